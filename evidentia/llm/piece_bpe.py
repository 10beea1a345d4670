"""SentencePiece encoding and decoding with a merge-type prefix table.

Of a merge-type (BPE) model, the encoding of a prefix of a text ends in one
token only, and what stands before that token is the encoding of a shorter
prefix.  So a table with the last token of each prefix holds the encodings of
all prefixes.  It is filled from left to right: an Aho-Corasick automaton
gives the pieces that end at a position, and the one piece is stored that is
compatible with the last token of the prefix before it (two tokens are
compatible if the model encodes their joint text as these two).  The ids are
then recovered backwards from the end.

Texts are cut where no piece can reach across: before a run of spaces, between
most words and the signs behind them, and around characters that are in no
longer piece.  The segments of many texts are encoded together: the automaton
is kept as arrays, and their tables are filled side by side, one prefix length
after another.  (Long segments have their tables filled one by one.)  A segment
is encoded once and kept in a table of each Python worker, which is bounded in
entries and, as long segments aren't kept, in bytes (about 50 MB).

Defined results
---------------
* null and empty texts have only the begin and end ids and decode to "";
* characters without a piece become their UTF-8 byte pieces, or the unknown
  id if the model has none;
* very long texts are encoded whole, segment by segment;
* each row is encoded by itself, so ties, repeated rows and null ids do no harm;
* an empty table gives an empty result; extra columns pass through, but for those
  named as a new one, which are replaced.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import struct
from array import array
from itertools import chain, islice, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import append_columns, in_pieces, table, texts

SPACE = "▁"


class Automaton:
    """The pieces' Aho-Corasick automaton as arrays, for many texts at once.  State 0 is the root."""

    def __init__(self, pieces: dict[str, int]):
        number = {p: k for k, p in enumerate(sorted({p[:k] for p in pieces for k in range(len(p) + 1)}, key=len))}
        self.sign = np.zeros(0x110000, np.int32)  # 0 for a character in no piece
        sign = {c: k for k, c in enumerate(sorted(set().union(*pieces)), 1)}
        self.sign[[ord(c) for c in sign]] = list(sign.values())
        self.piece = np.array([pieces.get(p, -1) for p in number])
        #: The state of the longest proper suffix that has one; of those the first that is a piece, from the state itself on and behind it.
        self.fail, self.first, self.shorter = (np.zeros(len(number), np.int64) for _ in range(3))
        children: dict[int, list[tuple[int, int]]] = {}
        for p, k in number.items():
            if p:
                f = self.fail[k] = next(number[p[j:]] for j in range(1, len(p) + 1) if p[j:] in number)
                self.shorter[k] = self.first[f]
                self.first[k] = k if p in pieces else self.first[f]
                children.setdefault(number[p[:-1]], []).append((sign[p[-1]], k))
        # The children of all states lie in one row, a state's at its offset plus their signs.
        slots = 4 * len(number) + len(sign)
        self.offset, self.owner, self.child = np.zeros(len(number), np.int64), np.full(slots + len(sign) + 1, -1), np.zeros(slots + len(sign) + 1, np.int64)
        taken, draw = bytearray(slots + len(sign) + 1), random.Random(0)
        for k, below in sorted(children.items(), key=lambda x: -len(x[1])):
            at = draw.randrange(slots)
            while any(taken[at + c] for c, _ in below):
                at = draw.randrange(slots)
            self.offset[k] = at
            for c, child in below:
                taken[at + c], self.owner[at + c], self.child[at + c] = 1, k, child

    def step(self, state: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """The states after one more character each."""
        out, todo = np.zeros(len(state), np.int64), np.arange(len(state))
        while len(todo):
            at = self.offset[state] + sign
            there = self.owner[at] == state
            out[todo[there]] = self.child[at[there]]
            more = ~there & (state > 0)
            todo, state, sign = todo[more], self.fail[state[more]], sign[more]
        return out


class PieceModel:
    """A merge-type SentencePiece model, read by the library; encodes and decodes itself."""

    #: Segments kept in each of two generations, the longest of them, slots for pairs of tokens,
    #: and the most characters of segments whose tables are filled side by side.
    KEPT, LONGEST, PAIRS, BLOCK = 65_536, 64, 1_048_573, 1 << 17

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(lib.get_piece_size())
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        special = {i for i in ids if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)}
        names = [lib.id_to_piece(i) for i in ids]
        self.piece = [p.replace(SPACE, " ") for p in names]
        self.id = {self.piece[i]: i for i in ids if i not in special and " " not in names[i]}
        self.score = {p: lib.get_score(i) for p, i in self.id.items()}
        self.byte = {int(names[i][3:5], 16): i for i in ids if lib.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.control = {i for i in ids if lib.is_control(i)}
        self.whole = {p for p in self.id if self.merged(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for p in self.whole:
            self.automaton.add_word(p, self.id[p])
        self.automaton.make_automaton()
        chars = set().union(*self.id)
        self.gap = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in chars)
        self.arrays = Automaton({p: self.id[p] for p in self.whole})
        self.size = [len(p) for p in self.piece]
        self.sizes = np.array(self.size)
        self.pairs = array("q", [-1]) * self.PAIRS
        self.cut = self._cuts()
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _cuts(self) -> re.Pattern:
        """A pattern of segments between which no piece of the model can reach."""
        after = {a + b for p in self.id for a, b in zip(p, p[1:])}  # what follows what within a piece
        if any(x[1] == " " != x[0] for x in after):
            return re.compile(r"(?s).+")  # a piece spans words: no cut is safe
        inner = {c for x in after for c in x}
        lone = "".join(re.escape(c) for c in "\n\t" if c not in inner)
        # Signs that no piece has behind a letter begin a segment of their own, but behind what a piece has before one of them.
        signs = {c for c in string.punctuation if not any(x[1] == c and x[0].isalpha() for x in after)}
        ties = signs | {x[0] for x in after if x[1] in signs} - {" "}
        sign, tie = ("".join(map(re.escape, sorted(c))) for c in (signs, ties))
        parts = [rf" *+[^ {lone}{tie}]++(?:(?=[{sign}])|[^ {lone}]*+)"] if signs else []
        parts += [rf" *[^ {lone}]+", " +"] + ([rf"[{lone}]"] if lone else [])
        return re.compile("|".join(parts))

    def merged(self, text: str) -> list[str]:
        """The model's merges, one by one: the best score first, leftmost of equals."""
        parts, score, none = list(text), self.score.get, float("-inf")
        scores = [score(a + b, none) for a, b in pairwise(parts)]
        while scores and (best := max(scores)) > none:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            for k in range(max(i - 1, 0), min(i + 1, len(scores))):
                scores[k] = score(parts[k] + parts[k + 1], none)
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether the text of ``a`` and ``b`` is encoded as these two tokens."""
        return self.merged(a + b) == [a, b]

    def fits(self, before: int, i: int) -> bool:
        """Whether two tokens are compatible; kept in the pair's slot, from which it drives another pair."""
        key = before * len(self.piece) + i
        slot = key % self.PAIRS
        if self.pairs[slot] >> 1 != key:
            self.pairs[slot] = key << 1 | self.compatible(self.piece[before], self.piece[i])
        return self.pairs[slot] & 1 == 1

    def tokens(self, text: str) -> list[int]:
        """The ids of a normalised text, by the prefix table; -1 for a character without a piece."""
        n, fits, size = len(text), self.fits, self.size
        last = [-1] * (n + 1)  # id of the last token of the prefix that ends there
        for at, i in self.automaton.iter(text):
            if last[at + 1] < 0:
                start = at + 1 - size[i]
                before = last[start]
                if start and before >= 0 and not fits(before, i):  # a character without a piece merges with nothing
                    continue
                last[at + 1] = i
        out = []
        while n:
            i = last[n]
            out.append(i)
            n -= size[i] if i >= 0 else 1
        out.reverse()
        return out

    def tokens_of(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What :meth:`tokens` gives for each of many segments of at most ``LONGEST`` characters, one behind
        the other, and where each one's end.  Their tables are filled side by side, from short prefixes to long ones."""
        arrays = self.arrays
        lengths = np.array([len(s) for s in segments])
        ends = np.cumsum(lengths + 1) - 1
        heads = ends - lengths  # a segment's table goes from its head to its end
        signs = arrays.sign[np.frombuffer(self.gap.join(segments).encode("utf-32-le"), np.uint32)]
        last = np.full(ends[-1] + 1, -1)
        last[heads] = -2  # no token: any piece may begin a segment
        keys = np.frombuffer(self.pairs, np.int64)
        order = np.argsort(-lengths, kind="stable")
        place, state = heads[order], np.zeros(len(order), np.int64)
        for n in np.searchsorted(-lengths[order], -np.arange(1, lengths.max() + 1), "right").tolist():
            place, state = place[:n] + 1, arrays.step(state[:n], signs[place[:n]])
            node = arrays.first[state]  # the longest piece that ends here
            todo = np.flatnonzero(node)
            node = node[todo]
            while len(todo):
                i, at = arrays.piece[node], place[todo]
                before = last[at - self.sizes[i]]
                key = before * len(self.piece) + i
                held = keys[key % self.PAIRS]
                fit = (before < 0) | (held & 1 == 1)
                for k in np.flatnonzero((before >= 0) & (held >> 1 != key)).tolist():
                    fit[k] = self.fits(int(before[k]), int(i[k]))
                last[at[fit]] = i[fit]
                node = arrays.shorter[node]
                more = ~fit & (node > 0)
                todo, node = todo[more], node[more]
        steps, live, at = [], np.flatnonzero(lengths), ends.copy()
        while len(live):
            i = last[at[live]]
            steps.append((live, i))
            at[live] -= np.where(i >= 0, self.sizes[i], 1)
            live = live[at[live] > heads[live]]
        stop = np.cumsum(sum(np.bincount(which, minlength=len(segments)) for which, _ in steps))
        out = np.empty(stop[-1], np.int64)
        for k, (which, i) in enumerate(steps):
            out[stop[which] - 1 - k] = i
        return out, stop

    def segments(self, wanted: set[str]) -> tuple[dict[str, bytes], dict[str, str]]:
        """Segments' ids as little-endian integers, and what they decode to where that isn't the segment."""
        new, old = self.new, self.old
        out = {s: found for s in wanted if (found := new.get(s) or old.get(s))}
        odd: dict[str, str] = {}
        short, long = [], []
        for s in wanted - out.keys():
            (short if len(s) <= self.LONGEST else long).append(s)
        for block in in_pieces(short, self.BLOCK):
            ids, stop = self.tokens_of(block)
            raw, lone, shown = ids.astype("<u4").tobytes(), (ids < 0).any(), [self.piece[i] for i in ids.tolist()]
            a = 0
            for s, b in zip(block, stop.tolist()):
                if lone and (ids[a:b] < 0).any():
                    out[s] = self._fallen_back(s, ids[a:b].tolist(), odd)
                else:
                    out[s] = raw[4 * a : 4 * b]
                    if (decoded := "".join(shown[a:b])) != s:
                        odd[s] = decoded
                a = b
        if len(new) + len(out) > self.KEPT:
            self.old, self.new = new, {}
        self.new.update(islice(out.items(), self.KEPT))
        for s in odd:
            self.new.pop(s, None)
        for s in long:
            out[s] = self._fallen_back(s, self.tokens(s), odd)
        return out, odd

    def _fallen_back(self, text: str, ids: list[int], odd: dict[str, str]) -> bytes:
        """``ids``, with what stands for the characters without a piece; ``odd`` gets what they decode to if that isn't the text."""
        if -1 in ids:
            ids = self._fallback(text, ids)
        if (decoded := self.joined(ids)) != text:
            odd[text] = decoded
        return struct.pack(f"<{len(ids)}I", *ids)

    def _fallback(self, text: str, ids: list[int]) -> list[int]:
        """``ids`` with what stands for the characters without a piece."""
        out, at = [], 0
        for i in ids:
            if i >= 0:
                out.append(i)
                at += len(self.piece[i])
            else:
                out += [self.byte[b] for b in text[at].encode()] if self.byte else [self.unk]
                at += 1
        return out

    def joined(self, ids: list[int]) -> str:
        """The text of ids, with the space that begins it."""
        out, held = [], bytearray()
        for i in [*ids, -1]:
            b = self.of_byte.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(decode_bytes(bytes(held)))
                held.clear()
            if i == self.unk:
                out.append(" ⁇ ")
            elif i >= 0 and i not in self.control:
                out.append(self.piece[i])
        return "".join(out)

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Each text's ids without begin and end as little-endian integers, and their decoded text."""
        spaced = [" " + t.replace(SPACE, " ") if t else "" for t in texts]
        split = [self.cut.findall(t) for t in spaced]
        ids, odd = self.segments(set(chain.from_iterable(split)))
        out = []
        for decoded, parts in zip(spaced, split):
            if odd and not odd.keys().isdisjoint(parts):
                decoded = "".join([odd.get(s, s) for s in parts])
            out.append((b"".join([ids[s] for s in parts]), decoded[1:] if decoded[:1] == " " else decoded))
        return out

    def encode_decode(self, text: str) -> tuple[bytes, str]:
        """What :meth:`encode_all` gives for one text."""
        return self.encode_all([text])[0]

    def encode(self, text: str) -> list[int]:
        ids = self.encode_decode(text)[0]
        return [self.bos, *struct.unpack(f"<{len(ids) // 4}I", ids), self.eos]

    def decode(self, ids: list[int]) -> str:
        ids = [i for i in ids if i not in self.control]
        text = self.joined(ids)
        return text[1:] if ids and ids[0] not in self.of_byte and self.piece[ids[0]][:1] == " " else text


def decode_bytes(held: bytes) -> str:
    """UTF-8, with one replacement character for each byte that is no part of a character."""
    out, k = [], 0
    while k < len(held):
        b = held[k]
        n = 1 if b < 0x80 else 2 if b >> 5 == 6 else 3 if b >> 4 == 14 else 4 if b >> 3 == 30 else 0
        try:
            out.append(held[k : k + n].decode() if n else "�")
        except UnicodeDecodeError:
            out.append("�")
            n = 1
        k += n or 1
    return "".join(out)


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The worker's own copy, made once."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_documents(df: DataFrame, path: str, text_col: str = "text", keep_ids: bool = True, keep_decoded: bool = True, keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for,
    ``ids`` (binary, little-endian 32-bit) and ``decoded``.

    ``path`` is the model's path on every executor; ``keep`` limits which columns of ``df`` come out.
    """

    def make():
        m = model(path)
        begin, end = struct.pack("<I", m.bos), struct.pack("<I", m.eos)

        def work(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in fields}
            for ids, decoded in chain.from_iterable(map(m.encode_all, in_pieces(texts(batch, text_col)))):
                ids = begin + ids + end
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    out["ids"].append(ids)
                if keep_decoded:
                    out["decoded"].append(decoded)
            return out

        return work

    fields = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    if keep_ids:
        fields["ids"] = "binary"
    if keep_decoded:
        fields["decoded"] = "string"
    return append_columns(df, make, fields, keep)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, default_model(), keep_ids=False, keep_decoded=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
