"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item gives windows of ``window`` consecutive words (an item of
fewer words is one window).  A document contains a window only if it contains
all of the window's words, so a prefix of one token, the rarest in the
document collection, is necessary: documents are joined with windows on that
token alone.  A match of the token at word ``p`` fixes, for each offset that the
token has in a window, where the window would start; the positional and length
bounds (it has to begin at or after the document's first word and end before its
last) discard candidates, and the rest are verified word for word.

Rarity is the token's count over all documents, taken in one pass that counts
only words of the benchmark.

The benchmark's windows are sent to the executors in blocks of at most
``block_words`` words (or one item), about 400 bytes of index a word; what one
block broadcasts is thus bounded however large the benchmark is, and every
document meets every block.

Defined results
---------------
* null, empty or wordless texts have no words and no hits;
* wordless items and null texts have no window; items with equal texts each count;
* items with a null id hit as others do; together they are one null, the last in
  ``item_ids``, which counts there and has no part in the digest, as in SQL;
* rows that repeat an id are judged row by row; very long texts are read whole;
* an empty benchmark hits nothing, an empty table of documents gives an empty result;
* extra columns pass through, but for those named as a new one, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Workspace, append_columns, fresh, raw_texts, ship, table

WINDOW = 13

#: Bytes of a text to bytes of its words: A-Z become a-z, ASCII that is no
#: letter or digit becomes a space, and all bytes from 0x80 on stay.
WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text."""
    return text.translate(WORDS).split()


def item_windows(text: bytes, window: int = WINDOW) -> list[tuple[bytes, ...]]:
    """The distinct windows of an item, in order of their first occurrence."""
    w = words(text)
    if not w:
        return []
    n = min(window, len(w))
    return list(dict.fromkeys(tuple(w[i : i + n]) for i in range(len(w) - n + 1)))


class WindowIndex:
    """Windows by their prefix token, then by its offset in them and their length.

    A word of a document is thus compared with as many windows as there are offsets
    and lengths under it, at most ``window`` for full windows, however many windows share the token.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], counts: dict[bytes, int], window: int = WINDOW):
        owners: dict[tuple[bytes, ...], list[str | None]] = defaultdict(list)
        for item, text in items:
            for win in item_windows(text, window):
                owners[win].append(item)
        self.by_token: dict[bytes, dict[tuple[int, int], dict[tuple[bytes, ...], list[str | None]]]] = {}
        for win, ids in owners.items():
            _, token, at = min((counts.get(t, 0), t, i) for i, t in enumerate(win))
            self.by_token.setdefault(token, {}).setdefault((at, len(win)), {})[win] = ids

    def hits(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Spans of words (start, end) in which a window occurs, and the items."""
        spans, found, n, index = [], set(), len(w), self.by_token
        for p, token in [(p, t) for p, t in enumerate(w) if t in index]:
            for (at, size), windows in index[token].items():
                start, end = p - at, p - at + size
                if start >= 0 and end <= n and (ids := windows.get(tuple(w[start:end]))) is not None:
                    spans.append((start, end))
                    found.update(ids)
        return spans, found


def covered(spans: list[tuple[int, int]]) -> int:
    """How many positions the spans cover together."""
    total, end = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _blocks(bench: DataFrame, item_col: str, text_col: str, block_words: int):
    """The items in blocks of a bounded size, streamed through the driver."""
    block, size = [], 0
    rows = bench.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t"))
    for row in rows.where("t IS NOT NULL").toLocalIterator():
        n = len(words(bytes(row.t)))
        if not n:
            continue
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((row.i, bytes(row.t)))
        size += n
    if block:
        yield block


def _rarity(docs: DataFrame, text_col: str, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How often each word of the vocabulary occurs in all documents."""
    spark = docs.sparkSession
    ship(spark)
    known = spark.sparkContext.broadcast(vocabulary)

    def count(batches):
        total: Counter[bytes] = Counter()
        has = known.value.__contains__
        for batch in batches:
            for text in raw_texts(batch, text_col):
                total.update(filter(has, words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["w", "n"])

    rows = docs.select(text_col).mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return {bytes(r.w): r.n for r in rows.collect()}  # at most one row for each word of a block


def decontaminate(
    docs: DataFrame,
    bench: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = 150_000,
    workspace: Workspace | None = None,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``item_ids`` (sorted strings),
    ``spans`` (the hit stretches of words) and ``contaminated``."""
    spark = docs.sparkSession
    state = {k: fresh(docs, k) for k in ("spans", "items")}
    blocks = _blocks(bench, item_col, item_text_col, block_words)
    out, made, block = docs, 0, next(blocks, None)
    while block:
        after = next(blocks, None)
        vocabulary = frozenset(w for _, text in block for w in words(text))
        index = spark.sparkContext.broadcast(WindowIndex(block, _rarity(docs, text_col, vocabulary), window))
        if made == 1:
            workspace = workspace or Workspace(spark)
        if made:  # one block in a Python worker at a time
            out = workspace.cut(out, f"block{made + 1}")
        out = _met(out, index, text_col, state, first=not made) if after else _judged(out, index, text_col, state, docs.columns, first=not made)
        made, block = made + 1, after
    return out if made else _judged(docs, None, text_col, state, docs.columns, first=True)


def _hits_so_far(batch: pa.RecordBatch, index, text_col: str, state: dict[str, str], first: bool) -> Iterator[tuple[int, list[tuple[int, int]], list[str | None]]]:
    """Each text's number of words, and its spans and items in this block and those before."""
    before = None if first else [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in state.values()]
    for k, text in enumerate(raw_texts(batch, text_col)):
        w = words(text)
        s, i = index.value.hits(w) if index else ([], set())
        if before:
            s = [*zip(before[0][k][::2], before[0][k][1::2]), *s]
            i |= set(before[1][k])
        yield len(w), sorted(set(s)), sorted(i - {None}) + [None] * (None in i)


def _met(docs: DataFrame, index, text_col: str, state: dict[str, str], first: bool) -> DataFrame:
    """``docs`` with the hits so far, for the next block."""

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        found = list(_hits_so_far(batch, index, text_col, state, first))
        return {state["spans"]: [[x for pair in s for x in pair] for _, s, _ in found], state["items"]: [i for *_, i in found]}

    return append_columns(docs, lambda: work, {state["spans"]: "array<int>", state["items"]: "array<string>"})


def _judged(docs: DataFrame, index, text_col: str, state: dict[str, str], keep: list[str], first: bool) -> DataFrame:
    """The result, after the last block: in the same function that meets it, as a second one in the
    plan would take a second Python worker for each core, and workers live on with all that later stages load."""

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in fields}
        for n, spans, items in _hits_so_far(batch, index, text_col, state, first):
            hit = covered(spans)
            out["n_words"].append(n)
            out["n_hit"].append(hit)
            out["item_ids"].append(items)
            out["spans"].append([{"start": a, "end": b} for a, b in spans])
            out["contaminated"].append(hit > 0 and 20 * hit >= n)
        return out

    fields = {"n_words": "long", "n_hit": "long", "item_ids": "array<string>", "spans": "array<struct<start:int,end:int>>", "contaminated": "boolean"}
    return append_columns(docs, lambda: work, fields, keep=keep)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return done.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i + 1 : i + least(13, len(w))], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(d.w), FALSE) AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
