"""Toxicity by non-negative positive-unlabelled learning.

The positives are texts that are confirmed to be toxic; the unlabelled texts
are a sample of everything.  With the class prior ``p`` the risk of a
classifier is estimated as ``p R(+) + max(0, R_u(-) - p R_p(-))``: the second
term is what the unlabelled texts say about negatives after the positives
among them are taken off, and it may not fall below zero.  Where a step would
push it below zero, the step goes the other way, as the method asks.

The classifier is linear over hashed words.  Words that don't tell are left out
first, as part of the method: a word stays if it is commoner among the positives
than its rate in all documents explains (a Poisson test), with near copies of a
positive counted once; every word that passes is taken.  A word counts with the
logarithm of its frequency.  Weights minimise the logistic form of the risk; where
the score crosses one half is chosen by the same estimate of the zero-one risk,
``p (1 - TPR) + max(0, P_u(toxic) - p TPR)``.  No labelled negative is ever read:
reviewed rows only say what share of them, the prior ``p``, is toxic.

Samples are bounded: about ``positives`` toxic rows and ``unlabelled`` rows of all
texts, taken by hash of the id and written to the shared folder; the driver gets
signatures of the positives and counts of the chosen words.  How many texts have
a word is counted over all documents.

Defined results
---------------
* null and empty texts are scored by the bias alone;
* without a toxic row to learn from, or a word that tells, every score is 0;
* very long texts are counted whole;
* rows are scored one by one, so ties, repeats and null ids do no harm; an empty
  table gives an empty result;
* of several labels for an id any toxic one counts; extra columns pass through,
  but for those named as a new one, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Workspace, append_columns, bound_batches, crc_fold, hashed_words, in_pieces, letters_of, raw_texts, ship, table
from .decontamination import WORDS

BITS = 18
_LETTERS = letters_of(b" ")

Counts = tuple[np.ndarray, np.ndarray]


def word_numbers(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The hashed numbers of each text's words, in order."""
    for piece in in_pieces(texts):
        h, at = hashed_words([t.translate(WORDS) for t in piece], _LETTERS)
        numbers = (h >> np.uint64(64 - BITS)).astype(np.int32)
        yield from (numbers[lo:hi] for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()))


def word_counts(texts: list[bytes]) -> list[Counts]:
    """Numbers of the words in each text and how often they occur."""
    return [np.unique(n, return_counts=True) for n in word_numbers(texts)]


class Rows:
    """A sparse matrix of log counts over the chosen words."""

    def __init__(self, docs: list[Counts], chosen: np.ndarray):
        self.n = len(docs)
        self.row = np.repeat(np.arange(self.n), [len(i) for i, _ in docs])
        col, val = (np.concatenate([d[k] for d in docs]) if docs else np.empty(0, np.int32) for k in (0, 1))
        keep = chosen[col]
        self.row, self.col, self.val = self.row[keep], col[keep], np.log1p(val[keep].astype(float))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * g[self.row], 1 << BITS)


def signatures(docs: list[Counts], slots: int = 32) -> np.ndarray:
    """A MinHash of each text's words; -1 for a text without words."""
    rng = np.random.default_rng(5)
    a, b = (rng.integers(1 << 62, size=slots, dtype=np.uint64) | np.uint64(1) for _ in "ab")
    out = np.full((len(docs), slots), -1, np.int32)
    for k, (i, _) in enumerate(docs):
        if len(i):
            out[k] = ((i.astype(np.uint64)[:, None] * a + b) >> np.uint64(33)).min(axis=0).astype(np.int32)
    return out


def without_copies(signs: np.ndarray, alike: float = 0.4) -> list[int]:
    """Which texts stay when those whose words are much the same as an earlier one's go."""
    kept: list[int] = []
    for k, sign in enumerate(signs):
        if sign[0] >= 0 and (not kept or (signs[kept] == sign).mean(axis=1).max() < alike):
            kept.append(k)
    return kept


def telling_words(among: np.ndarray, positives: int, frequency: np.ndarray, total: int, sure: float = 9.0) -> np.ndarray:
    """A mask of the words that are significantly commoner in positives: the chance of
    being in ``among`` of them, at the rate ``frequency / total`` of all texts, is below
    about exp(-sure) (Chernoff's bound for a Poisson count)."""
    a = among / 1.0
    expected = (frequency + 1) * positives / (total + 1)
    return (a > expected) & (a * np.log(np.maximum(a, 1) / expected) - a + expected >= sure)


@dataclass
class ToxicityModel:
    weights: np.ndarray | None
    bias: float = 0.0
    gain: float = 1.0

    def score(self, index: np.ndarray, counts: np.ndarray) -> float:
        if self.weights is None:
            return 0.0
        f = float(np.log1p(counts.astype(float)) @ self.weights[index]) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.gain * f, -40, 40))))


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def negative_part(fp: np.ndarray, fu: np.ndarray, prior: float) -> float:
    """The risk on negatives as positives and unlabelled texts tell it: R_u(-) - p R_p(-)."""
    return float(np.mean(np.logaddexp(0, fu)) - prior * np.mean(np.logaddexp(0, fp)))


def risk(fp: np.ndarray, fu: np.ndarray, prior: float) -> float:
    """The non-negative estimate of the logistic risk, from the outputs for both samples."""
    return prior * float(np.mean(np.logaddexp(0, -fp))) + max(0.0, negative_part(fp, fu, prior))


def slopes(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """What a step goes along, by output: the risk's slope, or where the negative part
    is below zero, the slope of what is missing, so that the step brings it back."""
    sp, su = _sigmoid(fp), _sigmoid(fu)
    if negative_part(fp, fu, prior) >= 0:
        return prior * (sp - 1) / len(fp) - prior * sp / len(fp), su / len(fu)
    return prior * sp / len(fp), -su / len(fu)


def fit(pos: Rows, unl: Rows, prior: float, rounds: int = 200, rate: float = 0.3, penalty: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and bias of the least non-negative risk that the steps came across."""
    w = np.zeros((1 << BITS) + 1)  # the bias comes last
    m, v, best, least = np.zeros_like(w), np.zeros_like(w), w.copy(), np.inf
    for k in range(1, rounds + 1):
        fp, fu = (x.dot(w) + w[-1] for x in (pos, unl))
        if (now := risk(fp, fu, prior)) < least:
            best, least = w.copy(), now
        gp, gu = slopes(fp, fu, prior)
        g = np.append(pos.back(gp) + unl.back(gu), gp.sum() + gu.sum())
        g[:-1] += penalty * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-5)
    return best[:-1], float(best[-1])


def threshold(fp: np.ndarray, fu: np.ndarray, prior: float) -> float:
    """The output above which texts are called toxic: the least non-negative zero-one
    risk; in the middle of the widest gap among equals."""
    f = np.unique(np.concatenate((fp, fu)))
    edges = np.concatenate([[f[0] - 1e-3], (f[1:] + f[:-1]) / 2, [f[-1] + 1e-3]])
    caught, called = (1 - np.searchsorted(np.sort(x), edges, "right") / len(x) for x in (fp, fu))
    wrong = prior * (1 - caught) + np.maximum(0, called - prior * caught)
    gap = np.concatenate([[1e-6], f[1:] - f[:-1], [1e-6]])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float(edges[best[np.argmax(gap[best])]])


def _mapped(rows: DataFrame, text_col: str, make, fields: dict[str, str]) -> list:
    got = append_columns(rows.select(text_col), lambda: lambda batch: make(raw_texts(batch, text_col)), fields, keep=[]).collect()
    return sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in got)


def _text_key(t: bytes) -> int:
    return xxhash.xxh3_64_intdigest(t, seed=7) - (1 << 63)


def _chosen_counts(rows: DataFrame, text_col: str, chosen: np.ndarray) -> list[Counts]:
    """Counts of the chosen words in each row."""

    def make(texts: list[bytes]) -> dict[str, list]:
        found = [(i[chosen[i]], c[chosen[i]]) for i, c in word_counts(texts)]
        return {"i": [i.astype(np.int32).tobytes() for i, _ in found], "c": [c.astype(np.int32).tobytes() for _, c in found]}

    return [(np.frombuffer(i, np.int32), np.frombuffer(c, np.int32)) for i, c in _mapped(rows, text_col, make, {"i": "binary", "c": "binary"})]


def document_frequencies(docs: DataFrame, text_col: str, only: frozenset[int] | None = None) -> np.ndarray:
    """In how many of all texts each hashed word occurs (or of the texts with the keys
    ``only``, each once a task); each task sums up its own first."""

    def count(batches):
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            texts = raw_texts(batch, text_col)
            for n in word_numbers(texts if only is None else [t for t in texts if _text_key(t) in only]):
                total[np.unique(n)] += 1
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], ["i", "n"])

    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    found = docs.select(text_col).mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # 2^BITS rows at most
    out = np.zeros(1 << BITS, np.int64)
    out[found["i"].to_numpy()] = found["n"].to_numpy()
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, positives: int = 2500, unlabelled: int = 5000, workspace: Workspace | None = None) -> ToxicityModel:
    """Learn from ``labels``, which has none that are held out, and ``docs``."""
    flag = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    n = {r.y: r["count"] for r in flag.groupBy("y").count().collect()}
    n_pos, n_all = n.get(1, 0), sum(n.values())
    if not n_pos:
        return ToxicityModel(None)
    work = workspace or Workspace(docs.sparkSession)

    def share(salt: str):
        return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)

    some = flag.where((F.col("y") == 1) & (share("toxic") < positives / n_pos)).select(id_col)
    some = F.broadcast(some.limit(2 * positives))  # bounded by the parameter
    toxic = work.cut(docs.select(id_col, text_col).join(some, id_col, "left_semi").select(text_col).limit(4 * positives).dropDuplicates(), "toxic")
    total = docs.count()
    drawn = docs.where(share("unlabelled") < unlabelled / max(total, 1)).select(text_col)
    drawn = work.cut(drawn.limit(2 * unlabelled), "unlabelled")

    def signs(texts: list[bytes]) -> dict[str, list]:
        return {"key": list(map(_text_key, texts)), "sign": [x.tobytes() for x in signatures(word_counts(texts))]}

    seen = _mapped(toxic, text_col, signs, {"key": "long", "sign": "binary"})
    kept = frozenset(seen[k][0] for k in without_copies(np.array([np.frombuffer(x, np.int32) for _, x in seen]))) if seen else frozenset()
    model = ToxicityModel(None)
    if kept:
        chosen = telling_words(document_frequencies(toxic, text_col, kept), len(kept), document_frequencies(docs, text_col), total)
        if chosen.any():
            pos, unl = (Rows(_chosen_counts(rows, text_col, chosen), chosen) for rows in (toxic, drawn))
            unl = unl if unl.n else pos
            w, b = fit(pos, unl, n_pos / n_all)
            fp, fu = pos.dot(w), unl.dot(w)
            model = ToxicityModel(w.astype(np.float32), -threshold(fp, fu, n_pos / n_all), 3.0 / (float(np.std(np.concatenate((fp, fu)))) or 1.0))
    work.drop("toxic")
    work.drop("unlabelled")
    return model


def score_toxicity(df: DataFrame, model: ToxicityModel, text_col: str = "text", score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        found = [sent.value.score(*c) for c in word_counts(raw_texts(batch, text_col))]
        return {score: found, predicted: [int(s >= 0.5) for s in found]}

    return append_columns(df, lambda: work, {score: "double", predicted: "int"})


def training_labels(labels: DataFrame) -> DataFrame:
    """The rows of the training folds: crc32 of the id, modulo 5, isn't 0."""
    return labels.where(crc_fold("doc_id", 5) != 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = train(docs.select("doc_id", "text"), training_labels(labels), "doc_id", "text", "toxic")
    found = score_toxicity(docs.select("doc_id", "text"), model).drop("text")
    return found.select("doc_id", F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
