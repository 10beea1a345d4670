"""Language identification with error-correcting output codes.

Every language has a codeword of bits.  For each bit a binary classifier over
hashed byte n-grams is trained; to decode, the margins of all bits are
compared with each codeword under a loss, and the codeword of the least loss
wins.  A text whose two best codewords are close is flagged as ambiguous.

Training uses at most about ``per_language`` rows of each language, taken by a
hash of the id, and gathers only their n-gram counts.  The prediction reads
nothing but the text.

Defined results
---------------
* a text that is null or has no letter gets ``und``, score 0, not ambiguous;
* without any labelled row there is nothing to learn: all texts get ``und``;
* with one language every text with a letter gets it, with score 1;
* ties between codewords go to the language that sorts first;
* very long texts are counted whole, slice by slice;
* rows are judged one by one, so repeated rows and null ids do no harm; an empty
  table gives an empty result;
* extra columns pass through, but for those named as a new one, which are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import append_columns, crc_fold, raw_texts, table

BITS = 13  # of a feature's number
LETTER = re.compile(r"[^\W\d_]")
#: A-Z to a-z; what ASCII has besides letters to a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SLICE = 1 << 20  # bytes of a text that are counted at a time


def ngram_counts(text: bytes) -> np.ndarray:
    """How often each hashed byte 2- and 3-gram occurs in the whole text."""
    total = np.zeros(1 << BITS, np.float64)
    folded = b" " + re.sub(rb" +", b" ", text.translate(FOLD)) + b" "
    for at in range(0, max(len(folded) - 2, 0), SLICE):
        b = np.frombuffer(folded[at : at + SLICE + 2], np.uint8).astype(np.uint32)
        two = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77)
        three = two + b[2:] * np.uint32(0xC2B2AE3D)
        for h in (two, three ^ np.uint32(0x27D4EB2F)):
            h = h ^ (h >> np.uint32(15))
            total += np.bincount((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return total


def features(counts: np.ndarray) -> np.ndarray:
    """Square roots of the frequencies: a vector of length 1 (or 0)."""
    return np.sqrt(counts / max(counts.sum(), 1.0))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """``n`` rows of +1 and -1, far from one another, whose columns all split the rows."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:  # exhaustive: each split of the rows once
        splits = [[1] + [1 if (k >> i) & 1 else -1 for i in range(n - 1)] for k in range(2 ** (n - 1) - 1)]
        return np.array(splits, float).T
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, int(np.ceil(15 * np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i])
        if apart > far:
            best, far = code, apart
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    margin: float = 0.15

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of rows of features: the languages, scores and whether they are ambiguous."""
        if not self.languages:
            return ["und"] * len(x), np.zeros(len(x)), np.zeros(len(x), bool)
        f = x @ self.weights + self.bias
        loss = np.logaddexp(0.0, -f[:, None, :] * self.code[None]).mean(axis=2)  # rows x languages
        p = np.exp(-loss * self.code.shape[1])
        p /= p.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        ranked = np.sort(p, axis=1)
        close = (ranked[:, -1] - ranked[:, -2] < self.margin) if p.shape[1] > 1 else np.zeros(len(x), bool)
        return [self.languages[k] for k in best], p[np.arange(len(x)), best], close


def fit(x: np.ndarray, y: list[str], rounds: int = 150, rate: float = 0.5, penalty: float = 1e-4) -> LanguageModel:
    """Logistic classifiers, one for each bit; languages weigh the same."""
    languages = sorted(set(y))
    code = codewords(len(languages))
    if len(languages) < 2:
        return LanguageModel(languages, code, np.zeros((1 << BITS, code.shape[1])), np.full(code.shape[1], 8.0))
    at = np.array([languages.index(v) for v in y])
    target = code[at]
    weight = (len(at) / len(languages) / np.bincount(at))[at][:, None] / len(at)
    mean = x.mean(axis=0, dtype=np.float64).astype(np.float32)
    z = x - mean
    w, b, m, v = np.zeros((x.shape[1], code.shape[1])), np.zeros(code.shape[1]), 0.0, 0.0
    for k in range(1, rounds + 1):
        g = -target * weight / (1 + np.exp(np.clip(target * (z @ w.astype(np.float32) + b), -50, 50)))
        gw = z.T @ g.astype(np.float32) + penalty * w
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
        b -= 2.0 * g.sum(axis=0)
    return LanguageModel(languages, code, w, b - mean @ w)


def train(rows: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = 400) -> LanguageModel:
    """Learn from ``rows``, of which about ``per_language`` of each language are used."""
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    have = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not have:
        return LanguageModel([], np.ones((0, 1)), np.zeros((1, 1)), np.zeros(1))
    share = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    rule = F.lit(False)
    for lang, n in have.items():
        rule = rule | ((F.col(lang_col) == lang) & (share < per_language / n))
    sample = rows.where(rule).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).limit(2 * per_language * len(have))

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, list]:
            counts = [ngram_counts(t) for t in raw_texts(batch, "text")]
            return {"counts": [features(c).astype(np.float32).tobytes() if c.any() else None for c in counts]}

        return work

    got = append_columns(sample, make, {"counts": "binary"}, keep=["lang"]).where("counts IS NOT NULL").collect()
    got = sorted((r.lang, bytes(r.counts)) for r in got)
    if not got:
        return LanguageModel([], np.ones((0, 1)), np.zeros((1, 1)), np.zeros(1))
    return fit(np.frombuffer(b"".join(c for _, c in got), np.float32).reshape(len(got), -1), [lang for lang, _ in got])


def predict_languages(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``ambiguous``."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, list]:
            raw = raw_texts(batch, text_col)
            lang, score, close = ["und"] * len(raw), [0.0] * len(raw), [False] * len(raw)
            for at in range(0, len(raw), 64):
                some = [k for k in range(at, min(at + 64, len(raw))) if LETTER.search(raw[k].decode("utf-8", "replace"))]
                if some:
                    found = sent.value.predict(np.array([features(ngram_counts(raw[k])) for k in some]))
                    for k, a, b, c in zip(some, *found):
                        lang[k], score[k], close[k] = a, min(1.0, max(0.0, float(b))), bool(c)
            return {"lang_pred": lang, "score": score, "ambiguous": close}

        return work

    return append_columns(df, make, {"lang_pred": "string", "score": "double", "ambiguous": "boolean"})


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False))
    model = train(docs.where(~held_out & F.col("doc_id").isNotNull()), "doc_id", "text", "lang")
    found = predict_languages(docs.select("doc_id", "text"), model).drop("text")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")
