"""Dense retrieval: exact inner products, with pluggable embedders."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..cluster import ship
from ..functions.numeric import round_exact
from .vectors import near_best


class Embedder(Protocol):
    """Texts to unit vectors; made once in each Python worker."""

    def encode(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """A stand-in without a model: hashed words, L2-normalised."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts: list[str]) -> list[list[float]]:
        import re
        import zlib

        import numpy as np

        out = np.zeros((len(texts), self.size), np.float32)
        for row, text in zip(out, texts):
            for w in re.findall(r"[a-z0-9_\-\.]+", (text or "").lower()):
                h = zlib.crc32(w.encode())
                row[h % self.size] += 1.0 if h >> 31 else -1.0
            n = float(np.sqrt((row * row).sum()))
            if n:
                row /= n
        return out.tolist()


def embed(df: DataFrame, text: str, make: Callable[[], Embedder], out: str = "embedding", batch: int = 128) -> DataFrame:
    """``df`` with a vector for each text; blank texts get null."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            values: list = [None] * len(part)
            there = [k for k, t in enumerate(part) if t and t.strip()]
            for at in range(0, len(there), batch):
                some = there[at : at + batch]
                for k, v in zip(some, model.encode([part.iloc[k] for k in some])):
                    values[k] = v
            yield pd.Series(values)

    ship(df.sparkSession)
    return df.withColumn(out, run(F.col(text)))


def inner(a: Column, b: Column) -> Column:
    """The inner product in double precision, added from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def best_by_product(vectors: DataFrame, asked: list[float], k: int, key: str = "doc", embedding: str = "embedding", digits: int | None = None, score: str = "score", least: float = float("-inf")) -> DataFrame:
    """The k best rows by inner product, rounded to ``digits`` if given, ties by key.

    Matrix products of whole batches choose who can be among them; their scores come from :func:`inner`.
    """
    value = inner(F.col(embedding), vector(asked))
    value = value if digits is None else F.round(value, digits)
    return near_best(vectors, asked, k, embedding, least).withColumn(score, value).drop(embedding).orderBy(F.desc(score), F.asc(key)).limit(k)


def search(vectors: DataFrame, asked: list[float], k: int, key: str = "doc", embedding: str = "embedding", score: str = "score") -> DataFrame:
    """The k best rows by inner product, ties by key."""
    return best_by_product(vectors, asked, k, key, embedding, None, score)


def search_owners(vectors: DataFrame, asked: list[float], k: int, key: str = "doc") -> DataFrame:
    """(cid, score, top_chunks) of owners, from the best 5k chunks; scores to four digits."""
    from .lexical import by_owner

    return by_owner(search(vectors, asked, 5 * k, key)).withColumn("score", round_exact(F.col("score"), 4))
