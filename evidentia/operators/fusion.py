"""Fusion of retrieval lists, and the rerank blend."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..cluster import ship
from ..config import DEFAULT, Settings
from ..functions.numeric import round_exact
from ..functions.text import TOKEN


class PairScorer(Protocol):
    """Scores (query, text) pairs; made once in each Python worker."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class OverlapScorer:
    """A stand-in without a model: the share of the query's distinct tokens that a text has."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        import re

        sets = ([set(re.findall(TOKEN, x.lower())) for x in pair] for pair in pairs)
        return [len(q & t) / len(q) if q else 0.0 for q, t in sets]


def _rounded(x: Column, digits: int | None) -> Column:
    return x if digits is None else round_exact(x, digits)


def normalised(df: DataFrame, score: str, out: str, digits: int | None = 4) -> DataFrame:
    """``df`` with the score's min-max norm over all its rows; 0 for all if they are equal."""
    ends = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))  # one row
    norm = (F.col(score) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-9))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, _rounded(norm, digits)).drop("_lo", "_hi")


def weighted_norm(lex: DataFrame, sem: DataFrame, s: Settings = DEFAULT, digits: int | None = 4) -> DataFrame:
    """(cid, lexical_score, semantic_score, lexical_norm, semantic_norm, hybrid_score):
    each list is brought to 0..1 by itself; an owner that a list lacks has 0 there."""
    a = normalised(lex.withColumnRenamed("score", "lexical_score"), "lexical_score", "lexical_norm", digits)
    b = normalised(sem.withColumnRenamed("score", "semantic_score"), "semantic_score", "semantic_norm", digits)
    if "top_chunks" in a.columns:
        a = a.withColumnRenamed("top_chunks", "lexical_chunks")
    if "top_chunks" in b.columns:
        b = b.withColumnRenamed("top_chunks", "semantic_chunks")
    both = a.join(b, "cid", "full").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("lexical_score", "semantic_score", "lexical_norm", "semantic_norm")})
    hybrid = s.lexical_weight * F.col("lexical_norm") + s.semantic_weight * F.col("semantic_norm")
    return both.withColumn("hybrid_score", _rounded(hybrid, digits))


def reciprocal_rank(lex: DataFrame, sem: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(cid, rrf_score): the sum of 1 / (k + rank) over both lists, which are limited."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), F.asc("cid")))
    parts = [x.select("cid", (F.lit(1.0) / (s.rrf_k + rank)).alias("part"), F.lit(n).alias("n")) for n, x in enumerate((lex, sem))]
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("n", "part"))), F.lit(0.0), lambda acc, x: acc + x["part"])
    return parts[0].unionByName(parts[1]).groupBy("cid").agg(total.alias("rrf_score"))


def score_pairs(df: DataFrame, query: str, text: str, make: Callable[[], PairScorer], out: str = "pair_score", most: int = 512) -> DataFrame:
    """``df`` with a score of (query, text), each cut to ``most`` characters; no text gives null."""
    asked = query[:most]

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            values: list = [None] * len(part)
            there = [k for k, t in enumerate(part) if t]
            for k, v in zip(there, model.score([(asked, part.iloc[k]) for k in there])):
                values[k] = float(v)
            yield pd.Series(values)

    ship(df.sparkSession)
    return df.withColumn(out, run(F.substring(text, 1, most)))


def rerank(fused: DataFrame, pair: str | None, k: int, base: str = "hybrid_score", s: Settings = DEFAULT, digits: int | None = 4) -> DataFrame:
    """The head of ``k`` rows blended with normalised pair scores (null: no text, 0);
    the tail keeps a share of its score.  Without pair scores all pass through."""
    if pair is None:
        return fused.withColumns({"rerank_score": F.lit(0.0), "final_retrieval_score": F.col(base)})
    head = fused.orderBy(F.desc(base), F.asc("cid")).limit(k)
    ends = head.agg(F.min(pair).alias("_lo"), F.max(pair).alias("_hi"))  # one row
    norm = F.coalesce((F.col(pair) - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-9)), F.lit(0.0))
    blend = s.rerank_keep * F.col(base) + (1 - s.rerank_keep) * norm
    best = head.crossJoin(F.broadcast(ends)).withColumns({"rerank_score": _rounded(norm, digits), "final_retrieval_score": _rounded(blend, digits)}).drop("_lo", "_hi")
    tail = fused.join(F.broadcast(head.select("cid")), "cid", "left_anti")  # k rows
    return best.unionByName(tail.withColumns({"rerank_score": F.lit(0.0), "final_retrieval_score": s.tail_factor * F.col(base)}))
