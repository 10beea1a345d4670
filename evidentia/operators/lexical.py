"""Lexical retrieval: an inverted index as plain tables, and BM25 over it.

The index is two tables, postings (term, doc, tf, dl, cid, weight) and
documents (doc, cid, weight, section, dl), plus one row of corpus statistics.
Postings carry the document's length, owner and weight, so a query needs one
join with the handful of its terms and one aggregation by document.  An index
that isn't stored is asked by its tokens: those that aren't in the query go
before anything is counted, so no posting of another term is ever made.

Scores are summed as decimals: their sums don't depend on the order, so partial
sums are taken before each shuffle and equal inputs give bitwise equal scores.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..cluster import bucketed, read_bucketed
from ..config import DEFAULT, Settings
from ..functions.text import TOKEN, any_of, tokens

POSTINGS = "term STRING, doc {0}, cid {1}, weight DOUBLE, tf BIGINT, dl BIGINT"


@dataclass
class LexicalIndex:
    postings: DataFrame  # term, doc, cid, weight, tf, dl
    documents: DataFrame  # doc, cid, weight, section, dl
    corpus: DataFrame  # n, avgdl
    tokens: DataFrame | None = None  # doc, cid, weight, dl, tokens; of an index that isn't stored

    def matches(self, terms: DataFrame) -> DataFrame:
        """The postings of the query's terms, with the terms' columns."""
        asked = F.broadcast(terms)  # a query's terms: a few rows
        if self.tokens is None:  # literals choose the buckets and the pages that are read
            names = [r.term for r in terms.select("term").collect()]
            return self.postings.where(F.col("term").isin(names)).join(asked, "term")
        hits = self.tokens.select("doc", "cid", "weight", "dl", F.explode("tokens").alias("term")).join(asked, "term")
        return hits.groupBy("doc", "cid", "weight", "dl", *terms.columns).agg(F.count("*").alias("tf"))

    def save(self, path: str, buckets: int = 64) -> None:
        """As parquet; postings bucketed by term and sorted in the buckets, so that a query
        reads its terms' buckets only and joins without an exchange."""
        bucketed(self.postings, f"{path}/postings", buckets, "term")
        self.documents.write.mode("overwrite").parquet(f"{path}/documents")
        kinds = F.lit(",".join(self.postings.schema[c].dataType.simpleString() for c in ("doc", "cid")))
        self.corpus.coalesce(1).withColumns({"buckets": F.lit(buckets), "kinds": kinds}).write.mode("overwrite").parquet(f"{path}/corpus")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LexicalIndex:
        corpus = spark.read.parquet(f"{path}/corpus")
        one = corpus.first()
        postings = read_bucketed(spark, f"{path}/postings", POSTINGS.format(*one.kinds.split(",")), one.buckets, "term")
        return cls(postings, spark.read.parquet(f"{path}/documents"), corpus.select("n", "avgdl"))


def build_index(chunks: DataFrame, doc: str = "doc", cid: str = "cid", weight: str = "weight", section: str | None = None, text: str = "text") -> LexicalIndex:
    """From chunks of text.  Term frequencies are counted by hash, in the task that
    holds the chunk first; a text without tokens has length 0 and no postings."""
    sec = F.col(section) if section else F.lit(None).cast("string")
    base = chunks.select(F.col(doc).alias("doc"), F.col(cid).alias("cid"), F.col(weight).cast("double").alias("weight"), sec.alias("section"), tokens(F.col(text)).alias("tokens"))
    sized = base.withColumn("dl", F.size("tokens").cast("long"))
    postings = sized.select("doc", "cid", "weight", "dl", F.explode("tokens").alias("term")).groupBy("doc", "cid", "weight", "dl", "term").agg(F.count("*").alias("tf"))
    documents = sized.select("doc", "cid", "weight", "section", "dl")
    corpus = documents.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return LexicalIndex(postings.select("term", "doc", "cid", "weight", "tf", "dl"), documents, corpus, sized.drop("section"))


def word_counts(text: str) -> Counter[str]:
    """A query's terms and how often each occurs, in the order in which they first do."""
    return Counter(re.findall(TOKEN, text.lower()))


def query_terms(spark: SparkSession, text: str) -> DataFrame:
    """(term, qtf, pos) of a query, in the order in which terms first occur."""
    rows = [(t, n, k) for k, (t, n) in enumerate(word_counts(text).items())]
    return spark.createDataFrame(rows, "term string, qtf int, pos int")


def exact_total(value: Column) -> Column:
    """A sum of doubles that doesn't depend on their order, to fifteen decimals."""
    return F.sum(value.cast("decimal(28,15)"))


def exact_sum(value: Column) -> Column:
    return exact_total(value).cast("double")


def bm25(index: LexicalIndex, terms: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(doc, cid, weight, score) of the documents with a score above zero.

    Terms with an idf below the least are dropped.
    """
    mine = index.matches(terms)
    df = mine.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))  # asks for tf, so that both uses share one shuffle
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    rated = df.crossJoin(F.broadcast(index.corpus)).withColumn("idf", idf).where(F.col("idf") >= s.least_idf)
    norm = F.col("tf") + s.k1 * (1 - s.b) + (s.k1 * s.b) / F.col("avgdl") * F.col("dl")
    part = F.col("qtf") * F.col("idf") * (F.col("tf") * (s.k1 + 1)) / norm
    scored = mine.join(F.broadcast(rated.select("term", "idf", "avgdl")), "term").select("doc", "cid", "weight", part.alias("part"))
    return scored.groupBy("doc", "cid", "weight").agg(exact_sum(F.col("part")).alias("score")).where("score > 0")


def by_owner(scored: DataFrame, score: str = "score", chunks: int = 5) -> DataFrame:
    """(cid, score, top_chunks): weighted sums over each owner's chunks, and its best
    chunks by score; without the latter if ``chunks`` is 0.

    No owner's chunks are gathered: sums are partial, and the window keeps the best of each task first.
    """
    total = scored.groupBy("cid").agg(exact_sum(F.col(score) * F.col("weight")).alias("score"))
    if not chunks:
        return total
    best = top_per_group(scored, "cid", chunks, F.col(score), "doc").select("cid", F.struct("rn", "doc", F.col(score).alias("score")).alias("x"))
    listed = F.transform(F.array_sort(F.collect_list("x")), lambda x: F.struct(x["doc"].alias("doc"), x["score"].alias("score")))
    return total.join(best.groupBy("cid").agg(listed.alias("top_chunks")), "cid")


def boosted(ranked: DataFrame, chunks: DataFrame, must: tuple[str, ...], titles: tuple[str, ...], k: int) -> DataFrame:
    """Boosts for title and skill chunks, but only in the head of max(5k, 2000) owners.

    ``chunks`` has cid, text, is_title and is_skill; a skill chunk's hits are the
    must-haves found in its distinct tokens, joined in order of first occurrence.
    """
    head = max(5 * k, 2000)
    order = Window.orderBy(F.desc("score"), F.asc("cid"))
    top = ranked.orderBy(F.desc("score"), F.asc("cid")).limit(head).withColumn("_rn", F.row_number().over(order))
    own = chunks.join(top.select("cid"), "cid", "left_semi")
    unique = F.array_join(F.array_distinct(tokens(F.col("text"))), " ")
    hits = F.size(F.filter(F.array(*[F.lit(m.lower()) for m in must]), lambda m: F.contains(unique, m))) if must else F.lit(0)
    gain = own.groupBy("cid").agg(
        F.max(F.when(F.col("is_title") & any_of(F.lower("text"), titles), 1).otherwise(0)).alias("_title"),
        F.sum(F.when(F.col("is_skill"), F.least(F.lit(0.20), 0.04 * hits)).otherwise(0.0)).alias("_skill"),
    )
    factor = 1 + 0.15 * F.coalesce("_title", F.lit(0)) + F.coalesce("_skill", F.lit(0.0))
    head_rows = top.join(gain, "cid", "left").withColumn("score", F.col("score") * factor).drop("_title", "_skill", "_rn")
    rest = ranked.join(top.select("cid"), "cid", "left_anti")
    return head_rows.unionByName(rest)


def top(df: DataFrame, k: int, score: str = "score", key: str = "cid") -> DataFrame:
    return df.orderBy(F.desc(score), F.asc(key)).limit(k)


def ranked(df: DataFrame, score: str = "score", key: str = "cid", name: str = "rank") -> DataFrame:
    """With a rank; for small, already limited frames only."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(F.desc(score), F.asc(key))).cast("long"))


def top_per_group(df: DataFrame, group: str, k: int, score: Column, key: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(group).orderBy(score.desc(), F.asc(key)))
    return df.withColumn("rn", rn).where(F.col("rn") <= k)
