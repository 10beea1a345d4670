"""Top-k BM25 over a stored index of posting blocks.

A block holds a term's postings in one range of documents (about ``span`` of like
length, by their hashes) with the highest factor that the term gets
there; a term's row has its document frequency and the highest factor at all.
Both tables are bucketed by term, so a query's literals choose the buckets, and
the blocks are sorted by term and range, so they choose the pages in them.

A search first reads the few ranges whose bounds add up to most, which are those that
hold the rare terms: the k-th best score there is a threshold that the answer reaches.  Terms that together stay below it are optional:
a document with none of the others can't be in the answer.  Ranges whose blocks'
bounds don't add up to the threshold aren't read, and of the optional terms only
the blocks of ranges in which a document can still reach it.  All bounds hold, so
the answer is that of :func:`lexical.bm25`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..cluster import bucketed, read_bucketed, staged
from ..config import DEFAULT, Settings
from .lexical import LexicalIndex, exact_total, word_counts

#: Documents to a range, on average.
SPAN = 128
#: Ranges that are read for the first threshold, besides those that hold twice the answer.
FIRST = 8
#: Scores may differ by this much from their bounds, which aren't summed as decimals.
SLACK = 2e-6
#: Ranges up to which a list of them is broadcast.
SMALL = 2_000_000

BLOCKS = "term STRING, part BIGINT, top DOUBLE, n BIGINT, rows ARRAY<STRUCT<doc: {0}, cid: {1}, weight: DOUBLE, tf: BIGINT, dl: BIGINT>>"
TERMS = "term STRING, df BIGINT, top DOUBLE"


def factor(tf: Column, dl: Column, avgdl: Column, s: Settings) -> Column:
    """What a term's frequency gives, before its idf."""
    return tf * (s.k1 + 1) / (tf + s.k1 * (1 - s.b) + (s.k1 * s.b) / avgdl * dl)


@dataclass
class Answer:
    scores: DataFrame  # doc, cid, weight, score: the k best are among them
    read: DataFrame  # postings: read; of: all of the query's terms


@dataclass
class BlockIndex:
    blocks: DataFrame  # term, part, top, n, rows
    terms: DataFrame  # term, df, top
    corpus: DataFrame  # n, avgdl, span, k1, b, kinds

    @classmethod
    def build(cls, index: LexicalIndex, span: int = SPAN, s: Settings = DEFAULT) -> BlockIndex:
        one = staged(index.corpus.select("n", F.greatest("avgdl", F.lit(1e-9)).alias("avgdl")))  # one row, asked for again and again
        # documents of like length share ranges: what a term gives depends on it, so bounds are close
        like = F.floor(8 * F.log2(F.col("dl") + 1.0))
        sizes = F.broadcast(staged(index.documents.groupBy(like.alias("like")).agg(F.ceil(F.count("*") / span).alias("ranges"))))  # some hundred rows at most
        part = (F.col("like") * (1 << 40) + F.pmod(F.xxhash64("doc"), F.col("ranges"))).alias("part")
        if index.tokens is None:
            rows = index.postings.where("tf > 0").withColumn("like", like).join(sizes, "like").select("*", part)
        else:
            # a range's documents are brought together, as text: all its postings are then made, counted and gathered in one task
            docs = index.tokens.where("dl > 0").withColumns({"like": like, "words": F.array_join("tokens", " ")}).join(sizes, "like")
            docs = docs.select("doc", "cid", "weight", "dl", "words", part).repartition("part")
            each = docs.select("part", "doc", "cid", "weight", "dl", F.explode(F.split("words", " ")).alias("term"))
            rows = each.groupBy("part", "doc", "cid", "weight", "dl", "term").agg(F.count("*").alias("tf"))
        rows = rows.crossJoin(F.broadcast(one))
        rows = rows.select("term", "part", factor(F.col("tf"), F.col("dl"), F.col("avgdl"), s).alias("f"), F.struct("doc", "cid", "weight", "tf", "dl").alias("row"))
        blocks = rows.groupBy("term", "part").agg(F.max("f").alias("top"), F.count("*").alias("n"), F.collect_list("row").alias("rows"))  # about span at most
        terms = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("top"))
        kinds = F.lit(",".join(index.postings.schema[c].dataType.simpleString() for c in ("doc", "cid")))
        return cls(blocks, terms, one.withColumns({"span": F.lit(span), "k1": F.lit(float(s.k1)), "b": F.lit(float(s.b)), "kinds": kinds}))

    def save(self, path: str, buckets: int = 64) -> None:
        bucketed(self.blocks, f"{path}/blocks", buckets, "term", "part")
        heads = self.blocks.sparkSession.read.parquet(f"{path}/blocks")  # what was written: no posting is made again
        bucketed(heads.groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("top")), f"{path}/terms", buckets, "term")
        self.corpus.coalesce(1).withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/corpus")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BlockIndex:
        corpus = spark.read.parquet(f"{path}/corpus")
        one = corpus.first()
        blocks = read_bucketed(spark, f"{path}/blocks", BLOCKS.format(*one.kinds.split(",")), one.buckets, "term", "part")
        return cls(blocks, read_bucketed(spark, f"{path}/terms", TERMS, one.buckets, "term"), corpus)

    def _of(self, names: list[str], parts: DataFrame | None = None) -> DataFrame:
        """The blocks of these terms, in these ranges."""
        mine = self.blocks.where(F.col("term").isin(names))
        if parts is None:
            return mine
        return mine.join(F.broadcast(parts) if parts.limit(SMALL + 1).count() <= SMALL else parts, "part", "left_semi")

    def search(self, text: str, k: int, s: Settings = DEFAULT) -> Answer:
        """The k best documents for a query, and how much of the index that took.

        The query's terms and two thresholds go through the driver.
        """
        spark, one, asked = self.blocks.sparkSession, self.corpus.first(), word_counts(text)
        if (one.k1, one.b) != (float(s.k1), float(s.b)):
            raise ValueError("the index was built with another k1 or b")
        worth, df, most = {}, {}, {}
        for r in self.terms.where(F.col("term").isin(list(asked))).collect():
            idf = math.log((one.n - r.df + 0.5) / (r.df + 0.5) + 1.0)
            if idf >= s.least_idf:
                worth[r.term], df[r.term] = asked[r.term] * idf, r.df
                most[r.term] = worth[r.term] * r.top
        if not worth or k < 1:
            none = self.blocks.where("false").select(F.explode("rows").alias("r")).select("r.doc", "r.cid", "r.weight", F.lit(0.0).alias("score"))
            return Answer(none, spark.range(1).select(F.lit(0).cast("long").alias("postings"), F.lit(0).cast("long").alias("of")))
        worth_of = F.element_at(F.create_map(*[F.lit(x) for pair in worth.items() for x in pair]), F.col("term"))

        def summed(blocks: DataFrame) -> DataFrame:
            each = blocks.select("term", "part", F.explode("rows").alias("r")).select("term", "part", "r.*")
            part = worth_of * factor(F.col("tf"), F.col("dl"), F.lit(one.avgdl), s)
            return each.groupBy("part", "doc", "cid", "weight").agg(exact_total(part).alias("total"))

        # bounds of ranges come from the blocks' heads; the rows aren't read
        bound = worth_of * F.col("top")
        bounds = staged(self._of(list(worth)).select("part", "term", bound.alias("bound")))
        best = bounds.groupBy("part").agg(F.sum("bound").alias("all")).orderBy(F.desc("all"), "part").limit(FIRST + 2 * -(-k // one.span)).select("part")
        best = staged(best)  # a few ranges, those that promise most: where rare terms are
        head = summed(self._of(list(worth), best)).select("total").orderBy(F.desc("total")).limit(k)
        low = head.agg(F.min("total").cast("double").alias("low"), F.count("*").alias("n")).first()
        least = low.low - SLACK if low.n == k else 0.0
        optional, rest = [], 0.0
        for term in sorted(worth, key=lambda t: (most[t], t)):
            rest += most[term]
            if rest >= least:
                break
            optional.append(term)
        needed = [t for t in worth if t not in optional]
        extra = F.col("term").isin(optional)
        sums = bounds.groupBy("part").agg(F.sum("bound").alias("all"), F.sum(F.when(extra, F.col("bound")).otherwise(0.0)).alias("rest"), F.count_if(~extra).alias("needed"))
        live = staged(sums.where((F.col("all") >= least) & (F.col("needed") > 0)).select("part", "rest"))
        found = staged(summed(self._of(needed, live)).join(live, "part"))
        read = self._of(needed, live)
        if optional:
            second = found.orderBy(F.desc("total")).limit(k).agg(F.min("total").cast("double").alias("low"), F.count("*").alias("n")).first()
            least = max(least, second.low - SLACK if second.n == k else 0.0)
            hopeful = found.where(F.col("total") + F.col("rest") >= least)
            parts = hopeful.select("part").distinct()
            more = summed(self._of(optional, parts)).select("doc", F.col("total").alias("more"))
            found = hopeful.join(more, "doc", "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0)))
            read = read.unionByName(self._of(optional, parts))
        read = read.unionByName(self._of(list(worth), best)).select("term", "part", "n").distinct()
        scores = found.select("doc", "cid", "weight", F.col("total").cast("double").alias("score"))
        return Answer(scores.where("score > 0"), read.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("postings"), F.lit(sum(df.values())).alias("of")))
