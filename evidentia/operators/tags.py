"""Near-duplicate tags of a table: of tags that are alike, the first in order stays.

Two tags are alike if they are equal or the shorter one (of three characters or more)
stands in the longer one between word borders, as the driver's ``Tags`` has it.  All
words of a contained tag are words of the longer one, so a tag is joined with those
that have its rarest word, and only these pairs are looked at.  What stays is then
settled in rounds: a tag before which no undecided tag is alike stays, and what is
alike to it and comes later goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..cluster import staged

SHORTEST, LONGEST = 2, 200


def alike_pairs(tags: DataFrame) -> DataFrame:
    """(a, b) of the distinct keys in ``tags`` (k): a stands in b as whole words."""
    words = F.regexp_extract_all("k", F.lit(r"(?U)\w+"), F.lit(0))
    signs = F.filter(F.split("k", ""), lambda c: (c != "") & (c != " "))  # of a tag without words
    each = staged(tags.select("k", F.size(words).alias("n"), F.explode(F.array_distinct(F.concat(words, F.filter(signs, lambda c: ~c.rlike(r"(?U)\w"))))).alias("t")))
    own = each.where((F.col("n") == 0) | F.col("t").rlike(r"(?U)\w")).where(F.length("k") >= 3)
    counts = each.groupBy("t").agg(F.count("*").alias("df"))
    rarest = own.join(counts, "t").groupBy(F.col("k").alias("a")).agg(F.min(F.struct("df", "t"))["t"].alias("t"))
    met = rarest.join(each.select(F.col("k").alias("b"), "t"), "t").where((F.length("a") < F.length("b")) & F.contains("b", F.col("a")))
    pattern = F.concat(F.lit(r"(?U)\b\Q"), F.replace("a", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    return met.where(F.call_function("rlike", F.col("b"), pattern)).select("a", "b").distinct()


def keep_first(df: DataFrame, key: str, order: str, fillers: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``df`` whose tag (``key``, compared in lower case) stays: neither a filler, nor too
    short or long, nor alike to one that stays and comes before it in ``order``; of equal ones the first."""
    low = F.lower(key)
    fit = df.where(F.length(low).between(SHORTEST, LONGEST) & ~low.isin(*fillers) if fillers else F.length(low).between(SHORTEST, LONGEST))
    rows = staged(fit.groupBy(low.alias("k")).agg(F.min(order).alias("at")))
    place = rows.select(F.col("k").alias("v"), F.col("at").alias("p"))
    pairs = alike_pairs(rows.select("k"))
    for side in "ab":
        pairs = pairs.join(place.select(F.col("v").alias(side), F.col("p").alias(f"p{side}")), side)
    first = F.col("pa") < F.col("pb")
    edges = staged(pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v")))
    gone = None
    while edges.limit(1).count():
        # of the tags that have a like one, those with none before them stay, and what they are like goes
        stays = edges.select("u").distinct().join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_anti")
        out = staged(edges.join(stays, "u", "left_semi").select("v").distinct())
        gone = out if gone is None else gone.union(out)
        left = edges.join(stays, "u", "left_anti").join(out, "v", "left_anti")
        edges = staged(left.join(out.withColumnRenamed("v", "u"), "u", "left_anti"))
    kept = rows if gone is None else rows.join(gone.select(F.col("v").alias("k")), "k", "left_anti")
    kept = kept.select(F.col("k").alias("_k"), F.col("at").alias("_at"))
    return df.join(kept, (low == F.col("_k")) & (F.col(order) == F.col("_at"))).drop("_k", "_at")
