"""A store of records for lookups of a few by their ids.

Files are in order of ids, with row groups of bounded size, page indices and a Bloom
filter of the ids, so that a lookup by literals reads only row groups, and in them
pages, that can hold one of them.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes of a row group before compression, and of a page.
GROUP, PAGE = 8 << 20, 64 << 10
#: Ids up to which a lookup is by literals; more are joined.
LITERALS = 2000
#: Longer lists of literals reach the scan as a range only.
LIST = 10


def write_store(df: DataFrame, path: str, key: str = "candidate_id", files: int | None = None, group: int = GROUP, page: int = PAGE) -> None:
    rows = df.repartitionByRange(*([files] if files else []), key).sortWithinPartitions(key)
    out = rows.write.mode("overwrite").option("parquet.block.size", group).option("parquet.page.size", page).option("parquet.page.row.count.limit", 1000)
    out.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)


def among(key: str, ids: Iterable) -> Column:
    """Whether ``key`` is one of ``ids``, in lists short enough for the scan to use each value."""
    values = sorted(set(ids))
    return reduce(lambda a, b: a | b, [F.col(key).isin(values[i : i + LIST]) for i in range(0, len(values), LIST)], F.lit(False))


def lookup(spark: SparkSession, path: str, ids: DataFrame | Iterable, key: str = "candidate_id") -> DataFrame:
    """The store's records with these ids (a list, or a frame that has the column ``key``)."""
    rows = spark.read.parquet(path)
    if not isinstance(ids, DataFrame):
        return rows.where(among(key, ids))
    asked = ids.select(key).where(F.col(key).isNotNull()).distinct()
    few = asked.limit(LITERALS + 1).collect()
    return rows.where(among(key, (r[0] for r in few))) if len(few) <= LITERALS else rows.join(asked, key, "left_semi")
