"""Inner-product search over vectors in cells, exact by bounds.

Vectors are dealt to the nearest of some centres.  A cell's row holds its centre c and
its radius, a vector's its distance r to c; by Cauchy and Schwarz x.q is at most
c.q + r |q|.  A search scores the cells that promise most first, takes the k-th best
product as a threshold, and then reads only cells, and in them vectors, whose bound reaches it.

Products are taken as one matrix product for each Arrow batch; what is within
``SLACK`` of the threshold is scored again by :func:`dense.inner`, so results don't
depend on how a batch is added up.  Rows without a vector, or with one of another
length than the query, are no part of an answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..cluster import ship

#: Most centres, which go to all tasks and, with their radii, through the driver.
CELLS = 1024
#: What products may lack to a threshold, as scores are rounded to six digits at most.
SLACK = 2e-6
SUMMARY = "cell int, centre array<double>, radius double, n long"


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A batch's vectors as rows of doubles; nulls inside count as 0."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.nan_to_num(flat).reshape(-1, width)


def whole(embedding: str, width: int) -> Column:
    return F.col(embedding).isNotNull() & (F.size(embedding) == width)


def near_best(vectors: DataFrame, asked: list[float], k: int, embedding: str, least: float = -np.inf) -> DataFrame:
    """The rows that can be among the k best by inner product, and some more: those that
    were within reach when their task came to them."""
    query = np.array(asked, np.float64)
    names = vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full(k, -np.inf)
        for batch in batches:
            score = matrix(batch.column(names.index(embedding)), len(query)) @ query
            best = np.partition(np.concatenate([best, score]), -k)[-k:]
            yield batch.filter(pa.array(score >= max(best[0], least) - SLACK))

    ship(vectors.sparkSession)
    return vectors.where(whole(embedding, len(query))).mapInArrow(run, vectors.schema)


@dataclass
class VectorIndex:
    rows: DataFrame  # what was indexed, with cell and r
    cells: DataFrame  # cell, centre, radius, n
    embedding: str = "embedding"

    @classmethod
    def build(cls, vectors: DataFrame, key: str, embedding: str = "embedding", cells: int | None = None) -> VectorIndex:
        """Centres are vectors of the table, chosen by their keys' hashes: the square root of their number, or ``cells``."""
        some = vectors.where(F.col(embedding).isNotNull() & (F.size(embedding) > 0))
        width = some.select(F.size(embedding).alias("w")).limit(1).collect()
        width = width[0].w if width else 1
        many = cells or int(some.count() ** 0.5)
        picked = some.where(whole(embedding, width)).select(F.xxhash64(key, F.lit(7)).alias("h"), F.col(embedding).alias("c")).orderBy("h").limit(max(1, min(CELLS, many))).collect()
        centres = np.nan_to_num(np.array([r.c for r in picked] or [[0.0] * width], np.float64))
        names = vectors.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            norms = (centres**2).sum(1)
            for batch in batches:
                x = matrix(batch.column(names.index(embedding)), width)
                cell = (norms - 2 * x @ centres.T).argmin(1)
                r = np.sqrt(((x - centres[cell]) ** 2).sum(1)) * (1 + 1e-12) + 1e-12
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(r)], [*names, "cell", "r"])

        ship(vectors.sparkSession)
        schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("r", T.DoubleType())])
        rows = some.where(whole(embedding, width)).mapInArrow(run, schema)
        tops = rows.groupBy("cell").agg(F.max("r").alias("radius"), F.count("*").alias("n"))
        table = vectors.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)], "cell int, centre array<double>")
        return cls(rows, table.join(F.broadcast(tops), "cell").select("cell", "centre", "radius", "n"), embedding)

    def save(self, path: str) -> None:
        """As parquet, in order of cells and radii, so that a search skips row groups and pages."""
        self.rows.repartitionByRange("cell", "r").sortWithinPartitions("cell", "r").write.mode("overwrite").parquet(f"{path}/rows")
        rows = self.rows.sparkSession.read.parquet(f"{path}/rows")
        tops = rows.groupBy("cell").agg(F.max("r").alias("radius"), F.count("*").alias("n"))
        self.cells.select("cell", "centre").join(F.broadcast(tops), "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")

    @classmethod
    def load(cls, spark: SparkSession, path: str, embedding: str = "embedding") -> VectorIndex:
        return cls(spark.read.parquet(f"{path}/rows"), spark.read.schema(SUMMARY).parquet(f"{path}/cells"), embedding)

    def search(self, asked: list[float], k: int, key: str, digits: int | None = None, score: str = "score") -> tuple[DataFrame, DataFrame]:
        """The k best rows by inner product (rounded to ``digits`` if given), ties by key; and
        one row with how many vectors were compared, and of how many."""
        from .dense import best_by_product

        query = np.array(asked, np.float64)
        length = float(np.linalg.norm(query))
        known = [r for r in self.cells.collect() if len(r.centre) == len(query)]  # at most CELLS
        centre = {r.cell: float(np.array(r.centre) @ query) for r in known}
        bound = {r.cell: centre[r.cell] + r.radius * length + SLACK for r in known}
        first, held = [], 0
        for r in sorted(known, key=lambda r: -centre[r.cell]):
            first.append(r.cell)
            held += r.n
            if held >= 2 * k:
                break
        least = -np.inf
        head = self._of({c: -1.0 for c in first})
        if held >= k:
            best = best_by_product(head, asked, k, key, self.embedding).agg(F.min("score").alias("low"), F.count("*").alias("n")).first()
            least = best.low - 2 * SLACK if best.n == k else least
        # in a cell, only vectors that are far enough from the centre can reach the threshold
        need = {c: (least - centre[c]) / length - 1e-9 if length and least > -np.inf else -1.0 for c, b in bound.items() if b >= least}
        live = self._of(need)
        found = best_by_product(live, asked, k, key, self.embedding, digits, score, least)
        compared = live.agg(F.count("*").alias("compared")).withColumn("of", F.lit(sum(r.n for r in known)).cast("long"))
        return found.drop("cell", "r"), compared

    def _of(self, need: dict[int, float]) -> DataFrame:
        """The rows of these cells that are at least so far from their centres."""
        if not need:
            return self.rows.where("false")
        names = sorted(need)
        tests = [F.col("cell").isin(names[i : i + 10]) for i in range(0, len(names), 10)]  # lists this short reach the scan
        far = F.element_at(F.create_map(*[F.lit(x) for c in names for x in (c, float(need[c]))]), F.col("cell"))
        return self.rows.where(reduce(lambda a, b: a | b, tests)).where(F.col("r") >= far)
