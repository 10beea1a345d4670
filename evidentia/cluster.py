"""What a cluster's executors need from the driver."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_evidentia_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="evidentia-")) / "evidentia.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._evidentia_shipped = True


#: Bytes below which a file is likely to be a single row group, and so a single task.
ONE_TASK = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to all cores if what it reads is so small that one task would get it all.

    Larger tables are read as they lie, without a shuffle.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= ONE_TASK:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all machines see; a local session without one gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="evidentia-")
    return f"{base.rstrip('/')}/evidentia-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder and read back: what is used more than once is made once."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, path: str, buckets: int, key: str, *then: str) -> None:
    """Write ``df`` to ``path``, bucketed by ``key`` and sorted by it and ``then``: one file a bucket."""
    name = f"evidentia_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, key)
    rows.write.bucketBy(buckets, key).sortBy(key, *then).format("parquet").mode("overwrite").option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the files stay


def read_bucketed(spark: SparkSession, path: str, schema: str, buckets: int, key: str, *then: str) -> DataFrame:
    """What :func:`bucketed` wrote, by a table of this session that knows the buckets."""
    name = f"evidentia_{uuid.uuid4().hex}"
    order = ", ".join((key, *then))
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
