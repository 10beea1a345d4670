"""Plumbing that the operators of this subpackage share.

Row-wise Python operators go through :func:`append_columns`: whole Arrow
batches in, the same batches with extra columns out.  No row is dropped or
re-keyed on the way, so null ids, repeated rows and unrelated extra columns
need no special treatment there.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..cluster import ship, spread

#: Most rows and bytes of an Arrow batch: some texts are very long, so batches are kept small.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names that folder.  Only a local session (such as in
    tests) gets a folder of this process where it is unset; a cluster has to set it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="evidentia-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/evidentia-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of Arrow batches to this module's; Spark has no other place for them."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = str(spark.conf.get(key)).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


class Workspace:
    """Intermediate tables in the shared folder; each can be dropped early."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, shared_dir(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def cut(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        """Write ``df`` and read it back: the new frame has no lineage."""
        df.write.mode("overwrite").parquet(self.path(name), compression=compression)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def tidy(self) -> None:
        """Let the driver see which shuffle files nobody needs any more.

        Spark removes them when the driver's JVM collects their handles, which
        may be long after the frames they belong to were cut.
        """
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def if_small(df: DataFrame, most: int) -> DataFrame:
    """``df``, to be broadcast if a count shows that it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have (names compare case-insensitively)."""
    taken, name = {c.lower() for c in df.columns}, f"__ev_{base}"
    while name.lower() in taken:
        name += "_"
    return name


def append_columns(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, list]]],
    fields: dict[str, str],
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``fields`` (name to DDL type) to each row of ``df``.

    ``make()`` runs once per task and returns the function from an Arrow batch
    to lists by field name.  A column of ``df`` named as a new one is replaced.
    ``keep`` limits which columns of ``df`` come out; default all.
    """
    new = T._parse_datatype_string(", ".join(f"`{k}` {v}" for k, v in fields.items()))
    lower = {k.lower() for k in fields}
    kept = [c for c in df.columns if c.lower() not in lower and (keep is None or c in keep)]
    schema = T.StructType([df.schema[c] for c in kept] + list(new.fields))
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {f.name: to_arrow_type(f.dataType) for f in new.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            out = work(batch)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            arrays += [x if isinstance(x := out[k], pa.Array) else pa.array(x, kind) for k, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, *kinds])
            del batch, out, arrays
        pa.default_memory_pool().release_unused()  # workers live on

    ship(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The batch's texts; null reads as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The batch's texts as UTF-8; null reads as empty."""
    at = batch.column(batch.schema.get_field_index(column))
    kind = pa.large_binary() if pa.types.is_large_string(at.type) else pa.binary()
    return [x or b"" for x in at.cast(kind).to_pylist()]


# -- words as hashes ---------------------------------------------------------

_A = np.uint64(0x9E3779B97F4A7C15)
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed one by one.
_LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letters_of(split: bytes) -> np.ndarray:
    """For each byte whether it belongs to a word, where the bytes of ``split`` stand between words."""
    return ~np.isin(np.arange(256), np.frombuffer(split, np.uint8))


def hashed_words(texts: list[bytes], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of the texts and where each text's begin; those of
    text k are hashes[at[k]:at[k + 1]].  A space must be no letter.

    Eight bytes of every word are mixed at once, so no word becomes a Python object.
    """
    data = b" ".join([*texts, b"        "])
    inside = letters[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.append(0, edges)
    starts, size = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))  # the eight bytes from each place on
    h = mix((eights[starts] & _HEAD[np.minimum(size, 8)]) + size.astype(np.uint64) * _A)
    rest, k = np.flatnonzero(size > 8), 8
    while len(rest) and k < _LONG:
        h[rest] = mix(h[rest] * _A + (eights[starts[rest] + k] & _HEAD[np.minimum(size[rest] - k, 8)]))
        k += 8
        rest = rest[size[rest] > k]
    for j in rest.tolist():
        h[j] = xxhash.xxh3_64_intdigest(data[starts[j] : starts[j] + size[j]])
    ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return h, np.searchsorted(starts, ends)


def in_pieces(texts: list[bytes], most: int = 1 << 19) -> Iterator[list[bytes]]:
    """The texts in lists of at most ``most`` bytes; a longer text is a list by itself."""
    piece, size = [], 0
    for t in texts:
        if piece and size + len(t) > most:
            yield piece
            piece, size = [], 0
        piece.append(t)
        size += len(t) + 1
    if piece:
        yield piece


def crc_fold(column: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds
