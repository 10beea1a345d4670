"""Top-K over a stream of records.

Each micro-batch adds the scores of its records to a log, one folder an epoch; the
K best are those of each id's latest record.  A batch costs what it holds, a worse
update takes a record down again, and a replayed batch gives the same folder.

Every so many epochs the log is compacted: the last base and the epochs since then
become a new base, each id's latest row.  A result reads a base and at most that
many epochs.  The base before it and the epochs that it needs stay for those who
still read them; older ones go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import explain
from ..plans.ranking import scan_scores
from ..sources.candidates import last_wins, parse_lines
from ..sources.profile import profiles

LOG = "candidate_id STRING, legacy_score DOUBLE, reasoning STRING, epoch LONG"


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Records of a folder of JSON lines, and where each stands (``_at``): of one id in a
    batch the last in order of files, then in a file, counts."""
    at = F.struct("_metadata.file_modification_time", "_metadata.file_name", "_metadata.file_block_start")
    return parse_lines(spark.readStream.text(path).select("value", at.alias("_at")))


def latest(log: DataFrame) -> DataFrame:
    """Of each id the row of its last epoch."""
    row = F.struct("epoch", "legacy_score", "reasoning")
    return log.groupBy("candidate_id").agg(F.max(row).alias("r")).select("candidate_id", "r.legacy_score", "r.reasoning")


class StreamingTopK:
    """The log of scores below ``path``, and the K best of it; compacted every ``compact`` epochs
    into a base of ``files`` files."""

    def __init__(self, path: str, k: int, as_of: str, compact: int = 16, files: int = 16):
        self.path, self.k, self.as_of, self.compact, self.files = path.rstrip("/"), k, as_of, compact, files

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        place = [c for c in ("_at",) if c in batch.columns]
        rows = last_wins(batch.withColumn("_at", F.struct(*place, F.monotonically_increasing_id().alias("_row"))), "_at")
        scored = scan_scores(profiles(rows), self.as_of).withColumn("reasoning", explain.short_reasoning())
        self.add(scored.select("candidate_id", "legacy_score", "reasoning"), epoch)

    def add(self, scores: DataFrame, epoch: int) -> None:
        """The scores of an epoch, of each id one; a replay writes the same again."""
        scores.write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")
        if (epoch + 1) % self.compact == 0:
            spark = scores.sparkSession
            new = self._log(spark, epoch).groupBy("candidate_id").agg(F.max(F.struct("epoch", "legacy_score", "reasoning")).alias("r")).select("candidate_id", "r.*")
            new.repartition(self.files, "candidate_id").write.mode("overwrite").parquet(f"{self.path}/base={epoch}")
            kept = max((e for e in self._done(spark, "base") if e < epoch), default=-1)
            for kind, gone in (("base", [e for e in self._done(spark, "base") if e < kept]), ("epoch", [e for e in self._done(spark, "epoch") if e <= kept])):
                for e in gone:
                    self._folder(spark, f"{kind}={e}", delete=True)

    def _folder(self, spark: SparkSession, name: str, delete: bool = False) -> list[str]:
        """The names in a folder below the path; or drops it."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if delete:
            fs.delete(path, True)
        return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []

    def _done(self, spark: SparkSession, kind: str) -> list[int]:
        """The epochs of which there is a whole folder of this kind."""
        named = [x for x in self._folder(spark, "") if x.startswith(f"{kind}=")]
        return sorted(int(x.partition("=")[2]) for x in named if "_SUCCESS" in self._folder(spark, x))

    def _log(self, spark: SparkSession, epoch: int | None) -> DataFrame:
        """The last base up to an epoch and the epochs after it, up to that one."""
        bases = self._done(spark, "base")
        base = max((e for e in bases if epoch is None or e <= epoch), default=-1)
        after = [e for e in self._done(spark, "epoch") if e > base and (epoch is None or e <= epoch)]
        if base < 0 and bases and len(after) <= epoch:
            raise ValueError(f"epoch {epoch} has been compacted into a later base")
        frames = [spark.read.schema(LOG).parquet(f"{self.path}/base={base}")] if base >= 0 else []
        if after:
            log = spark.read.schema(LOG).option("basePath", self.path)
            frames.append(log.parquet(*[f"{self.path}/epoch={e}" for e in after]))
        if not frames:
            return spark.createDataFrame([], LOG)
        return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def result(self, spark: SparkSession, epoch: int | None = None) -> DataFrame:
        """The K best after an epoch, by default the last."""
        return latest(self._log(spark, epoch)).orderBy(F.desc("legacy_score"), F.asc("candidate_id")).limit(self.k)
