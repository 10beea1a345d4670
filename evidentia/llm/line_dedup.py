"""Line dedup over levelled sorted runs of line hashes.

The state is a small log-structured store: every batch of documents adds one
run (a table of 128-bit line hashes, sorted within its files), and when a
level holds ``fan_in`` runs they are compacted into one run of the next level,
so that a batch meets O(log batches) runs.  A batch is processed by two merge
anti-joins: its distinct keys against the runs leave the keys it is first to
hold, and its occurrences against those leave what has to go.

All work is DataFrame operations; no Python runs on the executors.

Defined results
---------------
* null or empty text: one empty line, nothing dropped;
* keys shorter than ``min_chars`` code points are never dropped;
* rows that share an id count as one document; a null id counts as one
  document after all others;
* ties can't occur: within a batch the smallest id keeps a key, and of two
  batches the earlier one does;
* very long texts and lines are taken whole; an empty table gives an empty result;
* extra columns pass through, but for those named as a new one, which are replaced.

Keys are compared by two 64-bit hashes with independent seeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Workspace, fresh

#: What is stripped at both ends of a line: space and U+0009 to U+000D.
STRIP = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line, stripped, with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(STRIP)), UPPER, LOWER)


class LineRuns:
    """The levelled store of line hashes below ``workspace``."""

    def __init__(self, workspace: Workspace, fan_in: int = 4):
        self.work, self.fan_in = workspace, fan_in
        self.levels: list[list[str]] = [[]]
        self.made = 0

    def _write(self, keys: DataFrame) -> str:
        name = f"run{self.made}"
        self.made += 1
        keys.sortWithinPartitions("h1", "h2").write.parquet(self.work.path(name))
        return name

    def read(self) -> DataFrame | None:
        """All hashes held; a hash is in one run only."""
        names = [n for level in self.levels for n in level]
        if not names:
            return None
        return self.work.spark.read.schema("h1 long, h2 long").parquet(*map(self.work.path, names))

    def add(self, keys: DataFrame) -> None:
        """Add a run of new hashes, then compact the levels that are full."""
        self.levels[0].append(self._write(keys.select("h1", "h2")))
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            full = self.levels[level]
            read = self.work.spark.read.schema("h1 long, h2 long").parquet(*map(self.work.path, full))
            merged = self._write(read.repartition("h1"))
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            for name in full:
                self.work.drop(name)
            level += 1


def _dedup_batch(batch: DataFrame, runs: LineRuns, name: str, ident: str, text_col: str, min_chars: int) -> DataFrame:
    """Rows (id, text hash, positions to drop); adds the batch's new keys to the runs."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    key = F.col("key")
    seen = (
        batch.select(F.col(ident).alias("id"), F.xxhash64(text_col).alias("row"), F.posexplode(lines).alias("pos", "line"))
        .select("id", "row", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("id", "row", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))
    )
    first = seen.groupBy("h1", "h2").agg(F.min("id").alias("id"))
    held = runs.read()
    if held is not None:
        first = first.join(held.hint("merge"), ["h1", "h2"], "left_anti")
    first = runs.work.cut(first, f"first-{name}")
    runs.add(first)
    return seen.join(first.hint("merge"), ["h1", "h2", "id"], "left_anti").groupBy("id", "row").agg(F.collect_set("pos").alias("gone"))


def _bounds(df: DataFrame, ident: str, batches: int) -> list[int]:
    if batches < 2:
        return []
    at = [i / batches for i in range(1, batches)]
    found = df.agg(F.percentile_approx(ident, at, 1000).alias("q")).first()["q"]
    return sorted(set(found or []))


def dedup_lines(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    batches: int = 3,
    fan_in: int = 2,
    workspace: Workspace | None = None,
    n_lines: str = "n_lines",
    n_dropped: str = "n_dropped",
    kept: str = "kept_text",
) -> DataFrame:
    """``df`` with the columns ``n_lines``, ``n_dropped`` and ``kept``.

    The table is taken in ``batches`` ranges of ascending ids, so the first
    holder of a key is the smallest id in the whole table.
    """
    work = workspace or Workspace(df.sparkSession)
    ident, row = fresh(df, "id"), fresh(df, "row")
    docs = df.withColumn(ident, F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)))
    runs = LineRuns(work, fan_in)
    cuts = _bounds(docs, ident, batches)
    drops: list[DataFrame] = []
    for k in range(len(cuts) + 1):
        batch = docs.select(ident, text_col)
        if k:
            batch = batch.where(F.col(ident) > cuts[k - 1])
        if k < len(cuts):
            batch = batch.where(F.col(ident) <= cuts[k])
        drops.append(work.cut(_dedup_batch(batch, runs, str(k), ident, text_col, min_chars), f"drop-{k}"))
        work.drop(f"first-{k}")
    for name in [n for level in runs.levels for n in level]:
        work.drop(name)
    gone = drops[0]
    for x in drops[1:]:
        gone = gone.unionByName(x)
    g_id, g_row, g_pos = fresh(docs, "gid"), fresh(docs, "grow"), fresh(docs, "gpos")
    gone = gone.select(F.col("id").alias(g_id), F.col("row").alias(g_row), F.col("gone").alias(g_pos))
    out = docs.withColumn(row, F.xxhash64(text_col)).join(gone, (F.col(ident) == F.col(g_id)) & (F.col(row) == F.col(g_row)), "left")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    l_col = fresh(out, "lines")
    out = out.withColumn(l_col, lines)
    stay = F.array_except(F.sequence(F.lit(0), F.size(l_col) - 1), F.col(g_pos))
    rest = F.when(F.col(g_pos).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(F.col(l_col), i)), "\n")
    )
    out = out.withColumns(
        {
            n_lines: F.size(l_col).cast("long"),
            n_dropped: F.coalesce(F.size(g_pos), F.lit(0)).cast("long"),
            kept: rest,
        }
    )
    return out.drop(ident, row, g_id, g_row, g_pos, l_col)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
k AS (SELECT doc_id, pos, line,
  translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.doc_id, k.pos, k.line, f.first IS NOT NULL AND f.first <> k.doc_id AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
