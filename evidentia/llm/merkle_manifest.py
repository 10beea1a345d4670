"""A Merkle manifest of a table by superblock reduction.

Each group's leaves stand in order; runs of ``fanout`` nodes become one until one
is left, the group's subroot, and the subroots likewise give the root.  A leaf's
proof is the list of its siblings up to the root.

No task sees a whole tree.  Leaves are numbered by a range sort and the sizes of
its partitions; index // fanout^k is a leaf's bucket, and ``applyInPandas``
collapses the k lower levels of a bucket at once.  The buckets' roots are numbered
as the buckets are, so the same step reduces them, recursively, until each group
has one.  A leaf's proof is that of its bucket and, behind it, its bucket root's.
A large group is thus many buckets of at most fanout^k leaves, however large it is.

Defined results
---------------
* a null field reads as ``-``; a null group is a group of its own, the first;
  null ids come first in their group;
* rows that share a group and an id are ordered by leaf; equal rows are
  leaves of their own, side by side;
* a row whose id is null is never tampered with; empty and very long texts are
  hashed whole;
* an empty table gives an empty result;
* other columns of the table, whatever their names, neither count nor come out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Workspace, append_columns, if_small, ship, table

FANOUT, LEVELS = 3, 7
#: Most rows of a side that is broadcast; one holds a path of up to a few kB.
SMALL = 10_000

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A field as its UTF-8 size, a colon and itself; null as a dash."""
    s = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_of(values: list[Column]) -> Column:
    """The digest of a row's fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def collapse(nodes: list[str], fanout: int, levels: int | None) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    """What ``nodes`` become after ``levels`` levels (None: until one is left), and
    for each of them its place among its run and its siblings, level by level."""
    paths: list[list[tuple[int, list[str]]]] = [[] for _ in nodes]
    span, level = 1, 0
    while len(nodes) > 1 if levels is None else level < levels:
        above = []
        for k in range(0, len(nodes), fanout):
            run = nodes[k : k + fanout]
            above.append(digest("".join(run)))
            for i in range(len(run)):
                step = (i, run[:i] + run[i + 1 :])
                for leaf in range((k + i) * span, min((k + i + 1) * span, len(paths))):
                    paths[leaf].append(step)
        nodes, span, level = above, span * fanout, level + 1
    return nodes[0], paths


def fold(node: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a node and its path give."""
    for at, siblings in path:
        node = digest("".join([*siblings[:at], node, *siblings[at:]]))
    return node


def numbered(df: DataFrame, group: str, order: list[str], work: Workspace, name: str) -> DataFrame:
    """``df`` with each row's index in its group's order and the group's size (``idx``, ``total``).

    Rows are range-sorted by group and order, then by where they were read, so a large
    group spans many partitions; what a partition adds is its count of each group.
    """
    keys = [F.asc_nulls_first(group), *map(F.asc_nulls_first, order), F.col("_read")]
    rows = df.withColumn("_read", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_read")
    rows = work.cut(rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), name)
    sizes = rows.groupBy("_part", group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    all_of = Window.partitionBy(group)
    before = all_of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("_part").alias("_p"), F.col(group).alias("_g"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(all_of).alias("total"),
    )
    starts = if_small(work.cut(starts, f"{name}-starts"), SMALL)
    placed = rows.join(starts, (rows["_part"] == starts["_p"]) & rows[group].eqNullSafe(starts["_g"]))
    return placed.withColumn("idx", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_p", "_g", "_first", "_before")


def _collapsed(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``nodes`` (grp, idx, total, node, and others) with bucket, root, pos and sibs of the bucket."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields), "bucket long, root binary, pos array<int>, sibs array<binary>"])
    width = fanout**levels

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        # a group that has other buckets too goes through all levels, so its last run may be one node
        root, ways = collapse([bytes(x).hex() for x in pdf["node"]], fanout, levels if pdf["total"][0] > width else None)
        pdf["root"] = [bytes.fromhex(root)] * len(pdf)
        pdf["pos"] = [[at for at, _ in way] for way in ways]
        pdf["sibs"] = [[bytes.fromhex("".join(s)) for _, s in way] for way in ways]
        return pdf

    ship(nodes.sparkSession)
    return nodes.withColumn("bucket", F.expr(f"idx div {width}")).groupBy("grp", "bucket").applyInPandas(reduce, schema)


def climb(nodes: DataFrame, above: Callable[[DataFrame], DataFrame], work: Workspace, name: str, fanout: int, levels: int) -> DataFrame:
    """``nodes`` (grp, idx, total, node, and others) with subroot, root and the way there (pos, sibs).

    ``above`` gives these of the groups' own roots, which come as nodes with idx 0.
    """
    width = fanout**levels
    low = work.cut(_collapsed(nodes, fanout, levels), name)
    tops = low.groupBy("grp", "bucket").agg(F.first("total").alias("total"), F.first("root").alias("node"))
    tops = tops.select("grp", F.col("bucket").alias("idx"), F.expr(f"(total + {width - 1}) div {width}").alias("total"), "node")
    many = (low.agg(F.max("total")).first()[0] or 0) > width
    up = climb(tops, above, work, f"{name}-up", fanout, levels) if many else above(tops)
    up = up.select(F.col("grp").alias("_g"), F.col("idx").alias("_b"), "subroot", F.col("root").alias("_root"), F.col("pos").alias("_pos"), F.col("sibs").alias("_sibs"))
    up = if_small(work.cut(up, f"{name}-all"), SMALL)
    both = low.join(up, low["grp"].eqNullSafe(up["_g"]) & (low["bucket"] == up["_b"]))
    return both.withColumns({"root": F.col("_root"), "pos": F.concat("pos", "_pos"), "sibs": F.concat("sibs", "_sibs")}).drop("bucket", "_g", "_b", "_root", "_pos", "_sibs")


def manifest(
    df: DataFrame,
    id_col: str,
    group_col: str,
    leaf: Column,
    seen: Column | None = None,
    fanout: int = FANOUT,
    levels: int = LEVELS,
    workspace: Workspace | None = None,
) -> DataFrame:
    """A row for each row of ``df``: its id and group, leaf, seen, subroot and root (hex), the siblings
    (``sibs``: hex, the siblings of each level joined) with the leaf's place among them (``pos``),
    ``proof_sha256``, ``folded_root`` and ``verified``.

    ``leaf`` is a column of 32 bytes; ``seen`` is that of the row as it is found
    later (default: the same), which is folded with the siblings of the first.
    """
    if id_col == group_col:
        raise ValueError("id and group are two columns")
    work = workspace or Workspace(df.sparkSession)
    leaves = df.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), leaf.alias("node"), (leaf if seen is None else seen).alias("seen"))
    nodes = numbered(work.cut(leaves, "leaves"), "grp", ["id", "node"], work, "order")

    def topmost(tops: DataFrame) -> DataFrame:
        return tops.select("grp", "idx", F.col("node").alias("subroot"), F.col("node").alias("root"), F.array().cast("array<int>").alias("pos"), F.array().cast("array<binary>").alias("sibs"))

    def over_groups(tops: DataFrame) -> DataFrame:
        roots = numbered(tops.select(F.lit(0).alias("grp"), F.col("grp").alias("of"), "node"), "grp", ["of"], work, "groups")
        done = climb(roots, topmost, work, "top", fanout, levels)
        return done.select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("idx"), F.col("node").alias("subroot"), "root", "pos", "sibs")

    tree = climb(nodes, over_groups, work, "tree", fanout, levels)

    def check():
        def run(batch: pa.RecordBatch) -> dict[str, list]:
            of = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("seen", "pos", "sibs")}
            proofs, roots = [], []
            for one, at, siblings in zip(of["seen"], of["pos"], of["sibs"]):
                hexes = [x.hex() for x in siblings]
                proofs.append(digest("".join(hexes)))
                roots.append(fold(one.hex(), [(p, [h[k : k + 64] for k in range(0, len(h), 64)]) for p, h in zip(at, hexes)]))
            return {"proof_sha256": proofs, "folded_root": roots}

        return run

    done = append_columns(tree, check, {"proof_sha256": "string", "folded_root": "string"})
    text = {c: F.lower(F.hex(c)) for c in ("seen", "subroot", "root")}
    sibs = F.transform("sibs", lambda x: F.lower(F.hex(x)))
    return done.select(
        F.col("id").alias(id_col), F.col("grp").alias(group_col), F.lower(F.hex("node")).alias("leaf"), *[x.alias(c) for c, x in text.items()],
        "pos", sibs.alias("sibs"), "proof_sha256", "folded_root", (F.col("folded_root") == text["root"]).alias("verified"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    fields = [F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0  # null for a null id
    changed = leaf_of([*fields[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit(""))])
    found = manifest(docs, "doc_id", "source", leaf_of(fields), F.when(hit, changed).otherwise(leaf_of(fields)))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _tree_sql(nodes: str, name: str, levels: int) -> list[str]:
    """CTEs of a tree over ``nodes`` (g, i, h): each level's, and those that are hashed, with their level."""
    steps = [f"{name}0 AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS c FROM {nodes})"]
    for k in range(levels):
        steps.append(f"{name}{k + 1} AS (SELECT g, i // 3 AS i, CASE WHEN max(c) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h, (max(c) + 2) // 3 AS c FROM {name}{k} GROUP BY g, i // 3)")
    every = " UNION ALL ".join(f"SELECT {k} AS lev, {3**k} AS s, g, i, h FROM {name}{k} WHERE c > 1" for k in range(levels))
    return [*steps, f"{name} AS ({every})"]


def op13_sql(levels: int = 11) -> str:
    """DuckDB SQL for tables of up to 3 ** levels rows a source."""

    def leaf(text: str) -> str:
        values = [(c, c if c != "text" else text) for c in FIELDS]
        return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({v}::VARCHAR) || ':' || {v}::VARCHAR END" for c, v in values) + ")"

    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce({bits}, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295::BIGINT), 4294967295::BIGINT)"
    steps = [
        f"""l AS (SELECT row_number() OVER () AS r, doc_id, source AS g, h, seen, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i
  FROM (SELECT doc_id, source, {leaf("text")} AS h, CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS seen FROM documents))""",
        *_tree_sql("l", "a", levels),
        f"sub AS (SELECT g, h, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS k FROM a{levels})",
        *_tree_sql("(SELECT 0 AS g, k AS i, h FROM sub)", "b", levels),
        "w AS (SELECT l.r, l.g, l.i, l.seen, sub.k, sub.h AS subroot FROM l JOIN sub ON l.g IS NOT DISTINCT FROM sub.g)",
        """p AS (SELECT w.r, 0 AS tree, n.lev, n.i, n.h, n.i < w.i // n.s AS before FROM w JOIN a n ON n.g IS NOT DISTINCT FROM w.g AND n.i // 3 = w.i // (3 * n.s) AND n.i <> w.i // n.s
  UNION ALL SELECT w.r, 1, n.lev, n.i, n.h, n.i < w.k // n.s FROM w JOIN b n ON n.i // 3 = w.k // (3 * n.s) AND n.i <> w.k // n.s)""",
        "s AS (SELECT r, string_agg(h, '' ORDER BY tree, lev, i) AS sibs FROM p GROUP BY r)",
        "e AS (SELECT r, tree, lev, string_agg(h, '' ORDER BY i) FILTER (WHERE before) AS bef, string_agg(h, '' ORDER BY i) FILTER (WHERE NOT before) AS aft FROM p GROUP BY r, tree, lev)",
        "m AS (SELECT DISTINCT 0 AS tree, lev, g FROM a)",
        "f0 AS (SELECT r, g, seen AS h FROM w)",
    ]
    for k in range(2 * levels):
        tree, lev = divmod(k, levels)
        many = f"(SELECT count(*) FROM b{lev}) > 1" if tree else "m.lev IS NOT NULL"
        steps.append(
            f"f{k + 1} AS (SELECT f.r, f.g, CASE WHEN {many} THEN sha256(coalesce(bef, '') || f.h || coalesce(aft, '')) ELSE f.h END AS h "
            f"FROM f{k} f LEFT JOIN e ON e.r = f.r AND e.tree = {tree} AND e.lev = {lev} LEFT JOIN m ON m.g IS NOT DISTINCT FROM f.g AND m.lev = {lev})"
        )
    root = f"(SELECT max(h) FROM b{levels})"
    return "WITH " + ",\n".join(steps) + f"""
SELECT l.doc_id, l.h AS leaf, w.subroot, {root} AS root, sha256(coalesce(s.sibs, '')) AS proof_sha256, f.h AS folded_root, f.h = {root} AS verified
FROM l JOIN w ON l.r = w.r JOIN f{2 * levels} f ON f.r = l.r LEFT JOIN s ON s.r = l.r"""


OP13_SQL = op13_sql()
