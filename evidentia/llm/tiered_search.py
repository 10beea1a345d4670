"""Ranked lexical search over a tiered index.

The index has a row for each shard of documents, at most ``shard_docs`` of them:
their ids, a column of postings for each tier, and for each of its terms the
highest impact that the tiers below a tier hold, the residual bound.  The first
tier has the postings of the highest impact; tiers end at fixed shares of the
highest impact that a collection of this size can give a single occurrence.

A search reads the first tier of all shards, a column by itself, and takes each
item's k-th best partial score as its threshold.  Then each shard takes each item
from the first tier down.  After a tier, no document of the shard can get more
than its partial score and the residual bounds of the item's terms that it hasn't
shown yet.  If no such sum reaches the threshold, that is the proof that the
shard adds nothing to the item; an item without it falls through to the next tier,
and after the last one scores are exact.  What is found raises the threshold for
the shards that a task still has to search.

Postings never move: items go to the shards, in blocks of at most ``block_terms``
terms and ``block_items`` items, and of a shard at most k rows an item come back.
Texts are read once a block; frequencies are counted on the shards' postings.

Defined results
---------------
* null and empty texts have no term: they don't count as documents, and such items
  have no rows; items with equal texts or ids each have their own rows;
* equal scores are ordered by id, null ids last; rows that repeat an id are
  documents of their own, and each can be listed;
* a term that is in all documents, or nearly, has the weight 0 and adds nothing;
* very long texts are read whole; an empty table gives an empty result;
* other columns of the tables, whatever their names, play no part.

Terms are compared by 64-bit hashes.  All sums are exact: they are whole numbers
below 2^53.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import Workspace, append_columns, bound_batches, hashed_words, in_pieces, letters_of, raw_texts, ship, table

K = 10
#: A tier ends at this share of the highest impact of a term that occurs once; the last tier has the rest.
SHARES = (0.5, 0.25, 0.1)
SHARD_DOCS, SHARD_POSTINGS = 8192, 1 << 20

LETTERS = letters_of(bytes(b for b in range(128) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)))
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, size: np.ndarray, n: int, total: int) -> np.ndarray:
    """What each posting adds to a score: term weights, frequencies and sizes of the documents, all 64-bit."""
    m = 10 + (90 * size * n) // total
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all terms of the texts, and where each text's begin."""
    return hashed_words([t.translate(LOWER) for t in texts], LETTERS)


@dataclass
class Items:
    """A block of items: hashes of all its terms in order, and each item's as places in them."""

    ids: list
    terms: list[np.ndarray]
    vocabulary: np.ndarray


def blocks(items: DataFrame, item_col: str, text_col: str, block_terms: int, block_items: int) -> Iterator[Items]:
    """The items in blocks of bounded size, streamed through the driver."""

    def made(ids: list, found: list[np.ndarray]) -> Items:
        vocabulary = np.unique(np.concatenate(found))
        return Items(ids, [np.searchsorted(vocabulary, f) for f in found], vocabulary)

    ids, found, size = [], [], 0
    for row in items.select(F.col(item_col).alias("i"), F.col(text_col).cast("binary").alias("t")).where("t IS NOT NULL").toLocalIterator():
        own = np.unique(terms_of([bytes(row.t)])[0])
        if not len(own):
            continue
        if ids and (size + len(own) > block_terms or len(ids) >= block_items):
            yield made(ids, found)
            ids, found, size = [], [], 0
        ids.append(row.i)
        found.append(own)
        size += len(own)
    if ids:
        yield made(ids, found)


# -- the index -----------------------------------------------------------------


def _packed(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *(a.astype(np.int64).tobytes() for a in arrays)])


def _unpacked(data: bytes, n: int) -> list[np.ndarray]:
    sizes = np.frombuffer(data, np.int64, n)
    ends = np.cumsum(sizes)
    return [np.frombuffer(data, np.int64, int(s), 8 * (n + int(e - s))) for s, e in zip(sizes, ends)]


def _shards(docs: DataFrame, id_col: str, text_col: str, vocabulary, shard_docs: int) -> DataFrame:
    """The documents' postings of the vocabulary: (ids, size, term, doc, tf), a row for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        ids, sizes, keys, counts, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            key, count = np.concatenate(keys), np.concatenate(counts)
            doc, term = np.divmod(key, len(known))
            order = np.argsort(term, kind="stable")
            binary = [pa.array([x], pa.large_binary()).cast(pa.binary()) for x in (_packed(np.concatenate(sizes)), _packed(term[order], doc[order], count[order]))]
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), *binary], ["ids", "size", "postings"])

        for batch in batches:
            own, at = batch.column(batch.schema.get_field_index(id_col)).to_pylist(), 0
            for piece in in_pieces(raw_texts(batch, text_col)):
                hashes, begins = terms_of(piece)
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                asked = known[place] == hashes
                doc = np.repeat(np.arange(len(piece)) + len(ids), np.diff(begins))
                key, count = np.unique(doc[asked] * len(known) + place[asked], return_counts=True)
                ids += own[at : at + len(piece)]
                at += len(piece)
                sizes.append(np.diff(begins))
                keys.append(key)
                counts.append(count)
                held += len(key)
                if len(ids) >= shard_docs or held >= SHARD_POSTINGS:
                    yield flush()
                    ids, sizes, keys, counts, held = [], [], [], [], 0
        if ids:
            yield flush()

    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, "ids array<long>, size binary, postings binary")


def _statistics(shards: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """The number of documents with a term, of their terms, and each asked term's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            for size, postings in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (s,), (term, _, _) = _unpacked(size, 1), _unpacked(postings, 3)
                n, total = n + int((s > 0).sum()), total + int(s.sum())
                df += np.bincount(term, minlength=terms)
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *there.tolist()], pa.int64()), pa.array([n, total, *df[there].tolist()], pa.int64())], ["term", "n"])

    rows = shards.select("size", "postings").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r.term: r.n for r in rows.collect()}  # at most one row for each term of a block
    df = np.zeros(terms, np.int64)
    for term, n in found.items():
        if term >= 0:
            df[term] = n
    return found.get(-2, 0), found.get(-1, 0), df


def _tiered(shards: DataFrame, n: int, total: int, weights) -> DataFrame:
    """The shards with a column for each tier, and the residual bounds."""
    tiers = len(SHARES) + 1

    def make():
        w = weights.value
        most = weight(n, 1) * (1_000_000_000 // 1080) if n else 0
        cuts = [int(most * s) for s in SHARES]

        def work(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {k: [] for k in ("bounds", *(f"tier{t}" for t in range(tiers)))}
            of = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("size", "postings")}
            for size, postings in zip(of["size"], of["postings"]):
                (s,), (term, doc, tf) = _unpacked(size, 1), _unpacked(postings, 3)
                value = impacts(w[term], tf, s[doc], n, total) if len(term) else term
                some = value > 0
                term, doc, value = term[some], doc[some], value[some]
                tier = np.sum([value < c for c in cuts], axis=0) if len(term) else term
                there = np.unique(term)
                bounds = np.zeros((tiers, len(there)), np.int64)
                for t in range(tiers):
                    mine = tier == t
                    names, begin = np.unique(term[mine], return_index=True)  # postings are in order of terms
                    out[f"tier{t}"].append(_packed(names, np.append(begin, mine.sum()), doc[mine], value[mine]))
                    lower = tier > t
                    np.maximum.at(bounds[t], np.searchsorted(there, term[lower]), value[lower])
                out["bounds"].append(_packed(there, bounds.ravel()))
            return out

        return work

    fields = {"bounds": "binary"} | {f"tier{t}": "binary" for t in range(tiers)}
    return append_columns(shards, make, fields, keep=["ids"])


# -- the search ----------------------------------------------------------------


class Tier:
    """One tier of a shard."""

    def __init__(self, data: bytes):
        self.terms, self.begin, self.doc, self.value = _unpacked(data, 4)

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The postings of the terms: places in ``terms``, documents, impacts."""
        if not len(self.terms):
            return self.terms, self.terms, self.terms
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        asked = np.flatnonzero(self.terms[at] == terms)
        begin, size = self.begin[at[asked]], self.begin[at[asked] + 1] - self.begin[at[asked]]
        every = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
        return np.repeat(asked, size), self.doc[every], self.value[every]


def search_shard(terms: np.ndarray, n_docs: int, bounds: tuple[np.ndarray, np.ndarray], tier: Callable[[int], Tier], tiers: int, need: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The documents of a shard that score at least ``need`` (and above 0), their exact
    scores, and how many tiers were read until that was proven."""
    there, most = bounds
    at = np.minimum(np.searchsorted(there, terms), max(len(there) - 1, 0))
    own = terms[there[at] == terms] if len(there) else terms[:0]
    rest = most[:, np.searchsorted(there, own)]  # tier, term
    score, need = np.zeros(n_docs), max(need, 1)
    shown = []
    for t in range(tiers):
        place, doc, value = tier(t).of(own)
        score += np.bincount(doc, value, n_docs)
        shown.append((place, doc))
        left = rest[t]
        if not left.any():
            break
        if left.sum() < need:  # a document that showed no term yet is out; what the others can still get?
            can = score + left.sum()
            for p, d in shown:
                can -= np.bincount(d, left[p], n_docs)
            if not (can >= need).any():
                return np.zeros(0, np.int64), np.zeros(0, np.int64), t + 1
    found = np.flatnonzero(score >= need)
    return found, score[found].astype(np.int64), t + 1


def _best(ids: list, scores: list[int], k: int) -> list[tuple[int, int | None]]:
    """The k best (score, id): highest scores first, then lowest ids, null last."""
    return sorted(zip(scores, ids), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]


def _partial(index: DataFrame, items, k: int) -> DataFrame:
    """(item, score): of each task and item, the k best scores by the first tier alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = items.value, {}
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tier = Tier(data)
                for q, terms in enumerate(block.terms):
                    _, doc, value = tier.of(terms)
                    if len(doc):
                        scores = np.bincount(doc, value)
                        scores = scores[scores > 0]
                        best[q] = np.sort(np.concatenate([best[q], scores]) if q in best else scores)[-k:]
        rows = [(q, int(s)) for q, own in best.items() for s in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())], ["item", "score"])

    return index.select(F.size("ids").alias("n"), "tier0").mapInArrow(run, "item int, score long")


def _exact(index: DataFrame, items, needs, k: int) -> DataFrame:
    """(item, doc, score, depth): of each task and item, the k best documents that reach
    the threshold; and for each item a row without a score with the most tiers that were read for it."""
    tiers = len(SHARES) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, need = items.value, list(needs.value)
        best: dict[int, list] = {}
        depth = [0] * len(need)
        for batch in batches:
            of = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in batch.schema.names}
            for r, ids in enumerate(of["ids"]):
                there, most = _unpacked(of["bounds"][r], 2)
                bounds, opened = (there, most.reshape(tiers, len(there))), {}

                def tier(t: int, r=r, opened=opened, of=of) -> Tier:
                    if t not in opened:
                        opened[t] = Tier(of[f"tier{t}"][r])
                    return opened[t]

                for q, terms in enumerate(block.terms):
                    doc, score, read = search_shard(terms, len(ids), bounds, tier, tiers, need[q])
                    depth[q] = max(depth[q], read)
                    if len(doc):
                        own = best.get(q, [])
                        best[q] = _best([x[1] for x in own] + [ids[d] for d in doc], [x[0] for x in own] + score.tolist(), k)
                        if len(best[q]) == k:
                            need[q] = max(need[q], best[q][-1][0])
        rows = [(q, i, s, None) for q, own in best.items() for s, i in own] + [(q, None, None, d) for q, d in enumerate(depth)]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*rows), kinds)], ["item", "doc", "score", "depth"])

    return index.mapInArrow(run, "item int, doc long, score long, depth int")


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    k: int = K,
    shard_docs: int = SHARD_DOCS,
    block_terms: int = 1_000_000,
    block_items: int = 20_000,
    workspace: Workspace | None = None,
) -> DataFrame:
    """(item, rank, doc, score, depth): each item's k best documents; depth is the most
    tiers that any shard had to read for the item."""
    spark = docs.sparkSession
    work = workspace or Workspace(spark)
    kind = items.schema[item_col].dataType.simpleString()
    done = []
    for b, block in enumerate(blocks(items, item_col, item_text_col, block_terms, block_items)):
        vocabulary = spark.sparkContext.broadcast(block.vocabulary)
        shards = work.cut(_shards(docs, id_col, text_col, vocabulary, shard_docs), f"shards{b}")
        n, total, df = _statistics(shards, len(block.vocabulary))
        weights = spark.sparkContext.broadcast(np.array([weight(n, x) if x else 0 for x in df.tolist()], np.int64))
        index = work.cut(_tiered(shards, n, total, weights), f"index{b}")
        work.drop(f"shards{b}")
        asked = spark.sparkContext.broadcast(block)
        by_score = Window.partitionBy("item").orderBy(F.desc("score"))
        first = _partial(index, asked, k).withColumn("_k", F.row_number().over(by_score)).where(F.col("_k") <= k)
        held = {r.item: r.least for r in first.groupBy("item").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).collect()}  # a number for each item of a block
        needs = spark.sparkContext.broadcast([held.get(q, 0) for q in range(len(block.ids))])
        found = work.cut(_exact(index, asked, needs, k), f"found{b}")
        work.drop(f"index{b}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
        top = found.where("score IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("depth")
        depth = found.where("score IS NULL").groupBy("item").agg(F.max("depth").alias("depth"))
        names = F.broadcast(spark.createDataFrame(list(enumerate(block.ids)), f"item int, name {kind}"))
        done.append(top.join(depth, "item").join(names, "item").select(F.col("name").alias("item"), "rank", "doc", "score", "depth"))
    if not done:
        return spark.createDataFrame([], f"item {kind}, rank int, doc long, score long, depth int")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def op12_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
c AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
i AS (SELECT row_number() OVER () AS q, item_id, list_distinct({_TERMS}) AS w FROM benchmark),
t AS (SELECT q, item_id, unnest(w) AS term FROM i),
p AS (SELECT r, doc_id, size, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(w)::BIGINT AS size, unnest(w) AS term FROM d) SEMI JOIN t USING (term) GROUP BY ALL),
g AS (SELECT term, floor(1000 * ln((2 * (SELECT n FROM c) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p GROUP BY term),
s AS (SELECT q, item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * size * n) // l))))::BIGINT AS score FROM t JOIN p USING (term) JOIN g USING (term), c GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
