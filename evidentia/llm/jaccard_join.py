"""N-gram Jaccard join in metric space.

Documents are sets of word shingles under the Jaccard distance, a metric; two
link if their similarity is at least ``similar`` percent.  The join goes from
coarse pivots to fine ones, and each step is exact:

1. *Sites.*  The first pivots are the sets of one shingle.  A set of ``n``
   shingles is at distance ``1 - 1/n`` from each of its own sites and at 1 from
   all others, so it lies on the border of ``n`` Voronoi regions; ties go to the
   rarer site.  A set that links with it lacks at most ``n - ceil(s n)`` of its
   shingles.  So the set is replicated to its ``n - ceil(s n) + 1`` rarest sites:
   linked sets then share the rarest site that they have in common.
2. *Stars.*  In each region one set is the pivot, and the exact distance of the
   others to it is computed.  A group of near copies becomes one component
   here, by as many pairs as it has members.
3. *Small regions.*  In a region of up to ``LEAF`` sets that aren't one component each
   set is a pivot, and meets those that it may link with by their sizes, their
   distances to the star's pivot (the triangle inequality's window) and their sketches
   (parities of hash classes, which differ in at most as many bits as the sets in
   elements).  Sizes and sketches also spare stars the distances of sets that can't link.
4. *Projections.*  Sets in larger regions, such as those that share a passage, are
   joined anew by finer pivots.  In an interval of sizes up to ``m`` linked sets differ in
   at most ``H = 2m(1-s)/(1+s)`` elements.  Shingles are dealt into ``K = H + 1 + e``
   classes by hash; as the projection on a class is 1-Lipschitz, linked sets agree
   wholly on ``1 + e`` classes at least, so a set is replicated to the region of each of its
   projections (at the border of sizes, to those of both intervals).  ``e`` allows for the
   empty ones; a set with more of them also is in a region of such sets.  Then as before,
   where the regions of one pivot are taken as one.
5. *Voronoi cells.*  A region that still has more than ``CLOSE`` sets in several components is
   merged with such regions of nearly the same members, and joined recursively: ``SPREAD`` times as many sets as it has to be cut into parts become
   pivots (twice as many in each further round, up to ``PIVOTS``), each member goes home to the
   nearest (at distance ``d``) and is a guest in the cells of pivots before it in
   order that are nearer than ``d + 2r``.  By the triangle inequality one of two linked
   members then is at home where the other one is home or guest, so guests need
   not meet guests.

Pivots that are whole documents can't begin the join: unrelated texts are at a
distance of nearly 1 from all of them, so every window would hold nearly
everything (README has figures).  Sites are ordered by how rare their words are,
the sum of the logarithms of the words' counts in the whole corpus (hashed to
``1 << COUNTERS`` counters), and by hash among equals.  Any fixed order is exact;
this one keeps regions small, as unrelated texts share no phrase of rare words.

Equal sets are collapsed before all this, so groups of copies cost one set each.

Defined results
---------------
* null, empty or wordless texts have an empty set and link with nothing;
* with fewer words than a shingle the whole sequence is the only shingle;
* very long texts are one set as any other, never cut;
* rows that share an id are one vertex, which takes the links of each;
* rows with a null id keep their set's size and have a null component;
* an empty table gives an empty result; extra columns pass through, but for
  those named as a new one, which are replaced.

Shingles are compared by 64-bit hashes, whole sets by 128-bit ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Workspace, append_columns, bound_batches, fresh, hashed_words, if_small, in_pieces, letters_of, mix, raw_texts, ship, table

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1
_LOW = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_LETTERS = letters_of(b" \t\n\x0b\x0c\r")

#: Binary logarithm of the counters of words by which sites are ordered.
COUNTERS = 18
#: Sets of more shingles have a sketch of a bit for each shingle or two besides the one of 512 bits.
WIDE = 1024
#: Pivots of a large region at most, and those for each CLOSE members in the first round.  Regions of sites with up to LEAF members, and regions of
#: projections and cells with up to CLOSE, are compared without further pivots.
PIVOTS, SPREAD, LEAF, CLOSE = 64, 8, 64, 1024
#: Passes in which large regions with nearly the same members are made one.
MERGES = 3
#: Rows up to which a list of ids or keys (8 bytes each) is broadcast; beyond it is shuffled.
SMALL = 2_000_000
#: Bytes of pivots' sets up to which they are broadcast.
SENT = 16 << 20


def shingle_sets(texts: list[bytes], size: int, rare: np.ndarray | None = None) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with ``rare``, the logarithms of
    the words' counts, instead the shingles in the order of sites: their rarity in the
    first 12 bits and the first 52 of their hash."""
    out = []
    for piece in in_pieces(texts):
        w, at = hashed_words([t.translate(_LOW) for t in piece], _LETTERS)
        known = None if rare is None else rare[place(w)]
        whole = _sequences(w, known, size)
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            n = hi - lo
            if n >= size:
                s = whole[lo : hi - size + 1]
            else:
                s = _sequences(w[lo:hi], None if known is None else known[lo:hi], n) if n else whole[:0]
            s = np.sort(s)
            out.append(s[np.append(True, s[1:] != s[:-1])] if n > size else s)
    return out


def _sequences(w: np.ndarray, known: np.ndarray | None, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive word hashes, or where it stands in the order of sites."""
    many = max(0, len(w) - n + 1)
    h, sure = np.zeros(many, np.uint64), np.zeros(many)
    for k in range(n):
        h = h * _A + w[k : k + many]
        if known is not None:
            sure += known[k : k + many]
    h = mix(h + np.uint64(n * int(_B) & _MASK))
    if known is None:
        return h
    return (np.minimum(np.round(sure * (128 / n)), 4095).astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12))


def shingles(text: bytes, size: int) -> np.ndarray:
    return shingle_sets([text], size)[0]


def place(h: np.ndarray) -> np.ndarray:
    """Which counter a word falls on."""
    return (h >> np.uint64(64 - COUNTERS)).astype(np.int64)


def sites(ordered: np.ndarray, similar: int) -> np.ndarray:
    """The sites of a set in the order of sites: the first, as many as a linked set can lack and one more."""
    return ordered[: len(ordered) + similar * len(ordered) // -100 + 1]


def size_regions(similar: int, ratio: float = 1.25) -> np.ndarray:
    """Where the intervals of sizes begin; a linked set is at most one interval away."""
    ratio, edges = max(ratio, 104 / similar), [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(edges[-1] * ratio + 1)))
    return np.array(edges, np.int64)


def classes(low: int, top: int, similar: int) -> tuple[int, int]:
    """(K, e) of an interval of sizes: ``e`` is what the least set that can be replicated
    to it is expected to have of empty classes and four deviations, if so few suffice."""
    least, h = similar * low / 100, (2 * top * (100 - similar)) // (100 + similar)
    e = 1
    while e <= h + 8:
        empty = (h + 1 + e) * math.exp(-least / (h + 1 + e))
        if e >= empty + 4 * math.sqrt(empty):
            break
        e += 1
    return h + 1 + e, e


def projections(h: np.ndarray, similar: int, edges: np.ndarray, known: dict) -> np.ndarray:
    """The regions of a set: a 64-bit key for each non-empty projection."""
    home = int(np.searchsorted(edges, len(h), "right")) - 1
    keys = []
    for interval in (home, home + 1):
        low, top = int(edges[interval]), int(edges[interval + 1]) - 1
        if interval > home and 100 * len(h) < similar * low:
            continue
        if interval not in known:
            known[interval] = classes(low, top, similar)
        k, e = known[interval]
        of = ((mix(h ^ np.uint64(interval * 2 + 1)) >> np.uint64(11)) % np.uint64(k)).astype(np.int64)
        total = np.zeros(k, np.uint64)
        np.add.at(total, of, mix(h + _B))
        there = np.flatnonzero(np.bincount(of, minlength=k))
        salt = np.uint64(interval * int(_A) & _MASK)
        keys.append(mix(mix(total[there]) + salt + mix(there.astype(np.uint64) + _B)))
        if k - len(there) > e:
            keys.append(mix(np.array([int(salt) + 1 & _MASK], np.uint64)))
    return np.unique(np.concatenate(keys))


def _projected(df: DataFrame, size: int, similar: int) -> DataFrame:
    """``df`` (with text) with keys: its regions by projections."""

    def make():
        edges, known = size_regions(similar), {}
        return lambda batch: {"keys": [projections(h, similar, edges, known).view(np.int64) if len(h) else [] for h in shingle_sets(raw_texts(batch, "text"), size)]}

    return append_columns(df, make, {"keys": "array<long>"}, keep=["id"])


def sketch(h: np.ndarray, bits: int = 512) -> np.ndarray:
    """A bit for each class of shingles: whether the set has an odd number of them.

    Two sketches differ in at most as many bits as the sets do in elements.  The two
    halves of a sketch make the one of half as many bits.
    """
    odd = np.bincount(((h >> np.uint64(16)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def wide_sketch(h: np.ndarray) -> bytes | None:
    """Of a large set, a sketch of as many bits as it has shingles, or up to twice as many."""
    return sketch(h, 1 << (len(h) - 1).bit_length()).tobytes() if len(h) > WIDE else None


def bits_apart(x: bytes, y: bytes) -> int:
    """In how many bits two sketches differ, the longer one folded."""
    u, v = (np.frombuffer(z, np.uint64) for z in (x, y))
    while len(u) != len(v):
        u, v = (u[: len(u) // 2] ^ u[len(u) // 2 :], v) if len(u) > len(v) else (u, v[: len(v) // 2] ^ v[len(v) // 2 :])
    return int(np.bitwise_count(u ^ v).sum())


def count_words(docs: DataFrame) -> np.ndarray:
    """How many words of all texts fall on each counter; a task sums up its own first."""

    def count(batches):
        total = np.zeros(1 << COUNTERS, np.int64)
        for batch in batches:
            for piece in in_pieces(raw_texts(batch, "text")):
                total += np.bincount(place(hashed_words([t.translate(_LOW) for t in piece], _LETTERS)[0]), minlength=1 << COUNTERS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], ["i", "n"])

    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    found = docs.select("text").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # at most a row for each counter
    out = np.zeros(1 << COUNTERS, np.int64)
    out[found["i"].to_numpy()] = found["n"].to_numpy()
    return out


def _sets(df: DataFrame, size: int, similar: int, rare) -> DataFrame:
    """``df`` (with text) with n (shingles), s1 and s2 (hash of the set), its sketches and
    keys (its sites); ``rare`` is what :func:`shingle_sets` needs, broadcast."""

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, list]:
            texts = raw_texts(batch, "text")
            sets, keys = shingle_sets(texts, size), [sites(k, similar) for k in shingle_sets(texts, size, rare.value)]
            at = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
            return {
                "n": list(map(len, sets)),
                "s1": [int(mix(h).sum(dtype=np.uint64).astype(np.int64)) for h in sets],
                "s2": [int(mix(h ^ _A).sum(dtype=np.uint64).astype(np.int64)) for h in sets],
                "sketch": [sketch(h) for h in sets],
                "wide": [wide_sketch(h) for h in sets],
                "keys": pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64), pa.int64())),
            }

        return work

    return append_columns(df, make, {"n": "long", "s1": "long", "s2": "long", "sketch": "array<long>", "wide": "binary", "keys": "array<long>"})


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")  # two runs, which are merged
    return int(np.count_nonzero(both[1:] == both[:-1]))


def components(work: Workspace, links: DataFrame, name: str) -> DataFrame:
    """(id, component) for each id in ``links`` (columns a, b), with the smallest id
    that can be reached.

    Each round every vertex moves to the best of its neighbours and itself, and the
    links are rewritten and contracted.  In odd rounds the smallest id is best, which
    finishes stars around it at once; in even rounds the least hash, which changes
    from round to round, so that chains shrink by a constant factor.
    """
    edges = work.cut(links.select("a", "b").where("a <> b").distinct(), f"{name}-edges0")
    state = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    state = work.cut(state.withColumn("root", F.col("id")), f"{name}-state0")
    step = 0
    while edges.limit(1).count():
        step += 1
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if step % 2:
            best = both.groupBy("a").agg(F.min("b").alias("to")).where("to < a")
        else:
            rank = F.xxhash64("b", F.lit(step))
            best = both.groupBy("a").agg(F.min(rank).alias("h"), F.min_by("b", rank).alias("to")).where(F.col("h") < F.xxhash64("a", F.lit(step)))
        move = work.cut(best.select(F.col("a").alias("v"), "to"), f"{name}-move{step}")
        ends = edges
        for c in ("a", "b"):
            ends = ends.join(move.withColumnRenamed("v", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        edges = work.cut(ends.select("a", "b").where("a <> b").distinct(), f"{name}-edges{step}")
        state = state.join(move.withColumnRenamed("v", "root"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
        state = work.cut(state, f"{name}-state{step}")
        for old in (f"edges{step - 1}", f"state{step - 1}", f"move{step}"):
            work.drop(f"{name}-{old}")
    least = state.groupBy("root").agg(F.min("id").alias("component"))
    done = work.cut(state.join(least, "root").select("id", "component"), f"{name}-done")
    work.drop(f"{name}-edges{step}")
    work.drop(f"{name}-state{step}")
    return done


def _joined(work: Workspace, label: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``label`` after more links: only the graph of components is contracted."""
    for c in ("a", "b"):
        own = label.select(F.col("id").alias(c), F.col("component").alias("_c"))
        links = links.join(own, c, "left").withColumn(c, F.coalesce("_c", c)).drop("_c")
    links = work.cut(links.where("a <> b"), f"{name}-links")
    if not links.limit(1).count():
        return label
    new = components(work, links, name)
    up = new.select(F.col("id").alias("component"), F.col("component").alias("_c"))
    old = label.join(up, "component", "left").select("id", F.coalesce("_c", "component").alias("component"))
    return work.cut(old.union(new.join(label, "id", "left_anti").select("id", "component")), f"{name}-all")


def _distances(work: Workspace, texts: DataFrame, pairs: DataFrame, size: int, similar: int, name: str) -> DataFrame:
    """(a, b, d, link) for pairs of ids: d is their exact distance."""
    need = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    need = work.cut(need, f"{name}-need")
    found = texts.join(if_small(need, SMALL), "id", "left_semi")
    whole = append_columns(found, lambda: lambda batch: {"set": [s.tobytes() for s in shingle_sets(raw_texts(batch, "text"), size)]}, {"set": "binary"}, keep=["id"])
    sets = work.cut(whole, f"{name}-sets")
    # a pivot, and so b, can be in very many pairs: the sets of pivots are sent to all if they are
    # small together; else those pairs come last, and skewed partitions are split
    firsts = sets.join(if_small(pairs.select(F.col("b").alias("id")).distinct(), SMALL), "id", "left_semi").select(F.col("id").alias("b"), F.col("set").alias("y"))
    size_of = firsts.agg(F.sum(F.length("y") + 64).alias("bytes")).first()["bytes"] or 0
    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(F.broadcast(firsts) if size_of <= SENT else firsts, "b")

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, list]:
            d, link = [], []
            for x, y in zip(*(batch.column(batch.schema.get_field_index(c)) for c in "xy")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = overlap(x, y)
                every = len(x) + len(y) - both
                d.append(1 - both / every)
                link.append(100 * both >= similar * every)
            return {"d": d, "link": link}

        return work

    done = work.cut(append_columns(met, make, {"d": "double", "link": "boolean"}, keep=["a", "b"]), f"{name}-d")
    work.drop(f"{name}-sets")
    work.drop(f"{name}-need")
    return done


def _near(similar: int, na: str, sa: str, nb: str, sb: str) -> Column:
    """Whether sizes and sketches leave it possible that two sets link."""
    apart = sum((F.bit_count(F.get(sa, F.lit(k)).bitwiseXOR(F.get(sb, F.lit(k)))) for k in range(8)), F.lit(0))
    sizes = 100 * F.least(na, nb) >= similar * F.greatest(na, nb)
    return sizes & (apart * (100 + similar) <= (100 - similar) * (F.col(na) + F.col(nb)))


def _may_link(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches leave it possible that they link."""
    for c in "ab":
        pairs = pairs.join(sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")), c)
    most = (100 - similar) * (F.col("na") + F.col("nb"))  # elements in which linked sets differ, times 100 + similar
    near = pairs.where(_near(similar, "na", "sa", "nb", "sb")).select("a", "b", most.alias("most"))
    for c in "ab":
        near = near.join(sets.where("wide IS NOT NULL").select(F.col("id").alias(c), F.col("wide").alias(f"w{c}")), c, "left")

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, list]:
            rows = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("most", "wa", "wb")))
            return {"may": [x is None or y is None or bits_apart(x, y) * (100 + similar) <= most for most, x, y in rows]}

        return work

    return append_columns(near, make, {"may": "boolean"}, keep=["a", "b"]).where("may").select("a", "b")


def _regions(keys: DataFrame) -> DataFrame:
    """One site for each set of members that has different sets in it.

    Near copies share most of their sites, so many regions have the same members;
    their number, two of them and the exclusive or of hashes of all tell which.
    """
    by_key = keys.groupBy("key").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi"), F.count("*").alias("k"), F.bit_xor(F.xxhash64("id", "s1")).alias("x"))
    return by_key.where("lo <> hi").groupBy("lo", "hi", "k", "x").agg(F.min("key").alias("key")).select("key")


def _open_cells(work: Workspace, cells: DataFrame, label: DataFrame, name: str) -> DataFrame | None:
    """The cells with several components and someone at home: (key, id, n, home, d, c, homes)."""
    seen = cells.join(label, "id", "left").select("key", "id", "n", "home", "d", F.coalesce("component", "id").alias("c"))
    seen = work.cut(seen, f"{name}-seen")
    apart = seen.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count_if("home").alias("homes"))
    apart = work.cut(apart.where("lo <> hi AND homes > 0").select("key", "homes"), f"{name}-apart")
    if not apart.limit(1).count():
        return None
    done = work.cut(seen.join(apart, "key"), f"{name}-open")
    work.drop(f"{name}-seen")
    return done


def _small_pairs(cells: DataFrame, sets: DataFrame, leaf: int, similar: int) -> DataFrame:
    """The pairs (a, b) that may link within the cells of up to ``leaf`` sets at home."""
    mine = cells.where(F.col("homes") <= leaf).join(sets.select("id", "sketch"), "id")
    others = mine.where("home").select("key", F.col("id").alias("o"), F.col("n").alias("no"), F.col("c").alias("co"), F.col("d").alias("do"), F.col("sketch").alias("so"))
    window = F.coalesce(F.abs(F.col("d") - F.col("do")) <= 1 - similar / 100 + 1e-9, F.lit(True))
    once = (F.col("id") > F.col("o")) | ~F.col("home")
    met = mine.join(others, (mine["key"] == others["key"]) & (F.col("c") != F.col("co")) & once & window & _near(similar, "n", "sketch", "no", "so"))
    return _may_link(met.select(F.greatest("id", "o").alias("a"), F.least("id", "o").alias("b")).distinct(), sets, similar)


def _merged(large: DataFrame) -> DataFrame:
    """Large cells that share most of their members as one, so that these meet one set of pivots only.

    A cell is renamed after its member of the least hash, so two become one with the
    probability of the share that they have in common, in each of ``MERGES`` passes.
    No pair is lost: a member at home in one of the cells is at home in the whole.
    """
    for k in range(MERGES):
        names = large.groupBy("key").agg(F.min(F.xxhash64("id", F.lit(k))).alias("to"))
        large = large.join(names, "key").groupBy(F.col("to").alias("key"), "id", "n", "c").agg(F.max("home").alias("home"))
    homes = large.groupBy("key").agg(F.count_if("home").alias("homes"))
    return large.join(homes, "key")


def _large_pairs(cells: DataFrame, leaf: int, step: int) -> tuple[DataFrame, DataFrame]:
    """(key, pivot) of larger cells, and the pairs of all their members with them."""
    # cells are uneven, so more pivots than parts; a region that stays large gets more of them
    count = F.least(F.lit(PIVOTS), F.ceil(F.col("homes") / leaf) * (SPREAD << min(step - 1, 6)))
    chosen = cells.where("home").groupBy("key", F.pmod(F.xxhash64("id", F.lit(step)), count).alias("bucket")).agg(F.min("id").alias("pivot")).select("key", "pivot")
    met = cells.join(chosen, "key").where("id <> pivot")
    return chosen, met.select(F.greatest("id", "pivot").alias("a"), F.least("id", "pivot").alias("b")).distinct()


def _cells(cells: DataFrame, chosen: DataFrame, known: DataFrame, similar: int) -> DataFrame:
    """The Voronoi cells of larger cells' pivots, without the pivots themselves."""
    large = cells.join(chosen.select("key", F.col("pivot").alias("id")), ["key", "id"], "left_anti")
    met = large.join(chosen.select("key", "pivot"), "key")
    met = met.withColumns({"a": F.greatest("id", "pivot"), "b": F.least("id", "pivot")}).join(known.select("a", "b", "d"), ["a", "b"])
    near = met.groupBy("key", "id", "n", "home").agg(F.min(F.struct("d", "pivot")).alias("near"), F.collect_list(F.struct("pivot", "d")).alias("all"))  # at most PIVOTS
    far = F.col("near.d") + 2 * (1 - similar / 100) + 1e-9
    each = near.select("key", "id", "n", "home", "near", far.alias("far"), F.explode("all").alias("x"))
    own = F.col("x.pivot") == F.col("near.pivot")
    to = F.when(F.col("home"), own | (F.col("x.pivot") < F.col("near.pivot"))).otherwise(True) & (F.col("x.d") <= F.col("far"))
    return each.where(to).select(F.xxhash64("key", "x.pivot").alias("key"), "id", "n", (F.col("home") & own).alias("home"), F.col("x.d").alias("d"))


def _stars(work: Workspace, texts: DataFrame, keys: DataFrame, sets: DataFrame, copies: DataFrame, label: DataFrame | None, size: int, similar: int, name: str, merge: bool = False) -> tuple[DataFrame, DataFrame]:
    """Regions (id, n, s1, key) joined with a pivot each: the components, and the regions
    with different sets (key, id, n, home, d) but for their pivots.  With ``merge``, regions
    with the same pivot become one: near texts share many of them."""
    region = work.cut(_regions(keys), f"{name}-regions")
    member = keys.join(if_small(region, SMALL), "key").join(if_small(copies.select("id"), SMALL), "id", "left_anti")
    member = work.cut(member.select("key", "id", "n").distinct(), f"{name}-members")
    pivots = work.cut(member.groupBy("key").agg(F.min("id").alias("pivot")), f"{name}-pivots")
    base = member.join(pivots, "key").where("id <> pivot")
    base = base.select(F.col("pivot").alias("key"), "id", "n", "pivot").distinct() if merge else base.select("key", "id", "n", "pivot")
    base = work.cut(base, f"{name}-base")
    for x in ("regions", "members", "pivots"):
        work.drop(f"{name}-{x}")
    work.tidy()
    # each set with its first pivot, which is enough for most groups; then with those that it isn't connected with yet
    first = base.groupBy(F.col("id").alias("a")).agg(F.min("pivot").alias("b"))
    first = work.cut(_may_link(first, sets, similar), f"{name}-first")
    known = _distances(work, texts, first, size, similar, f"{name}-star")
    links = known.where("link").select("a", "b")
    label = components(work, links, f"{name}-comp") if label is None else _joined(work, label, links, f"{name}-comp")
    pairs = base.select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    for c in "ab":
        pairs = pairs.join(label.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")), c, "left")
    pairs = pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    pairs = work.cut(_may_link(pairs, sets, similar), f"{name}-near")
    if pairs.limit(1).count():
        more = _distances(work, texts, pairs, size, similar, f"{name}-dist")
        label = _joined(work, label, more.where("link").select("a", "b"), f"{name}-join")
        known = known.union(more)
    far = known.select(F.col("a").alias("id"), F.col("b").alias("pivot"), "d")
    cells = work.cut(base.join(far, ["id", "pivot"], "left").select("key", "id", "n", F.lit(True).alias("home"), "d"), f"{name}-cells")
    for x in ("base", "first", "near", "star-d", "dist-d"):
        work.drop(f"{name}-{x}")
    return label, cells


def _recursion(work: Workspace, texts: DataFrame, cells: DataFrame, sets: DataFrame, label: DataFrame, size: int, similar: int) -> DataFrame:
    """The components after all pairs of the cells are linked, connected or ruled out."""
    step = 0
    while (rest := _open_cells(work, cells, label, f"round{step}")) is not None:
        step += 1
        pairs = work.cut(_small_pairs(rest, sets, CLOSE, similar), f"pairs{step}")
        known = _distances(work, texts, pairs, size, similar, f"dist{step}")
        label = _joined(work, label, known.where("link").select("a", "b"), f"comp{step}")
        if not rest.where(F.col("homes") > CLOSE).limit(1).count():
            break
        large = work.cut(_merged(rest.where(F.col("homes") > CLOSE)), f"large{step}")
        chosen, pairs = _large_pairs(large, CLOSE, step)
        chosen, pairs = work.cut(chosen, f"pivots{step}"), work.cut(pairs, f"wide{step}")
        known = _distances(work, texts, pairs, size, similar, f"far{step}")
        label = _joined(work, label, known.where("link").select("a", "b"), f"link{step}")
        cells = work.cut(_cells(large, chosen, known, similar), f"cells{step}")
        for name in (f"round{step - 1}-open", f"round{step - 1}-apart", f"pivots{step}", f"pairs{step}", f"wide{step}", f"large{step}", f"dist{step}-d", f"far{step}-d"):
            work.drop(name)
        work.tidy()
    return label


def find_components(docs: DataFrame, size: int, similar: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """For ``docs`` (id, text), where rows with the same id have the same set: (id, n, s1, s2)
    of each row, and (id, component) of all that link."""
    rare = docs.sparkSession.sparkContext.broadcast(np.log2(1.0 + count_words(docs)).astype(np.float32))
    sets = work.cut(_sets(docs, size, similar, rare).select("id", "n", "s1", "s2", "sketch", "wide", "keys"), "sets")

    # equal sets: one representative each
    whole = sets.where("n > 0 AND id IS NOT NULL")
    narrow = whole.select("id", "n", "s1", "s2")
    groups = narrow.groupBy("n", "s1", "s2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last")
    groups = work.cut(groups.select("n", "s1", "s2", "first"), "groups")
    copies = work.cut(narrow.join(groups, ["n", "s1", "s2"]).where("id <> first").select("id", "first").distinct(), "copies")
    work.drop("groups")

    texts = docs.where("id IS NOT NULL")
    keys = whole.select("id", "n", "s1", F.explode("keys").alias("key"))
    label, cells = _stars(work, texts, keys, whole, copies, None, size, similar, "site")
    rest = _open_cells(work, cells, label, "site")
    work.drop("site-cells")
    if rest is not None:
        pairs = work.cut(_small_pairs(rest, whole, LEAF, similar), "site-pairs")
        known = _distances(work, texts, pairs, size, similar, "site-more")
        label = _joined(work, label, known.where("link").select("a", "b"), "site-comp1")
        many = work.cut(rest.where(F.col("homes") > LEAF).select("id").distinct(), "many")
        work.drop("site-open")
        if many.limit(1).count():
            found = _projected(texts.join(if_small(many, SMALL), "id", "left_semi"), size, similar)
            keys = found.join(whole.select("id", "n", "s1"), "id").select("id", "n", "s1", F.explode("keys").alias("key"))
            label, cells = _stars(work, texts, keys, whole, copies, label, size, similar, "class", merge=True)
            label = _recursion(work, texts, cells, whole, label, size, similar)
    head = label.withColumnRenamed("id", "first")
    others = copies.join(head, "first", "left").select("id", F.coalesce("component", "first").alias("component"))
    return sets.drop("keys"), work.cut(label.union(others), "components")


def _numbered(df: DataFrame, ident, text_col: str, size: int, work: Workspace) -> DataFrame | None:
    """Rows (vertex, id, text) with a vertex for each row that has an id, written to the
    shared folder, if rows share an id; None if no id occurs twice."""
    twice = df.where(ident.isNotNull()).groupBy(ident.alias("id")).count().where("count > 1")
    if not twice.limit(1).count():
        return None
    vertex = F.when(ident.isNotNull(), F.monotonically_increasing_id())
    rows = df.select(vertex.alias("vertex"), ident.alias("id"), F.col(text_col).alias("text"))
    return work.cut(rows, "numbered")


def _of_ids(work: Workspace, rows: DataFrame, label: DataFrame) -> DataFrame:
    """(id, component) of ids whose rows are several vertices: rows with one id are linked."""
    owner = rows.where("id IS NOT NULL").select("vertex", "id")
    part = owner.join(label.withColumnRenamed("id", "vertex"), "vertex", "left").select("id", F.coalesce("component", "vertex").alias("part"))
    part = work.cut(part.distinct(), "parts")
    # ids that have a part in common are linked with the first of them
    ids = part.groupBy("part").agg(F.min("id").alias("first"))
    links = part.join(ids, "part").select(F.col("id").alias("a"), F.col("first").alias("b"))
    return components(work, links, "ids")


def linked_ids(df: DataFrame, ident, text_col: str, size: int, similar: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(id, n) of each row, and (id, component) of all ids that links connect with another."""
    rows = _numbered(df, ident, text_col, size, work)
    if rows is None:
        docs = df.select(ident.alias("id"), F.col(text_col).alias("text"))
        sets, label = find_components(docs, size, similar, work)
        return sets.select("id", "n"), label
    sets, label = find_components(rows.select(F.col("vertex").alias("id"), "text"), size, similar, work)
    label = _of_ids(work, rows, label)
    sets = sets.withColumnRenamed("id", "vertex").join(rows.select("vertex", "id"), "vertex", "left").select("id", "n")
    return work.cut(sets, "sizes"), label


def jaccard_components(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    similar: int = 80,
    workspace: Workspace | None = None,
    n_shingles: str = "n_shingles",
    component: str = "component_id",
    keep: list[str] | None = None,
) -> DataFrame:
    """``df`` (or its columns ``keep``) with the size of its set and the smallest
    id that its links reach."""
    work = workspace or Workspace(df.sparkSession)
    ident = F.col(id_col).cast("long")
    sets, label = linked_ids(df, ident, text_col, size, similar, work)
    if keep == [id_col]:
        out = sets.select(F.col("id").alias(id_col), F.col("n").alias(n_shingles)).join(label.withColumnRenamed("id", id_col), id_col, "left")
        return out.select(id_col, n_shingles, F.coalesce("component", id_col).alias(component))
    top, other, n = fresh(df, "component"), fresh(df, "id"), fresh(df, "n")
    label = label.select(F.col("id").alias(other), F.col("component").alias(top))
    # sizes again from the row's own text: rows of one id may differ
    sized = append_columns(df, lambda: lambda batch: {n: list(map(len, shingle_sets(raw_texts(batch, text_col), size)))}, {n: "long"})
    out = sized.join(label, ident == F.col(other), "left")
    kept = [c for c in (keep or df.columns) if c.lower() not in (n_shingles.lower(), component.lower())]
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col(n).alias(n_shingles), F.coalesce(F.col(top), ident).alias(component))


def drop_linked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similar: int = 80, workspace: Workspace | None = None) -> DataFrame:
    """``df`` less the rows that links connect with a smaller id; of equal rows that
    share an id all stay.  A row with a null id is a vertex of its own and comes after
    all ids: it goes if a row with an id, or another such row, stays for it."""
    work = workspace or Workspace(df.sparkSession)
    gone, key = fresh(df, "gone"), fresh(df, "key")
    ident = F.col(id_col).cast("long")
    bare, ids = None, df.where(ident.isNotNull())
    if df.where(ident.isNull()).limit(1).count():
        numbered = work.cut(df.where(ident.isNull()).withColumn(key, F.monotonically_increasing_id()), "bare")
        salt, taken = 0, ids.select(ident.alias(key))
        while bare is None or bare.join(taken, key, "left_semi").limit(1).count() or bare.groupBy(key).count().where("count > 1").limit(1).count():
            bare, salt = numbered.withColumn(key, F.xxhash64(key, F.lit(salt))), salt + 1  # numbers that are no ids
        ids = ids.select(ident.alias("id"), F.col(text_col).alias("text")).union(bare.select(key, text_col))
        _, label = linked_ids(ids, F.col("id"), "text", size, similar, work)
        label = label.union(label.select(F.col("component").alias("id"), "component")).distinct()  # the least of copies may have no row
        label = label.join(bare.select(F.col(key).alias("id"), F.lit(1).alias("bare")), "id", "left").withColumn("bare", F.coalesce("bare", F.lit(0)))
        stays = label.groupBy("component").agg(F.min(F.struct("bare", "id"))["id"].alias("stays"))
        lost = label.join(stays, "component").where("id <> stays").select(F.col("id").alias(gone))
    else:
        _, label = linked_ids(ids, ident, text_col, size, similar, work)
        lost = label.where("id <> component").select(F.col("id").alias(gone))
    lost = if_small(work.cut(lost, "lost"), SMALL)
    work.drop("sets")
    if bare is None:
        return df.join(lost, ident == F.col(gone), "left_anti")
    kept = bare.join(lost, F.col(key) == F.col(gone), "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
    return df.where(ident.isNotNull()).join(lost, ident == F.col(gone), "left_anti").union(kept)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs, size=3, similar=90, keep=["doc_id"])
