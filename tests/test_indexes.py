"""Stored indexes, exact pruned searches, boosting, background tasks and the compacted stream log."""

import random
import re
import threading
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.functions.numeric import round_exact
from evidentia.functions.patterns import match_many
from evidentia.operators import blockmax, boosting, dense, lexical, model, vectors
from evidentia.plans.tasks import Cancelled, Task, Tasks
from evidentia.sources import candidates, store
from evidentia.streaming.topk import StreamingTopK


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# -- postings ------------------------------------------------------------------


@pytest.fixture(scope="module")
def texts(spark):
    """Most texts are long and have the common words here and there; a few are short and full of them."""
    r = random.Random(3)
    rows = []
    for k in range(6000):
        if k % 100 == 7:
            words = [r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randrange(3, 8))]
        else:
            words = [f"w{int(r.paretovariate(0.6))}" for _ in range(r.randrange(40, 90))] + [w for w in ("alpha", "beta", "gamma") if r.random() < 0.4]
        rows.append((k, f"c{k % 50}", 1.0 + k % 3, " ".join(words)))
    rows += [(9000, "c1", 1.0, None), (9001, "c1", 1.0, ""), (9002, None, 1.0, "alpha w1 w2")]
    return spark.createDataFrame(rows, "doc long, cid string, weight double, text string").repartition(4).cache()


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    made = lexical.build_index(texts)
    blockmax.BlockIndex.build(made, span=32).save(f"{path}/blocks", 4)
    made.save(f"{path}/plain", 4)
    return made, path


@pytest.mark.parametrize(("query", "k"), [("alpha beta gamma", 10), ("w1 w7 w9 alpha", 25), ("alpha alpha w555", 3), ("w123456789 nothing", 5), ("", 5), ("w3", 100_000)])
def test_blocks_give_the_same_answer(spark, index, query, k):
    made, path = index
    answer = blockmax.BlockIndex.load(spark, f"{path}/blocks").search(query, k)
    got = [(r.doc, r.cid, r.score) for r in lexical.top(answer.scores.withColumn("score", F.round("score", 6)), k, key="doc").collect()]
    want = lexical.bm25(made, lexical.query_terms(spark, query)) if query else made.postings.where("false").select("doc", "cid", F.lit(0.0).alias("score"))
    assert got == [(r.doc, r.cid, r.score) for r in lexical.top(want.withColumn("score", F.round("score", 6)), k, key="doc").collect()]
    read = answer.read.first()
    assert 0 <= read.postings <= read.of
    if query == "alpha beta gamma":
        assert read.of > 6000 and read.postings <= read.of / 3


def test_blocks_are_made_without_shuffling_postings(spark):
    """Texts are shuffled, by range; postings were too, twice, at many times the table's size."""
    rows = spark.createDataFrame([(1, "a", 1.0, "x y x"), (2, "b", 1.0, "y z"), (3, "c", 1.0, None)], "doc long, cid string, weight double, text string")
    blocks = blockmax.BlockIndex.build(lexical.build_index(rows)).blocks
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "Exchange hashpartitioning(part#" in plan
    got = {(r.term, x.doc, x.cid, x.tf, x.dl) for r in blocks.collect() for x in r.rows}
    assert got == {("x", 1, "a", 2, 3), ("y", 1, "a", 1, 3), ("y", 2, "b", 1, 2), ("z", 2, "b", 1, 2)}


def test_blocks_of_other_settings(spark, index):
    from dataclasses import replace

    with pytest.raises(ValueError):
        blockmax.BlockIndex.load(spark, f"{index[1]}/blocks").search("alpha", 3, replace(blockmax.DEFAULT, k1=2.0))


def test_stored_postings_join_without_exchange(spark, index, tmp_path):
    made, _ = index
    made.save(str(tmp_path), 4)
    loaded = lexical.LexicalIndex.load(spark, str(tmp_path))
    a, b = (lexical.bm25(i, lexical.query_terms(spark, "alpha w7")) for i in (made, loaded))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    hits = loaded.matches(lexical.query_terms(spark, "alpha w7"))
    plan = plan_of(hits)
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
    # files of other buckets aren't opened: they can be gone
    own = {r.f.rpartition("/")[2] for r in hits.select(F.input_file_name().alias("f")).distinct().collect()}
    others = [p for p in (tmp_path / "postings").glob("*.parquet") if p.name not in own]
    assert len(own) <= 2 and len(others) >= 2
    for p in others:
        p.unlink()
    assert hits.count() == made.postings.where("term IN ('alpha', 'w7')").count()


# -- the store of records --------------------------------------------------------


def test_lookup_reads_few_rows(spark, tmp_path):
    path, n = str(tmp_path / "store"), 200_000
    rows = spark.range(n).select(F.format_string("id%08d", F.xxhash64("id") % 10**8).alias("candidate_id"), F.col("id").alias("n"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    store.write_store(rows, path, files=8, group=1 << 20)
    some = [r.candidate_id for r in rows.where("n % 1000 = 3").collect()]
    assert len(some) == 200
    found = store.lookup(spark, path, [*some, "id_none"])
    assert {r.candidate_id for r in found.collect()} == set(some)
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert "PushedFilters: [Or" in scan.toString()
    assert scan.metrics().apply("numOutputRows").value() < n / 1.5  # 200 pages of 1000 rows at most
    one = store.lookup(spark, path, some[:1])
    one.collect()
    assert one._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value() <= 2000
    asked = spark.createDataFrame([(i,) for i in [*some, some[0], None]], "candidate_id string")
    assert store.lookup(spark, path, asked).count() == 200
    assert store.lookup(spark, path, []).count() == 0


def test_lookup_of_many_ids_joins(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "LITERALS", 5)
    rows = spark.range(500).select(F.col("id").cast("string").alias("candidate_id"))
    store.write_store(rows, str(tmp_path / "s"))
    assert store.lookup(spark, str(tmp_path / "s"), rows.where("candidate_id < '3'")).count() == rows.where("candidate_id < '3'").count()


# -- vectors ---------------------------------------------------------------------


@pytest.mark.parametrize("clustered", [False, True])
def test_vector_index_is_exact(spark, tmp_path, clustered):
    r = np.random.default_rng(4)
    middle = r.normal(size=(20, 16)) * 3
    x = (middle[r.integers(0, 20, 3000)] + r.normal(size=(3000, 16)) * 0.2 if clustered else r.normal(size=(3000, 16))).astype(np.float32)
    x[5] = x[6]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(9000, None), (9001, [1.0]), (9002, []), (9003, [0.0] * 16)]
    df = spark.createDataFrame(rows, "doc long, embedding array<float>").repartition(4)
    vectors.VectorIndex.build(df, "doc").save(str(tmp_path))
    ix = vectors.VectorIndex.load(spark, str(tmp_path))
    for query in (x[6], x[100], -x[7], np.zeros(16, np.float32)):
        asked = [float(v) for v in query]
        score = np.array([[float(a) * b for a, b in zip(v, asked)] for v in x.tolist() + [[0.0] * 16]]).sum(1)
        best = sorted(zip([*range(3000), 9003], score), key=lambda p: (-round(p[1], 6), p[0]))[:20]
        for found, compared in (ix.search(asked, 20, "doc", 6), (dense.best_by_product(df, asked, 20, digits=6), None)):
            got = [(g.doc, g.score) for g in found.collect()]
            assert [g[0] for g in got] == [b[0] for b in best] and np.allclose([g[1] for g in got], [b[1] for b in best], atol=2e-6)
            if compared is not None and clustered and query.any():
                seen = compared.first()
                assert seen.of == 3001 and seen.compared < seen.of / 4
    assert ix.search([1.0] * 16, 5000, "doc")[0].count() == 3001
    assert ix.search([1.0], 5, "doc")[0].count() == 0
    assert vectors.VectorIndex.build(df.limit(0), "doc").search([1.0], 3, "doc")[0].count() == 0


# -- rounding ----------------------------------------------------------------------


def test_rounds_as_python_does(spark):
    r = random.Random(1)
    values = [r.random() for _ in range(120_000)] + [r.randrange(10**6) / 10**5 for _ in range(60_000)] + [r.uniform(-1e6, 1e6) for _ in range(20_000)]
    values += [0.00005, 0.5, 1.5, 2.5, -2.5, 0.00015, 2.675, 1e300, -1e17, 0.0, 0.03125, 0.09375, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", *[round_exact(F.col("v"), d).alias(f"r{d}") for d in (1, 4)])
    for row in df.collect():
        for d in (1, 4):
            want = None if row.v is None else round(row.v, d)
            assert row[f"r{d}"] == want or want != want and row[f"r{d}"] != row[f"r{d}"], (row.v, d)


# -- the first records of a file -----------------------------------------------------


def test_limit_in_file_order(spark, tmp_path):
    lines = []
    for name in ("b", "a"):
        own = [f'{{"candidate_id": "{name}{k:05d}", "profile": {{"summary": "{"x" * (k % 50)}"}}}}' if k % 7 else "{bad" for k in range(3000)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(own))
        lines = own + lines
    ids = [m[1] for x in lines if (m := re.search(r'"candidate_id": "(\w+)"', x))]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        for n in (1, 700, len(ids) // 2 + 5, len(ids) + 10):
            df = candidates.read_jsonl(spark, str(tmp_path), limit=n)
            assert "rangepartitioning" not in plan_of(df)
            assert sorted(r.candidate_id for r in df.collect()) == sorted(ids[:n])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


# -- keywords ------------------------------------------------------------------------


def test_many_keywords(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcd é") for _ in range(r.randrange(1, 7))).strip() or "a" for _ in range(10_000)] + ["Ab", "", "zz"]
    rows = [(k, "".join(r.choice("ABCDabcd é") for _ in range(60))) for k in range(40)] + [(98, None), (99, ""), (100, "x" * 50_000 + "zz")]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("__low", F.lit(1))
    listed = list(dict.fromkeys(w.lower() for w in words if w))
    for given, want in ((words, listed), (spark.createDataFrame([(w,) for w in words], "w string"), sorted(listed))):
        for block in (1 << 20, 4000):
            got = {x.id: x.keywords for x in match_many(df, "text", given, block=block).collect()}
            assert got == {i: [w for w in want if w in (t or "").lower()] for i, t in rows}


# -- boosting ------------------------------------------------------------------------


def plain_trees(x, y, trees, depth, rate, alpha, lam, least_child):
    """Second-order trees by trying each value of each feature."""
    base, made = float(np.mean(y)), []
    margin = np.full(len(y), base)

    def soft(g):
        return np.sign(g) * max(abs(g) - alpha, 0.0)

    def grow(rows, level):
        g, h = float(sum(margin[rows] - y[rows])), len(rows)
        best = None
        for f in range(x.shape[1]) if level < depth else ():
            for v in sorted(set(x[:, f]))[:-1]:
                a, b = rows[x[rows, f] <= v], rows[x[rows, f] > v]
                if len(a) >= least_child and len(b) >= least_child:
                    ga, gb = float(sum(margin[a] - y[a])), float(sum(margin[b] - y[b]))
                    gain = soft(ga) ** 2 / (len(a) + lam) + soft(gb) ** 2 / (len(b) + lam) - soft(g) ** 2 / (h + lam)
                    if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = (gain, a, b)
        if best is None:
            out[rows] = -rate * soft(g) / (h + lam)
            return
        grow(best[1], level + 1)
        grow(best[2], level + 1)

    for _ in range(trees):
        out = np.zeros(len(y))
        grow(np.arange(len(y)), 0)
        margin = margin + out
        made.append(margin)
    return made[-1]


def test_trees_equal_plain_ones(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(0)
    x = np.stack([r.integers(0, 12, 150), r.integers(0, 5, 150), r.integers(-3, 3, 150)], 1).astype(float)
    y = 0.1 * x[:, 0] + (x[:, 1] > 2) - 0.3 * (x[:, 2] == -1) + r.normal(size=150) * 0.05
    rows = [(k, a.tolist(), float(b)) for k, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame([*rows, (900, None, 1.0), (901, [1.0, 2.0, 3.0], None)], "id long, features array<double>, label double").repartition(3)
    monkeypatch.setattr(boosting, "RENEW", 2)
    fitted = model.train(df, trees=5, depth=3, rate=0.3, rows_share=1.0, features_share=1.0)
    assert fitted.getNumTrees == 5
    got = {p.id: p.p for p in df.select("id", fitted.predict(F.col("features")).alias("p")).collect()}
    want = plain_trees(x, y, 5, 3, 0.3, 0.1, 1.0, 3.0)
    assert np.allclose([got[k] for k in range(150)], want, atol=1e-7)
    fitted.save(spark, str(tmp_path / "m"))
    again = boosting.Boosted.load(spark, str(tmp_path / "m"))
    assert again == fitted and abs(sum(again.importances()) - 1) < 1e-9


def test_sampled_trees_are_the_same_again(spark):
    rows = spark.range(400).select(F.array(F.col("id") % 17, F.col("id") % 5, F.col("id") / 7).cast("array<double>").alias("features"), (F.col("id") % 17 / 17.0).alias("label"))
    a, b = (model.train(rows.repartition(n), trees=3, depth=2) for n in (2, 5))
    assert a == b
    error = model.predict(model.train(rows, trees=10, rate=0.5), rows).agg(F.avg(F.abs(F.col("model_score") - F.col("label")))).first()[0]
    assert error < 0.05


# -- background tasks ------------------------------------------------------------------


def test_tasks(spark, tmp_path):
    tasks = Tasks(spark)
    done = tasks[tasks.submit_write(lambda: spark.range(100), str(tmp_path / "out"))]
    assert done.result(60) == str(tmp_path / "out") and spark.read.parquet(done.result()).count() == 100
    told = tasks.status(done.id)
    assert told["state"] == "done" and told["jobs"] >= 1 and told["tasks_done"] == told["tasks"] > 0
    failed = tasks[tasks.submit(lambda: spark.range(1).selectExpr("raise_error('no')").collect())]
    with pytest.raises(RuntimeError, match="no"):
        failed.result(60)
    assert tasks.status(failed.id)["state"] == "failed" and tasks.status("?")["state"] == "unknown"

    @F.udf("long")
    def slow(x):
        time.sleep(1)
        return x

    long = Task(spark, lambda: [spark.range(0, 400, 1, 4).select(slow("id")).write.format("noop").mode("overwrite").save() for _ in range(3)]).start()
    until = time.time() + 60
    while not long.status()["tasks_running"] and time.time() < until:
        time.sleep(0.1)
    told = long.status()
    assert told["state"] == "running" and told["tasks_running"] > 0 and long.jobs()
    with pytest.raises(TimeoutError):
        long.result(0.1)
    assert long.cancel() and long.status()["state"] == "cancelled"
    time.sleep(0.5)
    assert not long.jobs()
    with pytest.raises(Cancelled):
        long.result()
    tasks.forget()
    assert tasks.status(done.id)["state"] == "unknown"
    held = threading.Event()
    early = Task(spark, held.wait)
    early.cancel()
    assert early.start() and early._thread.join(10) is None and early.state == "cancelled"


# -- the compacted log of a stream --------------------------------------------------------


def test_compacted_log(spark, tmp_path):
    r = random.Random(9)
    top, latest = StreamingTopK(str(tmp_path / "log"), 7, "2024-02-01", compact=4, files=2), {}
    for epoch in range(14):
        batch = {f"p{r.randrange(60)}": r.random() for _ in range(12)}
        latest |= batch
        top.add(spark.createDataFrame([(i, s, "why") for i, s in batch.items()], "candidate_id string, legacy_score double, reasoning string").coalesce(1), epoch)
        if epoch in (7, 10):  # a replay
            top.add(spark.createDataFrame([(i, s, "why") for i, s in batch.items()], "candidate_id string, legacy_score double, reasoning string").coalesce(1), epoch)
        if epoch in (2, 3, 8, 13):
            got = [(x.candidate_id, x.legacy_score) for x in top.result(spark).collect()]
            assert got == sorted(latest.items(), key=lambda x: (-x[1], x[0]))[:7]
    folders = Counter(p.name.partition("=")[0] for p in (tmp_path / "log").iterdir())
    assert folders["base"] == 2 and folders["epoch"] <= 2 * 4
    assert len(top._log(spark, None).inputFiles()) <= 2 + 4
    with pytest.raises(ValueError):
        top.result(spark, 1)


# -- tags ----------------------------------------------------------------------------------


def test_tags_of_a_table(spark):
    from evidentia.operators.tags import keep_first
    from evidentia.plans.query import FILLER_WORDS, FILLERS, Tags

    r = random.Random(6)
    words = ["data", "ml", "c++", ".net", "Café", "api-design", "go", "x", "search", "big", r"a\E", "engine", "python", "3d"]
    tags = [" ".join(r.choice(words) for _ in range(r.randrange(1, 5))) for _ in range(1500)] + ["+++", "a+++b", "a +++ b", "the", "phd", "y" * 201, "y" * 200, "", "Data", "database"]
    r.shuffle(tags)
    want = Tags(form=lambda t: t.strip().lower())
    for t in tags:
        want.offer(t)
    df = spark.createDataFrame(list(enumerate(tags)), "pos long, tag string").withColumn("k", F.lit(1)).repartition(3)
    got = keep_first(df, "tag", "pos", tuple(sorted(FILLERS | FILLER_WORDS))).orderBy("pos").collect()
    assert [x.tag.lower() for x in got] == want.keys
    assert len(got) < len(set(tags)) / 2
    assert keep_first(df.limit(0), "tag", "pos").count() == 0
