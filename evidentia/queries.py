"""Queries that apply the engine's operators to the star-schema tables, with their SQL.

A chunk is a document, its owner the document's source, its weight a function of
its language, its vector the embedding of the same number; the query text is the
first benchmark item; behaviour comes from events and careers from orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import profile_queries
from .cluster import shared_folder, spread
from .config import DEFAULT, EVIDENCE
from .functions.numeric import between, clamp
from .functions.text import contacts, jaccard, matched, pack_chunks, sentences, tokens
from .operators import blockmax, checks, dense, explain, features, fusion, lexical, model, vectors
from .sources.candidates import last_wins, missing, pick
from .sources.profile import split_chunks

K = 50
AS_OF = "2024-02-01"
#: Words of the documents that stand in for keyword lists.
WORDS = ("the", "tion", "ing", "house", "de la", "password", "license", "qui", "und", "trash")
GROUPS = {"a": (("the", "and", "of", "with", "from", "that", "this"), 0.6), "b": (("ing", "tion", "ment", "heit", "ción"), 0.4)}
SKILL_WORDS = ("than", "onesen", "with", "the")
TITLE_WORDS = ("licensed", "token", "password")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _texts(spark: SparkSession, d: str, name: str = "documents") -> DataFrame:
    """A table whose rows take long, on all cores."""
    return spread(_t(spark, d, name))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    weight = F.when(F.col("lang") == "en", 1.2).when(F.col("lang") == "de", 1.0).otherwise(0.8)
    return _texts(spark, d).select(F.col("doc_id").alias("doc"), F.col("source").alias("cid"), weight.alias("weight"), "text", "lang")


def _query(spark: SparkSession, d: str) -> str:
    return _t(spark, d, "benchmark").where("item_id = 0").first()["text"]


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(lexical.build_index(_docs(spark, d)), lexical.query_terms(spark, _query(spark, d)))


def _owners(spark: SparkSession, d: str) -> DataFrame:
    return lexical.by_owner(_bm25(spark, d), chunks=0)


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), "embedding")
    return v.join(_docs(spark, d).select("doc", "cid", "weight"), "doc")


def _asked(spark: SparkSession, d: str):
    return _t(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


def _dense_owners(spark: SparkSession, d: str) -> DataFrame:
    return lexical.by_owner(dense.search(_vectors(spark, d), _asked(spark, d), 5 * K), chunks=0)


def _r(*columns: str, digits: int = 6) -> dict:
    return {c: F.round(c, digits) for c in columns}


# -- text --------------------------------------------------------------------


def tokenize_stats(spark, d):
    n = F.size(tokens(F.col("text")))
    return _texts(spark, d).select("doc_id", n.cast("long").alias("n_tokens"), F.size(F.array_distinct(tokens(F.col("text")))).cast("long").alias("n_distinct"))


def corpus_stats(spark, d):
    return lexical.build_index(_docs(spark, d)).corpus.withColumns(_r("avgdl"))


def term_df_topk(spark, d):
    p = lexical.build_index(_docs(spark, d)).postings
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).orderBy(F.desc("df"), "term").limit(100)


def sentence_split(spark, d):
    s = _texts(spark, d).select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    return s.select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


def sentence_chunks(spark, d):
    c = _texts(spark, d).select("doc_id", F.posexplode(pack_chunks(F.col("text"), 512)).alias("part", "chunk"))
    return c.select("doc_id", F.col("part").cast("long").alias("part"), F.md5("chunk").alias("chunk_md5"), F.length("chunk").cast("long").alias("size"))


def keyword_match(spark, d):
    m = matched(F.lower("text"), WORDS)
    return _texts(spark, d).select("doc_id", F.array_join(m, ",").alias("keywords"), F.size(m).cast("long").alias("n"))


def evidence_piecewise(spark, d):
    rows = _texts(spark, d).select("doc_id", F.lower("text").alias("low"))
    hits = {g: F.size(matched(F.col("low"), words)) for g, (words, _) in GROUPS.items()}
    total = sum((checks.evidence_level(hits[g]) * w for g, (_, w) in GROUPS.items()), F.lit(0.0))
    return rows.select("doc_id", *[h.cast("long").alias(f"hits_{g}") for g, h in hits.items()], F.round(F.least(F.lit(1.0), total), 6).alias("score"))


def contact_extract(spark, d):
    found = contacts(F.col("text"), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
    return _texts(spark, d).select("doc_id", F.array_join(found, ",").alias("emails"), F.size(found).cast("long").alias("n")).where("n > 0")


def text_truncation(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(F.substring("text", 1, 512)).alias("head_md5"))


# -- lexical retrieval -------------------------------------------------------


def bm25_doc_topk(spark, d):
    best = lexical.top(_bm25(spark, d).withColumns(_r("score")), K, "score", "doc")
    return best.select(F.col("doc").alias("doc_id"), F.col("cid").alias("source"), "score")


def bm25_candidate_topk(spark, d):
    best = lexical.top(_owners(spark, d).withColumns(_r("score")), K)
    return lexical.ranked(best).select(F.col("cid").alias("source"), "score", "rank")


def bm25_top_chunks(spark, d):
    rows = _bm25(spark, d).withColumns(_r("score"))
    return lexical.top_per_group(rows, "cid", 5, F.col("score"), "doc").select(F.col("cid").alias("source"), F.col("doc").alias("doc_id"), "score", F.col("rn").cast("long").alias("rn"))


def bm25_boosted_topk(spark, d):
    marked = _docs(spark, d).select("cid", "text", (F.col("lang") == "en").alias("is_title"), (F.col("lang") == "de").alias("is_skill"))
    best = lexical.boosted(_owners(spark, d), marked, SKILL_WORDS, TITLE_WORDS, K)
    return best.select(F.col("cid").alias("source"), F.round("score", 4).alias("score"))


# -- dense retrieval and fusion ----------------------------------------------


def vector_topk(spark, d):
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), "embedding")
    return dense.best_by_product(v, _asked(spark, d), K, digits=6).select(F.col("doc").alias("vec_id"), "score")


def vector_index_topk(spark, d):
    """The same from a stored index of cells."""
    v, path = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), "embedding"), shared_folder(spark)
    vectors.VectorIndex.build(v, "doc").save(path)
    best, _ = vectors.VectorIndex.load(spark, path).search(_asked(spark, d), K, "doc", 6)
    return best.select(F.col("doc").alias("vec_id"), "score")


def vector_candidate_topk(spark, d):
    best = lexical.top(_dense_owners(spark, d).withColumns(_r("score")), K)
    return best.select(F.col("cid").alias("source"), "score")


def _fused(spark, d):
    return fusion.weighted_norm(_owners(spark, d), _dense_owners(spark, d), digits=None)


def fusion_weighted_norm(spark, d):
    return _fused(spark, d).select(F.col("cid").alias("source"), *[F.round(c, 5).alias(c) for c in ("lexical_norm", "semantic_norm", "hybrid_score")])


def fusion_rrf(spark, d):
    lex, sem = (lexical.top(x.withColumns(_r("score")), K) for x in (_owners(spark, d), _dense_owners(spark, d)))
    return fusion.reciprocal_rank(lex, sem).select(F.col("cid").alias("source"), F.round("rrf_score", 8).alias("rrf_score"))


def rerank_blend(spark, d):
    terms = F.array_distinct(tokens(F.lit(_query(spark, d))))
    pair = _docs(spark, d).groupBy("cid").agg(F.max(jaccard(F.array_distinct(tokens(F.col("text"))), terms)).alias("pair"))
    base = _fused(spark, d).select("cid", F.round("hybrid_score", 5).alias("hybrid_score")).join(pair, "cid", "left")
    out = fusion.rerank(base, "pair", 10, digits=None)
    return out.select(F.col("cid").alias("source"), *[F.round(c, 5).alias(c) for c in ("rerank_score", "final_retrieval_score")])


def funnel_topk(spark, d):
    first = lexical.top(_bm25(spark, d).withColumns(_r("score")), 6 * K, "score", "doc")
    owners = first.groupBy("cid").agg(F.round(F.sum(F.col("score") * F.col("weight")), 4).alias("score"), F.count("*").alias("chunks"))
    return lexical.ranked(lexical.top(owners, 10)).select(F.col("cid").alias("source"), "score", "chunks", "rank")


# -- near duplicates and openings --------------------------------------------


def near_duplicate_pairs(spark, d):
    """Inside each conversation, pairs of turns with like token sets."""
    rows = _t(spark, d, "conversations").select("conv_id", F.struct("turn", F.array_distinct(tokens(F.col("text"))).alias("w")).alias("t"))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    pairs = F.flatten(F.transform("t", lambda a, i: F.transform(F.filter("t", lambda b: b["turn"] > a["turn"]), lambda b: F.struct(a["turn"].alias("a"), b["turn"].alias("b"), F.round(jaccard(a["w"], b["w"]), 6).alias("similarity")))))
    return rows.select("conv_id", F.explode(F.filter(pairs, lambda p: p["similarity"] > 0.2)).alias("p")).select("conv_id", F.col("p.a").alias("turn_a"), F.col("p.b").alias("turn_b"), F.col("p.similarity").alias("similarity"))


def opening_mode(spark, d):
    """Openings of three tokens, as the description check takes them; shorter texts have none."""
    w = tokens(F.col("text"))
    rows = _t(spark, d, "conversations").select("conv_id", F.when(F.size(w) >= 3, F.array_join(F.slice(w, 1, 3), " ")).alias("w"))
    rows = rows.groupBy("conv_id").agg(F.collect_list("w").alias("w"))  # a conversation's turns
    return rows.select("conv_id", F.size("w").cast("long").alias("n"), checks.commonest(F.col("w")).cast("long").alias("most"))


def positional_weights(spark, d):
    w = F.greatest(F.lit(0.6), 1.2 - 0.15 * F.col("turn"))
    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.round(F.when(F.col("role") == "system", 1.5).otherwise(w), 6).alias("weight"))
    return rows


# -- behaviour ---------------------------------------------------------------


def _behaviour(spark, d):
    e = _t(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    g = e.groupBy("user_id").agg(
        F.count("*").alias("n"), F.max("ts").alias("last"), F.sum("k").alias("k"), F.countDistinct("event_type").alias("kinds"),
        F.count_if(F.col("event_type") == "click").alias("clicks"),
    )
    days = F.datediff(F.to_date(F.lit(AS_OF)), F.to_date("last"))
    return g.select(
        "user_id", "n", "clicks", "k", days.cast("long").alias("days"), F.coalesce(between(days, 7.0, 90.0), F.lit(0.3)).alias("recent"),
        (100.0 * F.col("clicks") / F.col("n")).alias("rate"), (F.col("k") % 30).cast("double").alias("hours"), (20 + F.col("k") % 80).cast("double").alias("notice"),
        (F.col("k") % 100).cast("double").alias("github"), (40 + F.col("k") % 60).cast("double").alias("interview"),
    )


def behavioral_score(spark, d):
    b = _behaviour(spark, d)
    c = F.col
    score = features.behavioral_score(c("n") % 2 == 0, c("recent"), c("rate"), c("hours"), c("notice"), c("github"), c("interview"))
    return b.select("user_id", "days", F.round(score, 6).alias("score"))


def json_props(spark, d):
    e = _t(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


# -- timelines ---------------------------------------------------------------


def _timeline(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("start"))
    o = o.withColumn("end", F.expr("date_add(start, cast(30 + o_orderkey % 400 as int))"))
    w = Window.partitionBy("o_custkey").orderBy("start", "o_orderkey")
    return o.withColumn("next", F.lead("start").over(w)).withColumn("gap", F.datediff("next", "end"))


def timeline_gaps(spark, d):
    months = F.coalesce(F.max("gap"), F.lit(0)) / 30.0
    g = _timeline(spark, d).groupBy("o_custkey").agg(F.round(months, 6).alias("gap_months"))
    return g.withColumn("points", checks.gap_points(F.col("gap_months")))


def timeline_overlaps(spark, d):
    g = _timeline(spark, d).groupBy("o_custkey").agg(F.count_if(F.col("gap") < -90).alias("overlaps"), F.count("*").alias("roles"))
    return g.withColumn("points", checks.overlap_points(F.col("overlaps")))


def band_penalty(spark, d):
    c, o = _t(spark, d, "customer"), _t(spark, d, "orders")
    n = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    j = c.join(n, c["c_custkey"] == n["o_custkey"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "done": F.coalesce("done", F.lit(0))})
    factor = features.negative_multiplier(F.col("done") == 0, F.col("c_mktsegment") == "BUILDING", F.least(F.col("n"), F.lit(2)), F.col("c_acctbal") < 0, F.col("n") / 4.0)
    penalty = checks.credibility_penalty(checks.overlap_points(F.col("done")), checks.gap_points(F.col("n") * 4), F.when(F.col("c_acctbal") < 0, 0.45).otherwise(0.0), F.lit(0.1))
    return j.select("c_custkey", F.round(factor, 6).alias("multiplier"), F.round(penalty, 6).alias("penalty"))


# -- ranking -----------------------------------------------------------------


def weighted_rank_final(spark, d):
    s = _t(spark, d, "supplier")
    li = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("disc"), F.countDistinct("l_partkey").alias("parts"))
    j = s.join(li, s["s_suppkey"] == li["l_suppkey"])
    legacy = features.weighted_score(clamp(F.col("n") / 1000), clamp(F.col("q") / 20000), clamp(F.col("disc") * 10), clamp(F.col("parts") / 700), F.lit(0.6), F.lit(0.95))
    final = model.rule_score(legacy, clamp(F.col("s_acctbal") / 10000), clamp(F.col("parts") / 900), clamp(F.col("disc") * 8), F.lit(0.97), F.lit(0.98))
    scored = j.select("s_suppkey", F.round(final, 4).alias("score"))
    return lexical.ranked(lexical.top(scored, 20, "score", "s_suppkey"), "score", "s_suppkey")


def distinct_breadth(spark, d):
    li, s = _t(spark, d, "lineitem"), _t(spark, d, "supplier")
    j = li.join(s, li["l_suppkey"] == s["s_suppkey"]).groupBy("s_nationkey").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))
    return j.withColumn("score", F.round(clamp(0.04 * (F.col("suppliers") - 1), 0.0, 0.08), 6))


def id_anti(spark, d):
    return _t(spark, d, "documents").select("doc_id").join(_t(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


def id_semi(spark, d):
    return _t(spark, d, "documents").select("doc_id", "source").join(_t(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


def id_union(spark, d):
    """Owners that either retriever found."""
    return _fused(spark, d).select(F.col("cid").alias("source"), (F.col("lexical_score") > 0).alias("lexical"), (F.col("semantic_score") > 0).alias("semantic"))


def label_metrics(spark, d):
    j = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    m = model.metrics(j, F.col("quality").cast("double"), clamp(F.col("n_chars") / 4000.0))
    return m.select("n", *[F.round(c, 5).alias(c) for c in ("mae", "r2")])


def explain_template(spark, d):
    w = tokens(F.col("text"))
    base = _texts(spark, d).select("doc_id", F.slice(F.array_distinct(w), 1, 5).alias("w"), (F.size(w) % 9).alias("must"), (F.size(w) % 12).cast("double").alias("years"), (F.length("text") % 5).alias("stack"))
    seed = explain.seed_of(F.col("must"), F.col("years"), F.col("stack"))
    signal = explain.first_largest([("skills", F.col("must") * 1.5), ("tech", F.col("stack") * 2.0), ("career", F.lit(3.5)), ("experience", F.least(F.lit(1.0), F.col("years") / 10) * 4)])
    partial = explain.concern(seed, F.lit(None).cast("string"), F.col("must"))
    return base.select("doc_id", seed.cast("long").alias("seed"), signal.alias("signal"), partial.alias("concern"))


def best_first_topk(spark, d):
    """The bounded scan: the K best rows by score, then id."""
    o = _t(spark, d, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("score"))
    return lexical.ranked(lexical.top(o, 100, "score", "o_orderkey"), "score", "o_orderkey")


def pair_scores(spark, d):
    """The pair scorer over the heads of all documents."""
    rows = _texts(spark, d).select("doc_id", "text")
    return fusion.score_pairs(rows, _query(spark, d), "text", fusion.OverlapScorer).select("doc_id", F.round("pair_score", 6).alias("score"))


def chunk_parts(spark, d):
    """Documents as evidence chunks, split at 512 characters."""
    rows = _texts(spark, d).select("doc_id", F.col("source").alias("section"), "text")
    return split_chunks(rows, 512).groupBy("section").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("size"), F.max("part").cast("long").alias("last"))


def latest_wins(spark, d):
    """Of each user's events the last in order of time, then id."""
    e = _t(spark, d, "events").select(F.col("user_id").alias("candidate_id"), F.struct("ts", "event_id").alias("at"), "event_id", "event_type")
    return last_wins(e, "at").select(F.col("candidate_id").alias("user_id"), "event_id", "event_type")


def short_list(spark, d):
    """The records of a short list, and which of the list have none."""
    ids = _t(spark, d, "labels").select(F.col("doc_id").cast("string").alias("candidate_id"))
    have = _docs(spark, d).where("lang = 'en'").select(F.col("doc").cast("string").alias("candidate_id"), "cid")
    found = pick(have, ids).select(F.col("candidate_id").cast("long").alias("doc_id"), F.col("cid").alias("source"))
    return found.unionByName(missing(ids, have).select(F.col("candidate_id").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("source")))


def stored_index(spark, d):
    """What an index that was saved and loaded again holds of the query's terms."""
    path = shared_folder(spark)
    lexical.build_index(_docs(spark, d)).save(path, 16)
    hits = lexical.LexicalIndex.load(spark, path).matches(lexical.query_terms(spark, _query(spark, d)))
    return hits.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.sum("dl").alias("words"), F.max("qtf").cast("long").alias("qtf"))


def blockmax_doc_topk(spark, d):
    """The best documents by a stored index of posting blocks."""
    path = shared_folder(spark)
    blockmax.BlockIndex.build(lexical.build_index(_docs(spark, d)), span=32).save(path, 16)
    found = blockmax.BlockIndex.load(spark, path).search(_query(spark, d), K).scores
    best = lexical.top(found.withColumns(_r("score")), K, "score", "doc")
    return best.select(F.col("doc").alias("doc_id"), F.col("cid").alias("source"), "score")


def gbt_scores(spark, d):
    """Boosted trees over simple text counts, trained on the labels; no SQL form."""
    j = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "n_chars", "text"), "doc_id")
    vec = F.array(F.col("n_chars"), F.size(tokens(F.col("text"))), F.size(sentences(F.col("text"))), F.size(F.array_distinct(tokens(F.col("text"))))).cast("array<float>")
    rows = j.select("doc_id", vec.alias("features"), F.col("quality").cast("double").alias("label"))
    fitted = model.train(rows.orderBy("doc_id"))
    return model.predict(fitted, rows).select("doc_id", "model_score")


def parsed_queries(spark, d):
    """Benchmark items parsed as queries; no SQL form."""
    from .plans.query import parse_column

    q = parse_column(_t(spark, d, "benchmark"), "text")
    return q.select("item_id", F.col("query.role_title").alias("role_title"), F.col("query.seniority").alias("seniority"), F.col("query.min_experience_years").alias("years"), F.size("query.intent_facets").alias("intents"))


def evidence_terms(spark, d):
    """Hits of the engine's own evidence lists in documents."""
    rows = _texts(spark, d).select("doc_id", F.lower("text").alias("low"))
    hits = {c: F.size(matched(F.col("low"), terms)) for c, (terms, _) in DEFAULT.evidence.items()}
    return rows.select("doc_id", *[h.cast("long").alias(c) for c, h in hits.items()]).where(" + ".join(hits) + " > 0")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        bm25_candidate_topk, tokenize_stats, corpus_stats, term_df_topk, sentence_split, sentence_chunks, keyword_match, evidence_piecewise,
        evidence_terms, contact_extract, text_truncation, bm25_doc_topk, bm25_top_chunks, bm25_boosted_topk, vector_topk, vector_candidate_topk,
        fusion_weighted_norm, fusion_rrf, rerank_blend, funnel_topk, near_duplicate_pairs, opening_mode, positional_weights, behavioral_score,
        json_props, timeline_gaps, timeline_overlaps, band_penalty, weighted_rank_final, distinct_breadth, id_anti, id_semi, id_union,
        label_metrics, explain_template, best_first_topk, gbt_scores, parsed_queries, pair_scores, chunk_parts, latest_wins,
        short_list, stored_index, blockmax_doc_topk, vector_index_topk,
    )
}

# -- SQL ---------------------------------------------------------------------

_TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9_\\-\\.]+')"
_TEXT = _TOK.format("text")


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _hits(low: str, words) -> str:
    return f"len(list_filter({_list(words)}, lambda k: contains({low}, k)))"


def _level(n: str) -> str:
    return f"(CASE WHEN {n} = 0 THEN 0.0 WHEN {n} <= 2 THEN 0.2 * {n} WHEN {n} <= 5 THEN 0.4 + 0.4 * ({n} - 2) / 3.0 ELSE 0.8 + 0.2 * least(1.0, ({n} - 5) / 5.0) END)"


_DOCS = f"""d AS (SELECT doc_id AS doc, source AS cid, CASE lang WHEN 'en' THEN 1.2 WHEN 'de' THEN 1.0 ELSE 0.8 END::DOUBLE AS weight, text, lang, {_TEXT} AS w FROM documents)"""
_POSTINGS = f"""{_DOCS}, dl AS (SELECT doc, cid, weight, len(w)::BIGINT AS dl FROM d), p AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(w) AS term FROM d) GROUP BY ALL)"""
_BM25 = f"""{_POSTINGS}, q AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({_TEXT}) AS term FROM benchmark WHERE item_id = 0) GROUP BY term),
c AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
t AS (SELECT q.term, qtf, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM q JOIN (SELECT term, count(*) AS df FROM p GROUP BY term) USING (term), c WHERE ln((n - df + 0.5) / (df + 0.5) + 1) >= 0.2),
s AS (SELECT doc, cid, weight, sum(qtf * idf * (tf * 2.5) / (tf + 1.5 * 0.25 + 1.5 * 0.75 / avgdl * dl)) AS score FROM p JOIN t USING (term) JOIN dl USING (doc), c GROUP BY ALL HAVING score > 0),
lex AS (SELECT cid, sum(score * weight) AS score FROM s GROUP BY cid)"""
_DENSE = """v AS (SELECT vec_id AS doc, list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings),
vd AS (SELECT v.doc, d2.cid, d2.weight, v.score FROM v JOIN (SELECT doc_id AS doc, source AS cid, CASE lang WHEN 'en' THEN 1.2 WHEN 'de' THEN 1.0 ELSE 0.8 END::DOUBLE AS weight FROM documents) d2 USING (doc) ORDER BY score DESC, doc LIMIT 250),
sem AS (SELECT cid, sum(score * weight) AS score FROM vd GROUP BY cid)"""
_FUSED = f"""{_BM25}, {_DENSE},
ln_ AS (SELECT cid, score, (score - min(score) OVER ()) / greatest(max(score) OVER () - min(score) OVER (), 1e-9) AS norm FROM lex),
sn AS (SELECT cid, score, (score - min(score) OVER ()) / greatest(max(score) OVER () - min(score) OVER (), 1e-9) AS norm FROM sem),
fused AS (SELECT coalesce(ln_.cid, sn.cid) AS cid, coalesce(ln_.score, 0) AS lexical_score, coalesce(sn.score, 0) AS semantic_score, coalesce(ln_.norm, 0) AS lexical_norm, coalesce(sn.norm, 0) AS semantic_norm,
  0.45 * coalesce(ln_.norm, 0) + 0.55 * coalesce(sn.norm, 0) AS hybrid_score FROM ln_ FULL JOIN sn ON ln_.cid = sn.cid)"""
_TIMELINE = """o AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS start, (o_orderdate::DATE + (30 + o_orderkey % 400)::INT)::DATE AS fin FROM orders),
g AS (SELECT *, date_diff('day', fin, lead(start) OVER (PARTITION BY o_custkey ORDER BY start, o_orderkey)) AS gap FROM o)"""
_CLAMP = "greatest(0.0, least(1.0, {0}))".format
_SENT = r"""list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))), lambda x: x <> '')"""

SQL: dict[str, str] = {
    "tokenize_stats": f"SELECT doc_id, len({_TEXT})::BIGINT AS n_tokens, len(list_distinct({_TEXT}))::BIGINT AS n_distinct FROM documents",
    "corpus_stats": f"WITH {_POSTINGS} SELECT count(*) AS n, round(avg(dl), 6) AS avgdl FROM dl",
    "term_df_topk": f"WITH {_POSTINGS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term ORDER BY df DESC, term LIMIT 100",
    "sentence_split": f"SELECT doc_id, unnest(range(len(s)))::BIGINT AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {_SENT} AS s FROM documents)",
    "sentence_chunks": f"""WITH RECURSIVE s AS (SELECT doc_id, {_SENT} AS s FROM documents),
r(doc_id, s, i, part, size, held) AS (
  SELECT doc_id, s, 1, 0, length(s[1]) + 1, s[1] FROM s WHERE len(s) > 0
  UNION ALL
  SELECT doc_id, s, i + 1, CASE WHEN size + length(s[i + 1]) > 512 THEN part + 1 ELSE part END,
    CASE WHEN size + length(s[i + 1]) > 512 THEN length(s[i + 1]) + 1 ELSE size + length(s[i + 1]) + 1 END,
    CASE WHEN size + length(s[i + 1]) > 512 THEN s[i + 1] ELSE held || ' ' || s[i + 1] END
  FROM r WHERE i < len(s))
SELECT doc_id, part::BIGINT AS part, md5(arg_max(held, i)) AS chunk_md5, length(arg_max(held, i))::BIGINT AS size FROM r GROUP BY doc_id, part""",
    "keyword_match": f"SELECT doc_id, array_to_string(k, ',') AS keywords, len(k)::BIGINT AS n FROM (SELECT doc_id, list_filter({_list(WORDS)}, lambda k: contains(lower(text), k)) AS k FROM documents)",
    "evidence_piecewise": f"SELECT doc_id, a::BIGINT AS hits_a, b::BIGINT AS hits_b, round(least(1.0, {_level('a')} * 0.6 + {_level('b')} * 0.4), 6)::DOUBLE AS score FROM (SELECT doc_id, {_hits('lower(text)', GROUPS['a'][0])} AS a, {_hits('lower(text)', GROUPS['b'][0])} AS b FROM documents)",
    "evidence_terms": "SELECT * FROM (SELECT doc_id, " + ", ".join(f"{_hits('lower(text)', t)}::BIGINT AS {c}" for c, (t, _) in EVIDENCE.items()) + " FROM documents) WHERE " + " + ".join(EVIDENCE) + " > 0",
    "contact_extract": r"SELECT doc_id, array_to_string(e, ',') AS emails, len(e)::BIGINT AS n FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS e FROM documents) WHERE len(e) > 0",
    "text_truncation": "SELECT doc_id, md5(substring(text, 1, 512)) AS head_md5 FROM documents",
    "bm25_doc_topk": f"WITH {_BM25} SELECT doc AS doc_id, cid AS source, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, doc LIMIT {K}",
    "bm25_candidate_topk": f"WITH {_BM25} SELECT source, score, row_number() OVER (ORDER BY score DESC, source) AS rank FROM (SELECT cid AS source, round(score, 6) AS score FROM lex ORDER BY 2 DESC, 1 LIMIT {K})",
    "bm25_top_chunks": f"WITH {_BM25} SELECT * FROM (SELECT cid AS source, doc AS doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY cid ORDER BY round(score, 6) DESC, doc) AS rn FROM s) WHERE rn <= 5",
    "bm25_boosted_topk": f"""WITH {_BM25}, m AS (SELECT cid, text, lang, array_to_string(list_transform(list_filter(list_zip(w, range(len(w))), lambda x: list_position(w, x[1]) = x[2] + 1), lambda x: x[1]), ' ') AS u FROM d),
h AS (SELECT cid, max(CASE WHEN lang = 'en' AND {_hits('lower(text)', TITLE_WORDS)} > 0 THEN 1 ELSE 0 END) AS ti, sum(CASE WHEN lang = 'de' THEN least(0.20, 0.04 * {_hits('u', SKILL_WORDS)}) ELSE 0 END) AS sk FROM m GROUP BY cid),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, cid) AS rn FROM lex)
SELECT cid AS source, round(CASE WHEN rn <= 2000 THEN score * (1 + 0.15 * coalesce(ti, 0) + coalesce(sk, 0)) ELSE score END, 4)::DOUBLE AS score FROM o LEFT JOIN h USING (cid)""",
    "vector_topk": f"WITH {_DENSE} SELECT doc AS vec_id, round(score, 6) AS score FROM v ORDER BY round(score, 6) DESC, doc LIMIT {K}",
    "vector_candidate_topk": f"WITH {_DENSE} SELECT cid AS source, round(score, 6) AS score FROM sem ORDER BY round(score, 6) DESC, cid LIMIT {K}",
    "fusion_weighted_norm": f"WITH {_FUSED} SELECT cid AS source, round(lexical_norm, 5) AS lexical_norm, round(semantic_norm, 5) AS semantic_norm, round(hybrid_score, 5) AS hybrid_score FROM fused",
    "fusion_rrf": f"""WITH {_BM25}, {_DENSE}, a AS (SELECT cid, row_number() OVER (ORDER BY round(score, 6) DESC, cid) AS r FROM lex), b AS (SELECT cid, row_number() OVER (ORDER BY round(score, 6) DESC, cid) AS r FROM sem)
SELECT cid AS source, round(sum(1.0::DOUBLE / (60 + r)), 8) AS rrf_score FROM (SELECT * FROM a WHERE r <= {K} UNION ALL SELECT * FROM b WHERE r <= {K}) GROUP BY cid""",
    "rerank_blend": f"""WITH {_FUSED}, qt AS (SELECT list_distinct({_TEXT}) AS q FROM benchmark WHERE item_id = 0),
pr AS (SELECT cid, max(len(list_intersect(list_distinct(w), q)) / len(list_distinct(list_concat(w, q)))) AS pair FROM d, qt GROUP BY cid),
b AS (SELECT fused.cid, round(hybrid_score, 5) AS h, pair, row_number() OVER (ORDER BY round(hybrid_score, 5) DESC, fused.cid) <= 10 AS head FROM fused LEFT JOIN pr USING (cid)),
e AS (SELECT min(pair) AS lo, max(pair) AS hi FROM b WHERE head), n AS (SELECT *, coalesce((pair - lo) / greatest(hi - lo, 1e-9), 0) AS norm FROM b, e)
SELECT cid AS source, round(CASE WHEN head THEN norm ELSE 0 END, 5)::DOUBLE AS rerank_score, round(CASE WHEN head THEN 0.7 * h + 0.3 * norm ELSE 0.8 * h END, 5)::DOUBLE AS final_retrieval_score FROM n""",
    "funnel_topk": f"""WITH {_BM25}, f AS (SELECT doc, cid, weight, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, doc LIMIT {6 * K}),
o AS (SELECT cid AS source, round(sum(score * weight), 4) AS score, count(*) AS chunks FROM f GROUP BY cid ORDER BY 2 DESC, 1 LIMIT 10)
SELECT *, row_number() OVER (ORDER BY score DESC, source) AS rank FROM o""",
    "near_duplicate_pairs": f"""WITH t AS (SELECT conv_id, turn, list_distinct({_TEXT}) AS w FROM conversations)
SELECT a.conv_id, a.turn AS turn_a, b.turn AS turn_b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS similarity FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn
WHERE len(list_concat(a.w, b.w)) > 0 AND round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) > 0.2""",
    "opening_mode": f"WITH t AS (SELECT conv_id, CASE WHEN len({_TEXT}) >= 3 THEN array_to_string({_TEXT}[1:3], ' ') END AS w FROM conversations), c AS (SELECT conv_id, w, count(w) AS n FROM t GROUP BY ALL) SELECT conv_id, sum(n)::BIGINT AS n, max(n) AS most FROM c GROUP BY conv_id",
    "positional_weights": "SELECT conv_id, turn, round(CASE WHEN role = 'system' THEN 1.5 ELSE greatest(0.6, 1.2 - 0.15 * turn) END, 6)::DOUBLE AS weight FROM conversations",
    "behavioral_score": f"""WITH e AS (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
g AS (SELECT user_id, count(*) AS n, sum(k)::BIGINT AS k, count(*) FILTER (WHERE event_type = 'click') AS clicks, date_diff('day', max(ts)::DATE, DATE '{AS_OF}') AS days FROM e GROUP BY user_id)
SELECT user_id, days::BIGINT AS days, round({_CLAMP("0.20::DOUBLE * (CASE WHEN n % 2 = 0 THEN 1.0 ELSE 0.5 END) + 0.20 * " + _CLAMP("(days - 90.0) / (7.0 - 90.0)") + " + 0.15 * " + _CLAMP("(100.0::DOUBLE * clicks / n - 40) / 50.0") + " + 0.20 * " + _CLAMP("(k % 30 - 24.0) / (2.0 - 24.0)") + " + 0.10 * greatest(0.40, " + _CLAMP("(20 + k % 80 - 90.0) / (30.0 - 90.0)") + ") + 0.10 * " + _CLAMP("(k % 100 - 20.0) / 60.0") + " + 0.05 * " + _CLAMP("(40 + k % 60 - 50.0) / 45.0"))}, 6)::DOUBLE AS score FROM g""",
    "json_props": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, max(k) AS most FROM (SELECT event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events) GROUP BY event_type",
    "timeline_gaps": f"WITH {_TIMELINE}, m AS (SELECT o_custkey, round(coalesce(max(gap), 0) / 30.0, 6)::DOUBLE AS gap_months FROM g GROUP BY o_custkey) SELECT *, (CASE WHEN gap_months > 36 THEN 0.25 WHEN gap_months > 24 THEN 0.10 ELSE 0.0 END)::DOUBLE AS points FROM m",
    "timeline_overlaps": f"WITH {_TIMELINE}, m AS (SELECT o_custkey, count(*) FILTER (WHERE gap < -90) AS n, count(*) AS roles FROM g GROUP BY o_custkey) SELECT o_custkey, n AS \"overlaps\", roles, (CASE WHEN n >= 2 THEN 0.4 WHEN n = 1 THEN 0.15 ELSE 0.0 END)::DOUBLE AS points FROM m",
    "band_penalty": """WITH n AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY o_custkey),
j AS (SELECT c_custkey, c_mktsegment, c_acctbal, coalesce(n, 0) AS n, coalesce(done, 0) AS done FROM customer LEFT JOIN n ON c_custkey = o_custkey)
SELECT c_custkey, round(greatest(0.65::DOUBLE, (CASE WHEN done = 0 THEN 0.88 ELSE 1.0 END)::DOUBLE * (CASE WHEN c_mktsegment = 'BUILDING' AND n = 1 THEN 0.95 WHEN c_mktsegment = 'BUILDING' AND n = 0 THEN 0.85 ELSE 1.0 END)
  * (CASE WHEN c_acctbal < 0 THEN 0.90 ELSE 1.0 END) * (CASE WHEN n / 4.0 < 2.0 THEN 0.85 ELSE 1.0 END)), 6) AS multiplier,
round(least(0.12::DOUBLE, 0.30::DOUBLE * (CASE WHEN done >= 2 THEN 0.4 WHEN done = 1 THEN 0.15 ELSE 0 END) + 0.25 * (CASE WHEN n * 4 > 36 THEN 0.25 WHEN n * 4 > 24 THEN 0.10 ELSE 0 END) + 0.20 * (CASE WHEN c_acctbal < 0 THEN 0.45 ELSE 0 END) + 0.25 * 0.1), 6) AS penalty FROM j""",
    "weighted_rank_final": f"""WITH li AS (SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS q, avg(l_discount) AS disc, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey),
a AS (SELECT s_suppkey, s_acctbal, disc, parts, {_CLAMP("(0.35::DOUBLE * " + _CLAMP("n / 1000") + " + 0.25 * " + _CLAMP("q / 20000") + " + 0.20 * " + _CLAMP("disc * 10") + " + 0.20 * " + _CLAMP("parts / 700") + " + 0.05 * 0.6) * 0.95")} AS legacy FROM supplier JOIN li ON s_suppkey = l_suppkey),
b AS (SELECT s_suppkey, round({_CLAMP("(0.45::DOUBLE * legacy + 0.30 * " + _CLAMP("s_acctbal / 10000") + " + 0.15 * " + _CLAMP("parts / 900") + " + 0.10 * " + _CLAMP("disc * 8") + ") * 0.97 * 0.98")}, 4)::DOUBLE AS score FROM a)
SELECT *, row_number() OVER (ORDER BY score DESC, s_suppkey) AS rank FROM (SELECT * FROM b ORDER BY score DESC, s_suppkey LIMIT 20)""",
    "distinct_breadth": f"SELECT *, round(greatest(0.0, least(0.08, 0.04 * (suppliers - 1))), 6)::DOUBLE AS score FROM (SELECT s_nationkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey)",
    "id_anti": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "id_semi": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "id_union": f"WITH {_FUSED} SELECT cid AS source, lexical_score > 0 AS lexical, semantic_score > 0 AS semantic FROM fused",
    "label_metrics": "WITH j AS (SELECT quality::DOUBLE AS y, greatest(0.0, least(1.0, n_chars / 4000.0))::DOUBLE AS p FROM labels JOIN documents USING (doc_id)) SELECT count(*) AS n, round(avg(abs(y - p)), 5) AS mae, round(1 - var_pop(y - p) / var_pop(y), 5) AS r2 FROM j",
    "explain_template": f"""WITH b AS (SELECT doc_id, len({_TEXT}) % 9 AS must, (len({_TEXT}) % 12)::DOUBLE AS years, length(text) % 5 AS stack FROM documents),
c AS (SELECT *, must * 11 + floor(years * 7)::BIGINT + stack * 13 AS seed, greatest(must * 1.5, stack * 2.0, 3.5, least(1.0, years / 10) * 4) AS top FROM b)
SELECT doc_id, seed::BIGINT AS seed, CASE WHEN must * 1.5 = top THEN 'skills' WHEN stack * 2.0 = top THEN 'tech' WHEN 3.5 = top THEN 'career' ELSE 'experience' END AS signal,
CASE WHEN must < 4 THEN ['The overall fit with JD-specific requirements is partial.', 'Several JD requirements are not directly evidenced in the profile.', 'The match is present but less comprehensive than stronger candidates.'][(seed % 3 + 1)::INT] ELSE '' END AS concern FROM c""",
    "chunk_parts": f"""WITH RECURSIVE x AS (SELECT doc_id, source, text, trim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS t, {_SENT} AS s FROM documents),
r(doc_id, source, s, i, part, size, held) AS (
  SELECT doc_id, source, s, 1, 0, length(s[1]) + 1, s[1] FROM x WHERE length(t) > 512
  UNION ALL
  SELECT doc_id, source, s, i + 1, CASE WHEN size + length(s[i + 1]) > 512 THEN part + 1 ELSE part END,
    CASE WHEN size + length(s[i + 1]) > 512 THEN length(s[i + 1]) + 1 ELSE size + length(s[i + 1]) + 1 END,
    CASE WHEN size + length(s[i + 1]) > 512 THEN s[i + 1] ELSE held || ' ' || s[i + 1] END
  FROM r WHERE i < len(s)),
c AS (SELECT doc_id, source, part, length(arg_max(held, i)) AS size FROM r GROUP BY doc_id, source, part UNION ALL SELECT doc_id, source, 0, length(text) FROM x WHERE length(t) BETWEEN 1 AND 512),
p AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM c)
SELECT CASE WHEN n > 1 THEN source || ' [part ' || (part + 1) || ']' ELSE source END AS section, count(*) AS chunks, sum(size)::BIGINT AS size, max(part)::BIGINT AS last FROM p GROUP BY 1""",
    "pair_scores": f"""WITH q AS (SELECT list_distinct(regexp_extract_all(lower(substring(text, 1, 512)), '[a-z0-9_\\-\\.]+')) AS q FROM benchmark WHERE item_id = 0)
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN NULL ELSE round(len(list_intersect(list_distinct(regexp_extract_all(lower(substring(text, 1, 512)), '[a-z0-9_\\-\\.]+')), q)) / len(q), 6) END AS score FROM documents, q""",
    "latest_wins": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "short_list": "SELECT l.doc_id, d.source FROM (SELECT DISTINCT doc_id FROM labels) l LEFT JOIN (SELECT * FROM documents WHERE lang = 'en') d USING (doc_id)",
    "stored_index": f"WITH {_POSTINGS}, q AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({_TEXT}) AS term FROM benchmark WHERE item_id = 0) GROUP BY term) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, sum(dl)::BIGINT AS words, max(qtf)::BIGINT AS qtf FROM p JOIN dl USING (doc) JOIN q USING (term) GROUP BY term",
    "best_first_topk": "SELECT *, row_number() OVER (ORDER BY score DESC, o_orderkey) AS rank FROM (SELECT o_orderkey, round(o_totalprice, 2) AS score FROM orders ORDER BY 2 DESC, 1 LIMIT 100)",
}
QUERIES |= profile_queries.QUERIES
SQL |= profile_queries.SQL
SQL |= {"blockmax_doc_topk": SQL["bm25_doc_topk"], "vector_index_topk": SQL["vector_topk"]}
