"""The ranking engine: index, retrieve, fuse, rerank, score, explain, export."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import DEFAULT, DEFAULT_QUERY, Settings
from ..functions.numeric import round_exact
from ..operators import dense, explain, features, fusion, lexical, model
from ..operators.checks import with_checks
from ..sources import candidates as source
from ..sources.profile import evidence_chunks, profiles
from .query import ParsedQuery, parse_query
from .resume import FORMATS, uploads

RESULT = (
    "candidate_id", "name", "current_title", "final_score", "rule_score", "model_score", "legacy_score", "retrieval_score", "lexical_score",
    "semantic_score", "relevance", "production", "technical", "behavioral", "career_history_relevance", "negative", "proof_of_work",
    "contradictions", "credibility", "explanation",
)


@dataclass
class Engine:
    """Candidates and their index; every ranking is a function of these and the query."""

    spark: SparkSession
    settings: Settings = DEFAULT
    make_embedder: Callable[[], dense.Embedder] | None = None
    make_scorer: Callable[[], fusion.PairScorer] | None = None
    model: object | None = None
    people: DataFrame | None = None
    chunks: DataFrame | None = None
    lexical_index: lexical.LexicalIndex | None = None
    vectors: DataFrame | None = None
    raw: DataFrame | None = field(default=None, repr=False)

    def index(self, raw: DataFrame) -> Engine:
        """Profiles, chunks and indices of raw candidate records."""
        self.raw, self.people = raw, profiles(raw)
        self.chunks = evidence_chunks(self.people)
        self.lexical_index = lexical.build_index(self.chunks, section="section")
        self.vectors = self._embed(self.chunks)
        return self

    def _embed(self, chunks: DataFrame) -> DataFrame | None:
        if self.make_embedder is None:
            return None
        there = chunks.where(F.trim("text") != "")
        return dense.embed(there, "text", self.make_embedder).select("doc", "cid", "weight", "section", "embedding")

    def save(self, path: str) -> None:
        """The index as plain tables."""
        self.raw.write.mode("overwrite").parquet(f"{path}/candidates")
        self.lexical_index.save(f"{path}/lexical")
        if self.vectors is not None:
            self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")

    @classmethod
    def load(cls, spark: SparkSession, path: str, **options) -> Engine:
        e = cls(spark, **options)
        e.raw = spark.read.parquet(f"{path}/candidates")
        e.people = profiles(e.raw)
        e.chunks = evidence_chunks(e.people)
        e.lexical_index = lexical.LexicalIndex.load(spark, f"{path}/lexical")
        if e.make_embedder is not None:
            e.vectors = spark.read.parquet(f"{path}/vectors")
        return e

    def status(self) -> dict:
        return {"status": "ok", "indexed": self.lexical_index is not None, "candidates": self.people.count() if self.people is not None else 0}

    def retrieve(self, query: str, k: int, normalise_lexical: bool = True, method: str = "weighted_norm") -> DataFrame:
        """(cid, lexical_score, semantic_score, hybrid_score, ...) of about 3k owners.

        The depth depends on ``k`` only.  Without vectors the lexical list is normalised,
        unless ``normalise_lexical`` is false: then its raw sum is the score.
        """
        s, depth = self.settings, 3 * k
        found = lexical.by_owner(lexical.bm25(self.lexical_index, lexical.query_terms(self.spark, query), s))
        marked = self.chunks.select("cid", "text", "is_title", "is_skill")
        found = lexical.boosted(found, marked, s.keywords.must, s.keywords.relevant_titles, depth)
        lex = lexical.top(found, depth)
        if self.vectors is None:
            out = lex.withColumnRenamed("score", "lexical_score").withColumnRenamed("top_chunks", "lexical_chunks")
            if normalise_lexical:
                out = fusion.normalised(out, "lexical_score", "hybrid_score")
            else:
                out = out.withColumn("hybrid_score", F.col("lexical_score"))
            return out.withColumn("semantic_score", F.lit(0.0))
        asked = self.make_embedder().encode([query])[0]
        sem = lexical.top(dense.search_owners(self.vectors, asked, depth), depth)
        if method == "rrf":
            both = fusion.weighted_norm(lex, sem, s).drop("hybrid_score")
            return both.join(fusion.reciprocal_rank(lex, sem, s).withColumnRenamed("rrf_score", "hybrid_score"), "cid")
        return fusion.weighted_norm(lex, sem, s)

    def rank(self, query: str, k: int = 100, as_of: str | None = None, parsed: ParsedQuery | None = None, use_query_lists: bool = True, normalise_lexical: bool = True, method: str = "weighted_norm") -> DataFrame:
        """The best ``k`` candidates with sub-scores, penalties, explanation and rank.

        ``as_of`` is the day that recency counts from; today if it isn't given.
        """
        s = self.settings
        as_of = as_of or str(self.spark.sql("SELECT current_date() AS d").first()["d"])
        q = parsed or parse_query(query)
        lists = features.Lists(q.must_have_skills, q.nice_to_have_skills) if use_query_lists else features.Lists(s.keywords.must, s.keywords.nice)
        fused = self.retrieve(query, k, normalise_lexical, method)
        if self.make_scorer is None:
            again = fusion.rerank(fused, None, 2 * k)
        else:
            texts = self.people.join(fused.select(F.col("cid").alias("candidate_id")), "candidate_id", "left_semi").select(F.col("candidate_id").alias("cid"), "full_text")
            paired = fusion.score_pairs(fused.join(texts, "cid", "left"), query, "full_text", self.make_scorer).drop("full_text")
            again = fusion.rerank(paired, "pair_score", 2 * k)
        short = lexical.top(again, 2 * k, "final_retrieval_score")
        short = short.select(F.col("cid").alias("candidate_id"), F.col("final_retrieval_score").alias("retrieval_score"), "lexical_score", "semantic_score")
        scored = self.score(self.people.join(F.broadcast(short), "candidate_id"), lists, as_of, short=True)  # 2k rows
        best = scored.orderBy(F.desc("final_score"), F.asc("candidate_id")).limit(k)
        out = explain.with_explanation(best).select(*RESULT)
        return lexical.ranked(out, "final_score", "candidate_id")

    def score(self, people: DataFrame, lists: features.Lists, as_of: str, short: bool = False) -> DataFrame:
        """Profiles (with a retrieval_score) and all their scores.

        A short list is dealt anew between the steps: that costs nothing, and keeps the
        optimiser from writing each step's expressions into the next one's again and again.
        """
        s = self.settings
        deal = (lambda df: df.repartition(8, "candidate_id")) if short else (lambda df: df)
        out = deal(features.with_features(deal(people), lists, as_of, s))
        out = deal(with_checks(deal(out), s))
        rule = model.rule_score(F.col("legacy_score"), F.col("retrieval_score"), F.col("proof_of_work.pow_score"), F.col("behavioral.score"), F.col("contradictions.penalty"), F.col("credibility.credibility_multiplier"))
        out = out.withColumn("rule_score", round_exact(rule, 4)).withColumn("features", model.feature_vector())
        return model.predict(self.model, out).withColumn("final_score", model.blend(F.col("rule_score"), F.col("model_score"), s))

    def run(self, path: str, query: str, k: int = 100, **options) -> DataFrame:
        """Load, index and rank a file of records."""
        return self.index(source.read_jsonl(self.spark, path)).rank(query, k, **options)

    def ingest_documents(self, files: DataFrame, query: str = "", top_n: int = 10, formats: tuple[str, ...] = FORMATS, **options) -> tuple[DataFrame, DataFrame]:
        """Rank uploaded files (``binaryFile`` rows): résumés, and JSON with any number of
        records.  Gives the ranking of 5 to 50 rows and the files that gave no record;
        without a query the default one is asked."""
        raw, errors = uploads(files, formats)
        return self.index(raw).rank(query.strip() or DEFAULT_QUERY, max(5, min(50, top_n)), **options), errors

    def training_rows(self, as_of: str) -> DataFrame:
        """(features, label) of all candidates, scored against the engine's own lists."""
        s = self.settings
        lists = features.Lists(s.keywords.must, s.keywords.nice)
        out = with_checks(features.with_features(self.people, lists, as_of, s), s)
        return out.select("candidate_id", model.feature_vector().alias("features"), model.pseudo_label().alias("label"))


def scan_scores(people: DataFrame, as_of: str, s: Settings = DEFAULT) -> DataFrame:
    """Profiles and the legacy score, without retrieval."""
    return features.with_features(people, features.Lists(s.keywords.must, s.keywords.nice), as_of, s)


def scan_top(people: DataFrame, k: int, as_of: str, s: Settings = DEFAULT) -> DataFrame:
    """The best ``k`` profiles by the legacy score alone; only they are explained."""
    best = scan_scores(people, as_of, s).orderBy(F.desc("legacy_score"), F.asc("candidate_id")).limit(k)
    return lexical.ranked(best.withColumn("reasoning", explain.short_reasoning()), "legacy_score", "candidate_id")
