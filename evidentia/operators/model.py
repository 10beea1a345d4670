"""Feature vectors, pseudo-labels and a boosted-tree model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..cluster import ship
from ..config import DEFAULT, Settings
from ..functions.numeric import clamp, round_exact
from . import boosting

#: Fixed order of the vector.
NAMES = (
    "relevance_score", "must_count", "nice_count", "must_ratio", "nice_ratio", "title_relevant", "title_irrelevant",
    "production_score", "prod_signal_count", "prod_ratio", "exp_years", "exp_ratio", "tier1", "tier2",
    "technical_score", "retrieval_count", "retrieval_ratio", "eval_count", "python_count", "python_ratio",
    "behavioral_score", "open_to_work", "recency_score", "response_rate", "response_time_h", "notice_days", "github",
    "career_score", "career_relevant_count", "is_career_pivot",
    "neg_multiplier", "neg_no_production", "neg_irrelevant_role", "neg_wrapper_only", "neg_under_experienced",
    "final_score",
)


def feature_vector() -> Column:
    """The 36 numbers, as an array of floats in the order of ``NAMES``."""
    rel, prod, tech, beh = (F.col(c) for c in ("relevance", "production", "technical", "behavioral"))
    hist, neg = F.col("career_history_relevance"), F.col("negative")

    def has(*flags: str) -> Column:
        return F.arrays_overlap(neg["flags"], F.array(*[F.lit(f) for f in flags]))

    def bit(test: Column) -> Column:
        return F.when(test, 1.0).otherwise(0.0)

    values = [
        rel["score"], rel["must_count"], rel["nice_count"], clamp(rel["must_count"] / 14.0), clamp(rel["nice_count"] / 20.0),
        bit(rel["title_relevant"]), bit(has("irrelevant_current_role", "irrelevant_current_role_mild")),
        prod["score"], prod["prod_signal_count"], clamp(prod["prod_signal_count"] / 10.0), prod["exp_years"], clamp(prod["exp_years"] / 15.0), bit(prod["tier1"]), bit(prod["tier2"]),
        tech["score"], tech["retrieval_count"], clamp(tech["retrieval_count"] / 10.0), tech["eval_count"], tech["python_count"], clamp(tech["python_count"] / 8.0),
        beh["score"], bit(beh["open_to_work"]), beh["recency_score"], beh["response_rate"], beh["response_time_h"], beh["notice_days"], beh["github"],
        hist["score"], hist["career_history_relevant_count"], bit(hist["is_career_pivot"]),
        neg["multiplier"], bit(has("no_production_signals")), bit(has("irrelevant_current_role")), bit(has("api_wrapper_only")), bit(has("under_experienced")),
        F.col("legacy_score"),
    ]
    return F.array(*[F.coalesce(v.cast("float"), F.lit(0.0).cast("float")) for v in values])


def pseudo_label() -> Column:
    """The score, sharpened by strong signs and dulled by flags."""
    rel, prod, tech = F.col("relevance"), F.col("production"), F.col("technical")
    flags = F.col("negative.flags")

    def gain(n: Column, least: int, each: float, most: float) -> Column:
        return F.when(n >= least, F.least(F.lit(most), n * each)).otherwise(0.0)

    off = sum((F.when(F.array_contains(flags, f), p).otherwise(0.0) for f, p in (("no_production_signals", 0.03), ("irrelevant_current_role", 0.04), ("api_wrapper_only", 0.02), ("under_experienced", 0.03))), F.lit(0.0))
    on = gain(rel["must_count"], 5, 0.015, 0.10) + gain(tech["retrieval_count"], 3, 0.012, 0.08) + gain(prod["prod_signal_count"], 4, 0.01, 0.06)
    on = on + 0.05 * F.col("proof_of_work.pow_score") + gain(F.col("career_history_relevance.career_history_relevant_count"), 0, 0.015, 0.04)
    return clamp(F.col("legacy_score") + on - off)


def train(vectors: DataFrame, features: str = "features", label: str = "label", least_rows: int = 10, trees: int = 200, depth: int = 4, rate: float = 0.05, seed: int = 42, **options) -> boosting.Boosted:
    """Boosted trees with L1 and L2 penalties, rows and features sampled; see :mod:`boosting`."""
    if vectors.limit(least_rows).count() < least_rows:
        raise ValueError(f"at least {least_rows} rows are needed")
    return boosting.train(vectors, features, label, trees, depth, rate, seed=seed, **options)


def predict(model: boosting.Boosted | None, df: DataFrame, features: str = "features", out: str = "model_score") -> DataFrame:
    """Predictions bounded to 0..1; null without a model."""
    if model is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    ship(df.sparkSession)
    return df.withColumn(out, clamp(model.predict(F.col(features))))


def save(model: boosting.Boosted, path: str) -> None:
    model.save(SparkSession.active(), path)


def load(path: str) -> boosting.Boosted:
    return boosting.Boosted.load(SparkSession.active(), path)


def metrics(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """One row: n, mae, r2 = 1 - var(residual) / var(truth)."""
    return df.agg(
        F.count("*").alias("n"), F.avg(F.abs(truth - guess)).alias("mae"),
        (1 - F.try_divide(F.var_pop(truth - guess), F.var_pop(truth))).alias("r2"),
    )


def importances(model: boosting.Boosted, names=NAMES, k: int = 10) -> list[tuple[str, float]]:
    return sorted(zip(names, model.importances()), key=lambda x: (-x[1], x[0]))[:k]


def rule_score(legacy: Column, retrieval: Column, power: Column, behaviour: Column, contradiction: Column, credibility: Column) -> Column:
    return clamp((0.45 * legacy + 0.30 * clamp(retrieval) + 0.15 * power + 0.10 * behaviour) * contradiction * credibility)


def blend(rule: Column, model: Column, s: Settings = DEFAULT) -> Column:
    """The rule score, mixed with a model's where there is one."""
    return F.when(model.isNull(), rule).otherwise(round_exact(clamp(s.rule_share * rule + s.model_share * model), 4))
