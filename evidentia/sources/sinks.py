"""Exports of a ranking, and reading the last one back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_submission(ranking: DataFrame, path: str, k: int = 100) -> None:
    """candidate_id, rank, score, reasoning: one quoted CSV of at most ``k`` rows."""
    rows = ranking.orderBy("rank").limit(k).select("candidate_id", "rank", F.col("final_score").alias("score"), F.col("explanation.reasoning_text").alias("reasoning"))
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def problems(ranking: DataFrame, k: int = 100, score: str = "final_score") -> list[str]:
    """What is wrong with a ranking of at most ``k`` rows: ids twice or missing, ranks that
    aren't 1 to n, scores out of 0..1 or out of order."""
    rows = ranking.select("candidate_id", "rank", score).orderBy("rank").limit(k + 1).collect()
    ids, scores = [r.candidate_id for r in rows], [r[score] for r in rows]
    found = {
        f"more than {k} rows": len(rows) > k,
        "a row without an id": not all(ids),
        "an id that occurs twice": len(set(ids)) < len(ids),
        "ranks that aren't 1 to n": [r.rank for r in rows] != list(range(1, len(rows) + 1)),
        "a score outside 0 to 1": not all(x is not None and 0 <= x <= 1 for x in scores),
        "scores that rise": any(a is not None and b is not None and a < b for a, b in zip(scores, scores[1:])),
    }
    return [text for text, wrong in found.items() if wrong]


def write_scan(ranking: DataFrame, path: str) -> None:
    """The scan's result in the same form."""
    rows = ranking.orderBy("rank").select("candidate_id", "rank", F.col("legacy_score").alias("score"), "reasoning")
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def detailed(ranking: DataFrame, people: DataFrame) -> DataFrame:
    """Ranking rows with the profile's details, one projection for files and services."""
    p = people.select(
        "candidate_id", F.col("location"), F.col("country"), F.col("current_company").alias("company"),
        F.concat(F.format_string("%.1f", "years"), F.lit(" yrs")).alias("experience"),
        F.array_join(F.transform("education", lambda e: F.concat_ws(", ", F.filter(F.array(e["degree"], e["field_of_study"], e["institution"]), lambda x: x != ""))), "; ").alias("education"),
        F.transform("skills", lambda s: s["name"]).alias("skills"),
        F.transform("career", lambda e: F.struct(e["title"].alias("title"), e["company"].alias("company"), e["start_date"].alias("start"), e["end_date"].alias("end"), e["description"].alias("description"))).alias("careerHistory"),
        F.to_json("signals").alias("signals"),
    )
    return ranking.join(p, "candidate_id", "left")


def write_detailed(ranking: DataFrame, people: DataFrame, path: str) -> None:
    detailed(ranking, people).orderBy("rank").coalesce(1).write.mode("overwrite").json(path)


def read_last(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The last export and one row about it: result_count and top_score."""
    rows = spark.read.json(path)
    return rows, rows.agg(F.count("*").alias("result_count"), F.max("final_score").alias("top_score"))
