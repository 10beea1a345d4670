"""Sub-scores of a profile, all as column expressions over one row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULT, Settings
from ..functions.numeric import between, clamp, or_default, parse_date, round_exact
from ..functions.text import any_of, matched



@dataclass(frozen=True)
class Lists:
    """The must-have and nice-to-have lists a query scores against."""

    must: Sequence[str]
    nice: Sequence[str]


def staged(lists: Lists, s: Settings = DEFAULT) -> dict[str, Column]:
    """What the sub-scores share, as plain columns.

    A plain column that is used more than once is computed once; fields of a struct
    would be written out again wherever they are used.
    """
    k, title = s.keywords, F.col("title_lower")
    names = F.transform("career", lambda e: F.lower(e["company"]))
    distinct = F.size(F.array_distinct(F.transform(names, lambda c: F.trim(c))))
    blank = F.when(F.forall(names, lambda c: c != ""), 0).otherwise(1)
    off = any_of(title, k.irrelevant_titles)
    prior = _career_titles(F.filter("career", lambda e: ~e["is_current"]), s)
    return {
        "_must": matched(F.col("full_text"), lists.must), "_nice": matched(F.col("full_text"), lists.nice),
        "_fits": any_of(title, k.relevant_titles), "_off": off, "_made": F.size(matched(F.col("career_text"), k.production)),
        "_tier1": F.exists(names, lambda c: any_of(c, k.tier1)), "_tier2": F.exists(names, lambda c: any_of(c, k.tier2)),
        "_companies": F.when(F.size("career") == 0, 0).otherwise(distinct - blank),
        "_ret": matched(F.col("full_text"), k.retrieval), "_ev": matched(F.col("full_text"), k.evaluation), "_py": matched(F.col("full_text"), k.python),
        "_prior": F.when(off, prior).otherwise(F.array().cast("array<string>")), "_titles": _career_titles(F.col("career"), s),
        "_wrapper": any_of(F.col("full_text"), k.wrapper) & ~any_of(F.col("full_text"), k.systems),
    }


def relevance() -> Column:
    must, nice, fits = F.col("_must"), F.col("_nice"), F.col("_fits") & ~F.col("_off")
    raw = clamp(0.12 * F.size(must)) + F.least(F.lit(0.20), 0.04 * F.size(nice)) + F.when(fits, 0.08).otherwise(0.0)
    return F.struct(
        clamp(raw).alias("score"), F.size(must).alias("must_count"), F.slice(must, 1, 6).alias("must_matched"),
        F.size(nice).alias("nice_count"), F.slice(nice, 1, 4).alias("nice_matched"), fits.alias("title_relevant"),
    )


def production() -> Column:
    n, tier1, tier2, companies = (F.col(c) for c in ("_made", "_tier1", "_tier2", "_companies"))
    raw = 0.45 * clamp(n / 6.0) + 0.35 * clamp(F.col("years") / 7.0) + F.when(tier1, 0.15).when(tier2, 0.08).otherwise(0.0)
    raw = raw + clamp(0.04 * (companies - 1), 0.0, 0.08)
    return F.struct(clamp(raw).alias("score"), n.alias("prod_signal_count"), F.col("years").alias("exp_years"), tier1.alias("tier1"), (tier2 & ~tier1).alias("tier2"), companies.alias("companies"))


def technical() -> Column:
    ret, ev, py = F.col("_ret"), F.col("_ev"), F.col("_py")
    raw = F.least(F.lit(0.60), 0.10 * F.size(ret)) + F.least(F.lit(0.25), 0.10 * F.size(ev)) + F.least(F.lit(0.20), 0.05 * F.size(py))
    return F.struct(
        clamp(raw).alias("score"), F.size(ret).alias("retrieval_count"), F.slice(ret, 1, 5).alias("retrieval_matched"),
        F.size(ev).alias("eval_count"), F.slice(ev, 1, 3).alias("eval_matched"), F.size(py).alias("python_count"), F.slice(py, 1, 3).alias("python_matched"),
    )


def recency(last_active: Column, as_of: Column) -> Column:
    """1 up to 7 days, 0 from 90 on; 0.3 where the date is unknown."""
    return F.coalesce(between(F.datediff(as_of, last_active), 7.0, 90.0), F.lit(0.3))


def behavioral_score(open_to_work: Column, recent: Column, rate: Column, hours: Column, notice: Column, github: Column, interview: Column) -> Column:
    """Weights and bands of the seven signals; rates are percentages."""
    slow = F.greatest(F.lit(0.40), between(notice, 30.0, 90.0))
    return clamp(
        0.20 * F.when(open_to_work, 1.0).otherwise(0.5)
        + 0.20 * recent
        + 0.15 * between(rate, 90.0, 40.0)
        + 0.20 * between(hours, 2.0, 24.0)
        + 0.10 * slow
        + 0.10 * between(github, 80.0, 20.0)
        + 0.05 * between(interview, 95.0, 50.0)
    )


def behavioral(as_of: str, s: Settings = DEFAULT) -> Column:
    """Zero counts as unknown, as null does; -1 is "no account" for code activity."""
    g = F.col("signals")
    is_open = F.coalesce(g["open_to_work_flag"], F.lit(False))
    recent = recency(parse_date(g["last_active_date"]), F.to_date(F.lit(as_of)))
    rate = 100 * or_default(g["recruiter_response_rate"], 0.5)
    hours, notice = or_default(g["avg_response_time_hours"], 12), or_default(g["notice_period_days"], 60)
    github = F.when(g["github_activity_score"] == -1, 20.0).otherwise(or_default(g["github_activity_score"], 40))
    interview = 100 * or_default(g["interview_completion_rate"], 0.8)
    return F.struct(
        behavioral_score(is_open, recent, rate, hours, notice, github, interview).alias("score"), is_open.alias("open_to_work"), recent.alias("recency_score"),
        rate.alias("response_rate"), hours.alias("response_time_h"), notice.cast("int").alias("notice_days"), github.alias("github"), interview.alias("interview_rate"),
    )


def _career_titles(jobs: Column, s: Settings) -> Column:
    return F.transform(F.filter(jobs, lambda e: any_of(F.lower(e["title"]), s.keywords.career_titles)), lambda e: e["title"])


def negative_multiplier(no_production: Column, irrelevant: Column, prior: Column, wrapper: Column, years: Column, s: Settings = DEFAULT) -> Column:
    factor = F.when(no_production, s.no_production).otherwise(1.0)
    factor = factor * F.when(irrelevant & (prior == 1), s.irrelevant_mild).when(irrelevant & (prior == 0), s.irrelevant_full).otherwise(1.0)
    factor = factor * F.when(wrapper, s.wrapper_only).otherwise(1.0) * F.when(years < 2.0, s.under_experienced).otherwise(1.0)
    return F.greatest(factor, F.lit(s.negative_floor))


def negative(s: Settings = DEFAULT) -> Column:
    none, irrelevant, titles, wrapper = F.col("_made") == 0, F.col("_off"), F.col("_prior"), F.col("_wrapper")
    n = F.size(titles)
    flag = F.when(n >= 2, "career_pivot_noted").when(n == 1, "irrelevant_current_role_mild").otherwise("irrelevant_current_role")
    flags = F.array(
        F.when(none, "no_production_signals"), F.when(irrelevant, flag),
        F.when(wrapper, "api_wrapper_only"), F.when(F.col("years") < 2.0, "under_experienced"),
    )
    factor = negative_multiplier(none, irrelevant, n, wrapper, F.col("years"), s)
    return F.struct(
        round_exact(factor, 4).alias("multiplier"), F.filter(flags, lambda x: x.isNotNull()).alias("flags"),
        n.alias("relevant_prior_count"), titles.alias("relevant_prior_titles"),
    )


def career_history() -> Column:
    off, titles = F.col("_off"), F.col("_titles")
    now, n = F.col("_fits") & ~off, F.size(titles)
    blended = 0.40 * F.when(now, 1.0).otherwise(0.0) + 0.60 * F.when(n >= 2, 1.0).when(n == 1, 0.6).otherwise(0.0)
    return F.struct(
        round_exact(clamp(blended), 4).alias("score"), now.alias("current_title_relevant"), n.alias("career_history_relevant_count"),
        F.slice(titles, 1, 5).alias("career_history_relevant_titles"), (off & (n >= 2)).alias("is_career_pivot"), F.size("career").alias("total_roles"),
    )


def weighted_score(rel: Column, prod: Column, tech: Column, beh: Column, career: Column, factor: Column, s: Settings = DEFAULT) -> Column:
    raw = s.relevance * rel + s.production * prod + s.technical * tech + s.behavioral * beh + s.career_bonus * career
    return clamp(raw * factor)


def with_features(people: DataFrame, lists: Lists, as_of: str, s: Settings = DEFAULT) -> DataFrame:
    """Profiles with the struct columns relevance, production, technical, behavioral,
    negative, career_history_relevance, and legacy_score."""
    first = staged(lists, s)
    out = people.withColumns(first).withColumns(
        {"relevance": relevance(), "production": production(), "technical": technical(), "behavioral": behavioral(as_of, s), "negative": negative(s), "career_history_relevance": career_history()}
    ).drop(*first)
    score = weighted_score(F.col("relevance.score"), F.col("production.score"), F.col("technical.score"), F.col("behavioral.score"), F.col("career_history_relevance.score"), F.col("negative.multiplier"), s)
    return out.withColumn("legacy_score", round_exact(score, 4))
