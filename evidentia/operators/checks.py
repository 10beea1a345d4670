"""Evidence of work done, contradictions, and credibility of a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULT, Settings
from ..functions.numeric import fixed, parse_date, round_exact, whole
from ..functions.text import any_of, jaccard, tokens

SENIOR = ("senior", "lead", "principal", "staff", "director", "head of")


def kept(*items: Column) -> Column:
    """The items that aren't null, in order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def evidence_level(n: Column) -> Column:
    """0 hits: 0; up to 2: 0.2 each; up to 5: towards 0.8; then towards 1 at 10."""
    return (
        F.when(n == 0, 0.0)
        .when(n <= 2, 0.4 * n / 2)
        .when(n <= 5, 0.4 + 0.4 * (n - 2) / 3)
        .otherwise(0.8 + 0.2 * F.least(F.lit(1.0), (n - 5) / 5))
    )


def proof_of_work(s: Settings = DEFAULT) -> Column:
    hits = {c: F.col(f"_hits_{c}") for c in s.evidence}
    total = F.lit(0.0)
    for c, (_, weight) in s.evidence.items():
        total = total + F.least(F.lit(1.0), evidence_level(F.size(hits[c]))) * weight
    names = {"shipping": "shipped", "scale": "scale", "retrieval_infra": "retrieval infra", "evaluation": "eval rigor"}
    parts = kept(*[F.when(F.size(hits[c]) > 0, F.concat(F.lit(f"{n} ("), F.size(hits[c]).cast("string"), F.lit(" signals)"))) for c, n in names.items() if c in hits])
    summary = F.when(F.size(parts) > 0, F.array_join(parts, " · ")).otherwise("no concrete production evidence found")
    count = sum((F.size(h) for h in hits.values()), F.lit(0))
    return F.struct(
        round_exact(F.least(F.lit(1.0), total), 4).alias("pow_score"),
        F.struct(*[round_exact(evidence_level(F.size(h)), 3).alias(c) for c, h in hits.items()]).alias("category_scores"),
        F.struct(*[F.slice(h, 1, 5).alias(c) for c, h in hits.items()]).alias("evidence_hits"),
        summary.alias("evidence_summary"),
        count.alias("total_evidence_count"),
    )


def matched_in_either(terms: tuple[str, ...]) -> Column:
    """Terms in the job descriptions or in the whole text."""
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.col("career_text"), t) | F.contains(F.col("full_text"), t))


def contradictions(s: Settings = DEFAULT) -> Column:
    title, rel, fits, off = F.col("title_lower"), F.col("relevance"), F.col("_fits"), F.col("_off")
    power = F.col("proof_of_work.pow_score")
    weak = fits & (power < 0.15)
    now = F.col("_now")
    shallow = ~off & (rel["score"] > 0.7) & now.isNotNull() & ~any_of(now, ("ml", "machine learning", "ai", "model", "retrieval")) & ~F.contains(title, F.lit("engineer"))
    claimed, absent, career = F.col("_claimed"), F.col("_absent"), F.col("_career_years")
    ratio = F.when((F.col("years") > 0) & (career > 0), career / F.col("years"))
    few = (rel["score"] > 0.6) & (rel["must_count"] < 3)
    young = F.contains(title, F.lit("senior")) & (F.col("years") < 3.0)
    own, total = fixed(F.col("years"), 1), fixed(career, 1)
    warnings = F.concat(
        kept(
            F.when(weak, F.concat(F.lit("Title '"), F.col("current_title"), F.lit("' suggests engineering role but proof-of-work score is very low ("), fixed(power, 2), F.lit(")."))),
            F.when(shallow, "High skill relevance but current role description lacks ML/AI content."),
        ),
        F.transform(absent, lambda m: F.concat(F.lit("Skill '"), m, F.lit("' listed but not found in career descriptions or summary."))),
        kept(
            F.when(ratio < 0.5, F.concat(F.lit("Claimed "), own, F.lit(" yrs but career history totals ~"), total, F.lit(" yrs (significant gap).")))
            .when(ratio > 2.0, F.concat(F.lit("Career history ("), total, F.lit(" yrs) significantly exceeds claimed experience ("), own, F.lit(" yrs)."))),
            F.when(few, F.concat(F.lit("Relevance score is high ("), fixed(rel["score"], 2), F.lit(") but only "), rel["must_count"].cast("string"), F.lit(" must-have skill matches found."))),
            F.when(young, F.concat(F.lit("Title says 'Senior' but only "), own, F.lit(" years of experience."))),
        ),
    )
    factor = F.when(weak, 0.95).otherwise(1.0) * F.when(shallow, 0.97).otherwise(1.0)
    factor = factor * F.aggregate(absent, F.lit(1.0), lambda acc, _: acc * 0.99) * F.when(ratio < 0.5, 0.96).otherwise(1.0)
    factor = factor * F.when(few, 0.97).otherwise(1.0) * F.when(young, 0.95).otherwise(1.0)
    return F.struct(
        round_exact(F.greatest(factor, F.lit(s.contradiction_floor)), 4).alias("penalty"), warnings.alias("warnings"), F.size(warnings).alias("warning_count"),
        F.struct(fits.alias("title_relevant"), off.alias("title_irrelevant"), F.size(claimed).alias("claimed_must_haves_in_skills"),
                 round_exact(career / F.greatest(F.col("years"), F.lit(0.1)), 2).alias("career_vs_claimed_ratio")).alias("details"),
    )


def overlap_points(n: Column) -> Column:
    return F.when(n >= 2, 0.4).when(n == 1, 0.15).otherwise(0.0)


def gap_points(months: Column) -> Column:
    return F.when(months > 36, 0.25).when(months > 24, 0.10).otherwise(0.0)


def _points(*parts: tuple[Column, float, Column]) -> tuple[Column, Column]:
    """(sum of points, reasons) of (test, points, reason)."""
    total = F.lit(0.0)
    for test, points, _ in parts:
        total = total + F.when(test, points).otherwise(0.0)
    return F.least(F.lit(1.0), total), kept(*[F.when(test, reason) for test, _, reason in parts])


def _code(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def staged(s: Settings = DEFAULT) -> list[dict[str, Column]]:
    """What the checks share, as plain columns in three steps; each is computed once."""
    k, career = s.keywords, F.col("career")
    dated = F.transform(career, lambda e, i: F.struct(parse_date(e["start_date"]).alias("start"), i.alias("i"), F.when(~e["is_current"], parse_date(e["end_date"])).alias("end")))
    claimed = F.filter(F.array(*[F.lit(m) for m in k.must]), lambda m: F.array_contains("skill_names", m))
    one = {f"_hits_{c}": matched_in_either(terms) for c, (terms, _) in s.evidence.items()}
    one |= {
        "_fits": any_of(F.col("title_lower"), k.relevant_titles), "_off": any_of(F.col("title_lower"), k.irrelevant_titles),
        "_senior": any_of(F.col("title_lower"), SENIOR), "_claimed": claimed,
        "_now": F.lower(F.get(F.transform(F.filter("career", lambda e: e["is_current"]), lambda e: e["description"]), F.lit(0))),
        "_career_years": F.aggregate("career", F.lit(0), lambda acc, e: acc + e["duration_months"]) / 12.0,
        "_dated": F.array_sort(F.filter(dated, lambda e: e["start"].isNotNull())),
        "_short": F.size(F.filter(career, lambda e: (e["duration_months"] > 0) & (e["duration_months"] < 2) & ~e["is_current"])),
        "_bare": F.size(F.filter("skills", lambda x: (x["endorsements"] == 0) & ~F.contains(F.col("career_text"), F.lower(x["name"])))),
        "_words": F.aggregate("career", F.lit(0), lambda acc, e: acc + F.size(tokens(e["description"]))),
        "_texts": F.filter(F.transform("career", lambda e: e["description"]), lambda t: F.trim(t) != ""),
        "_thin": F.size(F.filter("career", lambda e: (e["description"] != "") & (e["duration_months"] > 12) & (F.size(tokens(e["description"])) < 15))),
        "_told": F.size(F.filter("career", lambda e: F.length(F.trim(e["description"])) > 30)),
    }
    two = {
        "_absent": F.filter(F.slice("_claimed", 1, 5), lambda m: ~F.contains(F.col("career_text"), m) & ~F.contains(F.lower("summary"), m)),
        "_days": F.filter(
            F.transform(F.slice("_dated", 1, F.greatest(F.size("_dated") - 1, F.lit(0))), lambda e, i: F.datediff(F.get(F.col("_dated"), i + 1)["start"], e["end"])),
            lambda d: d.isNotNull(),
        ),
        "_sets": F.transform("_texts", lambda t: F.array_distinct(tokens(t))),
        "_firsts": F.transform(F.filter(F.transform("_texts", tokens), lambda w: F.size(w) >= 3), lambda w: F.array_join(F.slice(w, 1, 3), " ")),
    }
    three = {
        "_overlaps": F.size(F.filter("_days", lambda d: d < -90)), "_gap": F.coalesce(F.array_max("_days"), F.lit(0)) / 30.0,
        "_pairs": alike_sets(F.col("_sets")), "_most": commonest(F.col("_firsts")),
    }
    return [one, two, three]


def timeline() -> tuple[Column, Column]:
    """Overlaps of consecutive roles, very short tenures, long gaps."""
    overlaps, short, gap = F.col("_overlaps"), F.col("_short"), F.col("_gap")
    enough = (F.size("career") >= 2) & (F.size("_dated") >= 2)
    points, reasons = _points(
        (overlaps >= 2, 0.4, _code("timeline_overlap_", overlaps, "_roles")),
        (overlaps == 1, 0.15, _code("timeline_overlap_1_role")),
        (short >= 3, 0.3, _code("very_short_tenure_", short, "_roles")),
        (short == 2, 0.15, _code("very_short_tenure_", short, "_roles")),
        (gap > 36, 0.25, _code("career_gap_", F.floor(gap), "_months")),
        ((gap > 24) & (gap <= 36), 0.10, _code("career_gap_", F.floor(gap), "_months")),
    )
    none = F.array().cast("array<string>")
    return F.when(enough, points).otherwise(0.0), F.when(enough, reasons).otherwise(none)


def stuffing() -> tuple[Column, Column]:
    n, bare, words = F.size("skills"), F.col("_bare"), F.col("_words")
    share = bare / F.greatest(n, F.lit(1))
    hits = F.col("relevance.must_count") + F.col("relevance.nice_count")
    density = F.try_divide(hits, words / 100.0)
    most, many = (share > 0.6) & (bare > 5), (share > 0.4) & (bare > 4)
    return _points(
        (n > 30, 0.35, _code("excessive_skills_", n)),
        ((n > 22) & (n <= 30), 0.15, _code("high_skill_count_", n)),
        (most, 0.25, _code("unsupported_skills_", bare, "_of_", n)),
        (many & ~most, 0.10, _code("partially_unsupported_skills_", bare)),
        ((words > 0) & (density > 8.0) & (hits > 10), 0.20, _code("high_buzzword_density_", fixed(density, 1))),
    )


def alike_sets(sets: Column, above: float = 0.85) -> Column:
    """How many pairs of an array's token sets are alike, inside the row."""
    return F.aggregate(
        F.transform(sets, lambda a, i: F.size(F.filter(F.transform(sets, lambda b, j: (j > i) & (jaccard(a, b) > above)), lambda x: x))),
        F.lit(0), lambda acc, x: acc + x,
    )


def commonest(items: Column) -> Column:
    """How often the commonest item of an array occurs; 0 for an empty one."""
    counts = F.transform(F.array_distinct(items), lambda x: F.size(F.filter(items, lambda y: y == x)))
    return F.coalesce(F.array_max(counts), F.lit(0))


def descriptions() -> tuple[Column, Column]:
    n, pairs, thin, most = F.size("_texts"), F.col("_pairs"), F.col("_thin"), F.col("_most")
    uniform = (n >= 3) & (most >= 3) & (F.try_divide(most, F.size("_firsts")) > 0.6)
    points, reasons = _points(
        (pairs >= 2, 0.45, _code("duplicate_descriptions_", pairs, "_pairs")),
        (pairs == 1, 0.20, _code("near_duplicate_description_1_pair")),
        (thin >= 2, 0.15, _code("thin_descriptions_", thin, "_roles")),
        (F.coalesce(uniform, F.lit(False)), 0.15, _code("uniform_description_openings")),
    )
    enough, none = (F.size("career") >= 2) & (n >= 2), F.array().cast("array<string>")
    return F.when(enough, points).otherwise(0.0), F.when(enough, reasons).otherwise(none)


def claim_gaps() -> tuple[Column, Column]:
    years, must, made = F.col("years"), F.col("relevance.must_count"), F.col("production.prod_signal_count")
    senior, skills, jobs = F.col("_senior"), F.size("skills"), F.size("career")
    return _points(
        (senior & (years < 2.0), 0.30, _code("senior_title_low_exp_", fixed(years, 1), "yr")),
        (senior & (years >= 2.0) & (years < 3.0), 0.10, _code("senior_title_moderate_exp_", fixed(years, 1), "yr")),
        ((must >= 6) & (made == 0), 0.25, _code("high_skill_match_", must, "_no_production")),
        ((must >= 4) & (must < 6) & (made == 0), 0.10, _code("skill_match_", must, "_no_production")),
        ((skills > 10) & (jobs == 0), 0.30, _code("skills_", skills, "_no_career_history")),
        ((years > 8.0) & (jobs <= 1), 0.15, _code("exp_", whole(years), "yr_only_", jobs, "_role")),
    )


def credibility_penalty(timeline_: Column, stuffing_: Column, description_: Column, claim_: Column, s: Settings = DEFAULT) -> Column:
    return F.least(F.lit(s.most_credibility_penalty), 0.30 * timeline_ + 0.25 * stuffing_ + 0.20 * description_ + 0.25 * claim_)


def credibility(s: Settings = DEFAULT) -> tuple[dict[str, Column], Column]:
    """Plain columns of points and reasons, and the struct made of them."""
    parts = {"timeline": timeline(), "stuffing": stuffing(), "description": descriptions(), "claim_gap": claim_gaps()}
    points = {f"_points_{n}": p for n, (p, _) in parts.items()} | {f"_reasons_{n}": r for n, (_, r) in parts.items()}
    jobs, told = F.size("career"), F.col("_told")
    sure = 0.5 + F.when(jobs >= 3, 0.3).when(jobs == 2, 0.15).otherwise(0.0) + F.when(told >= 2, 0.15).when(told == 1, 0.05).otherwise(0.0) + F.when(F.size("skills") >= 3, 0.05).otherwise(0.0)
    penalty = round_exact(credibility_penalty(*[F.col(f"_points_{n}") for n in parts], s), 4)
    return points, F.struct(
        penalty.alias("credibility_penalty"), round_exact(1 - penalty, 4).alias("credibility_multiplier"),
        F.struct(*[round_exact(F.col(f"_points_{n}"), 4).alias(n) for n in parts]).alias("signal_scores"),
        F.concat(*[F.col(f"_reasons_{n}") for n in parts]).alias("reason_codes"), round_exact(F.least(F.lit(1.0), sure), 3).alias("confidence"),
    )


def with_checks(scored: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Profiles with features, plus proof_of_work, contradictions and credibility."""
    out, steps = scored, staged(s)
    for step in steps:
        out = out.withColumns(step)
    points, struct = credibility(s)
    out = out.withColumns({"proof_of_work": proof_of_work(s)} | points)
    return out.withColumns({"contradictions": contradictions(s), "credibility": struct}).drop(*points, *[c for step in steps for c in step])
