"""Explanations: strengths, gaps and a short deterministic text, as column expressions.

The sentences are fixed values: which one is used follows from counts in the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import round_exact, whole
from .checks import kept


def say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def choose(seed: Column, options: Sequence[Column]) -> Column:
    """One of the options, by the seed modulo their number."""
    return F.element_at(F.array(*options), (F.pmod(seed, F.lit(len(options))) + 1).cast("int"))


def listed(words: Column, n: int) -> Column:
    return F.array_join(F.slice(words, 1, n), ", ")


def seed_of(must: Column, years: Column, stack: Column) -> Column:
    return must * 11 + F.floor(years * 7).cast("int") + stack * 13


def first_largest(parts: Sequence[tuple[str, Column]]) -> Column:
    """The name of the largest value; of equal ones the first."""
    top = F.greatest(*[v for _, v in parts])
    out = F.lit(None).cast("string")
    for name, value in reversed(parts):
        out = F.when(value == top, name).otherwise(out)
    return out


def _claim(test: Column, claim: Column, source: str) -> Column:
    return F.when(test, F.struct(claim.alias("claim"), F.lit(source).alias("source")))


def sanitise(text: Column) -> Column:
    """Encoding debris and doubled punctuation removed."""
    for pattern, by in (("Â|�|​", ""), (" ", " "), (r"  +", " "), (r"\s*[·•]\s*$", ""), (r"\.\.", "."), (r",\s*\.", ".")):
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def lead(signal: Column, must: Column, must_words: Column, years: Column, tier1: Column, made: Column, stack: Column, seed: Column) -> Column:
    """The opening sentence."""
    y, many, some, tools = whole(years), listed(must_words, 3), listed(must_words, 2), listed(stack, 3)
    n = F.size(stack)
    skills6 = choose(seed, [
        say("Well-matched on core JD requirements with skills in ", many, "."),
        say("The profile covers key areas the JD calls for, including ", many, "."),
        say("Directly relevant skill set spanning ", many, " and ", (must - 3).cast("string"), " other JD requirements."),
        say("Clear alignment on ", must.cast("string"), " JD requirements, notably ", many, "."),
    ])
    skills3 = choose(seed, [
        say("Covers several JD requirements including ", some, "."),
        say("The candidate's background touches on ", some, " and ", (must - 2).cast("string"), " other relevant areas."),
        say("Partial but meaningful skill overlap with the JD, particularly in ", some, "."),
    ])
    tech = choose(seed, [
        say("The technical profile is a strong match, with hands-on ", tools, " experience."),
        say("Brings direct experience in ", tools, ", closely aligned with what the role requires."),
        say("Technically well-positioned for this role, with evidence of ", tools, " usage."),
    ])
    big = choose(seed, [
        say("Comes from a tier-1 tech background with ", y, " years in the field."),
        say("Seasoned engineer with ", y, " years of experience, including time at a major tech company."),
        say("The candidate's ", y, "-year career includes high-caliber engineering environments."),
    ])
    ships = choose(seed, [
        say("Has a track record of production engineering work across ", y, " years."),
        say("The career history shows real production ownership over ", y, " years."),
        say("Brings ", y, " years of experience with clear production deployment signals."),
    ])
    plain = choose(seed, [say("Brings ", y, " years of relevant industry experience."), say("The candidate has ", y, " years in the field.")])
    old = choose(seed, [
        say("With ", y, " years in the industry, the candidate has substantial depth."),
        say("Brings ", y, " years of engineering experience to the table."),
        say("An experienced practitioner with ", y, " years of relevant work."),
    ])
    return (
        F.when((signal == "skills") & (must >= 6), skills6)
        .when((signal == "skills") & (must >= 3), skills3)
        .when((signal == "tech") & (n >= 3), tech)
        .when((signal == "career") & tier1, big)
        .when((signal == "career") & (made >= 3), ships)
        .when(signal == "career", plain)
        .when((signal == "experience") & (years >= 3), old)
        .when(must >= 1, say("The profile shows some alignment with the JD, particularly around ", F.coalesce(F.get(must_words, F.lit(0)), F.lit("relevant areas")), "."))
        .otherwise("The profile was evaluated against the JD requirements.")
    )


def support(signal: Column, seed: Column, facts: dict[str, Column]) -> Column:
    """One more fact that the opening doesn't use; "" if there is none."""
    f = facts
    found = kept(
        F.when((signal != "career") & (f["made"] >= 3), say("Career history includes clear production deployment evidence over ", whole(f["years"]), " years.")),
        F.when((signal != "career") & f["tier1"], "Background includes experience at a major tech company."),
        F.when((signal != "skills") & (f["must"] >= 5), say("Matches ", f["must"].cast("string"), " core JD skills including ", listed(f["must_words"], 2), ".")),
        F.when((signal != "tech") & (F.size(f["stack"]) >= 2), say("The technical stack includes ", listed(f["stack"], 2), ", which aligns with JD needs.")),
        F.when((f["power"] >= 0.4) & (f["summary"] != ""), say("Proof-of-work signals are present (", F.rtrim(F.trim(f["summary"]), F.lit(".")), ").")),
        F.when(f["roles"] >= 3, say("The career path shows ", f["roles"].cast("string"), " relevant engineering roles, indicating sustained focus.")),
        F.when(f["open"] & (f["notice"] <= 30), say("Currently open to opportunities with a ", f["notice"].cast("string"), "-day notice period.")),
    )
    return F.when(F.size(found) > 0, F.get(found, F.pmod(seed, F.greatest(F.size(found), F.lit(1))))).otherwise("")


def concern(seed: Column, gap: Column, must: Column) -> Column:
    """One limitation: the first gap, else a weak overall match, else ""."""
    told = say(F.lower(F.substring(gap, 1, 1)), F.substring(gap, 2, 1 << 20))
    of_gap = choose(seed, [say(x, told, ".") for x in ("That said, ", "One area to note: ", "The main concern is that ", "A limitation is that ", "However, ")])
    partial = choose(seed, [F.lit(x) for x in (
        "The overall fit with JD-specific requirements is partial.",
        "Several JD requirements are not directly evidenced in the profile.",
        "The match is present but less comprehensive than stronger candidates.",
    )])
    return F.when(gap.isNotNull(), of_gap).when(must < 4, partial).otherwise("")


def finished(*parts: Column) -> Column:
    """Parts joined, cleaned, with a capital and a full stop."""
    text = sanitise(F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " "))
    text = F.when((text != "") & ~text.endswith("."), say(text, ".")).otherwise(text)
    text = say(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 20))
    for a, b in (("..", "."), (". .", "."), (".,", ",")):
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(text == "", "Profile reviewed with limited matching signals.").otherwise(text)


def with_explanation(scored: DataFrame) -> DataFrame:
    """Rows with features and checks, plus an ``explanation`` struct.

    The contradiction record keeps its own warnings; those of the explanation
    add credibility notes, in an array of their own.
    """
    rel, prod, tech, beh = (F.col(c) for c in ("relevance", "production", "technical", "behavioral"))
    neg, hist, power, cred = F.col("negative"), F.col("career_history_relevance"), F.col("proof_of_work"), F.col("credibility")
    must, years, made, stack = rel["must_count"], prod["exp_years"], prod["prod_signal_count"], tech["retrieval_matched"]
    flag = {f: F.array_contains(neg["flags"], f) for f in ("no_production_signals", "irrelevant_current_role", "irrelevant_current_role_mild", "career_pivot_noted", "api_wrapper_only", "under_experienced")}
    quick = beh["open_to_work"] & (beh["notice_days"] <= 30)
    strengths = kept(
        _claim(must >= 6, say("Matches ", must.cast("string"), " must-have requirements (", listed(rel["must_matched"], 3), ")"), "skills + career text"),
        _claim((must >= 3) & (must < 6), say("Matches ", must.cast("string"), " must-have skills (", listed(rel["must_matched"], 2), ")"), "skills + career text"),
        _claim(prod["tier1"], say("Tier-1 tech company background, ", whole(years), " yrs experience"), "career_history companies"),
        _claim(~prod["tier1"] & (made >= 3), say("Production deployment evidence across ", whole(years), " years"), "career descriptions"),
        _claim(F.size(stack) >= 3, say("Relevant technical stack: ", listed(stack, 3)), "skills + career text"),
        _claim(power["pow_score"] >= 0.4, say("Proof-of-work evidence (", power["evidence_summary"], ")"), "career descriptions"),
        _claim(quick, say("Available within ", beh["notice_days"].cast("string"), " days"), "signals"),
        _claim(~quick & (beh["response_time_h"] <= 6), say("Responsive (", whole(beh["response_time_h"]), "h avg reply)"), "signals"),
        _claim(~quick & (beh["response_time_h"] > 6) & (beh["github"] >= 70), F.lit("Active GitHub contributor"), "signals"),
        _claim(~hist["is_career_pivot"] & (hist["career_history_relevant_count"] >= 3), say(hist["career_history_relevant_count"].cast("string"), " relevant prior engineering roles"), "career_history titles"),
        _claim(flag["career_pivot_noted"], say("Career pivot with ", neg["relevant_prior_count"].cast("string"), " prior relevant roles (", listed(neg["relevant_prior_titles"], 3), ")"), "career_history titles"),
    )
    refs = kept(
        F.when(must >= 3, "skill_relevance"), F.when(prod["tier1"], "career_history").when(made >= 3, "career_descriptions"),
        F.when(F.size(stack) >= 3, "technical_stack"), F.when(power["pow_score"] >= 0.4, "proof_of_work"), F.when(flag["career_pivot_noted"], "career_pivot"),
    )
    prior = F.coalesce(F.get(neg["relevant_prior_titles"], F.lit(0)), F.lit("an engineering role"))
    first = kept(
        _claim(flag["no_production_signals"], F.lit("No production deployment evidence found"), "career descriptions"),
        _claim(flag["irrelevant_current_role"], F.lit("Current role lacks engineering relevance"), "profile.current_title"),
        _claim(flag["irrelevant_current_role_mild"], say("Current role is non-technical (prior: ", prior, ")"), "profile.current_title + career_history"),
        _claim(flag["api_wrapper_only"], F.lit("Experience skews toward API integration over systems depth"), "career descriptions"),
        _claim(flag["under_experienced"], say("Experience (", whole(years), " yrs) below JD minimum"), "profile.years_of_experience"),
    )
    low = F.least(tech["score"], prod["score"], rel["score"])
    lowest = F.when(tech["score"] == low, "technical").when(prod["score"] == low, "production").otherwise("relevance")
    thin = F.when(lowest == "technical", "Limited retrieval/ranking technology evidence").when(lowest == "production", "Thin production-scale deployment evidence").otherwise("Several core JD requirements not clearly covered")
    weakest = kept(F.when((F.size(first) == 0) & (must < 5), F.struct(thin.alias("claim"), say(lowest, " score analysis").alias("source"))))
    signs = cred["signal_scores"]
    worries = kept(F.when(signs["timeline"] > 0.15, "timeline inconsistencies"), F.when(signs["stuffing"] > 0.15, "possible keyword inflation"), F.when(signs["description"] > 0.15, "low description quality"), F.when(signs["claim_gap"] > 0.15, "claim-evidence gaps"))
    doubted = (cred["credibility_penalty"] > 0.02) & (F.size(worries) > 0)
    doubt = kept(_claim(doubted, say("Credibility signals: ", F.array_join(worries, ", ")), "resume credibility checks"))
    notes = F.when(doubted, F.transform(F.slice(cred["reason_codes"], 1, 3), lambda c: say("Credibility: ", c))).otherwise(F.array().cast("array<string>"))
    told = F.col("contradictions.warnings")
    sure = F.least(F.lit(1.0), F.size(strengths) * 0.2 + 0.3)
    sure = sure * F.when(F.size(told) > 0, F.greatest(F.lit(0.7), 1.0 - F.size(told) * 0.05)).otherwise(1.0)
    sure = sure * F.when(doubted, F.greatest(F.lit(0.85), 1.0 - cred["credibility_penalty"])).otherwise(1.0)
    gaps = F.concat(first, weakest, doubt)
    out = scored.withColumns({"_strengths": strengths, "_gaps": gaps, "_sure": sure})

    depth = F.when(prod["tier1"], 1.0).when(made >= 3, 0.7).otherwise(0.3)
    signal = first_largest([("skills", must * 1.5), ("tech", F.size(stack) * 2.0), ("career", depth * 5), ("experience", F.greatest(F.lit(0.0), F.least(F.lit(1.0), years / 10)) * 4)])
    out = out.withColumns({"_signal": signal, "_seed": seed_of(must, years, F.size(stack))})
    s, seed = F.col("_signal"), F.col("_seed")
    facts = {"made": made, "years": years, "tier1": prod["tier1"], "must": must, "must_words": rel["must_matched"], "stack": stack, "power": power["pow_score"], "summary": power["evidence_summary"], "roles": hist["career_history_relevant_count"], "open": beh["open_to_work"], "notice": beh["notice_days"]}
    text = finished(lead(s, must, rel["must_matched"], years, prod["tier1"], made, stack, seed), support(s, seed, facts), concern(seed, F.get(F.col("_gaps"), F.lit(0))["claim"], must))
    made_of = F.struct(
        text.alias("reasoning_text"), F.col("_strengths").alias("strengths"), F.col("_gaps").alias("gaps"), F.concat(told, notes).alias("warnings"),
        refs.alias("evidence_refs"), round_exact(F.col("_sure"), 3).alias("confidence"),
    )
    return out.withColumn("explanation", made_of).drop("_strengths", "_gaps", "_sure", "_signal", "_seed")


def short_reasoning() -> Column:
    """The older one-line form: two drivers, one availability fact, one gap."""
    rel, prod, tech, beh, flags = F.col("relevance"), F.col("production"), F.col("technical"), F.col("behavioral"), F.col("negative.flags")
    parts = [("relevance", rel["score"], 0), ("production", prod["score"], 1), ("technical", tech["score"], 2)]
    order = F.transform(F.array_sort(F.array(*[F.struct((-v).alias("neg"), F.lit(k).alias("k"), F.lit(n).alias("n")) for n, v, k in parts])), lambda x: x["n"])
    best, second, last = (F.element_at(order, k) for k in (1, 2, 3))
    years, must, tools = prod["exp_years"].cast("string"), rel["must_count"].cast("string"), listed(tech["retrieval_matched"], 2)
    one = (
        F.when((best == "relevance") & (rel["must_count"] >= 4), say("Strong JD match (", must, " must-haves including ", listed(rel["must_matched"], 2), ")"))
        .when(best == "relevance", say("Partial JD match (", must, " must-haves)"))
        .when((best == "production") & prod["tier1"], say("Deep production ML experience (", years, " yrs) with Tier-1 tech background"))
        .when((best == "production") & (prod["prod_signal_count"] >= 3), say("Proven history of shipping ML systems (", years, " yrs exp)"))
        .when(best == "production", say("Solid ML experience (", years, " yrs)"))
        .when(tools != "", say("Deep retrieval/ranking stack expertise (", tools, ")"))
        .otherwise("Strong technical evaluation skills")
    )
    two = F.when(second == "production", say("shipped ML systems (", years, " yrs exp)")).when((second == "technical") & (tools != ""), say("solid retrieval stack (", tools, ")")).when(second == "relevance", say("matched ", must, " key skills"))
    three = (
        F.when(beh["open_to_work"] & (beh["notice_days"] <= 30), say("Available fast (", beh["notice_days"].cast("string"), "d notice)"))
        .when(beh["response_time_h"] <= 6, say("Highly responsive (", beh["response_time_h"].cast("string"), "h avg)"))
        .when(beh["github"] >= 80, "High GitHub activity")
    )
    has = lambda f: F.array_contains(flags, f)
    four = (
        F.when(has("no_production_signals"), "Gap: missing production/deployment signals")
        .when(has("irrelevant_current_role"), "Gap: current role lacks engineering relevance")
        .when(has("api_wrapper_only"), "Gap: primarily API wrapper experience, missing systems depth")
        .when(has("under_experienced"), "Gap: below minimum experience requirement")
        .when(F.size(flags) > 0, F.lit(None))
        .when(last == "technical", "Gap: limited specific retrieval/ranking tech stack")
        .when(last == "production", "Gap: lighter on production scale evidence")
        .otherwise("Gap: missing several JD must-have skills")
    )
    text = F.array_join(kept(one, two, three, four), " · ")
    text = say(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 20))
    return F.when(text.endswith("."), text).otherwise(say(text, "."))
