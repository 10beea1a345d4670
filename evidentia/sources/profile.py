"""From raw records to profiles and weighted evidence chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import joined, pack_chunks


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def profiles(raw: DataFrame) -> DataFrame:
    """Typed profiles: every null has its default, lists are never null, and the
    searchable texts are computed once.

    ``full_text`` joins all fields, so keywords may match across their borders.
    """
    skills = F.transform(
        F.coalesce("skills", F.array().cast(dict_type(raw, "skills"))),
        lambda s: F.struct(
            F.coalesce(s["name"], F.lit("")).alias("name"),
            F.coalesce(s["proficiency"], F.lit("")).alias("proficiency"),
            F.coalesce(s["endorsements"], F.lit(0.0)).cast("int").alias("endorsements"),
            F.coalesce(s["duration_months"], F.lit(0.0)).cast("int").alias("duration_months"),
        ),
    )
    career = F.transform(
        F.coalesce("career_history", F.array().cast(dict_type(raw, "career_history"))),
        lambda e: F.struct(
            *[F.coalesce(e[c], F.lit("")).alias(c) for c in ("company", "title")],
            F.coalesce(e["start_date"], F.lit("")).alias("start_date"),
            e["end_date"].alias("end_date"),
            F.coalesce(e["duration_months"], F.lit(0.0)).cast("int").alias("duration_months"),
            F.coalesce(e["is_current"], F.lit(False)).alias("is_current"),
            *[F.coalesce(e[c], F.lit("")).alias(c) for c in ("industry", "company_size", "description")],
        ),
    )
    education = F.transform(
        F.coalesce("education", F.array().cast(dict_type(raw, "education"))),
        lambda e: F.struct(*[F.coalesce(e[c], F.lit("")).alias(c) for c in ("degree", "field_of_study", "institution")]),
    )
    out = raw.select(
        "candidate_id",
        *[F.coalesce(F.col(f"profile.{a}"), F.lit("")).alias(b) for a, b in (("anonymized_name", "name"), ("headline", "headline"), ("summary", "summary"), ("location", "location"), ("country", "country"), ("current_title", "current_title"), ("current_company", "current_company"), ("current_company_size", "current_company_size"), ("current_industry", "current_industry"))],
        F.coalesce(F.col("profile.years_of_experience"), F.lit(0.0)).alias("years"),
        skills.alias("skills"),
        career.alias("career"),
        education.alias("education"),
        F.col("certifications"),
        F.col("signals"),
    )
    fields = F.concat(
        F.array(_text("summary"), _text("headline"), _text("current_title")),
        F.transform("skills", lambda s: s["name"]),
        F.flatten(F.transform("career", lambda e: F.array(e["description"], e["title"], e["company"], e["industry"]))),
        F.flatten(F.transform("education", lambda e: F.array(e["field_of_study"], e["degree"]))),
    )
    return out.withColumns(
        {
            "full_text": F.lower(joined(fields)),
            "career_text": F.lower(F.array_join(F.transform("career", lambda e: e["description"]), " ")),
            "skill_names": F.transform("skills", lambda s: F.lower(s["name"])),
            "title_lower": F.lower("current_title"),
        }
    )


def dict_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def evidence_chunks(people: DataFrame) -> DataFrame:
    """(cid, ordinal, section, text, weight, is_title, is_skill, doc): the summary,
    the headline, each job, the skills and each education, with their weights."""

    def chunk(section: Column, text: Column, weight: Column, title: bool = False, skill: bool = False) -> Column:
        return F.struct(section.alias("section"), text.alias("text"), weight.cast("double").alias("weight"), F.lit(title).alias("is_title"), F.lit(skill).alias("is_skill"))

    def when(test: Column, c: Column) -> Column:
        return F.array(F.when(test, c))

    jobs = F.transform(
        "career",
        lambda e, i: chunk(
            F.when(e["company"] != "", F.concat(F.lit("Career @ "), e["company"])).otherwise(F.concat(F.lit("Career #"), (i + 1).cast("string"))),
            joined(F.array(e["title"], e["company"], e["description"]), " | "),
            F.when(e["is_current"], 1.5).otherwise(F.greatest(F.lit(0.6), 1.2 - 0.15 * i)),
            title=True,
        ),
    )
    names = joined(F.transform("skills", lambda s: s["name"]), ", ")
    schools = F.transform("education", lambda e: chunk(F.lit("Education"), F.concat(e["degree"], F.lit(" in "), e["field_of_study"], F.lit(" from "), e["institution"]), F.lit(0.5)))
    parts = F.concat(
        when(F.col("summary") != "", chunk(F.lit("Summary"), F.col("summary"), F.lit(1.2))),
        when(F.col("headline") != "", chunk(F.lit("Headline"), F.col("headline"), F.lit(1.0), title=True)),
        F.filter(jobs, lambda c: c["text"] != ""),
        when(names != "", chunk(F.lit("Skills"), names, F.lit(1.0), skill=True)),
        schools,
    )
    rows = people.select(F.col("candidate_id").alias("cid"), F.posexplode(F.filter(parts, lambda c: c.isNotNull())).alias("ordinal", "c"))
    return rows.select("cid", "ordinal", "c.*").withColumn("doc", F.concat_ws("#", "cid", F.lpad(F.col("ordinal").cast("string"), 4, "0")))


def split_chunks(chunks: DataFrame, most: int = 512) -> DataFrame:
    """Chunks of at most about ``most`` characters: longer ones are packed anew sentence by
    sentence and their sections numbered (``[part n]``); blank ones go.  A longer sentence stays whole."""
    text = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    parts = F.when(F.length(text) <= most, F.array("text")).otherwise(pack_chunks(text, most))
    others = [c for c in chunks.columns if c not in ("section", "text")]
    rows = chunks.where(text != "").select(*others, "section", F.size(parts).alias("_n"), F.posexplode(parts).alias("part", "text"))
    section = F.when(F.col("_n") > 1, F.concat("section", F.lit(" [part "), (F.col("part") + 1).cast("string"), F.lit("]"))).otherwise(F.col("section"))
    return rows.withColumn("section", section).drop("_n")


def timeline(career: Column) -> Column:
    """Jobs with the current ones first, then the latest start first."""
    return F.transform(
        F.array_sort(F.transform(career, lambda e: F.struct((~e["is_current"]).alias("past"), F.when(e["start_date"] == "", 0).otherwise(-F.unix_date(F.coalesce(_date(e["start_date"]), F.to_date(F.lit("1900-01-01"))))).alias("neg"), e.alias("e")))),
        lambda x: x["e"],
    )


def _date(text: Column) -> Column:
    from ..functions.numeric import parse_date

    return parse_date(text)
