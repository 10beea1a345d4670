"""The engine's sub-scores and checks on records made of the star-schema tables, with their SQL.

A customer is a candidate and their orders are the jobs; titles, companies, skills
and descriptions are chosen by the keys' remainders, so that each band is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .cluster import shared_folder, spread, staged
from .config import DEFAULT as S
from .operators import features
from .operators.checks import with_checks
from .plans.ranking import scan_top
from .plans.resume import structure_column
from .sources import sinks
from .sources.candidates import read_jsonl, schema
from .sources.profile import profiles

AS_OF = "2024-02-01"
# What the records are made of.
TITLES = ("ML Engineer", "Senior Data Scientist", "Product Manager", "Head of Sales", "Search Engineer", "Staff Gardener", "Accountant", "Senior Engineer", "Marketing Lead", "Director")
JOBS = ("ML Engineer", "Cook", "Platform Engineer", "Teacher", "Barista", "Clerk", "Driver", "Tech Lead", "Painter", "Guide", "Nurse")
COMPANIES = ("Google", "Acme", "Uber", "", "Initech", "Metaphor", "Swiggy", "Globex", "acme ", "Hooli")
INDUSTRIES = ("software", "retail", "")
PHRASES = (
    "deployed a retrieval pipeline to production for a million users", "built ranking with faiss and python", "wrote reports and planned meetings with the other teams of the house",
    "ran a/b testing and ndcg metrics of an evaluation framework", "made langchain demos", "sold insurance", "served low latency search at scale with elasticsearch and docker", "",
    "published a paper on dense retrieval, embedding and bm25 in production ml", "kept the books in order for many years and learned a lot about tax along the way", "fastapi, pytorch and kubernetes",
    "kept the books in order for many years and learned a lot about tax along the way too",
)
SKILLS = ("Python", "FAISS", "Excel", "Ranking", "Cooking", "BM25", "Search", "Docker", "Chess", "Elasticsearch", "RAG", "Writing", "Embedding")


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (at % len(values)).cast("int"))


def records(spark, d: str) -> DataFrame:
    """Raw candidate records: a customer each, with their orders as jobs in order of their keys."""
    k, n = F.col("o_orderkey"), F.col("c_custkey")
    days = (k * 7 % 400).cast("int")
    start = F.to_date("o_orderdate")
    words = F.array_join(F.filter(F.array(_pick(PHRASES, k), _pick(PHRASES, F.floor(k / 12)), _pick(PHRASES, k * 5 + 3)), lambda p: p != ""), ". ")
    job = F.struct(
        k.alias("k"), _pick(COMPANIES, k).alias("company"), _pick(JOBS, k).alias("title"), F.when(k % 13 != 0, start.cast("string")).alias("start_date"), F.date_add(start, days).cast("string").alias("end_date"),
        F.floor(days / 30).cast("double").alias("duration_months"), (k % 11 == 0).alias("is_current"), _pick(INDUSTRIES, k).alias("industry"), F.lit("").alias("company_size"),
        F.when(k % 4 == 0, _pick(PHRASES, k)).otherwise(words).alias("description"),
    )
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", job.alias("job"))
    jobs = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("job")).alias("jobs"))  # a customer's orders
    customers = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey")
    rows = customers.join(jobs, customers["c_custkey"] == jobs["o_custkey"], "left")
    skill = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(40)), lambda i: i < n % 37),
        lambda i: F.struct(_pick(SKILLS, n + i * 3).alias("name"), F.lit("").alias("proficiency"), ((n + i) % 3).cast("double").alias("endorsements"), F.lit(0.0).alias("duration_months")),
    )
    profile = F.struct(
        n.cast("string").alias("anonymized_name"), _pick(PHRASES, n * 3 + 1).alias("headline"), _pick(PHRASES, n).alias("summary"), F.lit("").alias("location"), F.lit("").alias("country"),
        ((n % 23) / 2.0).alias("years_of_experience"), _pick(TITLES, n).alias("current_title"), F.lit("").alias("current_company"), F.lit("").alias("current_company_size"), F.lit("").alias("current_industry"),
    )
    kinds = {f.name: f.dataType for f in schema().fields}
    made = {
        "candidate_id": n.cast("string"), "profile": profile, "skills": skill, "career_history": F.transform("jobs", lambda j: j.dropFields("k")),
        "education": F.lit(None), "certifications": F.lit(None), "signals": F.lit(None),
    }
    return rows.select(*[made[c].cast(kinds[c]).alias(c) for c in kinds])


def _scored(spark, d: str) -> DataFrame:
    lists = features.Lists(S.keywords.must, S.keywords.nice)
    # read like any table of records and profiles: otherwise what makes them is worked out again wherever they are used
    return features.with_features(staged(profiles(staged(records(spark, d)))), lists, AS_OF)


def _six(**columns: Column) -> list[Column]:
    return [F.round(c, 6).alias(n) for n, c in columns.items()]


def _long(**columns: Column) -> list[Column]:
    return [c.cast("long").alias(n) for n, c in columns.items()]


def profile_scores(spark, d):
    """Relevance, production, technical, negative, career and combined scores of all records."""
    c = F.col
    return _scored(spark, d).select(
        "candidate_id",
        *_six(relevance=c("relevance.score"), production=c("production.score"), technical=c("technical.score"), behavioral=c("behavioral.score"), multiplier=c("negative.multiplier"), career=c("career_history_relevance.score"), legacy=c("legacy_score")),
        *_long(must=c("relevance.must_count"), nice=c("relevance.nice_count"), made=c("production.prod_signal_count"), companies=c("production.companies"), retrieval=c("technical.retrieval_count"), evaluation=c("technical.eval_count"), python=c("technical.python_count"), prior=c("negative.relevant_prior_count"), roles=c("career_history_relevance.career_history_relevant_count")),
        c("relevance.title_relevant").alias("fits"), c("production.tier1").alias("tier1"), c("production.tier2").alias("tier2"), c("career_history_relevance.is_career_pivot").alias("pivot"), F.array_join("negative.flags", ",").alias("flags"),
    )


def profile_checks(spark, d):
    """Proof of work, contradictions and the four parts of credibility of all records."""
    c, g = F.col, lambda n: F.col(f"credibility.signal_scores.{n}")
    return with_checks(_scored(spark, d)).select(
        "candidate_id",
        *_six(power=c("proof_of_work.pow_score"), timeline=g("timeline"), stuffing=g("stuffing"), description=g("description"), claim_gap=g("claim_gap"), penalty=c("credibility.credibility_penalty"), sure=c("credibility.confidence"), contradiction=c("contradictions.penalty")),
        *_long(evidence=c("proof_of_work.total_evidence_count"), warnings=c("contradictions.warning_count"), reasons=F.size("credibility.reason_codes")),
        F.array_join(F.transform("credibility.reason_codes", lambda r: F.regexp_replace(r, "[0-9.]+", "#")), ",").alias("codes"),
    )


def jsonl_records(spark, d):
    """The records, written as JSON lines and read back."""
    path = shared_folder(spark)
    records(spark, d).select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    c = F.col
    return read_jsonl(spark, path).select(
        "candidate_id", c("profile.current_title").alias("title"), c("profile.years_of_experience").alias("years"), F.size("skills").cast("long").alias("skills"),
        F.coalesce(F.size("career_history"), F.lit(0)).cast("long").alias("jobs"), F.coalesce(F.size(F.filter("career_history", lambda e: e["is_current"])), F.lit(0)).cast("long").alias("current"),
    )


def _scanned(spark, d: str) -> tuple[DataFrame, DataFrame]:
    people = staged(profiles(staged(records(spark, d))))
    return people, scan_top(people, 100, AS_OF)


def scan_export(spark, d):
    """The best hundred by the legacy score, exported as CSV and read back."""
    path = shared_folder(spark)
    sinks.write_scan(_scanned(spark, d)[1], path)
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).schema("candidate_id string, rank long, score double, reasoning string").csv(path)
    return rows.select("candidate_id", "rank", "score", (F.length("reasoning") > 0).alias("told"))


def detailed_export(spark, d):
    """The same with their profiles' details, exported as JSON and read back."""
    path = shared_folder(spark)
    people, best = _scanned(spark, d)
    sinks.write_detailed(best.select("candidate_id", "rank", F.col("legacy_score").alias("final_score")), people, path)
    rows, _ = sinks.read_last(spark, path)
    return rows.select("candidate_id", "rank", "final_score", "experience", F.size("skills").cast("long").alias("skills"), F.array_join(F.transform("careerHistory", lambda j: j["company"]), "|").alias("companies"))


NAMES = ("Ann Lee", "Bo van Dyk", "Cy El Amin", "Di Roe")
DEGREES = ("B.S", "MBA", "PhD")
FIELDS = ("Physics", "Law", "Art History")
PLACES = ("Foo College", "Stanford", "Acme Institute")
FIRMS = ("Acme", "Globex", "Initech", "Hooli", "Umbra")
ROLES = ("ML Engineer", "Data Scientist", "Shop Manager", "Lead Designer")


def resume_records(spark, d):
    """Résumé texts made of customers (their orders are jobs, in order of their keys), read back as records."""
    k, n = F.col("o_orderkey"), F.col("c_custkey")
    line = F.concat(_pick(ROLES, k), F.when(k % 3 == 0, F.lit(", ")).otherwise(" at "), _pick(FIRMS, k), F.lit(" "), (F.lit(1990) + k % 20).cast("string"), F.when(k % 7 == 0, F.lit(" - present")).otherwise(F.concat(F.lit(" - "), (F.lit(2010) + k % 10).cast("string"))))
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", F.struct(k.alias("k"), F.concat(line, F.lit("\n- order number "), k.cast("string")).alias("line")).alias("job"))
    jobs = orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("job")), lambda j: j["line"]), "\n").alias("jobs"))
    customers = spread(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey"))  # else a small table's texts are all read by one task
    rows = customers.join(jobs, customers["c_custkey"] == jobs["o_custkey"], "left")
    text = F.concat(
        F.when(n % 2 == 0, F.lit("mail@x.org\n")).otherwise(""), _pick(NAMES, n), F.lit("\n"), _pick(ROLES, n), F.lit("\nExperience\n"), F.coalesce("jobs", F.lit("none")), F.lit("\nEducation:\n"),
        _pick(DEGREES, n), F.lit(" in "), _pick(FIELDS, n), F.lit(" from "), _pick(PLACES, n), F.lit(", 2001\nSkills\n"), _pick(SKILLS, n), F.lit("; skill "), n.cast("string"),
    )
    out = structure_column(rows.select(n.alias("i"), text.alias("t")), "i", "t")
    told = F.transform("career_history", lambda j: F.concat_ws("|", j["title"], j["company"], j["start_date"], F.coalesce(j["end_date"], F.lit("now")), j["description"]))
    school = F.get("education", F.lit(0))
    return out.select(
        F.col("candidate_id"), F.col("profile.anonymized_name").alias("name"), F.col("profile.current_title").alias("title"), F.array_join(told, ";").alias("jobs"), F.size("career_history").cast("long").alias("n"),
        school["degree"].alias("degree"), school["field_of_study"].alias("field"), school["institution"].alias("place"), F.element_at(F.transform("skills", lambda s: s["name"]), -1).alias("last_skill"), F.col("profile.years_of_experience").alias("years"),
    )


# -- SQL -----------------------------------------------------------------------


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _at(values: tuple[str, ...], at: str) -> str:
    return f"{_list(values)}[(({at}) % {len(values)} + 1)::INT]"


def _n(text: str, words) -> str:
    return f"len(list_filter({_list([w.lower() for w in words])}, lambda w: contains({text}, w)))"


def _any(text: str, words) -> str:
    return f"{_n(text, words)} > 0"


def _clamp(x: str, low: str = "0.0", high: str = "1.0") -> str:
    return f"greatest({low}::DOUBLE, least({high}::DOUBLE, {x}))"


_K = S.keywords
_WORDS = f"array_to_string(list_filter([{_at(PHRASES, 'k')}, {_at(PHRASES, 'k // 12')}, {_at(PHRASES, 'k * 5 + 3')}], lambda p: p <> ''), '. ')"
_MADE = f"""j AS (SELECT n, list({{'k': k, 'company': {_at(COMPANIES, 'k')}, 'title': {_at(JOBS, 'k')}, 'start': CASE WHEN k % 13 <> 0 THEN day END, 'fin': day + (k * 7 % 400)::INT,
  'months': (k * 7 % 400) // 30, 'now': k % 11 = 0, 'industry': {_at(INDUSTRIES, 'k')}, 'text': CASE WHEN k % 4 = 0 THEN {_at(PHRASES, 'k')} ELSE {_WORDS} END}} ORDER BY k) AS career
  FROM (SELECT o_custkey AS n, o_orderkey AS k, o_orderdate::DATE AS day FROM orders) GROUP BY n),
r AS (SELECT c_custkey AS n, coalesce(career, []) AS career, (c_custkey % 23) / 2.0 AS years, lower({_at(TITLES, 'c_custkey')}) AS title, {_at(PHRASES, 'c_custkey')} AS summary, {_at(PHRASES, 'c_custkey * 3 + 1')} AS headline,
  list_transform(range(c_custkey % 37), lambda i: {{'name': {_at(SKILLS, 'c_custkey + i * 3')}, 'endorsed': (c_custkey + i) % 3}}) AS skills FROM customer LEFT JOIN j ON c_custkey = n),
t AS (SELECT *, lower(array_to_string(list_transform(career, lambda e: e.text), ' ')) AS work,
  lower(array_to_string(list_filter(list_concat([summary, headline, title], list_transform(skills, lambda s: s.name), flatten(list_transform(career, lambda e: [e.text, e.title, e.company, e.industry]))), lambda x: x <> ''), ' ')) AS full_text,
  list_transform(career, lambda e: lower(e.company)) AS firms FROM r),
x AS (SELECT *, {_n('full_text', _K.must)} AS must, {_n('full_text', _K.nice)} AS nice, {_any('title', _K.irrelevant_titles)} AS off, {_any('title', _K.relevant_titles)} AS fit, {_n('work', _K.production)} AS made,
  len(list_filter(firms, lambda f: {_any('f', _K.tier1)})) > 0 AS top1, len(list_filter(firms, lambda f: {_any('f', _K.tier2)})) > 0 AS top2,
  CASE WHEN len(career) = 0 THEN 0 ELSE len(list_distinct(list_transform(firms, lambda f: trim(f)))) - CASE WHEN list_contains(firms, '') THEN 1 ELSE 0 END END AS companies,
  {_n('full_text', _K.retrieval)} AS retrieval, {_n('full_text', _K.evaluation)} AS evaluation, {_n('full_text', _K.python)} AS python,
  len(list_filter(career, lambda e: {_any('lower(e.title)', _K.career_titles)})) AS roles, len(list_filter(career, lambda e: NOT e.now AND {_any('lower(e.title)', _K.career_titles)})) AS past,
  {_any('full_text', _K.wrapper)} AND NOT {_any('full_text', _K.systems)} AS wrapper FROM t),
y AS (SELECT *, CASE WHEN off THEN past ELSE 0 END AS prior, fit AND NOT off AS fits,
  {_clamp(_clamp('0.12 * must') + ' + least(0.20, 0.04 * nice) + CASE WHEN fit AND NOT off THEN 0.08 ELSE 0.0 END')} AS relevance,
  {_clamp('0.45 * ' + _clamp('made / 6.0') + ' + 0.35 * ' + _clamp('years / 7.0') + ' + CASE WHEN top1 THEN 0.15 WHEN top2 THEN 0.08 ELSE 0.0 END + ' + _clamp('0.04 * (companies - 1)', '0.0', '0.08'))} AS production,
  {_clamp('least(0.60, 0.10 * retrieval) + least(0.25, 0.10 * evaluation) + least(0.20, 0.05 * python)')} AS technical,
  (0.20 * 0.5 + 0.20 * 0.3 + 0.15 * (50 - 40) / 50.0 + 0.20 * (12 - 24) / (2 - 24.0) + 0.10 * 0.5 + 0.10 * (40 - 20) / 60.0 + 0.05 * (80 - 50) / 45.0)::DOUBLE AS behavioral,
  round(greatest(0.65, (CASE WHEN made = 0 THEN 0.88 ELSE 1.0 END)::DOUBLE * (CASE WHEN off AND (CASE WHEN off THEN past ELSE 0 END) = 1 THEN 0.95 WHEN off AND past = 0 THEN 0.85 ELSE 1.0 END) * (CASE WHEN wrapper THEN 0.90 ELSE 1.0 END) * (CASE WHEN years < 2 THEN 0.85 ELSE 1.0 END)), 4) AS multiplier,
  0.40::DOUBLE * (CASE WHEN fit AND NOT off THEN 1 ELSE 0 END) + 0.60::DOUBLE * (CASE WHEN roles >= 2 THEN 1.0 WHEN roles = 1 THEN 0.6 ELSE 0.0 END) AS career_score FROM x)"""

PROFILE_SCORES = f"""WITH {_MADE}
SELECT n::VARCHAR AS candidate_id, round(relevance, 6) AS relevance, round(production, 6) AS production, round(technical, 6) AS technical, round(behavioral, 6) AS behavioral, round(multiplier, 6) AS multiplier, round(career_score, 6) AS career,
round(round({_clamp('(0.35::DOUBLE * relevance + 0.25::DOUBLE * production + 0.20::DOUBLE * technical + 0.20::DOUBLE * behavioral + 0.05::DOUBLE * career_score) * multiplier')}, 4), 6) AS legacy,
must::BIGINT AS must, nice::BIGINT AS nice, made::BIGINT AS made, companies::BIGINT AS companies, retrieval::BIGINT AS retrieval, evaluation::BIGINT AS evaluation, python::BIGINT AS python, prior::BIGINT AS prior, roles::BIGINT AS roles,
fits, top1 AS tier1, top2 AND NOT top1 AS tier2, off AND roles >= 2 AS pivot,
array_to_string(list_filter([CASE WHEN made = 0 THEN 'no_production_signals' END, CASE WHEN off THEN CASE WHEN prior >= 2 THEN 'career_pivot_noted' WHEN prior = 1 THEN 'irrelevant_current_role_mild' ELSE 'irrelevant_current_role' END END,
  CASE WHEN wrapper THEN 'api_wrapper_only' END, CASE WHEN years < 2 THEN 'under_experienced' END], lambda f: f IS NOT NULL), ',') AS flags FROM y"""

_LEVEL = "(CASE WHEN {0} = 0 THEN 0.0 WHEN {0} <= 2 THEN 0.4 * {0} / 2 WHEN {0} <= 5 THEN 0.4 + 0.4 * ({0} - 2) / 3 ELSE 0.8 + 0.2 * least(1.0, ({0} - 5) / 5) END)::DOUBLE".format
_TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9_\\-\\.]+')".format
_BOTH = {c: f"len(list_filter({_list(w)}, lambda w: contains(work, w) OR contains(full_text, w)))" for c, (w, _) in S.evidence.items()}

PROFILE_CHECKS = f"""WITH {_MADE},
a AS (SELECT *, {', '.join(f'{sql}::DOUBLE AS e_{c}' for c, sql in _BOTH.items())},
  list_sort(list_filter(list_transform(career, lambda e, i: {{'start': e.start, 'i': i, 'fin': CASE WHEN NOT e.now THEN e.fin END}}), lambda e: e.start IS NOT NULL)) AS dated,
  len(list_filter(career, lambda e: e.months > 0 AND e.months < 2 AND NOT e.now)) AS short, len(list_filter(skills, lambda s: s.endorsed = 0 AND NOT contains(work, lower(s.name)))) AS bare,
  coalesce(list_sum(list_transform(career, lambda e: len({_TOKENS('e.text')}))), 0) AS words, list_filter(list_transform(career, lambda e: e.text), lambda x: trim(x) <> '') AS texts,
  len(list_filter(career, lambda e: e.text <> '' AND e.months > 12 AND len({_TOKENS('e.text')}) < 15)) AS thin, len(list_filter(career, lambda e: length(trim(e.text)) > 30)) AS told,
  coalesce(list_sum(list_transform(career, lambda e: e.months)), 0) / 12.0 AS career_years, lower(list_filter(career, lambda e: e.now)[1].text) AS now_text,
  {_any('title', ('senior', 'lead', 'principal', 'staff', 'director', 'head of'))} AS senior, len(skills) AS n_skills, len(career) AS n_jobs,
  list_filter({_list(_K.must)}, lambda m: list_contains(list_transform(skills, lambda s: lower(s.name)), m)) AS claimed FROM y),
b AS (SELECT *, list_filter(list_transform(range(len(dated) - 1), lambda i: date_diff('day', dated[i + 1].fin, dated[i + 2].start)), lambda g: g IS NOT NULL) AS gaps, list_transform(texts, lambda x: list_distinct({_TOKENS('x')})) AS sets,
  list_transform(list_filter(list_transform(texts, lambda x: {_TOKENS('x')}), lambda w: len(w) >= 3), lambda w: array_to_string(w[1:3], ' ')) AS firsts,
  round(least(1.0, {' + '.join(f'least(1.0, {_LEVEL(f"e_{c}")}) * {w}' for c, (_, w) in S.evidence.items())}), 4)::DOUBLE AS power, {' + '.join(f'e_{c}' for c in S.evidence)} AS evidence,
  list_filter(claimed[1:5], lambda m: NOT contains(work, m) AND NOT contains(lower(summary), m)) AS absent FROM a),
c AS (SELECT *, len(list_filter(gaps, lambda g: g < -90)) AS laps, coalesce(list_max(gaps), 0) / 30.0 AS gap, n_jobs >= 2 AND len(dated) >= 2 AS timed, n_jobs >= 2 AND len(texts) >= 2 AS many,
  coalesce(list_sum(list_transform(range(len(sets)), lambda i: len(list_filter(range(len(sets)), lambda h: h > i AND len(list_intersect(sets[i + 1], sets[h + 1])) > 0.85 * len(list_distinct(list_concat(sets[i + 1], sets[h + 1]))))))), 0) AS pairs,
  coalesce(list_max(list_transform(firsts, lambda f: len(list_filter(firsts, lambda g: g = f)))), 0) AS most, bare / greatest(n_skills, 1)::DOUBLE AS share, must + nice AS hits,
  CASE WHEN words > 0 THEN (must + nice) / (words / 100.0) END AS density, CASE WHEN years > 0 AND career_years > 0 THEN career_years / years END AS ratio FROM b),
g AS (SELECT *, CASE WHEN timed THEN [CASE WHEN laps >= 2 THEN {{'p': 0.4, 'c': 'timeline_overlap_#_roles'}} END, CASE WHEN laps = 1 THEN {{'p': 0.15, 'c': 'timeline_overlap_#_role'}} END,
    CASE WHEN short >= 3 THEN {{'p': 0.3, 'c': 'very_short_tenure_#_roles'}} WHEN short = 2 THEN {{'p': 0.15, 'c': 'very_short_tenure_#_roles'}} END,
    CASE WHEN gap > 36 THEN {{'p': 0.25, 'c': 'career_gap_#_months'}} WHEN gap > 24 THEN {{'p': 0.10, 'c': 'career_gap_#_months'}} END] ELSE [] END AS g1,
  [CASE WHEN n_skills > 30 THEN {{'p': 0.35, 'c': 'excessive_skills_#'}} WHEN n_skills > 22 THEN {{'p': 0.15, 'c': 'high_skill_count_#'}} END,
    CASE WHEN share > 0.6 AND bare > 5 THEN {{'p': 0.25, 'c': 'unsupported_skills_#_of_#'}} WHEN share > 0.4 AND bare > 4 THEN {{'p': 0.10, 'c': 'partially_unsupported_skills_#'}} END,
    CASE WHEN words > 0 AND density > 8.0 AND hits > 10 THEN {{'p': 0.20, 'c': 'high_buzzword_density_#'}} END] AS g2,
  CASE WHEN many THEN [CASE WHEN pairs >= 2 THEN {{'p': 0.45, 'c': 'duplicate_descriptions_#_pairs'}} WHEN pairs = 1 THEN {{'p': 0.20, 'c': 'near_duplicate_description_#_pair'}} END,
    CASE WHEN thin >= 2 THEN {{'p': 0.15, 'c': 'thin_descriptions_#_roles'}} END, CASE WHEN len(texts) >= 3 AND most >= 3 AND most / len(firsts)::DOUBLE > 0.6 THEN {{'p': 0.15, 'c': 'uniform_description_openings'}} END] ELSE [] END AS g3,
  [CASE WHEN senior AND years < 2 THEN {{'p': 0.30, 'c': 'senior_title_low_exp_#yr'}} WHEN senior AND years < 3 THEN {{'p': 0.10, 'c': 'senior_title_moderate_exp_#yr'}} END,
    CASE WHEN must >= 6 AND made = 0 THEN {{'p': 0.25, 'c': 'high_skill_match_#_no_production'}} WHEN must >= 4 AND made = 0 THEN {{'p': 0.10, 'c': 'skill_match_#_no_production'}} END,
    CASE WHEN n_skills > 10 AND n_jobs = 0 THEN {{'p': 0.30, 'c': 'skills_#_no_career_history'}} END, CASE WHEN years > 8 AND n_jobs <= 1 THEN {{'p': 0.15, 'c': 'exp_#yr_only_#_role'}} END] AS g4,
  [CASE WHEN fit AND power < 0.15 THEN 0.95 END, CASE WHEN NOT off AND relevance > 0.7 AND now_text IS NOT NULL AND NOT {_any('now_text', ('ml', 'machine learning', 'ai', 'model', 'retrieval'))} AND NOT contains(title, 'engineer') THEN 0.97 END,
    CASE WHEN ratio < 0.5 THEN 0.96 WHEN ratio > 2.0 THEN 1.0 END, CASE WHEN relevance > 0.6 AND must < 3 THEN 0.97 END, CASE WHEN contains(title, 'senior') AND years < 3 THEN 0.95 END] AS w FROM c),
h AS (SELECT *, {', '.join(f"least(1.0, coalesce(list_sum(list_transform(list_filter(g{i}, lambda z: z IS NOT NULL), lambda z: z.p)), 0))::DOUBLE AS p{i}" for i in (1, 2, 3, 4))},
  list_transform(list_filter(list_concat(g1, g2, g3, g4), lambda z: z IS NOT NULL), lambda z: z.c) AS codes, list_filter(w, lambda z: z IS NOT NULL) AS warned FROM g)
SELECT n::VARCHAR AS candidate_id, round(power, 6) AS power, round(p1, 6) AS timeline, round(p2, 6) AS stuffing, round(p3, 6) AS description, round(p4, 6) AS claim_gap,
round(round(least(0.12, 0.30 * p1 + 0.25 * p2 + 0.20 * p3 + 0.25 * p4), 4), 6)::DOUBLE AS penalty,
round(least(1.0, 0.5 + CASE WHEN n_jobs >= 3 THEN 0.3 WHEN n_jobs = 2 THEN 0.15 ELSE 0 END + CASE WHEN told >= 2 THEN 0.15 WHEN told = 1 THEN 0.05 ELSE 0 END + CASE WHEN n_skills >= 3 THEN 0.05 ELSE 0 END), 3)::DOUBLE AS sure,
round(greatest(0.80::DOUBLE, coalesce(list_product(list_transform(warned, lambda z: z::DOUBLE)), 1.0::DOUBLE) * 0.99::DOUBLE ** len(absent)), 4)::DOUBLE AS contradiction,
evidence::BIGINT AS evidence, (len(warned) + len(absent))::BIGINT AS warnings, len(codes)::BIGINT AS reasons, array_to_string(codes, ',') AS codes FROM h"""

RESUME_RECORDS = f"""WITH j AS (SELECT o_custkey AS n, list(concat_ws('|', {_at(ROLES, 'o_orderkey')}, {_at(FIRMS, 'o_orderkey')}, 1990 + o_orderkey % 20, CASE WHEN o_orderkey % 7 = 0 THEN 'now' ELSE (2010 + o_orderkey % 10)::VARCHAR END, 'order number ' || o_orderkey) ORDER BY o_orderkey) AS jobs FROM orders GROUP BY o_custkey),
c AS (SELECT c_custkey AS n, coalesce(jobs, [])[1:10] AS jobs FROM customer LEFT JOIN j ON n = c_custkey)
SELECT n::VARCHAR AS candidate_id, {_at(NAMES, 'n')} AS name, {_at(ROLES, 'n')} AS title, array_to_string(jobs, ';') AS jobs, len(jobs)::BIGINT AS n, {_at(DEGREES, 'n')} AS degree, {_at(FIELDS, 'n')} AS field, {_at(PLACES, 'n')} AS place,
'skill ' || n AS last_skill, 2.5::DOUBLE * len(jobs) AS years FROM c"""

JSONL_RECORDS = f"WITH {_MADE} SELECT n::VARCHAR AS candidate_id, {_at(TITLES, 'n')} AS title, years::DOUBLE AS years, len(skills)::BIGINT AS skills, len(career)::BIGINT AS jobs, len(list_filter(career, lambda e: e.now))::BIGINT AS current FROM r"
_BEST = f"""b AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT *, n::VARCHAR AS id,
  round({_clamp('(0.35::DOUBLE * relevance + 0.25::DOUBLE * production + 0.20::DOUBLE * technical + 0.20::DOUBLE * behavioral + 0.05::DOUBLE * career_score) * multiplier')}, 4) AS score FROM y))"""
SCAN_EXPORT = f"WITH {_MADE}, {_BEST} SELECT id AS candidate_id, rank, score, TRUE AS told FROM b WHERE rank <= 100"
DETAILED_EXPORT = f"WITH {_MADE}, {_BEST} SELECT id AS candidate_id, rank, score AS final_score, printf('%.1f yrs', years::DOUBLE) AS experience, len(skills)::BIGINT AS skills, array_to_string(list_transform(career, lambda e: e.company), '|') AS companies FROM b WHERE rank <= 100"

QUERIES = {"jsonl_records": jsonl_records, "scan_export": scan_export, "detailed_export": detailed_export, "resume_records": resume_records, "profile_scores": profile_scores, "profile_checks": profile_checks}
SQL = {"jsonl_records": JSONL_RECORDS, "scan_export": SCAN_EXPORT, "detailed_export": DETAILED_EXPORT, "resume_records": RESUME_RECORDS, "profile_scores": PROFILE_SCORES, "profile_checks": PROFILE_CHECKS}
