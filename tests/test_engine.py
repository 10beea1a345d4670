"""The candidate engine on small records, each written for one rule."""

import json
from pathlib import Path

import pytest
from conftest import DATA, duck, same
from pyspark.sql import functions as F

from evidentia import jobs, profile_queries, queries
from evidentia.config import DEFAULT_QUERY
from evidentia.functions import numeric, text
from evidentia.operators import checks, explain, features, fusion, lexical, model
from evidentia.operators.dense import HashingEmbedder
from evidentia.plans import query, resume
from evidentia.plans.ranking import Engine, scan_top
from evidentia.sources import candidates, sinks
from evidentia.sources.profile import evidence_chunks, profiles, split_chunks, timeline
from evidentia.streaming.topk import StreamingTopK, read_stream

AS_OF = "2024-02-01"
LISTS = features.Lists(features.DEFAULT.keywords.must, features.DEFAULT.keywords.nice)
QUERY = """Senior Search Engineer

Requirements:
- 4+ years of experience in ML engineering or AI research
- Python
- Experience with retrieval systems, ranking
- Knowledge of cloud platforms (AWS, GCP or Azure)

Nice to have:
- FastAPI, Docker
- Kubernetes is a plus
"""


def job(**k):
    base = {"company": "X", "title": "ML Engineer", "start_date": "2015-01-01", "end_date": "2017-01-01", "duration_months": 24, "is_current": False, "description": "Deployed a serving pipeline with low latency for users"}
    return base | k


def person(cid, **k):
    profile = {"anonymized_name": cid, "headline": "", "summary": "", "current_title": "ML Engineer", "years_of_experience": 5.0} | k.pop("profile", {})
    return {"candidate_id": cid, "profile": profile, "skills": [], "career_history": [], "education": [], "some_signals": {}} | k


PEOPLE = [
    person("strong", profile={"current_title": "Senior ML Engineer", "years_of_experience": 9.0, "summary": "Retrieval, ranking, search with faiss and python."}, skills=[{"name": "Python", "endorsements": 3}, {"name": "FAISS"}], career_history=[job(company="Google", is_current=True, end_date=None), job(), job(company="Uber")]),
    person("pivot2", profile={"current_title": "Product Manager"}, career_history=[job(), job(title="Data Engineer")]),
    person("pivot1", profile={"current_title": "Product Manager"}, career_history=[job()]),
    person("pivot0", profile={"current_title": "Product Manager"}, career_history=[job(title="Cook")]),
    person("wrapper", profile={"summary": "langchain apps"}),
    person("novice", profile={"current_title": "Senior Engineer", "years_of_experience": 1.0}),
    person("overlap1", career_history=[job(start_date="2015-01-01", end_date="2017-01-01"), job(start_date="2016-10-02", end_date="2018-01-01")]),
    person("overlap0", career_history=[job(start_date="2015-01-01", end_date="2017-01-01"), job(start_date="2016-10-03", end_date="2018-01-01")]),
    person("gap37", career_history=[job(start_date="2010", end_date="2011-01"), job(start_date="2014-06", end_date="2015")]),
    person("tenure2", career_history=[job(duration_months=1), job(duration_months=1, start_date="2018-01", end_date="2018-02")]),
    person("stuffed", skills=[{"name": f"skill{i}", "endorsements": 0} for i in range(31)]),
    person("copypaste", career_history=[job(description="built the same long thing again and again here"), job(start_date="2018", description="built the same long thing again and again here")]),
    {"candidate_id": "sparse", "profile": None, "skills": None, "career_history": None, "education": None, "some_signals": None},
    person("zeros", some_signals={"open_to_work_flag": False, "recruiter_response_rate": 0, "avg_response_time_hours": 0, "notice_period_days": 0, "github_activity_score": -1, "interview_completion_rate": 0}),
    person("substring", profile={"summary": "planning arrays of metadata"}, career_history=[job(company="Metaphor")]),
    person("tie_b"),
    person("tie_a"),
]


@pytest.fixture(scope="module")
def people(spark):
    return profiles(candidates.from_rows(spark, PEOPLE)).cache()


@pytest.fixture(scope="module")
def scored(people):
    rows = features.with_features(people, LISTS, AS_OF).repartition(2)
    rows = checks.with_checks(rows).select("candidate_id", "relevance", "production", "technical", "behavioral", "negative", "career_history_relevance", "legacy_score", "proof_of_work", "contradictions", "credibility")
    return {r.candidate_id: r for r in rows.collect()}


def test_sources(spark, tmp_path):
    lines = [json.dumps(person("a", profile={"headline": "old"})), "", "{bad", json.dumps({"profile": {}}), json.dumps(person("b")), json.dumps(person("a", profile={"headline": "new"}))]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    rows = {r.candidate_id: r for r in candidates.read_jsonl(spark, str(tmp_path / "x.jsonl")).collect()}
    assert set(rows) == {"a", "b"} and rows["a"].profile.headline == "new"
    assert candidates.read_jsonl(spark, str(tmp_path / "x.jsonl"), 1).count() == 1


def test_json_forms(spark):
    texts = [json.dumps([{"candidate_id": "1"}]), json.dumps({"candidates": [{"candidate_id": "2"}]}), json.dumps({"id": "3", "name": "N", "title": "T"}), '{"candidate_id": "4"}\n{"candidate_id": "5"}', None, "junk"]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    rows = {r.candidate_id: r for r in candidates.parse_json(df, "value").collect() if r.candidate_id}
    assert set(rows) == {"1", "2", "3", "4", "5"}
    assert rows["3"].profile.anonymized_name == "N" and rows["3"].profile.current_title == "T"


def test_old_dialect_is_rejected(spark):
    assert candidates.from_rows(spark, [{"candidateid": "x", "skills": {"primary": ["a"]}}]).count() == 0


def test_ids(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("b",)], "candidate_id string")
    have = spark.createDataFrame([("b",), ("c",)], "candidate_id string")
    assert [r[0] for r in candidates.pick(have, ids).collect()] == ["b"]
    assert [r[0] for r in candidates.missing(ids, have).collect()] == ["a"]
    named = candidates.with_upload_ids(have, "candidate_id").orderBy("candidate_id")
    assert [r.candidate_id for r in named.collect()] == ["UPLOAD_001", "UPLOAD_002"]


def test_negative_rules(scored):
    n = {k: v.negative for k, v in scored.items()}
    assert n["pivot2"].flags == ["career_pivot_noted"] and n["pivot2"].multiplier == 1.0
    assert n["pivot1"].multiplier == 0.95 and n["pivot1"].flags == ["irrelevant_current_role_mild"]
    assert n["pivot0"].multiplier == 0.85
    assert "api_wrapper_only" in n["wrapper"].flags and "no_production_signals" in n["wrapper"].flags
    assert n["wrapper"].multiplier == pytest.approx(0.88 * 0.90, abs=1e-4)
    assert "under_experienced" in n["novice"].flags


def test_substring_semantics(scored):
    assert "ann" in scored["substring"].technical.retrieval_matched  # planning
    assert "ray" in scored["substring"].technical.python_matched  # arrays
    assert scored["substring"].production.tier1  # Metaphor has "meta"


def test_behaviour_defaults(scored):
    b = scored["zeros"].behavioral
    assert (b.response_rate, b.response_time_h, b.notice_days, b.github, b.interview_rate) == (50.0, 12.0, 60, 20.0, 80.0)
    assert b.recency_score == 0.3
    assert scored["sparse"].behavioral.github == 40.0


def test_credibility_bands(scored):
    c = {k: v.credibility for k, v in scored.items()}
    assert "timeline_overlap_1_role" in c["overlap1"].reason_codes  # 91 days
    assert not any(r.startswith("timeline") for r in c["overlap0"].reason_codes)  # 90 days
    assert any(r.startswith("career_gap_") for r in c["gap37"].reason_codes)
    assert "very_short_tenure_2_roles" in c["tenure2"].reason_codes
    assert {"excessive_skills_31", "unsupported_skills_31_of_31"} <= set(c["stuffed"].reason_codes)
    assert "near_duplicate_description_1_pair" in c["copypaste"].reason_codes
    for v in c.values():
        assert 0.88 <= v.credibility_multiplier <= 1.0


def test_bounds(scored):
    for r in scored.values():
        assert 0 <= r.legacy_score <= 1 and 0.65 <= r.negative.multiplier <= 1 and 0.80 <= r.contradictions.penalty <= 1
        assert 0 <= r.proof_of_work.pow_score <= 1
        assert r.contradictions.warning_count == len(r.contradictions.warnings)


def test_companies_and_history(scored):
    assert scored["strong"].production.companies == 3 and scored["strong"].production.tier1
    assert scored["strong"].career_history_relevance.score == 1.0
    assert scored["sparse"].production.companies == 0


def test_chunks(people):
    rows = [r for r in evidence_chunks(people).collect() if r.cid == "strong"]
    assert [r.section for r in rows] == ["Summary", "Career @ Google", "Career @ X", "Career @ Uber", "Skills"]
    assert [round(r.weight, 2) for r in rows] == [1.2, 1.5, 1.05, 0.9, 1.0]


def test_timeline_order(people):
    rows = {r.candidate_id: r.t for r in people.select("candidate_id", timeline(F.col("career")).alias("t")).collect()}
    assert rows["strong"][0].is_current


def test_query_parser():
    q = query.parse_query(QUERY)
    assert q.role_title == "Senior Search Engineer" and q.seniority == "senior" and q.min_experience_years == 4.0
    assert "Python" in q.must_have_skills and {"AWS", "GCP", "Azure"} <= set(q.must_have_skills)
    assert "Fastapi, Docker" in q.nice_to_have_skills
    assert set(q.domains) >= {"retrieval", "ml_production"}
    assert query.parse_query("") .must_have_skills == []
    assert query.alike("search", "vector search") and not query.alike("ml", "html")
    assert query.optional_tags("Kafka is a plus\nGo is a plus\nKafka is a plus", ["Go"]) == ["Kafka"]
    assert query.shown("rest apis design") == "REST APIs Design" and query.shown("golang") == "Go" and query.shown("ml html x") == "ML HTML X"
    assert query.split_tag("frontend frameworks such as React, Angular or Vue") == ["React", "Angular", "Vue"]


def test_default_query():
    """The tags of the default query, derived by hand from the rules."""
    q = query.parse_query(DEFAULT_QUERY)
    assert (q.role_title, q.seniority, q.min_experience_years, q.work_mode) == ("Senior AI Engineer", "senior", 4.0, "")
    assert q.must_have_skills == [
        "Engineering Or Ai/ml Research", "Skills With Production Experience", "Retrieval Systems", "Search", "Ranking", "Recommendation",
        "FAISS", "Elasticsearch", "Similar", "Production ML Deployment",
    ]
    assert q.nice_to_have_skills == [
        "Cross-encoders, Reranking, RAG", "Sentence Transformers", "Embeddings Models", "FastAPI", "Similar Python Web Frameworks",
        "Large Language Models", "To Open-source ML Projects", "A/B Testing",
    ]
    assert q.responsibilities[0] == "Build and maintain retrieval and ranking systems" and len(q.responsibilities) == 4


def test_rank(spark, people):
    e = Engine(spark, make_embedder=HashingEmbedder).index(candidates.from_rows(spark, PEOPLE))
    rows = e.rank(QUERY, 6, as_of=AS_OF).orderBy("rank").collect()
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
    assert [(-r.final_score, r.candidate_id) for r in rows] == sorted((-r.final_score, r.candidate_id) for r in rows)
    assert rows[0].candidate_id == "strong"
    assert all(r.explanation.reasoning_text.endswith(".") for r in rows)
    assert [r.candidate_id for r in e.rank(QUERY, 6, as_of=AS_OF).orderBy("rank").collect()] == [r.candidate_id for r in rows]


def test_scan_and_sinks(spark, people, tmp_path):
    top = scan_top(people, 5, AS_OF).cache()
    rows = top.orderBy("rank").collect()
    assert rows[0].candidate_id == "strong" and all(r.reasoning.endswith(".") for r in rows)
    sinks.write_scan(top, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["candidate_id", "rank", "score", "reasoning"]


def test_empty_index(spark):
    e = Engine(spark).index(candidates.from_rows(spark, []))
    assert lexical.bm25(e.lexical_index, lexical.query_terms(spark, "python")).count() == 0


def test_fusion_and_rerank(spark):
    lex = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "cid string, score double")
    sem = spark.createDataFrame([("b", 0.5), ("c", 0.1)], "cid string, score double")
    got = {r.cid: r.hybrid_score for r in fusion.weighted_norm(lex, sem).collect()}
    assert got == {"a": 0.45, "b": 0.55, "c": 0.0}
    rrf = {r.cid: r.rrf_score for r in fusion.reciprocal_rank(lex, sem).collect()}
    assert rrf["b"] == pytest.approx(1 / 62 + 1 / 61)
    base = spark.createDataFrame([("a", 0.9, 1.0), ("b", 0.8, None), ("c", 0.7, 3.0)], "cid string, hybrid_score double, p double")
    out = {r.cid: (r.rerank_score, r.final_retrieval_score) for r in fusion.rerank(base, "p", 2).collect()}
    assert out["a"][0] == 0.0 and out["b"] == (0.0, 0.56) and out["c"][1] == pytest.approx(0.56)


def test_text_functions(spark):
    df = spark.createDataFrame([("Python. C++ naïve a_b-c", "One. Two! Three?  Four"), (None, None), ("", "")], "t string, s string")
    rows = df.select(text.tokens(F.col("t")).alias("w"), text.sentences(F.col("s")).alias("s"), text.pack_chunks(F.col("s"), 9).alias("c")).collect()
    assert rows[0].w == ["python.", "c", "na", "ve", "a_b-c"]
    assert rows[0].s == ["One.", "Two!", "Three?", "Four"] and rows[0].c == ["One. Two!", "Three?", "Four"]
    assert rows[1].w == rows[1].s == rows[1].c == [] and rows[2].c == []
    assert spark.range(1).select(numeric.python_title(F.lit("ci/cd a-b")).alias("x")).first().x == "Ci/Cd A-B"
    ids = spark.createDataFrame([("https://drive.example/drive/folders/ab_1?x",), ("https://x/open?id=Z-9",), ("nothing",)], "u string")
    assert [r[0] for r in ids.select(text.drive_folder_id(F.col("u"))).collect()] == ["ab_1", "Z-9", None]


def test_dates(spark):
    df = spark.createDataFrame([("2020-3-4",), ("2020-03",), ("2020",), ("soon",), (None,), ("2020-01-02T10:00",)], "d string")
    assert [str(r[0]) for r in df.select(numeric.parse_date(F.col("d"))).collect()] == ["2020-03-04", "2020-03-01", "2020-01-01", "None", "None", "2020-01-02"]


def parsed(spark, *texts):
    rows = spark.createDataFrame([(str(k), *(t if isinstance(t, tuple) else (t, None))) for k, t in enumerate(texts)], "i string, t string, called string")
    return [r.asDict(recursive=True) for r in resume.structure_column(rows, "i", "t", "called").orderBy(F.col("candidate_id").cast("int")).collect()]


def test_resume(spark):
    text = "Jane Doe\nSenior ML Engineer\njane@x.com\nSummary\nBuilds search.\nExperience\nML Engineer at Google Jan 2019 - Present\n- built retrieval\n* and ranking\nData Engineer, Foo 2015 - 2018\nInitech | Analyst\nEducation\nB.S. in Computer Science from MIT, 2014\nFoo College\nGardening club\nSkills\nPython, Kafka\n"
    r, empty, named, null, loose, late = parsed(
        spark, text, "", ("", "From File"), None, "Kim Lee\n\n  12 years of experience, 3 yrs here\nPaint and\nShop 2001 to 2003 Manager\nsold paint\nskills\nPhD in Physics at Stanford",
        "Experience\nwork that nobody dated\nEngineer - Acme" + "\nMay 2001 – now" * 12 + "\n" + "x" * 600,
    )
    assert r["profile"]["anonymized_name"] == "Jane Doe" and r["profile"]["current_title"] == "Senior ML Engineer" and r["profile"]["current_company"] == "Google"
    assert [(j["title"], j["company"], j["is_current"], j["start_date"], j["end_date"], j["description"]) for j in r["career_history"]] == [
        ("ML Engineer", "Google", True, "Jan 2019", None, "built retrieval and ranking"), ("Data Engineer", "Foo", False, "2015", "2018", ""), ("Analyst", "Initech", False, "", "", ""),
    ]
    assert [(e["degree"], e["field_of_study"], e["institution"]) for e in r["education"]] == [("B.S", "Computer Science", "MIT"), ("", "", "Foo College")]
    assert r["profile"]["summary"] == "Builds search." and r["profile"]["years_of_experience"] == 7.5
    assert {"Python", "Kafka"} <= {s["name"] for s in r["skills"]}
    for e, name in ((empty, "Unknown"), (named, "From File"), (null, "Unknown")):
        assert e["profile"]["anonymized_name"] == name and e["skills"] == e["career_history"] == e["education"] == [] and e["profile"]["years_of_experience"] == 0
    assert loose["profile"]["years_of_experience"] == 12 and [(j["title"], j["company"]) for j in loose["career_history"]] == [("Shop  Manager", "")]
    assert loose["career_history"][0]["description"] == "sold paint" and loose["education"][0]["institution"] == "Stanford"
    assert len(late["career_history"]) == 10 and (late["career_history"][0]["title"], late["career_history"][0]["company"]) == ("Engineer", "Acme")
    assert late["career_history"][1]["is_current"] and late["career_history"][1]["title"] == ""


def test_resume_names_titles_skills(spark):
    a, b, c, d = parsed(
        spark, "Phone +1 234 567 8901\njohn van Dyk\nAnn de Witt\nCurrent: Lead Engineer\nx", "(555) 123-4567\na@b.c\n" + "x" * 90 + " engineer",
        "Golang and Perl\nSkills\nCooking, perl; Cooking | x\nEducation:\nJulia", "Golang and Perl\nSkills\nCooking, perl; cooking | x\nEducation:\nJulia",
    )
    assert a["profile"]["anonymized_name"] == "Ann de Witt" and a["profile"]["current_title"] == "Lead Engineer"
    assert b["profile"]["anonymized_name"] == "(555) 123-4567" and b["profile"]["current_title"] == ""
    assert [s["name"] for s in c["skills"]][:5] == ["Golang", "Julia", "Perl", "GO", "R"]
    assert [s["name"] for s in d["skills"]][-1] == "Cooking" and len(c["skills"]) == len(d["skills"])
    assert len(resume.SKILLS) == len(set(resume.SKILLS)) == 122


def test_uploads(spark, tmp_path):
    (tmp_path / "a_people.json").write_text(json.dumps([{"candidate_id": "mine", "profile": {"anonymized_name": "A"}, "odd.key_signals": {"notice_period_days": 30}}, {"name": "B", "title": "ML Engineer"}]))
    (tmp_path / "b_more.JSONL").write_text('{"name": "C"}\n{bad\n\n{"name": "D", "x": "some_signals: 1"}\n')
    (tmp_path / "c_none.json").write_text("nothing to read here")
    (tmp_path / "jane-doe_cv.txt").write_text(" \n \n \n \n \n \n ")
    (tmp_path / "k_lee.txt").write_text("Kim Lee\nML Engineer\nPython, faiss and retrieval")
    (tmp_path / "tiny.pdf").write_bytes(b"%PDF")
    (tmp_path / "z.exe").write_bytes(b"0123456789abc")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    raw, errors = resume.uploads(files, (*resume.FORMATS, "txt"))
    rows = {r.candidate_id: r for r in raw.collect()}
    assert {k: r.profile.anonymized_name for k, r in rows.items()} == {"UPLOAD_001": "A", "UPLOAD_002": "B", "UPLOAD_003": "C", "UPLOAD_004": "D", "UPLOAD_005": "Kim Lee"}
    assert rows["UPLOAD_001"].signals.notice_period_days == 30 and rows["UPLOAD_004"].signals is None
    told = {r.path.rsplit("/", 1)[1]: r.error for r in errors.collect()}
    assert told == {"c_none.json": "no records", "jane-doe_cv.txt": "no text", "tiny.pdf": "empty or too small", "z.exe": "unsupported format (.exe)"}
    ranking, errors = Engine(spark).ingest_documents(files.where("path LIKE '%.json%' OR path LIKE '%.exe'"), as_of=AS_OF)
    assert ranking.columns[0] == "candidate_id" and errors.count() == 2
    assert [r.name for r in resume.file_texts(files).where("path LIKE '%jane%'").collect()] == ["Jane Doe Cv"]


def test_sandbox_upload(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"candidate_id": str(k)} if k % 2 else {"name": "n"} for k in range(300)]))
    assert sorted(int(r.candidate_id) for r in candidates.read_upload(spark, str(tmp_path / "x.json")).collect()) == list(range(1, 100, 2))


def test_behaviour_key(spark):
    text = json.dumps({"candidate_id": "1", "a_signals": {"notice_period_days": 7}, "b_signals": {"notice_period_days": 9}, "profile": {"summary": '"c_signals": {}'}})
    df = spark.createDataFrame([(text,)], "value string")
    row = candidates.parse_lines(df).first()
    assert row.signals.notice_period_days == 7 and row.profile.summary == '"c_signals": {}'
    assert candidates.parse_lines(df, signals_key="b_signals").first().signals.notice_period_days == 9


def test_model(spark, people):
    rows = checks.with_checks(features.with_features(people, LISTS, AS_OF).repartition(2)).select(model.feature_vector().alias("features"), model.pseudo_label().alias("label")).cache()
    assert all(len(r.features) == len(model.NAMES) == 36 and 0 <= r.label <= 1 for r in rows.collect())
    fitted = model.train(rows, trees=2)
    assert all(0 <= r.model_score <= 1 for r in model.predict(fitted, rows).collect())
    assert model.predict(None, rows).where("model_score IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        model.train(rows.limit(3))


def test_stream_equals_batch(spark, tmp_path):
    """Three epochs: new records, an update that makes the best one worse, and repeats in a batch."""
    src = tmp_path / "in"
    src.mkdir()
    top = StreamingTopK(str(tmp_path / "state"), 3, AS_OF)
    worse = person("strong", profile={"current_title": "Cook"})
    epochs = [PEOPLE[:9], [*PEOPLE[9:], worse], [PEOPLE[0], person("tie_a"), worse, person("tie_a")]]
    latest = {}
    for k, batch in enumerate(epochs):
        (src / f"{k}.json").write_text("\n".join(json.dumps(p) for p in batch))
        top.start(read_stream(spark, str(src)), str(tmp_path / "ck")).awaitTermination(120)
        latest |= {p["candidate_id"]: p for p in batch}
        got = [(r.candidate_id, r.legacy_score) for r in top.result(spark).collect()]
        want = scan_top(profiles(candidates.from_rows(spark, list(latest.values()))), 3, AS_OF).orderBy("rank").collect()
        assert got == [(r.candidate_id, r.legacy_score) for r in want]
    assert top.result(spark, 0).first().candidate_id == "strong" != top.result(spark, 2).first().candidate_id


def test_jobs(spark, tmp_path):
    """Index, rank with reranking, scan, and what is read back; a missing input is named."""
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps(p) for p in PEOPLE))
    (tmp_path / "q.txt").write_text(QUERY)
    path = {k: str(tmp_path / k) for k in ("in.jsonl", "q.txt", "index", "csv", "json", "scan")}
    jobs.main(["index", "--input", path["in.jsonl"], "--index", path["index"]])
    jobs.main(["rank", "--index", path["index"], "--query", path["q.txt"], "--output-csv", path["csv"], "--output-json", path["json"], "--top-k", "5", "--as-of", AS_OF, "--rerank", "--validate"])
    rows = spark.read.option("header", True).option("escape", '"').csv(path["csv"]).collect()
    built = Engine(spark, make_embedder=HashingEmbedder, make_scorer=fusion.OverlapScorer).index(candidates.from_rows(spark, PEOPLE)).rank(QUERY, 5, as_of=AS_OF)
    assert [r.candidate_id for r in rows] == [r.candidate_id for r in built.orderBy("rank").collect()] and rows[0].candidate_id == "strong"
    last, about = sinks.read_last(spark, path["json"])
    assert about.first().result_count == len(rows) == last.count() and last.where("rank = 1").first().experience == "9.0 yrs"
    jobs.main(["scan", "--input", path["in.jsonl"], "--output-csv", path["scan"], "--top-k", "3", "--as-of", AS_OF])
    assert spark.read.option("header", True).csv(path["scan"]).count() == 3
    with pytest.raises(SystemExit, match="no such input"):
        jobs.main(["scan", "--input", path["in.jsonl"] + ".gone"])


def test_ranking_problems(spark):
    rows = spark.createDataFrame([("a", 1, 0.5), ("a", 3, 0.9), (None, 4, 2.0)], "candidate_id string, rank long, final_score double")
    assert len(sinks.problems(rows, 2)) == 6 and sinks.problems(rows.limit(1)) == []


def test_methods_and_training(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"candidates": PEOPLE}))
    raw = candidates.training_records(spark, str(tmp_path / "t.json"))
    e = Engine(spark, make_embedder=HashingEmbedder).index(raw)
    assert e.status() == {"status": "ok", "indexed": True, "candidates": len(PEOPLE)}
    assert e.retrieve(QUERY, 5, method="rrf").where("hybrid_score > 0").count() > 0
    fitted = model.train(e.training_rows(AS_OF).withColumn("label", F.col("label").cast("double")), trees=2)
    model.save(fitted, str(tmp_path / "m"))
    again = model.load(str(tmp_path / "m"))
    assert again.getNumTrees == 2 and len(model.importances(again)) > 0


def test_chunk_parts(spark):
    text = " ".join(f"Sentence number {k} goes here." for k in range(40))
    rows = spark.createDataFrame([("s", " \n "), ("t", "  short  "), ("u", text), ("v", "x" * 600)], "section string, text string")
    got = [(r.section, len(r.text)) for r in split_chunks(rows, 512).orderBy("section").collect()]
    assert [s for s, _ in got] == ["t", "u [part 1]", "u [part 2]", "u [part 3]", "v"] and got[0][1] == 9 and got[-1][1] == 600  # short ones stay as they are
    assert all(n <= 512 for s, n in got if s != "v")


def test_entry_without_the_subpackage(tmp_path):
    """The other queries are there without it, and a fault inside it isn't hidden."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for name in ("evidentia", "__spark_entry__.py"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    shutil.rmtree(tmp_path / "evidentia" / "llm", ignore_errors=True)
    assert int(run().stdout.split()[-1]) == len(queries.QUERIES)
    (tmp_path / "evidentia" / "llm").mkdir()
    (tmp_path / "evidentia" / "llm" / "queries.py").write_text("import no_such_module")
    assert "no_such_module" in run().stderr


def test_explanation_choice(spark):
    seed = explain.choose(F.lit(7), [F.lit("a"), F.lit("b"), F.lit("c")])
    assert spark.range(1).select(seed.alias("x")).first().x == "b"


def test_resume_expressions_stay_small(spark):
    """Each step of reading a job is written once; copies of copies took over a minute to analyse and run."""
    plan = spark.createDataFrame([("a b",)], "t string").select(resume.jobs_of(resume.lines_of(F.col("t"))).alias("jobs"))._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 50_000


def test_records_of_customers_without_orders(spark, tmp_path):
    for p in Path(f"{DATA}/sf0.001").iterdir():
        (tmp_path / p.name).symlink_to(p)
    (tmp_path / "orders.parquet").unlink()
    spark.read.parquet(f"{DATA}/sf0.001/orders.parquet").where("o_custkey % 3 <> 0").write.parquet(str(tmp_path / "orders.parquet"))
    for name in ("jsonl_records", "resume_records"):
        same(profile_queries.QUERIES[name](spark, str(tmp_path)).toPandas(), duck(tmp_path).sql(profile_queries.SQL[name]).df())
