"""Each star-schema query against DuckDB on the smallest tables."""

from pathlib import Path

import pytest
from conftest import DATA, duck, same
from pyspark.sql import functions as F

from evidentia import queries

SMALL = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, SMALL)
    if name in queries.SQL:
        same(got.toPandas(), con.sql(queries.SQL[name]).df())
    else:
        assert got.columns and got.count() >= 0


def test_plan_of_retrieval_prunes_columns(spark):
    plan = queries.bm25_doc_topk(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "n_chars" not in plan
    assert "TakeOrderedAndProject" in plan
    assert "Python" not in plan


def test_rerank_scores_all_documents(spark, tmp_path):
    """Owners whose best text has an id from 500 on; the registered SQL stops there, so it is asked without its filter."""
    for p in Path(SMALL).iterdir():
        (tmp_path / p.name).symlink_to(p)
    (tmp_path / "documents.parquet").unlink()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("doc_id", F.col("doc_id") + F.when(F.col("doc_id") % 2 == 0, 0).otherwise(1000))
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "late").otherwise(F.col("source"))).where("source <> 'late' OR doc_id >= 500")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    sql = queries.SQL["rerank_blend"].replace(" WHERE doc < 500", "")
    same(queries.rerank_blend(spark, str(tmp_path)).toPandas(), duck(tmp_path).sql(sql).df())


def test_boosted_trees_are_all_grown(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries.model, "predict", lambda fitted, rows: seen.append(fitted) or rows.withColumn("model_score", F.lit(0.0)))
    queries.gbt_scores(spark, SMALL)
    assert seen[0].getNumTrees == 200
