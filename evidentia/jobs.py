"""Command line: rank a file of records, build an index, train a model, scan."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from .config import DEFAULT_QUERY
from .operators import model
from .operators.dense import HashingEmbedder
from .operators.fusion import OverlapScorer
from .plans.ranking import Engine, scan_top
from .sources import candidates, sinks
from .sources.profile import profiles


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) not in (None, [])


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("job", choices=["rank", "index", "train", "scan"])
    p.add_argument("--input", help="records, one JSON object a line")
    p.add_argument("--query", help="file with the query text")
    p.add_argument("--index", help="folder of an index to read or write")
    p.add_argument("--model", help="folder of a model to read or write")
    p.add_argument("--output-csv")
    p.add_argument("--output-json")
    p.add_argument("--limit", type=int)
    p.add_argument("--top-k", type=int, default=100)
    p.add_argument("--as-of")
    p.add_argument("--no-semantic", action="store_true")
    p.add_argument("--rerank", action="store_true", help="score pairs of query and text (OverlapScorer; an Engine takes any)")
    p.add_argument("--validate", action="store_true", help="fail if the ranking isn't well-formed")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.input and not _exists(spark, a.input):
        raise SystemExit(f"no such input: {a.input}")
    options = {"make_embedder": None if a.no_semantic else HashingEmbedder, "make_scorer": OverlapScorer if a.rerank else None}
    if a.job == "rank" and a.model:
        options["model"] = model.load(a.model)
    as_of = a.as_of or str(spark.sql("SELECT current_date() AS d").first()["d"])
    if a.job == "rank" and a.index and not a.input:
        engine = Engine.load(spark, a.index, **options)
    else:
        raw = candidates.training_records(spark, a.input) if a.job == "train" else candidates.read_jsonl(spark, a.input, a.limit)
        if a.job == "scan":
            sinks.write_scan(scan_top(profiles(raw), a.top_k, as_of), a.output_csv)
            return
        engine = Engine(spark, **options).index(raw)
    if a.job == "index":
        engine.save(a.index)
    elif a.job == "train":
        model.save(model.train(engine.training_rows(as_of)), a.model)
    else:
        query = Path(a.query).read_text() if a.query else DEFAULT_QUERY
        ranking = engine.rank(query, a.top_k, as_of).cache()
        if a.validate and (found := sinks.problems(ranking, a.top_k)):
            raise SystemExit("the ranking has " + "; ".join(found))
        if a.output_csv:
            sinks.write_submission(ranking, a.output_csv, a.top_k)
        if a.output_json:
            sinks.write_detailed(ranking, engine.people, a.output_json)


if __name__ == "__main__":
    main()
