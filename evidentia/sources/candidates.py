"""Candidate records: schema, readers, normalisation, deduplication."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from ..cluster import staged

SCHEMA_DDL = """
candidate_id STRING,
profile STRUCT<anonymized_name: STRING, headline: STRING, summary: STRING, location: STRING, country: STRING,
  years_of_experience: DOUBLE, current_title: STRING, current_company: STRING, current_company_size: STRING, current_industry: STRING>,
skills ARRAY<STRUCT<name: STRING, proficiency: STRING, endorsements: DOUBLE, duration_months: DOUBLE>>,
career_history ARRAY<STRUCT<company: STRING, title: STRING, start_date: STRING, end_date: STRING, duration_months: DOUBLE,
  is_current: BOOLEAN, industry: STRING, company_size: STRING, description: STRING>>,
education ARRAY<STRUCT<degree: STRING, field_of_study: STRING, institution: STRING>>,
certifications ARRAY<STRING>,
signals STRUCT<open_to_work_flag: BOOLEAN, last_active_date: STRING, recruiter_response_rate: DOUBLE,
  avg_response_time_hours: DOUBLE, notice_period_days: DOUBLE, github_activity_score: DOUBLE, interview_completion_rate: DOUBLE,
  saved_by_recruiters_30d: DOUBLE>
"""


def schema() -> T.StructType:
    return T._parse_datatype_string(SCHEMA_DDL)


#: What a record may have at its top instead of the nested fields.
FLAT_DDL = "name STRING, title STRING, company STRING, summary STRING, headline STRING, location STRING, years_of_experience DOUBLE, id STRING"


def record(text: Column, signals_key: str | None = None) -> Column:
    """A record (struct, with the flat fields) of one JSON object.

    Its behaviour record stands under ``signals_key`` at its top; by default under
    ``signals`` or the first key there that ends in ``_signals``.
    """
    one = T.StructType([*schema().fields, *T._parse_datatype_string(FLAT_DDL).fields])
    read = F.from_json(text, one)
    if signals_key:
        key = F.lit(signals_key)
    else:
        key = F.get(F.filter(F.json_object_keys(text), lambda k: k.endswith("_signals")), F.lit(0))
    # a path needs its key in quotes, as a key may hold dots
    found = F.call_function("get_json_object", text, F.concat(F.lit("$['"), key, F.lit("']")))
    signals = F.coalesce(F.from_json(found, schema()["signals"].dataType), read["signals"])
    return F.when(F.json_object_keys(text).isNotNull(), read.withField("signals", signals))  # no keys: no object


def parse_lines(lines: DataFrame, column: str = "value", signals_key: str | None = None) -> DataFrame:
    """Records of lines of JSON, with the other columns; blank and malformed lines
    and records without an id are dropped."""
    others = [c for c in lines.columns if c != column]
    rows = lines.select(record(F.col(column), signals_key).alias("_r"), *others)
    return normalise(rows.select(*[F.col(f"_r.{f.name}") for f in schema().fields], *others))


def read_jsonl(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One record a line.  Blank and malformed lines and rows without an id are
    dropped; of rows with one id the last in file order stays."""
    # where a row stands: files by name, blocks by offset, rows by the id that grows within a partition
    at = F.struct("_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("_at")
    good = parse_lines(spark.read.text(path).select("value", at))
    return last_wins(good if limit is None else first_rows(good, limit), "_at")


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in order of ``_at`` (file, block, row), without a sort of all rows.

    Rows are counted for each block of a file; blocks that begin before the n-th row
    stay, and only in the block that holds it rows are numbered.
    """
    block = [F.col("_at.file_name").alias("_file"), F.col("_at.file_block_start").alias("_block")]
    counts = rows.groupBy(*block).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each block
    some = staged(counts.withColumn("_before", before).where(F.col("_before") < n))
    placed = rows.withColumns(dict(zip(("_file", "_block"), block))).join(F.broadcast(some), ["_file", "_block"])
    inside = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_at"))
    last = placed.where(F.col("_before") + F.col("_n") > n).withColumn("_row", inside).where(F.col("_row") <= n - F.col("_before")).drop("_row")
    return placed.where(F.col("_before") + F.col("_n") <= n).unionByName(last).select(*rows.columns)


def last_wins(df: DataFrame, order: str) -> DataFrame:
    """Of rows with the same id the one that comes last."""
    rn = F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.desc(order)))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn", order)


def from_rows(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """Records that are already in memory."""
    return normalise(spark.createDataFrame([_plain(r) for r in rows], schema()))


def _plain(record: dict) -> dict:
    def fit(value, kind):
        if value is None:
            return None
        if isinstance(kind, T.StructType):
            return {f.name: fit(value.get(f.name), f.dataType) for f in kind.fields} if isinstance(value, dict) else None
        if isinstance(kind, T.ArrayType):
            return [fit(v, kind.elementType) for v in value] if isinstance(value, list) else None
        if isinstance(kind, T.DoubleType):
            try:
                return float(value)
            except (TypeError, ValueError):
                return None
        if isinstance(kind, T.BooleanType):
            return bool(value)
        return str(value)

    behaviour = next((v for k, v in record.items() if k.endswith("_signals")), record.get("signals"))
    return {f.name: fit(behaviour if f.name == "signals" else record.get(f.name), f.dataType) for f in schema().fields}


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array, an object with a list under ``candidates``, a single object,
    or one record a line: whichever the file is."""
    text = spark.read.option("wholetext", True).text(path)
    return parse_json(text, "value")


def parse_json(df: DataFrame, column: str, keep: tuple[str, ...] = (), signals_key: str | None = None) -> DataFrame:
    """Records of uploaded JSON texts, in the order of the forms that :func:`read_json`
    knows; with ``keep``, these columns and the record's position in its text."""
    many = T.ArrayType(T.StringType())  # each element as its own JSON
    s = F.trim(F.col(column))
    wrapped = F.get_json_object(s, "$.candidates")
    # one object over several lines: its first line is none by itself
    single = s.startswith("{") & F.json_object_keys(s).isNotNull() & F.json_object_keys(F.get(F.split(s, r"\r?\n"), F.lit(0))).isNull()
    texts = (
        F.when(s.startswith("["), F.from_json(s, many))
        .when(wrapped.isNotNull(), F.from_json(wrapped, many))
        .when(single, F.array(s))
        .otherwise(F.filter(F.split(s, r"\r?\n"), lambda x: F.trim(x) != ""))
    )
    rows = df.select(F.posexplode(texts).alias("pos", "one"), *keep).select(record(F.col("one"), signals_key).alias("r"), "pos", *keep)
    out = unflatten(rows.where("r IS NOT NULL").select("r.*", "pos", *keep), ("pos", *keep))
    return out if keep else out.drop("pos")


def read_upload(spark: SparkSession, path: str, most: int = 100) -> DataFrame:
    """The first ``most`` records of one uploaded JSON file, less those without an id."""
    text = spark.read.option("wholetext", True).text(path).withColumn("at", F.lit(0))
    rows = parse_json(text, "value", ("at",)).orderBy("pos").limit(most)
    return normalise(rows.drop("pos", "at"))


def unflatten(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Flat records (name, title, ...) brought into the nested form, and the columns ``keep``."""
    p = F.col("profile")
    profile = F.struct(
        F.coalesce(p["anonymized_name"], "name").alias("anonymized_name"),
        F.coalesce(p["headline"], "headline", "title").alias("headline"),
        F.coalesce(p["summary"], "summary").alias("summary"),
        F.coalesce(p["location"], "location").alias("location"),
        p["country"].alias("country"),
        F.coalesce(p["years_of_experience"], "years_of_experience").alias("years_of_experience"),
        F.coalesce(p["current_title"], "title").alias("current_title"),
        F.coalesce(p["current_company"], "company").alias("current_company"),
        p["current_company_size"].alias("current_company_size"),
        p["current_industry"].alias("current_industry"),
    )
    out = rows.withColumns({"profile": profile, "candidate_id": F.coalesce("candidate_id", "id")})
    return out.select(*[f.name for f in schema().fields], *keep)


def normalise(df: DataFrame) -> DataFrame:
    """Rows with an id, in the engine's columns."""
    return df.where(F.col("candidate_id").isNotNull() & (F.col("candidate_id") != ""))


def training_records(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path) if path.endswith(".jsonl") else normalise(read_json(spark, path))


def pick(candidates: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of a short list of ids."""
    return candidates.join(ids.select("candidate_id").distinct(), "candidate_id", "left_semi")


def missing(ids: DataFrame, loaded: DataFrame) -> DataFrame:
    """Ids that are needed and not loaded yet."""
    return ids.select("candidate_id").distinct().join(loaded.select("candidate_id"), "candidate_id", "left_anti")


def with_upload_ids(df: DataFrame, *order: str, start: int = 1, prefix: str = "UPLOAD_") -> DataFrame:
    """New ids in upload order, UPLOAD_001 and so on; ids that came along are replaced."""
    n = F.row_number().over(Window.orderBy(*order)) + (start - 1)
    return df.withColumn("candidate_id", F.concat(F.lit(prefix), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))))
