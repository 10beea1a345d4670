"""The corpus pipeline: five stages over the table of documents.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and
returns the columns of the documents (the last one its own).  ``run`` writes
what a stage returns to the shared folder and reads it back for the next one,
so a lost executor costs at most the stage at work.

1. toxicity: documents that are predicted to be toxic go; null and empty texts
   stay;
2. line dedup: repeated lines go from all but the first document, in order of
   doc_id; every document stays, if need be with an empty text;
3. n-gram Jaccard join: of documents that five-word shingles connect at a
   similarity of 0.8 or more, the one with the smallest doc_id stays;
4. benchmark decontamination: contaminated documents go;
5. SentencePiece encoding: token counts, ids and the decoded text's digest.

``n_chars`` follows the text where a stage changes it.

Defined results, besides those of the operators: rows with a null text or id go
through all stages, as do rows with an empty text; rows that repeat an id are judged
by their own texts, but of copies and near copies only rows of one id stay (a row
with a null id goes where another row stays for it); very long texts are taken
whole; an empty table gives an empty table at every stage; extra columns come
through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidentia.llm import decontamination, jaccard_join, line_dedup, piece_bpe, toxicity
from evidentia.llm.common import Workspace, fresh, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic rows go, each by its own text; null and empty texts stay unless the bias alone says toxic."""
    labels = toxicity.training_labels(table(spark, sf_dir, "labels"))
    model = toxicity.train(docs, labels, "doc_id", "text", "toxic")
    score, toxic = fresh(docs, "stage_score"), fresh(docs, "stage_toxic")
    return toxicity.score_toxicity(docs, model, score=score, predicted=toxic).where(F.col(toxic) == 0).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; null texts stay null.  Rows that share an id count as one document, null ids as the last."""
    lines, dropped, kept = (fresh(docs, f"stage_{x}") for x in ("lines", "dropped", "kept"))
    done = line_dedup.dedup_lines(docs, n_lines=lines, n_dropped=dropped, kept=kept)
    changed = {"text": F.when(F.col(dropped) > 0, F.col(kept)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(dropped) > 0, F.length(kept).cast("long")).otherwise(F.col("n_chars"))
    return done.withColumns(changed).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the smallest id; texts without words link with nothing and stay."""
    return jaccard_join.drop_linked(docs, "doc_id", "text", size=5, similar=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated rows go, each by its own text; wordless ones stay, as do all under an empty benchmark."""
    done = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return done.where("NOT contaminated").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row; null and empty texts have the begin and end ids only."""
    done = piece_bpe.encode_documents(docs.select("doc_id", "text"), piece_bpe.default_model(), keep_decoded=False, keep=["doc_id"])
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode),
]

#: Learning, and the library's merges, are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    work, docs = Workspace(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.cut(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            work.drop(f"stage{k - 1}")
        work.tidy()
    return docs
