"""The training-data pipeline: language, boilerplate, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs, which its
predecessor kept; all but the last return the columns of documents.  ``run``
writes each stage's result as Parquet in the shared folder and reads it again.

Defined results
---------------
* A null text, or one without a letter, goes at the first stage; a null lang or
  source is as good as any.  Rows without an id pass all stages.
* Extra columns pass all stages but the last, whatever their names.
* Texts are read whole.  An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paginal.llm import jaccard, langid, linededup, packing, pii
from paginal.llm.common import spare_name, table, written

#: Calibrated probability of the predicted language below which a document goes.
LANGUAGE_SCORE = 0.4
#: Words of a shingle and percent of similarity from which documents are near copies.
SHINGLE_WORDS, NEAR_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a likely language."""
    found = langid.detect(docs, langid.fit(docs))
    kept = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE)
    return found.where(kept).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the boilerplate lines of each source from its documents; every document stays."""
    clean = linededup.drop_boilerplate_lines(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near copies.

    Rows with equal id and text are one document and stay once; an id's
    different texts all stay, and so do all rows without an id.
    """
    found = jaccard.jaccard_components(docs, width=SHINGLE_WORDS, percent=NEAR_PERCENT)
    first = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    digest = spare_name(docs.columns, "digest")
    kept = docs.join(first, "doc_id", "left_semi").withColumn(digest, F.sha2("text", 256)).dropDuplicates(["doc_id", digest])
    return kept.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; every document stays."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of all documents into sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("redact_pii", redact_pii),
    ("pack", pack),
]

#: SQL can't express the learned stages; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
