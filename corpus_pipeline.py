"""The corpus pipeline: toxicity, exact dedup, near dedup, secret redaction, packing.

Each stage works on all that the one before kept and is written as Parquet, so a lost executor costs a stage's tasks at
most. Stages but the last return the columns of documents. Near duplicates are those of 0.8 or more on five words (op9's
own query has a threshold of its own).

Defined results: null and empty texts pass all stages as empty texts, and of them one stays; null ids are kept by the
stages that go by id, and are packed; ties go as each operator says (the largest id of equal texts, the least of near
ones). Empty tables give empty tables. Further columns are carried along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktap.llm import exact_dedup, near_dedup, packing, secret_scan, toxicity
from sparktap.session import materialise, release, temporary_tables


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels beside them."""
    return toxicity.keep_rows(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, up to the case of A-Z, the one with the largest id stays."""
    return exact_dedup.keep_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles, the one with the least id stays."""
    return near_dedup.keep_rows(docs, num=80, den=100)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live credentials of few owners are replaced in the texts; all documents stay."""
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, in sequences of at most 2048 tokens."""
    return packing.digest(packing.pack(docs, loss=packing.answer_spans(F.col("text"))))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack_tokens),
]

#: SQL can't express the classifier, the links and the tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's table is kept until the next one is written; what a stage writes for itself goes with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with temporary_tables(spark) as keep:
            docs = keep(materialise(stage(spark, before, sf_dir), f"pipeline-{name}"))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
