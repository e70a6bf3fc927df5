"""A training corpus from raw documents: toxicity, near duplicates, secrets, mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm import mixing, packing, secrets, shingles, toxicity
from kinfold.llm.columns import unused
from kinfold.llm.queries import TOKENS, tokenizer
from kinfold.llm.store import delete, scratch, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels that aren't held out, scores 0.5 or more go.

    Null and empty texts are scored by the bias alone. Repeated rows are scored alike. Without labels all scores are 0.5, and nothing is dropped then.
    Columns of any name pass.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    if labels.where("doc_id is not null and toxic is not null").isEmpty():
        return docs
    score = unused(docs, "score")
    return toxicity.score(docs, toxicity.fit(docs, labels), into=score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles, one stays: that of the smallest id.

    Null ids come after all others. Of rows of one id, or without one, that of the smallest hash of its text; of rows
    equal in both, one. Texts without words (null, empty, blank) are copies of each other. Columns of any name pass.
    """
    row, key = unused(docs, "row"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text"))
    rows = docs.select(key.alias("key"), "text", F.struct(*docs.columns).alias(row))
    kept = shingles.classes(rows, size=5, percent=80, id_col="key").where("key = component_id").select("key").distinct()
    once = Window.partitionBy("key").orderBy(F.xxhash64(row))
    return rows.join(kept, "key", "left_semi").withColumn("rank", F.row_number().over(once)).where("rank = 1").select(f"{row}.*")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced with a mark; every document stays, with n_chars of its new text.

    Null texts keep n_chars. Repeated rows are treated alike. Columns of any name pass.
    """
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of its source takes it, from none to three.

    Null texts have no words and go with their hash; null sources are a source. Rows that repeat an id are taken or left together. Columns of any name pass.
    """
    rows = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("row"))
    out = mixing.plan(rows, carry=("row",)).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids, placed in sequences.

    Null and empty texts are the closing id; repeated rows are packed as often as they come; other columns are left behind.
    """
    return packing.pack(docs, tokenizer(), TOKENS, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Hashed features, 64-bit fingerprints and a tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read again; what a stage needed for itself, and the stage before it, is deleted then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        if before:
            delete(spark, before)
        before = f"{base}/{name}"
        docs = spark.read.parquet(before)
    return docs
