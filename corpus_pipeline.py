"""From raw documents to token ids: five stages over the whole corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``; all but the last return
the columns of ``documents``.  What a stage drops or changes stays so.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import bpe, decontaminate, minhash_forest, pii, quality
from fieldloom.llm.common import checkpoint_folder, reliable, remove, table
from fieldloom.llm.queries import word_bpe_path
from fieldloom.llm.spans import redacted

QUALITY, SIMILARITY = 0.3, 80


def held(docs: DataFrame) -> DataFrame:
    """(doc_id, text, doc): what a stage reads, and the whole row in one struct, so no column of the input can clash with those that a stage makes."""
    return docs.select("doc_id", "text", F.struct("*").alias("doc"))


def columns_of(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of ``docs`` out of ``doc``, some of them changed."""
    return [changed.get(c, F.col("doc")[c]).alias(c) for c in docs.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null and empty texts are scored too."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(held(docs), model).where(F.col("quality_score") >= QUALITY).select(*columns_of(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, as one row where rows repeat its id."""
    found = reliable(minhash_forest.near_duplicates(docs, inter=100, union=SIMILARITY))
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = reliable(found.where(F.col("kept") & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if repeated.isEmpty():
        return left
    row = F.struct(*docs.columns)
    one = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.xxhash64(row))).alias("_row")).select("_row.*")
    return left.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; ``n_chars`` follows the text."""
    changed = {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("spans") > 0, F.length("redacted")).otherwise(F.col("doc")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return pii.scan(held(docs)).withColumn("redacted", redacted(F.col("text"), F.col("spans"))).select(*columns_of(docs, **changed))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text: base64 of little-endian 32-bit integers, with digests of ids and decoded text."""
    return bpe.encode(docs.select("doc_id", "text"), word_bpe_path()).select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.base64("ids").alias("ids"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("BPE encoding and decoding", tokens_stage),
]

#: Learned models, MinHash and tokens are beyond SQL; tests/llm/test_pipeline.py holds every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared checkpoint folder, and goes when the next stage is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")  # the next stage reads what this one wrote
    return STAGES[-1][1](spark, docs, sf_dir)
