"""Reading documents, page texts, truth and results; routing files by their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One document per text file: (doc_id, source_path, text); the path is the id, as names repeat from folder to folder."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"))
    return rows.select(F.col("source_path").alias("doc_id"), "source_path", "text")


def page_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, text, n_pages): page texts (doc_id, page_no, text) in page order; a null page is an empty one."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"), F.count(F.lit(1)).alias("n_pages"))


# Words of file names per document type, in the order they are tried, and the type of all other files.
ROUTES = (("ia", r"\b(?:ia|property|adjuster)\b"), ("acord", r"\bacord\b"), ("hsmv", r"hsmv|90010"))
OTHER_FILES = "police"
# End of the fixed values.


def route(file_name: Column) -> Column:
    """The document type that a file's name speaks of; null for a null name."""
    name = F.regexp_replace(file_name, "[_.\\-]", " ")
    out = F.when(file_name.isNull(), F.lit(None).cast("string"))
    for kind, pattern in ROUTES:
        out = out.when((name if kind != "hsmv" else file_name).rlike(f"(?i){pattern}"), kind)
    return out.otherwise(OTHER_FILES)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, expected_form_id, field_id, value) of labelled documents; null values are fields that a document lacks."""
    schema = "_schema_version string, documents array<struct<filename:string,expected_form_id:string,path:string,fields:map<string,string>,_notes:string>>"
    docs = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("documents").alias("d"))
    return docs.select(F.col("d.filename").alias("doc_id"), F.col("d.expected_form_id").alias("expected_form_id"), F.explode("d.fields").alias("field_id", "value"))


def result_rows(record: DataFrame, audited: DataFrame, forms: DataFrame, docs: DataFrame) -> DataFrame:
    """One result per document: form, record and audit as JSON, and a status; documents without a text fail with a reason instead of an error."""
    values = record.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_id", "value"))))).alias("record"))
    trail = audited.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("field_id", "value", "confidence", "considered", "rejected_count", "needs_review")))).alias("audit"))
    failed = F.coalesce(F.trim("text"), F.lit("")) == ""
    return (
        docs.select("doc_id", F.when(failed, "failed").otherwise("ok").alias("status"), F.when(failed, "no text").alias("error"))
        .join(forms.select("doc_id", "form_id"), "doc_id", "left").join(values, "doc_id", "left").join(trail, "doc_id", "left")
    )


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").partitionBy("form_id").parquet(path)
