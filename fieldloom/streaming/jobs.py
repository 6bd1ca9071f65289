"""The batch functions over arriving rows.

Sinks are idempotent: a micro-batch writes its own folder, so a batch that is run
again after a failure replaces what it wrote, or goes through the file sink, whose
log counts each batch once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.feedback import alias_hits, column_cells, pattern_hits

ALIAS_SCHEMA = "canonical_field string, alias_header string"
PATTERN_SCHEMA = "field_name string, pattern string, example string, source_doc long"


def each_batch(arriving: DataFrame, job: Callable[[DataFrame, int], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run ``job`` (rows, batch number) on every micro-batch of a stream and keep its rows under ``out``; ends when all that is there was read."""

    def write(batch: DataFrame, number: int) -> None:
        job(batch, number).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arriving_rows(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def extract_arriving(spark: SparkSession, path: str, schema, extract: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Extraction over documents as they arrive: the same function as in batch."""
    return each_batch(arriving_rows(spark, path, schema), lambda batch, _: extract(batch), out, checkpoint)


def learned(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """What a learning stream has stored under ``out``; nothing where nothing is stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(out)


def stored_once(rows: DataFrame, keys: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """The first row of each key of a stream, kept under ``out``.

    The keys seen are the stream's state, so a batch reads none of what was stored; the file sink's own log leaves out
    what a batch that is run again has written before.
    """
    seen = rows.dropDuplicates(keys)
    return seen.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def learn_from_arriving(corrections: DataFrame, raw: DataFrame, out: str, checkpoint: str) -> tuple[StreamingQuery, StreamingQuery]:
    """Aliases and patterns learned from arriving corrections, in two folders under ``out``; each is stored once.

    The state holds one key for each alias and pattern learned, the raw texts are a static side.
    """
    aliases = alias_hits(corrections, column_cells(raw))
    patterns = pattern_hits(corrections, raw).select("field_name", "pattern", F.col("new_value").alias("example"), F.col("doc_id").alias("source_doc"))
    return (
        stored_once(aliases, ["canonical_field", "alias_header"], f"{out}/aliases", f"{checkpoint}/aliases"),
        stored_once(patterns, ["field_name", "pattern"], f"{out}/patterns", f"{checkpoint}/patterns"),
    )
