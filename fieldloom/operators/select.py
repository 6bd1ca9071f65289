"""Selection of the best candidate per field, and the audit around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 0.60


def best(scored: DataFrame) -> DataFrame:
    """The most confident candidate of each (doc_id, field_id) that is not rejected; ties go to the one generated first."""
    order = Window.partitionBy("doc_id", "field_id").orderBy(F.desc("confidence"), "gen_order")
    return scored.where(~F.col("rejected")).withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def ranked(scored: DataFrame) -> DataFrame:
    """All candidates with their rank in their field, the most confident first."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "field_id").orderBy(F.desc("confidence"), "gen_order")))


def leading(scored: DataFrame) -> DataFrame:
    """One row per (doc_id, field_id) with candidates: the chosen one, with ``considered`` and ``rejected_count`` of all.

    Where all were rejected nothing is chosen and the candidate's own columns are null.  One window serves the choice
    and the counts.
    """
    pool = Window.partitionBy("doc_id", "field_id")
    chosen = ~F.col("rejected")
    rows = scored.withColumns({
        "_nth": F.row_number().over(pool.orderBy("rejected", F.desc("confidence"), "gen_order")),
        "considered": F.count(F.lit(1)).over(pool),
        "rejected_count": F.sum(F.col("rejected").cast("long")).over(pool),
    }).where("_nth = 1").drop("_nth")
    keys = ("doc_id", "field_id", "considered", "rejected_count")
    return rows.select(*keys, *[F.when(chosen, F.col(c)).alias(c) for c in scored.columns if c not in keys])


def audit(docs: DataFrame, fields: list[tuple[str, bool]], scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document and template field, also where nothing was found.

    ``fields``: (field id, required) of the template.
    """
    wanted = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field_id"), F.lit(r).alias("required")) for f, r in fields])).alias("f")).select("doc_id", "f.*")
    winner = leading(scored).select(
        "doc_id", "field_id", "considered", "rejected_count", "value", "confidence", "strategy", "match_pattern", "raw_match", "start", "end", "page", *[c for c in ("label_proximity", "validator_pass", "regex_used", "specificity", "position", "agreement", "plausibility", "overlap_penalty") if c in scored.columns],
        F.size(F.filter("validation", lambda r: r["passed"])).alias("validators_passed"), F.size(F.filter("validation", lambda r: ~r["passed"])).alias("validators_failed"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return wanted.join(winner, ["doc_id", "field_id"], "left").withColumns({"considered": zero("considered"), "rejected_count": zero("rejected_count"), "needs_review": F.coalesce(F.col("confidence") < threshold, F.col("required"))})


def summary(audited: DataFrame) -> DataFrame:
    """Per document: fields, extracted ones, those under review, and the mean confidence of the extracted."""
    return audited.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_fields"),
        F.count("value").alias("extracted_fields"),
        F.count_if(F.col("value").isNotNull() & F.col("needs_review")).alias("low_confidence_fields"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("average_confidence"),
    )


def review_flags(audited: DataFrame) -> DataFrame:
    """(doc_id, flags map<field, needs_review>)."""
    return audited.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_id", "needs_review")))).alias("flags"))


def duplicate_insights(scored: DataFrame) -> DataFrame:
    """Fields with more than one candidate, rejected ones included, beside the chosen value."""
    return leading(scored).where("considered > 1").select("doc_id", "field_id", F.col("considered").alias("n_candidates"), F.col("value").alias("chosen"))


def evidence(scored: DataFrame) -> DataFrame:
    """(doc_id, field_id) with at least one candidate."""
    return scored.select("doc_id", "field_id").distinct()


def wide(record: DataFrame, fields: list[str]) -> DataFrame:
    """A row per document with a column per known field."""
    return record.groupBy("doc_id").pivot("field_id", fields).agg(F.first("value", ignorenulls=True))
