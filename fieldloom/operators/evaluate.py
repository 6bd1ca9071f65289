"""Extraction quality against labelled truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import as_items, same_date, same_text, trimmed_text

LIST_FIELDS = ("vehicles", "operators", "passengers", "pedestrians", "witnesses")
_ITEM = "array<map<string,string>>"


def flattened(field_id: Column, value: Column) -> Column:
    """A list field's JSON as comma-joined plates or names; other values, and what is no list, as they are."""
    items = F.from_json(value, _ITEM)
    given = lambda m, *keys: F.coalesce(*[F.nullif(F.trim(F.try_element_at(m, F.lit(k))), F.lit("")) for k in keys])
    car = lambda m: F.coalesce(given(m, "plate", "license_plate", "license", "tag", "tag_no"), given(m, "vin"), F.concat_ws(" ", *[given(m, k) for k in ("year", "make", "model", "color")]))
    name = lambda m: F.coalesce(given(m, "name", "full_name", "operator_name", "driver_name"), F.nullif(F.concat_ws(" ", given(m, "first_name"), given(m, "last_name")), F.lit("")))
    role = lambda m: F.lower(F.coalesce(F.try_element_at(m, F.lit("role")), F.lit("")))
    people = F.filter(items, lambda m: ~role(m).rlike("officer|investigator|witness"))
    seen = F.filter(items, lambda m: (role(m) == "") | role(m).contains("witness"))
    joined = lambda a, f: F.array_join(F.filter(F.transform(a, f), lambda x: x.isNotNull()), ", ")
    flat = (
        F.when(field_id == "vehicles", joined(items, car)).when(field_id.isin("operators", "passengers", "pedestrians"), joined(people, name)).when(field_id == "witnesses", joined(seen, name))
    )
    return F.when(field_id.isin(*LIST_FIELDS) & items.isNotNull(), flat).otherwise(value)


def match_class(field_id: Column, truth: Column, got: Column) -> Column:
    """exact, trim, containment, or null."""
    t, g = trimmed_text(truth), trimmed_text(got)
    contained = (F.length(t) >= 3) & (F.length(g) >= 3) & (F.contains(g, t) | F.contains(t, g))
    return (
        F.when(truth.isNull() & got.isNull(), "exact")
        .when(truth.isNull() | got.isNull(), None)
        .when((field_id == "date_time") & same_date(truth, got), "exact")
        .when(field_id.isin(*LIST_FIELDS), F.when(as_items(truth) == as_items(got), "exact"))
        .when(same_text(truth) == same_text(got), "exact")
        .when(t == g, "trim")
        .when(contained, "containment")
    )


def status(field_id: Column, truth: Column, got: Column) -> Column:
    """Seven classes of one comparison."""
    empty = got.isNull() | (got == "")
    kind = match_class(field_id, truth, got)
    return (
        F.when(truth.isNull() & empty, "TRUE_NEGATIVE")
        .when(empty, "MISSED")
        .when(truth.isNull(), "SPURIOUS")
        .when(kind == "exact", "CORRECT")
        .when(kind == "trim", "CORRECT_AFTER_TRIM")
        .when(kind == "containment", "CORRECT_BY_CONTAINMENT")
        .otherwise("INCORRECT")
    )


def compare(truth: DataFrame, record: DataFrame) -> DataFrame:
    """(doc_id, field_id, truth, extracted, confidence, status): ``truth`` (doc_id, field_id, value) left join ``record`` (…, confidence)."""
    got = record.select("doc_id", "field_id", flattened(F.col("field_id"), F.col("value")).alias("extracted"), "confidence")
    both = truth.withColumnRenamed("value", "truth").join(got, ["doc_id", "field_id"], "left")
    return both.withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).withColumn("status", status(F.col("field_id"), F.col("truth"), F.col("extracted")))


def _counts() -> list[Column]:
    return [F.count_if(F.col("status").startswith("CORRECT")).alias("correct"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("INCORRECT", "MISSED", "SPURIOUS", "TRUE_NEGATIVE")]]


def _with_rates(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("correct"), F.col("spurious") + F.col("incorrect"), F.col("missed") + F.col("incorrect")
    share = lambda a, b, none: F.coalesce(F.round(F.try_divide(a, b), 4), F.lit(none))
    rated = df.withColumns({"precision": share(tp, tp + fp, 0.0), "recall": share(tp, tp + fn, 0.0), "accuracy": share(tp, tp + fp + fn, 1.0)})
    return rated.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))


def metrics(compared: DataFrame) -> DataFrame:
    """Counts, precision, recall, F1 and accuracy of everything (``field_id`` null) and of each field, in one pass.

    An incorrect value counts against both precision and recall.
    """
    return _with_rates(compared.rollup("field_id").agg(*_counts()))


RESULT_SCHEMA = (
    "field_id string, correct long, incorrect long, missed long, spurious long, true_negative long, precision double, recall double, accuracy double, f1 double"
)


def write_results(compared: DataFrame, path: str) -> None:
    """An evaluation run as JSON: the figures of all and of each field, the documents' figures, and every comparison."""
    metrics(compared).write.mode("overwrite").json(f"{path}/summary")
    per_document(compared).write.mode("overwrite").json(f"{path}/documents")
    compared.write.mode("overwrite").json(f"{path}/detail")


def read_results(spark, path: str) -> DataFrame:
    """The figures of a stored run."""
    return spark.read.schema(RESULT_SCHEMA).json(f"{path}/summary")


def per_document(compared: DataFrame) -> DataFrame:
    right = F.col("status").startswith("CORRECT") | (F.col("status") == "TRUE_NEGATIVE")
    return compared.groupBy("doc_id").agg(
        F.count_if(right).alias("correct"), F.count(F.lit(1)).alias("total"),
        F.round(F.avg(F.when(F.col("status").startswith("CORRECT"), F.col("confidence"))), 4).alias("confidence_correct"),
        F.round(F.avg(F.when(F.col("status") == "INCORRECT", F.col("confidence"))), 4).alias("confidence_incorrect"),
    )


def calibration(compared: DataFrame) -> DataFrame:
    right = F.col("status").startswith("CORRECT")
    return compared.agg(
        F.round(F.avg(F.when(right, F.col("confidence"))), 4).alias("mean_correct"), F.round(F.avg(F.when(F.col("status") == "INCORRECT", F.col("confidence"))), 4).alias("mean_incorrect"),
        F.count_if(right).alias("n_correct"), F.count_if(F.col("status") == "INCORRECT").alias("n_incorrect"),
    )


def top_failures(compared: DataFrame, n: int = 10) -> DataFrame:
    """The most confident wrong values; a report of ``n`` rows."""
    return compared.where(F.col("status").isin("INCORRECT", "SPURIOUS")).orderBy(F.desc("confidence"), "doc_id", "field_id").limit(n)


def best_confidence(scored: DataFrame) -> DataFrame:
    return scored.where(~F.col("rejected")).groupBy("doc_id", "field_id").agg(F.max("confidence").alias("best_confidence"))


def fill_rates(record: DataFrame, groups: DataFrame, low: float = 0.3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per document, per group, documents under ``low``) shares of fields with a value; ``groups`` has (doc_id, state)."""
    per_doc = record.groupBy("doc_id").agg(F.round(F.count("value") / F.count(F.lit(1)), 4).alias("fill_rate"))
    placed = per_doc.join(groups, "doc_id")
    return per_doc, placed.groupBy("state").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("fill_rate"), 4).alias("fill_rate")), per_doc.where(F.col("fill_rate") < low)


def structure_check(children: DataFrame, expected: DataFrame) -> DataFrame:
    """Whether each document has at least the expected number of child rows: ``children`` (doc_id), ``expected`` (doc_id, least)."""
    counted = children.groupBy("doc_id").agg(F.count(F.lit(1)).alias("found"))
    return expected.join(counted, "doc_id", "left").select("doc_id", "least", F.coalesce("found", F.lit(0)).alias("found"), (F.coalesce("found", F.lit(0)) >= F.col("least")).alias("ok"))


def with_forced_form(classified: DataFrame, labels: DataFrame) -> DataFrame:
    """``classified`` (doc_id, form_id, …) with the labelled form where there is one (doc_id, expected)."""
    return classified.join(labels.select("doc_id", "expected"), "doc_id", "left").withColumn("form_id", F.coalesce("expected", "form_id")).drop("expected")
