"""Corrections by people: stores, analytics, and what is learned from them.

Stores are DataFrames; the writers append files, and the pure functions below say
which rows.  Keys: corrections (id), raw documents (doc_id), aliases
(canonical_field, alias_header), learned patterns (field_name, pattern).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.spans import once
from ..functions.text import table_rows
from ..functions.values import MISSING
from .templates import MOST_ROWS, checked

#: Fields that patterns may be learned for, and words that make a row a header.
LEARNABLE = (
    "date_time", "location", "agency", "officer", "report_number", "ems_agency", "inspection_date", "inspection_firm", "cause_of_loss",
    "coverage_a", "coverage_b", "coverage_c", "coverage_d", "settlement", "subrogation",
)
HEADER_WORDS = ("vin", "plate", "license", "citation", "name", "dob")


BUCKET = "store_bucket"


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def ratings(actions: DataFrame) -> DataFrame:
    """User actions as scores: ``up`` is 1, all else -1."""
    return actions.withColumn("score", F.when(F.col("action") == "up", 1).otherwise(-1))


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not there yet, one for each key: what insert-or-ignore would add."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def upserted(existing: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """The store after an upsert: of each key the row of the highest version; of equal versions an incoming one, and of those the largest row."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    others = [F.desc(c) for c in existing.columns if c not in (key, version) and "map" not in existing.schema[c].dataType.typeName()]
    order = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new"), *others)
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def deleted(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(gone.select(*keys).distinct(), keys, "left_anti")


# ---- stores in buckets: a change rewrites the buckets that it touches, whatever the size of the store


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_store(rows: DataFrame, path: str, keys: list[str], buckets: int = 256) -> None:
    """A new store of ``rows``, in folders by the hash of their keys."""
    rows.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read_store(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows of a store; ``schema`` without its buckets, so an emptied store can be read too."""
    return spark.read.schema(schema).parquet(path).drop(BUCKET)


def _rewrite(spark: SparkSession, path: str, schema, keys: list[str], buckets: int, changed: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
    """Replaces the buckets that ``changed`` rows fall in by ``change`` of their stored rows.

    The new rows are written beside the store first, so they do not depend on files that are being replaced, and a
    run that fails before the exchange leaves the store as it was.
    """
    bucket = bucket_of(keys, buckets)
    touched = [r[0] for r in changed.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets`` numbers
    of = spark._jvm.org.apache.hadoop.fs.Path
    system = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = {b: f"{path}/{BUCKET}={b}" for b in touched}
    there = [f for f in folders.values() if system.exists(of(f))]
    stored = spark.read.schema(schema).parquet(*there) if there else spark.createDataFrame([], schema)
    name = uuid.uuid4().hex
    beside, old = f"{path}_next_{name}", f"{path}_old_{name}"
    moved = []
    try:
        change(stored).withColumn(BUCKET, bucket).repartition(BUCKET).write.partitionBy(BUCKET).parquet(beside)
        system.mkdirs(of(old))
        for b, folder in folders.items():
            if system.exists(of(folder)):
                system.rename(of(folder), of(f"{old}/{b}"))
                moved.append(b)
            if system.exists(of(f"{beside}/{BUCKET}={b}")):
                system.rename(of(f"{beside}/{BUCKET}={b}"), of(folder))
    except BaseException:
        for b in moved:  # what was there before stands again
            system.delete(of(folders[b]), True)
            system.rename(of(f"{old}/{b}"), of(folders[b]))
        raise
    finally:
        for folder in (beside, old):
            system.delete(of(folder), True)


def upsert_store(spark: SparkSession, path: str, schema, incoming: DataFrame, key: str, version: str, buckets: int = 256) -> None:
    """:func:`upserted` on a store: reads and writes only the buckets of the incoming keys."""
    _rewrite(spark, path, schema, [key], buckets, incoming, lambda stored: upserted(stored, incoming.select(*stored.columns), key, version))


def delete_from_store(spark: SparkSession, path: str, schema, gone: DataFrame, keys: list[str], buckets: int = 256) -> None:
    """:func:`deleted` on a store: reads and writes only the buckets of the keys that go."""
    _rewrite(spark, path, schema, keys, buckets, gone, lambda stored: deleted(stored, gone, keys))


def custom_field_names(custom: DataFrame) -> DataFrame:
    """Names of custom fields: global, although stored with a document."""
    return custom.select("field_name").distinct()


def for_field(store: DataFrame, column: str, value: str) -> DataFrame:
    return store.where(F.col(column) == value)


def top_corrected(corrections: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most corrected fields, with the share of the leading one."""
    top = corrections.groupBy("field_name").agg(F.count(F.lit(1)).alias("corrections")).orderBy(F.desc("corrections"), "field_name").limit(n)
    return top.withColumn("percent", F.round(100 * F.col("corrections") / F.max("corrections").over(Window.partitionBy(F.lit(1))), 0).cast("int"))


def recent(corrections: DataFrame, n: int = 20) -> DataFrame:
    return corrections.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def totals(corrections: DataFrame, n: int = 10) -> DataFrame:
    """(top_total, true_total): corrections of the leading fields, and of all."""
    return top_corrected(corrections, n).agg(F.coalesce(F.sum("corrections"), F.lit(0)).alias("top_total")).join(F.broadcast(corrections.agg(F.count(F.lit(1)).alias("true_total"))))


def learn_aliases(corrections: DataFrame, raw: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(canonical_field, alias_header): headers of the table columns in which corrected values stand.

    The header is the first row with a header word, else the first row; a cell and a
    value match if either contains the other (an empty cell matches nothing).
    """
    cells = column_cells(raw.join(corrections.select("doc_id").distinct(), "doc_id", "left_semi"))
    found = alias_hits(corrections, cells).distinct()
    return found if known is None else new_rows(found, known, ["canonical_field", "alias_header"])


def column_cells(raw: DataFrame) -> DataFrame:
    """(doc_id, alias_header, cell): the cells of the tables of texts under their headers, in small letters."""
    rows = table_rows(raw)
    order = Window.partitionBy("doc_id", "table_no").orderBy("line_no")
    rows = rows.withColumn("n", F.row_number().over(order))
    joined = F.lower(F.array_join("cells", " "))
    is_header = F.exists(F.array(*map(F.lit, HEADER_WORDS)), lambda w: F.contains(joined, w))
    whole = Window.partitionBy("doc_id", "table_no")
    rows = rows.withColumn("at", F.coalesce(F.min(F.when(is_header, F.col("n"))).over(whole), F.lit(1)))
    rows = rows.withColumn("head", F.first(F.when(F.col("n") == F.col("at"), F.col("cells")), ignorenulls=True).over(whole))
    return rows.where("n > at").select("doc_id", "head", F.posexplode("cells").alias("col", "cell")).select("doc_id", F.lower(F.trim(F.get("head", F.col("col")))).alias("alias_header"), F.lower("cell").alias("cell")).where("cell <> ''")


def alias_hits(corrections: DataFrame, cells: DataFrame) -> DataFrame:
    """(canonical_field, alias_header) of every corrected value that stands in a cell or holds one; repeats come again."""
    given = corrections.where(F.trim(F.coalesce("new_value", F.lit(""))) != "").select("doc_id", F.lower("field_name").alias("canonical_field"), F.lower(F.trim("new_value")).alias("wanted"))
    hits = given.join(cells, "doc_id").where(F.contains(F.col("cell"), F.col("wanted")) | F.contains(F.col("wanted"), F.col("cell")))
    return hits.where("alias_header <> '' and alias_header <> canonical_field").select("canonical_field", "alias_header")


def alias_lists(learned: DataFrame, most: int = MOST_ROWS) -> dict[str, list[str]]:
    """{canonical_field: headers} of learned aliases, in order: a dimension of at most ``most`` rows that travels with the extraction."""
    out: dict[str, list[str]] = {}
    for r in checked(learned.select("canonical_field", "alias_header").distinct(), most).orderBy("canonical_field", "alias_header").collect():
        out.setdefault(r["canonical_field"], []).append(r["alias_header"])
    return out


def quoted(text: Column) -> Column:
    """A text as a literal inside a pattern."""
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\$1")


def learn_patterns(corrections: DataFrame, raw: DataFrame, known: DataFrame | None = None, learnable: tuple[str, ...] = LEARNABLE) -> DataFrame:
    """(field_name, pattern, example, source_doc): patterns from the label before a corrected value.

    Only corrections of missing values of learnable fields teach; the label is the
    last line that is not blank in the 60 characters before the value, and the
    pattern must match the document it came from.
    """
    found = pattern_hits(corrections, raw, learnable).groupBy("field_name", "pattern").agg(F.min_by(F.struct("new_value", "doc_id"), "id").alias("x")).select("field_name", "pattern", F.col("x.new_value").alias("example"), F.col("x.doc_id").alias("source_doc"))
    return found if known is None else new_rows(found, known, ["field_name", "pattern"])


def pattern_hits(corrections: DataFrame, raw: DataFrame, learnable: tuple[str, ...] = LEARNABLE) -> DataFrame:
    """(field_name, pattern, new_value, doc_id, id) of every correction that teaches a pattern; repeats come again."""
    fit = corrections.where(F.lower(F.trim("original_value")).isin(*MISSING) & (F.trim("new_value") != "") & F.col("field_name").isin(*learnable))
    at = F.call_function("locate", F.lower("new_value"), F.lower("text"))
    lines = lambda before: F.filter(F.transform(F.split(before, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    label = lambda at: F.trim(F.regexp_replace(F.try_element_at(lines(F.substring(F.col("text"), F.greatest(at - 60, F.lit(1)), F.least(at - 1, F.lit(60)))), F.lit(-1)), r"[\s:\-]+$", ""))
    pattern = lambda x: F.when(F.length(x).between(3, 60) & ~x.rlike(r"^\d"), F.concat(F.lit("(?i)"), quoted(x), F.lit(r"[\s:*\-]{0,5}(.{3,80})(?:\n|$)")))
    matching = lambda p: F.when(F.rlike(F.col("text"), p), p)
    # Each step is computed once for a row; as filters the steps would be computed again in every later one.
    found = once(at, lambda a: F.when(a > 0, once(once(label(a), pattern), matching)))
    return fit.join(raw.select("doc_id", "text"), "doc_id").select("field_name", F.explode(F.array_compact(F.array(found))).alias("pattern"), "new_value", "doc_id", "id")
