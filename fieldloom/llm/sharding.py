"""Sharding by fixed virtual slots (DataFrame functions only).

Every record hashes into one of ``n_slots`` virtual slots.  The slot's bytes are
aggregated, and a slot-to-shard map says where each slot lives.  The map is a
small table with a version; rebalancing writes the next version, which moves
only the slots that an overfull shard must give up.

Defined results
---------------
* null text counts as no bytes; every record weighs its bytes plus 1, so empty
  texts are spread too.
* null ``doc_id`` hashes like any other value.
* a record is hashed by its id, its text and its number among equal records, so
  copies of a text, repeated rows and rows without an id are spread like all others.
* an empty table gives an empty result and a map in which no slot has bytes.
* columns of the input other than ``doc_id`` and ``text`` are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

N_SLOTS = 4096
MAP_SCHEMA = "virtual_slot int, shard int, version int"


def virtual_slot(n_slots: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n_slots)).cast("int")


def sized_records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, copy, virtual_slot) of every record; ``copy`` numbers equal records from 0.

    Equal records are counted where they are read, then numbered by adding up those counts, so what meets in one task
    is a row per input partition, however often a record is repeated.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = ("doc_id", "size", "text_crc32")
    counted = (
        docs.select(
            "doc_id",
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.spark_partition_id().alias("part"),
        )
        .groupBy(*keys, "part")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(before), F.lit(0))
    return (
        counted.withColumn("first", first)
        .select(*keys, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("copy"))
        .withColumn("virtual_slot", virtual_slot(n_slots, *map(F.col, keys), F.col("copy")))
    )


def slot_loads(records: DataFrame) -> DataFrame:
    """Bytes and rows per virtual slot; at most ``n_slots`` rows."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))


def even_map(spark, n_slots: int, n_shards: int) -> DataFrame:
    """Version 0 of the map: equal runs of slots, whatever they hold."""
    return spark.range(n_slots).select(
        F.col("id").cast("int").alias("virtual_slot"),
        F.floor(F.col("id") * n_shards / n_slots).cast("int").alias("shard"),
        F.lit(0).alias("version"),
    )


def rebalance(slot_map: DataFrame, loads: DataFrame, n_shards: int) -> DataFrame:
    """The next version of ``slot_map`` for ``n_shards`` shards.

    Slots are visited from the heaviest; a slot stays where it is as long as its
    shard keeps within its fair share, and otherwise goes to the shard with the
    least bytes so far.  The walk is one fold over an array with an entry per
    slot: its size is the (fixed) number of slots, not of records.  With more or
    fewer shards than before, slots of shards that no longer exist move, and new
    shards fill from what the others must give up.
    """
    slots = slot_map.join(F.broadcast(loads), "virtual_slot", "left").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.coalesce("slot_bytes", F.lit(0)).cast("long").alias("bytes"),
                    (-F.col("virtual_slot")).alias("order"),
                    F.col("shard").alias("was"),
                )
            ),
            asc=False,
        ).alias("slots"),
        F.coalesce(F.sum("slot_bytes"), F.lit(0)).cast("long").alias("total"),
        F.coalesce(F.max("version") + 1, F.lit(1)).alias("version"),
    )
    fold = f"""
        aggregate(
          slots,
          named_struct('loads', array_repeat(0L, {n_shards}), 'shards', cast(array() AS array<int>)),
          (a, s) -> transform(array(
              if(s.was < {n_shards} AND get(a.loads, s.was) + s.bytes <= ceil(total / {n_shards}),
                 s.was, cast(array_position(a.loads, array_min(a.loads)) - 1 AS int))),
            to -> named_struct(
              'loads', transform(a.loads, (l, i) -> if(i = to, l + s.bytes, l)),
              'shards', array_append(a.shards, to)))[0],
          a -> zip_with(slots, a.shards, (s, to) -> named_struct('virtual_slot', cast(-s.order AS int), 'shard', to, 'was', s.was)))
    """
    return slots.select(F.explode(F.expr(fold)).alias("s"), "version").select("s.virtual_slot", "s.shard", "version")


def place(records: DataFrame, slot_map: DataFrame, loads: DataFrame) -> DataFrame:
    """Records with their shard and their gapless position in it.

    A shard's positions run through its virtual slots one after another: where a
    slot begins comes from the per-slot row counts, so rows are only ever ordered
    within a virtual slot and no task sees a whole shard.
    """
    starts = (
        slot_map.select("virtual_slot", "shard")
        .join(F.broadcast(loads), "virtual_slot")
        .withColumn(
            "first",
            F.sum("slot_rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)),
        )
        .select("virtual_slot", "shard", F.coalesce("first", F.lit(0)).alias("first"))
    )
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "copy")
    return (
        records.withColumn("nth", F.row_number().over(within))
        .join(F.broadcast(starts), "virtual_slot")
        .withColumn("slot", F.col("first") + F.col("nth") - 1)
        .drop("first", "nth")
    )


def shard_records(docs: DataFrame, store: str, n_shards: int = 8, n_slots: int = N_SLOTS) -> tuple[DataFrame, DataFrame]:
    """(records with shard, position and map version, the map that placed them).

    The newest map in ``store`` is in force (version 0, the even one, is written where there is none).  It is edited
    for the bytes now seen, the edited map is stored as the next version, and records are placed by what was stored.
    Maps and loads have ``n_slots`` rows, so broadcasting them is bounded by that parameter.
    """
    spark = docs.sparkSession
    records = sized_records(docs, n_slots)
    loads = slot_loads(records)
    newest = latest_version(spark, store)
    if newest is None:
        newest = 0
        write_map(even_map(spark, n_slots, n_shards), store)
    write_map(rebalance(read_map(spark, store, newest), loads, n_shards), store)
    edited = read_map(spark, store, newest + 1)
    return place(records, edited, loads).withColumn("map_version", F.lit(newest + 1)), edited


def latest_version(spark, path: str) -> int | None:
    """The newest stored version of the map; none where nothing is stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(MAP_SCHEMA).parquet(path).agg(F.max("version")).first()[0]


def write_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored maps; old versions stay readable."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def read_map(spark, path: str, version: int | None = None) -> DataFrame:
    """One stored version of the map (the latest by default)."""
    if version is None:
        version = latest_version(spark, path)
    return spark.read.schema(MAP_SCHEMA).parquet(path).where(F.col("version") == version)
