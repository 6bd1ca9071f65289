"""Form-like documents rendered from the order tables: what the extraction queries read back.

One document per order, its items numbered in a fixed order.  All of it is
DataFrame expressions over the given tables, so it grows with them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns of a line item that its number within the order goes by.
ITEM_ORDER = ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def numbered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with ``item_no``, their number within the order."""
    order = Window.partitionBy("l_orderkey").orderBy(*ITEM_ORDER)
    return table(spark, sf_dir, "lineitem").withColumn("item_no", F.row_number().over(order))


def order_forms(spark: SparkSession, sf_dir: str, item_style: str = "lines") -> DataFrame:
    """(doc_id, text): a form per order.  ``item_style``: ``lines`` (labelled lines) or ``table`` (a pipe table).

    Items meet their part first and their order then; they are numbered and written in the order's row, so they are moved
    twice at most.
    """
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", *ITEM_ORDER).join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))

    def written(x: Column, i: Column) -> Column:
        number, price, quantity = (i + 1).cast("string"), F.format_number(x["l_extendedprice"], 2), x["l_quantity"].cast("int").cast("string")
        if item_style == "lines":
            return F.concat(F.lit("ITEM "), number, F.lit(": "), x["p_name"], F.lit(" ("), x["p_brand"], F.lit(")\nQuantity: "), quantity, F.lit("\nPrice: $"), price, F.lit("\nCode: "), x["l_returnflag"])
        return F.concat(F.lit("| "), F.concat_ws(" | ", number, x["p_name"], quantity, F.concat(F.lit("$"), price), x["l_returnflag"]), F.lit(" |"))

    head = "" if item_style == "lines" else "| No | Part | Quantity | Price | Code |\n|---|---|---|---|---|\n"
    of_order = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*ITEM_ORDER, "p_name", "p_brand"))).alias("x"))
    listed = of_order.select("l_orderkey", F.array_join(F.transform("x", written), "\n").alias("items"))
    mark = lambda s: F.when(F.col("o_orderstatus") == s, "[X]").otherwise("[ ]")
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(listed, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat_ws(
            "\n",
            F.concat(F.lit("ORDER REPORT FORM "), F.substring("o_orderpriority", 1, 1)),
            F.concat(F.lit("REPORT NO.: OR-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")),
            F.concat(F.lit("DATE: "), F.date_format("o_orderdate", "MM/dd/yyyy")),
            F.concat(F.lit("CUSTOMER: "), F.col("c_name")),
            F.concat(F.lit("STATUS: "), mark("O"), F.lit(" Open  "), mark("F"), F.lit(" Filled  "), mark("P"), F.lit(" Pending")),
            F.lit("SECTION 2 - ITEMS"),
            F.when(F.col("items").isNotNull(), F.concat(F.lit(head), F.col("items"))),
            F.lit("SECTION 3 - SIGN-OFF"),
        ).alias("text"),
    )


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``, or the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    if base.startswith("file:") and not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share: the warehouse is a local folder")
    return f"{base}/{uuid.uuid4().hex}"
