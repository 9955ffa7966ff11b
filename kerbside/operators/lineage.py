"""Cutting the lineage of iterative jobs in a way that survives lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the folder in spark.checkpoint.dir and read back (a folder of its own only in a local session that sets none)."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/kerbside-shared"
    path = f"{base.rstrip('/')}/kerbside-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with each row's place in an order, from 1; rows that are equal in it follow each other in any order.

    The rows are sorted in ranges by many tasks and written once, so that
    counting the ranges and numbering the rows see the same ones; a range begins
    after those before it (one small row for each range).
    """
    at = F.monotonically_increasing_id()
    s = cut(df.orderBy(*order).withColumn("_at", at).withColumn("_range", F.shiftright("_at", 33)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = s.groupBy("_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    ranges = ranges.select("_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return s.join(F.broadcast(ranges), "_range").select(*df.columns, place.alias(name))
