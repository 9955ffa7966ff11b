"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by local sessions that name no checkpoint folder, as in tests; a cluster must name one.
LOCAL_SHARED = "file:///tmp/kerbside-shared"


def shared_dir(spark: SparkSession) -> str:
    """A fresh path below the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_SHARED
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/kerbside-{uuid.uuid4().hex}"


def materialise(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage in a way that survives the loss of executors: the files
    are committed by Spark's writer, and later stages only read them.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(value: str | None) -> bytes:
    return b"" if value is None else value.encode("utf-8")


def fresh(df: DataFrame, name: str) -> str:
    """A name for a helper column that no column of ``df`` has, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
