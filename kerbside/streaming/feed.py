"""A live table of the newest row of each key, renewed by parts, and the document that a dashboard shows of it."""

from __future__ import annotations

import json
from typing import Any

from pyarrow import fs as files
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.sources.connectors import opened

BUCKETS = 64
MANIFEST = "manifest.json"
# The parts of a live document, figures by name and lists of rows.
FIGURES = ["counts", "pedestrians"]
LISTS = ["plates", "violations", "two_wheeler_statuses"]


def manifest(path: str) -> dict:
    """What the table consists of: session, batch, and the folder of each bucket."""
    fs, root = opened(path)
    if fs.get_file_info(f"{root}/{MANIFEST}").type == files.FileType.NotFound:
        return {"session": None, "batch": -1, "buckets": {}, "stale": [], "schema": None}
    with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def _publish(path: str, new: dict) -> None:
    fs, root = opened(path)
    fs.create_dir(root)
    with fs.open_output_stream(f"{root}/_{MANIFEST}") as f:
        f.write(json.dumps(new).encode())
    fs.move(f"{root}/_{MANIFEST}", f"{root}/{MANIFEST}")


def _drop(path: str, folders: list[str]) -> None:
    fs, root = opened(path)
    for folder in folders:
        if fs.get_file_info(f"{root}/{folder}").type == files.FileType.NotFound:
            continue
        fs.delete_dir(f"{root}/{folder}")
        batch = f"{root}/{folder.rsplit('/', 1)[0]}"
        if not any(f.type == files.FileType.Directory for f in fs.get_file_info(files.FileSelector(batch))):
            fs.delete_dir(batch)


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy("bucket", *keys).agg(F.max(F.struct("order", "payload")).alias("r")).select("bucket", *keys, "r.order", "r.payload")


def merge(batch: DataFrame, number: int, keys: list[str], order: str, path: str, session: str, buckets: int = BUCKETS) -> None:
    """Take a batch into the table: only the buckets that its keys fall into are read and written again.

    A key's row is the one of the greatest order (null the least; of equal
    orders the greatest payload); null keys are keys like any other.  Readers
    see the table before or after a batch, as the manifest is renamed into place
    last; what it replaced goes one batch later.  A batch that was published
    before is passed over, and a session that is not the manifest's begins with
    an empty table.
    """
    spark, now = batch.sparkSession, manifest(path)
    if now["session"] == session and number <= now["batch"]:
        return
    rest = [c for c in batch.columns if c not in keys]
    rows = batch.select(F.pmod(F.hash(*keys), F.lit(buckets)).alias("bucket"), *keys, F.col(order).alias("order"), F.to_json(F.struct(*rest)).alias("payload"))
    rows = _newest(rows, keys)
    touched = sorted(str(r[0]) for r in rows.select("bucket").distinct().collect())  # at most ``buckets`` numbers
    old = now["buckets"] if now["session"] == session else {}
    replaced = {b: old[b] for b in touched if b in old}
    schema = rows.drop("bucket").schema
    for b, folder in replaced.items():
        rows = rows.unionByName(spark.read.schema(schema).parquet(f"{path}/{folder}").withColumn("bucket", F.lit(int(b))))
    folder = f"data/{session}-{number}"
    _newest(rows, keys).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{folder}")
    stale = list(replaced.values()) if now["session"] == session else list(now["buckets"].values())
    _publish(path, {"session": session, "batch": number, "buckets": old | {b: f"{folder}/bucket={b}" for b in touched}, "stale": stale, "schema": schema.json()})
    _drop(path, now["stale"])


def keep(df: DataFrame, keys: list[str], order: str, path: str, checkpoint: str, session: str, buckets: int = BUCKETS) -> Any:
    """Start a stream that keeps the table at ``path`` up to what has come; a session has a checkpoint of its own."""
    step = lambda batch, number: merge(batch, number, keys, order, path, session, buckets)
    return df.writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table(spark: SparkSession, path: str) -> DataFrame:
    """The rows (keys, order, payload as JSON) of the session that runs now."""
    from pyspark.sql.types import StructType

    now = manifest(path)
    if now["schema"] is None:
        raise FileNotFoundError(f"no table at {path}")
    schema = StructType.fromJson(json.loads(now["schema"]))
    found = [f"{path}/{folder}" for _, folder in sorted(now["buckets"].items())]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def documents(rows: DataFrame, camera: str = "camera_id", most: int = 1000) -> DataFrame:
    """One JSON document for each camera from rows (camera, kind, id, order, payload).

    ``counts`` and ``pedestrians`` are maps from id to the payload's ``n``; the
    other parts are lists of payloads, newest first.  The document is a view for
    a screen, so each list ends after the newest ``most`` rows of it, and
    ``listed`` says how many there are; the table keeps all.  Parts without rows
    are empty, other kinds are left out.
    """
    from pyspark.sql import Window

    by = [camera, "kind"]
    n = rows.where(F.col("kind").isin(FIGURES)).select(*by, "id", F.get_json_object("payload", "$.n").cast("long").alias("n"))
    figures = n.groupBy(*by).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "n"))))).alias("part"), F.lit(None).cast("long").alias("listed"))
    lists = rows.where(F.col("kind").isin(LISTS))
    sizes = lists.groupBy(*by).agg(F.count("*").alias("listed"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("order").desc(), F.col("id")))
    top = lists.withColumn("place", place).where(F.col("place") <= most)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("place", "payload"))), lambda x: x["payload"])
    tops = top.groupBy(*by).agg(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")).alias("part")).join(sizes, by)
    parts = figures.unionByName(tops.select(*by, "part", "listed"))

    def part(name: str, empty: str) -> Column:
        return F.concat(F.lit(f'"{name}":'), F.coalesce(F.max(F.when(F.col("kind") == name, F.col("part"))), F.lit(empty)))

    def size(name: str) -> Column:
        return F.concat(F.lit(f'"{name}":'), F.coalesce(F.max(F.when(F.col("kind") == name, F.col("listed"))), F.lit(0)).cast("string"))

    body = F.concat_ws(",", *[part(k, "{}") for k in FIGURES], *[part(k, "[]") for k in LISTS], F.concat(F.lit('"listed":{'), F.concat_ws(",", *map(size, LISTS)), F.lit("}")))
    return parts.groupBy(camera).agg(F.concat(F.lit("{"), body, F.lit("}")).alias("document"))
