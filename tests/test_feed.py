"""The live table and its document."""

import json

from pyspark.sql import functions as F

from kerbside.streaming import feed

SCHEMA = "camera_id long, kind string, id string, at long, n long, plate string"


def size(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def rows_of(spark, path):
    return {(r.camera_id, r.kind, r.id): (r.order, json.loads(r.payload)) for r in feed.table(spark, path).collect()}


def test_merge_by_parts(spark, tmp_path):
    path, keys = str(tmp_path), ["camera_id", "kind", "id"]
    put = lambda rows, number, session="s1": feed.merge(spark.createDataFrame(rows, SCHEMA), number, keys, "at", path, session)
    first = [(i % 3, "plates", str(i), i, None, f"KA{i}") for i in range(600)]
    put(first, 0)
    put([(0, "plates", "3", 9, None, "new"), (0, "plates", "6", 1, None, "late"), (None, "plates", None, None, None, "null")], 1)
    want = {(c, k, i): (at, plate) for c, k, i, at, _, plate in first} | {(0, "plates", "3"): (9, "new"), (None, "plates", None): (None, "null")}
    assert {k: (o, p.get("plate")) for k, (o, p) in rows_of(spark, path).items()} == want
    assert size(tmp_path / "data" / "s1-1") < size(tmp_path / "data" / "s1-0") / 4  # three buckets of 64
    before = feed.manifest(path)
    put([(0, "plates", "3", 99, None, "again")], 1)  # a batch that is run again
    assert feed.manifest(path) == before and rows_of(spark, path)[0, "plates", "3"][0] == 9
    for n in range(2, 5):
        put([(0, "plates", "3", 10 + n, None, f"v{n}")], n)
    held = {str(p.relative_to(tmp_path)) for p in (tmp_path / "data").glob("*/bucket=*")}
    now = feed.manifest(path)
    assert held == set(now["buckets"].values()) | set(now["stale"]) and len(now["stale"]) == 1
    put([], 5)
    assert rows_of(spark, path)[0, "plates", "3"] == (14, {"at": 14, "plate": "v4"}) and len(rows_of(spark, path)) == 601
    put([(1, "plates", "1", 0, None, "other")], 0, "s2")  # a session begins without the one before
    assert set(rows_of(spark, path)) == {(1, "plates", "1")}
    put([(1, "plates", "1", 1, None, "other")], 1, "s2")
    assert not list((tmp_path / "data").glob("s1-*/bucket=*"))


def test_documents(spark):
    rows = [(0, "counts", "Car", 5, '{"n":3}'), (0, "counts", "Bus", 4, '{"n":1}'), (0, "pedestrians", "total", 5, '{"n":2}'), (1, "violations", "8:no_helmet_rider", 2, '{"track_id":8}'), (1, "other", "x", 1, "{}")]
    rows += [(0, "plates", str(i), i, f'{{"track_id":{i},"plate":"KA\\"{i}"}}') for i in range(5)]
    df = spark.createDataFrame(rows, "camera_id long, kind string, id string, order long, payload string")
    got = {r.camera_id: json.loads(r.document) for r in feed.documents(df, most=3).collect()}
    assert got[0] == {
        "counts": {"Bus": 1, "Car": 3}, "pedestrians": {"total": 2}, "plates": [{"track_id": i, "plate": f'KA"{i}'} for i in (4, 3, 2)],
        "violations": [], "two_wheeler_statuses": [], "listed": {"plates": 5, "violations": 0, "two_wheeler_statuses": 0},
    }
    assert got[1]["violations"] == [{"track_id": 8}] and got[1]["counts"] == {} and set(got) == {0, 1}
    assert feed.documents(df.limit(0)).count() == 0


def test_stream(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "feed")
    all_ = []
    for n in range(3):
        rows = [(i % 2, "counts", f"c{i}", n, n * 10 + i, None) for i in range(n, 5)]
        all_ += rows
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
        feed.keep(s, ["camera_id", "kind", "id"], "at", path, str(tmp_path / "c"), "s1").awaitTermination()
    want = {(c, k, i): (at, n) for c, k, i, at, n, _ in sorted(all_, key=lambda r: r[3])}
    assert {k: (o, p["n"]) for k, (o, p) in rows_of(spark, path).items()} == want
    doc = json.loads(feed.documents(feed.table(spark, path)).where("camera_id = 0").first().document)
    assert doc["counts"] == {"c0": 0, "c2": 22, "c4": 24}
    assert feed.table(spark, path).where(F.col("payload").isNull()).count() == 0
