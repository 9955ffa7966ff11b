"""Sources and sinks of our own: growing logs, listings, a log with one header, line numbers of split files."""

import pytest

from pyspark.sql import functions as F

from kerbside.operators import datasets, reports
from kerbside.operators.lineage import numbered
from kerbside.sources import connectors, files


@pytest.fixture(scope="module")
def session(spark):
    return connectors.register(spark)


def run(stream, out, checkpoint, fail_at=None):
    def step(batch, number):
        if fail_at is not None:
            batch.count()
            raise RuntimeError("lost")
        batch.write.mode("append").parquet(out)

    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def test_growing_logs(session, tmp_path):
    logs, out, check = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "check")
    (logs / "deep").mkdir(parents=True)
    a, b = logs / "a.csv", logs / "deep" / "b.csv"
    a.write_bytes(b"one\r\n\ntwo, and some more\nhalf a li")
    b.write_bytes("übermäßig\n".encode() * 50)
    (logs / "empty.csv").write_bytes(b"")
    (logs / "other.txt").write_bytes(b"x\n")
    stream = session.readStream.format("growing_logs").option("path", str(logs)).option("blockBytes", 7).load()
    run(stream, out, check)
    lines = lambda: [(r.file.rsplit("/", 1)[1], r.position, r.line) for r in session.read.parquet(out).orderBy("file", "position").collect()]
    size = len("übermäßig\n".encode())
    of_b = [("b.csv", i * size, "übermäßig") for i in range(50)]
    assert lines() == [("a.csv", 0, "one"), ("a.csv", 5, ""), ("a.csv", 6, "two, and some more"), *of_b]
    a.write_bytes(a.read_bytes() + b"ne\nthree\n")
    with pytest.raises(Exception, match="lost"):
        run(stream, out, check, fail_at=1)
    a.write_bytes(a.read_bytes() + b"four\n")
    run(stream, out, check)  # what was lost, then what came since
    run(stream, out, check)
    of_a = ["one", "", "two, and some more", "half a line", "three", "four"]
    assert [t for f, _, t in lines() if f == "a.csv"] == of_a and len(lines()) == 56
    a.write_bytes(b"anew\n")
    run(stream, out, check)
    assert [(p, t) for f, p, t in lines() if f == "a.csv" and t == "anew"] == [(0, "anew")] and len(lines()) == 57


def test_listing(session, tmp_path):
    root = tmp_path / "set"
    for name, data in [("train/images/a.JPG", b"12"), ("train/images/b.png", b""), ("train/labels/a.txt", b""), ("valid/images/deep/er/c.jpg", b"1"), ("top.jpg", b"")]:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    read = lambda **o: session.read.format("file_listing").options(path=str(root), **o).load()
    for depth in (0, 1, 2, 9):
        got = {(r.stem, r.folder, r.length) for r in read(suffixes=".jpg, .jpeg, .png", depth=depth).collect()}
        assert got == {("a", "images", 2), ("b", "images", 0), ("c", "er", 1), ("top", "set", 0)}
        assert read(depth=depth).count() == 5
    labels = read(suffixes=".txt")
    background = labels.where("length = 0").select("stem")
    assert [r.stem for r in background.collect()] == ["a"]
    assert session.read.format("file_listing").option("path", str(tmp_path / "none")).load().count() == 0
    assert read().rdd.getNumPartitions() > 1


ROW = "2026-01-01T00:00:0{},{},1,0,0,0,0,0,0,7:KA01AB1234|8:x,0,none,3,1,1,0,1"


def log_rows(spark, totals):
    text = spark.createDataFrame([(ROW.format(i, t),) for i, t in enumerate(totals)], "line string").coalesce(1)
    return text.select(F.from_csv("line", reports.LOG_SCHEMA, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("r")).select("r.*")


def whole(path):
    return "".join(f.read_text() for f in sorted(path.glob("*/*.csv")))


def test_headed_log(session, tmp_path):
    log = tmp_path / "log"
    write = lambda df, mode: df.write.format("headed_log").mode(mode).option("path", str(log)).save()
    write(log_rows(session, [1, 2]), "append")
    write(log_rows(session, [3]).withColumn("plates_detected", F.lit('a,"b"')).withColumn("cars", F.lit(None).cast("int")), "append")
    head = ",".join(log_rows(session, []).columns)
    lines = whole(log).splitlines()
    assert lines[0] == head and whole(log).count("timestamp") == 1 and lines[1:3] == [ROW.format(0, 1), ROW.format(1, 2)]
    assert lines[3].startswith('2026-01-01T00:00:00,3,,0') and '"a,""b"""' in lines[3]
    back = files.written_log(session, str(log))
    assert sorted(r.total_vehicles for r in back.collect()) == [1, 2, 3] and back.where("cars is null").count() == 1
    bad = log_rows(session, [4, 5]).repartition(2).withColumn("cars", F.expr("CASE WHEN total_vehicles = 5 THEN raise_error('lost') ELSE 1 END").cast("int"))
    with pytest.raises(Exception, match="lost"):
        write(bad, "append")
    assert whole(log).splitlines() == lines and not list(log.glob("_staging*"))
    write(log_rows(session, [9]), "overwrite")
    assert whole(log).splitlines() == [head, ROW.format(0, 9)]


def test_headed_log_of_a_stream(session, tmp_path):
    source = tmp_path / "in"
    for i in range(2):
        log_rows(session, [i]).write.mode("append").parquet(str(source))
        s = session.readStream.schema(reports.LOG_SCHEMA).parquet(str(source))
        s.writeStream.format("headed_log").option("path", str(tmp_path / "log")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.total_vehicles for r in files.written_log(session, str(tmp_path / "log")).collect()) == [0, 1]
    assert whole(tmp_path / "log").count("timestamp") == 1
    again = connectors.HeadedLogStreamWriter(str(tmp_path / "log"), ["timestamp"], False)
    before = whole(tmp_path / "log")
    again.commit([], 1)
    assert whole(tmp_path / "log") == before and not list((tmp_path / "log").glob("_staging*"))


def test_lines_of_split_files(spark, tmp_path):
    head = "timestamp,total_vehicles"
    series = [f"2026-01-01T00:00:00,{i}" for i in range(400)]
    report = ["", reports.REPORT_TITLE, "generated_at,x", ""]
    for name, title, columns in reports.SECTIONS:
        report += [f"-- {title} --", ",".join(columns), *[f"{name}{i},1" for i in range(90)], ""]
    for f in ("a", "b"):
        (tmp_path / f"{f}.csv").write_text("\n".join(["", head, *series, *report]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = files.numbered_lines(spark, str(tmp_path / "*.csv"))
        assert lines.select(F.spark_partition_id()).distinct().count() > 4
        want = ["", head, *series, *report][:-1]
        for f in ("a", "b"):
            got = [(r.line_no, r.line) for r in lines.where(F.col("file").endswith(f"{f}.csv")).orderBy("line_no").collect()]
            assert got == list(enumerate(want))
        for stretch in (7, 100, 1 << 20):
            s, body = files.parsed_log(lines, stretch)
            assert [r.line for r in s.where(F.col("file").endswith("a.csv")).orderBy("line_no").collect()] == series
            n = {(r.section, r["count"]) for r in body.groupBy("section").count().collect()}
            assert n == {(name, 180) for name, _, _ in reports.SECTIONS}
            assert body.where("not startswith(line, section)").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_numbered(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "k long, v long").repartition(5)
    got = [(r.place, r.k, r.v) for r in numbered(df, ["k", "v"], "place").orderBy("place").collect()]
    assert got == [(n, k, v) for n, (k, v) in enumerate(sorted((i % 7, i) for i in range(500)), 1)]
    assert numbered(df.limit(0), ["k"], "place").count() == 0


def test_split_of_few_equal_and_null_keys(spark):
    keys = [None, "a", "a", *map(str, range(17))]
    got = datasets.split(spark.createDataFrame([(k,) for k in keys], "k string"), "k")
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 16, "val": 2, "test": 2}
    assert [r["split"] for r in got.where("k is null").collect()] == ["test"]
    assert datasets.split(got.limit(0), "k").count() == 0
