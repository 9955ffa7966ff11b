"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from kerbside.operators import counting, helmets, people, plates
from kerbside.sources import observations as o
from kerbside.streaming import feed, live

SF = "/root/testdata/sf0.001"


def landed(df, path, files=4):
    df = df.withColumn("ts", F.timestamp_seconds(F.col("frame_idx") * 2 + 1000))  # later than the first watermark
    step = df.agg(F.max("frame_idx")).first()[0] // files + 1
    for i in range(files):  # files that land one after the other
        df.where((F.col("frame_idx") >= i * step) & (F.col("frame_idx") < (i + 1) * step)).coalesce(1).write.mode("append").parquet(str(path))
    return df


def test_crossings_equal_the_batch(spark, tmp_path):
    v = landed(o.vehicles(spark, SF).select([c.split()[0] for c in live.OBSERVATION.split(", ")]), tmp_path / "in")
    s = live.crossings(live.observations(spark, str(tmp_path / "in"), files=1), counting.SHORT_LINE)
    live.run_once(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.camera_id, r.track_id, r.frame_idx, r.direction) for r in spark.read.parquet(str(tmp_path / "out")).where("not final").collect()}
    assert got == {tuple(r) for r in counting.crossings(o.vehicles(spark, SF), counting.SHORT_LINE).collect()} and got
    live.run_once(s, str(tmp_path / "out"), str(tmp_path / "cp"))  # nothing new: nothing twice
    assert spark.read.parquet(str(tmp_path / "out")).where("not final").count() == len(got)


def test_ticks_and_presences(spark, tmp_path):
    v = landed(o.vehicles(spark, SF).select([c.split()[0] for c in live.OBSERVATION.split(", ")]), tmp_path / "in")
    late = spark.createDataFrame([(10**6, 5)], "event_id long, track_id long").select("event_id", F.timestamp_seconds(F.lit(10**6)).alias("ts"), F.lit(9).cast("long").alias("camera_id"), "track_id", F.lit(10**6).cast("long").alias("frame_idx"), *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in live.OBSERVATION.split(", ")[5:]])
    late.write.mode("append").parquet(str(tmp_path / "in"))  # moves the watermark on
    obs = live.observations(spark, str(tmp_path / "in"))
    live.run_once(live.ticks(obs, "20 seconds"), str(tmp_path / "t"), str(tmp_path / "c1"))
    got = {(r.camera_id, int(r.start.timestamp()), r.total, r.n_car) for r in spark.read.parquet(str(tmp_path / "t")).where("camera_id < 9").collect()}
    want = {(r.camera_id, r.s, r.n, r.c) for r in v.groupBy("camera_id", (F.floor(F.col("frame_idx") / 10) * 20 + 1000).alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col("raw_class") == "car").alias("c")).collect()}
    assert got == want
    live.run_once(live.presences(obs, "90 seconds"), str(tmp_path / "p"), str(tmp_path / "c2"))
    got = {(r.camera_id, r.track_id, r.first_frame, r.last_frame, r.n_obs) for r in spark.read.parquet(str(tmp_path / "p")).where("camera_id < 9").collect()}
    assert got == {(r.camera_id, r.track_id, r.first_frame, r.last_frame, r.n_obs) for r in helmets.presences(o.vehicles(spark, SF), 44).collect()}


def test_plates_labels_alerts_and_feed(spark, tmp_path):
    reads = landed(plates.corrected(o.plate_reads(spark, SF)).where("plate is not null").select("camera_id", "track_id", "frame_idx", "plate"), tmp_path / "r")
    s = live.observations(spark, str(tmp_path / "r"), "camera_id long, track_id long, frame_idx long, plate string, ts timestamp", 1)
    live.run_once(live.confirmed_plates(s), str(tmp_path / "ro"), str(tmp_path / "rc"))
    got = spark.read.parquet(str(tmp_path / "ro"))
    assert got.where("status = 'confirmed'").count() == got.where("status = 'confirmed'").select("camera_id", "track_id").distinct().count() > 0
    twice = reads.groupBy("camera_id", "track_id", "plate").count().where("count >= 2").select("camera_id", "track_id").distinct().count()
    assert got.where("status = 'confirmed'").count() == twice

    accepted = people.accepted_votes(o.votes(spark, SF))
    landed(accepted.select("camera_id", "track_id", "frame_idx", "label", "conf"), tmp_path / "v", 1)
    s = live.observations(spark, str(tmp_path / "v"), "camera_id long, track_id long, frame_idx long, label string, conf double, ts timestamp")
    live.run_once(live.rolling_labels(s), str(tmp_path / "vo"), str(tmp_path / "vc"))
    got = {(r.camera_id, r.track_id, r.n_votes, r.label) for r in spark.read.parquet(str(tmp_path / "vo")).collect()}
    assert got == {(r.camera_id, r.track_id, r.n_votes, r.label) for r in people.consensus(accepted).collect()}

    landed(helmets.violations(o.heads(spark, SF)).select("camera_id", "track_id", "frame_idx", "type"), tmp_path / "a")
    s = live.observations(spark, str(tmp_path / "a"), "camera_id long, track_id long, frame_idx long, type string, ts timestamp", 1)
    live.run_once(live.alerts(s), str(tmp_path / "ao"), str(tmp_path / "ac"))
    a = spark.read.parquet(str(tmp_path / "ao"))
    assert 0 < a.count() <= spark.read.parquet(str(tmp_path / "a")).count()
    live.latest_feed(s, ["camera_id", "track_id"], "frame_idx", str(tmp_path / "f"), str(tmp_path / "fc")).awaitTermination()
    newest = {(r.camera_id, r.track_id, r.order) for r in feed.table(spark, str(tmp_path / "f")).collect()}
    assert newest == {tuple(r) for r in spark.read.parquet(str(tmp_path / "a")).groupBy("camera_id", "track_id").agg(F.max("frame_idx")).collect()}


def test_rolling_median_and_last_alerts(spark, tmp_path):
    counts = o.persons(spark, SF).groupBy("camera_id", "frame_idx").agg(F.count("*").alias("n"))
    landed(counts, tmp_path / "n")
    s = live.observations(spark, str(tmp_path / "n"), "camera_id long, frame_idx long, n long, ts timestamp", 1)
    live.run_once(live.rolling_median(s, 7), str(tmp_path / "no"), str(tmp_path / "nc"), form="csv", header=True)
    got = {tuple(map(int, r)) for r in spark.read.option("header", True).csv(str(tmp_path / "no")).collect()}
    rows = sorted(tuple(r) for r in counts.collect())
    want = set()
    for camera, frame, n in rows:  # a frame takes two seconds in the landed files
        near = sorted(m for c, f, m in rows if c == camera and frame * 2 - 7 <= f * 2 <= frame * 2)
        k = len(near)
        want.add((camera, frame, n, near[k // 2] if k % 2 else (near[k // 2 - 1] + near[k // 2]) // 2))
    assert got == want

    landed(helmets.violations(o.heads(spark, SF)).select("camera_id", "track_id", "frame_idx", "type"), tmp_path / "a")
    s = live.observations(spark, str(tmp_path / "a"), "camera_id long, track_id long, frame_idx long, type string, ts timestamp", 1)
    live.latest_alerts(s, str(tmp_path / "f"), str(tmp_path / "fc")).awaitTermination()
    got = {(r.camera_id, r.track_id, r.type, r.order) for r in feed.table(spark, str(tmp_path / "f")).collect()}
    assert got == {tuple(r) for r in spark.read.parquet(str(tmp_path / "a")).groupBy("camera_id", "track_id", "type").agg(F.max("frame_idx")).collect()}
