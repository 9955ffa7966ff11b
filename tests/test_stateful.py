"""Processors with timers give at every batch what the batch operators give."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from kerbside.functions import labels
from kerbside.operators import counting
from kerbside.sources import observations as o
from kerbside.streaming import live, stateful
from tests.test_streaming import SF, landed

COLUMNS = [c.split()[0] for c in live.OBSERVATION.split(", ")]


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    """A run over four files, and where it is."""
    at = tmp_path_factory.mktemp("session")
    v = landed(o.vehicles(spark, SF).select(COLUMNS), at / "in").cache()
    obs = live.observations(spark, str(at / "in"), files=1)
    stateful.run_session(obs, str(at / "out"), str(at / "cp"), line=counting.SHORT_LINE)
    return at, v, obs


def test_corrections_sum_to_the_running_votes(spark, session):
    at, v, _ = session
    events = spark.read.parquet(f"{at}/out/events")
    crossed = {(r.camera_id, r.track_id): r.frame_idx for r in counting.crossings(v, counting.SHORT_LINE).collect()}
    got = {(r.camera_id, r.track_id): r.frame_idx for r in events.where("event = 'crossed'").collect()}
    assert got == crossed and got
    assert events.where("event = 'corrected'").count() > 0
    votes = counting.running_votes(v).withColumn("c", labels.reporting_class(F.col("leading"))).collect()
    rows = events.where("delta <> 0").collect()
    last = v.agg(F.max("frame_idx")).first()[0]
    for end in range(0, last + 1, max(1, last // 20)):
        now = {}
        for r in sorted(votes, key=lambda r: r.frame_idx):
            if r.frame_idx <= end and crossed.get((r.camera_id, r.track_id), last + 1) <= end:
                now[r.camera_id, r.track_id] = r.c
        sums = Counter()
        for r in rows:
            if r.frame_idx <= end:
                sums[r.camera_id, r.vehicle_class] += r.delta
        assert +sums == Counter((k[0], c) for k, c in now.items()) and min(sums.values(), default=0) >= 0


def test_one_final_row_of_each_track(spark, session):
    at, v, obs = session
    want = {(r.camera_id, r.track_id): (r.direction, r.vehicle_class, r.last_frame) for r in counting.crossed_classes(v, counting.SHORT_LINE).join(counting.last_seen(v), ["camera_id", "track_id"]).collect()}
    stretches = stateful.finals(spark, f"{at}/out").collect()
    ends = Counter((r.camera_id, r.track_id) for r in stretches)
    open_ = {(r.camera_id, r.track_id): (r.direction, r.vehicle_class, r.frame_idx) for r in spark.read.parquet(f"{at}/out/open").collect()}
    assert set(ends) == set(want) and max(ends.values()) == 1 and open_.items() <= want.items() and open_
    before = spark.read.parquet(f"{at}/out/events").count()
    stateful.run_session(obs, f"{at}/out", f"{at}/cp", line=counting.SHORT_LINE)  # nothing new
    assert spark.read.parquet(f"{at}/out/events").count() == before
    assert Counter((r.camera_id, r.track_id) for r in stateful.finals(spark, f"{at}/out").collect()) == ends


def test_ticks_count_crossed_tracks(spark, session, tmp_path):
    at, v, _ = session
    v.write.parquet(str(tmp_path / "in"))
    late = v.limit(1).withColumns({"camera_id": F.lit(9).cast("long"), "frame_idx": F.lit(10**6).cast("long"), "ts": F.timestamp_seconds(F.lit(10**6))})
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # moves the watermark on
    stateful.with_rocks(spark)
    ticks = stateful.cumulative_ticks(stateful.track_events(live.observations(spark, str(tmp_path / "in"))), 20_000, 1_000_000)
    live.run_once(ticks, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.camera_id, int(r.tick.timestamp() - 1000) // 2): (r.total, sum(r.counts.values())) for r in spark.read.parquet(str(tmp_path / "out")).where("camera_id < 9").collect()}
    crossed = [(r.camera_id, r.frame_idx) for r in counting.crossings(v).collect()]
    last = {r.camera_id: r.f for r in v.groupBy("camera_id").agg(F.max("frame_idx").alias("f")).collect()}
    want = {(c, t): (n := sum(k == c and f <= t for k, f in crossed), n) for c, end in last.items() for t in range(0, end + 1, 10)}
    assert got == want and max(got.values())[0] > 5


def test_alerts_once_a_session(spark, tmp_path):
    row = "camera_id long, track_id long, type string, frame_idx long, ts timestamp"
    for i in range(3):  # a hundred seconds apart
        df = spark.createDataFrame([(1, 2, "a", 100 * i), (1, None, "a", 100 * i), (1, 2, None, 100 * i), (1, 3, "b", None)], "camera_id long, track_id long, type string, frame_idx long")
        df.withColumn("ts", F.timestamp_seconds(F.lit(1000 + 100 * i))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stateful.with_rocks(spark)
    alerts = stateful.session_alerts(live.observations(spark, str(tmp_path / "in"), row, 1))
    for _ in range(2):
        live.run_once(alerts, str(tmp_path / "out"), str(tmp_path / "cp"))
        got = sorted(((r.track_id, r.type, r.frame_idx) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
        assert sorted(((t, k, f) for t, k, f in got), key=str) == sorted([(2, "a", 0), (None, "a", 0), (2, None, 0)], key=str)
