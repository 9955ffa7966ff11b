"""Known answers on tiny tables."""

import pytest
from pyspark.sql import functions as F

from kerbside.functions import geometry as g
from kerbside.functions import labels, plate_text
from kerbside.operators import counting, evaluation, helmets, people, plates, spatial


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lits(*v):
    return tuple(F.lit(x) for x in v)


def test_geometry(spark):
    a, b = lits(0, 0, 10, 10), lits(5, 5, 15, 15)
    assert one(spark, F.round(g.iou(a, b), 9), g.iou(lits(0, 0, 0, 0), lits(0, 0, 0, 0)), g.inner_ratio(lits(0, 0, 10, 10), lits(0, 0, 5, 10)), g.centre_in_raised(lits(0, -4, 2, -2), a, 0.4)) == (round(25 / 175, 9), 0.0, 0.5, True)


@pytest.mark.parametrize("path,direction", [([(50, 40), (50, 60)], "INBOUND"), ([(50, 60), (50, 40)], "OUTBOUND"), ([(50, 10), (50, 45)], None), ([(10, 40), (90, 40)], None), ([(50, 40), (50, 50)], "OUTBOUND"), ([(50, 50), (50, 60)], None), ([(50, 40)], None)])
def test_crossing(spark, path, direction):
    rows = [(0, 1, i, x - 5, y - 10, x + 5, y) for i, (x, y) in enumerate(path)]
    d = spark.createDataFrame(rows, "camera_id long, track_id long, frame_idx long, x1 long, y1 long, x2 long, y2 long")
    assert [r.direction for r in counting.crossings(d, (0.0, 0.5, 1.0, 0.5), 100, 100).collect()] == ([direction] if direction else [])


def test_votes(spark):
    d = spark.createDataFrame([(0, 1, i, c) for i, c in enumerate(["car", "bus", "car", "car"])] + [(0, 2, i, c) for i, c in enumerate(["motorcycle"] * 3 + ["scooter"] * 3 + ["car"] * 4)] + [(0, 3, 0, "bus"), (0, 3, 1, "car")], "camera_id long, track_id long, frame_idx long, raw_class string")
    assert {r.track_id: r.vehicle_class for r in counting.voted_class(d).collect()} == {1: "Car", 2: "Car", 3: "Bus"}


@pytest.mark.parametrize("raw,plate", [("KA05MHOI34", "KA05MH0134"), ("MA05AB1234", "MH05AB1234"), ("ZZ05AB1234", None), ("INDKA05NF9274X", "KA05NF9274"), ("", None), (None, None), ("22BH1234AB", "22BH1234AB"), ("228H12E4AB", None), ("K405AB1234", "KA05AB1234"), ("H405AB1234", None), ("0L05AB1234", "DL05AB1234")])
def test_plates(spark, raw, plate):
    df = spark.createDataFrame([(raw,)], "raw_text string")
    assert df.select(plate_text.extract(plate_text.clean(F.col("raw_text")))).first()[0] == plate


def test_repair_with_the_prior_state(spark):
    df = spark.createDataFrame([("KR05AB1234",), ("XKA05AB123",), ("K405",)], "t string")
    assert [r[0] for r in df.select(plate_text.repair(F.col("t"))).collect()][0] == "KA05AB1234"


def test_trajectory_fold():
    f = plates.fold_reads
    assert f([("KA05MH0134", 5.0, 0.3)]) is None  # one unsure read
    assert f([("KA05MH0134", 5.0, 0.5)]) == ("KA05MH0134", 1, 0.5, True)
    assert f([("KA05MH0134", 5.0, 0.3), ("KA05MH0135", 9.0, 0.4), ("TN01AA0001", 99.0, 0.9)]) == ("KA05MH0135", 2, 0.4, False)  # confirmed: later reads are not read


def test_labels(spark):
    cases = [("male_adult", 0.9, "male_adult"), ("Female", 0.5, "female_adult"), ("female child", 0.9, "child"), ("male", 0.49, "unknown"), ("robot", 0.9, "unknown")]
    df = spark.createDataFrame([c[:2] for c in cases], "l string, c double")
    assert [r[0] for r in df.select(labels.demographic(F.col("l"), F.col("c"))).collect()] == [c[2] for c in cases]
    short = labels.demographic(F.lit("x"), F.lit(0.2), height=F.lit(50.0), adult_height=F.lit(100.0))
    assert one(spark, short, labels.canonical_class(F.lit("SUV")), labels.canonical_class(F.lit("unheard"), F.lit(3)), labels.canonical_class(F.lit("tree")), labels.is_two_wheeler(F.lit("bicycle")), labels.title(F.lit("no_helmet")), labels.share_of_text(F.lit("88.0%"))) == ("child", "car", "motorcycle", None, False, "No Helmet", 0.88)


def test_consensus_and_median(spark):
    v = spark.createDataFrame([(0, 1, i, "male_adult", 0.9) for i in range(3)] + [(0, 2, 0, "child", 0.9), (0, 2, 1, "child", 0.9)] + [(0, 3, 0, "child", 0.9), (0, 3, 1, "male_adult", 0.9), (0, 3, 2, "child", 0.6), (0, 3, 3, "male_adult", 0.7)], "camera_id long, track_id long, frame_idx long, label string, conf double")
    assert {r.track_id: r.label for r in people.consensus(v).collect()} == {1: "male_adult", 2: "unknown", 3: "unknown"}
    p = spark.createDataFrame([(0, f) for f, n in enumerate([5, 5, 18]) for _ in range(n)] + [(1, f) for f, n in enumerate([2, 8, 8]) for _ in range(n)], "camera_id long, frame_idx long")
    assert {(r.camera_id, r.smoothed) for r in people.median_counts(p.withColumn("ts", F.timestamp_seconds("frame_idx"))).where("frame_idx = 2").collect()} == {(0, 5), (1, 8)}


def test_greedy_and_snapshots(spark):
    boxes = spark.createDataFrame([(1, 0, 0.9, 0, 0, 10, 10), (1, 1, 0.8, 1, 0, 11, 10), (1, 2, 0.7, 50, 50, 60, 60)], "image long, no long, conf double, x1 long, y1 long, x2 long, y2 long")
    got = helmets.suppressed(boxes, ["image"], "conf", ("x1", "y1", "x2", "y2"), "no", 0.35)
    assert [r.cluster for r in got.orderBy("no").collect()] == [0, 0, 2]
    null = spark.createDataFrame([(1, 0, None, 0, 0, 10, 10), (1, 1, 0.9, 1, 0, 11, 10), (1, 2, None, 50, 50, 60, 60)], boxes.schema)
    got = helmets.suppressed(null, ["image"], "conf", ("x1", "y1", "x2", "y2"), "no", 0.35)
    assert {(r.no, r.cluster) for r in got.collect()} == {(0, 1), (1, 1), (2, 2)}  # a box without a score comes last


def test_helmet_verdicts(spark):
    rows = [(0, 1, 0.9, 0.8, None, None), (0, 2, 0.1, 0.9, 0.9, 0.7), (0, 3, 0.9, 0.9, 0.9, 0.9), (0, 4, None, None, None, None), (0, 5, 0.4, 0.9, None, None), (0, 6, 0.1, 0.9, 0.2, 0.9)]
    d = spark.createDataFrame(rows, "camera_id long, track_id long, r_p double, r_conf double, p_p double, p_conf double")
    assert [r.verdict.split(" (")[0] + ("+" if "Rider + Pillion" in r.verdict else "") for r in helmets.verdict(d).orderBy("track_id").collect()] == ["VIOLATION", "VIOLATION", "VIOLATION+", "UNVERIFIED", "REVIEW", "COMPLIANT"]


def test_training_report(spark):
    rows = [(1.0, 0.5, 0.4), (2.0, 0.91, None), (3.0, 0.91, 0.6), (None, 0.99, 0.9)]
    curve = spark.createDataFrame(rows, "epoch double, `metrics/mAP50(B)` double, `metrics/recall(B)` double")
    scores = {"mAP@50": "metrics/mAP50(B)", "Recall": "metrics/recall(B)"}
    lines = [r.line for r in evaluation.training_report(curve, "epoch", scores, "mAP@50").orderBy("row_no").collect()]
    assert lines == [
        "# Training",
        "## Best epoch: 2", "| mAP@50 | 91.00 % |", "| Recall | - |", "Rating: EXCELLENT",
        "## Last epoch: 3", "| mAP@50 | 91.00 % |", "| Recall | 60.00 % |",
        "| epoch | mAP@50 | Recall |", "|-|-|-|", "| 1 | 50.00 % | 40.00 % |", "| 2 | 91.00 % | - |", "| 3 | 91.00 % | 60.00 % |",
    ]
    assert evaluation.training_report(curve.limit(0), "epoch", scores, "mAP@50").count() == 3


@pytest.mark.parametrize("plate,two", [("KA05MH0134", True), ("DL1CAB1234", False), ("22BH1234AB", False), ("", False), (None, False)])
def test_two_digit_plates(spark, plate, two):
    assert spark.createDataFrame([(plate,)], "plate string").select(plate_text.is_two_digit(F.col("plate"))).first()[0] is two


def test_running_sum_over_stretches(spark):
    rows = [(k, at, n) for k in ("a", None) for at, n in [(None, 3), (0, 1), (4, 2), (4, None), (5, 7), (23, 1)]]
    df = spark.createDataFrame(rows, "k string, at long, n long")
    low = lambda x: (x is not None, x or 0)
    want = [(k, at, sum(m or 0 for q, b, m in rows if q == k and low(b) <= low(at))) for k, at, _ in rows]
    got = [tuple(r) for r in counting.running_sum(df, ["k"], "at", "n", stretch=5).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert counting.running_sum(df.limit(0), ["k"], "at", "n").count() == 0


def test_carried_over_stretches(spark):
    rows = [(k, at, v) for k in ("a", None) for at, v in [(0, None), (1, 5), (7, None), (12, None), (13, 2), (40, None)]]
    df = spark.createDataFrame(rows, "k string, at long, v long")
    got = {(r.k, r["at"]): r.v for r in spatial.carried(df, ["k"], "at", "v", stretch=5).collect()}
    assert got == {(k, at): v for k in ("a", None) for at, v in [(0, None), (1, 5), (7, 5), (12, 5), (13, 2), (40, 2)]}
