"""Readers and sinks on small files."""

import pytest

from pyspark.sql import functions as F

from kerbside.operators import datasets, evaluation, reports
from kerbside.sources import files

LOG_HEAD = "timestamp,total_vehicles,cars,trucks,buses,auto_rickshaws,motorcycles,scooters,bicycles,plates_detected,helmet_violations,violation_details,pedestrians_detected,males,females,children,unknown_pedestrians"


def row(second, total, plates="none", violations="none"):
    return f"2026-01-01T00:00:{second:02d},{total},{total},0,0,0,0,0,0,{plates},0,{violations},3,1,1,0,1"


@pytest.fixture()
def sections(spark):
    return {
        "counts": spark.createDataFrame([("Car", 3), ("Bus", 1)], "vehicle_class string, count long"),
        "humans": spark.createDataFrame([("total", 3), ("males", 1)], "category string, count long"),
        "vehicles": spark.createDataFrame([(10, "Car", "KA05MH0134", "N/A"), (2, "Bus", "not detected", "N/A")], "track_id long, vehicle_class string, plate_number string, helmet_status string"),
    }


def test_report_round_trip(spark, sections, tmp_path):
    reports.write_report(reports.report_lines(sections, "2026-01-01T00:01:00"), str(tmp_path / "r"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "r").glob("part-*")))
    assert "Bus,1\nCar,3\nTOTAL,4\n" in text and text.index("2,Bus") < text.index("10,Car")
    log = tmp_path / "log.csv"
    log.write_text("\n".join([LOG_HEAD, row(1, 2, "7:KA01AB1234|8:KA02AB1234"), row(2, 4, "9:KA01AB1234", "7:no_helmet_rider|7:no_helmet_pillion")]) + "\n" + text)
    series, body = files.parsed_log(files.numbered_lines(spark, str(log)))
    typed = files.log_series(series)
    assert [(r.total_vehicles, r.plates_detected) for r in typed.orderBy("line_no").collect()] == [(2, "7:KA01AB1234|8:KA02AB1234"), (4, "9:KA01AB1234")]
    assert {tuple(r)[2:] for r in files.report_section(body, "vehicles").collect()} == {("10", "Car", "KA05MH0134", "N/A"), ("2", "Bus", "not detected", "N/A")}
    assert {tuple(r)[2:] for r in files.report_section(body, "counts").collect()} == {("Bus", "1"), ("Car", "3"), ("TOTAL", "4")}
    assert {tuple(r) for r in reports.unique_plates(typed).collect()} == {("KA01AB1234", "7"), ("KA02AB1234", "8")}
    assert [tuple(r) for r in reports.violation_tracks(typed).collect()] == [("7", "NO HELMET", "NO HELMET")]
    h = reports.headline(typed).first()
    assert (h.total, h.people, h.unknown) == (4, 3, 1)


def test_snapshot_log_and_csv_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n".join([LOG_HEAD, row(1, 2), row(2, 0)]))
    log = files.snapshot_log(spark, str(tmp_path / "a.csv"))
    assert reports.non_empty(log).count() == 1 and len(log.columns) == 17
    reports.write_csv(spark.createDataFrame([(1, "x,y", "r1")], "track_id long, plate string, run_id string"), str(tmp_path / "o"), quoted=True, by=("run_id",))
    assert next((tmp_path / "o" / "run_id=r1").glob("*.csv")).read_text() == '"track_id","plate"\n"1","x,y"\n'


def test_annotations(spark, tmp_path):
    d = tmp_path / "labels" / "train"
    d.mkdir(parents=True)
    (d / "a.txt").write_text("0 0.5 0.5 0.2 0.2\n3 0.1 0.1 0.1 0.1\nbad line\n1 2 3\n")
    (d / "b.txt").write_text("\n")  # Spark lists no files without a byte
    y = files.yolo_labels(spark, str(tmp_path / "labels"))
    assert {(r.stem, r.class_id, r.raw_class) for r in y.collect()} == {("a", 0, 0), ("a", 0, 3)}
    assert [tuple(r) for r in files.sanitised(y).collect()] == [("a", 2, 1)]
    inv = files.inventory(spark, str(tmp_path / "labels"), "*.txt")
    assert {(r.stem, r.folder) for r in inv.collect()} == {("a", "train"), ("b", "train")} and "content" not in inv.columns
    (tmp_path / "x.xml").write_text("<annotation><filename>img1.jpg</filename><size><width>100</width><height>50</height></size><object><name>p</name><bndbox><xmin>90</xmin><ymin>10</ymin><xmax>120</xmax><ymax>30</ymax></bndbox></object><object><name>q</name><bndbox><xmin>5</xmin><ymin>5</ymin><xmax>5</xmax><ymax>9</ymax></bndbox></object></annotation>")
    v = files.voc_boxes(spark, str(tmp_path / "x.xml"))
    assert [tuple(r) for r in files.yolo_lines(v).collect()] == [("img1", "0 0.950000 0.400000 0.100000 0.400000")]
    images = spark.createDataFrame([("a",), ("z",)], "stem string")
    cand = spark.createDataFrame([("a", "/2", 2), ("a", "/1", 1)], "stem string, path string, priority int")
    assert {(r.stem, r.label_path) for r in files.label_of_image(images, cand).collect()} == {("a", "/1"), ("z", None)}


def test_labels_curve_and_markdown(spark, tmp_path):
    (tmp_path / "l.csv").write_text("crop_file,true_label\na.jpg, Male \nb.jpg,\n")
    done, pending = files.evaluation_labels(spark, str(tmp_path / "l.csv"))
    assert [tuple(r) for r in done.collect()] == [("a.jpg", "male")] and pending.count() == 1
    (tmp_path / "c.csv").write_text("  epoch,   metrics/mAP50(B)\n 1, 0.5\n 2, 0.93\n 3, 0.93\n 4, x\n")
    c = files.training_curve(spark, str(tmp_path / "c.csv")).withColumnRenamed("metrics/mAP50(B)", "score")
    assert tuple(evaluation.best_epoch(c.where("score is not null"), "epoch", "score").first()) == (2.0, 0.93, "EXCELLENT")
    rows = spark.createDataFrame([("male", "male")] * 129 + [("male", "female")] + [("female", "male")] * 19 + [("female", "female")] * 9, "truth string, pred string")
    m = {r["class"]: r for r in evaluation.class_metrics(rows).collect()}
    assert round(m["male"].precision, 3) == 0.872 and round(m["male"].recall, 3) == 0.992 and round(m["female"].f1, 3) == 0.474
    assert evaluation.accuracy(rows).first().accuracy == round(138 / 158, 6)
    lines = [r.line for r in evaluation.markdown(evaluation.class_metrics(rows), evaluation.confusion(rows, ["male", "female"]), ["male", "female"]).orderBy("row_no").collect()]
    assert "| female | 90.0 % | 32.1 % | 47.4 % | 28 |" in lines and "| male | 129 | 1 | 0 |" in lines


def test_split_manifest(spark, tmp_path):
    s = datasets.split(spark.range(2021).withColumnRenamed("id", "stem"), "stem")
    datasets.write_split(s, str(tmp_path / "m"))
    n = {r["split"]: r["count"] for r in spark.read.parquet(str(tmp_path / "m")).groupBy("split").count().collect()}
    assert n == {"train": 1616, "val": 202, "test": 203}


def test_keep_first(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (1, 5), (5, 6)]
    p = spark.createDataFrame(pairs, "k long, other long")
    kept = {r.k for r in datasets.keep_first(p, spark.createDataFrame([(i,) for i in range(1, 8)], "k long"), "k").collect()}
    want = set()
    for i in range(1, 8):
        if not any((j, i) in pairs for j in want):
            want.add(i)
    assert kept == want


def test_sheets_and_appended_logs(spark, tmp_path):
    rows = spark.createDataFrame([(0, 7, "Car", None, None, "2024-05-01 10:20:30", 0.876, "no_helmet", "none"), (0, 2, None, "KA01AB1234", "COMPLIANT", "2024-05-01 00:00:00", 0.5, "helmet", "helmet")], "camera_id long, track_id long, vehicle_class string, plate string, helmet_status string, ts string, conf double, rider_helmet string, pillion_helmet string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [tuple(r) for r in reports.plates_sheet(rows).collect()] == [("#7", "Car", None, "88%", "10:20:30"), ("#2", "Car", "KA01AB1234", "50%", "00:00:00")]
    assert [tuple(r) for r in reports.two_wheelers_sheet(rows).collect()] == [("#7", "Car", "not detected", "NO HELMET", "None", "VIOLATION"), ("#2", "Bike/Motorcycle", "KA01AB1234", "HELMET", "HELMET", "COMPLIANT")]
    assert [tuple(r) for r in reports.crossings_sheet(rows).collect()] == [("#7", "Car", "not detected", "N/A"), ("#2", "Unknown", "KA01AB1234", "COMPLIANT")]
    for _ in range(2):
        reports.write_csv(reports.crossings_sheet(rows), str(tmp_path / "log"), quoted=True, mode="append")
    back = spark.read.option("header", True).csv(str(tmp_path / "log"))
    assert back.count() == 4 and back.columns[0] == "Track ID" and back.where("`Track ID` = 'Track ID'").count() == 0
    extra = rows.withColumns({c: F.lit("x") for c in reports.DETAILED if c not in rows.columns})
    reports.write_detailed(extra, str(tmp_path / "detail"))
    back = spark.read.option("header", True).csv(str(tmp_path / "detail"))
    assert back.columns == reports.DETAILED and [r.track_id for r in back.collect()] == ["2", "7"]
