"""Observation views over the ``events`` table.

The tables at hand hold no road data, so boxes, reads, votes and heads are
derived from events by integer arithmetic; the amount of each grows with the
table.  A frame is 640 by 1080.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH, HEIGHT = 640, 1080
RAW_CLASSES = ["car", "motorcycle", "scooter", "bus", "truck", "auto-rickshaw", "bicycle", "van"]
VOTE_LABELS = ["male_adult", "female_adult", "child"]
STATES = ["KA", "MH", "DL", "TN", "UP", "ZZ"]


def _pick(values: list[str], index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def whole(expression: str):
    return F.expr(expression).cast("long")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each observed box: the first of a track in a frame."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", F.col("user_id").alias("track_id"))
    e = e.withColumn("camera_id", F.col("event_id") % 2).withColumn("frame_idx", whole("(event_id - event_id % 40) / 40"))
    e = e.withColumn("obs_no", F.row_number().over(Window.partitionBy("camera_id", "track_id").orderBy("event_id")).cast("long"))
    first = F.row_number().over(Window.partitionBy("camera_id", "track_id", "frame_idx").orderBy("event_id"))
    e = e.withColumn("nth", first).where("nth = 1").drop("nth")
    e = e.withColumn("w", whole("40 + (track_id * 13) % 160")).withColumn("h", whole("60 + (track_id * 17) % 180"))
    e = e.withColumn("x1", whole("(track_id * 97 + obs_no * 11) % 400")).withColumn("y2", whole("220 + (track_id * 61 + obs_no * 47) % 840"))
    e = e.withColumn("x2", F.col("x1") + F.col("w")).withColumn("y1", F.col("y2") - F.col("h"))
    kind = F.when(F.col("track_id") % 5 == 0, "person").otherwise("vehicle")
    raw = _pick(RAW_CLASSES, F.expr("(track_id + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) % 8"))
    return e.select("event_id", "ts", "camera_id", "track_id", "frame_idx", "obs_no", "x1", "y1", "x2", "y2", "w", "h", kind.alias("kind"), F.expr("(35 + event_id % 60) / 100.0D").alias("confidence"), raw.alias("raw_class"))


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).where("kind = 'vehicle'")


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).where("kind = 'person'")


def plate_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vehicles(spark, sf_dir)
    letter = lambda x: F.char(F.expr(f"65 + {x}"))
    truth = F.concat(_pick(STATES, F.col("track_id") % 6), F.lpad(F.expr("string(track_id % 99 + 1)"), 2, "0"), letter("track_id % 26"), letter("(track_id * 7) % 26"), F.lpad(F.expr("string((track_id * 37) % 10000)"), 4, "0"))
    v = v.withColumn("truth", truth)
    raw = (
        F.when(F.expr("event_id % 6 = 0"), F.expr("concat(left(truth, length(truth) - 4), replace(right(truth, 4), '0', 'O'))"))
        .when(F.expr("event_id % 6 = 1"), F.concat(F.lit("IND"), "truth", F.lit("X")))
        .when(F.expr("event_id % 6 = 2"), F.expr("concat(left(truth, 2), '-', substr(truth, 3))"))
        .when(F.expr("event_id % 6 = 3"), F.expr("concat(left(truth, length(truth) - 1), string((int(right(truth, 1)) + 1) % 10))"))
        .when(F.expr("event_id % 6 = 4"), F.expr("left(truth, 5)"))
        .otherwise(F.col("truth"))
    )
    numbers = ["(50 + event_id % 50) / 100.0D AS det_conf", "(20 + event_id % 75) / 100.0D AS ocr_conf", "200 + (event_id % 9) * 100 AS bbox_area"]
    return v.select("event_id", "ts", "camera_id", "track_id", "frame_idx", "truth", raw.alias("raw_text"), *map(F.expr, numbers))


def plate_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vehicles(spark, sf_dir).where("event_id % 3 <> 0")
    v = v.withColumn("px1", whole("CASE WHEN event_id % 5 = 0 THEN x1 + w + 10 ELSE x1 + floor(w / 4) END"))
    return v.select("event_id", "camera_id", "frame_idx", "px1", F.expr("y2 - 20 - event_id % 9").alias("py1"), F.expr("px1 + 20 + event_id % 60").alias("px2"), F.expr("y2 - 2").alias("py2"), F.expr("(20 + event_id % 75) / 100.0D").alias("det_conf"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = _pick(VOTE_LABELS, F.expr("(bigint(floor(track_id / 5)) + CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END) % 3"))
    return persons(spark, sf_dir).select("event_id", "ts", "camera_id", "track_id", "frame_idx", "h", label.alias("model_label"), F.expr("(30 + event_id % 65) / 100.0D").alias("conf"))


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vehicles(spark, sf_dir).where("raw_class in ('motorcycle', 'scooter')")
    v = v.withColumn("head_no", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)]))).where("head_no < event_id % 4")
    v = v.withColumn("hx1", whole("x1 + (event_id * 29 + head_no * 53) % 100")).withColumn("hy1", whole("y1 + (event_id * 7 + head_no * 31) % 40")).withColumn("side", whole("18 + (event_id + head_no) % 9"))
    name = F.expr("CASE (track_id + head_no + event_id % 5) % 3 WHEN 0 THEN 'without_helmet' WHEN 1 THEN 'with_helmet' ELSE CASE WHEN event_id % 2 = 0 THEN 'head' ELSE 'helmet' END END")
    return v.select("event_id", "ts", "camera_id", "track_id", "frame_idx", "x1", "y1", "x2", "y2", "head_no", "hx1", "hy1", F.expr("hx1 + side").alias("hx2"), F.expr("hy1 + side").alias("hy2"), F.expr("(20 + (event_id + head_no * 17) % 75) / 100.0D").alias("conf"), name.alias("class_name"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = plate_reads(spark, sf_dir).where("length(raw_text) >= 5")
    r = r.withColumn("tok_no", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    text = F.expr("CASE WHEN tok_no = 0 THEN left(raw_text, 4) ELSE substr(raw_text, 5) END")
    r = r.select(F.col("event_id").alias("image_id"), "tok_no", text.alias("text"), F.col("ocr_conf").alias("conf"), whole("CASE WHEN event_id % 2 = 0 THEN 0 ELSE tok_no * 60 END").alias("tx1"), whole("CASE WHEN event_id % 2 = 0 THEN tok_no * 24 ELSE tok_no * 2 END").alias("ty1"))
    return r.select("image_id", "tok_no", "text", "conf", "tx1", "ty1", F.expr("tx1 + 50").alias("tx2"), F.expr("ty1 + 20").alias("ty2"))


def snaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vehicles(spark, sf_dir).where("(frame_idx + track_id) % 2 = 0").withColumn("sharpness", F.expr("(event_id * 37) % 500"))


# DuckDB's form of the same views.
_SQL = {
    "detections": (
        (),
        """SELECT event_id, ts, camera_id, track_id, frame_idx, obs_no, x1, y2 - h AS y1, x1 + w AS x2, y2, w, h, CASE WHEN track_id % 5 = 0 THEN 'person' ELSE 'vehicle' END AS kind, (35 + event_id % 60) / 100.0::DOUBLE AS confidence,
        (['car','motorcycle','scooter','bus','truck','auto-rickshaw','bicycle','van'])[(track_id + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) % 8 + 1] AS raw_class
        FROM (SELECT *, 40 + (track_id * 13) % 160 AS w, 60 + (track_id * 17) % 180 AS h, (track_id * 97 + obs_no * 11) % 400 AS x1, 220 + (track_id * 61 + obs_no * 47) % 840 AS y2
        FROM (SELECT event_id, ts, event_id % 2 AS camera_id, user_id AS track_id, (event_id - event_id % 40) // 40 AS frame_idx, row_number() OVER (PARTITION BY event_id % 2, user_id ORDER BY event_id) AS obs_no FROM events)
        QUALIFY row_number() OVER (PARTITION BY camera_id, track_id, frame_idx ORDER BY event_id) = 1)""",
    ),
    "vehicles": (("detections",), "SELECT * FROM detections WHERE kind = 'vehicle'"),
    "persons": (("detections",), "SELECT * FROM detections WHERE kind = 'person'"),
    "plate_reads": (
        ("vehicles",),
        """SELECT event_id, ts, camera_id, track_id, frame_idx, truth, CASE event_id % 6 WHEN 0 THEN truth[:-5] || replace(right(truth, 4), '0', 'O') WHEN 1 THEN 'IND' || truth || 'X' WHEN 2 THEN left(truth, 2) || '-' || substr(truth, 3) WHEN 3 THEN truth[:-2] || ((right(truth, 1)::INT + 1) % 10)::VARCHAR WHEN 4 THEN left(truth, 5) ELSE truth END AS raw_text,
        (50 + event_id % 50) / 100.0::DOUBLE AS det_conf, (20 + event_id % 75) / 100.0::DOUBLE AS ocr_conf, 200 + (event_id % 9) * 100 AS bbox_area
        FROM (SELECT *, (['KA','MH','DL','TN','UP','ZZ'])[track_id % 6 + 1] || lpad((track_id % 99 + 1)::VARCHAR, 2, '0') || chr((65 + track_id % 26)::INT) || chr((65 + (track_id * 7) % 26)::INT) || lpad(((track_id * 37) % 10000)::VARCHAR, 4, '0') AS truth FROM vehicles)""",
    ),
    "plate_boxes": (
        ("vehicles",),
        """SELECT event_id, camera_id, frame_idx, px1, y2 - 20 - event_id % 9 AS py1, px1 + 20 + event_id % 60 AS px2, y2 - 2 AS py2, (20 + event_id % 75) / 100.0::DOUBLE AS det_conf
        FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN x1 + w + 10 ELSE x1 + w // 4 END AS px1 FROM vehicles WHERE event_id % 3 <> 0)""",
    ),
    "votes": (("persons",), "SELECT event_id, ts, camera_id, track_id, frame_idx, h, (['male_adult','female_adult','child'])[(track_id // 5 + CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END) % 3 + 1] AS model_label, (30 + event_id % 65) / 100.0::DOUBLE AS conf FROM persons"),
    "heads": (
        ("vehicles",),
        """SELECT event_id, ts, camera_id, track_id, frame_idx, x1, y1, x2, y2, head_no, hx1, hy1, hx1 + side AS hx2, hy1 + side AS hy2, (20 + (event_id + head_no * 17) % 75) / 100.0::DOUBLE AS conf,
        CASE (track_id + head_no + event_id % 5) % 3 WHEN 0 THEN 'without_helmet' WHEN 1 THEN 'with_helmet' ELSE CASE WHEN event_id % 2 = 0 THEN 'head' ELSE 'helmet' END END AS class_name
        FROM (SELECT *, x1 + (event_id * 29 + head_no * 53) % 100 AS hx1, y1 + (event_id * 7 + head_no * 31) % 40 AS hy1, 18 + (event_id + head_no) % 9 AS side
        FROM (SELECT *, unnest([0::BIGINT, 1::BIGINT, 2::BIGINT]) AS head_no FROM vehicles WHERE raw_class IN ('motorcycle', 'scooter')) WHERE head_no < event_id % 4)""",
    ),
    "tokens": (
        ("plate_reads",),
        """SELECT image_id, tok_no, text, conf, tx1, ty1, tx1 + 50 AS tx2, ty1 + 20 AS ty2 FROM (SELECT event_id AS image_id, tok_no, CASE WHEN tok_no = 0 THEN left(raw_text, 4) ELSE substr(raw_text, 5) END AS text, ocr_conf AS conf, CASE WHEN event_id % 2 = 0 THEN 0 ELSE tok_no * 60 END AS tx1, CASE WHEN event_id % 2 = 0 THEN tok_no * 24 ELSE tok_no * 2 END AS ty1
        FROM (SELECT *, unnest([0::BIGINT, 1::BIGINT]) AS tok_no FROM plate_reads WHERE length(raw_text) >= 5))""",
    ),
    "snaps": (("vehicles",), "SELECT *, (event_id * 37) % 500 AS sharpness FROM vehicles WHERE (frame_idx + track_id) % 2 = 0"),
}


def sql(query: str, *views: str) -> str:
    """A DuckDB query with the views it names (and theirs) before it; a query may begin with further common tables."""
    order: list[str] = []

    def need(v: str) -> None:
        for x in _SQL[v][0]:
            need(x)
        if v not in order:
            order.append(v)

    for v in views:
        need(v)
    ctes = ", ".join(f"{v} AS ({_SQL[v][1]})" for v in order)
    body = query.strip()
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
