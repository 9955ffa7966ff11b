"""Queries on counting, boxes and people, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbside.functions import geometry as g
from kerbside.functions import labels
from kerbside.operators import counting, people, plates, spatial
from kerbside.plans import vehicles as plates_sql
from kerbside.sources import observations as o

REPORTING_SQL = "CASE {} WHEN 'car' THEN 'Car' WHEN 'motorcycle' THEN 'Bike/Motorcycle' WHEN 'scooter' THEN 'Bike/Motorcycle' WHEN 'bus' THEN 'Bus' WHEN 'truck' THEN 'Truck' WHEN 'auto-rickshaw' THEN 'Auto Rickshaw' WHEN 'bicycle' THEN 'Bicycle' WHEN 'van' THEN 'Van' ELSE 'Others' END"
VOTED = f"""voted AS (SELECT camera_id, track_id, raw_class AS voted_class, {REPORTING_SQL.format("raw_class")} AS vehicle_class, n_obs FROM (SELECT *, sum(n) OVER (PARTITION BY camera_id, track_id) AS n_obs, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY n DESC, f) AS rk FROM (SELECT camera_id, track_id, raw_class, count(*) AS n, min(frame_idx) AS f FROM vehicles GROUP BY ALL)) WHERE rk = 1)"""


def crossed_sql(bx: int) -> str:
    """First crossings of the line (0, 702)-(bx, 702)."""
    side = f"sign(({{1}} - 702) * ({bx} - 0) - (702 - 702) * ({{0}} - 0))"
    cut = "sign(({1} - py) * (x - px) - (y - py) * ({0} - px))"
    return f"""steps AS (SELECT *, lag(x) OVER t AS px, lag(y) OVER t AS py FROM (SELECT camera_id, track_id, frame_idx, (x1 + x2) // 2 AS x, y2 AS y FROM vehicles) WINDOW t AS (PARTITION BY camera_id, track_id ORDER BY frame_idx)),
crossed AS (SELECT camera_id, track_id, frame_idx, CASE WHEN {side.format("x", "y")} > 0 THEN 'INBOUND' ELSE 'OUTBOUND' END AS direction FROM steps WHERE px IS NOT NULL AND {side.format("px", "py")} <> {side.format("x", "y")} AND {side.format("px", "py")} <> 0 AND {cut.format("0", "702")} <> {cut.format(str(bx), "702")} QUALIFY row_number() OVER (PARTITION BY camera_id, track_id ORDER BY frame_idx) = 1)"""


OVERLAP = "greatest(0, least({0}x2, {1}x2) - greatest({0}x1, {1}x1)) * greatest(0, least({0}y2, {1}y2) - greatest({0}y1, {1}y1))"
PEDESTRIANS = f"""peds AS (SELECT * FROM persons p WHERE NOT EXISTS (SELECT 1 FROM vehicles v WHERE v.camera_id = p.camera_id AND v.frame_idx = p.frame_idx AND (
({OVERLAP.format("p.", "v.")})::DOUBLE / ((p.x2 - p.x1) * (p.y2 - p.y1)) >= 0.5 OR (regexp_matches(v.raw_class, 'bike|motorcycle|scooter|two-wheeler|bicycle|auto|rickshaw|three-wheeler') AND (p.x1 + p.x2) / 2.0::DOUBLE BETWEEN v.x1 AND v.x2 AND (p.y1 + p.y2) / 2.0::DOUBLE BETWEEN v.y1 - (v.y2 - v.y1) * 0.4::DOUBLE AND v.y2))))"""
BY_IOU = f"""olds AS (SELECT * FROM persons p WHERE NOT EXISTS (SELECT 1 FROM vehicles v WHERE v.camera_id = p.camera_id AND v.frame_idx = p.frame_idx AND ({OVERLAP.format("p.", "v.")})::DOUBLE / ((p.x2 - p.x1) * (p.y2 - p.y1) + (v.x2 - v.x1) * (v.y2 - v.y1) - {OVERLAP.format("p.", "v.")}) >= 0.3))"""
MATCHED = f"""matched AS (SELECT p.event_id AS plate_id, camera_id, frame_idx, v.track_id, round(({OVERLAP.format("p.p", "v.")})::DOUBLE / ((px2 - px1) * (py2 - py1)), 6) AS share, det_conf FROM plate_boxes p JOIN vehicles v USING (camera_id, frame_idx) WHERE ({OVERLAP.format("p.p", "v.")})::DOUBLE / ((px2 - px1) * (py2 - py1)) >= 0.4 QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY ({OVERLAP.format("p.p", "v.")})::DOUBLE / ((px2 - px1) * (py2 - py1)) DESC, v.track_id) = 1)"""
LABEL = "CASE WHEN conf < 0.5 THEN 'unknown' ELSE model_label END"
ACCEPTED = "accepted AS (SELECT *, model_label AS label FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY frame_idx) AS attempt FROM votes) WHERE attempt <= 10 AND conf >= 0.5)"
#: The leading label over the latest 15 votes at each vote.
ROLLING = """w AS (SELECT a.camera_id, a.track_id, a.frame_idx, b.label, b.conf FROM accepted a JOIN accepted b ON a.camera_id = b.camera_id AND a.track_id = b.track_id AND b.frame_idx <= a.frame_idx QUALIFY row_number() OVER (PARTITION BY a.camera_id, a.track_id, a.frame_idx ORDER BY b.frame_idx DESC) <= 15),
l AS (SELECT camera_id, track_id, frame_idx, label, round(sum(conf), 6) AS s, sum(conf) AS raw, count(*) AS n FROM w GROUP BY ALL),
rolling AS (SELECT camera_id, track_id, frame_idx, label AS "leading", round(s / total, 6) AS share, n_window::BIGINT AS n_window FROM (SELECT *, sum(raw) OVER p AS total, sum(n) OVER p AS n_window, row_number() OVER (PARTITION BY camera_id, track_id, frame_idx ORDER BY s DESC, label DESC) AS rk FROM l WINDOW p AS (PARTITION BY camera_id, track_id, frame_idx)) WHERE rk = 1)"""
CONSENSUS = """agreed AS (SELECT camera_id, track_id, n_votes::BIGINT AS n_votes, CASE WHEN n_votes >= 3 AND round(s / total, 9) >= 0.6 THEN label ELSE 'unknown' END AS label, round(s / total, 6) AS share FROM (SELECT *, sum(s) OVER (PARTITION BY camera_id, track_id) AS total, sum(n) OVER (PARTITION BY camera_id, track_id) AS n_votes, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY round(s, 9) DESC, f) AS rk FROM (SELECT camera_id, track_id, label, sum(conf) AS s, count(*) AS n, min(frame_idx) AS f FROM accepted GROUP BY ALL)) WHERE rk = 1)"""


def resolved_observations(spark, sf):
    d = o.vehicles(spark, sf)
    name = F.when(F.col("event_id") % 3 == 0, F.upper(F.replace("raw_class", F.lit("-"), F.lit("_")))).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), "raw_class")).otherwise(F.lit("SUV"))
    c = labels.canonical_class(name)
    return d.select("event_id", c.alias("canonical"), labels.reporting_class(c).alias("vehicle_class"), labels.is_two_wheeler(c).alias("two_wheeler")).where("canonical is not null")


def plate_attempts(spark, sf):
    from pyspark.sql import Window

    d = o.vehicles(spark, sf).where(F.col("raw_class").isin(labels.PLATE_CLASSES) & ~F.col("raw_class").isin(labels.NO_PLATE_CLASSES) & (F.col("y2") - F.col("y1") >= 35) & ((F.col("frame_idx") + F.col("track_id")) % 2 == 0))
    n = F.row_number().over(Window.partitionBy("camera_id", "track_id").orderBy("frame_idx"))
    return d.withColumn("attempt", n.cast("long")).where("attempt <= 15").select("event_id", "camera_id", "track_id", "attempt")


def plausible_plates(spark, sf):
    p = o.plate_boxes(spark, sf).withColumn("w", F.col("px2") - F.col("px1")).withColumn("h", F.col("py2") - F.col("py1"))
    ratio = F.col("w") / F.col("h")
    return p.where((F.col("w") > 2) & (F.col("h") > 2)).select("event_id", ratio.between(0.8, 6.5).alias("plausible"), ratio.between(0.5, 8.5).alias("plausible_close"), F.round(ratio, 6).alias("ratio"))


def crop_quality(spark, sf):
    d = o.persons(spark, sf).withColumn("sharpness", F.expr("(event_id * 37) % 500"))
    inside = (F.col("x1") >= 3) & (F.col("y1") >= 3) & (F.col("x2") <= o.WIDTH - 3) & (F.col("y2") <= o.HEIGHT - 3)
    return d.select("event_id", (F.col("h") >= 60).alias("tall"), ((F.col("h") >= 80) & (F.col("w") >= 30) & inside & (F.col("sharpness") >= 20)).alias("usable"))


def snapshot_candidates(spark, sf):
    d = o.snaps(spark, sf).where("h >= 40 and w >= 8")
    two = labels.is_two_wheeler(F.col("raw_class"))
    grow = [F.when(two, F.lit(a)).otherwise(F.lit(0.06)) for a in (0.15, 0.95, 0.15, 0.06)]
    e = g.expanded(g.box(), *grow, o.WIDTH, o.HEIGHT)
    c = g.clipped(g.box(), o.WIDTH, o.HEIGHT)
    is_clipped = (F.col("x1") <= 2) | (F.col("y1") <= 2) | (F.col("x2") >= o.WIDTH - 2) | (F.col("y2") >= o.HEIGHT - 2)
    score = F.round(g.snapshot_score(g.box(), F.col("sharpness"), F.col("confidence"), is_clipped), 6)
    return d.select("event_id", *[x.alias(f"e{n}") for x, n in zip(e, ("x1", "y1", "x2", "y2"))], *[x.alias(f"c{n}") for x, n in zip(c, ("x1", "y1", "x2", "y2"))], is_clipped.alias("clipped"), score.alias("score"), (F.col("x1") - e[0]).alias("in_crop_x"), (F.col("y1") - e[1]).alias("in_crop_y"))


def merged_detections(spark, sf):
    v = o.vehicles(spark, sf).select("event_id", F.col("track_id").alias("merged_id"), (F.array_position(F.array(*map(F.lit, labels.CANONICAL)), F.col("raw_class")) + 9).alias("class_id"))
    p = o.persons(spark, sf).select("event_id", (F.col("track_id") + 100_000).alias("merged_id"), F.lit(0).cast("long").alias("class_id"))
    return v.unionByName(p)


def plate_as_of_check(spark, sf):
    """The plate known for a two-wheeler when its helmets are looked at."""
    reads = plates.corrected(o.plate_reads(spark, sf)).where("plate is not null").select("camera_id", "track_id", "frame_idx", "plate")
    checks = o.vehicles(spark, sf).where("raw_class in ('motorcycle', 'scooter')").select("camera_id", "track_id", "frame_idx", "event_id")
    return spatial.as_of(checks, reads, ["camera_id", "track_id"], "frame_idx", "plate").select("event_id", F.coalesce("plate", F.lit("UNKNOWN")).alias("plate"))


def tick_counts(spark, sf):
    """Ticks of ten frames, each with the newest count of crossed tracks."""
    c = counting.crossings(o.vehicles(spark, sf)).groupBy("camera_id", "frame_idx").agg(F.count("*").alias("so_far"))
    ticks = o.vehicles(spark, sf).groupBy("camera_id").agg(F.max("frame_idx").alias("last")).select("camera_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(10).cast("long"))).alias("frame_idx"))
    both = ticks.select("*", F.lit(0).cast("long").alias("so_far"), F.lit(True).alias("is_tick")).unionByName(c.select("camera_id", "frame_idx", "so_far", F.lit(False).alias("is_tick")))
    return counting.running_sum(both, ["camera_id"], "frame_idx", "so_far").where("is_tick").select("camera_id", F.col("frame_idx").alias("tick"), "so_far")


def _peds(spark, sf):
    return spatial.pedestrians(o.persons(spark, sf), o.vehicles(spark, sf))


QUERIES = {
    "resolved_observations": (
        resolved_observations,
        o.sql(f"""SELECT event_id, canonical, {REPORTING_SQL.format("canonical")} AS vehicle_class, regexp_matches(canonical, 'bike|motorcycle|scooter|moped') AS two_wheeler FROM (SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'car' ELSE raw_class END AS canonical FROM vehicles)""", "vehicles"),
    ),
    "plate_attempts": (plate_attempts, o.sql("SELECT event_id, camera_id, track_id, attempt FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY frame_idx) AS attempt FROM vehicles WHERE raw_class IN ('car','truck','bus','auto-rickshaw','motorcycle','scooter') AND y2 - y1 >= 35 AND (frame_idx + track_id) % 2 = 0) WHERE attempt <= 15", "vehicles")),
    "plausible_plates": (plausible_plates, o.sql("SELECT event_id, r BETWEEN 0.8 AND 6.5 AS plausible, r BETWEEN 0.5 AND 8.5 AS plausible_close, round(r, 6) AS ratio FROM (SELECT *, (px2 - px1)::DOUBLE / (py2 - py1) AS r FROM plate_boxes WHERE px2 - px1 > 2 AND py2 - py1 > 2)", "plate_boxes")),
    "crop_quality": (crop_quality, o.sql("SELECT event_id, h >= 60 AS tall, h >= 80 AND w >= 30 AND x1 >= 3 AND y1 >= 3 AND x2 <= 637 AND y2 <= 1077 AND (event_id * 37) % 500 >= 20 AS usable FROM persons", "persons")),
    "snapshot_candidates": (
        snapshot_candidates,
        o.sql("""WITH s AS (SELECT *, raw_class IN ('motorcycle', 'scooter') AS two FROM snaps WHERE h >= 40 AND w >= 8),
e AS (SELECT *, greatest(0, trunc(x1 - w * CASE WHEN two THEN 0.15::DOUBLE ELSE 0.06::DOUBLE END)::BIGINT) AS ex1, greatest(0, trunc(y1 - h * CASE WHEN two THEN 0.95::DOUBLE ELSE 0.06::DOUBLE END)::BIGINT) AS ey1, least(640, trunc(x2 + w * CASE WHEN two THEN 0.15::DOUBLE ELSE 0.06::DOUBLE END)::BIGINT) AS ex2, least(1080, trunc(y2 + h * 0.06::DOUBLE)::BIGINT) AS ey2, x1 <= 2 OR y1 <= 2 OR x2 >= 638 OR y2 >= 1078 AS clipped FROM s)
SELECT event_id, ex1, ey1, ex2, ey2, greatest(0, x1) AS cx1, greatest(0, y1) AS cy1, least(640, x2) AS cx2, least(1080, y2) AS cy2, clipped, round(sqrt((w * h)::DOUBLE) * (least(sharpness, 400) / 400.0::DOUBLE + 0.2::DOUBLE) * CASE WHEN clipped THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * (confidence + 0.5::DOUBLE), 6) AS score, x1 - ex1 AS in_crop_x, y1 - ey1 AS in_crop_y FROM e""", "snaps"),
    ),
    "merged_detections": (merged_detections, o.sql("SELECT event_id, track_id AS merged_id, list_position(['car','truck','bus','auto-rickshaw','motorcycle','scooter','bicycle','van'], raw_class) + 9::BIGINT AS class_id FROM vehicles UNION ALL SELECT event_id, track_id + 100000, 0 FROM persons", "vehicles", "persons")),
    "voted_classes": (lambda s, d: counting.voted_class(o.vehicles(s, d)), o.sql(f"WITH {VOTED} SELECT camera_id, track_id, voted_class, n_obs::BIGINT AS n_obs, vehicle_class FROM voted", "vehicles")),
    "last_seen": (lambda s, d: counting.last_seen(o.vehicles(s, d)), o.sql("SELECT camera_id, track_id, max(frame_idx) AS last_frame, arg_max(raw_class, frame_idx) AS last_class FROM vehicles GROUP BY ALL", "vehicles")),
    "first_crossings": (lambda s, d: counting.crossings(o.vehicles(s, d), counting.SHORT_LINE), o.sql(f"WITH {crossed_sql(128)} SELECT * FROM crossed", "vehicles")),
    "crossing_report": (
        lambda s, d: counting.crossing_report(o.vehicles(s, d)),
        o.sql(f"WITH {VOTED}, {crossed_sql(128)} SELECT coalesce(direction, 'TOTAL') AS direction, coalesce(vehicle_class, 'TOTAL') AS vehicle_class, count(*) AS n_tracks FROM crossed JOIN voted USING (camera_id, track_id) GROUP BY ROLLUP (direction, vehicle_class)", "vehicles"),
    ),
    "class_counts": (
        lambda s, d: counting.class_counts(counting.crossed_classes(o.vehicles(s, d))),
        o.sql(f"WITH {VOTED}, {crossed_sql(640)}, j AS (SELECT * FROM crossed JOIN voted USING (camera_id, track_id)) SELECT c.vehicle_class, count(track_id) AS n FROM (VALUES ('Car'), ('Bike/Motorcycle'), ('Bus'), ('Truck'), ('Auto Rickshaw'), ('Bicycle'), ('Van'), ('Others')) c(vehicle_class) LEFT JOIN j USING (vehicle_class) GROUP BY ALL UNION ALL SELECT 'TOTAL', count(*) FROM j", "vehicles"),
    ),
    "direction_pivot": (
        lambda s, d: counting.direction_pivot(counting.crossed_classes(o.vehicles(s, d), counting.SHORT_LINE)),
        o.sql(f"WITH {VOTED}, {crossed_sql(128)} SELECT vehicle_class, count(*) FILTER (direction = 'INBOUND') AS inbound, count(*) FILTER (direction = 'OUTBOUND') AS outbound FROM crossed JOIN voted USING (camera_id, track_id) GROUP BY ALL", "vehicles"),
    ),
    "frame_counts": (lambda s, d: counting.frame_counts(o.vehicles(s, d)), o.sql("SELECT camera_id, frame_idx, " + ", ".join(f"count(*) FILTER (raw_class = '{c}') AS n_{c.replace('-', '_')}" for c in labels.CANONICAL) + ", count(*) AS total FROM vehicles GROUP BY ALL", "vehicles")),
    "running_votes": (
        lambda s, d: counting.running_votes(o.vehicles(s, d)),
        o.sql("SELECT a.camera_id, a.track_id, a.frame_idx, (SELECT raw_class FROM (SELECT raw_class, count(*) AS n, min(frame_idx) AS f FROM vehicles b WHERE b.camera_id = a.camera_id AND b.track_id = a.track_id AND b.frame_idx <= a.frame_idx GROUP BY raw_class) ORDER BY n DESC, f LIMIT 1) AS leading, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY frame_idx) AS age FROM vehicles a", "vehicles"),
    ),
    "cumulative_counts": (
        lambda s, d: counting.cumulative_counts(counting.crossed_classes(o.vehicles(s, d), counting.SHORT_LINE)),
        o.sql(f"WITH {VOTED}, {crossed_sql(128)} SELECT DISTINCT camera_id, vehicle_class, frame_idx, (count(*) OVER (PARTITION BY camera_id, vehicle_class ORDER BY frame_idx RANGE UNBOUNDED PRECEDING))::BIGINT AS n_so_far FROM crossed JOIN voted USING (camera_id, track_id)", "vehicles"),
    ),
    "plates_to_vehicles": (lambda s, d: spatial.plates_to_vehicles(o.plate_boxes(s, d), o.vehicles(s, d)), o.sql(f"WITH {MATCHED} SELECT * FROM matched", "plate_boxes", "vehicles")),
    "plate_crop_pass": (
        lambda s, d: spatial.crop_pass(o.plate_boxes(s, d), o.vehicles(s, d), spatial.plates_to_vehicles(o.plate_boxes(s, d), o.vehicles(s, d))),
        o.sql(f"""WITH {MATCHED}, top AS (SELECT * FROM vehicles v WHERE raw_class IN ('motorcycle', 'scooter', 'auto-rickshaw') AND (frame_idx + track_id) % 2 = 0 AND NOT EXISTS (SELECT 1 FROM matched m WHERE m.camera_id = v.camera_id AND m.frame_idx = v.frame_idx AND m.track_id = v.track_id) QUALIFY row_number() OVER (PARTITION BY camera_id, frame_idx ORDER BY (x2 - x1) * (y2 - y1) DESC, track_id) <= 6)
SELECT camera_id, frame_idx, track_id, p.event_id AS plate_id, det_conf FROM top JOIN plate_boxes p USING (camera_id, frame_idx) WHERE x2 - x1 > 8 AND y2 - y1 > 8 AND px2 - px1 > 2 AND py2 - py1 > 2 AND (px2 - px1)::DOUBLE / (py2 - py1) BETWEEN 0.8 AND 6.5 AND (px1 + px2) / 2.0::DOUBLE BETWEEN x1 AND x2 AND (py1 + py2) / 2.0::DOUBLE BETWEEN y1 AND y2 QUALIFY row_number() OVER (PARTITION BY camera_id, frame_idx, track_id ORDER BY det_conf DESC, p.event_id) = 1""", "plate_boxes", "vehicles"),
    ),
    "pedestrians": (lambda s, d: _peds(s, d).select("event_id"), o.sql(f"WITH {PEDESTRIANS} SELECT event_id FROM peds", "persons", "vehicles")),
    "rule_comparison": (
        lambda s, d: spatial.compare_rules(o.persons(s, d), o.vehicles(s, d)),
        o.sql(f"WITH {PEDESTRIANS}, {BY_IOU}, t AS (SELECT 'rows' AS metric, (SELECT count(*) FROM olds) AS old, (SELECT count(*) FROM peds) AS new UNION ALL SELECT 'tracks', (SELECT count(DISTINCT (camera_id, track_id)) FROM olds), (SELECT count(DISTINCT (camera_id, track_id)) FROM peds)) SELECT *, new - old AS change FROM t", "persons", "vehicles"),
    ),
    "plate_as_of_check": (
        plate_as_of_check,
        o.sql(f"WITH {plates_sql.CORRECTED} SELECT v.event_id, coalesce(r.plate, 'UNKNOWN') AS plate FROM (SELECT * FROM vehicles WHERE raw_class IN ('motorcycle', 'scooter')) v ASOF LEFT JOIN (SELECT * FROM reads WHERE plate IS NOT NULL) r ON v.camera_id = r.camera_id AND v.track_id = r.track_id AND v.frame_idx >= r.frame_idx", "plate_reads"),
    ),
    "tick_counts": (
        tick_counts,
        o.sql(f"WITH {crossed_sql(640)} SELECT t.camera_id, tick, (SELECT count(*) FROM crossed c WHERE c.camera_id = t.camera_id AND c.frame_idx <= tick) AS so_far FROM (SELECT camera_id, unnest(range(0, max(frame_idx) + 1, 10)) AS tick FROM vehicles GROUP BY camera_id) t", "vehicles"),
    ),
    "demographic_consensus": (lambda s, d: people.consensus(people.accepted_votes(o.votes(s, d))), o.sql(f"WITH {ACCEPTED}, {CONSENSUS} SELECT * FROM agreed", "votes")),
    "rolling_votes": (
        lambda s, d: people.rolling_votes(people.accepted_votes(o.votes(s, d))),
        o.sql(f"WITH {ACCEPTED}, {ROLLING} SELECT * FROM rolling", "votes"),
    ),
    "session_pedestrians": (
        lambda s, d: people.session_totals(_peds(s, d), people.consensus(people.accepted_votes(o.votes(s, d)))),
        o.sql(f"WITH {PEDESTRIANS}, {ACCEPTED}, {CONSENSUS}, s AS (SELECT camera_id, track_id FROM peds WHERE h >= 60 GROUP BY ALL HAVING count(*) >= 8), j AS (SELECT coalesce(label, 'unknown') AS label FROM s LEFT JOIN agreed USING (camera_id, track_id)) SELECT count(*) AS total, count(*) FILTER (label = 'male_adult') AS males, count(*) FILTER (label = 'female_adult') AS females, count(*) FILTER (label = 'child') AS children, count(*) FILTER (label = 'unknown') AS unknown FROM j", "persons", "vehicles", "votes"),
    ),
    "frame_pedestrians": (
        lambda s, d: people.frame_summary(o.votes(s, d)),
        o.sql(f"SELECT camera_id, frame_idx, count(*) AS total, count(*) FILTER (label = 'male_adult') AS males, count(*) FILTER (label = 'female_adult') AS females, count(*) FILTER (label = 'child') AS children, count(*) FILTER (label = 'unknown') AS unknown, string_agg(lpad(track_id::VARCHAR, 12, '0') || ':' || label, '|' ORDER BY lpad(track_id::VARCHAR, 12, '0') || ':' || label) AS details FROM (SELECT *, {LABEL} AS label FROM votes) GROUP BY ALL", "votes"),
    ),
    "vote_tally": (lambda s, d: people.tally(o.votes(s, d)), o.sql("SELECT CASE model_label WHEN 'male_adult' THEN 'males' WHEN 'female_adult' THEN 'females' ELSE 'children' END AS category, count(*) AS n FROM votes GROUP BY ALL", "votes")),
    "adult_height": (
        lambda s, d: people.adult_height(o.votes(s, d), people.accepted_votes(o.votes(s, d)), o.detections(s, d).select("camera_id", "frame_idx").distinct()),
        o.sql(f"""WITH {ACCEPTED}, {ROLLING}, known AS (SELECT camera_id, track_id, frame_idx, CASE WHEN n_window >= 3 AND share >= 0.6 THEN "leading" ELSE 'unknown' END AS label FROM rolling),
p AS (SELECT v.camera_id, v.frame_idx, v.h, k.label FROM votes v ASOF LEFT JOIN known k ON v.camera_id = k.camera_id AND v.track_id = k.track_id AND v.frame_idx >= k.frame_idx),
m AS (SELECT camera_id, frame_idx, round(coalesce(avg(h) FILTER (label IN ('male_adult', 'female_adult')), avg(h)), 6) AS mean_height FROM p GROUP BY ALL)
SELECT f.camera_id, f.frame_idx, m.mean_height FROM (SELECT DISTINCT camera_id, frame_idx FROM detections) f ASOF LEFT JOIN m ON f.camera_id = m.camera_id AND f.frame_idx >= m.frame_idx""", "votes"),
    ),
    "median_counts": (
        lambda s, d: people.median_counts(o.persons(s, d)),
        o.sql("SELECT camera_id, frame_idx, n, floor(median(n) OVER (PARTITION BY camera_id ORDER BY t RANGE BETWEEN INTERVAL 2 SECONDS PRECEDING AND CURRENT ROW))::BIGINT AS smoothed FROM (SELECT camera_id, frame_idx, count(*) AS n, min(ts) AS t FROM persons GROUP BY ALL)", "persons"),
    ),
}
