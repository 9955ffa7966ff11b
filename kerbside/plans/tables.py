"""Queries on tables of the dashboard and on boxes between frames of reference, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kerbside.functions import geometry as g
from kerbside.functions import labels
from kerbside.operators import counting, datasets, people, plates, reports, spatial
from kerbside.plans import reports as report_plans
from kerbside.plans import traffic, vehicles
from kerbside.sources import observations as o

TRACK = ["camera_id", "track_id"]
#: Where the enlarged part of a frame starts, and its scale.
LOW, SCALE = 432, 1.975


def helmet_attempts(s, d):
    """Looks at two-wheelers for helmets: every third frame, twenty of a track at most."""
    v = o.vehicles(s, d).where(labels.is_two_wheeler(F.col("raw_class")) & (F.col("frame_idx") % 3 == 0))
    n = F.row_number().over(Window.partitionBy(*TRACK).orderBy("frame_idx")).cast("long")
    return v.withColumn("attempt", n).where("attempt <= 20").select("event_id", *TRACK, "attempt")


def padded_plates(s, d):
    b = g.padded(tuple(F.col(c) for c in ("px1", "py1", "px2", "py2")), o.WIDTH, o.HEIGHT)
    return o.plate_boxes(s, d).select("event_id", *[c.cast("long").alias(n) for c, n in zip(b, ("x1", "y1", "x2", "y2"))])


def crop_round_trip(s, d):
    """A box in the pixels of its own padded, enlarged crop, and back in the frame's."""
    v, ox, oy, scale = o.vehicles(s, d), F.greatest(F.lit(0), F.col("x1") - 10), F.greatest(F.lit(0), F.col("y1") - 20), F.lit(1.6)
    inner = g.to_crop(g.box(), ox, oy, scale)
    v = v.select("event_id", ox.alias("ox"), oy.alias("oy"), *[c.alias(n) for c, n in zip(inner, ("x1", "y1", "x2", "y2"))])
    back = g.to_frame(g.box(), F.col("ox"), F.col("oy"), scale)
    return v.select("event_id", *[F.col(c).alias(f"c{c}") for c in ("x1", "y1", "x2", "y2")], *[c.alias(f"f{n}") for c, n in zip(back, ("x1", "y1", "x2", "y2"))])


def united_plate_boxes(s, d):
    """Plate boxes of whole frames with those of their enlarged lower parts."""
    b = o.plate_boxes(s, d).withColumn("part", F.lit("whole"))
    whole = b.where("det_conf >= 0.25").withColumns({"ox": F.lit(0), "oy": F.lit(0), "scale": F.lit(1.0)})
    low = b.where(f"py1 >= {LOW} and event_id % 2 = 0").withColumns({"part": F.lit("low"), "ox": F.lit(0), "oy": F.lit(LOW), "scale": F.lit(SCALE)})
    low = low.withColumns(dict(zip(("px1", "py1", "px2", "py2"), g.to_crop(tuple(F.col(c) for c in ("px1", "py1", "px2", "py2")), F.col("ox"), F.col("oy"), F.col("scale")))))
    u = spatial.united_boxes(whole.unionByName(low), o.WIDTH, o.HEIGHT, (0.8, 6.5))
    return u.select("event_id", "part", *[F.col(c).cast("long").alias(c) for c in ("px1", "py1", "px2", "py2")])


def detailed(s, d):
    v = o.vehicles(s, d)
    rows = counting.crossings(v, counting.SHORT_LINE).join(counting.voted_class(v).select(*TRACK, "vehicle_class"), TRACK)
    kept, reads = vehicles.shots(s, d), o.plate_reads(s, d)
    votes = plates.variant_vote(reads.join(kept, [*TRACK, "frame_idx"], "left_semi"), TRACK)
    return reports.detailed_rows(rows, votes, plates.exact_consensus(reads), vehicles.helmet_verdicts(s, d), kept.where("place = 1"))


def clips(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("Clip_L"), F.expr("doc_id % 5"), F.lit("_"), "doc_id").alias("name"))


def people_now(s, d):
    return people.session_totals(spatial.pedestrians(o.persons(s, d), o.vehicles(s, d)), people.consensus(people.accepted_votes(o.votes(s, d))))


_BIKE = "vehicle_class = 'Bike/Motorcycle'"
_CLASSES = "(VALUES ('Car'), ('Bike/Motorcycle'), ('Bus'), ('Truck'), ('Auto Rickshaw'), ('Bicycle'), ('Others'))"
_JOINED = f"{traffic.VOTED}, {traffic.crossed_sql(640)}, j AS (SELECT replace(vehicle_class, 'Van', 'Others') AS vehicle_class FROM crossed JOIN voted USING (camera_id, track_id))"
_SHARE = "CASE WHEN total = 0 THEN 0 ELSE floor({} * 100 / total::DOUBLE + 0.5)::BIGINT END"
QUERIES = {
    "helmet_attempts": (helmet_attempts, o.sql("SELECT event_id, camera_id, track_id, attempt FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY frame_idx) AS attempt FROM vehicles WHERE raw_class IN ('motorcycle', 'scooter') AND frame_idx % 3 = 0) WHERE attempt <= 20", "vehicles")),
    "padded_plates": (padded_plates, o.sql("SELECT event_id, greatest(0, px1 - a)::BIGINT AS x1, greatest(0, py1 - b)::BIGINT AS y1, least(640, px2 + a)::BIGINT AS x2, least(1080, py2 + b)::BIGINT AS y2 FROM (SELECT *, greatest(6, trunc((px2 - px1) * 0.15::DOUBLE)::BIGINT) AS a, greatest(6, trunc((py2 - py1) * 0.25::DOUBLE)::BIGINT) AS b FROM plate_boxes)", "plate_boxes")),
    "crop_round_trip": (
        crop_round_trip,
        o.sql("WITH c AS (SELECT event_id, ox, oy, trunc((x1 - ox) * 1.6::DOUBLE)::BIGINT AS cx1, trunc((y1 - oy) * 1.6::DOUBLE)::BIGINT AS cy1, trunc((x2 - ox) * 1.6::DOUBLE)::BIGINT AS cx2, trunc((y2 - oy) * 1.6::DOUBLE)::BIGINT AS cy2 FROM (SELECT *, greatest(0, x1 - 10) AS ox, greatest(0, y1 - 20) AS oy FROM vehicles)) SELECT event_id, cx1, cy1, cx2, cy2, trunc(cx1 / 1.6::DOUBLE)::BIGINT + ox AS fx1, trunc(cy1 / 1.6::DOUBLE)::BIGINT + oy AS fy1, trunc(cx2 / 1.6::DOUBLE)::BIGINT + ox AS fx2, trunc(cy2 / 1.6::DOUBLE)::BIGINT + oy AS fy2 FROM c", "vehicles"),
    ),
    "united_plate_boxes": (
        united_plate_boxes,
        o.sql(f"WITH z AS (SELECT event_id, {', '.join(f'trunc(trunc({v} * {SCALE}::DOUBLE) / {SCALE}::DOUBLE)::BIGINT + {p} AS {n}' for v, p, n in (('px1', 0, 'px1'), (f'(py1 - {LOW})', LOW, 'py1'), ('px2', 0, 'px2'), (f'(py2 - {LOW})', LOW, 'py2')))} FROM plate_boxes WHERE py1 >= {LOW} AND event_id % 2 = 0), u AS (SELECT event_id, 'whole' AS part, px1, py1, px2, py2 FROM plate_boxes WHERE det_conf >= 0.25 UNION ALL SELECT event_id, 'low', px1, py1, px2, py2 FROM z) SELECT event_id, part, greatest(0, px1)::BIGINT AS px1, greatest(0, py1)::BIGINT AS py1, least(640, px2)::BIGINT AS px2, least(1080, py2)::BIGINT AS py2 FROM u WHERE px2 - px1 > 4 AND py2 - py1 > 4 AND (px2 - px1)::DOUBLE / (py2 - py1) BETWEEN 0.8 AND 6.5", "plate_boxes"),
    ),
    "detailed_rows": (
        detailed,
        o.sql(f"""WITH {traffic.VOTED}, {traffic.crossed_sql(128)}, {vehicles.SEATS}, {vehicles.REPAIRED.replace("reads AS (", "repaired AS (")}, shot_reads AS (SELECT r.* FROM repaired r SEMI JOIN shots USING (camera_id, track_id, frame_idx)),
{vehicles.VARIANT.replace("voted AS", "voted_plates AS").replace("FROM reads", "FROM shot_reads")}, {vehicles.CORRECTED.replace("texts", "texts2").replace("fixed", "fixed2")}, {vehicles.EXACT},
j AS (SELECT *, CASE WHEN s.status = 'valid' THEN 1 WHEN l.plate IS NOT NULL THEN 2 WHEN s.status = 'partial' THEN 3 ELSE 4 END AS origin, s.plate AS s_plate, s.conf AS s_conf, l.plate AS l_plate, l.conf AS l_conf, b.frame_idx AS snapshot_frame
FROM (SELECT camera_id, track_id, v.vehicle_class FROM crossed JOIN voted v USING (camera_id, track_id)) LEFT JOIN voted_plates s USING (camera_id, track_id) LEFT JOIN plates l USING (camera_id, track_id) LEFT JOIN verdicts h USING (camera_id, track_id) LEFT JOIN (SELECT * FROM shots WHERE place = 1) b USING (camera_id, track_id)),
t AS (SELECT *, (['valid', 'live', 'partial', 'none'])[origin] AS plate_status, ([s_plate, l_plate, s_plate || '?', 'not detected'])[origin] AS shown, round_even(round(CASE WHEN origin = 2 THEN l_conf ELSE s_conf END, 6) * 100, 1)::VARCHAR || '%' AS percent FROM j)
SELECT camera_id, track_id, vehicle_class, shown AS plate, plate_status, CASE WHEN origin = 4 THEN '' ELSE percent END AS plate_conf,
CASE WHEN NOT {_BIKE} THEN 'N/A' WHEN coalesce(rider_helmet, 'None') = 'None' THEN 'NOT VISIBLE' ELSE rider_helmet END AS rider_helmet, CASE WHEN {_BIKE} THEN coalesce(pillion_helmet, 'None') ELSE 'N/A' END AS pillion_helmet,
CASE WHEN {_BIKE} THEN (coalesce(rider_helmet, 'None') <> 'None')::BIGINT + (coalesce(pillion_helmet, 'None') <> 'None')::BIGINT ELSE 0 END AS n_people, CASE WHEN {_BIKE} THEN coalesce(verdict, 'UNVERIFIED (no head detected)') ELSE 'N/A' END AS verdict, snapshot_frame,
CASE WHEN snapshot_frame IS NOT NULL THEN 'cam' || camera_id || '_id' || lpad(track_id::VARCHAR, greatest(4, length(track_id::VARCHAR))::INT, '0') || '_' || replace(replace(vehicle_class, '/', '-'), ' ', '') || '_' || CASE origin WHEN 4 THEN 'noplate' WHEN 3 THEN s_plate || '_partial' ELSE shown END || '.jpg' END AS snapshot FROM t""", "vehicles", "plate_reads", "heads", "snaps"),
    ),
    "table_violations": (lambda s, d: reports.mode(report_plans.rows(s, d), "violations"), report_plans._rows_sql("SELECT * FROM items WHERE starts_with(helmet_status, 'VIOLATION')")),
    "table_two_wheelers": (lambda s, d: reports.mode(report_plans.rows(s, d), "two_wheelers"), report_plans._rows_sql("SELECT * FROM items WHERE helmet_status <> 'N/A'")),
    "rolled_counts": (
        lambda s, d: reports.rolled(counting.class_counts(counting.crossed_classes(o.vehicles(s, d))).where("vehicle_class <> 'TOTAL'")),
        o.sql(f"WITH {_JOINED} SELECT c.vehicle_class, count(j.vehicle_class) AS n FROM {_CLASSES} c(vehicle_class) LEFT JOIN j USING (vehicle_class) GROUP BY ALL", "vehicles"),
    ),
    "active_classes": (
        lambda s, d: reports.active(reports.rolled(counting.class_counts(counting.crossed_classes(o.vehicles(s, d))).where("vehicle_class <> 'TOTAL'"))),
        o.sql(f"WITH {_JOINED} SELECT vehicle_class, count(*) AS n FROM j GROUP BY ALL", "vehicles"),
    ),
    "people_shares": (
        lambda s, d: reports.people_shares(people_now(s, d)),
        o.sql(f"WITH {traffic.PEDESTRIANS}, {traffic.ACCEPTED}, {traffic.CONSENSUS}, s AS (SELECT camera_id, track_id FROM peds WHERE h >= 60 GROUP BY ALL HAVING count(*) >= 8), t AS (SELECT count(*) AS total, count(*) FILTER (label = 'male_adult') AS males, count(*) FILTER (label = 'female_adult') AS females, count(*) FILTER (label = 'child') AS children FROM s LEFT JOIN agreed USING (camera_id, track_id)), p AS (SELECT total, {_SHARE.format('males')} AS male_percent, {_SHARE.format('females')} AS female_percent, {_SHARE.format('children')} AS child_percent FROM t) SELECT *, CASE WHEN total > 0 THEN greatest(0, 100 - male_percent - female_percent - child_percent) ELSE 0 END::BIGINT AS unknown_percent FROM p", "persons", "vehicles", "votes"),
    ),
    "clips_by_priority": (
        lambda s, d: datasets.by_priority(clips(s, d), "name", ["l3", "l2", "20260521"]),
        "SELECT name, CASE WHEN contains(lower(name), 'l3') THEN 0 WHEN contains(lower(name), 'l2') THEN 1 WHEN contains(lower(name), '20260521') THEN 2 ELSE 10 END AS priority FROM (SELECT 'Clip_L' || doc_id % 5 || '_' || doc_id AS name FROM documents)",
    ),
}
