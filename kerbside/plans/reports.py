"""Queries on reports, logs, data sets and evaluation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbside.functions import labels
from kerbside.operators import counting, datasets, evaluation, helmets, people, plates, reports, spatial
from kerbside.operators.lineage import cut
from kerbside.plans import traffic, vehicles
from kerbside.sources import observations as o


def rows(s, d):
    v = o.vehicles(s, d)
    return reports.vehicle_rows(counting.crossings(v, counting.SHORT_LINE), counting.voted_class(v), counting.last_seen(v), plates.exact_consensus(o.plate_reads(s, d)), vehicles.helmet_verdicts(s, d))


ROWS = f"""{traffic.VOTED}, {traffic.crossed_sql(128)}, {vehicles.CORRECTED}, {vehicles.EXACT}, {vehicles.SEATS},
items AS (SELECT camera_id, track_id, v.vehicle_class, coalesce(p.plate, 'not detected') AS plate, CASE WHEN v.vehicle_class <> 'Bike/Motorcycle' THEN 'N/A' ELSE coalesce(h.verdict, 'UNVERIFIED') END AS helmet_status FROM crossed JOIN voted v USING (camera_id, track_id) LEFT JOIN plates p USING (camera_id, track_id) LEFT JOIN verdicts h USING (camera_id, track_id))"""


def _rows_sql(tail: str, *more: str) -> str:
    return o.sql(f"WITH {ROWS}, {tail}" if tail.startswith("x ") else f"WITH {ROWS} {tail}", "plate_reads", "heads", "snaps", *more)


# The log's columns of counts with their classes (scooters count as motorcycles).
LOGGED = {"cars": "Car", "trucks": "Truck", "buses": "Bus", "auto_rickshaws": "Auto Rickshaw", "motorcycles": "Bike/Motorcycle", "scooters": "Scooter", "bicycles": "Bicycle"}


def log(s, d):
    """A snapshot log: for each camera and stretch of ten frames (three more after the last) the tracks counted so far by class, packed plates and violations, and who is in its last frame with people."""
    v, tick = o.vehicles(s, d), F.floor(F.col("frame_idx") / 10).alias("tick")
    keys = ["camera_id", "tick"]
    seen = o.detections(s, d).groupBy("camera_id", tick).agg(F.max("ts").alias("ts"))
    ticks = seen.groupBy("camera_id").agg(F.max("tick").alias("last")).select("camera_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") + 3)).alias("tick"))
    ticks = spatial.carried(ticks.join(seen, keys, "left"), ["camera_id"], "tick", "ts")
    changes = counting.class_changes(v).groupBy("camera_id", tick, "vehicle_class").agg(F.sum("n").alias("n"))
    classes = F.explode(F.array(*[F.lit(c) for c in ["total", *LOGGED.values()]])).alias("vehicle_class")
    moves = changes.unionByName(changes.groupBy(*keys).agg(F.sum("n").alias("n")).withColumn("vehicle_class", F.lit("total"))).unionByName(ticks.select(*keys, classes, F.lit(0).cast("long").alias("n")))
    per = counting.running_sum(moves.groupBy(*keys, "vehicle_class").agg(F.sum("n").alias("n")), ["camera_id", "vehicle_class"], "tick", "n")
    n = lambda c: F.coalesce(F.max(F.when(F.col("vehicle_class") == c, F.col("n"))), F.lit(0)).cast("int")
    counts = per.groupBy(*keys).agg(n("total").alias("total_vehicles"), *[n(c).alias(name) for name, c in LOGGED.items()])
    r = plates.corrected(o.plate_reads(s, d)).where("plate is not null").groupBy("camera_id", tick, "track_id").agg(F.max_by("plate", "frame_idx").alias("plate"))
    p = reports.packed(r, keys, "track_id", F.col("plate"), "plates_detected")
    h = helmets.violations(o.heads(s, d)).withColumn("tick", tick)
    w = reports.packed(h, keys, "track_id", F.col("type"), "violation_details")
    who = people.frame_summary(o.votes(s, d)).groupBy("camera_id", tick).agg(F.max_by(F.struct("total", "males", "females", "children", "unknown"), "frame_idx").alias("w"))
    who = who.select(*keys, F.col("w.total").alias("pedestrians_detected"), "w.males", "w.females", "w.children", F.col("w.unknown").alias("unknown_pedestrians"))
    out = ticks.join(counts, keys, "left").join(p.drop("n_plates_detected"), keys, "left").join(w, keys, "left").join(who, keys, "left")
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    return out.select(*keys, (F.col("tick") * 2 + F.col("camera_id")).alias("line_no"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), *[zero(c, "int") for c in counts.columns if c not in keys], F.coalesce("plates_detected", F.lit("none")).alias("plates_detected"), F.coalesce("n_violation_details", F.lit(0)).alias("helmet_violations"), F.coalesce("violation_details", F.lit("none")).alias("violation_details"), *[zero(c, "int") for c in ("pedestrians_detected", "males", "females", "children", "unknown_pedestrians")])


LOG = f"""{vehicles.LIVE}, {vehicles.CORRECTED}, {traffic.crossed_sql(128)}, ticks AS (SELECT camera_id, unnest(range(0, max(frame_idx) // 10 + 4)) AS tick FROM detections GROUP BY camera_id),
stamped AS (SELECT t.camera_id, t.tick, (SELECT strftime(max_by(ts, k), '%Y-%m-%dT%H:%M:%S') FROM (SELECT camera_id, frame_idx // 10 AS k, max(ts) AS ts FROM detections GROUP BY ALL) d WHERE d.camera_id = t.camera_id AND k <= t.tick) AS timestamp FROM ticks t),
led AS (SELECT camera_id, tick, track_id, raw_class FROM (SELECT t.camera_id, t.tick, v.track_id, v.raw_class, count(*) AS n, min(v.frame_idx) AS f FROM ticks t JOIN crossed c ON c.camera_id = t.camera_id AND c.frame_idx // 10 <= t.tick JOIN vehicles v ON v.camera_id = c.camera_id AND v.track_id = c.track_id AND v.frame_idx // 10 <= t.tick GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY camera_id, tick, track_id ORDER BY n DESC, f) = 1),
seen AS (SELECT camera_id, tick, count(*)::INT AS total_vehicles, {", ".join(f"(count(*) FILTER (c = '{c}'))::INT AS {n}" for n, c in LOGGED.items())} FROM (SELECT *, {traffic.REPORTING_SQL.format("raw_class")} AS c FROM led) GROUP BY ALL),
pl AS (SELECT camera_id, tick, string_agg(track_id || ':' || plate, '|' ORDER BY track_id) AS plates_detected FROM (SELECT camera_id, frame_idx // 10 AS tick, track_id, arg_max(plate, frame_idx) AS plate FROM reads WHERE plate IS NOT NULL GROUP BY ALL) GROUP BY ALL),
vi AS (SELECT camera_id, frame_idx // 10 AS tick, count(*) AS n, string_agg(track_id || ':' || type, '|' ORDER BY track_id, type) AS violation_details FROM (SELECT *, CASE WHEN n = 1 THEN 'no_helmet_rider' ELSE 'no_helmet_pillion' END AS type FROM ranked WHERE n <= 2 AND bad) GROUP BY ALL),
who AS (SELECT camera_id, frame_idx // 10 AS tick, count(*)::INT AS pedestrians_detected, {", ".join(f"(count(*) FILTER (label = '{c}'))::INT AS {n}" for c, n in (("male_adult", "males"), ("female_adult", "females"), ("child", "children"), ("unknown", "unknown_pedestrians")))} FROM (SELECT *, {traffic.LABEL} AS label, max(frame_idx) OVER (PARTITION BY camera_id, frame_idx // 10) AS last FROM votes) WHERE frame_idx = last GROUP BY ALL),
log AS (SELECT camera_id, tick, tick * 2 + camera_id AS line_no, timestamp, {", ".join(f"coalesce({c}, 0) AS {c}" for c in "total_vehicles cars trucks buses auto_rickshaws motorcycles scooters bicycles".split())}, coalesce(plates_detected, 'none') AS plates_detected, coalesce(n, 0) AS helmet_violations, coalesce(violation_details, 'none') AS violation_details, {", ".join(f"coalesce({c}, 0) AS {c}" for c in "pedestrians_detected males females children unknown_pedestrians".split())} FROM stamped LEFT JOIN seen USING (camera_id, tick) LEFT JOIN pl USING (camera_id, tick) LEFT JOIN vi USING (camera_id, tick) LEFT JOIN who USING (camera_id, tick))"""
UNPACK = "(SELECT line_no, i AS pos, split_part(trim(x), ':', 1) AS id, split_part(trim(x), ':', 2) AS value FROM (SELECT line_no, unnest(string_split({0}, '|')) AS x, unnest(range(len(string_split({0}, '|')))) AS i FROM log WHERE {0} <> 'none') WHERE contains(x, ':'))"


def images(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id")


def label_stems(s, d):
    return s.read.parquet(f"{d}/labels.parquet").select("doc_id")


def evaluated(s, d):
    """True quality against a guess from the length, with a band of abstention."""
    x = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars", "source").join(s.read.parquet(f"{d}/labels.parquet"), "doc_id")
    pred = F.when(F.col("n_chars") < 600, "low").when(F.col("n_chars") < 800, "unknown").otherwise("high")
    return x.select("doc_id", "source", F.when(F.col("quality") == 1, "high").otherwise("low").alias("truth"), pred.alias("pred"), F.expr("(30 + doc_id % 65) / 100.0D").alias("conf"))


EVAL = "WITH e AS (SELECT doc_id, source, CASE WHEN quality = 1 THEN 'high' ELSE 'low' END AS truth, CASE WHEN n_chars < 600 THEN 'low' WHEN n_chars < 800 THEN 'unknown' ELSE 'high' END AS pred, (30 + doc_id % 65) / 100.0::DOUBLE AS conf FROM documents JOIN labels USING (doc_id))"


def curve(s, d):
    li = s.read.parquet(f"{d}/lineitem.parquet")
    return li.groupBy(F.col("l_linenumber").alias("epoch")).agg(F.round(1 - F.avg("l_discount"), 6).alias("score"))


def prints(s, d):
    """Frames with a fingerprint of 256 bits: five of each vector, by what is larger of two of its numbers, with some bits changed."""
    e = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")
    e = e.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(4))))
    changed = F.when(F.col("f") < 4, F.col("f") * 4).otherwise(F.when(F.col("vec_id") % 5 == 0, 0).otherwise(16))

    def bit(i):
        up = F.get("embedding", i % 64) < F.get("embedding", (i + 1 + F.floor(i / 64).cast("int")) % 64)
        # bit i is the j-th that is changed, where i = 13 vec_id + 37 j (mod 256), and 173 is the inverse of 37
        return up != (F.pmod((i - F.col("vec_id") * 13) * 173, F.lit(256)) < changed)

    return e.select((F.col("vec_id") * 5 + F.col("f")).alias("frame_id"), datasets.words(bit, 256).alias("bits"))


#: The same frames, distances by counting the places where the bits differ; of equal ones the first stands for all.
PAIRS = """WITH RECURSIVE e AS (SELECT vec_id, embedding, unnest([0, 1, 2, 3, 4]) AS f FROM embeddings),
b AS MATERIALIZED (SELECT vec_id * 5 + f AS frame_id, array_to_string([CASE WHEN (embedding[1 + i % 64] < embedding[1 + (i + 1 + i // 64) % 64])
  <> list_contains([(vec_id * 13 + j * 37) % 256 for j in range(0, CASE WHEN f < 4 THEN f * 4 WHEN vec_id % 5 = 0 THEN 0 ELSE 16 END)], i) THEN '1' ELSE '0' END for i in range(0, 256)], '')::BIT AS b FROM e),
firsts AS MATERIALIZED (SELECT b, min(frame_id) AS frame_id FROM b GROUP BY b),
pairs AS MATERIALIZED (SELECT x.frame_id, y.frame_id AS other, bit_count(xor(x.b, y.b))::INT AS distance FROM firsts x JOIN firsts y ON x.frame_id < y.frame_id WHERE bit_count(xor(x.b, y.b)) <= 10)"""
#: Frames in order, each kept unless a kept one is near (or equal).
KEPT = f"""{PAIRS}, near AS (SELECT other, list(frame_id) AS near FROM pairs GROUP BY other),
items AS MATERIALIZED (SELECT f.frame_id, near, row_number() OVER (ORDER BY f.frame_id) AS n FROM firsts f LEFT JOIN near ON other = f.frame_id),
walk AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS kept UNION ALL SELECT w.n + 1, CASE WHEN near IS NOT NULL AND list_has_any(kept, near) THEN kept ELSE list_append(kept, frame_id) END FROM walk w JOIN items i ON i.n = w.n + 1)
SELECT unnest(kept) AS frame_id FROM (SELECT kept FROM walk ORDER BY n DESC LIMIT 1)"""


def pairs(s, d):
    """Pairs of first frames, and each other frame with the first one of its fingerprint at distance 0."""
    p = cut(prints(s, d))
    same = datasets.members(p, "frame_id", "bits").select(F.col("other").alias("frame_id"), F.col("frame_id").alias("other"), F.lit(0).alias("distance"))
    return datasets.near_pairs(p, "frame_id", "bits").unionByName(same)


def crop_names(s, d):
    v = o.persons(s, d)
    name = F.concat(F.lit("/data/Crops v1/cam"), "camera_id", F.lit("_f"), F.lpad(F.col("frame_idx").cast("string"), 5, "0"), F.when(F.col("event_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("_t"), "track_id")), F.lit("_a.jpg"))
    from kerbside.sources.files import stem

    n = v.select("event_id", "ts", "confidence", name.alias("name"))
    return n.select("event_id", stem(F.col("name")).alias("stem"), labels.track_of_file(F.col("name")).alias("track"), F.regexp_replace("name", "[^A-Za-z0-9._-]", "_").alias("safe"), labels.percent_text(F.col("confidence")).alias("percent"), labels.share_of_text(F.concat((F.bround(F.col("confidence") * 100, 0)).cast("int").cast("string"), F.lit("%"))).alias("share"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.date_format("ts", "HH:mm:ss").alias("clock"), labels.run_folder(F.col("ts")).alias("run_folder"), F.expr("timestampdiff(MILLISECOND, timestamp_ntz '1970-01-01 00:00:00', ts)").alias("millis"))


QUERIES = {
    "vehicle_rows": (rows, _rows_sql("SELECT * FROM items")),
    "session_kpis": (
        lambda s, d: reports.kpis(rows(s, d), people.session_totals(spatial.pedestrians(o.persons(s, d), o.vehicles(s, d)), people.consensus(people.accepted_votes(o.votes(s, d))))),
        o.sql(f"WITH {ROWS}, {traffic.PEDESTRIANS}, ps AS (SELECT camera_id, track_id FROM peds WHERE h >= 60 GROUP BY ALL HAVING count(*) >= 8), k AS (SELECT count(*) AS vehicles, count(DISTINCT plate) FILTER (plate <> 'not detected') AS unique_plates, count(*) FILTER (starts_with(helmet_status, 'VIOLATION')) AS violations, count(*) FILTER (helmet_status <> 'N/A') AS tw FROM items) SELECT vehicles, unique_plates, violations, (SELECT count(*) FROM ps) AS pedestrians, CASE WHEN tw = 0 THEN 100 ELSE floor((tw - violations) * 100 / tw::DOUBLE + 0.5)::BIGINT END AS compliance FROM k", "plate_reads", "heads", "snaps", "persons"),
    ),
    "class_shares": (lambda s, d: reports.shares(rows(s, d)), _rows_sql("SELECT vehicle_class, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER ()::DOUBLE, 6) AS percent FROM items GROUP BY vehicle_class")),
    "table_search": (lambda s, d: reports.search(rows(s, d), "KA"), _rows_sql("SELECT * FROM items WHERE contains(lower(plate), 'ka') OR contains(track_id::VARCHAR, 'ka') OR contains(lower(vehicle_class), 'ka')")),
    "table_compliant": (lambda s, d: reports.mode(rows(s, d), "compliant"), _rows_sql("SELECT * FROM items WHERE helmet_status <> 'N/A' AND NOT starts_with(helmet_status, 'VIOLATION')")),
    "table_with_plates": (lambda s, d: reports.last_rows(reports.mode(rows(s, d), "with_plates").withColumn("key", F.col("track_id") * 2 + F.col("camera_id")), 15, "key"), _rows_sql("SELECT *, track_id * 2 + camera_id AS key FROM items WHERE plate <> 'not detected' ORDER BY key DESC LIMIT 15")),
    "snapshot_log": (lambda s, d: reports.non_empty(log(s, d)), o.sql(f"WITH {LOG} SELECT * FROM log WHERE total_vehicles > 0 OR plates_detected <> 'none' OR violation_details <> 'none'", "plate_reads", "heads", "votes")),
    "log_plates": (lambda s, d: reports.unique_plates(log(s, d)), o.sql(f"WITH {LOG} SELECT value AS plate, id AS track_id FROM {UNPACK.format('plates_detected')} WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY value ORDER BY line_no, pos, id) = 1", "plate_reads", "heads", "votes")),
    "log_violations": (lambda s, d: reports.violation_tracks(log(s, d)), o.sql(f"WITH {LOG} SELECT id AS track_id, CASE WHEN bool_or(contains(value, 'rider')) THEN 'NO HELMET' ELSE 'HELMET' END AS rider_helmet, CASE WHEN bool_or(contains(value, 'pillion')) THEN 'NO HELMET' ELSE 'None' END AS pillion_helmet FROM {UNPACK.format('violation_details')} GROUP BY ALL", "plate_reads", "heads", "votes")),
    "log_headline": (lambda s, d: reports.headline(reports.non_empty(log(s, d))), o.sql(f"WITH {LOG} SELECT total_vehicles::BIGINT AS total, cars::BIGINT AS cars, (motorcycles + scooters)::BIGINT AS bikes, buses::BIGINT AS buses, trucks::BIGINT AS trucks, CASE WHEN pedestrians_detected > 0 THEN pedestrians_detected ELSE males + females + children END::BIGINT AS people, greatest(0, pedestrians_detected - males - females - children)::BIGINT AS unknown FROM (SELECT * FROM log WHERE total_vehicles > 0) ORDER BY line_no DESC LIMIT 1", "plate_reads", "heads", "votes")),
    "latest_per_track": (lambda s, d: reports.latest(o.vehicles(s, d).select("camera_id", "track_id", "frame_idx", "raw_class", "confidence"), ["camera_id", "track_id"], "frame_idx"), o.sql("SELECT camera_id, track_id, frame_idx, raw_class, confidence FROM vehicles QUALIFY row_number() OVER (PARTITION BY camera_id, track_id ORDER BY frame_idx DESC) = 1", "vehicles")),
    "frame_rates": (lambda s, d: reports.frame_rate(o.detections(s, d), ["camera_id"], "ts"), None),
    "crop_names": (
        crop_names,
        o.sql("WITH n AS (SELECT event_id, ts, confidence, '/data/Crops v1/cam' || camera_id || '_f' || lpad(frame_idx::VARCHAR, 5, '0') || CASE WHEN event_id % 4 = 0 THEN '' ELSE '_t' || track_id END || '_a.jpg' AS name FROM persons) SELECT event_id, regexp_extract(name, '([^/]+?)(\\.[^./]*)?$', 1) AS stem, coalesce(nullif(regexp_extract(name, '_t(\\d+)_', 1), '')::BIGINT, -1) AS track, regexp_replace(name, '[^A-Za-z0-9._-]', '_', 'g') AS safe, round_even(confidence * 100, 1)::VARCHAR || '%' AS percent, round_even(confidence * 100, 0) / 100 AS share, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%H:%M:%S') AS clock, strftime(ts, 'run_%Y%m%d_%H%M%S') AS run_folder, epoch_us(ts) // 1000 AS millis FROM n", "persons"),
    ),
    "matched_images": (lambda s, d: datasets.matched(images(s, d), label_stems(s, d), "doc_id"), "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"),
    "images_without_label": (lambda s, d: datasets.without_label(images(s, d), label_stems(s, d), "doc_id"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "stem_sets": (lambda s, d: datasets.set_counts(images(s, d), label_stems(s, d), "doc_id"), "SELECT 'images_only' AS part, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS n UNION ALL SELECT 'labels_only', (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) UNION ALL SELECT 'both', (SELECT count(*) FROM (SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents)) UNION ALL SELECT 'either', (SELECT count(*) FROM (SELECT doc_id FROM labels UNION SELECT doc_id FROM documents))"),
    "dataset_split": (lambda s, d: datasets.split(images(s, d), "doc_id"), "SELECT doc_id, CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '_42'), doc_id) AS r, count(*) OVER () AS n FROM documents)"),
    "capped_crops": (
        lambda s, d: datasets.capped(o.persons(s, d).where("h >= 60 and w >= 25 and x1 >= 5 and y1 >= 5 and x2 <= 635 and y2 <= 1075 and frame_idx % 3 = 0"), ["camera_id"], ["frame_idx", "track_id"], 100, 160).select("event_id", "camera_id", "place"),
        o.sql("SELECT event_id, camera_id, place FROM (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY frame_idx, track_id) AS place FROM persons WHERE h >= 60 AND w >= 25 AND x1 >= 5 AND y1 >= 5 AND x2 <= 635 AND y2 <= 1075 AND frame_idx % 3 = 0) WHERE place <= 100 ORDER BY camera_id, place LIMIT 160", "persons"),
    ),
    "merged_sets": (lambda s, d: datasets.merged_sources({"images": images(s, d), "labels": label_stems(s, d)}, "doc_id"), "SELECT 'images_' || doc_id AS doc_id, 'images' AS source_set FROM documents UNION ALL SELECT 'labels_' || doc_id, 'labels' FROM labels"),
    "label_histogram": (lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", "source").join(s.read.parquet(f"{d}/labels.parquet"), "doc_id", "left").groupBy("source").agg(F.count("*").alias("n_images"), F.count("quality").alias("n_labelled"), F.count_if(F.col("quality").isNull()).alias("n_background"), F.count_if(F.col("quality") == 1).alias("n_class_1")), "SELECT source, count(*) AS n_images, count(quality) AS n_labelled, count(*) FILTER (quality IS NULL) AS n_background, count(*) FILTER (quality = 1) AS n_class_1 FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL"),
    "near_frames": (pairs, f"{PAIRS} SELECT * FROM pairs UNION ALL SELECT f.frame_id, x.frame_id, 0 FROM b x JOIN firsts f USING (b) WHERE x.frame_id > f.frame_id"),
    "kept_frames": (lambda s, d: datasets.kept(prints(s, d), "frame_id", "bits"), KEPT),
    "confusion_matrix": (lambda s, d: evaluation.confusion(evaluated(s, d), ["high", "low"]), f"{EVAL} SELECT truth, count(*) FILTER (pred = 'high') AS n_high, count(*) FILTER (pred = 'low') AS n_low, count(*) FILTER (pred = 'unknown') AS n_unknown, count(*) AS support FROM e GROUP BY ALL"),
    "class_metrics": (lambda s, d: evaluation.class_metrics(evaluated(s, d)), f"{EVAL}, m AS (SELECT t.truth AS class, tp::DOUBLE / support AS r, coalesce(tp::DOUBLE / nullif(predicted, 0), 0) AS p, support FROM (SELECT truth, count(*) AS support, count(*) FILTER (pred = truth) AS tp FROM e GROUP BY ALL) t LEFT JOIN (SELECT pred, count(*) AS predicted FROM e GROUP BY ALL) q ON q.pred = t.truth) SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, support FROM m"),
    "overall_accuracy": (lambda s, d: evaluation.accuracy(evaluated(s, d)), f"{EVAL} SELECT count(*) AS n, round(avg(CASE WHEN pred = truth THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, round(avg(CASE WHEN pred = 'unknown' THEN 1.0::DOUBLE ELSE 0 END), 6) AS abstained FROM e"),
    "track_accuracy": (lambda s, d: evaluation.track_accuracy(evaluated(s, d), ["source"], "doc_id"), f"{EVAL}, v AS (SELECT source, pred FROM e WHERE pred <> 'unknown' GROUP BY source, pred QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(sum(conf), 9) DESC, min(doc_id)) = 1), t AS (SELECT source, arg_max(truth, doc_id) AS truth FROM e GROUP BY ALL) SELECT count(*) AS n_tracks, round(avg(CASE WHEN pred = truth THEN 1.0::DOUBLE ELSE 0 END), 6) AS track_accuracy FROM t LEFT JOIN v USING (source)"),
    "best_epoch": (lambda s, d: evaluation.best_epoch(curve(s, d), "epoch", "score"), "WITH c AS (SELECT l_linenumber AS epoch, round(1 - avg(l_discount), 6) AS score FROM lineitem GROUP BY ALL) SELECT epoch, score, CASE WHEN score >= 0.9 THEN 'EXCELLENT' WHEN score >= 0.8 THEN 'VERY GOOD' WHEN score >= 0.7 THEN 'GOOD' WHEN score >= 0.55 THEN 'FAIR' ELSE 'POOR' END AS rating FROM c ORDER BY score DESC, epoch LIMIT 1"),
}
