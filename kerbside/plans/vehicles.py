"""Queries on plate text, helmets and snapshots, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbside.functions import geometry as g
from kerbside.functions import plate_text as p
from kerbside.operators import helmets, plates
from kerbside.sources import observations as o

_STATES = ", ".join(f"'{s}'" for s in p.STATES)
_CLEAN = "regexp_replace(upper({}), '[^A-Z0-9]', '', 'g')"


def correct_sql(s: str) -> str:
    d, a = (lambda x: f"translate({x}, 'OQDILZSGBATJ', '000112568473')"), (lambda x: f"translate({x}, '012456783', 'OIZASGTBE')")
    std = f"{a(f'{s}[1:2]')} || {d(f'{s}[3:3]')} || CASE WHEN regexp_matches({d(f'{s}[4:4]')}, '[0-9]') THEN {d(f'{s}[4:4]')} || {a(f'{s}[5:length({s}) - 4]')} ELSE {a(f'{s}[4:length({s}) - 4]')} END || {d(f'right({s}, 4)')}"
    fixed = f"CASE left({std}, 2) WHEN 'MA' THEN 'MH' WHEN 'CQ' THEN 'CG' WHEN 'KB' THEN 'KA' WHEN 'OL' THEN 'DL' WHEN 'QL' THEN 'DL' ELSE left({std}, 2) END || substr({std}, 3)"
    bh = f"{d(f'{s}[1:2]')} || 'BH' || {d(f'{s}[5:8]')} || translate({a(f'{s}[9:11]')}, 'IO', 'AA')"
    return f"""CASE WHEN length({s}) BETWEEN 8 AND 11 THEN CASE WHEN {s}[3:4] IN ('BH', '8H', 'B1', '81') THEN CASE WHEN regexp_full_match({bh}, '[0-9]{{2}}BH[0-9]{{4}}[A-HJ-NP-Z]{{1,2}}') THEN {bh} END
WHEN left({fixed}, 2) IN ({_STATES}) AND regexp_full_match({fixed}, '[A-Z]{{2}}[0-9]{{1,2}}[A-Z]{{1,3}}[0-9]{{4}}') THEN {fixed} END END"""


def extract_sql(s: str) -> str:
    windows = " || ".join(f"CASE WHEN length({s}) > 8 AND length({s}) >= {w} THEN list_transform(range(1, length({s}) - {w} + 2), lambda i: substr({s}, i, {w})) ELSE [] END" for w in (10, 9, 8))
    return f"list_filter(list_transform([{s}] || {windows}, lambda x: {correct_sql('x')}), lambda y: y IS NOT NULL)[1]"


def repair_sql(raw: str) -> str:
    s = _CLEAN.format(raw)
    damaged = f"CASE WHEN left({s}, 2) NOT IN ({_STATES}) AND (left({s}, 1) = 'K' OR {s}[2:2] = 'A') THEN {extract_sql(f'(' + chr(39) + 'KA' + chr(39) + f' || substr({s}, 3))')} END"
    return f"CASE WHEN length({s}) >= 8 THEN coalesce({extract_sql(s)}, {damaged}, {extract_sql(f'substr({s}, 2)')}, {extract_sql(f'left({s}, length({s}) - 1)')}) END"


CORRECTED = f"texts AS (SELECT DISTINCT raw_text FROM plate_reads), fixed AS (SELECT raw_text, {extract_sql('s')} AS plate FROM (SELECT raw_text, {_CLEAN.format('raw_text')} AS s FROM texts)), reads AS (SELECT * FROM plate_reads JOIN fixed USING (raw_text))"
REPAIRED = f"texts AS (SELECT DISTINCT raw_text FROM plate_reads), fixed AS (SELECT raw_text, {_CLEAN.format('raw_text')} AS cleaned, {repair_sql('raw_text')} AS plate FROM texts), reads AS (SELECT * FROM plate_reads JOIN fixed USING (raw_text))"
EXACT = """plates AS (SELECT camera_id, track_id, plate, support, round_even(round(conf * 100, 7), 0) / 100 AS conf, support = 1 AS provisional FROM (SELECT camera_id, track_id, plate, sum(det_conf * ocr_conf * sqrt(bbox_area::DOUBLE)) AS w, count(*) AS support, max(ocr_conf) AS top, avg(ocr_conf) AS conf, min(frame_idx) AS f FROM reads WHERE plate IS NOT NULL GROUP BY ALL) WHERE support >= 2 OR top >= 0.45 QUALIFY row_number() OVER (PARTITION BY camera_id, track_id ORDER BY round(w, 6) DESC, f) = 1)"""
VARIANT = """valid AS (SELECT camera_id, track_id, plate, avg(ocr_conf) AS conf, count(*) AS support FROM reads WHERE plate IS NOT NULL GROUP BY camera_id, track_id, plate QUALIFY row_number() OVER (PARTITION BY camera_id, track_id ORDER BY round(sum(ocr_conf + 0.5), 9) DESC, min(event_id)) = 1),
loose AS (SELECT camera_id, track_id, cleaned, ocr_conf FROM reads WHERE length(cleaned) >= 6 QUALIFY row_number() OVER (PARTITION BY camera_id, track_id ORDER BY round(length(cleaned) * ocr_conf, 9) DESC, event_id) = 1),
voted AS (SELECT camera_id, track_id, CASE WHEN v.plate IS NOT NULL THEN 'valid' WHEN cleaned IS NOT NULL THEN 'partial' ELSE 'none' END AS status, coalesce(v.plate, cleaned) AS plate, (round(round(coalesce(v.conf, ocr_conf, 0.0)::DOUBLE * 1000000, 3), 0) / 1000000)::DOUBLE AS conf, coalesce(v.support, 0) AS support FROM (SELECT DISTINCT camera_id, track_id FROM reads) LEFT JOIN valid v USING (camera_id, track_id) LEFT JOIN loose USING (camera_id, track_id))"""
LIVE = """ranked AS (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id, frame_idx ORDER BY hx1 + hx2, head_no) AS n, class_name IN ('without_helmet', 'head') AS bad FROM heads),
live AS (SELECT camera_id, track_id, frame_idx, max(CASE WHEN n = 1 THEN CASE WHEN bad THEN 'no_helmet' ELSE 'helmet' END END) AS rider, coalesce(max(CASE WHEN n = 2 THEN CASE WHEN bad THEN 'no_helmet' ELSE 'helmet' END END), 'none') AS pillion FROM ranked GROUP BY ALL)"""
#: Greedy clusters of at most three boxes, best first.
CLUSTERS = """hs AS (SELECT *, class_name IN ('without_helmet', 'head') AS bad, row_number() OVER (PARTITION BY camera_id, track_id, frame_idx ORDER BY conf DESC, head_no) AS k FROM heads),
pairs AS (SELECT a.camera_id, a.track_id, a.frame_idx, a.k AS ka, b.k AS kb, s::DOUBLE / ((a.hx2 - a.hx1) * (a.hy2 - a.hy1) + (b.hx2 - b.hx1) * (b.hy2 - b.hy1) - s) >= 0.35 AS near FROM hs a JOIN hs b ON a.camera_id = b.camera_id AND a.track_id = b.track_id AND a.frame_idx = b.frame_idx AND a.k < b.k, LATERAL (SELECT greatest(0, least(a.hx2, b.hx2) - greatest(a.hx1, b.hx1)) * greatest(0, least(a.hy2, b.hy2) - greatest(a.hy1, b.hy1)) AS s)),
near AS (SELECT camera_id, track_id, frame_idx, coalesce(bool_or(near) FILTER (ka = 1 AND kb = 2), false) AS n12, coalesce(bool_or(near) FILTER (ka = 1 AND kb = 3), false) AS n13, coalesce(bool_or(near) FILTER (ka = 2 AND kb = 3), false) AS n23 FROM pairs GROUP BY ALL),
owned AS (SELECT hs.*, CASE WHEN k = 1 THEN 1 WHEN k = 2 THEN CASE WHEN n12 THEN 1 ELSE 2 END ELSE CASE WHEN n13 THEN 1 WHEN n23 AND NOT n12 THEN 2 ELSE 3 END END AS c FROM hs LEFT JOIN near USING (camera_id, track_id, frame_idx)),
clusters AS (SELECT camera_id, track_id, frame_idx, arg_min(head_no, k) AS cluster, arg_min((hx2 - hx1) * (hy2 - hy1), k) AS area, max(conf) AS conf, round(coalesce(max(conf) FILTER (bad), 0) / (coalesce(max(conf) FILTER (NOT bad), 0) + coalesce(max(conf) FILTER (bad), 0)), 9) AS p_no, arg_min((hx1 + hx2) / 2.0::DOUBLE, k) AS cx, arg_min((hy1 + hy2) / 2.0::DOUBLE, k) AS cy, any_value(x1) AS x1, any_value(x2) AS x2, any_value(y1) AS y1, any_value(y2) AS y2 FROM owned GROUP BY camera_id, track_id, frame_idx, c),
kept AS (SELECT camera_id, track_id, frame_idx, cluster, area, conf, p_no FROM clusters WHERE area <= 0.30 * 640 * 1080 AND cx BETWEEN x1 - (x2 - x1) * 0.2::DOUBLE AND x2 + (x2 - x1) * 0.2::DOUBLE AND cy <= y1 + (y2 - y1) * 0.55::DOUBLE)"""
SCORED = "scored AS (SELECT *, round(sqrt((w * h)::DOUBLE) * (least(sharpness, 400) / 400.0::DOUBLE + 0.2::DOUBLE) * CASE WHEN x1 <= 2 OR y1 <= 2 OR x2 >= 638 OR y2 >= 1078 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * (confidence + 0.5::DOUBLE), 6) AS score FROM snaps)"
#: The best snapshot of each track and two more.
SHOTS = SCORED + """, shots AS (SELECT camera_id, track_id, frame_idx, event_id, score, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY score DESC, event_id) AS place FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY camera_id, track_id, frame_idx // 6 ORDER BY score DESC, event_id) = 1) QUALIFY place <= 3)"""
SEATS = SHOTS + ", " + CLUSTERS + """, seats AS (SELECT camera_id, track_id, frame_idx, CASE WHEN row_number() OVER (PARTITION BY camera_id, track_id, frame_idx ORDER BY area DESC, top) = 1 THEN 'rider' ELSE 'pillion' END AS role, conf, p_no FROM (SELECT *, row_number() OVER (PARTITION BY camera_id, track_id, frame_idx ORDER BY conf DESC, cluster) AS top FROM kept SEMI JOIN shots USING (camera_id, track_id, frame_idx)) WHERE top <= 2),
per AS (SELECT camera_id, track_id, role, round(sum(p_no * conf) / sum(conf), 9) AS p_no, max(conf) AS conf, count(*) AS n FROM seats GROUP BY ALL),
tw AS (SELECT camera_id, track_id, count(*) AS n_snapshots FROM shots SEMI JOIN (SELECT * FROM vehicles WHERE raw_class IN ('motorcycle', 'scooter')) USING (camera_id, track_id) GROUP BY ALL),
agg AS (SELECT camera_id, track_id, n_snapshots, r.p_no AS r_p, r.conf AS r_conf, CASE WHEN ok THEN q.p_no END AS p_p, CASE WHEN ok THEN q.conf END AS p_conf FROM tw LEFT JOIN (SELECT * FROM per WHERE role = 'rider') r USING (camera_id, track_id) LEFT JOIN (SELECT * FROM per WHERE role = 'pillion') q USING (camera_id, track_id), LATERAL (SELECT r.p_no IS NOT NULL AND (q.n >= CASE WHEN n_snapshots = 1 THEN 1 ELSE 2 END OR q.conf >= 0.6) AS ok)),
verdicts AS (SELECT camera_id, track_id, CASE WHEN r_p IS NULL THEN 'None' ELSE CASE WHEN r_p >= 0.5 THEN 'NO HELMET' ELSE 'HELMET' END || ' (' || printf('%.2f', r_conf) || ')' END AS rider_helmet, CASE WHEN p_p IS NULL THEN 'None' ELSE CASE WHEN p_p >= 0.5 THEN 'NO HELMET' ELSE 'HELMET' END || ' (' || printf('%.2f', p_conf) || ')' END AS pillion_helmet,
CASE WHEN r_p IS NULL THEN 'UNVERIFIED (no head detected)' WHEN r_p >= 0.5 AND coalesce(p_p >= 0.5, false) THEN 'VIOLATION (Rider + Pillion No Helmet)' WHEN r_p >= 0.5 THEN 'VIOLATION (Rider No Helmet)' WHEN coalesce(p_p >= 0.5, false) THEN 'VIOLATION (Pillion No Helmet)' WHEN r_conf < 0.45 OR (r_p > 0.35 AND r_p < 0.5) OR coalesce(p_conf < 0.45 OR (p_p > 0.35 AND p_p < 0.5), false) THEN 'REVIEW (low confidence)' ELSE 'COMPLIANT' END AS verdict FROM agg)"""


def scored_snaps(s, d):
    is_clipped = (F.col("x1") <= 2) | (F.col("y1") <= 2) | (F.col("x2") >= o.WIDTH - 2) | (F.col("y2") >= o.HEIGHT - 2)
    return o.snaps(s, d).withColumn("score", F.round(g.snapshot_score(g.box(), F.col("sharpness"), F.col("confidence"), is_clipped), 6))


def shots(s, d):
    """The best snapshot of each track and two more."""
    return helmets.bucket_snapshots(scored_snaps(s, d))


def helmet_verdicts(s, d):
    """Verdicts over the kept snapshots of tracks that were a two-wheeler in some frame."""
    seen = o.vehicles(s, d).where("raw_class in ('motorcycle', 'scooter')").select(*helmets.TRACK)
    kept = shots(s, d).select(*helmets.IMAGE).join(seen, helmets.TRACK, "left_semi")
    h = o.heads(s, d).join(kept, helmets.IMAGE, "left_semi")
    return helmets.verdict(helmets.aggregate_helmets(kept, helmets.snapshot_heads(helmets.head_clusters(h))))


def merged_plate_boxes(s, d):
    """Plate boxes of a frame, the best first by confidence and size, without those that overlap a better one."""
    b = o.plate_boxes(s, d).withColumn("score", F.round(F.col("det_conf") * F.sqrt(((F.col("px2") - F.col("px1")) * (F.col("py2") - F.col("py1"))).cast("double")), 9))
    m = helmets.suppressed(b, ["camera_id", "frame_idx"], "score", ("px1", "py1", "px2", "py2"), "event_id", 0.4, strict=True)
    return m.where("cluster = event_id").select("event_id", "score")


QUERIES = {
    "corrected_plates": (lambda s, d: plates.corrected(o.plate_reads(s, d)).select("event_id", "plate", p.is_valid_length(F.col("plate")).alias("valid_length"), p.near(F.col("plate"), F.col("truth")).alias("near_truth")), o.sql(f"WITH {CORRECTED} SELECT event_id, plate, length(plate) BETWEEN 8 AND 10 AS valid_length, levenshtein(plate, truth) <= 2 AS near_truth FROM reads", "plate_reads")),
    "repaired_plates": (lambda s, d: plates.repaired(o.plate_reads(s, d)).select("event_id", p.clean(F.col("raw_text")).alias("cleaned"), "plate", p.is_two_digit(F.col("plate")).alias("two_digit")), o.sql(f"WITH {REPAIRED} SELECT event_id, cleaned, plate, coalesce(regexp_matches(plate, '{p.TWO_DIGIT}'), false) AS two_digit FROM reads", "plate_reads")),
    "plate_variant_vote": (lambda s, d: plates.variant_vote(o.plate_reads(s, d), ["camera_id", "track_id"]), o.sql(f"WITH {REPAIRED}, {VARIANT} SELECT * FROM voted", "plate_reads")),
    "plate_position_vote": (
        lambda s, d: plates.position_vote(o.plate_reads(s, d), ["camera_id", "track_id"]),
        o.sql(f"""WITH {REPAIRED}, sized AS (SELECT camera_id, track_id, n FROM (SELECT camera_id, track_id, length(plate) AS n, count(*) AS c FROM reads WHERE plate IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY camera_id, track_id ORDER BY c DESC, n DESC) = 1 AND c >= 3),
chars AS (SELECT camera_id, track_id, event_id, ocr_conf, i, plate[i:i] AS ch FROM (SELECT r.*, unnest(range(1, n + 1)) AS i FROM reads r JOIN sized s USING (camera_id, track_id) WHERE length(plate) = n)),
best AS (SELECT camera_id, track_id, i, ch FROM chars GROUP BY camera_id, track_id, i, ch QUALIFY row_number() OVER (PARTITION BY camera_id, track_id, i ORDER BY round(sum(ocr_conf + 0.5), 9) DESC, min(event_id)) = 1),
spelt AS (SELECT camera_id, track_id, string_agg(ch, '' ORDER BY i) AS plate FROM best GROUP BY ALL) SELECT * FROM spelt WHERE {extract_sql('plate')} = plate""", "plate_reads"),
    ),
    "modal_plates": (
        lambda s, d: plates.modal_plate(o.plate_reads(s, d)),
        o.sql(f"""WITH {CORRECTED}, a AS (SELECT camera_id, track_id, plate AS t, count(*) AS hits, sum(count(*)) OVER (PARTITION BY camera_id, track_id) AS n, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY count(*) DESC, min(frame_idx)) AS rk FROM reads WHERE plate IS NOT NULL GROUP BY camera_id, track_id, plate),
b AS (SELECT camera_id, track_id, t, count(*) AS hits, sum(count(*)) OVER (PARTITION BY camera_id, track_id) AS n, row_number() OVER (PARTITION BY camera_id, track_id ORDER BY count(*) DESC, min(frame_idx)) AS rk FROM (SELECT *, {_CLEAN.format('raw_text')} AS t FROM plate_reads) WHERE length(t) >= 6 GROUP BY camera_id, track_id, t)
SELECT camera_id, track_id, coalesce(a.t, b.t) AS plate, coalesce(a.hits, b.hits) AS hits, coalesce(a.n, b.n)::BIGINT AS n_reads FROM (SELECT * FROM a WHERE rk = 1) a FULL JOIN (SELECT * FROM b WHERE rk = 1) b USING (camera_id, track_id)""", "plate_reads"),
    ),
    "plate_consensus": (lambda s, d: plates.exact_consensus(o.plate_reads(s, d)), o.sql(f"WITH {CORRECTED}, {EXACT} SELECT * FROM plates", "plate_reads")),
    "plate_trajectories": (lambda s, d: plates.trajectory_consensus(o.plate_reads(s, d)), None),
    "plate_choice": (
        lambda s, d: plates.snapshot_or_live(plates.variant_vote(o.plate_reads(s, d).where("(frame_idx + track_id) % 2 = 0"), ["camera_id", "track_id"]), plates.exact_consensus(o.plate_reads(s, d))),
        o.sql(f"WITH {REPAIRED.replace('FROM plate_reads)', 'FROM plate_reads WHERE (frame_idx + track_id) % 2 = 0)').replace('SELECT * FROM plate_reads JOIN', 'SELECT * FROM (SELECT * FROM plate_reads WHERE (frame_idx + track_id) % 2 = 0) JOIN')}, {VARIANT}, {CORRECTED.replace('texts', 'texts2').replace('fixed', 'fixed2').replace('reads AS', 'reads2 AS')}, {EXACT.replace('FROM reads', 'FROM reads2')} SELECT camera_id, track_id, CASE WHEN take THEN s.plate ELSE l.plate END AS plate, CASE WHEN take THEN 'snapshot' ELSE 'live' END AS origin FROM (SELECT * FROM voted WHERE status = 'valid') s FULL JOIN plates l USING (camera_id, track_id), LATERAL (SELECT coalesce(s.plate IS NOT NULL AND (l.plate IS NULL OR s.support >= 2 OR s.conf > l.conf), false) AS take)", "plate_reads"),
    ),
    "total_plates": (lambda s, d: plates.total_plates(plates.exact_consensus(o.plate_reads(s, d))), o.sql(f"WITH {CORRECTED}, {EXACT} SELECT count(*) AS total_plates FROM plates", "plate_reads")),
    "token_plates": (
        lambda s, d: plates.token_plates(o.tokens(s, d)),
        o.sql(f"""WITH t AS (SELECT *, (tx1 + tx2) / 2.0::DOUBLE AS x, (ty1 + ty2) / 2.0::DOUBLE AS y, tx2 - tx1 AS w, ty2 - ty1 AS h FROM tokens),
j AS (SELECT a.image_id, a.tok_no AS seed, string_agg(b.text, '' ORDER BY floor((b.y - a.y) / a.h + 0.5), b.x, b.text) AS raw, avg(b.conf) AS conf FROM t a JOIN t b USING (image_id) WHERE abs(b.y - a.y) <= a.h * 2.2::DOUBLE AND abs(b.x - a.x) <= greatest(a.w, a.h * 3) * 3.5::DOUBLE GROUP BY ALL),
f AS (SELECT raw, {repair_sql('raw')} AS plate FROM (SELECT DISTINCT raw FROM j))
SELECT image_id, plate, round(round(conf * 1000000, 3), 0) / 1000000 AS conf FROM j JOIN f USING (raw) WHERE plate IS NOT NULL QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY round(conf * length(plate), 9) DESC, seed) = 1""", "tokens"),
    ),
    "text_lines": (
        lambda s, d: plates.text_lines(o.tokens(s, d)),
        o.sql("WITH t AS (SELECT *, (ty1 + ty2) / 2.0::DOUBLE AS cy, (ty2 - ty1)::DOUBLE AS h FROM tokens), l AS (SELECT image_id, tok_no, tx1, CASE WHEN lag(cy) OVER w IS NULL OR abs(cy - lag(cy) OVER w) < 0.5 * lag(h) OVER w THEN 0 ELSE 1 END AS line_no FROM t WINDOW w AS (PARTITION BY image_id ORDER BY cy, tx1, tok_no)) SELECT image_id, tok_no, line_no::BIGINT AS line_no, row_number() OVER (PARTITION BY image_id, line_no ORDER BY tx1, tok_no) AS place FROM l", "tokens"),
    ),
    "merged_plate_boxes": (merged_plate_boxes, None),
    "head_clusters": (lambda s, d: helmets.head_clusters(o.heads(s, d)), o.sql(f"WITH {CLUSTERS} SELECT * FROM kept", "heads")),
    "helmet_verdicts": (helmet_verdicts, o.sql(f"WITH {SEATS} SELECT * FROM verdicts", "heads", "snaps")),
    "live_helmets": (lambda s, d: helmets.live_status(o.heads(s, d)), o.sql(f"WITH {LIVE} SELECT * FROM live", "heads")),
    "helmet_violations": (lambda s, d: helmets.violations(o.heads(s, d)), o.sql(f"WITH {LIVE} SELECT camera_id, track_id, frame_idx, CASE WHEN n = 1 THEN 'Rider' ELSE 'Pillion' END AS role, CASE WHEN n = 1 THEN 'no_helmet_rider' ELSE 'no_helmet_pillion' END AS type, hx1, hy1, hx2, hy2 FROM ranked WHERE n <= 2 AND bad", "heads")),
    "sticky_helmets": (
        lambda s, d: helmets.sticky_status(helmets.live_status(o.heads(s, d))),
        o.sql(f"""WITH {LIVE}, s AS (SELECT camera_id, track_id, CASE WHEN bool_or(rider = 'no_helmet') THEN 'no_helmet' WHEN bool_or(rider = 'helmet') THEN 'helmet' ELSE 'unknown' END AS rider_helmet, CASE WHEN bool_or(pillion = 'no_helmet') THEN 'no_helmet' WHEN bool_or(pillion = 'helmet') THEN 'helmet' ELSE 'none' END AS pillion_helmet, arg_max(bad, frame_idx) FILTER (bad IS NOT NULL) AS last_violations FROM (SELECT *, nullif(concat_ws(',', CASE WHEN rider = 'no_helmet' THEN 'no_helmet_rider' END, CASE WHEN pillion = 'no_helmet' THEN 'no_helmet_pillion' END), '') AS bad FROM live) GROUP BY ALL)
SELECT *, CASE WHEN rider_helmet = 'no_helmet' OR pillion_helmet = 'no_helmet' THEN 'VIOLATION' ELSE 'COMPLIANT' END AS live_verdict, CASE rider_helmet WHEN 'no_helmet' THEN 'No Helmet' WHEN 'helmet' THEN 'Helmet' ELSE 'Unknown' END AS rider_text FROM s""", "heads"),
    ),
    "best_snapshots": (lambda s, d: helmets.best_snapshots(scored_snaps(s, d)), None),
    "bucket_snapshots": (
        shots,
        o.sql(f"WITH {SHOTS} SELECT * FROM shots", "snaps"),
    ),
    "presences": (
        lambda s, d: helmets.presences(o.vehicles(s, d)),
        o.sql("WITH a AS (SELECT camera_id, track_id, frame_idx, CASE WHEN frame_idx - lag(frame_idx) OVER (PARTITION BY camera_id, track_id ORDER BY frame_idx) > 45 THEN 1 ELSE 0 END AS new FROM vehicles), b AS (SELECT *, sum(new) OVER (PARTITION BY camera_id, track_id ORDER BY frame_idx)::BIGINT AS presence FROM a) SELECT camera_id, track_id, presence, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(*) AS n_obs FROM b GROUP BY ALL", "vehicles"),
    ),
}
