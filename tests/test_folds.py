"""Queries without SQL against plain Python over the collected rows."""

from collections import defaultdict

from kerbside.functions import geometry as g
from kerbside.operators import datasets, plates
from kerbside.plans import catalogue, reports, vehicles
from kerbside.sources import observations as o
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def query(spark, name):
    return catalogue.queries()[name](spark, SF).collect()


def reads_of(spark, *tracks):
    """Reads (text, confidence) of tracks, in order, all of one size and detection confidence."""
    rows = [(0, t, i, text, conf, 0.5, 400) for t, reads in enumerate(tracks) for i, (text, conf) in enumerate(reads)]
    return spark.createDataFrame(rows, "camera_id long, track_id long, frame_idx long, raw_text string, ocr_conf double, det_conf double, bbox_area long")


def test_plate_trajectories_worked_by_hand(spark):
    good, near, other = "KA05AB1234", "KA05AB1284", "MH12CD5678"
    got = plates.trajectory_consensus(reads_of(
        spark,
        [("..", 0.9)] * 14 + [(good, 0.3), (good, 0.9)],  # the sixteenth read is never made, a single weak one is no plate
        [("..", 0.9)] * 14 + [(good, 0.5), (good, 0.9)],  # surer: a plate, but only provisionally
        [("", 0.9)] * 20 + [(good, 0.3), (good, 0.4)],  # empty reads are not counted
        [(near, 0.2), (good, 0.4), (other, 0.9)],  # two near reads settle it before the third is made; the heavier text is taken
        [(other, 0.5), (good, 0.3), (near, 0.6)],  # provisional first, then confirmed by a heavier cluster
        [(other, 0.4), ("x", 0.9)],
    ))
    assert {tuple(r)[1:] for r in got.collect()} == {
        (1, good, 1, 0.5, True),
        (2, good, 2, 0.35, False),
        (3, good, 2, 0.4, False),
        (4, near, 2, 0.6, False),
    }


def test_plate_trajectories_of_events(spark):
    """Every plate is one of the track's first 15 reads that are not empty, and only tracks whose plates are all single and weak have none."""
    first = defaultdict(list)
    for r in plates.corrected(o.plate_reads(spark, SF)).orderBy("frame_idx").collect():
        if r.raw_text and len(first[(r.camera_id, r.track_id)]) < 15:
            first[(r.camera_id, r.track_id)].append((r.plate, r.ocr_conf))
    rows = query(spark, "plate_trajectories")
    found = {(r.camera_id, r.track_id): r for r in rows}
    assert len(found) == len(rows) > 0
    for k, reads in first.items():
        valid = [x for x in reads if x[0] is not None]
        if k in found:
            assert found[k].plate in {x[0] for x in valid} and found[k].provisional == (found[k].support == 1)
        else:
            assert all(c < 0.45 for _, c in valid) and len({x for x, _ in valid}) == len(valid)


def test_merged_plate_boxes(spark):
    frames = defaultdict(list)
    for r in o.plate_boxes(spark, SF).collect():
        b = (r.px1, r.py1, r.px2, r.py2)
        frames[(r.camera_id, r.frame_idx)].append((-round(r.det_conf * ((b[2] - b[0]) * (b[3] - b[1])) ** 0.5, 9), r.event_id, b))
    kept = set()
    for boxes in frames.values():
        mine = []
        for _, e, b in sorted(boxes):
            def iou(c):
                w, h = min(b[2], c[2]) - max(b[0], c[0]), min(b[3], c[3]) - max(b[1], c[1])
                s = max(0, w) * max(0, h)
                return s / ((b[2] - b[0]) * (b[3] - b[1]) + (c[2] - c[0]) * (c[3] - c[1]) - s)
            if all(iou(c) <= 0.4 for c in mine):
                mine.append(b)
                kept.add(e)
    assert {r.event_id for r in query(spark, "merged_plate_boxes")} == kept


def test_best_snapshots(spark):
    """What the rule promises of the kept: candidates of the track, few, best first, and no candidate clearly better than the best of them."""
    tracks, kept = defaultdict(dict), defaultdict(list)
    for r in vehicles.scored_snaps(spark, SF).collect():
        tracks[(r.camera_id, r.track_id)][r.event_id] = (r.frame_idx, r.score)
    for r in query(spark, "best_snapshots"):
        kept[(r.camera_id, r.track_id)].append((r.place, r.score, r.frame_idx, r.event_id))
    assert set(kept) == set(tracks)
    for k, rows in kept.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(len(rows))) and len(rows) <= 3
        assert [r[1] for r in rows] == sorted((r[1] for r in rows), reverse=True)
        assert all(tracks[k][r[3]] == (r[2], r[1]) for r in rows)
        top = max(score for _, score in tracks[k].values())
        assert rows[0][1] * 1.08 >= top


def test_best_snapshots_worked_by_hand(spark):
    """The second moment is replaced by a clearly better one near it; of a full set the worst goes for a clearly better one."""
    from kerbside.operators import helmets

    hand = {1: [(0, 1.0), (3, 1.05), (5, 1.2), (12, 0.5), (20, 0.6), (30, 0.53), (40, 0.7)], 2: [(0, 2.0), (6, 1.0), (12, 1.0), (18, 1.05), (24, 1.09)], 3: [(5, None), (9, 1.0), (None, 3.0)]}
    rows = [(0, t, f, 100 * t + i, s) for t, all_ in hand.items() for i, (f, s) in enumerate(all_)]
    got = helmets.best_snapshots(spark.createDataFrame(rows, "camera_id long, track_id long, frame_idx long, event_id long, score double"))
    assert {(r.track_id, r.event_id, r.place) for r in got.collect()} == {(1, 102, 0), (1, 106, 1), (1, 104, 2), (2, 200, 0), (2, 204, 1), (2, 202, 2), (3, 301, 0)}
    assert helmets.best_snapshots(spark.createDataFrame([], "camera_id long, track_id long, frame_idx long, event_id long, score double")).count() == 0


def test_frame_rates(spark):
    times = defaultdict(list)
    for r in o.detections(spark, SF).collect():
        times[r.camera_id].append(r.ts)
    want = {}
    for k, t in times.items():
        t, rate = sorted(t), 0.0
        for a, b in zip(t, t[1:]):
            if (dt := (b - a).total_seconds()) > 0:
                rate = 0.9 * rate + 0.1 / dt
        want[k] = round(rate, 6)
    assert {r.camera_id: r.rate for r in query(spark, "frame_rates")} == want


def test_near_pairs_of_many_distances(spark):
    rows = [(i, sum(1 << b for b in range(i))) for i in range(40)]
    df = spark.createDataFrame([(k, [b]) for k, b in rows], "k long, bits array<long>")
    got = {(r.k, r.other) for r in datasets.near_pairs(df, "k", "bits", 10, 64).collect()}
    assert got == {(a, b) for a in range(40) for b in range(a + 1, 40) if b - a <= 10}
    assert spark.range(1).select(g.iou(*[tuple(F.lit(v) for v in x) for x in ((0, 0, 2, 2), (0, 0, 2, 2))])).first()[0] == 1.0
