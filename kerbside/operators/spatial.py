"""Joins of boxes that stand in the same frame.

All of them are equi joins on (camera_id, frame_idx) with the geometry as a
further condition, so a frame's few dozen boxes are all that meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions import geometry as g
from kerbside.functions import labels

FRAME = ["camera_id", "frame_idx"]


def plates_to_vehicles(plates: DataFrame, vehicles: DataFrame, least: float = 0.40) -> DataFrame:
    """Each plate box with the vehicle that holds most of it (at least the share given; of equals the lower track)."""
    v = vehicles.select(*FRAME, "track_id", *[F.col(c).alias(f"v{c}") for c in ("x1", "y1", "x2", "y2")])
    p = plates.select(*FRAME, F.col("event_id").alias("plate_id"), "px1", "py1", "px2", "py2", "det_conf")
    j = p.join(v, FRAME).withColumn("share", g.inner_ratio(g.box("p"), g.box("v"))).where(F.col("share") >= least)
    best = j.groupBy("plate_id", *FRAME, "px1", "py1", "px2", "py2", "det_conf").agg(F.max_by(F.struct("track_id", "share"), F.struct("share", -F.col("track_id"))).alias("b"))
    return best.select("plate_id", *FRAME, F.col("b.track_id").alias("track_id"), F.round("b.share", 6).alias("share"), "det_conf")


def plausible(b: g.Box, least: float = 0.8, most: float = 6.5) -> Column:
    """Whether a box has the shape of a plate."""
    w, h = b[2] - b[0], b[3] - b[1]
    return (w > 2) & (h > 2) & (w / F.nullif(h, F.lit(0))).between(least, most)


def crop_pass(plates: DataFrame, vehicles: DataFrame, matched: DataFrame, most: int = 6, every: int = 2) -> DataFrame:
    """The best plausible plate box centred in each of a frame's largest small vehicles that have none yet.

    Two-wheelers and three-wheelers only, each in every second frame; a
    vehicle of 8 pixels or less takes its place among the largest, but is not
    looked at.
    """
    due = F.lower("raw_class").isin(labels.CROP_PASS_CLASSES) & ((F.col("frame_idx") + F.col("track_id")) % every == 0)
    rest = vehicles.where(due).join(matched.select(*FRAME, "track_id").distinct(), [*FRAME, "track_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy(*FRAME).orderBy(g.area(g.box()).desc(), "track_id"))
    top = rest.withColumn("rank", rank).where(F.col("rank") <= most).where("x2 - x1 > 8 and y2 - y1 > 8")
    v = top.select(*FRAME, "track_id", *[F.col(c).alias(f"v{c}") for c in ("x1", "y1", "x2", "y2")])
    j = plates.select(*FRAME, F.col("event_id").alias("plate_id"), "px1", "py1", "px2", "py2", "det_conf").where(plausible(g.box("p"))).join(v, FRAME).where(g.centre_in(g.box("p"), g.box("v")))
    return j.groupBy(*FRAME, "track_id").agg(F.max_by(F.struct("plate_id", "det_conf"), F.struct("det_conf", -F.col("plate_id"))).alias("b")).select(*FRAME, "track_id", "b.plate_id", "b.det_conf")


def _riders(persons: DataFrame, vehicles: DataFrame, ratio: float, up: float):
    v = vehicles.select(*FRAME, F.col("raw_class").alias("v_class"), *[F.col(c).alias(f"v{c}") for c in ("x1", "y1", "x2", "y2")])
    inside = g.inner_ratio(g.box(), g.box("v")) >= ratio
    above = labels.is_small_vehicle(F.col("v_class")) & g.centre_in_raised(g.box(), g.box("v"), up)
    return v, inside | above


def pedestrians(persons: DataFrame, vehicles: DataFrame, ratio: float = 0.5, up: float = 0.4) -> DataFrame:
    """Persons who do not ride on any vehicle of their frame."""
    v, rides = _riders(persons, vehicles, ratio, up)
    same = (persons["camera_id"] == v["camera_id"]) & (persons["frame_idx"] == v["frame_idx"])
    return persons.join(v, same & rides, "left_anti")


def pedestrians_by_iou(persons: DataFrame, vehicles: DataFrame, most: float = 0.30) -> DataFrame:
    """The earlier rule: persons whose box meets no vehicle's in more than a share of their union."""
    v = vehicles.select(F.col("camera_id").alias("v_camera"), F.col("frame_idx").alias("v_frame"), *[F.col(c).alias(f"v{c}") for c in ("x1", "y1", "x2", "y2")])
    same = (F.col("camera_id") == F.col("v_camera")) & (F.col("frame_idx") == F.col("v_frame"))
    return persons.join(v, same & (g.iou(g.box(), g.box("v")) >= most), "left_anti")


def united_boxes(boxes: DataFrame, width: int, height: int, aspect: tuple[float, float], box=("px1", "py1", "px2", "py2")) -> DataFrame:
    """Boxes found in the whole frame and in enlarged parts of it, in one frame of reference.

    ``boxes`` carries beside the box the part's origin (ox, oy) and scale; boxes
    of four pixels or less, and those of another shape, go; the rest are clipped.
    """
    moved = g.to_frame(tuple(F.col(c) for c in box), F.col("ox"), F.col("oy"), F.col("scale"))
    d = boxes.withColumns(dict(zip(box, moved)))
    w, h = F.col(box[2]) - F.col(box[0]), F.col(box[3]) - F.col(box[1])
    kept = d.where((w > 4) & (h > 4) & (w / h).between(*aspect))
    return kept.withColumns(dict(zip(box, g.clipped(tuple(F.col(c) for c in box), width, height)))).drop("ox", "oy", "scale")


def compare_rules(persons: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Totals of the two rules side by side."""
    def totals(df, name):
        t = df.agg(F.count("*").alias("rows"), F.count_distinct("camera_id", "track_id").alias("tracks"))
        return t.unpivot([], ["rows", "tracks"], "metric", name)

    return totals(pedestrians(persons, vehicles), "new").join(totals(pedestrians_by_iou(persons, vehicles), "old"), "metric", "full").select("metric", "old", "new", (F.col("new") - F.col("old")).alias("change"))


def carried(df: DataFrame, keys: list[str], order: str, value: str, stretch: int = 10_000) -> DataFrame:
    """``df`` with the latest value of its key that is not null, at or before each row.

    A key's rows are dealt into stretches of the (whole-number) order, so that
    one busy key does not end in one task; what a stretch begins with comes
    from a window over one row for each stretch.  A null key is a key like any other.
    """
    s = df.withColumn("_stretch", F.floor(F.col(order) / stretch))
    ends = s.groupBy(*keys, "_stretch").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    by = [*keys, "_stretch"]
    ends = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).select(*[F.col(k).alias(f"_of_{k}") for k in by], "_before")
    inside = Window.partitionBy(*keys, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    j = s.withColumn(value, F.last(value, ignorenulls=True).over(inside)).join(ends, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in by])
    return j.withColumn(value, F.coalesce(value, "_before")).select(*df.columns)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Each left row with the latest value of its key at or before its place in the order (both sides once through one window)."""
    both = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("is_left")).unionByName(right.select(*keys, order, value, F.lit(0).alias("is_left")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(order, "is_left").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("is_left = 1").drop("is_left")
