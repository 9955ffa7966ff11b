"""Line crossings, class votes and counts.

Everything of a track shares one shuffle on (camera_id, track_id); state that
a frame loop would carry is a window or a keyed aggregate here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions import geometry as g
from kerbside.functions import labels

TRACK = ("camera_id", "track_id")
#: The line as fractions of the frame: across all of it, or a short one.
FULL_LINE = (0.0, 0.65, 1.0, 0.65)
SHORT_LINE = (0.0, 0.65, 0.2, 0.65)


def crossings(dets: DataFrame, line=FULL_LINE, width: int = 640, height: int = 1080) -> DataFrame:
    """The first crossing of each track: camera_id, track_id, frame_idx, direction.

    A track crosses where its bottom centre changes sides between two of its
    observations and the step meets the line itself; landing on the line
    counts, leaving from it does not.
    """
    ax, ay, bx, by = (F.lit(v) for v in g.line_pixels(line, width, height))
    x, y = g.bottom_centre(g.box())
    w = Window.partitionBy(*TRACK).orderBy("frame_idx")
    d = dets.select(*TRACK, "frame_idx", x.alias("x"), y.alias("y"))
    d = d.withColumn("px", F.lag("x").over(w)).withColumn("py", F.lag("y").over(w))
    before, now = g.turn(ax, ay, bx, by, F.col("px"), F.col("py")), g.turn(ax, ay, bx, by, F.col("x"), F.col("y"))
    ends = g.turn(F.col("px"), F.col("py"), F.col("x"), F.col("y"), ax, ay) != g.turn(F.col("px"), F.col("py"), F.col("x"), F.col("y"), bx, by)
    d = d.withColumn("side", now).where((before != now) & (before != 0) & ends)
    first = d.groupBy(*TRACK).agg(F.min(F.struct("frame_idx", "side")).alias("f"))
    return first.select(*TRACK, "f.frame_idx", F.when(F.col("f.side") > 0, "INBOUND").otherwise("OUTBOUND").alias("direction"))


def voted_class(dets: DataFrame) -> DataFrame:
    """The class that most of a track's observations have; of equals the one seen first."""
    n = dets.groupBy(*TRACK, "raw_class").agg(F.count("*").alias("n"), F.min("frame_idx").alias("first"))
    best = n.groupBy(*TRACK).agg(F.max_by("raw_class", F.struct("n", -F.col("first"))).alias("voted_class"), F.sum("n").alias("n_obs"))
    return best.withColumn("vehicle_class", labels.reporting_class(F.col("voted_class")))


def last_seen(dets: DataFrame) -> DataFrame:
    return dets.groupBy(*TRACK).agg(F.max("frame_idx").alias("last_frame"), F.max_by("raw_class", "frame_idx").alias("last_class"))


def crossed_classes(dets: DataFrame, line=FULL_LINE) -> DataFrame:
    """Crossed tracks with direction and voted class (over their whole history)."""
    return crossings(dets, line).join(voted_class(dets), list(TRACK))


def class_counts(crossed: DataFrame) -> DataFrame:
    """Tracks for each reporting class, zeros included, and their total."""
    spark = crossed.sparkSession
    names = spark.createDataFrame([(c,) for c in [*dict.fromkeys(labels.REPORTING.values()), labels.OTHERS]], "vehicle_class string")
    n = crossed.groupBy("vehicle_class").agg(F.count("*").alias("n"))
    each = names.join(F.broadcast(n), "vehicle_class", "left").select("vehicle_class", F.coalesce("n", F.lit(0)).alias("n"))
    return each.unionByName(crossed.agg(F.lit("TOTAL").alias("vehicle_class"), F.count("*").alias("n")))


def crossing_report(dets: DataFrame, line=SHORT_LINE) -> DataFrame:
    """Counts by direction and class with subtotals."""
    r = crossed_classes(dets, line).rollup("direction", "vehicle_class").agg(F.count("*").alias("n_tracks"), F.grouping_id().alias("level"))
    return r.select(F.when(F.col("level") >= 3, "TOTAL").otherwise(F.col("direction")).alias("direction"), F.when(F.col("level") >= 1, "TOTAL").otherwise(F.col("vehicle_class")).alias("vehicle_class"), "n_tracks")


def direction_pivot(crossed: DataFrame) -> DataFrame:
    return crossed.groupBy("vehicle_class").pivot("direction", ["INBOUND", "OUTBOUND"]).count().na.fill(0).withColumnsRenamed({"INBOUND": "inbound", "OUTBOUND": "outbound"})


def frame_counts(dets: DataFrame) -> DataFrame:
    """Boxes of each class in each frame, zeros included; the total counts every row."""
    columns = [F.count_if(F.col("raw_class") == c).alias("n_" + c.replace("-", "_")) for c in labels.CANONICAL]
    return dets.groupBy("camera_id", "frame_idx").agg(*columns, F.count("*").alias("total"))


def running_votes(dets: DataFrame) -> DataFrame:
    """After each observation of a track: its leading class so far (of equals the one seen first)."""
    w = Window.partitionBy(*TRACK).orderBy("frame_idx")
    n = {c: F.sum(F.when(F.col("raw_class") == c, 1).otherwise(0)).over(w) for c in labels.CANONICAL}
    first = {c: F.min(F.when(F.col("raw_class") == c, F.col("frame_idx"))).over(w) for c in labels.CANONICAL}
    best = F.array_max(F.array(*[F.struct(n[c].alias("n"), (-F.coalesce(first[c], F.lit(1 << 60))).alias("f"), F.lit(c).alias("c")) for c in labels.CANONICAL]))
    return dets.select(*TRACK, "frame_idx", best["c"].alias("leading"), F.row_number().over(w).cast("long").alias("age"))


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, stretch: int = 10_000) -> DataFrame:
    """``df`` with the sum of its key's values up to each row, rows of the same place in the order included.

    A key's rows are dealt into stretches of the (whole-number) order, so that
    one busy key does not end in one task; what a stretch begins with comes
    from a window over one row for each stretch.  Null values add nothing, null
    keys and places in the order are values like any other (null places first).
    """
    by = [*keys, "_stretch"]
    s = df.withColumn("_stretch", F.floor(F.col(order) / stretch))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = s.groupBy(*by).agg(F.sum(value).alias("_sum")).withColumn("_before", F.sum("_sum").over(before))
    ends = ends.select(*[F.col(k).alias(f"_of_{k}") for k in by], "_before")
    inside = s.withColumn(value, F.sum(value).over(Window.partitionBy(*by).orderBy(order)))
    j = inside.join(ends, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in by])
    return j.withColumn(value, F.coalesce(value, F.lit(0)) + F.coalesce("_before", F.lit(0))).select(*df.columns)


def cumulative_counts(crossed: DataFrame) -> DataFrame:
    """Crossed tracks of each class up to each frame with a crossing, for each camera."""
    per = crossed.groupBy("camera_id", "vehicle_class", "frame_idx").agg(F.count("*").alias("n_so_far"))
    return running_sum(per, ["camera_id", "vehicle_class"], "frame_idx", "n_so_far")


def class_changes(dets: DataFrame, line=SHORT_LINE) -> DataFrame:
    """What each observation does to the counts of crossed tracks: camera_id, frame_idx, vehicle_class, n (1 or -1).

    A track counts from its crossing on under the class that leads its votes;
    when another takes the lead, the old class loses one and the new one gains one.
    """
    since = crossings(dets, line).select(*TRACK, F.col("frame_idx").alias("crossed_at"))
    now = running_votes(dets).join(since, list(TRACK)).where("frame_idx >= crossed_at").withColumn("now", labels.reporting_class(F.col("leading")))
    d = now.withColumn("was", F.lag("now").over(Window.partitionBy(*TRACK).orderBy("frame_idx"))).where(~F.col("now").eqNullSafe(F.col("was")))
    gain, loss = F.struct(F.col("now").alias("c"), F.lit(1).alias("n")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("n"))
    return d.select("camera_id", "frame_idx", F.explode(F.array(gain, loss)).alias("x")).where("x.c is not null").select("camera_id", "frame_idx", F.col("x.c").alias("vehicle_class"), F.col("x.n").cast("long").alias("n"))
