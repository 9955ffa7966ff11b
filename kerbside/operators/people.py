"""Demographic votes, stable tracks and counts of pedestrians."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions import labels
from kerbside.operators import spatial

TRACK = ["camera_id", "track_id"]


def accepted_votes(votes: DataFrame, least: float = 0.5, attempts: int = 10) -> DataFrame:
    """The votes that count: of a track's first attempts those that are sure enough."""
    n = F.row_number().over(Window.partitionBy(*TRACK).orderBy("frame_idx"))
    v = votes.withColumn("attempt", n).where(F.col("attempt") <= attempts)
    return v.withColumn("label", labels.demographic(F.col("model_label"), F.col("conf"), least)).where("label <> 'unknown'")


def consensus(accepted: DataFrame, window: int = 15, fewest: int = 3, share: float = 0.6) -> DataFrame:
    """The label that a track's latest votes agree on by confidence, or unknown."""
    back = F.row_number().over(Window.partitionBy(*TRACK).orderBy(F.col("frame_idx").desc()))
    v = accepted.withColumn("back", back).where(F.col("back") <= window)
    per = v.groupBy(*TRACK, "label").agg(F.sum("conf").alias("s"), F.count("*").alias("n"), F.min("frame_idx").alias("first"))
    best = per.groupBy(*TRACK).agg(F.sum("s").alias("all"), F.sum("n").alias("n_votes"), F.max_by(F.struct("label", "s"), F.struct(F.round("s", 9), -F.col("first"))).alias("b"))
    sure = (F.col("n_votes") >= fewest) & (F.round(F.col("b.s") / F.col("all"), 9) >= share)
    return best.select(*TRACK, "n_votes", F.when(sure, F.col("b.label")).otherwise("unknown").alias("label"), F.round(F.col("b.s") / F.col("all"), 6).alias("share"))


def rolling_votes(accepted: DataFrame, window: int = 15) -> DataFrame:
    """At each vote: the leading label and its share over the latest votes."""
    w = Window.partitionBy(*TRACK).orderBy("frame_idx").rowsBetween(1 - window, 0)
    sums = {x: F.sum(F.when(F.col("label") == x, F.col("conf")).otherwise(0.0)).over(w) for x in ("male_adult", "female_adult", "child")}
    best = F.array_max(F.array(*[F.struct(F.round(s, 6).alias("s"), F.lit(x).alias("label")) for x, s in sums.items()]))
    return accepted.select(*TRACK, "frame_idx", best["label"].alias("leading"), F.round(best["s"] / F.sum("conf").over(w), 6).alias("share"), F.count("*").over(w).alias("n_window"))


def stable_tracks(persons: DataFrame, fewest: int = 8, least_height: int = 60) -> DataFrame:
    return persons.where(F.col("h") >= least_height).groupBy(*TRACK).agg(F.count("*").alias("n_frames")).where(F.col("n_frames") >= fewest)


def session_totals(persons: DataFrame, agreed: DataFrame) -> DataFrame:
    """Stable tracks by agreed label; those without one are unknown."""
    s = stable_tracks(persons).join(agreed.select(*TRACK, "label"), TRACK, "left")
    label = F.coalesce("label", F.lit("unknown"))
    return s.agg(F.count("*").alias("total"), F.count_if(label == "male_adult").alias("males"), F.count_if(label == "female_adult").alias("females"), F.count_if(label == "child").alias("children"), F.count_if(label == "unknown").alias("unknown"))


def frame_summary(votes: DataFrame) -> DataFrame:
    """Who is in each frame just now, with the details packed."""
    label = labels.demographic(F.col("model_label"), F.col("conf"))
    v = votes.select("camera_id", "frame_idx", "track_id", label.alias("label"))
    details = F.array_join(F.array_sort(F.collect_list(F.concat(F.lpad(F.col("track_id").cast("string"), 12, "0"), F.lit(":"), F.col("label")))), "|")
    return v.groupBy("camera_id", "frame_idx").agg(F.count("*").alias("total"), F.count_if(F.col("label") == "male_adult").alias("males"), F.count_if(F.col("label") == "female_adult").alias("females"), F.count_if(F.col("label") == "child").alias("children"), F.count_if(F.col("label") == "unknown").alias("unknown"), details.alias("details"))


def tally(votes: DataFrame) -> DataFrame:
    """Votes by synonym."""
    n = F.lower(F.trim("model_label"))
    word = F.when(n.isin("male", "man", "boy", "male_adult"), "males").when(n.isin("female", "woman", "girl", "female_adult"), "females").when(n.isin("child", "kid", "children"), "children").otherwise("unknown")
    return votes.groupBy(word.alias("category")).agg(F.count("*").alias("n"))


def running_labels(accepted: DataFrame, window: int = 15, fewest: int = 3, share: float = 0.6) -> DataFrame:
    """The label of a track after each of its votes: what the latest votes agree on, or unknown."""
    r = rolling_votes(accepted, window)
    return r.select(*TRACK, "frame_idx", F.when((F.col("n_window") >= fewest) & (F.col("share") >= share), F.col("leading")).otherwise("unknown").alias("label"))


def adult_height(persons: DataFrame, accepted: DataFrame, frames: DataFrame) -> DataFrame:
    """Mean height of those who count as adults by the votes so far (else of everyone), carried over frames without a person.

    frames: (camera_id, frame_idx) of the frames to report; those before the
    first person have none.
    """
    p = spatial.as_of(persons.select(*TRACK, "frame_idx", "h"), running_labels(accepted), TRACK, "frame_idx", "label")
    h = p.groupBy("camera_id", "frame_idx").agg(F.avg(F.when(F.col("label").isin("male_adult", "female_adult"), F.col("h"))).alias("adults"), F.avg("h").alias("everyone"))
    h = h.select("camera_id", "frame_idx", F.round(F.coalesce("adults", "everyone"), 6).alias("mean_height"))
    return spatial.carried(frames.join(h, ["camera_id", "frame_idx"], "left"), ["camera_id"], "frame_idx", "mean_height")


def median_counts(persons: DataFrame, seconds: int = 2, stretch: int = 3600) -> DataFrame:
    """Rolling median, in whole numbers, of the persons of a frame over the seconds up to its first observation.

    A camera's frames are dealt into stretches of time; those that the next
    stretch looks back on are dealt to it as well.
    """
    per = persons.groupBy("camera_id", "frame_idx").agg(F.count("*").alias("n"), F.unix_micros(F.min("ts").cast("timestamp")).alias("t"))
    at = lambda t: F.floor(t / (stretch * 1_000_000))
    own, later = at(F.col("t")), at(F.col("t") + seconds * 1_000_000)
    dealt = per.withColumn("own", own).withColumn("stretch", F.explode(F.array_distinct(F.array(own, later))))
    w = Window.partitionBy("camera_id", "stretch").orderBy("t").rangeBetween(-seconds * 1_000_000, 0)
    return dealt.withColumn("smoothed", F.floor(F.percentile("n", 0.5).over(w)).cast("long")).where("own = stretch").select("camera_id", "frame_idx", "n", "smoothed")
