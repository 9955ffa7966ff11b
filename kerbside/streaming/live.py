"""Streaming queries over observations with event time.

Observations arrive as rows (camera_id, track_id, frame_idx, ts, ..).  Late
rows are dropped after the watermark.  State is kept by key: a track's state
goes when the track has not been seen for a while, and nothing is kept of a
track but counts.
"""

from __future__ import annotations

import hashlib
import statistics
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kerbside.functions import labels
from kerbside.functions.geometry import line_pixels
from kerbside.operators.counting import FULL_LINE
from kerbside.streaming import feed

LATE = "10 seconds"
OBSERVATION = "event_id long, ts timestamp, camera_id long, track_id long, frame_idx long, obs_no long, x1 long, y1 long, x2 long, y2 long, w long, h long, kind string, confidence double, raw_class string"
CROSSING = "camera_id long, track_id long, frame_idx long, direction string, voted_class string, final boolean"


def observations(spark: SparkSession, path: str, schema: str = OBSERVATION, files: int = 16) -> DataFrame:
    """A stream of the observation files that land in a folder; a bounded number of files is taken at a time, none is passed over."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def ticks(obs: DataFrame, width: str = "1 second") -> DataFrame:
    """Boxes of each class in each tumbling window, once the window is closed."""
    w = obs.withWatermark("ts", LATE).groupBy(F.window("ts", width).alias("w"), "camera_id")
    counts = [F.count_if(F.col("raw_class") == c).alias("n_" + c.replace("-", "_")) for c in labels.CANONICAL]
    return w.agg(F.count("*").alias("total"), *counts).select(F.col("w.start").alias("start"), "camera_id", "total", *[f"n_{c.replace('-', '_')}" for c in labels.CANONICAL])


def presences(obs: DataFrame, gap: str = "90 seconds") -> DataFrame:
    """A row for each stretch in which a track was seen, when it is lost."""
    g = obs.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap).alias("w"), "camera_id", "track_id")
    return g.agg(F.count("*").alias("n_obs"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame")).drop("w")


def alerts(violations: DataFrame) -> DataFrame:
    """The first alert of each track and type."""
    return violations.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["camera_id", "track_id", "type"])


def latest_alerts(violations: DataFrame, path: str, checkpoint: str) -> Any:
    """The last alert of each track and type, as a table that each batch renews."""
    return latest_feed(violations, ["camera_id", "track_id", "type"], "frame_idx", path, checkpoint)


def _side(line, x: int, y: int) -> int:
    ax, ay, bx, by = line
    v = (y - ay) * (bx - ax) - (by - ay) * (x - ax)
    return (v > 0) - (v < 0)


def _meets(line, px: int, py: int, x: int, y: int) -> bool:
    ax, ay, bx, by = line
    return _side(line, px, py) != _side(line, x, y) and _side(line, px, py) != 0 and _side((px, py, x, y), ax, ay) != _side((px, py, x, y), bx, by)


def crossings(obs: DataFrame, line=FULL_LINE, width: int = 640, height: int = 1080, idle_ms: int = 90_000) -> DataFrame:
    """The crossing of each track with its class so far, and again (final) when the track is lost and its class is settled.

    State of a track: last point, first crossing, and a count and first frame
    for each class.
    """
    pixels = line_pixels(line, width, height)
    state_schema = "x long, y long, frame long, crossed_at long, direction string, counts map<string,long>, firsts map<string,long>"

    def leading(counts: dict[str, int], firsts: dict[str, int]) -> str:
        return max(counts, key=lambda c: (counts[c], -firsts[c]))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["camera_id", "track_id", "frame_idx", "direction", "voted_class", "final"]
        if state.hasTimedOut:
            x, y, frame, at, direction, counts, firsts = state.get
            state.remove()
            rows = [(*key, at, direction, leading(counts, firsts), True)] if at is not None else []
            yield pd.DataFrame(rows, columns=columns)
            return
        x, y, frame, at, direction, counts, firsts = state.get if state.exists else (None, None, None, None, None, {}, {})
        counts, firsts, rows = dict(counts), dict(firsts), []
        all_ = pd.concat(list(frames)).sort_values("frame_idx")
        for r in all_.itertuples(index=False):
            if frame is not None and r.frame_idx <= frame:
                continue  # a late row of a frame that is past
            cx, cy = int((r.x1 + r.x2) // 2), int(r.y2)
            counts[r.raw_class] = counts.get(r.raw_class, 0) + 1
            firsts.setdefault(r.raw_class, int(r.frame_idx))
            if at is None and x is not None and _meets(pixels, x, y, cx, cy):
                at, direction = int(r.frame_idx), "INBOUND" if _side(pixels, cx, cy) > 0 else "OUTBOUND"
                rows.append((*key, at, direction, leading(counts, firsts), False))
            x, y, frame = cx, cy, int(r.frame_idx)
        state.update((x, y, frame, at, direction, counts, firsts))
        mark = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(mark, int(all_["ts"].max().timestamp() * 1000)) + idle_ms)
        yield pd.DataFrame(rows, columns=columns)

    keyed = obs.withWatermark("ts", LATE).groupBy("camera_id", "track_id")
    return keyed.applyInPandasWithState(step, CROSSING, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def confirmed_plates(reads: DataFrame, idle_ms: int = 90_000) -> DataFrame:
    """A track's plate whenever it is new or confirmed (seen twice); reads after that are passed over.

    ``reads`` has camera_id, track_id, frame_idx, ts and plate (a valid text).
    """
    state_schema = "plates map<string,long>, done boolean"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["camera_id", "track_id", "plate", "status"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        plates, done = state.get if state.exists else ({}, False)
        plates, rows = dict(plates), []
        all_ = pd.concat(list(frames)).sort_values("frame_idx")
        for plate in all_["plate"]:
            if done:
                break
            plates[plate] = plates.get(plate, 0) + 1
            done = plates[plate] >= 2
            if done or len(plates) == 1:
                rows.append((*key, plate, "confirmed" if done else "provisional"))
        state.update((plates, done))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(all_["ts"].max().timestamp() * 1000)) + idle_ms)
        yield pd.DataFrame(rows, columns=columns)

    keyed = reads.withWatermark("ts", LATE).groupBy("camera_id", "track_id")
    return keyed.applyInPandasWithState(step, "camera_id long, track_id long, plate string, status string", state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def rolling_labels(votes: DataFrame, window: int = 15, fewest: int = 3, share: float = 0.6, idle_ms: int = 90_000) -> DataFrame:
    """After each batch: the label that a track's latest votes agree on, or unknown.

    ``votes`` has camera_id, track_id, frame_idx, ts, label and conf (accepted votes).
    """
    state_schema = "labels array<string>, confs array<double>"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["camera_id", "track_id", "n_votes", "label"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        names, confs = map(list, state.get) if state.exists else ([], [])
        all_ = pd.concat(list(frames)).sort_values("frame_idx")
        names, confs = (names + all_["label"].tolist())[-window:], (confs + all_["conf"].tolist())[-window:]
        weight: dict[str, float] = {}
        for n, c in zip(names, confs):
            weight[n] = weight.get(n, 0.0) + c
        best = max(weight, key=lambda n: round(weight[n], 9))
        sure = len(names) >= fewest and round(weight[best] / sum(confs), 9) >= share
        state.update((names, confs))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(all_["ts"].max().timestamp() * 1000)) + idle_ms)
        yield pd.DataFrame([(*key, len(names), best if sure else "unknown")], columns=columns)

    keyed = votes.withWatermark("ts", LATE).groupBy("camera_id", "track_id")
    return keyed.applyInPandasWithState(step, "camera_id long, track_id long, n_votes long, label string", state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def rolling_median(counts: DataFrame, seconds: float = 2.0, idle_ms: int = 90_000) -> DataFrame:
    """Each count of a camera with the whole-number median of the counts of the seconds up to it.

    ``counts`` has camera_id, frame_idx, ts and n; state is the counts of that stretch of time.
    """
    columns = ["camera_id", "frame_idx", "n", "smoothed"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        times, values = map(list, state.get) if state.exists else ([], [])
        all_, rows = pd.concat(list(frames)).sort_values(["ts", "frame_idx"]), []
        for r in all_.itertuples(index=False):
            now = int(r.ts.timestamp() * 1_000_000)
            times, values = [*times, now], [*values, int(r.n)]
            live = [i for i, t in enumerate(times) if t >= now - seconds * 1_000_000]
            times, values = [times[i] for i in live], [values[i] for i in live]
            rows.append((*key, int(r.frame_idx), int(r.n), int(statistics.median(values))))
        state.update((times, values))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(all_["ts"].max().timestamp() * 1000)) + idle_ms)
        yield pd.DataFrame(rows, columns=columns)

    keyed = counts.withWatermark("ts", LATE).groupBy("camera_id")
    schema = "camera_id long, frame_idx long, n long, smoothed long"
    return keyed.applyInPandasWithState(step, schema, "times array<long>, values array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append", form: str = "parquet", **options: Any) -> None:
    """Work off all that is there, write it and end; run again with the same checkpoint it goes on from there.

    A log as CSV: ``form="csv", header=True``; each file has its header, and readers take it for one.
    """
    df.writeStream.format(form).options(**options).option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def latest_feed(df: DataFrame, keys: list[str], order: str, path: str, checkpoint: str) -> Any:
    """Keep a table of the newest row of each key, as JSON beside its key, by parts (``feed.table`` reads it); the checkpoint is its session."""
    return feed.keep(df, keys, order, path, checkpoint, hashlib.sha256(checkpoint.encode()).hexdigest()[:16])
