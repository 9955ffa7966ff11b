"""Keyed state with timers: tracks, corrected counts, ticks and session alerts.

Each operator is a stateful processor: named state variables in RocksDB, read
and written one by one (a track's votes are a map, so a new vote touches one
entry), timers in event time, expiry of what is not seen again.  A session's
end closes what is still open from the state that its checkpoint holds.

Rows without camera, track, time or frame are passed over; a null class counts
as the class ``unknown`` and is reported under Others.  Of a track's rows of one frame the first
by event_id counts, so repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from kerbside.functions import labels
from kerbside.functions.geometry import line_pixels
from kerbside.operators.counting import FULL_LINE
from kerbside.streaming.live import LATE, _meets, _side

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRACK_EVENT = "camera_id long, track_id long, frame_idx long, ts timestamp, event string, direction string, vehicle_class string, delta long"
_NAMES = [c.split()[0] for c in TRACK_EVENT.split(", ")]


def with_rocks(spark: SparkSession) -> None:
    """The store that named state variables need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _reported(raw: str) -> str:
    return labels.REPORTING.get(raw, labels.OTHERS)


def _ms(ts: pd.Timestamp) -> int:
    return int(ts.timestamp() * 1000)


class Tracks(StatefulProcessor):
    """A track's crossing, each later change of its class (one less of the old, one more of the new), and its end.

    State of a track: last point and frame, crossing, class it is counted as;
    and for each raw class its votes and first frame.
    """

    def __init__(self, line: tuple, idle_ms: int) -> None:
        self.line, self.idle_ms = line, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "x long, y long, frame long, seen long, crossed_at long, direction string, counted_as string")
        self.votes = handle.getMapState("votes", "raw string", "n long, first long")

    def leading(self) -> str:
        votes = {k[0]: v for k, v in self.votes.iterator()}
        return min(votes, key=lambda c: (-votes[c][0], votes[c][1]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["frame_idx", "event_id"]).drop_duplicates("frame_idx")
        x, y, frame, seen, at, direction, counted = self.place.get() if self.place.exists() else (None,) * 7
        out, before = [], seen
        for r in new.itertuples(index=False):
            if frame is not None and r.frame_idx <= frame:
                continue  # of a frame that is past
            raw = "unknown" if r.raw_class is None else r.raw_class
            n, first = self.votes.getValue((raw,)) if self.votes.containsKey((raw,)) else (0, int(r.frame_idx))
            self.votes.updateValue((raw,), (n + 1, first))
            cx, cy, now = int((r.x1 + r.x2) // 2), int(r.y2), int(r.frame_idx)
            if at is None and x is not None and _meets(self.line, x, y, cx, cy):
                at, direction, counted = now, "INBOUND" if _side(self.line, cx, cy) > 0 else "OUTBOUND", _reported(self.leading())
                out.append((*key, now, r.ts, "crossed", direction, counted, 1))
            elif at is not None and (voted := _reported(self.leading())) != counted:
                out += [(*key, now, r.ts, "corrected", direction, counted, -1), (*key, now, r.ts, "corrected", direction, voted, 1)]
                counted = voted
            x, y, frame, seen = cx, cy, now, max(seen or 0, _ms(r.ts))
        if seen is None:
            return
        self.place.update((x, y, frame, seen, at, direction, counted))
        if before is not None and before != seen:
            self.handle.deleteTimer(before + self.idle_ms)
        if before != seen:
            self.handle.registerTimer(seen + self.idle_ms)
        out.append((*key, frame, new["ts"].max(), "seen", None, None, 0))
        yield pd.DataFrame(out, columns=_NAMES)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.place.exists():
            return
        _, _, frame, seen, at, direction, counted = self.place.get()
        self.place.clear()
        self.votes.clear()
        if at is not None:
            ts = pd.Timestamp(max(seen + self.idle_ms, timerValues.getCurrentWatermarkInMs()), unit="ms")
            yield pd.DataFrame([(*key, frame, ts, "final", direction, counted, 0)], columns=_NAMES)

    def close(self) -> None:
        pass


def track_events(obs: DataFrame, line=FULL_LINE, width: int = 640, height: int = 1080, idle_ms: int = 90_000) -> DataFrame:
    """camera_id, track_id, frame_idx, ts, event (crossed, corrected, seen, final), direction, vehicle_class and delta.

    The sum of delta up to any frame is the count of crossed tracks of a class,
    by each track's leading class so far.
    """
    keyed = obs.dropna(subset=["camera_id", "track_id", "frame_idx", "ts"]).withWatermark("ts", LATE).groupBy("camera_id", "track_id")
    return keyed.transformWithStateInPandas(Tracks(line_pixels(line, width, height), idle_ms), TRACK_EVENT, "Append", "EventTime", eventTimeColumnName="ts")


class Ticks(StatefulProcessor):
    """The counts of a camera at each tick, whether or not anything happened since the one before."""

    def __init__(self, every_ms: int, start_ms: int) -> None:
        self.every_ms, self.start_ms = every_ms, start_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "tick long, last long")  # the next tick, and the newest row's time
        self.counts = handle.getMapState("counts", "vehicle_class string", "n long")
        self.waiting = handle.getListState("waiting", "at long, vehicle_class string, delta long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        times = [_ms(t) for t in new["ts"]]
        tick, last = self.clock.get() if self.clock.exists() else (None, 0)
        if tick is None:
            tick = self.start_ms
            self.handle.registerTimer(tick)
        self.clock.update((tick, max(last, *times)))
        for at, c, d in zip(times, new["vehicle_class"], new["delta"]):
            if d:
                self.waiting.appendValue((at, c, int(d)))
        yield pd.DataFrame([], columns=["camera_id", "tick", "total", "counts"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        tick, last = self.clock.get()
        mark = timerValues.getCurrentWatermarkInMs()
        counts = {k[0]: v[0] for k, v in self.counts.iterator()}
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        out, i = [], 0
        while tick <= min(mark, last):
            while i < len(waiting) and waiting[i][0] <= tick:
                counts[waiting[i][1]] = counts.get(waiting[i][1], 0) + waiting[i][2]
                i += 1
            out.append((key[0], pd.Timestamp(tick, unit="ms"), sum(counts.values()), {c: n for c, n in counts.items() if n}))
            tick += self.every_ms
        self.clock.update((tick, last))
        self.counts.clear()
        for c, n in counts.items():
            self.counts.updateValue((c,), (n,))
        self.waiting.clear()
        if waiting[i:]:
            self.waiting.put(waiting[i:])
        self.handle.registerTimer(max(tick, mark + 1))
        yield pd.DataFrame(out, columns=["camera_id", "tick", "total", "counts"])

    def close(self) -> None:
        pass


def cumulative_ticks(events: DataFrame, every_ms: int = 1_000, start_ms: int = 0) -> DataFrame:
    """camera_id, tick, total and counts by class at each tick up to the camera's newest row, once the watermark has passed it.

    ``events`` is what track_events gives; both operators run in one query.
    """
    keyed = events.where("event <> 'final'").groupBy("camera_id")
    schema = "camera_id long, tick timestamp, total long, counts map<string,long>"
    return keyed.transformWithStateInPandas(Ticks(every_ms, start_ms), schema, "Append", "EventTime")


class FirstAlert(StatefulProcessor):
    """The first row of a key in a session; state lives as long as the session's checkpoint."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "frame long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["frame_idx", "ts"])
        if not self.first.exists():
            self.first.update((int(new["frame_idx"].iloc[0]),))
            yield new.head(1)[["camera_id", "track_id", "type", "frame_idx", "ts"]]

    def close(self) -> None:
        pass


def session_alerts(violations: DataFrame) -> DataFrame:
    """The first alert of each track and type of a session, however far apart the others are; null keys are keys of their own."""
    keyed = violations.dropna(subset=["frame_idx"]).groupBy("camera_id", "track_id", "type")
    schema = "camera_id long, track_id long, type string, frame_idx long, ts timestamp"
    return keyed.transformWithStateInPandas(FirstAlert(), schema, "Append", "None")


def open_tracks(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """The tracks that a checkpoint of track_events still holds, as final rows."""
    state = spark.read.format("statestore").option("path", checkpoint).option("operatorId", operator).option("stateVarName", "place").load()
    v = "value."
    return state.where(F.col(v + "crossed_at").isNotNull()).select(
        F.col("key.camera_id").alias("camera_id"),
        F.col("key.track_id").alias("track_id"),
        F.col(v + "frame").alias("frame_idx"),
        F.timestamp_millis(F.col(v + "seen")).alias("ts"),
        F.lit("final").alias("event"),
        F.col(v + "direction").alias("direction"),
        F.col(v + "counted_as").alias("vehicle_class"),
        F.lit(0).cast("long").alias("delta"),
    )


def run_session(obs: DataFrame, path: str, checkpoint: str, **options: Any) -> None:
    """Work off all that is there into ``path``/events and close what is open into ``path``/open.

    The open tracks are written anew at each end, so a session that is run again
    adds nothing, and one that goes on takes back what was only its end for now.
    """
    spark = obs.sparkSession
    with_rocks(spark)
    events = track_events(obs, **options)
    written = events.writeStream.format("parquet").option("path", f"{path}/events").option("checkpointLocation", checkpoint)
    written.trigger(availableNow=True).start().awaitTermination()
    open_tracks(spark, checkpoint).write.mode("overwrite").parquet(f"{path}/open")


def finals(spark: SparkSession, path: str) -> DataFrame:
    """One final row for each crossed track of a session that has ended."""
    lost = spark.read.parquet(f"{path}/events").where("event = 'final'")
    return lost.unionByName(spark.read.parquet(f"{path}/open"))
