"""Streaming forms (ST1, ST2): frames as they arrive."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lattica.operators.windows import majority_events

EVENT = "cell int, lipid_nr int, bind_i int, bind_f int, dwell int"
CHANGE = f"{EVENT}, late bigint"
#: State that a batch run can hand over: the last 2r + 1 labels, the frame that follows them, and the open event, if any.
HELD = "cell int, ring array<int>, next int, lipid_nr int, bind_i int, bind_f int"


class MajorityEvents(StatefulProcessor):
    """One cell: a typed ring buffer, the open event, and the frames that the watermark has not passed. A timer at the earliest of these takes
    them in order, once it has. Rows that come after the watermark has passed them are counted."""

    def __init__(self, r: int) -> None:
        self.r, self.span = r, 2 * r + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", "labels array<int>, next int")
        self.open = handle.getValueState("open", "lipid_nr int, bind_i int, bind_f int")
        self.wait = handle.getValueState("wait", "frames array<int>, labels array<int>, times array<bigint>")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples():
            self.ring.update(([int(x) for x in row.ring], int(row.next)))
            if not pd.isna(row.lipid_nr):
                self.open.update((int(row.lipid_nr), int(row.bind_i), int(row.bind_f)))

    def _waiting(self) -> dict[int, tuple[int, int]]:
        if not self.wait.exists():
            return {}
        frames, labels, times = self.wait.get()
        return {f: (label, ms) for f, label, ms in zip(frames, labels, times)}

    def _keep(self, waiting: dict[int, tuple[int, int]]) -> None:
        if not waiting:
            self.wait.clear()
            return
        self.wait.update((list(waiting), [x for x, _ in waiting.values()], [ms for _, ms in waiting.values()]))
        self.handle.registerTimer(min(ms for _, ms in waiting.values()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, waiting, late = timerValues.getCurrentWatermarkInMs(), self._waiting(), 0
        first = min((ms for _, ms in waiting.values()), default=None)
        for pdf in rows:
            for frame, label, ms in zip(pdf["frame"].tolist(), pdf["lipid_nr"].tolist(), pdf["ms"].tolist()):
                if mark > 0 and ms <= mark:
                    late += 1
                else:
                    waiting[frame] = (label, ms)
        if waiting and min(ms for _, ms in waiting.values()) != first and first is not None:
            self.handle.deleteTimer(first)
        self._keep(waiting)
        yield pd.DataFrame({"cell": [key[0]] * bool(late), "late": [late] * bool(late)}).reindex(columns=CHANGED).astype(TYPES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, waiting, out = timerValues.getCurrentWatermarkInMs(), self._waiting(), []
        ring, after = self.ring.get() if self.ring.exists() else ([], None)
        ring, held = list(ring), list(self.open.get()) if self.open.exists() else None
        for frame in sorted(f for f, (_, ms) in waiting.items() if ms <= mark):
            label, _ = waiting.pop(frame)
            if after is not None and frame < after:
                continue  # a frame that the handed-over state has already
            # frames that the cell lacks are empty; beyond a ring of them nothing changes
            gap = range(after, min(frame, after + self.span)) if after is not None else ()
            for at, seen in [*((g, -1) for g in gap), (frame, label)]:
                ring = (ring + [seen])[-self.span :]
                most = Counter(x for x in ring if x >= 0).most_common(1)
                holder = most[0][0] if most and 2 * most[0][1] >= self.span and at >= 2 * self.r else None
                if held and held[0] != holder:
                    out.append((key[0], *held, held[2] - held[1] + 1, 0))
                    held = None
                if holder is not None:
                    held = [holder, held[1] if held else at, at]
            after = frame + 1
        self.ring.update((ring, after))
        if held:
            self.open.update(tuple(held))
        else:
            self.open.clear()
        self._keep(waiting)
        yield pd.DataFrame(out, columns=CHANGED).astype(TYPES)

    def close(self) -> None:
        pass


CHANGED = ["cell", "lipid_nr", "bind_i", "bind_f", "dwell", "late"]
TYPES = dict.fromkeys(CHANGED[:-1], "Int32") | {"late": "Int64"}


def majority_changes_stream(frames: DataFrame, r: int, delay: str = "0 seconds", held: DataFrame | None = None) -> DataFrame:
    """The batch operator majority_events as frames arrive: frames(cell, frame, lipid_nr, ts), ts increasing with frame.

    Events go out when they close, with late 0; for each batch with frames that came too late for their cell, a row without an event tells
    how many. held: what a run up to some frame left open, as HELD. Frames that a cell lacks count as empty. State is kept in RocksDB."""
    spark = frames.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # the time goes on as a number, so that Spark moves the watermark by it but leaves late rows to be counted
    rows = frames.withWatermark("ts", delay).select("cell", "frame", "lipid_nr", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("cell").transformWithStateInPandas(MajorityEvents(r), CHANGE, "append", "eventTime", held.groupBy("cell") if held is not None else None)


def majority_events_stream(frames: DataFrame, r: int, delay: str = "0 seconds", held: DataFrame | None = None) -> DataFrame:
    """The closed events of majority_changes_stream."""
    return majority_changes_stream(frames, r, delay, held).filter("late = 0").drop("late")


def held_state(occupancy: DataFrame, r: int) -> DataFrame:
    """What a stream needs to go on after the batch table occupancy(cell, frame, lipid_nr): per cell the labels of its last 2r + 1 frames, and
    the event that is open on its last one."""
    span = 2 * r + 1
    last = occupancy.groupBy("cell").agg(F.max("frame").alias("_last"))
    recent = occupancy.join(last, "cell").filter(F.col("frame") > F.col("_last") - span)
    found = recent.groupBy("cell").agg(F.max("_last").alias("_last"), F.map_from_entries(F.collect_list(F.struct("frame", "lipid_nr"))).alias("_at"))
    back = F.sequence(F.greatest(F.lit(0), F.col("_last") - span + 1), F.col("_last"))
    ring = F.transform(back, lambda f: F.coalesce(F.element_at("_at", f), F.lit(-1)))
    rings = found.select("cell", ring.alias("ring"), (F.col("_last") + 1).cast("int").alias("next"))
    still = majority_events(occupancy, r).join(last, "cell").filter(F.col("bind_f") == F.col("_last")).select("cell", "lipid_nr", "bind_i", "bind_f")
    return rings.join(still, "cell", "left").selectExpr("cell", "ring", "next", "lipid_nr", "bind_i", "bind_f")


def window_report_stream(rows: DataFrame, size: str, delay: str, value: str = "value") -> DataFrame:
    """Mean and standard deviation of each time window, once the watermark has passed it."""
    w = rows.withWatermark("ts", delay).groupBy(F.window("ts", size)).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    return w.select(F.col("window.start").alias("start"), "mean", "sd", "n")


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Runs what is available of a stream into a Parquet table in a shared folder, and reads it."""
    at = f"{folder}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")
