"""Streams put in order behind the watermark: last known flight state, and frames that wait for the telemetry sample after them.

Both are extensions: they keep, message by message and for unbounded streams, what ``state_rows`` and ``interpolating_join`` make of whole tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.timejoin import LINEAR
from ..schemas import DECLINATION_DEG


class InOrder(StatefulProcessor):
    """Holds the rows of a key until the watermark has passed them, then hands them to :meth:`step` by time and ``order``.

    Rows are dropped by Spark only if they come after the watermark has passed their time; the progress counts them. State is what arrived
    within the watermark's delay, and ``carry``, one row that a step leaves to the next. A timer wakes a key for its earliest waiting row.
    """

    #: Columns of ``carry`` as DDL.
    carry_schema = ""

    def __init__(self, by: str, columns: list[str], row_schema: str, order: tuple[str, ...], out: list[str]) -> None:
        self.by, self.columns, self.row_schema, self.order, self.out = by, columns, row_schema, order, out
        self.longs = [c for c in columns if f"{c} long" in row_schema.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row_schema)
        self.carried = handle.getValueState("carried", self.carry_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            if part.empty:
                continue
            clean = part[self.columns].astype(object)
            clean = clean.where(clean.notna(), None)
            for c in self.longs:  # which pandas makes floats where some are null
                clean[c] = [None if v is None else int(v) for v in clean[c]]
            self.waiting.appendList(list(clean.astype(object).where(clean.notna(), None).itertuples(index=False, name=None)))
        yield from self._release(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, timerValues)

    def close(self) -> None:
        pass

    def _release(self, key, timer_values) -> Iterator[pd.DataFrame]:
        mark = timer_values.getCurrentWatermarkInMs()
        rows = [dict(zip(self.columns, r)) for r in self.waiting.get()]
        ready = sorted((r for r in rows if r["event_ms"] <= mark), key=self.rank)
        left = [r for r in rows if r["event_ms"] > mark]
        carry = dict(zip(self.names(), self.carried.get())) if self.carried.exists() else {}
        found, wake = self.step(ready, carry, mark)
        if ready:
            self.waiting.clear()
            if left:
                self.waiting.put([tuple(r[c] for c in self.columns) for r in left])
        if carry:
            self.carried.update(tuple(carry.get(n) for n in self.names()))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        times = [r["event_ms"] for r in left] + ([wake] if wake is not None else [])
        if times:
            self.handle.registerTimer(max(min(times), mark + 1))
        if found:
            yield pd.DataFrame(found, columns=self.out[1:]).assign(**{self.by: key[0]})[self.out]

    def rank(self, row: dict) -> tuple:
        return tuple(row[c] for c in self.order)

    def names(self) -> list[str]:
        return [f.strip().split(" ")[0] for f in self.carry_schema.split(",")]

    def step(self, ready: list[dict], carry: dict, mark: int) -> tuple[list[tuple], int | None]:
        """Output rows (without the key) of rows in order, and when to wake up at the latest; changes ``carry`` in place."""
        raise NotImplementedError


_STATE = ("lat", "lon", "alt_m", "roll_deg", "pitch_deg", "yaw_deg")


class LastKnown(InOrder):
    carry_schema = ", ".join(f"{c} double" for c in _STATE)

    def __init__(self, declination_deg: float, **more) -> None:
        super().__init__(**more)
        self.declination_deg = declination_deg

    def step(self, ready: list[dict], carry: dict, mark: int) -> tuple[list[tuple], None]:
        out = []
        for r in ready:
            new = {}
            if r["type"] == "GPS":
                new = {"lat": None if r["lat_e7"] is None else r["lat_e7"] / 1e7, "lon": None if r["lon_e7"] is None else r["lon_e7"] / 1e7}
            elif r["type"] == "BARO":
                new = {"alt_m": r["alt"]}
            elif r["type"] == "ATT":
                new = {"roll_deg": r["roll"], "pitch_deg": r["pitch"], "yaw_deg": None if r["yaw"] is None else r["yaw"] + self.declination_deg}
            carry.update({k: v for k, v in new.items() if v is not None})
            if all(carry.get(c) is not None for c in _STATE):
                out.append((r["t"], *(carry[c] for c in _STATE)))
        return out, None


def _timed(df: DataFrame, t_ms: str, delay: str) -> DataFrame:
    ms = F.ceil(F.col(t_ms)).cast("long")
    return df.withColumn("event_ms", ms).withColumn("event_ts", F.timestamp_millis(ms)).withWatermark("event_ts", delay)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def streamed_states(messages: DataFrame, by: str = "flight_id", delay: str = "10 seconds", declination_deg: float = DECLINATION_DEG) -> DataFrame:
    """``state_rows`` of a stream of ``by, t`` (milliseconds)``, seq, type, lat_e7, lon_e7, roll, pitch, yaw, alt``: a row after every message, once all kinds were seen.

    Messages may come in any order within ``delay``; they take effect by time, then ``seq``, when the watermark has passed them. Later ones are dropped.
    """
    columns = ["t", "seq", "type", "lat_e7", "lon_e7", "roll", "pitch", "yaw", "alt", "event_ms"]
    row_schema = "t double, seq long, type string, lat_e7 long, lon_e7 long, roll double, pitch double, yaw double, alt double, event_ms long"
    rows = _timed(messages, "t", delay)
    out = [by, "t", *_STATE]
    work = LastKnown(declination_deg, by=by, columns=columns, row_schema=row_schema, order=("t", "seq"), out=out)
    return rows.groupBy(by).transformWithStateInPandas(
        statefulProcessor=work, outputStructType=f"{by} {_kind(messages, by)}, t double, " + ", ".join(f"{c} double" for c in _STATE), outputMode="Append", timeMode="EventTime")


class Interpolate(InOrder):
    """The last sample is carried; frames after it wait for the next sample, or until the watermark is ``hold_ms`` past them, as then the flight has ended."""

    carry_schema = "frames string, prev string"

    def __init__(self, hold_ms: int, values: tuple[str, ...], frame: list[str], **more) -> None:
        super().__init__(**more)
        self.hold_ms, self.values, self.frame = hold_ms, values, frame

    def rank(self, row: dict) -> tuple:
        """A frame before the samples of its time, which are in order of their values."""
        return row["t_ms"], not row["is_frame"], *((row[c] for c in self.values) if not row["is_frame"] else ())

    def step(self, ready: list[dict], carry: dict, mark: int) -> tuple[list[tuple], int | None]:
        out = []
        frames = json.loads(carry.get("frames") or "[]")
        prev = json.loads(carry["prev"]) if carry.get("prev") else None

        def place(f: list, after: list | None) -> None:
            t = f[0]
            if prev is None and after is None:
                return
            if prev is None or after is None or after[0] == t:
                v = (after or prev)[1:]
            else:
                share = (t - prev[0]) / (after[0] - prev[0]) if after[0] > prev[0] else 0.0
                v = [a + share * (b - a) for a, b in zip(prev[1:], after[1:])]
            out.append((*f[2:], t, *v))

        for r in ready:
            if r["is_frame"]:
                frames.append([r["t_ms"], r["event_ms"], *(r[c] for c in self.frame)])
                continue
            sample = [r["t_ms"], *(r[c] for c in self.values)]
            for f in frames:
                place(f, sample)
            frames, prev = [], sample
        keep = []
        for f in frames:
            if f[1] + self.hold_ms <= mark:
                place(f, None)
            else:
                keep.append(f)
        carry.update(frames=json.dumps(keep), prev=json.dumps(prev) if prev else None)
        return out, min((f[1] + self.hold_ms for f in keep), default=None)


def streamed_interpolation(
    frames: DataFrame, samples: DataFrame, by: str = "flight_id", frame_columns: tuple[str, ...] = ("frame_idx",), values: tuple[str, ...] = LINEAR,
    delay: str = "10 seconds", samples_delay: str | None = None, hold_ms: int = 600_000,
) -> DataFrame:
    """``interpolating_join`` of two streams: ``by``, the frame's columns, ``t_ms`` and ``values`` between the samples around a frame.

    Each stream has a watermark of its own; rows are taken in order when the slower one has passed them. A frame waits in state for the next
    sample; one before a flight's first sample takes that, one for which the watermark is ``hold_ms`` past takes the last, if there is one. Rows that come
    after the watermark are dropped, and counted by the query's progress. Whole-number frame columns only.
    """
    null = lambda cols: [F.lit(None).cast(k).alias(c) for c, k in cols]
    numbers = [(c, "double") for c in values]
    longs = [(c, "long") for c in frame_columns]
    f = _timed(frames, "t_ms", delay).select(by, F.col("t_ms").cast("double").alias("t_ms"), F.lit(True).alias("is_frame"), *[F.col(c).cast("long").alias(c) for c in frame_columns], *null(numbers), "event_ms", "event_ts")
    s = _timed(samples.dropna(subset=list(values)), "t_ms", samples_delay or delay).select(
        by, F.col("t_ms").cast("double").alias("t_ms"), F.lit(False).alias("is_frame"), *[F.lit(0).cast("long").alias(c) for c in frame_columns], *[F.col(c).cast("double").alias(c) for c in values], "event_ms", "event_ts")
    columns = ["t_ms", "is_frame", *frame_columns, *values, "event_ms"]
    row_schema = "t_ms double, is_frame boolean, " + ", ".join(f"{c} {k}" for c, k in longs + numbers) + ", event_ms long"
    out = [by, *frame_columns, "t_ms", *values]
    work = Interpolate(hold_ms, values, list(frame_columns), by=by, columns=columns, row_schema=row_schema, order=("t_ms",), out=out)
    schema = f"{by} {_kind(frames, by)}, " + ", ".join(f"{c} long" for c in frame_columns) + ", t_ms double, " + ", ".join(f"{c} double" for c in values)
    return f.unionByName(s).groupBy(by).transformWithStateInPandas(statefulProcessor=work, outputStructType=schema, outputMode="Append", timeMode="EventTime")
