"""Rolling detector features from keyed state: no history is read.

A series' state is the last ``baseline_points`` readings judged and those that still wait for the
watermark. Readings are judged in (event_time, event_id) order when the watermark has passed them, so a
reading that arrives out of order, but before the watermark, takes its place. An event-time timer
watches for the next reading: a series that falls silent is told when the timer fires, not when it comes back.

Needs the RocksDB state store (see ``session.SETTINGS``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from plantpulse.operators import detectors
from plantpulse.operators.series import SERIES

_TEXT = {name: T.StringType() for name in detectors._PASSENGERS}
_HELD = {"at": T.LongType(), "event_id": T.StringType(), "value": T.DoubleType(), "quality_flags": T.ArrayType(T.StringType()), **_TEXT,
         "judged": T.BooleanType(), "told": T.BooleanType()}
_OUT = {
    **{name: T.StringType() for name in SERIES},
    **_TEXT,
    "event_id": T.StringType(),
    "event_time": T.LongType(),
    "observed_value": T.DoubleType(),
    "rolling_baseline_mean": T.DoubleType(),
    "rolling_baseline_stddev": T.DoubleType(),
    "prev_window_value": T.DoubleType(),
    "gap_minutes": T.DoubleType(),
    "window_stddev": T.DoubleType(),
    "event_count": T.LongType(),
    "window_start": T.LongType(),
    "window_end": T.LongType(),
    "quality_flags": T.ArrayType(T.StringType()),
    "source_event_ids": T.ArrayType(T.StringType()),
    "silent": T.BooleanType(),
}
_TIMES = ("event_time", "window_start", "window_end")


def _struct(fields: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def _moments(values: list[float]) -> tuple[float | None, float | None]:
    """Mean and population deviation; equal values deviate by exactly 0."""
    if not values:
        return None, None
    mean = math.fsum(values) / len(values)
    if min(values) == max(values):
        return mean, 0.0
    return mean, math.sqrt(math.fsum((v - mean) ** 2 for v in values) / len(values))


class SeriesFeatures(StatefulProcessor):
    """State of one series. ``told``: the pause behind this reading has been told."""

    def __init__(self, baseline_points: int, recent_points: int, gap_minutes: float) -> None:
        self.baseline, self.recent = baseline_points, recent_points
        self.kept = max(baseline_points, recent_points - 1, 1)
        self.gap = int(gap_minutes * 60_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _struct(_HELD))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        new = [{c: row[c] for c in _HELD if c not in ("judged", "told")} | {"judged": False, "told": False} for row in rows]
        yield from self._advance(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def _advance(self, key: tuple, new: list[dict], watermark_ms: int) -> Iterator[Row]:
        held = [dict(zip(_HELD, row, strict=True)) for row in self.held.get()] + new
        past = [r for r in held if r["judged"]]
        waiting = sorted((r for r in held if not r["judged"]), key=lambda r: (r["at"], r["event_id"] or ""))
        passed = watermark_ms * 1000
        while waiting and waiting[0]["at"] <= passed:  # later rows up to here are dropped as late before they reach this
            row = waiting.pop(0)
            if past and not past[-1]["told"] and row["at"] - past[-1]["at"] >= self.gap:
                yield self._silence(key, past[-1])
            yield self._features(key, past, row)
            past = [*past, row | {"judged": True}][-self.kept :]
        if past and not past[-1]["told"] and past[-1]["at"] + self.gap <= passed:
            past[-1]["told"] = True
            yield self._silence(key, past[-1])
        self.held.put([tuple(r[c] for c in _HELD) for r in past + waiting])
        self._wake(past, waiting)

    def _wake(self, past: list[dict], waiting: list[dict]) -> None:
        """One timer: the first waiting reading or the end of the allowed pause, whichever comes first."""
        times = [waiting[0]["at"]] if waiting else []
        if past and not past[-1]["told"]:
            times.append(past[-1]["at"] + self.gap)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if times:
            self.handle.registerTimer(-(-min(times) // 1000))

    def _features(self, key: tuple, past: list[dict], row: dict) -> Row:
        known = [r["value"] for r in past[-self.baseline :] if r["value"] is not None] if self.baseline else []
        recent = [*past[len(past) - self.recent + 1 if len(past) >= self.recent else 0 :], row]
        values = [r["value"] for r in recent if r["value"] is not None]
        mean, deviation = _moments(known)
        gap = (row["at"] - past[-1]["at"]) / 1_000_000 / 60 if past else None
        return self._row(
            key, row, rolling_baseline_mean=mean, rolling_baseline_stddev=deviation, prev_window_value=past[-1]["value"] if past else None,
            gap_minutes=gap, window_stddev=_moments(values)[1], event_count=len(values), window_start=min(r["at"] for r in recent),
            window_end=row["at"], source_event_ids=[r["event_id"] for r in recent if r["event_id"] is not None], silent=False,
        )

    def _silence(self, key: tuple, last: dict) -> Row:
        return self._row(
            key, last, gap_minutes=self.gap / 60_000_000, event_count=1, window_start=last["at"], window_end=last["at"] + self.gap,
            source_event_ids=[last["event_id"]], silent=True,
        )

    def _row(self, key: tuple, row: dict, **given: object) -> Row:
        values = dict(zip(SERIES, key, strict=True)) | {c: row[c] for c in ("event_id", "quality_flags", *_TEXT)}
        values |= {"event_time": row["at"], "observed_value": row["value"]} | given
        return Row(*_OUT)(*[values.get(c) for c in _OUT])


def feature_stream(
    readings: DataFrame,
    baseline_points: int = detectors.BASELINE_POINTS,
    recent_points: int = detectors.FLATLINE_POINTS,
    max_gap_minutes: float = detectors.MAX_GAP_MINUTES,
    delay: str = "5 minutes",
) -> DataFrame:
    """Features of every reading of a stream, as :func:`detectors.detector_features` gives them, and its silences.

    A row with ``silent`` tells that no reading followed ``event_id`` for ``max_gap_minutes``; each pause of
    that length is told once, whether or not a reading ends it. Readings behind the watermark are dropped
    by Spark; :func:`jobs.late_batches` keeps them. State per series: the last readings judged and
    those within ``delay`` of the newest one.
    """
    kind = readings.schema["event_time"].dataType
    rows = readings.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", delay)
    rows = rows.select(*SERIES, "event_time", F.unix_micros("event_time").alias("at"), "event_id", "value", "quality_flags", *_TEXT)
    out = rows.groupBy(*SERIES).transformWithState(
        SeriesFeatures(baseline_points, recent_points, max_gap_minutes), _struct(_OUT), "Append", "EventTime"
    )
    return out.withColumns({c: F.timestamp_micros(c).cast(kind) for c in _TIMES})


def anomaly_stream(features: DataFrame, verdict: detectors.Verdict) -> DataFrame:
    """Anomalies of one window detector over :func:`feature_stream`; narrow."""
    return detectors.window_anomalies(features.filter(~F.col("silent")), verdict)


def silence_stream(features: DataFrame, max_gap_minutes: float = detectors.MAX_GAP_MINUTES) -> DataFrame:
    """Missing-heartbeat anomalies of :func:`feature_stream` raised by the timer: from the last reading to the end of the allowed pause."""
    return detectors.window_anomalies(features.filter("silent"), detectors.heartbeat_verdict(max_gap_minutes))
