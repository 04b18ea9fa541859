"""Anomaly detectors over series of enriched readings.

Two families share the 25-column anomaly row.  *Group* detectors give one verdict per
series from partial aggregates only (no ordered frame over a series).  *Window*
detectors judge every reading against rolling features (:func:`detector_features`).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.functions.ids import anomaly_id
from plantpulse.functions.text import sorted_set
from plantpulse.functions.times import iso_z, seconds, with_bucket
from plantpulse.operators.latest import first_n, latest_n
from plantpulse.operators.series import ORDER, SERIES, with_halo

# Quality flags that point at the sensor, and detector defaults.
SENSOR_FLAGS = ("calibration_drift", "sensor_stuck", "dead_sensor", "noise_spike", "communication_loss")
SPIKE_MULTIPLIER = 2.5
ZSCORE_LIMIT = 3.0
MAX_SLOPE = 0.8
MAX_GAP_MINUTES = 10
FLATLINE_POINTS = 6
FLATLINE_WINDOW_POINTS = 3
BASELINE_POINTS = 24
STEP_MINUTES = 5.0
MAX_SOURCE_IDS = 10

ANOMALY_COLUMNS = (
    "anomaly_id schema_version rule_id tenant_id plant_id asset_id asset_name component_id tag_id tag_name "
    "metric_name observed_value baseline_value expected_value event_count breach_count window_start window_end "
    "severity quality_flags quality_event_ids fault_type failure_mode_id detection_confidence source_event_ids"
).split()
_PASSENGERS = ("plant_id", "asset_name", "component_id", "tag_name")


# --- severity and fault type -------------------------------------------------------------


def resolve_severity(
    profile: Column, rule: Column, params: Column | None = None, default: str = "warning"
) -> Column:
    """Profile severity, else rule severity (empty and ``*`` do not count), else the parameter, else default."""

    def given(c: Column) -> Column:
        return F.when((c != "") & (c != "*"), c)

    fallback = F.lit(default) if params is None else F.coalesce(F.try_element_at(params, F.lit("severity")), F.lit(default))
    return F.coalesce(given(profile), given(rule), fallback)


def resolve_fault_type(flags: Column, param_fault: Column | None = None) -> Column:
    """``sensor_fault`` for sensor flags (any case), else what the rule parameter allows, else ``asset_fault``."""
    lowered = F.transform(F.coalesce(flags, F.array().cast("array<string>")), F.lower)
    sensor = F.arrays_overlap(lowered, F.array(*[F.lit(f) for f in SENSOR_FLAGS]))
    out = F.when(sensor, F.lit("sensor_fault"))
    if param_fault is not None:
        out = out.when(param_fault.isin("sensor_fault", "operating_context_change"), param_fault)
    return out.otherwise(F.lit("asset_fault"))


# --- group detectors ----------------------------------------------------------------------


def series_summary(readings: DataFrame, cell: str = "1 hour") -> DataFrame:
    """One row per series: count, first and last reading, moments without the last reading, flags, first ten ids.

    One scan.  Rows meet by series and time ``cell``, so no series comes to one task.  A cell keeps the mean and
    the squared deviations of all its readings but the last one, and that one apart; the cells of a series are then
    merged in time order, the last one without its last reading.  Nothing is ever subtracted from a sum, so an
    extreme last value takes no digits from the baseline.  Key columns may be NULL.
    """
    row = F.struct(*ORDER, "value", *_PASSENGERS)
    rows = with_bucket(readings, "event_time", cell, "_cell").withColumn("_row", row)
    inside = Window.partitionBy(*SERIES, "_cell").orderBy("_row")
    rows = rows.withColumns({"_front": F.row_number().over(inside), "_end": F.lead(F.lit(True)).over(inside).isNull()})
    rest = F.when(~F.col("_end"), F.col("value"))
    cells = rows.groupBy(*SERIES, "_cell").agg(
        F.count("value").alias("_n"),
        F.min("_row").alias("_first"),
        F.max("_row").alias("_last"),
        F.struct(
            F.count(rest).alias("n"),
            F.coalesce(F.avg(rest), F.lit(0.0)).alias("mean"),
            F.coalesce(F.var_pop(rest) * F.count(rest), F.lit(0.0)).alias("m2"),
            F.min(rest).alias("lo"),
            F.max(rest).alias("hi"),
        ).alias("_rest"),
        F.flatten(F.collect_set("quality_flags")).alias("_flags"),
        F.array_sort(F.collect_list(F.when(F.col("_front") <= MAX_SOURCE_IDS, F.struct(*ORDER)))).alias("_ids"),
    )
    # a cell has at least one reading, so the first ten ids lie in the first ten cells
    early = F.row_number().over(Window.partitionBy(*SERIES).orderBy("_cell")) <= MAX_SOURCE_IDS
    s = (
        cells.withColumn("_ids", F.when(early, F.col("_ids")))
        .groupBy(*SERIES)
        .agg(
            F.sum("_n").alias("event_count"),
            F.min("_first").alias("first"),
            F.max("_last").alias("last"),
            F.array_sort(F.collect_list(F.struct("_cell", "_rest", F.col("_last.value").alias("end")))).alias("_cells"),
            F.flatten(F.collect_set("_flags")).alias("flags"),
            F.array_sort(F.flatten(F.collect_list("_ids"))).alias("_ids"),
        )
    )
    before = F.transform(F.slice("_cells", 1, F.size("_cells") - 1), lambda c: _merged(c["_rest"], _one(c["end"])))
    base = F.aggregate(before, F.element_at("_cells", -1)["_rest"], _merged)
    mean = F.when(base["n"] > 0, base["mean"])
    deviation = F.when(base["lo"] == base["hi"], F.lit(0.0)).when(base["n"] > 0, F.sqrt(base["m2"] / base["n"]))
    return s.select(
        *SERIES,
        "event_count",
        F.col("first.event_time").alias("window_start"),
        F.col("last.event_time").alias("window_end"),
        F.col("first.value").alias("first_value"),
        F.col("last.value").alias("last_value"),
        *[F.col(f"first.{c}").alias(c) for c in _PASSENGERS],
        mean.alias("base_mean"),
        deviation.alias("base_stddev"),
        sorted_set(F.col("flags")).alias("quality_flags"),
        F.transform(F.slice("_ids", 1, MAX_SOURCE_IDS), lambda r: r["event_id"]).alias("source_event_ids"),
    )


def _one(value: Column) -> Column:
    """Moments of a single value; of none where it is NULL."""
    zero = F.lit(0.0)
    n = F.when(value.isNull(), F.lit(0)).otherwise(F.lit(1)).cast("bigint")
    return F.struct(n.alias("n"), F.coalesce(value, zero).alias("mean"), zero.alias("m2"), value.alias("lo"), value.alias("hi"))


def _merged(a: Column, b: Column) -> Column:
    """Moments of two groups of values together: counts, mean, sum of squared deviations from it, extremes."""
    n = a["n"] + b["n"]
    share = F.when(n > 0, b["n"] / n).otherwise(F.lit(0.0))
    step = b["mean"] - a["mean"]
    return F.struct(
        n.alias("n"),
        (a["mean"] + step * share).alias("mean"),
        (a["m2"] + b["m2"] + step * step * a["n"] * share).alias("m2"),
        F.least(a["lo"], b["lo"]).alias("lo"),
        F.greatest(a["hi"], b["hi"]).alias("hi"),
    )


def anomaly_rows(
    df: DataFrame,
    rule: str | Column,
    *,
    severity: str | Column,
    observed: Column,
    baseline: Column,
    expected: Column,
    breach_count: Column,
    confidence: Column | float = 0.9,
    fault_type: Column | None = None,
    failure_mode: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Shape rows that carry series, window and source columns into anomaly rows, with the columns ``keep`` behind."""

    def col(c: Column | str | float) -> Column:
        return c if isinstance(c, Column) else F.lit(c)

    start, end = iso_z("window_start"), iso_z("window_end")
    return df.select(
        anomaly_id(col(rule), start, end).alias("anomaly_id"),
        F.lit("anomaly_event.v1").alias("schema_version"),
        col(rule).alias("rule_id"),
        "tenant_id",
        "plant_id",
        "asset_id",
        "asset_name",
        "component_id",
        "tag_id",
        "tag_name",
        "metric_name",
        observed.alias("observed_value"),
        baseline.cast("double").alias("baseline_value"),
        expected.cast("double").alias("expected_value"),
        "event_count",
        breach_count.cast("long").alias("breach_count"),
        "window_start",
        "window_end",
        col(severity).alias("severity"),
        "quality_flags",
        F.lit(None).cast("array<string>").alias("quality_event_ids"),
        (fault_type if fault_type is not None else resolve_fault_type(F.col("quality_flags"))).alias("fault_type"),
        (F.lit(None) if failure_mode is None else failure_mode).cast("string").alias("failure_mode_id"),
        col(confidence).cast("double").alias("detection_confidence"),
        "source_event_ids",
        *keep,
    )


@dataclass
class Verdict:
    """Column expressions of one detector."""

    rule_id: str
    severity: str
    hit: Column
    observed: Column
    baseline: Column
    expected: Column
    confidence: Column = field(default_factory=lambda: F.lit(0.9))
    fault_type: Column | None = None
    breach_count: Column | None = None


def group_anomalies(summaries: DataFrame, *verdicts: Verdict) -> DataFrame:
    """Anomaly rows of several detectors over one :func:`series_summary`: the summary is computed once."""
    found = [
        F.when(
            v.hit,
            F.struct(
                F.lit(v.rule_id).alias("rule_id"),
                F.lit(v.severity).alias("severity"),
                v.observed.cast("double").alias("observed"),
                v.baseline.cast("double").alias("baseline"),
                v.expected.cast("double").alias("expected"),
                v.confidence.cast("double").alias("confidence"),
                v.breach_count.cast("long").alias("breach_count"),
            ),
        )
        for v in verdicts
    ]
    rows = summaries.withColumn("_found", F.explode(F.filter(F.array(*found), lambda v: v.isNotNull())))
    return anomaly_rows(
        rows,
        F.col("_found.rule_id"),
        severity=F.col("_found.severity"),
        observed=F.col("_found.observed"),
        baseline=F.col("_found.baseline"),
        expected=F.col("_found.expected"),
        breach_count=F.col("_found.breach_count"),
        confidence=F.col("_found.confidence"),
    )


def group_spike(multiplier: float = SPIKE_MULTIPLIER, upper: Column | None = None, lower: Column | None = None) -> Verdict:
    """At least two values, the last one at a bound (the lower one wins), else at ``multiplier`` times the mean before it."""
    x, limit = F.col("last_value"), F.col("base_mean") * multiplier
    none = F.lit(None).cast("double")
    upper, lower = none if upper is None else upper, none if lower is None else lower
    expected = F.when(x <= lower, lower).when(x >= upper, upper).when(x >= limit, limit)
    hit = (F.col("event_count") >= 2) & expected.isNotNull()
    return Verdict("threshold_spike", "critical", hit, x, F.round("base_mean", 6), F.round(expected, 6), breach_count=F.lit(1))


def group_zscore(limit: float = ZSCORE_LIMIT) -> Verdict:
    """At least four values, the last one ``limit`` deviations from the mean of those before it."""
    mean, deviation = F.col("base_mean"), F.col("base_stddev")
    z = F.abs((F.col("last_value") - mean) / F.nullif(deviation, F.lit(0.0)))
    return Verdict(
        "rolling_zscore",
        "warning",
        (F.col("event_count") >= 4) & (z >= limit),
        F.col("last_value"),
        F.round(mean, 6),
        F.round(mean + limit * deviation, 6),
        F.least(F.lit(0.99), F.round(z / (limit * 2), 3)),
        breach_count=F.lit(1),
    )


def group_drift(max_slope: float = MAX_SLOPE) -> Verdict:
    """At least three values whose mean change per point is ``max_slope`` or more in either direction."""
    steps = F.col("event_count") - 1
    slope = (F.col("last_value") - F.col("first_value")) / F.nullif(steps, F.lit(0))
    return Verdict(
        "drift_rate_of_change",
        "warning",
        (F.col("event_count") >= 3) & (F.abs(slope) >= max_slope),
        F.round(slope, 6),
        F.col("first_value"),
        F.lit(max_slope),
        breach_count=steps,
    )


def detect_spike(
    readings: DataFrame,
    multiplier: float = SPIKE_MULTIPLIER,
    bounds: DataFrame | None = None,
    summaries: DataFrame | None = None,
) -> DataFrame:
    """Last value against bounds, else against ``multiplier`` times the mean of the values before it.

    ``bounds`` may give ``upper`` / ``lower`` per tenant and tag; the lower bound wins.
    """
    s = series_summary(readings) if summaries is None else summaries
    if bounds is None:
        return group_anomalies(s, group_spike(multiplier))
    s = s.join(bounds.select("tenant_id", "tag_id", "upper", "lower"), ["tenant_id", "tag_id"], "left")
    return group_anomalies(s, group_spike(multiplier, F.col("upper"), F.col("lower")))


def detect_zscore(readings: DataFrame, limit: float = ZSCORE_LIMIT, summaries: DataFrame | None = None) -> DataFrame:
    """Last value at least ``limit`` standard deviations from the mean of the values before it."""
    return group_anomalies(series_summary(readings) if summaries is None else summaries, group_zscore(limit))


def detect_drift(readings: DataFrame, max_slope: float = MAX_SLOPE, summaries: DataFrame | None = None) -> DataFrame:
    """Mean change per point from the first to the last value, in either direction."""
    return group_anomalies(series_summary(readings) if summaries is None else summaries, group_drift(max_slope))


def detect_heartbeat_gap(
    readings: DataFrame, max_gap_minutes: int = MAX_GAP_MINUTES, all_gaps: bool = False
) -> DataFrame:
    """First pause of at least ``max_gap_minutes`` per series (``all_gaps``: every pause).

    Two readings in one bucket of that width are closer than the gap, so only the first
    and last reading of each bucket matter: the ordered step sees one row per bucket.
    """
    row = F.struct(*ORDER, "value", "quality_flags", *_PASSENGERS)
    cells = (
        with_bucket(readings, "event_time", f"{max_gap_minutes} minutes", "_cell")
        .groupBy(*SERIES, "_cell")
        .agg(F.min(row).alias("current"), F.max(row).alias("_last"))
    )
    series = Window.partitionBy(*SERIES).orderBy("_cell")
    pairs = cells.withColumn("previous", F.lag("_last").over(series)).drop("_last")
    gap = seconds("previous.event_time", "current.event_time") / 60.0
    pairs = pairs.withColumn("_gap", gap).filter(F.col("_gap") >= max_gap_minutes).drop("_cell")
    pairs = pairs.withColumns(
        {"window_start": F.col("previous.event_time"), "window_end": F.col("current.event_time")}
    )
    if not all_gaps:
        pairs = first_n(pairs, SERIES, ["window_start"], 1)
    flags = F.concat(F.coalesce("previous.quality_flags", F.array()), F.coalesce("current.quality_flags", F.array()))
    pairs = pairs.withColumns(
        {
            **{c: F.col(f"previous.{c}") for c in _PASSENGERS},
            "event_count": F.lit(2).cast("long"),
            "quality_flags": sorted_set(flags),
            "source_event_ids": F.array("previous.event_id", "current.event_id"),
        }
    )
    return anomaly_rows(
        pairs,
        "missing_heartbeat",
        severity="critical",
        observed=F.col("_gap"),
        baseline=F.round("previous.value", 6),
        expected=F.lit(float(max_gap_minutes)),
        breach_count=F.lit(1),
        confidence=0.95,
    )


def detect_flatline(readings: DataFrame, points: int = FLATLINE_POINTS) -> DataFrame:
    """Last ``points`` values of a series all equal (at most that many rows per series are shuffled
    per task)."""
    tail = latest_n(readings.select(*SERIES, *ORDER, "value", "quality_flags", *_PASSENGERS), SERIES, ORDER, points)
    rows = F.array_sort(F.collect_list(F.struct(*ORDER, "value", "quality_flags", *_PASSENGERS)))
    s = tail.groupBy(*SERIES).agg(
        rows.alias("rows"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n")
    )
    s = s.filter((F.col("n") == points) & (F.col("lo") == F.col("hi")))
    first = F.col("rows")[0]
    s = s.withColumns(
        {
            **{c: first[c] for c in _PASSENGERS},
            "window_start": first["event_time"],
            "window_end": F.element_at("rows", -1)["event_time"],
            "event_count": F.lit(points).cast("long"),
            "quality_flags": sorted_set(F.flatten(F.transform("rows", lambda r: r["quality_flags"]))),
            "source_event_ids": F.slice(F.transform("rows", lambda r: r["event_id"]), 1, MAX_SOURCE_IDS),
        }
    )
    return anomaly_rows(
        s,
        "flatline",
        severity="warning",
        observed=F.col("hi"),
        baseline=F.col("lo"),
        expected=F.lit(None),
        breach_count=F.lit(points),
        fault_type=F.lit("sensor_fault"),
    )


def detect_all(readings: DataFrame) -> DataFrame:
    """Every group detector with its defaults.  Spike, z-score and drift are judged side by side on one summary."""
    return (
        detect_heartbeat_gap(readings)
        .unionByName(detect_flatline(readings))
        .unionByName(group_anomalies(series_summary(readings), group_spike(), group_zscore(), group_drift()))
    )


# --- window detectors ---------------------------------------------------------------------


def detector_features(
    readings: DataFrame,
    baseline_points: int = BASELINE_POINTS,
    recent_points: int = FLATLINE_POINTS,
    target_rows: int = 1_000_000,
) -> DataFrame:
    """Rolling features of every reading from the readings before it in its series.

    One shuffle serves all features: mean and deviation of the ``baseline_points``
    previous values, previous value, gap, and the deviation of the ``recent_points``
    latest values (the reading included).  Long series are split into chunks.
    """
    before = max(baseline_points, recent_points - 1)
    rows = with_halo(
        readings.select(*SERIES, *ORDER, "value", "quality_flags", *_PASSENGERS), before, target_rows=target_rows
    )
    series = Window.partitionBy(*SERIES, "_chunk").orderBy(*ORDER)
    base = series.rowsBetween(-baseline_points, -1)
    recent = series.rowsBetween(-(recent_points - 1), 0)
    return (
        rows.withColumns(
            {
                "rolling_baseline_mean": F.avg("value").over(base),
                "rolling_baseline_stddev": F.stddev_pop("value").over(base),
                "prev_window_value": F.lag("value").over(series),
                "_prev_time": F.lag("event_time").over(series),
                # equal values give exactly 0, whatever the rounding of their mean
                "window_stddev": F.when(
                    F.min("value").over(recent) == F.max("value").over(recent), F.lit(0.0)
                ).otherwise(F.stddev_pop("value").over(recent)),
                "event_count": F.count("value").over(recent),
                "window_start": F.min("event_time").over(recent),
                "source_event_ids": F.collect_list("event_id").over(recent),
            }
        )
        .filter(~F.col("_halo"))
        .select(
            *SERIES,
            *_PASSENGERS,
            "event_id",
            "event_time",
            F.col("value").alias("observed_value"),
            "rolling_baseline_mean",
            "rolling_baseline_stddev",
            "prev_window_value",
            (seconds("_prev_time", "event_time") / 60.0).alias("gap_minutes"),
            "window_stddev",
            "event_count",
            "window_start",
            F.col("event_time").alias("window_end"),
            "quality_flags",
            "source_event_ids",
        )
    )


def spike_verdict(
    multiplier: Column | float = SPIKE_MULTIPLIER,
    upper: Column | None = None,
    lower: Column | None = None,
    given: Column | None = None,
) -> Verdict:
    """Bounds first, then the multiplier test, which is always made and overrides the expectation.
    A rolling mean of exactly 0 counts as missing; then the ``given`` baseline is taken, else 0."""
    x = F.col("observed_value")
    zero = F.lit(0.0)
    given = F.lit(None).cast("double") if given is None else given
    base = F.coalesce(F.nullif(F.col("rolling_baseline_mean"), zero), F.nullif(given, zero), zero)
    upper = F.lit(None).cast("double") if upper is None else upper
    lower = F.lit(None).cast("double") if lower is None else lower
    expected = F.when(x >= base * multiplier, base * multiplier).when(x <= lower, lower).when(x >= upper, upper)
    return Verdict(
        "threshold_spike", "critical", expected.isNotNull(), x, F.round(base, 6), F.round(expected, 6)
    )


def zscore_verdict(limit: Column | float = ZSCORE_LIMIT) -> Verdict:
    mean, sd, x = F.col("rolling_baseline_mean"), F.col("rolling_baseline_stddev"), F.col("observed_value")
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    z = F.abs((x - mean) / F.nullif(sd, F.lit(0.0)))
    return Verdict(
        "rolling_zscore",
        "warning",
        F.coalesce(z >= limit, F.lit(False)),
        x,
        F.round(mean, 6),
        F.round(mean + limit * sd, 6),
        F.least(F.lit(0.99), F.round(z / (limit * 2), 3)),
    )


def drift_verdict(max_slope: Column | float = MAX_SLOPE, step_minutes: float = STEP_MINUTES) -> Verdict:
    max_slope = max_slope if isinstance(max_slope, Column) else F.lit(max_slope)
    previous = F.col("prev_window_value")
    rate = F.abs(F.col("observed_value") - previous) / F.lit(max(step_minutes, 1.0))
    return Verdict(
        "drift_rate_of_change",
        "warning",
        F.coalesce(rate >= max_slope, F.lit(False)),
        F.round(rate, 6),
        previous,
        max_slope.cast("double"),
    )


def heartbeat_verdict(max_gap_minutes: Column | int = MAX_GAP_MINUTES) -> Verdict:
    limit = max_gap_minutes if isinstance(max_gap_minutes, Column) else F.lit(max_gap_minutes)
    gap = F.col("gap_minutes")
    return Verdict(
        "missing_heartbeat",
        "critical",
        F.coalesce(gap >= limit, F.lit(False)),
        gap,
        F.lit(None).cast("double"),
        limit.cast("double"),
        F.lit(0.95),
    )


def flatline_verdict(points: Column | int = FLATLINE_WINDOW_POINTS) -> Verdict:
    points = points if isinstance(points, Column) else F.lit(points)
    still = (F.coalesce(F.col("window_stddev"), F.lit(1.0)) == 0) & (F.coalesce("event_count", F.lit(0)) >= points)
    x = F.col("observed_value")
    return Verdict(
        "flatline", "warning", still, x, x, F.lit(None).cast("double"), fault_type=F.lit("sensor_fault")
    )


def window_anomalies(features: DataFrame, verdict: Verdict, with_cleared: bool = False) -> DataFrame:
    """Anomaly rows for the feature rows a verdict hits.  Narrow: no shuffle.

    A window's own ``breach_count`` and ``failure_mode_id`` are kept where it has them.
    ``with_cleared`` keeps the rows not hit as well and tells them by the column ``cleared``.
    """
    given = {c: F.col(c) if c in features.columns else F.lit(None) for c in ("breach_count", "failure_mode_id")}
    hit = F.coalesce(verdict.hit, F.lit(False))
    rows = features.withColumn("cleared", ~hit) if with_cleared else features.filter(hit)
    return anomaly_rows(
        rows,
        verdict.rule_id,
        severity=verdict.severity,
        observed=verdict.observed,
        baseline=verdict.baseline,
        expected=verdict.expected,
        breach_count=given["breach_count"],
        confidence=verdict.confidence,
        fault_type=verdict.fault_type,
        failure_mode=given["failure_mode_id"],
        keep=("cleared",) if with_cleared else (),
    )
