"""Tumbling-window statistics and completeness of tag series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.functions.joins import join_same
from plantpulse.functions.text import sorted_set
from plantpulse.functions.times import with_bucket
from plantpulse.operators.series import mark_busy, nearest_rank

EXPECTED_POINTS = 15


def settled(x: Column, digits: int) -> Column:
    """Round after removing summation noise, so that a tie does not depend on the order of rows."""
    return F.round(F.round(x, digits + 6), digits)


def window_stats(
    readings: DataFrame, width: str = "15 minutes", expected: int = EXPECTED_POINTS, target_rows: int = 100_000
) -> DataFrame:
    """Statistics per tenant, tag and window (19 columns).

    All measures combine map-side.  p95 is the nearest-rank percentile; that of a tag and window of more than
    ``target_rows`` readings is selected by :func:`series.nearest_rank`, so no buffer holds their values.
    """
    keys = ("tenant_id", "tag_id", "window_start")
    for c in ("component_id", "measurement_point_id", "operating_state", "degradation_stage"):
        if c not in readings.columns:
            readings = readings.withColumn(c, F.lit(None).cast("string"))
    row = F.struct(
        "event_time", "event_id", "value", "asset_id", "component_id", "measurement_point_id", "operating_state",
        "degradation_stage",
    )
    rows = with_bucket(readings, "event_time", width, "window_start")
    rows = mark_busy(rows, keys, target_rows)
    g = (
        rows.groupBy(*keys)
        .agg(
            F.min(row).alias("first"),
            F.max("value").alias("max_value"),
            F.min("value").alias("min_value"),
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("sd"),
            F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN _busy IS NULL THEN value END)").alias("p95"),
            F.max_by("value", F.struct("event_time", "event_id")).alias("last_value"),
            F.count("value").alias("n"),
            sorted_set(F.flatten(F.collect_set("quality_flags"))).alias("quality_flags"),
        )
    )
    busy = nearest_rank(rows.filter("_busy"), keys, "value", 95, "_p95", target_rows)
    g = join_same(g, busy, keys, "left").withColumn("p95", F.coalesce("p95", "_p95"))
    n, last = F.col("n"), F.col("last_value")
    flat = F.col("min_value") == F.col("max_value")
    sd = F.when(flat, F.lit(0.0)).otherwise(F.col("sd"))
    return g.select(
        "tenant_id",
        F.coalesce("first.asset_id", F.lit("")).alias("asset_id"),
        F.coalesce("first.component_id", F.lit("")).alias("component_id"),
        F.coalesce("first.measurement_point_id", F.lit("")).alias("measurement_point_id"),
        "tag_id",
        "window_start",
        (F.col("window_start") + F.expr(f"INTERVAL {width}")).alias("window_end"),
        settled(F.col("mean"), 3).alias("avg_value"),
        F.round("min_value", 3).alias("min_value"),
        F.round("max_value", 3).alias("max_value"),
        F.round(sd, 6).alias("stddev_value"),
        F.round("p95", 3).alias("p95_value"),
        settled((last - F.col("first.value")) / F.greatest(n - 1, F.lit(1)), 6).alias("slope"),
        F.when(sd == 0, F.lit(0.0)).otherwise(F.round((last - F.col("mean")) / F.nullif(sd, F.lit(0.0)), 6)).alias("z_score"),
        n.alias("event_count"),
        F.lit(expected).alias("expected_count"),
        "quality_flags",
        F.coalesce("first.operating_state", F.lit("unknown")).alias("operating_state"),
        F.coalesce("first.degradation_stage", F.lit("none")).alias("degradation_stage"),
    )


def completeness(readings: DataFrame, width: str = "15 minutes", expected: int = EXPECTED_POINTS) -> DataFrame:
    """Received against expected readings per tenant, tag and window."""
    return (
        with_bucket(readings, "event_time", width, "window_start")
        .groupBy("tenant_id", "tag_id", "window_start")
        .agg(F.count("value").alias("event_count"))
        .select(
            "*",
            F.lit(expected).alias("expected_count"),
            (F.col("event_count") / F.lit(float(expected))).alias("completeness_ratio"),
            (F.col("event_count") < expected).alias("is_incomplete"),
        )
    )
