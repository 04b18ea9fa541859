"""Enrichment of readings with tag, asset and component attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands for the missing tenant of a mapping; no reading has it.
NO_TENANT = "\x00"

ENRICHED_COLUMNS = (
    "event_id tenant_id tag_id tag_name asset_id asset_name component_id component_type metric_name "
    "measurement_point expected_unit value unit event_time ingest_time quality_flags asset_type site_id"
).split()


def tag_context(tags: DataFrame, assets: DataFrame, components: DataFrame) -> DataFrame:
    """One wide row per tag.  The three dimensions are joined with each other first, so the
    readings meet them in a single join instead of three."""
    a = assets.select("tenant_id", "asset_id", "asset_name", "asset_type", "site_id")
    c = components.select("tenant_id", "asset_id", "component_id", "component_type")
    m = tags.select(
        "tenant_id", "tag_id", "asset_id", "component_id", "metric_name", "measurement_point", "expected_unit", "unit"
    ).filter(F.col("asset_id").isNotNull())
    return (
        m.withColumnRenamed("unit", "mapped_unit")
        .join(a, ["tenant_id", "asset_id"], "left")
        .join(c, ["tenant_id", "asset_id", "component_id"], "left")
    )


def enrich_readings(readings: DataFrame, tags: DataFrame, assets: DataFrame, components: DataFrame) -> DataFrame:
    """Readings with a mapped tag, carrying the tag's, asset's and component's attributes.

    Readings of unmapped tags are left out.  Dimensions may be batch frames under a
    streaming ``readings``: the join is then stream-static and keeps no state.
    """
    context = tag_context(tags, assets, components)
    r = readings.select(
        "tenant_id", "tag_id", "event_id", "tag_name", "value", "unit", "event_time", "ingest_time", "quality_flags"
    )
    return r.join(context, ["tenant_id", "tag_id"]).select(*ENRICHED_COLUMNS)


def check_mapping(readings: DataFrame, tags: DataFrame) -> DataFrame:
    """Readings with ``error_code`` / ``field_path`` / ``message`` set where the mapping does not fit.

    The mapping is looked up by tag id; a tag known only under other tenants, or in
    another unit, is an error.  One join: tenants that share a tag id sit in a small map.
    Of several mappings of one tag and tenant the newest (``updated_at``, where given) counts; one without
    a tenant makes its tag known, but to no tenant.
    """
    newest = F.struct(*[c for c in ("updated_at",) if c in tags.columns], "unit")
    single = tags.groupBy("tag_id", "tenant_id").agg(F.max(newest)["unit"].alias("unit"))
    per_tag = single.groupBy("tag_id").agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.coalesce("tenant_id", F.lit(NO_TENANT)).alias("tenant_id"), F.col("unit").alias("mapped_unit")))
        ).alias("_units")
    )
    units = F.col("_units")
    known = F.coalesce(F.map_contains_key(units, F.coalesce(F.col("tenant_id"), F.lit(""))), F.lit(False))
    unit_fits = F.try_element_at(units, F.col("tenant_id")) == F.col("unit")
    joined = readings.join(per_tag, "tag_id", "left")
    code = (
        F.when(units.isNull(), F.lit("missing_tag_metadata"))
        .when(~known, F.lit("invalid_asset_tag_mapping"))
        .when(~F.coalesce(unit_fits, F.lit(False)), F.lit("invalid_tag_mapping"))
    )
    out = joined.withColumn("error_code", code)
    path = (
        F.when(F.col("error_code") == "missing_tag_metadata", F.lit("/tag_id"))
        .when(F.col("error_code") == "invalid_asset_tag_mapping", F.lit("/tenant_id"))
        .when(F.col("error_code") == "invalid_tag_mapping", F.lit("/unit"))
    )
    message = (
        F.when(F.col("error_code") == "missing_tag_metadata", F.lit("No valid tag metadata mapping"))
        .when(F.col("error_code") == "invalid_asset_tag_mapping", F.lit("Tag metadata tenant mismatch"))
        .when(F.col("error_code") == "invalid_tag_mapping", F.lit("Tag metadata unit mismatch"))
    )
    return out.withColumns({"field_path": path, "message": message}).drop("_units")


def enrich_checked(
    readings: DataFrame, tags: DataFrame, assets: DataFrame, components: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``: enriched readings, and dead letters for bad mappings."""
    checked = check_mapping(readings, tags)
    fine = checked.filter(F.col("error_code").isNull()).drop("error_code", "field_path", "message")
    bad = checked.filter(F.col("error_code").isNotNull()).select(
        F.to_json(F.struct(*[F.col(c) for c in sorted(readings.columns)]), {"ignoreNullFields": "false"}).alias(
            "original_record"
        ),
        "event_id",
        "tenant_id",
        "error_code",
        "field_path",
        "message",
        F.lit("enriched_telemetry").alias("schema_name"),
        F.lit("enriched_telemetry.v1").alias("schema_version"),
    )
    return enrich_readings(fine, tags, assets, components), bad
