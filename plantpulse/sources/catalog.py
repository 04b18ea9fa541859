"""Reference dimensions derived from configuration: tag catalogue, measurement points, first-wins dims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.functions.ids import key_text, sha1_id
from plantpulse.functions.joins import spread
from plantpulse.operators.latest import first_n


def measurement_point_ids(points: DataFrame) -> DataFrame:
    """Points with ``mp_<asset type>_<hash>`` ids."""
    digest = F.substring(F.sha1(key_text("asset_type", "component_type", "measurement_point")), 1, 10)
    return points.withColumn("measurement_point_id", F.concat(F.lit("mp_"), F.col("asset_type"), F.lit("_"), digest))


def plant_slug(plant: Column) -> Column:
    return F.regexp_replace(plant, "^plant_", "")


def tag_catalog(plants: DataFrame, points: DataFrame) -> DataFrame:
    """One row per asset and measurement point that its plant expects.

    ``plants``: tenant_id, plant_id, asset_types, expected_metrics, units (arrays), assets
    (count), threshold_profile_id.  Assets take the plant's asset types in turn.
    ``points``: asset_type, component_type, measurement_point, metric_name, tag_suffix, unit.
    Every asset becomes some hundred rows, so the assets are dealt over all tasks before they meet the points.
    Points are broadcast: they describe asset types, whose number does not grow with the assets, and a join
    by asset type would bring all assets of one type to one task.
    """
    types = F.size("asset_types")
    assets = plants.withColumn("asset_index", F.explode(F.sequence(F.lit(1), F.col("assets"))))
    assets = assets.withColumn(
        "asset_type", F.element_at("asset_types", ((F.col("asset_index") - 1) % types + 1).cast("int"))
    )
    assets = spread(assets, "tenant_id", "plant_id", "asset_index")
    number = F.lpad(F.col("asset_index").cast("string"), 4, "0")
    slug = plant_slug(F.col("plant_id"))
    p = measurement_point_ids(points)
    df = assets.join(F.broadcast(p), "asset_type").filter(
        F.array_contains("expected_metrics", F.col("metric_name")) & F.array_contains("units", F.col("unit"))
    )
    df = df.withColumn("asset_id", F.concat_ws("_", F.lit("asset"), slug, number))
    return df.select(
        "tenant_id",
        "plant_id",
        "asset_id",
        F.concat_ws(" ", F.initcap(F.replace(F.col("asset_type"), F.lit("_"), F.lit(" "))), number).alias("asset_name"),
        "asset_type",
        sha1_id("comp_", key_text("tenant_id", "asset_id", "component_type", F.lit("1"))).alias("component_id"),
        "component_type",
        "measurement_point_id",
        "measurement_point",
        F.concat_ws("_", F.lit("tag"), slug, number, "measurement_point_id", "tag_suffix").alias("tag_id"),
        F.concat_ws("_", "asset_type", "measurement_point", "tag_suffix", number).alias("tag_name"),
        "metric_name",
        "unit",
        "threshold_profile_id",
    )


# Types whose assets or components count as critical.
CRITICAL_ASSETS = ("reactor", "compressor")
CRITICAL_COMPONENTS = ("seal", "compressor_stage")


def dims_from_tags(tags: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(assets, components, measurement points)`` of a tag catalogue; the first tag id wins per key."""

    def first(cols: list[str], key: str) -> DataFrame:
        return first_n(tags.select("tag_id", *cols), [key], ["tag_id"], 1).drop("tag_id")

    critical_a = F.when(F.col("asset_type").isin(*CRITICAL_ASSETS), "critical").otherwise("high")
    assets = first(["asset_id", "asset_name", "asset_type", "tenant_id", "plant_id"], "asset_id")
    critical_c = F.when(F.col("component_type").isin(*CRITICAL_COMPONENTS), "critical").otherwise("high")
    components = first(["component_id", "asset_id", "component_type"], "component_id")
    points = first(
        ["measurement_point_id", "component_id", "measurement_point", "metric_name", "unit"], "measurement_point_id"
    )
    return (
        assets.withColumn("criticality", critical_a).withColumn("lifecycle_state", F.lit("operating")),
        components.withColumn("criticality", critical_c),
        points,
    )
