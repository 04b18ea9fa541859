"""Validity and scope of governed rows (rules, threshold profiles)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_force(rows: DataFrame, as_of: Column) -> DataFrame:
    """Approved (where that column exists) and active rows whose validity interval holds ``as_of``."""
    kept = rows.filter(
        (F.col("status") == "active")
        & (F.col("effective_from") <= as_of)
        & (F.col("effective_to").isNull() | (F.col("effective_to") > as_of))
    )
    return kept.filter(F.col("approval_status") == "approved") if "approval_status" in rows.columns else kept


def match_profiles(
    tags: DataFrame, profiles: DataFrame, scope: tuple[str, ...] = ("asset_type", "component_type", "unit")
) -> DataFrame:
    """Best threshold profile per tag: equal metric, tenant equal or ``*``, and each scope column
    equal, ``*`` or NULL.  The profile with most scope columns named wins, then the smallest id.

    Each tag asks for every combination of "own value" and ``*`` (16 keys for four
    columns), so profiles are found by equality: no tag is paired with profiles that do
    not fit.  Both sides are dimensions; readings meet the result by (tenant, tag).
    """
    names = ("tenant_id", *scope)
    keys = [f"_{c}" for c in names]
    p = profiles.select(
        "profile_id", "metric_name", "critical_min", "critical_max",
        *[F.coalesce(c, F.lit("*")).alias(k) for c, k in zip(names, keys, strict=True)],
    )
    asked = tags.withColumn("named_scopes", F.lit(0))
    for c, k in zip(names, keys, strict=True):
        choices = F.array(F.struct(F.lit("*").alias("v"), F.lit(0).alias("n")), F.struct(F.col(c).alias("v"), F.lit(1).alias("n")))
        asked = asked.select("*", F.explode(choices).alias("_choice"))
        asked = asked.withColumn(k, F.col("_choice.v")).withColumn("named_scopes", F.col("named_scopes") + F.col("_choice.n"))
        asked = asked.drop("_choice")
    found = asked.join(p, ["metric_name", *keys])
    w = Window.partitionBy("tenant_id", "tag_id").orderBy(F.col("named_scopes").desc(), "profile_id")
    best = found.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") == 1)
    return best.drop("_rank", *keys)
