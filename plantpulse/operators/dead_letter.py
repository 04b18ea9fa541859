"""Dead letters for readings that lack a required field."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED = ("event_id", "tenant_id", "tag_id", "event_time", "ingest_time", "value", "unit", "source_system")
PAYLOAD = (
    "event_id schema_version tenant_id tag_id tag_name event_time ingest_time value unit source_system "
    "quality_flags scenario"
).split()


def complete() -> Column:
    """No required field is null."""
    return reduce(and_, [F.col(c).isNotNull() for c in REQUIRED])


def missing_required(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One record per reading with a null required field; the first null field names the path.

    Works for every tenant at once, so readings without a tenant are caught as well.  Columns ``keep`` go along.
    """
    path = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"$.{c}")) for c in REQUIRED])
    payload = [F.col(c).cast("string").alias(c) if c == "quality_flags" else F.col(c) for c in PAYLOAD]
    return (
        raw.withColumn("field_path", path)
        .filter(F.col("field_path").isNotNull())
        .select(
            F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}).alias("original_record"),
            F.lit("MISSING_REQUIRED_FIELD").alias("error_code"),
            "field_path",
            F.lit("Required raw sensor event field is missing or null").alias("message"),
            F.lit("raw_sensor_event.v1").alias("schema_name"),
            F.lit("raw_sensor_event.v1").alias("schema_version"),
            F.current_timestamp().alias("validation_time"),
            *keep,
        )
    )
