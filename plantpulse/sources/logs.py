"""Log and file sources, topic routing, typed landing and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantpulse.functions.text import text_bool
from plantpulse.functions.times import iso_z, parse_iso

# Topic names per tenant.
TOPICS = {
    "raw_sensor_events": "{tenant_id}.raw_apm__sensor_readings.v1",
    "raw_dlq": "{tenant_id}.raw_apm__dlq_events.v1",
    "staging_telemetry_enriched": "{tenant_id}.staging_apm__sensor_readings.v1",
    "staging_dlq": "{tenant_id}.staging_apm__dlq_events.v1",
    "mart_anomalies": "{tenant_id}.mart_apm__fct_anomaly_events.v1",
    "mart_late_events": "{tenant_id}.mart_apm__fct_late_sensor_readings.v1",
    "mart_stream_health": "{tenant_id}.mart_apm__fct_stream_health_snapshots.v1",
    "mart_realtime_diagnosis": "{tenant_id}.mart_apm__fct_realtime_diagnosis_events.v1",
}


def _schema(text: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "a": T.ArrayType(T.StringType()), "i": T.IntegerType()}
    fields = [(f.split(":") + ["s"])[:2] for f in text.split()]
    return T.StructType([T.StructField(n, kinds[k]) for n, k in fields])


RAW_SCHEMA = _schema(
    "event_id event_time ingest_time quality_flags:a scenario schema_version source_system tag_id tag_name tenant_id "
    "unit value:d"
)

# Typed landing per stream.  ":d" double, ":i" int, ":t" time, ":b" boolean;
# "a>b" renames a to b.
LANDINGS = {
    "readings": (
        "staging_telemetry_enriched",
        "event_id tenant_id plant_id asset_id asset_name component_id tag_id tag_name metric_name threshold_profile_id "
        "event_time:t ingest_time:t value:d unit source_system quality_flags scenario",
    ),
    "anomalies": (
        "mart_anomalies",
        "anomaly_id schema_version rule_id tenant_id plant_id asset_id asset_name tag_id tag_name metric_name "
        "observed_value:d baseline_value:d expected_value:d event_count:i breach_count:i window_start:t window_end:t "
        "severity quality_flags detection_confidence:d source_event_ids",
    ),
    "late": (
        "mart_late_events",
        "event_id schema_version tenant_id plant_id asset_id tag_id metric_name event_time:t ingest_time:t "
        "watermark_time:t lateness_minutes:d reason quality_flags",
    ),
    "health": (
        "mart_stream_health",
        "schema_version job_name tenant_id watermark_lag_seconds:d late_event_count:n checkpoint_status observed_at:t",
    ),
    "diagnosis": (
        "mart_realtime_diagnosis",
        "diagnosis_id tenant_id anomaly_event_id>anomaly_id asset_id component_id risk_level escalation_required:b "
        "confidence:d quality_caveats generated_at>created_at:t",
    ),
    "dlq": (
        "raw_dlq",
        "dlq_event_id tenant_id event_time:t raw_payload original_topic error_type error_message",
    ),
}


def topic_for(key: str, tenant: Column) -> Column:
    """Topic of a tenant, as a column."""
    if key not in TOPICS:
        raise ValueError(f"Unknown topic key: {key}")
    before, after = TOPICS[key].split("{tenant_id}")
    return F.concat(F.lit(before), tenant, F.lit(after))


def land(stream: str, records: DataFrame, typed: bool = True) -> DataFrame:
    """Typed landing of one stream of text records, with its ``source_topic``.

    ``typed=False`` passes the text through (renames still apply).
    """
    topic, spec = LANDINGS[stream]
    out: list[Column] = []
    for field in spec.split():
        name, _, kind = field.partition(":")
        source, _, target = name.partition(">")
        c = F.col(source) if source in records.columns else F.lit(None).cast("string")
        if typed and kind == "d":
            c = c.try_cast("double")
        elif typed and kind == "i":
            c = c.try_cast("int")
        elif typed and kind == "n":
            c = c.try_cast("bigint")
        elif typed and kind == "t":
            c = parse_iso(c)
        elif typed and kind == "b":
            c = text_bool(c)
        out.append(c.alias(target or source))
    if stream == "readings":
        out.insert(1, F.lit("1.0").alias("schema_version"))
    return records.select(*out, topic_for(topic, F.col("tenant_id")).alias("source_topic"))


def kafka_source(
    spark: SparkSession, servers: str, *, topic: str | None = None, pattern: str | None = None, streaming: bool = True
) -> DataFrame:
    """A log topic, or every topic matching ``pattern``, from the earliest offset, as ``key, value, topic`` text."""
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    reader = reader.option("kafka.bootstrap.servers", servers).option("startingOffsets", "earliest")
    reader = reader.option("subscribePattern", pattern) if pattern else reader.option("subscribe", topic)
    return reader.load().select(F.col("key").cast("string"), F.col("value").cast("string"), "topic", "offset", "partition")


def kafka_sink(records: DataFrame, servers: str, checkpoint: str):  # noqa: ANN201
    """Append ``key, value, topic`` records to the log; the topic column chooses the topic per row."""
    return (
        records.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def parse_json(lines: DataFrame, schema: T.StructType = RAW_SCHEMA, value: str = "value") -> DataFrame:
    """Tolerant JSON scan: lines that are not JSON objects are skipped, unknown fields ignored.

    Numbers may be written as text; text that is no number gives NULL.
    """
    numeric = (T.DoubleType, T.IntegerType, T.LongType)
    texts = T.StructType(
        [T.StructField(f.name, T.StringType() if isinstance(f.dataType, numeric) else f.dataType) for f in schema]
    )
    kind = F.schema_of_variant(F.try_parse_json(F.col(value)))
    keep = [c for c in lines.columns if c != value]
    # inline() parses each line once, whatever is done with its fields later
    doc = F.from_json(F.col(value), texts, {"mode": "PERMISSIVE"})
    fields = [F.col(f.name).try_cast(f.dataType) if isinstance(f.dataType, numeric) else F.col(f.name) for f in schema]
    parsed = lines.filter(kind.startswith("OBJECT")).select(*keep, F.inline(F.array(doc)))
    return parsed.select(*keep, *[c.alias(f.name) for c, f in zip(fields, schema, strict=True)])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """``(records, rejects)`` of JSON-lines files; blank lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    kind = F.schema_of_variant(F.try_parse_json(F.col("value")))
    bad = ~F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    reason = F.when(F.try_parse_json(F.col("value")).isNull(), F.lit("Invalid JSON")).otherwise(
        F.lit("JSONL record must be an object")
    )
    return parse_json(lines, schema), lines.filter(bad).select("value", reason.alias("message"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object per line with keys in alphabetical order."""
    df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias("value")).write.mode("overwrite").text(path)


def write_by_month(df: DataFrame, path: str, time_col: str, sort: tuple[str, ...] = ("tenant_id",), mode: str = "append") -> None:
    """Parquet partitioned by month of ``time_col``.

    Rebalancing by month lets Spark split a heavy month over several tasks and merge
    light ones; rows are sorted inside files so that row-group statistics can skip.
    """
    out = df.withColumn("month", F.date_format(time_col, "yyyyMM")).hint("rebalance", "month")
    out.sortWithinPartitions("month", *sort, time_col).write.mode(mode).partitionBy("month").parquet(path)


def read_by_month(spark: SparkSession, path: str, time_col: str, since: str | None = None) -> DataFrame:
    """Monthly parquet; a lower time bound also prunes months."""
    df = spark.read.parquet(path)
    if since is None:
        return df
    month = since[:4] + since[5:7]
    return df.filter((F.col("month") >= month) & (F.col(time_col) >= F.lit(since).cast("timestamp_ntz")))


def route_records(checked: DataFrame, tenants: DataFrame) -> DataFrame:
    """Topic, key and validity per checked record.

    Valid records go to the tenant's raw topic with key ``tenant|tag``; invalid ones of a
    known tenant to its dead-letter topic; the rest have no topic (fallback file).
    ``checked`` needs ``tenant_id, tag_id, error_code``.  The list of tenants is broadcast: a join by tenant
    would bring all records of one tenant to one task.
    """
    known = tenants.select("tenant_id", F.lit(True).alias("_known")).dropDuplicates(["tenant_id"])
    df = checked.join(F.broadcast(known), "tenant_id", "left")
    valid = F.col("error_code").isNull()
    dead = ~valid & F.coalesce("_known", F.lit(False))
    tenant = F.col("tenant_id")
    return df.withColumns(
        {
            "valid": valid,
            "topic": F.when(valid, topic_for("raw_sensor_events", tenant)).when(dead, topic_for("raw_dlq", tenant)),
            "key": F.when(valid, F.concat_ws("|", "tenant_id", "tag_id")).when(dead, F.concat(tenant, F.lit("|dlq"))),
        }
    ).drop("_known")


def with_payload(routed: DataFrame, value: str = "value", now: Column | None = None) -> DataFrame:
    """Routed records with what is sent: a valid line as it is, for others the dead-letter record as JSON.

    The record holds the original (null where it is no JSON object), the error's code, path and message, the
    contract and the time, keys in alphabetical order.  ``routed`` also needs ``field_path`` and ``message``.
    """
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(F.col(value))).startswith("OBJECT"), F.lit(False))
    before = F.struct(F.lit("schema_validation_error").alias("error_code"), "field_path", "message")
    after = F.struct(
        F.lit("raw_sensor_event").alias("schema_name"),
        F.lit("raw_sensor_event.v1").alias("schema_version"),
        iso_z(F.current_timestamp() if now is None else now).alias("validation_time"),
    )
    # the original goes in as it stands, between the fields before and behind it
    record = F.concat(
        F.regexp_replace(F.to_json(before, {"ignoreNullFields": "false"}), r"\}$", ',"original_record":'),
        F.when(is_object, F.col(value)).otherwise(F.lit("null")),
        F.regexp_replace(F.to_json(after), r"^\{", ","),
    )
    return routed.withColumn("payload", F.when(F.col("valid"), F.col(value)).otherwise(record))


def restamp_times(records: DataFrame, mode: str, now: Column) -> DataFrame:
    """``backfill_replay`` stamps the ingest time, ``realtime_live`` event and ingest time.

    The mode goes into ``synthetic_metadata`` (a struct or a string map; made where missing).
    """
    if mode not in ("backfill_replay", "realtime_live"):
        raise ValueError(f"unknown producer mode: {mode}")
    kind = dict(records.dtypes).get("synthetic_metadata", "")
    if kind.startswith("struct"):
        metadata = F.when(F.col("synthetic_metadata").isNotNull(), F.col("synthetic_metadata").withField("producer_mode", F.lit(mode)))
        metadata = F.coalesce(metadata, F.lit(None).cast(kind).withField("producer_mode", F.lit(mode)))
    elif kind.startswith("map"):
        kept = F.map_filter(F.coalesce("synthetic_metadata", F.create_map().cast(kind)), lambda k, _: k != "producer_mode")
        metadata = F.map_concat(kept, F.create_map(F.lit("producer_mode"), F.lit(mode)))
    else:
        metadata = F.create_map(F.lit("producer_mode"), F.lit(mode))
    out = records.withColumn("ingest_time", now).withColumn("synthetic_metadata", metadata)
    return out if mode == "backfill_replay" else out.withColumn("event_time", now)
