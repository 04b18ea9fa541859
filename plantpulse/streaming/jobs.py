"""Structured Streaming forms of the operators.

Sources and sinks are given by the caller: a log (:func:`sources.logs.kafka_source`) or
files.  Narrow operators run unchanged on streams.  Anything written inside
``foreachBatch`` goes to a folder named by the batch id, written with overwrite, so a
batch that runs twice after a lost executor or driver leaves one copy.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from plantpulse.functions.times import parse_iso, seconds, whole_seconds
from plantpulse.operators import detectors, health, incidents
from plantpulse.operators.dead_letter import complete, missing_required
from plantpulse.operators.enrich import enrich_readings
from plantpulse.operators.late import late_against, late_by_ingest_lag, late_by_watermark
from plantpulse.operators.latest import latest_by_key, latest_n
from plantpulse.operators.series import ORDER, SERIES
from plantpulse.sources import tables
from plantpulse.sources.logs import RAW_SCHEMA, parse_json
from plantpulse.sources.tables import BUCKETS

WATERMARK = "5 minutes"
# event-time state must outlive the watermark delay plus the allowed lateness
STATE_WATERMARK = "15 minutes"


def json_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of text lines from a folder (the file twin of a log topic)."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def readings_stream(lines: DataFrame, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """Typed readings with an event-time watermark, without repeats of an event id."""
    r = parse_json(lines, schema).withColumns(
        {c: parse_iso(c).cast("timestamp") for c in ("event_time", "ingest_time")}
    )
    return r.withWatermark("event_time", STATE_WATERMARK).dropDuplicatesWithinWatermark(["event_id"])


def enriched_stream(readings: DataFrame, dims: Callable[[], tuple[DataFrame, DataFrame, DataFrame]]) -> DataFrame:
    """Readings joined with static dimensions; no join state is kept.

    ``dims`` returns (tags, assets, components).  The files behind them are listed when
    the query starts; use :func:`enrich_batches` to see changes in every micro-batch.
    """
    return enrich_readings(readings, *dims())


def health_stream(
    readings: DataFrame,
    dead_letters: DataFrame | None = None,
    gaps: DataFrame | None = None,
    width: str = "5 minutes",
    max_lag_seconds: int = 600,
) -> DataFrame:
    """Tumbling health snapshots per tenant in the 10 columns of the batch form, from up to three streams.

    Append: a window is emitted when the watermark of all streams passes it.  ``dead_letters`` needs
    ``tenant_id, event_time``; ``gaps`` ``tenant_id, window_end``; each with a watermark on its time.
    """
    no, none = F.lit(0).cast("bigint"), F.lit(None).cast("double")
    late = (whole_seconds("event_time", "ingest_time") > max_lag_seconds).cast("bigint")
    lag = seconds("event_time", "ingest_time")

    def part(rows: DataFrame, time_col: str, *measures: Column) -> DataFrame:
        return rows.select("tenant_id", F.col(time_col).alias("at"), *[m.alias(c) for m, c in zip(measures, health.PART, strict=True)])

    one = F.lit(1).cast("bigint")
    rows = part(readings, "event_time", one, lag, late, no, no)
    if dead_letters is not None:
        rows = rows.union(part(dead_letters, "event_time", no, none, no, one, no))
    if gaps is not None:
        rows = rows.union(part(gaps, "window_end", no, none, no, no, one))
    totals = rows.groupBy("tenant_id", F.window("at", width).alias("w")).agg(
        *[(F.max if c == "watermark_lag_seconds" else F.sum)(c).alias(c) for c in health.PART]
    )
    return health.shaped(totals.filter("reading_count > 0").withColumn("observed_at", F.col("w.start")))


def append_files(df: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> DataStreamWriter:
    """Continuous landing into parquet."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return w.partitionBy(*partition_by) if partition_by else w


def per_batch(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(work)


def run_available(writer: DataStreamWriter) -> StreamingQuery:
    """Process what is there, in micro-batches, and stop."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _stored(spark: SparkSession, path: str, before: int, like: DataFrame) -> DataFrame:
    """Rows written by earlier batches (none before the first)."""
    if before <= 0:
        return like.limit(0)
    schema = T.StructType([*like.schema.fields, T.StructField("batch_id", T.IntegerType())])
    return spark.read.schema(schema).parquet(path).filter(F.col("batch_id") < before).drop("batch_id")


# --- upsert --------------------------------------------------------------------------------


def upsert_batches(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Keyed upsert as an append of versions: :func:`current_rows` gives the newest per key.

    Nothing already written is touched, so the cost of a batch does not grow with the table.
    """
    return per_batch(df, lambda batch, n: write_batch(batch, path, n), checkpoint)


def merge_batches(
    df: DataFrame, path: str, checkpoint: str, keys: Sequence[str], version: str, ties: Sequence[str] = (), buckets: int = BUCKETS
) -> DataStreamWriter:
    """Keyed upsert into a table of hash buckets (:func:`sources.tables.merge_batch`).

    A batch rewrites the buckets it touches; :func:`sources.tables.read_table` reads one file per bucket,
    however many batches there were.  :func:`upsert_batches` writes less and reads more.
    """
    return per_batch(df, lambda batch, n: tables.merge_batch(batch, path, keys, version, ties, n, buckets), checkpoint)


def current_anomalies(spark: SparkSession, path: str) -> DataFrame:
    """Anomalies of a detector folder by their newest verdict per series and reading; cleared ones are gone."""
    keys = [*SERIES, "window_end"]
    return current_rows(spark, path, keys, ["anomaly_id"]).filter(~F.col("cleared")).drop("cleared")


def current_rows(spark: SparkSession, path: str, keys: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Newest version per key of an upsert folder; ``ties`` order the versions of one batch."""
    return latest_by_key(spark.read.parquet(path), keys, "batch_id", ties).drop("batch_id")


# --- enrichment against changing dimensions ------------------------------------------------


def enrich_batches(
    readings: DataFrame,
    dims: Callable[[], tuple[DataFrame, DataFrame, DataFrame]],
    path: str,
    checkpoint: str,
) -> DataStreamWriter:
    """Enrichment that reads the current dimensions again in every micro-batch."""

    def work(batch: DataFrame, n: int) -> None:
        write_batch(enrich_readings(batch, *dims()), path, n)

    return per_batch(readings, work, checkpoint)


# --- late readings by watermark -------------------------------------------------------------


def late_batches(readings: DataFrame, path: str, state: str, checkpoint: str) -> DataStreamWriter:
    """Late readings by watermark.  Each batch stores its newest event time per tenant (one small
    row per tenant); readings are judged against that of earlier batches and the earlier
    arrivals of their own batch."""

    def work(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        tops = batch.groupBy("tenant_id").agg(F.max("event_time").alias("top"))
        # the batch before carries the maxima of all earlier ones
        known = tops.limit(0) if n == 0 else spark.read.schema(tops.schema).parquet(f"{state}/batch_id={n - 1}")
        write_batch(late_since(batch, known), path, n)
        carried = known.unionByName(tops).groupBy("tenant_id").agg(F.max("top").alias("top"))
        write_batch(carried, state, n)

    return per_batch(readings, work, checkpoint)


def late_since(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Late readings of one batch, given the newest event time per tenant before it."""
    earlier = batch.join(known, "tenant_id").withColumn(
        "watermark_time", F.col("top") - F.expr(f"INTERVAL {WATERMARK}")
    )
    by_state = late_against(earlier)
    own = late_by_watermark(batch)
    # a reading may be late against both; the later watermark is the one in force on arrival
    return latest_by_key(by_state.unionByName(own), ["event_id"], "watermark_time")


# --- detectors ------------------------------------------------------------------------------


def detector_increment(
    batch: DataFrame, history: DataFrame, verdict: detectors.Verdict, rows_before: int = detectors.BASELINE_POINTS
) -> DataFrame:
    """Window anomalies of the series a batch touches, from the batch's first reading on.

    ``history`` holds earlier readings.  Only the ``rows_before`` readings before the batch
    and those after its first reading are read into the frames; a reading that arrives late
    re-judges the readings after it (their anomaly ids stay the same).
    """
    starts = batch.groupBy(*SERIES).agg(F.min("event_time").alias("_from"))
    old = history.join(starts, list(SERIES))
    after = old.filter(F.col("event_time") >= F.col("_from")).drop("_from")
    before = latest_n(old.filter(F.col("event_time") < F.col("_from")).drop("_from"), SERIES, ORDER, rows_before)
    rows = before.unionByName(after).unionByName(batch).dropDuplicates(["event_id"])
    features = detectors.detector_features(rows).join(starts, list(SERIES))
    judged = features.filter(F.col("event_time") >= F.col("_from")).drop("_from")
    return detectors.window_anomalies(judged, verdict, with_cleared=True)


def detect_batches(
    readings: DataFrame,
    verdict: Callable[[], detectors.Verdict],
    path: str,
    history: str,
    checkpoint: str,
    horizon: str | None = None,
) -> DataStreamWriter:
    """Detector over a stream of enriched readings; :func:`current_anomalies` reads what stands.

    Every reading judged anew leaves its verdict, hit or cleared, so a late reading withdraws a
    false alarm.

    ``horizon`` (e.g. ``"7 DAYS"``) bounds how far back history is read, where readings are
    known not to pause or arrive later than that; the bound reaches the history scan.
    """

    def work(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        old = _stored(batch.sparkSession, history, n, batch)
        if horizon:
            oldest = batch.agg(F.min("event_time").alias("oldest")).scalar()
            old = old.filter(F.col("event_time") >= oldest - F.expr(f"INTERVAL {horizon}"))
        write_batch(detector_increment(batch, old, verdict()), path, n)
        write_batch(batch, history, n)
        batch.unpersist()

    return per_batch(readings, work, checkpoint)


# --- one pass with several outputs -----------------------------------------------------------


OUTPUTS = ("readings", "dead_letters", "late", "health", "metrics")


def ingest_batches(
    lines: DataFrame,
    dims: Callable[[], tuple[DataFrame, DataFrame, DataFrame]],
    path: str,
    checkpoint: str,
    max_lag_seconds: int = 600,
) -> DataStreamWriter:
    """Raw JSON lines to enriched readings, dead letters, late readings and health, each a folder below ``path``.

    The source is read once per batch: the parsed rows are kept for all outputs.  What the batch held is
    observed while the readings are written and stored as one row of ``metrics``.  Every output is a folder
    named by the batch, so a repeated batch leaves one copy.
    """

    def work(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        parsed = parse_json(batch).persist()
        dead = missing_required(parsed.withColumn("at", parse_iso("event_time")), keep=("tenant_id", "at"))
        write_batch(dead, f"{path}/dead_letters", n)
        dead = spark.read.parquet(f"{path}/dead_letters/batch_id={n}")
        rows = parsed.filter(complete())
        rows = rows.withColumns({c: parse_iso(c) for c in ("event_time", "ingest_time")})
        lag = seconds("event_time", "ingest_time")
        seen = Observation()
        rows = rows.observe(
            seen,
            F.count(F.lit(1)).alias("complete_count"),
            F.count_if(lag > max_lag_seconds).alias("late_count"),
            F.max(lag).alias("max_lag_seconds"),
        )
        write_batch(enrich_readings(rows, *dims()), f"{path}/readings", n)
        readings = spark.read.parquet(f"{path}/readings/batch_id={n}")
        write_batch(late_by_ingest_lag(readings, max_lag_seconds), f"{path}/late", n)
        dead_times = dead.select("tenant_id", F.col("at").alias("event_time"))
        write_batch(health.health_parts(readings, dead_times, max_lag_seconds=max_lag_seconds), f"{path}/health", n)
        counts = spark.range(1).select(
            F.lit(dead.count()).alias("dead_count"),
            *[F.lit(seen.get[c]).cast("double" if c == "max_lag_seconds" else "bigint").alias(c) for c in sorted(seen.get)],
        )
        write_batch(counts, f"{path}/metrics", n)
        parsed.unpersist()

    return per_batch(lines, work, checkpoint)


def current_health(spark: SparkSession, path: str, gaps: DataFrame | None = None) -> DataFrame:
    """Health rows of all batches of :func:`ingest_batches`; ``gaps`` (missing heartbeats) as in the batch form."""
    parts = spark.read.parquet(f"{path}/health").drop("batch_id")
    if gaps is not None:
        parts = parts.unionByName(health.health_parts(gaps.limit(0).select("tenant_id", F.col("window_end").alias("event_time"),
                                                      F.col("window_end").alias("ingest_time")), gaps=gaps))
    return health.health_rows(parts)


# --- incidents ---------------------------------------------------------------------------------


def incident_stream(anomalies: DataFrame, cooldown: str = incidents.COOLDOWN, delay: str = "5 minutes") -> DataFrame:
    """Incidents of a stream of anomalies, each emitted once, when the watermark has passed its cool-down.

    State per key: the open sessions' counts and extremes.  An anomaly that comes after its incident was
    closed opens nothing anew; :func:`incidents.missed_anomalies` tells it from the landed anomalies.
    """
    kind = anomalies.schema["window_start"].dataType
    rows = incidents.seen(anomalies).withColumn("seen_at", F.col("seen_at").cast("timestamp")).withWatermark("seen_at", delay)
    sessions = rows.groupBy(*incidents.KEYS, F.session_window("seen_at", cooldown.lower()).alias("w")).agg(
        F.min("seen_at").alias("first_seen_at"),
        F.max("seen_at").alias("last_seen_at"),
        F.count(F.lit(1)).alias("anomaly_count"),
        F.min(F.struct("seen_at", "anomaly_id", "severity")).alias("_primary"),
        F.max(incidents.severity_rank(F.col("severity"))).alias("_rank"),
    )
    out = incidents.shaped(sessions)
    return out.withColumns({c: F.col(c).cast(kind) for c in ("first_seen_at", "last_seen_at")})


def signal_stream(readings: DataFrame, bucket: str = "1 minute") -> DataFrame:
    """Per-tag minute series as a stream (append, closed by the watermark)."""
    keys = ("tenant_id", "tag_id")
    return (
        readings.groupBy(*keys, F.window("event_time", bucket).alias("w"))
        .agg(
            F.avg("value").alias("avg_value"),
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
            F.max_by("value", F.struct("event_time", "event_id")).alias("last_value"),
            F.count(F.lit(1)).alias("event_count"),
        )
        .select(*keys, F.col("w.start").alias("bucket_minute"), "avg_value", "min_value", "max_value", "last_value",
                "event_count")
    )


def dead_letter_rows(lines: DataFrame) -> DataFrame:
    """Dead letters of a raw stream: the second output next to the enriched readings."""
    return missing_required(parse_json(lines))


