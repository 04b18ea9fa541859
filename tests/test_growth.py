"""What a task holds must not grow with the table: rows are shuffled once, and no task gets a whole group."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantpulse.operators import detectors
from plantpulse.operators.series import as_of_join, as_of_joins, with_halo
from plantpulse.plans import queries
from plantpulse.plans.queries import QUERIES
from plantpulse.sources import logs

SF = "/root/testdata/sf0.001"


def plan(df) -> str:  # noqa: ANN001
    return df._jdf.queryExecution().executedPlan().toString()


def test_rolling_features_shuffle_the_readings_once(spark):
    """The list of busy series is broadcast, so no join sorts all readings beside the window's own sort."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables too large to broadcast
    try:
        shown = plan(QUERIES["detect_flatline_window"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in shown and "BroadcastHashJoin" in shown


def test_a_busy_series_with_a_null_key_is_split(spark):
    rows = spark.range(200).select(
        F.lit("t").alias("tenant_id"), F.lit(None).cast("string").alias("asset_id"), F.lit("g").alias("tag_id"), F.lit("m").alias("metric_name"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("event_time"),
        F.format_string("e%03d", "id").alias("event_id"), F.col("id").cast("double").alias("value"), F.array().cast("array<string>").alias("quality_flags"),
        *[F.lit("x").alias(c) for c in detectors._PASSENGERS],
    )
    chunks = with_halo(rows, 24, target_rows=40).filter("not _halo").groupBy("_chunk").count().collect()
    assert len(chunks) > 3 and sum(r["count"] for r in chunks) == 200
    columns = ["event_id", "rolling_baseline_mean", "prev_window_value", "event_count"]
    cut, whole = (detectors.detector_features(rows, target_rows=n).select(columns).orderBy("event_id").collect() for n in (40, 10**6))
    assert len(cut) == 200 and cut == whole


def test_tag_catalogue_is_made_by_many_tasks(spark):
    """Few bytes of plants become many rows: the plants' bytes alone would make it one task."""
    rows = QUERIES["tag_catalog"](spark, SF)
    made = rows.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(made) >= 4 and sum(r["count"] for r in made) == rows.count()


def test_records_are_not_shuffled_by_tenant(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        checked = spark.range(30).selectExpr("concat('t', id % 3) AS tenant_id", "'g' AS tag_id", "if(id % 2 = 0, 'bad', NULL) AS error_code")
        routed = logs.route_records(checked, checked.select("tenant_id").filter("tenant_id != 't2'"))
        assert "SortMergeJoin" not in plan(routed) and "BroadcastHashJoin" in plan(routed)
        assert routed.filter("topic IS NULL").count() == 5 and routed.count() == 30
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_several_as_of_tables_share_one_pass(spark):
    a = spark.range(50).selectExpr("if(id % 7 = 0, NULL, id % 3) AS k", "if(id % 11 = 0, NULL, timestamp_ntz '2024-01-01' + make_dt_interval(id % 9, id % 5)) AS at", "id")
    b, c = (
        spark.range(n).selectExpr("id % 3 AS k", f"timestamp_ntz '2024-01-01' + make_dt_interval(id % {n // 5}, id % 3) AS {t}", f"id AS {i}")
        for n, t, i in ((40, "b_at", "b"), (30, "c_at", "c"))
    )
    one = as_of_join(as_of_join(a, b, ["k"], "at", "b_at", ["b"], "x"), c, ["k"], "at", "c_at", ["c"], "y")
    both = as_of_joins(a, [(b, "b_at", ["b"], "x"), (c, "c_at", ["c"], "y")], ["k"], "at")
    assert both.orderBy("id").collect() == one.orderBy("id").collect() and both.count() == 50


def test_evidence_in_context_reads_its_tables_a_few_times(spark):
    """Chained as-of joins read what is before them three times each, and a join of evidence and context all of it again."""
    shown = plan(QUERIES["evidence_context"](spark, SF))
    assert shown.count("events.parquet") < 20 and shown.count("lineitem.parquet") < 8


def test_a_tenants_anomalies_are_not_gathered_in_one_task(spark):
    """The tenant's health row is broadcast: shuffled for it, all evidence of a tenant would be made by one task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where the health rows' plan is not known to be small
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = QUERIES["triage_evidence"](spark, SF)
        # the maximum asks for the evidence text, without which the join would be left out
        made = found.groupBy("tenant_id", F.spark_partition_id().alias("task")).agg(F.max("json_window_start")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for tenant in {r["tenant_id"] for r in made}:
        assert len([r for r in made if r["tenant_id"] == tenant]) > 1


def shuffled_records(spark, df) -> int:  # noqa: ANN001
    """Records written to shuffles while ``df`` is computed."""
    store, no = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def written() -> dict[tuple[int, int], int]:
        stages = store.stageList(None, False, False, no, spark._jvm.java.util.ArrayList())
        found = (stages.apply(i) for i in range(stages.size()))
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in found}

    before = written()
    df.write.format("noop").mode("overwrite").save()
    return sum(n for k, n in written().items() if k not in before)


def test_rows_that_no_as_of_join_can_find_are_not_shuffled(spark):
    """Of 40,000 rows per key, one from before the first time asked for and those up to the last can be found."""
    a = spark.range(20).selectExpr("id % 2 AS k", "timestamp_ntz '2024-01-01' + make_dt_interval(0, id) AS at", "id")
    b = spark.range(80_000).selectExpr("id % 2 AS k", "timestamp_ntz '2023-06-01' + make_dt_interval(id % 400, id % 24) AS b_at", "id AS b")
    found = as_of_join(a, b, ["k"], "at", "b_at", ["b"], "x")
    assert shuffled_records(spark, found) < 2_000
    rows = b.collect()
    for r in found.collect():
        want = max((x.b_at, x.b) for x in rows if x.k == r.k and x.b_at <= r["at"])
        assert (r.x.b_at, r.x.b) == want


def test_evidence_in_context_shuffles_the_line_items_once(spark):
    """One shuffle of the line items serves maintenance and failures; the context's health rows need no gaps of the readings."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert shuffled_records(spark, QUERIES["evidence_context"](spark, SF)) < 1.5 * lines
    health = lambda df: {tuple(r.stream_health[0]) for r in df.collect()}
    assert health(queries.evidence_in_context(spark, SF)) == health(queries.latest_context(spark, SF))
