"""Correlated incidents: anomalies of one (tenant, asset, metric, rule) with a cool-down between incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.functions.ids import key_text, sha1_id
from plantpulse.functions.times import iso_z, with_bucket
from plantpulse.operators.series import bucketed_sessions, positions

KEYS = ("tenant_id", "asset_id", "metric_name", "rule_id")
COOLDOWN = "10 MINUTES"
BUCKET = "5 minutes"

# Severity ranks and the channel a severity is routed to.
SEVERITY_RANK = {"critical": 3, "warning": 2, "info": 1}
CHANNELS = {"critical": "teams_card", "warning": "ticket_simulated", "info": "dashboard_only"}
DEFAULT_CHANNEL = "dashboard_only"


def severity_rank(severity: Column) -> Column:
    out = None
    for name, rank in SEVERITY_RANK.items():
        cond = severity == name
        out = F.when(cond, F.lit(rank)) if out is None else out.when(cond, F.lit(rank))
    return out.otherwise(F.lit(0))


def channel_of(severity: Column) -> Column:
    """Routing channel of a severity; unknown severities go to the dashboard."""
    out = None
    for name, channel in CHANNELS.items():
        cond = severity == name
        out = F.when(cond, F.lit(channel)) if out is None else out.when(cond, F.lit(channel))
    return out.otherwise(F.lit(DEFAULT_CHANNEL))


def seen(anomalies: DataFrame) -> DataFrame:
    """Keys, id, severity and time of anomalies; missing keys are empty text."""
    keys = [F.coalesce(c, F.lit("")).alias(c) for c in KEYS]
    return anomalies.select(
        *keys,
        "anomaly_id",
        F.coalesce("severity", F.lit("info")).alias("severity"),
        F.coalesce("window_start", "window_end").alias("seen_at"),
    )


def _cells(anomalies: DataFrame, cooldown: str) -> DataFrame:
    """Per key and cool-down-wide bucket: counts and extremes, numbered by incident."""
    return bucketed_sessions(
        seen(anomalies),
        KEYS,
        "seen_at",
        cooldown,
        [
            F.min("seen_at").alias("_first"),
            F.max("seen_at").alias("_last"),
            F.count(F.lit(1)).alias("_n"),
            F.min(F.struct("seen_at", "anomaly_id", "severity")).alias("_primary"),
            F.max(severity_rank(F.col("severity"))).alias("_rank"),
        ],
        "_first",
        "_last",
    )


def _named(sessions: DataFrame) -> DataFrame:
    """Incident id and key: taken from the incident's first anomaly and its 5-minute bucket."""
    at = with_bucket(sessions.withColumn("_at", F.col("_primary.seen_at")), "_at", BUCKET, "_bucket")
    key = key_text(*KEYS, iso_z("_bucket"))
    return at.withColumn("correlation_key", key).withColumn("incident_id", sha1_id("inc_", key))


def incidents(anomalies: DataFrame, cooldown: str = COOLDOWN) -> DataFrame:
    """One row per incident.  An anomaly within ``cooldown`` of the previous one of its key (exactly
    that far included) extends the incident; the severest anomaly sets severity and channel.

    All anomaly ids of an incident are in :func:`incident_members` (an incident may hold
    any number of them); ``primary_anomaly_id`` is the first.
    """
    s = (
        _cells(anomalies, cooldown)
        .groupBy(*KEYS, "_session")
        .agg(
            F.min("_first").alias("first_seen_at"),
            F.max("_last").alias("last_seen_at"),
            F.sum("_n").alias("anomaly_count"),
            F.min("_primary").alias("_primary"),
            F.max("_rank").alias("_rank"),
        )
    )
    return shaped(s)


def shaped(sessions: DataFrame) -> DataFrame:
    """Incident rows of sessions with ``first_seen_at``, ``last_seen_at``, ``anomaly_count``, ``_primary`` and ``_rank``."""
    names = F.create_map(*[F.lit(x) for name, rank in SEVERITY_RANK.items() for x in (rank, name)])
    severity = F.coalesce(F.try_element_at(names, F.col("_rank")), F.col("_primary.severity"))
    return _named(sessions).select(
        "incident_id",
        "correlation_key",
        *KEYS,
        "first_seen_at",
        "last_seen_at",
        F.col("anomaly_count").alias("anomaly_count"),
        severity.alias("max_severity"),
        F.col("_primary.anomaly_id").alias("primary_anomaly_id"),
        F.lit("open").alias("status"),
        channel_of(severity).alias("routing_channel"),
    )


def incident_members(anomalies: DataFrame, cooldown: str = COOLDOWN) -> DataFrame:
    """``incident_id, anomaly_id, seen_at, position``: distinct anomaly ids in order of first sight."""
    # buckets of an incident already share a task (same key), so its first anomaly is a window away
    whole = Window.partitionBy(*KEYS, "_session")
    cells = _cells(anomalies, cooldown).withColumn("_primary", F.min("_primary").over(whole))
    by_cell = _named(cells).select(*KEYS, "_cell", "incident_id")
    rows = with_bucket(seen(anomalies), "seen_at", cooldown, "_cell").join(by_cell, [*KEYS, "_cell"])
    first = rows.groupBy("incident_id", "anomaly_id").agg(F.min("seen_at").alias("seen_at"))
    return positions(first, ["incident_id"], ["seen_at", "anomaly_id"], "seen_at")


def placed_anomalies(anomalies: DataFrame, incident_rows: DataFrame, cooldown: str = COOLDOWN) -> DataFrame:
    """Anomalies with the ``incident_id`` whose first and last sight they lie between; NULL outside every incident.

    Incidents are met per key and cool-down-wide time cell, so a key with many incidents makes no row pairs.
    """
    cells = F.explode(F.sequence("_from", "_to", F.expr(f"INTERVAL {cooldown}")))
    spans = with_bucket(with_bucket(incident_rows, "first_seen_at", cooldown, "_from"), "last_seen_at", cooldown, "_to")
    spans = spans.select(*KEYS, "incident_id", "first_seen_at", "last_seen_at", cells.alias("_cell"))
    rows = with_bucket(seen(anomalies), "seen_at", cooldown, "_cell").alias("a")
    met = [F.col(f"a.{c}") == F.col(f"i.{c}") for c in (*KEYS, "_cell")]
    inside = F.col("a.seen_at").between(F.col("i.first_seen_at"), F.col("i.last_seen_at"))
    return rows.join(spans.alias("i"), [*met, inside], "left").select("a.*", "i.incident_id").drop("_cell")


def missed_anomalies(anomalies: DataFrame, incident_rows: DataFrame, closed_until: Column, cooldown: str = COOLDOWN) -> DataFrame:
    """What a stream of incidents left out because it came too late: ``incident_id`` (NULL: of its own) and ``missed_count`` per key.

    ``closed_until``: incidents last seen before then are closed.  An incident counts as many anomalies as
    lie in its span, unless some came after it was closed; those outside every incident are told by key.
    """
    placed = placed_anomalies(anomalies, incident_rows, cooldown).filter(F.col("seen_at") < closed_until)
    known = incident_rows.select("incident_id", "anomaly_count")
    found = placed.groupBy(*KEYS, "incident_id").agg(F.count(F.lit(1)).alias("_n")).join(known, "incident_id", "left")
    missed = (F.col("_n") - F.coalesce("anomaly_count", F.lit(0))).alias("missed_count")
    return found.select(*KEYS, "incident_id", missed).filter("missed_count > 0")


def incident_id_pages(members: DataFrame, page_size: int = 1000) -> DataFrame:
    """Ordered id lists: ``incident_id, page, source_anomaly_ids``, at most ``page_size`` ids per row."""
    page = F.floor((F.col("position") - 1) / page_size).cast("bigint")
    ordered = F.array_sort(F.collect_list(F.struct("position", "anomaly_id")))
    return (
        members.withColumn("page", page)
        .groupBy("incident_id", "page")
        .agg(F.transform(ordered, lambda m: m["anomaly_id"]).alias("source_anomaly_ids"))
    )


def incident_context(incident_rows: DataFrame, recommendation_rows: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Incidents with evidence and recommendation of their first anomaly.

    Recommendations that carry the column ``evidence`` (:func:`recommend.evidence_reference`) name it themselves.
    """
    on = ["tenant_id", "primary_anomaly_id"]
    shown = ["recommendation_id", "summary", "recommended_checks"]
    if evidence is None:
        r = recommendation_rows.select(F.col("evidence.tenant_id"), F.col("evidence.anomaly_id").alias(on[1]), "evidence.evidence_id", *shown)
        return incident_rows.join(r, on, "left")
    e = evidence.select("tenant_id", F.col("anomaly_id").alias(on[1]), "evidence_id")
    r = recommendation_rows.select("tenant_id", F.col("anomaly_id").alias(on[1]), *shown)
    return incident_rows.join(e, on, "left").join(r, on, "left")


def route_alerts(incident_rows: DataFrame, created_at: Column, webhook_configured: bool = False) -> DataFrame:
    """Routing row per incident (9 columns).  Cards wait for delivery only when a webhook is configured."""
    waiting = F.lit(webhook_configured) & (F.col("routing_channel") == "teams_card")
    return incident_rows.select(
        F.concat(F.lit("route_"), F.col("incident_id")).alias("route_id"),
        "incident_id",
        "tenant_id",
        F.col("max_severity").alias("severity"),
        "routing_channel",
        F.when(waiting, F.lit("pending")).otherwise(F.lit("simulated")).alias("routing_status"),
        F.col("routing_channel").alias("notification_target"),
        F.lit(None).cast("string").alias("error_message"),
        created_at.alias("created_at"),
    )


# The card's labels, in order, its constant cool-down and its closing sentences.
CARD_LABELS = (
    "Tenant",
    "Asset",
    "Metric",
    "Rule",
    "Incident ID",
    "Severity",
    "Anomaly count",
    "First seen",
    "Last seen",
    "Cooldown",
    "Triage finding",
    "Recommended checks",
    "Evidence ID",
    "Recommendation ID",
)
CARD_COOLDOWN = "10 min"
CARD_CLOSING = (
    "This is an LLM-assisted triage summary for operator review. "
    "Review the recommended checks before taking operational action."
)


def alert_text(context: DataFrame) -> DataFrame:
    """Incidents with the card's ``alert_summary``, ``alert_color`` and ``alert_text``."""

    def shown(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit("None"))

    def other(name: str) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("N/A"))

    checks = F.coalesce(F.nullif(F.array_join("recommended_checks", ", "), F.lit("")), F.lit("N/A"))
    values = [
        *[shown(F.col(c)) for c in ("tenant_id", "asset_id", "metric_name", "rule_id", "incident_id", "max_severity")],
        shown(F.col("anomaly_count")),
        shown(iso_z("first_seen_at")),
        shown(iso_z("last_seen_at")),
        F.lit(CARD_COOLDOWN),
        other("summary"),
        checks,
        other("evidence_id"),
        other("recommendation_id"),
    ]
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in zip(CARD_LABELS, values, strict=True)]
    text = F.concat_ws("\n\n", *lines, F.lit(CARD_CLOSING))
    return context.withColumns(
        {
            "alert_summary": F.concat(
                F.lit("Alert: "), shown(F.col("tenant_id")), F.lit(" / "), shown(F.col("asset_id")), F.lit(" / "),
                shown(F.col("metric_name")),
            ),
            "alert_color": F.when(F.col("max_severity") == "critical", F.lit("FF0000")).otherwise(F.lit("FFA500")),
            "alert_text": text,
        }
    )
