"""Rule-based recommendations, recorded model responses and their audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plantpulse.functions.ids import key_text, recommendation_id, sha1_id
from plantpulse.functions.once import computed_once
from plantpulse.functions.text import json_list, sorted_set
from plantpulse.functions.times import iso_z

RECOMMENDATION_COLUMNS = (
    "recommendation_id schema_version tenant_id anomaly_id evidence_version asset_id component_id summary findings "
    "possible_causes recommended_checks runbook_references related_signals related_failure_modes suggested_action "
    "confidence_label quality_caveats model_name prompt_version token_cost latency_ms created_at status"
).split()

PROMPT_VERSION = "triage_prompt.v1"
RULE_MODEL = "fallback-rule-based"

# Sentences of the rule-based recommendation and unit prices per 1000 tokens.
RECOMMENDED_CHECKS = (
    "Check recent sensor readings and source event IDs in Doris.",
    "Review asset runbook references before operator action.",
    "Confirm data quality flags before escalating severity.",
)
SUMMARY_MIDDLE = " has an evidence-backed "
SUMMARY_END = " anomaly in the selected window. Review the recommended checks before taking operational action."
ACTION_START = "Review "
ACTION_MIDDLE = " readings on "
ACTION_END = " in Doris and cross-check with asset runbook references before operator action."
CAUSE_CHANGE = "Hypothesis: sensor or process condition changed during the anomaly window."
CAUSE_QUALITY = "Hypothesis: data quality issues may affect confidence."
CAUSE_PHYSICAL = "Hypothesis: physical operating condition breached configured expectations."
EMPTY_WINDOW = "Sensor window evidence is missing or empty."
PROMPT_PRICE, COMPLETION_PRICE = 0.001, 0.002


def _text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit("None"))


def quality_caveats() -> Column:
    """Sorted caveats from an evidence row: empty sensor window, and each failing or serious check."""
    serious = F.filter(
        F.col("quality_events"), lambda q: q["severity"].isin("critical", "warning") | (q["check_status"] == "fail")
    )
    lines = F.transform(
        serious,
        lambda q: F.concat(
            F.lit("Quality check "), q["check_name"], F.lit(" reported "), q["check_status"], F.lit("/"), q["severity"],
            F.lit("."),
        ),
    )
    empty = F.when(F.size("sensor_window") == 0, F.array(F.lit(EMPTY_WINDOW))).otherwise(F.array().cast("array<string>"))
    return sorted_set(F.concat(empty, lines))


def _failure_modes(evidence: DataFrame) -> Column:
    """Ids of the evidence's failure mode: one, or none."""
    none = F.array().cast("array<string>")
    kind = evidence.schema["failure_mode_context"].dataType
    if not isinstance(kind, StructType) or "failure_mode_id" not in kind.names:
        return none
    name = F.nullif(F.col("failure_mode_context.failure_mode_id"), F.lit(""))
    return F.when(name.isNotNull(), F.array(name)).otherwise(none)


def evidence_reference() -> Column:
    """What later checks ask of the evidence a recommendation was made from, as one struct."""
    allowed = F.transform("runbook_refs", lambda r: F.concat(r["runbook_id"], F.lit("#"), r["section"]))
    return F.struct("evidence_id", "tenant_id", "anomaly_id", "evidence_version", allowed.alias("allowed"))


def recommendations(
    evidence: DataFrame, created_at: Column, related_signals: Column | None = None, with_reference: bool = False
) -> DataFrame:
    """One recommendation per evidence row (23 columns), all from column expressions.

    ``related_failure_modes`` has the failure mode of the evidence, where it has one.  ``with_reference`` adds the
    column ``evidence`` (see :func:`evidence_reference`), so that later steps need not build the evidence again.
    """
    metric = F.coalesce(F.nullif("metric_name", F.lit("")), F.lit("metric"))
    asset = F.coalesce(F.nullif("asset_id", F.lit("")), F.lit("asset"))
    component = F.coalesce("component_id", F.lit(""))
    df = computed_once(evidence, _caveats=quality_caveats())
    doubtful = F.size("_caveats") > 0
    slash = F.when(component != "", F.concat(F.lit("/"), component)).otherwise(F.lit(""))
    if related_signals is None:
        has_window = F.size("sensor_window") > 0
        related_signals = F.when(has_window, F.array("tag_id")).otherwise(F.array().cast("array<string>"))
    refs = F.transform("runbook_refs", lambda r: F.concat(r["runbook_id"], F.lit("#"), r["section"]))
    return df.select(
        recommendation_id(F.col("evidence_version")).alias("recommendation_id"),
        F.lit("agent_explanation.v1").alias("schema_version"),
        "tenant_id",
        "anomaly_id",
        "evidence_version",
        asset.alias("asset_id"),
        component.alias("component_id"),
        F.concat(
            asset, F.lit(SUMMARY_MIDDLE), metric,
            F.lit(SUMMARY_END),
        ).alias("summary"),
        F.array(
            F.concat(
                F.lit("Observed value "), _text("observed_value"), F.lit(" vs expected "), _text("expected_value"),
                F.lit("."),
            ),
            F.concat(
                F.lit("Detection window "), _text(iso_z("window_start")), F.lit(" to "), _text(iso_z("window_end")),
                F.lit("."),
            ),
        ).alias("findings"),
        F.array(
            F.lit(CAUSE_CHANGE), F.when(doubtful, F.lit(CAUSE_QUALITY)).otherwise(F.lit(CAUSE_PHYSICAL))
        ).alias("possible_causes"),
        F.array(*[F.lit(c) for c in RECOMMENDED_CHECKS]).alias("recommended_checks"),
        refs.alias("runbook_references"),
        sorted_set(related_signals).alias("related_signals"),
        _failure_modes(evidence).alias("related_failure_modes"),
        F.concat(
            F.lit(ACTION_START), metric, F.lit(ACTION_MIDDLE), asset, slash, F.lit(ACTION_END),
        ).alias("suggested_action"),
        F.when(doubtful, F.lit("low")).otherwise(F.lit("medium")).alias("confidence_label"),
        F.col("_caveats").alias("quality_caveats"),
        F.lit(RULE_MODEL).alias("model_name"),
        F.lit(PROMPT_VERSION).alias("prompt_version"),
        F.lit(0.0).alias("token_cost"),
        F.lit(0).alias("latency_ms"),
        created_at.alias("created_at"),
        F.lit("fallback").alias("status"),
        *([evidence_reference().alias("evidence")] if with_reference else []),
    )


def recommendation_rows(validated: DataFrame) -> DataFrame:
    """Storage form: arrays as JSON list text, with validation status and quarantine reason (19 columns)."""
    lists = ("findings", "possible_causes", "recommended_checks", "runbook_references", "quality_caveats")
    names = (
        "recommendation_id tenant_id anomaly_id evidence_version summary findings possible_causes recommended_checks "
        "runbook_references confidence_label quality_caveats model_name prompt_version token_cost latency_ms status "
        "validation_status quarantine_reason created_at"
    ).split()
    return validated.select(*[json_list(F.col(c)).alias(c) if c in lists else F.col(c) for c in names])


# --- recorded model responses --------------------------------------------------------------


def parse_responses(responses: DataFrame, content: str = "content") -> DataFrame:
    """Recorded model output with code fences removed (``cleaned``) and ``parsed_status``:
    ``parsed_json`` when the rest is one JSON object, else ``non_json``."""

    def strip(c: Column) -> Column:
        return F.regexp_replace(c, r"^\s+|\s+$", "")

    bare = strip(F.col(content))
    head = F.regexp_replace(bare, r"^[^\n]*(\n|$)", "")
    inner = strip(F.regexp_replace(head, r"(^|\n)```[^\n]*$", ""))
    cleaned = F.when(bare.startswith("```"), inner).otherwise(bare)
    out = computed_once(responses, cleaned=cleaned)
    kind = F.schema_of_variant(F.try_parse_json(F.col("cleaned")))
    ok = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    return out.withColumn("parsed_status", F.when(ok, F.lit("parsed_json")).otherwise(F.lit("non_json")))


def token_cost(prompt_tokens: Column, completion_tokens: Column) -> Column:
    return prompt_tokens * PROMPT_PRICE / 1000 + completion_tokens * COMPLETION_PRICE / 1000


def choose_recommendation(rules: DataFrame, recorded: DataFrame) -> DataFrame:
    """The recorded recommendation where it is valid, else the rule-based one.

    ``recorded`` has one row per anomaly: ``parsed_status``, ``validation_status``,
    ``validation_reason`` and the recommendation columns it replaces.  Adds
    ``chosen_status`` (valid, quarantined or fallback) and ``chosen_reason``.
    """
    r = recorded.select(
        "tenant_id",
        "anomaly_id",
        "parsed_status",
        "validation_status",
        "validation_reason",
        F.struct("summary", "model_name", "token_cost", "latency_ms").alias("_rec"),
    )
    df = rules.join(r, ["tenant_id", "anomaly_id"], "left")
    parsed = F.coalesce(F.col("parsed_status") == "parsed_json", F.lit(False))
    valid = parsed & F.coalesce(F.col("validation_status") == "valid", F.lit(False))
    status = F.when(valid, F.lit("valid")).when(parsed, F.lit("quarantined")).otherwise(F.lit("fallback"))
    reason = (
        F.when(valid, F.lit(""))
        .when(parsed, F.coalesce("validation_reason", F.lit("")))
        .otherwise(F.coalesce("parsed_status", F.lit("")))
    )
    df = df.withColumns({"_valid": valid, "chosen_status": status, "chosen_reason": reason})
    replaced = {c: F.when(F.col("_valid"), F.col(f"_rec.{c}")).otherwise(F.col(c)) for c in
                ("summary", "model_name", "token_cost", "latency_ms")}
    replaced["status"] = F.when(F.col("_valid"), F.lit("llm_generated")).otherwise(F.col("status"))
    return df.withColumns(replaced).drop("_rec", "_valid", "parsed_status", "validation_status", "validation_reason")


def invocation_audit(calls: DataFrame) -> DataFrame:
    """Audit row per model call (16 columns).  The request hash covers the evidence id only.

    ``calls`` carries tenant, incident, anomaly and evidence ids, provider, model,
    ``raw_response``, statuses, token counts, latency and ``created_at``.
    """
    request = F.concat(F.lit('{"evidence_id":"'), F.col("evidence_id"), F.lit('"}'))
    request_hash = F.substring(F.sha1(request), 1, 32)
    df = calls.withColumn("request_hash", request_hash)
    return df.select(
        sha1_id("inv_", key_text("tenant_id", "incident_id", "anomaly_id", "evidence_id", "request_hash")).alias(
            "invocation_id"
        ),
        "tenant_id",
        "incident_id",
        "anomaly_id",
        "evidence_id",
        "provider",
        "model_name",
        F.lit(PROMPT_VERSION).alias("prompt_version"),
        "request_hash",
        "raw_response",
        "parsed_status",
        "validation_status",
        "quarantine_reason",
        token_cost(F.col("prompt_tokens"), F.col("completion_tokens")).alias("token_cost"),
        "latency_ms",
        "created_at",
    )
