"""Checks on derived records: consumed anomalies, recommendations, diagnoses, operator feedback."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.functions.ids import quarantine_id
from plantpulse.functions.once import computed_once
from plantpulse.functions.text import sorted_set
from plantpulse.operators.contracts import contract_errors

# Phrases no recommendation or diagnosis may use, and required fields.
BANNED_IN_RECOMMENDATION = (
    "definitive root cause|autonomous diagnosis|automatic remediation|remediation executed|shut down the equipment"
)
BANNED_IN_DIAGNOSIS = f"root_cause|{BANNED_IN_RECOMMENDATION}|guaranteed RUL"
ANOMALY_FIELDS = (
    "tenant_id anomaly_id asset_id component_id tag_id metric_name rule_id window_start window_end severity "
    "quality_flags source_event_ids"
).split()
FEEDBACK_FIELDS = (
    "feedback_id tenant_id incident_id anomaly_id operator_id is_true_positive severity_correction "
    "explanation_usefulness resolution_note created_at"
).split()
SEVERITY_CORRECTIONS = ("none", "info", "warning", "critical")

_LIST = {"type": "array", "items": {"type": "string"}}
_TEXT = {"type": "string"}
# The contract of a recommendation.
EXPLANATION = {
    "title": "agent_explanation",
    "type": "object",
    "additionalProperties": False,
    "required": (
        "recommendation_id schema_version tenant_id anomaly_id evidence_version summary findings possible_causes "
        "recommended_checks runbook_references confidence_label quality_caveats model_name prompt_version token_cost "
        "latency_ms created_at status"
    ).split(),
    "properties": {
        "recommendation_id": _TEXT,
        "schema_version": {"type": "string", "const": "agent_explanation.v1"},
        "tenant_id": _TEXT,
        "anomaly_id": _TEXT,
        "asset_id": _TEXT,
        "component_id": _TEXT,
        "related_signals": _LIST,
        "related_failure_modes": _LIST,
        "suggested_action": _TEXT,
        "quality_event_ids": _LIST,
        "failure_mode_hypothesis": _TEXT,
        "failure_mode_hypothesis_confidence": {"type": "number", "minimum": 0, "maximum": 1},
        "evidence_version": _TEXT,
        "summary": _TEXT,
        "findings": _LIST,
        "possible_causes": _LIST,
        "recommended_checks": _LIST,
        "runbook_references": _LIST,
        "confidence_label": {"type": "string", "enum": ["low", "medium", "high"]},
        "model_name": _TEXT,
        "prompt_version": _TEXT,
        "token_cost": {"type": "number", "minimum": 0},
        "latency_ms": {"type": "integer", "minimum": 0},
        "quality_caveats": _LIST,
        "created_at": {"type": "string", "format": "date-time", "pattern": "Z$"},
        "status": {"type": "string", "enum": ["fallback", "llm_generated", "quarantined"]},
    },
}


def contract_messages(lines: DataFrame, contract: dict[str, Any] = EXPLANATION, value: str = "value") -> DataFrame:
    """Lines with ``schema_messages``: the contract's error messages for each JSON document."""
    checked = contract_errors(lines, contract, value)
    messages = F.transform("errors", lambda e: e["message"])
    return checked.withColumn("schema_messages", messages).drop("errors", "error_code", "field_path", "message")


def quarantine_anomalies(anomalies: DataFrame, tenant: str | None = None) -> DataFrame:
    """Anomaly messages with ``missing_fields`` and ``quarantine_reason`` (NULL: fit for consumption).

    A tenant-bound consumer also turns away other tenants' messages.
    """
    missing = F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ANOMALY_FIELDS]), lambda c: c.isNotNull()
    )
    reason = F.when(F.size("missing_fields") > 0, F.lit("missing_required_fields"))
    if tenant is not None:
        reason = reason.when(F.col("tenant_id") != tenant, F.lit("tenant_mismatch"))
    return anomalies.withColumn("missing_fields", missing).withColumn("quarantine_reason", reason)


def _joined(df: DataFrame, names: list[str]) -> Column:
    types = dict(df.dtypes)
    parts = [F.concat_ws(" ", F.col(n)) if types[n].startswith("array") else F.col(n) for n in names if n in types]
    return F.concat_ws(" ", *parts)


def _differs(left: str, right: str) -> Column:
    return ~F.col(left).eqNullSafe(F.col(right))


def _is_empty(name: str) -> Column:
    return F.coalesce(F.size(name) <= 0, F.lit(True))


def _evidence_side(evidence: DataFrame) -> DataFrame:
    return evidence.select(
        F.col("tenant_id").alias("_tenant_id"),
        F.col("anomaly_id").alias("_anomaly_id"),
        F.col("evidence_version").alias("_evidence_version"),
        F.transform("runbook_refs", lambda r: F.concat(r["runbook_id"], F.lit("#"), r["section"])).alias("_allowed"),
    )


#: Columns that name the tenant and the anomaly of the evidence that a row was made from.
EVIDENCE_KEY = ("evidence_tenant", "evidence_key")


def _paired(rows: DataFrame, evidence: DataFrame | None, on: tuple[str, str]) -> DataFrame:
    """Rows with their evidence; a row without any keeps NULL there.  Ids are unique within a tenant only.

    Without ``evidence`` the rows carry their own reference to it (:func:`recommend.evidence_reference`): no join.
    """
    if evidence is None:
        return rows.withColumns({f"_{c}": F.col(f"evidence.{c}") for c in ("tenant_id", "anomaly_id", "evidence_version", "allowed")})
    same = (F.col(on[0]) == F.col("_tenant_id")) & (F.col(on[1]) == F.col("_anomaly_id"))
    return rows.join(_evidence_side(evidence), same, "left")


def _or_missing(reasons: Column) -> Column:
    return F.when(F.col("_anomaly_id").isNull(), F.array(F.lit("missing_evidence"))).otherwise(reasons)


def validate_recommendations(
    recommendations: DataFrame, evidence: DataFrame | None = None, on: tuple[str, str] = EVIDENCE_KEY
) -> DataFrame:
    """Recommendations with ``validation_status`` (valid, quarantined) and ``quarantine_reason``.

    Both sides are paired by the columns ``on`` of the recommendation (tenant and anomaly of
    the evidence it was made from), so a recommendation that *names* another anomaly or
    tenant is caught, and one without evidence is quarantined as ``missing_evidence``.  Recommendations that
    carry the column ``evidence`` need no second side.
    ``schema_messages`` (from :func:`contract_messages`) join the reasons where present.
    """
    df = _paired(recommendations, evidence, on)
    banned = _joined(df, ["summary", "findings", "possible_causes", "recommended_checks"])
    unsupported = F.when(
        F.size("_allowed") > 0,
        F.transform(
            F.array_except("runbook_references", "_allowed"), lambda r: F.concat(F.lit("unsupported_runbook_ref:"), r)
        ),
    ).otherwise(F.array().cast("array<string>"))
    own = F.array(
        F.when(_differs("tenant_id", "_tenant_id"), F.lit("cross_tenant")),
        F.when(_differs("anomaly_id", "_anomaly_id"), F.lit("unsupported_anomaly")),
        F.when(_differs("evidence_version", "_evidence_version"), F.lit("unsupported_evidence_version")),
        F.when(_is_empty("findings") | _is_empty("recommended_checks"), F.lit("evidence_free")),
        F.when(banned.rlike(rf"(?i)\b({BANNED_IN_RECOMMENDATION})\b"), F.lit("banned_autonomous_claim")),
    )
    reasons = [F.filter(own, lambda e: e.isNotNull()), F.coalesce(unsupported, F.array().cast("array<string>"))]
    if "schema_messages" in df.columns:
        reasons.append(F.coalesce("schema_messages", F.array().cast("array<string>")))
    df = computed_once(df, _reasons=_or_missing(sorted_set(F.concat(*reasons))))
    bad = F.size("_reasons") > 0
    return df.withColumns(
        {
            "validation_status": F.when(bad, F.lit("quarantined")).otherwise(F.lit("valid")),
            "quarantine_reason": F.when(bad, F.array_join("_reasons", ";")),
        }
    ).drop("_reasons", "_tenant_id", "_anomaly_id", "_evidence_version", "_allowed")


def validate_diagnoses(diagnoses: DataFrame, evidence: DataFrame | None = None, on: tuple[str, str] = EVIDENCE_KEY) -> DataFrame:
    """Diagnoses with ``validation_status``, ``failure_reasons`` and, when quarantined, ``quarantine_id``.

    Paired like recommendations; one without evidence fails as ``missing_evidence``.
    """
    df = _paired(diagnoses, evidence, on)
    text = _joined(
        df,
        "summary findings possible_causes recommended_checks diagnosis_summary probable_causes suggested_action".split(),
    )
    own = F.array(
        F.when(_differs("tenant_id", "_tenant_id"), F.lit("cross_tenant")),
        F.when(_differs("anomaly_id", "_anomaly_id"), F.lit("anomaly_mismatch")),
        F.when(_differs("evidence_version", "_evidence_version"), F.lit("evidence_version_mismatch")),
        F.when(_is_empty("findings") | _is_empty("possible_causes"), F.lit("empty_findings_or_causes")),
        F.when(_is_empty("recommended_checks"), F.lit("empty_recommended_checks")),
        F.when(text.rlike(rf"(?i)\b({BANNED_IN_DIAGNOSIS})\b"), F.lit("banned_autonomous_claim")),
    )
    df = computed_once(df, failure_reasons=_or_missing(sorted_set(F.filter(own, lambda e: e.isNotNull()))))
    bad = F.size("failure_reasons") > 0
    # the quarantine id belongs to the evidence, whatever tenant or anomaly the diagnosis names
    named = df.withColumns({"_t": F.col("tenant_id"), "_a": F.col("anomaly_id")})
    named = named.withColumns(
        {"tenant_id": F.coalesce("_tenant_id", F.col(on[0])), "anomaly_id": F.coalesce("_anomaly_id", F.col(on[1]))}
    )
    named = named.withColumns(
        {
            "validation_status": F.when(bad, F.lit("quarantined")).otherwise(F.lit("valid")),
            "quarantine_id": F.when(bad, quarantine_id()),
        }
    )
    return named.withColumns({"tenant_id": F.col("_t"), "anomaly_id": F.col("_a")}).drop(
        "_t", "_a", "_tenant_id", "_anomaly_id", "_evidence_version", "_allowed"
    )


def validate_feedback(feedback: DataFrame) -> DataFrame:
    """Feedback with ``reject_reason``: first missing required field, unknown severity correction, or
    usefulness outside 1..5; NULL when accepted."""
    missing = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in FEEDBACK_FIELDS])
    useful = F.col("explanation_usefulness")
    reason = (
        F.when(missing.isNotNull(), F.concat(F.lit("missing required feedback key: "), missing))
        .when(~F.col("severity_correction").isin(*SEVERITY_CORRECTIONS), F.lit("invalid severity_correction"))
        .when((useful < 1) | (useful > 5), F.lit("explanation_usefulness out of range"))
    )
    return feedback.withColumn("reject_reason", reason)


def diagnosis_events(source: DataFrame, now: Column) -> DataFrame:
    """Diagnosis events (20 columns): given fields first, else what the recommendation offers, else defaults."""
    have = set(source.columns)
    text = F.lit("").cast("string")
    none_list = F.array().cast("array<string>")
    fallback: dict[str, Column | str] = {
        "diagnosis_id": "recommendation_id",
        "tenant_id": text,
        "asset_id": text,
        "component_id": text,
        "anomaly_event_id": "anomaly_id",
        "diagnosis_summary": "summary",
        "probable_causes": "possible_causes",
        "evidence": F.lit("{}"),
        "related_signals": none_list,
        "related_failure_modes": none_list,
        "recommended_checks": none_list,
        "suggested_action": text,
        "risk_level": F.lit("medium"),
        "confidence": F.lit(0.5),
        "escalation_required": F.lit(False),
        "quality_caveats": none_list,
        "generated_at": now,
        "agent_version": F.lit("agent.v1"),
        "prompt_version": F.lit("triage_prompt.v1"),
        "model_version": "model_name",
    }

    def value(name: str, other: Column | str) -> Column:
        if isinstance(other, str):
            rest = "fallback-rule-based" if name == "model_version" else ""
            empty = none_list if name == "probable_causes" else F.lit(rest)
            other = F.coalesce(F.col(other), empty) if other in have else empty
        return (F.coalesce(F.col(name), other) if name in have else other).alias(name)

    return source.select(*[value(n, o) for n, o in fallback.items()])
