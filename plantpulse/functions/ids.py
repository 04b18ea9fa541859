"""Deterministic identifiers: a hash prefix of the ``|``-joined key parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Part = Column | str


def key_text(*parts: Part) -> Column:
    """Join key parts with ``|``; a missing part counts as empty text, never as absent."""
    cols = [p if isinstance(p, Column) else F.col(p) for p in parts]
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def sha1_id(prefix: str, text: Column, length: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(text), 1, length))


def sha256_id(prefix: str, text: Column, length: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, length))


def anomaly_id(rule: Part, start: Column, end: Column) -> Column:
    """Identifier of an anomaly from its rule, series and window bounds (ISO text)."""
    rule_col = rule if isinstance(rule, Column) else F.lit(rule)
    return sha256_id("anom_", key_text(rule_col, "tenant_id", "asset_id", "tag_id", "metric_name", start, end))


def evidence_id(version: str = "triage_evidence.v1") -> Column:
    return sha1_id("ev_", key_text("tenant_id", "anomaly_id", F.lit(version)))


def recommendation_id(version: Column) -> Column:
    return sha1_id("rec_", key_text("tenant_id", "anomaly_id", version))


def quarantine_id() -> Column:
    return sha1_id("qn_", key_text("tenant_id", "anomaly_id", F.lit("quarantine")))


def caveat_event_id() -> Column:
    return sha1_id("qe_", key_text("tenant_id", "anomaly_id", F.lit("quality_caveats")))
