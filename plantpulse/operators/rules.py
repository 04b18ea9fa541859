"""Rule table: which detector runs on which window, with which parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.operators import detectors as d
from plantpulse.operators.scope import in_force


# The shipped rules (profile, asset type, component type, metric, unit, rule,
# name, method, severity, parameters, owner).
RULES = (
    ("thr_manufacturing_rotating_temp", "cnc_machine", "motor", "temperature", "celsius", "threshold_spike",
     "CNC Motor Temperature Spike", "static_threshold", "critical",
     '{"multiplier": 2.5, "baseline_window_points": 24}', "reliability_engineering"),
    ("thr_manufacturing_rotating_vib", "conveyor", "bearing", "vibration", "mm_s", "rolling_zscore",
     "Conveyor Bearing Vibration Z-Score", "rolling_baseline_zscore", "warning",
     '{"window_points": 24, "zscore_threshold": 3.0}', "reliability_engineering"),
    ("thr_chemical_process_pressure", "reactor", "seal", "pressure", "bar", "drift_rate_of_change",
     "Reactor Pressure Drift Detection", "slope_over_window", "warning",
     '{"window_points": 36, "max_slope_per_hour": 0.8}', "process_safety"),
    ("thr_power_critical_vib", "turbine", "turbine_blade", "vibration", "mm_s", "threshold_spike",
     "Turbine Vibration Spike", "static_threshold", "critical",
     '{"multiplier": 2.0, "baseline_window_points": 48}', "reliability_engineering"),
    ("thr_water_treatment_flow", "lift_pump", "pump_impeller", "flow_rate", "m3_h", "missing_heartbeat",
     "Pump Missing Heartbeat Detection", "heartbeat_gap", "critical",
     '{"max_gap_minutes": 10}', "water_ops"),
    ("thr_generic_balanced_flatline", "motor", "motor", "temperature", "celsius", "flatline",
     "Motor Temperature Flatline", "repeated_value_window", "warning",
     '{"min_repeated_points": 6}', "reliability_engineering"),
)
_COLUMNS = (
    "profile_id asset_type component_type metric_name unit rule_id rule_name method severity parameters owner"
).split()


def shipped_rules(spark: SparkSession) -> DataFrame:
    """The six shipped rules; all of them scope to every tenant and are approved and active."""
    schema = ", ".join(f"{c} string" for c in _COLUMNS)
    return spark.createDataFrame(list(RULES), schema).select(
        "*",
        F.lit("*").alias("tenant_id"),
        F.lit("1.0.0").alias("version"),
        F.lit("approved").alias("approval_status"),
        F.lit("active").alias("status"),
        F.lit("2025-06-01 00:00:00").cast("timestamp_ntz").alias("effective_from"),
        F.lit(None).cast("timestamp_ntz").alias("effective_to"),
    )


def rules_per_tenant(rules: DataFrame, tenants: DataFrame) -> DataFrame:
    """One rule row per rule and tenant; the rule is known by its profile id.

    Every rule goes to every tenant, so the pairing is the result itself.
    ``tenants`` is keyed by tenant; the rule list rides along as one small array.
    """
    packed = rules.select(
        F.struct(
            F.col("profile_id").alias("rule_id"), "rule_name", "method", "asset_type", "component_type", "metric_name",
            "unit", "severity", "parameters", "approval_status", "status", "owner", "version",
        ).alias("r")
    ).agg(F.sort_array(F.collect_list("r")).alias("rules"))
    return tenants.select("tenant_id", F.explode(packed.scalar()).alias("r")).select("tenant_id", "r.*")


def parameter(name: str, default: float, params: str = "parameters") -> Column:
    """A numeric rule parameter out of the JSON text, or its default."""
    return F.coalesce(F.get_json_object(F.col(params), f"$.{name}").try_cast("double"), F.lit(default))


def apply_rules(
    features: DataFrame,
    rules: DataFrame,
    scope: tuple[str, ...] = (),
    as_of: Column | None = None,
) -> DataFrame:
    """Anomalies of every rule whose ``method`` equals the window's ``method``.

    ``scope`` names further columns that must agree (``*`` or NULL in a rule matches
    all); ``as_of`` keeps only approved, active rules in force.  The five methods are
    told apart row by row, so all rules share one pass over the features.
    """
    r = rules if as_of is None else in_force(rules, as_of)
    r = r.select(F.col("method").alias("_method"), "parameters", *[F.col(c).alias(f"_{c}") for c in scope])
    match = F.col("method") == F.col("_method")
    for c in scope:
        match = match & (F.col(f"_{c}").isNull() | (F.col(f"_{c}") == "*") | (F.col(f"_{c}") == F.col(c)))
    have = set(features.columns)
    upper = F.col("profile_critical_max") if "profile_critical_max" in have else None
    lower = F.col("profile_critical_min") if "profile_critical_min" in have else None
    given = F.col("baseline_value") if "baseline_value" in have else None
    verdicts = {
        "static_threshold": d.spike_verdict(parameter("multiplier", d.SPIKE_MULTIPLIER), upper, lower, given),
        "rolling_baseline_zscore": d.zscore_verdict(parameter("zscore_threshold", d.ZSCORE_LIMIT)),
        "slope_over_window": d.drift_verdict(parameter("max_slope_per_hour", d.MAX_SLOPE)),
        "repeated_value_window": d.flatline_verdict(parameter("min_repeated_points", d.FLATLINE_WINDOW_POINTS)),
        "heartbeat_gap": d.heartbeat_verdict(parameter("max_gap_minutes", d.MAX_GAP_MINUTES)),
    }

    def by_method(pick) -> Column:  # noqa: ANN001
        out = None
        for method, verdict in verdicts.items():
            cond = F.col("method") == method
            out = F.when(cond, pick(verdict)) if out is None else out.when(cond, pick(verdict))
        return out

    hits = features.join(r, match).filter(by_method(lambda v: v.hit))
    own_fault = d.resolve_fault_type(F.col("quality_flags"))
    return d.anomaly_rows(
        hits,
        by_method(lambda v: F.lit(v.rule_id)),
        severity=by_method(lambda v: F.lit(v.severity)),
        observed=by_method(lambda v: v.observed),
        baseline=by_method(lambda v: v.baseline),
        expected=by_method(lambda v: v.expected),
        breach_count=F.col("breach_count") if "breach_count" in have else F.lit(None),
        confidence=by_method(lambda v: v.confidence),
        fault_type=by_method(lambda v: own_fault if v.fault_type is None else v.fault_type),
        failure_mode=F.col("failure_mode_id") if "failure_mode_id" in have else None,
    )
