"""Contract validation of JSON log lines against a JSON Schema (2020-12 subset).

The contract is compiled into column expressions over one parsed VARIANT value:
``required``, ``additionalProperties``, ``type``, ``const``, ``enum``, ``pattern``,
``minLength``, ``minimum``, ``maximum``, ``minItems``, ``maxItems``, ``uniqueItems``, ``items`` and nested
``properties``, to any depth.  All of it is narrow, so it runs in batch and in streams.

Lines are checked in two phases.  The first accepts: the kinds of all fields, as one text, must match one
pattern made from the contract, and fields with values to keep to are looked up.  Only lines that it cannot
accept are taken apart field by field, for every error they have.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.functions.once import computed_once

ERROR = "struct<field_path:string,error_code:string,message:string>"
_MAP = "map<string,variant>"

# The contract of a raw reading.
_SCENARIOS = (
    "normal late missing_heartbeat flatline spike drift startup steady_load high_load idle warning critical "
    "degradation failure maintenance shutdown invalid_event"
).split()
RAW_READING = {
    "title": "raw_sensor_event",
    "type": "object",
    "additionalProperties": False,
    "required": (
        "event_id schema_version tenant_id tag_id tag_name event_time ingest_time value unit source_system quality_flags"
    ).split(),
    "properties": {
        "event_id": {"type": "string", "minLength": 1},
        "schema_version": {"type": "string", "const": "raw_sensor_event.v1"},
        "tenant_id": {"type": "string", "pattern": "^tenant_[a-z0-9_]+$"},
        "tag_id": {"type": "string", "pattern": "^tag_[a-z0-9_]+$"},
        "tag_name": {"type": "string", "minLength": 1},
        "event_time": {"type": "string", "format": "date-time", "pattern": "Z$"},
        "ingest_time": {"type": "string", "format": "date-time", "pattern": "Z$"},
        "value": {"type": "number"},
        "unit": {"type": "string", "enum": ["celsius", "mm_s", "bar", "m3_h", "kw", "ampere", "rpm", "db"]},
        "source_system": {"type": "string", "enum": ["opc_ua", "scada", "historian", "bms"]},
        "quality_flags": {"type": "array", "items": {"type": "string"}, "uniqueItems": True},
        "scenario": {"type": "string", "enum": _SCENARIOS},
        "synthetic_metadata": {
            "type": "object",
            "additionalProperties": True,
            "properties": {
                "generator_version": {"type": "string"},
                "scenario": {"type": "string", "enum": _SCENARIOS},
                "seed_asset_index": {"type": "integer"},
            },
        },
    },
}

# The contract of a dead-letter record.
_TEXT = {"type": "string"}
_FILLED = {"type": "string", "minLength": 1}
DEAD_LETTER = {
    "title": "dlq_record",
    "type": "object",
    "additionalProperties": False,
    "required": ["original_record", "error_code", "field_path", "message", "schema_name", "schema_version", "validation_time"],
    "properties": {
        "original_record": {"type": ["object", "null"]},
        "error_code": _FILLED,
        "field_path": _FILLED,
        "message": _FILLED,
        "schema_name": _FILLED,
        "schema_version": _FILLED,
        "validation_time": {"type": "string", "format": "date-time", "pattern": "Z$"},
        "all_errors": {
            "type": "array",
            "items": {
                "type": "object",
                "additionalProperties": False,
                "required": ["error_code", "field_path", "message"],
                "properties": {"error_code": _TEXT, "field_path": _TEXT, "message": _TEXT},
            },
        },
    },
}

# The contract of a work order.
WORK_ORDER = {
    "title": "work_order",
    "type": "object",
    "additionalProperties": False,
    "required": ["schema_version", "work_order_id", "tenant_id", "asset_id", "work_type", "priority", "created_at", "status"],
    "properties": {
        "schema_version": {"type": "string", "const": "work_order.v1"},
        "work_order_id": _TEXT,
        "tenant_id": _TEXT,
        "asset_id": _TEXT,
        "component_id": _TEXT,
        "failure_mode_id": _TEXT,
        "anomaly_id": _TEXT,
        "incident_id": _TEXT,
        "work_type": {"type": "string", "enum": ["corrective", "preventive", "predictive", "inspection", "emergency", "calibration"]},
        "priority": {"type": "string", "enum": ["low", "medium", "high", "emergency"]},
        "problem_code": _TEXT,
        "cause_code": _TEXT,
        "remedy_code": _TEXT,
        "technician_notes": _TEXT,
        "downtime_minutes": {"type": "number", "minimum": 0},
        "parts_used": {
            "type": "array",
            "items": {"type": "object", "properties": {"part_number": _TEXT, "part_name": _TEXT, "quantity": {"type": "integer"}}},
        },
        "inspection_results": {
            "type": "object",
            "properties": {
                "inspection_type": {"type": "string", "enum": ["visual", "thermal", "vibration_analysis", "oil_analysis", "ultrasound", "ndt"]},
                "findings": _TEXT,
                "severity": {"type": "string", "enum": ["normal", "degraded", "action_required", "critical"]},
                "measurements": {"type": "object", "additionalProperties": {"type": "number"}},
            },
        },
        "source_system": {"type": "string", "enum": ["cmms", "eam", "manual", "apm_triage"]},
        "created_at": {"type": "string", "format": "date-time"},
        "completed_at": {"type": "string", "format": "date-time"},
        "status": {"type": "string", "enum": ["open", "in_progress", "pending_parts", "completed", "cancelled"]},
    },
}

_KINDS = {
    "string": "^STRING$",
    "number": "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)",
    "integer": "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL\\(\\d+,0\\))",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY",
    "object": "^OBJECT",
    "null": "^VOID$",
}


#: Keywords that change nothing here, and those that the checks know.
_NOTES = {"$schema", "$id", "title", "description"}
_CHECKED = {
    "type", "const", "enum", "pattern", "format", "minLength", "minimum", "maximum", "minItems", "maxItems", "uniqueItems",
    "items", "properties", "required", "additionalProperties",
}


def check_contract(contract: dict[str, Any], path: str = "") -> None:
    """Refuse a contract with a keyword that the checks would pass over."""
    unknown = set(contract) - _NOTES - _CHECKED
    if unknown:
        raise ValueError(f"contract keywords not supported at {path or '/'}: {', '.join(sorted(unknown))}")
    below = {**contract.get("properties", {}), **{k: contract[k] for k in ("items", "additionalProperties") if k in contract}}
    for name, rule in below.items():
        if not isinstance(rule, bool):
            check_contract(rule, f"{path}/{name}")


def _types(rule: dict[str, Any]) -> list[str]:
    return rule["type"] if isinstance(rule["type"], list) else [rule["type"]]


def contract_errors(lines: DataFrame, contract: dict[str, Any] = RAW_READING, value: str = "value") -> DataFrame:
    """Lines with ``errors`` (sorted by path, code, message; empty when valid) and the first
    of them as ``error_code`` / ``field_path`` / ``message``.

    A contract with keywords that are not supported is refused. Each line is parsed once.  Fields, their kinds and their texts become columns of
    their own, so that the checks only read them.
    """
    check_contract(contract)
    out = lines.withColumn("_doc", F.try_parse_json(F.col(value)))
    out = out.withColumn("_kind", F.schema_of_variant(F.col("_doc")))
    out = computed_once(out, _texts=_texts(contract))
    out = computed_once(out, _fine=_accepted(contract)).drop("_texts")
    # what follows finds nothing to do in a line accepted here
    is_object = F.col("_kind").rlike(_KINDS["object"])
    out = out.withColumn("_map", F.when(~F.col("_fine") & is_object, F.try_variant_get("_doc", "$", _MAP)))
    out, found = _object_checks(out, "_map", contract, "")
    errors = (
        F.when(F.col("_fine"), _none())
        .when(F.col("_doc").isNull(), F.array(_error("/", "invalid_json", F.lit("Invalid JSON"))))
        .when(~is_object, F.array(_error("/", "invalid_json", F.lit("JSONL record must be an object"))))
        .otherwise(F.sort_array(F.array_compact(F.concat(*found))))
    )
    out = computed_once(out, errors=errors).select(*lines.columns, "errors")
    first = F.try_element_at(F.col("errors"), F.lit(1))
    return out.withColumns(
        {"error_code": first["error_code"], "field_path": first["field_path"], "message": first["message"]}
    )


def contract_split(
    lines: DataFrame, contract: dict[str, Any] = RAW_READING, value: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``; rejected lines keep the original text and every error."""
    checked = contract_errors(lines, contract, value)
    keep = [c for c in lines.columns]
    accepted = checked.filter(F.size("errors") == 0).select(*keep)
    rejected = checked.filter(F.size("errors") > 0).select(
        *[c for c in keep if c != value],
        F.col(value).alias("original_record"),
        "error_code",
        "field_path",
        "message",
        F.lit(contract["title"]).alias("schema_name"),
        F.lit(contract["properties"]["schema_version"]["const"]).alias("schema_version"),
        F.col("errors").alias("all_errors"),
    )
    return accepted, rejected


def contract_summary(lines: DataFrame, contract: dict[str, Any] = RAW_READING, value: str = "value") -> DataFrame:
    """Long-format totals: ``total_records``, ``accepted_records``, ``rejected_records`` and one
    ``errors:<code>`` row per code.  One pass over the lines; totals of zero are listed, and
    empty input has the row ``errors:no_input_records``."""
    checked = contract_errors(lines, contract, value).select("errors")
    rejected = F.size("errors") > 0
    codes = F.transform(F.col("errors"), lambda e: F.concat(F.lit("errors:"), e["error_code"]))
    counted = F.concat(
        F.array(F.lit("total_records"), F.when(rejected, F.lit("rejected_records")).otherwise(F.lit("accepted_records"))),
        codes,
    )
    found = checked.select(F.explode(counted).alias("measure"), F.lit(1).alias("n"))
    always = F.array(*[F.lit(m) for m in ("total_records", "accepted_records", "rejected_records", "errors:no_input_records")])
    zeros = lines.sparkSession.range(1).select(F.explode(always).alias("measure"), F.lit(0).alias("n"))
    totals = found.union(zeros).groupBy("measure").agg(F.sum("n").alias("n"))
    empty = F.max(F.when(F.col("measure") == "total_records", F.col("n"))).over(Window.partitionBy()) == 0  # a few rows
    is_empty_row = F.col("measure") == "errors:no_input_records"
    totals = totals.withColumn("_empty", empty).filter(~is_empty_row | F.col("_empty"))
    totals = totals.select("measure", F.when(is_empty_row, F.lit(1)).otherwise(F.col("n")).alias("n"))
    return totals.withColumn("schema_checked", F.lit(f"{contract['title']}.schema.json"))


def _error(path: str | Column, code: str, message: Column) -> Column:
    path_col = path if isinstance(path, Column) else F.lit(path)
    return F.struct(
        path_col.alias("field_path"), F.lit(code).alias("error_code"), message.alias("message")
    ).cast(ERROR)


def _none() -> Column:
    return F.array().cast(f"array<{ERROR}>")


def _accepted(contract: dict[str, Any]) -> Column:
    """Certainly valid, judged by the kinds of ``_doc``'s fields as one text and by the texts of fields with values to keep to.

    False says nothing: a contract with open properties, and lines with fields that need a closer look.
    """
    properties = contract.get("properties", {})
    patterns = {name: _kind_pattern(rule) for name, rule in properties.items()}
    required = set(contract.get("required", []))
    if contract.get("additionalProperties") is not False or any(patterns.get(name) is None for name in required):
        return F.lit(False)
    fields = [f"(?:{re.escape(name)}: {patterns[name]}, )" + ("" if name in required else "?") for name in sorted(patterns) if patterns[name]]
    inside = F.concat(F.substr(F.col("_kind"), F.lit(8), F.length("_kind") - 8), F.lit(", "))
    fits = [F.col("_kind").rlike(_KINDS["object"]), inside.rlike(f"^{''.join(fields)}$")]
    fits.append(F.col("_texts").isNotNull())
    for name, rule in properties.items():
        if patterns[name]:
            fits += _value_fits(F.col("_texts")[name], rule)
    return F.coalesce(reduce(and_, fits), F.lit(False))


def _texts(contract: dict[str, Any]) -> Column:
    """The fields with values to keep to as one struct of texts and lists of texts: one walk over the line."""
    said = {"const", "enum", "pattern", "minLength", "minimum", "maximum"}
    rules = {n: r for n, r in contract.get("properties", {}).items() if _kind_pattern(r) and (said & set(r) or "array" in _types(r))}
    fields = ", ".join(f"`{n}`: {'array<string>' if 'array' in _types(r) else 'string'}" for n, r in rules.items())
    return F.try_variant_get("_doc", "$", f"struct<{fields or '_: string'}>")


def _kind_pattern(rule: dict[str, Any]) -> str | None:
    """What schema_of_variant may say of a value of this rule; None where that is not enough to accept it."""
    kinds = {
        "string": "STRING",
        "number": "(?:TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL\\(\\d+,\\d+\\))",
        "integer": "(?:TINYINT|SMALLINT|INT|BIGINT|DECIMAL\\(\\d+,0\\))",
        "boolean": "BOOLEAN",
        "null": "VOID",
        "array": "ARRAY<(?:VOID|STRING)>",
    }
    types = _types(rule) if "type" in rule else []
    if not types or not set(types) <= set(kinds) or ("array" in types and rule.get("items") != {"type": "string"}):
        return None
    return f"(?:{'|'.join(kinds[t] for t in types)})"


def _value_fits(value: Column, rule: dict[str, Any]) -> list[Column]:
    """The value (of :func:`_texts`) is missing or keeps to the rule; its kind is known to."""
    fits: list[Column] = []
    if "const" in rule:
        fits.append(value == rule["const"])
    if "enum" in rule:
        fits.append(value.isin(*rule["enum"]))
    if "pattern" in rule:
        fits.append(value.rlike(rule["pattern"]))
    if "minLength" in rule:
        fits.append(F.length(value) >= rule["minLength"])
    if "minimum" in rule:
        fits.append(value.try_cast("double") >= rule["minimum"])
    if "maximum" in rule:
        fits.append(value.try_cast("double") <= rule["maximum"])
    fits = [F.coalesce(c, F.lit(True)) for c in fits]
    if "array" in _types(rule):
        size = F.size(value)
        if rule.get("uniqueItems"):
            fits.append(F.coalesce(F.size(F.array_distinct(value)) == size, F.lit(True)))
        # a NULL among texts does not show in the kind
        fits.append(F.coalesce(size.between(rule.get("minItems", 0), rule.get("maxItems", 2**31 - 1)), F.lit(True)))
        fits.append(F.coalesce(F.array_position(F.transform(value, F.isnull), F.lit(True)) == 0, F.lit(True)))
    return fits


def _object_checks(df: DataFrame, map_col: str, contract: dict[str, Any], path: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with the object's field columns, and the arrays of (possibly null) errors they give."""
    properties = contract.get("properties", {})
    names = {p: f"_v{path}/{p}" for p in properties}
    df = df.withColumns({v: F.try_element_at(F.col(map_col), F.lit(p)) for p, v in names.items()})
    df = df.withColumns({f"{v}:kind": F.schema_of_variant(F.col(f"`{v}`")) for v in names.values()})
    df = df.withColumns({f"{v}:text": F.try_variant_get(F.col(f"`{v}`"), "$", "string") for v in names.values()})
    found = _own_errors(F.col(map_col), contract, F.lit(path))
    for name, rule in properties.items():
        found += _field_checks(names[name], rule, f"{path}/{name}")
        if {"properties", "required", "additionalProperties"} & set(rule):
            v, nested_map = names[name], f"_m{path}/{name}"
            is_object = F.col(f"`{v}:kind`").rlike(_KINDS["object"])
            df = df.withColumn(nested_map, F.when(is_object, F.try_variant_get(F.col(f"`{v}`"), "$", _MAP)))
            df, nested = _object_checks(df, nested_map, rule, f"{path}/{name}")
            found += [F.coalesce(n, _none()) for n in nested]
    return df, found


def _field_checks(column: str, rule: dict[str, Any], path: str) -> list[Column]:
    return _checks(F.col(f"`{column}`"), F.col(f"`{column}:kind`"), F.col(f"`{column}:text`"), rule, F.lit(path))


def _checks(v: Column, kind: Column, text: Column, rule: dict[str, Any], path: Column) -> list[Column]:
    """Arrays of (possibly null) errors of one value; its own fields apart."""
    is_text = kind == "STRING"
    # a value as messages show it: text in single quotes, anything else as JSON
    shown = F.when(is_text, F.concat(F.lit("'"), text, F.lit("'"))).otherwise(text)
    single: list[Column] = []

    def check(broken: Column, code: str, message: Column) -> None:
        single.append(F.when(v.isNotNull() & broken, _error(path, code, message)))

    if "type" in rule:
        named = ", ".join(f"'{t}'" for t in _types(rule))
        fits = kind.rlike("|".join(f"({_KINDS[t]})" for t in _types(rule)))
        check(~fits, "invalid_type", F.concat(shown, F.lit(f" is not of type {named}")))
    if "const" in rule:
        check(~is_text | (text != rule["const"]), "invalid_value", F.lit(f"'{rule['const']}' was expected"))
    if "enum" in rule:
        listed = json.dumps(rule["enum"]).replace('"', "'")
        check(~is_text | ~text.isin(*rule["enum"]), "invalid_value", F.concat(shown, F.lit(f" is not one of {listed}")))
    if "pattern" in rule:
        message = F.concat(shown, F.lit(f" does not match '{rule['pattern']}'"))
        check(is_text & ~text.rlike(rule["pattern"]), "invalid_format", message)
    if "minLength" in rule:
        short = F.lit(" should be non-empty") if rule["minLength"] == 1 else F.lit(" is too short")
        check(is_text & (F.length(text) < rule["minLength"]), "schema_validation_error", F.concat(shown, short))
    number = text.try_cast("double")
    is_number = kind.rlike(_KINDS["number"])
    if "minimum" in rule:
        message = F.concat(shown, F.lit(f" is less than the minimum of {rule['minimum']}"))
        check(is_number & (number < rule["minimum"]), "invalid_value", message)
    if "maximum" in rule:
        message = F.concat(shown, F.lit(f" is greater than the maximum of {rule['maximum']}"))
        check(is_number & (number > rule["maximum"]), "invalid_value", message)
    items = F.try_variant_get(v, "$", "array<variant>")
    if "minItems" in rule:
        few = F.lit(" should be non-empty") if rule["minItems"] == 1 else F.lit(" is too short")
        check(F.coalesce(F.size(items) < rule["minItems"], F.lit(False)), "schema_validation_error", F.concat(shown, few))
    if "maxItems" in rule:
        many = F.lit(" is expected to be empty") if rule["maxItems"] == 0 else F.lit(" is too long")
        check(F.coalesce(F.size(items) > rule["maxItems"], F.lit(False)), "schema_validation_error", F.concat(shown, many))
    if rule.get("uniqueItems"):
        texts = F.transform(items, lambda i: F.to_json(i))
        message = F.concat(shown, F.lit(" has non-unique elements"))
        check(F.size(F.array_distinct(texts)) < F.size(texts), "schema_validation_error", message)
    found = [F.array(*single)] if single else []
    if _says_something(rule.get("items", {})):
        each = F.transform(items, lambda i, n: F.concat(*_value_errors(i, rule["items"], F.concat(path, F.lit("/"), n.cast("string")))))
        found.append(F.coalesce(F.flatten(each), _none()))
    return found


def _says_something(rule: dict[str, Any] | bool) -> bool:
    return not isinstance(rule, bool) and bool(set(rule) - _NOTES)


def _value_errors(v: Column, rule: dict[str, Any], path: Column) -> list[Column]:
    """Arrays of errors of a value and all below it, as expressions only, so that they can stand in a lambda."""
    kind = F.schema_of_variant(v)
    found = _checks(v, kind, F.try_variant_get(v, "$", "string"), rule, path)
    if {"properties", "required", "additionalProperties"} & set(rule):
        fields = F.when(kind.rlike(_KINDS["object"]), F.try_variant_get(v, "$", _MAP))
        found += [F.coalesce(x, _none()) for x in _own_errors(fields, rule, path)]
        for name, below in rule.get("properties", {}).items():
            found += _value_errors(F.try_element_at(fields, F.lit(name)), below, F.concat(path, F.lit(f"/{name}")))
    return found or [_none()]


def _own_errors(fields: Column, rule: dict[str, Any], path: Column) -> list[Column]:
    """Errors of an object's field names, and of the values of fields that only a general rule knows."""
    keys, found = F.map_keys(fields), []
    properties = F.array(*[F.lit(p) for p in rule.get("properties", {})]).cast("array<string>")
    if rule.get("required"):
        # every "required" error points at the first missing field in contract order, without what stands above it
        missing = F.array_except(F.array(*[F.lit(r) for r in rule["required"]]), keys)
        first = F.concat(F.lit("/"), F.try_element_at(missing, F.lit(1)))
        found.append(
            F.transform(
                missing,
                lambda m: _error(first, "missing_required_field", F.concat(F.lit("'"), m, F.lit("' is a required property"))),
            )
        )
    more = rule.get("additionalProperties", True)
    extra = F.array_except(keys, properties)
    if more is False:
        quoted = F.array_join(F.transform(extra, lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", ")
        verb = F.when(F.size(extra) > 1, F.lit(" were unexpected)")).otherwise(F.lit(" was unexpected)"))
        message = F.concat(F.lit("Additional properties are not allowed ("), quoted, verb)
        at = F.coalesce(F.nullif(path, F.lit("")), F.lit("/"))
        found.append(F.array(F.when(F.size(extra) > 0, _error(at, "unexpected_field", message))))
    elif _says_something(more):
        each = F.transform(extra, lambda k: F.concat(*_value_errors(F.try_element_at(fields, k), more, F.concat(path, F.lit("/"), k))))
        found.append(F.flatten(each))
    return found
