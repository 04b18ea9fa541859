"""Text building blocks: Python-style JSON text, list text, boolean words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _json_char(c: Column) -> Column:
    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))

    code = F.ascii(c)
    over = code - 0x10000
    pair = F.concat(unit(F.shiftright(over, 10) + 0xD800), unit(over.bitwiseAND(0x3FF) + 0xDC00))
    out = F.when(c == "\\", F.lit("\\\\")).when(c == '"', F.lit('\\"'))
    for char, short in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = out.when(c == char, F.lit(short))
    return out.when((code >= 32) & (code < 127), c).when(code < 0x10000, unit(code)).otherwise(pair)


def json_quote(col: Column) -> Column:
    """A JSON string literal in ASCII, or ``null``: other characters are escaped as ``\\uXXXX``, lower case."""
    text = col.cast("string")
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    spelled = F.array_join(F.transform(F.split(text, ""), _json_char), "")
    escaped = F.when(text.rlike(r"[^ -~]"), spelled).otherwise(plain)
    return F.when(col.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))


def spaced_json(**fields: Column) -> Column:
    """One JSON object with sorted keys and ``", "``/``": "`` separators, string values only."""
    parts = [F.concat(F.lit(f'"{name}": '), json_quote(fields[name])) for name in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def json_list(col: Column) -> Column:
    """An array of strings as JSON list text with ``", "`` separators."""
    quoted = F.transform(F.coalesce(col, F.array().cast("array<string>")), json_quote)
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def parse_list(col: Column) -> Column:
    """Tolerant list: JSON list text, else the text itself as the only item; empty text is an empty list."""
    empty = F.array().cast("array<string>")
    parsed = F.from_json(col, "array<string>")
    is_list = F.trim(col).startswith("[") & parsed.isNotNull()
    return (
        F.when(col.isNull() | col.isin("", "NULL"), empty)
        .when(is_list, parsed)
        .otherwise(F.array(col))
    )


def text_bool(col: Column) -> Column:
    """Boolean from the words the change feed uses; anything else is NULL."""
    word = F.lower(col)
    return (
        F.when(word.isin("true", "t", "1", "yes"), F.lit(True))
        .when(word.isin("false", "f", "0", "no"), F.lit(False))
        .otherwise(F.lit(None).cast("boolean"))
    )


def sorted_set(col: Column) -> Column:
    """Distinct items in order; NULL counts as empty."""
    return F.array_sort(F.array_distinct(F.coalesce(col, F.array().cast("array<string>"))))


def lookup(col: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """Value of a fixed table of at most a few dozen entries, as one map literal."""
    items: list[Column] = []
    for key, value in table.items():
        items += [F.lit(key), F.lit(value)]
    found = F.try_element_at(F.create_map(*items), col)
    return found if default is None else F.coalesce(found, default)
