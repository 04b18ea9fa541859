"""Time helpers that keep the caller's timestamp type (with or without zone)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AsOf = datetime | str | Column | DataFrame


def as_of_column(as_of: AsOf) -> Column:
    """An ``as_of`` instant as a column.

    A literal is pushed into the scan as is.  A one-row, one-column DataFrame
    becomes a scalar subquery, so ``max(event_time)`` never visits the driver.
    """
    if isinstance(as_of, DataFrame):
        return as_of.scalar()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, datetime):
        as_of = as_of.isoformat(sep=" ")
    return F.lit(as_of).cast("timestamp_ntz")


def since(time_col: Column | str, as_of: AsOf, lookback: str) -> Column:
    """``time >= as_of - lookback``; a bare comparison, so it can reach the scan."""
    col = F.col(time_col) if isinstance(time_col, str) else time_col
    return col >= as_of_column(as_of) - F.expr(f"INTERVAL {lookback}")


def with_bucket(df: DataFrame, time_col: str, width: str, out: str) -> DataFrame:
    """Add the start of the tumbling bucket that holds ``time_col`` (e.g. ``"15 minutes"``)."""
    return df.withColumn(out, F.window(F.col(time_col), width)["start"])


def iso_z(col: Column | str) -> Column:
    """ISO-8601 UTC text ending in ``Z``; the fraction is written only when it is not zero."""
    c = F.col(col) if isinstance(col, str) else col
    text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.regexp_replace(text, r"\.000000Z$", "Z")


def parse_iso(col: Column | str) -> Column:
    """Wire text to a zone-less UTC timestamp; text that cannot be read gives NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.regexp_replace(c, "Z$", ""), "T", " ").try_cast("timestamp_ntz")


def whole_seconds(start: Column | str, end: Column | str) -> Column:
    """Whole seconds from ``start`` to ``end``, cut towards zero."""
    return F.timestamp_diff("SECOND", _c(start), _c(end))


def seconds(start: Column | str, end: Column | str) -> Column:
    """Seconds with fraction from ``start`` to ``end``."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / F.lit(1000000.0)


def epoch_seconds(col: Column | str) -> Column:
    return F.unix_seconds(_c(col).cast("timestamp"))


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col
