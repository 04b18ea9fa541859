"""Ordered work on long series without sending a whole series to one task.

A series is one (tenant, asset, tag, metric).  One of them may hold a large share of
all rows, so ordered frames run inside time chunks of a series.  Rows just before a
chunk are copied into it (the halo), which makes row frames at the chunk's start exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.functions.joins import join_same
from plantpulse.functions.times import epoch_seconds, with_bucket
from plantpulse.operators.latest import latest_n

SERIES = ("tenant_id", "asset_id", "tag_id", "metric_name")
ORDER = ("event_time", "event_id")


def busy_series(
    df: DataFrame, keys: Sequence[str] = SERIES, time_col: str = "event_time", target_rows: int = 1_000_000
) -> DataFrame:
    """Series with more than ``target_rows`` rows and the chunk width (seconds) that keeps their
    busiest hour at about ``target_rows`` rows per chunk.  Counts are combined map-side."""
    hourly = with_bucket(df, time_col, "1 hour", "_hour").groupBy(*keys, "_hour").agg(F.count(F.lit(1)).alias("_n"))
    per_series = hourly.groupBy(*keys).agg(F.sum("_n").alias("_rows"), F.max("_n").alias("_peak"))
    width = F.greatest(F.lit(1), F.floor(F.lit(3600.0 * target_rows) / F.col("_peak"))).cast("bigint")
    return per_series.filter(F.col("_rows") > target_rows).select(*keys, width.alias("_width"))


def with_chunks(
    df: DataFrame,
    keys: Sequence[str] = SERIES,
    time_col: str = "event_time",
    target_rows: int = 1_000_000,
) -> tuple[DataFrame, DataFrame]:
    """``(df with _chunk, busy series)``.  Series below ``target_rows`` have the single chunk 0.

    The list of busy series can hold at most ``rows / target_rows`` entries and is broadcast: the rows are
    neither shuffled nor sorted for it, but once, by series and chunk, for what follows.  Keys may be NULL.
    """
    busy = busy_series(df, keys, time_col, target_rows)
    chunk = F.coalesce(F.floor(epoch_seconds(time_col) / F.col("_width")), F.lit(0)).cast("bigint")
    return join_same(df, busy, keys, "left", small=True).withColumn("_chunk", chunk), busy


def with_halo(
    df: DataFrame,
    rows_before: int,
    keys: Sequence[str] = SERIES,
    order: Sequence[str] = ORDER,
    target_rows: int = 1_000_000,
) -> DataFrame:
    """Rows with ``_chunk`` and ``_halo``: each chunk also receives the ``rows_before`` rows that
    precede it in its series, marked ``_halo = true``.

    Only the last rows of each chunk can precede another chunk, so the series-wide
    window sees ``rows_before`` rows per chunk, not the series.
    """
    columns = df.columns
    chunked, _ = with_chunks(df, keys, order[0], target_rows)
    own = chunked.select(*columns, "_chunk", F.lit(False).alias("_halo"))
    split = chunked.filter(F.col("_width").isNotNull())
    tails = latest_n(split, [*keys, "_chunk"], order, rows_before)
    series = Window.partitionBy(*keys).orderBy(*order)
    others = [c for c in columns if c not in keys]
    starts = (
        tails.withColumn("_previous", F.lag("_chunk").over(series))
        .withColumn("_before", F.collect_list(F.struct(*others)).over(series.rowsBetween(-rows_before, -1)))
        .filter(F.col("_previous") != F.col("_chunk"))
    )
    halo = (
        starts.select(*keys, "_chunk", F.explode("_before").alias("_row"))
        .select(*keys, *[F.col("_row")[c].alias(c) for c in others], "_chunk", F.lit(True).alias("_halo"))
        .select(*columns, "_chunk", "_halo")
    )
    return own.unionByName(halo)


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    time_col: str,
    counted: Column | None = None,
    cell: str = "1 minute",
    name: str = "position",
) -> DataFrame:
    """Running count along each series (1-based for counted rows) without a series-wide window.

    Rows are counted per time cell, the cell counts are summed along the series, and the
    running count inside a cell is added.  ``counted`` selects the rows that advance the
    count; other rows get the count so far.
    """
    counted = F.lit(True) if counted is None else counted
    cells = with_bucket(df, time_col, cell, "_cell")
    totals = cells.groupBy(*keys, "_cell").agg(F.count_if(counted).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cells.join(totals, [*keys, "_cell"])
        .withColumn(name, F.col("_offset") + F.count_if(counted).over(inside))
        .drop("_cell", "_offset")
    )


def mark_busy(df: DataFrame, keys: Sequence[str], target_rows: int) -> DataFrame:
    """``_busy`` is true for keys of more than ``target_rows`` rows, else NULL.

    There are at most rows / target_rows such keys, so their list is broadcast: by a shuffle of the rows for
    this join a busy key would come to one task.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    busy = counts.filter(F.col("_n") > target_rows).select(*keys, F.lit(True).alias("_busy"))
    return join_same(df, busy, keys, "left", small=True)


def with_ranges(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], target_rows: int = 1_000_000, ranges: int = 1024, name: str = "_range"
) -> DataFrame:
    """Number the range of ``order`` each row falls in inside its key, ascending, NULLs first.

    Keys of at most ``target_rows`` rows have the single range 0.  The rows of the others are cut into about
    ``ranges`` ranges of like size in all, so that no key makes a range large (rows equal in key and order
    share one).  The bounds are the rows of the smallest hashes, in one sorted array that every task reads (a
    scalar subquery); where they fall changes the ranges' sizes only, never a result.  Keys may be NULL.
    """
    step = max(1, int(ranges**0.5))
    key = F.struct(*[F.col(c) for c in (*keys, *order)])
    marked = mark_busy(df, keys, target_rows)
    some = marked.filter("_busy").select(key.alias("key")).orderBy(F.xxhash64("key"), "key").limit(ranges)
    fine = some.agg(F.array_sort(F.collect_set("key")).alias("fine"))
    bounds = fine.select(F.struct("fine", F.filter("fine", lambda _, i: i % step == 0).alias("coarse")).alias("bounds")).scalar()

    def below(some: Column) -> Column:
        """How many of some bounds are less than the row's key (higher-order functions take no subquery)."""
        return F.array_position(F.sort_array(F.array_append(some, key)), key) - 1

    # two searches among about the root of ``ranges`` bounds each
    skipped = (below(bounds["coarse"]) - 1).cast("int") * step
    inside = below(F.slice(bounds["fine"], skipped + 1, F.lit(step)))
    number = F.when(F.col("_busy").isNull() | (skipped < 0), F.lit(0)).otherwise(skipped + inside)
    return marked.withColumn(name, number.cast("int")).drop("_busy")


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, percent: int, name: str, target_rows: int = 100_000) -> DataFrame:
    """Per key the smallest value with at least ``percent`` per cent of the values at or below it; NULLs do not count.

    Rows are counted per key and range of values, the counts say in which range the rank lies, and only
    that range's values are put in order: no task or buffer holds a busy key's values.  Keys may be NULL.
    """
    ranged = with_ranges(df.select(*keys, value).filter(F.col(value).isNotNull()), keys, [value], target_rows)
    cells = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    line = Window.partitionBy(*keys).orderBy("_range")
    until = F.sum("_n").over(line)
    total = F.sum("_n").over(Window.partitionBy(*keys))
    cells = cells.withColumns({"_until": until, "_rank": F.ceil(total * percent / 100).cast("bigint")})
    lies = (F.col("_until") >= F.col("_rank")) & (F.col("_until") - F.col("_n") < F.col("_rank"))
    cells = cells.filter(lies).select(*keys, "_range", (F.col("_rank") - F.col("_until") + F.col("_n")).alias("_want"))
    inside = Window.partitionBy(*keys, "_range").orderBy(value)
    found = join_same(ranged, cells, [*keys, "_range"]).withColumn("_at", F.row_number().over(inside))
    return found.filter(F.col("_at") == F.col("_want")).select(*keys, F.col(value).alias(name))


def as_of_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    at: str,
    right_at: str,
    ties: Sequence[str],
    name: str,
    cell: str = "1 day",
) -> DataFrame:
    """``left`` with ``name``: the newest row of ``right`` of its keys at or before ``at``, as a struct; NULL where there is none."""
    return as_of_joins(left, [(right, right_at, ties, name)], keys, at, cell)


def as_of_joins(
    left: DataFrame,
    rights: Sequence[tuple[DataFrame, str, Sequence[str], str]],
    keys: Sequence[str],
    at: str,
    cell: str = "1 day",
) -> DataFrame:
    """:func:`as_of_join` with several tables at once; each is given as ``(right, right_at, ties, name)``.

    The newest is the last by (``right_at``, ``ties``).  Of a right side only what can be found goes on: nothing behind
    the last ``at``, per key one row of all up to the first ``at`` and one per instant between them, picked before
    anything is shuffled.  Then all sides are merged into one line per key, cut into time
    cells: the newest rows per cell come first, a running maximum over a key's cells, then the last rows carried
    along inside each cell.  Neither a key nor a pair of rows is ever held together, so a key may have any number
    of rows on either side.  A NULL key or time finds nothing.  ``left`` is read four times, however many tables
    there are; joins one behind the other would read it four times each.
    """
    bounds = F.broadcast(left.agg(F.min(at).alias("_first"), F.max(at).alias("_last")))  # one row
    held = [f"_row{i}" for i in range(len(rights))]
    sides, kinds = [], []
    for right, right_at, ties, _ in rights:
        row = F.struct(*[F.col(c) for c in (right_at, *ties)], *[F.col(c) for c in right.columns if c not in (right_at, *ties, *keys)])
        kinds.append(right.select(row.alias("row")).schema["row"].dataType.simpleString())
        seen = right.select(F.struct(*keys).alias("_key"), F.col(right_at).alias("_at"), row.alias("_row"))
        seen = seen.join(bounds, F.col("_at") <= F.col("_last")).withColumn("_at", F.greatest("_at", "_first"))
        sides.append(seen.groupBy("_key", "_at").agg(F.max("_row").alias("_row")))

    def none(i: int) -> Column:
        return F.lit(None).cast(kinds[i])

    line = left.filter(F.col(at).isNotNull()).select(
        F.struct(*keys).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"),
        *[none(i).alias(h) for i, h in enumerate(held)],
    )
    whole = line.schema["_left"].dataType
    for i, side in enumerate(sides):
        line = line.union(side.select(
            "_key", "_at", F.lit(0).alias("_side"), F.lit(None).cast(whole).alias("_left"),
            *[(F.col("_row") if j == i else none(j)).alias(h) for j, h in enumerate(held)],
        ))
    # nothing is filtered out here, but both uses of the sides stay alike and share what was shuffled for them
    line = with_bucket(line, "_at", cell, "_cell").filter("_cell IS NOT NULL")
    tops = line.groupBy("_key", "_cell").agg(*[F.max(h).alias(h) for h in held])
    before = Window.partitionBy("_key").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_key", "_cell", *[F.max(h).over(before).alias(f"_earlier{h}") for h in held])
    # rows of the right sides first among those of one instant, the last of each in front of the left side's
    inside = Window.partitionBy("_key", "_cell").orderBy("_at", "_side", *held).rowsBetween(Window.unboundedPreceding, 0)
    carried = [F.coalesce(F.last(h, ignorenulls=True).over(inside), F.col(f"_earlier{h}")).alias(f"_found{h}") for h in held]
    met = line.join(tops, ["_key", "_cell"]).select("_left", "_side", *carried).filter("_side = 1")
    known = F.lit(True)
    for k in keys:
        known = known & F.col(f"_left.{k}").isNotNull()
    names = [name for *_, name in rights]
    out = met.select("_left.*", *[F.when(known, F.col(f"_found{h}")).alias(n) for h, n in zip(held, names, strict=True)])
    return out.union(left.filter(F.col(at).isNull()).select("*", *[none(i).alias(n) for i, n in enumerate(names)]))


def bucketed_sessions(
    df: DataFrame, keys: Sequence[str], time_col: str, gap: str, partial: Sequence[Column], first: str, last: str
) -> DataFrame:
    """Pre-aggregated sessions: one row per (key, bucket of width ``gap``) with ``_session`` numbers.

    Rows of one bucket lie less than ``gap`` apart, so a session can only break between
    buckets.  ``partial`` are the bucket aggregates and must include the bucket's
    ``first`` and ``last`` time.  The ordered step then sees at most one row per bucket.
    """
    cells = with_bucket(df, time_col, gap, "_cell").groupBy(*keys, "_cell").agg(*partial)
    series = Window.partitionBy(*keys).orderBy("_cell")
    breaks = F.col(first) > F.lag(last).over(series) + F.expr(f"INTERVAL {gap}")
    opened = F.coalesce(breaks, F.lit(True)).cast("int")
    return cells.withColumn("_opened", opened).withColumn("_session", F.sum("_opened").over(series)).drop("_opened")
