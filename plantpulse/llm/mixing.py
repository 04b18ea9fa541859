"""Mixing sources to target weights by entropy balancing.

Rates r of documents keep closest to 1 in relative entropy while every source's words come to its target
and no rate exceeds ``most``. The solution tilts exponentially, r = min(most, exp(lambda * x)) with x the
document's words over its source's mean; lambda, one per source, solves the convex dual. Each Newton
iteration is one Spark aggregation of all sources' gradients and curvatures over the counts of documents
per source and size (documents of one source and size have one rate). A step that leaves the bracket of
its source is replaced by bisection. The rates are rounded to whole copies, from the largest size of a source to the
smallest: what one size is short of or has too much goes on to the next, within what the smaller ones can take.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.llm.shared import written

#: Words of the texts: runs of other characters than space and 09-0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Relative difference between a source's words and its target at which its iteration ends.
CLOSE = 1e-9
MOST_ITERATIONS = 100
#: Documents of one source and size that are ranked together; more are dealt out to several ranks.
RANKED = 5_000


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words; null text: 0) and h (a hash of id and text) of every row."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), identity().alias("h"))


def identity() -> Column:
    return F.xxhash64("doc_id", "text")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """``sources`` (source, source_size) with s (0, 1, ... by code point, null last) and target.

    The weights repeat over the sources in that order and share all words; a target stops at ``most``
    times its source's words, and what is over is shared again by weight. The level at which this ends is
    the largest of those reached when the sources of the least ratios of limit to weight are stopped. One
    task handles the sources, of which there is one row each.
    """
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("s")
    own = sources.select("source", "source_size", place).withColumns(
        {"w": F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int")).cast("double"), "cap": F.col("source_size") * most}
    )
    all_rows = Window.partitionBy()
    earlier = Window.orderBy(F.col("cap") / F.col("w"), "s").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    level = left / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0)))
    return own.withColumn("level", level).select("s", "source", "source_size", F.least("cap", F.max("level").over(all_rows) * F.col("w")).alias("target"))


def balance(counts: DataFrame, targets: DataFrame, most: float = 3.0) -> DataFrame:
    """The dual solution: s and lam (null where every document takes ``most``).

    ``counts``: s, size, n; ``targets``: s, source_size, target. Sources without words are left out.
    """
    limit = math.log(most)
    used = counts.where("size > 0")
    mean = used.groupBy("s").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    part = F.col("target") / F.col("source_size")
    state = written(
        targets.where("source_size > 0").join(mean, "s").select(
            "s", "target", "mean", F.lit(0.0).alias("lam"), F.least(F.lit(0.0), F.log(part) * F.col("mean")).alias("low"),
            (F.col("mean") * limit).alias("high"), (part > most * (1 - 1e-12)).alias("done"), (part > most * (1 - 1e-12)).alias("all"),
        ),
        "mix-state",
    )
    for _ in range(MOST_ITERATIONS):
        if not state.where("not done").limit(1).count():
            break
        x = F.col("size") / F.col("mean")
        free = F.col("lam") * x < limit
        rate = F.when(free, F.exp(F.least(F.col("lam") * x, F.lit(limit)))).otherwise(most)
        words = F.col("n") * F.col("size")
        sums = used.join(state.where("not done"), "s").groupBy("s").agg(
            F.sum(words * rate).alias("got"), F.sum(F.when(free, words * rate * x).otherwise(0.0)).alias("slope")
        )
        over = F.col("got") - F.col("target")
        low, high = F.when(over < 0, F.col("lam")).otherwise(F.col("low")), F.when(over > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - F.try_divide(over, F.col("slope"))
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high)
        close = F.coalesce((F.abs(over) <= CLOSE * F.col("target")) | (high - low <= 1e-15 * F.abs(high)), F.lit(False))
        state = written(
            state.join(sums, "s", "left").select(
                "s", "target", "mean",
                F.when(F.col("done") | close, F.col("lam")).when(inside, newton).otherwise((low + high) / 2).alias("lam"),
                low.alias("low"), high.alias("high"), (F.col("done") | close).alias("done"), "all",
            ),
            "mix-state",
        )
    return state.select("s", F.when(~F.col("all"), F.col("lam")).alias("lam"), "mean")


def copies(counts: DataFrame, solution: DataFrame, most: float = 3.0) -> DataFrame:
    """s, size, n with rate and total: how many copies all n documents of this source and size take together."""
    x = F.col("size") / F.col("mean")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("lam").isNull(), most).otherwise(F.least(F.lit(most), F.exp(F.least(F.col("lam") * x, F.lit(50.0)))))
    rated = counts.join(solution, "s", "left").select("s", "size", "n", rate.alias("rate"))

    def rounded(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", ascending=False, ignore_index=True)
        size, n, rate = (group[c].to_numpy() for c in ("size", "n", "rate"))
        total, carry = np.zeros(len(group), np.int64), 0.0
        left = float((n * rate * size).sum())
        smaller = most * (np.cumsum((n * size)[::-1])[::-1] - n * size)  # words that smaller sizes can take
        for i in range(len(group)):
            if not size[i]:
                total[i] = n[i]
                continue
            want = n[i] * rate[i] + carry / size[i]
            least, largest = math.ceil((left - smaller[i]) / size[i] - 1e-9), math.floor(left / size[i] + 1e-9)
            if least > largest:  # no whole number leaves what smaller sizes can take: the nearer one
                least = largest = least if least * size[i] - left < left - largest * size[i] - smaller[i] else largest
            total[i] = min(max(round(want), least, 0), max(largest, 0), int(most) * n[i])
            carry = (want - total[i]) * size[i]
            left -= total[i] * size[i]
        return group.assign(total=total)

    return rated.groupBy("s").applyInPandas(rounded, "s int, size bigint, n bigint, rate double, total bigint")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """doc_id, source, size, h, source_size, target, rate and copies of every row of ``docs``.

    See source_targets() for the targets and balance() for the rates. A document takes the whole number of
    copies just below or above its source's and size's mean; which ones take one more is settled by a hash
    of id and text, so reruns agree. A null text has size 0 and a null source is a source. Documents
    without words take one copy and count nothing. Repeated rows count each for itself.
    """
    rows = written(sizes(docs), "mix-sizes")
    counted = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    targets = written(source_targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most), "mix-targets")
    counts = written(counted.alias("c").join(targets.alias("t"), F.expr("c.source <=> t.source")).select("s", "size", "n"), "mix-counts")
    plan = written(copies(counts, balance(counts, targets, most), most).join(targets, "s").drop("source"), "mix-plan")
    numbered = rows.alias("r").join(targets.select("s", "source").alias("t"), F.expr("r.source <=> t.source")).select("r.*", "s")
    planned = numbered.join(plan, ["s", "size"]).withColumn("salt", F.pmod(F.xxhash64("h", F.lit(1)), F.ceil(F.col("n") / RANKED)))
    dealt = planned.groupBy("s", "size", "salt").count()
    before = dealt.select("s", "size", "salt", F.coalesce(F.sum("count").over(Window.partitionBy("s", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("s", "size", "salt").orderBy("h", "doc_id")) - 1 + F.col("before")
    each = F.floor(F.col("total") / F.col("n"))
    return planned.join(before, ["s", "size", "salt"]).select(
        "doc_id", "source", "size", "h", "source_size", "target", "rate", (each + F.when(rank < F.col("total") - each * F.col("n"), 1).otherwise(0)).alias("copies")
    )


def mixed_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (size times copies) of every row of ``docs``."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """The rows of ``docs``, each as often as its copies, with all its columns. Equal rows of one id and text may swap copies."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "h").orderBy(F.desc("copies")))
    taken = mix(docs, weights, most).select("doc_id", "h", "copies")
    taken = taken.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), nth.alias("__nth"), F.col("copies").alias("__copies"))
    own = docs.withColumn("__own", identity()).withColumn("__of", F.row_number().over(Window.partitionBy("doc_id", "__own").orderBy(F.lit(0))))
    joined = own.join(taken, F.expr("doc_id <=> __id and __own = __h and __of = __nth")).where("__copies > 0")
    return joined.withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
