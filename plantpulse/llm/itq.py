"""Near-equal embeddings by iterative quantisation, multi-index Hamming tables and an exact rerank.

Codes: vectors are centred, turned to their main axes and rotated so that the signs lose as little as
possible (iterative quantisation, fitted on a bounded sample; several starts give further bits). The code
is cut to ``TABLES`` substrings of ``KEY_BITS`` bits. Two vectors are candidates if they share a
substring and their first ``CODE_BITS`` bits differ in few places. At a cosine of 0.95 a bit differs with
probability 0.10, so some substring is shared with probability 0.95, and with 0.995 at 0.97.

Large groups of near-equal vectors are never taken apart into pairs. Equal vectors become one row with a
count. Vectors that share the first substring with ``CROWD`` others and lie within half the angle of their
centre are one *ball*: all of them are linked, by the triangle inequality. Tables hold each ball once per
substring. A vector and a ball are linked as a whole where their centre's distance proves or excludes it;
only what is left is compared member by member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.components import components
from plantpulse.llm.shared import written

#: Tables, bits of a substring, bits of the compared code.
TABLES = 24
KEY_BITS = 20
CODE_BITS = 128
#: Rows the rotations are fitted on, rounds of the fit, axes of one rotation.
SAMPLE = 8192
ROUNDS = 40
AXES = 64
#: Differing bits allowed between two vectors, a vector and a ball, two balls: five deviations above the mean.
NEAR_BITS = (33, 41, 48)
#: A substring with so many vectors may hold a ball; substrings of more units are compared in cuts of this many; salts of a ball.
CROWD = 32
CUT = 20_000
SALTS = 16
#: Radians by which angles are held back for rounding.
SLACK = 1e-7


def usable(c: str = "embedding") -> Column:
    """Neither null, empty, zero nor with null or non-finite components."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(c) > 0) & ~bad & F.exists(c, lambda x: x != 0), F.lit(False))


def units(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as vectors of length 1; scaled first, so that no square overflows."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def fit(sample: np.ndarray, bits: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Centre and directions (dimensions by ``bits``) of sign codes, by iterative quantisation."""
    centre = sample.mean(axis=0)
    flat = sample - centre
    values, axes = np.linalg.eigh(flat.T @ flat)
    axes = axes[:, np.argsort(-values)[:AXES]]
    seen, rng, out = flat @ axes, np.random.default_rng(seed), []
    while sum(x.shape[1] for x in out) < bits:
        turn, _ = np.linalg.qr(rng.normal(size=(axes.shape[1], axes.shape[1])))
        for _ in range(ROUNDS):
            left, _, right = np.linalg.svd(np.where(seen @ turn >= 0, 1.0, -1.0).T @ seen)
            turn = (left @ right).T
        out.append(axes @ turn)
    return centre, np.concatenate(out, axis=1)[:, :bits]


def codes(vectors: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Substrings (rows by TABLES) and the compared code (rows by CODE_BITS / 64 words)."""
    signs = (vectors - model[0]) @ model[1] >= 0
    powers = 1 << np.arange(KEY_BITS)
    keys = signs.reshape(len(signs), TABLES, KEY_BITS) @ powers
    words = np.packbits(signs[:, :CODE_BITS].reshape(len(signs), -1, 64), axis=2, bitorder="little")
    return keys.astype(np.int32), np.ascontiguousarray(words).view(np.int64)[:, :, 0]


def coded(rows: DataFrame, model: tuple, dim: int, column: str) -> DataFrame:
    """``rows`` with keys, c0 and c1 of the vectors in ``column``."""
    kept = rows.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words = codes(units(batch.column(column), dim), model)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * TABLES), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(words[:, 0]), pa.array(words[:, 1])], names=[*kept, "keys", "c0", "c1"])

    return rows.mapInArrow(run, kinds + ", keys array<int>, c0 bigint, c1 bigint")


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip((x * y).sum(axis=1), -1, 1))


def balls(rows: DataFrame, model: tuple, dim: int, angle: float) -> DataFrame:
    """rid, first (the ball's substring), alpha (angle to its centre), centre, c0, c1 of vectors that belong to a ball."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    first = rows.select("rid", F.col("keys")[0].alias("first"), "embedding", F.pmod("rid", F.lit(SALTS)).cast("int").alias("salt"))
    crowded = first.groupBy("first").agg(F.count("*").alias("n")).where(F.col("n") >= CROWD).select("first", salts.alias("salt"))
    some = first.join(crowded, ["first", "salt"])
    centre = some.groupBy("first").agg(F.array(*[F.sum(F.col("embedding")[i].cast("double")) for i in range(dim)]).alias("centre"))
    centre = coded(centre.where(usable("centre")), model, dim, "centre").drop("keys")
    met = some.join(centre.withColumn("salt", salts), ["first", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alpha = angles(units(batch.column("embedding"), dim), units(batch.column("centre"), dim))
            batch = batch.drop_columns(["embedding"]).append_column("alpha", pa.array(alpha))
            yield batch.filter(pa.array(alpha <= angle / 2 - SLACK))

    met = met.select("rid", "first", "centre", "c0", "c1", "embedding")
    return met.mapInArrow(run, "rid bigint, first int, centre array<double>, c0 bigint, c1 bigint, alpha double")


def candidates(entries: DataFrame) -> DataFrame:
    """Unit pairs a < b that share a substring of one table and whose codes are near; ``entries``: t, key, unit, ball, c0, c1."""
    size = entries.groupBy("t", "key").agg(F.ceil(F.count("*") / CUT).cast("int").alias("cuts")).where("cuts > 1")
    cut = entries.join(size, ["t", "key"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    left = cut.withColumn("cut", F.pmod(F.xxhash64("unit"), F.col("cuts")).cast("int")).drop("cuts")
    right = cut.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).drop("cuts")
    l, r = left.alias("l"), right.alias("r")
    bits = F.bit_count(F.col("l.c0").bitwiseXOR(F.col("r.c0"))) + F.bit_count(F.col("l.c1").bitwiseXOR(F.col("r.c1")))
    allowed = F.element_at(F.array(*map(F.lit, NEAR_BITS)), F.col("l.ball") + F.col("r.ball") + 1)
    same = (F.col("l.t") == F.col("r.t")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.cut") == F.col("r.cut"))
    met = l.join(r, same & (F.col("l.unit") < F.col("r.unit")) & (bits <= allowed))
    return met.select(F.col("l.unit").alias("a"), F.col("r.unit").alias("b")).distinct()


def _decided(met: DataFrame, dim: int, angle: float, cosine: float) -> DataFrame:
    """Vectors against other units: ``weight`` where all of the unit is linked, null where its members decide; others go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = units(batch.column("embedding"), dim), units(batch.column("centre"), dim)
            radius = batch.column("radius").to_numpy()
            alone = radius < 0  # a single vector: its own cosine decides
            alpha = angles(x, y)
            whole = np.where(alone, (x * y).sum(axis=1) >= cosine, alpha + radius <= angle - SLACK)
            open_ = ~alone & ~whole & (alpha - radius <= angle + SLACK)
            weight = pa.array(batch.column("weight").to_numpy(), mask=open_)
            columns = [batch.column("rid"), batch.column("a"), batch.column("b"), weight]
            out = pa.RecordBatch.from_arrays(columns, names=["rid", "a", "b", "weight"])
            yield out.filter(pa.array(whole | open_))

    met = met.select("rid", "a", "b", "weight", "radius", "embedding", "centre")
    return met.mapInArrow(run, "rid bigint, a bigint, b bigint, weight bigint")


def _compared(met: DataFrame, dim: int, cosine: float) -> DataFrame:
    """Vectors against members of a unit: those at least as near as ``cosine``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (units(batch.column("embedding"), dim) * units(batch.column("other"), dim)).sum(axis=1) >= cosine
            yield batch.select(["rid", "a", "b", "weight"]).filter(pa.array(near))

    return met.select("rid", "a", "b", "weight", "embedding", "other").mapInArrow(run, "rid bigint, a bigint, b bigint, weight bigint")


def _linked(rows: DataFrame, dim: int, cosine: float) -> DataFrame:
    """rid, n_links and component_id of ``rows``: rid, embedding (all of ``dim`` components, all different), copies, least."""
    angle = float(np.arccos(cosine))
    sample = rows.orderBy(F.xxhash64("embedding"), "rid").limit(SAMPLE).select("embedding").toArrow()
    model = fit(units(sample.column("embedding").combine_chunks(), dim), max(TABLES * KEY_BITS, CODE_BITS))
    rows = written(coded(rows, model, dim, "embedding"), "itq-codes")
    member = written(balls(rows, model, dim, angle), "itq-balls")
    size = member.groupBy("first").agg(F.min("rid").alias("unit"), F.max("alpha").alias("radius"), F.any_value("centre").alias("centre"))
    own = member.select("rid", "first", F.col("c0").alias("b0"), F.col("c1").alias("b1")).join(size.select("first", "unit"), "first", "left")
    placed = rows.join(own.drop("first"), "rid", "left").withColumn("ball", F.col("unit").isNotNull().cast("int"))
    placed = placed.withColumns({"unit": F.coalesce("unit", "rid"), "c0": F.coalesce("b0", "c0"), "c1": F.coalesce("b1", "c1")}).drop("b0", "b1")
    placed = written(placed, "itq-units")  # rid, embedding, copies, least, keys, unit, ball, c0, c1
    entries = placed.select("unit", "ball", "c0", "c1", F.posexplode("keys").alias("t", "key"))
    entries = entries.where("ball = 0").union(entries.where("ball = 1").distinct())
    pairs = written(candidates(entries), "itq-pairs")

    weights = placed.groupBy("unit").agg(F.sum("copies").alias("weight"), F.min("least").alias("least"))
    single = placed.where("ball = 0").select("unit", F.lit(-1.0).alias("radius"), F.transform("embedding", lambda x: x.cast("double")).alias("centre"))
    shapes = single.union(size.select("unit", "radius", "centre")).join(weights.select("unit", "weight"), "unit")
    both = pairs.union(pairs.select("b", "a"))
    asked = both.join(shapes.withColumnRenamed("unit", "b"), "b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    inside = placed.select(F.col("unit").alias("a"), "rid", "embedding", F.pmod("rid", F.lit(SALTS)).cast("int").alias("salt"))
    decided = written(_decided(inside.join(asked, ["a", "salt"]), dim, angle, cosine), "itq-decided")
    members = placed.select(F.col("unit").alias("b"), F.col("embedding").alias("other"), F.col("copies").alias("weight"))
    unsure = decided.where("weight IS NULL").drop("weight").join(rows.select("rid", "embedding"), "rid").join(members, "b")
    links = written(
        decided.where("weight IS NOT NULL").union(_compared(unsure, dim, cosine)).groupBy("rid", "a", "b").agg(F.sum("weight").alias("weight")), "itq-links"
    )
    roots = components(links.select("a", "b").distinct())
    found = links.groupBy("rid").agg(F.sum("weight").alias("others"))
    named = weights.join(roots.withColumnRenamed("node", "unit"), "unit", "left").withColumn("root", F.coalesce("root", "unit"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("unit", "weight", "component_id")
    out = placed.select("rid", "unit").join(named, "unit").join(found, "rid", "left")
    n_links = F.col("weight") - 1 + F.coalesce("others", F.lit(0))
    return written(out.select("rid", n_links.alias("n_links"), "component_id"), "itq-linked")


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding).

    n_links: other rows found with a cosine of at least ``cosine`` (in double precision); component_id: the
    smallest vec_id reachable by links, itself included; kept: vec_id = component_id. Rows that cannot be
    used (see usable()) have no links and stay. Vectors of different length are not linked. Equal rows are
    linked with each other. Rows without vec_id are linked like others; where no reachable row has an id,
    component_id is null, and kept is false without an own id. Other columns are not read.
    """
    rows = vectors.select("vec_id", "embedding")
    good = rows.where(usable())
    different = good.groupBy("embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    different = written(different.withColumn("rid", F.monotonically_increasing_id()), "itq-vectors")  # read again, so rid stays
    out = rows.where(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for (dim,) in different.select(F.size("embedding")).distinct().orderBy(F.size("embedding")).collect():
        same = different.where(F.size("embedding") == dim)
        linked = _linked(same, dim, cosine)
        back = same.select("rid", "embedding").join(linked, "rid").drop("rid")
        out = out.union(good.where(F.size("embedding") == dim).join(back, "embedding").select("vec_id", "n_links", "component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
