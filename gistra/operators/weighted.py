"""Minima of weighted sets: registers of two groups agree as often as their weighted similarity says."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from gistra.functions.hashing import gamma2, h60, h60_seeded, unit
from gistra.functions.scalars import stateless
from gistra.staging import cut

U = np.uint64


def _slots(weights: DataFrame, w: str, m: int) -> DataFrame:
    return weights.filter(F.col(w) > 0).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))


def permuted_points(weights: DataFrame, group: str, key: str, w: str, m: int) -> DataFrame:
    """group, slot, key, val: every key throws m points, at growing distances, into the slots in an order of its own; the
    i-th gap is exponential of rate w (m - i) / m. A slot keeps its nearest point. Merges by the least val."""
    s = _slots(weights, w, m).withColumn("h", h60_seeded(F.col(key), F.col("slot")))
    own = Window.partitionBy(group, key).orderBy("h", "slot")
    s = s.withColumn("i", F.row_number().over(own) - 1)
    gap = -F.ln(unit(h60_seeded(F.col(key), F.col("i") + 1000))) * m / (m - F.col("i"))
    s = s.withColumn("x", F.sum(gap).over(own.rowsBetween(Window.unboundedPreceding, 0)) / F.col(w))
    return s.groupBy(group, "slot").agg(F.min(F.struct("x", F.col(key).alias("key"))).alias("p")).select(group, "slot", F.col("p.key").alias("key"), F.round("p.x", 9).alias("val"))


def _uniform(state: np.ndarray) -> np.ndarray:
    return ((state >> U(12)).astype(float) + 0.5) / float(1 << 52)


def interval_points(weights: DataFrame, group: str, key: str, w: str, m: int) -> DataFrame:
    """group, slot, key, val: the i-th point of a key lies in the i-th unit of length, at a place drawn from an exponential of
    rate ln(m / (m - 1)) cut to the unit, and in a slot drawn anew; val is the place over w. A key stops where it can't improve
    a slot any more, so partitions hold the slots of one group at a time. Merges by the least val."""
    rate = np.log(m / (m - 1.0))
    kind, key_kind = weights.schema[group].dataType.simpleString(), weights.schema[key].dataType.simpleString()
    rows = weights.filter(F.col(w) > 0).select(F.col(group).alias("g"), F.col(key).alias("key"), F.col(w).cast("double").alias("w"), h60(key).alias("h"))

    def run(batches):
        own, val, who = None, None, None

        def out():
            at = np.flatnonzero(np.isfinite(val))
            return pa.RecordBatch.from_pylist([{"g": own[0], "slot": int(i), "key": who[i], "val": float(val[i])} for i in at], schema=schema)

        for batch in batches:
            for g, k, weight, h in zip(*(batch.column(c).to_pylist() for c in ("g", "key", "w", "h"))):
                if own is None or g != own[0]:
                    if own is not None:
                        yield out()
                    own, val, who = (g,), np.full(m, np.inf), [None] * m
                state, i, top = np.array([h], U), 0, np.inf
                while i / weight < top:
                    state = stateless(state)
                    u = float(_uniform(state)[0])
                    x = (i - np.log1p(u * np.expm1(-rate)) / rate) / weight
                    state = stateless(state)
                    slot = int(_uniform(state)[0] * m)
                    if x < val[slot] or (x == val[slot] and k < who[slot]):
                        val[slot], who[slot] = x, k
                    i, top = i + 1, val.max()
        if own is not None:
            yield out()

    names = {"g": kind, "slot": "int", "key": key_kind, "val": "double"}
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(", ".join(f"{n} {t}" for n, t in names.items())))
    parts = rows.sortWithinPartitions("g").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in names.items()))
    return parts.groupBy(F.col("g").alias(group), "slot").agg(F.min(F.struct("val", "key")).alias("p")).select(group, "slot", F.col("p.key").alias("key"), F.round("p.val", 9).alias("val"))


def halved(x: np.ndarray, side: np.ndarray, gap: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """First points of both halves of a stretch of weights whose first point is ``x``: the half that ``side`` names has it,
    the other's first point is later by an exponential ``gap`` of the half's rate."""
    later = x + gap / (width / 2)
    return np.where(side, later, x), np.where(side, x, later)


def nested_points(weights: DataFrame, group: str, key: str, w: str, m: int, top: float, depth: int = 24) -> DataFrame:
    """group, slot, key, val: each key has a random field of points over weights 0 .. ``top`` and distances, the same for every
    group; a slot keeps the nearest point at a weight up to the group's. The field is drawn where it is needed, by halving
    ``depth`` times along the weight; smaller differences of weights than top / 2^depth don't count. Weights beyond ``top`` raise."""
    lead = np.arange(m, dtype=U) * U(0x9E3779B97F4A7C15)

    def points(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """A row of nearest points for each key; all keys go down their own halves together."""
        state = stateless(stateless(lead + h[:, None]))
        low, width = np.zeros(len(h)), top
        x, best = -np.log(_uniform(state)) / top, np.full((len(h), m), np.inf)
        for _ in range(depth):
            within = weight < low + width  # a stretch that lies wholly under the weight needs no halves
            if not within.any():
                break
            state = stateless(state)
            side = (state & U(1)).astype(bool)
            state = stateless(state)
            left, right = halved(x, side, -np.log(_uniform(state)), width)
            # the draws of a half only depend on the path to it, whatever the weight
            up = within & (weight >= low + width / 2)
            best = np.where(up[:, None], np.minimum(best, left), best)
            x = np.where(up[:, None], right, np.where(within[:, None], left, x))
            state = np.where(up[:, None], state + U(1), state)
            # of a stretch that lies under the weight the point is taken, and none is left
            best = np.where(within[:, None], best, np.minimum(best, x))
            x = np.where(within[:, None], x, np.inf)
            low = np.where(up, low + width / 2, low)
            width /= 2
        return np.where((weight >= low + width)[:, None], np.minimum(best, x), best)

    rows = weights.filter((F.col(w) > 0) & F.col(key).isNotNull()).select(group, F.col(key).alias("key"), h60(key).alias("h"), F.col(w).cast("double").alias("w"))
    schema = StructType([rows.schema[group], StructField("slot", IntegerType()), rows.schema["key"], StructField("val", DoubleType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 11):
                part = batch.slice(at, 1 << 11)
                part = part.take(pc.sort_indices(part.column(1)))  # of equal points the least key's comes first
                weight = part.column(3).to_numpy(zero_copy_only=False)
                if (weight > top).any():
                    raise ValueError(f"a weight is beyond {top}")
                val = points(part.column(2).to_numpy(zero_copy_only=False).astype(U), weight)
                of = pc.dictionary_encode(part.column(0), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                for g in range(int(of.max()) + 1):
                    own = np.flatnonzero(of == g)
                    who = own[val[own].argmin(axis=0)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(who)), pa.array(np.arange(m, dtype=np.int32)), part.column(1).take(pa.array(who)), pa.array(val[who, np.arange(m)])], names=[group, "slot", "key", "val"])

    s = rows.mapInArrow(run, schema)
    return s.groupBy(group, "slot").agg(F.min(F.struct("val", "key")).alias("p")).filter("p.val < double('infinity')").select(group, "slot", F.col("p.key").alias("key"), F.round("p.val", 9).alias("val"))


def darts(weights: DataFrame, group: str, key: str, w: str, m: int, unit_weight: float) -> DataFrame:
    """group, slot, key, val: one dart for every full ``unit_weight`` of a key's weight, into a slot and at a distance by its
    hash. A slot keeps its nearest dart."""
    n = F.floor(F.col(w) / unit_weight).cast("int")
    thrown = weights.filter(n > 0).select(group, F.col(key).alias("key"), F.explode(F.sequence(F.lit(1), n)).alias("u"))
    name = F.concat_ws("/", F.col("key").cast("string"), F.col("u").cast("string"))
    s = thrown.select(group, "key", (h60(name, "slot") % m).cast("int").alias("slot"), h60(name, "place").alias("val"))
    return s.groupBy(group, "slot").agg(F.min(F.struct("val", "key")).alias("p")).select(group, "slot", F.col("p.key").alias("key"), F.col("p.val").alias("val"))


def first_hits(weights: DataFrame, group: str, key: str, w: str, keys: int, top: float, slots: int, tries: int) -> DataFrame:
    """group, slot, val: number of the first of ``tries`` random places (a key 1 .. ``keys``, a height to ``top``) that lies under
    the group's weight of that key. Groups without a hit have no row for the slot. Tries are joined by key, not searched."""
    at = weights.sparkSession.range(slots * tries).select(F.expr(f"cast(id div {tries} as int)").alias("slot"), (F.col("id") % tries).cast("int").alias("val"), (h60("id", "key") % keys + 1).alias("key_"), unit(h60("id", "height")).alias("height_"))
    hit = weights.select(group, F.col(key).alias("key_"), w).join(at, "key_").filter(F.col("height_") * top < F.col(w))
    return hit.groupBy(group, "slot").agg(F.min("val").alias("val"))


def sample_matrix(spark, rows: int, slots: int) -> DataFrame:
    """row, slot, r, c, beta: the random numbers of consistent weighted samples for ``rows`` keys."""
    name = lambda tag: F.concat_ws("/", F.lit(tag), F.col("row").cast("string"), F.col("slot").cast("string"))
    at = spark.range(rows).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    two = lambda a, b: F.round(gamma2(h60(name(a)), h60(name(b))), 9)
    return at.select("row", "slot", two("a", "b").alias("r"), two("c", "d").alias("c"), F.round(unit(h60(name("e"))), 9).alias("beta"))


def agreement(table: DataFrame, group: str, m: int) -> DataFrame:
    """i < j, similarity: share of slots with the same key and val, of all pairs. The table is read four times, so it is made once."""
    from gistra.operators import pairs as pr

    table = cut(table, "minima")
    same = pr.meeting(table.withColumn("v_", F.struct("key", "val")), group, ["slot", "v_"], "slot", n=F.count("*"))
    return pr.filled(pr.group_pairs(table, group), same, n=0).select("i", "j", F.round(F.col("n") / m, 6).alias("similarity"))


def hashed_order(c: Column, seed: int = 0) -> Column:
    """Place of each row in a pseudo-random order: sort by it."""
    return h60(c, f"order{seed}")
