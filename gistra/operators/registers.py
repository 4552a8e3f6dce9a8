"""Distinct counts from register tables: (group, reg, value) rows that merge by max, min or or.

A register table is a partial aggregate, so it is combined before the shuffle, stored as any table, rolled
up by grouping again and compared by joining on the register.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistra.functions.hashing import BITS, h60, rank, register, remainder
from gistra.operators import pairs as pr
from gistra.staging import cut


def hll(df: DataFrame, groups: list[str], key: Column | str, p: int = 10, seed: int = 0) -> DataFrame:
    """groups, reg, val: the largest rank of each register. Null keys are passed over."""
    h = df.select(*groups, h60(key, seed).alias("h")).filter("h IS NOT NULL")
    return h.groupBy(*groups, register(F.col("h"), p).alias("reg")).agg(F.max(rank(F.col("h"), p)).alias("val"))


def merge(tables: list[DataFrame], groups: list[str]) -> DataFrame:
    """Union of max-merged tables, or a roll-up of one to fewer groups."""
    out = tables[0].select(*groups, "reg", "val")
    for t in tables[1:]:
        out = out.unionByName(t.select(*groups, "reg", "val"))
    return out.groupBy(*groups, "reg").agg(F.max("val").alias("val"))


def fold(table: DataFrame, groups: list[str], p: int, to: int) -> DataFrame:
    """The table at a smaller p, as if built so: the dropped register bits lead the rank again."""
    d = p - to
    low = F.col("reg").bitwiseAND((1 << d) - 1)
    val = F.when(low == 0, F.col("val") + d).otherwise(d + 1 - F.length(F.bin(low)))
    return table.select(*groups, F.shiftright("reg", d).alias("reg"), val.cast("int").alias("val")).groupBy(*groups, "reg").agg(F.max("val").alias("val"))


def alpha(m: int) -> float:
    return {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))


def raw_estimate(harmonic: Column, zeros: Column, m: int) -> Column:
    """Original estimate with the small- and large-range corrections."""
    e = F.lit(alpha(m) * m * m) / harmonic
    big = float(1 << 32)
    return F.when((e < 2.5 * m) & (zeros > 0), F.lit(float(m)) * F.ln(F.lit(float(m)) / zeros)).when(e > big / 30, F.lit(-big) * F.ln(1 - e / big)).otherwise(e)


def estimate(table: DataFrame, groups: list[str], p: int) -> DataFrame:
    """groups, estimate: original estimate of each group."""
    m = 1 << p
    sums = table.groupBy(*groups).agg(F.sum(F.pow(F.lit(2.0), -F.col("val"))).alias("s"), F.count("*").alias("filled"))
    zeros = m - F.col("filled")
    return sums.select(*groups, F.round(raw_estimate(F.col("s") + zeros, zeros, m), 6).alias("estimate"))


def histogram(table: DataFrame, groups: list[str], p: int) -> DataFrame:
    """groups, val, regs: how many registers have each value (0 included)."""
    counts = table.groupBy(*groups, "val").agg(F.count("*").alias("regs"))
    zeros = table.groupBy(*groups).agg(((1 << p) - F.count("*")).alias("regs")).select(*groups, F.lit(0).alias("val"), "regs").filter("regs > 0")
    return counts.unionByName(zeros)


def improved(counts: np.ndarray, p: int, q: int) -> float:
    """Corrected raw estimate from the histogram of values 0 .. q + 1."""
    m = 1 << p

    def sigma(x):
        if x == 1:
            return math.inf
        y, z, old = 1.0, x, -1.0
        while z != old:
            x, old = x * x, z
            z, y = z + x * y, 2 * y
        return z

    def tau(x):
        if x in (0, 1):
            return 0.0
        y, z, old = 1.0, 1 - x, -1.0
        while z != old:
            x, old, y = math.sqrt(x), z, y / 2
            z -= (1 - x) ** 2 * y
        return z / 3

    z = m * tau(1 - counts[q + 1] / m)
    for k in range(q, 0, -1):
        z = 0.5 * (z + counts[k])
    return m * m / (2 * math.log(2) * (z + m * sigma(counts[0] / m)))


def likeliest(counts: np.ndarray, p: int, q: int) -> float:
    """Maximum-likelihood cardinality under the Poisson model, by bisection on the score."""
    m, k = 1 << p, np.arange(q + 2)
    if counts[0] == m:
        return 0.0
    width = np.where(k == 0, 1.0, 2.0 ** -np.minimum(k, q))

    def score(n):
        """Derivative of the log likelihood; P(k) is exp(-x_0), exp(-x_k) (1 - exp(-x_k)), 1 - exp(-x_q)."""
        w = width / m
        with np.errstate(over="ignore"):
            first = counts * w / np.expm1(n * w)  # of the factors 1 - exp(-x)
        return first[1:].sum() - (counts * w)[: q + 1].sum()

    lo, hi = 1e-6, 1.0
    while score(hi) > 0:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if score(mid) > 0 else (lo, mid)
    return (lo + hi) / 2


def estimate_by(table: DataFrame, groups: list[str], p: int, method: str) -> DataFrame:
    """groups, estimate by 'improved' or 'mle', from each group's histogram (at most 64 bins a group)."""
    q = BITS - p
    bins = histogram(table, groups, p).groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("val", "regs"))).alias("bins"))
    solve = improved if method == "improved" else likeliest
    @F.pandas_udf("double")
    def solved(s: pd.Series) -> pd.Series:
        out = []
        for bins in s:
            c = np.zeros(q + 2)
            for k, n in dict(bins).items():
                c[int(k)] = n
            out.append(solve(c, p, q))
        return pd.Series(out)

    return bins.select(*groups, F.round(solved("bins"), 4).alias("estimate"))


def comparisons(table: DataFrame, group: str, p: int, pairs: DataFrame | None = None) -> DataFrame:
    """i, j, card_i, card_j, union_size, intersection, jaccard, containment (of i in j), a_only, b_only of all pairs, or of
    the ``pairs`` (i, j) given and no others.

    Registers meet by an equi-join; what only one group has comes from its totals.
    """
    m = 1 << p
    power = lambda c: F.pow(F.lit(2.0), -c)
    both = pr.meeting(table, group, ["reg"], "val", pairs, c=F.count("*"), g=F.sum(power(F.greatest("x", "y"))), x=F.sum(power(F.col("x"))), y=F.sum(power(F.col("y"))))
    full = pr.filled(pr.group_pairs(table, group) if pairs is None else pairs, both, c=0, g=0.0, x=0.0, y=0.0)
    totals = table.groupBy(group).agg(F.sum(power(F.col("val"))).alias("s"), F.count("*").alias("n"))
    t = pr.sided(totals, group, full, ["s", "n"])
    est = lambda s, n: raw_estimate(s + (m - n), m - n, m)
    e = t.select("i", "j", est(F.col("s_i"), F.col("n_i")).alias("x"), est(F.col("s_j"), F.col("n_j")).alias("y"), est(F.col("g") + F.col("s_i") - F.col("x") + F.col("s_j") - F.col("y"), F.col("n_i") + F.col("n_j") - F.col("c")).alias("u"))
    e = e.withColumn("is", F.greatest(F.lit(0.0), F.col("x") + F.col("y") - F.col("u")))
    r = lambda c: F.round(c, 6)
    return e.select("i", "j", r(F.col("x")).alias("card_i"), r(F.col("y")).alias("card_j"), r(F.col("u")).alias("union_size"), r(F.col("is")).alias("intersection"), r(F.col("is") / F.col("u")).alias("jaccard"), r(F.col("is") / F.col("x")).alias("containment"), r(F.col("x") - F.col("is")).alias("a_only"), r(F.col("y") - F.col("is")).alias("b_only"))


def contains(probe: DataFrame, key: str, table: DataFrame, p: int, seed: int = 0) -> DataFrame:
    """probe rows with maybe (false: surely never added)."""
    hashed = probe.withColumn("h_", h60(key, seed))
    looked = hashed.withColumn("reg_", register(F.col("h_"), p)).join(table.select(F.col("reg").alias("reg_"), "val"), "reg_", "left")
    return looked.select(*probe.columns, (F.coalesce("val", F.lit(0)) >= rank(F.col("h_"), p)).alias("maybe"))


def bit_maps(df: DataFrame, groups: list[str], key: str, p: int = 6) -> DataFrame:
    """groups, reg, bits: the ranks seen, or-merged."""
    bit = F.least(rank(h60(key), p) - 1, F.lit(62))
    return df.groupBy(*groups, register(h60(key), p).alias("reg")).agg(F.bit_or(F.pow(F.lit(2), bit).cast("bigint")).alias("bits"))


def pcsa(df: DataFrame, groups: list[str], key: str, p: int = 6) -> DataFrame:
    """groups, estimate from or-merged bit patterns: n * 1.292808 * 2 ** mean of the lowest unset bit."""
    maps = bit_maps(df, groups, key, p)
    lowest = F.length(F.regexp_extract(F.reverse(F.bin("bits")), "^(1*)", 1))
    m = 1 << p
    return maps.groupBy(*groups).agg(F.sum(lowest).alias("s")).select(*groups, F.round(m * 1.292808 * F.pow(F.lit(2.0), F.col("s") / m), 6).alias("estimate"))


def merged(keys: list[str], how, *tables: DataFrame, value: str = "val") -> DataFrame:
    """Union of tables whose cells merge by max, min, or, or sum (``how`` is the aggregate function)."""
    out = tables[0].select(*keys, value)
    for t in tables[1:]:
        out = out.unionByName(t.select(*keys, value))
    return out.groupBy(*keys).agg(how(value).alias(value))


def merged_smallest(a: DataFrame, b: DataFrame, groups: list[str], k: int) -> DataFrame:
    """groups, h: the k smallest of two tables of smallest hashes."""
    both = a.select(*groups, "h").union(b.select(*groups, "h")).distinct()
    return both.withColumn("rk", F.row_number().over(Window.partitionBy(*groups).orderBy("h"))).filter(F.col("rk") <= k).select(*groups, "h")


def counted_smallest(df: DataFrame, groups: list[str], key: str, k: int) -> DataFrame:
    """groups, h, cnt: the k smallest hashes and how often their keys came."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(*groups, key).agg(F.count("*").alias("cnt")).select(*groups, h60(key).alias("h"), "cnt")
    return counts.withColumn("rk", F.row_number().over(Window.partitionBy(*groups).orderBy("h"))).filter(F.col("rk") <= k).drop("rk")


def kmv(df: DataFrame, groups: list[str], key: str, k: int = 64, seed: int = 0, largest: bool = False) -> DataFrame:
    """groups, rk, h: the k smallest (or largest) distinct hashes. Distinct first, so repeats don't reach the window."""
    w = Window.partitionBy(*groups).orderBy(F.desc("h") if largest else F.col("h"))
    distinct = df.filter((F.col(key) if isinstance(key, str) else key).isNotNull()).select(*groups, h60(key, seed).alias("h")).distinct()
    return distinct.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)


def kmv_estimate(table: DataFrame, groups: list[str], k: int) -> DataFrame:
    top = float(1 << BITS)
    return table.groupBy(*groups).agg(F.count("*").alias("n"), F.max("h").alias("kth")).select(*groups, F.round(F.when(F.col("n") < k, F.col("n").cast("double")).otherwise(top / F.col("kth") * k), 6).alias("estimate"))


def oph(df: DataFrame, groups: list[str], key: Column | str, p: int = 7, seed: int = 0) -> DataFrame:
    """One-permutation minima: groups, reg, val (least remainder)."""
    h = df.filter((F.col(key) if isinstance(key, str) else key).isNotNull()).select(*groups, h60(key, seed).alias("h"))
    return h.groupBy(*groups, register(F.col("h"), p).alias("reg")).agg(F.min(remainder(F.col("h"), p)).alias("val"))


def div_buckets(df: DataFrame, groups: list[str], key: Column | str, m: int) -> DataFrame:
    """Minima in any number of buckets: reg = h mod m, val = h div m."""
    h = df.select(*groups, h60(key).alias("h")).filter("h IS NOT NULL")
    return h.groupBy(*groups, (F.col("h") % m).cast("int").alias("reg")).agg(F.min(F.expr(f"h div {m}")).alias("val"))


def oph_fold(table: DataFrame, groups: list[str], p: int, to: int) -> DataFrame:
    """Minima at fewer registers, as if built so."""
    d = p - to
    low = F.col("reg").bitwiseAND((1 << d) - 1).cast("bigint")
    return table.select(*groups, F.shiftright("reg", d).alias("reg"), (low * (1 << (BITS - p)) + F.col("val")).alias("val")).groupBy(*groups, "reg").agg(F.min("val").alias("val"))


def oph_estimate(table: DataFrame, groups: list[str], p: int) -> DataFrame:
    """Harmonic estimate m^2 / sum of minima as fractions; an empty register counts as 1."""
    m, unit = 1 << p, float(1 << (BITS - p))
    s = table.groupBy(*groups).agg(F.sum(F.col("val").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    return s.select(*groups, F.round(F.lit(float(m) * m) / (F.col("s").cast("double") / unit + (m - F.col("n"))), 6).alias("estimate"))


def oph_measures(table: DataFrame, group: str, p: int) -> DataFrame:
    """i < j, jaccard, intersection, union_size, containment of all pairs from one-permutation minima: of cardinalities A, B
    and a Jaccard J the intersection is (A + B) J / (1 + J)."""
    equal = matches(table, group)
    t = pr.sided(oph_estimate(table, [group], p), group, equal, ["estimate"]).withColumn("jac", F.col("equal") / (1 << p))
    both = F.col("estimate_i") + F.col("estimate_j")
    inter = both * F.col("jac") / (1 + F.col("jac"))
    return t.select("i", "j", F.round("jac", 6).alias("jaccard"), F.round(inter, 4).alias("intersection"), F.round(both - inter, 4).alias("union_size"), F.round(inter / F.col("estimate_i"), 6).alias("containment"))


def first_arrivals(df: DataFrame, group: str, key: str, order: str, p: int) -> DataFrame:
    """group, estimate: the running estimate that grows by m over the registers' harmonic sum whenever a register rises.

    A rise can only come from the first row with its register and rank, so at most 64 rows a register are left to
    put in order, whatever the stream's length.
    """
    h = h60(key)
    first = df.filter(F.col(key).isNotNull()).groupBy(group, register(h, p).alias("reg"), rank(h, p).alias("val")).agg(F.min(order).alias("at"))
    return risen(first, group, p)


def risen(first: DataFrame, group: str, p: int) -> DataFrame:
    """group, estimate from (group, reg, val, at): each register's first row of each rank."""
    m = 1 << p
    before = Window.partitionBy(group, "reg").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rises = first.withColumn("old", F.coalesce(F.max("val").over(before), F.lit(0))).filter(F.col("val") > F.col("old"))
    fall = F.when(F.col("old") == 0, 1.0).otherwise(F.pow(F.lit(2.0), -F.col("old"))) - F.pow(F.lit(2.0), -F.col("val"))
    run = rises.withColumn("gone", F.sum(fall).over(Window.partitionBy(group).orderBy("at")) - fall)
    return run.groupBy(group).agg(F.round(F.sum(m / (m - F.col("gone"))), 4).alias("estimate"))


def bit_pair_counters(df: DataFrame, group: str, key: str, order: str, buckets: int) -> DataFrame:
    """group, estimate: sum over ``buckets`` of counters of two 64-bit maps and a level, each fed its keys' first rows in order.

    A counter's state is three numbers; partitions are read once, sorted by bucket and order, and no group is held.
    """
    kind = df.schema[group].dataType.simpleString()
    h = h60(key)
    first = df.filter(F.col(key).isNotNull()).groupBy(group, h.alias("h")).agg(F.min(order).alias("at"))
    dealt = first.select(group, (F.col("h") % buckets).cast("int").alias("bucket"), F.expr(f"h div {buckets}").alias("v"), "at").repartition(group, "bucket").sortWithinPartitions(group, "bucket", "at")

    def run(batches):
        state, own = [5, 0, 0], None
        for batch in batches:
            out = []
            for g, b, v in zip(batch[group], batch["bucket"], batch["v"]):
                if (g, b) != own:
                    if own is not None:
                        out.append((*own, *state[:2]))
                    state, own = [5, 0, 0], (g, b)
                v = int(v)
                zeros = (v & -v).bit_length() - 1 if v else 60
                if zeros > state[0]:
                    bit = 1 << ((v >> (zeros + 1)) % 64)
                    state[1] |= bit
                    if zeros > state[0] + 1:
                        state[2] |= bit
                    if state[1].bit_count() > 31:
                        state = [state[0] + 1, state[2], 0]
            yield pd.DataFrame([(g, b, lv + 5.8 + m.bit_count() / 32) for g, b, lv, m in out], columns=["g", "b", "e"])
        if own is not None:
            yield pd.DataFrame([(*own, state[0] + 5.8 + state[1].bit_count() / 32)], columns=["g", "b", "e"])

    logs = dealt.mapInPandas(run, f"g {kind}, b int, e double")
    return logs.groupBy(F.col("g").alias(group)).agg(F.round(F.sum(F.pow(F.lit(2.0), F.col("e"))), 4).alias("estimate"))


def hyper(df: DataFrame, groups: list[str], key: Column | str, p: int = 8, r: int = 10) -> DataFrame:
    """Registers of (rank, r more bits) in one number, merged by max."""
    h2 = h60(key, "second").bitwiseAND((1 << r) - 1)
    return df.groupBy(*groups, register(h60(key), p).alias("reg")).agg(F.max(rank(h60(key), p) * (1 << r) + h2).alias("val"))


def matches(table: DataFrame, group: str) -> DataFrame:
    """i < j, equal: registers with equal values, 0 for pairs without one. The table is read four times, so it is made once."""
    table = cut(table, "registers")
    both = pr.meeting(table, group, ["reg", "val"], "val", equal=F.count("*"))
    return pr.filled(pr.group_pairs(table, group), both, equal=0)


def orders(table: DataFrame, group: str) -> DataFrame:
    """i < j, gt, lt: registers of i above and below those of j."""
    return pr.compared(table, group).select("i", "j", "gt", "lt")


def densified(table: DataFrame, groups: list[str], p: int, tries: int = 64) -> DataFrame:
    """groups, reg, val with empty registers borrowing from others, picked by hash of register and attempt. A register
    that finds none in ``tries`` attempts takes the next filled one in circular order, so every group comes out full."""
    m = 1 << p
    have = table.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("reg", "val"))).alias("have"))
    want = have.withColumn("reg", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    order = F.transform(F.sequence(F.lit(0), F.lit(tries)), lambda t: F.when(t == 0, F.col("reg")).otherwise((h60(F.concat(F.col("reg").cast("string"), F.lit("/"), t.cast("string"))) % m).cast("int")))
    first = F.filter(F.transform(order, lambda r: F.element_at("have", r)), lambda v: v.isNotNull())
    filled = F.map_keys("have")
    following = F.coalesce(F.array_min(F.filter(filled, lambda r: r > F.col("reg"))), F.array_min(filled))
    return want.select(*groups, "reg", F.coalesce(F.get(first, F.lit(0)), F.element_at("have", following)).alias("val"))
