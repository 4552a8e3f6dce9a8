"""Set registers and variants of minima: exponential and integer registers, their measures, and further minima.

Exponential registers hold the least of exponential numbers; integer registers are their logarithms to a base b. From
the counts of registers above, below and equal follow the Jaccard of two groups and its likelihood.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistra.functions.hashing import BITS, h60, h60_seeded, rank, register, unit
from gistra.operators import pairs as pr

#: The published parameter sets (base b, scale a, largest register value q) by register width.
PRESETS = {
    "nibble": (2.718281828459045, 5e-4, 14),
    "small_nibble": (4.0, 1e-6, 14),
    "byte": (1.2, 20.0, 254),
    "short": (1.0005, 0.06, 65534),
    "wide_short": (1.0004, 0.06, 65534),
    "e_short": (1.0006, 0.06, 65534),
    "e_byte": (1.09, 0.08, 254),
    "uint": (1.0000000109723500835, 19.77882586, 4294967294),
}


def exponential(h: Column) -> Column:
    """An exponential number of rate 1 from a hash."""
    return -F.ln(1 - unit(h))


def winners(df: DataFrame, group: str, key: str, m: int) -> DataFrame:
    """group, reg, val, id, cnt: each register's least number, whose key it is, and how often the group has that key."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(group, key).agg(F.count("*").alias("cnt"))
    s = counts.withColumn("reg", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("h", h60_seeded(F.col(key), F.col("reg")))
    best = s.groupBy(group, "reg").agg(F.min(F.struct("h", F.col(key).alias("id"), "cnt")).alias("w"))
    return best.select(group, "reg", F.round(exponential(F.col("w.h")), 9).alias("val"), F.col("w.id").alias("id"), F.col("w.cnt").alias("cnt"))


def integer_registers(df: DataFrame, group: str, key: str, m: int, b: float, a: float, q: int) -> DataFrame:
    """group, reg, val: largest 1 - log_b(x / a) of the keys' numbers, within 0 .. q + 1; merged by max."""
    s = df.filter(F.col(key).isNotNull()).select(group, key).distinct().withColumn("reg", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    x = exponential(h60_seeded(F.col(key), F.col("reg")))
    val = F.floor(1 - F.ln(x / a) / math.log(b))
    return s.groupBy(group, "reg").agg(F.max(F.greatest(F.lit(0), F.least(F.lit(q + 1), val)).cast("bigint")).alias("val"))


def integer_cardinality(table: DataFrame, group: str, m: int, b: float, a: float) -> DataFrame:
    """group, estimate: m (1 - 1/b) / (a ln b sum of b^-val); absent registers count as 0."""
    s = table.groupBy(group).agg(F.sum(F.pow(F.lit(b), -F.col("val"))).alias("s"), F.count("*").alias("n"))
    return s.select(group, F.round(m * (1 - 1 / b) / (a * math.log(b) * (F.col("s") + m - F.col("n"))), 6).alias("estimate"))


def shared_measures(table: DataFrame, group: str, m: int) -> DataFrame:
    """i < j, jaccard (equal / m), alpha, beta (registers above and below / m), union_size, intersection,
    containment of i in j, from exponential registers of all pairs."""
    counts = pr.compared(table, group)
    both = pr.meeting(table, group, ["reg"], "val", least=F.sum(F.least("x", "y")))
    totals = table.groupBy(group).agg((m / F.sum("val")).alias("card"))
    t = pr.sided(totals, group, counts.join(both, ["i", "j"]), ["card"])
    j, u = F.col("equal") / m, m / F.col("least")
    inter = F.greatest(F.lit(0.0), F.col("card_i") + F.col("card_j") - u)
    r = lambda c: F.round(c, 6)
    return t.select("i", "j", r(j).alias("jaccard"), r(F.col("gt") / m).alias("alpha"), r(F.col("lt") / m).alias("beta"), r(u).alias("union_size"), r(inter).alias("intersection"), r(inter / F.col("card_i")).alias("containment"))


def cosine(alpha: Column, beta: Column) -> Column:
    """Cosine of two sets from the shares that only one has."""
    return (1 - alpha - beta) / F.sqrt((1 - alpha) * (1 - beta))


def likeliest_jaccard(above: int, below: int, m: int, x: float, y: float, b: float) -> float:
    """The Jaccard that maximises the likelihood of ``above`` and ``below`` of m registers, for cardinalities x and y,
    by golden section over 0 .. min / max."""
    if not x or not y:
        return 0.0
    u, v = x / (x + y), y / (x + y)
    log_b = lambda z: math.log1p(-z * (b - 1) / b) / -math.log(b) if z * (b - 1) / b < 1 else math.inf

    def score(j):
        p, q = log_b(max(0.0, u - v * j)), log_b(max(0.0, v - u * j))
        parts = ((above, p), (below, q), (m - above - below, 1 - p - q))
        return sum(n * math.log(max(c, 1e-300)) for n, c in parts if n)

    lo, hi, g = 0.0, min(x, y) / max(x, y), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        s, t = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, t) if score(s) > score(t) else (s, hi)
    ends = (0.0, (lo + hi) / 2, min(x, y) / max(x, y))
    return max(ends, key=score)


def joint_likelihood(table: DataFrame, group: str, m: int, b: float, a: float) -> DataFrame:
    """i < j, jaccard: of all pairs, by likelihood from integer registers."""
    @F.pandas_udf("double")
    def solved(gt: pd.Series, lt: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeliest_jaccard(int(p), int(q), m, u, v, b) for p, q, u, v in zip(gt, lt, x, y)])

    t = pr.sided(integer_cardinality(table, group, m, b, a), group, pr.compared(table, group), ["estimate"])
    return t.select("i", "j", F.round(solved("gt", "lt", "estimate_i", "estimate_j"), 4).alias("jaccard"))


def optimal_base(table: DataFrame, groups: list[str], q: int) -> DataFrame:
    """groups, a, b: the parameters at which registers 0 .. q + 1 span the values seen: b = (max / min)^(1/q), a = max / b."""
    s = table.groupBy(*groups).agg(F.max("val").alias("top"), F.min("val").alias("low"))
    b = F.exp(F.ln(F.col("top") / F.col("low")) / q)
    return s.select(*groups, F.round(F.col("top") / b, 6).alias("a"), F.round(b, 6).alias("b"))


def k_minima(df: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """group, slot, val: the least hash under each of k functions."""
    s = df.filter(F.col(key).isNotNull()).select(group, key).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return s.groupBy(group, "slot").agg(F.min(h60_seeded(F.col(key), F.col("slot"))).alias("val"))


def permuted_minima(df: DataFrame, group: str, key: str, m: int) -> DataFrame:
    """group, reg, val: every key puts the registers in an order of its own; a register keeps its least place plus a fraction."""
    s = df.filter(F.col(key).isNotNull()).select(group, key).distinct().withColumn("reg", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("h", h60_seeded(F.col(key), F.col("reg")))
    place = F.row_number().over(Window.partitionBy(group, key).orderBy("h", "reg")) - 1
    fraction = unit(h60_seeded(F.col(key), F.col("reg") + 1000))
    return s.withColumn("x", place + fraction).groupBy(group, "reg").agg(F.round(F.min("x"), 9).alias("val"))


def permuted_cardinality(table: DataFrame, group: str, m: int) -> DataFrame:
    """group, estimate: from the sum of registers of ``permuted_minima``, m^2 / sum."""
    return table.groupBy(group).agg(F.round(F.lit(float(m * m)) / F.sum("val"), 6).alias("estimate"))


def counted_minima(df: DataFrame, groups: list[str], key: str, p: int) -> DataFrame:
    """groups, reg, val, cnt: one-permutation minima, and how often the key at each minimum came."""
    h = df.filter(F.col(key).isNotNull()).groupBy(*groups, key).agg(F.count("*").alias("cnt")).withColumn("h", h60(key))
    best = h.groupBy(*groups, register(F.col("h"), p).alias("reg")).agg(F.min(F.struct(F.col("h").bitwiseAND((1 << (BITS - p)) - 1).alias("val"), "cnt")).alias("w"))
    return best.select(*groups, "reg", F.col("w.val").alias("val"), F.col("w.cnt").alias("cnt"))


def counted_jaccard(table: DataFrame, group: str) -> DataFrame:
    """i < j, jaccard: sum of least over sum of greatest counts, of the registers whose minima agree and of the others."""
    same = pr.meeting(table, group, ["reg", "val"], "cnt", low=F.sum(F.least("x", "y")), high=F.sum(F.greatest("x", "y")), x=F.sum("x"), y=F.sum("y"))
    full = pr.filled(pr.group_pairs(table, group), same, low=0, high=0, x=0, y=0)
    t = pr.sided(table.groupBy(group).agg(F.sum("cnt").alias("t")), group, full, ["t"])
    return t.select("i", "j", F.round(F.col("low") / (F.col("high") + F.col("t_i") - F.col("x") + F.col("t_j") - F.col("y")), 6).alias("jaccard"))


def ranks_of_minima(table: DataFrame, groups: list[str], p: int) -> DataFrame:
    """groups, reg, val: the largest-rank registers that the same hashes would have made: the rank of the least remainder."""
    v = F.col("val")
    return table.select(*groups, "reg", F.when(v == 0, BITS - p + 1).otherwise(BITS - p + 1 - F.length(F.bin(v))).cast("int").alias("val"))


def wide_base(table: DataFrame, groups: list[str], p: int) -> DataFrame:
    """groups, reg, val: 8-bit registers 255 - ceil(log of the least remainder), to the base 2^((BITS - p) / 254)."""
    base = math.log(2) * (BITS - p) / 254
    v = F.col("val")
    return table.select(*groups, "reg", F.when(v == 0, 255).otherwise(255 - F.ceil(F.ln(v.cast("double")) / base)).cast("int").alias("val"))


def wide_estimate(table: DataFrame, groups: list[str], p: int) -> DataFrame:
    """groups, estimate: m^2 / sum of base^-val, a register without value counting as 1."""
    m, base = 1 << p, 2 ** ((BITS - p) / 254)
    s = table.groupBy(*groups).agg(F.sum(F.pow(F.lit(base), -F.col("val"))).alias("s"), F.count("*").alias("n"))
    return s.select(*groups, F.round(m * m / (F.col("s") + m - F.col("n")), 4).alias("estimate"))


def packed_radix(table: DataFrame, groups: list[str]) -> DataFrame:
    """groups, reg, val: 4-bit registers, ranks to the radix 16: (rank - 1) div 4 + 1 at most 15; 0 for none."""
    return table.select(*groups, "reg", F.least(F.lit(15), F.floor((F.col("val") - 1) / 4) + 1).cast("int").alias("val"))


def packed_estimate(table: DataFrame, groups: list[str], p: int) -> DataFrame:
    """groups, estimate from 4-bit registers: e / (0.2 ln e - 0.5) of the harmonic e."""
    m = 1 << p
    s = table.groupBy(*groups).agg(F.sum(F.pow(F.lit(16.0), -F.col("val"))).alias("s"), F.count("*").alias("n"))
    e = F.lit(float(m * m)) / (F.col("s") + m - F.col("n"))
    return s.select(*groups, F.round(e / (0.2 * F.ln(e) - 0.5), 6).alias("estimate"))


def mean_estimates(table: DataFrame, groups: list[str], p: int) -> DataFrame:
    """groups and the harmonic, arithmetic, geometric and median estimates of one-permutation minima; an empty register is 1."""
    m, whole = 1 << p, float(1 << (BITS - p))
    full = table.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("reg", "val"))).alias("have"))
    x = full.withColumn("reg", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("x", F.coalesce((F.element_at("have", F.col("reg")).cast("double") + 1) / whole, F.lit(1.0)))
    s = x.groupBy(*groups).agg(F.sum("x").alias("s"), F.sum(1 / F.col("x")).alias("r"), F.sum(F.ln("x")).alias("l"), F.median("x").alias("d"))
    return s.select(*groups, F.round(m * m / F.col("s"), 4).alias("harmonic"), F.round(F.col("r"), 0).alias("arithmetic"), F.round(m * F.exp(-F.col("l") / m), 4).alias("geometric"), F.round(m * math.log(2) / F.col("d"), 4).alias("median"))


def collisions(p: int, r: int, ranks: int, n: float, k: float) -> float:
    """Expected registers at which disjoint sets of n and k elements agree by chance, over all ranks and remainders."""
    rank_ = np.arange(1, ranks + 1)
    width = 2.0 ** -(p + r + np.minimum(rank_, ranks - 1).astype(float))  # of one remainder's interval
    low = np.where(rank_ < ranks, 2.0 ** (-p - rank_.astype(float)), 0.0)
    at = low[:, None] + width[:, None] * np.arange(1 << r)[None]
    with np.errstate(divide="ignore"):
        inside = lambda c: np.exp(c * np.log1p(-at)) - np.exp(c * np.log1p(-np.minimum(at + width[:, None], 1 - 1e-16)))
        return float((inside(n) * inside(k)).sum() * (1 << p))


def rank_remainder_measures(table: DataFrame, group: str, p: int, r: int) -> DataFrame:
    """i < j, jaccard, union_size, intersection, containment of all pairs from rank-and-remainder registers; agreements
    expected by chance are taken off."""
    m, ranks = 1 << p, BITS - p + 1

    @F.pandas_udf("double")
    def chance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([collisions(p, r, ranks, a, b) for a, b in zip(x, y)])

    both = pr.filled(pr.group_pairs(table, group), pr.meeting(table, group, ["reg"], "val", c=F.count("*"), e=F.sum((F.col("x") == F.col("y")).cast("bigint"))), c=0, e=0)
    totals = rank_remainder_cardinality(table, [group], p, r).withColumnRenamed("estimate", "card").join(table.groupBy(group).agg(F.count("*").alias("n")), group)
    t = pr.sided(totals, group, both, ["card", "n"])
    some = F.col("n_i") + F.col("n_j") - F.col("c")
    j = F.greatest(F.lit(0.0), (F.col("e") - F.least(chance("card_i", "card_j"), F.col("e"))) / some)
    t = t.select("i", "j", "card_i", "card_j", j.alias("j_"))
    inter = (F.col("card_i") + F.col("card_j")) * F.col("j_") / (1 + F.col("j_"))
    return t.select("i", "j", F.round("j_", 6).alias("jaccard"), F.round(F.col("card_i") + F.col("card_j") - inter, 4).alias("union_size"), F.round(inter, 4).alias("intersection"), F.round(inter / F.col("card_i"), 6).alias("containment"))


def rank_remainder_cardinality(table: DataFrame, groups: list[str], p: int, r: int) -> DataFrame:
    """groups, estimate: harmonic, with the remainder as the fraction of a register's value; absent registers are 1."""
    m, top = 1 << p, (1 << r) - 1
    x = F.pow(F.lit(2.0), -F.shiftright("val", r).cast("double")) * (2 * top - F.col("val").bitwiseAND(top)) / top
    s = table.groupBy(*groups).agg(F.sum(x).alias("s"), F.count("*").alias("n"))
    return s.select(*groups, F.round(F.lit(float(m * m)) / (F.col("s") + m - F.col("n")), 4).alias("estimate"))


def joint_estimates(table: DataFrame, group: str, p: int) -> DataFrame:
    """i < j, a_only, b_only, intersection by maximum likelihood of both groups' registers: the two rates alone and the shared
    one, climbed in logarithms from inclusion and exclusion. A pair's histogram has at most 64 x 64 bins."""
    m, q = 1 << p, BITS - p

    def solve(bins, x, y, u):
        k, l, n = (np.array(c, float) for c in zip(*bins))
        shared = max(x + y - u, 1.0)
        theta = np.log([max(x - shared, 1.0), max(y - shared, 1.0), shared])
        below = lambda rate, v: np.where(v < 0, 0.0, np.where(v >= q + 1, 1.0, np.exp(-rate / m * 2.0 ** -np.minimum(np.maximum(v, 0), 60))))

        def loss(t):
            a, b, c = np.exp(t)
            # P(K <= k, L <= l) from three independent maxima; the cell's probability by differences
            f = lambda s, r: below(a, s) * below(b, r) * below(c, np.minimum(s, r))
            cell = f(k, l) - f(k - 1, l) - f(k, l - 1) + f(k - 1, l - 1)
            return -(n * np.log(np.maximum(cell, 1e-300))).sum()

        step, best = 0.5, loss(theta)
        while step > 1e-5:
            moved = False
            for at in range(3):
                for sign in (1, -1):
                    t = theta.copy()
                    t[at] += sign * step
                    value = loss(t)
                    if value < best:
                        theta, best, moved = t, value, True
            if not moved:
                step /= 2
        return np.exp(theta)

    @F.pandas_udf("array<double>")
    def solved(bins: pd.Series, x: pd.Series, y: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([solve([(b["x"], b["y"], b["n"]) for b in rows], *at).tolist() for rows, *at in zip(bins, x, y, u)])

    from gistra.operators.registers import comparisons

    full = table.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("reg", "val"))).alias("have")).withColumn("reg", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).select(group, "reg", F.coalesce(F.element_at("have", F.col("reg")), F.lit(0)).alias("val"))
    a, b = full.select(F.col(group).alias("i"), "reg", F.col("val").alias("x")), full.select(F.col(group).alias("j"), "reg", F.col("val").alias("y"))
    bins = a.join(b, "reg").filter("i < j").groupBy("i", "j", "x", "y").agg(F.count("*").alias("n")).groupBy("i", "j").agg(F.collect_list(F.struct("x", "y", "n")).alias("bins"))
    c = bins.join(comparisons(table, group, p), ["i", "j"]).withColumn("e", solved("bins", "card_i", "card_j", "union_size"))
    return c.select("i", "j", F.col("e")[0].alias("a_only"), F.col("e")[1].alias("b_only"), F.col("e")[2].alias("intersection"))
