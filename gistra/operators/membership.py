"""Bloom filters as sets of bit positions (group, bit), and hash-modulus samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistra.functions.hashing import h60, h60_seeded
from gistra.operators import pairs as pr
from gistra.staging import cut


def _ln(x: Column) -> Column:
    """Logarithm with ln 0 = -infinity, as in SQL: a full filter stands for infinitely many keys."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf")))


def bits(df: DataFrame, groups: list[str], key: str, size: int, hashes: int, seed: int = 0) -> DataFrame:
    """groups, bit: the positions that are set."""
    at = F.explode(F.transform(F.sequence(F.lit(seed), F.lit(seed + hashes - 1)), lambda i: (h60_seeded(F.col(key), i) % size).cast("int")))
    return df.filter(F.col(key).isNotNull()).select(*groups, key).distinct().select(*groups, at.alias("bit")).distinct()


def may_contain(probe: DataFrame, key: str, table: DataFrame, size: int, hashes: int) -> DataFrame:
    """Distinct keys of ``probe`` with maybe: all their bits are set."""
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: (h60_seeded(F.col(key), i) % size).cast("int")))
    looked = probe.select(key).distinct().select(key, at.alias("bit"))
    return looked.join(table.select("bit", F.lit(1).alias("set_")), "bit", "left").groupBy(key).agg((F.count("set_") == F.count("*")).alias("maybe"))


def optimal_hashes(size: int, keys: int) -> int:
    return max(1, math.ceil(math.log(2) * size / keys))


def optimal_hashes_column(size: int, keys: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(math.log(2) * size / keys)).cast("int")


def test_and_add(df: DataFrame, key: str, order: str, size: int, hashes: int) -> DataFrame:
    """order, seen: whether all bits of a row's key were set by rows before it, as if rows came one by one."""
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: (h60_seeded(F.col(key), i) % size).cast("int")))
    rows = df.filter(F.col(key).isNotNull()).select(order, at.alias("bit"))
    first = rows.groupBy("bit").agg(F.min(order).alias("first_"))
    return rows.join(first, "bit").groupBy(order).agg(F.every(F.col("first_") < F.col(order)).alias("seen"))


def batch_words(answers: DataFrame, key: str, width: int) -> DataFrame:
    """word, bits: answers (key, maybe) of whole-number keys packed ``width`` to a number."""
    bit = F.when(F.col("maybe"), F.expr(f"shiftleft(1L, cast({key} % {width} as int))")).otherwise(0)
    return answers.groupBy(F.expr(f"{key} div {width}").alias("word")).agg(F.sum(bit).alias("bits"))


def resized(table: DataFrame, groups: list[str], size: int, to: int) -> DataFrame:
    """The filter at a smaller size that divides the present one, as if built so."""
    if size % to:
        raise ValueError("the new size must divide the old")
    return table.select(*groups, (F.col("bit") % to).cast("int").alias("bit")).distinct()


def measures(table: DataFrame, group: str, size: int, hashes: int) -> DataFrame:
    """i < j, union_size, intersection, jaccard, containment of i in j, bit_jaccard of all pairs of groups."""
    table = cut(table, "bits")
    n = table.groupBy(group).agg(F.count("*").alias("n"))
    o = pr.sided(n, group, _overlaps(table, group), ["n"])
    card = lambda c: _ln(1 - c / float(size)) / (hashes * math.log(1 - 1 / size))
    e = o.select("i", "j", "common", "either", card(F.col("n_i")).alias("a"), card(F.col("n_j")).alias("b"), card(F.col("either")).alias("u"))
    e = e.withColumn("is", F.greatest(F.lit(0.0), F.col("a") + F.col("b") - F.col("u")))
    return e.select("i", "j", F.round("u", 4).alias("union_size"), F.round("is", 4).alias("intersection"), F.round(F.col("is") / F.col("u"), 6).alias("jaccard"), F.round(F.col("is") / F.col("a"), 6).alias("containment"), F.round(F.col("common") / F.col("either"), 6).alias("bit_jaccard"))


def sample_measures(table: DataFrame, group: str, modulus: int) -> DataFrame:
    """i < j, jaccard, containment of i in j, union_size of all pairs of hash-modulus samples."""
    both = pr.filled(pr.group_pairs(table, group), pr.meeting(table, group, ["v"], "v", c=F.count("*")), c=0)
    t = pr.sided(table.groupBy(group).agg(F.count("*").alias("n")), group, both, ["n"])
    u = F.col("n_i") + F.col("n_j") - F.col("c")
    return t.select("i", "j", F.round(F.col("c") / u, 6).alias("jaccard"), F.round(F.col("c") / F.col("n_i"), 6).alias("containment"), (u * modulus).alias("union_size"))


def cardinality(table: DataFrame, groups: list[str], size: int, hashes: int) -> DataFrame:
    filled = F.count("*") / float(size)
    return table.groupBy(*groups).agg(F.round(_ln(1 - filled) / (hashes * math.log(1 - 1 / size)), 6).alias("estimate"))


def halve(table: DataFrame, groups: list[str], size: int) -> DataFrame:
    return table.select(*groups, (F.col("bit") % (size // 2)).cast("int").alias("bit")).distinct()


def overlaps(table: DataFrame, group: str) -> DataFrame:
    """i < j, common, either, one: sizes of AND, OR and XOR of the bits of all pairs of groups. The table is read
    several times, so it is made once."""
    return _overlaps(cut(table, "bits"), group)


def _overlaps(table: DataFrame, group: str) -> DataFrame:
    sizes = table.groupBy(group).agg(F.count("*").alias("n"))
    both = pr.filled(pr.group_pairs(table, group), pr.meeting(table, group, ["bit"], "bit", common=F.count("*")), common=0)
    n = F.col("n_i") + F.col("n_j")
    return pr.sided(sizes, group, both, ["n"]).select("i", "j", "common", (n - F.col("common")).alias("either"), (n - 2 * F.col("common")).alias("one"))


def mod_sample(df: DataFrame, groups: list[str], key: str, modulus: int) -> DataFrame:
    """groups, v: quotients of the hashes that the modulus divides; size times modulus estimates the count."""
    h = df.select(*groups, h60(key).alias("h_")).filter(F.col("h_") % modulus == 0)
    return h.select(*groups, F.expr(f"h_ div {modulus}").alias("v")).distinct()


def mod_reduce(table: DataFrame, groups: list[str], factor: int) -> DataFrame:
    return table.filter(F.col("v") % factor == 0).select(*groups, F.expr(f"v div {factor}").alias("v"))
