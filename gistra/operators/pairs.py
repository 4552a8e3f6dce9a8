"""All pairs of groups: every pair appears, also those that share nothing, and no plan compares row by row.

A result over all pairs has as many rows as pairs; names are dealt to blocks and joined on the block, so that the
work is spread and hashed. Values come from equi-joins on a register or key, and what only one side has follows
from that side's totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that one side's names are dealt to; the other side is sent to each. More for longer lists of names.
BLOCKS = 16


def cross_names(a: DataFrame, b: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """i, j: each name of ``a`` (one column) with each name of ``b``."""
    left = a.toDF("i").distinct().withColumn("block_", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = b.toDF("j").distinct().withColumn("block_", F.pmod(F.xxhash64("j"), F.lit(blocks)).cast("int"))
    return left.join(right, "block_").select("i", "j")


def group_pairs(table: DataFrame, group: str) -> DataFrame:
    """i < j: all pairs of the table's groups."""
    names = table.select(group)
    return cross_names(names, names).filter("i < j")


def filled(pairs: DataFrame, values: DataFrame, **missing) -> DataFrame:
    """``pairs`` with the values of those that have some, and the constants given for the others."""
    out = pairs.join(values, ["i", "j"], "left")
    return out.select("i", "j", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in missing.items()))


def sided(totals: DataFrame, group: str, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with both groups' totals as <column>_i and <column>_j."""
    for s in "ij":
        pairs = pairs.join(totals.select(F.col(group).alias(s), *(F.col(c).alias(f"{c}_{s}") for c in columns)), s)
    return pairs


def meeting(table: DataFrame, group: str, on: list[str], value: str, pairs: DataFrame | None = None, **aggregates: Column) -> DataFrame:
    """i < j (or the pairs given) and aggregates over the cells that both groups have; the values there are x and y."""
    a = table.select(F.col(group).alias("i"), *on, F.col(value).alias("x"))
    b = table.select(F.col(group).alias("j"), *on, F.col(value).alias("y"))
    met = a.join(b, on).filter("i < j") if pairs is None else pairs.select("i", "j").join(a, "i").join(b, ["j", *on])
    return met.groupBy("i", "j").agg(*(c.alias(n) for n, c in aggregates.items()))


def compared(table: DataFrame, group: str) -> DataFrame:
    """i < j, gt, lt, equal: registers of i above, below and equal to those of j; missing ones are below all."""
    both = meeting(table, group, ["reg"], "val", c=F.count("*"), gt=F.sum((F.col("x") > F.col("y")).cast("bigint")), lt=F.sum((F.col("x") < F.col("y")).cast("bigint")))
    full = filled(group_pairs(table, group), both, c=0, gt=0, lt=0)
    full = sided(table.groupBy(group).agg(F.count("*").alias("n")), group, full, ["n"])
    return full.select("i", "j", (F.col("gt") + F.col("n_i") - F.col("c")).alias("gt"), (F.col("lt") + F.col("n_j") - F.col("c")).alias("lt"), (F.col("c") - F.col("gt") - F.col("lt")).alias("equal"))


def condensed_index(i: Column, j: Column, n: int) -> Column:
    """Place of the pair i < j (from 0) among n * (n - 1) / 2 in order."""
    return (i * n - F.floor(i * (i + 1) / 2) + j - i - 1).cast("bigint")


def square(pairs: DataFrame, names: DataFrame, value: str, own: float = 1.0) -> DataFrame:
    """The full symmetric matrix of condensed pairs: (i, j), (j, i) and the diagonal."""
    mirrored = pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), value)
    diagonal = names.toDF("i").distinct().select("i", F.col("i").alias("j"), F.lit(own).alias(value))
    return pairs.select("i", "j", value).unionByName(mirrored).unionByName(diagonal)


def nearest(pairs: DataFrame, value: str, k: int) -> DataFrame:
    """i, j, value, rk: the k best partners of each name; ties by name."""
    from pyspark.sql import Window

    both = pairs.select("i", "j", value).unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), value))
    return both.withColumn("rk", F.row_number().over(Window.partitionBy("i").orderBy(F.desc(value), "j"))).filter(F.col("rk") <= k)
