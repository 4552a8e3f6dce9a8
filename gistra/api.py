"""The names a user of a summaries library looks for, as functions on register tables, arrays and columns.

Tables are (group, reg, val) as ``gistra.operators`` makes them; ``measures`` has the kinds that all-pairs matrices know.
Results over all pairs are condensed (i < j); ``tri2full`` makes them square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gistra.functions import hashing as hx
from gistra.operators import membership as mb
from gistra.operators import pairs as pr
from gistra.operators import registers as rg
from gistra.operators import setregs as sr
from gistra.operators import similarity as sm
from gistra.sources import tables

#: kind -> (table, group, parameter) -> i, j and measures. The parameter is p, or the number of registers for "exponential".
measures: dict[str, Callable[[DataFrame, str, int], DataFrame]] = {
    "registers": rg.comparisons,
    "minima": rg.oph_measures,
    "exponential": sr.shared_measures,
    "rank_remainder": lambda t, g, p: sr.rank_remainder_measures(t, g, p, 10),
    "bloom": lambda t, g, size: mb.measures(t, g, size, 3),
    "sample": mb.sample_measures,
}


def _matrix(table: DataFrame, group: str, parameter: int, kind: str, measure: str) -> DataFrame:
    found = measures[kind](table, group, parameter)
    if measure not in found.columns:
        raise ValueError(f"{kind} has no {measure}")
    return found.select("i", "j", measure)


def jaccard_matrix(table: DataFrame, group: str, parameter: int, kind: str = "registers") -> DataFrame:
    return _matrix(table, group, parameter, kind, "jaccard")


def intersection_matrix(table: DataFrame, group: str, parameter: int, kind: str = "registers") -> DataFrame:
    return _matrix(table, group, parameter, kind, "intersection")


def union_size_matrix(table: DataFrame, group: str, parameter: int, kind: str = "registers") -> DataFrame:
    return _matrix(table, group, parameter, kind, "union_size")


def containment_matrix(table: DataFrame, group: str, p: int) -> DataFrame:
    """i, j, containment of i in j for all ordered pairs and the diagonal."""
    c = rg.comparisons(table, group, p)
    back = c.select(F.col("j").alias("i"), F.col("i").alias("j"), F.round(F.col("intersection") / F.col("card_j"), 6).alias("containment"))
    own = table.select(F.col(group).alias("i"), F.col(group).alias("j"), F.lit(1.0).alias("containment")).distinct()
    return c.select("i", "j", "containment").unionByName(back).unionByName(own)


def symmetric_containment_matrix(table: DataFrame, group: str, p: int) -> DataFrame:
    """i < j, containment of the smaller in the larger."""
    c = rg.comparisons(table, group, p)
    return c.select("i", "j", F.round(F.greatest("containment", F.col("intersection") / F.col("card_j")), 6).alias("containment"))


tri2full = pr.square
ij2ind = pr.condensed_index
optimal_ab = sr.optimal_base
randset = tables.random_ids
to_numpy = tables.to_numpy
from_np = tables.from_numpy


def union(*register_tables: DataFrame, groups: list[str]) -> DataFrame:
    return rg.merge(list(register_tables), groups)


def union_size(a: DataFrame, b: DataFrame, p: int) -> DataFrame:
    """One row, estimate: of two register tables without groups."""
    return rg.estimate(rg.merge([a, b], []), [], p)


def compress(table: DataFrame, groups: list[str], p: int, to: int) -> DataFrame:
    return rg.fold(table, groups, p, to)


def relative_error(p: int) -> float:
    return 1.03896 / (1 << p) ** 0.5


def est_err(table: DataFrame, groups: list[str], p: int) -> DataFrame:
    """groups, error: the standard error of each estimate."""
    return rg.estimate(table, groups, p).select(*groups, (F.col("estimate") * relative_error(p)).alias("error"))


def shs_isz(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays of distinct values."""
    return F.size(F.array_intersect(a, b)).cast("bigint")


def count_eq(a: Column, b: Column) -> Column:
    """How many places of two arrays hold equal values."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x, F.lit(0)))


def ccount_eq(a: DataFrame, b: DataFrame, group_a: str, group_b: str) -> DataFrame:
    """i, j, equal: each group of ``a`` with each of ``b``."""
    met = a.select(F.col(group_a).alias("i"), "reg", "val").join(b.select(F.col(group_b).alias("j"), "reg", "val"), ["reg", "val"]).groupBy("i", "j").agg(F.count("*").alias("equal"))
    return pr.filled(pr.cross_names(a.select(group_a), b.select(group_b)), met, equal=0)


pcount_eq = rg.matches


def hash(c: Column, seed: int = 0) -> Column:  # noqa: A001
    """Of a text or, joined by blanks, a list of texts."""
    return hx.h60(c, seed)


def hash_ngrams(words: Column, n: int = 3, seed: int = 0) -> Column:
    """Array of the hashes of all runs of n words."""
    return F.transform(hx.ngrams(words, n), lambda g: hx.h60(g, seed))


def fastdiv(a: Column, d: int) -> Column:
    return ((a - a % d) / d).cast("bigint")


def fastmod(a: Column, d: int) -> Column:
    return a % d


class BandIndex:
    """A banded index of one-permutation minima: add tables of (id, reg, val), query for the best candidates.

    ``levels`` are registers per band, 1, 2, 4 ... by default; ``extra`` bands of each level beyond the contiguous ones take
    registers picked by hash.
    """

    def __init__(self, spark: SparkSession, registers: int, levels: list[int] | None = None, extra: int = 0):
        self.spark, self.registers, self.extra = spark, registers, extra
        self.levels = levels or sm.default_levels(registers)
        self.table: DataFrame | None = None

    def bands(self, minima: DataFrame, id_col: str = "id") -> DataFrame:
        out = sm.bands(minima, id_col, self.levels, self.registers)
        for level in self.levels if self.extra else []:
            out = out.unionByName(sm.overflow_bands(minima, id_col, level, self.registers, self.extra))
        return out

    def add(self, minima: DataFrame, id_col: str = "id") -> "BandIndex":
        new = self.bands(minima, id_col)
        self.table = new if self.table is None else self.table.unionByName(new)
        return self

    def query(self, minima: DataFrame, maxcand: int = 50, start: int | None = None, id_col: str = "id") -> DataFrame:
        """qid, id, level, hits: at most ``maxcand`` for each query, from bands of ``start`` registers or fewer."""
        index, wanted = self.table, self.bands(minima, id_col)
        if start is not None:
            index, wanted = index.filter(F.col("level") <= start), wanted.filter(F.col("level") <= start)
        return sm.candidates(wanted, index, maxcand)

    def per_row(self, minima: DataFrame, id_col: str = "id") -> DataFrame:
        return sm.per_row(self.bands(minima, id_col), self.table)
