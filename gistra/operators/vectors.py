"""Projections, norms, quantile bins and moments."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistra.functions.hashing import h60_seeded, unit


def long_form(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(key, F.posexplode(vector).alias("idx", "x")).withColumn("x", F.col("x").cast("double"))


def project(entries: DataFrame, key: str, rows: int, width: int, p: float | None = None) -> DataFrame:
    """key, row, bucket, s: signed sums; with p, entries are first scaled by exponentials to the power 1/p."""
    e = entries.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    sign = F.when(h60_seeded(F.col("idx"), F.col("row") + 1000) % 2 == 0, 1.0).otherwise(-1.0)
    x = F.col("x") if p is None else F.col("x") / F.pow(-F.ln(unit(h60_seeded(F.col("idx"), F.lit("e")))), F.lit(1 / p))
    return e.groupBy(key, "row", (h60_seeded(F.col("idx"), F.col("row")) % width).cast("int").alias("bucket")).agg(F.round(F.sum(sign * x), 6).alias("s"))


def transform(entries: DataFrame, key: str, kind: str, rows: int, width: int, p: float = 2.0) -> DataFrame:
    """A projection by name: "signed" or "scaled" (by exponentials to the power 1/p), or "cauchy" sums."""
    return {"signed": lambda: project(entries, key, rows, width), "scaled": lambda: project(entries, key, rows, width, p), "cauchy": lambda: cauchy_sums(entries, key, rows)}[kind]()


def recover(table: DataFrame, entries: DataFrame, key: str, rows: int, width: int, p: float | None = None, digits: int = 6) -> DataFrame:
    """key, idx, estimate: median over rows of the signed cells, scaled back if they were scaled."""
    e = entries.select(key, "idx").withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    sign = F.when(h60_seeded(F.col("idx"), F.col("row") + 1000) % 2 == 0, 1.0).otherwise(-1.0)
    cells = e.withColumn("bucket", (h60_seeded(F.col("idx"), F.col("row")) % width).cast("int")).withColumn("sign", sign).join(table, [key, "row", "bucket"])
    back = F.lit(1.0) if p is None else F.pow(-F.ln(unit(h60_seeded(F.col("idx"), F.lit("e")))), F.lit(1 / p))
    return cells.groupBy(key, "idx").agg(F.round(F.median(F.col("sign") * F.col("s") * back), digits).alias("estimate"))


def top_indices(entries: DataFrame, key: str, k: int, by: str = "x") -> DataFrame:
    """key, idx, value, rk: the k entries of largest magnitude, of raw vectors or of what ``recover`` gives."""
    w = Window.partitionBy(key).orderBy(F.desc(F.abs(by)), "idx")
    return entries.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k).select(key, "idx", F.col(by), "rk")


def cauchy_sums(entries: DataFrame, key: str, tables: int, digits: int = 6) -> DataFrame:
    """key, t, s: projections on Cauchy numbers, cut at 30000 either way; they merge by sum and subtract."""
    e = entries.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tables - 1))))
    cauchy = F.tan(math.pi * (unit(h60_seeded(F.col("idx"), F.col("t"))) - 0.5))
    cauchy = F.greatest(F.lit(-30000.0), F.least(F.lit(30000.0), cauchy))
    return e.groupBy(key, "t").agg(F.round(F.sum(F.col("x") * cauchy), digits).alias("s"))


def l1_norm(entries: DataFrame, key: str, tables: int) -> DataFrame:
    """key, norm: median magnitude of Cauchy projections."""
    return cauchy_sums(entries, key, tables, 9).groupBy(key).agg(F.round(F.median(F.abs("s")), 4).alias("norm"))


def log_bins(df: DataFrame, groups: list[str], value: str, accuracy: float) -> DataFrame:
    """groups, bin, cnt: counts of positive values by logarithm to the base gamma; bins merge by sum."""
    g = math.log((1 + accuracy) / (1 - accuracy))
    return df.filter(F.col(value) > 0).groupBy(*groups, F.ceil(F.ln(F.col(value)) / g).cast("int").alias("bin")).agg(F.count("*").alias("cnt"))


def bin_quantile(bins: DataFrame, groups: list[str], q: float, accuracy: float) -> DataFrame:
    """groups, quantile: middle of the bin where the cumulative count reaches q of all."""
    gamma = (1 + accuracy) / (1 - accuracy)
    w = Window.partitionBy(*groups)
    run = bins.withColumn("below", F.sum("cnt").over(w.orderBy("bin"))).withColumn("total", F.sum("cnt").over(w))
    hit = run.filter(F.col("below") >= F.ceil(F.col("total") * q)).groupBy(*groups).agg(F.min("bin").alias("bin"))
    return hit.select(*groups, F.round(2 * F.pow(F.lit(gamma), F.col("bin")) / (gamma + 1), 6).alias("quantile"))
