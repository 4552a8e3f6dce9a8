"""Stored summaries: a table with the kind and parameters it was built with, which readers check.

Any file system that Spark reaches; gzip, zstd, snappy or none, with a level where the codec has one.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = {"gzip": "parquet.compression.codec.gzip.level", "zstd": "parquet.compression.codec.zstd.level"}


def save(table: DataFrame, path: str, kind: str, codec: str = "gzip", level: int | None = None, **params) -> None:
    """Write ``table`` under ``path``; ``kind`` and ``params`` go with it."""
    writer = table.write.option("compression", codec)
    if level is not None:
        if codec not in LEVELS:
            raise ValueError(f"{codec} has no levels")
        writer = writer.option(LEVELS[codec], level)
    writer.parquet(f"{path}/rows")
    table.sparkSession.createDataFrame([(kind, json.dumps(params, sort_keys=True))], "kind string, params string").coalesce(1).write.parquet(f"{path}/about")


def load(spark: SparkSession, path: str, kind: str, **params) -> DataFrame:
    """The table under ``path``; raises if it is of another kind or was built with other parameters."""
    about = spark.read.parquet(f"{path}/about").first()
    if about["kind"] != kind or json.loads(about["params"]) != params:
        raise ValueError(f"{path} holds {about['kind']} with {about['params']}, not {kind} with {json.dumps(params, sort_keys=True)}")
    return spark.read.parquet(f"{path}/rows")


def to_arrays(table: DataFrame, groups: list[str], m: int, empty: int = 0) -> DataFrame:
    """groups, values: registers 0 .. m - 1 of each group as an array, ``empty`` where there is none."""
    have = table.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("reg", "val"))).alias("have"))
    return have.select(*groups, F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda r: F.coalesce(F.element_at("have", r), F.lit(empty))).alias("values"))


def from_arrays(arrays: DataFrame, groups: list[str], empty: int = 0) -> DataFrame:
    """groups, reg, val of arrays as ``to_arrays`` gives them."""
    return arrays.select(*groups, F.posexplode("values").alias("reg", "val")).filter(F.col("val") != empty)


def to_numpy(arrays: DataFrame, group: str, most: int = 10_000) -> tuple[list, np.ndarray]:
    """Names and a matrix of at most ``most`` groups' arrays, on the driver; more raise."""
    rows = arrays.select(group, "values").orderBy(group).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} groups")
    return [r[0] for r in rows], np.array([r[1] for r in rows])


def from_numpy(spark: SparkSession, names: list, values: np.ndarray, group: str) -> DataFrame:
    """group, reg, val of a matrix whose rows are groups' registers; zeros are no registers."""
    rows = [(n, [int(v) for v in row]) for n, row in zip(names, values)]
    kind = "string" if names and isinstance(names[0], str) else "bigint"
    return from_arrays(spark.createDataFrame(rows, f"{group} {kind}, values array<bigint>"), [group])


def random_ids(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """id, h: n hashes, the same for the same seed."""
    from gistra.functions.hashing import h60

    return spark.range(n).select("id", h60("id", f"random{seed}").alias("h"))


def lines_kmers(spark: SparkSession, path: str, k: int) -> DataFrame:
    """kmer: all substrings of k characters of the lines of text files."""
    from gistra.functions.hashing import kmers

    return spark.read.text(path).select(F.explode(kmers(F.col("value"), k)).alias("kmer"))
