"""Mixing sources to target weights by Poisson replication, native throughout.

A source's rate is its target share of the whole divided by its present share. Every document draws how
often it appears from a Poisson distribution of that mean, inverted at a uniform number that is hashed from
its id; it is exploded by the count, and the copies are dealt and sorted by a hash of id and copy number, a
random permutation of the whole.

Sizes are characters plus one for each document, so empty documents count too. Without given weights a
source's weight is its size to the power ``alpha`` (1: as it is, 0: all sources alike).

Scale: one small aggregate by source, and one shuffle of the chosen copies by a uniform hash, which no hot
source can skew. The table of sources is broadcast only when it has ``BROADCAST_SOURCES`` rows or fewer;
beyond that it is an ordinary join, which adaptive execution splits when skewed.

Rates above ``STEP`` are drawn as a sum of independent parts, so any rate is exact.

Defined cases: a null source is a source of its own; null texts have length 0; rows with equal ids draw
equal counts, each row for itself; sources without a given weight have weight 0 and vanish; an empty table
gives an empty one; new columns get a leading underscore on a name clash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistra.llm.text import ensure_unique
from gistra.staging import cut

STEP, TERMS, BROADCAST_SOURCES = 16, 64, 20_000


def uniform(*parts: Column) -> Column:
    """52 hashed bits as a number from 0 to 1."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_steps(rate: Column) -> Column:
    """P(X <= j) for j = 0 .. TERMS - 1 of the Poisson distribution with this mean."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def add(s, j):
        p = s["p"] * rate / j
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.concat(s["all"], F.array(s["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, add)["all"]


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None, alpha: float, total: float, text_col: str, source_col: str) -> DataFrame:
    """(source_key, rate, parts, steps) of every source."""
    sizes = docs.groupBy(F.col(source_col).alias("source_key")).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0)).cast("long") + 1).alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(float(alpha))))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "k string, weight double")
        sizes = sizes.join(given, F.col("source_key").eqNullSafe(F.col("k")), "left").drop("k").fillna({"weight": 0.0})
    sums = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))  # one row
    rated = sizes.crossJoin(F.broadcast(sums)).withColumn("rate", F.round(F.col("weight") / F.col("all_weight") * F.lit(float(total)) * F.col("all_size") / F.col("size"), 9))
    parts = F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int")
    return rated.select("source_key", "rate", parts.alias("parts"), poisson_steps(F.col("rate") / parts).alias("steps"))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, alpha: float = 0.7, total: float = 1.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", extra: bool = True) -> DataFrame:
    """Documents repeated so that sources reach their weights, ``total`` times the present size, shuffled.

    With ``extra`` there are the columns rate, copies and copy_no besides those of ``docs``.
    """
    sources = cut(source_rates(docs, weights, alpha, total, text_col, source_col), "sources")
    small = sources.count() <= BROADCAST_SOURCES
    new = ensure_unique([*docs.columns, "source_key", "parts", "steps"], ["rate", "copies", "copy_no", "mix_key"])
    sources = sources.withColumnRenamed("rate", new["rate"])
    joined = docs.join(F.broadcast(sources) if small else sources, docs[source_col].eqNullSafe(sources["source_key"]))
    ident = F.coalesce(docs[id_col].cast("string"), F.lit(""))
    # the uniform number is hashed once for each part, not once for each term
    drawn = F.transform(F.transform(F.sequence(F.lit(1), F.col("parts")), lambda i: uniform(F.lit(str(seed)), ident, i.cast("string"))), lambda u: F.size(F.filter(F.col("steps"), lambda c: c < u)))
    copies = F.aggregate(drawn, F.lit(0), lambda a, n: a + n)
    chosen = joined.withColumn(new["copies"], copies).filter(F.col(new["copies"]) > 0)
    dealt = chosen.withColumn(new["copy_no"], F.explode(F.sequence(F.lit(1), F.col(new["copies"])))).withColumn(new["mix_key"], F.xxhash64(F.lit(seed), ident, F.col(new["copy_no"])))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shuffled = dealt.select(*[docs[c] for c in docs.columns], *[new[c] for c in ("rate", "copies", "copy_no", "mix_key")]).repartition(n, new["mix_key"]).sortWithinPartitions(new["mix_key"])
    return shuffled.drop(new["mix_key"]) if extra else shuffled.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH z AS (SELECT source, sum(coalesce(length(text), 0)::BIGINT + 1)::DOUBLE AS size FROM documents GROUP BY source),
r AS (SELECT source, round(pow(size, 0.7) / sum(pow(size, 0.7)) OVER () * sum(size) OVER () / size, 9) AS rate FROM z),
p AS (SELECT source, rate, greatest(ceil(rate / 16), 1)::INTEGER AS parts FROM r),
s AS (SELECT *, list_transform(range(0, 64), lambda j: list_sum(list_transform(range(0, j + 1), lambda i: exp(-rate / parts + i * ln(rate / parts) - lgamma(i + 1))))) AS steps FROM p),
d AS (SELECT documents.*, s.rate, list_sum(list_transform(range(1, s.parts + 1), lambda k:
    len(list_filter(s.steps, lambda c: c < ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || k), 1, 13))::BIGINT / 4503599627370496.0))))::INTEGER AS copies
  FROM documents JOIN s ON documents.source IS NOT DISTINCT FROM s.source)
SELECT *, unnest(range(1, copies + 1))::INTEGER AS copy_no FROM d WHERE copies > 0
"""
