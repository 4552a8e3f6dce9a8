"""Count tables beyond the linear ones: conservative and saturating counts, cascades, fingerprint tables and decaying cells.

What depends on the order of rows is dealt to independent cells, each of which is read once in order with a state of
a few numbers; no group is gathered.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistra.functions.hashing import h60, h60_seeded, unit
from gistra.operators.counts import _bucket, _rows


def saturated(table: DataFrame, bits: int) -> DataFrame:
    """Counters of ``bits`` bits: they stay at their largest value."""
    return table.withColumn("cnt", F.least("cnt", F.lit((1 << bits) - 1)))


def conservative(df: DataFrame, key: str, rows: int = 4, width: int = 256, shards: int = 16) -> DataFrame:
    """row, bucket, cnt with conservative update: a key raises only the cells that lie below its new least count.

    Keys are counted first and dealt to ``shards`` by hash; each shard builds a table in order of hashes, and tables
    are summed. A sum of conservative tables still bounds every count from above, and is at most the plain table. More shards
    spread more keys over more tasks, and come nearer to the plain table.
    """
    totals = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("w")).select(h60(key).alias("h"), F.array(*(h60_seeded(F.col(key), F.lit(r)) % width for r in range(rows))).alias("at"), "w")
    dealt = totals.withColumn("shard", (F.col("h") % shards).cast("int")).repartition("shard").sortWithinPartitions("shard", "h")

    def run(batches):
        cells, own = np.zeros((rows, width), np.int64), None
        every = np.arange(rows)

        def out():
            r, b = np.nonzero(cells)
            return pd.DataFrame({"row": r.astype("int32"), "bucket": b.astype("int32"), "cnt": cells[r, b]})

        for batch in batches:
            for shard, at, w in zip(batch["shard"], batch["at"], batch["w"]):
                if own is not None and shard != own:
                    yield out()
                    cells[:] = 0
                own, at = shard, np.asarray(at)
                cells[every, at] = np.maximum(cells[every, at], cells[every, at].min() + w)
        if own is not None:
            yield out()

    return dealt.mapInPandas(run, "row int, bucket int, cnt long").groupBy("row", "bucket").agg(F.sum("cnt").alias("cnt"))


def weighted_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, jaccard: mean over rows of sum of least over sum of greatest cells."""
    x, y = a.select("row", "bucket", F.col("cnt").alias("x")), b.select("row", "bucket", F.col("cnt").alias("y"))
    both = x.join(y, ["row", "bucket"], "full").select("row", F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    return both.groupBy("row").agg((F.sum(F.least("x", "y")) / F.sum(F.greatest("x", "y"))).alias("j")).agg(F.round(F.avg("j"), 6).alias("jaccard"))


def mean_corrected(keys: DataFrame, key: str, table: DataFrame, rows: int, width: int) -> DataFrame:
    """key, estimate: median over rows of the cell less the mean of the row's other cells."""
    looked = _rows(keys.select(key).distinct(), rows).withColumn("bucket", _bucket(F.col(key), width))
    total = table.groupBy("row").agg(F.sum("cnt").alias("n"))
    cells = looked.join(table, ["row", "bucket"], "left").join(F.broadcast(total), "row")  # a row for each row of the table
    c = F.coalesce("cnt", F.lit(0))
    return cells.groupBy(key).agg(F.round(F.median(c - (F.col("n") - c) / (width - 1)), 6).alias("estimate"))


def cascade(df: DataFrame, key: str, row_id: str, levels: int, size: int) -> DataFrame:
    """level, bit: the filters of a counting cascade. A row passes into level i with probability 2^-i, by its hash."""
    h = h60(F.concat_ws("/", F.col(key).cast("string"), F.col(row_id).cast("string")), "coin")
    coin = F.least(F.lit(levels - 1), F.floor(-F.log2(unit(h)))).cast("int")
    reached = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(coin).alias("top"))
    return reached.select(F.explode(F.sequence(F.lit(0), F.col("top"))).alias("level"), key).select("level", (h60_seeded(F.col(key), F.col("level")) % size).cast("int").alias("bit")).distinct()


def cascade_estimate(keys: DataFrame, key: str, table: DataFrame, levels: int, size: int) -> DataFrame:
    """key, level, estimate: how many levels in a row hold the key, and 2^(level - 1)."""
    probe = keys.filter(F.col(key).isNotNull()).select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")).withColumn("bit", (h60_seeded(F.col(key), F.col("level")) % size).cast("int"))
    missed = probe.join(table.withColumn("hit", F.lit(1)), ["level", "bit"], "left").groupBy(key).agg(F.min(F.when(F.col("hit").isNull(), F.col("level"))).alias("miss"))
    held = F.coalesce("miss", F.lit(levels))
    return missed.select(key, held.alias("level"), F.when(held == 0, 0.0).otherwise(F.pow(F.lit(2.0), held - 1)).alias("estimate"))


def fingerprint_counts(df: DataFrame, key: str, bits: int, weight: str | None = None) -> DataFrame:
    """slot, cnt: counts by the lowest ``bits`` bits of the hash, which are quotient and remainder of a compact table."""
    return df.filter(F.col(key).isNotNull()).groupBy(h60(key).bitwiseAND((1 << bits) - 1).alias("slot")).agg((F.sum(weight) if weight else F.count("*")).alias("cnt"))


def added(a: DataFrame, b: DataFrame, keys: list[str], value: str = "cnt", sign: int = 1) -> DataFrame:
    """Cell-wise sum (or difference, with sign -1) of two tables."""
    return a.select(*keys, value).unionByName(b.select(*keys, (F.col(value) * sign).alias(value))).groupBy(*keys).agg(F.sum(value).alias(value))


def decaying_cells(df: DataFrame, key: str, order: str, rows: int = 2, width: int = 512, base: float = 1.08) -> DataFrame:
    """row, bucket, fp, cnt: cells that keep the fingerprint of a frequent key. A row of the same key adds one; one of
    another key takes one off with probability base^-cnt, by its hash, and moves in at 0.

    A cell only depends on its own rows, so cells are dealt to tasks and read one by one in order.
    """
    h = h60(key)
    rows_ = _rows(df.filter(F.col(key).isNotNull()).select(order, key, h.alias("h")), rows).select("row", _bucket(F.col(key), width).alias("bucket"), F.col("h").bitwiseAND(0xFFFF).alias("fp"), unit(h60(F.concat_ws("/", F.col(key).cast("string"), F.col(order).cast("string"), F.col("row").cast("string")), "coin")).alias("u"), order)
    dealt = rows_.repartition("row", "bucket").sortWithinPartitions("row", "bucket", order)

    def run(batches):
        own, fp, cnt = None, 0, 0
        for batch in batches:
            out = []
            for r, b, f, u in zip(batch["row"], batch["bucket"], batch["fp"], batch["u"]):
                if (r, b) != own:
                    if own is not None:
                        out.append((*own, fp, cnt))
                    own, fp, cnt = (r, b), f, 0
                if cnt == 0:
                    fp, cnt = f, 1
                elif f == fp:
                    cnt += 1
                elif u < base**-cnt:
                    cnt -= 1
                    if cnt == 0:
                        fp, cnt = f, 1
            yield pd.DataFrame(out, columns=["row", "bucket", "fp", "cnt"])
        if own is not None:
            yield pd.DataFrame([(*own, fp, cnt)], columns=["row", "bucket", "fp", "cnt"])

    return dealt.mapInPandas(run, "row int, bucket int, fp long, cnt long")


def decaying_estimate(keys: DataFrame, key: str, table: DataFrame, rows: int = 2, width: int = 512) -> DataFrame:
    """key, estimate: the largest count of a cell that holds the key's fingerprint, else 0."""
    looked = _rows(keys.filter(F.col(key).isNotNull()).select(key).distinct(), rows).withColumn("bucket", _bucket(F.col(key), width)).withColumn("fp", h60(key).bitwiseAND(0xFFFF))
    return looked.join(table, ["row", "bucket", "fp"], "left").groupBy(key).agg(F.max(F.coalesce("cnt", F.lit(0))).alias("estimate"))


def decaying_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of both tables: of one fingerprint the sum, of two the larger, less the smaller."""
    both = a.unionByName(b).groupBy("row", "bucket", "fp").agg(F.sum("cnt").alias("cnt"))
    w = Window.partitionBy("row", "bucket").orderBy(F.desc("cnt"), "fp")  # two rows at most
    ranked = both.withColumn("other", F.coalesce(F.lead("cnt").over(w), F.lit(0))).withColumn("rk", F.row_number().over(w))
    return ranked.filter((F.col("rk") == 1) & (F.col("cnt") > F.col("other"))).select("row", "bucket", "fp", (F.col("cnt") - F.col("other")).alias("cnt"))


def log_counters(df: DataFrame, key: str, row_id: str, rows: int, width: int) -> DataFrame:
    """row, bucket, level: counters that hold a logarithm: the largest number of leading zeros of their rows' coins, plus
    one. They merge by max."""
    coin = F.floor(-F.log2(unit(h60(F.col(row_id), "coin")))).cast("int") + 1
    top = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(coin).alias("level"))
    return _rows(top, rows).groupBy("row", _bucket(F.col(key), width).alias("bucket")).agg(F.max("level").alias("level"))


def log_estimate(keys: DataFrame, key: str, table: DataFrame, rows: int, width: int) -> DataFrame:
    """key, estimate: 2^(level - 1) of its least cell, 0 if one is empty."""
    looked = _rows(keys.filter(F.col(key).isNotNull()).select(key).distinct(), rows).withColumn("bucket", _bucket(F.col(key), width))
    level = F.min(F.coalesce("level", F.lit(0)))
    return looked.join(table, ["row", "bucket"], "left").groupBy(key).agg(F.when(level == 0, 0.0).otherwise(F.pow(F.lit(2.0), level - 1)).alias("estimate"))


def spectrum_table(df: DataFrame, key: str, sample: int, r: int) -> DataFrame:
    """half, slot, cnt: rows whose hash has ``sample`` leading zeros, counted by one more bit and the lowest r bits."""
    h = h60(key)
    seen = df.filter(F.col(key).isNotNull()).select(h.alias("h")).filter(F.shiftright("h", 60 - sample) == 0) if sample else df.filter(F.col(key).isNotNull()).select(h.alias("h"))
    return seen.groupBy(F.shiftright("h", 59 - sample).bitwiseAND(1).cast("int").alias("half"), F.col("h").bitwiseAND((1 << r) - 1).cast("int").alias("slot")).agg(F.count("*").alias("cnt"))


def spectrum(table: DataFrame, sample: int, r: int, most: int) -> DataFrame:
    """i, estimate: number of distinct keys (i = 0) and of keys that come i times, up to ``most``, from the shares p_i of slots
    with count i in the mean of both halves. The recurrence reads ``most`` + 1 numbers."""
    slots = float(1 << (r + 1))
    shares = table.filter(F.col("cnt") <= most).groupBy("cnt").agg((F.count("*") / slots).alias("p"))
    filled = table.agg((F.count("*") / slots).alias("filled"))
    bins = shares.agg(F.map_from_entries(F.collect_list(F.struct("cnt", "p"))).alias("p")).crossJoin(F.broadcast(filled))  # one row each

    @F.pandas_udf("array<double>")
    def solved(p: pd.Series, filled: pd.Series) -> pd.Series:
        out = []
        for shares_, full in zip(p, filled):
            own = {int(k): v for k, v in dict(shares_ or {}).items()}
            p0 = 1 - full
            if p0 <= 0 or p0 >= 1:
                out.append([0.0] * (most + 1))
                continue
            f = [0.0] * (most + 1)
            for i in range(1, most + 1):
                rest = sum(j * own.get(i - j, 0.0) * f[j] for j in range(1, i))
                f[i] = -own.get(i, 0.0) / (p0 * math.log(p0)) - rest / (i * p0)
            whole = -math.log(p0) * 2.0 ** (sample + r + 1)
            out.append([whole, *(abs(x) * whole for x in f[1:])])
        return pd.Series(out)

    return bins.select(F.posexplode(solved("p", "filled")).alias("i", "estimate"))


def running_key(df: DataFrame, key: str, order: list[str], transform: str | None = None) -> DataFrame:
    """Rows with unit_, the key and how often it came so far: a multiset as a set. With ``transform`` (sqrt, ln, log2) a key
    only counts when the transformed count grows."""
    turn = df.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    if transform:
        of = {"sqrt": lambda c: F.floor(F.sqrt(c)), "ln": lambda c: F.floor(F.ln(c)), "log2": lambda c: F.floor(F.log2(c))}[transform]
        turn = turn.withColumn("now_", of(F.col("turn"))).filter((F.col("turn") == 1) | (F.col("now_") > of(F.greatest(F.lit(1), F.col("turn") - 1)))).withColumn("turn", F.col("now_")).drop("now_")
    return turn.withColumn("unit_", F.concat_ws("#", F.col(key).cast("string"), F.col("turn").cast("string"))).drop("turn")
