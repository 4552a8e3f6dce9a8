"""Point counts, heavy hitters and join sizes from count tables (row, bucket, cnt) that merge by sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistra.functions.hashing import h60, h60_seeded


def _rows(df: DataFrame, rows: int) -> DataFrame:
    return df.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))


def _bucket(key: Column, width: int) -> Column:
    return (h60_seeded(key, F.col("row")) % width).cast("int")


def _sign(key: Column) -> Column:
    return F.when(h60_seeded(key, F.col("row") + 1000) % 2 == 0, 1).otherwise(-1)


def count_min(df: DataFrame, key: str, rows: int = 4, width: int = 256, weight: str | None = None) -> DataFrame:
    """row, bucket, cnt. Keys are counted first, so hashing is done once for a key and task."""
    totals = df.filter(F.col(key).isNotNull()).groupBy(key).agg((F.sum(weight) if weight else F.count("*")).alias("w"))
    return _rows(totals, rows).groupBy("row", _bucket(F.col(key), width).alias("bucket")).agg(F.sum("w").alias("cnt"))


def count_min_estimate(keys: DataFrame, key: str, table: DataFrame, rows: int = 4, width: int = 256) -> DataFrame:
    """key, estimate: the least of its cells."""
    looked = _rows(keys.select(key).distinct(), rows).withColumn("bucket", _bucket(F.col(key), width))
    return looked.join(table, ["row", "bucket"], "left").groupBy(key).agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))


def signed_counts(df: DataFrame, key: str, rows: int = 5, width: int = 256, weight: str | None = None) -> DataFrame:
    """row, bucket, cnt with hashed signs; weights may be negative (subtraction)."""
    totals = df.filter(F.col(key).isNotNull()).groupBy(key).agg((F.sum(weight) if weight else F.count("*")).alias("w"))
    return _rows(totals, rows).groupBy("row", _bucket(F.col(key), width).alias("bucket")).agg(F.sum(_sign(F.col(key)) * F.col("w")).alias("cnt"))


def signed_estimate(keys: DataFrame, key: str, table: DataFrame, rows: int = 5, width: int = 256) -> DataFrame:
    """key, estimate: the median of its signed cells."""
    looked = _rows(keys.select(key).distinct(), rows).withColumn("bucket", _bucket(F.col(key), width))
    cells = looked.join(table, ["row", "bucket"], "left")
    return cells.groupBy(key).agg(F.median(_sign(F.col(key)) * F.coalesce("cnt", F.lit(0))).alias("estimate"))


def combine(a: DataFrame, b: DataFrame, how: str = "sum") -> DataFrame:
    """Cell-wise sum, difference or minimum of two tables."""
    both = a.select("row", "bucket", F.col("cnt").alias("x")).join(b.select("row", "bucket", F.col("cnt").alias("y")), ["row", "bucket"], "full")
    x, y = F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))
    return both.select("row", "bucket", {"sum": x + y, "difference": x - y, "min": F.least(x, y)}[how].alias("cnt"))


def fold(table: DataFrame, width: int) -> DataFrame:
    """Narrower table: width must divide the present one."""
    return table.groupBy("row", (F.col("bucket") % width).cast("int").alias("bucket")).agg(F.sum("cnt").alias("cnt"))


def l2(table: DataFrame) -> DataFrame:
    """One row, l2: root of the median row's sum of squares."""
    return table.groupBy("row").agg(F.sum(F.col("cnt") * F.col("cnt")).alias("s")).agg(F.round(F.sqrt(F.median("s")), 6).alias("l2"))


def join_size(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, join_size: median over rows of the cells' products."""
    x, y = a.select("row", "bucket", F.col("cnt").alias("x")), b.select("row", "bucket", F.col("cnt").alias("y"))
    return x.join(y, ["row", "bucket"]).groupBy("row").agg(F.sum(F.col("x") * F.col("y")).alias("s")).agg(F.median("s").alias("join_size"))


def top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """key, cnt of the k commonest keys by exact counts; ties by hash, then key. ``frequency.decaying_cells`` is the summary."""
    return df.groupBy(key).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), h60(key), key).limit(k)


def heavy_hitters(df: DataFrame, key: str, theta: float) -> DataFrame:
    """key, cnt of the keys with at least theta of all rows, by exact counts."""
    counts = df.groupBy(key).agg(F.count("*").alias("cnt"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("cnt").alias("total_")))).filter(F.col("cnt") >= theta * F.col("total_")).select(key, "cnt")


def running_count(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows with seen: how often the key came before, in the order given."""
    return df.withColumn("seen", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def decayed(df: DataFrame, key: str, age: str, half_life: float) -> DataFrame:
    """key, weight: counts that halve every ``half_life`` of the column ``age``, in closed form, a number for each key."""
    return df.groupBy(key).agg(F.round(F.sum(F.pow(F.lit(0.5), F.col(age) / half_life)), 6).alias("weight"))


def signed_by(df: DataFrame, h: Column, weight: Column, width: int) -> DataFrame:
    """bucket, cnt: one row of signed, weighted counts; a hash of its own gives bucket (its remainder) and sign (bit 40)."""
    sign = F.when(F.shiftright("h_", 40).bitwiseAND(1) == 0, 1).otherwise(-1)
    keyed = df.select(h.alias("h_"), weight.alias("w_")).groupBy("h_").agg(F.sum("w_").alias("w_"))
    return keyed.groupBy((F.col("h_") % width).cast("int").alias("bucket")).agg(F.sum(sign * F.col("w_")).alias("cnt"))


def last_n(df: DataFrame, key: str, order: list[str], n: int, group: str) -> DataFrame:
    """key, cnt within the last n rows of each group, exact; ``last_n_signed`` is the table of signed counts."""
    w = Window.partitionBy(group).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("back_", F.row_number().over(w)).filter(F.col("back_") <= n).groupBy(group, key).agg(F.count("*").alias("cnt"))


def last_n_signed(df: DataFrame, key: str, order: list[str], n: int, group: str, rows: int = 5, width: int = 256) -> DataFrame:
    """group, row, bucket, cnt: signed counts of the last n rows of each group: what leaves the window is never counted."""
    recent = last_n(df, key, order, n, group)
    return _rows(recent, rows).groupBy(group, "row", _bucket(F.col(key), width).alias("bucket")).agg(F.sum(_sign(F.col(key)) * F.col("cnt")).alias("cnt"))
