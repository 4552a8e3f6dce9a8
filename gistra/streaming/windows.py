"""Stream summaries: Structured Streaming over event files, run to the end of what is there.

Results go to Parquet in the shared folder, a folder for each micro-batch, and never to the driver: in update mode
a key's last row counts, in complete mode the last batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistra.functions.hashing import h60, rank, register
from gistra.staging import fresh_path


def events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the file or folder ``path``."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name if "." in name else "*").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def run(result: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """The state at the end of the stream, as a table: the rows of the last batch (complete) or each key's last row (update)."""
    spark = result.sparkSession
    where, state = fresh_path(spark, "stream"), fresh_path(spark, "checkpoint")
    # a batch that is run again overwrites its own folder
    q = result.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{where}/batch={n}")).trigger(availableNow=True).start()
    q.awaitTermination()
    batches = spark.read.schema(f"{_ddl(result)}, batch bigint").option("basePath", where).parquet(where)
    if mode == "complete":
        return batches.join(batches.agg(F.max("batch").alias("batch")), "batch").drop("batch")
    rest = [c for c in result.columns if c not in keys]
    last = batches.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last_"))
    return last.select(*keys, *(F.col(f"last_.{c}").alias(c) for c in rest))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def tumbling(spark: SparkSession, path: str, width: str, late: str = "365 days") -> DataFrame:
    """start, event_type, n: counts of every window; rows later than ``late`` behind the newest are passed over."""
    counts = events(spark, path).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return run(counts.select(F.col("w.start").alias("start"), "event_type", "n"), "update", ["start", "event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


def sessions(spark: SparkSession, path: str, gap: str) -> DataFrame:
    """user_id, start, n: runs of a user's events with less than ``gap`` between them."""
    counts = events(spark, path).filter("user_id IS NOT NULL").groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return run(counts.select("user_id", F.col("w.start").alias("start"), "n"), "complete", []).withColumn("start", F.col("start").cast("timestamp_ntz"))


def registers(spark: SparkSession, path: str, p: int) -> DataFrame:
    """g, reg, val: largest-rank registers of users by event type, kept up on the stream."""
    h = h60("user_id")
    table = events(spark, path).filter("user_id IS NOT NULL").groupBy(F.col("event_type").alias("g"), register(h, p).alias("reg")).agg(F.max(rank(h, p)).alias("val"))
    return run(table, "update", ["g", "reg"])


def hip(spark: SparkSession, path: str, p: int) -> DataFrame:
    """g, estimate: the running distinct count. The stream keeps each register's first row of each rank, from which every rise
    of the estimate follows."""
    from gistra.operators.registers import risen

    h = h60("user_id")
    first = events(spark, path).filter("user_id IS NOT NULL").groupBy(F.col("event_type").alias("g"), register(h, p).alias("reg"), rank(h, p).alias("val")).agg(F.min("event_id").alias("at"))
    return risen(run(first, "update", ["g", "reg", "val"]), "g", p)


def decayed(spark: SparkSession, path: str, half_life: float) -> DataFrame:
    """event_type, weight: counts that halve every ``half_life`` of event ids, summed on the stream."""
    weights = events(spark, path).groupBy("event_type").agg(F.sum(F.pow(F.lit(0.5), F.col("event_id") / half_life)).alias("weight"))
    return run(weights, "update", ["event_type"]).withColumn("weight", F.round("weight", 6))
