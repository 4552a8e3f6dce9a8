"""Best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the largest length are cut into pieces. Pieces, from the longest down, go to the open
bin that they fill best; if none has room, a bin is opened whose length costs least for each unit it will
hold (a bin costs its length plus ``OVERHEAD``; it can fill up to what is left to pack). At the end each bin
shrinks to the smallest permitted length that holds its contents.

Units are UTF-8 bytes, the tokens of a byte-level model, unless a length column is given.

Scale: the items (id and length, no text) are written once and dealt by a hash of id, text and how often both
came before to shards of about ``SHARD_UNITS`` units, so that the number of shards grows with the corpus and a shard never
does, whatever repeats, and equal tables are packed alike whatever their files and partitions. A shard wastes one partly filled bin at most, and that one shrinks too.

Defined cases: empty and null texts are pieces of length 0 and take no room; null ids are packed as any; repeated
rows are packed each for itself; ties go to the earlier bin; an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistra.staging import cut

LENGTHS = (1024, 2048, 4096, 8192, 16384)
OVERHEAD, SHARD_UNITS, SHARD_ROWS = 64, 2_000_000, 5_000


def best_fit(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, offset of each item, final length of each bin); sizes are at most the largest length."""
    lengths = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    left = sum(sizes)
    room: list[tuple[int, int]] = []  # (free units, bin), sorted
    used: list[int] = []
    where, offset = [0] * len(sizes), [0] * len(sizes)
    for i in order:
        n = sizes[i]
        k = bisect_left(room, (n, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            free = min((c for c in lengths if c >= n), key=lambda c: ((c + OVERHEAD) / max(min(c, left), 1), c))
            b = len(used)
            used.append(0)
        where[i], offset[i] = b, used[b]
        used[b] += n
        left -= n
        insort(room, (free - n, b))
    return where, offset, [next(c for c in lengths if c >= u) for u in used]


def pack(docs: DataFrame, lengths: Sequence[int] = LENGTHS, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, shard_units: int = SHARD_UNITS) -> DataFrame:
    """Pieces in bins: id, piece_start, piece_len, bin_id, bin_offset and bin_len (all in units)."""
    top = max(lengths)
    size = F.coalesce(F.col(length_col).cast("long") if length_col else F.octet_length(text_col).cast("long"), F.lit(0).cast("long"))
    # rows that are the same can be told apart by a number only: they are counted and spread again
    kinds = docs.select(F.col(id_col).alias("id"), size.alias("n"), F.xxhash64(text_col).alias("h")).groupBy("id", "n", "h").agg(F.count("*").alias("rows"))
    items = cut(kinds.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).select("id", "n", F.xxhash64("id", "h", "turn").alias("row")), "items")
    sums = items.agg(F.sum("n").alias("units"), F.sum(F.greatest(F.ceil(F.col("n") / top), F.lit(1))).alias("pieces")).first()
    shards = max(1, -(-(sums["units"] or 0) // shard_units), -(-(sums["pieces"] or 0) // SHARD_ROWS))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(top).cast("long")))
    pieces = items.select("id", "row", "n", starts.alias("start")).withColumn("len", F.least(F.col("n") - F.col("start"), F.lit(top)))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "start"), F.lit(shards)))
    fixed = list(lengths)

    def run(rows):
        rows = rows.sort_values(["row", "start"], ignore_index=True)
        where, offset, final = best_fit(rows["len"].tolist(), fixed)
        rows["bin_id"] = rows["shard"] * (1 << 20) + where
        rows["bin_offset"], rows["bin_len"] = offset, [final[b] for b in where]
        rows.columns = [{"start": "piece_start", "len": "piece_len"}.get(c, c) for c in rows.columns]
        return rows[["id", "piece_start", "piece_len", "bin_id", "bin_offset", "bin_len"]]

    kind = docs.schema[id_col].dataType.simpleString()
    packed = dealt.select("id", "row", "start", "len", "shard").groupBy("shard").applyInPandas(run, f"id {kind}, piece_start long, piece_len long, bin_id long, bin_offset long, bin_len long")
    return packed.withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
