"""Bounded, documented training samples for the classifiers; everything is scored, only fitting samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, held_out: int, per_class: int, text_col: str = "text", id_col: str = "doc_id", most_bytes: int = 200_000) -> list[tuple[str, int]]:
    """(text, label) of at most ``per_class`` labelled rows of each class outside the held-out fold.

    The rows are those with the smallest hash of their id, so the choice is the same at every size. The ids
    (2 * per_class at most) are broadcast, which keeps the documents from being shuffled. Null labels, ids
    without a document, repeated rows and texts of over ``most_bytes`` are passed over, so the sample has at most
    2 * per_class * most_bytes bytes.
    """
    usable = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & (fold(F.col("i"), folds) != held_out) & F.col("i").isNotNull()).distinct()
    order = F.xxhash64(F.lit("sample"), "i")
    picked = [usable.filter(F.col("y") == y).orderBy(order, "i").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).filter(F.octet_length("t") <= most_bytes).join(ids, "i").select("i", "t", "y").collect()
    seen = {(r["i"], r["y"]): r["t"] for r in sorted(rows, key=lambda r: (r["i"], r["t"]))}
    return [(t, y) for (i, y), t in sorted(seen.items())]
