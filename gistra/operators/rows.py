"""Summaries that a row has by itself: made where the row lies, so that nothing of its text is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from gistra.functions.hashing import BITS, h60, h60_texts, kmers, ngrams
from gistra.staging import cut

U = np.uint64
#: Words, and characters, that are worked on at once; a longer row is a run of its own.
AT_ONCE = 1 << 19


def apart(df: DataFrame, group: str, alone: Callable[[DataFrame], DataFrame], several: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``alone`` of the rows whose group has no other row, and ``several`` of the others. Null is a group."""
    again = cut(df.groupBy(F.col(group).alias("again_")).count().filter("count > 1").select("again_"), "again")
    if again.isEmpty():
        return alone(df)
    same = F.col(group).eqNullSafe(F.col("again_"))
    return alone(df.join(again, same, "left_anti")).unionByName(several(df.join(again, same, "left_semi")))


def _schema(df: DataFrame, group: str, **columns) -> StructType:
    return StructType([df.schema[group], *(StructField(n, t) for n, t in columns.items())])


def _texts_hash(points: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k code points: three of 21 bits to a number, mixed one after the other."""
    n = len(points) - k + 1
    h = np.full(n, 0x9E3779B97F4A7C15, U)
    for at in range(0, k, 3):
        for j in range(min(3, k - at)):
            h ^= points[at + j : at + j + n] << U(21 * j)
        for by, times in ((29, 0xBF58476D1CE4E5B9), (32, 0x94D049BB133111EB)):
            h *= U(times)
            h ^= h >> U(by)
    return h


def _kinds(text: bytes, k: int) -> int:
    """Different runs of k characters of a text."""
    points = np.frombuffer(text.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points) - k + 1
    if n <= 0:
        return 0
    h = np.empty(n, U)
    for at in range(0, n, AT_ONCE):
        h[at : at + AT_ONCE] = _texts_hash(points[at : at + AT_ONCE + k - 1].astype(U), k)
    h.sort()
    return 1 + int(np.count_nonzero(h[1:] != h[:-1]))


def kmer_kinds(df: DataFrame, group: str, text: str, k: int) -> DataFrame:
    """group, kinds: different substrings of k characters of each group's texts; groups without any have no row."""
    rows = df.filter(F.length(text) >= k).select(group, text)
    schema = _schema(rows, group, kinds=LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = [_kinds(x.as_buffer().to_pybytes(), k) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kinds, pa.int64())], names=[group, "kinds"])

    def alone(d: DataFrame) -> DataFrame:
        return d.select(group, F.col(text).cast("binary")).mapInArrow(run, schema)

    def several(d: DataFrame) -> DataFrame:
        return d.select(group, F.explode(kmers(F.col(text), k)).alias("kmer")).groupBy(group).agg(F.countDistinct(h60("kmer")).alias("kinds"))

    return apart(rows, group, alone, several)


def _runs(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """First row, lengths and the joined words of runs of rows that hold about ``AT_ONCE`` words, one row at least."""
    lists = batch.column(column)
    lens = np.array([0 if n is None else n for n in pc.list_value_length(lists).to_pylist()], np.int64)
    ends = np.cumsum(lens)
    begin = 0
    while begin < len(lens):
        before = ends[begin] - lens[begin]
        end = max(begin + 1, int(np.searchsorted(ends, before + AT_ONCE, "right")))
        yield begin, lens[begin:end], lists.slice(begin, end - begin).flatten()
        begin = end


def _occurrences(row: np.ndarray, code: np.ndarray) -> np.ndarray:
    """How often a row has had each of its words so far, this time included."""
    if not len(code):
        return code
    cell = row * (int(code.max()) + 1) + code
    order = np.argsort(cell, kind="stable")
    sorted_ = cell[order]
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    out = np.empty(len(code), np.int64)
    out[order] = np.arange(len(code)) - np.repeat(first, np.diff(np.r_[first, len(code)])) + 1
    return out


def _least(h: np.ndarray, row: np.ndarray, starts: np.ndarray, lens: np.ndarray, length: int) -> np.ndarray:
    """For each row the places of its ``length`` least hashes, in order of place; of equal ones the first. -1 where there are fewer."""
    top = np.iinfo(np.int64).max
    h, out = h.copy(), np.full((len(starts), length), top, np.int64)
    for i in range(length):
        low = np.minimum.reduceat(h, starts)
        at = np.flatnonzero((h == np.repeat(low, lens)) & (h < top))
        at = at[np.r_[True, row[at][1:] != row[at][:-1]]] if len(at) else at
        out[row[at], i] = at
        h[at] = top
    out.sort(axis=1)
    return np.where(out == top, -1, out)


def order_minima(words: DataFrame, group: str, words_col: str, slots: int, length: int) -> DataFrame:
    """group, slot, val: for rows of one group each, the hash of the ``length`` words of least hash (word and its
    occurrence), in text order. Words and occurrences that meet again nearby are hashed once."""
    schema = _schema(words, group, slot=IntegerType(), val=LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, all_lens, flat in _runs(b, 1):
                have = np.flatnonzero(all_lens)
                if not len(have):
                    continue
                lens = all_lens[have]
                row, starts = np.repeat(np.arange(len(have)), lens), np.r_[0, np.cumsum(lens)[:-1]]
                coded = pc.dictionary_encode(flat)
                code, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), [n.encode() for n in coded.dictionary.to_pylist()]
                occ = _occurrences(row, code)
                most = int(occ.max()) + 1
                pair, back = np.unique(code * most + occ, return_inverse=True)
                texts = [b"%b#%d" % (names[p // most], p % most) for p in pair.tolist()]
                vals = []
                for h in h60_texts(texts, list(range(slots))):
                    at = _least(h[back], row, starts, lens, length)
                    vals.extend(h60_texts([b" ".join([names[c] for c, p in zip(cs, ps) if p >= 0]) for cs, ps in zip(code[at].tolist(), at.tolist())]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(np.tile(begin + have, slots))), pa.array(np.repeat(np.arange(slots, dtype=np.int32), len(have))), pa.array(np.concatenate(vals))], names=[group, "slot", "val"]
                )

    return words.select(group, words_col).mapInArrow(run, schema)


def gram_minima(words: DataFrame, group: str, words_col: str, n: int, p: int) -> DataFrame:
    """group, reg, val: one-permutation minima of the runs of n words of each group, made row by row and merged."""
    schema = _schema(words, group, reg=IntegerType(), val=LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, lens, flat in _runs(b, 1):
                w, stop = flat.cast(pa.binary()).to_pylist(), np.cumsum(lens).tolist()
                counts = np.maximum(lens - n + 1, 0)
                texts: list[bytes] = []
                for end, count in zip(stop, lens.tolist()):
                    own = w[end - count : end]
                    texts.extend(map(b" ".join, zip(*(own[i:] for i in range(n)))))
                if not texts:
                    continue
                h = next(h60_texts(texts))
                cell = (np.repeat(np.arange(len(lens)), counts) << p) + (h >> (BITS - p))
                low = np.full(len(lens) << p, -1, np.int64)
                order = np.argsort(-h)  # the least comes last and stays
                low[cell[order]] = h[order] & ((1 << (BITS - p)) - 1)
                at = np.flatnonzero(low >= 0)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(begin + (at >> p))), pa.array((at & ((1 << p) - 1)).astype(np.int32)), pa.array(low[at])], names=[group, "reg", "val"])

    rows = words.select(group, words_col).mapInArrow(run, schema)
    return rows.groupBy(group, "reg").agg(F.min("val").alias("val"))


def gram_counts(words: DataFrame, group: str, words_col: str, n: int) -> DataFrame:
    """group, n, kinds: runs of n words of each group, and how many of them differ; groups without any have no row."""
    rows = words.filter(F.size(words_col) >= n).select(group, ngrams(F.col(words_col), n).alias("grams_"))

    def alone(d: DataFrame) -> DataFrame:
        return d.select(group, F.size("grams_").cast("bigint").alias("n"), F.size(F.array_distinct("grams_")).cast("bigint").alias("kinds"))

    def several(d: DataFrame) -> DataFrame:
        return d.select(group, F.explode("grams_").alias("gram")).groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(h60("gram")).alias("kinds"))

    return apart(rows, group, alone, several)
