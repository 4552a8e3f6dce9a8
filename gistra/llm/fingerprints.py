"""Document fingerprints: I-Match over several randomised subsets of a lexicon.

The lexicon has the terms whose inverse document frequency, counted over all documents, lies within a band.
A document keeps its distinct terms of the lexicon, sorted; for each of ``LEVELS`` x ``SEEDS`` random
subsets of the lexicon those in the subset are hashed. Subsets of several densities serve short and long
documents. The likeness of two fingerprints is the share of equal hashes at the density where it is largest,
among the subsets that aren't empty for both (at least ``LEAST`` of them; else over all densities).

Scale: term counts are pre-aggregated in each task, then summed by term. A term of the lexicon is in
``LOW`` of all documents or more, so the lexicon has at most (mean distinct terms of a document) / LOW
terms, however large the corpus is: that is what is broadcast.
Neighbours by id come from one range shuffle; only the last row of each range meets another range's first,
two rows for a range.

Defined cases: null texts are empty; texts without terms in the band have an empty fingerprint, and two of
them have likeness 1; equal texts have equal fingerprints; equal ids are ordered by a hash of the text, null ids come
first; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistra.llm.text import column, slices
from gistra.staging import cut, discard

LOW, HIGH = 0.004, 0.2
LEVELS, SEEDS, LEAST = (1 / 4, 1 / 16, 1 / 64, 1 / 256), 8, 3
FLUSH_TERMS, CACHE_WORDS = 400_000, 400_000

_terms = re.compile(r"[^\W_]+").findall


class Hashes(dict):
    """Signed 64-bit hashes of terms, remembered."""

    def __missing__(self, term: str) -> int:
        h = xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass"))
        h = self[term] = h - (1 << 64) if h >> 63 else h
        return h

    def of(self, text: str) -> np.ndarray:
        """Hashes of the distinct terms, sorted."""
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.sort(np.fromiter(map(self.__getitem__, set(_terms(text.lower()))), np.int64))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df) over all documents; terms as hashes."""

    def run(batches):
        hashes, count = Hashes(), Counter()
        schema = pa.schema([("term", pa.int64()), ("df", pa.int64())])
        take = lambda: pa.RecordBatch.from_arrays([pa.array(list(count), pa.int64()), pa.array(list(count.values()), pa.int64())], schema=schema)
        for batch in batches:
            for part in slices(batch, text_col):
                for t in column(part, text_col).to_pylist():
                    if t:
                        count.update(hashes.of(t).tolist())
                if len(count) > FLUSH_TERMS:
                    yield take()
                    count.clear()
        yield take()

    return docs.select(text_col).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Sorted hashes of the terms in at least ``low`` and at most ``high`` of all documents (and in two)."""
    n = docs.count()
    band = cut(document_frequencies(docs, text_col).filter((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= high * n)).select("term"), "lexicon")
    rows = band.collect()
    discard(band)
    return np.sort(np.array([r[0] for r in rows], np.int64))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers with well-spread bits."""
    x = x.astype(np.uint64)
    for shift, factor in ((32, 0x9E3779B97F4A7C15), (29, 0xD6E8FEB86659FD93)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


class Maker:
    def __init__(self, words: np.ndarray):
        self.words, self.hashes = words, Hashes()
        self.seeds = np.arange(1, len(LEVELS) * SEEDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
        self.limits = np.repeat([np.uint64(int(q * (1 << 53)) << 11) for q in LEVELS], SEEDS).astype(np.uint64)

    def __call__(self, text: str) -> np.ndarray:
        """The subsets' 32-bit hashes, 0 for an empty subset."""
        terms = self.hashes.of(text)
        if len(terms) and len(self.words):
            at = np.minimum(np.searchsorted(self.words, terms), len(self.words) - 1)
            terms = terms[self.words[at] == terms]
        else:
            terms = terms[:0]
        if not len(terms):
            return np.zeros(len(self.seeds), ">u4")
        inside = _mixed(terms.view(np.uint64)[None, :] ^ self.seeds[:, None]) < self.limits[:, None]
        return np.array([xxhash.xxh32_intdigest(terms[row].tobytes()) or 1 if row.any() else 0 for row in inside], ">u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if (a == b).all():
        return 1.0
    filled = ((a != 0) | (b != 0)).reshape(-1, SEEDS)
    same = (a == b).reshape(-1, SEEDS) & filled
    n, equal = filled.sum(1), same.sum(1)
    best = (equal[n >= LEAST] / n[n >= LEAST]).max(initial=0.0)
    return float(max(best, equal.sum() / n.sum()))


def edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprint_neighbours(docs: DataFrame, words: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its text edited with the next document's."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(words)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType.simpleString()
    result = f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"

    def compare(maker, text, fp, following, following_fp):
        new = edited(text, following)
        new_fp = fp if new == text else maker(new)
        return len(text), hashlib.sha256(new.encode("utf-8")).hexdigest(), fp.tobytes(), new_fp.tobytes(), likeness(fp, new_fp), likeness(fp, following_fp)

    kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def pairs(batches):
        maker, part_no, held = Maker(shared.value), TaskContext.get().partitionId(), None
        schema = None

        def rows(out):
            ids = pa.array([r[0] for r in out], schema)
            return pa.RecordBatch.from_arrays([ids, *[pa.array([r[i + 1] for r in out], k) for i, k in enumerate([*kinds, pa.int32(), pa.int32(), pa.string()])]], [*names, "edge", "part", "text"])

        none = (None,) * 6
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                schema = column(part, "id").type
                for i, t in zip(column(part, "id").to_pylist(), column(part, "text").to_pylist()):
                    fp = maker(t)
                    if held is None:
                        out.append((i, *none, 1, part_no, t))
                    else:
                        out.append((held[0], *compare(maker, held[1], held[2], t, fp), 0, part_no, None))
                    held = (i, t, fp)
                yield rows(out)
        if held is not None:
            yield rows([(held[0], *none, 2, part_no, held[1])])

    ordered = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranged = ordered.repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    done = cut(ranged.mapInArrow(pairs, f"{result}, edge int, part int, text string"), "neighbours")
    # two rows for each range: its first and its last
    edges = done.filter("edge > 0").select(F.col(id_col).alias("id"), "edge", "part", "text")
    first = edges.filter("edge = 1").orderBy("part").limit(1).select(F.col("text").alias("very_first"))
    # numbers of ranges are put in order, texts are joined to them
    order = Window.orderBy("part", "edge")
    after = edges.select("part", "edge").withColumn("next", F.lead("part").over(order)).filter("edge = 2").select(F.col("part").alias("own"), "next")
    heads = edges.filter("edge = 1").select(F.col("part").alias("next"), F.col("text").alias("following"))
    ends = edges.filter("edge = 2").withColumnRenamed("part", "own").join(after, "own").join(heads, "next", "left")
    open_ends = ends.crossJoin(F.broadcast(first)).select("id", "text", F.coalesce("following", "very_first").alias("following"))

    def close(batches):
        maker = Maker(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                out = [compare(maker, t, maker(t), f, maker(f)) for t, f in zip(column(part, "text").to_pylist(), column(part, "following").to_pylist())]
                yield pa.RecordBatch.from_arrays([column(part, "id"), *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]], names)

    every = done.filter("edge = 0").select(*names).unionByName(open_ends.mapInArrow(close, result))
    return every.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fingerprint_neighbours(docs, lexicon(docs))
