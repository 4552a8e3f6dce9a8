"""N-gram Jaccard self-join by count vectors: links of documents whose shingle sets are alike, and their components.

A document is the set of its distinct word shingles. Hashing shingles into groups makes it a point of group
counts, and for two documents the summed coordinate minima bound the overlap from above. Points are searched
with a tree in two tiers.

Tier 1 deals points to cells, and drops those that can have no partner. A document's head is the smallest of its
shingles in one order of hashes: as many as a linked set can lack, and ``extra`` more. Two linked sets then share
at least ``extra`` shingles of their heads. A shingle that one set alone has can't be among them, so a set
with fewer shared shingles in its head has no link: nearly all documents that only quote a common passage
go here. What is left puts its shared shingles in order of rarity and is dealt to the rarest of them, again all but
``extra`` less one: two linked sets still meet, and meet where few others do. Cells with the same members are one.

Tier 2 is an R-tree within a cell: nodes of near points with their coordinate maxima. Nodes and then points whose
summed minima are below the overlap needed are dropped, in steps: by sums of coordinates, by ``GROUPS`` of them, and by
points of n to 2 n coordinates, which tell near copies short of the threshold from links. Pairs that all bounds leave become
rows, each in the least of its common cells only, and are verified on whole sets. No link is lost, and one way serves all thresholds and cell sizes.

Links are wanted as components, so not all pairs of a cell of copies are looked at. Equal sets are one class
from the start. In each of ``ROUNDS`` rounds every class meets one pivot of the cells that hold more than
one component, and verified links join components; what is then still in cells with several components goes
through the R-tree, all pairs of different components, in blocks of bounded size.

Scale: shuffles carry 8-byte hashes, n / 5 to 3 n / 10 for a document of n shingles; sets are made and moved only
of classes that tier 1 leaves. Cells are aggregated before their members are joined, the join is
splittable when skewed, and R-tree blocks are bounded. Labels move by joins, never to the driver.

Defined cases: null and wordless texts have an empty set and no links; texts shorter than a shingle are one
shingle; rows with equal ids are documents of equal id (the smallest id of a component is its name); null ids are
kept; an empty table gives an empty result; extra columns are dropped by ``components`` and kept by ``keep_one``.
A class is known by a 64-bit hash of its set: for N different sets the chance that any two are taken as equal is about
N^2 / 2^65, and the same holds for cells that are taken to have equal members.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gistra.llm.text import column, ensure_unique, slices, utf8
from gistra.staging import cut, discard

GROUPS, FOLD, LEAF, BLOCK, ROUNDS, PASSES = 128, 4, 16, 1024, 3, 2
PAIRS_AT_ONCE, NUMBERS_AT_ONCE, FILTER_BITS = 100_000, 1 << 20, 27
U = np.uint64


class Terms(NamedTuple):
    """Links: 100 * intersection >= percent * union of the sets of ``words``-word shingles."""

    words: int = 3
    percent: int = 90

    def needed(self, total):
        """Least overlap of two linked sets with ``total`` shingles together: ceil(p * total / (100 + p))."""
        return -(-self.percent * total // (100 + self.percent))

    def smallest(self, n: int) -> int:
        return -(-self.percent * n // 100)

    def largest(self, n: int) -> int:
        return 100 * n // self.percent

    def extra(self, n: int) -> int:
        """How many shared shingles the heads of linked sets of ``n`` or more shingles have at least."""
        return max(1, n // 10)

    def head(self, n: int) -> int:
        return min(n, n - self.smallest(n) + self.extra(n))

    def shared(self, n: Column) -> Column:
        """``extra`` of the smallest set that a set of ``n`` shingles can link with."""
        return F.greatest(F.lit(1), F.floor(F.ceil(self.percent * n / 100) / 10)).cast("int")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; A-Z are folded, words are split at ASCII blanks."""
    split = [t.lower().split() for t in texts]
    known: dict[bytes, int] = {}
    for ws in split:
        for w in ws:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
    out = []
    for ws in split:
        if not ws:
            out.append(np.zeros(0, U))
            continue
        h = np.fromiter(map(known.__getitem__, ws), U, len(ws))
        k = min(words, len(ws))
        # words are hashed already: a polynomial of them keeps their order, one mix spreads it
        x = h[: len(h) - k + 1] + U(k)
        for i in range(1, k):
            x = x * U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
        out.append(np.unique(mixed(x)))
    return out


def head(u: np.ndarray, terms: Terms) -> np.ndarray:
    """The smallest shingles of a sorted set, as cells."""
    return u[: terms.head(len(u))].view(np.int64)


def class_key(u: np.ndarray) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(u.tobytes())], U).view(np.int64)[0])


def points(docs: DataFrame, terms: Terms, id_col: str, text_col: str) -> DataFrame:
    """id, n, class key and head (once for a class in each task, else null) of each document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, text_col):
                sets = shingle_sets(utf8(part, text_col), terms.words)
                keys = [class_key(u) for u in sets]
                heads = []
                for u, k in zip(sets, keys):
                    heads.append(None if k in seen else head(u, terms))
                    seen.add(k)
                if len(seen) > 1_000_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([column(part, id_col), pa.array([len(u) for u in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array(heads, pa.list_(pa.int64()))], ["id", "n", "key", "cells"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n long, key long, cells array<bigint>")


def packed(counts: np.ndarray) -> bytes:
    """A point's coordinates, a byte each if they fit, else four."""
    return counts.astype("<u1" if counts.max() < 256 else "<u4").tobytes()


def _vectors(values: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(v, "<u1" if len(v) == GROUPS else "<u4") for v in values]).astype(np.int32)


def bounded(pairs: DataFrame, terms: Terms) -> DataFrame:
    """Pairs (a, b) with both points (n_a, c_a, n_b, c_b) whose summed minima reach the overlap needed."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                bound = np.minimum(_vectors(column(batch, "c_a").to_pylist()), _vectors(column(batch, "c_b").to_pylist())).sum(1)
                total = column(batch, "n_a").to_numpy() + column(batch, "n_b").to_numpy()
                ok = pa.array(bound >= terms.needed(total))
                yield pa.RecordBatch.from_arrays([column(batch, "a").filter(ok), column(batch, "b").filter(ok), pa.array(bound, pa.int64()).filter(ok)], ["a", "b", "bound"])

    return pairs.mapInArrow(run, "a long, b long, bound long")


def fine_point(u: np.ndarray) -> bytes:
    """A point of n to 2 n coordinates, a power of two; the first byte is a coordinate's width."""
    groups = 1 << max(7, len(u).bit_length())
    counts = np.bincount((u & U(groups - 1)).astype(np.int64), minlength=groups)
    width = 1 if counts.max() < 256 else 4
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _fine_points(values: pa.Array) -> list[np.ndarray]:
    out = []
    for v in values:
        v = v.as_buffer()
        out.append(np.frombuffer(v, f"<u{v[:1].to_pybytes()[0]}", offset=1))
    return out


def summed_minima(points_: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Summed coordinate minima of the points numbered ``x`` and ``y``, ``NUMBERS_AT_ONCE`` coordinates at a time."""
    out = np.zeros(len(x), np.int64)
    step = max(1, NUMBERS_AT_ONCE // points_.shape[1])
    for k in range(0, len(x), step):
        out[k : k + step] = np.minimum(points_[x[k : k + step]], points_[y[k : k + step]]).sum(1)
    return out


def fine_bounds(fine: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Summed minima of the points numbered ``x`` and ``y``; the finer of two is summed to the coarser."""
    out = np.zeros(len(x), np.int64)
    sizes = np.fromiter(map(len, fine), np.int64, len(fine))
    least = np.minimum(sizes[x], sizes[y])
    for size in np.unique(least):
        runs = [np.flatnonzero(least == size)]
        while runs:
            at = runs.pop()
            rows = np.unique(np.concatenate([x[at], y[at]]))
            if len(rows) * size > 4 * NUMBERS_AT_ONCE and len(at) > 1:
                runs += [at[: len(at) // 2], at[len(at) // 2 :]]
                continue
            points_ = np.stack([fine[r].reshape(-1, size).sum(0, dtype=np.int32) for r in rows])
            out[at] = summed_minima(points_, np.searchsorted(rows, x[at]), np.searchsorted(rows, y[at]))
    return out


def finely_bounded(pairs: DataFrame, sets: DataFrame, terms: Terms) -> DataFrame:
    """Pairs (a, b) whose fine points still allow the overlap needed; the finer of two is summed to the coarser."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                fine, every = _fine_points(column(batch, "f_a")) + _fine_points(column(batch, "f_b")), np.arange(batch.num_rows)
                total = column(batch, "n_a").to_numpy() + column(batch, "n_b").to_numpy()
                ok = pa.array(fine_bounds(fine, every, every + batch.num_rows) >= terms.needed(total))
                yield pa.RecordBatch.from_arrays([column(batch, "a").filter(ok), column(batch, "b").filter(ok)], ["a", "b"])

    side = lambda s: sets.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col("fine").alias(f"f_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, terms: Terms) -> DataFrame:
    """Of the pairs (a, b) those whose whole sets are linked, as a staged table."""
    left, right = sets.select(F.col("key").alias("a"), F.col("shingles").alias("s_a")), sets.select(F.col("key").alias("b"), F.col("shingles").alias("s_b"))

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(column(batch, "s_a"), column(batch, "s_b")):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= terms.percent * (len(x) + len(y) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([column(batch, "a").filter(ok), column(batch, "b").filter(ok)], ["a", "b"])

    return cut(pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long"), "verified")


def connected(edges: DataFrame) -> DataFrame:
    """(node, label), staged: the smallest node of each component, by neighbours' minima and pointer jumping."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = cut(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low")), "low")
        jump = low.join(low.select(F.col("node").alias("low"), F.col("low").alias("lower")), "low").select("node", F.least("low", "lower").alias("label"), F.col("label").alias("was"))
        jump = cut(jump, "labels")
        discard(labels, low)
        labels = jump
        if not jump.filter("label <> was").limit(1).count():
            discard(both)
            return labels


class Tree:
    """An R-tree of one level over points in order of size and then of their largest spread coordinates.

    Its coordinates are folded ones (sums of ``FOLD`` groups), which bound the overlap too, only less tightly.
    """

    def __init__(self, n: np.ndarray, folded: np.ndarray):
        spread = np.argsort(-folded.std(0), kind="stable")[:2]
        tile = n // max(1, int(n.mean()) // 16)
        self.order = np.lexsort((folded[:, spread[1]], folded[:, spread[0]], tile))
        begins = np.arange(0, len(n), LEAF)
        self.tops = np.maximum.reduceat(folded[self.order], begins)
        self.least = np.minimum.reduceat(n[self.order], begins)

    def reaching(self, n: np.ndarray, folded: np.ndarray, terms: Terms):
        """(query, point) numbers for which the leaf's maxima allow enough overlap, in bounded runs."""
        step = max(1, PAIRS_AT_ONCE // (LEAF * len(self.least)))
        for k in range(0, len(n), step):
            bound = np.minimum(folded[k : k + step, None], self.tops[None]).sum(2)
            q, leaf = np.nonzero(bound >= terms.needed(self.least[None] + n[k : k + step, None]))
            at = (leaf[:, None] * LEAF + np.arange(LEAF)).reshape(-1)
            ok = at < len(self.order)
            yield np.repeat(q + k, LEAF)[ok], self.order[at[ok]]


def _cell_pairs(n, comp, key, fine, here, there, terms: Terms, before=None):
    """Pairs of points, one of ``here`` and one of ``there``, of different components that survive the bounds. ``before`` gives
    the cells of a point that are less than this one: pairs that share one of them come from there."""
    counts = np.stack([f.reshape(-1, GROUPS).sum(0, dtype=np.int32) for f in fine])
    folded = counts.reshape(len(counts), -1, FOLD).sum(2)
    tree = Tree(n[there], folded[there])
    for q, p in tree.reaching(n[here], folded[here], terms):
        x, y = here[q], there[p]
        ok = comp[x] != comp[y]
        if here is there:
            ok &= key[x] < key[y]
        x, y = x[ok], y[ok]
        need = terms.needed(n[x] + n[y])
        ok = summed_minima(folded, x, y) >= need
        x, y, need = x[ok], y[ok], need[ok]
        ok = summed_minima(counts, x, y) >= need
        x, y, need = x[ok], y[ok], need[ok]
        ok = np.flatnonzero(fine_bounds(fine, x, y) >= need)
        if before is not None and len(ok):
            earlier = {i: before(i) for i in np.unique(np.concatenate([x[ok], y[ok]])).tolist()}
            ok = np.array([k for k, a, b in zip(ok.tolist(), x[ok].tolist(), y[ok].tolist()) if earlier[a].isdisjoint(earlier[b])], np.int64)
        yield np.minimum(key[x[ok]], key[y[ok]]), np.maximum(key[x[ok]], key[y[ok]])


def _block_pairs(terms: Terms):
    """For rows sorted by (cell, i, j): the surviving pairs of each such group. A group has two blocks of rows
    at most, and only the group that a batch breaks off is held over to the next."""
    fields = ["cell", "i", "j", "block", "key", "comp", "n", "fine", "cells"]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(table):
        if not table.num_rows:
            return
        cell, i, j, block, key, comp, n = (table.column(c).to_numpy() for c in fields[:-2])
        fine, cells = _fine_points(table.column("fine")), table.column("cells").combine_chunks()
        every, ends = cells.values.to_numpy(), cells.offsets.to_numpy()
        begins = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        for a, b in zip(begins, [*begins[1:], len(cell)]):
            own = slice(a, b)
            here = np.flatnonzero(block[own] == i[a])
            there = here if i[a] == j[a] else np.flatnonzero(block[own] == j[a])
            if len(here) and len(there):
                least = lambda k, a=a: every[ends[a + k] : ends[a + k + 1]]
                before = lambda k, a=a: set(least(k)[least(k) < cell[a]].tolist())
                for x, y in _cell_pairs(n[own], comp[own], key[own], fine[own], here, there, terms, before):
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], schema=schema)

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]).select(fields)
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            cell, i, j = (table.column(c).to_numpy() for c in ("cell", "i", "j"))
            last = np.flatnonzero((cell != cell[-1]) | (i != i[-1]) | (j != j[-1])) if len(cell) else []
            stop = int(last[-1]) + 1 if len(last) else 0
            yield from work(table.slice(0, stop))
            held = table.slice(stop)
        if held is not None:
            yield from work(held)

    return run


def in_shared_cells(rows: DataFrame) -> DataFrame:
    """Of rows (cell, key, n) those of cells that hold more than one class, with the number of rows there (size); a staged table."""
    shared = cut(rows.groupBy("cell").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("size")).filter("low <> high").select("cell", "size"), "shared")
    members = cut(probably_in(rows, "cell", shared.select(F.col("cell").alias("id"))).join(shared, "cell").select("cell", "key", "n", "size").distinct(), "members")
    discard(shared)
    return members


def meeting(rows: DataFrame, terms: Terms) -> DataFrame:
    """Staged table with (cell, key, n): where classes that may have a partner meet; ``rows`` has their heads."""
    members = in_shared_cells(rows)
    for _ in range(PASSES):
        # who shares too little of its head has no partner, and its cells may then have one class left
        live = members.groupBy("key").agg(F.max("n").alias("n_"), F.count("*").alias("live")).filter(F.col("live") >= terms.shared(F.col("n_"))).select("key")
        kept = cut(members.drop("size").join(live, "key"), "kept")
        discard(members)
        sizes = cut(kept.groupBy("cell").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
        members = cut(kept.join(sizes, "cell"), "members")
        discard(kept, sizes)
    rarest = Window.partitionBy("key").orderBy("size", "cell")
    rare = members.withColumn("turn", F.row_number().over(rarest)).withColumn("live", F.count("*").over(Window.partitionBy("key")))
    chosen = cut(rare.filter(F.col("turn") <= F.col("live") - terms.shared(F.col("n")) + 1).select("cell", "key", "n"), "rarest")
    discard(members)
    same = chosen.groupBy("cell").agg(F.bit_xor(F.xxhash64("key")).alias("sig"), F.count("*").alias("size")).filter("size > 1").groupBy("sig", "size").agg(F.min("cell").alias("cell"))
    same = cut(same.select("cell"), "same")
    merged = cut(chosen.join(same, "cell"), "met")
    discard(chosen, same)
    return merged


def probably_in(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows whose id may be one of ``ids`` (one column, ``id``): what can't be needs no shuffle.

    The ids' hashes set bits of a map of at most ``2 ** FILTER_BITS`` bits, which is what is broadcast, in
    pieces of 4 KB. Where ids are too many for the map it lets more rows pass and nothing is lost.
    """
    bits = max(15, min(FILTER_BITS, (16 * ids.count()).bit_length()))
    place = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - bits)
    at = place(F.col("id"))
    pieces = ids.select(F.shiftright(at, 15).alias("piece"), at.bitwiseAND(32767).alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("map"))
    here = rows.withColumn("place_", place(F.col(id_col))).withColumn("piece_", F.shiftright("place_", 15))
    found = here.join(F.broadcast(pieces), F.col("piece_") == F.col("piece"))
    byte = F.expr("ascii(decode(substring(map, cast((place_ & 32767) div 8 as int) + 1, 1), 'ISO-8859-1'))")
    return found.filter(F.expr("shiftleft(1, cast(place_ & 7 as int))").bitwiseAND(byte) != 0).select(*rows.columns)


def sets_of(docs: DataFrame, classes: DataFrame, terms: Terms, id_col: str, text_col: str) -> DataFrame:
    """Staged table with (key, n, counts, fine, shingles) of the classes (key, rep), from their representatives' texts."""
    schema = "key long, n long, counts binary, fine binary, shingles binary"

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t"):
                # a rep's id may be that of several rows: only the one with the class's set counts
                good = [(k, u) for k, u in zip(column(part, "key").to_pylist(), shingle_sets(utf8(part, "t"), terms.words)) if class_key(u) == k]
                counts = [packed(np.bincount((u & U(GROUPS - 1)).astype(np.int64), minlength=GROUPS)) for _, u in good]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in good], pa.int64()), pa.array([len(u) for _, u in good], pa.int64()), pa.array(counts, pa.binary()), pa.array([fine_point(u) for _, u in good], pa.binary()), pa.array([u.tobytes() for _, u in good], pa.binary())], ["key", "n", "counts", "fine", "shingles"])

    texts = probably_in(docs.select(F.col(id_col).alias("rep_id"), F.col(text_col).alias("t")), "rep_id", classes.select(F.col("rep").alias("id")))
    # repeated rows of a rep are one text
    chosen = texts.join(classes.select("key", F.col("rep").alias("rep_id")), "rep_id").select("key", "t")
    once = cut(chosen.mapInArrow(run, schema), "made")
    repeated = cut(once.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1").select("key"), "repeated")
    if not repeated.limit(1).count():
        return once
    several = once.join(repeated, "key", "left_semi").groupBy("key").agg(*(F.min(c).alias(c) for c in once.columns[1:]))
    out = cut(once.join(repeated, "key", "left_anti").unionByName(several), "sets")
    discard(once, repeated)
    return out


def class_labels(docs: DataFrame, profile: DataFrame, terms: Terms, id_col: str, text_col: str) -> DataFrame:
    """(key, comp), staged, of the classes that share a cell with another one; the rest are on their own."""
    spark = docs.sparkSession
    members = meeting(profile.filter("cells IS NOT NULL").select(F.explode("cells").alias("cell"), "key", F.col("n").cast("int").alias("n")), terms)
    if not members.limit(1).count():
        discard(members)
        return spark.createDataFrame([], "key long, comp long")
    inside = cut(members.select("key").distinct(), "inside")
    named = probably_in(profile.select("id", "key"), "key", inside.select(F.col("key").alias("id")))
    reps = cut(named.join(inside, "key").groupBy("key").agg(F.min("id").alias("rep")), "reps")
    sets = sets_of(docs, reps, terms, id_col, text_col)
    labels = cut(reps.select("key", F.col("key").alias("comp")), "comps")
    discard(inside, reps)
    point = lambda s: sets.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col("counts").alias(f"c_{s}"))

    def joined(labels, links):
        """Labels after the links (a, b) of classes; None if there are none."""
        own = lambda s: labels.select(F.col("key").alias(s), F.col("comp").alias(f"comp_{s}"))
        edges = cut(links.join(own("a"), "a").join(own("b"), "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")), "links")
        discard(links)
        if not edges.limit(1).count():
            discard(edges)
            return None
        moved = connected(edges)
        out = cut(labels.join(moved.select(F.col("node").alias("comp"), "label"), "comp", "left").select("key", F.coalesce("label", "comp").alias("comp")), "comps")
        discard(edges, moved, labels)
        return out

    kinds = labels.count()
    for turn in range(ROUNDS):
        placed = members.select("cell", "key", "n").join(labels, "key")
        pivots = placed.groupBy("cell").agg(F.min_by(F.struct("key", "comp", "n"), F.xxhash64(F.lit(turn), "key")).alias("pivot"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("cell", "pivot")
        # cells of one component are done with
        pivots = cut(pivots, "pivots")
        open_cells = cut(placed.join(pivots, "cell"), "open")
        discard(members, pivots)
        members = open_cells
        alike = 100 * F.least("n", "pivot.n").cast("long") >= terms.percent * F.greatest("n", "pivot.n").cast("long")
        pairs = open_cells.filter("comp <> pivot.comp").filter(alike).select(F.col("pivot.key").alias("a"), F.col("key").alias("b")).distinct()
        near = bounded(pairs.join(point("a"), "a").join(point("b"), "b"), terms)
        near = cut(finely_bounded(near.groupBy("b").agg(F.max_by("a", F.struct("bound", "a")).alias("a")), sets, terms), "near")
        links = verified(near, sets, terms)
        discard(near)
        found = joined(labels, links)
        if found is None:
            break
        labels = found
        # a round that joins few components is the last: what is left doesn't consist of large groups
        was, kinds = kinds, labels.select("comp").distinct().count()
        if 100 * (was - kinds) < kinds:
            break
    pairs = cut(tree_pairs(members, labels, sets, terms), "pairs")
    links = verified(pairs, sets, terms)
    discard(members, pairs)
    found = joined(labels, links)
    discard(sets)
    return labels if found is None else found


def tree_pairs(members: DataFrame, labels: DataFrame, sets: DataFrame, terms: Terms) -> DataFrame:
    """Pairs (a, b) of different components that share a cell and whose points allow the overlap needed."""
    spark = members.sparkSession
    placed = members.select("cell", "key", "n").join(labels, "key")
    left = cut(placed.groupBy("cell").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).filter("low <> high").select("cell", "size"), "left")
    open_ = cut(placed.join(left, "cell"), "open")
    of = open_.groupBy("key").agg(F.collect_list("cell").alias("cells")).join(sets.select("key", "fine"), "key")  # as many as a head has shingles at most
    rest = open_.join(of, "key")
    dealt = rest.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("comp", F.floor(F.col("n") / 64)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = dealt.select("cell", "i", "j", "block", "key", "comp", "n", "fine", "cells").repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return grouped.mapInArrow(_block_pairs(terms), "a long, b long").distinct()


def components(docs: DataFrame, terms: Terms = Terms(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to) of every document."""
    return labelled(docs, terms, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def labelled(docs: DataFrame, terms: Terms, id_col: str, text_col: str) -> DataFrame:
    """id, n, class key, component and its smallest id of every document."""
    profile = cut(points(docs, terms, id_col, text_col), "points")
    labels = class_labels(docs, profile, terms, id_col, text_col)
    named = cut(profile.select("id", "n", "key").join(labels, "key", "left").select("id", "n", "key", F.coalesce("comp", "key").alias("comp")), "named")
    discard(profile, labels)
    # staged: a component that holds a third of all rows can then be split where it is joined
    least = cut(named.filter("n > 0").groupBy("comp").agg(F.min("id").alias("least")), "least")
    linked = named.filter("n > 0").join(least, "comp").select("id", "n", "key", "comp", "least")
    return linked.unionByName(named.filter("n = 0").select("id", "n", "key", "comp", F.col("id").alias("least")))


def with_keys(docs: DataFrame, terms: Terms, text_col: str, name: str) -> DataFrame:
    """``docs`` with the key of each row's class."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col):
                keys = [class_key(u) for u in shingle_sets(utf8(part, text_col), terms.words)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.int64())], [*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def keep_one(docs: DataFrame, terms: Terms = Terms(5, 80), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, of its smallest id (of several by a hash of the row). Rows without
    words have no component: all stay, except repetitions in all columns. Rows with a null id stay."""
    key, i, k, n, comp, least, row, turn, away = ensure_unique(docs.columns, ["key_", "id_", "k_", "n_", "comp_", "least_", "row_", "turn_", "gone"]).values()
    named = cut(labelled(docs.filter(F.col(id_col).isNotNull()), terms, id_col, text_col), "labelled")
    gone = named.filter("id <> least").select(F.col("id").alias(away))
    repeated = cut(named.groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col("id").alias(away)), "repeated")
    if not repeated.limit(1).count():
        return docs.join(gone, docs[id_col] == F.col(away), "left_anti")
    # an id doesn't tell its rows apart: they are known by id and class
    single = docs.join(gone.unionByName(repeated), docs[id_col] == F.col(away), "left_anti")
    kinds = named.join(repeated, F.col("id") == F.col(away), "left_semi").select(F.col("id").alias(i), F.col("key").alias(k), F.col("n").alias(n), F.col("comp").alias(comp), F.col("least").alias(least)).distinct()
    several = with_keys(docs.join(repeated, docs[id_col] == F.col(away), "left_semi"), terms, text_col, key)
    placed = several.join(kinds, (F.col(id_col) == F.col(i)) & (F.col(key) == F.col(k))).filter(F.col(i) == F.col(least)).withColumn(row, F.to_json(F.struct(*docs.columns)))
    same = Window.partitionBy(comp, F.when(F.col(n) == 0, F.col(i)), F.when(F.col(n) == 0, F.col(row))).orderBy(F.xxhash64(row))
    return single.unionByName(placed.withColumn(turn, F.row_number().over(same)).filter(F.col(turn) == 1).select(*docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')] ELSE list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
f AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, other) AS (SELECT DISTINCT doc_id, doc_id FROM documents UNION SELECT r.id, f.b FROM r JOIN f ON f.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.least AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(other) AS least FROM r GROUP BY id) m ON m.id = d.doc_id
"""
