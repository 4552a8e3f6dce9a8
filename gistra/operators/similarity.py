"""Similarity of groups from stored summaries, banded candidate search, and weighted samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gistra.functions.hashing import BITS, gamma2, h60, h60_seeded, unit
from gistra.operators import pairs as pr
from gistra.operators.rows import apart, order_minima
from gistra.staging import cut


def bottom_union(pairs: DataFrame, table: DataFrame, group: str, k: int) -> DataFrame:
    """i, j, h, c: the k smallest hashes of each pair's union, and how many of the two have each."""
    t = table.select(F.col(group).alias("g"), "h")
    left = pairs.join(t.select(F.col("g").alias("i"), "h"), "i")
    right = pairs.join(t.select(F.col("g").alias("j"), "h"), "j")
    union = left.select("i", "j", "h").unionByName(right.select("i", "j", "h")).groupBy("i", "j", "h").agg(F.count("*").alias("c"))
    w = Window.partitionBy("i", "j").orderBy("h")
    return union.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)


def bottom_jaccard(table: DataFrame, group: str, k: int) -> DataFrame:
    """i < j, shared, jaccard of all pairs from k-smallest tables (group, rk, h): matches among the k smallest of
    the union. Only pairs that share a hash have their union made; the others are 0. The table is read six times, so it is made once."""
    table = cut(table, "smallest")
    sharing = pr.meeting(table, group, ["h"], "h", n=F.count("*")).select("i", "j")
    kept = bottom_union(sharing, table, group, k)
    some = kept.groupBy("i", "j").agg(F.sum((F.col("c") == 2).cast("bigint")).alias("shared"), F.round(F.sum((F.col("c") == 2).cast("double")) / F.count("*"), 6).alias("jaccard"))
    return pr.filled(pr.group_pairs(table, group), some, shared=0, jaccard=0.0)


def bands(table: DataFrame, group: str, sizes: list[int], registers: int) -> DataFrame:
    """level, sub, key, id: for each band size, contiguous runs of complete registers hashed."""
    level = table.select(F.col(group).alias("id"), "reg", "val").withColumn("level", F.explode(F.array(*map(F.lit, sizes))))
    runs = level.withColumn("sub", (F.floor(F.col("reg") / F.col("level"))).cast("int")).groupBy("id", "level", "sub").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reg", "val"))), lambda s: s["val"].cast("string")), ",").alias("run"))
    return runs.filter("n = level").select("level", "sub", h60("run").alias("key"), "id")


def default_levels(registers: int) -> list[int]:
    """Band sizes 1, 2, 4, ... up to the number of registers."""
    return [1 << i for i in range(registers.bit_length()) if 1 << i <= registers]


def overflow_bands(table: DataFrame, group: str, level: int, registers: int, extra: int) -> DataFrame:
    """level, sub, key, id of ``extra`` bands beyond the contiguous ones: ``level`` registers each, picked by hash."""
    import numpy as np

    from gistra.functions.hashing import wang64

    first = registers // level
    picks = [(first + s, j, int(wang64(np.array([8 * s + 31 * j + 5], np.uint64))[0] % np.uint64(registers))) for s in range(extra) for j in range(level)]
    chosen = F.broadcast(table.sparkSession.createDataFrame(picks, "sub int, j int, reg int"))  # extra * level rows
    runs = table.select(F.col(group).alias("id"), "reg", "val").join(chosen, "reg").groupBy("id", "sub").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "val"))), lambda s: s["val"].cast("string")), ",").alias("run"))
    return runs.filter(F.col("n") == level).select(F.lit(level).alias("level"), "sub", h60("run").alias("key"), "id")


def _classes(index: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ids with the same bands are one class: (id, class), the bands of classes, and (class, id) of the ``most`` smallest ids."""
    of = index.groupBy("id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "sub", "key"))), lambda b: F.concat_ws(":", b["level"].cast("string"), b["sub"].cast("string"), b["key"].cast("string"))), ",")).alias("class"))
    reps = of.groupBy("class").agg(F.min("id").alias("id"))
    first = of.withColumn("rk", F.row_number().over(Window.partitionBy("class").orderBy("id"))).filter(F.col("rk") <= most).drop("rk")
    return of, index.join(reps, "id").select("level", "sub", "key", "class"), first


def candidates(queries: DataFrame, index: DataFrame, most: int) -> DataFrame:
    """qid, id, level (most specific), hits: the ``most`` best candidates of each query, from band tables; ties by id.

    Ids whose bands are all equal are one class, so that copies meet as one row: classes are joined, and spread to as
    many ids as a query can need (``most`` and itself).
    """
    of, bands_, first = _classes(index, most + 1)
    q_of, q_bands, _ = (of, bands_, first) if queries is index else _classes(queries, 1)
    met = q_bands.withColumnRenamed("class", "q").join(bands_, ["level", "sub", "key"]).groupBy("q", "class").agg(F.max("level").alias("level"), F.count("*").alias("hits"))
    best = Window.partitionBy("q").orderBy(F.desc("level"), F.desc("hits"), "id")
    spread = met.join(first, "class").withColumn("rk", F.row_number().over(best)).filter(F.col("rk") <= most + 1).select("q", "id", "level", "hits")
    hits = q_of.select(F.col("id").alias("qid"), F.col("class").alias("q")).join(spread, "q").filter("qid <> id")
    w = Window.partitionBy("qid").orderBy(F.desc("level"), F.desc("hits"), "id")
    return hits.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= most).select("qid", "id", "level", "hits")


def insert_and_query(index: DataFrame, most: int) -> DataFrame:
    """qid, id, level, hits: the ``most`` best candidates among smaller ids, as if each id were looked up and then inserted."""
    q = index.select("level", "sub", "key", F.col("id").alias("qid"))
    hits = q.join(index, ["level", "sub", "key"]).filter("id < qid").groupBy("qid", "id").agg(F.max("level").alias("level"), F.count("*").alias("hits"))
    w = Window.partitionBy("qid").orderBy(F.desc("level"), F.desc("hits"), "id")
    return hits.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= most).drop("rk")


def per_row(queries: DataFrame, index: DataFrame) -> DataFrame:
    """qid, level, sub, found: how many other ids each band of a query meets, from the bands' sizes."""
    sizes = index.groupBy("level", "sub", "key").agg(F.count("*").alias("n"))
    return queries.join(sizes, ["level", "sub", "key"]).select(F.col("id").alias("qid"), "level", "sub", (F.col("n") - 1).alias("found"))


def bottom_candidates(table: DataFrame, group: str, most: int) -> DataFrame:
    """qid, id, hits: the groups that share the most of their smallest hashes, by an inverted index on hashes."""
    a, b = table.select(F.col(group).alias("qid"), "h"), table.select(F.col(group).alias("id"), "h")
    hits = a.join(b, "h").filter("qid <> id").groupBy("qid", "id").agg(F.count("*").alias("hits"))
    w = Window.partitionBy("qid").orderBy(F.desc("hits"), "id")
    return hits.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= most).drop("rk")


def weighted_pairs(counts: DataFrame, group: str, key: str, w: str) -> DataFrame:
    """i < j, isect (sum of minima), unite (sum of maxima), jaccard, dot of all pairs of groups."""
    c = counts.filter(F.col(w) > 0)
    total = c.groupBy(group).agg(F.sum(w).alias("t"))
    some = pr.meeting(c, group, [key], w, isect=F.sum(F.least("x", "y")), dot=F.sum(F.col("x") * F.col("y")))
    s = pr.sided(total, group, pr.filled(pr.group_pairs(c, group), some, isect=0, dot=0), ["t"])
    u = F.col("t_i") + F.col("t_j") - F.col("isect")
    return s.select("i", "j", "isect", u.alias("unite"), F.round(F.col("isect") / u, 6).alias("jaccard"), "dot")


def counted_measures(counts: DataFrame, group: str, key: str, w: str) -> DataFrame:
    """i < j, isect, jaccard, containment of i in j, dot and cosine of all pairs of groups of counted keys."""
    some = pr.meeting(counts, group, [key], w, isect=F.sum(F.least("x", "y")), dot=F.sum(F.col("x") * F.col("y")))
    total = counts.groupBy(group).agg(F.sum(w).alias("t"), F.sqrt(F.sum(F.col(w) * F.col(w))).alias("q"))
    s = pr.sided(total, group, pr.filled(pr.group_pairs(counts, group), some, isect=0, dot=0), ["t", "q"])
    r = lambda c: F.round(c, 6)
    return s.select("i", "j", "isect", r(F.col("isect") / (F.col("t_i") + F.col("t_j") - F.col("isect"))).alias("jaccard"), r(F.col("isect") / F.col("t_i")).alias("containment"), "dot", r(F.col("dot") / (F.col("q_i") * F.col("q_j"))).alias("cosine"))


def weighted_similarity(counts: DataFrame, group: str, key: str, w: str) -> DataFrame:
    """i < j, similarity: sum of least over sum of greatest counts, keys weighted by ln(groups / groups with it) + 1."""
    groups = counts.agg(F.countDistinct(group).alias("all_"))  # one row
    idf = counts.groupBy(key).agg(F.countDistinct(group).alias("n_")).crossJoin(F.broadcast(groups)).select(key, (F.ln(F.col("all_") / F.col("n_")) + 1).alias("idf"))
    weighed = counts.join(idf, key).select(group, key, (F.col(w) * F.col("idf")).alias("x_"))
    some = pr.meeting(weighed, group, [key], "x_", low=F.sum(F.least("x", "y")))
    s = pr.sided(weighed.groupBy(group).agg(F.sum("x_").alias("t")), group, pr.filled(pr.group_pairs(counts, group), some, low=0.0), ["t"])
    return s.select("i", "j", F.round(F.col("low") / (F.col("t_i") + F.col("t_j") - F.col("low")), 6).alias("similarity"))


def icws(weights: DataFrame, group: str, key: str, w: str, slots: int) -> DataFrame:
    """group, slot, key, t: consistent weighted samples; two groups agree in a slot with the probability of
    their weighted similarity. Weights that aren't positive are passed over."""
    k = F.col(key).cast("string")
    s = weights.filter(F.col(w) > 0).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    h = lambda tag: h60_seeded(k, F.concat(F.lit(tag), F.col("slot").cast("string")))
    r, c, beta = gamma2(h("a"), h("b")), gamma2(h("c"), h("d")), unit(h("e"))
    s = s.withColumn("r", r).withColumn("t", F.floor(F.ln(F.col(w)) / F.col("r") + beta).cast("bigint"))
    s = s.withColumn("a", c / F.exp(F.col("r") * (F.col("t") - beta + 1)))
    return s.groupBy(group, "slot").agg(F.min_by(F.struct(F.col(key).alias("key"), "t"), "a").alias("s")).select(group, "slot", F.col("s.key").alias("key"), F.col("s.t").alias("t"))


def prob_min(weights: DataFrame, group: str, key: str, w: str, slots: int) -> DataFrame:
    """group, slot, key: the key whose exponential of rate w comes first in each slot."""
    s = weights.filter(F.col(w) > 0).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    x = -F.ln(unit(h60_seeded(F.col(key).cast("string"), F.col("slot")))) / F.col(w)
    return s.groupBy(group, "slot").agg(F.min_by(key, x).alias("key"))


def order_min(words: DataFrame, group: str, words_col: str, slots: int, length: int) -> DataFrame:
    """group, slot, val: hash of the ``length`` words of least hash (word and its occurrence), in text order. Rows that
    have their group to themselves are worked on where they lie; the others' words are dealt by group and word."""
    return apart(words, group, lambda d: order_minima(d, group, words_col, slots, length), lambda d: _order_min(d, group, words_col, slots, length))


def _order_min(words: DataFrame, group: str, words_col: str, slots: int, length: int) -> DataFrame:
    each = words.select(group, F.posexplode(words_col).alias("pos", "word"))
    each = each.withColumn("occ", F.row_number().over(Window.partitionBy(group, "word").orderBy("pos"))).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    h = h60_seeded(F.concat_ws("#", "word", F.col("occ").cast("string")), F.col("slot"))
    w = Window.partitionBy(group, "slot").orderBy("h", "pos")
    kept = each.withColumn("h", h).withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= length)
    run = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]), " ")
    return kept.groupBy(group, "slot").agg(h60(run).alias("val"))


def exponential_registers(df: DataFrame, group: str, key: str, m: int) -> DataFrame:
    """group, reg, val: least exponential number of each register over the group's distinct keys."""
    s = df.select(group, key).distinct().withColumn("reg", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    return s.groupBy(group, "reg").agg(F.min(h60_seeded(F.col(key).cast("string"), F.col("reg"))).alias("h")).select(group, "reg", (-F.ln(1 - (F.shiftright("h", 8).cast("double") + 0.5) / float(1 << (BITS - 8)))).alias("val"))


def quantised(table: DataFrame, a: float, b: float, q: int) -> DataFrame:
    """Integer registers 1 - log_b(x / a) within 0 .. q + 1, merged by max."""
    import math

    k = F.floor(1 - F.ln(F.col("val") / a) / math.log(b))
    return table.withColumn("val", F.greatest(F.lit(0), F.least(F.lit(q + 1), k)).cast("int"))
