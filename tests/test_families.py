"""Measures of sets, counts and weights against exact values on small inputs, within the tolerances they are known to keep."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gistra import api
from gistra.functions import scalars as sc
from gistra.operators import counts as ct
from gistra.operators import frequency as fq
from gistra.operators import membership as mb
from gistra.operators import pairs as pr
from gistra.operators import registers as rg
from gistra.operators import setregs as sr
from gistra.operators import similarity as sm
from gistra.operators import weighted as wt
from gistra.sources import tables as io


@pytest.fixture(scope="module")
def thirds(spark):
    """Two sets of 4000 with a Jaccard of 1/3, and a third that shares nothing."""
    part = lambda g, a, b: spark.range(a, b).select(F.lit(g).alias("g"), "id")
    return part("a", 0, 4000).unionByName(part("b", 2000, 6000)).unionByName(part("c", 90000, 90040)).cache()


def pairs_of(df, value):
    return {(r["i"], r["j"]): r[value] for r in df.collect()}


def test_pairs_that_share_nothing_are_there(spark, thirds):
    own = rg.comparisons(rg.hll(thirds, ["g"], "id", 10), "g", 10)
    assert set(pairs_of(own, "jaccard")) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert pairs_of(rg.matches(rg.oph(thirds, ["g"], "id", 4), "g"), "equal")[("a", "c")] == 0
    assert pairs_of(sm.bottom_jaccard(rg.kmv(thirds, ["g"], "id", 32), "g", 32), "jaccard")[("b", "c")] == 0
    square = {(r["i"], r["j"]): r["v"] for r in pr.square(spark.createDataFrame([("a", "b", 0.5)], "i string, j string, v double"), spark.createDataFrame([("a",), ("b",)], "n string"), "v").collect()}
    assert square == {("a", "b"): 0.5, ("b", "a"): 0.5, ("a", "a"): 1.0, ("b", "b"): 1.0}


def test_condensed_index_counts_up(spark):
    rows = pr.cross_names(spark.range(7), spark.range(7)).filter("i < j").select("i", "j", pr.condensed_index(F.col("i"), F.col("j"), 7).alias("at")).orderBy("i", "j").collect()
    assert [r["at"] for r in rows] == list(range(21))


def test_joint_estimates(spark, thirds):
    got = {(r["i"], r["j"]): r for r in sr.joint_estimates(rg.hll(thirds, ["g"], "id", 12), "g", 12).collect()}
    r = got[("a", "b")]
    for value in (r["a_only"], r["b_only"], r["intersection"]):
        assert abs(value - 2000) < 300
    assert got[("a", "c")]["intersection"] < 60


def test_set_registers(spark, thirds):
    m, (b, a, q) = 256, sr.PRESETS["short"]
    table = sr.integer_registers(thirds, "g", "id", m, b, a, q)
    cards = {r["g"]: r["estimate"] for r in sr.integer_cardinality(table, "g", m, b, a).collect()}
    assert abs(cards["a"] - 4000) < 800 and abs(cards["c"] - 40) < 8
    j = pairs_of(sr.joint_likelihood(table, "g", m, b, a), "jaccard")
    assert abs(j[("a", "b")] - 1 / 3) < 0.1 and j[("a", "c")] < 0.01
    assert abs(sr.likeliest_jaccard(0, 0, m, 100.0, 100.0, b) - 1) < 1e-6
    measured = {(r["i"], r["j"]): r for r in sr.shared_measures(sr.winners(thirds, "g", "id", m).select("g", "reg", "val"), "g", m).collect()}
    assert abs(measured[("a", "b")]["jaccard"] - 1 / 3) < 0.1 and abs(measured[("a", "b")]["union_size"] - 6000) < 1200


def test_rank_and_remainder_registers(spark, thirds):
    r = {(x["i"], x["j"]): x for x in sr.rank_remainder_measures(rg.hyper(thirds, ["g"], "id", 10, 6), "g", 10, 6).collect()}
    assert abs(r[("a", "b")]["jaccard"] - 1 / 3) < 0.06 and r[("a", "c")]["jaccard"] < 0.03
    assert abs(r[("a", "b")]["union_size"] - 6000) < 600


def test_minima_of_other_kinds(spark, thirds):
    for table in (sr.permuted_minima(thirds, "g", "id", 128), sr.k_minima(thirds, "g", "id", 128).withColumnRenamed("slot", "reg")):
        assert abs(pairs_of(rg.matches(table, "g"), "equal")[("a", "b")] / 128 - 1 / 3) < 0.13


def test_running_estimates(spark):
    df = spark.range(5000).select(F.lit("a").alias("g"), (F.col("id") % 2500).alias("k"), "id")
    assert abs(rg.first_arrivals(df, "g", "k", "id", 10).first()["estimate"] - 2500) < 250
    # the window form equals the estimate kept row by row
    p, m = 6, 64
    rows = sorted(((r["id"], r["reg"], r["val"]) for r in df.select("id", F.expr("k")).withColumn("h", rg.h60("k")).select("id", rg.register(F.col("h"), p).alias("reg"), rg.rank(F.col("h"), p).alias("val")).collect()))
    regs, total = [0] * m, 0.0
    for _, reg, val in rows:
        if val > regs[reg]:
            total += m / sum(2.0**-v for v in regs)
            regs[reg] = val
    assert abs(rg.first_arrivals(df, "g", "k", "id", p).first()["estimate"] - total) < 1e-3
    big = spark.range(200_000).select(F.lit("a").alias("g"), F.col("id").alias("k"), "id")
    assert 0.3 < rg.bit_pair_counters(big, "g", "k", "id", 4).first()["estimate"] / 200_000 < 3


def test_conservative_counts_lie_between(spark):
    df = spark.range(6000).select(F.expr("cast(sqrt(id) * 10 as int)").alias("k"))
    exact = Counter(r["k"] for r in df.collect())
    plain = {r["k"]: r["estimate"] for r in ct.count_min_estimate(df, "k", ct.count_min(df, "k")).collect()}
    less = {r["k"]: r["estimate"] for r in ct.count_min_estimate(df, "k", fq.conservative(df, "k")).collect()}
    assert all(exact[k] <= less[k] <= plain[k] for k in exact) and sum(less.values()) < sum(plain.values())


def test_decaying_cells_against_a_loop(spark):
    r = np.random.default_rng(3)
    keys = [int(k) for k in np.minimum(r.zipf(1.6, 4000), 300)]
    df = spark.createDataFrame(list(enumerate(keys)), "n long, k long").repartition(3)
    rows_ = fq._rows(df.withColumn("h", fq.h60("k")), 2).select("row", fq._bucket(F.col("k"), 32).alias("b"), F.col("h").bitwiseAND(0xFFFF).alias("f"), fq.unit(fq.h60(F.concat_ws("/", F.col("k").cast("string"), F.col("n").cast("string"), F.col("row").cast("string")), "coin")).alias("u"), "n").orderBy("n").collect()
    want = {}
    for x in rows_:
        fp, cnt = want.get((x["row"], x["b"]), (None, 0))
        if cnt == 0 or fp == x["f"]:
            fp, cnt = x["f"], cnt + 1
        elif x["u"] < 1.08**-cnt:
            fp, cnt = (fp, cnt - 1) if cnt > 1 else (x["f"], 1)
        want[(x["row"], x["b"])] = fp, cnt
    cells = fq.decaying_cells(df, "k", "n", 2, 32)
    assert {(x["row"], x["bucket"]): (x["fp"], x["cnt"]) for x in cells.collect()} == want
    est = {x["k"]: x["estimate"] for x in fq.decaying_estimate(df, "k", cells, 2, 32).collect()}
    exact = Counter(keys)
    assert all(est[k] <= exact[k] for k in exact) and est[exact.most_common(1)[0][0]] > 0.9 * exact.most_common(1)[0][1]
    merged = {(x["row"], x["bucket"]): x["cnt"] for x in fq.decaying_merge(cells, cells).collect()}
    assert merged == {k: 2 * c for k, (_, c) in want.items()}


def test_cascade_and_log_counters(spark):
    df = spark.range(4096).select(F.when(F.col("id") < 2048, 0).otherwise(F.col("id")).alias("k"), "id")
    est = {r["k"]: r["estimate"] for r in fq.cascade_estimate(df, "k", fq.cascade(df, "k", "id", 16, 1 << 20), 16, 1 << 20).collect()}
    assert 256 <= est[0] and np.median([v for k, v in est.items() if k]) <= 2
    logs = {r["k"]: r["estimate"] for r in fq.log_estimate(df, "k", fq.log_counters(df, "k", "id", 3, 1 << 16), 3, 1 << 16).collect()}
    assert 256 <= logs[0] <= 1 << 15


def test_spectrum(spark):
    df = spark.range(9000).select(F.expr("case when id < 3000 then id else 3000 + id % 3000 end").alias("k"))
    got = [r["estimate"] for r in fq.spectrum(fq.spectrum_table(df, "k", 0, 14), 0, 14, 3).orderBy("i").collect()]
    assert abs(got[0] - 6000) < 300 and abs(got[1] - 3000) < 450 and abs(got[2] - 3000) < 450 and got[3] < 300


@pytest.fixture(scope="module")
def weights(spark):
    r = np.random.default_rng(1)
    a, b = r.integers(1, 50, 60), r.integers(1, 50, 60)
    rows = [("a", i, float(w)) for i, w in enumerate(a)] + [("b", i, float(w)) for i, w in enumerate(b)]
    return spark.createDataFrame(rows, "g string, k long, w double").cache(), np.minimum(a, b).sum() / np.maximum(a, b).sum(), a, b


def test_weighted_minima(spark, weights):
    df, jaccard, a, b = weights
    bag = pairs_of(wt.agreement(wt.nested_points(df, "g", "k", "w", 400, 64.0, 12), "g", 400), "similarity")
    assert abs(bag[("a", "b")] - jaccard) < 0.08
    shares = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in range(60))  # agreement of points scaled by the total weight
    for t in (wt.permuted_points(df, "g", "k", "w", 400), wt.interval_points(df, "g", "k", "w", 400)):
        assert t.count() == 800
        same = t.filter("g = 'a'").join(t.filter("g = 'b'").select("slot", F.col("key").alias("other")), "slot").filter("key = other").count()
        assert abs(same / 400 - shares) < 0.1
    halves = wt.interval_points(df.filter("k < 30"), "g", "k", "w", 64).unionByName(wt.interval_points(df.filter("k >= 30"), "g", "k", "w", 64))
    merged = {(r["g"], r["slot"]): r["val"] for r in halves.groupBy("g", "slot").agg(F.min("val").alias("val")).collect()}
    assert merged == {(r["g"], r["slot"]): r["val"] for r in wt.interval_points(df, "g", "k", "w", 64).collect()}
    with pytest.raises(Exception, match="beyond"):
        wt.nested_points(df, "g", "k", "w", 4, 8.0).collect()
    dart = pairs_of(wt.agreement(wt.darts(df, "g", "k", "w", 400, 1.0), "g", 400), "similarity")
    assert abs(dart[("a", "b")] - jaccard) < 0.08
    hits = wt.first_hits(df.withColumn("k", F.col("k") + 1), "g", "k", "w", 60, 50.0, 400, 64)
    same = hits.filter("g = 'a'").join(hits.filter("g = 'b'").select("slot", F.col("val").alias("v")), "slot").filter("val = v").count()
    assert abs(same / 400 - jaccard) < 0.08


def test_test_and_add_in_order(spark):
    df = spark.createDataFrame([(n, k) for n, k in enumerate([5, 6, 5, 7, 7, 5, 8])], "n long, k long")
    got = {r["n"]: r["seen"] for r in mb.test_and_add(df, "k", "n", 1 << 20, 4).collect()}
    assert [got[n] for n in range(7)] == [False, False, True, False, True, True, False]


def test_hashes_and_their_inverses():
    x = np.random.default_rng(2).integers(0, 1 << 63, 2000).astype(np.uint64)
    assert (sc.finaliser_inverse(sc.finaliser(x)) == x).all()
    odd = x | np.uint64(1)
    assert (odd * sc.inverse64(odd) == 1).all()
    steps = [("xor", 77), ("mul", 12345678901), ("rotl", 13), ("add", 5)]
    assert (sc.reversible(sc.reversible(x, steps), sc.reversed_steps(steps)) == x).all()
    one = int(x[0])
    t = one + sc.STEP & (1 << 64) - 1
    for k in sc.MIXERS:
        t = (t * k >> 64) ^ (t * k & (1 << 64) - 1)
    assert int(sc.stateless(x)[0]) == t


def test_stored_summaries_know_their_kind(spark, tmp_path):
    table = rg.hll(spark.range(100), [], "id", 6)
    for codec, level in (("gzip", 4), ("zstd", 3), ("snappy", None), ("none", None)):
        io.save(table, f"{tmp_path}/{codec}", "registers", codec, level, p=6)
        assert sorted(io.load(spark, f"{tmp_path}/{codec}", "registers", p=6).collect()) == sorted(table.collect())
    with pytest.raises(ValueError, match="holds registers"):
        io.load(spark, f"{tmp_path}/gzip", "registers", p=7)
    with pytest.raises(ValueError, match="no levels"):
        io.save(table, f"{tmp_path}/x", "registers", "snappy", 4)
    (tmp_path / "lines").write_text("abcd\nab\n")
    assert sorted(r["kmer"] for r in io.lines_kmers(spark, f"{tmp_path}/lines", 3).collect()) == ["abc", "bcd"]


def test_candidates_of_many_copies(spark):
    """Copies meet as one class: 2000 equal items and 40 others."""
    items = spark.range(2000).select("id", F.lit(0).alias("base")).unionByName(spark.range(2000, 2040).select("id", F.col("id").cast("int").alias("base")))
    keys = items.select("id", F.explode(F.sequence(F.col("base") * 10, F.col("base") * 10 + 30)).alias("k"))
    index = sm.bands(rg.oph(keys, ["id"], "k", 3), "id", [1, 2, 4, 8], 8)
    got = sm.candidates(index, index, 5)
    best = {}
    for r in got.collect():
        best.setdefault(r["qid"], []).append(r["id"])
    assert sorted(best[0]) == [1, 2, 3, 4, 5] and sorted(best[3]) == [0, 1, 2, 4, 5] and sorted(best[1999]) == [0, 1, 2, 3, 4]


def test_candidates_recall(spark):
    """Of pairs with a similarity of 0.8 or more, nine in ten come up."""
    r = np.random.default_rng(5)
    rows, sets = [], {}
    for g in range(60):
        base = r.integers(0, 1 << 40, 100)
        for c in range(2):
            s = base.copy()
            s[r.choice(100, 5, replace=False)] = r.integers(0, 1 << 40, 5)
            sets[2 * g + c] = set(s.tolist())
            rows += [(2 * g + c, int(k)) for k in s]
    index = sm.bands(rg.oph(spark.createDataFrame(rows, "id long, k long"), ["id"], "k", 5), "id", [1, 2, 4, 8], 32)
    found = {(x["qid"], x["id"]) for x in sm.candidates(index, index, 10).collect()}
    alike = [(a, b) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(alike) > 60 and sum(p in found for p in alike) >= 0.9 * len(alike)


def test_names_of_the_interface(spark, thirds):
    table = rg.hll(thirds, ["g"], "id", 10)
    pairs = api.jaccard_matrix(table, "g", 10)
    assert abs(pairs_of(pairs, "jaccard")[("a", "b")] - 1 / 3) < 0.1
    assert api.tri2full(pairs, table.select("g"), "jaccard").count() == 9 and api.containment_matrix(table, "g", 10).count() == 9
    assert abs(pairs_of(api.symmetric_containment_matrix(table, "g", 10), "containment")[("a", "b")] - 0.5) < 0.12
    assert abs(pairs_of(api.union_size_matrix(rg.oph(thirds, ["g"], "id", 8), "g", 8, "minima"), "union_size")[("a", "b")] - 6000) < 1500
    with pytest.raises(ValueError, match="has no"):
        api.intersection_matrix(mb.mod_sample(thirds, ["g"], "id", 4), "g", 4, "sample")
    one = spark.createDataFrame([([1, 2, 3], [3, 2, 5], "a b c d", 17, -17)], "x array<int>, y array<int>, t string, n long, m long")
    row = one.select(api.shs_isz(F.col("x"), F.col("y")), api.count_eq(F.col("x"), F.col("y")), F.size(api.hash_ngrams(F.split("t", " "))), api.fastdiv(F.col("n"), 5), api.fastmod(F.col("n"), 5), api.fastdiv(F.col("m"), 5)).first()
    assert tuple(row) == (2, 1, 2, 3, 2, -3)
    minima = rg.oph(spark.range(40).select((F.col("id") % 4).alias("id"), (F.col("id") % 2 * 100 + F.floor(F.col("id") / 4)).alias("k")), ["id"], "k", 3)
    index = api.BandIndex(spark, 8, extra=2).add(minima)
    assert {(r["qid"], r["id"]) for r in index.query(minima, 1).collect()} == {(0, 2), (2, 0), (1, 3), (3, 1)}
    assert index.per_row(minima).filter("found < 1").count() == 0
