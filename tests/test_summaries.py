import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gistra.functions import hashing as hx
from gistra.operators import counts as ct
from gistra.operators import membership as mb
from gistra.operators import registers as rg
from gistra.operators import similarity as sm
from gistra.operators import vectors as vc


def test_wang_roundtrip():
    x = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    assert (hx.wang64_inverse(hx.wang64(x)) == x).all()


@pytest.mark.parametrize("p", [8, 10])
def test_distinct_within_error(spark, p):
    n = 20000
    table = rg.hll(spark.range(n), [], "id", p)
    for e in (rg.estimate(table, [], p).first()[0], rg.estimate_by(table, [], p, "improved").first()["estimate"], rg.estimate_by(table, [], p, "mle").first()["estimate"]):
        assert abs(e - n) <= 3 * 1.04 / 2 ** (p / 2) * n


def test_fold_equals_direct(spark):
    for n in (50, 3000):
        df = spark.range(n)
        a = rg.fold(rg.hll(df, [], "id", 11), [], 11, 8).collect()
        assert sorted(a) == sorted(rg.hll(df, [], "id", 8).collect())
        b = rg.oph_fold(rg.oph(df, [], "id", 9), [], 9, 6).collect()
        assert sorted(b) == sorted(rg.oph(df, [], "id", 6).collect())


def test_jaccard_of_overlapping_sets(spark):
    df = spark.range(4000).select(F.lit("a").alias("g"), "id").unionByName(spark.range(2000, 6000).select(F.lit("b").alias("g"), "id"))
    r = rg.comparisons(rg.hll(df, ["g"], "id", 12), "g", 12).first()
    assert abs(r["jaccard"] - 1 / 3) < 0.06
    assert abs(sm.bottom_jaccard(rg.kmv(df, ["g"], "id", 512), "g", 512).first()["jaccard"] - 1 / 3) < 0.08


def test_densified_sources_are_full(spark):
    df = spark.createDataFrame([(n, k) for n in (1, 2, 4, 300) for k in range(n)], "g int, k int")
    have = rg.oph(df, ["g"], "k", 7)
    got = {(r["g"], r["reg"]): r["val"] for r in rg.densified(have, ["g"], 7).collect()}
    assert set(got) == {(g, r) for g in (1, 2, 4, 300) for r in range(128)}
    own = {(r["g"], r["reg"]): r["val"] for r in have.collect()}
    assert all(got[k] == v for k, v in own.items()) and all(v in {w for (h, _), w in own.items() if h == g} for (g, _), v in got.items())


def test_bloom_has_no_false_negatives(spark):
    t = mb.bits(spark.range(500), [], "id", 8192, 4)
    seen = {r["id"]: r["maybe"] for r in mb.may_contain(spark.range(1000), "id", t, 8192, 4).collect()}
    assert all(seen[i] for i in range(500)) and sum(seen[i] for i in range(500, 1000)) < 25
    assert abs(mb.cardinality(t, [], 8192, 4).first()["estimate"] - 500) < 25
    assert mb.optimal_hashes(8192, 500) == 12


def test_point_counts(spark):
    df = spark.range(20000).select(F.when(F.col("id") < 1004, 137).otherwise(F.col("id")).alias("k"))
    one = spark.createDataFrame([(137,)], "k long")
    assert ct.count_min_estimate(one, "k", ct.count_min(df, "k", 4, 4096), 4, 4096).first()["estimate"] >= 1004
    assert abs(ct.signed_estimate(one, "k", ct.signed_counts(df, "k", 7, 4096), 7, 4096).first()["estimate"] - 1004) < 10
    assert ct.top_k(df, "k", 1).first()["k"] == 137
    assert [r["k"] for r in ct.heavy_hitters(df, "k", 0.01).collect()] == [137]


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None,), (1,)], "k long")
    assert rg.hll(df, [], "k", 6).count() == 1
    assert ct.count_min(df.filter("false"), "k").count() == 0
    assert mb.bits(df.filter("false"), [], "k", 64, 2).count() == 0


def test_weighted_samples_agree_with_similarity(spark):
    w = spark.createDataFrame([(g, k, float(x)) for k in range(30) for g, x in (("a", 1 + k % 3), ("b", 1 + (k + 1) % 3))] + [("a", 99, -1.0)], "g string, k long, w double")
    true = sm.weighted_pairs(w, "g", "k", "w").first()["jaccard"]
    s = sm.icws(w, "g", "k", "w", 400)
    same = s.filter("g = 'a'").alias("x").join(s.filter("g = 'b'").alias("y"), ["slot", "key", "t"]).count() / 400
    assert abs(same - true) < 0.1


def test_vectors(spark):
    e = vc.long_form(spark.createDataFrame([(1, [float(i) for i in range(50)])], "k long, v array<double>"), "k", "v")
    assert 0.4 < vc.l1_norm(e, "k", 51).first()["norm"] / sum(range(50)) < 2
    assert [r["idx"] for r in vc.top_indices(e, "k", 3).orderBy("rk").collect()] == [49, 48, 47]
    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("x"))
    q = vc.bin_quantile(vc.log_bins(df, [], "x", 0.01), [], 0.5, 0.01).first()["quantile"]
    assert abs(q - 500) <= 10


def test_kmers_and_order_minima_of_documents(spark, tmp_path):
    from gistra.plans import catalogue

    texts = {1: "a b a c d b a", 2: "The quick brown fox jumps over the lazy dog and the other fox", 3: "x" * 30, 4: "short", 5: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    h = lambda x, seed=0: int(hashlib.md5(f"{seed}:{x}".encode()).hexdigest()[:15], 16)
    kinds = {i: len({t[k : k + 21] for k in range(len(t) - 20)}) for i, t in texts.items() if t and len(t) > 20}
    assert {r["doc_id"]: r["kinds"] for r in catalogue.QUERIES["kmers_documents"](spark, str(tmp_path)).collect()} == kinds
    want = {}
    for i, t in texts.items():
        seen, each = Counter(), []
        for pos, w in enumerate((t or "").lower().split()):
            seen[w] += 1
            each.append((w, seen[w], pos))
        for slot in range(8 if each else 0):
            least = sorted(each, key=lambda e: (h(f"{e[0]}#{e[1]}", slot), e[2]))[:3]
            want[i, slot] = h(" ".join(w for w, _, _ in sorted(least, key=lambda e: e[2])))
    got = {(r["doc_id"], r["slot"]): r["val"] for r in catalogue.QUERIES["order_minhash_documents"](spark, str(tmp_path)).collect()}
    assert got == want


def test_queries_without_sql_are_named_in_the_readme():
    import os
    import re

    from gistra.plans import catalogue, frequency, sets  # noqa: F401

    readme = open(f"{os.path.dirname(os.path.dirname(__file__))}/README.md").read()
    assert len(catalogue.QUERIES) > 200 and set(catalogue.QUERIES) - set(catalogue.ORACLES) <= set(re.findall(r"\w+", readme))



def test_entry_and_catalogue(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
