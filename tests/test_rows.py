import hashlib
import math
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gistra.functions import hashing as hx
from gistra.operators import membership as mb
from gistra.operators import rows as rw
from gistra.operators import weighted as wt
from gistra.plans import catalogue


def h(x, seed=0):
    return int(hashlib.md5(f"{seed}:{x}".encode()).hexdigest()[:15], 16)


def documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_kmers_of_long_and_repeated_documents(spark, tmp_path):
    """each substring was found by walking from the begin of the text."""
    long = "".join(f"{i * i % 7919:x}é" for i in range(150_000))
    rows = [(1, long), (2, "aébc" * 40), (3, "x" * 20), (4, "y" * 21), (5, "😀a\n" * 30), (6, None), (7, "a" * 50 + "b" * 50), (7, "b" * 50 + "c" * 50), (None, "d" * 30), (None, "e" * 30)]
    want = {}
    for i, t in rows:
        if t and len(t) > 20:
            want.setdefault(i, set()).update(t[k : k + 21] for k in range(len(t) - 20))
    d, began = documents(spark, tmp_path, rows), time.time()
    got = catalogue.QUERIES["kmers_documents"](spark, d).collect()
    assert {r["doc_id"]: r["kinds"] for r in got} == {i: len(s) for i, s in want.items()} and len(got) == len(want)
    column = spark.read.parquet(f"{d}/documents.parquet").filter("doc_id < 6").select("doc_id", "text", hx.kmers(F.col("text"), 21).alias("k")).collect()
    assert time.time() - began < 30
    for r in column:
        t = r["text"] or ""
        assert r["k"] == [t[k : k + 21] for k in range(len(t) - 20)]


def test_cardinality_of_a_full_filter(spark):
    """the logarithm of 0 was null, where SQL has an infinite estimate."""
    bits = spark.createDataFrame([("full", b) for b in range(8)] + [("half", b) for b in range(4)], "g string, bit int")
    got = {r["g"]: r["estimate"] for r in mb.cardinality(bits, ["g"], 8, 3).collect()}
    assert got == {"full": math.inf, "half": round(math.log(0.5) / (3 * math.log(7 / 8)), 6)}


def test_measures_of_full_filters(spark):
    """full filters of two groups gave null sizes, where SQL has an infinite union and no number for the rest."""
    bits = spark.createDataFrame([(g, b) for g, n in (("full", 8), ("full2", 8), ("half", 4)) for b in range(n)], "g string, bit int")
    got = {(r["i"], r["j"]): r for r in mb.measures(bits, "g", 8, 3).collect()}
    both, one = got["full", "full2"], got["full", "half"]
    assert both["union_size"] == math.inf and math.isnan(both["intersection"]) and math.isnan(both["jaccard"]) and both["bit_jaccard"] == 1
    assert one["union_size"] == math.inf and math.isnan(one["intersection"]) and one["bit_jaccard"] == 0.5


def test_order_minima_are_made_where_the_text_lies(spark, tmp_path):
    """all words of all texts were shuffled and sorted, once for each slot."""
    texts = {1: "a b a c d b a", 2: "one", 3: "", 4: None, 5: " ".join(f"w{i % 97}é" for i in range(3000)), 6: "x " * 50}
    d = documents(spark, tmp_path / "one", list(texts.items()))
    df = catalogue.QUERIES["order_minhash_documents"](spark, d)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, t in texts.items():
        seen, each = Counter(), []
        for pos, w in enumerate((t or "").lower().split()):
            seen[w] += 1
            each.append((w, seen[w], pos))
        for slot in range(8 if each else 0):
            least = sorted(each, key=lambda e: (h(f"{e[0]}#{e[1]}", slot), e[2]))[:3]
            want[i, slot] = h(" ".join(w for w, _, _ in sorted(least, key=lambda e: e[2])))
    rows = df.collect()
    assert {(r["doc_id"], r["slot"]): r["val"] for r in rows} == want and len(rows) == len(want)
    # an id on two rows, where occurrences count on
    d = documents(spark, tmp_path / "two", [(1, "a b"), (2, "c a a"), (None, "z"), (None, "z z z"), (1, "")])
    rows = catalogue.QUERIES["order_minhash_documents"](spark, d).collect()
    assert Counter(r["doc_id"] for r in rows) == {1: 8, 2: 8, None: 8}
    assert {r["val"] for r in rows if r["doc_id"] is None} == {h("z z z")}


def test_hashes_of_texts_equal_md5():
    texts = ["", "a", "é" * 26, "x" * 52, "x" * 53, "y" * 54, "z" * 55, "w" * 56, "long " * 50, "end\0"] + [f"word#{i}" for i in range(9000)]
    for seed, got in zip([0, 7, 10, 12, 3], hx.h60_texts([t.encode() for t in texts], [0, 7, 10, 12, 3])):
        assert got.tolist() == [h(t, seed) for t in texts]


def test_gram_counts_are_made_where_the_text_lies(spark, tmp_path):
    """F8: every run of three words was shuffled to be counted."""
    texts = [(1, "a b c a b c a b"), (2, "one two"), (3, None), (4, "x " * 9), (5, "a B c")]
    df = catalogue.QUERIES["hash_ngrams"](spark, documents(spark, tmp_path / "one", texts))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, df.collect())) == [(1, 6, 3), (4, 7, 1), (5, 1, 1)]
    d = documents(spark, tmp_path / "two", [(1, "a b c d"), (1, "b c d e"), (None, "z z z"), (None, "z z z z"), (2, "p q r"), (2, "s")])
    assert {tuple(r) for r in catalogue.QUERIES["hash_ngrams"](spark, d).collect()} == {(1, 4, 3), (None, 3, 1), (2, 1, 1)}


def test_nested_points_of_many_keys_take_one_sweep(spark):
    """each key's points were drawn by themselves, and once for every reading of the table."""
    w = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.lit("a")).otherwise(F.lit("b")).alias("g"), (F.col("id") % 20_000).alias("k"), (1 + F.col("id") % 1000).alias("w"))
    began = time.time()
    rows = wt.agreement(wt.nested_points(w, "g", "k", "w", 64, float(1 << 40), 40), "g", 64).collect()
    assert len(rows) == 1 and time.time() - began < 30
    one = lambda d: sorted(map(tuple, wt.nested_points(d, "g", "k", "w", 16, 1024.0, 12).collect()))
    few = w.filter("k < 300")
    halves = {}
    for part in (one(few.filter("k % 2 = 0")), one(few.filter("k % 2 = 1"))):
        for g, slot, k, v in part:
            halves[g, slot] = min(halves.get((g, slot), (v, k)), (v, k))
    assert one(few) == sorted((g, s, k, v) for (g, s), (v, k) in halves.items())


@pytest.mark.parametrize("query", ["bottomk_jaccard", "ccount_eq", "bloom_and_or_xor"])
def test_all_pairs_read_a_made_table(spark, tmp_path, query):
    """the plan split the texts into words and hashed them again for every use of the table."""
    rows = [(i, f"s{i % 4}", " ".join(f"w{j % (7 + i)}" for j in range(i * 5))) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalogue.QUERIES[query](spark, str(tmp_path))
    assert "documents.parquet" not in df._jdf.queryExecution().optimizedPlan().toString() + "".join(df.inputFiles())
    assert df.count() == 6


def test_gram_minima_equal_a_loop(spark):
    """minima of runs of words are made row by row; rows of one group are merged."""
    rows = [(1, ["a", "b", "c", "d"]), (2, ["x"]), (3, []), (4, [f"w{i}é" for i in range(200)]), (5, ["long" * 20, "y", "z", "y"]), (1, ["c", "d", "e"]), (6, None)]
    want = {}
    for i, w in rows:
        for g in zip(w or [], (w or [])[1:], (w or [])[2:]):
            v = h(" ".join(g))
            want[i, v >> 56] = min(want.get((i, v >> 56), 1 << 60), v & ((1 << 56) - 1))
    df = spark.createDataFrame(rows, "id long, t array<string>").coalesce(1)
    plan = rw.gram_minima(df, "id", "t", 3, 4)
    assert {(r["id"], r["reg"]): r["val"] for r in plan.collect()} == want
