"""Queries of set measures: all pairs, unions, set registers, minima and their estimates, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gistra.functions import hashing as hx
from gistra.operators import membership as mb
from gistra.operators import pairs as pr
from gistra.operators import registers as rg
from gistra.operators import setregs as sr
from gistra.operators import similarity as sm
from gistra.plans.catalogue import ALL, HLL, HS, RANK, RAW, REG, REM, UNIT, H, query, table

P, M, U = 10, 1024, "user_id"
EV = "v AS (SELECT event_type AS g, user_id AS k, event_id AS n FROM events WHERE user_id IS NOT NULL)"
DV = "d AS (SELECT DISTINCT g, k FROM v)"


def events(s, d):
    return table(s, d, "events").filter("user_id IS NOT NULL").selectExpr("event_type AS g", "user_id AS k", "event_id AS n")


def hll(s, d, where="true", p=P, seed=0):
    return rg.hll(events(s, d).filter(where), ["g"], "k", p, seed)


R = f"{EV}, {HLL('t', 'v', 'g', 'k')}"
FULL = f"{ALL('t', 'g')}, f AS (SELECT i, j, r.reg, coalesce(a.val, 0) AS x, coalesce(b.val, 0) AS y FROM q_ CROSS JOIN (SELECT DISTINCT reg FROM t) r LEFT JOIN t a ON a.g = i AND a.reg = r.reg LEFT JOIN t b ON b.g = j AND b.reg = r.reg)"


def _est(c):
    return RAW(f"sum(CASE WHEN {c} > 0 THEN pow(2.0, -{c}) ELSE 0 END) + ({M} - sum(({c} > 0)::INTEGER))", f"{M} - sum(({c} > 0)::INTEGER)", M)


CARDS = f"{FULL}, e AS (SELECT i, j, {_est('x')} AS x, {_est('y')} AS y, {_est('greatest(x, y)')} AS u FROM f GROUP BY i, j), m AS (SELECT *, greatest(0.0, x + y - u) AS s FROM e)"


def compare(s, d):
    return rg.comparisons(hll(s, d), "g", P)


# all pairs
query("jaccard_matrix", f"WITH {R}, {CARDS} SELECT i, j, round(s / u, 6) AS jaccard FROM m")(lambda s, d: compare(s, d).select("i", "j", "jaccard"))
query("intersection_matrix", f"WITH {R}, {CARDS} SELECT i, j, round(s, 6) AS intersection FROM m")(lambda s, d: compare(s, d).select("i", "j", "intersection"))
query("union_size_matrix", f"WITH {R}, {CARDS} SELECT i, j, round(u, 6) AS union_size FROM m")(lambda s, d: compare(s, d).select("i", "j", "union_size"))
query("symmetric_containment_matrix", f"WITH {R}, {CARDS} SELECT i, j, round(s / least(x, y), 6) AS containment FROM m")(lambda s, d: compare(s, d).select("i", "j", F.round(F.greatest("containment", F.col("intersection") / F.col("card_j")), 6).alias("containment")))
query("tri2full", f"WITH {R}, {CARDS}, j AS (SELECT i, j, round(s / u, 6) AS jaccard FROM m) SELECT * FROM j UNION ALL SELECT j, i, jaccard FROM j UNION ALL SELECT DISTINCT g, g, 1.0 FROM t")(lambda s, d: pr.square(compare(s, d), hll(s, d).select("g"), "jaccard"))


@query("containment_matrix", f"WITH {R}, {CARDS} SELECT i, j, round(s / x, 6) AS containment FROM m UNION ALL SELECT j, i, round(s / y, 6) FROM m UNION ALL SELECT DISTINCT g, g, 1.0 FROM t")
def _containment(s, d):
    c = compare(s, d)
    back = c.select(F.col("j").alias("i"), F.col("i").alias("j"), F.round(F.col("intersection") / F.col("card_j"), 6).alias("containment"))
    own = hll(s, d).select(F.col("g").alias("i"), F.col("g").alias("j"), F.lit(1.0).alias("containment")).distinct()
    return c.select("i", "j", "containment").unionByName(back).unionByName(own)


query("knn_topk", f"WITH {R}, {CARDS}, j AS (SELECT i, j, round(s / u, 6) AS jaccard FROM m), b AS (SELECT * FROM j UNION ALL SELECT j, i, jaccard FROM j) SELECT i, j, jaccard, row_number() OVER (PARTITION BY i ORDER BY jaccard DESC, j)::INTEGER AS rk FROM b QUALIFY rk <= 2")(lambda s, d: pr.nearest(compare(s, d), "jaccard", 2))
query("pcount_eq", f"WITH {R}, {FULL} SELECT i, j, sum((x = y AND x > 0)::INTEGER)::BIGINT AS equal FROM f GROUP BY ALL")(lambda s, d: rg.matches(hll(s, d), "g"))


@query("ccount_eq_cross", f"WITH {EV}, {HLL('t', 'v', 'g', 'k')}, z AS (SELECT source AS g, doc_id AS k FROM documents WHERE doc_id IS NOT NULL), {HLL('o', 'z', 'g', 'k')}, q AS (SELECT DISTINCT t.g AS i, o.g AS j FROM t CROSS JOIN o) SELECT i, j, count(o.reg) AS equal FROM q JOIN t ON t.g = i LEFT JOIN o ON o.g IS NOT DISTINCT FROM j AND o.reg = t.reg AND o.val = t.val GROUP BY ALL")
def _cross(s, d):
    other = rg.hll(table(s, d, "documents").filter("doc_id IS NOT NULL"), ["source"], "doc_id", P)
    met = hll(s, d).select(F.col("g").alias("i"), "reg", "val").join(other.select(F.col("source").alias("j"), "reg", "val"), ["reg", "val"]).groupBy("i", "j").agg(F.count("*").alias("equal"))
    return pr.filled(pr.cross_names(hll(s, d).select("g"), other.select("source")), met, equal=0)


query("ij2ind", "SELECT i, j, (i * 9 - i * (i + 1) // 2 + j - i - 1)::BIGINT AS at FROM range(0, 9) a(i) CROSS JOIN range(0, 9) b(j) WHERE i < j")(lambda s, d: pr.cross_names(s.range(9), s.range(9)).filter("i < j").select("i", "j", pr.condensed_index(F.col("i"), F.col("j"), 9).alias("at")))
query("nchoose2", "SELECT c_custkey, c_custkey * (c_custkey - 1) // 2 AS pairs FROM customer")(lambda s, d: table(s, d, "customer").select("c_custkey", F.expr("c_custkey * (c_custkey - 1) div 2").alias("pairs")))
query("hll_pair_query", f"WITH {R}, {CARDS} SELECT i, j, round(u, 6) AS union_size FROM m WHERE i = (SELECT min(g) FROM t)")(lambda s, d: _listed(hll(s, d)))


def _listed(t):
    """Union sizes of the first group with each other one: the pairs are given, no others are made."""
    names = t.select("g").distinct()
    wanted = names.select(F.col("g").alias("j")).crossJoin(F.broadcast(names.agg(F.min("g").alias("i")))).filter("i < j")  # one row
    return rg.comparisons(t, "g", P, wanted).select("i", "j", "union_size")


# sorted-set intersections
query("isz_pairs", f"WITH {EV}, {DV}, {ALL('d', 'g')} SELECT i, j, count(b.k) AS shared FROM q_ JOIN d a ON a.g = i LEFT JOIN d b ON b.g = j AND b.k = a.k GROUP BY ALL")(lambda s, d: pr.filled(pr.group_pairs(e := events(s, d).select("g", "k").distinct(), "g"), pr.meeting(e, "g", ["k"], "k", shared=F.count("*")), shared=0))
query("shs_isz", "WITH a AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) FILTER (o_orderkey % 2 = 0) AS x, list(DISTINCT o_orderpriority) FILTER (o_orderkey % 2 = 1) AS y FROM orders GROUP BY o_custkey) SELECT k, coalesce(len(list_intersect(x, y)), 0)::BIGINT AS shared FROM a")(
    lambda s, d: table(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))).alias("x"), F.collect_set(F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderpriority"))).alias("y")).select("k", F.size(F.array_intersect("x", "y")).cast("bigint").alias("shared"))
)
query("rows_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")(lambda s, d: table(s, d, "orders").select(F.col("o_custkey").alias("k")).intersect(table(s, d, "customer").filter("c_acctbal > 0").select("c_custkey")))
query("rows_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")(lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("k")).exceptAll(table(s, d, "orders").select("o_custkey").distinct()))

# registers: variants and estimates
OP = f"o AS (SELECT g, {REG('h', 7)} AS reg, min({REM('h', 7)}) AS val FROM (SELECT g, {H('k')} AS h FROM v) GROUP BY ALL)"


def oph(s, d, where="true", p=7):
    return rg.oph(events(s, d).filter(where), ["g"], "k", p)


query("hll_error_bound", f"WITH {R} SELECT g, round(1.03896 / sqrt({M}), 9) AS relative, round(1.03896 / sqrt({M}) * {_est('val')}, 4) AS bound FROM t GROUP BY g")(lambda s, d: rg.estimate(hll(s, d), ["g"], P).select("g", F.round(F.lit(1.03896 / math.sqrt(M)), 9).alias("relative"), F.round(1.03896 / math.sqrt(M) * F.col("estimate"), 4).alias("bound")))
query("hll_within_bounds", f"WITH {R}, a AS (SELECT g, count(DISTINCT k) AS n FROM v GROUP BY g), e AS (SELECT g, {_est('val')} AS e FROM t GROUP BY g) SELECT g, abs(n - e) < 2 * 1.03896 / sqrt({M}) * n AS within FROM a JOIN e USING (g)")(lambda s, d: rg.estimate(hll(s, d), ["g"], P).join(events(s, d).groupBy("g").agg(F.countDistinct("k").alias("n")), "g").select("g", (F.abs(F.col("n") - F.col("estimate")) < 2 * 1.03896 / math.sqrt(M) * F.col("n")).alias("within")))
query("hll_sparse_nonzero", f"WITH {R} SELECT g, count(*) AS filled, sum(val)::BIGINT AS total FROM t GROUP BY g")(lambda s, d: hll(s, d).groupBy("g").agg(F.count("*").alias("filled"), F.sum("val").alias("total")))
query("hll_flatten", f"WITH {R}, m AS (SELECT reg, max(val) AS val FROM t GROUP BY reg) SELECT {_est('val')} AS estimate FROM m".replace("SELECT (CASE", "SELECT round((CASE").replace("END) AS estimate", "END), 6) AS estimate"))(lambda s, d: rg.estimate(rg.merge([hll(s, d)], []), [], P))
query("hll_from_oph", f"WITH {EV}, {HLL('t', 'v', 'g', 'k', 7)} SELECT * FROM t")(lambda s, d: sr.ranks_of_minima(oph(s, d), ["g"], 7))
LOGB = math.log(2) * (60 - 7) / 254
query("hll_wide_base", f"WITH {EV}, {OP} SELECT g, reg, (CASE WHEN val = 0 THEN 255 ELSE 255 - ceil(ln(val::DOUBLE) / {LOGB}) END)::INTEGER AS val FROM o")(lambda s, d: sr.wide_base(oph(s, d), ["g"], 7))
query("hll_wide_estimate", f"WITH {EV}, {OP}, w AS (SELECT g, reg, (CASE WHEN val = 0 THEN 255 ELSE 255 - ceil(ln(val::DOUBLE) / {LOGB}) END)::INTEGER AS val FROM o) SELECT g, round(16384 / (sum(pow({2 ** (53 / 254)}, -val)) + 128 - count(*)), 4) AS estimate FROM w GROUP BY g")(lambda s, d: sr.wide_estimate(sr.wide_base(oph(s, d), ["g"], 7), ["g"], 7))
PK = f"k4 AS (SELECT g, reg, least(15, (val - 1) // 4 + 1)::INTEGER AS val FROM t)"
query("hll_packed4", f"WITH {R}, {PK} SELECT * FROM k4")(lambda s, d: sr.packed_radix(hll(s, d), ["g"]))
query("hll_packed4_estimate", f"WITH {R}, {PK}, e AS (SELECT g, {M * M}.0 / (sum(pow(16.0, -val)) + {M} - count(*)) AS e FROM k4 GROUP BY g) SELECT g, round(e / (0.2 * ln(e) - 0.5), 6) AS estimate FROM e")(lambda s, d: sr.packed_estimate(sr.packed_radix(hll(s, d), ["g"]), ["g"], P))
FARM = f"{EV}, w AS (SELECT g, x, {HS('k', 'x')} AS h FROM v CROSS JOIN range(0, 5) s(x)), t AS (SELECT g, x, {REG('h', P)} AS reg, max({RANK('h', P)}) AS val FROM w GROUP BY ALL)"


def farm(s, d):
    """A register table for each of five seeds."""
    out = None
    for x in range(5):
        t = hll(s, d, seed=x).withColumn("x", F.lit(x))
        out = t if out is None else out.unionByName(t)
    return out


query("hll_seed_farm", f"WITH {FARM}, e AS (SELECT g, x, {_est('val')} AS e FROM t GROUP BY g, x) SELECT g, round(avg(round(e, 6)), 4) AS mean, round(median(round(e, 6)), 4) AS median FROM e GROUP BY g")(lambda s, d: rg.estimate(farm(s, d), ["g", "x"], P).groupBy("g").agg(F.round(F.avg("estimate"), 4).alias("mean"), F.round(F.median("estimate"), 4).alias("median")))
query("hll_farm_membership", f"WITH {FARM}, m AS (SELECT x, reg, max(val) AS val FROM t GROUP BY x, reg) SELECT c_custkey AS k, bool_and(coalesce(val, 0) >= {RANK(HS('c_custkey', 's.x'), P)}) AS maybe FROM customer CROSS JOIN range(0, 5) s(x) LEFT JOIN m ON m.x = s.x AND m.reg = {REG(HS('c_custkey', 's.x'), P)} GROUP BY c_custkey")(
    lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("x")).withColumn("h", hx.h60_seeded(F.col("k"), F.col("x"))).withColumn("reg", hx.register(F.col("h"), P)).join(rg.merge([farm(s, d)], ["x"]), ["x", "reg"], "left").groupBy("k").agg(F.every(F.coalesce("val", F.lit(0)) >= hx.rank(F.col("h"), P)).alias("maybe"))
)
query("hll_joint_mle")(lambda s, d: sr.joint_estimates(hll(s, d), "g", P))
FIRST = f"c AS (SELECT g, {REG(H('k'), P)} AS reg, {RANK(H('k'), P)} AS val, min(n) AS n FROM v GROUP BY ALL), u AS (SELECT *, coalesce(max(val) OVER (PARTITION BY g, reg ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS old FROM c), z AS (SELECT g, n, old, val, sum(CASE WHEN old = 0 THEN 1 ELSE pow(2.0, -old) END - pow(2.0, -val)) OVER (PARTITION BY g ORDER BY n) - (CASE WHEN old = 0 THEN 1 ELSE pow(2.0, -old) END - pow(2.0, -val)) AS gone FROM u WHERE val > old)"
query("hll_hip_stream", f"WITH {EV}, {FIRST} SELECT g, round(sum({M} / ({M} - gone)), 4) AS estimate FROM z GROUP BY g")(lambda s, d: rg.first_arrivals(events(s, d), "g", "k", "n", P))
ZEROS = "(length(bin(v)) - length(rtrim(bin(v), '0')))"
HB = f"""v4 AS (SELECT g, h % 4 AS bucket, h // 4 AS v, n FROM (SELECT g, {H('k')} AS h, min(n) AS n FROM v GROUP BY ALL)), z AS (SELECT g, bucket, {ZEROS} AS z, 1::HUGEINT << ((v >> ({ZEROS} + 1)) % 64)::HUGEINT AS bit, n FROM v4),
 r AS (SELECT *, row_number() OVER (PARTITION BY g, bucket ORDER BY n) AS i FROM z WHERE z > 5), s AS (SELECT DISTINCT g, bucket, 0::BIGINT AS i, 5::BIGINT AS lv, 0::HUGEINT AS a, 0::HUGEINT AS b FROM v4
 UNION ALL SELECT g, bucket, i, CASE WHEN bit_count(x) > 31 THEN lv + 1 ELSE lv END, CASE WHEN bit_count(x) > 31 THEN y ELSE x END, CASE WHEN bit_count(x) > 31 THEN 0 ELSE y END FROM (SELECT s.g, s.bucket, r.i, lv, CASE WHEN z > lv THEN a | bit ELSE a END AS x, CASE WHEN z > lv + 1 THEN b | bit ELSE b END AS y FROM s JOIN r ON r.g = s.g AND r.bucket = s.bucket AND r.i = s.i + 1))"""
query("hbb_estimate", f"WITH RECURSIVE {EV}, {HB}, e AS (SELECT g, bucket, arg_max(lv, i) + 5.8 + bit_count(arg_max(a, i)) / 32.0 AS e FROM s GROUP BY g, bucket) SELECT g, round(sum(pow(2.0, e)), 4) AS estimate FROM e GROUP BY g")(lambda s, d: rg.bit_pair_counters(events(s, d), "g", "k", "n", 4))
query("oph_mode_estimates", f"WITH {EV}, {OP}, x AS (SELECT q.g, coalesce((val::DOUBLE + 1) / {1 << 53}.0, 1.0) AS x FROM (SELECT DISTINCT g FROM o) q CROSS JOIN range(0, 128) s(r) LEFT JOIN o ON o.g = q.g AND o.reg = r) SELECT g, round(16384 / sum(x), 4) AS harmonic, round(sum(1 / x), 0) AS arithmetic, round(128 * exp(-sum(ln(x)) / 128), 4) AS geometric, round(128 * {math.log(2)} / median(x), 4) AS median FROM x GROUP BY g")(lambda s, d: sr.mean_estimates(oph(s, d), ["g"], 7))
query("bbit_values", f"WITH {EV}, {OP} SELECT g, reg, val & 255 AS val FROM o")(lambda s, d: oph(s, d).withColumn("val", F.col("val").bitwiseAND(255)))
DB = f"o AS (SELECT g, ({H('k')} % 100)::INTEGER AS reg, min({H('k')} // 100) AS val FROM v GROUP BY ALL)"
query("div_oph_cardinality", f"WITH {EV}, {DB} SELECT g, round(10000 / (sum(val::DOUBLE / {(1 << 60) / 100}) + 100 - count(*)), 4) AS estimate FROM o GROUP BY g")(lambda s, d: rg.div_buckets(events(s, d), ["g"], "k", 100).groupBy("g").agg(F.round(10000 / (F.sum(F.col("val") / ((1 << 60) / 100)) + 100 - F.count("*")), 4).alias("estimate")))
SP = f"sp AS (SELECT g, reg, round(min(x), 9) AS val FROM (SELECT g, r::INTEGER AS reg, row_number() OVER (PARTITION BY g, k ORDER BY {HS('k', 'r')}, r) - 1 + {UNIT(HS('k', 'r + 1000'))} AS x FROM d CROSS JOIN range(0, 16) s(r)) GROUP BY ALL)"
query("superminhash", f"WITH {EV}, {DV}, {SP} SELECT * FROM sp")(lambda s, d: sr.permuted_minima(events(s, d), "g", "k", 16))
query("superminhash_cardinality", f"WITH {EV}, {DV}, {SP} SELECT g, round(256.0 / sum(val), 6) AS estimate FROM sp GROUP BY g")(lambda s, d: sr.permuted_cardinality(sr.permuted_minima(events(s, d), "g", "k", 16), "g", 16))
query("superminhash_jaccard", f"WITH {EV}, {DV}, {SP}, {ALL('sp', 'g')} SELECT i, j, count(b.reg) AS equal FROM q_ JOIN sp a ON a.g = i LEFT JOIN sp b ON b.g = j AND a.reg = b.reg AND a.val = b.val GROUP BY ALL")(lambda s, d: rg.matches(sr.permuted_minima(events(s, d), "g", "k", 16), "g"))
query("kmins_minhash", f"WITH {EV}, {DV} SELECT g, x::INTEGER AS slot, min({HS('k', 'x')}) AS val FROM d CROSS JOIN range(0, 32) s(x) GROUP BY ALL")(lambda s, d: sr.k_minima(events(s, d), "g", "k", 32))
CO = f"co AS (SELECT g, reg, val, cnt FROM (SELECT g, {REG(H('k'), 7)} AS reg, {REM(H('k'), 7)} AS val, count(*) AS cnt FROM v GROUP BY g, k) QUALIFY row_number() OVER (PARTITION BY g, reg ORDER BY val, cnt) = 1)"
query("counting_oph", f"WITH {EV}, {CO} SELECT * FROM co")(lambda s, d: sr.counted_minima(events(s, d), ["g"], "k", 7))
query("counting_oph_jaccard", f"WITH {EV}, {CO}, {ALL('co', 'g')}, a AS (SELECT i, j, x.reg, x.val, x.cnt, 1 AS s FROM q_ JOIN co x ON x.g = i UNION ALL SELECT i, j, y.reg, y.val, y.cnt, 2 FROM q_ JOIN co y ON y.g = j), b AS (SELECT i, j, reg, val, max(cnt) AS hi, CASE WHEN count(*) = 2 THEN min(cnt) ELSE 0 END AS lo FROM a GROUP BY ALL) SELECT i, j, round(sum(lo) / sum(hi), 6) AS jaccard FROM b GROUP BY i, j")(lambda s, d: sr.counted_jaccard(sr.counted_minima(events(s, d), ["g"], "k", 7), "g"))
OJ = f"{ALL('o', 'g')}, e AS (SELECT i, j, sum((a.val = b.val)::INTEGER) AS e FROM q_ JOIN o a ON a.g = i JOIN o b ON b.g = j AND a.reg = b.reg GROUP BY ALL), c AS (SELECT g, 16384.0 / (sum(val::HUGEINT)::DOUBLE / {1 << 53}.0 + (128 - count(*))) AS c FROM o GROUP BY g)"
query("oph_set_measures", f"WITH {EV}, {OP}, {OJ}, x AS (SELECT e.i, e.j, e / 128.0 AS jac, round(a.c, 6) AS a, round(b.c, 6) AS b FROM e JOIN c a ON a.g = i JOIN c b ON b.g = j) SELECT i, j, round(jac, 6) AS jaccard, round((a + b) * jac / (1 + jac), 4) AS intersection, round(a + b - (a + b) * jac / (1 + jac), 4) AS union_size, round((a + b) * jac / (1 + jac) / a, 6) AS containment FROM x")(lambda s, d: rg.oph_measures(oph(s, d), "g", 7))
HM = f"hm AS (SELECT g, {REG(H('k'), 8)} AS reg, max({RANK(H('k'), 8)} * 1024 + ({H('k', 'second')} & 1023)) AS val FROM v GROUP BY ALL)"


def rankrem(s, d, where="true"):
    return rg.hyper(events(s, d).filter(where), ["g"], "k")


query("rankrem_cardinality", f"WITH {EV}, {HM} SELECT g, round(65536.0 / (sum(pow(2.0, -(val >> 10)) * (2046 - (val & 1023)) / 1023) + 256 - count(*)), 4) AS estimate FROM hm GROUP BY g")(lambda s, d: sr.rank_remainder_cardinality(rankrem(s, d), ["g"], 8, 10))
WIDTH = "pow(2.0, -(18 + least(k, 52)))"
LOWER = "CASE WHEN k < 53 THEN pow(2.0, -8 - k) ELSE 0 END"
RJ = f"""c AS (SELECT g, round(65536.0 / (sum(pow(2.0, -(val >> 10)) * (2046 - (val & 1023)) / 1023) + 256 - count(*)), 4) AS card, count(*) AS n FROM hm GROUP BY g), {ALL('hm', 'g')},
 o AS (SELECT {LOWER} + {WIDTH} * f AS z0, {WIDTH} AS w FROM range(1, 54) a(k) CROSS JOIN range(0, 1024) b(f)),
 p AS (SELECT i, j, x.card AS a, y.card AS b, x.n AS na, y.n AS nb, (SELECT count(*) FROM hm l JOIN hm r USING (reg) WHERE l.g = i AND r.g = j) AS c, (SELECT count(*) FROM hm l JOIN hm r USING (reg, val) WHERE l.g = i AND r.g = j) AS e FROM q_ JOIN c x ON x.g = i JOIN c y ON y.g = j),
 k AS (SELECT i, j, sum((pow(1 - z0, a) - pow(1 - least(z0 + w, 1 - 1e-16), a)) * (pow(1 - z0, b) - pow(1 - least(z0 + w, 1 - 1e-16), b))) * 256 AS chance FROM p CROSS JOIN o GROUP BY ALL),
 m AS (SELECT p.i, p.j, a, b, greatest(0.0, (e - least(chance, e)) / (na + nb - c)) AS jac FROM p JOIN k ON k.i = p.i AND k.j = p.j)"""
query("rankrem_jaccard", f"WITH {EV}, {HM}, {RJ} SELECT i, j, round(jac, 6) AS jaccard, round(a + b - (a + b) * jac / (1 + jac), 4) AS union_size, round((a + b) * jac / (1 + jac), 4) AS intersection, round((a + b) * jac / (1 + jac) / a, 6) AS containment FROM m")(lambda s, d: sr.rank_remainder_measures(rankrem(s, d), "g", 8, 10))

# bottom-k
K = 64
KM = f"b AS (SELECT g, h FROM (SELECT DISTINCT g, {H('k')} AS h FROM v) QUALIFY row_number() OVER (PARTITION BY g ORDER BY h) <= {K})"


def smallest(s, d, where="true"):
    return rg.kmv(events(s, d).filter(where), ["g"], "k", K).select("g", "h")


query("bottomk_union", f"WITH {EV}, {KM}, {ALL('b', 'g')} SELECT i, j, h FROM (SELECT DISTINCT i, j, h FROM q_ JOIN b ON b.g IN (i, j)) QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY h) <= {K}")(lambda s, d: sm.bottom_union(pr.group_pairs(t := smallest(s, d), "g"), t, "g", K).select("i", "j", "h"))
query("bottomk_intersection", f"WITH {EV}, {KM}, {ALL('b', 'g')} SELECT i, j, count(y.h) AS shared FROM q_ JOIN b x ON x.g = i LEFT JOIN b y ON y.g = j AND y.h = x.h GROUP BY ALL")(lambda s, d: pr.filled(pr.group_pairs(t := smallest(s, d), "g"), pr.meeting(t, "g", ["h"], "h", shared=F.count("*")), shared=0))
query("topk_largest_hashes", f"WITH {EV} SELECT g, h FROM (SELECT DISTINCT g, {H('k')} AS h FROM v) QUALIFY row_number() OVER (PARTITION BY g ORDER BY h DESC) <= {K}")(lambda s, d: rg.kmv(events(s, d), ["g"], "k", K, largest=True).select("g", "h"))
query("topk_largest_estimate", f"WITH {EV}, b AS (SELECT g, h FROM (SELECT DISTINCT g, {H('k')} AS h FROM v) QUALIFY row_number() OVER (PARTITION BY g ORDER BY h DESC) <= {K}) SELECT g, round(CASE WHEN count(*) < {K} THEN count(*)::DOUBLE ELSE {1 << 60}.0 / ({1 << 60} - min(h)) * {K} END, 6) AS estimate FROM b GROUP BY g")(lambda s, d: rg.kmv(events(s, d), ["g"], "k", K, largest=True).groupBy("g").agg(F.round(F.when(F.count("*") < K, F.count("*").cast("double")).otherwise(float(1 << 60) / ((1 << 60) - F.min("h")) * K), 6).alias("estimate")))
CB = f"cb AS (SELECT g, k, {H('k')} AS h, count(*) AS cnt FROM v GROUP BY g, k QUALIFY row_number() OVER (PARTITION BY g ORDER BY h) <= {K})"


def counted(s, d):
    return rg.counted_smallest(events(s, d), ["g"], "k", K)


query("counting_minhash", f"WITH {EV}, {CB} SELECT g, h, cnt FROM cb")(lambda s, d: counted(s, d).select("g", "h", "cnt"))
CP = f"{ALL('cb', 'g')}, t_ AS (SELECT g, sum(cnt) AS t, sqrt(sum(cnt * cnt)) AS q FROM cb GROUP BY g), s AS (SELECT i, j, sum(CASE WHEN y.cnt IS NULL THEN 0 ELSE least(x.cnt, y.cnt) END) AS lo, sum(x.cnt * coalesce(y.cnt, 0)) AS dot FROM q_ JOIN cb x ON x.g = i LEFT JOIN cb y ON y.g = j AND y.h = x.h GROUP BY ALL), z AS (SELECT s.*, a.t AS ti, b.t AS tj, a.q AS qi, b.q AS qj FROM s JOIN t_ a ON a.g = i JOIN t_ b ON b.g = j)"
query("count_similarity", f"WITH {EV}, {CB}, {CP} SELECT i, j, lo::BIGINT AS isect, round(lo / (ti + tj - lo), 6) AS jaccard, round(lo / ti, 6) AS containment, dot::BIGINT AS dot, round(dot / (qi * qj), 6) AS cosine FROM z")(lambda s, d: sm.counted_measures(counted(s, d), "g", "h", "cnt"))
TF = "w_ AS (SELECT h, ln((SELECT count(DISTINCT g) FROM cb)::DOUBLE / count(DISTINCT g)) + 1 AS idf FROM cb GROUP BY h)"
query("tfidf_similarity", f"WITH {EV}, {CB}, {TF}, {ALL('cb', 'g')}, u AS (SELECT i, j, h, max(cnt) AS hi, CASE WHEN count(*) = 2 THEN min(cnt) ELSE 0 END AS lo FROM q_ JOIN cb ON cb.g IN (i, j) GROUP BY ALL) SELECT i, j, round(sum(lo * idf) / sum(hi * idf), 6) AS similarity FROM u JOIN w_ USING (h) GROUP BY i, j")(lambda s, d: sm.weighted_similarity(counted(s, d), "g", "h", "cnt"))

# Bloom and hash-modulus sets
B = f"b AS (SELECT DISTINCT g, ({HS('k', 'x')} % 16384)::INTEGER AS bit FROM v CROSS JOIN range(0, 3) s(x))"


def bloom(s, d, where="true", seed=0):
    return mb.bits(events(s, d).filter(where), ["g"], "k", 16384, 3, seed)


CARD = "ln(1 - ({}) / 16384.0) / (3 * ln(1 - 1 / 16384.0))"
query("bloom_jaccard", f"WITH {EV}, {B}, {ALL('b', 'g')}, n AS (SELECT g, count(*) AS n FROM b GROUP BY g), c AS (SELECT i, j, count(y.bit) AS c FROM q_ JOIN b x ON x.g = i LEFT JOIN b y ON y.g = j AND x.bit = y.bit GROUP BY ALL), e AS (SELECT i, j, {CARD.format('x.n')} AS a, {CARD.format('y.n')} AS b, {CARD.format('x.n + y.n - c')} AS u, c, x.n + y.n - c AS either FROM c JOIN n x ON x.g = i JOIN n y ON y.g = j) SELECT i, j, round(u, 4) AS union_size, round(greatest(0.0, a + b - u), 4) AS intersection, round(greatest(0.0, a + b - u) / u, 6) AS jaccard, round(greatest(0.0, a + b - u) / a, 6) AS containment, round(c / either, 6) AS bit_jaccard FROM e")(lambda s, d: mb.measures(bloom(s, d), "g", 16384, 3))
query("bloom_resize", f"WITH {EV}, {B} SELECT DISTINCT g, bit % 2048 AS bit FROM b")(lambda s, d: mb.resized(bloom(s, d), ["g"], 16384, 2048))
query("bloom_reseed", f"WITH {EV} SELECT DISTINCT g, ({HS('k', 'x + 77')} % 16384)::INTEGER AS bit FROM v CROSS JOIN range(0, 3) s(x)")(lambda s, d: bloom(s, d, seed=77))
query("bloom_optimal_hashes", "SELECT n, greatest(1, ceil(ln(2) * 8192 / n))::INTEGER AS hashes FROM (SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type)")(lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n")).select("n", mb.optimal_hashes_column(8192, F.col("n")).alias("hashes")))
query("bloom_test_and_add", f"WITH {EV}, r AS (SELECT n, ({HS('k', 'x')} % 16384)::INTEGER AS bit FROM v CROSS JOIN range(0, 3) s(x)), f AS (SELECT bit, min(n) AS first FROM r GROUP BY bit) SELECT n, bool_and(first < n) AS seen FROM r JOIN f USING (bit) GROUP BY n")(lambda s, d: mb.test_and_add(events(s, d), "k", "n", 16384, 3))
query("bloom_batch_words", f"WITH b AS (SELECT DISTINCT ({HS('o_custkey', 'x')} % 16384)::INTEGER AS bit FROM orders CROSS JOIN range(0, 4) t(x)), m AS (SELECT c_custkey AS k, bool_and(({HS('c_custkey', 'x')} % 16384)::INTEGER IN (SELECT bit FROM b)) AS maybe FROM customer CROSS JOIN range(0, 4) t(x) GROUP BY c_custkey) SELECT k // 32 AS word, sum(CASE WHEN maybe THEN 1::BIGINT << (k % 32) ELSE 0 END)::BIGINT AS bits FROM m GROUP BY ALL")(
    lambda s, d: mb.batch_words(mb.may_contain(table(s, d, "customer"), "c_custkey", mb.bits(table(s, d, "orders"), [], "o_custkey", 16384, 4), 16384, 4), "c_custkey", 32)
)
MS = f"m AS (SELECT DISTINCT g, {H('k')} // 4 AS v FROM v WHERE {H('k')} % 4 = 0)"


def sample(s, d, where="true"):
    return mb.mod_sample(events(s, d).filter(where), ["g"], "k", 4)


query("modhash_cardinality", f"WITH {EV}, {MS} SELECT g, count(*) * 4 AS estimate FROM m GROUP BY g")(lambda s, d: sample(s, d).groupBy("g").agg((F.count("*") * 4).alias("estimate")))
query("modhash_jaccard", f"WITH {EV}, {MS}, {ALL('m', 'g')}, n AS (SELECT g, count(*) AS n FROM m GROUP BY g), c AS (SELECT i, j, count(y.v) AS c FROM q_ JOIN m x ON x.g = i LEFT JOIN m y ON y.g = j AND x.v = y.v GROUP BY ALL) SELECT i, j, round(c / (x.n + y.n - c), 6) AS jaccard, round(c / x.n, 6) AS containment, (x.n + y.n - c) * 4 AS union_size FROM c JOIN n x ON x.g = i JOIN n y ON y.g = j")(lambda s, d: mb.sample_measures(sample(s, d), "g", 4))

# set registers
S = 16
CW = f"cw AS (SELECT g, x::INTEGER AS reg, {HS('k', 'x')} AS h, k AS id, cnt FROM (SELECT g, k, count(*) AS cnt FROM v GROUP BY ALL) CROSS JOIN range(0, {S}) s(x) QUALIFY row_number() OVER (PARTITION BY g, x ORDER BY h, k) = 1), c AS (SELECT g, reg, round(-ln(1 - {UNIT('h')}), 9) AS val, id, cnt FROM cw)"


def exponential(s, d, where="true"):
    return sr.winners(events(s, d).filter(where), "g", "k", S).select("g", "reg", "val")


query("css_registers", f"WITH {EV}, {CW} SELECT g, reg, val FROM c")(exponential)
query("css_ids", f"WITH {EV}, {CW} SELECT g, reg, id, cnt FROM c")(lambda s, d: sr.winners(events(s, d), "g", "k", S).select("g", "reg", "id", "cnt"))
CC = f"{ALL('c', 'g')}, e AS (SELECT i, j, sum((x.val > y.val)::INTEGER) AS gt, sum((x.val < y.val)::INTEGER) AS lt, sum((x.val = y.val)::INTEGER) AS eq, {S} / sum(least(x.val, y.val)) AS u, {S} / sum(x.val) AS a, {S} / sum(y.val) AS b FROM q_ JOIN c x ON x.g = i JOIN c y ON y.g = j AND x.reg = y.reg GROUP BY ALL)"
query("setreg_measures", f"WITH {EV}, {CW}, {CC} SELECT i, j, round(eq / {S}, 6) AS jaccard, round(gt / {S}, 6) AS alpha, round(lt / {S}, 6) AS beta, round(u, 6) AS union_size, round(greatest(0.0, a + b - u), 6) AS intersection, round(greatest(0.0, a + b - u) / a, 6) AS containment FROM e")(lambda s, d: sr.shared_measures(exponential(s, d), "g", S))
query("setreg_cosine", f"WITH {EV}, {CW}, {CC} SELECT i, j, round(CASE WHEN gt < {S} AND lt < {S} THEN (1 - round(gt / {S}, 6) - round(lt / {S}, 6)) / sqrt((1 - round(gt / {S}, 6)) * (1 - round(lt / {S}, 6))) ELSE 0 END, 6) AS cosine FROM e")(lambda s, d: sr.shared_measures(exponential(s, d), "g", S).select("i", "j", F.round(F.when((F.col("alpha") < 1) & (F.col("beta") < 1), sr.cosine(F.col("alpha"), F.col("beta"))).otherwise(0.0), 6).alias("cosine")))


def SS(b, a, q, src="d"):
    return f"ss AS (SELECT g, x::INTEGER AS reg, max(greatest(0, least({q + 1}, floor(1 - ln(-ln(1 - {UNIT(HS('k', 'x'))}) / {a!r}) / {math.log(b)!r}))))::BIGINT AS val FROM {src} CROSS JOIN range(0, {S}) s(x) GROUP BY ALL)"


def integers(s, d, preset="byte", rows=None):
    return sr.integer_registers(events(s, d) if rows is None else rows, "g", "k", S, *sr.PRESETS[preset])


BB, BA, BQ = sr.PRESETS["byte"]
query("setreg_direct", f"WITH {EV}, {DV}, {SS(*sr.PRESETS['byte'])} SELECT * FROM ss")(integers)
query("setreg_quantize", f"WITH {EV}, {DV}, {SS(*sr.PRESETS['byte'])} SELECT * FROM ss")(lambda s, d: sm.quantised(sr.winners(events(s, d), "g", "k", S).select("g", "reg", F.col("val").alias("val")), BA, BB, BQ).withColumn("val", F.col("val").cast("bigint")))
query("setreg_cardinality", f"WITH {EV}, {DV}, {SS(*sr.PRESETS['byte'])} SELECT g, round({S} * (1 - 1 / {BB}) / ({BA} * {math.log(BB)!r} * sum(pow({BB}, -val))), 6) AS estimate FROM ss GROUP BY g")(lambda s, d: sr.integer_cardinality(integers(s, d), "g", S, BB, BA))
query("setreg_presets", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {b!r}::DOUBLE, {a!r}::DOUBLE, {q}::BIGINT)" for n, (b, a, q) in sr.PRESETS.items()) + ") v(name, b, a, q)")(lambda s, d: s.createDataFrame([(n, *map(float, v[:2]), v[2]) for n, v in sr.PRESETS.items()], "name string, b double, a double, q long"))
query("setreg_short", f"WITH {EV}, {DV}, {SS(*sr.PRESETS['short'])} SELECT * FROM ss")(lambda s, d: integers(s, d, "short"))
query("setreg_nibble", f"WITH {EV}, {DV}, {SS(*sr.PRESETS['nibble'])} SELECT * FROM ss")(lambda s, d: integers(s, d, "nibble"))
query("setreg_filtered", f"WITH {EV}, d AS (SELECT g, k FROM v GROUP BY ALL HAVING count(*) >= 2), {SS(*sr.PRESETS['byte'])} SELECT * FROM ss")(lambda s, d: integers(s, d, rows=events(s, d).groupBy("g", "k").count().filter("count >= 2")))
query("css_filtered", f"WITH v AS (SELECT event_type AS g, user_id AS k FROM events WHERE user_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 2), {CW} SELECT g, reg, val FROM c")(lambda s, d: sr.winners(events(s, d).groupBy("g", "k").count().filter("count >= 2"), "g", "k", S).select("g", "reg", "val"))
query("optimal_ab", f"WITH {EV}, {CW} SELECT g, round(max(val) / exp(ln(max(val) / min(val)) / 254), 6) AS a, round(exp(ln(max(val) / min(val)) / 254), 6) AS b FROM c GROUP BY g")(lambda s, d: sr.optimal_base(exponential(s, d), ["g"], 254))
BETA = (BB - 1) / BB


def _score(j):
    """Log likelihood of a Jaccard ``j`` from gt, lt and the cardinalities' shares u and v."""
    p, q = (f"(ln(1 - greatest(0, {x} - {y} * ({j})) * {BETA!r}) / -{math.log(BB)!r})" for x, y in (("u", "v"), ("v", "u")))
    return f"(CASE WHEN gt > 0 THEN gt * ln(greatest({p}, 1e-300)) ELSE 0 END + CASE WHEN lt > 0 THEN lt * ln(greatest({q}, 1e-300)) ELSE 0 END + CASE WHEN {S} - gt - lt > 0 THEN ({S} - gt - lt) * ln(greatest(1 - {p} - {q}, 1e-300)) ELSE 0 END)"


GOLD = (math.sqrt(5) - 1) / 2
JM = f"""c AS (SELECT g, round({S} * (1 - 1 / {BB}) / ({BA} * {math.log(BB)!r} * sum(pow({BB}, -val))), 6) AS card FROM ss GROUP BY g), {ALL('ss', 'g')},
 m AS (SELECT i, j, x.card / (x.card + y.card) AS u, y.card / (x.card + y.card) AS v, least(x.card, y.card) / greatest(x.card, y.card) AS top, (SELECT count(*) FROM ss l JOIN ss r USING (reg) WHERE l.g = i AND r.g = j AND l.val > r.val) AS gt, (SELECT count(*) FROM ss l JOIN ss r USING (reg) WHERE l.g = i AND r.g = j AND l.val < r.val) AS lt FROM q_ JOIN c x ON x.g = i JOIN c y ON y.g = j),
 s AS (SELECT *, 0.0::DOUBLE AS lo, top AS hi, 0 AS n FROM m UNION ALL SELECT i, j, u, v, top, gt, lt, CASE WHEN a > b THEN lo ELSE lo + 0 * hi + (hi - {GOLD!r} * (hi - lo) - lo) END, CASE WHEN a > b THEN lo + {GOLD!r} * (hi - lo) ELSE hi END, n + 1 FROM (SELECT *, {_score(f"hi - {GOLD!r} * (hi - lo)")} AS a, {_score(f"lo + {GOLD!r} * (hi - lo)")} AS b FROM s WHERE n < 60)),
 e AS (SELECT i, j, x, {_score("x")} AS score, o FROM (SELECT *, unnest([0.0, (lo + hi) / 2, top]) AS x, unnest([0, 1, 2]) AS o FROM s WHERE n = 60))"""
query("setreg_jmle", f"WITH RECURSIVE {EV}, {DV}, {SS(*sr.PRESETS['byte'])}, {JM} SELECT i, j, round(arg_max(x, score), 4) AS jaccard FROM e GROUP BY i, j")(lambda s, d: sr.joint_likelihood(integers(s, d), "g", S, BB, BA))

# unions: two halves merged are the whole, for every kind of table
EVEN, ODD = "n % 2 = 0", "n % 2 = 1"
query("union_bloom", f"WITH {EV}, {B} SELECT * FROM b")(lambda s, d: bloom(s, d, EVEN).unionByName(bloom(s, d, ODD)).distinct())
query("union_oph", f"WITH {EV}, {OP} SELECT * FROM o")(lambda s, d: rg.merged(["g", "reg"], F.min, oph(s, d, EVEN), oph(s, d, ODD)))
query("union_css", f"WITH {EV}, {CW} SELECT g, reg, val FROM c")(lambda s, d: rg.merged(["g", "reg"], F.min, exponential(s, d, EVEN), exponential(s, d, ODD)))
query("union_setreg", f"WITH {EV}, {DV}, {SS(*sr.PRESETS['byte'])} SELECT * FROM ss")(lambda s, d: rg.merged(["g", "reg"], F.max, *(integers(s, d, rows=events(s, d).filter(w)) for w in (EVEN, ODD))))
query("union_rankrem", f"WITH {EV}, {HM} SELECT * FROM hm")(lambda s, d: rg.merged(["g", "reg"], F.max, rankrem(s, d, EVEN), rankrem(s, d, ODD)))
query("union_pcsa", f"WITH {EV} SELECT g, {REG(H('k'), 6)} AS reg, bit_or((1::BIGINT) << least({RANK(H('k'), 6)} - 1, 62)) AS bits FROM v GROUP BY ALL")(lambda s, d: rg.merged(["g", "reg"], F.bit_or, *(rg.bit_maps(events(s, d).filter(w), ["g"], "k") for w in (EVEN, ODD)), value="bits"))
query("union_modhash", f"WITH {EV}, {MS} SELECT * FROM m")(lambda s, d: sample(s, d, EVEN).union(sample(s, d, ODD)).distinct())
query("union_bottomk", f"WITH {EV}, {KM} SELECT * FROM b")(lambda s, d: rg.merged_smallest(smallest(s, d, EVEN), smallest(s, d, ODD), ["g"], K))
query("union_wide", f"WITH {EV}, {OP} SELECT g, reg, (CASE WHEN val = 0 THEN 255 ELSE 255 - ceil(ln(val::DOUBLE) / {LOGB}) END)::INTEGER AS val FROM o")(lambda s, d: rg.merged(["g", "reg"], F.max, *(sr.wide_base(oph(s, d, w), ["g"], 7) for w in (EVEN, ODD))))
query("union_packed", f"WITH {R}, {PK} SELECT * FROM k4")(lambda s, d: rg.merged(["g", "reg"], F.max, *(sr.packed_radix(hll(s, d, w), ["g"]) for w in (EVEN, ODD))))
query("bloom_and", f"WITH {EV}, b AS (SELECT DISTINCT n % 2 AS half, ({HS('k', 'x')} % 16384)::INTEGER AS bit FROM v CROSS JOIN range(0, 3) s(x)) SELECT bit FROM b GROUP BY bit HAVING count(*) = 2")(lambda s, d: bloom(s, d, EVEN).select("bit").intersect(bloom(s, d, ODD).select("bit")))
query("bloom_xor", f"WITH {EV}, b AS (SELECT DISTINCT n % 2 AS half, ({HS('k', 'x')} % 16384)::INTEGER AS bit FROM v CROSS JOIN range(0, 3) s(x)) SELECT bit FROM b GROUP BY bit HAVING count(*) = 1")(lambda s, d: bloom(s, d, EVEN).select("bit").distinct().unionByName(bloom(s, d, ODD).select("bit").distinct()).groupBy("bit").count().filter("count = 1").select("bit"))
