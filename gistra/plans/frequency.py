"""Queries of counts, weighted sets, top-k, scalars, vectors, storage and streams, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gistra.functions import hashing as hx
from gistra.functions import scalars as sc
from gistra.operators import counts as ct
from gistra.operators import frequency as fq
from gistra.operators import pairs as pr
from gistra.operators import registers as rg
from gistra.operators import setregs as sr
from gistra.operators import similarity as sm
from gistra.operators import vectors as vc
from gistra.operators import weighted as wt
from gistra.plans import catalogue as cat
from gistra.plans import sets as st
from gistra.plans.catalogue import HS, LW, RANK, REG, UNIT, H, query, table
from gistra.plans.sets import EV, P, events
from gistra.sources import tables as io
from gistra.staging import fresh_path

# count tables
CM = cat.CMK
EVEN, ODD = "event_id % 2 = 0", "event_id % 2 = 1"


def _half(sql, half):
    return sql.replace("WHERE user_id IS NOT NULL", f"WHERE user_id IS NOT NULL AND {half}")


def signed(s, d, where="true"):
    return ct.signed_counts(table(s, d, "events").filter(where), "user_id")


query("cm_min", f"WITH a AS ({_half(CM, EVEN)}), b AS ({_half(CM, ODD)}) SELECT row, bucket, least(coalesce(a.cnt, 0), coalesce(b.cnt, 0)) AS cnt FROM a FULL JOIN b USING (row, bucket)")(lambda s, d: ct.combine(cat.cm(s, d, EVEN), cat.cm(s, d, ODD), "min"))
query("cm_saturating", f"WITH c AS ({CM}) SELECT row, bucket, least(cnt, 31) AS cnt FROM c")(lambda s, d: fq.saturated(cat.cm(s, d), 5))
query("cm_weighted_jaccard", f"WITH a AS ({_half(CM, EVEN)}), b AS ({_half(CM, ODD)}), f AS (SELECT row, coalesce(a.cnt, 0) AS x, coalesce(b.cnt, 0) AS y FROM a FULL JOIN b USING (row, bucket)), g AS (SELECT row, sum(least(x, y)) / sum(greatest(x, y)) AS j FROM f GROUP BY row) SELECT round(avg(j), 6) AS jaccard FROM g")(lambda s, d: fq.weighted_jaccard(cat.cm(s, d, EVEN), cat.cm(s, d, ODD)))
query("cm_mean_point", f"WITH c AS ({CM}), t AS (SELECT row, sum(cnt) AS n FROM c GROUP BY row) SELECT user_id, round(median(c.cnt - (n - c.cnt) / 255.0), 6) AS estimate FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL) CROSS JOIN range(0, 4) x(x) JOIN c ON row = x AND bucket = {HS('user_id', 'x')} % 256 JOIN t USING (row) GROUP BY user_id")(lambda s, d: fq.mean_corrected(table(s, d, "events").filter("user_id IS NOT NULL"), "user_id", cat.cm(s, d), 4, 256))
query("cm_membership", f"WITH b AS (SELECT x AS row, ({HS('o_custkey', 'x')} % 4096)::INTEGER AS bucket, count(*) AS cnt FROM orders CROSS JOIN range(0, 4) t(x) GROUP BY ALL) SELECT c_custkey, min(coalesce(cnt, 0)) > 0 AS maybe FROM customer CROSS JOIN range(0, 4) t(x) LEFT JOIN b ON b.row = x AND b.bucket = {HS('c_custkey', 'x')} % 4096 GROUP BY c_custkey")(lambda s, d: ct.count_min_estimate(table(s, d, "customer"), "c_custkey", ct.count_min(table(s, d, "orders"), "o_custkey", 4, 4096), 4, 4096).select("c_custkey", (F.col("estimate") > 0).alias("maybe")))
query("cm_conservative")(lambda s, d: fq.conservative(table(s, d, "events"), "user_id"))
query("cm_conservative_point")(lambda s, d: ct.count_min_estimate(table(s, d, "events").filter("user_id IS NOT NULL"), "user_id", fq.conservative(table(s, d, "events"), "user_id")))
SG = cat.CSK
query("cs_diff", f"WITH a AS ({_half(SG, EVEN)}), b AS ({_half(SG, ODD)}) SELECT row, bucket, coalesce(a.cnt, 0) - coalesce(b.cnt, 0) AS cnt FROM a FULL JOIN b USING (row, bucket)")(lambda s, d: ct.combine(signed(s, d, EVEN), signed(s, d, ODD), "difference"))
query("cs_merge", SG)(lambda s, d: ct.combine(signed(s, d, EVEN), signed(s, d, ODD)))
LG = f"SELECT x::INTEGER AS row, ({HS('user_id', 'x')} % 512)::INTEGER AS bucket, max(floor(-log2({UNIT(H('event_id', 'coin'))})) + 1)::INTEGER AS level FROM events CROSS JOIN range(0, 3) t(x) WHERE user_id IS NOT NULL GROUP BY ALL"
query("log_counter_table", LG)(lambda s, d: fq.log_counters(table(s, d, "events"), "user_id", "event_id", 3, 512))
query("log_counter_point", f"WITH c AS ({LG}) SELECT user_id, CASE WHEN min(coalesce(level, 0)) = 0 THEN 0 ELSE pow(2.0, min(level) - 1) END AS estimate FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL) CROSS JOIN range(0, 3) x(x) LEFT JOIN c ON row = x AND bucket = {HS('user_id', 'x')} % 512 GROUP BY user_id")(lambda s, d: fq.log_estimate(table(s, d, "events"), "user_id", fq.log_counters(table(s, d, "events"), "user_id", "event_id", 3, 512), 3, 512))
query("log_counter_merge", LG)(lambda s, d: rg.merged(["row", "bucket"], F.max, *(fq.log_counters(table(s, d, "events").filter(w), "user_id", "event_id", 3, 512) for w in (EVEN, ODD)), value="level"))
CAS = f"r AS (SELECT user_id, max(least(7, floor(-log2({UNIT(H('(user_id::VARCHAR || chr(47) || event_id::VARCHAR)', 'coin'))})))) AS top FROM events WHERE user_id IS NOT NULL GROUP BY user_id), cb AS (SELECT DISTINCT l::INTEGER AS level, ({HS('user_id', 'l')} % 32768)::INTEGER AS bit FROM r CROSS JOIN range(0, 8) t(l) WHERE l <= top)"


def cascade(s, d):
    return fq.cascade(table(s, d, "events"), "user_id", "event_id", 8, 32768)


query("counting_bloom", f"WITH {CAS} SELECT * FROM cb")(cascade)
CASE_ = f"q AS (SELECT user_id, min(CASE WHEN cb.bit IS NULL THEN l END) AS miss FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL) CROSS JOIN range(0, 8) t(l) LEFT JOIN cb ON cb.level = l AND cb.bit = {HS('user_id', 'l')} % 32768 GROUP BY user_id)"
query("counting_bloom_point", f"WITH {CAS}, {CASE_} SELECT user_id, coalesce(miss, 8)::INTEGER AS level, CASE WHEN miss = 0 THEN 0 ELSE pow(2.0, coalesce(miss, 8) - 1) END AS estimate FROM q")(lambda s, d: fq.cascade_estimate(table(s, d, "events"), "user_id", cascade(s, d), 8, 32768).withColumn("level", F.col("level").cast("int")))
query("counting_bloom_membership", f"WITH {CAS}, k AS (SELECT c_custkey AS k FROM customer) SELECT k, bool_or(cb.bit IS NOT NULL) AS maybe FROM k LEFT JOIN cb ON cb.level = 0 AND cb.bit = {HS('k', '0')} % 32768 GROUP BY k")(lambda s, d: fq.cascade_estimate(table(s, d, "customer").select(F.col("c_custkey").alias("k")), "k", cascade(s, d), 8, 32768).select("k", (F.col("level") > 0).alias("maybe")))
query("counting_bloom_levels", f"WITH {CAS}, h AS (SELECT l::INTEGER AS level, {REG(H('user_id'), 8)} AS reg, max({RANK(H('user_id'), 8)}) AS val FROM r CROSS JOIN range(0, 8) t(l) WHERE l <= top GROUP BY ALL) SELECT * FROM h")(
    lambda s, d: rg.hll(table(s, d, "events").filter("user_id IS NOT NULL").groupBy("user_id").agg(F.max(F.least(F.lit(7), F.floor(-F.log2(hx.unit(hx.h60(F.concat_ws("/", F.col("user_id").cast("string"), F.col("event_id").cast("string")), "coin"))))).cast("int")).alias("top")).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("top")))), ["level"], "user_id", 8)
)
query("lpcqf_counts", f"SELECT {H('user_id')} & 4095 AS slot, count(*) AS cnt FROM events WHERE user_id IS NOT NULL GROUP BY ALL")(lambda s, d: fq.fingerprint_counts(table(s, d, "events"), "user_id", 12))
query("lpcqf_merge", f"SELECT {H('user_id')} & 4095 AS slot, count(*) AS cnt FROM events WHERE user_id IS NOT NULL GROUP BY ALL")(lambda s, d: fq.added(*(fq.fingerprint_counts(table(s, d, "events").filter(w), "user_id", 12) for w in (EVEN, ODD)), ["slot"]))
query("lpcqf_point", f"WITH c AS (SELECT {H('user_id')} & 4095 AS slot, count(*) AS cnt FROM events WHERE user_id IS NOT NULL GROUP BY ALL) SELECT user_id, cnt AS estimate FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL) JOIN c ON slot = {H('user_id')} & 4095")(lambda s, d: table(s, d, "events").filter("user_id IS NOT NULL").select("user_id").distinct().withColumn("slot", hx.h60("user_id").bitwiseAND(4095)).join(fq.fingerprint_counts(table(s, d, "events"), "user_id", 12), "slot").select("user_id", F.col("cnt").alias("estimate")))


def heavy(s, d, where="true"):
    return fq.decaying_cells(table(s, d, "events").filter(where), "user_id", "event_id")


def HKC(name, where="true"):
    """A cell's rows in order, and its state after each of them."""
    at = H("user_id::VARCHAR || '/' || event_id::VARCHAR || '/' || x::VARCHAR", "coin")
    return f"""r_{name} AS (SELECT x AS row, {HS('user_id', 'x')} % 512 AS bucket, {H('user_id')} & 65535 AS fp, {UNIT(at)} AS u, row_number() OVER (PARTITION BY x, {HS('user_id', 'x')} % 512 ORDER BY event_id) AS i FROM events CROSS JOIN range(0, 2) t(x) WHERE user_id IS NOT NULL AND {where}),
 s_{name} AS (SELECT row, bucket, i, fp, 1::BIGINT AS cnt FROM r_{name} WHERE i = 1 UNION ALL SELECT s.row, s.bucket, r.i, CASE WHEN r.fp <> s.fp AND r.u < pow(1.08, -s.cnt) AND s.cnt = 1 THEN r.fp ELSE s.fp END, CASE WHEN r.fp = s.fp THEN s.cnt + 1 WHEN r.u < pow(1.08, -s.cnt) AND s.cnt > 1 THEN s.cnt - 1 ELSE s.cnt END FROM s_{name} s JOIN r_{name} r ON r.row = s.row AND r.bucket = s.bucket AND r.i = s.i + 1),
 {name} AS (SELECT row::INTEGER AS row, bucket::INTEGER AS bucket, arg_max(fp, i) AS fp, arg_max(cnt, i) AS cnt FROM s_{name} GROUP BY s_{name}.row, s_{name}.bucket)"""


HKP = f"SELECT user_id, max(coalesce(cnt, 0)) AS estimate FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL) CROSS JOIN range(0, 2) t(x) LEFT JOIN h ON h.row = x AND h.bucket = {HS('user_id', 'x')} % 512 AND h.fp = {H('user_id')} & 65535 GROUP BY user_id"
query("heavy_keeper_cells", f"WITH RECURSIVE {HKC('h')} SELECT * FROM h")(heavy)
query("heavy_keeper_point", f"WITH RECURSIVE {HKC('h')} {HKP}")(lambda s, d: fq.decaying_estimate(table(s, d, "events"), "user_id", heavy(s, d)))
query("heavy_keeper_merge", f"WITH RECURSIVE {HKC('a', EVEN)}, {HKC('b', ODD)}, m AS (SELECT row, bucket, fp, sum(cnt) AS cnt FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL), k AS (SELECT *, coalesce(lead(cnt) OVER w, 0) AS other, row_number() OVER w AS rk FROM m WINDOW w AS (PARTITION BY row, bucket ORDER BY cnt DESC, fp)) SELECT row, bucket, fp, (cnt - other)::BIGINT AS cnt FROM k WHERE rk = 1 AND cnt > other")(lambda s, d: fq.decaying_merge(heavy(s, d, EVEN), heavy(s, d, ODD)))
query("heavy_keeper_topk", f"WITH RECURSIVE {HKC('h')}, p AS ({HKP}) SELECT user_id, estimate FROM p ORDER BY estimate DESC, {H('user_id')}, user_id LIMIT 20")(lambda s, d: fq.decaying_estimate(table(s, d, "events"), "user_id", heavy(s, d)).orderBy(F.desc("estimate"), hx.h60("user_id"), "user_id").limit(20))
K61 = [1234567890123456789, 987654321987654321, 1111111111111111111, 424242424242424242]
POLY = "{0}::HUGEINT".format(K61[0])
for _k in K61[1:]:
    POLY = f"(({POLY}) * {{x}} + {_k}) % {sc.PRIME}::HUGEINT"


def poly(x):
    return f"({POLY.replace('{x}', x)})::BIGINT"


query("kwise_hash", f"SELECT o_orderkey, {poly('o_orderkey')} AS hash FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", sc.polynomial(F.col("o_orderkey"), K61).alias("hash")))
query("cs_kwise_weighted", f"SELECT ({poly('l_partkey')} % 256)::INTEGER AS bucket, sum(CASE WHEN ({poly('l_partkey')} >> 40) & 1 = 0 THEN l_quantity::BIGINT ELSE -l_quantity::BIGINT END)::BIGINT AS cnt FROM lineitem GROUP BY ALL")(lambda s, d: ct.signed_by(table(s, d, "lineitem"), sc.polynomial(F.col("l_partkey"), K61), F.col("l_quantity").cast("bigint"), 256))
query("ntcard_table", f"SELECT (({H('event_id')} >> 59) & 1)::INTEGER AS half, ({H('event_id')} & 65535)::INTEGER AS slot, count(*) AS cnt FROM events WHERE event_id IS NOT NULL GROUP BY ALL")(lambda s, d: fq.spectrum_table(table(s, d, "events"), "event_id", 0, 16))
NT = f"t AS (SELECT ({H('user_id')} >> 59) & 1 AS half, {H('user_id')} & 65535 AS slot, count(*) AS cnt FROM events WHERE user_id IS NOT NULL GROUP BY ALL), p AS (SELECT cnt, count(*) / 131072.0 AS p FROM t GROUP BY cnt), z AS (SELECT 1 - sum(p) AS p0 FROM p), g AS (SELECT p0, ln(p0) AS l, coalesce((SELECT p FROM p WHERE cnt = 1), 0) AS p1, coalesce((SELECT p FROM p WHERE cnt = 2), 0) AS p2, coalesce((SELECT p FROM p WHERE cnt = 3), 0) AS p3 FROM z), f AS (SELECT *, -p1 / (p0 * l) AS f1 FROM g), f2 AS (SELECT *, -p2 / (p0 * l) - p1 * f1 / (2 * p0) AS f2 FROM f), f3 AS (SELECT *, -p3 / (p0 * l) - (p2 * f1 + 2 * p1 * f2) / (3 * p0) AS f3 FROM f2), w AS (SELECT *, -l * 131072 AS f0 FROM f3)"
query("ntcard_spectrum", f"WITH {NT} SELECT 0::INTEGER AS i, round(f0, 4) AS estimate FROM w UNION ALL SELECT 1, round(abs(f1) * f0, 4) FROM w UNION ALL SELECT 2, round(abs(f2) * f0, 4) FROM w UNION ALL SELECT 3, round(abs(f3) * f0, 4) FROM w")(lambda s, d: fq.spectrum(fq.spectrum_table(table(s, d, "events"), "user_id", 0, 16), 0, 16, 3).select("i", F.round("estimate", 4).alias("estimate")))
query("vac_power_levels", f"SELECT x::INTEGER AS level, {REG(H('user_id'), 8)} AS reg, max({RANK(H('user_id'), 8)}) AS val FROM events CROSS JOIN range(0, 5) t(x) WHERE {UNIT(H('event_id', 'level'))} < pow(1.5, -x) AND user_id IS NOT NULL GROUP BY ALL")(lambda s, d: rg.hll(table(s, d, "events").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(4)))).filter(hx.unit(hx.h60("event_id", "level")) < F.pow(F.lit(1.5), -F.col("level"))), ["level"], "user_id", 8))
query("weighted_adapter", f"WITH u AS (SELECT event_type AS g, user_id::VARCHAR || '#' || row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS k FROM events WHERE user_id IS NOT NULL) SELECT g, {REG(H('k'), 7)} AS reg, min({H('k')} & {(1 << 53) - 1}) AS val FROM u GROUP BY ALL")(lambda s, d: rg.oph(_units(s, d), ["g"], "unit_", 7))
query("weighted_adapter_sqrt", f"WITH t AS (SELECT event_type AS g, user_id AS k, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS t FROM events WHERE user_id IS NOT NULL), u AS (SELECT g, k::VARCHAR || '#' || floor(sqrt(t))::BIGINT AS k FROM t WHERE t = 1 OR floor(sqrt(t)) > floor(sqrt(t - 1))) SELECT g, {REG(H('k'), 7)} AS reg, min({H('k')} & {(1 << 53) - 1}) AS val FROM u GROUP BY ALL")(lambda s, d: rg.oph(_units(s, d, "sqrt"), ["g"], "unit_", 7))


def _units(s, d, transform=None):
    """Rows of every group with a key that counts its occurrences within the group."""
    rows = events(s, d).withColumn("both", F.struct("g", "k"))
    return fq.running_key(rows, "both", ["n"], transform).withColumn("unit_", F.concat_ws("#", F.col("k").cast("string"), F.substring_index("unit_", "#", -1)))


# weighted sets
Q = cat.quantities
PP = f"h AS (SELECT g, k, w, x, row_number() OVER (PARTITION BY g, k ORDER BY {HS('k', 'x')}, x) - 1 AS i FROM c CROSS JOIN range(0, 32) s(x) WHERE w > 0), e AS (SELECT g, k, x, sum(-ln({UNIT(HS('k', 'i + 1000'))}) * 32 / (32 - i)) OVER (PARTITION BY g, k ORDER BY i) / w AS v FROM h)"
query("prob_minhash2", f"WITH {LW}, {PP} SELECT g, x::INTEGER AS slot, k AS key, round(v, 9) AS val FROM e QUALIFY row_number() OVER (PARTITION BY g, x ORDER BY v, k) = 1")(lambda s, d: wt.permuted_points(Q(s, d), "g", "k", "w", 32))
query("prob_minhash2_merge", f"WITH {LW}, {PP} SELECT g, x::INTEGER AS slot, k AS key, round(v, 9) AS val FROM e QUALIFY row_number() OVER (PARTITION BY g, x ORDER BY v, k) = 1")(lambda s, d: wt.permuted_points(Q(s, d).filter("k % 2 = 0"), "g", "k", "w", 32).unionByName(wt.permuted_points(Q(s, d).filter("k % 2 = 1"), "g", "k", "w", 32)).groupBy("g", "slot").agg(F.min(F.struct("val", "key")).alias("p")).select("g", "slot", "p.key", "p.val"))
query("prob_minhash3")(lambda s, d: wt.interval_points(Q(s, d), "g", "k", "w", 32))
query("bagminhash")(lambda s, d: wt.nested_points(Q(s, d), "g", "k", "w", 32, float(1 << 40), 40))
query("bagminhash_similarity")(lambda s, d: wt.agreement(wt.nested_points(Q(s, d), "g", "k", "w", 64, float(1 << 40), 40), "g", 64))
query("darts", f"WITH {LW}, t AS (SELECT g, k AS key, k::VARCHAR || '/' || u::VARCHAR AS name FROM c, LATERAL (SELECT unnest(range(1, 1 + (w // 100)::BIGINT)) AS u)) SELECT g, (({H('name', 'slot')}) % 32)::INTEGER AS slot, key, {H('name', 'place')} AS val FROM t QUALIFY row_number() OVER (PARTITION BY g, slot ORDER BY val, key) = 1")(lambda s, d: wt.darts(Q(s, d), "g", "k", "w", 32, 100.0))
REJ = f"a AS (SELECT id // 512 AS slot, id % 512 AS val, {H('id', 'key')} % 100 + 1 AS k, {UNIT(H('id', 'height'))} AS height FROM range(0, 8192) t(id))"
query("rejection_minhash", f"WITH {LW}, {REJ} SELECT g, slot::INTEGER AS slot, min(val)::INTEGER AS val FROM c JOIN a USING (k) WHERE height * 20000 < w GROUP BY ALL")(lambda s, d: wt.first_hits(Q(s, d), "g", "k", "w", 100, 20000.0, 16, 512))


def _gamma(a, b):
    return f"round(-ln({UNIT(a)}) - ln({UNIT(b)}), 9)"


def _at(tag):
    return H(f"'{tag}/' || row::VARCHAR || '/' || slot::VARCHAR")


query("sample_matrix", f"SELECT row, slot::INTEGER AS slot, {_gamma(_at('a'), _at('b'))} AS r, {_gamma(_at('c'), _at('d'))} AS c, round({UNIT(_at('e'))}, 9) AS beta FROM range(0, 50) a(row) CROSS JOIN range(0, 8) b(slot)")(lambda s, d: wt.sample_matrix(s, 50, 8))
query("gamma", f"SELECT o_orderkey, {_gamma(H('o_orderkey', 1), H('o_orderkey', 2))} AS x FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", F.round(hx.gamma2(hx.h60("o_orderkey", 1), hx.h60("o_orderkey", 2)), 9).alias("x")))

# top-k
query("topk_by_key", "SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL ORDER BY user_id DESC LIMIT 20")(lambda s, d: table(s, d, "events").filter("user_id IS NOT NULL").select("user_id").distinct().orderBy(F.desc("user_id")).limit(20))
query("topk_by_hash", f"SELECT DISTINCT user_id, {H('user_id')} AS h FROM events WHERE user_id IS NOT NULL ORDER BY h, user_id LIMIT 20")(lambda s, d: table(s, d, "events").filter("user_id IS NOT NULL").select("user_id").distinct().withColumn("h", hx.h60("user_id")).orderBy("h", "user_id").limit(20))
query("topk_by_score", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")(lambda s, d: table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20))
PT = cat.ORACLES["cm_point"]
query("topk_estimated", f"WITH p AS ({PT}) SELECT user_id, estimate FROM p ORDER BY estimate DESC, {H('user_id')}, user_id LIMIT 20")(lambda s, d: cat.QUERIES["cm_point"](s, d).orderBy(F.desc("estimate"), hx.h60("user_id"), "user_id").limit(20))
query("top_recovered", f"WITH {cat.EM}, p AS (SELECT vec_id, r AS row, {HS('idx', 'r')} % 16 AS bucket, round(sum(CASE WHEN {HS('idx', 'r + 1000')} % 2 = 0 THEN x ELSE -x END), 6) AS s FROM e CROSS JOIN range(0, 3) t(r) GROUP BY ALL), q AS (SELECT e.vec_id, idx, round(median(CASE WHEN {HS('idx', 't.r + 1000')} % 2 = 0 THEN s ELSE -s END), 6) AS estimate FROM e CROSS JOIN range(0, 3) t(r) JOIN p ON p.vec_id = e.vec_id AND p.row = t.r AND p.bucket = {HS('idx', 't.r')} % 16 GROUP BY ALL) SELECT vec_id, idx, estimate, row_number() OVER (PARTITION BY vec_id ORDER BY abs(estimate) DESC, idx)::INTEGER AS rk FROM q QUALIFY rk <= 5")(lambda s, d: vc.top_indices(cat.QUERIES["cs_recover"](s, d), "vec_id", 5, "estimate"))

# scalars
X = "(c_custkey * 2654435761 + 12345)"


def xs(s, d):
    return table(s, d, "customer").select("c_custkey", F.expr(X).alias("x"))


M64 = "18446744073709551616::HUGEINT"
M32 = "4294967296"


def _signed(x):
    return f"(CASE WHEN ({x}) >= 9223372036854775808::HUGEINT THEN ({x}) - {M64} ELSE ({x}) END)::BIGINT"


def _steps(*steps, source="customer", start=f"{X}::UHUGEINT"):
    """A chain of subqueries, each with the x of the one before."""
    q = f"SELECT c_custkey, {start} AS x FROM {source}"
    for s_ in steps:
        q = f"SELECT c_custkey, {s_} AS x FROM ({q})"
    return q


def _xs(by):
    return f"xor(x, x >> {by})"


WRAP = "18446744073709551616::UHUGEINT"
ONES = "18446744073709551615::UHUGEINT"
query("murmur_finaliser", f"SELECT c_custkey, {_signed('x::HUGEINT')} AS hash FROM ({_steps(_xs(33), f'(x * {sc.FINAL[0]}::UHUGEINT) % {WRAP}', _xs(33), f'(x * {sc.FINAL[1]}::UHUGEINT) % {WRAP}', _xs(33))})")(lambda s, d: xs(s, d).select("c_custkey", sc.arrow64(sc.finaliser)(F.col("x")).alias("hash")))
query("wyhash_stateless", f"SELECT c_custkey, {_signed('x::HUGEINT')} AS hash FROM ({_steps(f'(x + {sc.STEP}::UHUGEINT) % {WRAP}', *(f'xor((x * {m}::UHUGEINT) >> 64, (x * {m}::UHUGEINT) % {WRAP})' for m in sc.MIXERS))})")(lambda s, d: xs(s, d).select("c_custkey", sc.arrow64(sc.stateless)(F.col("x")).alias("hash")))
query("random_stream", f"SELECT c_custkey, {_signed('x::HUGEINT')} AS x FROM ({_steps(f'(x + {sc.STEP}::UHUGEINT) % {WRAP}', *(f'xor((x * {m}::UHUGEINT) >> 64, (x * {m}::UHUGEINT) % {WRAP})' for m in sc.MIXERS), start=f'(42 + c_custkey::UHUGEINT * {sc.STEP}::UHUGEINT) % {WRAP}')})")(lambda s, d: table(s, d, "customer").select("c_custkey", sc.arrow64(lambda v: sc.stream(42, v))(F.col("c_custkey")).alias("x")))
query("permuted_congruence", f"SELECT c_custkey, (((v >> t) | (v << ((32 - t) % 32))) % {M32})::BIGINT AS x FROM (SELECT c_custkey, (xor(x >> 18, x) >> 27) % {M32} AS v, x >> 59 AS t FROM ({_steps(f'(x * {sc.CONGRUENCE[0]}::UHUGEINT + {sc.CONGRUENCE[1]}::UHUGEINT) % {WRAP}')}))")(lambda s, d: xs(s, d).select("c_custkey", sc.arrow64(sc.permuted_congruence)(F.col("x")).alias("x")))
query("wang_hash32", f"SELECT c_custkey, x::BIGINT AS hash FROM ({_steps(f'x % {M32}', f'(4294967295::UHUGEINT - x + x * 32768) % {M32}', _xs(12), f'(x * 5) % {M32}', _xs(4), f'(x * 2057) % {M32}', _xs(16))})")(lambda s, d: xs(s, d).select("c_custkey", sc.arrow64(sc.wang32)(F.col("x")).alias("hash")))
query("wang_roundtrip", f"SELECT c_custkey, {X} AS x FROM customer")(lambda s, d: xs(s, d).select("c_custkey", sc.arrow64(lambda v: hx.wang64_inverse(hx.wang64(v)))(F.col("x")).alias("x")))
query("modular_inverse", "SELECT c_custkey, 1::BIGINT AS product FROM customer")(lambda s, d: xs(s, d).select("c_custkey", sc.arrow64(lambda v: (v | sc.U(1)) * sc.inverse64(v | sc.U(1)))(F.col("x")).alias("product")))
ALG = [("xor", 0x5BD1E995), ("mul", 0x9E3779B97F4A7C15), ("add", 0x1234567), ("rotl", 23)]
query("reversible_hash", f"SELECT c_custkey, {_signed('x::HUGEINT')} AS hash FROM ({_steps(f'xor(x, {ALG[0][1]}::UHUGEINT)', f'(x * {ALG[1][1]}::UHUGEINT) % {WRAP}', f'(x + {ALG[2][1]}::UHUGEINT) % {WRAP}', f'((x << 23) % {WRAP}) + (x >> 41)')})")(lambda s, d: xs(s, d).select("c_custkey", sc.arrow64(lambda v: sc.reversible(v, ALG))(F.col("x")).alias("hash")))
query("reversible_roundtrip", f"SELECT c_custkey, {X} AS x FROM customer")(lambda s, d: xs(s, d).select("c_custkey", sc.arrow64(lambda v: sc.reversible(sc.reversible(v, ALG), sc.reversed_steps(ALG)))(F.col("x")).alias("x")))
query("bit_functions", "SELECT k, 64 - length(bin(k)) AS clz, length(bin(k)) - length(rtrim(bin(k), '0')) AS ctz, length(bin(k)) - length(rtrim(bin(k), '0')) + 1 AS ffs, bit_count(k) AS popcount, length(bin(k)) - 1 AS ilog2, CASE WHEN bit_count(k) = 1 THEN k ELSE 1::BIGINT << length(bin(k)) END AS roundup, bit_count(k) = 1 AS is_pow2, (1::BIGINT << length(bin(k))) - 1 AS bitmask FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey > 0)")(lambda s, d: table(s, d, "customer").filter("c_custkey > 0").select(F.col("c_custkey").alias("k"), *(c.alias(n) for n, c in sc.bit_facts(F.col("c_custkey")).items())))
query("means", "SELECT l_returnflag, round(avg(l_quantity), 6) AS arithmetic, round(exp(avg(ln(l_quantity))), 6) AS geometric, round(count(*) / sum(1 / l_quantity), 6) AS inverse FROM lineitem WHERE l_quantity > 0 GROUP BY l_returnflag")(lambda s, d: table(s, d, "lineitem").filter("l_quantity > 0").groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("arithmetic"), F.round(F.exp(F.avg(F.ln("l_quantity"))), 6).alias("geometric"), F.round(F.count("*") / F.sum(1 / F.col("l_quantity")), 6).alias("inverse")))
query("approximate_log", f"SELECT o_orderkey, round((floor(log2(o_totalprice)) + (o_totalprice / pow(2.0, floor(log2(o_totalprice))) - 1) * (1.3465557 - 0.34655572 * (o_totalprice / pow(2.0, floor(log2(o_totalprice))) - 1))) * {math.log(2)!r}, 6) AS x FROM orders WHERE o_totalprice > 0")(lambda s, d: table(s, d, "orders").filter("o_totalprice > 0").select("o_orderkey", F.round(sc.approximate_ln(F.col("o_totalprice")), 6).alias("x")))
query("kahan_sum", "SELECT l_orderkey, round(sum(l_extendedprice), 4) AS total FROM lineitem GROUP BY l_orderkey")(lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_extendedprice").alias("x")).select("l_orderkey", F.round(sc.compensated_sum(F.col("x")), 4).alias("total")))
query("permutation", f"SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY {H('n_nationkey', 'order3')}, n_nationkey)::INTEGER AS place FROM nation")(lambda s, d: table(s, d, "nation").selectExpr("n_nationkey", "n_regionkey").withColumn("h", wt.hashed_order(F.col("n_nationkey"), 3)).selectExpr("n_nationkey", "row_number() OVER (PARTITION BY n_regionkey ORDER BY h, n_nationkey) AS place"))
query("random_ids", f"SELECT id, {H('id', 'random7')} AS h FROM range(0, 1000) t(id)")(lambda s, d: io.random_ids(s, 1000, 7))
query("hash_ngram_list", f"WITH t AS (SELECT item_id, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS t FROM benchmark), g AS (SELECT item_id, generate_subscripts(t, 1) AS i, t FROM t) SELECT item_id, (i - 1)::INTEGER AS pos, {H('array_to_string(t[i:i + 2], chr(32))')} AS h FROM g WHERE i <= len(t) - 2")(lambda s, d: table(s, d, "benchmark").select("item_id", F.posexplode(hx.ngrams(hx.tokens(F.col("text")), 3)).alias("pos", "gram")).select("item_id", "pos", hx.h60("gram").alias("h")))
query("seeded_hashes", f"SELECT c_custkey, x::INTEGER AS seed, {HS('c_custkey', 'x')} AS h FROM customer CROSS JOIN range(0, 3) t(x)")(lambda s, d: table(s, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seed")).withColumn("h", hx.h60_seeded(F.col("c_custkey"), F.col("seed"))))

# SQL of queries that stand in the catalogue
D32 = "x::HUGEINT"
QUAL = "QUALIFY row_number() OVER (PARTITION BY g, x ORDER BY a) = 1"
WZ = f"p AS (SELECT vec_id, r::INTEGER AS row, ({HS('idx', 'r')} % 16)::INTEGER AS bucket, round(sum((CASE WHEN {HS('idx', 'r + 1000')} % 2 = 0 THEN 1.0 ELSE -1.0 END) * x / pow(-ln({UNIT(HS('idx', chr(39) + 'e' + chr(39)))}), 0.5)), 6) AS s FROM e CROSS JOIN range(0, 3) t(r) GROUP BY ALL)"
BINS = f"{cat.EV}, b AS (SELECT event_type, val, count(*)::DOUBLE AS c FROM r GROUP BY ALL UNION ALL SELECT event_type, 0, {cat.M} - count(*) FROM r GROUP BY event_type)"


def _two(a, b):
    """Gamma(2, 1) of a key and slot."""
    return f"(-ln({UNIT(HS('k', chr(39) + a + chr(39) + ' || x'))}) - ln({UNIT(HS('k', chr(39) + b + chr(39) + ' || x'))}))"


ORDERED = "t AS (SELECT {id}, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS t FROM {src}), w AS (SELECT {id}, generate_subscripts(t, 1) AS pos, unnest(t) AS word FROM t), o AS (SELECT *, row_number() OVER (PARTITION BY {id}, word ORDER BY pos) AS occ FROM w), k AS (SELECT {id}, x, pos, word FROM o CROSS JOIN range(0, 8) s(x) QUALIFY row_number() OVER (PARTITION BY {id}, x ORDER BY {h}, pos) <= 3), r AS (SELECT {id}, x, string_agg(word, ' ' ORDER BY pos) AS run FROM k GROUP BY ALL) SELECT {id}, x::INTEGER AS slot, {v} AS val FROM r"
cat.ORACLES.update(
    wang_hash=f"SELECT c_custkey, {_signed(D32)} AS hash FROM ({_steps(f'({ONES} - x + x * 2097152) % {WRAP}', _xs(24), f'(x * 265) % {WRAP}', _xs(14), f'(x * 21) % {WRAP}', _xs(28), f'(x * 2147483649) % {WRAP}', start='c_custkey::UHUGEINT')})",
    cs_recover=f"WITH {cat.EM}, p AS (SELECT vec_id, r AS row, {HS('idx', 'r')} % 16 AS bucket, round(sum(CASE WHEN {HS('idx', 'r + 1000')} % 2 = 0 THEN x ELSE -x END), 6) AS s FROM e CROSS JOIN range(0, 3) t(r) GROUP BY ALL) SELECT e.vec_id, idx, round(median(CASE WHEN {HS('idx', 't.r + 1000')} % 2 = 0 THEN s ELSE -s END), 6) AS estimate FROM e CROSS JOIN range(0, 3) t(r) JOIN p ON p.vec_id = e.vec_id AND p.row = t.r AND p.bucket = {HS('idx', 't.r')} % 16 GROUP BY ALL",
    wz_project=f"WITH {cat.EM}, {WZ} SELECT * FROM p",
    icws_samples=f"WITH {LW}, s AS (SELECT g, k, x, {_two('a', 'b')} AS r, {_two('c', 'd')} AS c, {UNIT(HS('k', chr(39) + 'e' + chr(39) + ' || x'))} AS beta, w FROM c CROSS JOIN range(0, 32) s(x) WHERE w > 0), t AS (SELECT *, floor(ln(w) / r + beta)::BIGINT AS t FROM s), a AS (SELECT *, c / exp(r * (t - beta + 1)) AS a FROM t) SELECT g, x::INTEGER AS slot, k AS key, t FROM a {QUAL}",
    order_minhash="WITH " + ORDERED.format(id="item_id", src="benchmark", h=HS("word || '#' || occ::VARCHAR", "x"), v=H("run")),
    oph_densify=f"WITH {cat.WORDS}, {cat.OP}, q AS (SELECT DISTINCT source FROM o), f AS (SELECT q.source, r.r AS reg, t.t, CASE WHEN t.t = 0 THEN r.r ELSE {H('r.r::VARCHAR || chr(47) || t.t::VARCHAR')} % 128 END AS slot FROM q CROSS JOIN range(0, 128) r(r) CROSS JOIN range(0, 65) t(t)), g AS (SELECT f.source, f.reg, arg_min(o.val, f.t) FILTER (o.val IS NOT NULL) AS val FROM f LEFT JOIN o ON o.source = f.source AND o.reg = f.slot GROUP BY ALL), n AS (SELECT o.source, r.r AS reg, arg_min(o.val, (o.reg - r.r + 128) % 128) AS val FROM o CROSS JOIN range(0, 128) r(r) GROUP BY ALL) SELECT g.source, g.reg::INTEGER AS reg, coalesce(g.val, n.val) AS val FROM g JOIN n ON n.source = g.source AND n.reg = g.reg",
    hll_estimate_improved=f"WITH {BINS}, z AS (SELECT event_type, sum(CASE WHEN val BETWEEN 1 AND 50 THEN c * pow(2.0, -val) ELSE 0 END) AS s, sum(CASE WHEN val = 0 THEN c ELSE 0 END) / {cat.M} AS x0, 1 - sum(CASE WHEN val = 51 THEN c ELSE 0 END) / {cat.M} AS x1 FROM b GROUP BY event_type), y AS (SELECT event_type, s, x0 + (SELECT sum(pow(x0, pow(2.0, i)) * pow(2.0, i - 1)) FROM range(1, 60) t(i)) AS sigma, (1 - x1 - (SELECT sum(pow(1 - pow(x1, pow(2.0, -i)), 2) * pow(2.0, -i)) FROM range(1, 60) t(i))) / 3 AS tau FROM z) SELECT event_type, round({cat.M} * {cat.M} / (2 * ln(2) * (s + {cat.M} * tau * pow(2.0, -50) + {cat.M} * sigma)), 4) AS estimate FROM y",
    hll_estimate_mle=f"WITH RECURSIVE {BINS}, w AS (SELECT event_type, val, c, pow(2.0, -least(val, 50)) / {cat.M} AS w FROM b), s(event_type, lo, hi, i) AS (SELECT DISTINCT event_type, 1e-6::DOUBLE, 1e9::DOUBLE, 0 FROM w UNION ALL SELECT s.event_type, CASE WHEN sum(CASE WHEN val > 0 THEN c * w / (exp((lo + hi) / 2 * w) - 1) ELSE 0 END) > sum(CASE WHEN val <= 50 THEN c * w ELSE 0 END) THEN (lo + hi) / 2 ELSE lo END, CASE WHEN sum(CASE WHEN val > 0 THEN c * w / (exp((lo + hi) / 2 * w) - 1) ELSE 0 END) > sum(CASE WHEN val <= 50 THEN c * w ELSE 0 END) THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM s JOIN w ON w.event_type = s.event_type WHERE i < 100 GROUP BY s.event_type, lo, hi, i) SELECT event_type, round((lo + hi) / 2, 4) AS estimate FROM s WHERE i = 100",
)

cat.ORACLES["order_minhash_documents"] = "WITH " + ORDERED.format(id="doc_id", src="documents", h=HS("word || '#' || occ::VARCHAR", "x"), v=H("run"))
CONS = f"""t AS (SELECT user_id AS k, count(*) AS w, {H('user_id')} AS h, [{', '.join(f'{256 * r} + ' + HS('user_id', str(r)) + ' % 256' for r in range(4))}] AS pos FROM events WHERE user_id IS NOT NULL GROUP BY user_id),
 r AS (SELECT *, h % 16 AS shard, row_number() OVER (PARTITION BY h % 16 ORDER BY h) AS i FROM t),
 s AS (SELECT DISTINCT shard, 0::BIGINT AS i, list_transform(range(0, 1024), lambda x: 0::BIGINT) AS c FROM r UNION ALL SELECT shard, i, list_transform(c, lambda x, p: CASE WHEN list_contains(pos, p - 1) THEN greatest(x, m) ELSE x END) FROM (SELECT s.shard, r.i, c, pos, list_min(list_transform(pos, lambda a: c[a + 1])) + w AS m FROM s JOIN r ON r.shard = s.shard AND r.i = s.i + 1)),
 f AS (SELECT shard, arg_max(c, i) AS c FROM s GROUP BY shard), u AS (SELECT generate_subscripts(c, 1) - 1 AS p, unnest(c) AS x FROM f), cc AS (SELECT (p // 256)::INTEGER AS row, (p % 256)::INTEGER AS bucket, sum(x)::BIGINT AS cnt FROM u WHERE x > 0 GROUP BY ALL)"""
cat.ORACLES["cm_conservative"] = f"WITH RECURSIVE {CONS} SELECT * FROM cc"
cat.ORACLES["cm_conservative_point"] = f"WITH RECURSIVE {CONS} SELECT user_id, min(coalesce(cnt, 0)) AS estimate FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL) CROSS JOIN range(0, 4) t(x) LEFT JOIN cc ON cc.row = x AND cc.bucket = {HS('user_id', 'x')} % 256 GROUP BY user_id"

# vectors
PS = f"SELECT vec_id, t::INTEGER AS t, round(sum(x * greatest(-30000.0, least(30000.0, tan({math.pi!r} * ({UNIT(HS('idx', 't'))} - 0.5))))), 6) AS s FROM e CROSS JOIN range(0, 15) r(t)"
query("pstable_table", f"WITH {cat.EM} {PS} GROUP BY ALL")(lambda s, d: vc.cauchy_sums(cat.entries(s, d), "vec_id", 15))
cat.ORACLES["pstable_norm"] = f"WITH {cat.EM}, s AS ({PS.replace(', 6) AS s', ', 9) AS s')} GROUP BY ALL) SELECT vec_id, round(median(abs(s)), 4) AS norm FROM s GROUP BY vec_id"
query("pstable_merge", f"WITH {cat.EM} {PS} GROUP BY ALL")(lambda s, d: fq.added(*(vc.cauchy_sums(cat.entries(s, d).filter(w), "vec_id", 15, 12) for w in ("idx % 2 = 0", "idx % 2 = 1")), ["vec_id", "t"], "s").withColumn("s", F.round("s", 6)))
query("pstable_diff", f"WITH {cat.EM} {PS.replace('sum(x *', 'sum((CASE WHEN idx % 2 = 0 THEN x ELSE -x END) *')} GROUP BY ALL")(lambda s, d: fq.added(*(vc.cauchy_sums(cat.entries(s, d).filter(w), "vec_id", 15, 12) for w in ("idx % 2 = 0", "idx % 2 = 1")), ["vec_id", "t"], "s", -1).withColumn("s", F.round("s", 6)))
query("wz_recover", f"WITH {cat.EM}, p AS (SELECT vec_id, r AS row, {HS('idx', 'r')} % 16 AS bucket, round(sum((CASE WHEN {HS('idx', 'r + 1000')} % 2 = 0 THEN 1.0 ELSE -1.0 END) * x / pow(-ln({UNIT(HS('idx', chr(39) + 'e' + chr(39)))}), 0.5)), 6) AS s FROM e CROSS JOIN range(0, 3) t(r) GROUP BY ALL) SELECT e.vec_id, idx, round(median((CASE WHEN {HS('idx', 't.r + 1000')} % 2 = 0 THEN 1.0 ELSE -1.0 END) * s * pow(-ln({UNIT(HS('idx', chr(39) + 'e' + chr(39)))}), 0.5)), 5) AS estimate FROM e CROSS JOIN range(0, 3) t(r) JOIN p ON p.vec_id = e.vec_id AND p.row = t.r AND p.bucket = {HS('idx', 't.r')} % 16 GROUP BY ALL")(lambda s, d: vc.recover(vc.transform(e := cat.entries(s, d), "vec_id", "scaled", 3, 16), e, "vec_id", 3, 16, 2.0, 5))
query("transform_signed", cat.ORACLES["cs_project"])(lambda s, d: vc.transform(cat.entries(s, d), "vec_id", "signed", 3, 16))

# storage: what was written is read back, with its kind and parameters checked


def stored(name, kind, oracle, make, codec="gzip", level=None, **params):
    def run(s, d):
        path = fresh_path(s, kind)
        io.save(make(s, d), path, kind, codec, level, **params)
        return io.load(s, path, kind, **params)

    query(name, oracle)(run)


Z = cat.ORACLES
stored("io_bloom", "bloom", Z["union_bloom"], lambda s, d: st.bloom(s, d), size=16384, hashes=3)
stored("io_wide_registers", "wide", Z["hll_wide_base"], cat.QUERIES["hll_wide_base"], "zstd", 5, p=7)
stored("io_seed_farm", "farm", f"WITH {st.FARM} SELECT g, x::INTEGER AS x, reg, val FROM t", lambda s, d: st.farm(s, d), p=P, seeds=5)
stored("io_oph", "oph", Z["union_oph"], lambda s, d: st.oph(s, d), "gzip", 9, p=7)
stored("io_div_oph", "div_oph", f"WITH {EV}, {st.DB} SELECT * FROM o", lambda s, d: rg.div_buckets(events(s, d), ["g"], "k", 100), m=100)
stored("io_counting_oph", "counting_oph", Z["counting_oph"], cat.QUERIES["counting_oph"], p=7)
stored("io_superminhash", "superminhash", Z["superminhash"], cat.QUERIES["superminhash"], m=16)
stored("io_bottomk", "bottomk", Z["union_bottomk"], lambda s, d: st.smallest(s, d), "snappy", k=64)
stored("io_counting_bottomk", "counting_bottomk", Z["counting_minhash"], cat.QUERIES["counting_minhash"], k=64)
stored("io_css", "css", Z["css_registers"], st.exponential, m=16)
stored("io_setreg", "setreg", Z["setreg_direct"], st.integers, m=16, preset="byte")
stored("io_prob_minhash", "prob_minhash", Z["prob_minhash2"], cat.QUERIES["prob_minhash2"], m=32)
stored("io_rankrem", "rankrem", Z["union_rankrem"], lambda s, d: st.rankrem(s, d), p=8, r=10)
stored("io_signed_counts", "signed", SG, lambda s, d: signed(s, d), rows=5, width=256)
stored("io_modhash", "modhash", Z["union_modhash"], lambda s, d: st.sample(s, d), "none", modulus=4)
query("registers_to_array", f"WITH {EV}, {cat.HLL('t', 'v', 'g', 'k', 6)} SELECT q.g, string_agg(coalesce(val, 0)::VARCHAR, ',' ORDER BY r) AS registers FROM (SELECT DISTINCT g FROM t) q CROSS JOIN range(0, 64) s(r) LEFT JOIN t ON t.g = q.g AND reg = r GROUP BY q.g")(lambda s, d: io.to_arrays(st.hll(s, d, p=6), ["g"], 64).select("g", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("registers")))
query("registers_from_array", f"WITH {EV}, {cat.HLL('t', 'v', 'g', 'k', 6)} SELECT g, reg, val::BIGINT AS val FROM t")(lambda s, d: io.from_numpy(s, *io.to_numpy(io.to_arrays(st.hll(s, d, p=6), ["g"], 64), "g"), "g"))

# banded index
O4 = "o AS (SELECT event_type AS g, user_id AS id, event_id AS k FROM events WHERE user_id IS NOT NULL), r AS (SELECT id, {reg} AS reg, min({rem}) AS val FROM (SELECT id, {h} AS h FROM o) GROUP BY ALL)".format(reg=REG("h", 3), rem=cat.REM("h", 3), h=H("k"))
BK = f"WITH v AS (SELECT c_nationkey AS g, floor(c_acctbal)::BIGINT AS k FROM customer), {st.KM}, p AS (SELECT a.g AS qid, b.g AS id, count(*) AS hits FROM b a JOIN b USING (h) WHERE a.g <> b.g GROUP BY ALL) SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY qid ORDER BY hits DESC, id) <= 5"


def nation_keys(s, d):
    return rg.kmv(table(s, d, "customer").select(F.col("c_nationkey").alias("g"), F.expr("cast(floor(c_acctbal) as bigint)").alias("k")), ["g"], "k", 64).select("g", "h")


query("lsh_bottomk", BK)(lambda s, d: sm.bottom_candidates(nation_keys(s, d), "g", 5))
LB = "n AS (SELECT c_nationkey AS id, {x} AS k FROM customer), o AS (SELECT id, {reg} AS reg, min({rem}) AS val FROM (SELECT id, {h} AS h FROM n) GROUP BY ALL)".format(x="(c_custkey % 40)", reg=REG("h", 3), rem=cat.REM("h", 3), h=H("k"))


def nations(s, d):
    return rg.oph(table(s, d, "customer").selectExpr("c_nationkey AS id", "c_custkey % 40 AS k"), ["id"], "k", 3)


BANDS = "b AS (SELECT id, lv, reg // lv AS sub, string_agg(val::VARCHAR, ',' ORDER BY reg) AS r, count(*) AS n FROM o CROSS JOIN (VALUES (1), (2), (4), (8)) v(lv) GROUP BY ALL), l AS (SELECT lv AS level, sub::INTEGER AS sub, {h} AS key, id FROM b WHERE n = lv)".format(h=H("r"))
query("lsh_default_levels", f"WITH {LB}, {BANDS} SELECT * FROM l")(lambda s, d: sm.bands(nations(s, d), "id", sm.default_levels(8), 8))
query("lsh_insert_query", f"WITH {LB}, {BANDS}, c AS (SELECT q.id AS qid, l.id, max(l.level) AS level, count(*) AS hits FROM l q JOIN l USING (level, sub, key) WHERE l.id < q.id GROUP BY q.id, l.id) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY level DESC, hits DESC, id) <= 3")(lambda s, d: sm.insert_and_query(sm.bands(nations(s, d), "id", sm.default_levels(8), 8), 3))
query("lsh_per_row", f"WITH {LB}, {BANDS} SELECT q.id AS qid, level, sub, count(*) - 1 AS found FROM l q JOIN l USING (level, sub, key) GROUP BY ALL")(lambda s, d: sm.per_row(t := sm.bands(nations(s, d), "id", sm.default_levels(8), 8), t))
query("lsh_start_level", f"WITH {LB}, {BANDS}, c AS (SELECT q.id AS qid, l.id, max(l.level) AS level, count(*) AS hits FROM l q JOIN l USING (level, sub, key) WHERE q.id <> l.id AND level <= 2 GROUP BY q.id, l.id) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY level DESC, hits DESC, id) <= 3")(lambda s, d: sm.candidates((t := sm.bands(nations(s, d), "id", sm.default_levels(8), 8)).filter("level <= 2"), t.filter("level <= 2"), 3))
OV = [[(int(hx.wang64(__import__("numpy").array([8 * sub + 31 * j + 5], dtype="uint64"))[0] % 8)) for j in range(4)] for sub in range(3)]
query("lsh_overflow_rows", "WITH {lb}, w AS (SELECT * FROM (VALUES {v}) v(sub, j, reg)), b AS (SELECT id, sub, string_agg(val::VARCHAR, ',' ORDER BY j) AS r, count(*) AS n FROM o JOIN w USING (reg) GROUP BY id, sub) SELECT 4::INTEGER AS level, (2 + sub)::INTEGER AS sub, {h} AS key, id FROM b WHERE n = 4".format(lb=LB, v=", ".join(f"({a}, {j}, {r})" for a, row in enumerate(OV) for j, r in enumerate(row)), h=H("r")))(lambda s, d: sm.overflow_bands(nations(s, d), "id", 4, 8, 3))

# streams
query("stream_hll", f"WITH {EV}, {cat.HLL('t', 'v', 'g', 'k', 8)} SELECT * FROM t")(lambda s, d: _stream().registers(s, f"{d}/events.parquet", 8))
query("stream_hip", f"WITH {EV}, {st.FIRST} SELECT g, round(sum(1024 / (1024 - gone)), 4) AS estimate FROM z GROUP BY g")(lambda s, d: _stream().hip(s, f"{d}/events.parquet", P))
query("stream_decayed", "SELECT event_type, round(sum(pow(0.5, event_id / 1000.0)), 6) AS weight FROM events GROUP BY event_type")(lambda s, d: _stream().decayed(s, f"{d}/events.parquet", 1000.0))
query("stream_session", "WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events WHERE user_id IS NOT NULL), n AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 6 hour THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l) SELECT user_id, min(ts) AS start, count(*) AS n FROM n GROUP BY user_id, s")(lambda s, d: _stream().sessions(s, f"{d}/events.parquet", "6 hours"))
query("sliding_signed_counts", f"WITH e AS (SELECT * FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 500) SELECT event_type, x::INTEGER AS row, ({HS('user_id', 'x')} % 256)::INTEGER AS bucket, sum(CASE WHEN {HS('user_id', 'x + 1000')} % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS cnt FROM e CROSS JOIN range(0, 5) t(x) GROUP BY ALL")(lambda s, d: ct.last_n_signed(table(s, d, "events").filter("user_id IS NOT NULL"), "user_id", ["ts", "event_id"], 500, "event_type"))


def _stream():
    from gistra.streaming import windows

    return windows
