"""All queries of the summaries, by name, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from gistra.functions import hashing as hx
from gistra.operators import counts as ct
from gistra.operators import membership as mb
from gistra.operators import registers as rg
from gistra.operators import rows as rw
from gistra.operators import similarity as sm
from gistra.operators import vectors as vc
from gistra.staging import cut, fresh_path

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# the oracle's side of the hash functions


def H(x, seed=0):
    return f"('0x' || substr(md5('{seed}:' || ({x})::VARCHAR), 1, 15))::BIGINT"


def HS(x, seed):
    return f"('0x' || substr(md5(({seed})::VARCHAR || ':' || ({x})::VARCHAR), 1, 15))::BIGINT"


def UNIT(h):
    return f"((({h}) >> 8)::DOUBLE + 0.5) / 4503599627370496.0"


def REG(h, p):
    return f"(({h}) >> {60 - p})::INTEGER"


def REM(h, p):
    return f"(({h}) & {(1 << (60 - p)) - 1})"


def RANK(h, p):
    return f"(CASE WHEN {REM(h, p)} = 0 THEN {61 - p} ELSE {61 - p} - length(bin({REM(h, p)})) END)::INTEGER"


def RAW(s, zeros, m):
    a = rg.alpha(m)
    return f"(CASE WHEN {a * m * m} / ({s}) < {2.5 * m} AND ({zeros}) > 0 THEN {m} * ln({m}.0::DOUBLE / ({zeros})) WHEN {a * m * m} / ({s}) > {(1 << 32) / 30} THEN -4294967296.0 * ln(1 - {a * m * m} / ({s}) / 4294967296.0) ELSE {a * m * m} / ({s}) END)"


def HLL(name, src, group, key, p=10):
    return f"{name} AS (SELECT {group}, {REG('h', p)} AS reg, max({RANK('h', p)}) AS val FROM (SELECT {group}, {H(key)} AS h FROM {src}) WHERE h IS NOT NULL GROUP BY ALL)"


def ALL(t, g):
    """All pairs of groups."""
    return f"n_ AS (SELECT DISTINCT {g} AS g FROM {t}), q_ AS (SELECT x.g AS i, y.g AS j FROM n_ x JOIN n_ y ON x.g < y.g)"


P, M = 10, 1024
EV = HLL("r", "events", "event_type", "user_id")
EST = f"SELECT event_type, round({RAW(f'sum(pow(2.0, -val)) + ({M} - count(*))', f'{M} - count(*)', M)}, 6) AS estimate FROM"


def users(spark, d, p=P):
    return rg.hll(table(spark, d, "events"), ["event_type"], "user_id", p)


query("hll_registers", f"WITH {EV} SELECT * FROM r")(users)
query("hll_estimate_original", f"WITH {EV} {EST} r GROUP BY event_type")(lambda s, d: rg.estimate(users(s, d), ["event_type"], P))
query("hll_histogram", f"WITH {EV} SELECT event_type, val, count(*) AS regs FROM r GROUP BY ALL UNION ALL SELECT event_type, 0, {M} - count(*) FROM r GROUP BY event_type HAVING count(*) < {M}")(lambda s, d: rg.histogram(users(s, d), ["event_type"], P))
query("hll_estimate_improved")(lambda s, d: rg.estimate_by(users(s, d), ["event_type"], P, "improved"))
query("hll_estimate_mle")(lambda s, d: rg.estimate_by(users(s, d), ["event_type"], P, "mle"))
query("hll_rollup", f"WITH {EV} SELECT reg, max(val) AS val FROM r GROUP BY reg")(lambda s, d: rg.merge([users(s, d)], []))
query("hll_union", f"WITH {HLL('a', 'orders', '1 AS g', 'o_custkey')}, {HLL('b', 'customer', '1 AS g', 'c_custkey')} SELECT reg, max(val) AS val FROM (SELECT reg, val FROM a UNION ALL SELECT reg, val FROM b) GROUP BY reg")(
    lambda s, d: rg.merge([rg.hll(table(s, d, "orders"), [], "o_custkey", P), rg.hll(table(s, d, "customer"), [], "c_custkey", P)], [])
)
query("hll_fold", f"WITH {HLL('r', 'events', 'event_type', 'user_id', 8)} SELECT * FROM r")(lambda s, d: rg.fold(users(s, d, 11), ["event_type"], 11, 8))
query("hll_membership", f"WITH {HLL('r', 'orders', '1 AS g', 'o_custkey')} SELECT c_custkey, coalesce(val, 0) >= {RANK(H('c_custkey'), P)} AS maybe FROM customer LEFT JOIN r ON reg = {REG(H('c_custkey'), P)}")(
    lambda s, d: rg.contains(table(s, d, "customer").select("c_custkey"), "c_custkey", rg.hll(table(s, d, "orders"), [], "o_custkey", P), P)
)
PAIRS = f"""WITH {HLL('r', 'lineitem', 'l_returnflag', 'l_partkey')}, g AS (SELECT DISTINCT l_returnflag AS g FROM r), k AS (SELECT DISTINCT reg FROM r),
 p AS (SELECT x.g AS i, y.g AS j, k.reg, coalesce(a.val, 0) AS a, coalesce(b.val, 0) AS b FROM g x JOIN g y ON x.g < y.g CROSS JOIN k
  LEFT JOIN r a ON a.l_returnflag = x.g AND a.reg = k.reg LEFT JOIN r b ON b.l_returnflag = y.g AND b.reg = k.reg WHERE a.val IS NOT NULL OR b.val IS NOT NULL)"""


def _raw(c):
    return RAW(f"sum(CASE WHEN {c} > 0 THEN pow(2.0, -{c}) ELSE 0 END) + ({M} - sum(({c} > 0)::INTEGER))", f"{M} - sum(({c} > 0)::INTEGER)", M)


def flags(s, d):
    return rg.hll(table(s, d, "lineitem"), ["l_returnflag"], "l_partkey", P)


query("hll_full_comparison", f"{PAIRS}, e AS (SELECT i, j, {_raw('a')} AS x, {_raw('b')} AS y, {_raw('greatest(a, b)')} AS u FROM p GROUP BY i, j), f AS (SELECT *, greatest(0.0, x + y - u) AS s FROM e) SELECT i, j, round(x, 6) AS card_i, round(y, 6) AS card_j, round(u, 6) AS union_size, round(s, 6) AS intersection, round(s / u, 6) AS jaccard, round(s / x, 6) AS containment, round(x - s, 6) AS a_only, round(y - s, 6) AS b_only FROM f")(
    lambda s, d: rg.comparisons(flags(s, d), "l_returnflag", P)
)
query("register_gtlt", f"{PAIRS} SELECT i, j, sum((a > b)::INTEGER)::BIGINT AS gt, sum((a < b)::INTEGER)::BIGINT AS lt FROM p GROUP BY i, j")(lambda s, d: rg.orders(flags(s, d), "l_returnflag"))
query("register_match", f"WITH {HLL('r', 'lineitem', 'l_returnflag', 'l_partkey')}, {ALL('r', 'l_returnflag')} SELECT i, j, count(b.reg) AS equal FROM q_ JOIN r a ON a.l_returnflag = i LEFT JOIN r b ON b.l_returnflag = j AND a.reg = b.reg AND a.val = b.val GROUP BY ALL")(lambda s, d: rg.matches(flags(s, d), "l_returnflag"))
PC = f"WITH b AS (SELECT event_type, {REG(H('user_id'), 6)} AS reg, bit_or((1::BIGINT) << least({RANK(H('user_id'), 6)} - 1, 62)) AS bits FROM events GROUP BY ALL) SELECT event_type, round(64 * 1.292808 * pow(2.0, sum(length(regexp_extract(reverse(bin(bits)), '^(1*)', 1))) / 64.0), 6) AS estimate FROM b GROUP BY event_type"
query("pcsa_estimate", PC)(lambda s, d: rg.pcsa(table(s, d, "events"), ["event_type"], "user_id"))

WORDS = "w AS (SELECT source, unnest(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS word FROM documents)"
K = 64
KMV = f"k AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY h)::INTEGER AS rk, h FROM (SELECT DISTINCT source, {H('word')} AS h FROM w) QUALIFY rk <= {K})"


def words(s, d):
    """Distinct words of each source: once in a row, then once in all, so that each is hashed once."""
    return table(s, d, "documents").select("source", F.explode(F.array_distinct(hx.tokens(F.col("text")))).alias("word")).distinct()


def smallest(s, d):
    return rg.kmv(words(s, d), ["source"], "word", K).select("source", "rk", "h")


query("bottomk_table", f"WITH {WORDS}, {KMV} SELECT * FROM k")(smallest)
query("kmv_estimate", f"WITH {WORDS}, {KMV} SELECT source, round(CASE WHEN count(*) < {K} THEN count(*)::DOUBLE ELSE {1 << 60}.0 / max(h) * {K} END, 6) AS estimate FROM k GROUP BY source")(lambda s, d: rg.kmv_estimate(smallest(s, d), ["source"], K))
query(
    "bottomk_jaccard",
    f"WITH {WORDS}, {KMV}, {ALL('k', 'source')}, u AS (SELECT i, j, h, count(*) AS c FROM q_ JOIN k ON k.source IN (i, j) GROUP BY ALL), t AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY h) <= {K}) SELECT i, j, sum((c = 2)::INTEGER)::BIGINT AS shared, round(sum((c = 2)::INTEGER)::DOUBLE / count(*), 6) AS jaccard FROM t GROUP BY i, j",
)(lambda s, d: sm.bottom_jaccard(smallest(s, d), "source", K))
OP = f"o AS (SELECT source, {REG('h', 7)} AS reg, min({REM('h', 7)}) AS val FROM (SELECT source, {H('word')} AS h FROM w) GROUP BY ALL)"


def oph(s, d, p=7):
    return rg.oph(words(s, d), ["source"], "word", p)


query("oph_registers", f"WITH {WORDS}, {OP} SELECT * FROM o")(oph)
query("oph_fold", f"WITH {WORDS}, {OP} SELECT * FROM o")(lambda s, d: rg.oph_fold(oph(s, d, 9), ["source"], 9, 7))
query("oph_cardinality", f"WITH {WORDS}, {OP} SELECT source, round(16384.0 / (sum(val::HUGEINT)::DOUBLE / {1 << 53}.0 + (128 - count(*))), 6) AS estimate FROM o GROUP BY source")(lambda s, d: rg.oph_estimate(oph(s, d), ["source"], 7))
query("oph_div_buckets", f"WITH {WORDS} SELECT source, ({H('word')} % 100)::INTEGER AS reg, min({H('word')} // 100) AS val FROM w GROUP BY ALL")(lambda s, d: rg.div_buckets(words(s, d), ["source"], "word", 100))
query("oph_densify")(lambda s, d: rg.densified(oph(s, d), ["source"], 7))
query("bbit_jaccard", f"WITH {WORDS}, {OP}, {ALL('o', 'source')} SELECT i, j, round(greatest(0.0, (count(b.reg) / 128.0 - 1 / 256.0) / (1 - 1 / 256.0)), 6) AS jaccard FROM q_ JOIN o a ON a.source = i LEFT JOIN o b ON b.source = j AND a.reg = b.reg AND a.val & 255 = b.val & 255 GROUP BY ALL")(
    lambda s, d: rg.matches(oph(s, d).withColumn("val", F.col("val").bitwiseAND(255)), "source").select("i", "j", F.round(F.greatest(F.lit(0.0), (F.col("equal") / 128 - 1 / 256) / (1 - 1 / 256)), 6).alias("jaccard"))
)
query("hyperminhash_registers", f"WITH {WORDS} SELECT source, {REG(H('word'), 8)} AS reg, max({RANK(H('word'), 8)} * 1024 + ({H('word', 'second')} & 1023)) AS val FROM w GROUP BY ALL")(lambda s, d: rg.hyper(words(s, d), ["source"], "word"))
query("ccount_eq", f"WITH {WORDS}, {OP}, {ALL('o', 'source')} SELECT i, j, count(b.reg) AS equal FROM q_ JOIN o a ON a.source = i LEFT JOIN o b ON b.source = j AND a.reg = b.reg AND a.val = b.val GROUP BY ALL")(lambda s, d: rg.matches(oph(s, d), "source"))
CS = f"c AS (SELECT source, x AS reg, min({HS('word', 'x')}) AS h FROM (SELECT DISTINCT source, word FROM w) CROSS JOIN range(0, 16) t(x) GROUP BY ALL)"
CV = "-ln(1 - ((h >> 8)::DOUBLE + 0.5) / 4503599627370496.0)"


def continuous(s, d):
    return sm.exponential_registers(words(s, d), "source", "word", 16)


query("css_cardinality", f"WITH {WORDS}, {CS} SELECT source, round(16 / sum({CV}), 4) AS estimate FROM c GROUP BY source")(lambda s, d: continuous(s, d).groupBy("source").agg(F.round(16 / F.sum("val"), 4).alias("estimate")))
query("setreg_registers", f"WITH {WORDS}, {CS} SELECT source, reg::INTEGER AS reg, greatest(0, least(255, floor(1 - ln({CV} / 20) / ln(1.2))))::INTEGER AS val FROM c")(lambda s, d: sm.quantised(continuous(s, d), 20.0, 1.2, 254))

BITS = f"b AS (SELECT DISTINCT source, ({HS('word', 'x')} % 65536)::INTEGER AS bit FROM w CROSS JOIN range(0, 3) t(x))"


def bloom(s, d):
    return mb.bits(words(s, d), ["source"], "word", 65536, 3)


query("bloom_bits", f"WITH {WORDS}, {BITS} SELECT * FROM b")(bloom)
query("bloom_halve", f"WITH {WORDS}, {BITS} SELECT DISTINCT source, bit % 32768 AS bit FROM b")(lambda s, d: mb.halve(bloom(s, d), ["source"], 65536))
query("bloom_cardinality", f"WITH {WORDS}, {BITS} SELECT source, round(ln(1 - count(*) / 65536.0) / (3 * ln(1 - 1 / 65536.0)), 6) AS estimate FROM b GROUP BY source")(lambda s, d: mb.cardinality(bloom(s, d), ["source"], 65536, 3))
query("bloom_and_or_xor", f"WITH {WORDS}, {BITS}, n AS (SELECT source, count(*) AS n FROM b GROUP BY source), {ALL('b', 'source')}, p AS (SELECT i, j, count(y.bit) AS common FROM q_ JOIN b x ON x.source = i LEFT JOIN b y ON y.source = j AND x.bit = y.bit GROUP BY ALL) SELECT i, j, common, x.n + y.n - common AS either, x.n + y.n - 2 * common AS one FROM p JOIN n x ON x.source = i JOIN n y ON y.source = j")(lambda s, d: mb.overlaps(bloom(s, d), "source"))
query("bloom_membership", f"WITH b AS (SELECT DISTINCT ({HS('o_custkey', 'x')} % 16384)::INTEGER AS bit FROM orders CROSS JOIN range(0, 4) t(x)) SELECT c_custkey, bool_and(({HS('c_custkey', 'x')} % 16384)::INTEGER IN (SELECT bit FROM b)) AS maybe FROM customer CROSS JOIN range(0, 4) t(x) GROUP BY c_custkey")(
    lambda s, d: mb.may_contain(table(s, d, "customer"), "c_custkey", mb.bits(table(s, d, "orders"), [], "o_custkey", 16384, 4), 16384, 4)
)
query("modhash_sample", f"WITH {WORDS} SELECT DISTINCT source, {H('word')} // 16 AS v FROM w WHERE {H('word')} % 16 = 0")(lambda s, d: mb.mod_sample(words(s, d), ["source"], "word", 16))
query("modhash_reduce", f"WITH {WORDS} SELECT DISTINCT source, {H('word')} // 64 AS v FROM w WHERE {H('word')} % 64 = 0")(lambda s, d: mb.mod_reduce(mb.mod_sample(words(s, d), ["source"], "word", 16), ["source"], 4))
query("filtered_distinct", f"WITH w AS (SELECT event_type, user_id FROM events GROUP BY ALL HAVING count(*) >= 2), {HLL('r', 'w', 'event_type', 'user_id')} SELECT * FROM r")(lambda s, d: rg.hll(table(s, d, "events").groupBy("event_type", "user_id").count().filter("count >= 2"), ["event_type"], "user_id", P))
query("vac_levels", f"SELECT x::INTEGER AS level, {REG(H('user_id'), 8)} AS reg, max({RANK(H('user_id'), 8)}) AS val FROM events CROSS JOIN range(0, 5) t(x) WHERE {H('event_id', 'level')} % (1::BIGINT << x) = 0 GROUP BY ALL")(
    lambda s, d: rg.hll(table(s, d, "events").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(4)))).filter(F.expr(f"conv(substring(md5(concat('level:', event_id)), 1, 15), 16, 10) % shiftleft(1L, level) = 0")), ["level"], "user_id", 8)
)

CMK = f"SELECT x::INTEGER AS row, ({HS('user_id', 'x')} % 256)::INTEGER AS bucket, count(*) AS cnt FROM events CROSS JOIN range(0, 4) t(x) WHERE user_id IS NOT NULL GROUP BY ALL"
CSK = f"SELECT x::INTEGER AS row, ({HS('user_id', 'x')} % 256)::INTEGER AS bucket, sum(CASE WHEN {HS('user_id', 'x + 1000')} % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS cnt FROM events CROSS JOIN range(0, 5) t(x) WHERE user_id IS NOT NULL GROUP BY ALL"


def cm(s, d, where="true"):
    return ct.count_min(table(s, d, "events").filter(where), "user_id")


def cs(s, d):
    return ct.signed_counts(table(s, d, "events"), "user_id")


query("cm_table", CMK)(cm)
query("cm_point", f"WITH c AS ({CMK}) SELECT user_id, min(cnt) AS estimate FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN range(0, 4) t(x) JOIN c ON row = x AND bucket = {HS('user_id', 'x')} % 256 GROUP BY user_id")(lambda s, d: ct.count_min_estimate(table(s, d, "events"), "user_id", cm(s, d)))
query("cm_merge", CMK)(lambda s, d: ct.combine(cm(s, d, "event_id % 2 = 0"), cm(s, d, "event_id % 2 = 1")))
query("cm_l2", f"WITH c AS ({CMK}), q AS (SELECT row, sum(cnt * cnt) AS s FROM c GROUP BY row) SELECT round(sqrt(median(s)), 6) AS l2 FROM q")(lambda s, d: ct.l2(cm(s, d)))
query("cs_table", CSK)(cs)
query("cs_fold", CSK.replace("% 256", "% 64"))(lambda s, d: ct.fold(cs(s, d), 64))
query("cs_point", f"WITH c AS ({CSK}) SELECT user_id, median(CASE WHEN {HS('user_id', 'x + 1000')} % 2 = 0 THEN cnt ELSE -cnt END) AS estimate FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN range(0, 5) t(x) JOIN c ON row = x AND bucket = {HS('user_id', 'x')} % 256 GROUP BY user_id")(lambda s, d: ct.signed_estimate(table(s, d, "events"), "user_id", cs(s, d)))


def _side(name, key):
    return f"SELECT x AS row, {HS(key, 'x')} % 256 AS bucket, sum(CASE WHEN {HS(key, 'x + 1000')} % 2 = 0 THEN 1 ELSE -1 END) AS cnt FROM {name} CROSS JOIN range(0, 5) t(x) GROUP BY ALL"


query("cs_join_size", f"WITH a AS ({_side('orders', 'o_orderkey')}), b AS ({_side('lineitem', 'l_orderkey')}), q AS (SELECT row, sum(a.cnt * b.cnt) AS s FROM a JOIN b USING (row, bucket) GROUP BY row) SELECT median(s) AS join_size FROM q")(
    lambda s, d: ct.join_size(ct.signed_counts(table(s, d, "orders"), "o_orderkey"), ct.signed_counts(table(s, d, "lineitem"), "l_orderkey"))
)
query("topk_counts", f"SELECT user_id, count(*) AS cnt FROM events GROUP BY user_id ORDER BY cnt DESC, {H('user_id')}, user_id LIMIT 20")(lambda s, d: ct.top_k(table(s, d, "events"), "user_id", 20))
query("heavy_hitters", "SELECT event_type, count(*) AS cnt FROM events GROUP BY event_type HAVING count(*) >= 0.1 * (SELECT count(*) FROM events)")(lambda s, d: ct.heavy_hitters(table(s, d, "events"), "event_type", 0.1))
query("running_count", "SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS seen FROM events")(lambda s, d: ct.running_count(table(s, d, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "seen"))
query("decayed_count", "SELECT event_type, round(sum(pow(0.5, event_id / 1000.0)), 6) AS weight FROM events GROUP BY event_type")(lambda s, d: ct.decayed(table(s, d, "events"), "event_type", "event_id", 1000.0))
query("sliding_last_n", "SELECT event_type, user_id, count(*) AS cnt FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 500) GROUP BY ALL")(lambda s, d: ct.last_n(table(s, d, "events"), "user_id", ["ts", "event_id"], 500, "event_type"))

GRAMS = "SELECT doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' '))) AS gram FROM (SELECT doc_id, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS t FROM documents)"


def tokenised(s, d):
    return table(s, d, "documents").select("doc_id", hx.tokens(F.col("text")).alias("t"))


def index(s, d):
    return sm.bands(rw.gram_minima(tokenised(s, d), "doc_id", "t", 3, 4), "doc_id", [2, 4, 8], 16)


LSH = f"o AS (SELECT doc_id, {REG('h', 4)} AS reg, min({REM('h', 4)}) AS val FROM (SELECT doc_id, {H('gram')} AS h FROM g) GROUP BY ALL), b AS (SELECT doc_id, lv, reg // lv AS sub, string_agg(val::VARCHAR, ',' ORDER BY reg) AS r, count(*) AS n FROM o CROSS JOIN (VALUES (2), (4), (8)) v(lv) GROUP BY ALL), l AS (SELECT lv AS level, sub::INTEGER AS sub, {H('r')} AS key, doc_id AS id FROM b WHERE n = lv)"
query("hash_ngrams", f"WITH g AS ({GRAMS}) SELECT doc_id, count(*) AS n, count(DISTINCT {H('gram')}) AS kinds FROM g GROUP BY doc_id")(lambda s, d: rw.gram_counts(tokenised(s, d), "doc_id", "t", 3))
query("lsh_buckets", f"WITH g AS ({GRAMS}), {LSH} SELECT * FROM l")(index)
query("lsh_candidates", f"WITH g AS ({GRAMS}), {LSH}, c AS (SELECT q.id AS qid, l.id, max(l.level) AS level, count(*) AS hits FROM l q JOIN l USING (level, sub, key) WHERE q.id <> l.id GROUP BY q.id, l.id) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY level DESC, hits DESC, id) <= 10")(lambda s, d: sm.candidates(t := cut(index(s, d), "index"), t, 10))
LW = "c AS (SELECT l_returnflag AS g, l_suppkey AS k, sum(l_quantity)::BIGINT AS w FROM lineitem GROUP BY ALL)"


def quantities(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").cast("bigint").alias("w"))


query("weighted_hist_intersection", f"WITH {LW}, t AS (SELECT g, sum(w) AS t FROM c GROUP BY g), {ALL('c', 'g')}, s AS (SELECT i, j, sum(CASE WHEN b.w IS NULL THEN 0 ELSE least(a.w, b.w) END) AS isect, sum(a.w * coalesce(b.w, 0)) AS dot FROM q_ JOIN c a ON a.g = i LEFT JOIN c b ON b.g = j AND b.k = a.k GROUP BY ALL) SELECT i, j, isect::BIGINT AS isect, (x.t + y.t - isect)::BIGINT AS unite, round(isect / (x.t + y.t - isect), 6) AS jaccard, dot::BIGINT AS dot FROM s JOIN t x ON x.g = i JOIN t y ON y.g = j")(
    lambda s, d: sm.weighted_pairs(quantities(s, d), "g", "k", "w")
)
query("icws_samples")(lambda s, d: sm.icws(quantities(s, d), "g", "k", "w", 32))
query("prob_minhash", f"WITH {LW} SELECT g, x::INTEGER AS slot, arg_min(k, -ln({UNIT(HS('k', 'x'))}) / w) AS key FROM c CROSS JOIN range(0, 32) t(x) WHERE w > 0 GROUP BY ALL")(lambda s, d: sm.prob_min(quantities(s, d), "g", "k", "w", 32))
query("order_minhash")(lambda s, d: sm.order_min(table(s, d, "benchmark").select("item_id", hx.tokens(F.col("text")).alias("t")), "item_id", "t", 8, 3))
query("order_minhash_documents")(lambda s, d: sm.order_min(table(s, d, "documents").select("doc_id", hx.tokens(F.col("text")).alias("t")), "doc_id", "t", 8, 3))

EM = "e AS (SELECT vec_id, unnest(range(0, len(embedding)))::INTEGER AS idx, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def entries(s, d):
    return vc.long_form(table(s, d, "embeddings"), "vec_id", "embedding")


query("cs_project", f"WITH {EM} SELECT vec_id, r::INTEGER AS row, ({HS('idx', 'r')} % 16)::INTEGER AS bucket, round(sum(CASE WHEN {HS('idx', 'r + 1000')} % 2 = 0 THEN x ELSE -x END), 6) AS s FROM e CROSS JOIN range(0, 3) t(r) GROUP BY ALL")(lambda s, d: vc.project(entries(s, d), "vec_id", 3, 16))
query("cs_recover")(lambda s, d: vc.recover(vc.project(e := entries(s, d), "vec_id", 3, 16), e, "vec_id", 3, 16))
query("wz_project")(lambda s, d: vc.project(entries(s, d), "vec_id", 3, 16, 2.0))
query("pstable_norm")(lambda s, d: vc.l1_norm(entries(s, d), "vec_id", 15))
query("top_indices", f"WITH {EM} SELECT vec_id, idx, x, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, idx)::INTEGER AS rk FROM e QUALIFY rk <= 5")(lambda s, d: vc.top_indices(entries(s, d), "vec_id", 5))
query("dd_bins", "SELECT l_returnflag, ceil(ln(l_extendedprice) / ln(1.01 / 0.99))::INTEGER AS bin, count(*) AS cnt FROM lineitem WHERE l_extendedprice > 0 GROUP BY ALL")(lambda s, d: vc.log_bins(table(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.01))
query("dd_quantile", "WITH b AS (SELECT l_returnflag, ceil(ln(l_extendedprice) / ln(1.01 / 0.99))::INTEGER AS bin, count(*) AS cnt FROM lineitem WHERE l_extendedprice > 0 GROUP BY ALL), r AS (SELECT *, sum(cnt) OVER (PARTITION BY l_returnflag ORDER BY bin) AS below, sum(cnt) OVER (PARTITION BY l_returnflag) AS total FROM b) SELECT l_returnflag, round(2 * pow(1.01 / 0.99, min(bin)) / (1.01 / 0.99 + 1), 6) AS quantile FROM r WHERE below >= ceil(total * 0.9) GROUP BY l_returnflag")(
    lambda s, d: vc.bin_quantile(vc.log_bins(table(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.01), ["l_returnflag"], 0.9, 0.01)
)
query("online_stats", "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS variance, round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem GROUP BY l_returnflag")(lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.var_samp("l_quantity"), 6).alias("variance"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("pearson")))
query("kmers", f"WITH k AS (SELECT item_id, unnest(list_transform(range(1, length(text) - 19), lambda i: substr(text, i, 21))) AS kmer FROM benchmark) SELECT item_id, count(DISTINCT {H('kmer')}) AS kinds FROM k GROUP BY item_id")(lambda s, d: table(s, d, "benchmark").select("item_id", F.explode(hx.kmers(F.col("text"), 21)).alias("kmer")).groupBy("item_id").agg(F.countDistinct(hx.h60("kmer")).alias("kinds")))
query("kmers_documents")(lambda s, d: rw.kmer_kinds(table(s, d, "documents"), "doc_id", "text", 21))
query("fast_div_mod", "SELECT o_orderkey, o_orderkey // 97 AS quotient, o_orderkey % 97 AS rest FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", F.expr("o_orderkey div 97").alias("quotient"), (F.col("o_orderkey") % 97).alias("rest")))
query("delta_encode", "SELECT c_custkey, c_custkey - coalesce(lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey), 0) AS delta FROM customer")(
    lambda s, d: table(s, d, "customer").selectExpr("c_custkey", "c_custkey - coalesce(lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey), 0) AS delta")
)
query("wang_hash")(lambda s, d: table(s, d, "customer").select("c_custkey", hx.wang_column(F.col("c_custkey")).alias("hash")))


@query("parquet_roundtrip", f"WITH {EV} SELECT * FROM r")
def _roundtrip(s, d):
    path = fresh_path(s, "registers")
    users(s, d).write.option("compression", "gzip").parquet(path)
    return s.read.parquet(path)


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _stream(s, d):
    from gistra.streaming.windows import tumbling

    return tumbling(s, f"{d}/events.parquet", "1 hour")
