"""Paired-end operators."""

from __future__ import annotations

from pyspark.sql import functions as F

import strandwise.plans.fixtures  # noqa: F401  (defines the derived tables)
from strandwise.operators import pairing as P
from strandwise.plans.registry import FIXTURES, fixture, query

BOUNDS = [(0, 50, 4000), (1, 10, 6000), (2, 30, 5000)]
_B = " UNION ALL ".join(f"SELECT {o} AS orient, {lo} AS low, {hi} AS high" for o, lo, hi in BOUNDS)

FIXTURES["hits"] = "SELECT read_id % 5000 AS pair_id, (read_id + k) % 2 AS mate, rid % 3 AS rid, rb AS pos, (k + rid) % 2 AS rev, score, k * 1000000 + read_id AS k, 40 + score % 20 AS len FROM {regions}"
FIXTURES["oriented"] = "SELECT *, xor_(same, p2 > b1) AS orient, abs(p2 - b1) AS dist FROM (SELECT *, CASE WHEN same THEN b2 ELSE 2 * l_pac - 1 - b2 END AS p2 FROM (SELECT *, (b1 >= l_pac) = (b2 >= l_pac) AS same FROM {ends}) AS x) AS y"
FIXTURES["oriented"] = FIXTURES["oriented"].replace("xor_(same, p2 > b1)", "CASE WHEN same AND p2 > b1 THEN 0 WHEN same THEN 3 WHEN p2 > b1 THEN 1 ELSE 2 END")


def bounds(spark):
    return spark.createDataFrame(BOUNDS, "orient int, low int, high int")


_Q = "CAST(trunc({0} + .499) AS INT)"


@query(
    "pestat",
    f"""WITH u AS (SELECT batch, orient, dist, row_number() OVER (PARTITION BY batch, orient ORDER BY dist) - 1 AS i, count(*) OVER (PARTITION BY batch, orient) AS n FROM {{oriented}} WHERE sub1 <= 0.8 * s1 AND sub2 <= 0.8 * s2 AND dist > 0 AND dist <= 10000),
q AS (SELECT batch, orient, n, max(dist) FILTER (i = CAST(trunc(.25 * n + .499) AS BIGINT)) AS p25, max(dist) FILTER (i = CAST(trunc(.75 * n + .499) AS BIGINT)) AS p75 FROM u GROUP BY batch, orient, n),
b AS (SELECT *, greatest({_Q.format('p25 - 2.0 * (p75 - p25)')}, 1) AS lo2, {_Q.format('p75 + 2.0 * (p75 - p25)')} AS hi2 FROM q),
m AS (SELECT batch, orient, sum(dist) / count(*)::DOUBLE AS avg FROM u JOIN b USING (batch, orient) WHERE dist BETWEEN lo2 AND hi2 GROUP BY batch, orient),
s AS (SELECT batch, orient, any_value(avg) AS avg, sqrt(sum((dist - avg) * (dist - avg)) / count(*)) AS std FROM u JOIN b USING (batch, orient) JOIN m USING (batch, orient) WHERE dist BETWEEN lo2 AND hi2 GROUP BY batch, orient),
f AS (SELECT *, {_Q.format('p25 - 3.0 * (p75 - p25)')} AS l3, {_Q.format('p75 + 3.0 * (p75 - p25)')} AS h3 FROM b JOIN s USING (batch, orient))
SELECT batch, orient, n AS n_pairs, CASE WHEN n >= 10 THEN greatest(CASE WHEN l3 > avg - 4 * std THEN {_Q.format('avg - 4 * std')} ELSE l3 END, 1) END AS low, CASE WHEN n >= 10 THEN CASE WHEN h3 < avg + 4 * std THEN {_Q.format('avg + 4 * std')} ELSE h3 END END AS high,
CASE WHEN n >= 10 THEN avg END AS avg, CASE WHEN n >= 10 THEN std END AS std, n < 10 OR n < 0.05 * max(n) OVER (PARTITION BY batch) AS failed FROM f""",
)
def pestat(spark, d):
    return P.insert_stats(P.unique_pairs(fixture(spark, d, "ends")), ["batch"])


def _external(bias: str, least: int, where: str, size: str, longest: str) -> str:
    return f"""WITH u AS (SELECT batch, {size} AS size, {longest} AS len FROM {{ends}} WHERE {where}), w AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY size) - 1 AS i, count(*) OVER (PARTITION BY batch) AS n FROM u),
q AS (SELECT batch, n, max(len) AS longest, max(size) FILTER (i = CAST(trunc(.25 * n + {bias}) AS BIGINT)) AS p25, max(size) FILTER (i = CAST(trunc(.5 * n + {bias}) AS BIGINT)) AS p50, max(size) FILTER (i = CAST(trunc(.75 * n + {bias}) AS BIGINT)) AS p75 FROM w GROUP BY batch, n HAVING n >= {least}),
b AS (SELECT *, greatest({_Q.format('p25 - 2.0 * (p75 - p25)')}, longest, 1) AS low, {_Q.format('p75 + 2.0 * (p75 - p25)')} AS high FROM q),
k AS (SELECT u.batch, size, avg(size) OVER (PARTITION BY u.batch) AS avg FROM u JOIN b USING (batch) WHERE size BETWEEN low AND high),
m AS (SELECT batch, any_value(avg) AS avg, avg(pow(size - avg, 2)) AS m2, avg(pow(size - avg, 3)) AS m3, avg(pow(size - avg, 4)) AS m4 FROM k GROUP BY batch)
SELECT batch, n AS n_pairs, p25, p50, p75, low, high, longest, avg, sqrt(m2) AS std, m3 / pow(sqrt(m2), 3) AS skewness, m4 / (m2 * m2) - 3 AS kurtosis FROM b JOIN m USING (batch) WHERE low <= high"""


_SIZE = "CASE WHEN b1 < b2 THEN b2 + 100 - b1 ELSE b1 + 100 - b2 END"


@query("isize_aln", _external(".5", 20, f"sub1 < 60 AND {_SIZE} < 100000", _SIZE, "80 + c % 20"))
def isize_aln(spark, d):
    x = fixture(spark, d, "ends").where("sub1 < 60").withColumn("size", F.expr(_SIZE)).where("size < 100000").withColumn("len", F.expr("80 + c % 20"))
    return P.external_stats(x, ["batch"], "len", 20, 0.5)


_SW = "CASE WHEN b1 > b2 THEN b1 - b2 + 90 ELSE b2 - b1 + 90 END"


@query("isize_sw", _external(".499", 8, f"sub1 <= 0.8 * s1 AND sub2 <= 0.8 * s2 AND {_SW} < 20000", _SW, "70 + c % 20"))
def isize_sw(spark, d):
    x = fixture(spark, d, "ends").where("sub1 <= 0.8 * s1 and sub2 <= 0.8 * s2").withColumn("size", F.expr(_SW)).where("size < 20000").withColumn("len", F.expr("70 + c % 20"))
    return P.external_stats(x, ["batch"], "len", 8, 0.499)


_PAIR = f"SELECT a.pair_id, b.orient, y.pos - a.pos AS dist, a.k AS k_a, y.k AS k_b, a.pos AS pos_a, y.pos AS pos_b, a.rev AS rev_a, y.rev AS rev_b, a.mate AS mate_a, a.score + y.score AS q FROM {{hits}} a JOIN {{hits}} y ON a.pair_id = y.pair_id AND a.rid = y.rid AND a.mate <> y.mate AND (a.pos, a.score, a.k, a.rev, a.mate) < (y.pos, y.score, y.k, y.rev, y.mate) JOIN ({_B}) b ON b.orient = a.rev * 2 + y.rev AND y.pos - a.pos BETWEEN low AND high"


def _cands(spark, d):
    return P.candidate_pairs(fixture(spark, d, "hits"), bounds(spark)).withColumn("q", F.col("score_a") + F.col("score_b"))


@query("mem_pair", f"SELECT pair_id, orient, dist, k_a, k_b FROM ({_PAIR})")
def mem_pair(spark, d):
    return _cands(spark, d).select("pair_id", "orient", "dist", "k_a", "k_b")


@query("mem_pair_sub", f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY q DESC, pos_a, pos_b, k_a, k_b, rev_a, rev_b, mate_a) AS nth FROM ({_PAIR})), s AS (SELECT *, coalesce(max(q) FILTER (nth = 2) OVER (PARTITION BY pair_id), 0) AS sub FROM r) SELECT pair_id, max(q) AS best, max(sub) AS sub, count(*) FILTER (nth > 1 AND sub - q <= 7) AS n_sub FROM s GROUP BY pair_id")
def mem_pair_sub(spark, d):
    return P.best_pairs(_cands(spark, d))


@query("rescue_need", f"SELECT DISTINCT e.pair_id, b.orient FROM {{oriented}} e, ({_B}) b WHERE NOT EXISTS (SELECT 1 FROM {{oriented}} x JOIN ({_B}) y USING (orient) WHERE x.pair_id = e.pair_id AND x.orient = b.orient AND dist BETWEEN low AND high)")
def rescue_need(spark, d):
    return P.rescue_needed(P.unique_pairs(fixture(spark, d, "ends").withColumns({"sub1": F.lit(0), "sub2": F.lit(0)})), bounds(spark))


@query(
    "rescue_win",
    f"""SELECT read_id, k, rid, orient, greatest(CASE WHEN lg THEN rb + low ELSE rb - high END - CASE WHEN fl THEN 60 ELSE 0 END, 0) AS wb, least(CASE WHEN lg THEN rb + high ELSE rb - low END + CASE WHEN fl THEN 0 ELSE 60 END, 42000) AS we, fl AS flip
FROM (SELECT *, orient < 2 AS lg, orient IN (1, 2) AS fl FROM {{regions}}, ({_B}) b) WHERE greatest(CASE WHEN lg THEN rb + low ELSE rb - high END - CASE WHEN fl THEN 60 ELSE 0 END, 0) < least(CASE WHEN lg THEN rb + high ELSE rb - low END + CASE WHEN fl THEN 0 ELSE 60 END, 42000)""",
)
def rescue_win(spark, d):
    return P.rescue_windows(fixture(spark, d, "regions"), bounds(spark), 21000, 60).select("read_id", "k", "rid", "orient", "wb", "we", "flip")


@query("pair_names", "SELECT doc_id AS pair_id, CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE 'r' END || doc_id AS name1, 'r' || doc_id AS name2 FROM {documents} WHERE doc_id % 11 = 0")
def pair_names(spark, d):
    r1 = fixture(spark, d, "dna").selectExpr("doc_id pair_id", "concat(case when doc_id % 11 = 0 then 'x' else 'r' end, doc_id, '/1') name")
    r2 = fixture(spark, d, "dna").selectExpr("doc_id pair_id", "concat('r', doc_id, '/2') name")
    from strandwise.functions.sequence import trim_name

    ends = r1.select("pair_id", trim_name(F.col("name")).alias("name1")).join(r2.select("pair_id", trim_name(F.col("name")).alias("name2")), "pair_id")
    return ends.where("name1 <> name2")


@query(
    "sampe_pair",
    "WITH x AS (SELECT r.pair_id, f.k AS k1, r.k AS k2, r.mate AS m2, r.pos + r.len - f.pos AS \"insert\", (f.score + r.score) * 10 AS q, f.pos AS p1, r.pos AS p2, row_number() OVER (PARTITION BY r.pair_id, r.mate, r.k, r.pos, r.score ORDER BY f.pos DESC, f.k DESC, f.score DESC) AS nth FROM {hits} r JOIN {hits} f ON f.pair_id = r.pair_id AND f.mate <> r.mate AND f.rev = 0 AND r.rev = 1 AND (f.pos < r.pos OR (f.pos = r.pos AND f.k < r.k))) SELECT pair_id, k1, k2, m2, \"insert\", q FROM x WHERE nth <= 2 AND p2 > p1 AND \"insert\" BETWEEN 60 AND 5000",
)
def sampe_pair(spark, d):
    return P.forward_reverse_pairs(fixture(spark, d, "hits"), 60, 5000)


@query("flag_fr", "SELECT read_id, k, rb, qb, qe, score, CASE WHEN EXISTS (SELECT 1 FROM {regions} o WHERE o.read_id = r.read_id AND o.k % 2 = 1 AND o.qb % 20 = r.qb % 20 AND o.rid % 5 = r.rid % 5) THEN 196608 ELSE 65536 END AS flag FROM {regions} r WHERE k % 2 = 0")
def flag_fr(spark, d):
    x = fixture(spark, d, "regions").withColumns({"a": F.expr("qb % 20"), "b": F.expr("rid % 5")})
    back = x.where("k % 2 = 1").select("read_id", "a", "b").distinct().withColumn("hit", F.lit(True))
    fwd = x.where("k % 2 = 0").join(back, ["read_id", "a", "b"], "left")
    return fwd.select("read_id", "k", "rb", "qb", "qe", "score", F.when(F.col("hit"), F.lit(0x30000)).otherwise(F.lit(0x10000)).alias("flag"))


@query("merge_hits", "SELECT read_id, k, qb AS beg, qe AS \"end\", 0 AS rev FROM {regions} WHERE k % 2 = 0 UNION ALL SELECT read_id, k, 200 - qe, 200 - qb, 16 FROM {regions} WHERE k % 2 = 1")
def merge_hits(spark, d):
    x = fixture(spark, d, "regions")
    fwd = x.where("k % 2 = 0").select("read_id", "k", F.col("qb").alias("beg"), F.col("qe").alias("end"), F.lit(0).alias("rev"))
    return fwd.unionByName(x.where("k % 2 = 1").select("read_id", "k", (200 - F.col("qe")).alias("beg"), (200 - F.col("qb")).alias("end"), F.lit(16).alias("rev")))
