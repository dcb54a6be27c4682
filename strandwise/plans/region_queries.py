"""Region, lift-over and allele operators."""

from __future__ import annotations

from pyspark.sql import functions as F

import strandwise.plans.fixtures  # noqa: F401  (defines the derived tables)
from strandwise.operators import alleles as A
from strandwise.operators import lift as L
from strandwise.operators import regions as R
from strandwise.plans.registry import FIXTURES, fixture, query

_ORD = "PARTITION BY read_id ORDER BY score DESC, rb, qb, k"
# one region for each read and number, so that orders are total
FIXTURES["regs"] = "SELECT read_id, row_number() OVER (PARTITION BY read_id ORDER BY rb, qb, score, rid, re, k) AS k, rid, rb, re, qb, qe, score, is_alt FROM {regions}"


def regs(spark, d):
    return fixture(spark, d, "regs").withColumn("k", F.col("k").cast("bigint"))


@query("region_order", f"SELECT read_id, k, row_number() OVER ({_ORD}) AS nth FROM {{regs}}")
def region_order(spark, d):
    return R.ranked(regs(spark, d)).select("read_id", "k", "nth")


@query("limits", f"SELECT read_id, k FROM (SELECT *, row_number() OVER ({_ORD}) AS nth FROM {{regs}}) WHERE nth <= 3")
def limits(spark, d):
    return R.ranked(regs(spark, d)).where("nth <= 3").select("read_id", "k")


@query("dedup_regs", "SELECT read_id, score, rb, qb, min(re) AS re FROM {regs} GROUP BY read_id, score, rb, qb")
def dedup_regs(spark, d):
    return R.distinct_regions(regs(spark, d)).select("read_id", "score", "rb", "qb", "re")


@query("primary5", "SELECT read_id, k, row_number() OVER (PARTITION BY read_id ORDER BY qb, score DESC, rb, k) = 1 AS is_primary FROM {regs} WHERE score >= 30")
def primary5(spark, d):
    return R.leftmost_primary(regs(spark, d), 30).select("read_id", "k", "is_primary")


_REP = f"SELECT read_id, k, rid, rb, score, nth, CASE WHEN nth > 1 THEN 2048 ELSE 0 END AS flag, CASE WHEN nth > 1 THEN least(mapq, top) ELSE mapq END AS mapq FROM (SELECT *, row_number() OVER ({_ORD}) AS nth, first_value(mapq) OVER ({_ORD}) AS top FROM (SELECT *, (rb * 7 + qb) % 61 AS mapq FROM {{regs}} WHERE score >= 30 AND k % 3 <> 2))"


def _reported(spark, d):
    return R.reported(regs(spark, d).withColumns({"mapq": F.expr("(rb * 7 + qb) % 61"), "secondary": F.expr("k % 3 = 2")}), 30)


@query("reg2sam", f"SELECT read_id, k, nth, flag, mapq FROM ({_REP})")
def reg2sam(spark, d):
    return _reported(spark, d).select("read_id", "k", "nth", "flag", "mapq")


@query("sa_tag", f"WITH r AS ({_REP}) SELECT a.read_id, a.nth, string_agg('c' || b.rid || ',' || (b.rb + 1) || ',' || b.mapq, ';' ORDER BY b.nth) || ';' AS sa FROM r a JOIN r b ON a.read_id = b.read_id AND a.nth <> b.nth GROUP BY a.read_id, a.nth")
def sa_tag(spark, d):
    return R.other_primaries(_reported(spark, d))


@query("xa", f"WITH r AS (SELECT *, row_number() OVER ({_ORD}) AS nth, max(score) OVER (PARTITION BY read_id) AS best FROM {{regs}}) SELECT read_id, string_agg('c' || rid || ',' || CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END || (rb + 1) || ',' || score, ';' ORDER BY nth) || ';' AS xa FROM r WHERE nth > 1 AND score >= best * 0.8 GROUP BY read_id HAVING count(*) <= 5 OR (sum(is_alt) > 0 AND count(*) <= 200)")
def xa(spark, d):
    return R.alternatives(regs(spark, d))


@query("x0x1", "WITH h AS (SELECT read_id, score % 5 AS score, 1 + k % 3 AS occ, min(score % 5) OVER (PARTITION BY read_id) AS b FROM {regs}) SELECT read_id, CAST(sum(CASE WHEN score = b THEN occ ELSE 0 END) AS BIGINT) AS x0, CAST(sum(CASE WHEN score <> b THEN occ ELSE 0 END) AS BIGINT) AS x1, CASE WHEN sum(CASE WHEN score = b THEN occ ELSE 0 END) > 1 THEN 'R' ELSE 'U' END AS type FROM h GROUP BY read_id")
def x0x1(spark, d):
    return R.hit_counts(regs(spark, d).select("read_id", F.expr("score % 5 score"), F.expr("1 + k % 3 occ")))


@query("multi_except", "SELECT read_id, rb, rid FROM {regs} a WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM {regs} b WHERE b.read_id = a.read_id AND b.k = 1 AND b.rb = a.rb AND b.rid = a.rid)")
def multi_except(spark, d):
    x = regs(spark, d)
    return x.where("k > 1").select("read_id", "rb", "rid").join(x.where("k = 1").select("read_id", "rb", "rid"), ["read_id", "rb", "rid"], "left_anti")


@query(
    "chain",
    "WITH l AS (SELECT *, qbeg - lag(qbeg) OVER w AS x, rbeg - lag(rbeg) OVER w AS y, lag(len) OVER w AS l FROM {seeds} WINDOW w AS (PARTITION BY read_id ORDER BY rbeg, qbeg, len)), n AS (SELECT *, sum(CASE WHEN x >= 0 AND abs(x - y) <= 100 AND x - l < 10000 AND y - l < 10000 THEN 0 ELSE 1 END) OVER (PARTITION BY read_id ORDER BY rbeg, qbeg, len ROWS UNBOUNDED PRECEDING) AS chain FROM l) SELECT read_id, CAST(chain AS BIGINT) AS chain, count(*) AS n_seeds, min(qbeg) AS qb, max(qbeg + len) AS qe, min(rbeg) AS rb, max(rbeg + len) AS re FROM n GROUP BY read_id, chain",
)
def chain(spark, d):
    return R.diagonal_chains(fixture(spark, d, "seeds"), 100, 10_000)


_GRP = "SELECT *, sum(fresh) OVER (PARTITION BY read_id, rid ORDER BY rb, re ROWS UNBOUNDED PRECEDING) AS grp FROM (SELECT *, CASE WHEN rb >= coalesce(max(re) OVER (PARTITION BY read_id, rid ORDER BY rb, re ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), rb) THEN 1 ELSE 0 END AS fresh FROM (SELECT read_id, k, rid % 2 AS rid, rb % 300 AS rb, rb % 300 + re - rb AS re, score FROM {regs}))"


def _groups(spark, d):
    return R.lifted_groups(regs(spark, d).select("read_id", "k", F.expr("rid % 2 rid"), F.expr("rb % 300 rb"), F.expr("rb % 300 + re - rb re"), "score"))


@query("postalt_group", f"SELECT read_id, k, rid, rb, re, CAST(grp AS BIGINT) AS grp FROM ({_GRP})")
def postalt_group(spark, d):
    return _groups(spark, d).select("read_id", "k", "rid", "rb", "re", "grp")


@query("postalt_mapq", f"WITH b AS (SELECT read_id, rid, grp, max(score) AS top FROM ({_GRP}) GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY top DESC, rid, grp) AS n FROM b) SELECT read_id, CAST(coalesce(least(60, 6 * (max(top) FILTER (n = 1) - max(top) FILTER (n = 2))), 60) AS INT) AS mapq FROM t GROUP BY read_id")
def postalt_mapq(spark, d):
    return R.regrouped_mapq(_groups(spark, d))


@query("postalt", f"WITH m AS (WITH b AS (SELECT read_id, rid, grp, max(score) AS top FROM ({_GRP}) GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY top DESC, rid, grp) AS n FROM b) SELECT read_id, CAST(coalesce(least(60, 6 * (max(top) FILTER (n = 1) - max(top) FILTER (n = 2))), 60) AS INT) AS mapq FROM t GROUP BY read_id) SELECT read_id, k, CASE WHEN rb < 150 AND re > 100 THEN least((rb * 7 + qb) % 61, mapq) WHEN score < 40 THEN 0 ELSE (rb * 7 + qb) % 61 END AS mapq, NOT (rb < 150 AND re > 100) AND score < 40 AS zeroed FROM (SELECT read_id, k, rb % 300 AS rb, rb % 300 + re - rb AS re, qb, score FROM {{regs}}) JOIN m USING (read_id)")
def postalt(spark, d):
    x = regs(spark, d).select("read_id", "k", F.expr("rb % 300 rb"), F.expr("rb % 300 + re - rb re"), "qb", "score").join(R.regrouped_mapq(_groups(spark, d)), "read_id")
    own, over = F.expr("(rb * 7 + qb) % 61"), F.expr("rb < 150 and re > 100")
    low = F.col("score") < 40
    return x.select("read_id", "k", F.when(over, F.least(own, F.col("mapq").cast("bigint"))).when(low, F.lit(0)).otherwise(own).alias("mapq"), (~over & low).alias("zeroed"))


@query(
    "liftover",
    """WITH o AS (SELECT id, n, p, cigar, q * 3 AS pos, generate_subscripts(l, 1) AS i, unnest(l) AS c FROM (SELECT *, regexp_extract_all(cigar, '[0-9]+[MIDSHN]') AS l FROM {cigars})),
e AS (SELECT id, n, p, cigar, pos, i, right(c, 1) AS op, CAST(left(c, length(c) - 1) AS BIGINT) AS len FROM o),
s AS (SELECT *, coalesce(sum(CASE WHEN op IN ('M', 'D') THEN len ELSE 0 END) OVER w, 0) AS x, coalesce(sum(CASE WHEN op <> 'D' THEN len ELSE 0 END) OVER w, 0) AS y FROM (SELECT DISTINCT * FROM e) WINDOW w AS (PARTITION BY id, n, p, cigar, pos ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT id, n, p, cigar, pos, CASE WHEN op = 'M' THEN x + pos - y WHEN op = 'I' THEN x ELSE -1 END AS at FROM s WHERE op <> 'D' AND y <= pos AND pos < y + len)
SELECT id, n, p, cigar, c.q * 3 AS pos, CAST(coalesce(f.at, -1) AS BIGINT) AS lifted FROM {cigars} c LEFT JOIN f USING (id, n, p, cigar) WHERE f.pos IS NULL OR f.pos = c.q * 3""".replace("AS at FROM s", "AS spot FROM s").replace("f.at", "f.spot").replace("LEFT JOIN f USING (id, n, p, cigar) WHERE f.pos IS NULL OR f.pos = c.q * 3", "LEFT JOIN (SELECT id, n, p, cigar, pos, spot FROM f) f ON f.id = c.id AND f.n = c.n AND f.p = c.p AND f.cigar = c.cigar AND f.pos = c.q * 3").replace("SELECT id, n, p, cigar, c.q * 3", "SELECT c.id, c.n, c.p, c.cigar, c.q * 3"),
)
def liftover(spark, d):
    return fixture(spark, d, "cigars").select("id", "n", "p", "cigar", (F.col("q") * 3).alias("pos"), L.lifted(F.col("cigar"), F.col("q") * 3).alias("lifted"))


_SUM = "coalesce(CAST(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[{0}]', 1), lambda x: CAST(x AS BIGINT))) AS BIGINT), 0)"


@query(
    "parse_hit",
    f"SELECT id, n, p, hit, ctg, start, start + m + d AS \"end\", rev, nm, CAST(floor((m - 5 * (nm - i - d) - 6 * gaps - (i + d)) / 1.0::DOUBLE + .499) AS BIGINT) AS score, m + i + c AS l_query FROM (SELECT *, greatest(nm0, i + d) AS nm FROM (SELECT id, n, p, 'c' || (p % 25) || ',' || CASE WHEN s % 2 = 0 THEN '+' ELSE '-' END || (p * 10 + 1) || ',' || cigar || ',' || (q % 9) AS hit, 'c' || (p % 25) AS ctg, p * 10 AS start, s % 2 = 1 AS rev, q % 9 AS nm0, {_SUM.format('M')} AS m, {_SUM.format('I')} AS i, {_SUM.format('D')} AS d, {_SUM.format('SH')} AS c, len(regexp_extract_all(cigar, '[ID]')) AS gaps FROM {{cigars}}))",
)
def parse_hit(spark, d):
    x = fixture(spark, d, "cigars").selectExpr("id", "n", "p", "concat('c', p % 25, ',', case when s % 2 = 0 then '+' else '-' end, p * 10 + 1, ',', cigar, ',', q % 9) hit")
    return L.hit_fields(x)


# hits of contigs on exons: 3 genes of 8 exons
FIXTURES["exon_hits"] = "SELECT p % 200 AS contig, concat('g', CAST(p % 3 AS STRING)) AS gene, s % 8 AS exon, (p * 7 + s) % 150 AS ts, (p * 7 + s) % 150 + 20 + q AS te, (p + q) % 7 AS nm FROM {num}"


@query("hla_perfect", "SELECT gene, exon, CAST(sum(greatest(0, te - greatest(ts, coalesce(r, ts)))) AS BIGINT) AS covered FROM (SELECT *, max(te) OVER (PARTITION BY gene, exon ORDER BY ts, te ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {exon_hits} WHERE nm = 0) GROUP BY gene, exon")
def hla_perfect(spark, d):
    # equal intervals add nothing; without repeats a group is bounded by the exon
    return A.perfect_coverage(fixture(spark, d, "exon_hits").where("nm = 0").select("gene", "exon", "ts", "te", "nm").distinct())


@query("hla_pri_exon", "SELECT exon, count(DISTINCT gene) AS genes, count(DISTINCT gene) = max(count(DISTINCT gene)) OVER () AS is_primary FROM {exon_hits} WHERE exon > 1 OR gene <> 'g2' GROUP BY exon")
def hla_pri_exon(spark, d):
    return A.primary_exons(fixture(spark, d, "exon_hits").where("exon > 1 or gene <> 'g2'"))


@query("hla_flags", "SELECT contig, CAST(bit_or(CAST(1 << CAST(exon AS INT) AS INT)) AS INT) AS exons, max(te - ts) AS len, min(nm) AS nm, min(nm) > 5 OR (max(te - ts) < 50 AND max(te - ts) < 0.8 * max(max(te - ts)) OVER ()) AS dropped FROM {exon_hits} GROUP BY contig")
def hla_flags(spark, d):
    return A.contig_flags(fixture(spark, d, "exon_hits"))


_DIST = "SELECT contig, gene || '*' || (exon % 4) AS allele, min(nm) AS nm FROM {exon_hits} GROUP BY ALL"


def _distances(spark, d):
    x = fixture(spark, d, "exon_hits").withColumn("allele", F.expr("concat(gene, '*', exon % 4)"))
    return x.groupBy("contig", "allele").agg(F.min("nm").alias("nm"))


_SCORES = f"WITH x AS ({_DIST}) SELECT a.allele AS g1, b.allele AS g2, CAST(least(sum(least(a.nm, b.nm)), 255) AS BIGINT) AS total FROM x a JOIN x b ON a.contig = b.contig AND a.allele <= b.allele GROUP BY ALL"


@query("hla_pairs", _SCORES)
def hla_pairs(spark, d):
    return A.genotype_scores(_distances(spark, d))


@query("hla_gt", f"SELECT * FROM ({_SCORES}) QUALIFY total <= min(total) OVER () + 1")
def hla_gt(spark, d):
    return A.best_genotypes(A.genotype_scores(_distances(spark, d)))


@query(
    "hla_selctg",
    "WITH h AS (SELECT read_id AS qname, rid AS contig, rb % 3000 AS ts, rb % 3000 + 60 AS te, score, CASE WHEN k % 4 = 0 THEN score ELSE 0 END AS sub FROM {regs}), e AS (SELECT range AS contig, (range * 97) % 2500 AS es, (range * 97) % 2500 + 900 AS ee FROM range(0, 20)), o AS (SELECT h.*, greatest(0, coalesce(least(te, ee) - greatest(ts, es), 0)) AS ovlp, max(score) OVER (PARTITION BY qname) AS b FROM h JOIN e USING (contig)) SELECT qname FROM o WHERE score = b GROUP BY qname HAVING NOT bool_or(ovlp < 30 OR score = sub)",
)
def hla_selctg(spark, d):
    h = regs(spark, d).select(F.col("read_id").alias("qname"), F.col("rid").alias("contig"), F.expr("rb % 3000 ts"), F.expr("rb % 3000 + 60 te"), "score", F.expr("case when k % 4 = 0 then score else 0 end sub"), F.struct("read_id", "k").alias("hid"))
    e = spark.range(20).selectExpr("id contig", "(id * 97) % 2500 es", "(id * 97) % 2500 + 900 ee")
    return A.selected_contigs(h, e)


@query("hla_reads", "SELECT gene, count(*) AS n, count(DISTINCT contig) AS contigs FROM {exon_hits} WHERE nm <= 2 GROUP BY gene")
def hla_reads(spark, d):
    return fixture(spark, d, "exon_hits").where("nm <= 2").groupBy("gene").agg(F.count("*").alias("n"), F.countDistinct("contig").alias("contigs"))
