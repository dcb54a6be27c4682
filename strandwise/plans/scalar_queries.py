"""Projection-layer operators, each over a whole derived table."""

from __future__ import annotations


from pyspark.sql import functions as F

import strandwise.plans.fixtures  # noqa: F401  (defines the derived tables)
from strandwise.functions import sequence as S
from strandwise.plans.registry import fixture, query

c = F.col


def lng(x):
    return x.cast("bigint")


@query("nt4", "SELECT doc_id, translate(regexp_replace(text, '[^ACGTacgt]', 'N'<g>), 'ACGTacgtN', '012301234') AS codes FROM {documents}")
def nt4(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", S.nt4(c("text")).alias("codes"))


@query("revcomp", "SELECT doc_id, translate(reverse(seq), 'acgt', 'tgca') AS rc FROM {dna}")
def revcomp(spark, d):
    return fixture(spark, d, "dna").select("doc_id", S.revcomp(c("seq")).alias("rc"))


@query("depos", "SELECT id, n, p, CASE WHEN p * 50 >= l THEN 2 * l - 1 - p * 50 ELSE p * 50 END AS pos, p * 50 >= l AS is_rev FROM (SELECT *, 50000 AS l FROM {num}) WHERE p * 50 < 2 * l")
def depos(spark, d):
    pos, rev = S.depos(c("p") * 50, F.lit(50000))
    return fixture(spark, d, "num").where("p * 50 < 100000").select("id", "n", "p", lng(pos).alias("pos"), rev.alias("is_rev"))


@query(
    "get_seq",
    "SELECT doc_id, CASE WHEN b < e AND b >= l THEN reverse(translate(substring(seq, CAST(2 * l - e + 1 AS INT), CAST(e - b AS INT)), 'acgt', 'tgca')) WHEN b < e AND e <= l THEN substring(seq, CAST(b + 1 AS INT), CAST(e - b AS INT)) ELSE '' END AS bases "
    "FROM (SELECT doc_id, seq, length(seq) AS l, greatest(b0, 0) AS b, least(b0 + 40, 2 * length(seq)) AS e FROM (SELECT doc_id, seq, (doc_id * 7919) % (2 * length(seq)) - 3 AS b0 FROM {dna} WHERE length(seq) > 0))",
)
def get_seq(spark, d):
    x = fixture(spark, d, "dna").where("length(seq) > 0").withColumn("b0", F.expr("(doc_id * 7919) % (2 * length(seq)) - 3"))
    return x.select("doc_id", S.on_axis(c("seq"), c("b0"), c("b0") + 40).alias("bases"))


@query(
    "scmat",
    "SELECT x, y, CASE WHEN x IN ('N') OR y IN ('N') THEN -1 WHEN x = y THEN 1 ELSE -4 END AS score, count(*) AS pairs FROM (SELECT substring('ACGTN', CAST(p % 5 + 1 AS INT), 1) AS x, substring('ACGTN', CAST(s % 5 + 1 AS INT), 1) AS y FROM {num}) GROUP BY x, y",
)
def scmat(spark, d):
    x = fixture(spark, d, "num").selectExpr("substring('ACGTN', cast(p % 5 + 1 as int), 1) x", "substring('ACGTN', cast(s % 5 + 1 as int), 1) y")
    return x.select("x", "y", S.base_score(c("x"), c("y")).alias("score")).groupBy("x", "y", "score").agg(F.count("*").alias("pairs"))


_LEN = "CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[{ops}]', 1), lambda x: CAST(x AS BIGINT))), 0) AS BIGINT)"


@query("cigar_rlen", f"SELECT id, n, p, cigar, {_LEN.replace('{ops}', 'MD')} AS rlen, {_LEN.replace('{ops}', 'MIS')} AS qlen FROM {{cigars}}")
def cigar_rlen(spark, d):
    return fixture(spark, d, "cigars").select("id", "n", "p", "cigar", S.ref_length(c("cigar")).alias("rlen"), S.query_length(c("cigar")).alias("qlen"))


_MAPQ = """SELECT id, n, p, CASE WHEN second >= score OR score = 0 THEN 0 ELSE CAST(trunc(least(greatest(
 CAST(trunc(6.02 * (score - second) * pow(CASE WHEN span < 50 THEN 1.0 ELSE ln(50.0) / ln(span) END * pow(1.0 - CAST(span - score AS DOUBLE) / 5 / span, 2), 2) + .499) AS INT)
 - CASE WHEN sub_n > 0 THEN CAST(trunc(4.343 * ln(sub_n + 1.0::DOUBLE) + .499) AS INT) ELSE 0 END, 0), 60) * (1.0 - rep) + .499) AS INT) END AS mapq
FROM (SELECT *, greatest(CASE WHEN sub > 0 THEN sub ELSE 19 END, csub) AS second FROM (SELECT id, n, p, 30 + p % 70 AS score, s % 60 AS sub, q AS csub, 40 + p % 90 AS span, n % 4 AS sub_n, CAST(n % 5 AS DOUBLE) / 10 AS rep FROM {num}))"""
_MAPQ = _MAPQ.replace("pow(CASE WHEN span < 50 THEN 1.0 ELSE ln(50.0) / ln(span) END * pow(1.0 - CAST(span - score AS DOUBLE) / 5 / span, 2), 2)", "(w * w)").replace(
    "FROM (SELECT *, greatest(", "FROM (SELECT *, CASE WHEN span < 50 THEN 1.0::DOUBLE ELSE ln(50.0::DOUBLE) / ln(span::DOUBLE) END * (1.0 - CAST(span - score AS DOUBLE) / 5 / span) * (1.0 - CAST(span - score AS DOUBLE) / 5 / span) AS w, greatest("
)


@query("mapq_se", _MAPQ)
def mapq_se(spark, d):
    x = fixture(spark, d, "num").selectExpr("id", "n", "p", "30 + p % 70 score", "s % 60 sub", "q csub", "40 + p % 90 span", "n % 4 sub_n", "cast(n % 5 as double) / 10 rep")
    return x.select("id", "n", "p", S.approx_mapq(c("score"), c("sub"), c("csub"), c("span"), c("sub_n"), c("rep")).alias("mapq"))


@query(
    "mapq_pe",
    """SELECT id, n, p, q_pe, least(greatest(se, least(q_pe, se + 40)), CAST(trunc(6.02 * (sc - q) + .499) AS INT)) AS mapq FROM (
SELECT *, CAST(trunc(least(greatest(CAST(trunc(6.02 * (o - greatest(subo, un)) + .499) AS INT) - CASE WHEN n > 0 THEN CAST(trunc(4.343 * ln(n + 1.0::DOUBLE) + .499) AS INT) ELSE 0 END, 0), 60) * (1.0 - 0.5 * (r0 + r1)) + .499) AS INT) AS q_pe
FROM (SELECT id, n, p, q, 100 + p % 60 AS o, 80 + s % 70 AS subo, 90 + q AS un, CAST(n % 3 AS DOUBLE) / 8 AS r0, CAST(p % 4 AS DOUBLE) / 8 AS r1, CAST(p % 61 AS INT) AS se, 50 + p % 50 AS sc FROM {num}))""",
)
def mapq_pe(spark, d):
    x = fixture(spark, d, "num").selectExpr("id", "n", "p", "q", "100 + p % 60 o", "80 + s % 70 subo", "90 + q un", "cast(n % 3 as double) / 8 r0", "cast(p % 4 as double) / 8 r1", "cast(p % 61 as int) se", "50 + p % 50 sc")
    x = x.withColumn("q_pe", S.pair_mapq(c("o"), c("subo"), c("un"), c("n"), c("r0"), c("r1")))
    return x.select("id", "n", "p", "q_pe", S.joint_mapq(c("se"), c("q_pe"), c("sc"), c("q")).alias("mapq"))


@query(
    "bandwidth",
    "SELECT id, n, p, least(greatest(CAST(trunc(CAST(p - 6 AS DOUBLE) / 1 + 1.0) AS INT), 1), 200) AS gap, CASE WHEN p % 100 = s % 100 AND p % 100 - q < 12 THEN 0 ELSE greatest(CAST(trunc(CAST(least(p % 100, s % 100) - q - 6 AS DOUBLE) + 2.0) AS INT), CAST(abs(p % 100 - s % 100) AS INT)) END AS w FROM {num}",
)
def bandwidth(spark, d):
    return fixture(spark, d, "num").select("id", "n", "p", S.max_gap(c("p")).alias("gap"), S.band(c("p") % 100, c("s") % 100, c("q")).alias("w"))


@query(
    "sam_flag",
    "SELECT id, n, p, CASE WHEN p % 2 = 0 THEN 1 ELSE 0 END | CASE WHEN p % 3 = 0 THEN 2 ELSE 0 END | CASE WHEN p % 5 = 0 THEN 4 ELSE 0 END | CASE WHEN p % 7 = 0 THEN 8 ELSE 0 END | CASE WHEN s % 2 = 0 THEN 16 ELSE 0 END | CASE WHEN s % 3 = 0 THEN 32 ELSE 0 END | CASE WHEN p % 2 = 0 THEN CASE WHEN q % 2 = 0 THEN 128 ELSE 64 END ELSE 0 END | CASE WHEN q % 3 = 0 THEN 256 ELSE 0 END | CASE WHEN n % 3 = 0 THEN 2048 ELSE 0 END AS flag FROM {num}",
)
def sam_flag(spark, d):
    on = lambda e: F.expr(f"{e} = 0")
    return fixture(spark, d, "num").select("id", "n", "p", S.sam_flag(on("p % 2"), on("p % 5"), on("p % 7"), on("s % 2"), on("s % 3"), on("p % 3"), on("q % 2"), on("q % 3"), on("n % 3")).alias("flag"))


@query(
    "tlen",
    "SELECT id, n, p, CASE WHEN r = 0 OR m = 0 THEN 0 ELSE -(p0 - p1 + CASE WHEN p0 > p1 THEN 1 WHEN p0 < p1 THEN -1 ELSE 0 END) END AS tlen FROM (SELECT id, n, p, q % 7 AS r, 1 + s % 50 AS m, p + CASE WHEN n % 2 = 0 THEN q % 7 - 1 ELSE 0 END AS p0, p + s % 9 + CASE WHEN n % 3 = 0 THEN s % 50 ELSE 0 END AS p1 FROM {num})",
)
def tlen(spark, d):
    return fixture(spark, d, "num").select("id", "n", "p", S.template_length(c("p"), F.expr("n % 2 = 0"), F.expr("q % 7"), F.expr("p + s % 9"), F.expr("n % 3 = 0"), F.expr("1 + s % 50")).alias("tlen"))


@query("trim_name", "SELECT ordinal, regexp_replace(name, '^(.+)/[0-9]$', '\\1') AS name FROM {fastq}")
def trim_name(spark, d):
    return fixture(spark, d, "fastq").select("ordinal", S.trim_name(c("name")).alias("name"))


@query(
    "qual_trim",
    """WITH b AS (SELECT ordinal, length(qual) AS n, l, sum(20 - (ascii(qual[l + 1]) - 33)) OVER (PARTITION BY ordinal ORDER BY l DESC) AS s FROM (SELECT ordinal, qual, unnest(range(35, length(qual))) AS l FROM {fastq})),
live AS (SELECT *, max(CASE WHEN s < 0 THEN l ELSE -1 END) OVER (PARTITION BY ordinal) AS stop FROM b),
top AS (SELECT ordinal, max(s) AS m FROM live WHERE l > stop AND s > 0 GROUP BY ordinal),
cut AS (SELECT ordinal, max(l) AS l FROM live JOIN top USING (ordinal) WHERE l > stop AND s = m GROUP BY ordinal)
SELECT ordinal, CAST(coalesce(l, length(qual)) AS INT) AS clip_len FROM {fastq} LEFT JOIN cut USING (ordinal)""",
)
def qual_trim(spark, d):
    return fixture(spark, d, "fastq").select("ordinal", S.clip_point(c("qual"), 20).alias("clip_len"))


@query(
    "barcode",
    "SELECT ordinal, array_to_string([CASE WHEN ascii(qual[i]) - 33 < 13 THEN lower(seq[i]) ELSE upper(seq[i]) END FOR i IN range(1, 7)], '') AS bc, substring(seq, 7) AS rest FROM {fastq} WHERE length(seq) > 6",
)
def barcode(spark, d):
    return fixture(spark, d, "fastq").where("length(seq) > 6").select("ordinal", S.barcode(c("seq"), c("qual"), 6).alias("bc"), F.expr("substring(seq, 7)").alias("rest"))


@query("il13", "SELECT ordinal, array_to_string([chr(ascii(translate(qual, '&#+(5BHI', 'efghijkl')[i]) - 31) FOR i IN range(1, length(qual) + 1)], '') AS qual FROM {fastq} WHERE length(qual) > 0")
def il13(spark, d):
    old = F.translate("qual", "&#+(5BHI", "efghijkl")
    return fixture(spark, d, "fastq").where("length(qual) > 0").select("ordinal", S.from_phred64(old).alias("qual"))


@query("casava", "SELECT ordinal, name FROM {fastq} WHERE NOT regexp_matches(comment, '^[^:]*:Y')")
def casava(spark, d):
    return fixture(spark, d, "fastq").where(~S.failed_casava(c("comment"))).select("ordinal", "name")


@query(
    "maxdiff",
    """WITH RECURSIVE l AS (SELECT DISTINCT 20 + p % 100 AS n FROM {num}),
t(n, k, term, fact, total) AS (SELECT n, 0, 1.0::DOUBLE, 1::HUGEINT, exp(-n * 0.02::DOUBLE) FROM l
 UNION ALL SELECT n, k + 1, term * (n * 0.02::DOUBLE), fact * (k + 1), total + exp(-n * 0.02::DOUBLE) * (term * (n * 0.02::DOUBLE)) / (fact * (k + 1))::DOUBLE FROM t WHERE k < 12 AND (k = 0 OR 1.0 - total >= 0.04))
SELECT n AS len, CAST(max(k) AS INT) AS max_diff FROM t GROUP BY n""",
)
def maxdiff(spark, d):
    lengths = fixture(spark, d, "num").selectExpr("20 + p % 100 len").distinct()
    table = spark.createDataFrame([(n, S.max_differences(n)) for n in range(1, 1001)], "len bigint, max_diff int")  # fixed at 1000 rows
    return lengths.join(F.broadcast(table), "len")


@query("mapq_aln", "SELECT id, n, p, CASE WHEN c1 = 0 THEN 23 WHEN c1 > 1 THEN 0 WHEN mm = 3 THEN 25 WHEN c2 = 0 THEN 37 ELSE greatest(23 - CAST(trunc(4.343 * ln(least(c2, 255)::DOUBLE) + 0.5) AS INT), 0) END AS mapq FROM (SELECT id, n, p, p % 3 AS c1, s % 400 AS c2, n % 4 AS mm FROM {num})")
def mapq_aln(spark, d):
    return fixture(spark, d, "num").select("id", "n", "p", S.aln_mapq(F.expr("p % 3"), F.expr("s % 400"), F.expr("n % 4"), F.lit(3)).alias("mapq"))


@query(
    "mapq_sw",
    "SELECT id, n, p, CASE WHEN p % 11 = 0 THEN 0 ELSE least(greatest(CAST(trunc(CASE WHEN s % 2 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN n < 2 THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END * (g - greatest(g2, 30)) * (250.0::DOUBLE / g + 0.03::DOUBLE / 1) + .499::DOUBLE) AS INT), 0), 250) END AS mapq FROM (SELECT id, n, p, s, 30 + p % 300 AS g, q * 3 AS g2 FROM {num})",
)
def mapq_sw(spark, d):
    return fixture(spark, d, "num").select("id", "n", "p", S.longread_mapq(F.expr("30 + p % 300"), F.expr("q * 3"), F.expr("s % 2 = 0"), c("n"), F.expr("p % 11 = 0")).alias("mapq"))


@query(
    "sw_thres",
    "SELECT id, n, p, t, least(greatest(least(CAST(trunc(CAST(len - 10 AS DOUBLE) / 5) AS INT), CAST(trunc(CAST(len - 1 - t AS DOUBLE) / 2) AS INT)), 1), 50) AS bw FROM (SELECT id, n, p, 20 + p AS len, CASE WHEN 30 < ln((20 + p)::DOUBLE) * 5.5::DOUBLE THEN CAST(trunc(ln((20 + p)::DOUBLE) * 5.5::DOUBLE + .499) AS INT) ELSE 30 END AS t FROM {num})",
)
def sw_thres(spark, d):
    x = fixture(spark, d, "num").select("id", "n", "p", S.longread_threshold(20 + c("p")).alias("t"))
    return x.select("id", "n", "p", "t", S.longread_band(20 + c("p"), c("t")).alias("bw"))


@query(
    "sa2pos",
    "SELECT id, n, p, CASE WHEN b < l AND l < b + r THEN -1 WHEN b < l THEN b WHEN 2 * l - 1 - b + 1 < r THEN 0 ELSE 2 * l - 1 - b - r + 1 END AS pos, NOT (b < l AND l < b + r) AND b < l AS forward FROM (SELECT id, n, p, p * 13 AS b, 15000 AS l, 30 + q AS r FROM {num}) WHERE b < 2 * l",
)
def sa2pos(spark, d):
    pos, fwd = S.sa_position(c("p") * 13, 30 + c("q"), F.lit(15000))
    return fixture(spark, d, "num").where("p * 13 < 30000").select("id", "n", "p", lng(pos).alias("pos"), fwd.alias("forward"))


@query("pos5", f"SELECT id, n, p, CASE WHEN p % 4 = 0 THEN NULL ELSE cigar END AS cigar, CASE WHEN s % 2 = 0 THEN p ELSE p + CASE WHEN p % 4 = 0 THEN 100 ELSE {_LEN.replace('{ops}', 'MD')} END END AS pos5 FROM {{cigars}}")
def pos5(spark, d):
    x = fixture(spark, d, "cigars").withColumn("cigar", F.expr("case when p % 4 = 0 then null else cigar end"))
    return x.select("id", "n", "p", "cigar", S.five_prime(c("p"), c("cigar"), F.lit(100), F.expr("s % 2 = 0")).alias("pos5"))


@query(
    "orient",
    "SELECT pair_id, xor(CASE WHEN same THEN 0 ELSE 1 END, CASE WHEN p2 > b1 THEN 0 ELSE 3 END) AS orient, abs(p2 - b1) AS dist FROM (SELECT *, CASE WHEN same THEN b2 ELSE 2 * l_pac - 1 - b2 END AS p2 FROM (SELECT *, (b1 >= l_pac) = (b2 >= l_pac) AS same FROM {ends}))",
)
def orient(spark, d):
    way, dist = S.orientation(c("b1"), c("b2"), c("l_pac"))
    return fixture(spark, d, "ends").select("pair_id", way.alias("orient"), lng(dist).alias("dist"))


_M = "18446744073709551616::HUGEINT"


def _hash_sql() -> str:
    """The mix in 128-bit arithmetic; shifts are products and quotients by powers of two."""
    x = "id::HUGEINT"
    steps = [
        f"(({{x}}) + (18446744073709551615::HUGEINT - (({{x}}) * 4294967296) % {_M})) % {_M}",
        "xor({x}, ({x}) // 4194304)",
        f"(({{x}}) + (18446744073709551615::HUGEINT - (({{x}}) * 8192) % {_M})) % {_M}",
        "xor({x}, ({x}) // 256)",
        f"(({{x}}) + (({{x}}) * 8) % {_M}) % {_M}",
        "xor({x}, ({x}) // 32768)",
        f"(({{x}}) + (18446744073709551615::HUGEINT - (({{x}}) * 134217728) % {_M})) % {_M}",
        "xor({x}, ({x}) // 2147483648)",
    ]
    sql = f"SELECT DISTINCT id, {x} AS h0 FROM {{num}}"
    for i, step in enumerate(steps):
        sql = f"SELECT id, {step.format(x=f'h{i}')} AS h{i + 1} FROM ({sql})"
    return f"SELECT id, CAST(h{len(steps)} AS VARCHAR) AS hash FROM ({sql})"


@query("hash64", _hash_sql())
def hash64(spark, d):
    from strandwise.operators.kernels import hash64 as mix

    return fixture(spark, d, "num").select("id").distinct().select("id", mix(c("id")).alias("hash"))


