"""Index, seeding and interval operators over the sequences of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

import strandwise.plans.fixtures  # noqa: F401  (defines the derived tables)
from strandwise.operators import index, intervals, seeds, stored, windows
from strandwise.plans.registry import FIXTURES, fixture, query, table_state
from strandwise.plans.scratch import scratch_folder, written

K = 19

FIXTURES["contigs"] = "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS rid, doc_id, seq, CAST(length(seq) AS BIGINT) AS len, CAST(coalesce(sum(length(seq)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ FROM {dna}"
FIXTURES["dna_n"] = "SELECT doc_id, concat(substring(seq, 1, CAST(floor(length(seq) / 2.0) AS INT)), repeat('n', CAST(doc_id % 7 AS INT)), repeat('r', CAST(doc_id % 3 AS INT)), substring(seq, CAST(floor(length(seq) / 2.0) AS INT) + 1)) AS seq FROM {dna}"


def tables(spark, d, reads="reads"):
    """Contigs with sequence and their k-mers, from the session's stored index, and reads."""
    held = session_index(spark, d)
    return held.seqs, held.kmers, fixture(spark, d, reads)


def exact_reads(spark, d, reads, reach=0):
    """Whole-read matches of ``reads(read_id, seq)`` in all documents, whose sequences are scanned where they lie."""
    dna = fixture(spark, d, "dna")
    return windows.exact_places(reads.select("read_id", "seq"), dna, index.axis(dna), "doc_id", K, reach)


def matches(spark, d, reads="reads"):
    """Maximal matches of the reads, written once for the operators that read them several times."""
    _, kmers, rows = tables(spark, d, reads)
    return written(spark, seeds.maximal_matches(rows, kmers, K), "matches")


def session_index(spark, d):
    """The index of all documents below ``d``: built once a session, and again if the table was written since."""
    state = table_state(spark, f"{d}/documents.parquet")
    key = spark.sparkContext.applicationId, d
    if key not in _BUILT or _BUILT[key][0] != state:
        folder = scratch_folder(spark, "index")
        stored.build_index(spark, fixture(spark, d, "dna"), folder, K)
        _BUILT[key] = state, folder
    return stored.load_index(spark, _BUILT[key][1])


_BUILT: dict = {}


#: The k-mer join and its diagonals, in DuckDB.
_KM = f"""km AS MATERIALIZED (SELECT rid, strand, seq[p:p + {K - 1}] AS kmer, p - 1 AS pos, st + p - 1 AS gpos FROM (
 SELECT rid, strand, seq, st, unnest(range(1, length(seq) - {K} + 2)) AS p FROM (
  SELECT rid, 0 AS strand, seq, offset_ AS st FROM {{contigs}} UNION ALL
  SELECT rid, 1, translate(reverse(seq), 'acgt', 'tgca'), 2 * (SELECT sum(length(seq)) FROM {{dna}}) - offset_ - len FROM {{contigs}})))"""
_MEM = f"""qk AS (SELECT read_id, p - 1 AS qpos, seq[p:p + {K - 1}] AS kmer FROM (SELECT read_id, seq, unnest(range(1, length(seq) - {K} + 2)) AS p FROM {{reads}})),
{_KM},
hit AS (SELECT read_id, rid, strand, qpos, gpos - qpos AS diag FROM qk JOIN km USING (kmer)),
mem AS (SELECT read_id, rid, strand, min(qpos) AS qb, max(qpos) + {K} AS qe, diag + min(qpos) AS gpos FROM (
 SELECT *, qpos - row_number() OVER (PARTITION BY read_id, rid, strand, diag ORDER BY qpos) AS isl FROM hit) GROUP BY read_id, rid, strand, diag, isl),
span AS (SELECT read_id, qb, qe, count(*) AS n_occ FROM mem GROUP BY ALL),
smem AS (SELECT * FROM span a WHERE NOT EXISTS (SELECT 1 FROM span b WHERE b.read_id = a.read_id AND b.qb <= a.qb AND b.qe >= a.qe AND (b.qb < a.qb OR b.qe > a.qe)))"""


@query("idx_contigs", "SELECT rid, doc_id AS name, offset_ AS \"offset\", len, CASE WHEN doc_id % 7 > 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 > 0 THEN 1 ELSE 0 END AS n_ambs FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS rid, doc_id, CAST(length(seq) AS BIGINT) AS len, CAST(coalesce(sum(length(seq)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ FROM {dna_n})")
def idx_contigs(spark, d):
    return index.contigs(fixture(spark, d, "dna_n"))


@query("idx_holes", "SELECT doc_id, CAST(floor(length(seq) / 2.0) AS BIGINT) AS start, doc_id % 7 AS len, 'n' AS amb FROM {dna} WHERE doc_id % 7 > 0 UNION ALL SELECT doc_id, CAST(floor(length(seq) / 2.0) AS BIGINT) + doc_id % 7, doc_id % 3, 'r' FROM {dna} WHERE doc_id % 3 > 0")
def idx_holes(spark, d):
    return index.holes(fixture(spark, d, "dna_n"))


@query("idx_kmers", f"WITH {_KM} SELECT strand, kmer, count(*) AS n, CAST(min(gpos) AS BIGINT) AS first_gpos FROM km GROUP BY strand, kmer")
def idx_kmers(spark, d):
    _, kmers, _ = tables(spark, d)
    return index.both_strands(kmers, K).groupBy("strand", "kmer").agg(F.count("*").alias("n"), F.min("gpos").alias("first_gpos"))


@query("index_build", f"SELECT {K} AS k, count(*) AS contigs, CAST(sum(length(seq)) AS BIGINT) AS l_pac, CAST(sum(greatest(length(seq) - {K - 1}, 0)) AS BIGINT) AS kmers FROM {{dna}}")
def index_build(spark, d):
    """A stored index of all documents, built anew and read back; the session's searches use it from here on."""
    _BUILT.pop((spark.sparkContext.applicationId, d), None)
    held = session_index(spark, d)
    return held.seqs.agg(F.lit(held.k).alias("k"), F.count("*").alias("contigs"), F.sum("len").alias("l_pac")).crossJoin(held.kmers.agg(F.count("*").alias("kmers")))  # one row each


@query("index_load", f"WITH {_KM}, n AS (SELECT rid, count(*) AS n_kmers, min(kmer) AS first_kmer FROM km WHERE strand = 0 GROUP BY rid) SELECT rid, doc_id AS name, offset_ AS \"offset\", len, coalesce(n_kmers, 0) AS n_kmers, first_kmer FROM {{contigs}} LEFT JOIN n USING (rid)")
def index_load(spark, d):
    """What the stored index holds for each contig."""
    held = session_index(spark, d)
    counts = held.kmers.groupBy("rid").agg(F.count("*").alias("n_kmers"), F.min("kmer").alias("least"))
    out = held.seqs.join(counts, "rid", "left")
    return out.select("rid", F.col("doc_id").alias("name"), "offset", "len", F.coalesce("n_kmers", F.lit(0)).alias("n_kmers"), index.unpacked(F.col("least"), K).alias("first_kmer"))


_ITEM = "SELECT item_id AS doc_id, seq FROM (SELECT item_id, translate(regexp_replace(lower(text), '[^a-z]', ''<g>), 'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgtacgtacgtac') AS seq FROM {benchmark}) AS x"
FIXTURES["items"] = _ITEM


@query("idx_sa", "SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY seq[pos + 1:]) AS rank FROM (SELECT doc_id, seq, unnest(range(0, length(seq))) AS pos FROM {items})")
def idx_sa(spark, d):
    return index.suffix_ranks(spark, fixture(spark, d, "items"))


@query("exact_match", f"WITH {_KM} SELECT read_id, rid, strand, CASE WHEN strand = 0 THEN pos ELSE len - pos - length(r.seq) END AS pos, CAST(gpos AS BIGINT) AS gpos FROM {{reads}} r JOIN km ON r.seq[1:{K}] = kmer JOIN {{contigs}} c USING (rid) WHERE pos + length(r.seq) <= len AND CASE WHEN strand = 0 THEN c.seq[pos + 1:pos + length(r.seq)] = r.seq ELSE translate(reverse(c.seq), 'acgt', 'tgca')[pos + 1:pos + length(r.seq)] = r.seq END")
def exact_match(spark, d):
    return exact_reads(spark, d, fixture(spark, d, "reads")).select("read_id", "rid", "strand", "pos", "gpos")


@query("smem", f"WITH {_MEM} SELECT read_id, qb, qe, n_occ FROM smem")
def smem(spark, d):
    _, kmers, reads = tables(spark, d)
    return seeds.super_maximal(seeds.maximal_matches(reads, kmers, K))


@query("fastmap", f"WITH {_MEM} SELECT read_id, qb, qe, n_occ, string_agg(rid || ':' || strand || ':' || CAST(gpos AS BIGINT), ' ' ORDER BY gpos) AS places FROM smem JOIN mem USING (read_id, qb, qe) WHERE n_occ <= 20 GROUP BY ALL UNION ALL SELECT read_id, qb, qe, n_occ, '*' FROM smem WHERE n_occ > 20")
def fastmap(spark, d):
    mems = matches(spark, d)
    spans = seeds.super_maximal(mems)
    named = F.struct("gpos", F.concat_ws(":", "rid", "strand", "gpos").alias("text"))
    few = mems.join(spans.where("n_occ <= 20"), ["read_id", "qb", "qe"]).groupBy("read_id", "qb", "qe", "n_occ").agg(F.array_sort(F.collect_list(named)).alias("at"))
    listed = few.select("read_id", "qb", "qe", "n_occ", F.concat_ws(" ", F.transform("at", lambda x: x["text"])).alias("places"))
    return listed.unionByName(spans.where("n_occ > 20").withColumn("places", F.lit("*")))


@query("maxk", f"WITH {_MEM}, cov AS (SELECT read_id, i, least(max(qe - qb), 255) AS len FROM (SELECT *, unnest(range(qb, qe)) AS i FROM smem) GROUP BY read_id, i), h AS (SELECT len, count(*) AS n FROM cov GROUP BY len UNION ALL SELECT 0, (SELECT sum(length(seq)) FROM {{reads}}) - (SELECT count(*) FROM cov)) SELECT l.len, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM (SELECT unnest(range(0, 256)) AS len) l LEFT JOIN h USING (len) GROUP BY l.len")
def maxk(spark, d):
    _, kmers, reads = tables(spark, d)
    return seeds.longest_cover(seeds.super_maximal(seeds.maximal_matches(reads, kmers, K)), reads)


_RESEED = f"""WITH {_MEM}, mids AS (SELECT DISTINCT read_id, (qb + qe) // 2 AS mid, n_occ + 1 AS min_occ FROM smem WHERE qe - qb >= 28 AND n_occ <= 10),
ov AS (SELECT mids.*, b.qb AS b, b.qe AS e FROM mids JOIN mem b ON b.read_id = mids.read_id AND b.qb <= mid AND mid < b.qe),
pr AS (SELECT DISTINCT x.read_id, x.mid, x.min_occ, x.b AS qb, y.e AS qe FROM ov x JOIN ov y USING (read_id, mid, min_occ)),
ct AS (SELECT p.*, count(*) AS n_occ FROM pr p JOIN ov USING (read_id, mid, min_occ) WHERE b <= qb AND qe <= e GROUP BY ALL HAVING count(*) >= min_occ)
SELECT * FROM ct a WHERE NOT EXISTS (SELECT 1 FROM ct b WHERE b.read_id = a.read_id AND b.mid = a.mid AND b.min_occ = a.min_occ AND b.qb <= a.qb AND b.qe >= a.qe AND (b.qb < a.qb OR b.qe > a.qe))"""


@query("reseed", _RESEED)
def reseed(spark, d):
    mems = matches(spark, d)
    at = seeds.super_maximal(mems).where("qe - qb >= 28 and n_occ <= 10").select("read_id", F.expr("(qb + qe) div 2 mid"), F.expr("n_occ + 1 min_occ")).distinct()
    return seeds.at_least_occurring(mems, at)


@query("seed_hits", f"WITH {_MEM}, o AS (SELECT *, row_number() OVER (PARTITION BY read_id, qb, qe ORDER BY gpos) - 1 AS nth, CASE WHEN n_occ > 3 THEN n_occ // 3 ELSE 1 END AS step FROM mem JOIN smem USING (read_id, qb, qe)) SELECT read_id, qb, qe, n_occ, rid, strand, CAST(gpos AS BIGINT) AS gpos FROM o WHERE nth % step = 0 AND nth // step < 3")
def seed_hits(spark, d):
    mems = matches(spark, d)
    return seeds.occurrences(mems, seeds.super_maximal(mems), 3).select("read_id", "qb", "qe", "n_occ", "rid", "strand", "gpos")


@query("seeds_union", f"WITH {_MEM} SELECT pass, read_id, qb, qe, n_occ FROM (SELECT 1 AS pass, read_id, qb, qe, n_occ FROM smem UNION ALL SELECT 2, read_id, qb, qe, n_occ FROM ({_RESEED.replace('WITH ' + _MEM + ', ', 'WITH ')})) WHERE qe - qb >= {K}")
def seeds_union(spark, d):
    mems = matches(spark, d)
    first = seeds.super_maximal(mems)
    at = first.where("qe - qb >= 28 and n_occ <= 10").select("read_id", F.expr("(qb + qe) div 2 mid"), F.expr("n_occ + 1 min_occ")).distinct()
    second = seeds.at_least_occurring(mems, at).select("read_id", "qb", "qe", "n_occ")
    return first.withColumn("pass", F.lit(1)).unionByName(second.withColumn("pass", F.lit(2))).where(f"qe - qb >= {K}")


@query("pos2rid", "SELECT id, n, p, s, rid, pos - offset_ AS at FROM (SELECT id, n, p, s, (p * 7919 + s * 104729) % (SELECT CAST(sum(length(seq)) AS BIGINT) FROM {dna}) AS pos FROM {num}) JOIN {contigs} ON pos >= offset_ AND pos < offset_ + len")
def pos2rid(spark, d):
    seqs = index.sequences(fixture(spark, d, "dna")).select("rid", "offset", "len", "l_pac")
    total = seqs.first()["l_pac"]
    points = fixture(spark, d, "num").select("id", "n", "p", "s", F.expr(f"(p * 7919 + s * 104729) % {total} pos"))
    spans = seqs.withColumn("end", F.col("offset") + F.col("len"))
    return intervals.positions_in(points, "pos", spans, "offset", "end").select("id", "n", "p", "s", "rid", (F.col("pos") - F.col("offset")).alias("at"))


@query("cnt_ambi", "SELECT id, n, p, s, CAST(sum(least(a + 300, h.start + h.len) - greatest(a, h.start)) AS BIGINT) AS n_ambi FROM (SELECT id, n, p, s, p % 500 AS doc_id, s * 5 AS a FROM {num}) w JOIN (SELECT doc_id, CAST(floor(length(seq) / 2.0) AS BIGINT) AS start, doc_id % 7 AS len FROM {dna} WHERE doc_id % 7 > 0 UNION ALL SELECT doc_id, CAST(floor(length(seq) / 2.0) AS BIGINT) + doc_id % 7, doc_id % 3 FROM {dna} WHERE doc_id % 3 > 0) h ON w.doc_id = h.doc_id AND a < h.start + h.len AND h.start < a + 300 GROUP BY ALL")
def cnt_ambi(spark, d):
    holes = index.holes(fixture(spark, d, "dna_n")).withColumn("end", F.col("start") + F.col("len"))
    windows = fixture(spark, d, "num").select("id", "n", "p", "s", F.expr("p % 500 doc_id"), F.expr("s * 5 a"), F.expr("s * 5 + 300 b"))
    hit = intervals.interval_join(windows, holes, ["doc_id"], "a", "b", "start", "end")
    return hit.groupBy("id", "n", "p", "s").agg(F.sum(F.least("b", "end") - F.greatest("a", "start")).alias("n_ambi"))


@query("intv_ovlp", "SELECT a.read_id, a.k, b.c AS other, CAST(least(a.re, b.e) - greatest(a.rb, b.st) AS BIGINT) AS overlap FROM {regions} a JOIN (SELECT o_orderkey AS c, o_custkey % 25 AS rid, (o_orderkey * 31) % 20000 AS st, (o_orderkey * 31) % 20000 + 1 + o_custkey % 40 AS e FROM {orders}) b ON a.rid = b.rid AND a.rb < b.e AND b.st < a.re WHERE a.score >= 90")
def intv_ovlp(spark, d):
    return _overlaps(fixture(spark, d, "regions").where("score >= 90"), spark.read.parquet(f"{d}/orders.parquet"))


def _overlaps(a, orders):
    b = orders.selectExpr("o_orderkey other", "cast(o_custkey % 25 as bigint) rid", "(o_orderkey * 31) % 20000 st", "(o_orderkey * 31) % 20000 + 1 + o_custkey % 40 e")
    hit = intervals.interval_join(a, b, ["rid"], "rb", "re", "st", "e", bits=8)
    return hit.select("read_id", "k", "other", (F.least("re", "e") - F.greatest("rb", "st")).alias("overlap"))


@query("intv_ovlp_all")
def intv_ovlp_all(spark, d):
    """As ``intv_ovlp`` over regions of every score."""
    return _overlaps(fixture(spark, d, "regions"), spark.read.parquet(f"{d}/orders.parquet"))


@query("frac_rep", "WITH o AS (SELECT *, max(qbeg + len) OVER (PARTITION BY read_id ORDER BY qbeg, qbeg + len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {seeds} WHERE n_occ > 500) SELECT read_id, CAST(sum(greatest(0, qbeg + len - greatest(qbeg, coalesce(reach, qbeg)))) AS BIGINT) AS l_rep, CAST(sum(greatest(0, qbeg + len - greatest(qbeg, coalesce(reach, qbeg)))) AS DOUBLE) / 150 AS frac_rep FROM o GROUP BY read_id")
def frac_rep(spark, d):
    often = fixture(spark, d, "seeds").where("n_occ > 500").selectExpr("read_id", "qbeg", "qbeg + len qend")
    return intervals.union_length(often, ["read_id"], "qbeg", "qend", "l_rep").withColumn("frac_rep", F.col("l_rep").cast("double") / 150)


@query("chain_weight", "WITH q AS (SELECT read_id, sum(greatest(0, qbeg + len - greatest(qbeg, coalesce(r, qbeg)))) AS w FROM (SELECT *, max(qbeg + len) OVER (PARTITION BY read_id ORDER BY qbeg, qbeg + len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {seeds}) GROUP BY read_id), t AS (SELECT read_id, sum(greatest(0, rbeg + len - greatest(rbeg, coalesce(r, rbeg)))) AS w FROM (SELECT *, max(rbeg + len) OVER (PARTITION BY read_id ORDER BY rbeg, rbeg + len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM {seeds}) GROUP BY read_id) SELECT read_id, CAST(least(q.w, t.w, 1073741823) AS BIGINT) AS weight FROM q JOIN t USING (read_id)")
def chain_weight(spark, d):
    x = fixture(spark, d, "seeds").selectExpr("read_id", "qbeg", "qbeg + len qend", "rbeg", "rbeg + len rend")
    q = intervals.union_length(x, ["read_id"], "qbeg", "qend", "wq")
    t = intervals.union_length(x, ["read_id"], "rbeg", "rend", "wr")
    return q.join(t, "read_id").select("read_id", F.least("wq", "wr", F.lit((1 << 30) - 1)).alias("weight"))


@query("seedcov", "SELECT r.read_id, r.k, CAST(coalesce(sum(s.len), 0) AS BIGINT) AS seedcov FROM {regions} r LEFT JOIN {seeds} s ON s.read_id = r.read_id AND s.qbeg >= r.qb AND s.qbeg + s.len <= r.qe AND s.qbeg % 4 <= r.k GROUP BY r.read_id, r.k, r.rb, r.qb, r.qe, r.score, r.rid")
def seedcov(spark, d):
    r = fixture(spark, d, "regions").withColumnRenamed("read_id", "rd")
    s = fixture(spark, d, "seeds")
    inside = (s["read_id"] == r["rd"]) & (s["qbeg"] >= r["qb"]) & (s["qbeg"] + s["len"] <= r["qe"]) & (s["qbeg"] % 4 <= r["k"])
    return r.join(s, inside, "left").groupBy("rd", "k", "rb", "qb", "qe", "score", "rid").agg(F.coalesce(F.sum("len"), F.lit(0)).cast("bigint").alias("seedcov")).select(F.col("rd").alias("read_id"), "k", "seedcov")
