"""Kernels, chaining, alignment, bounded-difference search, merging and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from strandwise.functions import sequence as S
from strandwise.operators import align as A
from strandwise.operators import bounded, index, many, merge, seeds, windows
from strandwise.operators import kernels as K
from strandwise.operators import pairing as P
from strandwise.plans.registry import FIXTURES, fixture, query
from strandwise.plans.scratch import scratch_folder
from strandwise.plans.search_queries import _KM, exact_reads, matches, tables
from strandwise.plans.search_queries import K as SEED
from strandwise.sources import sam

SC = K.Scoring()

FIXTURES["windows"] = "SELECT doc_id, substring(seq, CAST((doc_id * 7919) % (length(seq) - 300) + 1 AS INT), 200) AS target, substring(seq, CAST((doc_id * 7919) % (length(seq) - 300) + 71 AS INT), 60) AS query FROM {dna} WHERE length(seq) >= 400"


def per_row(df, schema: str, fn):
    """``fn(row tuple) -> tuple`` over Arrow batches."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([fn(r) for r in pdf.itertuples(index=False)], columns=names)

    return df.mapInPandas(run, schema)


def _in_lanes(df, schema: str, pair, fn):
    """``doc_id`` and ``fn(queries, targets)`` of the pair of sequences that ``pair(row)`` gives, many pairs at a time."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches):
        for pdf in batches:
            rows = list(pdf.itertuples(index=False))
            found = K.in_lanes([tuple(map(K.encode, pair(r))) for r in rows], fn)
            yield pd.DataFrame([(r.doc_id, *x) for r, x in zip(rows, found, strict=True)], columns=names)

    return df.mapInPandas(run, schema)


@query("sw_local", "SELECT doc_id, 60 AS score, 0 AS qb, 59 AS qe, CAST(strpos(target, query) - 1 AS INT) AS tb, CAST(strpos(target, query) + 58 AS INT) AS te FROM {windows}")
def sw_local(spark, d):
    schema = "doc_id bigint, score int, qb int, qe int, tb int, te int"
    return _in_lanes(fixture(spark, d, "windows"), schema, lambda r: (r.query, r.target), lambda q, t: K.local_lanes(q, t, SC)[:5])


@query("sw_extend")
def sw_extend(spark, d):
    schema = "doc_id bigint, score int, qle int, tle int, gtle int, gscore int, max_off int"
    return _in_lanes(fixture(spark, d, "windows"), schema, lambda r: (r.query[20:], r.target[90:190]), lambda q, t: K.extend_lanes(q, t, 20, 50, SC))


@query("nw_global")
def nw_global(spark, d):
    def one(q, t):
        score, ways = K.global_lanes(q, t, 10, SC)
        return score, [K.cigar_text(x) for x in ways]

    return _in_lanes(fixture(spark, d, "windows"), "doc_id bigint, score int, cigar string", lambda r: (r.query[:25] + r.query[28:], r.query), one)


@query("gen_cigar")
def gen_cigar(spark, d):
    def one(r):
        score, cigar, md, nm = K.align_cigar(r.query[:25] + r.query[28:], r.query, 10, r.doc_id % 2 == 1, SC)
        return r.doc_id, score, cigar, md, nm

    return per_row(fixture(spark, d, "windows"), "doc_id bigint, score int, cigar string, md string, nm int", one)


@query("md_nm", "SELECT doc_id, '100M' AS cigar, '49' || upper(substring(seq, 50, 1)) || '50' AS md, 1 AS nm, 95 AS score FROM {dna} WHERE length(seq) >= 400")
def md_nm(spark, d):
    x = fixture(spark, d, "reads").where("read_id % 2 = 1").join(fixture(spark, d, "dna").select("doc_id", F.col("seq").alias("ref")), "doc_id").select("doc_id", F.col("seq").alias("read"), F.substring("ref", 1, 100).alias("target"))

    def one(r):
        score, cigar, md, nm = K.align_cigar(r.read, r.target, 0, False, SC)
        return r.doc_id, cigar, md, nm, score

    return per_row(x, "doc_id bigint, cigar string, md string, nm int, score int", one)


def _seed_rows(spark, d):
    seqs, _, reads = tables(spark, d)
    mems = matches(spark, d)
    places = seeds.occurrences(mems, seeds.super_maximal(mems), A.MemOptions().max_occ)
    return A.seed_rows(reads, seqs, places, 220)


@query("chain_exact")
def chain_exact(spark, d):
    return many.per_groups(fixture(spark, d, "seeds"), "read_id", "read_id bigint, chain int, n_seeds int, qb int, qe int, rb bigint, weight int", lambda x: many.chains_by_place(x, A.MemOptions()))


@query("chain_flt")
def chain_flt(spark, d):
    return many.per_groups(fixture(spark, d, "seeds"), "read_id", "read_id bigint, nth int, kept int, weight int, qb int, qe int", lambda x: many.chains_to_extend(x, A.MemOptions()))


@query("primary")
def primary(spark, d):
    return many.per_groups(fixture(spark, d, "regions"), "read_id", "read_id bigint, nth int, rid int, rb bigint, qb int, qe int, score int, sub int, sub_n int, secondary int, alt_score int", lambda x: many.primaries(x, A.MemOptions()))


@query("extend")
def extend(spark, d):
    return A.align(_seed_rows(spark, d)).select("read_id", "nth", "rid", "strand", "rb", "re", "qb", "qe", "score", "seedcov")


@query("reg2aln")
def reg2aln(spark, d):
    return A.align(_seed_rows(spark, d)).select("read_id", "nth", "rid", "pos", "flag", "mapq", "cigar", "md", "nm", "score", "sub", "secondary")


_EXACT = f"WITH {_KM}, hit AS (SELECT read_id, r.seq, rid, strand, CASE WHEN strand = 0 THEN pos ELSE len - pos - length(r.seq) END AS pos FROM {{reads}} r JOIN km ON r.seq[1:{SEED}] = kmer JOIN {{contigs}} c USING (rid) WHERE pos + length(r.seq) <= len AND CASE WHEN strand = 0 THEN c.seq[pos + 1:pos + length(r.seq)] = r.seq ELSE translate(reverse(c.seq), 'acgt', 'tgca')[pos + 1:pos + length(r.seq)] = r.seq END)"


@query("sam_mem", f"{_EXACT} SELECT 'r' || read_id || '\t' || (strand * 16) || '\tc' || rid || '\t' || (pos + 1) || '\t0\t' || length(seq) || 'M\t*\t0\t0\t' || CASE WHEN strand = 0 THEN upper(seq) ELSE upper(translate(reverse(seq), 'acgt', 'tgca')) END || '\t*\tNM:i:0\tMD:Z:' || length(seq) || '\tAS:i:' || length(seq) AS line FROM hit")
def sam_mem(spark, d):
    found = exact_reads(spark, d, fixture(spark, d, "reads"))
    hit = found.withColumn("seq", F.when(F.col("strand") == 0, F.col("text")).otherwise(S.revcomp(F.col("text"))))
    n = F.length("seq")
    rows = hit.select(
        F.concat(F.lit("r"), "read_id").alias("qname"),
        (F.col("strand") * 16).alias("flag"),
        F.concat(F.lit("c"), "rid").alias("rname"),
        (F.col("pos") + 1).alias("pos"),
        F.lit(0).alias("mapq"),
        F.concat(n, F.lit("M")).alias("cigar"),
        F.lit("*").alias("rnext"),
        F.lit(0).alias("pnext"),
        F.lit(0).alias("tlen"),
        F.upper(F.when(F.col("strand") == 0, F.col("seq")).otherwise(S.revcomp(F.col("seq")))).alias("seq"),
        F.lit("*").alias("qual"),
        n.alias("n"),
    )
    return rows.select(sam.line(rows, [("NM", "i", F.lit(0)), ("MD", "Z", F.col("n")), ("AS", "i", F.col("n"))]).alias("line"))


_B = 50
_ALN = f"""WITH bk AS (SELECT rid, strand, seq[p:p + {_B - 1}] AS b, p - 1 AS pos, len FROM (SELECT rid, strand, seq, len, unnest(range(1, length(seq) - {_B} + 2)) AS p FROM (SELECT rid, 0 AS strand, seq, len FROM {{contigs}} UNION ALL SELECT rid, 1, translate(reverse(seq), 'acgt', 'tgca'), len FROM {{contigs}}))),
c AS (SELECT DISTINCT read_id, r.seq AS read, rid, strand, len, pos - o AS st FROM {{reads}} r, (SELECT unnest([0, {_B}]) AS o) JOIN bk ON r.seq[o + 1:o + {_B}] = b),
h AS (SELECT read_id, rid, strand, CASE WHEN strand = 0 THEN st ELSE len - st - 100 END AS pos, hamming(read, CASE WHEN strand = 0 THEN g.seq[st + 1:st + 100] ELSE translate(reverse(g.seq), 'acgt', 'tgca')[st + 1:st + 100] END) AS mm FROM c JOIN (SELECT rid, seq FROM {{contigs}}) g USING (rid) WHERE st >= 0 AND st + 100 <= len)"""


@query("aln", f"{_ALN} SELECT read_id, rid, strand, pos, CAST(mm AS INT) AS mm FROM h WHERE mm <= 1")
def aln(spark, d):
    dna = fixture(spark, d, "dna")
    return windows.near_places(fixture(spark, d, "reads"), dna, index.axis(dna), "doc_id", SEED, 1)


_SE = f"{_ALN}, m AS (SELECT *, min(mm) OVER (PARTITION BY read_id) AS xm FROM h WHERE mm <= 1), g AS (SELECT read_id, xm, count(*) FILTER (mm = xm) AS x0, count(*) FILTER (mm > xm) AS x1, min({{{{'r': rid, 'p': pos, 's': strand}}}}) FILTER (mm = xm) AS a FROM m GROUP BY read_id, xm) SELECT read_id, a.r AS rid, a.p AS pos, a.s AS strand, x0, x1, CAST(xm AS INT) AS xm, CASE WHEN x0 > 1 THEN 'R' ELSE 'U' END AS xt, CASE WHEN x0 > 1 THEN 0 WHEN xm = 1 THEN 25 WHEN x1 = 0 THEN 37 ELSE greatest(23 - CAST(trunc(4.343 * ln(least(x1, 255)::DOUBLE) + 0.5) AS INT), 0) END AS mapq FROM g"
_SE = _SE.replace("{{'r'", "{'r'").replace("strand}}", "strand}")


@query("samse", _SE)
def samse(spark, d):
    return bounded.single_end(aln(spark, d), 1)


@query("sam_se", f"SELECT 'r' || read_id || '\t' || (strand * 16) || '\tc' || rid || '\t' || (pos + 1) || '\t' || mapq || '\t100M\tXT:A:' || xt || '\tX0:i:' || x0 || '\tX1:i:' || x1 || '\tXM:i:' || xm AS line FROM ({_SE})")
def sam_se(spark, d):
    x = samse(spark, d)
    return x.select(F.concat_ws("\t", F.concat(F.lit("r"), "read_id"), F.col("strand") * 16, F.concat(F.lit("c"), "rid"), F.col("pos") + 1, "mapq", F.lit("100M"), F.concat(F.lit("XT:A:"), "xt"), F.concat(F.lit("X0:i:"), "x0"), F.concat(F.lit("X1:i:"), "x1"), F.concat(F.lit("XM:i:"), "xm")).alias("line"))


def _merged(spark, d):
    x = fixture(spark, d, "reads_pe").select("pair_id", "r1", F.lit(None).cast("string").alias("q1"), "r2", F.lit(None).cast("string").alias("q2"))
    return merge.merge_pairs(x)


@query("pemerge")
def pemerge(spark, d):
    return _merged(spark, d)


@query("pemerge_stats")
def pemerge_stats(spark, d):
    return _merged(spark, d).groupBy("code").agg(F.count("*").alias("n"))


def _ends(spark, d):
    """Both ends of the inserts as reads, and their alignments."""
    pe = fixture(spark, d, "reads_pe")
    reads = pe.select((F.col("pair_id") * 2).alias("read_id"), F.col("r1").alias("seq")).unionByName(pe.select((F.col("pair_id") * 2 + 1).alias("read_id"), F.col("r2").alias("seq")))
    seqs, kmers, _ = tables(spark, d)
    mems = seeds.maximal_matches(reads, kmers, SEED)
    places = seeds.occurrences(mems, seeds.super_maximal(mems), A.MemOptions().max_occ)
    return A.align(A.seed_rows(reads, seqs, places, 180)), reads


@query("sam_pe")
def sam_pe(spark, d):
    """Paired records: best pairs within the bounds of the forward-reverse orientation, flags, lengths and joint qualities."""
    found, reads = _ends(spark, d)
    top = found.where("nth = 0").withColumns({"pair_id": F.floor(F.col("read_id") / 2), "mate": (F.col("read_id") % 2).cast("int")})
    cols = ("rid", "strand", "pos", "mapq", "cigar", "score", "sub")
    both = top.where("mate = 0").select("pair_id", *(F.col(c).alias(f"{c}_0") for c in cols)).join(top.where("mate = 1").select("pair_id", *(F.col(c).alias(f"{c}_1") for c in cols)), "pair_id", "full")
    same = (F.col("rid_0") == F.col("rid_1")) & (F.col("strand_0") != F.col("strand_1"))
    left = F.when(F.col("strand_0") == 0, F.col("pos_0")).otherwise(F.col("pos_1"))
    right = F.when(F.col("strand_0") == 1, F.col("pos_0")).otherwise(F.col("pos_1"))
    proper = F.coalesce(same & (right - left).between(-10, 400), F.lit(False))
    q_pe = S.pair_mapq(F.col("score_0") + F.col("score_1"), F.col("sub_0") + F.col("sub_1"), F.col("score_0") + F.col("score_1") - 17, F.lit(0), F.lit(0.0), F.lit(0.0))
    out = None
    for me, other in (("0", "1"), ("1", "0")):
        mine, theirs = F.col(f"pos_{me}").isNotNull(), F.col(f"pos_{other}").isNotNull()
        flag = S.sam_flag(F.lit(True), ~mine, ~theirs, F.coalesce(F.col(f"strand_{me}") == 1, F.lit(False)), F.coalesce(F.col(f"strand_{other}") == 1, F.lit(False)), proper, F.lit(me == "1"), F.lit(False), F.lit(False))
        tlen = S.template_length(F.col(f"pos_{me}"), F.col(f"strand_{me}") == 1, S.ref_length(F.col(f"cigar_{me}")), F.col(f"pos_{other}"), F.col(f"strand_{other}") == 1, S.ref_length(F.col(f"cigar_{other}")))
        mapq = F.when(proper, S.joint_mapq(F.col(f"mapq_{me}"), q_pe, F.col(f"score_{me}"), F.lit(0))).otherwise(F.col(f"mapq_{me}"))
        rows = both.select("pair_id", F.lit(int(me)).alias("mate"), flag.alias("flag"), F.col(f"rid_{me}").alias("rid"), F.col(f"pos_{me}").alias("pos"), mapq.alias("mapq"), F.col(f"cigar_{me}").alias("cigar"), F.when(F.col("rid_0") == F.col("rid_1"), tlen).otherwise(F.lit(0)).alias("tlen"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("stream_align")
def stream_align(spark, d):
    """Reads as a file stream, aligned a micro-batch at a time."""
    from strandwise.streaming.align import run_batches

    source, out, state = (scratch_folder(spark, f"stream-{x}") for x in ("in", "out", "state"))
    fixture(spark, d, "reads").select("read_id", "seq").repartition(2).write.parquet(source)

    def work(batch, number):
        return exact_reads(spark, d, batch).select("read_id", "rid", "strand", "pos")

    stream = spark.readStream.schema("read_id bigint, seq string").option("maxFilesPerTrigger", 1).parquet(source)
    run_batches(stream, work, out, state).awaitTermination()
    return spark.read.schema("read_id bigint, rid bigint, strand int, pos bigint").parquet(out)


@query("stream_isize")
def stream_isize(spark, d):
    """Insert sizes of a file stream of pairs; a batch where an orientation fails uses what it had."""
    from strandwise.streaming.align import CarriedStats, run_batches

    source, out, state = (scratch_folder(spark, f"stream-{x}") for x in ("in", "out", "state"))
    ends = P.unique_pairs(fixture(spark, d, "ends")).select("pair_id", "orient", "dist")
    ends.repartitionByRange(3, "pair_id").write.parquet(source)
    carried = CarriedStats(scratch_folder(spark, "stream-sizes"))

    def work(batch, number):
        rows = carried.update(P.insert_stats(batch, []), number)
        return spark.createDataFrame([(number, *r) for r in rows], "batch_no bigint, orient int, low int, high int, avg double, std double")

    stream = spark.readStream.schema("pair_id bigint, orient int, dist bigint").option("maxFilesPerTrigger", 1).parquet(source)
    run_batches(stream, work, out, state).awaitTermination()
    return spark.read.schema("batch_no bigint, orient int, low int, high int, avg double, std double").parquet(out)


