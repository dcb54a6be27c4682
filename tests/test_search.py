"""Searches against brute force, and alignment of planted reads under any partitioning."""

import random

import pytest

from strandwise.operators import align as A
from strandwise.operators import bounded, index, intervals, seeds
from strandwise.plans.catalog import QUERIES
from strandwise.plans.prefix import running_totals
from strandwise.plans.registry import fixture

K = 8


def turned(s):
    return s[::-1].translate(str.maketrans("acgt", "tgca"))


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(11)
    dna = lambda n: "".join(r.choice("acgt") for _ in range(n))
    repeat = dna(60)
    contigs = {i: dna(300) + (repeat if i % 2 else "") + dna(200) for i in range(6)}
    contigs[6] = contigs[0][50:250]
    reads = {}
    for i in range(40):
        seq = contigs[r.randrange(6)]
        at = r.randrange(len(seq) - 60)
        read = list(seq[at : at + 60])
        for _ in range(i % 3):
            read[r.randrange(60)] = r.choice("acgt")
        reads[i] = "".join(read) if i % 4 else turned("".join(read))
    reads[90] = dna(60)
    reads[91] = "acgtn" * 12
    fasta = spark.createDataFrame(list(contigs.items()), "doc_id bigint, seq string")
    seqs = index.sequences(fasta)
    return contigs, reads, seqs, index.kmers(seqs, K), spark.createDataFrame(list(reads.items()), "read_id bigint, seq string")


def occurrences(text, contigs):
    n = 0
    for seq in contigs.values():
        for strand in (seq, turned(seq)):
            n += sum(strand.startswith(text, i) for i in range(len(strand) - len(text) + 1))
    return n


def plain_smems(read, contigs):
    spans = []
    for b in range(len(read)):
        e = b
        while e < len(read) and read[e] in "acgt" and occurrences(read[b : e + 1], contigs):
            e += 1
        if e - b >= K:
            spans.append((b, e))
    return sorted((b, e, occurrences(read[b:e], contigs)) for b, e in spans if not any(c <= b and e <= f and (c, f) != (b, e) for c, f in spans))


def test_super_maximal_matches(world):
    contigs, reads, _, kmers, table = world
    got = {}
    for r in seeds.super_maximal(seeds.maximal_matches(table, kmers, K)).collect():
        got.setdefault(r.read_id, []).append((r.qb, r.qe, r.n_occ))
    for i in list(reads)[::3] + [90, 91]:
        assert sorted(got.get(i, [])) == plain_smems(reads[i], contigs), i


def test_exact_and_bounded_search(world):
    contigs, reads, seqs, kmers, table = world
    want = {d: set() for d in (0, 2)}
    for i, read in reads.items():
        for rid, seq in contigs.items():
            for strand in (0, 1):
                text = read if strand == 0 else turned(read)
                for p in range(len(seq) - len(text) + 1):
                    mm = sum(a != b for a, b in zip(text, seq[p : p + len(text)]))
                    for d in want:
                        if mm <= d:
                            want[d].add((i, rid, strand, p, mm) if d else (i, rid, strand, p))
    assert {(r.read_id, r.rid, r.strand, r.pos) for r in seeds.exact_matches(table, seqs, kmers, K).collect()} == want[0]
    assert {tuple(r) for r in bounded.mismatch_hits(table, seqs, kmers, K, 2).collect()} == want[2]


def test_alignment_recovers_planted_reads_whatever_the_partitions(spark, world):
    contigs, reads, seqs, kmers, table = world
    opt = A.MemOptions(min_seed=K, threshold=25)
    results = []
    for n in ("1", "5", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        mems = seeds.maximal_matches(table, kmers, K)
        places = seeds.occurrences(mems, seeds.super_maximal(mems), opt.max_occ)
        results.append(sorted(tuple(r) for r in A.align(A.seed_rows(table, seqs, places, 180), opt).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1] == results[2]
    best = {}
    for read_id, nth, rid, strand, pos, flag, mapq, cigar, md, nm, score, *_ in results[0]:
        best.setdefault(read_id, (rid, strand, pos, cigar, nm))
    for i in range(40):
        rid, strand, pos, cigar, nm = best[i]
        if cigar == "60M":
            text = reads[i] if strand == 0 else turned(reads[i])
            assert sum(a != b for a, b in zip(text, contigs[rid][pos : pos + 60])) == nm
    assert sum(best[i][3] == "60M" for i in range(40)) >= 36 and 90 not in best


def test_suffix_ranks(spark):
    text = "banana" + "ab" * 20 + "n"
    got = {r.pos: r.rank for r in index.suffix_ranks(spark, spark.createDataFrame([(1, text)], "doc_id bigint, seq string")).collect()}
    order = sorted(range(len(text)), key=lambda i: text[i:])
    assert [got[i] for i in order] == list(range(1, len(text) + 1))


def test_running_totals(spark):
    rows = [(i * 777, i % 5) for i in range(50)] + [(-3, 2)]
    got = {r.k: (r.n, r.s) for r in running_totals(spark.createDataFrame(rows, "k bigint, v bigint"), "k", {"n": "1", "s": "v"}, width=100).collect()}
    for k, _ in rows:
        earlier = [v for j, v in rows if j < k]
        assert got[k] == (len(earlier), sum(earlier))


def test_interval_join(spark):
    r = random.Random(2)
    spans = lambda n: [(i, r.randrange(3), a := r.randrange(200), a + r.randrange(0, 60)) for i in range(n)]
    a, b = spans(80), spans(80)
    left = spark.createDataFrame(a, "i long, g long, s long, e long")
    right = spark.createDataFrame(b, "j long, g long, t long, f long")
    got = sorted((x.i, x.j) for x in intervals.interval_join(left, right, ["g"], "s", "e", "t", "f", bits=4).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3] and x[2] < x[3] and y[2] < y[3])


def test_overlaps_of_regions_of_every_score(spark, sf_dir, tmp_path):
    for name, n in (("lineitem", 600), ("orders", 300), ("documents", None)):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        (df.orderBy(*df.columns[:4]).limit(n) if n else df).write.parquet(f"{tmp_path}/{name}.parquet")
    d = str(tmp_path)
    spans = [(r.o_orderkey, r.o_custkey % 25, r.o_orderkey * 31 % 20000, r.o_orderkey * 31 % 20000 + 1 + r.o_custkey % 40) for r in spark.read.parquet(f"{d}/orders.parquet").collect()]
    regions = fixture(spark, d, "regions").collect()
    want = sorted((a.read_id, a.k, other, min(a.re, e) - max(a.rb, st)) for a in regions for other, rid, st, e in spans if a.rid == rid and a.rb < e and st < a.re)
    assert want and any(a.score < 90 for a in regions)
    assert sorted(map(tuple, QUERIES["intv_ovlp_all"](spark, d).select("read_id", "k", "other", "overlap").collect())) == want


def test_union_of_all_three_seeding_passes(spark, sf_dir):
    cols = ("read_id", "qb", "qe", "n_occ")
    rows = QUERIES["seeds_union_all"](spark, sf_dir).select("pass", *cols).collect()
    assert sorted(tuple(r) for r in rows if r[0] < 3) == sorted(map(tuple, QUERIES["seeds_union"](spark, sf_dir).select("pass", *cols).collect()))
    third = sorted(tuple(r[1:]) for r in rows if r[0] == 3)
    assert third and third == sorted(map(tuple, QUERIES["seed3"](spark, sf_dir).select(*cols).collect()))


def test_whole_searches_read_no_index_and_shuffle_no_contigs(spark, sf_dir, monkeypatch):
    from strandwise.plans import search_queries

    monkeypatch.setattr(search_queries, "session_index", None)  # these queries built an index of all k-mers before
    for name in ("exact_match", "aln", "fetch_seq", "mate_rescue", "sam_mem"):
        assert QUERIES[name](spark, sf_dir).count() > 0
