"""The stored index: tiles of long contigs, loading, and searches that leave it where it lies."""

import random

import pytest

from strandwise.functions.sequence import revcomp
from strandwise.operators import index, seeds, stored

K = 12


@pytest.fixture(scope="module")
def contigs():
    r = random.Random(5)
    dna = lambda n: "".join(r.choice("acgt") for _ in range(n))
    long = dna(8191) + "n" + dna(8180) + "ACgt" * 5 + dna(4000)  # runs over the edges of tiles
    return {3: long, 5: dna(8192), 9: dna(8192 + K - 1), 10: "acg", 11: "", 12: dna(40)}


@pytest.fixture(scope="module")
def held(spark, contigs, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}/it's"
    return path, stored.build_index(spark, spark.createDataFrame(list(contigs.items()), "doc_id bigint, seq string"), path, K)


def test_every_kmer_with_its_neighbours(held, contigs):
    code = lambda b: 0 if not b else {"a": 48, "c": 49, "g": 50, "t": 51, "n": 110}[b.lower()]
    want, offset = [], 0
    for rid, (_, seq) in enumerate(sorted(contigs.items())):
        for i in range(len(seq) - K + 1):
            if "n" not in seq[i : i + K]:
                want.append((seq[i : i + K].lower(), rid, offset + i, code(seq[i - 1 : i] if i else ""), code(seq[i + K : i + K + 1])))
        offset += len(seq)
    got = held[1].kmers.select(index.unpacked(held[1].kmers.kmer, K), "rid", "gpos", "before", "after").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert [tuple(r) for r in held[1].holes.collect()] == [(3, 8191, 1, "n")]


def test_loading(spark, held):
    path, built = held
    spark.sql(f"DROP TABLE {stored._name(path)}")  # as in a session that did not build it
    again = stored.load_index(spark, path)
    assert (again.k, again.l_pac) == (K, built.l_pac)
    assert again.kmers.count() == built.kmers.count() > 0
    with pytest.raises(FileExistsError):
        stored.build_index(spark, built.seqs.select("doc_id", "seq"), path, K)
    with pytest.raises(FileNotFoundError):
        stored.load_index(spark, path + "-none")


def test_searches_shuffle_the_reads_alone(spark, held, contigs):
    reads = spark.createDataFrame([(1, contigs[3][8200:8300]), (2, contigs[9][8100:8200])], "read_id bigint, seq string")
    found = seeds.maximal_matches(reads.union(reads.selectExpr("read_id + 10", "seq").withColumn("seq", revcomp("seq"))), held[1].kmers, K)
    got = {(r.read_id, r.rid, r.strand): (r.qb, r.qe) for r in found.where("qe - qb = 100").collect()}
    assert got == {(1, 0, 0): (0, 100), (2, 2, 0): (0, 100), (11, 0, 1): (0, 100), (12, 2, 1): (0, 100)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin") :]
    assert join.count("Exchange") == 1 and "Bucketed: true" in join


def test_empty_reference(spark, tmp_path):
    empty = stored.build_index(spark, spark.createDataFrame([], "doc_id bigint, seq string"), f"file://{tmp_path}/none", K)
    assert empty.l_pac == 0 and empty.kmers.count() == 0
