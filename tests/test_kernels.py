"""Kernels against textbook recursions on random short sequences."""

import random
import re

import numpy as np
import pytest

from strandwise.operators import align as A
from strandwise.operators import kernels as K
from strandwise.operators.merge import merge_pair
from strandwise.operators.overlaps import Spans, Standing, parents, without_redundant

SC = K.Scoring()


def dna(r, n, letters="ACGT"):
    return "".join(r.choice(letters) for _ in range(n))


def mutated(r, seq, rate=0.1):
    out = []
    for c in seq:
        x = r.random()
        out.append("" if x < rate / 3 else c + r.choice("ACGT") if x < 2 * rate / 3 else r.choice("ACGT") if x < rate else c)
    return "".join(out)


def plain_local(q, t, sc):
    m = sc.matrix()
    h = np.zeros((len(t) + 1, len(q) + 1), int)
    d = np.full_like(h, -10**6)
    s = np.full_like(h, -10**6)
    for i in range(1, len(t) + 1):
        for j in range(1, len(q) + 1):
            d[i, j] = max(d[i - 1, j], h[i - 1, j] - sc.o_del) - sc.e_del
            s[i, j] = max(s[i, j - 1], h[i, j - 1] - sc.o_ins) - sc.e_ins
            h[i, j] = max(0, h[i - 1, j - 1] + m[t[i - 1], q[j - 1]], d[i, j], s[i, j])
    return h


def plain_global(q, t, sc):
    m = sc.matrix()
    big = -10**6
    h = np.full((len(t) + 1, len(q) + 1), big)
    d, s = h.copy(), h.copy()
    h[0, 0] = 0
    for i in range(len(t) + 1):
        for j in range(len(q) + 1):
            if i:
                d[i, j] = max(d[i - 1, j], h[i - 1, j] - sc.o_del) - sc.e_del
            if j:
                s[i, j] = max(s[i, j - 1], h[i, j - 1] - sc.o_ins) - sc.e_ins
            if i and j:
                h[i, j] = h[i - 1, j - 1] + m[t[i - 1], q[j - 1]]
            h[i, j] = max(h[i, j], d[i, j], s[i, j])
    return int(h[-1, -1])


def score_of(ops, q, t, sc):
    m, total, i, j = sc.matrix(), 0, 0, 0
    for op, n in ops:
        if op == "M":
            total += int(m[t[i : i + n], q[j : j + n]].sum())
            i, j = i + n, j + n
        elif op == "D":
            total, i = total - sc.o_del - n * sc.e_del, i + n
        else:
            total, j = total - sc.o_ins - n * sc.e_ins, j + n
    assert (i, j) == (len(t), len(q))
    return total


@pytest.mark.parametrize("seed", range(40))
def test_local_and_global(seed):
    r = random.Random(seed)
    t = dna(r, r.randint(5, 40), "ACGTN" if seed % 4 == 0 else "ACGT")
    q = mutated(r, t[r.randint(0, 4) :], 0.2) or "A"
    sc = SC if seed % 2 else K.Scoring(a=2, b=3, o_del=4, e_del=2, o_ins=5, e_ins=1)
    qc, tc = K.encode(q), K.encode(t)
    h = plain_local(qc, tc, sc)
    score, qb, qe, tb, te, _, _ = K.local(qc, tc, sc)
    assert score == h.max()
    if score:
        assert h[te + 1, qe + 1] == score and te + 1 == np.argwhere(h == score)[0][0]
        assert plain_local(qc[qb : qe + 1], tc[tb : te + 1], sc)[-1, -1] == score
    got, ops = K.global_(qc, tc, 100, sc)
    assert got == plain_global(qc, tc, sc) == score_of(ops, qc, tc, sc)


@pytest.mark.parametrize("seed", range(20))
def test_extension_of_a_match_reaches_its_end(seed):
    r = random.Random(seed)
    t = dna(r, 60)
    q = t[:40]
    score, qle, tle, gtle, gscore, off = K.extend(K.encode(q), K.encode(t), 20, 50, SC)
    assert (score, qle, tle, gtle, gscore, off) == (60, 40, 40, 40, 60, 0)
    broken = list(q)
    broken[20] = "A" if broken[20] != "A" else "C"
    score, qle, *_, gscore, _ = K.extend(K.encode("".join(broken)), K.encode(t), 20, 50, SC)
    assert score == gscore == 20 + 39 - 4 and qle == 40


def test_extension_stops():
    q = K.encode("ACGT" * 5 + "A" * 200)
    t = K.encode("ACGT" * 5 + "C" * 200)
    score, qle, tle, *_ = K.extend(q, t, 20, 100, K.Scoring(zdrop=20))
    assert (score, qle, tle) == (40, 20, 20)
    assert K.extend(q[:0], t, 7, 5, SC)[0] == 7


@pytest.mark.parametrize("seed", range(30))
def test_cigar_md_and_nm(seed):
    r = random.Random(100 + seed)
    t = dna(r, 50)
    q = mutated(r, t, 0.15)
    for reverse in (False, True):
        _, cigar, md, nm = K.align_cigar(q, t, 20, reverse, SC)
        parts = [(int(n), op) for n, op in re.findall("([0-9]+)([MID])", cigar)]
        assert sum(n for n, op in parts if op != "D") == len(q) and sum(n for n, op in parts if op != "I") == len(t)
        edits, i, j = 0, 0, 0
        for n, op in parts:
            if op == "M":
                edits += sum(x != y for x, y in zip(q[j : j + n], t[i : i + n]))
                i, j = i + n, j + n
            else:
                edits += n
                i, j = (i + n, j) if op == "D" else (i, j + n)
        assert nm == edits
        assert sum(map(int, re.findall("[0-9]+", md))) + len(re.findall("[A-Z]", md)) == len(t)


def test_hash_vectors(spark):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(3).orderBy("id").select(K.hash64(F.col("id"))).collect()]
    assert got == ["7654268697807496793", "2320827452992767577", "6174653592142994962"]


def test_options():
    assert A.MemOptions(a=2).scaled().threshold == 60 and A.MemOptions(a=2, b=4, set_by_user=frozenset({"b"})).scaled().b == 4
    assert A.MemOptions().preset("ont2d").min_seed == 14 and A.MemOptions().preset("intractg").b == 9
    with pytest.raises(KeyError):
        A.MemOptions().preset("other")


def test_chains():
    opt = A.MemOptions()
    seeds = [(100, 0, 20, 0, 0, 0, False), (130, 30, 20, 0, 0, 1, False), (105, 5, 10, 0, 0, 2, False), (5000, 10, 25, 0, 0, 3, False), (131, 31, 19, 1, 0, 4, False)]
    chains = A.chained(seeds, opt)
    assert sorted(len(c.seeds) for c in chains) == [1, 1, 2]
    assert max(map(A.weight, chains)) == 40
    kept = A.filtered(chains, opt)
    assert kept[0].standing is Standing.ALONE and all(c.standing is not Standing.DROPPED for c in kept)


def test_primaries():
    opt = A.MemOptions()
    region = lambda qb, qe, score, alt=False: A.Region(0, 0, qb, qe, qb, qe, score, score, 100, 0, 0, alt)
    rows = A.marked([region(0, 100, 90), region(5, 95, 80), region(100, 150, 50), region(0, 100, 87)], 7, opt)
    assert [r.secondary for r in rows] == [-1, 0, 0, -1] and rows[0].sub == 87 and rows[0].sub_n == 1
    rows = A.marked([region(0, 100, 90, True), region(0, 100, 80)], 7, opt)
    assert rows[0].secondary == -1 and not rows[0].alt and rows[0].alt_score == 90


def test_parents_are_the_first_primaries_that_cover():
    r = random.Random(9)
    for _ in range(200):
        rows = [(b, b + r.randint(1, 30), False) for b in (r.randint(0, 60) for _ in range(r.randint(0, 9)))]
        parent = parents(Spans.of(rows), 0.5)
        for i, (b, e, _) in enumerate(rows):
            covers = [j for j in range(i) if parent[j] < 0 and min(e, rows[j][1]) - max(b, rows[j][0]) >= max(1, 0.5 * min(e - b, rows[j][1] - rows[j][0]))]
            assert parent[i] == (covers[0] if covers else -1)


def test_best_of_redundant_regions_stay():
    same = lambda n: np.array([(100, 200 + k % 2) for k in range(n)])
    stays = without_redundant(np.array(sorted(same(6).tolist(), key=lambda x: x[1])), same(6), np.array([50, 70, 60, 90, 80, 10]), 0.95, 10_000)
    assert stays.tolist() == [3]
    apart = np.array([(0, 100), (50, 150), (90, 190)])
    assert without_redundant(apart, apart, np.array([1, 2, 3]), 0.95, 10_000).tolist() == [0, 1, 2]


@pytest.mark.parametrize("overlap", [15, 30, 59])
def test_merge(overlap):
    r = random.Random(overlap)
    whole = dna(r, 120 - overlap)
    r1, r2 = whole[:60], A._turned(whole[-60:])
    assert merge_pair(r1, None, r2, None)[:2] == (0, whole)
    assert merge_pair(dna(r, 60), None, dna(r, 60), None)[0] != 0


@pytest.mark.parametrize("seed", range(6))
def test_many_pairs_at_once_equal_one_at_a_time(seed):
    r = random.Random(seed)
    pairs = []
    for i in range(300):
        t = dna(r, r.choice([20, 45]), "ACGTN" if i % 5 == 0 else "AC" if i % 7 == 0 else "ACGT")
        q = mutated(r, t[r.randrange(8) :], 0.3)[:18].ljust(18, "A") if i % 3 else dna(r, 18)
        pairs.append((K.encode(q), K.encode(t)))
    sc = SC if seed % 2 else K.Scoring(a=5, b=4, o_del=2, e_del=17, o_ins=2, e_ins=17) if seed % 4 else K.Scoring(zdrop=4, o_del=2, o_ins=3)
    w, h0 = r.choice([3, 50]), r.choice([5, 20])
    assert K.in_lanes(pairs, lambda q, t: K.local_lanes(q, t, sc)) == [K.local(q, t, sc) for q, t in pairs]
    assert K.in_lanes(pairs, lambda q, t: K.extend_lanes(q, t, h0, w, sc)) == [K.extend(q, t, h0, w, sc) for q, t in pairs]
    assert K.in_lanes(pairs, lambda q, t: K.global_lanes(q, t, w, sc)) == [K.global_(q, t, w, sc) for q, t in pairs]


def test_overlap_scores_are_those_of_each_length():
    from strandwise.operators.merge import SCORING, _overlap_scores

    r, mat = random.Random(3), SCORING.matrix()
    for na, nb in ((60, 60), (40, 55), (55, 40), (1, 1)):
        a, b = K.encode(dna(r, na, "ACGTN")), K.encode(dna(r, nb))
        assert _overlap_scores(a, b).tolist() == [0, *(int(mat[b[:n], a[na - n :]].sum()) for n in range(1, min(na, nb)))]
