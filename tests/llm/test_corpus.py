"""Dedup, sharding, mixing, quality and decontamination against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from helpers import awkward, empty, prose, table
from strandwise.llm import bloom, op3_sharding, op5_simhash, op6_mixing, op7_quality, op8_decontaminate
from strandwise.llm.components import connected_components
from strandwise.llm.tokenize import tokenizer_path

# ---- components and SimHash ----


def roots_of(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    r = random.Random(3)
    links = {"chain": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 60)], "random": [(r.randint(0, 99), r.randint(0, 99)) for _ in range(70)], "none": []}[shape]
    got = {x.node: x.root for x in connected_components(spark, spark.createDataFrame([*links, (5, 5)], "a bigint, b bigint")).collect()}
    want = roots_of(100, links)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert set(got) == nodes
    groups = lambda f: {frozenset(x for x in nodes if f(x) == v) for v in {f(x) for x in nodes}}
    assert groups(got.__getitem__) == groups(want.__getitem__)


def plain_fingerprint(text, k):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in (None, "", " \t\n", "One", "one two", "A b C", "a b c d e a b c", prose(1, 300), "Ünï É é ſ K a b"):
        assert op5_simhash.fingerprint(text, 3) == plain_fingerprint(text, 3)


@pytest.mark.parametrize(("bits", "extra"), [(1, 1), (2, 1), (3, 2), (4, 2)])
def test_every_near_pair_shares_an_anchor(bits, extra):
    rng = np.random.default_rng(bits)
    x = rng.integers(0, 2**64, 400, dtype=np.uint64)
    y = x.copy()
    for _ in range(bits):
        y ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
    sets = []
    for fps in (x, y):
        at = collections.defaultdict(set)
        for row, key in zip(*(c.tolist() for c in op5_simhash.anchors(fps, extra))):
            at[row].add(key)
        sets.append(at)
    assert all(sets[0][i] & sets[1][i] for i in range(len(x)))


@pytest.mark.parametrize("n", [10, 300, 3000])
def test_local_links_connect_what_is_near(n, monkeypatch):
    monkeypatch.setattr(op5_simhash, "PAIRWISE", 200)
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 2**64, 5, dtype=np.uint64)
    fps = centres[rng.integers(0, 5, n)].copy()
    for _ in range(4):
        fps ^= (np.uint64(1) << rng.integers(0, 12, n).astype(np.uint64)) * rng.integers(0, 2, n).astype(np.uint64)
    fps = np.unique(fps)
    i, j = op5_simhash.local_links(fps, 2)
    near = [(a, int(b)) for a in range(len(fps)) for b in np.flatnonzero(np.bitwise_count(fps ^ fps[a]) <= 2) if b > a]
    assert roots_of(len(fps), list(zip(i.tolist(), j.tolist()))) == roots_of(len(fps), near)


def test_near_duplicates_equal_brute_force(spark):
    base = [prose(9, 40).split() for _ in range(1)][0]
    rows = awkward()
    for k in range(40):
        words = list(base)
        words[k % 40] = f"edit{k}"
        rows.append((200 + k, " ".join(words), "en", "s0", 0))
    docs = table(spark, rows, clash=("fp", "rep", "component_id", "anchor"))
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.fp % 2**64, r.component_id if r.component_id is not None else -1) for r in op5_simhash.near_duplicates(spark, docs, 3, 2).collect())
    fps = [plain_fingerprint(r[1], 3) for r in rows]
    root = roots_of(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    least = {}
    for r, x in zip(root, rows):
        if x[0] is not None:
            least[r] = min(least.get(r, x[0]), x[0])
    assert got == sorted(((x[0] is not None, x[0] or 0), f, least.get(r, -1)) for x, f, r in zip(rows, fps, root))
    assert op5_simhash.near_duplicates(spark, empty(spark)).count() == 0


def test_keep_one_of_each_group(spark):
    body = prose(20, 300).split()
    rows = [(r[0], *r[1:]) for r in awkward()]
    for k in range(12):
        words = list(body)
        words[7 * k] = "edited"
        rows.append((300 + k, " ".join(words), "en", "s0", 0))
    rows.append((320, " ".join(body[:150] + prose(21, 150).split()), "en", "s0", 0))  # half of it is another text
    docs = table(spark, rows, clash=("_id", "_key", "node", "key"))
    kept = op5_simhash.keep_one(spark, docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(105) == 0 and ids.count(104) == 0 and ids.count(4) == 1  # equal texts of 4, 104, 105 and 105
    assert [i for i in ids if i is not None and 300 <= i < 312] == [300] and 320 in ids
    assert len([i for i in ids if i is not None and i < 24]) == 24
    assert ids.count(None) == 2
    assert len([i for i in ids if i in (100, 101, 102)]) == 1  # blank texts are one group
    assert op5_simhash.keep_one(spark, empty(spark)).count() == 0


def plain_groups(rows, shingle=5, similarity=0.8):
    sets = []
    for r in rows:
        words = (r[1] or "").encode().lower().split()
        sets.append({tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))})
    alike = lambda a, b: len(a & b) >= similarity * len(a | b)
    return roots_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])])


def assert_groups(spark, rows):
    """similar_groups puts rows with distinct ids together exactly where brute force does."""
    got = {r.doc_id: r.node for r in op5_simhash.similar_groups(spark, table(spark, rows)).collect()}
    root = plain_groups(rows)
    assert len(set(zip(root, (got[r[0]] for r in rows)))) == len(set(root)) == len(set(got.values()))


def contiguous_edits():
    rows = []
    for k in range(60):  # one paragraph more: similarity falls from 0.91 to 0.79
        body = prose(1000 + k, 300).split()
        rows.append((2 * k, " ".join(body), "en", "s0", 0))
        rows.append((2 * k + 1, " ".join(body[: 5 * k] + prose(3000 + k, 26 + k * 52 // 60).split() + body[5 * k :]), "en", "s0", 0))
    return rows


def test_similar_groups_find_every_contiguous_edit(spark):
    assert_groups(spark, contiguous_edits())


def test_similar_groups_drop_no_candidate_of_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(op5_simhash, "frequency_classes", lambda *_: np.zeros(op5_simhash.COUNTERS))  # in order of hash, which refuses few pairs early
    rows = []
    for g in range(20):  # one text at 0.804 among eleven at 0.798, which are nothing to each other
        body = prose(5000 + g, 300).split()
        for k in range(12):
            less = k != g % 12
            own = body[: 22 * k] + prose(6000 + 100 * g + k, 26 + less).split() + body[22 * k + 30 + less :]
            rows.append((len(rows), " ".join(own), "en", "s0", 0))
        rows.append((len(rows), " ".join(body), "en", "s0", 0))
    assert_groups(spark, rows)


def scattered_edits():
    """Texts of 2,000 words and copies of each with one word edited, alone or repeated, and one unrelated text each."""
    rows = []
    for g in range(30):
        body = prose(7000 + g, 2000).split()
        for k in range(4):
            own = body[: 400 * k] + ["edited"] * (k > 0) + body[400 * k + (k > 0) :]
            rows.append((len(rows), " ".join(own), "en", "s0", 0))
        rows.append((len(rows), " ".join(body + body), "en", "s0", 0))  # nearly the same set, another fingerprint or the same
        rows.append((len(rows), prose(8000 + g, 300), "en", "s0", 0))
    return rows


def test_similar_groups_join_what_the_covering_meets(spark, monkeypatch):
    """Without any pair from the prefixes, exactly the near pairs of fingerprints that are similar too are joined."""
    none = "anchor bigint, node bigint, size int, place int"
    monkeypatch.setattr(op5_simhash, "_shared_anchors", lambda s, _: op5_simhash.write_table(s, s.createDataFrame([], none), "shared-anchors"))
    rows = scattered_edits()
    fps = np.array([plain_fingerprint(r[1], 5) for r in rows], np.uint64)
    near = [(i, j) for j in range(len(rows)) for i in range(j) if int(fps[i] ^ fps[j]).bit_count() <= 2]
    sets = [set(op5_simhash.shingle_set(r[1], 5).tolist()) for r in rows]
    alike = [(i, j) for i, j in near if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(near) == len(alike) > 30  # so no refused link stands between two that are joined
    got = {r.doc_id: r.node for r in op5_simhash.similar_groups(spark, table(spark, rows)).collect()}
    root = roots_of(len(rows), alike)
    assert len(set(zip(root, (got[r[0]] for r in rows), strict=True))) == len(set(root)) == len(set(got.values()))


def test_covering_pairs_are_part_of_the_groups(spark):
    """The exact way adds what the covering does not meet."""
    assert_groups(spark, scattered_edits())


def test_near_dedup_releases_what_its_workers_hold(spark, monkeypatch):
    workers = pytest.importorskip("strandwise.llm.workers")
    held = workers.encoder(tokenizer_path(), 2, False)
    assert list(workers.lean(lambda batches: (b for b in batches))([1, 2])) == [1, 2]
    assert workers.encoder.cache_info().currsize == 0 and workers.encoder(tokenizer_path(), 2, False) is not held
    wrapped = []
    monkeypatch.setattr(op5_simhash, "lean", lambda run: wrapped.append(run.__name__) or workers.lean(run))
    op5_simhash.similar_groups(spark, table(spark, scattered_edits()[:12])).count()
    assert {"hashed", "count", "merge", "prints", "replicate", "shared", "run"} <= set(wrapped)


# ---- sharding ----


def plain_links(texts, shingle=5, similarity=0.8):
    """All pairs of texts that similar, by counting common shingles through an index of the less frequent ones."""
    sets = [op5_simhash.shingle_set(t, shingle).tolist() for t in texts]
    holders = collections.defaultdict(list)
    for i, hashes in enumerate(sets):
        for h in hashes:
            holders[h].append(i)
    common = collections.Counter(pair for rows in holders.values() for k, j in enumerate(rows) for pair in ((i, j) for i in rows[:k]))
    return [(i, j) for (i, j), n in common.items() if n + 1e-9 >= similarity * (len(sets[i]) + len(sets[j]) - n)]


def test_similar_groups_of_all_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    root = roots_of(len(rows), plain_links([r.text for r in rows]))
    got = {r.doc_id: r.node for r in op5_simhash.similar_groups(spark, docs).collect()}
    by_root, by_node = collections.defaultdict(set), collections.defaultdict(set)
    for r, k in zip(rows, root, strict=True):
        by_root[k].add(r.doc_id)
        by_node[got[r.doc_id]].add(r.doc_id)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_node.values()))


def test_similar_groups_of_one_dense_cluster(spark):
    """5,000 edits of one text: most pairs are below the similarity, chains of those above it join many."""
    r = random.Random(11)
    body = prose(50, 60).split()
    texts = []
    for _ in range(5000):
        words = list(body)
        for _ in range(r.randint(1, 2)):
            words[r.randrange(60)] = f"e{r.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [set(op5_simhash.shingle_set(t, 5).tolist()) for t in texts]
    often = collections.Counter(h for s in sets for h in s)
    code = {h: k for k, h in enumerate(h for h, n in often.items() if n > 1)}
    bits = np.zeros((5000, len(code)), np.float32)
    for i, s in enumerate(sets):
        bits[i, [code[h] for h in s if h in code]] = 1
    sizes = np.array(list(map(len, sets)))
    links = []
    for a in range(0, 5000, 500):
        common = bits[a : a + 500] @ bits.T
        i, j = np.nonzero(common + 1e-6 >= 0.8 * (sizes[a : a + 500, None] + sizes[None, :] - common))
        links += zip((i + a).tolist(), j.tolist(), strict=True)
    root = roots_of(5000, links)
    got = {r.doc_id: r.node for r in op5_simhash.similar_groups(spark, table(spark, [(i, t, "en", "s0", 0) for i, t in enumerate(texts)])).collect()}
    assert len(set(got.values())) == len(set(root)) and len(set(zip(root, map(got.get, range(5000)), strict=True))) == len(set(root))


def test_frequency_classes_cover_all_sets(spark):
    r = np.random.default_rng(4)
    hashes = [r.integers(0, 2**64, int(n), dtype=np.uint64).view(np.int64).tolist() for n in r.integers(0, 60, 80)] * 2
    sets = spark.createDataFrame([(h,) for h in hashes], "hashes array<bigint>").repartition(5)
    flat = np.array([x for h in hashes for x in h], np.int64).view(np.uint64)
    want = np.round(1024 * np.log2(1.0 + np.bincount((flat >> np.uint64(43)).astype(int), minlength=1 << 21)))
    assert np.array_equal(op5_simhash.frequency_classes(spark, sets), want)


def test_parities_are_a_lower_bound_at_any_size():
    r = np.random.default_rng(8)
    for n in (1, 30, 400, 5000):
        a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 5 :], r.integers(0, 2**64, n // 3, dtype=np.uint64)]))
        p, q = (op5_simhash.parities(x, op5_simhash.parity_bits(len(x))) for x in (a, b))
        for octets in (min(len(p), len(q)), 32):
            bits = int(np.bitwise_count(op5_simhash.folded(p, octets) ^ op5_simhash.folded(q, octets)).sum())
            assert bits <= len(np.setxor1d(a, b))
        assert np.array_equal(op5_simhash.folded(p, 32), op5_simhash.parities(a, 256))


def check_shards(rows, n, slack=0.0):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    return by


def test_shards_balance_bytes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = op3_sharding.shards(spark, docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    check_shards(rows, 16)
    size = collections.Counter()
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        size[r.shard] += r.size
    mean = sum(size.values()) / 16
    assert set(size) == set(range(16)) and max(size.values()) - mean <= max(r.size for r in rows)


def test_shards_of_awkward_rows(spark):
    docs = table(spark, clash=("part", "nth", "start", "arc", "pos", "size", "k"))
    rows = op3_sharding.shards(spark, docs).collect()
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.size) for r in rows) == sorted(((x[0] is not None, x[0] or 0), len((x[1] or "").encode()) + 1) for x in awkward())
    check_shards(rows, 16)
    assert op3_sharding.shards(spark, empty(spark)).count() == 0


def test_shards_equal_a_walk_byte_by_byte(spark):
    rows = [(i, prose(i % 37, 1 + random.Random(i).randint(0, 12)), "en", "s0", 0) for i in range(150)] + [(900 + i, "hot copy", "en", "s0", 0) for i in range(60)]
    at, owner = op3_sharding.ring(5, 8)
    hashed = table(spark, rows).select("doc_id", "text", F.xxhash64("text").alias("pos")).collect()
    order = sorted((r.pos, r.doc_id, len(r.text.encode()) + 1) for r in hashed)
    late = [x for x in order if x[0] > at[-1]]
    order = late + [x for x in order if x[0] <= at[-1]]  # what lies past the last point belongs to the first
    total = sum(x[2] for x in order)
    room = [-(-int(total * 1.001 + 1) // 5)] * 5
    own = collections.defaultdict(list)
    for pos, doc_id, size in order:
        own[0 if pos > at[-1] else int(np.searchsorted(at, pos))] += [(doc_id, b) for b in range(size)]
    home, queue = {}, collections.deque()
    for turn in range(2):
        for i, s in enumerate(owner.tolist()):
            if turn == 0:
                for byte in own[i]:
                    if room[s]:
                        home[byte], room[s] = s, room[s] - 1
                    else:
                        queue.append(byte)
            while queue and room[s]:
                home[queue.popleft()], room[s] = s, room[s] - 1
    got = {r.doc_id: r.shard for r in op3_sharding.shards(spark, table(spark, rows), 5, 8).collect()}
    assert got == {doc_id: home[doc_id, size // 2] for _, doc_id, size in order}


def test_walk_gives_every_byte_once():
    rng = np.random.default_rng(5)
    for _ in range(30):
        _, owner = op3_sharding.ring(4, 8)
        loads = rng.integers(0, 50, len(owner)) * rng.integers(0, 2, len(owner))
        loads[3] += int(rng.integers(0, 2000))
        cap = -(-int(loads.sum() * 1.01 + 1) // 4)
        taken = op3_sharding.walk(loads, owner, cap)
        flat = [x for a, b, _ in taken for x in (a, b)]
        assert flat == sorted(flat) and sum(b - a for a, b, _ in taken) == loads.sum()
        per = collections.Counter()
        for a, b, s in taken:
            per[s] += b - a
        assert max(per.values(), default=0) <= cap


def test_more_slack_moves_less():
    _, owner = op3_sharding.ring(16, 128)
    loads = np.random.default_rng(2).integers(1, 1000, len(owner))
    ends = np.cumsum(loads)

    def at_home(slack):
        taken = op3_sharding.walk(loads, owner, int(loads.sum() * (1 + slack) / 16) + 1)
        return sum(b - a for a, b, s in taken if owner[np.searchsorted(ends, a, side="right")] == s)

    assert at_home(0.5) == loads.sum() > at_home(0.001) > 0.8 * loads.sum()


# ---- mixing ----


def test_targets():
    t = op6_mixing.targets([("b", 100), ("a", 100), (None, 100), ("c", 100)])
    assert list(map(t.get, ("a", "b", "c", None))) == pytest.approx([400 * w / 13 for w in (5, 2, 1, 5)])
    t = op6_mixing.targets([("a", 10), ("b", 990)])
    assert t["a"] == 30 and t["b"] == 970
    assert op6_mixing.targets([]) == {} and op6_mixing.targets([("a", 0)]) == {"a": 0.0}
    t = op6_mixing.targets([("a", 1), ("b", 1), ("c", 10_000)])
    assert t["a"] == 3 and t["b"] == 3 and sum(t.values()) == pytest.approx(10_002)


def test_mix_meets_targets_and_repeats(spark):
    rows = [(i, prose(i, 20 + i % 90), "en", random.Random(i).choice(["a", "b", "c", None]), 0) for i in range(1500)]
    docs = table(spark, rows, clash=("copies", "part", "nth", "target"))
    got = op6_mixing.mix(spark, docs).collect()
    again = op6_mixing.mix(spark, docs.repartition(7)).collect()
    assert sorted(((r.doc_id, r.copies) for r in got)) == sorted(((r.doc_id, r.copies) for r in again))
    words, target, rate = collections.Counter(), {}, {}
    for r in got:
        assert r.size == len(rows[r.doc_id][1].split()) and 0 <= r.copies <= 3
        words[r.source] += r.copies * r.size
        target[r.source], rate[r.source] = r.target, r.target / r.source_size
    for s in target:
        assert words[s] == pytest.approx(target[s], rel=0.01)
        assert all(r.copies in (int(rate[s]), int(rate[s]) + 1) for r in got if r.source == s)


def test_mix_equals_a_walk_over_sorted_rows(spark):
    rows = [(i, prose(i, random.Random(i).choice([0, 3, 30, 30, 400])), "en", random.Random(-i).choice(["a", "b", None]), 0) for i in range(240)]
    got = {r.doc_id: r.copies for r in op6_mixing.mix(spark, table(spark, rows).repartition(5)).collect()}
    size = {r[0]: len(r[1].split()) for r in rows}
    own = collections.defaultdict(list)
    for r in rows:
        own[r[3]].append(r[0])
    target = op6_mixing.targets([(s, sum(size[i] for i in ids)) for s, ids in own.items()])
    for s, ids in own.items():
        ids.sort(key=lambda i: (size[i], i))
        rate, at = target[s] / sum(size[i] for i in ids), op6_mixing.offset(6, s)
        taken = 0
        for k, i in enumerate(ids[::2] + ids[1::2][::-1]):
            copies = int(rate * (k + 1) + at) - int(rate * k + at)
            assert got[i] == copies
            taken += copies * size[i]
        assert abs(taken - target[s]) < 2 * max(size[i] for i in ids)


def test_rows_that_differ_in_any_column_are_mixed_on_their_own(spark):
    rows = [(1, prose(1, 40), lang, "a", n) for lang in ("en", "de", None) for n in (40, None)] * 2 + [(2, prose(2, 40), "a", "a", 0)]
    out = op6_mixing.mixed(spark, table(spark, rows)).collect()
    assert collections.Counter(map(tuple, out)) == collections.Counter(rows)  # one source takes each row once


def test_mixed_rows(spark):
    docs = table(spark, clash=("_k", "_id", "copies"))
    out = op6_mixing.mixed(spark, docs)
    assert out.columns == docs.columns
    per = {}
    for r in op6_mixing.mix(spark, docs).collect():
        per[r.doc_id] = per.get(r.doc_id, 0) + r.copies
    got = collections.Counter(r.doc_id for r in out.collect())
    assert dict(got) == {k: v for k, v in per.items() if v}
    assert op6_mixing.mixed(spark, empty(spark)).count() == 0 and op6_mixing.mix(spark, empty(spark)).count() == 0


# ---- quality ----


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    hit = {j for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_measures():
    r = random.Random(4)
    texts = [x[1] for x in awkward()] + ["".join(r.choice("ab #|\n\t\x0b é") for _ in range(r.randint(0, 120))) for _ in range(300)] + ["a b c a b c", "a a a a", "a\na\n a\n\n\n", "x y z\nx y z"]
    for t in texts:
        assert op7_quality.measures(t) == plain_measures(t), t and t[:50]


def test_fences_reject_the_odd_and_keep_the_rest(spark):
    rows = [(1000 + i, "\n".join(prose(i * 7 + j, 30) for j in range(4)), "en", f"s{i % 2}", 0) for i in range(200)]
    junk = [(500 + i, " ".join(w + "###" for w in prose(i, 120).split()), "en", "s0", 0) for i in range(5)]
    docs = table(spark, rows + junk + awkward(), clash=("n_words", "kept", "row", "base_failed", "_lang"))
    judged = {r.doc_id: r for r in op7_quality.judged(spark, docs).collect()}
    assert all(judged[1000 + i].kept for i in range(200)) and not any(judged[500 + i].kept for i in range(5))
    assert all(judged[i].base_failed for i in (100, 101, 102, 107))
    out = op7_quality.passing(spark, docs)
    assert out.columns == docs.columns
    assert out.count() == op7_quality.judged(spark, docs).where("kept").count()
    assert op7_quality.judged(spark, empty(spark)).count() == 0 and op7_quality.passing(spark, empty(spark)).count() == 0


# ---- decontamination ----


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_hits(text, items):
    words = plain_words(text)
    hit, found = set(), set()
    for item, body in items:
        w = plain_words(body)
        size = min(len(w), 10)
        if not size:
            continue
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add("" if item is None else str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("most", [1 << 24, 64])
def test_contamination_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(bloom, "LEAST_BITS", min(most, bloom.LEAST_BITS))
    monkeypatch.setattr(bloom, "MOST_BITS", most)  # a full filter passes nearly all
    items = [(i, prose(70 + i, 14)) for i in range(6)] + [(20, prose(70, 14)), (21, "Omega77 Only"), (22, "single99"), (23, "!!"), (24, None), (None, prose(90, 12)), (25, "xx yy zz " * 5)]
    rows = awkward()
    for i in range(6):
        p = prose(70 + i, 14)
        rows += [(400 + i, f"{prose(i, 30)} {p.upper()}, {prose(i + 9, 20)}", "en", "s", 0), (420 + i, " ".join(p.split()[:9]), "en", "s", 0), (440 + i, ", ".join(p.split()[2:]), "en", "s", 0)]
    rows += [(460, "a omega77 ONLY b single99 c", "en", "s", 0), (461, "xx yy zz " * 9, "en", "s", 0), (462, prose(90, 12) + " " + prose(71, 14), "en", "s", 0)]
    docs = table(spark, rows, clash=("words", "key", "key2", "hits", "win", "n_words"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.n_words): (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in op8_decontaminate.contamination(spark, docs, bench).collect()}
    for r in rows:
        want = plain_hits(r[1], items)
        assert got[r[0], want[0]] == want, r[0]
    kept = op8_decontaminate.without_benchmark(spark, docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(plain_hits(r[1], items)[1] == 0 for r in rows)


def test_filter_passes_every_shingle_and_few_others(spark):
    r = np.random.default_rng(5)
    grams = spark.createDataFrame([(x,) for x in r.integers(-(2**63), 2**63, 3000).tolist()], "h bigint")
    others = spark.createDataFrame([(x,) for x in r.integers(-(2**63), 2**63, 3000).tolist()], "h bigint")
    passes = bloom.hash_filter(grams)
    assert grams.where(passes(F.col("h"))).count() == 3000 and others.where(passes(F.col("h"))).count() < 150


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    docs = table(spark)
    got = op8_decontaminate.contamination(spark, docs, none)
    assert got.count() == docs.count() and got.where("contaminated").count() == 0
    assert op8_decontaminate.without_benchmark(spark, docs, none).count() == docs.count()
    assert op8_decontaminate.contamination(spark, empty(spark), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")).count() == 0
