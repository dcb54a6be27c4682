"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into blocks of 23, 23 and 15 bits (3 bits are in no
block).  The binary Golay code covers 23 bits with radius 3 and the Hamming
code covers 15 bits with radius 1, both perfectly, so the product of the three
is a covering code: every fingerprint has exactly one anchor within the radius
of every block.  Two fingerprints at distance t have a midpoint at distance at
most ceil(t/2) from both, and the midpoint's anchor lies within that much more
than the radius of either.  Replicating each fingerprint to every anchor that
is within radius plus ceil(t/2) therefore brings every pair together somewhere.
"""

from __future__ import annotations

import itertools
import math
import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.bloom import hash_filter
from strandwise.llm.components import connected_components
from strandwise.llm.storage import drop_table, write_table
from strandwise.llm.tokenize import bounded_batches
from strandwise.llm.workers import lean

SEED = 42
#: Generator polynomial x^11+x^9+x^7+x^6+x^5+x+1 of the binary Golay code, x^4+x+1 of the Hamming code.
GOLAY, HAMMING = 0b101011100011, 0b10011
#: (first bit, bits, polynomial) of each block.
BLOCKS = ((0, 23, GOLAY), (23, 23, GOLAY), (46, 15, HAMMING))
PAIRWISE = 2048


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of the word shingles of a text in order, repeats included; fewer words are one shingle, none has none."""
    words = text.encode().lower().split() if text else []
    flat = b" ".join(words)
    at = list(itertools.accumulate((len(w) + 1 for w in words), initial=0))
    ends = at[shingle:] if len(words) > shingle else at[-1:] if words else []
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[a : b - 1], SEED) for a, b in zip(at, ends)), np.uint64, len(ends))


def simhash(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint of the hashes: a bit is 1 if set in over half of them; none gives zero."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):  # bounded memory for very long texts
        octets = hashes[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int) -> int:
    """The 64-bit fingerprint of one text as an unsigned number; no word gives zero."""
    return simhash(shingle_hashes(text, shingle))


def fingerprints(spark: SparkSession, docs: DataFrame, shingle: int) -> DataFrame:
    """``(doc_id, fp)`` of ``docs(doc_id, text)``, ``fp`` as a signed bigint."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    bounded_batches(spark)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def _syndromes(values: np.ndarray, bits: int, poly: int) -> np.ndarray:
    """Remainders of the values, read as polynomials over GF(2), by the code's generator."""
    degree = poly.bit_length() - 1
    rest = values.copy()
    for k in range(bits - 1, degree - 1, -1):
        rest ^= ((rest >> np.uint64(k)) & np.uint64(1)) * np.uint64(poly << (k - degree))
    return rest


@lru_cache(maxsize=8)
def _flips(bits: int, poly: int, extra: int) -> list[list[tuple[int, int]]]:
    """For each syndrome the ``(flips beyond the radius, pattern)`` that lead to a code word within radius + extra."""
    radius = {23: 3, 15: 1}[bits]
    table: list[list[tuple[int, int]]] = [[] for _ in range(1 << (poly.bit_length() - 1))]
    for weight in range(radius + extra + 1):
        patterns = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(bits), weight)], np.uint64)
        for s, p in zip(_syndromes(patterns, bits, poly).tolist(), patterns.tolist(), strict=True):
            table[s].append((max(0, weight - radius), p))
    return table


def anchors(fps: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, anchor)`` of every anchor within the radii plus ``extra`` flips in all blocks together."""
    rows = np.arange(len(fps), dtype=np.int64)
    keys = np.zeros(len(fps), np.uint64)
    used = np.zeros(len(fps), np.int64)
    for first, bits, poly in BLOCKS:
        part = (fps >> np.uint64(first)) & np.uint64((1 << bits) - 1)
        table = _flips(bits, poly, extra)
        sizes = np.array([len(x) for x in table])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        beyond = np.array([w for x in table for w, _ in x], np.int64)
        pattern = np.array([p for x in table for _, p in x], np.uint64)
        syndrome = _syndromes(part, bits, poly).astype(np.int64)[rows]
        n = sizes[syndrome]
        again = np.repeat(np.arange(len(rows)), n)
        pick = starts[syndrome][again] + np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
        total = used[again] + beyond[pick]
        keep = total <= extra
        again, pick, used = again[keep], pick[keep], total[keep]
        rows = rows[again]
        # a code word is divisible by its polynomial; the key keeps its high bits, which determine it
        word = (part[rows] ^ pattern[pick]) >> np.uint64(poly.bit_length() - 1)
        keys = (keys[again] << np.uint64(bits - poly.bit_length() + 1)) | word
    return rows, keys


def _settle(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest reachable index of each of n nodes with links i-j."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]  # both are roots, and the larger is hung below the smaller
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def local_links(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected at ``bits`` or fewer differing bits, at most one a fingerprint.

    Up to PAIRWISE fingerprints are compared directly.  Beyond that and for two
    bits, fingerprints are linked through the words they share within
    one flip, which costs 65 words each; for other bits all are compared row by row.
    """
    n = len(fps)
    found_i, found_j = [], []
    label = np.arange(n)
    if n <= PAIRWISE or bits != 2:
        for a in range(n - 1):
            near = np.flatnonzero(np.bitwise_count(fps[a + 1 :] ^ fps[a]) <= bits) + a + 1
            if len(near):
                found_i.append(np.full(len(near), a))
                found_j.append(near)
            if sum(map(len, found_j)) > 1 << 20:
                label = _settle(n, np.concatenate([*found_i, label]), np.concatenate([*found_j, np.arange(n)]))
                found_i, found_j = [], []
        if found_i:
            label = _settle(n, np.concatenate([*found_i, label]), np.concatenate([*found_j, np.arange(n)]))
    else:
        masks = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
        passes = 1 + n * len(masks) // (1 << 22)
        for p in range(passes):  # each pass takes the words of one residue, which bounds memory
            words, owner = [], []
            for m in masks:
                w = fps ^ m
                mine = np.flatnonzero((w * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(passes) == p)
                words.append(w[mine])
                owner.append(mine)
            words, owner = np.concatenate(words), np.concatenate(owner)
            order = np.argsort(words, kind="stable")
            words, owner = words[order], owner[order]
            same = np.flatnonzero(words[1:] == words[:-1])
            label = _settle(n, np.concatenate([owner[same], label]), np.concatenate([owner[same + 1], np.arange(n)]))
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _group_links(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys; rows are sorted by key."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    left, right = [], []
    small = 16
    for shift in range(1, small):  # pairs of all small groups at once
        i = np.flatnonzero(keys[shift:] == keys[:-shift])
        if not len(i):
            break
        i = i[np.repeat(sizes <= small, sizes)[i]]
        i = i[np.bitwise_count(fps[i] ^ fps[i + shift]) <= bits]
        left.append(i)
        right.append(i + shift)
    if left:
        label = _settle(len(keys), np.concatenate(left), np.concatenate(right))
        moved = np.flatnonzero(label != np.arange(len(keys)))
        left, right = [moved], [label[moved]]
    for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        i, j = local_links(fps[s : s + n], bits)
        left.append(s + i)
        right.append(s + j)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return fps[np.concatenate(left)].view(np.int64), fps[np.concatenate(right)].view(np.int64)


def near_links(reps: DataFrame, bits: int) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``reps(fp)`` that keep every connection at ``bits``.

    The links of an anchor connect what is connected there with at most one
    link a fingerprint, so a dense group of m near copies makes O(m) rows.
    """
    extra = -(-bits // 2)

    def replicate(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fps), 20_000):
                part = fps[i : i + 20_000]
                rows, keys = anchors(part, extra)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(part[rows].view(np.int64))], ["anchor", "fp"])

    def compare(batches):
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def links(keys, fps):
            a, b = _group_links(keys, fps.view(np.uint64), bits)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held_k = np.concatenate([held_k, batch.column(0).to_numpy()])
            held_f = np.concatenate([held_f, batch.column(1).to_numpy()])
            cut = int(np.searchsorted(held_k, held_k[-1]))  # the last anchor may go on in the next batch
            if cut:
                yield links(held_k[:cut], held_f[:cut])
                held_k, held_f = held_k[cut:], held_f[cut:]
        if len(held_k):
            yield links(held_k, held_f)

    at = reps.select("fp").mapInArrow(replicate, "anchor bigint, fp bigint")
    return at.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(compare, "a bigint, b bigint")


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 5, bits: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)`` of ``docs(doc_id, text)``.

    ``component_id`` is the smallest ``doc_id`` that links at ``bits`` or fewer
    differing bits reach, the row's own included; nulls are never smallest, so
    it is null only where every reachable ``doc_id`` is.  A null or blank text
    has fingerprint zero and is linked like any other; repeated rows are kept;
    other columns are ignored; an empty table gives no rows.
    """
    fps = write_table(spark, fingerprints(spark, docs, shingle), "fingerprints")
    reps = write_table(spark, fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    labels = connected_components(spark, near_links(reps, bits))
    linked = labels.join(reps.withColumnRenamed("fp", "node"), "node")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    found = labels.join(least, "root").select(F.col("node").alias("fp"), "least")
    classes = reps.join(found, "fp", "left").select("fp", F.when(F.col("least").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"))
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


# ---- a stated similarity ---------------------------------------------------------------------------------------

WIDE_WORDS = 4
#: Counters of the sketch that orders shingles by their frequency, and counters in a row of it.
COUNTERS, COUNTER_BLOCK = 1 << 21, 1 << 16
#: Pairs held before they are passed on.
HELD_PAIRS = 1 << 20
#: Rows before it at an anchor that a row is compared with when only the nearest is wanted.
NEIGHBOURS = 512


def as_set(hashes: np.ndarray) -> np.ndarray:
    """The distinct hashes in order; a text without words has the hash of the empty one."""
    return np.unique(hashes) if len(hashes) else np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of the word shingles of a text, in order; a text of fewer words is one shingle."""
    return as_set(shingle_hashes(text, shingle))


def parities(hashes: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` (a power of two) bits, packed: the parity of the number of hashes in each of as many buckets.

    A hash that one of two sets lacks flips one bit, so two sets differ in at
    least as many hashes as their parities differ in bits.  A parity of more
    bits gives one of fewer by :func:`folded`.
    """
    buckets = (hashes & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(buckets, minlength=bits) & 1).astype(np.uint8), bitorder="little")


def folded(packed: np.ndarray, octets: int) -> np.ndarray:
    """A packed parity as one of fewer octets."""
    while len(packed) > octets:
        packed = packed[: len(packed) // 2] ^ packed[len(packed) // 2 :]
    return packed


def parity_bits(size: int) -> int:
    """Bits of the parity of a set: four a hash or more, so that it tells sets of any size apart."""
    return max(64 * WIDE_WORDS, 1 << (4 * size - 1).bit_length())


def least_common(both: np.ndarray, similarity: float) -> np.ndarray:
    """The least common shingles of two sets that similar, from the sum of their sizes."""
    return np.ceil(both * (similarity / (1 + similarity)) - 1e-9).astype(np.int64)


def counter_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def prefix_of(hashes: np.ndarray, rarity: np.ndarray, similarity: float) -> np.ndarray:
    """The first hashes by (frequency class of their counter, hash): two sets that similar share one of these.

    Any order of all hashes is right; one that begins with rare hashes gives few chance meetings.
    """
    n = len(hashes)
    return hashes[np.lexsort((hashes, rarity[counter_of(hashes)]))][: n - math.ceil(similarity * n - 1e-9) + 1]


def frequency_classes(spark: SparkSession, sets: DataFrame) -> np.ndarray:
    """A class for each counter of a sketch of all ``sets(hashes)``, higher for more frequent hashes.

    Every hash of every set is counted; counters of all tasks are summed block
    by block, and the driver gets two bytes a counter whatever the input.
    """

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            total += np.bincount(counter_of(batch.column(0).flatten().to_numpy().view(np.uint64)), minlength=COUNTERS)
        counts = pa.array(total)
        blocks = np.arange(0, COUNTERS + 1, COUNTER_BLOCK, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks) - 1)), pa.ListArray.from_arrays(pa.array(blocks), counts)], ["block", "counts"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[block] = sums.get(block, 0) + counts.values.to_numpy()
        classes = [np.round(1024 * np.log2(1.0 + x)).astype("<u2").tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(classes, pa.binary())], ["block", "classes"])

    partial = sets.select("hashes").mapInArrow(lean(count), "block bigint, counts array<bigint>")
    found = partial.repartition(COUNTERS // COUNTER_BLOCK, "block").mapInArrow(lean(merge), "block bigint, classes binary").collect()
    return np.frombuffer(b"".join(bytes(r.classes) for r in sorted(found)), "<u2") if found else np.zeros(COUNTERS, "<u2")


class _Group:
    """Rows sorted by anchor and size, of which those with one anchor may be pairs."""

    def __init__(self, cols: list[np.ndarray], similarity: float):
        self.keys, self.nodes, self.sizes, self.places, self.roots = cols[:5]
        self.wide = np.stack(cols[5:], 1).view(np.uint64)
        self.similarity = similarity

    def possible(self, i, j) -> tuple[np.ndarray, np.ndarray]:
        """Whether two rows may be that similar, and the differing bits of their parities; never wrong about a pair that is.

        What they share lies from the places of the anchor on where the anchor
        is their first common hash, and a pair is found there at the latest.
        """
        both = self.sizes[i] + self.sizes[j]
        least = least_common(both, self.similarity)
        bits = np.bitwise_count(self.wide[i] ^ self.wide[j]).sum(1).astype(np.int64)
        left = np.minimum(self.sizes[i] - self.places[i], self.sizes[j] - self.places[j])
        return (left >= least) & (bits <= both - 2 * least) & (self.roots[i] != self.roots[j]), bits

    def shifted(self, most: int):
        """``i, j, bits`` of every possible pair of rows at most ``most`` apart."""
        for shift in range(1, most + 1):
            i = np.flatnonzero(self.keys[shift:] == self.keys[:-shift])
            if not len(i):
                return
            ok, bits = self.possible(i, i + shift)
            yield i[ok], i[ok] + shift, bits[ok]

    def runs(self) -> list[tuple[int, int]]:
        """First row and number of rows of each anchor."""
        starts = np.flatnonzero(np.concatenate([[True], self.keys[1:] != self.keys[:-1]]))
        return list(zip(starts.tolist(), np.diff(np.concatenate([starts, [len(self.keys)]])).tolist(), strict=True))

    def apart(self):
        """``i, j`` of every possible pair with different roots."""
        for s, n in self.runs():
            order = s + np.argsort(self.roots[s : s + n], kind="stable")
            roots = self.roots[order]
            for a in range(n - 1):
                # rows of the same root are neighbours here, so none of them is looked at
                j = order[np.searchsorted(roots, roots[a], side="right") :]
                if len(j):
                    i = np.full(len(j), order[a])
                    ok, _ = self.possible(i, j)
                    yield i[ok], j[ok]

    def pairs(self, i, j) -> list[np.ndarray]:
        return [np.minimum(self.nodes[i], self.nodes[j]), np.maximum(self.nodes[i], self.nodes[j])]

    def nearest(self):
        """``anchor, a, b`` of each row and the nearest possible one of those just before it, and the anchors where more may be.

        The former have no anchor, the latter no pair.
        """
        best = np.full(len(self.keys), np.iinfo(np.int64).max)
        more = np.zeros(len(self.keys), bool)
        partner = np.full(len(self.keys), -1)
        for i, j, bits in self.shifted(NEIGHBOURS):  # no j twice in one yield
            more[j[partner[j] >= 0]] = True
            nearer = bits < best[j]
            best[j[nearer]], partner[j[nearer]] = bits[nearer], i[nearer]
        j = np.flatnonzero(partner >= 0)
        yield [pa.nulls(len(j), pa.int64()), *map(pa.array, self.pairs(partner[j], j))]
        crowded = np.zeros(len(self.keys), bool)
        crowded[NEIGHBOURS + 1 :] = self.keys[NEIGHBOURS + 1 :] == self.keys[: -NEIGHBOURS - 1]
        anchors = np.unique(self.keys[more | crowded])
        yield [pa.array(anchors), pa.nulls(len(anchors), pa.int64()), pa.nulls(len(anchors), pa.int64())]

    def rest(self):
        """``anchor, a, b`` of every possible pair that is still apart, without the anchor."""
        held_i, held_j, n = [], [], 0

        def flush():
            pairs = np.unique(np.stack(self.pairs(np.concatenate(held_i), np.concatenate(held_j)), 1), axis=0)
            return [pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())]

        for i, j in self.apart():
            held_i.append(i)
            held_j.append(j)
            n += len(i)
            if n >= HELD_PAIRS:
                yield flush()
                held_i, held_j, n = [], [], 0
        if n:
            yield flush()


def _in_runs(found: Callable) -> Callable:
    """A function of batches sorted by their first column that hands ``found`` whole runs of it, as arrays."""

    def run(batches):
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            end = int(np.searchsorted(held[0], held[0][-1]))
            if end:
                yield from found([c[:end] for c in held])
                held = [c[end:] for c in held]
        if held is not None:
            yield from found(held)

    return run


def _covering_pairs(spark: SparkSession, nodes: DataFrame, bits: int) -> DataFrame:
    """Pairs ``(a, b)``, a first, that connect the ``nodes(node, fp)`` whose fingerprints link at ``bits``.

    A node may have several fingerprints, as texts of one set repeat its
    shingles differently.  Nodes of one fingerprint are paired with the first of them, and the first
    ones as :func:`near_links` links their fingerprints, so a group of m nodes
    makes O(m) pairs.
    """
    own = nodes.select("node", "fp").distinct()
    reps = write_table(spark, own.groupBy("fp").agg(F.min("node").alias("rep")), "distinct-fingerprints")
    rep = lambda c, r: reps.select(F.col("fp").alias(c), F.col("rep").alias(r))
    near = near_links(reps, bits).distinct().join(rep("a", "ra"), "a").join(rep("b", "rb"), "b").where("ra <> rb")
    equal = own.join(reps, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    pairs = write_table(spark, near.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).union(equal).distinct(), "covering-pairs")
    drop_table(spark, reps)
    return pairs


def _shared_anchors(spark: SparkSession, prefixes: DataFrame) -> DataFrame:
    """``(anchor, node, size, place)`` of ``prefixes(prefix, node, size)`` where an anchor has two nodes or more."""
    columns, schema = ["anchor", "node", "size", "place"], "anchor bigint, node bigint, size int, place int"

    def replicate(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                prefix, node, size = batch.slice(i, 1000).columns
                counts = prefix.value_lengths().to_numpy()
                again = np.repeat(np.arange(len(counts)), counts)
                place = np.arange(len(again)) - np.repeat(np.cumsum(counts) - counts, counts)
                yield pa.RecordBatch.from_arrays([prefix.flatten(), node.take(pa.array(again)), size.take(pa.array(again)), pa.array(place.astype(np.int32))], columns)

    def shared(batches):
        last: pa.RecordBatch | None = None  # a row that waits for the next one's anchor
        taken = None  # the anchor of the row before it
        for batch in batches:
            if last is not None:
                batch = pa.concat_batches([last, batch])
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            same = keys[1:] == keys[:-1]
            keep = np.concatenate([[keys[0] == taken], same])
            keep[:-1] |= same
            last, taken = batch.slice(batch.num_rows - 1), keys[-2] if len(keys) > 1 else taken
            keep[-1] = False
            yield batch.filter(pa.array(keep))
        if last is not None and taken == last.column(0)[0].as_py():
            yield last

    at = prefixes.select("prefix", "node", "size").mapInArrow(lean(replicate), schema)
    return write_table(spark, at.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lean(shared), schema), "shared-anchors")


def _possible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs(a, b)`` that parities in proportion to their sets do not rule out."""

    def side(c: str, s: str) -> DataFrame:
        return sketches.select(F.col("node").alias(c), F.col("size").alias(f"n{s}"), F.col("parity").alias(f"p{s}"))

    def run(batches):
        for batch in batches:
            both = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            most = both - 2 * least_common(both, similarity)
            bits = []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                octets = min(len(x), len(y))
                bits.append(int(np.bitwise_count(folded(x, octets) ^ folded(y, octets)).sum()))
            yield batch.select([0, 1]).filter(pa.array(np.array(bits, np.int64) <= most))

    return pairs.join(side("a", "a"), "a").join(side("b", "b"), "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(lean(run), "a bigint, b bigint")


def _shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``(node, hashes)``: the shingles of one text for each of ``wanted(key, node)``; other texts are not moved."""

    def run(batches):
        for batch in batches:
            out = [shingle_set(text, shingle).view(np.int64) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["node", "hashes"])

    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("key"), text.alias("text")).where(hash_filter(wanted.select("key"))(F.col("key")))
    return texts.join(wanted, "key").dropDuplicates(["node"]).select("node", "text").mapInArrow(lean(run), "node bigint, hashes array<bigint>")


def _alike(spark: SparkSession, docs: DataFrame, nodes: DataFrame, pairs: DataFrame, sketches: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The ``pairs(a, b)`` whose sets of shingles are that similar."""
    pairs = write_table(spark, _possible(pairs, sketches, similarity), "possible-pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = write_table(spark, nodes.join(ends, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key")), "wanted-texts")
    sets = write_table(spark, _shingle_sets(docs, wanted, shingle), "wanted-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
    common = F.size(F.array_intersect("ha", "hb"))
    found = write_table(spark, both.where(common + 1e-9 >= similarity * (F.size("ha") + F.size("hb") - common)).select("a", "b"), "alike")
    for table in (pairs, wanted, sets):
        drop_table(spark, table)
    return found


def similar_groups(spark: SparkSession, docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bits: int = 2) -> DataFrame:
    """``(doc_id, key, node)`` of ``docs(doc_id, text)``: rows with the same ``node`` are near-duplicates.

    Two texts are linked if the Jaccard similarity of their sets of word
    shingles is ``similarity`` or more.  Their fingerprints meet at the anchors
    of the covering code and are compared there, and what links at ``bits`` or
    fewer differing bits are candidates.  A pair that similar may differ in
    more bits than any covering of useful size reaches, so an exact way follows
    for the rest: of two such sets of any sizes the prefixes (:func:`prefix_of`)
    share a hash, a text is sent to each hash of its prefix, and texts that meet
    are candidates unless the sizes, the places or the parities rule them out;
    none of these refuses a pair that is that similar.  The sets themselves
    decide candidates: first those of the covering and the nearest one of each
    row at each hash, which settle dense groups with few pairs, and then every
    candidate whose ends are still apart.  ``key`` is a hash of the
    text.  Blank texts are one group; repeated rows share a group; a null
    ``doc_id`` is a value like any other; a text of any length is one row; an
    empty table gives no rows; other columns are ignored.
    """
    names = [f"w{k}" for k in range(WIDE_WORDS)]
    bounded_batches(spark)

    def hashed(batches):
        for batch in batches:
            found, fps = [], []
            for text in batch.column(2).to_pylist():
                hashes = shingle_hashes(text, shingle)
                fps.append(simhash(hashes))
                found.append(as_set(hashes))
            nodes = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in found], np.uint64).view(np.int64)
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))
            prints = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes), prints, pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "key", "node", "fp", "hashes"])

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")
    sets = write_table(spark, own.mapInArrow(lean(hashed), "doc_id bigint, key bigint, node bigint, fp bigint, hashes array<bigint>"), "shingle-sets")
    rarity = frequency_classes(spark, sets)

    def prints(batches):
        for batch in batches:
            found = [h.values.to_numpy().view(np.uint64) for h in batch.column(1)]
            packed = [parities(h, parity_bits(len(h))) for h in found]
            wide = np.array([folded(p, 8 * WIDE_WORDS) for p in packed], np.uint8).reshape(-1, 8 * WIDE_WORDS).view("<i8")
            prefix = pa.array([prefix_of(h, rarity, similarity).view(np.int64) for h in found], pa.list_(pa.int64()))
            cols = [pa.array([len(h) for h in found], pa.int32()), pa.array([p.tobytes() for p in packed], pa.binary()), prefix, *(pa.array(wide[:, k].copy()) for k in range(WIDE_WORDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["node", "size", "parity", "prefix", *names])

    schema = f"node bigint, size int, parity binary, prefix array<bigint>, {', '.join(f'{w} bigint' for w in names)}"
    distinct = write_table(spark, sets.select("node", "hashes").mapInArrow(lean(prints), schema).dropDuplicates(["node"]), "sketches")
    nodes = write_table(spark, sets.select("doc_id", "key", "node", "fp"), "nodes")
    drop_table(spark, sets)  # few texts are looked at again
    covered = _covering_pairs(spark, nodes, bits)
    shared = _shared_anchors(spark, distinct)

    def met(at, take):
        at = at.select("anchor", "node", "size", "place", "root", *names).repartition("anchor").sortWithinPartitions("anchor", "size", "node")
        batches = _in_runs(lambda cols: (pa.RecordBatch.from_arrays(x, ["anchor", "a", "b"]) for x in take(_Group(cols, similarity))))
        return at.mapInArrow(lean(batches), "anchor bigint, a bigint, b bigint").distinct()

    wide = distinct.select("node", *names)
    found = write_table(spark, met(shared.join(wide, "node").withColumn("root", F.col("node")), _Group.nearest), "near-pairs")
    first = covered.union(found.where("a is not null").select("a", "b")).distinct()
    linked = connected_components(spark, _alike(spark, docs, nodes, first, distinct, shingle, similarity))

    # what was not offered and is still apart; anchors where each row had one candidate are done
    crowded = found.where("anchor is not null").select("anchor").distinct()
    again = shared.join(crowded, "anchor", "left_semi").join(wide, "node").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    second = write_table(spark, met(again, _Group.rest).select("a", "b").join(first, ["a", "b"], "left_anti"), "other-pairs")
    drop_table(spark, shared)
    alike = _alike(spark, docs, nodes, second, distinct, shingle, similarity)
    root = lambda c, r: linked.select(F.col("node").alias(c), F.col("root").alias(r))
    apart = alike.join(root("a", "ra"), "a", "left").join(root("b", "rb"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    more = connected_components(spark, apart)
    own_root = nodes.join(linked, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("node"))
    groups = write_table(spark, own_root.join(more, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("node")), "groups")
    for table in (nodes, distinct, covered, found, second, alike):
        drop_table(spark, table)
    return groups


def keep_one(spark: SparkSession, docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bits: int = 2) -> DataFrame:
    """The row of ``docs(doc_id, text, ..)`` with the smallest ``doc_id`` of each group, nulls last; one of repeated rows.

    Rows that agree in ``doc_id`` and text are repeated rows whatever else they
    hold; blank and null texts are one group; texts of any length are compared
    whole; columns may have any names; an empty table gives no rows.  Only
    texts that others are equal or similar to are moved.
    """
    groups = similar_groups(spark, docs, shingle, similarity, bits)
    own = groups.select(F.col("doc_id").isNull().alias("_no"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("key").alias("_key"), "node")
    same = write_table(spark, own.groupBy("_no", "_id", "_key").agg(F.min("node").alias("node"), F.count("*").alias("n")), "rows")
    first = same.groupBy("node").agg(F.min(F.struct("_no", "_id", "_key")).alias("o"))
    chosen = write_table(spark, first.select(F.col("o._no").alias("_no"), F.col("o._id").alias("_id"), F.col("o._key").alias("_key")), "chosen")
    repeated = same.where("n > 1").select("_key")
    touched = same.join(chosen, ["_no", "_id", "_key"], "left_anti").select("_key").union(repeated)
    doc_id = F.col("doc_id").cast("bigint")
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), doc_id.isNull().alias("_no"), F.coalesce(doc_id, F.lit(0)).alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_key"))
    maybe = hash_filter(touched)(F.col("_key"))
    rest = keyed.where(maybe).join(chosen, ["_no", "_id", "_key"]).dropDuplicates(["_no", "_id", "_key"])
    return keyed.where(~maybe).select("_row").unionByName(rest.select("_row")).select("_row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    found = near_duplicates(spark, docs, shingle=3, bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_simhash": op5_simhash}
ORACLES: dict[str, str] = {}
