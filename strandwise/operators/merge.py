"""Overlapping read pairs to single reads."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from strandwise.operators.kernels import Scoring, encode, in_lanes, local, local_lanes

#: Scores, gap costs and limits of the merge.
SCORING = Scoring(a=5, b=4, o_del=2, e_del=17, o_ins=2, e_ins=17)
LEAST, MOST_MISMATCH, RIVAL = 10 * 5, 70, 0.8
DEFAULT_QUALITY = 20
SCHEMA = "pair_id bigint, code int, seq string, qual string"


def _ends(r1: str, r2: str) -> tuple[np.ndarray, np.ndarray]:
    """The first read and the second turned around, as codes."""
    b = encode(r2)[::-1]
    return encode(r1), np.where(b < 4, 3 - b, 4).astype(np.int8)


def _overlap_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each length below both reads', the score of the end of ``a`` on the start of ``b``: diagonals of their table."""
    table = np.zeros((len(b), len(a) + len(b)), np.int64)
    table[:, : len(a)] = SCORING.matrix()[b][:, a[::-1]]
    slanted = table.ravel()[: len(b) * (len(a) + len(b) - 1)].reshape(len(b), -1)
    return np.concatenate([[0], slanted.sum(0)[: max(min(len(a), len(b)) - 1, 0)]])


def merge_pair(r1: str, q1: str | None, r2: str, q2: str | None, hit: tuple | None = None) -> tuple[int, str | None, str | None]:
    """0 and the merged read, or the code of the first test that fails, 1 to 8.

    The tests in order: score, room on the left, room on the right, a rival
    second score, gaps, the end-to-end overlap, a rival overlap (tandem
    repeats), and the mismatches' qualities.  ``hit`` is their local alignment
    where it is known.
    """
    a, b = _ends(r1, r2)
    qa = np.frombuffer(q1.encode(), np.uint8).astype(int) - 33 if q1 else np.full(len(a), DEFAULT_QUALITY)
    qb = np.frombuffer(q2.encode(), np.uint8).astype(int)[::-1] - 33 if q2 else np.full(len(b), DEFAULT_QUALITY)
    score, s, e, t, u, second, _ = hit or local(b, a, SCORING)
    e, u = e + 1, u + 1
    if score < LEAST:
        return 1, None, None
    if t < s:
        return 2, None, None
    if len(a) - u > len(b) - e:
        return 3, None, None
    if second / score >= RIVAL:
        return 4, None, None
    if e - s != u - t:
        return 5, None, None
    sums = _overlap_scores(a, b)
    top = int(np.argmax(sums))
    overlap = len(a) - (t - s)
    if sums[top] < LEAST or top != overlap:
        return 6, None, None
    rest = sums.copy()
    rest[top] = -1
    other = int(np.argmax(rest))
    if other < top and rest[other] >= LEAST and (rest[other] + (top - other) * SCORING.a) / sums[top] >= RIVAL:
        return 7, None, None
    if other > top and rest[other] / sums[top] >= RIVAL:
        return 7, None, None
    x, y, p, q = a[len(a) - overlap :], b[:overlap], qa[len(a) - overlap :], qb[:overlap]
    clash = (x != y) & (x < 4) & (y < 4)
    low = np.minimum(p, q)[clash]
    if int(np.where(low >= 3, 2 * low, 1).sum()) // 2 > MOST_MISMATCH:
        return 8, None, None
    base = np.where(x == 4, y, np.where(clash & (q >= p), y, x))
    qual = np.where(x == 4, q, np.where(y == 4, p, np.where(clash, np.abs(p - q), np.maximum(p, q))))
    seq = np.concatenate([a[: len(a) - overlap], base, b[overlap:]])
    quals = np.concatenate([qa[: len(a) - overlap], qual, qb[overlap:]]) + 33
    return 0, "".join("ACGTN"[i] for i in seq), "".join(map(chr, quals))


def merge_pairs(pairs: DataFrame) -> DataFrame:
    """SCHEMA of ``pairs(pair_id, r1, q1, r2, q2)``; null qualities take the default."""

    def run(batches):
        for pdf in batches:
            pairs = list(pdf[["pair_id", "r1", "q1", "r2", "q2"]].where(pdf.notna(), None).itertuples(index=False))
            hits = in_lanes([_ends(a, b)[::-1] for _, a, _, b, _ in pairs], lambda q, t: local_lanes(q, t, SCORING))
            rows = [(i, *merge_pair(a, p, b, q, hit)) for (i, a, p, b, q), hit in zip(pairs, hits, strict=True)]
            yield pd.DataFrame(rows, columns=["pair_id", "code", "seq", "qual"])

    return pairs.select("pair_id", "r1", "q1", "r2", "q2").mapInPandas(run, SCHEMA)
