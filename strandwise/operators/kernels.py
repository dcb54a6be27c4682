"""Dynamic-programming kernels and hashes as Arrow functions.

A matrix row is one vector operation: vertical gaps come from the row above,
and horizontal gaps are a running maximum along the row, since
``max_k(H[k] + e*k) - e*j`` over earlier columns equals the gap recursion.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEG = -(1 << 28)
CODE = np.full(256, 4, np.int8)
for _i, _pair in enumerate(("Aa", "Cc", "Gg", "Tt")):
    for _ch in _pair:
        CODE[ord(_ch)] = _i


@dataclass(frozen=True)
class Scoring:
    """Match, mismatch, and gap open and extension of deletions and insertions."""

    a: int = 1
    b: int = 4
    o_del: int = 6
    e_del: int = 1
    o_ins: int = 6
    e_ins: int = 1
    zdrop: int = 100
    end_bonus: int = 5

    def matrix(self) -> np.ndarray:
        m = np.full((5, 5), -self.b, np.int32)
        np.fill_diagonal(m, self.a)
        m[4, :] = m[:, 4] = -1
        return m


def encode(seq: str) -> np.ndarray:
    return CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]


def _mix(x: np.ndarray) -> np.ndarray:
    u = np.uint64
    with np.errstate(over="ignore"):
        for add, left, right in ((True, 32, 22), (True, 13, 8), (False, 3, 15), (True, 27, 31)):
            x = x + (~(x << u(left)) if add else x << u(left))
            x = x ^ (x >> u(right))
    return x


def _hash_series(x: pd.Series) -> pd.Series:
    return pd.Series(_mix(x.to_numpy(np.int64).view(np.uint64)).astype(str))


def hash64(x: Column) -> Column:
    """A 64-bit integer mix as an unsigned decimal string."""
    return F.pandas_udf(_hash_series, T.StringType())(x.cast("bigint"))


def local(query: np.ndarray, target: np.ndarray, sc: Scoring) -> tuple[int, int, int, int, int, int, int]:
    """Best local alignment: ``score, qb, qe, tb, te, score2, te2``; ends inclusive, -1 where there is none.

    The end is the first target row with the best score and the last query
    column there; ``score2`` is the best row maximum at least ``score / a``
    rows from the end; the start comes from the reversed prefixes.
    """
    score, qe, te, rows = _sweep(query, target, sc)
    if score <= 0:
        return 0, -1, -1, -1, -1, -1, -1
    reach = -(-score // sc.a)
    best2, at2 = -1, -1
    far = np.concatenate([np.arange(0, max(te - reach, 0)), np.arange(min(te + reach + 1, len(rows)), len(rows))])
    if len(far) and rows[far].max() > 0:
        at2 = int(far[np.argmax(rows[far])])
        best2 = int(rows[at2])
    _, q_back, t_back, _ = _sweep(query[qe::-1] if qe >= 0 else query[:0], target[te::-1], sc, stop=score)
    return score, qe - q_back, qe, te - t_back, te, best2, at2


def _sweep(query: np.ndarray, target: np.ndarray, sc: Scoring, stop: int | None = None) -> tuple[int, int, int, np.ndarray]:
    n = len(query)
    profile = sc.matrix()[:, query]
    cols = np.arange(n + 1)
    h = np.zeros(n + 1, np.int32)
    gap = np.full(n + 1, NEG, np.int32)
    best, qe, te = 0, -1, -1
    rows = np.zeros(len(target), np.int32)
    for i, t in enumerate(target):
        diag = h[:-1] + profile[t]
        gap = np.maximum(gap, h - sc.o_del) - sc.e_del
        open_ = np.maximum(0, np.concatenate([[0], np.maximum(diag, gap[1:])]))
        run = np.maximum.accumulate(open_ - sc.o_ins + cols * sc.e_ins)
        side = np.concatenate([[NEG], run[:-1] - cols[1:] * sc.e_ins])
        h = np.maximum(open_, side).astype(np.int32)
        h[0] = 0
        rows[i] = top = h.max()
        if top > best:
            best, te = int(top), i
            qe = int(np.flatnonzero(h == top)[-1]) - 1
            if stop is not None and best >= stop:
                break
    return best, qe, te, rows


def extend(query: np.ndarray, target: np.ndarray, h0: int, w: int, sc: Scoring) -> tuple[int, int, int, int, int, int]:
    """Extension from a seed of score ``h0``: ``score, qle, tle, gtle, gscore, max_off``.

    Rows are targets; cells outside the band ``w`` or at zero are dead; the
    sweep ends when a row is dead or falls behind the best by more than the
    z-drop.  ``gscore`` is the best score that reaches the query's end.
    """
    n = len(query)
    profile = sc.matrix()[:, query] if n else np.zeros((5, 0), np.int32)
    cols = np.arange(n + 1)
    h = np.maximum(0, np.where(cols == 0, h0, h0 - sc.o_ins - sc.e_ins * cols)).astype(np.int32)
    gap = np.zeros(n + 1, np.int32)
    best, qle, tle, off = h0, 0, 0, 0
    gscore, gtle = -1, 0
    lo, hi = 0, n
    for i, t in enumerate(target):
        lo, hi = max(lo, i - w), min(hi, i + w + 1, n)
        if lo >= n and n:
            break
        first = max(0, h0 - sc.o_del - sc.e_del * (i + 1)) if lo == 0 else 0
        diag = np.where(h[:-1] > 0, h[:-1] + profile[t], 0)
        # a gap opens from a match only, so indels never follow each other directly
        cell = np.maximum(diag, 0)
        down = np.concatenate([[0], gap[1:]])
        open_ = np.concatenate([[first], np.maximum(cell, down[1:])])
        source = np.concatenate([[0], cell]) - sc.o_ins + cols * sc.e_ins
        run = np.maximum.accumulate(source)
        side = np.concatenate([[0], run[:-1] - cols[1:] * sc.e_ins])
        row = np.maximum(open_, np.maximum(side, 0)).astype(np.int32)
        live = (cols >= lo) & (cols <= hi)
        row[~live] = 0
        gap = np.maximum(np.maximum(gap, np.concatenate([[0], cell]) - sc.o_del) - sc.e_del, 0).astype(np.int32)
        h = row
        if lo == 0:
            h[0] = first
        top = int(row[1:].max()) if n else 0
        if hi == n and row[n] >= gscore and n and row[n] > 0:
            gscore, gtle = int(row[n]), i + 1
        if top == 0:
            break
        j = int(np.flatnonzero(row[1:] == top)[-1])
        if top > best:
            best, qle, tle = top, j + 1, i + 1
            off = max(off, abs(j - i))
        elif sc.zdrop > 0:
            di, dj = i + 1 - tle, j + 1 - qle
            slack = (di - dj) * sc.e_del if di > dj else (dj - di) * sc.e_ins
            if best - top - slack > sc.zdrop:
                break
        alive = np.flatnonzero((row > 0) | (gap > 0))
        if len(alive):
            lo, hi = int(alive[0]), min(int(alive[-1]) + 2, n)
    return best, qle, tle, gtle, gscore, off


#: Pairs that one array operation takes; more would leave the processor's cache.
LANES = 256


def in_lanes(pairs: list[tuple[np.ndarray, np.ndarray]], fn) -> list[tuple]:
    """``fn(queries, targets)`` of arrays (length, pair) for pairs of equal lengths, in the order of ``pairs``."""
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (q, t) in enumerate(pairs):
        shapes.setdefault((len(q), len(t)), []).append(i)
    out: list = [None] * len(pairs)
    for at in shapes.values():
        for k in range(0, len(at), LANES):
            lanes = at[k : k + LANES]
            found = fn(np.stack([pairs[i][0] for i in lanes], 1), np.stack([pairs[i][1] for i in lanes], 1))
            for i, x in zip(lanes, zip(*found, strict=True), strict=True):
                out[i] = x
    return out


def _profiles(queries: np.ndarray, sc: Scoring) -> np.ndarray:
    """Scores (code, length, pair) against each base; a code of 5 is beyond a query's end and matches nothing."""
    mat = np.full((5, 6), NEG, np.int32)
    mat[:, :5] = sc.matrix()
    return mat[:, queries]


def local_lanes(queries: np.ndarray, targets: np.ndarray, sc: Scoring) -> tuple[list, ...]:
    """:func:`local` of many pairs of equal lengths at once."""
    (n, lanes), m = queries.shape, len(targets)
    score, qe, te, rows = _sweep_lanes(queries, targets, sc)
    reach = -(-score // sc.a)
    at = np.arange(m)[:, None]
    far = np.where((at < np.maximum(te - reach, 0)) | (at >= np.minimum(te + reach + 1, m)), rows, 0)
    best2, at2 = (far.max(0), far.argmax(0)) if m else (np.zeros(lanes, int), np.zeros(lanes, int))
    none2 = best2 <= 0
    # the start comes from the reversed prefixes, padded where they are shorter than others
    back = lambda x, end, pad: np.where((i := end - np.arange(len(x))[:, None]) >= 0, np.take_along_axis(x, np.maximum(i, 0), 0), pad)
    _, q_back, t_back, _ = _sweep_lanes(back(queries, qe, 5), back(targets, te, 4), sc, score)
    some = score > 0
    columns = (score, qe - q_back, qe, te - t_back, te, np.where(none2, -1, best2), np.where(none2, -1, at2))
    return tuple(np.where(some, c, 0 if k == 0 else -1).tolist() for k, c in enumerate(columns))


def _sweep_lanes(queries: np.ndarray, targets: np.ndarray, sc: Scoring, stop: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    n, lanes = queries.shape
    profile, lane = _profiles(queries, sc), np.arange(lanes)
    ramp = (np.arange(n + 1, dtype=np.int32) * sc.e_ins)[:, None]
    h, gap = np.zeros((n + 1, lanes), np.int32), np.full((n + 1, lanes), NEG, np.int32)
    best, qe, te = np.zeros(lanes, np.int32), np.full(lanes, -1), np.full(lanes, -1)
    rows = np.zeros((len(targets), lanes), np.int32)
    for i, t in enumerate(targets):
        gap = np.maximum(gap, h - sc.o_del) - sc.e_del
        cell = np.maximum(np.maximum(h[:-1] + profile[t, :, lane].T, gap[1:]), 0)
        h = np.concatenate([np.zeros((1, lanes), np.int32), cell])
        run = np.maximum.accumulate(h - sc.o_ins + ramp, axis=0)
        h[1:] = np.maximum(cell, run[:-1] - ramp[1:])
        rows[i] = top = h.max(0)
        better = np.flatnonzero((top > best) & (best < stop if stop is not None else True))
        if len(better):
            best[better], te[better] = top[better], i
            qe[better] = n - 1 - (h[::-1, better] == top[better]).argmax(0)
        if stop is not None and (best >= stop).all():
            break
    return best, qe, te, rows


def extend_lanes(queries: np.ndarray, targets: np.ndarray, h0: int, w: int, sc: Scoring) -> tuple[list, ...]:
    """:func:`extend` of many pairs of equal lengths at once; a pair whose sweep has ended keeps what it had."""
    n, lanes = queries.shape
    if not n:
        return tuple(np.full(lanes, v).tolist() for v in extend(queries[:, 0], targets[:, 0], h0, w, sc))
    profile, lane = _profiles(queries, sc), np.arange(lanes)
    cols = np.arange(n + 1, dtype=np.int32)[:, None]
    ramp, zero = cols * sc.e_ins, np.zeros((1, lanes), np.int32)
    h = np.repeat(np.maximum(0, np.where(cols == 0, h0, h0 - sc.o_ins - sc.e_ins * cols)).astype(np.int32), lanes, 1)
    gap = np.zeros((n + 1, lanes), np.int32)
    best, qle, tle, off, gscore, gtle = (np.full(lanes, v, np.int64) for v in (h0, 0, 0, 0, -1, 0))
    lo, hi, live = np.zeros(lanes, np.int64), np.full(lanes, n, np.int64), np.ones(lanes, bool)
    for i, t in enumerate(targets):
        lo, hi = np.maximum(lo, i - w), np.minimum(np.minimum(hi, i + w + 1), n)
        live &= lo < n
        first = np.where(lo == 0, max(0, h0 - sc.o_del - sc.e_del * (i + 1)), 0).astype(np.int32)
        cell = np.where(h[:-1] > 0, np.maximum(h[:-1] + profile[t, :, lane].T, 0), 0)
        source = np.concatenate([zero, cell])
        run = np.maximum.accumulate(source - sc.o_ins + ramp, axis=0)
        row = np.concatenate([first[None], np.maximum(np.maximum(cell, gap[1:]), np.maximum(run[:-1] - ramp[1:], 0))])
        row[(cols < lo) | (cols > hi)] = 0
        gap = np.maximum(np.maximum(gap, source - sc.o_del) - sc.e_del, 0)
        h = row
        top = row[1:].max(0)
        ends = live & (hi == n) & (row[n] >= gscore) & (row[n] > 0)
        gscore, gtle = np.where(ends, row[n], gscore), np.where(ends, i + 1, gtle)
        live &= top > 0
        j = n - 1 - (row[:0:-1] == top).argmax(0)
        better = live & (top > best)
        if sc.zdrop > 0:
            di, dj = i + 1 - tle, j + 1 - qle
            slack = np.where(di > dj, (di - dj) * sc.e_del, (dj - di) * sc.e_ins)
            live &= better | (best - top - slack <= sc.zdrop)
        best, qle, tle = np.where(better, top, best), np.where(better, j + 1, qle), np.where(better, i + 1, tle)
        off = np.where(better, np.maximum(off, np.abs(j - i)), off)
        if not live.any():
            break
        alive = (row > 0) | (gap > 0)
        some = alive.any(0)
        lo = np.where(some, alive.argmax(0), lo)
        hi = np.where(some, np.minimum(n - alive[::-1].argmax(0) + 2, n), hi)
    return tuple(x.tolist() for x in (best, qle, tle, gtle, gscore, off))


def global_lanes(queries: np.ndarray, targets: np.ndarray, w: int, sc: Scoring) -> tuple[list, list]:
    """:func:`global_` of many pairs of equal lengths: the matrices at once, the way back through each."""
    (n, lanes), m = queries.shape, len(targets)
    w = max(w, abs(n - m))
    profile, lane = _profiles(queries, sc), np.arange(lanes)
    cols = np.arange(n + 1, dtype=np.int32)[:, None]
    ramp = cols * sc.e_ins
    h, d, s = (np.full((m + 1, n + 1, lanes), NEG, np.int32) for _ in range(3))
    s[0, 1:] = -sc.o_ins - ramp[1:]
    h[0, 1:] = s[0, 1:]
    h[0, 0] = 0
    h[0, cols[:, 0] > w] = NEG
    for i in range(1, m + 1):
        d[i] = np.maximum(d[i - 1], h[i - 1] - sc.o_del) - sc.e_del
        open_ = d[i].copy()
        open_[1:] = np.maximum(open_[1:], h[i - 1, :-1] + profile[targets[i - 1], :, lane].T)
        dead = np.abs(cols[:, 0] - i) > w
        open_[dead] = NEG
        s[i, 1:] = np.maximum.accumulate(open_ - sc.o_ins + ramp, axis=0)[:-1] - ramp[1:]
        h[i] = np.maximum(open_, s[i])
        h[i, dead] = NEG
    scores = sc.matrix()
    ways = [_way_back(np.ascontiguousarray(h[:, :, k]), np.ascontiguousarray(d[:, :, k]), np.ascontiguousarray(s[:, :, k]), scores, queries[:, k], targets[:, k], sc) for k in range(lanes)]
    return h[m, n].tolist(), ways


def global_(query: np.ndarray, target: np.ndarray, w: int, sc: Scoring) -> tuple[int, list[tuple[str, int]]]:
    """Banded global alignment: score and CIGAR; a diagonal step is preferred to a deletion and that to an insertion."""
    n, m = len(query), len(target)
    w = max(w, abs(n - m))
    mat = sc.matrix()
    h = np.full((m + 1, n + 1), NEG, np.int64)
    d = np.full((m + 1, n + 1), NEG, np.int64)
    s = np.full((m + 1, n + 1), NEG, np.int64)
    cols = np.arange(n + 1)
    h[0, 0] = 0
    s[0, 1:] = -sc.o_ins - sc.e_ins * cols[1:]
    h[0, 1:] = s[0, 1:]
    h[0, cols > w] = NEG
    for i in range(1, m + 1):
        d[i] = np.maximum(d[i - 1], h[i - 1] - sc.o_del) - sc.e_del
        open_ = d[i].copy()
        open_[1:] = np.maximum(open_[1:], h[i - 1, :-1] + mat[target[i - 1]][query])
        dead = np.abs(cols - i) > w
        open_[dead] = NEG
        run = np.maximum.accumulate(open_ - sc.o_ins + cols * sc.e_ins)
        s[i, 1:] = run[:-1] - cols[1:] * sc.e_ins
        h[i] = np.maximum(open_, s[i])
        h[i, dead] = NEG
    return int(h[m, n]), _way_back(h, d, s, mat, query, target, sc)


def _way_back(h: np.ndarray, d: np.ndarray, s: np.ndarray, mat: np.ndarray, query: np.ndarray, target: np.ndarray, sc: Scoring) -> list[tuple[str, int]]:
    """Runs of operations through the matrices of a global alignment."""
    ops: list[tuple[str, int]] = []
    i, j, state = len(target), len(query), "H"

    def push(op: str) -> None:
        if ops and ops[-1][0] == op:
            ops[-1] = (op, ops[-1][1] + 1)
        else:
            ops.append((op, 1))

    while i or j:
        if state == "H":
            if i and j and h[i, j] == h[i - 1, j - 1] + mat[target[i - 1], query[j - 1]]:
                push("M")
                i, j = i - 1, j - 1
                continue
            state = "D" if i and h[i, j] == d[i, j] else "I"
        if state == "D":
            push("D")
            state = "D" if d[i, j] == d[i - 1, j] - sc.e_del and d[i - 1, j] > NEG // 2 else "H"
            i -= 1
        else:
            push("I")
            state = "I" if j > 1 and s[i, j] == s[i, j - 1] - sc.e_ins and s[i, j - 1] > NEG // 2 else "H"
            j -= 1
    return ops[::-1]


def cigar_text(ops: list[tuple[str, int]]) -> str:
    return "".join(f"{n}{op}" for op, n in ops)


def md_nm(query: str, target: str, ops: list[tuple[str, int]]) -> tuple[str, int]:
    """The MD string and edit distance of an alignment."""
    out, run, nm, q, t = [], 0, 0, 0, 0
    for op, n in ops:
        if op == "M":
            for x, y in zip(query[q : q + n].upper(), target[t : t + n].upper(), strict=True):
                if x == y and x in "ACGT":
                    run += 1
                else:
                    out.append(f"{run}{y}")
                    run, nm = 0, nm + 1
            q, t = q + n, t + n
        elif op == "D":
            out.append(f"{run}^{target[t : t + n].upper()}")
            run, nm, t = 0, nm + n, t + n
        elif op == "I":
            nm, q = nm + n, q + n
        else:
            q += n
    return "".join(out) + str(run), nm


def align_cigar(query: str, target: str, w: int, reverse: bool, sc: Scoring) -> tuple[int, str, str, int]:
    """Score, CIGAR, MD and NM; on the reverse strand both are reversed first, so indels are left-most on the reference."""
    q, t = (query[::-1], target[::-1]) if reverse else (query, target)
    if w == 0 and len(q) == len(t):
        score, ops = int(sc.matrix()[encode(t), encode(q)].sum()), [("M", len(q))]
    else:
        score, ops = global_(encode(q), encode(t), max(w, abs(len(q) - len(t)) + 3), sc)
    if reverse:
        ops = ops[::-1]
        q, t = query, target
    md, nm = md_nm(q, t, ops)
    return score, cigar_text(ops), md, nm
