"""Column functions on bases, CIGAR strings, flags and mapping qualities."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def c_int(x: Column) -> Column:
    """Truncation towards zero."""
    return x.cast("int")


def rounded(x: Column) -> Column:
    """Truncation after adding .499, the rounding used for all reported qualities."""
    return c_int(x + F.lit(0.499))


def dna(text: Column) -> Column:
    """Letters of a text as bases: a-z cycle through acgt, anything else is dropped."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LETTERS, ("acgt" * 7)[:26])


def nt4(seq: Column) -> Column:
    """Base codes as digits: A0 C1 G2 T3 and 4 for any other letter."""
    return F.translate(F.regexp_replace(seq, "[^ACGTacgt]", "N"), "ACGTacgtN", "012301234")


def revcomp(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def depos(pos: Column, l_pac: Column) -> tuple[Column, Column]:
    """Forward position and strand of a place on the doubled axis."""
    return F.when(pos >= l_pac, 2 * l_pac - 1 - pos).otherwise(pos), pos >= l_pac


def on_axis(seq: Column, beg: Column, end: Column) -> Column:
    """Bases ``[beg, end)`` of the doubled axis of one sequence; empty when it bridges the strands."""
    n = F.length(seq)
    lo, hi = F.greatest(beg, F.lit(0)), F.least(end, 2 * n)
    forward = F.substring(seq, lo.cast("int") + 1, (hi - lo).cast("int"))
    reverse = revcomp(F.substring(seq, (2 * n - hi).cast("int") + 1, (hi - lo).cast("int")))
    return F.when((lo >= n) & (lo < hi), reverse).when((hi <= n) & (lo < hi), forward).otherwise(F.lit(""))


def base_score(x: Column, y: Column, a: int = 1, b: int = 4) -> Column:
    """Score of two bases: match, mismatch, or -1 with an ambiguous one."""
    known = x.rlike("^[ACGTacgt]$") & y.rlike("^[ACGTacgt]$")
    return F.when(~known, F.lit(-1)).when(F.upper(x) == F.upper(y), F.lit(a)).otherwise(F.lit(-b))


def cigar_length(cigar: Column, ops: str) -> Column:
    """Sum of the lengths of the given operations."""
    parts = F.regexp_extract_all(cigar, F.lit(f"([0-9]+)[{ops}]"), F.lit(1))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def ref_length(cigar: Column) -> Column:
    return cigar_length(cigar, "MD")


def query_length(cigar: Column) -> Column:
    return cigar_length(cigar, "MIS")


def approx_mapq(score, sub, csub, span, sub_n, frac_rep, a: int = 1, b: int = 4, min_seed: int = 19, coef_len: float = 50.0) -> Column:
    """Single-end mapping quality of a region."""
    second = F.greatest(F.when(sub > 0, sub).otherwise(F.lit(min_seed * a)), csub)
    identity = 1.0 - (span * a - score).cast("double") / (a + b) / span
    weight = F.when(span < coef_len, F.lit(1.0)).otherwise(F.lit(math.log(coef_len)) / F.log(span.cast("double"))) * identity * identity
    raw = rounded(6.02 * (score - second) / a * weight * weight)
    fewer = raw - F.when(sub_n > 0, rounded(4.343 * F.log((sub_n + 1).cast("double")))).otherwise(F.lit(0))
    kept = rounded(F.least(F.greatest(fewer, F.lit(0)), F.lit(60)) * (1.0 - frac_rep))
    return F.when((second >= score) | (score == 0), F.lit(0)).otherwise(kept)


def raw_mapq(difference: Column, a: int = 1) -> Column:
    return rounded(6.02 * difference / a)


def pair_mapq(best, second, unpaired, n_sub, rep0, rep1, a: int = 1) -> Column:
    """Quality of the best pair before it meets the single-end ones."""
    q = raw_mapq(best - F.greatest(second, unpaired), a) - F.when(n_sub > 0, rounded(4.343 * F.log((n_sub + 1).cast("double")))).otherwise(F.lit(0))
    return rounded(F.least(F.greatest(q, F.lit(0)), F.lit(60)) * (1.0 - 0.5 * (rep0 + rep1)))


def joint_mapq(single: Column, pair: Column, score: Column, csub: Column, a: int = 1) -> Column:
    """An end's quality in a pair: lifted by at most 40, capped by its tandem repeat."""
    lifted = F.greatest(single, F.least(pair, single + 40))
    return F.least(lifted, raw_mapq(score - csub, a))


def max_gap(qlen: Column, a: int = 1, o: int = 6, e: int = 1, w: int = 100) -> Column:
    return F.least(F.greatest(c_int((qlen * a - o).cast("double") / e + 1.0), F.lit(1)), F.lit(2 * w))


def band(l1: Column, l2: Column, score: Column, a: int = 1, q: int = 6, r: int = 1) -> Column:
    """Band width that an alignment of this score can need."""
    width = F.greatest(c_int((F.least(l1, l2) * a - score - q).cast("double") / r + 2.0), F.abs(l1 - l2).cast("int"))
    return F.when((l1 == l2) & (l1 * a - score < 2 * (q + r - a)), F.lit(0)).otherwise(width)


def sam_flag(paired, unmapped, mate_unmapped, reverse, mate_reverse, proper, second_end, secondary, supplementary) -> Column:
    bits = ((paired, 0x1), (proper, 0x2), (unmapped, 0x4), (mate_unmapped, 0x8), (reverse, 0x10), (mate_reverse, 0x20), (paired & ~second_end, 0x40), (paired & second_end, 0x80), (secondary, 0x100), (supplementary, 0x800))
    out = F.lit(0)
    for on, bit in bits:
        out = out.bitwiseOR(F.when(on, F.lit(bit)).otherwise(F.lit(0)))
    return out


def template_length(pos, reverse, rlen, mate_pos, mate_reverse, mate_rlen) -> Column:
    """Signed template length of an end on the same contig as its mate; 0 where one has no CIGAR."""
    p0 = pos + F.when(reverse, rlen - 1).otherwise(F.lit(0))
    p1 = mate_pos + F.when(mate_reverse, mate_rlen - 1).otherwise(F.lit(0))
    return F.when((rlen == 0) | (mate_rlen == 0), F.lit(0)).otherwise(-(p0 - p1 + F.signum((p0 - p1).cast("double")).cast("long")))


def trim_name(name: Column) -> Column:
    """A read name without a trailing slash and digit."""
    return F.regexp_replace(name, "^(.+)/[0-9]$", "$1")


def clip_point(qual: Column, threshold: int, least: int = 35) -> Column:
    """Length of a read after trimming its 3' end by quality."""
    n = F.length(qual)
    scan = F.reverse(F.split(F.substring(qual, F.lit(least + 1), F.greatest(n - least, F.lit(0))), ""))
    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("top"), n.alias("cut"), n.alias("at"), F.lit(False).alias("done"))

    def step(t: Column, c: Column) -> Column:
        s = t["s"] + threshold - (F.ascii(c) - 33)
        stop = t["done"] | (s < 0)
        better = ~stop & (s > t["top"])
        at = t["at"] - 1
        return F.struct(F.when(stop, t["s"]).otherwise(s).alias("s"), F.when(better, s).otherwise(t["top"]).alias("top"), F.when(better, at).otherwise(t["cut"]).alias("cut"), at.alias("at"), stop.alias("done"))

    return F.when(n > least, F.aggregate(scan, start, step, lambda t: t["cut"])).otherwise(n)


def barcode(seq: Column, qual: Column, n: int, low: int = 13) -> Column:
    """The first bases, in lower case where their quality is low."""
    pairs = F.zip_with(F.split(F.substring(seq, 1, n), ""), F.split(F.substring(qual, 1, n), ""), lambda s, q: F.when(F.ascii(q) - 33 < low, F.lower(s)).otherwise(F.upper(s)))
    return F.array_join(pairs, "")


def from_phred64(qual: Column) -> Column:
    """Old qualities with offset 64 moved to offset 33."""
    return F.array_join(F.transform(F.split(qual, ""), lambda c: F.char(F.ascii(c) - 31)), "")


def failed_casava(comment: Column) -> Column:
    """Whether the letter after the first colon of a comment is Y."""
    return F.coalesce(comment.rlike("^[^:]*:Y"), F.lit(False))


def max_differences(length: int, error: float = 0.02, threshold: float = 0.04) -> int:
    """Least number of differences whose Poisson tail is below the threshold; the factorial wraps at 32 bits."""
    rate, term, fact = math.exp(-length * error), 1.0, 1
    total = rate
    for k in range(1, 1000):
        term *= length * error
        fact = (fact * k + 2**31) % 2**32 - 2**31
        if fact == 0:
            return 2
        total += rate * term / fact
        if 1.0 - total < threshold:
            return k
    return 2


def aln_mapq(best: Column, others: Column, mismatches: Column, most: Column) -> Column:
    """Quality of a bounded-difference hit from the counts of best and second hits."""
    seen = F.least(others, F.lit(255))
    penalty = c_int(4.343 * F.log(F.greatest(seen, F.lit(1)).cast("double")) + 0.5)
    return F.when(best == 0, F.lit(23)).when(best > 1, F.lit(0)).when(mismatches == most, F.lit(25)).when(others == 0, F.lit(37)).otherwise(F.greatest(F.lit(23) - penalty, F.lit(0)))


def longread_mapq(g: Column, g2: Column, one_direction: Column, seeds: Column, random: Column, t: int = 30, a: int = 1) -> Column:
    c = F.when(one_direction, F.lit(0.5)).otherwise(F.lit(1.0)) * F.when(seeds < 2, F.lit(0.2)).otherwise(F.lit(1.0))
    q = rounded(c * (g - F.greatest(g2, F.lit(t))) * (F.lit(250.0) / g + 0.03 / a))
    return F.when(random, F.lit(0)).otherwise(F.least(F.greatest(q, F.lit(0)), F.lit(250)))


def longread_threshold(qlen: Column, t: int = 30, coef: float = 5.5) -> Column:
    x = F.log(qlen.cast("double")) * coef
    return F.when(F.lit(t) < x, rounded(x)).otherwise(F.lit(t))


def longread_band(qlen: Column, t: Column, a: int = 1, q: int = 5, r: int = 2, bw: int = 50) -> Column:
    k = F.least(c_int((qlen * a - 2 * q).cast("double") / (2 * r + a)), c_int((qlen * a - a - t).cast("double") / r))
    return F.least(F.greatest(k, F.lit(1)), F.lit(bw))


def sa_position(pos: Column, ref_len: Column, l_pac: Column) -> tuple[Column, Column]:
    """First forward base and forward-strand mark of a hit on the doubled axis; -1 across the strands."""
    fwd, rev = depos(pos, l_pac)
    first = F.when(~rev, fwd).when(fwd + 1 < ref_len, F.lit(0)).otherwise(fwd - ref_len + 1)
    bridge = (pos < l_pac) & (l_pac < pos + ref_len)
    return F.when(bridge, F.lit(-1)).otherwise(first), F.when(bridge, F.lit(False)).otherwise(~rev)


def five_prime(pos: Column, cigar: Column, length: Column, forward: Column) -> Column:
    """5' position: the start of a forward hit, the end of a reverse one."""
    end = pos + F.when(cigar.isNull(), length).otherwise(ref_length(cigar))
    return F.when(forward, pos).otherwise(end)


def orientation(b1: Column, b2: Column, l_pac: Column) -> tuple[Column, Column]:
    """Orientation (FF FR RF RR as 0 to 3) and distance of two ends on the doubled axis."""
    same = (b1 >= l_pac) == (b2 >= l_pac)
    p2 = F.when(same, b2).otherwise(2 * l_pac - 1 - b2)
    way = F.when(same, F.lit(0)).otherwise(F.lit(1)).bitwiseXOR(F.when(p2 > b1, F.lit(0)).otherwise(F.lit(3)))
    return way, F.abs(p2 - b1)
