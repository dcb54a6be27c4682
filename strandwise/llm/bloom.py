"""Bloom filters of hash columns as one literal of bounded size, to keep wide rows out of joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each hash, and the least and the most bits of a filter (2 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 14, 1 << 24


def _places(h: Column, bits: int) -> list[Column]:
    """The two bits of the filter that a hash sets: its low and its high half."""
    return [h.bitwiseAND(F.lit(bits - 1)), F.call_function("shiftright", h, F.lit(32)).bitwiseAND(F.lit(bits - 1))]


def hash_filter(hashes: DataFrame) -> Callable[[Column], Column]:
    """A test that every value of the one bigint column of ``hashes`` passes, and others seldom.

    The values must be hashes already; nulls and repeats are fine.  The bits
    grow with the number of values up to a bound; beyond it more of the others
    pass, which costs room in the join that follows and changes no result.
    """
    own = hashes.toDF("h").dropna().distinct()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * max(1, own.count()) - 1).bit_length()))
    set_bits = own.select(F.explode(F.array(*_places(F.col("h"), bits))).alias("p"))
    word, one = F.call_function("shiftright", "p", F.lit(6)), F.lit(1).cast("bigint")
    rows = set_bits.groupBy(word.alias("at")).agg(F.bit_or(F.call_function("shiftleft", one, F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("v")).collect()
    words = ["0"] * (bits // 64)
    for r in rows:
        words[r["at"]] = str(r.v)
    table = F.split(F.lit(",".join(words)), ",").cast("array<bigint>")  # one literal once the planner has folded it

    def passes(h: Column) -> Column:
        tests = [F.call_function("getbit", F.get(table, F.call_function("shiftright", p, F.lit(6)).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in _places(h, bits)]
        return tests[0] & tests[1]

    return passes
