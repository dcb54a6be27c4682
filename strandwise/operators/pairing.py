"""Paired ends: insert sizes, candidate pairs, rescue windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.sequence import c_int, orientation, rounded

MAX_INSERT = 10_000


def _at_index(hist: DataFrame, keys: list[str], value: str, index: dict[str, Column]) -> DataFrame:
    """Values at places of the sorted list of each key, from counts per value; a key has a row per distinct value."""
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(*keys))
    placed = hist.withColumn("_to", upto).withColumn("_n", total)
    picks = [F.max(F.when((F.col("_to") > c_int(at)) & (F.col("_to") - F.col("n") <= c_int(at)), F.col(value))).alias(name) for name, at in index.items()]
    return placed.groupBy(*keys).agg(F.first("_n").alias("n_pairs"), *picks)


def insert_stats(pairs: DataFrame, keys: list[str], min_pairs: int = 10, min_share: float = 0.05) -> DataFrame:
    """Insert-size statistics per orientation of ``pairs(keys.., orient, dist)``.

    Quartiles come from counts per distance, of which there are at most
    MAX_INSERT, so a batch of any size is aggregated before it is sorted.
    """
    own = [*keys, "orient"]
    hist = pairs.where((F.col("dist") > 0) & (F.col("dist") <= MAX_INSERT)).groupBy(*own, "dist").agg(F.count("*").alias("n"))
    n = F.col("_n")
    q = _at_index(hist, own, "dist", {"p25": 0.25 * n + 0.499, "p75": 0.75 * n + 0.499})
    spread = F.col("p75") - F.col("p25")
    q = q.withColumn("lo2", F.greatest(rounded(F.col("p25") - 2.0 * spread), F.lit(1))).withColumn("hi2", rounded(F.col("p75") + 2.0 * spread))
    inside = hist.join(q, own).where("dist between lo2 and hi2")
    mean = inside.groupBy(*own).agg((F.sum(F.col("dist") * F.col("n")) / F.sum("n")).alias("avg"))
    spread2 = inside.join(mean, own).groupBy(*own).agg(F.first("avg").alias("avg"), F.sqrt(F.sum(F.pow(F.col("dist") - F.col("avg"), 2) * F.col("n")) / F.sum("n")).alias("std"))
    out = q.join(spread2, own)
    low, high = rounded(F.col("p25") - 3.0 * spread), rounded(F.col("p75") + 3.0 * spread)
    lo4, hi4 = F.col("avg") - 4.0 * F.col("std"), F.col("avg") + 4.0 * F.col("std")
    most = F.max("n_pairs").over(Window.partitionBy(*keys)) if keys else F.max("n_pairs").over(Window.partitionBy(F.lit(0)))
    failed = (F.col("n_pairs") < min_pairs) | (F.col("n_pairs") < most * min_share)
    few = F.col("n_pairs") < min_pairs
    keep = lambda c: F.when(~few, c)
    return out.select(
        *own,
        "n_pairs",
        keep(F.greatest(F.when(low > lo4, rounded(lo4)).otherwise(low), F.lit(1))).alias("low"),
        keep(F.when(high < hi4, rounded(hi4)).otherwise(high)).alias("high"),
        keep(F.col("avg")).alias("avg"),
        keep(F.col("std")).alias("std"),
        failed.alias("failed"),
    )


def unique_pairs(ends: DataFrame) -> DataFrame:
    """Pairs both of whose ends are clearly best, with orientation and distance."""
    way, dist = orientation(F.col("b1"), F.col("b2"), F.col("l_pac"))
    sure = (F.col("sub1") <= 0.8 * F.col("s1")) & (F.col("sub2") <= 0.8 * F.col("s2"))
    return ends.where(sure).withColumn("orient", way).withColumn("dist", dist)


def external_stats(sizes: DataFrame, keys: list[str], longest: str, min_pairs: int, bias: float) -> DataFrame:
    """Insert-size statistics of ``sizes(keys.., size)`` with bounds no lower than the longest read: quartiles, mean, deviation, skewness, kurtosis."""
    hist = sizes.groupBy(*keys, "size").agg(F.count("*").alias("n"), F.max(longest).alias("_max"))
    n = F.col("_n")
    q = _at_index(hist, keys, "size", {"p25": 0.25 * n + bias, "p50": 0.5 * n + bias, "p75": 0.75 * n + bias}).where(F.col("n_pairs") >= min_pairs)
    q = q.join(hist.groupBy(*keys).agg(F.max("_max").alias("longest")), keys)
    spread = F.col("p75") - F.col("p25")
    q = q.withColumn("low", F.greatest(rounded(F.col("p25") - 2.0 * spread), F.col("longest").cast("int"), F.lit(1))).withColumn("high", rounded(F.col("p75") + 2.0 * spread)).where("low <= high")
    inside = hist.join(q, keys).where("size between low and high")
    mean = inside.groupBy(*keys).agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("avg"))
    d = F.col("size") - F.col("avg")
    m = lambda k: F.sum(F.pow(d, k) * F.col("n")) / F.sum("n")
    moments = inside.join(mean, keys).groupBy(*keys).agg(F.first("avg").alias("avg"), m(2).alias("m2"), m(3).alias("m3"), m(4).alias("m4"))
    joined = q.join(moments, keys)
    return joined.select(*keys, "n_pairs", "p25", "p50", "p75", "low", "high", "longest", "avg", F.sqrt("m2").alias("std"), (F.col("m3") / F.pow(F.sqrt("m2"), 3)).alias("skewness"), (F.col("m4") / (F.col("m2") * F.col("m2")) - 3).alias("kurtosis"))


def candidate_pairs(hits: DataFrame, bounds: DataFrame) -> DataFrame:
    """Hits of both ends of a pair on one contig whose distance suits their orientation.

    ``hits(pair_id, mate, rid, pos, rev, score, k)``; the hit that comes first
    by position (then score and number) names the orientation's first strand.
    ``bounds(orient, low, high)``.
    """
    a = hits.select("pair_id", "rid", *(F.col(c).alias(f"{c}_a") for c in ("mate", "pos", "rev", "score", "k")))
    b = hits.select("pair_id", "rid", *(F.col(c).alias(f"{c}_b") for c in ("mate", "pos", "rev", "score", "k")))
    key = lambda s: F.struct(*(F.col(f"{c}_{s}") for c in ("pos", "score", "k", "rev", "mate")))
    joined = a.join(b, ["pair_id", "rid"]).where((F.col("mate_a") != F.col("mate_b")) & (key("a") < key("b")))
    placed = joined.withColumn("orient", (F.col("rev_a") * 2 + F.col("rev_b")).cast("int")).withColumn("dist", F.col("pos_b") - F.col("pos_a"))
    return placed.join(F.broadcast(bounds), "orient").where("dist between low and high")  # four rows at most


def best_pairs(cands: DataFrame, penalty: int = 7) -> DataFrame:
    """Best and second pair score of each pair, and how many score within a penalty of the second."""
    order = Window.partitionBy("pair_id").orderBy(F.desc("q"), "pos_a", "pos_b", "k_a", "k_b", "rev_a", "rev_b", "mate_a")
    ranked = cands.withColumn("nth", F.row_number().over(order))
    second = F.max(F.when(F.col("nth") == 2, F.col("q"))).over(Window.partitionBy("pair_id"))
    with_sub = ranked.withColumn("sub", F.coalesce(second, F.lit(0)))
    near = F.sum(F.when((F.col("nth") > 1) & (F.col("sub") - F.col("q") <= penalty), 1).otherwise(0))
    return with_sub.groupBy("pair_id").agg(F.max("q").alias("best"), F.max("sub").alias("sub"), near.alias("n_sub"))


def rescue_needed(pairs: DataFrame, bounds: DataFrame) -> DataFrame:
    """``pair_id, orient`` that no distance of the pair satisfies yet, of the orientations that have bounds."""
    want = pairs.select("pair_id").distinct().join(F.broadcast(bounds.select("orient")), how="cross")  # four rows at most
    have = pairs.join(F.broadcast(bounds), "orient").where("dist between low and high").select("pair_id", "orient")
    return want.join(have, ["pair_id", "orient"], "left_anti")


def rescue_windows(hits: DataFrame, bounds: DataFrame, l_pac: int, mate_len: int) -> DataFrame:
    """Where a mate may be for each orientation: ``[wb, we)`` on the doubled axis."""
    o = F.col("orient")
    flip = (F.shiftright(o, 1) != o.bitwiseAND(F.lit(1)))
    larger = F.shiftright(o, 1) == 0
    near, far = F.when(larger, F.col("rb") + F.col("low")).otherwise(F.col("rb") - F.col("high")), F.when(larger, F.col("rb") + F.col("high")).otherwise(F.col("rb") - F.col("low"))
    wb = F.greatest(near - F.when(flip, F.lit(mate_len)).otherwise(F.lit(0)), F.lit(0))
    we = F.least(far + F.when(flip, F.lit(0)).otherwise(F.lit(mate_len)), F.lit(2 * l_pac))
    wide = hits.join(F.broadcast(bounds), how="cross")  # four rows at most
    return wide.withColumn("wb", wb.cast("bigint")).withColumn("we", we.cast("bigint")).withColumn("flip", flip).where("wb < we")


def forward_reverse_pairs(hits: DataFrame, longest: int, max_insert: int) -> DataFrame:
    """For each reverse hit, the last two forward hits of the other end before it, scored by their sum times ten."""
    fwd = hits.where("rev = 0").select("pair_id", F.col("mate").alias("m1"), F.col("pos").alias("p1"), F.col("score").alias("s1"), F.col("k").alias("k1"))
    rev = hits.where("rev = 1").select("pair_id", F.col("mate").alias("m2"), F.col("pos").alias("p2"), F.col("score").alias("s2"), F.col("k").alias("k2"), F.col("len").alias("len2"))
    before = rev.join(fwd, "pair_id").where("m1 <> m2 and (p1 < p2 or (p1 = p2 and k1 < k2))")
    nth = F.row_number().over(Window.partitionBy("pair_id", "m2", "k2", "p2", "s2").orderBy(F.desc("p1"), F.desc("k1"), F.desc("s1")))
    size = F.col("p2") + F.col("len2") - F.col("p1")
    return before.withColumn("nth", nth).where("nth <= 2").withColumn("insert", size).where((F.col("p2") > F.col("p1")) & (size >= longest) & (size <= max_insert)).select("pair_id", "k1", "k2", "m2", "insert", ((F.col("s1") + F.col("s2")) * 10).alias("q"))
