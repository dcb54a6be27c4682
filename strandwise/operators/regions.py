"""Alignment regions of a read: order, duplicates, primaries, reported lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.operators.intervals import islands

ORDER = ("score", "rb", "qb", "k")


def ranked(regions: DataFrame) -> DataFrame:
    """``nth`` of each region by score, then places; the order is total, unlike an unstable sort's."""
    return regions.withColumn("nth", F.row_number().over(Window.partitionBy("read_id").orderBy(F.desc("score"), "rb", "qb", "k", "rid")))


def distinct_regions(regions: DataFrame) -> DataFrame:
    """One region for each read, score, reference and query start: the first by end."""
    first = Window.partitionBy("read_id", "score", "rb", "qb").orderBy("re", "k", "rid")
    return regions.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def leftmost_primary(regions: DataFrame, threshold: int) -> DataFrame:
    """Among regions that score enough, the one that starts first on the query is primary."""
    good = regions.where(F.col("score") >= threshold)
    first = F.row_number().over(Window.partitionBy("read_id").orderBy("qb", F.desc("score"), "rb", "k"))
    return good.withColumn("is_primary", first == 1)


def reported(regions: DataFrame, threshold: int) -> DataFrame:
    """Regions to print: enough score, no secondaries; later ones are supplementary with a quality capped by the first."""
    keep = regions.where((F.col("score") >= threshold) & ~F.col("secondary"))
    order = Window.partitionBy("read_id").orderBy(F.desc("score"), "rb", "qb", "k")
    nth = F.row_number().over(order)
    top = F.first("mapq").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return keep.withColumn("nth", nth).withColumn("flag", F.when(F.col("nth") > 1, F.lit(0x800)).otherwise(F.lit(0))).withColumn("mapq", F.when(F.col("nth") > 1, F.least("mapq", top)).otherwise(F.col("mapq")))


def alternatives(regions: DataFrame, ratio: float = 0.8, most: int = 5, most_alt: int = 200) -> DataFrame:
    """The list of other hits near the best one's score, unless there are too many: ``read_id, xa``."""
    best = F.max("score").over(Window.partitionBy("read_id"))
    order = Window.partitionBy("read_id").orderBy(F.desc("score"), "rb", "qb", "k")
    near = regions.withColumn("_n", F.row_number().over(order)).withColumn("_best", best).where((F.col("_n") > 1) & (F.col("score") >= F.col("_best") * ratio))
    text = F.concat_ws(",", F.concat(F.lit("c"), F.col("rid")), F.concat(F.when(F.col("k") % 2 == 0, F.lit("+")).otherwise(F.lit("-")), F.col("rb") + 1), F.col("score"))
    listed = near.groupBy("read_id").agg(F.count("*").alias("n"), F.sum("is_alt").alias("alts"), F.array_sort(F.collect_list(F.struct("_n", text.alias("t")))).alias("l"))
    few = listed.where((F.col("n") <= most) | ((F.col("alts") > 0) & (F.col("n") <= most_alt)))
    return few.select("read_id", F.concat(F.array_join(F.transform("l", lambda x: x["t"]), ";"), F.lit(";")).alias("xa"))


def other_primaries(rows: DataFrame) -> DataFrame:
    """For each printed region the list of the read's other printed ones: ``read_id, nth, sa``."""
    text = F.concat_ws(",", F.concat(F.lit("c"), F.col("rid")), F.col("rb") + 1, F.col("mapq"))
    lists = rows.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("nth", text.alias("t")))).alias("l"))
    joined = rows.select("read_id", F.col("nth").alias("_n")).join(lists, "read_id")
    others = F.filter("l", lambda x: x["nth"] != F.col("_n"))
    return joined.where(F.size("l") > 1).select("read_id", F.col("_n").alias("nth"), F.concat(F.array_join(F.transform(others, lambda x: x["t"]), ";"), F.lit(";")).alias("sa"))


def hit_counts(hits: DataFrame) -> DataFrame:
    """``x0`` best hits and ``x1`` other hits of each read, and whether the best is unique; low scores are better."""
    best = F.min("score").over(Window.partitionBy("read_id"))
    counted = hits.withColumn("_b", best).groupBy("read_id").agg(F.sum(F.when(F.col("score") == F.col("_b"), F.col("occ")).otherwise(0)).alias("x0"), F.sum(F.when(F.col("score") != F.col("_b"), F.col("occ")).otherwise(0)).alias("x1"))
    return counted.withColumn("type", F.when(F.col("x0") > 1, F.lit("R")).otherwise(F.lit("U")))


def diagonal_chains(seeds: DataFrame, band: int, gap: int) -> DataFrame:
    """Chains of seeds where consecutive ones, by place on the reference, stay within a band and a gap."""
    order = Window.partitionBy("read_id").orderBy("rbeg", "qbeg", "len")
    q, r, size = (F.lag(c).over(order) for c in ("qbeg", "rbeg", "len"))
    x, y = F.col("qbeg") - q, F.col("rbeg") - r
    joins = (x >= 0) & (F.abs(x - y) <= band) & (x - size < gap) & (y - size < gap)
    numbered = seeds.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("chain", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("read_id", "chain").agg(F.count("*").alias("n_seeds"), F.min("qbeg").alias("qb"), F.max(F.col("qbeg") + F.col("len")).alias("qe"), F.min("rbeg").alias("rb"), F.max(F.col("rbeg") + F.col("len")).alias("re"))


def lifted_groups(hits: DataFrame) -> DataFrame:
    """Groups of hits that overlap on the lifted axis of each read: ``grp`` counts from 1 per read and contig."""
    return islands(hits, ["read_id", "rid"], "rb", "re", "grp")


def regrouped_mapq(groups: DataFrame) -> DataFrame:
    """Quality from the best scores of the groups: six times their difference, 60 at most or if there is one group."""
    best = groups.groupBy("read_id", "rid", "grp").agg(F.max("score").alias("top"))
    nth = F.row_number().over(Window.partitionBy("read_id").orderBy(F.desc("top"), "rid", "grp"))
    two = best.withColumn("n", nth).where("n <= 2").groupBy("read_id").agg(F.max(F.when(F.col("n") == 1, F.col("top"))).alias("a"), F.max(F.when(F.col("n") == 2, F.col("top"))).alias("b"))
    return two.select("read_id", F.when(F.col("b").isNull(), F.lit(60)).otherwise(F.least(F.lit(60), 6 * (F.col("a") - F.col("b")))).cast("int").alias("mapq"))
