"""Allele typing from hits of contigs on exons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.operators.intervals import interval_join, union_length


def selected_contigs(hits: DataFrame, exons: DataFrame, least: int = 30) -> DataFrame:
    """Names whose best hits overlap an exon enough and beat their own second score: ``qname``.

    ``hits(hid, qname, contig, ts, te, score, sub)`` with a unique ``hid``.
    """
    pairs = interval_join(hits, exons, ["contig"], "ts", "te", "es", "ee")
    most = pairs.groupBy("hid").agg(F.max(F.least("te", "ee") - F.greatest("ts", "es")).alias("ovlp"))
    covered = hits.join(exons.select("contig").distinct(), "contig", "left_semi").join(most, "hid", "left").withColumn("ovlp", F.coalesce("ovlp", F.lit(0)))
    best = F.max("score").over(Window.partitionBy("qname"))
    top = covered.withColumn("_b", best).where(F.col("score") == F.col("_b"))
    bad = (F.col("ovlp") < least) | (F.col("score") == F.col("sub"))
    return top.groupBy("qname").agg(F.bool_or(bad).alias("bad")).where("not bad").select("qname")


def perfect_coverage(hits: DataFrame) -> DataFrame:
    """Bases of each gene's exons that hits without differences cover."""
    return union_length(hits.where("nm = 0"), ["gene", "exon"], "ts", "te", "covered")


def primary_exons(hits: DataFrame) -> DataFrame:
    """Genes seen on each exon, and whether no exon sees more."""
    per = hits.groupBy("exon").agg(F.countDistinct("gene").alias("genes"))
    most = per.agg(F.max("genes").alias("most"))
    return per.join(F.broadcast(most), how="cross").select("exon", "genes", (F.col("genes") == F.col("most")).alias("is_primary"))  # one row


def contig_flags(hits: DataFrame, max_nm: int = 5, least: int = 50, share: float = 0.8) -> DataFrame:
    """Exons of each contig as bits, its longest hit and least differences, and whether it is dropped."""
    per = hits.groupBy("contig").agg(F.bit_or(F.expr("shiftleft(1, cast(exon as int))")).alias("exons"), F.max(F.col("te") - F.col("ts")).alias("len"), F.min("nm").alias("nm"))
    longest = per.agg(F.max("len").alias("longest"))
    return per.join(F.broadcast(longest), how="cross").select("contig", "exons", "len", "nm", ((F.col("nm") > max_nm) | ((F.col("len") < least) & (F.col("len") < share * F.col("longest")))).alias("dropped"))  # one row


def genotype_scores(distances: DataFrame, cap: int = 255) -> DataFrame:
    """Every unordered pair of alleles with the sum over contigs of the smaller distance.

    ``distances(contig, allele, nm)``; alleles of one gene are a bounded
    dictionary, and pairs are made per contig, where both are compared.
    """
    a = distances.select("contig", F.col("allele").alias("g1"), F.col("nm").alias("n1"))
    b = distances.select("contig", F.col("allele").alias("g2"), F.col("nm").alias("n2"))
    return a.join(b, "contig").where("g1 <= g2").groupBy("g1", "g2").agg(F.least(F.sum(F.least("n1", "n2")), F.lit(cap)).cast("bigint").alias("total"))


def best_genotypes(scores: DataFrame, slack: int = 1) -> DataFrame:
    """Genotypes within a slack of the least total."""
    least = scores.agg(F.min("total").alias("least"))
    return scores.join(F.broadcast(least), how="cross").where(F.col("total") <= F.col("least") + slack).select("g1", "g2", "total")  # one row
