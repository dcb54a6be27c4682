"""Alternate contigs: lift-over through CIGARs and scores of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def operations(cigar: Column) -> Column:
    """``array<struct<n, op>>`` of a CIGAR."""
    n = F.regexp_extract_all(cigar, F.lit("([0-9]+)[MIDSHN]"), F.lit(1))
    op = F.regexp_extract_all(cigar, F.lit("[0-9]+([MIDSHN])"), F.lit(1))
    return F.zip_with(n, op, lambda a, b: F.struct(a.cast("bigint").alias("n"), b.alias("op")))


def lifted(cigar: Column, pos: Column) -> Column:
    """The reference offset of a query position: -1 in a clip or beyond, the place of an insertion within one."""
    start = F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), F.lit(None).cast("bigint").alias("at"))

    def step(t: Column, c: Column) -> Column:
        query = c["op"].isin("M", "I", "S", "H")
        here = query & (t["y"] <= pos) & (pos < t["y"] + c["n"])
        found = F.when(c["op"] == "M", t["x"] + pos - t["y"]).when(c["op"] == "I", t["x"]).otherwise(F.lit(-1))
        return F.struct(
            (t["x"] + F.when(c["op"].isin("M", "D"), c["n"]).otherwise(0)).alias("x"),
            (t["y"] + F.when(query, c["n"]).otherwise(0)).alias("y"),
            F.coalesce(t["at"], F.when(here, found)).alias("at"),
        )

    return F.aggregate(operations(cigar), start, step, lambda t: F.coalesce(t["at"], F.lit(-1)))


def hit_fields(df: DataFrame, a: int = 1, b: int = 4, o: int = 6, e: int = 1) -> DataFrame:
    """Fields of hits written as ``contig,±position,cigar,nm`` in ``hit``: ``ctg, start, end, rev, nm, score, l_query``."""
    part = F.split("hit", ",")
    raw = df.withColumns({"ctg": part[0], "start": F.substring(part[1], F.lit(2), F.length(part[1])).cast("bigint") - 1, "rev": part[1].startswith("-"), "cigar": part[2], "nm0": part[3].cast("bigint")})
    ops = operations(F.col("cigar"))
    total = lambda which: F.aggregate(F.filter(ops, lambda x: x["op"].isin(*which)), F.lit(0).cast("bigint"), lambda t, x: t + x["n"])
    count = lambda which: F.size(F.filter(ops, lambda x: x["op"].isin(*which)))
    s = raw.withColumns({"m": total("M"), "i": total("I"), "d": total("D"), "sk": total("N"), "c": total("SH"), "gaps": count("ID")})
    s = s.withColumn("nm", F.greatest("nm0", F.col("i") + F.col("d")))
    score = F.floor((a * F.col("m") - (a + b) * (F.col("nm") - F.col("i") - F.col("d")) - o * F.col("gaps") - e * (F.col("i") + F.col("d"))) / F.lit(float(a)) + 0.499)
    return s.select(*df.columns, "ctg", "start", (F.col("start") + F.col("m") + F.col("d") + F.col("sk")).alias("end"), "rev", "nm", score.cast("bigint").alias("score"), (F.col("m") + F.col("i") + F.col("c")).alias("l_query"))
