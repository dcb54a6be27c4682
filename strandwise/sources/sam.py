"""SAM text: scanning, headers, records, expansion of alternatives, and normal order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.sequence import revcomp

FIELDS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")


def scan(lines: DataFrame) -> DataFrame:
    """Records of ``lines(value)`` with the eleven fields and ``tags`` as a map; header lines are skipped."""
    body = lines.where(~F.col("value").startswith("@"))
    part = F.split("value", "\t")
    number = {"flag", "pos", "mapq", "pnext", "tlen"}
    cols = [(F.get(part, F.lit(i)).cast("int") if f in number else F.get(part, F.lit(i))).alias(f) for i, f in enumerate(FIELDS)]
    tags = F.map_from_entries(F.transform(F.filter(F.slice(part, 12, F.lit(1 << 20)), lambda x: x != ""), lambda x: F.struct(F.substring(x, 1, 2), F.substring(x, F.lit(6), F.length(x)))))
    return body.select(*cols, tags.alias("tags"))


def header(contigs: DataFrame, program: str = "strandwise") -> DataFrame:
    """``nth, line``: a line for each contig and one for the program."""
    sq = contigs.select(F.col("rid").alias("nth"), F.concat(F.lit("@SQ\tSN:"), F.col("name"), F.lit("\tLN:"), F.col("len"), F.when(F.col("is_alt"), F.lit("\tAH:*")).otherwise(F.lit(""))).alias("line"))
    spark = contigs.sparkSession
    return sq.unionByName(spark.createDataFrame([(-1, "@HD\tVN:1.5\tSO:unsorted\tGO:query"), (1 << 60, f"@PG\tID:{program}\tPN:{program}")], "nth bigint, line string"))


def line(df: DataFrame, tags: list[tuple[str, str, Column]]) -> Column:
    """A record as text from the eleven fields and typed tags; null tags are left out."""
    core = [F.col(f).cast("string") for f in FIELDS]
    extra = [F.when(c.isNotNull(), F.concat(F.lit(f"{name}:{kind}:"), c.cast("string"))) for name, kind, c in tags]
    return F.concat_ws("\t", *core, *extra)


def expand_alternatives(df: DataFrame) -> DataFrame:
    """``df(qname, flag, rname, pos, cigar, seq, xa)`` with a secondary row for each entry of ``xa``."""
    parts = F.regexp_extract_all("xa", F.lit("([^;]+);"), F.lit(1))
    main = df.select("qname", "flag", "rname", "pos", "cigar", "seq", F.lit(None).cast("int").alias("nm"))
    each = df.select("qname", "flag", "seq", F.explode(parts).alias("e")).withColumn("p", F.split("e", ","))
    place = F.col("p")[1]
    rev = place.startswith("-")
    flip = rev != (F.col("flag").bitwiseAND(F.lit(0x10)) != 0)
    flag = F.col("flag").bitwiseAND(F.lit(0xFFFF - 0x10 - 0x900)).bitwiseOR(F.when(rev, F.lit(0x110)).otherwise(F.lit(0x100)))
    alt = each.select("qname", flag.alias("flag"), F.col("p")[0].alias("rname"), F.abs(place.cast("int")).alias("pos"), F.col("p")[2].alias("cigar"), F.when(flip, revcomp(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.col("p")[3].cast("int").alias("nm"))
    return main.unionByName(alt)


def read_number(qname: Column) -> Column:
    """The integer after the last full stop of a name."""
    return F.substring_index(qname, ".", -1).cast("bigint")
