"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected equally often, target / size of the
source times.  Documents are ranked by size within their source and put in an
order that rises over the even ranks and falls over the odd ones; expected
copies are summed along it, one random offset is added, and a document is
taken once for each whole number that its step crosses.  Neighbours in the
order are of nearly equal size and both ends are small, so what the sums miss
at one document the next ones give back: the words taken differ from the
target by less than twice the largest document.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandwise.llm.ranked import in_order
from strandwise.llm.storage import write_table

#: Fixed values of the contract.
WEIGHTS = (5, 2, 1)
MOST = 3
SPACE = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Words each source should give: weights repeat over the sources by code point, null last; no target exceeds ``most`` times its size."""
    order = sorted(sizes, key=lambda x: (x[0] is None, [ord(c) for c in x[0] or ""]))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_ = float(sum(size.values())), dict(weight)
    out: dict[str | None, float] = {}
    while open_:
        whole = sum(open_.values())
        over = [s for s, w in open_.items() if left * w / whole > most * size[s]]
        if not over:
            return out | {s: left * w / whole for s, w in open_.items()}
        for s in over:
            out[s] = float(most * size[s])
            del open_[s]
        left = float(sum(size.values())) - sum(out.values())
    return out


def offset(seed: int, source: str | None) -> float:
    """The one random number of a source, from 0 to 1; a multiple of 2^-20, so that whole rates stay whole."""
    return (xxhash.xxh64_intdigest(f"{seed} {source!r}") >> 44) / 2**20


def mix(spark: SparkSession, docs: DataFrame, keep: list[str] | None = None, seed: int = 6, **how) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` for each row of ``docs(doc_id, text, source)``.

    The offset of a source comes from ``seed`` and its name, and the order is
    total (source, size, ``doc_id``), so reruns agree whatever the partitions.
    A null text has no words and a null source is a source; rows that agree in
    all three keys are interchangeable; a text of any length is one row; an
    empty table gives no rows; other columns are ignored but for those that
    ``keep`` names.  The driver holds one row a source.
    """
    keep = keep or []
    words = F.coalesce(F.regexp_count("text", F.lit(SPACE)), F.lit(0)).cast("bigint")
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", words.alias("size"), *keep)
    rows = in_order(spark, narrow, [F.col("source").asc_nulls_last(), "size", "doc_id"], "mix")
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min("nth").alias("least"))
    parts = write_table(spark, parts, "mix-parts")
    totals = parts.groupBy("source").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).collect()
    target = targets([(r.source, r.b) for r in totals], **how)
    table = [(r.source, r.b, float(target[r.source]), r.n, target[r.source] / r.b if r.b else 0.0, offset(seed, r.source)) for r in totals]
    sources = spark.createDataFrame(table, "_of string, source_size bigint, target double, n bigint, rate double, u double")
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = parts.select("source", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("least")).alias("start"))
    starts = starts.join(sources, F.col("source").eqNullSafe(F.col("_of"))).select("_of", F.col("part").alias("_part"), "start", "source_size", "target", "n", "rate", "u")
    starts = write_table(spark, starts, "mix-starts")  # the planner chooses the join by its size
    joined = rows.join(starts, F.col("source").eqNullSafe(F.col("_of")) & (F.col("part") == F.col("_part")))
    rank = F.col("nth") + F.col("start")
    place = F.when(rank % 2 == 0, F.floor(rank / 2)).otherwise(F.col("n") - 1 - F.floor(rank / 2))
    copies = F.floor(F.col("rate") * (place + 1) + F.col("u")) - F.floor(F.col("rate") * place + F.col("u"))
    return joined.select("doc_id", "source", "size", *keep, "source_size", "target", copies.cast("bigint").alias("copies"))


def mixed(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs(doc_id, text, source, ..)`` as often as the mix takes them, with all their columns.

    Rows that agree in every column share their copies; rows that differ in any
    are taken each on its own.  Nulls in any column are values, an empty table
    gives no rows, and columns may have any names.
    """
    whole = F.xxhash64(*(docs[c] for c in docs.columns), *(docs[c].isNull() for c in docs.columns))
    doc_id = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0))
    row = docs.select(F.struct(*docs.columns).alias("_row"), whole.alias("_k"), doc_id.alias("_id"))
    narrow = docs.select("doc_id", "text", "source", whole.alias("_k"))
    counts = mix(spark, narrow, keep=["_k"], **how).groupBy(F.coalesce("doc_id", F.lit(0)).alias("_id"), "_k").agg(F.sum("copies").alias("copies"))
    counts = write_table(spark, counts.where("copies > 0"), "copies")
    one = row.join(counts, ["_id", "_k"]).dropDuplicates(["_id", "_k"])
    return one.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(spark, spark.read.parquet(os.path.join(sf_dir, "documents.parquet")))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_mixing": op6_mixing}
ORACLES: dict[str, str] = {}
