"""Connected components by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.storage import drop_table, write_table


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of bigint nodes -> ``(node, root)`` for every node with an edge.

    ``root`` is one node of the component, the same for all its members.  In
    each round every node points to its smallest neighbour (or itself), edges
    are rewritten to the nodes pointed at, and self-loops vanish; the pointers
    of all rounds compose to the labels.  Each round is a map-side combined
    minimum and two equi-joins on tables, so hubs are split by adaptive
    execution and nothing is gathered anywhere.  Self-loops and repeated edges
    are allowed; a null endpoint is no edge; without edges the result is empty.
    """
    own = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    live = write_table(spark, own.where("a <> b").distinct(), "cc-edges")
    labels: DataFrame | None = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        step = write_table(spark, least.select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "cc-step")
        moved = (
            live.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
        after = write_table(spark, moved, "cc-edges")
        drop_table(spark, live)
        if labels is None:
            labels = step
        else:
            hop = step.select(F.col("node").alias("root"), F.col("root").alias("to"))
            joined = labels.join(hop, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            composed = write_table(spark, joined, "cc-labels")
            drop_table(spark, labels)
            drop_table(spark, step)
            labels = composed
        live = after
    return own.where("false").select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else labels
