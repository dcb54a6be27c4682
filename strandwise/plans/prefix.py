"""Running totals over a whole table without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_totals(df: DataFrame, order: str, values: dict[str, str], width: int = 4096) -> DataFrame:
    """``df`` with a column for each of ``values`` (name -> expression): its sum over rows with a smaller ``order``.

    Rows are cut into ranges of ``width`` values of the integer ``order``;
    sums within a range are a window per range, and only the ranges' totals,
    a row for each, are summed in one place.
    """
    bucket = F.floor(F.col(order) / width).alias("_bucket")
    cut = df.withColumn("_bucket", bucket).withColumns({f"_v_{n}": F.expr(e) for n, e in values.items()})
    totals = cut.groupBy("_bucket").agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values))
    over = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("_bucket").alias("_b"), *(F.coalesce(F.sum(f"_t_{n}").over(over), F.lit(0)).alias(f"_s_{n}") for n in values))
    inside = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(starts, F.col("_bucket").eqNullSafe(F.col("_b")))
    out = joined.withColumns({n: (F.col(f"_s_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0))).cast("bigint") for n in values})
    return out.select(*df.columns, *values)
