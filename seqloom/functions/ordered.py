"""Global ranks and running sums without a single-partition window.

The order is cut at approximate quantiles into buckets; sums of the buckets are a few rows that are added up and broadcast, and
windows then run within buckets. The cuts only decide how evenly the work is dealt, never the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def _bucketed(rows: DataFrame, order: str, buckets: int) -> DataFrame:
    cuts = sorted(set(rows.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.005)))
    kind = rows.schema[order].dataType.simpleString()
    above = [(F.col(order) > F.lit(c).cast(kind)).cast("int") for c in cuts]
    return rows.withColumn("_bucket", F.coalesce(sum(above, F.lit(0)), F.lit(0)))


def running_sums(rows: DataFrame, order: str, values: list[str], buckets: int = BUCKETS, by: str | None = None) -> DataFrame:
    """rows with before_<value>: the sum of the value over all rows with a lesser ``order``, which has to be distinct and numeric.

    by: a column of groups, each of which has its own sums and distinct orders; a group is cut into buckets like the whole, so a
    large one isn't a window of its own. The groups' bucket sums are broadcast, so it is meant for a few thousand groups.
    """
    keys = [by] if by else []
    cut = _bucketed(rows, order, buckets)
    sums = cut.groupBy(*keys, "_bucket").agg(*(F.sum(v).alias(v) for v in values))
    earlier = (Window.partitionBy(by) if by else Window).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_bucket", *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_{v}") for v in values))
    within = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(F.broadcast(offsets), [*keys, "_bucket"])
    for v in values:
        out = out.withColumn(f"before_{v}", F.coalesce(F.sum(v).over(within), F.lit(0)) + F.col(f"_{v}"))
    return out.drop("_bucket", *(f"_{v}" for v in values))


def numbered(rows: DataFrame, order: str, name: str = "rank", buckets: int = BUCKETS) -> DataFrame:
    """rows with their number from 0 by a distinct numeric column."""
    out = running_sums(rows.withColumn("_one", F.lit(1).cast("long")), order, ["_one"], buckets)
    return out.withColumn(name, F.col("before__one").cast("long")).drop("_one", "before__one")


def average_ranks(rows: DataFrame, value: str, name: str, buckets: int = BUCKETS) -> DataFrame:
    """rows with the rank of a numeric column, from 1, equal values sharing their mean rank."""
    counts = rows.groupBy(value).agg(F.count("*").alias("_n"))
    ranks = running_sums(counts, value, ["_n"], buckets).select(value, (F.col("before__n") + (F.col("_n") + 1) / 2).alias(name))
    return rows.join(ranks, value)
