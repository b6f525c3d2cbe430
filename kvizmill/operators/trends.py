"""Year-over-year change of category shares, in the two ways it is reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _last_two(counts: DataFrame, digits: int | None) -> DataFrame:
    """Shares within each of the last two years that have rows; ``k`` is 1 for the last. A row per year and category."""
    share = F.lit(100.0) * F.col("count") / F.sum("count").over(Window.partitionBy("year"))
    return (
        counts.withColumn("pct", F.round(share, digits) if digits is not None else share)
        .withColumn("k", F.dense_rank().over(Window.orderBy(F.col("year").desc())))
        .where("k <= 2")
    )


def growth_rounded(counts: DataFrame) -> DataFrame:
    """Change of rounded shares, for the categories of the last year; a new category had 0."""
    both = _last_two(counts, 1)
    last = both.where("k = 1").select("category", "pct")
    before = both.where("k = 2").select("category", F.col("pct").alias("prev_pct"))
    return last.join(before, "category", "left").fillna({"prev_pct": 0.0}).withColumn("delta", F.round(F.col("pct") - F.col("prev_pct"), 1))


def growth(counts: DataFrame) -> DataFrame:
    """Change of shares, rounded at the end, for the categories of either year; nothing if there is one year only."""
    both = _last_two(counts, None)
    last = both.where("k = 1").select("category", F.col("pct").alias("a"))
    before = both.where("k = 2").select("category", F.col("pct").alias("b"))
    two = before.select(F.lit(True).alias("_two")).distinct()
    change = F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))
    return last.join(before, "category", "full").join(F.broadcast(two)).select("category", F.bround(F.round(change, 9), 1).alias("delta"))


def arrow(delta: Column, still: float = 0.5) -> Column:
    return F.when(delta > still, "↑").when(delta < -still, "↓").otherwise("→")
