"""Problem 7: a most number of records for each contributor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvizmill.session import cut

#: Least number of partitions of the global sort; more where the session shuffles into more.
RANGES = 64


def positions(records: DataFrame, contributor: str, order: list[Column], ranges: int | None = None) -> DataFrame:
    """``records`` with ``position``: place within its contributor, from 1, in the given order."""
    return counted_positions(records, contributor, order, ranges)[0]


def counted_positions(records: DataFrame, contributor: str, order: list[Column], ranges: int | None = None) -> tuple[DataFrame, int]:
    """``positions`` and the number of records.

    A global range sort by contributor and order, exact places from prefix sums
    of partition sizes, less the place at which the contributor starts. A
    contributor with a third of all rows spreads over a third of the
    partitions; no window or join ever holds it, as starts are joined by
    partition and contributor. ``order`` has to be total.
    """
    spark = records.sparkSession
    ranges = ranges or max(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(contributor).asc_nulls_first(), *order]
    # The sort is written once: ranges are sampled, so that computing it again could move their borders.
    ordered = cut(
        records.repartitionByRange(ranges, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_at", 33).cast("int"))
        .withColumn("_nth", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    sizes = {r["_range"]: r["n"] for r in ordered.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    starts, before = [], 0
    for k in sorted(sizes):
        starts.append((k, before))
        before += sizes[k]
    start = F.broadcast(spark.createDataFrame(starts or [(0, 0)], "_range int, _before long"))  # a row per partition
    runs = ordered.groupBy("_range", F.col(contributor).alias("_who")).agg(F.min("_nth").alias("_least")).join(start, "_range")
    first = F.min(F.col("_before") + F.col("_least")).over(Window.partitionBy("_who"))
    runs = runs.select(F.col("_range").alias("_of"), "_who", "_before", first.alias("_first"))
    here = (F.col("_range") == F.col("_of")) & F.col(contributor).eqNullSafe(F.col("_who"))
    placed = ordered.join(runs, here).withColumn("position", F.col("_before") + F.col("_nth") - F.col("_first") + 1)
    return placed.drop("_at", "_range", "_nth", "_of", "_who", "_before", "_first"), before


def over_cap(posts: DataFrame, parts: int = 25) -> DataFrame:
    """``channel_id, post_id`` of the posts that each channel has beyond its share.

    With N different (channel_id, post_id), a channel keeps at most N // parts.
    A post's views are the highest of its rows, null below every number; more
    views stay first, then the smaller post_id. Rows without channel or post
    are no posts: they neither count nor come out. ``posts`` may have any other
    columns.
    """
    once = (
        posts.where(F.col("channel_id").isNotNull() & F.col("post_id").isNotNull())
        .groupBy("channel_id", "post_id")
        .agg(F.max("views").alias("views"))
    )
    placed, n = counted_positions(once, "channel_id", [F.col("views").desc_nulls_last(), F.col("post_id").asc()])
    return placed.where(F.col("position") > n // parts).select("channel_id", "post_id")
