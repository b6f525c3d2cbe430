"""Category and subcategory statistics over the question-topic bridge.

Counts of different questions are taken in two steps, (question, key) first,
so that the shuffle carries each pair once and no count-distinct is expanded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def everything():
    """One window over all rows: only for tables of a row per category."""
    return Window.partitionBy()



def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Half-even rounded percentage, 0 where the whole is 0."""
    return F.coalesce(F.bround(F.try_divide(F.lit(100.0) * part, whole), digits), F.lit(0.0))


def question_counts(rows: DataFrame, *keys: str, name: str = "count") -> DataFrame:
    """Different questions per key."""
    return rows.select("question_id", *keys).distinct().groupBy(*keys).agg(F.count("*").alias(name))


def with_share(counts: DataFrame, digits: int = 1) -> DataFrame:
    """``pct`` of the sum of all counts."""
    return counts.withColumn("pct", percent(F.col("count"), F.sum("count").over(everything()), digits))


def share_of_distinct(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``pct`` of the number of different questions overall: with several labels they add up to more than 100."""
    total = rows.select("question_id").distinct().agg(F.count("*").alias("_total"))
    return counts.join(F.broadcast(total)).withColumn("pct", F.round(F.try_divide(F.lit(100.0) * F.col("count"), F.col("_total")), 1)).drop("_total")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """A report of the first n rows in a total order."""
    return df.orderBy(*order).limit(n)


def quartiles(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Least, quartiles and greatest value per key, exact."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        rows.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.min(value).alias("low"), q.alias("_q"), F.max(value).alias("high"), F.count("*").alias("n"))
        .select(*keys, "low", *[F.round(F.col("_q")[i], 6).alias(c) for i, c in enumerate(("q1", "median", "q3"))], "high", "n")
    )


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins from low to high, the last one closed; values outside are left out."""
    width = (high - low) / bins
    k = F.least(F.floor((F.col(value) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(value).between(low, high)).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))


def primary_topics(topics: DataFrame, *partition: str) -> DataFrame:
    """The row with the most confidence of each question (and model), nulls last, ties by subcategory and id."""
    order = Window.partitionBy(*partition).orderBy(F.col("confidence").desc_nulls_last(), "subcategory_id", "id")
    return topics.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def paired_categories(labelled: DataFrame, least: int) -> DataFrame:
    """Pairs of categories that questions have in two of their topics.

    Per question the different (subcategory, category) pairs meet themselves:
    few rows, as a question has at most the 52 subcategories.
    """
    once = labelled.select("question_id", "subcategory_id", "category").distinct()
    a = once.select("question_id", F.col("subcategory_id").alias("sa"), F.col("category").alias("category_a"))
    b = once.select("question_id", F.col("subcategory_id").alias("sb"), F.col("category").alias("category_b"))
    pairs = a.join(b, "question_id").where((F.col("sa") < F.col("sb")) & (F.col("category_a") != F.col("category_b")))
    return question_counts(pairs, "category_a", "category_b").where(F.col("count") >= least)


def tagged_union(tag: str, tables: dict[str, DataFrame]) -> DataFrame:
    """All rows of several tables, each with the name of its own in ``tag``."""
    return reduce(DataFrame.unionByName, [df.withColumn(tag, F.lit(name)) for name, df in tables.items()])
