"""Looking things up: filters, ordered fetches, pages, ranked search, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvizmill.functions.text import shuffle_key


def page(df: DataFrame, size: int, number: int, *order: Column) -> DataFrame:
    """Page ``number`` (from 1) of a total order."""
    return df.orderBy(*order).offset(size * (number - 1)).limit(size)


def shuffled(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """A reproducible random sample of n rows: the smallest hashes of the key, ties by key."""
    return df.orderBy(shuffle_key(F.col(key), seed), key).limit(n)


def fetch_in_order(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` of the (id, pos) list in its order; unknown ids are dropped."""
    return rows.join(ids, "id").orderBy("pos", "id")


def diverse_sample(questions: DataFrame, n: int, least: int, seed: int) -> DataFrame:
    """n questions of packs with at least ``least``: one random question per pack first, then further ones."""
    pack = Window.partitionBy("pack_id")
    ranked = questions.withColumn("_h", shuffle_key(F.col("id"), seed)).withColumn("_size", F.count("*").over(pack)).where(F.col("_size") >= least)
    ranked = ranked.withColumn("rn", F.row_number().over(pack.orderBy("_h", "id")))
    return ranked.orderBy(F.col("rn") > 1, "_h", "id").limit(n).drop("_h", "_size", "rn")


def search_titles(packs: DataFrame, text: str, n: int) -> DataFrame:
    """Titles that contain the text in any case: exact, then at the start, then inside; nearer the start, larger, by title."""
    low, needle = F.lower("title"), text.strip().lower()
    at = F.locate(needle, low)
    rank = F.when(low == needle, 0).when(at == 1, 1).otherwise(2)
    hits = packs.where(at > 0).withColumn("rank", rank).withColumn("at", at)
    return hits.orderBy("rank", "at", F.col("questions").desc(), "title", "id").limit(n)


def anti(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``left`` whose keys aren't in ``right``."""
    return left.join(right.select(*keys), list(keys), "left_anti")
