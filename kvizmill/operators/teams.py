"""A group's authors and skills against the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvizmill.session import if_small


def share_delta(group: DataFrame, whole: DataFrame, least: float) -> DataFrame:
    """``category, pct, whole_pct, delta`` of two (category, count) tables, where the shares differ by more than ``least``."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        total = df.agg(F.sum("count").alias("_t"))
        return df.join(F.broadcast(total)).select("category", (F.lit(100.0) * F.col("count") / F.col("_t")).alias(name))

    both = shares(group, "pct").join(shares(whole, "whole_pct"), "category", "full").fillna(0.0)
    out = both.withColumn("delta", F.round(F.col("pct") - F.col("whole_pct"), 6))
    return out.where(F.abs("delta") > least).select("category", F.round("pct", 6).alias("pct"), F.round("whole_pct", 6).alias("whole_pct"), "delta")


def skill_levels(scores: DataFrame) -> DataFrame:
    """``person, category, score, team_mean, level`` of (person, category, score): expert from 4, weak to 2, else above, below or near the mean."""
    mean = scores.groupBy("category").agg(F.avg("score").alias("team_mean"))
    level = (
        F.when(F.col("score") >= 4, "expert")
        .when(F.col("score") <= 2, "weak")
        .when(F.col("score") > F.col("team_mean") + 0.5, "above")
        .when(F.col("score") < F.col("team_mean") - 0.5, "below")
        .otherwise("near")
    )
    return scores.join(F.broadcast(mean), "category").select("person", "category", "score", F.round("team_mean", 4).alias("team_mean"), level.alias("level"))


def priority(frequency: Column, score: Column) -> Column:
    return F.when((frequency > 8) & (score <= 2), "high").when(frequency > 5, "mid").otherwise("low")


def described(items: DataFrame, names: DataFrame, least: int) -> DataFrame:
    """(key, count) items with what is known of them (key, category, description), frequent ones only; unknown ones have empty fields."""
    known = names.groupBy("key").agg(F.min("category").alias("category"), F.min("description").alias("description"))
    return items.where(F.col("count") >= least).join(known, "key", "left").fillna({"category": "", "description": ""})


def first_in_catalogue(names: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``name, item``: the first catalogue entry (item, pos, title) whose title has the name.

    A single word of six letters or more must begin a word of the title; of
    several words, all over two letters must be in it. A small catalogue is
    checked against all names in one pass.
    """
    words = F.filter(F.split(F.lower("name"), r"\s+"), lambda w: F.length(w) > 2)
    title = F.lower(F.col("title"))
    one = (F.size(F.split(F.trim("name"), r"\s+")) == 1) & (F.length(F.trim("name")) >= 6) & F.contains(F.concat(F.lit(" "), title), F.concat(F.lit(" "), F.lower(F.trim("name"))))
    many = (F.size(F.split(F.trim("name"), r"\s+")) > 1) & (F.size(words) > 0) & F.forall(words, lambda w: F.contains(title, w))
    return names.join(if_small(catalogue, 10_000), one | many).groupBy("name").agg(F.min_by("item", "pos").alias("item"))


def typed_names(found: DataFrame) -> DataFrame:
    """``key, type, count`` of (name, type, count): counts add up over spellings, and of several types the first of PER, LOC, ORG holds."""
    rank = F.when(F.col("type") == "PER", 1).when(F.col("type") == "LOC", 2).otherwise(3)
    return found.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.min_by("type", rank).alias("type"), F.sum("count").alias("count"))


def labelled_by(rows: DataFrame, classify, schema: str, least: float, dims: DataFrame) -> DataFrame:
    """Rows through a classifier (an iterator of frames to frames with question_id, cat, sub, conf), kept from a confidence on, with subcategory ids.

    ``classify`` may call any model; Spark's task retry is its retry.
    """
    return with_subcategory(rows.mapInPandas(classify, schema), least, dims)


def with_subcategory(made: DataFrame, least: float, dims: DataFrame) -> DataFrame:
    """``question_id, subcategory_id, confidence`` of (question_id, cat, sub, conf) from a confidence on, by the taxonomy's order numbers."""
    made = made.where(F.col("conf") >= least)
    ids = dims.select(F.col("sort_order").alias("cat"), F.col("sub_order").alias("sub"), "subcategory_id")
    return made.join(F.broadcast(ids), ["cat", "sub"]).select("question_id", "subcategory_id", F.col("conf").alias("confidence"))
