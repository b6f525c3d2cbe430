"""Posts as a stream: those beyond the marks, once each, and counts by event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvizmill.session import if_small
from kvizmill.streaming.runs import drained, stream_table

#: How late a row may come: longer than the whole history of the channels.
LATE = "3650 days"


def new_posts(posts: DataFrame, channels: DataFrame, late: str = LATE) -> DataFrame:
    """``channel_id, post_id`` beyond the channel's mark; a post that comes again within ``late`` isn't new.

    The stream keeps the keys of that time as its state, and rows that come
    later than it are dropped, as in any stream with a bounded state: where all
    rows must count, run the batch ``above_mark``, or choose a longer time.
    """
    marks = channels.select(F.col("id").alias("channel_id"), "last_parsed_id")
    beyond = posts.join(if_small(marks), "channel_id").where(F.col("post_id") > F.coalesce("last_parsed_id", F.lit(0)))
    timed = beyond.select("channel_id", "post_id", F.col("created_at").cast("timestamp").alias("created_at"))
    return timed.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["channel_id", "post_id"]).select("channel_id", "post_id")


def window_counts(posts: DataFrame, width: str, late: str) -> DataFrame:
    """Posts and views per channel and window of ``created_at``; later rows than ``late`` are dropped."""
    timed = posts.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return (
        timed.withWatermark("created_at", late)
        .groupBy("channel_id", F.window("created_at", width).alias("w"))
        .agg(F.count("*").alias("posts"), F.sum("views").alias("views"))
        .select("channel_id", F.col("w.start").alias("start"), "posts", "views")
    )


def drained_new_posts(spark: SparkSession, sf_dir: str, channels: DataFrame) -> DataFrame:
    return drained(new_posts(stream_table(spark, sf_dir, "tg_posts"), channels))


def drained_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 30 days. Each batch gives the windows it changed; the fullest state of a window is its last."""
    changes = drained(window_counts(stream_table(spark, sf_dir, "tg_posts"), "30 days", LATE), "update")
    return changes.groupBy("channel_id", "start").agg(F.max("posts").alias("posts"), F.max_by("views", "posts").alias("views"))
