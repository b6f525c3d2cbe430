"""Spaced repetition: the state of each (user, question), what is due, and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvizmill.operators.shares import percent

#: Days until the next review, by box.
BOX_DAYS = (1, 3, 7, 14, 30)
UNNAMED = "Без категории"


def next_review(at: Column, box: Column) -> Column:
    return at + F.make_dt_interval(F.element_at(F.array(*[F.lit(d) for d in BOX_DAYS]), box.cast("int")))


def leitner(attempts: DataFrame) -> DataFrame:
    """``user_id, question_id, box, streak, last_attempt_at, next_review_at`` from all attempts.

    A right answer moves a question up a box, from 1 to 5, a wrong one back to
    1; so the box is 1 + the number of right answers since the last wrong one,
    at most 5. The last wrong answer is put beside each attempt of its key and
    what came after it is counted, on one partitioning by key. Attempts without
    a time, user, question or answer have no effect; of the same time, the
    later id counts as later.
    """
    last = _streaks(attempts)
    return _state(last.select("user_id", "question_id", "streak", F.col("last.attempted_at").alias("last_attempt_at")))


def advance(state: DataFrame, attempts: DataFrame) -> DataFrame:
    """``state`` moved on by later attempts: rows without any stay as they are, new keys begin in the first box."""
    keys = ["user_id", "question_id"]
    now = _streaks(attempts).select(*keys, F.col("streak").alias("_streak"), "wrong_at", F.col("last.attempted_at").alias("_last"))
    both = state.select(*keys, "streak", "last_attempt_at").join(now, keys, "full")
    kept = F.when(F.col("wrong_at").isNull(), F.coalesce("streak", F.lit(0).cast("long"))).otherwise(0)
    return _state(both.select(*keys, (kept + F.coalesce("_streak", F.lit(0))).alias("streak"), F.coalesce("_last", "last_attempt_at").alias("last_attempt_at")))


def _streaks(attempts: DataFrame) -> DataFrame:
    """``user_id, question_id, streak, last, wrong_at``: right answers since the last wrong one, the last attempt and the last wrong one."""
    valid = attempts.where("user_id IS NOT NULL AND question_id IS NOT NULL AND attempted_at IS NOT NULL AND knew IS NOT NULL")
    keys = ["user_id", "question_id"]
    when = F.struct("attempted_at", "id")
    wrong = F.max(F.when(~F.col("knew"), F.col("at"))).over(Window.partitionBy(*keys))
    each = valid.select(*keys, when.alias("at"), "knew").withColumn("wrong_at", wrong)
    return each.groupBy(*keys).agg(
        F.count_if(F.col("knew") & (F.col("wrong_at").isNull() | (F.col("at") > F.col("wrong_at")))).alias("streak"),
        F.max("at").alias("last"),
        F.max("wrong_at").alias("wrong_at"),
    )


def _state(streaks: DataFrame) -> DataFrame:
    box = F.least(F.col("streak") + 1, F.lit(5)).cast("int")
    out = streaks.select("user_id", "question_id", box.alias("box"), "streak", "last_attempt_at")
    return out.withColumn("next_review_at", next_review(F.col("last_attempt_at"), F.col("box")))


def due(state: DataFrame, as_of: Column) -> DataFrame:
    """Questions to review by ``as_of``, oldest first within a user."""
    order = Window.partitionBy("user_id").orderBy("next_review_at", "question_id")
    return state.where(F.col("next_review_at") <= as_of).withColumn("rank", F.row_number().over(order))


def progress(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("user_id").agg(
        F.count("*").alias("total"), F.count_if("knew").alias("right"), F.countDistinct("question_id").alias("questions")
    )


def by_category(attempts: DataFrame, *keys: str) -> DataFrame:
    """Totals per category; a null or empty one is the unnamed."""
    name = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(UNNAMED))
    return attempts.groupBy(*keys, name.alias("category")).agg(F.count("*").alias("total"), F.count_if("knew").alias("right"))


def summary(attempts: DataFrame, *keys: str) -> DataFrame:
    """Per session: total, right, whole per cent, mean seconds (0 without any)."""
    out = attempts.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if("knew").alias("right"), F.round(F.coalesce(F.avg("time_seconds"), F.lit(0.0)), 4).alias("mean_seconds")
    )
    return out.withColumn("pct", percent(F.col("right"), F.col("total"), 0))
