"""The tables of one data directory, as operators want them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvizmill.session import cut, if_small, load, spread

#: Columns of questions that hold whole texts.
LONG_COLUMNS = {"text", "comment"}


class Corpus:
    """Lazy tables. ``packs`` and ``questions`` have no rows repeated in full."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)

    def question_columns(self, *columns: str) -> DataFrame:
        """Some columns of the distinct questions; only these are read, and of texts only those are shuffled whose id comes again.

        Repeated rows are few; so where texts are asked for, ids are counted
        first, rows of an id that comes once pass as they are, and the others
        are compared.
        """
        rows = self.table("questions").select("id", *columns)
        if not LONG_COLUMNS.intersection(columns):
            return rows.distinct()
        again = self.table("questions").groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select("id")
        again = if_small(cut(again))
        once = spread(rows.where("id IS NOT NULL")).join(again, "id", "left_anti")
        return once.unionByName(rows.where("id IS NULL").unionByName(rows.join(again, "id", "left_semi")).distinct())

    @cached_property
    def packs(self) -> DataFrame:
        return self.table("packs").distinct()

    @cached_property
    def questions(self) -> DataFrame:
        return self.table("questions").distinct()

    @cached_property
    def topics(self) -> DataFrame:
        return self.table("question_topics")

    @cached_property
    def categories(self) -> DataFrame:
        return self.table("categories")

    @cached_property
    def subcategories(self) -> DataFrame:
        return self.table("subcategories")

    @cached_property
    def dims(self) -> DataFrame:
        """52 rows: subcategory with its category; the taxonomy is fixed, so it may be broadcast."""
        s = self.subcategories.select(
            F.col("id").alias("subcategory_id"), "category_id", F.col("name").alias("subcategory"), F.col("sort_order").alias("sub_order")
        )
        c = self.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"), "sort_order")
        return F.broadcast(s.join(F.broadcast(c), "category_id"))

    def labelled(self, model: str | None = None) -> DataFrame:
        """Topic rows with their subcategory and category, of one model or of all."""
        topics = self.topics if model is None else self.topics.where(F.col("model_name") == model)
        return topics.join(self.dims, "subcategory_id")

    @cached_property
    def posts(self) -> DataFrame:
        return self.table("tg_posts")

    @cached_property
    def channels(self) -> DataFrame:
        return self.table("tg_channels")

    @cached_property
    def attempts(self) -> DataFrame:
        """Events as answers of a quiz: purchases and clicks are right ones."""
        e = self.table("events")
        return e.select(
            F.col("event_id").alias("id"),
            "user_id",
            F.get_json_object("props", "$.k").cast("long").alias("question_id"),
            F.col("ts").alias("attempted_at"),
            F.col("event_type").isin("purchase", "click").alias("knew"),
            F.col("event_type").alias("category"),
            F.col("value").alias("time_seconds"),
        )
