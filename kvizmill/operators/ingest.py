"""New rows into existing tables: merges, increments, numbering and parsing.

A table is never changed in place. Each function returns the new version; the
caller writes it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvizmill.session import cut, if_small


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows with the non-null fields of new ones of their key, and the new keys. Columns new doesn't have are kept."""
    fields = [c for c in old.columns if c not in keys]
    renamed = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in fields if c in new.columns])
    both = old.join(renamed, keys, "full")
    return both.select(*keys, *[F.coalesce(f"_{c}", c).alias(c) if c in new.columns else F.col(c) for c in fields])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """New rows whose key isn't there yet, the first of each key in ``order``; null keys are keys like others."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = new.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    there = old.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return first.join(there, on, "left_anti")


def delete_matching(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    return rows.join(keys.select(*columns).distinct(), list(columns), "left_anti")


def import_copies_free(old: DataFrame, new: DataFrame, key: str, first_id: int) -> DataFrame:
    """New rows whose copy key is unknown, once each, numbered on from the largest id.

    The numbers are dense and follow the keys' order.
    """
    fresh = insert_ignore(old, new, [key], key)
    floor = spark_max(old, "id")
    return numbered(fresh, [key], max(floor, first_id - 1))


def spark_max(df: DataFrame, column: str) -> int:
    """The largest value of a column, 0 for none."""
    return df.agg(F.coalesce(F.max(column), F.lit(0)).cast("long").alias("m")).first().m


def numbered(rows: DataFrame, order: list[str], after: int) -> DataFrame:
    """``rows`` with ``id``: after + 1, after + 2 and on in a total order.

    A global range sort, written once; places come from the sizes of its
    partitions, so no task numbers more rows than it holds.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    ordered = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part, nth = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    starts, before = {}, after + 1
    for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():  # a row per partition
        starts[r.p] = before
        before += r.n
    if not starts:
        return ordered.drop("_at").withColumn("id", F.lit(None).cast("long"))
    start = F.element_at(F.create_map(*[F.lit(x) for p, s in starts.items() for x in (p, s)]), part)
    return ordered.withColumn("id", (start + nth).cast("long")).drop("_at")


def append_numbered(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """New rows as they are appended to ``old``: numbered on from its largest ``key``, in ``order``."""
    return numbered(new, order, spark_max(old, key)).withColumnRenamed("id", key)


def migrate(rows: DataFrame, added: dict[str, Column], key: list[str] | None = None) -> DataFrame:
    """An older table in the newer form: columns it lacks, or has nulls in, get a value; rows of one widened ``key`` are told apart no more."""
    for name, value in added.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    return rows.dropDuplicates(key) if key else rows


def seeded(rows: DataFrame, seed: DataFrame) -> DataFrame:
    """``rows``, or where there are none the ``seed``."""
    return rows.unionByName(seed.join(rows.limit(1).select(F.lit(True).alias("_any")), F.col("_any"), "left_anti"))


def above_mark(posts: DataFrame, channels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new posts, new marks): posts beyond their channel's ``last_parsed_id``, once each, and the marks moved on."""
    marks = channels.select(F.col("id").alias("channel_id"), "last_parsed_id")
    beyond = posts.join(if_small(marks), "channel_id").where(F.col("post_id") > F.coalesce("last_parsed_id", F.lit(0)))
    fresh = beyond.groupBy("channel_id", "post_id").agg(F.min("id").alias("id"))
    top = fresh.groupBy("channel_id").agg(F.max("post_id").alias("_top"))
    moved = channels.join(top, channels["id"] == top["channel_id"], "left")
    return fresh, moved.select("id", F.greatest(F.coalesce("last_parsed_id", F.lit(0)), F.coalesce("_top", F.lit(0))).alias("last_parsed_id"))


def tour_numbers(questions: DataFrame) -> DataFrame:
    """``tour``: counts from 1 within a pack and goes up where the question number doesn't (the number before the first is 0)."""
    order = Window.partitionBy("pack_id").orderBy("id")
    reset = F.when(F.col("number") <= F.coalesce(F.lag("number").over(order), F.lit(0)), 1).otherwise(0)
    return questions.withColumn("_r", reset).withColumn("tour", 1 + F.sum("_r").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_r")


def gap_runs(ids: DataFrame, span: int = 1 << 16) -> DataFrame:
    """``first_missing, missing``: runs of missing ids between known ones.

    The next id is looked for within spans of 2^16 ids; only the first and last
    id of a span go on to spans of 2^32, of these to spans of 2^48, of which 64
    bits have no more than 2^16. So no task orders more than 2^17 rows, however
    many or sparse the ids are.
    """
    level = ids.where("id IS NOT NULL").select(F.col("id").cast("long").alias("_low")).distinct().withColumn("_high", F.col("_low"))
    steps = []
    widths = [span]
    while widths[-1] < 1 << 48:
        widths.append(widths[-1] << 16)
    for width in widths:
        level = level.withColumn("_s", F.expr(f"_low div {width}L"))
        steps.append(level.select(F.col("_high").alias("id"), F.lead("_low").over(Window.partitionBy("_s").orderBy("_low")).alias("_next")))
        level = level.groupBy("_s").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    steps.append(level.select(F.col("_high").alias("id"), F.lead("_low").over(Window.orderBy("_s")).alias("_next")))  # at most 2^16 rows
    return (
        reduce(DataFrame.unionByName, steps)
        .where(F.col("_next") > F.col("id") + 1)
        .select((F.col("id") + 1).alias("first_missing"), (F.col("_next") - F.col("id") - 1).alias("missing"))
    )


def mask_difficulty(masks: DataFrame) -> DataFrame:
    """``pack_id, position, difficulty``: (1 - share of right answers) x 10 at each place of the 0/1 masks.

    The width is that of the pack's first mask (by ``team``); what a mask
    hasn't counts as wrong.
    """
    first = masks.groupBy("pack_id").agg(F.min_by(F.length("mask"), F.struct("team", "mask")).alias("_width"), F.count("*").alias("_teams"))
    marks = masks.select("pack_id", F.posexplode(F.split("mask", "")).alias("_at", "_mark"))
    right = marks.groupBy("pack_id", (F.col("_at") + 1).alias("position")).agg(F.count_if(F.col("_mark") == "1").alias("_right"))
    places = first.select("pack_id", "_teams", F.explode(F.sequence(F.lit(1), "_width")).alias("position"))
    share = F.coalesce("_right", F.lit(0)) / F.col("_teams")
    return places.join(right, ["pack_id", "position"], "left").select("pack_id", "position", F.bround((1 - share) * 10, 1).alias("difficulty"))
