"""Problem 6: samples that match target shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvizmill.llm.capping import positions
from kvizmill.session import cut, if_small

#: Prime modulus and multipliers of the random keys.
PRIME, MULTIPLIERS = 2_147_483_647, (1_103_515_245, 48_271)


def _once(members: DataFrame) -> DataFrame:
    return members.where(F.col("item_id").isNotNull() & F.col("plan_id").isNotNull() & F.col("stratum_key").isNotNull()).select(
        "plan_id", "stratum_key", "item_id"
    ).distinct()


def strata_counts(members: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets with ``available``, the number of different items of the stratum.

    ``members`` has ``plan_id, stratum_key, item_id``; repeated rows count once
    and rows with a null count nowhere. A target without members has 0.
    """
    counts = _once(members).groupBy("plan_id", "stratum_key").agg(F.count("*").alias("available"))
    wanted = targets.where(F.col("plan_id").isNotNull() & F.col("stratum_key").isNotNull()).select(
        "plan_id",
        "stratum_key",
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.coalesce("min_rows", F.lit(0)).cast("long").alias("min_rows"),
        F.coalesce("sample_rows", F.lit(0)).cast("long").alias("sample_rows"),
    ).distinct()
    return wanted.join(counts, ["plan_id", "stratum_key"], "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("long"))


def shortfalls(allocated: DataFrame) -> DataFrame:
    """``plan_id, stratum_key`` of the targets of ``allocate`` that are out of reach."""
    return allocated.where("out_of_reach").select("plan_id", "stratum_key").distinct()


def allocate(counted: DataFrame) -> DataFrame:
    """``counted`` with ``quota``, ``short`` and ``out_of_reach``, by largest remainder between floors and caps.

    A stratum's floor is ``min_rows``, its cap what there is of it; a floor
    above the cap is lowered to it. Between these, all strata get the same
    multiple of their shares, the level at which the quotas sum to
    ``sample_rows``: what a floor needs or a cap can't give is so reapportioned
    over the strata that are at neither. The level is found on the sorted
    points where a stratum leaves its floor or reaches its cap, as the sum is
    linear between these. Whole parts are given first, the rows still missing
    one each to the largest remainders, ties to the smaller key. So quotas sum
    to ``sample_rows`` unless the floors alone exceed it (floors win) or there
    are too few items in strata with a share (all are taken). A share that is
    null, zero or negative asks for no more than the floor.

    ``short``: how far the quota stays below the greater of floor and rounded
    share. ``out_of_reach``: fewer items than the greater of floor and share.
    The windows run over the targets of a plan, a table of its strata, not of
    items.
    """
    share = F.greatest(F.col("target_share"), F.lit(0.0))
    base = (
        counted.withColumn("_share", share)
        .withColumn("_floor", F.least(F.greatest(F.col("min_rows"), F.lit(0)), F.col("available")).cast("double"))
        .withColumn("_cap", F.when(F.col("_share") > 0, F.col("available").cast("double")).otherwise(F.col("_floor")))
        .withColumn("_all_floors", F.sum("_floor").over(Window.partitionBy("plan_id")))
    )
    turn = F.inline(
        F.array(
            F.struct((F.col("_floor") / F.col("_share")).alias("_at"), F.col("_share").alias("_slope"), (-F.col("_floor")).alias("_fixed")),
            F.struct((F.col("_cap") / F.col("_share")).alias("_at"), (-F.col("_share")).alias("_slope"), F.col("_cap").alias("_fixed")),
        )
    )
    # After a turning point the quotas sum to _base + _level * _rise, up to the next one.
    turns = base.where("_share > 0").select("plan_id", "sample_rows", "_all_floors", turn)
    by_level = Window.partitionBy("plan_id").orderBy("_at")
    level = turns.select(
        "plan_id",
        "sample_rows",
        "_at",
        F.sum("_slope").over(by_level).alias("_rise"),
        (F.col("_all_floors") + F.sum("_fixed").over(by_level)).alias("_base"),
        F.lead("_at").over(Window.partitionBy("plan_id").orderBy("_at", "_slope")).alias("_next"),
    )
    reached = F.round(F.col("_base") + F.col("_at") * F.col("_rise"), 6) <= F.col("sample_rows")
    rest = F.when(F.col("_rise") > 1e-12, (F.col("sample_rows") - F.col("_base")) / F.col("_rise")).otherwise(F.col("_at"))
    last = F.max_by(F.least(F.greatest(rest, F.col("_at")), F.coalesce("_next", rest)), F.struct("_at", F.coalesce("_next", F.col("_at")).alias("n")))
    level = level.where(reached).groupBy("plan_id").agg(last.alias("_level"))
    part = F.least(F.col("_cap"), F.greatest(F.col("_floor"), F.round(F.coalesce("_level", F.lit(0.0)) * F.col("_share"), 6)))
    order = Window.partitionBy("plan_id").orderBy(F.round(F.col("_part") - F.floor("_part"), 6).desc(), F.col("stratum_key"))
    shared = (
        base.join(level, "plan_id", "left")
        .withColumn("_part", part)
        .withColumn("_left", F.col("sample_rows") - F.sum(F.floor("_part")).over(Window.partitionBy("plan_id")))
        .withColumn("_turn", F.row_number().over(order))
    )
    more = (F.col("_part") > F.floor("_part")) & (F.col("_turn") <= F.col("_left"))
    wanted = F.greatest(F.col("min_rows"), F.round(F.col("target_share") * F.col("sample_rows")).cast("long"))
    return shared.select(
        *counted.columns,
        (F.floor("_part") + F.when(more, 1).otherwise(0)).cast("long").alias("quota"),
    ).select(
        "*",
        F.greatest(F.lit(0), wanted - F.col("quota")).cast("long").alias("short"),
        (F.col("available") < F.greatest(F.col("min_rows").cast("double"), F.col("target_share") * F.col("sample_rows"))).alias("out_of_reach"),
    )


def draw_key(item_id, seed: int):
    """A random but fixed number of an item, in plain arithmetic that any SQL engine repeats."""
    once = F.pmod(F.pmod(item_id, F.lit(PRIME)) * F.lit(MULTIPLIERS[0]) + F.lit(seed), F.lit(PRIME))
    return F.pmod(F.pmod(once, F.lit(65_536)) * F.lit(MULTIPLIERS[1]) + F.floor(once / 65_536), F.lit(PRIME))


def draw(members: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """``plan_id, stratum_key, item_id`` of a sample that keeps the quotas of ``allocate``.

    From each stratum the items with the smallest ``draw_key`` are taken, ties
    by id: the same at every run and on every cluster. Ranks come from a global
    range sort, so that no task sorts a whole stratum. An item in several
    strata can be drawn for each of them; of a target given twice with
    different numbers the larger quota holds.
    """
    quotas = allocate(strata_counts(members, targets)).groupBy("plan_id", "stratum_key").agg(F.max("quota").alias("quota")).where("quota > 0")
    items = (
        _once(members)
        .join(if_small(cut(quotas)), ["plan_id", "stratum_key"])  # a row for each target
        .withColumn("_key", draw_key(F.col("item_id"), seed))
        .withColumn("_stratum", F.concat_ws(":", F.col("plan_id").cast("string"), F.col("stratum_key")))
    )
    placed = positions(items, "_stratum", [F.col("_key").asc(), F.col("item_id").asc()])
    return placed.where(F.col("position") <= F.col("quota")).select("plan_id", "stratum_key", "item_id")


def question_strata(questions: DataFrame, packs: DataFrame, topics: DataFrame, targets: DataFrame) -> DataFrame:
    """Members of the strata of ``targets``: questions by subcategory and by the difficulty of their pack."""
    plans = targets.select("plan_id", "dimension", "stratum_key", "subcategory_id", "low_bound", "high_bound").distinct()
    by_topic = (
        topics.select("question_id", "subcategory_id")
        .distinct()
        .join(if_small(plans.where("dimension = 'subcategory'")), "subcategory_id")
        .select("plan_id", "stratum_key", F.col("question_id").alias("item_id"))
    )
    bands = plans.where("dimension = 'difficulty'").select("plan_id", "stratum_key", "low_bound", "high_bound")
    banded = packs.select(F.col("id").alias("pack_id"), F.col("difficulty").alias("pack_difficulty")).distinct().join(
        if_small(bands), F.expr("low_bound <= pack_difficulty AND pack_difficulty < high_bound")
    )
    by_band = questions.select(F.col("id").alias("item_id"), "pack_id").join(banded, "pack_id").select("plan_id", "stratum_key", "item_id")
    return by_topic.unionByName(by_band)
