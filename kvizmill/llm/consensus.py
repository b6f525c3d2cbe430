"""Problem 3: consensus of annotators who disagree.

Confidence-aware truth discovery. An annotator's weight is the upper bound of
the chi-squared confidence interval on its error variance, inverted: an
annotator with few labels has a wide interval and so less weight than one of
the same error rate with many. Truths and weights are found in turn.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvizmill.llm import ballots as B
from kvizmill.session import cut, keep

#: Rounds at most, and the mean change of weights from which it is enough.
ROUNDS, STILL = 8, 0.01
#: Width of a step of confidence.
STEP = 0.05
#: Confidences above this are per cents.
PLAIN = 1.5
#: Up to so many sources (annotators by step) their weights are broadcast; beyond, they are a table that is joined.
MANY_SOURCES = 200_000
#: Standard normal quantile of half the risk (0.05) of the interval.
Z = -1.959964
#: Annotators whose shared errors are the same in this part of cases, of at least so many, count as one.
COPY_SHARE, COPY_CASES = 0.75, 20
#: Before any truth is known: two annotators that agree so often, and so much more than with any third, count as one.
TWIN_SHARE, TWIN_LEAD = 0.9, 0.25


def main_labels(topics: DataFrame) -> DataFrame:
    """``question_id, model_name, subcategory_id, confidence``: each annotator's main label of each question.

    The label with the most confidence; a confidence that is null counts as
    the annotator's mean. An annotator most of whose confidences are above 1 in
    earnest (by the median, so that stray values don't matter) writes per cents,
    which are divided by 100, as are single values like that of the others. Ties
    go to the later run, then to the smaller subcategory. Rows whose question,
    annotator or subcategory is null have no say.
    """
    known = topics.where(
        F.col("question_id").isNotNull() & F.col("model_name").isNotNull() & F.col("subcategory_id").isNotNull()
    ).select("question_id", "model_name", "subcategory_id", F.col("confidence").cast("double").alias("confidence"), "classified_at")
    percent = F.col("confidence") / 100
    single = F.when(F.col("confidence") > PLAIN, percent).otherwise(F.col("confidence"))
    scale = known.groupBy("model_name").agg(
        (F.percentile_approx("confidence", 0.5, 1000) > PLAIN).alias("_percent"), F.avg(percent).alias("_if"), F.avg(single).alias("_else")
    )
    own = F.when(F.col("_percent"), F.coalesce(percent, "_if")).otherwise(F.coalesce(single, "_else"))
    scaled = known.join(scale, "model_name").withColumn("confidence", F.coalesce(own, F.lit(0.5)))
    best = F.max_by(
        F.struct("subcategory_id", "confidence"),
        F.struct(F.col("confidence"), F.col("classified_at"), -F.col("subcategory_id")),
    ).alias("_best")
    return scaled.groupBy("question_id", "model_name").agg(best).select("question_id", "model_name", "_best.*")


def _chi_squared_low(n):
    """Low quantile of chi-squared with n degrees of freedom (Wilson and Hilferty), above 0."""
    part = F.lit(2.0) / (F.lit(9.0) * n)
    return F.greatest(n * F.pow(F.greatest(F.lit(1.0) - part + F.lit(Z) * F.sqrt(part), F.lit(0.0)), F.lit(3.0)), F.lit(0.001))


def _with_party(rows: DataFrame, party: dict[str, str]) -> DataFrame:
    """``party`` of each row's annotator, itself where it copies nobody."""
    rows = rows.withColumn("party", F.col("model_name"))
    if not party:
        return rows
    names = rows.sparkSession.createDataFrame(sorted(party.items()), "model_name string, _party string")
    return rows.join(names, "model_name", "left").withColumn("party", F.coalesce("_party", "party")).drop("_party")


def _vote(labels: DataFrame, weights: DataFrame | None, party: dict[str, str] | None = None) -> DataFrame:
    """One row per question: the winning ``truth``, its weight and the runner-up's, shares and counts."""
    weighed = (
        _with_party(labels, party or {}).withColumnRenamed("party", "_party").withColumn("_w", F.lit(1.0))
        if weights is None
        else labels.join(weights.select("model_name", "step", F.col("weight").alias("_w"), F.col("party").alias("_party")), ["model_name", "step"])
    )
    # Of annotators that copy each other, one speaks.
    heard = weighed.groupBy("question_id", "subcategory_id", "_party").agg(F.max("_w").alias("_w"), F.count("*").alias("_n"))
    sums = heard.groupBy("question_id", "subcategory_id").agg(F.sum("_w").alias("_w"), F.sum("_n").alias("_n"), F.count("*").alias("_p"))
    order = Window.partitionBy("question_id").orderBy(F.col("_w").desc(), F.col("_n").desc(), F.col("subcategory_id"))
    ranked = sums.withColumn("_k", F.row_number().over(order))
    first, second = F.col("_k") == 1, F.col("_k") == 2
    return ranked.groupBy("question_id").agg(
        F.max(F.when(first, F.col("subcategory_id"))).alias("truth"),
        F.max(F.when(first, F.col("_w"))).alias("won"),
        F.coalesce(F.max(F.when(second, F.col("_w"))), F.lit(0.0)).alias("next"),
        (F.max(F.when(first, F.col("_w"))) / F.sum("_w")).alias("support"),
        (F.max(F.when(first, F.col("_n"))) / F.sum("_n")).alias("agreement"),
        F.sum("_n").alias("annotators"),
        F.sum("_p").alias("parties"),
    )


def _judged(labels: DataFrame, truths: DataFrame, weights: DataFrame | None) -> DataFrame:
    """``labels`` with ``wrong``: 1.0 where the others' consensus is another label."""
    own = labels.withColumn("weight", F.lit(1.0)) if weights is None else labels.join(weights.select("model_name", "step", "weight"), ["model_name", "step"])
    differs = (F.col("subcategory_id") != F.col("truth")) | (F.col("won") - F.col("weight") < F.col("next"))
    return own.join(truths.where("parties > 1").select("question_id", "truth", "won", "next"), "question_id").select(
        "question_id", "model_name", "step", "subcategory_id", "truth", differs.cast("double").alias("wrong")
    )


def _weigh(judged: DataFrame, party: dict[str, str]) -> DataFrame:
    n = F.col("labels").cast("double")
    weights = (
        judged.groupBy("model_name", "step")
        .agg(F.count("*").alias("labels"), F.sum("wrong").alias("errors"))
        .withColumn("weight", _chi_squared_low(n) / F.greatest(F.col("errors"), F.lit(0.5)))
    )
    return _with_party(weights, party)


def _meetings(labels: DataFrame) -> DataFrame:
    """``a, b, both, same``: how often two annotators a < b met at a question, and the share of the same label.

    A row of ``labels`` meets the other annotators of its question, of which
    there are at most as many as annotators; a question with very many is a
    skewed key of the join, which adaptive execution splits. What is left is a
    row for each two annotators.
    """
    a = labels.select("question_id", F.col("model_name").alias("a"), F.col("subcategory_id").alias("sa"))
    b = labels.select("question_id", F.col("model_name").alias("b"), F.col("subcategory_id").alias("sb"))
    met = a.join(b, "question_id").where("a < b").groupBy("a", "b")
    return met.agg(F.count("*").alias("both"), F.avg((F.col("sa") == F.col("sb")).cast("double")).alias("same")).where(F.col("both") >= COPY_CASES)


def _joined(pairs: DataFrame) -> dict:
    """Annotator -> first of its party, for the few pairs that copy each other."""
    party: dict = {}
    for r in pairs.select("a", "b").orderBy("a", "b").collect():
        one, other = party.get(r.a, r.a), party.get(r.b, r.b)
        first = min(one, other)
        party |= {k: first for k in [r.a, r.b, *(k for k, v in party.items() if v in (one, other))]}
    return party


def _twins(met: DataFrame) -> dict:
    """Parties found without a truth, from ``_meetings``. Left to vote twice, a pair of copies would be the first truth."""
    met = cut(met)
    each = met.select(F.col("a").alias("who"), "same").unionByName(met.select(F.col("b").alias("who"), "same"))
    order = Window.partitionBy("who").orderBy(F.col("same").desc())
    third = each.withColumn("k", F.row_number().over(order)).where("k = 2").select("who", F.col("same").alias("third"))
    best = met.where(F.col("same") >= TWIN_SHARE)
    for side in ("a", "b"):
        best = best.join(third.withColumnsRenamed({"who": side, "third": f"third_{side}"}), side, "left")
    lead = F.col("same") - F.greatest(F.coalesce("third_a", F.lit(1.0)), F.coalesce("third_b", F.lit(1.0)))
    return _joined(best.where(lead >= TWIN_LEAD))


def _moved(before: DataFrame, after: DataFrame) -> float:
    """Mean relative change of the weights, by labels."""
    old = before.select("model_name", "step", F.col("weight").alias("_w"))
    both = after.join(old, ["model_name", "step"])
    change = F.sum(F.col("labels") * F.abs(F.col("weight") - F.col("_w"))) / F.sum(F.col("labels") * F.col("_w"))
    return both.agg(change.alias("c")).first().c or 0.0


def _by_joins(labels: DataFrame, sources: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Truth discovery with weights as a table of any size: each round joins the labels with it."""
    party = _twins(_meetings(labels))
    truths, weights = cut(_vote(labels, None, party)), None
    for k in range(rounds):
        judged = _judged(labels, truths, weights)
        if k == 1:
            met = _meetings(judged.where("subcategory_id <> truth"))
            party = party | _joined(met.where(F.col("same") >= COPY_SHARE))
        # A step that no other annotator has judged has the weight of a coin.
        fresh = sources.join(_weigh(judged, party), ["model_name", "step"], "left").fillna({"labels": 0, "errors": 0.0, "weight": 1.0})
        before, weights = weights, cut(fresh.withColumn("party", F.coalesce("party", "model_name")))
        truths = cut(_vote(labels, weights))
        if k > 1 and _moved(before, weights) < STILL:
            break
    held = labels.join(truths.where("parties > 1").select("question_id", "truth"), "question_id", "left")
    said = held.groupBy("model_name").agg(
        F.count("truth").alias("labels"),
        F.coalesce(F.sum((F.col("subcategory_id") != F.col("truth")).cast("double")), F.lit(0.0)).alias("errors"),
    )
    mean = F.sum(F.col("weight") * F.greatest("labels", F.lit(1))) / F.sum(F.greatest("labels", F.lit(1)))
    annotators = (
        weights.groupBy("model_name")
        .agg(mean.alias("weight"), F.min("party").alias("party"))
        .join(said, "model_name")
        .withColumn("reliability", F.lit(1.0) - F.col("errors") / F.nullif(F.col("labels").cast("double"), F.lit(0.0)))
        .select("model_name", "labels", "errors", "reliability", "weight", "party")
    )
    kept = truths.select("question_id", F.col("truth").alias("subcategory_id"), "annotators", "agreement", "support")
    return kept, annotators


def _by_ballots(labels: DataFrame, sources: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Truth discovery with weights as an array: the labels are shuffled once, a round is a pass over the ballots."""
    spark = labels.sparkSession
    pairs = sorted((r.model_name, r.step) for r in sources.collect())
    names = sorted({m for m, _ in pairs})
    number = {m: i for i, m in enumerate(names)}
    annotator = np.array([number[m] for m, _ in pairs], dtype=np.int64)
    numbered = spark.createDataFrame([(m, st, i) for i, (m, st) in enumerate(pairs)], "model_name string, step int, source int")
    ballots = keep(B.make(labels, numbered))
    weight, party = np.ones(len(pairs)), annotator.copy()

    def met(df: DataFrame) -> DataFrame:
        a, b = F.floor(F.col("pair") / len(names)).cast("int"), (F.col("pair") % len(names)).cast("int")
        return df.where(F.col("both") >= COPY_CASES).select(a.alias("a"), b.alias("b"), "both", (F.col("same") / F.col("both")).alias("same"))

    def joined(found: dict) -> np.ndarray:
        return np.array([found.get(int(p), int(p)) for p in party], dtype=np.int64)

    if len(names) > 1:
        party = joined(_twins(met(B.meetings(ballots, annotator, None, party))))
    for k in range(rounds if pairs else 0):
        votes, errors = B.errors(ballots, weight, party)
        if k == 1 and len(names) > 1:
            wrong = met(B.meetings(ballots, annotator, weight, party))
            party = joined(_joined(wrong.where(F.col("same") >= COPY_SHARE)))
        part = 2 / (9 * np.maximum(votes, 1))
        low = np.maximum(votes * np.maximum(1 - part + Z * np.sqrt(part), 0) ** 3, 0.001)
        # A step that no other annotator has judged has the weight of a coin.
        fresh = np.where(votes > 0, low / np.maximum(errors, 0.5), 1.0)
        moved = (votes * np.abs(fresh - weight)).sum() / max((votes * weight).sum(), 1e-9)
        weight = fresh
        if k > 1 and moved < STILL:
            break
    truths = B.outcome(ballots, weight, party)
    votes, against = B.agreement_with(ballots, weight, party)
    rows = []
    for i, name in enumerate(names):
        mine = annotator == i
        n, counts = votes[mine].sum(), np.maximum(votes[mine], 1)
        first = names[int(party[mine][0])]
        rows.append((name, int(n), float(against[mine].sum()), float(1 - against[mine].sum() / n) if n else None, float((weight[mine] * counts).sum() / counts.sum()), first))
    annotators = spark.createDataFrame(rows, "model_name string, labels long, errors double, reliability double, weight double, party string")
    return truths.select("question_id", F.col("truth").alias("subcategory_id"), "annotators", "agreement", "support"), annotators


def discover(topics: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(consensus, annotators) of ``question_topics`` rows.

    consensus: ``question_id, subcategory_id, annotators, agreement, support``:
    the winning label, how many labelled, the share of them that agree and the
    weighted share. A tie goes to more annotators, then to the smaller
    subcategory. annotators: ``model_name, labels, errors, reliability,
    weight, party``, where reliability is the share of labels that equal the
    consensus of questions with two annotators or more. A question labelled by
    one annotator has that label; an empty table has empty results.
    """
    step = F.floor(F.least(F.col("confidence"), F.lit(1.0)) / F.lit(STEP)).cast("int")
    labels = keep(main_labels(topics).withColumn("step", step).drop("confidence"))
    sources = cut(labels.select("model_name", "step").distinct())
    return (_by_ballots if sources.count() <= MANY_SOURCES else _by_joins)(labels, sources, rounds)


def consensus_of_three(topics: DataFrame) -> DataFrame:
    """``question_id, subcategory_id`` of the questions with at least three different annotators."""
    truths, _ = discover(topics)
    return truths.where("annotators >= 3").select("question_id", "subcategory_id")
