"""Two annotators against each other, and predictions against a gold label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvizmill.session import if_small

#: Rules that are broadcast at most.
RULES = 10_000

from kvizmill.operators.shares import percent


def common_questions(topics: DataFrame, dims: DataFrame, a: str, b: str) -> DataFrame:
    """``question_id, cat_a, cat_b, conf_a, conf_b``: primary topics of the questions that both models labelled.

    One scan and one shuffle: each question keeps the greatest (confidence,
    -subcategory, -id) of either model. Null confidences are least.
    """
    rank = F.struct("confidence", (-F.col("subcategory_id")).alias("s"), (-F.col("id")).alias("i"))
    best = (
        topics.where(F.col("model_name").isin(a, b))
        .groupBy("question_id")
        .agg(F.max(F.when(F.col("model_name") == a, rank)).alias("x"), F.max(F.when(F.col("model_name") == b, rank)).alias("y"))
        .where("x IS NOT NULL AND y IS NOT NULL")
    )
    of = dims.select("subcategory_id", "category_id")
    one, two = of.withColumnsRenamed({"subcategory_id": "_a", "category_id": "cat_a"}), of.withColumnsRenamed({"subcategory_id": "_b", "category_id": "cat_b"})
    return (
        best.withColumn("_a", -F.col("x.s"))
        .withColumn("_b", -F.col("y.s"))
        .join(F.broadcast(one), "_a")
        .join(F.broadcast(two), "_b")
        .select("question_id", "cat_a", "cat_b", F.col("x.confidence").alias("conf_a"), F.col("y.confidence").alias("conf_b"))
    )


def agreement_matrix(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("cat_a", "cat_b").agg(F.count("*").alias("count"))


def dense_matrix(pairs: DataFrame, categories: DataFrame) -> DataFrame:
    """The matrix with a cell for each two categories, 0 where no question is. Categories are a fixed table of 14 rows."""
    a, b = categories.select(F.col("id").alias("cat_a")), categories.select(F.col("id").alias("cat_b"))
    cells = a.join(F.broadcast(b))
    return cells.join(agreement_matrix(pairs), ["cat_a", "cat_b"], "left").fillna({"count": 0})


def agreement(pairs: DataFrame) -> DataFrame:
    same = F.sum((F.col("cat_a") == F.col("cat_b")).cast("long"))
    return pairs.agg(F.count("*").alias("common"), F.coalesce(same, F.lit(0)).alias("same")).withColumn("pct", percent(F.col("same"), F.col("common")))


def cohens_kappa(pairs: DataFrame) -> DataFrame:
    """One row ``kappa``: 0 without questions, 1 where chance agreement is certain."""
    cells = agreement_matrix(pairs)
    a = cells.groupBy(F.col("cat_a").alias("cat")).agg(F.sum("count").alias("na"))
    b = cells.groupBy(F.col("cat_b").alias("cat")).agg(F.sum("count").alias("nb"))
    chance = a.join(b, "cat", "full").agg(F.sum(F.coalesce("na", F.lit(0)) * F.coalesce("nb", F.lit(0))).alias("chance"))
    seen = cells.agg(F.sum("count").alias("n"), F.sum(F.when(F.col("cat_a") == F.col("cat_b"), F.col("count")).otherwise(0)).alias("same"))
    po = F.col("same") / F.col("n")
    pe = F.try_divide(F.col("chance").cast("double"), F.col("n") * F.col("n").cast("double"))
    kappa = F.when(F.coalesce("n", F.lit(0)) == 0, 0.0).when(pe >= 1, 1.0).otherwise(F.round((po - pe) / (1 - pe), 6))
    return seen.join(F.broadcast(chance)).select(kappa.alias("kappa"))


def calibration(judged: DataFrame) -> DataFrame:
    """Accuracy of ``ok`` by step of ``confidence``."""
    step = F.when(F.col("confidence") < 0.5, "<0.5").when(F.col("confidence") < 0.7, "0.5-0.7").when(F.col("confidence") < 0.9, "0.7-0.9").otherwise(">=0.9")
    return judged.where("confidence IS NOT NULL").groupBy(step.alias("step")).agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("ok").cast("double")), 4).alias("accuracy")
    )


def runs(topics: DataFrame) -> DataFrame:
    """Runs of labelling (model, method, month), the latest first: start, end, labels and questions."""
    month = F.to_date(F.date_trunc("month", "classified_at")).alias("month")
    made = topics.where("classified_at IS NOT NULL").groupBy("model_name", "method", month)
    return made.agg(
        F.min("classified_at").alias("started_at"), F.max("classified_at").alias("finished_at"), F.count("*").alias("labels"), F.countDistinct("question_id").alias("questions")
    ).orderBy(F.col("started_at").desc())


def token_estimate(questions: DataFrame, topics: DataFrame, input_tokens: int = 1600, output_tokens: int = 40) -> DataFrame:
    """``model_name, questions, input_tokens, output_tokens``: what labelling the questions a model hasn't labelled would take."""
    known = questions.select(F.col("id").alias("question_id")).distinct()
    done = topics.where("model_name IS NOT NULL").select("model_name", "question_id").distinct().join(known, "question_id", "left_semi")
    left = done.groupBy("model_name").agg(F.count("*").alias("_done")).join(F.broadcast(known.agg(F.count("*").alias("_n"))))  # one row
    rest = (F.col("_n") - F.col("_done")).alias("questions")
    return left.select("model_name", rest).select("*", (F.col("questions") * input_tokens).alias("input_tokens"), (F.col("questions") * output_tokens).alias("output_tokens"))


def dispute(labelled: DataFrame, confused: list[tuple[str, str]], logic: str, primary: str | None = None, confused_only: bool = False) -> DataFrame:
    """``question_id, score, reasons`` from a question's two surest topics; of those whose first category has ``primary`` in its name, or of confused pairs only.

    3 for a first confidence under .6 (1 under .7), 3 for a lead under .05 (2
    under .1), 2 for a known pair of confused categories, 1 for the logic category.
    """
    order = Window.partitionBy("question_id").orderBy(F.col("confidence").desc_nulls_last(), "subcategory_id", "id")
    ranked = labelled.withColumn("k", F.row_number().over(order)).where("k <= 2")
    first, second = F.col("k") == 1, F.col("k") == 2
    two = ranked.groupBy("question_id").agg(
        F.max(F.when(first, F.col("confidence"))).alias("c1"),
        F.max(F.when(second, F.col("confidence"))).alias("c2"),
        F.max(F.when(first, F.col("category"))).alias("cat1"),
        F.max(F.when(second, F.col("category"))).alias("cat2"),
    )
    lead = F.round(F.col("c1") - F.col("c2"), 9)
    pair = F.concat_ws(">", "cat1", "cat2").isin([f"{a}>{b}" for a, b in confused])
    parts: list[tuple[Column, Column]] = [
        (F.when(F.col("c1") < 0.6, 3).when(F.col("c1") < 0.7, 1).otherwise(0), F.when(F.col("c1") < 0.7, "low_confidence")),
        (F.when(lead < 0.05, 3).when(lead < 0.1, 2).otherwise(0), F.when(lead < 0.1, "close")),
        (F.when(pair, 2).otherwise(0), F.when(pair, "confused")),
        (F.when(F.col("cat1") == logic, 1).otherwise(0), F.when(F.col("cat1") == logic, "logic")),
    ]
    score = sum((p for p, _ in parts[1:]), parts[0][0])
    if primary is not None:
        two = two.where(F.contains(F.lower("cat1"), F.lit(primary.lower())))
    if confused_only:
        two = two.where(pair)
    return two.select("question_id", score.alias("score"), F.concat_ws(",", *[r for _, r in parts]).alias("reasons"))


def keyword_scores(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """``id, category, score``: sum of the weights of a category's keywords that are in the question (2), answer (1.5) or comment (1).

    ``keywords`` (keyword, category) is a table of rules; while it is small, all
    are tried in one pass over the texts.
    """
    hit = lambda column, w: F.when(F.contains(F.lower(F.coalesce(column, F.lit(""))), F.col("keyword")), w).otherwise(0.0)
    score = hit("text", 2.0) + hit("answer", 1.5) + hit("comment", 1.0)
    return (
        texts.join(if_small(keywords, RULES))
        .withColumn("s", score)
        .where("s > 0")
        .groupBy("id", "category")
        .agg(F.sum("s").alias("score"))
    )


def keyword_topics(scores: DataFrame) -> DataFrame:
    """The best category of each text, and the second if it has at least 2.5 and .55 of the first."""
    order = Window.partitionBy("id").orderBy(F.col("score").desc(), "category")
    ranked = scores.withColumn("rank", F.row_number().over(order)).withColumn("best", F.first("score").over(order))
    enough = (F.col("rank") == 1) | ((F.col("rank") == 2) & (F.col("score") >= F.greatest(F.lit(2.5), F.col("best") * 0.55)))
    confidence = F.when(F.col("score") >= 6, 0.95).when(F.col("score") >= 4, 0.85).when(F.col("score") >= 2, 0.7).otherwise(0.55) - F.when(F.col("rank") == 2, 0.15).otherwise(0.0)
    return ranked.where(enough).select("id", "category", "rank", "score", F.round(F.greatest(F.lit(0.4), F.least(F.lit(0.95), confidence)), 2).alias("confidence"))
