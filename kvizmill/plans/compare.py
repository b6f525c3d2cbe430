"""Annotators compared, accuracy, calibration and disputes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kvizmill.functions import text as X
from kvizmill.operators import compare as C
from kvizmill.operators import shares as S
from kvizmill.plans.browse import HASH
from kvizmill.plans.registry import query
from kvizmill.plans.shares import LAB, Q

A, B = "heron-72b", "lynx-pro"


def _best(model):
    return f"""(SELECT question_id, category_id, c.name AS category, confidence, subcategory_id FROM (SELECT * FROM question_topics WHERE model_name = '{model}'
    QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY confidence DESC NULLS LAST, subcategory_id, id) = 1) t
    JOIN subcategories s ON s.id = t.subcategory_id JOIN categories c ON c.id = s.category_id)"""


COMMON = f"(SELECT question_id, a.category_id AS cat_a, b.category_id AS cat_b, a.confidence AS conf_a, b.confidence AS conf_b FROM {_best(A)} a JOIN {_best(B)} b USING (question_id))"


def pairs(c):
    return C.common_questions(c.topics, c.dims, A, B)


@query("m1_common_questions", f"FROM {COMMON}")
def m1(c):
    return pairs(c)


@query("m2_agreement_matrix", f"SELECT cat_a, cat_b, count(*) AS count FROM {COMMON} GROUP BY ALL")
def m2(c):
    return C.agreement_matrix(pairs(c))


@query("m3_dense_matrix", f"SELECT a.id AS cat_a, b.id AS cat_b, count(m.question_id) AS count FROM categories a CROSS JOIN categories b LEFT JOIN {COMMON} m ON m.cat_a = a.id AND m.cat_b = b.id GROUP BY ALL")
def m3(c):
    return C.dense_matrix(pairs(c), c.categories)


@query("m4_agreement", f"SELECT count(*) AS common, count(*) FILTER (cat_a = cat_b) AS same, round_even(100.0 * count(*) FILTER (cat_a = cat_b) / count(*), 1) AS pct FROM {COMMON}")
def m4(c):
    return C.agreement(pairs(c))


@query(
    "m5_kappa",
    f"""WITH m AS (FROM {COMMON}), n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (cat_a = cat_b) AS same FROM m),
    e AS (SELECT sum(a.k * b.k) AS chance FROM (SELECT cat_a AS cat, count(*)::DOUBLE AS k FROM m GROUP BY 1) a JOIN (SELECT cat_b AS cat, count(*)::DOUBLE AS k FROM m GROUP BY 1) b USING (cat))
    SELECT round((same / n - chance / n / n) / (1 - chance / n / n), 6) AS kappa FROM n, e""",
)
def m5(c):
    return C.cohens_kappa(pairs(c))


@query(
    "m6_disagreements",
    f"""SELECT question_id, q.text, cat_a, cat_b FROM {COMMON} m JOIN {Q} q ON q.id = m.question_id WHERE cat_a <> cat_b AND q.text LIKE '%ведущ%'
    ORDER BY {HASH.format('question_id', 11)}, question_id LIMIT 20""",
)
def m6(c):
    differ = pairs(c).where("cat_a <> cat_b")
    q = c.question_columns("text").where(F.contains("text", F.lit("ведущ"))).withColumnRenamed("id", "question_id")
    return differ.join(q, "question_id").orderBy(X.shuffle_key(F.col("question_id"), 11), "question_id").limit(20).select("question_id", "text", "cat_a", "cat_b")


GOLD = _best("editor_desk")


def judged(c, model):
    """Gold category (the editors' first) and a model's categories, surest first, per question."""
    gold = S.primary_topics(c.topics.where("model_name = 'editor_desk'"), "question_id").join(c.dims, "subcategory_id").select("question_id", F.col("category").alias("gold"))
    rows = c.labelled(model).select("question_id", "category", "confidence", "subcategory_id", "id")
    order = Window.partitionBy("question_id").orderBy(F.col("confidence").desc_nulls_last(), "subcategory_id", "id")
    return rows.withColumn("k", F.row_number().over(order)).join(gold, "question_id")


def hits(c, *models):
    """Whether any label of each model is the gold one, per question; one scan for all models."""
    gold = S.primary_topics(c.topics.where("model_name = 'editor_desk'"), "question_id").join(c.dims, "subcategory_id").select("question_id", F.col("category").alias("gold"))
    rows = c.labelled().where(F.col("model_name").isin(*models)).join(gold, "question_id")
    return rows.groupBy("model_name", "question_id", "gold").agg(F.bool_or(F.col("category") == F.col("gold")).alias("ok"))


@query(
    "m8_accuracy",
    f"""WITH g AS (SELECT question_id, category AS gold FROM {GOLD}), h AS (SELECT qt.model_name, g.question_id, g.gold, bool_or(c.name = g.gold) AS ok
    FROM {LAB} JOIN g ON g.question_id = qt.question_id WHERE qt.model_name IN ('{A}', '{B}', 'finch-3b') GROUP BY ALL)
    SELECT model_name, gold, count(*) AS n, count(*) FILTER (ok) AS right FROM h GROUP BY ALL""",
)
def m8(c):
    out = hits(c, A, B, "finch-3b")
    return out.groupBy("model_name", "gold").agg(F.count("*").alias("n"), F.count_if("ok").alias("right"))


@query(
    "m8_right_and_wrong",
    f"""WITH g AS (SELECT question_id, category AS gold FROM {GOLD}), h AS (SELECT qt.model_name, g.question_id, bool_or(c.name = g.gold) AS ok FROM {LAB} JOIN g ON g.question_id = qt.question_id GROUP BY ALL)
    SELECT question_id FROM h WHERE model_name = '{A}' AND ok AND question_id IN (SELECT question_id FROM h WHERE model_name = 'finch-3b' AND NOT ok)""",
)
def m8_sets(c):
    both = hits(c, A, "finch-3b").groupBy("question_id").agg(
        F.bool_or((F.col("model_name") == A) & F.col("ok")).alias("a"), F.bool_or((F.col("model_name") == "finch-3b") & ~F.col("ok")).alias("b")
    )
    return both.where("a AND b").select("question_id")


@query(
    "m9_top_two_accuracy",
    f"""WITH g AS (SELECT question_id, category AS gold FROM {GOLD}), r AS (SELECT qt.question_id, c.name AS category, row_number() OVER (PARTITION BY qt.question_id
    ORDER BY confidence DESC NULLS LAST, subcategory_id, qt.id) AS k FROM {LAB} WHERE model_name = '{B}')
    SELECT gold, count(DISTINCT question_id) AS n, count(*) FILTER (k = 1 AND category = gold) AS first, count(DISTINCT question_id) FILTER (k <= 2 AND category = gold) AS first_two
    FROM r JOIN g USING (question_id) GROUP BY 1""",
)
def m9(c):
    each = judged(c, B).groupBy("question_id", "gold").agg(
        F.bool_or((F.col("k") == 1) & (F.col("category") == F.col("gold"))).alias("one"), F.bool_or((F.col("k") <= 2) & (F.col("category") == F.col("gold"))).alias("two")
    )
    return each.groupBy("gold").agg(F.count("*").alias("n"), F.count_if("one").alias("first"), F.count_if("two").alias("first_two"))


@query(
    "m10_calibration",
    f"""WITH g AS (SELECT question_id, category AS gold FROM {GOLD}) SELECT CASE WHEN confidence < 0.5 THEN '<0.5' WHEN confidence < 0.7 THEN '0.5-0.7' WHEN confidence < 0.9 THEN '0.7-0.9' ELSE '>=0.9' END AS step,
    count(*) AS n, round(avg((b.category = g.gold)::INT), 4) AS accuracy FROM {_best(A)} b JOIN g USING (question_id) WHERE confidence IS NOT NULL GROUP BY 1""",
)
def m10(c):
    return C.calibration(judged(c, A).where("k = 1").withColumn("ok", F.col("category") == F.col("gold")))


KEYWORDS = [("фреск", "visual_arts"), ("натюрморт", "visual_arts"), ("вратар", "sport"), ("шайб", "sport"), ("суффикс", "linguistics"), ("глагол", "linguistics"), ("сервер", "software"), ("оркестр", "music"), ("сонат", "music"), ("пирог", "food_home"), ("храм", "belief"), ("журавл", "wildlife")]


@query(
    "m11_keyword_topics",
    f"""WITH k AS (SELECT * FROM (VALUES {', '.join(map(str, KEYWORDS))}) k(keyword, category)),
    s AS (SELECT id, category, sum(w) AS score FROM (SELECT q.id, k.category, 2.0 * contains(lower(coalesce(text, '')), keyword)::INT + 1.5 * contains(lower(coalesce(answer, '')), keyword)::INT
    + 1.0 * contains(lower(coalesce(comment, '')), keyword)::INT AS w FROM {Q} q CROSS JOIN k) WHERE w > 0 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, category) AS rank, max(score) OVER (PARTITION BY id) AS best FROM s)
    SELECT id, category, rank::INT AS rank, score::DOUBLE AS score, round(greatest(0.4, least(0.95, (CASE WHEN score >= 6 THEN 0.95 WHEN score >= 4 THEN 0.85 WHEN score >= 2 THEN 0.7 ELSE 0.55 END)
    - (CASE WHEN rank = 2 THEN 0.15 ELSE 0 END))), 2)::DOUBLE AS confidence FROM r WHERE rank = 1 OR (rank = 2 AND score >= greatest(2.5, 0.55 * best))""",
)
def m11(c):
    keywords = c.spark.createDataFrame(KEYWORDS, "keyword string, category string")
    return C.keyword_topics(C.keyword_scores(c.question_columns("text", "answer", "comment"), keywords))


@query(
    "m12_relabelled",
    f"""SELECT a.category AS before, b.category AS after, count(*) AS n FROM {_best('tern-14b')} a JOIN {_best('tern-14b-short')} b USING (question_id) GROUP BY ALL""",
)
def m12(c):
    moved = C.common_questions(c.topics, c.dims, "tern-14b", "tern-14b-short")
    names = c.categories.select("id", "name")
    before, after = names.select(F.col("id").alias("cat_a"), F.col("name").alias("before")), names.select(F.col("id").alias("cat_b"), F.col("name").alias("after"))
    return moved.join(F.broadcast(before), "cat_a").join(F.broadcast(after), "cat_b").groupBy("before", "after").agg(F.count("*").alias("n"))


CONFUSED = [("software", "literature"), ("software", "music"), ("wildlife", "science"), ("science", "wildlife"), ("history", "law_state"), ("law_state", "history"), ("history", "literature"), ("music", "screen_stage"), ("screen_stage", "music")]


DISPUTES = f"""WITH r AS (SELECT qt.question_id, c.name AS category, confidence, row_number() OVER (PARTITION BY question_id ORDER BY confidence DESC NULLS LAST, subcategory_id, qt.id) AS k FROM {LAB} WHERE model_name = '{A}'),
    t AS (SELECT question_id, max(confidence) FILTER (k = 1) AS c1, max(confidence) FILTER (k = 2) AS c2, max(category) FILTER (k = 1) AS cat1, max(category) FILTER (k = 2) AS cat2 FROM r WHERE k <= 2 GROUP BY 1),
    s AS (SELECT *, round(c1 - c2, 9) AS lead, coalesce((cat1 || '>' || cat2) IN ({', '.join(f"'{a}>{b}'" for a, b in CONFUSED)}), false) AS pair FROM t)
    SELECT question_id, CASE WHEN c1 < 0.6 THEN 3 WHEN c1 < 0.7 THEN 1 ELSE 0 END + CASE WHEN lead < 0.05 THEN 3 WHEN lead < 0.1 THEN 2 ELSE 0 END + CASE WHEN pair THEN 2 ELSE 0 END
    + CASE WHEN cat1 = 'software' THEN 1 ELSE 0 END AS score, concat_ws(',', CASE WHEN c1 < 0.7 THEN 'low_confidence' END, CASE WHEN lead < 0.1 THEN 'close' END, CASE WHEN pair THEN 'confused' END,
    CASE WHEN cat1 = 'software' THEN 'logic' END) AS reasons, cat1, pair FROM s"""


@query("w10_disputes", f"SELECT question_id, score, reasons FROM ({DISPUTES})")
def w10(c):
    return C.dispute(c.labelled(A), CONFUSED, "software")


@query("a33_status_by_model", "SELECT coalesce(model_name, '*') AS model_name, count(DISTINCT question_id) AS n FROM question_topics GROUP BY ROLLUP (model_name) HAVING model_name IS NOT NULL OR grouping(model_name) = 1")
def a33(c):
    once = c.topics.select("model_name", "question_id").distinct()
    each = once.where("model_name IS NOT NULL").groupBy("model_name").agg(F.count("*").alias("n"))
    every = once.select("question_id").distinct().agg(F.count("*").alias("n")).select(F.lit("*").alias("model_name"), "n")
    return each.unionByName(every)
