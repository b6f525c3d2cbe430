"""Shares, trends and distributions by category."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kvizmill.functions.dates import written_date
from kvizmill.operators import shares as S
from kvizmill.operators import trends as T
from kvizmill.plans.registry import query

MODEL = "heron-72b"
P = "(SELECT DISTINCT * FROM packs)"
Q = "(SELECT DISTINCT * FROM questions)"
LAB = "question_topics qt JOIN subcategories s ON s.id = qt.subcategory_id JOIN categories c ON c.id = s.category_id"
DATE = """coalesce(try_cast(CASE WHEN regexp_matches(trim({0}), '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN trim({0})[1:10] END AS DATE),
 CASE WHEN regexp_matches(trim({0}), '^\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}}$') THEN try_strptime(trim({0}), '%d.%m.%Y')::DATE END)"""


def dated(c, model=None):
    """Labelled topics with the year and month their pack was published."""
    day = written_date(F.col("published_date"))
    packs = c.packs.select(F.col("id").alias("pack_id"), day.alias("day")).where("day IS NOT NULL")
    questions = c.question_columns("pack_id").withColumnRenamed("id", "question_id")
    return (
        c.labelled(model)
        .join(questions, "question_id")
        .join(packs, "pack_id")
        .withColumn("year", F.year("day"))
        .withColumn("month", F.date_format("day", "yyyy-MM"))
    )


DATED = f"""(SELECT qt.*, c.name AS category, c.id AS category_id, c.sort_order, s.name AS subcategory, d.day, year(d.day)::INT AS year, strftime(d.day, '%Y-%m') AS month
 FROM {LAB} JOIN {Q} q ON q.id = qt.question_id JOIN (SELECT id, {DATE.format('published_date')} AS day FROM {P}) d ON d.id = q.pack_id WHERE d.day IS NOT NULL)"""


@query(
    "a1_overview",
    f"""SELECT (SELECT count(*) FROM {Q}) AS questions, (SELECT count(*) FROM {P} WHERE parse_status = 'parsed') AS packs,
    count(DISTINCT question_id) AS classified, round_even(100.0 * count(DISTINCT question_id) / (SELECT count(*) FROM {Q}), 1) AS pct
    FROM question_topics WHERE model_name = '{MODEL}'""",
)
def a1(c):
    questions = c.question_columns("pack_id").agg(F.count("*").alias("questions"))
    packs = c.packs.where("parse_status = 'parsed'").agg(F.count("*").alias("packs"))
    done = c.topics.where(F.col("model_name") == MODEL).select("question_id").distinct().agg(F.count("*").alias("classified"))
    return questions.join(F.broadcast(packs)).join(F.broadcast(done)).withColumn("pct", S.percent(F.col("classified"), F.col("questions")))


@query(
    "a2_category_share",
    f"""SELECT category, sort_order, count, round_even(100.0 * count / sum(count) OVER (), 1) AS pct FROM
    (SELECT c.name AS category, c.sort_order, count(DISTINCT question_id) AS count FROM {LAB} GROUP BY ALL)""",
)
def a2(c):
    return S.with_share(S.question_counts(c.labelled(), "category", "sort_order"))


@query(
    "a3_category_share_of_questions",
    f"""SELECT c.name AS category, count(DISTINCT question_id) AS count,
    round(100.0 * count(DISTINCT question_id) / (SELECT count(DISTINCT question_id) FROM question_topics), 1) AS pct FROM {LAB} GROUP BY 1""",
)
def a3(c):
    return S.share_of_distinct(c.topics, S.question_counts(c.labelled(), "category"))


@query(
    "a4_top_subcategories",
    f"""SELECT subcategory, category, count, round_even(100.0 * count / sum(count) OVER (), 1) AS pct FROM
    (SELECT s.name AS subcategory, c.name AS category, count(DISTINCT question_id) AS count FROM {LAB} WHERE c.name = 'history'
     GROUP BY ALL ORDER BY count DESC, subcategory LIMIT 4)""",
)
def a4(c):
    counts = S.question_counts(c.labelled().where("category = 'history'"), "subcategory", "category")
    return S.with_share(S.top(counts, 4, F.col("count").desc(), F.col("subcategory")))


@query(
    "a5_top_subcategories_of_questions",
    f"""SELECT s.name AS subcategory, count(DISTINCT question_id) AS count,
    round(100.0 * count(DISTINCT question_id) / (SELECT count(DISTINCT question_id) FROM question_topics), 1) AS pct
    FROM {LAB} GROUP BY 1 ORDER BY count DESC, 1 LIMIT 15""",
)
def a5(c):
    counts = S.top(S.question_counts(c.labelled(), "subcategory"), 15, F.col("count").desc(), F.col("subcategory"))
    return S.share_of_distinct(c.topics, counts)


@query("a6_monthly_trend", f"SELECT month, category, count(DISTINCT question_id) AS count FROM {DATED} GROUP BY ALL")
def a6(c):
    return S.question_counts(dated(c), "month", "category")


@query("a7_yearly_trend", f"SELECT year, category, count(DISTINCT question_id) AS count FROM {DATED} GROUP BY ALL")
def a7(c):
    return S.question_counts(dated(c), "year", "category")


@query("a8_yearly_subcategories", f"SELECT year, subcategory, category, count(DISTINCT question_id) AS count FROM {DATED} GROUP BY ALL")
def a8(c):
    return S.question_counts(dated(c), "year", "subcategory", "category")


@query(
    "a9_mean_difficulty",
    f"""SELECT c.name AS category, round(avg(q.difficulty), 2) AS mean_difficulty, count(DISTINCT question_id) AS count
    FROM {LAB} JOIN {Q} q ON q.id = qt.question_id WHERE q.difficulty IS NOT NULL GROUP BY 1 HAVING count(DISTINCT question_id) > 5""",
)
def a9(c):
    questions = c.question_columns("difficulty").where("difficulty IS NOT NULL").withColumnRenamed("id", "question_id")
    # Per question first: its difficulty counts once for each topic row, itself once.
    each = c.labelled().join(questions, "question_id").groupBy("category", "question_id").agg(F.sum("difficulty").alias("d"), F.count("*").alias("n"))
    return (
        each.groupBy("category")
        .agg(F.round(F.sum("d") / F.sum("n"), 2).alias("mean_difficulty"), F.count("*").alias("count"))
        .where(F.col("count") > 5)
    )


@query(
    "a10_confidence_stats",
    f"""SELECT c.name AS category, round(avg(confidence), 3) AS mean, round(min(confidence), 3) AS low, round(max(confidence), 3) AS high,
    count(*) AS rows FROM {LAB} WHERE model_name = '{MODEL}' GROUP BY 1""",
)
def a10(c):
    return c.labelled(MODEL).groupBy("category").agg(
        F.round(F.avg("confidence"), 3).alias("mean"), F.round(F.min("confidence"), 3).alias("low"), F.round(F.max("confidence"), 3).alias("high"), F.count("*").alias("rows")
    )


@query("a11_confidence_values", f"SELECT confidence, c.name AS category, model_name FROM {LAB} WHERE confidence IS NOT NULL")
def a11(c):
    return c.labelled().where("confidence IS NOT NULL").select("confidence", "category", "model_name")


@query("a12_difficulty_values", f"SELECT q.difficulty, c.name AS category FROM {LAB} JOIN {Q} q ON q.id = qt.question_id WHERE q.difficulty IS NOT NULL")
def a12(c):
    questions = c.question_columns("difficulty").where("difficulty IS NOT NULL").withColumnRenamed("id", "question_id")
    return c.labelled().join(questions, "question_id").select("difficulty", "category")


@query(
    "a13_confidence_histogram",
    """SELECT least(floor(confidence / 0.04), 24)::INT AS bin, count(*) AS n FROM question_topics WHERE confidence BETWEEN 0 AND 1 GROUP BY 1""",
)
def a13(c):
    return S.histogram(c.topics, "confidence", 0.0, 1.0, 25)


@query(
    "a14_confidence_quartiles",
    f"""SELECT c.name AS category, model_name, min(confidence) AS low, round(quantile_cont(confidence, 0.25), 6) AS q1, round(quantile_cont(confidence, 0.5), 6) AS median,
    round(quantile_cont(confidence, 0.75), 6) AS q3, max(confidence) AS high, count(*) AS n FROM {LAB}
    WHERE confidence IS NOT NULL AND model_name IN ('{MODEL}', 'lynx-pro') GROUP BY ALL""",
)
def a14(c):
    both = c.labelled(MODEL).unionByName(c.labelled("lynx-pro"))
    return S.quartiles(both, "confidence", "category", "model_name")


@query(
    "a18_paired_categories",
    f"""WITH l AS (SELECT DISTINCT question_id, subcategory_id, c.name AS category FROM {LAB})
    SELECT a.category AS category_a, b.category AS category_b, count(DISTINCT a.question_id) AS count FROM l a JOIN l b USING (question_id)
    WHERE a.subcategory_id < b.subcategory_id AND a.category <> b.category GROUP BY ALL HAVING count >= 3 ORDER BY count DESC, 1, 2 LIMIT 20""",
)
def a18(c):
    return S.top(S.paired_categories(c.labelled(), 3), 20, F.col("count").desc(), F.col("category_a"), F.col("category_b"))


@query(
    "a19_rare_subcategories",
    f"""SELECT subcategory, count, round(100.0 * count / total, 2) AS pct FROM (SELECT s.name AS subcategory, count(DISTINCT question_id) AS count,
    sum(count(DISTINCT question_id)) OVER () AS total FROM {LAB} GROUP BY 1) WHERE 100.0 * count / total < 1.0""",
)
def a19(c):
    counts = S.question_counts(c.labelled(), "subcategory").withColumn("_share", F.lit(100.0) * F.col("count") / F.sum("count").over(S.everything()))
    return counts.where("_share < 1.0").select("subcategory", "count", F.round("_share", 2).alias("pct"))


@query(
    "a24_topic_row_share",
    f"""SELECT c.name AS category, count(*) AS rows, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM {LAB} WHERE model_name LIKE '%72b%' GROUP BY 1""",
)
def a24(c):
    rows = c.labelled().where(F.col("model_name").contains("72b")).groupBy("category").agg(F.count("*").alias("rows"))
    return rows.withColumn("pct", F.round(F.lit(100.0) * F.col("rows") / F.sum("rows").over(S.everything()), 6))


@query(
    "a25_subcategory_row_share",
    f"""SELECT c.name AS category, s.name AS subcategory, count(*) AS rows, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY c.name), 6) AS pct
    FROM {LAB} WHERE model_name LIKE '%72b%' GROUP BY 1, 2""",
)
def a25(c):
    rows = c.labelled().where(F.col("model_name").contains("72b")).groupBy("category", "subcategory").agg(F.count("*").alias("rows"))
    return rows.withColumn("pct", F.round(F.lit(100.0) * F.col("rows") / F.sum("rows").over(Window.partitionBy("category")), 6))


YEARLY = f"(SELECT year, category, count(DISTINCT question_id) AS count FROM {DATED} GROUP BY ALL)"


@query(
    "w4_growth_of_rounded_shares",
    f"""WITH y AS (SELECT year, category, count, round(100.0 * count / sum(count) OVER (PARTITION BY year), 1) AS pct, dense_rank() OVER (ORDER BY year DESC) AS k FROM {YEARLY})
    SELECT a.category, a.pct, coalesce(b.pct, 0) AS prev_pct, round(a.pct - coalesce(b.pct, 0), 1) AS delta FROM y a LEFT JOIN y b ON b.category = a.category AND b.k = 2 WHERE a.k = 1""",
)
def w4(c):
    return T.growth_rounded(S.question_counts(dated(c), "year", "category"))


@query(
    "w5_growth_of_shares",
    f"""WITH y AS (SELECT year, category, count, 100.0 * count / sum(count) OVER (PARTITION BY year) AS pct, dense_rank() OVER (ORDER BY year DESC) AS k FROM {YEARLY})
    SELECT coalesce(a.category, b.category) AS category, round_even(round(coalesce(a.pct, 0) - coalesce(b.pct, 0), 9), 1) AS delta
    FROM (SELECT * FROM y WHERE k = 1) a FULL JOIN (SELECT * FROM y WHERE k = 2) b ON b.category = a.category WHERE (SELECT max(k) FROM y) > 1""",
)
def w5(c):
    return T.growth(S.question_counts(dated(c), "year", "category"))


@query(
    "w6_trend_arrow",
    f"""WITH y AS (SELECT year, category, count, round(100.0 * count / sum(count) OVER (PARTITION BY year), 1) AS pct, dense_rank() OVER (ORDER BY year DESC) AS k FROM {YEARLY})
    SELECT a.category, CASE WHEN round(a.pct - coalesce(b.pct, 0), 1) > 0.5 THEN '↑' WHEN round(a.pct - coalesce(b.pct, 0), 1) < -0.5 THEN '↓' ELSE '→' END AS arrow
    FROM y a LEFT JOIN y b ON b.category = a.category AND b.k = 2 WHERE a.k = 1""",
)
def w6(c):
    return w4(c).select("category", T.arrow(F.col("delta")).alias("arrow"))


@query(
    "w7_top_series",
    f"""WITH m AS (SELECT month, category, count(DISTINCT question_id) AS count FROM {DATED} GROUP BY ALL),
    t AS (SELECT category FROM m GROUP BY 1 ORDER BY sum(count) DESC, 1 LIMIT 6) SELECT * FROM m WHERE category IN (FROM t)""",
)
def w7(c):
    series = S.question_counts(dated(c), "month", "category")
    best = S.top(series.groupBy("category").agg(F.sum("count").alias("_n")), 6, F.col("_n").desc(), F.col("category")).select("category")
    return series.join(best, "category", "left_semi").select("month", "category", "count")


@query(
    "w8_group_totals",
    f"""SELECT category, subcategory, count, sum(count) OVER (PARTITION BY category)::BIGINT AS category_total FROM
    (SELECT c.name AS category, s.name AS subcategory, count(DISTINCT question_id) AS count FROM {LAB} GROUP BY ALL)""",
)
def w8(c):
    counts = S.question_counts(c.labelled(), "category", "subcategory")
    return counts.withColumn("category_total", F.sum("count").over(Window.partitionBy("category")))


@query(
    "l12_risers_and_fallers",
    f"""WITH y AS (SELECT year, category, count, round(100.0 * count / sum(count) OVER (PARTITION BY year), 1) AS pct, dense_rank() OVER (ORDER BY year DESC) AS k FROM {YEARLY}),
    g AS (SELECT a.category, round(a.pct - coalesce(b.pct, 0), 1) AS delta FROM y a LEFT JOIN y b ON b.category = a.category AND b.k = 2 WHERE a.k = 1)
    (SELECT 'up' AS side, * FROM g WHERE delta > 0 ORDER BY delta DESC, category LIMIT 5) UNION ALL (SELECT 'down' AS side, * FROM g WHERE delta < 0 ORDER BY delta, category LIMIT 5)""",
)
def l12(c):
    g = w4(c).select("category", "delta")
    up = S.top(g.where("delta > 0"), 5, F.col("delta").desc(), F.col("category")).select(F.lit("up").alias("side"), "*")
    down = S.top(g.where("delta < 0"), 5, F.col("delta"), F.col("category")).select(F.lit("down").alias("side"), "*")
    return up.unionByName(down)


@query(
    "m7_year_matrix",
    f"""SELECT year, {', '.join(f"coalesce(max(count) FILTER (category = '{x}'), 0) AS {x}" for x in ('history', 'science', 'sport'))} FROM {YEARLY} GROUP BY 1""",
)
def m7(c):
    counts = S.question_counts(dated(c), "year", "category")
    return counts.groupBy("year").pivot("category", ["history", "science", "sport"]).agg(F.first("count")).fillna(0)
