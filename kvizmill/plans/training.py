"""Training: progress, review state and queues (A30-A31, STR3-STR4, U6, U10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvizmill.operators import training as T
from kvizmill.plans.registry import query
from kvizmill.streaming.leitner import streamed_leitner

ATT = """(SELECT event_id AS id, user_id, json_extract_string(props, '$.k')::BIGINT AS question_id, ts AS attempted_at, event_type IN ('purchase', 'click') AS knew, event_type AS category, value AS time_seconds FROM events)"""
STATE = f"""(SELECT user_id, question_id, least(streak + 1, 5)::INT AS box, streak, last_attempt_at, last_attempt_at + [1, 3, 7, 14, 30][least(streak + 1, 5)] * INTERVAL 1 DAY AS next_review_at FROM
 (SELECT user_id, question_id, count(*) FILTER (knew AND (w IS NULL OR (attempted_at, id) > w)) AS streak, max(attempted_at) AS last_attempt_at FROM
 (SELECT *, max((attempted_at, id)) FILTER (NOT knew) OVER (PARTITION BY user_id, question_id) AS w FROM {ATT}) GROUP BY ALL))"""


@query("a30_user_progress", f"SELECT user_id, count(*) AS total, count(*) FILTER (knew) AS right, count(DISTINCT question_id) AS questions FROM {ATT} GROUP BY 1")
def a30(c):
    return T.progress(c.attempts)


@query("a30_progress_by_category", f"SELECT user_id, coalesce(nullif(category, ''), 'Без категории') AS category, count(*) AS total, count(*) FILTER (knew) AS right FROM {ATT} GROUP BY ALL")
def a30_categories(c):
    return T.by_category(c.attempts, "user_id")


@query("a30_boxes", f"SELECT user_id, box, count(*) AS questions FROM {STATE} GROUP BY ALL")
def a30_boxes(c):
    return T.leitner(c.attempts).groupBy("user_id", "box").agg(F.count("*").alias("questions"))


@query("a31_session_summary", f"SELECT user_id, attempted_at::DATE AS day, count(*) AS total, count(*) FILTER (knew) AS right, round_even(100.0 * count(*) FILTER (knew) / count(*), 0) AS pct, round(coalesce(avg(time_seconds), 0), 4) AS mean_seconds FROM {ATT} GROUP BY ALL")
def a31(c):
    return T.summary(c.attempts.withColumn("day", F.to_date("attempted_at")), "user_id", "day")


@query("str3_leitner", f"FROM {STATE}")
def str3(c):
    return T.leitner(c.attempts)


@query("str3_leitner_stream", f"SELECT user_id, question_id, box, streak FROM {STATE}")
def str3_stream(c):
    return streamed_leitner(c.spark, c.sf_dir).select("user_id", "question_id", "box", "streak")


@query("str4_due", f"SELECT user_id, question_id, next_review_at, row_number() OVER (PARTITION BY user_id ORDER BY next_review_at, question_id)::INT AS rank FROM {STATE} WHERE next_review_at <= TIMESTAMP '2024-02-01' QUALIFY rank <= 20")
def str4(c):
    as_of = F.lit("2024-02-01").cast("timestamp_ntz")
    return T.due(T.leitner(c.attempts), as_of).where("rank <= 20").select("user_id", "question_id", "next_review_at", "rank")


@query("str4_due_counts", f"SELECT user_id, count(*) AS due FROM {STATE} WHERE next_review_at <= TIMESTAMP '2024-02-01' GROUP BY 1")
def str4_counts(c):
    as_of = F.lit("2024-02-01").cast("timestamp_ntz")
    return T.leitner(c.attempts).where(F.col("next_review_at") <= as_of).groupBy("user_id").agg(F.count("*").alias("due"))
