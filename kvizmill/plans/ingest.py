"""Merges, increments, numbering and posts (U1-U7, STR1-STR2, STR5, W9, A32, A47-A48, X14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvizmill.functions import text as X
from kvizmill.operators import ingest as I
from kvizmill.plans.registry import query
from kvizmill.plans.shares import P, Q
from kvizmill.streaming.posts import drained_new_posts, drained_window_counts


@query("u1_packs_merged", f"SELECT id, title, CASE WHEN parse_status = 'failed' THEN 'pending' ELSE parse_status END AS parse_status, CASE WHEN parse_status = 'failed' THEN coalesce(question_count, 0) ELSE question_count END AS question_count FROM {P}")
def u1(c):
    old = c.packs.select("id", "title", "parse_status", "question_count")
    again = c.packs.where("parse_status = 'failed'").select("id", F.lit("pending").alias("parse_status"), F.coalesce("question_count", F.lit(0)).alias("question_count"))
    return I.merge(old, again, ["id"])


@query("u2_channels_merged", "SELECT id, username, CASE WHEN expected_category = 'history' THEN title || ' *' ELSE title END AS title FROM tg_channels")
def u2(c):
    old = c.channels.select("id", "username", "title")
    new = c.channels.select("username", F.when(F.col("expected_category") == "history", F.concat("title", F.lit(" *"))).otherwise("").alias("title"))
    return I.merge(old, new.withColumn("title", F.nullif("title", F.lit(""))), ["username"])


@query(
    "u3_topics_once",
    """SELECT question_id, subcategory_id, method, model_name, min(id) AS id FROM question_topics GROUP BY ALL""",
)
def u3(c):
    t = c.topics.select("question_id", "subcategory_id", "method", "model_name", "id")
    return t.groupBy("question_id", "subcategory_id", "method", "model_name").agg(F.min("id").alias("id"))


@query(
    "u3_topics_inserted",
    """WITH k AS (SELECT DISTINCT question_id, subcategory_id, method, model_name FROM question_topics WHERE classified_at < TIMESTAMP '2023-03-01')
    SELECT t.question_id, t.subcategory_id, t.method, t.model_name, min(t.id) AS id FROM question_topics t WHERE t.classified_at >= TIMESTAMP '2023-03-01' AND NOT EXISTS (SELECT 1 FROM k WHERE k.question_id = t.question_id
    AND k.subcategory_id = t.subcategory_id AND k.method = t.method AND k.model_name IS NOT DISTINCT FROM t.model_name) GROUP BY ALL""",
)
def u3_inserted(c):
    keys = ["question_id", "subcategory_id", "method", "model_name"]
    before = F.col("classified_at") < F.lit("2023-03-01").cast("timestamp_ntz")
    return I.insert_ignore(c.topics.where(before).select(*keys, "id"), c.topics.where(~before).select(*keys, "id"), keys, "id")


@query("u4_categories_set", "SELECT id, CASE WHEN category IS NULL OR trim(category) = '' THEN 'none' ELSE lower(trim(category)) END AS category, is_useful AND coalesce(views, 0) > 0 AS is_useful FROM tg_posts")
def u4(c):
    empty = F.trim(F.coalesce("category", F.lit(""))) == ""
    return c.posts.select("id", F.when(empty, "none").otherwise(F.lower(F.trim("category"))).alias("category"), (F.col("is_useful") & (F.coalesce("views", F.lit(0)) > 0)).alias("is_useful"))


@query("u5_labels_deleted", "SELECT id FROM question_topics WHERE NOT (coalesce(model_name, '') = 'noise_probe' AND question_id IN (SELECT q.id FROM questions q JOIN packs p ON p.id = q.pack_id WHERE p.parse_status = 'failed'))")
def u5(c):
    failed = c.table("packs").where("parse_status = 'failed'").select(F.col("id").alias("pack_id"))
    q = c.table("questions").join(failed, "pack_id", "left_semi").select(F.col("id").alias("question_id")).distinct()
    gone = c.topics.where("model_name = 'noise_probe'").join(q, "question_id", "left_semi")
    return I.delete_matching(c.topics.select("id"), gone, "id")


@query("u7_import_without_copies", f"""SELECT count(*) AS rows, count(DISTINCT id) AS ids, min(id) AS first, max(id) AS last FROM (SELECT 1000000 - 1 + row_number() OVER () AS id FROM
 (SELECT DISTINCT lower(trim(answer)) AS k FROM {Q} WHERE source IS NULL) n WHERE k IS NOT NULL AND k NOT IN (SELECT lower(trim(answer)) FROM {Q} WHERE source IS NOT NULL AND answer IS NOT NULL))""")
def u7(c):
    q = c.question_columns("source", "answer").where("answer IS NOT NULL").withColumn("k", F.lower(F.trim("answer")))
    new = I.import_copies_free(q.where("source IS NOT NULL").select("id", "k"), q.where("source IS NULL").select("k"), "k", 1_000_000)
    return new.agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.min("id").alias("first"), F.max("id").alias("last"))


NEW = "(SELECT DISTINCT p.channel_id, p.post_id FROM tg_posts p JOIN tg_channels c ON c.id = p.channel_id WHERE p.post_id > coalesce(c.last_parsed_id, 0))"


@query("str1_new_posts", f"FROM {NEW}")
def str1(c):
    return I.above_mark(c.posts, c.channels)[0].select("channel_id", "post_id")


@query("str1_new_posts_stream", f"FROM {NEW}")
def str1_stream(c):
    return drained_new_posts(c.spark, c.sf_dir, c.channels)


@query("str1_marks", f"SELECT c.id, greatest(coalesce(c.last_parsed_id, 0), coalesce(max(n.post_id), 0)) AS last_parsed_id FROM tg_channels c LEFT JOIN {NEW} n ON n.channel_id = c.id GROUP BY c.id, c.last_parsed_id")
def str1_marks(c):
    return I.above_mark(c.posts, c.channels)[1]


@query("a46_window_counts_stream", "SELECT channel_id, time_bucket(INTERVAL 30 DAY, created_at, TIMESTAMP '1970-01-01') AS start, count(*) AS posts, sum(views)::BIGINT AS views FROM tg_posts GROUP BY ALL")
def a46(c):
    return drained_window_counts(c.spark, c.sf_dir).select("channel_id", F.col("start").cast("timestamp_ntz").alias("start"), "posts", "views")


@query("str2_unprocessed_posts", "SELECT id FROM tg_posts WHERE category IS NULL AND is_useful")
def str2(c):
    return c.posts.where("category IS NULL AND is_useful").select("id")


@query("str5_gaps", f"SELECT id + 1 AS first_missing, nxt - id - 1 AS missing FROM (SELECT id, lead(id) OVER (ORDER BY id) AS nxt FROM (SELECT DISTINCT id FROM packs)) WHERE nxt > id + 1")
def str5(c):
    return I.gap_runs(c.table("packs"))


@query("w9_tours", f"""SELECT id, 1::BIGINT + sum(r) OVER (PARTITION BY pack_id ORDER BY id ROWS UNBOUNDED PRECEDING)::BIGINT AS tour FROM
 (SELECT id, pack_id, CASE WHEN number <= coalesce(lag(number) OVER (PARTITION BY pack_id ORDER BY id), 0) THEN 1 ELSE 0 END AS r FROM {Q})""")
def w9(c):
    return I.tour_numbers(c.question_columns("pack_id", "number")).select("id", F.col("tour"))


@query("a32_post_statistics", "SELECT count(*) AS posts, count(category) AS classified, count(*) FILTER (is_useful) AS useful, count(DISTINCT channel_id) AS channels FROM tg_posts")
def a32(c):
    return c.posts.agg(F.count("*").alias("posts"), F.count("category").alias("classified"), F.count_if("is_useful").alias("useful"), F.countDistinct("channel_id").alias("channels"))


@query("a32_posts_by_category", "SELECT category, count(*) AS n FROM tg_posts WHERE category IS NOT NULL GROUP BY 1")
def a32_categories(c):
    return c.posts.where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))




@query("a47_mask_difficulty", f"""WITH m AS (SELECT pack_id, id AS team, bin(id + 1024) AS mask FROM {Q}), w AS (SELECT pack_id, arg_min(length(mask), (team, mask)) AS width, count(*) AS teams FROM m GROUP BY 1),
 r AS (SELECT w.pack_id, p.position, teams, count(*) FILTER (m.mask[p.position] = '1') AS ok FROM w JOIN (SELECT unnest(range(1, 65)) AS position) p ON p.position <= w.width JOIN m ON m.pack_id = w.pack_id GROUP BY ALL)
 SELECT pack_id, position::INT AS position, round_even((1 - ok / teams) * 10, 1) AS difficulty FROM r""")
def a47(c):
    masks = c.question_columns("pack_id").select("pack_id", F.col("id").alias("team"), F.bin(F.col("id") + 1024).alias("mask"))
    return I.mask_difficulty(masks)


@query("x14_view_counts", "SELECT id, greatest(coalesce(views, 0), 0) AS views FROM tg_posts")
def x14(c):
    return c.posts.select("id", X.view_count(F.col("views").cast("string")).alias("views"))


@query("x14_labels_read", "SELECT id, CASE WHEN views >= 1000000 THEN views // 100000 * 100000 WHEN views >= 1000 THEN views // 100 * 100 ELSE greatest(views, 0) END AS views FROM tg_posts WHERE views IS NOT NULL")
def x14_labels(c):
    """Views from labels like 1.2K."""
    return c.posts.where("views IS NOT NULL").select("id", X.view_count(X.view_label(F.col("views"))).alias("views"))
