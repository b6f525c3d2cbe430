"""Text functions, answer and word frequencies, facts (X3-X7, X9-X10, X12-X18, X31-X32, A37-A42, M14, STR6-STR7, S5, L7)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kvizmill.functions import text as X
from kvizmill.functions.dates import written_date
from kvizmill.operators import mining as M
from kvizmill.operators import shares as S
from kvizmill.plans.registry import query
from kvizmill.plans.shares import DATE, P, Q

CLEAN = """trim(rtrim(trim(translate(replace(regexp_replace({0}, '\\[([^\\]]*)\\]', '\\1', 'g'), chr(160), ' '), chr(769) || '«»"„“”', '')), '.'))"""
ANSWERS = f"(SELECT id, pack_id, {CLEAN.format('answer')} AS a FROM {Q} WHERE trim(coalesce(answer, '')) <> '')"
NUMBERED = "list_filter(list_transform(regexp_split_to_array({0}, '\\d+\\)\\s*'), lambda e: trim(rtrim(trim(e), '.'))), lambda e: e <> '')"
DOTTED = "list_filter(list_transform(string_split({0}, '. '), lambda e: trim(e)), lambda e: e <> '')"
SPLIT = f"""CASE WHEN len({NUMBERED}) > 1 THEN {NUMBERED} WHEN len({DOTTED}) > 1 AND len(list_filter({DOTTED}, lambda e: length(e) >= 50)) = 0 AND NOT regexp_matches({{0}}, '^\\d') THEN {DOTTED} ELSE [{{0}}] END"""
KEY = "replace(lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))), 'ё', 'е')"
TOKENS = f"regexp_extract_all({KEY}, '[а-яa-z0-9]+')"
FRAG = f"(SELECT id, pack_id, fragment, CASE WHEN len({TOKENS.format('fragment')}) > 0 THEN array_to_string({TOKENS.format('fragment')}, ' ') ELSE {KEY.format('fragment')} END AS key FROM (SELECT id, pack_id, unnest({SPLIT.format('a')}) AS fragment FROM {ANSWERS}))"
STOP = ", ".join(f"'{w}'" for w in M.STOP_WORDS)
WORDS = f"(SELECT id, list_filter(regexp_extract_all({KEY.format('text')}, '[а-яa-z]{{{{3,}}}}'), lambda w: w NOT IN ({STOP})) AS w FROM {{0}} WHERE text IS NOT NULL)"


def parts(c):
    return M.fragments(c.question_columns("pack_id", "answer"))


@query("x3_clean_answers", f"SELECT id, a FROM {ANSWERS}")
def x3(c):
    return c.question_columns("answer").where(F.trim("answer") != "").select("id", X.clean_answer(F.col("answer")).alias("a"))


@query("x4_x5_answer_fragments", f"SELECT id, fragment, key FROM {FRAG}")
def x4(c):
    return parts(c).select("id", "fragment", "key")


@query("x6_numeric_answers", f"SELECT id, regexp_full_match(lower(trim(a)), '\\d{{1,4}}([./:-]\\d{{1,4}})*|\\d+[,.]\\d+') OR lower(trim(a)) IN ('π', 'пи', 'pi') AS numeric FROM {ANSWERS}")
def x6(c):
    return x3(c).select("id", X.is_numeric_like(F.col("a")).alias("numeric"))


@query(
    "x7_rejected_answers",
    f"""SELECT key, CASE WHEN key = '' THEN 'empty' WHEN regexp_full_match(key, '[^\\p{{L}}\\p{{N}}]+') THEN 'punctuation_only' WHEN key IN ({', '.join(f"'{a}'" for a in X.EMPTY_ANSWERS)}) THEN 'stop_answer'
    WHEN regexp_full_match(key, '\\d{{1,4}}([./:-]\\d{{1,4}})*|\\d+[,.]\\d+') OR key IN ('π', 'пи', 'pi') THEN NULL WHEN len(regexp_extract_all(key, '[а-яёa-z0-9]+')) = 0 THEN 'no_tokens'
    WHEN len(regexp_extract_all(key, '[а-яёa-z0-9]+')) = 1 AND length(regexp_extract_all(key, '[а-яёa-z0-9]+')[1]) <= 1 THEN 'too_short_single_token'
    WHEN len(regexp_extract_all(key, '[а-яёa-z0-9]+')) = 1 AND regexp_extract_all(key, '[а-яёa-z0-9]+')[1] IN ({', '.join(f"'{a}'" for a in X.EMPTY_ANSWERS)}) THEN 'stop_single_token' END AS reason FROM (SELECT DISTINCT key FROM {FRAG})""",
)
def x7(c):
    return parts(c).select("key").distinct().withColumn("reason", X.low_info_reason(F.col("key")))


@query("x9_text_keys", f"SELECT id, {KEY.format('title')} AS key FROM {P} WHERE title IS NOT NULL")
def x9(c):
    return c.packs.where("title IS NOT NULL").select("id", X.text_key(F.col("title")).alias("key"))


@query("x13_written_dates", f"SELECT id, {DATE.format('published_date')} AS published FROM {P}")
def x13(c):
    return c.packs.select("id", written_date(F.col("published_date")).alias("published"))


@query(
    "x15_view_labels",
    """SELECT id, CASE WHEN views >= 1000000 THEN format('{:.1f}M', floor(views / 100000) / 10) WHEN views >= 1000 THEN format('{:.1f}K', floor(views / 100) / 10) ELSE views::VARCHAR END AS label FROM tg_posts WHERE views IS NOT NULL""",
)
def x15(c):
    return c.posts.where("views IS NOT NULL").select("id", X.view_label(F.col("views")).alias("label"))


@query("x16_slugs", f"SELECT id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(title)), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '[\\s_-]+', '-', 'g'), '^-+|-+$', '', 'g')[1:80], ''), 'topic') AS slug FROM {P} WHERE title IS NOT NULL")
def x16(c):
    return c.packs.where("title IS NOT NULL").select("id", X.slug(F.col("title")).alias("slug"))


@query(
    "x32_labels",
    f"""SELECT id, CASE WHEN length(title) > 20 THEN title[1:19] || '…' ELSE title END AS short, replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html,
    CASE WHEN question_count % 100 BETWEEN 11 AND 14 THEN 'вопросов' WHEN question_count % 10 = 1 THEN 'вопрос' WHEN question_count % 10 BETWEEN 2 AND 4 THEN 'вопроса' ELSE 'вопросов' END AS noun FROM {P} WHERE question_count IS NOT NULL""",
)
def x32(c):
    return c.packs.where("question_count IS NOT NULL").select(
        "id", X.truncate(F.col("title"), 20).alias("short"), X.escape_html(F.col("title")).alias("html"), X.plural(F.col("question_count"), "вопрос", "вопроса", "вопросов").alias("noun")
    )


@query(
    "a37_answer_frequency",
    f"""WITH f AS (FROM {FRAG}), n AS (SELECT key, fragment, count(*) AS n FROM f GROUP BY ALL)
    SELECT key, sum(n)::BIGINT AS count, (SELECT count(DISTINCT pack_id) FROM f WHERE f.key = n.key) AS packs, arg_max(fragment, (n, fragment)) AS display FROM n GROUP BY key HAVING sum(n) >= 2""",
)
def a37(c):
    return M.answer_frequency(parts(c)).where(F.col("count") >= 2).select("key", "count", "packs", "display")


@query("a37_postings", f"SELECT DISTINCT key, id AS question_id FROM {FRAG} WHERE key IN (SELECT key FROM {FRAG} GROUP BY 1 HAVING count(*) >= 2)")
def a37_postings(c):
    return M.postings(parts(c), 2)


@query("a36_available_by_answer", f"SELECT count(DISTINCT id) AS n FROM {FRAG} WHERE key IN (SELECT key FROM {FRAG} GROUP BY 1 HAVING count(*) >= 2)")
def a36(c):
    return M.postings(parts(c), 2).select("question_id").distinct().agg(F.count("*").alias("n"))


@query("a38_word_frequency", f"SELECT word, count(*) AS count FROM (SELECT unnest(w) AS word FROM {WORDS.format(Q)}) GROUP BY 1 HAVING count(*) >= 3")
def a38(c):
    return M.frequency(M.words(c.question_columns("text")), "word", 3)


@query("a38_bigram_frequency", f"SELECT bigram, count(*) AS count FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM {WORDS.format(Q)}) GROUP BY 1 HAVING count(*) >= 3")
def a38_bigrams(c):
    return M.frequency(M.bigrams(c.question_columns("text")), "bigram", 3)


@query("a39_names", f"SELECT name, count(*) AS count FROM (SELECT unnest(regexp_extract_all(text, '[а-яёa-z,] (\\p{{Lu}}\\p{{Ll}}+(?: \\p{{Lu}}\\p{{Ll}}+)*)', 1)) AS name FROM {Q} WHERE text IS NOT NULL) GROUP BY 1 HAVING count(*) >= 2")
def a39(c):
    return M.entities(c.question_columns("text")).where(F.col("count") >= 2)


@query("a40_top_words", f"SELECT word, count(*) AS count FROM (SELECT unnest(w) AS word FROM {WORDS.format('tg_posts')}) GROUP BY 1 ORDER BY count DESC, word LIMIT 100")
def a40(c):
    return S.top(M.frequency(M.words(c.posts.select("id", "text")), "word"), 100, F.col("count").desc(), F.col("word"))


ALIASES = {"software": "science", "wildlife": "science"}
ITEMS = f"SELECT c.name AS category, f.key, count(*) AS count FROM {FRAG} f JOIN question_topics qt ON qt.question_id = f.id JOIN subcategories s ON s.id = qt.subcategory_id JOIN categories c ON c.id = s.category_id GROUP BY ALL"


def items(c):
    return parts(c).join(c.labelled().select(F.col("question_id").alias("id"), "category"), "id").groupBy("category", "key").agg(F.count("*").alias("count"))


@query("a42_merged_items", f"SELECT CASE WHEN category IN ('software', 'wildlife') THEN 'science' ELSE category END AS category, key, max(count) AS count FROM ({ITEMS}) GROUP BY ALL")
def a42(c):
    return M.max_merge(items(c), ALIASES)


@query("l7_top_items", f"SELECT category, key, count FROM ({ITEMS}) WHERE count >= 5 QUALIFY row_number() OVER (PARTITION BY category ORDER BY count DESC, key) <= 20")
def l7(c):
    order = Window.partitionBy("category").orderBy(F.col("count").desc(), "key")
    return items(c).where(F.col("count") >= 5).withColumn("k", F.row_number().over(order)).where("k <= 20").drop("k")


@query(
    "m14_category_by_pass",
    f"""WITH i AS ({ITEMS}), k AS (SELECT DISTINCT key FROM {FRAG}), one AS (SELECT key, min(category) AS category FROM i WHERE count >= 5 GROUP BY 1), two AS (SELECT key, min(category) AS category FROM i WHERE count >= 3 GROUP BY 1)
    SELECT key, coalesce(one.category, two.category, 'uncategorized') AS category, CASE WHEN one.category IS NOT NULL THEN 1 WHEN two.category IS NOT NULL THEN 2 ELSE 0 END AS pass FROM k LEFT JOIN one USING (key) LEFT JOIN two USING (key)""",
)
def m14(c):
    i = items(c)
    return M.fill_by_passes(parts(c), [i.where(F.col("count") >= 5), i.where(F.col("count") >= 3)])


@query("s5_first_positions", f"SELECT key, min(id) AS first_id FROM {FRAG} GROUP BY 1")
def s5(c):
    return parts(c).groupBy("key").agg(F.min("id").alias("first_id"))


@query("str7_kept_facts")
def str7(c):
    facts = c.question_columns("pack_id", "comment").where("comment <> ''")
    return M.drop_similar_facts(facts.select(F.col("pack_id").cast("string").alias("grp"), F.col("id").alias("pos"), F.col("comment").alias("text")))


@query("str6_transcript_chunks")
def str6(c):
    lines = c.table("documents").where("doc_kind = 'transcript' AND text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return M.transcript_chunks(lines.select(F.col("doc_id").alias("video"), F.col("pos").cast("long"), "text"), 1_500)


@query("x12_copy_keys")
def x12(c):
    return c.question_columns("text").select("id", M.copy_key(F.coalesce("text", F.lit(""))).alias("key"))


@query("x18_first_sentences")
def x18(c):
    return c.table("documents").where("text IS NOT NULL").select("doc_id", X.first_sentences(F.col("text"), 2).alias("head"))
