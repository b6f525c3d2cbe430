"""Group reports, replies and pages (A41-A45, A48, F16, J12, J14, M13, X17-X30, SRC10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvizmill.functions import answers as R
from kvizmill.functions import pages as H
from kvizmill.functions import text as X
from kvizmill.operators import shares as S
from kvizmill.operators import teams as T
from kvizmill.plans.browse import GROUP, LIKE
from kvizmill.plans.registry import query
from kvizmill.plans.shares import LAB, MODEL, P, Q


@query(
    "a45_share_delta",
    f"""WITH g AS (SELECT c.name AS category, count(*) AS n FROM {LAB} JOIN {Q} q ON q.id = qt.question_id WHERE {LIKE.format('q.authors')} GROUP BY 1),
    w AS (SELECT c.name AS category, count(*) AS n FROM {LAB} GROUP BY 1), d AS (SELECT w.category, coalesce(100.0 * g.n / (SELECT sum(n) FROM g), 0) AS pct, 100.0 * w.n / (SELECT sum(n) FROM w) AS whole_pct FROM w LEFT JOIN g USING (category))
    SELECT category, round(pct, 6) AS pct, round(whole_pct, 6) AS whole_pct, round(pct - whole_pct, 6) AS delta FROM d WHERE abs(round(pct - whole_pct, 6)) > 0.2""",
)
def a45(c):
    q = c.question_columns("authors").where(X.any_contained(F.col("authors"), GROUP)).select(F.col("id").alias("question_id"))
    count = lambda df: df.groupBy("category").agg(F.count("*").alias("count"))
    return T.share_delta(count(c.labelled().join(q, "question_id")), count(c.labelled()), 0.2)


SCORES = f"(SELECT model_name AS person, c.name AS category, round(5 * avg(CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END))::INT AS score FROM {LAB} WHERE model_name IS NOT NULL AND confidence IS NOT NULL GROUP BY ALL)"


@query(
    "a43_a44_skill_levels",
    f"""SELECT person, category, score, round(m, 4) AS team_mean, CASE WHEN score >= 4 THEN 'expert' WHEN score <= 2 THEN 'weak' WHEN score > m + 0.5 THEN 'above' WHEN score < m - 0.5 THEN 'below' ELSE 'near' END AS level,
    CASE WHEN n > 8 AND score <= 2 THEN 'high' WHEN n > 5 THEN 'mid' ELSE 'low' END AS priority FROM (SELECT *, avg(score) OVER (PARTITION BY category) AS m FROM {SCORES})
    JOIN (SELECT c.name AS category, count(*) AS n FROM categories c JOIN subcategories s ON s.category_id = c.id GROUP BY 1) USING (category)""",
)
def a43(c):
    one = F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence"))
    rows = c.labelled().where("model_name IS NOT NULL AND confidence IS NOT NULL")
    scores = rows.groupBy(F.col("model_name").alias("person"), "category").agg(F.round(5 * F.avg(one)).cast("int").alias("score"))
    n = c.dims.groupBy("category").agg(F.count("*").alias("n"))
    return T.skill_levels(scores).join(F.broadcast(n), "category").withColumn("priority", T.priority(F.col("n"), F.col("score"))).drop("n")


@query(
    "f16_j12_described",
    f"""SELECT k AS key, n AS count, coalesce(name, '') AS category, coalesce(name_ru, '') AS description FROM (SELECT lower(trim(category)) AS k, count(*) AS n FROM tg_posts WHERE category IS NOT NULL GROUP BY 1)
    LEFT JOIN categories ON lower(name_ru) = k OR name = k WHERE n >= 5""",
)
def f16(c):
    items = c.posts.where("category IS NOT NULL").groupBy(F.lower(F.trim("category")).alias("key")).agg(F.count("*").alias("count"))
    both = c.categories.select(F.lower("name_ru").alias("key"), F.col("name").alias("category"), F.col("name_ru").alias("description")).unionByName(
        c.categories.select(F.col("name").alias("key"), F.col("name").alias("category"), F.col("name_ru").alias("description"))
    )
    return T.described(items, F.broadcast(both), 5)


@query(
    "j14_first_in_catalogue",
    """WITH n AS (SELECT DISTINCT replace(lower(trim(regexp_replace(category, '\\s+', ' ', 'g'))), 'ё', 'е') AS name FROM tg_posts WHERE category IS NOT NULL),
    w AS (SELECT name, string_split(name, ' ') AS w, list_filter(string_split(name, ' '), lambda x: length(x) > 2) AS k FROM n)
    SELECT w.name, min(c.id) AS item FROM w JOIN categories c ON (len(w.w) = 1 AND length(w.name) >= 6 AND contains(' ' || lower(c.name_ru), ' ' || w.name))
    OR (len(w.w) > 1 AND len(w.k) > 0 AND len(list_filter(w.k, lambda x: NOT contains(lower(c.name_ru), x))) = 0) GROUP BY 1""",
)
def j14(c):
    names = c.posts.where("category IS NOT NULL").select(X.text_key(F.col("category")).alias("name")).distinct()
    return T.first_in_catalogue(names, c.categories.select(F.col("id").alias("item"), F.col("id").alias("pos"), F.col("name_ru").alias("title")))


@query(
    "m13_classified",
    f"""SELECT q.id AS question_id, s.id AS subcategory_id, 0.7::DOUBLE AS confidence FROM {Q} q JOIN categories c ON c.sort_order = 5 JOIN subcategories s ON s.category_id = c.id AND s.sort_order = 1
    WHERE regexp_matches(lower(coalesce(q.text, '') || ' ' || coalesce(q.answer, '')), 'фреск|витраж|скульптор') AND q.id NOT IN (SELECT question_id FROM question_topics WHERE model_name = '{MODEL}')""",
)
def m13(c):
    """The work queue of one model through a keyword rule; a model would be plugged in by ``labelled_by``."""
    done = c.topics.where(F.col("model_name") == MODEL).select(F.col("question_id").alias("id"))
    rows = c.question_columns("text", "answer").join(done, "id", "left_anti").select(F.col("id").alias("question_id"), "text", "answer")
    hit = F.regexp_like(F.lower(F.concat_ws(" ", "text", "answer")), F.lit("фреск|витраж|скульптор"))
    made = rows.where(hit).select("question_id", F.lit(5).alias("cat"), F.lit(1).alias("sub"), F.lit(0.7).alias("conf"))
    return T.with_subcategory(made, 0.4, c.dims)


@query("x30_topic_labels", f"SELECT s.id, c.name || ' → ' || s.name AS label FROM subcategories s JOIN categories c ON c.id = s.category_id UNION ALL SELECT 99, '?(99)'")
def x30(c):
    ids = c.subcategories.select("id").unionByName(c.spark.createDataFrame([(99,)], "id int"))
    known = c.dims.select(F.col("subcategory_id").alias("id"), F.concat_ws(" → ", "category", "subcategory").alias("label"))
    return ids.join(known, "id", "left").select("id", F.coalesce("label", F.format_string("?(%d)", "id")).alias("label"))


@query("x25_replies_parsed", f"SELECT question_id, cat, conf FROM (SELECT question_id, c.id AS cat, round(coalesce(confidence, 0.5), 2) AS conf FROM {LAB} WHERE model_name = '{MODEL}')")
def x25(c):
    """Labels written as a model would reply, in a fence, and read back."""
    rows = c.labelled(MODEL)
    topic = F.to_json(F.struct(F.array(F.struct(F.col("category_id").alias("cat"), F.lit("1").alias("sub"), F.col("confidence").alias("conf"))).alias("topics")))
    replies = rows.select("question_id", F.concat(F.lit("```json\n"), topic, F.lit("\n```")).alias("reply"))
    return replies.select("question_id", F.explode(R.topics(F.col("reply"))).alias("t")).select("question_id", "t.cat", "t.conf")


@query("x27_post_replies", "SELECT id, CASE WHEN lower(trim(category)) IN ('', 'null', 'none') THEN NULL ELSE trim(category) END AS category, coalesce(confidence, 0.5) AS confidence FROM tg_posts")
def x27(c):
    reply = F.concat(F.lit("Вот: "), F.to_json(F.struct("category", "confidence")))
    return c.posts.select("id", R.post_category(reply).alias("p")).select("id", "p.category", "p.confidence")


@query("x24_linked_packs", f"SELECT id, regexp_extract(link, '/pack/(\\d+)', 1)::BIGINT AS pack FROM {P} WHERE link IS NOT NULL")
def x24(c):
    return c.packs.where("link IS NOT NULL").select("id", H.linked_pack_id(F.col("link")).alias("pack"))


@query("a48_number_folds", f"SELECT id, coalesce(list_sum(list_transform(regexp_extract_all(title, '\\d+'), lambda n: n::BIGINT)), 0)::BIGINT AS total, round(list_avg(list_transform(regexp_extract_all(title, '\\d+'), lambda n: n::DOUBLE)), 2) AS mean FROM {P} WHERE title IS NOT NULL")
def a48(c):
    return c.packs.where("title IS NOT NULL").select("id", H.sum_of_numbers(F.col("title")).alias("total"), H.mean_of_numbers(F.col("title")).alias("mean"))


@query("src10_entry_ids", "SELECT id, ('0x' || md5(channel_id::VARCHAR || ':' || post_id::VARCHAR)[1:8])::BIGINT AS entry FROM tg_posts")
def src10(c):
    return c.posts.select("id", H.feed_entry_id(F.col("channel_id").cast("string"), F.col("post_id").cast("string")).alias("entry"))


@query("x19_page_texts")
def x19(c):
    page = F.concat(F.lit("<html><script>x</script><p>"), X.escape_html(F.col("text")), F.lit("</p></html>"))
    return c.question_columns("text").where("text IS NOT NULL").select("id", H.text_of(page).alias("text"))


@query(
    "x20_x22_embedded_questions",
    f"""SELECT id AS page_id, 0::BIGINT AS pos, id, number::BIGINT AS number, nullif(text, '') AS text, nullif(answer, '') AS answer, NULL::VARCHAR AS authors FROM {Q}""",
)
def x20(c):
    q = F.to_json(F.struct(F.array(F.struct("id", "number", "text", "answer")).alias("questions")))
    pages = c.question_columns("number", "text", "answer").select(F.col("id").alias("page_id"), F.concat(F.lit("<script>data = "), q, F.lit("</script>")).alias("html"))
    return H.embedded_questions(pages)


DAY = "DATE '2020-01-01' + (id % 900)::INT"


@query(
    "x21_page_metadata",
    f"""SELECT id AS page_id, nullif(trim(regexp_replace(replace(replace(replace(title, '"', ''), '<', ''), chr(92), ''), '\\s+', ' ', 'g')), '') AS title, question_count, CASE WHEN id % 3 = 0 THEN NULL ELSE {DAY} END AS start_date,
    CASE WHEN id % 3 = 2 THEN {DAY} END AS end_date, {DAY} AS published_date, teams_played::BIGINT AS teams_played, round(difficulty, 2) AS difficulty FROM {P} WHERE title IS NOT NULL AND question_count >= 0 AND teams_played >= 0 AND difficulty >= 0""",
)
def x21(c):
    """Pages in three forms: with labels alone, with embedded JSON, and with both."""
    p = c.packs.where("title IS NOT NULL AND question_count >= 0 AND teams_played >= 0 AND difficulty >= 0")
    title = F.trim(F.regexp_replace(F.regexp_replace("title", r'["<\\\\]', ""), r"\s+", " "))
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 900).cast("int"))
    dotted, form = F.date_format(day, "dd.MM.yyyy"), F.col("id") % 3
    fields = F.format_string('{"packTitle":"%s","pubDate":"%sT10:00:00","startDate":"%s"}', title, day.cast("string"), day.cast("string"))
    pushed = F.concat(F.lit('<script>self.push([1,"'), F.replace(fields, F.lit('"'), F.lit('\\"')), F.lit('"])</script>'))
    label = lambda k, v: F.concat(F.lit(f"<dt>{k}</dt><dd>"), v.cast("string"), F.lit("</dd>"))
    html = F.concat(
        F.when(form != 0, pushed).otherwise(F.concat(F.lit("<h1 class='a'>"), title, F.lit("</h1>"))),
        F.lit("<dl>"), label("Вопросов:", F.col("question_count")), label("Команд:", F.col("teams_played")), label("Сложность", F.col("difficulty")),
        F.when(form == 0, label("Опубликован", dotted)).otherwise(""), F.when(form == 2, label("Окончание", dotted)).otherwise(""), F.lit("</dl>"),
    )
    return H.page_metadata(p.select(F.col("id").alias("page_id"), html.alias("html")))


@query(
    "x23_archive_questions",
    f"""SELECT id AS page_id, number::BIGINT AS number, text, answer, authors, DATE '2020-01-01' + (id % 900)::INT AS played FROM (SELECT id, number, trim(regexp_replace(text, '[\\s]+', ' ', 'g')) AS text,
    nullif(trim(regexp_replace(answer, '[\\s]+', ' ', 'g')), '') AS answer, NULL::VARCHAR AS authors FROM {Q} WHERE regexp_full_match(text, '[ -~а-яА-ЯёЁ«»—]+') AND regexp_full_match(answer, '[ -~а-яА-ЯёЁ«»—]+')) WHERE text <> ''""",
)
def x23(c):
    """Questions written as an archive shows them, and read back; those of plain letters, as other spaces are no spaces to SQL."""
    simple = F.lit("^[ -~а-яА-ЯёЁ«»—]+\\z")
    q = c.question_columns("number", "text", "answer").where(F.regexp_like("text", simple) & F.regexp_like("answer", simple))
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 900).cast("int")).cast("string")
    field = lambda mark, value: F.concat(F.lit(f'<p><strong class="{mark}">'), F.lit(f"{mark}:</strong> "), X.escape_html(value), F.lit("</p>"))
    number = F.concat(F.lit('<p><strong class="Question"><a href="/question/x">'), F.concat(F.lit("Вопрос "), F.coalesce(F.col("number").cast("string"), F.lit(""))), F.lit("</a></strong>"), X.escape_html(F.col("text")), F.lit("</p>"))
    html = F.concat(F.lit('<dl><dt class="title"><a href="/t">Кубок '), day, F.lit('</a></dt><dd><div class="question">'), number, field("Answer", F.col("answer")), F.lit("<p>без поля</p></div></dd></dl>"))
    found = H.archive_questions(q.select(F.col("id").alias("page_id"), html.alias("html")))
    return found.select("page_id", "number", "text", "answer", "authors", "played")
