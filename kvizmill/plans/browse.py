"""Filters, joins, pages, samples and authors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kvizmill.functions import text as X
from kvizmill.functions.dates import written_date
from kvizmill.operators import browse as B
from kvizmill.operators import shares as S
from kvizmill.operators.authors import author_names, pooled_authors
from kvizmill.plans.registry import query
from kvizmill.plans.shares import DATE, LAB, MODEL, P, Q
from kvizmill.session import if_small

HASH = "((({0} % 2147483647) * (2654435761 % 2147483647) + {1}) % 2147483647)"
AUTHOR, GROUP = "Иван", ["Захар", "Рехрехаев"]
LIKE = "({0} LIKE '%Захар%' OR {0} LIKE '%Рехрехаев%')"
TOPIC = "(SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY confidence DESC NULLS LAST, subcategory_id, id) AS rn FROM question_topics)"


@query("f1_models", "SELECT DISTINCT model_name FROM question_topics WHERE model_name IS NOT NULL")
def f1(c):
    return c.topics.select("model_name").where("model_name IS NOT NULL").distinct()


@query("f4_categories", "SELECT id, name, name_ru, sort_order FROM categories")
def f4(c):
    return c.categories.orderBy("sort_order")


@query("f5_subcategories", "SELECT s.id, s.name, s.category_id FROM subcategories s JOIN categories c ON c.id = s.category_id WHERE c.id IN (3, 8)")
def f5(c):
    return c.subcategories.where(F.col("category_id").isin(3, 8)).orderBy("category_id", "sort_order").select("id", "name", "category_id")


@query("f6_subcategory_by_position", "SELECT c.sort_order AS cat, s.sort_order AS sub, s.id FROM subcategories s JOIN categories c ON c.id = s.category_id WHERE c.sort_order = 7 AND s.sort_order = 2")
def f6(c):
    at = c.dims.where("sort_order = 7 AND sub_order = 2")
    return at.select(F.col("sort_order").alias("cat"), F.col("sub_order").alias("sub"), F.col("subcategory_id").alias("id"))


@query("f7_pack_ids_by_status", f"SELECT parse_status, id FROM {P} WHERE parse_status IN ('pending', 'parsed')")
def f7(c):
    return c.packs.where(F.col("parse_status").isin("pending", "parsed")).select("parse_status", "id")


@query("f8_first_ids", f"SELECT q.id, p.title FROM {Q} q LEFT JOIN {P} p ON p.id = q.pack_id JOIN (SELECT unnest(range(5001, 5200, 7)) AS id) i ON i.id = q.id WHERE i.id < 5001 + 7 * 20")
def f8(c):
    ids = c.spark.createDataFrame([(5001 + 7 * k, k) for k in range(29)], "id long, pos int").where("pos < 20")
    titles = c.packs.select(F.col("id").alias("pack_id"), "title")
    return c.question_columns("pack_id").join(F.broadcast(ids), "id").join(titles, "pack_id", "left").orderBy("id").select("id", "title")


F10_WHERE = "q.text LIKE '%афиш%' AND qt.model_name = 'heron-72b' AND c.name = 'sport'"


@query(
    "f10_browse_questions",
    f"""SELECT q.id, q.text, c.name AS category, s.name AS subcategory, qt.confidence, p.title FROM {Q} q LEFT JOIN question_topics qt ON qt.question_id = q.id
    LEFT JOIN subcategories s ON s.id = qt.subcategory_id LEFT JOIN categories c ON c.id = s.category_id LEFT JOIN {P} p ON p.id = q.pack_id
    WHERE {F10_WHERE} ORDER BY q.id, qt.id LIMIT 50""",
)
def f10(c):
    rows = B.page(_browsed(c), 50, 1, F.col("id"), F.col("topic_id"))
    return rows.select("id", "text", "category", "subcategory", "confidence", "title")


def _browsed(c):
    questions = c.question_columns("text", "pack_id").where(X.contains_ascii_folded(F.col("text"), "афиш"))
    topics = c.labelled(MODEL).where("category = 'sport'").select(F.col("question_id").alias("id"), F.col("id").alias("topic_id"), "category", "subcategory", "confidence")
    packs = c.packs.select(F.col("id").alias("pack_id"), "title")
    # The filters on the topic leave no question without one, so the outer join to it is an inner one.
    return questions.join(topics, "id").join(packs, "pack_id", "left")


@query(
    "f11_browse_count",
    f"""SELECT count(DISTINCT q.id) AS n FROM {Q} q JOIN question_topics qt ON qt.question_id = q.id JOIN subcategories s ON s.id = qt.subcategory_id
    JOIN categories c ON c.id = s.category_id WHERE {F10_WHERE}""",
)
def f11(c):
    return _browsed(c).select("id").distinct().agg(F.count("*").alias("n"))


@query("f12_published_in", f"SELECT id, d FROM (SELECT id, {DATE.format('published_date')} AS d FROM {P}) WHERE d BETWEEN DATE '2015-01-01' AND DATE '2016-12-31'")
def f12(c):
    return c.packs.select("id", written_date(F.col("published_date")).alias("d")).where("d BETWEEN DATE '2015-01-01' AND DATE '2016-12-31'")


@query("f13_started_in_year", f"SELECT id, start_date FROM {P} WHERE start_date >= '2016-01-01' AND start_date < '2017-01-01'")
def f13(c):
    return c.table("packs").where("start_date >= '2016-01-01' AND start_date < '2017-01-01'").select("id", "start_date", "title", "authors").distinct().select("id", "start_date")


@query("f14_tour_or_first", f"SELECT id, tour_number FROM {Q} WHERE coalesce(tour_number, 1) = 1")
def f14(c):
    return c.question_columns("tour_number").where(F.coalesce("tour_number", F.lit(1)) == 1)


@query("f15_useful_posts", "SELECT (length(text) >= 50) AS useful, count(*) AS n FROM tg_posts WHERE text IS NOT NULL GROUP BY 1")
def f15(c):
    return c.posts.where("text IS NOT NULL").groupBy((F.length("text") >= 50).alias("useful")).agg(F.count("*").alias("n"))


@query("f17_topic_search", f"SELECT id FROM {Q} WHERE regexp_matches(concat_ws(' ', text, answer, comment), '(^|[^\\p{{L}}\\p{{N}}_])(?i:фреск)')")
def f17(c):
    q = c.question_columns("text", "answer", "comment")
    return q.where(X.mentions("фреск", F.col("text"), F.col("answer"), F.col("comment"))).select("id")


@query("j7_unclassified", f"SELECT id FROM {Q} WHERE id NOT IN (SELECT question_id FROM question_topics WHERE model_name = '{MODEL}')")
def j7(c):
    done = c.topics.where(F.col("model_name") == MODEL).select(F.col("question_id").alias("id"))
    return B.anti(c.question_columns("pack_id").select("id"), done, "id")


@query("j8_labelled_by_source", f"SELECT id FROM {Q} WHERE id IN (SELECT question_id FROM question_topics WHERE model_name = 'editor_desk')")
def j8(c):
    by = c.topics.where("model_name = 'editor_desk'").select(F.col("question_id").alias("id"))
    return c.question_columns("pack_id").join(by, "id", "left_semi").select("id")


@query("j15_union_anti", f"SELECT id, title FROM {P} WHERE (difficulty IS NULL OR difficulty > 10) AND id NOT IN (SELECT id FROM packs WHERE parse_status <> 'parsed')")
def j15(c):
    two = c.packs.where("difficulty IS NULL").select("id", "title").unionByName(c.packs.where("difficulty > 10").select("id", "title"), allowMissingColumns=True)
    return B.anti(two, c.table("packs").where("parse_status <> 'parsed'"), "id")


@query("l3_shuffled_page", f"SELECT id FROM {Q} ORDER BY {HASH.format('id', 7)}, id LIMIT 20 OFFSET 40")
def l3(c):
    return c.question_columns("pack_id").select("id").orderBy(X.shuffle_key(F.col("id"), 7), "id").offset(40).limit(20)


@query("l4_sample", f"SELECT id FROM {Q} WHERE id IN (SELECT question_id FROM question_topics WHERE subcategory_id IN (1, 2)) ORDER BY {HASH.format('id', 42)}, id LIMIT 25")
def l4(c):
    of = c.topics.where(F.col("subcategory_id").isin(1, 2)).select(F.col("question_id").alias("id"))
    return B.shuffled(c.question_columns("pack_id").select("id").join(of, "id", "left_semi"), "id", 42, 25)


@query(
    "l6_a50_diverse_sample",
    f"""SELECT id, pack_id FROM (SELECT id, pack_id, {HASH.format('id', 42)} AS h, row_number() OVER (PARTITION BY pack_id ORDER BY {HASH.format('id', 42)}, id) AS rn,
    count(*) OVER (PARTITION BY pack_id) AS n FROM {Q}) WHERE n >= 3 ORDER BY rn > 1, h, id LIMIT 60""",
)
def l6(c):
    return B.diverse_sample(c.question_columns("pack_id"), 60, 3, 42)


@query(
    "l8_top_posts_per_category",
    """SELECT category, id, views FROM tg_posts WHERE is_useful AND category IS NOT NULL AND category <> '' AND created_at >= TIMESTAMP '2024-01-01' - INTERVAL 365 DAY
    QUALIFY row_number() OVER (PARTITION BY category ORDER BY views DESC NULLS LAST, id) <= 3""",
)
def l8(c):
    rows = c.posts.where("is_useful AND category <> '' AND created_at >= TIMESTAMP_NTZ '2024-01-01' - INTERVAL 365 DAY")
    order = Window.partitionBy("category").orderBy(F.col("views").desc_nulls_last(), "id")
    return rows.select("category", "id", "views").withColumn("k", F.row_number().over(order)).where("k <= 3").drop("k")


@query("l9_unsent_posts", "SELECT id FROM tg_posts WHERE category IS NOT NULL AND is_useful ORDER BY created_at DESC, id LIMIT 30")
def l9(c):
    return c.posts.where("category IS NOT NULL AND is_useful").orderBy(F.col("created_at").desc(), "id").limit(30).select("id")


SIZES = f"(SELECT p.id, p.title, count(q.id) AS questions FROM {P} p LEFT JOIN {Q} q ON q.pack_id = p.id GROUP BY ALL)"


def pack_sizes(c):
    n = c.question_columns("pack_id").groupBy("pack_id").agg(F.count("*").alias("questions"))
    return c.packs.select("id", "title").join(n.withColumnRenamed("pack_id", "id"), "id", "left").fillna({"questions": 0})


@query(
    "l10_title_search",
    f"""SELECT id, title, CASE WHEN lower(title) = 'кубок' THEN 0 WHEN strpos(lower(title), 'кубок') = 1 THEN 1 ELSE 2 END AS rank, strpos(lower(title), 'кубок')::INT AS "at", questions
    FROM {SIZES} WHERE strpos(lower(title), 'кубок') > 0 ORDER BY 3, 4, questions DESC, title, id LIMIT 20""",
)
def l10(c):
    return B.search_titles(pack_sizes(c), " Кубок ", 20)


@query("l11_pack_questions", f"SELECT id, number, coalesce(tour_number, 1) AS tour FROM {Q} WHERE pack_id = 103 ORDER BY tour, number NULLS FIRST, id LIMIT 12")
def l11(c):
    q = c.table("questions").where("pack_id = 103").select("id", "number", F.coalesce("tour_number", F.lit(1)).alias("tour")).distinct()
    return q.orderBy("tour", "number", "id").limit(12)


@query("s2_missing_ids", f"SELECT g AS id FROM (SELECT unnest(range(100, (SELECT max(id) FROM packs) + 1)) AS g) WHERE g NOT IN (SELECT id FROM packs)")
def s2(c):
    last = c.table("packs").agg(F.max("id").alias("last"))
    span = last.select(F.explode(F.sequence(F.lit(100).cast("long"), F.col("last"))).alias("id"))
    return B.anti(span, c.table("packs"), "id")


TOKENS = "list_distinct(regexp_extract_all(lower({0}), '[а-яёa-z0-9]+'))"


@query(
    "s3_word_overlap",
    f"""SELECT id, round(len(list_intersect({TOKENS.format('answer')}, {TOKENS.format('zachet')})) / nullif(len(list_distinct(list_concat({TOKENS.format('answer')}, {TOKENS.format('zachet')}))), 0), 4) AS jaccard
    FROM {Q} WHERE answer IS NOT NULL AND zachet IS NOT NULL""",
)
def s3(c):
    """How far the answer and what else is accepted share their words."""
    tokens = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("([а-яёa-z0-9]+)"), F.lit(1)))
    both = c.question_columns("answer", "zachet").where("answer IS NOT NULL AND zachet IS NOT NULL").select("id", tokens("answer").alias("x"), tokens("zachet").alias("y"))
    return both.select("id", F.round(F.try_divide(F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))), 4).alias("jaccard"))


@query(
    "a15_author_profile",
    f"""SELECT c.name AS category, count(DISTINCT q.id) AS count FROM {LAB} JOIN {Q} q ON q.id = qt.question_id JOIN {P} p ON p.id = q.pack_id
    WHERE q.authors LIKE '%{AUTHOR}%' GROUP BY 1""",
)
def a15(c):
    q = c.question_columns("pack_id", "authors").where(X.any_contained(F.col("authors"), [AUTHOR]))
    q = q.join(c.packs.select(F.col("id").alias("pack_id")), "pack_id", "left_semi").select(F.col("id").alias("question_id"))
    return S.question_counts(c.labelled().join(q, "question_id"), "category")


X1_SQL = f"""(SELECT id, unnest(CASE WHEN json_valid(authors) AND ltrim(authors)[1] = '['
 THEN list_filter(list_transform(CAST(authors AS JSON[]), lambda e: CASE WHEN json_type(e) = 'OBJECT' THEN json_extract_string(e, '$.name') END), lambda n: n IS NOT NULL)
 ELSE list_filter(list_transform(string_split(authors, ','), lambda e: trim(e, ' ')), lambda e: e <> '') END) AS name FROM {Q} WHERE authors IS NOT NULL)"""


def exploded(c):
    q = c.question_columns("authors").where("authors IS NOT NULL")
    return q.select("id", F.explode(X.listed_or_split(F.col("authors"))).alias("name"))


@query("a16_top_authors", f"SELECT name, count(*) AS count FROM {X1_SQL} GROUP BY 1 ORDER BY count DESC, name LIMIT 30")
def a16(c):
    return S.top(a17(c), 30, F.col("count").desc(), F.col("name"))


@query("a17_all_authors", f"SELECT name, count(*) AS count FROM {X1_SQL} GROUP BY 1")
def a17(c):
    return exploded(c).groupBy("name").agg(F.count("*").alias("count"))


@query("x1_author_lists", f"SELECT id, name FROM {X1_SQL}")
def x1(c):
    return exploded(c)


@query("a17_all_author_names")
def a17_names(c):
    """Like a17, with the names of p2: no list syntax, escapes or numbering is left in them."""
    q = c.question_columns("authors").where("authors IS NOT NULL")
    return q.select(F.explode(author_names(F.col("authors"))).alias("name")).groupBy("name").agg(F.count("*").alias("count"))


@query(
    "a20_author_coverage",
    f"""SELECT a.author, count(DISTINCT q.id) AS total, count(DISTINCT CASE WHEN q.id IN (SELECT question_id FROM question_topics WHERE model_name = '{MODEL}') THEN q.id END) AS classified,
    round_even(100.0 * count(DISTINCT CASE WHEN q.id IN (SELECT question_id FROM question_topics WHERE model_name = '{MODEL}') THEN q.id END) / count(DISTINCT q.id), 1) AS pct
    FROM {Q} q JOIN (SELECT unnest(['Захар', 'Рехрехаев', 'Иван']) AS author) a ON contains(q.authors, a.author) GROUP BY 1""",
)
def a20(c):
    authors = c.spark.createDataFrame([(a,) for a in ("Захар", "Рехрехаев", "Иван")], "author string")
    done = c.topics.where(F.col("model_name") == MODEL).select(F.col("question_id").alias("id")).distinct().withColumn("done", F.lit(1))
    q = c.question_columns("authors").where("authors IS NOT NULL").join(done, "id", "left")
    hits = q.join(if_small(authors, 10_000), F.contains("authors", "author"))  # one pass for the whole list of authors
    out = hits.groupBy("author").agg(F.count("*").alias("total"), F.count("done").alias("classified"))
    return out.withColumn("pct", S.percent(F.col("classified"), F.col("total")))


@query(
    "a21_group_share",
    f"""SELECT category, count, round_even(100.0 * count / sum(count) OVER (), 1) AS pct FROM (SELECT c.name AS category, count(DISTINCT q.id) AS count
    FROM {LAB} JOIN {Q} q ON q.id = qt.question_id WHERE {LIKE.format('q.authors')} GROUP BY 1)""",
)
def a21(c):
    q = c.question_columns("authors").where(X.any_contained(F.col("authors"), GROUP)).select(F.col("id").alias("question_id"))
    return S.with_share(S.question_counts(c.labelled().join(q, "question_id"), "category"))


@query(
    "a22_frequent_answers",
    f"""SELECT lower(trim(answer)) AS key, count(*) AS count, trim(min(answer)) AS display FROM {Q} WHERE trim(coalesce(answer, '')) <> ''
    GROUP BY 1 HAVING count(*) >= 3 ORDER BY count DESC, key LIMIT 100""",
)
def a22(c):
    q = c.question_columns("answer").where(F.trim("answer") != "")
    counts = q.groupBy(F.lower(F.trim("answer")).alias("key")).agg(F.count("*").alias("count"), F.trim(F.min("answer")).alias("display"))
    return S.top(counts.where(F.col("count") >= 3), 100, F.col("count").desc(), F.col("key"))


@query("a23_group_answers", f"SELECT id, coalesce(answer, '') AS answer FROM {Q} WHERE {LIKE.format('authors')}")
def a23(c):
    return c.question_columns("authors", "answer").where(X.any_contained(F.col("authors"), GROUP)).select("id", F.coalesce("answer", F.lit("")).alias("answer"))


@query(
    "a26_author_top_categories",
    f"""WITH a AS (SELECT DISTINCT n.name, n.id, c.name AS category FROM {X1_SQL} n JOIN question_topics qt ON qt.question_id = n.id JOIN subcategories s ON s.id = qt.subcategory_id
    JOIN categories c ON c.id = s.category_id), t AS (SELECT name, count(DISTINCT id) AS total FROM a GROUP BY 1 HAVING total >= 10)
    SELECT name, category, count(*) AS count, total, round(100.0 * count(*) / total, 4) AS pct FROM a JOIN t USING (name) GROUP BY name, category, total
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, category) <= 3""",
)
def a26(c):
    a = exploded(c).join(c.labelled().select(F.col("question_id").alias("id"), "category").distinct(), "id").distinct()
    total = a.select("name", "id").distinct().groupBy("name").agg(F.count("*").alias("total")).where("total >= 10")
    counts = a.groupBy("name", "category").agg(F.count("*").alias("count")).join(total, "name")
    order = Window.partitionBy("name").orderBy(F.col("count").desc(), "category")
    return counts.withColumn("k", F.row_number().over(order)).where("k <= 3").drop("k").withColumn("pct", F.round(F.lit(100.0) * F.col("count") / F.col("total"), 4))


@query("a27_tours", f"SELECT pack_id, coalesce(tour_number, 1) AS tour, count(*) AS n FROM {Q} GROUP BY ALL")
def a27(c):
    return c.question_columns("pack_id", "tour_number").groupBy("pack_id", F.coalesce("tour_number", F.lit(1)).alias("tour")).agg(F.count("*").alias("n"))


@query("a28_recent_packs", f"SELECT id, title, questions FROM {SIZES} WHERE questions > 0 ORDER BY id DESC LIMIT 10")
def a28(c):
    return S.top(pack_sizes(c).where("questions > 0"), 10, F.col("id").desc())


@query("a29_pack_sizes", f"SELECT * FROM {SIZES}")
def a29(c):
    return pack_sizes(c)


@query(
    "a34_available",
    f"""SELECT count(DISTINCT q.id) AS n FROM {LAB} JOIN {Q} q ON q.id = qt.question_id JOIN {P} p ON p.id = q.pack_id
    WHERE c.id IN (1, 2) AND qt.model_name = '{MODEL}' AND p.difficulty BETWEEN 2 AND 5""",
)
def a34(c):
    packs = c.packs.where("difficulty BETWEEN 2 AND 5").select(F.col("id").alias("pack_id"))
    q = c.question_columns("pack_id").join(packs, "pack_id", "left_semi").select(F.col("id").alias("question_id"))
    of = c.labelled(MODEL).where(F.col("category_id").isin(1, 2)).select("question_id").distinct()
    return of.join(q, "question_id", "left_semi").agg(F.count("*").alias("n"))


@query("a35_available_at_random", f"SELECT count(*) AS n FROM {Q} q JOIN {P} p ON p.id = q.pack_id WHERE p.difficulty BETWEEN 2 AND 5")
def a35(c):
    packs = c.packs.where("difficulty BETWEEN 2 AND 5").select(F.col("id").alias("pack_id"))
    return c.question_columns("pack_id").join(packs, "pack_id", "left_semi").agg(F.count("*").alias("n"))


@query("w1_primary_topic_by_model", f"SELECT question_id, model_name, subcategory_id, confidence FROM {TOPIC.format('question_id, model_name')} WHERE rn = 1")
def w1(c):
    return S.primary_topics(c.topics, "question_id", "model_name").select("question_id", "model_name", "subcategory_id", "confidence")


@query("w2_primary_topic", f"SELECT question_id, subcategory_id, confidence FROM {TOPIC.format('question_id')} WHERE rn = 1")
def w2(c):
    return S.primary_topics(c.topics, "question_id").select("question_id", "subcategory_id", "confidence")


@query(
    "w3_full_questions",
    f"""SELECT q.id, i.pos, q.answer, c.name AS category, p.title FROM {Q} q JOIN (SELECT 5001 + 13 * k AS id, k AS pos FROM (SELECT unnest(range(30)) AS k)) i ON i.id = q.id
    LEFT JOIN {TOPIC.format('question_id')} t ON t.question_id = q.id AND t.rn = 1 LEFT JOIN subcategories s ON s.id = t.subcategory_id
    LEFT JOIN categories c ON c.id = s.category_id LEFT JOIN {P} p ON p.id = q.pack_id""",
)
def w3(c):
    ids = F.broadcast(c.spark.createDataFrame([(5001 + 13 * k, k) for k in range(30)], "id long, pos long"))
    best = S.primary_topics(c.topics.join(ids.select(F.col("id").alias("question_id")), "question_id", "left_semi"), "question_id")
    best = best.join(c.dims, "subcategory_id").select(F.col("question_id").alias("id"), "category")
    full = c.question_columns("answer", "pack_id").join(best, "id", "left").join(c.packs.select(F.col("id").alias("pack_id"), "title"), "pack_id", "left")
    return B.fetch_in_order(full, ids).select("id", "pos", "answer", "category", "title")


@query("p2_found")
def p2_found(c):
    return pooled_authors(c.table("packs"), c.table("questions"))
