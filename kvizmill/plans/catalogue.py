"""Records, names and samples around the corpus (A38-A39, A41, A49, F9, F18, L5, S1, SRC5, U8-U10, X8, X10-X11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvizmill.functions import text as X
from kvizmill.operators import browse as B
from kvizmill.operators import compare as C
from kvizmill.operators import ingest as I
from kvizmill.operators import mining as M
from kvizmill.operators import shares as S
from kvizmill.operators import teams as T
from kvizmill.operators import training as L
from kvizmill.plans.browse import GROUP, HASH, LIKE
from kvizmill.plans.compare import COMMON, CONFUSED, DISPUTES, A, B as MODEL_B
from kvizmill.plans.compare import pairs
from kvizmill.plans.mining import CLEAN, FRAG, KEY, STOP, parts
from kvizmill.plans.registry import query
from kvizmill.plans.shares import P, Q
from kvizmill.plans.training import ATT, STATE

OWNER = 477
QUOTED = lambda values: ", ".join(f"'{v}'" for v in values)


@query(
    "l5_sample_of_answers",
    f"""SELECT DISTINCT f.id, {HASH.format('f.id', 9)} AS h FROM {FRAG} f JOIN {P} p ON p.id = f.pack_id
    WHERE f.key IN (SELECT key FROM {FRAG} GROUP BY 1 HAVING count(*) >= 2) AND p.difficulty BETWEEN 3 AND 7 ORDER BY h, f.id LIMIT 20""",
)
def l5(c):
    found = M.sample_by_answers(M.postings(parts(c), 2), c.question_columns("pack_id"), c.packs, (3.0, 7.0), 20, 9)
    return found.select("id", X.shuffle_key(F.col("id"), 9).alias("h"))


@query("f18_disputes_of_category", f"SELECT question_id, score, reasons FROM ({DISPUTES}) WHERE contains(lower(cat1), 'soft')")
def f18(c):
    return C.dispute(c.labelled(A), CONFUSED, "software", primary="Soft")


@query("f18_confused_disputes", f"SELECT question_id, score, reasons FROM ({DISPUTES}) WHERE pair")
def f18_confused(c):
    return C.dispute(c.labelled(A), CONFUSED, "software", confused_only=True)


@query(
    "f9_runs",
    """SELECT model_name, method, date_trunc('month', classified_at)::DATE AS month, min(classified_at) AS started_at, max(classified_at) AS finished_at, count(*) AS labels,
    count(DISTINCT question_id) AS questions FROM question_topics WHERE classified_at IS NOT NULL GROUP BY ALL ORDER BY started_at DESC""",
)
def f9(c):
    return C.runs(c.topics)


@query("a49_token_estimate", f"SELECT model_name, n - done AS questions, (n - done) * 1600 AS input_tokens, (n - done) * 40 AS output_tokens FROM (SELECT model_name, count(DISTINCT question_id) AS done FROM question_topics WHERE model_name IS NOT NULL AND question_id IN (SELECT id FROM questions) GROUP BY 1), (SELECT count(DISTINCT id) AS n FROM questions)")
def a49(c):
    """Tokens that labelling the rest would take, for each model."""
    return C.token_estimate(c.question_columns().select("id"), c.topics)


@query("s1_confidence_of_two_models", f"SELECT question_id, '{A}' AS model, conf_a AS confidence FROM {COMMON} UNION ALL SELECT question_id, '{MODEL_B}', conf_b FROM {COMMON}")
def s1(c):
    return S.tagged_union("model", {A: pairs(c).select("question_id", F.col("conf_a").alias("confidence")), MODEL_B: pairs(c).select("question_id", F.col("conf_b").alias("confidence"))})


@query(
    "x8_organisation_like",
    f"""SELECT fragment, t <> '' AND lower(t) NOT IN ({QUOTED(X.NO_ORGANISATIONS)}) AND ({' OR '.join(f"contains(lower(t), '{k}')" for k in X.ORGANISATION_WORDS)}
    OR CASE WHEN regexp_full_match(t, '[A-ZА-ЯЁ0-9]{{2,8}}') THEN lower(t) NOT IN ({STOP}) ELSE regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '\\p{{Lu}}') END) AS organisation
    FROM (SELECT DISTINCT fragment, trim(fragment) AS t FROM {FRAG})""",
)
def x8(c):
    return parts(c).select("fragment").distinct().withColumn("organisation", X.is_organisation_like(F.col("fragment"), M.STOP_WORDS))


@query("x10_capitalised", f"SELECT fragment, regexp_matches(trim(fragment), '(^|[\\s-])\\p{{Lu}}') AS capitalised, len(regexp_extract_all(lower(fragment), '[а-яёa-z0-9]+')) AS tokens FROM (SELECT DISTINCT fragment FROM {FRAG})")
def x10(c):
    f = F.col("fragment")
    return parts(c).select("fragment").distinct().select("fragment", X.has_capital(f).alias("capitalised"), F.size(X.tokens(f)).cast("long").alias("tokens"))


RULES = M.ItemRules(
    denied=("ответ", "вопрос"), allowed={"москва": "place", "пушкин": "person"}, person_denied=("город", "река"), place_denied=("человек",), place_words=("город", "озеро"),
    works_denied=("стихи",), science=("ген", "атом"), expressions=(" на ", " не "),
)


@query(
    "x11_valid_categories",
    f"""WITH i AS (SELECT DISTINCT fragment, {KEY.format('fragment')} AS k, len(regexp_extract_all(lower(fragment), '[а-яёa-z0-9]+')) AS n, regexp_matches(trim(fragment), '(^|[\\s-])\\p{{Lu}}') AS cap FROM {FRAG}),
    k AS (SELECT unnest(['person', 'place', 'work', 'science', 'expression', 'number']) AS kind)
    SELECT fragment, kind, k NOT IN ('ответ', 'вопрос') AND CASE WHEN k = 'москва' THEN kind = 'place' WHEN k = 'пушкин' THEN kind = 'person'
    WHEN kind = 'person' THEN NOT (contains(k, 'город') OR contains(k, 'река')) AND (n >= 2 OR cap) WHEN kind = 'place' THEN NOT contains(k, 'человек') AND (contains(k, 'город') OR contains(k, 'озеро') OR cap OR n >= 2)
    WHEN kind = 'number' THEN regexp_full_match(lower(trim(k)), '\\d{{1,4}}([./:-]\\d{{1,4}})*|\\d+[,.]\\d+') OR lower(trim(k)) IN ('π', 'пи', 'pi')
    WHEN kind = 'expression' THEN n >= 3 OR n = 2 AND (contains(' ' || k || ' ', ' на ') OR contains(' ' || k || ' ', ' не ')) WHEN kind = 'science' THEN contains(k, 'ген') OR contains(k, 'атом') OR n >= 2
    ELSE k <> 'стихи' AND n >= 2 END AS valid FROM i, k""",
)
def x11(c):
    each = parts(c).select("fragment").distinct().withColumn("kind", F.explode(F.array(*[F.lit(k) for k in M.ITEM_KINDS])))
    return each.withColumn("valid", M.valid_item(F.col("fragment"), F.col("kind"), RULES))


LEGACY = ATT.replace("user_id,", f"{OWNER} AS user_id,", 1)


@query("u8_attempts_owned", f"SELECT id, user_id, question_id, knew FROM {LEGACY}")
def u8(c):
    """Attempts from before there were users become the owner's."""
    return I.migrate(c.attempts.select("id", "question_id", "knew"), {"user_id": F.lit(OWNER).cast("long")})


@query("u8_state_owned", f"SELECT user_id, question_id, box, streak FROM {STATE.replace(ATT, LEGACY)} WHERE next_review_at <= TIMESTAMP '2024-02-01'")
def u8_state(c):
    """Review states keyed by question become keyed by owner and question, and are due as before."""
    legacy = L.leitner(c.attempts.withColumn("user_id", F.lit(0).cast("long"))).drop("user_id")
    owned = I.migrate(legacy, {"user_id": F.lit(OWNER).cast("long")}, ["user_id", "question_id"])
    return L.due(owned, F.lit("2024-02-01").cast("timestamp_ntz")).select("user_id", "question_id", "box", "streak")


@query("u9_taxonomy_seeded", "SELECT 'empty' AS table_was, id, name FROM categories UNION ALL SELECT 'filled', id, name FROM subcategories")
def u9(c):
    seed = c.categories.select("id", "name")
    empty = I.seeded(seed.where("false"), seed).select(F.lit("empty").alias("table_was"), "id", "name")
    return empty.unionByName(I.seeded(c.subcategories.select("id", "name"), seed).select(F.lit("filled").alias("table_was"), "id", "name"))


@query("u10_state_after_attempts", f"FROM {STATE}")
def u10(c):
    """The state of the first half, moved on by the attempts of the second."""
    at = F.lit("2024-01-16").cast("timestamp_ntz")
    return L.advance(L.leitner(c.attempts.where(F.col("attempted_at") < at)), c.attempts.where(F.col("attempted_at") >= at))


@query("u10_attempts_appended", f"SELECT row_number() OVER (ORDER BY attempted_at, old, user_id) + 1000000 AS id, user_id, question_id FROM (SELECT *, id AS old FROM {ATT}) WHERE attempted_at >= TIMESTAMP '2024-01-30'")
def u10_appended(c):
    late = c.attempts.where(F.col("attempted_at") >= F.lit("2024-01-30").cast("timestamp_ntz")).withColumnRenamed("id", "old")
    old = c.spark.createDataFrame([(1_000_000,)], "id long")
    return I.append_numbered(old, late, "id", ["attempted_at", "old", "user_id"]).select("id", "user_id", "question_id")


@query("src5_legacy_packs", f"SELECT id, title, CASE WHEN parse_status = 'parsed' THEN 'parsed' ELSE 'metadata_only' END AS parse_status FROM {P}")
def src5(c):
    """Games of the old table become packs of which only this is known."""
    old = c.packs.where("parse_status = 'parsed'").select("id", "title", "parse_status")
    games = c.packs.select("id", "title", F.lit("metadata_only").alias("parse_status"))
    return old.unionByName(I.insert_ignore(old, games, ["id"], "title"))


NAMES = r"[а-яёa-z,] (\p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)*)"
FOUND = f"(SELECT unnest(regexp_extract_all({{0}}, '{NAMES}', 1)) AS name FROM {{1}})"
KIND = f"""CASE WHEN {' OR '.join(f"contains(lower(name), '{k}')" for k in X.ORGANISATION_WORDS)} OR regexp_matches(name, '[A-Za-z]') THEN CASE WHEN lower(name) IN ({QUOTED(X.NO_ORGANISATIONS)}) THEN NULL ELSE 'ORG' END END"""
TYPE = f"coalesce({KIND}, CASE WHEN contains(name, ' ') THEN 'PER' ELSE 'LOC' END)"


@query("a39_typed_names", f"SELECT type, name, count(*) AS count FROM (SELECT name, {TYPE} AS type FROM {FOUND.format('text', Q)}) GROUP BY type, name QUALIFY row_number() OVER (PARTITION BY type ORDER BY count(*) DESC, name) <= 300")
def a39(c):
    return M.top_entities(M.typed(M.found_names(c.question_columns("text"))), 300)


@query(
    "a41_names_of_group",
    f"""WITH t AS (SELECT concat_ws(' ', {CLEAN.format('text')}, {CLEAN.format('answer')}, {CLEAN.format('comment')}) AS text FROM {Q} WHERE {LIKE.format('authors')}),
    n AS (SELECT name, {TYPE} AS type, count(*) AS count FROM {FOUND.format('text', 't')} GROUP BY ALL)
    SELECT lower(trim(name)) AS key, CASE min(CASE type WHEN 'PER' THEN 1 WHEN 'LOC' THEN 2 ELSE 3 END) WHEN 1 THEN 'PER' WHEN 2 THEN 'LOC' ELSE 'ORG' END AS type, sum(count)::BIGINT AS count
    FROM n GROUP BY 1 ORDER BY count DESC, key LIMIT 500""",
)
def a41(c):
    of = c.question_columns("authors", "text", "answer", "comment").where(X.any_contained(F.col("authors"), GROUP))
    texts = of.select("id", F.concat_ws(" ", *[X.clean_answer(F.col(k)) for k in ("text", "answer", "comment")]).alias("text"))
    each = M.typed(M.found_names(texts)).groupBy("name", "type").agg(F.count("*").alias("count"))
    return S.top(T.typed_names(each), 500, F.col("count").desc(), F.col("key"))


LEMMA = f"regexp_replace(word, '{X.ENDING}', '\\1')"


@query("a38_lemma_frequency", f"SELECT {LEMMA} AS lemma, count(*) AS count FROM (SELECT unnest(list_filter(regexp_extract_all({KEY.format('text')}, '[а-яa-z]{{3,}}'), lambda w: w NOT IN ({STOP}))) AS word FROM {Q} WHERE text IS NOT NULL) GROUP BY 1 HAVING count(*) >= 3")
def a38(c):
    words = M.words(c.question_columns("text"), X.light_lemma)
    return M.frequency(words.withColumnRenamed("word", "lemma"), "lemma", 3)
