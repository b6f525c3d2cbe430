"""Operators on records: numbering, migration, gaps, streaks, lists, keys."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from kvizmill.functions import text as X
from kvizmill.operators import ingest as I
from kvizmill.operators import mining as M
from kvizmill.operators import training as L
from kvizmill.plans.corpus import Corpus
from kvizmill.session import if_small
from kvizmill.sources import files


def test_numbers_are_dense_and_in_order(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("a",), ("c",)], "k string")
    got = I.numbered(df, ["k"], 10).orderBy("id").collect()
    assert [r.id for r in got] == [11, 12, 13, 14, 15] and [r.k for r in got] == [None, "a", "a", "b", "c"]
    assert I.numbered(df.where("false"), ["k"], 10).count() == 0
    big = I.numbered(spark.range(5000).withColumnRenamed("id", "k").repartition(7), ["k"], 0)
    assert big.where("id = k + 1").count() == 5000


@pytest.mark.parametrize("ids", [[], [5], [1, 2, 3], [1, 4, 4, None, 9], [-(2**40), 7, 2**62, 2**62 + 3]])
def test_gaps(spark, ids):
    known = sorted({i for i in ids if i is not None})
    want = [(a + 1, b - a - 1) for a, b in zip(known, known[1:]) if b > a + 1]
    assert sorted(map(tuple, I.gap_runs(spark.createDataFrame([(i,) for i in ids], "id long")).collect())) == want


def test_gaps_of_sparse_ids(spark):
    rng = random.Random(1)
    ids = sorted({rng.randrange(2**63) for _ in range(500)} | set(range(2**20, 2**20 + 50)))
    got = sorted(map(tuple, I.gap_runs(spark.createDataFrame([(i,) for i in ids], "id long")).collect()))
    assert got == [(a + 1, b - a - 1) for a, b in zip(ids, ids[1:]) if b > a + 1]


def test_migration(spark):
    """Rows without an owner get one, those with one keep it; an empty table and clashing columns do no harm."""
    old = spark.createDataFrame([(5, None, "x"), (5, None, "x"), (6, 2, "y")], "question_id long, user_id long, value string")
    got = I.migrate(old, {"user_id": F.lit(477).cast("long"), "mode": F.lit("random")}, ["user_id", "question_id"])
    assert sorted(map(tuple, got.collect())) == [(5, 477, "x", "random"), (6, 2, "y", "random")]
    assert I.migrate(old.where("false"), {"user_id": F.lit(1).cast("long")}).count() == 0
    assert I.seeded(old.where("false"), old).count() == 3 and I.seeded(old.limit(1), old).count() == 1


def test_state_moves_on(spark):
    """Any split of the attempts gives the same state; a user's attempts don't touch another's."""
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), rng.randrange(4), f"2024-01-{rng.randrange(1, 29):02d} 00:00:00", rng.random() < 0.6) for i in range(120)]
    rows += [(900, None, 1, "2024-01-05 00:00:00", True), (901, 1, 1, None, True)]
    df = spark.createDataFrame(rows, "id long, user_id long, question_id long, at string, knew boolean").withColumn("attempted_at", F.col("at").cast("timestamp_ntz"))
    whole = sorted(map(tuple, L.leitner(df).collect()))
    for day in ("2024-01-01", "2024-01-12", "2024-02-01"):
        at = F.lit(day).cast("timestamp_ntz")
        moved = L.advance(L.leitner(df.where(F.col("attempted_at") < at)), df.where(F.col("attempted_at") >= at))
        assert sorted(map(tuple, moved.collect())) == whole
    one = L.advance(L.leitner(df.where("false")), spark.createDataFrame([(1, 1, 77, False), (2, 2, 77, True)], "id long, user_id long, question_id long, knew boolean").withColumn("attempted_at", F.lit("2024-01-01").cast("timestamp_ntz")))
    assert sorted((r.user_id, r.question_id, r.box) for r in one.collect()) == [(1, 77, 1), (2, 77, 2)]


def test_lists_of_channels(spark, tmp_path):
    (tmp_path / "c.txt").write_text("# channels\n@znatoki\nhttps://t.me/s/fakty/  # facts\n\nplain_name\nhttps://news.example/rss\n@znatoki\n", encoding="utf-8")
    got = sorted((r.username or "", r.link) for r in files.read_list(spark, str(tmp_path / "c.txt")).collect())
    assert got == [("", "https://news.example/rss"), ("fakty", "https://t.me/s/fakty/"), ("plain_name", "plain_name"), ("znatoki", "@znatoki")]


@pytest.mark.parametrize("text", ["ＡＢＣ ①②", "Ёлка,  ёлка!\n\tдва", "", "ﬁне_2 — «x»", "й а́", None, "½ Ⅷ ٣"])
def test_copy_keys_by_a_second_way(spark, text):
    want = " ".join(re.sub(r"[^\w\s]", "", unicodedata.normalize("NFKC", text or "").lower()).split())
    df = spark.createDataFrame([(text,), ("другое",)], "t string")
    assert want in {r.k for r in df.select(M.copy_key(F.coalesce("t", F.lit(""))).alias("k")).collect()}


def test_items(spark):
    rules = M.ItemRules(denied=("ответ",), allowed={"пушкин": "person"}, places=("рим",), expressions=(" не ",))
    rows = [("Ответ", "person", False), ("Пушкин", "place", False), ("пушкин", "person", True), ("рим", "place", True), ("рим", "person", False), ("не то", "expression", True), ("то да", "expression", False),
            ("1812", "number", True), ("слово", "work", False), ("слово", "other", True), ("", "place", False)]
    df = spark.createDataFrame(rows, "a string, k string, want boolean")
    assert df.where(M.valid_item(F.col("a"), F.col("k"), rules) != F.col("want")).count() == 0
    names = [("ООН", True), ("газета «Рейн»", True), ("Google", True), ("она", False), ("", False), ("ВСЕ", False), ("Москва", False), ("из ikea", True)]
    df = spark.createDataFrame(names, "a string, want boolean")
    assert df.where(X.is_organisation_like(F.col("a"), M.STOP_WORDS) != F.col("want")).count() == 0
    lemmas = {r.l for r in spark.createDataFrame([(w,) for w in ("книги", "книгу", "книга", "книгами")], "w string").select(X.light_lemma(F.col("w")).alias("l")).collect()}
    assert lemmas == {"книг"}


def test_repeated_texts_count_once(spark, sf_dir, tmp_path):
    """Texts come out as by distinct, also with rows repeated, ids with two texts and null ids."""
    rows = [(1, "а", "x"), (1, "а", "x"), (2, "б", "x"), (2, "в", "x"), (None, "г", "x"), (None, "г", "x"), (None, None, "x"), (3, None, "x")]
    spark.createDataFrame(rows, "id long, text string, answer string").write.parquet(str(tmp_path / "questions.parquet"))
    got = Corpus(spark, str(tmp_path)).question_columns("text").collect()
    assert sorted(map(str, got)) == sorted(map(str, {tuple(r[:2]) for r in rows})) or sorted((str(r.id), str(r.text)) for r in got) == sorted((str(a), str(b)) for a, b in {r[:2] for r in rows})


def test_only_small_tables_are_broadcast(spark):
    plan = lambda df: spark.range(10).join(df.withColumnRenamed("id", "k"), F.col("id") == F.col("k"))._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(if_small(spark.range(5), 5)) and "broadcast" not in plan(if_small(spark.range(6), 5))


def greedy(facts, most=0.6):
    """Facts in order, each kept if it overlaps no kept one."""
    kept, out, seen = {}, [], set()
    for grp, pos, text in sorted((f for f in facts if f[2] is not None), key=lambda f: f[1]):
        mine = {w for w in (w.strip(".,!?:;«»\"'()—–-").lower() for w in text.split()) if len(w) > 2}
        if mine and (grp, text) not in seen and all(len(mine & k) / len(mine | k) <= most for k in kept.get(grp, [])):
            kept.setdefault(grp, []).append(mine)
            out.append((grp, pos, text))
        seen.add((grp, text))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_facts_by_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"слово{k}" for k in range(14)]
    facts = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(4)}", i, " ".join(rng.sample(words, rng.randrange(1, 8))) + rng.choice(["", "!", " «и»"])) for i in range(150)]
    facts += [("hot", 900, None), ("hot", 901, ""), ("hot", 902, "и а"), ("hot", 903, facts[0][2])]
    df = spark.createDataFrame(facts, "grp string, pos long, text string")
    assert sorted(map(tuple, M.drop_similar_facts(df).collect())) == greedy(facts)
    assert M.drop_similar_facts(df.where("false")).count() == 0


def test_pages_that_lack_or_break_things(spark):
    from kvizmill.functions import pages as H

    html = [
        None, "", "<p>нет ничего", '<h1>Кубок <b>А</b></h1><table><tr><td>Команд</td><td>12 + 5</td></tr><tr><td>Сложность:</td><td>3,5 / 4</td></tr><tr><td>Начало</td><td>12 мая 2024 г.</td></tr></table>',
        'push([1,"{\\"packTitle\\":\\"Б\\",\\"pubDate\\":\\"2024-13-40\\"}"])<dt>Опубликован</dt><dd>01.02.2024</dd>',
    ]
    df = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    got = {r.page_id: r for r in H.page_metadata(df).collect()}
    assert all(got[i].title is None and got[i].teams_played is None and got[i].start_date is None for i in (0, 1, 2))
    assert (got[3].title, got[3].teams_played, got[3].difficulty, str(got[3].start_date)) == ("Кубок А", 17, 3.75, "2024-05-12")
    assert (got[4].title, str(got[4].published_date)) == ("Б", "2024-02-01")
    one = '<dt class="title">Кубок 2020-02-03 <a href="/t">x</a></dt><div class="question"><p><strong class="Question"><a href="/question/9">Вопрос 7:</a></strong> Кто <div>там</div>?</p>'
    html = [None, "<div class='question'><p>нет</p></div>", one, one + '<p><strong class="Answer">Ответ:</strong> <p><strong class="Other">x</strong>y</p></div>' + one.replace("Кто", "Где")]
    found = H.archive_questions(spark.createDataFrame(list(enumerate(html)), "page_id long, html string")).collect()
    assert sorted((r.page_id, r.pos, r.number, r.text, r.answer, str(r.played)) for r in found) == [
        (2, 0, 7, "Кто там ?", None, "2020-02-03"), (3, 0, 7, "Кто там ?", None, "2020-02-03"), (3, 1, 7, "Где там ?", None, "2020-02-03"),
    ]
