import pytest

from kvizmill.llm.subjects import Rules, fit, plain, sentences, subject_areas


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("tg_posts", "topic_examples", "categories")]


@pytest.fixture(scope="module")
def rules(tables):
    return fit(*tables)


def test_checked_examples_are_found_again(spark, tables, rules):
    posts, examples, categories = tables
    as_posts = examples.selectExpr("CAST(example_id AS LONG) AS id", "text", "CAST(NULL AS STRING) AS category")
    want = {r.example_id: r.category for r in examples.collect()}
    got: dict = {}
    for r in subject_areas(as_posts, examples, categories, rules).collect():
        got.setdefault(r.id, set()).add(r.category)
        assert 0.5 < r.confidence <= 1
    assert sum(got.get(i) == {c} for i, c in want.items()) >= 0.9 * len(want)


def test_edges(spark, tables, rules):
    _, examples, categories = tables
    df = spark.createDataFrame(
        [(1, None, "history", "x"), (2, "", "x", "x"), (3, "123 https://a.example 👍", None, "x"), (4, "Доброе утро! Как настроение?", "sport", "x"), (5, "Вратарь отразил пенальти.", None, "x"), (5, "Вратарь отразил пенальти.", None, "x"),
         (6, "Вратарь отразил пенальти. Вокалистка спела припев.", None, "x"), (7, "ВРАТАРЬ ОТРАЗИЛ ПЕНАЛЬТИ", None, "x"), (8, "Вратарь отразил пенальти. " * 4000, None, "x")],
        "id long, text string, category string, confidence string",
    )
    got = sorted((r.id, r.category) for r in subject_areas(df, examples, categories, rules).collect())
    assert got == [(5, "sport"), (5, "sport"), (6, "music"), (6, "sport"), (7, "sport"), (8, "sport")]
    assert subject_areas(df.where("false"), examples, categories, rules).count() == 0


def test_nothing_to_learn_from(spark, tables):
    posts, examples, categories = tables
    assert subject_areas(posts.limit(20).where("category = 'nothing'"), examples.where("false"), categories).count() == 0


def test_specific_rules_override(spark):
    r = Rules([("карту", "", "geography", 0.7), ("карту", "подписей", "", 0.95)], {"карту", "подписей"})
    assert r.judge(["карту"])[0] == ""  # too little evidence alone
    assert r.judge(["карту", "подписей"])[0] == ""
    assert sentences("Раз два. Три!\nпять") == [["Раз", "два"], ["Три"], ["пять"]]
    assert plain("Спeктр") == "спектр"


def test_muted_words_say_nothing():
    """A word that goes with an area is not heard beside a word with which it doesn't."""
    r = Rules([("два", "", "music", 0.95), ("два", "дня", "", 0.5), ("голоса", "", "music", 0.95)], {"два", "дня", "голоса"})
    assert r.judge(["два"])[0] == "music" and r.judge(["два", "дня"])[0] == ""
    assert r.judge(["два", "дня", "голоса"])[0] == "music"


def test_run_on_sentences_take_time_of_their_matches():
    words = [f"слово{k}" for k in range(20_000)]
    r = Rules([(a, b, "sport", 0.9) for a, b in zip(words[::2], words[1::2])], set(words))
    assert r.judge(words)[0] == "sport"


def test_confidence_is_calibrated(spark, tables):
    """Within bins of confidence, labels of posts the model hasn't seen agree with the area as often as said, but for wrong labels."""
    posts, examples, categories = tables
    seen, rest = posts.where("id % 2 = 0"), posts.where("id % 2 = 1")
    model = fit(seen, examples, categories)
    assert all(a <= b for a, b in zip(model.confidence, model.confidence[1:])) and max(model.confidence) <= 1
    areas = {str(s).strip().lower(): r["name"] for r in categories.collect() for s in (r["name"], r["name_ru"])}
    from kvizmill.llm.subjects import area_of_label
    from pyspark.sql import functions as F

    found = subject_areas(rest, examples, categories, model).groupBy("id").agg(F.max("category").alias("area"), F.count("*").alias("n"), F.max("confidence").alias("c")).where("n = 1")
    judged = found.join(rest.select("id", area_of_label(F.col("category"), areas).alias("label")), "id").where("label IS NOT NULL").toPandas()
    hit = (judged["area"] == judged["label"]).astype(float)
    ceiling = hit.mean() / judged["c"].mean()  # labels are wrong whatever the evidence
    for _, part in judged.assign(hit=hit).groupby(judged["c"].rank(method="first") // (len(judged) / 3 + 1)):
        assert abs(part["hit"].mean() - ceiling * part["c"].mean()) < 0.15
