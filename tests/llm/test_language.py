import pytest
from pyspark.sql import functions as F

from kvizmill.llm import language as L

SENTENCES = {
    "ru": ["Вахтёр подробно описал билет в один конец", "Говорят, скрипач играл сонату на трёх струнах", "Редактор пакета принёс фразу с опечаткой", "Старый библиотекарь случайно нашёл номер телефона"],
    "uk": ["Черговий по залі описав другу підказку", "Ідеться про назву, що з'явилася торік", "Дехто з глядачів намалював пропущене слово", "Запитання взяли лише кілька команд"],
    "en": ["The host finally guessed the wrong answer", "Nobody at the table remembered three strange letters", "The question was taken by many teams", "An old librarian hid the second clue"],
    "de": ["Niemand am Tisch notierte einen fremden Schirm", "Die Frage wurde von vielen Mannschaften beantwortet", "Das zweite Team verlor die kaputte Uhr", "Über den Einspruch wird erst morgen entschieden"],
    "fr": ["Le jury décrivit la mauvaise réponse", "La deuxième équipe demanda le mot manquant", "Un vieux bibliothécaire cherchait une carte", "Notre rédacteur cacha le deuxième indice"],
    "es": ["El jurado escondió una lista de ciudades", "La pregunta fue acertada por muchos equipos", "Nuestro redactor recordó un mapa sin nombres", "La jugadora más joven olvidó la respuesta"],
}


@pytest.fixture(scope="module")
def fitted():
    texts = [". ".join(s[i:] + s[:i]) + "." for s in SENTENCES.values() for i in range(4)]
    labels = [c for c in SENTENCES for _ in range(4)]
    labels[0], labels[5] = "en", "ru"  # wrong labels are outvoted
    return L.fit(texts, labels)


def run(spark, fitted, *rows):
    df = spark.createDataFrame([(i, t, lang, "x") for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, main string")
    return df, {r.doc_id: r for r in L.identify(df, fitted).collect()}


def test_documents_and_segments(spark, fitted):
    text = "Вахтёр подробно описал билет. The host guessed the wrong answer. Nobody at the table remembered letters."
    df, got = run(
        spark, fitted, (text, "ru"), ("Vakhtyor podrobno opisal bilet v odin konets.", "en"), ("Niemand am Tisch notierte («the second clue») einen Schirm.", "DE"),
        (None, "ru"), ("", None), ("12:0 *** https://a.example/b?c", "ru"), ("Дехто з глядачів намалював слово. " * 3000, None), ("# Озёрница\n\nThe question was taken by many teams.", "eng"),
    )
    assert sorted(got[0].languages) == ["en", "ru"]
    assert [s.lang for s in got[0].segments] == ["ru", "en"] and got[0].segments[-1].end == len(text)
    assert got[1].main == "ru" and got[2].languages == ["de"] and got[6].main == "uk" and got[7].languages == ["en"]
    assert all(got[i].main is None and got[i].segments == [] for i in (3, 4, 5))
    assert all(0 <= s.confidence <= 1 for r in got.values() for s in r.segments)
    found = {tuple(r) for r in L.mislabelled(df.unionByName(df), fitted).collect()}
    assert found == {(0, "ru"), (0, "en"), (1, "ru"), (6, "uk")}
    assert L.mislabelled(df.where("false"), fitted).count() == 0


def test_segments_end_in_the_stored_text(spark, fitted):
    """Stress marks, decomposed letters and invisible characters count where they are stored."""
    one, two = "Вахтё\u0301р подро\u0301бно описа\u0301л и\u0306 биле\u0301т\u200b.", " The host\u200b guessed the wrong answer\u00ad."
    _, got = run(spark, fitted, (one + two, "ru"), (f"\u0301{one}\n{two}", "ru"))
    assert [s.end for s in got[0].segments] == [len(one), len(one + two)]
    assert got[1].segments[-1].end == 2 + len(one + two)


@pytest.mark.parametrize("text", ["а\u0301б. в\u0306г!", "\u0301\u0301х", "q\u0307\u0323. ｈ ﬁ", "각. \u1100\u1161\u11a8 \u200b\u200b", "plain"])
def test_places(text):
    cleaned = L.clean(text)
    for k, at in enumerate(L.stored_places(text, cleaned, list(range(1, len(cleaned) + 1))), 1):
        assert len(L.clean(text[:at])) >= k or at == len(text)


def test_every_document_has_a_segment_row(spark, sf_dir):
    from kvizmill.llm import queries as Q

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = Q.p10_segments(spark, sf_dir)
    assert rows.select("doc_id").distinct().count() == documents.select("doc_id").distinct().count()


def test_short_sentences(spark, fitted):
    """What counts is the distance to the text's own language, for the letters there are; names count as words."""
    text = "The host guessed the wrong answer. Nobody at the table remembered three letters. "
    short = ["Кто нашёл?", "Тема: опус.", "Anna notierte Schirm.", "Movzisroz Demmuz.", "Билет!"]
    _, got = run(spark, fitted, *((text + s, "en") for s in short))
    assert [sorted(got[i].languages) for i in range(len(short))] == [["en", "ru"], ["en", "ru"], ["de", "en"], ["en"], ["en"]]


@pytest.mark.parametrize("label, want", [("ru-RU", "ru"), ("русский", "ru"), ("en_US", "en"), ("es-419", "es"), ("bg", "bg"), (None, ""), (" ", ""), ("und", ""), ("??", ""), ("N/A", "")])
def test_labels(spark, label, want):
    df = spark.createDataFrame([(label,)], "lang string")
    assert df.select(L.label_code(F.col("lang")).alias("c")).first().c == want


def test_held_out_accuracy(spark):
    """Fitted on one half of the labelled documents, most of the other half's labels are found again."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    half = docs.where("doc_id % 2 = 0")
    sample = L.training_rows(half).collect()
    found = L.identify(docs.where("doc_id % 2 = 1"), L.fit([r.text for r in sample], [r.code for r in sample]))
    judged = found.where(F.col("label").isin(*L.LANGUAGES) & (F.size("languages") == 1)).agg(F.avg((F.col("label") == F.col("main")).cast("int")).alias("a")).first()
    assert judged.a > 0.8  # a good tenth of the labels is wrong


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "слово за слово", "xx")], "doc_id long, text string, lang string")
    assert L.identify(df).count() == 1
