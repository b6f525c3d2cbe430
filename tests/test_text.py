import pytest
from pyspark.sql import functions as F

from kvizmill.functions import answers as R
from kvizmill.functions import dates, pages
from kvizmill.functions import text as X


def one(spark, value, f, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "text, want",
    [
        ("Пушкин", ["Пушкин"]),
        ("пушкин.", ["пушкин"]),
        ("«Ёлка»", ["Ёлка"]),
        ("1) Пупин. 2) Лупин.", ["Пупин", "Лупин"]),
        ("Пупин. Лупин", ["Пупин", "Лупин"]),
        ("[Не]принимать", ["Непринимать"]),
        ("за́мок", ["замок"]),
        ("42", ["42"]),
    ],
)
def test_answers_are_cleaned_and_split(spark, text, want):
    assert one(spark, text, lambda c: X.split_answer(X.clean_answer(c))) == want


@pytest.mark.parametrize("key, want", [("", "empty"), ("?!", "punctuation_only"), ("да", "stop_answer"), ("42", None), ("π", None), ("x", "stop_answer"), ("ж", "too_short_single_token"), ("слон", None)])
def test_low_info(spark, key, want):
    assert one(spark, key, X.low_info_reason) == want


@pytest.mark.parametrize("text, want", [("1.2K", 1200), ("5M", 5_000_000), ("3B", 3_000_000_000), ("1 234", 1234), ("", 0), ("n/a", 0), (None, 0)])
def test_view_counts(spark, text, want):
    assert one(spark, text, X.view_count) == want


@pytest.mark.parametrize("n, want", [(999, "999"), (1500, "1.5K"), (2_300_000, "2.3M")])
def test_view_labels(spark, n, want):
    assert one(spark, n, X.view_label, "long") == want


def test_russian_dates_of_all_months(spark):
    for i, m in enumerate(dates.MONTHS, 1):
        assert str(one(spark, f"12 {m} 2024 г.", dates.written_date)) == f"2024-{i:02}-12"
    for bad in ("12 мартобря 2024", "", None, "мая 2024", "31.02.2020"):
        assert one(spark, bad, dates.written_date) is None
    assert str(one(spark, "7.01.2016", dates.written_date)) == "2016-01-07"


@pytest.mark.parametrize(
    "field, want",
    [
        ('[{"name": "A"}, {"name": null}, {"id": 1}]', ["A"]),
        ('["A"]', []),
        ('"A"', ['"A"']),
        ("[broken, B", ["[broken", "B"]),
        ("A, B ,", ["A", "B"]),
        ("", []),
        (None, []),
    ],
)
def test_listed_or_split(spark, field, want):
    assert one(spark, field, X.listed_or_split) == want


def test_small_functions(spark):
    assert one(spark, "https://youtu.be/abcdefghijk", X.video_id) == "abcdefghijk"
    assert one(spark, "nothing", X.video_id) is None
    assert one(spark, "  Что? Где_Когда!  ", X.slug) == "что-где-когда"
    assert one(spark, "?!", X.slug) == "topic"
    assert one(spark, "<a & b>", X.escape_html) == "&lt;a &amp; b&gt;"
    assert one(spark, 65, X.clock, "int") == "1:05"
    assert [one(spark, n, lambda c: X.plural(c, "факт", "факта", "фактов"), "int") for n in (1, 3, 11, 25)] == ["факт", "факта", "фактов", "фактов"]
    assert one(spark, "mask: 0101010101, mask= 1111100000", X.answer_masks) == ["0101010101", "1111100000"]
    assert one(spark, "Ёж живёт. Он мал. А. Б. Ким.", lambda c: X.first_sentences(c, 2)) == "Ёж живёт. Он мал."
    assert one(spark, "Фреска в храме", lambda c: X.mentions("фреск", c)) is True
    assert one(spark, "афреска", lambda c: X.mentions("фреск", c)) is False
    assert one(spark, "Пушкин abc", lambda c: X.contains_ascii_folded(c, "ABC")) is True
    assert one(spark, "Пушкин", lambda c: X.contains_ascii_folded(c, "пушкин")) is False


@pytest.mark.parametrize(
    "reply, want",
    [
        ('```json\n{"topics": [{"cat": "3", "sub": 2, "conf": 0.876}]}\n```', [(3, 2, 0.88)]),
        ('{"topics": [{"cat": 0}, {"cat": 15}, {"cat": 5}]}', [(5, 1, 0.5)]),
        ('{"topics": [{"cat": 1}, {"cat": 2}, {"cat": 3}]}', [(1, 1, 0.5), (2, 1, 0.5)]),
        ('{"topics": [{"cat"', None),
        ("нет", None),
        (None, None),
    ],
)
def test_topic_replies(spark, reply, want):
    got = one(spark, reply, R.topics)
    assert (got and [tuple(t) for t in got]) == want


def test_other_replies(spark):
    assert one(spark, 'Вот {"пушкин": "2", "гоголь": 9, "x": "y"}', lambda c: R.numbered_map(c, 6)) == {"пушкин": 2}
    assert tuple(one(spark, '{"category": "null"}', R.post_category)) == (None, 0.5)
    assert one(spark, "1. Первый факт\n- Второй", R.facts) == ["Первый факт", "Второй"]
    assert one(spark, "НЕТ", R.facts) == []
    assert one(spark, '["Это довольно длинный факт о слоне", "мало"]', R.facts) == ["Это довольно длинный факт о слоне"]


def test_pages(spark):
    assert pages.html_text("<p>a &amp; b</p><script>x</script><p>c</p>") == "a & b\n\nc"
    assert pages.html_text(None) is None
    assert pages.labelled_values("<dl><dt>Дата:</dt><dd>12 мая</dd></dl><table><tr><td>Команд</td><td>10</td></tr></table>") == {"Дата": "12 мая", "Команд": "10"}
    assert pages.balanced('[{"a": "]"}, [1]] tail', 0) == '[{"a": "]"}, [1]]'
    assert pages.balanced("[1", 0) is None
    pushed = 'push([1,"{\\"questions\\":[{\\"id\\":1}]}"])'
    assert pages.embedded_arrays(pushed, "questions") == [{"id": 1}]
    assert one(spark, "a 3, b 4", pages.sum_of_numbers) == 7
    assert one(spark, "2,5 и 3.5", pages.mean_of_numbers) == 3.0
    assert one(spark, "/pack/7 /pack/12", pages.linked_pack_id) == 12
