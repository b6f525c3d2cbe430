import pytest
from pyspark.sql import functions as F

from kvizmill.operators.authors import author_names, explode_authors

CASES = [
    (None, []),
    ("", []),
    (" - ", []),
    ("[]", []),
    ("Иван Петров", ["Иван Петров"]),
    ("  Иван \t Петров", ["Иван", "Петров"]),
    ("Иван  Петров ,", ["Иван Петров"]),
    ("Варвара Физнуфизян/Олег Даздёв", ["Варвара Физнуфизян", "Олег Даздёв"]),
    ('[{"id": 1, "name": "Кугфахенко, Семён"}, {"id": 2, "name": "Школа «Биммивин и совы»"}]', ["Кугфахенко, Семён", "Школа «Биммивин и совы»"]),
    ('[{"id": 1, "name": "Школа \\"Кеплолам\\""}', ['Школа "Кеплолам"']),
    ('["\\u0418\\u0432\\u0430\\u043d", "Пётр"]', ["Иван", "Пётр"]),
    ('"Клуб ""Зис и компания""",Юрий Пеф,"Рехаев, К. М."', ['Клуб "Зис и компания"', "Юрий Пеф", "Рехаев, К. М."]),
    ("1. Иван Тафнук (Кумшино, Бурхан-Тау) 2. Эдуард Манр", ["Иван Тафнук (Кумшино, Бурхан-Тау)", "Эдуард Манр"]),
    ("Лига «Кожбез и фонари», Дмитрий Пибнув", ["Лига «Кожбез и фонари»", "Дмитрий Пибнув"]),
    ("Юрий Бав; Лига «Лудлолуд», Дольнево", ["Юрий Бав", "Лига «Лудлолуд», Дольнево"]),
    ("Лига «Лудлолуд», Верхняя Сорма | Ким", ["Лига «Лудлолуд», Верхняя Сорма", "Ким"]),
    ("Роман Ким; Гипразен, И. В.", ["Роман Ким", "Гипразен, И. В."]),
    ("А. Ким и Б. Ким and В. Ким & Г. Ким", ["А. Ким", "Б. Ким", "В. Ким", "Г. Ким"]),
    ("Странный 0 знак, Ким", ["Странный 0 знак", "Ким"]),
]


@pytest.mark.parametrize("field, want", CASES)
def test_fields(spark, field, want):
    df = spark.createDataFrame([(field,)], "v string")
    assert df.select(author_names(F.col("v")).alias("r")).first().r == want


def test_rows(spark, rows):
    df = spark.createDataFrame([(1, "А. Ким, Б. Ким", "x"), (1, "А. Ким, Б. Ким", "x"), (None, "В. Ким", "y"), (2, None, "z")], "id long, authors string, name string")
    got = {tuple(r) for r in explode_authors(df, "packs").collect()}
    assert got == {("packs", 1, 1, "А. Ким"), ("packs", 1, 2, "Б. Ким"), ("packs", None, 1, "В. Ким")}
    assert explode_authors(df.where("false"), "packs").count() == 0


def test_very_long_field(spark):
    df = spark.createDataFrame([(", ".join(f"Имя Ф{'а' * (i % 7)}" for i in range(20_000)),)], "v string")
    assert len(df.select(author_names(F.col("v")).alias("r")).first().r) == 20_000


@pytest.mark.parametrize(
    "field, want",
    [
        ('["А. Иванов; Б. Петров"]', ["А. Иванов", "Б. Петров"]),
        ('["А. Иванов, Б. Петров", "Рехаев, К. М.", "Клуб \\"Сова и Ко\\", Калинец"]', ["А. Иванов", "Б. Петров", "Рехаев, К. М.", 'Клуб "Сова и Ко", Калинец']),
        ('[{"id": 1, "name": "Иван Тафнук (Кумшино, Штарк) и Эдуард Манр"}]', ["Иван Тафнук (Кумшино, Штарк)", "Эдуард Манр"]),
    ],
)
def test_several_names_in_a_json_string(spark, field, want):
    df = spark.createDataFrame([(field,)], "v string")
    assert df.select(author_names(F.col("v")).alias("r")).first().r == want
