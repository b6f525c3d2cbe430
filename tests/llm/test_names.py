import random
import time

import pytest

from kvizmill.llm import names as N
from kvizmill.llm.names import fold, key_vectors, link_names, linked_pairs, one_edit, parse, similar_keys


@pytest.mark.parametrize(
    "name, kind, key, how",
    [
        ("Иван Дирвосук", "p", "дирвосук", "full"),
        ("Дирвосук Иван Петрович", "p", "дирвосук", "full"),
        ("Дирвосук, И. П.", "p", "дирвосук", "init"),
        ("И.Дирвосук", "p", "дирвосук", "init"),
        ("Евг. Сатбимян", "p", "сатбимян", "abbr"),
        ("Ivan Dirvosuk", "p", "дирвосук", "full"),
        ("Юля Лepмиxикян (Калинец)", "p", "лермихикян", "full"),
        ("Ксеия Музделамская", "p", "музделамская", "full"),
        ("Команда «Готсиг и совы», Калинец", "o", "готсиг", "full"),
        ("К. «Готсиг и совы»", "o", "готсиг", "init"),
        ("Komanda Gotsig", "o", "готсиг", "full"),
        ("Фантомас", "p", "фантомас", "none"),
        ("—", "p", "—", "none"),
    ],
)
def test_parts(name, kind, key, how):
    assert parse(name)[:3] == (kind, key, how)


def test_one_edit():
    assert all(one_edit("слон", w) for w in ("слон", "солн", "слн", "слоон", "злон"))
    assert not any(one_edit("слон", w) for w in ("сон1", "нолс", "", "слоны-"))
    assert fold("Наталья") == fold("Natalya") and fold("Семён") == fold("Semyon")


PEOPLE = [
    ["Иван Месденетенко", "Ivan Mesdenetenko", "Ивн Месденетенко", "Месденетенко, Иван", "Месденетенко И.", "И. Ю. Месденетенко", "Месденеетнко Иван", "Ваня Месденетенко", "ИВАН МЕСДЕНЕТЕНКО"],
    ["Константин Месденетенко", "Костя Месденетенко"],
    ["Команда «Готсиг и совы»", "Команда «Готисг и совы»", "К. «Готсиг и совы»", "Команда «Готсиг и совы», Калинец", "Komanda Gotsig"],
    ["Григорий Толвекский", "Г.Толвекский", "Гриша Толвекский", "Толвекский Григорий Максимович"],
    ["Галина Толвекская", "Галя Толвекская"],
    ["Борис Ким"],
    ["Семён Закнувагаев", "Сёма Закнувагаев"], ["Артём Закнувагаев", "Тёма Закнувагаев"],
    ["Эдуард Рехрехаев", "Э. Рехрехаев", "Eduard Rekhrekhaev"],
    ["Евгений Рехрехаев", "Е. Рехрехаев", "Женя Рехрехаев"],
]


def test_entities(spark):
    names = [n for p in PEOPLE for n in p]
    df = spark.createDataFrame([(n, "x") for n in names + names[:3]] + [(None, "y")], "name string, entity string")
    groups: dict = {}
    for r in link_names(df).collect():
        groups.setdefault(r.entity, set()).add(r.name)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, PEOPLE))
    pairs = {tuple(r) for r in linked_pairs(df).collect()}
    assert pairs == {(a, b) for p in PEOPLE for a in p for b in p if a < b}
    assert linked_pairs(df.where("false")).count() == 0


def groups_of(spark, names):
    found: dict = {}
    for r in link_names(spark.createDataFrame([(n,) for n in names], "name string")).collect():
        found.setdefault(r.entity, set()).add(r.name)
    return sorted(map(sorted, found.values()))


def test_two_edits(spark):
    """Spellings two edits from every other one of their entity are linked, other surnames of like letters aren't."""
    people = [
        ["Марина Цветаева", "Marina Cvetaeva"],
        ["Светлана Балвосатская", "Светлана Бавлосатсская"],
        ["Иван Петровский"], ["Иван Петров"],
        ["Елена Ламрасатенко"], ["Елена Ламмивосенко"],
    ]
    assert groups_of(spark, [n for p in people for n in p]) == sorted(map(sorted, people))


def test_whole_names_of_organisations(spark):
    """All words count, in any order; a town may be left out but not differ; a name that fits two stands for neither."""
    entities = [
        ["Клуб «Белая сова»", "Клуб «Сова Белая»", "клуб «Белая свва»", "К. «Белая сова», Калинец", "Klub Belaya Sova"],
        ["Клуб «Белая ворона»", "Клуб «Ворона белая» (Штарк)"],
        ["Клуб «Белая»"],
        ["Команда «Готсиг и совы»", "Команда «совы и Готсиг»", "Команда «и совы»", "Команда Готсиг"],
        ["Лига «Румнап», Тарнополье", "Лига «Румнап» (Тарнополье)"],
        ["Лига «Румнап», Калинец"],
        ["Школа 57"], ["Школа 58"],
    ]
    assert groups_of(spark, [n for e in entities for n in e]) == sorted(map(sorted, entities))


def test_names_outside_the_list(spark):
    people = [["Арминэ Дживелегова", "Дживелегова, Арминэ", "А. Дживелегова", "Арминэ Джвиелегова"], ["Торвальд Дживелегов"], ["Арсинэ Бунимович"], ["Квентин Бунимович", "Квентин Буниминович"]]
    assert groups_of(spark, [n for p in people for n in p]) == sorted(map(sorted, people))


def typed(surname, n, rng):
    """Different spellings of a surname, most with a typo or two."""
    found = {surname}
    while len(found) < n:
        w = list(surname)
        for _ in range(rng.randrange(1, 3)):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = rng.choice("абвгдежзиклмнопрстуфхчш")
        found.add("".join(w))
    return sorted(found)


def test_many_spellings_of_one_name(spark):
    """Twenty thousand spellings in one component are linked in seconds, and hang together."""
    surname = "константинопольский"
    keys = typed(surname, 20_000, random.Random(1))
    names = N.pd.DataFrame({"name": [f"Иван {k}" for k in keys], "sort": "p", "key": keys, "how": "full", "given": [["иван"]] * len(keys), "towns": [[]] * len(keys), "uses": [1000 if k == surname else 1 for k in keys]})
    names["entries"] = [[{"gram": g, "w": 1 / len(grams) ** 0.5} for g in grams] for grams in ({f"^{k}$"[i : i + 2] for i in range(len(k) + 1)} for k in keys)]
    vector = dict(zip(keys, ({e["gram"]: e["w"] for e in x} for x in names["entries"])))
    cosines = [(surname, k, sum(w * vector[surname].get(g, 0) for g, w in vector[k].items())) for k in keys if k != surname]
    begun = time.perf_counter()
    linked = N._cluster(names, N.pd.DataFrame([c for c in cosines if c[2] >= N.LINKAGE], columns=["a", "b", "cosine"]))
    assert time.perf_counter() - begun < 60
    assert linked["entity"].value_counts().iloc[0] > 0.95 * len(keys)


def test_top_n(spark):
    """The best partners are kept, all of them without a bound; most links survive a small one."""
    rng = random.Random(2)
    keys = [k for s in ("константинопольский", "преображенская", "добровольский") for k in typed(s, 40, rng)]
    vectors = key_vectors(spark.createDataFrame([(k,) for k in keys], "key string"))
    vector = {r.key: {e.gram: e.w for e in r.entries} for r in vectors.collect()}
    assert all(abs(sum(w * w for w in v.values()) - 1) < 1e-9 for v in vector.values())
    exact = {(r.a, r.b): r.cosine for r in similar_keys(vectors, None).collect()}
    want = {(a, b): sum(w * vector[b].get(g, 0) for g, w in vector[a].items()) for a in keys for b in keys if a < b}
    assert exact == pytest.approx({k: c for k, c in want.items() if c >= N.LINKAGE})
    kept = {(r.a, r.b) for r in similar_keys(vectors, 3).collect()}
    for k in keys:
        best = sorted((-c, a if b == k else b) for (a, b), c in exact.items() if k in (a, b))[:3]
        assert all((min(k, x), max(k, x)) in kept for _, x in best)
    names = spark.createDataFrame([(f"Иван {k.title()}",) for k in keys], "name string")
    whole, part = ({tuple(r) for r in linked_pairs_of(names, top)} for top in (None, 5))
    assert len(whole & part) >= 0.9 * len(whole)


def test_ngrams_stay_off_the_driver(spark):
    """However small the keys are, their n-grams aren't broadcast: these grow with the keys, a hundred bytes for each letter."""
    r = random.Random(4)
    keys = {"".join(r.choices("абвгдежзиклмнопрст", k=9)) for _ in range(500)}
    vectors = key_vectors(spark.createDataFrame([(k,) for k in keys], "key string"))
    assert {x.key for x in vectors.collect()} == keys
    assert "Broadcast" not in vectors._jdf.queryExecution().executedPlan().toString()


def linked_pairs_of(names, top):
    groups: dict = {}
    for r in link_names(names, top).collect():
        groups.setdefault(r.entity, []).append(r.name)
    return [(a, b) for g in groups.values() for a in g for b in g if a < b]


def test_the_cosine_decides(spark, monkeypatch):
    """With a threshold no cosine of different keys reaches, only names of one key are linked."""
    monkeypatch.setattr(N, "LINKAGE", 0.9999)
    df = spark.createDataFrame([("Иван Месденетенко",), ("Иван Месденетнеко",), ("Месденетенко, Иван",)], "name string")
    assert {tuple(r) for r in N.linked_pairs(df).collect()} == {("Иван Месденетенко", "Месденетенко, Иван")}
