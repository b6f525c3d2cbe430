import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kvizmill.llm import neardup as N
from kvizmill.llm.bitslice import close_pairs


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 300), st.integers(1, 6), st.integers(0, 2**32 - 1), st.sampled_from([0.02, 0.25, 0.6]))
def test_bit_slices_lose_no_pair(n, groups, seed, share):
    rng = np.random.default_rng(seed)
    bits = (rng.random((n, 128)) < 0.2).astype(np.uint8)
    for i in range(1, n, 3):
        bits[i] = bits[i - 1] ^ (rng.random(128) < 0.03)
    group, size = np.sort(rng.integers(0, groups, n)), rng.integers(1, 60, n)
    got = [(int(i), int(j)) for a, b in close_pairs(bits, size, group, share) for i, j in zip(a, b)]
    assert len(got) == len(set(got))
    wanted = {(i, j) for i, j in combinations(range(n), 2) if group[i] == group[j] and (bits[i] ^ bits[j]).sum() <= int(share * (size[i] + size[j]))}
    assert wanted <= set(got)
    assert all(group[i] == group[j] and i < j for i, j in got)


@pytest.mark.parametrize(
    "a, b",
    [("Ответ: снег", "снег."), ("«1) Гуж. 2) Пеф.»", "1) Гуж. 2) Пеф"), ("[старое] якорь", "старое якорь"), ("ЁЛКА", "елка"), ("Рехрaхаев", "рехрахаев"), ("мост (засчитать: мостик)", "мост")],
)
def test_answers_written_differently(a, b):
    assert N.answer_key(a) == N.answer_key(b)


def words(text):
    return {w for w in N._WORD.findall((text or "").translate(N._MARKS).lower())}


def brute(rows):
    """Pairs by the definition, answers equal or one letter apart."""
    from kvizmill.llm.names import one_edit

    found = set()
    for (i, t, a), (j, u, b) in combinations(rows, 2):
        x, y, k, m = words(t), words(u), N.answer_key(a), N.answer_key(b)
        digits = lambda s: [c for c in s if c.isdigit()]
        same = k == m or (min(len(k), len(m)) >= 4 and one_edit(k, m) and digits(k) == digits(m))
        if i != j and same and x and 5 * len(x & y) >= 3 * len(x | y):
            found.add((min(i, j), max(i, j)))
    return found


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"слово{k}" for k in range(60)]
    answers = ["якорь", "парус", "1066", "красная площадь", "очень длинный ответ из многих слов подряд"]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            _, text, answer = rng.choice(rows)
            w = text.split(" ")
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            answer = rng.choice([answer, answer, answer.upper(), f"Ответ: {answer}", answer[:2] + answer[3:], rng.choice(answers)])
            rows.append((i, " ".join(w), answer))
        else:
            rows.append((i, " ".join(rng.sample(vocabulary, 14)), rng.choice(answers)))
    return rows


@pytest.mark.parametrize("large", [10**6, 8])
def test_equals_brute_force(spark, monkeypatch, large):
    """Also where every group counts as large and goes by its rare words."""
    monkeypatch.setattr(N, "LARGE_GROUP", large)
    rows = corpus(3)
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(*rows[0], "x")], "id long, text string, answer string, words string")
    got = {tuple(r) for r in N.repeated_questions(df).collect()}
    want = brute(rows)
    assert want <= got
    # Two typos of one answer meet at the answer itself; nothing else may be more than brute force finds.
    text = {i: words(t) for i, t, _ in rows}
    assert all(5 * len(text[a] & text[b]) >= 3 * len(text[a] | text[b]) for a, b in got)
    assert len(got - want) <= 0.05 * len(want) + 3


def test_repeated_rows_of_large_groups(spark, monkeypatch):
    """Repeated rows, and an id with several texts, leave no fewer rare words to a text."""
    monkeypatch.setattr(N, "LARGE_GROUP", 8)
    common = [f"слово{k}" for k in range(14)]
    rows = [(1, " ".join(common), "якорь"), (2, " ".join(common[:11] + ["редкое", "иное", "третье"]), "якорь"), (2, " ".join(f"другое{k}" for k in range(14)), "якорь")]
    rows += [(10 + i, " ".join([*common[:5], *(f"прочее{i}х{k}" for k in range(9))]), "якорь") for i in range(12)]
    for times in (1, 2, 3):
        df = spark.createDataFrame(rows * times, "id long, text string, answer string")
        assert {tuple(r) for r in N.repeated_questions(df).collect()} == {(1, 2)}
    rows = corpus(5)
    df = spark.createDataFrame(rows * 2, "id long, text string, answer string")
    assert brute(rows) <= {tuple(r) for r in N.repeated_questions(df).collect()}


def test_short_answers_that_lost_a_letter(spark):
    """Four letters and three meet; three and three, three and two, or a lost digit don't."""
    text = "одно и то же слово здесь"
    pairs = [("снег", "снг"), ("дом", "дым"), ("рак", "ак"), ("1066", "106"), ("Снег", "[с]нг")]
    rows = [(10 * i + j, f"{text} {'абвгд'[i] * 9} {'абвгд'[i] * 8} {'абвгд'[i] * 7} {'абвгд'[i] * 6} {'абвгд'[i] * 5}", a) for i, p in enumerate(pairs) for j, a in enumerate(p)]
    df = spark.createDataFrame(rows, "id long, text string, answer string")
    assert {tuple(r) for r in N.repeated_questions(df).collect()} == {(0, 1), (40, 41)}


def test_long_answers_are_compared(spark):
    """Long answers that share a beginning are different; a typo at any place of a long one is none."""
    text, long = "одно и то же слово здесь", "первое второе третье четвертое пятое шестое седьмое"
    answers = ["Александр Сергеевич Пушкин писатель", "Александр Сергеевич Грибоедов поэт", "Александр Сергеевич Даргомыжский пп"]
    answers += [long, long[:20] + long[21:], long[:-2] + long[-1] + long[-2], long[::-1], "я" * 3000, "я" * 2999]
    df = spark.createDataFrame([(i, f"{text} раз{i}", a) for i, a in enumerate(answers)], "id long, text string, answer string")
    assert {tuple(r) for r in N.repeated_questions(df).collect()} == {(3, 4), (3, 5), (4, 5), (7, 8)}


def test_two_typos_of_one_answer(spark):
    """They meet at the answer itself, also where it has no more texts than they."""
    text, answers = "одно и то же слово здесь", ["розпефу", "ропефу", "розпфеу", "рзпефу"]
    df = spark.createDataFrame([(i, f"{text} раз{i}", a) for i, a in enumerate(answers)], "id long, text string, answer string")
    assert N.repeated_questions(df).count() == 6


def test_an_id_with_two_texts(spark):
    one, two = "первый вопрос о старом море и ветре", "совсем другие слова про новый город"
    df = spark.createDataFrame([(1, one, "да"), (1, two, "да"), (2, one, "да"), (3, two, "да")], "id long, text string, answer string")
    assert {tuple(r) for r in N.repeated_questions(df).collect()} == {(1, 2), (1, 3)}


@pytest.mark.parametrize("shared, most", [(3, 2000), (9, 300)])
def test_no_unit_holds_a_template(spark, shared, most):
    """A template answer with many texts comes in units of bounded size, and no link is lost."""
    rng = random.Random(7)
    rows = [(i, " ".join([*(f"общее{k}" for k in range(shared)), *(f"слово{rng.randrange(4000)}" for _ in range(7))]), "нет") for i in range(50_000 if shared == 3 else 1500)]
    planted = [(100_000 + i, t + " ещё", a) for i, t, a in rows[:40]]
    df = spark.createDataFrame(rows + planted, "id long, text string, answer string")
    texts = N._classes(df.where("false"))[2]  # the schema
    assert texts.count() == 0
    prepared = df.select("id", "text", "answer").mapInArrow(N._prepare, "id long, answer string, words array<int>, size int, bitmap binary, text_key binary")
    units = N._units(N.keep(prepared.withColumn("tid", N.F.monotonically_increasing_id())), most)
    sizes = [r["count"] for r in units.groupBy("grp").count().collect()]
    assert max(sizes) <= most * 1.2 and len(sizes) > 1
    N_large, N.LARGE_GROUP = N.LARGE_GROUP, most
    try:
        got = {tuple(r) for r in N.repeated_questions(df).collect()}
    finally:
        N.LARGE_GROUP = N_large
    assert {(i, 100_000 + i) for i in range(40)} <= got
    if shared == 9:
        every = [(i, words(t)) for i, t, _ in rows + planted]
        assert got == {(a, b) for (a, x), (b, y) in combinations(every, 2) if 5 * len(x & y) >= 3 * len(x | y)}


def test_copies_are_one_class(spark):
    df = spark.createDataFrame([(i, "одно и то же слово здесь", "да") for i in range(50)] + [(99, "одно и то же слово там", "да")], "id long, text string, answer string")
    links, members = N.near_duplicates(df)
    assert [tuple(r) for r in links.collect()] == [(0, 99)]
    assert {(r.id, r.rep) for r in members.collect()} == {(i, 0) for i in range(50)} | {(99, 99)}
    assert N.repeated_questions(df).count() == 51 * 50 // 2


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "да"), (2, None, "да"), (3, "", None), (None, "а б в", "да"), (4, "а б в", None), (5, "а б в", ""), (6, "а б в", "да"), (7, "слово " * 30_000, "x"), (8, "слово", "x")], "id long, text string, answer string")
    assert {tuple(r) for r in N.repeated_questions(df).collect()} == {(4, 5), (7, 8)}
    assert N.repeated_questions(df.where("false")).count() == 0
