import datetime

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvizmill.operators import browse, compare, ingest, mining, shares, teams, training, trends


def test_growth_variants_differ_on_lost_categories(spark, rows):
    counts = spark.createDataFrame([(2020, "a", 1), (2021, "a", 1), (2021, "old", 1), (2022, "a", 1), (2022, "new", 3)], "year int, category string, count long")
    assert rows(trends.growth_rounded(counts)) == [("a", 25.0, 50.0, -25.0), ("new", 75.0, 0.0, 75.0)]
    assert rows(trends.growth(counts)) == [("a", -25.0), ("new", 75.0), ("old", -50.0)]
    assert trends.growth(counts.where("year = 2022")).count() == 0


def test_primary_topic_ties_and_nulls(spark, rows):
    t = spark.createDataFrame([(1, 7, 0.5, 1), (1, 3, 0.5, 2), (2, 1, None, 3), (2, 2, 0.1, 4)], "question_id long, subcategory_id int, confidence double, id long")
    assert rows(shares.primary_topics(t, "question_id"), "question_id", "subcategory_id") == [(1, 3), (2, 2)]


def test_kappa(spark):
    k = lambda data: compare.cohens_kappa(spark.createDataFrame(data, "cat_a int, cat_b int")).first().kappa
    assert k([(1, 1), (2, 2)]) == 1.0
    assert k([(1, 1), (1, 2), (2, 1), (2, 2)]) == 0.0
    assert k([]) == 0.0
    assert k([(1, 1), (1, 1)]) == 1.0


def test_title_search_order(spark):
    packs = spark.createDataFrame([(1, "Супер Балрог", 5), (2, "Балрог-2", 1), (3, "Балрог", 1), (4, "Другой", 9)], "id long, title string, questions long")
    assert [r.title for r in browse.search_titles(packs, "балрог", 9).collect()] == ["Балрог", "Балрог-2", "Супер Балрог"]


def test_tours(spark, rows):
    data = [(1, i, n) for i, n in enumerate([1, 2, 3, 1, 2])] + [(2, 10 + i, n) for i, n in enumerate([0, 1, 1, 2])]
    df = spark.createDataFrame(data, "pack_id long, id long, number int")
    assert [r.tour for r in ingest.tour_numbers(df).orderBy("id").collect()] == [1, 1, 1, 2, 2, 2, 2, 3, 3]


def test_merge_keeps_what_is_not_given(spark, rows):
    old = spark.createDataFrame([(1, "A", "pending"), (2, "B", "parsed")], "id long, title string, status string")
    new = spark.createDataFrame([(1, "parsed"), (3, "new")], "id long, status string")
    assert {tuple(r) for r in ingest.merge(old, new, ["id"]).collect()} == {(1, "A", "parsed"), (2, "B", "parsed"), (3, None, "new")}


def test_import_numbers_new_keys_densely(spark, rows):
    old = spark.createDataFrame([(1, "a")], "id long, k string")
    new = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "k string")
    got = ingest.import_copies_free(old, new, "k", 1_000_000)
    assert sorted(r.k for r in got.collect()) == ["b", "c"]
    assert sorted(r.id for r in got.collect()) == [1_000_000, 1_000_001]


def test_masks(spark, rows):
    m = spark.createDataFrame([(1, 1, "110"), (1, 2, "10"), (1, 3, "0001")], "pack_id long, team long, mask string")
    assert rows(ingest.mask_difficulty(m)) == [(1, 1, 3.3), (1, 2, 6.7), (1, 3, 10.0)]


def test_gaps(spark, rows):
    ids = spark.createDataFrame([(1,), (2,), (5,), (9,), (None,)], "id long")
    for span in (1 << 16, 4, 1):
        assert rows(ingest.gap_runs(ids, span)) == [(3, 2), (6, 3)]


def test_share_delta_and_skills(spark, rows):
    g = spark.createDataFrame([("a", 1), ("b", 1)], "category string, count long")
    w = spark.createDataFrame([("a", 3), ("c", 1)], "category string, count long")
    assert [r[0] for r in rows(teams.share_delta(g, w, 1.0))] == ["a", "b", "c"]
    s = spark.createDataFrame([("p", "a", 4), ("q", "a", 0), ("r", "a", 3)], "person string, category string, score int")
    assert rows(teams.skill_levels(s), "person", "level") == [("p", "expert"), ("q", "weak"), ("r", "above")]


def test_facts_are_kept_greedily(spark):
    f = pd.DataFrame({"grp": "g", "pos": [0, 1, 2, 3], "text": ["аля бета гамма дельта", "аля бета гамма эпсилон", "бета гамма эпсилон дзета", "да"]})
    assert sorted(r.pos for r in mining.drop_similar_facts(spark.createDataFrame(f), 0.55).collect()) == [0, 2]


def test_chunks_carry_the_last_segments():
    f = pd.DataFrame({"video": 1, "pos": range(6), "text": ["x" * 4] * 6})
    out = mining.chunk_segments(f, 12, 1)
    assert out[["first_pos", "last_pos", "segments"]].values.tolist() == [[0, 2, 3], [2, 4, 3], [4, 5, 2]]


def test_merged_items_and_passes(spark, rows):
    i = spark.createDataFrame([("software", "k", 3), ("science", "k", 5)], "category string, key string, count long")
    assert rows(mining.max_merge(i, {"software": "science"})) == [("science", "k", 5)]
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    one, two = spark.createDataFrame([("a", "x")], "key string, category string"), spark.createDataFrame([("a", "y"), ("b", "y")], "key string, category string")
    assert rows(mining.fill_by_passes(keys, [one, two])) == [("a", "x", 1), ("b", "y", 2), ("c", "uncategorized", 0)]


def fold(marks):
    box, streak = 1, 0
    for knew in marks:
        box, streak = (min(box + 1, 5), streak + 1) if knew else (1, 0)
    return box, streak


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.booleans(), min_size=1, max_size=12), min_size=1, max_size=8))
def test_leitner_equals_the_fold(spark, runs):
    t0 = datetime.datetime(2024, 1, 1)
    data = [(i * 100 + k, i, 1, t0 + datetime.timedelta(seconds=k // 2), knew, "c", 1.0) for i, marks in enumerate(runs) for k, knew in enumerate(marks)]
    df = spark.createDataFrame(data, "id long, user_id long, question_id long, attempted_at timestamp_ntz, knew boolean, category string, time_seconds double")
    got = {r.user_id: (r.box, r.streak) for r in training.leitner(df).collect()}
    assert got == {i: fold(marks) for i, marks in enumerate(runs)}


def test_review_is_per_user(spark):
    t = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, 1, 77, t, False), (2, 2, 77, t, True)], "id long, user_id long, question_id long, attempted_at timestamp_ntz, knew boolean")
    got = {r.user_id: (r.box, r.next_review_at) for r in training.leitner(df).collect()}
    assert got == {1: (1, t + datetime.timedelta(days=1)), 2: (2, t + datetime.timedelta(days=3))}


def test_unnamed_categories(spark, rows):
    df = spark.createDataFrame([(1, None, False), (1, "", True)], "user_id long, category string, knew boolean")
    assert rows(training.by_category(df, "user_id")) == [(1, training.UNNAMED, 2, 1)]


def test_histogram_closes_the_last_bin(spark, rows):
    df = spark.createDataFrame([(0.0,), (0.04,), (1.0,), (1.5,), (None,)], "v double")
    assert rows(shares.histogram(df, "v", 0.0, 1.0, 25)) == [(0, 1), (1, 1), (24, 1)]


def test_empty_tables(spark, sf_dir):
    t = spark.createDataFrame([], "question_id long, subcategory_id int, confidence double, id long, category string")
    assert shares.with_share(shares.question_counts(t, "category")).count() == 0
    assert shares.paired_categories(t, 1).count() == 0


def test_catalogue(spark, rows):
    names = spark.createDataFrame([("слон",), ("слоновая",), ("война мир",)], "name string")
    cat = spark.createDataFrame([(1, 1, "Слоновая кость"), (2, 2, "Война и мир"), (3, 3, "Мир и война")], "item int, pos int, title string")
    assert rows(teams.first_in_catalogue(names, cat)) == [("война мир", 2), ("слоновая", 1)]
    assert F is not None
