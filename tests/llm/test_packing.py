from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kvizmill.llm.packing import pack, plan_packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=24))
def test_plan_uses_up_the_histogram(counts):
    window = len(counts)
    histogram = np.array([0, *counts])
    used = np.zeros_like(histogram)
    for parts, n in plan_packing(histogram, window):
        assert sum(parts) <= window and n > 0
        for s in parts:
            used[s] += n
    assert used.tolist() == histogram.tolist()


def check(rows, sizes, capacity):
    load, places, pieces = defaultdict(int), defaultdict(list), defaultdict(list)
    for r in rows:
        load[r.container] += r["size"]
        places[r.container].append(r.place)
        pieces[r.doc_id].append((r.piece, r["size"]))
    assert max(load.values()) <= capacity
    for p in places.values():
        assert sorted(p) == list(range(1, len(p) + 1))
    for doc, size in sizes.items():
        got = sorted(pieces[doc])
        assert sum(s for _, s in got) == size and [k for k, _ in got] == list(range(1, len(got) + 1))
        assert len(got) == max(1, -(-size // capacity))
    return len(load)


def test_documents_find_their_places(spark):
    rng = np.random.default_rng(1)
    sizes = {i: int(s) for i, s in enumerate(rng.lognormal(5, 1.2, 3000))} | {9001: 0, 9002: 0, 9003: 2048, 9004: 5000, 9005: 1500}
    df = spark.createDataFrame([(k, v, "x") for k, v in sizes.items()], "doc_id long, size long, place string")
    limits = spark.createDataFrame([(1, 512), (2, 1500), (1, 512), (3, None), (4, 0)], "limit_id int, capacity_tokens int")
    rows = pack(df, limits).collect()
    for limit, capacity in ((1, 512), (2, 1500)):
        used = check([r for r in rows if r.limit_id == limit], sizes, capacity)
        assert used <= 1.02 * sum(sizes.values()) / capacity + 1
    assert {r.limit_id for r in rows} == {1, 2}


def test_sizes_are_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr("kvizmill.llm.packing.RANKED", 300)
    test_one_size_has_all_rows(spark)
    test_documents_find_their_places(spark)


def test_one_size_has_all_rows(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "CAST(300 AS LONG) AS size")
    limits = spark.createDataFrame([(1, 512)], "limit_id int, capacity_tokens int")
    assert check(pack(df, limits).collect(), dict.fromkeys(range(5000), 300), 512) == 5000


def test_edges(spark):
    limits = spark.createDataFrame([(1, 10)], "limit_id int, capacity_tokens int")
    df = spark.createDataFrame([(1, None), (2, -5), (2, -5), (None, 3)], "doc_id long, size long")
    rows = pack(df, limits).collect()
    assert len(rows) == 4 and len({(r.container, r.place) for r in rows}) == 4
    assert pack(df.where("false"), limits).count() == 0
    assert pack(df, limits.where("false")).count() == 0
