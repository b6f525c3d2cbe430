from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvizmill.llm import queries as Q
from kvizmill.llm.capping import over_cap
from kvizmill.llm.quotas import allocate, draw, draw_key, shortfalls, strata_counts
from tests.oracle import connect, differences


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql_twins(spark, sf_dir, name):
    assert differences(Q.QUERIES[name](spark, sf_dir), connect(sf_dir), Q.SQL[name]) is None


POST = st.tuples(st.sampled_from([1, 2, None]), st.integers(1, 9) | st.none(), st.integers(-1, 3) | st.none())


@settings(max_examples=12, deadline=None)
@given(st.lists(POST, max_size=40), st.integers(1, 4))
def test_cap_equals_brute_force(spark, posts, parts):
    df = spark.createDataFrame([(*p, "x") for p in posts], "channel_id long, post_id long, views long, position string")
    best: dict = {}
    for c, p, v in posts:
        if c is not None and p is not None:
            old = best.get((c, p))
            best[(c, p)] = v if old is None else old if v is None else max(old, v)
    channels = defaultdict(list)
    for (c, p), v in best.items():
        channels[c].append((v is None, -(v or 0), p))
    cap = len(best) // parts
    want = sorted((c, p) for c, rows in channels.items() for _, _, p in sorted(rows)[cap:])
    assert sorted(map(tuple, over_cap(df, parts).collect())) == want


MEMBERS = "plan_id int, stratum_key string, item_id long, quota string"
TARGETS = "plan_id int, stratum_key string, target_share double, min_rows int, sample_rows long"


def test_quotas(spark):
    members = [(1, "a", i, "x") for i in range(100)] + [(1, "b", i, "x") for i in range(3)] + [(1, "a", 0, "x"), (1, "a", None, "x"), (None, "a", 5, "x")] + [(1, "d", i, "x") for i in range(50)]
    df = spark.createDataFrame(members, MEMBERS)
    targets = spark.createDataFrame([(1, "a", 0.555, 0, 20), (1, "b", 0.25, 2, 20), (1, "c", 0.01, 4, 20), (1, "d", 0.185, 1, 20), (2, "z", None, None, None)], TARGETS)
    counted = strata_counts(df, targets)
    assert {r.stratum_key: r.available for r in counted.collect()} == {"a": 100, "b": 3, "c": 0, "d": 50, "z": 0}
    quotas = {r.stratum_key: (r.quota, r.short) for r in allocate(counted).collect()}
    assert quotas["b"] == (3, 2) and quotas["c"] == (0, 4)
    assert quotas["a"] == (13, 0) and quotas["d"] == (4, 0)
    assert {r.stratum_key for r in shortfalls(allocate(counted)).collect()} == {"b", "c"}
    drawn = draw(df, targets).collect()
    assert Counter(r.stratum_key for r in drawn) == {"a": 13, "b": 3, "d": 4}
    assert len({tuple(r) for r in drawn}) == 20
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, draw(df.repartition(3), targets).collect()))
    assert draw(df.where("false"), targets).count() == 0
    assert shortfalls(allocate(strata_counts(df.where("false"), targets))).count() == 4


def test_floors_are_taken_from_the_others(spark):
    """Strata lifted to their floors don't make the sample larger, unless the floors alone do."""
    targets = [(1, "a", 0.6, 1, 20), (1, "b", 0.3, 2, 20), (1, "c", 0.05, 5, 20), (1, "d", 0.05, 4, 20), (2, "a", 0.9, 6, 10), (2, "b", 0.1, 7, 10)]
    members = [(p, k, i, "x") for p, k, *_ in targets for i in range(50)]
    counted = strata_counts(spark.createDataFrame(members, MEMBERS), spark.createDataFrame(targets, TARGETS))
    quotas = {(r.plan_id, r.stratum_key): r.quota for r in allocate(counted).collect()}
    assert quotas == {(1, "a"): 7, (1, "b"): 4, (1, "c"): 5, (1, "d"): 4, (2, "a"): 6, (2, "b"): 7}


def test_hot_stratum_is_sampled_by_smallest_key(spark):
    df = spark.range(20_000).selectExpr("1 AS plan_id", "'a' AS stratum_key", "id AS item_id")
    targets = spark.createDataFrame([(1, "a", 1.0, 0, 500)], TARGETS)
    got = {r.item_id for r in draw(df, targets).collect()}
    want = {r.item_id for r in df.select("item_id", draw_key(F.col("item_id"), 42).alias("k")).orderBy("k", "item_id").limit(500).collect()}
    assert got == want


STRATUM = st.tuples(st.integers(0, 40) | st.none(), st.integers(0, 30), st.integers(0, 60))


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.lists(STRATUM, min_size=1, max_size=6), st.integers(0, 120)), min_size=4, max_size=12))
def test_quotas_keep_the_sample_size(spark, plans):
    """Random shares, floors and numbers of items: the sum, the bounds, and equal levels between them."""
    table = []
    for plan, (strata, rows) in enumerate(plans):
        whole = sum(s or 0 for s, _, _ in strata) or 1
        table += [(plan, f"k{i}", (s or 0) / whole, f, rows, n) for i, (s, f, n) in enumerate(strata)]
    counted = spark.createDataFrame(table, "plan_id int, stratum_key string, target_share double, min_rows long, sample_rows long, available long")
    by_plan = defaultdict(list)
    for r in allocate(counted).collect():
        by_plan[r.plan_id].append(r)
    for plan, (_, rows) in enumerate(plans):
        got = {r.stratum_key: r for r in by_plan[plan]}
        low = {k: min(r.min_rows, r.available) for k, r in got.items()}
        high = {k: r.available if r.target_share > 0 else low[k] for k, r in got.items()}
        assert sum(r.quota for r in got.values()) == max(sum(low.values()), min(rows, sum(high.values())))
        assert all(low[k] <= r.quota <= high[k] for k, r in got.items())
        free = [(r.quota / r.target_share, 1 / r.target_share) for k, r in got.items() if low[k] < r.quota < high[k]]
        assert all(a - da <= b + db + 1e-6 for a, da in free for b, db in free)


def test_quotas_of_made_cases(spark):
    """Floors are taken from the others, and what a cap can't give goes to them."""
    rows = [(1, "a", 0.9, 10, 100, 500), (1, "b", 0.05, 10, 100, 500), (1, "c", 0.05, 10, 100, 500)]
    rows += [(2, "a", 0.5, 0, 100, 10), (2, "b", 0.3, 0, 100, 500), (2, "c", 0.2, 0, 100, 500)]
    counted = spark.createDataFrame(rows, "plan_id int, stratum_key string, target_share double, min_rows long, sample_rows long, available long")
    quotas = [(r.plan_id, r.stratum_key, r.quota) for r in allocate(counted).orderBy("plan_id", "stratum_key").collect()]
    assert quotas == [(1, "a", 80), (1, "b", 10), (1, "c", 10), (2, "a", 10), (2, "b", 54), (2, "c", 36)]
