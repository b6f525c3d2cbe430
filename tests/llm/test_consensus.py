import datetime
import random

import pytest

from kvizmill.llm import consensus as C
from kvizmill.llm.consensus import consensus_of_three, discover, main_labels

TOPICS = "question_id long, model_name string, subcategory_id int, confidence double, method string, classified_at timestamp_ntz, truth int"
T = datetime.datetime(2024, 1, 1)


def table(spark, rows):
    return spark.createDataFrame([(*r, "llm", T, 0) for r in rows], TOPICS)


@pytest.fixture(params=[C.MANY_SOURCES, 0], ids=["ballots", "joins"], autouse=True)
def both_ways(request, monkeypatch):
    monkeypatch.setattr(C, "MANY_SOURCES", request.param)


def test_reliable_annotators_outvote_copies(spark):
    """Three good annotators win against noise and a pair that copies its errors."""
    rng = random.Random(5)
    rows, truth = [], {}
    for q in range(400):
        truth[q] = rng.randrange(30)
        label = lambda p: truth[q] if rng.random() < p else rng.randrange(30)  # noqa: E731, B023
        bad = label(0.35)
        rows += [(q, "good", label(0.93), 0.9), (q, "fine", label(0.8), 0.8), (q, "third", label(0.75), 0.8), (q, "noise", rng.randrange(30), 0.7), (q, "bad", bad, 0.75), (q, "copy", bad, 0.75)]
    consensus, annotators = discover(table(spark, rows))
    right = sum(r.subcategory_id == truth[r.question_id] for r in consensus.collect())
    by = {r.model_name: r for r in annotators.collect()}
    assert right >= 0.9 * 400
    assert by["good"].weight > by["fine"].weight > by["noise"].weight
    assert by["bad"].party == by["copy"].party and by["good"].party == "good"
    assert 0.85 < by["good"].reliability <= 1


def test_main_label(spark):
    rows = [(1, "a", 5, 0.9), (1, "a", 6, 0.4), (1, "a", 5, None), (2, "p", 7, 80.0), (2, "p", 8, 60.0), (3, None, 1, 0.9), (None, "a", 1, 0.9), (4, "a", None, 0.9), (5, "b", 9, 0.5), (5, "b", 3, 0.5)]
    got = {(r.question_id, r.model_name): (r.subcategory_id, round(r.confidence, 2)) for r in main_labels(table(spark, rows)).collect()}
    assert got == {(1, "a"): (5, 0.9), (2, "p"): (7, 0.8), (5, "b"): (3, 0.5)}


def test_small_tables(spark):
    rows = [(1, "a", 5, 0.9), (1, "b", 5, 0.9), (1, "c", 6, None), (2, "a", 1, 0.5), (3, "a", 4, 0.5), (3, "b", 2, 0.5)]
    consensus, _ = discover(table(spark, rows + rows))
    got = {r.question_id: (r.subcategory_id, r.annotators, round(r.agreement, 2)) for r in consensus.collect()}
    assert got[1] == (5, 3, 0.67) and got[2] == (1, 1, 1.0) and got[3][1:] == (2, 0.5)
    assert [tuple(r) for r in consensus_of_three(table(spark, rows)).collect()] == [(1, 5)]
    assert consensus_of_three(table(spark, rows[:0])).count() == 0


def test_ways_agree(spark, monkeypatch):
    topics = spark.read.parquet("/root/testdata/sf0.01/question_topics.parquet")
    found = []
    for most in (10**6, 0):
        monkeypatch.setattr(C, "MANY_SOURCES", most)
        consensus, annotators = discover(topics, 3)
        found.append(({r.question_id: (r.subcategory_id, r.annotators, round(r.agreement, 6), round(r.support, 6)) for r in consensus.collect()}, {r.model_name: (r.labels, r.errors, round(r.weight, 6), r.party) for r in annotators.collect()}))
    assert found[0] == found[1]


def test_stray_values_dont_change_a_scale(spark):
    """One 95 among confidences up to 1, and one 1.0 among per cents, are what they look like."""
    rows = [(q, "plain", 1, 0.5) for q in range(9)] + [(9, "plain", 1, 95.0)] + [(q, "cent", 1, 60.0) for q in range(9)] + [(9, "cent", 1, 1.0)]
    got = {(r.question_id, r.model_name): round(r.confidence, 3) for r in main_labels(table(spark, rows)).collect()}
    assert got[0, "plain"] == 0.5 and got[9, "plain"] == 0.95 and got[0, "cent"] == 0.6 and got[9, "cent"] == 0.01


def test_a_question_everyone_labelled(spark, monkeypatch):
    """Pairs of a long ballot are counted in parts, with the same result."""
    rng = random.Random(3)
    rows = [(q, f"a{m}", rng.randrange(4), 0.5) for q in range(30) for m in range(40) if q == 0 or rng.random() < 0.3]
    found = []
    for long in (2000, 4):
        monkeypatch.setattr("kvizmill.llm.ballots.LONG", long)
        consensus, annotators = discover(table(spark, rows), 3)
        found.append((sorted(map(tuple, consensus.collect())), sorted(map(tuple, annotators.collect()))))
    assert found[0] == found[1] and max(r[2] for r in found[0][0]) == 40
