"""The review state as a stream: one state per user, with a small entry for each question."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kvizmill.streaming.runs import drained, stream_table

_STATE = "questions array<long>, streaks array<long>, at array<long>, ids array<long>"
_OUT = "user_id long, question_id long, streak long, at long, version long"


def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold the attempts of one user, for each question in the order of time and id.

    An attempt that isn't later than the question's last one came too late and
    is dropped. A call for each question would take most of its time for the
    call, so all questions of a user are folded at once.
    """
    old = [np.array(x, "int64") for x in (state.get if state.exists else ([], [], [], []))]
    parts = [[f[c].to_numpy() for c in ("question_id", "at", "id", "knew")] for f in frames]
    question, at, last, knew = (np.concatenate(x) for x in zip(*parts))
    touched = np.unique(question)
    # The state with a place for each question that came now; the least time before there was any attempt.
    questions = np.union1d(old[0], touched)
    streaks, ats, ids = np.zeros_like(questions), np.full_like(questions, np.iinfo("int64").min), np.full_like(questions, np.iinfo("int64").min)
    for new, x in zip((streaks, ats, ids), old[1:]):
        new[np.searchsorted(questions, old[0])] = x
    order = np.lexsort((last, at, question))
    place, at, last, knew = np.searchsorted(questions, question)[order], at[order], last[order], knew[order].astype(bool)
    late = (at < ats[place]) | (at == ats[place]) & (last <= ids[place])
    late[1:] |= (place[1:] == place[:-1]) & (at[1:] == at[:-1]) & (last[1:] == last[:-1])
    place, at, last, knew = (x[~late] for x in (place, at, last, knew))
    if len(place):
        starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        ends = np.append(starts[1:], len(place)) - 1
        wrong = np.maximum.reduceat(np.where(knew, -1, np.arange(len(place))), starts)
        moved = place[starts]
        streaks[moved] = np.where(wrong < 0, streaks[moved] + ends - starts + 1, ends - wrong)
        ats[moved], ids[moved] = at[ends], last[ends]
    state.update(tuple(x.tolist() for x in (questions, streaks, ats, ids)))
    now = np.searchsorted(questions, touched)
    yield pd.DataFrame({"user_id": key[0], "question_id": touched, "streak": streaks[now], "at": ats[now], "version": ids[now]})


def leitner_stream(attempts: DataFrame) -> DataFrame:
    """Streaming ``attempts`` to changes of state; the last version of a key holds."""
    valid = attempts.where("user_id IS NOT NULL AND question_id IS NOT NULL AND attempted_at IS NOT NULL AND knew IS NOT NULL")
    number = F.coalesce("id", F.lit(int(np.iinfo("int64").min))).alias("id")  # as in a struct, null is the least
    timed = valid.select("user_id", "question_id", number, "knew", F.unix_micros(F.col("attempted_at").cast("timestamp")).alias("at"))
    changes = timed.groupBy("user_id").applyInPandasWithState(step, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)
    box = F.least(F.col("streak") + 1, F.lit(5)).cast("int").alias("box")
    return changes.select("user_id", "question_id", box, "streak", F.timestamp_micros("at").alias("last_attempt_at"), "version")


def streamed_leitner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after all events of a directory have gone through the stream."""
    attempts = stream_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("question_id"),
        F.col("ts").cast("timestamp").alias("attempted_at"),
        F.col("event_type").isin("purchase", "click").alias("knew"),
    )
    changes = drained(leitner_stream(attempts), "update")
    return changes.groupBy("user_id", "question_id").agg(F.max_by(F.struct("box", "streak", "last_attempt_at"), "version").alias("s")).select(
        "user_id", "question_id", "s.*"
    )
