"""Votes on whole questions at once.

A ballot is a question with the sources (annotator and step of confidence) and
labels of all who labelled it, an annotator once; so it is no longer than the
list of annotators. Ballots are made by one shuffle and then only read: a round
of truth discovery passes over them in Arrow batches, and what comes back are
sums per source. Pairs of annotators are counted by ballot; long ballots, whose
pairs are the square of their votes, are spread over tasks for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of annotators of one question that are counted together.
_PAIRS = 2_000_000
#: Votes of a ballot from which its pairs are counted in parts of about as many pairs as a ballot of this length has.
LONG = 2_000


def make(labels: DataFrame, sources: DataFrame) -> DataFrame:
    """``question_id, source, label``: arrays of equal length, a row per question.

    ``labels`` (question_id, model_name, step, subcategory_id) meet the small
    table ``sources`` (model_name, step, source).
    """
    numbered = labels.join(F.broadcast(sources), ["model_name", "step"])
    both = numbered.groupBy("question_id").agg(F.collect_list(F.struct("source", "subcategory_id")).alias("b"))
    return both.select("question_id", F.col("b.source").alias("source"), F.col("b.subcategory_id").alias("label"))


class Batch:
    """Ballots of an Arrow batch, flat: question number, source and label of each vote."""

    def __init__(self, b: pa.RecordBatch):
        source, label = b.column(1), b.column(2)
        lengths = np.diff(source.offsets.to_numpy())
        self.ids, self.n = b.column(0), len(lengths)
        self.question = np.repeat(np.arange(self.n), lengths)
        self.source = source.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.label = label.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.lengths = lengths
        if b.num_columns > 3:
            self.part, self.of = b.column(3).to_numpy(), b.column(4).to_numpy()

    def count(self, weight: np.ndarray, party: np.ndarray):
        """Winning label, its weight and the runner-up's, voters for it, all weight, parties, per question.

        Of the sources of one party only the heaviest speaks for a label. A tie
        goes to more voters, then to the smaller label.
        """
        w, p = weight[self.source], party[self.source]
        order = np.lexsort((-w, p, self.label, self.question))
        q, s, p, w = self.question[order], self.label[order], p[order], w[order]
        new_label = np.r_[True, (q[1:] != q[:-1]) | (s[1:] != s[:-1])] if len(q) else np.zeros(0, bool)
        speaks = new_label | np.r_[True, p[1:] != p[:-1]] if len(q) else new_label
        at = np.flatnonzero(new_label)
        option = np.cumsum(new_label) - 1
        total = np.bincount(option, weights=np.where(speaks, w, 0.0), minlength=len(at))
        voters = np.bincount(option, minlength=len(at))
        speakers = np.bincount(option, weights=speaks, minlength=len(at))
        oq, ol = q[at], s[at]
        rank = np.lexsort((ol, -voters, -total, oq))
        oq, ol, total, voters, speakers = oq[rank], ol[rank], total[rank], voters[rank], speakers[rank]
        first = np.flatnonzero(np.r_[True, oq[1:] != oq[:-1]]) if len(oq) else np.zeros(0, int)
        second = np.zeros(self.n)
        has = first + 1 < np.r_[first[1:], len(oq)]
        second[oq[first[has]]] = total[first[has] + 1]
        won, truth, supporters = np.zeros(self.n), np.zeros(self.n, np.int64), np.zeros(self.n)
        won[oq[first]], truth[oq[first]], supporters[oq[first]] = total[first], ol[first], voters[first]
        whole = np.bincount(oq, weights=total, minlength=self.n)
        parties = np.bincount(oq, weights=speakers, minlength=self.n)
        return truth, won, second, supporters, whole, parties

    def pairs(self, annotator: np.ndarray, keep: np.ndarray, annotators: int, part: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair a * annotators + b, meetings, same labels) of the kept votes, a < b, in a ballot's ``part`` of ``of``."""
        who, question, label = annotator[self.source][keep], self.question[keep], self.label[keep]
        length = np.bincount(question, minlength=self.n)
        start = np.concatenate([[0], np.cumsum(length)])
        mine = np.flatnonzero(np.arange(len(who)) % of[question] == part[question])
        parts = []
        for block in np.split(mine, np.flatnonzero(np.diff(np.cumsum(length[question[mine]]) // _PAIRS)) + 1):
            if not len(block):
                continue
            m = length[question[block]]
            i = np.repeat(block, m)
            j = np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(start[question[block]], m)
            up = who[i] < who[j]
            i, j = i[up], j[up]
            parts.append(_sums(who[i] * annotators + who[j], label[i] == label[j]))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts))


def _sums(key: np.ndarray, hit: np.ndarray):
    found, inverse = np.unique(key, return_inverse=True)
    return found, np.bincount(inverse, minlength=len(found)), np.bincount(inverse, weights=hit, minlength=len(found)).astype(np.int64)


def _out(names, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=list(names))


def errors(ballots: DataFrame, weight: np.ndarray, party: np.ndarray) -> np.ndarray:
    """Votes and errors per source, 2 x sources: an error where the consensus of the others is another label."""
    shared = ballots.sparkSession.sparkContext.broadcast((weight, party))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, p = shared.value
        sums = np.zeros((2, len(w)))
        for b in map(Batch, batches):
            truth, won, second, _, _, parties = b.count(w, p)
            judged = parties[b.question] > 1
            wrong = (b.label != truth[b.question]) | (won[b.question] - w[b.source] < second[b.question])
            sums[0] += np.bincount(b.source[judged], minlength=len(w))
            sums[1] += np.bincount(b.source[judged & wrong], minlength=len(w))
        met = np.flatnonzero(sums[0])
        yield _out(("source", "votes", "errors"), met, sums[0, met], sums[1, met])

    rows = ballots.mapInArrow(run, "source long, votes double, errors double").groupBy("source").agg(F.sum("votes"), F.sum("errors")).collect()
    out = np.zeros((2, len(weight)))
    for source, votes, wrong in rows:
        out[:, source] = votes, wrong
    return out


def meetings(ballots: DataFrame, annotator: np.ndarray, weight: np.ndarray | None, party: np.ndarray) -> DataFrame:
    """``pair, both, same``: how often two annotators met, of the votes that were wrong if weights are given."""
    shared = ballots.sparkSession.sparkContext.broadcast((annotator, weight, party))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, w, p = shared.value
        for b in map(Batch, batches):
            keep = np.ones(len(b.source), bool) if w is None else b.label != b.count(w, p)[0][b.question]
            yield _out(("pair", "both", "same"), *b.pairs(who, keep, int(who.max(initial=0)) + 1, b.part, b.of))

    pairs = F.size("source").cast("double") * F.size("source")
    of = F.ceil(pairs / F.lit(float(LONG) ** 2)).cast("long")
    short = ballots.where(F.size("source") <= LONG).select("*", F.lit(0).cast("long").alias("part"), F.lit(1).cast("long").alias("of"))
    long = ballots.where(F.size("source") > LONG).select("*", F.explode(F.sequence(F.lit(0).cast("long"), of - 1)).alias("part"), of.alias("of"))
    spread = short.unionByName(long.repartition("question_id", "part"))
    return spread.mapInArrow(run, "pair long, both long, same long").groupBy("pair").agg(F.sum("both").alias("both"), F.sum("same").alias("same"))


def outcome(ballots: DataFrame, weight: np.ndarray, party: np.ndarray) -> DataFrame:
    """``question_id, truth, annotators, agreement, support, parties``."""
    shared = ballots.sparkSession.sparkContext.broadcast((weight, party))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in map(Batch, batches):
            truth, won, _, supporters, whole, parties = b.count(*shared.value)
            n = np.maximum(b.lengths, 1)
            yield _out(("question_id", "truth", "annotators", "agreement", "support", "parties"), b.ids.cast(pa.int64()), truth.astype(np.int32), b.lengths.astype(np.int64), supporters / n, won / whole, parties.astype(np.int64))

    return ballots.mapInArrow(run, "question_id long, truth int, annotators long, agreement double, support double, parties long")


def agreement_with(ballots: DataFrame, weight: np.ndarray, party: np.ndarray) -> np.ndarray:
    """Votes and votes against the outcome per source, over questions of several parties."""
    shared = ballots.sparkSession.sparkContext.broadcast((weight, party))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, p = shared.value
        sums = np.zeros((2, len(w)))
        for b in map(Batch, batches):
            truth, _, _, _, _, parties = b.count(w, p)
            judged = parties[b.question] > 1
            sums[0] += np.bincount(b.source[judged], minlength=len(w))
            sums[1] += np.bincount(b.source[judged & (b.label != truth[b.question])], minlength=len(w))
        met = np.flatnonzero(sums[0])
        yield _out(("source", "votes", "against"), met, sums[0, met], sums[1, met])

    rows = ballots.mapInArrow(run, "source long, votes double, against double").groupBy("source").agg(F.sum("votes"), F.sum("against")).collect()
    out = np.zeros((2, len(weight)))
    for source, votes, against in rows:
        out[:, source] = votes, against
    return out
