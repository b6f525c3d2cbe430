"""Problem 4: subject areas of posts, by class-association rules.

Parallel FP-growth over the sentences of a bounded sample of labelled posts
finds words and pairs of words that go with an area. The posts' labels are
often wrong and hold for the post, not for its sentences; so the first rules
give each sentence an area or none, and the rules proper are mined from these.
A sentence is judged by the evidence of the rules it matches, and a post has
the areas of its sentences. What an amount of evidence is worth as a confidence
is read off labelled posts that had no part in the rules.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvizmill.llm.names import LOOKALIKES, one_edit
from kvizmill.llm.sampling import bounded_sample
from kvizmill.session import spread

#: Rules are mined from at most so many labelled posts, and calibrated on one in so many of them that are held out.
TRAIN_ROWS, HELD_OUT = 22_000, 11
#: Least count of a rule, shards of the parallel FP-growth, rounds of mining.
LEAST_COUNT, SHARDS, ROUNDS = 6, 12, 3
#: Least confidence of a rule, and least evidence (log-odds) for an area.
CONFIDENCE, EVIDENCE = 0.6, 1.0
NONE = ""

_SENTENCE = re.compile(r"[.!?…\n\r]+(?:\s|$)|[\n\r]+")
_NOISE = re.compile(r"(?:https?://|www\.)\S+|@\w+|#\w+", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]{3,}")
_MARKS = {0x0301: None, 0x0300: None, 0x00AD: None, 0x200B: None, 0x200D: None}


def plain(word: str) -> str:
    if not word.isascii() and re.search("[A-Za-z]", word):
        word = word.translate(LOOKALIKES)
    return word.lower().replace("ё", "е")


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence of a text, without links, tags and mentions."""
    plain = _NOISE.sub(" ", (text or "").translate(_MARKS))
    return [words for part in _SENTENCE.split(plain) if (words := _WORD.findall(part))]


def _shorter(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


class Rules:
    """Rules of one and two words: class and weight (log-odds of the confidence). A pair of NONE at even odds mutes its words."""

    def __init__(self, rules: list[tuple[str, str, str, float]], vocabulary: set[str]):
        self.single: dict[str, tuple[str, float]] = {}
        self.pair: dict[str, dict[str, tuple[str, float]]] = defaultdict(dict)
        for x, y, label, confidence in rules:
            weight = math.log(confidence / (1 - confidence))
            if y:
                self.pair[x][y] = self.pair[y][x] = (label, weight)
            else:
                self.single[x] = (label, weight)
        self.vocabulary = vocabulary
        # A rare word one edit from exactly one known word is taken for it.
        self._near: dict[str, set[str]] = defaultdict(set)
        for w in vocabulary:
            if len(w) >= 5:
                for s in _shorter(w):
                    self._near[s].add(w)
        self._known: dict[str, str] = {}
        self.active = self.single.keys() | self.pair.keys()
        self._judged: dict[frozenset[str], tuple[str, float]] = {}  # sentences of one form have the same words that count

    def item(self, word: str) -> str:
        found = self._known.get(word)
        if found is None:
            found = plain(word)
            if found not in self.vocabulary and len(found) >= 5 and word == word.lower():
                found = self._repair(found) or found
            if len(self._known) > 500_000:
                self._known = {}
            self._known[word] = found
        return found

    def _repair(self, word: str) -> str | None:
        shorter = _shorter(word)
        near = (shorter & self.vocabulary) | self._near.get(word, set())
        if not near:
            near = {w for s in shorter for w in self._near.get(s, ()) if one_edit(word, w)}
        return near.pop() if len(near) == 1 else None

    def judge(self, words: list[str]) -> tuple[str, float]:
        """The area of a sentence and the evidence for it; NONE without enough."""
        known = self._known
        items = frozenset(i for w in words if (i := known.get(w) or self.item(w)) in self.active)
        found = self._judged.get(items)
        if found is None:
            if len(self._judged) > 500_000:
                self._judged = {}
            found = self._judged[items] = self._weigh(items)
        return found

    def _weigh(self, items: frozenset[str]) -> tuple[str, float]:
        evidence: dict[str, float] = defaultdict(float)
        used: set[str] = set()
        matched = [(w, (x,), c) for x in items if (r := self.single.get(x)) for c, w in [r]]
        for x in items & self.pair.keys():
            partners = self.pair[x]
            both = (y for y in partners if y in items) if len(partners) < len(items) else (y for y in items if y in partners)
            matched += [(w, (x, y), c) for y in both if x < y for c, w in [partners[y]]]
        # Muted words first, then the surest rules; a word speaks once.
        for w, x, c in sorted(matched, key=lambda m: (m[0] > 0 or m[2] != NONE, -m[0], len(m[1]), m[1])):
            if not used.intersection(x) or (c == NONE and w <= 0):
                used.update(x)
                evidence[c] += w
        against = evidence.pop(NONE, 0.0)
        if not evidence:
            return NONE, against
        best = max(evidence, key=lambda c: (evidence[c], c))
        rest = max([against, *(v for c, v in evidence.items() if c != best)])
        return (best, evidence[best] - rest) if evidence[best] - rest >= EVIDENCE else (NONE, rest)


def _transactions(frames: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    """(items, label, n) of the sentences: the post's label, or what the rules say."""
    rules = shared and shared.value
    for f in frames:
        count: Counter = Counter()
        for text, label, n in f[["text", "label", "n"]].itertuples(index=False):
            for words in sentences(text):
                items = " ".join(sorted({rules.item(w) for w in words} if rules else {plain(w) for w in words}))
                count[(items, rules.judge(words)[0] if rules else label)] += n
        yield pd.DataFrame([(i, c, n) for (i, c), n in count.items()], columns=["items", "label", "n"])


def _shards(frames: Iterator[pd.DataFrame], rank: dict[str, int]) -> Iterator[pd.DataFrame]:
    """Group-dependent transactions: for each shard the path up to its last item."""
    for f in frames:
        count: Counter = Counter()
        for items, label, n in f[["items", "label", "n"]].itertuples(index=False):
            path = sorted(rank[i] for i in items.split(" ") if i in rank)
            seen = set()
            for k in range(len(path) - 1, -1, -1):
                shard = path[k] % SHARDS
                if shard not in seen:
                    seen.add(shard)
                    count[(shard, tuple(path[: k + 1]), label)] += n
        yield pd.DataFrame([(s, list(p), c, n) for (s, p, c), n in count.items()], columns=["shard", "path", "label", "n"])


def _grow(frame: pd.DataFrame, least: int, classes: list[str]) -> pd.DataFrame:
    """FP-growth of one shard: counts by class of its items and of pairs that end with them."""
    shard, width = int(frame["shard"].iloc[0]), len(classes)
    code = {c: i for i, c in enumerate(classes)}
    parent, item, child = [-1], [-1], [{}]
    counts = [np.zeros(width, dtype=np.int64)]
    header: dict[int, list[int]] = defaultdict(list)
    for path, label, n in frame[["path", "label", "n"]].itertuples(index=False):
        at = 0
        for i in path:
            to = child[at].get(i)
            if to is None:
                to = child[at][i] = len(item)
                parent.append(at), item.append(i), child.append({}), counts.append(np.zeros(width, dtype=np.int64))
                if i % SHARDS == shard:
                    header[i].append(to)
            at = to
            counts[at][code[label]] += n
    out = []
    for i, nodes in header.items():
        whole = sum(counts[k] for k in nodes)
        if whole.sum() < least:
            continue
        out.append((i, -1, whole.tolist()))
        conditional: dict[int, np.ndarray] = {}
        for k in nodes:
            up = parent[k]
            while up > 0:
                seen = conditional.get(item[up])
                conditional[item[up]] = counts[k].copy() if seen is None else seen + counts[k]
                up = parent[up]
        out += [(i, j, c.tolist()) for j, c in conditional.items() if c.sum() >= least]
    return pd.DataFrame(out, columns=["x", "y", "counts"])


def _mine(transactions: DataFrame, classes: list[str], noisy: bool) -> Rules:
    """Rules that are sure enough and say more than the rules of their words."""
    transactions = transactions.repartition(SHARDS, "items", "label").groupBy("items", "label").agg(F.sum("n").alias("n")).cache()
    try:
        frequent = (
            transactions.select(F.explode(F.split("items", " ")).alias("item"), "n")
            .groupBy("item")
            .agg(F.sum("n").alias("n"))
            .where(F.col("n") >= LEAST_COUNT)
            .collect()
        )
        order = sorted(frequent, key=lambda r: (-r["n"], r["item"]))
        rank = {r["item"]: k for k, r in enumerate(order)}
        names = [r["item"] for r in order]
        grown = (
            transactions.mapInPandas(lambda fs: _shards(fs, rank), "shard int, path array<int>, label string, n long")
            .repartition(SHARDS, "shard")
            .groupBy("shard")
            .applyInPandas(lambda f: _grow(f, LEAST_COUNT, classes), "x int, y int, counts array<long>")
            .collect()
        )
    finally:
        transactions.unpersist()

    def bound(hits: int, n: int, side: int) -> float:
        p = hits / n  # an end of Wilson's interval, one standard error
        return max(0.0, min(0.995, (p + 0.5 / n + side * math.sqrt(p * (1 - p) / n + 0.25 / n / n)) / (1 + 1 / n)))

    def sureness(counts) -> tuple[str, float]:
        k = int(np.argmax(counts))
        return classes[k], bound(counts[k], sum(counts), -1)

    def denied(counts, word: int) -> bool:
        """Whether a word goes with an area, but not where the pair with these counts is."""
        area, p = known.get((word, -1), (NONE, 0.0))
        return p >= least and bound(counts[classes.index(area)], sum(counts), 1) < least

    known = {(r.x, r.y): sureness(r.counts) for r in grown}
    by_pair = {(r.x, r.y): r.counts for r in grown if r.y >= 0} if noisy else {}
    least = CONFIDENCE
    if noisy:  # labels are wrong at times: the surest rules show how sure a rule can be
        top = sorted(p for (x, y), (c, p) in known.items() if y < 0)
        least = 0.5 * top[int(len(top) * 0.95)] if top else 1.0
    rules = []
    for (x, y), (label, p) in known.items():
        if p < least:
            if noisy and y >= 0 and (denied(by_pair[x, y], x) or denied(by_pair[x, y], y)):
                rules.append((*sorted((names[x], names[y])), NONE, 0.5))
            continue
        if y >= 0:
            parts = [known.get((k, -1)) for k in (x, y)]
            if any(part and part[0] == label and part[1] >= min(p - 0.02, least if noisy else 0.9) for part in parts):
                continue  # a word of it says the same
        a, b = (names[x], names[y]) if y >= 0 else (names[x], "")
        rules.append((*((a, b) if not b else sorted((a, b))), label, 0.95 if noisy else p))
    return Rules(rules, set(names))


def area_of_label(label, areas: dict[str, str]):
    """Area named by a label in any of the spellings of ``areas``, else null."""
    plain = F.lower(F.trim(label))
    out = F.lit(None).cast("string")
    for spelling, area in areas.items():
        out = F.when(plain == spelling, F.lit(area)).otherwise(out)
    return out


class Model:
    """Rules, and the evidence at which a confidence is reached (two increasing sequences)."""

    def __init__(self, rules: Rules, evidence: list[float], confidence: list[float]):
        self.rules, self.evidence, self.confidence = rules, evidence, confidence

    def sure(self, evidence: float) -> float:
        return float(np.interp(evidence, self.evidence, self.confidence))


def _increasing(x: np.ndarray, hit: np.ndarray, least: int = 50) -> tuple[list[float], list[float]]:
    """Isotonic regression of hits on x (pool adjacent violators), in blocks of at least so many values."""
    order = np.argsort(x, kind="stable")
    parts = np.array_split(order, max(1, len(order) // least)) if len(order) else []
    blocks: list[list[float]] = []
    for k in parts:
        blocks.append([float(x[k].sum()), float(hit[k].sum()), len(k)])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return [b[0] / b[2] for b in blocks], [b[1] / b[2] for b in blocks]


def calibrate(rules: Rules, judged: pd.DataFrame) -> Model:
    """Confidences for evidence, from held-out posts in which one area was found (evidence, hit).

    A hit is a post whose label is the area found. Labels are wrong at times
    whatever the evidence; so hits are taken relative to the block in which they
    are most frequent. Without held-out posts the log-odds are believed.
    """
    x, p = _increasing(judged["evidence"].to_numpy(float), judged["hit"].to_numpy(float))
    if not p or not p[-1]:
        x = [EVIDENCE + k for k in range(12)]
        return Model(rules, x, [1 / (1 + math.exp(-e)) for e in x])
    return Model(rules, x, [v / p[-1] for v in p])


def _evidence(frames: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    """(evidence, hit) of posts in which one area is found."""
    for f in frames:
        rows = []
        for text, label in zip(f["text"], f["label"]):
            found = [(a, e) for words in sentences(text) for a, e in [shared.value.judge(words)] if a != NONE]
            if len({a for a, _ in found}) == 1:
                rows.append((max(e for _, e in found), float(found[0][0] == label)))
        yield pd.DataFrame(rows, columns=["evidence", "hit"])


def fit(posts: DataFrame, examples: DataFrame, categories: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Rules from a bounded sample of labelled posts, by hash of the id, and the checked examples; the rest of the sample calibrates them."""
    context = posts.sparkSession.sparkContext
    areas = {str(s).strip().lower(): r["name"] for r in categories.select("name", "name_ru").collect() for s in (r["name"], r["name_ru"]) if s and r["name"]}
    classes = [*sorted(set(areas.values())), NONE]
    label = area_of_label(F.col("category"), areas).alias("label")
    labelled = posts.select("id", "text", label).where("label IS NOT NULL AND text IS NOT NULL")
    sample = bounded_sample(labelled, "id", rows, labelled.count()).withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "id"), F.lit(HELD_OUT)) == 0)
    sample = sample.repartition(SHARDS, F.xxhash64("text")).cache()
    try:
        taught = sample.where("NOT held").select("text", "label", F.lit(1).cast("long").alias("n")).unionByName(
            examples.select("text", label, F.lit(3).cast("long").alias("n")).where("label IS NOT NULL").coalesce(1)
        )
        rules = shared = None
        for _ in range(ROUNDS):
            made = taught.mapInPandas(lambda fs, s=shared: _transactions(fs, s), "items string, label string, n long")
            rules = _mine(made, classes, noisy=rules is None)
            shared = context.broadcast(rules)
        judged = sample.where("held").select("text", "label").mapInPandas(lambda fs: _evidence(fs, shared), "evidence double, hit double").toPandas()
    finally:
        sample.unpersist()
    return calibrate(rules, judged)


def _assign(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for b in batches:
        ids, areas, confidence = [], [], []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found: dict[str, float] = {}
            for words in sentences(text):
                area, sure = model.rules.judge(words)
                if area != NONE:
                    found[area] = max(sure, found.get(area, 0.0))
            for area in sorted(found):
                ids.append(key), areas.append(area), confidence.append(model.sure(found[area]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(areas, pa.string()), pa.array(confidence, pa.float64())], names=["id", "category", "confidence"])


def subject_areas(posts: DataFrame, examples: DataFrame, categories: DataFrame, model: Model | None = None) -> DataFrame:
    """``id, category, confidence``: the areas of each post, none for posts that only announce.

    ``posts`` has ``id, text, category``; other columns are left behind.
    ``category`` is one of ``categories.name``; confidence is what the evidence
    of the surest sentence is worth on held-out posts. Null, empty and wordless
    texts have no row; a repeated row has its areas again, under its id. Without
    labelled posts and examples there are no rules and no rows. The rules are
    broadcast: their number is bounded by the sample they come from.
    """
    shared = posts.sparkSession.sparkContext.broadcast(model or fit(posts, examples, categories))
    return spread(posts.select(F.col("id").cast("long"), F.col("text").cast("string"))).mapInArrow(
        lambda bs: _assign(bs, shared), "id long, category string, confidence double"
    )
