"""Problem 1: questions that were entered again with changes.

Two questions belong together if their answers are the same but for writing
and typos, and their texts share at least three fifths of their words.

Candidates are compared within units: texts of one answer, and where these are
too many, texts of one answer that share rare words. Each text has a bitmap of
its hashed words; if the words of two texts overlap by t, their bitmaps differ
in no more than (1 - t) / (1 + t) of the sum of their sizes, so the bit-sliced
comparison loses no pair, and the exact overlap is only taken of what is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvizmill.llm.bitslice import close_pairs
from kvizmill.llm.names import LOOKALIKES, one_edit
from kvizmill.session import cut, keep, spread

#: Least share of words as a fraction, and bits of a bitmap.
SHARE, BITS = (3, 5), 256
#: Most texts of a unit of comparison; larger groups are split, without loss.
LARGE_GROUP = 20_000
#: Parts of a frequent word's rows when they meet its count.
SALTS = 16
#: Rows gathered from whole groups before they are compared.
BATCH_ROWS = 50_000

_WORD = re.compile(r"[^\W_]+")
_MARKS = dict.fromkeys(map(ord, "̀́­​‌‍⁠﻿")) | {ord("ё"): "е", ord("Ё"): "Е"}
_PREFIX = re.compile(r"^\W*(?:ответ|otvet|answer)\s*[:.—–-]\s*", re.IGNORECASE)
_NOTE = re.compile(r"\([^()]*\)")


def answer_key(answer: str | None) -> str:
    """An answer without case, punctuation, "Ответ:", notes in round brackets and lookalike letters.

    What square brackets make optional stays: copies differ in the brackets, not in the words.
    """
    plain = _PREFIX.sub("", (answer or "").translate(_MARKS))
    short = _NOTE.sub(" ", plain)
    if not _WORD.search(short):
        short = plain
    key = "".join(_WORD.findall(short))
    if re.search("[Ѐ-ӿ]", key):
        key = key.translate(LOOKALIKES)
    return key.lower()


_PREPARED = pa.schema([("id", pa.int64()), ("answer", pa.string()), ("words", pa.list_(pa.int32())), ("size", pa.int32()), ("bitmap", pa.binary()), ("text_key", pa.binary())])


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers: dict[str, int] = {}
    for batch in batches:
        if len(numbers) > 2_000_000:
            numbers = {}
        answers, words, sizes, bitmaps, keys = [], [], [], [], []
        for text, answer in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            found = set(_WORD.findall((text or "").translate(_MARKS).lower()))
            mine = []
            for w in found:
                n = numbers.get(w)
                if n is None:
                    n = numbers[w] = xxhash.xxh32_intdigest(w) - (1 << 31)
                mine.append(n)
            row = np.unique(np.array(mine, dtype=np.int32))
            bitmap = np.zeros(BITS, dtype=np.uint8)
            bitmap[row & (BITS - 1)] = 1
            answers.append(answer_key(answer))
            words.append(row)
            sizes.append(len(row))
            bitmaps.append(np.packbits(bitmap, bitorder="little").tobytes())
            keys.append(xxhash.xxh3_128_digest(row.tobytes() + answers[-1].encode()))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        flat = np.concatenate(words) if words else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(answers, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())), pa.array(sizes, pa.int32()), pa.array(bitmaps, pa.binary()), pa.array(keys, pa.binary())],
            schema=_PREPARED,
        )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs from rows (grp, size, id, bitmap) sorted by grp."""
    share = (SHARE[1] - SHARE[0]) / (SHARE[1] + SHARE[0])

    def flush(held: list[tuple[np.ndarray, ...]]):
        grp, size, key, bits = (np.concatenate(x) for x in zip(*held))
        for i, j in close_pairs(bits, size, grp, share):
            small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            ok = small * SHARE[1] >= large * SHARE[0]
            a, b = key[i[ok]], key[j[ok]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        grp = batch.column(0).to_numpy()
        bitmaps = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(-1, BITS // 8)
        part = (grp, batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy(), np.unpackbits(bitmaps, axis=1, bitorder="little"))
        # The rows of the last group may go on in the next batch.
        cut = int(np.searchsorted(grp, grp[-1])) if (np.diff(grp) >= 0).all() else int(np.flatnonzero(np.diff(grp, prepend=grp[0] - 1))[-1])
        if rows + cut >= BATCH_ROWS and (cut or held):
            if cut:
                held.append(tuple(x[:cut] for x in part))
                yield from flush(held)
                held, rows = [], 0
                part = tuple(x[cut:] for x in part)
            elif held[-1][0][-1] != grp[0]:
                yield from flush(held)
                held, rows = [], 0
        held.append(part)
        rows += len(part[0])
    if held:
        yield from flush(held)


_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, n, v): hashes two answers share if they are equal after leaving out at most one letter of each.

    Digits are never left out. Answers of three letters have only themselves,
    so they meet those of four that lost a letter; shorter ones have none. The
    hash is a sum of letters times powers of a base, so that all variants of an
    answer come from one running sum, in time and space of its length.
    """
    back = np.uint64(pow(_BASE, -1, 1 << 64))
    for batch in batches:
        answers = batch.column(1).to_pylist()
        length = np.array([len(a) for a in answers], dtype=np.int64)
        codes = np.frombuffer("".join(answers).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        start = np.cumsum(length) - length
        owner = np.repeat(np.arange(len(answers)), length)
        place = np.arange(len(codes)) - start[owner]
        powers = np.ones(int(length.max(initial=0)) + 1, dtype=np.uint64)
        np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(powers) - 1, _BASE, dtype=np.uint64)], out=powers)
        terms = _mix(codes + np.uint64(1)) * powers[place]
        running = np.r_[np.uint64(0), np.cumsum(terms, dtype=np.uint64)]
        before, whole = running[:-1] - running[start[owner]], running[start + length] - running[start]
        without = before + (whole[owner] - before - terms) * back
        lost = (length[owner] >= 4) & ~((codes >= 48) & (codes <= 57))
        own = np.flatnonzero(length >= 3)
        row = np.concatenate([owner[lost], own])
        value = np.concatenate([without[lost], whole[own]])
        left = np.concatenate([length[owner[lost]] - 1, length[own]]).astype(np.uint64)
        for at in range(0, len(row), 200_000):
            part = slice(at, at + 200_000)
            take = pa.array(row[part])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(2).take(take), pa.array(_mix(value[part] + left[part] * np.uint64(_BASE)).view(np.int64))], names=["grp", "n", "v"]
            )


def _typos(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, to, x, y) whose answers x and y are one typo apart, digits untouched."""
    for b in batches:
        ok = [one_edit(x, y) and [c for c in x if "0" <= c <= "9"] == [c for c in y if "0" <= c <= "9"] for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield b.filter(pa.array(ok, pa.bool_())).select([0, 1])


def _visits(answers: DataFrame) -> DataFrame:
    """``grp, to``: the texts of an answer visit the group of each one that is a typo away, unless it has less than half as many.

    So one of two visits the other, and both do where their numbers are alike:
    which of them is the one without typos can't be seen, and two typos of it
    have to meet there. A frequent answer doesn't visit its rare neighbours.
    """
    variant = cut(answers.select("grp", "answer", "n").mapInArrow(_variants, "grp long, n long, v long"))
    other = variant.select(F.col("grp").alias("to"), F.col("n").alias("m"), "v")
    near = (
        variant.join(other, "v")
        .where((F.col("grp") != F.col("to")) & (F.col("n") <= 2 * F.col("m")))
        .select("grp", "to")
        .distinct()
    )
    spelt = answers.select("grp", "answer")
    return (
        near.join(spelt.withColumnRenamed("answer", "x"), "grp")
        .join(spelt.select(F.col("grp").alias("to"), F.col("answer").alias("y")), "to")
        .select("grp", "to", "x", "y")
        .mapInArrow(_typos, "grp long, to long")
    )


def _over(rows: DataFrame, most: int) -> DataFrame:
    return rows.groupBy("grp").agg(F.count("*").alias("held")).where(F.col("held") > most)


def _split(large: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """Rows of large groups in units of at most ``most`` texts; two similar texts of a group share a unit.

    Of n words at least c = ceil(3n/5) are shared; so the k-th rarest word that
    two similar texts share, by one order of all words, is among the n - c + k
    rarest of each. A large group is split by the first shared word, a part
    that is still too large by the first and the second (a text with one word
    resembles no other, so both exist), and what is too large then is cut into
    blocks, each two of which are a unit: only texts that share answer and two
    rare words and are many all the same are compared block by block.
    """
    rows = large.join(texts.select("tid", "words"), "tid")
    each = rows.select("grp", "size", "tid", "bitmap", F.explode("words").alias("word")).withColumn("salt", F.pmod("tid", F.lit(SALTS)))
    count = each.groupBy("word").agg(F.count("*").alias("_n")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    rest = F.col("size") - F.ceil(F.col("size") * F.lit(SHARE[0]) / F.lit(SHARE[1])).cast("int")
    ordered = (
        each.join(count, ["word", "salt"])
        .groupBy("grp", "size", "tid", "bitmap")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "word"))), lambda e: e["word"]).alias("rare"))
        .withColumn("rare", F.slice("rare", 1, rest + 2))
    )
    first = keep(
        ordered.select("grp", "size", "tid", "bitmap", "rare", F.posexplode(F.slice("rare", 1, rest + 1)).alias("k", "word")).select(
            F.xxhash64("grp", "word").alias("grp"), "size", "tid", "bitmap", F.slice("rare", F.col("k") + 2, F.size("rare")).alias("after")
        )
    )
    over = cut(_over(first, most))
    fits = first.join(over, "grp", "left_anti").select("grp", "size", "tid", "bitmap")
    second = keep(
        first.join(over.select("grp"), "grp", "left_semi")
        .select("grp", "size", "tid", "bitmap", F.explode("after").alias("word"))
        .select(F.xxhash64("grp", "word").alias("grp"), "size", "tid", "bitmap")
    )
    over = cut(_over(second, most))
    blocks = F.ceil(F.col("held") / F.lit(max(1, most // 2))).cast("long")
    paired = (
        second.join(over, "grp")
        .withColumn("blocks", blocks)
        .withColumn("i", F.pmod(F.xxhash64("tid"), "blocks"))
        .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select(F.xxhash64("grp", F.least("i", "j"), F.greatest("i", "j")).alias("grp"), "size", "tid", "bitmap")
    )
    return fits.unionByName(second.join(over, "grp", "left_anti").select("grp", "size", "tid", "bitmap")).unionByName(paired)


def _units(texts: DataFrame, most: int) -> DataFrame:
    """``grp, size, tid, bitmap``: each text in all units in which it has to be compared."""
    answers = cut(texts.groupBy("answer").agg(F.count("*").alias("n")).withColumn("grp", F.xxhash64("answer")))
    visits = cut(_visits(answers))
    here = texts.select(F.xxhash64("answer").alias("grp"), "size", "tid", "bitmap")
    guests = here.join(visits, "grp").select(F.col("to").alias("grp"), "size", "tid", "bitmap")
    placed = here.unionByName(guests)
    # A group holds its own texts and its guests.
    brought = visits.join(answers.select("grp", "n"), "grp").select(F.col("to").alias("grp"), "n")
    held = answers.select("grp", "n").unionByName(brought).groupBy("grp").agg(F.sum("n").alias("n"))
    over = cut(held.where(F.col("n") > most).select("grp"))
    if over.limit(1).count():
        large = placed.join(over, "grp", "left_semi")
        placed = placed.join(over, "grp", "left_anti").unionByName(_split(large, texts, most))
    return placed


def _classes(questions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, members, texts) by ``tid``, the number of a text: its words and its answer."""
    rows = keep(
        spread(questions.where(F.col("id").isNotNull()).select(F.col("id").cast("long"), F.col("text").cast("string"), F.col("answer").cast("string")))
        .mapInArrow(_prepare, "id long, answer string, words array<int>, size int, bitmap binary, text_key binary")
        .where("size > 0")
    )
    # One row for each text, whatever the number of its copies. Numbers are fixed by writing them.
    firsts = [F.first(c).alias(c) for c in ("answer", "words", "size", "bitmap")]
    texts = keep(rows.groupBy("text_key").agg(F.min("id").alias("id"), *firsts).withColumn("tid", F.monotonically_increasing_id()))
    members = rows.select("id", "text_key").distinct().join(texts.select("text_key", "tid", F.col("id").alias("rep")), "text_key").select("id", "rep", "tid")
    found = (
        _units(texts, LARGE_GROUP)
        .repartition("grp")
        .sortWithinPartitions("grp", "size", "tid")
        .mapInArrow(_compare, "a long, b long")
        .where("a < b")
        .distinct()
    )
    words = texts.select("tid", "words")
    both = found.join(words.select(F.col("tid").alias("a"), F.col("words").alias("x")), "a").join(
        words.select(F.col("tid").alias("b"), F.col("words").alias("y")), "b"
    )
    common = F.size(F.array_intersect("x", "y"))
    enough = common * SHARE[1] >= (F.size("x") + F.size("y") - common) * SHARE[0]
    return both.where(enough).select("a", "b"), members, texts


def near_duplicates(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, members): links between different texts, and the class of exact copies of each question.

    ``questions`` has ``id, text, answer``; other columns are left behind.
    members: ``id, rep, tid``, where questions of the same words and answer
    have one ``tid``, and ``rep`` is the smallest of their ids. links: ``a, b``,
    pairs a < b of different ``rep``s whose texts share three fifths of their
    words, with the same answer. Answers are the same if their keys are equal
    or one typo apart, or both one typo from a third answer that has at least
    half as many texts as each.
    Rows without an id are left out; null texts and answers count as empty, and
    a text without words resembles no other. An id with several texts is a
    member of several classes, and stands in ``links`` for each it represents.
    """
    links, members, texts = _classes(questions)
    of = texts.select("tid", "id")
    ids = links.join(of.select(F.col("tid").alias("a"), F.col("id").alias("i")), "a").join(of.select(F.col("tid").alias("b"), F.col("id").alias("j")), "b")
    return ids.where("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct(), members


def repeated_questions(questions: DataFrame) -> DataFrame:
    """``question_id_a, question_id_b``: all pairs a < b of questions that ask the same with the same answer.

    Copies are expanded here, as the pairs of a group are asked for;
    ``near_duplicates`` has them as classes.
    """
    links, members, _ = _classes(questions)
    members = keep(members)
    one = members.select(F.col("tid").alias("a"), F.col("id").alias("i"))
    two = members.select(F.col("tid").alias("b"), F.col("id").alias("j"))
    across = links.join(one, "a").join(two, "b").select("i", "j")
    within = one.join(two, F.col("a") == F.col("b")).where("i < j").select("i", "j")
    return (
        across.unionByName(within)
        .where("i <> j")
        .select(F.least("i", "j").alias("question_id_a"), F.greatest("i", "j").alias("question_id_b"))
        .distinct()
    )
