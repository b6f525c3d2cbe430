"""Frequencies of answers, words and word pairs, and the steps that feed them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvizmill.functions import text as X
from kvizmill.session import cut

#: Russian function words that carry no subject.
STOP_WORDS = tuple(
    "без более бы был была были было быть вам вас весь во вот все всего всех вы где да даже для до его ее ей ему если есть еще же за из или им их"
    " как когда кто ли либо мне может мы на над нам нас не него нее нет ни них но ну об один она они оно от очень по под при про раз сам себя со так также"
    " такой там то того тоже только том ты уже хотя чего чем что чтобы эта эти это этого этой этот".split()
)


def fragments(questions: DataFrame) -> DataFrame:
    """``id, pack_id, fragment, key``: single answers of questions, cleaned and split; a row per answer."""
    clean = questions.where(F.trim(F.coalesce("answer", F.lit(""))) != "").select("id", "pack_id", X.clean_answer(F.col("answer")).alias("a"))
    each = clean.select("id", "pack_id", F.explode(X.split_answer(F.col("a"))).alias("fragment"))
    return each.withColumn("key", X.token_key(F.col("fragment")))


def answer_frequency(parts: DataFrame) -> DataFrame:
    """``key, count, packs, display, reason`` per answer key.

    ``display`` is the most frequent spelling, ties by spelling; ``reason``
    says why a key is of no use, else null. Spellings and packs are counted
    before they meet at the key, so a frequent answer is no large group.
    """
    forms = parts.groupBy("key", "fragment").agg(F.count("*").alias("n"))
    counts = forms.groupBy("key").agg(F.sum("n").alias("count"), F.max_by("fragment", F.struct("n", "fragment")).alias("display"))
    packs = parts.select("key", "pack_id").distinct().groupBy("key").agg(F.count("pack_id").alias("packs"))
    return counts.join(packs, "key").withColumn("reason", X.low_info_reason(F.col("key")))


def postings(parts: DataFrame, least: int) -> DataFrame:
    """``key, question_id`` of the keys that at least ``least`` fragments have: posting lists, a row per entry."""
    frequent = parts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("key")
    return parts.join(frequent, "key", "left_semi").select("key", F.col("id").alias("question_id")).distinct()


def words(texts: DataFrame, lemma: Callable[[Column], Column] | None = None) -> DataFrame:
    """``id, pos, word``: words of at least three letters that are no stop words, in order.

    ``lemma`` maps a word column to its base form, e.g. a vectorised UDF around
    a morphological dictionary; without it words stand for themselves.
    """
    tokens = F.regexp_extract_all(X.text_key(F.col("text")), F.lit("([а-яa-z]{3,})"), F.lit(1))
    kept = F.filter(tokens, lambda w: ~w.isin(*STOP_WORDS))
    each = texts.where("text IS NOT NULL").select("id", F.posexplode(kept).alias("pos", "word"))
    return each.withColumn("word", lemma(F.col("word"))) if lemma else each


def bigrams(texts: DataFrame) -> DataFrame:
    """``bigram``: two kept words that follow each other in one text; built inside each row, without a window."""
    tokens = F.filter(F.regexp_extract_all(X.text_key(F.col("text")), F.lit("([а-яa-z]{3,})"), F.lit(1)), lambda w: ~w.isin(*STOP_WORDS))
    rows = texts.where("text IS NOT NULL").select(tokens.alias("w")).where(F.size("w") > 1)
    return rows.select(F.explode(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).alias("bigram"))


def frequency(rows: DataFrame, column: str, least: int = 1) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("count")).where(F.col("count") >= least)


def entities(texts: DataFrame, find: Callable[[Column], Column] | None = None) -> DataFrame:
    """``name, count``: names in texts, by count.

    ``find`` maps a text column to an array of names, e.g. a vectorised UDF
    around a tagger; by default runs of capitalised words inside a sentence.
    """
    return frequency(found_names(texts, find), "name")


def found_names(texts: DataFrame, find: Callable[[Column], Column] | None = None) -> DataFrame:
    """``id, name``: a row per name in a text, found as ``entities`` says."""
    by_rule = lambda t: F.regexp_extract_all(t, F.lit(r"[а-яёa-z,] (\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*)"), F.lit(1))
    return texts.where("text IS NOT NULL").select("id", F.explode((find or by_rule)(F.col("text"))).alias("name"))


def typed(names: DataFrame) -> DataFrame:
    """Names with ``type``: ORG by their words, PER for several words, LOC for one. Where a tagger gives types, this isn't needed."""
    kind = F.when(X.is_organisation_like(F.col("name"), STOP_WORDS), "ORG").when(F.contains("name", F.lit(" ")), "PER").otherwise("LOC")
    return names.withColumn("type", kind)


def top_entities(names: DataFrame, n: int) -> DataFrame:
    """``type, name, count``: the n most frequent names of each type, ties by name."""
    counts = names.groupBy("type", "name").agg(F.count("*").alias("count"))
    place = F.row_number().over(Window.partitionBy("type").orderBy(F.col("count").desc(), "name"))
    return counts.withColumn("_k", place).where(F.col("_k") <= n).drop("_k")


def sample_by_answers(postings: DataFrame, questions: DataFrame, packs: DataFrame, difficulty: tuple[float, float] | None, n: int, seed: int) -> DataFrame:
    """``id`` of n random questions of posting lists, where given of packs with a difficulty in the range (both ends count)."""
    of = questions.join(postings.select(F.col("question_id").alias("id")), "id", "left_semi")
    if difficulty:
        fit = packs.where(F.col("difficulty").between(*difficulty)).select(F.col("id").alias("pack_id"))
        of = of.join(fit, "pack_id", "left_semi")
    return of.select("id").distinct().orderBy(X.shuffle_key(F.col("id"), seed), "id").limit(n)


ITEM_KINDS = ("person", "place", "work", "science", "expression", "number")


@dataclass(frozen=True)
class ItemRules:
    """Word lists by which an item's category is checked; keys are those of ``text_key``."""

    denied: tuple[str, ...] = ()
    allowed: dict[str, str] = field(default_factory=dict)
    person_denied: tuple[str, ...] = ()
    persons: tuple[str, ...] = ()
    place_denied: tuple[str, ...] = ()
    places: tuple[str, ...] = ()
    place_words: tuple[str, ...] = ()
    works_denied: tuple[str, ...] = ()
    works: tuple[str, ...] = ()
    science: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    expressions: tuple[str, ...] = ()


def valid_item(answer: Column, kind: Column, rules: ItemRules) -> Column:
    """Whether an answer may belong to a category; what is denied is denied everywhere, and a listed answer belongs to its own alone."""
    key, n, capital = X.text_key(answer), F.size(X.tokens(answer)), X.has_capital(answer)
    padded = F.concat(F.lit(" "), key, F.lit(" "))

    def part(of: Column, words: tuple[str, ...]) -> Column:
        return reduce(or_, [F.contains(of, F.lit(w)) for w in words], F.lit(False))

    own = F.lit(None).cast("string")
    for word, of in rules.allowed.items():
        own = F.when(key == word, of).otherwise(own)
    person = ~part(key, rules.person_denied) & ~key.isin(*rules.places) & (key.isin(*rules.persons) | (n >= 2) | capital)
    place = ~part(key, rules.place_denied) & ~key.isin(*rules.persons) & (key.isin(*rules.places) | part(key, rules.place_words) | capital | (n >= 2))
    expression = key.isin(*rules.phrases) | (n >= 3) | ((n == 2) & part(padded, rules.expressions))
    by_kind = (
        F.when(kind == "person", person)
        .when(kind == "place", place)
        .when(kind == "work", ~key.isin(*rules.works_denied) & ((n >= 2) | key.isin(*rules.works)))
        .when(kind == "science", part(key, rules.science) | (n >= 2))
        .when(kind == "expression", expression)
        .when(kind == "number", X.is_numeric_like(key))
        .otherwise(True)
    )
    return ~key.isin(*rules.denied) & F.when(own.isNotNull(), own == kind).otherwise(by_kind)


def max_merge(items: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """``category, key, count``: the largest count per category and key, after renaming categories."""
    category = F.col("category")
    for old, new in aliases.items():
        category = F.when(F.col("category") == old, F.lit(new)).otherwise(category)
    return items.withColumn("category", category).groupBy("category", "key").agg(F.max("count").alias("count"))


def fill_by_passes(keys: DataFrame, passes: list[DataFrame]) -> DataFrame:
    """``key, category, pass``: the first pass that knows a category, else ``uncategorized``."""
    out = keys.select("key").distinct()
    for i, p in enumerate(passes):
        out = out.join(p.groupBy("key").agg(F.min("category").alias(f"_{i}")), "key", "left")
    found = [F.col(f"_{i}") for i in range(len(passes))]
    number = F.coalesce(*[F.when(f.isNotNull(), F.lit(i + 1)) for i, f in enumerate(found)], F.lit(0))
    return out.select("key", F.coalesce(*found, F.lit("uncategorized")).alias("category"), number.alias("pass"))


def fact_words(text: Column) -> Column:
    """Different words over two letters, in lower case, without punctuation around them."""
    stripped = F.transform(F.split(text, r"(?U)\s+"), lambda w: F.lower(F.btrim(w, F.lit(".,!?:;«»\"'()—–-"))))
    return F.array_distinct(F.filter(stripped, lambda w: F.length(w) > 2))


def similar_facts(facts: DataFrame, most: float) -> DataFrame:
    """``grp, a, b``: pairs of facts of one group, a before b, whose words overlap by more than ``most`` (Jaccard).

    Two such facts share one of the rarest words of each (prefix filter), so
    facts meet over rare words only, and large groups are spread by them.
    """
    rows = facts.select("grp", "at", "words", F.size("words").alias("n"))
    each = rows.select("grp", "at", "n", F.explode("words").alias("word"))
    count = each.groupBy("grp", "word").agg(F.count("*").alias("_n"))
    rare = F.transform(F.sort_array(F.collect_list(F.struct("_n", "word"))), lambda e: e["word"])
    prefix = F.col("n") - F.floor(F.col("n") * F.lit(most) - 1e-9).cast("int")
    ordered = each.join(count, ["grp", "word"]).groupBy("grp", "at", "n").agg(rare.alias("w"))
    index = ordered.select("grp", "at", F.explode(F.slice("w", F.lit(1), prefix)).alias("word"))
    one, other = index.withColumnRenamed("at", "a"), index.withColumnRenamed("at", "b")
    met = one.join(other, ["grp", "word"]).where("a < b").select("grp", "a", "b").distinct()
    words = rows.select("grp", "at", "words")
    both = met.join(words.select("grp", F.col("at").alias("a"), F.col("words").alias("x")), ["grp", "a"])
    both = both.join(words.select("grp", F.col("at").alias("b"), F.col("words").alias("y")), ["grp", "b"])
    return both.where(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")) > most).select("grp", "a", "b")


def drop_similar_facts(facts: DataFrame, most: float = 0.6) -> DataFrame:
    """Facts (grp, pos, text) that overlap no earlier kept one of their group by more than ``most``, as if taken in order.

    Copies are dropped first, facts without words are never kept. Then, in
    rounds: a fact without an undecided earlier one like it is kept, and all
    like it that come later are dropped. Ties of ``pos`` go by a hash of the
    text. A round is a few joins of the pairs that are left, so that no task
    holds a group.
    """
    first = Window.partitionBy("grp", F.xxhash64("text"), "text").orderBy("pos")
    once = facts.where("text IS NOT NULL").withColumn("_k", F.row_number().over(first)).where("_k = 1").select("grp", "pos", "text")
    rows = cut(once.withColumn("words", fact_words(F.col("text"))).where(F.size("words") > 0).withColumn("at", F.struct("pos", F.xxhash64("text").alias("h"))))
    edges = cut(similar_facts(rows, most))
    dropped = []
    while edges.limit(1).count():
        kept = edges.select("grp", "a").distinct().join(edges.select("grp", F.col("b").alias("a")).distinct(), ["grp", "a"], "left_anti")
        gone = cut(edges.join(kept, ["grp", "a"], "left_semi").select("grp", F.col("b").alias("at")).distinct())
        dropped.append(gone)
        edges = cut(
            edges.join(gone.withColumnRenamed("at", "b"), ["grp", "b"], "left_anti").join(gone.withColumnRenamed("at", "a"), ["grp", "a"], "left_anti")
        )
    for gone in dropped:
        rows = rows.join(gone, ["grp", "at"], "left_anti")
    return rows.select("grp", "pos", "text")


def chunk_segments(frame: pd.DataFrame, limit: int, carry: int) -> pd.DataFrame:
    """Segments of one video joined to chunks of up to ``limit`` characters; a new chunk begins with the last ``carry`` segments."""
    rows, held, length = [], [], 0
    for seg in frame.sort_values("pos").itertuples(index=False):
        text = seg.text or ""
        if held and length + len(text) > limit:
            rows.append((seg.video, len(rows), held[0][0], held[-1][0], len(held), " ".join(t for _, t in held)))
            held = held[-carry:]
            length = sum(len(t) for _, t in held)
        held.append((seg.pos, text))
        length += len(text)
    if held:
        rows.append((frame["video"].iloc[0], len(rows), held[0][0], held[-1][0], len(held), " ".join(t for _, t in held)))
    return pd.DataFrame(rows, columns=["video", "chunk", "first_pos", "last_pos", "segments", "text"])


def transcript_chunks(segments: DataFrame, limit: int = 10_000, carry: int = 3) -> DataFrame:
    """``video, chunk, first_pos, last_pos, segments, text`` from ``video, pos, text``."""
    schema = "video long, chunk long, first_pos long, last_pos long, segments long, text string"
    return segments.groupBy("video").applyInPandas(lambda f: chunk_segments(f, limit, carry), schema)


def _composed(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in frames:
        odd = ~s.map(lambda t: t is None or unicodedata.is_normalized("NFKC", t))
        yield s.where(~odd, s[odd].str.normalize("NFKC")) if odd.any() else s


def copy_key(text: Column) -> Column:
    """NFKC, lower case, no punctuation, single spaces: what copies are recognised by. Spark has no NFKC of its own; the rest is its."""
    plain = F.regexp_replace(F.lower(F.pandas_udf(_composed, "string")(text)), r"(?U)[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))
