"""Problem 10: the languages of documents and of their sentences.

Multinomial naive Bayes over hashed character n-grams of words. The n-grams
don't cross word borders, so a word has one vector of log-probabilities,
whatever the text; each worker keeps those of the words it has met, and a
sentence is a sum of rows of that matrix.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvizmill.llm.sampling import bounded_sample
from kvizmill.session import spread

#: The languages told apart.
LANGUAGES = ("ru", "uk", "en", "de", "fr", "es")

#: Spellings of a language label beside its two-letter code.
LABELS = {
    "ru": ("rus", "russian", "русский"),
    "uk": ("ukr", "ukrainian", "украинский", "українська"),
    "en": ("eng", "english", "английский"),
    "de": ("deu", "ger", "german", "deutsch", "немецкий"),
    "fr": ("fra", "fre", "french", "français", "francais", "французский"),
    "es": ("spa", "spanish", "español", "espanol", "castellano", "испанский"),
}

#: Labels that name no language.
PLACEHOLDERS = ("", "und", "n/a", "na", "unknown", "none", "null", "??", "???", "?", "-", "xx", "zxx", "mul", "other")

#: The classifier is fitted on at most so many labelled documents of at most so many characters.
TRAIN_ROWS, TRAIN_CHARS = 6000, 4000
BUCKETS, ORDERS, PASSES = 1 << 18, (1, 2, 3, 4), 4
#: Log-odds from which a sentence's language is taken as certain, and log-odds a letter against the language of the
#: text from which a sentence of two words, often a heading with a loan word, brings in a language; single words never do.
MARGIN, SHORT_MARGIN = 4.0, 6.0
CACHE_WORDS = 1_000_000

#: The usual English romanisation of Cyrillic letters.
ROMAN = dict(
    zip(
        "абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґ",
        "a b v g d e yo zh z i y k l m n o p r s t u f kh ts ch sh shch  y  e yu ya i yi ye g".split(" "),
    )
)
#: Weight of a Cyrillic word's romanised spelling beside the word itself, when fitting.
ROMAN_WEIGHT = 0.3

_TOKEN = re.compile(
    r"(?:https?://|www\.)\S+|[@#]\w+|\([^()\n]{0,120}\)"  # links, tags and brackets aren't part of the sentence
    r"|([^\W\d_]+(?:['’ʼ][^\W\d_]+)*)|([.!?…]+(?=[\s»\"”)]|$)|[\n\r  ]+)"
)
_MARKS = re.compile("[̀́­​-‏⁠﻿№]")


def clean(text: str) -> str:
    """NFC without stress marks and invisible characters."""
    if text.isascii():
        return text
    return _MARKS.sub("", unicodedata.normalize("NFC", text))


_PART = re.compile(r"[\x00-\x7f][^\x00-\x7f]*|[^\x00-\x7f]+")


def stored_places(text: str, cleaned: str, places: list[int]) -> list[int]:
    """Places in ``text`` as it is stored, for increasing places in its ``clean`` form.

    Nothing is composed across the beginning of an ASCII character, so the
    parts that begin with one can be cleaned by themselves.
    """
    if cleaned == text:
        return places
    out, done, stored, parts = [], 0, 0, _PART.finditer(text)
    part, length = "", 0
    for place in places:
        while done + length < place:
            done, stored = done + length, stored + len(part)
            part = next(parts)[0]
            length = len(clean(part))
        if done + length == place:
            out.append(stored + len(part))
        else:
            out.append(stored + next(k for k in range(1, len(part) + 1) if len(clean(part[:k])) >= place - done))
    return out


def label_code(column):
    """Two-letter code of a label; "" for a missing one; the label itself if it names another language."""
    plain = F.lower(F.trim(F.coalesce(column.cast("string"), F.lit(""))))
    short = F.regexp_replace(plain, r"^([a-z]{2,3})[-_].*$", "$1")
    out = F.when(plain.isin(*PLACEHOLDERS) | short.isin(*PLACEHOLDERS), F.lit(""))
    for code, names in LABELS.items():
        out = out.when((short == code) | short.isin(*names), F.lit(code))
    return out.otherwise(short)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams of the words, and the word each belongs to."""
    joined = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    owner = np.cumsum(codes == 2) - 1
    buckets, owners = [], []
    h = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            inside = owner[:m] == owner[n - 1 :]
            if n == 1:
                inside &= codes > 3
            buckets.append((mixed >> np.uint64(40)).astype(np.int64)[inside] & (BUCKETS - 1))
            owners.append(owner[:m][inside])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


class _Words:
    """Numbers of words, and for each number a row of scores once a model is there."""

    def __init__(self, table: np.ndarray | None = None):
        self.table = table
        self.number: dict[str, int] = {}
        self.new: list[str] = []
        self.named = np.zeros(0, dtype=bool)
        self.letters = np.zeros(0, dtype=np.int64)
        self.rows = np.zeros((0, len(LANGUAGES)), dtype=np.float32)

    def tell(self, word: str) -> int:
        n = self.number.get(word)
        if n is None:
            n = self.number[word] = len(self.number)
            self.new.append(word)
        return n

    def settle(self) -> None:
        """Score the words met since the last time."""
        if not self.new:
            return
        self.named = np.concatenate([self.named, np.array([w[:1].isupper() for w in self.new])])
        self.letters = np.concatenate([self.letters, np.array([len(w) for w in self.new])])
        if self.table is not None:
            rows = np.zeros((len(self.new), len(LANGUAGES)), dtype=np.float32)
            for at in range(0, len(self.new), 20_000):
                buckets, owner = _grams([w.lower() for w in self.new[at : at + 20_000]])
                np.add.at(rows, owner + at, self.table[buckets])
            self.rows = np.concatenate([self.rows, rows])
        self.new = []


def _sentences(texts: list[str | None], words: _Words):
    """Words, their sentences, and the text and end place of each sentence.

    Returns (word numbers, sentence of each word, counted words mask, text of
    each sentence, end offset of each sentence in its cleaned text). A name,
    that is a capitalised word inside a sentence, isn't counted, unless the
    sentence has no other words.
    """
    numbers, of, first, owner, ends = [], [], [], [], []
    k = 0
    for i, text in enumerate(texts):
        if not text:
            continue
        begun, cleaned = False, clean(text)
        for m in _TOKEN.finditer(cleaned):
            kind = m.lastindex
            if kind == 1:
                numbers.append(words.tell(m[1]))
                of.append(k)
                first.append(not begun)
                begun = True
            elif kind == 2 and begun:
                owner.append(i)
                ends.append(m.end())
                k, begun = k + 1, False
        if begun:
            owner.append(i)
            ends.append(len(cleaned))
            k += 1
    words.settle()
    number, sentence = np.array(numbers, dtype=np.int64), np.array(of, dtype=np.int64)
    counted = ~words.named[number] | np.array(first, dtype=bool) if len(number) else np.zeros(0, dtype=bool)
    lower = np.bincount(sentence[~words.named[number]], minlength=k) if len(number) else np.zeros(k)
    if len(number):
        counted |= lower[sentence] == 0
    return number, sentence, counted, np.array(owner, dtype=np.int64), np.array(ends, dtype=np.int64)


def fit(texts: list[str], labels: list[str]) -> np.ndarray:
    """Log-probabilities by hash bucket and language, from documents with doubtful labels.

    Starts from the documents' labels, then gives each sentence the language
    the model finds and counts again, so that wrong labels and mixed documents
    stop mattering.
    """
    words = _Words()
    number, sentence, counted, owner, _ = _sentences(texts, words)
    number, sentence = number[counted], sentence[counted]
    code = {c: i for i, c in enumerate(LANGUAGES)}
    lang = np.array([code[x] for x in labels], dtype=np.int64)[owner] if len(owner) else np.zeros(0, np.int64)
    vocabulary = [w.lower() for w in words.number]
    buckets, holder = _grams(vocabulary)
    # A language keeps its words when they are written in Latin letters.
    cyrillic = [i for i, w in enumerate(vocabulary) if any(c in ROMAN for c in w)]
    roman, roman_holder = _grams(["".join(ROMAN.get(c, c) for c in vocabulary[i]) for i in cyrillic])
    roman_holder = np.array(cyrillic, dtype=np.int64)[roman_holder]
    by_language = np.zeros((len(LANGUAGES), len(vocabulary)))
    table = np.zeros((BUCKETS, len(LANGUAGES)), dtype=np.float32)
    for _ in range(PASSES):
        for j in range(len(LANGUAGES)):
            by_language[j] = np.bincount(number[lang[sentence] == j], minlength=len(vocabulary))
        counts = np.stack(
            [
                np.bincount(buckets, weights=w[holder], minlength=BUCKETS)
                + np.bincount(roman, weights=ROMAN_WEIGHT * w[roman_holder], minlength=BUCKETS)
                for w in by_language
            ],
            axis=1,
        )
        total = counts.sum(axis=0)
        met = max(1, int((counts.sum(axis=1) > 0).sum()))
        table = (np.log(counts + 0.3) - np.log(total + 0.3 * met)).astype(np.float32)
        rows = np.zeros((len(vocabulary), len(LANGUAGES)))
        np.add.at(rows, holder, table[buckets])
        score = np.zeros((len(owner), len(LANGUAGES)))
        np.add.at(score, sentence, rows[number])
        score[:, total == 0] = -np.inf
        found, ordered = score.argmax(axis=1), np.sort(score, axis=1)
        sure = ordered[:, -1] - ordered[:, -2] > MARGIN
        lang = np.where(sure, found, lang)
    table[:, total == 0] = -30.0
    return table


def training_rows(docs: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> DataFrame:
    """The bounded sample the classifier is fitted on: labelled documents, by hash of the id."""
    code = label_code(F.col("lang"))
    labelled = docs.select("doc_id", "text", code.alias("code")).where(F.col("code").isin(*LANGUAGES))
    fit_for = labelled.where(F.length("text").between(20, chars))
    return bounded_sample(fit_for, "doc_id", rows, fit_for.count()).select("text", "code")


def _judge(score: np.ndarray, size: np.ndarray, words: np.ndarray, letters: np.ndarray):
    """Languages of one text's sentences: index, confidence, and whether the sentence may bring in a language.

    ``size`` and ``letters`` are of the counted words, ``words`` is the number of all.
    """
    ordered = np.sort(score, axis=1)
    margin = ordered[:, -1] - ordered[:, -2]
    best = score.argmax(axis=1)
    short = words <= 2
    own = (margin >= np.where(short, SHORT_MARGIN * letters, MARGIN)) & (size > 1)
    weight = np.bincount(best[own], weights=size[own], minlength=len(LANGUAGES)) if own.any() else None
    main = int(weight.argmax()) if weight is not None and weight.any() else int(score.sum(axis=0).argmax())
    # That a third language comes close doesn't make a short sentence one of the text's own language.
    own |= short & (size > 1) & (margin >= MARGIN) & (ordered[:, -1] - score[:, main] >= SHORT_MARGIN * letters)
    lang = np.where(own, best, main)
    shifted = np.exp(score - ordered[:, -1:])
    confidence = shifted[np.arange(len(lang)), lang] / shifted.sum(axis=1)
    return lang, confidence, own, main


_SEGMENT = pa.list_(pa.struct([("lang", pa.string()), ("end", pa.int32()), ("confidence", pa.float64())]))


def _identify(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    words = _Words(table.value)
    for batch in batches:
        if len(words.number) > CACHE_WORDS:
            words = _Words(table.value)
        keys, texts = batch.column(0), batch.column(1).to_pylist()
        number, sentence, counted, owner, ends = _sentences(texts, words)
        score = np.zeros((len(owner), len(LANGUAGES)))
        for j in range(len(LANGUAGES)):
            score[:, j] = np.bincount(sentence[counted], weights=words.rows[number[counted], j], minlength=len(owner))
        size, every_word = np.bincount(sentence[counted], minlength=len(owner)), np.bincount(sentence, minlength=len(owner))
        letters = np.bincount(sentence[counted], weights=words.letters[number[counted]], minlength=len(owner))
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        main, sure, every, segments = [], [], [], []
        for i, text in enumerate(texts):
            a, b = bounds[i], bounds[i + 1]
            if a == b:
                main.append(None), sure.append(None), every.append([]), segments.append([])
                continue
            lang, confidence, own, top = _judge(score[a:b], size[a:b], every_word[a:b], letters[a:b])
            found = sorted({top, *lang[own].tolist()})
            main.append(LANGUAGES[top])
            sure.append(float(np.average(np.where(lang == top, confidence, 0), weights=size[a:b] + 1e-9)))
            every.append([LANGUAGES[x] for x in found])
            cut = np.flatnonzero(np.diff(lang, append=-1))  # the last sentence of each stretch
            begin = np.concatenate([[0], cut[:-1] + 1])
            at = [int(ends[a + y]) for y in cut]
            segments.append(
                [
                    {"lang": LANGUAGES[lang[y]], "end": end, "confidence": float(confidence[x : y + 1].mean())}
                    for x, y, end in zip(begin, cut, at if text.isascii() else stored_places(text, clean(text), at))
                ]
            )
        yield pa.RecordBatch.from_arrays(
            [keys.cast(pa.int64()), batch.column(2), pa.array(main, pa.string()), pa.array(sure, pa.float64()), pa.array(every, pa.list_(pa.string())), pa.array(segments, _SEGMENT)],
            names=["doc_id", "label", "main", "confidence", "languages", "segments"],
        )


def identify(docs: DataFrame, fitted: np.ndarray | None = None) -> DataFrame:
    """The language of each document and of each stretch of it.

    Needs ``doc_id, text, lang``; other columns are left behind. Gives one row
    per row: ``doc_id, label`` (the code the label stands for, "" if missing),
    ``main`` and its ``confidence`` (share of the words, weighted by the
    posterior), ``languages`` with a whole sentence, and ``segments``: stretches
    of one language with their end place in the stored text, in code points,
    and confidence. A text that is null, empty or without words
    has a null ``main`` and empty lists. If no row has a usable label, nothing
    can be learnt and all sentences count as the first language.

    The classifier is fitted on ``training_rows``; pass ``fitted`` to reuse one.
    Its matrix of BUCKETS x 6 numbers is broadcast, a size the data doesn't change.
    """
    spark = docs.sparkSession
    if fitted is None:
        sample = training_rows(docs).collect()
        fitted = fit([r.text for r in sample], [r.code for r in sample])
    table = spark.sparkContext.broadcast(fitted)
    return spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), label_code(F.col("lang")).alias("label"))).mapInArrow(
        lambda batches: _identify(batches, table),
        "doc_id long, label string, main string, confidence double, languages array<string>,"
        " segments array<struct<lang: string, end: int, confidence: double>>",
    )


def mislabelled(docs: DataFrame, fitted: np.ndarray | None = None) -> DataFrame:
    """``doc_id, lang``: documents whose label is missing or wrong or whose text mixes languages.

    One row for each language with a whole sentence. Texts without words and
    null or empty ones have none; rows repeated in full count once.
    """
    found = identify(docs, fitted)
    wrong = (F.size("languages") > 1) | (F.col("label") != F.col("main"))
    return found.where(F.col("main").isNotNull() & wrong).select("doc_id", F.explode("languages").alias("lang")).distinct()
