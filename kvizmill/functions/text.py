"""Text functions as column expressions; patterns are Unicode-aware."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def contains_ascii_folded(text: Column, needle: str) -> Column:
    """Literal substring test; A-Z fold, other letters keep their case."""
    fold = lambda c: F.translate(c, _UPPER, _LOWER)
    return F.contains(fold(text), fold(F.lit(needle)))


def any_contained(text: Column, needles: list[str]) -> Column:
    """Whether one of the needles is in the text; false for no needles and null texts."""
    return F.coalesce(reduce(or_, [contains_ascii_folded(text, n) for n in needles], F.lit(False)), F.lit(False))


def mentions(topic: str, *texts: Column) -> Column:
    """Whether a word that starts like the topic is in one of the texts, in any case."""
    quoted = "".join(f"\\{c}" if not c.isalnum() else c for c in topic)
    return F.regexp_like(F.concat_ws(" ", *texts), F.lit(rf"(?iU)(?<!\w){quoted}"))


def listed_or_split(field: Column) -> Column:
    """Names of a JSON list of objects; text that is no JSON list is split at commas.

    A list without names has none; a JSON value of another kind is split as text.
    """
    objects = F.from_json(field, "array<struct<name: string>>", {"mode": "PERMISSIVE"})
    strings = F.from_json(field, "array<string>")
    split = F.filter(F.transform(F.split(field, ","), lambda p: F.trim(p)), lambda p: p != "")
    named = F.filter(F.transform(objects, lambda o: o["name"]), lambda n: n.isNotNull())
    listed = F.startswith(F.ltrim(field), F.lit("["))
    return F.coalesce(
        F.when(listed & strings.isNotNull(), F.coalesce(named, F.array().cast("array<string>"))), split, F.array().cast("array<string>")
    )


def clean_answer(text: Column) -> Column:
    """Square brackets, stress marks, quotes and full stops at the end removed; no-break spaces are spaces."""
    plain = F.regexp_replace(text, r"\[([^\]]*)\]", "$1")
    plain = F.translate(F.replace(plain, F.lit(" "), F.lit(" ")), "́«»\"„“”", "")
    return F.trim(F.rtrim(F.trim(plain), F.lit(".")))


def split_answer(text: Column) -> Column:
    """Answers of a numbered list, or of a few short sentences, else the text as one."""
    tidy = lambda p: F.trim(F.rtrim(F.trim(p), F.lit(".")))
    numbered = F.filter(F.transform(F.split(text, r"\d+\)\s*"), tidy), lambda p: p != "")
    dotted = F.filter(F.transform(F.split(text, r"\. "), lambda p: F.trim(p)), lambda p: p != "")
    short = (F.size(dotted) > 1) & F.forall(dotted, lambda p: F.length(p) < 50) & ~F.regexp_like(text, F.lit(r"^\d"))
    return F.when(F.size(numbered) > 1, numbered).when(short, dotted).otherwise(F.array(text))


def text_key(text: Column) -> Column:
    """Lower case, single spaces, ё as е."""
    return F.translate(F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " "))), "ё", "е")


def token_key(text: Column) -> Column:
    """The Latin, Cyrillic and digit tokens of the key, or the key where there are none."""
    key = text_key(text)
    tokens = F.regexp_extract_all(key, F.lit("([а-яa-z0-9]+)"), F.lit(1))
    return F.when(F.size(tokens) > 0, F.array_join(tokens, " ")).otherwise(key)


def is_numeric_like(text: Column) -> Column:
    """Numbers, dates, decimal fractions and pi."""
    t = F.lower(F.trim(text))
    return t.isin("π", "пи", "pi") | F.regexp_like(t, F.lit(r"^(\d{1,4}([./:-]\d{1,4})*|\d+[,.]\d+)$"))


#: Answers that say nothing.
EMPTY_ANSWERS = (
    "да", "нет", "не", "ничего", "никто", "всё", "все", "что", "кто", "он", "она", "они", "мы", "это", "то",
    "икс", "x", "игрек", "y", "зет", "z", "альфа", "бета", "гамма", "дельта",
)

#: Parts of the names of organisations.
ORGANISATION_WORDS = (
    "компания", "корпорация", "фирма", "бренд", "банк", "университет", "институт", "академия", "газета", "журнал", "издательство", "партия",
    "клуб", "команда", "википедия", "wikipedia", "google", "apple", "ikea", "lego", "starbucks", "microsoft", "openai", "nasa",
    "ооо", "оао", "зао", "llc", "inc", "corp", "ltd", "gmbh",
)

#: Words that taggers take for organisations.
NO_ORGANISATIONS = (
    "ее", "её", "она", "его", "им", "их", "альфа", "оно", "первый", "это", "они", "нем", "ней", "них", "ним", "ними", "этого",
    "этим", "икса", "ему", "иксом", "он", "альф", "этом", "ею", "там", "иксов", "вторым", "второй", "альфу", "иксы", "альфе",
    "ими", "иксе", "первым", "первая", "бета", "альфой", "таким", "нее", "неё", "сми",
)

#: Endings of Russian words that light_lemma takes off, after at least three letters.
ENDING = (
    "^(.{3,}?)(?:иями|ями|ами|ого|его|ому|ему|ыми|ими|ая|яя|ое|ее|ые|ие|ый|ий|ой|ей|ую|юю|ых|их|ым|им|ом|ем|ям|ам|ах|ях|ов|ев|ию|ия|ии|а|я|о|е|ы|и|у|ю|ь)$"
)


def low_info_reason(key: Column) -> Column:
    """Why an answer key says too little, or null."""
    tokens = F.regexp_extract_all(key, F.lit("([а-яёa-z0-9]+)"), F.lit(1))
    return (
        F.when(F.coalesce(key, F.lit("")) == "", "empty")
        .when(F.regexp_like(key, F.lit(r"(?U)^[\W_]+$")), "punctuation_only")
        .when(key.isin(*EMPTY_ANSWERS), "stop_answer")
        .when(is_numeric_like(key), None)
        .when(F.size(tokens) == 0, "no_tokens")
        .when((F.size(tokens) == 1) & (F.length(tokens[0]) <= 1), "too_short_single_token")
        .when((F.size(tokens) == 1) & tokens[0].isin(*EMPTY_ANSWERS), "stop_single_token")
    )


def tokens(text: Column) -> Column:
    """Latin, Cyrillic and digit tokens in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([а-яёa-z0-9]+)"), F.lit(1))


def has_capital(text: Column) -> Column:
    """Whether a part between spaces or hyphens begins with a capital letter."""
    return F.regexp_like(F.trim(text), F.lit(r"(?:^|[\s-])\p{Lu}"))


def is_organisation_like(text: Column, stop_words: tuple[str, ...]) -> Column:
    """Whether a name looks like an organisation: a word of such names, a short abbreviation, or Latin letters with a capital."""
    t = F.trim(text)
    low = F.lower(t)
    known = reduce(or_, [F.contains(low, F.lit(w)) for w in ORGANISATION_WORDS])
    short = F.regexp_like(t, F.lit("^[A-ZА-ЯЁ0-9]{2,8}$"))
    latin = F.regexp_like(t, F.lit("[A-Za-z]")) & F.regexp_like(t, F.lit(r"\p{Lu}"))
    return (t != "") & ~low.isin(*NO_ORGANISATIONS) & (known | F.when(short, ~low.isin(*stop_words)).otherwise(latin))


def light_lemma(word: Column) -> Column:
    """A word without its inflexional ending: what stands in for a lemma where no dictionary is at hand."""
    return F.regexp_replace(word, ENDING, "$1")


def view_count(text: Column) -> Column:
    """``1.2K``, ``5M``, ``3B`` and plain numbers as a count; 0 for anything else."""
    t = F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s ]", ""))
    number = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)([KMB]?)$", 1).try_cast("double")
    unit = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)([KMB]?)$", 2)
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return F.coalesce(F.round(number * factor).cast("long"), F.lit(0))


def view_label(n: Column) -> Column:
    """A count as ``1.2M``, ``3.4K`` or digits."""
    return (
        F.when(n >= 1_000_000, F.format_string("%.1fM", F.floor(n / 100_000) / 10.0))
        .when(n >= 1_000, F.format_string("%.1fK", F.floor(n / 100) / 10.0))
        .otherwise(n.cast("string"))
    )


def clock(seconds: Column) -> Column:
    """Seconds as ``m:ss``."""
    s = F.floor(seconds).cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def video_id(url: Column) -> Column:
    """The eleven characters of a video in the usual kinds of link, else null."""
    pattern = r"(?:v=|youtu\.be/|/embed/|/shorts/)([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])"
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))


def slug(text: Column) -> Column:
    """Lower-case words joined by hyphens, at most 80 characters, ``topic`` if nothing is left."""
    words = F.regexp_replace(F.lower(F.trim(text)), r"(?U)[^\w\s-]", "")
    joined = F.regexp_replace(F.regexp_replace(words, r"(?U)[\s_-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(joined, 1, 80), F.lit("")), F.lit("topic"))


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The Russian form that goes with a number."""
    tens, units = n % 100, n % 10
    return F.when(tens.between(11, 14), many).when(units == 1, one).when(units.between(2, 4), few).otherwise(many)


def shuffle_key(key: Column, seed: int) -> Column:
    """Multiplicative hash of an id: the same random order on every page and every cluster."""
    m = 2147483647
    return F.pmod(F.pmod(key, F.lit(m)) * F.lit(2654435761 % m) + F.lit(seed), F.lit(m))


def answer_masks(text: Column) -> Column:
    """The 0/1 strings that follow the word ``mask`` in a page."""
    return F.regexp_extract_all(text, F.lit("mask[^01]{1,20}([01]{10,})"), F.lit(1))


def first_sentences(text: Column, n: int) -> Column:
    """The first n sentences without stress marks and brackets; 300 characters where that is too little."""
    plain = F.regexp_replace(F.replace(text, F.lit("́"), F.lit("")), r"\s*\([^()]{0,200}\)", "")
    parts = F.split(plain, r"(?<=(?<!\p{Lu})\.)\s+(?=\p{Lu})")
    joined = F.array_join(F.slice(parts, 1, n), " ")
    return F.when(F.length(joined) < 10, F.substring(plain, 1, 300)).otherwise(joined)
