"""Problem 5: spellings of one person or organisation.

Names are taken apart into a key (surname, or all words of the organisation's
name, in any order) and what else tells entities apart (given name, kind and
town of the organisation). Keys are tf-idf vectors of character n-grams; a
distributed sparse join gives each key its top n others by cosine, a check of
the letters follows, and names are grouped by average linkage on the cosines,
in which names that can't be the same are never joined.
"""

from __future__ import annotations

import functools
import heapq
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvizmill.session import cut

#: Least cosine at which a pair of keys, and least average similarity at which two groups of names are joined.
LINKAGE = 0.45
#: Longest n-grams (all shorter ones count too), and partners a key keeps in the join.
GRAM, TOP = 2, 20

#: Latin letters that look like Cyrillic ones.
LOOKALIKES = str.maketrans("aceopxykmtbhiABCEHKMOPTXY", "асеорхукмтвніАВСЕНКМОРТХУ")

#: English romanisation, longest first, back to Cyrillic.
FROM_LATIN = (
    ("shch", "щ"), ("yo", "е"), ("yu", "ю"), ("ya", "я"), ("ye", "е"), ("zh", "ж"), ("kh", "х"), ("ch", "ч"), ("sh", "ш"), ("ts", "ц"),
    ("a", "а"), ("b", "б"), ("c", "к"), ("d", "д"), ("e", "е"), ("f", "ф"), ("g", "г"), ("h", "х"), ("i", "и"), ("j", "и"),
    ("k", "к"), ("l", "л"), ("m", "м"), ("n", "н"), ("o", "о"), ("p", "п"), ("q", "к"), ("r", "р"), ("s", "с"), ("t", "т"), ("u", "у"),
    ("v", "в"), ("w", "в"), ("x", "кс"), ("y", "и"), ("z", "з"),
)

#: Given names with their short forms.
GIVEN_NAMES = {
    "Александр": "Саша Саня Шура Алекс", "Александра": "Саша Шура", "Алексей": "Лёша Алёша", "Алёна": "", "Алина": "", "Алла": "",
    "Анастасия": "Настя Ася", "Анатолий": "Толя", "Андрей": "Андрюша", "Анна": "Аня Анюта Нюра", "Антон": "Тоша", "Арсений": "Сеня", "Артём": "Тёма",
    "Богдан": "", "Борис": "Боря", "Вадим": "Вадик", "Валентин": "Валя", "Валентина": "Валя", "Валерий": "Валера", "Варвара": "Варя",
    "Василий": "Вася", "Вера": "", "Вероника": "Ника", "Виктор": "Витя", "Виктория": "Вика", "Виталий": "Виталик", "Владимир": "Вова Володя",
    "Владислав": "Влад Слава", "Вячеслав": "Слава", "Галина": "Галя", "Геннадий": "Гена", "Георгий": "Гоша Жора", "Глеб": "", "Григорий": "Гриша",
    "Даниил": "Даня Данила", "Дарья": "Даша", "Денис": "", "Дмитрий": "Дима Митя", "Евгений": "Женя", "Евгения": "Женя", "Егор": "",
    "Екатерина": "Катя", "Елена": "Лена", "Елизавета": "Лиза", "Ефим": "Фима", "Захар": "", "Зинаида": "Зина", "Зоя": "", "Иван": "Ваня",
    "Игорь": "", "Илья": "Илюша", "Инна": "", "Ирина": "Ира", "Кирилл": "", "Клавдия": "Клава", "Константин": "Костя", "Ксения": "Ксюша",
    "Лариса": "Лара", "Лев": "Лёва", "Леонид": "Лёня", "Лидия": "Лида", "Любовь": "Люба", "Людмила": "Люда Люся Мила", "Максим": "Макс",
    "Маргарита": "Рита", "Марина": "", "Мария": "Маша Маруся", "Матвей": "", "Михаил": "Миша", "Надежда": "Надя", "Наталья": "Наташа", "Никита": "",
    "Николай": "Коля", "Нина": "", "Оксана": "", "Олег": "", "Ольга": "Оля", "Павел": "Паша", "Пётр": "Петя", "Полина": "Поля", "Раиса": "Рая",
    "Роман": "Рома", "Светлана": "Света", "Семён": "Сеня Сёма", "Сергей": "Серёжа", "София": "Соня", "Станислав": "Стас Слава", "Степан": "Стёпа",
    "Тамара": "Тома", "Тарас": "", "Татьяна": "Таня", "Тимофей": "Тима Тимоша", "Тимур": "", "Фёдор": "Федя", "Эдуард": "Эдик", "Юлия": "Юля",
    "Юрий": "Юра", "Яков": "Яша", "Яна": "", "Ярослав": "Слава",
}

#: Kinds of organisation.
KINDS = ("клуб", "команда", "лига", "школа", "редакция", "группа", "студия", "кружок", "союз", "центр", "издательство", "общество", "сборная")

_PATRONYMIC = re.compile("(?:ович|евич|ичн?а?|овна|евна)$")
_FOLD = str.maketrans({"ё": "е", "э": "е", "й": "и", "ы": "и", "ь": None, "ъ": None, "і": "и", "ц": "тс", "щ": "шч"})


def fold(word: str) -> str:
    """A word in lower-case Cyrillic, without what spelling and romanisation leave open."""
    word = unicodedata.normalize("NFKC", word)
    if re.search("[Ѐ-ӿ]", word):
        word = word.translate(LOOKALIKES)
    word = word.lower()
    if re.search("[a-z]", word):
        for latin, cyrillic in FROM_LATIN:
            word = word.replace(latin, cyrillic)
    return word.translate(_FOLD)


def one_edit(a: str, b: str) -> bool:
    """Whether the words are equal or one letter was added, left out, changed or swapped with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :] or (a[k + 2 :] == b[k + 2 :] and a[k : k + 2] == b[k : k + 2][::-1])
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def edits(a: str, b: str) -> int:
    """How many letters must be added, left out, changed or swapped with their neighbours to make one word of the other."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
    return last[-1]


@functools.cache
def _given() -> dict[str, tuple[str, ...]]:
    names: dict[str, set[str]] = {}
    for full, short in GIVEN_NAMES.items():
        for n in [full, *short.split()]:
            names.setdefault(fold(n), set()).add(fold(full))
    return {k: tuple(sorted(v)) for k, v in names.items()}


@functools.cache
def _begin_with_e() -> frozenset[str]:
    """Folded given names whose first letter is Э, which folding makes Е."""
    return frozenset(fold(n) for n in GIVEN_NAMES if n[0] == "Э")


def _initial(word: str) -> str:
    """A folded initial; of the Cyrillic ones, Э and Е are kept apart as "э" and "е-"."""
    return {"Э": "э", "э": "э", "Е": "е-", "е": "е-"}.get(word) or fold(word)


def _begins(name: str, start: str) -> bool:
    if start == "э":
        return name in _begin_with_e()
    if start == "е-":
        return name[:1] == "е" and name not in _begin_with_e()
    return name.startswith(start)


@functools.lru_cache(100_000)
def given_name(word: str) -> tuple[str, ...]:
    """Full given names that a folded word may stand for, allowing one typo."""
    exact = _given().get(word)
    if exact or len(word) < 3:
        return exact or ()
    near = sorted({n for k, v in _given().items() if len(k) >= 4 and one_edit(word, k) for n in v})
    return tuple(near) if len(near) <= 2 else ()


def organisation(name: str) -> tuple[list[str], list[str]]:
    """The words of an organisation's name, in order of the alphabet, and its towns, as far as they are given.

    The name is what is quoted, else what comes after the kind and before a
    comma. Towns come after a comma or in brackets, with a capital letter.
    """
    plain = re.sub(r"\([^()]*\)", " ", name)
    quoted = re.search(r"[«\"“„]\s*([^«»\"“”„]+)[»\"“”]?(.*)", plain)
    if quoted:
        core, after = quoted[1], quoted[2]
    else:
        core, _, after = plain.partition(",")
        core, after = core.split(None, 1)[-1], "," + after
    named = [*re.findall(r",([^,]*)", after), *(t for b in re.findall(r"\(([^()]*)\)", name) for t in b.split(","))]
    towns = {fold(t) for x in named for t in [" ".join(re.findall(r"[\w-]+", x))] if t[:1].isupper()}
    return sorted({fold(w) for w in re.findall(r"[^\W_]+", core)} - {""}), sorted(towns)


def parse(name: str) -> tuple[str, str, str, list[str]]:
    """(kind of entity "o" or "p", key, how the rest is given, what it may be).

    For organisations the key is the first word of the name, of which
    ``organisation`` has the others, and the rest is its kind, whole or an
    initial. For people it
    is the given name: "full" with all names it may be, "abbr" with its first
    letters, "init" with one, or "none".
    """
    plain = re.sub(r"\([^()]*\)", " ", name)
    words = re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", plain)
    first = fold(words[0]) if words else ""
    quoted = re.search(r"[«\"“„]\s*([^«»\"“”„]+)", plain)
    kind = next((k for k in KINDS if one_edit(first, fold(k))), None) if len(first) > 3 else None
    if quoted and len(words) > 1 or kind and (len(words) > 1 or re.search(r"\d", plain)):
        core = quoted[1] if quoted else re.split(r",", plain)[0].split(None, 1)[-1]
        key = fold(re.findall(r"[^\W\d_]+", core)[0]) if re.search(r"[^\W\d_]", core) else first
        if kind:
            return "o", key, "full", [fold(kind)]
        return "o", key, "init" if len(first) == 1 else "abbr", [first]
    surname, comma, rest = plain.partition(",")
    found = re.findall(r"([^\W\d_]+(?:['’-][^\W\d_]+)*)\s?(\.?)", plain)
    tokens = [(_initial(w) if len(w) == 1 else fold(w), dot == ".") for w, dot in found]
    tokens = [(w, dot) for w, dot in tokens if w]
    single = {_initial(w) for w, _ in found if len(w) == 1}
    full = [w for w, dot in tokens if not dot and w not in single]
    short = [w for w, dot in tokens if dot or w in single]
    if not tokens:
        return "p", fold(name), "none", []
    if comma and rest.strip():
        own = [fold(w) for w in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", surname)]
        key = own[-1] if own else full[0] if full else tokens[0][0]
        full = [w for w in full if w != key]
    elif len(full) == 1:
        key, full = full[0], []
    elif len(full) > 1:
        at = next((i for i, w in enumerate(full) if w in _given()), None)
        if at is None:
            at = next((i for i, w in enumerate(full) if given_name(w)), None)
        if len(full) > 2:
            middle = next((i for i, w in enumerate(full) if i and _PATRONYMIC.search(w)), None)
            if at is None:
                at = middle - 1 if middle else 0
            key = full[0] if at == 1 else full[-1]
        else:
            # Of two words that may both be given names, the surname is the one further from the list.
            at = 0 if at is None else at
            key = full[1 - at]
        full = [full[at]]
    else:
        key = max((w for w, _ in tokens), key=len)
        short = [w for w in short if w != key]
    if full:
        return "p", key, "full", list(given_name(full[0])) or [full[0]]
    if short:
        return "p", key, "init" if short[0] in single else "abbr", [short[0]]
    return "p", key, "none", []


_PARSED = "name string, sort string, key string, how string, given array<string>, towns array<string>"


def _parse_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for n in f["name"]:
            sort, key, how, given = parse(n)
            words, towns = organisation(n) if sort == "o" else ([], [])
            rows.append((n, sort, " ".join(words) or key, how, given, towns))
        yield pd.DataFrame(rows, columns=["name", "sort", "key", "how", "given", "towns"])


def _compatible(a: tuple, b: tuple) -> float:
    """How well two given names (how, what) agree; 0 if they can't be the same."""
    if a[0] == "none" or b[0] == "none":
        return 0.6
    if a[0] == "full" and b[0] == "full":
        if set(a[1]) & set(b[1]):
            return 1.0
        unlisted = len(a[1]) == len(b[1]) == 1 and min(len(a[1][0]), len(b[1][0])) > 3
        return 0.95 if unlisted and one_edit(a[1][0], b[1][0]) else 0.0
    if a[0] == "full":
        a, b = b, a
    if b[0] == "full":
        return 0.9 if any(_begins(n, a[1][0]) for n in b[1]) else 0.0
    one, other = a[1][0], b[1][0]
    if {one, other} == {"э", "е-"}:
        return 0.0
    one, other = (w.rstrip("-").replace("э", "е") for w in (one, other))
    return 0.9 if one.startswith(other) or other.startswith(one) else 0.0


def _same_town(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    return not a or not b or any(x == y or min(len(x), len(y)) > 3 and one_edit(x, y) for x in a for y in b)


@functools.lru_cache(100_000)
def _letters(a: str, b: str) -> int:
    """Whether two keys may be spellings of one by their letters: 1 yes, 0 not by themselves, -1 never in one group.

    Words of six letters or more may be two edits apart, shorter ones one, those
    of up to three none; numbers may not differ. Of several words, each of the
    shorter key must have its own in the other; words in common beside
    different ones make two names.
    """
    if a == b:
        return 1
    if " " in a or " " in b:
        one, other = sorted((a.split(" "), b.split(" ")), key=len)
        left, met = list(other), 0
        for w in sorted(one, key=len, reverse=True):
            match = min((v for v in left if _letters(*sorted((w, v))) > 0), key=lambda v: (v != w, edits(w, v), v), default=None)
            if match is not None:
                met += 1
                left.remove(match)
        return 1 if met == len(one) else -1 if met else 0
    if any(c.isdigit() for c in a + b):
        return -1
    short = min(len(a), len(b))
    return int(short > 3 and (one_edit(a, b) or short > 5 and edits(a, b) <= 2))


class _Group:
    """A group of names: number and sum of key vectors, for each way the rest is given and each number of words."""

    def __init__(self, fact: tuple, key: str, vector: dict[str, float]):
        words = key.count(" ")
        self.sort, self.words, self.keys = fact[0], words, {key}
        self.sums = {(fact, words): (1, dict(vector))}

    def add(self, other: _Group) -> None:
        self.words = max(self.words, other.words)
        self.keys |= other.keys
        for part, (n, vector) in other.sums.items():
            before, mine = self.sums.get(part, (0, {}))
            for g, w in vector.items():
                mine[g] = mine.get(g, 0.0) + w
            self.sums[part] = before + n, mine


def _average(a: _Group, b: _Group) -> float:
    """Average similarity of the names of two groups, cosine times agreement of the rest; 0 if two of them can't be the same.

    The sum of all cosines between two groups is the product of their sums.
    Names of organisations that leave words out have no part in the average of
    a group that has fuller ones.
    """
    if a.sort == "o" and any(_letters(*sorted((x, y))) < 0 for x in a.keys for y in b.keys):
        return 0.0
    total, pairs = 0.0, 0
    for (f, words), (n, x) in a.sums.items():
        for (g, others), (m, y) in b.sums.items():
            agree = _agreement(f, g)
            if not agree:
                return 0.0
            if words == a.words and others == b.words:
                small, large = (x, y) if len(x) < len(y) else (y, x)
                total += agree * sum(w * large[k] for k, w in small.items() if k in large)
                pairs += n * m
    return total / pairs


@functools.lru_cache(200_000)
def _agreement(a: tuple, b: tuple) -> float:
    """How well the rests (sort, how, given, towns) of two names agree; 0 if they can't be the same."""
    if a[0] != b[0] or not _same_town(a[3], b[3]):
        return 0.0
    return _compatible(a[1:3], b[1:3])


def _cluster(names: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """Average-linkage clusters of the names of one component of similar keys.

    Names that say the same (key and rest) start as one item. Only groups with
    a pair in ``pairs`` or a key in common are tried; the average is of all
    their names. An entry of the queue is computed again when it comes up after
    one of its groups has grown: as an average of averages it can't have become
    more than the entries it comes from, so the largest is always met first.
    """
    names = names.sort_values(["uses", "name"], ascending=[False, True])
    spelt: dict[tuple, list[str]] = {}
    vectors: dict[str, dict[str, float]] = {}
    for name, sort, key, how, given, towns, entries in names[["name", "sort", "key", "how", "given", "towns", "entries"]].itertuples(index=False):
        spelt.setdefault((key, (sort, how, tuple(given), tuple(towns))), []).append(name)
        if key not in vectors:
            vectors[key] = {} if entries is None else {e["gram"]: e["w"] for e in entries}
    items = list(spelt)
    groups = {i: _Group(fact, key, vectors[key]) for i, (key, fact) in enumerate(items)}
    of_key: dict[str, list[int]] = {}
    for i, (key, _) in enumerate(items):
        of_key.setdefault(key, []).append(i)
    edges: dict[tuple[int, int], float] = {}
    for key, mine in of_key.items():
        for k, i in enumerate(mine):
            for j in mine[:k]:
                agree = _agreement(items[i][1], items[j][1])
                if agree >= LINKAGE:
                    edges[j, i] = agree
    for a, b, cosine in pairs[["a", "b", "cosine"]].itertuples(index=False):
        for i in of_key.get(a, ()):
            for j in of_key.get(b, ()):
                s = cosine * _agreement(items[i][1], items[j][1])
                if s >= LINKAGE:
                    edges[min(i, j), max(i, j)] = s
    edges = _without_unclear(items, edges)
    root = list(range(len(items)))
    grown = [0] * len(items)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    queue = [(-round(s, 9), i, j, 0, 0) for (i, j), s in edges.items()]
    heapq.heapify(queue)
    tried = set()
    while queue:
        s, i, j, of_i, of_j = heapq.heappop(queue)
        i, j = sorted((top(i), top(j)))
        if i == j:
            continue
        if (of_i, of_j) != (grown[i], grown[j]):
            now = (i, j, grown[i], grown[j])
            if now not in tried:
                tried.add(now)
                s = _average(groups[i], groups[j])
                if s >= LINKAGE:
                    heapq.heappush(queue, (-round(s, 9), *now))
            continue
        groups[i].add(groups.pop(j))
        root[j] = i
        grown[i] += 1
    found: dict[int, list[int]] = {}
    for i in range(len(items)):
        found.setdefault(top(i), []).append(i)
    out = [(min(spelt[items[m[0]]]), name) for m in found.values() for k in m for name in spelt[items[k]]]
    return pd.DataFrame(out, columns=["entity", "name"])


def _without_unclear(items: list[tuple], edges: dict[tuple[int, int], float]) -> dict[tuple[int, int], float]:
    """Edges but those of organisations that say less (fewer words, no town) and fit two that can't be the same: they stand for neither."""
    says = [(len(key.split(" ")), bool(fact[3])) for key, fact in items]
    fuller: dict[int, list[int]] = {}
    for pair in edges:
        for i, j in (pair, pair[::-1]):
            if items[i][1][0] == "o" and says[j] != says[i] and all(x >= y for x, y in zip(says[j], says[i])):
                fuller.setdefault(i, []).append(j)

    def differ(j: int, k: int) -> bool:
        return not _agreement(items[j][1], items[k][1]) or _letters(*sorted((items[j][0], items[k][0]))) < 1

    unclear = {i for i, others in fuller.items() if any(differ(j, k) for n, j in enumerate(others) for k in others[:n])}
    return {(i, j): s for (i, j), s in edges.items() if not (i in unclear and j in fuller[i] or j in unclear and i in fuller[j])}


def key_vectors(keys: DataFrame) -> DataFrame:
    """``key, entries``: the n-grams of each different ``key`` of up to GRAM letters, rarest first, with tf-idf weights of norm 1."""
    of_word = lambda w: F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(GRAM)),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) + 3 - n)), lambda i: F.concat(n.cast("string"), F.substring(F.concat(F.lit("^"), w, F.lit("$")), i, n))
            ),
        )
    )
    once = keys.select("key").distinct()
    grams = F.array_except(F.array_distinct(F.flatten(F.transform(F.split("key", " "), of_word))), F.array(F.lit("1^"), F.lit("1$")))
    each = once.select("key", F.explode(grams).alias("gram"))
    df = each.groupBy("gram").agg(F.count("*").alias("df"))
    # Spark takes the exploded n-grams for no larger than the keys and would collect all of them on the driver to broadcast them.
    weighed = each.join(df.hint("merge"), "gram").withColumn("w", F.log1p(F.lit(float(once.count())) / F.col("df")))
    entry = F.struct((-F.col("w")).alias("rare"), "gram", "w")
    return (
        weighed.groupBy("key")
        .agg(F.sort_array(F.collect_list(entry)).alias("entries"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        .select("key", F.transform("entries", lambda e: F.struct(e["gram"].alias("gram"), (e["w"] / F.col("norm")).alias("w"))).alias("entries"))
    )


def similar_keys(vectors: DataFrame, top: int | None = TOP) -> DataFrame:
    """``a, b, cosine``: pairs a < b of different keys of ``key_vectors`` that are at least LINKAGE similar.

    Prefix filter: of each vector the rarest n-grams are indexed, as far as the
    rest of it can't reach the threshold alone. A pair above the threshold
    shares one of these, so no link is lost, and n-grams that many keys share
    are hardly ever indexed.

    Each key keeps its ``top`` best partners, and a pair stays if either of its
    keys keeps it; None keeps all. A key whose partners are cut has ``top``
    closer ones, through which linkage reaches the rest.
    """
    # Squared norm of what comes after each entry.
    rest = F.transform(
        F.sequence(F.lit(1), F.size("entries")),
        lambda i: F.aggregate(F.slice("entries", i, F.size("entries")), F.lit(0.0), lambda s, e: s + e["w"] * e["w"]),
    )
    indexed = vectors.withColumn("rest", rest).select(
        "key", "entries", F.explode(F.filter("entries", lambda e, i: F.col("rest")[i] >= F.lit(LINKAGE * LINKAGE))).alias("e")
    ).select("key", "entries", F.col("e.gram").alias("gram"))
    left = indexed.select("gram", F.col("key").alias("a"), F.col("entries").alias("x"))
    right = indexed.select("gram", F.col("key").alias("b"), F.col("entries").alias("y"))
    dot = F.aggregate(
        F.col("x"),
        F.lit(0.0),
        lambda s, e: s + e["w"] * F.coalesce(F.try_element_at(F.map_from_entries("y"), e["gram"]), F.lit(0.0)),
    )
    pairs = (
        left.join(right, "gram")
        .where(F.col("a") < F.col("b"))
        .dropDuplicates(["a", "b"])
        .select("a", "b", dot.alias("cosine"))
        .where(F.col("cosine") >= LINKAGE)
    )
    if top is None:
        return pairs
    pairs = cut(pairs)
    sides = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.col("cosine").desc(), "b"))
    best = sides.withColumn("place", place).where(F.col("place") <= top)
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine").distinct()


def _linkable(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose letters allow what their cosine says."""
    for f in frames:
        yield f[[_letters(a, b) > 0 for a, b in zip(f["a"], f["b"])]]


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``key, group``: the smallest key that can be reached over ``links`` (a, b), by rounds of least labels."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = cut(nodes.select("key", F.col("key").alias("group")))
    while True:
        near = both.join(state, both["b"] == state["key"]).groupBy("a").agg(F.min("group").alias("near"))
        moved = state.join(near, state["key"] == near["a"], "left").select(
            "key", F.least("group", F.coalesce("near", "group")).alias("group"), F.col("group").alias("was")
        )
        # The label of the label: long chains take a logarithmic number of rounds.
        jump = moved.select(F.col("key").alias("via"), F.col("group").alias("far"))
        moved = cut(moved.join(jump, moved["group"] == jump["via"], "left").select("key", F.least("group", F.coalesce("far", "group")).alias("group"), "was"))
        state = moved.select("key", "group")
        if moved.where(F.col("group") != F.col("was")).limit(1).count() == 0:
            return state


def link_names(names: DataFrame, top: int | None = TOP) -> DataFrame:
    """``entity, name``: each different name with the smallest of the most used spelling of its entity.

    ``names`` has one row per use of a ``name``; other columns are left behind.
    Null names are left out; names without letters stand for themselves. The
    names of one task are the spellings of people whose surnames are alike: they
    grow with the ways to write a surname, not with the rows, as repeated names
    were counted before, and are linked in time of their pairs, of which a key
    has about ``top``.
    """
    uses = cut(names.where(F.col("name").isNotNull()).groupBy("name").agg(F.count("*").alias("uses")))
    parsed = cut(uses.select("name").mapInPandas(_parse_all, _PARSED).join(uses, "name"))
    vectors = cut(key_vectors(parsed))
    # Two groups are joined only if some pair of their names reaches LINKAGE, as an average is no more
    # than its largest term; so components of such pairs hold all that linkage would join.
    near = cut(similar_keys(vectors, top).mapInPandas(_linkable, "a string, b string, cosine double"))
    group = components(parsed.select("key").distinct(), near)
    grouped = parsed.join(group, "key").join(vectors, "key", "left").groupBy("group")
    pairs = near.join(group, near["a"] == group["key"]).select("group", "a", "b", "cosine").groupBy("group")
    return grouped.cogroup(pairs).applyInPandas(_cluster, "entity string, name string")


def linked_pairs(names: DataFrame) -> DataFrame:
    """``name_a, name_b``: pairs of different names, in code point order, of one entity."""
    linked = cut(link_names(names))
    return (
        linked.select("entity", F.col("name").alias("name_a"))
        .join(linked.select("entity", F.col("name").alias("name_b")), "entity")
        .where(F.col("name_a") < F.col("name_b"))
        .select("name_a", "name_b")
    )
