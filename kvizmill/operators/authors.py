"""Author fields as people typed them: one row per name.

Everything here is built from Spark's own functions, so that fields of any
length are split inside the JVM without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A placeholder is OPEN, the span's index, CLOSE. An OPEN that is in the text already becomes OPEN + OWN, and
# a comma that joins the parts of one name becomes OPEN + COMMA, so that no text can look like a placeholder.
_OPEN, _CLOSE, _OWN, _COMMA = "", "", "", ""

#: Spans whose delimiters don't count: quoted (with doubled or escaped quotes), guillemets, brackets.
_SPAN = r'"(?:[^"\\]|\\.|"")*"|«[^«»]*»|“[^“”]*”|„[^„“”]*[“”]|\([^()]*\)'
_DELIMITER = r"[,;|/&\t\r\n]+|\s+(?:и|and)\s+|(?:^|\s+)\d{1,3}[.)](?=\s|\p{L})"
_AFTER = r"(?=\s*(?:$|[,;|/&\t\r\n]|\s(?:и|and)\s|\s\d{1,3}[.)]))"
_BEFORE = r"((?:^|[,;|/&\t\r\n]|\s(?:и|and)\s|(?:^|\s)\d{1,3}[.)])\s*)"
_SURNAME = r"(\p{Lu}[\p{L}'’-]+)"
_INITIALS = r"(\p{Lu}\p{Ll}?\.(?:[\s-]*\p{Lu}\p{Ll}?\.)*)"
_GIVEN = r"(\p{Lu}[\p{L}-]+)"
_ORGANISATION = rf"(\p{{L}}[\p{{L}}.]*\s*{_OPEN}\d+{_CLOSE})"
_TOWN = r"(\p{Lu}[\p{L}-]+(?<!ск[аи][яй])|\p{Lu}\p{L}*(?:яя|[нврл](?:ая|ое|ее|ый|ые|ие)|[жх]ний|(?<!с)кий)\s\p{Lu}[\p{L}-]+)"


def _plain_names(field: Column) -> Column:
    """Names of a field that isn't a JSON list."""
    own = F.replace(field, F.lit(_OPEN), F.lit(_OPEN + _OWN))
    spans = F.regexp_extract_all(own, F.lit(f"({_SPAN})"), F.lit(1))
    between = F.split(own, _SPAN, -1)

    def mark(i: Column) -> Column:  # brackets are told from quotes, as a comma after them means something else
        bracket = F.when(F.startswith(F.get(spans, i), F.lit("(")), F.lit("b")).otherwise("")
        return F.concat(F.lit(_OPEN), i.cast("string"), bracket, F.lit(_CLOSE))

    masked = F.array_join(
        F.transform(
            between,
            lambda part, i: F.concat(part, F.when(i < F.size(spans), mark(i)).otherwise("")),
        ),
        "",
    )
    # "Surname, initials", "Surname, Given" and "Organisation, Town" are one name. Two single words are only taken
    # for surname and given name where the comma isn't what delimits the list.
    joined = F.regexp_replace(masked, f"{_BEFORE}{_SURNAME},(\\s*){_INITIALS}{_AFTER}", f"$1$2{_OPEN}{_COMMA}$3$4")
    joined = F.regexp_replace(joined, f"{_ORGANISATION},(\\s*){_TOWN}{_AFTER}", f"$1{_OPEN}{_COMMA}$2$3")
    other = F.regexp_like(joined, F.lit(r"[;|/&\t\r\n]|\s(?:и|and)\s|^\s*\d{1,3}[.)]"))
    commas = F.length(joined) - F.length(F.replace(joined, F.lit(","), F.lit("")))
    joined = F.when(
        other | (commas == 1), F.regexp_replace(joined, f"{_BEFORE}{_SURNAME},(\\s*){_GIVEN}{_AFTER}", f"$1$2{_OPEN}{_COMMA}$3$4")
    ).otherwise(joined)
    pieces = F.transform(F.split(joined, _DELIMITER, -1), lambda p: F.trim(p))

    def restore(piece: Column) -> Column:
        indexes = F.regexp_extract_all(piece, F.lit(f"{_OPEN}(\\d+)b?{_CLOSE}"), F.lit(1))
        full = F.aggregate(
            indexes,
            piece,
            lambda text, i: F.replace(text, mark(i.cast("int")), F.get(spans, i.cast("int"))),
        )
        full = F.replace(full, F.lit(_OPEN + _COMMA), F.lit(","))
        alone = F.regexp_like(piece, F.lit(f"^{_OPEN}\\d+{_CLOSE}$"))
        inner = F.substring(full, F.lit(2), F.length(full) - 2)
        quoted = F.when(F.startswith(full, F.lit('"')), F.regexp_replace(F.replace(inner, F.lit('""'), F.lit('"')), r'\\(["\\/])', "$1")).otherwise(inner)
        return F.replace(F.when(alone & ~F.startswith(full, F.lit("(")), quoted).otherwise(full), F.lit(_OPEN + _OWN), F.lit(_OPEN))

    return F.transform(pieces, restore)


def _listed_names(field: Column) -> Column:
    """Names of a JSON list of objects or strings, also of one that is cut off.

    The strings of the list are taken first; one that has delimiters is split like a field of its own.
    """
    text = r'"((?:[^"\\]|\\.)*)(?:"|$)'
    keyed = F.regexp_extract_all(field, F.lit(r'"name"\s*:\s*' + text), F.lit(1))
    strings = F.regexp_extract_all(field, F.lit(text), F.lit(1))
    objects = F.regexp_like(field, F.lit(r"^\s*\[?\s*\{"))
    listed = F.transform(
        F.when(objects, keyed).otherwise(strings),
        lambda s: F.coalesce(F.get(F.from_json(F.concat(F.lit('["'), s, F.lit('"]')), "array<string>"), F.lit(0)), s),
    )
    return F.flatten(F.transform(listed, lambda s: F.when(F.regexp_like(s, F.lit(_DELIMITER)), _plain_names(s)).otherwise(F.array(s))))


def author_names(field: Column) -> Column:
    """Array of the names in an author field, in order, without empty places.

    A name is as written, trimmed, each run of white space one space, without
    list syntax, keys, ids, numbering, enclosing quotes and their escapes. Null,
    empty and letterless fields have an empty array.
    """
    spaced = F.regexp_replace(F.coalesce(field.cast("string"), F.lit("")), "[   -   　]", " ")
    listed = F.regexp_like(spaced, F.lit(r'^\s*(?:\[\s*[\{"\]]|\{\s*")'))
    names = F.when(listed, _listed_names(spaced)).otherwise(_plain_names(spaced))
    tidy = F.transform(names, lambda n: F.trim(F.regexp_replace(n, "[\\s   -   　]+", " ")))
    return F.filter(tidy, lambda n: F.regexp_like(n, F.lit(r"\p{L}")))


def explode_authors(records: DataFrame, tbl: str, id_column: str = "id", field: str = "authors") -> DataFrame:
    """``tbl, record_id, pos, name``: one row per name of each record.

    ``pos`` counts from 1. Records repeated in full count once; two records of
    one id with different fields both count. A null id stays null. Other
    columns of ``records`` are left behind.
    """
    each = records.select(F.col(id_column).cast("long").alias("record_id"), F.col(field).alias("_field"))
    # One shuffle by id: a record's fields are told apart as they are, then by their names, and stay with their id.
    # Records without an id stay apart by their fields.
    own = F.when(F.col("record_id").isNull(), F.xxhash64("_field"))
    lists = each.groupBy("record_id", own.alias("_own")).agg(F.collect_set("_field").alias("_fields"))
    rows = F.array_distinct(
        F.flatten(F.transform("_fields", lambda f: F.transform(author_names(f), lambda n, i: F.struct((i + 1).alias("pos"), n.alias("name")))))
    )
    return lists.select(F.lit(tbl).alias("tbl"), "record_id", F.inline(rows))


def pooled_authors(packs: DataFrame, questions: DataFrame) -> DataFrame:
    """``explode_authors`` of both tables."""
    return explode_authors(packs, "packs").unionByName(explode_authors(questions, "questions"))
