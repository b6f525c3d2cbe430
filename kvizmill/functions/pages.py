"""Facts from pages. HTML has no grammar Spark could express, so pages go through Arrow batches in Python's own parser."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvizmill.functions.dates import written_date

_SILENT = {"script", "style", "nav", "header", "footer", "noscript"}
_BLOCKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "section", "article", "tr", "table"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.silent = [], 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in _SILENT
        if tag in _BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self.silent -= tag in _SILENT and self.silent > 0
        if tag in _BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)


def html_text(html: str | None) -> str | None:
    """Text of a page without scripts, styles and frames around it; at most one empty line in a row. Null stays null."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines = re.sub(r"[ \t\r\f]+", " ", "".join(parser.parts))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", lines)).strip()


class _Labels(HTMLParser):
    """Label and value of definition lists and two-cell rows."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pairs, self.label, self.open, self.buffer = {}, None, None, []

    def handle_starttag(self, tag, attrs):
        if tag in ("dt", "th", "dd", "td"):
            self.finish()
            self.open = "label" if tag in ("dt", "th") or (tag == "td" and self.label is None) else "value"

    def handle_endtag(self, tag):
        if tag in ("dt", "th", "dd", "td"):
            self.finish()
        if tag == "tr":
            self.label = None

    def handle_data(self, data):
        if self.open:
            self.buffer.append(data)

    def finish(self):
        if self.open:
            text = " ".join("".join(self.buffer).split())
            if self.open == "label":
                self.label = text.rstrip(":")
            elif self.label is not None:
                self.pairs.setdefault(self.label, text)
                self.label = None
        self.open, self.buffer = None, []


def labelled_values(html: str | None) -> dict[str, str]:
    parser = _Labels()
    parser.feed(html or "")
    parser.close()
    parser.finish()
    return parser.pairs


def balanced(text: str, start: int) -> str | None:
    """The JSON value that begins with the bracket at ``start``; brackets inside strings don't count."""
    closing = {"[": "]", "{": "}"}.get(text[start : start + 1])
    if closing is None:
        return None
    stack, quoted, at = [], False, start
    while at < len(text):
        c = text[at]
        if quoted:
            if c == "\\":
                at += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "[{":
            stack.append("]" if c == "[" else "}")
        elif c in "]}":
            if not stack or stack.pop() != c:
                return None
            if not stack:
                return text[start : at + 1]
        at += 1
    return None


def embedded_arrays(html: str | None, key: str) -> list:
    """Items of all JSON arrays named ``key`` in a page, also in strings that scripts push."""
    html = html or ""
    pushed = re.findall(r'push\(\[\s*\d+\s*,\s*("(?:[^"\\]|\\.)*")\s*\]\)', html)
    sources = [html]
    for p in pushed:
        try:
            sources.append(json.loads(p))
        except ValueError:
            continue
    items = []
    for source in sources:
        for m in re.finditer(rf'"{re.escape(key)}"\s*:\s*(?=\[)', source):
            found = balanced(source, m.end())
            try:
                items += json.loads(found) if found else []
            except ValueError:
                continue
    return items


def _apply(f):
    def run(s: pd.Series) -> pd.Series:
        return s.map(f)

    return run


def text_of(html: Column) -> Column:
    return F.pandas_udf(_apply(html_text), "string")(html)


def values_of(html: Column) -> Column:
    return F.pandas_udf(_apply(labelled_values), "map<string, string>")(html)


def embedded_questions(pages: DataFrame) -> DataFrame:
    """``page_id, pos, id, number, text, answer, authors``: the questions embedded as JSON in ``pages`` (page_id, html)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for page, html in zip(f["page_id"], f["html"]):
                for pos, q in enumerate(q for q in embedded_arrays(html, "questions") if isinstance(q, dict)):
                    authors = q.get("authors")
                    rows.append((page, pos, q.get("id"), q.get("number"), q.get("text") or None, q.get("answer") or None, json.dumps(authors, ensure_ascii=False) if authors else None))
            yield pd.DataFrame(rows, columns=["page_id", "pos", "id", "number", "text", "answer", "authors"]).astype({"id": "Int64", "number": "Int64"})

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, pos long, id long, number long, text string, answer string, authors string")


def _pushed(html: Column, field: str) -> Column:
    """The first value of a JSON string field, plain or inside a string that a script pushes; null for none."""
    plain = F.replace(html, F.lit('\\"'), F.lit('"'))
    return F.nullif(F.regexp_extract(plain, f'"{field}"\\s*:\\s*"([^"]*)"', 1), F.lit(""))


def _labelled(values: Column, *parts: str) -> Column:
    """The first value whose label has one of the parts in it."""
    hit = lambda e: reduce(or_, [F.contains(F.lower(e["key"]), F.lit(p)) for p in parts])
    return F.get(F.filter(F.map_entries(values), hit), F.lit(0))["value"]


def page_metadata(pages: DataFrame) -> DataFrame:
    """``page_id, title, question_count, start_date, end_date, published_date, teams_played, difficulty`` of ``pages`` (page_id, html).

    Title and dates come from the embedded JSON, and where it lacks them from
    the page's heading and labels; the rest comes from the labels. What a page
    doesn't say is null.
    """
    heading = F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    title = F.nullif(F.trim(F.regexp_replace(F.regexp_replace(heading, "<[^>]*>", " "), r"\s+", " ")), F.lit(""))
    read = pages.withColumn("_v", values_of(F.col("html")))
    date = lambda field, *parts: F.coalesce(F.substring(_pushed(F.col("html"), field), 1, 10).try_cast("date"), written_date(_labelled(F.col("_v"), *parts)))
    teams = _labelled(F.col("_v"), "команд")
    return read.select(
        "page_id",
        F.coalesce(_pushed(F.col("html"), "packTitle"), title).alias("title"),
        F.regexp_extract(_labelled(F.col("_v"), "вопр"), r"(\d+)", 1).try_cast("int").alias("question_count"),
        date("startDate", "начал").alias("start_date"),
        date("endDate", "окон", "заверш").alias("end_date"),
        date("pubDate", "публик").alias("published_date"),
        F.when(F.regexp_like(teams, F.lit(r"\d")), sum_of_numbers(teams)).alias("teams_played"),
        mean_of_numbers(_labelled(F.col("_v"), "сложн")).alias("difficulty"),
    )


#: Classes of the marks before a field on an archive's page, and the fields.
ARCHIVE_FIELDS = {"Question": "text", "Answer": "answer", "PassCriteria": "zachet", "Comments": "comment", "Sources": "source", "Authors": "authors"}


class _Archive(HTMLParser):
    """Questions of an archive's page: the title above a block, and its paragraphs, each led by a mark that names the field."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.title, self.url, self.into, self.buffer = [], None, None, None, []
        self.question, self.depth, self.field = None, 0, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if tag == "dt" and "title" in classes:
            self.into, self.buffer, self.url = "title", [], None
        elif tag == "a" and self.into == "title":
            self.url = a.get("href")
        elif tag == "div":
            if self.question is not None:
                self.depth += 1
            elif "question" in classes:
                self.question, self.depth = {"tournament": self.title, "url": self.url}, 1
        elif tag == "p" and self.question is not None:
            self.close_field()
        elif tag == "strong" and self.question is not None and self.into is None:
            self.field = ARCHIVE_FIELDS.get(classes[0]) if classes else None
            self.into = "mark"
            self.buffer = []
        elif tag == "a" and self.into == "mark" and "/question/" in (a.get("href") or ""):
            self.question["question_url"] = a["href"]

    def handle_endtag(self, tag):
        if tag == "dt" and self.into == "title":
            self.title, self.into = " ".join("".join(self.buffer).split()), None
        elif tag == "strong" and self.into == "mark":
            number = re.search(r"\d+", "".join(self.buffer))
            if self.field == "text" and number:
                self.question["number"] = int(number[0])
            self.into, self.buffer = ("field", []) if self.field else (None, [])
        elif tag == "p" and self.question is not None:
            self.close_field()
        elif tag == "div" and self.question is not None:
            self.depth -= 1
            if not self.depth:
                self.close_question()

    def handle_data(self, data):
        if self.into:
            self.buffer.append(data)

    def close_field(self):
        if self.into == "field":
            text = " ".join(" ".join(self.buffer).split())
            if text:
                self.question.setdefault(self.field, text)
        self.into, self.buffer, self.field = None, [], None

    def close_question(self):
        self.close_field()
        if self.question and self.question.get("text"):
            self.found.append(self.question)
        self.question = None


_ARCHIVE = ("tournament", "url", "question_url", "number", "text", "answer", "zachet", "comment", "source", "authors")


def archive_questions(pages: DataFrame) -> DataFrame:
    """``page_id, pos`` and the fields of the questions on an archive's search pages (page_id, html); ``played`` is the date in the title.

    Blocks without a text are left out, cut-off pages give what is whole.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for page, html in zip(f["page_id"], f["html"]):
                parser = _Archive()
                parser.feed(html or "")
                parser.close()
                parser.close_question()
                rows += [(page, pos, *(q.get(k) for k in _ARCHIVE)) for pos, q in enumerate(parser.found)]
            yield pd.DataFrame(rows, columns=["page_id", "pos", *_ARCHIVE]).astype({"number": "Int64"})

    text = ", ".join(f"{k} {'long' if k == 'number' else 'string'}" for k in _ARCHIVE)
    found = pages.select("page_id", "html").mapInPandas(run, f"page_id long, pos long, {text}")
    return found.withColumn("played", F.regexp_extract("tournament", r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date"))


def linked_pack_id(html: Column) -> Column:
    """The largest pack number a page links to, or null."""
    return F.array_max(F.transform(F.regexp_extract_all(html, F.lit(r"/pack/(\d+)"), F.lit(1)), lambda n: n.try_cast("long")))


def sum_of_numbers(text: Column) -> Column:
    """Sum of the whole numbers in a text; 0 without any."""
    return F.aggregate(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), F.lit(0).cast("long"), lambda s, n: s + n.cast("long"))


def mean_of_numbers(text: Column) -> Column:
    """Mean of the numbers in a text, comma or point, to two digits; null without any."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1)), lambda n: F.replace(n, F.lit(","), F.lit(".")).cast("double"))
    total = F.aggregate(numbers, F.lit(0.0), lambda s, n: s + n)
    return F.when(F.size(numbers) > 0, F.round(total / F.size(numbers), 2))


def feed_entry_id(feed: Column, entry: Column) -> Column:
    """A stable number for a feed's entry: the first eight hex digits of the hash of both."""
    return F.conv(F.substring(F.md5(F.concat(feed, F.lit(":"), entry)), 1, 8), 16, 10).cast("long")
