"""Replies of language models as typed columns. What doesn't parse is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unfenced(reply: Column) -> Column:
    """The reply without a Markdown fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(reply, F.lit("")), r"^\s*```[a-zA-Z]*\s*", ""), r"\s*```\s*$", ""))


def first_object(reply: Column) -> Column:
    """From the first opening to the last closing brace, or null."""
    return F.nullif(F.regexp_extract(unfenced(reply), r"(?s)(\{.*\})", 1), F.lit(""))


def topics(reply: Column, categories: int = 14) -> Column:
    """At most two ``(cat, sub, conf)`` of ``{"topics": [...]}``; null if there is no valid one.

    A confidence that is missing is .5; it is rounded to two digits. Numbers
    may be written as strings.
    """
    item = "array<struct<cat: string, sub: string, conf: string>>"
    raw = F.from_json(F.get_json_object(first_object(reply), "$.topics"), item)
    typed = F.transform(
        raw,
        lambda t: F.struct(
            t["cat"].try_cast("int").alias("cat"),
            F.coalesce(t["sub"].try_cast("int"), F.lit(1)).alias("sub"),
            F.round(F.coalesce(t["conf"].try_cast("double"), F.lit(0.5)), 2).alias("conf"),
        ),
    )
    valid = F.slice(F.filter(typed, lambda t: t["cat"].between(1, categories)), 1, 2)
    return F.when(F.size(valid) > 0, valid)


def numbered_map(reply: Column, most: int) -> Column:
    """Map of key to number of a JSON object, for whole numbers from 1 to ``most``; empty if it doesn't parse."""
    pairs = F.map_entries(F.from_json(first_object(reply), "map<string, string>"))
    numbers = F.transform(pairs, lambda e: F.struct(e["key"], e["value"].try_cast("int").alias("value")))
    kept = F.filter(numbers, lambda e: e["value"].between(1, most))
    return F.map_from_entries(F.coalesce(kept, F.array().cast("array<struct<key: string, value: int>>")))


def post_category(reply: Column) -> Column:
    """``(category, confidence)`` of a reply; "null" and "" are no category, a missing confidence is .5."""
    body = first_object(reply)
    name = F.trim(F.get_json_object(body, "$.category"))
    category = F.when(F.lower(name).isin("null", "none", ""), None).otherwise(name)
    confidence = F.coalesce(F.get_json_object(body, "$.confidence").try_cast("double"), F.lit(0.5))
    return F.when(body.isNotNull(), F.struct(category.alias("category"), confidence.alias("confidence")))


def facts(reply: Column) -> Column:
    """Facts of a reply: strings of a JSON list over 20 characters, else numbered or bulleted lines; none for "НЕТ"."""
    text = unfenced(reply)
    listed = F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit("")), "array<string>")
    lines = F.filter(F.split(text, r"\r?\n"), lambda line: F.regexp_like(line, F.lit(r"^\s*(?:\d+[.)]|[-*•])\s+\S")))
    stripped = F.transform(lines, lambda line: F.trim(F.regexp_replace(line, r"^\s*(?:\d+[.)]|[-*•])\s+", "")))
    none = F.array().cast("array<string>")
    return F.when(F.upper(text).isin("НЕТ", ""), none).otherwise(
        F.coalesce(F.filter(listed, lambda s: F.length(s) > 20), stripped, none)
    )
