"""Dates as they are written in the sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Genitives of the Russian months.
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")


def written_date(text: Column) -> Column:
    """Date of ``2024-05-12...``, ``12.05.2024`` or ``12 мая 2024 г.``; null for anything else."""
    t = F.trim(text)
    dotted = F.regexp_extract(t, r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", 0) != ""
    part = lambda i: F.regexp_extract(t, r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", i)
    return F.coalesce(
        F.when(F.regexp_like(t, F.lit(r"^\d{4}-\d{2}-\d{2}")), F.substring(t, 1, 10)).try_cast("date"),
        F.when(dotted, F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0"))).try_cast("date"),
        russian_date(t),
    )


def russian_date(text: Column) -> Column:
    """Date of ``12 мая 2024 г.``, else null."""
    pattern = r"^\s*(\d{1,2})\s+([а-яё]+)\s+(\d{4})"
    low = F.lower(text)
    month = F.lit(None).cast("string")
    for i, name in enumerate(MONTHS, 1):
        month = F.when(F.regexp_extract(low, pattern, 2) == name, F.lit(f"{i:02}")).otherwise(month)
    return F.concat_ws(
        "-", F.nullif(F.regexp_extract(low, pattern, 3), F.lit("")), F.coalesce(month, F.lit("x")), F.lpad(F.regexp_extract(low, pattern, 1), 2, "0")
    ).try_cast("date")
