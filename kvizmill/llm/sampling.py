"""Bounded samples for fitting."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, key: str, most: int, known: int) -> DataFrame:
    """At most ``most`` of ``known`` or fewer rows, by hash of ``key``: the same ones at each run.

    Where there are many more, a hash threshold thins them out first to about
    twice as many, so that the final order is one of few rows however large
    the table.
    """
    if known > 4 * most:
        part = math.ceil(2_000_000_000 * most / known)
        rows = rows.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1_000_000_000)) < part)
    return rows.orderBy(F.xxhash64(key), key).limit(most)
