"""All queries of the core by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from kvizmill.plans.corpus import Corpus

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a ``Corpus`` as a query, with its SQL twin if there is one."""

    def register(f: Callable[[Corpus], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return register


from kvizmill.plans import browse, catalogue, compare, ingest, mining, reports, shares, training  # noqa: E402, F401
