"""Registry of queries: ``@query(name, sql)`` on a function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


table = read_table


def rounded(value: Column | str, digits: int) -> Column:
    """A double rounded as DuckDB's ``round`` does: its product with the power of ten, to the next integer. Spark's rounds the
    shortest decimal form, which may end in a 5 where the product lies below a half."""
    power = 10.0**digits
    return F.round((F.col(value) if isinstance(value, str) else value) * power) / power


def lit(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def lits(items) -> str:
    return ", ".join(lit(x) for x in items)
