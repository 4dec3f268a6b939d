"""Operators by name, each with the query that applies it and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.testbed import Library, oracle
from .staging import fingerprint, forgotten

OPERATORS: dict[str, Callable[[Library], DataFrame]] = {}
SQL: dict[str, str] = {}
_libraries: dict[tuple[str, str], tuple[tuple, Library]] = {}


def operator(name: str, sql: str | Callable[[], str] | None = None):
    def register(f: Callable[[Library], DataFrame]) -> Callable[[Library], DataFrame]:
        assert name not in OPERATORS, name
        OPERATORS[name] = f
        if sql:
            SQL[name] = oracle(sql() if callable(sql) else sql)
        return f

    return register


def library(spark: SparkSession, sf_dir: str) -> Library:
    """One library for each session and folder, so that derived tables are computed once; a folder whose files have changed gets
    a new one, and the stored tables of the old one go."""
    key, now = (spark.sparkContext.applicationId, sf_dir), tuple(fingerprint(spark, sf_dir).first())
    if key in _libraries and _libraries[key][0] != now:
        forgotten(_libraries.pop(key)[1])
    return _libraries.setdefault(key, (now, Library(spark, sf_dir)))[1]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(library(spark, sf_dir))) for name, f in OPERATORS.items()}
