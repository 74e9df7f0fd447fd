"""Registered queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from listing_radar.queries.logical import logical, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SHARED: dict[str, str] = {}


class Tables:
    """Logical tables of one run by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return logical(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    """Register ``function(tables) -> DataFrame`` under ``name`` together with its reference SQL."""

    def register(function: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_tables(sql, SHARED)
        return function

    return register


def shared(**ctes: str) -> None:
    """Reference SQL of intermediate results that several queries build on."""
    SHARED.update(ctes)


def ts(column, name: str | None = None):
    """Timestamp as text, so that both engines give the same value."""
    c = F.col(column) if isinstance(column, str) else column
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name or column)


def num(column: str, name: str | None = None):
    return F.col(column).cast("double").alias(name or column)


def duck_ts(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"


def duck_norm(expression: str) -> str:
    return (f"trim(regexp_replace(strip_accents(lower(coalesce({expression}, ''))), "
            f"'[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'))")


def duck_title(expression: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower(coalesce({expression}, ''))), '[ \\t\\r\\n]+', ' ', 'g'))"


def duck_clean(expression: str, length: int) -> str:
    clean = f"trim(regexp_replace(coalesce({expression}, ''), '[\\s\\x{{0B}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))"
    return f"(case when length({clean}) <= {length} then {clean} else left({clean}, {length - 1}) || '…' end)"
