"""Registry of queries and their oracle SQL.

A query states its plain columns and its rounded (floating-point) columns once; the same selection is
applied to the Spark result and to the oracle.  Oracle statements name shared sub-results, which are put
in front of them as common table expressions.
"""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SHARED: dict[str, str] = {}
RECURSIVE: set[str] = set()


def shared(name: str, sql: str, recursive: bool = False) -> None:
    SHARED[name] = sql
    if recursive:
        RECURSIVE.add(name)


def query(name: str, plain: str, rounded: str = "", oracle: str | None = None, digits: int = 6):
    """Register a query; `oracle` is the name of a shared sub-result or a SELECT."""
    keep, approx = plain.split(), rounded.split()

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _present(build(spark, sf_dir), keep, approx, digits)
        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if oracle is not None:
            columns = keep + [f"round({c}, {digits}) + 0.0 AS {c}" for c in approx]
            source = oracle if re.fullmatch(r"\w+", oracle.strip()) else f"({oracle})"
            ORACLES[name] = f"SELECT {', '.join(columns)} FROM {source} AS result"
        return build
    return register


def _present(df: DataFrame, keep: list[str], approx: list[str], digits: int) -> DataFrame:
    """Select the stated columns; integers as BIGINT, floating-point values rounded without negative zero."""
    def plain(c: str):
        small = isinstance(df.schema[c].dataType, (T.IntegerType, T.ShortType, T.ByteType))
        return F.col(c).cast("bigint").alias(c) if small else F.col(c)
    return df.select(*[plain(c) for c in keep],
                     *[(F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c) for c in approx])


def oracle_statements() -> dict[str, str]:
    return {name: _with_shared(sql) for name, sql in ORACLES.items()}


def _with_shared(sql: str) -> str:
    order: list[str] = []
    pending: set[str] = set()

    def need(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_][a-z0-9_]*", text)):
            if word in SHARED and word not in order and word not in pending:
                pending.add(word)
                need(SHARED[word])
                order.append(word)

    need(sql)
    if not order:
        return sql
    tables = ",\n".join(f"{n} AS (\n{SHARED[n].strip()}\n)" for n in order)
    return f"WITH {'RECURSIVE ' if RECURSIVE & set(order) else ''}{tables}\n{sql}"
