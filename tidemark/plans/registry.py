"""The table of registered queries and the shared parts of their check SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.bindings import Data
from tidemark.plans.relations import RELATIONS
from tidemark.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """One form for both engines: dates as ISO text, doubles rounded (no negative zero), integers as long."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, digits: int = 6):
    """Registers a function of the bindings under a name, with its check SQL."""
    def add(fn: Callable[[Data], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(Data(configure(spark), sf_dir)), digits)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_relations(sql)
        return fn
    return add


def _needs(text: str) -> list[str]:
    return [r for r in RELATIONS if re.search(rf"\b{r}\b", text)]


def with_relations(sql: str) -> str:
    """Prefixes the shared relations the SQL names, in dependency order."""
    order: list[str] = []
    def visit(name: str) -> None:
        for dep in _needs(RELATIONS[name]):
            if dep != name:
                visit(dep)
        if name not in order:
            order.append(name)
    for name in _needs(sql):
        visit(name)
    if not order:
        return sql
    head = ",\n".join(f"{n} AS ({RELATIONS[n]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    return f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"


def r(expr: str, name: str, digits: int = 6) -> str:
    """A rounded double in the check SQL."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


def n(expr: str, name: str) -> str:
    """A count in the check SQL."""
    return f"CAST({expr} AS BIGINT) AS {name}"


def d(expr: str, name: str) -> str:
    """A date as text in the check SQL."""
    return f"strftime(CAST({expr} AS DATE), '%Y-%m-%d') AS {name}"
