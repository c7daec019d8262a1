"""Registration of queries and the SQL they are checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textquarry.plans.joins import spread
from textquarry.workload import views

# Tables whose rows are worth more work than a shuffle of them costs.
TEXT_TABLES = {"documents", "part"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables and the views derived from them, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in views.VIEWS:
            table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return spread(table) if name in TEXT_TABLES else table
        sql = views.VIEWS[name](views.SPARK)
        used = {n: getattr(self, n) for n in _names(sql)}
        sql = sql.replace("{", "{{").replace("}", "}}")
        for table in used:
            sql = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}} AS {table}", sql)
        return self.spark.sql(sql, **used)


def _names(sql: str) -> list[str]:
    """Tables and views a SELECT reads."""
    return sorted(set(re.findall(r"\b(?:FROM|JOIN) ([a-z_]+)\b", sql)) & views.KNOWN)


def with_views(sql: str) -> str:
    """Put the derived views a DuckDB query reads in front of it."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in _names(text):
            if name in views.VIEWS and name not in order:
                need(views.VIEWS[name](views.DUCK))
                order.append(name)

    need(sql)
    ctes = [f"{n} AS (\n{views.VIEWS[n](views.DUCK).strip()}\n)" for n in order]
    sql = sql.strip()
    if not ctes:
        return sql
    opening = re.match(r"WITH (RECURSIVE )?", sql)
    if opening:
        return opening[0] + ",\n".join(ctes) + ",\n" + sql.removeprefix(opening[0])
    return "WITH " + ",\n".join(ctes) + "\n" + sql


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return register
