"""Registry of checked queries: a Spark callable per inventory id and, where SQL can say it, its oracle text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import spread
from . import views

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()

# Text tables whose rows are costly; their test files are a single split each.
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}


class Tables:
    """The given tables and the derived views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str, given: dict[str, DataFrame] | None = None):
        self.spark, self.folder, self.given = spark, folder, given or {}

    def replaced(self, **tables: DataFrame) -> Tables:
        """The same tables but for these; the views are made of them."""
        return Tables(self.spark, self.folder, self.given | tables)

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.given:
            return self.given[name]
        if name in TABLES:
            table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return spread(table, TEXT_KEYS[name]) if name in TEXT_KEYS else table
        if name in views.VIEWS:
            return self.sql(views.VIEWS[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """SQL over ``{table}`` and ``{view}`` names."""
        used = {n: getattr(self, n) for n in [*TABLES, *views.VIEWS] if "{" + n + "}" in text}
        return self.spark.sql(text, **used)


@dataclass(frozen=True)
class Check:
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Check] = {}


def expand(sql: str) -> str:
    """Oracle text with views written out as sub-selects and tables as plain names."""
    for _ in range(3):
        for name, text in views.VIEWS.items():
            sql = sql.replace("{" + name + "}", f"({text})")
    for name in TABLES:
        sql = sql.replace("{" + name + "}", name)
    return sql


def check(name: str, sql: str | None = None):
    """Register a query. The SQL must give the same column names and values."""
    def register(run: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Check(run, expand(sql) if sql else None)
        return run

    return register
