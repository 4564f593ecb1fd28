"""Named queries: each binds an operator to the tables, with the same result in SQL where SQL can express it."""

from __future__ import annotations

import importlib
import pkgutil
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The tables of one folder, read when asked for: t.orders is spark.read.parquet(<folder>/orders.parquet)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers f(tables) under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[Tables], DataFrame]):
        name = f.__name__
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return add


def load() -> None:
    """Imports all modules of this package, so that their queries are registered."""
    import shelfmark.plans as here

    for m in pkgutil.iter_modules(here.__path__):
        importlib.import_module(f"shelfmark.plans.{m.name}")


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Registers a query that is plain SQL, run by Catalyst on the tables it names; `oracle` where DuckDB's words differ."""
    tables = "|".join(_TABLES)
    named = re.compile(rf"\b(FROM|JOIN)\s+({tables})\b", re.I)
    used = sorted({m[2].lower() for m in named.finditer(text)})
    bound = named.sub(lambda m: f"{m[1]} {{{m[2].lower()}}}", text)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # the tables as arguments, so that no view of the caller's is replaced
        return spark.sql(bound, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})

    if name in QUERIES:
        raise ValueError(f"two queries are named {name}")
    QUERIES[name], ORACLE[name] = run, oracle or text
