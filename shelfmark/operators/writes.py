"""Writes as pure functions from the old table and the incoming rows to the new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Appends rows whose key isn't there yet (ON CONFLICT DO NOTHING). Keys of rows must be distinct."""
    return target.unionByName(rows.join(target.select(*keys).distinct(), keys, "left_anti"))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those of the same key and are added otherwise."""
    return target.join(rows.select(*keys), keys, "left_anti").select(*target.columns).unionByName(rows)


def update_from(target: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """UPDATE ... FROM: columns take the value in changes where the key has one. Keys of changes must be distinct."""
    new = changes.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = target.join(new, keys, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns))


def delete_using(target: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    """DELETE ... USING: rows without a partner in doomed."""
    return target.join(doomed.select(*keys).distinct(), keys, "left_anti").select(*target.columns)


def counter_upsert(counters: DataFrame, increments: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds increments to counters, and counters that are new."""
    return counters.select(*keys, value).unionByName(increments.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))
