"""Rows chosen within groups: first rows, top n, fairness ranks, capped running sums, circular cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rank(df: DataFrame, keys: list, order: list, into: str = "_rn") -> DataFrame:
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_n_per_group(df: DataFrame, keys: list, order: list, n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each group; Spark limits groups before the shuffle. `order` must be total."""
    out = _rank(df, keys, order, rank or "_rn").where(F.col(rank or "_rn") <= n)
    return out if rank else out.drop("_rn")


def distinct_on(df: DataFrame, keys: list, order: list) -> DataFrame:
    """DISTINCT ON: the first row of each group."""
    return top_n_per_group(df, keys, order, 1)


def supersede(df: DataFrame, keys: list, order: list, flag: str = "superseded") -> DataFrame:
    """Marks all rows but the first of each group."""
    return _rank(df, keys, order).withColumn(flag, F.col("_rn") > 1).drop("_rn")


def fair_ranks(df: DataFrame, first: list, second: list, order: list, n: int) -> DataFrame:
    """At most n rows of each first group, and of these at most n of each second group."""
    return top_n_per_group(top_n_per_group(df, first, order, n), second, order, n)


def running_cap(df: DataFrame, keys: list, order: list, eligible: Column, most: int) -> DataFrame:
    """Rows up to and with the most-th eligible one of each group; rows that aren't eligible count for nothing."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running", F.sum(F.when(eligible, 1).otherwise(0)).over(frame)).where(F.col("running") <= most)


def circular_after(df: DataFrame, key: str, cursor, n: int) -> DataFrame:
    """The n rows after the cursor in the order of key, going on from the start at the end."""
    return df.orderBy((F.col(key) <= F.lit(cursor)).cast("int"), F.col(key)).limit(n)
