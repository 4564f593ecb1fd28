"""A fluent query over a DataFrame: filters, order, limit and one-row results, with a gateway's rules for empty lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Query:
    """Each call returns a new query; df() gives the DataFrame. Nothing runs before."""

    def __init__(self, df: DataFrame):
        self._df = df

    def _where(self, condition: Column) -> Query:
        return Query(self._df.where(condition))

    def select(self, *columns: str) -> Query:
        return Query(self._df.select(*columns))

    def eq(self, c: str, v) -> Query:
        return self._where(F.col(c) == v)

    def neq(self, c: str, v) -> Query:
        return self._where(F.col(c) != v)

    def gt(self, c: str, v) -> Query:
        return self._where(F.col(c) > v)

    def gte(self, c: str, v) -> Query:
        return self._where(F.col(c) >= v)

    def lt(self, c: str, v) -> Query:
        return self._where(F.col(c) < v)

    def lte(self, c: str, v) -> Query:
        return self._where(F.col(c) <= v)

    def in_(self, c: str, values: list) -> Query:
        """An empty list matches nothing."""
        return self._where(F.col(c).isin(values) if values else F.lit(False))

    def not_in(self, c: str, values: list) -> Query:
        """An empty list excludes nothing."""
        return self._where(~F.col(c).isin(values) if values else F.lit(True))

    def is_(self, c: str, v) -> Query:
        return self._where(F.col(c).eqNullSafe(v))

    def is_not(self, c: str, v) -> Query:
        return self._where(~F.col(c).eqNullSafe(v))

    def like(self, c: str, pattern: str) -> Query:
        return self._where(F.col(c).like(pattern))

    def ilike(self, c: str, pattern: str) -> Query:
        return self._where(F.col(c).ilike(pattern))

    def overlaps(self, c: str, values: list) -> Query:
        return self._where(F.arrays_overlap(c, F.array(*map(F.lit, values))))

    def order(self, c: str, ascending: bool = True, nulls_first: bool = False) -> Query:
        """Nulls come last unless asked for."""
        col = F.col(c)
        by = (col.asc_nulls_first() if nulls_first else col.asc_nulls_last()) if ascending else (col.desc_nulls_first() if nulls_first else col.desc_nulls_last())
        return Query(self._df.orderBy(by))

    def limit(self, n: int) -> Query:
        return Query(self._df.limit(n))

    def df(self) -> DataFrame:
        return self._df

    def maybe_single(self):
        """The only row, None without one; ValueError for more."""
        rows = self._df.limit(2).collect()
        if len(rows) > 1:
            raise ValueError("more than one row")
        return rows[0] if rows else None

    def single(self):
        row = self.maybe_single()
        if row is None:
            raise ValueError("no row")
        return row
