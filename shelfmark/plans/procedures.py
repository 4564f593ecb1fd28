"""Named procedures over the tables, with arguments that switch their predicates off where they aren't given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.plans.registry import Tables, query
from shelfmark.sources.catalog import Procedures


def given(value, predicate: Column) -> Column:
    """`$1 IS NULL OR predicate`: an argument that isn't given leaves every row."""
    return F.lit(True) if value is None else predicate


def tasks_due(t: Tables, work: int | None = None, priority: str | None = None, before=None, limit: int = 100) -> DataFrame:
    """Open tasks of a work, a priority, a time, or of any: the most urgent first."""
    rows = t.orders.where((F.col("o_orderstatus") == "O") & given(work, F.col("o_custkey") == work) & given(priority, F.col("o_orderpriority") == priority) & given(before, F.col("o_orderdate") <= F.lit(before).cast("timestamp_ntz")))
    return rows.orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(limit).select("o_orderkey", "o_custkey", "o_orderpriority")


def chapters_of(t: Tables, work: int | None = None, status: str | None = None) -> DataFrame:
    """Chapters by work, those of a status or of any."""
    rows = t.orders.where(given(work, F.col("o_custkey") == work) & given(status, F.col("o_orderstatus") == status))
    return rows.groupBy("o_custkey").agg(F.count("*").alias("chapters"), F.max("o_orderdate").alias("latest"))


def source_load(t: Tables, least: int | None = None) -> DataFrame:
    """Open routes by source, of at least so many."""
    n = t.lineitem.where("l_linestatus = 'O'").groupBy("l_suppkey").agg(F.count("*").alias("open"))
    return n.where(given(least, F.col("open") >= least))


def procedures() -> Procedures:
    """What may be called by name."""
    known = Procedures()
    for f in (tasks_due, chapters_of, source_load):
        known.register(f.__name__, f)
    return known


_DUE = "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND ($w IS NULL OR o_custkey = $w) AND ($p IS NULL OR o_orderpriority = $p) ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 100"


def _bound(**values) -> str:
    text = _DUE
    for name, value in values.items():
        text = text.replace(f"${name}", value)
    return text


@query(_bound(w="NULL", p="NULL"))
def rpc_all_off(t: Tables) -> DataFrame:
    """A procedure by name, without arguments."""
    return procedures().call("tasks_due", t=t)


@query(_bound(w="NULL", p="'2-HIGH'"))
def rpc_one_on(t: Tables) -> DataFrame:
    return procedures().call("tasks_due", t=t, priority="2-HIGH")


@query("SELECT o_custkey, count(*) AS chapters, max(o_orderdate) AS latest FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def rpc_chapters(t: Tables) -> DataFrame:
    return procedures().call("chapters_of", t=t, status="F")


@query("SELECT l_suppkey, count(*) AS open FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_suppkey HAVING count(*) >= 3")
def rpc_source_load(t: Tables) -> DataFrame:
    return procedures().call("source_load", t=t, least=3)
