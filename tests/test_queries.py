"""Every query of the library runs on the smallest tables; those with SQL agree with DuckDB."""

import os

import pytest
from oracle import connect, form

from shelfmark.plans.registry import ORACLE, QUERIES, load

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
load()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name in ORACLE:
        r = duck.sql(ORACLE[name])
        assert form(rows, df.columns) == form(r.fetchall(), r.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["work", "chapter", "published_at", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_hold_no_cross_product(spark):
    """Pairs of large tables are never all compared."""
    for name in ("trigram_fuzzy_match", "publication_barrier", "latency_nearest_rank", "frontier_antijoin", "gap_cover_interval_join", "prev_max_publish", "lateral_top1"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_no_window_over_a_whole_table(spark):
    """What is ranked over all rows is cut down by a limit or a count before."""
    for name in ("latency_nearest_rank", "page_merge_dedup", "top3_share", "sequence_gaps", "monotone_publish"):
        lines = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                assert any(k in " ".join(lines[i + 1 : i + 5]) for k in ("TakeOrderedAndProject", "HashAggregate", "LocalLimit", "GlobalLimit")), (name, lines[i : i + 5])


def test_views_of_the_caller_stay(spark):
    spark.range(3).createOrReplaceTempView("orders")
    assert QUERIES["semi_exists"](spark, SF).count() >= 0 and spark.table("orders").columns == ["id"]
    spark.catalog.dropTempView("orders")
