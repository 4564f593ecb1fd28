"""Rates on literal events."""

import math

import pytest

from shelfmark.plans.registry import QUERIES, load

load()

# means of 41.45, 46.55, 61.95 and -41.45, whose doubles add up to less in this order
TIES = {1: [12.19, 94.91, 23.26, 35.44], 2: [54.64, 85.43, 52.63, 34.56, 45.53, 6.51], 3: [63.59, 38.61, 48.04, 78.35, 71.11, 58.89, 64.75, 72.26], 4: [-12.19, -94.91, -23.26, -35.44]}


def _stats(spark, at, values, files=1):
    rows = [(u, "error" if i == 0 else "view", v) for u, vs in values.items() for i, v in enumerate(vs)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").coalesce(1).repartition(files).write.parquet(f"{at}/events.parquet")
    df = QUERIES["source_stats"](spark, str(at))
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("source", "bigint"), ("n", "bigint"), ("mean", "double"), ("total", "double"), ("errors", "bigint")]
    return {r.source: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("files", [1, 5])
@pytest.mark.parametrize("order", [list, sorted, lambda v: v[::-1]])
def test_source_stats_ties_in_any_order(spark, tmp_path, order, files):
    got = _stats(spark, tmp_path, {u: order(v) for u, v in TIES.items()}, files)
    assert got == {1: (4, 41.5, 165.8, 1), 2: (6, 46.6, 279.3, 1), 3: (8, 62.0, 495.6, 1), 4: (4, -41.5, -165.8, 1)}


def test_source_stats_odd_values(spark, tmp_path):
    nan, inf = math.nan, math.inf
    got = _stats(spark, tmp_path, {None: [1.25, None], 1: [None, None], 2: [1.0, inf], 3: [1.0, nan], 4: [1e300, 1e300], 5: [9e19, 9e19], 6: [1e16, 1.0, -1e16], 7: [1e-300, 0.0004], 8: [1e20, 0.5]})
    assert math.isnan(got[3][1]) and math.isnan(got[3][2])
    del got[3]
    assert got == {None: (2, 1.3, 1.25, 1), 1: (2, 0.0, None, 1), 2: (2, inf, inf, 1), 4: (2, 1e300, 2e300, 1), 5: (2, 9e19, 1.8e20, 1), 6: (3, 0.3, 1.0, 1), 7: (2, 0.0, 0.0, 1), 8: (2, 5e19, 1e20, 1)}
