"""The operators' queries agree with DuckDB where SQL can express them."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import connect, form

from shelfmark.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    r = connect(SF).sql(ORACLE[name])
    assert form(df.collect(), df.columns) == form(r.fetchall(), r.columns)


def test_all_ten():
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in QUERIES)] == []
