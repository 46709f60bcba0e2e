"""The driver's contract: names, columns, and equal rows from SQL for a few cheap queries."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tidepool.plans import ORACLES, QUERIES
from tidepool.plans.tables import GIVEN

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["query_id", "asset_id", "similarity", "fused", "rank", "width", "height", "creation_s", "modification_s", "text"]


@pytest.mark.parametrize("name", ["search_combined", "snapshot_diff", "index_summary", "label_report", "retrieval_scores", "tile_plan"])
def test_rows_are_those_of_the_sql(spark, name):
    db = duckdb.connect()
    for t in GIVEN:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = db.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    want = sorted(map(repr, found.fetchall()))
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr(tuple(r)) for r in got.select(names).collect()) == want
