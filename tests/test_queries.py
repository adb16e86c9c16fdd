"""Every registered query against DuckDB on the smallest tables."""

import math

import duckdb
import pytest
from conftest import SMALL

from landsieve.registry import ORACLES, QUERIES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders"]


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return db


def plain(rows, order):
    def text(value):
        if value is None or (isinstance(value, float) and math.isnan(value)):
            return "NULL"
        return repr(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)

    return sorted(tuple(text(row[i]) for i in order) for row in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    ours = plain(got.collect(), [got.columns.index(c) for c in sorted(names)])
    theirs = plain(want.fetchall(), [names.index(c) for c in sorted(names)])
    assert ours == theirs
    assert ours


def test_expected_values(spark):
    """Validated figures of the smallest fixture."""
    funnel = {r["stage"]: r["n"] for r in QUERIES["q_funnel"](spark, SMALL).collect()}
    assert funnel == {
        "all": 1500, "min_size": funnel["min_size"], "exclusions": 856, "airports": 852, "transmission": 411,
        "min_kv": 209, "roadway": 159, "provider": 21,
    }
    ranked = QUERIES["q_mcda"](spark, SMALL).collect()
    assert len(ranked) == 159
    assert sum(r["drive_time"] == 9999.0 for r in ranked) == 86
    stats = QUERIES["q_stats_mcda"](spark, SMALL).first()
    assert (round(stats["mean_score"], 5), round(stats["median_score"], 6), round(stats["std_dev"], 6)) == (4.91238, 4.971827, 1.872321)
    assert [r["ogc_fid"] for r in QUERIES["q_top5"](spark, SMALL).collect()] == [586, 880, 478, 1120, 317]
