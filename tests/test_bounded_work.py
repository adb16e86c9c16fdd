"""Quantiles, hot keys and listings: the same results with bounded work in any task."""

import math
import random

import numpy as np
import pytest
from conftest import local
from pyspark.sql import functions as F

from landsieve.operators import catalog, skew, stats


@pytest.mark.parametrize("values", [
    [1.0], [1.0, 2.0], [5.0] * 40, [1e-300, 1.0, 1e300, -1e300, 1.7e308, -1.7e308], [float(i % 7) for i in range(500)], [2.0**k for k in range(-200, 200)],
    [-0.0, 0.0, 3.0], [1.0 + k * 2**-52 for k in range(200)],
])
@pytest.mark.parametrize("bins", [2, 1024])
def test_quantile_of_odd_values(spark, values, bins):
    rows = local(spark, [(v,) for v in [*values, None, float("nan")]], "x double")
    for q in (0.0, 0.3, 0.5, 1.0):
        got = stats.exact_quantile(rows, "x", q, accuracy=100, bins=bins).first()["quantile"]
        order, at = sorted(values), q * (len(values) - 1)
        low, high = order[math.floor(at)], order[math.ceil(at)]
        assert got == (low if low == high else low + (high - low) * (at - math.floor(at)))


def test_quantile_gathers_a_fixed_number(spark, monkeypatch):
    """Ten million different values; no round hands more rows to the driver than it has bins and two ends."""
    gathered = []
    kept = stats._narrowed

    def watched(values, bracket, ranks, wanted, found, bins):
        low, high = bracket
        gathered.append(bins + 2)
        out = kept(values, bracket, ranks, wanted, found, bins)
        assert low <= out[0] <= out[1] <= high
        return out

    monkeypatch.setattr(stats, "_narrowed", watched)
    n = 10_000_000
    rows = spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("x"))
    assert stats.exact_quantile(rows, "x", 0.37).first()["quantile"] == pytest.approx(0.37 * (n - 1), rel=1e-15)
    assert len(gathered) <= 3 and max(gathered) <= 1026
    assert stats.exact_quantile(rows.limit(0), "x").first()["quantile"] is None


def test_hot_keys_get_salts_by_their_share(spark):
    n = 120_000
    rows = spark.range(n).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN 'warm' ELSE CAST(id AS STRING) END AS k")
    found = {r["_hot"]: r["_salts"] for r in skew.hot_keys(rows, ["k"]).collect()}
    keys = {k: spark.range(1).select(F.xxhash64(F.lit(k))).first()[0] for k in ("hot", "warm")}
    share = {r["k"]: r["count"] / n for r in rows.where("k IN ('hot', 'warm')").groupBy("k").count().collect()}
    assert set(found) == set(keys.values())
    for k, h in keys.items():
        assert found[h] >= share[k] * skew.SLICES
    # No (key, salt) holds more than 1 / 200 of the rows.
    marked = rows.join(skew.hot_keys(rows, ["k"]), F.xxhash64("k") == F.col("_hot"), "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("_salts", F.lit(1))))
    assert marked.groupBy("k", "salt").count().agg(F.max("count")).first()[0] <= n / 200


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_salted_join_of_hot_null_and_mixed_keys(spark, how):
    chance = random.Random(3)
    left = [(i, chance.choice([7, 7, 7, None, i, 10_000 + i % 50])) for i in range(6000)]
    right = [(k, f"r{k}{c}") for k in [7, 10_001, *range(0, 6000, 9)] for c in "ab"] + [(None, "none")]
    a, b = local(spark, left, "id long, k long"), local(spark, right, "k int, v string")
    got = skew.salted_join(a, b, ["k"], how, ["id"])
    want = a.join(b, a["k"] == b["k"], how).drop(b["k"]) if how != "left_anti" else a.join(b, a["k"] == b["k"], how)
    rows = lambda df: sorted(map(str, (tuple(r) for r in df.select("id", "k", *(["v"] if how != "left_anti" else [])).collect())))
    assert rows(got) == rows(want)
    plan = skew.hot_keys(a, ["k"])._jdf.queryExecution().toString()
    assert "approx_top_k" in plan and "hashpartitioning" not in plan.split("Physical Plan")[1]


def test_folders_are_read_without_their_files(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = [("az", "pima", "p", f"2024010{i}_000000", i) for i in range(1, 4)] + [("04", "st. john's #1", "p", "20240101_000000", 9)]
    local(spark, rows, "state string, county string, provider string, run_ts string, n int").write.partitionBy("state", "county", "provider", "run_ts").parquet(path)
    for file in (tmp_path / "results").rglob("*.parquet"):
        file.write_bytes(b"nothing that could be read")
    listed = catalog.run_folders(spark, path)
    assert sorted(map(tuple, listed.collect())) == sorted(r[:4] for r in rows)
    assert [r["run_ts"] for r in catalog.runs_to_drop(listed, 2).collect()] == ["20240101_000000"]
    info = {(r["county"], r["run_ts"]): r["total_runs"] for r in catalog.runs_info(listed).collect()}
    assert info["pima", "20240102_000000"] == 3 and info["st. john's #1", "20240101_000000"] == 1
    assert "Join" not in catalog.runs_info(listed)._jdf.queryExecution().toString()
    assert np.all([r["state"] in ("04", "az") for r in catalog.folders(spark, path, ["state"]).collect()])
