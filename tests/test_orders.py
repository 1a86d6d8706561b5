"""Order statistics and the block bootstrap against plain versions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import gates, orders

WANTED = {"f0": (0.0, "floor"), "f50": (0.5, "floor"), "f90": (0.9, "floor"), "f100": (1.0, "floor"), "d50": (0.5, "disc"), "d10": (0.1, "disc"), "l10": (0.1, "linear"), "l75": (0.75, "linear")}


def plain(values, p, how):
    v = sorted(values)
    if not v:
        return None
    if how == "disc":
        return v[max(0, math.ceil(len(v) * p) - 1)]
    at = (len(v) - 1) * p
    low, high = v[math.floor(at)], v[math.ceil(at)]
    return low if how == "floor" else low if low == high else low + (high - low) * (at - math.floor(at))


def check(spark, rows, kind):
    found = orders.quantiles(spark.createDataFrame(rows, f"g string, v {kind}"), ["g"], "v", WANTED)
    assert found.columns == ["g", "n", *WANTED]
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).extend([v] if v is not None and not (isinstance(v, float) and math.isnan(v)) else [])
    got = {r["g"]: r for r in found.collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g]["n"] == len(values)
        for name, (p, how) in WANTED.items():
            want = plain(values, p, how)
            assert got[g][name] == want or want is not None and math.isclose(got[g][name], want, rel_tol=1e-12, abs_tol=1e-300), (g, name)


def test_quantiles_of_doubles(spark):
    rng = np.random.default_rng(2)
    rows = [("normal", float(x)) for x in rng.normal(size=3001)] + [("wide", float(x)) for x in np.exp(rng.normal(0, 80, 2000))] + [("ties", float(x)) for x in rng.integers(0, 4, 999)]
    rows += [("one", 3.5), ("none", None), ("nan", float("nan")), ("nan", 1.0), (None, 2.0), (None, 4.0), ("same", 7.25), ("same", 7.25), ("tiny", 5e-324), ("tiny", 0.0), ("tiny", -5e-324)]
    rows += [("inf", float("inf")), ("inf", float("-inf")), ("inf", 0.0), ("inf", 1.7e308), ("inf", -1.7e308), ("huge", 1.7e308), ("huge", -1.7e308), ("huge", 1.0)]
    check(spark, [r for r in rows if r[0] != "inf"], "double")
    rounds: list[int] = []
    wide = spark.createDataFrame([r for r in rows if r[0] == "wide"], "g string, v double")
    assert orders.quantiles(wide, ["g"], "v", {"m": (0.5, "floor")}, rounds).first()["m"] == plain([v for g, v in rows if g == "wide"], 0.5, "floor") and len(rounds) <= 6
    got = orders.quantiles(spark.createDataFrame([r for r in rows if r[0] == "inf"], "g string, v double"), ["g"], "v", {f"p{k}": (k / 4, "floor") for k in range(5)}).first()
    assert [got[f"p{k}"] for k in range(5)] == [float("-inf"), -1.7e308, 0.0, 1.7e308, float("inf")]


def test_quantiles_of_whole_numbers(spark):
    rng = np.random.default_rng(3)
    rows = [("small", int(x)) for x in rng.integers(-50, 50, 700)] + [("near", 2**62 + int(x)) for x in rng.integers(0, 3000, 500)] + [("far", int(x)) for x in rng.integers(-(2**63), 2**63 - 1, 500)]
    found = orders.quantiles(spark.createDataFrame(rows, "g string, v long"), ["g"], "v", {"f": (0.3, "floor"), "d": (0.6, "disc")})
    for r in found.collect():
        own = [v for g, v in rows if g == r["g"]]
        assert (r["f"], r["d"]) == (plain(own, 0.3, "floor"), plain(own, 0.6, "disc"))


def test_large_groups_are_counted_by_tasks(spark):
    """A group of a million values: what is shuffled is a row a bin and task, and rounds are few."""
    rows = spark.range(0, 1_000_000, 1, 8).select(F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("g"), F.xxhash64("id").alias("v"))
    rounds: list[int] = []
    found = {r["g"]: r["m"] for r in orders.quantiles(rows, ["g"], "v", {"m": (0.5, "floor")}, rounds).collect()}
    values = rows.toPandas().groupby("g")["v"].apply(lambda s: np.sort(s.to_numpy())[(len(s) - 1) // 2])
    assert found == values.to_dict() and len(rounds) <= 5


def test_quantiles_without_groups_and_of_an_empty_table(spark):
    rows = spark.createDataFrame([(float(k),) for k in range(11)], "v double")
    assert tuple(orders.quantiles(rows, [], "v", {"m": (0.5, "floor"), "q": (0.25, "linear")}).first()) == (11, 5.0, 2.5)
    assert orders.quantiles(rows.limit(0).withColumn("g", F.lit("a")), ["g"], "v", {"m": (0.5, "floor")}).collect() == []


def test_a_joined_span_table_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(orders, "_BROADCAST_ROWS", 0)
    check(spark, [(f"g{k % 7}", float(k * k % 101)) for k in range(500)], "double")


# --- bootstrap ---------------------------------------------------------------------------------------

def test_the_tree_splits_all_draws():
    sizes = [5, 0, 17, 3, 1, 40, 9]
    totals = np.zeros(len(sizes))
    for draw in range(400):
        taken = [gates.draws_of_block(sizes, b, draw, "s") for b in range(len(sizes))]
        assert sum(taken) == sum(sizes) and taken[1] == 0
        totals += taken
    expected = np.array(sizes) * 400
    assert (np.abs(totals - expected) <= 5 * np.sqrt(expected + 1)).all()
    spread = np.var([gates.draws_of_block(sizes, 5, d, "s") for d in range(400)])
    p = 40 / 75
    assert 0.75 * 75 * p * (1 - p) < spread < 1.3 * 75 * p * (1 - p)


def test_the_block_bootstrap_is_a_bootstrap(spark):
    rng = np.random.default_rng(1)
    d = rng.normal(0.3, 2.0, 2000)
    rows = spark.createDataFrame([(k, float(x)) for k, x in enumerate(d)], "k long, d double")
    got = gates.block_bootstrap(rows.repartition(7), "k", "d", 300, "s", block_rows=150).first()
    again = gates.block_bootstrap(rows.repartition(2), "k", "d", 300, "s", block_rows=150).first()
    assert np.isclose(got["low"], again["low"]) and np.isclose(got["high"], again["high"]) and got["n"] == 2000
    means = [rng.choice(d, len(d)).mean() for _ in range(3000)]
    low, high = np.quantile(means, [0.025, 0.975])
    assert abs(got["low"] - low) < 0.02 and abs(got["high"] - high) < 0.02 and np.isclose(got["mean"], d.mean()) and np.isclose(got["wins"], (d < 0).mean())
    assert gates.block_bootstrap(rows.limit(0), "k", "d", 10, "s").collect() == []
    one = gates.block_bootstrap(rows.limit(1), "k", "d", 10, "s").first()
    assert one["low"] == one["high"] == one["mean"]


@pytest.mark.parametrize("n", [200_000])
def test_many_rows_are_resampled_block_by_block(spark, n):
    rows = spark.range(n).select("id", (F.col("id") % 7 - 3).cast("double").alias("d"))
    got = gates.block_bootstrap(rows, "id", "d", 50, "s", block_rows=20_000).first()
    assert got["low"] < got["mean"] < got["high"] and abs(got["high"] - got["low"]) < 0.05
