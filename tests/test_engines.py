"""Gram blocks against plain solutions, grids of codebooks against lone runs, and runs that are cut off."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import registry
from tessera.operators import clustering, codebooks, gram, readouts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(4)
    n = 700
    x, v = rng.normal(size=(n, 3)), rng.normal(size=n) * 5 + 2
    a, b = rng.integers(0, 5, n), rng.integers(0, 3, n)
    y = x @ [1.0, -2.0, 0.5] + 0.3 * v + np.array([0, 1, 5, -2, 0.5])[a] + rng.normal(size=n)
    z = rng.normal(size=(n, 2)) + b[:, None]
    split = np.array(["train", "val", "test"])[rng.choice(3, n, p=[0.7, 0.2, 0.1])]
    rows = [(split[k].item(), x[k].tolist(), float(v[k]), None if k % 50 == 0 else int(a[k]), int(b[k]) if k % 40 else 99, float(y[k]), z[k].tolist()) for k in range(n)]
    return spark.createDataFrame(rows, "split string, x array<double>, v double, a int, b int, y double, z array<double>").repartition(5), rows


def design(rows, split, codes):
    own = [r for r in rows if r[0] == split]
    parts = [np.ones((len(own), 1)), np.array([r[1] for r in own]), np.array([[r[2]] for r in own]), np.array([[r[5]] for r in own]), np.array([r[6] for r in own])]
    for place, n in zip((3, 4), codes, strict=True):
        parts.append(np.array([[1.0 if r[place] == k else 0.0 for k in range(n)] for r in own]))
    return np.hstack(parts)


def test_blocks_are_the_gram_matrix(mixed):
    df, rows = mixed
    grams = gram.block_gram(df, ["x", "v"], {"a": 5, "b": 3}, ["y", "z"], "split", {"x": 3, "z": 2})
    assert set(grams) == {"train", "val", "test"}
    for split, g in grams.items():
        m = design(rows, split, (5, 3))
        assert np.allclose(g.matrix, m.T @ m) and len(g.columns) == m.shape[1]
    assert grams["val"].columns[:6] == ["1", ("x", 0), ("x", 1), ("x", 2), "v", "y"] and grams["val"].columns[-1] == ("b", 2)


def test_readouts_equal_a_plain_solution(mixed):
    df, rows = mixed
    grams = gram.block_gram(df, ["x", "v"], {"a": 5, "b": 3}, ["y", "z"], "split", {"x": 3, "z": 2})
    models = {"dense": ["x", "v"], "codes": ["a", "b"], "all": ["x", "v", "a", "b"], "none": []}
    found = {(r["model"], r["target"], r["alpha"], r["split"]): r for r in gram.readout_grid(grams, models, ["y", "z"], [0.1, 8.0])}
    assert len(found) == 4 * 2 * 2 * 3
    places = {"dense": [1, 2, 3, 4], "codes": [8, 9, 10, 11, 12, 13, 14, 15], "all": [1, 2, 3, 4, *range(8, 16)], "none": []}
    for (model, target, alpha, split), r in found.items():
        t, h = design(rows, "train", (5, 3)), design(rows, split, (5, 3))
        p, to = places[model], [5] if target == "y" else [6, 7]
        mean, scale, my = t[:, p].mean(0), t[:, p].std(0), t[:, to].mean(0)
        u = (t[:, p] - mean) / scale
        w = np.linalg.solve(u.T @ u + alpha * np.eye(len(p)), u.T @ (t[:, to] - my)) if p else np.zeros((0, len(to)))
        error = ((h[:, to] - my - (h[:, p] - mean) / scale @ w) ** 2).sum()
        assert np.isclose(r["mse"], error / len(h)) and np.isclose(r["reduction"], 1 - error / ((h[:, to] - my) ** 2).sum())
    for model in models:
        own = [r for r in found.values() if (r["model"], r["target"], r["split"]) == (model, "y", "val")]
        assert [r["alpha"] for r in own if r["chosen"]] == [max(own, key=lambda r: (r["reduction"], -r["alpha"]))["alpha"]]


def test_the_engine_agrees_with_the_single_readouts(spark, mixed):
    df, _ = mixed
    flat = df.select("split", F.col("x")[0].alias("x0"), "v", "a", "b", "y").where("b < 3 AND a IS NOT NULL")
    g = gram.block_gram(flat, ["x0", "v"], {"a": 5, "b": 3}, ["y"], "split")["train"]
    one = gram.solve(g, ["x0", "v", "a", "b"], "y", [2.0])[2.0]
    base, numbers, codes = readouts.mixed_ridge(flat.where("split = 'train'"), ["x0", "v"], ["a", "b"], "y", 2.0)
    assert np.isclose(one.intercept[0], base) and all(np.isclose(one.weights[k][0], w) for k, w in {**numbers, **codes}.items())


def test_two_thousand_columns_fit_in_one_scan(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(3000).select(F.lit("train").alias("split"), (F.col("id") % 1000).alias("a"), (F.xxhash64("id") % 1000 + 1000).cast("long").alias("raw"), F.rand(3).alias("y")).withColumn("b", F.pmod("raw", F.lit(1000))).drop("raw")
    counted = rows.mapInArrow(count, rows.schema)
    g = gram.block_gram(counted, [], {"a": 1000, "b": 1000}, ["y"], "split")["train"]
    assert g.matrix.shape == (2002, 2002) and seen.value == 3000 and g.matrix[2:1002, 2:1002].trace() == 3000 and g.matrix[2:1002, 1002:].sum() == 3000
    grid = gram.readout_grid({"train": g}, {"both": ["a", "b"], "a": ["a"]}, ["y"], [1.0, 10.0])
    assert len(grid) == 4 and seen.value == 3000 and all(0 < r["reduction"] < 1 for r in grid)


def test_ridges_equal_to_nine_decimals_go_to_the_smaller():
    def split(slope, n=1e6):  # a standard column, and a target that follows it by a slope
        return gram.Gram(["1", "a", "y"], n * np.array([[1, 0, 0], [0, 1, slope], [0, slope, 1]]))

    for slope, best in ((0.009, 0.5), (0.5, 0.5), (-0.5, 4.0)):
        grid = gram.readout_grid({"train": split(0.01), "val": split(slope)}, {"a": ["a"]}, ["y"], (4.0, 0.5))
        assert {r["alpha"] for r in grid if r["chosen"]} == {best}
        raw = {r["alpha"]: r["reduction"] for r in grid if r["split"] == "val"}
        assert raw[4.0] != raw[0.5]


def test_gram_refuses_bad_rows(spark):
    for rows, match in (([("train", 1.0, None)], "nulls"), ([("train", float("nan"), 1.0)], "finite"), ([(None, 1.0, 1.0)], "every row")):
        with pytest.raises(Exception, match=match):
            gram.block_gram(spark.createDataFrame(rows, "split string, x double, y double"), ["x"], {}, ["y"], "split")
    assert gram.block_gram(spark.createDataFrame([], "split string, x double, y double"), ["x"], {}, ["y"], "split") == {}


# --- codebooks ---------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(c, 0.3, (60, 3)) for c in ((0, 0, 0), (4, 0, 0), (0, 5, 1), (3, 3, 3))])
    split = np.where(np.arange(len(x)) % 5 == 0, "val", "train")
    rows = [(k, v.tolist(), split[k].item(), bool(split[k] == "train")) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x array<double>, split string, learn boolean").repartition(4, "id").cache(), x, split


MEMBERS = [codebooks.Member("a", 4, 7), codebooks.Member("b", 4, 19), codebooks.Member("c", 6, 7, "learn", 1e-4, 3), codebooks.Member("d", 2, 7, None, 0.5, 1)]


def test_members_of_a_grid_move_as_they_would_alone(cloud):
    df, _, _ = cloud
    scans: list[int] = []
    grid = codebooks.fit_grid(df, "x", "id", MEMBERS, "split", scans=scans)
    for m in MEMBERS:
        alone = codebooks.fit_grid(df, "x", "id", [m], "split")[m.name]
        assert np.allclose(alone.centers, grid[m.name].centers) and len(alone.curve) == len(grid[m.name].curve)
        assert all(np.isclose(p[s], q[s]) for p, q in zip(alone.curve, grid[m.name].curve, strict=True) for s in p)
    rounds = [len(f.curve) for f in grid.values()]
    assert len(scans) == max(rounds) and sum(scans) == sum(rounds) and scans[0] == 4 and scans[-1] < 4 and all(f.settled for f in grid.values())


def test_a_member_equals_plain_iterations(cloud):
    df, x, split = cloud
    fit = codebooks.fit_grid(df, "x", "id", [MEMBERS[2]], "split")["c"]
    own = x[split == "train"]
    d = ((own[:, None] - fit.centers) ** 2).sum(2)
    near = d.argmin(1)
    assert np.allclose([own[near == k].mean(0) for k in range(6)], fit.centers, atol=1e-2)
    assert set(fit.curve[0]) == {"train", "val"} and all(p["train"] >= q["train"] - 1e-12 for p, q in zip(fit.curve, fit.curve[1:], strict=False))
    one = codebooks.fit_grid(df, "x", "id", [codebooks.Member("m", 1, rounds=3)])["m"]
    assert np.allclose(one.centers[0], x.mean(0)) and np.isclose(one.curve[-1]["all"], x.var(0).sum())


def test_empty_centers_move_to_the_hardest_rows(spark):
    rows = spark.createDataFrame([(k, [float(v)]) for k, v in enumerate([0.0] * 20 + [1.0, 9.0, 10.0])], "id long, x array<double>")
    fit = codebooks.fit_grid(rows, "x", "id", [codebooks.Member("m", 3, rounds=12)])["m"]
    assert sorted(fit.centers[:, 0].round(3).tolist()) == [round(1 / 21, 3), 9.0, 10.0] or fit.curve[-1]["all"] < 0.05
    few = codebooks.fit_grid(rows.limit(2), "x", "id", [codebooks.Member("m", 5, rounds=2)])["m"]
    assert len(few.centers) == 2
    with pytest.raises(ValueError, match="no rows"):
        codebooks.fit_grid(rows.limit(0), "x", "id", [codebooks.Member("m", 2)])


def test_a_grid_that_is_cut_off_goes_on(cloud, tmp_path):
    df, _, _ = cloud
    whole = codebooks.fit_grid(df, "x", "id", MEMBERS, "split")
    folder, scans = f"file://{tmp_path}/grid", []
    for _ in range(20):
        found = codebooks.fit_grid(df, "x", "id", MEMBERS, "split", folder, stop_after=2, scans=scans)
        if all(f.settled for f in found.values()):
            break
    assert len(scans) == max(len(f.curve) for f in whole.values())
    for m in MEMBERS:
        assert np.allclose(found[m.name].centers, whole[m.name].centers) and len(found[m.name].curve) == len(whole[m.name].curve)
    for other in ([MEMBERS[0]], [codebooks.Member("a", 5, 7), *MEMBERS[1:]], [codebooks.Member("a", 4, 7, patience=9), *MEMBERS[1:]]):
        with pytest.raises(ValueError, match="other members or rows"):
            codebooks.fit_grid(df, "x", "id", other, "split", folder)
    with pytest.raises(ValueError, match="other members or rows"):
        codebooks.fit_grid(df.where("id > 0"), "x", "id", MEMBERS, "split", folder)


def test_residual_levels_resume_and_differ(cloud, tmp_path):
    df, x, split = cloud
    whole = codebooks.fit_residual_levels(df, "x", "id", 4, 3, "split", "learn")
    folder = f"file://{tmp_path}/levels"
    for cut in range(1, 40):
        got = codebooks.fit_residual_levels(df, "x", "id", 4, 3, "split", "learn", folder, stop_after=1)
        if len(got) == 3 and got[-1].settled:
            break
    assert cut == sum(len(f.curve) for f in whole)
    left = x.copy()
    for a, b in zip(whole, got, strict=True):
        assert np.allclose(a.centers, b.centers) and a.settled
        near = ((left[:, None] - a.centers) ** 2).sum(2).argmin(1)
        left = left - a.centers[near]
    assert not np.allclose(whole[0].centers, whole[1].centers)
    assert (left**2).sum(1).mean() <= whole[-1].curve[-1]["train"] * 1.1 + whole[-1].curve[-1]["val"]
    with pytest.raises(ValueError, match="other members or rows"):
        codebooks.fit_residual_levels(df, "x", "id", 5, 3, "split", "learn", folder)


def test_the_older_trainer_keeps_levels_apart_and_refuses_other_runs(cloud, tmp_path):
    df, _, _ = cloud
    folder = f"file://{tmp_path}/rq"
    plain = clustering.train_residual_quantizer(df, "x", "id", 4, 3, rounds=6)
    first = clustering.train_residual_quantizer(df, "x", "id", 4, 3, folder, rounds=6)
    again = clustering.train_residual_quantizer(df, "x", "id", 4, 3, folder, rounds=6)
    for a, b, c in zip(plain, first, again, strict=True):
        assert np.allclose(a, b) and np.allclose(b, c)
    assert not np.allclose(first[0], first[1])
    cut = f"file://{tmp_path}/cut"
    clustering.train_residual_quantizer(df, "x", "id", 4, 2, cut, rounds=6)
    more = clustering.train_residual_quantizer(df, "x", "id", 4, 3, cut, rounds=6)
    assert all(np.allclose(a, b) for a, b in zip(plain, more, strict=True))
    for other, k in ((df, 5), (df.where("id > 3"), 4)):
        with pytest.raises(ValueError, match="another model or table"):
            clustering.train_residual_quantizer(other, "x", "id", k, 3, folder, rounds=6)


@pytest.mark.parametrize("name", ["readout_grid"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got, columns = registry.queries()[name](spark, SF), sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want.project(", ".join(columns)).fetchall(), key=repr)


@pytest.mark.parametrize("name", ["readout_blocks", "kmeans_grid", "rq_levels"])
def test_queries_run(spark, name):
    rows = registry.queries()[name](spark, SF).collect()
    assert rows and all(np.isfinite(r["mse"]) and r["mse"] >= 0 for r in rows)
