"""Literal cases of the engine's operators, invariants, and all queries against DuckDB at the smallest scale."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import registry
from tessera.functions import scalar
from tessera.operators import clustering, gates, manifests, metrics, readouts, sampling, series
from tessera.sources import contracts, exports, files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _values(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def _episodes(spark, n=9, invalid=()):
    rows = [(e, t, 0.25 * t, float(t + o), t not in invalid) for e, o in (("A", 0), ("B", 100)) for t in range(n if e == "A" else 7)]
    return spark.createDataFrame(rows, "user_id string, tick long, sec double, value double, valid boolean")


def test_causal_triples(spark):
    got = _values(series.causal_triples(_episodes(spark), 2, "value"), "user_id", "tick", "x0", "x1", "x2")
    assert got == [("A", t, t - 4.0, t - 2.0, float(t)) for t in range(4, 9)] + [("B", t, t + 96.0, t + 98.0, t + 100.0) for t in range(4, 7)]
    got = _values(series.causal_triples(_episodes(spark, invalid=(2,)), 2, "value", valid=F.col("valid")).where("user_id = 'A'"), "tick")
    assert got == [(5,), (7,), (8,)]


def test_the_future_does_not_change_the_past(spark):
    whole = series.causal_triples(_episodes(spark), 2, "value")
    cut = series.causal_triples(_episodes(spark).where("tick <= 6"), 2, "value")
    assert _values(whole.where("tick <= 6"), "user_id", "tick", "x0", "x1", "x2") == _values(cut, "user_id", "tick", "x0", "x1", "x2")


def test_future_change_and_segments(spark):
    assert _values(series.future_change(_episodes(spark).where("user_id = 'A'"), 2, "value"), "tick", "target") == [(t, 2.0) for t in range(7)]
    rows = spark.createDataFrame([("A", k, s) for k, s in enumerate((0.0, 1.0, 9.0, 10.0, 11.0))], "user_id string, tick long, sec double")
    assert _values(series.segments(rows, 5.0), "start", "stop") == [(0, 2), (2, 5)]
    right = spark.createDataFrame([("A", 1.0, 10), ("A", 9.5, 20)], "user_id string, sec double, v int")
    assert _values(series.as_of(rows, right, "user_id", "sec", "v"), "tick", "v") == [(0, None), (1, 10), (2, 10), (3, 20), (4, 20)]


def test_association(spark):
    pure = spark.createDataFrame([(0, "a")] * 2 + [(1, "b")] * 2, "c int, l string")
    r = metrics.association(pure, "c", "l").first()
    assert math.isclose(r["mutual_information"], math.log(2)) and math.isclose(r["nmi"], 1) and r["purity_gain"] == 1 and r["ari"] == 1
    mixed = spark.createDataFrame([(c, l) for c in (0, 1) for l in "ab"], "c int, l string")
    r = metrics.association(mixed, "c", "l").first()
    assert abs(r["mutual_information"]) < 1e-12 and abs(r["nmi"]) < 1e-12 and r["purity_gain"] == 0
    swapped = spark.createDataFrame(list(zip((0, 0, 1, 1, 2, 2), (2, 2, 0, 0, 1, 1), strict=True)), "c int, l int")
    assert metrics.association(swapped, "c", "l").first()["ari"] == 1


def test_backoff(spark):
    train = spark.createDataFrame([(0, 0, 1.0), (0, 0, 1.0), (1, 1, 3.0)], "a int, b int, y double")
    out = metrics.mean_backoff(train, spark.createDataFrame([(0, 1), (1, 0), (0, 0)], "a int, b int"), ["a", "b"], "y", 2)
    assert [(r["a"], r["b"], round(r["prediction"], 6), r["depth"]) for r in out.orderBy("a", "b").collect()] == [(0, 0, 1.0, 2), (0, 1, 1.0, 1), (1, 0, round(5 / 3, 6), 0)]
    labels = spark.createDataFrame([(0, 0, 0), (0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 0, 1), (1, 0, 1)], "a int, b int, l int")
    out = metrics.majority_backoff(labels, spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "a int, b int"), ["a", "b"], "l", 2)
    assert [(r["prediction"], r["depth"]) for r in out.orderBy("a", "b").collect()] == [(0, 2), (0, 1), (1, 1)]


def test_spearman_moments_quantiles_usage(spark):
    rows = spark.createDataFrame([("g", float(k), float(-k)) for k in range(10)] + [("h", 1.0, 1.0)] * 5, "g string, a double, b double")
    assert dict(_values(metrics.spearman(rows, "a", "b", ["g"]), "g", "spearman")) == {"g": -1.0, "h": None}
    m = spark.createDataFrame([([1.0, 2.0],), ([3.0, 6.0],)], "x array<double>")
    assert _values(metrics.vector_moments(m, "x"), "dim", "mean", "std") == [(0, 2.0, 1.0), (1, 4.0, 2.0)]
    assert rows.where("g = 'g'").agg(metrics.index_floor_quantile("a", 0.5)).first()[0] == 4.0
    u = metrics.usage(spark.createDataFrame([(0,), (1,), (1,), (2,)], "c int"), "c", [], 4).first()
    assert (u["used"], u["dead"], u["max_fraction"]) == (3, 1, 0.5)


def test_scalars(spark):
    one = spark.range(1)
    codes = F.array(*(F.lit(c).cast("long") for c in (0, 1, 2)))
    assert [one.select(scalar.prefix_key(codes, 3, d)).first()[0] for d in (1, 2, 3)] == [0, 1, 5]
    assert one.select(scalar.joint_key(codes, 3)).first()[0] == 0 + 1 * 3 + 2 * 9
    key = scalar.encode_mixed(F.array(F.lit(2), F.lit(3), F.lit(1)), [3, 5, 4])
    assert one.select(scalar.decode_mixed(key, [3, 5, 4])).first()[0] == [2, 3, 1]
    angles = F.array(F.lit(-3.13), F.lit(0.5), F.lit(3.13))
    assert np.allclose(one.select(scalar.decode_angles(scalar.encode_angles(angles), 3)).first()[0], [-3.13, 0.5, 3.13])
    vectors = spark.createDataFrame([([0.1, 0.0, 0.0],), ([-1.0, 0.0, 0.0],), ([0.0, -1.0, 0.5],), ([0.0, 0.0, 2.0],)], "v array<double>")
    assert [r[0] for r in vectors.select(scalar.direction(F.col("v"), 0.5)).collect()] == [0, 1, 3, 6]
    assert one.select(scalar.above(F.lit(2.0), [F.lit(1.0), F.lit(2.0), F.lit(3.0)])).first()[0] == 1


def test_sampling(spark):
    rows = spark.createDataFrame([(f"s{k % 8}", k) for k in range(40)], "scene string, episode long")
    for n in (1, 13):
        again = sampling.hash_sample(rows.repartition(n), 7, "episode", "x")
        assert _values(again, "episode") == _values(sampling.hash_sample(rows, 7, "episode", "x"), "episode")
    split = sampling.hash_split(rows, "scene", "salt")
    assert split.groupBy("scene").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    small, large = (set(_values(sampling.nested_subset(rows, "scene", f, "n"), "scene")) for f in (0.25, 0.5))
    assert len(small) == 2 and len(large) == 4 and small < large
    sizes = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "k string, n long")
    assert _values(sampling.largest_remainder(sizes, "k", "n", 7), "k", "quota") == [("a", 4), ("b", 2), ("c", 1)]
    assert sorted(q for _, q in _values(sampling.water_fill(sizes, "k", "n", 8, "w"), "k", "quota")) == [2, 3, 3]
    parents = spark.createDataFrame([("g", "p1"), ("g", "p2"), ("h", "p3")], "g string, p string")
    folds = dict(((g, p), f) for g, p, f in _values(sampling.folds(parents, ["g"], "p", "f"), "g", "p", "fold"))
    assert {folds["g", "p1"], folds["g", "p2"]} == {0, 1} and folds["h", "p3"] is None
    windows = spark.createDataFrame([("s", p, f"{p}{k}") for p, n in (("a", 6), ("b", 2), ("c", 2)) for k in range(n)], "s string, p string, w string")
    d = _values(sampling.derangement(windows, ["s"], "p", "w", "d"), "p", "w", "donor", "donor_parent")
    assert len({r[2] for r in d}) == 10 and all(r[1] != r[2] for r in d) and sum(r[0] != r[3] for r in d) == 8
    assert sampling.longest_first({"a": 5, "b": 4, "c": 3, "d": 3}, 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    assert sampling.greedy_cover([("x", "1", 5), ("y", "1", 3), ("y", "2", 3), ("z", "2", 9)], {"1": 3, "2": 3}, {"x": 5, "y": 6, "z": 9}) == ["y"]


def test_clustering(spark):
    generator = np.random.default_rng(0)
    x = np.concatenate([generator.normal(c, 0.1, (40, 2)) for c in ((0, 0), (5, 0), (0, 5))])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>")
    centers, curve = clustering.lloyd(rows, "x", "id", 3)
    assert sorted(np.round(centers).astype(int).tolist()) == [[0, 0], [0, 5], [5, 0]] and curve[-1] < 0.1
    plain = ((x[:, None] - centers) ** 2).sum(2)
    got = clustering.assign_nearest(rows, "x", centers.tolist()).orderBy("id").select("code", "distance").collect()
    assert [r[0] for r in got] == plain.argmin(1).tolist() and np.allclose([r[1] for r in got], plain.min(1))
    levels = clustering.train_residual_quantizer(rows, "x", "id", 3, 2, rounds=5)
    out = clustering.assign_batches(rows, "x", levels, ["id"]).collect()
    assert sum(r["error"] for r in out) <= plain.min(1).sum() + 1e-9 and all(len(r["codes"]) == 2 for r in out)
    ratio, n = clustering.effective_rank(rows, "x")
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))
    assert math.isclose(ratio, values.sum() ** 2 / (values**2).sum()) and n == 2


def test_readouts(spark):
    rows = spark.createDataFrame([(a, b, 2.0 * a - b) for a in (0, 1, 2) for b in (0, 1) for _ in range(5)], "a int, b int, y double")
    out = readouts.predict_additive(rows, readouts.additive_ridge(rows, ["a", "b"], "y", 1e-6)).select(F.max(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    assert out < 1e-4
    numbers = rows.select(F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"), "y")
    assert np.allclose(readouts.continuous_ridge(numbers, ["a", "b"], "y", 1e-9), [0, 2, -1], atol=1e-6)


def test_gates(spark):
    deltas = spark.createDataFrame([("a", -0.5), ("b", -1.0)], "e string, d double")
    r = gates.paired_bootstrap(deltas, "e", "d", 50, "s").first()
    assert (r["n"], r["mean"], r["wins"]) == (2, -0.75, 1.0) and -1 <= r["low"] <= r["high"] <= -0.5
    rows = spark.createDataFrame([("p", 40, -1.0, -0.5), ("f", 40, 1.0, 2.0), ("i", 5, -1.0, -1.0), ("u", 40, -1.0, 0.5)], "k string, n long, mean double, high double")
    assert _values(gates.verdict(rows, ["k"]), "k", "verdict") == [("f", "fail"), ("i", "invalid"), ("p", "pass"), ("u", "inconclusive")]


def _broadcast_parts(plan):
    """The subtree below each broadcast of a plan's text."""
    lines = plan.splitlines()
    depth = [len(x) - len(x.lstrip(" :+-*")) for x in lines]
    for k, x in enumerate(lines):
        if x.lstrip(" :+-*").startswith("BroadcastExchange"):
            end = next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines))
            yield "\n".join(lines[k:end])


@pytest.mark.parametrize("by_index", [False, True])
@pytest.mark.parametrize("broadcast", [False, True])
def test_a_bootstrap_broadcasts_no_draws_and_orders_no_episodes_in_one_task(spark, monkeypatch, by_index, broadcast):
    import hashlib

    monkeypatch.setattr(gates, "_BROADCAST_ROWS", 100 if broadcast else 2, raising=False)
    d = [0.5, -1.25, 3.0, 0.75, -2.0, 8.5, -0.25]
    deltas = spark.createDataFrame(list(zip("gbeadfc", d, strict=True)), "e string, d double").repartition(3)
    out = gates.paired_bootstrap(deltas, "e", "d", 40, "s", by_index)
    r = out.first()
    own, n = [x for _, x in sorted(zip("gbeadfc", d, strict=True))], len(d)
    at = lambda draw, place: int(hashlib.sha256(f"s|{draw}|{place}".encode()).hexdigest()[:12], 16) % n
    means = sorted(np.mean([own[at(draw, place)] for place in range(n)]) for draw in range(40))
    want = (means[0], means[39]) if by_index else tuple(np.quantile(means, [0.025, 0.975]))
    assert r["n"] == n and np.allclose((r["mean"], r["wins"], r["low"], r["high"]), (np.mean(d), 3 / 7, *want))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(("Range (" in x or "Generate" in x) and "Aggregate" not in x for x in _broadcast_parts(plan))
    assert "Generate" not in plan and not any("row_number" in x for x in plan.splitlines())


def test_positions(spark):
    rows = spark.createDataFrame([(k * 37 % 101, k) for k in range(101)] + [(None, 999)], "k int, v int").repartition(5)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # several ranges
    try:
        got = sampling.positions(rows, "k", "pos").collect()
    finally:
        spark.conf.unset(coalesce)
    assert sorted((r["pos"], r["k"]) for r in got) == [*((k, k) for k in range(101)), (101, None)] and len(got[0]) == 3


def test_contracts(spark, tmp_path):
    rows, path = spark.range(5), str(tmp_path / "t")
    digest = contracts.write_table(rows, path, {"b": 1, "a": [2]})
    assert contracts.write_table(rows, path, {"a": [2], "b": 1}) == digest and contracts.read_table(spark, path, digest).count() == 5
    with pytest.raises(ValueError):
        contracts.write_table(rows, path, {"b": 2})
    assert contracts.fingerprint(rows).first() == contracts.fingerprint(rows.repartition(3)).first() != contracts.fingerprint(spark.range(6)).first()


def test_streams(spark, tmp_path):
    from tessera.streaming import online

    spark.read.parquet(f"{SF}/events.parquet").repartition(2).write.parquet(str(tmp_path / "events"))
    counts = online.windowed_counts(online.event_stream(spark, str(tmp_path / "events")))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    try:
        q.processAllAvailable()
        assert spark.sql("SELECT sum(n) FROM counts").first()[0] == 1000
    finally:
        q.stop()


def test_manifest_from_its_sources(spark):
    path = lambda k, told="success": f"/nfs/data/r2d2-data-full/LAB/{told}/2023-04-17/day_{k}/trajectory.h5"
    keep = spark.createDataFrame([(path(k, "failure" if k == 3 else "success"), [] if k == 5 else [(0, 4), (6, 8)]) for k in range(10)], "raw string, ranges array<struct<begin:bigint,end:bigint>>")
    meta = [(path(k, "failure" if k == 3 else "success"), f"e{k if k != 9 else 8}", k != 3, ["blur"] if k == 4 else [], 8 - (k == 6), "LAB", "hall", "" if k == 7 else "s", f" pick  {k} ") for k in range(1, 10)]
    meta = spark.createDataFrame(meta + [(path(2), "e22", True, [], 8, "LAB", "hall", "s", "x")], "raw string, episode_id string, success boolean, quality_flags array<string>, num_steps long, institution_id string, building_id string, scene_id string, task string")
    index = spark.createDataFrame([(path(k, "failure" if k == 3 else "success"), 8, "shard") for k in range(10)], "raw string, num_steps long, shard_name string")
    by_path = lambda df: df.withColumn("path", manifests.canonical_path(F.col("raw"))).drop("raw")
    language = spark.createDataFrame([("e1", ["lift it", "pick 1"])], "episode_id string, texts array<string>")
    rows = manifests.build_manifest(by_path(keep), by_path(meta), by_path(index), language, spark.createDataFrame([("shard", "c")], "shard_name string, checksum string"))
    got = {r["path"].rpartition("_")[2]: r for r in rows.collect()}
    assert {k: r["reason"] for k, r in got.items()} == {
        "0": "missing_raw_metadata", "1": "kept", "2": "ambiguous_raw_metadata_path", "3": "failure_episode", "4": "raw_metadata_quality_flag", "5": "no_eligible_keep_ranges", "6": "kept", "7": "missing_scene_identity",
        "8": "ambiguous_raw_metadata_id", "9": "ambiguous_raw_metadata_id",
    }
    assert got["1"]["texts"] == ["lift it", "pick 1"] and got["1"]["eligible_steps"] == 6 and (got["1"]["delta"], got["6"]["delta"]) == (0, 1)


def test_canonical_paths(spark):
    # fixed values: raw paths and what they name
    cases = {
        "/nfs/data/r2d2-data-full/RAIL/success/2023-04-17/Mon_Apr_17_14:48:05_2023/trajectory.h5": "RAIL/success/2023-04-17/Mon_Apr_17_14:48:05_2023",
        "RAIL/failure/d/e/recordings/MP4": "RAIL/failure/d/e", "/RAIL/success/d/e/": "RAIL/success/d/e", "RAIL/success/d": None, "RAIL/other/d/e": None, "": None,
    }
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", manifests.canonical_path(F.col("p"))).collect()
    assert dict(map(tuple, got)) == cases


def test_rounds_from_given_centers(spark):
    x = np.random.default_rng(3).normal(size=(200, 3))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(3)
    at, want = x[:4], []
    for _ in range(3):
        d = ((x[:, None] - at) ** 2).sum(2)
        near = d.argmin(1)
        want.append((200, len(set(near.tolist())), d.min(1).sum()))
        at = np.array([x[near == k].mean(0) for k in range(4)])
    got = clustering.lloyd_from(df, "x", x[:4].tolist(), 3)
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


def test_mixed_ridge_equals_a_plain_solution(spark):
    rng = np.random.default_rng(5)
    n = 400
    a, b, c1, c2 = rng.normal(size=n), rng.normal(size=n) * 3 + 1, rng.integers(0, 4, n), rng.integers(0, 3, n)
    y = 2 * a - b + c1 * 0.5 + (c2 == 2) + rng.normal(size=n) * 0.1
    df = spark.createDataFrame([tuple(map(float, (p, q, r))) + (int(u), int(v), 7) for p, q, r, u, v in zip(a, b, y, c1, c2, strict=True)], "a double, b double, y double, c1 int, c2 int, same int").repartition(3)
    base, numbers, codes = readouts.mixed_ridge(df, ["a", "b"], ["c1", "c2", "same"], "y", 5.0)
    x = np.column_stack([a, b, *(c1 == k for k in range(4)), *(c2 == k for k in range(3))]).astype(float)
    mean, scale = x.mean(0), x.std(0)
    z = (x - mean) / scale
    w = np.linalg.solve(z.T @ z / n + 5.0 / n * np.eye(9), z.T @ (y - y.mean()) / n) / scale
    assert np.allclose([numbers["a"], numbers["b"], *(codes["c1", k] for k in range(4)), *(codes["c2", k] for k in range(3))], w) and codes["same", 7] == 0 and np.isclose(base, y.mean() - mean @ w)
    out = readouts.predict_mixed(df, (base, numbers, codes)).select("a", "prediction").toPandas().sort_values("a")
    assert np.allclose(out["prediction"], (base + x @ w)[np.argsort(a)])


def test_codebooks_reports_and_checksums(spark, tmp_path):
    import hashlib

    levels = [[[0.0, 1.0], [2.0, 3.0]], [[0.5, 0.25], [1.0, 1.5]]]
    path = f"{tmp_path}/book"
    contracts.save_codebook(spark, path, levels, [0.0, 1.0], [1.0, 2.0], {"k": 2})
    contracts.save_codebook(spark, path, levels, [0.0, 1.0], [1.0, 2.0], {"k": 2})
    assert contracts.load_codebook(spark, path) == (levels, [0.0, 1.0], [1.0, 2.0])
    with pytest.raises(ValueError):
        contracts.save_codebook(spark, path, levels[:1], [0.0, 1.0], [1.0, 2.0], {"k": 2})
    files.write_report(spark, f"{tmp_path}/report", {"b": 1, "a": [2, "ü"]})
    assert files.read_report(spark, f"{tmp_path}/report") == {"a": [2, "ü"], "b": 1}
    (tmp_path / "shards/deep").mkdir(parents=True)
    (tmp_path / "shards/deep/one.bin").write_bytes(b"abc")
    got = files.file_checksums(spark, f"{tmp_path}/shards").collect()
    assert [(r["bytes"], r["sha256"]) for r in got] == [(3, hashlib.sha256(b"abc").hexdigest())]


def test_exports_resume_and_are_complete(spark, tmp_path):
    df = spark.createDataFrame([(f"s{k % 5}", k, None if k % 7 == 0 else f"v{k}") for k in range(200)], "shard string, k long, v string").repartition(3)
    path = f"file://{tmp_path}/x"
    assert exports.export(df.where("shard < 's2'"), path, "shard") == 2
    (tmp_path / "x/parts/left-over.parquet").write_bytes(b"a run that was cut off")
    with pytest.raises(ValueError, match="3 parts are missing"):
        exports.finalize(df, path, "shard", {"n": 1})
    assert exports.export(df, path, "shard") == 3 and exports.export(df, path, "shard") == 0
    whole = exports.finalize(df, path, "shard", {"n": 1})
    assert _values(whole, "shard", "k") == _values(df, "shard", "k") and exports.changed_parts(spark, path) == []
    file = exports.reports(spark, path).where("part = 's1'").first()["file"]
    (tmp_path / "x" / file).write_bytes(b"something else")
    assert exports.changed_parts(spark, path) == ["s1"]
    with pytest.raises(Exception, match="every row"):
        exports.export(spark.createDataFrame([(None, 1)], "shard string, k long"), path, "shard")



def test_iterations_resume(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(300, 3)).round(3)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id int, x array<double>")
    want, curve = clustering.lloyd(df, "x", "id", 4, rounds=5)
    folder = f"file://{tmp_path}/rounds"
    _, part = clustering.lloyd(df, "x", "id", 4, rounds=2, checkpoint=folder)
    got, whole = clustering.lloyd(df, "x", "id", 4, rounds=5, checkpoint=folder)
    assert len(part) == 2 and np.allclose(whole, curve) and np.allclose(got, want) and whole[:2] == part


def _rows(frame, columns):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        if hasattr(v, "item"):
            v = v.item()
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    rows = [[plain(v) for v in r] for r in frame[columns].astype(object).values.tolist()]
    return sorted(rows, key=lambda r: str([round(v, 3) if isinstance(v, float) else v for v in r]))


def _near(x, y):
    return x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-6 * max(1.0, abs(y)) * 2


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, SF).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    for a, b in zip(_rows(got, columns), _rows(want, columns), strict=True):
        assert all(_near(x, y) for x, y in zip(a, b, strict=True)), (a, b)
