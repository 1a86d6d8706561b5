"""Literal cases and brute-force comparisons of motion, selection, gates and text files."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import gates, metrics, motion, sampling
from tessera.sources import contracts, files


def test_grids(spark):
    row = spark.createDataFrame([([float(k) for k in range(32)],)], "v array<double>")
    assert row.select(motion.pool_grid(F.col("v"), 2, 4, 2)).first()[0] == [2.5, 4.5, 10.5, 12.5, 18.5, 20.5, 26.5, 28.5]
    assert row.select(motion.pool_grid(F.col("v"), 2, 4, 1)).first()[0] == [7.5, 23.5]
    got = row.select(motion.spatial_moments(F.col("v"), 2, 4)).first()[0]
    at = [-1, -1 / 3, 1 / 3, 1]
    want = [sum((16 * c + 4 * i + j) * f(at[j], at[i]) for i in range(4) for j in range(4)) / 16 for c in range(2) for f in (lambda x, y: 1, lambda x, y: x, lambda x, y: y, lambda x, y: x * x + y * y)]
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got, want, strict=True))


def test_latent_frames(spark):
    got = motion.latent_frames(spark.createDataFrame([("a", 0), ("b", 1), ("c", 8), ("d", 9)], "e string, n long")).select("e", "latent", "frame").collect()
    assert sorted(map(tuple, got)) == [("b", 0, 0), ("c", 0, 0), ("c", 1, 4), ("d", 0, 0), ("d", 1, 4), ("d", 2, 8)]


def test_proportional_means_round_half_to_even(spark):
    rows = spark.createDataFrame([("a", t, float(t)) for t in range(10)] + [("b", 0, 7.0)], "user_id string, tick long, value double")
    got = {(r[0], r[1]): (r[2], r[3]) for r in motion.proportional_means(rows, "value", 5, 1).select("user_id", "latent", "n", "mean").collect()}
    bounds = [round(t / 4 * 10) for t in range(5)]
    for t in range(4):
        assert got["a", t] == (bounds[t + 1] - bounds[t], sum(range(bounds[t], bounds[t + 1])) / (bounds[t + 1] - bounds[t]))
        assert got["b", t] == (1, 7.0)


def test_perturbations_and_transitions(spark):
    got = {r["condition"]: (r["y0"], r["y1"], r["y2"]) for r in motion.perturbed(spark.createDataFrame([(1, 2, 3)], "x0 int, x1 int, x2 int")).collect()}
    assert got == {"history_swap": (2, 1, 3), "reverse_time": (3, 2, 1), "static_current": (3, 3, 3)}
    rows = spark.range(6).select(F.lit("a").alias("user_id"), F.col("id").alias("tick"))
    assert [r["kind"] for r in motion.transition_kind(rows, [(1, 4)]).orderBy("tick").collect()] == ["boundary", "inside", "inside", "boundary", "outside"]


def test_weights_have_mean_one(spark):
    rows = spark.createDataFrame([(u, t, float(t * t % 7), t % 5 == 0) for u in "ab" for t in range(12)] + [("c", 0, 1.0, True)], "user_id string, tick long, value double, on boolean")
    out = motion.decision_weights(rows, F.col("on").cast("double"), "value").groupBy("user_id").agg(F.avg("weight")).collect()
    assert len(out) == 3 and all(math.isclose(r[1], 1) for r in out)


def test_nearest(spark):
    left = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("a", 9.0), ("b", 1.0)], "k string, at double")
    right = spark.createDataFrame([("a", 2.0, 20), ("a", 6.0, 60)], "k string, at double, v int")
    got = motion.nearest(left, right, "k", "at", "v").select("k", "at", "v", "distance").collect()
    assert sorted(map(tuple, got)) == [("a", 1.0, 20, 1.0), ("a", 4.0, 20, 2.0), ("a", 9.0, 60, 3.0), ("b", 1.0, None, None)]


def test_overlap_mapping_equals_all_permutations():
    draw = random.Random(3)
    for k in (0, 1, 3, 5, 7):
        for _ in range(20 if k < 7 else 3):
            m = [[draw.randrange(4) for _ in range(k)] for _ in range(k)]
            want = max((sum(m[i][j] for i, j in enumerate(p)), p) for p in itertools.permutations(range(k)))[1]
            assert tuple(metrics.overlap_mapping(m)) == want
    # fixed values: overlaps and the mapping expected of them
    assert metrics.overlap_mapping([[0, 5, 0], [0, 0, 7], [9, 0, 0]]) == [1, 2, 0]
    many = [[draw.randrange(100) for _ in range(64)] for _ in range(64)]
    assert sorted(metrics.overlap_mapping(many)) == list(range(64))


def _robin(rows, n, salt):
    """All rows at once, without any cut."""
    import hashlib

    h = lambda *x: hashlib.sha256("|".join((salt, *map(str, x))).encode()).hexdigest()
    scenes = sorted({r[0] for r in rows}, key=lambda s: h("scene", s))
    left, a, b, out, start = {s: [r for r in rows if r[0] == s] for s in scenes}, {}, {}, [], 0
    while len(out) < min(n, len(rows)):
        for k in range(len(scenes)):
            own = left[scenes[(start + k) % len(scenes)]]
            if own and len(out) < n:
                r = min(own, key=lambda r: (a.get(r[2], 0), b.get(r[3], 0), h(r[1])))
                own.remove(r)
                a[r[2]], b[r[3]] = a.get(r[2], 0) + 1, b.get(r[3], 0) + 1
                out.append(r[1])
        start += 1
    return out


@pytest.mark.parametrize("n", [1, 4, 9, 33, 200])
def test_scene_round_robin_equals_brute_force(spark, n):
    draw = random.Random(5)
    rows = [(f"s{draw.randrange(7) // 2}", k, draw.choice("xyz"), draw.choice("pq")) for k in range(90)]
    df = spark.createDataFrame(rows, "scene string, id long, person string, task string").withColumn("all", F.lit(1))
    got = sampling.scene_round_robin(df, ["all"], "scene", "id", ["person", "task"], n, "t").orderBy("pick").collect()
    assert [r["id"] for r in got] == _robin(rows, n, "t")


def test_dealt_ranks_are_equal_and_disjoint(spark):
    rows = spark.range(100).select((F.col("id") % 9).alias("g"), "id")
    got = sampling.deal_ranks(rows, "g", "id", 7, "x").collect()
    assert len({r["id"] for r in got}) == len(got) == 98 and sorted(r["pos"] for r in got) == list(range(98))
    assert {sum(r["rank"] == k for r in got) for k in range(7)} == {14}


def test_gates_and_rules(spark):
    rows = spark.createDataFrame([(0.9, 5.0), (0.4, None)], "a double, b double")
    got = {r["gate"]: (r["worst"], r["status"]) for r in gates.bounds(rows, {"low": ("a", 0.5, None, True), "high": ("a", None, 0.9, False), "null": ("b", 1.0, None, True)}).collect()}
    assert got == {"low": (0.4, "fail"), "high": (0.9, "pass"), "null": (5.0, "fail")}
    assert {r["status"] for r in gates.bounds(rows.where("a > 1"), {"low": ("a", 0.5, None, True)}).collect()} == {"missing"}
    assert [tuple(r) for r in contracts.violations(rows, {"a": F.col("a") > 0.5, "b": F.col("b") > 0}).collect()] == [("a", 1), ("b", 1)]


def test_text_files(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", 1 / 3), (1, "a\tq", None), (3, None, 2e9)], "id int, z string, m double")
    files.write_jsonl(rows, str(tmp_path / "j"), "id")
    assert [r[0] for r in spark.read.text(str(tmp_path / "j")).orderBy(F.get_json_object("value", "$.id")).collect()][0] == '{"id":1,"z":"a\\tq"}'
    files.write_tsv(rows.coalesce(1), str(tmp_path / "t"), ["z", "nothing"])
    lines = [x for f in (tmp_path / "t").glob("*.csv") for x in f.read_text().splitlines()]
    assert lines[0] == "z\tid\tm" and "b\t2\t0.333333" in lines and any(x.endswith("3\t2e+09") for x in lines)
    (tmp_path / "l.txt").write_text("gs://x/a.bin:\n    Creation time: now\n    Content-Length:  12\n    Hash (crc32c):  AA==\ngs://x/b:\n    Content-Length: 7\nTOTAL: 2 objects\n")
    assert sorted(map(tuple, files.read_object_listing(spark, str(tmp_path / "l.txt")).collect())) == [("gs://x/a.bin", 12, "AA=="), ("gs://x/b", 7, None)]


def test_ragged_offsets(spark):
    rows = spark.createDataFrame([(5, 2), (1, None), (3, 4)], "k long, n int")
    assert sorted(tuple(r) for r in files.ragged_offsets(rows, "k", "n", block=3).select("k", "start", "stop").collect()) == [(1, 0, 0), (3, 0, 4), (5, 4, 6)]
