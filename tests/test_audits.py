"""Audits on small tables with known answers, nulls and repeats."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import audits


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_windows_against_episodes(spark):
    w = spark.createDataFrame([(1, "a", 0, 4, "x"), (1, "a", 0, 4, "x"), (2, "a", 3, 9, "y"), (3, "gone", 0, 5, "x")], "w int, ref string, start int, stop int, role string")
    e = spark.createDataFrame([("a", 5, "train"), ("b", 9, "val")], "id string, steps int, split string")
    got = audits.windows_against_episodes(w, e, ["w"], "ref", "start", "stop", "role", "id", "steps", "split")
    assert rows(got) == [("-", "x", 1, 0, 1, 0, 0), ("train", "x", 2, 2, 0, 0, 8), ("train", "y", 1, 0, 0, 1, 2)]


def test_run_consistency(spark):
    a = spark.createDataFrame([("r", 1, "p", 5), ("r", 2, "p", 5), ("s", 1, "p", 5), ("s", 1, "q", 6)], "run string, seed int, pool string, size int")
    got = audits.run_consistency(a, "run", {"pools": F.col("pool")}, {"seeds": F.col("seed")}, {"one_size": F.col("size")})
    assert rows(got) == [("r", 1, True, True, 2), ("s", 2, False, False, 2)]


def test_row_differences(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, v string")
    assert rows(audits.row_differences(a, b)) == [(1, 1)] and rows(audits.row_differences(a, a)) == [(0, 0)] and rows(audits.row_differences(a.limit(0), b.limit(0))) == [(0, 0)]
    assert rows(audits.differing_pairs({"a": a, "b": b, "c": a})) == [("a", "b", 1, 1), ("a", "c", 0, 0), ("b", "c", 1, 1)]
    with pytest.raises(ValueError, match="other columns"):
        audits.row_differences(a, b.withColumnRenamed("v", "w"))


def test_lookup_losses_and_measured_records(spark):
    clips = spark.createDataFrame([("a", "s1"), ("a", "s2"), ("b", "s1"), (None, "s1"), ("zz", "s9")], "ref string, shard string")
    episodes = spark.createDataFrame([("a", "lab", 1), ("b", "lab", 2)], "id string, lab string, scene int")
    shards = spark.createDataFrame([("s1",)], "name string")
    got = audits.lookup_losses(clips, {"no_episode": (episodes, "ref", "id"), "no_shard": (shards, "shard", "name")}, F.coalesce("lab", F.lit("-")).alias("lab"), {"scenes": "scene"})
    assert rows(got) == [("-", 2, 2, 1, 0), ("lab", 3, 0, 1, 2)]
    motion = spark.createDataFrame([("a", 6.0, 3)], "id string, motion double, steps int")
    assert rows(audits.measured_records(episodes, motion, "id", "lab", F.col("motion") / F.col("steps"))) == [("lab", 2, 1, 2.0)]


def test_condition_summary(spark):
    m = spark.createDataFrame([("f", "left", 1, 2.0), ("f", "right", 1, 4.0), ("f", "left", 2, 4.0), ("f", "right", 2, 4.0), ("f", "natural", 1, 4.0), ("g", "left", 1, 1.0)], "family string, condition string, clip int, value double")
    got = {(r["family"], r["condition"]): (r["n"], r["mean"], r["to_natural"], r["opposite"]) for r in audits.condition_summary(m, "family", "condition", "clip", "value", "natural", ("left", "right"), F.col("value")).collect()}
    assert got == {("f", "left"): (2, 3.0, 0.75, 0.5), ("f", "right"): (2, 4.0, 1.0, 0.5), ("f", "natural"): (1, 4.0, 1.0, 0.5), ("g", "left"): (1, 1.0, None, None)}


def test_changes_texts_and_depths(spark):
    t = spark.createDataFrame([("e", 0, 7, 1.0), ("e", 1, 7, 20.0), ("e", 2, 8, 21.0), ("d", 0, 7, 5.0)], "e string, t int, code int, v double")
    assert rows(audits.change_by_code(t, "e", "t", "code", "v", 10)) == [(7, 1, 1.0, 20.0, 19.0), (8, 1, 0.0, 21.0, 1.0)]
    w, texts = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "p string"), spark.createDataFrame([("a", 3), ("b", None)], "p string, n int")
    assert rows(audits.text_coverage(w, texts, "p", "n")) == [(3, 1, 2, 6)] and rows(audits.text_coverage(w.limit(0), texts, "p", "n")) == [(0, 0, 0, 0)]
    d = spark.createDataFrame([("x", 0, 2.0), ("x", 1, 1.0), ("x", 2, 1.0), ("y", 0, 1.0), ("y", 2, 3.0)], "g string, depth int, mse double")
    assert rows(audits.best_depth(d, ["g"])) == [("x", 1, 1.0), ("y", 0, 1.0)]
    assert [(r["g"], r["complete"], [tuple(x) for x in r["profile"]]) for r in audits.depth_profiles(d, ["g"], (0, 1, 2)).orderBy("g").collect()] == [("x", True, [(0, 2.0), (1, 1.0), (2, 1.0)]), ("y", False, [(0, 1.0), (2, 3.0)])]
