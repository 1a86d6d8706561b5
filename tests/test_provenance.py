"""Closure of reports over their links, and what the audit finds."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import registry
from tessera.operators import provenance

SF = "/root/testdata/sf0.001"


def tables(spark, links, reports):
    return spark.createDataFrame(reports, "report string, hash string"), spark.createDataFrame(links, "report string, input string, claimed string")


def test_broken_links_are_found(spark):
    reports = [(r, f"h{r}") for r in "abcdefgx"] + [("d", "hd"), ("e", "other")]
    links = [("a", "b", "hb"), ("a", "c", "hc"), ("b", "d", "hd"), ("c", "d", "old"), ("d", "a", "ha"), ("c", "gone", "h"), ("b", "e", "he"), ("f", "g", "hg"), ("f", "nowhere", "h"), ("a", "b", "hb"), ("g", None, "h"), ("d", "g", None)]
    r, k = tables(spark, links, reports)
    roots = spark.createDataFrame([("a",), ("zz",), (None,)], "report string")
    got = sorted(map(tuple, provenance.audit(r, k, roots).collect()), key=repr)
    want = [("missing", "c", "gone"), ("unequal", "c", "d"), ("unequal", "b", "e"), ("unequal", "d", "g"), ("unknown", "zz", None), ("unreachable", "f", None), ("unreachable", "x", None)]
    assert got == sorted(want, key=repr)
    depth = dict(map(tuple, provenance.closure(k, roots).collect()))
    assert depth == {"a": 0, "zz": 0, "b": 1, "c": 1, "d": 2, "e": 2, "gone": 2, "g": 3}


@pytest.mark.parametrize("rows", [1, 3])
def test_partitions_follow_rows_not_bytes(spark, monkeypatch, rows):
    monkeypatch.setattr(provenance, "_ROWS", rows, raising=False)  # every step is joined by shuffle
    ids = spark.range(40).select(F.lit("a").alias("report"), F.col("id").alias("input"))
    assert provenance.dealt(ids, "input", 40).withColumn("task", F.spark_partition_id()).agg(F.count_distinct("task")).first()[0] > 4  # put together by bytes, all would be in one
    test_broken_links_are_found(spark)


def test_many_paths_are_followed_once(spark):
    layers = [[f"n{k}-{j}" for j in range(6)] for k in range(12)]
    links = [(x, y, f"h{y}") for a, b in zip(layers, layers[1:], strict=False) for x in a for y in b]  # 6^12 paths
    r, k = tables(spark, links, [(x, f"h{x}") for own in layers for x in own])
    roots = spark.createDataFrame([(x,) for x in layers[0]], "report string")
    assert provenance.audit(r, k, roots).collect() == [] and provenance.closure(k, roots).count() == 72


def test_identities_of_what_is_reached(spark):
    r, k = tables(spark, [("a", "b", "hb")], [("a", "ha"), ("b", "hb"), ("c", "hc")])
    r = r.withColumns({"manifest": F.when(F.col("report") == "c", "n").otherwise("m"), "artifact": F.col("report"), "note": F.lit(None).cast("string")})
    roots = spark.createDataFrame([("a",)], "report string")
    assert [tuple(x) for x in provenance.identity_conflicts(r, k, roots, ["manifest", "artifact", "note"]).collect()] == [("artifact", 2)]
    assert provenance.audit(r.limit(0), k.limit(0), roots.limit(0)).collect() == []


def test_the_query_equals_its_recursive_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    want = con.sql(registry.oracle_sql()["provenance_audit"])
    got = registry.queries()["provenance_audit"](spark, SF).select(*want.columns)
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == sorted(want.fetchall(), key=repr) and {r[0] for r in rows} == {"missing", "unequal", "unreachable"}
