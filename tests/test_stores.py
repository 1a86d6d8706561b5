"""Record files, transactional parts and segment stores: formats, plans, corruption, and runs that are cut off."""

from __future__ import annotations

import os
import struct
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import registry
from tessera.sources import commits, contracts, exports, records, segments

SF = "/root/testdata/sf0.001"
TABLES = "events lineitem".split()


def plain_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def rows_of(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)


def test_crc32c():
    assert records.crc32c([b"123456789"]) == [0xE3069283] and records.crc32c([bytes(32)]) == [0x8A9136AA]  # published values
    rng = np.random.default_rng(0)
    datas = [rng.bytes(n) for n in (0, 1, 2, 3, 4, 5, 63, 64, 65, 127, 128, 129, 1000, 5000, 64, 3)]
    assert records.crc32c(datas) == [plain_crc(d) for d in datas]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text(max_size=8), st.one_of(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=9), st.lists(st.binary(max_size=9), max_size=5), st.lists(st.floats(width=32, allow_nan=False), max_size=9)), max_size=5))
def test_examples_come_back(features):
    data = records.encode_example(features)
    assert records.decode_example(data, set(features)) == features
    for name in list(features)[:1]:
        assert records.decode_example(data, {name}) == {name: features[name]}


def test_examples_as_others_write_them():
    unpacked = bytes.fromhex("0a0d 0a0b 0a0161 1206 1a04 0801 0802".replace(" ", ""))  # integers one by one
    with pytest.raises(ValueError, match="ends after"):
        records.decode_example(unpacked[:-3], {"a"})
    assert records.decode_example(records._field(1, records._field(1, records._field(1, b"a") + records._field(2, records._field(3, b"\x08\x01\x08\x02")))), {"a"}) == {"a": [1, 2]}


@pytest.fixture
def shards(spark, tmp_path):
    path = f"file://{tmp_path}/records"
    rows = spark.range(60).select(F.format_string("s%d", F.col("id") % 4).alias("shard"), F.col("id").alias("key"), F.col("id").cast("string").cast("binary").alias("data"))
    records.write_records(rows, path, "shard", ["key"], ["key"])
    return path


def plan(spark, df, tmp_path, name):
    df.write.parquet(f"file://{tmp_path}/{name}")
    return f"file://{tmp_path}/{name}"


def local(path: str) -> str:
    return path.removeprefix("file://")


def test_records_are_read_by_position(spark, tmp_path, shards):
    index = records.written_index(spark, shards)
    assert rows_of(index.groupBy("shard").count(), "count") == [(15,)] * 4
    manifest = plan(spark, index.where("key % 3 = 0").select("shard", "position", "bytes", "key"), tmp_path, "m")
    for stretch in (1, 4, 10_000):
        read = records.read_records(spark, f"{shards}/data", manifest, stretch=stretch)
        assert sorted(int(r["data"]) for r in read.collect()) == list(range(0, 60, 3))
    assert read.rdd.getNumPartitions() == 4 and records.read_records(spark, f"{shards}/data", manifest, stretch=2).rdd.getNumPartitions() == 12
    whole = records.read_records(spark, f"{shards}/data")
    assert sorted(int(r[0]) for r in whole.select("data").collect()) == list(range(60))


def test_filters_reach_the_plan_and_other_shards_are_not_opened(spark, tmp_path, shards):
    index = records.written_index(spark, shards)
    manifest = plan(spark, index.select("shard", "position", "bytes"), tmp_path, "m")
    wanted = index.where("key = 9").first()
    for name in os.listdir(local(f"{shards}/data")):
        if name != wanted["shard"]:
            os.truncate(local(f"{shards}/data/{name}"), 3)
    read = records.read_records(spark, f"{shards}/data", manifest).where((F.col("shard") == wanted["shard"]) & (F.col("position") >= wanted["position"]) & (F.col("position") < wanted["position"] + 2))
    assert sorted(int(r["data"]) for r in read.collect()) == [9, 13]
    with pytest.raises(Exception, match="bytes, not"):
        records.read_records(spark, f"{shards}/data", manifest).collect()


def test_reading_stops_after_the_last_wanted_record(spark, tmp_path, shards):
    index = records.written_index(spark, shards)
    last = index.where("key = 56").first()  # the last of its shard
    with open(local(f"{shards}/data/{last['shard']}"), "r+b") as f:
        f.seek(last["offset"] + 12)
        f.write(b"\xff")
    early = plan(spark, index.where(F.col("shard") == last["shard"]).where("key < 50").select("shard", "position"), tmp_path, "early")
    assert records.read_records(spark, f"{shards}/data", early).count() == 13
    late = plan(spark, index.where("key = 56").select("shard", "position"), tmp_path, "late")
    with pytest.raises(Exception, match="fails its checksum"):
        records.read_records(spark, f"{shards}/data", late).collect()
    gone = plan(spark, index.where("key = 56").select("shard", (F.col("position") + 9).alias("position")), tmp_path, "gone")
    with pytest.raises(Exception, match="has no record"):
        records.read_records(spark, f"{shards}/data", gone).collect()
    twice = plan(spark, index.where("key = 56").select("shard", "position").union(index.where("key = 56").select("shard", "position")), tmp_path, "twice")
    with pytest.raises(Exception, match="repeats positions"):
        records.read_records(spark, f"{shards}/data", twice).collect()


def test_the_file_format_is_the_public_one(shards):
    name = sorted(os.listdir(local(f"{shards}/data")))[0]
    data = Path(local(f"{shards}/data/{name}")).read_bytes()
    (n,) = struct.unpack("<Q", data[:8])
    mask = lambda c: ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF
    assert struct.unpack("<I", data[8:12])[0] == mask(plain_crc(data[:8])) and struct.unpack("<I", data[12 + n : 16 + n])[0] == mask(plain_crc(data[12 : 12 + n]))


def test_features_that_are_not_named_stay_encoded(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    rows = spark.createDataFrame([("s", 1, [1, -2], [0.5], ["a", "é"], None), ("s", 2, [], [1.5, 2.5], ["b"], b"x")], "shard string, key long, n array<long>, x array<float>, t array<string>, image binary")
    records.write_records(rows, path, "shard", ["key"], ["key"])
    read = records.read_records(spark, f"{path}/data", schema="position long, t array<string>, n array<long>, image array<binary>, other array<long>")
    assert rows_of(read) == [(0, ["a", "é"], [1, -2], [], None), (1, ["b"], [], [b"x"], None)]
    empty = plan(spark, spark.createDataFrame([], "shard string, position long"), tmp_path, "none")
    assert records.read_records(spark, f"{path}/data", empty).collect() == []


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "shard string, key long").withColumn("data", F.lit(b"x"))
    with pytest.raises(Exception, match="repeats"):
        records.write_records(rows, path, "shard", ["key"], ["key"], unique="key")
    left = [f for d, _, names in os.walk(local(path)) for f in names]
    assert left == [] and commits.committed(path) == []
    with pytest.raises(ValueError, match="no committed shard"):
        records.written_index(spark, path)


def test_shards_are_written_once(spark, shards):
    rows = spark.createDataFrame([("s1", 99, b"x"), ("s9", 100, b"y")], "shard string, key long, data binary")
    before = sorted(os.listdir(local(f"{shards}/data")))
    with pytest.raises(Exception, match="committed already"):
        records.write_records(rows, shards, "shard", ["key"], ["key"])
    assert sorted(os.listdir(local(f"{shards}/data"))) == before


# --- parts -------------------------------------------------------------------------------------------

PARTS = "part string, k long, v string"


def parts(spark, *names):
    return spark.createDataFrame([(p, k, f"{p}{k}") for p in names for k in range(20)], PARTS)


def test_part_names_keep_their_type(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    df = parts(spark, "007", "08", "x")
    assert exports.export(df, path, "part") == 3 and exports.export(df, path, "part") == 0
    assert rows_of(exports.finalize(df, path, "part", {"n": 1})) == rows_of(df)
    numbers = spark.createDataFrame([(7, 1), (8, 2)], "part int, k long")
    assert exports.export(numbers, f"{path}-int", "part") == 2 and rows_of(exports.finalize(numbers, f"{path}-int", "part", {})) == rows_of(numbers)


def test_exports_resume(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    assert exports.export(parts(spark, "a"), path, "part") == 1
    first = rows_of(exports.reports(spark, path))
    with pytest.raises(ValueError, match="2 parts are missing"):
        exports.finalize(parts(spark, "a", "b", "c"), path, "part", {})

    def fails(batches):
        for b in batches:
            if "c" in b.column(0).to_pylist():
                raise RuntimeError("an executor is lost")
            yield b

    cut = parts(spark, "a", "b", "c").repartition(4, "part").mapInArrow(fails, PARTS)
    with pytest.raises(Exception, match="an executor is lost"):
        exports.export(cut, path, "part")
    assert rows_of(exports.reports(spark, path)) == first and len(os.listdir(local(f"{path}/parts"))) == 1
    assert exports.export(parts(spark, "a", "b", "c"), path, "part") == 2
    assert set(first) <= set(rows_of(exports.reports(spark, path)))
    with pytest.raises(ValueError, match="1 are unexpected"):
        exports.finalize(parts(spark, "a", "b"), path, "part", {})
    whole = exports.finalize(parts(spark, "a", "b", "c"), path, "part", {"n": 1})
    assert rows_of(whole) == rows_of(parts(spark, "a", "b", "c")) and exports.finished(spark, path)["n"] == 1


def test_a_finished_table_is_verified_each_time(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    df = parts(spark, "a", "b")
    exports.export(df, path, "part")
    exports.finalize(df, path, "part", {})
    entry = next(e for e in commits.committed(path) if e["key"] == "b")
    at = Path(local(f"{path}/{entry['file']}"))
    data = at.read_bytes()
    at.write_bytes(data[:-1] + bytes([data[-1] ^ 1]))
    assert exports.changed_parts(spark, path) == ["b"]
    with pytest.raises(ValueError, match=r"differ.*\['b'\]"):
        exports.finalize(df, path, "part", {})
    at.unlink()
    assert exports.changed_parts(spark, path) == ["b"]


def test_a_part_of_another_source_is_refused(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    of = lambda **x: spark.createDataFrame(list(x.items()), "part string, source string")
    exports.export(parts(spark, "a"), path, "part", of(a="1"))
    assert exports.export(parts(spark, "a", "b"), path, "part", of(a="1", b="1")) == 1
    with pytest.raises(ValueError, match=r"\['a'\] have changed"):
        exports.export(parts(spark, "a", "b"), path, "part", of(a="2", b="1"))
    assert rows_of(exports.read_parts(spark, path)) == rows_of(parts(spark, "a", "b"))


def test_rows_without_a_part_and_large_parts(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    with pytest.raises(Exception, match="every row needs a part"):
        exports.export(spark.createDataFrame([("a", 1), (None, 2)], "part string, k long"), path, "part")
    assert commits.committed(path) == []
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
    try:
        big = spark.range(40_000).select(F.when(F.col("id") < 30_000, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 5)).alias("part"), F.col("id").alias("k"))
        assert exports.export(big, path, "part") == 6
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = [e["key"] for e in commits.committed(path)]
    assert files.count("hot") > 1 and rows_of(exports.finalize(big, path, "part", {})) == rows_of(big)


def test_a_changed_commit_is_refused_and_the_first_of_two_counts(tmp_path):
    root = f"file://{tmp_path}/c"
    entry = lambda key, name: {"key": key, "file": name}
    commits.commit(root, [entry("a", "1")])
    with pytest.raises(ValueError, match="committed already"):
        commits.commit(root, [entry("a", "2"), entry("b", "2")])
    commits.commit(root, [entry("a", "3"), entry("b", "3")], unique=False)  # as a second job would that looked before the first commit
    assert [(e["key"], e["file"]) for e in commits.committed(root)] == [("a", "1"), ("b", "3")]
    name = sorted(os.listdir(tmp_path / "c/commits"))[0]
    at = tmp_path / "c/commits" / name
    at.write_text(at.read_text().replace('"file": "1"', '"file": "9"'))
    with pytest.raises(ValueError, match="was changed"):
        commits.committed(root)


# --- segments ----------------------------------------------------------------------------------------

@pytest.fixture
def store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = spark.range(3000).select(F.format_string("e%d@0:3", "id").alias("episode_id"), F.transform(F.sequence(F.lit(0), F.col("id") % 5), lambda x: F.array(x / 3.0, F.col("id") * 1.0)).alias("action"), F.when(F.col("id") % 2 == 0, "train").alias("split"))
    return path, rows, segments.write_segments(rows, path, "episode_id", {"joint": "abc"}, shards=40)


def test_lookups_read_only_what_they_need(spark, store):
    path, rows, digest = store
    wanted = rows.where("episode_id IN ('e5@0:3', 'e77@0:3', 'e2048@0:3')")
    index = records.written_index(spark, path)
    own = {r[0] for r in index.join(wanted.withColumnRenamed("episode_id", "id"), "id").select("shard").collect()}
    for name in os.listdir(local(f"{path}/data")):
        if name not in own:
            os.unlink(local(f"{path}/data/{name}"))
    assert rows_of(segments.lookup(spark, path, wanted.select("episode_id"), digest)) == rows_of(wanted)
    assert rows_of(segments.lookup(spark, path, wanted.select("episode_id"), digest, ["split", "episode_id"])) == rows_of(wanted, "split", "episode_id")
    assert segments.lookup(spark, path, wanted.select("episode_id"), digest).rdd.getNumPartitions() <= 3
    assert segments.lookup(spark, path, wanted.select("episode_id").limit(0), digest).collect() == []


def test_lookups_refuse_ids_and_contracts(spark, store):
    path, rows, digest = store
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    with pytest.raises(ValueError, match="1 ids repeat, 0 are unknown"):
        segments.lookup(spark, path, ids("e1@0:3", "e1@0:3"))
    with pytest.raises(ValueError, match="0 ids repeat, 2 are unknown"):
        segments.lookup(spark, path, ids("e1@0:3", "nobody", None))
    with pytest.raises(ValueError, match="another contract"):
        segments.lookup(spark, path, ids("e1@0:3"), "0" * 64)
    with pytest.raises(FileExistsError):
        segments.write_segments(rows, path, "episode_id", {})


def test_a_changed_index_is_refused_before_data_are_read(spark, store):
    path, rows, digest = store
    for name in os.listdir(local(f"{path}/data")):
        os.unlink(local(f"{path}/data/{name}"))
    at = Path(local(f"{path}/index")) / sorted(x for x in os.listdir(local(f"{path}/index")) if x.endswith(".parquet"))[0]
    data = at.read_bytes()
    at.write_bytes(data[:100] + bytes([data[100] ^ 1]) + data[101:])
    with pytest.raises(ValueError, match="index files were changed"):
        segments.lookup(spark, path, rows.select("episode_id").limit(1), digest)


def test_ids_of_segments_are_unique(spark, tmp_path):
    for n, ids in enumerate(([1, 2, 1], [1, None])):
        with pytest.raises(Exception, match="null or repeats"):
            segments.write_segments(spark.createDataFrame([(i, "x") for i in ids], "id long, v string"), f"file://{tmp_path}/s{n}", "id", {})


# --- fingerprints and queries ------------------------------------------------------------------------

def test_fingerprints_tell_nulls_and_separators_apart(spark):
    def of(*rows):
        return tuple(contracts.fingerprint(spark.createDataFrame(rows, "a string, b string")).first())

    cases = [of((None, "z")), of(("null", "z")), of(("-", "z")), of(("x|b=y", "z")), of(("x", "y|b=z")), of(("x", "z")), of(("", "xz")), of(("x", "z"), ("x", "z"))]
    assert len(set(cases)) == len(cases) and of(("a", "b"), ("c", None)) == of(("c", None), ("a", "b"))


@pytest.mark.parametrize("name", ["record_files", "part_export", "sidecar_lookup", "content_fingerprint"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want.project(", ".join(columns)).fetchall(), key=repr)
