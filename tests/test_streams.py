"""Causal triples over streams: any order of arrival, late and missing ticks, restarts, and state that goes."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import registry
from tessera.streaming import causal, online

SF = "/root/testdata/sf0.001"
SCHEMA = "user_id long, tick long, sec double, value double, ok boolean"
BASE = 1_700_000_000.0


def rows_of(n=30, users=3, missing=((1, 7), (2, 0)), invalid=((0, 11),), cut=((0, 20),)):
    """Ticks a minute apart; from a cut on, an hour later."""
    out = []
    for u in range(users):
        later = 0.0
        for t in range(n):
            later += 3600 if (u, t) in cut else 0
            if (u, t) not in missing:
                out.append((u, t, BASE + 60.0 * t + later, float(100 * u + t), (u, t) not in invalid))
    return out


def plain(rows, stride, most):
    at = {(u, t): (sec, x, ok) for u, t, sec, x, ok in rows}
    out = []
    for u, t in at:
        three = [at.get((u, t - k * stride)) for k in (2, 1, 0)]
        if None not in three and all(v[2] for v in three) and three[1][0] - three[0][0] <= most and three[2][0] - three[1][0] <= most:
            out.append((u, t, three[2][0], *(v[1] for v in three)))
    return sorted(out)


def write(spark, folder, k, rows):
    spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros((F.col("sec") * 1e6).cast("long"))).coalesce(1).write.parquet(f"{folder}/slice-{k:03d}")


def stream(spark, folder):
    return spark.readStream.schema(f"{SCHEMA}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/slice-*")


def triples(spark, folder, late="1 day"):
    return causal.causal_triples(stream(spark, folder), 2, "value", 200.0, late, valid="ok")


def test_any_order_gives_what_the_batch_gives_and_restarts_change_nothing(spark, tmp_path):
    rows = rows_of()
    want = plain(rows, 2, 200.0)
    assert want and want == sorted(set(want)) and len(want) < len(rows)
    random.Random(3).shuffle(rows)
    slices = [rows[:25], rows[25:60] + rows[:5], rows[60:]]  # five rows come twice
    folder, sink, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    for k, own in enumerate(slices):
        write(spark, folder, k, own)
        got = causal.run_to_end(triples(spark, folder), sink, checkpoint)  # a new run each time, from the checkpoint
    assert sorted(map(tuple, got.collect())) == want
    again = causal.run_to_end(triples(spark, folder), sink, checkpoint)
    assert sorted(map(tuple, again.collect())) == want


def test_rows_after_the_watermark_are_left_out_and_state_goes(spark, tmp_path):
    rows = rows_of(users=1, missing=(), invalid=(), cut=())
    early, late = rows[:10], rows[10:12]
    far = [(9, 0, BASE + 100_000.0, 0.0, True)]
    folder, sink, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    for k, own in enumerate([early, far, far, late]):
        write(spark, folder, k, own)
        got = causal.run_to_end(triples(spark, folder, "1 hour"), sink, checkpoint)
    assert sorted(map(tuple, got.collect())) == plain(early, 2, 200.0)  # the watermark has passed the last two ticks
    state = spark.read.format("statestore").option("stateVarName", "ticks").load(checkpoint)
    assert {r[0] for r in state.select("key.user_id").distinct().collect()} == {9}


def test_slices_keep_their_files_and_each_row_comes_once(spark, tmp_path):
    from tessera.plans import streams

    rows = spark.range(4000).select(F.col("id").alias("event_id"), F.col("id").cast("double").alias("sec")).repartition(4)
    want = 0
    for k, stream in enumerate(streams.arriving(rows, f"{tmp_path}/in", 3, 100)):
        assert stream.isStreaming
        own = spark.read.parquet(f"{tmp_path}/in/slice-{k:03d}")
        assert len(own.inputFiles()) > 1 and not any(tmp_path.glob(f"in/slice-{k + 1:03d}"))
        want += own.count()
    assert want == 4000 == spark.read.parquet(f"{tmp_path}/in/slice-*").select("event_id").distinct().count()


# --- codebooks ---------------------------------------------------------------------------------------

def cloud(spark, n=400, seed=0):
    x = np.random.default_rng(seed).normal(0, 0.1, (n, 2)) + np.array([[0, 0], [5, 5], [0, 5]])[np.arange(n) % 3]
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, x array<double>"), x


def test_dead_codes_revive_at_the_worst_residuals(spark, tmp_path):
    df, x = cloud(spark)
    book = online.StreamingCodebook(spark, np.array([[0.0, 0.0], [900.0, 900.0], [-900.0, 0.0]]), f"{tmp_path}/state", decay=0.3)
    for k in range(8):
        book.update(df, k)
    near = ((x[:, None] - book.centers) ** 2).sum(2)
    assert book.revived >= 2 and len(set(near.argmin(1).tolist())) == 3 and near.min(1).mean() < 0.1
    plain = online.OnlineCodebook(np.array([[0.0, 0.0], [900.0, 900.0], [-900.0, 0.0]]), decay=0.3)
    for k in range(8):
        plain.update(df, k)
    assert ((x[:, None] - plain.centers) ** 2).sum(2).min(1).mean() > 1


def test_replays_and_restarts_change_nothing(spark, tmp_path):
    df, _ = cloud(spark)
    start = np.array([[0.0, 0.0], [900.0, 900.0], [4.0, 4.0]])
    whole = online.StreamingCodebook(spark, start, f"{tmp_path}/a", decay=0.3)
    for k in range(4):
        whole.update(df.where(F.col("vec_id") % 4 == k), k)
    cut = online.StreamingCodebook(spark, start, f"{tmp_path}/b", decay=0.3)
    for k in (0, 0, 1):
        cut.update(df.where(F.col("vec_id") % 4 == k).repartition(3), k)
    again = online.StreamingCodebook(spark, start, f"{tmp_path}/b", decay=0.3)
    for k in (1, 2, 2, 3, 0):
        again.update(df.where(F.col("vec_id") % 4 == k), k)
    assert np.allclose(whole.centers, again.centers) and np.allclose(whole.size, again.size) and whole.revived == again.revived
    with pytest.raises(ValueError, match="comes after"):
        again.update(df, 9)


def test_a_codebook_follows_a_stream(spark, tmp_path):
    df, x = cloud(spark)
    folder = f"{tmp_path}/in"
    source = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/slice-*")
    for k in range(3):
        df.where(F.col("vec_id") % 3 == k).coalesce(1).write.parquet(f"{folder}/slice-{k}")
        book = online.StreamingCodebook(spark, np.array([[0.0, 0.0], [900.0, 900.0], [4.0, 4.0]]), f"{tmp_path}/state", decay=0.3)
        book.follow(source(), f"{tmp_path}/checkpoint")
        assert book.last == k
    assert book.revived >= 1 and np.isfinite(book.centers).all()


def test_the_codebook_query_revives_codes(spark):
    rows = registry.queries()["streaming_codebook"](spark, SF).collect()
    assert len(rows) == 7 and rows[0]["revived"] >= 2 and all(max(map(abs, r["center"])) < 100 for r in rows)


# --- queries -----------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", ["causal_stream"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    columns = sorted(want.columns)
    got = registry.queries()[name](spark, SF)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.project(", ".join(columns)).fetchall()) != []
