"""Queries that run a stream over a table that arrives in slices, late rows included, and return what it wrote."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..registry import query
from ..sources import commits
from ..sources.tables import TICKS, table, ticks
from ..streaming import causal, online

_GAP, _STRIDE, _SLICES = 43_200, 2, 5


def arriving(rows, folder: str, slices: int, late_seconds: int):
    """Deal ``rows`` over slices in order of their time, each row up to ``late_seconds`` late by a hash; yield the stream over all that has come after each slice is written.

    Rows are dealt in one pass and a slice has as many files as tasks wrote, so a run takes up a slice as one batch."""
    spark = rows.sparkSession
    rows = commits.stored(rows, "arriving")
    low, high = rows.agg(F.min("sec"), F.max("sec")).first()  # two numbers
    late = F.pmod(F.xxhash64("event_id"), F.lit(late_seconds))
    width = ((high or 0) - (low or 0) + late_seconds) / slices + 1
    dealt = rows.withColumn("slice", F.floor((F.col("sec") - F.lit(low or 0) + late) / F.lit(width)).cast("int"))
    for k in range(slices):
        # an empty slice leaves an empty file
        dealt.where(F.col("slice") == k).drop("slice").write.parquet(f"{folder}/slice-{k:03d}")
        yield spark.readStream.schema(rows.schema).parquet(f"{folder}/slice-*")


@query(
    f"WITH {TICKS}, l AS (SELECT user_id, tick, sec, lag(value, 4) OVER w AS x0, lag(value, 2) OVER w AS x1, value AS x2, lag(sec, 4) OVER w AS t0, lag(sec, 2) OVER w AS t1 FROM ticks WINDOW w AS (PARTITION BY user_id ORDER BY tick)) "
    f"SELECT user_id, tick, x0, x1, x2 FROM l WHERE tick >= 4 AND t1 - t0 <= {_GAP} AND sec - t1 <= {_GAP}"
)
def causal_stream(spark, sf_dir):
    """WIN-01, STR-01: causal triples of stride two from a stream whose rows come up to six hours late."""
    folder = commits.scratch(spark, "causal-stream")
    rows = ticks(spark, sf_dir).select("event_id", "user_id", "tick", "sec", "value", F.timestamp_micros((F.col("sec") * 1e6).cast("long")).alias("ts"))
    empty = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(empty)
    spark.conf.set(empty, "false")  # batches without rows only clear state, and the next slice's batch does so too
    try:
        for stream in arriving(rows, f"{folder}/in", _SLICES, 6 * 3600):
            found = causal.run_to_end(causal.causal_triples(stream, _STRIDE, "value", float(_GAP), "12 hours"), f"{folder}/out", f"{folder}/checkpoint")
    finally:
        spark.conf.set(empty, before)
    return found.select("user_id", "tick", "x0", "x1", "x2")


@query()
def streaming_codebook(spark, sf_dir):
    """CLU-27: a codebook that follows a stream of vectors; two of its codes start where no vector is and are revived."""
    folder = commits.scratch(spark, "streaming-codebook")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.pmod(F.xxhash64("vec_id"), F.lit(_SLICES)).cast("int").alias("slice"))
    for k in range(_SLICES):
        rows.where(F.col("slice") == k).drop("slice").write.parquet(f"{folder}/in/slice-{k:03d}")
    stream = spark.readStream.schema("vec_id long, x array<double>").option("maxFilesPerTrigger", 4).parquet(f"{folder}/in/slice-*")
    first = rows.groupBy("slice").agg(F.min_by("x", "vec_id").alias("x")).orderBy("slice").collect()  # a row a slice
    away = [[1e3 * (k + 1)] * len(first[0]["x"]) for k in range(2)] if first else []
    book = online.StreamingCodebook(spark, np.array([r["x"] for r in first] + away), f"{folder}/state", decay=0.5)
    book.follow(stream, f"{folder}/checkpoint")
    rows = [(k, c.tolist(), float(n), book.revived) for k, (c, n) in enumerate(zip(book.centers, book.size, strict=True))]
    return spark.createDataFrame(rows, "code int, center array<double>, size double, revived int")
