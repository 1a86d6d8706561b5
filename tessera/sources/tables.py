"""Readers of the test tables and the episode views made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, plain or gzipped; a bad line stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """All Parquet files below a folder, their schemas merged."""
    return spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(root)


def seconds(ts: str) -> "F.Column":
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})") / F.lit(1e6)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as episodes: one row a tick of a user, in order of time, then id."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", seconds("ts").alias("sec"), (F.row_number().over(order) - 1).cast("long").alias("tick"))


#: The same view in SQL.
TICKS = "ticks AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS tick FROM events)"


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as episodes of scenes (customers) in buildings (nations) of institutions (regions)."""
    o, c, n, r = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation", "region"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return joined.select(F.col("o_orderkey").alias("episode_id"), F.col("c_custkey").alias("scene_id"), F.col("n_name").alias("building_id"), F.col("r_name").alias("institution_id"), F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


MANIFEST = "manifest AS (SELECT o_orderkey AS episode_id, c_custkey AS scene_id, n_name AS building_id, r_name AS institution_id, o_orderpriority AS task, o_orderstatus AS status, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
