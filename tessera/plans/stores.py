"""Queries that write tables into record files, parts and segment stores, and read them back through manifests and indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources import commits, contracts, exports, records, segments
from ..sources.tables import TICKS, table, ticks


def _episodes(spark, sf_dir):
    """A row a user: lists of event ids, cents and types by tick."""
    step = F.struct("tick", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"), F.col("value").cast("float").alias("value"), "event_type")
    rows = ticks(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(step)).alias("s"))
    return rows.select("user_id", F.size("s").cast("long").alias("num_steps"), F.col("s.event_id").alias("event_id"), F.col("s.cents").alias("cents"), F.col("s.value").alias("value"), F.col("s.event_type").alias("event_type"))


@query(
    f"WITH {TICKS}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS num_steps FROM ticks) "
    "SELECT user_id, count(*) AS steps, sum(event_id * (tick + 1))::BIGINT AS ids, sum(round(value * 100)::BIGINT)::BIGINT AS cents, round(max(value::FLOAT)::DOUBLE, 3) AS largest, string_agg(event_type, ',' ORDER BY tick) AS types "
    "FROM n WHERE num_steps % 2 = 0 GROUP BY 1"
)
def record_files(spark, sf_dir):
    """SRC-14 to SRC-18: episodes are written as record files, their index joined with a choice of episodes makes the manifest, and only its positions are read and decoded."""
    path = commits.scratch(spark, "record-files")
    rows = _episodes(spark, sf_dir).withColumn("shard", F.format_string("episodes-%04d", F.pmod(F.xxhash64("user_id"), F.lit(13)))).withColumn("steps/user", F.col("user_id"))
    records.write_records(rows, path, "shard", ["user_id", "num_steps"], ["user_id"], unique="user_id")
    manifest = commits.scratch(spark, "manifest")
    records.written_index(spark, path).where("num_steps % 2 = 0").select("shard", "position", "bytes").write.parquet(manifest)
    read = records.read_records(spark, f"{path}/data", manifest, "position long, `steps/user` array<long>, event_id array<long>, cents array<long>, value array<float>, event_type array<string>")
    weighted = F.aggregate(F.transform("event_id", lambda x, k: x * (k + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return read.select(
        F.col("steps/user")[0].alias("user_id"), F.size("event_id").cast("long").alias("steps"), weighted.alias("ids"), F.aggregate("cents", F.lit(0).cast("long"), lambda a, x: a + x).alias("cents"),
        F.round(F.array_max("value").cast("double"), 3).alias("largest"), F.array_join("event_type", ",").alias("types"),
    )


@query(
    "SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS rows, sum(l_quantity)::BIGINT AS quantity, sum(l_orderkey)::BIGINT AS orders, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1"
)
def part_export(spark, sf_dir):
    """SNK-34, SNK-35, STR-10 to STR-13: a run exports the parts of some months, a second one only the rest; the whole is verified and read back."""
    path = commits.scratch(spark, "parts")
    rows = table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_quantity", "l_orderkey", "l_suppkey")
    sources = rows.groupBy(F.col("month").alias("part")).agg(F.count(F.lit(1)).alias("source"))
    exports.export(rows.where("month < '1995'"), path, "month", sources)
    exports.export(rows, path, "month", sources)
    whole = exports.finalize(rows, path, "month", {"table": "lineitem"})
    return whole.groupBy("month").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").cast("long").alias("quantity"), F.sum("l_orderkey").alias("orders"), F.count_distinct("l_suppkey").alias("suppliers"))


@query(
    f"WITH {TICKS}, late AS (SELECT user_id FROM ticks GROUP BY 1 HAVING max(value) > 2 * avg(value) AND user_id % 2 = 1) "
    "SELECT user_id, tick, event_id, event_type, value FROM ticks SEMI JOIN late USING (user_id)"
)
def sidecar_lookup(spark, sf_dir):
    """SNK-29 to SNK-31, SRC-16, SRC-29, JON-14: segments are stored once, then those of odd users with a far outlier are found by the index and read by range."""
    path = commits.scratch(spark, "segments")
    rows = ticks(spark, sf_dir)
    step = F.struct("tick", "event_id", "event_type", "value")
    digest = segments.write_segments(rows.groupBy("user_id").agg(F.array_sort(F.collect_list(step)).alias("steps")), path, "user_id", {"of": "events"}, shards=24)
    wanted = rows.groupBy("user_id").agg(F.max("value").alias("most"), F.avg("value").alias("mean")).where("most > 2 * mean AND user_id % 2 = 1").select("user_id")
    return segments.lookup(spark, path, wanted, digest).select("user_id", F.inline("steps"))


@query(
    "WITH h AS (SELECT sha256('10:l_discount=' || coalesce(strlen(l_discount::VARCHAR) || ':' || l_discount::VARCHAR, '-') || '10:l_orderkey=' || coalesce(strlen(l_orderkey::VARCHAR) || ':' || l_orderkey::VARCHAR, '-') || '12:l_returnflag=' || coalesce(strlen(l_returnflag) || ':' || l_returnflag, '-')) AS d FROM lineitem) "
    "SELECT count(*) AS rows, sum(concat('0x', substr(d, 1, 7))::BIGINT)::BIGINT AS low, sum(concat('0x', substr(d, 8, 7))::BIGINT)::BIGINT AS high FROM h"
)
def content_fingerprint(spark, sf_dir):
    """SNK-04: the fingerprint of a table's content, nulls and separators told apart."""
    return contracts.fingerprint(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_discount"))
