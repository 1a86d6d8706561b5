"""Queries that sample, apportion and permute by hashes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import score
from ..operators import sampling
from ..registry import query
from ..sources.tables import MANIFEST, manifest, table


@query("WITH n AS (SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1), e AS (SELECT *, floor(n * 101 / sum(n) OVER ()) AS base, round(n * 101 / sum(n) OVER () - floor(n * 101 / sum(n) OVER ()), 9) AS rest FROM n), p AS (SELECT *, row_number() OVER (ORDER BY rest DESC, r_name) AS place, 101 - sum(base) OVER () AS leftover FROM e) SELECT r_name, n, (base + CASE WHEN place <= leftover THEN 1 ELSE 0 END)::BIGINT AS quota FROM p")
def largest_remainder(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    sizes = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))
    return sampling.largest_remainder(sizes, "r_name", "n", 101)


@query("WITH n AS (SELECT c_nationkey AS k, count(*) AS cap FROM customer GROUP BY 1), s AS (SELECT k, unnest(range(1, least(cap, 90) + 1)) AS level FROM n), t AS (SELECT k FROM s ORDER BY level, sha256('fill|' || k::VARCHAR) LIMIT 90), q AS (SELECT k, count(*) AS quota FROM t GROUP BY 1) SELECT k, cap, coalesce(quota, 0) AS quota FROM n LEFT JOIN q USING (k)")
def quota_water_fill(spark, sf_dir):
    cap = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("cap"))
    return sampling.water_fill(cap, "k", "cap", 90, "fill")


@query(f"WITH {MANIFEST}, s AS (SELECT *, row_number() OVER (PARTITION BY institution_id, scene_id ORDER BY sha256('pick|' || episode_id::VARCHAR)) AS g, sha256('pick|' || episode_id::VARCHAR) AS score FROM manifest), r AS (SELECT institution_id, scene_id, episode_id, row_number() OVER (PARTITION BY institution_id ORDER BY score) AS rank FROM s WHERE g = 1) SELECT * FROM r WHERE rank <= 4")
def scene_distinct_quota(spark, sf_dir):
    rows = manifest(spark, sf_dir).withColumn("score", score("pick", F.col("episode_id")))
    return sampling.diverse(rows, ["institution_id"], "scene_id", 4, "score").select("institution_id", "scene_id", "episode_id", "rank")


@query("WITH s AS (SELECT DISTINCT o_custkey AS scene_id FROM orders), r AS (SELECT scene_id, row_number() OVER (ORDER BY sha256('nest|' || scene_id::VARCHAR)) AS k, count(*) OVER () AS n FROM s) SELECT scene_id FROM r WHERE k <= ceil(round(0.25 * n, 9))")
def nested_scene_subset(spark, sf_dir):
    return sampling.nested_subset(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scene_id")), "scene_id", 0.25, "nest")


@query("SELECT o_orderkey, sha256('eval|' || o_orderkey::VARCHAR) AS score FROM orders ORDER BY score LIMIT 100")
def fixed_eval_subset(spark, sf_dir):
    return sampling.hash_sample(table(spark, sf_dir, "orders").select("o_orderkey"), 100, "o_orderkey", "eval")


@query("WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY sha256('res|' || event_id::VARCHAR)) AS rank FROM events) SELECT * FROM r WHERE rank <= 10")
def reservoir_hash_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "event_id").withColumn("score", score("res", F.col("event_id")))
    return sampling.first_per_group(rows, ["event_type"], 10, "score").select("event_type", "event_id", "rank")


@query("WITH p AS (SELECT event_type, user_id, event_id, count(*) OVER (PARTITION BY event_type, user_id) AS size FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY size DESC, sha256('perm|' || user_id::VARCHAR), sha256('perm|' || event_id::VARCHAR)) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n, max(size) OVER (PARTITION BY event_type) AS shift FROM p) SELECT a.event_type, a.user_id, a.event_id, b.event_id AS donor, b.user_id AS donor_parent FROM o a JOIN o b ON a.event_type = b.event_type AND (a.pos + a.shift) % a.n = b.pos")
def action_permutation(spark, sf_dir):
    return sampling.derangement(table(spark, sf_dir, "events"), ["event_type"], "user_id", "event_id", "perm")


@query(f"WITH {MANIFEST}, n AS (SELECT institution_id, task, count(*) AS n FROM manifest GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY institution_id ORDER BY n DESC, task) AS k FROM n) SELECT institution_id, task, n FROM r WHERE k = 1")
def modal_task(spark, sf_dir):
    """Each institution's commonest task, ties to the lowest name."""
    n = manifest(spark, sf_dir).groupBy("institution_id", "task").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("institution_id").orderBy(F.desc("n"), "task"))).where("k = 1").drop("k")


@query()
def shard_balance(spark, sf_dir):
    """Longest-first assignment of shards (nations) to four ranks by bytes (order value)."""
    sizes = {r[0]: int(r[1]) for r in manifest(spark, sf_dir).groupBy("building_id").agg(F.sum("price")).collect()}  # a row a shard
    ranks = sampling.longest_first(sizes, 4)
    return spark.createDataFrame([(k, sizes[k], b) for k, b in sorted(ranks.items())], "shard string, bytes long, rank int")


@query()
def shard_cover(spark, sf_dir):
    """Shards that meet a quota of episodes in each institution at little cost."""
    cells = [(r[0], r[1], r[2]) for r in manifest(spark, sf_dir).groupBy("building_id", "institution_id").count().collect()]  # shards x cells
    total: dict[str, int] = {}
    for _, cell, n in cells:
        total[cell] = total.get(cell, 0) + n
    chosen = sampling.greedy_cover(cells, {c: n // 3 for c, n in total.items()}, {s: n for s, _, n in cells})
    return spark.createDataFrame([(k, s) for k, s in enumerate(chosen)], "place int, shard string")
