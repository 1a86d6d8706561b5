"""Queries that fit codebooks and readouts, resample and decide."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import decode_angles, decode_mixed, direction, encode_angles, encode_mixed, joint_key, prefix_key
from ..operators import clustering, gates, metrics, readouts, sampling
from ..registry import query
from ..sources.tables import TICKS, table, ticks
from .series import _CODED, SPLIT_SQL, _coded


def _whole_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")


def _fixed_centers(vectors, last: bool = False) -> list[list[float]]:
    """The first, or the last, vector of each label: a codebook of ten."""
    pick = F.max_by if last else F.min_by
    rows = vectors.groupBy("label").agg(pick("x", "vec_id").alias("x")).orderBy("label").collect()
    return [list(r["x"]) for r in rows]


_LAST = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), c AS (SELECT row_number() OVER (ORDER BY label) - 1 AS k, arg_max(x, vec_id) AS x FROM v GROUP BY label)"


@query(f"WITH {_LAST}, d AS (SELECT vec_id, k, list_distance(e.x, c.x) ** 2 AS d FROM v e CROSS JOIN c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS n FROM d) SELECT vec_id, k AS code, round(d, 6) AS distance FROM r WHERE n = 1")
def assign_nearest_fixed(spark, sf_dir):
    """Codes of whole vectors under the last vector of each label; ``assign_nearest_whole`` has those under the first."""
    return _assigned(_whole_vectors(spark, sf_dir), last=True)


def _assigned(vectors, last=False):
    out = clustering.assign_nearest(vectors, "x", _fixed_centers(vectors, last))
    return out.select("vec_id", F.col("code").cast("long").alias("code"), F.round("distance", 6).alias("distance"))


@query(f"WITH {_LAST}, d AS (SELECT vec_id, k, e.x AS x, c.x AS y, list_distance(e.x, c.x) AS d FROM v e CROSS JOIN c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS n FROM d), e AS (SELECT vec_id, k AS c1, [z[1] - z[2] for z in list_zip(x, y)] AS x FROM r WHERE n = 1), d2 AS (SELECT vec_id, c1, k, list_distance(e.x, [0.5 * z for z in c.x]::DOUBLE[]) AS d FROM e CROSS JOIN c), r2 AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS n FROM d2) SELECT vec_id, c1, k AS c2, c1 * 10 + k AS prefix, c1 + k * 10 AS joint FROM r2 WHERE n = 1")
def rq_encode_fixed(spark, sf_dir):
    """Two levels of residual codes of whole vectors under the last vector of each label; the second codebook is half the first."""
    return _residual_codes(_whole_vectors(spark, sf_dir), last=True)


def _residual_codes(vectors, last=False):
    centers = _fixed_centers(vectors, last)
    first = clustering.assign_nearest(vectors, "x", centers, "c1")
    rest = clustering.residual(first, "x", "c1", centers)
    out = clustering.assign_nearest(rest, "x", [[0.5 * v for v in c] for c in centers], "c2")
    codes = F.array(F.col("c1").cast("long"), F.col("c2").cast("long"))
    return out.select("vec_id", F.col("c1").cast("long").alias("c1"), F.col("c2").cast("long").alias("c2"), prefix_key(codes, 10, 2).alias("prefix"), joint_key(codes, 10).alias("joint"))


_WHOLE = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), c AS (SELECT row_number() OVER (ORDER BY label) - 1 AS k, arg_min(x, vec_id) AS x FROM v GROUP BY label)"


@query(f"WITH {_WHOLE}, d AS (SELECT vec_id, k, list_distance(e.x, c.x) ** 2 AS d FROM v e CROSS JOIN c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS n FROM d) SELECT vec_id, k AS code, round(d, 6) AS distance FROM r WHERE n = 1")
def assign_nearest_whole(spark, sf_dir):
    return _assigned(_whole_vectors(spark, sf_dir))


@query(f"WITH {_WHOLE}, d AS (SELECT vec_id, k, e.x AS x, c.x AS y, list_distance(e.x, c.x) AS d FROM v e CROSS JOIN c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS n FROM d), e AS (SELECT vec_id, k AS c1, [z[1] - z[2] for z in list_zip(x, y)] AS x FROM r WHERE n = 1), d2 AS (SELECT vec_id, c1, k, list_distance(e.x, [0.5 * z for z in c.x]::DOUBLE[]) AS d FROM e CROSS JOIN c), r2 AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS n FROM d2) SELECT vec_id, c1, k AS c2, c1 * 10 + k AS prefix, c1 + k * 10 AS joint FROM r2 WHERE n = 1")
def rq_encode_whole(spark, sf_dir):
    """Two levels of residual codes of whole vectors; the second codebook is half the first."""
    return _residual_codes(_whole_vectors(spark, sf_dir))


@query("SELECT p_partkey, (p_size % 3) * 20 + (p_partkey % 5) * 4 + p_partkey % 4 AS key, (p_size % 3)::BIGINT AS a, p_partkey % 5 AS b, p_partkey % 4 AS c FROM part")
def prefix_encode_decode(spark, sf_dir):
    """Codes of unlike radices to one key and back."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.array((F.col("p_size") % 3).cast("long"), F.col("p_partkey") % 5, F.col("p_partkey") % 4).alias("v"))
    keyed = p.select("p_partkey", encode_mixed(F.col("v"), [3, 5, 4]).alias("key"))
    back = decode_mixed(F.col("key"), [3, 5, 4])
    return keyed.select("p_partkey", "key", *(F.get(back, F.lit(k)).alias(n) for k, n in enumerate("abc")))


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 5) AS a, round(embedding[2]::DOUBLE, 5) AS b FROM embeddings WHERE abs(embedding[1]) < 3 AND abs(embedding[2]) < 3")
def euler_roundtrip(spark, sf_dir):
    """Angles to sines and cosines and back are the same angles."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 2).cast("array<double>").alias("v")).where(F.forall("v", lambda x: F.abs(x) < 3))
    back = decode_angles(encode_angles(F.col("v")), 2)
    return e.select("vec_id", F.round(F.get(back, F.lit(0)), 5).alias("a"), F.round(F.get(back, F.lit(1)), 5).alias("b"))


@query("WITH v AS (SELECT vec_id, embedding[1:3]::DOUBLE[] AS v FROM embeddings), a AS (SELECT *, [abs(v[1]), abs(v[2]), abs(v[3])] AS s FROM v), k AS (SELECT *, list_position(s, list_max(s)) AS axis FROM a) SELECT CASE WHEN sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]) <= 0.1 THEN 0 ELSE 1 + 2 * (axis - 1) + CASE WHEN v[axis] >= 0 THEN 1 ELSE 0 END END AS direction, count(*) AS n FROM k GROUP BY 1")
def direction_labels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(direction(F.slice("embedding", 1, 3).cast("array<double>"), 0.1).alias("direction"))
    return e.groupBy("direction").agg(F.count(F.lit(1)).alias("n"))


@query("WITH x AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT dim, count(*) AS n, round(avg(x), 5) AS mean, round(greatest(stddev_pop(x), 1e-6), 5) AS std FROM x GROUP BY 1")
def vector_moments(spark, sf_dir):
    out = metrics.vector_moments(table(spark, sf_dir, "embeddings"), "embedding")
    return out.select(F.col("dim").cast("long").alias("dim"), "n", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@query()
def kmeans_lloyd(spark, sf_dir):
    """Inertia by round of Lloyd's iterations with eight centers."""
    _, curve = clustering.lloyd(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")), "x", "vec_id", 8)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(curve)], "round int, inertia double")


@query()
def rq_train(spark, sf_dir):
    """Codes of a trained two-level residual codebook and what they leave over."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    levels = clustering.train_residual_quantizer(rows, "x", "vec_id", 8, 2, rounds=10)
    return clustering.assign_batches(rows, "x", levels, ["vec_id"])


@query()
def effective_rank(spark, sf_dir):
    ratio, n = clustering.effective_rank(table(spark, sf_dir, "embeddings"), "embedding")
    return spark.createDataFrame([(ratio, n)], "effective_rank double, rank95 int")


@query()
def additive_ridge(spark, sf_dir):
    """Held-out error of an additive one-hot ridge on two codes."""
    rows = _coded(spark, sf_dir)
    model = readouts.additive_ridge(rows.where("split = 'train'"), ["c1", "c2"], "target", 8.0)
    out = readouts.predict_additive(rows, model)
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("target") - F.col("prediction")) ** 2).alias("mse"), F.avg(F.col("all_seen").cast("double")).alias("seen"))


@query(
    f"WITH {_CODED}, t AS (SELECT value AS a, tick::DOUBLE AS b, target AS y FROM coded WHERE split = 'train'), "
    "m AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, avg(a * a) - avg(a) * avg(a) AS aa, avg(b * b) - avg(b) * avg(b) AS bb, avg(a * b) - avg(a) * avg(b) AS ab, avg(a * y) - avg(a) * avg(y) AS ay, avg(b * y) - avg(b) * avg(y) AS bb_y FROM t), "
    "u AS (SELECT *, 1 + 1.0::DOUBLE / n AS d, ab / sqrt(aa * bb) AS r, ay / sqrt(aa) AS ca, bb_y / sqrt(bb) AS cb FROM m), w AS (SELECT *, (d * ca - r * cb) / (d * d - r * r) / sqrt(aa) AS wa, (d * cb - r * ca) / (d * d - r * r) / sqrt(bb) AS wb FROM u) "
    "SELECT round(my - ma * wa - mb * wb, 5) AS intercept, round(wa, 6) + 0.0 AS value, round(wb, 6) + 0.0 AS tick FROM w"
)
def continuous_ridge(spark, sf_dir):
    """AGG-15, REG-06: a ridge on two standardised columns, which SQL solves by Cramer's rule."""
    rows = _coded(spark, sf_dir).withColumn("t", F.col("tick").cast("double"))
    w = readouts.continuous_ridge(rows.where("split = 'train'"), ["value", "t"], "target", 1.0)
    return spark.createDataFrame([(round(float(w[0]), 5), round(float(w[1]), 6) + 0.0, round(float(w[2]), 6) + 0.0)], "intercept double, value double, tick double")


_DELTA = f"WITH {TICKS}, d AS (SELECT user_id, round(avg(CASE WHEN tick % 2 = 0 THEN value END) - avg(CASE WHEN tick % 2 = 1 THEN value END), 6) AS d FROM ticks GROUP BY 1 HAVING count(*) >= 2)"


def _deltas(spark, sf_dir):
    even = F.avg(F.when(F.col("tick") % 2 == 0, F.col("value")))
    odd = F.avg(F.when(F.col("tick") % 2 == 1, F.col("value")))
    return ticks(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("k"), F.round(even - odd, 6).alias("d")).where("k >= 2").select("user_id", "d")


@query(_DELTA + ", p AS (SELECT d, row_number() OVER (ORDER BY user_id) - 1 AS pos, count(*) OVER () AS n FROM d), s AS (SELECT b.i AS draw, concat('0x', substr(sha256('boot|' || b.i::VARCHAR || '|' || q.j::VARCHAR), 1, 12))::BIGINT % (SELECT count(*) FROM d) AS pos FROM range(200) b(i), (SELECT unnest(range(0, (SELECT count(*) FROM d))) AS j) q), m AS (SELECT draw, avg(d) AS m FROM s JOIN p USING (pos) GROUP BY 1) SELECT (SELECT count(*) FROM d) AS n, (SELECT round(avg(d), 5) FROM d) AS mean, (SELECT round(avg(CASE WHEN d < 0 THEN 1.0 ELSE 0.0 END), 6) FROM d) AS wins, round(quantile_cont(m, 0.025), 5) AS low, round(quantile_cont(m, 0.975), 5) AS high FROM m")
def paired_bootstrap(spark, sf_dir):
    out = gates.paired_bootstrap(_deltas(spark, sf_dir), "user_id", "d", 200, "boot")
    return out.select("n", F.round("mean", 5).alias("mean"), F.round("wins", 6).alias("wins"), F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


_GATES = f"WITH {TICKS}, s AS (SELECT *, {SPLIT_SQL} AS split FROM ticks), r AS (SELECT event_type, split, count(*) AS n, avg(value) - 50 AS mean, max(value) - 60 AS high FROM s GROUP BY 1, 2)"


def _gate_rows(spark, sf_dir):
    rows = sampling.hash_split(ticks(spark, sf_dir), "user_id", "split")
    return rows.groupBy("event_type", "split").agg(F.count(F.lit(1)).alias("n"), (F.avg("value") - 50).alias("mean"), (F.max("value") - 60).alias("high"))


@query(_GATES + " SELECT event_type, CASE WHEN min(n) < 30 THEN 'invalid' WHEN max(high) < 0 THEN 'pass' WHEN max(mean) >= 0 THEN 'fail' ELSE 'inconclusive' END AS verdict FROM r GROUP BY 1")
def gate_verdict(spark, sf_dir):
    return gates.verdict(_gate_rows(spark, sf_dir), ["event_type"])


@query(_GATES + ", v AS (SELECT event_type, CASE WHEN min(n) < 30 THEN 'invalid' WHEN max(high) < 0 THEN 'pass' WHEN max(mean) >= 0 THEN 'fail' ELSE 'inconclusive' END AS status, event_type < 'm' AS blocker FROM r GROUP BY 1) SELECT CASE WHEN bool_or(status = 'fail' AND blocker) THEN 'not_ready' WHEN bool_or(status = 'fail') THEN 'conditional_pass' ELSE 'pass' END AS decision, count(*) FILTER (WHERE status = 'fail') AS failed FROM v")
def overall_decision(spark, sf_dir):
    v = gates.verdict(_gate_rows(spark, sf_dir), ["event_type"]).select(F.col("verdict").alias("status"), (F.col("event_type") < "m").alias("blocker"))
    return gates.overall(v)


@query(_GATES + " SELECT event_type, count(mean) AS n, round(avg(mean), 6) AS mean, round(stddev_samp(mean), 6) AS std, bool_and(mean < 0) AS all_negative FROM r GROUP BY 1")
def seed_summary(spark, sf_dir):
    out = gates.seed_summary(_gate_rows(spark, sf_dir), ["event_type"], "mean")
    return out.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "all_negative")


@query("WITH m AS (SELECT p_brand, p_size % 5 AS k, avg(p_retailprice) AS v FROM part GROUP BY 1, 2) SELECT p_brand, count(*) AS runs, round(min(v), 6) AS best, round(avg(v), 6) AS mean FROM m GROUP BY 1")
def capacity_summary(spark, sf_dir):
    m = table(spark, sf_dir, "part").groupBy("p_brand", (F.col("p_size") % 5).alias("k")).agg(F.avg("p_retailprice").alias("v"))
    return m.groupBy("p_brand").agg(F.count(F.lit(1)).alias("runs"), F.round(F.min("v"), 6).alias("best"), F.round(F.avg("v"), 6).alias("mean"))


@query("WITH m AS (SELECT p_brand, p_size AS rounds, round(avg(p_retailprice), 6) AS v FROM part GROUP BY 1, 2), b AS (SELECT *, min(v) OVER (PARTITION BY p_brand) AS best FROM m), r AS (SELECT p_brand, rounds, v, row_number() OVER (PARTITION BY p_brand ORDER BY rounds) AS k FROM b WHERE v <= best * 1.005) SELECT p_brand, rounds, v FROM r WHERE k = 1")
def early_stop_recommendation(spark, sf_dir):
    """The fewest rounds within half a percent of the best."""
    from pyspark.sql import Window

    m = table(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").alias("rounds")).agg(F.round(F.avg("p_retailprice"), 6).alias("v"))
    near = m.withColumn("best", F.min("v").over(Window.partitionBy("p_brand"))).where("v <= best * 1.005")
    return sampling.first_per_group(near, ["p_brand"], 1, "rounds").select("p_brand", "rounds", "v")
