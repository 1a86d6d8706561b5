"""Queries over event series: descriptors, windows, usage, transitions, association."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import above, score, split_of, unit_interval
from ..operators import metrics, orders, sampling, series
from ..registry import query
from ..sources import commits
from ..sources.tables import TICKS, table, ticks


def _r(*columns: str, digits: int = 6) -> dict:
    return {c: F.round(c, digits) for c in columns}


_U = "(concat('0x', substr(sha256({0}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"
_SPLIT = "CASE WHEN {0} < 0.8 THEN 'train' WHEN {0} < 0.9 THEN 'val' ELSE 'test' END"
SPLIT_SQL = _SPLIT.format(_U.format("'split|' || user_id::VARCHAR"))
CADENCE = f"WITH {TICKS}, g AS (SELECT *, sec - lag(sec) OVER (PARTITION BY user_id ORDER BY tick) AS gap FROM ticks), c AS (SELECT user_id, quantile_disc(gap, 0.5) AS cadence FROM g GROUP BY 1)"


def _triple_sql(s: int) -> str:
    lag = lambda c, n: f"lag({c}, {n}) OVER (PARTITION BY user_id ORDER BY tick)"
    return f"""{CADENCE}, l AS (SELECT user_id, tick, value AS x2, {lag('value', s)} AS x1, {lag('value', 2 * s)} AS x0, sec AS t2, {lag('sec', s)} AS t1, {lag('sec', 2 * s)} AS t0,
 value >= 0 AS v2, {lag('value >= 0', s)} AS v1, {lag('value >= 0', 2 * s)} AS v0 FROM ticks)
SELECT user_id, tick, x0, x1, x2 FROM l JOIN c USING (user_id) WHERE tick >= {2 * s} AND v0 AND v1 AND v2 AND t1 - t0 <= cadence * {s} * 1.5 AND t2 - t1 <= cadence * {s} * 1.5"""


def _triple(s: int):
    def f(spark, sf_dir):
        return series.causal_triples(ticks(spark, sf_dir), s, "value", valid=F.col("value") >= 0).select("user_id", "tick", "x0", "x1", "x2")

    f.__name__ = f"causal_triple_q{s}"
    return query(_triple_sql(s))(f)


causal_triple_q2, causal_triple_q3, causal_triple_q5 = (_triple(s) for s in (2, 3, 5))


@query(f"{CADENCE}, a AS (SELECT user_id, tick FROM ticks WHERE tick >= 10), f AS (SELECT user_id, max(tick) AS last FROM ticks GROUP BY 1) SELECT a.user_id, count(*) AS aligned FROM a JOIN f USING (user_id) WHERE tick + 5 <= last GROUP BY 1")
def aligned_family_ticks(spark, sf_dir):
    """Ticks at which all three strides have their history and the longest its future."""
    order = Window.partitionBy("user_id").orderBy("tick")
    rows = ticks(spark, sf_dir).withColumns({"h": F.lag("tick", 10).over(order), "f": F.lead("tick", 5).over(order)})
    return rows.where("h IS NOT NULL AND f IS NOT NULL").groupBy("user_id").agg(F.count(F.lit(1)).alias("aligned"))


@query(f"WITH {TICKS}, s AS (SELECT *, {SPLIT_SQL} AS split FROM ticks), m AS (SELECT event_type, avg(value) AS mean, greatest(stddev_pop(value), 1e-6) AS std FROM s WHERE split = 'train' GROUP BY 1) SELECT event_type, split, count(*) AS n, round(avg((value - mean) / std), 4) + 0.0 AS z_mean, round(avg(((value - mean) / std) * ((value - mean) / std)), 6) AS z_square FROM s JOIN m USING (event_type) GROUP BY 1, 2")
def zscore_apply(spark, sf_dir):
    """Values of every split under the moments of train alone."""
    rows = sampling.hash_split(ticks(spark, sf_dir), "user_id", "split")
    m = metrics.moments(rows.where("split = 'train'"), "value", ["event_type"]).drop("n")
    z = rows.join(F.broadcast(m), "event_type").withColumn("z", (F.col("value") - F.col("mean")) / F.col("std"))  # a row an event type
    return z.groupBy("event_type", "split").agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg("z"), 4) + F.lit(0.0)).alias("z_mean"), F.round(F.avg(F.col("z") * F.col("z")), 6).alias("z_square"))


@query(f"WITH {TICKS}, s AS (SELECT *, {SPLIT_SQL} AS split FROM ticks) SELECT split, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(greatest(stddev_pop(value), 1e-6), 6) AS std FROM s GROUP BY 1, 2")
def train_moments(spark, sf_dir):
    rows = sampling.hash_split(ticks(spark, sf_dir), "user_id", "split")
    return metrics.moments(rows, "value", ["split", "event_type"]).withColumns(_r("mean", "std"))


@query(f"WITH {TICKS}, n AS (SELECT user_id, event_type, count(*) AS n FROM ticks GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total FROM n) SELECT user_id, count(*) AS used, max(total)::BIGINT AS total, round(-sum(n / total * ln(n / total)), 6) AS entropy, round(max(n / total), 6) AS max_fraction, round(exp(-sum(n / total * ln(n / total))), 6) AS perplexity, 5 - count(*) AS dead FROM t GROUP BY 1")
def code_usage(spark, sf_dir):
    return metrics.usage(ticks(spark, sf_dir), "event_type", ["user_id"], 5).withColumns(_r("entropy", "max_fraction", "perplexity"))


@query(f"WITH {TICKS}, p AS (SELECT event_type AS cur, lag(event_type) OVER (PARTITION BY user_id ORDER BY tick) AS prev FROM ticks), n AS (SELECT prev || '>' || cur AS pair, count(*) AS n FROM p WHERE prev IS NOT NULL GROUP BY 1), t AS (SELECT n, sum(n) OVER () AS total FROM n) SELECT count(*) AS used, max(total)::BIGINT AS total, round(-sum(n / total * ln(n / total)), 6) AS entropy, round(max(n / total), 6) AS max_fraction, round(exp(-sum(n / total * ln(n / total))), 6) AS perplexity, 25 - count(*) AS dead FROM t")
def joint_usage(spark, sf_dir):
    """Usage of pairs of adjacent codes against a capacity of 25."""
    pairs = series.transitions(ticks(spark, sf_dir), "event_type").withColumn("pair", F.concat_ws(">", "prev", "cur"))
    n = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    out = n.join(F.broadcast(total), F.lit(True)).agg(F.count(F.lit(1)).alias("used"), F.max("total").alias("total"), -F.sum(p * F.log(p)), F.max(p)).toDF("used", "total", "entropy", "max_fraction")
    return out.select("used", "total", F.round("entropy", 6).alias("entropy"), F.round("max_fraction", 6).alias("max_fraction"), F.round(F.exp("entropy"), 6).alias("perplexity"), (F.lit(25) - F.col("used")).alias("dead"))


@query(f"WITH {TICKS}, p AS (SELECT user_id, event_type AS cur, lag(event_type) OVER (PARTITION BY user_id ORDER BY tick) AS prev FROM ticks) SELECT user_id, count(*) AS pairs, round(avg(CASE WHEN prev = cur THEN 1.0 ELSE 0.0 END), 6) AS same_fraction, count(DISTINCT prev || '>' || cur) AS distinct_pairs FROM p WHERE prev IS NOT NULL GROUP BY 1")
def transition_metrics(spark, sf_dir):
    rows = series.transitions(ticks(spark, sf_dir), "event_type")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg((F.col("prev") == F.col("cur")).cast("double")), 6).alias("same_fraction"), F.count_distinct(F.concat_ws(">", "prev", "cur")).alias("distinct_pairs"))


@query(f"WITH {TICKS}, r AS (SELECT event_type, event_id, user_id, value, row_number() OVER (PARTITION BY event_type ORDER BY abs(value - 50), event_id) AS rank FROM ticks) SELECT * FROM r WHERE rank <= 5")
def representatives_topk(spark, sf_dir):
    """Per code the five rows nearest to a center, by distance, then id."""
    rows = ticks(spark, sf_dir).withColumn("d", F.abs(F.col("value") - 50))
    return sampling.first_per_group(rows, ["event_type"], 5, "d", "event_id").select("event_type", "event_id", "user_id", "value", "rank")


@query(f"WITH {TICKS}, b AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY abs(value - 50), event_id) AS g FROM ticks), r AS (SELECT event_type, event_id, user_id, row_number() OVER (PARTITION BY event_type ORDER BY abs(value - 50), event_id) AS rank FROM b WHERE g = 1) SELECT * FROM r WHERE rank <= 5")
def diverse_representatives(spark, sf_dir):
    """The same with one row a user at most."""
    rows = ticks(spark, sf_dir).withColumn("d", F.abs(F.col("value") - 50))
    return sampling.diverse(rows, ["event_type"], "user_id", 5, "d", "event_id").select("event_type", "event_id", "user_id", "rank")


_BUCKET = "(user_id % 7)"


def _coded(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("tick")
    rows = ticks(spark, sf_dir).withColumns({"c1": (F.col("user_id") % 7).cast("long"), "c2": F.lag("event_type").over(order), "target": F.lead("value").over(order)})
    return sampling.hash_split(rows.where("c2 IS NOT NULL AND target IS NOT NULL"), "user_id", "split")


_CODED = f"{TICKS}, coded AS (SELECT *, {_BUCKET} AS c1, {SPLIT_SQL} AS split FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY tick) AS c2, lead(value) OVER (PARTITION BY user_id ORDER BY tick) AS target FROM ticks) WHERE c2 IS NOT NULL AND target IS NOT NULL)"
_BACKOFF = f"WITH {_CODED}, t AS (SELECT * FROM coded WHERE split = 'train'), g2 AS (SELECT c1, c2, count(*) AS n, avg(target) AS m FROM t GROUP BY 1, 2), g1 AS (SELECT c1, count(*) AS n, avg(target) AS m FROM t GROUP BY 1), g0 AS (SELECT avg(target) AS m, var_pop(target) AS v FROM t), p AS (SELECT split, target, CASE WHEN g2.n >= 20 THEN g2.m WHEN g1.n >= 20 THEN g1.m ELSE g0.m END AS prediction, CASE WHEN g2.n >= 20 THEN 2 WHEN g1.n >= 20 THEN 1 ELSE 0 END AS depth, g0.m AS base FROM coded LEFT JOIN g2 USING (c1, c2) LEFT JOIN g1 USING (c1) CROSS JOIN g0)"


@query(_BACKOFF + " SELECT split, depth, count(*) AS n, round(avg(prediction), 6) AS prediction FROM p GROUP BY 1, 2")
def conditional_mean_backoff(spark, sf_dir):
    rows = commits.stored(_coded(spark, sf_dir), "coded")
    out = metrics.mean_backoff(rows.where("split = 'train'"), rows, ["c1", "c2"], "target", 20)
    return out.groupBy("split", "depth").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("prediction"), 6).alias("prediction"))


@query(_BACKOFF + " SELECT split, count(*) AS n, round(avg((target - prediction) * (target - prediction)), 5) AS mse, round(1 - avg((target - prediction) * (target - prediction)) / greatest(avg((target - base) * (target - base)), 1e-12), 6) AS reduction FROM p GROUP BY 1")
def regression_report(spark, sf_dir):
    """Held-out error of the backed-off mean and its reduction against the global mean of train."""
    rows = commits.stored(_coded(spark, sf_dir), "coded")
    train = rows.where("split = 'train'")
    out = metrics.mean_backoff(train, rows, ["c1", "c2"], "target", 20).join(F.broadcast(train.agg(F.avg("target").alias("base"))), F.lit(True))  # one row
    square = lambda c: F.avg((F.col("target") - F.col(c)) * (F.col("target") - F.col(c)))
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(square("prediction"), 5).alias("mse"), F.round(1 - square("prediction") / F.greatest(square("base"), F.lit(1e-12)), 6).alias("reduction"))


_MAJ = f"WITH {_CODED}, t AS (SELECT * FROM coded WHERE split = 'train'), m2 AS (SELECT c1, c2, arg_min(event_type, (-n, event_type)) AS l, sum(n) AS n FROM (SELECT c1, c2, event_type, count(*) AS n FROM t GROUP BY ALL) GROUP BY 1, 2), m1 AS (SELECT c1, arg_min(event_type, (-n, event_type)) AS l, sum(n) AS n FROM (SELECT c1, event_type, count(*) AS n FROM t GROUP BY ALL) GROUP BY 1), m0 AS (SELECT arg_min(event_type, (-n, event_type)) AS l FROM (SELECT event_type, count(*) AS n FROM t GROUP BY ALL)), p AS (SELECT split, event_type, CASE WHEN m2.n >= 20 THEN m2.l WHEN m1.n >= 20 THEN m1.l ELSE m0.l END AS prediction, CASE WHEN m2.n >= 20 THEN 2 WHEN m1.n >= 20 THEN 1 ELSE 0 END AS depth FROM coded LEFT JOIN m2 USING (c1, c2) LEFT JOIN m1 USING (c1) CROSS JOIN m0)"


@query(_MAJ + " SELECT split, depth, prediction, count(*) AS n, count(*) FILTER (WHERE event_type = prediction) AS hits FROM p GROUP BY 1, 2, 3")
def majority_backoff(spark, sf_dir):
    rows = commits.stored(_coded(spark, sf_dir), "coded")
    out = metrics.majority_backoff(rows.where("split = 'train'"), rows, ["c1", "c2"], "event_type", 20)
    return out.groupBy("split", "depth", "prediction").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == F.col("prediction")).alias("hits"))


@query(_MAJ + ", e AS (SELECT * FROM p WHERE split <> 'train'), h AS (SELECT event_type AS c, count(*) AS have, count(*) FILTER (WHERE event_type = prediction) AS tp FROM e GROUP BY 1), s AS (SELECT prediction AS c, count(*) AS said FROM e GROUP BY 1) SELECT round(sum(tp) / sum(have), 6) AS accuracy, round(avg(tp / have), 6) AS balanced_accuracy, round(avg(2 * tp / (have + coalesce(said, 0))), 6) AS macro_f1 FROM h LEFT JOIN s USING (c)")
def confusion_metrics(spark, sf_dir):
    rows = commits.stored(_coded(spark, sf_dir), "coded")
    out = metrics.majority_backoff(rows.where("split = 'train'"), rows.where("split <> 'train'"), ["c1", "c2"], "event_type", 20)
    return metrics.confusion_report(out, "event_type", "prediction").withColumns(_r("accuracy", "balanced_accuracy", "macro_f1"))


def _assoc_sql(source: str, code: str, label: str, columns: str) -> str:
    return f"""WITH {source}, n AS (SELECT {code} AS c, {label} AS l, count(*)::DOUBLE AS n FROM base GROUP BY 1, 2), a AS (SELECT c, sum(n) AS a, max(n) AS top FROM n GROUP BY 1), b AS (SELECT l, sum(n) AS b FROM n GROUP BY 1), t AS (SELECT sum(n) AS t FROM n),
mi AS (SELECT sum(n / t * ln(n * t / (a * b))) AS mutual_information, sum(n * (n - 1) / 2) AS pn FROM n JOIN a USING (c) JOIN b USING (l) CROSS JOIN t), ha AS (SELECT -sum(a / t * ln(a / t)) AS code_entropy, sum(top / t) AS purity, sum(a * (a - 1) / 2) AS pa FROM a CROSS JOIN t), hb AS (SELECT -sum(b / t * ln(b / t)) AS label_entropy, max(b / t) AS majority, sum(b * (b - 1) / 2) AS pb FROM b CROSS JOIN t),
r AS (SELECT t::BIGINT AS total, *, CASE WHEN sqrt(code_entropy * label_entropy) > 1e-12 THEN mutual_information / sqrt(code_entropy * label_entropy) ELSE 0 END AS nmi, CASE WHEN majority < 1 THEN (purity - majority) / (1 - majority) ELSE 0 END AS purity_gain, (pn - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)) AS ari FROM mi CROSS JOIN ha CROSS JOIN hb CROSS JOIN t)
SELECT {columns} FROM r"""


_B = f"{TICKS}, base AS (SELECT event_type, {_BUCKET} AS bucket FROM ticks)"


def _base(spark, sf_dir):
    return ticks(spark, sf_dir).select("event_type", (F.col("user_id") % 7).alias("bucket"))


@query(_assoc_sql(_B, "event_type", "bucket", "total, round(mutual_information, 6) AS mutual_information, round(code_entropy, 6) AS code_entropy, round(label_entropy, 6) AS label_entropy, round(nmi, 6) AS nmi"))
def mutual_information(spark, sf_dir):
    columns = ("mutual_information", "code_entropy", "label_entropy", "nmi")
    return metrics.association(_base(spark, sf_dir), "event_type", "bucket").withColumns(_r(*columns)).select("total", *columns)


@query(_assoc_sql(_B, "event_type", "bucket", "round(purity, 6) AS purity, round(majority, 6) AS majority, round(purity_gain, 6) AS purity_gain"))
def concentration(spark, sf_dir):
    columns = ("purity", "majority", "purity_gain")
    return metrics.association(_base(spark, sf_dir), "event_type", "bucket").withColumns(_r(*columns)).select(*columns)


@query(_assoc_sql("base AS (SELECT label, vec_id % 7 AS bucket FROM embeddings)", "label", "bucket", "total, round(ari, 8) AS ari"))
def adjusted_rand(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", (F.col("vec_id") % 7).alias("bucket"))
    return metrics.association(rows, "label", "bucket").select("total", F.round("ari", 8).alias("ari"))


_FOLD = f"WITH {TICKS}, p AS (SELECT DISTINCT event_type, user_id FROM ticks), f AS (SELECT event_type, user_id, CASE WHEN count(*) OVER (PARTITION BY event_type) >= 2 THEN (row_number() OVER (PARTITION BY event_type ORDER BY sha256('folds|' || user_id::VARCHAR)) - 1) % 2 END AS fold FROM p)"


@query(_FOLD + " SELECT * FROM f")
def cross_parent_folds(spark, sf_dir):
    return sampling.folds(ticks(spark, sf_dir), ["event_type"], "user_id", "folds")


@query(_FOLD + f", r AS (SELECT t.event_type, {_BUCKET.replace('user_id', 't.user_id')} AS code, fold FROM ticks t JOIN f ON t.event_type = f.event_type AND t.user_id = f.user_id), m AS (SELECT code, arg_min(event_type, (-n, event_type)) AS guess FROM (SELECT code, event_type, count(*) AS n FROM r WHERE fold = 0 GROUP BY ALL) GROUP BY 1), g AS (SELECT arg_min(event_type, (-n, event_type)) AS top FROM (SELECT event_type, count(*) AS n FROM r WHERE fold = 0 GROUP BY ALL)) SELECT count(*) AS n, round(avg(CASE WHEN coalesce(guess, top) = event_type THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(CASE WHEN guess IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM r LEFT JOIN m USING (code) CROSS JOIN g WHERE fold = 1")
def cross_parent_accuracy(spark, sf_dir):
    """The commonest label of a code among one fold's parents, tried on the other's."""
    t = ticks(spark, sf_dir)
    rows = t.join(sampling.folds(t, ["event_type"], "user_id", "folds"), ["event_type", "user_id"]).withColumn("code", F.col("user_id") % 7)
    out = metrics.majority_backoff(rows.where("fold = 0"), rows.where("fold = 1"), ["code"], "event_type", 1)
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("prediction") == F.col("event_type")).cast("double")), 6).alias("accuracy"), F.round(F.avg((F.col("depth") > 0).cast("double")), 6).alias("coverage"))


@query(f"WITH {TICKS}, k AS (SELECT user_id, rank() OVER (PARTITION BY user_id ORDER BY value) - 1 + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2 AS ra, rank() OVER (PARTITION BY user_id ORDER BY tick) - 1 AS rb FROM ticks WHERE value IS NOT NULL) SELECT user_id, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN round(corr(ra, rb), 6) END AS spearman FROM k GROUP BY 1")
def spearman_by_user(spark, sf_dir):
    return metrics.spearman(ticks(spark, sf_dir).withColumn("t", F.col("tick").cast("double")), "value", "t", ["user_id"]).withColumns(_r("spearman"))


@query(f"WITH {TICKS}, base AS (SELECT lag(event_type, 2) OVER w AS a, lag(event_type, 3) OVER w AS b FROM ticks WINDOW w AS (PARTITION BY user_id ORDER BY tick)), n AS (SELECT a AS c, b AS l, count(*)::DOUBLE AS n FROM base WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2), m AS (SELECT n, sum(n) OVER (PARTITION BY c) AS a, sum(n) OVER (PARTITION BY l) AS b, sum(n) OVER () AS t FROM n) SELECT 2 AS stride_a, 3 AS stride_b, round(sum(n / t * ln(n * t / (a * b))), 6) AS mutual_information FROM m")
def cross_stride_mi(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("tick")
    rows = ticks(spark, sf_dir).select(F.lag("event_type", 2).over(order).alias("a"), F.lag("event_type", 3).over(order).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return metrics.association(rows, "a", "b").select(F.lit(2).alias("stride_a"), F.lit(3).alias("stride_b"), F.round("mutual_information", 6).alias("mutual_information"))


@query(f"{CADENCE}, s AS (SELECT user_id, tick, sum(CASE WHEN gap > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY tick ROWS UNBOUNDED PRECEDING) AS segment FROM g) SELECT user_id, segment::BIGINT AS segment, min(tick) AS start, max(tick) + 1 AS stop FROM s GROUP BY 1, 2")
def session_gap_segments(spark, sf_dir):
    return series.segments(ticks(spark, sf_dir), 7200).select("user_id", F.col("segment").cast("long").alias("segment"), "start", "stop")


@query(f"WITH {TICKS}, n AS (SELECT user_id, count(*) AS n FROM ticks GROUP BY 1) SELECT user_id, unnest(range(4, n - 3, 4)) AS anchor FROM n")
def sliding_windows(spark, sf_dir):
    n = ticks(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return series.sliding_windows(n, 4, 3, 4).select("user_id", "anchor")


_JOINT = f"WITH {TICKS}, e AS (SELECT user_id, floor(sec / 3600)::BIGINT AS step, min(event_type) AS code FROM ticks GROUP BY 1, 2), w AS (SELECT a.user_id, a.step AS current, b.step AS future, a.code AS current_code, b.code AS future_code FROM e a JOIN e b ON a.user_id = b.user_id AND b.step = a.step + 4)"


def _windows(spark, sf_dir):
    steps = ticks(spark, sf_dir).groupBy("user_id", F.floor(F.col("sec") / 3600).cast("long").alias("step")).agg(F.min("event_type").alias("code"))
    return series.exact_endpoint_windows(steps, 4, 0, "user_id", "step", "code")


@query(_JOINT + " SELECT * FROM w")
def joint_windows_exact_endpoint(spark, sf_dir):
    return _windows(spark, sf_dir).select("user_id", "current", "future", "current_code", "future_code")


@query(_JOINT + " SELECT current_code, count(*) AS windows, count(*) FILTER (WHERE current_code <> future_code) AS changed, count(DISTINCT user_id) AS parents, count(DISTINCT CASE WHEN current_code <> future_code THEN user_id END) AS changed_parents FROM w GROUP BY 1")
def transition_coverage(spark, sf_dir):
    changed = F.col("current_code") != F.col("future_code")
    return _windows(spark, sf_dir).groupBy("current_code").agg(F.count(F.lit(1)).alias("windows"), F.count_if(changed).alias("changed"), F.count_distinct("user_id").alias("parents"), F.count_distinct(F.when(changed, F.col("user_id"))).alias("changed_parents"))


@query(f"WITH {TICKS} SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS lower_median, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90 FROM ticks GROUP BY 1")
def quantile_summary(spark, sf_dir):
    """AGG-35: by counting in bins, so no type's values meet in one task."""
    wanted = {"lower_median": (0.5, "disc"), "p10": (0.1, "linear"), "p90": (0.9, "linear")}
    return orders.quantiles(table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value", wanted).withColumns({c: F.round(c, 6) for c in ("p10", "p90")})


@query(f"{CADENCE}, k AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY tick) AS d, gap <= 3600 AS inside FROM g) SELECT user_id, count(*) FILTER (WHERE inside) AS n_inside, round(sqrt(avg(d * d) FILTER (WHERE inside)), 6) AS rms_inside, round(sqrt(avg(d * d) FILTER (WHERE NOT inside)), 6) AS rms_outside FROM k GROUP BY 1")
def quantile_summary_in_out(spark, sf_dir):
    """Root mean square change inside and outside of runs, per episode."""
    rows = series.with_cadence(ticks(spark, sf_dir), "user_id", "tick", "sec").withColumns({"d": F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("tick")), "inside": F.col("gap") <= 3600})
    rms = lambda on: F.round(F.sqrt(F.avg(F.when(on, F.col("d") * F.col("d")))), 6)
    return rows.groupBy("user_id").agg(F.count_if("inside").alias("n_inside"), rms(F.col("inside")).alias("rms_inside"), rms(~F.col("inside")).alias("rms_outside"))


@query(f"WITH {TICKS}, n AS (SELECT user_id, list_sort(list(tick)) AS l FROM ticks GROUP BY 1) SELECT user_id, l[floor((len(l) - 1) * 0.5)::INT + 1] AS p50, l[floor((len(l) - 1) * 0.9)::INT + 1] AS p90 FROM n")
def index_floor_quantiles(spark, sf_dir):
    """AGG-40: by counting in bins, so no user's ticks meet in one array."""
    return orders.quantiles(ticks(spark, sf_dir).select("user_id", "tick"), ["user_id"], "tick", {"p50": (0.5, "floor"), "p90": (0.9, "floor")}).drop("n")


@query(f"WITH {TICKS}, q AS (SELECT event_type, quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM ticks GROUP BY 1) SELECT event_type, round(q[1], 6) AS q1, round(q[2], 6) AS q2, round(q[3], 6) AS q3 FROM q")
def event_thresholds(spark, sf_dir):
    """FUN-21, FUN-22: quartiles by counting in bins."""
    q = orders.quantiles(table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value", {f"q{k}": (k / 4, "linear") for k in (1, 2, 3)})
    return q.select("event_type", *(F.round(f"q{k}", 6).alias(f"q{k}") for k in (1, 2, 3)))


@query(f"WITH {TICKS}, q AS (SELECT event_type, quantile_cont(value, [0.25, 0.5, 0.75]) AS q FROM ticks GROUP BY 1) SELECT event_type, CASE WHEN value > q[1] THEN 1 ELSE 0 END + CASE WHEN value > q[2] THEN 1 ELSE 0 END + CASE WHEN value > q[3] THEN 1 ELSE 0 END AS level, count(*) AS n FROM ticks JOIN q USING (event_type) GROUP BY 1, 2")
def event_labels(spark, sf_dir):
    """Left-open levels: how many quartiles lie strictly below the value."""
    t = ticks(spark, sf_dir)
    q = t.groupBy("event_type").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    rows = t.join(F.broadcast(q), "event_type")  # a row an event type
    return rows.groupBy("event_type", above(F.col("value"), [F.get("q", F.lit(k)) for k in range(3)]).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TICKS}, l AS (SELECT user_id, value, lead(value) OVER w AS n1, lead(value, 2) OVER w AS n2 FROM ticks WINDOW w AS (PARTITION BY user_id ORDER BY tick)) SELECT user_id, round(corr(value, n1), 6) AS now, round(corr(value, n2), 6) AS shifted, count(*) AS n FROM l WHERE n2 IS NOT NULL GROUP BY 1 HAVING count(*) >= 3")
def endpoint_alignment(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("tick")
    rows = ticks(spark, sf_dir).withColumns({"n1": F.lead("value").over(order), "n2": F.lead("value", 2).over(order)}).where("n2 IS NOT NULL")
    return rows.groupBy("user_id").agg(F.round(metrics.correlation("value", "n1"), 6).alias("now"), F.round(metrics.correlation("value", "n2"), 6).alias("shifted"), F.count(F.lit(1)).alias("n")).where("n >= 3")


@query(f"WITH {TICKS}, t AS (SELECT user_id, value AS x2, lag(value, 2) OVER w AS x1, lag(value, 4) OVER w AS x0 FROM ticks WINDOW w AS (PARTITION BY user_id ORDER BY tick)), c AS (SELECT unnest([0, 1, 2]) AS kind, x0, x1, x2 FROM t WHERE x0 IS NOT NULL), d AS (SELECT kind, CASE kind WHEN 0 THEN x1 ELSE x2 END AS y0, CASE kind WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END AS y1, CASE kind WHEN 1 THEN x0 ELSE x2 END AS y2, x0, x1, x2 FROM c) SELECT CASE kind WHEN 0 THEN 'history_swap' WHEN 1 THEN 'reverse_time' ELSE 'static_current' END AS perturbation, count(*) AS n, round(avg(CASE WHEN floor(y0 / 25) <> floor(x0 / 25) OR floor(y1 / 25) <> floor(x1 / 25) OR floor(y2 / 25) <> floor(x2 / 25) THEN 1.0 ELSE 0.0 END), 6) AS changed FROM d GROUP BY 1")
def temporal_counterfactuals(spark, sf_dir):
    """How often codes change if the three frames are reordered."""
    order = Window.partitionBy("user_id").orderBy("tick")
    rows = ticks(spark, sf_dir).select(F.array(F.lag("value", 4).over(order), F.lag("value", 2).over(order), F.col("value")).alias("x")).where("x[0] IS NOT NULL")
    forms = {"history_swap": (1, 0, 2), "reverse_time": (2, 1, 0), "static_current": (2, 2, 2)}
    code = lambda v: F.transform(v, lambda x: F.floor(x / 25))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("perturbation"), F.array(*(F.get("x", F.lit(k)) for k in p)).alias("y")) for n, p in forms.items())))
    out = rows.withColumn("e", each).select("e.perturbation", (code(F.col("e.y")) != code(F.col("x"))).cast("double").alias("c"))
    return out.groupBy("perturbation").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("changed"))


@query(f"WITH {TICKS}, l AS (SELECT value, (value % 10) / 10 AS conf FROM ticks WHERE value >= 0), b AS (SELECT least(floor(conf * 10), 9) AS bin, count(*) AS n, avg(conf) AS c, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS a FROM l GROUP BY 1) SELECT sum(n)::BIGINT AS n, round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b")
def calibration_ece(spark, sf_dir):
    rows = ticks(spark, sf_dir).where("value >= 0").select(((F.col("value") % 10) / 10).alias("conf"), (F.col("value") > 50).alias("ok"))
    return metrics.calibration_error(rows, "conf", "ok").withColumns(_r("ece"))


@query(f"WITH {TICKS}, p AS (SELECT user_id, event_type, value, lag(event_type) OVER (PARTITION BY user_id ORDER BY tick) AS prev FROM ticks), s AS (SELECT user_id, value, unnest(['all', CASE WHEN prev = event_type THEN 'stable' ELSE 'changed' END, 'type:' || event_type]) AS stratum FROM p WHERE prev IS NOT NULL) SELECT stratum, count(*) AS n, round(avg(value), 6) AS mean, count(DISTINCT user_id) AS parents FROM s GROUP BY 1")
def stratified_metrics(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("tick")
    rows = ticks(spark, sf_dir).withColumn("prev", F.lag("event_type").over(order)).where("prev IS NOT NULL")
    strata = F.array(F.lit("all"), F.when(F.col("prev") == F.col("event_type"), "stable").otherwise("changed"), F.concat(F.lit("type:"), "event_type"))
    return rows.withColumn("stratum", F.explode(strata)).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.count_distinct("user_id").alias("parents"))


@query(f"WITH {TICKS}, q AS (SELECT event_id, user_id, sec FROM ticks WHERE event_type = 'purchase'), v AS (SELECT user_id, sec, arg_max(value, event_id) AS value FROM ticks WHERE event_type = 'view' GROUP BY 1, 2) SELECT q.event_id, q.user_id, v.value AS last_view FROM q ASOF LEFT JOIN v ON q.user_id = v.user_id AND q.sec >= v.sec")
def as_of_last_view(spark, sf_dir):
    """Each purchase with the user's last view at or before it."""
    t = ticks(spark, sf_dir)
    views = t.where("event_type = 'view'").groupBy("user_id", "sec").agg(F.max_by("value", "event_id").alias("last_view"))
    return series.as_of(t.where("event_type = 'purchase'").select("event_id", "user_id", "sec"), views, "user_id", "sec", "last_view").select("event_id", "user_id", "last_view")


@query(f"WITH {TICKS}, s AS (SELECT DISTINCT user_id, {SPLIT_SQL} AS split FROM ticks) SELECT split, count(*) AS users, min(user_id) AS least FROM s GROUP BY 1")
def hash_split_users(spark, sf_dir):
    users = ticks(spark, sf_dir).select("user_id").distinct().withColumn("split", split_of(unit_interval(score("split", F.col("user_id")))))
    return users.groupBy("split").agg(F.count(F.lit(1)).alias("users"), F.min("user_id").alias("least"))
