"""Queries over grids, frames, motion, perturbations and reconstruction."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics, motion, series
from ..registry import query
from ..sources.tables import TICKS, table, ticks
from .series import _triple_sql


def _rows():
    return F.count(F.lit(1)).alias("n")


@query("SELECT vec_id, k AS cell, round((embedding[b+1]::DOUBLE + embedding[b+2]::DOUBLE + embedding[b+5]::DOUBLE + embedding[b+6]::DOUBLE) / 4, 5) + 0.0 AS mean FROM (SELECT vec_id, embedding, k, (k // 4) * 16 + ((k % 4) // 2) * 8 + (k % 2) * 2 AS b FROM embeddings, range(16) t(k))")
def block_pool(spark, sf_dir):
    """PRJ-06: vectors as four 4 x 4 grids, each pooled to 2 x 2."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(motion.pool_grid(F.col("embedding"), 4, 4, 2)).alias("cell", "mean"))
    return rows.select("vec_id", F.col("cell").cast("long").alias("cell"), (F.round("mean", 5) + F.lit(0.0)).alias("mean"))


_AT = [2 * k / 3 - 1 for k in range(4)]
_BASES = [[1.0] * 16, [x for _ in _AT for x in _AT], [y for y in _AT for _ in _AT], [x * x + y * y for y in _AT for x in _AT]]


@query("SELECT vec_id, c * 4 + m AS moment, round(list_inner_product(embedding[c * 16 + 1 : c * 16 + 16]::DOUBLE[], (" + str(_BASES) + "::DOUBLE[][])[m + 1]) / 16, 5) + 0.0 AS value FROM embeddings, range(4) a(c), range(4) b(m)")
def spatial_moments(spark, sf_dir):
    """PRJ-08."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(motion.spatial_moments(F.col("embedding"), 4, 4)).alias("moment", "value"))
    return rows.select("vec_id", F.col("moment").cast("long").alias("moment"), (F.round("value", 5) + F.lit(0.0)).alias("value"))


@query(f"WITH t AS ({_triple_sql(2)}), p AS (SELECT *, 'history_swap' AS condition, x1 AS y0, x0 AS y1, x2 AS y2 FROM t UNION ALL SELECT *, 'reverse_time', x2, x1, x0 FROM t UNION ALL SELECT *, 'static_current', x2, x2, x2 FROM t) SELECT condition, count(*) AS n, round(sqrt(avg((y0 - x0) * (y0 - x0) + (y1 - x1) * (y1 - x1) + (y2 - x2) * (y2 - x2))), 5) AS change FROM p GROUP BY 1")
def descriptor_perturbations(spark, sf_dir):
    """PRJ-26: how far each perturbation moves a causal triple."""
    rows = motion.perturbed(series.causal_triples(ticks(spark, sf_dir), 2, "value", valid=F.col("value") >= 0).select("x0", "x1", "x2"))
    square = sum(((F.col(f"y{k}") - F.col(f"x{k}")) * (F.col(f"y{k}") - F.col(f"x{k}")) for k in range(3)), F.lit(0.0))
    return rows.groupBy("condition").agg(_rows(), F.round(F.sqrt(F.avg(square)), 5).alias("change"))


_RANGES = [(10, 30), (40, 50)]
_KEPT = " OR ".join(f"(tick >= {a} AND tick < {b})" for a, b in _RANGES)
_KIND = f"WITH {TICKS}, k AS (SELECT *, ({_KEPT}) AS kept FROM ticks), l AS (SELECT *, lead(kept) OVER w AS next_kept, abs(lead(value) OVER w - value) AS step FROM k WINDOW w AS (PARTITION BY user_id ORDER BY tick)), t AS (SELECT *, CASE WHEN kept AND next_kept THEN 'inside' WHEN kept OR next_kept THEN 'boundary' ELSE 'outside' END AS kind FROM l WHERE next_kept IS NOT NULL)"


@query(_KIND + " SELECT user_id, kind, count(*) AS n FROM t GROUP BY 1, 2")
def keep_transition_masks(spark, sf_dir):
    """PRJ-21."""
    return motion.transition_kind(ticks(spark, sf_dir), _RANGES).groupBy("user_id", "kind").agg(_rows())


@query(_KIND + ", r AS (SELECT user_id, sqrt(avg(step * step) FILTER (WHERE kind = 'inside')) AS i, sqrt(avg(step * step) FILTER (WHERE kind = 'outside')) AS o FROM t GROUP BY 1) SELECT user_id, round(i, 5) AS inside, round(o, 5) AS outside, round(CASE WHEN o > 0 THEN i / o END, 5) AS ratio FROM r")
def motion_by_range(spark, sf_dir):
    """AGG-36: root mean square steps inside and outside of the kept ranges, and their ratio."""
    order = Window.partitionBy("user_id").orderBy("tick")
    rows = motion.transition_kind(ticks(spark, sf_dir).withColumn("step", F.lead("value").over(order) - F.col("value")), _RANGES)
    rms = lambda kind: F.sqrt(F.avg(F.when(F.col("kind") == kind, F.col("step") * F.col("step"))))
    out = rows.groupBy("user_id").agg(rms("inside").alias("i"), rms("outside").alias("o"))
    return out.select("user_id", F.round("i", 5).alias("inside"), F.round("o", 5).alias("outside"), F.round(F.when(F.col("o") > 0, F.col("i") / F.col("o")), 5).alias("ratio"))


@query("WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), l AS (SELECT user_id, n, unnest(range((n - 1) // 4 + 1)) AS latent FROM n) SELECT user_id, latent, least(4 * latent, n - 1) AS frame FROM l")
def latent_frame_indices(spark, sf_dir):
    """WIN-10."""
    return motion.latent_frames(table(spark, sf_dir, "events").groupBy("user_id").agg(_rows())).select("user_id", "latent", "frame")


@query(f"WITH {TICKS}, n AS (SELECT user_id, count(*) AS n FROM ticks GROUP BY 1), b AS (SELECT user_id, n, t AS latent, greatest(0, least(round_even(t / 4.0::DOUBLE * n, 0), n - 1)) AS start FROM n, range(4) r(t)), w AS (SELECT *, greatest(start + 1, least(round_even((latent + 1) / 4.0::DOUBLE * n, 0), n)) AS stop FROM b) SELECT t.user_id, latent, count(*) AS n, round(avg(value), 6) AS mean FROM ticks t JOIN w ON t.user_id = w.user_id AND tick >= start AND tick < stop GROUP BY 1, 2")
def proportional_action_means(spark, sf_dir):
    """WIN-06."""
    return motion.proportional_means(ticks(spark, sf_dir), "value", 5, 1).withColumn("mean", F.round("mean", 6))


@query(f"WITH {TICKS}, p AS (SELECT event_type, value AS a, lead(value, 2) OVER (PARTITION BY user_id ORDER BY tick) AS b FROM ticks), q AS (SELECT *, b - a AS c FROM p WHERE b IS NOT NULL), m AS (SELECT avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb, avg(c) AS mc, stddev_samp(c) AS sc FROM q) SELECT event_type, count(*) AS n, round(avg((a - ma) / sa), 5) + 0.0 AS now, round(avg((b - mb) / sb), 5) + 0.0 AS ahead, round(avg((c - mc) / sc), 5) + 0.0 AS change FROM q, m GROUP BY 1")
def forward_pairs_standardised(spark, sf_dir):
    """WIN-03: a value, the one two ticks on and their difference, under global means and sample deviations."""
    rows = ticks(spark, sf_dir).withColumns({"a": F.col("value"), "b": F.lead("value", 2).over(Window.partitionBy("user_id").orderBy("tick"))}).where("b IS NOT NULL").withColumn("c", F.col("b") - F.col("a"))
    m = rows.agg(*(f(c).alias(p + c) for c in "abc" for p, f in (("m", F.avg), ("s", F.stddev_samp))))
    z = lambda c, name: (F.round(F.avg((F.col(c) - F.col(f"m{c}")) / F.col(f"s{c}")), 5) + F.lit(0.0)).alias(name)
    return rows.join(F.broadcast(m), F.lit(True)).groupBy("event_type").agg(_rows(), z("a", "now"), z("b", "ahead"), z("c", "change"))  # one row


@query(f"WITH {TICKS}, v AS (SELECT *, lag(tick) OVER w AS before, lag(event_type) OVER w AS prev FROM ticks WHERE value >= 10 WINDOW w AS (PARTITION BY user_id ORDER BY tick)) SELECT user_id, count(*) AS pairs, round(avg(CASE WHEN prev = event_type THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM v WHERE tick = before + 1 GROUP BY 1")
def lag_one_agreement(spark, sf_dir):
    """WIN-04: equal codes at ticks that follow each other, after other ticks were left out."""
    rows = series.transitions(ticks(spark, sf_dir).where("value >= 10"), "event_type")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg((F.col("prev") == F.col("cur")).cast("double")), 6).alias("agreement"))


@query(f"WITH {TICKS}, s AS (SELECT user_id, abs(value - lag(value, 2) OVER w) AS change, sqrt(avg(value * value) OVER (PARTITION BY user_id ORDER BY tick ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) AS size FROM ticks WINDOW w AS (PARTITION BY user_id ORDER BY tick)) SELECT user_id, count(*) AS n, round(avg(change), 9) AS change, round(avg(size), 9) AS size FROM s WHERE change IS NOT NULL GROUP BY 1")
def motion_scalars(spark, sf_dir):
    """WIN-12: change over two ticks and the root mean square over the rows between."""
    order = Window.partitionBy("user_id").orderBy("tick")
    rows = ticks(spark, sf_dir).select("user_id", F.abs(F.col("value") - F.lag("value", 2).over(order)).alias("change"), F.sqrt(F.avg(F.col("value") * F.col("value")).over(order.rowsBetween(-1, 0))).alias("size"))
    return rows.where("change IS NOT NULL").groupBy("user_id").agg(_rows(), F.round(F.avg("change"), 9).alias("change"), F.round(F.avg("size"), 9).alias("size"))


@query(f"WITH {TICKS}, m AS (SELECT event_type, value, abs(value - lag(value) OVER w) AS motion, lead(value) OVER w AS ahead FROM ticks WINDOW w AS (PARTITION BY user_id ORDER BY tick)), k AS (SELECT * FROM m WHERE motion IS NOT NULL AND ahead IS NOT NULL), q AS (SELECT event_type, quantile_disc(motion, 0.5) AS median, quantile_cont(motion, 0.25) AS q1, quantile_cont(motion, 0.75) AS q3 FROM k GROUP BY 1), s AS (SELECT event_type, any_value(median) AS median, avg(ahead) FILTER (WHERE motion <= q1) AS low, avg(ahead) FILTER (WHERE motion >= q3) AS high FROM k JOIN q USING (event_type) GROUP BY 1) SELECT event_type, round(median, 6) AS median, round(low, 5) AS low, round(high, 5) AS high, low < high AS ordered FROM s")
def motion_quartiles(spark, sf_dir):
    """AGG-33: the lower median of motion, and what follows its lowest and highest quarter."""
    order = Window.partitionBy("user_id").orderBy("tick")
    rows = ticks(spark, sf_dir).select("event_type", F.abs(F.col("value") - F.lag("value").over(order)).alias("motion"), F.lead("value").over(order).alias("ahead")).where("motion IS NOT NULL AND ahead IS NOT NULL")
    q = rows.groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY motion)").alias("median"), F.percentile("motion", F.lit(0.25)).alias("q1"), F.percentile("motion", F.lit(0.75)).alias("q3"))
    out = rows.join(F.broadcast(q), "event_type").groupBy("event_type").agg(  # a row an event type
        F.first("median").alias("median"), F.avg(F.when(F.col("motion") <= F.col("q1"), F.col("ahead"))).alias("low"), F.avg(F.when(F.col("motion") >= F.col("q3"), F.col("ahead"))).alias("high")
    )
    return out.select("event_type", F.round("median", 6).alias("median"), F.round("low", 5).alias("low"), F.round("high", 5).alias("high"), (F.col("low") < F.col("high")).alias("ordered"))


@query(f"WITH {TICKS}, s AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0 END AS sw FROM ticks), d AS (SELECT user_id, event_type, coalesce(abs(sw - lag(sw) OVER w), 0) AS turn, coalesce(abs((lead(value) OVER w - value) - (value - lag(value) OVER w)), 0) AS bend FROM s WINDOW w AS (PARTITION BY user_id ORDER BY tick)), r AS (SELECT *, greatest(1.0::DOUBLE, least(5.0::DOUBLE, 1 + turn / (avg(turn) OVER u + 1e-6) + bend / (avg(bend) OVER u + 1e-6))) AS w FROM d WINDOW u AS (PARTITION BY user_id)), n AS (SELECT user_id, event_type, w / avg(w) OVER (PARTITION BY user_id) AS weight FROM r) SELECT user_id, event_type, count(*) AS n, round(avg(weight), 5) AS weight FROM n GROUP BY 1, 2")
def decision_frame_weights(spark, sf_dir):
    """WIN-16."""
    rows = motion.decision_weights(ticks(spark, sf_dir), F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0), "value")
    return rows.groupBy("user_id", "event_type").agg(_rows(), F.round(F.avg("weight"), 5).alias("weight"))


@query(f"WITH {TICKS}, w AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN sec END IGNORE NULLS) OVER p AS tb, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER p AS b, first_value(CASE WHEN event_type = 'click' THEN sec END IGNORE NULLS) OVER f AS ta, first_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER f AS a FROM ticks WINDOW p AS (PARTITION BY user_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY tick ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT user_id, event_id, CASE WHEN b IS NULL OR ta - sec < sec - tb THEN a ELSE b END AS click_id, round(CASE WHEN b IS NULL OR ta - sec < sec - tb THEN ta - sec ELSE sec - tb END, 3) AS distance FROM w WHERE event_type = 'purchase'")
def nearest_frame(spark, sf_dir):
    """SRC-24: each purchase with the user's nearest click in time, the earlier one in a tie."""
    rows = ticks(spark, sf_dir)
    clicks = rows.where("event_type = 'click'").select("user_id", "sec", F.col("event_id").alias("click_id"))
    found = motion.nearest(rows.where("event_type = 'purchase'").select("user_id", "event_id", "sec"), clicks, "user_id", "sec", "click_id")
    return found.select("user_id", "event_id", "click_id", F.round("distance", 3).alias("distance"))


@query(f"WITH {TICKS}, u AS (SELECT DISTINCT user_id FROM ticks), l AS (SELECT user_id, coalesce(lead(user_id) OVER (ORDER BY user_id), first_value(user_id) OVER (ORDER BY user_id)) AS other FROM u), f AS (SELECT user_id, value AS a, row_number() OVER (PARTITION BY user_id ORDER BY tick) AS pos FROM ticks), b AS (SELECT user_id AS other, value AS b, row_number() OVER (PARTITION BY user_id ORDER BY tick DESC) AS pos FROM ticks) SELECT user_id, other, count(*) AS n, round(avg(abs(a - b)), 9) AS distance FROM f JOIN l USING (user_id) JOIN b USING (other, pos) WHERE pos <= 256 GROUP BY 1, 2")
def cross_episode_distances(spark, sf_dir):
    """WIN-13; 256 rows a pair is the definition."""
    return motion.cross_episode_pairs(ticks(spark, sf_dir), "value").groupBy("user_id", "other").agg(_rows(), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 9).alias("distance"))


@query("WITH g AS (SELECT value, avg(value) OVER (PARTITION BY event_type) AS m, event_type FROM events) SELECT count(DISTINCT event_type) AS groups, round(avg((value - m) * (value - m)), 5) AS mse, round(1 - avg((value - m) * (value - m)) / greatest(var_pop(value), 1e-12), 6) + 0.0 AS r2 FROM g")
def grouped_target_r2(spark, sf_dir):
    """AGG-30: from a group's moments alone, so no row is joined back."""
    m = metrics.moments(table(spark, sf_dir, "events"), "value", ["event_type"], 0.0)
    pooled = metrics.merged_moments(m, [])
    within = m.agg(F.count(F.lit(1)).alias("groups"), (F.sum(F.col("n") * F.col("std") * F.col("std")) / F.sum("n")).alias("mse"))
    out = within.join(pooled, F.lit(True))  # one row each
    return out.select("groups", F.round("mse", 5).alias("mse"), (F.round(1 - F.col("mse") / F.greatest(F.col("std") * F.col("std"), F.lit(1e-12)), 6) + F.lit(0.0)).alias("r2"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def merged_moments(spark, sf_dir):
    """AGG-02, SUP-01: moments of parts merged to those of the whole."""
    parts = metrics.moments(table(spark, sf_dir, "events"), "value", ["event_type", "user_id"], 0.0)
    return metrics.merged_moments(parts, ["event_type"]).select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), t AS (SELECT count(*) AS used, sum(n) AS total, max(n) AS most FROM n), e AS (SELECT -sum(n / total * ln(n / total)) AS e FROM n, t) SELECT used, round(used / total, 6) AS used_fraction, round(e, 6) AS entropy, round(exp(e), 5) AS perplexity, round(exp(e) / total, 6) AS perplexity_fraction, round(most / total, 6) AS max_fraction FROM t, e")
def label_metrics(spark, sf_dir):
    """AGG-29: users as labels; entropy from sums of n and n ln n."""
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(_rows())
    t = n.agg(F.count(F.lit(1)).alias("used"), F.sum("n").alias("total"), F.max("n").alias("most"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    e = F.log("total") - F.col("nlogn") / F.col("total")
    return t.select("used", F.round(F.col("used") / F.col("total"), 6).alias("used_fraction"), F.round(e, 6).alias("entropy"), F.round(F.exp(e), 5).alias("perplexity"), F.round(F.exp(e) / F.col("total"), 6).alias("perplexity_fraction"), F.round(F.col("most") / F.col("total"), 6).alias("max_fraction"))


@query("WITH e AS (SELECT embedding::DOUBLE[] AS x, list_transform(embedding::DOUBLE[], lambda v: floor(v * 4 + 0.5) / 4) AS q FROM embeddings), s AS (SELECT len(x) AS d, list_inner_product(x, x) AS xx, list_inner_product(q, q) AS qq, list_inner_product(x, q) AS xq FROM e) SELECT round(sum(xx + qq - 2 * xq) / sum(d), 6) AS mse, round(sum(xx + qq - 2 * xq) / sum(xx), 6) AS relative_mse, round(1 - sum(xx + qq - 2 * xq) / sum(xx), 6) AS r2_like, round(avg(xq / greatest(sqrt(xx) * sqrt(qq), 1e-8)), 6) AS mean_cosine FROM s")
def reconstruction_metrics(spark, sf_dir):
    """INF-14: vectors against themselves on a grid of quarters."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("x")).withColumn("q", F.transform("x", lambda v: F.floor(v * 4 + 0.5) / 4))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    rows = rows.select(F.size("x").alias("d"), dot("x", "x").alias("xx"), dot("q", "q").alias("qq"), dot("x", "q").alias("xq"))
    error = F.sum(F.col("xx") + F.col("qq") - 2 * F.col("xq"))
    cosine = F.col("xq") / F.greatest(F.sqrt("xx") * F.sqrt("qq"), F.lit(1e-8))
    return rows.agg(F.round(error / F.sum("d"), 6).alias("mse"), F.round(error / F.sum("xx"), 6).alias("relative_mse"), F.round(1 - error / F.sum("xx"), 6).alias("r2_like"), F.round(F.avg(cosine), 6).alias("mean_cosine"))


@query(f"WITH {TICKS}, f AS (SELECT user_id, value, event_type, lead(event_type, 5) OVER (PARTITION BY user_id ORDER BY tick) AS future FROM ticks) SELECT user_id, count(*) AS n, round(avg(CASE WHEN future = event_type THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) FILTER (WHERE value >= 10) AS masked, round(avg(CASE WHEN future = event_type THEN 1.0 ELSE 0.0 END) FILTER (WHERE value >= 10), 6) AS masked_accuracy FROM f WHERE future IS NOT NULL GROUP BY 1")
def persistence_metrics(spark, sf_dir):
    """AGG-52, AGG-55: the code now as a forecast of the one five ticks on, over all rows and over the valid ones."""
    rows = ticks(spark, sf_dir).withColumn("future", F.lead("event_type", 5).over(Window.partitionBy("user_id").orderBy("tick"))).where("future IS NOT NULL")
    hit = (F.col("future") == F.col("event_type")).cast("double")
    valid = F.col("value") >= 10
    return rows.groupBy("user_id").agg(_rows(), F.round(F.avg(hit), 6).alias("accuracy"), F.count_if(valid).alias("masked"), F.round(F.avg(F.when(valid, hit)), 6).alias("masked_accuracy"))


@query(f"WITH {TICKS}, p AS (SELECT event_type, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY tick) AS d FROM ticks) SELECT event_type, count(*) AS n, round(avg(d * d), 4) AS mse, round(avg(abs(d)), 5) AS mae, round(avg(abs(atan2(sin(d * {2 * math.pi / 100}), cos(d * {2 * math.pi / 100})))), 5) AS angle_error FROM p WHERE d IS NOT NULL AND value >= 10 GROUP BY 1")
def masked_policy_errors(spark, sf_dir):
    """AGG-56, AGG-58: errors of the value before as a forecast; angles wrap."""
    rows = ticks(spark, sf_dir).withColumn("d", F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("tick"))).where("d IS NOT NULL AND value >= 10")
    angle = F.col("d") * (2 * math.pi / 100)
    return rows.groupBy("event_type").agg(_rows(), F.round(F.avg(F.col("d") * F.col("d")), 4).alias("mse"), F.round(F.avg(F.abs("d")), 5).alias("mae"), F.round(F.avg(F.abs(F.atan2(F.sin(angle), F.cos(angle)))), 5).alias("angle_error"))


@query("WITH p AS (SELECT event_type, value AS b, round(value, 0) AS a FROM events) SELECT event_type, count(*) AS n, round(max(abs(a - b)), 6) AS max_error, round(avg(abs(a - b)), 6) AS mean_error, round(sqrt(avg((a - b) * (a - b))), 6) AS rmse, round(avg(CASE WHEN abs(a - b) > 0.1::DOUBLE + 0.01::DOUBLE * abs(b) THEN 1.0 ELSE 0.0 END), 6) AS mismatch FROM p GROUP BY 1")
def compare_prefixes(spark, sf_dir):
    """GAT-16: largest, mean and root mean square error, and the share beyond absolute plus relative tolerance."""
    rows = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("b"), (F.col("value") - F.round("value", 0)).alias("e"))
    beyond = (F.abs("e") > 0.1 + 0.01 * F.abs("b")).cast("double")
    return rows.groupBy("event_type").agg(_rows(), F.round(F.max(F.abs("e")), 6).alias("max_error"), F.round(F.avg(F.abs("e")), 6).alias("mean_error"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 6).alias("rmse"), F.round(F.avg(beyond), 6).alias("mismatch"))


_TYPES = "k AS (SELECT event_type AS e, row_number() OVER (ORDER BY event_type) - 1 AS k FROM (SELECT DISTINCT event_type FROM ticks))"


@query(f"WITH RECURSIVE {TICKS}, {_TYPES}, p AS (SELECT event_type AS cur, lag(event_type) OVER (PARTITION BY user_id ORDER BY tick) AS prev FROM ticks), c AS (SELECT prev, cur, count(*) AS n FROM p WHERE prev IS NOT NULL GROUP BY 1, 2), g AS (SELECT a.k AS a, b.k AS b, coalesce(n, 0) AS n FROM k a CROSS JOIN k b LEFT JOIN c ON prev = a.e AND cur = b.e), m AS (SELECT 0::BIGINT AS depth, []::BIGINT[] AS m, 0::BIGINT AS v UNION ALL SELECT depth + 1, list_append(m, b), (v + n)::BIGINT FROM m JOIN g ON a = depth WHERE NOT list_contains(m, b)), best AS (SELECT m FROM m WHERE depth = (SELECT count(*) FROM k) ORDER BY v DESC, m DESC LIMIT 1), q AS (SELECT unnest(range(len(m))) AS a, unnest(m) AS b FROM best) SELECT ka.e AS code, kb.e AS mapped, g.n AS overlap FROM q JOIN g ON g.a = q.a AND g.b = q.b JOIN k ka ON ka.k = q.a JOIN k kb ON kb.k = q.b")
def best_overlap_mapping(spark, sf_dir):
    """INF-08, INF-09: the one-to-one relabelling of the code before that agrees most with the code now."""
    pairs = series.transitions(ticks(spark, sf_dir), "event_type")
    cells = {(r["prev"], r["cur"]): r["n"] for r in pairs.groupBy("prev", "cur").agg(_rows()).collect()}  # codes x codes
    names = sorted({c for pair in cells for c in pair})
    best = metrics.overlap_mapping([[cells.get((a, b), 0) for b in names] for a in names])
    return spark.createDataFrame([(a, names[j], cells.get((a, names[j]), 0)) for a, j in zip(names, best, strict=True)], "code string, mapped string, overlap long")
