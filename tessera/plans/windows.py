"""Queries over code prefixes, window slices, time features, stability of labellings and nested text."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import collapse_space
from ..operators import series
from ..registry import query
from ..sources.tables import TICKS, table, ticks
from .series import _triple_sql

_CODES = "[user_id % 3, floor(value / 20)::BIGINT % 4, tick % 2]"


def _coded(spark, sf_dir):
    c = F.array(F.col("user_id") % 3, F.floor(F.col("value") / 20) % 4, F.col("tick") % 2)
    return ticks(spark, sf_dir).withColumn("c", c).withColumn("d", F.lead("c", 2).over(Window.partitionBy("user_id").orderBy("tick"))).where("d IS NOT NULL")


@query(f"WITH {TICKS}, c AS (SELECT user_id, tick, {_CODES} AS c FROM ticks), p AS (SELECT c, lead(c, 2) OVER (PARTITION BY user_id ORDER BY tick) AS d FROM c), l AS (SELECT c, d, unnest(range(3)) AS level FROM p WHERE d IS NOT NULL) SELECT level, count(*) AS n, round(avg(CASE WHEN c[level + 1] <> d[level + 1] THEN 1.0 ELSE 0.0 END), 6) AS changed, round(avg(CASE WHEN c[1:level + 1] <> d[1:level + 1] THEN 1.0 ELSE 0.0 END), 6) AS prefix_changed FROM l GROUP BY 1")
def prefix_change(spark, sf_dir):
    """FUN-35, AGG-45: how often each level, and any level up to it, differs two ticks on."""
    rows = _coded(spark, sf_dir).select("c", "d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("level"))
    at = (F.col("level") + 1).cast("int")
    level = (F.element_at("c", at) != F.element_at("d", at)).cast("double")
    prefix = (F.slice("c", F.lit(1), at) != F.slice("d", F.lit(1), at)).cast("double")
    return rows.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(level), 6).alias("changed"), F.round(F.avg(prefix), 6).alias("prefix_changed"))


@query(f"WITH {TICKS}, c AS (SELECT user_id, tick, {_CODES} AS c FROM ticks), p AS (SELECT c, lead(c, 2) OVER (PARTITION BY user_id ORDER BY tick) AS d FROM c) SELECT c[2] AS source, d[2] AS target, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY c[2]), 6) AS fraction FROM p WHERE d IS NOT NULL GROUP BY 1, 2")
def code_flows(spark, sf_dir):
    """AGG-45: flows between the codes of one level."""
    n = _coded(spark, sf_dir).groupBy(F.element_at("c", 2).alias("source"), F.element_at("d", 2).alias("target")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("fraction", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("source")), 6))


_CENTERS = [[0.5, -1.0, 2.0], [10.0, 20.0, 30.0, 45.0], [0.25, 0.75]]


@query(f"WITH {TICKS}, c AS (SELECT event_id, {_CODES} AS c FROM ticks), l AS (SELECT event_id, c, unnest(range(3)) AS level FROM c), r AS (SELECT event_id, level, list_sum(list_transform(range(level + 1), lambda k: ({_CENTERS}::DOUBLE[][])[k + 1][c[k + 1] + 1])) AS x FROM l) SELECT level, count(*) AS n, round(avg(x), 6) AS mean, round(avg((value - x) * (value - x)), 4) AS mse FROM r JOIN events USING (event_id) GROUP BY 1")
def prefix_reconstructions(spark, sf_dir):
    """FUN-33, FUN-34: sums of the centers of all levels so far, and their error."""
    centers = F.array(*(F.array(*map(F.lit, row)) for row in _CENTERS))
    codes = F.array(F.col("user_id") % 3, F.floor(F.col("value") / 20) % 4, F.col("tick") % 2)
    own = F.zip_with(centers, codes, lambda row, c: F.get(row, c.cast("int")))
    sums = F.array(*(F.aggregate(F.slice(own, 1, k + 1), F.lit(0.0), lambda s, x: s + x) for k in range(3)))
    rows = ticks(spark, sf_dir).select("value", F.posexplode(sums).alias("level", "x"))
    error = F.col("value") - F.col("x")
    return rows.groupBy(F.col("level").cast("long").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.avg(error * error), 4).alias("mse"))


@query(f"WITH {TICKS}, w AS (SELECT user_id, tick, sec, list(value) OVER h AS history, list(value) OVER f AS future, first_value(sec) OVER h AS since, last_value(sec) OVER f AS till FROM ticks WINDOW h AS (PARTITION BY user_id ORDER BY tick ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), f AS (PARTITION BY user_id ORDER BY tick ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)) SELECT user_id, tick, round(list_sum(history), 6) AS history, round(list_sum(future), 6) AS future, round(since - sec, 3) AS since, round(till - sec, 3) AS till FROM w WHERE tick % 5 = 0 AND len(history) = 4 AND len(future) = 4")
def window_slices(spark, sf_dir):
    """JON-13, JON-15, WIN-18: at every fifth tick the values of four ticks before and ahead, with times relative to it."""
    order = Window.partitionBy("user_id").orderBy("tick")
    h, f = order.rowsBetween(-3, 0), order.rowsBetween(1, 4)
    rows = ticks(spark, sf_dir).select("user_id", "tick", "sec", F.collect_list("value").over(h).alias("h"), F.collect_list("value").over(f).alias("f"), F.first("sec").over(h).alias("a"), F.last("sec").over(f).alias("b"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6)
    rows = rows.where((F.col("tick") % 5 == 0) & (F.size("h") == 4) & (F.size("f") == 4))
    return rows.select("user_id", "tick", total("h").alias("history"), total("f").alias("future"), F.round(F.col("a") - F.col("sec"), 3).alias("since"), F.round(F.col("b") - F.col("sec"), 3).alias("till"))


_RATES = [math.exp(-math.log(10000.0) * k / 3) for k in range(4)]


@query("WITH t AS (SELECT event_id, value, unnest(range(8)) AS dim FROM events) SELECT dim, count(*) AS n, round(avg(CASE WHEN dim < 4 THEN sin(value * r[dim + 1]) ELSE cos(value * r[dim - 3]) END), 6) + 0.0 AS mean FROM t, (SELECT " + str(_RATES) + "::DOUBLE[] AS r) GROUP BY 1")
def sinusoidal_features(spark, sf_dir):
    """FUN-31: sines, then cosines, at geometric rates from 1 to 1/10000."""
    angles = [F.col("value") * r for r in _RATES]
    rows = table(spark, sf_dir, "events").select(F.posexplode(F.array(*map(F.sin, angles), *map(F.cos, angles))).alias("dim", "x"))
    return rows.groupBy(F.col("dim").cast("long").alias("dim")).agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg("x"), 6) + F.lit(0.0)).alias("mean"))


_PAIR = "comb AS (SELECT a, b, sum(nab * (nab - 1) / 2) AS s, any_value(sa) AS sa, any_value(sb) AS sb, any_value(t) AS t FROM (SELECT a, b, x, y, nab, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM l WHERE run = a GROUP BY code)) AS sa, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM l WHERE run = b GROUP BY code)) AS sb, (SELECT count(*) * (count(*) - 1) / 2 FROM events) AS t FROM (SELECT p.run AS a, q.run AS b, p.code AS x, q.code AS y, count(*) AS nab FROM l p JOIN l q ON p.event_id = q.event_id AND p.run < q.run GROUP BY ALL)) GROUP BY 1, 2)"


@query(f"WITH l AS (SELECT event_id, run, CASE run WHEN 0 THEN floor(value / 20)::BIGINT WHEN 1 THEN floor((value + 3) / 20)::BIGINT ELSE user_id % 4 END AS code FROM events, range(3) r(run)), {_PAIR}, r AS (SELECT a::VARCHAR || '-' || b::VARCHAR AS pair, (s - sa * sb / t) / ((sa + sb) / 2 - sa * sb / t) AS ari FROM comb) SELECT pair, round(ari, 6) + 0.0 AS ari FROM r UNION ALL SELECT 'mean', round(avg(ari), 6) + 0.0 FROM r")
def pairwise_stability(spark, sf_dir):
    """INF-10, AGG-61: adjusted Rand index of every two of three labellings, and their mean.

    Labels of a row lie side by side, so no join: each pair is a count of cells in one grouping."""
    runs = [F.floor(F.col("value") / 20), F.floor((F.col("value") + 3) / 20), F.col("user_id") % 4]
    pairs = [F.struct(F.lit(f"{i}-{j}").alias("pair"), runs[i].alias("x"), runs[j].alias("y")) for i in range(3) for j in range(i + 1, 3)]
    cells = table(spark, sf_dir, "events").select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.pair", "p.x", "p.y").agg(F.count(F.lit(1)).alias("n"))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    side = lambda k, name: cells.groupBy("pair", k).agg(F.sum("n").alias("n")).groupBy("pair").agg(two("n").alias(name))
    sums = cells.groupBy("pair").agg(two("n").alias("s"), F.sum("n").alias("t")).join(side("x", "sa"), "pair").join(side("y", "sb"), "pair")  # a row a pair
    chance = F.col("sa") * F.col("sb") / (F.col("t") * (F.col("t") - 1) / 2)
    ari = sums.select("pair", F.try_divide(F.col("s") - chance, (F.col("sa") + F.col("sb")) / 2 - chance).alias("ari"))
    return ari.unionByName(ari.agg(F.lit("mean").alias("pair"), F.avg("ari").alias("ari"))).select("pair", (F.round("ari", 6) + F.lit(0.0)).alias("ari"))


@query("WITH t AS (SELECT conv_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS text, turn FROM conversations), f AS (SELECT conv_id, text, min(turn) AS turn FROM t WHERE text <> '' GROUP BY 1, 2) SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS place FROM f")
def task_texts(spark, sf_dir):
    """SRC-11, JON-02: an episode's different texts with white space collapsed, in order of their first appearance."""
    t = table(spark, sf_dir, "conversations").select("conv_id", collapse_space(F.col("text")).alias("text"), "turn").where("text <> ''")
    first = t.groupBy("conv_id", "text").agg(F.min("turn").alias("turn"))
    return first.select("conv_id", "text", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")).cast("long").alias("place"))


@query("SELECT event_type, (props->>'$.k')::BIGINT // 10 AS k, count(*) AS n FROM events GROUP BY 1, 2")
def nested_fields(spark, sf_dir):
    """SRC-08, SRC-10: a field of a JSON column read under a schema."""
    rows = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return rows.groupBy("event_type", F.floor(F.col("p.k") / 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH a AS ({_triple_sql(2)}), b AS ({_triple_sql(3)}) SELECT user_id, count(*) AS n, round(avg(a.x2 - a.x0), 6) + 0.0 AS short, round(avg(b.x2 - b.x0), 6) + 0.0 AS long FROM a JOIN b USING (user_id, tick) GROUP BY 1")
def aligned_descriptors(spark, sf_dir):
    """JON-03, JON-05: triples of two strides at the ticks that have both."""
    rows = series.aligned_triples(ticks(spark, sf_dir), [2, 3], "value", valid=F.col("value") >= 0)
    change = lambda s, name: (F.round(F.avg(F.col(f"x2_{s}") - F.col(f"x0_{s}")), 6) + F.lit(0.0)).alias(name)
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), change(2, "short"), change(3, "long"))
