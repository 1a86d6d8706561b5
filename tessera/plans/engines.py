"""Queries of the engines that fit many models from one scan."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import codebooks, gates, gram, provenance, sampling
from ..registry import query
from ..sources import files
from ..sources.tables import TICKS, table, ticks
from .series import SPLIT_SQL, _coded

_ALPHAS = (0.5, 4.0, 32.0, 256.0)
_SINGLE = ("value", "phase", "step")


def _numbers(spark, sf_dir):
    rows = sampling.hash_split(ticks(spark, sf_dir), "user_id", "split")
    return rows.select("split", "value", (F.col("tick") % 7).cast("double").alias("phase"), F.col("tick").cast("double").alias("step"), F.sqrt(F.abs("value")).alias("root"), F.pmod(F.col("event_id"), F.lit(11)).cast("double").alias("other"))


@query(
    f"WITH {TICKS}, s AS (SELECT {SPLIT_SQL} AS split, value, (tick % 7)::DOUBLE AS phase, tick::DOUBLE AS step, sqrt(abs(value)) AS root, (event_id % 11)::DOUBLE AS other FROM ticks), "
    "x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS model, '{t}' AS target, split, {c} AS x, {t} AS y FROM s" for c in _SINGLE for t in ("root", "other")) + "), "
    "m AS (SELECT model, target, split, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(x * x) AS xx, avg(x * y) AS xy, avg(y * y) AS yy FROM x GROUP BY ALL), "
    f"t AS (SELECT model, target, x AS mx, y AS my, alpha, (xy - x * y) / ((xx - x * x) * (1 + alpha / n)) AS w FROM m, (VALUES {', '.join(f'({a}::DOUBLE)' for a in _ALPHAS)}) v(alpha) WHERE split = 'train'), "
    "e AS (SELECT model, target, alpha, split, n, yy - 2 * my * y + my * my AS base, 2 * w * (xy - mx * y - my * x + mx * my) - w * w * (xx - 2 * mx * x + mx * mx) AS gone FROM m JOIN t USING (model, target)), "
    "r AS (SELECT *, gone / base AS reduction FROM e), b AS (SELECT model, target, arg_max(alpha, (round(reduction, 9), -alpha)) AS best FROM r WHERE split = 'val' GROUP BY ALL) "
    "SELECT model, target, alpha, split, n AS rows, round(base - gone, 5) AS mse, round(reduction, 5) + 0.0 AS reduction, alpha = best AS chosen FROM r JOIN b USING (model, target)"
)
def readout_grid(spark, sf_dir):
    """REG-10, REG-11, AGG-15, AGG-16: every readout, ridge, target and split of one Gram matrix from one scan; models of one column, which SQL can solve."""
    grams = gram.block_gram(_numbers(spark, sf_dir), list(_SINGLE), {}, ["root", "other"], "split")
    rows = gram.readout_grid(grams, {c: [c] for c in _SINGLE}, ["root", "other"], _ALPHAS)
    found = spark.createDataFrame(rows, "model string, target string, alpha double, split string, rows long, mse double, reduction double, chosen boolean")
    return found.withColumns({"mse": F.round("mse", 5), "reduction": F.round("reduction", 5) + F.lit(0.0)})


@query()
def readout_blocks(spark, sf_dir):
    """REG-11, REG-16, AGG-19, AGG-20: continuous columns, code blocks of three codebooks and both together, for two targets."""
    rows = _coded(spark, sf_dir).withColumns({"t": F.col("tick").cast("double"), "c3": F.pmod(F.xxhash64("user_id"), F.lit(9)), "half": F.col("value") / 2 + F.col("tick") % 3})
    rows = files.dictionary_codes(files.dictionary_codes(rows, "c1", "k1"), "c2", "k2")
    most = rows.agg(F.max("k1"), F.max("k2")).first()  # two numbers
    codes = {"k1": most[0] + 1, "k2": most[1] + 1, "c3": 9}
    grams = gram.block_gram(rows, ["value", "t"], codes, ["target", "half"], "split")
    models = {"continuous": ["value", "t"], "codes": ["k1", "k2"], "seed": ["c3"], "joint": ["value", "t", "k1", "k2", "c3"]}
    found = gram.readout_grid(grams, models, ["target", "half"], _ALPHAS)
    return spark.createDataFrame(found, "model string, target string, alpha double, split string, rows long, mse double, reduction double, chosen boolean")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), sampling_split("vec_id"))


def sampling_split(key: str):
    """Three splits by hash, of which two are held out."""
    at = F.pmod(F.xxhash64(key), F.lit(10))
    return F.when(at == 0, "val").when(at == 1, "test").otherwise("train").alias("split")


@query()
def kmeans_grid(spark, sf_dir):
    """CLU-04, CLU-20, CLU-23: codebooks of several sizes, seeds, pools and tolerances, all moved by each scan."""
    rows = _vectors(spark, sf_dir).withColumn("learn", F.col("split") == "train")
    members = [codebooks.Member(f"k{k}-s{s}-{'pool' if pool else 'all'}", k, s, pool, tolerance, rounds=12) for k, tolerance in ((4, 1e-2), (8, 1e-3), (16, 1e-3)) for s in (7, 19, 31) for pool in (None, "learn")]
    fits = codebooks.fit_grid(rows, "x", "vec_id", members, "split")
    out = [(name, k, s, float(e), k + 1 == len(f.curve) and f.settled) for name, f in fits.items() for k, errors in enumerate(f.curve) for s, e in errors.items()]
    return spark.createDataFrame(out, "member string, round int, split string, mse double, settled boolean")


@query()
def rq_levels(spark, sf_dir):
    """CLU-09, CLU-15, CLU-24: a residual codebook of three levels, learned on the train split; what each level leaves over of each split, by round."""
    rows = _vectors(spark, sf_dir).withColumn("learn", F.col("split") == "train")
    fits = codebooks.fit_residual_levels(rows, "x", "vec_id", 8, 3, "split", "learn", rounds=8)
    out = [(level, k, s, float(e)) for level, f in enumerate(fits) for k, errors in enumerate(f.curve) for s, e in errors.items()]
    return spark.createDataFrame(out, "level int, round int, split string, mse double")


@query()
def block_bootstrap(spark, sf_dir):
    """GAT-01, GAT-02: resampled means of price changes by line, split over blocks by a binomial tree; rows are not ordered."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("delta"))
    return gates.block_bootstrap(rows, "line", "delta", 200, "blocks", 10_000)


_BAD, _GONE = 17, 23


@query(
    f"WITH RECURSIVE o AS (SELECT o_orderkey AS report, sha256(o_orderkey::VARCHAR || '|' || o_orderstatus) AS hash, o_custkey, lag(o_orderkey) OVER w AS prev, lag(o_orderstatus) OVER w AS status, lead(o_orderkey) OVER w IS NULL AS root FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), "
    f"l AS (SELECT report, CASE WHEN report % {_GONE} = 0 THEN -prev ELSE prev END AS input, sha256(prev::VARCHAR || CASE WHEN report % {_BAD} = 0 THEN '?' ELSE '|' END || status) AS claimed FROM o WHERE prev IS NOT NULL), "
    "c AS (SELECT report FROM o WHERE root UNION SELECT l.input FROM c JOIN l USING (report)) "
    "SELECT CASE WHEN h.report IS NULL THEN 'missing' ELSE 'unequal' END AS kind, l.report, l.input FROM l SEMI JOIN c ON l.report = c.report LEFT JOIN o h ON h.report = l.input WHERE h.hash IS DISTINCT FROM l.claimed "
    "UNION ALL SELECT 'unreachable', report, 0 FROM o WHERE report NOT IN (SELECT report FROM c)"
)
def provenance_audit(spark, sf_dir):
    """JON-25: each order is a report that read the customer's order before it; some claim another hash, some name one that isn't there, and what lies behind these is out of reach."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    rows = provenance.dealt(orders, "o_custkey", orders.count()).withColumns({"prev": F.lag("o_orderkey").over(w), "status": F.lag("o_orderstatus").over(w), "root": F.lead("o_orderkey").over(w).isNull()})
    digest = lambda k, sign, status: F.sha2(F.concat(k.cast("string"), sign, status), 256)
    reports = rows.select(key.alias("report"), digest(key, F.lit("|"), F.col("o_orderstatus")).alias("hash"))
    sign = F.when(key % _BAD == 0, "?").otherwise("|")
    links = rows.where("prev IS NOT NULL").select(key.alias("report"), F.when(key % _GONE == 0, -F.col("prev")).otherwise(F.col("prev")).alias("input"), digest(F.col("prev"), sign, F.col("status")).alias("claimed"))
    return provenance.audit(reports, links, rows.where("root").select(key.alias("report"))).withColumn("input", F.coalesce("input", F.lit(0)))
