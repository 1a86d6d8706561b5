"""Queries that build manifests, choose models on validation rows, compare runs and report gates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import audits, gates, manifests, metrics, readouts, sampling
from ..registry import query
from ..sources import commits
from ..sources.tables import MANIFEST, TICKS, manifest, table, ticks
from .series import SPLIT_SQL, _coded


def _rows():
    return F.count(F.lit(1)).alias("n")


def _split_ticks(spark, sf_dir):
    return sampling.hash_split(ticks(spark, sf_dir), "user_id", "split")


_SPLIT_TICKS = f"{TICKS}, s AS (SELECT *, {SPLIT_SQL} AS split FROM ticks)"


_LAB, _TAIL = "'lab' || o_custkey % 9", "strftime(o_orderdate, '%Y-%m-%d') || '/' || CASE WHEN o_custkey % 11 = 0 THEN 'again' ELSE o_orderkey::VARCHAR END"
_PATH = f"{_LAB} || CASE WHEN o_orderstatus = 'F' THEN '/failure/' ELSE '/success/' END || {_TAIL}"


@query(
    f"WITH o AS (SELECT *, {_PATH} AS path FROM orders), l AS (SELECT l_orderkey, count(*) AS steps FROM lineitem GROUP BY 1), k AS (SELECT path, min(o_custkey) AS c FROM o GROUP BY 1), "
    "m AS (SELECT path, o_orderkey - CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END AS episode_id, o_orderstatus <> 'F' AS success, o_orderpriority = '1-URGENT' AS flagged, o_custkey % 7 + 1 AS steps FROM o WHERE o_custkey % 13 <> 0), "
    "mp AS (SELECT path, count(*) AS m_n, CASE WHEN count(*) = 1 THEN min(episode_id) END AS episode_id, bool_and(success) AS success, bool_or(flagged) AS flagged, CASE WHEN count(*) = 1 THEN min(steps) END AS steps FROM m GROUP BY 1), ids AS (SELECT episode_id, count(DISTINCT path) > 1 AS shared FROM m GROUP BY 1), "
    "ip AS (SELECT path, count(*) AS i_n, CASE WHEN count(*) = 1 THEN min(steps) END AS steps FROM o JOIN l ON l_orderkey = o_orderkey GROUP BY 1), r AS (SELECT k.path, mp.steps AS raw, ip.steps, CASE WHEN c % 10 = 3 THEN 0 ELSE c % 4 + 1 END AS eligible, CASE WHEN m_n IS NULL THEN 'missing_raw_metadata' WHEN m_n > 1 THEN 'ambiguous_raw_metadata_path' WHEN i_n IS NULL THEN 'missing_rlds_index' WHEN i_n > 1 THEN 'ambiguous_rlds_path' WHEN shared THEN 'ambiguous_raw_metadata_id' "
    "WHEN flagged THEN 'raw_metadata_quality_flag' WHEN NOT success THEN 'failure_episode' WHEN c % 10 = 3 THEN 'no_eligible_keep_ranges' WHEN ip.steps <= 0 OR c % 4 + 2 > ip.steps THEN 'keep_range_exceeds_rlds_length' ELSE 'kept' END AS reason FROM k LEFT JOIN mp USING (path) LEFT JOIN ip USING (path) LEFT JOIN ids USING (episode_id)) "
    "SELECT reason, count(*) AS n, sum(eligible)::BIGINT AS eligible_steps, coalesce(sum(steps - raw), 0)::BIGINT AS delta FROM r GROUP BY 1"
)
def manifest_build(spark, sf_dir):
    """JON-01, PRJ-13, SRC-13: five sources joined by canonical path; exclusions by the first rule that fails.

    Metadata of every thirteenth customer have a path that is none."""
    o = table(spark, sf_dir, "orders")
    customer, key = F.col("o_custkey"), F.col("o_orderkey")
    told = F.when(F.col("o_orderstatus") == "F", "/failure/").otherwise("/success/")
    raw = lambda kind: F.concat(F.lit("/nfs/r2d2-data-full/lab"), customer % 9, kind, F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("/"), F.when(customer % 11 == 0, "again").otherwise(key.cast("string")), F.lit("/trajectory.h5"))
    paths = {"path": manifests.canonical_path(raw(told)), "other": manifests.canonical_path(raw(F.when(customer % 13 == 0, "/unknown/").otherwise(told))), "episode_id": key - F.when(customer % 5 == 0, 1).otherwise(0)}
    # written once: each of the five sources would work the paths out again, in each of its filters
    o = commits.stored(o.withColumns(paths), "manifest-sources")
    steps = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("num_steps"))
    c = F.col("c")
    ranges = F.when(c % 10 == 3, F.array().cast("array<struct<begin:bigint,end:bigint>>")).otherwise(F.array(F.struct(F.lit(1).cast("long").alias("begin"), (c % 4 + 2).alias("end"))))
    keep = o.groupBy("path").agg(F.min("o_custkey").alias("c")).select("path", ranges.alias("ranges"))
    flags = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("urgent"))).otherwise(F.array().cast("array<string>"))
    metadata = o.select(
        F.col("other").alias("path"), "episode_id", (F.col("o_orderstatus") != "F").alias("success"), flags.alias("quality_flags"), (customer % 7 + 1).alias("num_steps"),
        F.lit("lab").alias("institution_id"), F.lit("hall").alias("building_id"), customer.cast("string").alias("scene_id"), F.col("o_orderpriority").alias("task"),
    )
    index = o.join(steps, key == F.col("l_orderkey")).select("path", "num_steps", (customer % 3).cast("string").alias("shard_name"))
    objects = o.select((customer % 3).cast("string").alias("shard_name"), F.lit("crc").alias("checksum")).distinct()
    language = o.select("episode_id", F.array("o_orderpriority").alias("texts"))
    rows = manifests.build_manifest(keep, metadata, index, language, objects)
    return rows.groupBy("reason").agg(_rows(), F.sum("eligible_steps").alias("eligible_steps"), F.coalesce(F.sum("delta"), F.lit(0)).alias("delta"))


_ALPHAS = (0.0, 1.0, 10.0, 100.0, 1000.0)
_ALPHA_SQL = ", ".join(f"({a}::DOUBLE)" for a in _ALPHAS)


@query(
    f"WITH {_SPLIT_TICKS}, t AS (SELECT event_type, avg(tick) AS mx, avg(value) AS my, sum(tick * value) - count(*) * avg(tick) * avg(value) AS sxy, sum(tick * tick) - count(*) * avg(tick) * avg(tick) AS sxx FROM s WHERE split = 'train' GROUP BY 1), "
    f"a AS (SELECT event_type, alpha, mx, my, sxy / (sxx + alpha) AS w FROM t CROSS JOIN (VALUES {_ALPHA_SQL}) v(alpha)), e AS (SELECT event_type, alpha, split, 1 - avg((value - my - w * (tick - mx)) * (value - my - w * (tick - mx))) / avg((value - my) * (value - my)) AS reduction FROM s JOIN a USING (event_type) WHERE split <> 'train' GROUP BY 1, 2, 3), "
    "r AS (SELECT event_type, split, alpha, round(reduction, 8) AS reduction FROM e), b AS (SELECT event_type, arg_max(alpha, (reduction, -alpha)) AS alpha FROM r WHERE split = 'val' GROUP BY 1) SELECT event_type, split, alpha, round(reduction, 6) AS reduction FROM r JOIN b USING (event_type, alpha)"
)
def alpha_selection(spark, sf_dir):
    """REG-10, INL-7: the ridge's strength by (reduction, least alpha) on validation rows alone; sums of the splits are all it needs."""
    x, y = F.col("tick").cast("double"), F.col("value")
    rows = _split_ticks(spark, sf_dir)
    sums = rows.groupBy("event_type", "split").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"))
    n = F.col("n")
    train = sums.where("split = 'train'").select("event_type", (F.col("x") / n).alias("mx"), (F.col("y") / n).alias("my"), (F.col("xy") - F.col("x") * F.col("y") / n).alias("sxy"), (F.col("xx") - F.col("x") * F.col("x") / n).alias("sxx"))
    each = train.withColumn("alpha", F.explode(F.array(*map(F.lit, _ALPHAS)))).withColumn("w", F.col("sxy") / (F.col("sxx") + F.col("alpha")))
    mx, my, w = F.col("mx"), F.col("my"), F.col("w")
    held = sums.where("split <> 'train'").join(each, "event_type")
    ss_y = F.col("yy") - 2 * my * F.col("y") + n * my * my
    ss_x = F.col("xx") - 2 * mx * F.col("x") + n * mx * mx
    s_xy = F.col("xy") - mx * F.col("y") - my * F.col("x") + n * mx * my
    r = held.select("event_type", "split", "alpha", F.round((2 * w * s_xy - w * w * ss_x) / ss_y, 8).alias("reduction"))
    best = r.where("split = 'val'").groupBy("event_type").agg(F.max_by("alpha", F.struct("reduction", -F.col("alpha"))).alias("alpha"))
    return r.join(best, ["event_type", "alpha"]).select("event_type", "split", "alpha", F.round("reduction", 6).alias("reduction"))


_FAMILIES = ("l_returnflag", "l_linestatus", "l_linenumber")
_SETS = [list(c) for k in range(len(_FAMILIES) + 1) for c in combinations(_FAMILIES, k)]
_NAMED = {"+".join(s) or "none": s for s in _SETS}


def _left_sql() -> str:
    each = " UNION ALL ".join(f"SELECT '{name}' AS families, {len(keys)} AS size, count(*) AS cells, sum(s * s / n) AS fit FROM (SELECT count(*) AS n, sum(y) AS s FROM r {'GROUP BY ' + ', '.join(keys) if keys else ''})" for name, keys in _NAMED.items())
    return f"WITH r AS (SELECT *, l_extendedprice / l_quantity AS y FROM lineitem), g AS ({each}), t AS (SELECT sum(y * y) AS yy, sum(y) * sum(y) / count(*) AS none FROM r), e AS (SELECT families, size, cells, (fit - none) / (yy - none) AS reduction FROM g, t)"


@query(_left_sql() + " SELECT families, size, cells, round(reduction, 6) AS reduction FROM e")
def family_reductions(spark, sf_dir):
    """AGG-17, REG-14: what every set of families explains, from one pass of grouping sets over counts and sums."""
    return _reductions(spark, sf_dir).select("families", "size", "cells", F.round("reduction", 6).alias("reduction"))


def _reductions(spark, sf_dir):
    y = F.col("l_extendedprice") / F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(*_FAMILIES, y.alias("y"))
    cube = rows.cube(*_FAMILIES).agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    fits = cube.groupBy("gid").agg(F.count(F.lit(1)).alias("cells"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("fit"), F.sum("yy").alias("yy"))
    top = len(_FAMILIES) - 1
    gid = {name: sum(1 << (top - k) for k, f in enumerate(_FAMILIES) if f not in keys) for name, keys in _NAMED.items()}
    name = F.create_map(*(F.lit(x) for n, g in gid.items() for x in (g, n)))
    whole = fits.where(F.col("gid") == gid["none"]).select(F.col("fit").alias("none"))  # one row
    sized = fits.withColumn("families", F.element_at(name, F.col("gid").cast("int"))).crossJoin(F.broadcast(whole))
    size = F.when(F.col("families") == "none", 0).otherwise(F.size(F.split("families", r"\+")))
    return sized.select("families", size.alias("size"), "cells", ((F.col("fit") - F.col("none")) / (F.col("yy") - F.col("none"))).alias("reduction"))


@query(
    _left_sql() + ", j AS (SELECT max(reduction) FILTER (WHERE size = 3) AS joint, max(reduction) FILTER (WHERE size = 1) AS single, arg_max(families, (round(reduction, 9), families)) FILTER (WHERE size = 1) AS best, joint - max(reduction) FILTER (WHERE size = 2) AS least_increment FROM e) "
    "SELECT best, round(joint, 6) AS joint, round(joint - single, 6) AS gain, round(least_increment, 6) AS least_increment, CASE WHEN joint - single < 0.0001 OR least_increment < 0 THEN 'fail' ELSE 'pass' END AS status FROM j"
)
def family_complementarity(spark, sf_dir):
    """INL-6, GAT-07: the joint reduction against the best single family and with each family left out."""
    one = lambda k: F.max(F.when(F.col("size") == k, F.col("reduction")))
    best = F.max_by("families", F.when(F.col("size") == 1, F.struct(F.round("reduction", 9), "families")))
    j = _reductions(spark, sf_dir).agg(one(3).alias("joint"), one(1).alias("single"), best.alias("best"), (one(3) - one(2)).alias("least_increment"))
    gain = F.col("joint") - F.col("single")
    return j.select("best", F.round("joint", 6).alias("joint"), F.round(gain, 6).alias("gain"), F.round("least_increment", 6).alias("least_increment"), F.when((gain < 0.0001) | (F.col("least_increment") < 0), "fail").otherwise("pass").alias("status"))


_PREFIX = f"WITH {_SPLIT_TICKS}, f AS (SELECT split, event_type, 0 AS depth, 0 AS a, 0 AS b, value FROM s UNION ALL SELECT split, event_type, 1, tick % 4, 0, value FROM s UNION ALL SELECT split, event_type, 2, tick % 4, user_id % 3, value FROM s), g AS (SELECT split, event_type, depth, a, b, count(*) AS n, sum(value) AS s, sum(value * value) AS q FROM f GROUP BY ALL), d AS (SELECT split, event_type, depth, round(sum(q - s * s / n) / sum(n), 6) AS mse FROM g GROUP BY ALL)"


def _prefix_errors(spark, sf_dir):
    v = F.col("value")
    cells = _split_ticks(spark, sf_dir).rollup("split", "event_type", (F.col("tick") % 4).alias("a"), (F.col("user_id") % 3).alias("b")).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q")
    ).where("gid <= 3")
    depth = F.when(F.col("gid") == 0, 2).when(F.col("gid") == 1, 1).otherwise(0)
    return cells.groupBy("split", "event_type", depth.alias("depth")).agg(F.round(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.sum("n"), 6).alias("mse"))


@query(_PREFIX + " SELECT event_type, split, arg_min(depth, (mse, depth)) AS depth, min(mse) AS mse FROM d GROUP BY 1, 2")
def best_prefix(spark, sf_dir):
    """INL-3: the prefix of most reduction, the shortest of equal ones."""
    return audits.best_depth(_prefix_errors(spark, sf_dir), ["event_type", "split"])


@query(_PREFIX + " SELECT event_type, split, string_agg(depth::VARCHAR || ':' || round(mse, 3)::DECIMAL(18, 3)::VARCHAR, ',' ORDER BY depth) AS by_depth, list(depth ORDER BY depth) = [0, 1, 2] AS complete FROM d GROUP BY 1, 2")
def prefix_profiles(spark, sf_dir):
    """INL-4, INL-5: rows by depth become one array by depth, which must hold every depth once."""
    rows = audits.depth_profiles(_prefix_errors(spark, sf_dir).withColumn("mse", F.round("mse", 3).cast("decimal(18,3)")), ["event_type", "split"], (0, 1, 2))
    shown = F.array_join(F.transform("profile", lambda x: F.concat_ws(":", x["depth"].cast("string"), x["error"].cast("string"))), ",")
    return rows.select("event_type", "split", shown.alias("by_depth"), "complete")


@query("WITH w AS (SELECT l_orderkey // 2 AS window_id, l_orderkey AS ref, l_linenumber AS start, l_linenumber + 3 AS stop, l_returnflag AS role FROM lineitem), e AS (SELECT o_orderkey AS id, o_custkey % 9 + 2 AS steps, o_orderstatus AS split FROM orders), j AS (SELECT *, count(*) OVER (PARTITION BY window_id, start) > 1 AS repeated FROM w LEFT JOIN e ON ref = id) SELECT coalesce(split, '-') AS split, role, count(*) AS windows, count(*) FILTER (WHERE repeated) AS repeated, count(*) FILTER (WHERE id IS NULL) AS unknown, count(*) FILTER (WHERE stop > steps) AS beyond, coalesce(sum(greatest(least(stop, steps) - start, 0)), 0)::BIGINT AS actions FROM j GROUP BY 1, 2")
def cache_finalize(spark, sf_dir):
    """SNK-10, SNK-11, PRJ-28: windows against their episodes: repeated ids, unknown references, ends beyond the episode, and actions by split and role."""
    w = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 2).alias("window_id"), F.col("l_orderkey").alias("ref"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 3).alias("stop"), F.col("l_returnflag").alias("role"))
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 9 + 2).alias("steps"), F.col("o_orderstatus").alias("split"))
    return audits.windows_against_episodes(w, e, ["window_id", "start"], "ref", "start", "stop", "role", "id", "steps", "split")


@query("SELECT p_brand AS run, count(DISTINCT p_size % 2) AS pools, count(DISTINCT p_type) = count(*) AS distinct_types, min(p_retailprice) = max(p_retailprice) AS one_price, count(DISTINCT p_name) AS names, count(*) AS n FROM part GROUP BY 1")
def run_identity(spark, sf_dir):
    """JON-18, JON-24, SUP-07, INL-9: what all artifacts of a run must share, and what must differ."""
    counted = {"pools": F.col("p_size") % 2, "names": F.col("p_name")}
    return audits.run_consistency(table(spark, sf_dir, "part"), "p_brand", counted, {"distinct_types": F.col("p_type")}, {"one_price": F.col("p_retailprice")})


@query("WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, round(c_acctbal, 2) AS v FROM customer), s AS (SELECT s_suppkey AS k, s_nationkey AS n, round(s_acctbal, 2) AS v FROM supplier) SELECT (SELECT count(*) FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM s)) AS only_left, (SELECT count(*) FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM c)) AS only_right, (SELECT count(*) FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM c)) AS with_itself")
def tables_equal(spark, sf_dir):
    """SUP-12, SUP-22, SNK-19: two tables are equal if neither has a row more; repeated rows count, nulls are equal."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), F.round("c_acctbal", 2).alias("v"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"), F.round("s_acctbal", 2).alias("v"))
    with_itself = audits.row_differences(c, c).select(F.col("only_left").alias("with_itself"))
    return audits.row_differences(c, s).crossJoin(F.broadcast(with_itself))  # one row each


@query(f"WITH {_SPLIT_TICKS}, p AS (SELECT event_type, avg(value) AS m FROM s WHERE split = 'train' GROUP BY 1) SELECT event_type, split, count(*) AS n, round(avg((value - m) * (value - m)), 6) AS mean_square FROM s JOIN p USING (event_type) GROUP BY 1, 2")
def residual_mean_square(spark, sf_dir):
    """CLU-08: the mean square of what a codebook leaves over, by split."""
    m = metrics.moments(_split_ticks(spark, sf_dir), "value", ["event_type", "split"], 0.0)
    train = m.where("split = 'train'").select("event_type", F.col("mean").alias("m"))
    left = F.col("std") * F.col("std") + (F.col("mean") - F.col("m")) * (F.col("mean") - F.col("m"))
    return m.join(train, "event_type").select("event_type", "split", "n", F.round(left, 6).alias("mean_square"))


@query(f"WITH {TICKS} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id % 8 ORDER BY user_id, tick) - 1 AS position FROM ticks")
def batch_positions(spark, sf_dir):
    """SUP-18: the place of each key in its batch."""
    t = ticks(spark, sf_dir)
    return t.select("user_id", "event_id", (F.row_number().over(Window.partitionBy(F.col("user_id") % 8).orderBy("user_id", "tick")) - 1).cast("long").alias("position"))


@query(f"WITH {_SPLIT_TICKS}, c AS (SELECT user_id % 4 AS ctx, event_type, count(*) AS n FROM s WHERE split = 'train' GROUP BY 1, 2), p AS (SELECT ctx, event_type, (n + 1.0) / (sum(n) OVER (PARTITION BY ctx) + 5.0) AS p FROM c) SELECT s.split, count(*) AS n, round(avg(-ln(p)), 6) AS nll, round(avg(CASE WHEN p > 0.2 THEN 1.0 ELSE 0.0 END), 6) AS above_chance FROM s JOIN p ON s.user_id % 4 = p.ctx AND s.event_type = p.event_type GROUP BY 1")
def code_log_likelihood(spark, sf_dir):
    """SUP-47: mean negative log probability of the true code under smoothed counts of its context."""
    s = _split_ticks(spark, sf_dir).withColumn("ctx", F.col("user_id") % 4)
    c = s.where("split = 'train'").groupBy("ctx", "event_type").agg(_rows())
    p = c.withColumn("p", (F.col("n") + 1.0) / (F.sum("n").over(Window.partitionBy("ctx")) + 5.0)).drop("n")
    hits = s.groupBy("split", "ctx", "event_type").agg(_rows()).join(p, ["ctx", "event_type"])
    n, lp = F.col("n"), F.log("p")
    return hits.groupBy("split").agg(F.sum("n").alias("n"), F.round(-F.sum(n * lp) / F.sum("n"), 6).alias("nll"), F.round(F.sum(F.when(F.col("p") > 0.2, n).otherwise(0)) / F.sum("n"), 6).alias("above_chance"))


@query(f"WITH {TICKS}, m AS (SELECT event_type, median(value) FILTER (WHERE tick % 3 = 0) AS inside, median(value) FILTER (WHERE tick % 3 <> 0) AS outside FROM ticks GROUP BY 1) SELECT event_type, round(inside / nullif(outside, 0), 6) AS ratio, printf('%.2f%%', 100 * inside / nullif(outside, 0)) AS shown FROM m")
def median_ratios(spark, sf_dir):
    """FUN-27, FUN-29, FUN-36: the ratio of medians inside and outside of ranges, and as a report shows it."""
    inside = F.col("tick") % 3 == 0
    m = ticks(spark, sf_dir).groupBy("event_type").agg(F.median(F.when(inside, F.col("value"))).alias("i"), F.median(F.when(~inside, F.col("value"))).alias("o"))
    ratio = F.try_divide(F.col("i"), F.col("o"))
    return m.select("event_type", F.round(ratio, 6).alias("ratio"), F.format_string("%.2f%%", 100 * ratio).alias("shown"))


@query("SELECT doc_id, printf('doc-%05d-', doc_id) || substr(sha256(source || '|' || doc_id::VARCHAR), 1, 12) AS episode_id, length(coalesce(decode(encode(text)), '')) AS decoded FROM documents")
def episode_ids(spark, sf_dir):
    """FUN-04, FUN-05: a number and the beginning of a hash name an episode; bytes are read as text."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.format_string("doc-%05d-", "doc_id"), F.substring(F.sha2(F.concat_ws("|", F.col("source"), F.col("doc_id").cast("string")), 256), 1, 12))
    return d.select("doc_id", name.alias("episode_id"), F.length(F.coalesce(F.decode(F.encode("text", "UTF-8"), "UTF-8"), F.lit(""))).cast("long").alias("decoded"))


_OFFSETS = (-10, -6, -5, -4, -3, -2, 0)


@query(f"WITH {TICKS}, w AS (SELECT user_id, tick, " + ", ".join(f"lag(value, {-o}) OVER (PARTITION BY user_id ORDER BY tick) AS o{-o}" for o in _OFFSETS) + " FROM ticks) SELECT * FROM w WHERE tick >= 10")
def causal_offsets(spark, sf_dir):
    """JON-07: the union of the causal offsets that several artifacts need, in one row a tick."""
    order = Window.partitionBy("user_id").orderBy("tick")
    w = ticks(spark, sf_dir).select("user_id", "tick", *(F.lag("value", -o).over(order).alias(f"o{-o}") for o in _OFFSETS))
    return w.where("tick >= 10")


@query("SELECT vec_id, round(embedding[3]::DOUBLE, 4) AS first, round(embedding[1]::DOUBLE, 4) AS second FROM embeddings")
def selected_features(spark, sf_dir):
    """PRJ-07: values of the cameras asked for, in the order asked for."""
    cameras, wanted = F.array(*map(F.lit, ("left", "right", "wrist"))), F.array(F.lit("wrist"), F.lit("left"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 3).cast("array<double>").alias("x"))
    picked = e.withColumn("p", F.transform(wanted, lambda c: F.element_at("x", F.array_position(cameras, c).cast("int"))))
    return picked.select("vec_id", F.round(F.get("p", F.lit(0)), 4).alias("first"), F.round(F.get("p", F.lit(1)), 4).alias("second"))


@query(f"WITH {MANIFEST}, c AS (SELECT l_orderkey AS ref, l_suppkey AS shard, l_linenumber AS clip FROM lineitem WHERE l_returnflag = 'R'), j AS (SELECT *, s_nationkey FROM c LEFT JOIN manifest ON ref = episode_id LEFT JOIN supplier ON shard = s_suppkey) SELECT coalesce(institution_id, '-') AS institution, count(*) AS clips, count(*) FILTER (WHERE episode_id IS NULL) AS no_episode, count(*) FILTER (WHERE s_nationkey IS NULL) AS no_shard, count(DISTINCT scene_id) AS scenes FROM j GROUP BY 1")
def clip_resolution(spark, sf_dir):
    """JON-08: clips looked up in the manifest and among shards; what is missing at each hop."""
    c = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("ref"), F.col("l_suppkey").alias("shard"))
    hops = {"no_episode": (manifest(spark, sf_dir), "ref", "episode_id"), "no_shard": (table(spark, sf_dir, "supplier").select("s_suppkey"), "shard", "s_suppkey")}
    return audits.lookup_losses(c, hops, F.coalesce("institution_id", F.lit("-")).alias("institution"), {"scenes": "scene_id"}, "clips")


@query(f"WITH {MANIFEST}, q AS (SELECT l_orderkey AS e, sum(l_quantity) AS motion, count(*) AS steps FROM lineitem GROUP BY 1) SELECT institution_id, count(*) AS records, count(motion) AS measured, round(avg(motion / steps), 6) AS motion FROM manifest LEFT JOIN q ON e = episode_id GROUP BY 1")
def motion_audit(spark, sf_dir):
    """JON-21: measurements of episodes beside their records; records without any show as a difference of counts."""
    q = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("episode_id")).agg(F.sum("l_quantity").alias("motion"), F.count(F.lit(1)).alias("steps"))
    found = audits.measured_records(manifest(spark, sf_dir), q, "episode_id", "institution_id", F.col("motion") / F.col("steps"))
    return found.select("institution_id", "records", "measured", F.round("mean", 6).alias("motion"))


@query("WITH m AS (SELECT event_type AS family, CASE user_id % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'natural' ELSE 'blur' END AS condition, event_id // 4 AS clip, value FROM events), g AS (SELECT family, condition, count(*) AS n, avg(value) AS v FROM m GROUP BY 1, 2), o AS (SELECT a.family, avg(CASE WHEN round(a.value, 0) <> round(b.value, 0) THEN 1.0 ELSE 0.0 END) AS opposite FROM m a JOIN m b ON a.family = b.family AND a.clip = b.clip AND a.condition = 'left' AND b.condition = 'right' GROUP BY 1) SELECT g.family, g.condition, g.n, round(g.v, 6) AS mean, round(g.v / x.v, 6) AS to_natural, round(opposite, 6) AS opposite FROM g LEFT JOIN g x ON x.family = g.family AND x.condition = 'natural' LEFT JOIN o ON o.family = g.family")
def perturbation_summary(spark, sf_dir):
    """AGG-46: means by family and condition, against the natural step, and how often opposite conditions differ."""
    k = F.col("user_id") % 4
    condition = F.when(k == 0, "left").when(k == 1, "right").when(k == 2, "natural").otherwise("blur")
    m = table(spark, sf_dir, "events").select(F.col("event_type").alias("family"), condition.alias("condition"), F.floor(F.col("event_id") / 4).alias("clip"), "value")
    found = audits.condition_summary(m, "family", "condition", "clip", "value", "natural", ("left", "right"), F.round("value", 0))
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "to_natural", "opposite")})


@query(f"WITH {TICKS}, l AS (SELECT event_type, tick % 6 AS code, value, lag(value) OVER (PARTITION BY user_id ORDER BY tick) AS before FROM ticks) SELECT code, count(*) AS n, round(avg(CASE WHEN abs(value - before) > 10 THEN 1.0 ELSE 0.0 END), 6) AS changed, round(sum(value), 3) AS total, round(avg(abs(value - before)), 6) AS step FROM l WHERE before IS NOT NULL GROUP BY 1")
def change_by_code(spark, sf_dir):
    """INL-10, AGG-17: how often and how far values change, by true code."""
    rows = audits.change_by_code(ticks(spark, sf_dir).withColumn("code", F.col("tick") % 6), "user_id", "tick", "code", "value", 10)
    return rows.select("code", "n", F.round("changed", 6).alias("changed"), F.round("total", 3).alias("total"), F.round("step", 6).alias("step"))


@query("WITH w AS (SELECT l_orderkey AS parent, count(*) AS windows FROM lineitem GROUP BY 1), t AS (SELECT o_orderkey AS parent, length(o_orderpriority) AS tokens FROM orders WHERE o_orderpriority <> '3-MEDIUM') SELECT count(*) AS parents, count(tokens) AS covered, count(*) - count(tokens) AS missing, sum(CASE WHEN tokens IS NOT NULL THEN windows * tokens ELSE 0 END)::BIGINT AS tokens FROM w LEFT JOIN t USING (parent)")
def language_coverage(spark, sf_dir):
    """JON-16: windows joined to the text of their parent, which must be there for all."""
    w = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent"))
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("parent"), F.when(F.col("o_orderpriority") != "3-MEDIUM", F.length("o_orderpriority")).alias("tokens"))
    return audits.text_coverage(w, t, "parent", "tokens")


_HEALTH = {"used": ("used", 0.9, None, True), "perplexity": ("perplexity", 1.5, None, True), "most": ("most", None, 0.6, False), "median_most": ("median_most", None, 0.5, False)}


@query(
    "WITH c AS (SELECT user_id % 12 AS family, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT family, sum(n) AS total FROM c GROUP BY 1), u AS (SELECT family, count(*) / 5.0::DOUBLE AS used, max(n / total) AS most, exp(-sum(n / total * ln(n / total))) AS perplexity FROM c JOIN t USING (family) GROUP BY 1), m AS (SELECT *, (SELECT median(most) FROM u) AS median_most FROM u), "
    "g AS (SELECT 'used' AS gate, min(used) < 0.9 AS failed, true AS blocker FROM m UNION ALL SELECT 'perplexity', min(perplexity) < 1.5, true FROM m UNION ALL SELECT 'most', max(most) > 0.6, false FROM m UNION ALL SELECT 'median_most', max(median_most) > 0.5, false FROM m) SELECT CASE WHEN bool_or(failed AND blocker) THEN 'not_ready' WHEN bool_or(failed) THEN 'conditional_pass' ELSE 'pass' END AS decision, count(*) FILTER (WHERE failed) AS failed FROM g"
)
def usability_decision(spark, sf_dir):
    """GAT-05, GAT-06, GAT-08, GAT-11, GAT-15: health of every family against its bounds, medians too, and the decision that follows."""
    n = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 12).alias("family"), "event_type").agg(_rows())
    total, nlogn = F.sum("n"), F.sum(F.col("n") * F.log("n"))
    use = n.groupBy("family").agg((F.count(F.lit(1)) / F.lit(5.0)).alias("used"), (F.max("n") / total).alias("most"), F.exp(F.log(total) - nlogn / total).alias("perplexity"))
    use = use.crossJoin(use.agg(F.median("most").alias("median_most")))  # one row
    return gates.overall(gates.bounds(use, _HEALTH))


_ROUNDS = 3


def _kmeans_sql() -> str:
    sql = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), c0 AS (SELECT row_number() OVER (ORDER BY label) - 1 AS k, arg_min(x, vec_id) AS x FROM v GROUP BY label)"
    for r in range(_ROUNDS):
        sql += f", a{r} AS (SELECT vec_id, v.x AS x, arg_min(k, (list_distance(v.x, c{r}.x), k)) AS k, min(list_distance(v.x, c{r}.x)) AS d FROM v CROSS JOIN c{r} GROUP BY 1, 2)"
        sql += f", m{r} AS (SELECT k, i, avg(x[i]) AS m FROM a{r} CROSS JOIN range(1, 65) t(i) GROUP BY 1, 2), c{r + 1} AS (SELECT k, list(m ORDER BY i) AS x FROM m{r} GROUP BY 1)"
    each = " UNION ALL ".join(f"SELECT {r} AS round, count(*) AS n, count(DISTINCT k) AS used, round(sum(d * d), 5) AS inertia FROM a{r}" for r in range(_ROUNDS))
    return sql + " " + each


@query(_kmeans_sql())
def kmeans_rounds(spark, sf_dir):
    """CLU-04, CLU-12, CLU-16: three rounds of Lloyd's iterations from fixed centers: inertia and codes in use."""
    from ..operators import clustering

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")
    first = vectors.groupBy("label").agg(F.min_by("x", "vec_id").alias("x")).orderBy("label").collect()  # a row a label
    curve = clustering.lloyd_from(vectors.select("vec_id", "x"), "x", [list(r["x"]) for r in first], _ROUNDS)
    return spark.createDataFrame([(k, int(n), int(used), round(float(v), 5)) for k, (n, used, v) in enumerate(curve)], "round int, n long, used long, inertia double")


@query()
def mixed_ridge(spark, sf_dir):
    """REG-07, REG-08, REG-09, AGG-18: held-out error of a ridge on continuous columns and codes together."""
    rows = _coded(spark, sf_dir).withColumn("t", F.col("tick").cast("double"))
    model = readouts.mixed_ridge(rows.where("split = 'train'"), ["value", "t"], ["c1", "c2"], "target", 8.0)
    out = readouts.predict_mixed(rows, model)
    return out.groupBy("split").agg(_rows(), F.avg((F.col("target") - F.col("prediction")) ** 2).alias("mse"), F.avg(F.col("all_seen").cast("double")).alias("seen"))


@query("SELECT l_orderkey, l_linenumber, o_custkey, round(l_extendedprice, 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey IN (SELECT o_orderkey FROM orders ORDER BY sha256('wanted|' || o_orderkey::VARCHAR) LIMIT 50)")
def segment_lookup(spark, sf_dir):
    """SRC-26, SRC-29, JON-14, JON-26: the rows of fifty segments asked for by id, as a join on keys."""
    from ..functions.scalar import score

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    wanted = o.orderBy(score("wanted", F.col("o_orderkey"))).limit(50)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return lines.join(F.broadcast(wanted), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey", F.round("l_extendedprice", 2).alias("price"))
