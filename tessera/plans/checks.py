"""Queries that validate, compare and select: constraints, coverage, exports, gates, plans, index columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import score
from ..operators import gates, metrics, sampling
from ..registry import query
from ..sources import contracts, files
from ..sources.tables import MANIFEST, TICKS, manifest, table, ticks
from .models import _DELTA, _deltas
from .series import SPLIT_SQL


def _rows():
    return F.count(F.lit(1)).alias("n")
_HOLED = "holed AS (SELECT episode_id, CASE WHEN episode_id % 5 <> 0 THEN institution_id END AS institution, CASE WHEN episode_id % 3 <> 0 THEN building_id END AS building, CASE WHEN episode_id % 2 <> 0 THEN scene_id::VARCHAR END AS scene FROM manifest)"
_LEVELS = ("institution", "building", "scene")


def _key_sql(level: str) -> str:
    at = _LEVELS.index(level)
    whens = "".join(f" WHEN {c} IS NOT NULL THEN concat_ws('/', '{c}', {', '.join(f'coalesce({p}, {chr(39)}_{chr(39)})' for p in _LEVELS[:k])}{', ' if k else ''}{c})" for k, c in enumerate(_LEVELS) if k >= at)
    return f"CASE{whens} ELSE concat_ws('/', 'episode', episode_id::VARCHAR) END"


@query(f"WITH {MANIFEST}, {_HOLED}, g AS (" + " UNION ALL ".join(f"SELECT '{c}' AS level, {_key_sql(c)} AS key FROM holed" for c in _LEVELS) + ") SELECT level, split_part(key, '/', 1) AS kind, count(*) AS episodes, count(DISTINCT key) AS groups FROM g GROUP BY 1, 2")
def hierarchical_group_keys(spark, sf_dir):
    """PRJ-02: the key at each level, or at the next finer level that is known; unknown parents are ``_``."""
    e = F.col("episode_id")
    rows = manifest(spark, sf_dir).select(
        "episode_id", F.when(e % 5 != 0, F.col("institution_id")).alias("institution"), F.when(e % 3 != 0, F.col("building_id")).alias("building"), F.when(e % 2 != 0, F.col("scene_id").cast("string")).alias("scene")
    )

    def key(at: int):
        out = F.concat_ws("/", F.lit("episode"), e.cast("string"))
        for k in reversed(range(at, 3)):
            parents = [F.coalesce(F.col(p), F.lit("_")) for p in _LEVELS[:k]]
            out = F.when(F.col(_LEVELS[k]).isNotNull(), F.concat_ws("/", F.lit(_LEVELS[k]), *parents, F.col(_LEVELS[k]))).otherwise(out)
        return out

    keyed = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("level"), key(k).alias("key")) for k, c in enumerate(_LEVELS)))).alias("g")).select("g.*")
    return keyed.groupBy("level", F.substring_index("key", "/", 1).alias("kind")).agg(F.count(F.lit(1)).alias("episodes"), F.count_distinct("key").alias("groups"))


@query("SELECT 'price' AS rule, count(*) FILTER (WHERE NOT coalesce(o_totalprice > 1000, false)) AS violations FROM orders UNION ALL SELECT 'status', count(*) FILTER (WHERE NOT coalesce(o_orderstatus IN ('O', 'F'), false)) FROM orders UNION ALL SELECT 'task', count(*) FILTER (WHERE NOT coalesce(length(o_orderpriority) > 0, false)) FROM orders")
def row_constraints(spark, sf_dir):
    """PRJ-04, PRJ-05."""
    return contracts.violations(table(spark, sf_dir, "orders"), {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus").isin("O", "F"), "task": F.length("o_orderpriority") > 0})


@query("WITH r AS (SELECT l_orderkey AS e, l_suppkey % 50 AS a, l_suppkey % 50 + l_quantity::BIGINT AS b FROM lineitem), o AS (SELECT e, b, lead(a) OVER (PARTITION BY e ORDER BY a, b) AS following FROM r), v AS (SELECT e, count(*) FILTER (WHERE following < b) AS crossing, count(*) FILTER (WHERE b > 80) AS beyond FROM o GROUP BY 1) SELECT crossing, beyond, count(*) AS episodes FROM v GROUP BY 1, 2")
def keep_range_violations(spark, sf_dir):
    """PRJ-14, PRJ-15, PRJ-22: half-open ranges of an episode that overlap the next, or leave its 80 steps."""
    a = F.col("l_suppkey") % 50
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("e"), a.alias("a"), (a + F.col("l_quantity").cast("long")).alias("b"))
    rows = rows.withColumn("following", F.lead("a").over(Window.partitionBy("e").orderBy("a", "b")))
    each = rows.groupBy("e").agg(F.count_if(F.col("following") < F.col("b")).alias("crossing"), F.count_if(F.col("b") > 80).alias("beyond"))
    return each.groupBy("crossing", "beyond").agg(F.count(F.lit(1)).alias("episodes"))


@query("WITH m AS (SELECT l_orderkey AS e, min(l_linenumber) AS a, max(l_linenumber) AS b FROM lineitem GROUP BY 1), f AS (SELECT e, l_linenumber = 1 AS first, l_linenumber = b AS last, l_returnflag = 'R' AS terminal FROM lineitem JOIN m ON l_orderkey = e), v AS (SELECT e, count(*) FILTER (WHERE first) <> 1 AS bad_first, count(*) FILTER (WHERE last) <> 1 AS bad_last, count(*) FILTER (WHERE terminal AND NOT last) > 0 AS early_end FROM f GROUP BY 1) SELECT bad_first, bad_last, early_end, count(*) AS episodes FROM v GROUP BY 1, 2, 3")
def step_flag_violations(spark, sf_dir):
    """PRJ-16, PRJ-20: one first step, one last, and no end before it."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("e"), "l_linenumber", "l_returnflag")
    rows = rows.withColumn("last", F.col("l_linenumber") == F.max("l_linenumber").over(Window.partitionBy("e")))
    each = rows.groupBy("e").agg((F.count_if(F.col("l_linenumber") == 1) != 1).alias("bad_first"), (F.count_if("last") != 1).alias("bad_last"), F.bool_or((F.col("l_returnflag") == "R") & ~F.col("last")).alias("early_end"))
    return each.groupBy("bad_first", "bad_last", "early_end").agg(F.count(F.lit(1)).alias("episodes"))


@query("WITH f AS (SELECT CASE WHEN o_custkey % 3 <> 0 THEN o_custkey ELSE o_custkey + 1000000000 END AS id, count(DISTINCT o_orderpriority) AS parts FROM orders GROUP BY 1), j AS (SELECT c_custkey, id, parts FROM customer FULL JOIN f ON c_custkey = id) SELECT count(*) FILTER (WHERE parts > 1) AS repeated, count(*) FILTER (WHERE id IS NULL) AS missing, count(*) FILTER (WHERE c_custkey IS NULL) AS unexpected, count(*) FILTER (WHERE c_custkey = id) AS found FROM j")
def partition_coverage(spark, sf_dir):
    """SET-01, SRC-30: parts must not share an id, and together hold all that are expected.  A third of the ids is changed, so that some are missing and some unexpected."""
    customer = F.col("o_custkey")
    found = table(spark, sf_dir, "orders").groupBy(F.when(customer % 3 != 0, customer).otherwise(customer + 1000000000).alias("id")).agg(F.count_distinct("o_orderpriority").alias("parts"))
    j = table(spark, sf_dir, "customer").select("c_custkey").join(found, F.col("c_custkey") == F.col("id"), "full")
    return j.agg(F.count_if(F.col("parts") > 1).alias("repeated"), F.count_if(F.col("id").isNull()).alias("missing"), F.count_if(F.col("c_custkey").isNull()).alias("unexpected"), F.count_if(F.col("c_custkey") == F.col("id")).alias("found"))


@query(f"WITH {TICKS}, w AS (SELECT user_id % 10 AS export, user_id % 4 + 2 AS world, CASE WHEN tick < user_id % 7 THEN tick % 5 ELSE 0 END AS rank, max(sec) AS sec FROM ticks GROUP BY 1, 2, 3), c AS (SELECT export, world, max(sec) AS sec FROM w WHERE rank < world GROUP BY 1, 2 HAVING count(DISTINCT rank) = world) SELECT export, arg_max(world, (sec, world)) AS world FROM c GROUP BY 1")
def latest_complete_export(spark, sf_dir):
    """SET-02: of the sizes under which all ranks of an export reported, the one of the latest report.  Later ticks report for the first rank."""
    u, tick = F.col("user_id"), F.col("tick")
    rows = ticks(spark, sf_dir).select((u % 10).alias("export"), (u % 4 + 2).alias("world"), F.when(tick < u % 7, tick % 5).otherwise(0).alias("rank"), "sec")
    complete = rows.where("rank < world").groupBy("export", "world").agg(F.max("sec").alias("sec"), F.count_distinct("rank").alias("ranks")).where("ranks = world")
    return complete.groupBy("export").agg(F.max_by("world", F.struct("sec", "world")).alias("world"))


@query("WITH a AS (SELECT CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey ELSE -o_orderkey END AS k, o_custkey % 7 + 1 AS n FROM orders), b AS (SELECT CASE WHEN l_orderkey % 5 <> 0 THEN l_orderkey ELSE -l_orderkey END AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' WHEN a.n = b.n THEN 'equal' ELSE 'different' END AS status, count(*) AS segments, coalesce(sum(abs(a.n - b.n)), 0)::BIGINT AS difference FROM a FULL JOIN b ON a.k = b.k GROUP BY 1")
def full_outer_equality(spark, sf_dir):
    """JON-17, JON-22: two tables of segments compared by id, then by value.  Some ids of either are negated, so that each has rows the other lacks."""
    altered = lambda c, by: F.when(F.col(c) % by != 0, F.col(c)).otherwise(-F.col(c))
    a = table(spark, sf_dir, "orders").select(altered("o_orderkey", 3).alias("ka"), (F.col("o_custkey") % 7 + 1).alias("na"))
    b = table(spark, sf_dir, "lineitem").groupBy(altered("l_orderkey", 5).alias("kb")).agg(F.count(F.lit(1)).alias("nb"))
    status = F.when(F.col("kb").isNull(), "left_only").when(F.col("ka").isNull(), "right_only").when(F.col("na") == F.col("nb"), "equal").otherwise("different")
    return a.join(b, F.col("ka") == F.col("kb"), "full").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum(F.abs(F.col("na") - F.col("nb"))), F.lit(0)).alias("difference"))


@query(f"WITH {TICKS}, s AS (SELECT *, {SPLIT_SQL} AS split FROM ticks), t AS (SELECT event_type, avg(value) AS m FROM s WHERE split = 'train' GROUP BY 1), e AS (SELECT event_type, split, avg((value - m) * (value - m)) AS mse FROM s JOIN t USING (event_type) GROUP BY 1, 2) SELECT a.event_type, b.split, round(a.mse, 4) AS train, round(b.mse, 4) AS held_out, round(a.mse - b.mse, 4) + 0.0 AS gap FROM e a JOIN e b ON a.event_type = b.event_type AND a.split = 'train' AND b.split <> 'train'")
def train_heldout_gap(spark, sf_dir):
    """JON-11, JON-12: each family's train row beside its held-out rows, from moments of the splits alone."""
    m = metrics.moments(sampling.hash_split(ticks(spark, sf_dir), "user_id", "split"), "value", ["event_type", "split"], 0.0)
    t = m.where("split = 'train'").select("event_type", F.col("mean").alias("m"), (F.col("std") * F.col("std")).alias("train"))
    held = F.col("std") * F.col("std") + (F.col("mean") - F.col("m")) * (F.col("mean") - F.col("m"))
    rows = m.where("split <> 'train'").join(t, "event_type").select("event_type", "split", "train", held.alias("held_out"))
    return rows.select("event_type", "split", F.round("train", 4).alias("train"), F.round("held_out", 4).alias("held_out"), (F.round(F.col("train") - F.col("held_out"), 4) + F.lit(0.0)).alias("gap"))


@query(f"WITH {MANIFEST} SELECT building_id AS shard, count(*) AS episodes, count(DISTINCT scene_id * 40 + episode_id % 40) = count(*) AS unique_positions, min(institution_id) = max(institution_id) AS consistent FROM manifest GROUP BY 1")
def shard_work(spark, sf_dir):
    """TOP-30: a shard's episodes, whether their positions are unique and their shared fields agree."""
    position = F.col("scene_id") * 40 + F.col("episode_id") % 40
    return manifest(spark, sf_dir).groupBy(F.col("building_id").alias("shard")).agg(F.count(F.lit(1)).alias("episodes"), (F.count_distinct(position) == F.count(F.lit(1))).alias("unique_positions"), (F.min("institution_id") == F.max("institution_id")).alias("consistent"))


@query("SELECT event_id, round(abs(value - 50), 6) AS distance FROM events ORDER BY abs(value - 50) DESC, event_id LIMIT 20")
def hardest_rows(spark, sf_dir):
    """TOP-03, TOP-04: the twenty rows farthest from the center; each task keeps twenty."""
    rows = table(spark, sf_dir, "events").withColumn("d", F.abs(F.col("value") - 50)).orderBy(F.desc("d"), "event_id").limit(20)
    return rows.select("event_id", F.round("d", 6).alias("distance"))


@query(f"WITH {TICKS}, n AS (SELECT user_id, user_id % 20 AS file, count(*) AS n FROM ticks GROUP BY 1), f AS (SELECT file, min(user_id) AS user_id FROM n WHERE n >= 8 GROUP BY 1), p AS (SELECT file, user_id, arg_max(tick, (value, -tick)) AS peak, count(*) AS n FROM f JOIN ticks USING (user_id) GROUP BY 1, 2), w AS (SELECT file, user_id, least(greatest(peak - 4, 0), n - 8) AS start FROM p) SELECT * FROM w ORDER BY sha256('plan|' || file::VARCHAR || '|' || user_id::VARCHAR || '|' || start::VARCHAR) LIMIT 6")
def peak_window_plans(spark, sf_dir):
    """TOP-20, TOP-24: of each file the first long enough episode, a window of 8 about its peak, and 6 of them by hash."""
    t = ticks(spark, sf_dir)
    each = t.groupBy("user_id").agg(_rows(), F.max_by("tick", F.struct("value", -F.col("tick"))).alias("peak")).where("n >= 8").withColumn("file", F.col("user_id") % 20)
    first = each.groupBy("file").agg(F.min_by(F.struct("user_id", "n", "peak"), "user_id").alias("f")).select("file", "f.*")
    w = first.select("file", "user_id", F.least(F.greatest(F.col("peak") - 4, F.lit(0)), F.col("n") - 8).alias("start"))
    return w.orderBy(score("plan", F.col("file"), F.col("user_id"), F.col("start"))).limit(6)


@query(f"WITH {MANIFEST}, s AS (SELECT episode_id, scene_id, sha256('first|' || episode_id::VARCHAR) AS score FROM manifest), r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY score) > 1 AS again FROM s) SELECT episode_id, scene_id FROM r ORDER BY again, score LIMIT 120")
def scenes_first_then_fill(spark, sf_dir):
    """TOP-19."""
    return sampling.groups_first(manifest(spark, sf_dir).select("episode_id", "scene_id"), "scene_id", 120, "episode_id", "first").select("episode_id", "scene_id")


@query()
def scene_round_robin(spark, sf_dir):
    """TOP-13, TOP-14, TOP-15: 40 episodes of each institution over scenes, balanced by status and task."""
    return sampling.scene_round_robin(manifest(spark, sf_dir), ["institution_id"], "building_id", "episode_id", ["status", "task"], 40, "robin")


@query("WITH s AS (SELECT user_id, event_id, row_number() OVER (ORDER BY sha256('deal|' || user_id::VARCHAR), user_id, sha256('deal|' || event_id::VARCHAR), event_id) - 1 AS pos, count(*) OVER () AS total FROM events) SELECT pos % 7 AS rank, count(*) AS n, sum(event_id)::BIGINT AS ids FROM s WHERE pos < total - total % 7 GROUP BY 1")
def rank_indices(spark, sf_dir):
    """TOP-25: shuffled groups and rows dealt to seven ranks of equal size."""
    return sampling.deal_ranks(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 7, "deal").groupBy("rank").agg(_rows(), F.sum("event_id").alias("ids"))


@query("WITH u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS i FROM (SELECT DISTINCT user_id FROM events)) SELECT user_id, i AS code, CASE i % 6 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM u JOIN events USING (user_id) GROUP BY ALL")
def dictionary_codes(spark, sf_dir):
    """SNK-12, TOP-23: dense codes of episodes and the split that follows from them."""
    rows = files.dictionary_codes(table(spark, sf_dir, "events").select("user_id"), "user_id", "code").groupBy("user_id", "code").agg(_rows())
    at = F.col("code") % 6
    return rows.select("user_id", "code", F.when(at == 0, "val").when(at == 1, "test").otherwise("train").alias("split"), "n")


@query("SELECT doc_id, coalesce(sum(coalesce(n_chars, 0)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, sum(coalesce(n_chars, 0)) OVER (ORDER BY doc_id)::BIGINT AS stop FROM documents")
def ragged_offsets(spark, sf_dir):
    """SNK-24, SRC-28: where each row's values lie in one flat array."""
    return files.ragged_offsets(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars").select("doc_id", "start", "stop")


_USE = f"WITH {TICKS}, c AS (SELECT user_id, event_type, count(*) AS n FROM ticks GROUP BY 1, 2), t AS (SELECT user_id, sum(n) AS total FROM c GROUP BY 1), u AS (SELECT user_id, count(*) / 5.0::DOUBLE AS used, max(n) / max(total) AS most, exp(-sum(n / total * ln(n / total))) AS perplexity FROM c JOIN t USING (user_id) GROUP BY 1)"
_LIMITS = {"used": ("used", 0.5, None, True), "most": ("most", None, 0.4, False), "perplexity": ("perplexity", 3.0, None, False)}


@query(_USE + " SELECT 'used' AS gate, round(min(used), 5) AS worst, CASE WHEN bool_or(used < 0.5) THEN 'fail' ELSE 'pass' END AS status, true AS blocker FROM u UNION ALL SELECT 'most', round(max(most), 5), CASE WHEN bool_or(most > 0.4) THEN 'fail' ELSE 'pass' END, false FROM u UNION ALL SELECT 'perplexity', round(min(perplexity), 5), CASE WHEN bool_or(perplexity < 3) THEN 'fail' ELSE 'pass' END, false FROM u")
def threshold_gates(spark, sf_dir):
    """GAT-04 to GAT-12: the worst row decides each gate; all gates in one pass."""
    n = ticks(spark, sf_dir).groupBy("user_id", "event_type").agg(_rows())
    total, nlogn = F.sum("n"), F.sum(F.col("n") * F.log("n"))
    use = n.groupBy("user_id").agg((F.count(F.lit(1)) / F.lit(5.0)).alias("used"), (F.max("n") / total).alias("most"), F.exp(F.log(total) - nlogn / total).alias("perplexity"))
    return gates.bounds(use, _LIMITS).withColumn("worst", F.round("worst", 5))


@query(_DELTA + ", p AS (SELECT d, row_number() OVER (ORDER BY user_id) - 1 AS pos FROM d), s AS (SELECT b.i AS draw, concat('0x', substr(sha256('index|' || b.i::VARCHAR || '|' || q.j::VARCHAR), 1, 12))::BIGINT % (SELECT count(*) FROM d) AS pos FROM range(200) b(i), (SELECT unnest(range(0, (SELECT count(*) FROM d))) AS j) q), m AS (SELECT draw, avg(d) AS m FROM s JOIN p USING (pos) GROUP BY 1), o AS (SELECT list(m ORDER BY m) AS l FROM m) SELECT (SELECT count(*) FROM d) AS n, round(l[5], 5) AS low, round(l[196], 5) AS high FROM o")
def index_bootstrap(spark, sf_dir):
    """GAT-02: ends picked among the sorted means."""
    out = gates.paired_bootstrap(_deltas(spark, sf_dir), "user_id", "d", 200, "index", by_index=True)
    return out.select("n", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


@query("SELECT DISTINCT o_custkey AS parent FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.09)")
def referenced_parents(spark, sf_dir):
    """SET-03, SET-04, SET-05: parents of segments that own a window; the windows are reduced to keys before they meet."""
    used = table(spark, sf_dir, "lineitem").where("l_discount > 0.09").select("l_orderkey")
    o = table(spark, sf_dir, "orders")
    return o.join(used, o.o_orderkey == used.l_orderkey, "left_semi").select(F.col("o_custkey").alias("parent")).distinct()
