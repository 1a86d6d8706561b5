"""Queries over manifests: joins with exclusions, constraints, coverage, statistics, fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import collapse_space
from ..operators import sampling
from ..registry import query
from ..sources import contracts
from ..sources.tables import MANIFEST, manifest, table
from .series import _SPLIT, _U

_REASON = "CASE WHEN l.doc_id IS NULL THEN 'missing_metadata' WHEN l.quality IS NULL OR l.toxic IS NULL THEN 'missing_label' WHEN l.quality = 0 THEN 'quality_flag' WHEN l.toxic = 1 THEN 'failure' WHEN d.n_chars < 200 THEN 'too_short' WHEN d.lang IS NULL THEN 'missing_language' ELSE 'kept' END"


@query(f"WITH n AS (SELECT doc_id, count(*) AS n, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1), r AS (SELECT d.n_chars, CASE WHEN l.n > 1 THEN 'ambiguous' ELSE {_REASON} END AS reason FROM documents d LEFT JOIN n l ON d.doc_id = l.doc_id) SELECT reason, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM r GROUP BY 1")
def manifest_join_exclusions(spark, sf_dir):
    """Documents joined to labels that are unique by id; the first reason that holds excludes a row."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(labels, "doc_id", "left")
    reason = (
        F.when(F.col("n") > 1, "ambiguous").when(F.col("n").isNull(), "missing_metadata").when(F.col("quality").isNull() | F.col("toxic").isNull(), "missing_label")
        .when(F.col("quality") == 0, "quality_flag").when(F.col("toxic") == 1, "failure").when(F.col("n_chars") < 200, "too_short").when(F.col("lang").isNull(), "missing_language").otherwise("kept")
    )
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT n_chars - length(text) AS delta, count(*) AS n FROM documents GROUP BY 1")
def length_delta_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy((F.col("n_chars") - F.length("text")).alias("delta")).agg(F.count(F.lit(1)).alias("n"))


_USPLIT = _SPLIT.format(_U.format("'scene|' || {0}::VARCHAR"))


@query(f"SELECT {_USPLIT.format('c_custkey')} AS split, count(*) AS n, count(DISTINCT c_nationkey) AS buildings FROM customer GROUP BY 1")
def hash_split_customers(spark, sf_dir):
    return sampling.hash_split(table(spark, sf_dir, "customer"), "c_custkey", "scene").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_nationkey").alias("buildings"))


@query(f"WITH {MANIFEST}, s AS (SELECT building_id, {_USPLIT.format('scene_id')} AS split FROM manifest) SELECT building_id, count(DISTINCT split) AS splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1")
def group_isolation_violations(spark, sf_dir):
    """Buildings that a split by scene spreads over several splits."""
    rows = sampling.hash_split(manifest(spark, sf_dir), "scene_id", "scene")
    return rows.groupBy("building_id").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


@query(f"WITH {MANIFEST} SELECT institution_id, count(*) AS episodes, count(DISTINCT scene_id) AS scenes, count(DISTINCT building_id) AS buildings, round(sum(price), 2) AS price FROM manifest GROUP BY 1")
def manifest_stats(spark, sf_dir):
    return manifest(spark, sf_dir).groupBy("institution_id").agg(F.count(F.lit(1)).alias("episodes"), F.count_distinct("scene_id").alias("scenes"), F.count_distinct("building_id").alias("buildings"), F.round(F.sum("price"), 2).alias("price"))


@query(f"WITH {MANIFEST}, n AS (SELECT institution_id, scene_id, count(*) AS n FROM manifest GROUP BY 1, 2) SELECT institution_id, min(n) AS least, max(n) AS greatest, count(*) AS scenes FROM n GROUP BY 1")
def manifest_distribution(spark, sf_dir):
    n = manifest(spark, sf_dir).groupBy("institution_id", "scene_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("institution_id").agg(F.min("n").alias("least"), F.max("n").alias("greatest"), F.count(F.lit(1)).alias("scenes"))


@query("WITH n AS (SELECT l_orderkey, sum(l_quantity)::BIGINT AS len FROM lineitem GROUP BY 1), t AS (SELECT 1 + (len - 1) // 4 AS ticks FROM n WHERE len > 0) SELECT sum(ticks)::BIGINT AS ticks, sum(greatest(0, ticks - 4))::BIGINT AS q2, sum(greatest(0, ticks - 6))::BIGINT AS q3, sum(greatest(0, ticks - 10))::BIGINT AS q5 FROM t")
def temporal_distribution(spark, sf_dir):
    """Ticks of segments and how many remain for each stride of descriptors."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("len")).where("len > 0")
    t = n.select(F.expr("1 + (len - 1) DIV 4").alias("ticks"))
    return t.agg(F.sum("ticks").alias("ticks"), *(F.sum(F.greatest(F.lit(0), F.col("ticks") - 2 * s)).alias(f"q{s}") for s in (2, 3, 5)))


@query("SELECT 'missing' AS kind, d.doc_id FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id UNION ALL SELECT 'unexpected', l.doc_id FROM labels l ANTI JOIN documents d ON d.doc_id = l.doc_id")
def coverage_missing_unexpected(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_anti").select(F.lit("missing").alias("kind"), "doc_id").unionByName(labels.join(docs, "doc_id", "left_anti").select(F.lit("unexpected").alias("kind"), "doc_id"))


@query("WITH h AS (SELECT sha256(concat_ws('|', 'n_name=' || coalesce(n_name, 'null'), 'n_nationkey=' || coalesce(n_nationkey::VARCHAR, 'null'), 'n_regionkey=' || coalesce(n_regionkey::VARCHAR, 'null'))) AS d FROM nation) SELECT count(*) AS rows, sum(concat('0x', substr(d, 1, 7))::BIGINT)::BIGINT AS low, sum(concat('0x', substr(d, 8, 7))::BIGINT)::BIGINT AS high FROM h")
def table_fingerprint(spark, sf_dir):
    return contracts.plain_fingerprint(table(spark, sf_dir, "nation"))


@query("WITH n AS (SELECT role, turn, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS text FROM conversations) SELECT role, count(*) AS turns, count(DISTINCT text) AS texts, count(*) FILTER (WHERE text = '') AS empty FROM n GROUP BY 1")
def text_normalize_distinct(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("role", collapse_space(F.col("text")).alias("text"))
    return t.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("text").alias("texts"), F.count_if(F.col("text") == "").alias("empty"))


#: Which losses a trajectory of a role may supervise.
ROLES = (("expert", True, True, True, True), ("recovery", True, True, True, True), ("exploration", True, True, False, True), ("failure", True, True, False, True), ("action_free", True, False, False, False))


@query(f"WITH {MANIFEST}, r AS (SELECT CASE status WHEN 'F' THEN 'expert' WHEN 'O' THEN 'failure' ELSE 'action_free' END AS role FROM manifest), d(role, video, dynamics, policy, codebook) AS (VALUES " + ", ".join(str(r) for r in ROLES) + ") SELECT role, video, dynamics, policy, codebook, count(*) AS n FROM r JOIN d USING (role) GROUP BY ALL")
def role_supervision(spark, sf_dir):
    role = F.when(F.col("status") == "F", "expert").when(F.col("status") == "O", "failure").otherwise("action_free")
    dim = spark.createDataFrame(ROLES, "role string, video boolean, dynamics boolean, policy boolean, codebook boolean")
    return manifest(spark, sf_dir).select(role.alias("role")).join(F.broadcast(dim), "role").groupBy(*dim.columns).agg(F.count(F.lit(1)).alias("n"))  # five rows


@query("WITH r AS (SELECT o_orderkey, range(0, 3) AS k FROM orders) SELECT o_orderkey::VARCHAR || '@' || (i * 10)::VARCHAR || ':' || (i * 10 + 5)::VARCHAR AS segment_id, i * 10 AS start, i * 10 + 5 AS stop FROM r, unnest(k) AS t(i)")
def segment_explode(spark, sf_dir):
    """Half-open ranges as rows, with ids episode@start:stop."""
    ranges = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct((i * 10).cast("long").alias("start"), (i * 10 + 5).cast("long").alias("stop")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(ranges).alias("r"))
    return rows.select(F.concat(F.col("o_orderkey").cast("string"), F.lit("@"), F.col("r.start").cast("string"), F.lit(":"), F.col("r.stop").cast("string")).alias("segment_id"), "r.start", "r.stop")


@query("SELECT l_returnflag AS flag, count(*) AS n, count(*) FILTER (WHERE l_discount = l_tax) AS exact, round(avg(abs(l_discount - l_tax)), 8) AS mean_abs, round(sqrt(avg((l_discount - l_tax) * (l_discount - l_tax))), 8) AS rmse, round(max(abs(l_discount - l_tax)), 8) AS most FROM lineitem GROUP BY 1")
def mapping_statistics(spark, sf_dir):
    e = F.abs(F.col("l_discount") - F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") == F.col("l_tax")).alias("exact"), F.round(F.avg(e), 8).alias("mean_abs"), F.round(F.sqrt(F.avg(e * e)), 8).alias("rmse"), F.round(F.max(e), 8).alias("most"))


@query("SELECT coalesce(o.o_custkey, c.c_custkey) AS scene_id, count(o.o_orderkey) AS episodes, bool_or(c.c_custkey IS NULL) AS unknown FROM orders o FULL JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1")
def scene_set_equality(spark, sf_dir):
    """Scenes of episodes against scenes of the directory, either side kept."""
    o, c = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey")
    return o.join(c, o.o_custkey == c.c_custkey, "full").groupBy(F.coalesce("o_custkey", "c_custkey").alias("scene_id")).agg(F.count("o_orderkey").alias("episodes"), F.bool_or(F.col("c_custkey").isNull()).alias("unknown"))


@query(f"WITH {MANIFEST} SELECT institution_id, building_id, grouping_id(institution_id, building_id) AS level, count(*) AS episodes FROM manifest GROUP BY ROLLUP (institution_id, building_id)")
def hierarchy_rollup(spark, sf_dir):
    return manifest(spark, sf_dir).rollup("institution_id", "building_id").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("episodes"))


@query(f"WITH {MANIFEST} SELECT task, status, grouping_id(task, status) AS level, count(*) AS n, round(avg(price), 4) AS price FROM manifest GROUP BY CUBE (task, status)")
def family_cube(spark, sf_dir):
    """Every subset of two code families at once."""
    return manifest(spark, sf_dir).cube("task", "status").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.avg("price"), 4).alias("price"))
