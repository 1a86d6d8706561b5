"""A manifest of episodes from its sources: each is unique by path, and the first rule that fails excludes a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import collapse_space

#: What stands before and after an episode's path in its sources.
MARKER, SUFFIXES = "r2d2-data-full/", ("/trajectory.h5", "/recordings/MP4")


def canonical_path(value: Column) -> Column:
    """The episode's path alone; null unless it has four parts and its second says success or failure."""
    at = F.instr(value, MARKER)
    rest = F.btrim(F.when(at > 0, F.substr(value, at + len(MARKER))).otherwise(value), F.lit("/"))
    plain = F.regexp_replace(rest, "(?:" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + ")$", "")
    parts = F.split(plain, "/")
    return F.when((F.size(parts) >= 4) & F.get(parts, F.lit(1)).isin("success", "failure"), plain)


def _by_path(df: DataFrame, name: str) -> DataFrame:
    """A row a path: how many rows it has, and its row if that is one."""
    others = [c for c in df.columns if c != "path"]
    return df.where("path IS NOT NULL").groupBy("path").agg(F.count(F.lit(1)).alias(f"{name}_n"), F.when(F.count(F.lit(1)) == 1, F.first(F.struct(*others))).alias(name))


def build_manifest(keep: DataFrame, metadata: DataFrame, index: DataFrame, language: DataFrame | None = None, objects: DataFrame | None = None, successful_only: bool = True, without_flags: bool = True) -> DataFrame:
    """Rows of ``keep`` with ``reason``: why a row is excluded, or ``kept``; and what the other sources say of it.

    ``keep``: path, ranges array<struct<begin, end>>.  ``metadata``: path, episode_id, success, quality_flags array<string>,
    num_steps, institution_id, building_id, scene_id, task.  ``index``: path, num_steps, shard_name.  ``language``: episode_id,
    texts array<string>, of which an episode that repeats keeps the least.  ``objects``: shard_name, checksum; a kept row without one is ``missing_checksum``.  All joins are by equal keys on
    sides that are unique by then.
    """
    ids = metadata.groupBy("episode_id").agg((F.count_distinct("path") > 1).alias("shared_id"))
    m, i = _by_path(metadata, "m"), _by_path(index, "i")
    rows = keep.join(m, "path", "left").join(i, "path", "left").withColumn("episode_id", F.col("m.episode_id")).join(ids, "episode_id", "left")
    if language is not None:
        rows = rows.join(language.groupBy("episode_id").agg(F.min("texts").alias("texts")), "episode_id", "left")
    else:
        rows = rows.withColumn("texts", F.array().cast("array<string>"))
    known = F.lit(True)
    if objects is not None:
        rows = rows.withColumn("shard_name", F.col("i.shard_name")).join(objects.groupBy("shard_name").agg(F.max("checksum").alias("checksum")), "shard_name", "left")
        known = F.col("checksum").isNotNull()
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    last = F.element_at("ranges.end", -1)
    # fixed values: the reasons, in the order in which rules are asked
    reason = (
        F.when(F.col("m_n").isNull(), "missing_raw_metadata").when(F.col("m_n") > 1, "ambiguous_raw_metadata_path").when(F.col("i_n").isNull(), "missing_rlds_index")
        .when(F.col("i_n") > 1, "ambiguous_rlds_path").when(F.col("shared_id"), "ambiguous_raw_metadata_id")
        .when(F.lit(without_flags) & (F.size("m.quality_flags") > 0), "raw_metadata_quality_flag").when(F.lit(successful_only) & ~F.col("m.success"), "failure_episode")
        .when(F.size("ranges") == 0, "no_eligible_keep_ranges").when((F.col("i.num_steps") <= 0) | (last > F.col("i.num_steps")), "keep_range_exceeds_rlds_length")
        .when(blank("m.institution_id") | blank("m.building_id") | blank("m.scene_id"), "missing_scene_identity").when(~known, "missing_checksum").otherwise("kept")
    )
    texts = F.array_distinct(F.filter(F.concat(F.coalesce("texts", F.array().cast("array<string>")), F.array(F.coalesce(collapse_space(F.col("m.task")), F.lit("")))), lambda t: t != ""))
    eligible = F.aggregate("ranges", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["begin"])
    return rows.select(
        "path", "episode_id", reason.alias("reason"), F.col("i.num_steps").alias("num_steps"), (F.col("i.num_steps") - F.col("m.num_steps")).alias("delta"), eligible.alias("eligible_steps"),
        F.col("m.institution_id").alias("institution_id"), F.col("m.building_id").alias("building_id"), F.col("m.scene_id").alias("scene_id"), texts.alias("texts"),
    )
