"""Merkle manifest of a table: a leaf a row, a tree a group, a tree over the groups, and a proof a row.

A tree's nodes stand in order; every ``FANOUT`` consecutive ones get a parent, whose digest is that of their digests put together.
A *slot pivot* makes the parents: one aggregation spreads the children of a parent over ``FANOUT`` columns by conditions on
their slot; the columns put together are hashed, and all but a child's own column are its siblings.  Rows are numbered within their group
without a window over the group: they are dealt by ranges of (group, order), numbered inside each range, and ranges are counted.
A group may thus hold any share of the rows.

Defined results: null columns are written as ``-``; a null group is a group of its own and the first; rows of equal ids are ordered by their leaves, null ids first;
repeated rows are leaves of their own; rows with a null id are never tampered with; a text of any length is hashed whole; an empty table has no rows; columns
beside those named aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, written

FANOUT = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Siblings of a node, level by level: digests before its own and after it.
_NO_PATH = "cast(array() as array<struct<before:string,after:string>>)"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def part(value: Column) -> Column:
    """A value as it is hashed: its length in bytes of UTF-8, a colon, the value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _same(a: str, b: str, names: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names])


def ranges(rows: DataFrame, groups: Sequence[str], order: Sequence[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` dealt and sorted by ranges of (group, order), nulls first; and where each group's part of a range starts.

    The second table (group, range, first, start, size: the group's rows) has a row for each group and range, so the window over it is small.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*groups, *order)]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    held = written(dealt.select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("row")), name)
    counted = held.groupBy(*groups, "range").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    whole = Window.partitionBy(*groups)
    before = F.sum("n").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    return held, counted.select(*groups, "range", "first", F.coalesce(before, F.lit(0)).alias("start"), F.sum("n").over(whole).alias("size"))


def placed(held: DataFrame, starts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows with their place ``pos`` (from 0) in their group, and the columns that ``starts`` has of the group."""
    own = [c for c in starts.columns if c not in {*groups, "range", "first", "start"}]
    both = held.alias("a").join(starts.alias("b"), _same("a", "b", [*groups, "range"]))
    pos = (F.col("b.start") + F.col("a.row") - F.col("b.first")).alias("pos")
    return both.select(*(f"a.{c}" for c in held.columns if c not in ("range", "row")), pos, *(f"b.{c}" for c in own))


def parents(nodes: DataFrame) -> DataFrame:
    """(tree, pos, size, digest) of the parents of nodes, with the digests of their children in columns c0 to c15."""
    slots = [F.max(F.when(F.col("pos") % FANOUT == k, F.col("digest"))).alias(f"c{k}") for k in range(FANOUT)]
    spread = nodes.groupBy("tree", F.expr(f"pos div {FANOUT}").alias("parent")).agg(*slots, F.max(F.expr(f"(size + {FANOUT - 1}) div {FANOUT}")).alias("size"))
    whole = digest(*(F.coalesce(f"c{k}", F.lit("")) for k in range(FANOUT)))
    return spread.withColumnRenamed("parent", "pos").withColumn("digest", whole)


def grow(nodes: DataFrame, most: int, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, digest) of the tops of trees of up to ``most`` leaves (tree, pos, size, digest), and the parents of each level, lowest first."""
    levels: list[DataFrame] = []
    tops, width = nodes.where("size = 1").select("tree", "digest"), 1
    while width < most:
        width *= FANOUT
        levels.append(written(parents(nodes.where("size > 1")), f"{name}-level"))
        nodes = levels[-1]
        tops = tops.unionByName(nodes.where("size = 1").select("tree", "digest"))
    return tops, levels


def _siblings(slot: Column) -> Column:
    columns = F.array(*(F.col(f"c{k}") for k in range(FANOUT)))
    before, after = F.slice(columns, F.lit(1), slot), F.slice(columns, slot + 2, F.lit(FANOUT))
    return F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))


def paths(levels: list[DataFrame], ends: DataFrame) -> DataFrame:
    """(tree, pos, path, ...) of the parents of the leaves; ``ends`` has (tree, path, ...) of the tops of the trees."""
    more = [c for c in ends.columns if c not in ("tree", "path")]
    found: DataFrame | None = None
    for level in reversed(levels):
        below = level.where("size = 1").select("tree", "pos").join(ends, "tree")
        if found is not None:
            # the nodes of this level that have parents are the children in the level above
            children = upper.drop("size", "digest").join(found, ["tree", "pos"]).select("*", F.posexplode(F.array(*(F.col(f"c{k}") for k in range(FANOUT)))).alias("slot", "child")).where("child IS NOT NULL")
            path = F.concat(F.array(_siblings(F.col("slot"))), "path").alias("path")
            below = below.unionByName(children.select("tree", (F.col("pos") * FANOUT + F.col("slot")).alias("pos"), path, *more))
        upper, found = level, below
    return found


def leaf_paths(leaves: DataFrame, levels: list[DataFrame], ends: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` of the leaves, their path and the other columns of ``ends``."""
    more = [c for c in ends.columns if c not in ("tree", "path")]
    alone = leaves.where("size = 1").join(ends, "tree").select(*keep, "path", *more)
    if not levels:
        return alone
    pivots = levels[0].drop("digest", "size").join(paths(levels, ends), ["tree", "pos"])
    own = leaves.where("size > 1").withColumn("slot", (F.col("pos") % FANOUT).cast("int")).withColumn("leaf_pos", F.col("pos")).withColumn("pos", F.expr(f"pos div {FANOUT}"))
    path = F.concat(F.array(_siblings(F.col("slot"))), "path").alias("path")
    joined = own.join(pivots, ["tree", "pos"]).withColumn("pos", F.col("leaf_pos"))
    return joined.select(*keep, path, *more).unionByName(alone)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda acc, p: F.sha2(F.concat(p["before"], acc, p["after"]), 256))


def proof(path: Column) -> Column:
    """The digest of all siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def manifest(
    docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", id_col: str = "doc_id", text_col: str = "text", tampered: Column | None = None,
) -> DataFrame:
    """A row a leaf: doc_id, leaf, subroot, root, path (its siblings), and other_leaf: that of the row with its text in lower case where ``tampered`` holds, else the leaf."""
    col = {c: F.col(quoted(c)) for c in (*columns, group, id_col, text_col)}
    leaf = digest(*(part(col[c]) for c in columns))
    changed = digest(*(part(lower_ascii(col[c]) if c == text_col else col[c]) for c in columns))
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered, changed)
    bare = docs.select(col[id_col].alias("doc_id"), col[group].cast("string").alias("source"), leaf.alias("digest"), other.alias("other"))
    held, starts = ranges(bare, ["source"], ["doc_id", "digest"], "leaves")
    starts = written(starts, "starts")
    groups_held, groups_start = ranges(starts.select("source", "size").distinct().withColumnRenamed("size", "leaves"), [], ["source"], "groups")
    trees = written(placed(groups_held, groups_start, []), "trees").alias("t")  # source, leaves, pos, size
    tree_of = starts.alias("s").join(trees, _same("s", "t", ["source"])).select("s.*", F.col("t.pos").alias("tree"))
    leaves = written(placed(held, tree_of, ["source"]), "placed")
    most, groups = trees.agg(F.coalesce(F.max("leaves"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()  # two numbers
    tops, levels = grow(leaves.select("tree", "pos", "size", "digest"), most, "rows")
    tops = written(tops, "tops")
    upper = tops.crossJoin(F.broadcast(trees.agg(F.max("size").alias("size")))).select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "size", "digest")
    roots, over = grow(upper, groups, "groups")
    ends = roots.select("tree", F.expr(_NO_PATH).alias("path"), F.col("digest").alias("root"))  # one row
    group_ends = leaf_paths(upper.withColumnRenamed("digest", "subroot"), over, ends, ["pos", "subroot"]).withColumnRenamed("pos", "tree")
    found = leaf_paths(leaves, levels, written(group_ends, "group-paths"), ["doc_id", "digest", "other"])
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", F.coalesce("other", "digest").alias("other_leaf"))


def proofs(docs: DataFrame, tampered: Column | None = None, **names) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (of the tampered leaf where there is one) and whether that equals root."""
    found = manifest(docs, tampered=tampered, **names)
    checked = found.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.col("other_leaf"), F.col("path")).alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def proofs_sql(levels: int = 6) -> str:
    """The query on ``documents`` in DuckDB's SQL, for trees of at most 16^levels nodes."""
    columns = "||".join(f"coalesce(strlen({c}::varchar)||':'||{c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
    leaf = "sha256({}||coalesce(strlen({})||':'||{}, '-'))".format(columns, "text", "text")
    low = f"translate(text, '{_UPPER}', '{_LOWER}')"
    changed = "sha256({}||coalesce(strlen({})||':'||{}, '-'))".format(columns, low, low)
    step = "list_reduce(range(9), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)"
    crc = "xor(list_reduce(list_prepend(4294967295, [ord(x) for x in string_split(doc_id::varchar, '')]), lambda c, b: xor(c >> 8, crc_steps[1 + (xor(c, b) & 255)])), 4294967295)"
    step = step.replace("range(9)", "range(8)")
    ctes = [
        f"crc AS (SELECT list({step} ORDER BY n) AS crc_steps FROM (SELECT unnest(range(256)) AS n))",
        f"l0 AS (SELECT doc_id, source, {leaf} AS digest, CASE WHEN {crc} % 5 = 0 THEN {changed} END AS other FROM documents, crc)",
        "n0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size FROM l0)",
        "f0 AS (SELECT doc_id, source, digest AS leaf, coalesce(other, digest) AS cur, pos, size, '' AS sib FROM n0)",
    ]
    for k in range(levels):
        ctes += [
            f"p{k} AS (SELECT source, pos // 16 AS pos, list(digest ORDER BY pos) AS kids, (max(size) + 15) // 16 AS size FROM n{k} WHERE size > 1 GROUP BY 1, 2)",
            f"n{k + 1} AS (SELECT source, sha256(array_to_string(kids, '')) AS digest, pos, size FROM p{k} UNION ALL SELECT source, digest, pos, size FROM n{k} WHERE size = 1)",
            f"f{k + 1} AS (SELECT doc_id, f.source, leaf, CASE WHEN kids IS NULL THEN cur ELSE sha256(array_to_string(kids[:f.pos % 16], '')||cur||array_to_string(kids[f.pos % 16 + 2:], '')) END AS cur, f.pos // 16 AS pos, (f.size + 15) // 16 AS size, "
            f"CASE WHEN kids IS NULL THEN sib ELSE sib||array_to_string(kids[:f.pos % 16], '')||array_to_string(kids[f.pos % 16 + 2:], '') END AS sib FROM f{k} f LEFT JOIN p{k} p ON f.size > 1 AND f.source IS NOT DISTINCT FROM p.source AND f.pos // 16 = p.pos)",
        ]
    ctes.append(f"g0 AS (SELECT source, digest AS subroot, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS own, count(*) OVER () AS size FROM n{levels})")
    ctes.append(f"h0 AS (SELECT doc_id, leaf, subroot, cur, sib, pos, g.size FROM (SELECT doc_id, source, leaf, cur, sib FROM f{levels}) f JOIN g0 g ON f.source IS NOT DISTINCT FROM g.source)")
    for k in range(levels):
        ctes += [
            f"q{k} AS (SELECT pos // 16 AS pos, list(digest ORDER BY pos) AS kids, (max(size) + 15) // 16 AS size FROM g{k} WHERE size > 1 GROUP BY 1)",
            f"g{k + 1} AS (SELECT sha256(array_to_string(kids, '')) AS digest, pos, size FROM q{k} UNION ALL SELECT digest, pos, size FROM g{k} WHERE size = 1)",
            f"h{k + 1} AS (SELECT doc_id, leaf, subroot, CASE WHEN kids IS NULL THEN cur ELSE sha256(array_to_string(kids[:h.pos % 16], '')||cur||array_to_string(kids[h.pos % 16 + 2:], '')) END AS cur, h.pos // 16 AS pos, (h.size + 15) // 16 AS size, "
            f"CASE WHEN kids IS NULL THEN sib ELSE sib||array_to_string(kids[:h.pos % 16], '')||array_to_string(kids[h.pos % 16 + 2:], '') END AS sib FROM h{k} h LEFT JOIN q{k} q ON h.size > 1 AND h.pos // 16 = q.pos)",
        ]
    return (
        f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, cur AS folded_root, cur = root AS verified "
        f"FROM h{levels}, (SELECT digest AS root FROM g{levels})"
    )
