"""Deterministic splits, quotas and samples: hashes in place of random numbers, so order never matters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import score, split_of, unit_interval
from ..shipping import ensure_importable
from ..sources import commits


def hash_split(df: DataFrame, key: str, salt: str) -> DataFrame:
    """Adds ``split``; all rows of a key get the same."""
    return df.withColumn("split", split_of(unit_interval(score(salt, F.col(key)))))


def hash_sample(df: DataFrame, n: int, key: str, salt: str) -> DataFrame:
    """The ``n`` rows with the least hash of the key: a reservoir that no order of rows changes."""
    return df.withColumn("score", score(salt, F.col(key))).orderBy("score").limit(n)


def first_per_group(df: DataFrame, by: list[str], n: int, *order: Column | str) -> DataFrame:
    """Adds ``rank`` from 1; keeps the first ``n`` rows of each group.  Spark limits groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= n)


def diverse(df: DataFrame, by: list[str], group: str, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` of each key with at most one row of each group, in the original order."""
    best = df.withColumn("__g", F.row_number().over(Window.partitionBy(*by, group).orderBy(*order))).where("__g = 1").drop("__g")
    return first_per_group(best, by, n, *order)


def largest_remainder(sizes: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Shares ``total`` among keys by size; left-over units go to the largest remainders, ties by name.
    ``sizes`` has a row a key and is small."""
    w = Window.partitionBy()
    exact = F.col(size) * F.lit(total) / F.sum(size).over(w)
    rows = sizes.withColumn("base", F.floor(exact)).withColumn("rest", F.round(exact - F.floor(exact), 9))
    rows = rows.withColumn("place", F.row_number().over(w.orderBy(F.desc("rest"), key))).withColumn("left", F.lit(total) - F.sum("base").over(w))
    return rows.select(key, size, (F.col("base") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).cast("long").alias("quota"))


def water_fill(capacity: DataFrame, key: str, cap: str, total: int, salt: str) -> DataFrame:
    """Round-robin quotas up to each key's capacity: the first ``total`` slots by (level, hash)."""
    slots = capacity.withColumn("level", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col(cap), F.lit(total)).cast("long"))))
    taken = slots.withColumn("score", score(salt, F.col(key))).orderBy("level", "score").limit(total)
    return capacity.join(taken.groupBy(key).agg(F.count(F.lit(1)).alias("quota")), key, "left").select(key, cap, F.coalesce("quota", F.lit(0)).alias("quota"))


def nested_subset(df: DataFrame, group: str, fraction: float, salt: str) -> DataFrame:
    """Groups whose hash rank is within ceil(fraction * groups); a larger fraction holds every smaller one's."""
    groups = df.select(group).distinct().withColumn("score", score(salt, F.col(group)))
    n = groups.count()
    import math

    return groups.orderBy("score").limit(math.ceil(round(fraction * n, 9))).select(group)


def folds(parents: DataFrame, by: list[str], parent: str, salt: str) -> DataFrame:
    """Alternating folds 0 and 1 of parents in each group, by hash; groups of one parent are not eligible (null)."""
    w = Window.partitionBy(*by)
    p = parents.select(*by, parent).distinct().withColumn("score", score(salt, F.col(parent)))
    return p.select(*by, parent, F.when(F.count(F.lit(1)).over(w) >= 2, F.pmod(F.row_number().over(w.orderBy("score")) - 1, F.lit(2))).cast("long").alias("fold"))


def derangement(df: DataFrame, by: list[str], parent: str, row: str, salt: str) -> DataFrame:
    """A donor row for each row: rows stand parent by parent, the largest first, and the donor is one largest
    parent's size further on, cyclically; so donors come from other parents wherever that is possible.
    Parents are placed among each other by their sizes alone, rows within their parent, so no task sorts a group's rows.
    """
    w = Window.partitionBy(*by)
    ranked = w.orderBy(F.desc("size"), score(salt, F.col(parent)))
    sizes = df.groupBy(*by, parent).agg(F.count(F.lit(1)).alias("size")).withColumns({
        "before": F.sum("size").over(ranked.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"), "n": F.sum("size").over(w), "shift": F.max("size").over(w),
    }).drop("size")
    keys = [*by, parent]
    sizes = sizes.select(*(F.col(c).alias(f"__{c}") for c in keys), "before", "n", "shift")
    same = reduce(lambda p, c: p & F.col(c).eqNullSafe(F.col(f"__{c}")), keys, F.lit(True))
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(score(salt, F.col(row)))) - 1
    placed = df.select(*keys, row).withColumn("own", own).join(sizes, same).withColumn("pos", F.col("before") + F.col("own"))
    donor = placed.select(*by, F.col("pos").alias("dpos"), F.col(row).alias("donor"), F.col(parent).alias("donor_parent"))
    return placed.withColumn("dpos", F.pmod(F.col("pos") + F.col("shift"), F.col("n"))).join(donor, [*by, "dpos"]).select(*by, parent, row, "donor", "donor_parent")


def deal_ranks(df: DataFrame, group: str, row: str, ranks: int, salt: str) -> DataFrame:
    """Adds ``pos`` and ``rank``: groups in order of hash, rows in order of hash within them, dealt round; the rows
    that would make ranks unequal go.  Only the groups' sizes are summed in one order."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(score(salt, F.col(group)), group)  # a row a group
    sizes = sizes.withColumns({"before": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"), "total": F.sum("n").over(Window.partitionBy())}).drop("n")
    own = F.row_number().over(Window.partitionBy(group).orderBy(score(salt, F.col(row)), row)) - 1
    placed = df.withColumn("__own", own).join(sizes, group).withColumn("pos", F.col("before") + F.col("__own"))
    kept = placed.where(F.col("pos") < F.col("total") - F.pmod(F.col("total"), F.lit(ranks)))
    return kept.withColumn("rank", F.pmod(F.col("pos"), F.lit(ranks))).drop("__own", "before", "total")


def positions(df: DataFrame, key: str, name: str) -> DataFrame:
    """Adds ``name``: each row's place from 0 in order of ``key``, null last.  Tasks order ranges of the key; only the ranges' sizes are summed in one order."""
    order = F.col(key).asc_nulls_last()
    dealt = df.repartitionByRange(order).sortWithinPartitions(order)
    held = commits.stored(dealt.select("*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().alias("__row")), "positions")
    sizes = held.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    starts = sizes.select("__range", (before - F.col("__first")).alias("__shift"))
    return held.join(F.broadcast(starts), "__range").withColumn(name, F.col("__row") + F.col("__shift")).drop("__range", "__row", "__shift")


def groups_first(df: DataFrame, group: str, n: int, row: str, salt: str) -> DataFrame:
    """``n`` rows by hash, the first of each group before any second one; rows without group count as their own."""
    own = F.coalesce(F.col(group).cast("string"), F.concat(F.lit("row|"), F.col(row).cast("string")))
    rows = df.withColumn("score", score(salt, F.col(row))).withColumn("__g", own)
    rows = rows.withColumn("again", (F.row_number().over(Window.partitionBy("__g").orderBy("score")) > 1).cast("int"))
    return rows.orderBy("again", "score").limit(n).drop("__g")


def scene_round_robin(df: DataFrame, by: list[str], scene: str, row: str, labels: list[str], n: int, salt: str) -> DataFrame:
    """Up to ``n`` rows of each key, a scene at a time in rounds; round r starts at the r-th scene by hash, and each scene
    gives the row whose labels were taken least so far (the first label counts most), then the least hash.

    Counts of labels run through all picks of a key, so a task makes them in turn; but it sees few rows: at most ``n``
    scenes matter, and of equal labels in a scene only the first by hash, ``n`` at the most.  Rows without scene go.
    """
    names = [*by, scene, row, *labels]
    scenes = df.where(F.col(scene).isNotNull()).select(*by, scene).distinct().withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(score(salt, "scene", F.col(scene)))))
    pool = df.select(*names).withColumn("score", score(salt, F.col(row))).join(scenes.where(F.col("place") <= n), [*by, scene])
    pool = first_per_group(pool, [*by, scene, *labels], n, "score").drop("rank")
    schema = pool.select(*names).withColumn("pick", F.lit(0).cast("long")).schema

    def turns(part):
        import pandas as pd

        counts: list[dict] = [{} for _ in labels]
        waiting = [g.to_dict("records") for _, g in part.sort_values("score").groupby("place")]
        picked: list[dict] = []
        start = 0
        while len(picked) < n and any(waiting):
            for k in range(len(waiting)):
                own = waiting[(start + k) % len(waiting)]
                if own and len(picked) < n:
                    best = min(own, key=lambda r: (*(c.get(r[name], 0) for c, name in zip(counts, labels, strict=True)), r["score"]))
                    own.remove(best)
                    for c, name in zip(counts, labels, strict=True):
                        c[best[name]] = c.get(best[name], 0) + 1
                    picked.append({**{name: best[name] for name in names}, "pick": len(picked)})
            start += 1
        return pd.DataFrame(picked, columns=[*names, "pick"])

    ensure_importable(df.sparkSession)
    return pool.groupBy(*by).applyInPandas(turns, schema)


def longest_first(sizes: dict[str, int], bins: int) -> dict[str, int]:
    """Longest-processing-time assignment of a bounded list of files to bins; ties to fewer files, then lower bin."""
    load = [[0, 0, b] for b in range(bins)]
    out = {}
    for name, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        best = min(load)
        out[name] = best[2]
        best[0] += size
        best[1] += 1
    return out


def greedy_cover(cells: list[tuple[str, str, int]], quota: dict[str, int], cost: dict[str, int]) -> list[str]:
    """Shards that meet quotas by cell at little cost: again and again the shard with most of the deficit per byte.
    ``cells``: (shard, cell, rows), already aggregated, so bounded by shards x cells."""
    have: dict[str, dict[str, int]] = {}
    for shard, cell, n in cells:
        have.setdefault(shard, {})[cell] = n
    need, out = dict(quota), []
    while any(v > 0 for v in need.values()):
        gain = {s: sum(min(n, max(0, need.get(c, 0))) for c, n in own.items()) for s, own in have.items() if s not in out}
        best = max(gain, key=lambda s: (gain[s] / max(1, cost.get(s, 1)), gain[s], -ord(s[0]) if s else 0, s), default=None)
        if best is None or not gain[best]:
            break
        out.append(best)
        for c, n in have[best].items():
            need[c] = need.get(c, 0) - n
    return out
