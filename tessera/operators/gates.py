"""Paired resampling with hashed indices, threshold gates and verdicts by rule."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import score
from ..shipping import ensure_importable
from . import sampling


#: Rows of a key and a number that are broadcast (450,000 took 20 MB), else they are joined by shuffle.
_BROADCAST_ROWS = 500_000


def paired_bootstrap(deltas: DataFrame, key: str, delta: str, draws: int, salt: str, by_index: bool = False) -> DataFrame:
    """n, mean, win share and the linear 2.5 and 97.5 % quantiles of means of resampled episodes.

    A draw takes n positions from hashes of (draw, place), so it can be repeated anywhere.  All draws * n of them are dealt over
    tasks and summed there; ``deltas`` has a row an episode.  ``by_index`` picks the ends among the sorted means, at draws * 0.025 - 1
    and draws * 0.975 from 0, instead of quantiles between them.
    """
    spark = deltas.sparkSession
    own = sampling.positions(deltas.select(F.col(key).alias("key"), F.col(delta).alias("d")), "key", "pos")
    n = own.count()
    if not n:
        return spark.createDataFrame([], "n long, mean double, wins double, low double, high double")
    # a range's size is known to the planner, unlike that of exploded places, which it took for small enough to broadcast
    slots = spark.range(0, draws * n, 1, max(spark.sparkContext.defaultParallelism, draws * n // 2_000_000)).select(F.expr(f"id DIV {n}").alias("draw"), F.expr(f"id % {n}").alias("place"))
    picks = slots.select("draw", F.pmod(F.conv(F.substring(score(salt, F.col("draw"), F.col("place")), 1, 12), 16, 10).cast("long"), F.lit(n)).alias("pos"))
    rows = own.select("pos", "d")
    means = picks.join(F.broadcast(rows) if n <= _BROADCAST_ROWS else rows.hint("merge"), "pos").groupBy("draw").agg(F.avg("d").alias("m"))
    if by_index:
        at = lambda k: F.element_at(F.sort_array(F.collect_list("m")), k + 1)  # noqa: E731  (a value a draw)
        low, high = at(max(0, int(0.025 * draws) - 1)), at(min(draws - 1, int(0.975 * draws)))
    else:
        low, high = F.percentile("m", F.lit(0.025)), F.percentile("m", F.lit(0.975))
    ends = means.agg(low.alias("low"), high.alias("high"))
    return own.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.avg((F.col("d") < 0).cast("double")).alias("wins")).join(ends, F.lit(True))  # one row each


def _node(salt: str, *at: int):
    """A generator of its own for each draw and node of the tree, the same wherever it is made."""
    import numpy as np

    digest = hashlib.sha256("|".join([salt, *map(str, at)]).encode()).digest()
    return np.random.Generator(np.random.Philox(key=np.frombuffer(digest[:16], np.uint64)))


def draws_of_block(sizes: list[int], block: int, draw: int, salt: str) -> int:
    """How many of the draws that are made from all rows fall on a block: a tree over the blocks splits them by binomial numbers, and a task walks down to its own leaf.

    ``sizes``: rows of each block.  Over all blocks the numbers sum to the rows, and follow a multinomial distribution.
    """
    before = [0]
    for s in sizes:
        before.append(before[-1] + s)
    low, high, left = 0, len(sizes), before[-1]
    while high - low > 1:
        middle = (low + high) // 2
        whole, first = before[high] - before[low], before[middle] - before[low]
        taken = int(_node(salt, draw, low, high).binomial(left, first / whole)) if whole else 0
        low, high, left = (low, middle, taken) if block < middle else (middle, high, left - taken)
    return left


def block_bootstrap(deltas: DataFrame, key: str, delta: str, draws: int, salt: str, block_rows: int = 50_000) -> DataFrame:
    """n, mean, wins, and the linear 2.5 and 97.5 % quantiles of means of resampled rows, for any number of rows.

    Rows are dealt over blocks by a hash of their key.  Each block's task finds, draw by draw, how many of the n positions fall on it, places these on its rows, and hands on one
    sum a draw: no row is shuffled more than once, and none are ordered but within a block.  Draws don't depend on partitions or their number of tasks.
    """
    spark = deltas.sparkSession
    ensure_importable(spark)
    n = deltas.count()
    if not n:
        return spark.createDataFrame([], "n long, mean double, wins double, low double, high double")
    blocks = -(-n // block_rows)
    rows = deltas.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), F.col(key).cast("string").alias("key"), F.col(delta).cast("double").alias("d"))
    found = {r["block"]: r["count"] for r in rows.groupBy("block").count().collect()}  # a row a block
    sizes = [found.get(b, 0) for b in range(blocks)]

    def resample(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by([("key", "ascending"), ("d", "ascending")])
        block, d = table.column("block")[0].as_py(), table.column("d").to_numpy()
        sums, counts = [], []
        for draw in range(draws):
            taken = draws_of_block(sizes, block, draw, salt)
            picks = _node(f"{salt}|rows", draw, block).integers(0, len(d), taken)
            sums.append(float(d @ np.bincount(picks, minlength=len(d))))
            counts.append(taken)
        return pa.table({"draw": pa.array(range(draws), pa.int64()), "s": pa.array(sums), "taken": pa.array(counts, pa.int64())})

    each = rows.groupBy("block").applyInArrow(resample, "draw long, s double, taken long").groupBy("draw").agg((F.sum("s") / F.sum("taken")).alias("m"), F.sum("taken").alias("taken"))
    ends = each.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.min("taken").alias("least"), F.max("taken").alias("most"))  # a value a draw
    d = F.col(delta)
    whole = deltas.agg(F.count(F.lit(1)).alias("n"), F.avg(delta).alias("mean"), F.avg((d < 0).cast("double")).alias("wins"))
    return whole.join(ends.where((F.col("least") == n) & (F.col("most") == n)).select("low", "high"), F.lit(True), "left")  # one row each


def verdict(rows: DataFrame, by: list[str], high: str = "high", n: str = "n", least: int = 30) -> DataFrame:
    """invalid under ``least`` episodes, pass if every upper end is below 0, fail if any mean is at or above 0, else inconclusive."""
    return rows.groupBy(*by).agg(
        F.when(F.min(n) < least, "invalid").when(F.max(high) < 0, "pass").when(F.max("mean") >= 0, "fail").otherwise("inconclusive").alias("verdict")
    )


def overall(gates: DataFrame, status: str = "status", blocker: str = "blocker") -> DataFrame:
    """not_ready if a blocker fails, conditional_pass if any other gate does, else pass."""
    failed = F.col(status) == "fail"
    return gates.agg(F.when(F.bool_or(failed & F.col(blocker)), "not_ready").when(F.bool_or(failed), "conditional_pass").otherwise("pass").alias("decision"), F.count_if(failed).alias("failed"))


def seed_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Across seeds: n, mean, sample deviation, least and greatest, whether all are negative, coefficient of variation."""
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.bool_and(F.col(value) < 0).alias("all_negative"),
        F.try_divide(F.stddev_pop(value), F.abs(F.avg(value))).alias("cv"),
    )


def bounds(rows: DataFrame, limits: dict[str, tuple[str, float | None, float | None, bool]]) -> DataFrame:
    """A row a gate: its worst value over ``rows`` against its bounds.  ``limits``: gate -> (column, least, most, blocker).
    A gate fails if any row is outside or null, and is ``missing`` over no rows at all."""
    def one(name, column, least, most, blocker):
        v = F.col(column)
        outside = v.isNull() | (F.lit(False) if least is None else v < least) | (F.lit(False) if most is None else v > most)
        status = F.when(F.count(F.lit(1)) == 0, "missing").when(F.bool_or(outside), "fail").otherwise("pass")
        worst = F.min(v) if least is not None else F.max(v)
        return F.struct(F.lit(name).alias("gate"), worst.cast("double").alias("worst"), status.alias("status"), F.lit(blocker).alias("blocker"))

    return rows.agg(F.array(*(one(k, *v) for k, v in limits.items())).alias("g")).select(F.inline("g"))
