"""Causal descriptors, targets and windows over episodes, by window functions on one ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(episode: str, tick: str):
    return Window.partitionBy(episode).orderBy(tick)


def with_cadence(df: DataFrame, episode: str, tick: str, seconds: str) -> DataFrame:
    """Adds ``cadence``: the lower median gap of all ticks of the episode, and ``gap``."""
    gap = df.withColumn("gap", F.col(seconds) - F.lag(seconds).over(_order(episode, tick)))
    return gap.withColumn("cadence", F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY gap)").over(Window.partitionBy(episode)))


def causal_triples(df: DataFrame, stride: int, value: str, episode: str = "user_id", tick: str = "tick", seconds: str = "sec", valid: Column | None = None, factor: float = 1.5) -> DataFrame:
    """Rows with x0, x1, x2 = the value two strides, one stride ago and now; both gaps must be within
    ``factor`` times the cadence's span, and all three ticks valid.  Future rows never matter."""
    order = _order(episode, tick)
    ok = F.lit(True) if valid is None else valid
    rows = with_cadence(df, episode, tick, seconds).withColumn("ok", ok)
    for name, column in (("x", value), ("t", seconds), ("v", "ok")):
        rows = rows.withColumns({f"{name}0": F.lag(column, 2 * stride).over(order), f"{name}1": F.lag(column, stride).over(order), f"{name}2": F.col(column)})
    most = F.col("cadence") * stride * factor
    return rows.where((F.col(tick) >= 2 * stride) & F.col("v0") & F.col("v1") & F.col("v2") & (F.col("t1") - F.col("t0") <= most) & (F.col("t2") - F.col("t1") <= most))


def aligned_triples(df: DataFrame, strides: list[int], value: str, episode: str = "user_id", tick: str = "tick", seconds: str = "sec", valid: Column | None = None, factor: float = 1.5) -> DataFrame:
    """Rows at which the triples of all strides exist, as x0_s, x1_s, x2_s for each stride s.  All lags share one sort of
    the episodes, so nothing is joined."""
    order = _order(episode, tick)
    rows = with_cadence(df, episode, tick, seconds).withColumn("ok", F.lit(True) if valid is None else valid)
    back = lambda c, k: F.lag(c, k).over(order) if k else F.col(c)
    out = rows.withColumns({f"{name}{2 - k}_{s}": back(c, k * s) for s in strides for name, c in (("x", value), ("t", seconds), ("v", "ok")) for k in (2, 1, 0)})
    for s in strides:
        most = F.col("cadence") * s * factor
        out = out.where((F.col(tick) >= 2 * s) & F.col(f"v0_{s}") & F.col(f"v1_{s}") & F.col(f"v2_{s}") & (F.col(f"t1_{s}") - F.col(f"t0_{s}") <= most) & (F.col(f"t2_{s}") - F.col(f"t1_{s}") <= most))
    return out


def future_change(df: DataFrame, stride: int, value: str, episode: str = "user_id", tick: str = "tick") -> DataFrame:
    """Adds ``target``: the value one stride ahead less the value now; rows without one go."""
    return df.withColumn("target", F.lead(value, stride).over(_order(episode, tick)) - F.col(value)).where("target IS NOT NULL")


def segments(df: DataFrame, most_gap: float, episode: str = "user_id", tick: str = "tick", seconds: str = "sec") -> DataFrame:
    """Half-open ranges [start, stop) of ticks without a gap over ``most_gap`` seconds; none is joined across one."""
    order = _order(episode, tick)
    new = F.when(F.col(seconds) - F.lag(seconds).over(order) > most_gap, 1).otherwise(0)
    cut = df.withColumn("segment", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy(episode, "segment").agg(F.min(tick).alias("start"), (F.max(tick) + 1).alias("stop"))


def sliding_windows(lengths: DataFrame, history: int, horizon: int, stride: int, length: str = "n") -> DataFrame:
    """One row a window: ``anchor`` from ``history`` on, every ``stride``, with ``horizon`` ticks ahead."""
    last = F.col(length) - 1 - horizon
    return lengths.where(last >= history).withColumn("anchor", F.explode(F.sequence(F.lit(history).cast("long"), last.cast("long"), F.lit(stride).cast("long"))))


def exact_endpoint_windows(df: DataFrame, horizon: int, history: int, episode: str, source: str, code: str) -> DataFrame:
    """Windows whose end lies exactly ``horizon`` source steps ahead; a missing end drops the window."""
    now = df.select(episode, F.col(source).alias("current"), F.col(code).alias("current_code"))
    end = df.select(F.col(episode).alias("__e"), F.col(source).alias("future"), F.col(code).alias("future_code"))
    rows = now.join(end, (F.col(episode) == F.col("__e")) & (F.col("future") == F.col("current") + horizon)).drop("__e")
    return rows.where(F.col("current") >= history)


def transitions(df: DataFrame, code: str, episode: str = "user_id", tick: str = "tick") -> DataFrame:
    """Adjacent pairs: prev and cur; only where ticks follow each other."""
    order = _order(episode, tick)
    rows = df.select(episode, F.lag(code).over(order).alias("prev"), F.col(code).alias("cur"), (F.col(tick) - F.lag(tick).over(order)).alias("step"))
    return rows.where("step = 1").select(episode, "prev", "cur")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` at or before ``at``: one union and one window, no range join."""
    both = left.withColumns({"__v": F.lit(None).cast(right.schema[value].dataType), "__side": F.lit(1)}).unionByName(
        right.select(key, at, F.col(value).alias("__v")).withColumn("__side", F.lit(0)), allowMissingColumns=True
    )
    order = Window.partitionBy(key).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(order)).where("__side = 1").drop("__v", "__side")
