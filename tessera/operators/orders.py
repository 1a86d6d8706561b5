"""Exact order statistics of groups of any size by counting: no group's values meet in one array, task or sort.

Each round counts a group's values in equal bins between two bounds, finds the bin that holds the wanted rank, and takes the least and
greatest value in it as the next bounds, until they are equal.  Tasks sum up bins before anything is shuffled, so a group, however large, costs a task a row a bin.
Bounds move with the data, so a round narrows at least to fewer distinct values, and mostly by the number of bins.  Every other round has
bins of equal ratio instead of equal width, so values over hundreds of powers of ten take few rounds too.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import commits

BINS = 512
#: Bounds of groups are broadcast below this many rows, else joined.
_BROADCAST_ROWS = 50_000


def _ranks(n: Column, p: float, kind: str) -> dict[str, Column]:
    """Ranks from 0 that a quantile needs: ``floor``: that at floor((n - 1) p); ``disc``: the least with a share of p at or below it; ``linear``: two neighbours."""
    if kind == "disc":
        return {"low": F.greatest(F.lit(0), F.ceil(n * F.lit(p)).cast("long") - 1)}
    at = (n - 1) * F.lit(p)
    return {"low": F.floor(at).cast("long")} | ({"high": F.ceil(at).cast("long")} if kind == "linear" else {})


def _magnitude(x: Column) -> Column:
    """Rises with the value, by as much for each factor: all doubles lie within 1500 of 0."""
    log = F.log(F.when(x == 0, 1.0).otherwise(F.abs(x))) + 750
    return F.when(x == 0, 0.0).when(x > 0, log).otherwise(-log)


def _bin(value: Column, low: Column, high: Column, by_magnitude: bool) -> Column:
    """A bin from 0 that never falls as the value rises, the first for ``low`` and a later one for ``high``."""
    v, a, b = (c.cast("double") for c in (value, low, high))
    infinite = (a == float("-inf")) | (b == float("inf"))
    outer = F.when(v == float("-inf"), 0).when(v == float("inf"), 2).otherwise(1)
    # halves where a difference of doubles overflows
    share = F.when(b - a == float("inf"), F.try_divide(v / 2 - a / 2, b / 2 - a / 2)).otherwise(F.try_divide(v - a, b - a))
    if by_magnitude:
        share = F.coalesce(F.try_divide(_magnitude(v) - _magnitude(a), _magnitude(b) - _magnitude(a)), share)
    inner = F.floor(share * BINS).cast("int")
    close = (value - low).cast("int")  # whole numbers that are one double
    return F.least(F.when(infinite, outer).when(a == b, close).otherwise(F.when(value == high, BINS - 1).otherwise(F.least(inner, F.lit(BINS - 1)))), F.lit(BINS - 1))


def _same(a: str, b: str, by: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by], F.lit(True))


def quantiles(df: DataFrame, by: Sequence[str], column: str, wanted: Mapping[str, tuple[float, str]], rounds: list | None = None) -> DataFrame:
    """A row a group: its columns, ``n`` (values) and each wanted quantile, given as (share, ``floor``, ``disc`` or ``linear``).

    Nulls and NaN are left out; a group of these alone has n = 0 and null quantiles.  ``rounds`` gets how many ranks were still open before each scan.
    """
    spark = df.sparkSession
    value = F.col(column)
    kind = df.schema[column].dataType.simpleString()
    known = F.when(value.isNotNull() & ~F.isnan(value.cast("double")), value)
    rows = df.select(*by, known.alias("__v"))
    folder = commits.scratch(spark, "order-statistics")

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{folder}/{name}")

    groups = stored(rows.groupBy(*by).agg(F.count("__v").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high")), "groups")
    each = [F.struct(F.lit(f"{name}/{side}").alias("name"), rank.alias("rank")) for name, (p, how) in wanted.items() for side, rank in _ranks(F.col("n"), p, how).items()]
    open_ = groups.where("n > 0").select(*by, "low", "high", F.explode(F.array(*each)).alias("w")).select(*by, "low", "high", "w.name", "w.rank")
    # of several quantiles with one rank, and of those that share bounds, one is counted
    found: list[DataFrame] = []
    step = 0
    while True:
        done = open_.where("low <=> high").select(*by, "name", F.col("low").alias("value"))
        found.append(done)
        open_ = open_.where("NOT (low <=> high)")
        left = open_.count()
        if rounds is not None and left:
            rounds.append(left)
        if not left:
            break
        spans = open_.select(*by, "low", "high").distinct()
        a, b = rows.where("__v IS NOT NULL").alias("a"), (F.broadcast(spans) if left <= _BROADCAST_ROWS else spans).alias("b")
        inside = _same("a", "b", by) & (F.col("a.__v") >= F.col("b.low")) & (F.col("a.__v") <= F.col("b.high"))
        binned = a.join(b, inside).select(*(F.col(f"b.{c}").alias(c) for c in by), F.col("b.low").alias("low"), F.col("b.high").alias("high"), F.col("a.__v").alias("__v"))
        counts = binned.groupBy(*by, "low", "high", _bin(F.col("__v"), F.col("low"), F.col("high"), step % 2 == 1).alias("bin")).agg(F.count(F.lit(1)).alias("m"), F.min("__v").alias("least"), F.max("__v").alias("most"))
        order = Window.partitionBy(*by, "low", "high").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a row a bin
        counts = stored(counts.withColumn("before", F.coalesce(F.sum("m").over(order), F.lit(0))), f"bins-{step}")
        x, y = open_.alias("x"), counts.alias("y")
        here = _same("x", "y", [*by, "low", "high"]) & (F.col("x.rank") >= F.col("y.before")) & (F.col("x.rank") < F.col("y.before") + F.col("y.m"))
        narrowed = x.join(y, here).select(*(f"x.{c}" for c in by), F.col("y.least").alias("low"), F.col("y.most").alias("high"), "x.name", (F.col("x.rank") - F.col("y.before")).alias("rank"))
        open_ = stored(narrowed, f"open-{step}")
        step += 1
    values = stored(reduce(DataFrame.unionByName, found), "values")
    sides = [F.max(F.when(F.col("name") == f"{name}/{side}", F.col("value"))).alias(f"{name}/{side}") for name, (p, how) in wanted.items() for side in _ranks(F.lit(0), p, how)]
    wide = values.groupBy(*by).agg(*sides)
    a, b = groups.alias("a"), wide.alias("b")

    def result(name: str, p: float, how: str) -> Column:
        low = F.col(f"b.`{name}/low`")
        if how != "linear":
            return low.cast(kind).alias(name)
        at = (F.col("a.n") - 1) * F.lit(p)
        low, high = low.cast("double"), F.col(f"b.`{name}/high`").cast("double")
        # equal neighbours stay as they are, infinite ones too
        return F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at))).alias(name)

    return a.join(b, _same("a", "b", by), "left").select(*(f"a.{c}" for c in by), "a.n", *(result(name, p, how) for name, (p, how) in wanted.items()))
