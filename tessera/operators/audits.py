"""Audits of derived tables: windows against their episodes, runs against each other, lookups hop by hop, measurements by condition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def _rows(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def windows_against_episodes(windows: DataFrame, episodes: DataFrame, identity: Sequence[str], reference: str, start: str, stop: str, role: str, episode: str, steps: str, split: str) -> DataFrame:
    """By split and role: windows, those whose ``identity`` repeats, those of unknown episodes or that end beyond theirs, and the actions that lie inside.

    Windows of unknown episodes count under split ``-`` and have no actions.
    """
    own = windows.select(*(F.col(c).alias(f"id{k}") for k, c in enumerate(identity)), F.col(reference).alias("ref"), F.col(start).alias("start"), F.col(stop).alias("stop"), F.col(role).alias("role"))
    e = episodes.select(F.col(episode).alias("episode"), F.col(steps).alias("steps"), F.col(split).alias("split"))
    again = F.count(F.lit(1)).over(Window.partitionBy(*(f"id{k}" for k in range(len(identity))))) > 1
    joined = own.withColumn("again", again).join(e, F.col("ref") == F.col("episode"), "left")
    known = F.col("episode").isNotNull()
    actions = F.sum(F.when(known, F.greatest(F.least("stop", "steps") - F.col("start"), F.lit(0))))
    return joined.groupBy(F.coalesce("split", F.lit("-")).alias("split"), "role").agg(
        _rows("windows"), F.count_if("again").alias("repeated"), F.count_if(~known).alias("unknown"), F.count_if(F.col("stop") > F.col("steps")).alias("beyond"), F.coalesce(actions, F.lit(0)).cast("long").alias("actions"),
    )


def run_consistency(artifacts: DataFrame, run: str, counted: Mapping[str, Column], distinct: Mapping[str, Column], shared: Mapping[str, Column]) -> DataFrame:
    """A row a run: how many values ``counted`` expressions have, whether ``distinct`` ones never repeat, and whether ``shared`` ones have one value; ``n`` artifacts."""
    return artifacts.groupBy(F.col(run).alias("run")).agg(
        *(F.count_distinct(c).alias(k) for k, c in counted.items()), *((F.count_distinct(c) == F.count(F.lit(1))).alias(k) for k, c in distinct.items()), *((F.min(c) == F.max(c)).alias(k) for k, c in shared.items()), _rows(),
    )


def row_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(only_left, only_right): rows that one table has more often than the other, in one shuffle; nulls are equal.  Equal tables have zeros."""
    if left.columns != right.columns:
        raise ValueError("the tables have other columns")
    d = F.col("__d")
    signed = left.withColumn("__d", F.lit(1)).unionAll(right.withColumn("__d", F.lit(-1))).groupBy(*left.columns).agg(F.sum("__d").alias("__d"))
    return signed.agg(F.coalesce(F.sum(F.greatest(d, F.lit(0))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.greatest(-d, F.lit(0))), F.lit(0)).alias("only_right"))


def lookup_losses(rows: DataFrame, hops: Mapping[str, tuple[DataFrame, str, str]], by: Column, distinct: Mapping[str, str] | None = None, total: str = "n") -> DataFrame:
    """Rows looked up hop by hop, each by an own key: by ``by``, how many there are and how many find nothing at each hop.

    ``hops``: name -> (table that is unique by its key, key of the rows, key of the table).
    """
    for name, (side, key, own) in hops.items():
        side = side.withColumnRenamed(own, f"__{name}")
        rows = rows.join(side, F.col(key) == F.col(f"__{name}"), "left")
    return rows.groupBy(by).agg(_rows(total), *(F.count_if(F.col(f"__{name}").isNull()).alias(name) for name in hops), *(F.count_distinct(c).alias(k) for k, c in (distinct or {}).items()))


def measured_records(records: DataFrame, measurements: DataFrame, key: str, by: str, value: Column) -> DataFrame:
    """By group: records, those that have a measurement, and the mean of ``value`` over these."""
    joined = records.join(measurements.withColumn("__there", F.lit(True)), key, "left")
    return joined.groupBy(by).agg(_rows("records"), F.count("__there").alias("measured"), F.avg(value).alias("mean"))


def condition_summary(rows: DataFrame, family: str, condition: str, clip: str, value: str, natural: str, opposite: tuple[str, str], decided: Column) -> DataFrame:
    """By family and condition: rows, mean, its ratio to the ``natural`` condition's; and by family how often ``decided`` differs between two opposite conditions of a clip."""
    each = rows.groupBy(family, condition).agg(_rows(), F.avg(value).alias("mean"))
    base = each.where(F.col(condition) == natural).select(family, F.col("mean").alias("__natural"))
    sides = [rows.where(F.col(condition) == c).select(family, clip, decided.alias(f"__{k}")) for k, c in enumerate(opposite)]
    differ = sides[0].join(sides[1], [family, clip]).groupBy(family).agg(F.avg((F.col("__0") != F.col("__1")).cast("double")).alias("opposite"))
    return each.join(base, family, "left").join(differ, family, "left").withColumn("to_natural", F.try_divide("mean", "__natural")).drop("__natural")


def change_by_code(rows: DataFrame, episode: str, tick: str, code: str, value: str, least: float) -> DataFrame:
    """By the code of a tick: ticks that have one before, how many changed by over ``least``, the mean change and the sum of values."""
    before = F.lag(value).over(Window.partitionBy(episode).orderBy(tick))
    own = rows.select(F.col(code).alias("code"), F.col(value).alias("value"), before.alias("before")).where("before IS NOT NULL")
    step = F.abs(F.col("value") - F.col("before"))
    return own.groupBy("code").agg(_rows(), F.avg((step > least).cast("double")).alias("changed"), F.sum("value").alias("total"), F.avg(step).alias("step"))


def text_coverage(windows: DataFrame, texts: DataFrame, parent: str, tokens: str) -> DataFrame:
    """Parents of windows, those whose text is there and those without, and the tokens that all windows need; null tokens are no text."""
    counted = windows.groupBy(parent).agg(_rows("__windows"))
    joined = counted.join(texts.select(parent, F.col(tokens).alias("__tokens")), parent, "left")
    t = F.col("__tokens")
    return joined.agg(_rows("parents"), F.count(t).alias("covered"), F.count_if(t.isNull()).alias("missing"), F.coalesce(F.sum(F.col("__windows") * t), F.lit(0)).alias("tokens"))


def best_depth(errors: DataFrame, by: Sequence[str], depth: str = "depth", error: str = "mse") -> DataFrame:
    """The depth of least error of each group, the least of equal ones, and that error."""
    return errors.groupBy(*by).agg(F.min_by(depth, F.struct(error, depth)).alias("depth"), F.min(error).alias("mse"))


def depth_profiles(errors: DataFrame, by: Sequence[str], depths: Sequence[int], depth: str = "depth", error: str = "mse") -> DataFrame:
    """``profile``: (depth, error) of each group in order of depth, which is bounded by the depths; ``complete``: whether each of ``depths`` is there once and no other."""
    each = F.array_sort(F.collect_list(F.struct(F.col(depth).alias("depth"), F.col(error).alias("error"))))
    return errors.groupBy(*by).agg(each.alias("profile")).withColumn("complete", F.col("profile.depth") == F.array(*map(F.lit, depths)))


def differing_pairs(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(left, right, only_left, only_right) of each two of a few tables."""
    names = list(tables)
    found = [row_differences(tables[a], tables[b]).select(F.lit(a).alias("left"), F.lit(b).alias("right"), "only_left", "only_right") for k, a in enumerate(names) for b in names[k + 1 :]]
    return reduce(DataFrame.unionByName, found)
