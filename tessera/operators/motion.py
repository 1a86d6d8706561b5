"""Grids, frame indices, motion and perturbations of episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pool_grid(values: Column, channels: int, grid: int, size: int) -> Column:
    """Block means of ``channels`` square grids laid out one after another, to ``size`` x ``size`` each."""
    side = grid // size
    cells = []
    for c in range(channels):
        for y in range(size):
            for x in range(size):
                block = [c * grid * grid + (y * side + i) * grid + x * side + j for i in range(side) for j in range(side)]
                cells.append(sum((F.get(values, F.lit(k)).cast("double") for k in block), F.lit(0.0)) / len(block))
    return F.array(*cells)


def spatial_moments(values: Column, channels: int, grid: int) -> Column:
    """Per channel its mean and its means weighted by x, y and x^2 + y^2; coordinates run from -1 to 1."""
    at = [2 * k / (grid - 1) - 1 for k in range(grid)]
    bases = [[1.0 for _ in at for _ in at], [x for _ in at for x in at], [y for y in at for _ in at], [x * x + y * y for y in at for x in at]]
    dot = lambda part, basis: F.aggregate(F.zip_with(part, F.array(*map(F.lit, basis)), lambda v, b: v.cast("double") * b), F.lit(0.0), lambda s, v: s + v) / (grid * grid)
    return F.array(*(dot(F.slice(values, c * grid * grid + 1, grid * grid), b) for c in range(channels) for b in bases))


def latent_frames(lengths: DataFrame, length: str = "n", step: int = 4) -> DataFrame:
    """A row a latent tick with its source frame: every ``step`` frames, the last clamped into the episode."""
    ticks = F.sequence(F.lit(0).cast("long"), F.expr(f"({length} - 1) div {step}").cast("long"))
    return lengths.where(F.col(length) > 0).withColumn("latent", F.explode(ticks)).withColumn("frame", F.least(F.col("latent") * step, F.col(length) - 1))


def proportional_means(df: DataFrame, value: str, latents: int, stride: int, episode: str = "user_id", tick: str = "tick") -> DataFrame:
    """The mean of an episode's values in each latent tick's share of it.  Bounds round half to even and leave at least one row.

    Rows look up their windows themselves, so nothing is joined."""
    rows = df.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(episode)))
    bound = lambda t: F.bround(F.lit(t / (latents - 1)) * F.col("n"), 0).cast("long")
    windows = []
    for t in range(latents - stride):
        start = F.greatest(F.lit(0), F.least(bound(t), F.col("n") - 1))
        windows.append(F.struct(F.lit(t).cast("long").alias("latent"), start.alias("start"), F.greatest(start + 1, F.least(bound(t + stride), F.col("n"))).alias("stop")))
    mine = F.filter(F.array(*windows), lambda w: (F.col(tick) >= w["start"]) & (F.col(tick) < w["stop"]))
    return rows.withColumn("w", F.explode(mine)).groupBy(episode, "w.latent").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def perturbed(df: DataFrame, names: tuple[str, str, str] = ("x0", "x1", "x2")) -> DataFrame:
    """Each triple three times: its history swapped, its time reversed, and its last frame alone; y0, y1, y2 and ``condition``."""
    a, b, c = (F.col(n) for n in names)
    forms = {"history_swap": (b, a, c), "reverse_time": (c, b, a), "static_current": (c, c, c)}
    options = F.array(*(F.struct(F.lit(k).alias("condition"), *(v.alias(f"y{i}") for i, v in enumerate(form))) for k, form in forms.items()))
    return df.withColumn("p", F.explode(options)).select("*", "p.*").drop("p")


def in_ranges(tick: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a tick lies in one of a few half-open ranges."""
    return F.exists(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ranges)), lambda r: (tick >= r["a"]) & (tick < r["b"]))


def transition_kind(df: DataFrame, ranges: list[tuple[int, int]], episode: str = "user_id", tick: str = "tick") -> DataFrame:
    """Adds ``kind`` of the step to the next row: inside, outside, or boundary of the kept ranges; the last row goes."""
    rows = df.withColumn("kept", in_ranges(F.col(tick), ranges))
    rows = rows.withColumn("next_kept", F.lead("kept").over(Window.partitionBy(episode).orderBy(tick))).where("next_kept IS NOT NULL")
    return rows.withColumn("kind", F.when(F.col("kept") & F.col("next_kept"), "inside").when(F.col("kept") | F.col("next_kept"), "boundary").otherwise("outside")).drop("kept", "next_kept")


def decision_weights(df: DataFrame, switch: Column, value: str, alpha: float = 1.0, most: float = 5.0, episode: str = "user_id", tick: str = "tick") -> DataFrame:
    """Adds ``weight``: higher where the switch turns or the value's velocity changes, relative to the episode's
    means, clamped to [1, most], and of mean 1 in each episode."""
    order, whole = Window.partitionBy(episode).orderBy(tick), Window.partitionBy(episode)
    v = F.col(value)
    rows = df.withColumn("__s", switch).withColumns({
        "__turn": F.coalesce(F.abs(F.col("__s") - F.lag("__s").over(order)), F.lit(0.0)),
        "__bend": F.coalesce(F.abs((F.lead(value).over(order) - v) - (v - F.lag(value).over(order))), F.lit(0.0)),
    })
    relative = lambda c: F.col(c) / (F.avg(c).over(whole) + 1e-6)
    rows = rows.withColumn("__w", F.greatest(F.lit(1.0), F.least(F.lit(most), 1 + alpha * relative("__turn") + alpha * relative("__bend"))))
    return rows.withColumn("weight", F.col("__w") / F.avg("__w").over(whole)).drop("__s", "__turn", "__bend", "__w")


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``left`` with the ``value`` of the row of ``right`` nearest in time, the earlier one in a tie, and ``distance``;
    null where the key has none.  One union and one sort, no range join."""
    both = left.withColumns({"__r": F.lit(None).cast(f"struct<t:double,v:{right.schema[value].dataType.simpleString()}>"), "__side": F.lit(1)}).unionByName(
        right.select(key, at, F.struct(F.col(at).cast("double").alias("t"), F.col(value).alias("v")).alias("__r")).withColumn("__side", F.lit(0)), allowMissingColumns=True
    )
    order = Window.partitionBy(key).orderBy(at, "__side")
    before = F.last("__r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("__r", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumns({"__b": before, "__a": after}).where("__side = 1")
    later = F.col("__b").isNull() | (F.col("__a.t") - F.col(at) < F.col(at) - F.col("__b.t"))
    best = F.when(later, F.col("__a")).otherwise(F.col("__b"))
    return found.withColumn("__n", best).withColumns({value: F.col("__n.v"), "distance": F.abs(F.col("__n.t") - F.col(at))}).drop("__r", "__side", "__b", "__a", "__n")


def cross_episode_pairs(df: DataFrame, value: str, most: int = 256, episode: str = "user_id", tick: str = "tick") -> DataFrame:
    """Each episode's rows in order beside the next episode's in reverse order, cyclically, ``most`` at the most."""
    own = Window.partitionBy(episode)
    first = df.select(episode, F.col(value).alias("a"), F.row_number().over(own.orderBy(tick)).alias("pos")).where(F.col("pos") <= most)
    last = df.select(F.col(episode).alias("other"), F.col(value).alias("b"), F.row_number().over(own.orderBy(F.desc(tick))).alias("pos")).where(F.col("pos") <= most)
    ring = Window.orderBy(episode)  # a row an episode
    names = df.select(episode).distinct()
    links = names.select(episode, F.coalesce(F.lead(episode).over(ring), F.first(episode).over(ring)).alias("other"))
    return first.join(links, episode).join(last, ["other", "pos"])
