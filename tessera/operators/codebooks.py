"""Many k-means models in one scan a round, and residual codebooks that resume level by level.

A member of a grid has its own number of centers, seed, pool of rows, tolerance and patience.  A round reads the vectors once: all members' centers are one matrix
product on each Arrow batch, and a task hands on sums, counts and the hardest vectors of each member that still runs.  Members that have settled drop out of the
next round.  Seeds are hash orders, so a member of a grid moves as it would alone.  State is stored by round with an identity (members, columns,
a fingerprint of the rows), so a run that was cut off goes on and another model or table is refused.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import score
from ..shipping import ensure_importable
from ..sources import commits, files
from ..sources.contracts import canonical_hash
from .clustering import _matrix

#: Hardest vectors that a task hands on for each member; empty centers beyond that wait a round.
_HARD = 8
_SAMPLE = 2048
#: Stands for all rows of a member's pool among the splits.
_POOL = "\0pool"


@dataclass(frozen=True)
class Member:
    """One k-means model.  ``pool``: a boolean column, whose true rows it learns from; all rows without it."""

    name: str
    k: int
    seed: int = 0
    pool: str | None = None
    tolerance: float = 1e-3
    patience: int = 2
    rounds: int = 50


@dataclass
class Fit:
    """Centers of a member, by round the mean squared distance of each split, and whether it settled."""

    centers: np.ndarray
    curve: list[dict[str, float]]
    settled: bool


def _seeds(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ on a sample of bounded size."""
    generator, chosen = np.random.default_rng(seed), [0]
    nearest = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(k, len(x)):
        total = nearest.sum()
        chosen.append(int(generator.choice(len(x), p=nearest / total)) if total > 0 else next(i for i in range(len(x)) if i not in chosen))
        nearest = np.minimum(nearest, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def _start(df: DataFrame, vector: str, key: str, members: Sequence[Member]) -> dict[str, np.ndarray]:
    """First centers of each member, from the pool's rows that come first in a hash order of the seed."""
    out, samples = {}, {}
    for m in members:
        if (m.pool, m.seed) not in samples:
            rows = df.where(F.col(m.pool)) if m.pool else df
            taken = rows.withColumn("__s", score(f"grid-{m.seed}", F.col(key))).orderBy("__s", key).limit(_SAMPLE).select(vector).collect()
            samples[m.pool, m.seed] = np.array([r[0] for r in taken], float)
        if not len(samples[m.pool, m.seed]):
            raise ValueError(f"{m.name} has no rows to learn from")
        out[m.name] = _seeds(samples[m.pool, m.seed], m.k, m.seed)
    return out


def scan_members(df: DataFrame, vector: str, key: str, split: str | None, live: Sequence[Member], centers: dict[str, np.ndarray]):
    """One scan: for each live member (sums, counts, {split: (error, rows)}, hardest vectors as (distance, key, vector))."""
    spark = df.sparkSession
    pools = sorted({m.pool for m in live if m.pool})
    shared = spark.sparkContext.broadcast([centers[m.name] for m in live])

    def run(batches):
        import pyarrow as pa

        cs = shared.value
        all_centers = np.vstack(cs)
        norms, cuts = (all_centers**2).sum(1), np.cumsum([0] + [len(c) for c in cs])
        sums, counts = np.zeros_like(all_centers), np.zeros(len(all_centers), np.int64)
        errors: dict[tuple[int, str], list[float]] = {}
        hard: list[list[tuple[float, str, list[float]]]] = [[] for _ in live]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0))
            keys = batch.column(1)
            splits = np.array(batch.column(2).to_pylist(), object)
            masks = {p: batch.column(3 + k).fill_null(False).to_numpy(zero_copy_only=False) for k, p in enumerate(pools)}
            squares = (x * x).sum(1)
            products = x @ all_centers.T
            for n, m in enumerate(live):
                d = np.maximum(0, squares[:, None] - 2 * products[:, cuts[n] : cuts[n + 1]] + norms[cuts[n] : cuts[n + 1]])
                near = d.argmin(1)
                best = d[np.arange(len(x)), near]
                pool_error = errors.setdefault((n, _POOL), [0.0, 0])
                own = masks[m.pool] if m.pool else np.ones(len(x), bool)
                at = cuts[n] + near[own]
                order = np.argsort(at, kind="stable")
                pool_error[0] += float(best[own].sum())
                pool_error[1] += int(own.sum())
                if len(order):
                    first = np.flatnonzero(np.diff(at[order], prepend=-1))
                    sums[at[order][first]] += np.add.reduceat(x[own][order], first)
                    counts += np.bincount(at, minlength=len(counts))
                    far = np.flatnonzero(own)[np.argpartition(-best[own], min(_HARD, own.sum()) - 1)[:_HARD]]
                    hard[n] = sorted([*hard[n], *((-float(best[i]), str(keys[int(i)].as_py()), x[i].tolist()) for i in far)])[:_HARD]
                for s in sorted(set(splits)):
                    e = errors.setdefault((n, s), [0.0, 0])
                    here = splits == s
                    e[0] += float(best[here].sum())
                    e[1] += int(here.sum())
        rows = [("center", k, None, float(n), s.tolist(), None) for k, (n, s) in enumerate(zip(counts.tolist(), sums, strict=True)) if n]
        rows += [("error", n, s, float(count), [e], None) for (n, s), (e, count) in errors.items()]
        rows += [("hard", n, name, -d, v, None) for n, each in enumerate(hard) for d, name, v in each]
        if rows:
            kind, at, name, number, values, _ = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({"kind": pa.array(kind), "at": pa.array(at, pa.int32()), "name": pa.array(name, pa.string()), "number": pa.array(number, pa.float64()), "values": pa.array(values, pa.list_(pa.float64()))})

    picked = df.select(F.col(vector).cast("array<double>"), F.col(key), (F.coalesce(F.col(split).cast("string"), F.lit("")) if split else F.lit("all")).alias("__split"), *pools)
    found = picked.mapInArrow(run, "kind string, at int, name string, number double, values array<double>")
    rank = F.when(F.col("kind") == "hard", F.col("name"))
    summed = (
        found.withColumn("hard", rank).withColumn("split", F.when(F.col("kind") == "error", F.col("name"))).select("kind", "at", "hard", "split", "number", F.posexplode("values").alias("dim", "x"))
        .groupBy("kind", "at", "hard", "split", "dim").agg(F.sum("x").alias("x"), F.sum("number").alias("number")).collect()
    )  # bounded by centers, members, splits and tasks x hardest
    sums, counts = {m.name: np.zeros_like(centers[m.name]) for m in live}, {m.name: np.zeros(len(centers[m.name])) for m in live}
    errors, hard = {m.name: {} for m in live}, {m.name: {} for m in live}
    owner = [(m.name, k) for m in live for k in range(len(centers[m.name]))]
    for r in summed:
        if r["kind"] == "center":
            name, k = owner[r["at"]]
            sums[name][k, r["dim"]], counts[name][k] = r["x"], r["number"]
        elif r["kind"] == "error":
            errors[live[r["at"]].name][r["split"]] = (r["x"], r["number"])
        else:
            own = hard[live[r["at"]].name].setdefault(r["hard"], [r["number"], {}])
            own[1][r["dim"]] = r["x"]
    hardest = {name: sorted((-d, key, [v[k] for k in sorted(v)]) for key, (d, v) in each.items())[:_HARD] for name, each in hard.items()}
    return {m.name: (sums[m.name], counts[m.name], errors[m.name], hardest[m.name]) for m in live}


def rows_fingerprint(df: DataFrame, columns: Sequence[str]) -> str:
    """Count and sum of row hashes, whatever the order of rows."""
    n, total = df.select(F.xxhash64(*columns).cast("decimal(38,0)").alias("h")).agg(F.count(F.lit(1)), F.sum("h")).first()
    return f"{n}:{total}"


def fit_grid(df: DataFrame, vector: str, key: str, members: Sequence[Member], split: str | None = None, checkpoint: str | None = None, stop_after: int | None = None, scans: list | None = None) -> dict[str, Fit]:
    """Fits all members; each scan of ``df`` moves every member that has not settled.

    A member settles after ``patience`` rounds that change its error on its pool's rows, or on all rows without pool, by less than ``tolerance`` with no center empty.
    Empty centers move to the hardest vectors of the pool (distance, then key).  With ``split`` the curve has the error of each split, all from the same scan.
    ``checkpoint``: a folder of this run; ``stop_after`` scans it returns as it is; ``scans``: gets how many members each scan moved.
    """
    spark = df.sparkSession
    ensure_importable(spark)
    if len({m.name for m in members}) < len(members) or any(m.k < 1 for m in members):
        raise ValueError("members need names of their own and at least one center")
    pools = sorted({m.pool for m in members if m.pool})
    df = df.select(vector, *dict.fromkeys([key, *([split] if split else []), *pools]))
    state, done = None, 0
    identity = canonical_hash({"members": [asdict(m) for m in members], "split": split, "rows": rows_fingerprint(df, df.columns)}) if checkpoint else ""
    while checkpoint and (found := files.found_report(spark, f"{checkpoint}/round-{done:04d}")):
        if found["identity"] != identity:
            raise ValueError(f"{checkpoint} holds rounds of other members or rows")
        state, done = found["members"], done + 1
    if state is None:
        centers = _start(df, vector, key, members)
        state = {m.name: {"centers": centers[m.name].tolist(), "curve": [], "last": [], "calm": 0, "settled": False} for m in members}
    passes = 0
    while live := [m for m in members if not state[m.name]["settled"] and len(state[m.name]["curve"]) < m.rounds]:
        if stop_after is not None and passes >= stop_after:
            break
        found = scan_members(df, vector, key, split, live, {m.name: np.array(state[m.name]["centers"], float) for m in live})
        if scans is not None:
            scans.append(len(live))
        for m in live:
            own = state[m.name]
            sums, counts, errors, hard = found[m.name]
            total = errors.pop(_POOL)[0]
            own["curve"].append({s: e / max(1, n) for s, (e, n) in sorted(errors.items())})
            at = np.array(own["centers"], float)
            new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], at)
            empty = np.flatnonzero(counts == 0).tolist()
            for spot, (_, _, v) in zip(empty, hard, strict=False):
                new[spot] = v
            before = own["last"][-1] if own["last"] else None
            calm = before is not None and not empty and abs(before - total) / max(before, 1e-12) < m.tolerance
            own |= {"centers": new.tolist(), "last": [total], "calm": own["calm"] + 1 if calm else 0}
            own["settled"] = own["calm"] >= m.patience
        passes += 1
        if checkpoint:
            files.write_report(spark, f"{checkpoint}/round-{done:04d}", {"identity": identity, "members": state})
            done += 1
    return {name: Fit(np.array(s["centers"], float), s["curve"], s["settled"]) for name, s in state.items()}


def _residuals(df: DataFrame, vector: str, centers: np.ndarray) -> DataFrame:
    """``vector`` less its nearest center, other columns as they are."""
    shared = df.sparkSession.sparkContext.broadcast(centers)
    place = df.columns.index(vector)

    def run(batches):
        import pyarrow as pa

        c = shared.value
        for batch in batches:
            if not batch.num_rows:
                yield batch
                continue
            x = _matrix(batch.column(place))
            near = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)).argmin(1)
            left = x - c[near]
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(left.reshape(-1)))
            yield pa.RecordBatch.from_arrays([values if k == place else batch.column(k) for k in range(batch.num_columns)], names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def fit_residual_levels(df: DataFrame, vector: str, key: str, k: int, levels: int, split: str | None = None, learn: str | None = None, checkpoint: str | None = None, scans: list | None = None, stop_after: int | None = None, **options) -> list[Fit]:
    """Residual codebooks: each level is fitted on what the ones before leave over, which is written once a level.

    ``learn``: a boolean column whose true rows are learned from; the curves have the errors of each ``split`` of all rows.  In ``checkpoint`` a level has a folder of its own with
    its rounds and its residuals; identities go by k, options and a fingerprint of the rows, so no other run's are taken up.
    ``stop_after``: scans in all, after which it returns what there is, as if cut off.
    """
    spark = df.sparkSession
    folder = checkpoint or commits.scratch(spark, "residual-levels")
    rows = df.select(F.col(vector).cast("array<double>").alias(vector), *dict.fromkeys([key, *([split] if split else []), *([learn] if learn else [])]))
    out: list[Fit] = []
    for level in range(levels):
        count: list[int] = []
        member = Member("level", k, seed=level, pool=learn, **options)
        fit = fit_grid(rows, vector, key, [member], split, f"{folder}/level-{level}/rounds" if checkpoint else None, stop_after, count)["level"]
        out.append(fit)
        if scans is not None:
            scans.append(len(count))
        if stop_after is not None:
            stop_after -= len(count)
            if not fit.settled and len(fit.curve) < member.rounds:
                break
        if level + 1 < levels:
            at = f"{folder}/level-{level}/residuals"
            if not (checkpoint and files.is_written(spark, at)):
                _residuals(rows, vector, fit.centers).write.mode("overwrite").parquet(at)
            rows = spark.read.schema(rows.schema).parquet(at)
    return out
