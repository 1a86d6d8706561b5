"""Vector quantisation: nearest centers, residual codes, Lloyd's iterations over DataFrame aggregates.

Centers are a model of fixed size (k x dimensions) and go with the tasks; vectors never leave the executors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ensure_importable
from ..functions.scalar import score, squared_distance, subtract
from ..sources import commits, files


def assign_nearest(df: DataFrame, vector: str, centers: list[list[float]], code: str = "code", distance: str = "distance") -> DataFrame:
    """Adds the nearest center's index (ties to the lowest) and the squared distance.  JVM-side; for few centers."""
    best = F.array_min(F.array(*(F.struct(squared_distance(F.col(vector), F.array(*map(F.lit, map(float, c)))).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centers))))
    return df.withColumn("__b", best).withColumns({code: F.col("__b.k"), distance: F.col("__b.d")}).drop("__b")


def assign_batches(df: DataFrame, vector: str, levels: list[np.ndarray], keep: list[str]) -> DataFrame:
    """Residual codes of all levels by matrix products on Arrow batches: columns ``keep``, codes, error (squared)."""
    ensure_importable(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast([np.asarray(c, float) for c in levels])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = _matrix(batch.column(0))
            codes = np.zeros((batch.num_rows, len(shared.value)), np.int32)
            for level, c in enumerate(shared.value):
                if len(x):
                    d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
                    codes[:, level] = d.argmin(1)
                    x = x - c[codes[:, level]]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(codes.tolist(), pa.list_(pa.int32())), pa.array((x * x).sum(1) if len(x) else [], pa.float64())], names=[*batch.schema.names[1:], "codes", "error"])

    rows = df.select(vector, *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{schema}, codes array<int>, error double")


def residual(df: DataFrame, vector: str, code: str, centers: list[list[float]]) -> DataFrame:
    """``vector`` less its assigned center."""
    table = F.array(*(F.array(*map(F.lit, map(float, c))) for c in centers))
    return df.withColumn(vector, subtract(F.col(vector), F.element_at(table, F.col(code) + 1)))


def _matrix(column) -> np.ndarray:
    """Vectors of an Arrow batch as rows of doubles, without a Python object a number."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _partial_sums(df: DataFrame, vector: str, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(sums, counts, inertia): a row for each center and task comes to the driver, whatever the number of vectors."""
    ensure_importable(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(centers)
    k, width = centers.shape

    def run(batches):
        import pyarrow as pa

        c = shared.value
        sums, counts, inertia = np.zeros((k, width)), np.zeros(k, int), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                d = np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1))
                near = d.argmin(1)
                np.add.at(sums, near, x)
                counts += np.bincount(near, minlength=k)
                inertia += np.bincount(near, d[np.arange(len(x)), near], k)
        yield pa.RecordBatch.from_pydict({"k": list(range(k)), "s": sums.tolist(), "n": counts.tolist(), "i": inertia.tolist()}, schema=pa.schema([("k", pa.int32()), ("s", pa.list_(pa.float64())), ("n", pa.int64()), ("i", pa.float64())]))

    parts = df.select(vector).mapInArrow(run, "k int, s array<double>, n long, i double")
    each = parts.select("k", "n", "i", F.posexplode("s").alias("dim", "x")).groupBy("k", "dim").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("i").alias("i")).collect()
    sums, counts, inertia = np.zeros((k, width)), np.zeros(k), 0.0
    for r in each:
        sums[r["k"], r["dim"]], counts[r["k"]] = r["x"], r["n"]
        inertia += r["i"] if r["dim"] == 0 else 0
    return sums, counts, inertia


def initial_centers(df: DataFrame, vector: str, key: str, k: int, sample: int = 2048, salt: str = "init") -> np.ndarray:
    """k-means++ on a hash-ordered sample of bounded size; no random numbers."""
    x = np.array([r[0] for r in df.withColumn("__s", score(salt, F.col(key))).orderBy("__s").limit(sample).select(vector).collect()], float)
    generator, chosen = np.random.default_rng(7), [0]
    while len(chosen) < min(k, len(x)):
        d = ((x[:, None] - x[chosen]) ** 2).sum(2).min(1)
        total = d.sum()
        chosen.append(int(generator.choice(len(x), p=d / total)) if total > 0 else next(i for i in range(len(x)) if i not in chosen))
    return x[chosen]


def lloyd(df: DataFrame, vector: str, key: str, k: int, rounds: int = 50, tolerance: float = 1e-3, patience: int = 2, checkpoint: str | None = None) -> tuple[np.ndarray, list[float]]:
    """(centers, mean inertia by round).  With a new or own folder as ``checkpoint`` each round is stored, and a run that was cut off goes on.  Empty centers move to the hardest vectors (distance, then key); it stops after
    ``patience`` rounds that change the inertia by less than ``tolerance`` with no center empty."""
    spark, state = df.sparkSession, None
    own = {"k": k, "tolerance": tolerance, "patience": patience, "rows": str(df.select(F.xxhash64(key, vector).cast("decimal(38,0)").alias("h")).agg(F.struct(F.count(F.lit(1)), F.sum("h"))).first()[0])} if checkpoint else {}
    while checkpoint and (found := files.found_report(spark, f"{checkpoint}/round-{0 if state is None else len(state['curve']):04d}")):
        if found.get("identity") != own:
            raise ValueError(f"{checkpoint} holds rounds of another model or table")
        state = found
    centers, curve, calm = (np.array(state["centers"]), state["curve"], state["calm"]) if state else (initial_centers(df, vector, key, k), [], 0)
    for _ in range(rounds - len(curve)):
        if calm >= patience:
            break
        sums, counts, inertia = _partial_sums(df, vector, centers)
        curve.append(inertia / max(1.0, counts.sum()))
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
        if empty := np.flatnonzero(counts == 0).tolist():
            far = assign_nearest(df.select(key, vector), vector, centers.tolist()).orderBy(F.desc("distance"), key).limit(len(empty)).select(vector).collect()
            for spot, r in zip(empty, far, strict=False):
                new[spot] = r[0]
        centers = new
        calm = calm + 1 if len(curve) > 1 and not empty and abs(curve[-2] - curve[-1]) / max(curve[-2], 1e-12) < tolerance else 0
        if checkpoint:
            files.write_report(spark, f"{checkpoint}/round-{len(curve) - 1:04d}", {"identity": own, "centers": centers.tolist(), "curve": curve, "calm": calm})
    return centers, curve


def lloyd_from(df: DataFrame, vector: str, centers: list[list[float]], rounds: int) -> list[tuple[int, int, float]]:
    """(vectors, codes in use, inertia) of each of so many rounds from given centers; an empty center stays where it is."""
    at, curve = np.asarray(centers, float), []
    for _ in range(rounds):
        sums, counts, inertia = _partial_sums(df, vector, at)
        curve.append((int(counts.sum()), int((counts > 0).sum()), inertia))
        at = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], at)
    return curve


def train_residual_quantizer(df: DataFrame, vector: str, key: str, k: int, levels: int, checkpoint: str | None = None, **options) -> list[np.ndarray]:
    """Centers of each level; a level is fitted on what the ones before leave over, which is written once a level.  In ``checkpoint`` each level
    has a folder of its own; rounds of another k, options or table are refused."""
    spark, out = df.sparkSession, []
    folder = checkpoint or commits.scratch(spark, "residuals")
    df = df.select(key, vector)
    for level in range(levels):
        centers, _curve = lloyd(df, vector, key, k, checkpoint=f"{folder}/level-{level}/rounds" if checkpoint else None, **options)
        out.append(centers)
        if level + 1 < levels:
            at = f"{folder}/level-{level}/residuals"
            if not files.is_written(spark, at):
                left = residual(assign_nearest(df, vector, centers.tolist()), vector, "code", centers.tolist())
                left.select(key, vector).write.mode("overwrite").parquet(at)
            df = spark.read.parquet(at)
    return out


def effective_rank(df: DataFrame, vector: str) -> tuple[float, int]:
    """Participation ratio and how many axes hold 95 % of the variance, from a Gram matrix summed on the executors."""
    def run(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                g = np.vstack([np.hstack([len(x), x.sum(0)]), np.hstack([x.sum(0)[:, None], x.T @ x])])
                total = g if total is None else total + g
        if total is not None:
            yield pa.RecordBatch.from_pydict({"g": [total.reshape(-1).tolist()]}, schema=pa.schema([("g", pa.list_(pa.float64()))]))

    parts = df.select(vector).mapInArrow(run, "g array<double>").select(F.posexplode("g").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
    side = int(round(len(parts) ** 0.5))
    g = np.array([r["x"] for r in parts]).reshape(side, side)
    cov = g[1:, 1:] / g[0, 0] - np.outer(g[0, 1:], g[0, 1:]) / g[0, 0] ** 2
    values = np.sort(np.maximum(np.linalg.eigvalsh(cov), 0))[::-1]
    return float(values.sum() ** 2 / (values**2).sum()), int(np.searchsorted(np.cumsum(values) / values.sum(), 0.95) + 1)
