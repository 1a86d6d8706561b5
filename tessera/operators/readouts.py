"""Ridge readouts from sufficient statistics: the executors sum Gram matrices, the driver solves a small system."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def additive_ridge(train: DataFrame, codes: list[str], target: str, alpha: float) -> tuple[float, dict[tuple[str, object], float]]:
    """(mean, coefficient by (code column, code)) of a one-hot ridge; statistics are counts and sums by code and pair of codes,
    so what comes to the driver is bounded by the codebooks' sizes."""
    n, mean = train.agg(F.count(F.lit(1)), F.avg(target)).first()
    keys: list[tuple[str, object]] = []
    sums: dict[tuple[str, object], tuple[int, float]] = {}
    for c in codes:
        for r in train.groupBy(c).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target) - F.lit(mean)).alias("s")).orderBy(c).collect():
            keys.append((c, r[0]))
            sums[c, r[0]] = (r["n"], r["s"])
    at = {k: i for i, k in enumerate(keys)}
    gram = np.diag([float(sums[k][0]) for k in keys])
    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            for r in train.groupBy(a, b).count().collect():
                gram[at[a, r[0]], at[b, r[1]]] = gram[at[b, r[1]], at[a, r[0]]] = r[2]
    share = np.array([sums[k][0] for k in keys]) / n
    centered = gram - n * np.outer(share, share)
    coef = np.linalg.solve(centered + alpha * np.eye(len(keys)), np.array([sums[k][1] for k in keys]))
    return float(mean - share @ coef), dict(zip(keys, coef.tolist(), strict=True))


def predict_additive(df: DataFrame, model: tuple[float, dict]) -> DataFrame:
    """Adds ``prediction`` and ``all_seen``; unseen codes add nothing."""
    base, coef = model
    total, seen = F.lit(base), F.lit(True)
    for c in sorted({k[0] for k in coef}):
        table = F.create_map(*(x for (col, v), w in coef.items() if col == c for x in (F.lit(v), F.lit(w))))
        total = total + F.coalesce(F.try_element_at(table, F.col(c)), F.lit(0.0))
        seen = seen & F.map_contains_key(table, F.col(c))
    return df.withColumns({"prediction": total, "all_seen": seen})


def continuous_ridge(df: DataFrame, x: list[str], y: str, alpha: float) -> np.ndarray:
    """Intercept and weights on standardised columns, from one aggregation of products."""
    names = ["1", *x, y]
    cells = {(a, b): F.sum((F.lit(1.0) if a == "1" else F.col(a)) * (F.lit(1.0) if b == "1" else F.col(b))) for i, a in enumerate(names) for b in names[i:]}
    row = df.agg(*(v.alias(f"c{k}") for k, v in enumerate(cells.values()))).first()
    value = dict(zip(cells, row, strict=True))
    n = value["1", "1"]
    mean = np.array([value["1", c] for c in x]) / n
    my = value["1", y] / n
    cov = np.array([[value[(a, b) if (a, b) in value else (b, a)] for b in x] for a in x]) / n - np.outer(mean, mean)
    cross = np.array([value[a, y] for a in x]) / n - mean * my
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    w = np.linalg.solve(cov / np.outer(scale, scale) + alpha / n * np.eye(len(x)), cross / scale) / scale
    return np.concatenate([[my - mean @ w], w])


def mixed_ridge(train: DataFrame, x: list[str], codes: list[str], target: str, alpha: float) -> tuple[float, dict[str, float], dict[tuple[str, object], float]]:
    """(intercept, weight by continuous column, weight by (code column, code)) of a ridge on standardised columns of both kinds.

    A code is a column of zeros and ones; constant columns have no weight.  The executors sum products of continuous columns, and by
    code and pair of codes counts and sums, so what comes to the driver is bounded by columns and codebooks.
    """
    numbers = [*x, target]
    cells = {(a, b): F.sum(F.col(a).cast("double") * F.col(b)) for k, a in enumerate(numbers) for b in numbers[k:]}
    row = train.agg(F.count(F.lit(1)), *(F.sum(F.col(c).cast("double")) for c in numbers), *cells.values()).first()
    n, first, products = row[0], dict(zip(numbers, row[1:], strict=False)), dict(zip(cells, row[1 + len(numbers) :], strict=True))
    columns: list = [*x]
    cross = {(a, b): v for (a, b), v in products.items()}
    for c in codes:
        for r in train.groupBy(c).agg(F.count(F.lit(1)), *(F.sum(F.col(v).cast("double")) for v in numbers)).where(F.col(c).isNotNull()).orderBy(c).collect():
            key = (c, r[0])
            columns.append(key)
            first[key] = cross[key, key] = float(r[1])
            cross.update({(v, key): s for v, s in zip(numbers, r[2:], strict=True)})
    for k, a in enumerate(codes):
        for b in codes[k + 1 :]:
            cross.update({((a, r[0]), (b, r[1])): float(r[2]) for r in train.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).count().collect()})
    product = lambda a, b: cross.get((a, b), cross.get((b, a), 0.0))
    mean = np.array([first[c] for c in columns]) / n
    covariance = np.array([[product(a, b) for b in columns] for a in columns]) / n - np.outer(mean, mean)
    with_target = np.array([product(c, target) for c in columns]) / n - mean * first[target] / n
    scale = np.sqrt(np.maximum(np.diag(covariance), 0))
    live = np.flatnonzero(scale > 1e-9)
    unit = covariance[np.ix_(live, live)] / np.outer(scale[live], scale[live])
    weight = np.zeros(len(columns))
    weight[live] = np.linalg.solve(unit + alpha / n * np.eye(len(live)), with_target[live] / scale[live]) / scale[live]
    named = dict(zip(columns, weight.tolist(), strict=True))
    return float(first[target] / n - mean @ weight), {c: named[c] for c in x}, {c: w for c, w in named.items() if isinstance(c, tuple)}


def predict_mixed(df: DataFrame, model: tuple[float, dict, dict]) -> DataFrame:
    """Adds ``prediction`` and ``all_seen``; unseen codes add nothing."""
    base, numbers, codes = model
    out = predict_additive(df, (base, codes))
    return out.withColumn("prediction", sum((F.lit(w) * F.col(c) for c, w in numbers.items()), F.col("prediction")))
