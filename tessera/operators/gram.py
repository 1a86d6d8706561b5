"""One pass over a table for many ridge readouts: a block Gram matrix of dense columns, code indicators and targets.

Tasks sum, for each split, the products of all columns: dense columns by matrix products on Arrow batches, a code column against dense ones by sums over its
codes, two code columns by counts of their pairs.  Blocks of rows of the matrix are added up over tasks by shuffle, first within groups of tasks, so no
task adds more than a block of a group.  What comes to the driver is the matrix, whose size is bounded by columns and codes.  Every
model (a choice of columns), target and ridge is then a sub-block, solved by Cholesky, and its error on any split is read off that split's matrix: no second
pass, no row is predicted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..shipping import ensure_importable

#: Rows of the matrix that are added up together, and tasks whose parts are put together first.
_ROWS, _GROUP = 256, 32


@dataclass
class Gram:
    """Sums of products over the rows of one split; ``columns`` names each row and column: ``1``, dense (name or (name, place)), (code column, code), targets."""

    columns: list
    matrix: np.ndarray

    def places(self, names: Sequence[str]) -> np.ndarray:
        """Where the columns of the given dense and code columns are."""
        wanted = set(names)
        return np.array([k for k, c in enumerate(self.columns) if (c[0] if isinstance(c, tuple) else c) in wanted], int)


def _layout(df: DataFrame, dense: Sequence[str], codes: Mapping[str, int], targets: Sequence[str], widths: Mapping[str, int]) -> list:
    out: list = ["1"]
    for c in (*dense, *targets):
        out += [(c, k) for k in range(widths[c])] if isinstance(df.schema[c].dataType, ArrayType) else [c]
    return out + [(c, k) for c, n in codes.items() for k in range(n)]


def block_gram(df: DataFrame, dense: Sequence[str], codes: Mapping[str, int], targets: Sequence[str], split: str, widths: Mapping[str, int] | None = None) -> dict[str, Gram]:
    """The Gram matrix of each value of ``split`` from one scan.

    ``dense`` and ``targets``: number columns, or arrays whose lengths ``widths`` gives; ``codes``: columns of integers below their number of codes.  A null or
    other code has no indicator.  Rows in which a number is null, not finite or an array has another length are an error, as is a null split.
    """
    ensure_importable(df.sparkSession)
    widths = widths or {}
    numbers, names = [*dense, *targets], list(codes)
    columns = _layout(df, dense, codes, targets, widths)
    width = len(columns) - sum(codes.values())
    begins = np.concatenate([[width], width + np.cumsum([codes[c] for c in names])]).astype(int) if names else np.array([width])
    arrays = [isinstance(df.schema[c].dataType, ArrayType) for c in numbers]
    shape = [widths.get(c, 1) for c in numbers]
    side = len(columns)

    def add(total: np.ndarray, batch_numbers: np.ndarray, batch_codes: list[np.ndarray]) -> None:
        total[:width, :width] += batch_numbers.T @ batch_numbers
        for i, a in enumerate(batch_codes):
            seen = np.flatnonzero(a >= 0)
            order = seen[np.argsort(a[seen], kind="stable")]
            if not len(order):
                continue
            first = np.flatnonzero(np.diff(a[order], prepend=-1))
            total[begins[i] + a[order][first], :width] += np.add.reduceat(batch_numbers[order], first)
            for j in range(i, len(batch_codes)):
                both = seen[batch_codes[j][seen] >= 0]
                n = codes[names[j]]
                pair, count = np.unique(a[both].astype(np.int64) * n + batch_codes[j][both], return_counts=True)
                total[begins[i] + pair // n, begins[j] + pair % n] += count

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [np.ones((batch.num_rows, 1))]
            for k, (is_array, n) in enumerate(zip(arrays, shape, strict=True)):
                column = batch.column(1 + k)
                values = column.flatten() if is_array else column
                if column.null_count or values.null_count or len(values) != n * batch.num_rows:
                    raise ValueError(f"{numbers[k]} has nulls or another length than {n}")
                x = values.to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, n)
                if not np.isfinite(x).all():
                    raise ValueError(f"{numbers[k]} isn't finite")
                parts.append(x)
            x = np.hstack(parts)
            found = []
            for k, c in enumerate(names):
                v = batch.column(1 + len(numbers) + k).fill_null(-1).to_numpy(zero_copy_only=False)
                found.append(np.where((v >= 0) & (v < codes[c]), v, -1))
            splits = np.array(batch.column(0).to_pylist(), object)
            if any(s is None for s in splits):
                raise ValueError("every row needs a split")
            for s in sorted(set(splits)):
                own = splits == s
                add(totals.setdefault(s, np.zeros((side, side))), x[own], [v[own] for v in found])
        group = TaskContext.get().partitionId() // _GROUP
        for s, total in totals.items():
            for at in range(0, side, _ROWS):
                yield pa.RecordBatch.from_pydict({"split": [s], "at": pa.array([at], pa.int32()), "group": pa.array([group], pa.int32()), "block": pa.array([total[at : at + _ROWS].tobytes()], pa.binary())})

    def summed(table):
        import pyarrow as pa

        total = np.add.reduce([np.frombuffer(x) for x in table.column("block").to_pylist()])
        return pa.table({"split": table.column("split")[:1], "at": table.column("at")[:1], "group": pa.array([0], pa.int32()), "block": pa.array([total.tobytes()], pa.binary())})

    schema = "split string, at int, group int, block binary"
    picked = df.select(F.col(split).cast("string").alias("split"), *(F.col(c) if a else F.col(c).cast("double").alias(c) for c, a in zip(numbers, arrays, strict=True)), *(F.col(c).cast("long").alias(c) for c in names))
    parts = picked.mapInArrow(run, schema)
    parts = parts.groupBy("split", "at", "group").applyInArrow(summed, schema).groupBy("split", "at").applyInArrow(summed, schema)
    out: dict[str, Gram] = {}
    for r in parts.collect():  # the matrices, by blocks of rows
        out.setdefault(r["split"], Gram(columns, np.zeros((side, side)))).matrix[r["at"] : r["at"] + _ROWS] = np.frombuffer(r["block"]).reshape(-1, side)
    for g in out.values():  # codes were summed against dense columns, and pairs of codes, on one side of the diagonal only
        m = g.matrix
        m[:width, width:] = m[width:, :width].T
        lower = np.tril_indices(side, -1)
        codes_only = (lower[0] >= width) & (lower[1] >= width)
        m[lower[0][codes_only], lower[1][codes_only]] = m[lower[1][codes_only], lower[0][codes_only]]
    return out


@dataclass
class Readout:
    """A ridge readout: its intercept and weights by column."""

    intercept: np.ndarray
    weights: dict


def solve(gram: Gram, columns: Sequence[str], target: str, alphas: Sequence[float]) -> dict[float, Readout]:
    """Ridge readouts of a target on standardised columns, one for each alpha; constant columns have no weight.

    The covariance of the model's columns is put together once; each alpha is one Cholesky decomposition.
    """
    m, own, to = gram.matrix, gram.places(columns), gram.places([target])
    n = m[0, 0]
    mean, target_mean = m[own, 0] / n, m[to, 0] / n
    covariance = m[np.ix_(own, own)] / n - np.outer(mean, mean)
    cross = m[np.ix_(own, to)] / n - np.outer(mean, target_mean)
    scale = np.sqrt(np.maximum(np.diag(covariance), 0))
    live = np.flatnonzero(scale > 1e-9)
    unit = covariance[np.ix_(live, live)] / np.outer(scale[live], scale[live])
    out = {}
    for alpha in alphas:
        weights = np.zeros((len(own), len(to)))
        if len(live):
            lower = np.linalg.cholesky(unit + alpha / n * np.eye(len(live)))
            half = np.linalg.solve(lower, cross[live] / scale[live, None])
            weights[live] = np.linalg.solve(lower.T, half) / scale[live, None]
        out[alpha] = Readout(target_mean - mean @ weights, {gram.columns[k]: w for k, w in zip(own, weights, strict=True)})
    return out


def squared_error(gram: Gram, target: str, model: Readout) -> tuple[float, float]:
    """(squared error, total variation around the mean) of a readout over the rows of ``gram``, both sums over the target's columns."""
    m, to = gram.matrix, gram.places([target])
    index = {c: k for k, c in enumerate(gram.columns)}
    own = np.array([0, *(index[c] for c in model.weights)])
    w = np.vstack([model.intercept, *model.weights.values()]).reshape(len(own), len(to))
    total = np.trace(m[np.ix_(to, to)])
    error = total - 2 * np.sum(w * m[np.ix_(own, to)]) + np.sum(w * (m[np.ix_(own, own)] @ w))
    return float(max(error, 0.0)), float(total - np.sum(m[to, 0] ** 2) / m[0, 0])


def readout_grid(grams: Mapping[str, Gram], models: Mapping[str, Sequence[str]], targets: Sequence[str], alphas: Sequence[float], train: str = "train", choose: str = "val") -> list[dict]:
    """A row for each model, target, alpha and split: rows, mse, reduction (share of the train mean's error that is gone) and whether ``choose`` picks the alpha.

    The alpha with the largest reduction on ``choose`` is picked, the smaller of those equal to nine decimals: over many rows ridges differ by less than sums round.
    """
    rows = []
    for name, columns in models.items():
        for target in targets:
            fits = solve(grams[train], columns, target, alphas)
            base = Readout(grams[train].matrix[grams[train].places([target]), 0] / grams[train].matrix[0, 0], {})
            own = []
            for alpha, model in fits.items():
                for split, gram in grams.items():
                    n = gram.matrix[0, 0]
                    error, reference = squared_error(gram, target, model)[0], squared_error(gram, target, base)[0]
                    own.append({"model": name, "target": target, "alpha": float(alpha), "split": split, "rows": int(n), "mse": float(error / n), "reduction": float(1 - error / reference) if reference > 0 else 0.0})
            best = max((r for r in own if r["split"] == (choose if choose in grams else train)), key=lambda r: (round(r["reduction"], 9), -r["alpha"]))["alpha"]
            rows += [r | {"chosen": r["alpha"] == best} for r in own]
    return rows
