"""LASSO over tens of thousands of columns, on the product table of those that matter.

Penalties are met from the largest down. The sequential strong rule foretells from the
gradient at one solution which columns may enter at the next penalty; the path is solved
on the product table of these columns alone, and a pass over the rows checks the
optimality conditions of *all* columns at every solution of a run of penalties. Columns
that violate them join, and the run is solved again, so the result is that of the whole
table. The driver holds a few numbers for each column and the table of the screened ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yieldscope.operators import linear
from yieldscope.operators.gram import HELD, MAX_WIDTH, Gram, grams, total
from yieldscope.operators.sums import collected, merged

RUN = 8             # penalties whose solutions one check looks at
SLICE = 2_048       # columns of a piece of the gradient
STEP = 0.85         # ratio of penalties on the way to the first one asked for
GROWTH = 256        # columns that join at once, the strongest first; the others if still needed
SLACK = 1e-6        # share by which a gradient may exceed its penalty, for rounding


@dataclass
class Screened:
    """The columns kept, in order, and the product sums per part on them (columns in units of ``scale``)."""

    columns: list[int]
    parts: dict[int, Gram]
    scale: np.ndarray
    passes: int


def _first_sums(points: DataFrame, width: int) -> dict[int, np.ndarray]:
    """Per part the rows ``n, Σy, Σy²``, then ``Σx``, ``Σx²`` and ``Σxy`` of all columns."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for part, x, y in _rows(batches):
            for p in np.unique(part).tolist():
                xp, yp = x[part == p], y[part == p]
                made = np.concatenate([[len(yp), yp.sum(), yp @ yp], xp.sum(axis=0), np.einsum("ij,ij->j", xp, xp), xp.T @ yp])
                sums[p] = sums.get(p, 0.0) + made
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))],
                                             names=["part", "v"])

    return {p: v for (p,), v in collected(points.mapInArrow(partial, "part int, v array<double>"), ["part"]).items()}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield (batch.column("part").to_numpy(zero_copy_only=False),
                   batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1),
                   batch.column("y").to_numpy(zero_copy_only=False))


def _exceeding(points: DataFrame, width: int, columns: list[int], fits: Sequence[frozenset], weights: list[np.ndarray],
               shifts: list[np.ndarray], scale: np.ndarray, penalties: list[np.ndarray], floors: np.ndarray) -> DataFrame:
    """``(j, at, excess)``: columns whose gradient at solution ``at`` is ``excess`` times its penalty, from ``floors`` on.

    For each fit, ``weights`` has a row for each solution on ``columns`` and ``shifts`` an
    intercept. Pieces of the gradient are summed where they lie; only what exceeds leaves.
    """
    if width * len(fits) * len(floors) * 8 > HELD:
        raise ValueError("the gradients of a run are more than a task holds; check fewer penalties at once")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for part, x, y in _rows(batches):
            for f, fit in enumerate(fits):
                mine = np.isin(part, list(fit))
                rest = y[mine][:, None] - x[mine][:, columns] @ weights[f].T - shifts[f]
                sums[f] = sums.get(f, 0.0) + x[mine].T @ rest
        for f, made in sums.items():
            for at in range(0, width, SLICE):
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([at], pa.int32()),
                                                  pa.array([made[at:at + SLICE].ravel()], pa.list_(pa.float64()))], names=["fit", "at", "v"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, at, v in zip(batch.column("fit").to_pylist(), batch.column("at").to_pylist(), batch.column("v")):
                g = np.abs(v.values.to_numpy(zero_copy_only=False).reshape(-1, len(floors)))
                over = g / scale[at:at + len(g), None] / penalties[f]
                j, solution = np.nonzero(over >= floors)
                yield pa.RecordBatch.from_arrays([pa.array(at + j, pa.int32()), pa.array(solution, pa.int32()),
                                                  pa.array(over[j, solution])], names=["j", "at", "excess"])

    parts = points.mapInArrow(partial, "fit int, at int, v array<double>")
    return merged(parts, ["fit", "at"]).mapInArrow(judge, "j int, at int, excess double").groupBy("j", "at").agg(
        F.max("excess").alias("excess"))


def screen(df: DataFrame, part: Column, fits: Callable[[set[int]], Sequence[frozenset]], alphas: Sequence[float],
           intercept: bool = True, unit: bool = False, run: int = RUN) -> Screened:
    """The columns that any LASSO solution on the path can hold, with their product sums.

    ``df`` has complete ``features`` and ``y``, is read several times and should be cached;
    ``part`` numbers sets of rows, and ``fits`` names those that each model is fitted on.
    ``unit`` divides columns by their norm over all rows. A path whose models hold more
    than ``MAX_WIDTH`` columns is an error: its smallest penalties are no selection.
    """
    points = df.select(part.cast("int").alias("part"), "features", F.col("y").cast("double").alias("y"))
    one = points.select(F.size("features").alias("n")).first()
    width = one["n"]
    sums = _first_sums(points, width)
    models = [frozenset(f) for f in fits(set(sums))]
    whole = sum(sums.values())
    scale = np.sqrt(whole[3 + width:3 + 2 * width]) if unit else np.ones(width)
    scale = np.where(scale > 0, scale, 1.0)
    alphas = np.sort(np.asarray(alphas, dtype=float))[::-1]
    counts, centred = [], []
    for f in models:
        held = sum(sums[p] for p in f if p in sums)
        n, mean_y = held[0], held[1] / held[0] if intercept else 0.0
        counts.append(n)
        centred.append(np.abs(held[3 + 2 * width:] - held[3:3 + width] * mean_y) / scale / n)
    strength = np.max(centred, axis=0)  # the gradient at the empty model
    top = float(strength.max())
    # larger penalties leave every model empty; steps down to the first that does not keep the rule sharp
    alphas = alphas[int(np.searchsorted(-alphas, -top)):]
    if len(alphas):
        steps = int(np.ceil(np.log(top / alphas[0]) / -np.log(STEP)))
        alphas = np.concatenate([top * STEP ** np.arange(1, steps), alphas])
    columns: list[int] = []
    parts: dict[int, Gram] = {}
    passes, at = 1, 0

    def grown(more: Sequence[int]) -> None:
        nonlocal columns, parts, passes
        columns = sorted({*columns, *map(int, more)})
        if len(columns) + 2 > MAX_WIDTH:
            raise ValueError(f"penalties down to {alphas[min(at + run, len(alphas)) - 1]:g} hold more than {MAX_WIDTH - 2} columns")
        places = F.expr("array(" + ",".join(map(str, columns)) + ")")
        slim = points.select("part", "y", F.transform(places, lambda i: F.get("features", i)).alias("features"))
        parts = {p: g.unit_columns(scale[columns]) for p, g in grams(slim, F.col("part")).items()}
        passes += 1

    # what the strong rule foretells from the empty model; at least one column, to have a table
    order = np.argsort(-strength, kind="stable")[:GROWTH]
    foretold = order[strength[order] >= 2 * alphas[0] - top] if len(alphas) else order[:1]
    grown(foretold if len(foretold) else order[:1])
    while at < len(alphas):
        some, after = alphas[at:at + run], alphas[at + run] if at + run < len(alphas) else None
        if not set(map(int, foretold)) <= set(columns):
            grown(foretold)
        floors = np.full(len(some), 1 + SLACK)
        if after is not None:
            floors[-1] = max(2 * after - some[-1], some[-1] / 2) / some[-1]
        while True:
            weights, shifts = [], []
            for f in models:
                table = total({p: g for p, g in parts.items() if p in f})
                q, c = table.centred() if intercept else (table.xx, table.xy)
                w = linear.lasso_path(q / table.n, c / table.n, some, linear.spread_of(table))
                means = table.table[0, 1:] / table.n
                shifts.append(means[-1] - w @ means[:-1] if intercept else np.zeros(len(some)))
                weights.append(w / scale[columns])
            found = _exceeding(points, width, columns, models, weights, shifts, scale, [some * n for n in counts], floors).toPandas()
            passes += 1
            bad = found[(found["excess"] > 1 + SLACK) & ~found["j"].isin(columns)]
            if bad.empty:
                break
            # solutions behind the first violated one are not to be trusted yet
            grown(bad[bad["at"] == bad["at"].min()].nlargest(GROWTH, "excess")["j"])
        foretold = found[found["at"] == len(some) - 1].nlargest(GROWTH, "excess")["j"].to_numpy()
        at += run
    return Screened(columns, parts, scale, passes)


def lasso_grid(df: DataFrame, side: Column, alphas: Sequence[float], unit: bool = True) -> tuple[list[dict], Screened]:
    """``linear.lasso_grid`` over any number of columns; ``side`` is 0 for train and 1 for test rows."""
    held = screen(df, side, lambda parts: [frozenset({0})], alphas, unit=unit)
    return linear.lasso_grid(held.parts[0], held.parts[1], alphas), held


def lasso_cv(df: DataFrame, fold: Column, alphas: Sequence[float]) -> dict:
    """``linear.lasso_cv`` over any number of columns: ``alpha``, ``mse`` and ``coefs`` (by column, zeros left out)."""
    held = screen(df, fold, lambda parts: [frozenset(parts), *(frozenset(parts - {p}) for p in sorted(parts))], alphas)
    fit = linear.lasso_cv(held.parts, alphas)
    coefs = {held.columns[j]: float(c) for j, c in enumerate(fit["coefs"]) if c != 0}
    return {"alpha": fit["alpha"], "mse": fit["mse"], "coefs": coefs, "passes": held.passes}


def lasso(df: DataFrame, alpha: float) -> dict:
    """``linear.lasso`` over any number of columns: ``coefs`` (by column, zeros left out) and both scores."""
    held = screen(df, F.lit(0), lambda parts: [frozenset(parts)], [alpha], intercept=False)
    fit = linear.lasso(total(held.parts), alpha)
    return {**fit, "coefs": {held.columns[j]: float(c) for j, c in enumerate(fit["coefs"]) if c != 0}}
