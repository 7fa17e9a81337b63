"""K-Means for many k and many starts at once.

All runs move together: a pass over the points adds up the sums of every centre of
every run, and the driver sees k rows a run. Points are first folded to distinct
cells with weights. Starts are drawn far from each other: the next centre is a cell
drawn with probability in proportion to weight times squared distance, as the
least of exponential times whose randomness is a hash of run, step and cell, so
that results do not depend on how the cells are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Cells per task at most, at least where cores are free, and per step inside a task.
CELLS_PER_TASK, LEAST_CELLS = 100_000, 1000
STEP = 1024
_MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Fit:
    """Centres of one run and the squared distances to them, summed."""

    k: int
    centres: np.ndarray
    inertia: float


def _spread(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def _chance(points: np.ndarray, salt: int) -> np.ndarray:
    """A fixed number in (0, 1) for each point."""
    x = np.full(len(points), salt, np.uint64)
    for column in np.ascontiguousarray(points).view(np.uint64).T:
        x = _spread(x ^ column)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _steps(batches: Iterator[pa.RecordBatch], cols: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        points = np.column_stack([batch.column(c).to_numpy() for c in cols])
        weights = batch.column("w").to_numpy().astype(np.float64)
        for at in range(0, len(points), STEP):
            yield points[at:at + STEP], weights[at:at + STEP]


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    far = np.zeros((len(points), len(centres)))
    for x, c in zip(points.T, centres.T, strict=True):
        far += (x[:, None] - c[None, :]) ** 2
    return far


def _drawn(runs: list[tuple[int, np.ndarray]], salt: int, cols: Sequence[str]) -> Callable:
    """The first cell to come up for every run, of those in this task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for points, weights in _steps(batches, cols):
            for no, centres in runs:
                far = _distances(points, centres).min(axis=1) if len(centres) else np.ones(len(points))
                with np.errstate(divide="ignore"):
                    time = -np.log(_chance(points, salt + no)) / (weights * far)
                i = int(np.argmin(time))
                best[no] = min(best.get(no, (np.inf,)), (float(time[i]), *map(float, points[i])))
        columns = list(zip(*((no, *b) for no, b in best.items() if len(b) > 1), strict=True))
        if columns:
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.float64()) for c in columns[1:])],
                                             names=["run", "time", *cols])

    return task


def _moved(runs: list[tuple[int, np.ndarray]], cols: Sequence[str]) -> Callable:
    """Weight, sums and squared distances of the cells nearest to every centre of every run."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {no: np.zeros((len(centres), len(cols) + 2)) for no, centres in runs}
        every = np.concatenate([c for _, c in runs])
        for points, weights in _steps(batches, cols):
            far, at = _distances(points, every), 0
            for no, centres in runs:
                own = far[:, at:at + len(centres)]
                at += len(centres)
                label = own.argmin(axis=1)
                for j, value in enumerate([np.ones(len(points)), *points.T, own[np.arange(len(points)), label]]):
                    total[no][:, j] += np.bincount(label, weights * value, minlength=len(centres))
        for no, sums in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sums), no, np.int32)), pa.array(np.arange(len(sums), dtype=np.int32)), *map(pa.array, sums.T.copy())],
                names=["run", "centre", "w", *cols, "far"])

    return task


def fit_all(scaled: DataFrame, ks: Sequence[int], cols: Sequence[str], n_init: int = 10, seed: int = 42, max_iter: int = 300,
            tol: float = 1e-4) -> list[Fit]:
    """Every run of every k: `n_init` starts each, moved until the squared shifts of its
    centres sum to `tol` or less. Fewer distinct cells than k give as many centres
    as there are cells; without rows there are no centres. An empty cluster keeps its centre.
    """
    width = [f"{c} double" for c in cols]
    cells = scaled.groupBy(*cols).agg(F.count("*").alias("w")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = cells.count()
        cores = min(scaled.sparkSession.sparkContext.defaultParallelism, 1 + n // LEAST_CELLS)
        table = cells.coalesce(max(cores, 1 + n // CELLS_PER_TASK))
        size = [k for k in ks for _ in range(n_init)]
        centres = [np.zeros((0, len(cols))) for _ in size]
        for step in range(max(ks)):
            open_ = [(no, centres[no]) for no, k in enumerate(size) if k > step]
            least = F.min(F.struct("time", *cols)).alias("first")
            found = (table.mapInArrow(_drawn(open_, seed * 1_000_003 + step * 10_007, cols), ", ".join(["run int", "time double", *width]))
                     .groupBy("run").agg(least).collect())
            for row in found:
                if np.isfinite(row.first.time):
                    centres[row.run] = np.vstack([centres[row.run], [row.first[c] for c in cols]])

        def sums(runs: list[int]) -> dict[int, list]:
            out: dict[int, list] = {no: [] for no in runs}
            given = [(no, centres[no]) for no in runs if len(centres[no])]
            if given:
                parts = table.mapInArrow(_moved(given, cols), ", ".join(["run int", "centre int", "w double", *width, "far double"]))
                for row in parts.groupBy("run", "centre").agg(*[F.sum(c).alias(c) for c in ("w", *cols, "far")]).collect():
                    out[row.run].append(row)
            return out

        moving = list(range(len(size)))
        for _ in range(max_iter):
            if not moving:
                break
            still = []
            for no, found in sums(moving).items():
                new = centres[no].copy()
                for row in found:
                    if row.w:
                        new[row.centre] = [row[c] / row.w for c in cols]
                if ((new - centres[no]) ** 2).sum() > tol:
                    still.append(no)
                centres[no] = new
            moving = still
        inertia = {no: sum(row.far for row in found) for no, found in sums(list(range(len(size)))).items()}
    finally:
        cells.unpersist()
    return [Fit(k, centres[no], inertia[no]) for no, k in enumerate(size)]
