"""Nearest points by brute force over blocks, for numpy algorithms on the driver.

The algorithms take ``each``, which runs a function over tasks: ``here`` in this process, or
``over(spark)`` on the executors, which get the points as a broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import SparkSession

Each = Callable[[Callable, object, list], Iterator]
#: Columns and elements of a block of distances, which is to stay in a processor's cache.
COLUMNS, ELEMENTS = 8192, 1 << 20


def here(f: Callable, shared: object, tasks: list) -> Iterator:
    """The results of ``f(shared, task)`` in order of the tasks."""
    return (f(shared, t) for t in tasks)


def over(spark: SparkSession) -> Each:
    """As ``here``, on the executors; the driver holds the results of a few tasks a core at once."""

    def each(f: Callable, shared: object, tasks: list) -> Iterator:
        context = spark.sparkContext
        held, wave = context.broadcast(shared), 16 * context.defaultParallelism
        try:
            for at in range(0, len(tasks), wave):
                part = tasks[at : at + wave]
                yield from context.parallelize(part, len(part)).map(lambda t: f(held.value, t)).collect()
        finally:
            held.unpersist()

    return each


def _close(x: np.ndarray, squares: np.ndarray, weight: np.ndarray | None, rows: np.ndarray, columns: slice, metric: str) -> np.ndarray:
    """Distances of some rows to a range of columns, up to a function that keeps the order of a row; a row is not close to itself."""
    d = x[rows] @ x[columns].T
    if metric == "cosine":
        np.negative(d, out=d)
    else:
        d *= -2
        d += squares[columns]
        if weight is not None:
            d += squares[rows, None]
            d /= weight[rows, None] + weight[columns]
    own = np.flatnonzero((rows >= columns.start) & (rows < columns.start + d.shape[1]))
    d[own, rows[own] - columns.start] = np.inf
    return d


def distances(x: np.ndarray, weight: np.ndarray | None, left: np.ndarray, right: np.ndarray, metric: str) -> np.ndarray:
    """Distances of each of ``left`` to its row of ``right``, by differences and so without cancellation.

    With weights that is the square over the sum of both.
    """
    out = np.empty(right.shape)
    step = max(1, ELEMENTS // max(1, right.shape[1] * x.shape[1]))
    for at in range(0, len(left), step):
        a, b = left[at : at + step], right[at : at + step]
        if metric == "cosine":
            out[at : at + step] = 1 - np.einsum("ikd,id->ik", x[b], x[a])
        else:
            square = ((x[b] - x[a][:, None]) ** 2).sum(2)
            out[at : at + step] = np.sqrt(square) if weight is None else square / (weight[a][:, None] + weight[b])
    return out


def of_rows(shared: tuple, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, distances) of the nearest others of some rows, nearest first; ties go to the smaller index."""
    x, weight, k, metric = shared
    n = len(x)
    # products cancel less about the mean
    centred = x if metric == "cosine" else x - x.mean(0)
    squares = (centred * centred).sum(1)
    # some more than are asked for, whose distances are then taken without cancellation
    some = min(k + 3, n - 1)
    index, dist = np.zeros((len(rows), some), int), np.zeros((len(rows), some))
    first = min(n, max(COLUMNS, some + 1))
    step = max(1, ELEMENTS // first)
    for at in range(0, len(rows), step):
        part = rows[at : at + step]
        d = _close(centred, squares, weight, part, slice(0, first), metric)
        best = np.argpartition(d, some - 1, axis=1)[:, :some]
        value = np.take_along_axis(d, best, 1)
        for lo in range(first, n, COLUMNS):
            d = _close(centred, squares, weight, part, slice(lo, lo + COLUMNS), metric)
            row, column = np.nonzero(d < value.max(1)[:, None])
            if not len(row):
                continue
            whose = np.concatenate([np.repeat(np.arange(len(part)), some), row])
            found, at_ = np.concatenate([value.ravel(), d[row, column]]), np.concatenate([best.ravel(), column + lo])
            order = np.lexsort((at_, found, whose))
            begin = np.searchsorted(whose[order], np.arange(len(part)))
            take = order[begin[:, None] + np.arange(some)]
            best, value = at_[take], found[take]
        best.sort(axis=1)
        exact = distances(x, weight, part, best, metric)
        order = np.argsort(exact, axis=1, kind="stable")
        index[at : at + step], dist[at : at + step] = np.take_along_axis(best, order, 1), np.take_along_axis(exact, order, 1)
    return index[:, :k], dist[:, :k]


def nearest(points: np.ndarray, k: int, metric: str = "euclidean", each: Each = here, rows: np.ndarray | None = None, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and distances of the ``k`` nearest other points, of all rows or of some."""
    n = len(points)
    x = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12) if metric == "cosine" else points
    rows, k = np.arange(n) if rows is None else rows, min(k, n - 1)
    if k < 1 or not len(rows):
        return np.zeros((len(rows), max(k, 0)), int), np.zeros((len(rows), max(k, 0)))
    # some hundred million distances a task; few are not worth the way
    size = max(1, (1 << 28) // n)
    tasks = [rows[at : at + size] for at in range(0, len(rows), size)]
    found = list((each if len(tasks) > 1 else here)(of_rows, (x, weight, k, metric), tasks))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
