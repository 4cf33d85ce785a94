"""Least-cost assignment of many points to many points by auction, with memory for points and prices but never for pairs.

Every column has a price. A row without a column bids for the one that is best for it at those prices, up to what the second
best would be worth, and a little more (epsilon); the highest bid takes the column from its holder. An assignment in
which each row's column is within epsilon of its best costs at most epsilon a row more than the least. Epsilon shrinks from
phase to phase; prices stay, and so do pairs that still hold at the new one. The prices certify the result: rows' best
values and prices bound any assignment's cost from below.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Pairs whose distances are worked out at once.
BLOCK_PAIRS = 4_000_000

#: Bids on fewer pairs than that are worked out where the prices are, those on more by executors.
SPREAD_PAIRS = 50_000_000

Best = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def best_two(rows: np.ndarray, cols: np.ndarray, price: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row its best column, its value there (less distance and price) and the second best value."""
    n, m = len(rows), len(cols)
    at, first, second = np.zeros(n, np.int64), np.zeros(n), np.full(n, -np.inf)
    step = max(1, BLOCK_PAIRS // max(1, m))
    for i in range(0, n, step):
        v = -np.hypot(rows[i : i + step, None, 0] - cols[None, :, 0], rows[i : i + step, None, 1] - cols[None, :, 1]) - price
        k = np.arange(len(v))
        at[i : i + step] = v.argmax(1)
        first[i : i + step] = v[k, at[i : i + step]]
        v[k, at[i : i + step]] = -np.inf
        second[i : i + step] = v.max(1)
    return at, first, second


def spread(spark: SparkSession) -> Best:
    """best_two with the rows dealt out to executors, where there are enough of them."""

    def best(rows: np.ndarray, cols: np.ndarray, price: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(rows) * len(cols) < SPREAD_PAIRS:
            return best_two(rows, cols, price)
        held = spark.sparkContext.broadcast((cols, price))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                i, x, y = (c.to_numpy() for c in b.columns)
                yield pa.RecordBatch.from_arrays([pa.array(i), *map(pa.array, best_two(np.stack([x, y], 1), *held.value))], ["i", "at", "first", "second"])

        df = spark.createDataFrame(pa.table({"i": np.arange(len(rows)), "x": rows[:, 0], "y": rows[:, 1]}))
        parts = min(4 * spark.sparkContext.defaultParallelism, -(-len(rows) * len(cols) // BLOCK_PAIRS))
        got = df.repartition(parts).mapInArrow(run, "i long, at long, first double, second double").toArrow()
        held.destroy()
        order = np.argsort(got["i"].to_numpy())
        return tuple(got[c].to_numpy()[order] for c in ("at", "first", "second"))

    return best


def auction(rows: np.ndarray, cols: np.ndarray, best: Best = best_two, tolerance: float = 1e-7) -> tuple[np.ndarray, float]:
    """The column of each row (rows at most columns; points as n x 2 numbers) at a total distance within `tolerance` of the least, and by how much the prices certify it.

    Columns that no row gets are held by as many dummies, to which all columns are alike; dummies without a column bid
    together, for as many of the cheapest columns as they are, up to the price of the next.
    """
    n, m = len(rows), len(cols)
    if not n:
        return np.zeros(0, np.int64), 0.0
    price, owner, held = np.zeros(m), np.full(m, -1), np.full(m, -1)  # holders: rows, then dummies
    far = lambda i, j: np.hypot(rows[i, 0] - cols[j, 0], rows[i, 1] - cols[j, 1])
    span = np.concatenate([rows, cols])
    last = tolerance / m
    epsilon = max(last, float(np.hypot(*(span.max(0) - span.min(0)))) / 4)

    def take(who: np.ndarray, at: np.ndarray) -> None:
        gone = owner[at]
        held[gone[gone >= 0]] = -1
        owner[at], held[who] = who, at

    def release(who: np.ndarray) -> None:
        owner[held[who]] = -1
        held[who] = -1

    while True:
        _, first, _ = best(rows, cols, price)
        own = np.flatnonzero(held[:n] >= 0)
        release(own[-far(own, held[own]) - price[held[own]] < first[own] - epsilon])
        own = n + np.flatnonzero(held[n:] >= 0)
        release(own[price[held[own]] > price.min() + epsilon])
        while True:
            free = np.flatnonzero(held[:n] < 0)
            if len(free):
                at, one, two = best(rows[free], cols, price)
                bid = price[at] + np.where(np.isfinite(two), one - two, 0) + epsilon
                order = np.lexsort((bid, at))
                won = order[np.append(at[order][1:] != at[order][:-1], True)]
                price[at[won]] = bid[won]
                take(free[won], at[won])
            idle = n + np.flatnonzero(held[n:] < 0)
            if len(idle):
                k = len(idle)
                order = np.argpartition(price, k - 1) if k < m else np.arange(m)
                cheap = order[:k]
                price[cheap] = (price[order[k:]].min() if k < m else price.max()) + epsilon
                take(idle, cheap)
            elif not len(free):
                break
        if epsilon <= last:
            break
        epsilon = max(last, epsilon / 5)
    _, first, _ = best(rows, cols, price)
    least = -(first.sum() - (m - n) * price.min() + price.sum())
    return held[:n], float(far(np.arange(n), held[:n]).sum() - least)
