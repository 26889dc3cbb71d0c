"""Means and co-moments of many columns, pair by pair, in one mergeable matrix.

For columns a and b only the rows where both are known count. A block of rows gives, for
all pairs at once, the number of such rows, the means, the centred sums of squares and
products, and the smallest and largest value: a few matrix products over the values and
the masks of their nulls. Two blocks merge exactly as two samples do, so blocks are
merged in a tree of tasks, in a fixed order, and one small matrix reaches the driver
however many rows there are.

A null is unknown, and so is a NaN or an infinity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows of a block, and partial matrices that one task or the driver merges.
BLOCK_ROWS, FAN_IN = 1 << 14, 64


@dataclass
class Moments:
    """Matrices [a, b] over the rows where columns a and b are known: their number, the
    mean, squares about it, smallest and largest value of a, and products with b."""

    n: np.ndarray
    mean: np.ndarray
    squares: np.ndarray
    products: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def bytes(self) -> bytes:
        return np.stack([self.n, self.mean, self.squares, self.products, self.least, self.most]).tobytes()

    @classmethod
    def of_bytes(cls, data: bytes) -> Moments:
        k = round((len(data) / 48) ** 0.5)
        return cls(*np.frombuffer(data).reshape(6, k, k))

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        share = other.n / np.maximum(n, 1)
        apart = other.mean - self.mean
        both = self.n * share
        return Moments(
            n, self.mean + apart * share, self.squares + other.squares + apart * apart * both,
            self.products + other.products + apart * apart.T * both,
            np.minimum(self.least, other.least), np.maximum(self.most, other.most))

    def correlation(self) -> np.ndarray:
        """Pearson's; NaN where either column is constant or no row knows both. The
        smallest and largest value say exactly what is constant."""
        varied = (self.least < self.most) & (self.least < self.most).T
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(varied, self.products / np.sqrt(self.squares * self.squares.T), np.nan)


def of_block(values: np.ndarray) -> Moments:
    """Moments of rows x columns, NaN where a value is unknown."""
    known = np.isfinite(values)
    mask = known.astype(float)
    n = mask.T @ mask
    # About a middle of the block, so that the sums of squares lose little.
    middle = np.where(known, values, 0).sum(axis=0) / np.maximum(mask.sum(axis=0), 1)
    x = np.where(known, values - middle, 0.0)
    sums = x.T @ mask
    mean = sums / np.maximum(n, 1)
    squares = (x * x).T @ mask - sums * mean
    products = x.T @ x - sums * mean.T
    low, high = np.where(known, values, np.inf), np.where(known, values, -np.inf)
    if known.all():
        least, most = (np.repeat(v[:, None], values.shape[1], axis=1) for v in (low.min(axis=0), high.max(axis=0)))
    else:
        least = np.stack([np.where(known[:, [b]], low, np.inf).min(axis=0) for b in range(values.shape[1])], axis=1)
        most = np.stack([np.where(known[:, [b]], high, -np.inf).max(axis=0) for b in range(values.shape[1])], axis=1)
    return Moments(n, np.where(n > 0, mean + middle[:, None], 0), np.maximum(squares, 0), products, least, most)


def _merge(found) -> Moments | None:
    out = None
    for one in found:
        out = one if out is None else out.merged(one)
    return out


def _row(task: int, moments: Moments) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int64()), "data": [moments.bytes()]})


def moments(df: DataFrame, columns) -> Moments | None:
    """The matrices of the named columns; None without rows."""
    numbers = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def block(batches):
        from pyspark import TaskContext

        def parts():
            for batch in batches:
                values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
                for i in range(0, len(values), BLOCK_ROWS):
                    yield of_block(values[i:i + BLOCK_ROWS])

        out = _merge(parts())
        if out is not None:
            yield _row(TaskContext.get().partitionId(), out)

    def join(batches):
        task, found = None, []
        for batch in batches:
            task = batch.column("task")[0].as_py() if task is None else task
            found += map(Moments.of_bytes, batch.column("data").to_pylist())
        if found:
            yield _row(task // FAN_IN, _merge(found))

    made, tasks = numbers.mapInArrow(block, "task long, data binary"), numbers.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        made = made.repartition(tasks, F.floor(F.col("task") / FAN_IN)).sortWithinPartitions("task").mapInArrow(
            join, "task long, data binary")
    # One row per group of tasks, FAN_IN at most.
    return _merge(Moments.of_bytes(r["data"]) for r in sorted(made.collect()))
