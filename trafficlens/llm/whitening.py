"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

A vector's entries become whole numbers, ``floor(1024 * c) + 100000``, whose sums are
exact. The wanted components are the leading eigenvectors of the covariance V, which is
never formed. A pass sends a block Q of a few columns to all tasks; each centres its
vectors, multiplies twice and hands back XᵀXQ, and these small blocks are added up in
groups of tasks, level by level, in a fixed order.

One round applies a Chebyshev polynomial of V to the block by its recurrence, one pass a
degree. On the unwanted end of the spectrum the polynomial stays below one, above it
grows steeply, so the unwanted directions die away. QR makes the block orthonormal,
Rayleigh-Ritz turns it to approximate eigenvectors. Rounds go on until

* every wanted pair satisfies ``|Vq - eq| <= TOLERANCE * e`` (an eigenvalue lies within
  that of each e), and
* nothing was missed: the largest eigenvalue of V on what the block leaves over, bounded
  through a fresh random block under the same filter, does not pass the last wanted one.

Where a round gains little, as the spectrum has no gap behind the block, the block is
widened; at the full width the result is exact at once.

Nulls and odd cases: a vector that is null, of another length than most (of equally
frequent lengths the longer), or holds a null, a non-finite entry or one of 2^43 or more
is left out; repeated rows count repeatedly; directions without variance have no component, so fewer
than asked may come; equal eigenvalues share a space in which any orthonormal vectors are
right; a table without vectors gives an empty result; columns named as the new ones are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from trafficlens.session import Scratch

#: Entries as whole numbers: scale and shift; larger entries are not exact any more.
SCALE, SHIFT, LARGEST = 1024, 100_000, float(1 << 43)
#: Components, columns of the block beside them, and the polynomial's degree.
COMPONENTS, GUARD, DEGREE = 8, 24, 10
#: Relative residual of a certified pair; eigenvalues below this part of the trace are 0.
TOLERANCE, NOTHING = 1e-12, 1e-13
#: A round that does not shrink the residual so much widens the block.
SLOW = 0.05
MOST_ROUNDS = 60
#: Vectors of a stored block, and partial results that one task or the driver adds up.
BLOCK_ROWS, FAN_IN = 4096, 64
#: Steps of Lanczos that find the lower end of the spectrum, and how differently one
#: round may amplify two wanted directions without losing the lesser in rounding.
LANCZOS, UNEVEN = 10, 1e6
_SEED = 20240601


def whole(values: np.ndarray) -> np.ndarray:
    return np.floor(values * SCALE).astype(np.int64) + SHIFT


def vectors_of(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a usable vector of the length, and those as whole numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    values = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan))
    bad = ~(np.abs(values) < LARGEST)
    before, ends = np.concatenate(([0], np.cumsum(bad))), np.cumsum(lengths)
    keep = (lengths == dims) & (before[ends] == before[ends - lengths])
    return keep, whole(values[np.repeat(keep, lengths)]).reshape(-1, dims)


@dataclass
class Whitening:
    """A fitted whitening: exact sums, eigenvectors as columns, falling eigenvalues, and
    what certifies them: norms of Vq - eq, and how far the covariance of what it whitens
    is from the identity."""

    n: int
    sums: list[int]
    vectors: np.ndarray = None
    values: np.ndarray = None
    trace: float = 0.0
    residuals: np.ndarray = None
    identity_error: float = 0.0
    passes: int = 0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the difference is taken in whole numbers, so it loses nothing."""
        return self.spread(x).astype(np.float64) / self.n

    def spread(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, in 64 bits where they suffice."""
        most = self.n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, self.sums))
        if most < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        d = self.spread(x)
        most = int(np.abs(d).max(initial=0)) if d.size else 0
        if most * most * len(self.sums) >= 1 << 63:
            d = d.astype(object)
        return [int(v) if v < 1 << 63 else None for v in (d * d).sum(axis=1)]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


class _Passes:
    """Passes over the stored vectors."""

    def __init__(self, blocks: DataFrame, model: Whitening):
        self.blocks, self.model, self.count = blocks, model, 0
        self.tasks = blocks.rdd.getNumPartitions()

    def total(self, use) -> np.ndarray:
        """The sum of ``use(centred vectors)``, an array of fixed shape, over all blocks;
        blocks of a task in their order, tasks by number, in groups."""
        model = self.model
        self.count += 1

        def partial(batches):
            from pyspark import TaskContext

            out = None
            for batch in batches:
                for data, rows in zip(batch.column("data").to_pylist(), batch.column("rows").to_pylist()):
                    made = use(model.centred(np.frombuffer(data, np.int64).reshape(rows, -1)))
                    out = made if out is None else out + made
            if out is not None:
                yield pa.RecordBatch.from_pydict(
                    {"task": pa.array([TaskContext.get().partitionId()], pa.int64()), "data": [out.tobytes()]})

        def merge(batches):
            out, first = None, None
            for batch in batches:
                for task, data in zip(batch.column("task").to_pylist(), batch.column("data").to_pylist()):
                    made = np.frombuffer(data)
                    out, first = (made, task) if out is None else (out + made, first)
            if out is not None:
                yield pa.RecordBatch.from_pydict({"task": pa.array([first // FAN_IN], pa.int64()), "data": [out.tobytes()]})

        partials, tasks = self.blocks.mapInArrow(partial, "task long, data binary"), self.tasks
        while tasks > FAN_IN:
            tasks = -(-tasks // FAN_IN)
            partials = partials.repartition(tasks, F.floor(F.col("task") / FAN_IN)).sortWithinPartitions("task").mapInArrow(
                merge, "task long, data binary")
        # One row per group of tasks, FAN_IN at most.
        return sum(np.frombuffer(r["data"]) for r in sorted(partials.collect()))

    def times(self, q: np.ndarray) -> np.ndarray:
        """V @ q."""
        n = self.model.n
        return self.total(lambda x: x.T @ (x @ q)).reshape(q.shape) / n


def stored(embeddings: DataFrame, vector: str, dims: int, scratch: Scratch) -> DataFrame:
    """(rows, data): usable vectors as blocks of whole numbers."""

    def pack(batches):
        for batch in batches:
            _, x = vectors_of(batch.column(0), dims)
            parts = [x[i:i + BLOCK_ROWS] for i in range(0, len(x), BLOCK_ROWS)]
            if parts:
                yield pa.RecordBatch.from_pydict(
                    {"rows": pa.array([len(p) for p in parts], pa.int32()), "data": [p.tobytes() for p in parts]})

    return scratch.written(embeddings.select(vector).mapInArrow(pack, "rows int, data binary"), "whitening-vectors")


def exact_sums(blocks: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each entry, in two halves of 32 bits."""

    def add(batches):
        n, high, low = 0, 0, 0
        for batch in batches:
            for data, rows in zip(batch.column("data").to_pylist(), batch.column("rows").to_pylist()):
                x = np.frombuffer(data, np.int64).reshape(rows, -1)
                n, high, low = n + rows, high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"dim": np.arange(len(low)), "n": np.full(len(low), n), "high": high, "low": low})

    parts = blocks.mapInArrow(add, "dim long, n long, high long, low long").groupBy("dim").agg(
        *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")])
    rows = sorted(parts.collect())  # one row an entry of a vector
    return (int(rows[0]["n"]) if rows else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in rows]


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: falling values, vectors, and residual norms."""
    h = q.T @ vq
    values, turn = np.linalg.eigh((h + h.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    q, vq = q @ turn, vq @ turn
    return values, q, np.linalg.norm(vq - q * values, axis=0)


def _lower_end(passes: _Passes, dims: int, rng: np.random.Generator) -> float:
    """A safe lower end of the spectrum: the least value after a few steps of Lanczos,
    less the norm of the remainder; 0 at least."""
    v = rng.standard_normal(dims)
    basis, diagonal, beside = [v / np.linalg.norm(v)], [], []
    for _ in range(min(LANCZOS, dims)):
        w = passes.times(basis[-1][:, None])[:, 0]
        diagonal.append(float(w @ basis[-1]))
        known = np.array(basis).T
        w = w - known @ (known.T @ w)
        w = w - known @ (known.T @ w)
        beside.append(float(np.linalg.norm(w)))
        if beside[-1] <= 1e-12 * abs(diagonal[0]):
            break
        basis.append(w / beside[-1])
    t = np.diag(diagonal) + np.diag(beside[:len(diagonal) - 1], 1) + np.diag(beside[:len(diagonal) - 1], -1)
    return max(0.0, float(np.linalg.eigvalsh(t)[0]) - beside[-1])


def _filtered(passes: _Passes, q: np.ndarray, values: np.ndarray, wanted: int, low: float) -> np.ndarray:
    """The polynomial of V that is small on [low, the block's least value], by its
    three-term recurrence; of lower degree where the wanted values lie far apart."""
    cut = values[-1]
    half, middle = max((cut - low) / 2, 1e-9 * values[0]), (cut + low) / 2
    far, near = (np.arccosh(max(1.0, (v - middle) / half)) for v in (values[0], values[wanted - 1]))
    degree = next((m for m in range(DEGREE, 1, -1) if m * (far - near) <= np.log(UNEVEN)), 1)
    before, now = q, (passes.times(q) - q * middle) / half
    for _ in range(degree - 1):
        before, now = now, (passes.times(now) - now * middle) * (2 / half) - before
    return now


def fit(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table's vectors; None if it has none."""
    size = F.size(vector)
    common = embeddings.where(size > 0).groupBy(size.alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if common is None:
        return None
    dims, scratch, rng = common["dims"], Scratch(), np.random.default_rng(_SEED)
    blocks = stored(embeddings, vector, dims, scratch)
    model = Whitening(*exact_sums(blocks))
    if not model.n:
        scratch.clear()
        return None
    passes = _Passes(blocks, model)
    model.trace = float(passes.total(lambda x: (x * x).sum(axis=0)).sum()) / model.n
    model.values, model.vectors, model.residuals = _leading(passes, dims, min(components, dims), model.trace, rng)
    if len(model.values):
        k = len(model.values)

        def moments(x):
            w = x @ model.vectors / np.sqrt(model.values)
            return np.vstack([w.T @ w, w.sum(axis=0)])

        found = passes.total(moments).reshape(k + 1, k) / model.n
        model.identity_error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
    model.passes = passes.count
    scratch.clear()
    return model


def _leading(passes: _Passes, dims: int, wanted: int, trace: float, rng: np.random.Generator):
    """The leading eigenvalues above zero, their vectors and residuals, certified."""
    if trace <= 0:
        return np.zeros(0), np.zeros((dims, 0)), np.zeros(0)
    width = min(dims, wanted + GUARD)
    q = np.linalg.qr(rng.standard_normal((dims, width)))[0] if width < dims else np.eye(dims)
    values, q, residuals = _ritz(q, passes.times(q))
    low = _lower_end(passes, dims, rng) if width < dims else 0.0
    last, held = np.inf, None
    for _ in range(MOST_ROUNDS):
        real = values[:wanted] > NOTHING * trace
        allowed = TOLERANCE * values[:wanted] + 1e-15 * np.sqrt(dims) * values[0]
        good = bool(np.all(residuals[:wanted][real] <= allowed[real]))
        if good and (q.shape[1] == dims or held is not None and np.all(np.abs(values[:wanted] - held) <= 2 * allowed)):
            keep = np.flatnonzero(real)
            return values[keep], q[:, keep], residuals[keep]
        worst = float(np.max(residuals[:wanted] / np.maximum(allowed, 1e-300)))
        slow, last, held = not good and worst > SLOW * last, worst, values[:wanted].copy() if good else None
        if good and q.shape[1] > wanted:
            # Nothing missed: fresh columns in place of the last ones must not bring more.
            fresh = max(1, (q.shape[1] - wanted) // 4)
            q = np.linalg.qr(np.hstack([q[:, :-fresh], rng.standard_normal((dims, fresh))]))[0]
        q = _filtered(passes, q, values, wanted, low)
        if slow:
            more = min(q.shape[1], dims - q.shape[1])
            q = np.hstack([q / np.linalg.norm(q, axis=0), rng.standard_normal((dims, more))])
        q = np.linalg.qr(q / np.linalg.norm(q, axis=0))[0]
        values, q, residuals = _ritz(q, passes.times(q))
    raise RuntimeError(f"eigenvectors not certified after {MOST_ROUNDS} rounds and {passes.count} passes")


def apply(embeddings: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """Rows with a usable vector, with whitened (array<double>) and deviation instead of it."""
    kept = [c for c in embeddings.columns if c not in (vector, "whitened", "deviation")]
    schema = embeddings.select(*kept).schema.add("whitened", ArrayType(DoubleType())).add("deviation", "long")
    dims, width = len(model.sums), len(model.values)

    def run(batches):
        for batch in batches:
            keep, x = vectors_of(batch.column(vector), dims)
            rows = batch.filter(pa.array(keep))
            bounds = pa.array(np.arange(len(x) + 1) * width, pa.int32())
            whitened = pa.ListArray.from_arrays(bounds, pa.array(model.whiten(x).ravel()))
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in kept), whitened, pa.array(model.deviation(x), pa.int64())],
                [*kept, "whitened", "deviation"])

    return embeddings.select(*kept, vector).mapInArrow(run, schema)


def whiten(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: the columns of the table without the
    vector, component, n, deviation, whitened, explained, identity_error."""
    names = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    kept = [c for c in embeddings.columns if c not in (vector, *names)]
    model = fit(embeddings, vector, components)
    table = embeddings.select(*kept, vector)
    if model is None:
        model = Whitening(1, [0], np.zeros((1, 0)), np.zeros(0))
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values]).cast("array<double>")
    return apply(table, model, vector).select(
        *kept, "deviation", F.posexplode("whitened").alias("__at", "whitened")).select(
        *kept, (F.col("__at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("__at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
