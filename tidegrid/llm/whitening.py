"""Whitening of embeddings: principal components of all vectors by incremental eigendecomposition.

Entries c become integers floor(1024 c) + 100000.  Every task keeps the spectrum of the scatter of its vectors about
their mean and takes in further ones by centred rank-one updates (secular equation, with deflation); a chunk of CHUNK
vectors enters as the rows of its triangular factor, which have the same scatter, so that an update is due for each
dimension and not for each vector.  Spectra of tasks are combined in a tree, FAN at a time, by the rank-one updates of
one spectrum's scaled vectors and of the shift between the means.  A last scan projects all vectors, centred by the exact
mean, on the combined basis, sums the products (Rayleigh-Ritz) and so brings the components to double precision; another
one measures how far the whitened vectors' covariance is from the identity.

Each task and the driver hold a few matrices of dimension x dimension, however many vectors there are.

Defined results: rows whose vector is null, empty, of another length than most, or that holds null or non-finite entries
or some of 2^41 or more (whose integers a double does not hold), take no part; rows with null or repeated ids are rows
like any others; a component without variance has null whitened values and does not count for identity_error;
deviation is null where it exceeds a long; with fewer dimensions than asked for there are fewer components; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .spectra import Spectrum

SCALE, OFFSET, MOST = 1024, 100_000, 2.0**41
CHUNK = 4096
FAN = 16
_STATE = "part int, whole binary, real binary"
_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vectors: DataFrame, key: str, column: str) -> tuple[DataFrame, int]:
    """Rows (key, vector as array<double>) that take part, and their dimension."""
    v = F.col(column).cast("array<double>")
    fine = F.col(column).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST))
    rows = vectors.where(fine).select(F.col(key), v.alias("vector"))
    common = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = common["width"] if common else 0
    return rows.where(F.size("vector") == width), width


def _integers(batch: pa.RecordBatch, width: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Chunks of a batch with their rows of integers."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    for k in range(0, len(flat), CHUNK):
        yield slice(k, k + CHUNK), np.floor(flat[k : k + CHUNK] * SCALE).astype(np.int64) + OFFSET


def fold(states: DataFrame, merge: Callable[[list[tuple[bytes, bytes]]], tuple[bytes, bytes]]) -> tuple[bytes, bytes] | None:
    """Combines one state a task (part, whole, real) in a tree, FAN at a time and in a fixed order; None without any."""

    def combine(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("part").to_pylist(), table.column("whole").to_pylist(), table.column("real").to_pylist()))
        whole, real = merge([(w, r) for _, w, r in rows])
        return pa.table({"part": pa.array([rows[0][0] // FAN], pa.int32()), "whole": pa.array([whole], pa.binary()), "real": pa.array([real], pa.binary())})

    states = materialize(states)
    while True:
        first = states.limit(2).collect()
        if len(first) < 2:
            return (first[0]["whole"], first[0]["real"]) if first else None
        states = materialize(states.groupBy(F.floor(F.col("part") / FAN).alias("group")).applyInArrow(combine, _STATE))


def _each_task(rows: DataFrame, start: Callable, take: Callable, state: Callable) -> DataFrame:
    """One state of every task that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                held = take(start() if held is None else held, batch)
        if held is not None:
            whole, real = state(held)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([whole], pa.binary()), pa.array([real], pa.binary())], names=["part", "whole", "real"])

    return rows.mapInArrow(run, _STATE)


def spectrum(rows: DataFrame, width: int) -> Spectrum | None:
    """Of all vectors, from the tasks' own."""

    def take(held: Spectrum, batch: pa.RecordBatch) -> Spectrum:
        for _, x in _integers(batch, width):
            held.add_rows(x)
        return held

    def merge(states: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
        held = Spectrum.of(*states[0])
        for other in states[1:]:
            held.add(Spectrum.of(*other))
        return held.state()

    found = fold(_each_task(rows, lambda: Spectrum.empty(width), take, Spectrum.state), merge)
    return Spectrum.of(*found) if found else None


def _projected(rows: DataFrame, width: int, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Covariance of the centred vectors' projections on a basis."""

    def take(held: list, batch: pa.RecordBatch) -> list:
        for _, x in _integers(batch, width):
            y = (x - mean) @ basis
            own, n = y.mean(axis=0), len(y)
            y -= own
            held = _joined(held, [n, own, y.T @ y])
        return held

    def joined(states: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
        every = [_moments(w, r) for w, r in states]
        held = every[0]
        for other in every[1:]:
            held = _joined(held, other)
        return _moment_state(held)

    k = basis.shape[1]
    n, _, products = _moments(*fold(_each_task(rows, lambda: [0, np.zeros(k), np.zeros((k, k))], take, _moment_state), joined))
    return products / n


def _joined(a: list, b: list) -> list:
    """Number, mean and products about the mean of two sets together."""
    n, gap = a[0] + b[0], b[1] - a[1]
    return [n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] / n * b[0])]


def _moment_state(held: list) -> tuple[bytes, bytes]:
    return np.array([held[0]], "<i8").tobytes(), np.concatenate([held[1], held[2].ravel()]).astype("<f8").tobytes()


def _moments(whole: bytes, real: bytes) -> list:
    x = np.frombuffer(real, "<f8")
    k = int((np.sqrt(4 * len(x) + 1) - 1) / 2 + 0.5)
    return [int(np.frombuffer(whole, "<i8")[0]), x[:k], x[k:].reshape(k, k)]


def refined(rows: DataFrame, width: int, found: Spectrum) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues of the covariance and its unit eigenvectors (columns; the largest entry of each is positive)."""
    basis = np.linalg.qr(found.vectors[:, ::-1])[0]
    values, turn = np.linalg.eigh(_projected(rows, width, found.mean, basis))
    vectors = basis @ turn[:, ::-1]
    vectors /= np.sqrt((vectors * vectors).sum(axis=0))
    return values[::-1], vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(width)])


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n x - sum)^2; None beyond a long."""
    gap = x.astype(float) * n - np.array(sums, float)
    rough = (gap * gap).sum(axis=1)
    if rough.max() < 2.0**62 and np.abs(x).max() * float(n) < 2.0**62 and max(map(abs, sums)) < 2**62:
        exact = x * n - np.array(sums, np.int64)
        return (exact * exact).sum(axis=1).tolist()
    found = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in found]


def whiten(vectors: DataFrame, components: int = 8, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Rows (key, component, n, deviation, whitened, explained, identity_error), one for each vector and component."""
    rows, width = usable(vectors, key, column)
    kind = f"`{key}` {vectors.schema[key].dataType.simpleString()}, {_OUT}"
    found = spectrum(rows, width) if width else None
    if found is None:
        return vectors.sparkSession.createDataFrame([], kind)
    values, basis = refined(rows, width, found)
    k, n, mean, sums, trace = min(components, width), found.n, found.mean, found.sums(), values.sum()
    spread = values[:k] > width * np.finfo(float).eps * max(trace, 0)
    scaled = basis[:, :k] / np.sqrt(np.where(spread, values[:k], 1))
    error = np.abs(_projected(rows, width, mean, scaled[:, spread]) - np.eye(int(spread.sum()))).max() if spread.any() else 0.0
    explained = np.maximum(values[:k], 0) / trace if trace > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for own, x in _integers(batch, width):
                m = len(x)
                ids = batch.column(key).slice(own.start, m).take(pa.array(np.repeat(np.arange(m), k)))
                flat, none = ((x - mean) @ scaled).ravel(), np.tile(~spread, m)
                columns = [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array([d for d in _deviations(x, n, sums) for _ in range(k)], pa.int64()),
                    pa.array(flat, mask=none), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, *(c.split()[0] for c in _OUT.split(", "))])

    return rows.mapInArrow(run, kind)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
