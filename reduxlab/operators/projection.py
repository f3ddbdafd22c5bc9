"""One operator behind every reducer: x -> (x - mean) @ W on Arrow batches, with W dense or compressed."""

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions import folds, peaks
from ..functions.matrices import DenseRows, SparseRows, as_list_column, dense


def project(df, weights, mean=None, sparse=False):
    """Replace the features by their projection; the result is always dense.

    Centring is folded into a constant row, so sparse rows are never filled in.
    """
    weights = np.ascontiguousarray(weights, dtype=np.float64)
    offset = np.zeros(weights.shape[1]) if mean is None else np.asarray(mean, dtype=np.float64) @ weights
    shared = folds.share(df, (weights, offset), weights.nbytes, "projection matrix")

    note = peaks.watcher()

    def apply(rows):
        matrix, constant = shared.value
        out = as_list_column(rows.dot(matrix) - constant)
        note()
        return out

    if sparse:

        @F.arrow_udf("array<double>")
        def reduce_sparse(idx: pa.Array, val: pa.Array) -> pa.Array:
            return apply(SparseRows.from_columns(idx, val))

        return df.withColumn("features", reduce_sparse("idx", "val")).drop("idx", "val")

    @F.arrow_udf("array<double>")
    def reduce_dense(features: pa.Array) -> pa.Array:
        if not len(features):
            return pa.array([], pa.list_(pa.float64()))
        return apply(DenseRows(dense(features)))

    return df.withColumn("features", reduce_dense("features"))


# Four 32-bit draws come from one digest; the text form makes the same numbers in any engine.
_DRAWS = 4
# Numbers that one generating task, or one step of it, makes at a time; a smaller matrix is made on the spot.
_MADE_AT_ONCE = 1 << 18


def seeded_uniforms(kind, seed, first, rows, cols):
    """(rows, cols) numbers in (0, 1) from md5('kind:seed:row:block'), from row `first` on."""
    blocks = -(-cols // _DRAWS)
    raw = b"".join(
        hashlib.md5(f"{kind}:{seed}:{i}:{b}".encode()).digest() for i in range(first, first + rows) for b in range(blocks)
    )
    draws = np.frombuffer(raw, dtype=">u4").reshape(rows, blocks * _DRAWS)
    return (draws.astype(np.float64) + 0.5) / 2.0**32


def generated(spark, input_dim, n_components, part_of, arrow_schema):
    """A matrix made feature by feature: part_of(first, rows) gives a record batch of some features.

    Large ones are made by Spark tasks; what comes back is what the parts hold, features in order.
    """
    step = max(1, _MADE_AT_ONCE // n_components)

    def parts(batches):
        for batch in batches:
            for first in batch.column("id").to_pylist():
                yield part_of(first, min(step, input_dim - first))

    if input_dim <= step:
        return pa.Table.from_batches([part_of(0, input_dim)], arrow_schema)
    tasks = min(folds.MIN_TASKS, -(-input_dim // step))
    firsts = spark.range(0, input_dim, step, numPartitions=tasks)
    return firsts.mapInArrow(parts, from_arrow_schema(arrow_schema)).toArrow().sort_by("first")


def gaussian_weights(spark, input_dim, n_components, seed):
    """N(0, 1/k) entries by Box-Muller on neighbouring draws."""
    schema = pa.schema([("first", pa.int64()), ("values", pa.list_(pa.float64()))])

    def part_of(first, rows):
        u = seeded_uniforms("grp", seed, first, rows, n_components)
        radius = np.sqrt(-2.0 * np.log(u[:, 0::2]))
        angle = 2.0 * math.pi * u[:, 1::2]
        out = np.empty_like(u)
        out[:, 0::2] = radius * np.cos(angle)
        out[:, 1::2] = radius * np.sin(angle)
        values = out[:, :n_components] / math.sqrt(n_components)
        return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([values.ravel()], schema.field(1).type)], schema=schema)

    made = generated(spark, input_dim, n_components, part_of, schema)
    return made["values"].combine_chunks().flatten().to_numpy().reshape(input_dim, n_components)


@dataclass(frozen=True)
class SparseMap:
    """x -> x W for a matrix of few non-zeros, all of one size: signs by feature, compressed, and never filled in."""

    starts: np.ndarray
    outputs: np.ndarray
    signs: np.ndarray
    size: float
    n_components: int

    def by_output(self):
        """The same non-zeros by output: features, signs, where each output begins, and which outputs have any."""
        feature = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        order = np.argsort(self.outputs, kind="stable")
        counts = np.bincount(self.outputs, minlength=self.n_components)
        filled = np.flatnonzero(counts)
        return feature[order], self.signs[order], (np.cumsum(counts) - counts)[filled], filled

    def dense_rows(self, matrix, turned):
        """Sums of few columns for every output, some rows at a time."""
        feature, signs, begins, filled = turned
        out = np.zeros((len(matrix), self.n_components))
        step = max(1, 4_000_000 // max(1, len(feature)))
        for at in range(0, len(matrix) if len(feature) else 0, step):
            terms = matrix[at : at + step][:, feature] * signs
            out[at : at + step, filled] = np.add.reduceat(terms, begins, axis=1)
        return out * self.size

    def sparse_rows(self, rows):
        """Every stored value meets the non-zeros of its feature."""
        out = np.zeros((len(rows), self.n_components))
        row_of = np.repeat(np.arange(len(rows)), np.diff(rows.pointers))
        for at in range(0, len(rows.idx), 1 << 18):
            idx, val, row = rows.idx[at : at + (1 << 18)], rows.val[at : at + (1 << 18)], row_of[at : at + (1 << 18)]
            count = self.starts[idx + 1] - self.starts[idx]
            ends = np.cumsum(count)
            where = np.repeat(self.starts[idx] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)
            np.add.at(out, (np.repeat(row, count), self.outputs[where]), np.repeat(val, count) * self.signs[where])
        return out * self.size

    def first(self, k):
        """The map with fewer outputs: the draws are the same, only their size differs."""
        feature = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        kept = self.outputs < k
        starts = np.concatenate([[0], np.cumsum(np.bincount(feature[kept], minlength=len(self.starts) - 1))]).astype(np.int64)
        return SparseMap(starts, self.outputs[kept], self.signs[kept], self.size * math.sqrt(self.n_components / k), k)

    def nbytes(self):
        return self.starts.nbytes + self.outputs.nbytes + self.signs.nbytes

    def transform(self, df, sparse=False):
        shared = folds.share(df, self, self.nbytes(), "projection matrix")
        note = peaks.watcher()
        if sparse:

            @F.arrow_udf("array<double>")
            def reduce_sparse(idx: pa.Array, val: pa.Array) -> pa.Array:
                out = as_list_column(shared.value.sparse_rows(SparseRows.from_columns(idx, val)))
                note()
                return out

            return df.withColumn("features", reduce_sparse("idx", "val")).drop("idx", "val")

        @F.arrow_udf("array<double>")
        def reduce_dense(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            turned = shared.value.by_output()
            for features in columns:
                rows = dense(features) if len(features) else np.empty((0, 0))
                out = as_list_column(shared.value.dense_rows(rows, turned))
                note()
                yield out

        return df.withColumn("features", reduce_dense("features"))


def sparse_map(spark, input_dim, n_components, seed):
    """+-sqrt(1/(s k)) with probability s/2 each, s = 1/sqrt(d), otherwise 0: only the non-zeros leave the tasks."""
    density = 1.0 / math.sqrt(input_dim)
    numbers = pa.list_(pa.int32())
    schema = pa.schema([("first", pa.int64()), ("counts", numbers), ("outputs", numbers), ("signs", numbers)])

    def part_of(first, rows):
        u = seeded_uniforms("srp", seed, first, rows, n_components)[:, :n_components]
        row, output = np.nonzero(u < density)
        found = np.bincount(row, minlength=rows), output, np.where(u[row, output] < density / 2, 1, -1)
        return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), *(pa.array([part], numbers) for part in found)], schema=schema)

    made = generated(spark, input_dim, n_components, part_of, schema)
    counts, outputs, signs = (made[c].combine_chunks().flatten().to_numpy() for c in ("counts", "outputs", "signs"))
    starts = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    return SparseMap(starts, outputs, signs.astype(np.int8), math.sqrt(1.0 / (density * n_components)), n_components)


def cosine_matrix(n, freqs):
    """Orthonormal DCT-II basis, one column per frequency."""
    freqs = np.asarray(freqs)
    where = (2 * np.arange(n)[:, None] + 1) * freqs[None, :]
    scale = np.where(freqs == 0, math.sqrt(1.0 / n), math.sqrt(2.0 / n))
    return np.cos(math.pi * where / (2 * n)) * scale


def low_frequency_order(height, width, channels, wanted):
    """The first coefficients by (row + column, row), channels innermost."""
    grid = sorted((i + j, i, j) for i in range(height) for j in range(width))
    return [(i, j, c) for _, i, j in grid for c in range(channels)][:wanted]


def image_cosine_matrix(height, width, channels, selected):
    """Products of row and column cosines for images with the channel innermost."""
    rows, cols, chans = (np.array(v) for v in zip(*selected))
    basis = np.einsum("hk,wk->hwk", cosine_matrix(height, rows), cosine_matrix(width, cols))
    placed = np.zeros((height, width, channels, len(selected)))
    for k, c in enumerate(chans):
        placed[:, :, c, k] = basis[:, :, k]
    return placed.reshape(height * width * channels, len(selected))


@dataclass(frozen=True)
class LinearMap:
    weights: np.ndarray
    mean: np.ndarray | None = None

    def first(self, k, scale=1.0):
        return LinearMap(self.weights[:, :k] * scale, self.mean)

    def transform(self, df, sparse=False):
        return project(df, self.weights, self.mean, sparse)
