"""Counts, means and squared deviations as one mergeable state per task.

Means and deviations are taken inside a batch, and states are merged by the pairwise update of (mass, mean, M2), so
nothing is lost when the values lie far from zero. A table is one fold: no value becomes a row.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from . import folds, peaks
from .matrices import SparseRows, dense

_CHUNK = 4096
_SCHEMA = "chunk int, salt int, state array<double>"


def merge(one, other):
    """Two states (mass, mean, M2), each by position, as one."""
    mass = one[0] + other[0]
    share = np.divide(other[0], mass, out=np.zeros_like(mass), where=mass > 0)
    gap = other[1] - one[1]
    return np.stack([mass, one[1] + gap * share, one[2] + other[2] + gap * gap * one[0] * share])


def largest(one, other):
    return np.maximum(one, other)


def _grown(state, width):
    return state if state.shape[1] >= width else np.hstack([state, np.zeros((len(state), width - state.shape[1]))])


def joined(states, combine):
    """States of any widths as one; missing positions are zeros."""
    total = None
    for state in states:
        if total is not None:
            width = max(total.shape[1], state.shape[1])
            state = combine(_grown(total, width), _grown(state, width))
        total = state
    return total


def _chunk_batch(number, salt, state):
    columns = [pa.array([number], pa.int32()), pa.array([salt], pa.int32()), pa.array([state.ravel()], pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, ["chunk", "salt", "state"])


def merged(df, state_of, combine, layers, length):
    """One state (layers, positions) of a whole table: states of batches, then of tasks, then of the table.

    state_of gives the state of a batch with rows. length: numbers of one state, about; few and small states are
    merged on the driver, others by Spark, in chunks of positions and in two steps.
    """
    tasks = min(folds.task_limit(df, length), folds.driver_tasks(length))
    inside = tasks < folds.MIN_TASKS
    tasks = folds.task_limit(df, length) if inside else tasks
    fan_in = max(2, int(tasks**0.5)) if inside else 1

    note = peaks.watcher()

    def run(batches):
        state = joined((state_of(batch) for batch in batches if batch.num_rows), combine)
        note()
        salt = TaskContext.get().partitionId() % fan_in
        for number, start in enumerate(range(0, state.shape[1], _CHUNK) if state is not None else ()):
            yield _chunk_batch(number, salt, state[:, start : start + _CHUNK])

    def states(batches):
        for batch in batches:
            for value in batch.column("state"):
                yield value.values.to_numpy().reshape(layers, -1)

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _chunk_batch(key[0].as_py(), 0, joined(states(batches), combine))

    chunks = df.coalesce(tasks).mapInArrow(run, _SCHEMA)
    if inside:
        chunks = chunks.groupBy("chunk", "salt").applyInArrow(add, _SCHEMA).groupBy("chunk").applyInArrow(add, _SCHEMA)
    found = {}
    for batch in chunks.toArrow().to_batches():
        for number, value in zip(batch.column("chunk").to_pylist(), batch.column("state")):
            state = value.values.to_numpy().reshape(layers, -1)
            found[number] = joined([found[number], state], combine) if number in found else state
    # Only the last chunk of the widest states is short; those of narrower ones are filled up.
    parts = [_grown(found[number], _CHUNK) if number < max(found) else found[number] for number in sorted(found)]
    return np.hstack(parts) if parts else np.zeros((layers, 0))


def of_rows(x):
    """The state of a matrix, by column."""
    mean = x.mean(axis=0)
    gap = x - mean
    return np.stack([np.full(x.shape[1], float(len(x))), mean, (gap * gap).sum(axis=0)])


def of_groups(codes, values, width):
    """The state of single values, by their group; groups without values are zeros."""
    mass = np.bincount(codes, minlength=width).astype(float)
    mean = np.bincount(codes, values, minlength=width) / np.maximum(mass, 1.0)
    gap = values - mean[codes]
    return np.stack([mass, mean, np.bincount(codes, gap * gap, minlength=width)])


def of_shares(x, shares):
    """The state of rows that belong to groups in parts: (3, groups * features)."""
    middle = x.mean(axis=0)
    gap = x - middle
    mass = shares.sum(axis=0)[:, None]
    first = shares.T @ gap
    mean = np.divide(first, mass, out=np.zeros_like(first), where=mass > 0)
    m2 = np.maximum(shares.T @ (gap * gap) - mean * first, 0.0)
    return np.stack([np.broadcast_to(mass, mean.shape).ravel(), (mean + middle).ravel(), m2.ravel()])


def table_moments(df, period=None):
    """(mass, mean, M2) of every feature of a dense table, or of every feature number modulo `period`."""
    rows = df.select("features").filter("features is not null")
    first = rows.head()
    if first is None:
        return np.zeros((3, 0))

    def state_of(batch):
        state = of_rows(dense(batch.column("features")))
        if period is None:
            return state
        # Columns that share a statistic are states of the same feature.
        pad = -state.shape[1] % period
        parts = np.hstack([state, np.zeros((3, pad))]).reshape(3, -1, period)
        return joined((parts[:, i] for i in range(parts.shape[1])), merge)

    return merged(rows, state_of, merge, 3, 3 * (period or len(first["features"])))


def _stored(batch):
    rows = SparseRows.from_columns(batch.column("idx"), batch.column("val"))
    return rows.idx, rows.val, int(rows.idx.max()) + 1 if len(rows.idx) else 0


def stored_moments(df, width):
    """(mass, mean, M2) of the stored values of every feature of a sparse table."""
    return merged(df.select("idx", "val"), lambda batch: of_groups(*_stored(batch)), merge, 3, 3 * width)


def stored_peaks(df, width):
    """The largest absolute stored value of every feature of a sparse table, and how many are stored."""

    def state_of(batch):
        idx, val, size = _stored(batch)
        peak = np.zeros((1, size))
        np.maximum.at(peak[0], idx, np.abs(val))
        return peak

    return merged(df.select("idx", "val"), state_of, largest, 1, width)[0]
