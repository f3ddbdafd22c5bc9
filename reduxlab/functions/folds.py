"""Sums of fixed-size numeric state over all rows of a table.

Every iterative fit here is "fold each task's rows to one vector, add the vectors". The number
of tasks follows the input splits; it is cut only where so many vectors would be too much to hand on,
and never by the cores that happen to be there. Small states are added on the driver; large ones
(a covariance of thousands of features) are cut into chunks and added by a two-level group-by,
so that no task and no shuffle key ever holds more than a few hundred chunks.

Fits whose result depends on who sees which rows first deal the rows to a documented number of
workers (`dealt`), so they do not depend on the layout of their input either.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from . import peaks

DRIVER_BYTES = 128 << 20
BROADCAST_BYTES = 512 << 20
# What all tasks of one pass may hand on together, before the number of tasks is cut.
STATE_BYTES = 256 << 30
# A pass is never cut to fewer tasks than these.
MIN_TASKS = 256
MAX_TASKS = 100_000
# Rows and bytes for each worker of a fit by local epochs.
ROWS_PER_WORKER = 50_000
WORKER_BYTES = 64 << 20
_CHUNK = 8192
_CHUNK_SCHEMA = "chunk int, salt int, state array<double>"


def task_limit(df, length=0):
    """Most tasks of a pass: fewer when each of them returns a large state, whatever the cluster."""
    return int(min(MAX_TASKS, max(MIN_TASKS, STATE_BYTES // (8 * max(1, length)))))


def driver_tasks(length):
    """Most tasks whose states the driver adds itself; below MIN_TASKS Spark adds them."""
    return int(min(MAX_TASKS, DRIVER_BYTES // (8 * max(1, length))))


def workers_for(rows, row_bytes, rows_per_worker, worker_bytes=None):
    """Workers of a fit by local epochs: a function of the number of rows and their bytes alone."""
    worker_bytes = WORKER_BYTES if worker_bytes is None else worker_bytes
    return max(1, rows // rows_per_worker, row_bytes // worker_bytes)


def dealt(df, workers, id_col="id"):
    """Rows dealt to one task per worker by hash of their id, and sorted by id there."""
    worker = F.pmod(F.xxhash64(id_col), F.lit(workers)).cast("int")
    return df.repartitionById(workers, worker).sortWithinPartitions(id_col)


def share(df, value, size_bytes, what):
    """Broadcast model state after checking its size."""
    if size_bytes > BROADCAST_BYTES:
        raise ValueError(f"{what} needs {size_bytes >> 20} MiB on every executor, limit {BROADCAST_BYTES >> 20} MiB")
    return df.sparkSession.sparkContext.broadcast(value)


def _chunk_batch(chunks, salts, states):
    return pa.RecordBatch.from_arrays(
        [
            pa.array(chunks, pa.int32()),
            pa.array(salts, pa.int32()),
            pa.array(states, pa.list_(pa.float64())),
        ],
        ["chunk", "salt", "state"],
    )


def _per_task_chunks(df, fold, fan_in, tasks):
    note = peaks.watcher()

    def run(batches):
        state = np.asarray(fold(batches), dtype=np.float64).ravel()
        note()
        salt = TaskContext.get().partitionId() % fan_in
        for number, start in enumerate(range(0, len(state), _CHUNK)):
            yield _chunk_batch([number], [salt], [state[start : start + _CHUNK]])

    return (df.coalesce(tasks) if tasks else df).mapInArrow(run, _CHUNK_SCHEMA)


def _add_chunks(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        column = batch.column("state")
        part = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).sum(axis=0)
        total = part if total is None else total + part
    yield _chunk_batch([key[0].as_py()], [0], [total])


def folded_table(df, fold, length, dealt_tasks=None):
    """Summed state as rows (pos, value), wholly inside Spark: groups of tasks first, then the groups."""
    tasks = dealt_tasks or task_limit(df, length)
    fan_in = max(2, int(tasks**0.5))
    chunks = _per_task_chunks(df, fold, fan_in, None if dealt_tasks else tasks)
    level = chunks.groupBy("chunk", "salt").applyInArrow(_add_chunks, _CHUNK_SCHEMA)
    total = level.groupBy("chunk").applyInArrow(_add_chunks, _CHUNK_SCHEMA)
    return total.select("chunk", F.posexplode("state").alias("offset", "value")).select(
        (F.col("chunk").cast("long") * _CHUNK + F.col("offset")).alias("pos"), "value"
    )


def folded(df, fold, length, dealt_tasks=None):
    """Summed state as a NumPy vector of `length` values on the driver; rows dealt to so many tasks stay there."""
    total = np.zeros(length)
    if driver_tasks(length) >= (dealt_tasks or MIN_TASKS):
        parts = _per_task_chunks(df, fold, 1, None if dealt_tasks else driver_tasks(length)).toArrow()
        for number, state in zip(parts["chunk"].to_pylist(), parts["state"]):
            piece = state.values.to_numpy()
            total[number * _CHUNK : number * _CHUNK + len(piece)] += piece
        return total
    table = folded_table(df, fold, length, dealt_tasks).toArrow()
    total[table["pos"].to_numpy()] = table["value"].to_numpy()
    return total
