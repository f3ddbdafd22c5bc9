"""Every row of one table against every row of another, without forming the pairs as rows.

The work function sees blocks as matrices and emits only its summary. While the second table
is small (its bytes are counted first) it is broadcast and the first is streamed where it
lies, with no shuffle. Beyond that both are hashed by id into blocks of bounded size and each
pair of blocks is one group, so no group grows with the data or with any value in it. A block
moves once for each block of the other side, so blocks are not cut finer than `parcels` says.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions import folds

SMALL_SIDE_BYTES = 64 << 20
BLOCK_BYTES = 32 << 20
# What a row takes besides its values: id, label, offsets, names of its columns.
ROW_BYTES = 64
# Cuts of a side that small blocks may ask for; beyond BLOCK_BYTES a block is cut in any case.
PARCELS = 4


def parcels(side_bytes, block_bytes):
    """Parts of a side that move as a whole: of `block_bytes`, or as many small blocks as make a quarter of the side.

    All of one side moves once for every part of the other, so parts stay few as long as they stay small.
    """
    return max(1, math.ceil(side_bytes / max(block_bytes, min(BLOCK_BYTES, side_bytes / PARCELS))))


def stored_bytes(df, columns):
    values = sum((F.coalesce(F.array_size(c), F.lit(0)) for c in columns), F.lit(0)).cast("long")
    total = F.sum(values * 8 + ROW_BYTES)
    row = df.agg(F.count("*").alias("n"), total.alias("bytes")).head()
    return row["n"], row["bytes"] or 0


def _blocks(df, count, other, mine, theirs):
    others = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
    return df.withColumn(mine, F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")).withColumn(theirs, others)


def even_keys(spark, groups):
    """Numbers for groups that Spark's hash deals evenly to the shuffle partitions, so that few heavy groups do not share a task."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if groups > 32 * tasks:
        return np.arange(groups)
    tried = spark.range(16 * tasks * (groups // tasks + 4)).select(F.pmod(F.hash("id"), F.lit(tasks)).alias("task"))
    task = tried.toArrow()["task"].to_numpy()
    key = np.argsort(task, kind="stable")
    place = np.arange(len(key)) - np.searchsorted(task[key], task[key])
    return key[np.argsort(place, kind="stable")][:groups]


def against(streamed, held, vectors, work, arrow_schema, small_bytes=SMALL_SIDE_BYTES, block_bytes=BLOCK_BYTES):
    """Run work(batches of `streamed`, table of `held`) so that all pairs of rows meet once.

    Both need an `id` column; `vectors` are their array columns. `work` yields record batches.
    """
    schema = from_arrow_schema(arrow_schema)
    _, held_bytes = stored_bytes(held, vectors)
    if held_bytes <= small_bytes:
        shared = folds.share(held, held.toArrow(), held_bytes, "the smaller side")

        def stream(batches):
            yield from work(batches, shared.value)

        return streamed.coalesce(folds.task_limit(streamed)).mapInArrow(stream, schema)

    _, streamed_bytes = stored_bytes(streamed, vectors)
    left_blocks = parcels(streamed_bytes, block_bytes)
    right_blocks = parcels(held_bytes, block_bytes)
    left_names, right_names = streamed.columns, held.columns
    left = _blocks(streamed, left_blocks, right_blocks, "lb", "rb")
    # Other column names keep a table apart from itself when both sides are the same.
    held_names = [f"held_{c}" for c in right_names]
    right = _blocks(held, right_blocks, left_blocks, "rb", "lb").toDF(*held_names, "rb", "lb")

    def meet(left_table: pa.Table, right_table: pa.Table) -> pa.Table:
        if not left_table.num_rows or not right_table.num_rows:
            return arrow_schema.empty_table()
        against_rows = right_table.select(held_names).rename_columns(right_names)
        made = work(iter(left_table.select(left_names).to_batches()), against_rows)
        return pa.Table.from_batches(list(made), arrow_schema)

    return left.groupBy("lb", "rb").cogroup(right.groupBy("lb", "rb")).applyInArrow(meet, schema)
