"""An exact neighbour join for two large tables, pruned by pivots.

Base rows belong to the cell of a near pivot. A query's k-th distance is bounded from
above by the rows known to lie near the pivots, and a cell is skipped when its distance bound
from below exceeds that. Pivots form groups around some of them: a row meets the heads of all groups
and the members of its own group and of those that its bound does not rule out. Cells that lie
together travel as one parcel, and parcels are cut by counted sizes on both sides: a query is sent once
to every parcel with a cell it needs, however many those are, and a cell holding a third of all rows,
or copies of one row, is spread like any other.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions import distances, folds
from ..functions.matrices import dense
from . import blocks
from .sampling import subsample

MAX_PIVOTS = 65_536
PIVOT_BYTES = 64 << 20
_CELLS = pa.schema([("cell", pa.int32()), ("n", pa.int64()), ("radius", pa.float64()), ("near", pa.list_(pa.float64()))])


def _gaps(metric, x, pivots):
    """Distances to all pivots, and what rounding may add to them."""
    near, noise = distances.approximate(metric, x, pivots)
    return near, noise[:, None]


def _nearest(gaps, noise):
    """The first pivot as near as any, so that equal pivots give the same answer in every batch."""
    return (gaps <= gaps.min(axis=1, keepdims=True) + 2.0 * noise).argmax(axis=1)


class PivotTree:
    """Pivots in groups of about the square root of their number, each around one of them."""

    def __init__(self, metric, pivots):
        self.metric, self.pivots = metric, pivots
        heads = np.arange(0, len(pivots), max(1, int(np.ceil(len(pivots) ** 0.5))))
        self.heads = pivots[heads]
        near, noise = _gaps(metric, pivots, self.heads)
        group = near.argmin(axis=1)
        self.gap = near[np.arange(len(pivots)), group] + noise[:, 0]
        self.members = [np.flatnonzero(group == j) for j in range(len(heads))]
        # Equal pivots may leave the group of one of them empty.
        filled = [j for j, cells in enumerate(self.members) if len(cells)]
        self.heads, self.members = self.heads[filled], [self.members[j] for j in filled]

    def nbytes(self):
        return self.pivots.nbytes + self.heads.nbytes + self.gap.nbytes

    def near_group(self, x):
        """(rows, cells, gaps, noise) for every group that is the nearest one of some rows."""
        group = _nearest(*_gaps(self.metric, x, self.heads))
        for j in np.unique(group).tolist():
            rows, cells = np.flatnonzero(group == j), self.members[j]
            yield rows, cells, *_gaps(self.metric, x[rows], self.pivots[cells])

    def home(self, x):
        """A near cell of every row, and an upper bound of the distance to its pivot."""
        cell, gap = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        for rows, cells, gaps, noise in self.near_group(x):
            best = _nearest(gaps, noise)
            cell[rows], gap[rows] = cells[best], gaps[np.arange(len(rows)), best] + noise[:, 0]
        return cell, gap

    def visits(self, x, radius, near, k):
        """(query row, cell) pairs that cannot be ruled out; radius is below 0 for cells without rows."""
        bound = np.full(len(x), np.inf)
        for rows, cells, gaps, noise in self.near_group(x):
            reach = (gaps[:, :, None] + noise[:, :, None] + near[cells][None]).reshape(len(rows), -1)
            if reach.shape[1] >= k:
                bound[rows] = np.partition(reach, k - 1, axis=1)[:, k - 1]
        heads, noise = _gaps(self.metric, x, self.heads)
        found = []
        for j, cells in enumerate(self.members):
            cells = cells[radius[cells] >= 0]
            if not len(cells):
                continue
            extent = (self.gap[cells] + radius[cells]).max()
            rows = np.flatnonzero(heads[:, j] - extent <= bound + 4 * noise[:, 0])
            if len(rows):
                gaps, more = _gaps(self.metric, x[rows], self.pivots[cells])
                row, cell = np.nonzero(gaps - radius[cells][None, :] <= bound[rows][:, None] + 4 * more)
                found.append((rows[row], cells[cell]))
        row, cell = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.int64) for i in range(2))
        return row, cell

    def in_order(self):
        """All cells, those of a group one after the other."""
        return np.concatenate(self.members)


def _cell_table(base, shared, k):
    """Per pivot: rows in its cell, largest distance, and the k smallest distances."""

    def measure(batches):
        tree = shared.value
        pivots = tree.pivots
        count, radius = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots))
        near = np.full((len(pivots), k), np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, gap = tree.home(dense(batch.column("features")))
            count += np.bincount(cell, minlength=len(pivots))
            np.maximum.at(radius, cell, gap)
            order = np.lexsort((gap, cell))
            ranked = cell[order]
            place = np.arange(len(ranked)) - np.searchsorted(ranked, ranked)
            kept = order[place < k]
            both = np.full((len(pivots), 2 * k), np.inf)
            both[:, :k] = near
            both[cell[kept], k + place[place < k]] = gap[kept]
            near = np.sort(both, axis=1)[:, :k]
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used, pa.int32()),
                pa.array(count[used], pa.int64()),
                pa.array(radius[used], pa.float64()),
                pa.array([v[np.isfinite(v)] for v in near[used]], pa.list_(pa.float64())),
            ],
            schema=_CELLS,
        )

    return (
        base.select("features")
        .coalesce(folds.task_limit(base))
        .mapInArrow(measure, from_arrow_schema(_CELLS))
        .groupBy("cell")
        .agg(
            F.sum("n").alias("n"),
            F.max("radius").alias("radius"),
            # k values from every task.
            F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"),
        )
        .collect()
    )


def _spread(ids):
    """Mix ids so that blocks are even."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (z ^ (z >> np.uint64(29))) >> np.uint64(3)


def _lists(rows, owner, values):
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(values, pa.int64()))


def _expanded(owner, first, count):
    """For every owner the numbers first, first + 1, ... (count of them)."""
    repeated = np.repeat(np.arange(len(owner)), count)
    step = np.arange(len(repeated)) - np.repeat(np.cumsum(count) - count, count)
    return owner[repeated], first[repeated] + step


def _cut(order, rows_in, most):
    """(first parcel, number of parcels) of every cell: at most `most` rows in each, cells in `order`."""
    first, cuts = np.zeros(len(rows_in), dtype=np.int64), np.ones(len(rows_in), dtype=np.int64)
    number, room = 0, most
    for cell in order.tolist():
        if rows_in[cell] > room:
            # What does not fit begins a new parcel, and what is larger than one gets its own.
            number, room = number + (room < most), most
        first[cell], cuts[cell] = number, max(1, -(-rows_in[cell] // most))
        if cuts[cell] > 1:
            number, room = number + cuts[cell], most
        else:
            room -= rows_in[cell]
    return first, cuts, number + 1


def _needed(tree, bounds, k, cut, x):
    """(row, parcel) for all parcels with a cell that a row may need, by row."""
    first, cuts, parcels = cut
    for at in distances.row_slices(len(x), len(first)):
        row, cell = tree.visits(x[at], *bounds, k)
        row, parcel = _expanded(row, first[cell], cuts[cell])
        needed = np.zeros((at.stop - at.start, parcels), dtype=bool)
        needed[row, parcel] = True
        row, parcel = np.nonzero(needed)
        yield at.start + row, parcel


def _counts(queries, needed_by, parcels):
    """How many queries need each parcel."""

    def count(batches):
        total = np.zeros(parcels, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                for _, parcel in needed_by(dense(batch.column("features"))):
                    total += np.bincount(parcel, minlength=parcels)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["parcel", "n"])

    total = np.zeros(parcels, dtype=np.int64)
    rows = queries.select("features").mapInArrow(count, "parcel long, n long").groupBy("parcel").agg(F.sum("n").alias("n"))
    for row in rows.collect():
        total[row["parcel"]] = row["n"]
    return total


def meet(queries, base, k, metric, base_rows, block_rows, base_most, query_most, work, arrow_schema, seed=42):
    """Run work(base rows by cell, their cells, table of queries, visits) on every parcel that matters.

    There is a pivot for every `block_rows` of the base; a parcel holds up to `base_most` base rows and is
    copied for every `query_most` queries that need it.
    """
    sc = base.sparkSession.sparkContext
    first = base.select("features").head()
    most = max(2, PIVOT_BYTES // (8 * max(1, len(first["features"])))) if first else 2
    wanted = int(min(MAX_PIVOTS, most, max(2, base_rows // max(1, block_rows) + 1)))
    pivots = dense(subsample(base.select("id", "features"), wanted, seed).toArrow()["features"].combine_chunks())
    tree = PivotTree(metric, pivots)
    shared_tree = folds.share(base, tree, tree.nbytes(), "pivots")
    radius, near = np.full(len(pivots), -1.0), np.full((len(pivots), k), np.inf)
    rows_in = np.zeros(len(pivots), dtype=np.int64)
    for row in _cell_table(base, shared_tree, k):
        rows_in[row["cell"]], radius[row["cell"]] = row["n"], row["radius"]
        near[row["cell"], : len(row["near"])] = row["near"]
    order = tree.in_order()
    place = np.empty(len(pivots), dtype=np.int64)
    place[order] = np.arange(len(order))
    cut = _cut(order, rows_in, base_most)
    shared_bounds = sc.broadcast((radius, near, cut, place))

    def needed_by(x):
        radius, near, cut, _ = shared_bounds.value
        return _needed(shared_tree.value, (radius, near), k, cut, x)

    copies = np.maximum(1, -(-_counts(queries, needed_by, cut[2]) // query_most))
    start = np.concatenate([[0], np.cumsum(copies)])[:-1]
    shared_copies = sc.broadcast((copies, start, blocks.even_keys(base.sparkSession, int(copies.sum()))))

    @F.arrow_udf("array<bigint>")
    def query_parcels(ids: pa.Array, features: pa.Array) -> pa.Array:
        if not len(features):
            return pa.array([], pa.list_(pa.int64()))
        copies, start, key = shared_copies.value
        row, parcel = (np.concatenate(v) for v in zip(*needed_by(dense(features))))
        mine = _spread(ids.to_numpy())[row] % copies[parcel].astype(np.uint64)
        return _lists(len(features), row, key[start[parcel] + mine.astype(np.int64)])

    @F.arrow_udf("struct<cell: int, parcels: array<bigint>>")
    def base_parcels(ids: pa.Array, features: pa.Array) -> pa.Array:
        cell = np.zeros(0, dtype=np.int64)
        parcels = pa.array([], pa.list_(pa.int64()))
        if len(features):
            (first, cuts, _), (copies, start, key) = shared_bounds.value[2], shared_copies.value
            cell, _ = shared_tree.value.home(dense(features))
            parcel = first[cell] + (_spread(ids.to_numpy()) % cuts[cell].astype(np.uint64)).astype(np.int64)
            row, group = _expanded(np.arange(len(cell)), start[parcel], copies[parcel])
            parcels = _lists(len(cell), row, key[group])
        return pa.StructArray.from_arrays([pa.array(cell, pa.int32()), parcels], ["cell", "parcels"])

    left = base.withColumn("_at", base_parcels("id", "features"))
    left = left.select(*base.columns, F.col("_at.cell").alias("cell"), F.explode("_at.parcels").alias("parcel"))
    right = queries.withColumn("parcel", F.explode(query_parcels("id", "features")))
    # Other column names keep a table apart from itself when both sides are the same.
    held = [f"held_{c}" for c in queries.columns]
    right = right.toDF(*held, "parcel")
    base_names, query_names = base.columns, queries.columns

    def compare(base_table: pa.Table, query_table: pa.Table) -> pa.Table:
        if not base_table.num_rows or not query_table.num_rows:
            return arrow_schema.empty_table()
        radius, near, _, place = shared_bounds.value
        cell = base_table["cell"].to_numpy()
        by_place = np.argsort(place[cell], kind="stable")
        cells_here, local = np.unique(cell, return_inverse=True)
        here = np.full(len(radius), -1.0)
        here[cells_here] = radius[cells_here]

        def visits(x):
            row, cell = shared_tree.value.visits(x, here, near, k)
            return row, np.searchsorted(cells_here, cell)

        rows = base_table.select(base_names).take(pa.array(by_place))
        asked = query_table.select(held).rename_columns(query_names)
        return pa.Table.from_batches(list(work(rows, local[by_place], asked, visits)), arrow_schema)

    return left.groupBy("parcel").cogroup(right.groupBy("parcel")).applyInArrow(compare, from_arrow_schema(arrow_schema))
