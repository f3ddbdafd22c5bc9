"""Exact nearest neighbours: a join that keeps k rows per query, the vote, and the graph.

Three ways, chosen by counted sizes, give the same rows:

* a small base is broadcast and every query is finished where it lies, without a shuffle;
* few queries are broadcast, the base is streamed, and each task's k candidates are merged;
* otherwise both sides meet in cells around pivots, and cells that the triangle inequality
  rules out for a query are never sent to it (`cells.py`).
"""

import math
from typing import Iterator, Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions import distances, peaks
from ..functions.columns import largest_by_count
from ..functions.matrices import feature_columns, first_copies, read_rows
from . import blocks, cells

_FOUND = pa.schema(
    [
        ("id", pa.int64()),
        ("neighbour", pa.int64()),
        ("label", pa.int32()),
        ("dist", pa.float64()),
        ("rank", pa.int32()),
    ]
)


# Rows compared at a time: the stand-ins of one pair of slices stay in the processor's cache.
_QUERY_ROWS, _BASE_ROWS = 1024, 2048


class _Best:
    """The k nearest base rows seen so far for a slice of distinct queries, by (distance, id)."""

    def __init__(self, rows, width, k, metric):
        self.rows, self.width, self.k, self.metric = rows, width, k, metric
        self.query = np.empty(0, dtype=np.int64)
        self.dist = np.empty(0)
        self.found = np.empty(0, dtype=np.int64)
        self.label = np.empty(0, dtype=np.int32)
        self.bound = np.full(len(rows), np.inf)
        # Candidates that are not ranked yet.
        self.new, self.waiting = [], 0

    def see(self, base, asking=None):
        """Compare the queries, or those numbered in `asking`, with a slice of the base."""
        ids, labels, vectors, right = base
        asking = np.arange(len(self.bound)) if asking is None else asking
        mine = self.rows.take(asking).to_matrix(self.width)
        left = distances.left_form(self.metric, mine)
        near, noise = distances.compared(self.metric, left, right)
        slack = 2.0 * noise
        limit = distances.as_stand_in(self.metric, self.bound[asking]) + slack
        close = near <= limit.astype(near.dtype)[:, None]
        if len(ids) > self.k and np.count_nonzero(close) > 4 * self.k * len(near):
            kth = np.partition(near, self.k - 1, axis=1)[:, self.k - 1]
            close = near <= np.minimum(limit, kth + slack).astype(near.dtype)[:, None]
        q, b = np.divmod(np.flatnonzero(close), len(ids))
        if not len(q):
            return
        dist = distances.aligned_pairs(self.metric, mine, vectors, q, b)
        self.new.append((asking[q], dist, ids[b], labels[b]))
        self.waiting += len(q)
        # Few candidates hardly lower the bounds, so they wait for more.
        if self.waiting > self.k * len(self.bound) // 4:
            self.settle()

    def settle(self):
        """Rank what was found; bounds are the k-th distances."""
        if not self.waiting:
            return
        held = zip((self.query, self.dist, self.found, self.label), *self.new)
        query, dist, found, label = (np.concatenate(parts) for parts in held)
        self.new, self.waiting = [], 0
        order = np.lexsort((found, dist, query))
        ranked = query[order]
        place = np.arange(len(ranked)) - np.searchsorted(ranked, ranked)
        keep = order[place < self.k]
        self.query, self.dist, self.found, self.label = query[keep], dist[keep], found[keep], label[keep]
        full = np.flatnonzero(np.bincount(self.query, minlength=len(self.bound)) == self.k)
        self.bound[full] = self.dist[np.searchsorted(self.query, full, side="right") - 1]


class _Found:
    """Neighbours of all queries of a block, copies of a query included."""

    def __init__(self, ids, parts, place, k, skip_self):
        """`place` gives for every query its number among the distinct ones."""
        for part in parts:
            part.settle()
        sizes = [len(part.bound) for part in parts]
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        query = np.concatenate([part.query + start for part, start in zip(parts, starts)])
        counts = np.bincount(query, minlength=sum(sizes))
        first = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(ids)), counts[place])
        at = np.arange(len(owner)) - np.repeat(np.cumsum(counts[place]) - counts[place], counts[place])
        at += first[place][owner]
        found = np.concatenate([part.found for part in parts])[at]
        kept = np.flatnonzero(found != ids[owner]) if skip_self else np.arange(len(owner))
        owner, at, found = owner[kept], at[kept], found[kept]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner) + 1
        kept = np.flatnonzero(rank <= k)
        self.owner, self.rank, self.found = owner[kept], rank[kept], found[kept]
        self.ids, at = ids, at[kept]
        self.label = np.concatenate([part.label for part in parts])[at]
        self.dist = np.concatenate([part.dist for part in parts])[at]

    def vote(self):
        """Most frequent label of every query, ties to the smallest."""
        order = np.lexsort((self.label, self.owner))
        owner, label = self.owner[order], self.label[order]
        first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (label[1:] != label[:-1])])
        count = np.diff(np.r_[first, len(owner)])
        ranked = np.lexsort((label[first], -count, owner[first]))
        return label[first][ranked[np.r_[True, np.diff(owner[first][ranked]) != 0]]]

    def batch(self):
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.ids[self.owner], pa.int64()),
                pa.array(self.found, pa.int64()),
                pa.array(self.label, pa.int32()),
                pa.array(self.dist, pa.float64()),
                pa.array(self.rank, pa.int32()),
            ],
            schema=_FOUND,
        )


class _Search:
    """Compares blocks of queries with blocks of the base inside a task.

    Copies cost nothing twice: equal queries are searched once, and of equal base rows only the
    ones with the lowest ids, as many as can be among the nearest, are compared at all.
    """

    def __init__(self, k, metric, skip_self, sparse, width):
        self.k, self.metric, self.skip_self, self.sparse, self.width = k, metric, skip_self, sparse, width
        # A row may find itself first.
        self.sought = k + skip_self

    def _read(self, batch):
        rows = read_rows(batch, self.sparse)
        width = self.width if self.sparse else rows.matrix.shape[1]
        return batch.column("id").to_numpy(), rows, width

    def queries(self, batch):
        """(ids, slices of distinct queries, place of every query among them)."""
        ids, rows, width = self._read(batch)
        distinct, place = np.unique(first_copies(rows), return_inverse=True)
        step = max(1, min(_QUERY_ROWS, distances.SLICE_VALUES // width))
        parts = [
            _Best(rows.take(distinct[at : at + step]), width, self.sought, self.metric)
            for at in range(0, len(distinct), step)
        ]
        return ids, parts, place

    def base(self, batch):
        """Slices of (ids, labels, vectors, their right form)."""
        return (piece for _, piece in self.placed(batch))

    def placed(self, batch):
        """The same with the row numbers of each slice, which follow the batch."""
        ids, rows, width = self._read(batch)
        copy_of = first_copies(rows)
        order = np.lexsort((ids, copy_of))
        ranked = copy_of[order]
        kept = order[np.arange(len(ranked)) - np.searchsorted(ranked, ranked) < self.sought]
        labels = batch.column("label").to_numpy()
        step = max(1, min(_BASE_ROWS, distances.SLICE_VALUES // width))
        for at in range(0, len(kept), step):
            part = kept[at : at + step]
            vectors = rows.take(part).to_matrix(width)
            yield part, (ids[part], labels[part], vectors, distances.right_form(self.metric, vectors))

    def result(self, ids, parts, place):
        return _Found(ids, parts, place, self.k, self.skip_self)

    def stream_base(self, base_batches, held):
        """Candidates for all held queries from the base rows of this task."""
        blocks_of = [self.queries(batch) for batch in _batches(held)]
        for batch in base_batches:
            if batch.num_rows:
                for piece in self.base(batch):
                    for _, parts, _ in blocks_of:
                        for part in parts:
                            part.see(piece)
        for block in blocks_of:
            yield self.result(*block).batch()

    def stream_cells(self, base, cell, held, visits):
        """Candidates for all held queries from base rows sorted by cell.

        visits(vectors) gives the (row, cell) pairs that matter; a query is compared with the slices that hold
        a row of such a cell.
        """
        (batch,) = _batches(base)
        placed = list(self.placed(batch))
        in_slice = np.zeros((cell.max() + 1, len(placed)), dtype=np.float32)
        for at, (part, _) in enumerate(placed):
            in_slice[cell[part], at] = 1.0
        for batch in _batches(held):
            block = self.queries(batch)
            for part in block[1]:
                wanted = np.zeros((len(part.bound), len(in_slice)), dtype=np.float32)
                wanted[visits(part.rows.to_matrix(self.width))] = 1.0
                wanted = wanted @ in_slice > 0
                for at, (_, piece) in enumerate(placed):
                    asking = np.flatnonzero(wanted[:, at])
                    if len(asking):
                        part.see(piece, asking)
            yield self.result(*block).batch()

    def finished(self, query_batch, pieces):
        """Neighbours of a batch of queries in all pieces of the base."""
        ids, parts, place = self.queries(query_batch)
        for part in parts:
            for piece in pieces:
                part.see(piece)
        return self.result(ids, parts, place)

    def pieces(self, held):
        """A held base, read once; sparse rows are filled in again for every use."""
        if self.sparse:
            return _Again(lambda: (piece for batch in _batches(held) for piece in self.base(batch)))
        return [piece for batch in _batches(held) for piece in self.base(batch)]


class _Again:
    """An iterable made afresh on every use."""

    def __init__(self, make):
        self.make = make

    def __iter__(self):
        return self.make()


def _batches(table):
    return [batch for batch in table.combine_chunks().to_batches() if batch.num_rows]


def nearest(queries, base, k, metric="auto", skip_self=False, sparse=False, width=None,
            small_bytes=blocks.SMALL_SIDE_BYTES, block_bytes=blocks.BLOCK_BYTES):
    """(id, neighbour, label, dist, rank) for the k nearest `base` rows of every query.

    Sparse rows of `width` features are filled in only for the slice being compared.
    """
    metric = distances.resolve(metric)
    if sparse and width is None:
        raise ValueError("sparse rows need their width")
    columns = feature_columns(sparse)
    label = F.col("label").cast("int") if "label" in base.columns else F.lit(0)
    base = base.select(F.col("id").cast("long"), *columns, label.alias("label"))
    queries = queries.select(F.col("id").cast("long"), *columns)
    search = _Search(k, metric, skip_self, sparse, width)

    base_rows, base_bytes = blocks.stored_bytes(base, columns)
    if base_bytes <= small_bytes:
        shared = base.sparkSession.sparkContext.broadcast(base.toArrow())

        def finish(batches):
            pieces = search.pieces(shared.value)
            for batch in batches:
                if batch.num_rows:
                    yield search.finished(batch, pieces).batch()

        return queries.mapInArrow(finish, from_arrow_schema(_FOUND))
    prunable = not sparse and metric != distances.COSINE
    query_rows, query_bytes = blocks.stored_bytes(queries, columns) if prunable else (0, 0)
    if query_bytes > small_bytes:
        block_rows = max(1, block_bytes * base_rows // base_bytes)
        base_most, query_most = (
            math.ceil(rows / blocks.parcels(size, block_bytes))
            for rows, size in ((base_rows, base_bytes), (query_rows, query_bytes))
        )
        found = cells.meet(
            queries, base, k + skip_self, metric, base_rows, block_rows, base_most, query_most, search.stream_cells, _FOUND
        )
    else:
        found = blocks.against(base, queries, columns, search.stream_base, _FOUND, small_bytes, block_bytes)
    rank = F.row_number().over(W.partitionBy("id").orderBy("dist", "neighbour"))
    # The rank filter also runs inside every task, so at most k rows per query leave it.
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def vote(neighbours):
    """Most frequent neighbour label, ties to the smallest label."""
    counts = neighbours.groupBy("id", "label").agg(F.count("*").alias("n"))
    return counts.groupBy("id").agg(
        F.max_by("label", largest_by_count(F.col("n"), F.col("label"))).cast("int").alias("prediction")
    )


def neighbour_graph(df, k=15, metric="euclidean", **sizes):
    """Edges (src, dst, dist, rank) to the k nearest other rows."""
    return nearest(df, df.select("id", "features"), k, metric, skip_self=True, **sizes).select(
        F.col("id").alias("src"), F.col("neighbour").alias("dst"), "dist", "rank"
    )


class NearestNeighbours:
    """k-nearest-neighbour classifier over a stored training table."""

    name = "knn"

    def __init__(self, n_neighbors=5, metric="auto"):
        self.n_neighbors, self.metric = n_neighbors, metric
        distances.resolve(metric)
        self.base = None
        self.sparse, self.width = False, None

    def fit(self, df, sparse=False, width=None):
        self.base = df.select("id", *feature_columns(sparse), "label")
        self.sparse, self.width = sparse, width
        return self

    def predict(self, df):
        """Add `prediction` in place of the features."""
        columns = feature_columns(self.sparse)
        base = self.base.select(F.col("id").cast("long"), *columns, F.col("label").cast("int"))
        if blocks.stored_bytes(base, columns)[1] <= blocks.SMALL_SIDE_BYTES:
            return df.withColumn("prediction", self._finish_here(base, columns)).drop(*columns)
        found = nearest(df, self.base, self.n_neighbors, self.metric, sparse=self.sparse, width=self.width)
        return df.drop(*columns).join(vote(found), "id")

    def _finish_here(self, base, columns):
        """A small training table travels to the queries, which are classified in the scan."""
        search = _Search(self.n_neighbors, distances.resolve(self.metric), False, self.sparse, self.width)
        shared = base.sparkSession.sparkContext.broadcast(base.toArrow())

        note = peaks.watcher()

        def labels_of(pieces, *arrays):
            if not len(arrays[0]):
                return pa.array([], pa.int32())
            ids = pa.array(np.arange(len(arrays[0])), pa.int64())
            asked = pa.RecordBatch.from_arrays([ids, *arrays], ["id", *columns])
            out = pa.array(search.finished(asked, pieces).vote(), pa.int32())
            note()
            return out

        @F.arrow_udf("int")
        def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            pieces = search.pieces(shared.value)
            for features in batches:
                yield labels_of(pieces, features)

        @F.arrow_udf("int")
        def classify_sparse(batches: Iterator[Tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            pieces = search.pieces(shared.value)
            for idx, val in batches:
                yield labels_of(pieces, idx, val)

        return (classify_sparse if self.sparse else classify)(*columns)

    def params(self):
        return {"n_neighbors": self.n_neighbors, "metric": self.metric}
