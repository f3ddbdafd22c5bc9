"""Arrow batches as NumPy matrices, dense or compressed by row."""

import numpy as np
import pyarrow as pa

# Products of sparse rows are formed in slices of at most this many values.
_SLICE_VALUES = 4_000_000


def dense(column):
    """List column -> (rows, dims) matrix."""
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1) if rows else np.empty((0, 0))


def as_list_column(matrix):
    rows, dims = matrix.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * dims
    return pa.ListArray.from_arrays(offsets, np.ascontiguousarray(matrix, dtype=np.float64).ravel())


class SparseRows:
    """Rows given by pointers, feature numbers and values."""

    def __init__(self, pointers, idx, val):
        self.pointers, self.idx, self.val = pointers, idx, val

    @classmethod
    def from_columns(cls, idx_column, val_column):
        lengths = idx_column.value_lengths().to_numpy(zero_copy_only=False)
        pointers = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        return cls(
            pointers,
            idx_column.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
            val_column.flatten().to_numpy(zero_copy_only=False),
        )

    def __len__(self):
        return len(self.pointers) - 1

    def take(self, rows):
        lengths = np.diff(self.pointers)[rows]
        pointers = np.concatenate([[0], np.cumsum(lengths)])
        where = np.repeat(self.pointers[:-1][rows] - pointers[:-1], lengths) + np.arange(pointers[-1])
        return SparseRows(pointers, self.idx[where], self.val[where])

    def signature(self):
        """A number per row, equal for equal rows."""
        mixed = self.val * np.sin(1.0 + self.idx)
        return np.bincount(np.repeat(np.arange(len(self)), np.diff(self.pointers)), mixed, len(self))

    def equals(self, other):
        """Which rows equal the same-numbered row of `other`."""
        same = np.diff(self.pointers) == np.diff(other.pointers)
        mine, theirs = self.take(np.flatnonzero(same)), other.take(np.flatnonzero(same))
        row_of = np.repeat(np.flatnonzero(same), np.diff(mine.pointers))
        same[row_of[(mine.idx != theirs.idx) | (mine.val != theirs.val)]] = False
        return same

    def to_matrix(self, width):
        out = np.zeros((len(self), width))
        out[np.repeat(np.arange(len(self)), np.diff(self.pointers)), self.idx] = self.val
        return out

    def _slices(self, width):
        step = max(1, _SLICE_VALUES // max(width, 1))
        start = 0
        while start < len(self):
            stop = int(np.searchsorted(self.pointers, self.pointers[start] + step, side="right")) - 1
            stop = min(len(self), max(start + 1, stop))
            yield start, stop
            start = stop

    def dot(self, weights):
        """rows @ weights."""
        out = np.zeros((len(self), weights.shape[1]))
        for start, stop in self._slices(weights.shape[1]):
            lo, hi = self.pointers[start], self.pointers[stop]
            if hi == lo:
                continue
            terms = self.val[lo:hi, None] * weights[self.idx[lo:hi]]
            filled = np.flatnonzero(np.diff(self.pointers[start : stop + 1]))
            out[start + filled] = np.add.reduceat(terms, self.pointers[start:stop][filled] - lo, axis=0)
        return out

    def transposed_terms(self, right):
        """The touched rows of rows.T @ right: their numbers and values. For few rows."""
        order = np.argsort(self.idx, kind="stable")
        idx = self.idx[order]
        if not len(idx):
            return idx, np.zeros((0, right.shape[1]))
        row_of = np.repeat(np.arange(len(self)), np.diff(self.pointers))[order]
        first = np.flatnonzero(np.r_[True, idx[1:] != idx[:-1]])
        return idx[first], np.add.reduceat(self.val[order, None] * right[row_of], first, axis=0)

    def transposed_dot(self, right, dims):
        """rows.T @ right, summed by feature number."""
        out = np.zeros((dims, right.shape[1]))
        row_of = np.repeat(np.arange(len(self)), np.diff(self.pointers))
        for start, stop in self._slices(right.shape[1]):
            lo, hi = self.pointers[start], self.pointers[stop]
            if hi == lo:
                continue
            order = np.argsort(self.idx[lo:hi], kind="stable")
            idx = self.idx[lo:hi][order]
            terms = self.val[lo:hi][order, None] * right[row_of[lo:hi][order]]
            first = np.flatnonzero(np.r_[True, idx[1:] != idx[:-1]])
            out[idx[first]] += np.add.reduceat(terms, first, axis=0)
        return out


class DenseRows:
    """The same three products for a plain matrix."""

    def __init__(self, matrix):
        self.matrix = matrix

    def __len__(self):
        return self.matrix.shape[0]

    def take(self, rows):
        return DenseRows(self.matrix[rows])

    def signature(self):
        return (self.matrix * np.sin(1.0 + np.arange(self.matrix.shape[1]))).sum(axis=1)

    def equals(self, other):
        return (self.matrix == other.matrix).all(axis=1)

    def to_matrix(self, width):
        return self.matrix

    def dot(self, weights):
        return self.matrix @ weights

    def transposed_terms(self, right):
        return slice(None), self.matrix.T @ right

    def transposed_dot(self, right, dims):
        return self.matrix.T @ right


def first_copies(rows):
    """For every row the number of an equal row, the same one for all its copies."""
    _, first, group = np.unique(rows.signature(), return_index=True, return_inverse=True)
    chosen = first[group]
    return np.where(rows.equals(rows.take(chosen)), chosen, np.arange(len(rows)))


def read_rows(batch, sparse):
    """Feature rows of a batch whose columns are `features`, or `idx` and `val`."""
    if sparse:
        return SparseRows.from_columns(batch.column("idx"), batch.column("val"))
    return DenseRows(dense(batch.column("features")))


def feature_columns(sparse):
    return ["idx", "val"] if sparse else ["features"]
