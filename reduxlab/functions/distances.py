"""Distances between rows of matrices."""

import numpy as np

EUCLIDEAN, COSINE, MANHATTAN, CHEBYSHEV = "euclidean", "cosine", "manhattan", "chebyshev"
_NAMES = {
    "auto": EUCLIDEAN,
    "euclidean": EUCLIDEAN,
    "l2": EUCLIDEAN,
    "minkowski": EUCLIDEAN,
    "cosine": COSINE,
    "manhattan": MANHATTAN,
    "cityblock": MANHATTAN,
    "l1": MANHATTAN,
    "chebyshev": CHEBYSHEV,
    "infinity": CHEBYSHEV,
}
# Temporary arrays hold at most this many values.
SLICE_VALUES = 4_000_000
# Left rows whose distances to a slice are summed up together.
_TILE_ROWS = 128
# Share of the mean distance that rounding to steps may be off.
_COARSE = 1 / 16


def resolve(metric):
    if metric not in _NAMES:
        raise ValueError(f"Unknown metric: {metric}")
    return _NAMES[metric]


def _unit(rows):
    norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return rows / np.where(norm == 0, 1.0, norm)[:, None]


def aligned(metric, left, right):
    """Distance of row i to row i, from the differences themselves."""
    if metric == COSINE:
        return 1.0 - np.einsum("ij,ij->i", _unit(left), _unit(right))
    gap = np.abs(left - right)
    if metric == EUCLIDEAN:
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return gap.sum(axis=1) if metric == MANHATTAN else gap.max(axis=1)


def aligned_pairs(metric, left, right, i, j):
    """Exact distances of the pairs (left[i], right[j]), in slices."""
    out = np.empty(len(i))
    step = max(1, SLICE_VALUES // max(1, left.shape[1]))
    for start in range(0, len(i), step):
        at = slice(start, start + step)
        out[at] = aligned(metric, left[i[at]], right[j[at]])
    return out


# A stand-in grows with the distance and costs one matrix product: the square for Euclidean
# distances (the squared lengths ride along as two more columns), minus the cosine for cosine
# distances, and the distance itself otherwise.


def left_form(metric, rows):
    if metric == EUCLIDEAN:
        squares = np.einsum("ij,ij->i", rows, rows)
        return np.column_stack([-2.0 * rows, squares, np.ones(len(rows))])
    return -_unit(rows) if metric == COSINE else rows


def right_form(metric, rows):
    if metric == EUCLIDEAN:
        squares = np.einsum("ij,ij->i", rows, rows)
        return np.column_stack([rows, np.ones(len(rows)), squares])
    return _unit(rows) if metric == COSINE else rows


def stand_in(metric, left, right):
    """All stand-ins between two tables in their left and right forms."""
    if metric in (EUCLIDEAN, COSINE):
        return left @ right.T
    out = np.zeros((len(left), len(right)))
    join, columns = np.add if metric == MANHATTAN else np.maximum, np.ascontiguousarray(right.T)
    for at in range(0, len(left), _TILE_ROWS):
        total = out[at : at + _TILE_ROWS]
        gap = np.empty_like(total)
        for f in range(left.shape[1]):
            np.subtract(left[at : at + _TILE_ROWS, f, None], columns[f], out=gap)
            join(total, np.abs(gap, out=gap), out=total)
    return out


def compared(metric, left, right):
    """Stand-ins for the choice of candidates, and per left row what they may be off."""
    if metric == MANHATTAN and left.size and right.size:
        near, noise = _stepped(left, right)
        # Steps too coarse for the distances at hand would leave too many candidates.
        if near is not None and noise.max() <= _COARSE * near[:_TILE_ROWS].mean():
            return near, noise + rounding(metric, left, right)
    return stand_in(metric, left, right), rounding(metric, left, right)


def _stepped(left, right):
    """Manhattan distances of rows rounded to equal steps, and what that changes per left row.

    Steps are so many that the sum over all features fits 16 bits. As |a - b| = 2 max(a, b) - a - b,
    a pair costs one maximum and one sum per feature, on tiles that stay in the processor's cache.
    """
    low, steps = min(left.min(), right.min()), np.iinfo(np.uint16).max // left.shape[1]
    step = (max(left.max(), right.max()) - low) / max(1, steps)
    # Single precision holds the result; NaN fails too.
    if not steps or not 1e-30 < step < 1e30:
        return None, None
    (mine, off), (theirs, more) = _in_steps(left, low, step), _in_steps(right, low, step)
    columns, sums = np.ascontiguousarray(theirs.T), theirs.sum(axis=1, dtype=np.uint16)
    near = np.empty((len(left), len(right)), dtype=np.float32)
    for at in range(0, len(left), _TILE_ROWS):
        part = mine[at : at + _TILE_ROWS]
        total = np.zeros((len(part), len(right)), dtype=np.uint16)
        larger = np.empty_like(total)
        for f in range(left.shape[1]):
            np.add(total, np.maximum(part[:, f, None], columns[f], out=larger), out=total)
        # The result fits 16 bits, so what overflows on the way to it does no harm.
        total += total
        total -= part.sum(axis=1, dtype=np.uint16)[:, None]
        total -= sums
        np.multiply(total, np.float32(step), out=near[at : at + _TILE_ROWS])
    return near, off + more.max() + step


def _in_steps(rows, low, step):
    """Rows as whole numbers of steps above `low`, and per row the distance to what they were."""
    whole = np.rint((rows - low) / step).astype(np.uint16)
    return whole, np.abs(rows - (low + whole * step)).sum(axis=1)


def as_stand_in(metric, distance):
    return distance * distance if metric == EUCLIDEAN else distance - 1.0 if metric == COSINE else distance


def rounding(metric, left, right):
    """Per left row, what rounding may do to its stand-ins."""
    if not len(right):
        return np.zeros(len(left))
    scale = np.abs(left).max(axis=1, initial=0.0) * left.shape[1] + np.abs(right).max() * right.shape[1]
    if metric == EUCLIDEAN:
        return 1e-14 * left.shape[1] * (left[:, -2] + right[:, -1].max())
    return 1e-14 * (scale + left.shape[1])


def approximate(metric, left, right):
    """All distances by the fastest route, and a bound on their error per row of `left`."""
    left, right = left_form(metric, left), right_form(metric, right)
    near, noise = stand_in(metric, left, right), rounding(metric, left, right)
    if metric == EUCLIDEAN:
        return np.sqrt(np.maximum(near, 0.0)), np.sqrt(noise)
    return (near + 1.0 if metric == COSINE else near), noise


def euclidean(left, right):
    """All distances; pairs too close for the product formula are taken from differences."""
    a = np.einsum("ij,ij->i", left, left)
    b = np.einsum("ij,ij->i", right, right)
    scale = a[:, None] + b[None, :]
    squares = scale - 2.0 * (left @ right.T)
    i, j = np.nonzero(squares < 1e-4 * scale)
    out = np.sqrt(np.maximum(squares, 0.0))
    out[i, j] = aligned_pairs(EUCLIDEAN, left, right, i, j)
    return out


def row_slices(rows, width):
    """Ranges of rows whose product with `width` columns stays small."""
    step = max(1, SLICE_VALUES // max(1, width))
    for start in range(0, rows, step):
        yield slice(start, min(rows, start + step))
