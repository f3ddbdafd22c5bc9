"""Second moments of a table and the spectral reducers built on them."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..errors import ReductionError
from ..functions import folds
from ..functions.matrices import feature_columns, read_rows

# A covariance of this many features is 512 MiB; the axes of wider tables come from products with blocks of vectors.
MAX_COVARIANCE_DIM = 8192
OVERSAMPLES = 10
# Vectors that the block Lanczos iteration keeps per wanted axis before it starts anew from its best ones, how far
# an axis may be from the exact one, relative to the largest variance, and its most passes.
KEPT_BLOCKS = 8
RESIDUAL = 1e-9
MAX_PASSES = 300


def _gram_fold(mean, width):
    shift = mean if mean is not None else np.zeros(width)

    def fold(batches):
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                x = read_rows(batch, False).matrix - shift
                total += x.T @ x
        return total

    return fold


def column_means(df, width, sparse=False):
    """Row count and mean of every feature, stored zeros or not."""

    def fold(batches):
        total = np.zeros(width + 1)
        for batch in batches:
            if batch.num_rows:
                rows = read_rows(batch, sparse)
                total[0] += len(rows)
                total[1:] += rows.transposed_dot(np.ones((len(rows), 1)), width)[:, 0]
        return total

    state = folds.folded(df.select(*feature_columns(sparse)), fold, width + 1)
    return int(state[0]), state[1:] / max(state[0], 1)


def covariance(df, width):
    """Row count, mean and sample covariance, centred before the products are formed."""
    n, mean = column_means(df, width)
    gram = folds.folded(df.select("features"), _gram_fold(mean, width), width * width)
    return n, mean, gram.reshape(width, width) / (n - 1)


def covariance_table(df, width):
    """The same covariance as rows (i, j, cov), summed and kept inside Spark."""
    n, mean = column_means(df, width)
    summed = folds.folded_table(df.select("features"), _gram_fold(mean, width), width * width)
    return summed.select(
        F.floor(F.col("pos") / width).cast("int").alias("i"),
        (F.col("pos") % width).cast("int").alias("j"),
        (F.col("value") / (n - 1)).alias("cov"),
    )


def _power_fold(shared, mean, width, sparse):
    shift = None if mean is None else mean

    def fold(batches):
        basis = shared.value
        total = np.zeros((width, basis.shape[1]))
        offset = 0.0 if shift is None else shift @ basis
        mass = np.zeros(basis.shape[1])
        for batch in batches:
            if batch.num_rows:
                rows = read_rows(batch, sparse)
                scores = rows.dot(basis) - offset
                total += rows.transposed_dot(scores, width)
                mass += scores.sum(axis=0)
        return total if shift is None else total - np.outer(shift, mass)

    return fold


def power_step(df, basis, mean=None, sparse=False):
    """(A - mean)^T (A - mean) @ basis in one pass."""
    width, size = basis.shape
    shared = folds.share(df, basis, basis.nbytes, "range basis")
    fold = _power_fold(shared, mean, width, sparse)
    total = folds.folded(df.select(*feature_columns(sparse)), fold, width * size)
    shared.destroy()
    return total.reshape(width, size)


def power_step_table(df, basis, mean=None, sparse=False):
    """One power step as rows (i, j, value)."""
    width, size = basis.shape
    shared = folds.share(df, basis, basis.nbytes, "range basis")
    fold = _power_fold(shared, mean, width, sparse)
    return folds.folded_table(df.select(*feature_columns(sparse)), fold, width * size).select(
        F.floor(F.col("pos") / size).cast("int").alias("i"), (F.col("pos") % size).cast("int").alias("j"), "value"
    )


def oriented(vectors):
    """Fix each column's sign: its largest loading is positive."""
    peak = np.abs(vectors).argmax(axis=0)
    sign = np.sign(vectors[peak, np.arange(vectors.shape[1])])
    return vectors * np.where(sign == 0, 1.0, sign)


def _orthonormal(block, basis):
    """Directions of a block that a basis does not have yet; numerically dependent ones go."""
    size = max(float(np.abs(block).max(initial=0.0)), 1e-300)
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    vectors, values, _ = np.linalg.svd(block / size, full_matrices=False)
    vectors = vectors[:, values > 1e-12 * max(1.0, values.max(initial=0.0))]
    return np.linalg.qr(vectors - basis @ (basis.T @ vectors))[0]


def lanczos(product, width, n_components, seed=42):
    """Leading eigenvectors of a symmetric product and their values, by block Lanczos with full reorthogonalisation.

    A pass multiplies one block. The best vectors in the space of all blocks are exact once their residuals are
    tiny or the space is closed; a space that grows too large goes on from its best vectors.
    """
    rng = np.random.default_rng(seed)
    size = min(width, n_components + OVERSAMPLES)
    block = np.linalg.qr(rng.standard_normal((width, size)))[0]
    basis, image = np.zeros((width, 0)), np.zeros((width, 0))
    for _ in range(MAX_PASSES):
        fresh = product(block)
        basis, image = np.hstack([basis, block]), np.hstack([image, fresh])
        small = basis.T @ image
        values, rotation = np.linalg.eigh((small + small.T) / 2)
        values, rotation = values[::-1], rotation[:, ::-1]
        lead = rotation[:, :n_components]
        residual = np.linalg.norm(image @ lead - basis @ (lead * values[:n_components]), axis=0).max()
        if basis.shape[1] >= n_components and residual <= RESIDUAL * max(float(values[0]), 1e-300):
            break
        following = _orthonormal(fresh, basis)
        if not following.shape[1]:
            if basis.shape[1] >= n_components:
                break
            following = _orthonormal(rng.standard_normal((width, size)), basis)
        if basis.shape[1] + following.shape[1] > KEPT_BLOCKS * size:
            best = rotation[:, : 2 * size]
            basis, image = basis @ best, image @ best
            following = _orthonormal(following, basis)
        block = following[:, : width - basis.shape[1]]
        if not block.shape[1]:
            break
    else:
        raise ReductionError(f"the axes have not settled after {MAX_PASSES} passes: residual {residual / values[0]:.1e}")
    return basis @ lead, values[:n_components]


def full_components(df, width, n_components):
    """Mean, leading principal axes and their variances: from the exact covariance, or to `RESIDUAL` where it is too wide."""
    rows = df.select("features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if width <= MAX_COVARIANCE_DIM:
            n, mean, cov = covariance(rows, width)
            _check_rank(n, width, n_components)
            variances, vectors = np.linalg.eigh(cov)
            lead = np.argsort(variances)[::-1][:n_components]
            return mean, oriented(vectors[:, lead]), variances[lead]
        n, mean = column_means(rows, width)
        _check_rank(n, width, n_components)
        axes, squares = lanczos(lambda block: power_step(rows, block, mean), width, n_components)
        return mean, oriented(axes), np.maximum(squares, 0.0) / (n - 1)
    finally:
        rows.unpersist()


def _check_rank(n, width, n_components):
    if n_components > min(n, width):
        raise ReductionError(f"{n_components} components wanted from {n} rows of {width} features")


def randomized_components(df, width, n_components, n_iter=5, seed=42, centre=False, sparse=False):
    """Leading right singular vectors by a randomised range finder (Halko et al., 2011).

    One pass per power iteration; the driver holds `width` x (k + 10) numbers.
    """
    if n_components > width:
        raise ReductionError(f"{n_components} components wanted from {width} features")
    rows = df.select(*feature_columns(sparse)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        mean = column_means(rows, width, sparse)[1] if centre else None
        size = min(width, n_components + OVERSAMPLES)
        basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0]
        for _ in range(n_iter + 1):
            basis = np.linalg.qr(power_step(rows, basis, mean, sparse))[0]
        small = basis.T @ power_step(rows, basis, mean, sparse)
    finally:
        rows.unpersist()
    squares, rotation = np.linalg.eigh((small + small.T) / 2)
    lead = np.argsort(squares)[::-1][:n_components]
    return mean, oriented(basis @ rotation[:, lead]), np.sqrt(np.maximum(squares[lead], 0.0))
