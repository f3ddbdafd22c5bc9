"""Features computed from images: gradient histograms and user-supplied networks."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.matrices import as_list_column, dense

# Fixed values of the block normalisation.
CLIP, EPSILON = 0.2, 1e-5


def gradient_histograms(images, orientations=9, cell=(4, 4), block=(2, 2)):
    """Histograms of oriented gradients of (n, height, width) images.

    Unsigned gradient angles, mean magnitude per cell and bin, overlapping blocks scaled to unit
    length, clipped, and scaled again.
    """
    n, height, width = images.shape
    down, right = np.zeros_like(images), np.zeros_like(images)
    down[:, 1:-1, :] = images[:, 2:, :] - images[:, :-2, :]
    right[:, :, 1:-1] = images[:, :, 2:] - images[:, :, :-2]
    size = np.hypot(right, down)
    angle = np.rad2deg(np.arctan2(down, right)) % 180.0
    rows, cols = height // cell[0], width // cell[1]
    sector = np.floor(angle / (180.0 / orientations)).astype(np.int64)
    cells = np.zeros((n, rows, cols, orientations))
    for o in range(orientations):
        part = np.where(sector == o, size, 0.0)[:, : rows * cell[0], : cols * cell[1]]
        cells[..., o] = part.reshape(n, rows, cell[0], cols, cell[1]).sum(axis=(2, 4)) / (cell[0] * cell[1])
    blocks = []
    for r in range(rows - block[0] + 1):
        for c in range(cols - block[1] + 1):
            values = cells[:, r : r + block[0], c : c + block[1]].reshape(n, -1)
            values = values / np.sqrt((values**2).sum(axis=1, keepdims=True) + EPSILON**2)
            values = np.minimum(values, CLIP)
            blocks.append(values / np.sqrt((values**2).sum(axis=1, keepdims=True) + EPSILON**2))
    return np.concatenate(blocks, axis=1)


def hog(df, height, width, orientations=9, cell=(4, 4), block=(2, 2)):
    """Replace grey images by their gradient histograms."""
    return featurize(
        df, lambda x: gradient_histograms(x.reshape(-1, height, width), orientations, cell, block)
    )


def featurize(df, network, batch_rows=128):
    """Replace the features by network(matrix of a batch), at most `batch_rows` rows at a time."""

    @F.arrow_udf("array<double>")
    def run(features: pa.Array) -> pa.Array:
        if not len(features):
            return pa.array([], pa.list_(pa.float64()))
        x = dense(features)
        parts = [network(x[at : at + batch_rows]) for at in range(0, len(x), batch_rows)]
        return as_list_column(np.concatenate(parts))

    return df.withColumn("features", run("features"))


def resize_matrix(size, wanted):
    """(size, wanted) weights of bilinear resampling with aligned pixel areas."""
    centre = np.clip((np.arange(wanted) + 0.5) * size / wanted - 0.5, 0, size - 1)
    low = np.floor(centre).astype(np.int64)
    high = np.minimum(low + 1, size - 1)
    out = np.zeros((size, wanted))
    np.add.at(out, (low, np.arange(wanted)), 1.0 - (centre - low))
    np.add.at(out, (high, np.arange(wanted)), centre - low)
    return out


def prepared_images(x, channels, height, width, wanted, mean, std):
    """Planar image rows -> (n, channels, wanted, wanted), resized and normalised per channel."""
    images = x.reshape(-1, channels, height, width)
    images = np.einsum("nchw,hy,wx->ncyx", images, resize_matrix(height, wanted), resize_matrix(width, wanted))
    return (images - np.asarray(mean)[None, :, None, None]) / np.asarray(std)[None, :, None, None]
