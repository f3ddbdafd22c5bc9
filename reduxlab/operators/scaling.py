"""Scalers: statistics in one fold of mergeable states, application inside the scan."""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

from ..functions import moments
from ..functions.columns import array_literal

MAX_FEATURES = 4_000_000


def _deviations(df, period=None):
    """Mean and population deviation by feature, or by feature number modulo `period`."""
    mass, mean, m2 = moments.table_moments(df, period)
    return mean, np.sqrt(np.divide(m2, mass, out=np.zeros_like(m2), where=mass > 0))


def feature_moments(df):
    """The same as a table, for narrow ones: pos, mean, population deviation."""
    return (
        df.select(F.posexplode("features").alias("pos", "x"))
        .groupBy("pos")
        .agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    )


def stored_width(df):
    """One more than the largest feature number of a sparse table."""
    return int(df.agg(F.max(F.array_max("idx")).alias("d")).head()["d"] or 0) + 1


def _checked(width):
    if width > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features")
    return int(width)


@dataclass(frozen=True)
class Shift:
    """x -> (x - mean[i]) / scale[i], with i taken modulo the number of statistics.

    Rows whose width is no multiple of them, or for `whole` statistics not that number, are an error.
    """

    mean: np.ndarray
    scale: np.ndarray
    whole: bool = False

    def transform(self, df):
        mean, scale, period = array_literal(self.mean), array_literal(self.scale), len(self.scale)

        def at(stats, i):
            return F.get(stats, i % period)

        size = F.size("features")
        fits = size == period if self.whole else size % period == 0
        wrong = F.raise_error(F.concat(F.lit(f"fitted on {period} statistics, not on "), size, F.lit(" features")))
        scaled = F.transform("features", lambda x, i: (x - at(mean, i)) / at(scale, i))
        return df.withColumn("features", F.when(fits | F.col("features").isNull(), scaled).otherwise(wrong))


def fit_standardizer(df, with_mean=True):
    """Population deviation; a constant feature is divided by 1."""
    mean, std = _deviations(df)
    return Shift(mean if with_mean else np.zeros_like(mean), np.where(std == 0, 1.0, std), whole=True)


def fit_channel_normalizer(df, channels, eps=1e-8):
    """The same per colour channel of images stored with the channel innermost."""
    mean, std = _deviations(df, channels)
    return Shift(mean, std + eps)


@dataclass(frozen=True)
class SparseScale:
    """val -> val / scale[idx]; zeros stay zeros."""

    scale: np.ndarray

    def transform(self, df):
        scale = array_literal(self.scale)
        # Features unseen while fitting keep their values.
        return df.withColumn(
            "val",
            F.zip_with("idx", "val", lambda i, v: v / F.coalesce(F.get(scale, i), F.lit(1.0))),
        )


def _scale_vector(values, width):
    """Statistics by feature; features without any, or with 0, are divided by 1."""
    scale = np.ones(max(width, len(values)))
    scale[: len(values)] = np.where(values == 0, 1.0, values)
    return SparseScale(scale)


def fit_max_abs(df, width=None):
    width = _checked(width if width is not None else stored_width(df))
    return _scale_vector(moments.stored_peaks(df, width), width)


def fit_sparse_deviation(df, width=None):
    """Deviation scaling that does not centre, so stored zeros are never filled in."""
    width = _checked(width if width is not None else stored_width(df))
    mass, mean, m2 = moments.stored_moments(df, width)
    # The rows that store nothing for a feature hold zeros: one more state to merge.
    zeros = np.stack([df.count() - mass, np.zeros_like(mean), np.zeros_like(m2)])
    mass, _, m2 = moments.merge(zeros, np.stack([mass, mean, m2]))
    return _scale_vector(np.sqrt(np.divide(m2, mass, out=np.zeros_like(m2), where=mass > 0)), width)


def rescale_pixels(df, peak=255.0):
    return df.withColumn("features", F.transform("features", lambda x: x / F.lit(peak)))
