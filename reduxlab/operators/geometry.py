"""Scores over pairs of rows: silhouette, distance preservation, distance distortion.

The pairs are never rows. Tasks compare blocks of the (usually sampled) table and emit sums per
point and cluster, moments, or histogram counts.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import distances
from ..functions.matrices import dense
from . import blocks
from .sampling import subsample

_SILHOUETTE = pa.schema(
    [("id", pa.int64()), ("own", pa.int32()), ("other", pa.int32()), ("n", pa.int64()), ("total", pa.float64())]
)
_MOMENTS = pa.schema(
    [("method", pa.string())] + [(c, pa.float64()) for c in ("n", "m1", "m2", "v1", "v2", "c12")]
)
_RANGE = pa.schema([("method", pa.string()), ("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int64())])
_BINS = pa.schema([("method", pa.string()), ("bin", pa.int32()), ("n", pa.int64())])
SAME_POINT = 1e-12
MAX_BROADCAST_IDS = 1_000_000


def _matrix(table, name):
    column = table.column(name)
    return dense(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)


def _table(schema, rows):
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def silhouette_widths(df, sample_size=2000, seed=42, cluster="cluster", **sizes):
    """(id, cluster, width) on Euclidean distances; a cluster of one row has width 0."""
    sample = subsample(df, sample_size, seed).select(
        F.col("id").cast("long"), "features", F.col(cluster).cast("int").alias("cluster")
    )

    def work(batches, held):
        names, code = np.unique(held["cluster"].to_numpy(), return_inverse=True)
        points = _matrix(held, "features") if held.num_rows else None
        members = np.zeros((held.num_rows, len(names)))
        members[np.arange(held.num_rows), code] = 1.0
        for batch in batches:
            for at in distances.row_slices(batch.num_rows, max(1, held.num_rows)):
                part = batch.slice(at.start, at.stop - at.start)
                if not held.num_rows:
                    continue
                sums = distances.euclidean(_matrix(part, "features"), points) @ members
                rows = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(part.column("id").to_numpy(), len(names)), pa.int64()),
                        pa.array(np.repeat(part.column("cluster").to_numpy(), len(names)), pa.int32()),
                        pa.array(np.tile(names, rows), pa.int32()),
                        pa.array(np.tile(members.sum(axis=0).astype(np.int64), rows), pa.int64()),
                        pa.array(sums.ravel(), pa.float64()),
                    ],
                    schema=_SILHOUETTE,
                )

    sums = (
        blocks.against(sample, sample, ["features"], work, _SILHOUETTE, **sizes)
        .groupBy("id", "own", "other")
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    )
    inside = F.col("own") == F.col("other")
    per_point = sums.groupBy("id", "own").agg(
        F.max(F.when(inside, F.col("n"))).alias("size"),
        F.max(F.when(inside & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~inside, F.col("total") / F.col("n"))).alias("b"),
    )
    spread = F.greatest("a", "b")
    width = F.when((F.col("size") == 1) | (spread == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / spread)
    return per_point.select("id", F.col("own").alias("cluster"), width.alias("width"))


def silhouette(df, sample_size=2000, seed=42, cluster="cluster", **sizes):
    """One row: mean silhouette width; undefined (null) for a single cluster."""
    return silhouette_widths(df, sample_size, seed, cluster, **sizes).agg(F.avg("width").alias("silhouette"))


def pair_distances(batches, held, vectors):
    """Distances of every pair of rows once, one array per vector column."""
    if not held.num_rows:
        return
    ids = held["id"].to_numpy()
    points = {v: _matrix(held, v) for v in vectors}
    for batch in batches:
        for at in distances.row_slices(batch.num_rows, held.num_rows):
            part = batch.slice(at.start, at.stop - at.start)
            once = part.column("id").to_numpy()[:, None] < ids[None, :]
            if once.any():
                yield [distances.euclidean(_matrix(part, v), points[v])[once] for v in vectors]


def paired_sample(original, reduced, sample_size, seed=42):
    """id, `original` and one vector column per entry of `reduced`, for a sample of the rows.

    The sample is drawn before the tables are joined, so only its rows travel.
    """
    chosen = subsample(original.select("id", F.col("features").alias("original")), sample_size, seed)
    if sample_size is not None and sample_size <= MAX_BROADCAST_IDS:
        ids = F.broadcast(chosen.select("id"))
        reduced = {name: df.join(ids, "id", "left_semi") for name, df in reduced.items()}
    for name, df in reduced.items():
        chosen = chosen.join(df.select("id", F.col("features").alias(name)), "id")
    return chosen


def distance_moments(df, methods, **sizes):
    """Per method: number of pairs, means, variances and covariance of the two distances."""

    def work(batches, held):
        for base, *others in pair_distances(batches, held, ["original", *methods]):
            for method, reduced in zip(methods, others):
                m1, m2 = base.mean(), reduced.mean()
                yield _table(
                    _MOMENTS,
                    [
                        {
                            "method": method,
                            "n": float(len(base)),
                            "m1": m1,
                            "m2": m2,
                            "v1": float(((base - m1) ** 2).sum()),
                            "v2": float(((reduced - m2) ** 2).sum()),
                            "c12": float(((base - m1) * (reduced - m2)).sum()),
                        }
                    ],
                )

    return blocks.against(df, df, ["original", *methods], work, _MOMENTS, **sizes)


def distance_preservation(original, reduced, sample_size=1000, seed=42, **sizes):
    """Per method, Pearson's correlation of pair distances before and after reduction."""
    methods = list(reduced)
    parts = distance_moments(paired_sample(original, reduced, sample_size, seed), methods, **sizes)
    n = F.col("n")

    def spread(own, left, right):
        total = F.sum(n)
        between = F.sum(n * F.col(left) * F.col(right)) - F.sum(n * F.col(left)) * F.sum(n * F.col(right)) / total
        return F.sum(own) + between

    both = F.sqrt(spread("v1", "m1", "m1") * spread("v2", "m2", "m2"))
    return parts.groupBy("method").agg((spread("c12", "m1", "m2") / both).alias("distance_preservation"))


def distance_distortion(original, reduced, sample_size=600, seed=42, bins=50, **sizes):
    """Per method, a histogram of reduced / original distance over equal bins."""
    methods = list(reduced)
    sample = paired_sample(original, reduced, sample_size, seed)
    columns = ["original", *methods]

    def ratios(batches, held):
        for base, *others in pair_distances(batches, held, columns):
            apart = base > SAME_POINT
            yield [(m, other[apart] / base[apart]) for m, other in zip(methods, others)]

    def extent(batches, held):
        for found in ratios(batches, held):
            rows = [
                {"method": m, "lo": float(r.min()), "hi": float(r.max()), "n": len(r)} for m, r in found if len(r)
            ]
            if rows:
                yield _table(_RANGE, rows)

    # One row per method.
    limits = {
        row["method"]: (row["lo"], row["hi"])
        for row in blocks.against(sample, sample, columns, extent, _RANGE, **sizes)
        .groupBy("method")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .collect()
    }

    def count(batches, held):
        for found in ratios(batches, held):
            for method, ratio in found:
                if not len(ratio):
                    continue
                lo, hi = limits[method]
                if lo == hi:
                    lo, hi = lo - 0.5, hi + 0.5
                place = np.floor((ratio - lo) / (hi - lo) * bins).astype(np.int64)
                hits = np.bincount(np.minimum(place, bins - 1), minlength=bins)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([method] * bins),
                        pa.array(np.arange(1, bins + 1), pa.int32()),
                        pa.array(hits, pa.int64()),
                    ],
                    schema=_BINS,
                )

    counted = blocks.against(sample, sample, columns, count, _BINS, **sizes)
    edges = original.sparkSession.createDataFrame(
        [(m, lo, hi) for m, (lo, hi) in limits.items()], "method string, lo double, hi double"
    )
    return (
        counted.groupBy("method", "bin")
        .agg(F.sum("n").alias("n"))
        .join(F.broadcast(edges), "method")
        .select(
            "method",
            "bin",
            (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("bin") - 1) / bins).alias("bin_start"),
            (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins).alias("bin_end"),
            "n",
        )
    )
