"""The two experiment grids: cells are Spark jobs, a few of them at a time, and their records are kept as they end."""

import time
import warnings
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..operators import geometry, scaling, scores
from ..operators.partitions import GaussianMixture, KMeans
from ..operators.reducers import feasible_dims, make_cluster_reducer
from ..operators.sampling import sample_stratified
from ..sources.records import RecordStore
from .evaluate import RECORD_SCHEMA, evaluate, fit_once, side_sizes

METHODS = ["pca", "rp", "srp", "dct"]
CLUSTER_SCHEMA = (
    "dataset string, method string, model string, k int, ari double, nmi double, purity double, silhouette double, "
    "distance_preservation double, reduction_time double, clustering_time double, total_time double"
)


CELL_KEY = ("run_id", "seed", "dataset", "reducer", "force_srp_matrix_type", "requested_dim", "model")
CLUSTER_KEY = ("dataset", "method", "k", "model")


def records_frame(spark, records, schema=RECORD_SCHEMA):
    return RecordStore(spark, None, schema, ()).frame(records)


def concurrently(spark, work, cells, at_once):
    """work(cell) for all cells, so many at a time, each in a scheduler pool of its own; results in order."""

    def pooled(numbered):
        number, cell = numbered
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"cell-{number}")
        try:
            return work(cell)
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    if at_once == 1 or len(cells) < 2:
        return [work(cell) for cell in cells]
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(pooled, enumerate(cells)))


def classification_sweep(spark, load, datasets, reducers=("identity", "sparse_rp"), models=("knn",), dims=(100,),
                         runs=1, seed=42, force_srp_matrix_type=None, path=None, at_once=1, **options):
    """runs x datasets x reducers x dims x models -> one record per cell.

    With `path` the records of a cell are appended there as soon as it is done, and cells found there are not run
    again, so a sweep that was stopped goes on where it was. Every reducer is fitted once per run and dataset, to
    the largest dimension; smaller ones are its first components and carry its fit time. `at_once` cells run
    side by side; times are only comparable when it is 1.

    `load(name, seed)` gives the prepared table of a run; run r uses seed + r. The identity
    reducer runs once, dimensions beyond the data are skipped.
    """
    store, order = RecordStore(spark, path, RECORD_SCHEMA, CELL_KEY), []
    for run_id in range(runs):
        for name in datasets:
            table = load(name, seed + run_id)
            run_seed, cells, open_ = seed + run_id, [], []
            for reducer in reducers:
                for k in feasible_dims([None] if reducer == "identity" else dims, table.input_dim):
                    force = force_srp_matrix_type if reducer == "sparse_rp" else None
                    wanted = "original" if k is None else str(k)
                    keys = [(run_id, run_seed, table.name, reducer, force, wanted, model) for model in models]
                    cells += keys
                    missing = [model for model, key in zip(models, keys) if key not in store]
                    if missing:
                        open_.append((reducer, k, missing))
            order += cells
            if open_:
                _classify(spark, table, open_, store, run_id, run_seed, force_srp_matrix_type, at_once, options)
    return store.frame([store.get(key) for key in order])


def _classify(spark, table, cells, store, run_id, seed, force_srp_matrix_type, at_once, options):
    """Runs the open cells (reducer, k, models) of one table."""
    stored = table.df.persist(StorageLevel.MEMORY_AND_DISK)
    kept = table.with_df(stored)
    try:
        sizes = side_sizes(kept)
        largest = {}
        for reducer, k, _ in cells:
            if k is not None:
                largest[reducer] = max(k, largest.get(reducer, 0))

        def fit(cell):
            return fit_once(kept, cell[0], cell[1], seed, force_srp_matrix_type, **options)

        fits = dict(zip(largest, concurrently(spark, fit, list(largest.items()), at_once)))

        def run(cell):
            reducer, k, models = cell
            store.add(
                evaluate(kept, reducer, k, models, run_id, seed, force_srp_matrix_type, fits.get(reducer), sizes, **options)
            )

        concurrently(spark, run, cells, at_once)
    finally:
        stored.unpersist()


def _timed(work):
    start = time.perf_counter()
    out = work()
    return out, time.perf_counter() - start


def _stored(df):
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    out.write.format("noop").mode("overwrite").save()
    return out


def cluster_models(n_clusters, seed=42, **options):
    """The two compared models; options limit restarts or iterations."""
    return {
        "kmeans": KMeans(n_clusters, seed=seed, **options.get("kmeans", {})),
        "gmm": GaussianMixture(n_clusters, seed=seed, **options.get("gmm", {})),
    }


def _cell(table, df, method, k, models, n_clusters, reduction_time, preserved, seed, options):
    rows = []
    for name, model in cluster_models(n_clusters, seed, **options).items():
        if name not in models:
            continue
        clustered, seconds = _timed(lambda: _stored(model.fit(df).transform(df)))
        try:
            agreement = scores.clustering_agreement(clustered).head().asDict()
            width = geometry.silhouette(clustered, seed=seed).head()["silhouette"]
        finally:
            clustered.unpersist()
        rows.append(
            {
                "dataset": table.name, "method": method, "model": name, "k": k, **agreement, "silhouette": width,
                "distance_preservation": preserved, "reduction_time": reduction_time, "clustering_time": seconds,
                "total_time": reduction_time + seconds,
            }
        )
    return rows


def prepare_sample(table, sample_size, seed=42):
    """Stratified sample of the table, standardised over the whole sample."""
    sample = sample_stratified(table.df, sample_size, seed)
    return table.with_df(scaling.fit_standardizer(sample).transform(sample))


def clustering_sweep(spark, tables, dims=(50, 100, 200), sample_size=10_000, seed=42, methods=METHODS, path=None, at_once=1,
                     **options):
    """datasets x k x methods x {k-means, mixture} -> one record per cell.

    Cells are kept at `path`, fitted once per method and run side by side as in the classification sweep. A cell
    that fails is warned of, has null scores, and is run again by the next sweep with that path.
    """
    store, rows = RecordStore(spark, path, CLUSTER_SCHEMA, CLUSTER_KEY), []
    names = list(cluster_models(1, seed))
    for table in tables:
        cells = [(k, method) for k in feasible_dims(dims, table.input_dim) for method in methods]
        open_ = [(k, method, [n for n in names if (table.name, method, k, n) not in store]) for k, method in cells]
        open_ = [cell for cell in open_ if cell[2]]
        if open_:
            _cluster(spark, table, open_, store, sample_size, seed, at_once, options)
        for key in ((table.name, method, k, name) for k, method in cells for name in names):
            rows.append(store.get(key) if key in store else dict(zip(CLUSTER_KEY, key)))
    return store.frame(rows)


def _cluster(spark, table, cells, store, sample_size, seed, at_once, options):
    """Runs the open cells (k, method, models) of one table."""
    sampled = prepare_sample(table, sample_size, seed)
    stored = _stored(sampled.df)
    sampled = sampled.with_df(stored)
    try:
        n_clusters = stored.agg(F.countDistinct("label").alias("n")).head()["n"]
        largest = {}
        for k, method, _ in cells:
            largest[method] = max(k, largest.get(method, 0))

        def fit(cell):
            reducer = make_cluster_reducer(*cell, seed).setup(sampled)
            return _timed(lambda: reducer.fit(stored))

        fits = dict(zip(largest, concurrently(spark, fit, list(largest.items()), at_once)))

        def run(cell):
            k, method, models = cell
            reducer, fitted = fits[method]
            df = None
            try:
                df, seconds = _timed(lambda: _stored(reducer.sliced(k).transform(stored)))
                preserved = geometry.distance_preservation(stored, {method: df}, seed=seed).head()["distance_preservation"]
                store.add(_cell(table, df, method, k, models, n_clusters, fitted + seconds, preserved, seed, options))
            except Exception as error:  # a failed cell must not end the sweep
                warnings.warn(f"{table.name}, {method}, {k}: {type(error).__name__}: {error}", stacklevel=2)
            finally:
                if df is not None:
                    df.unpersist()

        concurrently(spark, run, cells, at_once)
    finally:
        stored.unpersist()
