"""The tables behind the plots."""

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import reducers
from ..operators.sampling import subsample
from .sweeps import METHODS, cluster_models

METRICS = ["ari", "nmi", "purity", "silhouette", "distance_preservation"]


def _method_order(spark):
    rows = [(i, m) for i, m in enumerate(METHODS)]
    return F.broadcast(spark.createDataFrame(rows, "method_order int, method string"))


def metric_vs_k(results, metrics=METRICS):
    """dataset, model, metric, method, k, value: one series per method, ordered by k."""
    long = results.unpivot(["dataset", "model", "method", "k"], metrics, "metric", "value")
    keys = ["dataset", "model", "metric", "method_order", "k"]
    return long.join(_method_order(results.sparkSession), "method").orderBy(*keys).drop("method_order")


def runtime_vs_k(results):
    named = results.join(_method_order(results.sparkSession), "method")
    return named.orderBy("dataset", "model", "method_order", "k").select("dataset", "model", "method", "k", "total_time")


def runtime_breakdown(results):
    """Per dataset, model and k the methods in fixed order with stacked stage times.

    A method without both times is left out, and so is a group without any.
    """
    groups = results.select("dataset", "model", "k").distinct()
    grid = groups.withColumn("method", F.explode(F.array(*[F.lit(m) for m in METHODS])))
    times = results.select("dataset", "model", "k", "method", "reduction_time", "clustering_time")
    full = grid.join(times, ["dataset", "model", "k", "method"], "left").na.drop(
        subset=["reduction_time", "clustering_time"]
    )
    return (
        full.join(_method_order(results.sparkSession), "method")
        .withColumn("bar_top", F.col("reduction_time") + F.col("clustering_time"))
        .orderBy("dataset", "model", "k", "method_order")
        .drop("method_order")
    )


def cluster_gallery(df, clusters=10, members=8, cluster="cluster"):
    """The first clusters by number and the first members of each by id."""
    first = df.select(cluster).distinct().orderBy(cluster).limit(clusters)
    # At most `clusters` rows. The rank filter is applied inside every task before the shuffle.
    place = F.row_number().over(W.partitionBy(cluster).orderBy("id"))
    return (
        df.join(F.broadcast(first), cluster, "left_semi")
        .withColumn("place", place)
        .filter(F.col("place") <= members)
    )


def feature_sets(table, k, seed=42):
    """The original features and the four reductions: {method: df}."""
    k = min(k, table.input_dim)
    out = {"original": table.df}
    for name in METHODS:
        reducer = reducers.make_cluster_reducer(name, k, seed).setup(table)
        out[name] = reducer.fit(table.df).transform(table.df)
    return out


def cluster_labels(table, k, n_clusters, seed=42, **options):
    """(id, method, model, cluster) for every feature set and both models."""
    parts = []
    for method, df in feature_sets(table, k, seed).items():
        for name, model in cluster_models(n_clusters, seed, **options).items():
            clustered = model.fit(df).transform(df)
            parts.append(clustered.select("id", F.lit(method).alias("method"), F.lit(name).alias("model"), "cluster"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def label_grid(table, k, labels, max_points=1500, seed=42):
    """Two-dimensional coordinates of each feature set with true and cluster labels.

    Coordinates are the first two principal axes of a sample of at most `max_points` rows.
    """
    wide = labels.groupBy("id", "method").pivot("model", ["kmeans", "gmm"]).agg(F.first("cluster"))
    parts = []
    for method, df in feature_sets(table, k, seed).items():
        sample = subsample(df, max_points, seed)
        width = table.input_dim if method == "original" else min(k, table.input_dim)
        two = reducers.FullPCA(2, seed).setup(table.with_df(sample, input_dim=width)).fit(sample).transform(sample)
        parts.append(
            two.select(
                "id", "label", F.lit(method).alias("method"),
                F.get("features", F.lit(0)).alias("x"), F.get("features", F.lit(1)).alias("y"),
            )
        )
    points = reduce(lambda a, b: a.unionByName(b), parts)
    return points.join(wide, ["id", "method"])
