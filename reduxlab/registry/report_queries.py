"""Queries over files, records, sweeps and report tables."""

from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import reducers, sampling, scaling
from ..operators.layout import force_form
from ..plans import reports, sweeps
from ..plans.evaluate import evaluate
from ..session import scratch_path
from ..sources import loaders, records, text_matrix
from .data_queries import SEED, SPLIT_E, UNPACKED, E, r6
from .fixtures import dense_table, embeddings, long_form, patterned, table
from .reduction_queries import (
    EUCLID,
    SIX_SQL,
    cosine_ctes,
    gaussian_ctes,
    knn_ctes,
    scores_sql,
    sparse_ctes,
)


def text_matrix_join(spark, sf_dir):
    """Features and labels written as text over several files and matched again by line."""
    path = scratch_path(spark, "matrix")
    df = embeddings(spark, sf_dir).withColumn("label", F.col("label") + 1)
    text_matrix.write_matrix(df, f"{path}/x", 4)
    text_matrix.write_column(df, "label", f"{path}/y", 3)
    out = text_matrix.read_labelled_matrix(spark, f"{path}/x", f"{path}/y")
    return out.select("id", "label", F.posexplode("features").alias("pos", "value")).withColumn(
        "value", rounded(F.col("value"))
    )


def wide_sensor_csv(spark, sf_dir):
    """Text files of both sides -> one wide CSV with unique column names -> read back."""
    path = scratch_path(spark, "sensors")
    df = embeddings(spark, sf_dir).withColumn("subject", (F.col("id") % 30).cast("int"))
    for side, rows in (("train", df.filter("id % 4 <> 0")), ("test", df.filter("id % 4 = 0"))):
        text_matrix.write_matrix(rows, f"{path}/{side}/X_{side}.txt", 3)
        text_matrix.write_column(rows, "label", f"{path}/{side}/y_{side}.txt", 2)
        text_matrix.write_column(rows, "subject", f"{path}/{side}/subject_{side}.txt", 1)
    # The names of the 64 features repeat after ten.
    names = df.orderBy("id").limit(1).select(F.posexplode("features").alias("id", "x"))
    named = names.withColumn("line", F.concat(F.col("id") + 1, F.lit(" energy()-"), F.col("id") % 10))
    text_matrix.write_column(named, "line", f"{path}/features.txt", 1)
    wide = loaders.wide_sensor_table(spark, path)
    records.write_results(wide, f"{path}/csv")
    out = records.read_results(spark, f"{path}/csv", wide.schema)
    values = [c for c in out.columns if c.startswith("energy")]
    return out.unpivot(["split", "subject", "activity"], values, "name", "value").withColumn(
        "value", rounded(F.col("value"))
    )


def append_records(spark, sf_dir):
    """Failed records before complete ones: the columns meet by name."""
    events = table(spark, sf_dir, "events")
    failed = events.filter("event_type = 'error'").select("event_id", F.lit("failed").alias("status"), "props")
    complete = events.filter("event_type <> 'error'").select(
        F.round("value", 6).alias("accuracy"), "event_id", F.lit("ok").alias("status")
    )
    path = scratch_path(spark, "records")
    records.append_records(failed, path)
    records.append_records(complete, path)
    return records.read_records(spark, path).select("event_id", "status", "props", "accuracy")


def append_columns(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    old = events.filter("user_id % 2 = 0").select("event_id", "user_id")
    new = events.filter("user_id % 2 = 1").select("event_type", "event_id")
    return records.append_columns(old, new).withColumn("event_type", F.coalesce("event_type", F.lit("")))


def nested_json(spark, sf_dir):
    """Parameters and label lists of every order as JSON text."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set("l_linenumber")).alias("lines"), F.count("*").alias("n")
    )
    nested = lines.select("l_orderkey", "lines", F.struct("n", F.lit(SEED).alias("seed")).alias("params"))
    return records.nested_as_json(nested)


RESULT_SCHEMA = "dataset string, method string, model string, k int, " + ", ".join(
    f"{c} double" for c in [*reports.METRICS, "reduction_time", "clustering_time", "total_time"]
)


def _results(spark, sf_dir):
    """A results table grown from the order lines: one row per flag, ship mode, status and line."""
    lines = table(spark, sf_dir, "lineitem")
    method = F.element_at(F.array(*[F.lit(m) for m in sweeps.METHODS]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    model = F.when(F.col("l_linestatus") == "F", "gmm").otherwise("kmeans")
    return lines.groupBy(
        F.col("l_returnflag").alias("dataset"), method.alias("method"), model.alias("model"),
        (F.col("l_linenumber") * 50).alias("k"),
    ).agg(
        F.round(F.avg("l_discount"), 6).alias("ari"),
        F.round(F.avg("l_tax"), 6).alias("nmi"),
        F.round(F.max("l_discount"), 6).alias("purity"),
        F.round(F.min("l_tax"), 6).alias("silhouette"),
        F.round(F.avg("l_quantity"), 6).alias("distance_preservation"),
        F.when(F.col("k") != 350, F.round(F.sum("l_quantity"), 2)).alias("reduction_time"),
        F.round(F.sum("l_discount"), 2).alias("clustering_time"),
        F.round(F.sum("l_quantity") + F.sum("l_discount"), 2).alias("total_time"),
    )


def results_file(spark, sf_dir):
    path = scratch_path(spark, "results")
    records.write_results(_results(spark, sf_dir), path)
    return records.read_results(spark, path, RESULT_SCHEMA)


def metric_vs_k(spark, sf_dir):
    return reports.metric_vs_k(_results(spark, sf_dir))


def runtime_vs_k(spark, sf_dir):
    return reports.runtime_vs_k(_results(spark, sf_dir))


def runtime_breakdown(spark, sf_dir):
    return reports.runtime_breakdown(_results(spark, sf_dir)).withColumn("bar_top", F.round("bar_top", 2))


def feature_cache(spark, sf_dir):
    """Computed and written on the first call, read on the second."""
    path = scratch_path(spark, "features")
    df = embeddings(spark, sf_dir)

    def compute():
        reducer = reducers.make_reducer("dct", 4, SEED).setup(dense_table(df))
        return reducer.fit(df).transform(df)

    records.cached_features(spark, path, compute)
    again = records.cached_features(spark, path, lambda: compute().limit(0))
    return long_form(again).withColumn("value", rounded(F.col("value")))


def class_folders(spark, sf_dir):
    """Samples below class folders, written in two goes; the second skips what is there."""
    path = scratch_path(spark, "classes")
    df = embeddings(spark, sf_dir).drop("features")
    records.write_by_class(df.filter("id % 3 = 0"), loaders.FASHION_LABELS, path)
    records.write_by_class(df, loaders.FASHION_LABELS, path)
    return spark.read.parquet(path).select("id", "label", "sample", "label_name")


def cluster_gallery(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    df = events.select(F.col("event_id").alias("id"), (F.col("user_id") % 23).alias("cluster"), "event_type")
    return reports.cluster_gallery(df)


def _patterned_table(spark, sf_dir):
    return dense_table(patterned(embeddings(spark, sf_dir)))


def cluster_labels(spark, sf_dir):
    """Per feature set, model and cluster: its size and the labels it holds."""
    data = _patterned_table(spark, sf_dir)
    found = reports.cluster_labels(data, 16, 10, SEED)
    return (
        found.join(data.df.select("id", "label"), "id")
        .groupBy("method", "model", "cluster")
        .agg(F.min("label").alias("lowest"), F.max("label").alias("highest"), F.count("*").alias("n"))
        .drop("cluster")
    )


def label_grid(spark, sf_dir):
    data = _patterned_table(spark, sf_dir)
    few = {"kmeans": {"n_init": 2, "max_iter": 20}, "gmm": {"n_init": 1, "max_iter": 20}}
    labels = reports.cluster_labels(data, 16, 10, SEED, **few)
    return reports.label_grid(data, 16, labels, 1500, SEED)


def clustering_sweep(spark, sf_dir):
    """The clustering sweep without its times; 128 exceeds the data and is skipped."""
    out = sweeps.clustering_sweep(
        spark, [_patterned_table(spark, sf_dir)], (16, 128), 10_000, SEED, ["rp", "srp", "dct"], at_once=4
    )
    scores = ["ari", "nmi", "purity", "silhouette", "distance_preservation"]
    return out.select("dataset", "method", "model", "k", *[F.round(c, 6).alias(c) for c in scores])


def clustering_times(spark, sf_dir):
    """The whole record of the sweep for principal components."""
    return sweeps.clustering_sweep(spark, [_patterned_table(spark, sf_dir)], (16,), 10_000, SEED, ["pca"])


def _prepared(spark, sf_dir):
    split = sampling.split_table(embeddings(spark, sf_dir), test_size=0.2, seed=SEED)
    scaled = scaling.fit_standardizer(split.filter("split = 'train'")).transform(split)
    return dense_table(scaled)


def classification_sweep(spark, sf_dir):
    """Scores of the neighbour classifier over three reducers and two dimensions."""
    out = sweeps.classification_sweep(
        spark,
        lambda name, seed: _prepared(spark, sf_dir),
        ["embeddings"],
        reducers=("identity", "gaussian_rp", "sparse_rp", "dct"),
        models=("knn",),
        dims=(8, 16, 128),
        seed=SEED,
        at_once=4,
    )
    kept = ["run_id", "seed", "dataset", "model", "reducer", "requested_dim", "input_dim", "n_train", "n_test", "status", "output_dim"]
    six = ["accuracy", "balanced_accuracy", "macro_f1", "weighted_f1", "macro_precision", "macro_recall"]
    return out.select(*kept, *[F.round(c, 6).alias(c) for c in six])


def model_sweep(spark, sf_dir):
    """All four classifiers on a planted signal, after two reductions."""
    split = sampling.split_table(patterned(embeddings(spark, sf_dir)), test_size=0.2, seed=SEED)
    out = sweeps.classification_sweep(
        spark,
        lambda name, seed: dense_table(split),
        ["embeddings"],
        reducers=("pca_svd", "randomized_svd"),
        models=("knn", "svm", "svm_sgd", "dnn"),
        dims=(16,),
        seed=SEED,
        at_once=2,
        svm_scale_dense=True,
        dnn_batch_size=32,
        dnn_lr=1e-2,
    )
    return out.select("reducer", "model", "requested_dim", "status", "n_train", "n_test", F.round("accuracy", 6).alias("accuracy"))


PEAKS = [
    "reduction_fit_peak_py_mb", "reduction_train_transform_peak_py_mb", "reduction_test_transform_peak_py_mb",
    "model_fit_peak_py_mb", "model_predict_peak_py_mb",
]


def cell_measures(spark, sf_dir):
    """Whether times and peaks of every stage are within bounds, and those of worker stages above an empty process."""
    records = sweeps.classification_sweep(
        spark, lambda name, seed: _prepared(spark, sf_dir), ["embeddings"], ("sparse_rp", "pca_svd"), ("knn", "svm"), (8, 16), seed=SEED
    )
    times = [c for c in records.columns if c.endswith("_time_sec")]
    inside = [F.col(c).between(0, 600) for c in times] + [F.col(c).between(0, 32_000) for c in PEAKS]
    worked = [F.col(c) > 20 for c in PEAKS[1:3] + PEAKS[4:]]
    return records.select(
        "reducer", "model", "requested_dim", reduce(and_, inside).alias("within_bounds"), reduce(and_, worked).alias("workers_seen")
    )


def failed_cells(spark, sf_dir):
    """Full PCA refuses a sparse table: the cell is recorded as failed and the rest goes on."""
    forced = force_form(_prepared(spark, sf_dir), "sparse")
    found = []
    for name in ("pca_svd", "sparse_rp"):
        found += evaluate(forced, name, 8, ["knn"], seed=SEED)
    return sweeps.records_frame(spark, found).select(
        "reducer", "status", "error_type", "n_train", "n_test", F.round("accuracy", 6).alias("accuracy")
    )


QUERIES = {
    f.__name__: f
    for f in (
        text_matrix_join, wide_sensor_csv, append_records, append_columns, nested_json, results_file, metric_vs_k, runtime_vs_k,
        runtime_breakdown, feature_cache, class_folders, cluster_gallery, cluster_labels, label_grid,
        clustering_sweep, clustering_times, classification_sweep, model_sweep, cell_measures, failed_cells,
    )
}


# --- the same results in SQL -------------------------------------------------------------------

_METHOD_LIST = "['pca', 'rp', 'srp', 'dct']"
_RESULTS = f"""results AS (SELECT l_returnflag AS dataset, {_METHOD_LIST}[l_suppkey % 4 + 1] AS method,
        CASE WHEN l_linestatus = 'F' THEN 'gmm' ELSE 'kmeans' END AS model, (l_linenumber * 50)::INTEGER AS k,
        round(avg(l_discount), 6) AS ari, round(avg(l_tax), 6) AS nmi, round(max(l_discount), 6) AS purity,
        round(min(l_tax), 6) AS silhouette, round(avg(l_quantity), 6) AS distance_preservation,
        CASE WHEN l_linenumber <> 7 THEN round(sum(l_quantity), 2) END AS reduction_time,
        round(sum(l_discount), 2) AS clustering_time, round(sum(l_quantity) + sum(l_discount), 2) AS total_time
    FROM lineitem GROUP BY 1, 2, 3, l_linenumber)"""


def _sweep_cell(reducer, dim, width, features):
    """One record of the neighbour classifier on a list-valued CTE."""
    return f"""SELECT 0 AS run_id, {SEED} AS seed, 'embeddings' AS dataset, 'knn' AS model, '{reducer}' AS reducer,
            '{dim}' AS requested_dim, 64 AS input_dim, (SELECT count(*) FROM parts WHERE split = 'train') AS n_train,
            (SELECT count(*) FROM parts WHERE split = 'test') AS n_test, 'ok' AS status, {width} AS output_dim, s.*
        FROM (WITH tr AS (SELECT id, label, features FROM {features} JOIN parts USING (id) WHERE split = 'train'),
            te AS (SELECT id, label, features FROM {features} JOIN parts USING (id) WHERE split = 'test'),
            {knn_ctes('te', 'tr', EUCLID)}, g AS (SELECT te.label, prediction FROM te JOIN voted USING (id)),
            {scores_sql('g')} SELECT {SIX_SQL}) s"""


_SCALED = """s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS sd FROM u JOIN parts USING (id) WHERE split = 'train' GROUP BY pos),
        scaled AS (SELECT id, pos, (x - m) / sd AS x FROM u JOIN s USING (pos))"""


def _sweep_sql():
    ctes, cells = [], []
    for name, weights in (("gaussian_rp", gaussian_ctes), ("sparse_rp", sparse_ctes), ("dct", cosine_ctes)):
        for k in (8, 16):
            tag = f"{name}_{k}"
            text = weights(64, k)
            for word in ("digest", "draw", "weight"):
                text = text.replace(word, f"{word}_{tag}")
            ctes.append(
                f"{text}, z_{tag} AS (SELECT id, list(v ORDER BY j) AS features FROM (SELECT id, j, sum(x * w) AS v "
                f"FROM scaled JOIN weight_{tag} ON pos = i GROUP BY id, j) GROUP BY id)"
            )
            cells.append(_sweep_cell(name, k, k, f"z_{tag}"))
    cells.append(_sweep_cell("identity", "original", 64, "z_identity"))
    whole = "z_identity AS (SELECT id, list(x ORDER BY pos) AS features FROM scaled GROUP BY id)"
    return f"WITH {E}, {UNPACKED}, {SPLIT_E}, {_SCALED}, {', '.join(ctes)}, {whole} " + " UNION ALL ".join(cells)


def _clustering_sql():
    """Scores when every cluster is a class, on features reduced after standardising."""
    ctes, rows = [], []
    for name, weights in (("rp", gaussian_ctes), ("srp", sparse_ctes), ("dct", cosine_ctes)):
        text = weights(64, 16)
        for word in ("digest", "draw", "weight"):
            text = text.replace(word, f"{word}_{name}")
        ctes.append(
            f"""{text}, z_{name} AS (SELECT id, list(v ORDER BY j) AS f FROM (SELECT id, j, sum(x * w) AS v
                FROM scaled JOIN weight_{name} ON pos = i GROUP BY id, j) GROUP BY id),
            d_{name} AS (SELECT a.id, e.label AS own, o.label AS other, count(*) AS n, sum(list_distance(a.f, b.f)) AS total
                FROM z_{name} a JOIN e ON e.id = a.id, z_{name} b JOIN e o ON o.id = b.id GROUP BY ALL),
            w_{name} AS (SELECT id, max(total / (n - 1)) FILTER (own = other) AS a, min(total / n) FILTER (own <> other) AS b
                FROM d_{name} GROUP BY id),
            drawn_{name} AS (SELECT id, a.f AS f0, z.f AS f1 FROM z_identity a JOIN z_{name} z USING (id)
                ORDER BY md5(concat('{SEED}:', id)), id LIMIT 1000)"""
        )
        rows += [
            f"""SELECT 'embeddings' AS dataset, '{name}' AS method, '{model}' AS model, 16 AS k, 1.0::DOUBLE AS ari,
                1.0::DOUBLE AS nmi, 1.0::DOUBLE AS purity, (SELECT round(avg((b - a) / greatest(a, b)), 6) FROM w_{name}) AS silhouette,
                (SELECT round(corr(list_distance(a.f0, b.f0), list_distance(a.f1, b.f1)), 6)
                    FROM drawn_{name} a JOIN drawn_{name} b ON a.id < b.id) AS distance_preservation"""
            for model in ("kmeans", "gmm")
        ]
    return f"""WITH {E}, u AS (SELECT id, pos, x + label * (pos // 8 + 1) % 11 - 5 AS x FROM
            (SELECT id, label, unnest(features) AS x, generate_subscripts(features, 1) - 1 AS pos FROM e)),
        s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS sd FROM u GROUP BY pos),
        scaled AS (SELECT id, pos, (x - m) / sd AS x FROM u JOIN s USING (pos)),
        z_identity AS (SELECT id, list(x ORDER BY pos) AS f FROM scaled GROUP BY id), {', '.join(ctes)} {' UNION ALL '.join(rows)}"""


ORACLES = {
    "cell_measures": """SELECT reducer, model, k AS requested_dim, true AS within_bounds, true AS workers_seen
        FROM (SELECT unnest(['sparse_rp', 'pca_svd']) AS reducer), (SELECT unnest(['knn', 'svm']) AS model),
            (SELECT unnest(['8', '16']) AS k) WHERE (SELECT count(*) FROM embeddings) > 0""",
    "cluster_labels": """SELECT method, model, label AS lowest, label AS highest, count(*) AS n FROM embeddings,
        (SELECT unnest(['original', 'pca', 'rp', 'srp', 'dct']) AS method), (SELECT unnest(['kmeans', 'gmm']) AS model) GROUP BY ALL""",
    "clustering_sweep": _clustering_sql(),
    "model_sweep": f"""WITH {E}, {SPLIT_E} SELECT reducer, model, '16' AS requested_dim, 'ok' AS status,
        count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test, 1.0::DOUBLE AS accuracy
        FROM parts, (SELECT unnest(['pca_svd', 'randomized_svd']) AS reducer),
            (SELECT unnest(['knn', 'svm', 'svm_sgd', 'dnn']) AS model) GROUP BY ALL""",
    "text_matrix_join": f"WITH {E}, {UNPACKED} SELECT id, label, pos::INTEGER AS pos, {r6('x')} AS value FROM u",
    "wide_sensor_csv": f"""WITH {E}, {UNPACKED}
        SELECT CASE WHEN id % 4 = 0 THEN 'test' ELSE 'train' END AS split, (id % 30)::INTEGER AS subject, label AS activity,
            concat('energy()-', pos % 10, CASE WHEN pos >= 10 THEN concat('_', pos // 10 + 1) ELSE '' END) AS name, {r6('x')} AS value
        FROM u""",
    "append_records": """SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status,
        CASE WHEN event_type = 'error' THEN props END AS props, CASE WHEN event_type <> 'error' THEN round(value, 6) END AS accuracy FROM events""",
    "append_columns": """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN user_id END AS user_id,
        CASE WHEN user_id % 2 = 1 THEN event_type ELSE '' END AS event_type FROM events""",
    "nested_json": f"""SELECT l_orderkey, '[' || string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) || ']' AS lines,
        concat('{{"n":', count(*), ',"seed":{SEED}}}') AS params FROM lineitem GROUP BY l_orderkey""",
    "results_file": f"WITH {_RESULTS} SELECT * FROM results",
    "metric_vs_k": f"""WITH {_RESULTS}
        UNPIVOT (SELECT dataset, model, method, k, ari, nmi, purity, silhouette, distance_preservation FROM results)
        ON ari, nmi, purity, silhouette, distance_preservation INTO NAME metric VALUE value""",
    "runtime_vs_k": f"WITH {_RESULTS} SELECT dataset, model, method, k, total_time FROM results",
    "runtime_breakdown": f"""WITH {_RESULTS} SELECT dataset, model, k, method, reduction_time, clustering_time,
        round(reduction_time + clustering_time, 2) AS bar_top FROM results WHERE reduction_time IS NOT NULL""",
    "feature_cache": f"""WITH {E}, {UNPACKED}, {cosine_ctes(64, 4)}
        SELECT id, j::INTEGER AS pos, {r6('sum(x * w)')} AS value FROM u JOIN weight ON pos = i GROUP BY id, j""",
    "class_folders": f"""SELECT vec_id AS id, label, CASE WHEN length(vec_id::VARCHAR) >= 5 THEN vec_id::VARCHAR ELSE lpad(vec_id::VARCHAR, 5, '0') END AS sample,
        {loaders.FASHION_LABELS!r}[label + 1] AS label_name FROM embeddings""",
    "cluster_gallery": """WITH c AS (SELECT event_id AS id, user_id % 23 AS cluster, event_type FROM events),
        r AS (SELECT *, dense_rank() OVER (ORDER BY cluster) AS d, row_number() OVER (PARTITION BY cluster ORDER BY id) AS place FROM c)
        SELECT id, cluster, event_type, place FROM r WHERE d <= 10 AND place <= 8""",
    "classification_sweep": _sweep_sql(),
    "failed_cells": f"""WITH cells AS ({_sweep_sql()})
        SELECT 'pca_svd' AS reducer, 'failed' AS status, 'ReductionError' AS error_type, n_train, n_test, NULL::DOUBLE AS accuracy
        FROM cells WHERE reducer = 'identity'
        UNION ALL SELECT reducer, 'ok', NULL, n_train, n_test, accuracy FROM cells WHERE reducer = 'sparse_rp' AND output_dim = 8""",
}
