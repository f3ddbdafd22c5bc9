"""Queries over reducers, neighbours, scores and pair geometry."""

import numpy as np
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import geometry, layout, neighbours, reducers, sampling, scaling, scores, spectral
from ..sources.tables import vector_width
from .data_queries import SEED, SPLIT_E, THIN, UNPACKED, E, r6
from .fixtures import dense_table, embeddings, line_features, long_form, planted, tapered, thinned

K = 16


def _reduced(df, name, k=K, sparse=False, image_shape=None, maker=reducers.make_reducer, **options):
    table = dense_table(df, image_shape=image_shape)
    if sparse:
        table = layout.force_form(table, "sparse")
    reducer = maker(name, k, SEED, **options).setup(table)
    return reducer.fit(table.df).transform(table.df)


def _values(df):
    return long_form(df).withColumn("value", rounded(F.col("value")))


def identity(spark, sf_dir):
    return _values(_reduced(embeddings(spark, sf_dir), "identity"))


def gaussian_rp(spark, sf_dir):
    return _values(_reduced(embeddings(spark, sf_dir), "gaussian_rp"))


def sparse_rp(spark, sf_dir):
    return _values(_reduced(embeddings(spark, sf_dir), "sparse_rp"))


def sparse_rp_on_sparse(spark, sf_dir):
    out = _reduced(thinned(embeddings(spark, sf_dir)), "sparse_rp", sparse=True)
    return out.select("id", F.explode(F.arrays_zip("idx", "val")).alias("e")).select(
        "id", F.col("e.idx").alias("pos"), rounded(F.col("e.val")).alias("value")
    )


def dct_1d(spark, sf_dir):
    return _values(_reduced(embeddings(spark, sf_dir), "dct"))


def dct_2d(spark, sf_dir):
    return _values(_reduced(embeddings(spark, sf_dir), "dct", image_shape=(8, 8)))


def dct_2d_channels(spark, sf_dir):
    return _values(_reduced(embeddings(spark, sf_dir), "dct", image_shape=(4, 4, 4)))


def feasible_dims(spark, sf_dir):
    """The sweep's parameter table without the dimensions the data does not have."""
    width, dims = vector_width(embeddings(spark, sf_dir)), (16, 32, 64, 128)
    kept = reducers.feasible_dims(dims, width)
    rows = [(width, k, min(k, width), k not in kept) for k in dims]
    return spark.createDataFrame(rows, "input_dim int, k int, clamped int, skipped boolean")


def pca_covariance(spark, sf_dir):
    return spectral.covariance_table(embeddings(spark, sf_dir), 64).withColumn("cov", rounded(F.col("cov"), 9))


def pca_lines(spark, sf_dir):
    """Order lines on their first principal axis, summed by return flag."""
    lines = line_features(spark, sf_dir)
    table = dense_table(lines, name="lines", n_classes=3, width=4)
    reducer = reducers.make_reducer("pca_svd", 1, SEED).setup(table).fit(lines)
    score = F.get("features", F.lit(0))
    return (
        reducer.transform(lines)
        .groupBy("label")
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg(score), 3).alias("mean_score"),
            F.round(F.stddev_pop(score), 3).alias("std_score"),
        )
    )


def svd_lines(spark, sf_dir):
    """The same without centring, by the randomised solver."""
    lines = line_features(spark, sf_dir)
    table = dense_table(lines, name="lines", n_classes=3, width=4)
    reducer = reducers.make_reducer("randomized_svd", 1, SEED).setup(table).fit(lines)
    score = F.get("features", F.lit(0))
    return (
        reducer.transform(lines)
        .groupBy("label")
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg(score), 3).alias("mean_score"),
            F.round(F.stddev_pop(score), 3).alias("std_score"),
        )
    )


def svd_power_step(spark, sf_dir):
    basis = np.eye(64)[:, :4] + np.eye(64, k=-1)[:, :4]
    return spectral.power_step_table(embeddings(spark, sf_dir), basis).withColumn("value", rounded(F.col("value")))


def svd_power_step_sparse(spark, sf_dir):
    basis = np.eye(64)[:, :4] + np.eye(64, k=-1)[:, :4]
    sparse = layout.to_sparse(thinned(embeddings(spark, sf_dir)))
    return spectral.power_step_table(sparse, basis, sparse=True).withColumn("value", rounded(F.col("value")))


def _axis_scores(df):
    return long_form(df).withColumn("value", rounded(F.col("value"), 5))


def pca_full(spark, sf_dir):
    return _axis_scores(_reduced(tapered(embeddings(spark, sf_dir)), "pca_svd", 3))


def pca_randomized(spark, sf_dir):
    out = _reduced(tapered(embeddings(spark, sf_dir)), "pca", 3, maker=reducers.make_cluster_reducer)
    return _axis_scores(out)


def truncated_svd(spark, sf_dir):
    """Uncentred axes of a sparse table."""
    return _axis_scores(_reduced(tapered(thinned(embeddings(spark, sf_dir))), "randomized_svd", 3, sparse=True))


def _split(spark, sf_dir):
    return sampling.split_table(embeddings(spark, sf_dir), test_size=0.2, seed=SEED)


def _predictions(split, k=5, metric="auto"):
    train = split.filter("split = 'train'").drop("split")
    test = split.filter("split = 'test'").drop("split")
    model = neighbours.NearestNeighbours(k, metric).fit(train)
    return model.predict(test)


def knn_predict(spark, sf_dir):
    return _predictions(_split(spark, sf_dir)).select("id", "label", "prediction")


def knn_cosine(spark, sf_dir):
    return _predictions(planted(_split(spark, sf_dir), 0.2), metric="cosine").select("id", "label", "prediction")


def knn_manhattan(spark, sf_dir):
    return _predictions(_split(spark, sf_dir), k=3, metric="manhattan").select("id", "label", "prediction")


def knn_graph(spark, sf_dir):
    edges = neighbours.neighbour_graph(embeddings(spark, sf_dir), 15)
    return edges.select("src", "dst", F.round("dist", 6).alias("dist"), "rank")


def knn_graph_cells(spark, sf_dir):
    """The same by cells around pivots, as for two sides too large to broadcast."""
    edges = neighbours.neighbour_graph(embeddings(spark, sf_dir), 15, small_bytes=0, block_bytes=64 << 10)
    return edges.select("src", "dst", F.round("dist", 6).alias("dist"), "rank")


def knn_graph_blocks(spark, sf_dir):
    """The graph by cosine distance, whose large sides meet in hash blocks."""
    edges = neighbours.neighbour_graph(embeddings(spark, sf_dir), 15, "cosine", small_bytes=0, block_bytes=64 << 10)
    return edges.select("src", "dst", F.round("dist", 6).alias("dist"), "rank")


def flagship(spark, sf_dir):
    """Split, standardise on train, project to 16 dimensions, 5 nearest neighbours, scores."""
    split = _split(spark, sf_dir)
    scaled = scaling.fit_standardizer(split.filter("split = 'train'")).transform(split)
    return _six(scores.classification_scores(_predictions(_reduced(scaled, "sparse_rp"))))


def _six(df):
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


def _guessed(spark, sf_dir):
    """Labels with a prediction that differs: class 3 is never guessed, class 11 never true."""
    guess = (
        F.when(F.col("id") % 7 == 0, F.col("label") + 1)
        .when(F.col("label") == 3, F.lit(11))
        .when(F.col("id") % 11 == 0, F.lit(0))
        .otherwise(F.col("label"))
    )
    return embeddings(spark, sf_dir).select("id", "label", guess.alias("prediction"))


def classification_metrics(spark, sf_dir):
    return _six(scores.classification_scores(_guessed(spark, sf_dir)))


def per_class_metrics(spark, sf_dir):
    table = scores.per_class(scores.confusion(_guessed(spark, sf_dir)))
    return table.select(
        "cls", "support", "predicted", "hit", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    )


def clustering_metrics(spark, sf_dir):
    df = _guessed(spark, sf_dir).withColumn("cluster", F.col("prediction") % 4)
    return _six(scores.clustering_agreement(df))


def clustering_metrics_events(spark, sf_dir):
    """Agreement of event types with user groups over the whole event table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    df = events.select("event_type", (F.col("user_id") % 8).alias("cluster"))
    return _six(scores.clustering_agreement(df, "event_type"))


def contingency(spark, sf_dir):
    df = _guessed(spark, sf_dir).withColumn("cluster", F.col("prediction") % 4)
    return scores.contingency(df, classes=list(range(10)))


def silhouette(spark, sf_dir):
    df = planted(embeddings(spark, sf_dir), 1.0).withColumn(
        "cluster", F.when(F.col("id") == 3, -1).otherwise(F.col("label"))
    )
    return geometry.silhouette(df, seed=SEED).select(F.round("silhouette", 6).alias("silhouette"))


def _methods(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    return df, {name: _reduced(df, name) for name in ("gaussian_rp", "sparse_rp", "dct")}


def distance_preservation(spark, sf_dir):
    kept = geometry.distance_preservation(*_methods(spark, sf_dir), seed=SEED)
    return kept.select("method", F.round("distance_preservation", 6).alias("distance_preservation"))


def distortion_histogram(spark, sf_dir):
    return geometry.distance_distortion(*_methods(spark, sf_dir), seed=SEED).select(
        "method", "bin", F.round("bin_start", 6).alias("bin_start"), F.round("bin_end", 6).alias("bin_end"), "n"
    )


QUERIES = {
    f.__name__: f
    for f in (
        flagship, identity, gaussian_rp, sparse_rp, sparse_rp_on_sparse, dct_1d, dct_2d, dct_2d_channels,
        feasible_dims, pca_covariance, pca_lines, svd_lines, svd_power_step, svd_power_step_sparse, pca_full,
        pca_randomized, truncated_svd, knn_predict, knn_cosine, knn_manhattan, knn_graph, knn_graph_cells, knn_graph_blocks,
        classification_metrics,
        per_class_metrics, clustering_metrics, clustering_metrics_events, contingency, silhouette,
        distance_preservation, distortion_histogram,
    )
}


# --- the same results in SQL -------------------------------------------------------------------


def draws(kind, d=64, k=K, seed=SEED):
    """CTE `draw(i, j, u)`: four 32-bit numbers from every digest."""
    return f"""digest AS (SELECT i, b, md5(concat('{kind}:{seed}:', i, ':', b)) AS h
            FROM range({d}) AS a(i), range({-(-k // 4)}) AS c(b)),
        draw AS (SELECT i, b * 4 + lane AS j, (('0x' || substr(h, (lane * 8 + 1)::INTEGER, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u
            FROM digest, range(4) AS l(lane))"""


def gaussian_ctes(d=64, k=K):
    return f"""{draws('grp', d, k)},
        weight AS (SELECT a.i, a.j, sqrt(-2 * ln(a.u)) * cos(2 * pi() * b.u) / sqrt({k}::DOUBLE) AS w
                FROM draw a JOIN draw b ON a.i = b.i AND b.j = a.j + 1 WHERE a.j % 2 = 0 AND a.j < {k}
            UNION ALL SELECT b.i, b.j, sqrt(-2 * ln(a.u)) * sin(2 * pi() * b.u) / sqrt({k}::DOUBLE)
                FROM draw a JOIN draw b ON a.i = b.i AND b.j = a.j + 1 WHERE a.j % 2 = 0 AND b.j < {k})"""


def sparse_ctes(d=64, k=K):
    s = f"(1 / sqrt({d}::DOUBLE))"
    return f"""{draws('srp', d, k)},
        weight AS (SELECT i, j, CASE WHEN u < {s} / 2 THEN 1 WHEN u < {s} THEN -1 ELSE 0 END * sqrt(1 / ({s} * {k})) AS w
                FROM draw WHERE j < {k})"""


def cosine_ctes(n=64, k=K):
    return f"""weight AS (SELECT i, j, cos(pi() * (2 * i + 1) * j / {2 * n}.0::DOUBLE)
                * CASE WHEN j = 0 THEN sqrt(1 / {n}.0::DOUBLE) ELSE sqrt(2 / {n}.0::DOUBLE) END AS w
            FROM range({n}) AS a(i), range({k}) AS b(j))"""


def image_ctes(side, channels, k=K):
    n = f"{side}.0::DOUBLE"
    return f"""chosen AS (SELECT r, c, ch, row_number() OVER (ORDER BY r + c, r, ch) - 1 AS j
                FROM range({side}) AS a(r), range({side}) AS b(c), range({channels}) AS d(ch) QUALIFY j < {k}),
        weight AS (SELECT (y * {side} + x) * {channels} + ch AS i, j,
                cos(pi() * (2 * y + 1) * r / (2 * {n})) * CASE WHEN r = 0 THEN sqrt(1 / {n}) ELSE sqrt(2 / {n}) END
                * cos(pi() * (2 * x + 1) * c / (2 * {n})) * CASE WHEN c = 0 THEN sqrt(1 / {n}) ELSE sqrt(2 / {n}) END AS w
            FROM chosen, range({side}) AS a(y), range({side}) AS b(x))"""


def projected(weights, source="u"):
    """CTE `z(id, pos, value)`."""
    return f"{weights}, z AS (SELECT id, j AS pos, sum(x * w) AS value FROM {source} JOIN weight ON pos = i GROUP BY id, j)"


def _z_sql(weights, source="u", unpacked=UNPACKED, where=""):
    return f"WITH {E}, {unpacked}, {projected(weights, source)} SELECT id, pos::INTEGER AS pos, {r6('value')} AS value FROM z{where}"


def scores_sql(source):
    """The six scores from rows (label, prediction)."""
    return f"""seen AS (SELECT label AS cls FROM {source} UNION SELECT prediction FROM {source}),
        pc AS (SELECT cls, (SELECT count(*) FROM {source} WHERE label = cls) AS support,
                   (SELECT count(*) FROM {source} WHERE prediction = cls) AS predicted,
                   (SELECT count(*) FROM {source} WHERE prediction = cls AND label = cls) AS hit FROM seen),
        rates AS (SELECT *, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS precision,
                   CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall,
                   2 * hit / (support + predicted) AS f1 FROM pc)"""


SIX_SQL = """round(sum(hit) / sum(support), 6) AS accuracy, round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy,
        round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
        round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall FROM rates"""


def knn_ctes(test, train, distance, k=5):
    """CTE `voted(id, prediction)` over two CTEs (id, label, features)."""
    return f"""near AS (SELECT q.id, b.label, row_number() OVER (PARTITION BY q.id ORDER BY {distance}, b.id) AS place
                FROM {test} q, {train} b),
        votes AS (SELECT id, label, count(*) AS n FROM near WHERE place <= {k} GROUP BY id, label),
        voted AS (SELECT id, label AS prediction FROM votes
                QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1)"""


def _knn_sql(distance, k=5, features="features"):
    return f"""WITH {E}, {SPLIT_E},
        tr AS (SELECT id, e.label, {features} AS features FROM e JOIN parts USING (id) WHERE split = 'train'),
        te AS (SELECT id, e.label, {features} AS features FROM e JOIN parts USING (id) WHERE split = 'test'),
        {knn_ctes('te', 'tr', distance, k)}
        SELECT id, te.label, prediction FROM te JOIN voted USING (id)"""


EUCLID = "list_distance(q.features, b.features)"

GUESSED = """g AS (SELECT vec_id AS id, label, CASE WHEN vec_id % 7 = 0 THEN label + 1 WHEN label = 3 THEN 11
        WHEN vec_id % 11 = 0 THEN 0 ELSE label END AS prediction FROM embeddings)"""


def agreement_sql(source):
    """ARI, NMI and purity from rows (y, p)."""
    return f"""cells AS (SELECT y, p, count(*)::DOUBLE AS n FROM {source} GROUP BY y, p),
        ys AS (SELECT y, sum(n) AS n FROM cells GROUP BY y), ps AS (SELECT p, sum(n) AS n FROM cells GROUP BY p),
        s AS (SELECT (SELECT sum(n) FROM cells) AS t, (SELECT sum(n * (n - 1) / 2) FROM cells) AS c,
                (SELECT sum(n * (n - 1) / 2) FROM ys) AS a, (SELECT sum(n * (n - 1) / 2) FROM ps) AS b,
                (SELECT sum(-n / t.t * ln(n / t.t)) FROM ys, (SELECT sum(n) AS t FROM cells) t) AS hy,
                (SELECT sum(-n / t.t * ln(n / t.t)) FROM ps, (SELECT sum(n) AS t FROM cells) t) AS hp,
                (SELECT sum(cells.n / t.t * ln(cells.n * t.t / (ys.n * ps.n))) FROM cells JOIN ys USING (y) JOIN ps USING (p),
                    (SELECT sum(n) AS t FROM cells) t) AS mi,
                (SELECT sum(m) FROM (SELECT max(n) AS m FROM cells GROUP BY p)) AS major)
        SELECT round((c - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2)), 6) AS ari,
            round(mi / ((hy + hp) / 2), 6) AS nmi, round(major / t, 6) AS purity FROM s"""


def _methods_sql(size):
    parts = []
    for name, weights in (("gaussian_rp", gaussian_ctes()), ("sparse_rp", sparse_ctes()), ("dct", cosine_ctes())):
        renamed = weights.replace("digest", f"digest_{name}").replace("draw", f"draw_{name}").replace("weight", f"weight_{name}")
        parts.append(
            f"{renamed}, z_{name} AS (SELECT id, list(value ORDER BY j) AS v FROM (SELECT id, j, sum(x * w) AS value "
            f"FROM u JOIN weight_{name} ON pos = i GROUP BY id, j) GROUP BY id)"
        )
    return f"""WITH {E}, {UNPACKED}, {', '.join(parts)},
        m AS (SELECT id, features, a.v AS v1, b.v AS v2, c.v AS v3 FROM e JOIN z_gaussian_rp a USING (id)
                JOIN z_sparse_rp b USING (id) JOIN z_dct c USING (id)
                ORDER BY md5(concat('{SEED}:', id)), id LIMIT {size}),
        pairs AS (SELECT list_distance(a.features, b.features) AS d0, list_distance(a.v1, b.v1) AS d1,
                list_distance(a.v2, b.v2) AS d2, list_distance(a.v3, b.v3) AS d3 FROM m a JOIN m b ON a.id < b.id)"""


def _axis_sql(centred):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    shift = {c: (f"(SELECT avg({c}) FROM lineitem)" if centred else "0") for c in cols}
    x = ", ".join(f"{c} - {shift[c]} AS x{i}" for i, c in enumerate(cols))
    moments = ", ".join(f"sum(x{i} * x{j}) AS c{i}{j}" for i in range(4) for j in range(4))
    products = ", ".join(f"{' + '.join(f'c{i}{j} * v{j}' for j in range(4))} AS y{i}" for i in range(4))
    norm = "sqrt(" + " + ".join(f"y{i} * y{i}" for i in range(4)) + ")"
    scaled = ", ".join(f"y{i} / {norm} AS v{i}" for i in range(4))
    score = " + ".join(f"x{i} * v{i}" for i in range(4))
    return f"""WITH RECURSIVE x AS (SELECT {x}, l_returnflag FROM lineitem), c AS (SELECT {moments} FROM x),
        power AS (SELECT 0 AS step, 0.5::DOUBLE AS v0, 0.5::DOUBLE AS v1, 0.5::DOUBLE AS v2, 0.5::DOUBLE AS v3
            UNION ALL SELECT step + 1, {', '.join(f'v{i}' for i in range(4))}
            FROM (SELECT step, {scaled} FROM (SELECT step, {products} FROM power, c WHERE step < 40))),
        axis AS (SELECT * FROM power WHERE step = 40)
        SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label, count(*) AS n,
            round(avg({score}), 3) AS mean_score, round(stddev_pop({score}), 3) AS std_score
        FROM x, axis GROUP BY l_returnflag"""


def _power_sql(source, unpacked):
    return f"""WITH {E}, {unpacked}, b AS (SELECT j, i FROM range(4) AS a(j), range(64) AS c(i) WHERE i = j OR i = j + 1),
        q AS (SELECT id, j, sum(x) AS y FROM {source} JOIN b ON pos = i GROUP BY id, j)
        SELECT pos::INTEGER AS i, j::INTEGER AS j, {r6('sum(x * y)')} AS value FROM {source} JOIN q USING (id) GROUP BY pos, j"""


def _axes_sql(source, unpacked, centred):
    """Scores on the three leading axes: power iteration, each axis removed before the next."""
    mean = "avg(x)" if centred else "0.0"
    ctes = [
        f"""x AS (SELECT id, pos, x * power(0.8::DOUBLE, pos) AS x FROM {source}),
        s AS (SELECT pos, {mean} AS m FROM x GROUP BY pos), c AS (SELECT id, pos, x - m AS x FROM x JOIN s USING (pos)),
        cov AS (SELECT a.pos AS i, b.pos AS j, sum(a.x * b.x) AS v FROM c a JOIN c b USING (id) GROUP BY i, j),
        m0 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM cov GROUP BY i))"""
    ]
    scores = []
    for n in range(3):
        ctes.append(
            f"""p{n} AS (SELECT 0 AS step, list_transform(range(64), lambda i: 1.0::DOUBLE / (i + 1 + {n})) AS v
            UNION ALL SELECT step + 1, list_transform(y, lambda e: e / sqrt(list_dot_product(y, y))) FROM
                (SELECT step, list_transform(m, lambda r: list_dot_product(r, v)) AS y FROM p{n}, m{n} WHERE step < 150)),
        l{n} AS (SELECT v, sqrt(list_dot_product(y, y)) AS size FROM
            (SELECT v, list_transform(m, lambda r: list_dot_product(r, v)) AS y FROM p{n}, m{n} WHERE step = 150)),
        m{n + 1} AS (SELECT list_transform(range(64), lambda i: list_transform(range(64), lambda j:
            m[i + 1][j + 1] - size * v[i + 1] * v[j + 1])) AS m FROM m{n}, l{n}),
        a{n} AS (SELECT v, v[list_position(list_transform(v, lambda e: abs(e)), list_max(list_transform(v, lambda e: abs(e))))] AS peak FROM l{n})"""
        )
        value = "sum(x * v[pos + 1] * sign(peak))"
        scores.append(f"SELECT id, {n} AS pos, {r6(value, 5)} AS value FROM c, a{n} GROUP BY id")
    return f"WITH RECURSIVE {E}, {unpacked}, {', '.join(ctes)} {' UNION ALL '.join(scores)}"


def _graph_sql(distance):
    return f"""WITH {E} SELECT a.id AS src, b.id AS dst, round({distance}, 6) AS dist,
            row_number() OVER (PARTITION BY a.id ORDER BY {distance}, b.id) AS rank
        FROM e a JOIN e b ON a.id <> b.id QUALIFY rank <= 15"""


ORACLES = {
    "flagship": f"""WITH {E}, {UNPACKED}, {SPLIT_E}, {sparse_ctes()},
        s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS sd FROM u JOIN parts USING (id) WHERE split = 'train' GROUP BY pos),
        scaled AS (SELECT id, pos, (x - m) / sd AS x FROM u JOIN s USING (pos)),
        z AS (SELECT id, list(v ORDER BY j) AS features FROM (SELECT id, j, sum(x * w) AS v
                FROM scaled JOIN weight ON pos = i GROUP BY id, j) GROUP BY id),
        tr AS (SELECT id, label, features FROM z JOIN parts USING (id) WHERE split = 'train'),
        te AS (SELECT id, label, features FROM z JOIN parts USING (id) WHERE split = 'test'),
        {knn_ctes('te', 'tr', EUCLID)}, g AS (SELECT te.label, prediction FROM te JOIN voted USING (id)),
        {scores_sql('g')} SELECT {SIX_SQL}""",
    "identity": f"WITH {E}, {UNPACKED} SELECT id, pos::INTEGER AS pos, {r6('x')} AS value FROM u",
    "gaussian_rp": _z_sql(gaussian_ctes()),
    "sparse_rp": _z_sql(sparse_ctes()),
    "sparse_rp_on_sparse": _z_sql(sparse_ctes(), "t", THIN, " WHERE value <> 0"),
    "dct_1d": _z_sql(cosine_ctes()),
    "dct_2d": _z_sql(image_ctes(8, 1)),
    "dct_2d_channels": _z_sql(image_ctes(4, 4)),
    "feasible_dims": """SELECT input_dim, k::INTEGER AS k, least(k, input_dim)::INTEGER AS clamped, k > input_dim AS skipped
        FROM (SELECT max(len(embedding))::INTEGER AS input_dim FROM embeddings), (SELECT unnest([16, 32, 64, 128]) AS k)""",
    "pca_covariance": f"""WITH {E}, {UNPACKED}, s AS (SELECT pos, avg(x) AS m FROM u GROUP BY pos),
        c AS (SELECT id, pos, x - m AS x FROM u JOIN s USING (pos))
        SELECT a.pos::INTEGER AS i, b.pos::INTEGER AS j,
            {r6('sum(a.x * b.x) / ((SELECT count(*) FROM e) - 1)', 9)} AS cov
        FROM c a JOIN c b USING (id) GROUP BY a.pos, b.pos""",
    "pca_lines": _axis_sql(True),
    "svd_lines": _axis_sql(False),
    "pca_full": _axes_sql("u", UNPACKED, True),
    "pca_randomized": _axes_sql("u", UNPACKED, True),
    "truncated_svd": _axes_sql("t", THIN, False),
    "svd_power_step": _power_sql("u", UNPACKED),
    "svd_power_step_sparse": _power_sql("t", THIN),
    "knn_predict": _knn_sql(EUCLID),
    "knn_cosine": _knn_sql(
        "1 - list_cosine_similarity(q.features, b.features)",
        features="list_transform(range(64), lambda i: features[i + 1] + CASE WHEN i = e.label THEN 0.2 ELSE 0 END)",
    ),
    "knn_manhattan": _knn_sql(
        "list_sum(list_transform(range(1, 65), lambda i: abs(q.features[i] - b.features[i])))", 3
    ),
    "knn_graph": _graph_sql("list_distance(a.features, b.features)"),
    "knn_graph_cells": _graph_sql("list_distance(a.features, b.features)"),
    "knn_graph_blocks": _graph_sql("(1 - list_cosine_similarity(a.features, b.features))"),
    "classification_metrics": f"WITH {GUESSED}, {scores_sql('g')} SELECT {SIX_SQL}",
    "per_class_metrics": f"""WITH {GUESSED}, {scores_sql('g')} SELECT cls, support, predicted, hit,
        round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM rates""",
    "clustering_metrics": f"WITH {GUESSED}, r AS (SELECT label AS y, prediction % 4 AS p FROM g), {agreement_sql('r')}",
    "clustering_metrics_events": "WITH r AS (SELECT event_type AS y, user_id % 8 AS p FROM events), " + agreement_sql("r"),
    "contingency": f"WITH {GUESSED} SELECT prediction % 4 AS cluster, "
    + ", ".join(f'count(*) FILTER (label = {i}) AS "{i}"' for i in range(10))
    + " FROM g GROUP BY 1",
    "silhouette": f"""WITH {E}, s AS (SELECT id, CASE WHEN id = 3 THEN -1 ELSE label END AS cluster,
            list_transform(range(64), lambda i: features[i + 1] + CASE WHEN i = label THEN 1 ELSE 0 END) AS f FROM e
            ORDER BY md5(concat('{SEED}:', id)), id LIMIT 2000),
        d AS (SELECT a.id, a.cluster AS own, b.cluster AS other, sum(list_distance(a.f, b.f)) AS total, count(*) AS n
            FROM s a, s b GROUP BY ALL),
        w AS (SELECT id, max(n) FILTER (own = other) AS size,
                max(CASE WHEN n > 1 THEN total / (n - 1) END) FILTER (own = other) AS a, min(total / n) FILTER (own <> other) AS b
            FROM d GROUP BY id)
        SELECT round(avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM w""",
    "distance_preservation": f"""{_methods_sql(1000)}
        SELECT 'gaussian_rp' AS method, round(corr(d0, d1), 6) AS distance_preservation FROM pairs
        UNION ALL SELECT 'sparse_rp', round(corr(d0, d2), 6) FROM pairs UNION ALL SELECT 'dct', round(corr(d0, d3), 6) FROM pairs""",
    "distortion_histogram": f"""{_methods_sql(600)},
        r AS (SELECT 'gaussian_rp' AS method, d1 / d0 AS r FROM pairs WHERE d0 > 1e-12 UNION ALL
              SELECT 'sparse_rp', d2 / d0 FROM pairs WHERE d0 > 1e-12 UNION ALL SELECT 'dct', d3 / d0 FROM pairs WHERE d0 > 1e-12),
        lim AS (SELECT method, min(r) AS lo, max(r) AS hi FROM r GROUP BY method),
        counted AS (SELECT method, least(floor((r - lo) / (hi - lo) * 50)::INTEGER + 1, 50) AS bin, count(*) AS n
            FROM r JOIN lim USING (method) GROUP BY ALL)
        SELECT lim.method, b::INTEGER AS bin, round(lo + (hi - lo) * (b - 1) / 50, 6) AS bin_start,
            round(lo + (hi - lo) * b / 50, 6) AS bin_end, coalesce(n, 0) AS n
        FROM lim CROSS JOIN range(1, 51) AS t(b) LEFT JOIN counted ON counted.method = lim.method AND counted.bin = b""",
}
