"""Queries over sources, sampling, scaling and layout."""

import json

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import layout, sampling, scaling
from ..sources import tables
from .fixtures import embeddings, line_features, long_form, table, thinned

SEED = 42


def _values(df):
    return long_form(df).withColumn("value", rounded(F.col("value")))


def subsample_exact(spark, sf_dir):
    return sampling.subsample(table(spark, sf_dir, "events"), 1000, SEED, "event_id").select("event_id", "event_type")


def split_stratified(spark, sf_dir):
    split = sampling.split_table(
        table(spark, sf_dir, "events"), test_size=0.2, seed=SEED, label_col="event_type", id_col="event_id"
    )
    return split.select("event_id", "event_type", "split")


def split_given_sizes(spark, sf_dir):
    split = sampling.split_table(embeddings(spark, sf_dir), train_size=301, test_size=103, seed=SEED)
    return split.select("id", "label", "split")


def split_fallback(spark, sf_dir):
    lone = embeddings(spark, sf_dir).withColumn("label", F.when(F.col("id") == 7, 99).otherwise(F.col("label")))
    return sampling.split_table(lone, test_size=0.25, seed=SEED).select("id", "label", "split")


def sample_stratified(spark, sf_dir):
    marked = table(spark, sf_dir, "labels")
    chosen = sampling.sample_stratified(marked, 150, SEED, "quality", "doc_id")
    return sampling.companion_rows(table(spark, sf_dir, "documents"), chosen, "doc_id").select("doc_id", "lang", "n_chars")


def val_split(spark, sf_dir):
    return sampling.validation_split(
        table(spark, sf_dir, "events"), 0.1, SEED, label_col="event_type", id_col="event_id"
    ).select("event_id", "event_type", "part")


def standardize(spark, sf_dir):
    split = sampling.split_table(embeddings(spark, sf_dir), test_size=0.2, seed=SEED)
    scaler = scaling.fit_standardizer(split.filter(F.col("split") == "train"))
    return _values(scaler.transform(split))


def line_moments(spark, sf_dir):
    stats = scaling.feature_moments(line_features(spark, sf_dir))
    return stats.select("pos", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def channel_normalize(spark, sf_dir):
    split = sampling.split_table(embeddings(spark, sf_dir), test_size=0.2, seed=SEED)
    return _values(scaling.fit_channel_normalizer(split.filter(F.col("split") == "train"), 4).transform(split))


def pixel_rescale(spark, sf_dir):
    return _values(scaling.rescale_pixels(embeddings(spark, sf_dir)))


def _sparse_values(df):
    return df.select("id", F.explode(F.arrays_zip("idx", "val")).alias("e")).select(
        "id", F.col("e.idx").alias("idx"), rounded(F.col("e.val")).alias("val")
    )


def sparse_coords(spark, sf_dir):
    return _sparse_values(layout.to_sparse(thinned(embeddings(spark, sf_dir))))


def dense_again(spark, sf_dir):
    sparse = layout.to_sparse(thinned(embeddings(spark, sf_dir)))
    return _values(layout.to_dense(sparse, 64))


def maxabs_scale(spark, sf_dir):
    sparse = layout.to_sparse(thinned(embeddings(spark, sf_dir)))
    return _sparse_values(scaling.fit_max_abs(sparse, 64).transform(sparse))


def sparse_deviation_scale(spark, sf_dir):
    sparse = layout.to_sparse(thinned(embeddings(spark, sf_dir)))
    return _sparse_values(scaling.fit_sparse_deviation(sparse, 64).transform(sparse))


# Numbering of the event types, used as label numbers.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _user_labels(spark, sf_dir):
    """Users with the set of event types in which they passed a value."""
    code = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type")) - 1
    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(F.collect_set(F.when(F.col("value") > 200, code)).alias("labels"))
    )


def first_label(spark, sf_dir):
    return tables.first_label(_user_labels(spark, sf_dir)).select("user_id", "label")


def image_layout(spark, sf_dir):
    return _values(layout.channels_last(embeddings(spark, sf_dir), 4, 4, 4))


def image_layout_back(spark, sf_dir):
    return _values(layout.channels_first(embeddings(spark, sf_dir), 4, 4, 4))


def table_facts(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    facts = tables.class_count(df), tables.highest_label_count(df), tables.vector_width(df), df.count()
    return spark.createDataFrame([facts], "n_classes long, label_range int, input_dim int, n long")


def label_rebase(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_linenumber", "label")
    return tables.rebase_label(lines).groupBy("label").agg(F.count("*").alias("n"))


def train_test_union(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("subject"), "event_type")
    train = events.filter(F.col("subject") % 3 != 0)
    test = events.filter(F.col("subject") % 3 == 0)
    return tables.stack_with_origin(train, test)


def feature_memory(spark, sf_dir):
    dense = embeddings(spark, sf_dir)
    sparse = layout.to_sparse(thinned(dense))
    return (
        layout.feature_memory(dense)
        .withColumn("form", F.lit("dense"))
        .unionByName(layout.feature_memory(sparse, sparse=True).withColumn("form", F.lit("sparse")))
        .withColumn("memory_mb", F.round("memory_mb", 6))
    )


def unique_names(spark, sf_dir):
    return layout.unique_names(table(spark, sf_dir, "events"), "event_id", "event_type").select(
        "event_id", "event_type", "unique_name"
    )


def wide_table(spark, sf_dir):
    df = embeddings(spark, sf_dir).filter("label is not null")
    names = [f"f_{i}" for i in range(64)]
    wide = layout.widen(df, names)
    return wide.select("id", "label", *[F.round(n, 6).alias(n) for n in names])


QUERIES = {
    f.__name__: f
    for f in (
        subsample_exact, split_stratified, split_given_sizes, split_fallback, sample_stratified, val_split,
        standardize, line_moments, channel_normalize, pixel_rescale, sparse_coords, dense_again, maxabs_scale,
        sparse_deviation_scale, first_label, image_layout, image_layout_back, table_facts, label_rebase,
        train_test_union, feature_memory, unique_names, wide_table,
    )
}


# --- the same results in SQL -------------------------------------------------------------------

E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS features, label FROM embeddings)"
UNPACKED = "u AS (SELECT id, label, unnest(features) AS x, generate_subscripts(features, 1) - 1 AS pos FROM e)"
THIN = (
    "t AS (SELECT id, label, CASE WHEN abs(x) >= 0.1 THEN x ELSE 0.0 END AS x, pos FROM "
    "(SELECT id, label, unnest(features) AS x, generate_subscripts(features, 1) - 1 AS pos FROM e))"
)


def r6(value, digits=6):
    return f"CASE WHEN round({value}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({value}, {digits}) END"


def split_ctes(source, train, test, label="label", id_col="id", seed=SEED):
    """CTE `parts(id, label, split)`: largest-remainder shares, then rank by key within the class."""
    return f"""
    sized AS (SELECT {id_col} AS id, {label} AS label, count(*) OVER (PARTITION BY {label}) AS n,
                     count(*) OVER () AS total,
                     row_number() OVER (PARTITION BY {label} ORDER BY md5(concat('{seed}:', {id_col})), {id_col}) AS place
              FROM {source}),
    classes AS (SELECT DISTINCT label, n, total FROM sized),
    wanted AS (SELECT *, {train} AS n_train, {test} AS n_test FROM classes),
    floor_train AS (SELECT *, n * n_train // total AS f,
                     row_number() OVER (ORDER BY n * n_train % total DESC, label) AS r FROM wanted),
    in_train AS (SELECT *, f + CASE WHEN r <= n_train - (SELECT sum(f) FROM floor_train) THEN 1 ELSE 0 END AS a
                 FROM floor_train),
    remaining AS (SELECT label, n, a, n_test, n - a AS m, (sum(n - a) OVER ())::BIGINT AS left_over FROM in_train),
    floor_test AS (SELECT *, m * n_test // left_over AS g,
                     row_number() OVER (ORDER BY m * n_test % left_over DESC, label) AS q FROM remaining),
    in_test AS (SELECT *, g + CASE WHEN q <= n_test - (SELECT sum(g) FROM floor_test) THEN 1 ELSE 0 END AS b
                FROM floor_test),
    parts AS (SELECT s.id, s.label, CASE WHEN place <= a THEN 'train' ELSE 'test' END AS split
              FROM sized s JOIN in_test USING (label) WHERE place <= a + b)"""


SPLIT_E = split_ctes("e", "total - CAST(ceil(total * 0.2) AS BIGINT)", "CAST(ceil(total * 0.2) AS BIGINT)")


def _sparse_sql(value, extra=""):
    return f"WITH {E}, {THIN}{extra} SELECT t.id, t.pos::INTEGER AS idx, {r6(value)} AS val FROM t"


ORACLES = {
    "subsample_exact": f"""SELECT event_id, event_type FROM events
        ORDER BY md5(concat('{SEED}:', event_id)), event_id LIMIT 1000""",
    "split_stratified": "WITH "
    + split_ctes(
        "events", "total - CAST(ceil(total * 0.2) AS BIGINT)", "CAST(ceil(total * 0.2) AS BIGINT)", "event_type", "event_id"
    )
    + " SELECT id AS event_id, label AS event_type, split FROM parts",
    "split_given_sizes": f"WITH {E}, {split_ctes('e', '301', '103')} SELECT id, label, split FROM parts",
    "split_fallback": f"""WITH {E}, ranked AS (
            SELECT id, CASE WHEN id = 7 THEN 99 ELSE label END AS label, count(*) OVER () AS total,
                   row_number() OVER (ORDER BY md5(concat('{SEED}:', id)), id) AS place FROM e)
        SELECT id, label, CASE WHEN place <= total - CAST(ceil(total * 0.25) AS BIGINT) THEN 'train' ELSE 'test' END AS split
        FROM ranked""",
    "sample_stratified": f"""WITH {split_ctes('labels', 'total - 150', '150', 'quality', 'doc_id')}
        SELECT doc_id, lang, n_chars FROM documents
        WHERE doc_id IN (SELECT id FROM parts WHERE split = 'test' OR (SELECT count(*) FROM labels) <= 150)""",
    "val_split": f"""WITH ranked AS (
            SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type) AS n,
                   row_number() OVER (PARTITION BY event_type ORDER BY md5(concat('{SEED}:', event_id)), event_id) AS place
            FROM events)
        SELECT event_id, event_type,
               CASE WHEN n >= 2 AND place <= least(greatest(1, round_even(n * 0.1, 0)), n - 1) THEN 'val' ELSE 'train' END AS part
        FROM ranked""",
    "standardize": f"""WITH {E}, {UNPACKED}, {SPLIT_E},
        s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS sd FROM u JOIN parts USING (id) WHERE split = 'train' GROUP BY pos)
        SELECT id, pos::INTEGER AS pos, {r6('(x - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END')} AS value FROM u JOIN s USING (pos)""",
    "line_moments": " UNION ALL ".join(
        f"SELECT {i}::INTEGER AS pos, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM lineitem"
        for i, c in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    ),
    "channel_normalize": f"""WITH {E}, {UNPACKED}, {SPLIT_E},
        s AS (SELECT pos % 4 AS ch, avg(x) AS m, stddev_pop(x) + 1e-8 AS sd
              FROM u JOIN parts USING (id) WHERE split = 'train' GROUP BY ch)
        SELECT id, pos::INTEGER AS pos, {r6('(x - m) / sd')} AS value FROM u JOIN s ON pos % 4 = ch""",
    "pixel_rescale": f"WITH {E}, {UNPACKED} SELECT id, pos::INTEGER AS pos, {r6('x / 255')} AS value FROM u",
    "sparse_coords": _sparse_sql("x") + " WHERE x <> 0",
    "dense_again": f"WITH {E}, {THIN} SELECT id, pos::INTEGER AS pos, {r6('x')} AS value FROM t",
    "maxabs_scale": _sparse_sql(
        "x / m", ", s AS (SELECT pos, max(abs(x)) AS m FROM t GROUP BY pos HAVING max(abs(x)) > 0)"
    )
    + " JOIN s USING (pos) WHERE x <> 0",
    "sparse_deviation_scale": _sparse_sql("x / m", ", s AS (SELECT pos, stddev_pop(x) AS m FROM t GROUP BY pos)")
    + " JOIN s USING (pos) WHERE x <> 0",
    "first_label": f"""SELECT user_id, min(list_position({json.dumps(EVENT_TYPES).replace('"', "'")}, event_type) - 1)::INTEGER AS label
        FROM events WHERE value > 200 GROUP BY user_id""",
    "image_layout": f"""WITH {E}, {UNPACKED}
        SELECT id, ((pos % 16) * 4 + pos // 16)::INTEGER AS pos, {r6('x')} AS value FROM u""",
    "image_layout_back": f"""WITH {E}, {UNPACKED}
        SELECT id, ((pos % 4) * 16 + pos // 4)::INTEGER AS pos, {r6('x')} AS value FROM u""",
    "table_facts": """SELECT count(DISTINCT label) AS n_classes, max(label) + 1 AS label_range,
        max(len(embedding))::INTEGER AS input_dim, count(*) AS n FROM embeddings""",
    "label_rebase": "SELECT (l_linenumber - 1)::INTEGER AS label, count(*) AS n FROM lineitem GROUP BY 1",
    "train_test_union": """SELECT event_id, user_id AS subject, event_type,
        CASE WHEN user_id % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM events""",
    "feature_memory": f"""WITH {E}, {THIN}
        SELECT count(DISTINCT id) AS n, round(count(*) * 4 / 1048576.0, 6)::DOUBLE AS memory_mb, 'dense' AS form FROM t
        UNION ALL SELECT count(DISTINCT id),
            round((count(*) FILTER (x <> 0) * 8 + (count(DISTINCT id) + 1) * 4) / 1048576.0, 6)::DOUBLE, 'sparse' FROM t""",
    "unique_names": """WITH n AS (SELECT event_id, event_type,
            row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth FROM events)
        SELECT event_id, event_type, CASE WHEN nth = 1 THEN event_type ELSE concat(event_type, '_', nth) END AS unique_name FROM n""",
    "wide_table": "SELECT vec_id AS id, label, "
    + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) AS f_{i}" for i in range(64))
    + " FROM embeddings",
}
