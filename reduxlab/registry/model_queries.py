"""Queries over text features, classifiers, clusterings and computed features."""

import numpy as np
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..operators import featurize, layout, linear_svm, mlp, partitions, sampling, scaling, scores, text
from ..operators.linear_svm import HingeSGD, SquaredHingeSVM
from ..operators.mlp import NeuralNetwork, Settings
from ..session import scratch_path
from ..sources import loaders
from ..sources.records import cached_features
from ..sources.tables import spread
from .data_queries import EVENT_TYPES, SEED, SPLIT_E, THIN, UNPACKED, E, r6, split_ctes
from .fixtures import embeddings, long_form, planted, table, thinned
from .reduction_queries import _six, agreement_sql

# Words left out in the text queries, in all four languages of the documents.
STOP_WORDS = ["the", "and", "of", "to", "der", "die", "und", "la", "le", "el", "de", "les", "un", "une", "en"]
VOCABULARY = 50_000


def _documents(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    side = F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")
    return docs.select(F.col("doc_id").alias("id"), "text", side.alias("split"), "source")


def _weights(df):
    return df.select("id", F.explode(F.arrays_zip("idx", "val")).alias("e")).select(
        "id", F.col("e.idx").alias("idx"), rounded(F.col("e.val")).alias("val")
    )


def tfidf(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    model = text.fit_tfidf(docs.filter("split = 'train'"), "text", STOP_WORDS, VOCABULARY)
    return _weights(model.transform(docs, "text", STOP_WORDS))


def tfidf_whole_vocabulary(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    model = text.fit_tfidf(docs.filter("split = 'train'"), "text", STOP_WORDS, None, min_df=3)
    return _weights(model.transform(docs, "text", STOP_WORDS))


def tfidf_repeated_rows(spark, sf_dir):
    """The vocabulary is joined, and every document comes twice with all its columns."""
    docs = _documents(spark, sf_dir)
    model = text.fit_tfidf(docs.filter("split = 'train'"), "text", STOP_WORDS, None, min_df=3)
    return _weights(model.transform(docs.unionByName(docs), "text", STOP_WORDS))


def term_statistics(spark, sf_dir):
    return text.term_statistics(spread(table(spark, sf_dir, "documents")), "text", STOP_WORDS)


def clean_text(spark, sf_dir):
    cleaned = text.clean_text(spread(table(spark, sf_dir, "documents")), ("footers", "quotes"))
    return cleaned.select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("length"))


def clean_conversations(spark, sf_dir):
    """Whole conversations as messages: header up to the first empty line, quotes, footers."""
    turns = table(spark, sf_dir, "conversations")
    marked = turns.withColumn(
        "text", F.concat(F.col("role"), F.lit(": x\n\n> "), F.col("role"), F.lit("\n"), F.col("text"), F.lit("\n--\nsent\n"))
    )
    return text.clean_text(marked).select("conv_id", "turn", F.md5("text").alias("digest"))


def text_loader(spark, sf_dir):
    """The prepared text corpus: TF-IDF fitted on train, max-abs scaling."""
    docs = _documents(spark, sf_dir).withColumnRenamed("source", "label")
    out = loaders.prepare_text(docs, SEED, max_features=VOCABULARY, remove=(), stop_words=STOP_WORDS)
    return _weights(out.df)


def _multilabel(spark, sf_dir):
    """Per user: summed values by the number in props as features, passed event types as labels."""
    events = table(spark, sf_dir, "events").withColumn("idx", F.get_json_object("props", "$.k").cast("int"))
    code = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type")) - 1
    cells = events.groupBy("user_id", "idx").agg(
        F.sum("value").alias("val"), F.collect_set(F.when(F.col("value") > 150, code)).alias("passed")
    )
    return cells.groupBy(F.col("user_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "val"))).alias("cells"),
        F.array_distinct(F.flatten(F.collect_list("passed"))).alias("labels"),
    ).select("id", F.col("cells.idx").alias("idx"), F.col("cells.val").alias("val"), "labels")


def multilabel_loader(spark, sf_dir):
    rows = cached_features(spark, scratch_path(spark, "multilabel"), lambda: _multilabel(spark, sf_dir))
    out = loaders.prepare_multilabel(rows, 100, SEED).df
    return out.select("id", "label", "split", F.explode(F.arrays_zip("idx", "val")).alias("e")).select(
        "id", "label", "split", F.col("e.idx").alias("idx"), rounded(F.col("e.val")).alias("val")
    )


def image_loader(spark, sf_dir):
    """The prepared image table: rescale, split, standardise per pixel."""
    out = loaders.prepare_images(
        embeddings(spark, sf_dir), SEED, train_size=None, test_size=0.2, image_shape=(8, 8)
    )
    return out.df.select("id", "split", F.posexplode("features").alias("pos", "value")).withColumn(
        "value", rounded(F.col("value"))
    )


def colour_loader(spark, sf_dir):
    """Given train and test parts of colour images, normalised per channel."""
    df = embeddings(spark, sf_dir)
    out = loaders.prepare_colour_images(df.filter("id % 4 != 0"), df.filter("id % 4 = 0"), SEED, image_shape=(4, 4, 4))
    return out.df.select("id", "split", F.posexplode("features").alias("pos", "value")).withColumn(
        "value", rounded(F.col("value"))
    )


def _pattern(rows, cols):
    """Fixed weights that any engine can write down."""
    i, j = np.indices((rows, cols))
    return ((i * 7 + j * 3) % 11 - 5) / 20.0


def svm_gradient_step(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    return linear_svm.squared_hinge_table(df, _pattern(65, 10), np.arange(10), cost=0.5).withColumn(
        "slope", rounded(F.col("slope"))
    )


def svm_gradient_sparse(spark, sf_dir):
    df = layout.to_sparse(thinned(embeddings(spark, sf_dir)))
    return linear_svm.squared_hinge_table(df, _pattern(65, 10), np.arange(10), cost=0.5, sparse=True).withColumn(
        "slope", rounded(F.col("slope"))
    )


def _sides(spark, sf_dir, sparse=False):
    df = planted(embeddings(spark, sf_dir))
    split = sampling.split_table(layout.to_sparse(df) if sparse else df, test_size=0.2, seed=SEED)
    return split.filter("split = 'train'").drop("split"), split.filter("split = 'test'").drop("split")


def svm_predict(spark, sf_dir):
    train, test = _sides(spark, sf_dir)
    return SquaredHingeSVM(seed=SEED, scale_dense=True).fit(train).predict(test).select("id", "prediction")


def svm_predict_sparse(spark, sf_dir):
    train, test = _sides(spark, sf_dir, sparse=True)
    return SquaredHingeSVM(seed=SEED).fit(train, sparse=True, width=64).predict(test).select("id", "prediction")


def sgd_hinge_step(spark, sf_dir):
    """The hinge objective at fixed weights, per class."""
    df = embeddings(spark, sf_dir)
    values = linear_svm.hinge_objective(df, _pattern(65, 10), np.arange(10), 0.01)
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(values)], "cls int, objective double")


def sgd_predict(spark, sf_dir):
    train, test = _sides(spark, sf_dir)
    return HingeSGD(seed=SEED).fit(train).predict(test).select("id", "prediction")


def sgd_local_steps(spark, sf_dir):
    """Weights after two epochs of one local step per worker, four or more workers: averages of steps are steps on all rows."""
    df = planted(embeddings(spark, sf_dir))
    model = HingeSGD(alpha=0.1, max_iter=2, seed=SEED, average=False, early_stopping=False, rows_per_worker=100,
                     learning_rate="constant", eta0=0.5, step_rows=linear_svm.REORDER_ROWS).fit(df)
    rows = [(int(model.classes[c]), i, float(v)) for (i, c), v in np.ndenumerate(model.weights)]
    return spark.createDataFrame(rows, "cls int, pos int, weight double").withColumn("weight", rounded(F.col("weight")))


MLP_SHAPES = mlp.layer_shapes(64, 8, 10)
MLP_SIZE = sum(int(np.prod(s)) for s in MLP_SHAPES)


def _network_weights():
    p = np.arange(MLP_SIZE)
    return ((p * 13) % 29 - 14) / 40.0


def mlp_forward(spark, sf_dir):
    logits = mlp.predict(embeddings(spark, sf_dir), _network_weights(), MLP_SHAPES, with_logits=True)
    return logits.select("id", "prediction", F.posexplode("logits").alias("cls", "logit")).withColumn(
        "logit", rounded(F.col("logit"))
    )


def mlp_forward_sparse(spark, sf_dir):
    df = layout.to_sparse(thinned(embeddings(spark, sf_dir)))
    return mlp.predict(df, _network_weights(), MLP_SHAPES, sparse=True).select("id", "prediction")


def mlp_loss(spark, sf_dir):
    return mlp.loss_table(embeddings(spark, sf_dir), _network_weights(), MLP_SHAPES).withColumn(
        "loss_sum", F.round("loss_sum", 5)
    )


MLP_SETTINGS = Settings(batch_size=32, lr=1e-2, seed=SEED)


def mlp_predict(spark, sf_dir):
    train, test = _sides(spark, sf_dir)
    return NeuralNetwork(10, MLP_SETTINGS).fit(train).predict(test).select("id", "prediction")


def mlp_predict_sparse(spark, sf_dir):
    train, test = _sides(spark, sf_dir, sparse=True)
    return NeuralNetwork(10, MLP_SETTINGS).fit(train, sparse=True, width=64).predict(test).select("id", "prediction")


def _over_layouts(fit, train, test):
    """Predictions of fits on 1, 4 and 16 input partitions, and whether all agree."""
    found = [
        fit(train.repartition(parts)).predict(test).select("id", F.col("prediction").alias(f"p{parts}")) for parts in (1, 4, 16)
    ]
    joined = found[0].join(found[1], "id").join(found[2], "id")
    return joined.select("id", F.col("p16").alias("prediction"), ((F.col("p1") == F.col("p4")) & (F.col("p4") == F.col("p16"))).alias("agree"))


def sgd_layout(spark, sf_dir):
    """Four or more workers, whatever the layout of the training rows."""
    train, test = _sides(spark, sf_dir)
    return _over_layouts(lambda df: HingeSGD(seed=SEED, rows_per_worker=100).fit(df), train, test)


def mlp_layout(spark, sf_dir):
    train, test = _sides(spark, sf_dir)
    return _over_layouts(lambda df: NeuralNetwork(10, MLP_SETTINGS, rows_per_worker=100).fit(df), train, test)


def _first_centers(df):
    """The ten rows with the lowest ids as centers."""
    rows = df.orderBy("id").limit(10).select("features").collect()
    return np.array([row["features"] for row in rows])


def kmeans_step(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    return partitions.lloyd_step(df, _first_centers(df)).withColumn("center", rounded(F.col("center")))


def _purity_rows(clustered):
    """Lowest and highest label of every cluster, and its size."""
    return (
        clustered.groupBy("cluster")
        .agg(F.min("label").alias("lowest"), F.max("label").alias("highest"), F.count("*").alias("n"))
        .drop("cluster")
    )


def kmeans_planted(spark, sf_dir):
    df = planted(embeddings(spark, sf_dir))
    return _purity_rows(partitions.KMeans(10, seed=SEED).fit(df).transform(df))


def kmeans_scores(spark, sf_dir):
    df = planted(embeddings(spark, sf_dir))
    return _six(scores.clustering_agreement(partitions.KMeans(10, seed=SEED).fit(df).transform(df)))


def gmm_em_step(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    centers = _first_centers(df)
    start = partitions.Mixture(np.full(10, 0.1), centers, np.full(centers.shape, 0.02))
    after, likelihood = partitions.em_step(df, start)
    rows = [
        (c, f, round(float(after.weights[c]), 6), round(float(after.means[c, f]), 6), round(float(after.variances[c, f]), 6))
        for c in range(10)
        for f in range(centers.shape[1])
    ]
    out = spark.createDataFrame(rows, "component int, pos int, weight double, mean double, variance double")
    zero = [F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in ("weight", "mean", "variance")]
    return out.select("component", "pos", *zero).withColumn("log_likelihood", F.lit(round(likelihood, 6)))


def gmm_planted(spark, sf_dir):
    df = planted(embeddings(spark, sf_dir))
    return _purity_rows(partitions.GaussianMixture(10, seed=SEED).fit(df).transform(df))


def hog(spark, sf_dir):
    return long_form(featurize.hog(embeddings(spark, sf_dir), 8, 8)).withColumn("value", rounded(F.col("value")))


def batch_features(spark, sf_dir):
    """Planar 4 x 4 x 4 images doubled in size, normalised per channel, rectified, and averaged."""

    def network(x):
        images = featurize.prepared_images(x, 4, 4, 4, 8, np.array([0.0, 0.01, 0.02, 0.03]), np.array([0.1, 0.2, 0.3, 0.4]))
        return np.maximum(images, 0.0).mean(axis=(2, 3))

    return long_form(featurize.featurize(embeddings(spark, sf_dir), network)).withColumn(
        "value", rounded(F.col("value"))
    )


def scaled_svm_features(spark, sf_dir):
    """What the pipeline SVM sees: train statistics, both sides scaled."""
    train, test = _sides(spark, sf_dir)
    scaler = scaling.fit_standardizer(train)
    return long_form(scaler.transform(test)).withColumn("value", rounded(F.col("value")))


QUERIES = {
    f.__name__: f
    for f in (
        tfidf, tfidf_whole_vocabulary, tfidf_repeated_rows, term_statistics, clean_text, clean_conversations, text_loader,
        multilabel_loader, image_loader, colour_loader, svm_gradient_step, svm_gradient_sparse, svm_predict,
        svm_predict_sparse, sgd_hinge_step, sgd_local_steps, sgd_predict, mlp_forward, mlp_forward_sparse, mlp_loss, mlp_predict,
        mlp_predict_sparse, sgd_layout, mlp_layout, kmeans_step, kmeans_planted, kmeans_scores, gmm_em_step, gmm_planted, hog,
        batch_features, scaled_svm_features,
    )
}


# --- the same results in SQL -------------------------------------------------------------------

_WORDS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def terms_ctes(train="doc_id % 5 <> 0", limit=VOCABULARY, min_df=2):
    """CTEs `tf(id, term, n)` for all documents and `vocab(term, idx, idf)` from the training ones."""
    cut = "" if limit is None else f"ORDER BY uses DESC, term LIMIT {limit}"
    return f"""tokens AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents),
        tf AS (SELECT id, term, count(*) AS n FROM tokens WHERE term NOT IN ({_WORDS}) GROUP BY id, term),
        stats AS (SELECT term, sum(n) AS uses, count(*) AS docs FROM tf JOIN documents ON id = doc_id WHERE {train} GROUP BY term),
        chosen AS (SELECT term, docs FROM stats WHERE docs >= {min_df} {cut}),
        vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx,
                ln((1 + (SELECT count(*) FROM documents WHERE {train})) / (1 + docs)) + 1 AS idf FROM chosen),
        raw AS (SELECT id, idx, n * idf AS w FROM tf JOIN vocab USING (term)),
        weights AS (SELECT id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw)"""


_PATTERN = "((i * 7 + j * 3) % 11 - 5) / 20.0::DOUBLE"


def _slope_sql(source, unpacked):
    return f"""WITH {E}, {unpacked},
        p AS (SELECT id, pos, x FROM {source} UNION ALL SELECT id, 64, 1 FROM e),
        w AS (SELECT i, j, {_PATTERN} AS w FROM range(65) AS a(i), range(10) AS b(j)),
        f AS (SELECT id, j, sum(x * w) AS f FROM p JOIN w ON pos = i GROUP BY id, j),
        g AS (SELECT id, j, -2 * 0.5 * s * greatest(0, 1 - s * f) AS g
            FROM (SELECT f.*, CASE WHEN label = j THEN 1 ELSE -1 END AS s FROM f JOIN e USING (id)))
        SELECT pos::INTEGER AS i, j::INTEGER AS cls, {r6('sum(x * g)')} AS slope FROM p JOIN g USING (id) GROUP BY pos, j"""


def _network_ctes(source):
    """CTE `out(id, j, logit)` of the 64-8-32-10 network with patterned weights."""

    def weight(at):
        return f"((({at}) * 13) % 29 - 14) / 40.0::DOUBLE"

    b1 = 64 * 8
    w2, b2 = b1 + 8, b1 + 8 + 8 * 32
    w3, b3 = b2 + 32, b2 + 32 + 32 * 10
    return f"""h1 AS (SELECT id, j, greatest(0, sum(x * {weight('pos * 8 + j')}) + any_value({weight(f'{b1} + j')})) AS h
            FROM {source}, range(8) AS a(j) GROUP BY id, j),
        h2 AS (SELECT id, k AS j, greatest(0, sum(h * {weight(f'{w2} + j * 32 + k')}) + any_value({weight(f'{b2} + k')})) AS h
            FROM h1, range(32) AS b(k) GROUP BY id, k),
        out AS (SELECT id, k AS j, sum(h * {weight(f'{w3} + j * 10 + k')}) + any_value({weight(f'{b3} + k')}) AS logit
            FROM h2, range(10) AS c(k) GROUP BY id, k),
        best AS (SELECT id, j::INTEGER AS prediction FROM out QUALIFY row_number() OVER (PARTITION BY id ORDER BY logit DESC, j) = 1)"""


_NEAREST = """c AS (SELECT row_number() OVER (ORDER BY id) - 1 AS k, features FROM (SELECT * FROM e ORDER BY id LIMIT 10)),
        near AS (SELECT e.id, k FROM e, c QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY list_distance(e.features, c.features), k) = 1)"""

_LABELLED = "SELECT label AS lowest, label AS highest, count(*) AS n FROM embeddings GROUP BY label"
_TEST_LABELS = f"WITH {E}, {SPLIT_E} SELECT id, label AS prediction FROM parts WHERE split = 'test'"


def _hog_sql():
    """9 directions, 4 x 4 cells of an 8 x 8 image, one 2 x 2 block."""
    return f"""WITH {E}, {UNPACKED},
        g AS (SELECT a.id, a.pos // 8 AS r, a.pos % 8 AS c,
                CASE WHEN a.pos // 8 IN (0, 7) THEN 0 ELSE d.x - b.x END AS gy,
                CASE WHEN a.pos % 8 IN (0, 7) THEN 0 ELSE rt.x - l.x END AS gx
            FROM u a LEFT JOIN u b ON b.id = a.id AND b.pos = a.pos - 8 LEFT JOIN u d ON d.id = a.id AND d.pos = a.pos + 8
                LEFT JOIN u l ON l.id = a.id AND l.pos = a.pos - 1 LEFT JOIN u rt ON rt.id = a.id AND rt.pos = a.pos + 1),
        m AS (SELECT id, r // 4 AS cr, c // 4 AS cc, sqrt(gx * gx + gy * gy) AS mag, degrees(atan2(gy, gx)) AS a FROM g),
        s AS (SELECT id, cr, cc, mag, floor((CASE WHEN a < 0 THEN a + 180 WHEN a >= 180 THEN a - 180 ELSE a END) / 20) AS o FROM m),
        cells AS (SELECT id, (cr * 2 + cc) * 9 + o AS pos, sum(mag) / 16 AS v FROM s GROUP BY id, cr, cc, o),
        filled AS (SELECT e.id, p AS pos, coalesce(v, 0) AS v FROM e CROSS JOIN range(36) AS t(p) LEFT JOIN cells ON cells.id = e.id AND pos = p),
        once AS (SELECT id, pos, least(v / sqrt(sum(v * v) OVER (PARTITION BY id) + 1e-10), 0.2) AS v FROM filled)
        SELECT id, pos::INTEGER AS pos, {r6('v / sqrt(sum(v * v) OVER (PARTITION BY id) + 1e-10)')} AS value FROM once"""


def _resized_sql():
    axis = """SELECT y, greatest(least((y + 0.5) * 4 / 8 - 0.5, 3), 0)::DOUBLE AS p FROM range(8) AS t(y)"""
    return f"""WITH {E}, {UNPACKED}, axis AS ({axis}),
        share AS (SELECT y, floor(p)::INTEGER AS i, 1 - (p - floor(p)) AS w FROM axis
            UNION ALL SELECT y, least(floor(p) + 1, 3)::INTEGER, p - floor(p) FROM axis),
        big AS (SELECT id, pos // 16 AS ch, a.y AS y, b.y AS x, sum(u.x * a.w * b.w) AS v
            FROM u JOIN share a ON a.i = (pos % 16) // 4 JOIN share b ON b.i = pos % 4 GROUP BY id, ch, a.y, b.y)
        SELECT id, ch::INTEGER AS pos, {r6('avg(greatest(0, (v - ch * 0.01) / ((ch + 1) * 0.1)))')} AS value
        FROM big GROUP BY id, ch"""


ORACLES = {
    "tfidf": f"WITH {terms_ctes()} SELECT id, idx::INTEGER AS idx, {r6('w')} AS val FROM weights",
    "tfidf_whole_vocabulary": f"WITH {terms_ctes(limit=None, min_df=3)} SELECT id, idx::INTEGER AS idx, {r6('w')} AS val FROM weights",
    "tfidf_repeated_rows": f"WITH {terms_ctes(limit=None, min_df=3)} SELECT id, idx::INTEGER AS idx, {r6('w')} AS val FROM weights, range(2)",
    "term_statistics": f"WITH {terms_ctes('true')} SELECT term, uses::BIGINT AS uses, docs FROM stats",
    "clean_text": r"""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)) AS lines, text FROM documents),
        k AS (SELECT *, len(lines) - list_position(list_reverse(list_transform(lines, lambda x: regexp_full_match(x, '\s*-*\s*'))), true) AS kept FROM l),
        f AS (SELECT doc_id, CASE WHEN kept > 0 THEN array_to_string(lines[1:kept], chr(10)) ELSE text END AS text FROM k),
        q AS (SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x,
            '(writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\||^>)')), chr(10)) AS text FROM f)
        SELECT doc_id, md5(text) AS digest, length(text) AS length FROM q""",
    "clean_conversations": r"""WITH l AS (SELECT conv_id, turn, string_split(regexp_replace(concat('> ', role, chr(10), text, chr(10), '--', chr(10), 'sent', chr(10)), '^\s+|\s+$', '', 'g'), chr(10)) AS lines
            FROM conversations),
        k AS (SELECT *, len(lines) - list_position(list_reverse(list_transform(lines, lambda x: regexp_full_match(x, '\s*-*\s*'))), true) AS kept FROM l),
        q AS (SELECT conv_id, turn, array_to_string(list_filter(lines[1:kept], lambda x: NOT regexp_matches(x,
            '(writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\||^>)')), chr(10)) AS text FROM k)
        SELECT conv_id, turn, md5(text) AS digest FROM q""",
    "text_loader": f"""WITH {terms_ctes()},
        kept AS (SELECT w.*, id % 5 <> 0 AS train FROM weights w),
        peak AS (SELECT idx, max(w) AS m FROM kept WHERE train GROUP BY idx)
        SELECT id, idx::INTEGER AS idx, {r6('w / coalesce(m, 1)')} AS val FROM kept LEFT JOIN peak USING (idx)""",
    "multilabel_loader": f"""WITH cells AS (SELECT user_id AS id, (props->>'$.k')::INTEGER AS idx, sum(value) AS val FROM events GROUP BY 1, 2),
        firsts AS (SELECT user_id AS id, min(list_position({EVENT_TYPES!r}, event_type) - 1)::INTEGER AS label
            FROM events WHERE value > 150 GROUP BY user_id),
        smallest AS (SELECT CASE WHEN ceil(sum(n) * 0.2) < count(*) THEN 1 ELSE min(n) END AS few FROM (SELECT count(*) AS n FROM firsts GROUP BY label)),
        grouped AS (SELECT id, label AS true_label, CASE WHEN few < 2 THEN 0 ELSE label END AS label FROM firsts, smallest),
        {split_ctes('grouped', 'total - CAST(ceil(total * 0.2) AS BIGINT)', 'CAST(ceil(total * 0.2) AS BIGINT)')},
        kept AS (SELECT c.*, true_label AS label, p.split FROM cells c JOIN parts p USING (id) JOIN grouped USING (id)),
        peak AS (SELECT idx, max(abs(val)) AS m FROM kept WHERE split = 'train' GROUP BY idx)
        SELECT id, label, split, idx, {r6('val / CASE WHEN coalesce(m, 0) = 0 THEN 1 ELSE m END')} AS val FROM kept LEFT JOIN peak USING (idx)""",
    "image_loader": f"""WITH {E}, {UNPACKED}, {SPLIT_E},
        p AS (SELECT id, split, pos, x / 255 AS x FROM u JOIN parts USING (id)),
        s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS sd FROM p WHERE split = 'train' GROUP BY pos)
        SELECT id, split, pos::INTEGER AS pos, {r6('(x - m) / sd')} AS value FROM p JOIN s USING (pos)""",
    "colour_loader": f"""WITH {E}, {UNPACKED},
        p AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'test' ELSE 'train' END AS split, pos, x / 255 AS x FROM u),
        s AS (SELECT pos % 4 AS ch, avg(x) AS m, stddev_pop(x) + 1e-8 AS sd FROM p WHERE split = 'train' GROUP BY ch)
        SELECT id, split, pos::INTEGER AS pos, {r6('(x - m) / sd')} AS value FROM p JOIN s ON pos % 4 = ch""",
    "svm_gradient_step": _slope_sql("u", UNPACKED),
    "svm_gradient_sparse": _slope_sql("t", THIN),
    "svm_predict": _TEST_LABELS,
    "svm_predict_sparse": _TEST_LABELS,
    "sgd_hinge_step": f"""WITH {E}, {UNPACKED},
        w AS (SELECT i, j, {_PATTERN} AS w FROM range(65) AS a(i), range(10) AS b(j)),
        f AS (SELECT id, j, sum(x * w) AS f FROM u JOIN w ON pos = i GROUP BY id, j),
        h AS (SELECT f.j, avg(greatest(0, 1 - CASE WHEN label = f.j THEN 1 ELSE -1 END * (f + w))) AS h
            FROM f JOIN e USING (id) JOIN w ON i = 64 AND w.j = f.j GROUP BY f.j)
        SELECT h.j::INTEGER AS cls, round(h + 0.005 * (SELECT sum(w * w) FROM w WHERE w.j = h.j AND i < 64), 6) AS objective FROM h""",
    "sgd_local_steps": f"""WITH {E}, {UNPACKED},
        p AS (SELECT id, label, pos, x + CASE WHEN pos = label THEN 4 ELSE 0 END AS x FROM u UNION ALL SELECT id, label, 64, 1 FROM e),
        c AS (SELECT DISTINCT label AS j FROM e),
        q AS (SELECT p.*, j, CASE WHEN label = j THEN 1 ELSE -1 END AS s FROM p, c),
        one AS (SELECT j, pos, 0.5 * avg(s * x) AS w FROM q GROUP BY j, pos),
        f AS (SELECT id, q.j, sum(s * x * w) AS margin FROM q JOIN one ON q.j = one.j AND q.pos = one.pos GROUP BY id, q.j),
        two AS (SELECT q.j, pos, 0.5 * avg(CASE WHEN margin < 1 THEN s * x ELSE 0 END) AS w
            FROM q JOIN f ON q.id = f.id AND q.j = f.j GROUP BY q.j, pos)
        SELECT one.j::INTEGER AS cls, one.pos::INTEGER AS pos,
            {r6('one.w * CASE WHEN one.pos = 64 THEN 1 ELSE 1 - 0.5 * 0.1 END + two.w')} AS weight
        FROM one JOIN two ON one.j = two.j AND one.pos = two.pos""",
    "sgd_predict": _TEST_LABELS,
    "mlp_forward": f"""WITH {E}, {UNPACKED}, {_network_ctes('u')}
        SELECT id, prediction, j::INTEGER AS cls, {r6('logit')} AS logit FROM out JOIN best USING (id)""",
    "mlp_forward_sparse": f"WITH {E}, {THIN}, {_network_ctes('t')} SELECT id, prediction FROM best",
    "mlp_loss": f"""WITH {E}, {UNPACKED}, {_network_ctes('u')},
        l AS (SELECT id, ln(sum(exp(logit))) - any_value(logit) FILTER (j = label) AS loss FROM out JOIN e USING (id) GROUP BY id)
        SELECT round(sum(loss), 5) AS loss_sum, count(*) FILTER (prediction = label) AS correct, count(*) AS n
        FROM l JOIN best USING (id) JOIN e USING (id)""",
    "mlp_predict": _TEST_LABELS,
    "sgd_layout": f"SELECT *, true AS agree FROM ({_TEST_LABELS})",
    "mlp_layout": f"SELECT *, true AS agree FROM ({_TEST_LABELS})",
    "mlp_predict_sparse": _TEST_LABELS,
    "kmeans_step": f"""WITH {E}, {UNPACKED}, {_NEAREST}
        SELECT k::INTEGER AS cluster, pos::INTEGER AS pos, count(*) AS n, {r6('avg(x)')} AS center FROM near JOIN u USING (id) GROUP BY k, pos""",
    "kmeans_planted": _LABELLED,
    "kmeans_scores": "WITH r AS (SELECT label AS y, label AS p FROM embeddings), " + agreement_sql("r"),
    "gmm_em_step": f"""WITH {E}, {UNPACKED},
        c AS (SELECT row_number() OVER (ORDER BY id) - 1 AS k, id AS cid FROM (SELECT id FROM e ORDER BY id LIMIT 10)),
        d AS (SELECT a.id, k, ln(0.1::DOUBLE) - 32 * ln(2 * pi()) - 32 * ln(0.02::DOUBLE) - sum((a.x - b.x) ** 2) / 0.04 AS lp
            FROM u a JOIN u b USING (pos) JOIN c ON b.id = cid GROUP BY a.id, k),
        n AS (SELECT id, max(lp) AS top FROM d GROUP BY id),
        t AS (SELECT id, top + ln(sum(exp(lp - top))) AS total FROM d JOIN n USING (id) GROUP BY id, top),
        r AS (SELECT id, k, exp(lp - total) AS r FROM d JOIN t USING (id)),
        s AS (SELECT k, pos, sum(r) AS mass, sum(r * x) AS sx, sum(r * x * x) AS sxx FROM r JOIN u USING (id) GROUP BY k, pos)
        SELECT k::INTEGER AS component, pos::INTEGER AS pos, {r6('mass / (SELECT count(*) FROM e)')} AS weight,
            {r6('sx / mass')} AS mean, {r6('sxx / mass - (sx / mass) ** 2 + 1e-4')} AS variance,
            (SELECT round(avg(total), 6) FROM t) AS log_likelihood FROM s""",
    "gmm_planted": _LABELLED,
    "hog": _hog_sql(),
    "batch_features": _resized_sql(),
    "scaled_svm_features": f"""WITH {E}, {SPLIT_E}, p AS (SELECT id, split, pos, x + CASE WHEN pos = label THEN 4 ELSE 0 END AS x FROM
            (SELECT e.id, split, e.label, unnest(features) AS x, generate_subscripts(features, 1) - 1 AS pos FROM e JOIN parts USING (id))),
        s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS sd FROM p WHERE split = 'train' GROUP BY pos)
        SELECT id, pos::INTEGER AS pos, {r6('(x - m) / sd')} AS value FROM p JOIN s USING (pos) WHERE split = 'test'""",
}
