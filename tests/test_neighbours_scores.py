import numpy as np
import pyarrow as pa
import pytest
from conftest import blobs
from pyspark.sql import functions as F

from reduxlab.functions import distances
from reduxlab.operators import blocks, cells, geometry, layout, neighbours, scores


def brute(queries, base, k, distance, skip_self=False):
    out = {}
    for i, q in enumerate(queries):
        ranked = sorted((distance(q, b), j) for j, b in enumerate(base) if not (skip_self and i == j))
        out[i] = [j for _, j in ranked[:k]]
    return out


def found(df):
    out = {}
    for row in df.orderBy("id", "rank").collect():
        out.setdefault(row["id"], []).append(row["neighbour"])
    return out


METRICS = {
    "euclidean": lambda a, b: round(float(np.sqrt(((a - b) ** 2).sum())), 12),
    "manhattan": lambda a, b: round(float(np.abs(a - b).sum()), 12),
    "chebyshev": lambda a, b: round(float(np.abs(a - b).max()), 12),
    "cosine": lambda a, b: round(float(1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 12),
}


@pytest.mark.parametrize("metric", METRICS)
def test_neighbours_match_brute_force(make, metric):
    rng = np.random.default_rng(8)
    base, queries = rng.normal(size=(150, 7)), rng.normal(size=(20, 7))
    got = neighbours.nearest(make(queries), make(base), 6, metric)
    assert found(got) == brute(queries, base, 6, METRICS[metric])


def test_blocks_give_the_broadcast_result_with_a_third_of_copies(make):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(180, 5))
    base[::3] = base[0]
    df = make(base, parts=5)
    small = neighbours.nearest(df, df, 15, skip_self=True)
    blocked = neighbours.nearest(df, df, 15, skip_self=True, small_bytes=0, block_bytes=1500)
    expected = brute(base, base, 15, METRICS["euclidean"], skip_self=True)
    assert found(small) == expected
    assert found(blocked) == expected


def test_streamed_base_gives_the_same_neighbours(make):
    rng = np.random.default_rng(19)
    base, queries = rng.normal(size=(300, 5)), rng.normal(size=(10, 5))
    got = neighbours.nearest(make(queries), make(base, parts=6), 4, small_bytes=1000)
    assert found(got) == brute(queries, base, 4, METRICS["euclidean"])


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_both_sides_large(make, metric):
    x, _ = blobs(seed=4, per=50, centers=8, dims=4, spread=0.4)
    x[::3] = x[1]
    rng = np.random.default_rng(20)
    queries = x[rng.choice(len(x), 90)] + rng.normal(scale=0.05, size=(90, 4))
    queries[0] = 100.0
    got = neighbours.nearest(make(queries), make(x, parts=5), 7, metric, small_bytes=0, block_bytes=1000)
    assert found(got) == brute(queries, x, 7, METRICS[metric])


COUNTED = pa.schema([("base_rows", pa.int64()), ("queries", pa.int64())])


def test_small_blocks_do_not_multiply_what_is_moved(make):
    df = make(np.random.default_rng(22).normal(size=(400, 5)))

    def work(batches, held):
        sizes = [[sum(batch.num_rows for batch in batches)], [held.num_rows]]
        yield pa.RecordBatch.from_arrays([pa.array(n) for n in sizes], schema=COUNTED)

    met = blocks.against(df, df, ["features"], work, COUNTED, small_bytes=0, block_bytes=500).collect()
    assert sum(r["base_rows"] for r in met) <= 4 * 400 and sum(r["queries"] for r in met) <= 4 * 400
    assert sum(r["base_rows"] * r["queries"] for r in met) == 400 * 400
    assert blocks.parcels(10 * blocks.BLOCK_BYTES, 1000) == 10 and blocks.parcels(0, 1000) == 1


def test_queries_are_sent_once_to_a_parcel_of_many_cells(make):
    rng = np.random.default_rng(23)
    middles = rng.normal(scale=50, size=(4, 8))
    x = middles[np.repeat(np.arange(4), 100)] + rng.normal(size=(400, 8))
    df = make(x, parts=4)

    def work(rows, cell, asked, visits):
        assert len(cell) == rows.num_rows and len(set(cell)) > 1
        sizes = [[rows.num_rows], [asked.num_rows]]
        yield pa.RecordBatch.from_arrays([pa.array(n) for n in sizes], schema=COUNTED)

    met = cells.meet(df.select("id", "features"), df, 5, "euclidean", 400, 5, 100, 100, work, COUNTED).collect()
    # 81 cells in parcels of up to 100 rows; a query needs the cells of its own cluster.
    assert sum(r["queries"] for r in met) <= 3 * 400 and sum(r["base_rows"] for r in met) <= 3 * 400
    assert max(r["base_rows"] for r in met) <= 100


@pytest.mark.parametrize("groups", [0, 1, 3, 4, 11, 1000])
def test_groups_are_dealt_evenly(spark, groups):
    key = blocks.even_keys(spark, groups)
    assert len(set(key.tolist())) == groups == len(key)
    rows = spark.createDataFrame([(int(k),) for k in key], "key long").repartition(4, "key")
    sizes = [len(part) for part in rows.rdd.glom().collect()]
    assert groups > 128 or max(sizes) == -(-groups // 4)


@pytest.mark.parametrize("most", [1, 7, 30, 1000])
def test_parcels_hold_so_many_rows_at_most(most):
    rng = np.random.default_rng(24)
    rows_in = rng.integers(0, 40, size=50)
    order = rng.permutation(50)
    first, cuts, n = cells._cut(order, rows_in, most)
    held = np.zeros(n)
    for cell in range(50):
        held[first[cell] : first[cell] + cuts[cell]] += -(-rows_in[cell] // cuts[cell])
    assert held.max() <= most and held.sum() >= rows_in.sum()


@pytest.mark.parametrize("scale, shift, width", [(1, 0, 6), (1e-4, 1e3, 64), (1e25, 0, 3), (1, 0, 40_000)])
def test_manhattan_stand_ins_stay_within_their_bound(scale, shift, width):
    rng = np.random.default_rng(25)
    left, right = (rng.normal(size=(n, width)) * scale + shift for n in (70, 90))
    right[:5], left[0], right[-1] = left[:5], left[0] * 3, right[-1] * 3
    near, noise = distances.compared("manhattan", left, right)
    exact = np.abs(left[:, None] - right[None]).sum(axis=2)
    assert np.all(np.abs(near - exact) <= noise[:, None])
    if width < 100 and shift == 0:
        assert near.dtype == np.float32


def test_manhattan_neighbours_with_far_values_and_copies(make):
    rng = np.random.default_rng(26)
    base = rng.normal(size=(300, 6))
    base[::4], base[7], base[9, 2] = base[1], 1e9, -1e30
    df = make(base, parts=5)
    expected = brute(base, base, 9, METRICS["manhattan"], skip_self=True)
    for sizes in ({}, {"small_bytes": 0, "block_bytes": 2000}):
        assert found(neighbours.nearest(df, df, 9, "manhattan", skip_self=True, **sizes)) == expected


def test_far_cells_are_skipped():
    x, _ = blobs(seed=4, per=50, centers=8, dims=4, spread=0.2)
    pivots = x[::50]
    tree = cells.PivotTree("euclidean", pivots)
    cell, gap = tree.home(x)
    radius = np.array([gap[cell == c].max() for c in range(8)])
    near = np.array([np.sort(gap[cell == c])[:5] for c in range(8)])
    row, visited = tree.visits(x, radius, near, 5)
    assert len(row) < 2 * len(x) and np.all(np.isin(np.arange(len(x)) * 8 + cell, row * 8 + visited))


def test_sparse_neighbours(make):
    rng = np.random.default_rng(10)
    base = np.where(rng.random((60, 12)) < 0.3, rng.normal(size=(60, 12)), 0)
    df = make(base)
    got = neighbours.nearest(
        layout.to_sparse(df), layout.to_sparse(df), 4, skip_self=True, sparse=True, width=12
    )
    assert found(got) == brute(base, base, 4, METRICS["euclidean"], skip_self=True)


def test_ties_go_to_low_ids_and_small_labels(make):
    base = make([[0.0], [0.0], [2.0], [2.0]], [3, 1, 2, 1])
    model = neighbours.NearestNeighbours(4).fit(base)
    assert model.predict(make([[1.0]])).head()["prediction"] == 1
    model = neighbours.NearestNeighbours(2).fit(make([[0.0], [2.0]], [5, 4]))
    assert model.predict(make([[1.0]])).head()["prediction"] == 4
    assert found(neighbours.nearest(make([[1.0]]), base, 2)) == {0: [0, 1]}


def test_large_training_tables_give_the_same_votes(make, monkeypatch):
    x, y = blobs(per=30, spread=4.0)
    df = make(x, y)
    for form in (df, layout.to_sparse(df)):
        sparse = "idx" in form.columns
        model = neighbours.NearestNeighbours(7).fit(form, sparse=sparse, width=6)
        here = {(r["id"], r["label"], r["prediction"]) for r in model.predict(form).collect()}
        with monkeypatch.context() as patch:
            patch.setattr(neighbours.blocks, "SMALL_SIDE_BYTES", 0)
            moved = {(r["id"], r["label"], r["prediction"]) for r in model.predict(form).collect()}
        assert here == moved and len(here) == len(y)


def test_one_neighbour_on_train_is_perfect(make):
    x, y = blobs()
    df = make(x, y)
    pred = neighbours.NearestNeighbours(1).fit(df).predict(df)
    assert pred.count() == len(y) and pred.filter("label <> prediction").count() == 0
    with pytest.raises(ValueError):
        neighbours.NearestNeighbours(1, "nearby")


def test_macro_rules_for_absent_classes(spark):
    rows = [(0, 0), (0, 0), (0, 2), (1, 1), (1, 0)]
    row = scores.classification_scores(spark.createDataFrame(rows, "label int, prediction int")).head()
    assert row["accuracy"] == pytest.approx(3 / 5)
    assert row["balanced_accuracy"] == pytest.approx((2 / 3 + 1 / 2) / 2)
    assert row["macro_recall"] == pytest.approx((2 / 3 + 1 / 2 + 0) / 3)
    assert row["macro_precision"] == pytest.approx((2 / 3 + 1 + 0) / 3)
    assert row["macro_f1"] == pytest.approx((2 / 3 + 2 / 3 + 0) / 3)
    assert row["weighted_f1"] == pytest.approx((2 / 3 * 3 + 2 / 3 * 2) / 5)


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([(0, 5), (0, 5), (1, 6), (1, 6)], (1.0, 1.0, 1.0)),
        ([(0, 5), (0, 5), (1, 5), (1, 5)], (0.0, 0.0, 0.5)),
        ([(0, 5), (0, 5)], (1.0, 1.0, 1.0)),
        ([(0, 1), (1, 2), (2, 3)], (1.0, 1.0, 1.0)),
    ],
)
def test_agreement_edge_cases(spark, rows, expected):
    row = scores.clustering_agreement(spark.createDataFrame(rows, "label int, cluster int")).head()
    assert (row["ari"], row["nmi"], row["purity"]) == pytest.approx(expected, abs=1e-9)


def test_contingency_counts(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 0)], "label int, cluster int")
    rows = {r["cluster"]: (r["0"], r["1"]) for r in scores.contingency(df).collect()}
    assert rows == {0: (0, 1), 1: (2, 0)}


def silhouette_reference(x, c):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        own = c == c[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][c == o].mean() for o in set(c) if o != c[i])
        out.append((b - a) / max(a, b))
    return np.mean(out)


def test_silhouette_with_a_single_row_cluster(make):
    x, y = blobs(spread=2.0)
    y = np.where(np.arange(len(y)) == 5, 9, y)
    df = make(x, y).withColumnRenamed("label", "cluster")
    expected = silhouette_reference(x, y)
    assert geometry.silhouette(df).head()[0] == pytest.approx(expected)
    assert geometry.silhouette(df, small_bytes=0, block_bytes=2000).head()[0] == pytest.approx(expected)
    assert geometry.silhouette(df.withColumn("cluster", F.lit(1))).head()[0] is None


def test_pair_scores_skip_copies_and_agree_across_paths(make):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(60, 6))
    x[7] = x[3]
    half = x[:, :3]
    df = make(x)
    cut = {"cut": df.withColumn("features", F.slice("features", 1, 3))}
    i, j = np.triu_indices(60, 1)
    d0 = np.sqrt(((x[i] - x[j]) ** 2).sum(axis=1))
    d1 = np.sqrt(((half[i] - half[j]) ** 2).sum(axis=1))
    for sizes in ({}, {"small_bytes": 0, "block_bytes": 1000}):
        kept = geometry.distance_preservation(df, cut, **sizes).head()
        assert kept["distance_preservation"] == pytest.approx(np.corrcoef(d0, d1)[0, 1])
        rows = geometry.distance_distortion(df, cut, bins=10, **sizes).orderBy("bin").collect()
        apart = d0 > 1e-12
        expected, edges = np.histogram(d1[apart] / d0[apart], bins=10)
        assert [r["n"] for r in rows] == list(expected)
        assert np.allclose([r["bin_start"] for r in rows], edges[:-1])


def test_samples_are_drawn_before_the_join(make):
    rng = np.random.default_rng(21)
    df = make(rng.normal(size=(80, 4)))
    both = geometry.paired_sample(df, {"same": df}, 30)
    assert both.count() == 30 and both.filter("original <> same").count() == 0
    kept = geometry.distance_preservation(df, {"same": df}, sample_size=30).head()
    assert kept["distance_preservation"] == pytest.approx(1.0)
