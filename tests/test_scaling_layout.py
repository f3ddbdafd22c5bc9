import numpy as np
import pytest
from conftest import matrix_of

from reduxlab.functions import moments
from reduxlab.functions.matrices import SparseRows
from reduxlab.operators import layout, scaling
from reduxlab.sources.tables import FeatureTable, first_label, highest_label_count


def test_standardizer_uses_population_deviation_and_keeps_constants(make):
    x = np.c_[np.arange(9.0), np.full(9, 3.0), np.zeros(9)]
    scaler = scaling.fit_standardizer(make(x))
    got = matrix_of(scaler.transform(make(x)))
    assert np.allclose(got[:, 0], (x[:, 0] - 4) / x[:, 0].std())
    assert np.all(got[:, 1:] == 0)


def test_channel_normalizer(make):
    x = np.random.default_rng(1).normal(size=(20, 12))
    got = matrix_of(scaling.fit_channel_normalizer(make(x), 3).transform(make(x))).reshape(20, 4, 3)
    images = x.reshape(20, 4, 3)
    assert np.allclose(got, (images - images.mean(axis=(0, 1))) / (images.std(axis=(0, 1)) + 1e-8))


def test_sparse_scalers_with_empty_features(make):
    x = np.where(np.random.default_rng(2).random((30, 5)) < 0.4, np.arange(1, 6) * 1.5, 0.0)
    x[:, 3] = 0.0
    sparse = layout.to_sparse(make(x))
    peak = np.abs(x).max(axis=0)
    peak[3] = 1
    got = matrix_of(layout.to_dense(scaling.fit_max_abs(sparse, 5).transform(sparse), 5))
    assert np.allclose(got, x / peak)
    spread = np.where(x.std(axis=0) == 0, 1, x.std(axis=0))
    got = matrix_of(layout.to_dense(scaling.fit_sparse_deviation(sparse, 5).transform(sparse), 5))
    assert np.allclose(got, x / spread)


@pytest.mark.parametrize("driver_bytes", [None, 0])
def test_moments_survive_a_far_origin_and_any_merge(make, monkeypatch, driver_bytes):
    if driver_bytes is not None:
        monkeypatch.setattr(moments.folds, "DRIVER_BYTES", driver_bytes)
    monkeypatch.setattr(moments, "_CHUNK", 5)
    x = np.random.default_rng(7).normal(size=(211, 12)) * np.arange(1, 13) + 1e6
    mass, mean, m2 = moments.table_moments(make(x, parts=7))
    assert (mass == 211).all() and np.allclose(mean, x.mean(axis=0), rtol=1e-14)
    assert np.allclose(m2 / 211, x.var(axis=0), rtol=1e-9)
    mass, mean, m2 = moments.table_moments(make(x, parts=7), 3)
    images = x.reshape(-1, 3)
    assert (mass == 211 * 4).all() and np.allclose(m2 / mass, images.var(axis=0), rtol=1e-9)
    sparse = layout.to_sparse(make(np.where(x > 1e6 + 1, x, 0)))
    scale = scaling.fit_sparse_deviation(sparse, 14).scale
    assert np.allclose(scale[:12], np.where(x > 1e6 + 1, x, 0).std(axis=0)) and (scale[12:] == 1).all()
    assert np.allclose(scaling.fit_max_abs(sparse).scale, np.where(x > 1e6 + 1, x, 0).max(axis=0))


def test_scalers_of_a_table_without_rows(make, spark):
    empty = spark.createDataFrame([], "id long, features array<double>, label int")
    assert scaling.fit_standardizer(empty).scale.tolist() == []
    none = spark.createDataFrame([(1, [], [], 0)], "id long, idx array<int>, val array<double>, label int")
    assert scaling.fit_max_abs(none, 3).scale.tolist() == [1.0] * 3
    assert scaling.fit_sparse_deviation(none, 3).scale.tolist() == [1.0] * 3


def test_forms_round_trip(make):
    x = np.array([[0, 1.5, 0], [0, 0, 0], [2, 0, -3.0]])
    table = FeatureTable("t", make(x), 3, 1, "dense_sensor")
    sparse = layout.force_form(table, "sparse")
    assert sparse.sparse and np.array_equal(matrix_of(layout.force_form(sparse, "dense").df), x)
    assert layout.force_form(table, None) is table
    with pytest.raises(ValueError):
        layout.force_form(table, "diagonal")


def test_channel_orders_are_inverse(make):
    x = np.arange(24.0).reshape(1, 24)
    last = layout.channels_last(make(x), 2, 4, 3)
    assert np.array_equal(matrix_of(last)[0], x.reshape(3, 2, 4).transpose(1, 2, 0).ravel())
    assert np.array_equal(matrix_of(layout.channels_first(last, 2, 4, 3)), x)


def test_repeated_names_are_numbered(spark):
    df = spark.createDataFrame(list(enumerate(["a", "b", "a", "a"])), "pos long, name string")
    got = [r["unique_name"] for r in layout.unique_names(df, "pos", "name").orderBy("pos").collect()]
    assert got == ["a", "b", "a_2", "a_3"]


def test_occurrences_count_across_spans(spark):
    df = spark.range(1000).selectExpr("id", "case when id % 3 = 0 then 'hot' else 'cold' end as name")
    rows = layout.occurrence_number(df, "id", "name", span_rows=17).filter("name = 'hot'").orderBy("id").collect()
    assert [r["nth"] for r in rows] == list(range(1, 335))


def test_first_label_drops_empty_sets(spark):
    df = spark.createDataFrame([(1, [4, 2]), (2, []), (3, [0])], "id long, labels array<int>")
    got = first_label(df)
    assert {(r["id"], r["label"]) for r in got.collect()} == {(1, 2), (3, 0)}
    assert highest_label_count(got) == 3


def test_sparse_products_match_dense():
    rng = np.random.default_rng(3)
    x = np.where(rng.random((40, 30)) < 0.1, rng.normal(size=(40, 30)), 0)
    x[5] = x[39] = 0
    pointers = np.r_[0, np.cumsum((x != 0).sum(axis=1))]
    rows = SparseRows(pointers, np.nonzero(x)[1], x[x != 0])
    w, v = rng.normal(size=(30, 4)), rng.normal(size=(40, 3))
    assert np.allclose(rows.dot(w), x @ w)
    assert np.allclose(rows.transposed_dot(v, 30), x.T @ v)
    picked = rows.take(np.array([39, 3, 5, 3]))
    assert np.allclose(picked.to_matrix(30), x[[39, 3, 5, 3]])
