import numpy as np
import pytest
from conftest import matrix_of

from reduxlab.errors import ReductionError
from reduxlab.functions import folds
from reduxlab.operators import layout, projection, reducers, spectral
from reduxlab.sources.tables import FeatureTable


def table(df, width, shape=None, sparse=False):
    return FeatureTable("t", df, width, 2, "dense_image" if shape else "dense_sensor", shape, sparse)


def cosine_reference(x):
    n = x.shape[-1]
    i = np.arange(n)
    basis = np.cos(np.pi * (2 * i[:, None] + 1) * i[None, :] / (2 * n)) * np.sqrt(2 / n)
    basis[:, 0] /= np.sqrt(2)
    return x @ basis


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(5)
    return rng.normal(size=(120, 20)) @ np.diag(np.linspace(3, 0.2, 20)) + 1.0


def test_cosine_transform_keeps_norms(make, x):
    got = matrix_of(reducers.make_reducer("DCT", 20).setup(table(make(x), 20)).fit_transform(make(x)))
    assert np.allclose(got, cosine_reference(x))
    assert np.allclose((got**2).sum(axis=1), (x**2).sum(axis=1))


def test_image_transform_order_and_limits(make):
    x = np.random.default_rng(6).normal(size=(4, 24))
    images = x.reshape(4, 2, 4, 3)
    both = np.moveaxis(cosine_reference(np.moveaxis(images, 2, 3)), 3, 2)
    both = np.moveaxis(cosine_reference(np.moveaxis(both, 1, 3)), 3, 1)
    t = table(make(x), 24, (2, 4, 3))
    got = matrix_of(reducers.make_reducer("dct", 7).setup(t).fit_transform(t.df))
    order = [(0, 0, 0), (0, 0, 1), (0, 0, 2), (0, 1, 0), (0, 1, 1), (0, 1, 2), (1, 0, 0)]
    assert np.allclose(got, np.array([[img[o] for o in order] for img in both]))
    with pytest.raises(ReductionError):
        reducers.make_reducer("dct", 25).setup(t).fit(t.df)
    flat = reducers.make_reducer("dct", 24, dct_mode="1d").setup(t).fit_transform(t.df)
    assert np.allclose(matrix_of(flat), cosine_reference(x))
    with pytest.raises(ReductionError):
        reducers.make_reducer("dct", 2).setup(table(make(x), 24, (24,))).fit(t.df)


def test_projections_keep_lengths_on_average(make):
    x = np.random.default_rng(7).normal(size=(200, 64))
    for name in ("gaussian_rp", "sparse_rp"):
        got = matrix_of(reducers.make_reducer(name, 48, 3).setup(table(make(x), 64)).fit_transform(make(x)))
        ratio = (got**2).sum(axis=1) / (x**2).sum(axis=1)
        assert abs(ratio.mean() - 1) < 0.15


def filled(sparse_map, input_dim):
    out = np.zeros((input_dim, sparse_map.n_components))
    out[np.repeat(np.arange(input_dim), np.diff(sparse_map.starts)), sparse_map.outputs] = sparse_map.signs * sparse_map.size
    return out


def test_projection_weights_have_the_wanted_law(spark):
    w = projection.gaussian_weights(spark, 100, 41, 1)
    assert w.shape == (100, 41) and abs(w.std() * np.sqrt(41) - 1) < 0.03 and abs(w.mean()) < 0.01
    s = filled(projection.sparse_map(spark, 100, 40, 1), 100)
    assert abs((s != 0).mean() - 0.1) < 0.02
    assert set(np.round(np.unique(s), 9)) == {0.0, *np.round([-(0.25**0.5), 0.25**0.5], 9)}
    assert not np.array_equal(w, projection.gaussian_weights(spark, 100, 41, 2))


def test_matrices_made_by_tasks_are_the_same(spark, monkeypatch):
    w, s = projection.gaussian_weights(spark, 90, 7, 3), projection.sparse_map(spark, 90, 7, 3)
    u = projection.seeded_uniforms("srp", 3, 0, 90, 7)[:, :7]
    density = 1 / np.sqrt(90)
    expected = np.where(u < density / 2, 1.0, np.where(u < density, -1.0, 0.0)) / np.sqrt(density * 7)
    assert np.allclose(filled(s, 90), expected)
    monkeypatch.setattr(projection, "_MADE_AT_ONCE", 40)
    assert np.array_equal(projection.gaussian_weights(spark, 90, 7, 3), w)
    assert np.array_equal(filled(projection.sparse_map(spark, 90, 7, 3), 90), filled(s, 90))


def test_compressed_projection_matches_its_matrix(make, spark):
    x = np.random.default_rng(8).normal(size=(50, 6))
    x[np.abs(x) < 0.7] = 0
    made = projection.sparse_map(spark, 6, 90, 4)
    expected = x @ filled(made, 6)
    assert (np.abs(filled(made, 6)).sum(axis=0) == 0).any()
    assert np.allclose(matrix_of(made.transform(make(x))), expected)
    assert np.allclose(matrix_of(made.transform(layout.to_sparse(make(x)), sparse=True)), expected)
    assert made.transform(make(x).limit(0)).collect() == []


def test_reducers_must_be_set_up(make, x):
    for name in ("gaussian_rp", "sparse_rp"):
        with pytest.raises(RuntimeError):
            reducers.make_reducer(name, 3).fit(make(x))
        with pytest.raises(RuntimeError):
            reducers.make_reducer(name, 3).transform(make(x))
    with pytest.raises(ValueError):
        reducers.make_reducer("umap", 3)


def test_pca_matches_numpy(make, x):
    t = table(make(x), 20)
    reducer = reducers.make_reducer("pca_svd", 5).setup(t)
    got = matrix_of(reducer.fit_transform(t.df))
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs((x - x.mean(axis=0)) @ vt[:5].T))
    axes = reducer.map.weights
    assert np.all(axes[np.abs(axes).argmax(axis=0), np.arange(5)] > 0)
    variances = spectral.full_components(t.df, 20, 5)[2]
    assert np.allclose(variances, s[:5] ** 2 / 119)


def test_pca_error_falls_with_k(make, x):
    errors = []
    for k in (2, 6, 12):
        mean, axes, _ = spectral.full_components(make(x), 20, k)
        centred = x - mean
        errors.append(((centred - centred @ axes @ axes.T) ** 2).sum())
    assert errors[0] > errors[1] > errors[2]


def test_pca_refuses_sparse_and_too_many_components(make, x):
    sparse = table(layout.to_sparse(make(x)), 20, sparse=True)
    with pytest.raises(ReductionError):
        reducers.make_reducer("pca_svd", 3).setup(sparse).fit(sparse.df)
    allowed = reducers.make_reducer("pca_svd", 3, allow_dense_sparse_pca=True).setup(sparse)
    dense = reducers.make_reducer("pca_svd", 3).setup(table(make(x), 20))
    assert np.allclose(matrix_of(allowed.fit_transform(sparse.df)), matrix_of(dense.fit_transform(make(x))))
    with pytest.raises(ReductionError):
        spectral.full_components(make(x), 20, 21)


@pytest.mark.parametrize("kept", [8, 3])
def test_axes_without_a_covariance_are_the_same(make, x, monkeypatch, kept):
    exact = spectral.full_components(make(x), 20, 3)
    monkeypatch.setattr(spectral, "MAX_COVARIANCE_DIM", 10)
    monkeypatch.setattr(spectral, "KEPT_BLOCKS", kept)
    monkeypatch.setattr(spectral, "OVERSAMPLES", 2)
    for got, expected in zip(spectral.full_components(make(x), 20, 3), exact):
        assert np.allclose(got, expected, atol=1e-7)
    with pytest.raises(ReductionError):
        spectral.full_components(make(x[:3]), 20, 4)
    few = spectral.full_components(make(x[:4]), 20, 4)
    assert np.allclose(few[1].T @ few[1], np.eye(4)) and few[2][3] < 1e-9


def test_twenty_thousand_features(make):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(36, 12)) * np.linspace(6, 1, 12) @ rng.normal(size=(12, 20_000)) + rng.normal(size=(36, 20_000))
    mean, axes, variances = spectral.full_components(make(x), 20_000, 5)
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(variances, s[:5] ** 2 / 35)
    assert np.allclose(np.abs((axes * vt[:5].T).sum(axis=0)), 1, atol=1e-9)


def test_randomised_solvers_match_numpy(make, x):
    t = table(make(x), 20)
    got = matrix_of(reducers.make_reducer("randomized_svd", 4, randomized_svd_iter=12).setup(t).fit_transform(t.df))
    _, _, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(x @ vt[:4].T), atol=1e-5)
    got = matrix_of(reducers.make_cluster_reducer("PCA", 4).setup(t).fit_transform(t.df))
    _, _, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs((x - x.mean(axis=0)) @ vt[:4].T), atol=1e-3)


def test_sparse_rows_give_the_dense_result(make, x):
    x = np.where(np.abs(x) > 0.8, x, 0)
    dense, sparse = table(make(x), 20), table(layout.to_sparse(make(x)), 20, sparse=True)
    for name in ("gaussian_rp", "dct", "randomized_svd"):
        a = reducers.make_reducer(name, 4).setup(dense).fit_transform(dense.df)
        b = reducers.make_reducer(name, 4).setup(sparse).fit_transform(sparse.df)
        assert np.allclose(matrix_of(a), matrix_of(b), atol=1e-6)
    kept = reducers.make_reducer("sparse_rp", 4).setup(sparse)
    out = kept.fit_transform(sparse.df)
    assert kept.sparse_output() and set(out.columns) == {"id", "label", "idx", "val"}
    plain = reducers.make_reducer("sparse_rp", 4).setup(dense).fit_transform(dense.df)
    assert np.allclose(matrix_of(layout.to_dense(out, 4)), matrix_of(plain))


def test_large_states_are_added_inside_spark(make, x, monkeypatch):
    expected = np.cov(x.T)
    monkeypatch.setattr(folds, "DRIVER_BYTES", 0)
    monkeypatch.setattr(folds, "_CHUNK", 64)
    assert np.allclose(spectral.covariance(make(x, parts=7), 20)[2], expected)


def test_oversized_broadcasts_are_refused(make, x, monkeypatch):
    monkeypatch.setattr(folds, "BROADCAST_BYTES", 100)
    with pytest.raises(ValueError):
        projection.project(make(x), np.ones((20, 3)))


def test_dims_beyond_the_data_are_skipped():
    assert reducers.feasible_dims([None, 5, 20, 21], 20) == [None, 5, 20]
