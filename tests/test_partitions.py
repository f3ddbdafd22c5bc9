import numpy as np
import pytest
from conftest import blobs, matrix_of

from reduxlab.operators import featurize, partitions, scores


def agreement(df):
    return scores.clustering_agreement(df).head()


def test_kmeans_recovers_blobs(make):
    x, y = blobs()
    df = make(x, y)
    model = partitions.KMeans(4, n_init=5).fit(df)
    assert agreement(model.transform(df))["ari"] == pytest.approx(1.0)
    centers = np.array([x[y == c].mean(axis=0) for c in range(4)])
    assert model.inertia == pytest.approx(((x - centers[y]) ** 2).sum())


def test_restarts_do_not_depend_on_the_layout(make):
    x, y = blobs(spread=3.0)
    one = partitions.KMeans(4, n_init=3).fit(make(x, y, parts=1))
    many = partitions.KMeans(4, n_init=3).fit(make(x, y, parts=6))
    assert np.allclose(one.all_centers, many.all_centers)


def test_draws_merged_inside_spark_are_the_same(make, monkeypatch):
    x, y = blobs(spread=3.0)
    df = make(x, y, parts=5)
    expected = partitions.seed_centers(df, 4, 3, 7)
    monkeypatch.setattr(partitions.folds, "DRIVER_BYTES", 0)
    assert np.array_equal(partitions.seed_centers(df, 4, 3, 7), expected)


def test_seeding_prefers_distant_rows(make):
    x = np.r_[np.zeros((50, 2)), [[9.0, 9.0]], [[-9.0, 9.0]]]
    centers = partitions.seed_centers(make(x), 3, 4, 1)
    for found in centers:
        assert {tuple(c) for c in found} == {(0.0, 0.0), (9.0, 9.0), (-9.0, 9.0)}


def test_passes_do_not_grow_with_the_number_of_centers(make, monkeypatch):
    x, _ = blobs(per=60, centers=6)
    df = make(x)
    passes = []
    draw, fold = partitions._draw, partitions.folds.folded
    monkeypatch.setattr(partitions, "_draw", lambda *a: passes.append("draw") or draw(*a))
    monkeypatch.setattr(partitions.folds, "folded", lambda *a, **b: passes.append("fold") or fold(*a, **b))
    for k in (2, 40):
        passes.clear()
        assert partitions.seed_centers(df, k, 2, 1).shape == (2, k, x.shape[1])
        assert passes == ["draw"] * 6 + ["fold"]


def test_more_centers_than_rows(make):
    x = np.array([[0.0, 1.0], [2.0, 3.0], [0.0, 1.0]])
    assert {tuple(c) for c in partitions.seed_centers(make(x), 5, 1, 3)[0]} == {(0.0, 1.0), (2.0, 3.0)}


def test_seeds_are_close_to_the_best_centers(make):
    x, y = blobs(seed=5, per=50, centers=12, spread=0.2)
    best = sum(((x[y == c] - x[y == c].mean(axis=0)) ** 2).sum() for c in range(12))
    for centers in partitions.seed_centers(make(x), 12, 4, 2):
        assert partitions.square_distances(x, centers).min(axis=1).sum() < 1.5 * best


def test_row_uniforms_look_uniform():
    u = partitions.row_uniforms(np.arange(20_000), 3, 5)
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.005
    v = partitions.row_uniforms(np.arange(20_000), 3, 6)
    assert abs(np.corrcoef(u, v)[0, 1]) < 0.03


def test_mixture_step_matches_numpy_and_likelihood_grows(make):
    x, y = blobs(spread=2.0, dims=4)
    df = make(x, y)
    start = partitions.Mixture(np.full(4, 0.25), x[[0, 50, 90, 130]], np.full((4, 4), 2.0))
    after, bound = partitions.em_step(df, start)
    logs = np.log(0.25) - 0.5 * (
        ((x[:, None] - start.means[None]) ** 2 / 2.0).sum(axis=2) + 4 * np.log(2 * np.pi) + 4 * np.log(2.0)
    )
    total = np.log(np.exp(logs).sum(axis=1))
    r = np.exp(logs - total[:, None])
    assert bound == pytest.approx(total.mean())
    means = (r.T @ x) / r.sum(axis=0)[:, None]
    assert np.allclose(after.means, means)
    assert np.allclose(after.variances, (r.T @ (x * x)) / r.sum(axis=0)[:, None] - means**2 + 1e-4)
    model = partitions.GaussianMixture(4, n_init=2).fit(df)
    for bounds in model.history:
        assert all(b >= a - 1e-3 for a, b in zip(bounds, bounds[1:]))


def test_a_far_origin_changes_nothing(make):
    x, y = blobs(spread=1.5, dims=4)
    near, far = (partitions.GaussianMixture(4, n_init=2).fit(make(x + shift)) for shift in (0.0, 1e6))
    assert np.allclose(far.mixture.means - 1e6, near.mixture.means, atol=1e-5)
    assert np.allclose(far.mixture.variances, near.mixture.variances, rtol=1e-4)
    assert np.allclose(far.mixture.weights, near.mixture.weights, atol=1e-6)
    near, far = (partitions.KMeans(4, n_init=2).fit(make(x + shift)) for shift in (0.0, 1e6))
    assert np.allclose(far.centers - 1e6, near.centers, atol=1e-6)


def test_mixture_recovers_blobs_with_a_constant_feature(make):
    x, y = blobs()
    x[:, 2] = 1.0
    df = make(x, y)
    assert agreement(partitions.GaussianMixture(4).fit(df).transform(df))["ari"] == pytest.approx(1.0)


def hog_reference(image, orientations=9, cell=4):
    h, w = image.shape
    gy, gx = np.zeros_like(image), np.zeros_like(image)
    for r in range(h):
        for c in range(w):
            if 0 < r < h - 1:
                gy[r, c] = image[r + 1, c] - image[r - 1, c]
            if 0 < c < w - 1:
                gx[r, c] = image[r, c + 1] - image[r, c - 1]
    cells = np.zeros((h // cell, w // cell, orientations))
    for r in range(h):
        for c in range(w):
            angle = np.degrees(np.arctan2(gy[r, c], gx[r, c])) % 180
            cells[r // cell, c // cell, int(angle // (180 / orientations))] += np.hypot(gx[r, c], gy[r, c]) / cell**2
    out = []
    for r in range(h // cell - 1):
        for c in range(w // cell - 1):
            v = cells[r : r + 2, c : c + 2].ravel()
            v = np.minimum(v / np.sqrt((v**2).sum() + 1e-10), 0.2)
            out.append(v / np.sqrt((v**2).sum() + 1e-10))
    return np.concatenate(out)


def test_gradient_histograms(make):
    x = np.random.default_rng(4).random((5, 28 * 28))
    got = matrix_of(featurize.hog(make(x), 28, 28))
    assert got.shape == (5, 1296)
    assert np.allclose(got, [hog_reference(row.reshape(28, 28)) for row in x])


def test_batches_stay_small(make):
    x = np.random.default_rng(5).random((300, 4))

    def network(rows):
        assert len(rows) <= 128
        return rows.sum(axis=1, keepdims=True) * len(rows[0])

    assert np.allclose(matrix_of(featurize.featurize(make(x, parts=1), network))[:, 0], x.sum(axis=1) * 4)


def test_resizing_keeps_constants_and_halves():
    assert np.allclose(featurize.resize_matrix(4, 9).sum(axis=0), 1)
    assert np.allclose(np.array([0.0, 2.0, 4.0, 6.0]) @ featurize.resize_matrix(4, 2), [1.0, 5.0])
