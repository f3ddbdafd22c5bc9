import numpy as np
import pytest
from conftest import blobs
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from reduxlab.errors import ModelError
from reduxlab.functions.matrices import DenseRows
from reduxlab.operators import layout, linear_svm, mlp
from reduxlab.operators.linear_svm import HingeSGD, SquaredHingeSVM
from reduxlab.operators.mlp import NeuralNetwork, Settings
from reduxlab.operators.models import make_model


def accuracy(df, pred):
    both = df.select("id", "label").join(pred.select("id", "prediction"), "id")
    return both.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).head()[0]


def objective(x, y, w, cost):
    signs = np.where(y[:, None] == np.arange(w.shape[1])[None, :], 1.0, -1.0)
    short = np.maximum(0, 1 - signs * (x @ w[:-1] + w[-1]))
    slope = np.vstack([x.T @ (-2 * cost * signs * short), (-2 * cost * signs * short).sum(axis=0)]) + w
    return 0.5 * (w**2).sum() + cost * (short**2).sum(), slope


@pytest.fixture(scope="module")
def overlap():
    return blobs(seed=3, per=50, centers=3, dims=5, spread=4.0)


def test_squared_hinge_pass_matches_numpy(make, overlap):
    x, y = overlap
    w = np.random.default_rng(0).normal(size=(6, 3)) / 3
    losses, slope, curvature = linear_svm.squared_hinge(make(x, y), w, np.arange(3), 0.7, curved=True)
    expected, expected_slope = objective(x, y, w, 0.7)
    assert losses.sum() == pytest.approx(expected) and np.allclose(slope, expected_slope)
    moved = w.copy()
    moved[2, 1] += 1e-7
    change = (objective(x, y, moved, 0.7)[1] - expected_slope)[:, 1] / 1e-7
    assert np.allclose(curvature[1][:, 2], change, rtol=1e-4, atol=1e-3)


def solved(x, y, classes, cost):
    """The same problem by Newton steps in NumPy, with a system of rows instead of features."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    gram, out = x1 @ x1.T, np.zeros((x1.shape[1], classes))
    for c in range(classes):
        sign, active = np.where(y == c, 1.0, -1.0), np.ones(len(x), dtype=bool)
        for _ in range(100):
            rows = np.flatnonzero(active)
            dual = np.linalg.solve(gram[np.ix_(rows, rows)] + np.eye(len(rows)) / (2 * cost), sign[rows])
            out[:, c] = x1[rows].T @ dual
            now = sign * (x1 @ out[:, c]) < 1
            if (now == active).all():
                break
            active = now
        else:
            raise AssertionError("the active rows did not settle")
    return out


@pytest.mark.parametrize(("dims", "block"), [(64, 4_000_000), (64, 4160), (5000, 4_000_000)])
def test_squared_hinge_weights_match_a_numpy_solve(make, monkeypatch, dims, block):
    monkeypatch.setattr(linear_svm, "BLOCK_VALUES", block)
    rng = np.random.default_rng(dims)
    y = np.arange(240) % 3
    x = rng.normal(size=(240, dims)) * rng.uniform(0.2, 3, size=dims) + 0.3 * y[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None] / 3
    expected = solved(x, y, 3, 0.5)
    tight = SquaredHingeSVM(C=0.5, tol=1e-9).fit(make(x, y)).weights
    assert np.allclose(tight, expected, atol=1e-6)
    usual = SquaredHingeSVM(C=0.5).fit(make(x, y)).weights
    assert np.allclose(usual, expected, atol=2e-3 * np.abs(expected).max())


def test_wide_products_need_few_passes(make, monkeypatch):
    x, y = blobs(seed=9, per=60, centers=3, dims=40, spread=5.0)
    passes = []
    product = linear_svm.curvature_products
    monkeypatch.setattr(linear_svm, "BLOCK_VALUES", 41 * 41)
    monkeypatch.setattr(linear_svm, "curvature_products", lambda *a, **b: passes.append(1) or product(*a, **b))
    model = SquaredHingeSVM(scale_dense=True).fit(make(x, y))
    scaled = (x - x.mean(axis=0)) / x.std(axis=0)
    assert 0 < len(passes) < 150
    _, slope = objective(scaled, y, model.weights, 1.0)
    _, first = objective(scaled, y, np.zeros_like(model.weights), 1.0)
    assert (np.linalg.norm(slope, axis=0) <= 1.1e-4 * np.linalg.norm(first, axis=0)).all()


def test_squared_hinge_reaches_the_optimum(make, overlap):
    x, y = overlap
    model = SquaredHingeSVM(C=0.5, tol=1e-9).fit(make(x, y))
    value, slope = objective(x, y, model.weights, 0.5)
    assert np.linalg.norm(slope) < 1e-6 * value
    scaled = SquaredHingeSVM(scale_dense=True).fit(make(x * 100, y))
    assert scaled.scaler is not None and accuracy(make(x, y), scaled.predict(make(x * 100, y))) > 0.6


def test_two_classes_and_sparse_rows(make):
    x, y = blobs(centers=2)
    x = np.where(np.abs(x) > 1, x, 0)
    df = make(x, y * 5 + 2)
    dense = SquaredHingeSVM().fit(df)
    sparse = SquaredHingeSVM().fit(layout.to_sparse(df), sparse=True, width=6)
    assert np.allclose(dense.weights, sparse.weights, atol=1e-3)
    assert accuracy(df, sparse.predict(layout.to_sparse(df))) == 1.0


@pytest.mark.parametrize("schedule", ["constant", "invscaling", "adaptive"])
def test_schedules_start_from_eta0(make, schedule):
    x, y = blobs(seed=2, per=40, centers=3)
    model = HingeSGD(learning_rate=schedule, eta0=0.05, max_iter=40, rows_per_worker=50).fit(make(x, y))
    assert accuracy(make(x, y), model.predict(make(x, y))) > 0.95
    assert model.params()["learning_rate"] == schedule and model.params()["eta0"] == 0.05


def test_step_sizes_and_unknown_schedules(make):
    sizes = np.array([0.2, 0.1])
    assert linear_svm.step_sizes("optimal", 0.5, sizes, 4) == 0.5
    assert linear_svm.step_sizes("constant", 0.5, sizes, 4) is sizes
    assert np.allclose(linear_svm.step_sizes("invscaling", 0.5, sizes, 4), [0.1, 0.05])
    for wrong in ({"learning_rate": "falling"}, {"learning_rate": "constant", "eta0": 0.0}):
        with pytest.raises(ValueError):
            HingeSGD(**wrong)


def test_adaptive_steps_shrink_before_a_class_stops(make):
    x, y = blobs(seed=2, per=30, centers=2)
    shared = dict(alpha=1e-3, early_stopping=False, n_iter_no_change=1, tol=1e9, max_iter=200)
    plain = HingeSGD(learning_rate="constant", eta0=0.01, **shared).fit(make(x, y))
    adaptive = HingeSGD(learning_rate="adaptive", eta0=0.01, **shared).fit(make(x, y))
    assert plain.epochs == 1 and adaptive.epochs == 1 + 6  # 0.01 is divided six times until it is 6.4e-7


def test_hinge_descent_comes_close_to_spark(make):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 5))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=300) > 0).astype(int)
    df = make(x, y, parts=1)
    alpha = 0.1
    other = LinearSVC(regParam=alpha, standardization=False, maxIter=200, tol=1e-10).fit(
        df.select(array_to_vector("features").alias("features"), F.col("label").cast("double"))
    )
    best = np.append(other.coefficients.toArray(), other.intercept)[:, None]
    target = linear_svm.hinge_objective(df, np.hstack([-best, best]), np.arange(2), alpha)
    model = HingeSGD(alpha=alpha, max_iter=30, early_stopping=False).fit(df)
    got = linear_svm.hinge_objective(df, model.weights, np.arange(2), alpha)
    assert np.all(got < target * 1.001) and np.all(got > target * 0.999)


def test_hinge_descent_stops_early_and_takes_sparse_rows(make):
    x, y = blobs(per=60)
    df = make(x, y)
    model = HingeSGD(alpha=1e-3, max_iter=50).fit(df)
    assert model.epochs < 50 and accuracy(df, model.predict(df)) > 0.97
    sparse = layout.to_sparse(df)
    model = HingeSGD(alpha=1e-3, max_iter=10, scale_dense=True).fit(sparse, sparse=True, width=6)
    assert accuracy(df, model.predict(sparse)) > 0.97


def test_hinge_descent_is_the_same_on_sparse_rows(make):
    x, y = blobs(per=30, spread=5.0)
    x = np.where(np.abs(x) > 2, x, 0)
    df = make(x, y, parts=1).orderBy("id").coalesce(1)
    dense = HingeSGD(alpha=1e-2, max_iter=3, early_stopping=False).fit(df)
    sparse = HingeSGD(alpha=1e-2, max_iter=3, early_stopping=False).fit(layout.to_sparse(df), sparse=True, width=6)
    assert np.allclose(dense.weights, sparse.weights)


def test_averaged_weights_match_the_plain_sums():
    rng = np.random.default_rng(2)
    start, x = rng.normal(size=(5, 2)), rng.normal(size=(30, 4))
    averaged, plain, total = linear_svm._Averaged(start), start.copy(), np.zeros((5, 2))
    for row in x:
        push, shrink = rng.normal(size=(1, 2)), rng.uniform(0.8, 1.0, 2)
        averaged.step(DenseRows(row[None]), push, shrink)
        plain[:-1] = plain[:-1] * shrink + np.outer(row, push)
        plain[-1] += push[0]
        total += plain
    assert np.allclose(averaged.current(), plain) and np.allclose(averaged.mean(), total / 30)


def test_network_slopes_match_finite_differences():
    rng = np.random.default_rng(1)
    shapes = mlp.layer_shapes(6, 5, 3)
    weights = mlp.initial_weights(shapes, 2)
    x, y = DenseRows(rng.normal(size=(9, 6))), rng.integers(0, 3, 9)
    mask = (rng.random((9, 5)) > 0.3) / 0.7
    _, slopes, _ = mlp.loss_and_slopes(x, y, mlp.split_layers(weights, shapes), mask)
    for at in rng.choice(len(weights), 40, replace=False):
        moved = [weights.copy(), weights.copy()]
        moved[0][at] += 1e-6
        moved[1][at] -= 1e-6
        up, down = (mlp.loss_and_slopes(x, y, mlp.split_layers(w, shapes), mask)[0] for w in moved)
        assert slopes[at] == pytest.approx((up - down) / 2e-6, abs=1e-6)
    bound = 1 / np.sqrt(6)
    assert np.abs(mlp.split_layers(weights, shapes)[0]).max() <= bound


def test_network_learns_and_stops_early(make):
    x, y = blobs(per=80)
    df = make(x, y)
    model = NeuralNetwork(4, Settings(hidden_dim=16, epochs=40, batch_size=16, lr=1e-2, patience=3)).fit(df)
    assert model.best_val_acc > 0.97 and len(model.history) < 40
    assert accuracy(df, model.predict(df)) > 0.97
    assert model.history[0]["loss"] > model.history[-1]["loss"]
    assert model.params()["num_parameters"] == 6 * 16 + 16 + 16 * 32 + 32 + 32 * 4 + 4


def test_network_without_validation_uses_all_epochs(make):
    x, y = blobs()
    settings = Settings(hidden_dim=8, epochs=4, batch_size=32, early_stopping=False, dropout=0.0)
    model = NeuralNetwork(4, settings).fit(make(x, y))
    assert len(model.history) == 4 and model.best_epoch is None


def test_network_on_sparse_rows(make):
    x, y = blobs(per=60)
    sparse = layout.to_sparse(make(x, y))
    settings = Settings(hidden_dim=16, epochs=25, batch_size=16, lr=1e-2, patience=25)
    model = NeuralNetwork(4, settings).fit(sparse, sparse=True, width=6)
    assert accuracy(make(x, y), model.predict(sparse)) > 0.95
    with pytest.raises(ModelError):
        model.predict(make(x, y))
    filled = NeuralNetwork(4, Settings(hidden_dim=8, epochs=2, allow_sparse_to_dense=True))
    filled.fit(sparse, sparse=True, width=6)
    assert filled.predict(sparse).count() == len(y)


def test_models_by_name():
    assert make_model("KNN", 3, knn_neighbors=7).params() == {"n_neighbors": 7, "metric": "auto"}
    assert make_model("svm_sgd", 3, svm_scale_dense=True).scale_dense
    assert make_model("dnn", 3, dnn_early_stopping=False).settings.early_stopping is False
    with pytest.raises(ValueError):
        make_model("forest", 3)
