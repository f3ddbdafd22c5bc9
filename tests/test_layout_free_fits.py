"""Fits, limits and scratch folders that must not depend on partitions, cores or sizes."""

import numpy as np
import pytest
from conftest import blobs
from pyspark.errors import PySparkException

from reduxlab import session
from reduxlab.functions import folds
from reduxlab.operators import layout, sampling, scaling
from reduxlab.operators.blocks import stored_bytes
from reduxlab.operators.linear_svm import HingeSGD
from reduxlab.operators.mlp import NeuralNetwork, Settings
from reduxlab.plans.sweeps import classification_sweep
from reduxlab.sources import loaders
from reduxlab.sources.records import class_folders, read_records
from reduxlab.sources.tables import FeatureTable


@pytest.mark.parametrize("rows_per_worker", [40, 10_000])
def test_fits_agree_over_layouts(make, rows_per_worker):
    matrix, labels = blobs(per=60)
    settings = Settings(hidden_dim=8, epochs=3, batch_size=16, lr=1e-2)
    sgd, mlp = [], []
    for parts in (1, 4, 16):
        df = make(matrix, labels, parts=parts)
        sgd.append(HingeSGD(max_iter=3, rows_per_worker=rows_per_worker).fit(df).weights)
        mlp.append(NeuralNetwork(4, settings, rows_per_worker=rows_per_worker).fit(df).weights)
    for weights in (sgd, mlp):
        assert np.allclose(weights[0], weights[1], atol=1e-12) and np.allclose(weights[0], weights[2], atol=1e-12)


def test_many_partitions_cost_no_accuracy(make):
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 10, 1600)
    matrix = rng.normal(size=(1600, 64)) * 0.5
    matrix[np.arange(1600), labels] += 3
    model = NeuralNetwork(10, Settings(epochs=20)).fit(make(matrix, labels, parts=16))
    found = model.predict(make(matrix, labels, parts=2)).select("label", "prediction").collect()
    assert np.mean([r.label == r.prediction for r in found]) >= 0.99


def test_sgd_stops_on_its_training_loss(make):
    matrix, labels = blobs()
    model = HingeSGD(alpha=1e-2, max_iter=200, early_stopping=False).fit(make(matrix, labels))
    assert model.epochs < 60


def test_rows_are_dealt_by_id(spark):
    df = spark.range(500).repartition(9)
    for workers in (1, 3, 7):
        parts = [[r.id for r in part] for part in folds.dealt(df, workers).rdd.glom().collect()]
        again = [[r.id for r in part] for part in folds.dealt(df.repartition(2), workers).rdd.glom().collect()]
        assert len(parts) == workers and parts == again and all(p == sorted(p) and p for p in parts)
    assert [folds.workers_for(n, 8 * n, 100) for n in (0, 99, 250, 10**9)] == [1, 1, 2, 10**7]
    assert folds.workers_for(99_999, 99_999 * 3072 * 8, 50_000) == 36


def test_states_of_many_workers_are_averaged_in_groups(make, monkeypatch):
    matrix, labels = blobs(per=60)
    settings = Settings(hidden_dim=8, epochs=2, batch_size=16, lr=1e-2)

    def weights():
        df = make(matrix, labels)
        return HingeSGD(max_iter=3, rows_per_worker=8).fit(df).weights, NeuralNetwork(4, settings, rows_per_worker=8).fit(df).weights

    expected = weights()
    monkeypatch.setattr(folds, "DRIVER_BYTES", 0)
    for got, want in zip(weights(), expected):
        assert np.allclose(got, want, atol=1e-12)


def test_tasks_follow_the_splits_not_the_cores(spark):
    class TwoCores:
        defaultParallelism = 2

    class Frame:
        sparkSession = type("S", (), {"sparkContext": TwoCores})

    assert folds.task_limit(Frame) == folds.MAX_TASKS
    assert folds.task_limit(Frame, 10**9) == folds.MIN_TASKS
    many = spark.range(0, 1000, 1, 300)
    seen = folds.folded(many, lambda batches: np.array([sum(b.num_rows for b in batches), 1.0]), 2)
    assert seen.tolist() == [1000.0, 300.0]


def test_wrong_widths_and_names_are_errors(make):
    df = make(np.ones((6, 3)), np.arange(6))
    assert layout.widen(df, ["a", "b", "c"]).columns[-3:] == ["a", "b", "c"]
    for names in (["a"], ["a", "b", "c", "d"]):
        with pytest.raises(PySparkException, match="names for 3 features"):
            layout.widen(df, names).collect()
    assert class_folders(df, list("uvwxyz")).count() == 6
    with pytest.raises(PySparkException, match="no class name for label"):
        class_folders(df, ["u"]).collect()


def test_no_sample_size_means_all_rows(make):
    df = make(np.ones((6, 3)), np.arange(6) % 2)
    assert sampling.sample_stratified(df, None).count() == 6


def test_rows_without_values_still_count(spark):
    df = spark.createDataFrame([(i, [], None) for i in range(20)], "id long, idx array<int>, val array<double>")
    rows, size = stored_bytes(df, ["idx", "val"])
    assert rows == 20 and size >= 20 * 16


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    frame, path = session.stored(spark.range(3), "probe")
    assert frame.count() == 3
    session.drop_path(spark, path)
    with pytest.raises(PySparkException):
        spark.read.parquet(path).count()

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("X", (), {"master": "yarn", "getConf": staticmethod(lambda: {})})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_path(Cluster, "probe")


def test_labels_of_any_type_and_no_nulls(spark):
    rows = [(i, 1e20 if i % 3 else 0.25) for i in range(90)]
    split = sampling.split_table(spark.createDataFrame(rows, "id long, label double"), test_size=0.2)
    counts = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert counts == {(1e20, "train"): 48, (1e20, "test"): 12, (0.25, "train"): 24, (0.25, "test"): 6}
    with pytest.raises(ValueError, match="null labels"):
        sampling.split_table(spark.createDataFrame([(1, None), (2, 3)], "id long, label int"))


def test_scaler_refuses_other_widths(make):
    fitted = scaling.fit_standardizer(make(np.arange(12.0).reshape(4, 3)))
    with pytest.raises(PySparkException, match="fitted on 3 statistics"):
        fitted.transform(make(np.ones((2, 6)))).collect()


def test_text_without_a_vocabulary_limit_has_a_width(spark):
    texts = ["apple pear", "apple plum", "pear plum fig", "apple pear"]
    rows = [(i, t, i % 2, "train" if i < 3 else "test") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string, label int, split string")
    table = loaders.prepare_text(df, max_features=None, remove=(), stop_words=[])
    assert table.input_dim == 3 and table.df.count() == 4


def test_sweep_keeps_the_records_of_finished_datasets(make, tmp_path, spark):
    matrix, labels = blobs(per=30)

    def load(name, seed):
        if name == "broken":
            raise OSError("no such file")
        split = sampling.split_table(make(matrix, labels), test_size=0.25, seed=seed)
        return FeatureTable(name, split, matrix.shape[1], 4, "dense_sensor")

    path = str(tmp_path / "records")
    with pytest.raises(OSError):
        classification_sweep(spark, load, ["good", "broken"], reducers=("identity",), models=("knn",), path=path)
    assert [r.dataset for r in read_records(spark, path).collect()] == ["good"]
