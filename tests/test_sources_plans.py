import json

import numpy as np
import pytest
from conftest import blobs, matrix_of
from pyspark.sql import functions as F

from reduxlab.functions import peaks
from reduxlab.operators import layout, sampling
from reduxlab.operators.reducers import make_reducer
from reduxlab.plans import reports, sweeps
from reduxlab.plans.evaluate import evaluate
from reduxlab.sources import loaders, records, text_matrix
from reduxlab.sources.tables import FeatureTable


def test_lines_are_numbered_over_files_and_splits(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    sizes = {"a.txt": 3, "b.txt": 400, "c.txt": 1}
    n = 0
    for name, size in sizes.items():
        (folder / name).write_text("".join(f"{n + i}\n" for i in range(size)))
        n += size
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        rows = text_matrix.numbered_lines(spark, str(folder)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == n and all(int(r["value"]) == r["line"] for r in rows)


def har_folder(root, rng):
    for side, n in (("train", 12), ("test", 6)):
        (root / side).mkdir(parents=True)
        x = rng.normal(size=(n, 3))
        lines = "\n".join("  " + "  ".join(f"{v:.7e}" for v in row) for row in x)
        (root / side / f"X_{side}.txt").write_text(lines + "\n")
        (root / side / f"y_{side}.txt").write_text("".join(f"{i % 6 + 1}\n" for i in range(n)))
    return root


def test_sensor_loader_joins_lines_and_rebases_labels(spark, tmp_path):
    path = str(har_folder(tmp_path / "har", np.random.default_rng(0)))
    table = loaders.load_dataset(spark, "UCI_HAR", path, standardize=False)
    assert table.input_dim == 3 and table.df.count() == 18
    assert table.part("train").agg(F.max("label")).head()[0] == 5
    scaled = loaders.load_dataset(spark, "uci_har", path, max_train=10, max_test=4)
    assert matrix_of(scaled.part("train")).std(axis=0) == pytest.approx(1.0)
    whole = loaders.load_cluster_dataset(spark, "uci_har", path)
    assert sorted(r["id"] for r in whole.df.collect()) == list(range(18))


def test_datasets_by_name(spark, make, tmp_path):
    rng = np.random.default_rng(1)
    make(rng.integers(0, 256, (40, 28 * 28)), np.arange(40) % 10).write.parquet(str(tmp_path / "grey"))
    with pytest.raises(ValueError):
        loaders.load_dataset(spark, "fashion_mnist", str(tmp_path / "grey"))
    hog = loaders.load_cluster_dataset(spark, "fashion_mnist_hog", str(tmp_path / "grey"), str(tmp_path / "hog"))
    assert hog.input_dim == 1296 and records.is_complete(spark, str(tmp_path / "hog"))
    make(rng.integers(0, 256, (30, 3072)), np.arange(30) % 10).write.parquet(str(tmp_path / "colour/train"))
    make(rng.integers(0, 256, (10, 3072)), np.arange(10) % 10).write.parquet(str(tmp_path / "colour/test"))
    colour = loaders.load_dataset(spark, "cifar10", str(tmp_path / "colour"), max_train=20)
    assert colour.part("train").count() == 20 and colour.part("test").count() == 10
    cnn = loaders.load_cluster_dataset(
        spark, "cifar10_cnn", str(tmp_path / "colour/train"), str(tmp_path / "cnn"), lambda images: images.mean(axis=(2, 3))
    )
    assert cnn.input_dim == 3
    for load in (loaders.load_dataset, loaders.load_cluster_dataset):
        with pytest.raises(ValueError):
            load(spark, "imagenet", "nowhere")


def test_text_and_multilabel_loaders(spark, tmp_path):
    text = [(i, f"x\n\ncommon word{i % 3} topic{i % 2}", i % 2, "test" if i % 4 == 0 else "train") for i in range(24)]
    spark.createDataFrame(text, "id long, text string, label int, split string").write.parquet(str(tmp_path / "news"))
    news = loaders.load_dataset(spark, "20newsgroups", str(tmp_path / "news"))
    assert news.sparse and news.n_classes == 2 and news.input_dim == 6
    sparse = [(i, [i % 5, 7], [1.0, 2.0 + i], [i % 4] if i % 6 else []) for i in range(60)]
    spark.createDataFrame(sparse, "id long, idx array<int>, val array<double>, labels array<int>").write.parquet(
        str(tmp_path / "rcv1")
    )
    corpus = loaders.load_dataset(spark, "rcv1", str(tmp_path / "rcv1"), max_train=30, max_test=10)
    assert (corpus.part("train").count(), corpus.part("test").count()) == (30, 10)
    assert corpus.input_dim == 8 and corpus.n_classes == 4
    assert corpus.part("train").agg(F.max(F.array_max("val"))).head()[0] == pytest.approx(1.0)


def test_records_line_up_by_name(spark, tmp_path):
    path = str(tmp_path / "records")
    records.append_records(spark.createDataFrame([("failed", "boom")], "status string, error string"), path)
    records.append_records(spark.createDataFrame([(0.5, "ok")], "accuracy double, status string"), path)
    got = {(r["status"], r["error"], r["accuracy"]) for r in records.read_records(spark, path).collect()}
    assert got == {("failed", "boom", None), ("ok", None, 0.5)}
    nested = spark.sql("select array(1, 2) as a, map('k', 1.5D) as m, named_struct('x', 1) as s, 'plain' as p")
    row = records.nested_as_json(nested).head()
    assert (row["a"], json.loads(row["m"]), json.loads(row["s"]), row["p"]) == ("[1,2]", {"k": 1.5}, {"x": 1}, "plain")


def test_class_folders_pad_without_cutting(spark):
    df = spark.createDataFrame([(7, 0), (123456, 9)], "id long, label int")
    got = {(r["sample"], r["label_name"]) for r in records.class_folders(df, loaders.FASHION_LABELS).collect()}
    assert got == {("00007", "0_tshirt_top"), ("123456", "9_ankle_boot")}


def prepared(make, width=6):
    x, y = blobs(per=30, dims=width)
    split = sampling.split_table(make(x, y), test_size=0.25)
    return FeatureTable("blobs", split, width, 4, "dense_sensor")


def test_a_cell_shares_its_reduction_and_records_failures(make):
    table = prepared(make)
    good = evaluate(table, "pca_svd", 2, ["knn", "svm"], svm_max_iter=20)
    assert [r["status"] for r in good] == ["ok", "ok"] and all(r["accuracy"] > 0.9 for r in good)
    assert good[0]["reduction_fit_time_sec"] == good[1]["reduction_fit_time_sec"]
    assert good[0]["output_dim"] == 2 and good[0]["requested_dim"] == "2"
    bad = evaluate(layout.force_form(table, "sparse"), "pca_svd", 2, ["knn", "dnn"])
    assert [(r["status"], r["error_type"]) for r in bad] == [("failed", "ReductionError")] * 2


def test_stages_fill_their_peaks(spark, make):
    (record,) = evaluate(prepared(make), "gaussian_rp", 4, ["svm"])
    stages = ("reduction_fit", "reduction_train_transform", "reduction_test_transform", "model_fit", "model_predict")
    assert all(record[f"{stage}_peak_py_mb"] > 0 and record[f"{stage}_time_sec"] > 0 for stage in stages)
    assert all(record[f"{stage}_peak_py_mb"] > 20 for stage in stages[1:])
    with peaks.watched(spark) as outer:
        with peaks.watched(spark) as inner:
            note = peaks.watcher()
            spark.range(3).select("id").mapInArrow(lambda batches: (note() or batch for batch in batches), "id long").collect()
        assert inner() > 20 and outer() < inner()


def test_sparse_projection_can_be_forced(make):
    table = prepared(make)
    for form in ("dense", "sparse"):
        (record,) = evaluate(table, "sparse_rp", 4, ["knn"], force_srp_matrix_type=form)
        assert record["status"] == "ok" and record["force_srp_matrix_type"] == form
    (record,) = evaluate(table, "dct", 4, ["knn"], force_srp_matrix_type="sparse")
    assert record["force_srp_matrix_type"] is None


def test_classification_sweep_covers_the_grid(spark, make):
    table = prepared(make)
    seeds = []

    def load(name, seed):
        seeds.append(seed)
        return table

    out = sweeps.classification_sweep(
        spark, load, ["blobs"], ("identity", "gaussian_rp"), ("knn",), (2, 4, 100), runs=2, seed=10
    )
    cells = [(r["run_id"], r["seed"], r["reducer"], r["requested_dim"]) for r in out.collect()]
    assert seeds == [10, 11]
    assert cells == [
        (run, 10 + run, name, k)
        for run in (0, 1)
        for name, k in (("identity", "original"), ("gaussian_rp", "2"), ("gaussian_rp", "4"))
    ]


def test_smaller_dimensions_are_the_first_components(make):
    table = prepared(make)
    train = table.part("train")
    for name in ("gaussian_rp", "sparse_rp", "pca_svd", "dct"):
        large = make_reducer(name, 5, 7).setup(table).fit(train).sliced(3)
        small = make_reducer(name, 3, 7).setup(table).fit(train)
        assert large.params() == small.params()
        assert np.allclose(matrix_of(large.transform(train)), matrix_of(small.transform(train)))
        with pytest.raises(ValueError):
            large.sliced(4)


def test_a_stopped_sweep_goes_on_and_fits_once(spark, make, tmp_path, monkeypatch):
    table, path = prepared(make), str(tmp_path / "records")
    fits, cells = [], []
    fit, cell = sweeps.fit_once, sweeps.evaluate

    def stops(table, reducer, k, *rest, **options):
        cells.append((reducer, k))
        if len(cells) == 3:
            raise KeyboardInterrupt
        return cell(table, reducer, k, *rest, **options)

    monkeypatch.setattr(sweeps, "fit_once", lambda *a, **b: fits.append(a[1:3]) or fit(*a, **b))
    monkeypatch.setattr(sweeps, "evaluate", stops)
    grid = dict(reducers=("identity", "dct", "pca_svd"), models=("knn",), dims=(2, 3, 5), path=path)
    with pytest.raises(KeyboardInterrupt):
        sweeps.classification_sweep(spark, lambda name, seed: table, ["blobs"], **grid)
    assert fits == [("dct", 5), ("pca_svd", 5)] and spark.read.parquet(path).count() == 2
    done = cells[:2]
    cells[:] = [None] * 3
    out = sweeps.classification_sweep(spark, lambda name, seed: table, ["blobs"], at_once=3, **grid).collect()
    again = cells[3:]
    assert not set(done) & set(again) and len(again) == 5 and spark.read.parquet(path).count() == 7
    assert [(r["reducer"], r["requested_dim"]) for r in out] == [
        ("identity", "original"), *[(name, str(k)) for name in ("dct", "pca_svd") for k in (2, 3, 5)]
    ]
    assert all(r["status"] == "ok" for r in out)
    cells.clear()
    sweeps.classification_sweep(spark, lambda name, seed: table, ["blobs"], **grid)
    assert cells == []


def test_a_failed_clustering_cell_is_left_open(spark, make, tmp_path, monkeypatch):
    x, y = blobs(per=20)
    table, path = FeatureTable("blobs", make(x, y), 6, 4, "dense_sensor"), str(tmp_path / "clusters")
    few = {"kmeans": {"n_init": 1}, "gmm": {"n_init": 1}}
    preserved = sweeps.geometry.distance_preservation

    def fails(stored, reduced, **options):
        if "rp" in reduced:
            raise ArithmeticError("no distances")
        return preserved(stored, reduced, **options)

    monkeypatch.setattr(sweeps.geometry, "distance_preservation", fails)
    with pytest.warns(UserWarning, match="no distances"):
        rows = sweeps.clustering_sweep(spark, [table], (3,), 100, methods=["rp", "dct"], path=path, **few).collect()
    assert [(r["method"], r["ari"] is None) for r in rows] == [("rp", True), ("rp", True), ("dct", False), ("dct", False)]
    monkeypatch.setattr(sweeps.geometry, "distance_preservation", preserved)
    rows = sweeps.clustering_sweep(spark, [table], (3,), 100, methods=["rp", "dct"], path=path, at_once=2, **few).collect()
    assert all(r["ari"] is not None for r in rows) and spark.read.parquet(path).count() == 4


def test_clustering_sweep_records(spark, make):
    x, y = blobs(per=30)
    table = FeatureTable("blobs", make(x, y), 6, 4, "dense_sensor")
    few = {"kmeans": {"n_init": 5}, "gmm": {"n_init": 3}}
    rows = sweeps.clustering_sweep(spark, [table], (6, 50), 100, methods=["dct"], **few).collect()
    assert [(r["method"], r["model"], r["k"]) for r in rows] == [("dct", "kmeans", 6), ("dct", "gmm", 6)]
    for row in rows:
        assert row["ari"] == pytest.approx(1.0) and row["distance_preservation"] == pytest.approx(1.0)
        assert row["total_time"] == pytest.approx(row["reduction_time"] + row["clustering_time"])


@pytest.fixture
def results(spark):
    rows = [
        ("d", m, "kmeans", k, 0.1, 0.2, 0.3, 0.4, 0.5, None if (m, k) == ("rp", 50) else 1.0, 2.0, 3.0)
        for m in ("dct", "rp", "pca")
        for k in (100, 50)
    ]
    return spark.createDataFrame(rows, sweeps.CLUSTER_SCHEMA)


def test_report_tables_keep_the_method_order(results):
    series = reports.metric_vs_k(results).filter("metric = 'ari'").collect()
    assert [(r["method"], r["k"]) for r in series] == [(m, k) for m in ("pca", "rp", "dct") for k in (50, 100)]
    times = reports.runtime_vs_k(results).collect()
    assert [r["method"] for r in times] == ["pca", "pca", "rp", "rp", "dct", "dct"]
    bars = [(r["k"], r["method"], r["bar_top"]) for r in reports.runtime_breakdown(results).collect()]
    assert bars == [(50, "pca", 3.0), (50, "dct", 3.0), (100, "pca", 3.0), (100, "rp", 3.0), (100, "dct", 3.0)]


def test_gallery_takes_first_members_of_a_large_cluster(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 40).alias("cluster"))
    rows = reports.cluster_gallery(df, clusters=6, members=3).orderBy("cluster", "place").collect()
    assert [(r["cluster"], r["place"]) for r in rows] == [(c, p) for c in range(6) for p in (1, 2, 3)]
    assert [r["id"] for r in rows if r["cluster"] == 5] == [0, 3, 5]


def test_label_grid_joins_both_models(make):
    x, y = blobs(per=20)
    table = FeatureTable("blobs", make(x, y), 6, 4, "dense_sensor")
    few = {"kmeans": {"n_init": 1, "max_iter": 5}, "gmm": {"n_init": 1, "max_iter": 5}}
    labels = reports.cluster_labels(table, 3, 4, **few)
    grid = reports.label_grid(table, 3, labels, max_points=50)
    assert grid.count() == 5 * 50 and set(grid.columns) == {"id", "method", "label", "x", "y", "kmeans", "gmm"}
    assert grid.filter("kmeans is null or gmm is null").count() == 0
