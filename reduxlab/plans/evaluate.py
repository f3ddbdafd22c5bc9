"""One cell of a sweep: reduce, fit, predict, score, and a record of it."""

import json
import time
import traceback
from contextlib import contextmanager

from pyspark.storagelevel import StorageLevel

from ..functions import peaks
from ..operators import layout, scores
from ..operators.reducers import make_reducer
from ..operators.models import make_model

# Column order and types of a classification record; absent values stay null.
RECORD_SCHEMA = (
    "run_id int, seed int, dataset string, feature_kind string, model string, reducer string, "
    "force_srp_matrix_type string, requested_dim string, input_dim int, n_train long, n_test long, n_classes int, "
    "status string, output_dim int, x_train_memory_mb double, x_test_memory_mb double, "
    "reduction_fit_time_sec double, reduction_train_transform_time_sec double, "
    "reduction_test_transform_time_sec double, reduction_fit_peak_py_mb double, "
    "reduction_train_transform_peak_py_mb double, reduction_test_transform_peak_py_mb double, "
    "model_fit_time_sec double, model_predict_time_sec double, model_fit_peak_py_mb double, "
    "model_predict_peak_py_mb double, reducer_params string, model_params string, accuracy double, "
    "balanced_accuracy double, macro_f1 double, weighted_f1 double, macro_precision double, macro_recall double, "
    "error_type string, error_message string, traceback string"
)


@contextmanager
def measured(spark, record, stage):
    """Wall seconds of a stage, and the peak memory of a worker or of the driver's Python in it."""
    with peaks.watched(spark) as peak:
        start = time.perf_counter()
        yield
        record[f"{stage}_time_sec"] = time.perf_counter() - start
        record[f"{stage}_peak_py_mb"] = peak()


def _failure(error):
    return {
        "status": "failed",
        "error_type": type(error).__name__,
        "error_message": str(error),
        "traceback": "".join(traceback.format_exception(error, limit=3)),
    }


def _forced(table, reducer, force_srp_matrix_type):
    return layout.force_form(table, force_srp_matrix_type) if reducer.name == "sparse_rp" else table


def fit_once(table, reducer_name, n_components, seed=42, force_srp_matrix_type=None, **options):
    """A reducer fitted on the training rows and the record of that, or None if it can't be fitted to so many components."""
    reducer, record = make_reducer(reducer_name, n_components, seed, **options), {}
    try:
        forced = _forced(table, reducer, force_srp_matrix_type)
        reducer.setup(forced)
        with measured(table.df.sparkSession, record, "reduction_fit"):
            reducer.fit(forced.part("train"))
    except Exception:  # each cell then fits its own, or records why it can't
        return None
    return reducer, record


class ReducedTable:
    """A fitted reducer and both reduced sides, kept for all models of the cell.

    fitted: a reducer fitted to at least as many components and the record of that, instead of a fit of its own.
    """

    def __init__(self, table, reducer, sizes, force_srp_matrix_type=None, fitted=None):
        forced = _forced(table, reducer, force_srp_matrix_type)
        self.record = {}
        train, test = forced.part("train"), forced.part("test")
        if fitted:
            self.reducer = fitted[0].sliced(reducer.n_components)
            self.record.update(fitted[1])
        else:
            self.reducer = reducer.setup(forced)
            with measured(train.sparkSession, self.record, "reduction_fit"):
                self.reducer.fit(train)
        self.sparse = self.reducer.sparse_output()
        self.train = self.test = None
        with measured(train.sparkSession, self.record, "reduction_train_transform"):
            self.train = self._kept(train)
        try:
            with measured(train.sparkSession, self.record, "reduction_test_transform"):
                self.test = self._kept(test)
        except Exception:
            self.train.unpersist()
            raise
        # Every reducer returns the wanted number of components; identity keeps the width.
        self.width = reducer.n_components or table.input_dim
        for side, df in (("train", self.train), ("test", self.test)):
            self.record[f"x_{side}_memory_mb"] = self._memory(df, sizes.get(side, 0))

    def _memory(self, df, rows):
        if self.sparse:
            return layout.feature_memory(df, sparse=True).head()["memory_mb"]
        return rows * self.width * 4 / (1 << 20)

    def _kept(self, df):
        out = self.reducer.transform(df).persist(StorageLevel.MEMORY_AND_DISK)
        out.write.format("noop").mode("overwrite").save()
        return out

    def close(self):
        for df in (self.train, self.test):
            if df is not None:
                df.unpersist()


def base_record(table, reducer, reducer_name, model_name, run_id, seed, sizes, force_srp_matrix_type=None):
    return {
        "run_id": run_id,
        "seed": seed,
        "dataset": table.name,
        "feature_kind": table.feature_kind,
        "model": model_name,
        "reducer": reducer_name,
        "force_srp_matrix_type": force_srp_matrix_type if reducer_name == "sparse_rp" else None,
        "requested_dim": str(reducer.n_components) if reducer.n_components is not None else "original",
        "input_dim": table.input_dim,
        "n_train": sizes.get("train", 0),
        "n_test": sizes.get("test", 0),
        "n_classes": table.n_classes,
    }


def side_sizes(table):
    return {row["split"]: row["count"] for row in table.df.groupBy("split").count().collect()}


def evaluate_model(reduced, model):
    """Fit, predict and score on a reduced table."""
    record = {}
    spark = reduced.train.sparkSession
    with measured(spark, record, "model_fit"):
        model.fit(reduced.train, sparse=reduced.sparse, width=reduced.width)
    predictions = None
    try:
        with measured(spark, record, "model_predict"):
            predictions = model.predict(reduced.test).persist(StorageLevel.MEMORY_AND_DISK)
            predictions.write.format("noop").mode("overwrite").save()
        record.update(scores.classification_scores(predictions).head().asDict())
    finally:
        if predictions is not None:
            predictions.unpersist()
    record["model_params"] = json.dumps(model.params())
    return record


def evaluate(table, reducer_name, n_components, model_names, run_id=0, seed=42, force_srp_matrix_type=None, fitted=None,
             sizes=None, **options):
    """Records of one reduction with every model; any failure becomes a record of its own.

    The reduction is fitted (or taken from `fitted`, see fit_once) and stored once and shared by the models.
    """
    sizes = sizes or side_sizes(table)
    reducer = make_reducer(reducer_name, n_components, seed, **options)
    bases = [
        base_record(table, reducer, reducer_name, name, run_id, seed, sizes, force_srp_matrix_type)
        for name in model_names
    ]
    try:
        reduced = ReducedTable(table, reducer, sizes, force_srp_matrix_type, fitted)
    except Exception as error:  # a failed cell must not end the sweep
        return [{**base, **_failure(error)} for base in bases]
    records = []
    try:
        shared = {
            "status": "ok",
            "output_dim": reduced.width,
            "reducer_params": json.dumps(reducer.params()),
            **reduced.record,
        }
        for base, name in zip(bases, model_names):
            try:
                model = make_model(name, table.n_classes, seed, **options)
                records.append({**base, **shared, **evaluate_model(reduced, model)})
            except Exception as error:  # as above
                records.append({**base, **_failure(error)})
    finally:
        reduced.close()
    return records
