"""Two-hidden-layer network trained by local AdamW epochs with averaged weights."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..errors import ModelError
from ..functions import folds, peaks
from ..functions.matrices import feature_columns, read_rows
from .blocks import stored_bytes
from .layout import to_dense
from .linear_svm import buffered
from .sampling import validation_split

# Fixed values of the optimiser's published defaults.
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8


@dataclass(frozen=True)
class Settings:
    hidden_dim: int = 128
    epochs: int = 20
    batch_size: int = 256
    lr: float = 1e-3
    dropout: float = 0.2
    seed: int = 42
    early_stopping: bool = True
    validation_fraction: float = 0.1
    patience: int = 3
    min_delta: float = 0.0
    weight_decay: float = 0.0
    allow_sparse_to_dense: bool = False


def layer_shapes(input_dim, hidden_dim, n_classes):
    middle = max(32, hidden_dim // 2)
    return [
        (input_dim, hidden_dim), (hidden_dim,),
        (hidden_dim, middle), (middle,),
        (middle, n_classes), (n_classes,),
    ]


def split_layers(vector, shapes):
    """Views of one parameter vector as layer matrices."""
    out, at = [], 0
    for shape in shapes:
        size = int(np.prod(shape))
        out.append(vector[at : at + size].reshape(shape))
        at += size
    return out


def initial_weights(shapes, seed):
    """Uniform in +-1/sqrt(inputs of the layer), biases too."""
    rng = np.random.default_rng(seed)
    parts = []
    for weight, bias in zip(shapes[0::2], shapes[1::2]):
        bound = 1.0 / np.sqrt(max(1, weight[0]))
        parts += [rng.uniform(-bound, bound, int(np.prod(weight))), rng.uniform(-bound, bound, bias[0])]
    return np.concatenate(parts)


def forward(rows, layers, mask=None):
    """Hidden activations and logits; `mask` is the scaled dropout of the first layer."""
    w1, b1, w2, b2, w3, b3 = layers
    first = np.maximum(rows.dot(w1) + b1, 0.0)
    dropped = first if mask is None else first * mask
    second = np.maximum(dropped @ w2 + b2, 0.0)
    return first, dropped, second, second @ w3 + b3


def cross_entropy(logits, code):
    shifted = logits - logits.max(axis=1, keepdims=True)
    log_total = np.log(np.exp(shifted).sum(axis=1))
    return log_total - shifted[np.arange(len(code)), code], np.exp(shifted - log_total[:, None])


def loss_and_slopes(rows, code, layers, mask=None):
    """Mean cross-entropy, its gradient as one vector, and the number of hits."""
    w1, _, w2, _, w3, _ = layers
    first, dropped, second, logits = forward(rows, layers, mask)
    losses, shares = cross_entropy(logits, code)
    n = len(code)
    top = shares
    top[np.arange(n), code] -= 1.0
    top /= n
    middle = (top @ w3.T) * (second > 0)
    bottom = (middle @ w2.T) * (first > 0)
    if mask is not None:
        bottom *= mask
    slopes = np.concatenate(
        [
            rows.transposed_dot(bottom, len(w1)).ravel(), bottom.sum(axis=0),
            (dropped.T @ middle).ravel(), middle.sum(axis=0),
            (second.T @ top).ravel(), top.sum(axis=0),
        ]
    )
    return float(losses.mean()), slopes, int((logits.argmax(axis=1) == code).sum())


def _epoch_fold(shared, shapes, settings, epoch, sparse, learn):
    """One local epoch, and the held-out loss and hits of the shared weights."""

    def fold(batches):
        start, mean, square, taken = shared.value
        rng = np.random.default_rng([settings.seed, epoch, TaskContext.get().partitionId()])
        weights, mean, square = start.copy(), mean.copy(), square.copy()
        fixed, layers = split_layers(start, shapes), split_layers(weights, shapes)
        steps = seen = hits = checked = right = 0
        loss_sum = checked_loss = 0.0
        for batch in buffered(batches, sparse, rng):
            rows, code = read_rows(batch, sparse), batch.column("label").to_numpy()
            held_out = batch.column("held_out").to_numpy(zero_copy_only=False)
            probe = np.flatnonzero(held_out)
            if len(probe):
                logits = forward(rows.take(probe), fixed)[-1]
                checked_loss += float(cross_entropy(logits, code[probe])[0].sum())
                right += int((logits.argmax(axis=1) == code[probe]).sum())
                checked += len(probe)
            order = np.flatnonzero(~held_out) if learn else []
            for at in range(0, len(order), settings.batch_size):
                part = order[at : at + settings.batch_size]
                mask = None
                if settings.dropout > 0:
                    kept = rng.random((len(part), settings.hidden_dim)) >= settings.dropout
                    mask = kept / (1.0 - settings.dropout)
                loss, slopes, found = loss_and_slopes(rows.take(part), code[part], layers, mask)
                steps += 1
                t = taken + steps
                mean *= BETA1
                mean += (1 - BETA1) * slopes
                square *= BETA2
                square += (1 - BETA2) * slopes * slopes
                weights *= 1.0 - settings.lr * settings.weight_decay
                weights -= settings.lr * (mean / (1 - BETA1**t)) / (np.sqrt(square / (1 - BETA2**t)) + EPSILON)
                seen, hits, loss_sum = seen + len(part), hits + found, loss_sum + loss * len(part)
        tail = [seen, seen * steps, loss_sum, hits, checked, checked_loss, right]
        if not learn:
            return np.concatenate([np.zeros(len(weights)), tail])
        return np.concatenate([seen * weights, seen * mean, seen * square, tail])

    return fold


class NeuralNetwork:
    """Linear-ReLU-dropout-linear-ReLU-linear classifier.

    Rows are dealt by hash of their id to workers of bounded rows and bytes and lie there in the order
    of their ids, so the fit does not depend on the layout of its input. Each epoch is one job in which
    every worker runs mini-batch AdamW over its own rows from the shared state; weights and moments are
    averaged by row count, and one worker is plain AdamW. The same job scores the held-out rows for the weights it started from, so early
    stopping needs no extra pass.
    """

    name = "dnn"

    def __init__(self, n_classes, settings=Settings(), rows_per_worker=folds.ROWS_PER_WORKER):
        self.n_classes, self.settings, self.rows_per_worker = n_classes, settings, rows_per_worker
        self.weights = self.shapes = self.input_dim = None
        self.best_epoch = self.best_val_acc = self.best_val_loss = None
        self.history = []
        self.sparse, self.workers = False, 1

    def _rows(self, df, sparse, width):
        if sparse and self.settings.allow_sparse_to_dense:
            return to_dense(df, width), False
        return df, sparse

    def fit(self, df, sparse=False, width=None):
        s = self.settings
        df, self.sparse = self._rows(df, sparse, width)
        marked = validation_split(df, s.validation_fraction, s.seed, s.early_stopping)
        columns = feature_columns(self.sparse)
        rows = marked.select("id", *columns, "label", (F.col("part") == "val").alias("held_out"))
        self.workers = folds.workers_for(*stored_bytes(rows, columns), self.rows_per_worker)
        rows = folds.dealt(rows, self.workers).drop("id").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if width is None:
                column = F.array_max("idx") + 1 if self.sparse else F.size("features")
                width = rows.agg(F.max(column).alias("d")).head()["d"]
            self.input_dim = width
            self.shapes = layer_shapes(width, s.hidden_dim, self.n_classes)
            self._train(rows)
        finally:
            rows.unpersist()
        return self

    def _pass(self, rows, state, epoch, learn=True):
        size = len(state[0])
        shared = folds.share(rows, state, 3 * 8 * size, "network state")
        fold = _epoch_fold(shared, self.shapes, self.settings, epoch, self.sparse, learn)
        total = folds.folded(rows, fold, (3 if learn else 1) * size + 7, self.workers)
        shared.destroy()
        seen, steps, loss, hits, checked, checked_loss, right = total[-7:]
        scores = (checked_loss / checked, right / checked) if checked else None
        if not learn or not seen:
            return state, scores
        moved = tuple(total[i * size : (i + 1) * size] / seen for i in range(3))
        self.history.append({"epoch": epoch, "loss": loss / seen, "accuracy": hits / seen})
        return (*moved, state[3] + steps / seen), scores

    def _train(self, rows):
        s = self.settings
        weights = initial_weights(self.shapes, s.seed)
        state = (weights, np.zeros_like(weights), np.zeros_like(weights), 0.0)
        best, best_weights, stale = -np.inf, None, 0
        for epoch in range(1, s.epochs + 2):
            following, scores = self._pass(rows, state, epoch, learn=epoch <= s.epochs)
            if epoch > 1 and scores is not None and s.early_stopping:
                loss, accuracy = scores
                if accuracy > best + s.min_delta:
                    best, best_weights, stale = accuracy, state[0], 0
                    self.best_epoch, self.best_val_acc, self.best_val_loss = epoch - 1, accuracy, loss
                else:
                    stale += 1
                if stale >= s.patience:
                    break
            if epoch > s.epochs or (epoch == s.epochs and scores is None):
                state = following
                break
            state = following
        self.weights = state[0] if best_weights is None else best_weights

    def predict(self, df, with_logits=False):
        """Add `prediction` (and `logits` on request) in place of the features."""
        df, sparse = self._rows(df, "idx" in df.columns, self.input_dim)
        if sparse != self.sparse:
            raise ModelError("rows must have the form, dense or sparse, that the network was trained on")
        return predict(df, self.weights, self.shapes, sparse, with_logits)

    def params(self):
        kept = {k: v for k, v in vars(self.settings).items() if k != "seed"}
        return {
            **kept, "best_epoch": self.best_epoch, "best_val_acc": self.best_val_acc,
            "best_val_loss": self.best_val_loss,
            "num_parameters": None if self.weights is None else int(self.weights.size),
        }


def predict(df, weights, shapes, sparse=False, with_logits=False):
    shared = folds.share(df, weights, weights.nbytes, "network weights")
    columns, note = feature_columns(sparse), peaks.watcher()

    def logits_of(*arrays):
        if not len(arrays[0]):
            return pa.array([], pa.list_(pa.float64()))
        rows = read_rows(pa.RecordBatch.from_arrays(list(arrays), columns), sparse)
        logits = forward(rows, split_layers(shared.value, shapes))[-1]
        note()
        offsets = np.arange(len(logits) + 1, dtype=np.int32) * logits.shape[1]
        return pa.ListArray.from_arrays(offsets, logits.ravel())

    @F.arrow_udf("array<double>")
    def run_dense(features: pa.Array) -> pa.Array:
        return logits_of(features)

    @F.arrow_udf("array<double>")
    def run_sparse(idx: pa.Array, val: pa.Array) -> pa.Array:
        return logits_of(idx, val)

    scored = df.withColumn("logits", (run_sparse if sparse else run_dense)(*columns)).drop(*columns)
    best = (F.array_position("logits", F.array_max("logits")) - 1).cast("int")
    out = scored.withColumn("prediction", best)
    return out if with_logits else out.drop("logits")


def loss_table(df, weights, shapes, sparse=False):
    """One row: cross-entropy sum, hits, rows - the held-out totals that a training pass takes, here of all rows."""
    rows = df.select(*feature_columns(sparse), "label", F.lit(True).alias("held_out"))
    none = np.zeros(0)
    shared = folds.share(df, (weights, none, none, 0.0), weights.nbytes, "network weights")
    fold = _epoch_fold(shared, shapes, Settings(), 0, sparse, learn=False)
    checked, loss, right = folds.folded(rows, fold, weights.size + 7)[-3:]
    shared.destroy()
    return df.sparkSession.createDataFrame([(float(loss), int(right), int(checked))], "loss_sum double, correct long, n long")
