"""Linear support vector machines: squared hinge by matrix-free Newton steps, hinge by averaged local SGD.

All one-vs-rest problems share every pass over the table; the driver holds (d + 1) x K numbers.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions import folds, peaks
from ..functions.matrices import feature_columns, read_rows
from . import scaling
from .blocks import stored_bytes
from .sampling import MAX_COUNTS, validation_split


def class_values(df):
    rows = df.select("label").distinct().limit(MAX_COUNTS + 1).collect()
    if len(rows) > MAX_COUNTS:
        raise ValueError(f"more than {MAX_COUNTS} classes")
    return np.array(sorted(row["label"] for row in rows))


def _targets(batch, classes):
    """+1 where the row has the class, otherwise -1."""
    code = np.searchsorted(classes, batch.column("label").to_numpy())
    signs = np.full((len(code), len(classes)), -1.0)
    signs[np.arange(len(code)), code] = 1.0
    return signs


# Numbers that one pass may sum as products of the curvature with directions. A table whose curvature has no more of
# them gets its products with all unit directions along with the gradient, a wider one those with one direction per pass.
BLOCK_VALUES = 4_000_000
# Directions of the sketch that preconditions the wider tables.
SKETCH = 64


def _squared_hinge_fold(shared, classes, cost, sparse, curved=False):
    def fold(batches):
        weights = shared.value
        size, k = weights.shape
        slopes, losses = np.zeros_like(weights), np.zeros(k)
        curvature = np.zeros((k, size, size)) if curved else np.zeros(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, signs = read_rows(batch, sparse), _targets(batch, classes)
            short = np.maximum(0.0, 1.0 - signs * (rows.dot(weights[:-1]) + weights[-1]))
            pull = -2.0 * cost * signs * short
            slopes[:-1] += rows.transposed_dot(pull, size - 1)
            slopes[-1] += pull.sum(axis=0)
            losses += cost * (short * short).sum(axis=0)
            if curved:
                x = np.hstack([rows.to_matrix(size - 1), np.ones((len(rows), 1))])
                for c in range(k):
                    active = x[short[:, c] > 0]
                    curvature[c] += 2.0 * cost * (active.T @ active)
        return np.concatenate([slopes.ravel(), losses, curvature.ravel()])

    return fold


def _training_columns(sparse):
    return [*feature_columns(sparse), "label"]


def squared_hinge(df, weights, classes, cost=1.0, sparse=False, curved=False):
    """Per class 1/2 |w, b|^2 + C sum max(0, 1 - y f)^2, its gradient and, if wanted, curvature."""
    size, k = weights.shape
    shared = folds.share(df, weights, weights.nbytes, "weights")
    fold = _squared_hinge_fold(shared, classes, cost, sparse, curved)
    length = weights.size + k + (k * size * size if curved else 0)
    state = folds.folded(df.select(*_training_columns(sparse)), fold, length)
    shared.destroy()
    slopes = state[: weights.size].reshape(weights.shape) + weights
    losses = state[weights.size : weights.size + k] + 0.5 * (weights * weights).sum(axis=0)
    curvature = state[weights.size + k :].reshape(k, size, size) + np.eye(size) if curved else None
    return losses, slopes, curvature


def curvature_products(df, weights, directions, chosen, classes, cost=1.0, sparse=False):
    """The curvature at the weights times one direction of each chosen class, by one pass and without forming it."""
    shared = folds.share(df, (weights[:, chosen], directions), 2 * directions.nbytes, "weights")

    def fold(batches):
        at, along = shared.value
        size, k = at.shape
        total = np.zeros_like(along)
        for batch in batches:
            if batch.num_rows:
                rows, signs = read_rows(batch, sparse), _targets(batch, classes)[:, chosen]
                both = rows.dot(np.hstack([at[:-1], along[:-1]])) + np.hstack([at[-1], along[-1]])
                move = 2.0 * cost * both[:, k:] * (signs * both[:, :k] < 1.0)
                total[:-1] += rows.transposed_dot(move, size - 1)
                total[-1] += move.sum(axis=0)
        return total.ravel()

    state = folds.folded(df.select(*_training_columns(sparse)), fold, directions.size)
    shared.destroy()
    return state.reshape(directions.shape) + directions


def sketched_inverse(df, size, cost, sparse, seed, rank=SKETCH):
    """An approximate inverse of the curvature where every row counts, from products with `rank` random directions.

    The largest eigenvalues come from a Nystroem approximation and the others are taken as equal; the same for all
    classes, as the targets do not enter.
    """
    rank = max(1, min(rank, size, BLOCK_VALUES // size))
    frame, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, rank)))
    shared = folds.share(df, frame, frame.nbytes, "directions")

    def fold(batches):
        along = shared.value
        total = np.zeros_like(along)
        for batch in batches:
            if batch.num_rows:
                rows = read_rows(batch, sparse)
                move = 2.0 * cost * (rows.dot(along[:-1]) + along[-1])
                total[:-1] += rows.transposed_dot(move, size - 1)
                total[-1] += move.sum(axis=0)
        return total.ravel()

    image = folds.folded(df.select(*feature_columns(sparse)), fold, frame.size).reshape(frame.shape)
    shared.destroy()
    little = 1e-10 * max(float(np.linalg.norm(image)), 1e-300)
    core = frame.T @ image + little * np.eye(rank)
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    half = vectors / np.sqrt(np.maximum(values, little))
    axes, spread, _ = np.linalg.svd((image + little * frame) @ half, full_matrices=False)
    values = np.maximum(spread**2 - little, 0.0)
    rest = values.min() + 1.0

    def inverse(vectors, chosen):
        inside = axes.T @ vectors
        return (vectors - axes @ inside) / rest + axes @ (inside / (values + 1.0)[:, None])

    return inverse


def squared_hinge_table(df, weights, classes, cost=1.0, sparse=False):
    """The loss part of that gradient as rows (i, class, slope); i = d is the intercept."""
    shared = folds.share(df, weights, weights.nbytes, "weights")
    size = len(classes)
    fold = _squared_hinge_fold(shared, classes, cost, sparse)
    summed = folds.folded_table(df.select(*_training_columns(sparse)), fold, weights.size + size)
    return summed.filter(F.col("pos") < weights.size).select(
        F.floor(F.col("pos") / size).cast("int").alias("i"),
        (F.col("pos") % size).cast("int").alias("cls"),
        F.col("value").alias("slope"),
    )


def _along(a, b):
    return (a * b).sum(axis=0)


def conjugate_steps(product, inverse, slope, shortfall=0.1, most=500):
    """Per class the step that preconditioned conjugate gradients take towards the foot of its quadratic model, and
    the gain that the model expects. product and inverse take (vectors, chosen classes)."""
    step, rest = np.zeros_like(slope), -slope
    goal = shortfall * np.linalg.norm(slope, axis=0)
    chosen = np.flatnonzero(goal > 0)
    way, gain = np.zeros_like(slope), np.ones(slope.shape[1])
    for turn in range(most):
        if not len(chosen):
            break
        ready = inverse(rest[:, chosen], chosen)
        fresh = _along(rest[:, chosen], ready)
        way[:, chosen] = ready + (fresh / gain[chosen] * way[:, chosen] if turn else 0.0)
        gain[chosen] = fresh
        image = product(way[:, chosen], chosen)
        share = fresh / _along(way[:, chosen], image)
        step[:, chosen] += share * way[:, chosen]
        rest[:, chosen] -= share * image
        chosen = chosen[np.linalg.norm(rest[:, chosen], axis=0) > goal[chosen]]
    return step, 0.5 * (_along(step, rest) - _along(slope, step))


# Parts of a step whose losses one pass compares when the whole step gains too little.
FRACTIONS = 0.75 ** np.arange(1, 33)


def newton(evaluate, products, inverse_at, losses_along, start, max_iter, tol):
    """Newton steps for every class at once, until each gradient is at most `tol` of its first.

    evaluate(point) gives losses, gradients and state; products(point, state) and inverse_at(state) give functions
    of (vectors, chosen classes); losses_along(point, step, fractions) the losses at parts of a step. A class whose
    step gains far less than hoped takes the best part of it.
    """
    point = start
    losses, slope, state = evaluate(point)
    limit = tol * np.maximum(1.0, np.linalg.norm(slope, axis=0))
    for _ in range(max_iter):
        open_ = np.linalg.norm(slope, axis=0) > limit
        if not open_.any():
            break
        step, hoped = conjugate_steps(products(point, state), inverse_at(state), slope * open_)
        trial = point + step
        found = evaluate(trial)
        # Close to the optimum a loss is known less well than the gain; the model is exact there.
        poor = open_ & (losses - found[0] < 0.25 * hoped) & (hoped > 1e-12 * np.abs(losses))
        if poor.any():
            parts = losses_along(point, step, FRACTIONS)
            part = np.where(poor & (parts.min(axis=0) < found[0]), FRACTIONS[parts.argmin(axis=0)], 1.0)
            if (part < 1).any():
                trial = point + part * step
                found = evaluate(trial)
            worse = poor & (found[0] >= losses)
            if worse[open_].all():
                break
            trial = np.where(worse, point, trial)
            found = tuple(_chosen(worse, old, new) for old, new in zip((losses, slope, state), found))
        point, (losses, slope, state) = trial, found
    return point


def _chosen(first, one, other):
    """Per class one of two values; classes are the last axis of vectors and matrices and the first of stacks."""
    if one is None:
        return None
    return np.where(first[:, None, None] if one.ndim == 3 else first, one, other)


def losses_at(df, weights, step, fractions, classes, cost=1.0, sparse=False):
    """Losses of all classes at the weights plus each fraction of a step, by one pass."""
    shared = folds.share(df, (weights, step), 2 * weights.nbytes, "weights")
    k = len(classes)

    def fold(batches):
        at, along = shared.value
        total = np.zeros((len(fractions), k))
        for batch in batches:
            if batch.num_rows:
                rows, signs = read_rows(batch, sparse), _targets(batch, classes)
                both = rows.dot(np.hstack([at[:-1], along[:-1]])) + np.hstack([at[-1], along[-1]])
                room, pace = 1.0 - signs * both[:, :k], signs * both[:, k:]
                for i, part in enumerate(fractions):
                    total[i] += cost * (np.maximum(0.0, room - part * pace) ** 2).sum(axis=0)
        return total.ravel()

    total = folds.folded(df.select(*_training_columns(sparse)), fold, len(fractions) * k).reshape(-1, k)
    shared.destroy()
    return total + np.stack([0.5 * _along(weights + part * step, weights + part * step) for part in fractions])


def minimised(rows, classes, size, cost, sparse, max_iter, tol, seed):
    """Weights of the squared hinge problems of all classes."""
    curved = len(classes) * size * size <= BLOCK_VALUES

    def evaluate(weights):
        return squared_hinge(rows, weights, classes, cost, sparse, curved)

    def products(weights, curvature):
        if curved:
            return lambda vectors, chosen: np.einsum("cij,jc->ic", curvature[chosen], vectors)
        return lambda vectors, chosen: curvature_products(rows, weights, vectors, chosen, classes, cost, sparse)

    sketched = None if curved else sketched_inverse(rows, size, cost, sparse, seed)

    def inverse_at(curvature):
        if curved:
            return lambda vectors, chosen: np.linalg.solve(curvature[chosen], vectors.T[:, :, None])[:, :, 0].T
        return sketched

    def along(weights, step, fractions):
        return losses_at(rows, weights, step, fractions, classes, cost, sparse)

    return newton(evaluate, products, inverse_at, along, np.zeros((size, len(classes))), max_iter, tol)


def decide(df, weights, classes, sparse=False):
    """Add `prediction`, the class with the largest decision value (the first one on ties)."""
    shared = folds.share(df, (weights, classes), weights.nbytes, "weights")
    note = peaks.watcher()

    def label_of(rows):
        matrix, names = shared.value
        out = pa.array(names[np.argmax(rows.dot(matrix[:-1]) + matrix[-1], axis=1)], pa.int32())
        note()
        return out

    columns = feature_columns(sparse)

    @F.arrow_udf("int")
    def predict_one(features: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([features], columns)
        return label_of(read_rows(batch, False)) if len(features) else pa.array([], pa.int32())

    @F.arrow_udf("int")
    def predict_sparse(idx: pa.Array, val: pa.Array) -> pa.Array:
        return label_of(read_rows(pa.RecordBatch.from_arrays([idx, val], columns), True))

    predict = predict_sparse if sparse else predict_one
    return df.withColumn("prediction", predict(*columns)).drop(*columns)


class _LinearClassifier:
    def __init__(self, scale_dense):
        self.scale_dense = scale_dense
        self.weights = self.classes = self.scaler = None
        self.sparse = False

    def _prepare(self, df):
        return self.scaler.transform(df) if self.scaler is not None else df

    def predict(self, df):
        return decide(self._prepare(df), self.weights, self.classes, self.sparse)


def _width(df, sparse):
    column = F.array_max("idx") + 1 if sparse else F.size("features")
    return df.agg(F.max(column).alias("d")).head()["d"]


class SquaredHingeSVM(_LinearClassifier):
    """One-vs-rest linear SVM with penalised intercept; dense rows may be standardised first."""

    name = "svm"

    def __init__(self, C=1.0, max_iter=5000, seed=42, scale_dense=False, tol=1e-4):
        super().__init__(scale_dense)
        self.C, self.max_iter, self.seed, self.tol = C, max_iter, seed, tol

    def fit(self, df, sparse=False, width=None):
        self.sparse = sparse
        if self.scale_dense and not sparse:
            self.scaler = scaling.fit_standardizer(df)
        rows = self._prepare(df).select(*_training_columns(sparse)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self.classes = class_values(rows)
            width = width or _width(rows, sparse)
            self.weights = minimised(rows, self.classes, width + 1, self.C, sparse, self.max_iter, self.tol, self.seed)
        finally:
            rows.unpersist()
        return self

    def params(self):
        return {"C": self.C, "max_iter": self.max_iter, "scale_dense": self.scale_dense}


# Rows per step of the local descent; one step moves against their mean subgradient.
STEP_ROWS = 16
# Published defaults of the schedules: the power of invscaling, and what adaptive divides its step by, down to the last.
POWER, SHRINK, LAST_STEP = 0.5, 5.0, 1e-6
SCHEDULES = ("optimal", "constant", "invscaling", "adaptive")
# Rows held and reordered at a time before stepping through them.
REORDER_ROWS = 8192


def buffered(batches, sparse, rng, limit=REORDER_ROWS, value_limit=8_000_000):
    """Record batches regrouped and reordered inside bounded windows."""
    held, rows, values = [], 0, 0

    def release():
        table = pa.Table.from_batches(held)
        order = rng.permutation(table.num_rows)
        return table.take(pa.array(order)).combine_chunks().to_batches()[0]

    for batch in batches:
        for start in range(0, batch.num_rows, limit):
            piece = batch.slice(start, limit)
            held.append(piece)
            rows += piece.num_rows
            values += len(piece.column(0).flatten())
            if rows >= limit or values >= value_limit:
                yield release()
                held, rows, values = [], 0, 0
    if rows:
        yield release()


def hinge_step_sizes(alpha):
    """The first step number of the 1 / (alpha t) schedule."""
    typical = np.sqrt(1.0 / np.sqrt(alpha))
    return 1.0 / (typical * alpha)


def step_sizes(schedule, alpha, step_size, step):
    """The size of a step: 1 / (alpha t), or the given sizes by class, for invscaling over a power of t."""
    if schedule == "optimal":
        return 1.0 / (alpha * step)
    return step_size / step**POWER if schedule == "invscaling" else step_size


class _Averaged:
    """Weights under shrinking steps, and the sum of all iterates.

    The weights are `scale` * `base`: shrinking touches one number per class, and a step only the
    features of its rows. With S the running sum of scales, the sum of iterates is
    S * base minus every step's change times the S before it.
    """

    def __init__(self, start):
        self.base, self.intercept = start[:-1].copy(), start[-1].copy()
        self.late = np.zeros_like(self.base)
        self.scale, self.scales = np.ones(start.shape[1]), np.zeros(start.shape[1])
        self.intercepts = np.zeros(start.shape[1])
        self.steps = 0

    def decision(self, rows):
        return rows.dot(self.base) * self.scale + self.intercept

    def step(self, rows, push, shrink):
        self.scale *= shrink
        at, change = rows.transposed_terms(push)
        change = change / self.scale
        self.base[at] += change
        self.late[at] += change * self.scales
        self.intercept += push.sum(axis=0)
        self.scales += self.scale
        self.intercepts += self.intercept
        self.steps += 1

    def current(self):
        return np.vstack([self.base * self.scale, self.intercept])

    def mean(self):
        return np.vstack([self.base * self.scales - self.late, self.intercepts]) / max(self.steps, 1)


def _hinge_fold(shared, classes, alpha, epoch, seed, sparse, schedule, step_rows):
    """One local epoch from shared weights, and the validation hits of the shared weights."""

    def fold(batches):
        start, first_step, active, step_size = shared.value
        rng = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()])
        weights = _Averaged(start)
        seen = checked = 0
        hits, losses = np.zeros(len(classes)), np.zeros(len(classes))
        for batch in buffered(batches, sparse, rng):
            rows, signs = read_rows(batch, sparse), _targets(batch, classes)
            held_out = batch.column("held_out").to_numpy(zero_copy_only=False)
            probe = np.flatnonzero(held_out)
            if len(probe):
                right = (rows.take(probe).dot(start[:-1]) + start[-1]) * signs[probe] > 0
                hits += right.sum(axis=0)
                checked += len(probe)
            learn = np.flatnonzero(~held_out)
            for at in range(0, len(learn), step_rows):
                part = learn[at : at + step_rows]
                x, y = rows.take(part), signs[part]
                eta = step_sizes(schedule, alpha, step_size, first_step + weights.steps)
                margin = weights.decision(x) * y
                losses += np.maximum(0.0, 1.0 - margin).sum(axis=0)
                wrong = (margin < 1.0) * active
                weights.step(x, y * wrong * (eta / len(part)), np.maximum(1.0 - eta * alpha * active, 1e-9))
            seen += len(learn)
        steps = weights.steps
        return np.concatenate(
            [seen * weights.current().ravel(), seen * weights.mean().ravel(), hits, losses, [seen, seen * steps, checked]]
        )

    return fold


def hinge_objective(df, weights, classes, alpha, sparse=False):
    """Per class: mean hinge loss + alpha / 2 |w|^2."""
    shared = folds.share(df, weights, weights.nbytes, "weights")

    def fold(batches):
        matrix = shared.value
        loss = np.zeros(len(classes) + 1)
        for batch in batches:
            if batch.num_rows:
                margin = _targets(batch, classes) * (read_rows(batch, sparse).dot(matrix[:-1]) + matrix[-1])
                loss[:-1] += np.maximum(0.0, 1.0 - margin).sum(axis=0)
                loss[-1] += batch.num_rows
        return loss

    state = folds.folded(df.select(*_training_columns(sparse)), fold, len(classes) + 1)
    return state[:-1] / state[-1] + alpha / 2 * (weights[:-1] ** 2).sum(axis=0)


class HingeSGD(_LinearClassifier):
    """Hinge loss by stochastic subgradient steps with averaged iterates.

    Rows are dealt by hash of their id to one worker per `rows_per_worker` rows and lie there in the
    order of their ids, so the fit does not depend on the layout of its input. An epoch is one job:
    every worker steps through its rows from the shared weights, and the results are averaged by
    row count. With one worker this is plain averaged SGD. A class stops when its held-out accuracy,
    or without early stopping its training loss, has not improved by `tol` for `n_iter_no_change` epochs;
    under the schedule `adaptive` its steps get smaller first. Steps are 1 / (alpha t) under `optimal`, and start
    from `eta0` otherwise.
    """

    name = "svm_sgd"

    def __init__(self, alpha=1e-4, max_iter=1000, tol=1e-3, seed=42, scale_dense=False, average=True,
                 early_stopping=True, validation_fraction=0.1, n_iter_no_change=5,
                 rows_per_worker=folds.ROWS_PER_WORKER, learning_rate="optimal", eta0=0.01, step_rows=STEP_ROWS):
        super().__init__(scale_dense)
        if learning_rate not in SCHEDULES:
            raise ValueError(f"Unknown learning rate schedule: {learning_rate}")
        if learning_rate != "optimal" and eta0 <= 0:
            raise ValueError("eta0 must be above 0")
        self.learning_rate, self.eta0, self.step_rows = learning_rate, eta0, step_rows
        self.alpha, self.max_iter, self.tol, self.seed = alpha, max_iter, tol, seed
        self.average, self.early_stopping = average, early_stopping
        self.validation_fraction, self.n_iter_no_change = validation_fraction, n_iter_no_change
        self.rows_per_worker = rows_per_worker
        self.epochs, self.workers = 0, 1

    def fit(self, df, sparse=False, width=None):
        self.sparse = sparse
        if self.scale_dense:
            self.scaler = scaling.fit_sparse_deviation(df, width) if sparse else scaling.fit_standardizer(df)
        marked = validation_split(self._prepare(df), self.validation_fraction, self.seed, self.early_stopping)
        rows = marked.select("id", *_training_columns(sparse), (F.col("part") == "val").alias("held_out"))
        self.workers = folds.workers_for(*stored_bytes(rows, feature_columns(sparse)), self.rows_per_worker)
        rows = folds.dealt(rows, self.workers).drop("id").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self.classes = class_values(rows)
            self._descend(rows, width or _width(rows, sparse))
        finally:
            rows.unpersist()
        return self

    def _epoch(self, rows, weights, step, active, sizes, epoch):
        shared = folds.share(rows, (weights, step, active, sizes), weights.nbytes, "weights")
        fold = _hinge_fold(
            shared, self.classes, self.alpha, epoch, self.seed, self.sparse, self.learning_rate, min(self.step_rows, REORDER_ROWS)
        )
        size, k = weights.size, len(self.classes)
        state = folds.folded(rows, fold, 2 * size + 2 * k + 3, self.workers)
        shared.destroy()
        seen, steps, checked = state[-3:]
        moved = state[:size].reshape(weights.shape) / seen
        mean = state[size : 2 * size].reshape(weights.shape) / seen
        if checked:
            gained = state[2 * size : 2 * size + k] / checked
        else:
            gained = -state[2 * size + k : 2 * size + 2 * k] / seen
        return moved, mean, steps / seen, gained, bool(checked)

    def _descend(self, rows, width):
        k = len(self.classes)
        weights, average = np.zeros((width + 1, k)), np.zeros((width + 1, k))
        active, best, stale = np.ones(k), np.full(k, -np.inf), np.zeros(k)
        epochs = np.zeros(k)
        step = hinge_step_sizes(self.alpha) if self.learning_rate == "optimal" else 1.0
        sizes = np.full(k, self.eta0)
        for epoch in range(self.max_iter):
            moved, mean, taken, gained, checked = self._epoch(rows, weights, step, active, sizes, epoch)
            if epoch or not checked:
                # Accuracies belong to the weights this epoch started from, losses to its steps.
                stale = np.where(gained > best + self.tol, 0, stale + 1)
                best = np.maximum(best, gained)
                over = stale >= self.n_iter_no_change
                if self.learning_rate == "adaptive":
                    smaller = over & (sizes > LAST_STEP)
                    sizes, stale, over = np.where(smaller, sizes / SHRINK, sizes), np.where(smaller, 0, stale), over & ~smaller
                active = active * ~over
                if not active.any():
                    break
            running = active > 0
            average[:, running] += (mean - average)[:, running] / (epochs[running] + 1)
            weights[:, running] = moved[:, running]
            epochs += active
            step += taken
        self.epochs = int(epochs.max())
        self.weights = average if self.average else weights

    def params(self):
        return {
            "alpha": self.alpha, "max_iter": self.max_iter, "tol": self.tol, "scale_dense": self.scale_dense,
            "learning_rate": self.learning_rate, "eta0": self.eta0, "average": self.average, "early_stopping": self.early_stopping,
            "validation_fraction": self.validation_fraction, "n_iter_no_change": self.n_iter_no_change,
        }
