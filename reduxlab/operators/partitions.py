"""k-means and diagonal Gaussian mixtures: all restarts advance in the same pass."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.storagelevel import StorageLevel

from ..functions import folds, moments
from ..functions.matrices import as_list_column, dense

_DRAWS = pa.schema(
    [
        ("restart", pa.int32()),
        ("salt", pa.int32()),
        ("key", pa.float64()),
        ("id", pa.int64()),
        ("features", pa.list_(pa.float64())),
    ]
)
_GOLDEN, _MIX1, _MIX2 = (np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def row_uniforms(ids, seed, stream):
    """A number in (0, 1) per id and stream, by 64-bit mixing: independent of the layout."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + _GOLDEN * np.uint64((seed + 1) * 1_000_003 + stream + 1)
        z = (z ^ (z >> np.uint64(30))) * _MIX1
        z = (z ^ (z >> np.uint64(27))) * _MIX2
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def square_distances(x, centers):
    """(rows, centers) squared distances, taken around the centers so that a far origin costs no digits."""
    origin = centers.mean(axis=0)
    x, centers = x - origin, centers - origin
    cross = x @ centers.T
    return np.maximum(
        np.einsum("ij,ij->i", x, x)[:, None] - 2.0 * cross + np.einsum("ij,ij->i", centers, centers)[None, :], 0.0
    )


def _rows(df):
    return df.select(F.col("id").cast("long").alias("id"), "features")


#: Passes that draw candidates, and candidates of a pass per wanted center.
SEED_ROUNDS = 5
OVERSAMPLING = 2


def _smallest(keys, ids, count):
    """Places of the smallest (key, id), in order."""
    near = np.flatnonzero(keys <= np.partition(keys, count - 1)[count - 1]) if len(keys) > count else np.arange(len(keys))
    return near[np.lexsort((ids[near], keys[near]))][:count]


def _draw_fold(shared, restarts, count, seed, turn, fan_in):
    """Per restart the rows of a weighted draw: those with the smallest exponential time over squared distance."""

    def fold(batches):
        candidates = shared.value
        held = [None] * restarts
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column("id").to_numpy(), dense(batch.column("features"))
            for r in range(restarts):
                keys = -np.log(row_uniforms(ids, seed, turn * restarts + r))
                if candidates is not None:
                    weight = square_distances(x, candidates[r]).min(axis=1)
                    # Copies of a candidate are not drawn while other rows remain.
                    keys = np.where(weight > 1e-12, keys / np.maximum(weight, 1e-300), np.finfo(float).max)
                found = _smallest(keys, ids, count)
                found = keys[found], ids[found], x[found]
                if held[r] is not None:
                    found = tuple(np.concatenate(both) for both in zip(held[r], found))
                    found = tuple(part[_smallest(found[0], found[1], count)] for part in found)
                held[r] = found
        salt = TaskContext.get().partitionId() % fan_in
        for r, found in enumerate(held):
            if found is not None:
                keys, ids, x = found
                columns = [np.full(len(ids), r, dtype=np.int32), np.full(len(ids), salt, dtype=np.int32), keys, ids]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), as_list_column(x)], schema=_DRAWS)

    return fold


def _draw(df, candidates, restarts, count, dims, seed, turn):
    """(restarts, count, dims) rows drawn by their squared distance to the candidates, without replacement.

    A table with fewer rows gives all of them, the last one several times.
    """
    shared = folds.share(df, candidates, 0 if candidates is None else candidates.nbytes, "cluster centers")
    tasks = folds.task_limit(df)
    inside = tasks * restarts * count * (dims + 4) * 8 > folds.DRIVER_BYTES
    fan_in = max(2, int(tasks**0.5)) if inside else 1
    drawn = df.coalesce(tasks).mapInArrow(_draw_fold(shared, restarts, count, seed, turn, fan_in), from_arrow_schema(_DRAWS))
    for groups in (["restart", "salt"], ["restart"]) if inside else ():
        place = F.row_number().over(Window.partitionBy(*groups).orderBy("key", "id"))
        drawn = drawn.withColumn("place", place).filter(F.col("place") <= count).drop("place")
    table = drawn.toArrow()
    shared.destroy()
    restart, keys, ids = (table[c].to_numpy() for c in ("restart", "key", "id"))
    vectors = dense(table["features"].combine_chunks())
    out = []
    for r in range(restarts):
        own = np.flatnonzero(restart == r)
        own = own[_smallest(keys[own], ids[own], count)]
        out.append(vectors[np.r_[own, np.full(count - len(own), own[-1])]])
    return np.stack(out)


def _weigh_fold(shared):
    """Per restart and candidate the number of rows that lie nearest to it."""

    def fold(batches):
        candidates = shared.value
        total = np.zeros(candidates.shape[:2])
        for batch in batches:
            if batch.num_rows:
                x = dense(batch.column("features"))
                for r, centers in enumerate(candidates):
                    total[r] += np.bincount(square_distances(x, centers).argmin(axis=1), minlength=len(centers))
        return total.ravel()

    return fold


def weighted_centers(x, weights, n_clusters, rng, steps=20):
    """k-means of few weighted points: greedy k-means++ and Lloyd steps."""
    trials = 2 + int(np.log(n_clusters))

    def drawn(mass, count):
        mass = mass if mass.sum() > 0 else weights
        return rng.choice(len(x), size=count, p=mass / mass.sum())

    centers = x[drawn(weights, 1)]
    gap = square_distances(x, centers)[:, 0]
    while len(centers) < n_clusters:
        choices = drawn(weights * np.where(gap > 1e-12, gap, 0.0), trials)
        left = np.minimum(gap[:, None], square_distances(x, x[choices]))
        best = int((weights @ left).argmin())
        gap, centers = left[:, best], np.vstack([centers, x[choices[best]]])
    for _ in range(steps):
        code = square_distances(x, centers).argmin(axis=1)
        mass = np.bincount(code, weights, minlength=n_clusters)
        member = np.zeros((len(x), n_clusters))
        member[np.arange(len(x)), code] = weights
        moved = np.where(mass[:, None] > 0, member.T @ x / np.maximum(mass, 1e-300)[:, None], centers)
        if np.array_equal(moved, centers):
            break
        centers = moved
    return centers


def seed_centers(df, n_clusters, restarts, seed):
    """k-means|| for all restarts at once: the number of passes does not depend on the number of centers.

    One row is drawn, then `SEED_ROUNDS` passes draw some rows each by their squared distance to those drawn
    before, and one pass counts the rows nearest to each of these candidates; their weighted k-means on the driver,
    which holds some ten rows per center and restart, gives the centers.
    """
    first = df.head()
    if first is None:
        raise ValueError("no rows to cluster")
    dims = len(first["features"])
    candidates = _draw(df, None, restarts, 1, dims, seed, 0)
    for turn in range(1, SEED_ROUNDS + 1):
        drawn = _draw(df, candidates, restarts, OVERSAMPLING * n_clusters, dims, seed, turn)
        candidates = np.concatenate([candidates, drawn], axis=1)
    shared = folds.share(df, candidates, candidates.nbytes, "cluster centers")
    size = restarts * candidates.shape[1]
    weights = folds.folded(df.select("features"), _weigh_fold(shared), size).reshape(restarts, -1)
    shared.destroy()
    return np.stack(
        [weighted_centers(x, w, n_clusters, np.random.default_rng([seed, r])) for r, (x, w) in enumerate(zip(candidates, weights))]
    )


def _lloyd_fold(shared):
    def fold(batches):
        centers = shared.value
        restarts, k, dims = centers.shape
        origin = centers.mean(axis=(0, 1))
        sums, counts, spread = np.zeros((restarts, k, dims)), np.zeros((restarts, k)), np.zeros(restarts)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = dense(batch.column("features"))
            for r in range(restarts):
                gaps = square_distances(x, centers[r])
                code = gaps.argmin(axis=1)
                member = np.zeros((len(x), k))
                member[np.arange(len(x)), code] = 1.0
                sums[r] += member.T @ (x - origin)
                counts[r] += member.sum(axis=0)
                spread[r] += gaps[np.arange(len(x)), code].sum()
        return np.concatenate([sums.ravel(), counts.ravel(), spread])

    return fold


def lloyd_pass(df, centers):
    """Per restart and cluster: new centers and counts; per restart: total squared distance. Without rows a center stays."""
    restarts, k, dims = centers.shape
    shared = folds.share(df, centers, centers.nbytes, "centers")
    size = centers.size
    state = folds.folded(df.select("features"), _lloyd_fold(shared), size + restarts * k + restarts)
    shared.destroy()
    counts = state[size : size + restarts * k].reshape(restarts, k)
    means = state[:size].reshape(centers.shape) / np.maximum(counts, 1)[..., None] + centers.mean(axis=(0, 1))
    return np.where(counts[..., None] > 0, means, centers), counts, state[-restarts:]


def _mean_variance(df):
    mass, _, m2 = moments.table_moments(df)
    return float((m2 / mass).mean())


def assign_clusters(df, centers):
    """id, cluster: the nearest center, the first one on ties."""
    shared = folds.share(df, centers, centers.nbytes, "centers")

    @F.arrow_udf("int")
    def nearest(features: pa.Array) -> pa.Array:
        if not len(features):
            return pa.array([], pa.int32())
        return pa.array(square_distances(dense(features), shared.value).argmin(axis=1), pa.int32())

    return df.withColumn("cluster", nearest("features"))


def lloyd_step(df, centers):
    """The step that fits take, from given centers, as a table: cluster, pos, n, and the new center by position."""
    moved, counts, _ = lloyd_pass(df, centers[None])
    rows = [(c, f, int(counts[0, c]), float(v)) for c, center in enumerate(moved[0]) if counts[0, c] for f, v in enumerate(center)]
    return df.sparkSession.createDataFrame(rows, "cluster int, pos int, n long, center double")


@dataclass
class KMeans:
    """Best of `n_init` k-means|| starts by total squared distance.

    A restart stops when its centers move less than `tol` times the mean feature variance. A
    cluster that loses all rows keeps its center.
    """

    n_clusters: int = 10
    max_iter: int = 300
    seed: int = 42
    n_init: int = 10
    tol: float = 1e-4
    centers: np.ndarray | None = None
    inertia: float | None = None
    all_centers: np.ndarray | None = None

    def fit(self, df):
        rows = _rows(df).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self.fit_stored(rows)
        finally:
            rows.unpersist()

    def fit_stored(self, rows):
        """The same for rows that the caller keeps in storage."""
        centers = seed_centers(rows, self.n_clusters, self.n_init, self.seed)
        limit = self.tol * _mean_variance(rows)
        running = np.ones(self.n_init, dtype=bool)
        spread = np.full(self.n_init, np.inf)
        for _ in range(self.max_iter):
            alive = np.flatnonzero(running)
            moved, _, total = lloyd_pass(rows, centers[alive])
            shift = ((moved - centers[alive]) ** 2).sum(axis=(1, 2))
            centers[alive], spread[alive] = moved, total
            running[alive] = shift > limit
            if not running.any():
                break
        spread = lloyd_pass(rows, centers)[2]
        best = int(spread.argmin())
        self.centers, self.inertia, self.all_centers = centers[best], float(spread[best]), centers
        return self

    def transform(self, df):
        return assign_clusters(df, self.centers)


@dataclass(frozen=True)
class Mixture:
    """Weights, means and diagonal variances of one mixture."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    def log_joint(self, x):
        """(rows, components) log weight + log density."""
        precision, origin = 1.0 / self.variances, self.means.mean(axis=0)
        x, means = x - origin, self.means - origin
        quadratic = (x * x) @ precision.T - 2.0 * (x @ (means * precision).T) + (means**2 * precision).sum(axis=1)
        constant = np.log(self.weights) - 0.5 * (x.shape[1] * np.log(2 * np.pi) + np.log(self.variances).sum(axis=1))
        return constant - 0.5 * quadratic

    def shares(self, x):
        """Log likelihood of each row and the responsibilities."""
        joint = self.log_joint(x)
        peak = joint.max(axis=1, keepdims=True)
        scaled = np.exp(joint - peak)
        total = scaled.sum(axis=1, keepdims=True)
        return (peak + np.log(total))[:, 0], scaled / total


def _maximise(state, reg_covar):
    """The mixture of one state (mass, mean, M2), each by component and feature."""
    mass, means, m2 = state
    # Ten machine epsilons keep an empty component finite.
    mass = mass[:, :1] + 10 * np.finfo(float).eps
    return Mixture(mass[:, 0] / mass.sum(), means, m2 / mass + reg_covar)


def _gather(df, responsibilities, restarts, k, dims):
    """Per restart the state of its components, and the mean log likelihood of a row."""

    def state_of(batch):
        x = dense(batch.column("features"))
        parts, logs = [], []
        for r in range(restarts):
            log, shares = responsibilities(r, x)
            parts.append(moments.of_shares(x, shares))
            logs.append(log / len(x))
        # Log likelihoods are means too: a mass, a value and nothing to deviate.
        ends = np.stack([np.full(restarts, float(len(x))), logs, np.zeros(restarts)])
        return np.hstack([*parts, ends])

    size = restarts * k * dims
    state = moments.merged(df.select("features"), state_of, moments.merge, 3, 3 * (size + restarts))
    return state[:, :size].reshape(3, restarts, k, dims).swapaxes(0, 1), state[1, size:]


def expectation_step(df, mixtures):
    """States under the responsibilities of every mixture, and mean log likelihoods."""
    k, dims = mixtures[0].means.shape
    shared = folds.share(df, mixtures, len(mixtures) * k * dims * 16, "mixtures")

    def responsibilities(r, x):
        logs, shares = shared.value[r].shares(x)
        return logs.sum(), shares

    out = _gather(df, responsibilities, len(mixtures), k, dims)
    shared.destroy()
    return out


def hard_moments(df, centers):
    """States when every row belongs to its nearest center."""
    restarts, k, dims = centers.shape
    shared = folds.share(df, centers, centers.nbytes, "centers")

    def responsibilities(r, x):
        shares = np.zeros((len(x), k))
        shares[np.arange(len(x)), square_distances(x, shared.value[r]).argmin(axis=1)] = 1.0
        return 0.0, shares

    out = _gather(df, responsibilities, restarts, k, dims)[0]
    shared.destroy()
    return out


def em_step(df, mixture, reg_covar=1e-4):
    """One expectation and maximisation step: the new mixture and the old mean log likelihood."""
    states, likelihood = expectation_step(df, [mixture])
    return _maximise(states[0], reg_covar), float(likelihood[0])


@dataclass
class GaussianMixture:
    """Diagonal mixture by EM from `n_init` k-means starts; the best lower bound wins."""

    n_components: int = 10
    max_iter: int = 300
    seed: int = 42
    n_init: int = 3
    reg_covar: float = 1e-4
    tol: float = 1e-3
    mixture: Mixture | None = None
    lower_bound: float | None = None
    history: list | None = None

    def fit(self, df):
        rows = _rows(df).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            starts = KMeans(self.n_components, seed=self.seed, n_init=self.n_init).fit_stored(rows).all_centers
            mixtures = [_maximise(m, self.reg_covar) for m in hard_moments(rows, starts)]
            bounds = np.full(self.n_init, -np.inf)
            running = list(range(self.n_init))
            self.history = [[] for _ in mixtures]
            for _ in range(self.max_iter):
                states, likelihood = expectation_step(rows, [mixtures[r] for r in running])
                still = []
                for r, state, bound in zip(running, states, likelihood):
                    mixtures[r] = _maximise(state, self.reg_covar)
                    self.history[r].append(float(bound))
                    if abs(bound - bounds[r]) >= self.tol:
                        still.append(r)
                    bounds[r] = bound
                running = still
                if not running:
                    break
            best = int(bounds.argmax())
            self.mixture, self.lower_bound = mixtures[best], float(bounds[best])
        finally:
            rows.unpersist()
        return self

    def transform(self, df):
        """Add the most likely component as `cluster`."""
        mixture = self.mixture
        shared = folds.share(df, mixture, mixture.means.nbytes * 2, "mixture")

        @F.arrow_udf("int")
        def likeliest(features: pa.Array) -> pa.Array:
            if not len(features):
                return pa.array([], pa.int32())
            return pa.array(shared.value.log_joint(dense(features)).argmax(axis=1), pa.int32())

        return df.withColumn("cluster", likeliest("features"))
