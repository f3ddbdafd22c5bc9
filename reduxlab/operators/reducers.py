"""The six reducers by name: setup(table) -> fit(df) -> transform(df)."""

import copy
import math

from ..errors import ReductionError
from . import projection, spectral
from .layout import to_dense, to_sparse


class Reducer:
    name = ""

    def __init__(self, n_components=None, seed=42):
        self.n_components = n_components
        self.seed = seed
        self.table = None
        self.map = None

    def setup(self, table):
        """Learn the facts of the table: width, form, image shape."""
        self.table = table
        return self

    def fit(self, df):
        return self

    def transform(self, df):
        if self.map is None:
            raise RuntimeError(f"{self.name} must be set up and fitted before use")
        return self.map.transform(df, self.table.sparse)

    def fit_transform(self, df):
        return self.fit(df).transform(df)

    def sparse_output(self):
        return False

    def sliced(self, k):
        """A fitted reducer to fewer components: the first ones, as every reducer here is nested."""
        if k > self.n_components:
            raise ValueError(f"fitted to {self.n_components} components, {k} wanted")
        out = copy.copy(self)
        out.n_components, out.map = k, self._first(k)
        return out

    def _first(self, k):
        return self.map.first(k)

    def params(self):
        return {"n_components": self.n_components, "random_state": self.seed}

    def _require_setup(self):
        if self.table is None:
            raise RuntimeError(f"{self.name} must be set up before use")
        return self.table


class Identity(Reducer):
    name = "identity"

    def transform(self, df):
        return df

    def sparse_output(self):
        return bool(self.table and self.table.sparse)


class GaussianProjection(Reducer):
    name = "gaussian_rp"

    def fit(self, df):
        width = self._require_setup().input_dim
        self.map = projection.LinearMap(projection.gaussian_weights(df.sparkSession, width, self.n_components, self.seed))
        return self


    def _first(self, k):
        # Entries of N(0, 1/k).
        return self.map.first(k, math.sqrt(self.n_components / k))


class SparseProjection(Reducer):
    name = "sparse_rp"

    def fit(self, df):
        width = self._require_setup().input_dim
        self.map = projection.sparse_map(df.sparkSession, width, self.n_components, self.seed)
        return self

    def transform(self, df):
        out = super().transform(df)
        return to_sparse(out) if self.sparse_output() else out

    def sparse_output(self):
        return self.dense_output is False

    def __init__(self, n_components=None, seed=42, dense_output=None):
        super().__init__(n_components, seed)
        self.dense_output = dense_output

    def setup(self, table):
        super().setup(table)
        if self.dense_output is None:
            self.dense_output = not table.sparse
        return self

    def params(self):
        return {**super().params(), "dense_output": self.dense_output}


class FullPCA(Reducer):
    """Exact principal components; sparse tables only when filling them in is allowed."""

    name = "pca_svd"

    def __init__(self, n_components=None, seed=42, allow_dense_sparse=False):
        super().__init__(n_components, seed)
        self.allow_dense_sparse = allow_dense_sparse

    def _dense(self, df):
        if not self._require_setup().sparse:
            return df
        if not self.allow_dense_sparse:
            raise ReductionError("full PCA needs dense rows: allow filling in, or use randomized_svd")
        return to_dense(df, self.table.input_dim)

    def fit(self, df):
        mean, axes, _ = spectral.full_components(self._dense(df), self._require_setup().input_dim, self.n_components)
        self.map = projection.LinearMap(axes, mean)
        return self

    def transform(self, df):
        if self.map is None:
            raise RuntimeError("pca_svd must be set up and fitted before use")
        return self.map.transform(self._dense(df))

    def params(self):
        return {**super().params(), "svd_solver": "full", "allow_dense_sparse": self.allow_dense_sparse}


class RandomizedSVD(Reducer):
    """Uncentred, so sparse tables stay sparse."""

    name = "randomized_svd"
    centre = False

    def __init__(self, n_components=None, seed=42, n_iter=5):
        super().__init__(n_components, seed)
        self.n_iter = n_iter

    def fit(self, df):
        table = self._require_setup()
        mean, axes, _ = spectral.randomized_components(
            df, table.input_dim, self.n_components, self.n_iter, self.seed, self.centre, table.sparse
        )
        self.map = projection.LinearMap(axes, mean)
        return self

    def params(self):
        return {**super().params(), "algorithm": "randomized", "n_iter": self.n_iter}


class RandomizedPCA(RandomizedSVD):
    """The same range finder on centred rows."""

    name = "pca"
    centre = True

    def __init__(self, n_components=None, seed=42, n_iter=7):
        super().__init__(n_components, seed, n_iter)


class CosineTransform(Reducer):
    """First DCT-II coefficients: along the features, or over rows and columns of images."""

    name = "dct"

    def __init__(self, n_components=None, seed=42, mode="auto"):
        super().__init__(n_components, seed)
        self.mode = mode

    def fit(self, df):
        table = self._require_setup()
        if table.image_shape is not None and self.mode in ("auto", "image2d"):
            weights = self._image_weights(tuple(table.image_shape))
        else:
            kept = min(self.n_components, table.input_dim)
            weights = projection.cosine_matrix(table.input_dim, range(kept))
        self.map = projection.LinearMap(weights)
        return self

    def _image_weights(self, shape):
        if len(shape) not in (2, 3):
            raise ReductionError(f"images need two or three dimensions, not {shape}")
        height, width, channels = (*shape, 1)[:3]
        selected = projection.low_frequency_order(height, width, channels, self.n_components)
        if len(selected) < self.n_components:
            raise ReductionError(f"{self.n_components} coefficients wanted, {len(selected)} exist")
        return projection.image_cosine_matrix(height, width, channels, selected)

    def params(self):
        return {**super().params(), "mode": self.mode}


def make_reducer(name, n_components=None, seed=42, *, allow_dense_sparse_pca=False, dct_mode="auto",
                 randomized_svd_iter=5, **_):
    """A reducer by its case-insensitive name; unused options are for other stages."""
    makers = {
        "identity": lambda: Identity(None, seed),
        "sparse_rp": lambda: SparseProjection(n_components, seed),
        "gaussian_rp": lambda: GaussianProjection(n_components, seed),
        "pca_svd": lambda: FullPCA(n_components, seed, allow_dense_sparse_pca),
        "randomized_svd": lambda: RandomizedSVD(n_components, seed, randomized_svd_iter),
        "dct": lambda: CosineTransform(n_components, seed, dct_mode),
    }
    if name.lower() not in makers:
        raise ValueError(f"Unknown reducer: {name}")
    return makers[name.lower()]()


def make_cluster_reducer(name, n_components, seed=42):
    """The four methods compared by the clustering sweep; its DCT is always one-dimensional."""
    makers = {
        "pca": lambda: RandomizedPCA(n_components, seed),
        "rp": lambda: GaussianProjection(n_components, seed),
        "srp": lambda: SparseProjection(n_components, seed, dense_output=True),
        "dct": lambda: CosineTransform(n_components, seed, mode="1d"),
    }
    if name.lower() not in makers:
        raise ValueError(f"Unknown method: {name}")
    return makers[name.lower()]()


def feasible_dims(dims, input_dim):
    """Wanted dimensions that the table has."""
    return [k for k in dims if k is None or k <= input_dim]
