import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from reduxlab.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="8", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """A dense table from a matrix and labels, over several partitions."""

    def build(matrix, labels=None, parts=3):
        labels = np.zeros(len(matrix), dtype=int) if labels is None else labels
        rows = [(i, [float(v) for v in x], int(y)) for i, (x, y) in enumerate(zip(matrix, labels))]
        return spark.createDataFrame(rows, "id long, features array<double>, label int").repartition(parts)

    return build


def matrix_of(df, column="features"):
    return np.array([row[column] for row in df.orderBy("id").select(column).collect()])


def blobs(seed=0, per=40, centers=4, dims=6, spread=0.3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(scale=6, size=(centers, dims))
    labels = np.repeat(np.arange(centers), per)
    return middles[labels] + rng.normal(scale=spread, size=(len(labels), dims)), labels
