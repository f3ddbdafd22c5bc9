"""Feature tables: a DataFrame with explicit ids plus a few facts about it."""

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.matrices import feature_columns


@dataclass(frozen=True)
class FeatureTable:
    """Columns: id, split ('train'/'test' or absent), label, and `features` or `idx` + `val`."""

    name: str
    df: DataFrame
    input_dim: int
    n_classes: int
    feature_kind: str
    image_shape: tuple | None = None
    sparse: bool = False
    layout: str | None = None

    @property
    def columns(self):
        return feature_columns(self.sparse)

    def part(self, split):
        return self.df.filter(F.col("split") == split).drop("split")

    def with_df(self, df, **changes):
        return replace(self, df=df, **changes)


def vector_width(df, column="features"):
    """Input dimension, read from one row."""
    row = df.select(F.size(column).alias("d")).head()
    return row["d"] if row else 0


def class_count(df, label_col="label"):
    return df.agg(F.countDistinct(label_col).alias("n")).head()["n"]


def highest_label_count(df, label_col="label"):
    """One more than the largest label, whether or not every label occurs."""
    return df.agg((F.max(label_col) + 1).alias("n")).head()["n"]


def read_dense(spark, path, id_col, features_col, label_col):
    return spark.read.parquet(path).select(
        F.col(id_col).cast("long").alias("id"),
        F.col(features_col).cast("array<double>").alias("features"),
        F.col(label_col).cast("int").alias("label"),
    )


def spread(scan):
    """Deal a scan of fewer splits than cores out to all of them; a larger one stays as read.

    For text: a few small files hold minutes of work that would run in a few tasks.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def stack_with_origin(train, test):
    """Both given parts as one table that remembers where each row came from."""
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


def first_label(df, labels_col="labels"):
    """Multilabel rows -> their first positive label; rows without any are dropped."""
    return df.filter(F.size(labels_col) > 0).withColumn("label", F.array_min(labels_col).cast("int")).drop(labels_col)


def rebase_label(df, base=1):
    return df.withColumn("label", (F.col("label") - base).cast("int"))
