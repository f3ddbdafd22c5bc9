"""The given tables in the roles of the feature tables the experiments work on."""

from pyspark.sql import functions as F

from ..sources.tables import FeatureTable, read_dense

LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PLANTED = 4.0


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark, sf_dir):
    """64 dense features, 10 labels; also read as 8 x 8 or 4 x 4 x 4 images."""
    return read_dense(spark, f"{sf_dir}/embeddings.parquet", "vec_id", "embedding", "label")


def planted(df, size=PLANTED):
    """Give the labels a signal: `size` is added to the feature numbered like the label."""
    return df.withColumn(
        "features", F.transform("features", lambda x, i: x + F.when(i == F.col("label"), F.lit(size)).otherwise(F.lit(0.0)))
    )


def patterned(df, size=1.0):
    """Give every label a pattern over all features, which survives scaling and projection."""
    return df.withColumn(
        "features", F.transform("features", lambda x, i: x + F.lit(size) * (F.col("label") * (F.floor(i / 8) + 1) % 11 - 5))
    )


def thinned(df, least=0.1):
    """Small entries become zeros, for the sparse forms."""
    return df.withColumn(
        "features", F.transform("features", lambda x: F.when(F.abs(x) >= F.lit(least), x).otherwise(F.lit(0.0)))
    )


def tapered(df, base=0.8):
    """Later features shrink, so that the principal axes are far apart."""
    return df.withColumn("features", F.transform("features", lambda x, i: x * F.pow(F.lit(base), i)))


def line_features(spark, sf_dir):
    """Four numeric columns of every order line, labelled by return flag."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.array(*LINE_COLUMNS).alias("features"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("label"),
    )


def dense_table(df, split=None, image_shape=None, name="embeddings", n_classes=10, width=64, kind="dense_sensor"):
    return FeatureTable(name, df, width, n_classes, kind, image_shape)


def long_form(df, column="features", value="value"):
    return df.select("id", F.posexplode(column).alias("pos", value))
