"""Dense and sparse forms, image layouts, feature memory, and unique column names."""

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def to_sparse(df):
    """features -> idx, val without the zeros."""
    pairs = F.filter(
        F.transform("features", lambda x, i: F.struct(i.cast("int").alias("idx"), x.alias("val"))),
        lambda p: p["val"] != 0,
    )
    return (
        df.withColumn("_p", pairs)
        .withColumn("idx", F.col("_p.idx"))
        .withColumn("val", F.col("_p.val"))
        .drop("_p", "features")
    )


def to_dense(df, width):
    """idx (ascending), val -> features of `width` values, the gaps filled with zeros."""
    zero = F.lit(0.0)

    def with_gap(value, p):
        before = F.when(p == 0, F.lit(0)).otherwise(F.get("idx", p - 1) + 1)
        return F.concat(F.array_repeat(zero, F.get("idx", p) - before), F.array(value))

    last = F.coalesce(F.array_max("idx"), F.lit(-1))
    tail = F.array(F.array_repeat(zero, F.lit(width - 1) - last))
    return df.withColumn("features", F.flatten(F.concat(F.transform("val", with_gap), tail))).drop("idx", "val")


def force_form(table, wanted):
    """The table in the wanted form: None keeps it, otherwise 'dense' or 'sparse'."""
    if wanted not in (None, "dense", "sparse"):
        raise ValueError(f"unknown matrix form: {wanted}")
    if wanted == "dense" and table.sparse:
        return table.with_df(to_dense(table.df, table.input_dim), sparse=False)
    if wanted == "sparse" and not table.sparse:
        return table.with_df(to_sparse(table.df), sparse=True)
    return table


def channels_last(df, height, width, channels):
    """Planar images (channel, row, column) -> (row, column, channel)."""
    plane = height * width
    return df.withColumn(
        "features",
        F.transform(
            F.sequence(F.lit(0), F.lit(plane * channels - 1)),
            lambda p: F.get("features", ((p % channels) * plane + F.floor(p / channels)).cast("int")),
        ),
    )


def channels_first(df, height, width, channels):
    """(row, column, channel) -> planar (channel, row, column)."""
    plane = height * width
    return df.withColumn(
        "features",
        F.transform(
            F.sequence(F.lit(0), F.lit(plane * channels - 1)),
            lambda p: F.get("features", ((p % plane) * channels + F.floor(p / plane)).cast("int")),
        ),
    )


def feature_memory(df, sparse=False, value_bytes=4):
    """Rows and MiB of the features: the full matrix, or values, numbers and row pointers."""
    if sparse:
        stored = F.sum(F.size("idx"))
        size = stored * (value_bytes + 4) + (F.count("*") + 1) * 4
    else:
        size = F.sum(F.size("features")) * value_bytes
    return df.agg(F.count("*").alias("n"), (size / F.lit(float(1 << 20))).alias("memory_mb"))


MAX_SPANS = 10_000


def _cut_by_order(df, order_col, span_rows):
    """Add `_span`, the number of an equal share of the rows along `order_col`."""
    spans = min(MAX_SPANS, df.count() // span_rows + 1)
    if spans == 1:
        return df.withColumn("_span", F.lit(0.0))
    shares = [i / spans for i in range(1, spans)]
    edges = sorted(set(df.approxQuantile(order_col, shares, 1 / (4 * spans))))
    splits = [float("-inf"), *edges, float("inf")]
    return Bucketizer(splits=splits, inputCol="_order", outputCol="_span").transform(
        df.withColumn("_order", F.col(order_col).cast("double"))
    ).drop("_order")


def occurrence_number(df, order_col, name_col, span_rows=100_000):
    """How often the name has appeared so far along a unique order.

    The rows are cut into spans of similar size: occurrences are counted per span, summed over
    the spans before, and numbered inside a span, so a name holding most of the rows is still
    cut into pieces.
    """
    cut = _cut_by_order(df, order_col, span_rows)
    before = F.sum("n").over(W.partitionBy(name_col).orderBy("_span").rowsBetween(W.unboundedPreceding, -1))
    offsets = (
        cut.groupBy(name_col, "_span")
        .agg(F.count("*").alias("n"))
        .select(name_col, "_span", F.coalesce(before, F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(W.partitionBy(name_col, "_span").orderBy(order_col))
    return (
        cut.withColumn("_inside", inside)
        .join(offsets, [name_col, "_span"])
        .withColumn("nth", F.col("_before") + F.col("_inside"))
        .drop("_span", "_before", "_inside")
    )


def unique_names(df, order_col, name_col):
    """Repeated names get _2, _3, ... in order of appearance."""
    return occurrence_number(df, order_col, name_col).withColumn(
        "unique_name", F.when(F.col("nth") == 1, F.col(name_col)).otherwise(F.concat_ws("_", name_col, "nth"))
    )


def widen(df, names):
    """One double column per feature; a row with another number of features than names is an error."""
    kept = [F.col(c) for c in df.columns if c != "features"]
    wrong = F.raise_error(F.concat(F.lit(f"{len(names)} names for "), F.size("features"), F.lit(" features")))
    checked = F.when(F.size("features") == len(names), F.col("features")).otherwise(wrong)
    wide = df.select(*kept, checked.alias("_features"))
    return wide.select(*kept, *[F.get("_features", F.lit(i)).alias(name) for i, name in enumerate(names)])
