"""Matrices kept as whitespace-separated text, matched with other files by line number."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A broadcast of this many (file, block) starts is a few MiB; more are joined by shuffle.
MAX_BROADCAST_BLOCKS = 50_000


def numbered_lines(spark, path):
    """line (from 0, over files in name order) and value.

    A split of a file is read in order by one task, so a line's number is the lines in the
    splits before it plus its place in its own split. Only the counts per split are shuffled.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("mark"),
    )
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("mark").alias("first"))
    before = F.sum("n").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1))
    # One row per split of a file.
    starts = sizes.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    if sizes.limit(MAX_BROADCAST_BLOCKS + 1).count() <= MAX_BROADCAST_BLOCKS:
        starts = F.broadcast(starts)
    return lines.join(starts, ["file", "block"]).select(
        (F.col("before") + F.col("mark") - F.col("first")).alias("line"), "value"
    )


def read_matrix(spark, path):
    """id = line number, features = the numbers of the line."""
    numbers = F.split(F.trim("value"), r"\s+").cast("array<double>")
    return numbered_lines(spark, path).select(F.col("line").alias("id"), numbers.alias("features"))


def read_column(spark, path, name):
    """id = line number and one whole number per line."""
    return numbered_lines(spark, path).select(F.col("line").alias("id"), F.trim("value").cast("int").alias(name))


def read_labelled_matrix(spark, matrix_path, label_path, subject_path=None, first_label=1):
    """Rows and labels (re-based to 0) joined on their line number."""
    out = read_matrix(spark, matrix_path).join(read_column(spark, label_path, "label"), "id")
    if subject_path:
        out = out.join(read_column(spark, subject_path, "subject"), "id")
    return out.withColumn("label", F.col("label") - first_label)


def write_matrix(df, path, files):
    """Write features as text lines in id order, over several files."""
    text = F.array_join(F.transform("features", lambda x: x.cast("string")), "  ")
    ordered = df.repartitionByRange(files, "id").sortWithinPartitions("id")
    ordered.select(F.concat(F.lit("  "), text).alias("value")).write.text(path)


def write_column(df, column, path, files):
    ordered = df.repartitionByRange(files, "id").sortWithinPartitions("id")
    ordered.select(F.col(column).cast("string").alias("value")).write.text(path)
