"""Gapless places of rows inside groups of any size, without one task per group."""

from pyspark.sql import Window
from pyspark.sql import functions as F

#: Rows that one task ranks together, on average.
BUCKET_ROWS = 20_000
#: Buckets at least, so that one large group of a small table spreads over the tasks too.
LEAST_BUCKETS = 32


def ranked(df, group, identity, into="rank", total=None, bucket_rows=BUCKET_ROWS):
    """Adds a place from 0 within each group. Groups are cut into hash buckets of the identity columns.

    Buckets are counted, the counts are summed up to the first place of each bucket, and rows are only
    ordered inside their bucket. Rows that agree in all identity columns are interchangeable.
    """
    total = df.count() if total is None else total
    buckets = max(LEAST_BUCKETS, -(-total // bucket_rows))
    keyed = df.withColumn("__bucket", F.pmod(F.xxhash64(*identity), F.lit(buckets)))
    counts = keyed.groupBy(*group, "__bucket").agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("__first", F.coalesce(F.sum("__n").over(upto), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*group, "__bucket").orderBy(*identity)
    keyed = keyed.withColumn("__place", F.row_number().over(inside) - 1)
    placed = keyed.join(first, [*group, "__bucket"])
    return placed.withColumn(into, (F.col("__first") + F.col("__place")).cast("long")).drop("__bucket", "__first", "__place")
