"""Result records, feature caches and class folders."""

import threading

from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CLASS_NAMES = 100_000


def append_columns(old, new):
    """Stack records by column name; a key missing on one side is null there."""
    return old.unionByName(new, allowMissingColumns=True)


def nested_as_json(df):
    """Structs, maps and arrays as JSON text."""
    nested = (T.StructType, T.MapType, T.ArrayType)
    return df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema]
    )


def append_records(df, path):
    """Append to a Parquet record table whose columns may grow."""
    df.write.mode("append").parquet(path)


def read_records(spark, path):
    return spark.read.option("mergeSchema", "true").parquet(path)


class RecordStore:
    """Records of finished cells by key, appended cell by cell, so that a sweep that was stopped goes on from there.

    Without a path nothing is kept between runs. Cells may be added from several threads.
    """

    def __init__(self, spark, path, schema, key):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key
        self.names = [part.split()[0] for part in schema.split(", ")]
        self.lock = threading.Lock()
        self.known = {}
        if path and path_exists(spark, path):
            for row in read_records(spark, path).collect():
                self._remember(row.asDict())

    def _remember(self, record):
        self.known[tuple(record[name] for name in self.key)] = {name: record.get(name) for name in self.names}

    def __contains__(self, key):
        return tuple(key) in self.known

    def get(self, key):
        return self.known[tuple(key)]

    def frame(self, records):
        return self.spark.createDataFrame([tuple(r.get(n) for n in self.names) for r in records], self.schema)

    def add(self, records):
        with self.lock:
            if self.path and records:
                append_records(nested_as_json(self.frame(records)), self.path)
            for record in records:
                self._remember(record)


def path_exists(spark, path):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def write_results(df, path):
    df.write.mode("overwrite").option("header", True).csv(path)


def read_results(spark, path, schema):
    return spark.read.schema(schema).option("header", True).csv(path)


def is_complete(spark, path):
    """Whether a table was written to its end."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def cached_features(spark, path, compute):
    """The stored feature table, computed and written once."""
    if not is_complete(spark, path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def class_folders(df, names, id_col="id", label_col="label"):
    """Add the class name and the sample name padded to five digits; a label without a name is an error."""
    if len(names) > MAX_CLASS_NAMES:
        raise ValueError("too many class names to broadcast")
    table = df.sparkSession.createDataFrame(list(enumerate(names)), f"{label_col} int, label_name string")
    text = F.col(id_col).cast("string")
    sample = F.when(F.length(text) >= 5, text).otherwise(F.lpad(text, 5, "0"))
    wrong = F.raise_error(F.concat(F.lit("no class name for label "), F.coalesce(F.col(label_col).cast("string"), F.lit("null"))))
    named = F.coalesce(F.col("label_name"), wrong)
    return df.join(F.broadcast(table), label_col, "left").withColumns({"label_name": named, "sample": sample})


def write_by_class(df, names, path, id_col="id", label_col="label"):
    """One folder per class; samples already there are left alone."""
    spark = df.sparkSession
    out = class_folders(df, names, id_col, label_col)
    if is_complete(spark, path):
        out = out.join(spark.read.parquet(path).select(id_col), id_col, "left_anti")
    out.write.mode("append").partitionBy("label_name").parquet(path)
