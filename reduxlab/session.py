"""Session settings and shared scratch space."""

import gc
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores="8", shuffle_partitions=8, memory="8g", name="reduxlab"):
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_path(spark, label):
    """A fresh folder below the shared directory the cluster names, removed when the driver ends.

    Only a local session without that setting (a test) gets a folder of its own: the executors
    of a cluster would each write to their own disk.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="reduxlab-")
        spark.conf.set(CHECKPOINT_KEY, root)
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
    folder, files = _file_system(spark, path)
    files.deleteOnExit(folder)
    return path


def _file_system(spark, path):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def drop_path(spark, path):
    """Remove a folder made by scratch_path that no later step reads."""
    folder, files = _file_system(spark, path)
    files.delete(folder, True)


def release_shuffles(spark):
    """Let go of the shuffle files of finished steps, which stay on disk until the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def stored(df, label, partition_by=()):
    """The rows written to shared scratch and read back, with their path: cuts lineage, survives executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
