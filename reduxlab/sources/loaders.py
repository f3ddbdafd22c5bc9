"""The datasets of the experiments, read from tables or text and prepared for a sweep."""

from pyspark.sql import functions as F

from ..operators import featurize, sampling, scaling
from ..operators.layout import unique_names, widen
from ..operators.text import clean_text, english_stop_words, fit_tfidf
from . import text_matrix
from .records import cached_features
from .tables import (
    FeatureTable,
    class_count,
    first_label,
    highest_label_count,
    spread,
    stack_with_origin,
    vector_width,
)

# Class folders of the clothing images.
FASHION_LABELS = [
    "0_tshirt_top", "1_trouser", "2_pullover", "3_dress", "4_coat",
    "5_sandal", "6_shirt", "7_sneaker", "8_bag", "9_ankle_boot",
]
# Channel statistics used before a pretrained network.
IMAGE_MEAN, IMAGE_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def limit_sides(df, max_train, max_test, seed):
    """Subsample both sides; the test side draws with the next seed."""
    train = sampling.subsample(df.filter("split = 'train'"), max_train, seed)
    test = sampling.subsample(df.filter("split = 'test'"), max_test, seed + 1)
    return train.unionByName(test)


def _standardized(df):
    return scaling.fit_standardizer(df.filter("split = 'train'")).transform(df)


def prepare_images(df, seed=42, max_train=None, max_test=None, standardize=True, train_size=60_000, test_size=10_000,
                   name="fashion_mnist", image_shape=(28, 28)):
    """Grey images without a given split: rescale, split, subsample, standardise per pixel."""
    split = sampling.split_table(scaling.rescale_pixels(df), train_size, test_size, seed)
    split = limit_sides(split, max_train, max_test, seed)
    out = _standardized(split) if standardize else split
    return FeatureTable(name, out, vector_width(df), 10, "dense_image", image_shape)


def prepare_colour_images(train, test, seed=42, max_train=None, max_test=None, standardize=True, name="cifar10",
                          image_shape=(32, 32, 3)):
    """Colour images, channel innermost, with a given split: normalised per channel."""
    both = limit_sides(scaling.rescale_pixels(stack_with_origin(train, test)), max_train, max_test, seed)
    if standardize:
        both = scaling.fit_channel_normalizer(both.filter("split = 'train'"), image_shape[2]).transform(both)
    return FeatureTable(name, both, vector_width(train), 10, "dense_image", image_shape, layout="hwc")


def prepare_sensors(train, test, seed=42, max_train=None, max_test=None, standardize=True, name="uci_har"):
    both = limit_sides(stack_with_origin(train, test), max_train, max_test, seed)
    out = _standardized(both) if standardize else both
    return FeatureTable(name, out, vector_width(train), 6, "dense_sensor")


def prepare_text(df, seed=42, max_train=None, max_test=None, standardize=True, max_features=50_000,
                 remove=("headers", "footers", "quotes"), stop_words=None, name="20newsgroups"):
    """Text with a given split: TF-IDF fitted on all training text, subsample, max-abs scaling."""
    words = english_stop_words() if stop_words is None else stop_words
    cleaned = clean_text(df, remove)
    model = fit_tfidf(cleaned.filter("split = 'train'"), "text", words, max_features)
    weighted = limit_sides(model.transform(cleaned, "text", words), max_train, max_test, seed)
    width = model.size
    if standardize:
        weighted = scaling.fit_max_abs(weighted.filter("split = 'train'"), width).transform(weighted)
    return FeatureTable(name, weighted, width, class_count(df), "sparse_text", sparse=True)


def prepare_multilabel(df, input_dim, seed=42, max_train=None, max_test=None, standardize=True, name="rcv1"):
    """Sparse rows with label sets: first label, joint subsample, split, max-abs scaling."""
    single = first_label(df)
    both_limits = None if max_train is None or max_test is None else max_train + max_test
    drawn = sampling.subsample(single, both_limits, seed)
    split = sampling.split_table(drawn, max_train, max_test if max_test is not None else 0.2, seed)
    if standardize:
        split = scaling.fit_max_abs(split.filter("split = 'train'"), input_dim).transform(split)
    return FeatureTable(name, split, input_dim, highest_label_count(single), "sparse_text", sparse=True)


def _har(spark, path, side):
    return text_matrix.read_labelled_matrix(spark, f"{path}/{side}/X_{side}.txt", f"{path}/{side}/y_{side}.txt")


def _offset_ids(train, test):
    """Give the second part ids after the first one's."""
    first = train.agg(F.max("id").alias("m")).head()["m"] + 1
    return test.withColumn("id", F.col("id") + first)


def _har_sides(spark, path):
    train = _har(spark, path, "train")
    return train, _offset_ids(train, _har(spark, path, "test"))


def sensor_feature_names(spark, path):
    """Unique column names from lines of number and name; one row per feature."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = text_matrix.numbered_lines(spark, path).select("line", F.get(parts, F.lit(1)).alias("name"))
    return [row["unique_name"] for row in unique_names(lines, "line", "name").orderBy("line").collect()]


def wide_sensor_table(spark, path):
    """split, subject, activity (as stored) and one named column per feature."""

    def side(name):
        folder = f"{path}/{name}"
        files = [f"{folder}/{kind}_{name}.txt" for kind in ("X", "y", "subject")]
        return text_matrix.read_labelled_matrix(spark, *files, first_label=0).withColumnRenamed("label", "activity")

    both = stack_with_origin(side("train"), side("test")).select("split", "subject", "activity", "features")
    return widen(both, sensor_feature_names(spark, f"{path}/features.txt"))


def load_dataset(spark, name, path, seed=42, max_train=None, max_test=None, standardize=True):
    """A prepared classification dataset by its case-insensitive name.

    `path` holds: a table (id, features, label) for fashion_mnist; tables train/ and test/ of it
    for cifar10; the text files for uci_har; a table (id, text, label, split) for 20newsgroups;
    a table (id, idx, val, labels) for rcv1.
    """
    limits = {"seed": seed, "max_train": max_train, "max_test": max_test, "standardize": standardize}

    def rcv1():
        df = spark.read.parquet(path)
        width = df.agg(F.max(F.array_max("idx")).alias("m")).head()["m"] + 1
        return prepare_multilabel(df, width, **limits)

    loaders = {
        "fashion_mnist": lambda: prepare_images(spark.read.parquet(path), **limits),
        "cifar10": lambda: prepare_colour_images(
            spark.read.parquet(f"{path}/train"), spark.read.parquet(f"{path}/test"), **limits
        ),
        "uci_har": lambda: prepare_sensors(*_har_sides(spark, path), **limits),
        "20newsgroups": lambda: prepare_text(spread(spark.read.parquet(path)), **limits),
        "rcv1": rcv1,
    }
    if name.lower() not in loaders:
        raise ValueError(f"Unknown dataset: {name}")
    return loaders[name.lower()]()


def pretrained_features(network, size=224):
    """Wrap a network over (n, 3, size, size) images for planar 32 x 32 colour rows in 0..1."""

    def run(x):
        return network(featurize.prepared_images(x, 3, 32, 32, size, IMAGE_MEAN, IMAGE_STD))

    return run


def load_cluster_dataset(spark, name, path, cache=None, network=None):
    """An unsplit clustering dataset: id, features, label. Images are planar here.

    The `_hog` and `_cnn` variants keep their features below `cache`; the latter needs `network`.
    """

    def images():
        return scaling.rescale_pixels(spark.read.parquet(path))

    def har():
        train, test = _har_sides(spark, path)
        return train.unionByName(test)

    loaders = {
        "fashion_mnist": images,
        "cifar10": images,
        "uci_har": har,
        "fashion_mnist_hog": lambda: cached_features(spark, cache, lambda: featurize.hog(images(), 28, 28)),
        "cifar10_cnn": lambda: cached_features(
            spark, cache, lambda: featurize.featurize(images(), pretrained_features(network))
        ),
    }
    if name.lower() not in loaders:
        raise ValueError(f"Unknown dataset: {name}")
    df = loaders[name.lower()]()
    kind = "dense_sensor" if name.lower() == "uci_har" else "dense_image"
    # Only raw images have channels; computed features and sensors have no layout.
    planar = {"layout": "chw"} if name.lower() in ("fashion_mnist", "cifar10") else {}
    return FeatureTable(name.lower(), df, vector_width(df), class_count(df), kind, **planar)
