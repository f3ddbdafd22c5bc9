"""Line dedup over levelled sorted runs of line hashes, with DataFrame operators only.

A line's key is the line without white space at both ends, A-Z lower-cased, as two 64-bit hashes. Documents
come in batches. A batch's keys are merge-anti-joined with the keys that the runs already hold often enough;
the rest is added as a sorted run of level 0 with the number of documents and the largest document id per key.
When a level has `fanout` runs they are compacted into one run of the next level, so the number of runs stays
logarithmic in the number of batches. Batches go from large ids to small ones, so the largest holder of a key
is known from the first batch that has it.

Edge cases: a null or empty text is one empty line; a null doc_id counts as one document, smaller than all
others; repeated rows count as one document and each of them loses the same lines; keys are compared by
128 bits of hash. Columns of the input other than id and text pass through; n_lines and n_dropped replace
columns of the same name.
"""

from functools import reduce

from pyspark.sql import functions as F

from ..session import drop_path, release_shuffles, scratch_path, stored

SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_KEY = ["h1", "h2"]


def lines_of(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line):
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, UPPER.lower())


def keyed_lines(docs, id_col, text_col, min_chars):
    """Place and key hashes of every line long enough to be compared."""
    text = F.col(text_col)
    lines = docs.select(
        F.col(id_col).alias("doc"), F.xxhash64(text).alias("version"), F.posexplode(lines_of(text)).alias("pos", "line")
    )
    # Characters are counted before the costlier key is made; a key never has more than its line.
    lines = lines.filter(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line")))
    return lines.filter(F.length("key") >= min_chars).select(
        "doc", "version", "pos", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2")
    )


def holders(lines):
    """Documents and largest document id per key; the documents of a frequent key are counted in two steps."""
    return lines.select(*_KEY, "doc").distinct().groupBy(*_KEY).agg(F.count("*").alias("n_docs"), F.max("doc").alias("largest"))


def merged(entries):
    return entries.groupBy(*_KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("largest").alias("largest"))


class LineRuns:
    """Runs by level, kept in shared scratch: dealt by key, as the grouping left them, and sorted in each part."""

    def __init__(self, spark, fanout=2):
        self.spark, self.fanout, self.levels = spark, fanout, []

    def runs(self):
        return [run for level in self.levels for run, _ in level]

    def entries(self):
        """One row per key over all runs, or None while there are none."""
        runs = self.runs()
        return merged(reduce(lambda a, b: a.unionByName(b), runs)) if runs else None

    def unseen(self, entries, min_docs=1):
        """The batch's entries whose key the runs do not yet hold in `min_docs` documents."""
        held = self.entries()
        if held is None:
            return entries
        return entries.join(held.filter(F.col("n_docs") >= min_docs).select(*_KEY), _KEY, "left_anti")

    def _write(self, entries, level):
        path = scratch_path(self.spark, f"lines-level{level}")
        entries.sortWithinPartitions(*_KEY).write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((self.spark.read.schema(entries.schema).parquet(path), path))

    def add(self, entries):
        """A new run of level 0; full levels are compacted upwards."""
        self._write(entries, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            self._write(merged(reduce(lambda a, b: a.unionByName(b), [run for run, _ in old])), level + 1)
            self.levels[level] = []
            for _, path in old:
                drop_path(self.spark, path)
            level += 1


def _batch_bounds(docs, id_col, batches):
    """Document ids that cut the rows into batches of about equal size; the cuts do not change the result."""
    parts = [i / batches for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(id_col, parts, 1000)).first()[0] if parts else None
    return sorted(set(cuts or []), reverse=True)


def dropped_lines(docs, id_col="doc_id", text_col="text", min_docs=3, min_chars=20, batches=4, fanout=2):
    """(doc, version, places): lines whose key is in at least min_docs documents, but for the largest of them."""
    spark = docs.sparkSession
    cuts = _batch_bounds(docs, id_col, batches)
    lines = keyed_lines(docs, id_col, text_col, min_chars)
    batch = F.lit(len(cuts))
    for number, cut in reversed(list(enumerate(cuts))):
        batch = F.when(F.col("doc") > cut, F.lit(number)).otherwise(batch)
    lines, _ = stored(lines.withColumn("batch", batch), "lines", ["batch"])
    runs = LineRuns(spark, fanout)
    for number in range(len(cuts) + 1):
        runs.add(runs.unseen(holders(lines.filter(F.col("batch") == number)), min_docs))
    # Written first, so that the join deals both sides anew and a frequent line can be split.
    frequent, _ = stored(runs.entries().filter(F.col("n_docs") >= min_docs).select(*_KEY, "largest"), "lines-frequent")
    release_shuffles(spark)
    lost = lines.join(frequent, _KEY).filter(~F.col("doc").eqNullSafe(F.col("largest")))
    return lost.groupBy("doc", "version").agg(F.sort_array(F.collect_set("pos")).alias("places"))


def _without(lines, places):
    """The lines but those at the given places: the stretches between them, so long texts take linear time."""

    def stretch(i):
        begin = F.when(i == 0, F.lit(0)).otherwise(F.element_at(places, i) + 1)
        end = F.when(i == F.size(places), F.size(lines)).otherwise(F.element_at(places, i + 1))
        return F.slice(lines, begin + 1, end - begin)

    # element_at counts from 1, and its branch is not taken for place 0.
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(places)), stretch))


def dedup(docs, id_col="doc_id", text_col="text", **options):
    """All documents with their kept lines as text, and n_lines (before) and n_dropped."""
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    lost = dropped_lines(docs, id_col, text_col, **options).toDF("__doc", "__of", "__places")
    rows = docs.select(*kept_columns).withColumn("__version", F.xxhash64(F.col(text_col)))
    rows = rows.join(
        lost, F.col(id_col).eqNullSafe(F.col("__doc")) & (F.col("__version") == F.col("__of")), "left"
    ).withColumn("__lines", lines_of(F.col(text_col)))
    places, lines = F.col("__places"), F.col("__lines")
    text = F.when(places.isNull(), F.col(text_col)).otherwise(F.array_join(_without(lines, places), "\n"))
    return rows.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in kept_columns],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.array_size(places), F.lit(0)).cast("long").alias("n_dropped"),
    )


def report(docs, **options):
    """Per document the number of lines, of dropped ones, and the digest of the kept text."""
    return dedup(docs.select("doc_id", "text"), **options).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256")
    )
