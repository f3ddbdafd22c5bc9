"""Phrase mining by top-order marginalisation: only the longest windows are counted, ROLLUP sums their beginnings.

Every word starts one window of `LONGEST` lead columns: the word and those after it in its piece, padded with 0. Tasks
count equal windows of their rows; one ROLLUP over the lead columns then gives the counts of phrases of every length,
as a phrase begins as many windows as it has occurrences, and the number of words of each language as its last level.
No separate n-grams are made.

Windows need not go on where no phrase frequent enough can: a sketch of fixed size sums, in saturating counters, the
neighbouring pairs of words, and a window is padded from the first pair whose counter stays below the least count.
A counter is never less than its pair's count, so the result is that of all windows, whatever the size of the
sketch; on corpora that fill it more windows are longer. Words are 64-bit hashes until the phrases are known.

Edge cases: a null or empty text has no words, a null language is `und`; a text of any length is read in bounded
runs of rows (one text at least); repeated rows count each; a table without rows, or without frequent phrases, gives
no rows; other columns of the input are not read. Scores are exact up to 38 digits; ties go by count, then by the
UTF-8 bytes of the phrase.
"""

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import stored
from .words import mixed, text_bytes, word_hashes

#: Fixed by the task: what ends a piece, and what else ends a word.
BREAKS = b".,;:!?\n\x0b\x0c\r"
SPACES = b" \t"
LONGEST = 5
MIN_COUNT = 100
#: A phrase goes if so many per cent of its occurrences lie in one longer phrase.
COVERED = 100
TOP = 2000
#: Counters of the sketch, and of one row of it.
SLOTS = 1 << 24
CHUNK = 1 << 18
#: First step of adding sketches, so that no group reads those of all tasks.
FAN_IN = 8
#: Bytes of text that are cut into words at a time, and windows that a task gathers before it hands them on.
RUN_BYTES = 1 << 23
GATHERED = 600_000
#: Groups of each language that are ranked before the language is.
RANK_GROUPS = 64

_LEADS = [f"w{i + 1}" for i in range(LONGEST)]
_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))
_IS_BREAK = np.isin(np.arange(256), list(BREAKS))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _seed(lang):
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Run:
    """The words of some rows: hashes, places in the bytes, language, and which word follows in the same piece."""

    def __init__(self, langs, texts):
        self.data, _ = text_bytes(texts)
        self.hashes, self.first, self.last, offsets = word_hashes(texts, SPACES + BREAKS)
        self.hashes = np.where(self.hashes == 0, np.uint64(1), self.hashes)
        coded = langs.dictionary_encode()
        self.names = coded.dictionary.to_pylist()
        seeds = np.array([_seed(name) for name in self.names], dtype=np.uint64)
        self.lang = np.repeat(coded.indices.to_numpy(zero_copy_only=False), np.diff(offsets)).astype(np.int32)
        self.seed = seeds[self.lang] if len(self.lang) else np.zeros(0, dtype=np.uint64)
        breaks = np.zeros(len(self.data) + 1, dtype=np.int32)
        np.cumsum(_IS_BREAK[self.data], out=breaks[1:])
        self.follows = np.zeros(len(self.hashes), dtype=bool)
        self.follows[:-1] = breaks[self.first[1:]] == breaks[self.last[:-1]]
        ends = offsets[1:] - 1
        self.follows[ends[ends >= 0]] = False

    def slots(self, slots):
        """A counter for each word that another one follows."""
        at = np.flatnonzero(self.follows)
        pair = mixed(self.hashes[at] * _STEP + self.hashes[at + 1] + self.seed[at])
        return at, (pair & np.uint64(slots - 1)).astype(np.uint32)

    def word(self, at):
        return self.data[self.first[at] : self.last[at]].tobytes().translate(_LOWER).decode(errors="replace")


def runs(batches, size=RUN_BYTES):
    """Batches (language, text) as runs of rows of about `size` bytes."""
    for batch in batches:
        langs, texts = batch.column(0), batch.column(1)
        _, offsets = text_bytes(texts)
        row = 0
        while row < len(texts):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
            yield Run(langs.slice(row, end - row), texts.slice(row, end - row))
            row = end


def _counter(least):
    """The smallest counter that can hold `least`, where it saturates."""
    return next(kind for kind in (np.uint8, np.uint16, np.uint32) if least <= np.iinfo(kind).max)


def frequent_pairs(rows, least, slots=SLOTS, chunk=CHUNK):
    """A bit for each counter that reaches `least`, over all neighbouring words of the table."""
    kind, chunk = _counter(least), min(chunk, slots)
    schema = "chunk int, part int, counts binary"

    def packed(number, part, counts):
        data = zlib.compress(np.minimum(counts, least).astype(kind).tobytes(), 1)
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int32()), pa.array([part], pa.int32()), pa.array([data], pa.binary())], ["chunk", "part", "counts"]
        )

    def count(batches):
        total = np.zeros(slots, dtype=kind)
        for run in runs(batches):
            at, n = np.unique(run.slots(slots)[1], return_counts=True)
            total[at] = np.minimum(total[at] + n, least)
        part = TaskContext.get().partitionId() % FAN_IN
        for number, begin in enumerate(range(0, slots, chunk)):
            if total[begin : begin + chunk].any():
                yield packed(number, part, total[begin : begin + chunk])

    def added(batches):
        total = np.zeros(chunk, dtype=np.int64)
        for batch in batches:
            for data in batch.column("counts"):
                total += np.frombuffer(zlib.decompress(data.as_py()), dtype=kind)
                np.minimum(total, least, out=total)
        return total

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield packed(key[0].as_py(), 0, added(batches))

    def finish(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.packbits(added(batches) >= least, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([bits], pa.binary())], ["chunk", "bits"])

    parts = rows.mapInArrow(count, schema).groupBy("chunk", "part").applyInArrow(add, schema)
    found = parts.groupBy("chunk").applyInArrow(finish, "chunk int, bits binary")
    bits = np.zeros(slots // 8, dtype=np.uint8)
    for row in found.collect():  # slots / 8 bytes in all, whatever the input
        bits[row["chunk"] * chunk // 8 : (row["chunk"] + 1) * chunk // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return bits


class Windows:
    """Counts of equal windows that a task has gathered."""

    def __init__(self):
        self.parts, self.rows = [], 0

    def add(self, keys, names, leads, counts):
        self.parts.append((keys, names, leads, counts))
        self.rows += len(keys)
        if self.rows > 2 * GATHERED:
            self.merge()

    def merge(self):
        keys, names, leads, counts = (np.concatenate([part[i] for part in self.parts]) for i in range(4))
        keys, first, group = np.unique(keys, return_index=True, return_inverse=True)
        total = np.zeros(len(keys), dtype=np.int64)
        np.add.at(total, group, counts)
        self.parts, self.rows = [(keys, names[first], leads[first], total)], len(keys)

    def taken(self):
        if self.rows:
            self.merge()
            yield self.parts[0][1:]
        self.parts, self.rows = [], 0


def counted_windows(rows, frequent, slots=SLOTS):
    """Rows (kind 0: language, lead columns, count) and (kind 1: language, word hash, word)."""
    schema = f"kind int, lang string, {', '.join(f'{c} long' for c in _LEADS)}, n long, word string"
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def batch(kind, langs, leads, counts, words):
        columns = [pa.array(np.full(len(langs), kind, dtype=np.int32)), pa.array(langs, pa.string())]
        columns += [pa.array(np.ascontiguousarray(leads[:, i]).view(np.int64)) for i in range(LONGEST)]
        columns += [pa.array(counts, pa.int64()), pa.array(words, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["kind", "lang", *_LEADS, "n", "word"])

    def count(batches):
        windows, known = Windows(), np.zeros(0, dtype=np.uint64)
        for run in runs(batches):
            size = len(run.hashes)
            at, slot = run.slots(slots)
            linked = np.zeros(size + LONGEST, dtype=bool)
            linked[at] = (shared.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
            # Lead columns: 0 from the end of the piece, or from the first pair that cannot be frequent.
            leads = np.zeros((size, LONGEST), dtype=np.uint64)
            leads[:, 0] = run.hashes
            going = linked[:size].copy()
            for i in range(1, LONGEST):
                leads[: size - i, i] = np.where(going[: size - i], run.hashes[i:], np.uint64(0))
                going &= linked[i : size + i]
            keys = run.seed.copy()
            for i in range(LONGEST):
                keys = mixed(keys * _STEP + leads[:, i])
            keys, first, n = np.unique(keys, return_index=True, return_counts=True)
            names = np.array(run.names, dtype=object)
            windows.add(keys, names[run.lang[first]] if size else names[:0], leads[first], n.astype(np.int64))
            if windows.rows > GATHERED:
                for langs, columns, counts in windows.taken():
                    yield batch(0, langs, columns, counts, [None] * len(langs))
            part = np.flatnonzero(linked[:size])
            part = np.union1d(part, part + 1)
            ids, first = np.unique(mixed(run.seed[part] + run.hashes[part] * _STEP), return_index=True)
            fresh = ~np.isin(ids, known, assume_unique=True)
            known = np.union1d(known, ids[fresh])
            part = part[first[fresh]]
            if len(part):
                leads = np.zeros((len(part), LONGEST), dtype=np.uint64)
                leads[:, 0] = run.hashes[part]
                yield batch(1, names[run.lang[part]], leads, np.zeros(len(part), dtype=np.int64), [run.word(i) for i in part])
        for langs, columns, counts in windows.taken():
            yield batch(0, langs, columns, counts, [None] * len(langs))

    return rows.mapInArrow(count, schema)


def marginals(windows, least):
    """Counts of all beginnings of the windows: (lang, words, f); no words: all words of the language."""
    last = F.coalesce(*[F.col(c) for c in reversed(_LEADS)], F.lit(1))
    # Both conditions read grouping columns only, so Catalyst drops padded levels before it groups them.
    sums = windows.rollup("lang", *_LEADS).agg(F.sum("n").alias("f")).filter(F.col("lang").isNotNull() & (last != 0))
    words = F.filter(F.array(*_LEADS), lambda w: w.isNotNull())
    return sums.select("lang", words.alias("words"), "f").filter((F.size("words") == 0) | (F.col("f") >= least))


def scored(phrases):
    """Candidates with their lowest-scoring cut: lang, words, a, n, and the struct cut (score, k, l, r)."""
    parts = phrases.filter(F.size("words") > 0)
    totals = phrases.filter(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    cuts = (
        parts.filter(F.size("words") > 1)
        .withColumnRenamed("f", "a")
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
        .withColumn("left", F.slice("words", F.lit(1), F.col("k")))
        .withColumn("right", F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")))
    )
    cuts = cuts.join(parts.select("lang", F.col("words").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("words").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(totals, "lang")
    for column in "alrn":
        cuts = cuts.withColumn(f"{column}_", F.col(column).cast("decimal(19,0)"))
    score = F.expr("(CAST(1000 AS DECIMAL(4,0)) * a_ * n_) DIV (l_ * r_)")
    return cuts.groupBy("lang", "words", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))


def longer_counts(phrases):
    """The largest count of a longer phrase around each phrase that lies in one: lang, words, longer."""
    inner = F.expr(
        "flatten(transform(sequence(2, size(words) - 1), "
        "m -> transform(sequence(1, size(words) - m + 1), s -> slice(words, s, m))))"
    )
    inside = phrases.filter(F.size("words") > 2).select("lang", F.explode(inner).alias("words"), "f")
    return inside.groupBy("lang", "words").agg(F.max("f").alias("longer"))


def mine(docs, min_count=MIN_COUNT, covered=COVERED, top=TOP, slots=SLOTS, lang_col="lang", text_col="text"):
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    found, _ = stored(counted_windows(rows, frequent_pairs(rows, min_count, slots), slots), "windows", ("kind",))
    phrases, _ = stored(marginals(found.filter("kind = 0"), min_count), "phrases")
    kept = (
        scored(phrases)
        .join(longer_counts(phrases), ["lang", "words"], "left")
        .filter(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    )
    names = found.filter("kind = 1").groupBy("lang", F.col("w1").alias("word_id")).agg(F.min("word").alias("word"))
    spelt = (
        kept.select("lang", "words", "a", "n", "cut", F.posexplode("words").alias("pos", "word_id"))
        .join(names, ["lang", "word_id"])
        .groupBy("lang", "words", "a", "n", "cut")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("spelt"))
        .select("lang", F.array_join("spelt.word", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    spelt = spelt.withColumn("__group", F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS)))
    first = spelt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "__group").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
