"""Benchmark decontamination: a broadcast set of test n-grams against every window of the training texts.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A window is `length`
consecutive words of a benchmark item; an item of fewer words is one window, an item without words none.
Every window of every text is looked up by hash and each hit is compared word by word.

The window set is broadcast only below BLOCK_BYTES of benchmark text. A larger benchmark is cut into
blocks of items below that size, the texts are scanned once per block, and the hits are united.

Edge cases: null and empty texts have no words and no hits; an item with a null id is listed as "null";
items sharing an id count once; repeated rows each get their result; columns of the input that have the
name of the result column are replaced by it.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from ..session import stored
from .words import PUNCTUATION, slices, windows, word_hashes

#: Benchmark text of one broadcast set, in bytes.
BLOCK_BYTES = 32 << 20
_TO_SPACE = bytes(0x20 if b in PUNCTUATION else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_HITS = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())]))),
    ]
)
_HITS_TYPE = from_arrow_type(_HITS)


def normal(raw):
    """The words of some bytes, joined by single spaces."""
    return b" ".join(raw.translate(_TO_SPACE).split())


class WindowSet:
    """Windows of benchmark items by hash, one sorted array per window length."""

    def __init__(self, items, length):
        self.by_length, self.texts = {}, {}
        for item_id, text in items:
            words = normal((text or "").encode()).split()
            size = min(length, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                self.by_length.setdefault(size, {}).setdefault(b" ".join(words[i : i + size]), set()).add(item_id)
        for size, known in self.by_length.items():
            joined = list(known)
            column = pa.array([w.decode() for w in joined])
            hashes, _, _, offsets = word_hashes(column, PUNCTUATION)
            keys = [int(windows(hashes[a:b], size)[0]) for a, b in zip(offsets[:-1], offsets[1:])]
            table = {}
            for key, text in zip(keys, joined):
                table.setdefault(key, {})[text] = sorted(known[text])
            self.texts[size] = table
            self.by_length[size] = np.array(sorted(table), dtype=np.uint64)

    def prefilters(self):
        """A bit per leading 20 bits of the hashes, which dismisses nearly all windows at once."""
        out = {}
        for size, keys in self.by_length.items():
            out[size] = np.zeros(1 << 20, dtype=bool)
            out[size][(keys >> np.uint64(44)).astype(np.int64)] = True
        return out

    def scan(self, column, prefilters):
        """Hits of a string column as an Arrow struct array."""
        counts, results = [], {}
        for row, hashes, first, last, offsets in slices(column, PUNCTUATION):
            counts.append(np.diff(offsets))
            for size, keys in self.by_length.items():
                found = windows(hashes, size)
                near = np.flatnonzero(prefilters[size][(found >> np.uint64(44)).astype(np.int64)])
                place = np.minimum(np.searchsorted(keys, found[near]), len(keys) - 1)
                near = near[keys[place] == found[near]]
                owner = np.searchsorted(offsets, near, side="right") - 1
                inside = near + size <= offsets[owner + 1]
                for at, doc in zip(near[inside].tolist(), owner[inside].tolist()):
                    raw = self._bytes(column, row + doc, first, last, offsets, doc, at, size)
                    items = self.texts[size][int(found[at])].get(raw)
                    if items:
                        spans, names = results.setdefault(row + doc, ([], set()))
                        begin = int(first[at] - self._base)
                        spans.append((at - int(offsets[doc]), size, begin, int(last[at + size - 1] - self._base)))
                        names.update(items)
        return np.concatenate(counts) if counts else np.zeros(0, dtype=np.int64), results

    def _bytes(self, column, index, first, last, offsets, doc, at, size):
        if getattr(self, "_at", None) != index:
            self._raw = column[index].as_py().encode()
            words_before = normal_start(self._raw)
            self._base = int(first[offsets[doc]]) - words_before
            self._at = index
        return normal(self._raw[int(first[at]) - self._base : int(last[at + size - 1]) - self._base])


def normal_start(raw):
    """The first byte of a text that belongs to a word."""
    line = raw.translate(_TO_SPACE)
    return len(line) - len(line.lstrip(b" "))


def merged(spans):
    """Overlapping or touching word spans as one."""
    out = []
    for word, words, begin, end in sorted(spans):
        if out and word <= out[-1][0] + out[-1][1]:
            last = out[-1]
            size = max(last[1], word + words - last[0])
            out[-1] = (last[0], size, last[2], max(last[3], end))
        else:
            out.append((word, words, begin, end))
    return out


def _struct(counts, results):
    rows = []
    for i, n in enumerate(counts.tolist()):
        spans, names = results.get(i, ((), ()))
        spans = merged(spans)
        keep = [dict(zip(("word", "words", "begin", "end"), s)) for s in spans]
        rows.append({"n_words": n, "n_hit": sum(s[1] for s in spans), "items": sorted(names), "spans": keep})
    return pa.array(rows, type=_HITS)


def _scanner(spark, items, length):
    known = spark.sparkContext.broadcast(WindowSet(items, length))

    @F.arrow_udf(_HITS_TYPE)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        windows_of = known.value
        windows_of._at = None
        prefilters = windows_of.prefilters()
        for column in batches:
            windows_of._at = None
            yield _struct(*windows_of.scan(column, prefilters))

    return scan


@F.arrow_udf(_HITS_TYPE)
def _united(left: pa.Array, right: pa.Array) -> pa.Array:
    rows = []
    for a, b in zip(left.to_pylist(), right.to_pylist()):
        spans = merged([tuple(s.values()) for s in a["spans"] + b["spans"]])
        keep = [dict(zip(("word", "words", "begin", "end"), s)) for s in spans]
        items = sorted({*a["items"], *b["items"]})
        rows.append({"n_words": a["n_words"], "n_hit": sum(s[1] for s in spans), "items": items, "spans": keep})
    return pa.array(rows, type=_HITS)


@F.arrow_udf(T.StringType())
def _cut(text: pa.Array, hits: pa.Array) -> pa.Array:
    out = []
    for raw, hit in zip(text.to_pylist(), hits.to_pylist()):
        if raw is not None and hit["spans"]:
            data, kept, at = raw.encode(), [], 0
            for span in hit["spans"]:
                kept.append(data[at : span["begin"]])
                at = span["end"]
            raw = b"".join([*kept, data[at:]]).decode()
        out.append(raw)
    return pa.array(out, type=pa.string())


def _blocks(benchmark, id_col, text_col, block_bytes):
    """The items in lists of at most about block_bytes of text, one list at a time on the driver."""
    items = benchmark.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text")
    )
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    count = max(1, -(-2 * size // block_bytes) if size > block_bytes else 1)
    for number in range(count):
        part = items if count == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == number)
        yield [(r["item"], r["text"]) for r in part.toLocalIterator()]


def scan(docs, benchmark, length=10, text_col="text", item_col="item_id", item_text="text", into="hits", block_bytes=BLOCK_BYTES):
    """The documents with a struct column: n_words, n_hit, items and the spans of hit words (places and bytes)."""
    spark = docs.sparkSession
    out = None
    for items in _blocks(benchmark, item_col, item_text, block_bytes):
        found = _scanner(spark, items, length)(F.col(text_col))
        if out is None:
            out = docs.withColumn(into, found)
            continue
        out, _ = stored(out, "decontamination")
        out = out.withColumn(into, _united(F.col(into), found))
    return out


def clean(docs, benchmark, remove="documents", text_col="text", **options):
    """Documents without their contamination: whole documents go, or only the spans of hit words."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    columns = docs.columns
    hits = "__hits"
    found = scan(docs, benchmark, text_col=text_col, into=hits, **options)
    if remove == "documents":
        found = found.filter(F.col(hits)["n_hit"] == 0)
    else:
        found = found.withColumn(text_col, _cut(F.col(text_col), F.col(hits)))
    return found.select(*columns)


def report(docs, benchmark, **options):
    """Per document the counts, the digest of the item ids found in it, and whether it is contaminated."""
    hit = F.col("hits")
    return scan(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), **options).select(
        "doc_id",
        hit["n_words"].alias("n_words"),
        hit["n_hit"].alias("n_hit"),
        F.size(hit["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", hit["items"]), 256).alias("items_sha256"),
        (hit["n_hit"] > 0).alias("contaminated"),
    )
