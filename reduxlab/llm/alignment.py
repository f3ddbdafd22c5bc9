"""Alignment of two tokenizers over a corpus by inverted pair bitmaps.

Tokenizer A (byte-level BPE) and tokenizer B (sentence pieces) cut the same bytes, a space and the text. Offsets where
a token of both ends cut a document into groups; every occurrence of an A token is linked with every occurrence of a B
token of its group. The links are kept inverted: for each pair of ids and each block of documents a compressed bitmap
of the documents that hold the pair linked, and one more bitmap for each binary digit of how often beyond once
(multiplicity planes). Bitmaps are lists of 16-bit places where that is shorter. Tasks OR the documents of a block
into its bitmaps; their popcounts, weighted by plane, are summed by Spark to document and link counts of every
pair, and the bitmaps, joined with those, return the scores to their documents block by block. So a frequent pair is
one small row per block and plane, never one per document, and blocks are bounded.

Edge cases: a text that is null or empty, or whose tokens of either side do not spell the space and the text, has no
tokens: zeros and an empty string; strings of special tokens are plain text; repeated rows are documents of their own;
a text of any length is one block at most, and a group with many tokens on both sides is counted by distinct ids;
an empty table gives no rows; other columns of the input are not read.
"""

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .byte_bpe import Encoder, Vocabulary, byte_of_sign

#: Documents of one block, and bytes of its texts (one text at least).
BLOCK_DOCS = 8192
BLOCK_BYTES = 32 << 20
#: A bitmap with more places than this holds bits, another one a list of places: the shorter of both.
LIST_PLACES = BLOCK_DOCS // 16
#: Bytes of texts that are aligned at a time.
RUN_BYTES = 1 << 20
#: Links of one group that are listed; a larger group is counted by distinct ids.
GROUP_LINKS = 4096


def read_byte_level(path):
    """The vocabulary of a byte-level BPE in the JSON form of the tokenizers library."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    signs = byte_of_sign()

    def spelt(token):
        return bytes(signs[c] for c in token)

    ids = {spelt(token): number for token, number in model["vocab"].items() if all(c in signs for c in token)}
    merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
    return Vocabulary.from_merges(ids, [(spelt(a), spelt(b)) for a, b in merges])


class Pieces:
    """Sentence pieces of texts, and the bytes of each piece."""

    def __init__(self, proto):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=proto)
        tokens = [self._bytes(number) for number in range(self.model.get_piece_size())]
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def _bytes(self, number):
        piece = self.model.id_to_piece(number)
        if self.model.is_byte(number):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts):
        rows = self.model.encode(texts, num_threads=1)
        counts = np.array([len(row) for row in rows], dtype=np.int64)
        return np.fromiter(chain.from_iterable(rows), dtype=np.int64, count=int(counts.sum())), counts


def _gathered(flat, starts, lengths):
    """The bytes of flat[start : start + length] for all given pairs, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def _upto(counts):
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


class Aligner:
    """Tokens, groups and links of runs of texts."""

    def __init__(self, vocabulary, pattern, proto):
        self.a, self.b = vocabulary, Pieces(proto)
        self.encoder = Encoder(vocabulary, pattern)
        self.names, self.name_starts, self.name_lengths = self._names(len(vocabulary.known), len(self.b.lengths))

    @staticmethod
    def _names(n_a, n_b):
        """Ids with what follows them: A ids with a comma or a bar, B ids with a comma or a semicolon."""
        names = [f"{i}{end}".encode() for end, n in ((",", n_a), ("|", n_a), (",", n_b), (";", n_b)) for i in range(n)]
        lengths = np.array([len(name) for name in names], dtype=np.int64)
        return np.frombuffer(b"".join(names), dtype=np.uint8), _upto(lengths)[:-1], lengths

    def tokens(self, texts):
        """Ids and their bytes' lengths on both sides, tokens per text; texts that are not spelt by both have none."""
        spaced = [" " + text if text else "" for text in texts]
        raw = [text.encode() for text in spaced]
        a = [np.frombuffer(ids, dtype="<u4") for ids in self.encoder.encode(spaced)]
        n_a = np.array([len(ids) for ids in a], dtype=np.int64)
        a = np.concatenate([np.zeros(0, dtype=np.int64), *a]).astype(np.int64)
        b, n_b = self.b.encode([text or "" for text in texts])
        size = np.array([len(r) for r in raw], dtype=np.int64)
        long_a, long_b = self.a.lengths[a], self.b.lengths[b]
        good = size > 0
        for lengths, counts in ((long_a, n_a), (long_b, n_b)):
            ends = _upto(lengths)[_upto(counts)]
            good &= np.diff(ends) == size
        for _ in range(2):  # First the sizes agree, then the bytes.
            keep_a, keep_b = np.repeat(good, n_a), np.repeat(good, n_b)
            a, long_a, b, long_b = a[keep_a], long_a[keep_a], b[keep_b], long_b[keep_b]
            n_a, n_b, size = np.where(good, n_a, 0), np.where(good, n_b, 0), np.where(good, size, 0)
            whole = np.frombuffer(b"".join(r for r, ok in zip(raw, good.tolist()) if ok), dtype=np.uint8)
            wrong = _gathered(self.a.flat, self.a.starts[a], long_a) != whole
            wrong |= _gathered(self.b.flat, self.b.starts[b], long_b) != whole
            if not wrong.any():
                break
            good &= np.diff(_upto(wrong)[_upto(size)]) == 0
        return a, long_a, n_a, b, long_b, n_b

    def align(self, texts):
        """Per text: tokens of A and of B, groups, links, and the groups as bytes; and links as (text, a, b, times)."""
        a, long_a, n_a, b, long_b, n_b = self.tokens(texts)
        end_a, end_b = np.cumsum(long_a), np.cumsum(long_b)
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        from_a, from_b = _upto(in_a), _upto(in_b)
        doc_a = np.repeat(np.arange(len(texts)), n_a)
        doc = doc_a[from_a[:-1]]
        links = in_a * in_b
        n_groups = np.bincount(doc, minlength=len(texts))
        n_links = np.diff(_upto(links)[_upto(n_groups)])
        # The text form: every id with what follows it, in the order of the groups.
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        last_a, last_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
        last_a[from_a[1:] - 1], last_b[from_b[1:] - 1] = True, True
        codes[np.arange(len(a)) + from_b[group_a]] = a + last_a * len(self.a.known)
        codes[np.arange(len(b)) + from_a[group_b + 1]] = b + 2 * len(self.a.known) + last_b * len(self.b.lengths)
        lengths = self.name_lengths[codes]
        written = _gathered(self.names, self.name_starts[codes], lengths).tobytes()
        cuts = _upto(lengths)[_upto(n_a + n_b)].tolist()
        groups = [written[i : j - 1] if j > i else b"" for i, j in zip(cuts[:-1], cuts[1:])]
        return n_a, n_b, n_groups, n_links, groups, self._links(a, b, doc, in_a, in_b, from_a, from_b, group_a)

    @staticmethod
    def _links(a, b, doc, in_a, in_b, from_a, from_b, group_a):
        large = in_a * in_b > GROUP_LINKS
        small = ~large[group_a]
        times = in_b[group_a[small]]
        begin = _upto(times)[:-1]
        partner = np.repeat(from_b[group_a[small]] - begin, times) + np.arange(int(times.sum()))
        docs, left, right = [np.repeat(doc[group_a[small]], times)], [np.repeat(a[small], times)], [b[partner]]
        count = [np.ones(len(partner), dtype=np.int64)]
        for g in np.flatnonzero(large).tolist():
            ids_a, times_a = np.unique(a[from_a[g] : from_a[g + 1]], return_counts=True)
            ids_b, times_b = np.unique(b[from_b[g] : from_b[g + 1]], return_counts=True)
            docs.append(np.full(len(ids_a) * len(ids_b), doc[g]))
            left.append(np.repeat(ids_a, len(ids_b)))
            right.append(np.tile(ids_b, len(ids_a)))
            count.append(np.outer(times_a, times_b).ravel())
        return tuple(np.concatenate(part) for part in (docs, left, right, count))


def summed(keys, times):
    """Ascending distinct keys and the sums of their times."""
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(times, first) if len(first) else times[:0]


def bitmaps(pairs, places):
    """Ascending (pair, place) rows -> pairs, places in each, and compressed bitmaps as one Arrow column."""
    first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.r_[first, len(pairs)])
    dense = counts > LIST_PLACES
    sizes = np.where(dense, BLOCK_DOCS // 8, 2 * counts)
    offsets = _upto(sizes)
    data = np.zeros(int(offsets[-1]), dtype=np.uint8)
    listed = ~np.repeat(dense, counts)
    inside = np.repeat(~dense, sizes)
    data[inside] = places[listed].astype("<u2").view(np.uint8)
    for i in np.flatnonzero(dense).tolist():
        bits = np.zeros(BLOCK_DOCS, dtype=bool)
        bits[places[first[i] : first[i] + counts[i]]] = True
        data[offsets[i] : offsets[i + 1]] = np.packbits(bits, bitorder="little")
    column = pa.Array.from_buffers(
        pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
    ).cast(pa.binary())
    return pairs[first], counts, column


def places_of(counts, column):
    """Places of all bitmaps of a column, one after the other."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    dense = counts > LIST_PLACES
    out = np.empty(int(counts.sum()), dtype=np.int64)
    inside = np.repeat(~dense, np.diff(offsets))
    out[np.repeat(~dense, counts)] = np.frombuffer(data[inside].tobytes(), dtype="<u2")
    upto = _upto(counts)
    for i in np.flatnonzero(dense).tolist():
        bits = np.unpackbits(data[offsets[i] : offsets[i + 1]], bitorder="little")
        out[upto[i] : upto[i + 1]] = np.flatnonzero(bits)
    return out


_PAIR_FIELDS = [("a", pa.int32()), ("b", pa.int32()), ("weight", pa.int64()), ("whole", pa.bool_()), ("n", pa.int64()), ("bits", pa.binary())]
_DOC_FIELDS = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string())]


class Block:
    """Documents and links of one block."""

    def __init__(self, number):
        self.number, self.docs, self.bytes, self.parts = number, 0, 0, []

    def full(self):
        return self.docs >= BLOCK_DOCS or self.bytes > BLOCK_BYTES

    def add(self, links, width):
        docs, a, b, times = links
        self.parts.append(summed((a * width + b) * BLOCK_DOCS + docs + self.docs, times))

    def rows(self, width):
        """Bitmaps of the documents of each pair, then its multiplicity planes: weight 1 and whole, then 1, 2, 4, ..."""
        keys, times = summed(*(np.concatenate(column) for column in zip(*self.parts)))
        pairs, places = np.divmod(keys, BLOCK_DOCS)
        extra = times - 1
        planes = [(1, True, np.ones(len(keys), dtype=bool))]
        planes += [(1 << k, False, (extra >> k) & 1 > 0) for k in range(int(extra.max()).bit_length() if len(extra) else 0)]
        for weight, whole, some in planes:
            found, counts, bits = bitmaps(pairs[some], places[some])
            if len(found):
                a, b = np.divmod(found, width)
                yield a, b, np.full(len(found), weight), np.full(len(found), whole), counts, bits


def inverted(docs, vocabulary, pattern, proto, id_col, text_col, digest):
    """Rows (kind 0: document with its block and place) and (kind 1: bitmap of a pair in a block)."""
    context = docs.sparkSession.sparkContext.broadcast((vocabulary, pattern, proto))
    id_type = docs.schema[id_col].dataType
    doc_names, pair_names = [n for n, _ in _DOC_FIELDS], [n for n, _ in _PAIR_FIELDS]
    schema = T.StructType.fromDDL(
        "kind int, block long, pos int, n_a long, n_b long, n_groups long, n_links long, groups string, "
        "a int, b int, weight long, whole boolean, n long, bits binary"
    ).add(T.StructField("id", id_type))
    names = ["kind", "block", "pos", *doc_names, *pair_names, "id"]

    def batch(kind, block, rows, given, id_array_type):
        columns = []
        for name, type_ in [("pos", pa.int32()), *_DOC_FIELDS, *_PAIR_FIELDS, ("id", id_array_type)]:
            value = given.get(name)
            columns.append(pa.nulls(rows, type_) if value is None else value if isinstance(value, pa.Array) else pa.array(value, type_))
        head = [pa.array(np.full(rows, kind, dtype=np.int32)), pa.array(np.full(rows, block, dtype=np.int64))]
        return pa.RecordBatch.from_arrays([*head, *columns], names)

    def run(batches):
        aligner = Aligner(*context.value)
        width = len(aligner.b.lengths)
        if len(aligner.a.known) * width * BLOCK_DOCS >= 1 << 62:
            raise ValueError("the vocabularies are too large for one 64-bit key")
        task, number = TaskContext.get().partitionId(), 0
        block, ids_type = Block(task << 24), None

        def rows(of):
            for a, b, weight, whole, n, bits in of.rows(width) if of.parts else ():
                yield batch(1, of.number, len(a), dict(zip(pair_names, (a, b, weight, whole, n, bits))), ids_type)

        for given in batches:
            ids_type, texts, first, size = given.column(0).type, [], 0, 0
            for i in range(given.num_rows):
                texts.append(given.column(1)[i].as_py())
                size += len(texts[-1] or "")
                if size < RUN_BYTES and len(texts) + block.docs < BLOCK_DOCS and i + 1 < given.num_rows:
                    continue
                *counts, groups, links = aligner.align(texts)
                groups = [hashlib.sha256(g).hexdigest() if g and digest else g.decode() for g in groups]
                place = np.arange(len(texts)) + block.docs
                ids = given.column(0).slice(first, len(texts))
                yield batch(0, block.number, len(texts), {"pos": place, "id": ids, **dict(zip(doc_names, (*counts, groups)))}, ids_type)
                block.add(links, width)
                block.docs += len(texts)
                block.bytes += size
                texts, first, size = [], i + 1, 0
                if block.full():
                    yield from rows(block)
                    number += 1
                    block = Block((task << 24) + number)
        yield from rows(block)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def returned_scores(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bitmaps of one block, with the counts of their pairs, as sums for its documents."""
    sums = np.zeros((2, BLOCK_DOCS), dtype=np.int64)
    seen = np.zeros(BLOCK_DOCS, dtype=bool)
    for batch in batches:
        n = batch.column("n").to_numpy(zero_copy_only=False)
        places = places_of(n, batch.column("bits"))
        weight = batch.column("weight").to_numpy(zero_copy_only=False)
        best = batch.column("is_best").to_numpy(zero_copy_only=False)
        np.add.at(sums[0], places, np.repeat(weight * best, n))
        np.add.at(sums[1], places, np.repeat(weight * batch.column("n_docs").to_numpy(zero_copy_only=False), n))
        seen[places] = True
    pos = np.flatnonzero(seen)
    columns = [pa.array(np.full(len(pos), key[0].as_py(), dtype=np.int64)), pa.array(pos, pa.int32())]
    yield pa.RecordBatch.from_arrays([*columns, pa.array(sums[0, pos]), pa.array(sums[1, pos])], ["block", "pos", "n_best", "count_sum"])


def pair_counts(found):
    """Documents and links of each pair of ids, and whether no pair of its A id is in more documents."""
    whole = F.when(F.col("whole"), F.col("n"))
    counts = found.filter("kind = 1").groupBy("a", "b").agg(F.sum(whole).alias("n_docs"), F.sum(F.col("weight") * F.col("n")).alias("n_links"))
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "a").select("a", "b", "n_docs", "n_links", (F.col("n_docs") == F.col("most")).alias("is_best"))


def align(docs, json_path, model_path, pattern, id_col="doc_id", text_col="text", digest=False):
    """(documents, pairs): per document its counts, groups and scores; per pair of ids its counts.

    groups is `a1,a2|b1;a3|b2,b3`: ids of A and of B in their order, one group after the other; with `digest`
    it is the SHA-256 of that, and of a document without tokens the empty string either way.
    """
    with open(model_path, "rb") as file:
        proto = file.read()
    found, _ = stored(inverted(docs, read_byte_level(json_path), pattern, proto, id_col, text_col, digest), "alignment", ("kind",))
    pairs, _ = stored(pair_counts(found), "pairs")
    bitmaps_ = found.filter("kind = 1").select("block", "a", "b", "weight", "n", "bits")
    scored = bitmaps_.join(pairs.select("a", "b", "n_docs", "is_best"), ["a", "b"])
    scores = scored.groupBy("block").applyInArrow(returned_scores, "block long, pos int, n_best long, count_sum long")
    rows = found.filter("kind = 0").select("block", "pos", "id", "n_a", "n_b", "n_groups", "n_links", "groups")
    out = rows.join(scores, ["block", "pos"], "left").select(
        F.col("id").alias(id_col),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")],
        "groups",
    )
    return out, pairs


def report(docs, json_path, model_path, pattern, id_col="doc_id", text_col="text"):
    """One row per document, with the digest of its groups."""
    return align(docs, json_path, model_path, pattern, id_col, text_col, digest=True)[0].withColumnRenamed("groups", "groups_sha256")
