"""Byte-level BPE encoding and decoding with padded NumPy matrices.

A text is cut into the matches of a pattern; matches never share a token. Matches that the task has not met before
are put, by length, into matrices of byte tokens padded on the right. In each round every row of a matrix merges
the leftmost of its pairs of least rank: ranks of neighbours come from a hash table of pairs, only the two pairs
around a merge are looked up again, the freed place is squeezed out, and rows without a pair left leave the matrix.
Decoding gathers the bytes of all ids of a batch at once.

The table of pairs is made once on the driver from the vocabulary and broadcast; its size is that of the vocabulary.
Tokens of met matches are kept in two generations of bounded size, which end with the task.

Edge cases: a null or empty text has no ids and decodes to no bytes; a text of any length is read in runs of
matches; a match longer than `LONG` bytes would need as many rounds as bytes and is merged along a heap, in the same
order; repeated rows are encoded each; an empty table gives an empty one; columns of the input stay as they are, and
one that has the name of the new column is replaced. Ids outside the vocabulary are an error.
"""

import base64
import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longest match, in bytes, that goes through the matrices.
LONG = 1024
#: Values of one matrix.
MATRIX_VALUES = 1 << 21
#: Characters of texts that are cut at a time, and matches of a longer text.
RUN_CHARS = 1 << 19
RUN_MATCHES = 1 << 17
#: Bytes of one generation of known matches, with about what Python needs for an entry.
CACHE_BYTES = 32 << 20
ENTRY_BYTES = 240
_NONE = np.iinfo(np.int32).max
_MIX = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path):
    """Token bytes and their ranks, from a file with a base64 token and its rank per line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def byte_of_sign():
    """The printable signs that byte-level vocabularies write bytes with: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class PairTable:
    """Pairs of ids -> rank of the merged token, by open addressing over arrays."""

    def __init__(self, left, right, ranks):
        size = 1 << max(4, int(4 * len(ranks)).bit_length())
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.keys, self.ranks = np.zeros(size, dtype=np.uint64), np.full(size, _NONE, dtype=np.int32)
        keys = self._key(np.asarray(left), np.asarray(right))
        ranks = np.asarray(ranks, dtype=np.int32)
        at = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.ranks[at[put]] = keys[put], ranks[put]
            rest = np.ones(len(keys), dtype=bool)
            rest[put] = False
            keys, ranks, at = keys[rest], ranks[rest], (at[rest] + 1) & (size - 1)

    @staticmethod
    def _key(left, right):
        return (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) + np.uint64(1))

    def _slot(self, keys):
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def look_up(self, left, right):
        """Ranks of pairs, the largest int32 where there is none."""
        keys = self._key(left, right)
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], _NONE)
        open_ = np.flatnonzero((found != keys) & (found != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found != 0)]
        return out


class Vocabulary:
    """Arrays of a byte-level vocabulary: ids of single bytes, the pair table, ids by rank, bytes by id.

    ids: token bytes -> id, every single byte among them. pairs: (left id, right id, rank) of the merges that are
    allowed. whole: whether a match that is a token is taken as that token without merging.
    """

    def __init__(self, ids, pairs, whole):
        size = max(ids.values()) + 1
        tokens = [None] * size
        for token, number in ids.items():
            tokens[number] = token
        left, right, rank = (np.array(column, dtype=np.int64) for column in zip(*pairs))
        self.table = PairTable(left, right, rank)
        self.id_of_rank = np.zeros(int(rank.max()) + 1, dtype=np.int32)
        self.id_of_rank[rank] = [ids[tokens[a] + tokens[b]] for a, b, _ in pairs]
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], dtype=np.int32)
        self.known = np.array([token is not None for token in tokens])
        self.lengths = np.array([len(token or b"") for token in tokens], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.flat = np.frombuffer(b"".join(token or b"" for token in tokens), dtype=np.uint8)
        self.whole = whole

    @classmethod
    def from_ranks(cls, ranks):
        """Token bytes -> rank, which is the id too; any two neighbours that make a token may merge."""
        cuts = ((token, rank, token[:k], token[k:]) for token, rank in ranks.items() for k in range(1, len(token)))
        return cls(ranks, [(ranks[a], ranks[b], rank) for _, rank, a, b in cuts if a in ranks and b in ranks], whole=True)

    @classmethod
    def from_merges(cls, ids, merges):
        """Token bytes -> id, and pairs of token bytes in the order of their ranks; nothing else merges."""
        return cls(ids, [(ids[a], ids[b], rank) for rank, (a, b) in enumerate(merges)], whole=False)

    def whole_tokens(self):
        data = self.flat.tobytes()
        spans = zip(np.flatnonzero(self.known).tolist(), self.starts[self.known].tolist(), self.lengths[self.known].tolist())
        return {data[start : start + length]: number for number, start, length in spans}

    def bytes_of(self, ids):
        """All bytes of the ids in one array, and the number of bytes of each id."""
        ids = ids.astype(np.int64)
        if len(ids) and (ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ids) else 0
        return self.flat[np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(total)], lengths


def merge_matrix(vocabulary, ids):
    """Final ids of every row of a matrix padded with -1; rows of the answer are padded alike."""
    table, of_rank = vocabulary.table, vocabulary.id_of_rank
    out = np.full(ids.shape, -1, dtype=np.int32)
    rows = np.arange(len(ids))
    ranks = np.full((len(ids), max(0, ids.shape[1] - 1)), _NONE, dtype=np.int32)
    inside = ids[:, 1:] >= 0
    ranks[inside] = table.look_up(ids[:, :-1][inside], ids[:, 1:][inside])
    while len(rows):
        width = ids.shape[1]
        if width == 1:
            out[rows, 0] = ids[:, 0]
            break
        at = ranks.argmin(axis=1)
        every = np.arange(len(rows))
        least = ranks[every, at]
        live = least != _NONE
        if not live.all():
            out[rows[~live], :width] = ids[~live]
            ids, ranks, rows, at, least = ids[live], ranks[live], rows[live], at[live], least[live]
            every = np.arange(len(rows))
            if not len(rows):
                break
        ids[every, at] = of_rank[least]
        keep = np.ones(ids.shape, dtype=bool)
        keep[every, at + 1] = False
        ids = ids[keep].reshape(len(rows), width - 1)
        keep = np.ones(ranks.shape, dtype=bool)
        keep[every, at] = False
        ranks = ranks[keep].reshape(len(rows), width - 2)
        for place in (at - 1, at):  # The pairs that end and begin with the merged token.
            some = np.flatnonzero((place >= 0) & (place < width - 2))
            left, right = ids[some, place[some]], ids[some, np.minimum(place[some] + 1, width - 2)]
            paired = right >= 0
            fresh = np.full(len(some), _NONE, dtype=np.int32)
            fresh[paired] = table.look_up(left[paired], right[paired])
            ranks[some, place[some]] = fresh
    return out


def merge_long(vocabulary, data):
    """Ids of one long match: the same order of merges along a heap of (rank, place)."""
    ids = vocabulary.byte_ids[np.frombuffer(data, dtype=np.uint8)]
    first = vocabulary.table.look_up(ids[:-1], ids[1:])
    ids, size = ids.tolist(), len(ids)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    wanted = first.tolist() + [_NONE]
    heap = [(rank, at) for at, rank in enumerate(wanted) if rank != _NONE]
    heapq.heapify(heap)
    known = {}

    def rank_of(a, b):
        if (a, b) not in known:
            known[a, b] = int(vocabulary.table.look_up(np.array([a]), np.array([b]))[0])
        return known[a, b]

    while heap:
        rank, at = heapq.heappop(heap)
        if wanted[at] != rank:
            continue
        gone = after[at]
        ids[at] = int(vocabulary.id_of_rank[rank])
        ids[gone], wanted[gone] = -1, _NONE
        after[at] = after[gone]
        if after[at] < size:
            before[after[at]] = at
        for place in (before[at], at):
            if place >= 0:
                wanted[place] = rank_of(ids[place], ids[after[place]]) if after[place] < size else _NONE
                if wanted[place] != _NONE:
                    heapq.heappush(heap, (wanted[place], place))
    return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()


def merged_pieces(vocabulary, pieces):
    """Id bytes of each piece (bytes, not empty), in buckets of doubling length."""
    out = [b""] * len(pieces)
    buckets = {}
    for i, piece in enumerate(pieces):
        if len(piece) > LONG:
            out[i] = merge_long(vocabulary, piece)
        else:
            buckets.setdefault((len(piece) - 1).bit_length(), []).append(i)
    for bits, members in buckets.items():
        step = max(1, MATRIX_VALUES >> bits)
        for begin in range(0, len(members), step):
            part = members[begin : begin + step]
            lengths = np.array([len(pieces[i]) for i in part])
            matrix = np.full((len(part), int(lengths.max())), -1, dtype=np.int32)
            inside = np.arange(matrix.shape[1]) < lengths[:, None]
            matrix[inside] = vocabulary.byte_ids[np.frombuffer(b"".join(pieces[i] for i in part), dtype=np.uint8)]
            done = merge_matrix(vocabulary, matrix)
            used = done >= 0
            data = done[used].astype("<u4").tobytes()
            ends = (4 * np.cumsum(used.sum(axis=1))).tolist()
            for i, a, b in zip(part, [0, *ends], ends):
                out[i] = data[a:b]
    return out


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, for one task."""

    def __init__(self, vocabulary, pattern):
        import regex

        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.whole = vocabulary.whole_tokens() if vocabulary.whole else {}
        self.young, self.old, self.bytes = {}, {}, 0

    def _learn(self, matches):
        """Id bytes of all given matches: the young generation has them afterwards."""
        fresh, old = [], self.old
        for match in matches.difference(self.young):
            if match in old:
                self._keep(match, old[match])
            else:
                fresh.append(match)
        raw = [match.encode() for match in fresh]
        whole = [self.whole.get(piece) for piece in raw]
        open_ = [i for i, number in enumerate(whole) if number is None]
        for i, ids in zip(open_, merged_pieces(self.vocabulary, [raw[i] for i in open_])):
            self._keep(fresh[i], ids)
        for match, number in zip(fresh, whole):
            if number is not None:
                self._keep(match, number.to_bytes(4, "little"))

    def _keep(self, match, ids):
        self.young[match] = ids
        self.bytes += len(match) + len(ids) + ENTRY_BYTES

    def _flush(self, runs):
        if self.bytes > CACHE_BYTES:
            self.young, self.old, self.bytes = {}, self.young, 0
        self._learn(set().union(*runs))
        get = self.young.__getitem__
        return [b"".join(map(get, run)) for run in runs]

    def _long(self, text):
        """Id bytes of runs of matches of one text."""
        found = (m.group() for m in self.pattern.finditer(text))
        while run := list(islice(found, RUN_MATCHES)):
            yield self._flush([run])[0]

    def encode(self, texts):
        """The id bytes of each text; null counts as empty. The caller bounds the run."""
        out = [None if text and len(text) > RUN_CHARS else self.pattern.findall(text or "") for text in texts]
        short = iter(self._flush([run for run in out if run is not None]))
        return [next(short) if run is not None else b"".join(self._long(text)) for run, text in zip(out, texts)]


def runs(column, size):
    """A string or binary column as (first row, values) with about `size` characters or bytes, one value at least."""
    first, values, total = 0, [], 0
    for i, value in enumerate(column):
        values.append(value.as_py())
        total += len(values[-1] or "")
        if total > size:
            yield first, values
            first, values, total = i + 1, [], 0
    if values:
        yield first, values


def _added(batch, first, new, names):
    """Some rows of a batch with binary columns put in or in place of those with their names."""
    rows = batch.slice(first, len(next(iter(new.values()))))
    arrays = [pa.array(new[name], pa.binary()) if name in new else rows.column(name) for name in names]
    return pa.RecordBatch.from_arrays(arrays, names)


def _schema(table, names):
    kept = [field for field in table.schema.fields if field.name not in names]
    return T.StructType([*kept, *[T.StructField(name, T.BinaryType()) for name in names]])


def encoded(docs, vocabulary, pattern, text_col="text", into="ids", back=None):
    """The table with the ids of its texts: binary, four little-endian bytes an id.

    back: the name of one more column, for the bytes that the ids decode to.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = _schema(docs, [into, *([back] if back else [])])

    def encode(batches):
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            for first, texts in runs(batch.column(text_col), RUN_CHARS):
                new = {into: encoder.encode(texts)}
                if back:
                    new[back] = decode(shared.value, new[into])
                yield _added(batch, first, new, schema.names)

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(encode, schema)


def decoded(table, vocabulary, ids_col="ids", into="decoded"):
    """The table with the bytes that its ids stand for; null ids are none."""
    shared = table.sparkSession.sparkContext.broadcast(vocabulary)
    schema = _schema(table, [into])

    def run(batches):
        for batch in batches:
            for first, rows in runs(batch.column(ids_col), 4 * RUN_CHARS):
                yield _added(batch, first, {into: decode(shared.value, rows)}, schema.names)

    return table.mapInArrow(run, schema)


def decode(vocabulary, rows):
    """The bytes that each row of id bytes stands for; long rows are gathered in parts."""
    if any(row is not None and len(row) > 8 * RUN_CHARS for row in rows):
        step = 8 * RUN_CHARS
        return [b"".join(_split(vocabulary, [row[i : i + step]])[0] for i in range(0, len(row or b""), step)) for row in rows]
    return _split(vocabulary, [row or b"" for row in rows])


def _split(vocabulary, rows):
    """Decoded bytes of several rows by one gather."""
    data, lengths = vocabulary.bytes_of(np.frombuffer(b"".join(rows), dtype="<u4"))
    upto = np.concatenate([[0], np.cumsum(lengths)])
    ends = upto[np.cumsum([len(row) // 4 for row in rows], dtype=np.int64)].tolist() if rows else []
    data = data.tobytes()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def report(docs, ranks_path, pattern, id_col="doc_id", text_col="text"):
    """Digests of the ids and of the bytes they decode to, one row per document."""
    vocabulary = Vocabulary.from_ranks(read_ranks(ranks_path))
    table = encoded(docs.select(id_col, F.col(text_col).alias("__text")), vocabulary, pattern, "__text", "__ids", "__back")
    return table.select(
        id_col,
        (F.octet_length("__ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("__ids", 256).alias("ids_sha256"),
        F.sha2("__back", 256).alias("decoded_sha256"),
    )
