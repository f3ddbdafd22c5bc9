"""Best-fit packing by length patterns: documents as token pieces into sequences of fixed size.

Lengths are counted. Patterns of up to `depth` length classes that fill a sequence exactly are enumerated and
their repeat counts are fitted to the histogram by non-negative least squares, then rounded. What the patterns
leave over goes, longest first, to the sequence with the least sufficient room. All of that handles counts of
lengths, never pieces, so the plan takes the same memory and time for any corpus. Pieces then take their
sequence from their place among the pieces of equal length, which is found in bounded buckets.

Edge cases: null and empty texts are the end token alone; repeated rows are packed each; a table without rows
gives none; columns of the input other than id and text are not read.
"""

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .ranks import ranked
from .tokens import WordEncoder

SIZE = 2048
#: Length classes of the fit, and documents in a pattern.
CLASSES = 512
DEPTH = 3


def pieces(docs, tokenizer, size=SIZE, id_col="doc_id", text_col="text", end_id=0, with_ids=False):
    """Pieces of at most `size` tokens of each document: id, piece, start, length, ids_crc32 and, if wanted, ids."""
    id_type = docs.schema[id_col].dataType
    fields = [(id_col, id_type), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(("ids", T.BinaryType()))
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def cut(batches):
        encoder = WordEncoder(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            texts = (value.as_py() for value in batch.column(1))
            row, piece, length, crc, ids = [], [], [], [], []
            for i, data in enumerate(encoder.encode(texts)):
                data += end
                for number, at in enumerate(range(0, len(data), 4 * size)):
                    part = data[at : at + 4 * size]
                    row.append(i)
                    piece.append(number)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            columns = [
                batch.column(0).take(pa.array(row, pa.int32())),
                pa.array(piece, pa.int32()),
                pa.array(np.array(piece, dtype=np.int64) * size),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [n for n, _ in fields])

    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def patterns(classes, depth):
    """Multisets of up to `depth` classes that add up to `classes`, as rows padded with 0."""
    rows = [(classes,)]
    if depth >= 2:
        rows += [(classes - b, b) for b in range(1, classes // 2 + 1)]
    if depth >= 3:
        rows += [(classes - b - c, b, c) for c in range(1, classes // 3 + 1) for b in range(c, (classes - c) // 2 + 1)]
    return np.array([r + (0,) * (depth - len(r)) for r in rows], dtype=np.int64)


def fitted(columns, wanted, rounds=24, at_once=64):
    """Non-negative least squares of pattern counts: an active set that takes in a few columns per round.

    columns: the classes of each pattern (0 = none); wanted: pieces per class, from class 0.
    """
    scale = max(1.0, float(wanted.sum()))
    goal = wanted / scale
    matrix = np.zeros((len(wanted), 0))
    chosen, x = np.zeros(0, dtype=np.int64), np.zeros(0)
    for _ in range(rounds):
        rest = goal - matrix @ x
        rest[0] = 0
        gain = rest[columns].sum(axis=1)
        gain[chosen] = 0
        order = np.argsort(-gain, kind="stable")[: 4 * at_once]
        order = order[gain[order] > 1e-9]
        # Columns that share no class can be taken in together.
        fresh, used = [], set()
        for j in order.tolist():
            parts = set(columns[j].tolist()) - {0}
            if not parts & used and len(fresh) < at_once:
                fresh.append(j)
                used |= parts
        if not fresh:
            break
        added = np.zeros((len(wanted), len(fresh)))
        for k, j in enumerate(fresh):
            np.add.at(added[:, k], columns[j][columns[j] > 0], 1)
        matrix, chosen, x = np.hstack([matrix, added]), np.concatenate([chosen, fresh]), np.concatenate([x, np.zeros(len(fresh))])
        while True:
            gram = matrix.T @ matrix + 1e-10 * np.eye(len(chosen))
            best = np.linalg.solve(gram, matrix.T @ goal)
            if (best > 0).all():
                x = best
                break
            down = best <= 0
            step = min(1.0, float(np.min(np.where(down, x / np.maximum(x - best, 1e-300), np.inf))))
            x = x + step * (best - x)
            keep = x > 1e-12
            if keep.all():
                keep[np.argmin(x)] = False
            matrix, chosen, x = matrix[:, keep], chosen[keep], x[keep]
    return chosen, x * scale


class Plan:
    """Runs of equal placements: pieces of one length, by place, into consecutive sequences at one offset."""

    def __init__(self, histogram, size=SIZE):
        self.size = size
        self.left = {n: c for n, c in histogram.items() if c}
        self.next_place = dict.fromkeys(self.left, 0)
        self.runs, self.sequences = [], 0
        self.open, self.rooms = {}, []

    def put(self, length, count, first, offset):
        self.runs.append((length, self.next_place[length], count, first, offset))
        self.next_place[length] += count
        self.left[length] -= count

    def leave_open(self, first, count, room):
        if room > 0 and count > 0:
            if not self.open.get(room):
                insort(self.rooms, room)
            self.open.setdefault(room, []).append((first, count))

    def by_patterns(self, classes=CLASSES, depth=DEPTH):
        width = -(-self.size // classes)
        classes = self.size // width
        of = {n: -(-n // width) for n in self.left}
        wanted = np.zeros(classes + 1)
        members = {}
        for n in sorted(self.left, reverse=True):
            if of[n] <= classes:
                wanted[of[n]] += self.left[n]
                members.setdefault(of[n], []).append(n)
        table = patterns(classes, depth)
        chosen, counts = fitted(table, wanted)
        for j in np.argsort(-table[chosen, 0], kind="stable").tolist():
            parts = [int(c) for c in table[chosen[j]] if c]
            have = {c: sum(self.left[n] for n in members.get(c, ())) for c in set(parts)}
            repeat = min(int(round(counts[j])), *(have[c] // parts.count(c) for c in have))
            if repeat > 0:
                self._repeat(parts, repeat, members)

    def _repeat(self, parts, repeat, members):
        """Sequences of one pattern; within a class the longer pieces go first."""
        first = self.sequences
        self.sequences += repeat
        groups = [(first, repeat, 0)]
        for c in parts:
            rest, groups, queue = groups, [], iter(members[c])
            n = next(queue)
            for begin, count, used in rest:
                while count:
                    while not self.left[n]:
                        n = next(queue)
                    k = min(count, self.left[n])
                    self.put(n, k, begin, used)
                    groups.append((begin, k, used + n))
                    begin, count = begin + k, count - k
        for begin, count, used in groups:
            self.leave_open(begin, count, self.size - used)

    def by_best_fit(self):
        """The rest, longest first, into the least sufficient room; new sequences take as many as they hold."""
        for n in sorted(self.left, reverse=True):
            while self.left[n]:
                at = bisect_left(self.rooms, n)
                if at == len(self.rooms):
                    per = self.size // n
                    whole, over = divmod(self.left[n], per)
                    for count, each in ((whole, per), (1 if over else 0, over)):
                        for k in range(each if count else 0):
                            self.put(n, count, self.sequences, k * n)
                        self.leave_open(self.sequences, count, self.size - each * n)
                        self.sequences += count
                    continue
                room = self.rooms[at]
                first, count = self.open[room].pop()
                if not self.open[room]:
                    self.rooms.pop(at)
                k = min(count, self.left[n])
                self.put(n, k, first, self.size - room)
                self.leave_open(first, k, room - n)
                self.leave_open(first + k, count - k, room)

    def lookup(self):
        """Run columns sorted by (length, place)."""
        runs = np.array(sorted(self.runs), dtype=np.int64).reshape(-1, 5)
        return [np.ascontiguousarray(runs[:, k]) for k in range(5)]


def planned(histogram, size=SIZE, classes=CLASSES, depth=DEPTH):
    plan = Plan(histogram, size)
    plan.by_patterns(classes, depth)
    plan.by_best_fit()
    return plan


def assigned(cut, plan, id_col="doc_id"):
    """The pieces with sequence_id and offset."""
    lengths, places, counts, firsts, offsets = plan.lookup()
    # Places of all lengths in one ascending line.
    stride = int(places.max() + counts.max() + 1) if len(places) else 1
    keys = lengths.astype(np.float64) * stride + places
    if len(keys) and keys[-1] >= 2**53:
        raise ValueError("too many pieces of one length for the lookup")
    answer = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @F.arrow_udf(answer)
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, n.astype(np.float64) * stride + r, side="right") - 1
        return pa.StructArray.from_arrays(
            [pa.array(firsts[at] + r - places[at]), pa.array(offsets[at])], names=["sequence_id", "offset"]
        )

    placed = ranked(cut, ["length"], [id_col, "piece", "ids_crc32"], into="__rank")
    return placed.withColumn("__at", place("length", "__rank")).select(*cut.columns, "__at.sequence_id", "__at.offset")


def pack(docs, tokenizer, size=SIZE, id_col="doc_id", text_col="text", classes=CLASSES, depth=DEPTH, **options):
    """Every piece of every document with its sequence and the place in it."""
    cut, _ = stored(pieces(docs, tokenizer, size, id_col, text_col, **options), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    return assigned(cut, planned(histogram, size, classes, depth), id_col)
