"""Hierarchical Pitman-Yor language model: seating by Gibbs sampling, averaged predictions as scores.

A context is the whole word before, or the beginning of a text. Every context has a restaurant whose customers
are the training tokens that follow it; all of them share one parent, the restaurant of words without context, whose
customers are the tables of the contexts and whose own parent is uniform over the known words and one unknown.
A sweep takes the customers of a word from a context and seats them again one after the other, by the Chinese
restaurant process given all other seats; large groups take their seats in leaps of an eighth of those seated.
After the burn-in, the predictive probabilities of the samples are averaged.

Everything about a word lies in one bucket of its hash: counts, tables and predictions. After every sweep the buckets
send what they hold of each context to shards of contexts, which know the places of its hashes since the first
seating, and get back its totals over all buckets. Documents are read once, in blocks that are coded by a
dictionary of their own; a block sends its distinct (word, context) pairs to the buckets and gets their
predictions back, so tokens themselves are never shuffled.

Edge cases: a null or empty text is one end token; repeated rows are scored and learnt each; a null id counts as
training; without any training token every token has the base probability of an unknown word.
"""

import copy
import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_path, release_shuffles, stored
from .words import text_bytes, word_hashes

FOLDS, HELD_FOLD = 7, 2
BURN_IN, SAMPLES = 3, 3
#: Concentration of the contexts and of the root; discounts are estimated from counts of counts.
STRENGTH = (10.0, 10.0)
#: Tokens that share one dictionary, and bytes of text per bucket of words.
BLOCK_TOKENS = 1_500_000
BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 12
#: Buckets are gathered and answered in so many parts, one after the other.
PARTS = 4
#: Hashes of the end and of the beginning of a text.
END, BEGIN = np.uint64(1), np.uint64(0)


def _planes(value):
    """Arrays as their first bytes, then their second bytes and so on, which compresses better."""
    if isinstance(value, np.ndarray):
        return value.dtype.str, np.ascontiguousarray(value).view(np.uint8).reshape(-1, value.itemsize).T.tobytes()
    return [_planes(v) for v in value] if isinstance(value, list | tuple) else value


def _joined(value):
    if isinstance(value, tuple):
        kind = np.dtype(value[0])
        return np.frombuffer(value[1], dtype=np.uint8).reshape(kind.itemsize, -1).T.copy(order="C").view(kind).reshape(-1)
    return [_joined(v) for v in value] if isinstance(value, list) else value


def packed(*values):
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(_planes(values), protocol=5))


def unpacked(data):
    return _joined(pickle.loads(zstandard.ZstdDecompressor().decompress(data)))


def _tokens(column):
    """(hash, context, tokens before each row) of all words and the end of each row."""
    hashes, _, _, offsets = word_hashes(column)
    ends = offsets + np.arange(len(offsets))
    size = len(hashes) + len(column)
    place = np.arange(len(hashes)) + np.repeat(np.arange(len(column)), np.diff(offsets))
    token = np.full(size, END, dtype=np.uint64)
    token[place] = hashes
    context = np.full(size + 1, BEGIN, dtype=np.uint64)
    context[place + 1] = hashes
    context[ends[:-1]] = BEGIN
    return token, context[:size], ends


class _Block:
    """Documents that share one dictionary of (word, context) pairs."""

    def __init__(self):
        self.rows, self.tokens, self.contexts, self.lengths, self.size = [], [], [], [], 0

    def add(self, rows, token, context, lengths):
        self.rows.append(rows)
        self.tokens.append(token)
        self.contexts.append(context)
        self.lengths.append(lengths)
        self.size += len(token)

    def coded(self, buckets):
        """The block itself, and per bucket of words the pairs it asks for with their training counts."""
        rows = pa.Table.from_batches(self.rows).combine_chunks()
        lengths = np.concatenate(self.lengths)
        learnt = np.repeat(~rows.column("held").to_numpy().astype(bool), lengths)
        words, word = np.unique(np.concatenate(self.tokens), return_inverse=True)
        contexts, context = np.unique(np.concatenate(self.contexts), return_inverse=True)
        pairs, pair = np.unique(word * len(contexts) + context, return_inverse=True)
        counts = np.bincount(pair, weights=learnt, minlength=len(pairs)).astype(np.uint32)
        of_word, of_context = np.divmod(pairs, max(1, len(contexts)))
        per_word = np.bincount(of_word, minlength=len(words))
        doc = np.repeat(np.arange(len(lengths)), lengths)
        # Scores are sums, so each document keeps its pairs in ascending order, as differences.
        order = np.lexsort((pair, doc))
        steps = np.diff(pair[order], prepend=0).astype(np.int32)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as writer:
            writer.write_table(rows)
        # Whether a pair begins a new word is all that the block needs to know of its words.
        yield -1, packed(sink.getvalue().to_pybytes(), lengths.astype(np.int32), steps, np.diff(of_word, prepend=-1) > 0)
        cuts = np.searchsorted(bucket_of(words, buckets), np.arange(buckets + 1))
        before = np.concatenate([[0], np.cumsum(per_word)])
        for b in range(buckets):
            lo, hi = cuts[b], cuts[b + 1]
            if hi > lo:
                part = slice(before[lo], before[hi])
                asked, place = np.unique(of_context[part], return_inverse=True)
                yield b, packed(words[lo:hi], per_word[lo:hi].astype(np.uint32), contexts[asked], place.astype(np.uint32), counts[part])


def bucket_of(words, buckets):
    return ((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _blocks(docs, buckets, id_col, text_col):
    """(kind, bucket, block, payload) of all blocks: kind 0 the block, kind 1 what it asks of a bucket."""
    held = F.pmod(F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(0)), F.lit(FOLDS)) == HELD_FOLD
    rows = docs.select(F.col(id_col).alias("doc"), held.alias("held"), F.col(text_col).alias("text"))

    def emit(block, name):
        coded = list(block.coded(buckets))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([0 if b < 0 else 1 for b, _ in coded], pa.int32()),
                pa.array([b for b, _ in coded], pa.int32()),
                pa.array([name] * len(coded), pa.int64()),
                pa.array([p for _, p in coded], pa.binary()),
            ],
            ["kind", "bucket", "block", "payload"],
        )

    def run(batches):
        block, number = _Block(), 0
        first = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = text_bytes(batch.column(2))
            row = 0
            while row < batch.num_rows:
                # About a MB of text at a time.
                end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + (1 << 20), side="right")) - 1)
                part = batch.slice(row, end - row)
                token, context, ends = _tokens(part.column(2))
                block.add(part.select([0, 1]), token, context, np.diff(ends))
                row = end
                if block.size >= BLOCK_TOKENS:
                    yield emit(block, first + number)
                    block, number = _Block(), number + 1
        if block.size:
            yield emit(block, first + number)

    return rows.mapInArrow(run, "kind int, bucket int, block long, payload binary")


def _merged(payloads):
    """Words, contexts and pairs of a bucket over all blocks, with the place of every asked word and pair in them."""
    asked = [unpacked(p) for p in payloads]
    words, word = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    contexts, context = np.unique(np.concatenate([a[2] for a in asked]), return_inverse=True)
    begin, first, keys = 0, 0, []
    for own, per_word, near, place, _ in asked:
        of_context = context[first : first + len(near)][place]
        keys.append(np.repeat(word[begin : begin + len(own)], per_word) * len(contexts) + of_context)
        begin, first = begin + len(own), first + len(near)
    pairs, pair = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(pair, weights=np.concatenate([a[4] for a in asked]), minlength=len(pairs)).astype(np.int64)
    return asked, words, word, contexts, pairs, pair, counts


class Totals:
    """Sums over all buckets that seating and prediction need; those of contexts are in the order of a seating."""

    def __init__(self, row):
        self.customers = np.array(row["customers"], dtype=np.float64)
        self.tables = np.array(row["tables"], dtype=np.float64)
        self.root_tables = float(row["root_tables"])
        self.root_customers = float(row["root_customers"])
        self.tokens, self.known = int(row["tokens"]), int(row["known"])
        ones, twos, pair_ones, pair_twos = (float(x) for x in row["few"])
        self.root_discount = min(0.95, max(0.05, ones / max(1.0, ones + 2 * twos)))
        self.discount = min(0.95, max(0.05, pair_ones / max(1.0, pair_ones + 2 * pair_twos)))

    def of(self, customers, tables):
        """The same with the sums of the contexts of one bucket."""
        own = copy.copy(self)
        own.customers, own.tables = customers.astype(np.float64), tables.astype(np.float64)
        return own


class Seating:
    """Customers and tables of the words of one bucket."""

    def __init__(self, pairs, counts, words, contexts):
        self.word, self.context = np.divmod(pairs, contexts)
        self.count, self.words, self.contexts = counts, words, contexts
        self.tables = (counts > 0).astype(np.int64)
        self.root = np.minimum(1, self.root_customers())

    def root_customers(self):
        return np.bincount(self.word, weights=self.tables, minlength=self.words).astype(np.int64)

    def sweep(self, totals, rng):
        d, d0 = totals.discount, totals.root_discount
        unseen = (STRENGTH[1] + d0 * totals.root_tables) / (totals.known + 1)
        scale = STRENGTH[1] + totals.root_customers
        for group in range(8):
            mine = np.flatnonzero((self.context % 8 == group) & (self.count > 0))
            w = self.word[mine]
            others = self.root_customers()[w] - self.tables[mine]
            root = np.minimum(np.maximum(self.root[w], 1), np.maximum(others, 1))
            pull = STRENGTH[0] + d * np.maximum(totals.tables[self.context[mine]], 1.0)

            def opens(at, tables):
                parent = np.maximum(others[at] + tables - d0 * root[at], 0.0) + unseen
                return pull[at] * parent / scale

            self.tables[mine] = _seated(self.count[mine], d, opens, rng)
        self.root = np.where(
            self.root_customers() > 0, _seated(self.root_customers(), d0, lambda at, tables: np.full(len(at), unseen), rng), 0
        )

    def predictive(self, totals):
        """Of every pair: the probability of the word in the context."""
        d, d0 = totals.discount, totals.root_discount
        unseen = (STRENGTH[1] + d0 * totals.root_tables) / (totals.known + 1)
        root = (np.maximum(self.root_customers() - d0 * self.root, 0.0) + unseen) / (STRENGTH[1] + totals.root_customers)
        u = self.context
        seated = np.maximum(self.count - d * self.tables, 0.0)
        above = (STRENGTH[0] + d * totals.tables[u]) * root[self.word]
        return (seated + above) / (STRENGTH[0] + totals.customers[u])

    def summary(self):
        words = np.bincount(self.word, weights=self.count, minlength=self.words)
        few = [int((words == k).sum()) for k in (1, 2)] + [int((self.count == k).sum()) for k in (1, 2)]
        return {
            "customers": np.bincount(self.context, weights=self.count, minlength=self.contexts).astype(np.int64),
            "tables": np.bincount(self.context, weights=self.tables, minlength=self.contexts).astype(np.int64),
            "root_customers": int(self.tables.sum()),
            "root_tables": int(self.root.sum()),
            "tokens": int(self.count.sum()),
            "known": int((words > 0).sum()),
            "few": few,
        }


def _seated(counts, discount, opens, rng):
    """Tables after `counts` customers of one dish sat down one after the other; opens(rows, tables) is the pull of a new table."""
    tables = np.minimum(counts, 1).astype(np.int64)
    at, seated = np.flatnonzero(counts > 1), 1
    while len(at):
        leap = max(1, seated // 8)
        take = np.minimum(leap, counts[at] - seated)
        new = opens(at, tables[at])
        chance = new / (new + np.maximum(seated - discount * tables[at], 1e-9))
        if leap == 1:
            tables[at] += rng.random(len(at)) < chance
        else:
            tables[at] += rng.binomial(take, chance)
        seated += leap
        at = at[counts[at] > seated]
    return tables


_SCALARS = ("root_customers", "root_tables", "tokens", "known")
_STATE = f"bucket int, state binary, sums array<binary>, {', '.join(f'{c} long' for c in _SCALARS)}, few array<long>"
#: What no sweep changes: words, contexts and counts of the pairs, and the hashes of the contexts by shard.
_FIXED = "fixed binary, hashes array<binary>"


def _state_batch(bucket, seating, cuts, customers, samples):
    """One row: the seats, and per shard of contexts what this bucket holds of them; customers only as long as totals are unknown."""
    s = seating.summary()
    state = packed(seating.tables, seating.root, customers, samples)
    held = [s["tables"]] if customers is not None else [s["tables"], s["customers"]]
    sums = [packed(*[h[lo:hi] for h in held]) if hi > lo else None for lo, hi in zip(cuts[:-1], cuts[1:])]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([bucket], pa.int32()),
            pa.array([state], pa.binary()),
            pa.array([sums], pa.list_(pa.binary())),
            *[pa.array([s[c]], pa.int64()) for c in _SCALARS],
            pa.array([s["few"]], pa.list_(pa.int64())),
        ],
        ["bucket", "state", "sums", *_SCALARS, "few"],
    )


def _restored(fixed, state, replies):
    """The seating of a bucket, the cuts of its contexts into shards, their customers and tables over all buckets, and the samples."""
    word, context, count, cuts = unpacked(fixed)
    tables, root, customers, samples = unpacked(state)
    seating = Seating.__new__(Seating)
    seating.word, seating.context, seating.count = word.astype(np.int64), context.astype(np.int64), count
    seating.tables, seating.root, seating.words, seating.contexts = tables, root, len(root), int(cuts[-1])
    parts = [unpacked(r["payload"]) for r in sorted(replies, key=lambda r: r["shard"])]
    totals = [np.concatenate(part) for part in zip(*parts)]
    return seating, cuts, totals[1] if customers is None else customers, totals[0], samples


def _totals(states):
    """The sums that are no arrays of contexts, as one row."""
    few = F.array(*[F.sum(F.col("few")[k]) for k in range(4)]).alias("few")
    row = states.agg(few, *[F.sum(c).alias(c) for c in _SCALARS]).first()
    return Totals({**row.asDict(), "customers": [], "tables": []})


def _places(begun):
    """(shard, bucket, place): where the contexts of each bucket lie among all contexts of a shard."""

    def placed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, hashes = [], []
        for batch in batches:
            buckets += batch.column("bucket").to_pylist()
            hashes += [unpacked(p.as_py())[0] for p in batch.column("hashes")]
        place = np.unique(np.concatenate(hashes), return_inverse=True)[1].astype(np.uint32)
        ends = np.cumsum([len(h) for h in hashes])[:-1]
        for bucket, mine in zip(buckets, np.split(place, ends)):
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([bucket], pa.int32()), pa.array([packed(mine)])], ["shard", "bucket", "place"])

    sent = begun.select("bucket", F.posexplode("hashes").alias("shard", "hashes")).filter("hashes is not null")
    return sent.groupBy("shard").applyInArrow(placed, "shard int, bucket int, place binary")


def _with_context_totals(states, fixed, places):
    """(bucket, fixed, state, replies): the totals over all buckets of the contexts of each bucket, per shard in the bucket's order."""

    def added(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        held = dict(zip(left.column("bucket").to_pylist(), left.column("payload").to_pylist()))
        buckets = right.column("bucket").to_pylist()
        place = [unpacked(p)[0] for p in right.column("place").to_pylist()]
        parts = [unpacked(held[b]) for b in buckets]
        at = np.concatenate(place)
        sums = [np.bincount(at, weights=np.concatenate(h)).astype(np.int64) for h in zip(*parts)]
        replies = pa.array([packed(*[x[mine] for x in sums]) for mine in place], pa.binary())
        return pa.table([pa.array(buckets, pa.int32()), pa.array([key[0].as_py()] * len(buckets), pa.int32()), replies], ["bucket", "shard", "payload"])

    sent = states.select("bucket", F.posexplode("sums").alias("shard", "payload")).filter("payload is not null")
    replies = sent.groupBy("shard").cogroup(places.groupBy("shard")).applyInArrow(added, "bucket int, shard int, payload binary")
    replies = replies.groupBy("bucket").agg(F.collect_list(F.struct("shard", "payload")).alias("replies"))
    both = fixed.select("bucket", "fixed").join(states.select("bucket", "state"), "bucket")
    return both.join(replies, "bucket").select("bucket", "fixed", "state", "replies")


def _begin(requests, shards):
    """Per bucket: the first seating from the requests of all blocks, and what no sweep changes."""

    def gather(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        payloads = [p for batch in batches for p in batch.column("payload").to_pylist()]
        _, words, _, contexts, pairs, _, counts = _merged(payloads)
        seating = Seating(pairs, counts, len(words), len(contexts))
        cuts = np.searchsorted(bucket_of(contexts, shards), np.arange(shards + 1))
        first = _state_batch(key[0].as_py(), seating, cuts, None, [])
        fixed = packed(seating.word.astype(np.int32), seating.context.astype(np.int32), counts, cuts)
        hashes = [packed(contexts[lo:hi]) if hi > lo else None for lo, hi in zip(cuts[:-1], cuts[1:])]
        more = [pa.array([fixed], pa.binary()), pa.array([hashes], pa.list_(pa.binary()))]
        yield pa.RecordBatch.from_arrays([*first.columns, *more], [*first.schema.names, "fixed", "hashes"])

    return requests.select("bucket", "payload").groupBy("bucket").applyInArrow(gather, f"{_STATE}, {_FIXED}")


def _swept(states, fixed, places, totals, number, burn_in, seed):
    def run(batches):
        for batch in batches:
            for bucket, *held in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                seating, cuts, customers, tables, samples = _restored(*(h.as_py() for h in held))
                # The totals are those of the sweep before.
                if number > burn_in:
                    samples = [*samples, (seating.tables.copy(), seating.root.copy(), tables)]
                seating.sweep(totals.of(customers, tables), np.random.default_rng([seed, number, bucket]))
                yield _state_batch(bucket, seating, cuts, customers, samples)

    return _with_context_totals(states, fixed, places).mapInArrow(run, _STATE)


def _answers(last, requests, sample_totals):
    """(block, bucket, payload): log10 of the averaged predictions of the asked pairs, and training counts of the words."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.binary())], ["block", "bucket", "payload"])
        blocks, payloads = left.column("block").to_pylist(), left.column("payload").to_pylist()
        asked, _, word, _, _, pair, _ = _merged(payloads)
        seating, _, customers, tables, samples = _restored(*(right.column(c)[0].as_py() for c in ("fixed", "state", "replies")))
        samples = [*samples, (seating.tables, seating.root, tables)]
        counts = np.bincount(seating.word, weights=seating.count, minlength=seating.words).astype(np.uint32)
        average = np.zeros(len(seating.word))
        for (seats, root, of_contexts), totals in zip(samples, sample_totals):
            seating.tables, seating.root = seats, root
            average += seating.predictive(totals.of(customers, of_contexts))
        score = np.log10(average / len(samples))
        at_word = at_pair = 0
        replies = []
        for own, _, _, place, _ in asked:
            replies.append(packed(score[pair[at_pair : at_pair + len(place)]], counts[word[at_word : at_word + len(own)]]))
            at_word, at_pair = at_word + len(own), at_pair + len(place)
        return pa.table([pa.array(blocks, pa.int64()), pa.array([key[0].as_py()] * len(blocks), pa.int32()), pa.array(replies, pa.binary())], ["block", "bucket", "payload"])

    both = requests.select("bucket", "block", "payload").groupBy("bucket").cogroup(last.groupBy("bucket"))
    return both.applyInArrow(run, "block long, bucket int, payload binary")


def _scored(blocks, answers, totals, id_type):
    """Per document of each block the sums of its tokens' scores."""
    lowest = np.log10(totals.tokens + totals.known + 1)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {}
        for batch in batches:
            parts.update(zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist()))
        rows, lengths, steps, begins = unpacked(parts.pop(-1))
        rows = pa.ipc.open_stream(rows).read_all().combine_chunks()
        replies = [unpacked(parts[b]) for b in sorted(parts)]
        score = np.concatenate([r[0] for r in replies])
        counts = np.concatenate([r[1] for r in replies])[np.cumsum(begins) - 1]
        pair = np.cumsum(steps)
        cuts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        base = np.add.reduceat(np.log10(counts[pair] + 1.0), cuts) - lengths * lowest
        known = np.add.reduceat((counts[pair] > 0).astype(np.int64), cuts)
        n = len(lengths)
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("doc").combine_chunks() if isinstance(rows.column("doc"), pa.ChunkedArray) else rows.column("doc"),
                pa.array(rows.column("held").to_numpy().astype(bool)),
                pa.array(lengths.astype(np.int64)),
                pa.array(known),
                pa.array(np.full(n, totals.tokens, dtype=np.int64)),
                pa.array(base),
                pa.array(np.add.reduceat(score[pair], cuts)),
            ],
            ["doc", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    fields = [("doc", id_type), ("held_out", T.BooleanType())]
    fields += [(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")]
    fields += [(n, T.DoubleType()) for n in ("base_score", "score")]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    return blocks.select("block", "bucket", "payload").union(answers).groupBy("block").applyInArrow(run, schema)


def score(docs, id_col="doc_id", text_col="text", burn_in=BURN_IN, samples=SAMPLES, seed=7):
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score and the model's log10 probability, score."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = int(max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)))
    part = F.floor(F.greatest("bucket", F.lit(0)) * PARTS / buckets).cast("int").alias("part")
    coded, path = stored(_blocks(docs, buckets, id_col, text_col).select("*", part), "lm-blocks", ["kind", "part"])
    # Requests are gathered by one part of the buckets after the other, so that their shuffle stays small next to the text.
    begun, paths = [], []
    for number in range(PARTS):
        found, place = stored(_begin(coded.filter(f"kind = 1 and part = {number}"), buckets), "lm-begun")
        begun.append(found)
        paths.append(place)
        release_shuffles(spark)
    begun = functools.reduce(DataFrame.union, begun)
    totals, sample_totals, last, answers = None if begun.isEmpty() else _totals(begun), [], None, None
    if totals:
        places, _ = stored(_places(begun), "lm-places")
        fixed, fixed_path = stored(begun.select("bucket", "fixed"), "lm-fixed")
        states = begun
        release_shuffles(spark)
    for number in range(burn_in + samples if totals else 0):
        states, seats = stored(_swept(states, fixed, places, totals, number, burn_in, seed), "lm-seats")
        for old in [last] if last else paths:
            drop_path(spark, old)
        last, totals = seats, _totals(states)
        release_shuffles(spark)
        if number >= burn_in:
            sample_totals.append(totals)
    for number in range(PARTS if totals else 0):
        mine = F.floor(F.col("bucket") * PARTS / buckets) == number
        of_part = _with_context_totals(states, fixed, places).filter(mine)
        found = _answers(of_part, coded.filter(f"kind = 1 and part = {number}"), sample_totals)
        found, _ = stored(found, "lm-answers")
        answers = answers.union(found) if answers else found
        drop_path(spark, f"{path}/kind=1/part={number}")
        release_shuffles(spark)
    # Scores need the answers only.
    for old in [fixed_path, last] if sample_totals else []:
        drop_path(spark, old)
    if not totals:
        totals = Totals({"customers": [], "tables": [], "root_customers": 0, "root_tables": 0, "tokens": 0, "known": 0, "few": [0] * 4})
        answers = coded.select("block", "bucket", "payload").limit(0)
    blocks = spark.read.schema("bucket int, block long, payload binary").parquet(path + "/kind=0") if sample_totals else coded
    found = _scored(blocks, answers, totals, docs.schema[id_col].dataType)
    return found.withColumnRenamed("doc", id_col)


def perplexity(scored):
    """Perplexity of the model and of the base, over held-out and over training documents."""
    def of(column):
        return F.pow(F.lit(10.0), -F.sum(column) / F.sum("n_tokens"))

    return scored.groupBy("held_out").agg(of("score").alias("perplexity"), of("base_score").alias("base_perplexity"))


def report(docs, **options):
    return score(docs.select("doc_id", "text"), **options)
