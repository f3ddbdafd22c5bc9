"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, as connected classes.

1. Equal sets are one class, so copies are compared once.
2. Every class sends its prefix: the first 25 % of its shingles (for 75 %) in a global order that puts frequent
   shingles last. Two sets that reach the threshold share a shingle of their prefixes, early enough in both to
   leave room for the overlap. Edges between rows of a shingle give candidate clusters: documents of different
   clusters cannot be linked.
3. Inside a cluster, signature trees (OR bitmaps and size ranges) are traversed pairwise; what survives is
   compared exactly on the whole sets. Clusters beyond UNIT_SETS are cut into blocks: first each block with
   itself, then the smallest document of each class found so far, then documents of different classes that share a
   shingle, and last, for shingles of very many rows, the pairs of blocks that still differ and fit in size.

The order of shingles is a parameter of speed only. It comes from counts of hash buckets, a table of fixed size:
buckets that are fuller than chance makes them go last, in the order of what they hold beyond that.

Edge cases: null and empty texts have no shingles and are their own class; fewer than five words are one
shingle; rows that share an id are one document, linked to whatever any of them is linked to; a null id takes
part in nothing and has a null component.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import release_shuffles, stored
from .components import components
from .shingles import WORDS, shingle_sets
from .signature_tree import links
from .words import mixed

PERCENT = 75
#: Shingle counts are kept for so many hash buckets, in so many chunks, each added up in so many parts.
SKETCH_BITS, CHUNKS, SALTS = 22, 64, 8
#: Sets and shingles compared by one task at a time.
UNIT_SETS = 512
UNIT_SHINGLES = 2_000_000
#: Documents of a shingle from which its rows are joined, not ordered.
HEAVY_ROWS = 1000
#: Rows of a shingle up to which its pairs are tested one by one.
FEW_ROWS = 512
#: Size of the filter that keeps documents outside all clusters from being shuffled.
FILTER_BITS = 22
#: Rows of tables without texts or shingles that are worth a task, and tasks that write them at least.
PART_ROWS, LEAST_PARTS = 20_000, 8
_CLASS = ["n_shingles", "s1", "s2"]


def _bucket(values):
    return (values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _small(df, label, parts):
    """Rows that are few next to the texts, written by few tasks."""
    return stored(df.coalesce(parts), label)[0]


def bucket_counts(docs, text_col, words):
    """How many sets hold a shingle of each hash bucket: per task at most 255 a bucket, added up in chunks."""
    size = (1 << SKETCH_BITS) // CHUNKS

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, dtype=np.uint16)
        for batch in batches:
            for values in shingle_sets(batch.column(0), words):
                at = _bucket(values)
                total[at] = np.minimum(total[at], 254) + 1
        parts = [zlib.compress(total[k * size : (k + 1) * size].astype(np.uint8), 1) for k in range(CHUNKS)]
        salt = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(CHUNKS), pa.int32()), pa.array([salt] * CHUNKS, pa.int32()), pa.array([1] * CHUNKS, pa.int32()), pa.array(parts)],
            ["chunk", "salt", "width", "counts"],
        )

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for width, counts in zip(batch.column("width").to_pylist(), batch.column("counts").to_pylist()):
                total += np.frombuffer(zlib.decompress(counts), dtype="u1" if width == 1 else "i8")
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([8], pa.int32()), pa.array([zlib.compress(total, 1)])],
            ["chunk", "salt", "width", "counts"],
        )

    schema = "chunk int, salt int, width int, counts binary"
    found = docs.select(text_col).mapInArrow(count, schema)
    found = found.groupBy("chunk", "salt").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema)
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    # A chunk is small: a few tasks give them all, each in a job of its own.
    for row in found.coalesce(4).toLocalIterator():
        counts[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.int64)
    return counts


def shingle_levels(counts):
    """0 for buckets as full as chance makes them, else one more than the logarithm of what stands out."""
    usual = float(np.median(counts))
    excess = counts - usual
    out = np.zeros(len(counts), dtype=np.uint8)
    high = excess > 4 * max(1.0, usual) ** 0.5
    out[high] = 1 + np.log2(excess[high]).astype(np.uint8)
    return out


def prefixes(docs, level, percent, words, id_col, text_col):
    """Per document the size and digest of its set, and its prefix: usual and heavy shingles in global order."""
    heavy_level = 1 + int(np.log2(HEAVY_ROWS))
    shared = docs.sparkSession.sparkContext.broadcast(level)
    id_type = docs.schema[id_col].dataType

    def describe(batches):
        level = shared.value
        for batch in batches:
            sizes, first, second, usual, heavy = [], [], [], [], []
            for values in shingle_sets(batch.column(1), words):
                n = len(values)
                sizes.append(n)
                first.append(int(mixed(values).sum(dtype=np.uint64)) - (1 << 63))
                second.append(int(mixed(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) - (1 << 63))
                length = n - -(-percent * n // 100) + 1 if n else 0
                rank = level[_bucket(values)]
                if rank.any():
                    order = np.argsort(rank, kind="stable")[:length]
                    values, rank = values[order], rank[order]
                    cut = int((rank < heavy_level).sum())
                else:
                    cut = length
                usual.append(values[:cut].view(np.int64))
                heavy.append(values[cut:length].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(first, pa.int64()),
                    pa.array(second, pa.int64()),
                    _lists(usual),
                    _lists(heavy),
                ],
                ["doc", *_CLASS, "usual", "heavy"],
            )

    schema = T.StructType(
        [T.StructField("doc", id_type)]
        + [T.StructField(n, T.LongType()) for n in _CLASS]
        + [T.StructField(n, T.ArrayType(T.LongType())) for n in ("usual", "heavy")]
    )
    return docs.select(id_col, text_col).mapInArrow(describe, schema)


def _lists(arrays):
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def _partners(rows, percent, differ):
    """Per row the earlier rows of its shingle that reach the threshold if this is the first one they share.

    Only for shingles of at most FEW_ROWS rows, and for rows that are not equal in the column `differ`.
    """
    columns = ["doc", "n_shingles", "pos", differ]
    ordered = Window.partitionBy("token").orderBy("n_shingles", "doc").rowsBetween(1 - FEW_ROWS, -1)

    def reaches(x):
        least = F.ceil(F.lit(percent) * (x["n_shingles"] + F.col("n_shingles")) / (100 + percent))
        fits = (x["n_shingles"] - x["pos"] >= least) & (F.col("n_shingles") - F.col("pos") >= least)
        return fits & (x[differ] != F.col(differ))

    few = rows.filter(F.col("rows") <= FEW_ROWS)
    few = few.withColumn("earlier", F.collect_list(F.struct(*columns)).over(ordered))
    return few.select("doc", F.filter("earlier", reaches).alias("partners")).filter(F.size("partners") > 0)


class _Forest:
    """Connected documents of one task: which shingles tie together, with loops over what is not connected yet."""

    def __init__(self, percent, few):
        self.percent, self.few = percent, few
        self.number, self.docs, self.parent, self.crowded = {}, [], [], set()

    def numbered(self, docs):
        """A number for each document of the column."""
        coded = docs.dictionary_encode()
        numbers = np.zeros(len(coded.dictionary), dtype=np.int64)
        for k, doc in enumerate(coded.dictionary.to_pylist()):
            numbers[k] = self.number.setdefault(doc, len(self.number))
            if numbers[k] == len(self.docs):
                self.docs.append(doc)
                self.parent.append(len(self.parent))
        return numbers[coded.indices.to_numpy(zero_copy_only=False)]

    def root(self, k):
        parent = self.parent
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    def add(self, docs, n, pos):
        """The rows of one shingle by size: documents that reach the threshold if it is the first one they share."""
        percent, roots = self.percent, [self.root(k) for k in docs.tolist()]
        many = len(docs) > self.few
        if many:
            self.crowded.update(docs.tolist())
        if len(set(roots)) == 1:
            return
        if many:
            # Each row joins the last one before it that can be the smaller partner of a pair, which shares its shingle
            # at the very start of its prefix. That chain connects whatever could be linked.
            can = pos <= n + (-2 * percent * n) // (100 + percent)
            before = np.maximum.accumulate(np.where(can, np.arange(len(n)), -1))
            before = np.concatenate([[-1], before[:-1]])
            near = (before >= 0) & (100 * n[before] >= percent * n)
            pairs = zip(np.flatnonzero(near).tolist(), before[near].tolist())
        else:
            room = n - pos
            least = -(-percent * (n[:, None] + n) // (100 + percent))
            label = np.array(roots)
            fits = (np.minimum(room[:, None], room) >= least) & (label[:, None] != label)
            pairs = zip(*(x.tolist() for x in np.nonzero(np.triu(fits)))) if fits.any() else ()
        for i, j in pairs:
            a, b = self.root(roots[i]), self.root(roots[j])
            if a != b:
                self.parent[max(a, b)] = min(a, b)

    def edges(self, id_arrow):
        """(a, b) from each connected document to the first of its tree, (a, null) for each in a shingle of many rows."""
        tied = [(k, self.root(k)) for k in range(len(self.docs)) if self.parent[k] != k]
        ends = [self.docs[k] for k, _ in tied] + [self.docs[k] for k in self.crowded]
        others = [self.docs[r] for _, r in tied] + [None] * len(self.crowded)
        return pa.RecordBatch.from_arrays([pa.array(ends, id_arrow), pa.array(others, id_arrow)], ["a", "b"])


def _tied(shared, percent):
    """Edges that connect all partners of all shingles, found by tasks that each hold whole shingles (see _Forest.edges)."""
    id_type = shared.schema["doc"].dataType
    id_arrow, few = to_arrow_type(id_type), FEW_ROWS

    def tie(batches):
        forest, held = _Forest(percent, few), None
        for batch in batches:
            rows = [batch.column(k).to_numpy() for k in range(3)] + [forest.numbered(batch.column(3))]
            rows = [np.concatenate(pair) for pair in zip(held, rows)] if held else rows
            starts = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]]).tolist() if len(rows[0]) else [0]
            for begin, end in zip(starts, starts[1:]):
                forest.add(rows[3][begin:end], rows[1][begin:end], rows[2][begin:end])
            held = [x[starts[-1] :] for x in rows]
        if held and len(held[0]):
            forest.add(held[3], held[1], held[2])
        if forest.docs:
            yield forest.edges(id_arrow)

    schema = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)])
    ordered = shared.select("token", "n_shingles", F.col("pos").cast("long").alias("pos"), "doc")
    return ordered.sortWithinPartitions("token", "n_shingles", "doc").mapInArrow(tie, schema)


def _shared(classes, *others):
    """(doc, n_shingles, others, pos, token, rows): usual shingles that two of the given prefixes hold at least."""
    usual = classes.select("doc", "n_shingles", *others, F.posexplode("usual").alias("pos", "token"))
    return usual.withColumn("rows", F.count("*").over(Window.partitionBy("token"))).filter("rows > 1")


def _clusters(classes, percent, parts):
    """Clusters and crowded documents.

    Clusters have (node, component): classes that could be linked, directly or through others, are in one component.
    """
    tied, _ = stored(_tied(_shared(classes), percent), "jaccard-tied")
    release_shuffles(classes.sparkSession)
    # Frequent shingles: the smallest document of each size class is a hub of that class and of the one below.
    heavy = classes.select(
        "doc",
        F.floor(F.log(F.col("n_shingles")) / F.log(F.lit(100 / percent))).cast("int").alias("class"),
        F.explode("heavy").alias("token"),
    )
    hubs = _small(heavy.groupBy("token", "class").agg(F.min("doc").alias("hub")), "shingle-hubs", parts)
    spokes = heavy.join(hubs, ["token", "class"]).select(F.col("doc").alias("a"), F.col("hub").alias("b"))
    upper = hubs.select("token", (F.col("class") - 1).alias("class"), F.col("hub").alias("a"))
    between = hubs.join(upper, ["token", "class"]).select("a", F.col("hub").alias("b"))
    edges = tied.filter(F.col("b").isNotNull()).union(spokes).union(between)
    clusters = _small(components(edges), "jaccard-clusters", parts)
    # Documents whose pairs may hide behind a shingle of many rows.
    crowded = heavy.select("doc").union(tied.filter(F.col("b").isNull()).select("a")).distinct()
    return clusters, _small(crowded, "jaccard-crowded", parts)


def _linked(units, percent, words):
    """Links found inside each unit; rows: unit, side (null: compare all), label, doc, text."""
    id_type = units.schema["doc"].dataType
    id_arrow = to_arrow_type(id_type)

    def found(rows):
        numbers = {}
        labels = [numbers.setdefault(label, len(numbers)) for _, label, _, _ in rows]
        side = None if rows[0][0] is None else [row[0] for row in rows]
        pairs = links([row[3] for row in rows], labels, percent, side)
        ends = [[rows[pair[k]][2] for pair in pairs] for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(e, id_arrow) for e in ends], ["a", "b"])

    def compare(batches):
        current, rows = None, []
        for batch in batches:
            columns = (batch.column(k).to_pylist() for k in range(4))
            for unit, side, label, doc, values in zip(*columns, shingle_sets(batch.column(4), words)):
                if unit != current:
                    if rows:
                        yield found(rows)
                    current, rows = unit, []
                rows.append((side, label, doc, values))
        if rows:
            yield found(rows)

    schema = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)])
    spread = units.select("unit", "side", "label", "doc", "text").repartition("unit")
    return stored(spread.sortWithinPartitions("unit", "side", "doc").mapInArrow(compare, schema), "jaccard-links")[0]


def _held(rows, others, columns):
    """Rows that may have an equal one among others in the columns, by a filter of fixed size: whether they have."""
    spark = rows.sparkSession
    place = F.pmod(F.xxhash64(*columns), F.lit(1 << FILTER_BITS)).cast("int")
    known = np.zeros(1 << FILTER_BITS, dtype=bool)
    known[others.select(place.alias("place")).distinct().coalesce(CHUNKS).toArrow()["place"].to_numpy()] = True
    shared = spark.sparkContext.broadcast(known)

    @F.arrow_udf(T.BooleanType())
    def held(places: pa.Array) -> pa.Array:
        return pa.array(shared.value[places.to_numpy(zero_copy_only=False)])

    return held(place)


def _meet(rows, nodes):
    """The join by document, which shuffles few other rows."""
    return rows.filter(_held(rows, nodes, ["doc"])).join(nodes, "doc")


def _texts(docs, nodes, id_col, text_col):
    """Nodes with their text."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).filter(F.col("doc").isNotNull())
    return _meet(rows, nodes)


def _blocked(nodes, unit_sets):
    """Nodes with their block: size classes of about a tenth, cut by hash to bounded blocks."""
    sized = nodes.withColumn("class", F.floor(F.log("n") / F.log(F.lit(1.1))).cast("int"))
    counts = sized.groupBy("cluster", "class").agg(F.count("*").alias("rows"), F.sum("n").alias("total"))
    cuts = F.greatest(F.ceil(F.col("rows") / unit_sets), F.ceil(F.col("total") / UNIT_SHINGLES))
    sized = sized.join(counts.select("cluster", "class", cuts.alias("cuts")), ["cluster", "class"])
    part = F.pmod(F.xxhash64("doc"), F.col("cuts"))
    return sized.withColumn("block", F.concat_ws(":", "class", part)).drop("class", "cuts")


def _labels(nodes, found):
    """Nodes with the smallest document they are linked to so far."""
    classes = components(found).select(F.col("node").alias("doc"), F.col("component").alias("label"))
    joined = nodes.join(classes, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    return stored(joined, "jaccard-labels")[0]


def _signatures(members, words):
    """Per text of a node its number of shingles and a bitmap of them, with four to eight bits a shingle."""
    schema = T.StructType([members.schema["doc"], T.StructField("n", T.LongType()), T.StructField("bitmap", T.BinaryType())])

    def sign(batches):
        for batch in batches:
            sizes, bitmaps = [], []
            for values in shingle_sets(batch.column(1), words):
                bits = np.zeros(1 << max(8, (4 * len(values)).bit_length()), dtype=bool)
                bits[(values & np.uint64(len(bits) - 1)).astype(np.int64)] = True
                sizes.append(len(values))
                bitmaps.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(bitmaps, pa.binary())], schema.names)

    return stored(members.select("doc", "text").mapInArrow(sign, schema), "jaccard-signatures")[0]


def most_overlap(n, bitmap, other_n, other_bitmap):
    """A bound of what two sets share: a bit that only one of them has is a shingle that only it has.

    The longer bitmap is folded to the length of the shorter one, as places are the last bits of the hashes.
    """
    while len(bitmap) > len(other_bitmap):
        half = len(bitmap) // 2
        bitmap = (int.from_bytes(bitmap[:half], "little") | int.from_bytes(bitmap[half:], "little")).to_bytes(half, "little")
    if len(bitmap) < len(other_bitmap):
        return most_overlap(other_n, other_bitmap, n, bitmap)
    one, other = int.from_bytes(bitmap, "little"), int.from_bytes(other_bitmap, "little")
    both = (one & other).bit_count()
    return min(n - one.bit_count(), other_n - other.bit_count()) + both


def _possible(near, members, percent, words):
    """Candidate pairs (a, b) whose bitmaps leave room for the overlap: bitmaps travel to each pair, texts do not."""
    signed = _signatures(members, words)

    @F.arrow_udf(T.BooleanType())
    def may_link(n: pa.Array, bitmap: pa.Array, other_n: pa.Array, other: pa.Array) -> pa.Array:
        rows = zip(*(column.to_pylist() for column in (n, bitmap, other_n, other)))
        return pa.array([(100 + percent) * most_overlap(i, x, j, y) >= percent * (i + j) for i, x, j, y in rows], pa.bool_())

    first = signed.select(F.col("doc").alias("a"), F.col("n").alias("n1"), F.col("bitmap").alias("bitmap1"))
    second = signed.select(F.col("doc").alias("b"), F.col("n").alias("n2"), F.col("bitmap").alias("bitmap2"))
    near = near.join(first, "a").join(second, "b").filter(100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2"))
    return stored(near.filter(may_link("n1", "bitmap1", "n2", "bitmap2")).select("a", "b").distinct(), "jaccard-possible")[0]


def _across_blocks(nodes, members, found, classes, crowded, percent, words, unit_sets):
    """Links of the clusters of several blocks.

    First between one document per class found so far. Then between documents of different classes: those that
    share a shingle of few rows by pairs, a document with its partners, and crowded ones by pairs of mixed blocks.
    """
    alone = F.lit(None).cast("int").alias("side")
    labelled = _labels(nodes, found)
    heads = labelled.filter(F.col("doc") == F.col("label")).drop("block")
    one = heads.groupBy("cluster").agg((F.count("*") <= unit_sets).alias("one"))
    heads = _blocked(heads, unit_sets).join(one, "cluster")
    unit = F.concat_ws("|", "cluster", F.when(F.col("one"), F.lit("")).otherwise(F.col("block")))
    heads = heads.select("doc", "label", unit.alias("unit"), alone)
    found = found.union(_linked(_meet(members, heads), percent, words))
    release_shuffles(nodes.sparkSession)
    labelled = _labels(nodes, found)
    # Labels join whole prefixes. Partners are of one cluster, so that no others' shingles are needed.
    near = _partners(_shared(_meet(classes, labelled.select("doc", "label")), "label"), percent, "label")
    near = near.select(F.col("doc").alias("a"), F.explode("partners.doc").alias("b")).distinct()
    near = _possible(near, members, percent, words)
    # A document with very many partners meets them in parts.
    parts = near.groupBy("a").agg(F.ceil(F.count("*") / unit_sets).alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.col("parts"))
    near = near.join(parts, "a").select("a", "b", F.concat_ws("|", "a", part).alias("unit"))
    near, _ = stored(near, "jaccard-pairs")
    sides = near.select("unit", F.lit(0).alias("side"), F.col("a").alias("doc")).distinct()
    sides = sides.union(near.select("unit", F.lit(1), "b")).join(labelled.select("doc", "label"), "doc")
    found = found.union(_linked(_meet(members, sides), percent, words))
    release_shuffles(nodes.sparkSession)
    labelled = labelled.join(crowded, "doc", "left_semi")
    if labelled.isEmpty():
        return found
    blocks = labelled.groupBy("cluster", "block").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    blocks, _ = stored(blocks, "jaccard-blocks")
    other = blocks.select("cluster", *[F.col(c).alias(f"{c}2") for c in ("block", "least", "most", "low", "high")])
    differ = (F.least("low", "low2") != F.greatest("high", "high2")) & (F.col("block") < F.col("block2"))
    fits = (100 * F.col("most") >= percent * F.col("least2")) & (100 * F.col("most2") >= percent * F.col("least"))
    pairs = blocks.join(other, "cluster").filter(differ & fits)
    both = F.posexplode(F.array("block", "block2")).alias("side", "block")
    pairs = pairs.select("cluster", F.concat_ws("|", "cluster", "block", "block2").alias("unit"), both)
    units = labelled.select("doc", "label", "cluster", "block").join(pairs, ["cluster", "block"]).drop("cluster", "block")
    return found.union(_linked(_meet(members, units), percent, words))


def join(docs, percent=PERCENT, words=WORDS, id_col="doc_id", text_col="text", unit_sets=UNIT_SETS):
    """(id, n_shingles, component_id, s1, s2) per row: set size, smallest id reachable by links, digest of the set."""
    spark = docs.sparkSession
    level = shingle_levels(bucket_counts(docs, text_col, words))
    sets, _ = stored(prefixes(docs, level, percent, words, id_col, text_col), "jaccard-sets")
    parts = max(LEAST_PARTS, -(-sets.count() // PART_ROWS))
    filled = sets.filter((F.col("n_shingles") > 0) & F.col("doc").isNotNull())
    heads = filled.groupBy(*_CLASS).agg(F.min("doc").alias("head"), F.count("*").alias("copies"))
    heads = _small(heads, "jaccard-classes", parts)
    # Copies are few next to all sets: a filter finds them, so that other prefixes are not shuffled to find their class.
    copies = filled.select("doc", *_CLASS).join(heads.filter("copies > 1").drop("copies"), [*_CLASS]).filter(F.col("doc") != F.col("head"))
    copies = _small(copies.distinct(), "jaccard-copies", parts)
    may_be_copy = _held(filled, copies, ["doc", *_CLASS])
    classes = filled.filter(may_be_copy).join(copies, ["doc", *_CLASS], "left_anti").unionByName(filled.filter(~may_be_copy))
    classes = classes.select("doc", "n_shingles", "usual", "heavy")
    release_shuffles(spark)
    clusters, crowded = _clusters(classes, percent, parts)
    release_shuffles(spark)
    # A document with several texts is one node: its sets are linked through its id.
    nodes = heads.groupBy(F.col("head").alias("doc")).agg(F.max("n_shingles").alias("n"))
    nodes = nodes.join(clusters.select(F.col("node").alias("doc"), F.col("component").alias("cluster")), "doc")
    nodes = _small(nodes, "jaccard-nodes", parts)
    sizes = nodes.groupBy("cluster").agg(((F.count("*") > unit_sets) | (F.sum("n") > UNIT_SHINGLES)).alias("large"))
    sizes = _small(sizes, "jaccard-sizes", parts)
    nodes = nodes.join(sizes, "cluster")
    small = nodes.filter("not large").withColumn("block", F.lit(""))
    nodes = small.unionByName(_blocked(nodes.filter("large"), unit_sets))
    nodes, _ = stored(nodes.coalesce(parts), "jaccard-nodes", ["large"])
    unit = F.concat_ws("|", "cluster", "block")
    members, _ = stored(_texts(docs, nodes.select("doc", "large", unit.alias("unit")), id_col, text_col), "jaccard-texts", ["large"])
    units = members.withColumns({"side": F.lit(None).cast("int"), "label": F.col("doc")})
    release_shuffles(spark)
    found = _linked(units, percent, words)
    release_shuffles(spark)
    large = nodes.filter("large").drop("large")
    if not large.isEmpty():
        members = members.filter("large").select("doc", "text")
        found = _across_blocks(large, members, found, classes, crowded, percent, words, unit_sets)
    same = copies.select(F.col("head").alias("a"), F.col("doc").alias("b"))
    classes = _small(components(found.union(same)), "jaccard-components", parts)
    classes = classes.select(F.col("node").alias("doc"), "component")
    joined = sets.select("doc", *_CLASS).join(classes, "doc", "left")
    return joined.select(
        F.col("doc").alias(id_col),
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc")).otherwise(F.col("doc")).alias("component_id"),
        "s1",
        "s2",
    )


def report(docs, **options):
    return join(docs, **options).select("doc_id", "n_shingles", "component_id")


def keep_one(docs, id_col="doc_id", text_col="text", **options):
    """Of each class of texts the row with the smallest id stays; rows without words or id all stay.

    Classes are of rows: where an id comes with several texts, only those go that have a row with a smaller id in
    their class, and of equal rows one stays.
    """
    column = F.col(id_col)
    repeated = docs.filter(column.isNotNull()).groupBy(column.alias("id")).count().filter("count > 1")
    if repeated.isEmpty():
        found = join(docs, id_col=id_col, text_col=text_col, **options)
        lost = found.filter(column != F.col("component_id")).select(column.alias("__lost")).distinct()
        return docs.join(lost, column == F.col("__lost"), "left_anti")
    rows, _ = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "jaccard-rows")
    found = join(rows.filter(column.isNotNull()), id_col="__row", text_col=text_col, **options).filter("n_shingles > 0")
    found = found.select("__row", F.col("component_id").alias("__class")).join(rows.select("__row", column.alias("__id")), "__row")
    first = F.min(F.struct("__id", "__row"))["__row"].alias("__first")
    lost = found.join(found.groupBy("__class").agg(first), "__class").filter(F.col("__row") != F.col("__first")).select("__row")
    return rows.join(lost, "__row", "left_anti").drop("__row")
