"""Approximate nearest neighbours by collision counting over query-centred windows.

Every vector is projected on `projections` random lines, and each line keeps its values sorted. A query opens a
window around its own value on every line; a vector that falls into enough windows is verified by its inner
product. Windows are widened step by step (virtual rehashing: the same sorted lines serve every width) until the
k-th best verified vector lies so near that any vector at its distance would have reached the collision threshold
with the wanted confidence.

All rows are indexed, in blocks of bounded size that each hold their own sorted lines; every block meets the
queries in slices, and the best of each block are merged per query. No vector pair becomes a row: a block emits
at most k rows per query. The widening rule depends only on distances, so results do not change in kind with
the number of rows or blocks.

Edge cases: vectors that are null, of zero length, or hold null or non-finite values take no part, nor do vectors
without an id; vectors of another length than the query's are no candidates; fewer than k candidates give all of
them; ties go to the smaller id; rows sharing an id are separate candidates.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import stored

PROJECTIONS = 16
#: Chance that a neighbour reaches the collision threshold when a query stops.
CONFIDENCE = 0.97
#: Width of the first windows and their growth, as a share of the distance between unit vectors.
FIRST_WIDTH, GROWTH = 0.9, 1.2
BLOCK_ROWS = 8192
QUERY_SLICE = 1024
_ROWS = "vec_id long, embedding array<double>"


def usable(vectors, id_col="vec_id", vector_col="embedding"):
    """Ids and vectors that take part, as doubles."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col(id_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("embedding"))


def threshold_table(projections, confidence):
    """Per collision threshold the least chance per line at which a vector reaches it with the confidence."""
    out = np.zeros(projections + 1)
    for least in range(1, projections + 1):
        low, high = 0.0, 1.0
        for _ in range(40):
            p = (low + high) / 2
            reached = sum(math.comb(projections, k) * p**k * (1 - p) ** (projections - k) for k in range(least, projections + 1))
            low, high = (low, p) if reached >= confidence else (p, high)
        out[least] = high
    return out


def _lines(dimension, projections, seed):
    return np.random.default_rng([seed, dimension]).normal(size=(projections, dimension))


class Block:
    """Vectors with their sorted lines, and the place of every vector on each line."""

    def __init__(self, ids, vectors, lines):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        self.rough = self.vectors.astype(np.float32)
        self.longest = float(np.sqrt((self.vectors**2).sum(axis=1).max()))
        values = self.vectors @ lines.T
        self.sorted = list(np.ascontiguousarray(np.sort(values, axis=0).T))
        places = np.argsort(np.argsort(values, axis=0, kind="stable"), axis=0, kind="stable")
        # BLOCK_ROWS fits 16 bits, and a window of places is one unsigned comparison.
        self.places = list(np.ascontiguousarray(places.T.astype(np.uint16)))

    def collisions(self, values, width):
        """In how many query-centred windows each vector lies."""
        counts = np.zeros(len(self.ids), dtype=np.uint8)
        reach = np.array([-width, width])
        for row, places, value in zip(self.sorted, self.places, values):
            lo, hi = row.searchsorted(value + reach).tolist()
            if hi - lo == len(counts):
                counts += 1
            elif hi > lo:
                counts += (places - np.uint16(lo)) < np.uint16(hi - lo)
        return counts

    def _scores(self, rows, query):
        if 8 * len(rows) > len(self.ids):
            return (self.rough @ query)[rows]
        return self.rough[rows] @ query

    def nearest(self, query_id, query, values, k, least, chance):
        """(ids, scores) of the k best: windows widen until the k-th verified one could not have been missed."""
        other = self.ids != query_id
        total = int(np.count_nonzero(other))
        rough = query.astype(np.float32)
        norm = float(np.sqrt(query @ query))
        # Windows are as wide as distances: both scale with the lengths of the vectors.
        width = FIRST_WIDTH * norm
        while True:
            everything = width > 40 * (norm + self.longest)
            best = np.flatnonzero(other if everything else (self.collisions(values, width) >= least) & other)
            found = len(best)
            if found >= min(k, total):
                score = self._scores(best, rough)
                if found == total:
                    break
                cut = float(np.partition(score, found - k)[found - k])
                # A vector with the k-th score is at most so far away, whatever its length up to the longest.
                far = max(self.longest**2 + norm**2 - 2 * cut, 0.0) ** 0.5
                if far == 0 or math.erf(width / (far * math.sqrt(2))) >= chance:
                    break
            width *= GROWTH
        if found > k:
            cut = float(np.partition(score, found - k)[found - k])
            best = best[score >= cut - 1e-5 * norm * self.longest]
        # Summed in the order of the components, so equal vectors get equal scores on every block.
        exact = np.zeros(len(best))
        for column, q in zip(self.vectors[best].T, query):
            exact += column * q
        order = np.lexsort((self.ids[best], -exact))[:k]
        return self.ids[best][order], exact[order]


def _matrix(column):
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(), lists.value_lengths().to_numpy()


def _meet(k, projections, confidence, least, seed):
    table = threshold_table(projections, confidence)

    def run(base: pa.Table, asked: pa.Table) -> pa.Table:
        blocks = {}
        if len(base):
            base = base.combine_chunks()
            flat, lengths = _matrix(base.column("embedding"))
            ids = base.column("vec_id").to_numpy()
            starts = np.cumsum(lengths) - lengths
            for dimension in np.unique(lengths):
                rows = np.flatnonzero(lengths == dimension)
                vectors = flat[(starts[rows][:, None] + np.arange(dimension)).ravel()].reshape(len(rows), dimension)
                lines = _lines(int(dimension), projections, seed)
                blocks[int(dimension)] = (Block(ids[rows], vectors, lines), lines)
        out = ([], [], [])
        if len(asked):
            asked = asked.combine_chunks()
            flat, lengths = _matrix(asked.column("embedding"))
            ends = np.cumsum(lengths)
            for query_id, end, dimension in zip(asked.column("vec_id").to_pylist(), ends.tolist(), lengths.tolist()):
                if dimension not in blocks:
                    continue
                block, lines = blocks[dimension]
                query = flat[end - dimension : end]
                ids, scores = block.nearest(query_id, query, lines @ query, k, least, table[least])
                out[0].append(np.full(len(ids), query_id))
                out[1].append(ids)
                out[2].append(scores)
        columns = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table(
            {
                "query_id": pa.array(columns[0].astype(np.int64)),
                "vec_id": pa.array(columns[1].astype(np.int64)),
                "score": pa.array(columns[2], pa.float64()),
            }
        )

    return run


def search(vectors, queries, k=20, projections=PROJECTIONS, confidence=CONFIDENCE, least=None, seed=3, block_rows=BLOCK_ROWS):
    """The k nearest found rows of `vectors` per row of `queries` (both as made by `usable`), with rank and score."""
    least = least or round(0.6 * projections)
    spark = vectors.sparkSession
    base, _ = stored(vectors, "vectors")
    asked, _ = stored(queries, "queries")
    blocks = max(1, -(-base.count() // block_rows))
    slices = max(1, -(-asked.count() // QUERY_SLICE))
    block = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(slices)).cast("int")
    # Both sides of a meeting are bounded; each is sent once per slice or block of the other.
    base = base.withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    asked = asked.withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = base.groupBy("block", "part").cogroup(asked.groupBy("block", "part"))
    found = met.applyInArrow(_meet(k, projections, confidence, least, seed), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(embeddings, **options):
    """Rows whose id is divisible by 20 as queries against all rows."""
    rows = usable(embeddings)
    return search(rows, rows.filter(F.col("vec_id") % 20 == 0), **options)
