"""Connected components by alternating star contractions, with joins and grouped minima only.

Every pass links each node to the smallest node it knows, first for the larger neighbours and then for the
smaller ones, until every component is a star; the number of passes grows with the logarithm of the size of the largest
component. Passes are written to shared scratch. No neighbour list is ever gathered: a hub costs one grouped
minimum, which is combined before the shuffle, and a join that adaptive execution can split.

Before the passes and between their halves each task replaces the links it has read by stars of its own, in runs of
bounded size, so that long chains do not take a pass for each doubling; few links are written by few tasks.
"""

import pyarrow as pa
from pyspark.sql import functions as F

from ..session import drop_path, stored

#: Nodes that one task holds at a time, and links that are worth a task.
RUN_NODES, TASK_LINKS = 200_000, 20_000


def _stars(batches):
    """The links of a task as links from each node to the smallest node that the same run connects it to."""
    parent, schema = {}, None

    def root(node):
        while parent[node] != node:
            parent[node] = node = parent[parent[node]]
        return node

    def emit():
        ends = [(node, root(node)) for node in parent]
        ends = [end for end in ends if end[0] != end[1]]
        return pa.RecordBatch.from_arrays([pa.array([end[k] for end in ends], schema.field(k).type) for k in (0, 1)], names=schema.names)

    for batch in batches:
        schema = batch.schema
        for node, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(node, node)
            parent.setdefault(other, other)
            a, b = root(node), root(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) >= RUN_NODES:
            yield emit()
            parent.clear()
    if parent:
        yield emit()


def _star(links, parts):
    """For rows (node, other): the pair (other, smallest of node and its others)."""
    least, path = stored(links.groupBy("node").agg(F.min("other").alias("least")).coalesce(parts), "least")
    return links.join(least, "node").withColumn("least", F.least("node", "least")), path


def _large_star(links, parts):
    both = links.union(links.select(F.col("other").alias("node"), F.col("node").alias("other")))
    starred, path = _star(both, parts)
    out = starred.filter(F.col("other") > F.col("node")).select(F.col("other").alias("node"), F.col("least").alias("other"))
    return out.filter(F.col("node") != F.col("other")), path


def _small_star(links, parts):
    down = links.select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other"))
    starred, path = _star(down, parts)
    out = starred.select(F.col("other").alias("node"), F.col("least").alias("other"))
    out = out.union(starred.select("node", F.col("least").alias("other")))
    return out.filter(F.col("node") != F.col("other")).distinct(), path


def _resolved(links, parts):
    """Whether every node has one link, to a node without links: then that is the smallest of its component."""
    ends = links.select("node", F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.union(links.select("other", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).coalesce(parts)
    return ends.filter("down > 1 or down = 1 and up = 1").isEmpty()


def components(edges, left="a", right="b"):
    """(node, component) for every node of the edges; the component is its smallest node.

    Edges with a null end and loops are ignored. The result lies in shared scratch.
    """
    links = edges.select(F.col(left).alias("node"), F.col(right).alias("other"))
    links = links.filter(F.col("node") != F.col("other"))
    links, path = stored(links.mapInArrow(_stars, links.schema).distinct(), "links")
    parts = -(-links.count() // TASK_LINKS) or 1
    while not _resolved(links, parts):
        large, least = _large_star(links, parts)
        large, large_path = stored(large.coalesce(parts).mapInArrow(_stars, links.schema), "links")
        drop_path(edges.sparkSession, least)
        small, least = _small_star(large, parts)
        small, small_path = stored(small.coalesce(parts), "links")
        for old in (least, large_path, path):
            drop_path(edges.sparkSession, old)
        links, path = small, small_path
    found = links.select("node", F.col("other").alias("component"))
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())
