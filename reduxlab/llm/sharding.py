"""Balanced label propagation: documents into shards of equal row counts, linked documents together.

Documents with equal texts are linked. Every linked document starts in a shard chosen by hash. In each round a
document moves towards the shard that holds most of its group, if that shard still has room; per target only
as many movers are let in as its quota holds, counting those that leave it. When nothing moves any more, or after
`ROUNDS` rounds, rows beyond a shard's quota and all unlinked documents fill the free places one by one, so counts
differ by at most one (law `rows`). A group larger than a shard gathers in one more shard per round; what is left
of it after the last round stays in the shards where the hash put it.

The state is one small row per linked document; only the numbers of movers between shards reach the driver.

Edge cases: a null text has 0 bytes, checksum 0 and no links; empty texts are linked like any equal texts;
repeated rows are placed one by one and are interchangeable; fewer documents than shards leave shards empty.
"""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import drop_path, stored
from .ranks import ranked

SHARDS = 24
ROUNDS = 8
#: Bytes that a row takes besides its text.
ROW_BYTES = 8
_GROUP = ["g1", "g2"]


def described(docs, id_col="doc_id", text_col="text"):
    """Id, size, checksum and the 128-bit group of equal texts of every document."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("crc"),
        F.when(text.isNotNull(), F.xxhash64(F.lit(1), text)).alias("g1"),
        F.when(text.isNotNull(), F.xxhash64(F.lit(2), text)).alias("g2"),
    )


def _quotas(total, shards):
    return np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)


def _let_in(loads, movers, quotas):
    """The share of movers each shard takes, so that those it keeps and takes fit its quota."""
    share = np.ones(len(quotas))
    for _ in range(10):
        leaving = (movers * share[None, :]).sum(axis=1)
        room = np.maximum(quotas - loads + leaving, 0)
        share = np.minimum(1.0, room / np.maximum(movers.sum(axis=0), 1))
    return share


def _literal(values):
    return F.array(*[F.lit(float(v)) for v in values])


def _round(state, number, open_shards, quotas):
    """(new state, movers): one step of label propagation under quotas."""
    shards = len(quotas)
    held = state.groupBy(*_GROUP, "shard").agg(F.count("*").alias("n"))
    weight = F.struct("n", F.xxhash64(*_GROUP, "shard").alias("tie"), "shard")
    is_open = F.col("shard").isin([int(s) for s in np.flatnonzero(open_shards)])
    # At most one row per shard and group.
    best = F.max(F.when(is_open, weight)).over(Window.partitionBy(*_GROUP))
    moves = held.withColumn("own", weight).withColumn("best", best)
    moves = moves.select(
        *_GROUP, "shard", "n", F.when(F.col("best") > F.col("own"), F.col("best.shard")).alias("target")
    )
    moves, moves_path = stored(moves, "shard-moves")
    loads, movers = np.zeros(shards), np.zeros((shards, shards))
    for row in moves.groupBy("shard", "target").agg(F.sum("n").alias("n")).collect():
        loads[row["shard"]] += row["n"]
        if row["target"] is not None:
            movers[row["shard"], row["target"]] += row["n"]
    share = _let_in(loads, movers, quotas)
    chance = F.pmod(F.xxhash64("doc", "crc", "size", F.lit(number)), F.lit(1 << 20)) / float(1 << 20)
    joined = state.join(moves.drop("n"), [*_GROUP, "shard"])
    goes = F.col("target").isNotNull() & (chance < F.element_at(_literal(share), F.coalesce("target", F.lit(0)) + 1))
    moved = joined.withColumn("shard", F.when(goes, F.col("target")).otherwise(F.col("shard"))).drop("target")
    moved, path = stored(moved.select(*state.columns), "shard-state")
    drop_path(state.sparkSession, moves_path)
    after = loads + (movers * share).sum(axis=0) - (movers * share).sum(axis=1)
    return moved, path, int(movers.sum()), after < 0.995 * quotas


def propagated(linked, quotas, rounds=ROUNDS):
    """Linked documents with their shard after label propagation."""
    shards = len(quotas)
    state = linked.withColumn("shard", F.pmod(F.xxhash64("doc", "crc", "size"), F.lit(shards)).cast("int"))
    state, path = stored(state, "shard-state")
    open_shards = quotas > 0
    for number in range(rounds):
        if not open_shards.any():
            break
        state, new, movers, open_shards = _round(state, number, open_shards, quotas)
        drop_path(linked.sparkSession, path)
        path = new
        if not movers:
            break
    return state


def shard(docs, shards=SHARDS, rounds=ROUNDS, id_col="doc_id", text_col="text"):
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = described(docs, id_col, text_col)
    groups = rows.filter("g1 is not null").groupBy(*_GROUP).agg(F.count("*").alias("__n")).filter("__n > 1")
    # Written first, so that the join deals both sides anew and a hot group can be split.
    groups, _ = stored(groups, "shard-groups")
    marked = rows.join(groups, _GROUP, "left").withColumn("linked", F.col("__n").isNotNull()).drop("__n")
    marked, _ = stored(marked, "shard-rows", ["linked"])
    total = marked.count()
    quotas = _quotas(total, shards)
    linked = marked.filter("linked").drop("linked")
    single = marked.filter("not linked").drop("linked")
    identity = ["doc", "crc", "size"]
    state = ranked(propagated(linked, quotas, rounds), ["shard"], identity, "slot", total)
    quota = F.element_at(_literal(quotas), F.col("shard") + 1)
    state, _ = stored(state.withColumn("kept", F.col("slot") < quota), "shard-places", ["kept"])
    kept = state.filter("kept").drop("kept")
    used = np.zeros(shards, dtype=np.int64)
    for row in kept.groupBy("shard").count().collect():
        used[row["shard"]] = row["count"]
    # Free places in one line: shard s takes the fillers from first[s] on.
    first = np.concatenate([[0], np.cumsum(quotas - used)])
    fillers = single.select(*identity).unionByName(state.filter("not kept").select(*identity)).withColumn("one", F.lit(0))
    fillers = ranked(fillers, ["one"], identity, "place", total)
    chosen = F.lit(0)
    for s in range(1, shards):
        chosen = F.when(F.col("place") >= int(first[s]), F.lit(s)).otherwise(chosen)
    fillers = fillers.withColumn("shard", chosen.cast("int"))
    start = F.element_at(F.array(*[F.lit(int(u - f)) for u, f in zip(used, first)]), F.col("shard") + 1)
    fillers = fillers.withColumn("slot", (F.col("place") + start).cast("long"))
    columns = [*identity, "shard", "slot"]
    placed = kept.select(*columns).unionByName(fillers.select(*columns))
    return placed.select(
        F.col("doc").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
