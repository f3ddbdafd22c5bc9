"""Exact-size sampling and splitting without sorting the table.

A row's place in its group is its rank by (draw key, id). Ranks are never materialised. Counts
per (group, key prefix) show which prefix holds the wanted rank; a prefix with many rows is
counted again by longer prefixes; the rows of the last one are ranked, and the result is one
cutoff key per group. Assigning rows is then a comparison in the scan. A group holding most of
the table costs no more than any other, and only the id and group columns are read before the
final pass.
"""

from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import draw_key

# Counts fetched by one job, and so also the number of groups.
MAX_COUNTS = 1_000_000
# Rows of one prefix that a task may sort.
RANKED_ROWS = 1_000_000


@dataclass(frozen=True)
class Cutoff:
    """Rows of a group with (key, id) up to this one have rank <= the wanted rank."""

    key: str
    id: object


class RankCuts:
    """Finds, for each group, the row standing at a wanted rank of the seeded order."""

    def __init__(self, df, seed, group_col=None, id_col="id"):
        group = F.col(group_col) if group_col else F.lit(0)
        self.keyed = df.select(group.alias("g"), F.col(id_col).alias("id"), draw_key(seed, id_col).alias("key"))
        self.texts = {}
        # As many leading digits of the key as the number of groups allows.
        for self.digits in (2, 1, 0):
            self.counts = self._count(self.keyed, self.digits)
            if self.counts is not None:
                break
        else:
            raise ValueError(f"more than {MAX_COUNTS} groups: this column is not a class label")
        self.sizes = {}
        if any(g is None for g, _ in self.counts):
            raise ValueError(f"column {group_col} has null labels: drop or name them before sampling by label")
        for (g, _), n in self.counts.items():
            self.sizes[g] = self.sizes.get(g, 0) + n

    def _count(self, rows, digits, limit=None):
        """{(group, prefix): rows}, or None if there are too many of them."""
        limit = limit or MAX_COUNTS
        table = (
            rows.groupBy("g", F.substring("key", 1, digits).alias("prefix"))
            .agg(F.count("*").alias("n"))
            .withColumn("text", F.col("g").cast("string"))
            .limit(limit + 1)
            .toArrow()
        )
        if table.num_rows > limit:
            return None
        # Groups are matched by the text that Spark itself gives them.
        self.texts.update(zip(table["g"].to_pylist(), table["text"].to_pylist()))
        return dict(zip(zip(table["g"].to_pylist(), table["prefix"].to_pylist()), table["n"].to_pylist()))

    def _among(self, places, digits):
        """Rows in any of the (group, prefix) places."""
        place = F.concat_ws("|", F.substring("key", 1, digits), F.col("g").cast("string"))
        return self.keyed.filter(place.isin([f"{prefix}|{self.texts[g]}" for g, prefix in places]))

    def at(self, *wanted):
        """Every argument {group: rank} -> {group: Cutoff}; ranks below 1 give no cutoff."""
        pairs = sorted({(g, rank) for ranks in wanted for g, rank in ranks.items() if rank >= 1}, key=repr)
        found = self._find(pairs) if pairs else {}
        cuts = [{g: found[g, rank] for g, rank in ranks.items() if rank >= 1} for ranks in wanted]
        return cuts if len(cuts) > 1 else cuts[0]

    def _find(self, pairs):
        digits, counts = self.digits, self.counts
        nth = dict(zip(pairs, ((g, "", rank) for g, rank in pairs)))
        while True:
            nth = _descend(counts, nth)
            places = {(g, prefix) for g, prefix, _ in nth.values()}
            if max(counts[place] for place in places) <= RANKED_ROWS or digits == 32:
                break
            step = next(d for d in (3, 2, 1) if len(places) * 16**d <= MAX_COUNTS or d == 1)
            rows = self._among(places, digits)
            digits = min(32, digits + step)
            counts = self._count(rows, digits, len(places) * 16**step)
        window = W.partitionBy("g", "prefix").orderBy("key", "id")
        ranked = (
            self._among(places, digits)
            .withColumn("prefix", F.substring("key", 1, digits))
            .withColumn("place", F.row_number().over(window))
        )
        mark = F.concat_ws("|", "prefix", "place", F.col("g").cast("string"))
        marks = {f"{prefix}|{place}|{self.texts[g]}" for g, prefix, place in nth.values()}
        rows = ranked.filter(mark.isin(list(marks))).select("g", "prefix", "place", "key", "id").collect()
        by_place = {(row["g"], row["prefix"], row["place"]): Cutoff(row["key"], row["id"]) for row in rows}
        return {pair: by_place[place] for pair, place in nth.items()}


def _descend(counts, nth):
    """Move every (group, prefix, rank inside) to the longer prefix of `counts` that holds it."""
    inside = {}
    for (g, prefix), n in sorted(counts.items(), key=lambda item: item[0][1]):
        inside.setdefault(g, []).append((prefix, n))
    out = {}
    for pair, (g, prefix, rank) in nth.items():
        options = [(p, n) for p, n in inside[g] if p.startswith(prefix)]
        upto = list(accumulate(n for _, n in options))
        at = bisect_left(upto, rank)
        out[pair] = (g, options[at][0], rank - (upto[at - 1] if at else 0))
    return out


def _within(cut_key, cut_id, seed, id_col):
    key = draw_key(seed, id_col)
    return (key < cut_key) | ((key == cut_key) & (F.col(id_col) <= cut_id))


def subsample(df, max_rows, seed, id_col="id"):
    """Exactly `max_rows` rows without replacement; all rows if there are no more than that."""
    if max_rows is None:
        return df
    cuts = RankCuts(df, seed, id_col=id_col)
    if cuts.sizes.get(0, 0) <= max_rows:
        return df
    cut = cuts.at({0: max_rows}).get(0)
    if cut is None:
        return df.limit(0)
    return df.filter(_within(F.lit(cut.key), F.lit(cut.id), seed, id_col))


def _assign(df, seed, label_col, id_col, first, second, names):
    """Name rows by two cutoffs per group: up to the first, up to the second, beyond."""
    groups = sorted(set(first) | set(second), key=repr)
    schema = (
        f"g {dict(df.dtypes)[label_col] if label_col else 'int'}, "
        f"k1 string, i1 {dict(df.dtypes)[id_col]}, k2 string, i2 {dict(df.dtypes)[id_col]}"
    )
    rows = []
    for g in groups:
        a, b = first.get(g), second.get(g)
        rows.append((g, a and a.key, a and a.id, b and b.key, b and b.id))
    cuts = df.sparkSession.createDataFrame(rows, schema)
    # At most MAX_COUNTS rows, checked while counting the groups.
    marked = df.withColumn("g", F.col(label_col) if label_col else F.lit(0)).join(F.broadcast(cuts), "g", "left")
    first_part = F.coalesce(_within(F.col("k1"), F.col("i1"), seed, id_col), F.lit(False))
    second_part = F.coalesce(_within(F.col("k2"), F.col("i2"), seed, id_col), F.lit(False))
    split = F.when(first_part, names[0]).when(second_part, names[1]).otherwise(names[2])
    return marked.withColumn("split", split).drop("g", "k1", "i1", "k2", "i2")


def proportional_shares(sizes, draws):
    """Split `draws` over groups in proportion to size: floors, then largest remainders."""
    total = sum(sizes.values())
    shares = {g: n * draws // total for g, n in sizes.items()}
    missing = draws - sum(shares.values())
    by_remainder = sorted(sizes, key=lambda g: (-(sizes[g] * draws % total), g))
    for g in by_remainder[:missing]:
        shares[g] += 1
    return shares


def _side_sizes(n, train_size, test_size):
    test = None if test_size is None else (test_size if isinstance(test_size, int) else -int(-test_size * n // 1))
    train = None if train_size is None else (train_size if isinstance(train_size, int) else int(train_size * n))
    if test is None:
        test = n - train
    if train is None:
        train = n - test
    if train < 1 or test < 1 or train + test > n:
        raise ValueError(f"cannot draw {train} training and {test} test rows from {n}")
    return train, test


def split_table(df, train_size=None, test_size=0.2, seed=42, label_col="label", id_col="id"):
    """Add `split` in ('train', 'test'), stratified by label; rows wanted by neither side go.

    Falls back to an unstratified split when a class has a single row or a side has fewer rows
    than there are classes.
    """
    cuts = RankCuts(df, seed, label_col, id_col)
    sizes = cuts.sizes
    n = sum(sizes.values())
    train, test = _side_sizes(n, train_size, test_size)
    if min(sizes.values()) >= 2 and min(train, test) >= len(sizes):
        in_train = proportional_shares(sizes, train)
        in_test = proportional_shares({g: sizes[g] - in_train[g] for g in sizes}, test)
        first, second = cuts.at(in_train, {g: in_train[g] + in_test[g] for g in sizes})
    else:
        label_col = None
        first, second = RankCuts(df, seed, None, id_col).at({0: train}, {0: train + test})
    marked = _assign(df, seed, label_col, id_col, first, second, ("train", "test", "none"))
    return marked if train + test == n else marked.filter(F.col("split") != "none")


def sample_stratified(df, sample_size, seed=42, label_col="label", id_col="id"):
    """The test side of a stratified split of `sample_size` rows; all rows for None or if no more exist."""
    if sample_size is None or df.select(id_col).count() <= sample_size:
        return df
    split = split_table(df, None, sample_size, seed, label_col, id_col)
    return split.filter(F.col("split") == "test").drop("split")


def companion_rows(df, sampled, id_col="id"):
    """Rows of another table for the sampled ids."""
    return df.join(sampled.select(id_col), id_col, "left_semi")


def validation_split(df, fraction=0.1, seed=42, enabled=True, label_col="label", id_col="id"):
    """Add `part` in ('train', 'val'): a share of each class, singletons stay in training."""
    if not enabled or fraction <= 0:
        return df.withColumn("part", F.lit("train"))
    cuts = RankCuts(df, seed, label_col, id_col)
    # Python's round() takes halves to the even neighbour.
    first = cuts.at({g: min(max(1, round(n * fraction)), n - 1) for g, n in cuts.sizes.items() if n >= 2})
    kept = df.withColumnRenamed("split", "_split") if "split" in df.columns else df
    out = _assign(kept, seed, label_col, id_col, first, {}, ("val", "val", "train")).withColumnRenamed("split", "part")
    return out.withColumnRenamed("_split", "split") if "_split" in out.columns else out
