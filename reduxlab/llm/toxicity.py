"""Toxicity by a classifier chain: categories in sequence, each linear model seeing the earlier probabilities.

A text's features are its distinct words and word beginnings, hashed. For every category the features that tell
its labelled documents apart are selected, and a logistic model is fitted on them and on the log odds of the
earlier categories. Those log odds come from models that did not see the document: the labelled rows are cut into
folds, and selection and fit of a fold's model leave the fold out. A last model of all rows scores the corpus.
The decision threshold of a category is the best F1 over the out-of-fold probabilities.

The fit uses at most SAMPLE labelled rows, chosen by hash; selection counts and fits run in Spark tasks over that
bounded sample. Every document is scored on its whole text.

Edge cases: a null or empty text has no features and gets what the intercepts say; rows with a null label are not
learnt from; a category whose labels are all alike has its rate as probability and is never decided; repeated rows
are learnt and scored each; columns of the input named like the results are replaced.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .words import PUNCTUATION, slices

#: Labelled rows that are learnt from, at most.
SAMPLE = 20_000
FOLDS = 5
FEATURE_BITS = 20
#: Bytes of the word beginnings.
BEGINNINGS = (4, 5, 6)
#: Text whose features one task makes at a time.
SLICE_BYTES = 2 << 20
#: Features of one model, and the least difference (in standard errors) for one to be taken.
SELECTED, LEAST_Z = 1500, 6.0
#: Categories of the query, as SQL over the joined labels and documents, in the order of the chain.
CATEGORIES = (
    ("low_quality", "quality = 0"),
    ("toxic", "toxic = 1"),
    ("toxic_foreign", "toxic = 1 and coalesce(lang, '') <> 'en'"),
)


def features(column):
    """(row, feature) index pairs of a string column, sorted and without repeats, a run of rows at a time."""
    for row, hashes, _, _, offsets, beginnings in slices(column, PUNCTUATION, SLICE_BYTES, BEGINNINGS):
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        keys = [(doc << FEATURE_BITS) | (hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)]
        for number, values in enumerate(beginnings):
            long = values != 0
            index = ((values[long] + np.uint64(number + 1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FEATURE_BITS)
            keys.append((doc[long] << FEATURE_BITS) | index.astype(np.int64))
        yield row, len(offsets) - 1, np.concatenate(keys)


def _scores(column, weights, chosen):
    """Sums of the weights of each row's distinct features, one column per model."""
    out = np.zeros((len(column), weights.shape[1]))
    slot = np.full(1 << FEATURE_BITS, -1, dtype=np.int64)
    slot[chosen] = np.arange(len(chosen))
    for row, count, keys in features(column):
        keys = np.unique(keys[slot[keys & ((1 << FEATURE_BITS) - 1)] >= 0])
        doc, place = keys >> FEATURE_BITS, slot[keys & ((1 << FEATURE_BITS) - 1)]
        for k in range(weights.shape[1]):
            out[row : row + count, k] = np.bincount(doc, weights=weights[place, k], minlength=count)
    return out


def _sample(docs, labels, categories, size, id_col, text_col):
    """Labelled documents: fold, one 0/1 per category and the distinct features."""
    drawn = labels.orderBy(F.xxhash64(F.col(id_col), F.lit(11)), F.col(id_col)).limit(size)
    known = [c for c in drawn.columns if c != id_col]
    rows = docs.drop(*known).join(F.broadcast(drawn), id_col)
    flags = [F.expr(text).cast("int").alias(f"__y{k}") for k, (_, text) in enumerate(categories)]
    rows = rows.select(F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(FOLDS)).cast("int").alias("fold"), *flags, text_col)
    rows = rows.dropna(subset=[f"__y{k}" for k in range(len(categories))])
    target = F.array(*[F.col(f"__y{k}") for k in range(len(categories))])

    def described(batches):
        for batch in batches:
            found = []
            for _, count, keys in features(batch.column(2)):
                keys = np.unique(keys)
                cuts = np.searchsorted(keys >> FEATURE_BITS, np.arange(1, count))
                found += [(part & ((1 << FEATURE_BITS) - 1)).astype(np.int32) for part in np.split(keys, cuts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["fold", "y", "features"]
            )

    rows = rows.select("fold", target.alias("y"), text_col)
    return stored(rows.mapInArrow(described, "fold int, y array<int>, features array<int>"), "toxicity-sample")[0]


def _selected(sample, count):
    """Per model (a left-out fold, or -1 for none) and category the features that tell its documents apart."""

    def tally(batches):
        for batch in batches:
            fold, y = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist()).reshape(batch.num_rows, -1)
            lengths = batch.column(2).value_lengths().to_numpy()
            index = batch.column(2).flatten().to_numpy()
            keys = np.repeat(fold.astype(np.int64), lengths) << FEATURE_BITS | index
            keys, place = np.unique(keys, return_inverse=True)
            owner = np.repeat(np.arange(batch.num_rows), lengths)
            hits = [np.bincount(place, weights=y[owner, k], minlength=len(keys)).astype(np.int64) for k in range(count)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys >> FEATURE_BITS, pa.int64()),
                    pa.array(keys & ((1 << FEATURE_BITS) - 1), pa.int64()),
                    pa.array(np.bincount(place, minlength=len(keys)).astype(np.int64)),
                    *[pa.array(h) for h in hits],
                ],
                ["fold", "feature", "n", *[f"h{k}" for k in range(count)]],
            )

    schema = "fold long, feature long, n long, " + ", ".join(f"h{k} long" for k in range(count))
    counted = sample.mapInArrow(tally, schema).groupBy("fold", "feature").agg(
        *[F.sum(c).alias(c) for c in ("n", *[f"h{k}" for k in range(count)])]
    )
    sizes = sample.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(F.col("y")[k]).alias(f"h{k}") for k in range(count)])
    sizes = {r["fold"]: np.array([r["n"], *[r[f"h{k}"] for k in range(count)]], dtype=float) for r in sizes.collect()}
    total = sum(sizes.values()) if sizes else np.zeros(count + 1)

    # A bucket of features at a time: all folds of a feature are in one group.
    def judge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        columns = [table.column(c).to_numpy() for c in ("fold", "feature", "n", *[f"h{k}" for k in range(count)])]
        names, place = np.unique(columns[1], return_inverse=True)
        cells = np.zeros((FOLDS, len(names), count + 1))
        cells[columns[0], place] = np.stack(columns[2:], axis=1)
        whole = cells.sum(axis=0)
        out = []
        for left_out in (-1, *range(FOLDS)):
            seen = whole if left_out < 0 else whole - cells[left_out]
            size = total if left_out < 0 else total - sizes.get(left_out, 0)
            for k in range(count):
                pos, neg = size[k + 1], size[0] - size[k + 1]
                if pos < 1 or neg < 1:
                    continue
                rate = np.clip(seen[:, 0] / size[0], 1e-9, 1 - 1e-9)
                gap = seen[:, k + 1] / pos - (seen[:, 0] - seen[:, k + 1]) / neg
                z = np.abs(gap) / np.sqrt(rate * (1 - rate) * (1 / pos + 1 / neg))
                best = np.argsort(-z, kind="stable")[:SELECTED]
                out += [(left_out, k, int(names[i]), float(z[i])) for i in best[z[best] >= LEAST_Z]]
        columns = list(zip(*out)) if out else [[], [], [], []]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["left_out", "category", "feature", "z"])

    counted = counted.withColumn("part", F.pmod(F.xxhash64("feature"), F.lit(16)))
    found = counted.groupBy("part").applyInArrow(judge, "left_out int, category int, feature int, z double")
    out = {}
    for row in found.collect():
        out.setdefault((row["left_out"], row["category"]), []).append((-row["z"], row["feature"]))
    return {key: np.sort(np.array([f for _, f in sorted(rows)[:SELECTED]], dtype=np.int64)) for key, rows in out.items()}


def fitted(indptr, index, dense, y, columns, ridge=0.1, rounds=80):
    """Weights of a logistic model: intercept, dense columns, then `columns` binary features; L-BFGS with L2."""
    width = dense.shape[1]
    owner = np.repeat(np.arange(len(y)), np.diff(indptr))

    def loss(w):
        margin = w[0] + dense @ w[1 : 1 + width] + np.bincount(owner, weights=w[1 + width + index], minlength=len(y))
        value = np.logaddexp(0, margin) - y * margin
        rest = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y
        gradient = np.concatenate(
            [[rest.sum()], dense.T @ rest, np.bincount(index, weights=rest[owner], minlength=columns)]
        )
        gradient[1:] += ridge * w[1:]
        return value.sum() + 0.5 * ridge * (w[1:] ** 2).sum(), gradient

    w = np.zeros(1 + width + columns)
    rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    w[0] = np.log(rate / (1 - rate))
    value, gradient = loss(w)
    steps, changes = [], []
    for _ in range(rounds):
        if np.abs(gradient).max() < 1e-3:
            break
        q, kept = gradient.copy(), []
        for s, c in zip(reversed(steps), reversed(changes)):
            a = s @ q / (s @ c)
            q -= a * c
            kept.append(a)
        q *= (steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1]) if steps else 1 / max(1.0, np.abs(gradient).max())
        for s, c, a in zip(steps, changes, reversed(kept)):
            q += (a - c @ q / (s @ c)) * s
        size = 1.0
        while size > 1e-8:
            after, slope = loss(w - size * q)
            if after <= value - 1e-4 * size * (gradient @ q):
                break
            size /= 2
        else:
            break
        if (slope - gradient) @ (-size * q) > 1e-12:
            steps, changes = [*steps, -size * q][-8:], [*changes, slope - gradient][-8:]
        w, value, gradient = w - size * q, after, slope
    return w


def _link(sample, models, category):
    """Models of one category: for each left-out fold (-1: none) its weights, and the log odds of the fold's rows."""
    copies = F.array(F.lit(-1), *[F.lit(f) for f in range(FOLDS)])
    names = sorted({f for (_, k), fs in models.items() if k == category for f in fs.tolist()})
    wanted = np.zeros(1 << FEATURE_BITS, dtype=bool)
    wanted[names] = True

    def cut(batches):
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy()
            index = batch.column(2).flatten().to_numpy()
            keep = wanted[index]
            sizes = np.bincount(np.repeat(np.arange(batch.num_rows), lengths)[keep], minlength=batch.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(index[keep], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, batch.column(3), batch.column(4)], batch.schema.names)

    def fit(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_out = key[0].as_py()
        table = pa.Table.from_batches(list(batches)).combine_chunks().sort_by("row")
        fold = table.column("fold").to_numpy()
        y = np.array(table.column("y").to_pylist(), dtype=float).reshape(len(fold), -1)[:, category]
        lists = table.column("features").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        lengths, index = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        dense = np.array(table.column("odds").to_pylist(), dtype=float).reshape(len(fold), -1)
        chosen = models.get((left_out, category), np.zeros(0, dtype=np.int64))
        slot = np.full(1 << FEATURE_BITS, -1, dtype=np.int64)
        slot[chosen] = np.arange(len(chosen))
        place = slot[index]
        owner = np.repeat(np.arange(len(fold)), lengths)[place >= 0]
        place = place[place >= 0]
        learnt = fold != left_out
        if len(set(y[learnt].tolist())) < 2:
            rate = np.clip(y[learnt].mean() if learnt.any() else 0.0, 1e-6, 1 - 1e-6)
            weights = np.concatenate([[np.log(rate / (1 - rate))], np.zeros(dense.shape[1] + len(chosen))])
        else:
            rows = np.cumsum(learnt) - 1
            mine = learnt[owner]
            indptr = np.concatenate([[0], np.cumsum(np.bincount(rows[owner[mine]], minlength=int(learnt.sum())))])
            weights = fitted(indptr, place[mine], dense[learnt], y[learnt], len(chosen))
        width = dense.shape[1]
        odds = weights[0] + dense @ weights[1 : 1 + width]
        odds += np.bincount(owner, weights=weights[1 + width + place], minlength=len(fold))
        rows = table.column("row").to_numpy()[~learnt]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([left_out], pa.int32()),
                pa.array([weights.tolist()], pa.list_(pa.float64())),
                pa.array([chosen.tolist()], pa.list_(pa.int32())),
                pa.array([rows.tolist()], pa.list_(pa.int64())),
                pa.array([odds[~learnt].tolist()], pa.list_(pa.float64())),
                pa.array([y[~learnt].tolist()], pa.list_(pa.float64())),
            ],
            ["left_out", "weights", "features", "row", "odds", "y"],
        )

    rows = sample.mapInArrow(cut, sample.schema).withColumn("left_out", F.explode(copies))
    schema = "left_out int, weights array<double>, features array<int>, row array<long>, odds array<double>, y array<double>"
    return stored(rows.groupBy("left_out").applyInArrow(fit, schema), "toxicity-models")[0]


def _threshold(odds, y):
    """The cut with the best F1 over out-of-fold log odds, in the middle of its gap; never if the labels are alike."""
    if len(set(y.tolist())) < 2:
        return float("inf")
    order = np.argsort(-odds, kind="stable")
    odds, y = odds[order], y[order]
    right = np.cumsum(y)
    score = 2 * right / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.r_[odds[1:] != odds[:-1], True]
    best = int(np.argmax(np.where(ends, score, -1)))
    return float((odds[best] + odds[best + 1]) / 2) if best + 1 < len(odds) else float(odds[best])


class Chain:
    """Fitted models of all categories, with the out-of-fold F1 they reached."""

    def __init__(self, names, links, thresholds, f1):
        self.names, self.links, self.thresholds, self.f1 = names, links, thresholds, f1

    def classify(self, docs, text_col="text"):
        """The documents with a probability p_<name> and a decision is_<name> per category."""
        chosen = np.unique(np.concatenate([f for _, _, f in self.links]))
        weights = np.zeros((len(chosen), len(self.links)))
        for k, (_, w, f) in enumerate(self.links):
            weights[np.searchsorted(chosen, f), k] = w
        intercepts = [d for d, _, _ in self.links]
        shared = docs.sparkSession.sparkContext.broadcast((weights, chosen))
        limits = self.thresholds
        answer = T.StructType(
            [T.StructField(f"p_{n}", T.DoubleType()) for n in self.names]
            + [T.StructField(f"is_{n}", T.BooleanType()) for n in self.names]
        )

        @F.arrow_udf(answer)
        def judge(texts: pa.Array) -> pa.Array:
            weights, chosen = shared.value
            sums = _scores(texts, weights, chosen)
            odds = np.zeros_like(sums)
            for k, dense in enumerate(intercepts):
                odds[:, k] = dense[0] + sums[:, k] + odds[:, :k] @ dense[1:]
            chance = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
            columns = [pa.array(chance[:, k]) for k in range(len(limits))]
            columns += [pa.array(odds[:, k] >= limits[k]) for k in range(len(limits))]
            return pa.StructArray.from_arrays(columns, names=answer.names)

        judged = docs.drop(*answer.names).withColumn("__judged", judge(F.col(text_col)))
        return judged.select(*[c for c in docs.columns if c not in answer.names], "__judged.*")


def fit(docs, labels, categories=CATEGORIES, sample_size=SAMPLE, id_col="doc_id", text_col="text"):
    """A Chain learnt from at most `sample_size` labelled documents."""
    count = len(categories)
    sample = _sample(docs, labels, categories, sample_size, id_col, text_col)
    models = _selected(sample, count)
    # Rows are numbered once, so that out-of-fold log odds find their row again.
    numbered = sample.withColumn("row", F.monotonically_increasing_id()).withColumn("odds", F.array().cast("array<double>"))
    numbered, _ = stored(numbered, "toxicity-rows")
    links, thresholds, f1 = [], [], []
    for k in range(count):
        found = _link(numbered, models, k)
        whole = found.filter("left_out = -1").select("weights", "features").first()
        out = found.filter("left_out >= 0").select(F.explode(F.arrays_zip("row", "odds", "y")).alias("o")).select("o.row", "o.odds", "o.y")
        table = out.toArrow()
        odds, y = table["odds"].to_numpy(), table["y"].to_numpy()
        thresholds.append(_threshold(odds, y))
        said = odds >= thresholds[-1]
        f1.append(float(2 * (said & (y > 0)).sum() / max(1, said.sum() + (y > 0).sum())))
        w = np.array(whole["weights"]) if whole else np.zeros(1 + k)
        links.append((w[: 1 + k], w[1 + k :], np.array(whole["features"] if whole else [], dtype=np.int64)))
        if k + 1 < count:
            numbered = numbered.join(out.select("row", F.col("odds").alias("new")), "row")
            numbered = numbered.withColumn("odds", F.concat("odds", F.array("new"))).select(*sample.columns, "row", "odds")
            numbered, _ = stored(numbered, "toxicity-rows")
    return Chain([n for n, _ in categories], links, thresholds, f1)


def report(docs, labels, **options):
    chain = fit(docs, labels, **options)
    judged = chain.classify(docs.select("doc_id", "text"))
    return judged.drop("text")
