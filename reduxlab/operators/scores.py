"""Classification and clustering scores from small contingency tables."""

from functools import reduce

from pyspark.sql import functions as F


def confusion(df, truth="label", guess="prediction"):
    """Rows per (truth, guess): as many rows as class pairs, whatever the table size."""
    return df.groupBy(F.col(truth).alias("y"), F.col(guess).alias("p")).agg(F.count("*").alias("n"))


def _ratio(top, bottom):
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def per_class(counts):
    """support, predicted, hits, precision, recall and F1 for every true or predicted class."""
    n, none = F.col("n"), F.lit(0).cast("long")
    hits = F.when(F.col("y") == F.col("p"), n).otherwise(none)

    def side(cls, support, predicted, hit):
        return F.struct(
            F.col(cls).alias("cls"), support.alias("support"), predicted.alias("predicted"), hit.alias("hit")
        )

    both = F.array(side("y", n, none, hits), side("p", none, n, none))
    sides = counts.select(F.explode(both).alias("s")).select("s.*")
    table = sides.groupBy("cls").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit")
    )
    return (
        table.withColumn("precision", _ratio(F.col("hit"), F.col("predicted")))
        .withColumn("recall", _ratio(F.col("hit"), F.col("support")))
        .withColumn("f1", _ratio(2 * F.col("hit"), F.col("support") + F.col("predicted")))
    )


def classification_scores(df, truth="label", guess="prediction"):
    """One row with the six scores; absent classes count as the macro rules say."""
    table = per_class(confusion(df, truth, guess))
    return table.agg(
        (F.sum("hit") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
    )


def _pairs(n):
    return n * (n - 1) / F.lit(2.0)


def _totals(counts):
    """Cells, rows, columns and largest cell of each column as one stream of (kind, n)."""
    parts = [
        counts.select(F.lit("cell").alias("kind"), "n"),
        counts.groupBy("y").agg(F.sum("n").alias("n")).select(F.lit("row").alias("kind"), "n"),
        counts.groupBy("p").agg(F.sum("n").alias("n")).select(F.lit("col").alias("kind"), "n"),
        counts.groupBy("p").agg(F.max("n").alias("n")).select(F.lit("best").alias("kind"), "n"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _over(kind, value):
    return F.sum(F.when(F.col("kind") == kind, value))


def clustering_agreement(df, truth="label", cluster="cluster"):
    """One row: adjusted Rand index, normalised mutual information, purity."""
    n = F.col("n").cast("double")
    sums = _totals(confusion(df, truth, cluster)).agg(
        _over("cell", n).alias("total"),
        _over("best", n).alias("majority"),
        *[_over(kind, _pairs(n)).alias(f"{kind}_pairs") for kind in ("cell", "row", "col")],
        *[_over(kind, n * F.log(n)).alias(f"{kind}_log") for kind in ("cell", "row", "col")],
    )
    total = F.col("total")
    expected = F.col("row_pairs") * F.col("col_pairs") / _pairs(total)
    ceiling = (F.col("row_pairs") + F.col("col_pairs")) / 2
    ari = F.when(
        (F.col("row_pairs") == F.col("cell_pairs")) & (F.col("col_pairs") == F.col("cell_pairs")), F.lit(1.0)
    ).otherwise((F.col("cell_pairs") - expected) / (ceiling - expected))
    entropy_y = F.log(total) - F.col("row_log") / total
    entropy_p = F.log(total) - F.col("col_log") / total
    mutual = F.log(total) + (F.col("cell_log") - F.col("row_log") - F.col("col_log")) / total
    nmi = F.when((F.abs(entropy_y) < 1e-12) & (F.abs(entropy_p) < 1e-12), F.lit(1.0)).when(
        F.abs(mutual) < 1e-12, F.lit(0.0)
    ).otherwise(mutual / ((entropy_y + entropy_p) / 2))
    return sums.select(ari.alias("ari"), nmi.alias("nmi"), (F.col("majority") / total).alias("purity"))


def contingency(df, truth="label", cluster="cluster", classes=None):
    """Cluster x class counts, one column per class."""
    pivoted = df.groupBy(F.col(cluster).alias("cluster")).pivot(truth, classes).count()
    return pivoted.na.fill(0)
