import pytest
from pyspark.sql import functions as F

from reduxlab.operators import sampling


def labelled(spark, counts):
    rows, i = [], 0
    for label, n in counts.items():
        for _ in range(n):
            rows.append((i, label))
            i += 1
    return spark.createDataFrame(rows, "id long, label int")


def counts(df, *cols):
    return {tuple(r[c] for c in cols): r["count"] for r in df.groupBy(*cols).count().collect()}


def test_subsample_is_exact_and_ignores_layout(spark):
    df = labelled(spark, {0: 700, 1: 300})
    first = {r["id"] for r in sampling.subsample(df, 123, 7).collect()}
    second = {r["id"] for r in sampling.subsample(df.repartition(11), 123, 7).collect()}
    assert len(first) == 123 and first == second
    assert first != {r["id"] for r in sampling.subsample(df, 123, 8).collect()}
    assert sampling.subsample(df, None, 7).count() == 1000
    assert sampling.subsample(df, 5000, 7).count() == 1000
    assert sampling.subsample(df, 0, 7).count() == 0


def test_large_prefixes_are_counted_again(spark, monkeypatch):
    df = labelled(spark, {0: 4000, 1: 900})
    expected = counts(sampling.split_table(df, test_size=0.3), "id", "split")
    monkeypatch.setattr(sampling, "RANKED_ROWS", 2)
    assert counts(sampling.split_table(df, test_size=0.3), "id", "split") == expected
    monkeypatch.setattr(sampling, "MAX_COUNTS", 40)
    assert counts(sampling.split_table(df, test_size=0.3), "id", "split") == expected
    monkeypatch.setattr(sampling, "MAX_COUNTS", 1)
    with pytest.raises(ValueError):
        sampling.split_table(df, test_size=0.3)


def test_shares_follow_largest_remainders():
    assert sampling.proportional_shares({0: 50, 1: 30, 2: 20}, 10) == {0: 5, 1: 3, 2: 2}
    assert sampling.proportional_shares({0: 1, 1: 1, 2: 1}, 2) == {0: 1, 1: 1, 2: 0}
    assert sum(sampling.proportional_shares({i: 7 + i for i in range(9)}, 31).values()) == 31


def test_split_with_one_class_holding_most_rows(spark):
    df = labelled(spark, {0: 900, 1: 60, 2: 40})
    split = sampling.split_table(df, test_size=0.2)
    assert counts(split, "label", "split") == {
        (0, "train"): 720, (0, "test"): 180, (1, "train"): 48, (1, "test"): 12, (2, "train"): 32, (2, "test"): 8,
    }


def test_split_leaves_unwanted_rows_out(spark):
    split = sampling.split_table(labelled(spark, {0: 60, 1: 40}), train_size=50, test_size=20)
    assert counts(split, "label", "split") == {(0, "train"): 30, (1, "train"): 20, (0, "test"): 12, (1, "test"): 8}


def test_split_falls_back_when_a_class_is_single(spark):
    split = sampling.split_table(labelled(spark, {0: 20, 1: 1}), test_size=0.25)
    assert counts(split, "split") == {("train",): 15, ("test",): 6}


def test_split_falls_back_when_a_side_is_smaller_than_the_classes(spark):
    split = sampling.split_table(labelled(spark, {i: 3 for i in range(8)}), test_size=4)
    assert counts(split, "split") == {("train",): 20, ("test",): 4}


def test_split_refuses_impossible_sizes(spark):
    with pytest.raises(ValueError):
        sampling.split_table(labelled(spark, {0: 10}), train_size=8, test_size=5)


def test_validation_split_keeps_singletons_and_rounds_half_to_even(spark):
    df = labelled(spark, {0: 1, 1: 2, 2: 25, 3: 35})
    part = sampling.validation_split(df, 0.1)
    assert counts(part.filter("part = 'val'"), "label") == {(1,): 1, (2,): 2, (3,): 4}
    assert counts(sampling.validation_split(df, 0.1, enabled=False), "part") == {("train",): 63}


def test_validation_split_keeps_an_earlier_split_column(spark):
    df = labelled(spark, {0: 20}).withColumn("split", F.lit("train"))
    assert set(sampling.validation_split(df).columns) == {"id", "label", "split", "part"}


def test_companion_rows_follow_the_sample(spark):
    df = labelled(spark, {0: 50, 1: 50})
    chosen = sampling.sample_stratified(df, 20)
    shown = sampling.companion_rows(df.withColumn("shown", F.col("id") * 2), chosen)
    assert counts(chosen, "label") == {(0,): 10, (1,): 10}
    assert {r["shown"] for r in shown.collect()} == {2 * r["id"] for r in chosen.collect()}
    assert sampling.sample_stratified(df, 500).count() == 100
