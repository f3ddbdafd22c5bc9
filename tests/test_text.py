import numpy as np
import pytest

from reduxlab.operators import text


@pytest.fixture
def docs(spark):
    rows = [
        (0, "The Élan of größe, the GRÖSSE größe a b_1"),
        (1, "élan vital vital x"),
        (2, ""),
        (3, "the a x"),
        (4, "b_1 größe vital unseen-word"),
    ]
    return spark.createDataFrame(rows, "id long, text string")


def rows_of(df):
    return {r["id"]: (list(r["idx"]), list(r["val"])) for r in df.collect()}


def test_weights_follow_the_smoothed_formula(docs):
    model = text.fit_tfidf(docs, stop_words=["the", "of"], min_df=2)
    assert model.terms == ["b_1", "größe", "vital", "élan"]
    idf = {t: np.log(6 / (1 + 2)) + 1 for t in model.terms}
    got = rows_of(model.transform(docs, stop_words=["the", "of"]))
    raw = np.array([1, 2, 1]) * idf["élan"]
    assert got[0][0] == [0, 1, 3]
    assert np.allclose(got[0][1], raw / np.linalg.norm(raw))
    assert got[2] == ([], []) and got[3] == ([], [])


def test_vocabulary_is_cut_by_use_then_name(docs):
    model = text.fit_tfidf(docs, stop_words=["the", "of"], min_df=1, max_features=3)
    assert model.terms == ["b_1", "größe", "vital"]


def test_unbounded_vocabulary_gives_the_same_rows(docs):
    small = text.fit_tfidf(docs, stop_words=["the"], min_df=1)
    large = text.fit_tfidf(docs, stop_words=["the"], min_df=1, max_features=None)
    a, b = rows_of(small.transform(docs, stop_words=["the"])), rows_of(large.transform(docs, stop_words=["the"]))
    assert a.keys() == b.keys()
    for key in a:
        assert a[key][0] == b[key][0] and np.allclose(a[key][1], b[key][1])


def test_repeated_rows_stay_on_both_paths(spark):
    rows = [(1, "one two two"), (1, "one two two"), (1, "one two two"), (2, ""), (2, ""), (None, "two"), (None, None)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    found = []
    for size in (100, None):
        out = text.fit_tfidf(docs, min_df=1, max_features=size).transform(docs)
        found.append(sorted(((r["id"], r["idx"], [round(v, 9) for v in r["val"]]) for r in out.collect()), key=repr))
    assert found[0] == found[1] and len(found[0]) == 7 and sum(row[0] == 1 for row in found[0]) == 3


def test_terms_are_counted_and_joined_once_per_batch(spark, monkeypatch):
    rows = [(i, f"one two two word{i % 3}" if i % 10 else None) for i in range(300)]
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    words = docs.select(text.token_list("text", ()).alias("words"))
    counted = words.mapInArrow(text.count_terms, "term string, uses long, docs long").collect()
    assert len(counted) == 5
    expected = {"one": (270, 270), "two": (540, 270), "word0": (90, 90), "word1": (90, 90), "word2": (90, 90)}
    found = {r["term"]: (r["uses"], r["docs"]) for r in text.term_statistics(docs).collect()}
    assert found == expected
    kept, keep = [], text.stored
    monkeypatch.setattr(text, "stored", lambda *given: kept.append(keep(*given)) or kept[-1])
    out = text.fit_tfidf(docs, min_df=1, max_features=None).transform(docs)
    packed = kept[0][0].collect()
    assert len(packed) == 1 and sorted(packed[0]["terms"]) == sorted(expected)
    assert sorted(len(r["idx"]) for r in out.collect()) == [0] * 30 + [3] * 270


def test_copies_with_all_their_columns_travel_packed(spark, monkeypatch):
    docs = spark.sql(
        "SELECT id % 4 AS id, IF(id % 4 = 3, NULL, array(id % 4, NULL)) AS tags, timestamp'2020-01-01' AS at,"
        " concat('one two two more', id % 4) AS text FROM range(0, 2000, 1, 1)"
    )
    kept, keep = [], text.stored
    monkeypatch.setattr(text, "stored", lambda *given: kept.append(keep(*given)) or kept[-1])
    model = text.fit_tfidf(docs, min_df=1, max_features=None)
    out = model.transform(docs)
    assert out.columns == ["id", "tags", "at", "idx", "val"] and out.schema["at"] == docs.schema["at"]
    found = out.groupBy("id", "tags", "at", "idx").count().collect()
    assert sorted((r["id"], r["tags"], r["idx"], r["count"]) for r in found) == [
        (i, None if i == 3 else [i, None], [i, 4, 5], 500) for i in range(4)
    ]
    packed = kept[0][0].collect()
    assert len(packed) == 1 and len(packed[0]["others"]) + len(packed[0]["counts"]) < 2000 * 6
    assert model.transform(docs.select("text")).select("idx").distinct().count() == 4


def test_default_stop_words(spark):
    assert {"the", "and", "of"} <= set(text.english_stop_words())


@pytest.mark.parametrize(
    "raw, part, expected",
    [
        ("From: a\nTo: b\n\nbody\n\nmore", "headers", "body\n\nmore"),
        ("no blank line", "headers", ""),
        ("keep\n> quoted\n| too\nBob wrote:\nend", "quotes", "keep\nend"),
        ("body\nmore\n--\nsigned", "footers", "body\nmore"),
        ("body\n\nsigned", "footers", "body"),
        ("body one\nbody two\n--\nJane Doe\n", "footers", "body one\nbody two"),
        ("body\nmore\n  ---\t\nJane\n\n \n", "footers", "body\nmore"),
        ("body\n- -\nmore", "footers", "body\n- -\nmore"),
        ("--\nonly a rule first\n", "footers", "--\nonly a rule first\n"),
        ("only one line", "footers", "only one line"),
    ],
)
def test_cleaning(spark, raw, part, expected):
    df = spark.createDataFrame([(raw,)], "text string")
    assert text.clean_text(df, (part,)).head()["text"] == expected
