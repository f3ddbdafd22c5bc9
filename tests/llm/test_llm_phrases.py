"""Phrase mining against brute force: any sketch size, padding, overlaps, ties, odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from reduxlab.llm import phrases


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, least, covered, top):
    counts, words = defaultdict(Counter), Counter()
    for lang, text in docs:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text)):
            w = re.findall("[^ \t]+", piece)
            words[lang or "und"] += len(w)
            for m in range(1, 6):
                counts[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    rows = []
    for lang, f in counts.items():
        longest = Counter()
        for g, n in f.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    longest[g[i : i + m]] = max(longest[g[i : i + m]], n)
        found = []
        for g, a in f.items():
            if len(g) < 2 or a < least or 100 * longest[g] >= covered * a:
                continue
            n = words[lang]
            score, k = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]], n))
        for rank, (score, a, phrase, left, right, n) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(rows)


def corpus(seed, rows=160):
    rng = random.Random(seed)
    vocabulary = ["la", "La", "de", "maison", "é", "Été", "to", "be", "x", "\x00z", "漢"] + [f"w{i}" for i in range(60)]
    docs = []
    for i in range(rows):
        words = rng.choices(vocabulary, weights=[9, 3, 9, 5, 4, 4, 6, 6, 12, 2, 2] + [1] * 60, k=rng.randint(0, 60))
        if rng.random() < 0.5:
            words[len(words) // 2 : len(words) // 2] = ["to", "be", "Or", "not", "to", "be"]
        docs.append((rng.choice(["en", "en", "en", "fr", None]), "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", "\n", ".", " ; "]) for w in words)))
    return docs + [("en", None), (None, ""), ("de", " .,;\n "), ("en", "x x x x x x x x x x " * 40), ("und", "la la")] + docs[:5]


def rows_of(spark, docs, **options):
    table = spark.createDataFrame([(i, t, lang, 1, "clash") for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, n int, w1 string")
    return sorted(map(tuple, phrases.mine(table.repartition(5), **options).collect()))


@pytest.mark.parametrize(("slots", "covered", "top"), [(1 << 18, 100, 2000), (64, 70, 4)])
def test_same_phrases_as_brute_force(spark, slots, covered, top):
    docs = corpus(slots)
    want = brute(docs, 4, covered, top)
    assert len(want) > 10 and {r[0] for r in want} >= {"en", "und"}
    assert rows_of(spark, docs, min_count=4, covered=covered, top=top, slots=slots) == want


def test_runs_and_gathering_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "RUN_BYTES", 200)
    monkeypatch.setattr(phrases, "GATHERED", 50)
    docs = corpus(2, rows=60)
    assert rows_of(spark, docs, min_count=3, slots=256) == brute(docs, 3, 100, 2000)


def test_saturating_counters_never_fall_short(spark):
    docs = [("en", "a b " * 400), ("en", "a b " * 300 + "c d"), ("fr", "a b")]
    table = spark.createDataFrame(docs, "lang string, text string").repartition(2)
    bits = phrases.frequent_pairs(table, 699, slots=1 << 12, chunk=1 << 10)
    run = phrases.Run(pa.array(["en", "fr"]), pa.array(["a b a. c d", "a b"]))
    _, slots = run.slots(1 << 12)
    got = ((bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1).tolist()
    assert got == [1, 0, 0, 0]  # a b 700 times, b a 698, c d once, a b in fr once


def test_large_counts_are_exact(spark):
    n, a, left, right = 4 * 10**14, 3 * 10**12 + 7, 5 * 10**12, 6 * 10**12 + 1
    rows = [("en", [], n), ("en", [1], left), ("en", [2], right), ("en", [1, 2], a)]
    found = phrases.scored(spark.createDataFrame(rows, "lang string, words array<long>, f long")).collect()
    assert [(r["cut"]["score"], r["n"]) for r in found] == [(1000 * a * n // (left * right), n)]


def test_no_rows_and_no_words(spark):
    for docs in ([], [(None, None), ("en", "")]):
        table = spark.createDataFrame(docs, "lang string, text string")
        assert phrases.mine(table, slots=256).collect() == []
