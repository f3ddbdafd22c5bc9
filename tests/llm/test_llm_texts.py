"""Word hashes, decontamination, packing, sharding: brute force and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from reduxlab.llm import decontamination, packing, sharding, words
from reduxlab.llm.ranks import ranked

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@pytest.mark.parametrize("piece", [16, 1 << 20])
def test_word_hashes_are_a_function_of_the_word(monkeypatch, piece):
    monkeypatch.setattr(words, "_PIECE", piece)
    texts = ["Aa bB  cc\naa", None, "", "x", "  ", "q" * 200 + " zz", "zz\x0bÄ ä", "aa"] * 3
    got, first, last, offsets = words.word_hashes(pa.array(["skip", *texts]).slice(1))
    expected = [w.lower() for t in texts for w in (t or "").encode().split()]
    assert len(got) == len(expected) and offsets.tolist() == np.cumsum([0] + [len((t or "").split()) for t in texts]).tolist()
    by_word, by_hash = {}, {}
    for word, value in zip(expected, got.tolist()):
        assert by_word.setdefault(word, value) == value and by_hash.setdefault(value, word) == word
    assert (last - first).tolist() == [len(w) for w in expected]


def brute_contamination(docs, items, length=10):
    def split(text):
        return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    grams = defaultdict(set)
    for item, text in items:
        w = split(text)
        n = min(length, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[i : i + n])].add("null" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                names = grams.get(tuple(w[i : i + n]))
                if names:
                    hit.update(range(i, i + n))
                    found |= names
        names = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), names, bool(hit)))
    return sorted(out, key=repr)


def contaminated_rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "ß9", "x1"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([14, 25, 11, 10])))) for i in range(30)]
    items += [(2, items[2][1]), (30, "Only Three words"), (31, "lonelyword"), (None, "a null id of three"), (33, None), (34, " ,. "), (35, "lonelyword")]
    docs = []
    for i in range(80):
        text = " ".join(rng.choices(vocabulary, k=rng.randrange(40)))
        if i % 3 == 0:
            text += ", " + rng.choice(items[:30])[1].upper().replace(" ", " -- ") + "! " + text
        docs.append((i, text))
    docs += [(5, docs[5][1]), (100, None), (101, ""), (102, "...!"), (103, "a null ID of three\nonly three  WORDS lonelyword")]
    return docs + [(104, " ".join(["lonelyword"] * 9000)), (None, "lonelyword"), (105, items[0][1][:-1])], items


@pytest.mark.parametrize("block_bytes", [1 << 20, 900])
def test_decontamination_as_brute_force(spark, block_bytes):
    docs, items = contaminated_rows()
    found = decontamination.report(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
        spark.createDataFrame(items, "item_id long, text string"),
        block_bytes=block_bytes,
    )
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_contamination(docs, items)


def test_decontamination_removes_spans_or_documents(spark):
    benchmark = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    rows = [
        (1, "Ä before. One, two three four five six seven eight nine TEN after", "x"),
        (2, "one two three four five six seven eight nine", "y"),
        (3, None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits string")
    assert [tuple(r) for r in decontamination.clean(docs, benchmark).orderBy("doc_id").collect()] == rows[1:]
    cut = decontamination.clean(docs, benchmark, remove="spans").orderBy("doc_id").collect()
    assert [r.text for r in cut] == ["Ä before.  after", rows[1][1], None]
    assert decontamination.clean(docs, benchmark.limit(0)).count() == 3
    assert decontamination.report(docs.limit(0), benchmark).count() == 0
    with pytest.raises(ValueError):
        decontamination.clean(docs, benchmark, remove="words")


def test_packing_ids_and_places(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["Ünder", "the", "I'll", "x!?", "12ab", "日本語", "<|endoftext|>", "e\u0301a"], k=rng.randrange(300))) for _ in range(120)]
    texts += ["", None, " ", "a\u00a0b \u0301c\x1cd\x00", "word " * 6000, "z" * 20000, texts[0]]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, length string").repartition(3)
    found = packing.pack(docs, TOKENIZER, size=256).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    expected = Counter()
    total = 0
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        for i in range(0, len(ids), 256):
            part = ids[i : i + 256]
            expected[doc, i // 256, i, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= 1.03 * total / 256 + 1
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0


def test_long_texts_are_split_at_white_space(monkeypatch):
    from reduxlab.llm import tokens

    monkeypatch.setattr(tokens, "PIECE_BYTES", 50)
    encoder = tokens.WordEncoder(TOKENIZER)
    texts = ["some words of a text that is longer than a piece " * 9, "q" * 300 + " end", "short", None]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for data, text in zip(encoder.encode(texts), texts, strict=True):
        assert np.frombuffer(data, "<u4").tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once_and_nearly_fills(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(2048, rng.lognormal([5, 6.5, 3, 7.4][seed], 1, 20000).astype(int) + 1)
    histogram = {int(k): int(c) for k, c in zip(*np.unique(lengths, return_counts=True))}
    plan = packing.planned(histogram)
    room = np.zeros(plan.sequences, dtype=np.int64)
    places = defaultdict(list)
    for length, place, count, first, offset in sorted(plan.runs, key=lambda r: r[4]):
        assert (room[first : first + count] == offset).all()
        room[first : first + count] += length
        places[length] += range(place, place + count)
    assert {k: sorted(v) for k, v in places.items()} == {k: list(range(c)) for k, c in histogram.items()}
    assert room.max() <= 2048 and plan.sequences <= 1.01 * lengths.sum() / 2048 + 1


def test_non_negative_least_squares():
    columns = packing.patterns(12, 3)
    assert all(row.sum() == 12 for row in columns) and len({tuple(sorted(r)) for r in columns.tolist()}) == len(columns) == 19
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, len(columns))
    wanted = np.zeros(13)
    np.add.at(wanted, columns.ravel(), np.repeat(counts, 3))
    wanted[0] = 0
    chosen, x = packing.fitted(columns, wanted)
    reached = np.zeros(13)
    np.add.at(reached, columns[chosen].ravel(), np.repeat(x, 3))
    assert (x >= 0).all() and np.abs(reached - wanted)[1:].max() < 1e-3 * wanted.max()


def test_ranks_are_gapless(spark):
    rows = [(i % 3 if i % 5 else 0, i // 2) for i in range(900)]
    got = ranked(spark.createDataFrame(rows, "g int, id long"), ["g"], ["id"], bucket_rows=50).collect()
    by = defaultdict(list)
    for r in got:
        by[r.g].append(r["rank"])
    assert {g: sorted(v) == list(range(len(v))) for g, v in by.items()} == {0: True, 1: True, 2: True}


def sharded(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int").repartition(3)
    return sharding.shard(docs, **options).collect()


def test_shards_are_even_gapless_and_keep_groups(spark):
    rng = random.Random(4)
    texts = [f"text {i}" for i in range(300)] + [None, None, "", "", "x" * 100000]
    texts += [f"group {i % 60}" for i in range(240)] + ["hot"] * 300
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(0, texts[0])]
    found = sharded(spark, rows, shards=7)
    counts = Counter(r.shard for r in found)
    assert len(found) == len(rows) and set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(n))
    text_of = dict(rows)
    assert all(r["size"] == len((text_of[r.doc_id] or "").encode()) + 8 for r in found)
    assert all(r.text_crc32 == zlib.crc32((text_of[r.doc_id] or "").encode()) for r in found)
    groups = defaultdict(Counter)
    for r in found:
        groups[text_of[r.doc_id]][r.shard] += 1
    small = [g for t, g in groups.items() if t and t.startswith("group")]
    assert sum(len(g) == 1 for g in small) >= 0.8 * len(small)
    # Three shards must be used by the 300 copies; scattered they would be in seven.
    assert groups["hot"].most_common(3)[2][1] >= 0.5 * counts[0]
    assert {r.law for r in found} == {"rows"} and {r.grown_shard for r in found} == {None}


def test_few_or_no_documents(spark):
    assert sorted(r.slot for r in sharded(spark, [(1, "a"), (2, "a"), (3, None)], shards=24)) == [0, 0, 0]
    assert sharded(spark, [], shards=24) == []
