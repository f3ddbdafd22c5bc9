"""Byte-level BPE: the same ids as the tokenizer library, round trips, odd rows."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from reduxlab.llm import byte_bpe

PATTERN = public_tokenizers.PATTERN
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def vocabulary(ranks):
    return byte_bpe.Vocabulary.from_ranks(ranks)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(library, text):
    return np.array(library.encode_ordinary(text or ""), dtype="<u4").tobytes()


def odd_texts():
    rng = random.Random(12)
    signs = " abcdefghijklmnop éßжx漢😀\n\t  '.;1"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    texts += ["".join(rng.choice("etaoin") for _ in range(n)) for n in (2, 3, 63, 64, 65, 1000, 3000)]
    return [*texts, None, "", " ", "a" * 5000 + " " * 3000, "ab" * 700, "x" * 1025, "<|endoftext|>", "it's we'll", "\x00\x00"]


def test_ids_are_those_of_the_library(vocabulary, library):
    encoder = byte_bpe.Encoder(vocabulary, PATTERN)
    for text, ids in zip(odd_texts(), encoder.encode(odd_texts()), strict=True):
        assert ids == expected(library, text)


def test_heap_and_matrix_merge_alike(vocabulary):
    rng = random.Random(3)
    for n in (2, 7, 50, 400, 1024):
        piece = bytes(rng.choice(b"the aaabbe ") for _ in range(n))
        assert [byte_bpe.merge_long(vocabulary, piece)] == byte_bpe.merged_pieces(vocabulary, [piece])


def test_runs_of_matches_and_generations_change_nothing(monkeypatch, vocabulary, library):
    text = "".join(random.Random(5).choice("the quick éà 12") for _ in range(4000))
    for name, value in (("RUN_CHARS", 300), ("RUN_MATCHES", 37), ("CACHE_BYTES", 2000), ("MATRIX_VALUES", 64)):
        monkeypatch.setattr(byte_bpe, name, value)
    encoder = byte_bpe.Encoder(vocabulary, PATTERN)
    for given, ids in zip([text, *odd_texts()], encoder.encode([text, *odd_texts()]), strict=True):
        assert ids == expected(library, given)
    assert encoder.bytes < 100_000


def test_pair_table_finds_each_pair_and_no_other():
    rng = np.random.default_rng(0)
    left, right = rng.integers(0, 300, 5000), rng.integers(0, 300, 5000)
    known = {(a, b): i for i, (a, b) in enumerate(zip(left.tolist(), right.tolist()))}
    pairs = np.array([(a, b, i) for (a, b), i in known.items()])
    table = byte_bpe.PairTable(pairs[:, 0], pairs[:, 1], pairs[:, 2])
    a, b = np.divmod(np.arange(90_000), 300)
    none = np.iinfo(np.int32).max
    assert table.look_up(a, b).tolist() == [known.get(pair, none) for pair in zip(a.tolist(), b.tolist())]


def test_least_rank_goes_first_and_ties_to_the_left():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"bc": 257, b"ab": 258, b"abc": 259}
    vocabulary = byte_bpe.Vocabulary.from_ranks(ranks)
    got = [np.frombuffer(ids, dtype="<u4").tolist() for ids in byte_bpe.merged_pieces(vocabulary, [b"aaa", b"abc", b"aaabc", b"d"])]
    assert got == [[256, 97], [259], [256, 259], [100]]


def test_report_round_trip_over_odd_rows(spark, library):
    texts = [*odd_texts(), "twice", "twice"]
    rows = [(i if i else None, text, "x", i) for i, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)
    got = sorted(map(tuple, byte_bpe.report(docs, PATH, PATTERN).collect()), key=repr)
    digest = lambda data: hashlib.sha256(data).hexdigest()
    want = [
        (doc, len(expected(library, text)) // 4, digest(expected(library, text)), digest((text or "").encode()))
        for doc, text, _, _ in rows
    ]
    assert got == sorted(want, key=repr)


def test_decoding_in_parts_and_unknown_ids(spark, monkeypatch, vocabulary):
    monkeypatch.setattr(byte_bpe, "RUN_CHARS", 4)
    texts = ["one text " * 50, "", None, "another"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    table = byte_bpe.decoded(byte_bpe.encoded(docs, vocabulary, PATTERN, into="text", text_col="text"), vocabulary, ids_col="text")
    got = {r["doc_id"]: bytes(r["decoded"]).decode() for r in table.collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}
    with pytest.raises(ValueError, match="vocabulary"):
        vocabulary.bytes_of(np.array([len(vocabulary.known) + 5]))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.report(empty, PATH, PATTERN).collect() == []
