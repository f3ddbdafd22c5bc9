"""Cross-tokenizer alignment: brute force over the libraries' tokens, bitmaps, blocks, odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from reduxlab.llm import alignment

JSON, MODEL = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def libraries():
    one = Tokenizer.from_file(JSON)
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=MODEL)


def groups_of(libraries, text):
    """[(A ids, B ids)] of one text by the libraries' own tokens."""
    one, two = libraries
    if not text:
        return []
    signs = alignment.byte_of_sign()
    a = [(i, bytes(signs[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()) for i in two.encode(text)]
    whole = (" " + text).encode()
    if b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
        return []
    ends = [set(np.cumsum([len(t) for _, t in side]).tolist()) for side in (a, b)]
    out, common = [], sorted(ends[0] & ends[1])
    for begin, end in zip([0, *common], common):
        sides = []
        for side in (a, b):
            upto = np.cumsum([0] + [len(t) for _, t in side]).tolist()
            sides.append([i for (i, _), u, v in zip(side, upto, upto[1:]) if begin <= u and v <= end])
        out.append(tuple(sides))
    return out


def brute(libraries, docs):
    made = [(doc, groups_of(libraries, text)) for doc, text in docs]
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for _, groups in made]
    count, times = Counter(), Counter()
    for found in links:
        count.update(found.keys())
        times.update(found)
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    rows = []
    for (doc, groups), found in zip(made, links):
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        rows.append(
            (
                doc,
                sum(len(a) for a, _ in groups),
                sum(len(b) for _, b in groups),
                len(groups),
                sum(found.values()),
                sum(n for (x, y), n in found.items() if count[x, y] == best[x]),
                sum(n * count[pair] for pair, n in found.items()),
                written,
            )
        )
    pairs = sorted((x, y, n, times[x, y], n == best[x]) for (x, y), n in count.items())
    return rows, pairs


def odd_docs():
    rng = random.Random(13)
    words = "the tokenizer réunit naïve 漢字 😀 Straße 12 345 <|endoftext|> <s> </s> … x́ ▁ ﬁ e-mail 'll".split(" ")
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 40))) + rng.choice(["", "\n", "  ", "\t.", "\r\n\r\n"]) for _ in range(60)]
    texts += [None, "", " ", "  ", "\n", "▁", "a\x00b", "<|endoftext|>", "<unk>", "😀" * 70, " " * 300, "the the the " * 300, "zq" * 400]
    return list(enumerate(texts)) + [(3, texts[3]), (3, texts[3]), (None, "no id")]


def table(spark, docs):
    rows = [(doc, text, 1, "clash") for doc, text in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, n_a int, block string").repartition(4)


@pytest.mark.parametrize(("block", "links"), [(None, 4096), (32, 4)])
def test_counts_scores_and_groups_are_those_of_brute_force(spark, monkeypatch, libraries, block, links):
    monkeypatch.setattr(alignment, "GROUP_LINKS", links)
    if block:
        monkeypatch.setattr(alignment, "BLOCK_DOCS", block)
        monkeypatch.setattr(alignment, "LIST_PLACES", block // 16)
        monkeypatch.setattr(alignment, "RUN_BYTES", 300)
    docs = odd_docs()
    rows, pairs = brute(libraries, docs)
    assert any(len(a) * len(b) > 4 for _, text in docs for a, b in groups_of(libraries, text))
    got, got_pairs = alignment.align(table(spark, docs), JSON, MODEL, PATTERN)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)
    assert sorted(map(tuple, got_pairs.collect())) == pairs


def test_report_hashes_groups_and_leaves_none_empty(spark, libraries):
    docs = odd_docs()
    rows, _ = brute(libraries, docs)
    want = [(*row[:-1], hashlib.sha256(row[-1].encode()).hexdigest() if row[-1] else "") for row in rows]
    got = alignment.report(table(spark, docs), JSON, MODEL, PATTERN)
    assert got.columns[-1] == "groups_sha256"
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_bitmaps_come_back(monkeypatch):
    rng = np.random.default_rng(1)
    pairs, places = [], []
    for pair, n in enumerate([1, 2, 700, alignment.LIST_PLACES, alignment.LIST_PLACES + 1, 5]):
        pairs += [pair] * n
        places += sorted(rng.choice(alignment.BLOCK_DOCS, n, replace=False).tolist())
    found, counts, column = alignment.bitmaps(np.array(pairs), np.array(places))
    assert found.tolist() == list(range(6)) and max(len(b.as_py()) for b in column) == alignment.BLOCK_DOCS // 8
    assert alignment.places_of(counts, column).tolist() == places
    assert alignment.places_of(counts[2:5], column.slice(2, 3)).tolist() == places[3:-5]
    assert alignment.places_of(counts[:0], pa.array([], pa.binary())).tolist() == []


def test_empty_table(spark):
    got, pairs = alignment.align(spark.createDataFrame([], "doc_id long, text string"), JSON, MODEL, PATTERN)
    assert got.collect() == [] and pairs.collect() == []
