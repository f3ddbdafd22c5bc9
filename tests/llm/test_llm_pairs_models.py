"""Jaccard join, vector search, language model, toxicity, WARC, pipeline: brute force and odd rows."""

import base64
import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reduxlab.llm import components as component_module
from reduxlab.llm import jaccard_join, pitman_yor, signature_tree, toxicity, vector_search, warc


def families(seed, count, copies=6, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(count):
        base = rng.choices(vocabulary, k=rng.randrange(1, words))
        for _ in range(rng.randrange(1, copies)):
            changed = [rng.choice(vocabulary) if rng.random() < 0.02 else w for w in base]
            texts.append(" ".join(changed[: rng.randrange(max(1, len(changed) - 4), len(changed) + 1)]))
    rng.shuffle(texts)
    return texts


def brute_classes(rows):
    def shingles(text):
        w = (text or "").encode().lower().split()
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = [shingles(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_id = {}
    for i, (doc, _) in enumerate(rows):
        if doc is None:
            continue
        for j in range(i):
            common = len(sets[i] & sets[j])
            linked = common and 100 * common >= 75 * len(sets[i] | sets[j])
            if rows[j][0] is not None and (linked or (rows[j][0] == doc and sets[i] and sets[j])):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            by_id.setdefault(root(i), []).append(doc)
    return Counter((doc, len(s), None if doc is None else min(by_id[root(i)]) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("unit_sets,heavy,few", [(512, 1000, 33), (3, 2, 33), (3, 1000, 2)])
def test_jaccard_join_as_brute_force(spark, monkeypatch, unit_sets, heavy, few):
    monkeypatch.setattr(jaccard_join, "HEAVY_ROWS", heavy)
    monkeypatch.setattr(jaccard_join, "FEW_ROWS", few)
    rows = list(enumerate(families(1, 40)))
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "few Words"), (n + 4, "FEW words"), (n + 5, "few words more")]
    rows += [(3, rows[3][1]), (4, rows[9][1]), (None, rows[2][1]), (n + 6, "repeat " * 5000), (n + 7, "repeat " * 7000), (n + 8, rows[2][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = Counter(tuple(r) for r in jaccard_join.report(docs, unit_sets=unit_sets).collect())
    assert found == brute_classes(rows)


def test_shingles_get_their_labels_before_they_are_exploded(spark, monkeypatch):
    plans, partners = [], jaccard_join._partners

    def seen(rows, *options):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return partners(rows, *options)

    monkeypatch.setattr(jaccard_join, "_partners", seen)
    rows = list(enumerate(families(1, 6, copies=20)))
    found = jaccard_join.report(spark.createDataFrame(rows, "doc_id long, text string"), unit_sets=3).collect()
    assert len(found) == len(rows)
    # The nodes of a plan come from the last one to the first: no join sees single shingles.
    assert plans and all("Join" in plan and plan.index("Generate") < plan.index("Join") for plan in plans)


def test_long_chains_take_few_passes(spark, monkeypatch):
    passes, stored = [], component_module.stored
    monkeypatch.setattr(component_module, "stored", lambda df, label: passes.append(label) or stored(df, label))
    edges = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(4)
    found = component_module.components(edges)
    assert found.count() == 3001 and found.agg(F.max("component")).first()[0] == 0
    assert len(passes) <= 1 + 3 * 4


def test_one_of_each_class_stays(spark):
    rows = [(5, "a b c d e f", "x"), (2, "A b c d e f", "y"), (9, "other words", "z"), (None, "a b c d e f", "n"), (7, None, "e"), (8, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    assert sorted((tuple(r) for r in jaccard_join.keep_one(docs).collect()), key=repr) == sorted(rows[1:], key=repr)
    assert jaccard_join.report(docs.limit(0)).count() == 0


def test_repeated_ids_lose_only_rows_that_have_a_copy(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "other words here"), (2, "other words here"), (3, "A b c d e F"), (None, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in jaccard_join.keep_one(docs).collect()), key=repr)
    assert got == sorted([rows[0], rows[2], rows[5]], key=repr)


def test_bitmaps_never_promise_too_little():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n, m = rng.integers(1, 400, 2)
        pool = rng.integers(0, 1 << 62, 500, dtype=np.uint64)
        sets = [np.unique(rng.choice(pool, size)) for size in (n, m)]
        maps = []
        for values in sets:
            bits = np.zeros(1 << max(8, (4 * len(values)).bit_length()), dtype=bool)
            bits[(values & np.uint64(len(bits) - 1)).astype(int)] = True
            maps.append(np.packbits(bits, bitorder="little").tobytes())
        bound = jaccard_join.most_overlap(len(sets[0]), maps[0], len(sets[1]), maps[1])
        common = len(np.intersect1d(*sets))
        assert common <= bound <= min(map(len, sets)) and bound <= common + 150


@pytest.mark.parametrize("seed", range(3))
def test_signature_tree_finds_all_links(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(25):
        base = rng.integers(0, 1 << 63, int(rng.integers(1, 300)), dtype=np.uint64)
        for _ in range(int(rng.integers(1, 9))):
            own = np.where(rng.random(len(base)) < 0.08, rng.integers(0, 1 << 63, len(base), dtype=np.uint64), base)
            sets.append(np.unique(own))
    sets.append(np.zeros(0, dtype=np.uint64))

    def classes(pairs):
        label = np.arange(len(sets))
        for a, b in pairs:
            label[label == label[b]] = label[a]
        return {tuple(np.flatnonzero(label == x)) for x in set(label.tolist())}

    every = [
        (a, b)
        for a in range(len(sets))
        for b in range(a)
        if len(sets[b]) and signature_tree.overlap(sets[a], sets[b]) >= signature_tree.needed(len(sets[a]), len(sets[b]), 75)
    ]
    assert classes(signature_tree.links(sets, range(len(sets)), 75)) == classes(every)
    side = rng.integers(0, 2, len(sets))
    assert classes(signature_tree.links(sets, range(len(sets)), 75, side)) == classes([p for p in every if side[p[0]] != side[p[1]]])


def test_search_recall_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    vectors = [v / np.linalg.norm(v) for v in rng.normal(size=(1500, 32))]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(2000 + i, rows[40][1]) for i in range(30)]
    odd = [(3000, None), (3020, []), (3040, [0.0] * 32), (3060, [None] + [1.0] * 31), (3080, [math.nan] + [1.0] * 31), (3100, [math.inf] * 32), (None, rows[1][1])]
    table = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, rank int").repartition(5)
    found = vector_search.search(*[vector_search.usable(table)] * 2, block_rows=400).filter("query_id % 20 = 0").collect()
    ids, matrix = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    answers = defaultdict(list)
    for r in found:
        answers[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = np.zeros(len(ids))
        for d in range(32):
            scores += matrix[:, d] * matrix[q, d]
        best = [k for k in np.lexsort((ids, -scores)) if k != q][:20]
        mine = sorted(answers.pop(ids[q]))
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(m[2] == scores[np.flatnonzero(ids == m[1])[0]] for m in mine)
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        hits += len({m[1] for m in mine} & set(ids[best].tolist()))
        total += 20
        if ids[q] == 40:
            assert [m[1] for m in mine] == list(range(2000, 2020))
    assert not answers and hits / total >= 0.95


def test_search_of_few_or_other_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [1.0, 1.0]), (40, [1.0, 0.0, 0.0]), (40, [3.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = [tuple(r) for r in vector_search.report(table).orderBy("query_id", "rank").collect()]
    assert [f for f in found if f[0] == 0] == [(0, 1, 40, 3.0), (0, 2, 3, 1.0), (0, 3, 20, 0.0)]
    assert vector_search.report(table.limit(0)).count() == 0


def lm_rows():
    rng = random.Random(8)
    rows = []
    for i in range(120):
        nouns = [f"n{k}en" for k in range(40)] if i % 2 else [f"v{k}ly" for k in range(40)]
        rows.append((i, " ".join(rng.choice(nouns) for _ in range(rng.randrange(60)))))
    rows += [(500, None), (501, ""), (3, rows[3][1]), (None, "The n1en the"), (502, "Unseen" * 3 + " N1EN\x0b " + "w " * 3000)]
    return rows


@pytest.mark.parametrize("block_tokens", [300, 1_500_000])
def test_language_model_counts_and_perplexity(spark, monkeypatch, block_tokens):
    monkeypatch.setattr(pitman_yor, "BLOCK_TOKENS", block_tokens)
    rows = lm_rows()
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    scored = pitman_yor.report(docs).cache()

    def held(doc):
        return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2

    tokens = [(doc, [*(text or "").encode().lower().split(), None]) for doc, text in rows]
    counts = Counter(t for doc, ts in tokens if not held(doc) for t in ts)
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        ((d, held(d), len(ts), sum(counts[t] > 0 for t in ts), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts), 6)) for d, ts in tokens),
        key=repr,
    )
    got = scored.collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == expected
    for r in pitman_yor.perplexity(scored).collect():
        assert r.perplexity < 0.8 * r.base_perplexity


def test_predictions_of_a_context_add_up_to_one():
    rng = np.random.default_rng(0)
    words, contexts = 50, 64
    pairs = np.arange(words * contexts)
    counts = rng.poisson(0.7, len(pairs)) * rng.integers(1, 30, len(pairs))
    seating = pitman_yor.Seating(pairs, counts, words, contexts)
    for number in range(4):
        totals = pitman_yor.Totals(seating.summary())
        seating.sweep(totals, np.random.default_rng(number))
        assert (seating.tables <= counts).all() and ((seating.tables > 0) == (counts > 0)).all()
        assert (seating.root <= seating.root_customers()).all()
        totals = pitman_yor.Totals(seating.summary())
        chance = seating.predictive(totals).reshape(words, contexts)
        rest = (pitman_yor.STRENGTH[1] + totals.root_discount * totals.root_tables) / (totals.known + 1)
        rest /= pitman_yor.STRENGTH[1] + totals.root_customers
        new = (pitman_yor.STRENGTH[0] + totals.discount * totals.tables) * rest / (pitman_yor.STRENGTH[0] + totals.customers)
        assert np.allclose(chance.sum(axis=0) + new, 1)


def test_sweeps_do_not_send_hashes_again(spark, monkeypatch):
    sent, stored = [], pitman_yor.stored

    def seen(df, label, *options):
        rows, path = stored(df, label, *options)
        if label == "lm-seats":
            sent.append(rows.select(F.explode("sums").alias("held")).agg(F.sum(F.length("held"))).first()[0])
        return rows, path

    monkeypatch.setattr(pitman_yor, "stored", seen)
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(300))) for i in range(100)]
    assert pitman_yor.report(spark.createDataFrame(rows, "doc_id long, text string")).count() == 100
    # About 30000 pairs, nearly each of a context that its bucket has once: a hash alone would take eight bytes.
    assert sent and max(sent) < 60_000


def test_contexts_are_whole_words(spark):
    # All first words end alike, so only the whole word tells which one follows.
    rng = random.Random(9)
    rows = []
    for i in range(1200):
        k = rng.randrange(200)
        rows.append((i, f"a{k}xyz b{k}xyz"))
    scored = pitman_yor.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    mean = sum(r.score for r in scored if r.held_out) / sum(r.held_out for r in scored)
    # The first word is one of 200, the rest is certain but for smoothing.
    assert mean > -math.log10(200) - 2.0


def test_language_model_without_rows_or_training(spark):
    schema = "doc_id long, text string"
    assert pitman_yor.report(spark.createDataFrame([], schema)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = pitman_yor.report(spark.createDataFrame([(held, "a b")], schema)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


def test_chain_learns_planted_words(spark):
    rng = random.Random(6)
    neutral = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = rng.choices(neutral, k=rng.randrange(5, 120))
        toxic, low = rng.random() < 0.2, rng.random() < 0.3
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["Idiot!", "scumette", "scumling", "scumhood"]))
        if low:
            text += ["buy"] * 3
        rows.append((i, " ".join(text), "en" if i % 3 else "de"))
        if i % 2:
            labels.append((i, int(not low), int(toxic)))
    labels += [(1, None, 1), (2000, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([*rows, (901, None, None), (902, "", "en"), (903, "scumnew " + "word1 " * 40000, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, labels)
    judged = {r.doc_id: r for r in chain.classify(docs.withColumn("is_toxic", docs.doc_id)).collect()}
    wrong = [i for i, text, _ in rows if judged[i].is_toxic != ("idiot" in text.lower() or "scum" in text)]
    assert len(wrong) <= 0.01 * len(rows) and judged[903].is_toxic
    assert not judged[901].is_toxic and judged[901].p_toxic == judged[902].p_toxic
    assert min(chain.f1[:2]) > 0.9
    assert all(0 <= r.p_low_quality <= 1 for r in judged.values())
    assert toxicity.report(docs.limit(0), labels).count() == 0


def test_chain_of_labels_that_are_all_alike(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en") for i in range(30)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        judged = toxicity.report(docs, known).collect()
        assert len(judged) == 30 and not any(r.is_toxic or r.is_low_quality for r in judged)


PAGES = [
    (1, "http://a.org/dir/page", '<html><head><title>A &amp; B</title><style>p{}</style></head><body><!-- no --><p>One<br>two &lt;3</p>'
     '<script>var t="</p>";</script><a href="/x">link</a><a href=\'y?q=1&amp;r=2\'>more</a></body>'),
    (2, None, None), (3, "", ""), (4, "http://b.org/", "plain & simple"), (5, "http://c.org/", "<p>" + "x " * 100000 + "<script>never closed"),
    (4, "http://b.org/", "plain & simple"),
]


def test_warc_derivatives_link_and_keep(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "q") for p in PAGES], "page_id long, url string, html string, block string").repartition(2)
    responses = {r.page_id: r for r in warc.responses(pages).collect()}
    records = warc.report(pages)
    by = defaultdict(list)
    for r in records.collect():
        by[r.page_id, r.warc_type].append(r)
    assert {k: len(v) for k, v in by.items()} == {(p, t): 1 + (p == 4) for p in range(1, 6) for t in ("metadata", "conversion")}
    for (page, kind), found in by.items():
        r, source = found[0], responses[page]
        block = bytes(r.block)
        assert (r.refers_to, r.target_uri, r.warc_date) == (source.record_id, source.target_uri, source.warc_date)
        assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() and r.content_length == len(block)
        payload = bytes(source.block).split(b"\r\n\r\n", 1)[1]
        assert r.source_payload_digest == warc.digest(payload) and r.source_block_digest == warc.digest(bytes(source.block))
        assert payload.decode() == (dict((p, h) for p, _, h in PAGES)[page] or "")
        if kind == "metadata":
            assert r.concurrent_to == by[page, "conversion"][0].record_id
    assert bytes(by[1, "conversion"][0].block).decode() == "One\ntwo <3\nlinkmore"
    lines = bytes(by[1, "metadata"][0].block).decode().split("\r\n")
    assert lines[:3] == ["title: A & B", "http-status: HTTP/1.1 200 OK", "http-header-content-type: text/html; charset=utf-8"]
    assert lines[-3:] == ["outlink: http://a.org/x L a/@href", "outlink: http://a.org/dir/y?q=1&r=2 L a/@href", ""]
    assert bytes(by[2, "conversion"][0].block) == b"" and by[2, "conversion"][0].target_uri is None
    for compression in ("gzip", "none"):
        path = str(tmp_path / compression)
        warc.write_warc(records, path, compression)
        back = warc.read_warc(spark, path).collect()
        assert Counter((r.header["WARC-Record-ID"], bytes(r.block)) for r in back) == Counter((r.record_id, bytes(r.block)) for rs in by.values() for r in rs)
        assert all(r.header["WARC-Refers-To"] == by[1, "metadata"][0].refers_to for r in back if r.header.get("WARC-Target-URI") == PAGES[0][1])
    assert warc.report(pages.limit(0)).count() == 0


def test_hostile_pages_take_linear_time_and_end():
    start = time.perf_counter()
    for piece in ("<a ", "<", "<p ", "<title ", "</div ", "<a href=\"", "<!-- ", "<a href='x>' ", "<script "):
        for page in (piece * (1_000_000 // len(piece)), piece * (1_000_000 // len(piece)) + ">"):
            warc.plain_text(page), warc.title_of(page), warc.links_of(page, "http://a.b/")
    assert time.perf_counter() - start < 30


def test_anchors_and_titles():
    page = "<A class=x HREF=one.html>1</a><a\nhref = 'two>2.html'>2</a><a title='>' href=no><a href=\"three\">3<abbr href=no>"
    assert warc.links_of(page, "http://a.b/c/") == ["http://a.b/c/one.html", "http://a.b/c/two>2.html", "http://a.b/c/three"]
    assert warc.links_of("text <a href=open.html", "http://a.b/") == ["http://a.b/open.html"]
    assert warc.title_of("<title>a &amp;\n b</TITLE >c") == "a & b" and warc.title_of("<title x>open <b") == "open <b"
    assert warc.title_of("<title no end") == "" and warc.plain_text("a < b <i>c</i> <p") == "a < b c <p"


def test_charsets_that_do_not_fit():
    for charset in ("undefined", "utf-7", "unicode_escape", "idna", "hex", "utf-16", "no-such"):
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={charset}\r\n\r\n".encode() + b"<p>+2AA- \\ud800 \xff text"
        rows = list(warc.derivatives("<urn:x>", "http://a.b/", warc.FETCHED, block))
        assert len(rows) == 2


def test_other_charsets():
    block = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<p>é".encode("latin-1")
    meta, text = warc.derivatives("<id>", "http://a/", "d", block)
    assert text[-1] == "é".encode()
    bad = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=nothing\r\n\r\n\xff"
    assert list(warc.derivatives("<id>", None, "d", bad))[1][-1] == "�".encode()


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    item = " ".join(f"q{i}" for i in range(14))
    neutral = [f"word{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(400):
        text = " ".join(rng.choices(neutral, k=rng.randrange(20, 80)))
        if i % 5 == 0:
            text += rng.choice([" idiot", " moron"])
        if i % 7 == 1:
            text += " " + item.upper()
        if i % 2:
            text += "\nthis footer line is on many pages"
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
        if i < 250:
            labels.append((i, 1, int(i % 5 == 0)))
    rows += [(1000 + i, rows[12][1], "en", "src0", rows[12][4]) for i in range(20)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    texts = dict((r[0], r[1]) for r in rows)
    expected = {i for i in texts if not (i < 400 and i % 5 == 0)}
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        if name == "line_dedup":
            found = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
            last = max(i for i in expected if i < 400 and i % 2)
            for i in expected:
                text = texts[i] if i == last or i > 400 else (texts[i] or "").split("\nthis footer")[0]
                # The copies are single lines found in many documents; only the largest id keeps it.
                if i in (12, *range(1000, 1019)):
                    text = ""
                assert found[i] == (text, None if text is None else len(text))
        if name == "decontamination":
            expected -= {i for i in expected if i < 400 and i % 7 == 1}
        assert {r.doc_id for r in kept.select("doc_id").collect()} == expected
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in result} == expected
    assert len({(r.sequence_id, r.offset) for r in result}) == len(result)
