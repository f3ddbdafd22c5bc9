"""URL filter, components and line dedup: plain cases against brute force, and odd rows."""

import hashlib
import random
from collections import defaultdict
from urllib.parse import urljoin

import pytest

from reduxlab.llm import line_dedup, url_filter
from reduxlab.llm.components import components

PAGES = "page_id long, url string, html string"


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (None, 5), (7, None)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in list(parent)}


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def verdicts(spark, rows, **options):
    judged = url_filter.judge(spark.createDataFrame(rows, PAGES), **options).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged}


def test_rules_hosts_and_paths(spark):
    found = verdicts(
        spark,
        [
            (1, "https://Blog.Example.com/en/1?x", None),
            (2, "http://www.example.com/en/", "x"),
            (3, "http://example.com/EN/", "x"),
            (4, "http://notexample.com/en/", ""),
            (5, "x://a.net/es/#/fr/", ""),
            (6, "http://a.com", ""),
            (7, None, "x"),
            (8, "no scheme.com/", "x"),
            (9, "", None),
        ],
    )
    assert found == {
        1: ("blog.example.com", "/en/1", "example.com/en/", "block"),
        2: ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        3: ("example.com", "/EN/", "com/", "allow"),
        4: ("notexample.com", "/en/", "com/", "allow"),
        5: ("a.net", "/es/", "net/es/", "block"),
        6: ("a.com", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("", "", None, "allow"),
    }


def test_blocks_reach_aliases_and_allow_goes_first(spark):
    rows = [
        (1, "http://a.org/x", "<link rel=canonical href='https://b.example.com/en/q'>"),
        (2, "https://www.a.org/x/?utm_source=feed&ref=z#top", ""),
        (3, "http://c.org/1", '<link href="http://x.net/es/1" rel="canonical">'),
        (4, "http://d.org/1", '<META HTTP-EQUIV="Refresh" CONTENT="0; URL=http://www.example.com/en/5">'),
        (5, "http://d.org/2", "<link rel=canonical href=/1>"),
        (6, "http://d.org/3", "<link rel=canonical href=//c.org/1><meta http-equiv=refresh content='0;url=http://d.org/2'>"),
        (7, "http://alone.org/", "<link rel=stylesheet href=http://x.net/es/1>"),
        (7, "http://alone.org/", "<link rel=stylesheet href=http://x.net/es/1>"),
    ]
    found = {k: v[3] for k, v in verdicts(spark, rows).items()}
    # 3 is linked through 6, 5 and 4 to an allowed url, which outweighs the blocked one.
    assert found == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}


def test_relative_links_are_resolved_and_all_are_read(spark):
    bases = ["http://a.org/d/e?q=1#f", "http://a.org/d/e/", "http://a.org", "http://a.org?q=/x/", "http://a.org/x"]
    targets = ["page2.html", "../x", "?id=1", "#top", "./", "..", "../../../x", "a/./b/../c?x=/../y", ".hidden/..x", "x?next=http://q.org/"]
    targets += ["/a/../b", "/", "//h.org/x", "http://k.org/z"]
    links = "".join(f"<link rel=canonical href='{t}'>" for t in targets) + "<meta http-equiv=refresh content='0;url=r1'>" * 2
    rows = [(i, base, links + "<link rel=canonical href='mailto:x@y.org'>") for i, base in enumerate(bases)]
    found = url_filter.links_of(spark.createDataFrame(rows, PAGES)).collect()
    expected = [(b, urljoin(b, t), "canonical") for b in bases for t in targets] + [(b, urljoin(b, "r1"), "redirect") for b in bases] * 2
    assert sorted(tuple(r) for r in found) == sorted(expected)
    pages = [
        (1, "http://c.org/d/1", "<link rel=canonical href='../q/2'>"),
        (2, "http://c.org/q/2", "<meta http-equiv=refresh content='0;url=http://x.net/es/1'>"),
        (3, "http://b.org/1", "<link rel=canonical href=/2><link rel=canonical href=http://x.net/es/1>"),
        (4, "http://b.org/2", ""),
    ]
    assert {k: v[3] for k, v in verdicts(spark, pages).items()} == {1: "block", 2: "block", 3: "block", 4: "block"}


def test_given_edges_extra_columns_and_no_rows(spark):
    rows = [(1, "http://a.org/x", None, "mine", "theirs")]
    pages = spark.createDataFrame(rows, PAGES + ", host string, lang string")
    edges = spark.createDataFrame([("http://a.org/x", "http://m.net/fr/"), ("q", None)], "source string, target string")
    judged = url_filter.judge(pages, edges=edges)
    row = judged.first()
    assert judged.columns == ["page_id", "url", "html", "lang", "host", "path", "rule", "verdict"]
    assert (row.host, row.lang, row.verdict) == ("a.org", "theirs", "block")
    assert url_filter.report(pages.limit(0)).count() == 0


def test_unknown_action(spark):
    with pytest.raises(ValueError):
        url_filter.judge(spark.createDataFrame([], PAGES), rules=[("deny", "com/")]).count()


LONG = "this line is long enough to be compared"


def brute_lines(rows, min_docs=3, min_chars=20):
    split = [(doc, (text or "").split("\n")) for doc, text in rows]

    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)

    holders = defaultdict(set)
    for doc, lines in split:
        for line in lines:
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    out = []
    for doc, lines in split:
        kept = []
        for line in lines:
            held = holders.get(key(line), ())
            if len(held) < min_docs or doc == max(-1 if d is None else d for d in held):
                kept.append(line)
        text = "\n".join(kept)
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def line_rows():
    rng = random.Random(1)
    pool = [f"{LONG} number {i}" for i in range(12)] + ["short", "", "  ", "ÄÖ" * 9, "ÄÖ" * 10, "x" * 20]
    rows = []
    for doc in range(60):
        lines = [rng.choice([str.upper, str.title, lambda s: f" \t{s}\r"])(rng.choice(pool)) for _ in range(rng.randrange(9))]
        rows.append((doc, "\n".join(lines)))
    rows += [(7, rows[7][1]), (7, "another\n" + LONG + " number 1"), (60, None), (61, ""), (None, LONG + " number 2")]
    return rows + [(62, "\n".join([LONG + " number 3"] * 4000 + ["end"])), (63, "\n" * 5000)]


@pytest.mark.parametrize("options", [{}, {"batches": 1}, {"batches": 7, "fanout": 3}])
def test_line_dedup_as_brute_force(spark, options):
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = sorted((tuple(r) for r in line_dedup.report(docs, **options).collect()), key=repr)
    assert found == brute_lines(rows)


def test_line_dedup_keeps_other_columns(spark):
    rows = [(i, f"{LONG}\nonly {i}", "q", 5) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string, n_lines int")
    found = {r.doc_id: r for r in line_dedup.dedup(docs).collect()}
    assert set(found[0].asDict()) == {"doc_id", "text", "doc", "n_lines", "n_dropped"}
    assert [found[i].text for i in range(4)] == ["only 0", "only 1", "only 2", f"{LONG}\nonly 3"]
    assert found[0].n_lines == 2 and found[0].doc == "q"
    assert line_dedup.report(docs.limit(0)).count() == 0


def test_runs_hold_what_was_added(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    batches = [[(1, 1)], [(1, 1), (2, 2)], [(3, 3)], [(1, 1), (3, 3)], [(4, 4)]]
    unseen = []
    for number, keys in enumerate(batches):
        entries = spark.createDataFrame([(a, b, 1, number) for a, b in keys], "h1 long, h2 long, n_docs long, largest long")
        unseen.append(sorted(r.h1 for r in runs.unseen(entries).collect()))
        runs.add(entries)
    assert unseen == [[1], [2], [3], [], [4]]
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {(r.h1, r.n_docs, r.largest) for r in runs.entries().collect()} == {(1, 3, 3), (2, 1, 1), (3, 2, 3), (4, 1, 4)}
