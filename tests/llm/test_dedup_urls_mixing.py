import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import dedup, mixing, urls
from tessera.llm.graph import connected_components
from tessera.llm.queries import URL_RULES

DOCS = "doc_id long, text string, source string, kept string, row long"


def test_misra_gries_keeps_what_is_frequent():
    rng = random.Random(3)
    rows = ["a"] * 400 + ["b"] * 300 + [f"x{i}" for i in range(300)]
    rng.shuffle(rows)
    counts = {}
    for i in range(0, 1000, 50):
        part = rows[i : i + 50]
        counts = dedup.merge_summary(counts, [(k, part.count(k)) for k in set(part)], 4)
    assert {"a", "b"} <= set(counts) and len(counts) <= 4
    assert all(rows.count(k) - 1000 / 5 <= n <= rows.count(k) for k, n in counts.items())


@pytest.mark.parametrize("counters", [1, 1024])
def test_exact_duplicates(spark, counters):
    rows = [(i, f"text {i % 7}" if i % 3 else "hot", "s", "x", i) for i in range(300)]
    rows += [(500, None, "s", "x", 1), (501, "", "s", "x", 2), (None, "hot", "s", "x", 3), (299, "text 5", "s", "x", 4), (7, "long " * 50_000, "s", "x", 5)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    found = dedup.exact_duplicates(docs, counters=counters).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(found) == len(rows)
    for r in found:
        ids = sha[r.text_sha256]
        assert (r.group_size, r.keep_id) == (len(ids), max(i for i in ids if i is not None))
    assert sum(r.kept for r in found) == len(groups)
    assert all(r.doc_id == r.keep_id for r in found if r.kept)
    left = dedup.drop_exact_duplicates(docs, counters=counters)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(max(i for i in ids if i is not None) for ids in groups.values())


def test_exact_duplicates_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    assert dedup.exact_duplicates(docs).count() == 0 and dedup.drop_exact_duplicates(docs).count() == 0


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    found = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.node: r.component for r in found} == {x: root(x) for x in list(parent)} and len(found) == len(parent)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


PAGES = [
    (1, "http://a.example.org/es/1", ""),
    (2, "https://other.net/x?y=1#z", '<link rel="canonical" href="http://a.example.org/es/1">'),
    (3, "https://third.net", '<META content="0; url=https://other.net/x?y=1" http-equiv="refresh">'),
    (4, "http://b.com/fr/q", "<link href='http://a.example.org/es/1' rel='canonical'>"),
    (5, "http://B.COM/de/q", None),
    (6, "no url", "<link rel=canonical href=/x>"),
    (7, None, None),
    (8, "http://example.org/en/17", ""),
    (9, "ftp://notexample.org/es/2", ""),
    (9, "ftp://free.net/page/one", "<link rel=canonical href=two>"),
    (10, "http://free.net/page/two", ""),
]


def test_urls(spark):
    got = {(r.page_id, r.host): (r.path, r.rule, r.verdict) for r in urls.judge_urls(spark.createDataFrame(PAGES, "page_id long, url string, html string"), URL_RULES).collect()}
    assert got == {
        (1, "a.example.org"): ("/es/1", "example.org/es/", "block"),
        (2, "other.net"): ("/x", None, "block"),
        (3, "third.net"): ("", None, "block"),
        (4, "b.com"): ("/fr/q", "com/fr/", "allow"),
        (5, "b.com"): ("/de/q", "com/de/", "block"),
        (6, ""): ("", None, "allow"),
        (7, ""): ("", None, "allow"),
        (8, "example.org"): ("/en/17", "example.org/en/1", "block"),
        (9, "notexample.org"): ("/es/2", "org/", "allow"),
        (9, "free.net"): ("/page/one", None, "allow"),
        (10, "free.net"): ("/page/two", None, "allow"),
    }


def test_rules_are_asked_of_addresses_that_are_no_page(spark):
    pages = spark.createDataFrame([(1, "http://free.net/a", "<link rel=canonical href=http://example.org/es/1>"), (2, "http://kept.org/b", "<link rel=canonical href=http://example.org/es/1>"), (3, "http://lone.net/", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(pages, URL_RULES).collect()}
    assert got == {1: (None, "block"), 2: ("org/", "allow"), 3: (None, "allow")}
    edges = spark.createDataFrame([("lone.net/", "mid.net/"), ("mid.net/", "site.com/de/x?q=1")], "src string, dst string")
    assert {r.page_id: r.verdict for r in urls.judge_urls(pages, URL_RULES, edges=edges).collect()} == {1: "block", 2: "allow", 3: "block"}
    many = URL_RULES + [("block", f"site{i}.test", "/") for i in range(urls.INLINE_RULES)]
    assert {r.page_id: r.verdict for r in urls.judge_urls(pages, many, edges=edges).collect()} == {1: "block", 2: "allow", 3: "block"}


def test_unclosed_tags_take_linear_time(spark):
    html = ["<link " + "canonical " * 200_000, "<link rel=canonical " * 100_000, "<meta http-equiv=refresh " + " " * 2_000_000]
    pages = spark.createDataFrame([(i, f"http://h{i}.net/", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    began = time.time()
    assert urls.judge_urls(pages, URL_RULES).where("verdict = 'allow'").count() == 3
    assert time.time() - began < 30


def test_many_rules_are_joined(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rules = URL_RULES + [("block", f"site{i}.test", "/") for i in range(urls.INLINE_RULES)]
    key = lambda df: sorted(map(str, df.collect()))
    assert key(urls.judge_urls(pages, rules)) == key(urls.judge_urls(pages, URL_RULES))
    assert urls.judge_urls(pages.limit(0), rules).count() == 0


def test_source_targets():
    assert mixing.source_targets([("b", 60), ("a", 60), (None, 60)]) == {"a": 30.0, "b": 60.0, None: 90.0}
    got = mixing.source_targets([("a", 1), ("b", 1000), ("c", 10)])
    assert got["a"] == 3 and got["c"] == 30 and abs(sum(got.values()) - 1011) < 1e-6
    assert mixing.source_targets([]) == {}


def brute_targets(sizes, names):
    """Water filling by bisection: each source gets the lesser of its weight's share of a level and three times its size."""
    weight, total = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(sizes.values())
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * sizes[s], weight[s] * mid) for s in names) < total else (low, mid)
    return {s: min(3 * sizes[s], weight[s] * high) for s in names}


def test_sources_without_words_have_a_weight(spark):
    docs = spark.createDataFrame([(1, "", "a", 0)] + [(i, "w " * 20, s, 0) for i in range(2, 102) for s in ("b", "c")], "doc_id long, text string, source string, draw int")
    got = {r.source: (r.source_size, r.target) for r in mixing.mix_decisions(docs).collect()}
    assert got["a"] == (0, 0.0) and got["b"] == (2000, 1600.0) and got["c"] == (2000, 2400.0)
    assert {r.source: r.target for r in mixing.mix_decisions(docs.where("source = 'a'")).collect()} == {"a": 0.0}


def test_mix_follows_the_pareto_order(spark):
    """Against a plain version: all documents of a source in a list, sorted by rank."""
    rng = random.Random(9)
    rows = [(i if i % 7 else None, "w " * rng.choice([0, 1, 2, 5, 40, 300]) + f"x{i}", rng.choice(["a", "b", "c"]) if i % 3 else "hot", "k", i) for i in range(1500)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    light = mixing._sized(docs, 7, "doc_id", "source", "text", F.col("row")).collect()
    got = {r.row: r.copies for r in mixing.plan_mix(spark.createDataFrame(light)).copies(spark.createDataFrame(light)).collect()}
    names = sorted({r.s for r in light})
    target = brute_targets({s: sum(r["size"] for r in light if r.s == s) for s in names}, names)
    for s in names:
        own = [r for r in light if r.s == s]
        keen = {r.row: r["size"].bit_length() - (r["size"] + 1).bit_length() + 2 * (r["size"] + 1).bit_length() - r["size"].bit_length() for r in own}  # 1 + floor(log2(size + 1))
        low, high = 0.0, 1e9
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(3, mid * keen[r.row]) * r["size"] for r in own) < target[s] else (low, mid)
        want, ranked, need = {}, [], target[s]
        for r in own:
            copies = min(3.0, high * keen[r.row])
            want[r.row] = int(copies + 1e-9)
            need -= want[r.row] * r["size"]
            if copies - want[r.row] > 1e-9:
                p, u = copies - want[r.row], (((r.draw & (2**64 - 1)) >> 11) + 0.5) / 2**53
                ranked.append((u / (1 - u) * (1 - p) / p, r.row, r["size"]))
        skipped = []
        for _, row, size in sorted(ranked):
            if size <= need:
                want[row] += 1
                need -= size
            else:
                skipped.append((abs(need - size), row, size))
        first_that_is_too_long = max((n for _, _, n in skipped), default=0)
        mine = {r.row: got[r.row] for r in own}
        differ = [r for r in own if mine[r.row] != want[r.row]]
        assert len(differ) <= mixing.NEXT_ROWS and abs(sum(got[r.row] * r["size"] for r in own) - target[s]) <= first_that_is_too_long / 2 + 1


def test_columns_with_the_operators_own_names_stay(spark):
    names = ["row", "size", "draw", "copies", "s", "of", "odds", "text_sha256", "keep", "often", "n", "id", "best", "key"]
    docs = spark.createDataFrame([(i, f"text {i % 5} of some length", "src", *[500 + k for k in range(len(names))]) for i in range(20)], "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in names))
    for found in (dedup.drop_exact_duplicates(docs), mixing.mix_documents(docs)):
        assert found.columns == docs.columns
        assert {tuple(r)[3:] for r in found.collect()} == {tuple(500 + k for k in range(len(names)))}
    assert dedup.drop_exact_duplicates(docs).count() == 5
    assert dedup.exact_duplicates(docs).count() == 20 and mixing.mix_decisions(docs.withColumnRenamed("copies", "target")).count() == 20


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 120)), rng.choice(["x", "y", "z", None]) if i % 3 else "hot", "k", i) for i in range(3000)]
    rows += [(9000, None, "x", "k", 0), (9001, "", "lonely", "k", 0), (None, "a b c", "x", "k", 0), (5, "same words here", "x", "k", 0), (5, "same words here", "x", "k", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    found = mixing.mix_decisions(docs)
    got = found.collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix_decisions(docs.repartition(7)).collect()))
    assert all(r.taken <= 3 * r.size for r in got)
    for s in ("hot", "x", "y", "z", None):
        own = [r for r in got if r.source == s]
        assert own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 60
    names = ["hot", "lonely", "x", "y", "z", None]  # by code point, null last; a source without words has its weight too
    want = brute_targets({s: sum(r.size for r in got if r.source == s) for s in names}, names)
    assert all(np.isclose(r.target, want[r.source]) for r in got) and want["lonely"] == 0
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix_decisions(docs.limit(0)).count() == 0 and mixing.mix_documents(docs.limit(0)).count() == 0


def test_long_documents_are_taken_more_often(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('w ', int(if(id % 2 = 0, 4, 400))) AS text", "if(id < 2000, 'a', 'b') AS source")
    found = mixing.mix_decisions(docs, weights=(1, 1, 1), share=0.5).groupBy("size").agg(F.avg("copies").alias("c")).collect()
    by = {r["size"]: r.c for r in found}
    assert by[400] > by[4]
