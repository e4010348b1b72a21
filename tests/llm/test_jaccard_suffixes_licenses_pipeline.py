import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import jaccard, licenses, mixing, packing, shingles, suffixes
from tessera.llm.common import WORD

DOCS = "doc_id long, text string, n long, sid string"


def words_of(text):
    return re.findall(WORD, text.translate({c: c + 32 for c in range(65, 91)})) if text else []


def shingles_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_word_hashes_know_words():
    text = "The the\tTHE  a\x0bb é É x\xa0y \x1cz"
    h = shingles.word_hashes(text).tolist()
    w = words_of(text)
    assert len(h) == len(w) and all((h[i] == h[j]) == (w[i] == w[j]) for i in range(len(w)) for j in range(len(w)))
    assert len(shingles.word_hashes(" \n")) == 0


def test_long_texts_hash_like_short_ones(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000)) + " " + "Q" * 5000 + " end"
    whole = shingles.word_hashes(text)
    monkeypatch.setattr(shingles, "SEGMENT", 1000)
    assert (np.delete(shingles.word_hashes(text), 3000) == np.delete(whole, 3000)).all()
    assert (shingles.word_hashes(text + " " + "q" * 5000)[[3000, 3002]] == shingles.word_hashes(text)[3000]).all()


def test_sets_of_many_texts_are_those_of_each(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "Be", "sea\u00e9", "x" * 40]) + str(rng.randrange(9)) for _ in range(rng.choice([0, 1, 2, 4, 5, 6, 80, 700]))) for _ in range(300)] + [None, "", " ", "\t\n x \n", "Q" * 5000, "y " * 3000]
    rng.shuffle(texts)
    for segment in (1 << 20, 2500):
        monkeypatch.setattr(shingles, "SEGMENT", segment)
        for width in (5, 1, 3):
            many = shingles.shingle_sets(texts, width)
            assert len(many) == len(texts) and all((a == shingles.shingle_set(t, width)).all() and len(a) == len(shingles.shingle_set(t, width)) for a, t in zip(many, texts, strict=True))
    sets = [shingles.shingle_set(t) for t in texts]
    ids = jaccard._set_ids(sets)
    assert ids == [jaccard._set_id(s) for s in sets] and [i is None for i in ids] == [not len(s) for s in sets] and jaccard._set_ids([]) == []
    assert len({i for i in ids if i}) == len({tuple(s) for s in map(tuple, sets) if s})


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(60):
        rows.append([word() for _ in range(rng.choice([1, 3, 5, 6, 20, 80, 200]))])
    for base in ([word() for _ in range(150)], [word() for _ in range(60)]):
        rows.append(base)
        for _ in range(120):  # more copies than a token may have before it counts as common
            edited = list(base)
            for _ in range(rng.randrange(0, 9)):
                edited[rng.randrange(len(edited))] = word()
            rows.append(edited)
    for _ in range(50):
        rows.append([word() for _ in range(rng.randrange(5, 60))] + passage + [word() for _ in range(rng.randrange(5, 60))])
    chain = [word() for _ in range(100)]
    for k in range(12):
        rows.append(chain[k * 3 : k * 3 + 64])
    rows += [rows[5], rows[70]]
    rng.shuffle(rows)
    texts = [" ".join(w) for w in rows] + [None, "", " \t\n", "One two", "one TWO", "one"]
    return [(i * 3 + 1, t, 0, "x") for i, t in enumerate(texts)]


def brute_components(rows):
    sets = [(i, shingles_of(t)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if x and y and 100 * both >= 75 * len(x | y):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (len(x), root(i)) for i, x in sets}


@pytest.mark.parametrize("group,salt,most", [(32, 50_000, 1_000_000), (2, 10, 1_000_000), (3, 20, 50)])
def test_near_duplicates(spark, monkeypatch, group, salt, most):
    monkeypatch.setattr(jaccard, "GROUP", group)
    monkeypatch.setattr(jaccard, "SALT_ROWS", salt)
    monkeypatch.setattr(jaccard, "COMMON_MOST", most)
    rows = corpus(group)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    found = jaccard.near_duplicates(docs).collect()
    want = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want and len(found) == len(rows)
    left = jaccard.keep_one_of_each(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted({c for _, c in want.values()})


def _same_components(spark, rows):
    found = jaccard.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    want = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want and len(found) == len(rows)
    return want


def test_sets_of_sizes_inside_a_band_link(spark):
    """30 pairs of a set of 6 shingles and one of 7 that holds it, each with short texts that lead the lists of its tokens."""
    rows, n = [], 0
    for pair in range(30):
        base = [f"p{pair}w{k}" for k in range(10)]
        texts = [base, base + [f"p{pair}end"]]
        for k in range(12):
            texts.append(base[k % 6 : k % 6 + 5] + [f"p{pair}q{k}"])
        for t in texts:
            rows.append((n, " ".join(t), 0, "x"))
            n += 1
    want = _same_components(spark, rows)
    assert sum(want[14 * p + 1][1] == 14 * p for p in range(30)) == 30


@pytest.mark.parametrize("seed", [1, 2])
def test_random_phrases(spark, seed):
    """Short texts of a few phrases in changing order, many of them just above or below the threshold."""
    rng = random.Random(seed)
    phrases = [[f"f{p}w{k}" for k in range(rng.randrange(3, 12))] for p in range(25)]
    rows = []
    for i in range(1200):
        text = [w for p in rng.choices(phrases, k=rng.randrange(1, 5)) for w in p]
        if rng.random() < 0.5:
            text.insert(rng.randrange(len(text) + 1), f"own{rng.randrange(300)}")
        rows.append((i * 2, " ".join(text), 0, "x"))
    _same_components(spark, rows)


@pytest.mark.parametrize("bits", [6, 8])
def test_leaders_are_sought_in_shortened_lists(spark, monkeypatch, bits):
    """2^bits near copies that share all their tokens: each is in as many lists as it takes to meet in one, however large the group."""
    made, pairs = [], jaccard._leader_pairs

    def counted(postings, turn):
        found = pairs(postings, turn)
        made.append(found.agg(F.sum("shared")).first()[0])
        return found

    monkeypatch.setattr(jaccard, "_leader_pairs", counted)
    rows = []
    for i in range(2**bits):
        rows.append((i, " ".join(f"{'x' if w % 12 == 5 and i >> (w // 12) & 1 else 'w'}{w}" for w in range(100)), 0, "x"))
    want = _same_components(spark, rows)
    assert set(want.values()) == {(96, 0)}
    prefix, must = 96 - 72 + 13, 72 - (72 - 1 - 12)  # with the smallest partner, of 72 tokens
    assert sum(made) <= 2**bits * (prefix - must + jaccard.FEW)


def test_columns_with_the_operators_own_names_stay(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g h" + " i" * (i % 2), 500, 501, 502, 503) for i in range(6)], "doc_id long, text string, __id int, __key int, row int, key int")
    left = jaccard.keep_one_of_each(docs)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(0, "a b c d e f g h", 500, 501, 502, 503)]


def test_near_duplicates_of_odd_rows(spark):
    rows = [(5, "a b c d e f g", 0, ""), (5, "a b c d e f g", 0, ""), (None, "A b c d e f g", 0, ""), (2, "a b c d  e f g", 0, ""), (None, None, 0, ""), (9, "word " * 30_000, 0, ""), (8, "word " * 9, 0, "")]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    key = lambda r: str(r)
    assert sorted([tuple(r) for r in found], key=key) == sorted([(5, 3, 2), (5, 3, 2), (None, 3, 2), (2, 3, 2), (None, 0, None), (9, 1, 8), (8, 1, 8)], key=key)
    twice = spark.createDataFrame([(1, "a b c d e f g", 0, ""), (2, "a b c d e f g", 0, ""), (2, "another text with this id", 0, "")], DOCS)
    assert sorted((r.doc_id, r.text[:3]) for r in jaccard.keep_one_of_each(twice).collect()) == [(1, "a b"), (2, "ano")]
    empty = spark.createDataFrame([], DOCS)
    assert jaccard.near_duplicates(empty).count() == 0 and jaccard.keep_one_of_each(empty).count() == 0
    assert jaccard.near_duplicates(spark.createDataFrame([(1, None, 0, "")], DOCS)).count() == 1


def test_least_shared_tokens_of_a_band(spark):
    must = lambda n, m: -(-(n + m) * 75 // 175) - np.maximum(-(-n * 75 // 100) - 1 - n // 8, -(-m * 75 // 100) - 1 - m // 8)
    rows = []
    for n in [*range(1, 400), *range(5000, 5056), *range(20_000, 20_056)]:
        for step in range(-jaccard._REACH, jaccard._REACH + 1):
            at = int(np.log(n) // np.log(jaccard._BAND)) + step
            low, high = max(int(jaccard._BAND**at), -(-n * 75 // 100)), min(int(np.ceil(jaccard._BAND ** (at + 1))), n * 100 // 75)
            if low <= high:
                rows.append((n, low, high, int(must(n, np.arange(low, high + 1)).min())))
    bands = spark.createDataFrame(rows, "n long, low long, high long, want long")
    assert bands.where(jaccard._least_must_share(F.col("n"), F.col("low"), F.col("high")) != F.col("want")).count() == 0
    assert sum(min(must(n, a), must(n, b)) > w for n, a, b, w in rows) > 100


def test_partners_of_sizes_inside_a_band(spark):
    sets = spark.createDataFrame([(1, 18), (2, 19)], "sid long, n long")
    postings = spark.createDataFrame([(k, s, s, n) for s, n in ((1, 18), (2, 19)) for k in range(4)], "base long, comp long, sid long, n long")
    assert {(r.sid, r.must) for r in jaccard._partners(postings, sets).select("sid", "must").distinct().collect()} == {(1, 4), (2, 4)}


@pytest.mark.parametrize("common", [suffixes.COMMON, 30, 3, 1])
def test_repeated_passages(spark, monkeypatch, common):
    monkeypatch.setattr(suffixes, "COMMON", common)
    rng = random.Random(12)
    word = lambda: f"W{rng.randrange(900)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 75, 300)]
    rows = []
    for i in range(150):
        text = [word() for _ in range(rng.randrange(0, 120))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            cut = rng.randrange(0, 30) if len(p) > 60 else 0
            text += p[cut:] + [word() for _ in range(rng.randrange(0, 60))]
        rows.append((i, " ".join(text), 0, "x"))
    rows += [(200, "again " * 200, 0, "x"), (201, "AGAIN " * 70, 0, "x"), (202, " ".join(passages[1] * 3), 0, "x"), (203, None, 0, "x"), (204, "", 0, "x"), (205, "alone " * 90, 0, "x"), (205, "alone " * 90, 0, "x")]
    found = suffixes.repeated_passages(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    where = {}
    for i, t, *_ in rows:
        w = words_of(t)
        for k in range(len(w) - 49):
            where.setdefault(tuple(w[k : k + 50]), set()).add(i)
    want = set()
    for i, t, *_ in rows:
        w = words_of(t)
        hit = np.zeros(len(w) + 2, int)
        for k in range(len(w) - 49):
            if len(where[tuple(w[k : k + 50])]) > 1:
                hit[k + 1 : k + 51] = 1
        edge = np.flatnonzero(np.diff(hit))
        want |= {(i, int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)}
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    assert suffixes.repeated_passages(spark.createDataFrame([], DOCS)).count() == 0
    if common != 3:
        return
    named = spark.createDataFrame([(f"id {i}", t, 0, "x") for i, t, *_ in rows if i < 60] + [(None, " ".join(passages[4]), 1, "x"), (None, " ".join(passages[4]) + " end", 1, "x")], "doc_id string, text string, doc int, at string")
    got = suffixes.repeated_passages(named).collect()
    assert {r.doc_id for r in got} <= {None, *(f"id {i}" for i in range(60))} and [(r.start_word, r.n_words) for r in got if r.doc_id is None] == [(0, 300), (0, 300)]


def test_neighbours_of_sorted_suffixes():
    rng = np.random.default_rng(5)
    words, h = rng.integers(0, 2, (300, 9)).astype(np.uint32), rng.integers(0, 3, 300).astype(np.uint64)
    order, common = suffixes._sorted_neighbours(h, words)
    rows = [(int(h[i]), *words[i].tolist()) for i in order]
    assert rows == sorted(rows) and common[0] == -1
    for a, b, c in zip(rows[:-1], rows[1:], common[1:], strict=True):
        assert c == (-1 if a[0] != b[0] else next((k for k in range(9) if a[k + 1] != b[k + 1]), 9))


def test_licenses(spark):
    rows = [
        ("a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        ("a/b/c/code.py", "print(1)"),
        ("a/b/own.py", "some words of a file of code.\nLicensed under the Apache License, Version 2.0.\nand more words that follow here below"),
        ("a/b/d/COPYING", "Foo. This work is licensed under the GNU General Public License, version 3. And much more that is said here in words of no account at all and more."),
        ("a/b/d/e/x.py", None),
        ("z/x.py", "we talk of a license to drive and the public"),
        (None, "Released under the MIT License."),
        (None, ""),
        ("a/cc.md", "Licensed under CC BY-NC 4.0."),
    ]
    docs = spark.createDataFrame([(i, p, t, 1) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string, license int").repartition(2)
    got = {r.doc_id: (r.license, r.origin, r.from_dir) for r in licenses.licenses(docs).collect()}
    assert got == {
        0: ("MIT", "own", None),
        1: ("MIT", "inherited", "a"),
        2: ("Apache-2.0", "own", None),
        3: ("GPL-3.0", "own", None),
        4: ("GPL-3.0", "inherited", "a/b/d"),
        5: (None, None, None),
        6: ("MIT", "own", None),
        7: (None, None, None),
        8: ("CC-BY-NC-4.0", "own", None),
    }
    assert licenses.licenses(docs.limit(0)).count() == 0


def test_common_licence_statements_count(spark):
    rows = [(i, f"s{i % 3}/{i}", "Licensed under CC BY-SA 4.0" if i % 3 == 0 else f"words {i} of a text", 1) for i in range(60)]
    rows += [(60, "t/60", "Released under the MIT License", 1), (None, "t/61", "Released under the MIT License", 1), (None, "t/62", "none", 1), (60, "t/63", "said twice by this id", 1)]
    for some in (rows, rows[60:62]):
        docs = spark.createDataFrame(some, "doc_id long, path string, text string, license int")
        got = {(r.id, r.path): (r.license, r.cosine and round(r.cosine, 9)) for r in licenses.scan_statements(docs, path_col="path").collect()}
        assert got == {(i, p): ("CC-BY-SA-4.0", 1.0) if t.startswith("Lic") else ("MIT", 1.0) if t.startswith("Rel") else (None, None) for i, p, t, _ in some}


def brute_licenses(rows):
    """The cosine of every sentence and line with every template, all vectors in full."""
    split = lambda s: re.findall("[a-z0-9]+(?:[.-][a-z0-9]+)*", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s))
    df = {}
    for _, t in rows:
        for w in set(split(t or "")):
            df[w] = df.get(w, 0) + 1
    vector = lambda s: {w: split(s).count(w) * (np.log((1 + len(rows)) / (1 + df.get(w, 0))) + 1) for w in set(split(s))}
    size = lambda v: sum(x * x for x in v.values()) ** 0.5
    given = [(name, vector(t)) for name, t in licenses.TEMPLATES]
    out = {}
    for i, t in rows:
        said = [(vector(s), len(split(s))) for line in re.split("[\r\n]+", t or "") for s in re.split(r"(?<=[.!?;])\s+", line) if split(s)]
        best = [(max((round(sum(x * b.get(w, 0) for w, x in v.items()) / size(v) / size(b), 9), name) for name, b in given), n) for v, n in said]
        near = [(c, name, n) for (c, name), n in best if c >= licenses.LEAST_COSINE]
        out[i] = (max(near)[1], round(max(near)[0], 9), sum(n for *_, n in near)) if near else (None, None, 0)
    return out


@pytest.mark.parametrize("common,counted", [(3, 7), (10_000, 500_000)])
def test_licences_against_brute_force(spark, monkeypatch, common, counted):
    monkeypatch.setattr(licenses, "COMMON_TERMS", common)
    monkeypatch.setattr(licenses, "COUNTED_TERMS", counted)
    rng = random.Random(3)
    notes = [t for _, t in licenses.TEMPLATES]
    rows = []
    for i in range(240):
        text = " ".join(rng.choices(["freely", "today", "and", "more", "é", "MORE", "the", "under", "license", f"only{i}"], k=6)) + rng.choice([". ", "\n", "; ", " "])
        for _ in range(rng.randrange(0, 3)):
            note = rng.choice(notes).split()
            for _ in range(rng.randrange(0, 4)):  # words go, come or are said again
                note[rng.randrange(len(note))] = rng.choice(["", "freely", f"only{i}", "License", note[0]])
            text += rng.choice(["", "A line of code that says nothing.\r\n"]) + " ".join(note) + rng.choice([".\n", " freely; ", " today only\n"])
        rows.append((i, text))
    rows += [(900, None), (901, ""), (902, "license " * 60_000 + "MIT"), (903, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.id: (r.license, r.cosine and round(r.cosine, 9), r.licensed_words) for r in licenses.scan_statements(docs).collect()}
    want = brute_licenses(rows)
    assert got == want and sum(x is not None for x, *_ in want.values()) > 60


def test_a_long_statement_takes_linear_time(spark):
    docs = spark.createDataFrame([(1, "license mit " + " ".join(f"w{i}" for i in range(300_000)) + "\nReleased under the MIT License", "a/b", 0)], "doc_id int, text string, path string, key int")
    began = time.time()
    assert [(r.doc_id, r.license) for r in licenses.licenses(docs).collect()] == [(1, "MIT")]
    assert time.time() - began < 30


def test_pipeline_against_plain_steps(spark, tmp_path):
    rng = random.Random(1)
    lines = {"en": "the of and that this with from have", "de": "der die und nicht eine mit von auch"}
    text = lambda lang, n: " ".join(rng.choice(lines[lang].split()) + str(rng.randrange(50)) for _ in range(n))
    rows = [(i, text(lang := rng.choice(list(lines)), rng.choice([1, 4, 60, 400])), lang, f"s{i % 4}", 0) for i in range(120)]
    rows += [(200 + i, rows[0][1], "en", "s1", 0) for i in range(5)] + [(300, "12 34", "en", "s1", 0), (301, None, None, None, 0), (302, rows[2][1] + " tail", "en", "s2", 0), (303, "", "en", None, 0), (None, text("en", 50), None, "s9", 0)]
    rows += [(400 + i, " ".join(w if k != 7 * i else "other" for k, w in enumerate(rows[3][1].split())), "de", "s3", 0) for i in range(9)]
    given = "doc_id long, text string, lang string, source string, n_chars long"
    # columns with names that the operators use inside
    more = ["row", "id", "key", "score", "lang_pred", "size", "draw", "copies", "n", "sid", "text_sha256", "keep", "__id"]
    schema = given + "".join(f", `{c}` int" for c in more)
    spark.createDataFrame([(*r, *range(len(more))) for r in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == before.columns and all(tuple(r)[5:] == tuple(range(len(more))) for r in kept[name])
        if name == "mixing":
            copies = {(r.doc_id, r["size"]): r.copies for r in mixing.mix_decisions(before).collect()}
    ids = lambda found: sorted((r.doc_id is None, r.doc_id) for r in found)
    said = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert ids(kept["language ID"]) == sorted((r[0] is None, r[0]) for r in said)
    last = {}
    for r in said:
        if r[1] not in last or r[0] > last[r[1]][0]:
            last[r[1]] = r
    assert ids(kept["exact dedup"]) == sorted((r[0] is None, r[0]) for r in last.values())
    components = brute_components([r for r in last.values() if r[0] is not None])
    stay = {c for _, c in components.values()}
    assert ids(kept["n-gram Jaccard join"]) == sorted([(False, i) for i in stay] + [(True, None)]) and len(stay) < len(components)
    counts = {}
    for r in kept["mixing"]:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == {i: n for (i, _), n in copies.items() if n}
    tokenizer, covered = packing.pretoken_ids(packing_tokenizer()), {}
    of = {r.doc_id: r.text for r in kept["mixing"]}
    for r in kept["packing"]:
        ids_ = tokenizer.text(of[r.doc_id]) + (1).to_bytes(4, "little")
        assert r.doc_tokens == len(ids_) // 4 and r.ids_crc32 == zlib.crc32(ids_[4 * r.start : 4 * (r.start + r.length)])
        for at in range(r.start, r.start + r.length):
            covered[r.doc_id, at] = covered.get((r.doc_id, at), 0) + 1
    assert covered == {(i, at): n for i, n in counts.items() for at in range(len(tokenizer.text(of[i])) // 4 + 1)}
    run = corpus_pipeline.run(spark, str(tmp_path))
    total = F.sum("length"), F.count_distinct("doc_id")
    assert run.agg(*total).first() == docs.agg(*total).first() and packing.SEQUENCE == 2048


def packing_tokenizer():
    from tessera.llm.queries import TOKENIZER

    return TOKENIZER


def test_pipeline_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
