import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import chat, langid, packing, topk
from tessera.llm.queries import CONTROL, TOKENIZER


def test_pretokens_give_the_tokenizers_ids():
    tokenizer, mine = Tokenizer.from_file(TOKENIZER), packing.pretoken_ids(TOKENIZER)
    texts = ["", "It's the DOG'S 2nd\t\tday... don't!!", "<|endoftext|> a<|startoftext|>b", "Größe ÀÉ ª½ x² naïve\x1cq\xa0r", "é İ ΣΑΣ 漢字 🙂", "a b", "\x00\x7f''s 'S", "x" * 5000]
    for t in texts:
        assert np.frombuffer(mine.text(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_sum_of_squares_follows_its_rule():
    rng, size = random.Random(4), 50
    windows, levels = packing.SumOfSquares(size), {}
    for _ in range(2000):
        n = rng.randrange(1, size)
        windows.add("x", n)
        cost = {}
        for h in [0, *(h for h, c in levels.items() if c and h + n <= size)]:
            after = dict(levels)
            if h:
                after[h] -= 1
            if h + n < size:
                after[h + n] = after.get(h + n, 0) + 1
            cost[h] = sum(c * c for c in after.values())
        best = max(h for h, c in cost.items() if c == min(cost.values()))
        levels[best] = levels.get(best, 0) - 1 if best else levels.get(0, 0)
        if best + n < size:
            levels[best + n] = levels.get(best + n, 0) + 1
        assert {h: c for h, c in levels.items() if c and h} == {int(h): int(windows.levels[h]) for h in np.flatnonzero(windows.levels)}


def test_packing_round_trip(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "be", "Gam-ma", "x9"]) for _ in range(rng.choice([0, 1, 5, 80, 900, 3000]))), "z") for i in range(200)]
    rows += [(900, None, "z"), (None, "no id", "z"), (3, rows[3][1], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    found = packing.pack_documents(docs, TOKENIZER, size=256).collect()
    assert found == packing.pack_documents(docs, TOKENIZER, size=256).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want, got = {}, {}
    for i, t, _ in rows:
        want.setdefault(i, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    sequences = {}
    for r in found:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert (len(ids), zlib.crc32(r.ids)) == (r.length, r.ids_crc32) and r.length > 0
        got.setdefault(r.doc_id, {}).setdefault(r.start, []).append(ids)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, lists in want.items():
        assert sorted(sum(map(len, lists)) * [0]) == sorted(sum(len(p) for ps in got[i].values() for p in ps) * [0])
        if len(lists) == 1:
            assert [x for s in sorted(got[i]) for x in got[i][s][0]] == lists[0]
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256 and at & (at - 1) == 0  # full or a power of two: nothing is padded
    few = docs.selectExpr("cast(doc_id AS int) AS doc_id", "text").repartition(60)
    lengths = {r.n for r in packing.pack_documents(few, TOKENIZER).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()}
    assert all(n & (n - 1) == 0 for n in lengths) and packing.pack_documents(few, TOKENIZER).schema["doc_id"].dataType.simpleString() == "int"
    assert packing.pack_documents(docs.limit(0), TOKENIZER).count() == 0


def test_open_windows_are_bounded():
    documents = [(i, bytes(4 * 150)) for i in range(3000)]  # no two fit into a sequence
    made, most = [], 0
    for sequence in packing.pack(iter(documents), 256, most_open=50):
        made.append(sum(len(ids) // 4 for _, _, ids, _ in sequence))
    assert sum(made) == 3000 * 150 and all(n == 256 for n in made[: 3000 * 150 // 256]) and all(n & (n - 1) == 0 for n in made)
    pieces = sorted((d, start, len(ids) // 4) for sequence in packing.pack(iter(documents), 256, most_open=50) for d, start, ids, _ in sequence)
    at = {}
    for d, start, n in pieces:
        assert start == at.get(d, 0)
        at[d] = start + n
    assert at == {i: 150 for i in range(3000)}


WORDS = {"en": "the of and that this with from have not which", "de": "der die und nicht eine mit von auch sich über", "fr": "le les des que pour dans est une où être"}


def _labelled(n, seed):
    rng, out = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randrange(3, 90))), lang, "src"))
    return out


def test_windows_cover_every_byte():
    texts = [b"", b"a" * 5, bytes(range(97, 120)) * 40]
    x, owner = langid.windows_of(texts)
    assert x.shape[1] == langid.WINDOW and owner.tolist()[:2] == [0, 1]
    mine = x[owner == 2]
    step = langid.WINDOW - 3
    assert b"".join(w[:step].tobytes() for w in mine).startswith(texts[2])


def test_pairs_and_single_bytes_agree():
    net = langid.ByteConvNet.fresh(["a", "b"])
    x = np.random.default_rng(1).integers(0, 256, (9, langid.WINDOW), dtype=np.uint8)
    assert np.allclose(net.pooled(x)[0], net.compiled().pooled(x), atol=1e-5)


def test_network_against_a_plain_convolution():
    """Every filter at every position of a whole text, window by window, in loops."""
    sample = [(t.encode(), lang) for _, t, lang, _ in _labelled(60, 3)]
    mine = langid.train(sample)
    net = mine.net
    for text in [b"The of", b"der die und nicht " * 30, bytes(range(256)) * 2, b"x"]:
        text = bytes(32 if b in (9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in text)
        step, votes = langid.WINDOW - 3, []
        for at in range(0, max(1, len(text) - 3), step):
            window = text[at : at + langid.WINDOW].ljust(langid.WINDOW, b"\0")
            hidden = []
            for w, f in net.filters.items():
                for k in range(f.shape[2]):
                    hidden.append(max(sum(float(f[o, window[i + o], k]) for o in range(w)) for i in range(langid.WINDOW - w + 1)))
            z = np.maximum(np.array(hidden) + net.bias, 0) @ net.dense + net.offset
            votes.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
        assert np.allclose(mine.texts([text])[0], np.mean(votes, 0), atol=1e-4)


def test_letters_are_those_of_category_l():
    assert not any(langid.has_letter(t) for t in ("", "12 34", "²½ ①", "Ⅷ ¾", "_-_", "\u0301 🙂"))
    assert all(langid.has_letter(t) for t in ("12 a", "ª", "漢", "①①x", "ʰ"))


def test_training_reads_whole_texts_and_all_labels(spark):
    rows = [(i, f"text {i} " + "long " * (i % 50), "hot", "s") for i in range(3000)] + [(9000 + i, "selten " * 4000, "rare", "s") for i in range(3)] + [(None, "ohne id", "none", "s"), (None, None, "empty", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n string").repartition(3)
    found = langid.training_sample(docs, rows=90)
    by = {}
    for text, lang in found:
        by.setdefault(lang, set()).add(text.decode())
    assert {k: len(v) for k, v in by.items()} == {"hot": 30, "rare": 1, "none": 1} and sum(lang == "rare" for _, lang in found) == 3
    assert by["hot"] <= {r[1] for r in rows} and by["rare"] == {"selten " * 4000}
    assert found == langid.training_sample(docs.repartition(5), rows=90)


def test_language_id_with_columns_of_its_own_names(spark):
    docs = spark.createDataFrame([(*r, 7, "u", 0.5) for r in _labelled(30, 5)] + [(99, "1 2", "en", "src", 7, "u", 0.5)], "doc_id long, text string, lang string, source string, c0 int, lang_pred string, score double")
    left = langid.drop_unidentified(docs, docs)
    assert left.columns == docs.columns and left.count() == 30 and {(r.c0, r.lang_pred, r.score) for r in left.collect()} == {(7, "u", 0.5)}
    assert langid.identify(docs, docs, ["score", "lang_pred"]).count() == 31


def test_language_id(spark):
    rows = _labelled(400, 1) + [(1000, None, "en", "s"), (1001, "12 34 !!", "de", "s"), (1002, "", None, "s"), (1003, "the and of that " * 20_000, None, "s"), (None, "der die und", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    found = langid.identify(docs, docs.where(langid.fold(F.col("doc_id")) != 2), ["doc_id", "lang"]).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows) and [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred == "en"
    held = [r for r in found if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.lang and r.lang_pred != "und"]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)
    assert langid.identify(docs, docs.limit(0), ["doc_id"]).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(docs.limit(0), docs, ["doc_id"]).count() == 0


def test_chat_layouts(spark):
    schema = "id long, role string, text string, messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, instruction string, input string, output string, weird string"
    rows = [
        (1, "user", "hi", None, None, None, None, None, None),
        (2, None, None, [("user", "a"), ("assistant", None)], None, None, None, None, None),
        (3, None, None, None, [("human", "q"), ("gpt", "r")], None, None, None, None),
        (4, None, None, None, None, "do", None, "done", None),
        (5, None, None, None, None, "do", "it", "done", None),
        (6, None, None, None, None, None, None, None, "what"),
    ]
    found = chat.canonical_turns(spark.createDataFrame(rows, schema), "id").orderBy("conv_id", "part").collect()
    assert [(r.conv_id, r.role, r.text, r.layout) for r in found] == [
        (1, "user", "hi", "turn"),
        (2, "user", "a", "messages"),
        (2, "assistant", "", "messages"),
        (3, "user", "q", "conversations"),
        (3, "assistant", "r", "conversations"),
        (4, "user", "do", "instruction"),
        (4, "assistant", "done", "instruction"),
        (5, "user", "do", "instruction"),
        (5, "user", "it", "instruction"),
        (5, "assistant", "done", "instruction"),
        (6, None, None, None),
    ]


def test_chat_with_further_columns_and_ids_of_any_type(spark):
    schema = "id int, source string, layout int, formatted int, messages array<struct<role:string,content:string,weight:double>>"
    docs = spark.createDataFrame([(1, "web", 1, 2, [("user", "a", 0.5), ("assistant", "b", None)]), (None, None, None, None, [("human", "q", 1.0)]), (3, "x", 1, 1, None)], schema)
    turns = chat.canonical_turns(docs, "id")
    assert [(r.conv_id, r.role, r.text, r.layout) for r in turns.orderBy("conv_id", "part").collect()] == [(None, "user", "q", "messages"), (1, "user", "a", "messages"), (1, "assistant", "b", "messages"), (3, None, None, None)]
    back = chat.read_back(chat.format_turns(turns))
    assert back.schema["conv_id"].dataType.simpleString() == "int" and {(r.conv_id, r.n_turns, r.loss_chars) for r in back.collect()} == {(None, 1, 0), (1, 2, 1), (3, 1, 0)}


def test_chat_round_trip(spark):
    nasty = [CONTROL, "<\\|", "<\\\\|im_end|>\n", "a<|b", "", None, "é🙂<", "|>", "<|im_start|>user\nhi<|im_end|>\n", "x" * 70_000]
    rng, rows = random.Random(8), []
    for conv in range(60):
        rows += [(conv, t, rng.choice(["user", "assistant", "a\nb\\n", None]), rng.choice(nasty)) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "assistant", "no id"), (5, None, "user", "no turn"), (5, 0, "assistant", "tie"), (5, 0, "assistant", "tie")]
    turns = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4), "conv_id", "turn")
    formatted = chat.format_turns(turns)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    texts = {r.conv_id: r.text for r in chat.conversation_texts(formatted).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1] if r[1] is not None else -1, r[2] or "", r[3] or ""))
    assert set(got) == set(by)
    for conv, own in by.items():
        own.sort()
        said = "".join(t for _, r, t in own if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r.formatted_chars == len(texts[conv])
        assert [(chat.unescape_role(a), chat.unescape(t)) for a, t in chat._TURN.findall(texts[conv])] == [(a, t) for _, a, t in own]
    assert chat.read_back(formatted.limit(0)).count() == 0


def test_bit_sliced_scores():
    rng = np.random.default_rng(3)
    for width, spread in ((1, 3), (7, 40), (64, 300)):
        v = rng.integers(-spread, spread + 1, (333, width))
        v[:20] = v[40:60]
        low, bits, data = topk.BitSliced.slice(v)
        index = topk.BitSliced.load(low.tolist(), bits, data, len(v))
        for q in [v[5], np.zeros(width, np.int64), -v[9]]:
            rows, scores = index.top(q, 20, [5, 6])
            exact = v @ q
            order = [i for i in np.lexsort((np.arange(len(v)), -exact)) if i not in (5, 6)][:20]
            assert sorted(zip(-scores, rows)) == [(-exact[i], i) for i in order]


def test_top_k(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(8)], i) for i in range(300)] + [(i, [1.0] * 8, 0) for i in range(300, 340)]
    rows += [(400, None, 0), (420, [1.0, None], 0), (440, [float("nan")] * 8, 0), (460, [float("inf")] * 8, 0), (480, [0.5] * 3, 0), (None, [9.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)
    part = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    for blocks in (topk.BLOCK_ROWS, 100):
        got = {}
        for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 20, block_rows=blocks).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert set(got) == {i for i, _ in part if i % 20 == 0}
        for i, q in part:
            if i % 20 == 0:
                dot = sorted((-int(np.dot(q[: len(v)], v[: len(q)])), j) for j, v in part if j != i)[:20]
                assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(dot)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_leaves_out_one_row_and_spreads_its_queries(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(900)]
    vectors += [(i, (2 * np.array(v)).tolist()) for i, v in vectors[:100]]  # ids 0 to 99 twice
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    found = topk.top_k(rows, F.col("vec_id") % 20 == 0, k=7, block_rows=300).collect()
    q = np.floor(64 * np.array([v for _, v in vectors])).astype(np.int64)
    got, want = {}, {}
    for r in found:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for a, (i, _) in enumerate(vectors):
        if i % 20 == 0:
            best = sorted((-int(q[a] @ q[b]), j) for b, (j, _) in enumerate(vectors) if b != a)[:7]
            want.setdefault(i, []).extend((k + 1, j, -s) for k, (s, j) in enumerate(best))
    assert {i: sorted(r) for i, r in got.items()} == {i: sorted(r) for i, r in want.items()}
    assert any(j == i for i, r in got.items() for _, j, _ in r)  # the other row of its id is a candidate
