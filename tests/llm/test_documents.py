"""Operators on documents against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm import bpe_automaton, decontaminate, hashing, near_dedup, pii, quality, sharding, token_store
from cairn.llm.html_render import visible_text

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n\t", "a", "a b", "a b c", "The the THE the", "é É ß 日本語 テキスト 😀😀", "x" * 70_000, "word " * 30_000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(4, "a b", "clash"), (None, "no id", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


# near duplicates


def shingles(text, k):
    lower = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(lower))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def classes(texts, k, percent):
    sets, up = {i: shingles(t, k) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                i, j = root(a), root(b)
                up[max(i, j)] = min(i, j)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 500, 120)]
    texts = {}
    for i in range(70):  # a family around the threshold, which no single centre joins
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 9)):
            words[at] = f"n{rng.integers(0, 99)}"
        texts[i] = " ".join(words)
    texts |= {100 + i: texts[3] for i in range(20)}
    texts |= {200: None, 201: "", 202: " ", 203: "one", 204: "one two", 205: "ONE two"}
    rows = [(i, t, 1) for i, t in texts.items()] + [(204, "one two", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int")
    for k, percent in ((3, 85), (5, 80)):
        got = {r[0]: (r[1], r[2], r[3]) for r in near_dedup.near_duplicates(df, k=k, percent=percent).collect()}
        assert got == classes(texts, k, percent)


@pytest.mark.parametrize("nearest", [1, 8])
def test_hot_buckets_and_families(spark, monkeypatch, nearest):
    monkeypatch.setattr(near_dedup, "HOT", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "NEAREST", nearest)
    rng, texts = np.random.default_rng(6), {}
    for family in range(4):  # members share most of their words; some lie at the threshold
        base = [f"f{family}w{i}" for i in range(100)]
        for i in range(40):
            words = list(base)
            for at in rng.integers(0, 100, rng.integers(0, 8)):
                words[at] = f"n{rng.integers(0, 9999)}"
            texts[1000 * family + i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r[0]: (r[1], r[2], r[3]) for r in near_dedup.near_duplicates(df).collect()}
    assert got == classes(texts, 5, 80)


def test_an_id_of_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, b), (7, a), (7, b + " more"), (7, a), (7, None), (9, c), (9, ""), (11, a + " end"), (12, c)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [(3, 36, 3, True), (7, 36, 7, True), (7, 37, 3, False), (7, 36, 7, True), (7, 0, 7, True), (9, 36, 9, True), (9, 0, 9, True), (11, 37, 7, False), (12, 36, 9, False)]
    assert got == sorted(want)


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    text = ("ab cde " * 40 + "z" * 300 + " end").encode()
    data, offsets = np.frombuffer(text * 2, np.uint8), np.array([0, len(text), 2 * len(text)])
    whole, n = hashing.word_hashes(data, offsets)
    assert n.tolist() == [82, 82] and (whole[:82] == whole[82:]).all() and len(set(whole.tolist())) == 4


# decontamination


def test_contamination_matches_a_scan(spark):
    items = [(1, "A b c d e f g h i j K l"), (2, "short One"), (3, None), (4, "--"), (5, "b c d e f g h i j k")]
    docs = [(1, "x a, b c. d e f g h i j k l y"), (2, "short one short ONE"), (3, None), (4, ""), (5, "a b c d e f g h i"), (None, "short one"), (1, "other")]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower().encode())
    want = []
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for i, x in items:
            g = words(x)
            n = min(10, len(g))
            for a in range(len(g) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == g[a : a + n]:
                        hit |= set(range(p, p + n))
                        names.add(str(i))
        want.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    clean = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), "spans")
    assert {r[0]: r[1] for r in clean.filter("doc_id = 2").collect()} == {2: ""}
    assert clean.count() == len(docs)


def test_contamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, doc_id long, text string")
    some = spark.createDataFrame([(1, 1, "a b")], "item_id long, doc_id long, text string")
    assert decontaminate.contamination(none, some).count() == 0
    assert decontaminate.contamination(some, none).collect()[0]["n_hit"] == 0


# tokens


def test_bpe_agrees_with_the_library(spark, odd, documents):
    tokenizer = Tokenizer.from_file(PATH)
    rows = odd.select("doc_id", "text").union(documents.select(F.col("doc_id") + 1000, "text")).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = {r[0]: r[1] or "" for r in rows.collect()}
    for r in bpe_automaton.round_trip(rows, PATH).collect():
        ids = tokenizer.encode(texts[r[0]], add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_of_adversarial_words():
    tokenizer, own = Tokenizer.from_file(PATH), bpe_automaton.Automaton(PATH)
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("aanhtes' <|"), rng.integers(1, 60))) for _ in range(2000)] + ["a" * n for n in range(1, 60)] + ["<|endoftext|>x<|startoftext|>", "Σας ΣΑΣ", "don't I'LL 12a3", "é é"]
    for t in texts:
        assert own.encode_bytes(t.encode()).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_bpe_of_every_code_point():
    tokenizer, own = Tokenizer.from_file(PATH), bpe_automaton.Automaton(PATH)
    points = [c for c in [*range(0x32000), *range(0xE0000, 0xE0200), 0x10FFFF] if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}1b" for c in points]
    for t, ids, e in zip(texts, own.encode_all([t.encode() for t in texts]), tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
        assert ids.tolist() == e.ids, ascii(t)


def test_bpe_with_a_small_table(monkeypatch):
    monkeypatch.setattr(bpe_automaton, "TRANSITIONS", 40)
    tokenizer, own = Tokenizer.from_file(PATH), bpe_automaton.Automaton(PATH)
    for t in ["abcdefgh" * 30, "x" * 500, "international relations", "an unbelievably long sentence about nothing", "naïve façade " * 3]:
        assert own.encode_bytes(t.encode()).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_encode_then_decode(spark, odd):
    encoded = bpe_automaton.encode_documents(odd, PATH)
    decoded = {r[0]: r[1] for r in bpe_automaton.decode_documents(encoded, PATH).collect()}
    assert decoded[5] == "a</w> b</w> c</w>" and decoded[0] == ""


@pytest.mark.parametrize("n,top", [(0, 1), (1, 0), (1, 5), (100, 3), (1000, 10**9), (5000, 20000)])
def test_elias_fano(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top + 1, n))
    code = token_store.EliasFano(token_store.elias_fano(values))
    assert code.all().tolist() == values.tolist() == [code.select(i) for i in range(n)]


def test_store_round_trip(spark, odd, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(odd, path, PATH)
    tokenizer, at = Tokenizer.from_file(PATH), 0
    rows = sorted(((i, t) for i, t in [*enumerate(ODD), (4, "a b")]), key=lambda r: r[0])
    for (i, t), r in zip(rows, sorted(token_store.read_store(spark, path).collect())):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r[0]: len(r[1]) for r in token_store.read_ids(spark, path).collect()}[5] == 4


def test_store_of_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/empty"
    token_store.write_store(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert token_store.read_store(spark, path).count() == 0


# shards


def test_shards(spark, odd):
    rows = sharding.assign_shards(odd, 16).toPandas()
    assert len(rows) == len(ODD) + 2 and set(rows.law) == {"key"}
    for _, shard in rows.groupby("shard"):
        assert sorted(shard.slot) == list(range(len(shard)))
    own = {i: t for i, t in enumerate(ODD)}
    for r in rows.itertuples():
        if r.doc_id == r.doc_id:
            raw = (own[int(r.doc_id)] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))


def test_a_new_shard_takes_rows_only_into_itself(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("k"))
    got = keys.select(sharding.jump_hash(F.col("k"), 16).alias("a"), sharding.jump_hash(F.col("k"), 17).alias("b")).toPandas()
    moved = got[got.a != got.b]
    assert set(moved.b) == {16} and abs(len(moved) / len(got) - 1 / 17) < 0.01
    assert got.groupby("a").size().between(1100, 1400).all()


# personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c.isdigit()]
            luhn = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
            if [True, kind == 1 and all(int(p) <= 255 for p in m[0].split(".")), 12 <= len(digits) <= 19 and luhn, 9 <= len(digits) <= 15][kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans(spark):
    rng = np.random.default_rng(2)
    texts = [*ODD, "a@b.c_d@e.f x@y..z.q a@b.c.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111 1111 1111-9 4111-1111-1111-1111", "+49 (0)30 123456-78. +1", "9" * 30_000, "a." * 9000 + "@" + "b." * 9000, "1.2" * 9000, "+1" + "-1" * 9000]
    texts += ["".join(rng.choice(list("0123 -.@+ab(é"), 80)) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.report(df).collect():
        spans = plain_spans(texts[r["doc_id"]])
        want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), texts[r["doc_id"]][:90]
        assert r["n_card"] == sum(k == 2 for _, k, _ in spans)


def test_contexts_find_what_no_shape_does(spark):
    rows = [(i, f"please reach me: user{i}@mail{i}.com now") for i in range(6)] + [(6, "please reach me: frank_at_home99 now"), (7, "order number 12345678 today"), (8, None)]
    rows += [(20 + i, f"of the user{i}@mail{i}.com") for i in range(5)] + [(30 + i, f"of the 77{i}88") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit(1))
    got = {r["doc_id"]: r["spans"] for r in pii.report(df).collect()}
    assert got[6] == "email:17:32" and got[7] == got[8] == got[30] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[6] == clean[0] == "please reach me: [EMAIL] now" and clean[7] == rows[7][1] and clean[8] is None



def test_found_identifiers_seed_further_contexts(spark):
    texts = [f"please reach me: user{i}@mail{i}.com now" for i in range(30)] + [f"please reach me: handle_{i}x now" for i in range(9)]
    texts += [f"her alias is handle_{i}x today" for i in range(9)] + ["her alias is zoe_77x today"]
    texts += [f"ring them on +1 555 123 45{i:02}" for i in range(12)] + ["ring them on 555 123 4567, please", "on 555 123 4567 days"]
    got = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[30] == "email:17:26" and got[39] == "email:13:22" and got[48] == "email:13:20"
    assert got[61] == "phone:13:25" and got[62] == ""


# quality


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").toPandas()
    held = rows[rows.held_out]
    assert (held.predicted == held.quality).mean() > 0.9
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()


def test_quality_of_odd_texts(spark, odd):
    labels = spark.createDataFrame([(3, 1), (99, None)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    rows = quality.score(odd, model).toPandas()
    assert len(rows) == len(ODD) + 2 and rows.score.between(0, 1).all()
    assert quality.keep_good(odd, model, threshold=0.0).count() == len(ODD) + 2


def test_very_long_text_scores_as_in_one_run():
    rng = np.random.default_rng(0)
    model = quality.Model(0.7)
    model.p["c"] = rng.normal(0, 1, quality.HIDDEN).astype(np.float32)
    text = rng.integers(97, 122, 3 * 1024 * quality.PASSAGE_BYTES + 77).astype(np.uint8)
    counts, n = quality.passage_features(text, np.array([0, len(text)]))
    assert abs(model._long(text) - model.forward(quality._unit(counts), n)[0][0]) < 1e-3


# pages


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("plain", "plain"), ("<!DOCTYPE html><p>a<p>b", "a\n\nb"), ("<ul><li>a<li>b</ul>", "- a\n- b"), ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"),
    ("<table><tr><th>Name<th>N<tr><td>Longer<td>1</table>", "Name   | N\nLonger | 1"), ("a<span style='display: none'>b</span><b hidden>c</b>d", "ad"), ("x<br>y", "x\ny"),
    ("<pre>\n a  b\n  c</pre>", "a  b\n  c"), ("<script>var a='</p>'</script>&amp;&lt;", "&<"), ("<details><summary>S</summary>no</details>", "S"), ("<p>a <b>b</b>\n c</p>", "a b c"),
])
def test_visible_text(html, text):
    assert visible_text(html) == text or visible_text(html).strip() == text


@pytest.mark.parametrize("html,text", [
    ("a<select><option>x<option selected>y</select>b", "a\nx\ny\nb"), ("a<svg><title>no</title><text>l</text><path d=1 /><text>m</text></svg>", "a l m"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"), ("<table><tr><td rowspan=2 colspan=2>a<td>b<tr><td>c</table>", "a |  | b\n  |  | c"),
    ("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
])
def test_options_drawings_and_row_spans(html, text):
    assert visible_text(html) == text


def test_deep_and_broken_pages():
    assert visible_text("<div>" * 50_000 + "x") == "x"
    assert "x" in visible_text("<table><tr><td>" * 500 + "x")
    assert isinstance(visible_text('<p "' * 5000 + "<a href='"), str)


def test_store_pieces_equal_the_library_for_every_code_point():
    from tokenizers import Tokenizer

    from cairn.llm import token_store
    from cairn.llm.runtime import tokenizer_path

    library, known = Tokenizer.from_file(tokenizer_path()), token_store._Pieces(tokenizer_path())
    points = [c for c in range(1, 0x32000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 5000):
        texts = [f"A{chr(c)}, b{chr(c)}.B {chr(c)}1! J̌ <|EndOfText|>" for c in points[i : i + 5000]]
        split = [token_store.words(t.encode()) for t in texts]
        known.learn(split)
        for ws, e in zip(split, library.encode_batch_fast(texts, add_special_tokens=False)):
            assert np.frombuffer(b"".join(map(known.__getitem__, ws)), "<u4").tolist() == e.ids
