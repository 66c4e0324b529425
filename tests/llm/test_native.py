"""The operators that stay inside the JVM: brute force, odd tables, and rows so long that squares would show."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cairn.llm import chat_format, decontaminate, native, pii, sharding
from tests.llm.test_documents import plain_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_scans_and_parts(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randint(-9, 9) for _ in range(n)], "".join(rng.choice("aé😀\n") for _ in range(5 * n))) for i, n in enumerate((0, 1, 2, 3, 10, 99, 5000))]
    df = spark.createDataFrame(rows, "i int, v array<int>, t string")
    cuts = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (3, 3), (4090, 4100), (8191, 20_000))))
    got = df.select("i", native.sums(F.col("v")), native.parts_of(F.col("t"), lambda part: F.transform(cuts, lambda c: part(c["a"], c["b"]))))
    for i, sums, parts in got.collect():
        v, t = rows[i][1:]
        assert sums == [sum(v[: k + 1]) for k in range(len(v))]
        assert parts == [t[0:1], "", t[4090:4100], t[8191:20_000]]


def without(text, items):
    """The text without benchmark windows, by comparing every place with every window."""
    if text is None:
        return None
    words, hit = [(m.end(), lower(m[0])) for m in WORD.finditer(text)], set()
    for item in items:
        g = [lower(w) for w in WORD.findall(item)]
        n = min(10, len(g))
        for a in range(len(g) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if [w for _, w in words[p : p + n]] == g[a : a + n]:
                    hit |= set(range(p, p + n))
    out, at = "", 0
    for i, (end, _) in enumerate(words):
        out += "" if i in hit else text[at:end]
        at = end
    return out + text[at:]


@pytest.mark.parametrize("most", [200_000, 3])
def test_spans_are_removed_whatever_the_case(spark, monkeypatch, most):
    monkeypatch.setattr(native, "BROADCAST_ROWS", most)
    rng = random.Random(4)
    items = ["one two three four five six seven eight nine ten", "Short ONE", "é B c D e f g H i J k L", "x", "a b a b a b a b a b a b a b", ""]
    texts = ["AAA Bbb keep THIS one two three four FIVE six seven eight nine ten McDonald END stays", "", None, "short, ONE!", "X", "no hit é"]
    for _ in range(200):
        chosen = [rng.choice([*items, "Word", "FOO bar", "A b", "日本 x"]) for _ in range(rng.randint(1, 25))]
        texts.append("".join((c.upper() if rng.random() < 0.4 else c) + rng.choice([" ", ", ", "\n", "--"]) for c in chosen))
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = decontaminate.decontaminate(df, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), "spans")
    assert got.columns == df.columns
    assert {r[0]: r[1] for r in got.collect()} == {i: without(t, items) for i, t in enumerate(texts)}


def test_many_windows_cost_in_proportion_to_the_words(spark, monkeypatch):
    monkeypatch.setattr(native, "BROADCAST_ROWS", 3)
    rng, took = random.Random(5), []
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")
    for n in (4000, 4000, 32_000):
        rows = [(i, " ".join(rng.choice(["aa", "Bb", "w3"]) for _ in range(n)) + " " + " ".join(f"w{i}" for i in range(12))) for i in range(8)]
        start = time.time()
        hit = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
        took.append(time.time() - start)
        assert [r["n_hit"] for r in hit] == [12] * 8
    assert took[2] < 8 * took[1] + 2


def test_one_row_of_very_many_identifiers(spark):
    n = 60_000
    text = " ".join(f"a{i}@b.com x{i}y 10.0.0.{i % 256}" for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    row = pii.report(df).first()
    clean = pii.redact(df).first()["text"]
    assert (row["n_email"], row["n_ip"]) == (n, n) and time.time() - start < 90
    assert clean == " ".join(f"[EMAIL] x{i}y [IP]" for i in range(n))


def test_tokens_that_meet_base_spans_are_dropped(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        cuts = sorted(rng.sample(range(200), 2 * rng.randint(0, 9)))
        own = list(zip(cuts[::2], cuts[1::2]))
        others = [(s, s + rng.randint(1, 40)) for s in (rng.randrange(200) for _ in range(rng.randint(0, 4)))]
        rows.append((i, own, others))
    kind = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame(rows, f"i int, own {kind}, others {kind}")
    for i, got in df.select("i", pii._apart(F.col("own"), F.col("others"))).collect():
        assert [tuple(s) for s in got] == [s for s in rows[i][1] if not any(s[0] < e and b < s[1] for b, e in rows[i][2])]


EDGES = "\"'()[]{}<>,;:!?.*#$%&|"


def plain_tokens(text, base):
    """(start, end, value, context) of identifier-like tokens that meet no span, by plain regular expressions."""
    part = r"[(]?[0-9][0-9().-]*+"
    clash = lambda t, spans: any(a < t[1] and t[0] < b for a, b in spans)

    def found(pattern):
        out = []
        for m in re.finditer(pattern, text, re.A):
            left = m[0].lstrip(EDGES)
            value = left.rstrip(EDGES)
            start = m.start() + len(m[0]) - len(left)
            out.append((start, start + len(value), value))
        return out

    numbers = [t for t in found(rf"(?<!\S){part}(?:\x20{part}(?=[\s,;:!?]|\Z)){{1,5}}+") if not clash(t, base)]
    words = [t for t in found(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+") if not clash(t, base + [t[:2] for t in numbers])]
    return [(*t, plain_context(text, t[0])) for t in numbers + words if len(t[2]) >= 4 and plain_context(text, t[0])]


def plain_context(text, start):
    m = re.search(r"\s(\S+\s+\S+)\s+\Z", (" " + text[:start])[-80:], re.A)
    return re.sub(r"\s+", " ", m[1].lower(), flags=re.A) if m else ""


def plain_found(texts):
    """The spans that contexts add, by the rules of the module's docstring, one after another."""
    base = {i: plain_spans(t) for i, t in texts.items()}
    seeds = {(c, texts[i][a:b], k) for i, spans in base.items() for a, k, b in spans if (c := plain_context(texts[i], a))}
    tokens = [(i, *t) for i, text in texts.items() for t in plain_tokens(text, [(a, b) for a, _, b in base[i]])]
    follow = {}
    for text in texts.values():
        w = re.split(r"\s+", text.lower(), flags=re.A)
        for a, b, c in zip(w, w[1:], w[2:]):
            if not re.search("[0-9@]", c):
                follow.setdefault(f"{a} {b}", set()).add(c)
    known, good = {}, {}
    while True:
        held = seeds | {(c, v, known[v]) for _, _, _, v, c in tokens if v in known}
        counts = {}
        for c, _, k in held:
            counts[c, k] = counts.get((c, k), 0) + 1
        patterns = {c for (c, _), n in counts.items() if n >= 3}
        edges = {}
        for c, v, k in held | {(c, v, -1) for _, _, _, v, c in tokens}:
            if c in patterns:
                edges.setdefault(c, {})[v] = max(k, edges.get(c, {}).get(v, -1))
        best = lambda e: max(sum(k == x for k in e.values()) for x in range(4)) + sum(k < 0 for k in e.values())
        edges = {c: e for c, e in edges.items() if best(e) / (len(e) + 1) >= 0.8}
        sure = {(v, k): 1.0 for e in edges.values() for v, k in e.items() if k >= 0}
        belief = dict(sure)
        score = {}
        for _ in range(3):
            score = {}
            for c, e in edges.items():
                for k in range(4):
                    worth = [belief[v, k] for v in e if (v, k) in belief]
                    if worth:
                        score[c, k] = (sum(worth) / (len(e) + len(follow.get(c, ())) + 1), sum(w == 1 for w in worth))
            guess = {}
            for c, e in edges.items():
                for v, old in e.items():
                    for k in range(4):
                        if old < 0 and score.get((c, k), (0, 0))[1] >= 3:
                            guess[v, k] = max(guess.get((v, k), 0), score[c, k][0])
            belief = sure | {x: h for x, h in guess.items() if h < 1 and x not in sure}
        accepted = {}
        for (c, k), (confidence, n) in score.items():
            if confidence >= 0.8 and n >= 3:
                accepted.setdefault(c, []).append((confidence, -k))
        good = {c: max(x) for c, x in accepted.items()} | good
        fills = {}
        for _, _, _, v, c in tokens:
            if c in good:
                fills.setdefault(v, []).append(good[c])
        new = {v: -max(x)[1] for v, x in fills.items() if v not in known}
        if not new:
            break
        known |= new
    return {i: sorted({(a, -good[c][1], b) for j, a, b, _, c in tokens if j == i and c in good}) for i in texts}


@pytest.mark.parametrize("seed", range(3))
def test_bootstrapping_matches_a_plain_one(spark, seed):
    rng = random.Random(seed)
    sure = [lambda: f"u{rng.randint(0, 40)}@m{rng.randint(0, 3)}.com", lambda: f"10.0.{rng.randint(0, 9)}.{rng.randint(0, 9)}", lambda: f"+49 30 12{rng.randint(1000, 1999)}"]
    odd = [lambda: f"id_{rng.randint(0, 60)}x", lambda: f"555 12{rng.randint(10, 40)}", lambda: f"({rng.randint(1000, 1030)})", lambda: "word"]
    contexts = {c: rng.choice(sure) for c in ("mail to", "Reach me:", "host at", "call\non", "her alias", "runs  under")}
    texts = {}
    for i in range(250):
        words = []
        for _ in range(rng.randint(1, 5)):
            context = rng.choice(list(contexts))
            words.append(f"{context} {contexts[context]() if rng.random() < (0.9 if context != 'her alias' else 0.2) else rng.choice(odd[:2] if rng.random() < 0.98 else odd)()}")
        texts[i] = rng.choice([" and ", ", then ", "\n"]).join(words) + rng.choice(["", " end", "."])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = plain_found(texts)
    got = {r["doc_id"]: sorted((s["start"], s["kind"], s["end"]) for s in r["found"]) for r in pii.personal_data(df).collect()}
    assert got == want and sum(map(len, want.values())) > 20


def test_a_conversation_of_very_many_turns(spark):
    n = 60_000
    rows = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 3 = 0, 'user', 'assistant') AS role", "concat('a <s> [INST] ', id) AS text")
    start = time.time()
    row = chat_format.digests(chat_format.format_conversations(rows)).first()
    assert row["n_turns"] == n and time.time() - start < 60
    assert row["loss_chars"] == sum(len(f"a <s> [INST] {i}") for i in range(n) if i % 3)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, base int")
    assert pii.report(docs).count() == 0 and sharding.assign_shards(docs).count() == 0
    assert chat_format.digests(chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def plain_jump(key, shards, uniform):
    b, j, i = 0, 0, 0
    while j < shards:
        b, i = j, i + 1
        j = int((b + 1) / uniform[key, i])
    return b


def test_jumps_follow_the_published_loop(spark):
    keys = list(range(-50, 50))
    numbers = spark.createDataFrame([(k, i) for k in keys for i in range(1, 40)], "k long, i int").select("k", "i", F.xxhash64("k", "i").alias("h")).collect()
    uniform = {(r["k"], r["i"]): (((r["h"] % (1 << 64)) >> 11) + 1) / (1 << 53) for r in numbers}
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 16, 17, 1000):
        for k, got in df.select("k", sharding.jump_hash(F.col("k"), shards)).collect():
            assert got == plain_jump(k, shards, uniform)
