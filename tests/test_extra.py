"""The engine with its built-in routes, sinks over tables, outlines with cycles, against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import split
from cairn.operators import navigation
from cairn.plans import routes
from cairn.plans.engine import Engine, Plan, Route
from cairn.streaming import sinks

TOPICS = ["alpha", "beta", "gamma", "delta"]


def embed(text):
    return [1.0 + text.lower().split().count(t) for t in TOPICS]


@pytest.fixture(scope="module")
def corpus():
    """chunk -> (section, document, ord, text); section s of document s // 3; chunk c of section c // 7."""
    rng = random.Random(3)
    return {c: (c // 7, c // 21, c % 7, " ".join(rng.choices(TOPICS, k=6))) for c in range(126)}


@pytest.fixture(scope="module")
def store(spark, corpus):
    chunks = spark.createDataFrame([(c, *r) for c, r in corpus.items()], "chunk_id long, section_id long, document_id long, ord int, text string")
    sections = spark.createDataFrame([(s, s // 3, s) for s in range(18)], "section_id long, document_id long, ord int")
    vectors = lambda rows: spark.createDataFrame([(i, embed(t)) for i, t in rows], "id long, embedding array<double>")
    chunk = [(c, r[3]) for c, r in corpus.items()]
    section = [(s, " ".join(r[3] for r in corpus.values() if r[0] == s)) for s in range(18)]
    qa = [(900, "an answer", [3, 3, 70], None), (901, " ", [5], None), (902, "low", None, 9)]
    made = {"chunk": vectors(chunk), "enhanced_chunk": vectors(chunk), "section": vectors(section), "section_summary": vectors(section), "file_summary": vectors([(d, TOPICS[d % 4]) for d in range(6)]), "qa": vectors([(900, "alpha alpha"), (901, "beta"), (902, "gamma")])}
    questions = spark.createDataFrame(qa, "id long, answer string, source_chunk_ids array<long>, chunk_id long")
    return routes.Store(chunks, sections, made, questions, embed)


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def test_nine_routes(store):
    engine = Engine(store)
    assert tuple(sorted(engine.names())) == tuple(sorted(routes.NAMES)) and all(engine.describe().values())
    assert engine.is_semantic("qa_dense") and engine.is_lexical("bm25_sparse")
    engine.unregister("qa_dense")
    assert "qa_dense" not in engine.names()
    for name in engine.names():
        rows = engine.single(name, "alpha", 5).collect()
        assert 0 < len(rows) <= 5 and {"chunk_id", "score", "kind", "key"} <= set(rows[0].asDict())
    with pytest.raises(ValueError):
        routes.Store(store.chunks, store.sections).query_vector("x", {})


def test_dense_route_is_exact(store, corpus):
    got = [(r["key"], r["score"]) for r in Engine(store).single("chunk_dense", "alpha beta", 9).collect()]
    want = sorted(((c, round(cosine(embed(r[3]), embed("alpha beta")), 9)) for c, r in corpus.items()), key=lambda x: (-x[1], x[0]))[:9]
    assert got == want


def test_scope_limits_routes(store):
    scoped = routes.Store(store.chunks, store.sections, store.vectors, store.qa, embed, store.sections.filter("document_id = 2"))
    for name in ("chunk_dense", "bm25_sparse", "exact_match"):
        assert {r["key"] // 21 for r in Engine(scoped).single(name, "alpha", 50).collect()} == {2}


def test_alignment_takes_the_nearest_chunks(store, corpus):
    engine, q = Engine(store), "alpha"
    plan = Plan([Route("section_dense", 3), Route("file_summary_dense", 2), Route("qa_dense", 3), Route("chunk_dense", 4)])
    rows, evidence = engine.candidates(q, plan)
    got = {(r["route"], r["rank"]): (r["chunk_id"], r["score"]) for r in rows.collect()}
    near = lambda c: round(cosine(embed(corpus[c][3]), embed(q)), 9)
    pinned = {r["chunk_id"] for r in evidence.collect()}
    assert pinned == {"3", "70"}
    hits = [(r["key"], r["score"]) for r in engine.single("section_dense", q, 3).collect()]
    want, rank = {}, 0
    for s, score in hits:
        for c in sorted((c for c in corpus if corpus[c][0] == s), key=lambda c: (-near(c), corpus[c][2], c))[:5]:
            rank += 1
            want["section_dense", rank] = (str(c), round(score * 0.9, 9))
    rank = 0
    for d, score in [(r["key"], r["score"]) for r in engine.single("file_summary_dense", q, 2).collect()]:
        for c in sorted((c for c in corpus if corpus[c][1] == d), key=lambda c: (-near(c), corpus[c][0], corpus[c][2]))[:5]:
            rank += 1
            want["file_summary_dense", rank] = (str(c), round(score * 0.7, 9))
    want = {k: v for k, v in want.items() if v[0] not in pinned}
    assert {k: v for k, v in got.items() if k[0] in ("section_dense", "file_summary_dense")} == want
    assert {v[0] for k, v in got.items() if k[0] == "qa_dense"} == {"5", "9"}


def test_retrieve_leaves_pinned_chunks_out(store):
    rows = Engine(store).retrieve("alpha", top_k=20, plan=Plan([Route("qa_dense", 3), Route("chunk_dense", 60), Route("bm25_sparse", 60)])).collect()
    assert len(rows) == 20 and not {"3", "70"} & {r["chunk_id"] for r in rows}
    assert len(Engine(store).retrieve("alpha", top_k=5, mode="lexical", skip_rerank=True).collect()) == 5


def outlined(rows, most):
    """A recursive walk: (key, depth, parent) in reading order."""
    known, seen, out = {k for k, _, _ in rows}, set(), []
    rows = sorted(rows, key=lambda r: (r[2], r[0]))

    def walk(k, above, depth):
        if k in seen:
            return
        seen.add(k)
        out.append((k, depth, above))
        if depth < most:
            for c, p, _ in rows:
                if p == k:
                    walk(c, k, depth + 1)

    for k, p, _ in [r for r in rows if r[1] is None or r[1] not in known] + rows:
        walk(k, None, 1)
    return out


def test_skeleton_takes_up_cycles_and_deep_sections(spark):
    rng, rows = random.Random(2), []
    for d in range(30):
        n = rng.randint(1, 25)
        for k in range(n):
            rows.append((d, k, rng.choice([None, 99, *range(n)]), rng.randint(0, 30)))
    df = spark.createDataFrame(rows, "document_id long, section_id long, parent_id long, ord int")
    got = {}
    for r in sorted(navigation.skeleton(df, max_depth=3).collect(), key=lambda r: (r["document_id"], r["pos"])):
        got.setdefault(r["document_id"], []).append((r["section_id"], r["depth"], r["parent_id"]))
    assert got == {d: outlined([r[1:] for r in rows if r[0] == d], 3) for d in got}
    assert sum(map(len, got.values())) == len(rows)


def test_batches_of_changes_change_tables(spark, tmp_path):
    store = sinks.TableStore(spark, str(tmp_path), {"chunk": ["id"], "node": ["type", "name"]})
    store.create("chunk", spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "id long, text string, note string"))
    store.create("node", spark.createDataFrame([("t", "n", 1)], "type string, name string, n int"))
    rows = [(1, "chunk", "update", "1", '{"id": 1, "text": "A"}'), (2, "chunk", "delete", "2", '{"id": 2}'), (3, "chunk", "insert", "4", '{"id": 4, "text": "d"}'), (4, "chunk", "upsert", "3", '{"id": 3, "text": "C", "note": "n"}'),
            (5, "node", "upsert", "t:m", '{"type": "t", "name": "m", "n": 2}'), (6, "chunk", "fly", "1", "{}"), (7, "moon", "insert", "1", "{}"), (8, "chunk", "insert", None, '{"id": 9}'), (9, "chunk", "update", "77", '{"id": 77, "text": "?"}')]
    refused = store.write_batch(spark.createDataFrame(rows, "seq long, target string, operation string, key string, row string"))
    assert {(r["seq"], r["reason"]) for r in refused.collect()} == {(6, "operation"), (7, "target"), (8, "key")}
    assert sorted(map(tuple, store.read("chunk").collect())) == [(1, "A", "x"), (3, "C", "n"), (4, "d", None)]
    assert sorted(map(tuple, store.read("node").collect())) == [("t", "m", 2), ("t", "n", 1)]


def test_vector_rows_refuse_what_lacks_a_field(spark):
    df = spark.createDataFrame([(1, "a", "u"), (2, " ", "u"), (3, "c", None)], "id long, text string, user_id string")
    kept, refused = sinks.vector_rows(df, "text", ["id", "user_id"])
    assert [r["id"] for r in kept.collect()] == [1] and [r["id"] for r in refused.collect()] == [3]
    assert sinks.trigger("vector") == {"processingTime": "500 milliseconds"}


@pytest.mark.parametrize("strategy", split.STRATEGIES)
def test_splitters_by_name(spark, strategy):
    text = "one two three. " * 40 + "\n\n" + "four five " * 30
    pieces = spark.createDataFrame([(text,)], "t string").select(split.split_text(F.col("t"), strategy, 60, 20)).first()[0]
    assert len(pieces) > 1 and "four" in " ".join(pieces)
    with pytest.raises(ValueError):
        split.split_text(F.col("t"), strategy, 10, 10)
    with pytest.raises(ValueError):
        split.split_text(F.col("t"), "by eye")
