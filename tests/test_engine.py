"""Parsers, plans, splitters, catalog rules and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cairn.functions import split
from cairn.functions import text as T
from cairn.operators import catalog, lexical, navigation, ranking
from cairn.plans import engine
from cairn.plans.catalog_queries import _folders
from cairn.sources import readers
from cairn.streaming import events


def shown(tree):
    return tree.text if isinstance(tree, lexical.Term) else f"({tree.name} {' '.join(map(shown, tree.parts))})"


@pytest.mark.parametrize("text,tree", [("a", "a"), ("a AND b OR c", "(OR (AND a b) c)"), ("a OR b AND c", "(OR a (AND b c))"), ("NOT a and b", "(AND (NOT a) b)"), ("(a OR 'b c') AND not \"d\"", "(AND (OR a b c) (NOT d))"), ("a AND b AND c", "(AND (AND a b) c)"), ("NOT NOT a", "(NOT (NOT a))"), ("NOT (a OR b)", "(NOT (OR a b))")])
def test_boolean_grammar(text, tree):
    assert shown(lexical.parse_boolean(text)) == tree


@pytest.mark.parametrize("text", ["", "a b", "a NOT b", "a AND", "(a", "a)", "OR a", "()", "'open"])
def test_boolean_errors(text):
    with pytest.raises(ValueError):
        lexical.parse_boolean(text)


def test_match_modes(spark):
    rows = spark.createDataFrame([("a.b",), ("A.B\n",), ("xa.b",), ("axb",), (None,)], "t string")
    count = lambda mode: rows.filter(lexical.matches(F.col("t"), "a.b", mode)).count()
    assert [count(m) for m in ("exact", "prefix", "regex", "fuzzy")] == [1, 2, 4, 3]
    assert lexical.resolve_mode("a or b", "literal") == "boolean" and lexical.resolve_mode("a", "odd") == "literal"


def test_grep_bounds(spark):
    rows = spark.createDataFrame([(1, "x")], "chunk_id int, search_text string")
    with pytest.raises(ValueError):
        lexical.grep_chunks(rows, "q" * 501)
    assert lexical.grep_chunks(rows, "x", top_k=99).collect()[0]["snippet"] == ">>>x<<<"


def test_plans():
    plan = engine.parse_plan('so ```json\n{"routes": [{"name": "bm25_sparse", "top_k": 7}, {"name": "nope"}]}\n```')
    assert [r.name for r in engine.validated(plan, {"bm25_sparse"}, 5).routes] == ["bm25_sparse"] and plan.rerank_top_n == 50
    assert [(r.name, r.top_k) for r in engine.validated(plan, set(), 5).routes] == [("chunk_dense", 15), ("bm25_sparse", 15)]
    assert engine.default_plan(20).rerank_top_n == 100
    assert [r.name for r in engine.for_mode(engine.default_plan(5), "lexical", 5).routes] == ["bm25_sparse"]
    assert len(engine.for_mode(engine.default_plan(5), "graph", 5).routes) == 3
    with pytest.raises(ValueError):
        engine.parse_plan("nothing")


def test_registry():
    e = engine.Engine()
    e.register("a", lambda q, k, p: None)
    assert e.names() == ["a"] and e.describe() == {"a": ""}
    e.unregister("a")
    assert e.names() == []


def test_rrf_counts_a_repeated_chunk_twice(spark):
    rows = spark.createDataFrame([("r", 0, 1, "x", 1.0), ("r", 0, 2, "x", None), ("s", 1, 1, "y", 0.5)], "route string, route_no int, rank int, chunk_id string, score double")
    got = {r["chunk_id"]: r for r in ranking.rrf(rows).collect()}
    assert got["x"]["routes"] == ["r", "r"] and abs(got["x"]["score"] - (1 / 61 + 1 / 62)) < 1e-9
    flat = {r["chunk_id"]: r["score"] for r in ranking.weighted(rows).collect()}
    assert flat == {"x": 1.0, "y": 1.0}
    with pytest.raises(ValueError):
        ranking.fuse(rows, "other")


def test_pieces_are_short_and_whole():
    text = "。".join("字" * n for n in (5, 80, 3)) + "\n" + " ".join(["word"] * 50)
    out = split.recursive_pieces(text, 40, 0)
    assert all(len(p) <= 40 for p in out) and "".join("".join(out).split()) == "".join(text.replace("。", "").split()) and split.recursive_pieces("  ", 5, 0) == []


def test_structure_first(spark):
    rows = spark.createDataFrame([("aa\n\nbb\n\ncccc\n\nd",), ("aa\n\n" + "x" * 20 + "\n\nb",), ("",)], "t string")
    got = [r[0] for r in rows.select(split.split_structure_first(F.col("t"), 6, 0)).collect()]
    assert got[0] == ["aa\n\nbb", "cccc", "d"] and got[1][0] == "aa" and got[1][-1] == "b" and all(len(p) <= 6 for p in got[1]) and got[2] == []


def test_languages(spark):
    texts = {"你好世界": "zh", "これはペンです漢字": "ja", "안녕": "ko", "Привет": "ru", "مرحبا": "ar", "नमस्ते": "hi", "สวัสดี": "th", "hello": "en", "123 !": "en", "かな漢": "zh"}
    rows = spark.createDataFrame([(k,) for k in texts], "t string")
    assert {r[0]: r[1] for r in rows.select("t", T.language(F.col("t"))).collect()} == texts


def test_ranges(spark):
    heads = {"bytes=0-9": (0, 9, 10), "bytes=90-": (90, 99, 10), "bytes=-5": (95, 99, 5), "bytes=0-1,2-3": None, "bytes=200-": None, "bytes=5-2": None, "bytes=-": None, "bytes=50-500": (50, 99, 50)}
    rows = spark.createDataFrame([(k,) for k in heads], "h string")
    assert {r[0]: tuple(r[1]) if r[1] else None for r in rows.select("h", T.byte_range(F.col("h"), F.lit(100).cast("long"))).collect()} == heads


def test_folders(spark):
    rows = _folders(spark)
    for bad in (3, 2):
        with pytest.raises(ValueError):
            catalog.move_subtree(rows, 2, bad)
    assert {r["folder_id"] for r in catalog.hard_delete(rows, 1).collect()} == {5, 6}
    gone = catalog.delete_subtree(rows, 2)
    assert {r["folder_id"]: r["deleted"] for r in gone.collect()} == {1: 0, 2: 1, 3: 2, 4: 1, 5: 0, 6: 0}


def test_directions():
    navigation.check_direction("document", "chunk", True)
    for a, b, down in (("chunk", "document", True), ("document", "chunk", False), ("chunk", "chunk", True)):
        with pytest.raises(ValueError):
            navigation.check_direction(a, b, down)


def test_outline_of_a_cycle_ends(spark):
    rows = spark.createDataFrame([(1, 2), (2, 1), (3, None)], "section_id int, parent_id int")
    assert [tuple(r) for r in navigation.outline(rows).collect()] == [(3, 0, "3")]


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": [1, "é"]}')
    (tmp_path / "b.csv").write_text("x,y\r\n1,2\r\n")
    j = readers.read_files(spark, f"{tmp_path}/*.json", "json").select(F.explode("root").alias("p")).select(F.explode("p.page_info").alias("e")).select("e.*").collect()[0]
    assert j["type"] == "text" and json.loads(j["text"]) == {"k": [1, "é"]}
    c = readers.read_files(spark, f"{tmp_path}/*.csv", "csv").selectExpr("root[0].page_info[0].table_body AS b").collect()[0]
    assert c["b"] == "x,y\n1,2"
    with pytest.raises(ValueError):
        readers.read_files(spark, str(tmp_path), "xls")


def test_stream_equals_batch(spark, tmp_path):
    """Deduplication and windows over a file stream give what a batch gives."""
    src = f"{tmp_path}/in"
    rows = spark.range(60).selectExpr("CAST(id % 20 AS string) AS event_id", "timestamp_seconds(1700000000 + id % 20 * 60) AS timestamp", "CAST(id AS double) AS value")
    rows.repartition(3).write.parquet(src)
    stream = readers.stream(spark, "parquet", "event_id string, timestamp timestamp, value double", path=src)
    query = events.deduplicated(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r[0] for r in got.select("event_id").collect()) == sorted(r[0] for r in events.deduplicated(rows).select("event_id").collect())


def test_worker_keeps_good_and_bad_apart(spark, tmp_path):
    out = {"good": [], "bad": []}
    run = events.worker(lambda b: (b.filter("v > 0"), b.filter("v <= 0")), lambda d: out["good"].extend(d.collect()), lambda d: out["bad"].extend(d.collect()))
    run(spark.createDataFrame([("1", 1), ("1", 1), ("2", -1)], "event_id string, v int"), 0)
    assert len(out["good"]) == 1 and len(out["bad"]) == 1
    off = events.worker(None, None, None, enabled=False)
    assert off(None, 1) is None


def test_envelopes(spark):
    rows = spark.createDataFrame([('{"event_id": "e", "user_id": "u", "file_id": "f", "retry_count": 1}',), ("no json",)], "value string")
    got = events.decode(rows)
    assert [r["event_id"] for r in got.collect()] == ["e", None]
    assert events.encode(got.filter("event_id = 'e'")).collect()[0]["key"] == "u:f"


def test_nothing_outside_imports_the_training_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for top, _, names in os.walk(os.path.join(root, "cairn")):
        for n in names:
            if n.endswith(".py") and f"{os.sep}llm" not in top:
                assert "cairn.llm" not in open(os.path.join(top, n), encoding="utf-8").read(), n
