"""Exact search and chat formatting against brute force and round trips."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cairn.llm import chat_format, topk_search
from cairn.llm.queries import QUERIES


def brute(vectors, asked, k):
    fine = {i: [math.floor(256 * x) for x in v] for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in asked:
        if q in fine:
            scores = sorted(((-sum(a * b for a, b in zip(fine[q], v)), i) for i, v in fine.items() if i != q))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)}
    return out


def test_search_with_nulls_ties_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(60)] + [(100 + i, [0.5] * 8) for i in range(20)]
    rows += [(200, None), (201, [None] * 8), (202, [float("nan")] * 8), (203, [float("inf")] + [0.0] * 7), (204, [0.0] * 8), (None, [0.1] * 8), (205, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("block", F.lit(1))
    index = topk_search.build_index(df, block=16)
    got = topk_search.search(index, df.filter("vec_id % 4 = 0"), k=5)
    assert {tuple(r) for r in got.collect()} == brute(rows, [i for i, _ in rows if i is not None and i % 4 == 0], 5)


def test_search_keeps_large_vectors_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(0, 2.0**21, 8)).tolist()) for i in range(40)] + [(50 + i, [2.0**23 + i * 2.0**-8] + [0.0] * 7) for i in range(8)] + [(60, [0.0] * 8 + [1e12]), (61, [0.1] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [i for i, _ in rows if i < 60 and i % 3 == 0] + [61]
    got = topk_search.search(topk_search.build_index(df, block=16), df.filter(F.col("vec_id").isin(asked)), k=5)
    assert {tuple(r) for r in got.collect()} == brute(rows, asked, 5)


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.search(topk_search.build_index(empty), empty).count() == 0


def test_format_round_trip(spark):
    rows = [(1, 0, "user", "a\\l\\\\<s>[INST]\\b"), (1, 1, "user", None), (1, 2, "assistant", "</s>[/INST]<s"), (1, 3, "assistant", "b\\"), (2, None, None, ""), (3, 0, "assistant", "x" * 200_000), (4, 1, "user", "tie"), (4, 1, "user", "tie"), (None, 0, "system", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    made = chat_format.format_conversations(df)
    got = {r[0]: (r[1], r[2]) for r in made.select("conv_id", chat_format.read_conversation(F.col("formatted")).alias("turns"), chat_format.learnt_text(F.col("formatted"), F.col("loss")).alias("learnt")).collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in rows if c == conv)
        assert [tuple(t) for t in got[conv][0]] == [(r, x) for _, r, x in own]
        assert got[conv][1] == "".join(x for _, r, x in own if r == "assistant")
    for r in made.filter("conv_id < 3").collect():
        assert "[INST]" not in r["formatted"].split("[/INST]", 1)[1].split("</s>")[0].replace("[/INST]", "")


def test_chat_query_has_the_control_conversation(spark):
    rows = {r["conv_id"]: r for r in QUERIES["op3_chat"](spark, "/root/testdata/sf0.001").collect()}
    assert rows[-1]["n_turns"] == 2 and rows[-1]["loss_chars"] == len("</s>[INST] ok [/INST]")


def test_the_walk_multiplies_less_than_brute_force_and_skips_blocks():
    rng = np.random.default_rng(8)
    vectors = rng.normal(0, 1, (3000, 512)) * 16 * np.where(np.arange(3000) % 3, 0.3, 1.0)[:, None]
    table = pa.table({"tile": pa.array(np.zeros(3000, np.int32)), "id": pa.array(np.arange(3000)), "q": pa.array(np.floor(vectors).tolist(), pa.list_(pa.float64()))})
    parts = topk_search._segments(500)(table)
    number = parts.column("block").to_numpy()
    blocks = [topk_search.Block(parts.take(pa.array(np.flatnonzero(number == b))), 512) for b in range(6)]
    ask = np.floor(vectors[:30])
    best, work = topk_search.walk(blocks, np.arange(30), ask, 5)
    assert work < 0.8 * 30 * 3000 * 512
    for i in range(30):
        scores = np.floor(vectors) @ ask[i]
        scores[i] = -np.inf
        assert best[i] == [(int(scores[j]), j) for j in np.lexsort((np.arange(3000), -scores))[:5]]


def test_search_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "TILE_VALUES", 100)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(0, 0.4, 8).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r[0], r[1]) for r in df.collect()]
    got = topk_search.search(topk_search.build_index(df, block=4), df.filter("vec_id % 5 = 0"), k=5)
    assert {tuple(r) for r in got.collect()} == brute(rows, range(0, 120, 5), 5)
