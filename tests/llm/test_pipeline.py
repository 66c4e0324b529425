"""Each stage of the pipeline on its own input, against plain versions and on odd rows."""

import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cairn.llm.runtime import cut
from tests.llm.test_documents import ODD, PATTERNS, classes, plain_spans

DATA = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def states(spark):
    """The input of each stage, and what the last one returns."""
    out = [cut(spark.read.parquet(f"{DATA}/documents.parquet"))]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], DATA)))
    return dict(zip([*STAGES, "end"], out))


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns_and_order(states, spark):
    assert list(STAGES) == ["quality", "near_dedup", "decontamination", "pii", "bpe"]
    first = spark.read.parquet(f"{DATA}/documents.parquet").columns
    assert all(states[s].columns == first for s in STAGES)


def test_quality_rejects_what_labels_reject(states, spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = texts(states["near_dedup"])
    right = [(i in kept) == bool(q) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.9
    assert set(kept.items()) <= set(texts(states["quality"]).items())


def test_near_copies(states):
    want = classes(texts(states["near_dedup"]), 5, 80)
    assert set(texts(states["decontamination"])) == {i for i, (_, _, kept) in want.items() if kept}


def test_benchmarks(states, spark):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower().encode())
    grams = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = words(r["text"])
        grams |= {tuple(w[i : i + min(10, len(w))]) for i in range(len(w) - min(10, len(w)) + 1) if w}
    sizes = {len(g) for g in grams}
    bad = lambda t: any(tuple(w[i : i + n]) in grams for w in [words(t)] for n in sizes for i in range(len(w) - n + 1))
    before = texts(states["decontamination"])
    assert set(texts(states["pii"])) == {i for i, t in before.items() if not bad(t)}


def test_personal_data(states):
    before, after = texts(states["pii"]), texts(states["bpe"])
    assert set(before) == set(after) and len(PATTERNS) == 4
    for i, t in before.items():
        assert not plain_spans(after[i])
        if not plain_spans(t):
            assert after[i] == t


def test_encoding(states):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    before = texts(states["bpe"])
    rows = states["end"].collect()
    assert len(rows) == len(before)
    for r in rows:
        assert r["ids"] == tokenizer.encode(before[r["doc_id"]] or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def odd_rows(spark, empty=False):
    rows = [(i, t, None if i % 2 else "en", None, None if i % 3 else 5, "clash", None) for i, t in enumerate(ODD)]
    rows += [rows[5], (None, "nobody's text", None, None, None, None, None), (None, None, None, None, None, None, None)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, node string, score double"
    return spark.createDataFrame([] if empty else rows, kinds)


@pytest.mark.parametrize("name", list(STAGES))
def test_odd_rows(spark, name):
    df = odd_rows(spark)
    out = STAGES[name](spark, df, DATA)
    n = out.count()
    if name == "bpe":
        assert n == df.count()
    else:
        assert out.columns == df.columns
        assert n == df.count() - (1 if name == "near_dedup" else 0) or name == "quality"
        if name in ("near_dedup", "decontamination"):
            assert out.filter(F.col("doc_id").isNull()).count() == 2
    none = STAGES[name](spark, odd_rows(spark, empty=True), DATA)
    assert none.count() == 0


def test_texts_under_a_repeated_id_are_not_lost(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a, "x"), (1, b, "y"), (1, a, "x"), (2, a + " z", "z"), (3, None, None), (3, "", None), (3, "new text here", None), (None, a, None), (4, b.upper(), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, STAGES["near_dedup"](spark, df, DATA).collect()), key=repr)
    assert (1, a, "x") in got and (1, b, "y") in got and (3, "new text here", None) in got and (None, a, None) in got
    assert not any(r[0] in (2, 4) for r in got) and sum(r[0] == 1 for r in got) == 2


def test_run_leaves_the_last_table_alone(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.columns == ["doc_id", "n_tokens", "ids"] and rows.count() > 0
