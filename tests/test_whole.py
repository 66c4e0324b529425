"""Queries over the whole of their tables: no id is left out."""

import re

import pytest

from cairn import registry

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,key,source,column", [
    ("N21_chunk_position", "chunk_id", "lineitem", "l_orderkey"), ("T27_section_text", "section_id", "lineitem", "l_orderkey"),
    ("N1_document_sections", "document_id", "orders", "o_custkey"), ("N2_document_chunks", "chunk_id", "lineitem", "l_orderkey * 10 + l_linenumber"),
])
def test_every_id_is_answered(spark, name, key, source, column):
    got = registry.QUERIES[name](spark, SF).select(key).distinct()
    every = registry.table(spark, SF, source).selectExpr(f"{column} AS {key}").distinct()
    assert got.count() == every.count() and every.join(got, key, "left_anti").count() == 0


def test_lines_are_packed_whatever_the_id(spark, tmp_path):
    texts = {i: "\n".join(f"{i} {j} " + "x" * (j * 97 % 800) for j in range(n)) for i, n in ((5, 3), (999_999, 9), (1_000_000, 12), (7_000_001, 1))}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in texts.items():
        packed = []
        for line in text.split("\n"):
            if packed and len(packed[-1]) + len(line) + 2 <= 1500:
                packed[-1] += "\n\n" + line
            else:
                packed.append(line)
        want += [(i, seq, chunk) for seq, chunk in enumerate(packed)]
    assert sorted(map(tuple, registry.QUERIES["T6_pack_lines"](spark, str(tmp_path)).collect())) == want


def test_rows_of_pages_with_tables(spark, tmp_path):
    pages = ["no table", "", None, "<table><TR class=a><th>h <b>1</b></th><td> 2\n</td></TR>\n<tr><td></td></tr><tr>no cell</tr></table>", "<p>x<table><tr><td>a</td><td></td></tr><tr><TD colspan=2>b\nc</TD></tr></table>y", "<tr><td>open"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")

    def brute(text):
        if text is None or "<tr" not in text.lower():
            return text
        rows = [re.findall(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", r) for r in re.findall(r"(?is)<tr[^>]*>(.*?)</tr>", text)]
        lines = [" | ".join(re.sub(r"<[^>]+>", "", c).strip().replace("\n", " ") for c in r) for r in rows if r]
        return "\n".join(lines) if lines else text.strip()

    got = dict(map(tuple, registry.QUERIES["X1_html_rows"](spark, str(tmp_path)).collect()))
    assert got == {i: brute(x) for i, x in enumerate(pages)} and got[3] == "h 1 | 2\n" and got[4] == "a | \nb c"


def test_every_chunk_with_neighbours_is_an_anchor(spark):
    rows = registry.table(spark, SF, "lineitem").selectExpr("l_orderkey", "l_orderkey * 10 + l_linenumber AS anchor")
    every = rows.join(rows.groupBy("l_orderkey").count().filter("count > 1"), "l_orderkey", "left_semi").select("anchor").distinct()
    got = registry.QUERIES["N15_context_window"](spark, SF).select("anchor").distinct()
    assert got.count() == every.count() and every.join(got, "anchor", "left_anti").count() == 0


def test_summaries_become_the_nearest_five_of_all_chunks(spark):
    rows = registry.QUERIES["R11_align_summaries"](spark, SF).collect()
    for document in {r["document_id"] for r in rows}:
        assert 1 <= len([r for r in rows if r["document_id"] == document]) <= 5
    assert any(r["chunk_id"] % 10 > 2 for r in rows)  # beyond the first two of a section
