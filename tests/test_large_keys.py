"""Queries against their SQL where keys are as large as at 1 GB and more."""

import duckdb
import pytest

from cairn import registry
from tests.test_oracles import rows_of

registry.load()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Orders whose parts lie on both sides of a million, with repeated lines and parts that aren't known."""
    path = str(tmp_path_factory.mktemp("large"))
    lines = [(1, 1, 1_150_000), (1, 2, 7), (2, 1, 1_000_005), (2, 2, 3), (2, 2, 3), (3, 3, 1_199_999), (3, 3, 20), (3, 4, 20), (4, 7, 123_456_789), (4, 6, 999_999), (5, 1, 5_000_000_000), (5, 2, 1), (6, 1, 2), (6, 1, 777), (7, 1, 777), (8, 1, 1_000_009), (8, 2, 9)]
    parts = [(p, 6 + i) for i, p in enumerate(sorted({p for _, _, p in lines} - {777, 9}))] + [(9, 5)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{path}/part.parquet")
    return path


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return con


def same(spark, duck, folder, name):
    got, want = registry.QUERIES[name](spark, folder), duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want.fetchall())


def test_chunk_position(spark, duck, folder):
    same(spark, duck, folder, "N21_chunk_position")


def test_section_text(spark, duck, folder):
    same(spark, duck, folder, "T27_section_text")
