"""Exact top-k by inner product over an impact-ordered index, score at a time.

The index deals the vectors into tiles by a hash of their id, and cuts a tile into blocks by descending length. Of each
block it holds posting segments: for each dimension and each level of quantised impact (the number of bits of the
component's size) the vectors with such a component, and the components. A search walks a block's segments by
descending level and adds up what they contribute to the scores of a few queries at a time. What is still missing
from a vector's score is at most |query| times the length of its unprocessed part. When these bounds prove that few
vectors can be members, so that rescoring them costs less than the next level, the walk stops and rescores
those exactly, with all of their components. A query's k-th best score so far carries over to the next
block; blocks whose longest vector can't reach it are skipped, as are all after them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors of a block, and queries that walk it together: their scores fit a processor's cache.
BLOCK, PASS = 8192, 64
#: Components of a tile and of a share of the queries, at most about: tens of megabytes each. Every share meets every tile, so
#: what is exchanged grows with tiles times shares, and the larger they are the less.
TILE_VALUES = 4 << 20
SCALE = 256.0
#: Doubles from here on are whole numbers, and sums may lose units; beyond MOST, which no float reaches, squares could overflow.
WHOLE, MOST = 2.0**53, 2.0**400


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component, as double; null if the vector is null or empty, or a component null, not finite or beyond MOST."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= MOST))
    return F.when(fine & (F.size(x) > 0), F.transform(x, lambda v: F.when(F.abs(v) < WHOLE / SCALE, F.floor(v * SCALE).cast("double")).otherwise(v * SCALE)))


_INDEX = "tile int, block int, level int, dim int, members array<int>, ids array<long>, impacts array<double>"


def _segments(size: int):
    """One tile's vectors -> the posting segments of its blocks; a block's row of dimension -1 has its vectors' ids."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        tile = table.column("tile")[0].as_py()
        lists, ids = table.column("q").combine_chunks(), table.column("id").to_numpy()
        sizes = np.diff(lists.offsets.to_numpy())
        values = lists.flatten().to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        dim = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rank = np.empty(len(sizes), np.int64)
        rank[np.argsort(-np.bincount(row, values * values, len(sizes)), kind="stable")] = np.arange(len(sizes))
        names = np.empty(len(sizes), np.int64)
        names[rank] = ids
        row = rank[row]
        block = row // size
        level = np.ceil(np.log2(np.abs(values) + 1)).astype(np.int64)
        order = np.lexsort((row, dim, -level, block))
        order = order[level[order] > 0]  # a component of 0 contributes nothing
        key = np.stack([block[order], level[order], dim[order]])
        cut = np.flatnonzero(np.any(np.diff(key, axis=1, prepend=-1), axis=0))
        blocks = -(-len(sizes) // size)
        count, ends = len(cut) + blocks, np.append(cut, len(order))
        none = np.zeros(blocks + 1, np.int64)
        whole = np.minimum(np.arange(blocks + 1) * size, len(sizes))
        lists = lambda offsets, v, t: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(v, t))
        column = lambda head, rest: pa.array(np.concatenate([head, rest]).astype(np.int32))
        return pa.table({
            "tile": pa.array(np.full(count, tile, np.int32)),
            "block": column(np.arange(blocks), key[0][cut]),
            "level": column(np.full(blocks, -1), key[1][cut]),
            "dim": column(np.full(blocks, -1), key[2][cut]),
            "members": lists(np.append(none[1:], ends), row[order] % size, pa.int32()),
            "ids": lists(np.append(whole, np.full(len(cut), len(sizes))), names, pa.int64()),
            "impacts": lists(np.append(none[1:], ends), values[order], pa.float64()),
        })

    return run


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col)).alias("q")).filter("id IS NOT NULL AND q IS NOT NULL")
    return rows.groupBy("id").agg(F.min("q").alias("q"))


def _dealt(rows: DataFrame, name: str, least: int) -> tuple[DataFrame, int]:
    """rows with a column that deals them by id into tiles of about TILE_VALUES components, and how many there are."""
    n, values = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("q")), F.lit(0))).first()
    tiles = max(1, -(-values // TILE_VALUES), min(least, -(-n // BLOCK)))
    return rows.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")), tiles


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(tile, block, level, dim, members, ids, impacts): the posting segments of all vectors.

    Vectors that are null, empty or hold null or non-finite components, and rows without an id, take no part. A score
    beyond 64 bits that is among a query's best is an error, as in the SQL. Rows that
    repeat an id count once, with the smallest of their vectors. Vectors may differ in length; what is missing is 0.
    """
    dealt, _ = _dealt(_rows(vectors, id_col, vector_col), "tile", vectors.sparkSession.sparkContext.defaultParallelism)
    return dealt.groupBy("tile").applyInArrow(_segments(block), _INDEX)


class Block:
    """One block's segments by descending level, and what bounds need of its vectors."""

    def __init__(self, part: pa.Table, width: int):
        part = part.sort_by([("level", "descending"), ("dim", "ascending")])
        levels, dims = part.column("level").to_numpy(), part.column("dim").to_numpy()
        members, impacts = part.column("members").combine_chunks(), part.column("impacts").combine_chunks()
        self.ids = np.array(part.column("ids").combine_chunks()[len(dims) - 1].values, np.int64)
        #: (level, [(dimension, members, impacts)])
        self.levels: list[list[tuple[int, np.ndarray, np.ndarray]]] = []
        self.whole = np.zeros((len(self.ids), width))
        rests = []
        for level in sorted(set(levels[dims >= 0].tolist()), reverse=True):
            segments, rest = [], np.zeros(len(self.ids))
            for i in np.flatnonzero((levels == level) & (dims >= 0)):
                m, x = members[i].values.to_numpy(), impacts[i].values.to_numpy()
                segments.append((int(dims[i]), m, x))
                rest[m] += x * x
                self.whole[m, dims[i]] = x
            self.levels.append(segments)
            rests.append(rest)
        #: Squared length of what is left after each level; summed from the end, as differences would lose what is left.
        self.rests = [*np.cumsum(rests[:0:-1], axis=0)[::-1], np.zeros(len(self.ids))] if len(rests) > 1 else [np.zeros(len(self.ids))]
        self.lengths = np.sqrt(np.sum(rests, axis=0)) if rests else np.zeros(len(self.ids))


def walk(blocks: list[Block], asked: np.ndarray, ask: np.ndarray, k: int) -> tuple[list[list[tuple[int, int]]], int]:
    """(for each query its k best (score, id) of the blocks, multiplications that took)."""
    best: list[list[tuple[int, int]]] = [[] for _ in asked]
    least, work = np.full(len(asked), -np.inf), 0
    lengths = np.sqrt((ask * ask).sum(axis=1))
    for block in sorted(blocks, key=lambda b: -b.lengths.max(initial=0)):
        reach = lengths * block.lengths.max(initial=0) * (1 + 2.0**-36) + 0.5
        live = np.flatnonzero(reach >= least)
        if not len(live):
            break  # no later block has a longer vector
        possible, cost = _possible(block, asked[live], ask[live], lengths[live], least[live], k)
        work += cost
        for j, i in enumerate(live):
            at = np.flatnonzero(possible[:, j])
            work += len(at) * ask.shape[1]
            best[i] = _best(block, at, ask[i], lengths[i], best[i], k)
            if len(best[i]) == k:
                least[i] = float(best[i][-1][0]) * (1 - 2.0**-50) - 0.5 if abs(best[i][-1][0]) >= WHOLE else best[i][-1][0]
    return best, work


def _possible(block: Block, asked: np.ndarray, ask: np.ndarray, lengths: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """(which of the block's vectors can be among the best of which queries, multiplications that took)."""
    n, work = len(block.ids), 0
    # half as wide where no sum can overflow; what that loses is part of the slack
    kind, loss = (np.float32, 2.0**-18) if lengths.max(initial=0) * block.lengths.max(initial=0) < 2.0**100 else (np.float64, 2.0**-36)
    ask, score = ask.astype(kind), np.zeros((n, len(ask)), kind)
    own = [(np.flatnonzero(block.ids == a), j) for j, a in enumerate(asked)]
    possible = np.ones(score.shape, bool)
    for at, segments in enumerate(block.levels):
        for dim, members, impacts in segments:
            score[members] += impacts.astype(kind)[:, None] * ask[None, :, dim]
            work += len(members) * len(ask)
        rest = np.sqrt(block.rests[at]) + block.lengths * loss
        slack = np.outer(rest, lengths) + 0.5
        need = least
        if n > k and np.isinf(least).any():  # no k-th best score is known from a block before
            low = score - slack
            for i, j in own:
                low[i, j] = -np.inf
            need = np.maximum(least, np.partition(low, n - k, axis=0)[n - k])
        possible = score >= need[None, :] - slack
        after = sum(len(m) for _, m, _ in block.levels[at + 1]) * len(ask) if at + 1 < len(block.levels) else 0
        if possible.sum() * ask.shape[1] <= after:  # the proof leaves so few that to rescore them costs less than to go on
            break
    for i, j in own:
        possible[i, j] = False
    return possible, work


def _best(block: Block, at: np.ndarray, one: np.ndarray, length: float, best: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    """The k best of what is known and the possible vectors, with exact scores; ties go to the smaller id."""
    if length * block.lengths[at].max(initial=0) < WHOLE / 2:
        exact = (block.whole[at] @ one).astype(np.int64)
        first = np.lexsort((block.ids[at], -exact))[:k]
    else:  # sums of floats could be off
        ints = [int(x) for x in one]
        exact = [sum(int(a) * b for a, b in zip(v, ints)) for v in block.whole[at]]
        first = range(len(at))
    new = [(int(exact[j]), int(block.ids[at[j]])) for j in first]
    return sorted([*best, *new], key=lambda x: (-x[0], x[1]))[:k]


def _search(k: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if index.num_rows and queries.num_rows:
            index = index.combine_chunks()
            asked, q = queries.column("id").to_numpy(), queries.column("q").to_pylist()
            width = max(int(index.column("dim").to_numpy().max(initial=0)) + 1, max(map(len, q)))
            ask = np.zeros((len(q), width))
            for i, v in enumerate(q):
                ask[i, : len(v)] = v
            numbers = index.column("block").to_numpy()
            blocks = [Block(index.take(pa.array(np.flatnonzero(numbers == b))), width) for b in np.unique(numbers)]
            for i in range(0, len(ask), PASS):
                best, _ = walk(blocks, asked[i : i + PASS], ask[i : i + PASS], k)
                found += [(int(a), v, s) for a, b in zip(asked[i : i + PASS], best) for s, v in b]
        ids, vectors, scores = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(vectors, pa.int64()), "score": pa.array(scores, pa.int64())})

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best vectors, its own id left out, ties to the smaller id.

    Queries are treated as vectors are by build_index(). Each share of the queries meets each tile once; only k rows
    for each query and tile leave a task.
    """
    asked, shares = _dealt(_rows(queries, id_col, vector_col), "share", 1)
    tiles = index.agg(F.coalesce(F.max("tile") + 1, F.lit(0)).alias("n")).first()["n"]
    left = index.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    right = asked.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(max(tiles, 1) - 1))))
    met = left.groupBy("tile", "share").cogroup(right.groupBy("tile", "share")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The query in DuckDB.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
