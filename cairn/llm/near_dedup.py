"""Near-duplicate classes: MinHash bands find candidates, odd sketches verify them, full sets decide.

Each document is the set of its distinct word shingles. Copies with equal sets collapse to one node before
anything is paired. A node has ``bands * rows`` MinHash samples; nodes that agree on a whole band meet in a
bucket. The same samples are folded into a parity bitmap (an odd sketch): each sample flips one bit, so that
the XOR of two bitmaps keeps a bit only for samples in which the documents differ, and its population count
estimates how many those are. A pair whose estimate lies ``sigmas`` standard deviations beyond the threshold
is dropped; what remains is confirmed by intersecting the full sets.

A second bitmap folds the whole set instead of samples of it. The population count of two of these never exceeds
the number of shingles in which the sets differ, so a count beyond what the threshold allows is a proof.

A bucket is never expanded into all of its pairs: its members are first compared with two representatives, the
links found are contracted to components, and only members of buckets that still hold several components are
compared with each other, by their sketches, in blocks of bounded size. Of the candidates found there, each member's
nearest are confirmed and contracted first, so that a large family becomes one component before the rest is asked for.

Hot buckets are found by a coarse count of all keys and then an exact one of the few that can be large; what their
members need of them is broadcast, so no bucket, hub or group of copies has to pass through one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.hashing import mix, shingle_sets
from cairn.llm.native import bounded
from cairn.llm.runtime import cut, pieces, salted_join, text_bytes, trim

BANDS, ROWS = 32, 5
SKETCH_WORDS = 8
PARITY_WORDS = 64
CHUNK_BYTES = 1 << 20
#: Members of a bucket that are compared in one block, and the candidates of each that are confirmed first.
BLOCK, NEAREST = 512, 8
#: A bucket beyond this size doesn't go through a task of its own; and the cells of the coarse count that finds them.
HOT, CELLS = 512, 1 << 14


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(97)
    a = rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a, rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(1, 1 << 63, n, dtype=np.uint64)


def minhash(sets: np.ndarray, sizes: np.ndarray, samples: int) -> np.ndarray:
    """(rows, samples) MinHash values of sets that lie one after another; no set may be empty."""
    a, b, _ = _seeds(samples)
    halves = (sets >> np.uint64(32)).astype(np.uint32), sets.astype(np.uint32)
    starts = np.cumsum(sizes) - sizes
    out = np.empty((samples, len(sizes)), np.uint32)
    for j in range(samples):
        out[j] = np.minimum.reduceat(halves[j % 2] * a[j] + b[j], starts)
    return out.T


def odd_sketch(signatures: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """(rows, words) parity bitmaps of 64 * words bits: sample j with value v flips the bit that hashes (j, v)."""
    n, samples = signatures.shape
    bits = 64 * words
    _, _, salt = _seeds(samples)
    at = (mix(signatures.astype(np.uint64) + salt) % np.uint64(bits)).astype(np.int64)
    flips = np.bincount((np.arange(n)[:, None] * bits + at).ravel(), minlength=n * bits).reshape(n, bits) & 1
    return np.packbits(flips.astype(np.uint8), axis=1, bitorder="little").view(np.uint64).reshape(n, words)


def parity(sets: np.ndarray, sizes: np.ndarray, words: int = PARITY_WORDS) -> np.ndarray:
    """(rows, words) parity bitmaps to which each shingle of a row's set contributes one bit."""
    bits, n = 64 * words, len(sizes)
    out = np.empty((n, words), np.uint64)
    at, ends = (sets % np.uint64(bits)).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])
    for i in range(0, n, 256):
        j = min(n, i + 256)
        row = np.repeat(np.arange(j - i) * bits, sizes[i:j])
        flips = np.bincount(row + at[ends[i] : ends[j]], minlength=(j - i) * bits).reshape(j - i, bits) & 1
        out[i:j] = np.packbits(flips.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
    return out


def most_differing_bits(samples: int, similarity: float, words: int = SKETCH_WORDS, sigmas: float = 4.0) -> int:
    """The XOR population count that a pair at the threshold stays within: ``sigmas`` deviations for the samples
    that differ, and half as many again for bits that cancel out, which together are missed once in about 10**9.

    With d differing samples, 2d bits are flipped among n, of which n/2 (1 - exp(-4d/n)) are expected to be set.
    """
    n, miss = 64 * words, samples * (1 - similarity)
    d = miss + sigmas * np.sqrt(miss * similarity)
    expected = n / 2 * (1 - np.exp(-4 * d / n))
    return int(np.ceil(expected + sigmas / 2 * np.sqrt(expected)))


def _signatures(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, salt = _seeds(bands * rows)
        for batch in batches:
            ids, texts, (data, offsets) = batch.column(0), batch.column(2), text_bytes(batch.column(1))
            for i, j in pieces(offsets, CHUNK_BYTES):
                sets, sizes = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                full = np.flatnonzero(sizes)
                size = sizes[full]
                if len(full):
                    sig = minhash(sets, size, bands * rows)
                    parts = sig.reshape(len(full), bands, rows).astype(np.uint64) * salt.reshape(bands, rows)
                    keys = mix(parts.sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
                    sketch, starts = odd_sketch(sig), np.cumsum(size) - size
                    one, two = np.add.reduceat(mix(sets + np.uint64(1)), starts), np.add.reduceat(mix(sets ^ np.uint64(0xA5A5A5A5)), starts)
                if len(empty := np.flatnonzero(sizes == 0)):
                    at = pa.array(empty)
                    yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).take(at), texts.slice(i, j - i).take(at), pa.array(np.zeros(len(empty), np.int64)), *(pa.nulls(len(empty), t) for t in (pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3))], names=_SIGNED)
                whole = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel().view(np.int64)))
                if len(full):
                    at = pa.array(full)
                    yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).take(at), texts.slice(i, j - i).take(at), pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), whole(np.ascontiguousarray(keys)), whole(sketch), whole(parity(sets, size))], names=_SIGNED)
        trim()

    return run


_SIGNED = ["doc_id", "text_key", "n_shingles", "set_one", "set_two", "keys", "sketch", "parity"]


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (data, offsets) = batch.column(0), text_bytes(batch.column(1))
            for i, j in pieces(offsets, CHUNK_BYTES):
                sets, sizes = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), lists], names=["node", "shingles"])
        trim()

    return run


def _close(limit: int, percent: int, most: int | None):
    """Of one block: pairs of different components whose sizes and sketches allow the threshold.

    Of a node's partners, ordered by how little they differ, the first ``most`` are returned. A row without a pair says
    that partners in other components are left.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("node")
        node, size, comp, side = (table.column(c).to_numpy() for c in ("node", "n_shingles", "component", "side"))
        bits, whole = (np.array(table.column(c).combine_chunks().flatten(), dtype=np.int64).view(np.uint64).reshape(len(node), -1) for c in ("sketch", "parity"))
        one_sided = bool(len(side)) and side.min() == side.max()
        out, rest = [], False
        left = np.arange(len(node)) if one_sided else np.flatnonzero(side == side.min())
        right = left if one_sided else np.flatnonzero(side != side.min())
        for i in left:
            r = right[right > i] if one_sided else right
            r = r[comp[r] != comp[i]]
            r = r[100 * np.minimum(size[r], size[i]) >= percent * np.maximum(size[r], size[i])]
            r = r[np.bitwise_count(bits[r] ^ bits[i]).sum(axis=1) <= limit]
            apart = np.bitwise_count(whole[r] ^ whole[i]).sum(axis=1, dtype=np.int64)
            # sets of sizes x and y at the threshold differ in (x + y)(100 - percent) / (100 + percent) shingles
            may = (100 + percent) * apart <= (100 - percent) * (size[r] + size[i])
            r = r[may][np.argsort(apart[may], kind="stable")]
            rest = rest or len(r) > len(r[:most])
            if len(r := r[:most]):
                out.append(np.stack([np.minimum(node[r], node[i]), np.maximum(node[r], node[i])]))
        got = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        more, none = [table.column("key")[0].as_py()] * rest, [None] * rest
        a, b = (pa.array([*side, *none], pa.int64()) for side in got.tolist())
        return pa.table({"a": a, "b": b, "key": pa.array([None] * got.shape[1] + more, pa.int64())})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node that each can reach.

    Labels pass along the edges and then along themselves (pointer jumping) until none changes; each round is
    cut from its lineage. Nothing but a count reaches the driver.
    """
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    itself = edges.select(F.explode(F.array("a", "b")).alias("a")).select("a", F.col("a").alias("b"))
    both = cut(edges.select("a", "b").union(turned).union(itself).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")))
    while True:
        of = labels.select(F.col("node").alias("b"), "component")
        own = F.max(F.when(F.col("a") == F.col("b"), F.col("component"))).alias("was")
        step = salted_join(both, of, ["b"], F.col("a")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("mid"), own)
        jump = salted_join(step, labels.select(F.col("node").alias("mid"), F.col("component").alias("up")), ["mid"], F.col("node"), "left")
        done = cut(jump.select("node", "was", F.least("mid", F.coalesce("up", "mid")).alias("component")))
        labels = done.select("node", "component")
        if done.filter(F.col("was") != F.col("component")).isEmpty():
            return labels


def _confirmed(pairs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of nodes: those with 100 * intersection >= percent * union of their full sets.

    A node with many partners is a hot key of this join; its set is dealt out over as many salts as its
    partners need.
    """
    hub = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 64).cast("int").alias("deal"))
    wanted = cut(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
    sets = cut(nodes.join(bounded(wanted), "node", "left_semi").mapInArrow(_sets(k), "node long, shingles array<long>"))
    left = hub.join(sets, hub.a == sets.node).select("a", "deal", F.col("shingles").alias("sa"), F.explode(F.sequence(F.lit(0), F.col("deal") - 1)).alias("part"))
    dealt = salted_join(pairs, hub, ["a"], F.col("b"), "inner").withColumn("part", F.pmod(F.xxhash64("b"), F.col("deal")).cast("int")).drop("deal")
    right = dealt.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    met = right.join(left.drop("deal"), ["a", "part"])
    both = F.size(F.array_intersect("sa", "sb"))
    return met.select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("all")).filter(100 * F.col("both") >= percent * (F.col("all") - F.col("both"))).select("a", "b")


def _buckets(nodes: DataFrame) -> DataFrame:
    """(node, key, n, low, high): each node's bands that other nodes share, with the size and the ends of the bucket."""
    rows = nodes.select("node", F.explode("keys").alias("key"))
    cells = max(CELLS, min(8 * CELLS, nodes.count() >> 7))
    cell = F.pmod("key", F.lit(cells))
    counts = cut(rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")))  # at most 8 * CELLS rows
    mean = counts.agg(F.coalesce(F.avg("n"), F.lit(0.0))).first()[0]
    crowded = counts.filter(F.col("n") > 2 * mean + HOT).select("cell")
    cold, parts = rows, []
    if not crowded.isEmpty():
        large = rows.withColumn("cell", cell).join(F.broadcast(crowded), "cell").groupBy("key")
        large = cut(large.agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).filter(F.col("n") > HOT))
        small = bounded(large)
        parts = [rows.join(small, "key").select("node", "key", "n", "low", "high")]
        cold = rows.join(small, "key", "left_anti")
    bucket = Window.partitionBy("key")
    sized = cold.select("node", "key", F.count(F.lit(1)).over(bucket).alias("n"), F.min("node").over(bucket).alias("low"), F.max("node").over(bucket).alias("high"))
    return reduce(DataFrame.union, parts, sized.filter("n > 1"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key, class_id) for every document with an id.

    Documents are linked when 100 * |intersection| >= percent * |union| of their k-word shingle sets; the
    component's smallest id is the document that is kept. With the defaults a pair at the threshold shares no
    band with a probability of about 3e-6 at 0.80 and 7e-9 at 0.85.

    Null, empty and white-space texts have no shingles, stay alone and are kept. Rows without an id take no part
    and are not returned. Rows that repeat an id with the same text are answered alike; where an id names several
    texts, each of its rows is answered for its own text, which text_key (the text's xxhash64; null: of the empty
    one) tells apart. class_id tells components apart, also those whose smallest ids are equal; it is null without
    shingles. Only the two named columns are read, so other columns may have any names.
    """
    text = F.col(text_col).cast("string")
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), text_key(text).alias("text_key")).filter("doc_id IS NOT NULL")
    signed = cut(table.mapInArrow(_signatures(k, bands, rows), "doc_id long, text_key long, n_shingles long, set_one long, set_two long, keys array<long>, sketch array<long>, parity array<long>"))
    signed, texts, repeated, mixed = _named(signed, table)
    full = signed.filter("n_shingles > 0")
    copies = full.groupBy("set_one", "set_two").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    repeats = cut(salted_join(full.select("node", "set_one", "set_two"), copies, ["set_one", "set_two"], F.col("node")).select("node", "first").distinct())
    # not stored again: what is read of it comes from the stored signatures
    nodes = full.join(bounded(cut(repeats.filter("node <> first").select("node"))), "node", "left_anti").select("node", "n_shingles", "sketch", "parity", "keys")
    nodes = cut(nodes.dropDuplicates(["node"])) if repeated else nodes

    met = cut(_buckets(nodes))
    ends = F.array(F.struct(F.col("low").alias("a"), F.col("node").alias("b")), F.struct(F.col("high").alias("a"), F.col("node").alias("b")))
    stars = cut(met.select(F.explode(ends).alias("p")).select("p.*").filter("a <> b").distinct())
    limit = most_differing_bits(bands * rows, percent / 100)
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    centres = side("a").join(stars.select("a").distinct(), "a", "left_semi")
    stars = salted_join(stars, centres, ["a"], F.col("b")).join(side("b"), "b").filter(apart <= limit)
    stars = cut(stars.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b"))
    links = cut(_confirmed(stars, texts, k, percent))
    labels = components(links)

    tried, keys = cut(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), None
    for most in (NEAREST, None):
        near = _candidates(met, nodes, labels, keys, _close(limit, percent, most))
        if near is None:
            break
        more = cut(near.filter("a IS NOT NULL").select("a", "b").distinct().join(bounded(tried), ["a", "b"], "left_anti"))
        found = cut(_confirmed(more, texts, k, percent))
        if not found.isEmpty():
            links = cut(links.union(found))
            labels = components(links)
        tried, keys = cut(tried.union(more)), cut(near.filter("a IS NULL").select("key").distinct())

    named = signed.select("doc_id", "text_key", "n_shingles", "node").join(repeats, "node", "left").withColumn("node", F.coalesce("first", "node")).drop("first")
    # a component's root may be the node of very many copies
    named = salted_join(named, labels, ["node"], F.col("text_key") + F.col("doc_id"), "left").withColumn("component", F.coalesce("component", "node")).withColumn("class_id", F.col("component"))
    if mixed:  # the roots are not all ids
        named = cut(named)
        least = named.filter("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"))
        named = salted_join(named, least, ["component"], F.col("text_key") + F.col("doc_id"), "left").withColumn("component", F.col("least"))
    root = F.coalesce("component", "doc_id")
    return named.select("doc_id", "n_shingles", root.alias("component_id"), (F.col("doc_id") == root).alias("kept"), "text_key", "class_id")


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _named(signed: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame, bool, bool]:
    """(signed with each text's node, (node, text), whether ids repeat, whether some id names several sets).

    A text's node is its doc_id, or, where an id names several sets, a hash of the id and the set; texts without
    shingles have none.
    """
    repeated = not signed.groupBy("doc_id").count().filter("count > 1").isEmpty()
    mixed = None
    if repeated:
        several = (F.min("set_one") != F.max("set_one")) | (F.min("set_two") != F.max("set_two"))
        mixed = cut(signed.groupBy("doc_id").agg(several.alias("several")).filter("several").select("doc_id"))
    if mixed is None or mixed.isEmpty():
        node = F.when(F.col("n_shingles") > 0, F.col("doc_id"))
        return signed.withColumn("node", node), table.select(F.col("doc_id").alias("node"), "text") if not repeated else table.select(F.col("doc_id").alias("node"), "text").dropDuplicates(["node"]), repeated, False
    few = bounded(mixed.withColumn("mixed", F.lit(True)))
    own = F.xxhash64("doc_id", "set_one", "set_two")
    signed = cut(signed.join(few, "doc_id", "left").withColumn("node", F.when(F.col("n_shingles") > 0, F.when(F.col("mixed"), own).otherwise(F.col("doc_id")))).drop("mixed"))
    of = cut(signed.join(few, "doc_id", "left_semi").filter("node IS NOT NULL").select("doc_id", "text_key", F.col("node").alias("own")).distinct())
    texts = table.join(bounded(of), ["doc_id", "text_key"], "left").select(F.coalesce("own", "doc_id").alias("node"), "text").dropDuplicates(["node"])
    return signed, texts, True, True


def _candidates(met: DataFrame, nodes: DataFrame, labels: DataFrame, keys: DataFrame | None, close) -> DataFrame | None:
    """What close() returns of the buckets, of those given or of all, that hold several components; None if there are none.

    Members of a bucket's largest component need no comparison with each other: their blocks meet those of all other
    members only, and these each other's.
    """
    if keys is not None and keys.isEmpty():
        return None
    now = met if keys is None else met.join(bounded(keys), "key", "left_semi")
    now = now.select("key", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = now.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
    split = sizes.agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("m"), F.sum("n").alias("n")).filter("m < n")
    split = cut(split.select("key", "main", F.ceil(F.col("m") / BLOCK).cast("int").alias("bm"), F.ceil((F.col("n") - F.col("m")) / BLOCK).cast("int").alias("bo")))
    if split.isEmpty():
        return None
    few = bounded(split)
    rest = now.join(few, "key") if few is not split else salted_join(now, split, ["key"], F.col("node"))
    rest = rest.join(nodes.drop("keys"), "node").withColumn("h", F.xxhash64("node")).withColumn("in", F.col("component") == F.col("main"))
    rest = rest.withColumn("own", F.when(F.col("in"), F.pmod("h", "bm")).otherwise(F.col("bm") + F.pmod("h", "bo")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.when(F.col("in"), F.col("bm")).otherwise(0), F.col("bm") + F.col("bo") - 1)))
    rest = rest.select("key", "node", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"), "n_shingles", "sketch", "parity")
    return cut(rest.groupBy("key", "i", "j").applyInArrow(close, "a long, b long, key long"))


#: near_duplicates() with k=3 and percent=85 in DuckDB.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' ')))) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
