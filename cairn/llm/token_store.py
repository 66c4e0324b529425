"""Token ids in binary blocks whose document boundaries are Elias-Fano encoded.

A store is a Parquet table of self-contained blocks (so that any file system Spark reaches can hold it). A block is

    magic "EFT1", id width in bytes, documents n, ids m, then two Elias-Fano sequences and the ids:
    the n + 1 boundaries of documents in the id array, and the n document ids, less the smallest.

An Elias-Fano sequence of n ascending numbers below u keeps the low log2(u / n) bits of each in a packed array and
the high parts in a bit vector, in which number i sets bit (high + i): about 2 + log2(u / n) bits a number in all.
Every 64th set bit's position is stored, so select(i) counts the bits of a few words only.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.runtime import pieces, text_bytes

MAGIC = b"EFT1"
#: A block is closed when it holds this many ids.
BLOCK_IDS = 1 << 20
BUCKET_ROWS, MOST_BUCKETS = 500, 4096
CHUNK_BYTES = 1 << 20
_EVERY = 64


def elias_fano(values: np.ndarray) -> bytes:
    """Ascending numbers >= 0, encoded."""
    v = values.astype(np.uint64)
    n, top = len(v), int(v[-1]) + 1 if len(v) else 0
    low = max(0, (top // max(n, 1)).bit_length() - 1)
    bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    lows = np.packbits(bits.ravel(), bitorder="little").tobytes()
    ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    words = int(ones[-1]) // 64 + 1 if n else 0
    high = np.zeros(words * 64, np.uint8)
    high[ones] = 1
    samples = ones[::_EVERY].astype("<u4").tobytes()
    return struct.pack("<QBQ", n, low, words) + lows + np.packbits(high, bitorder="little").tobytes() + samples


class EliasFano:
    """Reads what elias_fano() wrote, from position ``at`` of a buffer; ``end`` is what follows it."""

    def __init__(self, buffer: bytes, at: int = 0):
        self.n, self.low, words = struct.unpack_from("<QBQ", buffer, at)
        at += 17
        size = (self.n * self.low + 7) // 8
        self._lows = np.frombuffer(buffer, np.uint8, size, at)
        self._high = np.frombuffer(buffer, "<u8", words, at + size)
        count = (self.n + _EVERY - 1) // _EVERY
        self._samples = np.frombuffer(buffer, "<u4", count, at + size + 8 * words)
        self.end = at + size + 8 * words + 4 * count

    def select(self, i: int) -> int:
        """Number i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self._samples[i // _EVERY])
        left, word = i % _EVERY, at // 64
        rest = int(self._high[word]) >> (at % 64) << (at % 64)
        while (have := rest.bit_count()) <= left:
            left -= have
            word += 1
            rest = int(self._high[word])
        for _ in range(left):
            rest &= rest - 1
        high = word * 64 + (rest & -rest).bit_length() - 1 - i
        first = i * self.low
        bits = int.from_bytes(self._lows[first // 8 : (first + self.low + 7) // 8].tobytes(), "little") >> (first % 8)
        return high << self.low | bits & ((1 << self.low) - 1)

    def all(self) -> np.ndarray:
        """All numbers, by one pass over the bit vector."""
        ones = np.flatnonzero(np.unpackbits(self._high.view(np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)) << self.low
        if self.low:
            bits = np.unpackbits(self._lows, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
            out = out + bits.astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))
        return out.astype(np.int64)


def write_block(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One block of documents in ascending order of their ids."""
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    first = int(doc_ids[0])
    head = MAGIC + struct.pack("<BQQq", width, len(doc_ids), len(ids), first)
    return head + elias_fano(np.concatenate([[0], np.cumsum(lengths)])) + elias_fano(doc_ids - first) + ids.astype(f"<u{width}").tobytes()


class Block:
    """Reads one block."""

    def __init__(self, buffer: bytes):
        if buffer[:4] != MAGIC:
            raise ValueError("not a token block")
        width, self.n_docs, self.n_ids, self.first = struct.unpack_from("<BQQq", buffer, 4)
        self.bounds = EliasFano(buffer, 29)
        self._docs = EliasFano(buffer, self.bounds.end)
        self.ids = np.frombuffer(buffer, f"<u{width}", self.n_ids, self._docs.end)

    def doc_ids(self) -> np.ndarray:
        return self._docs.all() + self.first

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


#: ASCII marks that may end a piece and never join with a letter before them. Apostrophes and what special strings
#: hold are not among them.
_MARKS = b".,!?;:*#$%&"
_MARK = rb"[" + re.escape(_MARKS) + rb"]"
#: Begins with the mark, as such patterns are searched for much faster than ones that look behind first.
_AFTER = re.compile(_MARK + rb"(?<=[A-Za-z0-9]" + _MARK + rb")" + _MARK + rb"*(?!\S)")
#: Words of the letters a-z and U+00DF-U+00FF, which no normalizer of case or composition changes.
_LATIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch


def words(text: bytes) -> list[bytes]:
    """The pieces of a text that can be encoded one by one: between ASCII white space, marks at an end apart.

    Letters of ASCII are lower-cased, as the tokenizer does, unless the text holds marks of U+0300-U+036F: it composes
    letters with those first, which case can change. A text that may hold a special string stays as it is.
    """
    if b"<" in text or b"|" in text:
        return text.split()
    if b"\xcc" not in text and b"\xcd" not in text:
        text = text.lower()
    return _AFTER.sub(rb" \g<0>", text).split()


def _folded(piece: bytes) -> bytes:
    return piece.lower() if piece.isascii() else piece


def _letters(c: str) -> bool:
    """Whether a character is letters only in the form that the tokenizer splits: composed, in lower case."""
    return unicodedata.normalize("NFC", c).lower().isalpha()


class _Pieces(dict):
    """Text between ASCII white space -> its ids as bytes. White space ends words and is dropped, so it stands alone.

    Pieces of ASCII that differ in the case of letters, and pieces that differ in marks after a letter, share what the
    library says of the letters: the tokenizer lower-cases, and splits letters from marks.
    """

    MOST, BYTES = 1_000_000, 64

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab()
        #: whether an id ends a word, where the file marks that
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.bare = self._bare()

    def _bare(self):
        """The model behind a splitter at white space alone, for _LATIN words; None if the file treats those in another way."""
        from tokenizers import Tokenizer, pre_tokenizers

        upper, lower = (bytes(r).decode("latin-1") for r in ([*range(65, 91), *range(192, 215), *range(216, 223)], [*range(97, 123), *range(223, 247), *range(248, 256)]))
        normal, split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if normal is None or split is None or not self.ends.any():
            return None
        if normal.normalize_str(f"{lower} {upper}") != f"{lower} {upper.lower()}":
            return None
        bare = Tokenizer(self.tokenizer.model)
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        if [w for w, _ in split.pre_tokenize_str(lower)] != [w for w, _ in to_bytes.pre_tokenize_str(lower)]:
            return None
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), to_bytes])
        return bare

    def encode(self, stems: list[bytes]) -> None:
        """Enters the ids of each. Stems of letters are one word each, so many are encoded as one text and cut at word ends."""
        latin, letters, alone = [], [], []
        for w in stems:
            if self.bare and (w.isalpha() and w.islower() or _LATIN(w)):
                latin.append(w)
            else:
                (letters if w.isalpha() or not w.isascii() and w.decode().isalpha() else alone).append(w)
        for tokenizer, plain in ((self.bare, latin), (self.tokenizer, letters)):
            groups = [plain[i : i + 512] for i in range(0, len(plain), 512)]
            for i in range(0, len(groups), 16):
                run = groups[i : i + 16]
                for group, e in zip(run, tokenizer.encode_batch_fast([b" ".join(g).decode() for g in run], add_special_tokens=False)):
                    ids = np.array(e.ids, "<u4")
                    cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
                    if len(cuts) == len(group) + 1 and cuts[-1] == 4 * len(ids):
                        raw = ids.tobytes()
                        self.update(zip(group, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
                    else:
                        alone += group
        for w, e in zip(alone, self.tokenizer.encode_batch_fast([w.decode() for w in alone], add_special_tokens=False)):
            self[w] = array("I", e.ids).tobytes()

    def parts(self, piece: bytes) -> tuple[bytes, bytes]:
        """What is encoded for a piece, in two parts."""
        if b"<" in piece or b"|" in piece:
            return piece, b""
        stem = piece.rstrip(_MARKS)
        if len(stem) < len(piece) and (stem[-1:].isalnum() or (stem[-1:] >= b"\x80" and _letters(stem.decode()[-1]))):
            return _folded(stem), piece[len(stem) :]
        return _folded(piece), b""

    def learn(self, texts: list[list[bytes]]) -> None:
        """Encodes what is not known yet of the texts' pieces in one call."""
        met = set().union(*texts)
        new = [w for w in filterfalse(self.__contains__, met) if len(w) <= self.BYTES]
        if len(self) + len(new) > self.MOST:
            self.clear()
            new = [w for w in met if len(w) <= self.BYTES]
        whole, rest = [], []
        for w in new:
            if w.isalpha() and w.islower() or _LATIN(w):
                whole.append(w)
            else:
                rest.append((w, *self.parts(w)))
        self.encode(whole)
        self.encode(list({p for _, *parts in rest for p in parts if p not in self}))
        self.update((w, self[stem] + self[marks]) for w, stem, marks in rest if stem != w)

    def __missing__(self, word: bytes) -> bytes:
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()


_OPEN: dict[str, _Pieces] = {}


def _encoded(path: str, end_id: int, bounds: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _OPEN:
            _OPEN[path] = _Pieces(path)
        known = _OPEN[path]
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in pieces(offsets, CHUNK_BYTES):
                docs = batch.column(0).slice(i, j - i)
                texts = [words(data[offsets[r] : offsets[r + 1]].tobytes()) for r in range(i, j)]
                known.learn(texts)
                ids = [np.frombuffer(b"".join(map(known.__getitem__, ws)) + end, "<u4") for ws in texts]
                width = [2 if x.max() < 1 << 16 else 4 for x in ids]
                ids = [x.astype(f"<u{w}").tobytes() for x, w in zip(ids, width)]
                bucket = np.searchsorted(np.array(bounds, np.int64), docs.to_numpy(), "right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), docs, pa.array(width, pa.int32()), pa.array(ids, pa.binary())], names=["bucket", "doc_id", "width", "ids"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by bucket and doc_id -> (bucket, seq, first_doc, n_docs, n_ids, block)."""
    bucket, seq, docs, ids, held = None, 0, [], [], 0

    def close() -> pa.RecordBatch:
        lengths = np.array([len(x) for x in ids])
        block = write_block(np.array(docs, np.int64), lengths, np.concatenate(ids))
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([seq], pa.int32()), pa.array([docs[0]], pa.int64()), pa.array([len(docs)], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), pa.array([block], pa.binary())], names=["bucket", "seq", "first_doc", "n_docs", "n_ids", "block"])

    for batch in batches:
        for b, d, w, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            if docs and (b != bucket or held >= BLOCK_IDS):
                yield close()
                seq = seq + 1 if b == bucket else 0
                docs, ids, held = [], [], 0
            bucket = b
            docs.append(d)
            ids.append(np.frombuffer(raw.as_buffer(), f"<u{w}"))
            held += len(ids[-1])
    if docs:
        yield close()


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The ids of all texts, each followed by ``end_id``, in ascending order of doc_id, as a store at ``path``.

    Rows fall into buckets by doc_id, so that blocks ordered by (bucket, seq) are in the order of doc_id. Null and empty
    texts have the end id alone. Rows without an id are left out, as no boundary could name them; rows that repeat
    an id follow each other.
    """
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id IS NOT NULL")
    n = max(1, min(MOST_BUCKETS, table.count() // BUCKET_ROWS))
    cuts = table.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
    encoded = table.mapInArrow(_encoded(tokenizer, end_id, sorted(set(cuts or []))), "bucket int, doc_id long, width int, ids binary")
    ordered = encoded.repartition("bucket").sortWithinPartitions("bucket", "doc_id")
    ordered.mapInArrow(_blocks, "bucket int, seq int, first_doc long, n_docs long, n_ids long, block binary").write.mode("overwrite").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bucket, seq, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            block = Block(raw.as_buffer().to_pybytes())
            bounds = block.bounds.all()
            whole = memoryview(block.ids.astype("<u4").tobytes())
            crc = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            n = block.n_docs
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, bucket, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(block.doc_ids()), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], names=["bucket", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a store, read back from its blocks."""
    store = spark.read.parquet(path)
    heads = store.select("bucket", "seq", "n_ids")
    before = lambda *by: (Window.partitionBy(*by) if by else Window).rowsBetween(Window.unboundedPreceding, -1)
    buckets = heads.groupBy("bucket").agg(F.sum("n_ids").alias("n"))  # MOST_BUCKETS rows at most
    base = buckets.select("bucket", F.coalesce(F.sum("n").over(before().orderBy("bucket")), F.lit(0)).alias("base"))
    inner = heads.select("bucket", "seq", F.coalesce(F.sum("n_ids").over(before("bucket").orderBy("seq")), F.lit(0)).alias("inner"))
    starts = inner.join(base, "bucket").select("bucket", "seq", (F.col("inner") + F.col("base")).alias("first"))
    docs = store.select("bucket", "seq", "block").mapInArrow(_documents, "bucket int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["bucket", "seq"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every document of a store."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                block = Block(raw.as_buffer().to_pybytes())
                lists = pa.ListArray.from_arrays(pa.array(block.bounds.all().astype(np.int32)), pa.array(block.ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids()), lists], names=["doc_id", "ids"])

    return spark.read.parquet(path).select("block").mapInArrow(run, "doc_id long, ids array<int>")
