"""BPE encoding and decoding by a deterministic automaton.

The token automaton starts with one state that every base symbol leads back to; its paths are all symbol sequences.
The merges are compiled in their order. The gadget of merge k, (l, r) -> t, takes arc r away from state l and adds
arc t wherever arc l led from, into a copy of the state after r. In the end each text has one path, and its labels
are the BPE tokens. A state is the token that was read last, so a gadget is kept as the date of its merge: arc (p, x) is
lost at the first merge that joins the last part of p, as it was then, to the first part of x, as it was
then; a copy has lost what its original had lost at its birth.

That automaton reads tokens. To read bytes it is made deterministic by the subset construction: a state of the
byte automaton holds the arc by which the bytes so far were read to their end (a text has one path, so has each of its
beginnings), and all arcs that have been read in part, each with the state it leaves from. Its transition table is
filled when a transition is first met, and then drives all words: one look-up a byte, for many words at a time. The
arcs that end at a word's last position, where that one starts, and so on backwards, are the word's tokens.
"""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.runtime import pieces, text_bytes, trim

#: Distinct pieces of text, words, transitions and dates of arcs that a worker remembers (about 350 MB), and the longest text among them in bytes.
CACHE, WORDS, TRANSITIONS, DATES, CACHED_BYTES = 700_000, 500_000, 1_000_000, 100_000, 64
#: Transitions for each piece that a caller lets a worker remember.
_PER_PIECE = 8
CHUNK_BYTES = 1 << 19
#: Positions times words that are read at a time.
CELLS = 1 << 19
_NEVER = 1 << 60
_START = -1
#: A word's end is a symbol of its own.
_END = 256
#: Stands between pieces that are split together; a piece with it in it is split alone.
_BETWEEN = "\uf8ff"


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


#: Marks that may follow the letters of a piece, and are then one word. What special strings and contractions hold is not among them.
_MARKS = b".,!?;:*#$%&"


class Automaton:
    """Encoder and decoder for a byte-level tokenizer file with word ends."""

    def __init__(self, path: str, most: int = CACHE):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix")
        if not suffix or any(t["content"].split() != [t["content"]] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("a file with word ends, and special strings that stand as they are and hold no white space, is needed")
        vocab: dict[str, int] = model["vocab"]
        self.labels: dict[int, str] = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        patterns = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self._words = regex.compile(patterns[0])
        marks = _MARKS.decode()
        #: Whether letters and marks after them are two words; without special strings nor contractions, that needs no pattern.
        self._simple = self._words.findall("abc" + marks) == ["abc", marks] and not any(set(t) & set(marks) for t in self.special)
        #: What the file says of letters beyond ASCII depends on Unicode tables, so its own are asked.
        library = Tokenizer.from_file(path)
        self._normalizer, self._splitter = library.normalizer, library.pre_tokenizer
        self._byte = {s: b for b, s in enumerate(byte_symbols())}
        self._bytes = {ord(s): b for s, b in self._byte.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: born[t]: date of the merge that made t, -1 for base symbols; parts[t]: what it joined; dates[(l, r)].
        self.born: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.dates: dict[tuple[int, int], int] = {}
        made: dict[str, int] = {}
        for s in self._byte:
            for t in (s, s + suffix):
                if t in vocab:
                    made[t] = vocab[t]
                    self.born[vocab[t]] = -1
        for k, (left, right) in enumerate(merges):
            self._gadget(k, vocab[left], vocab[right], vocab[left + right])
            made[left + right] = vocab[left + right]
        #: A tree of all tokens' symbols: (node << 9 | symbol) -> node, the token that ends at a node, whether it has children.
        self._tree: dict[int, int] = {}
        self._token, self._inner = [-1], [False]
        #: Symbols of each token.
        self.length = np.zeros(max(self.labels) + 1, np.int32)
        for t, i in made.items():
            ends = t.endswith(suffix)
            symbols = [self._byte[c] for c in (t.removesuffix(suffix) if ends else t)] + [_END] * ends
            self.length[i] = len(symbols)
            self._grow(symbols, i)
        #: Pieces, and words, that are remembered at most.
        self.most = most
        self._word: dict[bytes, bytes] = {}
        self._lost: dict[int, int] = {}
        self._clear()
        self._piece: dict[bytes, bytes] = _Pieces(self)
        self.dtype = np.dtype("<u2" if max(self.labels) < 1 << 16 else "<u4")
        self._digits = {i: str(i).encode() for i in self.labels}

    def _gadget(self, k: int, left: int, right: int, product: int) -> None:
        self.dates.setdefault((left, right), k)
        if product not in self.born:
            self.born[product] = k
            self.parts[product] = (left, right)

    def _grow(self, symbols: list[int], token: int) -> None:
        node = 0
        for x in symbols:
            at = node << 9 | x
            if at not in self._tree:
                self._tree[at] = len(self._token)
                self._token.append(-1)
                self._inner.append(False)
                self._inner[node] = True
            node = self._tree[at]
        self._token[node] = token

    def lost(self, state: int, label: int) -> int:
        """The date at which the arc (state, label) was taken away, or _NEVER."""
        known = self._lost.get(state << 32 | label)
        if known is not None:
            return known
        s, x = self.born[state], self.born[label]
        date = _NEVER
        if s > x:  # before its birth the state was that of its last part
            was = self.lost(self.parts[state][1], label)
            date = was if was < s else _NEVER
        elif x >= 0:  # before its birth the label was read as its first part; of one date, the left pair merges first
            was = self.lost(state, self.parts[label][0])
            date = was if was <= x else _NEVER
        if date == _NEVER:
            date = self.dates.get((state, label), _NEVER)
        if len(self._lost) >= DATES:
            self._lost.clear()
        self._lost[state << 32 | label] = date
        return date

    def _clear(self) -> None:
        """Back to the first state alone."""
        room = min(TRANSITIONS, self.most * _PER_PIECE)
        self.table = _Table(room)
        #: For each state the arc read to its end, and the arcs read in part: left from << 32 | node.
        self.read_arc = np.full(room + 2, _START, np.int32)
        self._partial: list[tuple[int, ...]] = [()]
        self._state: dict[tuple, int] = {(_START, ()): 0}

    def _transition(self, key: int) -> int:
        """Computes where a state goes with a symbol, and enters it into the table; key is state << 9 | symbol."""
        state, symbol = key >> 9, key & 511
        whole, partial = None, []
        for arc in (*self._partial[state], int(self.read_arc[state]) << 32):
            left, node = arc >> 32, self._tree.get((arc & 0xFFFFFFFF) << 9 | symbol)
            if node is None:
                continue
            label = self._token[node]
            if label >= 0 and (left == _START or self.lost(left, label) == _NEVER):
                whole = label
            if self._inner[node]:
                partial.append(left << 32 | node)
        if whole is None:
            raise ValueError(f"no token reads symbol {symbol}")
        name = (whole, tuple(partial))
        to = self._state.get(name)
        if to is None:
            to = self._state[name] = len(self._partial)
            self.read_arc[to] = whole
            self._partial.append(name[1])
        self.table.enter(key, to)
        return to

    def read(self, words: list[bytes]) -> list[bytes]:
        """The tokens of each word, as bytes of ids. All words move on by a symbol at a time."""
        out: list[bytes] = [b""] * len(words)
        order = sorted((i for i, w in enumerate(words) if w), key=lambda i: -len(words[i]))
        while order:  # longest first, in runs whose matrices stay small
            take = max(1, min(len(order), CELLS // (len(words[order[0]]) + 1)))
            for i, ids in zip(order[:take], self._read([words[i] for i in order[:take]])):
                out[i] = ids
            order = order[take:]
        return out

    def _read(self, words: list[bytes]) -> list[bytes]:
        sizes = np.array(list(map(len, words)))
        row = np.repeat(np.arange(len(words)), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        symbols = np.full((sizes[0] + 1, len(words)), _END, np.uint16)
        symbols[at, row] = np.frombuffer(b"".join(words), np.uint8)
        if self.table.room <= 0:
            self._clear()
        arcs, state = np.empty(symbols.shape, np.int32), np.zeros(len(words), np.int64)
        still = np.searchsorted(-sizes, -np.arange(sizes[0] + 1), "right")  # words that have a symbol at a position
        i = 0
        while i < len(symbols):
            n = still[i]
            keys = state[:n] << 9 | symbols[i, :n]
            to = self.table.find(keys)
            if len(new := np.unique(keys[to < 0])):
                if len(new) > self.table.room:
                    return self._halves(words)
                for key in new.tolist():
                    self._transition(key)
                to = self.table.find(keys)
            state[:n] = to
            arcs[i, :n] = self.read_arc[to]
            i += 1
        return self._backwards(arcs, sizes)

    def _halves(self, words: list[bytes]) -> list[bytes]:
        """Words for which the table has no room left, from a table that is empty again."""
        self._clear()
        if len(words) == 1:
            return [self._alone(words[0])]
        half = len(words) // 2
        return self._read(words[:half]) + self._read(words[half:])

    def _alone(self, word: bytes) -> bytes:
        """One word that meets more transitions than the table holds: it is read with none of them kept."""
        now, path = (_START, ()), []
        for symbol in (*word, _END):
            self._partial[0], self.read_arc[0] = now[1], now[0]
            self._state.clear()
            self.table = _Table(1)
            self._transition(symbol)
            now = (int(self.read_arc[len(self._partial) - 1]), self._partial.pop())
            path.append(now[0])
        self._clear()
        return self._backwards(np.array(path, np.int32)[:, None], np.array([len(word)]))[0]

    def _backwards(self, arcs: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Each word's tokens, from arcs[position, word] and the words' lengths."""
        at, left, found = sizes.copy(), np.arange(len(sizes)), []
        while len(left):
            token = arcs[at[left], left]
            found.append((left, token))
            at[left] -= self.length[token]
            left = left[at[left] >= 0]
        count = np.bincount(np.concatenate([w for w, _ in found]), minlength=len(sizes))
        ends = np.cumsum(count)
        flat = np.empty(int(ends[-1]), self.dtype)
        for j, (word, token) in enumerate(found):
            flat[ends[word] - 1 - j] = token
        raw, width = flat.tobytes(), self.dtype.itemsize
        ends = (ends * width).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _split(self, texts: list[str]) -> list[list[bytes]]:
        """The words of texts without special strings, and without white space of ASCII."""
        plain = [i for i, t in enumerate(texts) if t.isascii()]
        other = [i for i, t in enumerate(texts) if not t.isascii() and _BETWEEN not in t]
        out: list[list[bytes]] = [[]] * len(texts)
        if plain:
            self._deal(out, plain, self._ascii(f" {_BETWEEN} ".join([texts[i] for i in plain])))
        if other:
            self._deal(out, other, self._library(f" {_BETWEEN} ".join([texts[i] for i in other])))
        for i in set(range(len(texts))).difference(plain, other):
            out[i] = self._library(texts[i])
        return out

    def _ascii(self, text: str) -> list[bytes]:
        return [w.encode() for w in self._words.findall(text.lower())]

    def _library(self, text: str) -> list[bytes]:
        words = [w for w, _ in self._splitter.pre_tokenize_str(self._normalizer.normalize_str(text))]
        return "\n".join(words).translate(self._bytes).encode("latin-1").split(b"\n") if words else []

    @staticmethod
    def _deal(out: list[list[bytes]], places: list[int], words: list[bytes]) -> None:
        """Words between separators -> the lists at the places."""
        mark, at = _BETWEEN.encode(), 0
        for i in places[:-1]:
            end = words.index(mark, at)
            out[i] = words[at:end]
            at = end + 1
        out[places[-1]] = words[at:]

    def _known(self, words: set[bytes]) -> dict[bytes, bytes]:
        """A dictionary that has the ids of the words."""
        new = [w for w in words if w not in self._word]
        if len(self._word) + len(new) > min(WORDS, self.most):
            self._word = {}
            new = list(words)
        self._word.update(zip(new, self.read(new)))
        return self._word

    def _plain(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without special strings."""
        split = self._split(texts)
        known = self._known({w for words in split for w in words})
        out = [b"".join([known[w] for w in words]) for words in split]
        for w in [w for words in split for w in words if len(w) > CACHED_BYTES]:
            known.pop(w, None)
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text without white space of ASCII in it, special strings included."""
        parts, at, special = [], 0, []
        for m in self._special.finditer(text):
            parts.append(text[at : m.start()])
            special.append(np.array([self.special[m[0]]], self.dtype).tobytes())
            at = m.end()
        ids = self._plain([*parts, text[at:]])
        return b"".join(a + b for a, b in zip(ids, [*special, b""]))

    def learn(self, pieces: list[bytes]) -> None:
        """Encodes the pieces that are not known yet, all at once."""
        known = self._piece
        new = [p for p in set(pieces) if p not in known and len(p) <= CACHED_BYTES]
        if len(known) + len(new) > self.most:
            known.clear()
            new = [p for p in set(pieces) if len(p) <= CACHED_BYTES]
        if self._simple:
            stems = [p.rstrip(_MARKS) for p in new]
            simple = [(p, t.lower(), p[len(t) :]) for p, t in zip(new, stems) if t.isalpha()]
            new = [p for p, t in zip(new, stems) if not t.isalpha()]
            word = self._known({t for _, t, _ in simple} | {m for _, _, m in simple})
            known.update((p, word[t] + word[m]) for p, t, m in simple)
        texts = [p.decode() for p in new]
        plain = [i for i, t in enumerate(texts) if not self._special.search(t)]
        known.update(zip([new[i] for i in plain], self._plain([texts[i] for i in plain])))

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of whole texts in UTF-8. ASCII white space ends words, so pieces between it stand alone."""
        split = [t.split() for t in texts]
        self.learn([p for ps in split for p in ps])
        return [np.frombuffer(b"".join(map(self._piece.__getitem__, ps)), self.dtype) for ps in split]

    def encode_bytes(self, text: bytes) -> np.ndarray:
        """The ids of one whole text in UTF-8."""
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """The labels of the arcs taken; as the file names no decoder, a space stands between them."""
        return " ".join(map(self.labels.__getitem__, ids))


class _Table:
    """int -> int, open addressing over arrays, so that many keys are looked up at once."""

    def __init__(self, most: int):
        self.room, self.bits = most, max(4, (2 * most).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)

    def _slot(self, keys):
        return (keys * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - self.bits)

    def enter(self, key: int, value: int) -> None:
        slot, mask = self._slot(key), (1 << self.bits) - 1
        while self.keys[slot] >= 0:
            slot = slot + 1 & mask
        self.keys[slot], self.values[slot] = key, value
        self.room -= 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        mask = (1 << self.bits) - 1
        slot = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slot[left] = slot[left] + 1 & mask
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


class _Pieces(dict):
    """piece -> its ids as bytes; one that learn() left out is encoded when it is met."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, piece: bytes) -> bytes:
        return self.automaton.encode(piece.decode())


_OPEN: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """The automaton of a file, compiled once in each worker."""
    if path not in _OPEN:
        _OPEN[path] = Automaton(path)
        trim()
    return _OPEN[path]


def _each(path: str, make, names: list[str], remember: int = CACHE):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path) if remember >= CACHE else Automaton(path, remember)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in pieces(offsets, CHUNK_BYTES):
                texts = [data[offsets[r] : offsets[r + 1]].tobytes() for r in range(i, j)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *make(a, texts)], names=names)
        if remember < CACHE:  # the worker may go on with other operators: nothing stays
            del a
            gc.collect()
        trim()

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", remember: int = CACHE) -> DataFrame:
    """(doc_id, ids array<int>), a row for each row of docs; null and empty texts, and white space, have no ids.

    remember bounds the pieces and words that a worker keeps: fewer take less memory and more time. Below CACHE the
    automaton is compiled for each task (0.3 s) and dropped at its end.
    """

    def make(a: Automaton, texts: list[bytes]) -> list[pa.Array]:
        ids = a.encode_all(texts)
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))]

    kind = docs.schema[id_col].dataType.simpleString()
    return _texts(docs, id_col, text_col).mapInArrow(_each(path, make, ["doc_id", "ids"], remember), f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) with the text that the ids stand for; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of each text's ids and of the text decoded from them."""
    from hashlib import sha256

    def make(a: Automaton, texts: list[bytes]) -> list[pa.Array]:
        n, ids_sha, text_sha = [], [], []
        for ids in a.encode_all(texts):
            ids = ids.tolist()
            n.append(len(ids))
            ids_sha.append(sha256(b" ".join(map(a._digits.__getitem__, ids))).hexdigest())
            text_sha.append(sha256(a.decode(ids).encode()).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    kind = docs.schema[id_col].dataType.simpleString()
    return _texts(docs, id_col, text_col).mapInArrow(_each(path, make, names), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
