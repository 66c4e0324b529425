"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages (consecutive blocks of bytes), each encoded from its hashed byte trigrams to a vector
h. Gated attention gives passage k the weight a_k = softmax_k(w . (tanh(V h_k) * sigmoid(U h_k))), and the document's
score is sigmoid(c . sum_k a_k h_k + b). Only documents carry labels; which passages matter is learnt from them.

Training takes a bounded sample of the labelled rows (``most_labelled`` documents, of each at most ``most_passages``
passages, evenly spaced). Scoring reads whole texts of all rows, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.runtime import pieces, text_bytes, trim

PASSAGE_BYTES = 512
FEATURES = 1024
HIDDEN, GATE = 32, 16
STEPS, BATCH, RATE, DECAY = 600, 64, 3e-3, 1e-4
CHUNK_BYTES = 1 << 19
#: A score from here on predicts label 1.
THRESHOLD = 0.3


def passage_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts of hashed byte trigrams by passage, passages of each row); an empty row has one passage without any."""
    sizes = np.diff(offsets)
    n = np.maximum(1, -(-sizes // PASSAGE_BYTES))
    first = np.cumsum(n) - n
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(data)) - offsets[:-1][row]
    b = data.astype(np.uint32)
    h = b * np.uint32(0x9E3779B1)
    h[:-1] += b[1:] * np.uint32(0x85EBCA77)
    h[:-2] += b[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    whole = at + 2 < sizes[row]
    cell = (first[row] + at // PASSAGE_BYTES) * FEATURES + (h >> np.uint32(22)).astype(np.int64)
    total = int(n.sum())
    return np.bincount(cell[whole], minlength=total * FEATURES).reshape(total, FEATURES), n


def _unit(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts, dtype=np.float32)
    return x / np.sqrt(np.maximum(1, counts.sum(axis=1, keepdims=True)), dtype=np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """The network's weights; plain arrays, so that it travels with the tasks."""

    def __init__(self, prior: float, seed: int = 7):
        r = np.random.default_rng(seed)
        normal = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"E": normal(FEATURES, HIDDEN) * 4, "e": np.zeros(HIDDEN, np.float32), "V": normal(HIDDEN, GATE), "U": normal(HIDDEN, GATE), "w": normal(GATE) * 0.1, "c": np.zeros(HIDDEN, np.float32), "b": np.array([np.log(prior / (1 - prior))], np.float32)}

    def forward(self, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, tuple]:
        p, first = self.p, np.cumsum(n) - n
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (t * g) @ p["w"]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, first), n))
        a = s / np.repeat(np.add.reduceat(s, first), n)
        z = np.add.reduceat(a[:, None] * h, first)
        return _sigmoid(z @ p["c"] + p["b"][0]), (h, t, g, a, z, first)

    def gradients(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        score, (h, t, g, a, z, first) = self.forward(x, n)
        d = (score - y) / len(y)
        dz = np.repeat(d, n)[:, None] * p["c"]
        da = (dz * h).sum(axis=1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, first), n))
        dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"E": x.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ d, "b": np.array([d.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, steps: int = STEPS, seed: int = 11) -> Model:
        """Adam on the cross entropy, for as many whole epochs as ``steps`` batches need."""
        r = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(w) for k, w in self.p.items()}, {k: np.zeros_like(w) for k, w in self.p.items()}, 0
        for _ in range(-(-steps // -(-len(bags) // BATCH))):
            order = r.permutation(len(bags))
            for i in range(0, len(bags), BATCH):
                take = order[i : i + BATCH]
                n = np.array([len(bags[j]) for j in take])
                grads, step = self.gradients(_unit(np.concatenate([bags[j] for j in take])), n, y[take]), step + 1
                for k, g in grads.items():
                    g = g.astype(np.float32) + DECAY * self.p[k]
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The score of each whole text."""
        out = []
        for i, j in pieces(offsets, CHUNK_BYTES):
            part = offsets[i : j + 1] - offsets[i]
            if part[-1] > 2 * CHUNK_BYTES:
                out.append(np.array([self._long(data[offsets[i] : offsets[j]])]))
                continue
            counts, n = passage_features(data[offsets[i] : offsets[j]], part)
            out.append(self.forward(_unit(counts), n)[0])
        return np.concatenate(out).astype(np.float64) if out else np.zeros(0)

    def _long(self, text: np.ndarray) -> float:
        """One very long text: its passages are encoded in runs, and their attention is summed up as it goes."""
        p, top, mass, z = self.p, -np.inf, 0.0, np.zeros(HIDDEN)
        for i in range(0, len(text), 1024 * PASSAGE_BYTES):
            run = text[i : i + 1024 * PASSAGE_BYTES]
            x = _unit(passage_features(run, np.array([0, len(run)]))[0])
            h = np.tanh(x @ p["E"] + p["e"])
            s = (np.tanh(h @ p["V"]) * _sigmoid(h @ p["U"])) @ p["w"]
            high = max(top, float(s.max()))
            a, keep = np.exp(s - high), np.exp(top - high)
            top, mass, z = high, mass * keep + float(a.sum()), z * keep + a @ h
        return float(_sigmoid(z / mass @ p["c"] + p["b"][0]))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is divisible by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most_labelled: int = 3000, most_passages: int = 64) -> Model:
    """The model learnt from labelled documents that are not held out.

    Of more than ``most_labelled`` such labels, those whose ids hash lowest are taken. Labels other than 0 and 1,
    and labels without a document, don't count; if only one label or none is left, the score is its constant rate.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    known = known.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    chosen = F.broadcast(known)  # most_labelled rows at most
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(chosen, "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                n = max(1, -(-len(text) // PASSAGE_BYTES))
                take = np.unique(np.linspace(0, n - 1, min(n, most_passages)).astype(int))
                bag = np.concatenate([passage_features(p := text[k * PASSAGE_BYTES : (k + 1) * PASSAGE_BYTES], np.array([0, len(p)]))[0] for k in take])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(2).slice(i, 1), pa.array([np.minimum(bag, 255).astype(np.uint8).tobytes()], pa.binary())], names=["doc_id", "label", "bag"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = sorted(rows.mapInArrow(features, f"doc_id {kind}, label int, bag binary").collect(), key=lambda r: (r[0], bytes(r[2])))
    y = np.array([r[1] for r in got], np.float32)
    rate = float(np.clip((y.sum() + 1) / (len(y) + 2), 0.01, 0.99))
    model = Model(rate)
    if len(set(y.tolist())) < 2:
        return model
    return model.fit([np.frombuffer(r[2], np.uint8).reshape(-1, FEATURES) for r in got], y)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; null texts count as empty, repeated rows score alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(*text_bytes(batch.column(1))))], names=["doc_id", "score"])
        trim()

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least ``threshold``."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(*text_bytes(batch.column(at))) >= threshold))
        trim()

    return docs.mapInArrow(run, docs.schema)
