"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages (consecutive pieces of about ``PASSAGE`` bytes,
cut between words; the whole text).  Each passage is encoded by byte-class
shares, hashed word shares, word shapes and repetition measures, then by a
learned layer ``h = tanh(E x + e)``.  Gated attention weighs the passages,
``a = softmax(w . (tanh(V h) * sigmoid(U h)))``, and the document score is
``sigmoid(c . sum(a h) + b)``: only document labels are needed, the model finds
out which passages matter.

Encoding and scoring run in Arrow batches over all documents.  The network is
fitted in numpy on the driver to a bounded sample: about ``per_class`` labelled
documents of each label, drawn by a hash of the id and encoded on the
executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.common import same

PASSAGE = 512
PER_CLASS = 1500
WORD_BUCKETS = 64
HIDDEN = 16
ATTENTION = 8
STEPS = 900
BATCH = 64
THRESHOLD = 0.3
BLOCK_BYTES = 1 << 18

# Byte classes: each ASCII mark its own, letters and digits by kind, bytes beyond ASCII together.
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS = np.zeros(256, np.int64)                           # 0: control
_CLASS[[ord(c) for c in " "]] = 1
_CLASS[[9, 10, 13]] = 2
_CLASS[48:58] = 3
_CLASS[65:91] = 4
_CLASS[97:123] = 5
_CLASS[128:] = 6
for _k, _b in enumerate(_MARKS):
    _CLASS[_b] = 7 + _k
CLASSES = 7 + len(_MARKS)
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_VALUE = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)
_VALUE[65:91] = _VALUE[97:123]
_VALUE[_WHITE] = 0
SHAPES = 9
FEATURES = CLASSES + WORD_BUCKETS + SHAPES


def _distinct(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """Number of distinct values in each group (by 40 bits of the value's hash)."""
    keys = np.sort(group.astype(np.uint64) << np.uint64(40) | value >> np.uint64(24))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[new] >> np.uint64(40)).astype(np.int64), minlength=groups).astype(float)


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Passage features (passages, FEATURES) and the number of passages of each text (1 for an empty text)."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(d) for d in data], np.int64)
    raw = np.frombuffer(b"".join(data), np.uint8)
    ends = np.cumsum(sizes)
    begin = ends - sizes
    inside = ~_WHITE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[begin[sizes > 0]] = inside[begin[sizes > 0]]
    at = np.flatnonzero(first)                             # where words begin
    doc_of_word = np.repeat(np.arange(len(sizes)), np.diff(np.searchsorted(at, np.append(begin, len(raw)))))
    # a passage is the words that begin in the same PASSAGE bytes of the text
    word_passage = (at - begin[doc_of_word]) // PASSAGE
    per_doc = np.maximum(1, -(-sizes // PASSAGE))
    base = np.cumsum(per_doc) - per_doc
    passage = base[doc_of_word] + word_passage
    total = int(per_doc.sum())
    span = np.full(total, PASSAGE)                         # bytes of each passage
    span[base + per_doc - 1] = sizes - (per_doc - 1) * PASSAGE

    cell = np.repeat(np.arange(total) * CLASSES, span)
    cell += _CLASS[raw]
    shares = np.bincount(cell, minlength=total * CLASSES).reshape(total, CLASSES)
    n_bytes = np.maximum(shares.sum(axis=1, keepdims=True), 1)
    shape = np.zeros((total, SHAPES))
    buckets = np.zeros((total, WORD_BUCKETS))
    if len(at):
        place = np.arange(at[0], len(raw), dtype=np.uint64)
        place -= np.repeat(at.astype(np.uint64), np.diff(np.append(at, len(raw))))
        place *= np.uint64(0x9E3779B97F4A7C15)
        place |= np.uint64(1)
        place *= _VALUE[raw[at[0]:]]
        word = np.add.reduceat(place, at - at[0])
        word = (word ^ (word >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        word ^= word >> np.uint64(32)
        length = np.add.reduceat(inside[at[0]:].astype(np.int64), at - at[0])
        n_words = np.bincount(passage, minlength=total).astype(float)
        some = np.maximum(n_words, 1)
        buckets = np.bincount(passage * WORD_BUCKETS + (word % np.uint64(WORD_BUCKETS)).astype(np.int64),
                              minlength=total * WORD_BUCKETS).reshape(total, WORD_BUCKETS) / some[:, None]
        pair = word[:-1] * np.uint64(3) + word[1:]
        in_doc = doc_of_word[:-1] == doc_of_word[1:]
        doc_words = np.bincount(doc_of_word, minlength=len(sizes))
        new_in_doc = _distinct(doc_of_word, word, len(sizes)) / np.maximum(doc_words, 1)
        new_pairs = _distinct(doc_of_word[:-1][in_doc], pair[in_doc], len(sizes)) / np.maximum(doc_words - 1, 1)
        doc_of_passage = np.repeat(np.arange(len(sizes)), per_doc)
        shape = np.column_stack([
            _distinct(passage, word, total) / some,
            _distinct(passage[:-1][in_doc], pair[in_doc], total) / some,
            np.bincount(passage, length, total) / some / 10,
            np.bincount(passage, length > 14, total) / some,
            np.bincount(passage, length < 3, total) / some,
            new_in_doc[doc_of_passage], new_pairs[doc_of_passage],
            np.log1p(n_words) / 5, np.log1p(doc_words)[doc_of_passage] / 10])
    return np.hstack([np.sqrt(shares / n_bytes), np.sqrt(buckets), shape]).astype(np.float32), per_doc


def _logistic(v):
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


class AttentionModel:
    """Weights of the encoder layer, gated attention and score."""

    def __init__(self, features: int = FEATURES, hidden: int = HIDDEN, attention: int = ATTENTION, seed: int = 5):
        rng = np.random.default_rng(seed)
        w = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-1])).astype(np.float32)
        self.p = {"E": w(hidden, features), "e": np.zeros(hidden, np.float32), "V": w(attention, hidden),
                  "U": w(attention, hidden), "w": w(attention), "c": w(hidden), "b": np.zeros(1, np.float32)}
        self.center, self.scale = np.zeros(features, np.float32), np.ones(features, np.float32)

    def _bag(self, x: np.ndarray, starts: np.ndarray, counts: np.ndarray):
        """Forward over all passages of some bags; the tensors that the backward pass needs."""
        p = self.p
        h = np.tanh(x @ p["E"].T + p["e"])
        v, u = np.tanh(h @ p["V"].T), _logistic(h @ p["U"].T)
        logit = (v * u) @ p["w"]
        bag = np.repeat(np.arange(len(counts)), counts)
        a = np.exp(logit - np.maximum.reduceat(logit, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return h, v, u, a, bag, z, _logistic(z @ p["c"] + p["b"][0])

    def scores(self, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each bag, attention weight of each passage."""
        out = self._bag((x - self.center) * self.scale, np.cumsum(counts) - counts, counts)
        return out[6], out[3]

    def gradients(self, x, counts, label, weight):
        p, starts = self.p, np.cumsum(counts) - counts
        h, v, u, a, bag, z, s = self._bag(x, starts, counts)
        d = ((s - label) * weight / weight.sum()).astype(np.float32)
        g = {"c": d @ z, "b": np.array([d.sum()], np.float32)}
        dz = d[:, None] * p["c"]
        dh = a[:, None] * dz[bag]
        da = (h * dz[bag]).sum(axis=1)
        dl = a * (da - np.add.reduceat(a * da, starts)[bag])
        g["w"] = dl @ (v * u)
        dv = dl[:, None] * p["w"] * u * (1 - v * v)
        du = dl[:, None] * p["w"] * v * u * (1 - u)
        g["V"], g["U"] = dv.T @ h, du.T @ h
        dh += dv @ p["V"] + du @ p["U"]
        dh *= 1 - h * h
        g["E"], g["e"] = dh.T @ x, dh.sum(axis=0)
        return g

    def fit(self, x: np.ndarray, counts: np.ndarray, label: np.ndarray, steps: int = STEPS, batch: int = BATCH,
            seed: int = 9) -> AttentionModel:
        """Adam over bags, both labels drawn alike; the prior odds are put back into the bias."""
        rng = np.random.default_rng(seed)
        self.center = x.mean(axis=0)
        self.scale = (1 / np.maximum(x.std(axis=0), 0.02)).astype(np.float32)
        x = (x - self.center) * self.scale
        starts = np.cumsum(counts) - counts
        sides = [np.flatnonzero(label == k) for k in (0, 1)]
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        for s in range(1, steps + 1):
            pick = np.concatenate([rng.choice(side, batch // 2) for side in sides])
            rows = np.concatenate([np.arange(starts[k], starts[k] + counts[k]) for k in pick])
            g = self.gradients(x[rows], counts[pick], label[pick], np.ones(len(pick)))
            rate = 0.01 * (1 - 0.9 * s / steps)
            for k, v in g.items():
                v = v + 1e-4 * self.p[k]
                mean[k] = 0.9 * mean[k] + 0.1 * v
                square[k] = 0.99 * square[k] + 0.01 * v * v
                self.p[k] -= (rate * (mean[k] / (1 - 0.9 ** s)) / (np.sqrt(square[k] / (1 - 0.99 ** s)) + 1e-8)
                              ).astype(np.float32)
        return self

    def shift(self, odds: float) -> None:
        """Moves the score from equal classes to the given prior odds of label 1."""
        self.p["b"] += np.float32(np.log(odds))


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of batches of about BLOCK_BYTES of text (one text at least) with their passages."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop] or "") <= BLOCK_BYTES):
                size += len(texts[stop] or "")
                stop += 1
            yield (batch.slice(at, stop - at), *encode(texts[at:stop]))
            at = stop


def train(docs: DataFrame, labels: DataFrame, learnable: Column, per_class: int = PER_CLASS, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality") -> AttentionModel | None:
    """A model fitted to the bounded sample; None unless both labels occur.

    ``learnable`` is a condition on ``doc_id``.  Null labels and labels other
    than 0 and 1 are ignored; an id with both labels counts for each.
    Labels are drawn by a hash of the id, about ``per_class`` of each and twice
    that at most; of the documents they mark, where ids repeat, the first
    ``4 * per_class`` by a hash of their content are taken."""
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")) \
        .where(learnable & F.col("label").isin(0, 1))
    counts = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(counts) != {0, 1}:
        return None
    rate = F.when(F.col("label") == 0, per_class / counts[0]).otherwise(per_class / counts[1])
    drawn = marked.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < rate * (1 << 30))
    first = Window.partitionBy("label").orderBy(F.xxhash64("doc_id", F.lit("place")))
    drawn = drawn.withColumn("place", F.row_number().over(first)).where(F.col("place") <= 2 * per_class) \
        .select(F.col("doc_id").alias("m_id"), "label").distinct()
    # about 2 * per_class rows, 4 * per_class at most whatever the tables, so the texts need not be dealt by id
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .join(F.broadcast(drawn), same(F.col("doc_id"), F.col("m_id"))).select("doc_id", "label", "text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, counts in _encoded(batches):
            cuts = np.cumsum(counts)[:-1]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.string()), part.column("label"),
                 pa.array([f.astype(np.float16).tobytes() for f in np.split(x, cuts)], pa.binary())],
                names=["doc_id", "label", "x"])

    rows = sorted((r["doc_id"] or "", r["label"], bytes(r["x"]))
                  for r in texts.mapInArrow(gather, "doc_id string, label int, x binary")
                  .orderBy(F.xxhash64("doc_id", "x")).limit(4 * per_class).collect())
    bags = [np.frombuffer(x, np.float16).reshape(-1, FEATURES).astype(np.float32) for _, _, x in rows]
    label = np.array([k for _, k, _ in rows])
    if len(set(label.tolist())) < 2:
        return None
    model = AttentionModel().fit(np.concatenate(bags), np.array([len(b) for b in bags]), label)
    model.shift(counts[1] / counts[0])
    return model


def score_quality(docs: DataFrame, model: AttentionModel | None, threshold: float = THRESHOLD, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, score, predicted, n_passages, top_passage`` (number and weight of the
    passage with the most attention).

    Only the text is read.  Null and empty texts are one empty passage and get
    a score like any other.  Without a model every score is 0.5.  Repeated rows
    get equal scores.
    """
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, counts in _encoded(batches):
            s, a = model.scores(x, counts) if model else (np.full(len(counts), 0.5), np.zeros(len(x)))
            top = [int(w.argmax()) for w in np.split(a, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32)),
                 pa.array(counts, pa.int64()), pa.array(top, pa.int64())],
                names=["doc_id", "score", "predicted", "n_passages", "top_passage"])

    key_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        score, f"doc_id {key_type}, score double, predicted int, n_passages bigint, top_passage bigint")
