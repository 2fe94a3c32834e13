"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads windows of ``WINDOW`` bytes in both directions, labels every
byte with a probability for each learned language, and a document's
probabilities are the means over all its bytes (of the whole text: a document
is cut into consecutive windows).  It is trained in numpy by backpropagation
through time on a bounded sample of labelled rows: about ``per_language``
documents of each language, drawn by a hash of the id, and ``pieces`` windows
of each at hashed places.  Prediction runs in Arrow batches; the weights (a few
thousand numbers) travel with the tasks.

Arrays are laid out (features, windows), so that the gates are contiguous and
a block of windows stays in the processor's cache.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.session import materialize

WINDOW = 64
HIDDEN = 8
PER_LANGUAGE = 1000
PIECES = 8
STEPS = 800
BATCH = 192
BLOCK = 2048                    # windows at a time
UNKNOWN = "und"
STRANGE = "(none)"            # class of texts in no learned language; no language is named so
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = re.compile(r"[^\W\d_]")


def _gate(v: np.ndarray) -> np.ndarray:
    """Logistic function, in place."""
    np.negative(v, out=v)
    np.exp(v, out=v)
    v += 1
    return np.reciprocal(v, out=v)


class ByteGru:
    """Weights of both directions, and of the label of a position."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        small = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        # update gate, reset gate, candidate; one row of the input table per byte
        self.p = {f"{d}{k}": v for d in "fb" for k, v in (
            ("x", small(256, 3 * hidden)), ("h", small(3 * hidden, hidden)))}
        self.p |= {"o": small(len(languages), 2 * hidden), "ob": np.zeros(len(languages), np.float32)}

    # ---- one direction over (steps, windows) bytes
    def _forward(self, d: str, x: np.ndarray, real: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each byte; the backward direction starts at the last real byte of each window."""
        least, n, (steps, width) = int(real.min(initial=len(x))), self.hidden, x.shape
        table, mix = np.ascontiguousarray(self.p[f"{d}x"].T), self.p[f"{d}h"]
        states, h = np.empty((steps, n, width), np.float32), np.zeros((n, width), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            given = table.take(x[t], axis=1)
            rec = mix @ h
            gates = given[:2 * n]
            gates += rec[:2 * n]
            _gate(gates)
            update, reset = gates[:n], gates[n:]
            cand = reset * rec[2 * n:]
            cand += given[2 * n:]
            np.tanh(cand, out=cand)
            if keep is not None:
                keep.append((t, h, update, reset, rec[2 * n:], cand))
            step = cand - h
            step *= update
            h = np.add(h, step, out=states[t])
            if t >= least and d == "b":
                h *= real > t
        return states

    def _logits(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.hidden
        return self.p["o"][:, :n] @ f + self.p["o"][:, n:] @ b + self.p["ob"][:, None]

    def window_sums(self, x: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Sums of the positions' probabilities, (windows, languages); ``real`` bytes of each window count."""
        f, b = self._forward("f", x, real), self._forward("b", x, real)
        total = np.zeros((len(self.languages), x.shape[1]), np.float32)
        for t in range(len(x)):
            e = np.exp(np.clip(self._logits(f[t], b[t]), -30, 30))
            e *= (real > t) / e.sum(axis=0)
            total += e
        return total.T

    # ---- backpropagation through time
    def gradients(self, x: np.ndarray, real: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        n, width = self.hidden, x.shape[1]
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        tapes = {"f": [], "b": []}
        f, b = (self._forward(d, x, real, tapes[d]) for d in "fb")
        loss, count = 0.0, float(np.minimum(real, len(x)).sum())
        back = {"f": np.empty_like(f), "b": np.empty_like(b)}
        for t in range(len(x)):
            z = self._logits(f[t], b[t])
            z = np.exp(z - z.max(axis=0))
            z /= z.sum(axis=0)
            mask = (real > t) / count
            loss -= float((np.log(z[label, np.arange(width)] + 1e-9) * mask).sum())
            z[label, np.arange(width)] -= 1
            z *= mask
            g["o"][:, :n] += z @ f[t].T
            g["o"][:, n:] += z @ b[t].T
            g["ob"] += z.sum(axis=1)
            back["f"][t], back["b"][t] = self.p["o"][:, :n].T @ z, self.p["o"][:, n:].T @ z
        for d in "fb":
            mix, dh = self.p[f"{d}h"], np.zeros((n, width), np.float32)
            for t, h, update, reset, rec, cand in reversed(tapes[d]):
                dh = dh + back[d][t]
                if d == "b":
                    dh = dh * (real > t)
                d_cand = dh * update * (1 - cand * cand)
                d_update = dh * (cand - h) * update * (1 - update)
                d_reset = d_cand * rec * reset * (1 - reset)
                d_given = np.concatenate([d_update, d_reset, d_cand])
                d_rec = np.concatenate([d_update, d_reset, d_cand * reset])
                np.add.at(g[f"{d}x"], x[t], d_given.T)
                g[f"{d}h"] += d_rec @ h.T
                dh = dh * (1 - update) + mix.T @ d_rec
        return loss, g

    def fit(self, windows: list[bytes], labels: list[int], steps: int = STEPS, batch: int = BATCH, seed: int = 3) -> ByteGru:
        """Adam over random batches, languages drawn alike."""
        rng = np.random.default_rng(seed)
        # every fourth window is cut short, as short texts and the ends of texts are
        x, real = pack_windows([w[:rng.integers(4, WINDOW)] if k % 4 == 3 else w for k, w in enumerate(windows)])
        y = np.array(labels)
        by_label = [np.flatnonzero(y == k) for k in np.unique(y)]
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        for s in range(1, steps + 1):
            pick = np.concatenate([rng.choice(rows, -(-batch // len(by_label))) for rows in by_label])
            _, g = self.gradients(x[:, pick], real[pick], y[pick])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            rate = 0.02 * (1 - 0.9 * s / steps)
            for k, v in g.items():
                v *= min(1.0, 5.0 / (norm + 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * v
                square[k] = 0.99 * square[k] + 0.01 * v * v
                self.p[k] -= (rate * (mean[k] / (1 - 0.9 ** s)) / (np.sqrt(square[k] / (1 - 0.99 ** s)) + 1e-8)
                              ).astype(np.float32)
        return self

    # ---- documents
    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its mean probability over all bytes; ``und`` and 0 without any letter."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        known = [k for k, t in enumerate(texts) if t and _LETTER.search(t)]
        data = [texts[k].encode("utf-8", "surrogatepass") for k in known]
        sizes = np.array([len(d) for d in data], np.int64)
        windows = -(-sizes // WINDOW)
        total = int(windows.sum())
        sums = np.zeros((total, len(self.languages)), np.float32)
        flat = np.zeros(total * WINDOW, np.uint8)
        start = (np.cumsum(windows) - windows) * WINDOW
        for d, at in zip(data, start.tolist(), strict=True):
            flat[at:at + len(d)] = np.frombuffer(d, np.uint8)
        grid = _LOWER[flat].reshape(total, WINDOW)
        real = np.full(total, WINDOW)
        if total:
            real[np.cumsum(windows) - 1] = sizes - (windows - 1) * WINDOW
        for at in range(0, total, BLOCK):
            sums[at:at + BLOCK] = self.window_sums(np.ascontiguousarray(grid[at:at + BLOCK].T), real[at:at + BLOCK])
        if total:
            by_doc = np.add.reduceat(sums, start // WINDOW, axis=0, dtype=np.float64) / sizes[:, None]
            best = by_doc.argmax(axis=1)
            for k, c, p in zip(known, best.tolist(), by_doc[np.arange(len(best)), best].tolist(), strict=True):
                names[k] = UNKNOWN if self.languages[c] == STRANGE else self.languages[c]
                scores[k] = min(1.0, p)
        return names, scores


def pack_windows(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(WINDOW, n) bytes, padded with 0, and the real length of each window."""
    x = np.zeros((len(windows), WINDOW), np.uint8)
    for row, w in zip(x, windows, strict=True):
        row[:len(w)] = np.frombuffer(w[:WINDOW], np.uint8)
    return np.ascontiguousarray(_LOWER[x].T), np.array([min(len(w), WINDOW) for w in windows])


# First letter and size of alphabets that windows in no learned language are written in.
ALPHABETS = ((0x61, 26), (0x3b1, 25), (0x430, 32), (0x561, 38), (0x5d0, 27), (0x627, 36), (0x905, 53), (0xe01, 46),
             (0x10d0, 33), (0x3041, 86), (0x30a1, 90), (0x4e00, 3000), (0xac00, 3000))
MARKUP = ("<div class=\"{}\">", "</div>", "<a href=\"/{}/{}\">", "<li id={}>", "</span>", "&{};", "{{\"{}\": \"{}\"}}", "{} = {}();",
          "if ({} != {}) {{", "function {}({})", "[{}, {}]", "0x{}", "{}.{}({})")


def strange_windows(windows: list[str], n: int, seed: int = 5) -> list[str]:
    """``n`` windows in no learned language, made from ``windows`` of learned ones.

    A third has the letters of a window exchanged one for another (the look of an unknown language), the others are
    its characters in another order, words of random letters of some alphabet, hexadecimal and base-64 digits, and
    markup or code with random names."""
    rng = np.random.default_rng(seed)
    latin, digits = [chr(k) for k in range(97, 123)], "0123456789abcdef"
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

    def word(alphabet, least=2, most=10) -> str:
        first, size = alphabet
        return "".join(chr(first + k) for k in rng.integers(0, size, rng.integers(least, most)))

    def line() -> str:
        kind = rng.integers(0, 6)
        window = windows[rng.integers(0, len(windows))] if windows else ""
        if kind < 2:
            return window.lower().translate(dict(zip(map(ord, latin), rng.permutation(latin), strict=True)))
        if kind == 2:
            return "".join(rng.permutation(list(window)))
        if kind == 3:
            alphabet = ALPHABETS[rng.integers(0, len(ALPHABETS))]
            return " ".join(word(alphabet) for _ in range(WINDOW // 4))
        if kind == 4:
            letters = (digits, base64)[rng.integers(0, 2)]
            return "".join(letters[k] for k in rng.integers(0, len(letters), WINDOW))
        return " ".join(MARKUP[rng.integers(0, len(MARKUP))].format(*(word(ALPHABETS[0], 1, 8) for _ in range(3)))
                        for _ in range(WINDOW // 8))

    return [line()[:WINDOW] for _ in range(n)]


def training_windows(docs: DataFrame, learnable: Column, per_language: int = PER_LANGUAGE, pieces: int = PIECES,
                     id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, piece``: windows of about ``per_language`` documents of each language.

    Rows are drawn where a hash of id and text falls under the language's
    share.  Rows that repeat both fall in or out together, so the windows of a
    language are also held to the first ``2 * per_language * pieces`` by that
    hash: the sample is bounded whatever the table."""
    rows = docs.where(learnable & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)) \
        .select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    share = {r["lang"]: per_language / r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return rows.select("lang", F.col("text").alias("piece")).limit(0)
    rate = F.create_map(*[x for k, v in sorted(share.items()) for x in (F.lit(k), F.lit(float(v)))])
    rows = rows.withColumn("draw", F.xxhash64("doc_id", "text", F.lit("sample")))
    drawn = rows.where(F.pmod(F.col("draw"), F.lit(1 << 30)) < rate[F.col("lang")] * (1 << 30))
    at = F.pmod(F.xxhash64("doc_id", F.col("k")), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1) + 1
    windows = drawn.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(pieces)))) \
        .select("lang", F.col("text").substr(at.cast("int"), F.lit(WINDOW)).alias("piece"), "draw", "k")
    first = Window.partitionBy("lang").orderBy("draw", "k")
    return windows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= 2 * per_language * pieces) \
        .select("lang", "piece")


def train(docs: DataFrame, learnable: Column, strangers: bool = False, **options) -> ByteGru:
    """A network fitted on the driver to the bounded sample; without labelled rows it knows no language.

    With ``strangers`` it learns one more class, of :func:`strange_windows`, as many as a language has; a text that
    belongs to it most is ``und``."""
    rows = sorted(tuple(r) for r in training_windows(docs, learnable, **options).collect())
    languages = sorted({lang for lang, _ in rows})
    if strangers and languages:
        rows += [(STRANGE, w) for w in strange_windows([w for _, w in rows], len(rows) // len(languages))]
        languages = [*languages, STRANGE]
    model = ByteGru(languages)
    if len(languages) > 1:
        number = {c: k for k, c in enumerate(languages)}
        model.fit([p.encode("utf-8", "surrogatepass") for _, p in rows], [number[c] for c, _ in rows])
    return model


def identify(docs: DataFrame, model: ByteGru, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, lang_pred, score``.

    Only the text is read.  Null, empty and letterless texts are ``und`` with
    score 0; with a class of strangers, their texts are ``und`` with its probability; a model without languages answers ``und`` throughout, with one
    language always that one.  Repeated rows get equal answers.
    """
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                names, scores = model.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()),
                                                  pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    key_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(predict, f"doc_id {key_type}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: ByteGru, least_score: float, least_strange: float = 0.75,
                    text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all columns.

    Rejected are null texts, texts without a letter, texts of a language with a score below ``least_score`` and, where
    the model has a class of strangers, texts that belong to it with a probability of ``least_strange`` or more.
    The verdict goes by a hash of the text, so rows that share an id are judged each by its own text."""
    text = F.col(text_col).cast("string")
    known = docs.where(text.isNotNull()).select(F.xxhash64(text).alias("text_hash"), text.alias("text"))
    verdict = identify(known, model, id_col="text_hash")
    bad = verdict.where(F.when(F.col("lang_pred") == UNKNOWN, (F.col("score") == 0) | (F.col("score") >= least_strange))
                        .otherwise(F.col("score") < least_score))
    bad = materialize(bad.select(F.col("doc_id").alias("bad_hash")).distinct(), "lang-rejected")
    return docs.where(F.col(text_col).isNotNull()).join(bad, F.xxhash64(docs[text_col].cast("string")) == bad["bad_hash"],
                                                        "left_anti")
