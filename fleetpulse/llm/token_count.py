"""Token counts of whole texts with a piece tokenizer.

Texts travel in Arrow batches and only lengths come back.  A text is cut at
*safe boundaries* and its count is the sum over the parts.  A boundary is a
space after any character but a space or the word mark, and not at the end: no
piece of the vocabulary holds a word mark after another character, so no merge
crosses it, and the tokenizer puts the mark back in front of the next part.
The parts that a batch brings anew go to the tokenizer as one list, in an
encoding call over the whole batch; their lengths are remembered per worker in
a table of bounded size, as words repeat.  Arrow batches are cut into batches
of about ``BATCH_BYTES`` of text (one text at least), so that a call is bounded
by bytes and not by rows.

Tasks are balanced by bytes twice: the scan deals splits of like size, and a
text beyond ``long_bytes`` is cut into segments (at safe boundaries again)
that are dealt anew, so that neither one very long text nor a file of them
keeps one task busy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE_MARK = "▁"
REMEMBERED = 1_000_000
LONGEST_REMEMBERED = 48
LONG_BYTES = 1 << 20
BATCH_BYTES = 1 << 20
_BOUNDARY = re.compile(f"(?<=[^ {SPACE_MARK}]) (?=.)", re.DOTALL)


def safe_parts(text: str) -> list[str]:
    """Parts of a text whose token counts add up to the count of the text."""
    if SPACE_MARK not in text and "  " not in text and not text.startswith(" ") and not text.endswith(" "):
        return text.split(" ")
    return _BOUNDARY.split(text)


def segments(text: str | None, most: int) -> list[str]:
    """Pieces of about ``most`` characters, cut at safe boundaries; ``[""]`` for null."""
    text, out, begin = text or "", [], 0
    while len(text) - begin > most:
        cut = _BOUNDARY.search(text, begin + most)
        if cut is None:
            break
        out.append(text[begin:cut.start()])
        begin = cut.end()
    return [*out, text[begin:]]


class PartLengths(dict):
    """Token count by part; short parts are remembered, and all is forgotten when the table is full."""

    def __init__(self, encode, remembered: int = REMEMBERED):
        super().__init__()
        self.encode, self.remembered = encode, remembered      # encode: list of texts -> list of ids of each

    def counts(self, texts: list[str | None]) -> list[int]:
        """Token counts of a batch of texts: one encoding call for the parts not remembered."""
        split = [safe_parts(t) if t else [] for t in texts]
        new = list({p for parts in split for p in parts if p not in self})
        lengths = dict(zip(new, map(len, self.encode(new)), strict=True)) if new else {}
        known = [sum(lengths[p] if p in lengths else self[p] for p in parts) for parts in split]
        short = {p: n for p, n in lengths.items() if len(p) <= LONGEST_REMEMBERED}
        if len(self) + len(short) > self.remembered:
            self.clear()
        self.update(islice(short.items(), self.remembered))
        return known

    def count(self, text: str | None) -> int:
        return self.counts([text])[0]


def byte_batches(sizes: list[int], most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of ``most`` bytes together, one text at least."""
    begin, total = 0, 0
    for k, size in enumerate(sizes):
        if k > begin and total + size > most:
            yield begin, k
            begin, total = k, 0
        total += size
    if sizes:
        yield begin, len(sizes)


@cache
def _counter(model_path: str) -> PartLengths:
    """One per worker process and model; checks that the vocabulary has the boundaries used above."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    crossing = [p for p in map(model.id_to_piece, range(model.get_piece_size())) if SPACE_MARK in p.lstrip(SPACE_MARK)]
    if crossing or model.encode("a") != model.encode("a b")[:1] or model.encode("b") != model.encode("a b")[1:]:
        raise ValueError(f"texts cannot be cut at spaces for this vocabulary: {crossing[:5]}")
    return PartLengths(lambda parts: model.encode(parts, num_threads=1))


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text", long_bytes: int = LONG_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``n_tokens`` is what the sentencepiece model at ``model_path`` (on every
    executor) gives for the whole text, without begin, end or other added
    tokens; null and empty texts have 0 bytes and tokens.  Repeated rows are
    counted each; a null id stays null; other columns are ignored.
    """
    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path)
        for batch in batches:
            text = batch.column("text")
            n = [k for begin, end in byte_batches(pc.fill_null(pc.binary_length(text), 0).to_pylist())
                 for k in counter.counts(text.slice(begin, end - begin).to_pylist())]
            rest = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64())],
                                             names=[*batch.schema.names[:-1], "n_tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):                 # one long text at a time
                parts = segments(batch.column("text")[row].as_py(), long_bytes // 4)
                same = [pa.repeat(batch.column(k)[row], len(parts)) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(parts, pa.string())], names=batch.schema.names)

    key_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
                       .alias("n_bytes"), F.col(text_col).cast("string").alias("text"))
    short = rows.where(F.col("n_bytes") <= long_bytes) \
        .mapInArrow(lengths, f"doc_id {key_type}, n_bytes bigint, n_tokens bigint")
    # segments of a long text carry a number drawn for its row, so repeated rows stay apart
    long = rows.where(F.col("n_bytes") > long_bytes).select(
        "doc_id", "n_bytes", F.struct(F.spark_partition_id(), F.monotonically_increasing_id()).alias("row"), "text")
    shape = f"doc_id {key_type}, n_bytes bigint, row struct<a:int,b:bigint>"
    parts = long.mapInArrow(cut, f"{shape}, text string").repartition(F.xxhash64("text")) \
        .mapInArrow(lengths, f"{shape}, n_tokens bigint")
    summed = parts.groupBy("doc_id", "n_bytes", "row").agg(F.sum("n_tokens").alias("n_tokens")).drop("row")
    return short.unionByName(summed).withColumn("over_limit", F.col("n_tokens") > limit)
