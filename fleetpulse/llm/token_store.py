"""Token-id shards with a minimal perfect hash index.

Written: documents are range-partitioned by key and sorted; each task encodes
its texts and appends the raw ids (little-endian unsigned, 16 bits where the
vocabulary allows, else 32; an end id after every document) to one payload file.  Its rows (key, place in the
shard) are written by Spark in the same stage and name the file of the attempt
that was committed, so files of lost or repeated attempts are never read.

Indexed: record keys are dealt to buckets by hash; a bucket's task builds a
minimal perfect hash over its keys (levels of bit arrays: a key that shares its
bit with another goes on to the next level; the rank of its bit is its slot)
and stores, slot by slot, a fingerprint, shard, offset and length.

Read: a key's bucket, slot and fingerprint check give its shard and offset in
constant time; only that range of the payload is read.  All folders are under
the given root, a URI that driver and executors share.
"""

from __future__ import annotations

import gc
import io
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.common import same
from fleetpulse.session import materialize, scratch_path

SHARD_BYTES = 16 << 20          # of text per payload file
ROW_BYTES = 64                  # that a row counts for besides its text
BUCKET_KEYS = 1 << 16           # keys per index file, at most on average
LEAST_BUCKETS = 128             # so that small corpora are indexed in parallel, too
END_ID = 0
REMEMBERED = 300_000            # parts in each of two generations
SIGNS = 20_000                  # runs of signs remembered
ENCODE_DOCS = 256               # texts at a time
LEVELS = 64
GAMMA = 2.0


# ---------------------------------------------------------------- encoding
def _byte_level() -> dict[int, str]:
    """Character that stands for each byte in a byte-level vocabulary: printable bytes for themselves,
    the others in order from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


_BYTE_LEVEL = _byte_level()


def byte_level(text: str) -> str:
    """A text as a byte-level vocabulary spells it."""
    return text if text.isascii() and text.isalpha() else text.encode().decode("latin-1").translate(_BYTE_LEVEL)


def _ragged(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions begin[0], begin[0] + 1, ... of all runs, one run after another."""
    ends = np.cumsum(length)
    return np.repeat(begin - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)


class Known(dict):
    """Number by part; one that is not known gets the next number and is listed in ``new``."""

    def __init__(self):
        super().__init__()
        self.next, self.new = 0, []

    def __missing__(self, part: str) -> int:
        n = self[part] = self.next
        self.next = n + 1
        self.new.append(part)
        return n


class PieceIds:
    """Ids of texts, put together from remembered parts.

    The byte-level splitter always begins a new pre-token at a space that is
    followed by a non-space, so a text may be cut there and each part encoded
    by itself.  Texts that contain a special token's string are encoded whole.
    Two generations of parts are remembered: a full one becomes the old one, and
    parts met again are copied from it, so frequent words stay at hand.  A new
    part of Latin letters only, with or without the space before, is one
    pre-token: its byte-level form goes to the tokenizer's model directly.  Parts
    of Latin letters, ASCII signs and single line ends are runs of one kind each,
    which are pre-tokens, too: runs of letters that are known are copied.  Parts
    with apostrophes, digits or other letters go through the whole tokenizer.
    """

    _CUT = re.compile(r" (?=\S)")
    _ODD_SPACE = re.compile(r" (?:\s|$)")
    _LATIN = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
    _SIGNS = r"[!-&(-/:-@\[-`{-~]+"                         # without the apostrophe
    _LETTERS = re.compile(_LATIN)
    _RUN = re.compile(f"{_LATIN}|{_SIGNS}|\n")
    _RUNS = re.compile(f"\n?(?:(?:{_LATIN}+|{_SIGNS}+)\n?)++")      # possessive: linear for any part

    def __init__(self, tokenizer_path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        # letters go to the model directly only where the tokenizer is byte-level without normalisation
        self.bytewise = "ByteLevel" in str(self.tokenizer.pre_tokenizer) and self.tokenizer.normalizer is None
        self.pre_token, self.signs, self.stored = self.tokenizer.model.tokenize, {}, 0
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.remembered = remembered
        self._start({}, {})

    def _start(self, old_first: dict[str, int], old_later: dict[str, int]) -> None:
        self.first, self.later, self.old_first, self.old_later = Known(), Known(), old_first, old_later
        self.size = self.used = 0
        self.begin, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint16 if self.width == 2 else np.uint32)

    def _turn(self) -> None:
        """The parts known now become the old generation."""
        self.old_begin, self.old_length, self.old_ids = self.begin, self.length, self.ids[:self.used]
        self._start(self.first, self.later)

    def _numbers(self, parts: Iterable[str], count: int, known: Known, old: dict[str, int], lead: str) -> np.ndarray:
        """The number of every part; new parts are numbered on from ``size`` and then learned."""
        known.next = self.size
        at = np.fromiter(map(known.__getitem__, parts), np.int64, count)
        if new := known.new:
            known.new = []
            self._learn(new, range(self.size, self.size + len(new)), list(map(old.get, new)), lead)
        return at

    def _store(self, at: list[int], size: np.ndarray, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.length[at] = size
        self.begin[at] = self.used + np.cumsum(size) - size
        self.ids[self.used:self.used + len(ids)] = ids
        self.used += len(ids)

    def _direct(self, part: str, lead: str) -> list[int] | None:
        """Ids of a part that may go to the model itself, as a whole or run by run; None for others."""
        if not self.bytewise:
            return None
        if part.isascii() and part.isalpha():
            return [t.id for t in self.pre_token(_BYTE_LEVEL[32] + part if lead else part)]
        if self._LETTERS.fullmatch(part):
            return self._one(part, lead)
        if not self._RUNS.fullmatch(part) or lead and part[0] == "\n" or any(s in part for s in self.special):
            return None
        ids = []
        for run in self._RUN.findall(part):
            if run[0] > "\x7f" or run[0].isalpha():
                ids += self._known(run, lead)
            else:
                if (known := self.signs.get(lead + run)) is None:
                    known = self._one(run, lead)
                    if len(self.signs) < SIGNS:
                        self.signs[lead + run] = known
                ids += known
            lead = ""
        return ids

    def _one(self, run: str, lead: str) -> list[int]:
        """Ids of a pre-token."""
        return [t.id for t in self.pre_token((_BYTE_LEVEL[32] if lead else "") + byte_level(run))]

    def _known(self, run: str, lead: str) -> list[int]:
        """Ids of a run of letters, copied if it is known as a part (numbered below ``stored``: with its ids)."""
        known, old = (self.later, self.old_later) if lead else (self.first, self.old_first)
        n = known.get(run, self.stored)
        if n < self.stored:
            return self.ids[self.begin[n]:self.begin[n] + self.length[n]].tolist()
        if (n := old.get(run)) is not None:
            return self.old_ids[self.old_begin[n]:self.old_begin[n] + self.old_length[n]].tolist()
        return self._one(run, lead)

    def _learn(self, new: list[str], at: range, before: list[int | None], lead: str) -> None:
        """Encodes new parts, copies those the old generation knows (``before``: their numbers there)."""
        self.stored = self.size
        self.size += len(new)
        while self.size > len(self.begin):
            self.begin, self.length = (np.concatenate([a, np.zeros_like(a)]) for a in (self.begin, self.length))
        words, words_at, rest, rest_at, again, again_at = [], [], [], [], [], []
        for part, n, b in zip(new, at, before, strict=True):
            if b is not None:
                again.append(b)
                again_at.append(n)
            elif (ids := self._direct(part, lead)) is not None:
                words.append(ids)
                words_at.append(n)
            else:
                rest.append(lead + part)
                rest_at.append(n)
        for k in range(0, len(rest), 20_000):
            words += [e.ids for e in self.tokenizer.encode_batch_fast(rest[k:k + 20_000], add_special_tokens=False)]
        if words:
            size = np.fromiter(map(len, words), np.int64, len(words))
            self._store(words_at + rest_at, size, np.fromiter(chain.from_iterable(words), self.ids.dtype, int(size.sum())))
        if again:
            size = self.old_length[again]
            self._store(again_at, size, self.old_ids[_ragged(self.old_begin[again], size)])

    def _parts(self, text: str) -> list[str]:
        if any(s in text for s in self.special):
            return [text]
        return self._CUT.split(text) if self._ODD_SPACE.search(text) else text.split(" ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text."""
        collecting = gc.isenabled()
        gc.disable()                                       # many small lists, no cycles among them
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.size >= self.remembered:
            self._turn()
        split = [self._parts(t) if t else [] for t in texts]
        count = np.fromiter(map(len, split), np.int64, len(split))
        ends = np.cumsum(count)
        is_first = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
        is_first[(ends - count)[count > 0]] = True
        at = np.empty(len(is_first), np.int64)
        firsts = [p[0] for p in split if p]
        at[is_first] = self._numbers(firsts, len(firsts), self.first, self.old_first, "")
        rest = chain.from_iterable(p[1:] for p in split)
        at[~is_first] = self._numbers(rest, len(at) - len(firsts), self.later, self.old_later, " ")
        length = self.length[at]
        up_to = np.concatenate([[0], np.cumsum(length)])
        return self.ids[_ragged(self.begin[at], length)], np.diff(up_to[np.concatenate([[0], ends])])


@cache
def _pieces(tokenizer_path: str) -> PieceIds:
    return PieceIds(tokenizer_path)


# ---------------------------------------------------------------- files
def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def write_shards(docs: DataFrame, root: str, tokenizer_path: str, order: list | None = None, id_col: str = "doc_id",
                 text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Payload files under ``root/payload``; a row per document: ``doc_id, copy, shard, path,
    width, offset, n_tokens`` (width: bytes of an id).

    Documents stand in ``order`` (default: the id), rows alike in it by a hash of the text.  Alike rows are dealt over
    several shards like any others.  ``copy`` numbers the rows that share an id."""
    order = order or [F.col(id_col)]
    key_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
                       .alias("text"), *[c.alias(f"o{k}") for k, c in enumerate(order)],
                       F.monotonically_increasing_id().alias("row"))
    # a row counts for some bytes besides its text, so that empty texts fill shards, too
    total = rows.agg(F.sum(F.octet_length("text") + ROW_BYTES)).first()[0] or 0
    keys = [*[f"o{k}" for k in range(len(order))], F.xxhash64("text"), "row"]
    dealt = rows.repartitionByRange(max(1, -(-total // shard_bytes)), *keys).sortWithinPartitions(*keys)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, context = _pieces(tokenizer_path), TaskContext.get()
        shard, offset, copies = context.partitionId(), 0, {}
        uri = f"{root}/payload/shard-{shard:06d}-{context.taskAttemptId()}.ids"
        fs, path = _open(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as out:
            for batch in (b.slice(k, ENCODE_DOCS) for b in batches for k in range(0, b.num_rows, ENCODE_DOCS)):
                ids, n = pieces.encode(batch.column("text").to_pylist())
                n, ends = n + 1, np.cumsum(n)
                out.write(np.insert(ids, ends, END_ID).astype(f"<u{pieces.width}").tobytes())
                begin = offset + np.cumsum(n) - n
                offset += int(n.sum())
                copy = []
                for key in batch.column("doc_id").to_pylist():
                    copies[key] = copies.get(key, -1) + 1
                    copy.append(copies[key])
                size = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(copy, pa.int32()), pa.array([shard] * size, pa.int32()),
                     pa.array([uri] * size), pa.array([pieces.width] * size, pa.int32()), pa.array(begin, pa.int64()),
                     pa.array(n, pa.int64())],
                    names=["doc_id", "copy", "shard", "path", "width", "offset", "n_tokens"])

    written = materialize(dealt.select("doc_id", "text").mapInArrow(
        write, f"doc_id {key_type}, copy int, shard int, path string, width int, offset bigint, n_tokens bigint"),
        "token-entries")
    return _number_copies(written)


def _number_copies(entries: DataFrame) -> DataFrame:
    """Copy numbers that go on from shard to shard, for ids that occur in several shards."""
    each = entries.groupBy("doc_id", "shard").agg(F.count(F.lit(1)).alias("n"))
    spread = each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("shards")).where("shards > 1")
    ahead = F.sum("n").over(Window.partitionBy("doc_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    ahead = each.join(spread.select(F.col("doc_id").alias("s_id")), same(F.col("doc_id"), F.col("s_id")), "left_semi") \
        .select(F.col("doc_id").alias("a_id"), F.col("shard").alias("a_shard"), ahead.alias("ahead"))
    joined = entries.join(ahead, same(F.col("doc_id"), F.col("a_id")) & (F.col("shard") == F.col("a_shard")), "left_outer")
    return joined.withColumn("copy", (F.col("copy") + F.coalesce("ahead", F.lit(0))).cast("int")).select(entries.columns)


# ---------------------------------------------------------------- minimal perfect hash
def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


class PerfectHash:
    """Slots 0..n-1 for n distinct 128-bit keys, given as two arrays of 64 bits."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = [np.cumsum(b, dtype=np.int64) - 1 for b in levels]
        self.base = np.concatenate([[0], np.cumsum([int(b.sum()) for b in levels])])

    @staticmethod
    def _place(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mix(high ^ _mix(low, 2 * level + 1), 2 * level + 2) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        levels = []
        while len(high):
            if len(levels) == LEVELS:
                raise ValueError("record keys are not distinct")
            size = max(64, int(GAMMA * len(high)))
            place = cls._place(high, low, len(levels), size)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(alone)
            high, low = high[~alone[place]], low[~alone[place]]
        return cls(levels)

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for some keys that were not built in (others get a wrong slot, see fingerprints)."""
        out = np.full(len(high), -1, np.int64)
        for k, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            todo = np.flatnonzero(out < 0)
            place = self._place(high[todo], low[todo], k, len(bits))
            hit = bits[place]
            out[todo[hit]] = self.base[k] + rank[place[hit]]
        return out


def pack_index(high, low, shard, offset, n_tokens) -> bytes:
    """One bucket's index file: level bit arrays, then fingerprint, shard, offset and length by slot."""
    table = PerfectHash.build(high, low)
    slot = table.slots(high, low)
    columns = {}
    for name, kind, values in (("fingerprint", np.uint32, low >> np.uint64(32)), ("shard", np.int32, shard),
                               ("offset", np.int64, offset), ("n_tokens", np.int64, n_tokens)):
        columns[name] = np.zeros(len(high), kind)
        columns[name][slot] = values
    out = io.BytesIO()
    np.savez(out, sizes=np.array([len(b) for b in table.levels], np.int64),
             bits=np.packbits(np.concatenate([*table.levels, np.zeros(0, bool)])), **columns)
    return out.getvalue()


class BucketIndex:
    def __init__(self, data: bytes):
        a = np.load(io.BytesIO(data))
        sizes = a["sizes"]
        bits = np.unpackbits(a["bits"], count=int(sizes.sum())).astype(bool)
        self.table = PerfectHash(np.split(bits, np.cumsum(sizes)[:-1]) if len(sizes) else [])
        self.columns = {k: a[k] for k in ("fingerprint", "shard", "offset", "n_tokens")}

    def find(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Which keys are stored, and shard, offset and length of those."""
        slot = self.table.slots(high, low)
        found = slot >= 0
        found[found] = self.columns["fingerprint"][slot[found]] == (low[found] >> np.uint64(32)).astype(np.uint32)
        return found, {k: v[slot[found]] for k, v in self.columns.items() if k != "fingerprint"}


def key_hash(seed: int):
    """64 bits of a record key (document id and copy number)."""
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("copy"))


def _hashes(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return tuple(frame[c].to_numpy(np.int64).view(np.uint64) for c in ("high", "low"))


def write_index(entries: DataFrame, root: str, buckets: int) -> DataFrame:
    """Index files under ``root/index``; a row per file: ``bucket, index_path``."""
    def build(frame: pd.DataFrame) -> pd.DataFrame:
        bucket = int(frame["bucket"].iloc[0])
        uri = f"{root}/index/bucket-{bucket:06d}-{TaskContext.get().taskAttemptId()}.mph"
        fs, path = _open(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as out:
            out.write(pack_index(*_hashes(frame), *(frame[c].to_numpy() for c in ("shard", "offset", "n_tokens"))))
        return pd.DataFrame({"bucket": [bucket], "index_path": [uri]})

    return keyed(entries, buckets).select("bucket", "high", "low", "shard", "offset", "n_tokens") \
        .groupBy("bucket").applyInPandas(build, "bucket int, index_path string")


def keyed(records: DataFrame, buckets: int) -> DataFrame:
    return records.withColumns({"high": key_hash(1), "low": key_hash(2)}) \
        .withColumn("bucket", F.pmod(F.col("high"), F.lit(buckets)).cast("int"))


def look_up(records: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Keyed access: ``doc_id, copy`` -> ``shard, offset, n_tokens``; keys that are not stored give no row."""
    key_type = records.schema["doc_id"].dataType.simpleString()

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        fs, path = _open(frame["index_path"].iloc[0])
        with fs.open_input_file(path) as f:
            found, place = BucketIndex(f.read()).find(*_hashes(frame))
        return frame.loc[found, ["doc_id", "copy"]].assign(**place)

    return keyed(records.select("doc_id", "copy"), buckets).join(index, "bucket") \
        .groupBy("bucket").applyInPandas(find, f"doc_id {key_type}, copy int, shard int, offset bigint, n_tokens bigint")


def read_payload(places: DataFrame) -> DataFrame:
    """Adds ``ids_crc32`` of each record (its ids as 32 bits), read from its range of the payload file at ``path``."""
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in places.schema if f.name != "path")

    def read(frame: pd.DataFrame) -> pd.DataFrame:
        fs, path = _open(frame["path"].iloc[0])
        width = int(frame["width"].iloc[0])
        with fs.open_input_file(path) as f:
            crc = [zlib.crc32(np.frombuffer(f.read_at(width * n, width * o), f"<u{width}").astype("<u4"))
                   for o, n in zip(frame["offset"].tolist(), frame["n_tokens"].tolist(), strict=True)]
        return frame.drop(columns="path").assign(ids_crc32=np.array(crc, np.int64))

    return places.groupBy("shard").applyInPandas(read, f"{shape}, ids_crc32 bigint")


def running_start(shards: DataFrame, total: str, group: int = 4096) -> DataFrame:
    """``start``: sum of ``total`` over all earlier shards, in two steps so that no task orders all shards."""
    part = F.floor(F.col("shard") / group)
    before = lambda w: F.sum(total).over(w.rowsBetween(Window.unboundedPreceding, -1))
    inner = shards.withColumn("part", part).withColumn("inside", F.coalesce(
        before(Window.partitionBy("part").orderBy("shard")), F.lit(0)))
    parts = shards.groupBy(part.alias("part")).agg(F.sum(total).alias(total)) \
        .withColumn("ahead", F.coalesce(before(Window.partitionBy(F.lit(0)).orderBy("part")), F.lit(0))).drop(total)
    return inner.join(parts, "part").withColumn("start", F.col("ahead") + F.col("inside")).drop("part", "ahead", "inside")


def store_tokens(docs: DataFrame, tokenizer_path: str, root: str | None = None, order: list | None = None,
                 id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES,
                 bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Writes shards and index under ``root``, then reads every record back through the index.

    One row per input row: ``doc_id, copy, shard, start, n_tokens, ids_crc32``
    (``start``: ids of all documents before it, ``n_tokens`` with the end id).
    Documents stand in ascending id order, or by ``order`` (columns); rows that
    share an id are told apart by a copy number, in the order of a hash of
    their texts.  Null text counts as empty and is an end id alone; a null id
    is a key like any other and sorts first.  An empty table gives no rows.
    """
    root = root or scratch_path(docs.sparkSession, "token-store")
    entries = write_shards(docs, root, tokenizer_path, order, id_col, text_col, shard_bytes)
    buckets = max(LEAST_BUCKETS, -(-entries.count() // bucket_keys))
    index = materialize(write_index(entries, root, buckets), "token-index")
    shards = entries.groupBy("shard", "path", "width").agg(F.sum("n_tokens").alias("ids"))
    shards = materialize(running_start(shards, "ids").drop("ids"), "token-shards")
    places = look_up(entries, index, buckets).join(shards, "shard") \
        .withColumn("start", F.col("start") + F.col("offset"))
    return read_payload(places).select("doc_id", "copy", "shard", "start", "n_tokens", "ids_crc32")
