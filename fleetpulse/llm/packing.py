"""Best-fit packing of tokenized documents by the linear grouping scheme.

Spark encodes the documents, cuts long ones into pieces, and counts the pieces
by length: at most ``capacity`` numbers, whatever the size of the corpus.  The
plan is made from these counts on the driver, in four steps:

1. *Linear grouping.*  The large lengths (above a threshold) stand in descending
   order in ``groups`` groups of equally many pieces, and every length is
   rounded up to the largest of its group.
2. *Configurations.*  A configuration is how many pieces of each rounded size a
   sequence holds.  The linear program over all configurations (fewest sequences
   that hold all pieces) is solved by column generation: a knapsack over the
   dual prices finds the next configuration.  Each configuration is used as
   often as its whole part says.
3. *Substitution.*  Actual lengths, the longest first, take the places of their
   group.  Sequences with the same lengths in the same places are a *run*: its
   first sequence, how many, and the space left.
4. *Best fit.*  What is left (the fractions' large pieces, then the small ones),
   by descending length, goes where the least space is left that holds it, a run
   at a time; new sequences are opened where none does.

A placement says: of length l, the pieces of rank r to r + n go to sequences s
to s + k at offset o.  A piece's rank among those of its length comes from
counts by task and length, so it finds its place by itself; nothing is
gathered or sorted, and the plan's size depends on capacity and groups alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.common import same
from fleetpulse.llm.token_store import END_ID, PieceIds, _ragged, byte_level
from fleetpulse.session import materialize

CAPACITY = 2048
GROUPS = 192
SMALL = (1 / 4, 1 / 3, 1 / 2)   # of the capacity: thresholds tried
ROUNDS = 400                    # of column generation, at most
REMEMBERED = 400_000            # words in each of two generations
ENCODE_DOCS = 4096              # texts at a time, so that few words are looked up more than once


# ---------------------------------------------------------------- encoding
class WordIds(PieceIds):
    """Ids of texts for a tokenizer that drops white space: a text may be cut at any white space.

    A new word of Latin letters, with or without punctuation behind, is one or two pre-tokens: its lower-case
    letters go to the tokenizer's model directly and are remembered, too.  All else goes through the whole
    tokenizer; texts with a special token's string, or with separators that are no white space to the
    tokenizer, do so uncut."""

    _MARKS = ".,;:!?"
    _SEPARATORS = "\x1c\x1d\x1e\x1f"                       # white space for str.split only

    def __init__(self, tokenizer_path: str, remembered: int = REMEMBERED):
        super().__init__(tokenizer_path, remembered)
        self.stems: dict[str, list[int]] = {}
        self.model = self.tokenizer.model.tokenize
        self.uncut = "|".join(re.escape(x) for x in (*self.special, *self._SEPARATORS) if x)
        probe = self.tokenizer.encode("Abc déf, x", add_special_tokens=False).ids
        if probe != [i for w in ("Abc", "déf,", "x") for i in self._direct(w, "")] or self.tokenizer.encode(" \n").ids:
            raise ValueError("texts cannot be cut at white space for this tokenizer")

    def _turn(self) -> None:
        super()._turn()
        self.stems = {}

    def _of_model(self, word: str, plain: bool) -> list[int]:
        ids = self.stems[word] = [t.id for t in self.model(word if plain else byte_level(word))]
        return ids

    def _direct(self, part: str, lead: str) -> list[int] | None:
        known = self.stems
        if part.isalpha() and part.isascii():
            low = part.lower()
            return known.get(low) or self._of_model(low, True)
        stem = part.rstrip(self._MARKS)
        plain = stem.isascii() and stem.isalpha()
        if not (plain or self._LETTERS.fullmatch(stem)):
            return None
        low = stem.lower()
        if len(low) != len(stem):                          # a lower case of several characters
            return None
        ids = known.get(low) or self._of_model(low, plain)
        if len(stem) == len(part):
            return ids
        marks = part[len(stem):]
        return ids + (known.get(marks) or self._of_model(marks, False))

    def _encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each different word of the texts is looked up once; Arrow splits the texts and numbers their words."""
        if self.size >= self.remembered:
            self._turn()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        words = pc.utf8_split_whitespace(texts)
        odd = pc.match_substring_regex(texts, self.uncut)
        if pc.any(odd).as_py():
            words = pa.array([[text] if uncut else cut for text, uncut, cut in zip(
                texts.to_pylist(), odd.to_pylist(), words.to_pylist(), strict=True)], words.type)
        ends, words = np.asarray(words.offsets), words.flatten().dictionary_encode()
        different, place = words.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(words.indices)
        at = self._numbers(different, len(different), self.later, self.old_later, "")[place]
        length = self.length[at]
        up_to = np.concatenate([[0], np.cumsum(length)])
        return self.ids[_ragged(self.begin[at], length)], np.diff(up_to[ends - ends[0]])


@cache
def _words(tokenizer_path: str) -> WordIds:
    return WordIds(tokenizer_path)


def _running(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many equal values came before each; ``counts`` holds the numbers so far and is moved on."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    first = np.searchsorted(ranked, ranked, "left")
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - first + counts[ranked]
    np.add.at(counts, values, 1)
    return out


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece, with ``task`` and ``rank`` (among the pieces of
    its length in its task).  A document's ids end with an end id; null text is empty."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, seen = _words(tokenizer_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in (b.slice(k, ENCODE_DOCS) for b in batches for k in range(0, b.num_rows, ENCODE_DOCS)):
            ids, n = words.encode(batch.column(1))
            n, ends = n + 1, np.cumsum(n)
            data = memoryview(np.insert(ids, ends, END_ID).astype("<u4")).cast("B")
            pieces = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = _ragged(np.zeros(len(n), np.int64), pieces)
            start = piece * capacity
            length = np.minimum(capacity, n[row] - start)
            at = 4 * ((np.cumsum(n) - n)[row] + start)
            crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                 pa.array(crc, pa.int64()), pa.array(np.full(len(row), task), pa.int32()), pa.array(_running(length, seen))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    key_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(
        cut, f"doc_id {key_type}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint")


# ---------------------------------------------------------------- the plan
def linear_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths with their counts, longest first, in groups of equally many pieces (a length may be in several); as
    few lengths as groups need no rounding and are groups of their own."""
    if len(counts) <= groups:
        return [[(length, counts[length])] for length in sorted(counts, reverse=True)]
    total, out, room = sum(counts.values()), [], 0
    share = max(1, -(-total // groups))
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not room:
                out.append([])
                room = share
            take = min(n, room)
            out[-1].append((length, take))
            n, room = n - take, room - take
    return out


def _best_configuration(sizes: list[int], prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the highest price: a knapsack with any number of each size."""
    value = np.zeros(capacity + 1)
    for s, p in zip(sizes, prices, strict=True):
        more = 1                                           # 1, 2, 4, ... further pieces of the size
        while more * s <= capacity and p > 0:
            value[more * s:] = np.maximum(value[more * s:], value[:-more * s] + more * p)
            more *= 2
    counts, c, at = np.zeros(len(sizes)), capacity, np.array(sizes)
    while True:
        c = int(np.searchsorted(value[:c + 1], value[c] - 1e-12))          # values never fall with the space
        fits = np.flatnonzero(at <= c)
        if not len(fits) or value[c] <= 0:
            return float(value[capacity]), counts
        k = fits[int((value[c - at[fits]] + prices[fits]).argmax())]
        counts[k] += 1
        c -= sizes[k]


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Configurations and how many sequences of each the linear program uses (one per size at most)."""
    columns = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, float)
    for _ in range(rounds):
        inverse = np.linalg.inv(columns)
        used, prices = inverse @ need, inverse.sum(axis=0)
        worth, column = _best_configuration(sizes, np.maximum(prices, 0), capacity)
        if worth <= 1 + 1e-9:
            break
        change = inverse @ column
        ratio = np.where(change > 1e-9, np.maximum(used, 0) / np.where(change > 1e-9, change, 1), np.inf)
        columns[:, int(ratio.argmin())] = column
    used = np.linalg.solve(columns, need)
    return [(np.rint(columns[:, k]).astype(int), float(used[k])) for k in range(len(sizes)) if used[k] >= 1]


class Plan:
    """Runs of sequences with equal space left, and the placements made so far."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.placed: list[tuple[int, int, int, int, int, int]] = []      # length, rank, n, first, sequences, offset
        self.ranks: dict[int, int] = {}
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]   # by space left: first, sequences

    def put(self, length: int, n: int, first: int, sequences: int, left: int) -> None:
        """``n`` pieces over sequences with ``left`` space, in turn; n is a multiple of their number."""
        rank = self.ranks.get(length, 0)
        self.placed.append((length, rank, n, first, sequences, self.capacity - left))
        self.ranks[length] = rank + n

    def new(self, sequences: int) -> int:
        self.sequences += sequences
        return self.sequences - sequences

    def substitute(self, configuration: np.ndarray, sequences: int, groups: list[list[tuple[int, int]]]) -> None:
        """Opens sequences of one configuration and fills its places with the longest pieces of their groups."""
        runs = [(self.new(sequences), sequences, self.capacity)]
        for g in np.repeat(np.arange(len(groups)), configuration):
            filled, pool = [], groups[g]
            for first, n, left in runs:
                while n:
                    length, there = pool[0]
                    take = min(n, there)
                    self.put(length, take, first, take, left)
                    filled.append((first, take, left - length))
                    first, n = first + take, n - take
                    pool[:1] = [(length, there - take)] if there > take else []
            runs = filled
        for first, n, left in runs:
            self.open[left].append((first, n))

    def _fill(self, length: int, n: int, first: int, sequences: int, left: int) -> int:
        """Puts up to ``n`` pieces into the run, as many in a sequence as it holds; returns how many."""
        each = left // length
        full = min(sequences, n // each)
        if full:
            self.put(length, full * each, first, full, left)
            self.open[left - each * length].append((first, full))
        done, first, sequences = full * each, first + full, sequences - full
        if sequences and n > done:                         # one sequence gets the last ones
            self.put(length, n - done, first, 1, left)
            self.open[left - (n - done) * length].append((first, 1))
            done, first, sequences = n, first + 1, sequences - 1
        if sequences:
            self.open[left].append((first, sequences))
        return done

    def best_fit(self, length: int, n: int) -> None:
        for left in range(length, self.capacity + 1):
            while n and self.open[left]:
                n -= self._fill(length, n, *self.open[left].pop(), left)
            if not n:
                return
        sequences = -(-n // (self.capacity // length))
        self._fill(length, n, self.new(sequences), sequences, self.capacity)


def plan_with(counts: dict[int, int], capacity: int, groups: int, small: float) -> Plan:
    """Placements of ``counts[length]`` pieces of each length (1 to ``capacity``), large above ``small * capacity``."""
    plan = Plan(capacity)
    if large := {x: n for x, n in counts.items() if n and x > small * capacity}:
        sizes: dict[int, list[tuple[int, int]]] = {}
        for g in linear_groups(large, groups):             # groups with the same largest length are one size
            sizes.setdefault(g[0][0], []).extend(g)
        pools = list(sizes.values())
        for configuration, used in configurations(list(sizes), [sum(n for _, n in p) for p in pools], capacity):
            # rounding errors of the solver never ask for more pieces than there are
            there = [sum(n for _, n in p) // int(a) for p, a in zip(pools, configuration, strict=True) if a]
            if (n := min(int(used + 1e-6), *there)) > 0:
                plan.substitute(configuration, n, pools)
    for length in sorted(counts, reverse=True):
        if n := counts[length] - plan.ranks.get(length, 0):
            plan.best_fit(length, n)
    return plan


def make_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: tuple[float, ...] = SMALL) -> Plan:
    """The plan of the fewest sequences over the thresholds ``small``."""
    bound, best = -(-sum(x * n for x, n in counts.items()) // capacity), None
    for threshold in small:
        plan = plan_with(counts, capacity, groups, threshold)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences == bound:
            break
    return best


# ---------------------------------------------------------------- operator
def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, groups: int = GROUPS, small: tuple[float, ...] = SMALL,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document's ids, then an end id; documents longer than ``capacity`` are cut into pieces of that length and a
    last one, others are whole.  Null and empty texts are one end id.  Rows that repeat an id are documents of
    their own, null ids stay null, other columns are ignored.  An empty table gives no rows.
    """
    pieces = materialize(cut_pieces(docs, tokenizer_path, capacity, id_col, text_col), "pack-pieces")
    spans = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    spans = materialize(spans.select(F.col("task").alias("s_task"), F.col("length").alias("s_length"), "n",
                                     F.coalesce(before, F.lit(0)).alias("before")), "pack-spans")
    counts = {r[0]: r[1] for r in spans.groupBy("s_length").agg(F.sum("n")).collect()}     # a row per length
    plan = make_plan(counts, capacity, groups, small)
    table = np.array(sorted(plan.placed), np.int64).reshape(-1, 6).T
    begins = np.searchsorted(table[0], np.arange(capacity + 2))                            # a length's placements

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            row = np.empty(len(length), np.int64)
            for x in np.unique(length):
                at = length == x
                row[at] = begins[x] + np.searchsorted(table[1, begins[x]:begins[x + 1]], rank[at], "right") - 1
            _, first_rank, _, first, sequences, offset = table[:, row]
            turn, sequence = np.divmod(rank - first_rank, sequences)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(first + sequence), pa.array(offset + turn * length)],
                names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = pieces.join(spans, same(F.col("task"), F.col("s_task")) & same(F.col("length"), F.col("s_length"))) \
        .select(*names, (F.col("rank") + F.col("before")).alias("rank"))
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*names).schema)
    return ranked.mapInArrow(place, f"{shape}, sequence_id bigint, offset bigint")
