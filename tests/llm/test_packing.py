"""Packing: ids against direct encoding, plans against bounds and best fit, whole results against brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetpulse.llm import packing as P

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BITS = [" ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", "\xa0", " ", "\x00", "a", "B", "é", "É", "İ", "ΑΣ", "Σ", "字", "́", "é",
        "<|endoftext|>", "!", "1", "'s", "...", "\U0001f600", ".", "don't", "ǅ", "ß", "ŉ", "x,", "Ab."]


def test_words_give_the_same_ids():
    tokenizer, words, rng = Tokenizer.from_file(WORDS), P.WordIds(WORDS, remembered=200), random.Random(4)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 14))) for _ in range(8000)]
    for at in range(0, len(texts), 100):                       # small generations: turned over many times
        ids, n = words.encode(texts[at:at + 100])
        for text, end, k in zip(texts[at:at + 100], np.cumsum(n), n):
            assert ids[end - k:end].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_of_a_column_are_looked_up_once():
    """Texts as an Arrow column, sliced, with nulls, special tokens and all kinds of white space: each different word is
    looked up once, the ids are those of the whole texts."""
    class Counting(P.WordIds):
        looked_up = 0

        def _numbers(self, parts, count, *rest):
            self.looked_up += count
            return super()._numbers(parts, count, *rest)

    rng, tokenizer, words = random.Random(9), Tokenizer.from_file(WORDS), Counting(WORDS)
    some = ["Été", "naïve,", "plain", "PLAIN.", "x", "3.14", "don't", "İi", "ﬁn!", "...", "東京", "<|endoftext|>", "a\x1cb", "$$$"]
    space = [" ", "  ", "\n", "\t \r\n", "\u00a0", "\u2003", "\x85", "\u3000"]
    texts = ["skipped", *("".join(rng.choice(space) + rng.choice(some[:11] if k % 5 else some) for _ in range(rng.randrange(60)))
                          for k in range(400)), "", None, " ", "end "]
    for kind in (pa.string(), pa.large_string()):
        ids, n = words.encode(pa.array(texts, kind).slice(1))
        for text, end, k in zip(texts[1:], np.cumsum(n), n, strict=True):
            assert ids[end - k:end].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)
    odd = sum(any(x in (t or "") for x in ("<|endoftext|>", "\x1c")) for t in texts)
    assert words.looked_up <= 2 * (len(some) + 2 + odd)                # before: every word of every text


def check_plan(plan, counts, capacity):
    """Every piece has a place of its own, and sequences are gapless from 0 and within the capacity."""
    where, ranks = {}, {x: set() for x in counts}
    for length, rank, n, first, sequences, offset in plan.placed:
        assert n % sequences == 0
        for k in range(n):
            turn, s = divmod(k, sequences)
            where.setdefault(first + s, []).append((offset + turn * length, length))
            assert rank + k not in ranks[length]
            ranks[length].add(rank + k)
    assert {x: len(r) for x, r in ranks.items()} == counts
    assert all(r == set(range(len(r))) for r in ranks.values())
    assert set(where) == set(range(plan.sequences))
    for places in where.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


LENGTHS = st.dictionaries(st.integers(1, 64), st.integers(1, 300), min_size=1, max_size=40)


@settings(max_examples=60, deadline=None)
@given(LENGTHS, st.integers(1, 30), st.sampled_from([0, 1 / 16, 1 / 4, 1 / 3, 1 / 2, 0.99]))
def test_plans_are_whole(counts, groups, small):
    check_plan(P.plan_with(counts, 64, groups, small), counts, 64)


def best_fit_only(counts, capacity):
    plan = P.Plan(capacity)
    for x in sorted(counts, reverse=True):
        plan.best_fit(x, counts[x])
    return plan.sequences


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_close_to_the_bound(seed):
    """At most one group's share above the better of the bound and plain best fit."""
    rng = np.random.default_rng(seed)
    kind = [rng.integers(1, 2049, 20_000), np.clip(rng.lognormal(6, 1, 20_000), 1, 2048), rng.choice([700, 690, 1300, 1340, 600], 20_000),
            np.clip(rng.normal(680, 40, 20_000), 1, 2048), rng.integers(500, 1100, 20_000), rng.integers(1, 40, 20_000)][seed]
    x, n = np.unique(kind.astype(int), return_counts=True)
    counts = dict(zip(x.tolist(), n.tolist(), strict=True))
    plan = P.make_plan(counts)
    check_plan(plan, counts, 2048)
    assert plan.sequences <= 1.005 * max(-(-int(kind.astype(int).sum()) // 2048), 0) or plan.sequences <= best_fit_only(counts, 2048)


def test_configurations_beat_best_fit():
    """Sizes of which three fill a sequence only in the right mix: best fit pairs the largest and loses."""
    counts = {46: 300, 34: 300, 20: 300}                       # 46 + 34 + 20 = 100
    assert P.plan_with(counts, 100, 48, 0.05).sequences == 300
    counts = {51: 60, 27: 60, 26: 60, 23: 120, 25: 120}        # 51 + 26 + 23, 27 + 25 + 25 + 23
    assert P.plan_with(counts, 100, 48, 0.05).sequences <= best_fit_only(counts, 100)


def brute_pieces(rows, capacity):
    tokenizer, out = Tokenizer.from_file(WORDS), []
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start:start + capacity]
            out.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=str)


def check_packed(got, capacity):
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packed_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = P.pack_documents(docs, WORDS).collect()
    want = brute_pieces(rows, 2048)
    assert sorted([tuple(r)[:5] for r in got], key=str) == want
    sequences = check_packed(got, 2048)
    assert sequences <= 1.01 * -(-sum(r[3] for r in want) // 2048) + 1


def test_packing_edges(spark):
    """Null and empty texts, null and repeated ids and rows, a very long text, clashing columns, several tasks, nothing."""
    rows = [(3, None), (None, "no id"), (4, ""), (3, "again 3"), (2, "word " * 5000), (5, "b b"), (5, "b b"), (None, None), (6, "x" * 30_000)]
    rows += [(k, "same text here") for k in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns(
        {c: F.lit(7) for c in ("task", "rank", "length", "piece", "start", "n", "before", "s_task")})
    got = P.pack_documents(docs, WORDS, capacity=64).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == brute_pieces(rows, 64)
    check_packed(got, 64)
    assert P.pack_documents(docs.where("false"), WORDS).count() == 0
