"""Token counts and the token store: against direct encoding, and round trips through the index."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetpulse.llm import token_count as TC
from fleetpulse.llm import token_store as TS
from fleetpulse.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
# what could upset a cut: runs of spaces, other white space, word marks, special strings, odd characters
BITS = [" ", "  ", "   ", "\n", "\r\n", "\t", "\x1c", "\x85", "\xa0", " ", "\x00", "a", "b", "é", "字", "▁", "<s>", "</s>",
        "<|endoftext|>", "!", "1", "'s", "...", "\U0001f600"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_cuts_never_change_counts():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counter = TC.PartLengths(model.encode, remembered=50)
    for text in odd_texts(6000):
        n = len(model.encode(text))
        assert counter.count(text) == n, repr(text)
        parts = TC.segments(text, 4)
        assert sum(len(model.encode(p)) for p in parts) == n, repr(text)
    assert len(counter) <= 50
    texts = [*odd_texts(3000, seed=5), None, ""]               # batches: one encoding call for all that is new
    for begin, end in TC.byte_batches([len((t or "").encode()) for t in texts], 700):
        assert counter.counts(texts[begin:end]) == [len(model.encode(t or "")) for t in texts[begin:end]]


def test_batches_are_balanced_by_bytes():
    assert list(TC.byte_batches([])) == []
    assert list(TC.byte_batches([900, 1, 2, 300, 5, 5], 10)) == [(0, 1), (1, 3), (3, 4), (4, 6)]
    assert list(TC.byte_batches([0] * 5, 10)) == [(0, 5)]


def test_parts_give_the_same_ids():
    tokenizer, pieces = Tokenizer.from_file(BYTES), TS.PieceIds(BYTES, remembered=40)
    texts = odd_texts(6000, seed=2)
    for at in range(0, len(texts), 100):                       # small generations: turned over many times
        ids, n = pieces.encode(texts[at:at + 100])
        ends = np.cumsum(n)
        for text, end, k in zip(texts[at:at + 100], ends, n):
            assert ids[end - k:end].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_runs_of_letters_and_signs_go_to_the_model():
    """Words with signs or a line end behind are put together run by run, not sent through the whole tokenizer."""
    tokenizer, pieces, rng = Tokenizer.from_file(BYTES), TS.PieceIds(BYTES, remembered=60), random.Random(4)
    for part in ("word,", "over.\nThe", "Été***", "...", "(a", "x.\n"):
        for lead in ("", " "):
            assert pieces._direct(part, lead) == tokenizer.encode(lead + part, add_special_tokens=False).ids, (lead, part)
    assert [pieces._direct(p, " ") for p in ("it's", "a1", "a\n\nb", "\na", "<|endoftext|>", "字.")] == [None] * 6
    assert pieces._direct("a" * 10_000 + "1", " ") is None                     # no backtracking
    bits = ["word", "Été", "ab", ",", ".", "...", "***", "'", "'s", "\n", "\n\n", " ", "  ", "1", "字", "<", "|", "endoftext", "_", "ª", "×"]
    for _ in range(60):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(100)]
        ids, n = pieces.encode(texts)
        for text, end, k in zip(texts, np.cumsum(n), n):
            assert ids[end - k:end].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


DOCS = [(5, "b b"), (3, None), (None, "no id"), (4, ""), (3, "again 3"), (2, "word " * 5000 + "x" * 90_000), (5, "b b"),
        (2**62, "big key"), (-1, " lead <|endoftext|> tail ")]


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2) for r in rows], "doc_id long, text string, path string, shard int, n_tokens long")


def test_token_counts_edges(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for long_bytes in (1 << 20, 1000):                         # the second cuts the long text into segments
        got = TC.count_tokens(docs_of(spark, DOCS), PIECES, limit=100, long_bytes=long_bytes).collect()
        want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 100) for i, t in DOCS]
        assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert TC.count_tokens(docs_of(spark, []), PIECES).collect() == []


def brute_store(rows):
    tokenizer, start, out = Tokenizer.from_file(BYTES), 0, []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_store_round_trip(spark):
    got = QUERIES["op2_token_store"](spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert sorted(tuple(r) for r in got) == brute_store([tuple(r) for r in rows])


def test_token_store_edges(spark):
    docs = docs_of(spark, DOCS)
    got = TS.store_tokens(docs, BYTES, shard_bytes=2000, bucket_keys=2).orderBy("start").collect()
    order = docs.orderBy(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))).select("doc_id", "text").collect()
    want = brute_store([tuple(r) for r in order])
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    assert sorted((r.doc_id, r.copy) for r in got if r.doc_id == 5) == [(5, 0), (5, 1)]
    # another order: ids that repeat stand in different shards
    docs = docs.withColumn("o", F.length(F.coalesce("text", F.lit(""))))
    got = TS.store_tokens(docs, BYTES, shard_bytes=20, order=[F.col("o")]).orderBy("start").collect()
    order = docs.orderBy("o", F.xxhash64(F.coalesce("text", F.lit("")))).select("doc_id", "text").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == brute_store([tuple(r) for r in order])
    assert sorted((r.doc_id, r.copy) for r in got if r.doc_id == 3) == [(3, 0), (3, 1)]
    assert TS.store_tokens(docs_of(spark, []), BYTES).collect() == []


def test_perfect_hash_is_minimal_and_fingerprinted():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 20_000):
        high, low = (rng.integers(0, 1 << 63, n, np.uint64) for _ in range(2))
        table = TS.PerfectHash.build(high, low)
        assert sorted(table.slots(high, low).tolist()) == list(range(n))
        index = TS.BucketIndex(TS.pack_index(high, low, np.arange(n), np.arange(n) * 7, np.arange(n) + 1))
        found, place = index.find(high, low)
        assert found.all() and place["offset"].tolist() == [7 * k for k in range(n)]
        other = rng.integers(0, 1 << 63, 20_000, np.uint64)
        assert index.find(other, other)[0].mean() < 1e-3       # strangers: only by an equal fingerprint
    with pytest.raises(ValueError):
        TS.PerfectHash.build(np.array([5, 5], np.uint64), np.array([6, 6], np.uint64))


def test_keys_that_are_not_stored_give_no_row(spark):
    docs = docs_of(spark, DOCS)
    root = TS.scratch_path(spark, "token-test")
    entries = TS.write_shards(docs, root, BYTES)
    index = TS.write_index(entries, root, 4)
    asked = spark.createDataFrame([(2, 0), (3, 0), (3, 1), (3, 2), (77, 0)], "doc_id long, copy int")
    assert sorted((r.doc_id, r.copy) for r in TS.look_up(asked, index, 4).collect()) == [(2, 0), (3, 0), (3, 1)]


@pytest.mark.parametrize("text, one_id", [("", False), ("b b", True), (None, True)])
def test_many_alike_rows_fill_several_shards(spark, text, one_id):
    """Empty texts, and one id (or none) repeated: dealt over shards, every row with a place and a copy number of its own."""
    n, each = 20_000, 1 if not text else 3
    docs = spark.range(n).select(
        (F.lit(None).cast("long") if one_id and text is None else F.lit(7) if one_id else F.col("id")).alias("doc_id"),
        F.lit(text).cast("string").alias("text")).repartition(4)
    got = TS.store_tokens(docs, BYTES, shard_bytes=200_000)
    assert got.select("shard").distinct().count() > 4
    assert got.groupBy("shard").count().agg(F.max("count")).first()[0] < n / 3
    rows = sorted((r.start, r.n_tokens, r.copy) for r in got.collect())
    assert [r[0] for r in rows] == [each * k for k in range(n)] and {r[1] for r in rows} == {each}
    assert sorted(r[2] for r in rows) == (list(range(n)) if one_id else [0] * n)
