"""The pipeline's stages against brute force, each on its own input."""

import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from fleetpulse.llm.queries import MIX_WEIGHTS
from tests.llm.test_native_operators import brute_hits
from tests.llm.test_near_dup import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, stage) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()))


def test_stages_are_as_dealt(steps, spark):
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "token_output"]
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(d.columns == columns for d in steps[:-1])


def test_language_stage_keeps_documents_with_letters(steps, spark):
    before, after = rows_of(spark.read.parquet(f"{SF}/documents.parquet")), rows_of(steps[0])
    assert after == [r for r in before if any(c.isalpha() for c in r[1] or "")]


def test_near_dedup_stage_keeps_one_of_each_group(steps):
    verdict = brute(rows_of(steps[0]), P.NEAR_PERCENT)
    assert [i for i, _ in rows_of(steps[1])] == sorted(i for i, _, _, kept in verdict if kept)


def test_decontamination_stage_drops_exactly_the_hit_documents(steps, spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = sorted(i for i, _, _, _, bad in brute_hits(rows_of(steps[1]), items) if not bad)
    assert [i for i, _ in rows_of(steps[2])] == clean


def test_mixing_stage_orders_and_keeps_all(steps):
    assert rows_of(steps[3]) == rows_of(steps[2])
    # the last stage's starts show the order: blocks of one component, interleaved by weight
    order = [r.doc_id for r in steps[4].orderBy("start").collect()]
    source = {r.doc_id: r.source for r in steps[3].collect()}
    assert order != sorted(order) and len(set(order)) == len(order)
    component = [source[i] if source[i] in MIX_WEIGHTS else "rest" for i in order]
    runs = 1 + sum(a != b for a, b in zip(component, component[1:]))
    sizes = {c: component.count(c) for c in set(component)}
    assert runs <= sum(math.ceil(n / 64) for n in sizes.values())


def test_token_stage_encodes_in_that_order(steps):
    tokenizer, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    text = dict(rows_of(steps[3]))
    for r in steps[4].orderBy("start").collect():
        ids = [*tokenizer.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_run_gives_the_stages_result(steps, spark):
    assert sorted(map(tuple, P.run(spark, SF).collect())) == sorted(map(tuple, steps[4].collect()))
