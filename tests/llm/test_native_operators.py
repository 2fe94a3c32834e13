"""Exact dedup, decontamination, license scan and mixing: DuckDB twins, brute force, edge cases."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.llm import decontaminate, dedup_exact, licenses, mixing
from fleetpulse.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# extra columns whose names operators use themselves
DOCS = "doc_id long, text string, source string, norm string, w string, start int, score string, cls string, n int, c int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "src0", "x", "y", 1, "z", "q", 2, 3) for r in rows], DOCS)


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, name):
    import duckdb

    from tools.oracle_check import TABLES, compare
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert compare(spark, con, SF, name, QUERIES[name], ORACLE[name])[1] == "ok"


# ---------------------------------------------------------------- exact dedup
ROWS = [(1, "Same Text"), (2, "same text"), (3, None), (4, ""), (5, "ÉCOLE"), (6, "école"), (7, "x" * 200_000),
        (9, "X" * 200_000), (8, "same text "), (2, "same text"), (None, "same TEXT"), (None, "alone")]


def test_exact_dedup_edges(spark):
    got = [tuple(r) for r in dedup_exact.exact_dedup(docs_of(spark, ROWS), salts=3).collect()]
    groups = collections.defaultdict(list)
    for i, t in ROWS:
        groups[(t or "").translate(LOWER)].append(i)
    want = []
    for i, t in ROWS:
        norm = (t or "").translate(LOWER)
        keep = max((x for x in groups[norm] if x is not None), default=None)
        want.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = dedup_exact.keep_distinct(docs_of(spark, ROWS))
    assert len(kept.columns) == 10 and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 2, 4, 5, 6, 8, 9]


@pytest.mark.parametrize("digest", [lambda norm: F.lit("d"), lambda norm: F.length(norm).cast("string")])
def test_exact_dedup_compares_texts_of_a_shared_digest(spark, digest):
    rows = [*ROWS, (20, "abcd"), (21, "abce"), (22, "ABCD")]
    got = dedup_exact.exact_dedup(docs_of(spark, rows), salts=3, digest=digest).collect()
    want = dedup_exact.exact_dedup(docs_of(spark, rows), salts=3).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_exact_dedup_empty(spark):
    assert dedup_exact.exact_dedup(docs_of(spark, [])).collect() == []


# ---------------------------------------------------------------- decontamination
def brute_hits(docs, items, window=10):
    wins = collections.defaultdict(set)
    for i, t in items:
        w = item_words(t)
        for s in range(max(len(w) - window, 0) + 1) if w else []:
            wins[tuple(w[s:s + window])].add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = item_words(t), set(), set()
        for k, owners in wins.items():
            for s in range(len(w) - len(k) + 1):
                if tuple(w[s:s + len(k)]) == k:
                    hit |= set(range(s, s + len(k)))
                    found |= owners
        out.append((i, len(w), len(hit), sorted(found), bool(hit)))
    return out


def test_decontamination_edges(spark):
    long = " ".join(f"w{k}" for k in range(14))
    items = [(1, long), (2, "Two words"), (3, None), (4, "...!"), (5, "the the the the"), (6, "one"), (7, long), (2, "two, words!")]
    docs = [(1, None), (2, ""), (3, long.upper()), (4, "a " + long + " " + long), (5, "two-words two words TWO"),
            (6, "the " * 9), (7, " ".join(f"w{k}" for k in range(3, 12))), (8, " ".join(f"w{k}" for k in range(3, 13))),
            (9, "One"), (9, "one"), (9, "none"), (None, "x one y"), (10, "ONÉ"), (11, "z " * 30_000 + long + " one")]
    bench = spark.createDataFrame([(*i, "n", 3, "z") for i in items], "item_id long, text string, wid string, size int, h string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated)
           for r in decontaminate.decontaminate(docs_of(spark, docs), bench).collect()]
    assert sorted(got, key=str) == sorted(brute_hits(docs, items), key=str)
    clean = decontaminate.drop_contaminated(docs_of(spark, docs), bench)
    assert len(clean.columns) == 10
    want = [i for i, (_, _, _, _, bad) in zip([d[0] for d in docs], brute_hits(docs, items)) if not bad]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(want)


def test_decontamination_null_item_ids(spark):
    bench = spark.createDataFrame([(None, "only here"), (None, "both there"), (4, "both there")], "item_id long, text string")
    docs = docs_of(spark, [(1, "x only here y"), (2, "both there"), (3, "neither")])
    got = decontaminate.decontaminate(docs, bench).orderBy("doc_id").collect()
    assert [(r.n_hit, r.item_ids, r.contaminated) for r in got] == [(2, [], True), (2, ["4"], True), (0, [], False)]
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()] == [3]


def test_decontamination_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = docs_of(spark, [(1, "a b"), (2, None)])
    assert [(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in decontaminate.decontaminate(docs, none).orderBy("doc_id")
            .collect()] == [(1, 2, 0, False), (2, 0, 0, False)]
    assert decontaminate.decontaminate(docs_of(spark, []), none).collect() == []


# ---------------------------------------------------------------- licenses
def test_license_edges(spark):
    docs = [(1, None), (2, ""), (3, "CC-BY cc by cc by-nc"), (4, "General Public\nLicense"), (5, "All rights reserved. all Rights"),
            (6, "public license general"), (7, "Released under the MIT License."), (8, "the mit license"), (9, "cc"),
            (9, "by cc"), (None, "x " * 50_000 + "CC BY"), (10, "all rights réserved")]
    found = licenses.license_digest(licenses.scan_licenses(docs_of(spark, docs)))
    got = {(r.doc_id, r.n_words): r for r in found.collect()}
    assert len(got) == len(docs)
    base = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    for i, t in docs:
        w = item_words(t)
        if not w:
            continue
        places = [(s, label) for p, label in base.items() for s in range(len(w))
                  if w[s:s + len(p.split())] == p.split()]
        r = got[(i, len(w))]
        assert r.n_base == len(places)
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert got[(7, 5)].labels == "mit" and got[(7, 5)].score == 1.0
    assert got[(8, 3)].labels == "mit" and 0 < got[(8, 3)].score < 1
    assert got[(3, 7)].labels == "cc-by,cc-by-nc"
    assert licenses.scan_licenses(docs_of(spark, [])).collect() == []


def brute_places(words, templates):
    return sorted((t.label, s) for t in templates for s in range(len(words))
                  if words[s:s + len(t.key_words)] == list(t.key_words))


def test_license_postings_are_intersected_by_position(spark):
    rng = random.Random(7)
    notices = {t.label: t.words for t in licenses.TEMPLATES if len(t.words) > 60}
    assert {"mit", "bsd", "isc", "zlib"} <= set(notices)
    vocab = sorted({w for t in licenses.TEMPLATES for w in t.key_words})
    docs = [(k, " ".join(rng.choice(vocab) for _ in range(300))) for k in range(40)]        # rare words out of order
    for k, t in enumerate(licenses.TEMPLATES):
        words = list(t.key_words)
        docs += [(100 + k, " ".join(words)), (200 + k, " ".join(words[:-1])), (300 + k, " ".join(words[::-1])),
                 (400 + k, " ".join([*words, *words, "x", *words]))]
    docs += [(500 + k, "start " + " ".join(w) + " end") for k, w in enumerate(notices.values())]
    assert all(len(a) == min(licenses.ANCHORS, len(t.key_words)) for t, a in zip(
        licenses.TEMPLATES, licenses.anchors(licenses.TEMPLATES, collections.defaultdict(float)), strict=True))
    got = {r.doc_id: r for r in licenses.scan_licenses(docs_of(spark, docs)).collect()}
    for i, t in docs:
        assert sorted((p.label, p.start) for p in got[i].places) == brute_places(t.split(), licenses.TEMPLATES), i
    for k, label in enumerate(notices):
        assert got[500 + k].score == 1.0 and label in {p.label for p in got[500 + k].places}


# ---------------------------------------------------------------- mixing
def brute_cycle(quota):
    """Earliest deadline first, slot by slot."""
    length, done, order = sum(quota.values()), dict.fromkeys(quota, 0), []
    for t in range(length):
        ready = [(math.ceil((done[c] + 1) * length / q), c) for c, q in quota.items()
                 if done[c] < q and math.floor(done[c] * length / q) <= t]
        _, c = min(ready)
        done[c] += 1
        order.append(c)
    return order


def test_mix_follows_pfair_schedule(spark):
    sizes = {"a": 400, "b": 90, "c": 31, None: 40, "other": 10}
    rows = [(k, s) for k, s in enumerate(x for x, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame([(k, s, "m") for k, s in rows], "doc_id long, source string, mix string")
    weights, block = {"a": 3.0, "b": 2.0, "c": 1.0}, 4
    got = mixing.mix(docs.drop("mix"), weights, rest_weight=2.0, block_docs=block, cycle=16).select("doc_id", "source", "mix.*").collect()
    assert sorted(r.position for r in got) == list(range(len(rows)))
    names = ["a", "b", "c", mixing.REST]
    counts = {0: 400, 1: 90, 2: 31, 3: 50}
    runs = mixing.phases({c: -(-n // block) for c, n in counts.items()}, dict(enumerate([3.0, 2.0, 1.0, 2.0])), 16)
    want = [c for r in runs for _ in range(r["cycles"]) for c in brute_cycle(r["quota"])]
    by_slot = {r.slot: names.index(r.component) for r in got}
    assert [by_slot[t] for t in range(len(want))] == want
    for r in got:
        assert r.release <= r.slot < r.deadline
    # less than one block from the target in every slot of every cycle
    for r in runs:
        order, length = brute_cycle(r["quota"]), r["length"]
        for c, q in r["quota"].items():
            for t in range(1, length + 1):
                assert abs(order[:t].count(c) - t * q / length) < 1
    # blocks are whole and in rank order: md5 of the id inside each component
    first = [r.doc_id for r in sorted(got, key=lambda r: r.position) if r.component == "b"]
    assert first == sorted(first, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())


@pytest.mark.parametrize("weights, blocks", [
    ({c: 4.0 if c % 4 == 0 else 2.0 if c % 2 == 0 else 1.0 for c in range(21)}, 76_000),
    ({0: 1000.0, 1: 1.0, 2: 1 / 3}, 20_000), ({0: 0.7, 1: 0.2, 2: 0.1, 3: 0.0005}, 30_000)])
def test_mix_keeps_true_weights_over_many_cycles(weights, blocks):
    total = sum(weights.values())
    left = {c: max(1, round(blocks * w / total * (1 + c % 3))) for c, w in weights.items()}
    want = dict(left)
    for r in mixing.phases(left, weights):
        if {c for c, n in want.items() if n} != (active := {c for c in left if r["first"][c] < left[c]}):
            raise AssertionError("a component is lost")
        if r["start"] == 0 or active != before:                         # a new phase: counted anew
            before, slots, dealt, whole = active, 0, dict.fromkeys(active, 0), sum(weights[c] for c in active)
        for _ in range(r["cycles"]):
            for c in (x[0] for x in r["order"]):
                slots, want[c] = slots + 1, want[c] - 1
                dealt[c] += 1
                assert abs(dealt[c] - slots * weights[c] / whole) < 1 + 1e-6
            assert all(abs(dealt[c] - slots * weights[c] / whole) < 1 + 1e-6 for c in active)
    assert not any(want.values())


def test_mix_of_weights_that_do_not_divide_a_cycle(spark):
    weights = {"a": 4.0, "b": 2.0, "c": 1.0, "d": 1.0, "e": 0.3}        # 83 slots, not 256
    sizes = {"a": 4800, "b": 2400, "c": 1200, "d": 1200, "e": 360}
    docs = spark.createDataFrame([(k, s) for k, s in enumerate(x for x, n in sizes.items() for _ in range(n))],
                                 "doc_id long, source string")
    got = mixing.mix(docs, weights, block_docs=1).select("source", "mix.*").orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(docs.collect())))
    dealt = dict.fromkeys(weights, 0)
    for t, r in enumerate(got, 1):
        assert r.release <= r.slot < r.deadline
        dealt[r.source] += 1
        assert all(abs(n - t * weights[c] / 8.3) < 1 for c, n in dealt.items())


def test_mix_edges(spark):
    docs = docs_of(spark, [(None, "t"), (1, "a"), (1, "a"), (2, None)])
    own = mixing.mix(docs.withColumn("Mix", F.lit(1)), {"src0": 1.0})
    assert own.columns == [*docs.columns, "Mix", "_mix"] and {r.Mix for r in own.collect()} == {1}
    assert sorted(r._mix.position for r in own.collect()) == [0, 1, 2, 3]
    out = mixing.mixed_order(docs.withColumn("mix", F.lit(1)), {"src0": 1.0})
    assert out.columns == [*docs.columns, "mix"] and out.count() == 4
    assert sorted(r.mix.position for r in mixing.mix(docs, {}).collect()) == [0, 1, 2, 3]
    assert mixing.mix(docs_of(spark, []), {"src0": 1.0}).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(docs, {"src0": 0.0})


def test_mix_query_keeps_every_document(spark):
    got = QUERIES["op5_mixing"](spark, SF).collect()
    assert sorted(r.position for r in got) == list(range(spark.read.parquet(f"{SF}/documents.parquet").count()))
    assert isinstance(QUERIES["op5_mixing"](spark, SF).schema["position"].dataType, T.LongType)
