"""Near-duplicate components against brute force, with the plain and the large-node paths."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from fleetpulse.llm import near_dup as N

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, percent):
    sets, part = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    old, new = part[a], part[b]
                    part = [new if p == old else p for p in part]
    least = {}
    for p, (i, _) in zip(part, rows):
        if i is not None:
            least[p] = min(least.get(p, i), i)
    return sorted(((i, len(s), least.get(p), i == least.get(p)) for p, s, (i, _) in zip(part, sets, rows)), key=str)


def family(rng, base, size, edits):
    out = []
    for _ in range(size):
        words = base[:]
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(300)}"
    common = [word() for _ in range(25)]                              # a passage that most documents share
    texts = []
    for _ in range(30):
        texts.append(" ".join(common + [word() for _ in range(rng.randint(5, 60))]))
    for size, edits in ((60, 5), (12, 3), (8, 8), (5, 2), (3, 1)):
        texts += family(rng, common[:10] + [word() for _ in range(rng.randint(60, 160))], size, edits)
    texts += ["", None, "   ", "a b", "A  b", "a b c d e", "a b c d e f", "É b c", "é b c", texts[0].upper(), texts[0]]
    rng.shuffle(texts)
    ids = rng.sample(range(10_000), len(texts))
    return [*zip(ids, texts), (None, texts[-1]), (ids[0], texts[0]), (None, "nobody else")]


def run(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "n", b"m", 3) for r in rows],
                                 "doc_id long, text string, cls string, mins binary, node int")
    got = N.near_duplicates(docs, **options)
    return sorted((tuple(r) for r in got.drop("text_hash").collect()), key=str)


@pytest.mark.parametrize("percent, options", [(85, {}), (85, {"leaf": 2}), (70, {"leaf": 4, "depth": 2, "trees": 16})])
def test_components_match_brute_force(spark, percent, options):
    rows = corpus(percent)
    got = [(i, n, c, k) for i, n, c, k in run(spark, rows, percent=percent, **options)]
    want = [(i, n, i if not n else c, True if not n else k) for i, n, c, k in brute(rows, percent)]
    # a component of null ids only has a null id, and its rows stay
    want = [(i, n, c, True if c is None and i is None else k) for i, n, c, k in want]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_pairs_in_deep_nodes_meet(spark):
    # 1,600 classes share 75 % of their tokens; 800 pairs share 80 %, so nodes of more than 16 go to the last level
    rng = np.random.default_rng(5)
    passage, mins = rng.integers(0, 1 << 32, N.K), []
    for _ in range(800):
        own = rng.permutation(N.K)[:13]                        # 51 of 64 tokens in common
        a, b = passage.copy(), passage.copy()
        a[own], b[own] = rng.integers(0, 1 << 32, 13), rng.integers(0, 1 << 32, 13)
        both = rng.choice(np.setdiff1d(np.arange(N.K), own), 3, replace=False)
        a[both] = b[both] = rng.integers(0, 1 << 32, 3)
        mins += [a, b]
    # sketches of which none are alike, so that no node ends through a pivot
    classes = spark.createDataFrame([(k.to_bytes(4, "big"), m.astype(np.uint32).tobytes(), 100, rng.bytes(N.K)) for k, m in enumerate(mins)],
                                    "cls binary, mins binary, n long, sketch binary")
    nodes = defaultdict(set)
    for r in N.tree_nodes(classes, leaf=16).collect():
        nodes[int.from_bytes(r.cls, "big")].add(r.node)
    assert [k for k in range(0, len(mins), 2) if not nodes[k] & nodes[k + 1]] == []


def test_near_copies_end_through_a_pivot(spark):
    """3,000 near copies of one text beside 300 documents that share less: their nodes end at the first levels, in the
    first trees, with all members in them."""
    rng = np.random.default_rng(6)
    text, mins = rng.integers(0, 1 << 32, N.K), []
    for k in range(3300):
        own = rng.permutation(N.K)[:4 if k < 3000 else 30]
        m = text.copy()
        m[own] = rng.integers(0, 1 << 32, len(own))
        mins.append(m.astype(np.uint32))
    rows = [(k.to_bytes(4, "big"), m.tobytes(), 100, m.astype(np.uint8).tobytes()) for k, m in enumerate(mins)]
    classes = spark.createDataFrame(rows, "cls binary, mins binary, n long, sketch binary")
    ended = N.tree_nodes(classes, percent=85).groupBy("node").count().collect()
    assert sum(r["count"] > 2000 for r in ended) == N.TREES                   # a node per tree, at the first level
    assert sum(r["count"] for r in ended) <= N.TREES * len(mins)
    spread = defaultdict(set)
    for r in N.tree_nodes(classes, percent=85).collect():
        spread[int.from_bytes(r.cls, "big")].add(r.node)
    assert [k for k in range(1, 3000) if not spread[0] & spread[k]] == []


def test_members_of_large_nodes_are_judged_once(spark):
    """800 near copies of one text and 300 documents that share half of it, leaves of 64: the nodes with up to four leaves
    of unlike members end at the first level, and their members come with the size and pivot of the node."""
    rng = np.random.default_rng(8)
    text, mins = rng.integers(0, 1 << 32, N.K), []
    for k in range(1100):
        own = rng.permutation(N.K)[:3 if k < 800 else 32]
        m = text.copy()
        m[own] = rng.integers(0, 1 << 32, len(own))
        mins.append(m.astype(np.uint32))
    rows = [(k.to_bytes(4, "big"), m.tobytes(), 100, m.astype(np.uint8).tobytes()) for k, m in enumerate(mins)]
    classes = spark.createDataFrame(rows, "cls binary, mins binary, n long, sketch binary")
    nodes = defaultdict(list)
    for r in N.tree_nodes(classes, leaf=64, percent=85).collect():
        nodes[r.node].append(r)
    large = [rs for rs in nodes.values() if len(rs) > 64]
    assert len(large) == N.TREES and all(len(rs) > 700 for rs in large)       # before: branched, as 64 and more are unlike
    load, linked = N._by_tokens(85)
    for rs in large:
        assert {r.size for r in rs} == {len(rs)} and {r.pivot for r in rs} <= {r.cls for r in rs}
        at = next(k for k, r in enumerate(rs) if r.cls == r.pivot)
        want = linked(load(np.array([r.n for r in rs]), [bytes(r.sketch) for r in rs]), at, np.arange(len(rs)))
        assert [r.near for r in rs] == want.tolist() and 64 < (~want).sum() <= 4 * 64
    assert all(r.size is None and r.near is None for rs in nodes.values() if len(rs) <= 64 for r in rs)


def test_nodes_carry_what_comparing_needs(spark):
    """Members of nodes come with their size and sketch, so nothing is joined to them by class again."""
    rng = np.random.default_rng(7)
    text = rng.integers(0, 1 << 32, N.K)
    rows = []
    for k in range(60):
        m = text.copy()
        m[rng.permutation(N.K)[:20]] = rng.integers(0, 1 << 32, 20)
        rows.append((k.to_bytes(4, "big"), m.astype(np.uint32).tobytes(), 100 + k, m.astype(np.uint8).tobytes()))
    classes = spark.createDataFrame(rows, "cls binary, mins binary, n long, sketch binary")
    got = N.tree_nodes(classes, leaf=4, percent=85).collect()
    assert got and {(bytes(r.cls), r.n, bytes(r.sketch)) for r in got} <= {(c, n, s) for c, _, n, s in rows}


def test_links_of_a_large_node_do_not_grow_with_its_blocks(spark):
    """40 alike members and 12 unlike ones, in two nodes, with blocks of 2: a link for each member, not for each block."""
    sets = [np.arange(100, dtype=np.uint64)] * 40 + [np.arange(1000 * k, 1000 * k + 100, dtype=np.uint64) for k in range(1, 13)]
    rows = [(node, bytes([k]), 100, s.tobytes()) for node in (1, 2) for k, s in enumerate(sets)]
    rows.append((1, bytes([99]), 100, np.arange(1005, 1105, dtype=np.uint64).tobytes()))       # like one of the unlike
    rows.append((2, bytes([98]), 92, np.arange(92, dtype=np.uint64).tobytes()))                # like the pivot
    members = spark.createDataFrame(rows, "node long, cls binary, n long, payload binary")
    links = N.spanning_links(members, members.select("node", "cls"), N._by_sets(85), leaf=2).collect()
    assert len(links) <= len(rows)
    assert {frozenset((bytes(r.a), bytes(r.b))) for r in links} == {
        *(frozenset((b"\0", bytes([k]))) for k in (*range(1, 40), 98)), frozenset((bytes([40]), bytes([99])))}


def test_documents_that_share_a_passage_end_in_the_first_trees(spark):
    """3,000 documents of which none are alike share their first 12 tokens: the nodes of these end at the first level, in
    blocks, and no class grows in further trees (before: more than 1,024 unlike members branched to the last level)."""
    rng = np.random.default_rng(9)
    passage, rows = rng.integers(0, 1 << 32, N.K), []
    for k in range(3000):
        m = rng.integers(0, 1 << 32, N.K)
        m[::N.K // 5] = passage[::N.K // 5]
        m[rng.permutation(N.K)[:32]] = passage[0]
        m[0] = passage[0]
        rows.append((k.to_bytes(4, "big"), m.astype(np.uint32).tobytes(), 100, rng.bytes(N.K)))
    classes = spark.createDataFrame(rows, "cls binary, mins binary, n long, sketch binary")
    ended = N.tree_nodes(classes, percent=85).groupBy("node").count().collect()
    assert sum(r["count"] > 1024 for r in ended) >= N.TREES - 2
    assert sum(r["count"] for r in ended) <= N.TREES * len(rows)


@pytest.mark.parametrize("indexed", [N.INDEXED, 10])
def test_sets_of_a_group_are_compared_at_once(indexed, monkeypatch):
    """The numbered sets of a group and its pairs give the same, whatever was compared before."""
    monkeypatch.setattr(N, "INDEXED", indexed)
    rng = random.Random(11)
    sets = [frozenset(rng.sample(range(20), rng.randint(1, 20))) for _ in range(60)]
    load, linked = N._by_sets(50)
    data = load(np.array([len(s) for s in sets]), [np.array(sorted(s), np.uint64).tobytes() for s in sets])
    for i in [*range(60), 3, 0]:
        others = np.array(rng.sample(range(60), rng.randint(1, 60)))
        want = [100 * len(sets[i] & sets[k]) >= 50 * len(sets[i] | sets[k]) for k in others]
        assert linked(data, i, others).tolist() == want


def test_alike_by_tokens_counts_equal_bytes():
    rng = np.random.default_rng(12)
    rows = rng.integers(0, 3, (200, N.K)).astype(np.uint8)
    rows[:, :30] = 1
    n = rng.integers(60, 140, 200)
    load, linked = N._by_tokens(85)
    data = load(n, [r.tobytes() for r in rows])
    want = ((rows == rows[7]).mean(axis=1) >= N._least_share(85)) & (np.minimum(n, n[7]) * 100 >= 85 * np.maximum(n, n[7]))
    assert linked(data, 7, np.arange(200)).tolist() == want.tolist() and 0 < want.sum() < 200


def test_links_that_are_stars_need_no_round(spark, monkeypatch):
    """Links of stars are written twice, as links and as nodes (before: another round of joins told that nothing changes);
    repeated links and both directions are the same link."""
    written, write = [], N.materialize
    monkeypatch.setattr(N, "materialize", lambda df, name="stage": written.append(name) or write(df, name))
    links = [(b"a", b"b"), (b"c", b"a"), (b"a", b"c"), (b"d", b"e"), (b"a", b"b"), (b"f", b"f")]
    got = N.components(spark.createDataFrame(links, "a binary, b binary")).collect()
    assert sorted((bytes(r.member), bytes(r.root)) for r in got) == [(b"a", b"a"), (b"b", b"a"), (b"c", b"a"), (b"d", b"d"), (b"e", b"d")]
    plan = N.components(spark.createDataFrame(links, "a binary, b binary"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan                                             # the nodes are read as written
    assert len(written) == 4


@pytest.mark.parametrize("limit", [N.BROADCAST_CLASSES, 0])
def test_components_of_random_links(spark, monkeypatch, limit):
    """Against brute force, with names of classes sent along and dealt by class."""
    monkeypatch.setattr(N, "BROADCAST_CLASSES", limit)
    rng = random.Random(13)
    links, part = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)], {}
    for a, b in links:
        one, two = part.setdefault(a, {a}), part.setdefault(b, {b})
        if one is not two:
            one |= two
            part.update(dict.fromkeys(two, one))
    want = {k: min(p) for k, p in part.items() if len(p) > 1}
    got = {r.member: r.root for r in N.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want


def test_large_clusters_without_broadcasts(spark, monkeypatch):
    rows = corpus(3)
    want = run(spark, rows, percent=85, leaf=2)
    for name in ("BROADCAST_ROWS", "BROADCAST_CLASSES", "BROADCAST_BYTES"):
        monkeypatch.setattr(N, name, -1)
    assert run(spark, rows, percent=85, leaf=2) == want


def test_trees_needed_keeps_the_target():
    assert N.trees_needed(85, 2) <= N.TREES and N.trees_needed(80, 2) <= N.TREES
    for percent, level in ((85, 4), (80, 8)):
        rng, t = np.random.default_rng(level), N.trees_needed(percent, level)
        m = rng.binomial(N.K, percent / 100, 1_000_000)
        assert ((1 - (m / N.K) ** level) ** t).mean() <= 1.3 * N.MISS
        assert ((1 - (m / N.K) ** level) ** N.TREES).mean() > 5 * N.MISS


def test_keep_one_keeps_columns_and_one_of_each(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, "other words here"), (2, "own text of a repeated id"), (4, None)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, gone_id string")
    kept = N.keep_one(docs, 80)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.where("text is not null").collect()) == [
        (1, "a b c d e f"), (2, "own text of a repeated id"), (3, "other words here")]
    assert kept.where("text is null").count() == 1


def test_empty_and_single(spark):
    assert run(spark, []) == []
    assert run(spark, [(7, "x")]) == [(7, 1, 7, True)]


def test_components_of_a_long_chain(spark):
    chain = [(bytes([k // 256, k % 256]), bytes([(k + 1) // 256, (k + 1) % 256])) for k in range(300)]
    links = spark.createDataFrame([*chain, (b"\xff\x01", b"\xff\x00")], "a binary, b binary")
    got = {bytes(r.member): bytes(r.root) for r in N.components(links).collect()}
    assert len(got) == 303 and {got[b] for _, b in chain} == {b"\x00\x00"} and got[b"\xff\x01"] == b"\xff\x00"
