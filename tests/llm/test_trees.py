"""Merkle manifest and prefix trie: brute force on odd fixtures, hand-made chunks, edge cases.  The DuckDB twins run with the others."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetpulse.llm import merkle, midstate, prefix_trie

# extra columns whose names the operators use themselves
EXTRA = ", tree string, digest string, at string, size int, slice int, row int, level int, n int, n_chars_ int"
ROW = ("t", "d", "a", 1, 2, 3, 4, 5, 6)


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- SHA-256 states
def test_states_are_sha256():
    rng = np.random.default_rng(1)
    messages = [rng.integers(0, 256, 192, np.uint8).tobytes() for _ in range(50)]
    words = np.stack([np.frombuffer(m, ">u4").astype(np.uint32) for m in messages], axis=1)
    state = midstate.start(50)
    for k in range(3):
        state = midstate.unpack(midstate.pack(midstate.absorb(state, words[16 * k:16 * k + 16])))   # stored and resumed
        packed = midstate.pack(midstate.finish(state, np.full(50, k + 1)))
        want = b"".join(hashlib.sha256(m[:64 * (k + 1)]).digest() for m in messages)
        assert packed == want
    text = midstate.hex_block(midstate.unpack(packed)).T.astype(">u4").tobytes().decode()
    assert text == packed.hex()


# ---------------------------------------------------------------- Merkle manifest
def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(r, text):
    return H("".join(map(field, (r[0], r[1], r[2], r[3], text))))


def levels_of(nodes):
    levels = []
    while len(nodes) > 1:
        levels.append(nodes)
        nodes = [H("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]
    return levels, nodes[0]


def climb(levels, i, value):
    siblings = []
    for nodes in levels:
        run = range(i // 3 * 3, min(i // 3 * 3 + 3, len(nodes)))
        siblings += [nodes[j] for j in run if j != i]
        value = H("".join(value if j == i else nodes[j] for j in run))
        i //= 3
    return siblings, value


def brute_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    top, root = levels_of([trees[s][1] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            changed = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            low, v = climb(trees[s][0], i, leaf(r, r[4].replace("\n", "")) if changed else own)
            high, v = climb(top, k, v)
            out.append((r[0], own, trees[s][1], root, H("".join(low + high)), v, v == root))
    return sorted(out, key=str)


def manifest_of(spark, rows, **options):
    shape = "doc_id long, source string, lang string, n_chars long, text string" + EXTRA
    got = merkle.verify_tampered(spark.createDataFrame([(*r, *ROW) for r in rows], shape), **options)
    return sorted(map(tuple, got.collect()), key=str)


def test_manifest_of_odd_rows(spark):
    texts = ["a\nb", "", None, "\n", "línea\n" * 3000, "x\n\ny", "no feed"]
    rows = [(k, s, None if k % 5 == 0 else "en", None if k % 7 == 0 else k, texts[k % len(texts)])
            for s, ks in (("a", range(40)), (None, range(40, 53)), ("", [60]), ("é", [70, 71]), ("=", [80]), ("z", range(90, 94))) for k in ks]
    rows += [(7, "a", "en", 7, "again 7\n"), (7, "a", "en", 7, "again 7\n"), (None, "a", None, None, "null id\n"), (None, None, None, None, None)]
    got = manifest_of(spark, rows, slice_rows=9)
    assert got == brute_manifest(rows)
    assert {x[-1] for x in got} == {True, False}


def test_manifest_with_several_rounds(spark, monkeypatch):
    """Chunks of nine nodes: trees of up to three rounds, a tree of sources of two."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "CHUNK", 9)
    rng = random.Random(3)
    sizes = [rng.choice([1, 2, 3, 8, 9, 10, 27, 28]) for _ in range(14)] + [81, 82, 100]
    rows = [(1000 * s + k, f"s{s}", "en", k, f"{k}\n{s}") for s, n in enumerate(sizes) for k in range(n)]
    assert merkle.height(82) == 5
    assert manifest_of_local(rows) == brute_manifest(rows)


def manifest_of_local(rows):
    """The operator's chunk functions over Python lists: what the Spark jobs do, round by round."""
    def forest(trees):
        """The rounds of each tree: chunk number -> (n, levels, stored bytes, top)."""
        out = {}
        for t, digests in trees.items():
            rounds, nodes = [], digests
            while not rounds or len(digests) > merkle.FAN ** (merkle.LEVELS * len(rounds)):
                chunks = []
                for at in range(0, len(nodes), merkle.CHUNK):
                    part = midstate.unpack(b"".join(nodes[at:at + merkle.CHUNK]))
                    levels = min(merkle.LEVELS, merkle.height(len(digests)) - merkle.LEVELS * len(rounds))
                    below, before, top = merkle.grow(part, levels)
                    chunks.append((part.shape[1], levels, *merkle.store(below, before), midstate.pack(top)))
                rounds.append(chunks)
                nodes = [c[-1] for c in chunks]
            out[t] = rounds
        return out

    def path(rounds, i, above):
        """The path of the node at place ``i`` of the first round's input."""
        for chunks in rounds:
            n, levels, nodes, states, _ = chunks[i // merkle.CHUNK]
            above = above + merkle.steps_of(*merkle.load(n, levels, nodes, states), i % merkle.CHUNK)
            i //= merkle.CHUNK
        return above

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by)
    digests = {s: [bytes.fromhex(leaf(r, r[4])) for r in sorted(by[s])] for s in names}
    low = forest(digests)
    high = forest({"": [low[s][-1][0][-1] for s in names]})[""]
    root, out = high[-1][0][-1].hex(), []
    for k, s in enumerate(names):
        for i, r in enumerate(sorted(by[s])):
            changed = zlib.crc32(str(r[0]).encode()) % 2 == 0
            value = leaf(r, r[4].replace("\n", "")) if changed else leaf(r, r[4])
            whole = path(low[s], i, b"") + path(high, k, b"")
            v = midstate.pack(merkle.resume_path(whole, midstate.unpack(bytes.fromhex(value)))).hex()
            siblings = "".join(midstate.pack(o).hex() for *_, o in merkle.read_steps(whole))
            out.append((r[0], leaf(r, r[4]), low[s][-1][0][-1].hex(), root, H(siblings), v, v == root))
    return sorted(out, key=str)


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 120), st.randoms(use_true_random=False))
def test_chunk_folds(n, rng):
    """Resuming from stored states gives what hashing the whole tree anew gives."""
    digests = [bytes(rng.randrange(256) for _ in range(32)) for _ in range(n)]
    levels = merkle.height(n)
    below, before, top = merkle.grow(midstate.unpack(b"".join(digests)), levels)
    assert midstate.pack(top).hex() == levels_of([d.hex() for d in digests])[1]
    kept = merkle.load(n, levels, *merkle.store(below, before))
    at = np.array(sorted(rng.sample(range(n), min(n, 5))))
    new = midstate.unpack(b"".join(bytes(rng.randrange(256) for _ in range(32)) for _ in at))
    folded = midstate.pack(merkle.resume(*kept, at, new))
    for k, i in enumerate(at):
        changed = [d.hex() for d in digests]
        changed[i] = midstate.pack(new[:, k:k + 1]).hex()
        assert folded[32 * k:32 * k + 32].hex() == levels_of(changed)[1]


def test_more_than_one_chunk(spark):
    """A source of more than 3^7 rows, one of exactly as many, and one with a lone chunk at the end."""
    rows = [(k, s, "en", k, f"{k}\n") for s, n in (("hot", 4400), ("one", 2187), ("over", 2188)) for k in range(n)]
    assert manifest_of(spark, rows, slice_rows=700) == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    assert manifest_of(spark, []) == []
    one = [(5, "a", None, None, None)]
    assert manifest_of(spark, one) == brute_manifest(one)


# ---------------------------------------------------------------- prefix trie
def brute_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, tie, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    full = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        full[c] = tuple(own.get(base, [])[:h] + t[h:])
    members, ends, children = {}, {}, {}
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members.setdefault(full[c][:d], []).append(c)
        ends.setdefault(full[c], []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
            leaves[p[:d]] += p not in children
    return sorted((members[p][0], len(p), str(members[p[:-1]][0] if p else None), len(members[p]), len(children.get(p, [])),
                   leaves[p], saved[p], H(",".join(map(str, ends.get(p, []))))) for p in members)


def trie_of(spark, rows, **options):
    shape = "conv_id long, turn long, role string, text string" + EXTRA
    got = prefix_trie.prefix_trie(spark.createDataFrame([(*r, *ROW) for r in rows], shape), **options).collect()
    return sorted((r.conv_id, r.depth, str(r.parent_conv_id), *r[3:]) for r in got)


def test_trie_of_odd_conversations(spark):
    rng = random.Random(5)
    words = ["a", "b", "", None, "é字\U0001f600", "long " * 2000]
    rows = []
    for c in [*range(0, 230, 3), 500, 777, 10 ** 15, -5, -100, -250]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8, 13])):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), words[rng.choice([0, 0, 0, 1, 2, 3, 4, 5])]))
    rows += [(None, 0, "user", "no conversation"), (900, None, None, None), (900, None, None, None)]
    assert trie_of(spark, rows, slice_rows=50, chunk_bits=2) == brute_trie(rows)


def test_trie_of_hot_prefixes_and_copies(spark):
    """One conversation of 300 turns, copies of another, a passage of 40 turns that many share, in small slices and chunks."""
    rows = [(1, t, "user", f"t{t}") for t in range(300)]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 400) for t in range(7)]
    rows += [(c, t, "user", f"s{t}" if t < 40 else f"{c}") for c in range(600, 640) for t in range(40 + c % 4)]
    assert trie_of(spark, rows, slice_rows=100, chunk_bits=3) == brute_trie(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(3, 1, "user", "x")], [(2, 1, "user", "x"), (4, 1, "user", "x")]])
def test_trie_of_little(spark, rows):
    assert trie_of(spark, rows) == brute_trie(rows)
