"""Merkle manifest of a document table: a tree of SHA-256 midstates.

A document is a leaf, the documents of a source are a tree of runs of three by
ascending id, and the sources' subroots are one more such tree.  A node's digest
covers its children's digests as hex text, 64 characters or one block of
SHA-256 each, so a parent keeps the hash state *before each child slot* in
32 bytes.  Folding a replaced leaf resumes the state before its slot and takes
in the new digest and the siblings to its right only.

The forest is stored in chunks of 3^7 consecutive nodes of a tree, seven levels
a row: the nodes of every level, the states before the second and third child
of every parent (before the first it is the start of SHA-256), and the top.
The tops are the nodes of the next round, until every tree has one.  The
sources' trees give the nodes of the tree of sources.

To fold, paths go down from the root: a step of a path has the state before the
slot and the siblings.  Only chunks get paths; in a chunk the states and
siblings of all its leaves are picked from the stored row at once.
No task holds more than a chunk, however large a source is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm import midstate as M
from fleetpulse.llm.common import placed
from fleetpulse.session import materialize

FAN = 3
LEVELS = 7                      # of a stored chunk
CHUNK = FAN ** LEVELS
SLICE_ROWS = 50_000
ALL = ""                        # name of the tree of sources


# ---------------------------------------------------------------- one chunk
def height(n: int) -> int:
    """Levels above ``n`` nodes, until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def grow(nodes: np.ndarray, levels: int) -> tuple[list[np.ndarray], list[list[np.ndarray]], np.ndarray]:
    """The nodes of every level below the top, the states of every parent before its second and third child,
    and the top.  ``nodes``: digests as ``(8, n)`` words; the last parent of a level may have fewer children."""
    below, before = [], []
    for _ in range(levels):
        blocks = M.hex_block(nodes)
        state, states, last = M.start(-(-nodes.shape[1] // FAN)), [], None
        done = np.zeros(state.shape[1], np.int64)
        for slot in range(FAN):
            children = blocks[:, slot::FAN]                # parents without this child are at the end
            k = children.shape[1]
            if slot:
                states.append(state.copy())
            state[:, :k] = M.absorb(state[:, :k], children)
            done[:k] += 1
        below.append(nodes)
        before.append(states)
        nodes = last = M.finish(state, done)
    return below, before, nodes


def store(below: list[np.ndarray], before: list[list[np.ndarray]]) -> tuple[bytes, bytes]:
    return b"".join(map(M.pack, below)), b"".join(M.pack(s) for states in before for s in states)


def load(n: int, levels: int, nodes: bytes, states: bytes) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
    """What ``grow`` gave for ``n`` nodes, from the stored bytes."""
    all_nodes, all_states = M.unpack(nodes), M.unpack(states)
    below, before, a, b = [], [], 0, 0
    for _ in range(levels):
        parents = -(-n // FAN)
        below.append(all_nodes[:, a:a + n])
        before.append([all_states[:, b + k * parents:b + (k + 1) * parents] for k in range(FAN - 1)])
        a, b, n = a + n, b + (FAN - 1) * parents, parents
    return below, before


def resume(below: list[np.ndarray], before: list[list[np.ndarray]], at: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The chunk's top for each of the leaves ``at`` replaced by ``value``, each by itself."""
    for nodes, states in zip(below, before, strict=True):
        parent, slot = at // FAN, at % FAN
        state = M.start(len(at))
        for k in range(1, FAN):
            state[:, slot == k] = states[k - 1][:, parent[slot == k]]
        state = M.absorb(state, M.hex_block(value))
        for k in range(1, FAN):                            # the siblings to the right
            right = parent * FAN + k
            on = (slot < k) & (right < nodes.shape[1])
            if on.any():
                state[:, on] = M.absorb(state[:, on], M.hex_block(nodes[:, right[on]]))
        value, at = M.finish(state, np.minimum(FAN, nodes.shape[1] - parent * FAN)), parent
    return value


def siblings(below: list[np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hex text of the siblings of each leaf, level by level, left to right, and which of them exist."""
    texts = np.zeros((len(at), len(below), FAN - 1, 64), np.uint8)
    there = np.zeros(texts.shape[:3], bool)
    for level, nodes in enumerate(below):
        text = np.frombuffer(M.hex_block(nodes).T.astype(">u4").tobytes(), np.uint8).reshape(-1, 64)
        for k in range(FAN - 1):
            other = at // FAN * FAN + k + (k >= at % FAN)
            on = other < nodes.shape[1]
            texts[on, level, k], there[on, level, k] = text[other[on]], True
        at = at // FAN
    return texts, there


# ---------------------------------------------------------------- paths
def steps_of(below: list[np.ndarray], before: list[list[np.ndarray]], at: int) -> bytes:
    """The path of one node to the top: per level slot, children, the state before the slot, the siblings."""
    out = []
    for nodes, states in zip(below, before, strict=True):
        parent, slot = divmod(at, FAN)
        run = range(parent * FAN, min(parent * FAN + FAN, nodes.shape[1]))
        state = M.START[:, None] if not slot else states[slot - 1][:, parent:parent + 1]
        out += [bytes([slot, len(run)]), M.pack(state), M.pack(nodes[:, [i for i in run if i != at]])]
        at = parent
    return b"".join(out)


def read_steps(path: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``slot, children, state, siblings`` of each step."""
    at = 0
    while at < len(path):
        slot, count = path[at], path[at + 1]
        state, at = M.unpack(path[at + 2:at + 2 + M.STATE_BYTES]), at + 2 + M.STATE_BYTES
        others, at = M.unpack(path[at:at + M.STATE_BYTES * (count - 1)]), at + M.STATE_BYTES * (count - 1)
        yield slot, count, state, others


def resume_path(path: bytes, value: np.ndarray) -> np.ndarray:
    """The root for each value that takes the place of the path's node."""
    for slot, count, state, others in read_steps(path):
        state = M.absorb(np.repeat(state, value.shape[1], axis=1), M.hex_block(value))
        for k in range(slot, count - 1):
            state = M.absorb(state, np.repeat(M.hex_block(others[:, k:k + 1]), value.shape[1], axis=1))
        value = M.finish(state, np.full(value.shape[1], count))
    return value


# ---------------------------------------------------------------- the forest
STORED = "tree string, chunk bigint, size bigint, n int, levels int, nodes binary, states binary, top binary"


def _digests(column: pd.Series) -> np.ndarray:
    return M.unpack(b"".join(column))


def grow_forest(nodes: DataFrame) -> list[DataFrame]:
    """The stored rounds of the trees over ``nodes``: ``tree, at, size`` (nodes of the tree), ``digest``.

    A tree of one node has a chunk without levels."""
    def build(r: int):
        def one(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("at")
            size, tree = int(frame["size"].iloc[0]), frame["tree"].iloc[0]
            levels = min(LEVELS, height(size) - LEVELS * r)
            below, before, top = grow(_digests(frame["digest"]), levels)
            kept, states = store(below, before)
            return pd.DataFrame({"tree": [tree], "chunk": [int(frame["at"].iloc[0]) // CHUNK], "size": [size], "n": [len(frame)],
                                 "levels": [levels], "nodes": [kept], "states": [states], "top": [M.pack(top)]})
        return one

    rounds, largest = [], nodes.agg(F.max("size")).first()[0] or 0
    while not rounds or largest > FAN ** (LEVELS * len(rounds)):
        by_chunk = nodes.select("tree", "at", "size", "digest").groupBy("tree", F.floor(F.col("at") / CHUNK).alias("chunk"))
        rounds.append(materialize(by_chunk.applyInPandas(build(len(rounds)), STORED), "merkle-chunks"))
        nodes = rounds[-1].where(F.col("size") > FAN ** (LEVELS * len(rounds))).select(
            "tree", F.col("chunk").alias("at"), "size", F.col("top").alias("digest"))
    return rounds


def _ends_in(r: int) -> Column:
    """Trees whose top is in round ``r`` (from 0)."""
    ends = F.col("size") <= FAN ** (LEVELS * (r + 1))
    return ends & (F.col("size") > FAN ** (LEVELS * r)) if r else ends


def tops(rounds: list[DataFrame]) -> DataFrame:
    """``tree, top`` of every tree."""
    out = None
    for r, chunks in enumerate(rounds):
        here = chunks.where(_ends_in(r)).select("tree", "top")
        out = here if out is None else out.unionByName(here)
    return out


def chunk_paths(rounds: list[DataFrame], above: DataFrame, nodes: bool = False) -> DataFrame:
    """The chunks of the first round with ``path`` from their tops to the root, or with ``nodes`` the paths of
    their nodes: ``tree, at, path``.  ``above``: ``tree, path`` of every tree's top."""
    def expand(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for c in frame.itertuples(index=False):
                kept = load(c.n, c.levels, c.nodes, c.states)
                yield pd.DataFrame({"tree": c.tree, "at": c.chunk * CHUNK + np.arange(c.n),
                                    "path": [steps_of(*kept, i) + c.path for i in range(c.n)]})

    inherited = None
    for r in range(len(rounds) - 1, -1, -1):
        known = rounds[r].where(_ends_in(r)).select("tree", "chunk").join(above, "tree")
        known = known if inherited is None else known.unionByName(inherited)
        chunks = rounds[r].join(known, ["tree", "chunk"])
        if r or nodes:
            expanded = chunks.select("tree", "chunk", "n", "levels", "nodes", "states", "path") \
                .mapInPandas(expand, "tree string, at bigint, path binary")
            inherited = materialize(expanded, "merkle-paths").withColumnRenamed("at", "chunk")
    return inherited.withColumnRenamed("chunk", "at") if nodes else chunks


# ---------------------------------------------------------------- operator
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def record(text: Column, fields: list[str] = FIELDS) -> Column:
    """What a leaf covers: every field as its UTF-8 length, a colon and its value, or a dash for null."""
    def part(value: Column) -> Column:
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.concat(*[part(text if f == "text" else F.col(f).cast("string")) for f in fields])


def _sha(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


@dataclass
class Manifest:
    """``leaves``: ``doc_id, tree, at, size, digest, changed`` (null where the leaf is as it was); the stored rounds
    of the sources' trees and of the tree of sources; ``subroots``: ``tree, top, place``; ``root``: hex, None without leaves."""

    leaves: DataFrame
    rounds: list[DataFrame]
    source_rounds: list[DataFrame]
    subroots: DataFrame
    root: str | None


def build_manifest(docs: DataFrame, changed_text: Column | None = None, changed: Column | None = None,
                   slice_rows: int = SLICE_ROWS) -> Manifest:
    """The manifest of ``docs``; leaves of rows where ``changed`` holds also get a digest with ``changed_text``."""
    text = F.col("text").cast("string")
    now = F.lit(None).cast("binary") if changed is None else F.when(changed & (changed_text != text), _sha(record(changed_text)))
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))     # '-' sorts before '='
    hashed = materialize(docs.select("doc_id", tree.alias("tree"), _sha(record(text)).alias("digest"), now.alias("changed")), "merkle-leaves")
    leaves = materialize(placed(hashed, "tree", ["doc_id", "digest"], slice_rows), "merkle-placed")
    rounds = grow_forest(leaves)
    sources = tops(rounds).withColumn("name", F.lit(ALL))
    subroots = materialize(placed(materialize(sources, "merkle-tops"), "name", ["tree"], slice_rows), "merkle-subroots")
    source_rounds = grow_forest(subroots.select(F.col("name").alias("tree"), "at", "size", F.col("top").alias("digest")))
    root = tops(source_rounds).first()
    return Manifest(leaves, rounds, source_rounds, subroots.select("tree", "top", F.col("at").alias("place")),
                    bytes(root["top"]).hex() if root else None)


def fold_leaves(m: Manifest) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, a row per leaf.

    ``folded_root`` comes from the changed digest (or the leaf's own), the stored states and the siblings;
    ``proof_sha256`` covers the siblings' hex texts from the leaf to the root."""
    key_type = m.leaves.schema["doc_id"].dataType.simpleString()
    start = m.subroots.sparkSession.range(1).select(F.lit(ALL).alias("tree"), F.lit(b"").alias("path"))
    of_sources = chunk_paths(m.source_rounds, start, nodes=True).select(F.col("at").alias("place"), "path")
    above = materialize(m.subroots.join(of_sources, "place").select("tree", "path", F.col("top").alias("subroot")), "merkle-above")
    chunks = chunk_paths(m.rounds, above.select("tree", "path")).join(above.select("tree", "subroot"), "tree") \
        .select("tree", "chunk", "n", "levels", "nodes", "states", "path", "subroot")

    def fold(leaves: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        c = chunk.iloc[0]
        below, before = load(c["n"], c["levels"], c["nodes"], c["states"])
        at = (leaves["at"] % CHUNK).to_numpy()
        value = _digests(leaves["changed"].where(leaves["changed"].notna(), leaves["digest"]))
        folded = M.pack(resume_path(c["path"], resume(below, before, at, value)))
        texts, there = siblings(below, at)
        upper = b"".join(M.pack(o).hex().encode() for *_, o in read_steps(c["path"]))
        return pd.DataFrame({
            "doc_id": leaves["doc_id"], "leaf": [bytes(x).hex() for x in leaves["digest"]], "subroot": c["subroot"].hex(),
            "proof_sha256": [hashlib.sha256(t[o].tobytes() + upper).hexdigest() for t, o in zip(texts, there, strict=True)],
            "folded_root": [folded[k:k + 32].hex() for k in range(0, len(folded), 32)]})

    dealt = m.leaves.select("tree", F.floor(F.col("at") / CHUNK).alias("chunk"), "at", "doc_id", "digest", "changed")
    folded = dealt.groupBy("tree", "chunk").cogroup(chunks.groupBy("tree", "chunk")).applyInPandas(
        fold, f"doc_id {key_type}, leaf string, subroot string, proof_sha256 string, folded_root string")
    root = F.lit(m.root).cast("string")
    return folded.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
                         (F.col("folded_root") == root).alias("verified"))


def verify_tampered(docs: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The manifest of ``docs``, and every leaf folded to the root after tampering with the even ones.

    Tampering takes the line feeds out of the text where 2 divides the crc32 of the decimal id; null texts and rows
    without an id stay as they are.  Rows that repeat an id stand by their digest, null ids come first in their
    source, the rows without a source are the first source.  Other columns are ignored; an empty table gives no rows.
    """
    text = F.col("text").cast("string")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return fold_leaves(build_manifest(docs, F.replace(text, F.lit("\n"), F.lit("")), even, slice_rows))
