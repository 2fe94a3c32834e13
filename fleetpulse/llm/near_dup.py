"""Near-duplicate components by a chosen-path set similarity join.

A document is the set of its five-word shingles, hashed to 64 bits.

1. One pass gives each document the size of its set, a 128-bit fingerprint of
   the set, and ``K`` minwise tokens.  Documents with equal sets form one class
   and go on as one, however many copies there are.
2. Chosen paths: in each of ``trees`` independent trees a node picks one of the
   minwise coordinates (by a hash of the path that leads to it) and branches
   its classes by their token there, which similar sets share with the
   probability of their similarity.  Nodes of one class end, nodes of up to
   ``leaf`` classes are compared exhaustively.  A larger one is compared with a
   pivot, which its members get with its size: if at most ``UNLIKE * leaf`` of
   them are unlike it (near copies of one text and some others) it ends, too,
   else it branches again.  Larger nodes that ended, also for being ``depth``
   levels deep, are linked through the pivot, and their members not alike are
   compared, block by block, with all members.  So nothing is capped, and no
   task holds more than two blocks.
   Classes whose nodes branched deep (many documents that share a passage) are
   grown in further trees, as many as their deepest level asks for.
3. Comparing in a node uses the minwise tokens with a tolerance of 4.5
   standard errors and keeps a spanning set of links, not all pairs.  The
   connected groups of these candidate links are the clusters.
4. Clusters get the full sets, each document's set once, and are compared in
   the same way by exact intersection; again a spanning set of links is kept
   (documents that are already connected need no further comparison).
5. Components of the verified links, by alternating star contraction.

A pair with m of the K tokens in common stays together to level l of a tree
with probability (m / K)^l, so one of similarity s is missed by all trees with
probability E[(1 - (m / K)^l)^trees], m being binomial (K, s).  TREES trees
keep that below MISS to level 2 for 0.8 and above (5e-6 for 0.85, 4e-5 for 0.8);
at deeper levels ``trees_needed`` gives the number, at level 8 70 trees for
0.85 and 149 for 0.8.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import same
from fleetpulse.session import materialize

SHINGLE = 5
PERCENT = 80
K = 64
TREES = 12
MISS = 1e-4                     # of pairs at the threshold, at any level
LEAF = 256
UNLIKE = 32                     # leaves of members unlike the pivot up to which comparing these with all is cheaper than more levels
TOKEN_BLOCK = 8                 # leaves in a block of members that are compared by sketches of K bytes
DEPTH = 8
BLOCK_BYTES = 1 << 18           # of text hashed at a time
BLOCK_DOCS = 256
BROADCAST_ROWS = 1_000_000      # of 40 bytes each
BROADCAST_CLASSES = 250_000     # rows that name classes, of some 130 bytes each
BROADCAST_BYTES = 1 << 23       # of pivots' sets
INDEXED = 1 << 22               # hashes of a group that are numbered at once
MEMBER = ("node", "cls", "n", "sketch")
JUDGED = (*MEMBER, "size", "pivot", "near")

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_FLIP = _RNG.integers(0, 1 << 32, K, np.uint64).astype(np.uint32)
_MULTIPLY = _RNG.integers(0, 1 << 32, K, np.uint64).astype(np.uint32) | np.uint32(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


# ---------------------------------------------------------------- shingles
def _mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185) + np.uint64(seed * 0x632BE59BD9B4E019 % (1 << 64))
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), base)]).cumprod(dtype=np.uint64)[:n]


def word_hashes(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that stand one after another in ``data``
    (``begin``: where each text begins), and the number of words of each text."""
    low = _LOWER[data]
    inside = ~_SPACE[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = begin[begin < len(data)]
    first[edge] = inside[edge]                             # a text's first word begins anew
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(begin), np.int64)
    size = np.diff(np.append(at, len(data)))
    place = np.arange(at[0], len(data)) - np.repeat(at, size)
    value = _BYTE[low[at[0]:]] * inside[at[0]:]
    value *= _powers(_BASE, int(place.max()) + 1)[place]
    hashes = _mix(np.add.reduceat(value, at - at[0]))
    return hashes, np.diff(np.searchsorted(at, np.append(begin, len(data))))


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):                                # blocks of whole texts
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1)
        words, count = word_hashes(data[offsets[row]:offsets[stop]], offsets[row:stop] - offsets[row])
        ends = np.cumsum(count)
        # a run of `width` words from each word on; runs that leave the text are not used
        runs, scale = np.zeros(len(words), np.uint64), _powers(_STEP, width)
        for k in range(min(width, len(words))):
            runs[:len(words) - k] += words[k:] * scale[k]
        for n, end in zip(count.tolist(), ends.tolist(), strict=True):
            if n >= width:
                yield np.unique(_mix(runs[end - n:end - width + 1], width))
            elif n:
                yield _mix((words[end - n:end] * scale[:n]).sum(dtype=np.uint64, keepdims=True), n)
            else:
                yield np.zeros(0, np.uint64)
        row = stop


def _minwise(items: np.ndarray) -> np.ndarray:
    low = np.full(K, 0xFFFFFFFF, np.uint32)
    short = (items >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 4096):
        v = (short[None, at:at + 4096] ^ _FLIP[:, None]) * _MULTIPLY[:, None]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(low, v.min(axis=1), out=low)
    return low


def _class_id(items: np.ndarray) -> bytes:
    return np.array([_mix(items, 11).sum(dtype=np.uint64), _mix(items, 13).sum(dtype=np.uint64)]).astype(">u8").tobytes()


def signatures(docs: DataFrame, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, n, cls, mins, sketch``: set size, fingerprint, minwise tokens and their low bytes
    (null without words)."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_DOCS):
                part, n, cls, mins, sketch = batch.slice(at, BLOCK_DOCS), [], [], [], []
                for items in shingle_sets(part.column(2), width):
                    n.append(len(items))
                    cls.append(_class_id(items) if len(items) else None)
                    low = _minwise(items)
                    mins.append(low.tobytes() if len(items) else None)
                    sketch.append(low.astype(np.uint8).tobytes() if len(items) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (
                        cls, mins, sketch))], names=["doc_id", "text_hash", "n", "cls", "mins", "sketch"])

    key_type = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")) \
        .mapInArrow(sign, f"doc_id {key_type}, text_hash bigint, n bigint, cls binary, mins binary, sketch binary")


# ---------------------------------------------------------------- trees
def _branch(parent: np.ndarray, mins: np.ndarray) -> np.ndarray:
    """Child node of each row: the parent's hash picks the coordinate, the token there picks the child."""
    chosen = (_mix(parent, 3) % np.uint64(K)).astype(np.int64)
    token = mins[np.arange(len(mins)), chosen].astype(np.uint64)
    return _mix(_mix(parent, 5) + token, 7)


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, K)


def trees_needed(percent: int, level: int, miss: float = MISS) -> int:
    """Trees that miss a pair of ``percent`` similarity whose nodes branch to ``level`` with at most ``miss``."""
    s = min(max(percent, 1), 99) / 100
    m = np.arange(K + 1)
    weight = np.array([math.comb(K, k) * s ** k * (1 - s) ** (K - k) for k in range(K + 1)])
    apart = 1 - (m / K) ** level
    lost = lambda trees: float((weight * apart ** trees).sum())
    low, high = 0, 1
    while lost(high) > miss:
        low, high = high, 2 * high
    while high - low > 1:
        low, high = (low, mid) if lost(mid := (low + high) // 2) <= miss else (mid, high)
    return high


def _roots(growing: DataFrame, trees: int) -> DataFrame:
    """``cls, node``: the roots' children of each class in its trees ``grown`` to ``wanted`` - 1."""
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            mins, cls = _tokens(batch.column("mins")), batch.column("cls")
            grown, wanted = np.asarray(batch.column("grown")), np.asarray(batch.column("wanted"))
            for t in range(grown.min(), wanted.max()):
                at = np.flatnonzero((grown <= t) & (t < wanted))
                root = np.full(len(at), t + 1, np.uint64)
                if t < trees:                              # a coordinate of its own for each of the first trees' roots
                    node = _mix(_mix(root, 5) + mins[at, t * K // trees].astype(np.uint64), 7)
                else:
                    node = _branch(root, mins[at])
                yield pa.RecordBatch.from_arrays([cls.take(pa.array(at)), pa.array(node.view(np.int64))],
                                                 names=["cls", "node"])

    return growing.select("cls", "mins", "grown", "wanted").mapInArrow(grow, "cls binary, node bigint")


def _sizes(frontier: DataFrame, classes: DataFrame, leaf: int, carried: bool) -> DataFrame:
    """``node, size`` of the nodes with two and more classes; of those above ``leaf`` also ``pivot, pivot_n,
    pivot_sketch``, a member that the others are compared with.

    Members that do not carry their sketches yet name the pivot by a hash, and the few pivots are looked up."""
    if carried:
        sizes = frontier.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("cls", "n", "sketch")).alias("least"))
        sizes = sizes.where(F.col("size") > 1).withColumn("least", F.when(F.col("size") > leaf, F.col("least")))
    else:
        sizes = frontier.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min(F.xxhash64("cls")).alias("hash"))
        sizes = materialize(sizes.where(F.col("size") > 1), "near-sizes")
        named = classes.select(F.xxhash64("cls").alias("hash"), F.struct("cls", "n", "sketch").alias("least"))
        found = named.join(_small(sizes.where(F.col("size") > leaf).select("node", "hash")), "hash")
        sizes = sizes.join(found.groupBy("node").agg(F.min("least").alias("least")), "node", "left_outer")
    return sizes.select("node", "size", F.col("least.cls").alias("pivot"), F.col("least.n").alias("pivot_n"),
                        F.col("least.sketch").alias("pivot_sketch"))


def _judged(members: DataFrame, percent: int, levels: int) -> DataFrame:
    """Members of large nodes with ``near``: alike their node's pivot (``_by_tokens``).  Those that come with ``mins``
    get ``chain`` instead: the nodes that follow theirs on the next ``levels`` levels."""
    least = _least_share(percent)

    def follow(batch: pa.RecordBatch) -> pa.Array:
        node, mins, chain = np.asarray(batch.column("node")).view(np.uint64), _tokens(batch.column("mins")), []
        for _ in range(levels):
            node = _branch(node, mins)
            chain.append(node)
        flat = pa.array(np.stack(chain, axis=1).reshape(-1).view(np.int64))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, levels, dtype=np.int32)), flat)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, p = np.asarray(batch.column("n")), np.asarray(batch.column("pivot_n"))
            near = np.minimum(n, p) * 100 >= percent * np.maximum(n, p)
            near &= (_sketches(batch.column("sketch")) == _sketches(batch.column("pivot_sketch"))).mean(axis=1) >= least
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(near), follow(batch) if starts else batch.column("chain")],
                                             names=[*kept, "near", "chain"])

    starts = "mins" in members.columns
    kept = [c for c in members.columns if c not in ("pivot_n", "pivot_sketch", "mins", "chain")]
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.select(*kept).schema)
    return members.mapInArrow(judge, f"{shape}, near boolean, chain array<bigint>")


def tree_nodes(classes: DataFrame, trees: int = TREES, leaf: int = LEAF, depth: int = DEPTH,
               percent: int = PERCENT) -> DataFrame:
    """``node, cls, n, sketch``: the members of all nodes with two and more classes where branching ends; in nodes
    of more than ``leaf`` classes also ``size, pivot, near`` (alike the node's pivot), else null.

    All classes grow in ``trees`` trees.  Those whose nodes branched to a level that needs more trees for
    ``percent`` (``trees_needed``) grow in the others together, until each has the trees of its deepest level."""
    needed = [max(trees, trees_needed(percent, max(1, level))) for level in range(depth + 1)]
    growing, ended = classes.select("cls", "mins", F.lit(0).alias("grown"), F.lit(trees).alias("wanted")), None
    while True:
        done, deep = _grow(growing, classes, trees, leaf, depth, needed, percent)
        ended = _and(ended, done)
        if deep is None:
            return ended
        deep = deep.groupBy("cls").agg(F.max("needed").alias("needed"))
        growing = materialize(growing.join(deep, "cls").where(F.col("needed") > F.col("wanted")).select(
            "cls", "mins", F.col("wanted").alias("grown"), F.col("needed").alias("wanted")), "near-growing")
        if growing.isEmpty():
            return ended


def _grow(growing: DataFrame, classes: DataFrame, trees: int, leaf: int, depth: int,
          needed: list[int], percent: int) -> tuple[DataFrame, DataFrame | None]:
    """The members of the nodes where the trees of ``growing`` end, and ``cls, needed`` of the classes that
    branched to levels which need more than ``trees`` trees.

    A member gets its node's size and pivot in one join a level.  The paths of members of large nodes are followed to
    the end at once, as a path depends on a class's own tokens only; where it stops depends on the counts.
    They carry their size and sketch, so that no level looks them up again."""
    frontier, ended, deep, carried = materialize(_roots(growing, trees), "near-frontier"), None, None, False
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (("size", "bigint"), ("pivot", "binary"), ("near", "boolean"))]
    for level in range(depth):
        live = materialize(frontier.join(_sizes(frontier, classes, leaf, carried), "node"), "near-live")
        done, large = live.where(F.col("size") <= leaf), live.where(F.col("size") > leaf)
        done = (done if carried else done.select("node", "cls").join(classes.select("cls", "n", "sketch"), "cls"))
        ended = _and(ended, done.select(*MEMBER, *nothing))
        if large.isEmpty():
            break
        if not carried:
            large, carried = large.join(classes.select("cls", "n", "mins", "sketch"), "cls"), True
        large = materialize(_judged(large, percent, max(1, depth - 1)), "near-judged")
        if level + 1 == depth:
            ended = _and(ended, large.select(*JUDGED))
            break
        going = large.where(~F.col("near")).groupBy("node").agg(F.count(F.lit(1)).alias("unlike")) \
            .where(F.col("unlike") > UNLIKE * leaf).select("node")
        going = materialize(going, "near-going")
        ended = _and(ended, large.join(going, "node", "left_anti").select(*JUDGED))
        if going.isEmpty():
            break
        large = large.join(going, "node", "left_semi")
        frontier = materialize(large.select("cls", "chain", "n", "sketch", F.get("chain", F.lit(level)).alias("node")), "near-frontier")
        if needed[level + 2] > trees:
            deep = _and(deep, frontier.select("cls", F.lit(needed[level + 2]).alias("needed")))
    return ended, deep


def _and(one: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if one is None else one.unionByName(more)


# ---------------------------------------------------------------- comparing inside groups
class Forest:
    """Connected parts of positions 0..n-1."""

    def __init__(self, n: int):
        self.part = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        if not len(others):
            return
        parts = np.unique(self.part[others])
        target = self.part[i]
        self.part[np.isin(self.part, parts[parts != target])] = target


def _whole_groups(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The groups of a stream that is sorted by ``key``, each whole."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        keys = frame[key].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip(np.append(0, cuts[:-1]), cuts, strict=False):
            yield frame.iloc[a:b]
        rest = frame.iloc[cuts[-1] if len(cuts) else 0:]
    if rest is not None and len(rest):
        yield rest


def _links(cls: np.ndarray, part: np.ndarray) -> pd.DataFrame:
    """Every member of a part with the part's least member, so that groups with common members repeat their links."""
    order = np.argsort(cls)
    cls, part = cls[order], part[order]
    _, first, inverse = np.unique(part, return_index=True, return_inverse=True)
    head = cls[first[inverse]]
    differs = first[inverse] != np.arange(len(part))
    return pd.DataFrame({"a": head[differs], "b": cls[differs]})


LINK = "a binary, b binary"


def spanning_links(members: DataFrame, keys: DataFrame, alike: tuple[Callable, Callable], leaf: int = LEAF) -> DataFrame:
    """Links ``a, b`` that connect what is alike inside each group.

    ``members``: ``node, cls, n, payload``; ``keys``: their ``node, cls`` alone.
    ``alike``: a function that loads ``n`` and ``payload``, and one that tells
    which of the positions ``others`` are linked with ``i``.  Groups of up to
    ``leaf`` members are compared exhaustively.  Larger ones: all members with
    one pivot, then, in blocks, the members not linked to it with all.
    """
    load, linked = alike
    large = keys.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("cls").alias("pivot")) \
        .where(F.col("size") > leaf)
    large = materialize(large, "near-large")
    if large.isEmpty():
        return _leaf_links(members, alike)

    def star(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            near = np.zeros(len(frame), bool)
            for at in frame.groupby("node").indices.values():      # the pivot first, then its members in this batch
                one = frame.iloc[at[0]]
                data = load(np.append(one["pivot_n"], frame["n"].to_numpy()[at]),
                            np.concatenate([np.array([one["pivot_payload"]], object), frame["payload"].to_numpy()[at]]))
                near[at] = linked(data, 0, np.arange(1, len(at) + 1))
            yield frame[["node", "cls", "pivot", "size", "n", "payload"]].assign(near=near)

    pivots = materialize(members.join(_small(large), "node").where(F.col("cls") == F.col("pivot")).select(
        "node", "pivot", "size", F.col("n").alias("pivot_n"), F.col("payload").alias("pivot_payload")), "near-pivots")
    count, size = pivots.agg(F.count(F.lit(1)), F.sum(F.octet_length("pivot_payload"))).first()
    # few and small pivots go to where the members are
    pivots = F.broadcast(pivots) if count <= BROADCAST_CLASSES and (size or 0) <= BROADCAST_BYTES else pivots
    judged = materialize(members.join(pivots, "node").mapInPandas(
        star, "node bigint, cls binary, pivot binary, size bigint, n bigint, payload binary, near boolean"), "near-star")
    return _leaf_links(members.join(large.select("node"), "node", "left_anti"), alike) \
        .unionByName(_pivot_links(judged, alike, leaf))


def _leaf_links(members: DataFrame, alike: tuple[Callable, Callable]) -> DataFrame:
    """Links of groups (``node, cls, n, payload``) that are compared exhaustively."""
    load, linked = alike

    def exhaustive(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _whole_groups(frames, "node"):
            data, forest = load(group["n"].to_numpy(), group["payload"].to_numpy()), Forest(len(group))
            for i in range(len(group) - 1):
                others = np.flatnonzero(forest.part != forest.part[i])
                others = others[others > i]
                if len(others):
                    forest.join(i, others[linked(data, i, others)])
            out = _links(group["cls"].to_numpy(), forest.part)
            if len(out):
                yield out

    # comparing costs time, not bytes: a fixed number of tasks, not coalesced by size
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.select("node", "cls", "n", "payload") \
        .repartition(tasks, "node").sortWithinPartitions("node").mapInPandas(exhaustive, LINK)


def _pivot_links(judged: DataFrame, alike: tuple[Callable, Callable], rows: int) -> DataFrame:
    """Links of large groups whose members were compared with their pivot: ``node, cls, n, payload, size, pivot, near``,
    by blocks of ``rows`` members."""
    load, linked = alike
    stars = judged.where(F.col("near") & (F.col("cls") != F.col("pivot"))).select(
        F.col("pivot").alias("a"), F.col("cls").alias("b"))

    # the members not linked to the pivot, block by block, with the blocks of all members
    apart = judged.where(~F.col("near"))
    count = materialize(apart.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / rows).alias("u_blocks")), "near-apart")
    block = lambda seed, blocks: F.pmod(F.xxhash64(F.lit(seed), "cls"), blocks)
    m_blocks = F.ceil(F.col("size") / rows)
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    queries = apart.join(count, "node").withColumn("u", block(1, F.col("u_blocks"))) \
        .withColumn("m", spread(m_blocks)).select("node", "u", "m", "cls", "n", "payload")
    bases = judged.join(count, "node").withColumn("m", block(2, m_blocks)) \
        .withColumn("u", spread(F.col("u_blocks")))
    # aliased anew: both sides come from the same table
    bases = bases.select([F.col(c).alias(c) for c in ("node", "u", "m", "cls", "n", "payload", "near", "pivot")])

    def across(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        both = pd.concat([left, right], ignore_index=True)
        cls, forest, k = both["cls"].to_numpy(), Forest(len(both)), len(left)
        near = np.flatnonzero(right["near"].to_numpy(bool)) + k
        if len(near):
            forest.join(int(near[0]), near)                # connected through the pivot
        data = load(both["n"].to_numpy(), both["payload"].to_numpy())
        for i in range(k):
            others = np.flatnonzero(forest.part != forest.part[i])
            others = others[others >= k]
            if len(others):
                forest.join(i, others[linked(data, i, others)])
        if not len(near):
            return _links(cls, forest.part)
        # the star has the links of `near` already: the others of their part go to the pivot
        hub = forest.part == forest.part[near[0]]
        out = _links(cls[~hub], forest.part[~hub])
        hub[near] = False
        return pd.concat([out, pd.DataFrame({"a": right["pivot"].iloc[0], "b": cls[hub]})], ignore_index=True)

    blocks = queries.groupBy("node", "u", "m").cogroup(bases.groupBy("node", "u", "m")).applyInPandas(across, LINK)
    return stars.unionByName(blocks.where(F.col("a") != F.col("b")))


def _least_share(percent: int) -> float:
    """Least share of equal tokens of a pair that may be linked: a tolerance of 4.5 standard errors."""
    s = percent / 100
    return s - 4.5 * (s * (1 - s) / K) ** 0.5


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, K)


def _by_tokens(percent: int) -> tuple[Callable, Callable]:
    """Alike by length and the low bytes of the minwise tokens, with a tolerance (``_least_share``)."""
    least = _least_share(percent) * K

    def load(n, payload):
        return n, np.frombuffer(b"".join(payload), np.uint8).reshape(-1, K)

    def linked(data, i, others):
        n, tokens = data
        near = np.minimum(n[others], n[i]) * 100 >= percent * np.maximum(n[others], n[i])
        equal = np.packbits(tokens[others[near]] == tokens[i], axis=1).view(np.uint64)[:, 0]      # a bit for each token
        near[near] = np.bitwise_count(equal) >= least
        return near

    return load, linked


def _by_sets(percent: int) -> tuple[Callable, Callable]:
    """Linked by the whole sets: 100 * intersection >= percent * union.

    The hashes of a group are numbered, so that a set is looked up in all others at once; in groups with more than
    ``INDEXED`` hashes, whose sets are long, one pair after another is intersected."""
    def load(n, payload):
        sets, mark = [np.frombuffer(p, np.uint64) for p in payload], None
        if sum(map(len, sets)) <= INDEXED:
            known, number = np.unique(np.concatenate(sets), return_inverse=True)
            sets, mark = np.split(number, np.cumsum([len(s) for s in sets])[:-1]), np.zeros(len(known), bool)
        return n, sets, mark

    def common(sets, mark, i, others):
        if mark is None:
            at = (np.minimum(np.searchsorted(sets[i], sets[k]), len(sets[i]) - 1) for k in others)
            return np.array([(sets[i][a] == sets[k]).sum() for a, k in zip(at, others, strict=True)])
        mark[sets[i]] = True
        size = np.array([len(sets[k]) for k in others])
        both = np.add.reduceat(mark[np.concatenate([sets[k] for k in others])], np.cumsum(size) - size, dtype=np.int64)
        mark[sets[i]] = False
        return both

    def linked(data, i, others):
        n, sets, mark = data
        near = np.minimum(n[others], n[i]) * 100 >= percent * np.maximum(n[others], n[i])
        close = others[near]
        if len(close):
            both = common(sets, mark, i, close)
            near[near] = 100 * both >= percent * (n[i] + n[close] - both)
        return near

    return load, linked


# ---------------------------------------------------------------- components
def components(links: DataFrame) -> DataFrame:
    """``member, root`` (the smallest member reachable) of every node of ``links``, by alternating stars.

    Each round looks at every node's least and largest smaller neighbour: when all have one, and that one has none,
    the links are stars.  Else larger neighbours go to the least neighbour, then smaller ones do; both joins have a
    row per link, so the links never grow."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges = materialize(edges, "near-edges")
    while True:
        own = F.struct("u", "v", F.lit(False).alias("head"))
        head = F.struct(F.col("v").alias("u"), F.lit(None).cast(edges.schema["v"].dataType).alias("v"), F.lit(True).alias("head"))
        seen = edges.select(F.explode(F.array(own, head)).alias("e")).groupBy("e.u").agg(
            F.min("e.v").alias("low"), F.max("e.v").alias("high"), F.max("e.head").alias("head"))
        seen = materialize(seen, "near-seen")
        below = F.col("low").isNotNull()
        rows, unsettled = seen.agg(F.count("low"), F.count_if(below & ((F.col("low") != F.col("high")) | F.col("head")))).first()
        if not unsettled:
            return seen.select(F.col("u").alias("member"), F.coalesce("low", "u").alias("root"))
        small = (lambda names: F.broadcast(names)) if rows <= BROADCAST_CLASSES else (lambda names: names)
        lows = seen.where(below).select(F.col("u").alias("x"), "low")
        large = edges.join(small(lows), F.col("v") == F.col("x"), "left_outer").select("u", F.coalesce("low", "v").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        edges = large.join(small(least), "u").select(
            F.when(F.col("v") == F.col("least"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("least").alias("v"))
        edges = materialize(edges, "near-edges")


# ---------------------------------------------------------------- operator
def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE, trees: int = TREES, leaf: int = LEAF,
                    depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, text_hash, n_shingles, component_id, kept``.

    Words are runs of other than white space, lower-cased A-Z; a text of fewer
    than ``width`` words is one shingle, a null or wordless text has none and is
    linked with nothing.  Documents are linked when 100 * intersection >=
    ``percent`` * union of their sets; ``component_id`` is the smallest id
    reachable, ``kept`` marks the rows with that id.  Rows that repeat an id
    and text are equal rows.  A null id is never the smallest unless all ids of
    a component are null (then the component is null and its rows are kept).
    """
    signed = materialize(signatures(docs, width, id_col, text_col), "near-signed")
    classes = signed.where(F.col("n") > 0).groupBy("cls").agg(
        F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("one"), F.count(F.lit(1)).alias("rows"),
        F.first("n").alias("n"), F.first("mins").alias("mins"), F.first("sketch").alias("sketch"))
    classes = materialize(classes, "near-classes")

    tokens = tree_nodes(classes, trees, leaf, depth, percent).withColumnRenamed("sketch", "payload")
    links = _leaf_links(tokens.where(F.col("size").isNull()), _by_tokens(percent))
    large = materialize(tokens.where(F.col("size").isNotNull()), "near-tokens")
    if not large.isEmpty():
        links = links.unionByName(_pivot_links(large, _by_tokens(percent), TOKEN_BLOCK * leaf))
    clusters = components(links).select(F.col("member").alias("cls"), F.xxhash64("root").alias("node"))

    sets = materialize(_class_sets(docs, classes, clusters, width, id_col, text_col), "near-sets")
    linked = components(spanning_links(sets, clusters, _by_sets(percent), leaf))

    # a component for every class with copies or links; all other documents are their own
    linked = _small(linked.select(F.col("member").alias("cls"), "root"), BROADCAST_CLASSES)
    groups = classes.select("cls", "least_id", "rows").join(linked, "cls", "left_outer").where(
        F.col("root").isNotNull() | (F.col("rows") > 1)).select(F.col("cls").alias("g_cls"), "least_id", "root")
    groups = materialize(groups, "near-groups")
    alone, joined = groups.where(F.col("root").isNull()), groups.where(F.col("root").isNotNull())
    least = joined.groupBy("root").agg(F.min("least_id").alias("group_id"))
    small = groups.count() <= BROADCAST_CLASSES
    groups = alone.select("g_cls", F.col("least_id").alias("group_id")).unionByName(
        joined.select("g_cls", "root").join(F.broadcast(least) if small else least, "root").select("g_cls", "group_id"))
    groups = F.broadcast(groups) if small else groups
    return signed.select("doc_id", "text_hash", "n", "cls").join(groups, F.col("cls") == F.col("g_cls"), "left_outer").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"),
        F.when(F.col("g_cls").isNull(), F.col("doc_id")).otherwise(F.col("group_id")).alias("component_id")) \
        .withColumn("kept", same(F.col("doc_id"), F.col("component_id")))


def _class_sets(docs: DataFrame, classes: DataFrame, clusters: DataFrame, width: int, id_col: str,
                text_col: str) -> DataFrame:
    """``node, cls, n, payload`` (the whole set) of the clustered classes, from the text of one document of each."""
    chosen = classes.select("cls", "one").join(_small(clusters, BROADCAST_CLASSES), "cls") \
        .select("node", F.col("one.doc_id").alias("chosen_id"), F.col("one.text_hash").alias("chosen_hash"))
    wanted = _small(materialize(chosen, "near-chosen"))
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")) \
        .join(wanted, same(F.col("doc_id"), F.col("chosen_id")) & (F.col("text_hash") == F.col("chosen_hash"))) \
        .select("node", "text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()                                       # a row that is repeated gives its set once a task
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(at, BLOCK_DOCS)
                rows = []
                for k, items in enumerate(shingle_sets(part.column(1), width)):
                    cls = _class_id(items)
                    if cls not in seen:
                        seen.add(cls)
                        rows.append((k, cls, len(items), items.tobytes()))
                k, cls, n, payload = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(k, pa.int64())), pa.array(cls, pa.binary()), pa.array(n, pa.int64()),
                     pa.array(payload, pa.binary())], names=["node", "cls", "n", "payload"])

    return texts.mapInArrow(gather, "node bigint, cls binary, n bigint, payload binary")


def _small(written: DataFrame, rows: int | None = None) -> DataFrame:
    """A written table of ids and hashes, broadcast up to ``rows`` (BROADCAST_ROWS) rows, so that texts are not dealt
    by id; beyond that the join is a shuffle."""
    return F.broadcast(written) if written.count() <= (BROADCAST_ROWS if rows is None else rows) else written


def keep_one(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with all their columns."""
    gone = near_duplicates(docs, percent, id_col=id_col, text_col=text_col, **options).where(~F.col("kept"))
    gone = materialize(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")), "near-gone")
    gone = _small(gone)
    return docs.join(gone, same(docs[id_col], gone["gone_id"])
                     & (F.xxhash64(docs[text_col].cast("string")) == gone["gone_hash"]), "left_anti")
