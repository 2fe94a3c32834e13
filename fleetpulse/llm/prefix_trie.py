"""Prefix trie of conversations by van Emde Boas recursion on the depth.

A conversation is a sequence of turns; a turn is a 128-bit digest of role and
text, mixed with its position.  The name of a prefix is the exclusive or of its
turns' digests, so the name of a *block* of turns needs no order, and the name
at the end of a block is the name at its beginning, xor the block.

1. *Blocks.*  The aligned blocks of 2^k turns of every conversation, one
   aggregate for all k.
2. *Down.*  Equal conversations are one piece with a count.  For k from the
   half of the longest depth to 0 every piece of 2^k turns and more is cut after
   2^k turns.  The cut prefixes are named; pieces that agree up to the cut go on
   as one in the upper trie, what follows the cut goes on in the lower forest
   of that name.  All upper tries and lower forests of a level are cut by the
   same job, at k = 0 a piece is one turn and the names are the nodes.
   Each level leaves its jumps: the nodes at depths that 2^k divides, with the
   ancestor 2^k turns above.
3. *Up.*  The totals of a lower forest are grafted on the cut nodes: a node's
   total over the 2^(k+1) turns below it is that over the first 2^k and, by the
   jumps, those of the nodes there.  A second pass from large k to small gives
   every node the total of its whole subtree.

A level is a few joins of unique keys and sums with partial aggregation, and
there are as many levels as the longest conversation's length has bits.  The
texts never move: they are digested in the scan.  A conversation of any length
is dealt over slices, a node with any number of members is only counted.  The
digest of a node's ends streams its members' ids in order, in chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import dealt
from fleetpulse.session import materialize

BORROWED = 6                    # a conversation takes crc32 % BORROWED turns of its base
FAMILY = 100                    # ids of one base
SLICE_ROWS = 50_000
CHUNK_BITS = 12                 # 4096 ids joined at a time for the digest of ends


def turn_rows(conversations: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``conv_id, pos, length, tok, chars`` of every rebuilt turn, and a row with ``pos`` null for each
    conversation that has none.

    Rows are dealt to slices by range, so that a conversation with any share of all rows is spread; places
    are counted inside (conversation, slice) and moved on by the counts of the earlier slices."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = materialize(conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.unhex(F.left(digest, F.lit(32))).alias("tok"),
        F.length(text).cast("long").alias("chars")), "trie-digests")
    cut, spans = dealt(rows, "conv_id", ["turn", "tok"], slice_rows)
    conv = F.col("conv_id")
    convs = spans.where("before = 0").select(
        "conv_id", F.col("size").alias("own"), (F.crc32(conv.cast("string")) % BORROWED).alias("h"), (conv - conv % FAMILY).alias("base"))
    bases = convs.where(F.col("conv_id") == F.col("base")).select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    convs = convs.join(bases, "base", "left_outer").withColumn("shift", F.least("h", F.coalesce("there", F.lit(0)))) \
        .withColumn("length", F.col("shift") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = materialize(convs.select("conv_id", "base", "h", "shift", "length"), "trie-convs")

    placed = materialize(cut.join(spans.join(convs, "conv_id"), ["conv_id", "slice"]).select(
        "conv_id", "base", "h", "shift", "length", "tok", "chars", (F.col("before") + F.col("inside") - 1).alias("at")), "trie-turns")
    own = placed.where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("shift")).alias("pos"), "length", "tok", "chars")
    heads = placed.where((F.col("at") < BORROWED - 1) & (F.col("conv_id") == F.col("base"))).select(
        "base", F.col("at").alias("pos"), "tok", "chars")
    borrowed = convs.where("h > 0").join(heads, "base").where("pos < h").select("conv_id", "pos", "length", "tok", "chars")
    none = convs.where("length = 0").select(
        "conv_id", F.lit(None).cast("long").alias("pos"), "length", F.lit(None).cast("binary").alias("tok"),
        F.lit(0).cast("long").alias("chars"))
    return own.unionByName(borrowed).unionByName(none)


def _shift(x: Column, k) -> Column:
    return F.call_function("shiftright", x, k if isinstance(k, Column) else F.lit(k))


def _bits(x: Column) -> Column:
    """Position of the highest bit."""
    return F.length(F.bin(x)) - 1


def _blocks(rows: DataFrame) -> DataFrame:
    """``k, conv_id, j, b1, b2, chars``: the aligned full blocks of 2^k turns, with the length of the last one's text."""
    full = F.filter(F.sequence(F.lit(0), _bits(F.col("length"))),
                    lambda k: F.call_function("shiftleft", _shift(F.col("pos"), k) + 1, k) <= F.col("length"))
    each = rows.where("pos IS NOT NULL").select(
        "conv_id", "pos", "chars", F.explode(full).alias("k"),
        *[F.xxhash64(F.lit(seed), "pos", "tok").alias(f"b{seed}") for seed in (1, 2)])
    return each.groupBy("conv_id", "k", _shift(F.col("pos"), F.col("k")).alias("j")).agg(
        F.bit_xor("b1").alias("b1"), F.bit_xor("b2").alias("b2"), F.max_by("chars", "pos").alias("chars"))


def _whole(rows: DataFrame) -> DataFrame:
    """``conv_id, length, w1, w2``: the name of each whole conversation."""
    name = [F.bit_xor(F.when(F.col("pos").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(s), "pos", "tok"))).alias(f"w{s}")
            for s in (1, 2)]
    return rows.groupBy("conv_id", "length").agg(*name)


def _end_digests(whole: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """``ends, ends_sha256``: least id and digest of the ids of each group of equal conversations."""
    chunk = _shift(F.col("conv_id"), chunk_bits)
    chunks = whole.groupBy("length", "w1", "w2", chunk.alias("chunk")).agg(
        F.min("conv_id").alias("least"), F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = least = state = None
        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for *k, first, ids in zip(*columns, strict=True):
                if k != key:
                    if key is not None:
                        out.append((least, state.hexdigest()))
                    key, least, state = k, first, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _ends(out)
        if key is not None:
            yield _ends([(least, state.hexdigest())])

    def _ends(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())],
                                          names=["ends", "ends_sha256"])

    keys = ["length", "w1", "w2"]
    return chunks.repartition(*keys).sortWithinPartitions(*keys, "chunk").select(*keys, "least", "ids") \
        .mapInArrow(digest, "ends bigint, ends_sha256 string")


NAME = ["q1", "q2"]             # of a node
ABOVE = ["p1", "p2"]            # of the node where its piece begins


def _name_nodes(pieces: DataFrame, blocks: DataFrame, top: int) -> list[DataFrame]:
    """The jumps of every level: ``depth, q1, q2`` of the nodes at depths that 2^k divides, ``p1, p2`` of the
    ancestor 2^k turns above, ``c`` (least member), ``n`` (members), ``ends`` (group that ends there), ``chars``."""
    waiting, jumps = [pieces], [None] * (top + 1)
    for k in range(top, -1, -1):
        half = 1 << k
        active = waiting[0].where(F.col("level") == k)
        for w in waiting[1:]:
            active = active.unionByName(w.where(F.col("level") == k))
        level = blocks.where(F.col("k") == k).select(
            F.col("conv_id").alias("c"), F.col("j").alias("begin_j"), "b1", "b2", F.col("chars").alias("b_chars"))
        cut = active.withColumn("begin_j", _shift(F.col("begin"), k)).join(level, ["c", "begin_j"])
        cut = materialize(cut.select(
            "begin", "p1", "p2", "c", "n", "length", "ends", "z1", "z2", "chars", "b_chars",
            F.col("p1").bitwiseXOR(F.col("b1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("b2")).alias("q2")), "trie-cut")
        first = cut.select("begin", "p1", "p2", "q1", "q2", "c", "n", F.when(F.col("length") == half, F.col("ends")).alias("ends"),
                           F.col("b_chars").alias("chars"))
        # a piece that fills both halves: the second begins at the cut and ends where the piece does
        second = cut.where(F.col("length") == 2 * half).select(
            (F.col("begin") + half).alias("begin"), F.col("q1").alias("p1"), F.col("q2").alias("p2"),
            F.col("z1").alias("q1"), F.col("z2").alias("q2"), "c", "n", "ends", "chars")
        upper = first.unionByName(second).groupBy("begin", "p1", "p2", "q1", "q2").agg(
            F.min("c").alias("c"), F.sum("n").alias("n"), F.max("ends").alias("ends"), F.max("chars").alias("chars"))
        jumps[k] = materialize(upper.withColumn("depth", F.col("begin") + half).drop("begin"), "trie-jumps")
        if not k:
            break
        # the upper tries' pieces are full at the next level
        waiting.append(jumps[k].select(
            (F.col("depth") - half).alias("begin"), "p1", "p2", "c", "n", F.lit(half).cast("long").alias("length"), "ends",
            F.col("q1").alias("z1"), F.col("q2").alias("z2"), "chars", F.lit(k - 1).alias("level")))
        rest = F.col("length") - half
        waiting.append(cut.where((rest > 0) & (rest < half)).select(
            (F.col("begin") + half).alias("begin"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), "c", "n",
            rest.alias("length"), "ends", "z1", "z2", "chars", _bits(rest).alias("level")))
    return jumps


def _subtree_totals(nodes: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """``depth, q1, q2, leaves, saved``: sums over all nodes below a node (nodes without any below are left out)."""
    key = ["depth", *NAME]

    def summed(df: DataFrame) -> DataFrame:
        return df.groupBy(*key).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    def lifted(totals: DataFrame, k: int) -> DataFrame:
        """The totals of nodes, at their ancestors 2^k above."""
        up = totals.join(jumps[k].select(*key, *ABOVE), key)
        return up.select((F.col("depth") - (1 << k)).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), "leaves", "saved")

    odd = lambda k: _shift(F.col("depth"), k) % 2 == 1
    # up: totals over the 2^k turns below each node at a depth that 2^k divides
    below = [materialize(summed(nodes.where("depth > 0").select(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
        (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("chars")).alias("saved"))), "trie-below")]
    for k in range(len(jumps)):
        t = below[k]
        below.append(materialize(summed(t.where(~odd(k)).unionByName(lifted(t.where(odd(k)), k))), "trie-below"))
    # down: whole subtrees, of the depths that only 2^k divides
    known = below[-1]
    for k in range(len(jumps) - 1, -1, -1):
        deeper = known.where((F.col("depth") > 0) & (F.col("depth") % (2 << k) == 0))
        known = known.unionByName(materialize(summed(below[k].where(odd(k)).unionByName(lifted(deeper, k))), "trie-subtrees"))
    return known


def prefix_trie(conversations: DataFrame, slice_rows: int = SLICE_ROWS, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """The nodes of the trie over the rebuilt conversations: ``conv_id`` (smallest member), ``depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Turns stand by ``turn`` (null first), equal ones by a digest of role and text, repeated rows one after the
    other; null role or text is empty.  Conversation c gets the first h turns of conversation c - c % 100 and
    its own after its first h, h = crc32(decimal c) % 6.  Rows without a conversation id belong to none and are
    left out.  Other columns are ignored.  Without conversations there is no node, not even the root.
    """
    rows = materialize(turn_rows(conversations, slice_rows), "trie-rows")
    whole = materialize(_whole(rows), "trie-whole")
    blocks = materialize(_blocks(rows), "trie-blocks")
    groups = materialize(whole.groupBy("length", "w1", "w2").agg(F.min("conv_id").alias("c"), F.count(F.lit(1)).alias("n")), "trie-groups")
    longest = groups.agg(F.max("length")).first()[0] or 0

    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = groups.agg(F.min("c").alias("c"), F.sum("n").alias("n"), F.max(F.when(F.col("length") == 0, F.col("c"))).alias("ends")) \
        .where("n > 0").select(none.alias("p1"), none.alias("p2"), zero.alias("q1"), zero.alias("q2"), "c", "n", "ends",
                               zero.alias("chars"), zero.alias("depth"))
    jumps = []
    if longest:
        pieces = groups.where("length > 0").select(
            zero.alias("begin"), zero.alias("p1"), zero.alias("p2"), "c", "n", "length", F.col("c").alias("ends"),
            none.alias("z1"), none.alias("z2"), none.alias("chars"), _bits(F.col("length")).alias("level"))
        jumps = _name_nodes(pieces, blocks, longest.bit_length() - 1)
        root = root.unionByName(jumps[0])
    children = root.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2")) \
        .agg(F.count(F.lit(1)).alias("n_children"))
    key = ["depth", *NAME]
    nodes = materialize(root.join(children, key, "left_outer").withColumn("n_children", F.coalesce("n_children", zero)), "trie-nodes")

    totals = _subtree_totals(nodes, jumps) if jumps else nodes.select(*key, zero.alias("leaves"), zero.alias("saved")).where(F.lit(False))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"),
                         F.col("c").alias("parent_conv_id"))
    digests = _end_digests(whole, chunk_bits)
    return nodes.join(totals, key, "left_outer").join(digests, "ends", "left_outer").join(above, ["depth", *ABOVE], "left_outer").select(
        F.col("c").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        (F.coalesce("leaves", zero) + (F.col("n_children") == 0).cast("long")).alias("n_leaves"),
        (F.coalesce("saved", zero) + (F.col("n") - 1) * F.col("chars")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
