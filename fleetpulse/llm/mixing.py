"""Mixing sources to target weights by Pfair scheduling (native DataFrame plan).

Each component (a source named in ``weights``, or the rest) deals its documents
in blocks.  Time is counted in block slots.  The weights are taken as the exact
decimals they are written as and scaled to whole numbers ``w`` without a common
divisor; ``W`` is their sum.  Block ``j`` of a component is released at slot
``floor(j * W / w)`` and due by slot ``ceil((j + 1) * W / w)``.  In every slot
the released block with the earliest deadline goes next, so that after any slot
of a phase, however long it is, each component is less than one block away from
its weight times the slots.

The schedule repeats itself every ``W`` slots, so one *cycle* (as many whole
periods as fit ``CYCLE`` slots, one at least) is worked out once per phase, and
a document finds its slot by arithmetic.  When a component runs out, the
schedule is cut at its last block, and a new phase goes on with the others at
renormalised weights: every document gets a position.  No phase lays out more
slots than it has blocks, also where the period is longer (weights of many
digits); with such weights the plan grows with the number of blocks.

The rank of a document inside its component is found without gathering the
component: rows are dealt to slices by the leading digits of the md5 of the
id, ranked inside (component, slice), and offset by the counts of the earlier
slices.  The number of slices follows the row count, so a source with a third
of all rows is split like any other.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.session import materialize

BLOCK_DOCS = 64
CYCLE = 256
SLICE_ROWS = 20_000
LEAST_SLICES = 256              # a hot source is split in small tables, too
REST = "(rest)"


def shares(weights: dict[int, float]) -> dict[int, int]:
    """The weights as whole numbers without a common divisor: blocks of each component per period."""
    exact = {c: Fraction(str(w)) for c, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    whole = {c: int(x * scale) for c, x in exact.items()}
    divisor = math.gcd(*whole.values())
    return {c: n // divisor for c, n in whole.items()}


def edf_order(share: dict[int, int]) -> Iterator[tuple[int, int, int]]:
    """``component, release, deadline`` of slot after slot: earliest deadline first among the released blocks."""
    total, done = sum(share.values()), dict.fromkeys(share, 0)
    waiting, ready, t = [(0, c) for c in sorted(share)], [], 0
    while True:
        while waiting and waiting[0][0] <= t:
            release, c = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[c] + 1) * total // share[c]), c, release))
        deadline, c, release = heapq.heappop(ready)
        yield c, release, deadline
        done[c] += 1
        heapq.heappush(waiting, (done[c] * total // share[c], c))
        t += 1


def phases(blocks: dict[int, int], weights: dict[int, float], cycle: int = CYCLE) -> list[dict]:
    """Runs of alike cycles: ``start, length, cycles, quota{c}, first{c}`` (first block of c in the run), ``order``
    (``component, release, deadline`` of every slot of the cycle, counted from its start).

    Plain arithmetic over one number per component."""
    left, done, start, out = {c: n for c, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), 0, []

    def add(order: list[tuple[int, int, int]], cycles: int) -> None:
        nonlocal start
        quota = dict.fromkeys(left, 0)
        for c, _, _ in order:
            quota[c] += 1
        quota = {c: q for c, q in quota.items() if q}
        out.append({"start": start, "length": len(order), "cycles": cycles, "quota": quota, "first": dict(done),
                    "order": order})
        start += cycles * len(order)
        for c, q in quota.items():
            done[c] += cycles * q
            left[c] -= cycles * q

    while left:
        share = shares({c: weights[c] for c in left})
        period = sum(share.values())
        repeats = max(1, cycle // period)
        if full := min(left[c] // (repeats * share[c]) for c in left):
            add(list(islice(edf_order(share), repeats * period)), full)
        if all(left.values()):                             # up to the last block of the first to run out
            rest, order = dict(left), []
            for slot in edf_order(share):
                order.append(slot)
                rest[slot[0]] -= 1
                if not rest[slot[0]]:
                    break
            add(order, 1)
        left = {c: n for c, n in left.items() if n}
    return out


PLAN = ("array<struct<c:int,runs:array<struct<first:bigint,q:bigint,start:bigint,length:bigint,slots:array<bigint>,"
        "releases:array<bigint>,deadlines:array<bigint>>>,ends:array<struct<slot:bigint,gap:bigint>>>>")


def _plan(docs: DataFrame, counts: dict[int, int], weights: dict[int, float], block_docs: int, cycle: int) -> DataFrame:
    """One row per component: its runs of cycles with the slots of its blocks, and the short last blocks of all."""
    blocks = {c: -(-n // block_docs) for c, n in counts.items()}
    runs, last = {c: [] for c in counts}, {}
    for r in phases(blocks, weights, cycle):
        places = {c: [] for c in r["quota"]}
        for slot, (c, release, deadline) in enumerate(r["order"]):
            places[c].append((slot, release, deadline))
        for c, at in places.items():
            slots, releases, deadlines = zip(*at, strict=True)
            runs[c].append({"first": r["first"][c], "q": len(at), "start": r["start"], "length": r["length"],
                            "slots": slots, "releases": releases, "deadlines": deadlines})
            last[c] = r["start"] + (r["cycles"] - 1) * r["length"] + slots[-1]
    ends = [{"slot": last[c], "gap": blocks[c] * block_docs - counts[c]} for c in counts]
    # as many rows as there are components, from one text: a literal for each number would be slow to plan
    text = json.dumps([{"c": c, "runs": runs[c], "ends": ends} for c in counts], separators=(",", ":"))
    return materialize(docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(text), PLAN))), "mix-plan")


def _slot(runs: Column, block: Column) -> Column:
    """Slot, release and deadline of a component's block."""
    r = F.element_at(F.filter(runs, lambda x: x["first"] <= block), -1)
    k = block - r["first"]
    base, j = r["start"] + F.floor(k / r["q"]) * r["length"], (k % r["q"]).cast("int")
    return F.struct(*[(base + F.get(r[column], j)).alias(name) for column, name in (
        ("slots", "slot"), ("releases", "release"), ("deadlines", "deadline"))])


def free_name(docs: DataFrame, name: str) -> str:
    """``name`` with as many leading underscores as no column of ``docs`` has (letter case apart)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mix(docs: DataFrame, weights: dict[str, float], rest_weight: float = 1.0, block_docs: int = BLOCK_DOCS,
        cycle: int = CYCLE, id_col: str = "doc_id", source_col: str = "source", out: str = "mix") -> DataFrame:
    """``docs`` with one more column ``out``: a struct of ``component, block, release,
    deadline, slot, position`` (position: place of the document in the whole mix, from 0).
    Where ``docs`` has a column of that name, it stays as it is and the new one is
    called :func:`free_name` of it.

    ``weights`` gives the target weight of the named sources; all other
    sources, null included, form one component with ``rest_weight``.  Inside a
    component documents follow the md5 of their id, so a block is a random
    sample of its source; null ids come first, repeated ids stand together.  No
    row is dropped or repeated.  An empty table gives no rows.  Weights must be
    positive and finite.
    """
    if any(w <= 0 for w in [*weights.values(), rest_weight]):
        raise ValueError("target weights must be positive")
    out = free_name(docs, out)
    names = [*sorted(weights), REST]
    target = {c: weights.get(n, rest_weight) for c, n in enumerate(names)}
    number = F.create_map(*[x for c, n in enumerate(names[:-1]) for x in (F.lit(n), F.lit(c))]) if weights else None
    component = F.coalesce(F.try_element_at(number, F.col(source_col)) if weights else F.lit(None).cast("int"),
                           F.lit(len(names) - 1))
    slices = max(LEAST_SLICES, -(-docs.count() // SLICE_ROWS))
    digest = F.coalesce(F.md5(F.col(id_col).cast("string")), F.lit("0" * 32))
    part = F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * slices / F.lit(2.0 ** 32))
    rows = docs.select(F.struct("*").alias("doc"), component.alias("c"), digest.alias("h"), part.alias("slice"),
                       F.col(id_col).alias("doc_key"))

    sizes = rows.groupBy("c", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("c").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    sizes = materialize(sizes.select("c", "slice", "n", F.coalesce(before, F.lit(0)).alias("before")), "mix-slices")
    counts = {r["c"]: r["n"] for r in sizes.groupBy("c").agg(F.sum("n").alias("n")).collect()}  # a row per component
    shape = "struct<component:string,block:bigint,release:bigint,deadline:bigint,slot:bigint,position:bigint>"
    if not counts:
        return docs.select("*", F.lit(None).cast(shape).alias(out)).where(F.lit(False))
    plan = _plan(docs, counts, target, block_docs, cycle)

    ranked = rows.join(sizes.select("c", "slice", "before"), ["c", "slice"]).withColumn("rank", F.col("before") - 1 + (
        F.row_number().over(Window.partitionBy("c", "slice").orderBy("h", "doc_key"))))
    placed = ranked.withColumn("block", F.floor(F.col("rank") / block_docs)).join(plan, "c") \
        .withColumn("at", _slot(F.col("runs"), F.col("block")))
    gaps = F.aggregate(F.filter("ends", lambda e: e["slot"] < F.col("at.slot")), F.lit(0).cast("long"),
                       lambda acc, e: acc + e["gap"])
    result = F.struct(F.get(F.array(*[F.lit(n) for n in names]), F.col("c")).alias("component"), "block",
                      F.col("at.release").alias("release"), F.col("at.deadline").alias("deadline"),
                      F.col("at.slot").alias("slot"),
                      (F.col("at.slot") * block_docs - gaps + F.col("rank") % block_docs).alias("position")).cast(shape)
    return placed.select("doc.*", result.alias(out))


def mixed_order(docs: DataFrame, weights: dict[str, float], rest_weight: float = 1.0, **options) -> DataFrame:
    """``docs`` sorted by mix position (a range-partitioned sort; written files follow the order)."""
    name = free_name(docs, "mix")
    return mix(docs, weights, rest_weight, out=name, **options).orderBy(F.col(f"`{name}`.position")).drop(name)
