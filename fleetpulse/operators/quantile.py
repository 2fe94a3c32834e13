"""Exact per-group quantiles with linear interpolation by radix selection.

``percentile()`` keeps every distinct value of a group in one aggregation
buffer, and a ranking window puts a whole group in one task; a fleet-day that
holds a third of all readings would then sit on one executor.  Here no value is
sorted or exchanged:

1. Every reading has an order-preserving 64-bit key (``order_key``: the bits
   of its double, negated below zero).
2. A pass counts, per group, the readings by the leading 16 bits of the key
   with partial aggregation: at most groups x 65,536 counters, whatever the
   number of readings.  The running sum of a group's counters shows which
   counter holds a wanted rank, and the rank that is left inside it.
3. A counter whose least and largest value are equal gives the value.  The next
   pass counts only readings of the other wanted counters, by the next 16 bits;
   after four passes every counter is one value.  Telemetry counters and short
   decimals are settled after one or two.

For a fraction ``f`` of a group with ``n`` values the quantile sits between
ranks ``floor(f*(n-1))`` and ``ceil(f*(n-1))``.  The result (groups x
fractions) is written to the shared checkpoint folder.

``value_spans`` gives the ranks of *all* values, for draws by rank: counted
values, range-partitioned into sorted slices that are offset by their counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.session import materialize

DIGIT = 16                      # bits counted in a pass
_MANTISSA = 2.0 ** 52
_LEAST_NORMAL = 2.0 ** -1022
_INFINITE = 0x7FF << 52


def order_key(value: Column) -> Column:
    """The 64 bits of a double as a long of the same order (0.0 and -0.0 alike, NaN above all); null stays null."""
    a = F.abs(value)
    two = lambda e: F.pow(F.lit(2.0), e)
    guess = F.floor(F.log2(a))                             # off by one next to powers of two
    e = F.when(two(guess) > a, guess - 1).when((guess < 1023) & (two(guess + 1) <= a), guess + 1).otherwise(guess)
    normal = (e + 1023) * F.lit(1 << 52) + ((a / two(e) - 1) * F.lit(_MANTISSA)).cast("long")
    bits = (F.when(F.isnan(value), F.lit(_INFINITE + 1)).when(a == float("inf"), F.lit(_INFINITE))
            .when(a < _LEAST_NORMAL, (a / F.lit(2.0 ** -1074)).cast("long")).otherwise(normal))
    return F.when(value < 0, -bits).otherwise(bits)


def _with_fractions(groups: DataFrame, group_cols: list[str], fractions) -> DataFrame:
    """Attach ``(qid, fraction)`` rows to every group."""
    if isinstance(fractions, DataFrame):
        # per-key fractions (a rulebase), one row per key and side
        return groups.join(fractions, [c for c in fractions.columns if c in group_cols])
    lits = [F.struct(F.lit(str(k)).alias("qid"), F.lit(float(v)).alias("fraction"))
            for k, v in dict(fractions).items()]
    return (groups.select("*", F.explode(F.array(*lits)).alias("_q"))
            .select(*groups.columns, "_q.qid", "_q.fraction"))


def exact_quantiles(df: DataFrame, group_cols: list[str], value_col: str, fractions) -> DataFrame:
    """Per-group quantiles ``(…group_cols, qid, quantile, n)``.

    ``fractions`` is either ``{qid: fraction}`` (same fractions for every group)
    or a DataFrame ``(…some group cols, qid, fraction)`` for per-key fractions
    (e.g. per item from the rulebase).  NULL values are ignored; groups without
    values produce no rows.  Interpolation: ``v_lo + (v_hi - v_lo) * (k - floor(k))``
    with ``k = f * (n - 1)``, the definition of ``numpy.percentile`` and DuckDB
    ``quantile_cont``.  ``df`` is read once a pass: pass a written table or a
    cheap plan over one.
    """
    values = df.select(*group_cols, F.col(value_col).cast("double").alias("_v")).where(F.col("_v").isNotNull()) \
        .withColumn("_key", order_key(F.col("_v")))
    bucket = lambda shift: F.call_function("shiftright", F.col("_key"), F.lit(shift))
    wanted, settled = None, None
    for shift in range(64 - DIGIT, -1, -DIGIT):
        rows, within = values, list(group_cols)
        if wanted is not None:                             # the readings of the counters still in question
            within = [*group_cols, "_bucket"]
            rows = values.withColumn("_bucket", bucket(shift + DIGIT)).join(wanted.select(*within).distinct(), within, "left_semi")
        counts = materialize(
            rows.groupBy(*within, bucket(shift).alias("_next")).agg(
                F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max")), "quantile-counts")
        if wanted is None:
            sizes = counts.groupBy(*group_cols).agg(F.sum("_c").alias("_n"))
            wanted = (_with_fractions(sizes, group_cols, fractions).withColumn("_k", F.col("fraction") * (F.col("_n") - 1))
                      .select(*group_cols, "qid", "_n", (F.col("_k") - F.floor("_k")).alias("_w"), F.explode(F.array(
                          F.struct(F.lit("lo").alias("side"), F.floor("_k").alias("rank")),
                          F.struct(F.lit("hi").alias("side"), F.ceil("_k").alias("rank")))).alias("_at"))
                      .select(*group_cols, "qid", "_n", "_w", F.col("_at.side").alias("_side"), F.col("_at.rank").alias("_rank")))
        running = Window.partitionBy(*within).orderBy("_next").rowsBetween(Window.unboundedPreceding, 0)
        spans = counts.withColumn("_to", F.sum("_c").over(running)).withColumn("_from", F.col("_to") - F.col("_c"))
        found = (wanted.join(spans, within).where((F.col("_from") <= F.col("_rank")) & (F.col("_rank") < F.col("_to")))
                 .select(*group_cols, "qid", "_n", "_w", "_side", (F.col("_rank") - F.col("_from")).alias("_rank"),
                         F.col("_next").alias("_bucket"), "_min", "_max"))
        found = materialize(found, "quantile-ranks")
        one = F.col("_min") == F.col("_max")
        done = found.where(one | F.lit(shift == 0))
        settled = done if settled is None else settled.unionByName(done)
        wanted = found.where(~one).drop("_min", "_max")
        if not shift or wanted.isEmpty():
            break
    side = lambda name: F.max(F.when(F.col("_side") == name, F.col("_min")))
    out = (settled.groupBy(*group_cols, "qid", "_n", "_w").agg(side("lo").alias("_a"), side("hi").alias("_b"))
           .select(*group_cols, "qid", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")).alias("quantile"),
                   F.col("_n").alias("n")))
    return materialize(out, "quantiles")


def value_spans(df: DataFrame, group_cols: list[str], value_col: str, n_slices: int | None = None) -> DataFrame:
    """The ranks ``from`` (included, from 0) to ``to`` (excluded) of every distinct value of each group:
    ``(…group_cols, value, from, to, n)``.  NULL values are ignored.

    A value that fills most of a group is one row; the distinct values of a group are dealt over sorted slices."""
    n_slices = n_slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = (df.select(*group_cols, F.col(value_col).cast("double").alias("value")).where(F.col("value").isNotNull())
              .groupBy(*group_cols, "value").agg(F.count(F.lit(1)).alias("_c")))
    sliced = materialize(counts.repartitionByRange(n_slices, *group_cols, "value")
                         .withColumn("_slice", F.spark_partition_id()), "span-values")
    by_group = Window.partitionBy(*group_cols)
    before = F.sum("_cnt").over(by_group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    seg = materialize(sliced.groupBy(*group_cols, "_slice").agg(F.sum("_c").alias("_cnt"))
                      .select(*group_cols, "_slice", F.coalesce(before, F.lit(0)).alias("_off"),
                              F.sum("_cnt").over(by_group).alias("n")), "span-slices")
    inside = Window.partitionBy(*group_cols, "_slice").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return (sliced.withColumn("_cum", F.sum("_c").over(inside)).join(seg, [*group_cols, "_slice"])
            .select(*group_cols, "value", (F.col("_off") + F.col("_cum") - F.col("_c")).alias("from"),
                    (F.col("_off") + F.col("_cum")).alias("to"), "n"))
