"""Daily density of the normal population: Gaussian KDE evaluated on a
100-point grid and integrated into a CDF, per ``(…batch, item, date)``.

Semantics per group (the normal readings of one item on one day):

1. drop NULLs; keep values inside the exact 0.01 % / 99.99 % percentiles;
2. z-score with the mean and population std (identity when std is 0);
3. grid ``x_i = z_min + i * (z_max - z_min) / 99``, ``i = 0..99``
   (``x_99 = z_max`` exactly);
4. if ``x_99 - x_0 <= 1e-3`` the day is constant: every ``x`` is ``x_99``
   and there is no density (``cdf`` NULL);
5. else ``pdf(x) = 1/(n sqrt(2 pi)) * sum_j exp(-(x - z_j)^2 / 2)`` (bandwidth 1);
6. ``cdf_i`` = trapezoid area from ``x_0`` to ``x_min(i+1, 99)``, divided by the
   total, so ``cdf_0 > 0`` and the last two entries are 1;
7. ``x`` is scaled back: ``x * std + mean``.

Plan: the kernel sums are a fast Gauss transform.  The z values of a group fall
into cells of width 1; a cell keeps the first 16 Hermite moments of its
readings, ``sum(u^n / n!)`` with ``u`` the distance from its centre over sqrt(2).
They are plain sums, so they combine in the map tasks, and what is exchanged is
groups x cells, however many distinct values there are.  The grid is then
evaluated from the moments of the cells within 9 standard deviations.  The
error of a kernel of height 1 is below ``1.09 * 2 * 0.5^16 / sqrt(16!)`` = 8e-12
for the moments (Cramer's bound of the Hermite functions), and 3e-16 for the
cells left out, so the density is right to 1e-11 of its largest possible value.
Group statistics (one row per group) are written once and broadcast by their
file size.

``draw_share=s`` fits the kernel sums on ``n // s`` readings drawn *with
replacement* from the ``n`` of the group, as the reference samples: draw ``d``
takes the reading of rank ``draw_rank(group, d, n)`` in ascending order.  Ranks
and draws meet inside blocks of 65,536 ranks, so a hot day is spread.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.operators.quantile import exact_quantiles, value_spans
from fleetpulse.session import materialize

# Fixed values of the density step.
N_LAYERS = 100
TRIM_LOW = 0.0001      # 0.01 percentile
TRIM_HIGH = 0.9999     # 99.99 percentile
MIN_WIDTH = 1e-3       # grid narrower than this (in z units) -> constant day
BANDWIDTH = 1.0

MOMENTS = 16           # Hermite moments of a cell
REACH = 9.0            # cells farther from a grid point add less than 3e-16 of a kernel
RANK_BLOCK = 1 << 16   # ranks that draws and values meet in
DRAW_BLOCK = 10_000    # draws numbered at a time


def zscore(value, mean, std):
    return F.when(std != 0, (value - mean) / std).otherwise(value)


def group_stats(normal: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(trimmed readings, per-group statistics)."""
    trim = exact_quantiles(normal, keys, "value", {"t_lo": TRIM_LOW, "t_hi": TRIM_HIGH})
    trim = (trim.groupBy(*keys)
            .agg(F.max(F.when(F.col("qid") == "t_lo", F.col("quantile"))).alias("t_lo"),
                 F.max(F.when(F.col("qid") == "t_hi", F.col("quantile"))).alias("t_hi")))
    trimmed = (normal.join(trim, keys)
               .where(F.col("value").between(F.col("t_lo"), F.col("t_hi")))
               .drop("t_lo", "t_hi"))
    stats = (trimmed.groupBy(*keys)
             .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mu"),
                  F.stddev_pop("value").alias("sd"), F.min("value").alias("vmin"),
                  F.max("value").alias("vmax")))
    stats = (stats.withColumn("z0", zscore(F.col("vmin"), F.col("mu"), F.col("sd")))
             .withColumn("z1", zscore(F.col("vmax"), F.col("mu"), F.col("sd")))
             .withColumn("step", (F.col("z1") - F.col("z0")) / F.lit(N_LAYERS - 1))
             .withColumn("flat", (F.col("z1") - F.col("z0")) <= F.lit(MIN_WIDTH)))
    return trimmed, materialize(stats, "density-stats")


def grid_x(layer):
    """Grid point ``i`` in z units (the last one is exactly ``z_max``)."""
    return (F.when(F.col("flat") | (layer == N_LAYERS - 1), F.col("z1"))
            .otherwise(F.col("z0") + layer * F.col("step")))


def sample_number(serial, date):
    """A number for sampling that any SQL engine can work out: 32 bits of the md5 of drive and day."""
    key = F.concat_ws("|", serial.cast("string"), date.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def draw_rank(keys: list[str], draw: Column, n: Column) -> Column:
    """The rank that a draw of a group takes: 52 bits of the md5 of group and draw, modulo ``n``."""
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], draw.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") % n


def drawn_readings(readings: DataFrame, keys: list[str], share: int) -> DataFrame:
    """``n // share`` draws with replacement from the ``n`` readings of every group: ``(…keys, value)``."""
    spans = materialize(value_spans(readings, keys, "value"), "draw-spans")
    sizes = spans.groupBy(*keys).agg(F.first("n").alias("n")).withColumn("m", F.floor(F.col("n") / share)).where("m > 0")
    blocks = materialize(sizes.select(*keys, "n", "m", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("m") - 1) / DRAW_BLOCK))).alias("b")), "draw-blocks")
    numbers = F.sequence(F.col("b") * DRAW_BLOCK, F.least((F.col("b") + 1) * DRAW_BLOCK, F.col("m")) - 1)
    draws = blocks.repartition(*keys, "b").select(*keys, "n", F.explode(numbers).alias("draw")) \
        .select(*keys, draw_rank(keys, F.col("draw"), F.col("n")).alias("rank"))

    # as of: a draw takes the last value that begins at its rank or before; that is in its block of ranks, or
    # the last value that begins in the blocks before
    events = draws.select(*keys, "rank", F.lit(True).alias("drawn"), F.lit(None).cast("double").alias("value")).unionByName(
        spans.select(*keys, F.col("from").alias("rank"), F.lit(False).alias("drawn"), "value"))
    events = materialize(events.withColumn("block", F.floor(F.col("rank") / RANK_BLOCK)), "draw-events")
    last = F.max_by("value", F.when(~F.col("drawn"), F.col("rank")))
    carried = F.last("last", ignorenulls=True).over(
        Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    ahead = materialize(events.groupBy(*keys, "block").agg(last.alias("last")).select(*keys, "block", carried.alias("carried")), "draw-blocks")
    inside = Window.partitionBy(*keys, "block").orderBy("rank", "drawn").rowsBetween(Window.unboundedPreceding, 0)
    held = events.withColumn("here", F.last("value", ignorenulls=True).over(inside)).where("drawn")
    return held.join(ahead, [*keys, "block"]).select(*keys, F.coalesce("here", "carried").alias("value"))


def cell_moments(readings: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """``(…keys, centre, moments)`` of the cells of width 1 that have readings."""
    placed = (readings.join(stats.where(~F.col("flat")).select(*keys, "mu", "sd", "z0"), keys)
              .withColumn("z", zscore(F.col("value"), F.col("mu"), F.col("sd")))
              .withColumn("cell", F.floor(F.col("z") - F.col("z0")))
              .select(*keys, (F.col("z0") + F.col("cell") + 0.5).alias("centre"), "z")
              .select(*keys, "centre", ((F.col("z") - F.col("centre")) / (math.sqrt(2) * BANDWIDTH)).alias("u")))
    powers = [F.lit(1.0), F.col("u")]
    for n in range(2, MOMENTS):
        powers.append(powers[n // 2] * powers[n - n // 2])
    sums = [F.sum(p / F.lit(float(math.factorial(n)))).alias(f"m{n}") for n, p in enumerate(powers)]
    return placed.groupBy(*keys, "centre").agg(*sums).select(
        *keys, "centre", F.array(*[F.col(f"m{n}") for n in range(MOMENTS)]).alias("moments"))


def kernel_sum(moments: Column, x: Column, centre: Column) -> Column:
    """Sum of ``exp(-(x - z)^2 / 2)`` over a cell's readings: its moments times the Hermite functions at ``x``,
    which follow from one another, ``h_(n+1) = 2 t h_n - 2 n h_(n-1)``."""
    t = (x - centre) / (math.sqrt(2) * BANDWIDTH)
    start = F.struct(F.lit(0.0).alias("before"), F.exp(-t * t).alias("now"), F.lit(0.0).alias("n"), F.lit(0.0).alias("sum"))
    step = lambda s, m: F.struct(
        s["now"].alias("before"), (2 * t * s["now"] - 2 * s["n"] * s["before"]).alias("now"), (s["n"] + 1).alias("n"),
        (s["sum"] + m * s["now"]).alias("sum"))
    return F.aggregate(moments, start, step, lambda s: s["sum"])


def daily_density(normal: DataFrame, serial: str, batch: str | None = None,
                  sample_modulus: int | None = None, draw_share: int | None = None) -> DataFrame:
    """``(…batch, item, date, layer, x, cdf)`` for every day with readings.

    ``draw_share=s`` fits the kernel sums on one reading in ``s``, drawn with replacement, and
    ``sample_modulus=m`` on the drives with ``sample_number(serial, date) % m == 0`` only; both are
    deterministic, and the statistics and grid still come from every reading.  A day without sampled
    readings has no density.
    """
    keys = ([batch] if batch and batch in normal.columns else []) + ["item", "date"]
    # The population is read by the trim quantiles, the statistics and the
    # kernel sums: write its needed columns once instead of re-running the
    # anti joins that define it.
    normal = materialize(normal.select(*keys, serial, "value"), "normal-population")
    trimmed, stats = group_stats(normal, keys)
    st = stats     # materialised, one row per group: the planner broadcasts it by file size

    sample = trimmed
    if draw_share:
        sample = drawn_readings(trimmed, keys, draw_share)
    elif sample_modulus:
        sample = trimmed.where(sample_number(F.col(serial), F.col("date")) % sample_modulus == 0)

    # every cell with the grid points within its reach
    layer = F.col("layer")
    reach = lambda side: (F.col("centre") + side * (REACH + 0.5) - F.col("z0")) / F.col("step")
    low = F.greatest(F.ceil(reach(-1)), F.lit(0)).cast("int")
    high = F.least(F.floor(reach(1)), F.lit(N_LAYERS - 1)).cast("int")
    cells = cell_moments(sample, st, keys).join(st.select(*keys, "z0", "z1", "step", "flat"), keys)
    terms = (cells.select("*", F.explode(F.sequence(low, high)).alias("layer"))
             .select(*keys, "layer", kernel_sum(F.col("moments"), grid_x(layer), F.col("centre")).alias("k")))
    sums = terms.groupBy(*keys, "layer").agg(F.sum("k").alias("ksum"))

    grid = (stats.select(*keys, "n", "mu", "sd", "z0", "z1", "step", "flat",
                         F.explode(F.sequence(F.lit(0), F.lit(N_LAYERS - 1))).alias("layer"))
            .withColumn("gx", grid_x(layer)))
    dens = (grid.join(sums, [*keys, "layer"], "left")
            .withColumn("pdf", F.when(~F.col("flat"),
                                      F.coalesce(F.col("ksum"), F.lit(0.0))
                                      / (F.col("n") * F.lit(math.sqrt(2 * math.pi) * BANDWIDTH)))
                        .otherwise(F.lit(1.0))))
    w = Window.partitionBy(*keys).orderBy("layer")
    dens = (dens.withColumn("area", (F.lead("gx").over(w) - F.col("gx"))
                            * (F.lead("pdf").over(w) + F.col("pdf")) / 2)
            .withColumn("cum", F.sum("area").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("total", F.max("cum").over(Window.partitionBy(*keys))))
    return dens.select(*keys, "layer",
                       (F.col("gx") * F.col("sd") + F.col("mu")).alias("x"),
                       F.when(F.col("total") > 0, F.col("cum") / F.col("total")).alias("cdf"))
