"""Tables behind the trend plots, density heatmaps, histograms and bar charts.

The figures themselves are not drawn here; every function returns the rows a
plotting client needs, computed on the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.functions.rules import rule_key
from fleetpulse.operators.quantile import exact_quantiles

# Fixed values of the plots.
TB_FACTOR = 512 * 1000 / (1024 ** 4)     # 512-byte units x 1000 -> TB
HIST_BINS = 50
HIST_QUANTILE = 0.99
AXIS_PAD = 0.1
AXIS_FALLBACK_MAX = 200.0                # density axis without Y_MAX at/below Y_MIN
HIST_FALLBACK_MAX = 10.0                 # histogram range when p99 <= 0
ZOOM_PREFIXES = ("Temp", "Avail")
BASELINE_AVAIL = 100.0
BASELINE_OTHER = 0.0


def to_tb(value: Column, y_format: Column) -> Column:
    return F.when(y_format == "TB", value * F.lit(TB_FACTOR)).otherwise(value)


def starts_with_any(item: Column, prefixes=ZOOM_PREFIXES) -> Column:
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | item.startswith(p)
    return cond


def heatmap_normaliser(density: DataFrame, keys: list[str]) -> DataFrame:
    """Max adjacent CDF difference over all days but the last, per ``keys``.

    ``keys`` excludes the date (e.g. ``[item]`` or ``[item, span]``).
    """
    wl = Window.partitionBy(*keys, "date").orderBy("layer")
    last = density.groupBy(*keys).agg(F.max("date").alias("_last"))
    d = density.select(*keys, "date", (F.lead("cdf").over(wl) - F.col("cdf")).alias("delta")).join(last, keys)
    return d.where(F.col("date") < F.col("_last")).groupBy(*keys).agg(F.max("delta").alias("norm"))


def heatmap_cells(density: DataFrame, keys: list[str]) -> DataFrame:
    """One cell per (day j but the last, layer i < 99): the band between layers
    i and i+1 from day j to the next day, coloured by the CDF step.

    Columns: ``…keys, date, next_date, layer, delta, colour, opacity, alpha,
    x_lo, x_hi, next_x_lo, next_x_hi``.  Items whose normaliser is NULL (no
    density on any day) have no cells; NULL CDF values count as 0.
    """
    norm = heatmap_normaliser(density, keys).where(F.col("norm").isNotNull())
    wl = Window.partitionBy(*keys, "date").orderBy("layer")
    d = (density.withColumn("cdf0", F.coalesce(F.col("cdf"), F.lit(0.0)))
         .withColumn("delta", F.lead("cdf0").over(wl) - F.col("cdf0"))
         .withColumn("x_hi", F.lead("x").over(wl)))
    days = density.select(*keys, "date").distinct()
    nxt = days.withColumn("next_date", F.lead("date").over(Window.partitionBy(*keys).orderBy("date")))
    nd = d.select(*keys, F.col("date").alias("next_date"), "layer",
                  F.col("x").alias("next_x_lo"), F.col("x_hi").alias("next_x_hi"))
    cells = (d.where(F.col("layer") < 99)
             .join(nxt.where(F.col("next_date").isNotNull()), [*keys, "date"])
             .join(nd, [*keys, "next_date", "layer"])
             .join(norm, keys))
    ratio = F.col("delta") / F.col("norm")
    return cells.select(*keys, "date", "next_date", "layer", "delta",
                        ((F.lit(1.0) - ratio) * 0.8 + 0.2).alias("colour"),
                        ratio.alias("opacity"), (ratio * 0.9 + 0.1).alias("alpha"),
                        F.col("x").alias("x_lo"), "x_hi", "next_x_lo", "next_x_hi")


def axis_bounds(density: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Trend-plot y range ``(…keys, axis_min, axis_max)`` from the density grid.

    Grid max (after TB conversion) capped by Y_MAX (Temp* items: exactly
    Y_MAX); without Y_MAX a max at or below Y_MIN becomes 200; 10 % padding.
    """
    g = (density.join(rules, rule_key(F.col("item")) == rules["rule_item"])
         .groupBy(*keys, "y_format", "y_min", "y_max")
         .agg(F.max(to_tb(F.col("x"), F.col("y_format"))).alias("vmax")))
    vm = (F.when(F.col("y_max").isNotNull(),
                 F.when(F.col("item").startswith("Temp"), F.col("y_max"))
                  .otherwise(F.least(F.col("vmax"), F.col("y_max"))))
          .otherwise(F.when(F.col("vmax") <= F.col("y_min"), F.lit(AXIS_FALLBACK_MAX)).otherwise(F.col("vmax"))))
    g = g.withColumn("vm", vm)
    pad = (F.col("vm") - F.col("y_min")) * AXIS_PAD
    return g.select(*keys, (F.col("y_min") - pad).alias("axis_min"), (F.col("vm") + pad).alias("axis_max"))


def trend_points(cells: DataFrame, drives: DataFrame, rules: DataFrame, serial: str,
                 no_density_items: DataFrame | None = None) -> DataFrame:
    """Points of the trend lines of listed drives.

    ``(…span, …class, item, serial, date, value, single_point, in_zoom)``: NULL
    readings dropped, TB conversion applied, ``single_point`` when the drive has
    one point for the item, ``in_zoom`` when the item starts with Temp/Avail or
    has no density.  Cells may carry a ``span``, drives a ``class``: all spans
    and classes are then one pass, and points count within their own.
    """
    by = [c for c, t in (("span", cells), ("class", drives)) if c in t.columns]
    listed = drives.select("item", serial, *[c for c in by if c == "class"]).distinct()
    pts = (cells.join(listed, ["item", serial]).where(F.col("value").isNotNull())
           .join(rules, rule_key(F.col("item")) == rules["rule_item"], "left"))
    w = Window.partitionBy(*by, "item", serial)
    zoom = starts_with_any(F.col("item"))
    if no_density_items is not None:
        pts = pts.join(no_density_items.select("item").distinct().withColumn("_nd", F.lit(True)), "item", "left")
        zoom = zoom | F.coalesce(F.col("_nd"), F.lit(False))
    return pts.select(*by, "item", serial, "date", to_tb(F.col("value"), F.col("y_format")).alias("value"),
                      (F.count(F.lit(1)).over(w) == 1).alias("single_point"), zoom.alias("in_zoom"))


def with_spans(cells: DataFrame, cutoff: DataFrame) -> DataFrame:
    """Cells labelled ``long``, and once more ``short`` from the cutoff day on."""
    start = cutoff.select("cutoff").scalar()
    return cells.withColumn("span", F.explode(F.array_compact(F.array(
        F.lit("long"), F.when(F.col("date") >= start, F.lit("short"))))))


def newest_density(density: DataFrame, batch: str, keys=("item",)) -> DataFrame:
    """One density per (item, day): where weekly files share a day, the newest batch's."""
    newest = density.groupBy(*keys, "date").agg(F.max(batch).alias(batch))
    return density.join(newest, [*keys, "date", batch])


def baseline(dates: DataFrame, items: DataFrame, quiet_items: DataFrame) -> DataFrame:
    """Constant line for items with no critical, no warning and no density.

    ``dates``: ``(date)`` of the plot; ``quiet_items``: ``(item)``.
    Result ``(item, date, baseline)``: 100 for Avail* items, else 0.  The plot
    dates enter as one scalar subquery (an array of days), not as a join.
    """
    day_list = dates.select(F.sort_array(F.collect_set("date"))).scalar()
    q = items.select("item").distinct().join(quiet_items, "item", "left_semi")
    return q.select("item", F.explode(day_list).alias("date"),
                    F.when(F.col("item").startswith("Avail"), F.lit(BASELINE_AVAIL))
                    .otherwise(F.lit(BASELINE_OTHER)).alias("baseline"))


def histogram_range(values: DataFrame, rules: DataFrame) -> DataFrame:
    """``(item, axis_min, axis_max)`` from the exact 99th percentile and the rule."""
    q = exact_quantiles(values, ["item"], "value", {"p99": HIST_QUANTILE})
    g = q.join(rules, rule_key(F.col("item")) == rules["rule_item"])
    m = (F.when(F.col("y_max").isNotNull(), F.greatest(F.col("quantile"), F.col("y_max")))
         .otherwise(F.when(F.col("quantile") <= 0, F.lit(HIST_FALLBACK_MAX)).otherwise(F.col("quantile"))))
    g = g.withColumn("m", m)
    pad = (F.col("m") - F.col("y_min")) * AXIS_PAD
    lo = F.greatest(F.lit(0.0), F.col("y_min") - pad)
    hi = F.col("m") + pad
    return g.select("item", lo.alias("axis_min"), hi.alias("axis_max"))


def histogram(values: DataFrame, ranges: DataFrame, bins: int = HIST_BINS) -> DataFrame:
    """Equal-width histogram ``(item, bin, bin_lo, bin_hi, n)`` over each item's range.

    Values outside the range are not counted; the last bin is closed; a
    zero-width range is widened by 0.5 on both sides.
    """
    rg = (ranges.withColumn("lo", F.when(F.col("axis_min") == F.col("axis_max"), F.col("axis_min") - 0.5)
                            .otherwise(F.col("axis_min")))
          .withColumn("hi", F.when(F.col("axis_min") == F.col("axis_max"), F.col("axis_max") + 0.5)
                      .otherwise(F.col("axis_max")))
          .withColumn("step", (F.col("hi") - F.col("lo")) / F.lit(bins)))

    def edge(k):
        return F.when(k >= bins, F.col("hi")).otherwise(F.col("lo") + k * F.col("step"))

    v = (values.join(rg, "item")
         .where((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi"))))
    i0 = F.least(F.floor((F.col("value") - F.col("lo")) * (F.lit(bins) / (F.col("hi") - F.col("lo")))).cast("int"),
                 F.lit(bins - 1))
    v = v.withColumn("_i", i0)
    v = v.withColumn("_i", F.when(F.col("value") < edge(F.col("_i")), F.col("_i") - 1).otherwise(F.col("_i")))
    v = v.withColumn("_i", F.when((F.col("value") >= edge(F.col("_i") + 1)) & (F.col("_i") != bins - 1),
                                  F.col("_i") + 1).otherwise(F.col("_i")))
    counts = v.groupBy("item", F.col("_i").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = rg.select("item", "lo", "hi", "step", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (grid.join(counts, ["item", "bin"], "left")
            .select("item", "bin", edge(F.col("bin")).alias("bin_lo"), edge(F.col("bin") + 1).alias("bin_hi"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def value_counts(values: DataFrame, value_col: str = "value") -> DataFrame:
    """Bar-chart data ``(item, value, n)`` of non-null readings."""
    return (values.where(F.col(value_col).isNotNull())
            .groupBy("item", value_col).agg(F.count(F.lit(1)).alias("n")))
