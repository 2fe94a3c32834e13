"""Trend, heatmap, histogram and bar-chart data from the screening results.

``trend_data`` is the history step: drives listed in the latest result sets
of any trend item, their whole history (identity fixed), the short window of
the last batch, re-checked lists, the abnormal raw rows to export, and the
plot tables for the long and the short span.  ``special_item_data`` does the
same for the default-valued special items, ``last_reading_data`` the
histograms and bars of the last reading per drive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.catalog import SPECIAL_DEFAULTS, TelemetrySpec
from fleetpulse.functions.rules import literal_rows
from fleetpulse.operators import daily as D
from fleetpulse.operators import history as H
from fleetpulse.operators import plotdata as P
from fleetpulse.session import materialize
from fleetpulse.sources import io


def _newest(results: dict[str, DataFrame], batch: str):
    """The newest screened batch; bounds have rows for every batch with readings."""
    return results["bounds"].agg(F.max(batch)).first()[0]


def listed_drives(results: dict[str, DataFrame], batch: str, newest, serial: str, items=None) -> DataFrame:
    """``item, serial, class`` of the newest batch's critical and warning lists (maybe none)."""
    parts = [results[c].where(F.col(batch) == F.lit(newest)).select("item", serial).withColumn("class", F.lit(c))
             for c in ("critical", "warning")]
    both = parts[0].unionByName(parts[1])
    return both.where(F.col("item").isin(list(items))) if items is not None else both


def trend_data(raw: DataFrame, spec: TelemetrySpec, rules: DataFrame, results: dict[str, DataFrame],
               items: list[str], newest=None) -> dict[str, DataFrame]:
    """Plot tables of the trend items.

    ``raw``: every row of every batch (with ``spec.batch``); ``results``: the
    screening result sets (``critical``, ``warning``, ``bounds``, ``density``)
    of all batches; ``newest``: the newest screened batch (from the record of
    runs; default the newest with bounds).
    """
    b = spec.batch
    newest = _newest(results, b) if newest is None else newest
    lists = materialize(listed_drives(results, b, newest, spec.serial, items), "listed")
    crit, warn = (lists.where(F.col("class") == c).drop("class") for c in ("critical", "warning"))
    bounds = results["bounds"].where(F.col(b) == F.lit(newest)).drop(b)

    hist, cutoff = H.abnormal_history(raw, lists, spec, raw.where(F.col(b) == F.lit(newest)))
    hist, cutoff = materialize(hist, "abnormal-history"), materialize(cutoff, "cutoff")
    short = H.short_window(hist, cutoff)
    # keep-last is per day, so the short span is the long one from the cutoff on
    cells = materialize(P.with_spans(H.daily_cells(hist, spec, items), cutoff), "trend-cells")
    cells_short = cells.where(F.col("span") == "short").drop("span")
    crit_new = H.recheck_critical(cells_short, crit, rules, spec.serial)
    warn_new = H.recheck_warning(cells_short, warn, bounds, rules, spec.serial)
    rechecked = materialize(crit_new.withColumn("class", F.lit("critical"))
                            .unionByName(warn_new.withColumn("class", F.lit("warning"))), "rechecked")
    crit_new, warn_new = (rechecked.where(F.col("class") == c).drop("class") for c in ("critical", "warning"))
    counts = H.recheck_counts({"critical": crit, "warning": warn},
                              {"critical": crit_new, "warning": warn_new}, spec.serial)
    abnormal = short.join(rechecked, spec.serial)

    density = results.get("density")
    no_density = by_span = None
    if density is not None:
        density = materialize(P.newest_density(density, b), "density-by-day")
        by_span = density.withColumn("span", F.explode(F.array_compact(F.array(
            F.lit("long"), F.when(F.col(b) == F.lit(newest), F.lit("short")))))).drop(b)
        have = density.where(F.col("cdf").isNotNull()).select("item").distinct()
        no_density = lists.select("item").distinct().join(have, "item", "left_anti")
    out = {"history": hist, "short": short, "critical": crit_new, "warning": warn_new,
           "recheck_counts": counts, "abnormal_rows": abnormal,
           "trend_points": P.trend_points(cells, rechecked, rules, spec.serial, no_density)}
    if by_span is not None:
        out["heatmap"] = P.heatmap_cells(by_span, ["span", "item"])
        out["axis"] = P.axis_bounds(by_span, rules, ["span", "item"])
        busy = rechecked.select("item").unionByName(by_span.where(F.col("cdf").isNotNull()).select("item"))
        # the item list is configuration (the catalogue), not data
        all_items = literal_rows(raw.sparkSession, [(i,) for i in items], io.text_schema(["item"]))
        out["baseline"] = P.baseline(hist.select("date"), all_items, all_items.join(busy, "item", "left_anti"))
    return out


def special_item_data(raw: DataFrame, spec: TelemetrySpec, items: dict[str, float] | None = None, newest=None,
                      listed: DataFrame | None = None) -> dict:
    """Drives whose special items leave their default in the newest batch.

    ``listed``: their list, if it is known already; ``raw`` may then hold the listed drives only."""
    items, b = items or SPECIAL_DEFAULTS, spec.batch
    newest = raw.agg(F.max(b)).first()[0] if newest is None else newest
    last = raw.where(F.col(b) == F.lit(newest))
    listed = materialize(H.special_item_drives(last, spec.serial, items), "special-listed") if listed is None else listed
    hist, cutoff = H.abnormal_history(raw, listed, spec, last)
    hist, cutoff = materialize(hist, "special-history"), materialize(cutoff, "cutoff")
    short = H.short_window(hist, cutoff)
    cells = materialize(P.with_spans(H.daily_cells(hist, spec, list(items)), cutoff), "special-cells")
    new = materialize(H.recheck_special(cells.where(F.col("span") == "short"), listed, spec.serial, items), "special-new")
    series = cells.join(new, ["item", spec.serial], "left_semi")
    dflt = F.create_map(*[x for i, d in items.items() for x in (F.lit(i), F.lit(float(d)))])
    return {"listed": listed, "rechecked": new, "series": series.withColumn("default", dflt[F.col("item")]),
            "abnormal_rows": short.join(new.select(spec.serial, "item"), spec.serial)}


def last_reading_data(raw: DataFrame, spec: TelemetrySpec, rules: DataFrame, hist_items: list[str],
                      bar_items: list[str]) -> dict:
    """Histograms (50 bins, p99-based range) and value counts of each drive's last reading in ``raw``
    (the rows of the newest batch)."""
    last = D.keep_last_per_drive(raw, spec).withColumn("date", F.lit(None).cast("date"))
    last = materialize(last, "last-rows")
    plain = TelemetrySpec(serial=spec.serial, timestamp=spec.timestamp, firmware=None)
    skip = {"Wear_Range_Delta"}
    vals = D.to_long(last, plain, [i for i in hist_items if i not in skip])
    vals = (vals.join(rules, F.lower(F.col("item")) == rules["rule_item"], "left")
            .select("item", P.to_tb(F.col("value"), F.col("y_format")).alias("value")))
    vals = materialize(vals, "last-readings")
    ranges = P.histogram_range(vals, rules)
    bars = P.value_counts(D.to_long(last, plain, bar_items))
    return {"ranges": ranges, "histogram": P.histogram(vals, ranges), "bars": bars}
