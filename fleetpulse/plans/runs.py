"""The three jobs a user of the original notebooks runs, as Spark runs.

* :func:`screening_job`   - weekly screening of one product / log kind
  (critical, warning, bounds, density, quarantine result sets)
* :func:`trend_job`       - trend, heatmap, axis, baseline and special-item
  tables plus the abnormal raw-row exports
* :func:`histogram_job`   - last-reading histograms and bar counts

Inputs and outputs are folders (any Hadoop URI); every output is a table
partitioned by its natural keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from fleetpulse import catalog as C
from fleetpulse.catalog import TelemetrySpec
from fleetpulse.operators import history as H
from fleetpulse.plans import screening as SC
from fleetpulse.plans import trends as TR
from fleetpulse.session import materialize, scratch
from fleetpulse.sources import io

RESULTS = ("critical", "warning", "bounds", "density")


def _spec(items: list[str]) -> TelemetrySpec:
    return TelemetrySpec(tiebreak=(SC.ROW_ORDER,), items=tuple(items), batch="batch", log="log")


def _write_all(tables: dict, out: str, fmt: str = "parquet") -> None:
    for name, df in tables.items():
        keys = tuple(k for k in ("span", "class", "item") if k in df.columns)
        io.write_result_set(df, f"{out.rstrip('/')}/{name}", fmt=fmt, partition_by=keys)


def screening_job(spark: SparkSession, product: str, log_kind: str, telemetry: str, rules: str,
                  out: str, n_weeks: int = 2, kde: bool = True, sample: bool = False,
                  encoding: str | None = None) -> None:
    with scratch(spark):
        SC.screen_product(spark, telemetry, rules, product, log_kind, out, n_weeks=n_weeks, kde=kde,
                          encoding=encoding, draw_share=10 if sample else None)


def _exports(spark: SparkSession, telemetry, items: list[str], encoding: str | None, n_weeks: int | None = None,
             drives: DataFrame | None = None):
    """The pruned rows of the exports, of ``drives`` only if given, parsed once and written."""
    raw = SC.with_file_order(io.read_telemetry_csv(spark, telemetry, items=items, encoding=encoding, n_weeks=n_weeks))
    if drives is not None:
        raw = raw.join(drives, drives.columns, "left_semi")
    return materialize(raw, "telemetry-rows")


def trend_job(spark: SparkSession, product: str, telemetry, rules: str, results: str, out: str,
              encoding: str | None = None) -> None:
    """``telemetry``: folder(s) holding every weekly export (basic and extended
    logs) with the trend and special items; ``results``: output folder(s) of
    :func:`screening_job`, one per log kind."""
    trend = C.trend_items(product)
    special = C.special_items(product)
    items = list(dict.fromkeys(trend + special))
    spec = _spec(items)
    with scratch(spark):
        rulebase = io.read_rulebase_csv(spark, rules)
        bases = [results] if isinstance(results, str) else list(results)
        res = {n: reduce(lambda x, y: x.unionByName(y), [io.read_result_set(spark, base, n) for base in bases])
               for n in RESULTS}
        newest = max(io.newest_batch(spark, base) for base in bases)
        # the lists first: of the listed drives the history is kept, of all others nothing
        defaults = {i: C.SPECIAL_DEFAULTS[i] for i in special}
        last = [f for f in io.list_exports(spark, telemetry) if io.week_of(f) == newest]
        flagged = H.special_item_drives(io.read_telemetry_csv(spark, last, items=special, encoding=encoding), spec.serial, defaults)
        flagged = materialize(flagged, "special-listed")
        listed = TR.listed_drives(res, spec.batch, newest, spec.serial, trend).select(spec.serial)
        drives = materialize(listed.unionByName(flagged.select(spec.serial)).distinct(), "listed-drives")
        raw = _exports(spark, telemetry, items, encoding, drives=drives)
        t = TR.trend_data(raw, spec, rulebase, res, trend, newest)
        sp = TR.special_item_data(raw, spec, defaults, newest, listed=flagged)
        io.write_abnormal_rows(t.pop("abnormal_rows").drop(C.SSDUID), f"{out}/abnormal_rows",
                               sort_by=(spec.serial, spec.timestamp))
        io.write_abnormal_rows(sp.pop("abnormal_rows").drop(C.SSDUID), f"{out}/abnormal_rows_special",
                               sort_by=(spec.serial, spec.timestamp))
        _write_all({k: v for k, v in t.items() if k not in ("history", "short")}, f"{out}/trend")
        _write_all(sp, f"{out}/special")


def histogram_job(spark: SparkSession, product: str, log_kind: str, telemetry, rules: str, out: str,
                  encoding: str | None = None) -> None:
    hist_items = C.histogram_items(product, log_kind)
    bars = C.bar_items(log_kind)
    items = list(dict.fromkeys(hist_items + [C.histogram_extra_item(log_kind)] + bars))
    with scratch(spark):
        raw = _exports(spark, telemetry, items, encoding, n_weeks=1)       # the newest week is the only one opened
        rulebase = io.read_rulebase_csv(spark, rules)
        _write_all(TR.last_reading_data(raw, _spec(items), rulebase, hist_items, bars), f"{out}/last_reading")
