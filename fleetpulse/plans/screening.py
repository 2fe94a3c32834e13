"""Weekly screening run: load -> quarantine -> keep-last -> screen -> density.

One plan covers every item and every selected week: ``batch`` (the weekly
file) and ``item`` are grouping columns, not driver loops.  Result sets are
written partitioned by ``(batch, item)``:

* ``critical``  (batch, item, serial)
* ``warning``   (batch, item, serial)
* ``bounds``    (batch, item, date, lower, upper)
* ``density``   (batch, item, date, layer, x, cdf)
* ``quarantine`` error-firmware rows with all their columns
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse import catalog as C
from fleetpulse.catalog import TelemetrySpec
from fleetpulse.functions.rules import validate_items
from fleetpulse.operators import daily as D
from fleetpulse.operators import screen as S
from fleetpulse.operators.density import daily_density
from fleetpulse.session import materialize
from fleetpulse.sources import io

ROW_ORDER = "_row"


def with_file_order(df: DataFrame) -> DataFrame:
    """Tiebreak = position in the input file.

    Applied right after a file scan, ``monotonically_increasing_id`` grows with
    the row position inside a file (splits of one file map to increasing
    partitions), so "last reading of the day" keeps the last row of the file
    among equal timestamps, as a sorted pandas frame would.
    """
    return df.withColumn(ROW_ORDER, F.monotonically_increasing_id())


def run_screening(telemetry: DataFrame, spec: TelemetrySpec, rules: DataFrame, items: list[str],
                  out: str | None = None, n_batches: int | None = None, kde: bool = True,
                  draw_share: int | None = None, fmt: str = "parquet",
                  stage_input: bool = True, run: str | None = None) -> dict[str, DataFrame]:
    """Screen every item of ``items`` over the (last ``n_batches``) batches.

    ``stage_input`` writes the pruned input columns (keys, time, firmware,
    tiebreak, items) once as Parquet, so the quarantine and the daily load
    share one parse of the raw exports instead of scanning them twice.
    """
    validate_items(items, rules)
    raw = telemetry
    if n_batches and spec.batch:
        raw = io.last_batches(raw, spec.batch, n_batches)
    if stage_input:
        keep = list(dict.fromkeys([*spec.reading_keys(), *spec.order_cols(),
                                   *([spec.firmware] if spec.firmware else []), *items]))
        raw = materialize(raw.select(*keep), "telemetry-pruned")
    quarantined = D.with_day(D.quarantine(raw, spec), spec)
    daily = D.load_daily(raw, spec, columns=items)
    long = materialize(D.to_long(daily, spec, items), "daily-long")
    res = S.screen(long, rules, spec.serial, batch=spec.batch)
    results = {"critical": res["critical"], "warning": res["warning"], "bounds": res["bounds"],
               "quarantine": quarantined}
    if kde:
        results["density"] = daily_density(res["normal"], spec.serial, batch=spec.batch,
                                           draw_share=draw_share)
    if out:
        io.write_screening(results, out, fmt=fmt, batches=raw.select(F.col(spec.batch).alias("batch")) if spec.batch else None,
                           run=run)
    return results


def product_spec(product: str, log_kind: str) -> tuple[TelemetrySpec, list[str]]:
    items = C.screening_items(product, log_kind)
    spec = TelemetrySpec(tiebreak=(ROW_ORDER,), items=tuple(items), batch="batch")
    return spec, items


def screen_product(spark: SparkSession, telemetry_paths, rules_path: str, product: str, log_kind: str,
                   out: str, n_weeks: int = 2, kde: bool = True, encoding: str | None = None,
                   draw_share: int | None = None) -> dict[str, DataFrame]:
    """The weekly job: last ``n_weeks`` weekly exports of one product and log kind."""
    spec, items = product_spec(product, log_kind)
    # the weeks are chosen by file name: older exports are not opened
    raw = io.read_telemetry_csv(spark, telemetry_paths, items=items, encoding=encoding, n_weeks=n_weeks,
                                log_kind=log_kind)
    raw = with_file_order(raw)
    rules = io.read_rulebase_csv(spark, rules_path)
    return run_screening(raw, replace(spec, items=tuple(items)), rules, items, out=out,
                         kde=kde, draw_share=draw_share)
