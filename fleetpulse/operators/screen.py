"""Screening: critical drives, warning bounds and drives, normal population.

All items are screened in one plan over the long table
``(…batch, serial, date, item, value)``; lists are DataFrames keyed by
``(…batch, item, serial)`` and removal is a left-anti join, never a collected
``isin`` list.  Keep-last left at most one reading per drive and day, so an
``(item, serial)`` key holds at most one row per day and these joins cannot be
skewed by a hot drive.  Rules and per-day bounds carry their size (literal
rows, written tables), so the planner broadcasts them where they are small; a
hot day then never meets a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.rules import KIND_PPM, KIND_VALUE, quantile_requests, rule_key
from fleetpulse.operators.quantile import exact_quantiles
from fleetpulse.session import materialize

def _batch(long: DataFrame, batch: str | None) -> list[str]:
    return [batch] if batch and batch in long.columns else []


def with_rules(long: DataFrame, rules: DataFrame) -> DataFrame:
    """Attach each row's rule (inner join on the lower-case item name)."""
    return long.join(rules, rule_key(long["item"]) == rules["rule_item"]).drop("rule_item")


def critical_drives(long: DataFrame, rules: DataFrame, serial: str, batch: str | None = None) -> DataFrame:
    """``(…batch, item, serial)`` of drives with any day outside a VALUE limit."""
    b = _batch(long, batch)
    j = with_rules(long, rules)
    viol = (F.col("value") < F.col("crit_low")) | (F.col("value") > F.col("crit_high"))
    return j.where(viol).select(*b, "item", serial).distinct()


def without(long: DataFrame, drives: DataFrame, serial: str, batch: str | None = None) -> DataFrame:
    """Remove listed drives per item (left anti join)."""
    return long.join(drives, [*_batch(long, batch), "item", serial], "left_anti")


def warning_bounds(pop: DataFrame, rules: DataFrame, batch: str | None = None,
                   materialized: bool = True) -> DataFrame:
    """Per-day warning bounds ``(…batch, item, date, lower, upper)``.

    ``pop`` is the population without critical drives.  PPM sides are exact
    per-day quantiles of the remaining non-null readings; VALUE sides are the
    fixed number; other kinds give NULL (no bound).
    """
    b = _batch(pop, batch)
    keyed = pop.withColumn("rule_item", rule_key(F.col("item")))
    days = keyed.select(*b, "rule_item", "item", "date").distinct()

    req = quantile_requests(rules)
    ppm_items = req.select("rule_item").distinct()
    q = exact_quantiles(keyed.join(ppm_items, "rule_item", "left_semi"),
                        [*b, "rule_item", "item", "date"], "value", req)
    qw = (q.groupBy(*b, "rule_item", "item", "date")
          .agg(F.max(F.when(F.col("qid") == "lower", F.col("quantile"))).alias("q_lower"),
               F.max(F.when(F.col("qid") == "upper", F.col("quantile"))).alias("q_upper")))

    out = (days.join(rules, "rule_item")
           .join(qw, [*b, "rule_item", "item", "date"], "left")
           .select(*b, "item", "date",
                   F.when(F.col("warn_low_kind") == KIND_PPM, F.col("q_lower"))
                    .when(F.col("warn_low_kind") == KIND_VALUE, F.col("warn_low_num")).alias("lower"),
                   F.when(F.col("warn_high_kind") == KIND_PPM, F.col("q_upper"))
                    .when(F.col("warn_high_kind") == KIND_VALUE, F.col("warn_high_num")).alias("upper")))
    return materialize(out, "warning-bounds") if materialized else out


def outside_bounds(pop: DataFrame, bounds: DataFrame, batch: str | None = None) -> DataFrame:
    """Readings strictly below ``lower`` or above ``upper`` of their day."""
    b = _batch(pop, batch)
    # bounds is a written table (one row per batch, item, day): the planner
    # broadcasts it by its file size, so a hot day is never shuffled here.
    j = pop.join(bounds, [*b, "item", "date"])
    return j.where((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))


def warning_drives(pop: DataFrame, bounds: DataFrame, serial: str, batch: str | None = None) -> DataFrame:
    """``(…batch, item, serial)`` with any day outside that day's bounds."""
    b = _batch(pop, batch)
    return outside_bounds(pop, bounds, batch).select(*b, "item", serial).distinct()


def drives_of(long: DataFrame, serial: str, batch: str | None = None) -> DataFrame:
    return long.select(*_batch(long, batch), "item", serial).distinct()


def screen(long: DataFrame, rules: DataFrame, serial: str, batch: str | None = None,
           materialized: bool = True) -> dict[str, DataFrame]:
    """Critical -> bounds (without critical) -> warning -> normal, all items at once.

    Returns ``critical``, ``bounds``, ``warning`` (drive lists), ``population``
    (readings without critical drives) and ``normal`` (readings of drives that
    are neither critical nor warning).  Lists and bounds are written once to
    the shared checkpoint folder (``materialized``): later steps read them
    instead of re-deriving them, and the planner sees their real size (small
    lists are broadcast into the anti joins).  Pass a materialized ``long``.
    """
    crit = critical_drives(long, rules, serial, batch)
    if materialized:
        # A written list has a known size: when small, the anti joins below
        # broadcast it and the long table is never shuffled by drive.
        crit = materialize(crit, "critical")
    pop = without(long, crit, serial, batch)
    bounds = warning_bounds(pop, rules, batch, materialized=materialized)
    warn = warning_drives(pop, bounds, serial, batch)
    if materialized:
        warn = materialize(warn, "warning")
    normal = without(pop, warn, serial, batch)
    return {"critical": crit, "bounds": bounds, "warning": warn, "population": pop, "normal": normal}


def classify(long: DataFrame, result: dict[str, DataFrame], serial: str, batch: str | None = None) -> DataFrame:
    """``(…batch, item, serial, class)`` with class critical / warning / normal."""
    b = _batch(long, batch)
    keys = [*b, "item", serial]
    labelled = (result["critical"].withColumn("class", F.lit("critical"))
                .unionByName(result["warning"].withColumn("class", F.lit("warning"))))
    return (drives_of(long, serial, batch).join(labelled, keys, "left")
            .select(*keys, F.coalesce(F.col("class"), F.lit("normal")).alias("class")))
