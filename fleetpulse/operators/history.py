"""History of abnormal drives and the re-check of their lists.

* :func:`dominant_identity` - most frequent upper-cased secondary id per drive
  (ties: smallest id); rows with another or a NULL id are dropped.
* :func:`abnormal_history` - every raw row of the listed drives, identity-fixed,
  plus the short-window cutoff (oldest day of those drives in the last batch).
* :func:`recheck_critical` / :func:`recheck_warning` - drives of the lists
  that still violate their limits inside the short window.
* :func:`special_item_drives` - drives whose special items leave the default.

Plans: list membership is a left-semi join (lists are DataFrames); the mode is
two partial aggregations (``(drive, id) -> count`` then a ``min(struct)`` per
drive), so a drive with millions of rows is reduced map-side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.catalog import SPECIAL_DEFAULTS, TelemetrySpec
from fleetpulse.functions.rules import KIND_EMPTY, rule_key
from fleetpulse.operators.daily import keep_last, to_long, with_day
from fleetpulse.session import materialize


def dominant_identity(df: DataFrame, serial: str, identity: Column) -> DataFrame:
    """``(serial, identity, n)``: the most frequent upper-cased id per drive."""
    counts = (df.select(serial, F.upper(identity).alias("identity"))
              .where(F.col("identity").isNotNull())
              .groupBy(serial, "identity").agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy(serial).agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("identity"))).alias("m"))
    return best.select(serial, F.col("m.identity").alias("identity"), (-F.col("m.neg")).alias("n"))


def fix_identity(df: DataFrame, spec: TelemetrySpec, identity_name: str = "identity") -> DataFrame:
    """Keep the rows carrying the drive's dominant identity (upper-cased)."""
    ident = spec.identity_expr()
    mode = dominant_identity(df, spec.serial, ident).select(spec.serial, F.col("identity").alias("_mode"))
    out = (df.withColumn(identity_name, F.upper(ident))
           .join(mode, spec.serial)
           .where(F.col(identity_name) == F.col("_mode"))
           .drop("_mode"))
    return out


def union_lists(lists: list[DataFrame], serial: str) -> DataFrame:
    """Distinct drives of several lists (set union)."""
    return reduce(lambda a, b: a.unionByName(b), [l.select(serial) for l in lists]).distinct()


def short_cutoff(raw_last_batch: DataFrame, drives: DataFrame, spec: TelemetrySpec) -> DataFrame:
    """One row ``(cutoff)``: the oldest day of the listed drives in the last batch."""
    return (with_day(raw_last_batch.join(drives, spec.serial, "left_semi"), spec)
            .agg(F.min("date").alias("cutoff")))


def abnormal_history(raw: DataFrame, drives: DataFrame, spec: TelemetrySpec,
                     last_batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(long history, cutoff): all rows of the listed drives, identity fixed.

    The drive list is written first: its real size is then known to the
    planner, which broadcasts a small list into the semi join instead of
    shuffling the raw telemetry by drive.
    """
    drives = materialize(drives.select(spec.serial).distinct(), "abnormal-drives")
    hist = with_day(raw.join(drives, spec.serial, "left_semi"), spec)
    hist = fix_identity(hist, spec)
    return hist, short_cutoff(last_batch, drives, spec)


def short_window(hist: DataFrame, cutoff: DataFrame) -> DataFrame:
    """Rows on or after the cutoff (a one-row frame, used as a scalar subquery)."""
    return hist.where(F.col("date") >= cutoff.select("cutoff").scalar())


def daily_cells(hist: DataFrame, spec: TelemetrySpec, items: list[str]) -> DataFrame:
    """Keep-last per (drive, day), long format ``(serial, date, item, value)``."""
    last = keep_last(hist, [spec.serial, *([spec.log] if spec.log else []), "date"], spec.order_cols())
    return to_long(last, TelemetrySpec(serial=spec.serial, timestamp=spec.timestamp, firmware=None), items)


def recheck_critical(cells: DataFrame, crit: DataFrame, rules: DataFrame, serial: str) -> DataFrame:
    """``(item, serial)`` of listed critical drives with a violating reading.

    Without any VALUE limit on the item, any non-null reading keeps the drive.
    """
    j = (cells.join(crit.select("item", serial), ["item", serial], "left_semi")
         .join(rules, rule_key(F.col("item")) == rules["rule_item"]))
    no_rule = F.col("crit_low").isNull() & F.col("crit_high").isNull()
    viol = no_rule | (F.col("value") < F.col("crit_low")) | (F.col("value") > F.col("crit_high"))
    return j.where(viol).select("item", serial).distinct()


def recheck_warning(cells: DataFrame, warn: DataFrame, bounds: DataFrame, rules: DataFrame,
                    serial: str) -> DataFrame:
    """``(item, serial)`` of listed warning drives outside that day's bounds.

    A side counts unless its kind is EMPTY; both EMPTY keeps every drive with
    a reading.  Days are matched to bounds by date.
    """
    j = (cells.join(warn.select("item", serial), ["item", serial], "left_semi")
         .join(rules, rule_key(F.col("item")) == rules["rule_item"])
         .join(bounds.select("item", "date", "lower", "upper"), ["item", "date"], "left"))
    low_on = F.col("warn_low_kind") != KIND_EMPTY
    high_on = F.col("warn_high_kind") != KIND_EMPTY
    viol = (F.when(low_on & high_on, (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))
            .when(low_on, F.col("value") < F.col("lower"))
            .when(high_on, F.col("value") > F.col("upper"))
            .otherwise(F.lit(True)))
    return j.where(F.coalesce(viol, F.lit(False))).select("item", serial).distinct()


def recheck_counts(before: dict[str, DataFrame], after: dict[str, DataFrame], serial: str) -> DataFrame:
    """``(item, class, n_before, n_after)`` for every class of lists."""
    parts = []
    for cls, lst in before.items():
        b = lst.groupBy("item").agg(F.count(F.lit(1)).alias("n_before"))
        a = after[cls].groupBy("item").agg(F.count(F.lit(1)).alias("n_after"))
        parts.append(b.join(a, "item", "left").select(
            "item", F.lit(cls).alias("class"), "n_before",
            F.coalesce(F.col("n_after"), F.lit(0)).cast("long").alias("n_after")))
    return reduce(lambda x, y: x.unionByName(y), parts)


def special_item_drives(last_batch: DataFrame, serial: str, items: dict[str, float] | None = None) -> DataFrame:
    """``(item, serial)`` of drives with a non-null reading different from the default."""
    items = items or SPECIAL_DEFAULTS
    flagged = F.array_compact(F.array(*[F.when(F.col(i) != F.lit(d), F.lit(i)) for i, d in items.items()]))
    return last_batch.select(F.explode(flagged).alias("item"), serial).distinct()


def recheck_special(cells: DataFrame, listed: DataFrame, serial: str,
                    items: dict[str, float] | None = None) -> DataFrame:
    """Listed drives with a non-default reading inside the window."""
    items = items or SPECIAL_DEFAULTS
    dflt = F.create_map(*[x for i, d in items.items() for x in (F.lit(i), F.lit(float(d)))])
    return (cells.join(listed, ["item", serial], "left_semi")
            .where(F.col("value") != dflt[F.col("item")])
            .select("item", serial).distinct())
