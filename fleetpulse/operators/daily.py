"""Daily load: firmware quarantine, keep-last reading, long format, pivot.

Plan shape at scale: a scan with pruned columns, one filter, and one shuffle on
``(serial, day)`` for keep-last.  ``row_number() == 1`` is planned with a
partial window-group-limit before the shuffle, so a drive-day with millions of
readings is cut to one row per map task before it moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.catalog import TelemetrySpec


def with_day(df: DataFrame, spec: TelemetrySpec, name: str = "date") -> DataFrame:
    return df.withColumn(name, spec.day_expr())


def is_error_firmware(spec: TelemetrySpec):
    return F.col(spec.firmware).eqNullSafe(F.lit(spec.error_value))


def quarantine(df: DataFrame, spec: TelemetrySpec) -> DataFrame:
    """Rows read while the drive firmware was in error mode."""
    if spec.firmware is None:
        return df.limit(0)
    return df.where(is_error_firmware(spec))


def without_error_firmware(df: DataFrame, spec: TelemetrySpec) -> DataFrame:
    """Complement of :func:`quarantine`; a NULL firmware is not an error."""
    if spec.firmware is None:
        return df
    return df.where(~is_error_firmware(spec))


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per ``keys`` by ``order`` (all descending, nulls first last)."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def load_daily(df: DataFrame, spec: TelemetrySpec, split_firmware: bool = True,
               dedupe: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Telemetry -> one reading per (drive, day): the last one of that day.

    Error-mode readings leave before keep-last, so an error row never hides
    the last good reading of its day.  ``columns`` prunes the scan.
    """
    if columns is not None:
        keep = list(dict.fromkeys([*spec.reading_keys(), *spec.order_cols(),
                                   *([spec.firmware] if spec.firmware else []), *columns]))
        df = df.select(*keep)
    if split_firmware:
        df = without_error_firmware(df, spec)
    df = with_day(df, spec)
    if dedupe:
        df = keep_last(df, [*spec.reading_keys(), "date"], spec.order_cols())
    return df


def to_long(daily: DataFrame, spec: TelemetrySpec, items: list[str] | None = None,
            extra: list[str] | None = None) -> DataFrame:
    """Unpivot item columns to ``(…keys, date, item, value)``; NULL and NaN readings dropped."""
    items = list(items or spec.items)
    ids = [*spec.keys(), "date", *(extra or [])]
    long = daily.select(*ids, *[F.col(i).cast("double").alias(i) for i in items]) \
        .unpivot(ids, items, "item", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def pivot_days(long: DataFrame, serial: str, dates: list[str], how: str = "avg") -> DataFrame:
    """Drive x day matrix of one item; the date list is supplied (no extra job).

    ``how="unique"`` requires one reading per cell (the keep-last output) and
    raises otherwise, like a pandas pivot does.
    """
    if how == "unique":
        dup = long.groupBy(serial, "date").count().where(F.col("count") > 1).limit(1).count()
        if dup:
            raise ValueError("more than one reading for a (drive, day) cell")
        how = "max"
    agg = {"avg": F.avg, "first": F.first, "max": F.max}[how]
    return (long.withColumn("_d", F.col("date").cast("string"))
            .groupBy(serial).pivot("_d", dates).agg(agg("value")))


def keep_last_per_drive(df: DataFrame, spec: TelemetrySpec) -> DataFrame:
    """Last reading of each drive over the whole input (histogram input)."""
    return keep_last(df, spec.reading_keys(), spec.order_cols())


def daily_average(df: DataFrame, spec: TelemetrySpec, items: list[str]) -> DataFrame:
    """All readings of a (drive, day) averaged (the ad-hoc variant without keep-last)."""
    df = with_day(df, spec)
    return df.groupBy(*spec.keys(), "date").agg(*[F.avg(i).alias(i) for i in items])
