"""The last reading of every drive, kept up to date week by week.

A version of the table lies in ``version=N`` below its folder, in buckets by the reading's key: one Parquet file a
bucket.  A merge cuts the new rows to one per key, deals them to the buckets and meets the stored version bucket by
bucket; the stored side, which grows with the fleet and not with the week, is read where it lies and never exchanged.
The buckets of the join are the buckets of the next version, so writing it needs no exchange either.

A version counts when its number is committed (:func:`fleetpulse.sources.io.commit_run`), so a merge that dies leaves
the former one, and readers may pin a version.  Of two merges that build on the same version, the later commit is
refused (:class:`fleetpulse.sources.io.StaleVersion`), as its table would miss the rows of the first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.operators.daily import keep_last
from fleetpulse.sources import io

BUCKETS = 64
KEY = "_key"


def reading_key(keys: list[str]) -> Column:
    """One text per key that is never null (null parts are left out of it), so that buckets hold every row."""
    return F.to_json(F.struct(*keys))


def _bucketed(spark: SparkSession, path: str, columns: str, buckets: int) -> DataFrame:
    """The files below ``path`` as a table that knows its buckets (only a catalog entry can say so)."""
    name = f"last_readings_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) "
              f"INTO {buckets} BUCKETS LOCATION '{path}'")
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")                          # the plan holds the files and buckets; the files stay
    return table


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def read_last(spark: SparkSession, base: str, like: DataFrame, version: int | None = None,
              buckets: int = BUCKETS) -> DataFrame | None:
    """The table as of its newest commit, or of ``version``; None before the first.

    ``like`` has the table's columns (any rows); ``buckets`` as written."""
    known = io.commits(spark, base, version)
    if not known:
        return None
    keyed = like.withColumn(KEY, F.lit(""))
    return _bucketed(spark, f"{base.rstrip('/')}/{known[-1][1]}", _columns(keyed), buckets)


def merged(stored: DataFrame | None, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last of stored and new readings per key: ``rows`` go through keep-last, then join the stored version.

    Readings are ordered by ``order`` as in :func:`keep_last` (null before any value); of readings alike in it the
    new one stays.  Rows with null keys form a key like any other."""
    new = keep_last(rows, keys, order).withColumn(KEY, reading_key(keys))
    if stored is None:
        return new
    fields = [c for c in new.columns if c != KEY]
    old = stored.select(F.col(KEY).alias("_old_key"), F.struct(*order).alias("_old_at"), F.struct(*fields).alias("_old"))
    new = new.select(F.col(KEY).alias("_new_key"), F.struct(*order).alias("_new_at"), F.struct(*fields).alias("_new"))
    both = old.join(new, F.col("_old_key") == F.col("_new_key"), "full_outer")
    newer = F.col("_old_key").isNull() | (F.col("_new_key").isNotNull() & (F.col("_new_at") >= F.col("_old_at")))
    last = F.when(newer, F.col("_new")).otherwise(F.col("_old"))
    return both.select(last.alias("_last"), F.coalesce("_old_key", "_new_key").alias(KEY)).select("_last.*", KEY)


def merge_last(rows: DataFrame, base: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> int:
    """Merges the readings ``rows`` into the table at ``base``, which the first merge makes; returns the version.

    Later merges give rows of the same columns.  Merging rows a second time changes nothing."""
    spark, base = rows.sparkSession, base.rstrip("/")
    known = io.commits(spark, base)
    stored = _bucketed(spark, f"{base}/{known[-1][1]}", _columns(rows.withColumn(KEY, F.lit(""))), buckets) if known else None
    last = merged(stored, rows, keys, order)
    if stored is None:
        last = last.repartition(buckets, KEY)
    folder, name = f"version={uuid.uuid4().hex[:12]}", f"last_readings_{uuid.uuid4().hex[:12]}"
    last.write.format("parquet").bucketBy(buckets, KEY).sortBy(KEY).option("path", f"{base}/{folder}").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")                          # an external table: its files stay
    return io.commit_run(spark, base, folder, after=known[-1][0] if known else 0)
