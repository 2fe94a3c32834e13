"""Column helpers shared by the text operators.

Two small normalisations recur in the operators' definitions: lower-casing the
letters A-Z only (other scripts keep their case), and the split into *item
words*, runs of digits, letters A-Z and any character beyond ASCII.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetpulse.session import materialize

# Fixed value: everything in ASCII that is no word character once A-Z are lower case.
ITEM_DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty.

    ``lower`` has a fast path for text that is ASCII throughout, where it does
    the same; text with other characters takes ``translate``.
    """
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(
        F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def item_words(text: Column) -> Column:
    """Array of item words of a text (empty array for null or no words)."""
    return F.array_remove(F.split(ascii_lower(text), ITEM_DELIMITERS), "")


def same(left: Column, right: Column) -> Column:
    """Null-safe equality, usable as an equi-join key."""
    return left.eqNullSafe(right)


def dealt(rows: DataFrame, group: str, order: list[str], slice_rows: int) -> tuple[DataFrame, DataFrame]:
    """Places of rows inside their groups (by ``order``, nulls first), without gathering a group.

    Returns the rows with ``slice, inside`` (place in slice and group, from 1) and the *spans*: ``group, slice,
    before`` (rows of the group in earlier slices), ``size`` (rows of the group).  Rows alike in ``order`` are dealt
    by their place in the input; ``rows`` should be a written table, as it is sampled, counted and dealt."""
    slices = max(1, -(-rows.count() // slice_rows))
    cut = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(slices, group, *order, "row").drop("row")
    cut = materialize(cut.withColumn("slice", F.spark_partition_id()), "dealt-slices")
    spans = cut.groupBy(group, "slice").agg(F.count(F.lit(1)).alias("n"))
    here = Window.partitionBy(group)
    before = F.sum("n").over(here.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(group, "slice", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(here).alias("size"))
    inside = F.row_number().over(Window.partitionBy(group, "slice").orderBy(*order))
    return cut.withColumn("inside", inside), materialize(spans, "dealt-spans")


def placed(rows: DataFrame, group: str, order: list[str], slice_rows: int) -> DataFrame:
    """``rows`` with ``at`` (place in the group, from 0) and ``size`` (rows of the group); ``group`` is not null."""
    cut, spans = dealt(rows, group, order, slice_rows)
    return cut.join(spans, [group, "slice"]).withColumn("at", F.col("before") + F.col("inside") - 1).drop("slice", "inside", "before")
