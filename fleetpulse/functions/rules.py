"""Rulebase: per-item critical / warning limits and plot axis settings.

A rulebase row holds threshold expressions of the form ``KIND,number``:

* ``VALUE,x`` - a fixed limit
* ``PPM,x``   - a per-day quantile; x parts per million of the drives fall
                outside (low side: quantile x/1e6, high side: 1 - x/1e6)
* ``EMPTY`` or anything else - no limit on that side

Only ``VALUE`` counts for critical limits; warning limits accept both kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rulebase header names and threshold kinds.
RULE_COLUMNS = ["ITEM", "CRITICAL_LOW", "CRITICAL_HIGH", "WARNING_LOW", "WARNING_HIGH",
                "Y_FORMAT", "Y_MIN", "Y_MAX"]
KIND_VALUE = "VALUE"
KIND_PPM = "PPM"
KIND_EMPTY = "EMPTY"

RAW_RULE_SCHEMA = T.StructType([
    T.StructField("ITEM", T.StringType(), True),
    T.StructField("CRITICAL_LOW", T.StringType(), True),
    T.StructField("CRITICAL_HIGH", T.StringType(), True),
    T.StructField("WARNING_LOW", T.StringType(), True),
    T.StructField("WARNING_HIGH", T.StringType(), True),
    T.StructField("Y_FORMAT", T.StringType(), True),
    T.StructField("Y_MIN", T.StringType(), True),
    T.StructField("Y_MAX", T.StringType(), True),
])


def threshold_kind(expr: Column) -> Column:
    parts = F.split(F.coalesce(expr, F.lit(KIND_EMPTY)), ",")
    return F.upper(F.trim(F.try_element_at(parts, F.lit(1))))


def threshold_number(expr: Column) -> Column:
    parts = F.split(expr, ",")
    return F.trim(F.try_element_at(parts, F.lit(2))).try_cast("double")


def value_limit(expr: Column) -> Column:
    """Number of a ``VALUE,x`` expression, NULL for every other kind."""
    return F.when(threshold_kind(expr) == KIND_VALUE, threshold_number(expr))


def parse_rules(raw: DataFrame) -> DataFrame:
    """Typed rulebase keyed by lower-case item name.

    Columns: rule_item, crit_low, crit_high (VALUE only), warn_low_kind,
    warn_low_num, warn_high_kind, warn_high_num, y_format, y_min, y_max.
    """
    c = {name.upper(): F.col(f"`{name}`") for name in raw.columns}
    return raw.select(
        F.lower(F.trim(c["ITEM"])).alias("rule_item"),
        value_limit(c["CRITICAL_LOW"]).alias("crit_low"),
        value_limit(c["CRITICAL_HIGH"]).alias("crit_high"),
        threshold_kind(c["WARNING_LOW"]).alias("warn_low_kind"),
        threshold_number(c["WARNING_LOW"]).alias("warn_low_num"),
        threshold_kind(c["WARNING_HIGH"]).alias("warn_high_kind"),
        threshold_number(c["WARNING_HIGH"]).alias("warn_high_num"),
        F.trim(c["Y_FORMAT"]).alias("y_format") if "Y_FORMAT" in c else F.lit(None).cast("string").alias("y_format"),
        c["Y_MIN"].cast("string").try_cast("double").alias("y_min") if "Y_MIN" in c else F.lit(None).cast("double").alias("y_min"),
        c["Y_MAX"].cast("string").try_cast("double").alias("y_max") if "Y_MAX" in c else F.lit(None).cast("double").alias("y_max"),
    )


def rules_from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Build a parsed rulebase from literal rows in ``RULE_COLUMNS`` order."""
    for r in rows:
        for side in r[3:5]:
            if str(side).split(",")[0].strip().upper() == KIND_PPM and not _is_number(str(side).partition(",")[2]):
                raise ValueError(f"rulebase: {r[0]!r} has a PPM limit without a number: {side!r}")
    norm = [tuple(None if v is None else str(v) for v in r) + (None,) * (8 - len(r)) for r in rows]
    # literal rows: the planner knows the size of the table
    return parse_rules(literal_rows(spark, norm, RAW_RULE_SCHEMA))


def _is_number(text: str) -> bool:
    try:
        return float(text) == float(text)
    except ValueError:
        return False


def literal_rows(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small table whose rows are part of the plan."""
    if not rows:
        return spark.createDataFrame([], schema)
    cells = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, schema.fields)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*cells)))


def rule_key(item: Column) -> Column:
    return F.lower(item)


def ppm_low_fraction(ppm: Column) -> Column:
    return ppm / F.lit(1e6)


def ppm_high_fraction(ppm: Column) -> Column:
    return F.lit(1.0) - ppm / F.lit(1e6)


def quantile_requests(rules: DataFrame) -> DataFrame:
    """(rule_item, qid, fraction) for every PPM warning side of the rulebase.

    A PPM side without a number fails the query with a message that names the item."""
    def number(side: str) -> Column:
        return F.coalesce(F.col(side), F.raise_error(F.concat(
            F.lit("rulebase: PPM limit without a number for item "), F.col("rule_item"))).cast("double"))

    low = rules.where(F.col("warn_low_kind") == KIND_PPM).select(
        "rule_item", F.lit("lower").alias("qid"), ppm_low_fraction(number("warn_low_num")).alias("fraction"))
    high = rules.where(F.col("warn_high_kind") == KIND_PPM).select(
        "rule_item", F.lit("upper").alias("qid"), ppm_high_fraction(number("warn_high_num")).alias("fraction"))
    return low.unionByName(high)


def validate_items(items: list[str], rules: DataFrame) -> None:
    """Raise for items that have no rule (the original fails on lookup too)."""
    spark = rules.sparkSession
    asked = literal_rows(spark, [(i,) for i in items], T.StructType([T.StructField("asked", T.StringType())]))
    lost = asked.join(rules, F.lower("asked") == rules["rule_item"], "left_anti").collect()   # at most the items
    missing = [i for i in items if i in {r[0] for r in lost}]
    if missing:
        raise KeyError(f"items without a rule: {missing}")
