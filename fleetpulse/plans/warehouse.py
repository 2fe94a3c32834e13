"""Warehouse round trip of a rulebase (or any small table) over JDBC.

Append the table, read it back (optionally split over executors by a numeric
column), count rows and distinct rows, and query it with SQL through a temp
view.  URL and connection properties are always supplied by the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.sources import io


def table_report(spark: SparkSession, table: DataFrame, view: str = "crit_warn_info",
                 like_column: str = "CRITICAL_LOW", like_prefix: str = "VALUE") -> dict[str, DataFrame]:
    """Row count, distinct row count (rows with a NULL excluded) and a LIKE query."""
    table.createOrReplaceTempView(view)
    return {
        "rows": table,
        "count": table.select(F.count(F.lit(1)).alias("n")),
        "distinct": table.select(F.count_distinct(*[F.col(f"`{c}`") for c in table.columns]).alias("n")),
        "like": spark.sql(f"SELECT * FROM {view} WHERE `{like_column}` LIKE '{like_prefix}%'"),
    }


def jdbc_round_trip(spark: SparkSession, table: DataFrame, url: str, name: str, properties: dict,
                    mode: str = "append", **read_options) -> dict[str, DataFrame]:
    io.write_jdbc(table, url, name, properties, mode=mode)
    back = io.read_jdbc(spark, url, name, properties, **read_options)
    return table_report(spark, back)
