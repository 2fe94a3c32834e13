"""Driver tables mapped onto the telemetry model, and the literal rulebases.

* ``events``   -> single-item telemetry: drive ``user_id``, reading time ``ts``,
  firmware ``event_type`` (sentinel ``error``), identity ``upper(event_type)``,
  item ``value``; ``event_id`` breaks timestamp ties.
* ``lineitem`` -> multi-item telemetry: drive ``l_suppkey``, time
  ``l_shipdate``, items quantity / extendedprice / discount / tax, the month
  as the reporting day; ``(l_orderkey, l_linenumber)`` breaks ties.
* ``orders``   -> last-reading histograms: drive ``o_custkey``, time
  ``o_orderdate``, item ``o_totalprice``, category ``o_orderpriority``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetpulse.catalog import TelemetrySpec
from fleetpulse.functions.rules import rules_from_rows

EVENTS = TelemetrySpec(serial="user_id", timestamp="ts", firmware="event_type", error_value="error",
                       tiebreak=("event_id",), items=("value",), identity="upper(event_type)")

LINEITEM_ITEMS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINEITEM = TelemetrySpec(serial="l_suppkey", timestamp="l_shipdate", firmware=None,
                         tiebreak=("l_orderkey", "l_linenumber"), items=LINEITEM_ITEMS,
                         day="to_date(date_trunc('month', l_shipdate))")

ORDERS = TelemetrySpec(serial="o_custkey", timestamp="o_orderdate", firmware=None,
                       tiebreak=("o_orderkey",), items=("o_totalprice",))

# Rulebases used by the registered queries (ITEM, CRITICAL_LOW, CRITICAL_HIGH,
# WARNING_LOW, WARNING_HIGH, Y_FORMAT, Y_MIN, Y_MAX).
EVENTS_RULES = [("value", "EMPTY", "VALUE,250", "PPM,10000", "PPM,10000", "-", "0", None)]
LINEITEM_RULES = [
    ("l_quantity", "VALUE,1", "VALUE,50", "PPM,20000", "PPM,20000", "-", "0", "60"),
    ("l_extendedprice", "EMPTY", "VALUE,100000", "EMPTY", "PPM,50000", "TB", "0", None),
    ("l_discount", "EMPTY", "EMPTY", "VALUE,0.01", "VALUE,0.09", "-", "0", "0.1"),
    ("l_tax", "VALUE,0", "EMPTY", "PPM,100000", "EMPTY", "-", "0", None),
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_rules(spark: SparkSession) -> DataFrame:
    return rules_from_rows(spark, EVENTS_RULES)


def lineitem_rules(spark: SparkSession) -> DataFrame:
    return rules_from_rows(spark, LINEITEM_RULES)
