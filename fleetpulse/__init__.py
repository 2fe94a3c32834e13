"""fleetpulse: Spark-native screening and trend analytics for device telemetry.

Every public function maps DataFrames to DataFrames; nothing gathers a fleet on
the driver.  The layout:

* ``sources``   - telemetry / rulebase / text / JDBC readers and result-set writers
* ``functions`` - column expressions (threshold grammar, unit conversion, colours)
* ``operators`` - keep-last, long format, exact quantiles, screening, density,
                  history re-check, plot-data tables
* ``plans``     - composite runs (weekly screening, trend data, histograms)
                  and the registered driver queries
* ``streaming`` - the weekly screening loop as a Structured Streaming job
"""

from fleetpulse.catalog import TelemetrySpec  # noqa: F401
