"""The weekly screening loop as a Structured Streaming job.

Weekly telemetry exports land in a folder; a file source picks up their names
one file per micro-batch (oldest first), and ``foreachBatch`` reads that week
by its own header and runs the batch screening plan on it.  A run is named
after its weeks, so a micro-batch replayed after a failure replaces its own
results.  The stream's checkpoint lives under the shared checkpoint folder
unless one is given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fleetpulse.plans.screening import product_spec, run_screening, with_file_order
from fleetpulse.session import ensure_checkpoint_dir, scratch
from fleetpulse.sources import io


def weekly_screening_stream(spark: SparkSession, input_dir: str, rules: DataFrame, product: str,
                            log_kind: str, out: str, checkpoint: str | None = None, kde: bool = True,
                            files_per_week: int = 1, available_now: bool = True,
                            encoding: str | None = None) -> StreamingQuery:
    spec, items = product_spec(product, log_kind)
    # only the names of new files are streamed (their content is pruned)
    names = (spark.readStream.format("binaryFile").schema(spark.read.format("binaryFile").load(input_dir).schema)
             .option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", files_per_week).load(input_dir).select("path"))

    def per_week(week: DataFrame, batch_id: int) -> None:
        files = [r["path"] for r in week.select("path").collect()]          # files_per_week names
        if not files:
            return
        with scratch(spark):
            telemetry = io.read_telemetry_csv(spark, files, items=items, encoding=encoding, log_kind=log_kind)
            run_screening(with_file_order(telemetry), spec, rules, items, kde=kde, out=out,
                          run="+".join(sorted({io.week_of(f) for f in files})))

    default = f"{ensure_checkpoint_dir(spark).rstrip('/')}/weekly-stream-{uuid.uuid4().hex[:12]}"
    writer = names.writeStream.foreachBatch(per_week).option("checkpointLocation", checkpoint or default)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 hour")
    return writer.start()
