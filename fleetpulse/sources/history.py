"""A history of readings clustered by drive, of which only the parts that may hold listed drives are read.

Written: rows go to ``batch=…/bucket=…`` folders (bucket: a hash of the drive), range-partitioned and sorted by
(bucket, drive, time), so that a drive's rows lie together, a hot drive is cut by time, and every row group spans
few drives.  Its Parquet footer holds their least and largest drive and a Bloom filter of the drives.

Read: the buckets of the listed drives prune folders.  For lists of up to ``PUSHED`` drives the drives themselves
are pushed into the scan, where row groups whose range or Bloom filter excludes them are not read; longer lists
meet nearly every row group and skip folders only.  The semi join with the list decides in any case.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.session import materialize

BUCKETS = 64
PUSHED = 1000                   # listed drives pushed into the scan
IN_VALUES = 10                  # of one pushed IN: Spark pushes longer ones as a range only


def bucket_of(drive: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(drive.cast("string")), F.lit(buckets)).cast("int")


def write_history(rows: DataFrame, base: str, drive: str, time: str, batch: str | None = None, buckets: int = BUCKETS,
                  distinct_drives: int = 100_000, row_group_bytes: int | None = None, files: int | None = None) -> None:
    """Adds ``rows`` to the history at ``base``; a batch that is there already is replaced.

    ``distinct_drives``: drives expected in a file, the size of its Bloom filters."""
    folders = [*([batch] if batch else []), "bucket"]
    placed = rows.withColumn("bucket", bucket_of(F.col(drive), buckets))
    files = files or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    writer = placed.repartitionByRange(files, *folders, drive, time).sortWithinPartitions(*folders, drive, time).write \
        .mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders) \
        .option(f"parquet.bloom.filter.enabled#{drive}", "true") \
        .option(f"parquet.bloom.filter.expected.ndv#{drive}", str(distinct_drives))
    if row_group_bytes:
        writer = writer.option("parquet.block.size", str(row_group_bytes))
    writer.parquet(base)


def read_history(spark: SparkSession, base: str, drives: DataFrame, drive: str, buckets: int = BUCKETS,
                 pushed: int = PUSHED) -> DataFrame:
    """All rows of the drives in ``drives`` (its column ``drive``), without the bucket column.

    ``buckets`` as written.  Null drives are never listed."""
    listed = materialize(drives.select(drive).where(F.col(drive).isNotNull()).distinct(), "listed-drives")
    needed = [r[0] for r in listed.select(bucket_of(F.col(drive), buckets)).distinct().collect()]   # at most `buckets`
    rows = spark.read.parquet(base).where(F.col("bucket").isin(needed))
    few = [r[0] for r in listed.limit(pushed + 1).collect()]                                         # at most `pushed` + 1
    if few and len(few) <= pushed:
        chunks = [F.col(drive).isin(few[k:k + IN_VALUES]) for k in range(0, len(few), IN_VALUES)]
        while len(chunks) > 1:                             # a balanced tree of ORs
            chunks = [reduce(lambda a, b: a | b, chunks[k:k + 2]) for k in range(0, len(chunks), 2)]
        rows = rows.where(chunks[0])
    return rows.join(listed, drive, "left_semi").drop("bucket")
