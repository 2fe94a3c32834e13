"""Session helpers: one place for the configuration every run relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that matter for correctness (ANSI semantics, UTC days) and for the
# adaptive runtime (partition coalescing, skew-join splitting).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "fleetpulse", extra: dict | None = None) -> SparkSession:
    """``master=None`` keeps the master given by ``spark-submit``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must name a shared file system; only a ``local``
    master (tests, a laptop) gets a default on the machine.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = os.path.join(tempfile.gettempdir(), "fleetpulse-checkpoints")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


_SCRATCH: list[str] = []        # folders written by materialize() that still exist


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint location."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def materialize(df, name: str = "stage"):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    One job, and the lineage ends at reliable storage (an executor loss later
    never recomputes the upstream plan); the planner knows the table's size.
    The folder lives until the surrounding :func:`scratch` scope ends or
    :func:`release` is called.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    # the schema is known: an empty result (no data files) reads back as empty
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, kept: int = 0) -> int:
    """Delete the intermediate tables written since ``kept`` of them existed; returns their number.

    Call it when everything derived from them has been written or collected."""
    gone = 0
    while len(_SCRATCH) > kept:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        gone += 1
    return gone


def settle(spark: SparkSession, build, name: str = "stage"):
    """Materialize what ``build()`` returns and delete the intermediate tables it wrote."""
    kept = len(_SCRATCH)
    df = materialize(build(), name)
    written = _SCRATCH.pop()
    release(spark, kept)
    _SCRATCH.append(written)
    return df


@contextmanager
def scratch(spark: SparkSession):
    """Scope of a run: the intermediate tables written inside are deleted at its end."""
    kept = len(_SCRATCH)
    try:
        yield
    finally:
        release(spark, kept)
