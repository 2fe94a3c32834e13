"""Readers and writers.

Telemetry arrives as weekly CSV exports.  Which weeks are read is decided by
file name before anything is opened, files with alike headers are read in one
scan, and columns are matched by name across headers.  Screening results are
kept by run: every run writes below its own ``run=`` folder and is entered in
a record of runs when it is complete, so a run never touches another week's
results, a repeated week replaces its earlier results, and a week without any
listed drive is known to be empty.  The record is a series of numbered commits,
so two writers never hide each other's weeks and a reader may stay at a number.  Every path is caller-supplied (any Hadoop
URI); connection options for JDBC as well.
"""

from __future__ import annotations

import csv
import json
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse import catalog as C
from fleetpulse.functions.rules import RAW_RULE_SCHEMA, literal_rows, parse_rules

HEADER_READERS = 32             # exports whose first lines are read at a time
RESULT_SETS = ("critical", "warning", "bounds", "density", "quarantine")

# Cell texts that mean a missing value in the exports.
MISSING_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
                 "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


# ---------------------------------------------------------------- telemetry files
def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_exports(spark: SparkSession, paths, suffix: str = ".csv") -> list[str]:
    """The exports at ``paths`` (files, folders or patterns), sorted by path; nothing is opened.

    An export is a file, or a folder named like one that holds part files (as Spark writes it)."""
    found = []
    for path in [paths] if isinstance(paths, str) else paths:
        at, fs = _file_system(spark, path)
        for entry in fs.globStatus(at) or []:
            folder = entry.isDirectory() and not entry.getPath().getName().lower().endswith(suffix)
            found += [f.getPath().toString() for f in (fs.listStatus(entry.getPath()) if folder else [entry])
                      if not f.getPath().getName().startswith(("_", "."))]
    exact = [f for f in found if f.lower().endswith(suffix)]
    return sorted(set(exact or found))


# Fixed value: name of an export in a path, without extension; part files belong to their folder.
EXPORT_NAME = r"([^/]+?)(?:\.[^./]*)?(?:/part-[^/]*)?$"


def export_name(path: str) -> str:
    return re.search(EXPORT_NAME, path).group(1)


def week_of(path: str) -> str:
    """Weekly batch of an export: its name without extension and log kind, so that
    the SMART and the extended log of a week belong together."""
    name = export_name(path)
    for kind in sorted(C.LOG_KINDS, key=len, reverse=True):
        if name.endswith(f"_{kind}"):
            return name[:-len(kind) - 1]
    return name


def log_of(path: str) -> str:
    """Log kind in an export's name (empty if none)."""
    name = export_name(path)
    return next((k for k in sorted(C.LOG_KINDS, key=len, reverse=True) if name.endswith(f"_{k}")), "")


def latest_exports(files: list[str], n_weeks: int) -> list[str]:
    """The files of the ``n_weeks`` latest weeks, by name."""
    weeks = sorted({week_of(f) for f in files})[-n_weeks:]
    return [f for f in files if week_of(f) in weeks]


def first_line(spark: SparkSession, path: str, encoding: str | None = None) -> str | None:
    """The first line of one export (of its first part file); nothing else is read."""
    jvm = spark.sparkContext._jvm
    at, fs = _file_system(spark, path)
    if fs.getFileStatus(at).isDirectory():
        parts = sorted((f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-")),
                       key=lambda q: q.getName())
        if not parts:
            return None
        at = parts[0]
    stream = fs.open(at)
    try:
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, encoding or "UTF-8")).readLine()
    finally:
        stream.close()


def parse_header(line: str | None) -> tuple[str, ...]:
    """Column names in a header line (quoted names may hold commas)."""
    cells = next(csv.reader([line]), []) if line else []
    return tuple(c.lstrip("\ufeff").strip() for c in cells)


def header_of(spark: SparkSession, path: str, encoding: str | None = None) -> tuple[str, ...]:
    """Column names of one export: only its first line is read."""
    return parse_header(first_line(spark, path, encoding))


def header_index(spark: SparkSession, files: list[str], encoding: str | None = None) -> dict[tuple[str, ...], list[str]]:
    """The exports by header.  First lines are read side by side, without a Spark job, and each distinct line is
    parsed once, however many exports have it."""
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        lines = list(pool.map(lambda f: first_line(spark, f, encoding), files))
    headers = {line: parse_header(line) for line in set(lines)}
    out: dict[tuple[str, ...], list[str]] = {}
    for f, line in zip(files, lines, strict=True):
        out.setdefault(headers[line], []).append(f)
    return out


def present_text(cell: Column) -> Column:
    """A cell's text, NULL where it stands for a missing value."""
    return F.when(~F.trim(cell).isin(*MISSING_TEXTS), cell)


def telemetry_columns(raw: DataFrame, items: list[str], drop_malformed: bool = True) -> DataFrame:
    """Project a header-named, string-typed telemetry frame by column name.

    System columns stay strings, items become doubles (``try_cast``); texts
    that mean a missing value, and columns missing from the export, read as
    NULL.  With ``drop_malformed`` a row whose item field holds text that is
    neither a number nor missing is dropped, as a typed CSV read in
    DROPMALFORMED mode would.  Works on batch and streaming frames.
    """
    present = set(raw.columns)
    text = {c: (present_text(F.col(f"`{c}`")) if c in present else F.lit(None).cast("string"))
            for c in [*C.SYSTEM_COLUMNS, C.SSDUID, *items]}
    if drop_malformed:
        bad = [text[i].isNotNull() & text[i].try_cast("double").isNull() for i in items if i in present]
        if bad:
            raw = raw.where(~reduce(lambda a, b: a | b, bad))
    keep = [c for c in raw.columns if c not in text]          # e.g. batch, file metadata
    return raw.select(*[text[c].alias(c) for c in [*C.SYSTEM_COLUMNS, C.SSDUID]],
                      *[text[i].try_cast("double").alias(i) for i in items], *keep)


def text_schema(header) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in header])


def read_telemetry_csv(spark: SparkSession, paths, items: list[str] | None = None,
                       schema: T.StructType | None = None, encoding: str | None = None,
                       drop_malformed: bool = True, batch_from_file: bool = True,
                       n_weeks: int | None = None, log_kind: str | None = None) -> DataFrame:
    """Weekly telemetry CSV files, columns matched **by header name**.

    Every file's own header names its columns (a CSV schema is applied by
    position, and exports differ in column order and log kind): files with the
    same header are one scan, and the scans are united by name.  Cells are read
    as text, then ``items`` are cast (see :func:`telemetry_columns`).  Pass
    ``schema`` only for files known to have exactly that column order.
    ``encoding`` covers ISO-8859-1 exports.  With ``batch_from_file`` each row
    carries ``batch`` (the week, :func:`week_of`) and ``log`` (the log kind).
    ``n_weeks`` keeps the files of the latest weeks, ``log_kind`` those of one
    log (and files that name none); the others are not opened.
    """
    reader = spark.read.option("header", True).option("mode", "DROPMALFORMED" if drop_malformed else "PERMISSIVE")
    if encoding:
        reader = reader.option("encoding", encoding)
    files = [f for f in list_exports(spark, paths) if not log_kind or log_of(f) in ("", log_kind)]
    if n_weeks:
        files = latest_exports(files, n_weeks)
    if schema is not None:
        df = reader.schema(schema).csv(files) if files else empty_frame(spark, schema)
        return _with_week(df) if batch_from_file else df
    scans = []
    for header, same in sorted(header_index(spark, files, encoding).items()):
        if header:
            scan = reader.schema(text_schema(header)).csv(same)
            scans.append(telemetry_columns(_with_week(scan) if batch_from_file else scan, list(items or []),
                                           drop_malformed))
    if not scans:
        none = empty_frame(spark, text_schema([*C.SYSTEM_COLUMNS, *(["batch", "log"] if batch_from_file else [])]))
        return telemetry_columns(none, list(items or []), drop_malformed)
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), scans)


def _with_week(df: DataFrame) -> DataFrame:
    """``batch`` and ``log`` of every row, from the name of its export."""
    kinds = "|".join(sorted(C.LOG_KINDS, key=len, reverse=True))
    name = F.regexp_extract(F.col("_metadata.file_path"), EXPORT_NAME, 1)
    return df.withColumns({"batch": F.regexp_replace(name, f"_({kinds})$", ""),
                           "log": F.regexp_extract(name, f"_({kinds})$", 1)})


def read_rulebase_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rulebase CSV (header ``ITEM, CRITICAL_LOW, …, Y_MAX``) parsed to typed rules."""
    return parse_rules(spark.read.schema(RAW_RULE_SCHEMA).option("header", True).csv(path))


def last_batches(df: DataFrame, batch_col: str, n: int) -> DataFrame:
    """Rows of the ``n`` latest batches of a table (by sort order of the batch value).

    For tables that carry their batch as a column; export files are chosen by
    name before reading (:func:`latest_exports`)."""
    latest = df.select(batch_col).distinct().orderBy(F.col(batch_col).desc()).limit(n)
    return df.join(latest, batch_col, "left_semi")


def source_files(df: DataFrame) -> DataFrame:
    """Distinct input file paths of a file-based scan (sorted)."""
    return df.select(F.col("_metadata.file_path").alias("file_path")).distinct().orderBy("file_path")


def empty_frame(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


# ---------------------------------------------------------------- text
def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_text(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a one-string-column frame as text lines."""
    df.write.mode(mode).text(path)


# ---------------------------------------------------------------- result sets
def write_result_set(df: DataFrame, path: str, fmt: str = "parquet", partition_by=("batch", "item"),
                     single_file: bool = False, mode: str = "overwrite", sort_by=(),
                     schema_path: str | None = None) -> None:
    """One table, partitioned so a reader can prune to one batch/item.

    ``single_file`` coalesces to one partition (small outputs such as lists);
    ``sort_by`` orders rows inside each output file (no global sort); CSV
    output carries a header.  The schema is kept beside the data, so that an
    empty table reads back with its columns (:func:`read_table`).
    """
    cols = [c for c in partition_by if c in df.columns]
    if single_file:
        df = df.coalesce(1)
    if sort_by:                # behind the folders, as the writer would sort anew by them
        df = df.sortWithinPartitions(*cols, *sort_by)
    w = df.write.mode(mode)
    if cols:
        w = w.partitionBy(*cols)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)
    _keep_schema(df, schema_path or f"{path.rstrip('/')}/_schema")


def _keep_schema(df: DataFrame, path: str) -> None:
    literal_rows(df.sparkSession, [(df.schema.json(),)], text_schema(["value"])).coalesce(1) \
        .write.mode("overwrite").text(path)


def _kept_schema(spark: SparkSession, path: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(spark.read.text(path).first()[0]))


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table written by :func:`write_result_set`, empty or not."""
    reader = spark.read.format(fmt).schema(_kept_schema(spark, f"{path.rstrip('/')}/_schema"))
    return (reader.option("header", True) if fmt == "csv" else reader).load(path)


def write_run(results: dict[str, DataFrame], base: str, fmt: str = "parquet", batches: DataFrame | None = None,
              run: str | None = None, sort_by=()) -> str:
    """Writes the result sets of one run; returns the run's name.  Readers do not see it before :func:`commit_run`.

    Each set goes to ``base/<name>/run=<run>`` (partitioned by batch and item),
    its schema to ``base/_schema/<name>`` (apart from the data), and the run's
    batches to ``base/runs/run=<run>``.  ``batches``: the batches that were
    screened, default those of the bounds.
    """
    base, run = base.rstrip("/"), run or uuid.uuid4().hex
    sets = {k: v for k, v in results.items() if v is not None}
    for name, df in sets.items():
        write_result_set(df, f"{base}/{name}/run={run}", fmt=fmt, sort_by=sort_by, schema_path=f"{base}/_schema/{name}")
    batches = results["bounds"].select("batch") if batches is None else batches.select("batch")
    batches.distinct().coalesce(1).withColumns({"run_name": F.lit(run), "written_at": F.current_timestamp()}) \
        .write.mode("overwrite").parquet(f"{base}/runs/run={run}")
    return run


# Fixed value: name of a commit file.
COMMIT = re.compile(r"(\d{10})\.commit$")


def commits(spark: SparkSession, base: str, version: int | None = None) -> list[tuple[int, str]]:
    """``version, run`` of every commit, oldest first, up to ``version``."""
    at, fs = _file_system(spark, f"{base.rstrip('/')}/commits")
    if not fs.exists(at):
        return []
    found = sorted((int(m.group(1)), f.getPath().toString()) for f in fs.listStatus(at) if (m := COMMIT.search(f.getPath().getName())))
    runs = [(v, first_line(spark, path)) for v, path in found if version is None or v <= version]
    return [(v, run) for v, run in runs if run]            # a commit that was never filled belongs to a writer that died


class StaleVersion(RuntimeError):
    """Another run was committed since the version this one builds on."""


def commit_run(spark: SparkSession, base: str, run: str, after: int | None = None) -> int:
    """Makes a written run visible; returns its version.  A run that builds on version ``after`` gets the next number
    or, where that is taken, :class:`StaleVersion` (a file left empty by a writer that died has to be removed first).

    A version is a file that only one writer can create: whoever finds it taken tries the next number.  The order
    of versions, not a clock, decides which run holds a batch.  (The file system must create files exclusively, as
    HDFS and the object stores with conditional writes do; Hadoop's local one does not, so Python creates the file.)"""
    folder = f"{base.rstrip('/')}/commits"
    at, fs = _file_system(spark, folder)
    fs.mkdirs(at)
    taken = [int(m.group(1)) for f in fs.listStatus(at) if (m := COMMIT.search(f.getPath().getName()))]
    version = (max(taken, default=0) if after is None else after) + 1
    while True:
        path, _ = _file_system(spark, f"{folder}/{version:010d}.commit")
        try:
            if fs.getUri().getScheme() == "file":
                out = open(path.toUri().getPath(), "xb")
            else:
                out = fs.create(path, False)
        except (FileExistsError, Py4JJavaError):
            if not fs.exists(path):
                raise
            if after is not None:
                raise StaleVersion(f"version {version} of {base} is taken") from None
            version += 1
            continue
        out.write(bytearray(run.encode()))
        out.close()
        return version


def write_screening(results: dict[str, DataFrame], base: str, fmt: str = "parquet", batches: DataFrame | None = None,
                    run: str | None = None, sort_by=()) -> str:
    """Writes and commits the result sets of one run (:func:`write_run`, :func:`commit_run`); returns its name.

    A run that is repeated under its name replaces itself."""
    run = write_run(results, base, fmt, batches, run, sort_by)
    spark = next(df for df in results.values() if df is not None).sparkSession
    commit_run(spark, base, run)
    return run


def read_runs(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """``batch, run``: the run that holds the results of each batch, by the last commit, or as of ``version``."""
    known = commits(spark, base, version)
    runs = spark.read.parquet(f"{base.rstrip('/')}/runs")
    schema = T.StructType([T.StructField("version", T.LongType()), T.StructField("run_name", T.StringType())])
    order = literal_rows(spark, known, schema) if known else empty_frame(spark, schema)
    return runs.join(order, "run_name").groupBy("batch").agg(F.max_by("run_name", "version").alias("run"))


def newest_batch(spark: SparkSession, base: str, version: int | None = None):
    """The newest batch that was screened, whether or not any drive was listed."""
    return read_runs(spark, base, version).agg(F.max("batch")).first()[0]


def read_result_set(spark: SparkSession, base: str, name: str, fmt: str = "parquet",
                    latest_only: bool = False, version: int | None = None) -> DataFrame:
    """A result set over all batches, each from its latest run; ``latest_only`` gives the
    newest batch of the record of runs, which may be empty.  ``version`` reads the store as
    of that commit, whatever was committed since."""
    base = base.rstrip("/")
    path = f"{base}/{name}"
    schema = _kept_schema(spark, f"{base}/_schema/{name}")
    runs = read_runs(spark, base, version).withColumnRenamed("batch", "run_batch").withColumnRenamed("run", "run_name")
    reader = spark.read.format(fmt).schema(T.StructType([*schema.fields, T.StructField("run", T.StringType())]))
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.load(path)
    if latest_only:
        newest = newest_batch(spark, base, version)
        df = df.where(F.col("batch") == F.lit(newest))
    return df.join(runs, (df["batch"] == runs["run_batch"]) & (df["run"] == runs["run_name"]), "left_semi").drop("run")


def write_abnormal_rows(rows: DataFrame, path: str, fmt: str = "csv", sort_by=()) -> None:
    """Raw rows of re-checked drives, one folder per (class, item), sorted by
    ``sort_by`` (e.g. drive, timestamp) inside each file."""
    write_result_set(rows, path, fmt=fmt, partition_by=("class", "item"), sort_by=sort_by)


# ---------------------------------------------------------------- JDBC
def write_jdbc(df: DataFrame, url: str, table: str, properties: dict, mode: str = "append") -> None:
    """Append (or ``mode``) a frame to a JDBC table; connection options are the caller's."""
    df.write.jdbc(url, table, mode=mode, properties=properties)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict,
              partition_column: str | None = None, lower_bound=None, upper_bound=None,
              num_partitions: int | None = None) -> DataFrame:
    """Read a JDBC table; with a partition column the read is split over executors."""
    if partition_column:
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower_bound,
                               upperBound=upper_bound, numPartitions=num_partitions, properties=properties)
    return spark.read.jdbc(url, table, properties=properties)
