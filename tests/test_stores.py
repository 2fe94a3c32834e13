"""History by data skipping, commits of runs, matrices in blocks, distinct rows, header index."""

import pathlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.operators import daily as D
from fleetpulse.operators import distinct as U
from fleetpulse.operators import matrix as X
from fleetpulse.sources import history as HS
from fleetpulse.sources import io
from fleetpulse.sources import lastread as LR


# ---------------------------------------------------------------- history
def scanned(df) -> int:
    """Rows that the file scan of ``df`` gave, before any filter in the plan."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    leaves = plan.collectLeaves()
    return max(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size())
               if "Scan parquet" in leaves.apply(i).nodeName() and leaves.apply(i).metrics().contains("numOutputRows"))


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("history") / "store")
    n = 60_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("d"), (F.xxhash64("id") % 2000).cast("string"))).alias("drive"),
        (F.col("id") % 7).alias("week"), F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").cast("double").alias("value"))
    HS.write_history(rows, base, "drive", "ts", batch="week", buckets=8, distinct_drives=500, row_group_bytes=4096, files=12)
    return base, rows


def test_only_parts_of_listed_drives_are_read(spark, history):
    base, rows = history
    listed = spark.createDataFrame([("d17",), ("d-400",), (None,), ("absent",), ("d17",)], "drive string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = HS.read_history(spark, base, listed, "drive", buckets=8)
        assert scanned(got) < 60_000 / 8
        far = HS.read_history(spark, base, listed, "drive", buckets=8, pushed=1)       # folders only
        assert scanned(got) < scanned(far) < 60_000 * 0.6
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    want = rows.join(listed, "drive", "left_semi").select("drive", "week", "value")
    for df in (got, far):
        assert sorted(map(tuple, df.select("drive", "week", "value").collect())) == sorted(map(tuple, want.collect()))


def test_history_of_a_hot_drive_and_of_none(spark, history):
    base, rows = history
    hot = HS.read_history(spark, base, spark.createDataFrame([("hot",)], "drive string"), "drive", buckets=8)
    assert hot.count() == 20_000
    files = {f for f in spark.read.parquet(base).where("drive = 'hot'").select(F.col("_metadata.file_path")).distinct().collect()}
    assert len(files) > 7                                     # cut by time, not one file
    none = HS.read_history(spark, base, spark.createDataFrame([], "drive string"), "drive", buckets=8)
    assert none.count() == 0


def test_a_batch_is_replaced(spark, tmp_dir):
    base = f"{tmp_dir}/store"
    rows = spark.createDataFrame([("a", 1, 1, 1.0), ("a", 2, 2, 2.0), ("b", 1, 3, 3.0)], "drive string, week int, ts int, value double")
    HS.write_history(rows, base, "drive", "ts", batch="week")
    HS.write_history(rows.where("week = 2").withColumn("value", F.lit(9.0)), base, "drive", "ts", batch="week")
    back = HS.read_history(spark, base, rows, "drive")
    assert sorted(map(tuple, back.select("drive", "week", "value").collect())) == [("a", 1, 1.0), ("a", 2, 9.0), ("b", 1, 3.0)]


# ---------------------------------------------------------------- commits
def test_writers_take_versions_of_their_own(spark, tmp_dir):
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(8) as pool:
        versions = list(pool.map(lambda k: io.commit_run(spark, tmp_dir, f"run{k}"), range(24)))
    assert sorted(versions) == list(range(1, 25))
    assert sorted(io.commits(spark, tmp_dir)) == sorted((v, f"run{k}") for k, v in enumerate(versions))
    assert [v for v, _ in io.commits(spark, tmp_dir, version=5)] == [1, 2, 3, 4, 5]


def test_an_unfilled_commit_is_no_run(spark, tmp_dir):
    io.commit_run(spark, tmp_dir, "one")
    open(f"{tmp_dir}/commits/0000000002.commit", "w").close()          # its writer died
    assert io.commit_run(spark, tmp_dir, "three") == 3
    assert io.commits(spark, tmp_dir) == [(1, "one"), (3, "three")]


def test_runs_by_commit_not_by_clock(spark, tmp_dir):
    bounds = lambda *weeks: {"bounds": spark.createDataFrame([(w, "i", 1.0) for w in weeks], "batch string, item string, lower double")}
    old = io.write_run(bounds("w1", "w2"), tmp_dir)
    new = io.write_run(bounds("w2", "w3"), tmp_dir)
    lost = io.write_run(bounds("w9"), tmp_dir)                          # never committed
    assert io.read_runs(spark, tmp_dir).collect() == []
    io.commit_run(spark, tmp_dir, new)
    io.commit_run(spark, tmp_dir, old)
    runs = lambda **at: {r.batch: r.run for r in io.read_runs(spark, tmp_dir, **at).collect()}
    assert runs() == {"w1": old, "w2": old, "w3": new} and runs(version=1) == {"w2": new, "w3": new}
    assert lost not in runs().values() and io.newest_batch(spark, tmp_dir) == "w3"
    assert sorted(r.batch for r in io.read_result_set(spark, tmp_dir, "bounds").collect()) == ["w1", "w2", "w3"]
    assert sorted(r.batch for r in io.read_result_set(spark, tmp_dir, "bounds", version=1).collect()) == ["w2", "w3"]


# ---------------------------------------------------------------- matrices
def test_blocks_equal_a_pivot(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "hot", "hot", None]), rng.choice([None, *range(-40, 300)]), rng.choice([None, rng.random()]))
            for _ in range(4000)]
    df = spark.createDataFrame(rows, "r string, c int, value double").repartition(5)
    index = X.column_index(df, "c", slices=7)
    columns = sorted({c for _, c, _ in rows if c is not None})
    assert {r.c: r.idx for r in index.collect()} == {c: k for k, c in enumerate(columns)}
    got = {(r.r, r.block): r.cells for r in X.matrix_blocks(df, "r", "c", width=16, index=index).collect()}
    cells = {}
    for r, c, v in rows:
        if None not in (r, c, v):
            cells.setdefault((r, columns.index(c)), []).append(v)
    want = {}
    for (r, i), v in cells.items():
        want.setdefault((r, i // 16), [None] * 16)[i % 16] = np.mean(v)
    assert set(got) == set(want)
    for key, cells in want.items():
        assert got[key] == pytest.approx(cells)
    back = X.matrix_cells(X.matrix_blocks(df, "r", "c", width=16, index=index), "r", "c", index, width=16)
    assert back.count() == sum(v is not None for c in want.values() for v in c)


def test_a_block_costs_a_step_per_cell_that_is_there(spark):
    """One cell in a block of many: no step for each place, and no look-up of it."""
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 5, 2.0), ("b", 7, 3.0), ("b", 9, 4.0)], "r string, c int, value double")
    index = spark.createDataFrame([(0, 0), (5, 127), (7, 130), (9, 255)], "c int, idx long")
    blocks = X.matrix_blocks(df, "r", "c", index=index)
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "element_at(map" not in plan and "127" in plan
    got = {(r.r, r.block): r.cells for r in blocks.collect()}
    assert got == {("a", 0): [1.0, *[None] * 126, 2.0], ("b", 1): [None, None, 3.0, *[None] * 124, 4.0]}


def test_several_readings_in_a_unique_cell_fail(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0)], "r string, c int, value double")
    with pytest.raises(Exception, match="several readings in cell 1"):
        X.matrix_blocks(df, "r", "c", how="unique").collect()
    assert X.matrix_blocks(df.where("false"), "r", "c").collect() == []


# ---------------------------------------------------------------- distinct rows
def test_distinct_rows_with_meeting_fingerprints(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.randint(0, 30), rng.choice(["x", "y", None]), rng.choice([0.0, -0.0, 1.5])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a int, b string, `c d` double")
    want = df.select(F.count_distinct("a", "b", "`c d`")).first()[0]
    assert U.count_distinct_rows(df).first()[0] == want
    monkeypatch.setattr(U, "fingerprint", lambda cols: [(cols[0] % 3).alias("_f1"), F.lit(0).alias("_f2")])   # unlike rows meet
    assert U.count_distinct_rows(df).first()[0] == want
    assert U.count_distinct_rows(df, ["a"]).first()[0] == df.select("a").distinct().count()
    assert U.count_distinct_rows(df.where("false")).first()[0] == 0


def test_fingerprints_move_instead_of_rows(spark, tmp_dir):
    spark.range(20_000).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 8).alias("wide")).write.parquet(f"{tmp_dir}/t")
    df = spark.read.parquet(f"{tmp_dir}/t")
    assert U.count_distinct_rows(df).first()[0] == 20_000


# ---------------------------------------------------------------- headers
def test_headers_of_many_exports_without_a_job(spark, tmp_dir):
    import os
    os.makedirs(f"{tmp_dir}/in")
    headers = ['TIMESTAMP,DriveSerialNumber,Temperature', '﻿DriveSerialNumber,"odd, name",Temperature,TIMESTAMP', ""]
    for k in range(500):
        with open(f"{tmp_dir}/in/P_{k:04d}_SMART.csv", "w") as f:
            f.write(headers[k % 3] + "\n" + {0: f"2024-01-01,d{k},{k}", 1: f"d{k},x,{k},2024-01-01", 2: ""}[k % 3] + "\n")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        df = io.read_telemetry_csv(spark, f"{tmp_dir}/in", items=["Temperature"])
        assert len(tracker.getJobIdsForGroup("headers")) <= 2
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = sorted((r.DriveSerialNumber, r.Temperature) for r in df.collect())
    assert got == sorted((f"d{k}", float(k)) for k in range(500) if k % 3 < 2)
    assert io.parse_header('a,"b ""c"", d", e ') == ("a", 'b "c", d', "e")


# ---------------------------------------------------------------- last readings, week by week
READINGS = "drive string, log string, ts long, no long, value double"


def test_last_readings_merge_without_moving_the_store(spark, tmp_dir):
    rng, base, seen = random.Random(11), f"{tmp_dir}/last", []
    for week in range(4):
        rows = [(rng.choice(["hot", "hot", None, "", f"d{rng.randrange(200)}"]), rng.choice(["a", None]),
                 rng.choice([None, rng.randrange(1000)]), 1000 * week + k, rng.random()) for k in range(500)]
        seen += rows
        new = spark.createDataFrame(rows, READINGS)
        if week:
            stored = LR.read_last(spark, base, new, buckets=4)
            plan = LR.merged(stored, new, ["drive", "log"], ["ts", "no"])._jdf.queryExecution().toString()
            old, of_new = plan.split("== Physical Plan ==")[1].split("Bucketed: true")[0], plan.count("Exchange")
            assert "Bucketed: true" in plan and "Exchange" not in old and of_new == 2       # keep-last, then the buckets
        assert LR.merge_last(new, base, ["drive", "log"], ["ts", "no"], buckets=4) == week + 1
        want = D.keep_last(spark.createDataFrame(seen, READINGS), ["drive", "log"], ["ts", "no"])
        got = LR.read_last(spark, base, new, buckets=4)
        assert sorted(map(str, got.drop(LR.KEY).collect())) == sorted(map(str, want.collect()))
    files = [f for f in (pathlib.Path(base) / io.commits(spark, base)[-1][1]).glob("*.parquet")]
    assert 0 < len(files) <= 4                                                               # one a bucket
    assert LR.read_last(spark, base, new, version=1, buckets=4).agg(F.max("no")).first()[0] < 1000
    with pytest.raises(io.StaleVersion):
        io.commit_run(spark, base, "version=late", after=3)


def test_last_readings_of_nothing(spark, tmp_dir):
    none = spark.createDataFrame([], READINGS)
    assert LR.read_last(spark, f"{tmp_dir}/none", none) is None
    assert LR.merge_last(none, f"{tmp_dir}/none", ["drive"], ["ts"], buckets=2) == 1
    assert LR.merge_last(none, f"{tmp_dir}/none", ["drive"], ["ts"], buckets=2) == 2
    assert LR.read_last(spark, f"{tmp_dir}/none", none, buckets=2).count() == 0
