"""End to end through the public runs: weekly CSV exports -> screening result
sets -> trend / special-item / histogram tables; the streaming loop; sources."""

import csv
import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse import catalog as C
from fleetpulse.plans import screening as SC
from fleetpulse.plans import trends as TR
from fleetpulse.plans.warehouse import table_report
from fleetpulse.sources import io

PRODUCT, LOG = "PM963", "SMART"


def write_week(path, week_start, n_drives=12, seed=0, error_rows=True, encoding="utf-8", malformed=False):
    rng = np.random.default_rng(seed)
    items = C.screening_items(PRODUCT, LOG)
    # exports carry their own column order and extra columns: items first,
    # system columns after, plus a column the jobs never use
    header = list(reversed(items)) + ["AvailSpareThreshold"] + C.SYSTEM_COLUMNS + [C.SSDUID]
    with open(path, "w", newline="", encoding=encoding) as fh:
        w = csv.writer(fh)
        w.writerow(header)
        for d in range(7):
            day = week_start + dt.timedelta(days=d)
            for s in range(n_drives):
                for hour in (3, 15):
                    vals = [float(np.round(rng.normal(40 + s, 3), 1)) for _ in items]
                    vals[items.index("CritWarning")] = 4.0 if (s == 1 and d == 6) else 0.0
                    fw = "ERRORMOD" if (error_rows and s == 2 and hour == 15) else "FW1"
                    ssd = ("uid%d" % s).upper() if hour == 3 else "uid%d" % s
                    w.writerow(list(reversed(vals)) + [10.0] +
                               [f"{day} {hour:02d}:00:00", "c", "n", "g", "h", "p", f"SN{s:03d}", fw, ssd])
        if malformed:
            w.writerow(["x"] * (len(header) - 9) + ["garbage", "c", "n", "g", "h", "p", "SNX", "FW1", "u"])


def write_rules(path):
    items = C.screening_items(PRODUCT, LOG)
    with open(path, "w", newline="") as fh:
        w = csv.writer(fh)
        w.writerow(["ITEM", "CRITICAL_LOW", "CRITICAL_HIGH", "WARNING_LOW", "WARNING_HIGH", "Y_FORMAT", "Y_MIN", "Y_MAX"])
        for i in items:
            if i == "Temperature":
                w.writerow(["temperature", "EMPTY", "VALUE,55", "PPM,100000", "PPM,100000", "-", "0", "80"])
            elif i == "DataUnitsRead":
                w.writerow(["dataunitsread", "EMPTY", "EMPTY", "EMPTY", "VALUE,55", "TB", "0", ""])
            else:
                w.writerow([i.lower(), "VALUE,0", "EMPTY", "EMPTY", "PPM,50000", "-", "0", ""])


@pytest.fixture(scope="module")
def exports(tmp_path_factory):
    base = tmp_path_factory.mktemp("exports")
    data = base / "ssd"
    data.mkdir()
    write_week(data / "PM963_2021_w33_SMART.csv", dt.date(2021, 8, 16), seed=1)
    write_week(data / "PM963_2021_w34_SMART.csv", dt.date(2021, 8, 23), seed=2, malformed=True)
    write_week(data / "PM963_2021_w32_SMART.csv", dt.date(2021, 8, 9), seed=3)
    write_rules(base / "rules.csv")
    return base


def test_telemetry_scan(spark, exports):
    items = C.screening_items(PRODUCT, LOG)
    raw = io.read_telemetry_csv(spark, str(exports / "ssd"), items=items)
    # malformed row dropped once its item columns are parsed (CSV column pruning)
    assert len(raw.select("TIMESTAMP", *items).where(F.col("TIMESTAMP") == "garbage").collect()) == 0
    assert sorted(tuple(r) for r in raw.select("batch", "log").distinct().collect()) == [
        ("PM963_2021_w32", "SMART"), ("PM963_2021_w33", "SMART"), ("PM963_2021_w34", "SMART")]
    two = io.read_telemetry_csv(spark, str(exports / "ssd"), items=items, n_weeks=2)
    assert sorted(f[-18:] for f in two.inputFiles()) == ["_2021_w33_SMART.csv"[-18:], "_2021_w34_SMART.csv"[-18:]]
    assert io.last_batches(raw, "batch", 2).select("batch").distinct().count() == 2
    assert io.source_files(raw).count() == 3


def test_iso_8859_1_scan(spark, tmp_dir):
    p = os.path.join(tmp_dir, "w.csv")
    with open(p, "w", encoding="ISO-8859-1") as fh:
        fh.write("TIMESTAMP,DriveSerialNumber,Cluster\n2021-08-23 01:00:00,SN\xe9,c\n")
    schema = "TIMESTAMP string, DriveSerialNumber string, Cluster string"
    from pyspark.sql import types as T  # noqa: F401
    df = io.read_telemetry_csv(spark, p, schema=T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL")
                               else spark.createDataFrame([], schema).schema, encoding="ISO-8859-1")
    assert df.first().DriveSerialNumber == "SNé"


@pytest.fixture(scope="module")
def screened(spark, exports, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("results"))
    res = SC.screen_product(spark, str(exports / "ssd"), str(exports / "rules.csv"), PRODUCT, LOG, out, n_weeks=2)
    return out, res


def test_screening_run_writes_result_sets(spark, screened):
    out, res = screened
    for name in ("critical", "warning", "bounds", "density", "quarantine"):
        assert os.path.isdir(os.path.join(out, name))
    crit = io.read_result_set(spark, out, "critical")
    assert {r.batch for r in crit.select("batch").distinct().collect()} <= {
        "PM963_2021_w33", "PM963_2021_w34"}
    # drive SN011 has mean 51 and sd 3: Temperature above 58 happens -> critical on some week
    temps = crit.where(F.col("item") == "Temperature").select("DriveSerialNumber").distinct().collect()
    assert len(temps) >= 1
    q = io.read_result_set(spark, out, "quarantine", fmt="parquet")
    assert q.where(F.col("FirmwareRevision") != "ERRORMOD").count() == 0 and q.count() == 2 * 7 * 1
    dens = io.read_result_set(spark, out, "density")
    per_day = dens.groupBy("batch", "item", "date").agg(F.count("*").alias("n"), F.max("cdf").alias("m"))
    assert per_day.where(F.col("n") != 100).count() == 0
    assert per_day.where(F.col("m").isNotNull() & (F.abs(F.col("m") - 1) > 1e-9)).count() == 0
    # classes partition the drives
    latest = io.read_result_set(spark, out, "warning", latest_only=True)
    both = latest.join(io.read_result_set(spark, out, "critical", latest_only=True),
                       ["batch", "item", "DriveSerialNumber"])
    assert both.count() == 0


def test_trend_and_special_and_histograms(spark, exports, screened):
    out, _ = screened
    items = C.screening_items(PRODUCT, LOG)
    spec, _ = SC.product_spec(PRODUCT, LOG)
    raw = SC.with_file_order(io.read_telemetry_csv(spark, str(exports / "ssd"),
                                                   items=items)).withColumn("SSDUID", F.col("SSDUID"))
    results = {n: io.read_result_set(spark, out, n) for n in ("critical", "warning", "bounds", "density")}
    trend_items = [i for i in C.trend_items(PRODUCT) if i in items]
    rules = io.read_rulebase_csv(spark, str(exports / "rules.csv"))
    t = TR.trend_data(raw, spec, rules, results, trend_items)
    counts = t["recheck_counts"].collect()
    assert all(r.n_after <= r.n_before for r in counts)
    assert t["history"].where(F.col("identity") != F.upper(F.col("SSDUID"))).count() == 0
    assert t["heatmap"].where((F.col("opacity") < -1e-9) | (F.col("opacity") > 1 + 1e-9)).count() == 0
    assert t["axis"].count() > 0
    t["trend_points"].count()
    t["baseline"].count()
    sp = TR.special_item_data(raw, spec, {"CritWarning": 0.0})
    assert {r.DriveSerialNumber for r in sp["listed"].collect()} == {"SN001"}
    assert sp["series"].where(F.col("span") == "short").count() >= 1
    h = TR.last_reading_data(raw.where(F.col("batch") == "PM963_2021_w34"), spec, rules, C.histogram_items(PRODUCT, LOG), C.bar_items(LOG))
    n_drives = len({r.DriveSerialNumber for r in raw.select("DriveSerialNumber", *items).collect()})
    hist = h["histogram"].groupBy("item").agg(F.sum("n").alias("n")).collect()
    assert all(r.n <= n_drives for r in hist) and len(hist) == len(C.histogram_items(PRODUCT, LOG))
    assert h["bars"].groupBy("item").agg(F.sum("n")).first()[1] == n_drives


def test_streaming_weekly_loop(spark, exports, tmp_path_factory):
    from fleetpulse.streaming.weekly import weekly_screening_stream
    out = str(tmp_path_factory.mktemp("stream-out"))
    rules = io.read_rulebase_csv(spark, str(exports / "rules.csv"))
    q = weekly_screening_stream(spark, str(exports / "ssd"), rules, PRODUCT, LOG, out,
                                checkpoint=str(tmp_path_factory.mktemp("stream-ckpt")), kde=False)
    q.awaitTermination(600)
    weeks = {r.batch for r in io.read_result_set(spark, out, "bounds").select("batch").distinct().collect()}
    assert weeks == {"PM963_2021_w32", "PM963_2021_w33", "PM963_2021_w34"}


def test_text_and_report(spark, tmp_dir):
    lines = spark.createDataFrame([("a",), ("b",)], "value string")
    io.write_text(lines, tmp_dir + "/t")
    assert sorted(r.value for r in io.read_text(spark, tmp_dir + "/t").collect()) == ["a", "b"]
    from fleetpulse.functions.rules import RAW_RULE_SCHEMA
    raw = spark.createDataFrame([("x", "VALUE,1", "EMPTY", "EMPTY", "EMPTY", "-", "0", None),
                                 ("x", "VALUE,1", "EMPTY", "EMPTY", "EMPTY", "-", "0", None),
                                 ("y", "EMPTY", "EMPTY", "EMPTY", "EMPTY", "-", "0", "5")], RAW_RULE_SCHEMA)
    rep = table_report(spark, raw)
    assert rep["count"].first().n == 3 and rep["like"].count() == 2
    assert rep["distinct"].first().n == 1          # rows with a NULL column are not counted
    assert io.empty_frame(spark, RAW_RULE_SCHEMA).count() == 0


def test_three_jobs_end_to_end(spark, exports, tmp_path_factory):
    from fleetpulse.plans import runs
    base = str(tmp_path_factory.mktemp("jobs"))
    tel, rules = str(exports / "ssd"), str(exports / "rules.csv")
    from fleetpulse.session import _SCRATCH
    before = len(_SCRATCH)
    runs.screening_job(spark, PRODUCT, LOG, tel, rules, base + "/results", n_weeks=2)
    # the trend items of a product span SMART and extended logs; this fixture
    # has the SMART ones only, so the extended columns read as NULL
    runs.trend_job(spark, PRODUCT, tel, rules, base + "/results", base + "/plots")
    runs.histogram_job(spark, PRODUCT, LOG, tel, rules, base + "/plots")
    for name in ("trend/recheck_counts", "trend/trend_points", "trend/heatmap", "trend/axis",
                 "special/listed", "special/series", "last_reading/histogram", "last_reading/bars"):
        assert os.path.isdir(os.path.join(base, "plots", name)), name
    assert len(_SCRATCH) == before                 # a run leaves no intermediate table
    counts = io.read_table(spark, base + "/plots/trend/recheck_counts").collect()
    assert counts and all(r.n_after <= r.n_before for r in counts)
    assert io.read_table(spark, base + "/plots/last_reading/histogram").count() == 50 * len(
        C.histogram_items(PRODUCT, LOG))


def write_csv(path, header, rows, encoding="utf-8"):
    with open(path, "w", newline="", encoding=encoding) as fh:
        w = csv.writer(fh)
        w.writerow(header)
        w.writerows(rows)


def test_headers_missing_texts_and_both_logs(spark, tmp_dir):
    write_csv(f"{tmp_dir}/P_w01_SMART.csv", ["DriveSerialNumber", "Temperature", "MediaErrors"],
              [["A", "30", "0"], ["B", "NaN", "1"], ["C", "NA", ""], ["D", "hot", "2"]])
    write_csv(f"{tmp_dir}/P_w02_SMART.csv", ["MediaErrors", "DriveSerialNumber", "Temperature"], [["0", "A", "31"]])
    write_csv(f"{tmp_dir}/P_w02_Ext_SMART.csv", ["Erase_Fail_Count", "DriveSerialNumber"], [["7", "A"]])
    got = {(r.batch, r.log, r.DriveSerialNumber): (r.Temperature, r.MediaErrors, r.Erase_Fail_Count)
           for r in io.read_telemetry_csv(spark, tmp_dir, items=["Temperature", "MediaErrors", "Erase_Fail_Count"]).collect()}
    assert got == {("P_w01", "SMART", "A"): (30.0, 0.0, None), ("P_w01", "SMART", "B"): (None, 1.0, None),
                   ("P_w01", "SMART", "C"): (None, None, None), ("P_w02", "SMART", "A"): (31.0, 0.0, None),
                   ("P_w02", "Ext_SMART", "A"): (None, None, 7.0)}
    # one reading of each log a day: neither hides the other
    from fleetpulse.catalog import TelemetrySpec
    from fleetpulse.operators import daily as D
    spec = TelemetrySpec(firmware=None, batch="batch", log="log")
    raw = io.read_telemetry_csv(spark, tmp_dir, items=["Temperature", "Erase_Fail_Count"]) \
        .withColumn("TIMESTAMP", F.lit("2024-01-08 00:00:00"))
    long = D.to_long(D.load_daily(raw, spec), spec, ["Temperature", "Erase_Fail_Count"])
    assert {(r.batch, r.item) for r in long.where("DriveSerialNumber = 'A'").collect()} == {
        ("P_w01", "Temperature"), ("P_w02", "Temperature"), ("P_w02", "Erase_Fail_Count")}


def test_runs_accumulate_and_newest_list_may_be_empty(spark, tmp_dir):
    def store(batch, drives, run=None):
        lists = spark.createDataFrame([(batch, "Temperature", d) for d in drives], "batch string, item string, drive string")
        io.write_screening({"critical": lists}, tmp_dir, batches=spark.createDataFrame([(batch,)], "batch string"), run=run)

    store("w01", ["A", "B"])
    store("w02", ["C"])
    store("w03", [])
    read = lambda **k: sorted((r.batch, r.drive) for r in io.read_result_set(spark, tmp_dir, "critical", **k).collect())
    assert read() == [("w01", "A"), ("w01", "B"), ("w02", "C")]
    assert io.newest_batch(spark, tmp_dir) == "w03" and read(latest_only=True) == []
    store("w01", ["Z"])                            # a repeated week replaces its earlier results
    assert read() == [("w01", "Z"), ("w02", "C")]
    store("w03", ["Q"], run="named")
    store("w03", ["R"], run="named")               # so does a run repeated under its name
    assert read(latest_only=True) == [("w03", "R")]


def test_no_local_fallback_on_a_cluster():
    from types import SimpleNamespace

    from fleetpulse.session import ensure_checkpoint_dir
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None)))
