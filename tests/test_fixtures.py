"""Hand fixtures with worked numbers (FIXTURES.md section 4) and hazards H1-H13."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.catalog import TelemetrySpec
from fleetpulse.functions import rules as R
from fleetpulse.operators import daily as D
from fleetpulse.operators import density as K
from fleetpulse.operators import history as H
from fleetpulse.operators import plotdata as P
from fleetpulse.operators import screen as S
from fleetpulse.operators.quantile import exact_quantiles

D1, D2 = dt.date(2021, 8, 23), dt.date(2021, 8, 24)
SCREEN_ROWS = {  # serial: (day 1, day 2)
    "A": (30, 31), "B": (40, 41), "C": (50, None), "D": (75, 60),
    "E": (60, 35), "F": (35, 36), "G": (45, 44), "H": (38, 39),
}
TEMP_RULE = [("temperature", "EMPTY", "VALUE,70", "EMPTY", "PPM,200000", "-", "0", "80")]


def screen_long(spark):
    rows = [(s, d, "Temperature", float(v)) for s, vs in SCREEN_ROWS.items()
            for d, v in zip((D1, D2), vs) if v is not None]
    return spark.createDataFrame(rows, "serial string, date date, item string, value double")


def test_daily_load_quarantine_before_keep_last(spark):
    rows = [("A", "2021-08-23 01:00:00", "FW1", 20.0, 1), ("A", "2021-08-23 09:00:00", "FW1", 30.0, 2),
            ("A", "2021-08-23 23:00:00", "ERRORMOD", 99.0, 3), ("B", "2021-08-23 05:00:00", None, 40.0, 4),
            ("C", "2021-08-24 05:00:00", "FW1", None, 5)]
    df = spark.createDataFrame(rows, "DriveSerialNumber string, TIMESTAMP string, FirmwareRevision string, "
                                     "Temperature double, _row long")
    spec = TelemetrySpec(tiebreak=("_row",), items=("Temperature",))
    daily = {(r.DriveSerialNumber, str(r.date)): r.Temperature for r in D.load_daily(df, spec).collect()}
    assert daily == {("A", "2021-08-23"): 30.0, ("B", "2021-08-23"): 40.0, ("C", "2021-08-24"): None}
    q = D.quarantine(df, spec).collect()
    assert [r.Temperature for r in q] == [99.0]
    # long format drops the NULL reading of C
    assert D.to_long(D.load_daily(df, spec), spec).count() == 2


def test_keep_last_tiebreak(spark):
    rows = [("A", "2021-08-23 09:00:00", 1.0, 1), ("A", "2021-08-23 09:00:00", 2.0, 2)]
    df = spark.createDataFrame(rows, "DriveSerialNumber string, TIMESTAMP string, Temperature double, _row long")
    spec = TelemetrySpec(firmware=None, tiebreak=("_row",), items=("Temperature",))
    assert D.load_daily(df, spec).first().Temperature == 2.0


def test_screening_worked_example(spark):
    rules = R.rules_from_rows(spark, TEMP_RULE)
    res = S.screen(screen_long(spark), rules, "serial")
    assert {r.serial for r in res["critical"].collect()} == {"D"}
    bounds = {r.date: (r.lower, r.upper) for r in res["bounds"].collect()}
    assert bounds[D1][0] is None and bounds[D1][1] == pytest.approx(49.0)
    assert bounds[D2][0] is None and bounds[D2][1] == pytest.approx(41.0)
    assert {r.serial for r in res["warning"].collect()} == {"C", "E", "G"}
    assert {r.serial for r in S.drives_of(res["normal"], "serial").collect()} == {"A", "B", "F", "H"}


def test_bound_depends_on_removing_critical_first(spark):
    # With D left in, day 1's 80th percentile would be 56.0 (sorted position 5.6).
    q = exact_quantiles(screen_long(spark).where(F.col("date") == D1), ["date"], "value", {"u": 0.8})
    assert q.first().quantile == pytest.approx(56.0)


def reference_density(values):
    """Independent numpy formula of the density step (never the original code)."""
    v = np.asarray(values, dtype=float)
    lo, hi = np.percentile(v, 0.01), np.percentile(v, 99.99)
    v = v[(v >= lo) & (v <= hi)]
    mu, sd = v.mean(), v.std()
    z = (v - mu) / sd if sd != 0 else v
    x = np.linspace(z.min(), z.max(), 100)
    if x[-1] - x[0] <= 1e-3:
        return np.full(100, x[-1] * sd + mu), np.full(100, np.nan)
    pdf = np.exp(-0.5 * (x[:, None] - z[None, :]) ** 2).sum(axis=1) / (len(z) * math.sqrt(2 * math.pi))
    seg = np.diff(x) * (pdf[1:] + pdf[:-1]) / 2
    cum = np.concatenate([np.cumsum(seg), [seg.sum()]])
    return x * sd + mu, cum / cum.max()


def test_density_worked_example(spark):
    rules = R.rules_from_rows(spark, TEMP_RULE)
    res = S.screen(screen_long(spark), rules, "serial")
    dens = K.daily_density(res["normal"], "serial").orderBy("date", "layer").collect()
    assert len(dens) == 200
    day1 = [r for r in dens if r.date == D1]
    assert day1[0].x == pytest.approx(35.0) and day1[99].x == pytest.approx(38.0)
    expect = {0: 0.009609, 1: 0.019262, 49: 0.505121, 50: 0.515364, 98: 1.0, 99: 1.0}
    for layer, c in expect.items():
        assert day1[layer].cdf == pytest.approx(c, abs=1e-6)
    x_ref, c_ref = reference_density([30, 40, 35, 38])
    assert np.allclose([r.x for r in day1], x_ref) and np.allclose([r.cdf for r in day1], c_ref)


def test_density_edge_days(spark):
    rows = ([("s%d" % i, D1, "T", 5.0) for i in range(6)]         # constant day
            + [("a", D2, "T", 1.0), ("b", D2, "T", 2.0)])           # two values: trimmed away
    df = spark.createDataFrame(rows, "serial string, date date, item string, value double")
    out = K.daily_density(df, "serial").collect()
    assert len(out) == 100 and {r.date for r in out} == {D1}
    assert all(r.cdf is None and r.x == pytest.approx(5.0) for r in out)


def test_density_matches_numpy_on_random_days(spark):
    rng = np.random.default_rng(7)
    rows, ref = [], {}
    for d in range(3):
        vals = np.round(rng.gamma(2.0, 10.0, size=300), 2)
        day = D1 + dt.timedelta(days=d)
        ref[day] = reference_density(vals)
        rows += [("s%d" % i, day, "T", float(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "serial string, date date, item string, value double")
    got = K.daily_density(df, "serial").orderBy("date", "layer").collect()
    for day, (x_ref, c_ref) in ref.items():
        g = [r for r in got if r.date == day]
        assert np.allclose([r.x for r in g], x_ref, atol=1e-9)
        assert np.allclose([r.cdf for r in g], c_ref, atol=1e-9)


def test_histogram_bins(spark):
    vals = spark.createDataFrame([("v", float(x)) for x in (0, 1, 2, 10)], "item string, value double")
    rng = spark.createDataFrame([("v", 0.0, 10.0)], "item string, axis_min double, axis_max double")
    h = P.histogram(vals, rng, bins=5).orderBy("bin").collect()
    assert [r.n for r in h] == [2, 1, 0, 0, 1]
    assert np.histogram([0, 1, 2, 10], bins=5, range=(0, 10))[0].tolist() == [r.n for r in h]


def test_histogram_matches_numpy_edges(spark):
    rng_ = np.random.default_rng(3)
    x = np.round(rng_.normal(50, 20, 2000), 1)
    vals = spark.createDataFrame([("v", float(v)) for v in x], "item string, value double")
    rng = spark.createDataFrame([("v", 10.0, 90.0)], "item string, axis_min double, axis_max double")
    got = [r.n for r in P.histogram(vals, rng).orderBy("bin").collect()]
    assert got == np.histogram(x, bins=50, range=(10, 90))[0].tolist()


@pytest.mark.parametrize("p99,y_max,expect", [(95.0, "80", (0.0, 104.5)), (0.0, None, (0.0, 11.0))])
def test_histogram_range(spark, p99, y_max, expect):
    rules = R.rules_from_rows(spark, [("v", "EMPTY", "EMPTY", "EMPTY", "EMPTY", "-", "0", y_max)])
    vals = spark.createDataFrame([("v", p99)], "item string, value double")
    r = P.histogram_range(vals, rules).first()
    assert (r.axis_min, r.axis_max) == pytest.approx(expect)


@pytest.mark.parametrize("item,vmax,y_max,expect", [
    ("Temperature", 62.0, "80", (-8.0, 88.0)), ("Media_Units_Written", 62.0, "80", (-6.2, 68.2)),
    ("Media_Units_Written", 0.0, None, (-20.0, 220.0))])
def test_axis_bounds(spark, item, vmax, y_max, expect):
    rules = R.rules_from_rows(spark, [(item.lower(), "EMPTY", "EMPTY", "EMPTY", "EMPTY", "-", "0", y_max)])
    dens = spark.createDataFrame([(item, D1, 0, vmax - 1, 0.5), (item, D1, 1, vmax, 1.0)],
                                 "item string, date date, layer int, x double, cdf double")
    a = P.axis_bounds(dens, rules, ["item"]).first()
    assert (a.axis_min, a.axis_max) == pytest.approx(expect)


def test_tb_conversion(spark):
    v = spark.range(1).select(P.to_tb(F.lit(2147483.648), F.lit("TB")).alias("v")).first().v
    assert v == pytest.approx(1.0)


def test_mode_identity_and_tie(spark):
    df = spark.createDataFrame([("d1", "ab"), ("d1", "AB"), ("d1", "cd"), ("d2", "AB"), ("d2", "CD"),
                                ("d3", None)], "serial string, SSDUID string")
    got = {r.serial: (r.identity, r.n) for r in H.dominant_identity(df, "serial", F.col("SSDUID")).collect()}
    assert got == {"d1": ("AB", 2), "d2": ("AB", 1)}


def test_special_items(spark):
    df = spark.createDataFrame([("s1", 0.0, 100.0), ("s2", None, 98.0), ("s3", 4.0, 100.0)],
                               "serial string, CritWarning double, Capacitor_Health double")
    got = {(r.item, r.serial) for r in H.special_item_drives(df, "serial").collect()}
    assert got == {("CritWarning", "s3"), ("Capacitor_Health", "s2")}


def test_count_distinct_star_skips_null_rows(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (1, 2)], "a int, b int")
    assert df.select(F.count_distinct("a", "b")).first()[0] == 1


def test_rule_grammar(spark):
    rules = R.rules_from_rows(spark, [("x", "PPM,5", "VALUE,7", "EMPTY", "PPM,50"),
                                      ("y", "junk", "VALUE", "VALUE,1.5", None)]).orderBy("rule_item").collect()
    x, y = rules
    assert x.crit_low is None and x.crit_high == 7.0            # PPM in a critical field is ignored
    assert x.warn_low_kind == "EMPTY" and x.warn_high_kind == "PPM" and x.warn_high_num == 50.0
    assert y.crit_low is None and y.crit_high is None and y.warn_low_num == 1.5 and y.warn_high_kind == "EMPTY"
    req = {(r.rule_item, r.qid): r.fraction for r in R.quantile_requests(
        R.rules_from_rows(spark, [("x", "EMPTY", "EMPTY", "PPM,50", "PPM,50")])).collect()}
    assert req[("x", "lower")] == pytest.approx(0.00005) and req[("x", "upper")] == pytest.approx(0.99995)


def test_ppm_without_number_names_the_item(spark):
    with pytest.raises(ValueError, match="humidity"):
        R.rules_from_rows(spark, [("humidity", "EMPTY", "EMPTY", "PPM", "EMPTY")])
    raw = spark.createDataFrame([("humidity", "EMPTY", "EMPTY", "PPM,x", "EMPTY", "-", "0", None)], R.RAW_RULE_SCHEMA)
    with pytest.raises(Exception, match="humidity"):
        R.quantile_requests(R.parse_rules(raw)).collect()


def test_nan_reading_is_dropped(spark):
    wide = spark.createDataFrame([("A", D1, float("nan"), 1.0), ("B", D1, None, 2.0)], "serial string, date date, t double, u double")
    long = D.to_long(wide, TelemetrySpec(serial="serial", firmware=None), ["t", "u"])
    assert sorted((r.serial, r.item) for r in long.collect()) == [("A", "u"), ("B", "u")]


def test_missing_bound_is_null_not_nan(spark):
    # H1: a side without a limit must never flag (NaN would compare greater than everything).
    rules = R.rules_from_rows(spark, [("temperature", "EMPTY", "EMPTY", "EMPTY", "EMPTY")])
    res = S.screen(screen_long(spark), rules, "serial")
    assert res["critical"].count() == 0 and res["warning"].count() == 0
    assert all(r.lower is None and r.upper is None for r in res["bounds"].collect())


def test_unknown_item_raises(spark):
    rules = R.rules_from_rows(spark, TEMP_RULE)
    with pytest.raises(KeyError):
        R.validate_items(["Temperature", "NoSuchItem"], rules)


def test_pivot_unique_raises_on_duplicates(spark):
    long = screen_long(spark)
    wide = D.pivot_days(long, "serial", [str(D1), str(D2)], how="unique")
    assert wide.where(F.col("serial") == "D").first()[str(D1)] == 75.0
    with pytest.raises(ValueError):
        D.pivot_days(long.unionByName(long), "serial", [str(D1)], how="unique")


def test_item_catalogue_selections():
    from fleetpulse import catalog as C
    pm963 = C.screening_items("PM963", "SMART")
    assert len(pm963) == 18 and "AvailSpareThreshold" not in pm963 and pm963[-1] == "TempSensor2"
    assert C.screening_items("PM983", "SMART")[-1] == "TempSensor3"
    assert C.screening_items("PM953", "SMART")[-1] == "NumErrInfoLogEntries"
    assert C.screening_items("PM963", "Ext_SMART") == C.EXTENDED_ITEMS[:8]
    assert C.screening_items("PM953", "Ext_SMART") == ["Media_Units_Written", "Wear_Range_Delta",
                                                       "Unaligned_IO", "Mapped_LBAs"]
    with pytest.raises(ValueError):
        C.screening_items("PM1725b", "Ext_SMART")
    assert C.trend_items("PM963")[0] == "Temperature" and "Media_Units_Written" in C.trend_items("PM963")
    assert C.histogram_extra_item("SMART") == "CritWarning" and C.histogram_extra_item("Ext_SMART") == "Capacitor_Health"
    assert C.special_items("PM1725b") == ["CritWarning"]


@pytest.mark.parametrize("name", ["pivot_daily_avg", "pivot_unique"])
def test_pivot_queries_take_every_day(spark, tmp_dir, name):
    from fleetpulse.plans.registry import QUERIES
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    moved = events.withColumn("ts", (F.col("ts") + F.expr("INTERVAL 45 DAYS")).cast(events.schema["ts"].dataType))
    moved.write.parquet(f"{tmp_dir}/events.parquet")
    full = lambda rows: {(r["user_id"], d) for r in rows for d, v in r.asDict().items() if d != "user_id" and v is not None}
    before = full(QUERIES[name](spark, "/root/testdata/sf0.001").collect())
    after = full(QUERIES[name](spark, tmp_dir).collect())
    shift = lambda d: str(dt.date.fromisoformat(d) + dt.timedelta(days=45))
    assert before and after == {(u, shift(d)) for u, d in before}
