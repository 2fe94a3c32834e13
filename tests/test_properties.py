"""Property tests on random frames (hypothesis): exact quantiles
equal numpy, classes partition the drives, CDFs are monotone with max 1,
histogram counts add up, and results do not depend on the partitioning."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetpulse.functions import rules as R
from fleetpulse.operators import density as K
from fleetpulse.operators import plotdata as P
from fleetpulse.operators import screen as S
from fleetpulse.operators.quantile import exact_quantiles, order_key, value_spans

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
D0 = dt.date(2024, 1, 1)

groups_st = st.lists(
    st.lists(st.floats(min_value=-1e4, max_value=1e4, allow_nan=False, width=32), min_size=1, max_size=60),
    min_size=1, max_size=4)


@SETTINGS
@given(groups=groups_st, fracs=st.lists(st.floats(min_value=0, max_value=1), min_size=1, max_size=3))
def test_quantiles_equal_numpy(spark, groups, fracs):
    rows = [(g, float(v)) for g, vals in enumerate(groups) for v in vals]
    df = spark.createDataFrame(rows, "g int, v double")
    req = {f"q{i}": f for i, f in enumerate(fracs)}
    got = {(r.g, r.qid): r.quantile for r in exact_quantiles(df, ["g"], "v", req).collect()}
    for g, vals in enumerate(groups):
        for qid, f in req.items():
            assert got[(g, qid)] == pytest.approx(np.percentile(np.array(vals, dtype=float), f * 100),
                                                  rel=1e-9, abs=1e-9)


EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 2.0, 0.5, 1.7976931348623157e308,
         -1.7976931348623157e308, float("inf"), float("-inf"), 2.0 ** 53, 2.0 ** 53 - 1, 0.1, -0.1, 1 - 2 ** -53, 1 + 2 ** -52]


def test_order_key_is_the_bits_of_the_double(spark):
    import struct
    rng = np.random.default_rng(5)
    odd = rng.integers(0, 1 << 63, 3000, np.int64).view(np.float64)
    vals = [*EDGES, *(float(v) for v in odd if not np.isnan(v)), *(-float(v) for v in odd if not np.isnan(v)),
            *(2.0 ** e for e in range(-1074, 1024)), *(np.nextafter(2.0 ** e, 0) for e in range(-1000, 1024, 7))]
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    for v, key in df.select("v", order_key(F.col("v"))).collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
        assert key == (-bits if v < 0 else bits), v
    high = spark.createDataFrame([(float("nan"),)], "v double").select(order_key(F.col("v"))).first()[0]
    assert high > max(r[0] for r in df.select(order_key(F.col("v"))).collect())


def test_quantiles_of_odd_doubles(spark):
    finite = [v for v in EDGES if np.isfinite(v) and abs(v) < 1e300]
    df = spark.createDataFrame([(0, v) for v in finite] + [(0, None)], "g int, v double")
    q = exact_quantiles(df, ["g"], "v", {str(f): f / 20 for f in range(21)}).collect()
    assert len(q) == 21 and all(r.n == len(finite) for r in q)
    for r in q:
        assert r.quantile == pytest.approx(np.percentile(finite, float(r.qid) * 5), rel=1e-12, abs=1e-320)


def test_quantiles_exchange_counters_only(spark, monkeypatch):
    """One group holds most rows: its readings are counted where they are, and all that is exchanged are counters."""
    from fleetpulse.operators import quantile as Q
    rng = np.random.default_rng(11)
    hot, cold = rng.normal(0, 1, 20000), rng.normal(5, 1, 50)
    rows = [(0, float(v)) for v in hot] + [(1, float(v)) for v in cold]
    df = spark.createDataFrame(rows, "g int, v double").repartition(13)
    plans, write = [], Q.materialize
    monkeypatch.setattr(Q, "materialize", lambda d, name: plans.append((name, d._jdf.queryExecution().executedPlan().toString()))
                        or write(d, name))
    got = {r.g: r.quantile for r in exact_quantiles(df, ["g"], "v", {"p": 0.37}).collect()}
    assert got[0] == pytest.approx(np.percentile(hot, 37)) and got[1] == pytest.approx(np.percentile(cold, 37))
    counted = [p for name, p in plans if name == "quantile-counts"]
    assert 2 <= len(counted) <= 4
    for plan in counted:
        # every exchange by a key is fed by a partial aggregate or a limit on the ranks table
        assert "hashpartitioning(g" in plan and "partial_count" in plan and "Window" not in plan


def test_value_spans(spark):
    rng = np.random.default_rng(14)
    vals = np.where(rng.random(5000) < 0.7, 0, rng.integers(1, 400, 5000)).astype(float)
    df = spark.createDataFrame([(0, float(v)) for v in vals] + [(1, 3.0), (1, None)], "g int, v double")
    got = value_spans(df, ["g"], "v", n_slices=9).collect()
    zero = sorted((r["from"], r.to, r.value) for r in got if r.g == 0)
    assert [(a, b) for a, b, _ in zero] == [(int((vals < v).sum()), int((vals <= v).sum())) for v in sorted(set(vals))]
    assert [(r["from"], r.to, r.n) for r in got if r.g == 1] == [(0, 1, 1)]


def test_quantiles_of_mostly_one_value(spark):
    rng = np.random.default_rng(12)
    vals = np.where(rng.random(30_000) < 0.001, rng.integers(1, 9, 30_000), 0).astype(float)
    df = spark.createDataFrame([(0, float(v)) for v in vals], "g int, v double").repartition(7)
    got = {r.qid: r.quantile for r in exact_quantiles(df, ["g"], "v", {"a": 0.5, "b": 0.9995, "c": 0.99999}).collect()}
    assert [got[k] for k in "abc"] == pytest.approx([np.percentile(vals, p) for p in (50, 99.95, 99.999)])


def test_kernel_sums_from_moments(spark):
    """Gauss-transform moments against the direct kernel sum, to 1e-9 of a kernel, on wide, narrow and clustered days."""
    rng = np.random.default_rng(21)
    days = [rng.normal(0, 1, 400), np.exp(rng.normal(0, 2, 400)), np.where(rng.random(400) < 0.9, 0, 1000.0 + np.arange(400)),
            rng.uniform(0, 1, 30), np.full(5, 7.0)]
    rows = [(f"s{i}", D0 + dt.timedelta(days=d), "T", float(v)) for d, vals in enumerate(days) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "serial string, date date, item string, value double")
    keys = ["item", "date"]
    trimmed, stats = K.group_stats(df, keys)
    cells = K.cell_moments(trimmed, stats, keys)
    grid = stats.where("NOT flat").select(*keys, F.explode(F.sequence(F.lit(-30), F.lit(60))).alias("i"))
    sums = cells.join(grid, keys).withColumn("k", K.kernel_sum(F.col("moments"), F.col("i") / 3.0, F.col("centre"))) \
        .groupBy("date", "i").agg(F.sum("k").alias("k"))
    got = {(r.date, r.i): r.k for r in sums.collect()}
    st = {r.date: r for r in stats.collect()}
    for d, vals in enumerate(days[:4]):
        s = st[D0 + dt.timedelta(days=d)]
        kept = np.sort(vals)[(np.sort(vals) >= s.vmin) & (np.sort(vals) <= s.vmax)]
        z = (kept - s.mu) / s.sd
        for i in range(-30, 61):
            assert got[(s.date, i)] == pytest.approx(np.exp(-0.5 * (i / 3 - z) ** 2).sum(), abs=1e-9 * len(z))
    assert all(d != D0 + dt.timedelta(days=4) for d, _ in got)


def test_draws_with_replacement(spark, monkeypatch):
    """Numbered draws by rank: the same as over sorted values; small blocks, a value that fills most of a group, tiny groups."""
    import hashlib
    monkeypatch.setattr(K, "RANK_BLOCK", 16)
    monkeypatch.setattr(K, "DRAW_BLOCK", 7)
    rng = np.random.default_rng(22)
    days = [np.where(rng.random(3000) < 0.8, 0, rng.integers(1, 500, 3000)).astype(float), rng.normal(0, 1, 257), np.arange(9.0)]
    rows = [("T", D0 + dt.timedelta(days=d), float(v)) for d, vals in enumerate(days) for v in vals]
    df = spark.createDataFrame(rows, "item string, date date, value double").repartition(7)
    got = sorted(tuple(r) for r in K.drawn_readings(df, ["item", "date"], 10).collect())
    want = []
    for d, vals in enumerate(days):
        day = D0 + dt.timedelta(days=d)
        for k in range(len(vals) // 10):
            rank = int(hashlib.md5(f"T|{day}|{k}".encode()).hexdigest()[:13], 16) % len(vals)
            want.append(("T", day, float(np.sort(vals)[rank])))
    assert got == sorted(want) and len(set(want)) < len(want)


def random_long(spark, seed, n_drives=40, n_days=4):
    rng = np.random.default_rng(seed)
    rows = [(f"s{s}", D0 + dt.timedelta(days=d), "Temperature", float(np.round(rng.normal(40, 8), 1)))
            for s in range(n_drives) for d in range(n_days) if rng.random() > 0.1]
    return spark.createDataFrame(rows, "serial string, date date, item string, value double")


RULES = [("temperature", "VALUE,20", "VALUE,60", "PPM,50000", "PPM,50000", "-", "0", "80")]


@SETTINGS
@given(seed=st.integers(0, 10**6))
def test_classes_partition_the_drives(spark, seed):
    long = random_long(spark, seed)
    res = S.screen(long, R.rules_from_rows(spark, RULES), "serial")
    classes = S.classify(long, res, "serial").collect()
    drives = {r.serial for r in long.select("serial").distinct().collect()}
    assert {r.serial for r in classes} == drives and len(classes) == len(drives)
    crit = {r.serial for r in res["critical"].collect()}
    warn = {r.serial for r in res["warning"].collect()}
    normal = {r.serial for r in res["normal"].select("serial").distinct().collect()}
    assert not (crit & warn) and not (crit & normal) and not (warn & normal)


@SETTINGS
@given(seed=st.integers(0, 10**6))
def test_cdf_monotone_with_max_one(spark, seed):
    long = random_long(spark, seed, n_drives=30)
    d = K.daily_density(long, "serial").collect()
    by_day = {}
    for r in d:
        by_day.setdefault(r.date, []).append(r)
    for rows in by_day.values():
        rows.sort(key=lambda r: r.layer)
        assert len(rows) == 100
        cdf = [r.cdf for r in rows]
        if cdf[0] is None:
            continue
        assert all(b >= a - 1e-12 for a, b in zip(cdf, cdf[1:])) and cdf[-1] == pytest.approx(1.0)
        assert cdf[-2] == pytest.approx(cdf[-1]) and cdf[0] > 0
        xs = [r.x for r in rows]
        assert all(b >= a for a, b in zip(xs, xs[1:]))


@SETTINGS
@given(vals=st.lists(st.floats(min_value=-50, max_value=150, allow_nan=False), min_size=1, max_size=200),
       lo=st.floats(min_value=-20, max_value=20), width=st.floats(min_value=0.5, max_value=100))
def test_histogram_counts_add_up(spark, vals, lo, width):
    df = spark.createDataFrame([("v", float(x)) for x in vals], "item string, value double")
    rng = spark.createDataFrame([("v", lo, lo + width)], "item string, axis_min double, axis_max double")
    h = [r.n for r in P.histogram(df, rng).orderBy("bin").collect()]
    assert h == np.histogram(np.array(vals), bins=50, range=(lo, lo + width))[0].tolist()


def test_screening_independent_of_partitioning(spark):
    long = random_long(spark, 5, n_drives=60)
    rules = R.rules_from_rows(spark, RULES)

    def summary(df):
        res = S.screen(df, rules, "serial")
        return (sorted(tuple(r) for r in res["bounds"].select("date", F.round("lower", 9), F.round("upper", 9)).collect()),
                sorted(r.serial for r in res["warning"].collect()),
                sorted(r.serial for r in res["critical"].collect()))

    assert summary(long) == summary(long.repartition(7)) == summary(long.coalesce(1))
