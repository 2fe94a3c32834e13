"""Registered queries on the driver tables and their DuckDB oracle SQL.

Each query is ``(spark, sf_dir) -> DataFrame`` and runs the library operators
over whole tables.  Doubles are rounded to 6 decimals on both sides; every
column is aliased so Spark and SQL agree on names.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.functions.rules import rules_from_rows
from fleetpulse.operators import daily as D
from fleetpulse.operators import screen as S
from fleetpulse.plans import tables as TB

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------- shared SQL
EV_DAILY = """
ev_daily AS (
  SELECT user_id, CAST(ts AS DATE) AS date, ts, event_id, event_type, value
  FROM events
  WHERE event_type IS DISTINCT FROM 'error'
  QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1
)"""
EV_SCREEN = EV_DAILY + """,
ev_crit AS (SELECT DISTINCT user_id FROM ev_daily WHERE value > 250),
ev_pop AS (SELECT * FROM ev_daily WHERE user_id NOT IN (SELECT user_id FROM ev_crit)),
ev_bounds AS (
  SELECT date, quantile_cont(value, 10000 / 1e6) AS lower, quantile_cont(value, 1 - 10000 / 1e6) AS upper
  FROM ev_pop GROUP BY date),
ev_warn AS (
  SELECT DISTINCT p.user_id FROM ev_pop p JOIN ev_bounds b USING (date)
  WHERE p.value < b.lower OR p.value > b.upper),
ev_normal AS (SELECT * FROM ev_pop WHERE user_id NOT IN (SELECT user_id FROM ev_warn))"""


# ---------------------------------------------------------------- events slice
def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = TB.read(spark, sf_dir, "events")
    return D.load_daily(ev, TB.EVENTS, columns=["value"])


def events_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily long table, written once: screening, density and history all read it."""
    from fleetpulse.session import materialize
    return materialize(D.to_long(events_daily(spark, sf_dir), TB.EVENTS), "daily-long")


def events_screen(spark: SparkSession, sf_dir: str) -> dict:
    return S.screen(events_long(spark, sf_dir), TB.events_rules(spark), "user_id")


@register("daily_last", "WITH " + EV_DAILY + """
SELECT user_id, date, ts, event_id, event_type, value FROM ev_daily""")
def q_daily_last(spark, sf_dir):
    ev = TB.read(spark, sf_dir, "events")
    d = D.load_daily(ev, TB.EVENTS)
    return d.select("user_id", "date", "ts", "event_id", "event_type", "value")


@register("quarantine", """
SELECT event_id, ts, user_id, event_type, value, CAST(ts AS DATE) AS date
FROM events WHERE event_type = 'error'""")
def q_quarantine(spark, sf_dir):
    ev = TB.read(spark, sf_dir, "events")
    return D.with_day(D.quarantine(ev, TB.EVENTS), TB.EVENTS).select(
        "event_id", "ts", "user_id", "event_type", "value", "date")


@register("keep_last_per_drive", """
SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice
FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey
                           ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1""")
def q_keep_last_per_drive(spark, sf_dir):
    li = TB.read(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return D.keep_last_per_drive(li, TB.LINEITEM)


@register("critical_drives", "WITH " + EV_DAILY + """
SELECT DISTINCT 'value' AS item, user_id FROM ev_daily WHERE value > 250""")
def q_critical_drives(spark, sf_dir):
    long = events_long(spark, sf_dir)
    return S.critical_drives(long, TB.events_rules(spark), "user_id")


@register("warning_bounds", "WITH " + EV_SCREEN + """
SELECT 'value' AS item, date, round(lower, 6) AS lower, round(upper, 6) AS upper FROM ev_bounds""")
def q_warning_bounds(spark, sf_dir):
    b = events_screen(spark, sf_dir)["bounds"]
    return b.select("item", "date", r6("lower").alias("lower"), r6("upper").alias("upper"))


@register("warning_drives", "WITH " + EV_SCREEN + """
SELECT 'value' AS item, user_id FROM ev_warn""")
def q_warning_drives(spark, sf_dir):
    return events_screen(spark, sf_dir)["warning"]


@register("normal_population", "WITH " + EV_SCREEN + """
SELECT DISTINCT 'value' AS item, user_id FROM ev_normal""")
def q_normal_population(spark, sf_dir):
    return S.drives_of(events_screen(spark, sf_dir)["normal"], "user_id")


@register("screen_summary", "WITH " + EV_SCREEN + """
SELECT 'value' AS item,
       (SELECT count(*) FROM ev_crit) AS n_critical,
       (SELECT count(*) FROM ev_warn) AS n_warning,
       (SELECT count(DISTINCT user_id) FROM ev_normal) AS n_normal,
       (SELECT count(*) FROM ev_normal) AS n_normal_readings""")
def q_screen_summary(spark, sf_dir):
    res = events_screen(spark, sf_dir)
    cnt = lambda df, name: df.groupBy("item").agg(F.count(F.lit(1)).alias(name))
    normal = res["normal"].groupBy("item").agg(F.count_distinct("user_id").alias("n_normal"),
                                              F.count(F.lit(1)).alias("n_normal_readings"))
    items = res["population"].select("item").distinct()
    out = (items.join(cnt(res["critical"], "n_critical"), "item", "left")
           .join(cnt(res["warning"], "n_warning"), "item", "left")
           .join(normal, "item", "left"))
    return out.select("item", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                                for c in ["n_critical", "n_warning", "n_normal", "n_normal_readings"]])


# ---------------------------------------------------------------- density
EV_DENSITY = EV_SCREEN + """,
ev_trim AS (
  SELECT date, quantile_cont(value, 0.0001) AS t_lo, quantile_cont(value, 0.9999) AS t_hi
  FROM ev_normal GROUP BY date),
ev_t AS (
  SELECT n.user_id, n.date, n.value FROM ev_normal n JOIN ev_trim t USING (date)
  WHERE n.value BETWEEN t.t_lo AND t.t_hi),
ev_st AS (
  SELECT date, count(*) AS n, avg(value) AS mu, stddev_pop(value) AS sd,
         min(value) AS vmin, max(value) AS vmax
  FROM ev_t GROUP BY date),
ev_st2 AS (
  SELECT *, CASE WHEN sd <> 0 THEN (vmin - mu) / sd ELSE vmin END AS z0,
            CASE WHEN sd <> 0 THEN (vmax - mu) / sd ELSE vmax END AS z1
  FROM ev_st),
ev_grid AS (
  SELECT date, i AS layer, n, mu, sd, (z1 - z0) <= 1e-3 AS flat,
         CASE WHEN (z1 - z0) <= 1e-3 OR i = 99 THEN z1 ELSE z0 + i * ((z1 - z0) / 99) END AS gx
  FROM ev_st2, range(0, 100) r(i)),
ev_cmp AS (SELECT date, value, count(*) AS c FROM ev_t GROUP BY date, value),
ev_pdf AS (
  SELECT g.date, g.layer, g.gx, g.n, g.mu, g.sd, g.flat,
         CASE WHEN g.flat THEN 1.0
              ELSE coalesce(sum(c.c * exp(-0.5 * power(g.gx - CASE WHEN g.sd <> 0 THEN (c.value - g.mu) / g.sd
                                                                    ELSE c.value END, 2))), 0)
                   / (g.n * sqrt(2 * pi())) END AS pdf
  FROM ev_grid g LEFT JOIN ev_cmp c ON c.date = g.date AND NOT g.flat
  GROUP BY g.date, g.layer, g.gx, g.n, g.mu, g.sd, g.flat),
ev_area AS (
  SELECT *, (lead(gx) OVER w - gx) * (lead(pdf) OVER w + pdf) / 2 AS area
  FROM ev_pdf WINDOW w AS (PARTITION BY date ORDER BY layer)),
ev_cum AS (
  SELECT *, sum(area) OVER (PARTITION BY date ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM ev_area),
ev_density AS (
  SELECT 'value' AS item, date, layer, gx * sd + mu AS x,
         CASE WHEN max(cum) OVER (PARTITION BY date) > 0 THEN cum / max(cum) OVER (PARTITION BY date) END AS cdf
  FROM ev_cum)"""


def events_density(spark, sf_dir, **sampling):
    res = events_screen(spark, sf_dir)
    from fleetpulse.operators.density import daily_density
    return daily_density(res["normal"], "user_id", **sampling)


@register("daily_density", "WITH " + EV_DENSITY + """
SELECT item, date, CAST(layer AS INTEGER) AS layer, round(x, 6) AS x, round(cdf, 6) AS cdf FROM ev_density""")
def q_daily_density(spark, sf_dir):
    d = events_density(spark, sf_dir)
    return d.select("item", "date", "layer", r6("x").alias("x"), r6("cdf").alias("cdf"))


@register("density_sampled", "WITH " + EV_DENSITY.replace(
    "ev_cmp AS (SELECT date, value, count(*) AS c FROM ev_t GROUP BY date, value)",
    "ev_cmp AS (SELECT date, value, count(*) AS c FROM ev_t "
    "WHERE ('0x' || substring(md5(user_id::VARCHAR || '|' || date::VARCHAR), 1, 8))::BIGINT % 10 = 0 "
    "GROUP BY date, value)") + """
SELECT item, date, CAST(layer AS INTEGER) AS layer, round(x, 6) AS x, round(cdf, 6) AS cdf FROM ev_density""")
def q_density_sampled(spark, sf_dir):
    d = events_density(spark, sf_dir, sample_modulus=10)
    return d.select("item", "date", "layer", r6("x").alias("x"), r6("cdf").alias("cdf"))


@register("density_drawn", "WITH " + EV_DENSITY.replace(
    "ev_cmp AS (SELECT date, value, count(*) AS c FROM ev_t GROUP BY date, value)", """
ev_rank AS (SELECT date, value, row_number() OVER (PARTITION BY date ORDER BY value) - 1 AS r FROM ev_t),
ev_draw AS (SELECT date, ('0x' || substring(md5('value|' || date::VARCHAR || '|' || d::VARCHAR), 1, 13))::BIGINT % n AS r
            FROM (SELECT date, n, unnest(range(n // 10)) AS d FROM ev_st)),
ev_cmp AS (SELECT date, value, count(*) AS c FROM ev_draw JOIN ev_rank USING (date, r) GROUP BY date, value)""") + """
SELECT item, date, CAST(layer AS INTEGER) AS layer, round(x, 6) AS x, round(cdf, 6) AS cdf FROM ev_density""")
def q_density_drawn(spark, sf_dir):
    """K8: a tenth of each day's readings, drawn with replacement by rank."""
    d = events_density(spark, sf_dir, draw_share=10)
    return d.select("item", "date", "layer", r6("x").alias("x"), r6("cdf").alias("cdf"))


# ---------------------------------------------------------------- history / re-check
from fleetpulse.operators import history as H  # noqa: E402
from fleetpulse.operators import plotdata as P  # noqa: E402

EV_RAW = """
ev_raw AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(ts AS DATE) AS date,
         upper(event_type) AS identity, CAST(date_trunc('week', ts) AS DATE) AS week
  FROM events)"""
EV_HIST = EV_SCREEN + "," + EV_RAW + """,
ev_drives AS (SELECT user_id FROM ev_crit UNION SELECT user_id FROM ev_warn),
ev_mode AS (
  SELECT user_id, identity FROM (
    SELECT user_id, identity, count(*) AS n FROM ev_raw
    WHERE user_id IN (SELECT user_id FROM ev_drives) AND identity IS NOT NULL
    GROUP BY user_id, identity)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, identity ASC) = 1),
ev_hist AS (SELECT r.* FROM ev_raw r JOIN ev_mode m ON r.user_id = m.user_id AND r.identity = m.identity),
ev_cutoff AS (
  SELECT min(date) AS cutoff FROM ev_raw
  WHERE week = (SELECT max(week) FROM ev_raw) AND user_id IN (SELECT user_id FROM ev_drives)),
ev_short AS (SELECT * FROM ev_hist WHERE date >= (SELECT cutoff FROM ev_cutoff)),
ev_cells_long AS (
  SELECT * FROM (
    SELECT user_id, date, value FROM ev_hist
    QUALIFY row_number() OVER (PARTITION BY user_id, date ORDER BY ts DESC, event_id DESC) = 1)
  WHERE value IS NOT NULL),
ev_cells AS (
  SELECT * FROM (
    SELECT user_id, date, value FROM ev_short
    QUALIFY row_number() OVER (PARTITION BY user_id, date ORDER BY ts DESC, event_id DESC) = 1)
  WHERE value IS NOT NULL),
ev_crit_new AS (SELECT DISTINCT user_id FROM ev_cells WHERE user_id IN (SELECT user_id FROM ev_crit) AND value > 250),
ev_warn_new AS (
  SELECT DISTINCT c.user_id FROM ev_cells c LEFT JOIN ev_bounds b USING (date)
  WHERE c.user_id IN (SELECT user_id FROM ev_warn) AND (c.value < b.lower OR c.value > b.upper))"""


def with_week(df):
    return df.withColumn("week", F.to_date(F.date_trunc("week", F.col("ts"))))


def last_week(raw):
    return raw.where(F.col("week") == raw.select(F.max("week")).scalar())


def events_history(spark, sf_dir) -> dict:
    res = events_screen(spark, sf_dir)
    raw = with_week(TB.read(spark, sf_dir, "events"))
    drives = H.union_lists([res["critical"], res["warning"]], "user_id")
    from fleetpulse.session import materialize
    hist, cutoff = H.abnormal_history(raw, drives, TB.EVENTS, last_week(raw))
    hist, cutoff = materialize(hist, "abnormal-history"), materialize(cutoff, "cutoff")
    return dict(res, raw=raw, drives=drives, hist=hist, cutoff=cutoff, short=H.short_window(hist, cutoff))


def events_rechecks(spark, sf_dir) -> dict:
    """The history with the daily cells of the listed drives and the re-checked lists."""
    from fleetpulse.session import materialize
    h = events_history(spark, sf_dir)
    cells_long = materialize(H.daily_cells(h["hist"], TB.EVENTS, ["value"]), "history-cells")
    cells = cells_long.where(F.col("date") >= h["cutoff"].select("cutoff").scalar())   # keep-last is per day
    rules = TB.events_rules(spark)
    crit_new = H.recheck_critical(cells, h["critical"], rules, "user_id")
    warn_new = H.recheck_warning(cells, h["warning"], h["bounds"], rules, "user_id")
    return dict(h, cells=cells, cells_long=cells_long, crit_new=crit_new, warn_new=warn_new, rules=rules)


@register("set_union_distinct", "WITH " + EV_HIST + """
SELECT user_id FROM ev_drives""")
def q_set_union_distinct(spark, sf_dir):
    return events_history(spark, sf_dir)["drives"]


@register("mode_identity", "WITH " + EV_RAW + """
SELECT user_id, identity, n FROM (
  SELECT user_id, identity, count(*) AS n FROM ev_raw WHERE identity IS NOT NULL GROUP BY user_id, identity)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, identity ASC) = 1""")
def q_mode_identity(spark, sf_dir):
    ev = TB.read(spark, sf_dir, "events")
    return H.dominant_identity(ev, "user_id", TB.EVENTS.identity_expr())


@register("abnormal_history", "WITH " + EV_HIST + """
SELECT event_id, user_id, ts, date, identity, value FROM ev_hist""")
def q_abnormal_history(spark, sf_dir):
    return events_history(spark, sf_dir)["hist"].select("event_id", "user_id", "ts", "date", "identity", "value")


@register("short_window", "WITH " + EV_HIST + """
SELECT event_id, user_id, ts, date, identity, value FROM ev_short""")
def q_short_window(spark, sf_dir):
    return events_history(spark, sf_dir)["short"].select("event_id", "user_id", "ts", "date", "identity", "value")


@register("recheck_critical", "WITH " + EV_HIST + """
SELECT 'value' AS item, user_id FROM ev_crit_new""")
def q_recheck_critical(spark, sf_dir):
    return events_rechecks(spark, sf_dir)["crit_new"]


@register("recheck_warning", "WITH " + EV_HIST + """
SELECT 'value' AS item, user_id FROM ev_warn_new""")
def q_recheck_warning(spark, sf_dir):
    return events_rechecks(spark, sf_dir)["warn_new"]


@register("recheck_counts", "WITH " + EV_HIST + """
SELECT 'value' AS item, 'critical' AS class, (SELECT count(*) FROM ev_crit) AS n_before,
       (SELECT count(*) FROM ev_crit_new) AS n_after
UNION ALL
SELECT 'value', 'warning', (SELECT count(*) FROM ev_warn), (SELECT count(*) FROM ev_warn_new)""")
def q_recheck_counts(spark, sf_dir):
    h = events_rechecks(spark, sf_dir)
    return H.recheck_counts({"critical": h["critical"], "warning": h["warning"]},
                            {"critical": h["crit_new"], "warning": h["warn_new"]}, "user_id")


@register("trend_points", "WITH " + EV_HIST + """,
pts AS (
  SELECT 'long' AS span, 'critical' AS class, * FROM ev_cells_long WHERE user_id IN (SELECT user_id FROM ev_crit_new)
  UNION ALL
  SELECT 'long', 'warning', * FROM ev_cells_long WHERE user_id IN (SELECT user_id FROM ev_warn_new)
  UNION ALL
  SELECT 'short', 'critical', * FROM ev_cells WHERE user_id IN (SELECT user_id FROM ev_crit_new)
  UNION ALL
  SELECT 'short', 'warning', * FROM ev_cells WHERE user_id IN (SELECT user_id FROM ev_warn_new))
SELECT span, class, 'value' AS item, user_id, date, value,
       count(*) OVER (PARTITION BY span, class, user_id) = 1 AS single_point, false AS in_zoom
FROM pts""")
def q_trend_points(spark, sf_dir):
    from fleetpulse.session import materialize
    h = events_rechecks(spark, sf_dir)
    lists = materialize(h["crit_new"].withColumn("class", F.lit("critical"))
                        .unionByName(h["warn_new"].withColumn("class", F.lit("warning"))), "rechecked")
    return P.trend_points(P.with_spans(h["cells_long"], h["cutoff"]), lists, h["rules"], "user_id")


# ---------------------------------------------------------------- heatmap / axis / baseline
@register("heatmap_cells", "WITH " + EV_DENSITY + """,
d AS (SELECT *, coalesce(cdf, 0) AS cdf0 FROM ev_density),
d2 AS (SELECT *, lead(cdf0) OVER w - cdf0 AS delta, lead(cdf) OVER w - cdf AS raw_delta, lead(x) OVER w AS x_hi
       FROM d WINDOW w AS (PARTITION BY item, date ORDER BY layer)),
nrm AS (SELECT item, max(raw_delta) AS norm FROM d2 WHERE date < (SELECT max(date) FROM d2) GROUP BY item),
days AS (SELECT item, date, lead(date) OVER (PARTITION BY item ORDER BY date) AS next_date
         FROM (SELECT DISTINCT item, date FROM d))
SELECT a.item, a.date, days.next_date, a.layer, round(a.delta, 6) AS delta,
       round((1 - a.delta / nrm.norm) * 0.8 + 0.2, 6) AS colour, round(a.delta / nrm.norm, 6) AS opacity,
       round(a.delta / nrm.norm * 0.9 + 0.1, 6) AS alpha, round(a.x, 6) AS x_lo, round(a.x_hi, 6) AS x_hi,
       round(b.x, 6) AS next_x_lo, round(b.x_hi, 6) AS next_x_hi
FROM d2 a JOIN days USING (item, date) JOIN d2 b ON b.item = a.item AND b.date = days.next_date AND b.layer = a.layer
JOIN nrm ON nrm.item = a.item
WHERE a.layer < 99 AND days.next_date IS NOT NULL AND nrm.norm IS NOT NULL""")
def q_heatmap_cells(spark, sf_dir):
    from fleetpulse.session import materialize
    d = materialize(events_density(spark, sf_dir), "density")
    c = P.heatmap_cells(d, ["item"])
    return c.select("item", "date", "next_date", "layer",
                    *[r6(n).alias(n) for n in ["delta", "colour", "opacity", "alpha", "x_lo", "x_hi",
                                                "next_x_lo", "next_x_hi"]])


@register("axis_bounds", "WITH " + EV_DENSITY + """,
m AS (SELECT item, max(x) AS vmax FROM ev_density GROUP BY item),
v AS (SELECT item, CASE WHEN vmax <= 0 THEN 200 ELSE vmax END AS vm FROM m)
SELECT item, round(0 - (vm - 0) * 0.1, 6) AS axis_min, round(vm + (vm - 0) * 0.1, 6) AS axis_max FROM v""")
def q_axis_bounds(spark, sf_dir):
    d = events_density(spark, sf_dir)
    a = P.axis_bounds(d, TB.events_rules(spark), ["item"])
    return a.select("item", r6("axis_min").alias("axis_min"), r6("axis_max").alias("axis_max"))


@register("baseline", "WITH " + EV_HIST + """,
quiet AS (
  SELECT 'value' AS item WHERE NOT EXISTS (SELECT 1 FROM ev_crit_new) AND NOT EXISTS (SELECT 1 FROM ev_warn_new)
    AND NOT EXISTS (SELECT 1 FROM ev_normal))
SELECT item, date, CAST(0.0 AS DOUBLE) AS baseline FROM quiet, (SELECT DISTINCT date FROM ev_hist)""")
def q_baseline(spark, sf_dir):
    h = events_rechecks(spark, sf_dir)
    items = h["raw"].select(F.lit("value").alias("item")).distinct()
    busy = (h["crit_new"].select("item").unionByName(h["warn_new"].select("item"))
            .unionByName(h["normal"].select("item")))
    quiet = items.join(busy, "item", "left_anti")
    return P.baseline(h["hist"].select("date"), items, quiet)


# ---------------------------------------------------------------- special items
EV_SPECIAL = EV_RAW + """,
sp_last AS (SELECT * FROM ev_raw WHERE week = (SELECT max(week) FROM ev_raw)),
sp_list AS (SELECT DISTINCT 'value_band' AS item, user_id FROM sp_last
            WHERE floor(value / 200) IS NOT NULL AND floor(value / 200) <> 0),
sp_mode AS (
  SELECT user_id, identity FROM (
    SELECT user_id, identity, count(*) AS n FROM ev_raw
    WHERE user_id IN (SELECT user_id FROM sp_list) AND identity IS NOT NULL GROUP BY user_id, identity)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, identity ASC) = 1),
sp_hist AS (SELECT r.* FROM ev_raw r JOIN sp_mode m ON r.user_id = m.user_id AND r.identity = m.identity),
sp_cut AS (SELECT min(date) AS cutoff FROM sp_last WHERE user_id IN (SELECT user_id FROM sp_list)),
sp_cells AS (
  SELECT * FROM (
    SELECT user_id, date, floor(value / 200) AS value FROM sp_hist WHERE date >= (SELECT cutoff FROM sp_cut)
    QUALIFY row_number() OVER (PARTITION BY user_id, date ORDER BY ts DESC, event_id DESC) = 1)
  WHERE value IS NOT NULL),
sp_new AS (SELECT DISTINCT user_id FROM sp_cells WHERE user_id IN (SELECT user_id FROM sp_list) AND value <> 0)"""


def events_special(spark, sf_dir) -> dict:
    raw = with_week(TB.read(spark, sf_dir, "events")).withColumn("value_band", F.floor(F.col("value") / 200)
                                                                 .cast("double"))
    items = {"value_band": 0.0}
    last = last_week(raw)
    listed = H.special_item_drives(last, "user_id", items)
    hist, cutoff = H.abnormal_history(raw, listed.select("user_id").distinct(), TB.EVENTS, last)
    short = H.short_window(hist, cutoff)
    cells = H.daily_cells(short, TB.EVENTS, ["value_band"])
    new = H.recheck_special(cells, listed, "user_id", items)
    return dict(listed=listed, hist=hist, short=short, cells=cells, new=new)


@register("special_item_drives", "WITH " + EV_SPECIAL + """
SELECT item, user_id FROM sp_list""")
def q_special_item_drives(spark, sf_dir):
    return events_special(spark, sf_dir)["listed"]


def events_special_plots(spark, sf_dir) -> dict:
    from fleetpulse.plans import trends as TR
    raw = with_week(TB.read(spark, sf_dir, "events")).withColumn("value_band", F.floor(F.col("value") / 200)
                                                                 .cast("double"))
    return TR.special_item_data(raw, replace(TB.EVENTS, batch="week"), {"value_band": 0.0})


@register("special_item_history", "WITH " + EV_SPECIAL + """,
sp_long AS (
  SELECT * FROM (
    SELECT user_id, date, floor(value / 200) AS value FROM sp_hist
    QUALIFY row_number() OVER (PARTITION BY user_id, date ORDER BY ts DESC, event_id DESC) = 1)
  WHERE value IS NOT NULL)
SELECT 'long' AS span, 'value_band' AS item, user_id, date, value, CAST(0 AS DOUBLE) AS "default" FROM sp_long
WHERE user_id IN (SELECT user_id FROM sp_new)
UNION ALL
SELECT 'short', 'value_band', user_id, date, value, CAST(0 AS DOUBLE) FROM sp_cells
WHERE user_id IN (SELECT user_id FROM sp_new)""")
def q_special_item_history(spark, sf_dir):
    """Both spans of the special item's series, with its default line."""
    return events_special_plots(spark, sf_dir)["series"].select("span", "item", "user_id", "date", "value", "default")


@register("special_abnormal_rows", "WITH " + EV_SPECIAL + """
SELECT 'value_band' AS item, user_id, event_id, date, identity FROM sp_hist
WHERE date >= (SELECT cutoff FROM sp_cut) AND user_id IN (SELECT user_id FROM sp_new)""")
def q_special_abnormal_rows(spark, sf_dir):
    """The raw rows of the re-checked special drives, written and read back."""
    from fleetpulse.session import scratch_path
    from fleetpulse.sources import io
    rows, path = events_special_plots(spark, sf_dir)["abnormal_rows"], scratch_path(spark, "abnormal-special")
    io.write_abnormal_rows(rows, path, sort_by=("user_id", "ts"))
    return io.read_table(spark, path, fmt="csv").select("item", "user_id", "event_id", "date", "identity")


# ---------------------------------------------------------------- histogram / bars (orders)
ORD_LAST = """
ord_last AS (
  SELECT * FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"""
ORDERS_RULES = [("o_totalprice", "EMPTY", "EMPTY", "EMPTY", "EMPTY", "-", "0", None)]


def orders_last(spark, sf_dir):
    o = TB.read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey",
                                                "o_totalprice", "o_orderpriority")
    return D.keep_last_per_drive(o, TB.ORDERS)


@register("histogram", "WITH " + ORD_LAST + """,
v AS (SELECT o_totalprice AS value FROM ord_last WHERE o_totalprice IS NOT NULL),
p AS (SELECT quantile_cont(value, 0.99) AS q FROM v),
m AS (SELECT CASE WHEN q <= 0 THEN 10 ELSE q END AS m FROM p),
rg AS (SELECT greatest(0.0, 0 - (m - 0) * 0.1) AS lo, m + (m - 0) * 0.1 AS hi FROM m),
rg2 AS (SELECT lo, hi, (hi - lo) / 50 AS step FROM rg),
b0 AS (SELECT v.value, rg2.*, least(CAST(floor((v.value - lo) * (50 / (hi - lo))) AS INTEGER), 49) AS i0
       FROM v, rg2 WHERE v.value >= lo AND v.value <= hi),
b1 AS (SELECT *, CASE WHEN value < (CASE WHEN i0 >= 50 THEN hi ELSE lo + i0 * step END) THEN i0 - 1 ELSE i0 END AS i1 FROM b0),
b2 AS (SELECT *, CASE WHEN value >= (CASE WHEN i1 + 1 >= 50 THEN hi ELSE lo + (i1 + 1) * step END) AND i1 <> 49
                      THEN i1 + 1 ELSE i1 END AS bin FROM b1),
cnt AS (SELECT bin, count(*) AS n FROM b2 GROUP BY bin)
SELECT 'o_totalprice' AS item, CAST(g.i AS INTEGER) AS bin,
       round(CASE WHEN g.i >= 50 THEN hi ELSE lo + g.i * step END, 6) AS bin_lo,
       round(CASE WHEN g.i + 1 >= 50 THEN hi ELSE lo + (g.i + 1) * step END, 6) AS bin_hi,
       coalesce(cnt.n, 0) AS n
FROM rg2, range(0, 50) g(i) LEFT JOIN cnt ON cnt.bin = g.i""")
def q_histogram(spark, sf_dir):
    last = orders_last(spark, sf_dir)
    from fleetpulse.session import materialize
    vals = materialize(D.to_long(last.withColumn("date", F.to_date("o_orderdate")), TB.ORDERS, ["o_totalprice"]), "last")
    rules = rules_from_rows(spark, ORDERS_RULES)
    rng = P.histogram_range(vals, rules)
    h = P.histogram(vals, rng)
    return h.select("item", "bin", r6("bin_lo").alias("bin_lo"), r6("bin_hi").alias("bin_hi"), "n")


@register("bars", "WITH " + ORD_LAST + """
SELECT 'o_orderpriority' AS item, o_orderpriority AS value, count(*) AS n
FROM ord_last WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""")
def q_bars(spark, sf_dir):
    last = orders_last(spark, sf_dir)
    vals = last.select(F.lit("o_orderpriority").alias("item"), F.col("o_orderpriority").alias("value"))
    return P.value_counts(vals)


@register("quantiles_range_path", "WITH " + EV_SCREEN + """
SELECT 'value' AS item, date, round(quantile_cont(value, 0.0001), 6) AS q_lo,
       round(quantile_cont(value, 0.5), 6) AS q_mid, round(quantile_cont(value, 0.9999), 6) AS q_hi,
       count(*) AS n
FROM ev_pop GROUP BY date""")
def q_quantiles_range_path(spark, sf_dir):
    """Exact quantiles of the screened population, values dealt over sorted slices."""
    from fleetpulse.operators.quantile import exact_quantiles
    pop = events_screen(spark, sf_dir)["population"]
    q = exact_quantiles(pop, ["item", "date"], "value", {"q_lo": 0.0001, "q_mid": 0.5, "q_hi": 0.9999})
    return (q.groupBy("item", "date", "n").pivot("qid", ["q_lo", "q_mid", "q_hi"]).agg(F.first("quantile"))
            .select("item", "date", *[r6(c).alias(c) for c in ["q_lo", "q_mid", "q_hi"]], "n"))


@register("quantiles_one_value", """
WITH v AS (SELECT l_linenumber, CASE WHEN l_orderkey % 500 = 0 THEN l_quantity ELSE 0 END AS value FROM lineitem)
SELECT l_linenumber, round(quantile_cont(value, 0.5), 6) AS q_mid, round(quantile_cont(value, 0.999), 6) AS q_hi,
       round(quantile_cont(value, 0.9999), 6) AS q_top, count(*) AS n FROM v GROUP BY l_linenumber""")
def q_quantiles_one_value(spark, sf_dir):
    """An error counter: nearly every reading is 0, in groups of very different sizes."""
    from fleetpulse.operators.quantile import exact_quantiles
    v = TB.read(spark, sf_dir, "lineitem").select(
        "l_linenumber", F.when(F.col("l_orderkey") % 500 == 0, F.col("l_quantity")).otherwise(0).cast("double").alias("value"))
    q = exact_quantiles(v, ["l_linenumber"], "value", {"q_mid": 0.5, "q_hi": 0.999, "q_top": 0.9999})
    return (q.groupBy("l_linenumber", "n").pivot("qid", ["q_mid", "q_hi", "q_top"]).agg(F.first("quantile"))
            .select("l_linenumber", *[r6(c).alias(c) for c in ["q_mid", "q_hi", "q_top"]], "n"))


# ---------------------------------------------------------------- multi-item screening (lineitem)
LI_SCREEN = """
li_daily AS (
  SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
         l_quantity, l_extendedprice, l_discount, l_tax
  FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_suppkey, date_trunc('month', l_shipdate)
                             ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1),
li_long AS (UNPIVOT li_daily ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME item VALUE value),
li_crit AS (
  SELECT DISTINCT item, l_suppkey FROM li_long
  WHERE (item = 'l_quantity' AND (value < 1 OR value > 50)) OR (item = 'l_extendedprice' AND value > 100000)
     OR (item = 'l_tax' AND value < 0)),
li_pop AS (
  SELECT * FROM li_long l
  WHERE NOT EXISTS (SELECT 1 FROM li_crit c WHERE c.item = l.item AND c.l_suppkey = l.l_suppkey)),
li_bounds AS (
  SELECT item, date,
         CASE item WHEN 'l_quantity' THEN quantile_cont(value, 20000 / 1e6) WHEN 'l_discount' THEN 0.01
                   WHEN 'l_tax' THEN quantile_cont(value, 100000 / 1e6) END AS lower,
         CASE item WHEN 'l_quantity' THEN quantile_cont(value, 1 - 20000 / 1e6)
                   WHEN 'l_extendedprice' THEN quantile_cont(value, 1 - 50000 / 1e6) WHEN 'l_discount' THEN 0.09 END AS upper
  FROM li_pop GROUP BY item, date),
li_warn AS (
  SELECT DISTINCT p.item, p.l_suppkey FROM li_pop p JOIN li_bounds b USING (item, date)
  WHERE p.value < b.lower OR p.value > b.upper),
li_class AS (
  SELECT d.item, d.l_suppkey,
         CASE WHEN c.l_suppkey IS NOT NULL THEN 'critical' WHEN w.l_suppkey IS NOT NULL THEN 'warning'
              ELSE 'normal' END AS class
  FROM (SELECT DISTINCT item, l_suppkey FROM li_long) d
  LEFT JOIN li_crit c USING (item, l_suppkey) LEFT JOIN li_warn w USING (item, l_suppkey))"""


def lineitem_screen(spark, sf_dir):
    from fleetpulse.session import materialize
    li = TB.read(spark, sf_dir, "lineitem")
    daily = D.load_daily(li, TB.LINEITEM, columns=list(TB.LINEITEM_ITEMS))
    long = materialize(D.to_long(daily, TB.LINEITEM), "daily-long")
    res = S.screen(long, TB.lineitem_rules(spark), "l_suppkey")
    return long, res


@register("screen_multi_item", "WITH " + LI_SCREEN + """
SELECT item, l_suppkey, class FROM li_class""")
def q_screen_multi_item(spark, sf_dir):
    long, res = lineitem_screen(spark, sf_dir)
    return S.classify(long, res, "l_suppkey")


@register("multi_item_bounds", "WITH " + LI_SCREEN + """
SELECT item, date, round(lower, 6) AS lower, round(upper, 6) AS upper FROM li_bounds""")
def q_multi_item_bounds(spark, sf_dir):
    _, res = lineitem_screen(spark, sf_dir)
    return res["bounds"].select("item", "date", r6("lower").alias("lower"), r6("upper").alias("upper"))


# ---------------------------------------------------------------- weekly screening (batch = week)
W_SCREEN = """
w_daily AS (
  SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, CAST(ts AS DATE) AS date, value
  FROM events WHERE event_type IS DISTINCT FROM 'error'
  QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1),
w_crit AS (SELECT DISTINCT week, user_id FROM w_daily WHERE value > 250),
w_pop AS (SELECT d.* FROM w_daily d
          WHERE NOT EXISTS (SELECT 1 FROM w_crit c WHERE c.week = d.week AND c.user_id = d.user_id)),
w_bounds AS (SELECT week, date, quantile_cont(value, 10000 / 1e6) AS lower,
                    quantile_cont(value, 1 - 10000 / 1e6) AS upper FROM w_pop GROUP BY week, date),
w_warn AS (SELECT DISTINCT p.week, p.user_id FROM w_pop p JOIN w_bounds b USING (week, date)
           WHERE p.value < b.lower OR p.value > b.upper),
w_class AS (
  SELECT d.week, d.user_id,
         CASE WHEN c.user_id IS NOT NULL THEN 'critical' WHEN w.user_id IS NOT NULL THEN 'warning'
              ELSE 'normal' END AS class
  FROM (SELECT DISTINCT week, user_id FROM w_daily) d
  LEFT JOIN w_crit c USING (week, user_id) LEFT JOIN w_warn w USING (week, user_id))"""

EVENTS_WEEKLY = replace(TB.EVENTS, batch="week")


def weekly_screen(spark, sf_dir):
    from fleetpulse.session import materialize
    raw = with_week(TB.read(spark, sf_dir, "events"))
    daily = D.load_daily(raw, EVENTS_WEEKLY, columns=["value"])
    long = materialize(D.to_long(daily, EVENTS_WEEKLY), "daily-long")
    res = S.screen(long, TB.events_rules(spark), "user_id", batch="week")
    return long, res


@register("screen_weekly", "WITH " + W_SCREEN + """
SELECT week, class, count(*) AS n FROM w_class GROUP BY week, class""")
def q_screen_weekly(spark, sf_dir):
    long, res = weekly_screen(spark, sf_dir)
    c = S.classify(long, res, "user_id", batch="week")
    return c.groupBy("week", "class").agg(F.count(F.lit(1)).alias("n"))


@register("last_n_weeks", "WITH " + EV_RAW + """
SELECT event_id, user_id, week, date, value FROM ev_raw
WHERE week IN (SELECT DISTINCT week FROM ev_raw ORDER BY week DESC LIMIT 2)""")
def q_last_n_weeks(spark, sf_dir):
    from fleetpulse.sources.io import last_batches
    raw = with_week(TB.read(spark, sf_dir, "events")).withColumn("date", F.to_date("ts"))
    return last_batches(raw, "week", 2).select("event_id", "user_id", "week", "date", "value")


@register("union_all_weeks", "WITH " + W_SCREEN + """
SELECT week, user_id, date, value FROM w_daily
WHERE week IN (SELECT DISTINCT week FROM w_daily ORDER BY week DESC LIMIT 2)""")
def q_union_all_weeks(spark, sf_dir):
    """Two weekly loads (each: quarantine split + keep-last) appended by name."""
    raw = with_week(TB.read(spark, sf_dir, "events"))
    weeks = raw.select("week").distinct().orderBy(F.col("week").desc()).limit(2)
    newest, older = weeks.select(F.max("week")).scalar(), weeks.select(F.min("week")).scalar()
    parts = [D.load_daily(raw.where(F.col("week") == w), EVENTS_WEEKLY, columns=["value"]) for w in (newest, older)]
    out = parts[0].unionByName(parts[1])
    return out.select("week", "user_id", "date", "value")


@register("difference", "WITH " + EV_SCREEN + """
SELECT user_id, date, value FROM ev_pop""")
def q_difference(spark, sf_dir):
    pop = events_screen(spark, sf_dir)["population"]
    return pop.select("user_id", "date", "value")


# ---------------------------------------------------------------- pivots, ad-hoc screening
# The days a matrix has at least; days of the table outside them get columns too.
PIVOT_DAYS = [(dt.date(2024, 1, 1) + dt.timedelta(days=k)).isoformat() for k in range(31)]


def _cells_sql(agg: str, source: str) -> str:
    cells = ", ".join(f"round({agg}(CASE WHEN date = DATE '{d}' THEN value END), 6) AS \"{d}\"" for d in PIVOT_DAYS)
    return f"SELECT user_id, {cells} FROM {source} GROUP BY user_id"


def matrix_days(long) -> list[str]:
    """``PIVOT_DAYS`` and every other day with readings, in order (one small aggregate)."""
    found = long.select(F.col("date").cast("string").alias("d")).where("d is not null").distinct()
    return sorted({*PIVOT_DAYS, *(r["d"] for r in found.collect())})   # a row per day


@register("pivot_daily_avg", _cells_sql("avg", "(SELECT user_id, CAST(ts AS DATE) AS date, value FROM events)"))
def q_pivot_daily_avg(spark, sf_dir):
    """Drive x day matrix, the readings of a cell averaged."""
    ev = D.with_day(TB.read(spark, sf_dir, "events"), TB.EVENTS).select("user_id", "date", "value")
    days = matrix_days(ev)
    wide = D.pivot_days(ev, "user_id", days)
    return wide.select("user_id", *[r6(F.col(f"`{d}`")).alias(d) for d in days])


@register("pivot_unique", "WITH " + EV_DAILY + _cells_sql("max", "ev_daily"))
def q_pivot_unique(spark, sf_dir):
    """Drive x day matrix of the keep-last readings, one per cell (checked)."""
    long = events_long(spark, sf_dir)
    days = matrix_days(long)
    wide = D.pivot_days(long, "user_id", days, how="unique")
    return wide.select("user_id", *[r6(F.col(f"`{d}`")).alias(d) for d in days])


ADHOC = """
a_daily AS (SELECT user_id, CAST(ts AS DATE) AS date, avg(value) AS value FROM events GROUP BY user_id, CAST(ts AS DATE)),
a_crit AS (SELECT DISTINCT user_id FROM a_daily WHERE value > 250),
a_pop AS (SELECT * FROM a_daily WHERE user_id NOT IN (SELECT user_id FROM a_crit)),
a_bounds AS (SELECT date, quantile_cont(value, 10000 / 1e6) AS lower, quantile_cont(value, 1 - 10000 / 1e6) AS upper
             FROM a_pop GROUP BY date),
a_warn AS (SELECT DISTINCT p.user_id FROM a_pop p JOIN a_bounds b USING (date)
           WHERE p.value < b.lower OR p.value > b.upper),
a_normal AS (SELECT * FROM a_pop WHERE user_id NOT IN (SELECT user_id FROM a_warn)),
a_tr AS (SELECT quantile_cont(value, 0.0001) AS lo, quantile_cont(value, 0.9999) AS hi FROM a_normal),
a_t AS (SELECT value, lo, hi FROM a_normal, a_tr WHERE value BETWEEN lo AND hi)"""


@register("matrix_summary", "WITH " + ADHOC + """
SELECT 'value' AS item, round(lo, 6) AS lower_b, round(hi, 6) AS upper_b, round(avg(value), 6) AS mean,
       round(stddev_pop(value), 6) AS std, count(*) AS n
FROM a_t GROUP BY lo, hi""")
def q_matrix_summary(spark, sf_dir):
    """Ad-hoc run: daily averages of all readings (no quarantine, no keep-last),
    screened, then the pooled trim bounds, mean and population std of the
    normal drives."""
    from fleetpulse.operators.quantile import exact_quantiles
    ev = TB.read(spark, sf_dir, "events")
    daily = D.daily_average(ev, TB.EVENTS, ["value"])
    long = D.to_long(daily, TB.EVENTS)
    normal = S.screen(long, TB.events_rules(spark), "user_id")["normal"]
    q = exact_quantiles(normal, ["item"], "value", {"lo": 0.0001, "hi": 0.9999})
    qw = q.groupBy("item").agg(F.max(F.when(F.col("qid") == "lo", F.col("quantile"))).alias("lo"),
                               F.max(F.when(F.col("qid") == "hi", F.col("quantile"))).alias("hi"))
    t = normal.join(qw, "item").where(F.col("value").between(F.col("lo"), F.col("hi")))
    return t.groupBy("item", "lo", "hi").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("n")) \
        .select("item", r6("lo").alias("lower_b"), r6("hi").alias("upper_b"), r6("mean").alias("mean"),
                r6("std").alias("std"), "n")


# ---------------------------------------------------------------- counts, SQL, round trips
@register("count_distinct_all", """
SELECT count(*) AS n FROM (SELECT DISTINCT * FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL
  AND user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL AND props IS NOT NULL)""")
def q_count_distinct_all(spark, sf_dir):
    """Distinct rows over all columns (rows with a NULL are not counted)."""
    from fleetpulse.operators.distinct import count_distinct_rows
    return count_distinct_rows(TB.read(spark, sf_dir, "events"))


@register("count_distinct_wide", """
SELECT (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS n_rows,
       (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey, l_quantity, l_shipdate FROM lineitem)) AS n_short""")
def q_count_distinct_wide(spark, sf_dir):
    """D9 on a wide table: all columns, and some that repeat."""
    from fleetpulse.operators.distinct import count_distinct_rows
    li = TB.read(spark, sf_dir, "lineitem")
    return count_distinct_rows(li, out="n_rows").join(
        count_distinct_rows(li, ["l_partkey", "l_suppkey", "l_quantity", "l_shipdate"], out="n_short"))


# ---------------------------------------------------------------- matrices in blocks
@register("matrix_blocks", """
WITH idx AS (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) - 1 AS i FROM (SELECT DISTINCT l_orderkey FROM lineitem)),
c AS (SELECT l_suppkey, i // 128 AS block, i % 128 AS p, avg(l_quantity) AS v FROM lineitem JOIN idx USING (l_orderkey) GROUP BY ALL)
SELECT l_suppkey, block::BIGINT AS block, count(*) AS n_cells, min(p)::INTEGER AS first_cell, round(sum(v), 6) AS total,
       round(sum(p * v), 6) AS weighted FROM c GROUP BY l_suppkey, block""")
def q_matrix_blocks(spark, sf_dir):
    """D1 beyond the columns a plan can have: supplier x order, in blocks of 128 cells."""
    from fleetpulse.operators.matrix import matrix_blocks
    li = TB.read(spark, sf_dir, "lineitem")
    cells = matrix_blocks(li, "l_suppkey", "l_orderkey", "l_quantity").select("l_suppkey", "block", F.posexplode("cells").alias("p", "v")) \
        .where(F.col("v").isNotNull())
    return cells.groupBy("l_suppkey", "block").agg(
        F.count(F.lit(1)).alias("n_cells"), F.min("p").alias("first_cell"), r6(F.sum("v")).alias("total"),
        r6(F.sum(F.col("p") * F.col("v"))).alias("weighted"))


@register("matrix_unique", "WITH " + EV_DAILY + """
SELECT user_id, date, round(value, 6) AS value FROM ev_daily WHERE value IS NOT NULL""")
def q_matrix_unique(spark, sf_dir):
    """D2 in blocks: drive x day of the keep-last readings, one per cell (checked), and back to cells."""
    from fleetpulse.operators.matrix import column_index, matrix_blocks, matrix_cells
    long = events_long(spark, sf_dir)
    index = column_index(long, "date")
    blocks = matrix_blocks(long, "user_id", "date", how="unique", width=8, index=index)
    return matrix_cells(blocks, "user_id", "date", index, width=8).select("user_id", "date", r6("value").alias("value"))


# ---------------------------------------------------------------- history by data skipping
@register("history_skipping", "WITH " + EV_RAW + """,
listed AS (SELECT DISTINCT user_id FROM ev_raw WHERE value > 250)
SELECT week, event_id, user_id, round(value, 6) AS value FROM ev_raw WHERE user_id IN (SELECT user_id FROM listed)""")
def q_history_skipping(spark, sf_dir):
    """Readings kept by week and drive; only the parts that may hold the listed drives are read."""
    from fleetpulse.session import scratch_path
    from fleetpulse.sources import history as HS
    raw, base = with_week(TB.read(spark, sf_dir, "events")).select("week", "event_id", "user_id", "ts", "value"), \
        scratch_path(spark, "history")
    HS.write_history(raw, base, "user_id", "ts", batch="week")
    listed = TB.read(spark, sf_dir, "events").where("value > 250")
    return HS.read_history(spark, base, listed, "user_id").select("week", "event_id", "user_id", r6("value").alias("value"))


@register("row_count", "SELECT count(*) AS n FROM lineitem")
def q_row_count(spark, sf_dir):
    return TB.read(spark, sf_dir, "lineitem").select(F.count(F.lit(1)).alias("n"))


@register("like_filter", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'PROMO%'")
def q_like_filter(spark, sf_dir):
    TB.read(spark, sf_dir, "part").createOrReplaceTempView("part_rules_view")
    return spark.sql("SELECT p_partkey, p_type FROM part_rules_view WHERE p_type LIKE 'PROMO%'")


@register("csv_round_trip", "WITH " + EV_DAILY + """
SELECT user_id, date, event_id, value FROM ev_daily""")
def q_csv_round_trip(spark, sf_dir):
    from pyspark.sql import types as T

    from fleetpulse.session import scratch_path
    path = scratch_path(spark, "csv-round-trip")
    events_daily_rows(spark, sf_dir).write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("date", T.DateType()),
                           T.StructField("event_id", T.LongType()), T.StructField("value", T.DoubleType())])
    return (spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").csv(path))


def events_daily_rows(spark, sf_dir):
    ev = TB.read(spark, sf_dir, "events")
    return D.load_daily(ev, TB.EVENTS).select("user_id", "date", "event_id", "value")


@register("text_round_trip", "WITH " + EV_DAILY + """
SELECT user_id, event_id FROM ev_daily""")
def q_text_round_trip(spark, sf_dir):
    from fleetpulse.session import scratch_path
    from fleetpulse.sources.io import read_text, write_text
    path = scratch_path(spark, "text-round-trip")
    rows = events_daily_rows(spark, sf_dir)
    write_text(rows.select(F.concat_ws(",", "user_id", "event_id").alias("value")), path)
    parts = F.split(F.col("value"), ",")
    return read_text(spark, path).select(F.element_at(parts, 1).cast("long").alias("user_id"),
                                         F.element_at(parts, 2).cast("long").alias("event_id"))


@register("result_readback", "WITH " + EV_SCREEN + """
SELECT 'value' AS item, date, round(lower, 6) AS lower, round(upper, 6) AS upper FROM ev_bounds
WHERE date_trunc('week', date) = (SELECT max(date_trunc('week', date)) FROM ev_bounds)""")
def q_result_readback(spark, sf_dir):
    from fleetpulse.session import scratch_path
    from fleetpulse.sources.io import read_result_set, write_screening
    base = scratch_path(spark, "results")
    bounds = events_screen(spark, sf_dir)["bounds"]
    write_screening({"bounds": bounds.withColumn("batch", F.to_date(F.date_trunc("week", "date")))}, base)
    back = read_result_set(spark, base, "bounds", latest_only=True)
    return back.select("item", "date", r6("lower").alias("lower"), r6("upper").alias("upper"))


@register("daily_last_all_firmware", """
SELECT user_id, CAST(ts AS DATE) AS date, ts, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1""")
def q_daily_last_all_firmware(spark, sf_dir):
    """K2: keep-last without the firmware quarantine (error rows compete too)."""
    ev = TB.read(spark, sf_dir, "events")
    d = D.load_daily(ev, TB.EVENTS, split_firmware=False)
    return d.select("user_id", "date", "ts", "event_id", "event_type", "value")


@register("density_stats", "WITH " + EV_DENSITY + """
SELECT 'value' AS item, date, n, round(mu, 6) AS mean, round(sd, 6) AS std, vmin, vmax FROM ev_st""")
def q_density_stats(spark, sf_dir):
    """Per-day trimmed population statistics behind the density grid."""
    from fleetpulse.operators.density import group_stats
    normal = events_screen(spark, sf_dir)["normal"]
    _, stats = group_stats(normal, ["item", "date"])
    return stats.select("item", "date", "n", r6("mu").alias("mean"), r6("sd").alias("std"), "vmin", "vmax")


# ---------------------------------------------------------------- multi-item re-check (lineitem)
LI_RECHECK = LI_SCREEN + """,
li_raw AS (SELECT *, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
                  CAST(date_trunc('year', l_shipdate) AS DATE) AS year FROM lineitem),
li_drv AS (SELECT l_suppkey FROM li_crit UNION SELECT l_suppkey FROM li_warn),
li_cut AS (SELECT min(date) AS cutoff FROM li_raw
           WHERE year = (SELECT max(year) FROM li_raw) AND l_suppkey IN (SELECT l_suppkey FROM li_drv)),
li_short AS (SELECT * FROM li_raw
             WHERE l_suppkey IN (SELECT l_suppkey FROM li_drv) AND date >= (SELECT cutoff FROM li_cut)),
li_cells0 AS (
  SELECT l_suppkey, date, l_quantity, l_extendedprice, l_discount, l_tax FROM li_short
  QUALIFY row_number() OVER (PARTITION BY l_suppkey, date
                             ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1),
li_cells AS (UNPIVOT li_cells0 ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME item VALUE value),
li_crit_new AS (
  SELECT DISTINCT c.item, c.l_suppkey FROM li_cells c JOIN li_crit USING (item, l_suppkey)
  WHERE (c.item = 'l_quantity' AND (c.value < 1 OR c.value > 50)) OR (c.item = 'l_extendedprice' AND c.value > 100000)
     OR (c.item = 'l_tax' AND c.value < 0)),
li_warn_new AS (
  SELECT DISTINCT c.item, c.l_suppkey FROM li_cells c JOIN li_warn USING (item, l_suppkey)
  LEFT JOIN li_bounds b USING (item, date)
  WHERE CASE c.item WHEN 'l_quantity' THEN c.value < b.lower OR c.value > b.upper
                    WHEN 'l_extendedprice' THEN c.value > b.upper
                    WHEN 'l_discount' THEN c.value < b.lower OR c.value > b.upper
                    WHEN 'l_tax' THEN c.value < b.lower END)"""


@register("multi_item_recheck", "WITH " + LI_RECHECK + """
SELECT item, 'critical' AS class, count(*) AS n_before,
       (SELECT count(*) FROM li_crit_new n WHERE n.item = c.item) AS n_after
FROM li_crit c GROUP BY item
UNION ALL
SELECT item, 'warning', count(*), (SELECT count(*) FROM li_warn_new n WHERE n.item = w.item)
FROM li_warn w GROUP BY item""")
def q_multi_item_recheck(spark, sf_dir):
    """K11-K13 on multi-item telemetry: suppliers listed by the monthly
    screening, their history, the short window of the last yearly batch, and
    the re-checked critical / warning lists per item."""
    long, res = lineitem_screen(spark, sf_dir)
    spec = replace(TB.LINEITEM, identity="'all'", batch="year")   # no secondary id in this table
    raw = TB.read(spark, sf_dir, "lineitem").withColumn("year", F.to_date(F.date_trunc("year", "l_shipdate")))
    drives = H.union_lists([res["critical"], res["warning"]], "l_suppkey")
    hist, cutoff = H.abnormal_history(raw, drives, spec, last_batch(raw, "year"))
    cells = H.daily_cells(H.short_window(hist, cutoff), replace(spec, batch=None), list(TB.LINEITEM_ITEMS))
    rules = TB.lineitem_rules(spark)
    crit_new = H.recheck_critical(cells, res["critical"], rules, "l_suppkey")
    warn_new = H.recheck_warning(cells, res["warning"], res["bounds"], rules, "l_suppkey")
    return H.recheck_counts({"critical": res["critical"], "warning": res["warning"]},
                            {"critical": crit_new, "warning": warn_new}, "l_suppkey")


def last_batch(raw, batch):
    return raw.where(F.col(batch) == raw.select(F.max(batch)).scalar())


# ---------------------------------------------------------------- weekly exports and the record of runs
def write_export(rows: DataFrame, folder: str, name: str, columns: list[str]) -> str:
    """One weekly export with its own column order (a folder of part files named like the export)."""
    path = f"{folder}/{name}.csv"
    rows.select(*columns).write.option("header", True).csv(path)
    return path


def export_rows(events: DataFrame) -> DataFrame:
    """Events under export column names, with cells that stand for missing values and some malformed ones."""
    cell = (F.when(F.col("event_id") % 17 == 0, F.lit("NaN")).when(F.col("event_id") % 19 == 0, F.lit("NA"))
            .when(F.col("event_id") % 23 == 0, F.lit("n/a")).when(F.col("event_id") % 29 == 0, F.lit("broken"))
            .otherwise(F.col("value").cast("string")))
    return events.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("TIMESTAMP"),
                         F.col("user_id").alias("DriveSerialNumber"), F.col("event_type").alias("FirmwareRevision"),
                         F.col("event_id").alias("MediaErrors"), cell.alias("Temperature"), F.lit("x").alias("NotUsed"))


@register("csv_mixed_headers", """
SELECT user_id::VARCHAR AS drive, event_id::DOUBLE AS media_errors, event_type AS firmware,
       CASE WHEN event_id % 17 = 0 OR event_id % 19 = 0 OR event_id % 23 = 0 THEN NULL ELSE value END AS temperature,
       CASE WHEN event_id % 2 = 0 THEN 'PM963_2024_w01' ELSE 'PM963_2024_w02' END AS batch,
       CASE WHEN event_id % 2 = 0 THEN 'SMART' ELSE 'Ext_SMART' END AS log
FROM events
WHERE NOT (event_id % 29 = 0 AND event_id % 17 <> 0 AND event_id % 19 <> 0 AND event_id % 23 <> 0)""")
def q_csv_mixed_headers(spark, sf_dir):
    """A1, A2: exports of two logs whose columns stand in different orders, with missing-value texts and
    malformed rows, through the library's reader."""
    from fleetpulse.session import scratch_path
    from fleetpulse.sources import io
    rows, folder = export_rows(TB.read(spark, sf_dir, "events")), scratch_path(spark, "exports")
    write_export(rows.where("MediaErrors % 2 = 0"), folder, "PM963_2024_w01_SMART",
                 ["Temperature", "MediaErrors", "TIMESTAMP", "DriveSerialNumber", "FirmwareRevision", "NotUsed"])
    write_export(rows.where("MediaErrors % 2 = 1"), folder, "PM963_2024_w02_Ext_SMART",
                 ["DriveSerialNumber", "MediaErrors", "NotUsed", "Temperature", "FirmwareRevision", "TIMESTAMP"])
    back = io.read_telemetry_csv(spark, folder, items=["Temperature", "MediaErrors"])
    return back.select(F.col("DriveSerialNumber").alias("drive"), F.col("MediaErrors").alias("media_errors"),
                       F.col("FirmwareRevision").alias("firmware"), F.col("Temperature").alias("temperature"), "batch", "log")


@register("last_n_weeks_files", "WITH " + EV_RAW + """,
two AS (SELECT DISTINCT week FROM ev_raw ORDER BY week DESC LIMIT 2)
SELECT event_id::DOUBLE AS event_id, 'PM963_' || strftime(week, '%Y%m%d') AS batch, 2 AS n_exports
FROM ev_raw WHERE week IN (SELECT week FROM two)""")
def q_last_n_weeks_files(spark, sf_dir):
    """The two latest weekly exports, chosen by name before anything is opened."""
    from fleetpulse.session import scratch_path
    from fleetpulse.sources import io
    raw, folder = with_week(TB.read(spark, sf_dir, "events")), scratch_path(spark, "exports")
    for week in [r["week"] for r in raw.select("week").distinct().orderBy("week").collect()]:      # one export a week
        write_export(export_rows(raw.where(F.col("week") == F.lit(week))), folder, f"PM963_{week:%Y%m%d}_SMART",
                     ["TIMESTAMP", "DriveSerialNumber", "FirmwareRevision", "MediaErrors"])
    back = io.read_telemetry_csv(spark, folder, items=["MediaErrors"], n_weeks=2, log_kind="SMART")
    opened = {io.export_name(f) for f in back.inputFiles()}
    return back.select(F.col("MediaErrors").alias("event_id"), "batch", F.lit(len(opened)).alias("n_exports"))


QUIET_RULES = [("value", "EMPTY", "VALUE,1000000000", "PPM,10000", "PPM,10000", "-", "0", None)]


@register("weekly_store", "WITH " + W_SCREEN + """
SELECT 'all weeks' AS part, week, user_id FROM w_crit WHERE week < (SELECT max(week) FROM w_daily)
UNION ALL SELECT 'newest week', max(week), NULL FROM w_daily
UNION ALL SELECT 'bounds', week, count(*) FROM w_bounds WHERE week < (SELECT max(week) FROM w_daily) GROUP BY week
UNION ALL SELECT 'bounds', (SELECT max(week) FROM w_daily), count(DISTINCT date) FROM w_daily
          WHERE week = (SELECT max(week) FROM w_daily)""")
def q_weekly_store(spark, sf_dir):
    """All weeks are screened into one folder, then the newest week once more, now without
    any critical drive.  Earlier weeks stay, the newest week's list is read back empty."""
    from fleetpulse.plans.screening import run_screening
    from fleetpulse.session import scratch_path
    from fleetpulse.sources import io
    raw, base = with_week(TB.read(spark, sf_dir, "events")).withColumnRenamed("week", "batch"), scratch_path(spark, "store")
    spec = replace(TB.EVENTS, batch="batch")
    run_screening(raw, spec, TB.events_rules(spark), ["value"], out=base, kde=False)
    run_screening(raw.where(F.col("batch") == raw.select(F.max("batch")).scalar()), spec,
                  rules_from_rows(spark, QUIET_RULES), ["value"], out=base, kde=False)
    everything = io.read_result_set(spark, base, "critical").select(
        F.lit("all weeks").alias("part"), F.col("batch").alias("week"), "user_id")
    latest = io.read_result_set(spark, base, "critical", latest_only=True).select(
        F.lit("latest list").alias("part"), F.col("batch").alias("week"), "user_id")
    newest = spark.range(1).select(F.lit("newest week").alias("part"), F.lit(io.newest_batch(spark, base)).alias("week"),
                                   F.lit(None).cast("long").alias("user_id"))
    bounds = io.read_result_set(spark, base, "bounds").groupBy(F.col("batch").alias("week")).agg(
        F.count(F.lit(1)).alias("user_id")).select(F.lit("bounds").alias("part"), "week", "user_id")
    return everything.unionByName(latest).unionByName(newest).unionByName(bounds)


# ---------------------------------------------------------------- heatmap of shared days, axis branches
SHARED_DAY = dt.date(2024, 1, 15)


@register("heatmap_shared_days", "WITH " + EV_DENSITY + f""",
d0 AS (SELECT item, date, layer, CASE WHEN date < DATE '{SHARED_DAY}' THEN x + 1 ELSE x END AS x, cdf FROM ev_density)""" + """,
d AS (SELECT *, coalesce(cdf, 0) AS cdf0 FROM d0),
d2 AS (SELECT *, lead(cdf0) OVER w - cdf0 AS delta, lead(cdf) OVER w - cdf AS raw_delta, lead(x) OVER w AS x_hi
       FROM d WINDOW w AS (PARTITION BY item, date ORDER BY layer)),
nrm AS (SELECT item, max(raw_delta) AS norm FROM d2 WHERE date < (SELECT max(date) FROM d2) GROUP BY item),
days AS (SELECT item, date, lead(date) OVER (PARTITION BY item ORDER BY date) AS next_date
         FROM (SELECT DISTINCT item, date FROM d))
SELECT a.item, a.date, days.next_date, a.layer, round(a.delta, 6) AS delta, round(a.delta / nrm.norm, 6) AS opacity,
       round(a.x, 6) AS x_lo, round(b.x, 6) AS next_x_lo
FROM d2 a JOIN days USING (item, date) JOIN d2 b ON b.item = a.item AND b.date = days.next_date AND b.layer = a.layer
JOIN nrm ON nrm.item = a.item
WHERE a.layer < 99 AND days.next_date IS NOT NULL AND nrm.norm IS NOT NULL""")
def q_heatmap_shared_days(spark, sf_dir):
    """Two batches that share a day; the newer batch's density of that day counts, once."""
    from fleetpulse.session import materialize
    d = materialize(events_density(spark, sf_dir), "density")
    day = F.lit(SHARED_DAY)
    both = d.where(F.col("date") <= day).withColumn("x", F.col("x") + 1).withColumn("batch", F.lit("w03")).unionByName(
        d.where(F.col("date") >= day).withColumn("batch", F.lit("w04")))
    c = P.heatmap_cells(materialize(P.newest_density(both, "batch").drop("batch"), "density-by-day"), ["item"])
    return c.select("item", "date", "next_date", "layer",
                    *[r6(n).alias(n) for n in ["delta", "opacity", "x_lo", "next_x_lo"]])


AXIS_RULES = [("temp_fixed", "EMPTY", "EMPTY", "EMPTY", "EMPTY", "-", "10", "500"),
              ("capped", "EMPTY", "EMPTY", "EMPTY", "EMPTY", "-", "0", "100"),
              ("below", "EMPTY", "EMPTY", "EMPTY", "EMPTY", "-", "100000", None),
              ("units", "EMPTY", "EMPTY", "EMPTY", "EMPTY", "TB", "0", None)]


@register("axis_branches", "WITH " + EV_DENSITY + """,
m AS (SELECT * FROM (SELECT max(x) AS v FROM ev_density) WHERE v IS NOT NULL)
SELECT 'Temp_fixed' AS item, round(10 - 490 * 0.1, 6) AS axis_min, round(500 + 490 * 0.1, 6) AS axis_max FROM m
UNION ALL SELECT 'Capped', round(0 - least(v, 100) * 0.1, 6), round(least(v, 100) * 1.1, 6) FROM m
UNION ALL SELECT 'Below', round(100000 - (200 - 100000) * 0.1, 6), round(200 + (200 - 100000) * 0.1, 6) FROM m
UNION ALL SELECT 'Units', round(0 - (v * 512000 / 1024 ** 4) * 0.1, 6), round((v * 512000 / 1024 ** 4) * 1.1, 6) FROM m""")
def q_axis_branches(spark, sf_dir):
    """All branches of the axis range on one density."""
    d = events_density(spark, sf_dir).drop("item")
    d = d.withColumn("item", F.explode(F.array(*[F.lit(n) for n in ("Temp_fixed", "Capped", "Below", "Units")])))
    a = P.axis_bounds(d, rules_from_rows(spark, AXIS_RULES), ["item"])
    return a.select("item", r6("axis_min").alias("axis_min"), r6("axis_max").alias("axis_max"))


# ---------------------------------------------------------------- trend plots of several items
PLOT_ITEMS = ["Temp_value", "Units", "Avail_quiet", "Plain_quiet"]
PLOT_RULES = [("temp_value", "EMPTY", "VALUE,150", "PPM,10000", "PPM,10000", "-", "0", "300"),
              ("units", "EMPTY", "VALUE,990", "EMPTY", "VALUE,980", "TB", "0", None),
              ("avail_quiet", "EMPTY", "EMPTY", "EMPTY", "EMPTY", "-", "0", None),
              ("plain_quiet", "EMPTY", "EMPTY", "EMPTY", "EMPTY", "-", "0", None)]
EV_PLOT = """
e_raw AS (
  SELECT user_id, ts, event_id, event_type, CAST(ts AS DATE) AS date, upper(event_type) AS identity,
         CAST(date_trunc('week', ts) AS DATE) AS week, value AS Temp_value, CAST(event_id % 997 AS DOUBLE) AS Units,
         CAST(100 AS DOUBLE) AS Avail_quiet, CAST(0 AS DOUBLE) AS Plain_quiet
  FROM events),
e_daily AS (SELECT user_id, date, Temp_value, Units, Avail_quiet, Plain_quiet FROM e_raw
            WHERE event_type IS DISTINCT FROM 'error'
            QUALIFY row_number() OVER (PARTITION BY user_id, date ORDER BY ts DESC, event_id DESC) = 1),
e_long AS (UNPIVOT e_daily ON Temp_value, Units, Avail_quiet, Plain_quiet INTO NAME item VALUE value),
e_crit AS (SELECT DISTINCT item, user_id FROM e_long
           WHERE (item = 'Temp_value' AND value > 150) OR (item = 'Units' AND value > 990)),
e_pop AS (SELECT l.* FROM e_long l ANTI JOIN e_crit c ON l.item = c.item AND l.user_id = c.user_id),
e_bounds AS (SELECT item, date, CASE item WHEN 'Temp_value' THEN quantile_cont(value, 10000 / 1e6) END AS lower,
                    CASE item WHEN 'Temp_value' THEN quantile_cont(value, 1 - 10000 / 1e6) WHEN 'Units' THEN 980 END AS upper
             FROM e_pop GROUP BY item, date),
e_warn AS (SELECT DISTINCT p.item, p.user_id FROM e_pop p JOIN e_bounds b USING (item, date)
           WHERE p.value < b.lower OR p.value > b.upper),
e_listed AS (SELECT user_id FROM e_crit UNION SELECT user_id FROM e_warn),
e_mode AS (SELECT user_id, identity FROM (
    SELECT user_id, identity, count(*) AS n FROM e_raw WHERE user_id IN (SELECT user_id FROM e_listed)
      AND identity IS NOT NULL GROUP BY user_id, identity)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, identity) = 1),
e_hist AS (SELECT r.* FROM e_raw r JOIN e_mode m ON r.user_id = m.user_id AND r.identity = m.identity),
e_cut AS (SELECT min(date) AS cutoff FROM e_raw WHERE week = (SELECT max(week) FROM e_raw)
          AND user_id IN (SELECT user_id FROM e_listed)),
e_last AS (SELECT user_id, date, Temp_value, Units, Avail_quiet, Plain_quiet FROM e_hist
           QUALIFY row_number() OVER (PARTITION BY user_id, date ORDER BY ts DESC, event_id DESC) = 1),
e_cells AS (UNPIVOT e_last ON Temp_value, Units, Avail_quiet, Plain_quiet INTO NAME item VALUE value),
e_span AS (SELECT 'long' AS span, * FROM e_cells
           UNION ALL SELECT 'short', * FROM e_cells WHERE date >= (SELECT cutoff FROM e_cut)),
e_crit_new AS (SELECT DISTINCT s.item, s.user_id FROM e_span s JOIN e_crit c ON c.item = s.item AND c.user_id = s.user_id
               WHERE span = 'short' AND ((s.item = 'Temp_value' AND value > 150) OR (s.item = 'Units' AND value > 990))),
e_warn_new AS (SELECT DISTINCT s.item, s.user_id FROM e_span s JOIN e_warn c ON c.item = s.item AND c.user_id = s.user_id
               LEFT JOIN e_bounds b ON b.item = s.item AND b.date = s.date
               WHERE span = 'short' AND CASE s.item WHEN 'Temp_value' THEN value < lower OR value > upper
                                                    WHEN 'Units' THEN value > upper END),
e_new AS (SELECT 'critical' AS class, * FROM e_crit_new UNION ALL SELECT 'warning', * FROM e_warn_new)"""


def events_plots(spark, sf_dir) -> dict:
    """The trend plots of four items: one screening, its density, and the history of the listed drives."""
    from fleetpulse.operators.density import daily_density
    from fleetpulse.plans import trends as TR
    from fleetpulse.session import materialize
    raw = with_week(TB.read(spark, sf_dir, "events")).withColumnRenamed("value", "Temp_value").withColumns({
        "Units": (F.col("event_id") % 997).cast("double"), "Avail_quiet": F.lit(100.0), "Plain_quiet": F.lit(0.0)})
    spec, rules = replace(TB.EVENTS, items=tuple(PLOT_ITEMS), batch=None), rules_from_rows(spark, PLOT_RULES)
    long = materialize(D.to_long(D.load_daily(raw, spec, columns=PLOT_ITEMS), spec), "daily-long")
    res = S.screen(long, rules, "user_id")
    res["density"] = materialize(daily_density(res["normal"], "user_id"), "density")
    newest = raw.agg(F.max("week")).first()[0]
    results = {n: res[n].withColumn("week", F.lit(newest)) for n in ("critical", "warning", "bounds", "density")}
    return TR.trend_data(raw, replace(spec, batch="week"), rules, results, PLOT_ITEMS, newest)


@register("trend_plots", "WITH " + EV_PLOT + """
SELECT span, class, s.item, s.user_id, date,
       round(CASE WHEN s.item = 'Units' THEN value * 512000 / 1024 ** 4 ELSE value END, 9) AS value,
       count(*) OVER (PARTITION BY span, class, s.item, s.user_id) = 1 AS single_point, s.item LIKE 'Temp%' AS in_zoom
FROM e_span s JOIN e_new n ON n.item = s.item AND n.user_id = s.user_id""")
def q_trend_plots(spark, sf_dir):
    """Both spans and classes, a TB item and a zoomed one."""
    return events_plots(spark, sf_dir)["trend_points"].withColumn("value", F.round("value", 9))


@register("trend_baseline", "WITH " + EV_PLOT + """
SELECT item, date, CAST(CASE WHEN item LIKE 'Avail%' THEN 100 ELSE 0 END AS DOUBLE) AS baseline
FROM (VALUES ('Avail_quiet'), ('Plain_quiet')) q(item), (SELECT DISTINCT date FROM e_hist)""")
def q_trend_baseline(spark, sf_dir):
    """Constant lines of the items that have neither listed drives nor a density."""
    return events_plots(spark, sf_dir)["baseline"]


@register("trend_abnormal_rows", "WITH " + EV_PLOT + """
SELECT n.class, n.item, h.user_id, h.event_id, h.date FROM e_hist h JOIN e_new n ON n.user_id = h.user_id
WHERE h.date >= (SELECT cutoff FROM e_cut)""")
def q_trend_abnormal_rows(spark, sf_dir):
    """Raw rows of the re-checked drives, exported by class and item and read back."""
    from fleetpulse.session import scratch_path
    from fleetpulse.sources import io
    path = scratch_path(spark, "abnormal")
    io.write_abnormal_rows(events_plots(spark, sf_dir)["abnormal_rows"], path, sort_by=("user_id", "ts"))
    return io.read_table(spark, path, fmt="csv").select("class", "item", "user_id", "event_id", "date")


@register("quarantine_store", """
SELECT CAST(date_trunc('week', ts) AS DATE) AS batch, event_id, user_id, event_type FROM events WHERE event_type = 'error'""")
def q_quarantine_store(spark, sf_dir):
    """A10: the quarantined rows of a run, written by batch and read back through the record of runs."""
    from fleetpulse.session import scratch_path
    from fleetpulse.sources import io
    raw, base = with_week(TB.read(spark, sf_dir, "events")).withColumnRenamed("week", "batch"), scratch_path(spark, "store")
    bad = D.quarantine(raw.select("batch", "event_id", "user_id", "event_type"), TB.EVENTS)
    io.write_screening({"quarantine": bad}, base, fmt="csv", batches=raw)
    return io.read_result_set(spark, base, "quarantine", fmt="csv").select("batch", "event_id", "user_id", "event_type")


@register("interleaved_runs", "WITH " + W_SCREEN + """,
newest AS (SELECT max(week) AS week FROM w_daily)
SELECT 'now' AS part, week, user_id FROM w_crit, (SELECT week AS top FROM newest) WHERE week < top
UNION ALL SELECT 'version 1', week, user_id FROM w_crit
UNION ALL SELECT 'weeks now', NULL, count(DISTINCT week) FROM w_daily""")
def q_interleaved_runs(spark, sf_dir):
    """A run of the newest week is written before a run of all weeks and committed after it: its (empty)
    list counts, the other weeks stay, and a reader of version 1 sees the first commit only."""
    from fleetpulse.plans.screening import run_screening
    from fleetpulse.session import scratch_path
    from fleetpulse.sources import io
    raw, base = with_week(TB.read(spark, sf_dir, "events")).withColumnRenamed("week", "batch"), scratch_path(spark, "store")
    spec = replace(TB.EVENTS, batch="batch")
    last = raw.where(F.col("batch") == raw.select(F.max("batch")).scalar())
    late = io.write_run(run_screening(last, spec, rules_from_rows(spark, QUIET_RULES), ["value"], kde=False), base,
                        batches=last.select("batch"))
    early = io.write_run(run_screening(raw, spec, TB.events_rules(spark), ["value"], kde=False), base, batches=raw.select("batch"))
    first = io.commit_run(spark, base, early)
    io.commit_run(spark, base, late)
    part = lambda name, df: df.select(F.lit(name).alias("part"), F.col("batch").alias("week"), "user_id")
    weeks = io.read_runs(spark, base).select(F.lit("weeks now").alias("part"), F.lit(None).cast("date").alias("week"), "batch") \
        .groupBy("part", "week").agg(F.count_distinct("batch").alias("user_id"))
    return part("now", io.read_result_set(spark, base, "critical")).unionByName(
        part("version 1", io.read_result_set(spark, base, "critical", version=first))).unionByName(weeks)


# ---------------------------------------------------------------- last readings, week by week
@register("last_readings_merged", """
SELECT user_id, ts, event_id, event_type, value, week FROM
  (SELECT *, CAST(date_trunc('week', ts) AS DATE) AS week FROM events)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def q_last_readings_merged(spark, sf_dir):
    """The weeks before the newest make the stored table; the newest week is merged into it, and then
    all weeks but the newest come again, which changes nothing."""
    from fleetpulse.session import scratch_path
    from fleetpulse.sources import lastread as LR
    raw, base = with_week(TB.read(spark, sf_dir, "events")), scratch_path(spark, "last-readings")
    raw = raw.select("user_id", "ts", "event_id", "event_type", "value", "week")
    top = raw.select(F.max("week")).scalar()
    keys, order = TB.EVENTS.reading_keys(), TB.EVENTS.order_cols()
    for part in (F.col("week") < top, F.col("week") == top, F.col("week") < top):
        LR.merge_last(raw.where(part), base, keys, order, buckets=8)
    return LR.read_last(spark, base, raw, buckets=8).drop(LR.KEY)


# ---------------------------------------------------------------- encoded exports, rulebase files, sorted exports
@register("csv_encoded", """
SELECT event_id::DOUBLE AS media_errors, 'Zürich é ' || (event_id % 7)::VARCHAR AS cluster, event_type AS firmware FROM events""")
def q_csv_encoded(spark, sf_dir):
    """A2: an export in ISO-8859-1 with letters beyond ASCII in its cells."""
    from fleetpulse.session import scratch_path
    from fleetpulse.sources import io
    path = f"{scratch_path(spark, 'exports')}/PM963_2024_w01_SMART.csv"
    rows = export_rows(TB.read(spark, sf_dir, "events")).withColumn("Cluster", F.concat(
        F.lit("Zürich é "), (F.col("MediaErrors") % 7).cast("string")))
    rows.select("MediaErrors", "Cluster", "FirmwareRevision", "TIMESTAMP").write.option("header", True) \
        .option("encoding", "ISO-8859-1").csv(path)
    back = io.read_telemetry_csv(spark, path, items=["MediaErrors"], encoding="ISO-8859-1")
    return back.select(F.col("MediaErrors").alias("media_errors"), F.col("Cluster").alias("cluster"),
                       F.col("FirmwareRevision").alias("firmware"))


@register("rulebase_file", "WITH " + EV_SCREEN + """
SELECT 'critical' AS part, user_id, NULL AS date, NULL AS lower, NULL AS upper FROM ev_crit
UNION ALL SELECT 'bounds', NULL, date, round(lower, 6), round(upper, 6) FROM ev_bounds""")
def q_rulebase_file(spark, sf_dir):
    """A4: the screening with its rules from a rulebase file, among rules of other items."""
    from fleetpulse.functions.rules import RAW_RULE_SCHEMA, literal_rows
    from fleetpulse.session import scratch_path
    from fleetpulse.sources import io
    path = scratch_path(spark, "rulebase")
    raw = [(r.rule_item,) for r in TB.events_rules(spark).select("rule_item").collect()]       # the rulebase: a few rows
    lines = [(item, "EMPTY", "VALUE,250", "PPM,10000", "PPM,10000", "-", "0", None) for (item,) in raw]
    lines += [("other", "VALUE,1", "VALUE,2", "EMPTY", "PPM,5", "TB", "0", "9")]
    literal_rows(spark, lines, RAW_RULE_SCHEMA).coalesce(1).write.option("header", True).csv(path)
    res = S.screen(events_long(spark, sf_dir), io.read_rulebase_csv(spark, path), "user_id")
    crit = res["critical"].select(F.lit("critical").alias("part"), "user_id", F.lit(None).cast("date").alias("date"),
                                  F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"))
    return crit.unionByName(res["bounds"].select(F.lit("bounds").alias("part"), F.lit(None).cast("long").alias("user_id"), "date",
                                                 r6("lower").alias("lower"), r6("upper").alias("upper")))


@register("sorted_export", """
SELECT event_type AS class, 'value' AS item, count(*) AS n, 0::BIGINT AS n_out_of_order FROM events WHERE value > 100 GROUP BY event_type""")
def q_sorted_export(spark, sf_dir):
    """exported rows stand by drive and time inside each file (looked at in file order)."""
    from pyspark.sql import Window

    from fleetpulse.session import scratch_path
    from fleetpulse.sources import io
    path = scratch_path(spark, "sorted")
    rows = TB.read(spark, sf_dir, "events").where("value > 100").select(
        "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "value",
        F.col("event_type").alias("class"), F.lit("value").alias("item"))
    io.write_abnormal_rows(rows, path, sort_by=("user_id", "ts"))
    back = io.read_table(spark, path, fmt="csv").select("class", "item", "user_id", "ts", F.col("_metadata.file_path").alias("file"),
                                                        F.monotonically_increasing_id().alias("at"))
    w = Window.partitionBy("file").orderBy("at")
    early = (F.lag("user_id").over(w) > F.col("user_id")) | ((F.lag("user_id").over(w) == F.col("user_id")) & (F.lag("ts").over(w) > F.col("ts")))
    return back.withColumn("early", F.coalesce(early, F.lit(False)).cast("long")).groupBy("class", "item").agg(
        F.count(F.lit(1)).alias("n"), F.sum("early").alias("n_out_of_order"))
