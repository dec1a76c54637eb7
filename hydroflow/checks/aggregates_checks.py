"""AGG-1 .. AGG-24 on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydroflow import config as C
from hydroflow.checks import views as V
from hydroflow.checks.registry import query
from hydroflow.functions.scalars import slot_radiation_to_MJ
from hydroflow.operators import aggregates as A
from hydroflow.operators import fill, joins, quality
from hydroflow.plans.gold import SERIES, STATION

READ = V.with_views(V.READINGS_SQL)
ENS = V.with_views(V.ENSEMBLE_SQL)
LEVELS = V.with_views(V.LEVELS_SQL)
AGG_SQL = {"mean": "avg", "max": "max", "min": "min", "sum": "sum"}
USED = {p: kinds for p, kinds in C.PARAM_AGGS.items() if p in V.PARAMS.values()}

DAILY_SQL = " UNION ALL ".join(
    f"SELECT site, station, CAST(ts AS DATE) AS date, '{p}_{k}' AS metric, {AGG_SQL[k]}(value) AS value "
    f"FROM readings WHERE param = '{p}' GROUP BY ALL" for p, kinds in USED.items() for k in kinds)
ENERGY_SQL = ("SELECT site, station, CAST(ts AS DATE) AS date, 'global_radiation_MJm2' AS metric, "
              "round_even(sum(value) * 600 / 1e6, 3) AS value FROM readings "
              "WHERE param = 'global_radiation_Wm2' GROUP BY ALL")


@query("agg_1_daily_parameters", READ + f"{DAILY_SQL} UNION ALL {ENERGY_SQL}", "value")
def agg_1(spark, d):
    return A.daily_parameters(V.readings(spark, d), STATION)


@query("agg_2_radiation_energy", READ + """
    SELECT site, station, CAST(ts AS DATE) AS date, round_even(sum(value) * 600 / 1e6, 3) AS energy
    FROM readings WHERE param = 'global_radiation_Wm2' GROUP BY ALL""", "energy")
def agg_2(spark, d):
    rad = V.readings(spark, d).where("param = 'global_radiation_Wm2'")
    return rad.groupBy(*STATION, F.to_date("ts").alias("date")).agg(
        slot_radiation_to_MJ(F.sum("value")).alias("energy"))


DETECTED = "CASE WHEN value >= 10 THEN value END"


@query("agg_3_last_reading", READ + f"""
    SELECT site, station, ts, param, arg_max(v, src_ord) FILTER (WHERE v IS NOT NULL) AS value
    FROM (SELECT *, {DETECTED} AS v FROM readings) GROUP BY ALL HAVING count(v) > 0""", "value")
def agg_3(spark, d):
    seen = V.readings(spark, d).withColumn("value", F.expr(DETECTED))
    return A.last_reading(seen, [*STATION, "ts", "param"], "value", "src_ord")


@query("agg_4_pivot_wide", READ + "SELECT site, station, ts, " + ", ".join(
    f"arg_max(value, src_ord) FILTER (WHERE param = '{p}') AS {p}" for p in V.PARAMS.values())
    + " FROM readings GROUP BY ALL", " ".join(V.PARAMS.values()))
def agg_4(spark, d):
    cells = A.last_reading(V.readings(spark, d), [*STATION, "ts", "param"], "value", "src_ord")
    return A.pivot_wide(cells, [*STATION, "ts"], "param", "value", list(V.PARAMS.values()))


@query("agg_5_mean_of_duplicates", """
    SELECT o_orderpriority AS station, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS flow_m3
    FROM orders GROUP BY ALL""", "flow_m3")
def agg_5(spark, d):
    rows = V.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("station"), F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("flow_m3"))
    return A.mean_of_duplicates(rows, ["station", "date"], "flow_m3")


@query("agg_6_keep_first", """
    SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey, o_totalprice AS level_m FROM orders
    QUALIFY row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) = 1""", "level_m")
def agg_6(spark, d):
    rows = V.table(spark, d, "orders").select(
        F.to_date("o_orderdate").alias("date"), "o_orderkey", F.col("o_totalprice").alias("level_m"))
    return A.first_reading(rows, ["date"], "o_orderkey")


@query("agg_7_forecast_steps_to_days", """
    WITH steps AS (SELECT event_type AS site, CAST(ts AS DATE) AS date, value, user_id FROM events),
    spans AS (SELECT site, min(date) AS a FROM steps GROUP BY 1),
    asked AS (SELECT site, CAST(unnest(generate_series(a, DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS date
              FROM spans),
    daily AS (SELECT site, date, max(value) AS temp_max_C, min(value) AS temp_min_C,
                     sum(value) AS rainfall_mm, avg(user_id) AS humidity_pct, avg(value) / 3.6 AS wind_speed_ms
              FROM steps GROUP BY ALL)
    SELECT a.site, a.date, temp_max_C, temp_min_C, rainfall_mm, humidity_pct, wind_speed_ms,
           CAST(NULL AS DOUBLE) AS radiation_MJm2
    FROM asked a LEFT JOIN daily d ON a.site = d.site AND a.date = d.date""",
       "temp_max_C temp_min_C rainfall_mm humidity_pct wind_speed_ms")
def agg_7(spark, d):
    steps = V.table(spark, d, "events").select(
        F.col("event_type").alias("site"), "ts", F.col("value").alias("max_temp"),
        F.col("value").alias("min_temp"), F.col("value").alias("rain"),
        F.col("user_id").alias("humidity"), F.col("value").alias("wind_kmh"))
    asked = fill.daily_spine(steps.withColumn("date", F.to_date("ts")), ["site"], end="2024-02-05")
    return A.six_hourly_to_daily(steps, ["site"], asked.drop("doy"))


@query("agg_8_daily_flow", READ + """
    SELECT site, station, CAST(ts AS DATE) AS date, avg(value) * 86400 AS flow_m3
    FROM readings GROUP BY ALL""", "flow_m3:4")
def agg_8(spark, d):
    return A.daily_flow(V.readings(spark, d), STATION, "ts", "value")


@query("agg_9_month_matrix", LEVELS + "SELECT site, year(date) AS year, " + ", ".join(
    f"avg(level_m) FILTER (WHERE month(date) = {m}) AS m{m:02d}" for m in range(1, 13))
    + " FROM levels GROUP BY ALL", " ".join(f"m{m:02d}" for m in range(1, 13)))
def agg_9(spark, d):
    return A.month_matrix(V.levels(spark, d), ["site"], "date", "level_m")


@query("agg_9_monthly_mean", LEVELS + """
    SELECT site, CAST(date_trunc('month', date) AS DATE) AS month, avg(level_m) AS level_m
    FROM levels GROUP BY ALL""", "level_m")
def agg_9b(spark, d):
    return A.monthly_mean(V.levels(spark, d), ["site"], "date", "level_m")


@query("agg_10_annual", ENS + """
    SELECT model, scenario, year(date) AS year, sum(tmax) AS total, avg(tmin) AS mean
    FROM ensemble GROUP BY ALL""", "total mean")
def agg_10(spark, d):
    return A.annual(V.ensemble(spark, d), ["model", "scenario"], "date",
                    total=F.sum("tmax"), mean=F.avg("tmin"))


def annual_levels(spark, d):
    return A.annual(V.ensemble(spark, d), ["model", "scenario"], "date", level_m=F.avg("tmax"))


ANNUAL_SQL = V.ENSEMBLE_SQL + """, annual AS (
    SELECT model, scenario, year(date) AS year, avg(tmax) AS level_m FROM ensemble GROUP BY ALL)"""


@query("agg_11_ribbon", V.with_views(ANNUAL_SQL) + """
    SELECT scenario, year, quantile_cont(level_m, 0.1) AS p10, quantile_cont(level_m, 0.5) AS p50,
           quantile_cont(level_m, 0.9) AS p90 FROM annual GROUP BY ALL""", "p10 p50 p90")
def agg_11(spark, d):
    return A.ribbon(annual_levels(spark, d), ["scenario", "year"], "level_m")


@query("agg_12_ensemble_median", ENS + """
    SELECT scenario, date, quantile_cont(tmax, 0.5) AS level_pred FROM ensemble GROUP BY ALL""", "level_pred")
def agg_12(spark, d):
    return A.ensemble_median(V.ensemble(spark, d), ["scenario", "date"], "tmax", "level_pred")


PERIODS = (("1995-1998", 1995, 1998), ("1998-2000", 1998, 2000), ("2000-2010", 2000, 2010))
PERIODS_SQL = "(VALUES " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in PERIODS) + ") p(period, y0, y1)"


@query("agg_13_box_by_period", V.with_views(ANNUAL_SQL) + f"""
    SELECT scenario, period, quantile_cont(level_m, 0.10) AS p10, quantile_cont(level_m, 0.25) AS p25,
           quantile_cont(level_m, 0.50) AS p50, quantile_cont(level_m, 0.75) AS p75,
           quantile_cont(level_m, 0.90) AS p90, avg(level_m) AS mean
    FROM annual JOIN {PERIODS_SQL} ON year BETWEEN y0 AND y1 GROUP BY ALL""", "p10 p25 p50 p75 p90 mean")
def agg_13(spark, d):
    tagged = joins.in_periods(annual_levels(spark, d), "year", PERIODS)
    shares = {f"p{s}": s / 100 for s in (10, 25, 50, 75, 90)}
    return tagged.groupBy("scenario", "period").agg(
        *A.quantile_columns("level_m", shares), F.avg("level_m").alias("mean"))


@query("agg_14_distinct_models", ENS + """
    SELECT site, scenario, count(DISTINCT model) AS n_models, min(tmax) AS low, max(tmax) AS high,
           avg(tmax) AS mean FROM ensemble GROUP BY ALL""", "low high mean")
def agg_14(spark, d):
    return V.ensemble(spark, d).groupBy("site", "scenario").agg(
        F.count_distinct("model").alias("n_models"), F.min("tmax").alias("low"),
        F.max("tmax").alias("high"), F.avg("tmax").alias("mean"))


STATUSES = ("F", "O", "P")
WIDE_SQL = V.with_views(V.GAPPY_SPINE_SQL) [:-1] + ", wide AS (SELECT site, date, " + ", ".join(
    f"max(value) FILTER (WHERE station = '{s}') AS {s}" for s in STATUSES) \
    + " FROM dense GROUP BY ALL)\n"


def wide_gappy(spark, d):
    dense = fill.on_spine(V.gappy(spark, d), ["site", "station"])
    return A.pivot_wide(dense, ["site", "date"], "station", "value", STATUSES, drop_empty_rows=False)


@query("agg_15_null_profile", WIDE_SQL + """
    UNPIVOT (SELECT year(date) AS year, """ + ", ".join(
    f"100.0 * avg(CAST({s} IS NULL AS INT)) AS {s}" for s in STATUSES)
    + " FROM wide GROUP BY ALL) ON F, O, P INTO NAME metric VALUE null_pct", "null_pct")
def agg_15(spark, d):
    wide = wide_gappy(spark, d).withColumn("year", F.year("date"))
    return A.null_profile(wide, STATUSES, ["year"])


@query("agg_16_fill_rates", WIDE_SQL + """
    UNPIVOT (SELECT site, """ + ", ".join(
    f"100.0 * avg(CAST({s} IS NOT NULL AS INT)) AS {s}" for s in STATUSES)
    + " FROM wide GROUP BY ALL) ON F, O, P INTO NAME metric VALUE fill_pct", "fill_pct")
def agg_16(spark, d):
    return A.fill_rates(wide_gappy(spark, d), STATUSES, ["site"])


@query("agg_17_date_coverage", V.with_views(V.GAPPY_SQL) + """
    SELECT site, station, min(date) AS first_date, max(date) AS last_date, count(value) AS n_values,
           CAST(max(date) - min(date) + 1 AS INT) AS span_days,
           CAST(max(date) - min(date) + 1 - count(value) AS BIGINT) AS missing_days,
           100.0 * (max(date) - min(date) + 1 - count(value)) / (max(date) - min(date) + 1) AS missing_pct
    FROM gappy GROUP BY ALL""", "missing_pct")
def agg_17(spark, d):
    return A.date_coverage(V.gappy(spark, d), ["site", "station"], "date", "value")


MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LONG_SQL = ("UNPIVOT (SELECT l_returnflag AS site, " + ", ".join(MEASURES) + " FROM lineitem) ON "
            + ", ".join(MEASURES) + " INTO NAME metric VALUE value")


def measures(spark, d):
    items = V.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "site")
    return A.to_long(items, ["site"], MEASURES)


@query("agg_18_column_profile", f"""
    SELECT site, metric, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
           quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS median,
           quantile_cont(value, 0.75) AS p75, max(value) AS max, skewness(value) AS skew,
           kurtosis(value) AS kurt FROM ({LONG_SQL}) GROUP BY ALL""",
       "mean std min p25 median p75 max skew kurt")
def agg_18(spark, d):
    return A.column_profile(measures(spark, d), ["site", "metric"])


@query("agg_19_correlation_matrix", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT l_returnflag AS site, '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM lineitem GROUP BY ALL"
    for a in MEASURES for b in MEASURES) + ")", "r")
def agg_19(spark, d):
    items = V.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "site")
    return A.correlation_matrix(items, MEASURES, ["site"])


@query("agg_20_pair_trend", """
    SELECT l_returnflag AS site, count(*) AS n, corr(l_extendedprice, l_quantity) AS r,
           regr_slope(l_extendedprice, l_quantity) AS slope,
           regr_intercept(l_extendedprice, l_quantity) AS intercept
    FROM lineitem GROUP BY ALL""", "r slope intercept")
def agg_20(spark, d):
    items = V.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "site")
    return A.pair_trend(items, ["site"], "l_quantity", "l_extendedprice")


@query("agg_21_histogram", """
    WITH v AS (SELECT o_orderpriority AS site, o_totalprice AS value FROM orders),
    s AS (SELECT site, min(value) AS lo, max(value) AS hi, count(*) AS n,
                 greatest((max(value) - min(value)) / 40.0, 1e-9) AS w FROM v GROUP BY ALL),
    b AS (SELECT v.site, CAST(least(floor((value - lo) / w), 39) AS INT) AS bin, lo, w, s.n AS total
          FROM v JOIN s ON v.site = s.site)
    SELECT site, bin, lo + bin * w AS bin_start, count(*) AS n, count(*) / (total * w) AS density
    FROM b GROUP BY site, bin, lo, w, total""", "bin_start density:12")
def agg_21(spark, d):
    values = V.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("site"), F.col("o_totalprice").alias("value"))
    return A.histogram(values, ["site"], "value")


@query("agg_22_density", """
    WITH v AS (SELECT o_orderpriority AS site, o_totalprice AS value FROM orders),
    s AS (SELECT site, count(*) AS n, min(value) AS lo, max(value) AS hi,
                 1.06 * stddev_pop(value) * pow(count(*), -0.2) AS h FROM v GROUP BY ALL),
    g AS (SELECT *, lo - 3 * h + CAST(unnest(range(300)) AS INT) * (hi - lo + 6 * h) / 299 AS x,
                 CAST(unnest(range(300)) AS INT) AS point FROM s)
    SELECT g.site, point, x, sum(exp(-0.5 * pow((x - value) / h, 2))) / (any_value(g.n) * any_value(h)
           * sqrt(2 * pi())) AS density
    FROM g JOIN v ON g.site = v.site GROUP BY g.site, point, x""", "x density:12")
def agg_22(spark, d):
    values = V.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("site"), F.col("o_totalprice").alias("value"))
    return A.density(values, ["site"], "value")


@query("agg_23_box", """
    SELECT l_returnflag AS site, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
           avg(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS sd,
           quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
           quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY ALL""",
       "min max mean sd q1 median q3")
def agg_23(spark, d):
    items = V.table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("site"), F.col("l_extendedprice").alias("value"))
    return A.box(items, ["site"], "value")


BOUNDED_SQL = V.SILVER_SQL + ", bounds AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', {float(lo)}, {float(hi)})" for m, (lo, hi) in C.PHYSICAL_BOUNDS.items()) + \
    ") b(metric, lo, hi)), marked AS (SELECT s.*, coalesce(value < lo OR value > hi, false) AS bad " \
    "FROM silver s LEFT JOIN bounds b ON s.metric = b.metric)"


@query("agg_24_log_summary", V.with_views(BOUNDED_SQL) + """
    SELECT 'physical_bounds' AS layer, count(*) FILTER (WHERE bad) AS n,
           100.0 * count(*) FILTER (WHERE bad) / count(*) AS percent FROM marked""", "percent")
def agg_24(spark, d):
    checked = quality.apply_layers(V.silver(spark, d), [quality.physical_bounds()])
    return quality.log_summary(checked)


@query("agg_24_most_changed", V.with_views(BOUNDED_SQL) + """
    SELECT site, station, metric, count(*) AS n FROM marked WHERE bad GROUP BY ALL
    ORDER BY n DESC, site, station, metric LIMIT 8""")
def agg_24b(spark, d):
    checked = quality.apply_layers(V.silver(spark, d), [quality.physical_bounds()])
    return quality.most_changed(checked, SERIES[:2])
