"""RPT-1: the report tables on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydroflow.checks import views as V
from hydroflow.checks.evaluation_checks import ensemble_run
from hydroflow.checks.registry import query
from hydroflow.operators.fill import on_spine
from hydroflow.plans import gold as G
from hydroflow.plans import marts as R
from hydroflow.session import scratch_path

LAKE = V.with_views(V.WEATHER_SQL.replace("weather AS (", "weather0 AS ("),
                    "weather AS (SELECT *, level_m * 300 + 67000 AS volume_Mm3 FROM weather0)")


def lake(spark, d):
    return V.weather(spark, d).withColumn("volume_Mm3", F.col("level_m") * 300 + 67000)


@query("rpt_1_home_figures", LAKE + """
    , n AS (SELECT site, max(date) AS date, arg_max(level_m, date) AS l, arg_max(volume_Mm3, date) AS v FROM weather GROUP BY ALL),
    p AS (SELECT w.site, arg_max(level_m, w.date) AS l30, arg_max(volume_Mm3, w.date) AS v30 FROM weather w JOIN n ON w.site = n.site
          WHERE w.date <= n.date - 30 GROUP BY ALL)
    SELECT n.site, date, l AS level_m, v AS volume_Mm3, l - l30 AS level_change_30d_m, v - v30 AS volume_change_30d_Mm3,
           l + 213 AS above_lower_m, -208.9 - l AS below_upper_m, abs(l + 213) * 220 AS buffer_Mm3,
           CASE WHEN l - l30 > 0.01 THEN 'RISING' WHEN l - l30 < -0.01 THEN 'FALLING' ELSE 'STABLE' END AS trend
    FROM n JOIN p ON n.site = p.site""",
       "level_m volume_Mm3 level_change_30d_m volume_change_30d_Mm3 above_lower_m below_upper_m buffer_Mm3")
def home(spark, d):
    return R.home_figures(lake(spark, d))


@query("rpt_1_sparkline", LAKE + """
    , r AS (SELECT site, date, level_m, row_number() OVER (PARTITION BY site ORDER BY date DESC) AS k FROM weather),
    t AS (SELECT * FROM r WHERE k <= 30)
    SELECT site, date, level_m, level_m - lag(level_m) OVER (PARTITION BY site ORDER BY date) AS change_m FROM t""",
       "level_m change_m")
def spark_line(spark, d):
    return R.sparkline(lake(spark, d))


@query("rpt_1_null_heatmap", V.with_views(V.GAPPY_SPINE_SQL) + """
    SELECT site, CAST(year(date) AS INT) AS year, 'value' AS metric, 100.0 * avg(CAST(value IS NULL AS INT)) AS null_pct
    FROM dense GROUP BY ALL HAVING null_pct > 0""", "null_pct")
def heatmap(spark, d):
    return R.null_heatmap(on_spine(V.gappy(spark, d), ("site", "station")), ["value"])


@query("rpt_1_inflow_matrix", LAKE + "SELECT site, CAST(year(date) AS INT) AS year, " + ", ".join(
    f"avg(inflow_m3) FILTER (WHERE month(date) = {m}) AS m{m:02d}" for m in range(1, 13)) + " FROM weather GROUP BY ALL",
       " ".join(f"m{m:02d}" for m in range(1, 13)))
def inflow_matrix(spark, d):
    return R.seasonal_matrix(lake(spark, d), "inflow_m3")


ENSEMBLE = V.with_views(V.ENSEMBLE_SQL, "bal AS (SELECT date, model, scenario, tmax AS level_m FROM ensemble WHERE site = 'lake')")


def balance(spark, d):
    return V.ensemble(spark, d).where("site = 'lake'").withColumnRenamed("tmax", "level_m")


@query("rpt_1_scenario_ribbon", ENSEMBLE + """
    , y AS (SELECT model, scenario, CAST(year(date) AS INT) AS year, avg(level_m) AS v FROM bal GROUP BY ALL)
    SELECT scenario, year, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.9) AS p90
    FROM y GROUP BY ALL""", "p10 p50 p90")
def ribbon(spark, d):
    return R.scenario_ribbon(balance(spark, d))


@query("rpt_1_period_summary", ENSEMBLE + """
    , y AS (SELECT model, scenario, year(date) AS year, sum(level_m) AS v FROM bal GROUP BY ALL)
    SELECT scenario, period, round_even(quantile_cont(v, 0.1), 1) AS p10, round_even(quantile_cont(v, 0.5), 1) AS median,
           round_even(quantile_cont(v, 0.9), 1) AS p90
    FROM y JOIN (VALUES ('early', 1995, 1998), ('late', 1998, 2001)) p(period, a, b) ON year BETWEEN a AND b GROUP BY ALL""",
       "p10 median p90")
def period_summary(spark, d):
    return R.period_summary(balance(spark, d), "level_m", (("early", 1995, 1998), ("late", 1998, 2001)))


@query("rpt_1_observed_annual", V.with_views(V.ENSEMBLE_SQL, V.LEVELS_SQL) + """
    SELECT site, CAST(year(date) AS INT) AS year, avg(level_m) AS level_m FROM levels
    WHERE year(date) BETWEEN (SELECT min(year(date)) FROM ensemble) AND (SELECT max(year(date)) FROM ensemble)
    GROUP BY ALL""", "level_m")
def observed(spark, d):
    return R.observed_annual(V.levels(spark, d), V.ensemble(spark, d))


@query("rpt_1_gold_slice", LAKE + """
    SELECT site, date, level_m, volume_Mm3, rainfall_mm FROM weather WHERE date BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'""",
       "level_m volume_Mm3 rainfall_mm")
def gold_slice(spark, d):
    return G.gold_slice(lake(spark, d), "1997-03-01", "1998-02-28",
                        (("level_m", "volume_Mm3"), ("level_m", "rainfall_mm", "absent")))


@query("rpt_1_written_marts", LAKE + """
    SELECT 'decomposition' AS mart, count(*) AS n FROM weather UNION ALL
    SELECT 'home_figures', count(DISTINCT site) FROM weather UNION ALL
    SELECT 'sparkline', count(DISTINCT site) * 30 FROM weather""")
def marts(spark, d):
    places = R.write_marts(lake(spark, d), ensemble_run(spark, d), scratch_path(spark, "marts"))
    counted = [spark.read.parquet(p).agg(F.lit(m).alias("mart"), F.count(F.lit(1)).alias("n"))
               for m, p in sorted(places.items()) if m in ("decomposition", "home_figures", "sparkline")]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])
