"""REC-1 .. REC-6 on the driver tables (REC-7 is with the models)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydroflow import config as C
from hydroflow.checks import views as V
from hydroflow.checks.fits_checks import TEST_YEARS, daily_levels, rates_sql
from hydroflow.checks.registry import query
from hydroflow.functions import scalars as S
from hydroflow.operators import fits, joins, recurrences as R

SITE = ("site",)
ROWS_SQL = V.WEATHER_SQL + """, rows0 AS (SELECT site, date, rainfall_mm AS rain, radiation_MJm2 * 2 AS et,
        row_number() OVER (PARTITION BY site ORDER BY date) AS i FROM weather)"""


def series(spark, d):
    return V.weather(spark, d).select("site", "date", F.col("rainfall_mm").alias("rain"),
                                      (F.col("radiation_MJm2") * 2).alias("et"))


@query("rec_1_antecedent_index", V.with_views(ROWS_SQL) + """
    SELECT a.site, a.date, sum(b.rain * pow(0.9, a.i - b.i)) AS api
    FROM rows0 a JOIN rows0 b ON a.site = b.site AND b.i <= a.i GROUP BY ALL""", "api")
def rec_1(spark, d):
    return R.antecedent_index(series(spark, d), SITE, "date", "rain").select("site", "date", "api")


BUCKET_SQL = "WITH RECURSIVE " + ROWS_SQL + """, bucket AS (
    SELECT site, CAST(0 AS BIGINT) AS i, 75.0::DOUBLE AS s, 0.0::DOUBLE AS q FROM (SELECT DISTINCT site FROM rows0)
    UNION ALL
    SELECT b.site, b.i + 1, least(greatest(b.s + r.rain - r.et, 0), 150), greatest(b.s + r.rain - r.et - 150, 0)
    FROM bucket b JOIN rows0 r ON r.site = b.site AND r.i = b.i + 1)
"""


@query("rec_2_soil_bucket", BUCKET_SQL + """
    SELECT r.site, r.date, s AS bucket_S, q AS bucket_Q FROM rows0 r JOIN bucket b ON r.site = b.site AND r.i = b.i""",
       "bucket_S bucket_Q")
def rec_2(spark, d):
    return R.soil_bucket(series(spark, d), SITE, "date", "rain", "et").drop("rain", "et")


@query("rec_3_bucket_state", BUCKET_SQL + """
    SELECT r.site, r.date, s AS bucket_S,
           sum(q) OVER (PARTITION BY r.site ORDER BY r.date ROWS 29 PRECEDING) AS bucket_Q30
    FROM rows0 r JOIN bucket b ON r.site = b.site AND r.i = b.i""", "bucket_S bucket_Q30")
def rec_3(spark, d):
    return R.bucket_state(series(spark, d), SITE, "date", "rain", "et").select(
        "site", "date", "bucket_S", "bucket_Q30")


BALANCE_SQL = "WITH RECURSIVE " + V.ENSEMBLE_SQL + """, dv AS (
    SELECT model, scenario, date, tmin * 3 - tmax AS dv FROM ensemble WHERE site = 'lake' AND date >= DATE '1996-06-01'),
    seq AS (SELECT *, row_number() OVER (PARTITION BY model, scenario ORDER BY date) AS i FROM dv),
    vol AS (SELECT model, scenario, CAST(1 AS BIGINT) AS i, 40.0::DOUBLE AS v FROM seq WHERE i = 1
      UNION ALL SELECT a.model, a.scenario, a.i + 1, greatest(a.v + s.dv, 0)
      FROM vol a JOIN seq s ON a.model = s.model AND a.scenario = s.scenario AND s.i = a.i + 1)
"""


@query("rec_4_water_balance", BALANCE_SQL + f"""
    SELECT e.model, e.scenario, e.date, v.v AS volume_Mm3, {C.VOLUME_TO_LEVEL[0]!r} * v.v * v.v
           + {C.VOLUME_TO_LEVEL[1]!r} * v.v + {C.VOLUME_TO_LEVEL[2]!r} AS level_m
    FROM (SELECT * FROM ensemble WHERE site = 'lake') e
    LEFT JOIN seq s ON e.model = s.model AND e.scenario = s.scenario AND e.date = s.date
    LEFT JOIN vol v ON s.model = v.model AND s.scenario = v.scenario AND s.i = v.i""", "volume_Mm3 level_m")
def rec_4(spark, d):
    lake = V.ensemble(spark, d).where("site = 'lake'").withColumn("dv", F.col("tmin") * 3 - F.col("tmax"))
    out = R.water_balance(lake, ["model", "scenario"], "date", "dv", "1996-06-01", 40.0)
    return out.withColumn("level_m", S.level_from_volume("volume_Mm3")).select(
        "model", "scenario", "date", "volume_Mm3", "level_m")


ALL_RATES_SQL = rates_sql((0,)).replace("AND s.y <> g.test_year", "")
LINE = -213.0


@query("rec_5_crossings", V.with_views(ALL_RATES_SQL) + f"""
    , anchors AS (SELECT site, max(date) AS anchor_date, arg_max(level_m, date) AS anchor_level FROM levels GROUP BY ALL),
    path AS (SELECT a.site, a.anchor_date, scenario, anchor_date + CAST(k AS INT) AS date, anchor_level, scale,
                    sum(rate * scale) OVER (PARTITION BY a.site, scenario ORDER BY k) AS moved
             FROM anchors a, range(1, 401) t(k), (VALUES ('central', 0.8), ('fast', 1.0), ('slow', 0.8 * 0.82)) s(scenario, scale),
                  rates r WHERE r.site = a.site AND r.doy = dayofyear(anchor_date + CAST(k AS INT)))
    SELECT site, scenario, anchor_date, min(date) FILTER (WHERE anchor_level + moved <= {LINE}) AS crossing_date,
           CAST(min(date) FILTER (WHERE anchor_level + moved <= {LINE}) - anchor_date AS INT) AS days_to_line
    FROM path GROUP BY site, scenario, anchor_date""")
def rec_5(spark, d):
    daily = daily_levels(spark, d)
    rates = fits.recession_rates(daily, SITE, "date", "level_m", 1996)
    last = joins.latest_state(V.levels(spark, d), SITE, "date", ["level_m"]).select(
        "site", F.col("date").alias("anchor_date"), F.col("level_m").alias("anchor_level"))
    anchors = last.withColumn("s", F.explode(R.scenario_scales(F.lit(0.8)))).select(
        "site", "anchor_date", "anchor_level", "s.scenario", "s.scale")
    path = R.project_levels(anchors, rates, ["site", "scenario"], C.RECESSION_HORIZON_DAYS, SITE)
    return R.crossings(path, ["site", "scenario"], LINE)


@query("rec_5_path_until_crossing", V.with_views(ALL_RATES_SQL) + f"""
    , anchors AS (SELECT site, max(date) AS anchor_date, arg_max(level_m, date) AS anchor_level FROM levels GROUP BY ALL),
    path AS (SELECT a.site, anchor_date + CAST(k AS INT) AS date,
                    anchor_level + sum(rate) OVER (PARTITION BY a.site ORDER BY k) AS level
             FROM anchors a, range(1, 401) t(k), rates r
             WHERE r.site = a.site AND r.doy = dayofyear(anchor_date + CAST(k AS INT))),
    firsts AS (SELECT site, min(date) AS crossing FROM path WHERE level <= {LINE} GROUP BY site)
    SELECT p.site, p.date, level FROM path p LEFT JOIN firsts f ON p.site = f.site
    WHERE crossing IS NULL OR p.date - crossing <= 25""", "level")
def rec_5b(spark, d):
    daily = daily_levels(spark, d)
    rates = fits.recession_rates(daily, SITE, "date", "level_m", 1996)
    anchors = joins.latest_state(V.levels(spark, d), SITE, "date", ["level_m"]).select(
        "site", F.col("date").alias("anchor_date"), F.col("level_m").alias("anchor_level"),
        F.lit(1.0).alias("scale"))
    path = R.project_levels(anchors, rates, SITE, C.RECESSION_HORIZON_DAYS)
    return R.keep_until_crossing(path, SITE, LINE).select("site", "date", "level")


@query("rec_6_anomaly_scale", V.with_views(rates_sql(TEST_YEARS)) + """
    , a AS (SELECT site, test_year, make_date(test_year, 6, 1) AS anchor_date FROM grid),
    w AS (SELECT a.*, anchor_date - CAST(k AS INT) AS date, k FROM a, range(0, 22) t(k)),
    j AS (SELECT w.site, w.test_year, anchor_date, avg(rate) AS normal_rate, max(level_m) FILTER (WHERE k = 0) AS anchor_level,
                 (max(level_m) FILTER (WHERE k = 0) - max(level_m) FILTER (WHERE k = 21)) / 21 AS observed_rate
          FROM w LEFT JOIN daily d ON w.site = d.site AND w.date = d.date
          LEFT JOIN rates r ON w.site = r.site AND w.test_year = r.test_year AND r.doy = dayofyear(w.date) GROUP BY ALL)
    SELECT *, CASE WHEN normal_rate < -1e-4 THEN least(greatest(observed_rate / normal_rate, 0.45), 1.6) ELSE 1.0 END AS scale
    FROM j""", "normal_rate anchor_level observed_rate scale")
def rec_6(spark, d):
    daily = daily_levels(spark, d)
    rates = fits.recession_rates(daily, SITE, "date", "level_m", 1996, TEST_YEARS)
    years = daily.select("site").distinct().withColumn("test_year", F.explode(F.array(*map(F.lit, TEST_YEARS))))
    anchors = years.withColumn("anchor_date", F.make_date("test_year", F.lit(6), F.lit(1)))
    return R.observed_scale(daily, rates, anchors, ["site"], ["site", "test_year"], "level_m")


