"""JOIN-1 .. JOIN-11 on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydroflow import config as C
from hydroflow.checks import views as V
from hydroflow.checks.registry import query
from hydroflow.operators import fill, joins as J

SITE = ("site",)
LEVELS = V.with_views(V.LEVELS_SQL)
WEATHER = V.with_views(V.WEATHER_SQL)
SPINE = V.with_views(V.LEVELS_SQL, "spans AS (SELECT site, min(date) AS a, max(date) AS b FROM levels GROUP BY ALL)",
                     "spine AS (SELECT site, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM spans)")


@query("join_1_spine_lookup", SPINE + """
    SELECT s.site, s.date, CAST(dayofyear(s.date) AS INT) AS doy, level_m
    FROM spine s LEFT JOIN levels l ON s.site = l.site AND s.date = l.date""", "level_m")
def join_1(spark, d):
    levels = V.levels(spark, d)
    return J.lookup_join(fill.daily_spine(levels, SITE), levels, ["site", "date"])


@query("join_2_matched_pairs", V.with_views(V.ENSEMBLE_SQL, V.LEVELS_SQL) + """
    SELECT model AS site, e.date, avg(tmax) AS pred, any_value(level_m) AS obs
    FROM ensemble e JOIN levels l ON e.model = l.site AND e.date = l.date GROUP BY ALL""", "pred obs")
def join_2(spark, d):
    predicted = V.ensemble(spark, d).groupBy(F.col("model").alias("site"), "date").agg(F.avg("tmax").alias("pred"))
    observed = V.levels(spark, d).withColumnRenamed("level_m", "obs")
    return J.matched_pairs(predicted, observed, ["site", "date"])


@query("join_3_doy_lookup", WEATHER + """
    , clim AS (SELECT site, doy, avg(outflow_m3) AS outflow_clim FROM weather GROUP BY ALL)
    SELECT w.site, w.date, outflow_clim FROM weather w JOIN clim c ON w.site = c.site AND w.doy = c.doy""",
       "outflow_clim")
def join_3(spark, d):
    days = V.weather(spark, d)
    normals = days.groupBy("site", "doy").agg(F.avg("outflow_m3").alias("outflow_clim"))
    return J.lookup_join(days.select("site", "date", "doy"), normals, ["site", "doy"]).drop("doy")


@query("join_4_horizons", WEATHER + """
    SELECT a.site, a.date, CAST(h AS INT) AS horizon_h, t.date AS target_date, t.rainfall_mm AS rain_ahead,
           a.level_m FROM weather a, range(1, 8) r(h)
    LEFT JOIN weather t ON a.site = t.site AND t.date = a.date + CAST(h AS INT)""", "rain_ahead level_m")
def join_4(spark, d):
    return J.expand_horizons(V.weather(spark, d), SITE, "date", C.HORIZONS,
                             {"rainfall_mm": "rain_ahead"}, ("level_m",))


@query("join_4_horizons_within_year", WEATHER + """
    SELECT a.site, a.date, CAST(year(a.date) AS INT) AS fold, CAST(h AS INT) AS horizon_h, t.date AS target_date,
           t.inflow_m3 AS inflow_ahead FROM weather a, range(1, 8) r(h)
    LEFT JOIN weather t ON a.site = t.site AND t.date = a.date + CAST(h AS INT) AND year(t.date) = year(a.date)""",
       "inflow_ahead")
def join_4b(spark, d):
    days = V.weather(spark, d).withColumn("fold", F.year("date"))
    return J.expand_horizons(days, SITE, "date", C.HORIZONS, {"inflow_m3": "inflow_ahead"}, within="fold")


@query("join_5_as_of", V.with_views(V.LEVELS_SQL, V.GAPPY_SPINE_SQL.replace("spans AS", "gspans AS").replace(
    "FROM spans)", "FROM gspans)")) + """
    SELECT d.site, d.station, d.date, l.date AS state_date, l.level_m FROM dense d
    ASOF LEFT JOIN (SELECT * FROM levels WHERE level_m < -211) l ON d.site = l.site AND d.date >= l.date""", "level_m")
def join_5(spark, d):
    anchors = fill.daily_spine(V.gappy(spark, d), ("site", "station")).drop("doy")
    states = V.levels(spark, d).select(
        "site", F.col("date").alias("state_date"),
        F.when(F.col("level_m") < -211, F.col("level_m")).alias("level_m"))
    return J.as_of(anchors, states, ["site"], "date", "state_date", ["level_m"])


@query("join_5_month_ago", LEVELS + """
    , last AS (SELECT site, max(date) - 30 AS cut FROM levels GROUP BY ALL)
    SELECT l.site, max(l.date) AS date, arg_max(level_m, l.date) AS level_m
    FROM levels l JOIN last ON l.site = last.site WHERE l.date <= cut GROUP BY ALL""", "level_m")
def join_5b(spark, d):
    levels = V.levels(spark, d)
    cut = levels.groupBy("site").agg(F.date_sub(F.max("date"), 30).alias("cut"))
    return J.latest_state(levels.join(cut, "site"), SITE, "date", ["level_m"], F.col("cut"))


@query("join_6_periods", LEVELS + """
    SELECT site, period, count(*) AS n FROM levels JOIN (VALUES ('a', 1995, 1998), ('b', 1998, 2000), ('c', 2000, 2010))
    p(period, y0, y1) ON year(date) BETWEEN y0 AND y1 GROUP BY ALL""")
def join_6(spark, d):
    tagged = J.in_periods(V.levels(spark, d).withColumn("year", F.year("date")), "year",
                          (("a", 1995, 1998), ("b", 1998, 2000), ("c", 2000, 2010)))
    return tagged.groupBy("site", "period").agg(F.count(F.lit(1)).alias("n"))


TWO_SITES_SQL = "two AS (SELECT o_orderpriority AS model, CAST(o_orderdate AS DATE) AS date, o_orderstatus AS site, " \
                "avg(o_totalprice) / 1.013 AS tmax FROM orders GROUP BY ALL)"


def two_sites(spark, d):
    return V.gappy(spark, d).select(F.col("site").alias("model"), "date", F.col("station").alias("site"),
                                    F.col("value").alias("tmax"))


@query("join_7_alignment", V.with_views(TWO_SITES_SQL) + """
    , f AS (SELECT coalesce(a.model, b.model) AS model, a.date AS da, b.date AS db
            FROM (SELECT * FROM two WHERE site = 'F') a FULL JOIN (SELECT * FROM two WHERE site = 'O') b
            ON a.model = b.model AND a.date = b.date)
    SELECT model, count(da) AS n_left, count(db) AS n_right,
           count(*) FILTER (WHERE da IS NULL OR db IS NULL) AS mismatches FROM f GROUP BY ALL""")
def join_7(spark, d):
    return J.alignment_mismatches(two_sites(spark, d), ["model"], "site", ("F", "O"))


@query("join_8_side_by_side", V.with_views(TWO_SITES_SQL) + """
    SELECT coalesce(a.model, b.model) AS model, coalesce(a.date, b.date) AS date, a.tmax AS f, b.tmax AS o
    FROM (SELECT * FROM two WHERE site = 'F') a FULL JOIN (SELECT * FROM two WHERE site = 'O') b
    ON a.model = b.model AND a.date = b.date""", "f o")
def join_8(spark, d):
    sides = two_sites(spark, d).where(F.col("site").isin("F", "O"))
    return sides.groupBy("model", "date").agg(
        F.max(F.when(F.col("site") == "F", F.col("tmax"))).alias("f"),
        F.max(F.when(F.col("site") == "O", F.col("tmax"))).alias("o"))


@query("join_9_membership", LEVELS + """
    SELECT l.site, l.date, l.date IN (SELECT date FROM levels WHERE site = '5-LOW') AS known
    FROM levels l WHERE site <> '5-LOW'""")
def join_9(spark, d):
    levels = V.levels(spark, d)
    dates = levels.where("site = '5-LOW'").select("date").distinct()
    others = levels.where("site <> '5-LOW'").select("site", "date")
    return others.join(dates, "date", "left_semi").withColumn("known", F.lit(True)).unionByName(
        others.join(dates, "date", "left_anti").withColumn("known", F.lit(False)))


@query("join_10_redate_tail", LEVELS + """
    , r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY date DESC) AS k,
                   max(date) OVER (PARTITION BY site) AS last FROM levels)
    SELECT site, last + CAST(8 - k AS INT) AS date, level_m FROM r WHERE k <= 7""", "level_m")
def join_10(spark, d):
    return J.redate_tail(V.levels(spark, d), SITE, "date", 7)


@query("join_11_two_sites", V.with_views(V.ENSEMBLE_SQL) + """
    SELECT a.model, a.scenario, a.date, a.tmax AS tmax_catchment, a.tmin AS tmin_catchment,
           b.tmax AS tmax_lake, b.tmin AS tmin_lake
    FROM (SELECT * FROM ensemble WHERE site = 'catchment') a JOIN (SELECT * FROM ensemble WHERE site = 'lake') b
    ON a.model = b.model AND a.scenario = b.scenario AND a.date = b.date""",
       "tmax_catchment tmin_catchment tmax_lake tmin_lake")
def join_11(spark, d):
    return J.pair_sites(V.ensemble(spark, d), ["model", "scenario", "date"], "site", ("catchment", "lake"),
                        ["tmax", "tmin"])
