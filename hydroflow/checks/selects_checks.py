"""PRJ-1 .. PRJ-10, SRT-1 .. SRT-4, SET-1 .. SET-3 on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydroflow import config as C
from hydroflow.checks import views as V
from hydroflow.checks.registry import query
from hydroflow.functions import scalars as S
from hydroflow.operators import aggregates, joins, selects
from hydroflow.operators.fill import on_spine
from hydroflow.operators.windows import difference

SITE = ("site",)
WEATHER = V.with_views(V.WEATHER_SQL)
SILVER = V.with_views(V.SILVER_SQL)
LEVELS = V.with_views(V.LEVELS_SQL)


@query("prj_1_metric_suffix", SILVER + "SELECT * FROM silver WHERE suffix(metric, '_mean')", "value")
def prj_1(spark, d):
    return selects.select_metrics(V.silver(spark, d), "_mean")


@query("prj_2_complete_cases", V.with_views(V.GAPPY_SPINE_SQL) + """
    SELECT site, station, date, value FROM dense WHERE value IS NOT NULL""", "value")
def prj_2(spark, d):
    return selects.complete_cases(on_spine(V.gappy(spark, d), ("site", "station")), ["value"]).drop("doy")


@query("prj_3_calendar_filters", LEVELS + """
    SELECT * FROM levels WHERE year(date) IN (1996, 1997, 1998) AND month(date) IN (11, 12, 1, 2, 3)
    AND date BETWEEN DATE '1996-02-01' AND DATE '1998-11-30'""", "level_m")
def prj_3(spark, d):
    years = selects.in_years(V.levels(spark, d), "date", (1996, 1997, 1998))
    return selects.in_dates(selects.in_months(years, "date", C.WET_MONTHS), "date", "1996-02-01", "1998-11-30")


@query("prj_4_exclusions", LEVELS + "SELECT * FROM levels WHERE site NOT IN ('5-LOW', '2-HIGH')", "level_m")
def prj_4(spark, d):
    return selects.excluding(V.levels(spark, d), "site", ("5-LOW", "2-HIGH"))


@query("prj_5_seasons", LEVELS + """
    SELECT site, date, CASE WHEN month(date) IN (10, 11, 12, 1, 2, 3) THEN 'winter' ELSE 'summer' END AS season,
           CASE WHEN month(date) IN (11, 12, 1, 2, 3) THEN 'wet' ELSE 'dry' END AS wetness FROM levels""")
def prj_5(spark, d):
    return V.levels(spark, d).select("site", "date", S.season("date").alias("season"),
                                     S.wet_season("date").alias("wetness"))


@query("prj_6_first_of_two", V.with_views(V.GAPPY_SQL) + """
    SELECT site, date, coalesce(max(value) FILTER (WHERE station = 'F'), max(value) FILTER (WHERE station = 'O'))
           AS value FROM gappy GROUP BY ALL""", "value")
def prj_6(spark, d):
    wide = aggregates.pivot_wide(V.gappy(spark, d), ("site", "date"), "station", "value", ("F", "O", "P"))
    return wide.select("site", "date", F.coalesce("F", "O").alias("value"))


@query("prj_7_every_kth", WEATHER + """
    SELECT site, date, level_m FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY date) AS k FROM weather)
    WHERE (k - 1) % 7 = 0""", "level_m")
def prj_7(spark, d):
    return selects.every_kth(V.weather(spark, d), SITE, "date", C.TEST_ANCHOR_STEP).select(
        "site", "date", "level_m")


SCENARIOS = (("as forecast", 1.0, 0.0), ("wet", 1.5, -1.0), ("dry", 0.5, 2.0))


@query("prj_8_what_if", WEATHER + "SELECT site, date, scenario, rainfall_mm * m AS rainfall_mm, "
       "temp_max_C + o AS temp_max_C, temp_min_C + o AS temp_min_C FROM weather, (VALUES "
       + ", ".join(f"('{n}', {m}, {o})" for n, m, o in SCENARIOS) + ") s(scenario, m, o)",
       "rainfall_mm temp_max_C temp_min_C")
def prj_8(spark, d):
    days = V.weather(spark, d).select("site", "date", "rainfall_mm", "temp_max_C", "temp_min_C")
    return selects.what_if(days, SCENARIOS)


@query("prj_9_units", WEATHER + """
    SELECT site, date, inflow_m3 * 86400 / 1e9 AS daily, outflow_m3 / 1e6 AS mm3, wind_speed_ms / 3.6 AS ms,
           rainfall_mm * 166.0 * 0.001 AS lake, round_even(radiation_MJm2 * 1000 * 600 / 1e6, 3) AS energy
    FROM weather""", "daily mm3 ms lake energy")
def prj_9(spark, d):
    return V.weather(spark, d).select(
        "site", "date", (S.m3s_to_m3day("inflow_m3") / 1e9).alias("daily"), S.m3_to_Mm3("outflow_m3").alias("mm3"),
        S.kmh_to_ms("wind_speed_ms").alias("ms"), S.mm_over_lake_to_Mm3("rainfall_mm").alias("lake"),
        S.slot_radiation_to_MJ(F.col("radiation_MJm2") * 1000).alias("energy"))


@query("prj_10_trend_class", WEATHER + """
    , c AS (SELECT site, date, level_m - lag(level_m) OVER (PARTITION BY site ORDER BY date) AS dl FROM weather)
    SELECT site, date, CASE WHEN dl > 0.01 THEN 'RISING' WHEN dl < -0.01 THEN 'FALLING'
           WHEN dl IS NOT NULL THEN 'STABLE' END AS trend FROM c""")
def prj_10(spark, d):
    return V.weather(spark, d).select("site", "date", S.trend(
        difference("level_m", SITE, "date")).alias("trend"))


# sorts, limits, top-k --------------------------------------------------------------------

@query("srt_1_sorted", LEVELS + "SELECT * FROM levels ORDER BY site, date", "level_m")
def srt_1(spark, d):
    return V.levels(spark, d).orderBy("site", "date")


@query("srt_2_tail_rows", LEVELS + """
    SELECT site, date, level_m FROM levels WHERE date < DATE '1999-06-01'
    QUALIFY row_number() OVER (PARTITION BY site ORDER BY date DESC) <= 21""", "level_m")
def srt_2(spark, d):
    return selects.tail_rows(V.levels(spark, d), SITE, "date", 21, F.lit("1999-06-01").cast("date"))


@query("srt_3_top_counts", """
    SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL ORDER BY n DESC, o_custkey LIMIT 8""")
def srt_3(spark, d):
    return aggregates.top_counts(V.table(spark, d, "orders"), ["o_custkey"], 8)


@query("srt_4_winner", """
    WITH s AS (SELECT o_orderstatus AS fold, o_orderpriority AS model,
                      corr(o_totalprice, o_custkey) AS r2 FROM orders GROUP BY ALL)
    SELECT fold, model, r2 FROM s QUALIFY row_number() OVER (PARTITION BY fold ORDER BY
        CASE WHEN r2 IS NULL OR r2 = 0 THEN -1 ELSE r2 END DESC, model DESC) = 1""", "r2")
def srt_4(spark, d):
    scores = V.table(spark, d, "orders").groupBy(
        F.col("o_orderstatus").alias("fold"), F.col("o_orderpriority").alias("model")).agg(
        F.corr("o_totalprice", "o_custkey").alias("r2"))
    return selects.arg_max(scores, ["fold"], "model", "r2")


# set operations ------------------------------------------------------------------------------

@query("set_1_union_aligned", """
    SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""", "balance")
def set_1(spark, d):
    a = V.table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"))
    b = V.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return selects.union_aligned([a, b])


@query("set_2_distinct", "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def set_2(spark, d):
    return V.table(spark, d, "orders").select("o_orderpriority", "o_orderstatus").distinct()


@query("set_3_replace_rows", V.with_views(V.LEVELS_SQL) + """
    , fresh AS (SELECT site, date, level_m + 1 AS level_m FROM levels WHERE date >= DATE '2000-01-01')
    SELECT * FROM levels WHERE (site, date) NOT IN (SELECT (site, date) FROM fresh)
    UNION ALL SELECT * FROM fresh""", "level_m")
def set_3(spark, d):
    old = V.levels(spark, d)
    new = old.where(F.col("date") >= F.lit("2000-01-01").cast("date")) \
             .withColumn("level_m", F.col("level_m") + 1)
    return joins.replace_rows(old, new, ["site", "date"])
