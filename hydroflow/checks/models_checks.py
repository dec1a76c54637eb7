"""Gold table, MDL-1 .. MDL-9 and REC-7 on the driver tables.

Tree models are rows-only: MLlib's trees are not SQL. Single fits use the published number of trees, cross-validated
ones few, for the time that README names; the rows are always the whole table.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hydroflow import config as C
from hydroflow.checks import views as V
from hydroflow.checks.registry import query
from hydroflow.checks.scalars_checks import PM_SQL
from hydroflow.checks.windows_checks import roll
from hydroflow.operators import selects
from hydroflow.plans import gold as G
from hydroflow.plans import models as M
from hydroflow.plans import winner as W
from hydroflow.session import scratch_path

YEARS, TRAIN_FROM = (1999, 2000), 1995
SMALL = M.Learner(trees=3)
WHOLE = M.Learner()
FOREST = M.Learner(kind="forest")


def agreed(metric):
    picked = f"metric = '{metric}' AND station"
    return f"coalesce(max(value) FILTER (WHERE {picked} = 'O'), avg(value) FILTER (WHERE {picked} <> 'O'))"


def lagged(column, rows):
    return f"lag({column}, {rows}) OVER (PARTITION BY site ORDER BY date)"


P2, P1, P0 = V.LEVEL_TO_VOLUME
GOLD_SQL = [
    V.SILVER_SQL, V.FLOWS_SQL, V.WEATHER_SQL.replace("weather AS (", "days AS ("),
    "wide AS (SELECT site, date, " + ", ".join(f"{agreed(m)} AS {c}" for c, m in G.CONSENSUS.items())
    + ", max(value) FILTER (WHERE metric = 'global_radiation_MJm2' AND station = 'O') AS radiation_MJm2 "
    "FROM silver GROUP BY ALL)",
    "spans AS (SELECT site, min(date) AS a, max(date) AS b FROM wide GROUP BY ALL)",
    "spine AS (SELECT site, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM spans)",
    """weather AS (SELECT s.site, s.date, dayofyear(s.date) AS doy, w.* EXCLUDE (site, date),
        d.rainfall_mm / 7 AS precip_intensity_mm_hr, d.level_m,
        i.flow_m3 AS inflow_m3, o.flow_m3 AS outflow_m3
      FROM spine s LEFT JOIN wide w ON s.site = w.site AND s.date = w.date
      LEFT JOIN days d ON s.site = d.site AND s.date = d.date
      LEFT JOIN (SELECT * FROM flows WHERE station = 'F') i ON s.site = i.site AND s.date = i.date
      LEFT JOIN (SELECT * FROM flows WHERE station = 'O') o ON s.site = o.site AND s.date = o.date)""",
    PM_SQL.replace("greatest((0.408", "(0.408").replace("* u2)), 0) AS et0_mm", "* u2)) AS et0_raw"),
    f"""g1 AS (SELECT *, CASE WHEN et0_raw IS NOT NULL THEN greatest(et0_raw, 0) END AS et0_mm,
        {P2!r} * level_m * level_m + {P1!r} * level_m + {P0!r} AS volume_Mm3, inflow_m3 - outflow_m3 AS net_inflow_m3 FROM et)""",
    "g2 AS (SELECT *, " + ", ".join([f"{roll('rainfall_mm', n, m)} AS rainfall_{n}d_mm" for n, m in C.RAIN_WINDOWS]
                                    + [f"{roll('et0_mm', n, m)} AS et0_{n}d_mm" for n, m in C.ET0_WINDOWS])
    + f""", level_m - {lagged('level_m', 1)} AS level_change_m, volume_Mm3 - {lagged('volume_Mm3', 1)} AS volume_change_Mm3,
        volume_Mm3 - {lagged('volume_Mm3', 2)} AS volume_change_2d_Mm3, volume_Mm3 - {lagged('volume_Mm3', 3)} AS volume_change_3d_Mm3,
        {lagged('inflow_m3', 1)} AS inflow_lag1_m3, {lagged('inflow_m3', 2)} AS inflow_lag2_m3,
        {lagged('net_inflow_m3', 1)} AS net_inflow_lag1_m3, {lagged('net_inflow_m3', 2)} AS net_inflow_lag2_m3,
        {roll('net_inflow_m3', 7, 1, 'avg')} AS net_inflow_7d_ma_m3 FROM g1)""",
    f"""gold AS (SELECT *, {lagged('volume_change_Mm3', 1)} AS volume_change_lag1_Mm3,
        {lagged('volume_change_Mm3', 2)} AS volume_change_lag2_Mm3,
        rainfall_7d_mm - et0_7d_mm AS moisture_balance_7d_mm, rainfall_14d_mm - et0_14d_mm AS moisture_balance_14d_mm FROM g2)""",
]
CHECKED = ["temp_mean_C", "humidity_pct", "radiation_MJm2", "et0_mm", "rainfall_7d_mm", "rainfall_45d_mm", "et0_7d_mm",
           "et0_14d_mm", "moisture_balance_7d_mm", "moisture_balance_14d_mm", "precip_intensity_mm_hr", "inflow_lag1_m3",
           "net_inflow_lag2_m3", "net_inflow_7d_ma_m3", "volume_change_lag1_Mm3", "volume_change_lag2_Mm3", "level_m",
           "volume_Mm3", "level_change_m", "volume_change_Mm3", "volume_change_2d_Mm3", "volume_change_3d_Mm3"]


@query("gold_features", V.with_views(*GOLD_SQL) + f"SELECT site, date, {', '.join(CHECKED)} FROM gold",
       " ".join(f"{c}:4" if c.startswith("volume") else c for c in CHECKED))
def gold_features(spark, d):
    return V.gold(spark, d).select("site", "date", *CHECKED)


@query("mdl_1_boosted_trees")
def mdl_1(spark, d):
    frame = V.frame(spark, d)
    model = M.fit(frame, C.INFLOW_FEATURES, C.INFLOW_TARGET, WHOLE)
    return M.predict(model, frame, C.INFLOW_FEATURES, "predicted", floor=0.0).select("site", "date", "predicted")


@query("mdl_2_forest")
def mdl_2(spark, d):
    frame = V.frame(spark, d)
    model = M.fit(frame, C.INFLOW_FEATURES, C.INFLOW_TARGET, FOREST)
    return M.predict(model, frame, C.INFLOW_FEATURES, "predicted", floor=0.0).select("site", "date", "predicted")


@query("mdl_3_log_target")
def mdl_3(spark, d):
    frame = V.frame(spark, d).drop("predicted_inflow_m3").withColumn("predicted_inflow_m3", F.col("inflow_m3"))
    model = M.fit(frame, C.VOLUME_FEATURES, C.VOLUME_TARGET, WHOLE, log_target=True)
    return M.predict(model, frame, C.VOLUME_FEATURES, "predicted", log_target=True).select("site", "date", "predicted")


@query("mdl_4_stacked_stages")
def mdl_4(spark, d):
    return M.cv_baseline(V.frame(spark, d), SMALL, YEARS, TRAIN_FROM)


def architecture(name):
    def run(spark, d):
        return M.ARCHITECTURES[name](V.frame(spark, d), SMALL, YEARS, TRAIN_FROM)
    return run


for _name in ("max_chain", "direct_anchor", "single_stage", "roll_one"):
    query(f"mdl_5_{_name}")(architecture(_name))


def final_models(spark, d):
    frame = V.frame(spark, d)
    out_of_fold = M.cv_baseline(frame, SMALL, YEARS[-1:], TRAIN_FROM)
    path = scratch_path(spark, "models")
    M.save_models(M.fit_final(frame, out_of_fold, SMALL), path)
    return frame, path


@query("mdl_6_mdl_7_saved_importance")
def mdl_7(spark, d):
    _, path = final_models(spark, d)
    return selects.union_aligned([
        M.split_importance(spark, f"{path}/{name}", features).withColumn("model", F.lit(name))
        for name, features in (("inflow", C.INFLOW_FEATURES), ("volume", C.VOLUME_FEATURES),
                               ("volume_direct", C.VOLUME_DIRECT_FEATURES))])


def history_and_forecast(gold):
    """Per site the last seven days of the record as the forecast, the 52 before as the history."""
    last = gold.groupBy("site").agg(F.max("date").alias("_last"))
    age = F.datediff("_last", "date")
    marked = gold.join(last, "site").withColumn("_age", age).drop("_last")
    return marked.where("_age between 7 and 58").drop("_age"), \
        marked.where("_age < 7").select("site", *C.FORECAST_COLUMNS)


FORECAST_SQL = GOLD_SQL + [
    "cut AS (SELECT site, max(date) AS last FROM gold GROUP BY ALL)",
    """u AS (SELECT g.site, g.date, g.date > last - 7 AS ahead, doy, temp_max_C, temp_min_C, rainfall_mm, humidity_pct,
        wind_speed_ms, radiation_MJm2, et0_mm AS known_et0, (temp_max_C + temp_min_C) / 2 AS temp_mean_C
      FROM gold g JOIN cut ON g.site = cut.site WHERE g.date > last - 59)""",
    PM_SQL.replace("pm AS", "fpm AS").replace("pn AS", "fpn AS").replace("et AS (SELECT *, greatest(", "fet AS (SELECT *, (")
    .replace(", 0) AS et0_mm FROM pn", ") AS own FROM fpn").replace("FROM weather", "FROM u").replace("FROM pm", "FROM fpm"),
    """fx AS (SELECT *, CASE WHEN NOT ahead THEN known_et0 WHEN own IS NOT NULL THEN greatest(own, 0) END AS et0_mm FROM fet)""",
    "fr AS (SELECT site, date, ahead, et0_mm, " + ", ".join(
        [f"{roll('rainfall_mm', n, m)} AS rainfall_{n}d_mm" for n, m in C.RAIN_WINDOWS]
        + [f"{roll('et0_mm', n, m)} AS et0_{n}d_mm" for n, m in C.ET0_WINDOWS]
        + [f"{lagged('rainfall_mm', k)} AS rainfall_lag{k}_mm" for k in (1, 2, 3)]) + " FROM fx)"]
FORECAST_CHECKED = ["et0_mm", "rainfall_7d_mm", "rainfall_30d_mm", "rainfall_45d_mm", "et0_7d_mm", "rainfall_lag1_mm",
                    "rainfall_lag3_mm"]


@query("mdl_8_forecast_features", V.with_views(*FORECAST_SQL)
       + f"SELECT site, date, {', '.join(FORECAST_CHECKED)} FROM fr WHERE ahead", " ".join(FORECAST_CHECKED))
def mdl_8(spark, d):
    history, forecast = history_and_forecast(V.gold(spark, d))
    return G.forecast_features(history, forecast, V.CONFIG).select("site", "date", *FORECAST_CHECKED)


@query("mdl_9_rec_7_week_forecast")
def mdl_9(spark, d):
    frame, path = final_models(spark, d)
    history, forecast = history_and_forecast(frame)
    features = G.forecast_features(history, forecast, V.CONFIG)
    return M.run_forecast(features, history, M.load_models(path), V.CONFIG)


WEEK_SQL = V.with_views(*GOLD_SQL) + """
    , cut AS (SELECT site, max(date) AS last FROM gold GROUP BY ALL),
    st AS (SELECT g.site, arg_max(level_m, date) AS level_m, arg_max(volume_Mm3, date) AS volume_Mm3 FROM gold g JOIN cut ON g.site = cut.site
           WHERE date BETWEEN last - 58 AND last - 7 AND level_m IS NOT NULL AND volume_Mm3 IS NOT NULL GROUP BY ALL),
    week AS (SELECT cut.site, CAST(k AS INT) AS day, last - 7 + CAST(k AS INT) AS date FROM cut, range(1, 8) r(k))"""


def week_of(name):
    def run(spark, d):
        """The architecture is fitted on all rows and forecasts a week for every site."""
        frame = V.frame(spark, d)
        history, forecast = history_and_forecast(frame)
        features = G.forecast_features(history, forecast, V.CONFIG)
        entry = W.ARCHITECTURES[name]
        rows = entry.serve(features, history, entry.fit(frame, None, SMALL), V.CONFIG)
        known = F.col("pred_level_m").isNotNull() & F.col("pred_volume_Mm3").isNotNull()
        has_inflow = F.col("pred_inflow_Mm3").isNotNull()
        return rows.select("site", "day", "date", "start_level_m", "start_volume_Mm3", known.alias("is_predicted"), has_inflow.alias("has_inflow"),
                           (F.abs(F.col("pred_volume_Mm3") - F.col("start_volume_Mm3") - F.col("cum_dvol_Mm3")) < 1e-6).alias("adds_up"))
    return run


for _name, _inflow in (("direct_anchor", "true"), ("single_stage", "false"), ("max_chain", "true"), ("roll_one", "true")):
    query(f"mdl_6_week_of_{_name}", WEEK_SQL + f"""
    SELECT week.site, day, date, level_m AS start_level_m, volume_Mm3 AS start_volume_Mm3, true AS is_predicted, {_inflow} AS has_inflow, true AS adds_up
    FROM week JOIN st ON week.site = st.site""", "start_level_m start_volume_Mm3:4")(week_of(_name))


@query("mdl_9_forecast_summary", V.with_views(*GOLD_SQL) + """
    , w AS (SELECT site, date, level_m, volume_Mm3, row_number() OVER (PARTITION BY site ORDER BY date) AS day FROM gold WHERE level_m IS NOT NULL),
    e AS (SELECT site, arg_max(level_m, day) AS end_level_m, arg_max(volume_Mm3, day) AS end_volume_Mm3, CAST(max(day) AS DOUBLE) / 2 AS week_dvol_Mm3,
                 arg_min(level_m, day) AS start_level_m FROM w GROUP BY ALL)
    SELECT site, end_level_m, end_volume_Mm3, week_dvol_Mm3, end_level_m - start_level_m AS level_change_m,
           CASE WHEN end_level_m - start_level_m > 0.01 THEN 'RISING' WHEN end_level_m - start_level_m < -0.01 THEN 'FALLING' ELSE 'STABLE' END AS trend
    FROM e""", "end_level_m end_volume_Mm3:4 week_dvol_Mm3 level_change_m")
def mdl_9_summary(spark, d):
    gold = V.gold(spark, d).where("level_m is not null")
    w = Window.partitionBy("site").orderBy("date")
    rows = gold.select("site", F.col("level_m").alias("pred_level_m"), F.col("volume_Mm3").alias("pred_volume_Mm3"),
                       F.row_number().over(w).alias("day"), F.first("level_m").over(w).alias("start_level_m"))
    return M.forecast_summary(rows.withColumn("cum_dvol_Mm3", F.col("day") * 0.5))
