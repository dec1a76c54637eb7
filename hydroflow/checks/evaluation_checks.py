"""EVL-1 .. EVL-15 and FIT-12 on the driver tables.

Scores are checked on simple stored predictions (the day before's value), so the
twins can say them in SQL; the jobs that fit trees are rows-only.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hydroflow import config as C
from hydroflow.checks import views as V
from hydroflow.checks.fits_checks import (
    DAYS, TEST_YEARS, clear_sql, daily_levels, days, harmonic_sql, rates_sql, value_sql)
from hydroflow.checks.models_checks import SMALL, TRAIN_FROM
from hydroflow.checks.registry import query
from hydroflow.checks.scalars_checks import RA
from hydroflow.operators import aggregates as A
from hydroflow.operators import joins, recurrences, selects
from hydroflow.operators.windows import difference
from hydroflow.plans import evaluation as E
from hydroflow.plans import longrange as L
from hydroflow.plans import models as M

SITE = ("site",)
A2, A1, A0 = C.VOLUME_TO_LEVEL

# stored predictions: volume change of day t+h, predicted as half the anchor day's change
STORED_SQL = V.WEATHER_SQL.replace("weather AS (", "weather0 AS (") + """,
    weather AS (SELECT *, level_m * 300 + 67000 AS volume_Mm3 FROM weather0),
    ch AS (SELECT *, volume_Mm3 - lag(volume_Mm3) OVER (PARTITION BY site ORDER BY date) AS dv FROM weather),
    preds AS (SELECT CAST(year(a.date) AS VARCHAR) AS fold, a.site, a.date, CAST(h AS INT) AS horizon_h, 'volume' AS stage,
                     t.dv AS actual, a.dv / 2 AS predicted
              FROM ch a, range(1, 8) r(h) LEFT JOIN ch t ON a.site = t.site AND t.date = a.date + CAST(h AS INT))"""


def lake_days(spark, d):
    return V.weather(spark, d).withColumn("volume_Mm3", F.col("level_m") * 300 + 67000) \
            .withColumn("dv", difference("volume_Mm3", SITE, "date"))


def stored(spark, d):
    ahead = joins.expand_horizons(lake_days(spark, d), SITE, "date", C.HORIZONS, {"dv": "actual"}, ("dv",))
    return ahead.select(F.year("date").cast("string").alias("fold"), "site", "date", "horizon_h",
                        F.lit("volume").alias("stage"), "actual", (F.col("dv") / 2).alias("predicted"))


METRICS_SQL = """count(*) AS n, CASE WHEN var_pop(actual) > 0 THEN 1 - avg((predicted - actual) ** 2) / var_pop(actual)
    ELSE 0 END AS r2, avg(abs(predicted - actual)) AS mae, sqrt(avg((predicted - actual) ** 2)) AS rmse,
    avg(predicted - actual) AS bias"""
KNOWN = "actual IS NOT NULL AND predicted IS NOT NULL"


@query("evl_1_error_metrics", V.with_views(STORED_SQL) + f"""
    SELECT fold, site, {METRICS_SQL} FROM preds WHERE {KNOWN} GROUP BY fold, site""", "r2 mae rmse bias")
def evl_1(spark, d):
    return A.error_metrics(stored(spark, d), ["fold", "site"], "actual", "predicted")


@query("evl_2_walk_forward_folds", V.with_views(V.LEVELS_SQL) + """
    SELECT site, date, level_m, CAST(y AS INT) AS fold, CASE WHEN year(date) = y THEN 'test' ELSE 'train' END AS role
    FROM levels, (VALUES (1998), (1999), (2000)) f(y) WHERE year(date) <= y AND year(date) >= 1996""", "level_m")
def evl_2(spark, d):
    return M.tag_folds(V.levels(spark, d), TEST_YEARS, 1996)


DRIFT_SQL = STORED_SQL + f""",
    weeks AS (SELECT site, date, fold, sum(predicted) AS s, count(*) AS n FROM preds GROUP BY ALL),
    drift AS (SELECT w.fold, w.site, w.date, abs({A2!r} * (a.volume_Mm3 + s) ** 2 + {A1!r} * (a.volume_Mm3 + s) + {A0!r} - e.level_m) AS drift_m
      FROM weeks w JOIN weather a ON w.site = a.site AND w.date = a.date
      JOIN weather e ON w.site = e.site AND e.date = w.date + 7
      WHERE n >= 7 AND s IS NOT NULL)"""


@query("evl_3_week_drift", V.with_views(DRIFT_SQL) + "SELECT fold, avg(drift_m) AS drift_m FROM drift GROUP BY ALL", "drift_m")
def evl_3(spark, d):
    ahead = stored(spark, d).withColumnRenamed("predicted", "pred_dvol")
    drift = E.week_drift(ahead, lake_days(spark, d), groups=("fold",))
    return drift.groupBy("fold").agg(F.avg("drift_m").alias("drift_m"))


# long range -----------------------------------------------------------------------------

HS = f"0.0023 * 0.408 * {RA} * ((temp_max_C + temp_min_C) / 2 + 17.8) * sqrt(greatest(temp_max_C - temp_min_C, 0))"
SEEN = "year(date) < fold AND year(date) >= 1995"
FEATURES = "et0_hs cloud_index tmax_anom_z"


def fold_sql(k: int) -> str:
    """Daily features per fold, their references fitted with ``k`` harmonics on the train years."""
    normal = value_sql("t", harmonics=k)
    return DAYS[:-1] + ", " + ", ".join([
        "wf AS (SELECT *, CAST(unnest([1999, 2000]) AS INT) AS fold FROM weather)",
        harmonic_sql("h", "wf", "dtr", "site, fold", SEEN, k), harmonic_sql("t", "wf", "temp_max_C", "site, fold", SEEN, k),
        clear_sql("wf", ("site", "fold"), "year(date) < w.fold AND year(date) >= 1995", k),
        f"""sg AS (SELECT t.site, t.fold, stddev_pop(temp_max_C - {normal}) AS sigma FROM wf w
            JOIN t ON w.site = t.site AND w.fold = t.fold WHERE year(date) < w.fold AND year(date) >= 1995 GROUP BY t.site, t.fold)""",
        f"""feat AS (SELECT w.*, {HS} AS et0_hs,
            1 - least(greatest(sqrt(dtr) / sqrt(greatest({value_sql('clear', harmonics=k)}, 1e-9)), 0), 1) AS cloud_index,
            (temp_max_C - {normal}) / sigma AS tmax_anom_z
            FROM wf w JOIN clear ON w.site = clear.site AND w.fold = clear.fold JOIN t ON w.site = t.site AND w.fold = t.fold
            JOIN sg ON w.site = sg.site AND w.fold = sg.fold)"""]) + " "


FOLD_SQL = fold_sql(1)


def long_days(spark, d, harmonics=1):
    folds = L.per_fold(days(spark, d), (1999, 2000), 1995)
    return L.temperature_features(folds, harmonics=harmonics)


@query("fit_12_training_only_references", FOLD_SQL + """
    SELECT site, fold, date, et0_hs, cloud_index, tmax_anom_z FROM feat""", "et0_hs cloud_index tmax_anom_z")
def fit_12(spark, d):
    return long_days(spark, d).select("site", "fold", "date", "et0_hs", "cloud_index", "tmax_anom_z")


@query("fit_12_training_only_references_three_harmonics", fold_sql(3) + "SELECT site, fold, date, et0_hs, cloud_index, tmax_anom_z FROM feat",
       FEATURES)
def fit_12b(spark, d):
    return long_days(spark, d, 3).select("site", "fold", "date", *FEATURES.split())


def samples(spark, d, harmonics=1):
    lake = long_days(spark, d, harmonics).withColumns({
        "volume_Mm3": F.col("level_m") * 300 + 67000, "season_sin": F.sin(F.col("doy") / 58.0),
        "season_cos": F.cos(F.col("doy") / 58.0), "rainfall_30d_mm": F.col("rainfall_mm"),
        "bucket_S": F.col("humidity_pct"), "bucket_Q30": F.col("wind_speed_ms")})
    return L.change_samples(L.mark_anchors(lake), L.FOLD)


SAMPLES_OF = """, marked AS (SELECT *, level_m * 300 + 67000 AS v,
        row_number() OVER (PARTITION BY site, fold, year(date) < fold ORDER BY date) AS k_train,
        row_number() OVER (PARTITION BY site, fold, year(date) ORDER BY date) AS k_test FROM feat),
    ahead AS (SELECT *, """ + ", ".join(
    f"lead(v, {h}) OVER w AS v{h}, " + ", ".join(
        f"avg({c}) OVER (w ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) AS {c}_{h}"
        for c in ("cloud_index", "dtr", "tmax_anom_z", "et0_hs")) for h in C.LEADS) + """
        FROM marked WINDOW w AS (PARTITION BY site, fold ORDER BY date))""" + ", samples AS (" + " UNION ALL ".join(
    f"""SELECT site, fold, date, doy, {float(h)} AS horizon_h, year(date) < fold AND k_train % 2 = 1 AS train_anchor,
        year(date) = fold AND k_test % 7 = 1 AS test_anchor, cloud_index_{h} AS mean_cloud_index, dtr_{h} AS mean_dtr,
        tmax_anom_z_{h} AS mean_tmax_anom_z, et0_hs_{h} AS mean_et0_hs, v{h} - v AS target FROM ahead
        WHERE v{h} IS NOT NULL AND ((year(date) < fold AND k_train % 2 = 1) OR (year(date) = fold AND k_test % 7 = 1))"""
    for h in C.LEADS) + ") "
SAMPLES_SQL = FOLD_SQL + SAMPLES_OF
MEANS = "mean_cloud_index mean_dtr mean_tmax_anom_z mean_et0_hs target"


@query("evl_4_change_samples", SAMPLES_SQL + f"""
    SELECT site, fold, date, CAST(horizon_h AS DOUBLE) AS horizon_h, {', '.join(MEANS.split())} FROM samples
    WHERE test_anchor""", "horizon_h " + MEANS)
def evl_4(spark, d):
    return samples(spark, d).where("test_anchor").select("site", "fold", "date", "horizon_h", *MEANS.split())


@query("evl_4_change_samples_all_anchors", fold_sql(3) + SAMPLES_OF + f"""
    SELECT site, fold, date, CAST(horizon_h AS DOUBLE) AS horizon_h, train_anchor, test_anchor, {', '.join(MEANS.split())} FROM samples""",
       "horizon_h " + MEANS)
def evl_4b(spark, d):
    return samples(spark, d, 3).select("site", "fold", "date", "horizon_h", "train_anchor", "test_anchor", *MEANS.split())


def clim_sql(k: int, k_lead: int) -> str:
    return fold_sql(k) + SAMPLES_OF + ", " + harmonic_sql("cl", "samples", "target", "site, fold, horizon_h", "train_anchor", k_lead) + f"""
    , scored AS (SELECT s.*, {value_sql('cl', harmonics=k_lead)} AS pred_clim, target * 0.9 AS pred_base, target * 0.8 + 1 AS pred_temp,
        target * 0.7 + mean_dtr AS pred_tempbucket FROM samples s
        JOIN cl ON s.site = cl.site AND s.fold = cl.fold AND s.horizon_h = cl.horizon_h WHERE test_anchor)"""


CLIM_SQL = clim_sql(1, 1)
LEAD_CLIMATE = "SELECT site, fold, date, CAST(horizon_h AS DOUBLE) AS horizon_h, pred_clim FROM scored"


def with_climatology(spark, d):
    return L.climatology_predictor(samples(spark, d), harmonics=1).where("test_anchor")


@query("evl_5_lead_climatology", CLIM_SQL + LEAD_CLIMATE, "horizon_h pred_clim")
def evl_5(spark, d):
    return with_climatology(spark, d).select("site", "fold", "date", "horizon_h", "pred_clim")


@query("evl_5_lead_climatology_as_published", clim_sql(3, 2) + LEAD_CLIMATE, "horizon_h pred_clim")
def evl_5b(spark, d):
    """References with three harmonics, the normal of a lead with two."""
    made = L.climatology_predictor(samples(spark, d, 3)).where("test_anchor")
    return made.select("site", "fold", "date", "horizon_h", "pred_clim")


def skill_sql(lead, where):
    se = {p: f"avg((target - pred_{p}) ** 2)" for p in ("clim", "base", "temp", "tempbucket")}
    return f"""SELECT {lead} AS lead, CASE WHEN month(date) IN (11, 12, 1, 2, 3) THEN 'wet' ELSE 'dry' END AS season,
        count(*) AS n, """ + ", ".join(f"sqrt({v}) AS rmse_{p}" for p, v in se.items()) + ", " + ", ".join(
        f"1 - {se[a]} / {se[b]} AS ss_{a}_vs_{b}" for a, b in L.PAIRS) + f" FROM scored WHERE {where} GROUP BY 1, 2"


@query("evl_6_skill_scores", CLIM_SQL + skill_sql("CAST(horizon_h AS INT)", "true") + " UNION ALL "
       + skill_sql("CAST(NULL AS INT)", "horizon_h IN (14, 21, 30)"),
       " ".join([f"rmse_{p}" for p in ("clim", "base", "temp", "tempbucket")] + [f"ss_{a}_vs_{b}" for a, b in L.PAIRS]))
def evl_6(spark, d):
    scored = with_climatology(spark, d).withColumns({
        "pred_base": F.col("target") * 0.9, "pred_temp": F.col("target") * 0.8 + 1,
        "pred_tempbucket": F.col("target") * 0.7 + F.col("mean_dtr")})
    return L.skill_scores(scored)


@query("evl_6_longrange_bakeoff")
def evl_6b(spark, d):
    test_years = (1999, 2000)
    made = M.longrange_predictions(samples(spark, d, 3), test_years, SMALL)
    return L.skill_scores(made)


# red line -----------------------------------------------------------------------------------

BACKTEST_SQL = V.with_views(rates_sql(TEST_YEARS)) + """
    , a AS (SELECT site, test_year, make_date(test_year, 6, 1) AS d0 FROM grid),
    w AS (SELECT a.*, k, l.level_m, r.rate FROM a, range(0, 22) t(k), daily l, rates r WHERE l.site = a.site
          AND l.date = d0 - CAST(k AS INT) AND r.site = a.site AND r.test_year = a.test_year AND r.doy = dayofyear(d0 - CAST(k AS INT))),
    s AS (SELECT site, test_year, d0, max(level_m) FILTER (WHERE k = 0) AS l0,
            CASE WHEN avg(rate) < -1e-4 THEN least(greatest((max(level_m) FILTER (WHERE k = 0)
              - max(level_m) FILTER (WHERE k = 21)) / 21 / avg(rate), 0.45), 1.6) ELSE 1 END AS scale FROM w GROUP BY ALL),
    p AS (SELECT s.*, k, sum(rate) OVER (PARTITION BY s.site, s.test_year ORDER BY k) AS moved FROM s, range(1, 91) t(k), rates r
          WHERE r.site = s.site AND r.test_year = s.test_year AND r.doy = dayofyear(d0 + CAST(k AS INT))),
    errors AS (SELECT p.site, p.test_year, CAST(k AS INT) AS horizon, l0 + scale * moved - l.level_m AS err_method,
                      l0 - l.level_m AS err_persist, l0 + moved - l.level_m AS err_unscaled
               FROM p JOIN daily l ON l.site = p.site AND l.date = d0 + CAST(k AS INT) WHERE k IN (30, 60, 90))
"""


def backtest(spark, d):
    return L.redline_backtest(daily_levels(spark, d), SITE, TEST_YEARS, from_year=1996)


@query("evl_7_redline_errors", BACKTEST_SQL + "SELECT * FROM errors", "err_method err_persist err_unscaled")
def evl_7(spark, d):
    return backtest(spark, d)


@query("evl_7_redline_report", BACKTEST_SQL + """
    SELECT horizon, count(*) AS n_years, avg(abs(err_method)) AS mae_method_m, avg(abs(err_persist)) AS mae_persist_m,
           avg(abs(err_unscaled)) AS mae_unscaled_m, sqrt(avg(err_method ** 2)) AS rmse_method_m,
           1 - avg(err_method ** 2) / avg(err_persist ** 2) AS skill_vs_persistence,
           1 - avg(err_method ** 2) / avg(err_unscaled ** 2) AS skill_vs_unscaled FROM errors GROUP BY ALL""",
       "mae_method_m mae_persist_m mae_unscaled_m rmse_method_m skill_vs_persistence skill_vs_unscaled")
def evl_7b(spark, d):
    return L.redline_report(backtest(spark, d))


@query("evl_8_bucket_ablation")
def evl_8(spark, d):
    frame = V.frame(spark, d)
    frame = recurrences.bucket_state(frame, SITE, "date", "rainfall_mm", "et0_mm")
    variants = []
    for name, extra in (("base", ()), ("bucket", C.BUCKET_FEATURES)):
        rows = M.cv_baseline(frame, SMALL, (1999, 2000), TRAIN_FROM, (*C.INFLOW_FEATURES, *extra),
                             (*C.VOLUME_FEATURES, *extra))
        variants.append(rows.withColumn("variant", F.lit(name)))
    table = E.ablation(selects.union_aligned(variants), "1999", "2000")
    return E.ablation_verdict(table, "base", "bucket")


@query("evl_9_roc_auc", """
    WITH s AS (SELECT lang, n_chars AS score, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
    r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS rk FROM s)
    SELECT lang, (sum(rk) FILTER (WHERE quality = 1) - sum(quality) * (sum(quality) + 1) / 2) / nullif(sum(quality) * (count(*) - sum(quality)), 0) AS auc,
           CAST(sum(quality) AS BIGINT) AS n_pos, CAST(count(*) - sum(quality) AS BIGINT) AS n_neg FROM r GROUP BY ALL""", "auc")
def evl_9(spark, d):
    scored = V.table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").alias("score")).join(
        V.table(spark, d, "labels"), "doc_id")
    return A.roc_auc(scored, ["lang"], "score", "quality")


def premise_sql(k: int) -> str:
    return (DAYS[:-1] + ", " + ", ".join([
    harmonic_sql("h", "weather", "dtr", harmonics=k), harmonic_sql("t", "weather", "temp_max_C", harmonics=k),
    clear_sql("weather", harmonics=k),
    f"""sc AS (SELECT w.site, date, rainfall_mm, 1 - least(greatest(sqrt(dtr) / sqrt(greatest({value_sql('clear', harmonics=k)}, 1e-9)), 0), 1) AS ci,
        temp_max_C - {value_sql('t', harmonics=k)} AS resid FROM weather w JOIN clear ON w.site = clear.site JOIN t ON w.site = t.site)""",
    """z AS (SELECT site, month(date) IN (11, 12, 1, 2, 3) AS season, rainfall_mm, ci,
        CAST(rainfall_mm > 1 AS INT) AS wet, round(ci - 0.5 * resid / stddev_pop(resid) OVER (PARTITION BY site), 12) AS score FROM sc)"""])
    + """, ranks AS (SELECT *, rank() OVER (PARTITION BY site ORDER BY score) + (count(*) OVER (PARTITION BY site, score) - 1) / 2.0 AS rk FROM z),
    ws AS (SELECT *, rank() OVER (PARTITION BY site ORDER BY score) + (count(*) OVER (PARTITION BY site, score) - 1) / 2.0 AS rk FROM z WHERE season),
    o AS (SELECT site, (sum(rk) FILTER (WHERE wet = 1) - sum(wet) * (sum(wet) + 1) / 2) / nullif(sum(wet) * (count(*) - sum(wet)), 0) AS auc FROM ranks GROUP BY ALL),
    s AS (SELECT site, (sum(rk) FILTER (WHERE wet = 1) - sum(wet) * (sum(wet) + 1) / 2) / nullif(sum(wet) * (count(*) - sum(wet)), 0) AS auc,
                 corr(ci, rainfall_mm) AS c FROM ws GROUP BY ALL)
    SELECT o.site, o.auc AS overall_auc, s.auc AS wet_season_auc, c AS wet_season_cloud_rain_corr, 0.6::DOUBLE AS auc_threshold,
           CASE WHEN s.auc >= 0.6 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM o JOIN s ON o.site = s.site""")


PREMISE = "overall_auc wet_season_auc wet_season_cloud_rain_corr auc_threshold"


@query("evl_10_premise", premise_sql(1), PREMISE)
def evl_10(spark, d):
    return L.premise(days(spark, d), harmonics=1)


@query("evl_10_premise_three_harmonics", premise_sql(3), PREMISE)
def evl_10b(spark, d):
    return L.premise(days(spark, d))


@query("evl_11_hindcast", V.with_views(V.ENSEMBLE_SQL, V.LEVELS_SQL) + """
    , m AS (SELECT model AS site, date, quantile_cont(tmax, 0.5) AS level_pred FROM ensemble WHERE year(date) <= 2000 GROUP BY ALL)
    SELECT m.site, sqrt(avg((level_pred - level_m) ** 2)) AS rmse_m, corr(level_pred, level_m) AS corr, count(*) AS n_days
    FROM m JOIN levels l ON m.site = l.site AND m.date = l.date GROUP BY ALL""", "rmse_m corr")
def evl_11(spark, d):
    balance = V.ensemble(spark, d).select(F.col("model").alias("site"), "date", F.col("tmax").alias("level_m"))
    return L.hindcast(balance, V.levels(spark, d), 2000, ["site"])


@query("evl_11_ensemble_balance", V.with_views(V.ENSEMBLE_SQL, V.WEATHER_SQL) + """
    SELECT model, scenario, CAST(count(*) AS BIGINT) AS n FROM ensemble WHERE site = 'lake' GROUP BY ALL""")
def evl_11b(spark, d):
    run = ensemble_run(spark, d)
    return run.groupBy("model", "scenario").agg(F.count(F.lit(1)).alias("n"))


def ensemble_run(spark, d):
    normals = V.weather(spark, d).groupBy("doy").agg(
        (F.avg("outflow_m3") * 10).alias("outflow_clim"), (F.avg("outflow_m3") / 1e5).alias("inflow_clim_Mm3"))
    return L.ensemble_balance(V.ensemble(spark, d), normals.select("doy", "outflow_clim"),
                              normals.select("doy", "inflow_clim_Mm3"), "1996-01-01", 4000.0)


# boards -------------------------------------------------------------------------------------------

BOARD_SQL = """folds AS (SELECT o_orderpriority AS model, o_orderstatus AS fold, corr(o_totalprice, o_custkey) AS s2_r2,
    avg(o_totalprice) / 9973 AS s2_mae, CASE WHEN o_orderpriority <> '1-URGENT' THEN stddev_pop(o_totalprice) / 1e6 END AS drift_m,
    CASE WHEN o_orderpriority < '4' THEN corr(o_totalprice, o_orderkey) END AS s1_r2 FROM orders
    GROUP BY o_orderpriority, o_orderstatus),
  board AS (SELECT model, round_even(avg(s2_r2), 3) AS cv_vol_r2_mean, round_even(avg(s2_mae), 3) AS cv_vol_mae_mean,
    round_even(avg(drift_m), 4) AS cv_7d_drift_mean_m, round_even(avg(s1_r2), 3) AS cv_inflow_r2_mean FROM folds GROUP BY ALL)"""


def fold_scores(spark, d):
    orders = V.table(spark, d, "orders")
    model = F.col("o_orderpriority")
    return orders.groupBy(model.alias("model"), F.col("o_orderstatus").alias("fold")).agg(
        F.corr("o_totalprice", "o_custkey").alias("s2_r2"), (F.avg("o_totalprice") / 9973).alias("s2_mae"),
        F.stddev_pop("o_totalprice").alias("_sd"), F.corr("o_totalprice", "o_orderkey").alias("_c")).select(
        "model", "fold", "s2_r2", "s2_mae", F.when(F.col("model") != "1-URGENT", F.col("_sd") / 1e6).alias("drift_m"),
        F.when(F.col("model") < "4", F.col("_c")).alias("s1_r2"))


@query("evl_12_leaderboard", V.with_views(BOARD_SQL) + """
    SELECT *, coalesce(cv_vol_r2_mean, 0) - (SELECT cv_vol_r2_mean FROM board WHERE model = '3-MEDIUM') AS r2_delta,
           coalesce(cv_vol_mae_mean, 0) - (SELECT cv_vol_mae_mean FROM board WHERE model = '3-MEDIUM') AS mae_delta,
           model = (SELECT model FROM board ORDER BY CASE WHEN cv_vol_r2_mean = 0 THEN -1 ELSE cv_vol_r2_mean END DESC, model DESC LIMIT 1)
           AS is_winner FROM board""",
       "cv_vol_r2_mean cv_vol_mae_mean cv_7d_drift_mean_m cv_inflow_r2_mean r2_delta mae_delta")
def evl_12(spark, d):
    board = E.leaderboard(fold_scores(spark, d))
    best = E.winner(board).select("model").scalar()
    return E.against_baseline(board.drop("cv_vol_r2_by_fold"), "3-MEDIUM").withColumn(
        "is_winner", F.col("model") == best)


@query("evl_12_fold_matrix", V.with_views(BOARD_SQL) + """
    SELECT fold, max(s2_r2) FILTER (WHERE model = '2-HIGH') AS "2-HIGH", max(s2_r2) FILTER (WHERE model = '5-LOW') AS "5-LOW"
    FROM folds GROUP BY ALL""", "2-HIGH 5-LOW")
def evl_12b(spark, d):
    rows = fold_scores(spark, d).where(F.col("model").isin("2-HIGH", "5-LOW"))
    return E.fold_matrix(rows, ["2-HIGH", "5-LOW"])


MODELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("evl_12_fold_matrix_all_models", V.with_views(BOARD_SQL) + "SELECT fold, " + ", ".join(
    f"round(max(s2_r2) FILTER (WHERE model = '{m}'), 6) + 0.0 AS \"{m}\"" for m in MODELS) + " FROM folds GROUP BY ALL")
def evl_12c(spark, d):
    matrix = E.fold_matrix(fold_scores(spark, d), MODELS)
    return matrix.select("fold", *[F.round(F.col(f"`{m}`"), 6).alias(m) for m in MODELS])


@query("evl_12_fold_map", V.with_views(BOARD_SQL) + """
    SELECT model, fold, s2_r2 FROM folds WHERE s2_r2 IS NOT NULL""", "s2_r2")
def evl_12_map(spark, d):
    board = E.leaderboard(fold_scores(spark, d))
    return board.select("model", F.explode("cv_vol_r2_by_fold").alias("fold", "s2_r2"))


@query("evl_12_updated_entry", V.with_views(BOARD_SQL) + """
    SELECT model, CASE WHEN model = '2-HIGH' THEN 0.5 ELSE cv_vol_r2_mean END AS cv_vol_r2_mean, cv_vol_mae_mean, cv_7d_drift_mean_m,
           cv_inflow_r2_mean FROM board""", "cv_vol_r2_mean cv_vol_mae_mean cv_7d_drift_mean_m cv_inflow_r2_mean")
def evl_12_entry(spark, d):
    """One model is scored anew for volume only: the rest of its entry and all other entries stay."""
    board = E.leaderboard(fold_scores(spark, d)).drop("cv_vol_r2_by_fold")
    fresh = board.where("model = '2-HIGH'").select("model", F.lit(0.5).alias("cv_vol_r2_mean"), F.lit(None).cast("double").alias("cv_7d_drift_mean_m"))
    return E.update_entry(board, fresh)


@query("evl_12_champion_score", V.with_views(BOARD_SQL) + """
    SELECT model, coalesce(cv_vol_r2_mean, 0.25) AS cv_vol_r2_mean FROM board
    ORDER BY CASE WHEN cv_vol_r2_mean = 0 THEN -1 ELSE cv_vol_r2_mean END DESC, model DESC LIMIT 1""", "cv_vol_r2_mean")
def evl_12_champion(spark, d):
    return E.champion_score(E.leaderboard(fold_scores(spark, d)), 0.25).select("model", "cv_vol_r2_mean")


# forecast against actual -----------------------------------------------------------------------------

FORECAST_SQL = V.WEATHER_SQL + """, fc AS (SELECT site, date, row_number() OVER (PARTITION BY site, date_trunc('month', date) ORDER BY date) AS day,
    level_m + humidity_pct / 1013 AS pred_level_m, inflow_m3 / 1e6 * 1.1 AS pred_inflow_Mm3 FROM weather)"""


def forecast_days(spark, d):
    rows = V.weather(spark, d).withColumn("month", F.date_trunc("month", "date"))
    day = Window.partitionBy("site", "month").orderBy("date")
    return rows.select("site", "date", F.row_number().over(day).alias("day"), F.lit(-212.0).alias("start_level_m"),
                       (F.col("level_m") + F.col("humidity_pct") / 1013).alias("pred_level_m"),
                       (F.col("inflow_m3") / 1e6 * 1.1).alias("pred_inflow_Mm3"))


@query("evl_13_forecast_vs_actual", V.with_views(FORECAST_SQL) + """
    SELECT f.site, f.date, abs(pred_level_m - level_m) AS level_abs_error_m, abs(pred_inflow_Mm3 - inflow_m3 / 1e6) AS inflow_abs_error_Mm3,
           100 * abs(pred_inflow_Mm3 - inflow_m3 / 1e6) / abs(inflow_m3 / 1e6) AS inflow_error_pct
    FROM fc f JOIN weather w ON f.site = w.site AND f.date = w.date""", "level_abs_error_m inflow_abs_error_Mm3 inflow_error_pct")
def evl_13(spark, d):
    return E.forecast_against_actual(forecast_days(spark, d), V.weather(spark, d)).select(
        "site", "date", "level_abs_error_m", "inflow_abs_error_Mm3", "inflow_error_pct")


@query("evl_13_forecast_accuracy", V.with_views(FORECAST_SQL) + """
    SELECT f.site, avg(abs(pred_level_m - level_m)) AS mae_level_m, avg(abs(pred_inflow_Mm3 - inflow_m3 / 1e6)) AS mae_inflow_Mm3,
           count(level_m) AS n_level_days, arg_max(pred_level_m, f.date) + 212 AS pred_change_m,
           arg_max(level_m, f.date) - arg_min(level_m, f.date) AS actual_change_m
    FROM fc f JOIN weather w ON f.site = w.site AND f.date = w.date GROUP BY ALL""",
       "mae_level_m mae_inflow_Mm3 pred_change_m actual_change_m")
def evl_13b(spark, d):
    return E.forecast_accuracy(E.forecast_against_actual(forecast_days(spark, d), V.weather(spark, d)))


@query("evl_14_residuals", V.with_views(STORED_SQL) + """
    SELECT fold, site, date, stage, actual - predicted AS residual,
           CASE WHEN month(date) IN (10, 11, 12, 1, 2, 3) THEN 'winter' ELSE 'summer' END AS season
    FROM preds WHERE actual IS NOT NULL""", "residual")
def evl_14(spark, d):
    return E.residual_table(stored(spark, d))


@query("evl_15_lag_chain", V.with_views(FORECAST_SQL) + """
    SELECT site, CAST(day AS INT) AS day, date, coalesce(lag(pred_inflow_Mm3) OVER (PARTITION BY site, date_trunc('month', date) ORDER BY date), 7.0) AS input_lag1_Mm3,
           pred_inflow_Mm3 FROM fc""", "input_lag1_Mm3 pred_inflow_Mm3")
def evl_15(spark, d):
    rows = forecast_days(spark, d).withColumn("month", F.date_trunc("month", "date"))
    seed = rows.groupBy("site", "month").agg(F.lit(7e6).alias("inflow_lag1_m3"))
    return E.lag_chain(rows, seed, ("site", "month")).drop("month")
