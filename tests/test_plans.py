"""Joins, gold features, samples, models and scores on small frames."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hydroflow import config as C
from hydroflow.config import SiteConfig
from hydroflow.operators import joins as J
from hydroflow.operators import selects
from hydroflow.plans import evaluation as E
from hydroflow.plans import gold as G
from hydroflow.plans import longrange as L
from hydroflow.plans import models as M
from hydroflow.plans import winner as W

TREES = M.Learner(trees=2)


def gold_frame(spark, start="2012-01-01", end="2015-12-31", site="a", seed=1):
    rng = np.random.default_rng(seed)
    dates = pd.date_range(start, end)
    names = {*C.INFLOW_FEATURES, *C.VOLUME_FEATURES, *C.SEQUENCE_FEATURES, "outflow_m3", "volume_Mm3", "temp_min_C",
             "rainfall_30d_mm"} - {"predicted_inflow_m3"}
    pdf = pd.DataFrame({n: rng.random(len(dates)) for n in sorted(names)})
    pdf["volume_Mm3"] = 4000 + pdf.volume_change_Mm3.cumsum()
    pdf["level_m"] = np.polyval(C.VOLUME_TO_LEVEL, pdf.volume_Mm3)
    pdf["inflow_m3"] = pdf.rainfall_mm * 1e5 + 1e4
    pdf.insert(0, "site", site)
    pdf.insert(1, "date", dates.date)
    return spark.createDataFrame(pdf).withColumn("predicted_inflow_m3", F.lit(None).cast("double"))


@pytest.fixture(scope="module")
def frame(spark):
    return gold_frame(spark).persist()


def test_duplicate_lookup_keys_raise(spark):
    spine = spark.createDataFrame([("a", 1)], "site string, d int")
    twice = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0)], "site string, d int, v double")
    with pytest.raises(Exception, match="duplicate lookup key"):
        J.lookup_join(spine, twice, ["site", "d"]).collect()


def test_years_are_ranges_that_reach_the_scan(spark, tmp_path):
    rows = [(dt.date(y, m, d),) for y in range(2009, 2016) for m, d in ((1, 1), (12, 31))] + [(None,)]
    spark.createDataFrame(rows, "date date").write.parquet(str(tmp_path / "days"))
    days = spark.read.parquet(str(tmp_path / "days"))
    got = selects.in_years(days, "date", [2012, 2010, 2011, 2014])
    assert sorted(r["date"].year for r in got.collect()) == sorted([2010, 2011, 2012, 2014] * 2)
    assert "GreaterThanOrEqual(date,2010-01-01)" in got._jdf.queryExecution().executedPlan().toString()
    assert selects.in_years(days, "date", []).count() == 0


def test_gold_is_written_by_year_and_reads_back(spark, tmp_path):
    rows = [(s, dt.date(y, 5, 1), float(y)) for s in ("a", "b", None) for y in (2012, 2013)]
    gold = spark.createDataFrame(rows, "site string, date date, v double")
    G.save_gold(gold, str(tmp_path / "gold"))
    back = spark.read.parquet(str(tmp_path / "gold"))
    assert sorted(back.select("site", "date", "v").collect(), key=str) == sorted(gold.collect(), key=str)
    assert sorted(p.name for p in (tmp_path / "gold").glob("year=*")) == ["year=2012", "year=2013"]


def test_final_fit_uses_the_published_tree_count():
    assert M.FINAL.trees == C.GBT_TREES_FINAL == 500


def test_periods_overlap(spark):
    df = spark.createDataFrame([(2030,), (2009,)], "year int")
    assert sorted(r.period for r in J.in_periods(df, "year", C.SUMMARY_PERIODS).collect()) == ["2010-2030", "2030-2050"]


def test_unequal_sites_raise(spark):
    rows = [("m", dt.date(2020, 1, 1), "x", 1.0), ("m", dt.date(2020, 1, 1), "y", 2.0), ("m", dt.date(2020, 1, 2), "x", 3.0)]
    df = spark.createDataFrame(rows, "model string, date date, site string, t double")
    with pytest.raises(Exception, match="same dates"):
        J.pair_sites(df, ["model", "date"], "site", ("x", "y"), ["t"]).collect()
    assert J.pair_sites(df, ["model", "date"], "site", ("x", "y"), ["t"], strict=False).count() == 1
    assert J.alignment_mismatches(df, ["model"], "site", ("x", "y")).first().mismatches == 1


def test_as_of_takes_the_last_valid_state(spark):
    day = dt.date(2024, 1, 1)
    states = spark.createDataFrame([("a", day, 1.0), ("a", day + dt.timedelta(days=2), None)], "site string, s date, v double")
    anchors = spark.createDataFrame([("a", day - dt.timedelta(days=1), 0), ("a", day + dt.timedelta(days=5), 1), ("a", day, 2),
                                     ("a", day, 3)], "site string, date date, id int")
    got = {r.id: r.v for r in J.as_of(anchors, states, ["site"], "date", "s", ["v"]).collect()}
    assert got == {0: None, 1: 1.0, 2: 1.0, 3: 1.0}


def test_thirty_day_window_spans_history_and_forecast(spark):
    first = dt.date(2024, 1, 1)
    hist = pd.DataFrame({"site": "a", "date": [first + dt.timedelta(days=i) for i in range(50)], "rainfall_mm": np.arange(50.0), "et0_mm": 1.0})
    fore = pd.DataFrame({"site": "a", "date": [first + dt.timedelta(days=50 + i) for i in range(7)], "temp_max_C": 20.0, "temp_min_C": 10.0,
                         "rainfall_mm": 100.0, "humidity_pct": 50.0, "wind_speed_ms": 2.0, "radiation_MJm2": 15.0})
    out = G.forecast_features(spark.createDataFrame(hist), spark.createDataFrame(fore), SiteConfig()).orderBy("date").collect()
    assert len(out) == 7 and out[0].rainfall_30d_mm == sum(range(21, 50)) + 100
    assert out[0].rainfall_lag1_mm == 49 and out[0].temp_mean_C == 15


def test_gold_columns_and_order(spark):
    dates = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(12)]
    silver = [("a", s, d, m, 10.0 + i) for i, d in enumerate(dates) if i != 5 for s in ("main", "x")
              for m in (*G.CONSENSUS.values(), "global_radiation_MJm2")]
    schema = "site string, station string, date date, metric string, value double"
    flows = [("a", s, d, 1e6 + i) for i, d in enumerate(dates) for s in ("inflow", "outflow")]
    levels = [("a", d, -210.0 - i / 100) for i, d in enumerate(dates)]
    gold = G.build_gold(
        spark.createDataFrame(silver, schema), spark.createDataFrame(flows, "site string, station string, date date, flow_m3 double"),
        spark.createDataFrame(levels, "site string, date date, level_m double"),
        spark.createDataFrame([("a", dates[0], 2.0)], "site string, date date, precip_intensity_mm_hr double"),
        SiteConfig(), (1.4718614718585357, 784.4588744576319, 103974.06926393778))
    assert tuple(gold.columns[-6:]) == C.GOLD_TARGETS and gold.columns[:2] == ["site", "date"] and "doy" not in gold.columns
    assert {*C.INFLOW_FEATURES, *C.VOLUME_FEATURES} - set(gold.columns) == {
        "rainfall_lag1_mm", "rainfall_lag2_mm", "rainfall_lag3_mm", "predicted_inflow_m3"}
    rows = gold.orderBy("date").collect()
    assert len(rows) == 12 and rows[5].temp_mean_C is None and rows[5].rainfall_7d_mm == 10 + 11 + 12 + 13 + 14
    assert rows[3].level_change_m == pytest.approx(-0.01) and rows[0].volume_Mm3 == pytest.approx(4140, abs=30)
    assert rows[11].rainfall_30d_mm == sum(10 + i for i in range(12) if i != 5)
    featured = G.add_training_lags(gold).orderBy("date").collect()
    assert featured[4].rainfall_lag3_mm == 11


def test_direct_samples(spark):
    frame = gold_frame(spark, "2013-01-01", "2013-01-30")
    rows = M.direct_samples(frame, "volume").where("date = '2013-01-10'").orderBy("horizon_h").collect()
    known = {r.date: r for r in frame.collect()}
    assert [r.horizon_h for r in rows] == list(range(1, 8))
    anchor, before = known[dt.date(2013, 1, 10)], known[dt.date(2013, 1, 9)]
    assert rows[0].outflow_lag1_m3 == before.outflow_m3 and rows[0].dvol_lag2_anchor == before.volume_change_Mm3
    assert rows[2].rainfall_mm == known[dt.date(2013, 1, 13)].rainfall_mm and rows[2].level_m_anchor == anchor.level_m
    assert rows[6].predicted_inflow_m3 == known[dt.date(2013, 1, 17)].inflow_m3
    tail = M.direct_samples(frame, "volume").where("date = '2013-01-28' and horizon_h = 5").first()
    assert tail.target is None and tail.rainfall_mm is None


def test_folds_never_train_on_the_test_year(spark, frame):
    tagged = M.tag_folds(frame, (2014, 2015), 2012)
    got = tagged.groupBy("fold", "role").agg(F.min(F.year("date")).alias("a"), F.max(F.year("date")).alias("b")).collect()
    assert {(r.fold, r.role): (r.a, r.b) for r in got} == {
        (2014, "train"): (2012, 2013), (2014, "test"): (2014, 2014), (2015, "train"): (2012, 2014), (2015, "test"): (2015, 2015)}


def test_chain_needs_seven_coming_days(spark):
    days = gold_frame(spark, "2013-01-01", "2013-01-30")
    ready = M.weeks_ahead(days, ["rainfall_mm"])
    assert ready.count() == 23 and ready.agg(F.max("date")).first()[0] == dt.date(2013, 1, 23)
    holed = days.where("date <> '2013-01-10'")
    starts = {r.date.day for r in M.weeks_ahead(holed, ["rainfall_mm"]).collect()}
    assert starts == {1, 2, *range(11, 24)}
    assert M.weeks_ahead(gold_frame(spark, "2013-01-01", "2013-01-05"), ["rainfall_mm"]).count() == 0


def test_architectures_predict_and_score(spark, frame):
    chain = M.cv_chain(frame, TREES, (2015,), 2012).persist()
    assert chain.groupBy("date").count().where("count <> 7").count() == 0
    assert {r.fold for r in chain.select("fold").distinct().collect()} == {"2015"}
    table = E.fold_metrics(chain.withColumn("model", F.lit("chain")), frame).first()
    assert table.n_test == chain.where("actual is not null").count() and table.drift_m > 0 and table.s1_r2 is None


def test_baseline_final_models_and_forecast(spark, frame, tmp_path):
    oof = M.cv_baseline(frame, TREES, (2015,), 2012).persist()
    assert {r.stage for r in oof.select("stage").distinct().collect()} == {"inflow", "volume"}
    assert oof.where("stage = 'inflow' and predicted < 0").count() == 0
    M.save_models(M.fit_final(frame, oof, TREES), str(tmp_path))
    shares = M.split_importance(spark, str(tmp_path / "inflow"), C.INFLOW_FEATURES).collect()
    ordered = [r.importance for r in shares]
    assert sum(ordered) == pytest.approx(1) and ordered == sorted(ordered, reverse=True)
    last = dt.date(2015, 12, 31)
    days = [("a", last + dt.timedelta(days=i), 20.0, 10.0, 1.0, 50.0, 2.0, 15.0) for i in range(1, 8)]
    forecast = spark.createDataFrame(days, "site string, date date, temp_max_C double, temp_min_C double, rainfall_mm double, "
                                           "humidity_pct double, wind_speed_ms double, radiation_MJm2 double")
    features = G.forecast_features(frame, forecast, SiteConfig())
    rows = M.run_forecast(features, frame, M.load_models(str(tmp_path))).orderBy("day").toPandas()
    assert rows.day.tolist() == list(range(1, 8))
    np.testing.assert_allclose(rows.cum_dvol_Mm3, rows.pred_dvol_Mm3.cumsum())
    np.testing.assert_allclose(rows.pred_level_m, np.polyval(C.VOLUME_TO_LEVEL, rows.pred_volume_Mm3))
    assert M.forecast_summary(spark.createDataFrame(rows)).first().trend in ("RISING", "FALLING", "STABLE")


def test_forest_learner(spark, frame):
    model = M.fit(frame, C.INFLOW_FEATURES, C.INFLOW_TARGET, M.Learner(kind="forest", trees=2))
    holed = frame.limit(5).withColumn("rainfall_mm", F.lit(None).cast("double"))
    assert M.predict(model, holed, C.INFLOW_FEATURES, "p").where("p is null").count() == 0


def test_drift_needs_all_horizons(spark):
    day = dt.date(2020, 1, 1)
    gold = spark.createDataFrame([("a", day, 4000.0, -210.0), ("a", day + dt.timedelta(days=7), 4010.0, -209.9)],
                                 "site string, date date, volume_Mm3 double, level_m double")
    preds = [("a", day, h, 1.0) for h in range(1, 8)]
    schema = "site string, date date, horizon_h int, pred_dvol double"
    drift = E.week_drift(spark.createDataFrame(preds, schema), gold).first().drift_m
    assert drift == pytest.approx(abs(np.polyval(C.VOLUME_TO_LEVEL, 4007) + 209.9))
    assert E.week_drift(spark.createDataFrame(preds[:6], schema), gold).count() == 0


def test_leaderboard_and_winner(spark):
    rows = [("base", "2021", 0.7, 0.6, 0.9, 0.02), ("base", "2022", 0.9, 0.4, None, 0.04), ("x", "2021", 0.0, 0.1, None, None)]
    folds = spark.createDataFrame(rows, "model string, fold string, s2_r2 double, s2_mae double, s1_r2 double, drift_m double")
    board = E.leaderboard(folds)
    base = board.where("model = 'base'").first()
    assert (base.cv_vol_r2_mean, base.cv_vol_mae_mean, base.cv_inflow_r2_mean, base.cv_7d_drift_mean_m) == (0.8, 0.5, 0.9, 0.03)
    assert base.cv_vol_r2_by_fold == {"2021": 0.7, "2022": 0.9}
    assert E.winner(board).first().model == "base"
    negative = board.where("model = 'x'").unionByName(board.where("model = 'base'").withColumn("cv_vol_r2_mean", F.lit(-0.5)))
    assert E.winner(negative).first().model == "base"  # a score of exactly zero counts as -1
    fresh = board.where("model = 'x'").withColumn("cv_vol_r2_mean", F.lit(0.95))
    refreshed = {r.model: r.cv_vol_r2_mean for r in E.refresh_entry(board, fresh).collect()}
    assert refreshed == {"base": 0.8, "x": 0.95}
    assert E.champion_score(board.withColumn("cv_vol_r2_mean", F.lit(None).cast("double")), 0.76).first().cv_vol_r2_mean == 0.76


def test_skill_pools_the_headline_leads(spark):
    rows = [(dt.date(2021, 1, 1), float(h), 10.0, 12.0, 11.0) for h in C.LEADS] + [(dt.date(2021, 7, 1), 7.0, 1.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "date date, horizon_h double, target double, pred_clim double, pred_base double")
    out = {(r.season, r.lead): r for r in L.skill_scores(df, (), ("clim", "base"), (("base", "clim"),)).collect()}
    assert out[("wet", None)].n == 3 and out[("wet", None)].ss_base_vs_clim == pytest.approx(0.75)
    assert out[("wet", 7)].n == 1 and out[("dry", 7)].ss_base_vs_clim is None


def test_premise_passes_on_cloudy_rain(spark):
    rng = np.random.default_rng(3)
    dates = pd.date_range("2013-01-01", "2015-12-31")
    wet = rng.random(len(dates)) < 0.3
    span = np.where(wet, 4, 12) + rng.normal(0, 0.5, len(dates))
    tmax = 25 + 8 * np.sin(2 * np.pi * dates.dayofyear / 365) - 3 * wet
    pdf = pd.DataFrame({"site": "a", "date": dates.date, "temp_max_C": tmax, "temp_min_C": tmax - span,
                        "rainfall_mm": np.where(wet, 6.0, 0.0)})
    gold = spark.createDataFrame(pdf).withColumn(
        "temp_max_C", F.when(~F.col("date").isin(dt.date(2013, 1, 5), dt.date(2014, 1, 9)), F.col("temp_max_C")))
    row = L.premise(gold).first()
    assert row.verdict == "PASS" and row.wet_season_auc > 0.9 and 0 < row.wet_season_cloud_rain_corr <= 1


def test_premise_of_a_span_that_never_varies(spark):
    dates = pd.date_range("2013-01-01", "2014-12-31")
    rain = np.arange(len(dates)) % 7.0
    pdf = pd.concat([pd.DataFrame({"site": site, "date": dates.date, "temp_max_C": 50.0, "temp_min_C": 1.0 + np.arange(len(dates)) % k,
                                   "rainfall_mm": rain}) for site, k in (("same", 1), ("varied", 7))])
    for harmonics in (1, 3):
        rows = {r.site: r.wet_season_cloud_rain_corr for r in L.premise(spark.createDataFrame(pdf), harmonics=harmonics).collect()}
        assert np.isnan(rows["same"]) and rows["varied"] > 0.5
        dry = spark.createDataFrame(pdf).withColumn("rainfall_mm", F.lit(0.0))
        assert all(np.isnan(r.wet_season_cloud_rain_corr) for r in L.premise(dry, harmonics=harmonics).collect())


def test_embargo_drops_targets_in_the_test_year(spark, frame):
    ready = L.per_fold(frame.withColumns({"bucket_S": F.lit(1.0), "bucket_Q30": F.lit(0.0)}), (2015,), 2012)
    marked = L.mark_anchors(L.temperature_features(ready))
    late = F.year("target_date") >= 2015
    leaky = L.change_samples(marked, L.FOLD).where("train_anchor")
    assert leaky.where(late).count() > 0
    assert L.change_samples(marked, L.FOLD, embargo=True).where("train_anchor").where(late).count() == 0
    first = leaky.where("horizon_h = 7").orderBy("date").limit(2).collect()
    assert (first[1].date - first[0].date).days == 2


def test_every_kth_and_scenarios(spark, frame):
    assert selects.every_kth(frame.where("date < '2012-02-01'"), ["site"], "date", 7).count() == 5
    days = frame.limit(2).withColumn("temp_max_C", F.lit(20.0))
    out = selects.what_if(days, (("dry", 0.5, 2.0), ("same", 1.0, 0.0)))
    assert out.count() == 4 and out.where("scenario = 'dry'").first().temp_max_C == 22


def test_ensemble_balance_keeps_the_anchor_volume(spark):
    rows = [(dt.date(2006, 1, 1) + dt.timedelta(days=i), "m", "rcp", s, 8.0, 18.0) for i in range(30) for s in ("catchment", "lake")]
    ensemble = spark.createDataFrame(rows, "date date, model string, scenario string, site string, tmin double, tmax double")
    normals = spark.range(1, 367).select(F.col("id").cast("int").alias("doy"), F.lit(1e6).alias("outflow_clim"), F.lit(1.5).alias("inflow_clim_Mm3"))
    out = L.ensemble_balance(ensemble, normals, normals, "2006-01-03", 4000.0).orderBy("date").toPandas()
    assert out.volume_Mm3[:2].isna().all() and out.volume_Mm3[2] == 4000
    np.testing.assert_allclose(out.volume_Mm3[3:].diff().dropna(), out.dv_Mm3[4:])
    np.testing.assert_allclose(out.lake_ET_Mm3, out.et0_lake_mm * 0.166)


# the winner, whichever it is ---------------------------------------------------------------------

BOARD = "model string, cv_vol_r2_mean double, cv_vol_r2_by_fold map<string,double>, cv_vol_mae_mean double, cv_7d_drift_mean_m double, cv_inflow_r2_mean double"


def board_of(spark, **scores):
    return spark.createDataFrame([(m, s, {"2014": s}, 0.5, 0.02, 0.7) for m, s in scores.items()], BOARD)


def test_winner_must_be_there_and_known(spark, frame, tmp_path):
    with pytest.raises(ValueError, match="unknown_model"):
        W.train_winner(frame, board_of(spark, unknown_model=0.9, baseline=0.1), str(tmp_path))
    with pytest.raises(LookupError, match="no winner"):
        W.train_winner(frame, board_of(spark, baseline=0.9).limit(0), str(tmp_path))


@pytest.mark.parametrize("name", ["baseline", "direct_anchor", "single_stage", "max_chain"])
def test_any_winner_is_fitted_saved_served_and_recorded(spark, frame, tmp_path, name):
    board = board_of(spark, **{name: 0.99, "other": 0.1})
    won, models, fresh = W.train_winner(frame, board, str(tmp_path), 0, (2015,), 2012, TREES, TREES)
    assert won == name and models.keys() == W.ARCHITECTURES[name].parts.keys()
    new = {r.model: r for r in fresh.collect()}
    assert new["other"] == {r.model: r for r in board.collect()}["other"]
    assert new[name].cv_vol_r2_mean != 0.99 and set(new[name].cv_vol_r2_by_fold) == {"2015"}
    assert new[name].cv_7d_drift_mean_m is not None
    assert (new[name].cv_inflow_r2_mean == 0.7) == (name in ("single_stage", "max_chain"))  # kept where it is not measured
    record = spark.read.json(str(tmp_path / "record/v=0")).first()
    assert (record.winner, str(record.trained_through), record.n_rows_total) == (name, "2015-12-31", frame.count())
    fold = record.cv_results[0].asDict()
    assert fold["fold"] == "2015" and fold["s2_mae_Mm3"] > 0 and fold["n_test"] > 0
    assert (fold.get("s1_mae_Mm3") is not None) == (name in ("baseline", "direct_anchor"))
    last = dt.date(2015, 12, 31)
    days = [("a", last + dt.timedelta(days=i), 20.0, 10.0, 1.0, 50.0, 2.0, 15.0) for i in range(1, 8)]
    forecast = spark.createDataFrame(days, "site string, date date, temp_max_C double, temp_min_C double, rainfall_mm double, "
                                           "humidity_pct double, wind_speed_ms double, radiation_MJm2 double")
    features = G.forecast_features(frame, forecast, SiteConfig())
    served = W.ARCHITECTURES[name].serve(features, frame, W.load_winner(str(tmp_path), name))
    rows = served.orderBy("day").toPandas()
    assert rows.day.tolist() == list(range(1, 8)) and rows.pred_level_m.notna().all()
    np.testing.assert_allclose(rows.cum_dvol_Mm3, rows.pred_dvol_Mm3.cumsum())
    assert rows.pred_inflow_Mm3.isna().all() == (name == "single_stage")
    assert W.ARCHITECTURES[name].serve(features.limit(6), frame, models).count() == 0  # a week has seven days


def test_a_record_keeps_what_only_the_one_before_says(spark, tmp_path):
    path = str(tmp_path / "record")
    W.save_record(spark, spark.createDataFrame([("x", 0.1, "[1, 2]")], "winner string, cv_s2_mean_r2 double, curve string"), path, 0)
    W.save_record(spark, spark.createDataFrame([("y", 0.8)], "winner string, cv_s2_mean_r2 double"), path, 1)
    assert spark.read.json(f"{path}/v=1").first().asDict() == {"winner": "y", "cv_s2_mean_r2": 0.8, "curve": "[1, 2]"}


def test_stage_one_error_is_in_the_fold_table(spark, frame):
    rows = spark.createDataFrame([("m", "f", "a", dt.date(2014, 1, i), 0, "inflow", 10.0, 10.0 + i) for i in (1, 2, 3)],
                                 "model string, fold string, site string, date date, horizon_h int, stage string, actual double, predicted double")
    assert E.fold_metrics(rows, frame).first().s1_mae == 2.0
