"""Long-range jobs: temperature features, cumulative-change samples, water balance, red line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroflow import config as C
from hydroflow.config import SiteConfig
from hydroflow.functions.meteo import cloud_index, hargreaves, hargreaves_calibrated
from hydroflow.functions.scalars import level_from_volume, m3_to_Mm3, mm_over_lake_to_Mm3, wet_season
from hydroflow.operators import aggregates, fits, joins, recurrences
from hydroflow.operators.fill import interpolate_columns

SITE = ("site",)
FOLD = ("site", "fold")


def per_fold(df: DataFrame, test_years: Sequence[int], train_from: int = C.CV_TRAIN_FROM) -> DataFrame:
    """Copies of the daily rows per fold, marked as train (earlier years), test, or neither."""
    year = F.year("date")
    fold = F.explode(F.array(*[F.lit(int(y)) for y in test_years]))
    return df.withColumn("fold", fold).withColumns({
        "is_train": (year >= train_from) & (year < F.col("fold")), "is_test": year == F.col("fold")})


def temperature_features(df: DataFrame, keys: Sequence[str] = FOLD, harmonics: int = 3,
                         latitude: float = 32.82) -> DataFrame:
    """Daily features from temperature alone; every reference is fitted on ``is_train`` rows."""
    base = df.withColumn("doy", F.dayofyear("date")).withColumns({
        "dtr": F.col("temp_max_C") - F.col("temp_min_C"),
        "et0_hs": hargreaves("temp_max_C", "temp_min_C", F.col("doy").cast("double"), latitude)})
    train = base.where("is_train")
    clear = fits.fit_clear_sky(train, keys, "doy", "dtr", harmonics=harmonics)
    normal = fits.fit_harmonic(train, keys, "doy", "temp_max_C", harmonics)
    with_refs = fits.with_harmonic(
        fits.with_harmonic(base, clear, keys, "doy", "_clear", harmonics),
        normal, keys, "doy", "_normal", harmonics)
    residual = F.col("temp_max_C") - F.col("_normal")
    sigma = F.stddev_pop(F.when(F.col("is_train"), residual)).over(Window.partitionBy(*keys))
    return (with_refs.withColumn("cloud_index", cloud_index("dtr", "_clear"))
            .withColumn("_sigma", sigma)
            .withColumn("tmax_anom_z", residual / F.when(F.col("_sigma") > 1e-9, F.col("_sigma"))
                        .otherwise(F.lit(1.0)))
            .drop("_clear", "_normal", "_sigma"))


def mark_anchors(df: DataFrame, keys: Sequence[str] = FOLD, train_step: int = C.TRAIN_ANCHOR_STEP,
                 test_step: int = C.TEST_ANCHOR_STEP) -> DataFrame:
    """Mark every n-th train and test row of a fold as a forecast issue day."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)

    def every(flag: str, step: int) -> Column:
        return F.col(flag) & ((F.sum(F.col(flag).cast("int")).over(w) - 1) % step == 0)
    return df.withColumns({"train_anchor": every("is_train", train_step),
                           "test_anchor": every("is_test", test_step)})


def change_samples(df: DataFrame, keys: Sequence[str], leads: Sequence[int] = C.LEADS,
                   embargo: bool = False) -> DataFrame:
    """One row per anchor day and lead: state at the day, mean weather to come, volume change.

    The daily weather is gap-filled first and averaged over the ``lead`` rows
    after the anchor. ``embargo`` drops train samples whose target day lies in the
    test year.
    """
    weather = ("cloud_index", "dtr", "tmax_anom_z", "et0_hs")
    filled = interpolate_columns(df, keys, "date", {name: f"_{name}" for name in weather})
    w = Window.partitionBy(*keys).orderBy("date")
    options = []
    for lead in leads:
        ahead = w.rowsBetween(1, lead)
        options.append(F.struct(
            F.lit(float(lead)).alias("horizon_h"), F.lead("volume_Mm3", lead).over(w).alias("_v"),
            F.lead("date", lead).over(w).alias("target_date"),
            *[F.avg(f"_{n}").over(ahead).alias(f"mean_{n}") for n in weather]))
    named = filled.withColumns({f"_o{i}": o for i, o in enumerate(options)})
    anchors = named.where(F.col("volume_Mm3").isNotNull()
                          & (F.col("train_anchor") | F.col("test_anchor")))
    each = anchors.withColumn("_o", F.explode(F.array(*[f"_o{i}" for i in range(len(options))])))
    samples = each.where(F.col("_o._v").isNotNull()).select(
        *keys, "date", "doy", "train_anchor", "test_anchor", "season_sin", "season_cos", "level_m",
        "rainfall_30d_mm", F.col("bucket_S").alias("bucket_S_anchor"),
        F.col("bucket_Q30").alias("bucket_Q30_anchor"), "_o.horizon_h", "_o.target_date",
        *[F.col(f"_o.mean_{n}").alias(f"mean_{n}") for n in weather],
        (F.col("_o._v") - F.col("volume_Mm3")).alias("target"))
    if embargo:
        samples = samples.where(F.col("test_anchor") | (F.year("target_date") < F.col("fold")))
    return samples


def climatology_predictor(samples: DataFrame, keys: Sequence[str] = FOLD, harmonics: int = 2,
                          out: str = "pred_clim") -> DataFrame:
    """Normal of the target per fold and lead on the issue day, fitted on the train anchors."""
    by_lead = [*keys, "horizon_h"]
    fit = fits.fit_harmonic(samples.where("train_anchor"), by_lead, "doy", "target", harmonics)
    return fits.with_harmonic(samples, fit, by_lead, "doy", out, harmonics)


PAIRS = (("base", "clim"), ("temp", "clim"), ("temp", "base"), ("tempbucket", "clim"), ("tempbucket", "temp"))


def skill_scores(predictions: DataFrame, keys: Sequence[str] = (),
                 predictors: Sequence[str] = ("clim", "base", "temp", "tempbucket"),
                 pairs: Sequence[tuple[str, str]] = PAIRS,
                 headline: Sequence[int] = C.HEADLINE_LEADS) -> DataFrame:
    """1 - MSE(a)/MSE(b) by lead and season, and pooled over the headline leads (lead null).

    Both come from one aggregate with two grouping sets.
    """
    marked = predictions.withColumn("season", wet_season("date")) \
                        .withColumn("_in_headline", F.col("horizon_h").isin(*[float(h) for h in headline]))
    lead = F.col("horizon_h").cast("int").alias("lead")
    base = marked.select(*keys, lead, "season", "_in_headline", *[
        F.pow(F.col("target") - F.col(f"pred_{p}"), F.lit(2.0)).alias(f"se_{p}") for p in predictors])
    sets = [[*keys, "lead", "season"], [*keys, "season"]]
    grouped = base.groupingSets(
        [[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*keys, "lead", "season")])
    pooled = F.grouping("lead") == 1
    means = grouped.agg(
        pooled.alias("_pooled"),
        F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col("_in_headline"), F.lit(1))).alias("_nh"),
        *[F.avg(f"se_{p}").alias(f"m_{p}") for p in predictors],
        *[F.avg(F.when(F.col("_in_headline"), F.col(f"se_{p}"))).alias(f"h_{p}") for p in predictors])

    def mse(p: str) -> Column:
        return F.when(F.col("_pooled"), F.col(f"h_{p}")).otherwise(F.col(f"m_{p}"))
    return means.select(
        *keys, "lead", "season", F.when(F.col("_pooled"), F.col("_nh")).otherwise(F.col("_n")).alias("n"),
        *[F.sqrt(mse(p)).alias(f"rmse_{p}") for p in predictors],
        *[(F.lit(1.0) - F.try_divide(mse(a), mse(b))).alias(f"ss_{a}_vs_{b}") for a, b in pairs])


# premise -----------------------------------------------------------------------------------

def premise(gold: DataFrame, keys: Sequence[str] = SITE, threshold: float = 0.6,
            harmonics: int = 3) -> DataFrame:
    """Does a cloudy, cold day predict rain? AUC overall and in the wet season, with a verdict.

    The correlation is NaN where a column does not vary: a span that is the same every day has a cloud index of
    nothing but rounding, which is rounded away.
    """
    days = gold.select(*keys, "date", "temp_max_C", "temp_min_C", "rainfall_mm").withColumns({
        "doy": F.dayofyear("date"), "dtr": F.col("temp_max_C") - F.col("temp_min_C")})
    clear = fits.fit_clear_sky(days, keys, "doy", "dtr", harmonics=harmonics)
    normal = fits.fit_harmonic(days, keys, "doy", "temp_max_C", harmonics)
    scored = fits.anomaly(fits.with_harmonic(days, clear, keys, "doy", "_clear", harmonics), keys, "doy",
                          "temp_max_C", normal, harmonics=harmonics)
    cloudy = cloud_index("dtr", "_clear")
    scored = scored.withColumns({"cloud_index": cloudy, "score": cloudy - F.lit(0.5) * F.col("anomaly_z"),
                                 "wet": F.coalesce(F.col("rainfall_mm") > C.WET_DAY_MM, F.lit(False))})
    season = scored.where(wet_season("date") == "wet")
    overall = aggregates.roc_auc(scored, keys, "score", "wet").select(*keys, F.col("auc").alias("overall_auc"))
    wet = aggregates.roc_auc(season, keys, "score", "wet").select(*keys, F.col("auc").alias("wet_season_auc"))
    pairs = season.withColumn("cloud_index", F.round("cloud_index", 12)).where("cloud_index IS NOT NULL AND rainfall_mm IS NOT NULL")
    spread = F.stddev_pop("cloud_index") * F.stddev_pop("rainfall_mm")
    related = pairs.groupBy(*keys).agg(F.coalesce(
        F.try_divide(F.covar_pop("cloud_index", "rainfall_mm"), spread), F.lit(float("nan"))).alias("wet_season_cloud_rain_corr"))
    verdict = F.when(F.col("wet_season_auc") >= threshold, F.lit("PASS")).otherwise(F.lit("FAIL"))
    return (overall.join(wet, list(keys), "left").join(related, list(keys), "left")
            .withColumn("auc_threshold", F.lit(float(threshold))).withColumn("verdict", verdict))


# ensembles ------------------------------------------------------------------------------------

def ensemble_balance(ensemble: DataFrame, outflow_normals: DataFrame, inflow_normals: DataFrame,
                     anchor_date: str, anchor_volume: float, sites: tuple[str, str] = ("catchment", "lake"),
                     config: SiteConfig = SiteConfig(), strict: bool = True) -> DataFrame:
    """Daily water balance of every model and scenario from an anchor day on.

    ``ensemble`` is (date, model, scenario, site, tmin, tmax); the normals are
    (doy, outflow_clim) and (doy, inflow_clim_Mm3).
    """
    catchment, lake = sites
    paired = joins.pair_sites(ensemble, ["model", "scenario", "date"], "site", sites, ["tmax", "tmin"], strict)
    doy = F.col("doy").cast("double")
    daily = paired.withColumn("doy", F.dayofyear("date")).withColumns({
        "et0_catch_mm": hargreaves_calibrated(f"tmax_{catchment}", f"tmin_{catchment}", doy, config.latitude),
        "et0_lake_mm": hargreaves_calibrated(f"tmax_{lake}", f"tmin_{lake}", doy, config.latitude)})
    normals = inflow_normals.select("doy", "inflow_clim_Mm3").join(
        outflow_normals.select("doy", "outflow_clim"), "doy")
    balance = daily.join(normals, "doy", "left").withColumn(
        "lake_ET_Mm3", mm_over_lake_to_Mm3("et0_lake_mm")).withColumn(
        "dv_Mm3", F.col("inflow_clim_Mm3") - F.col("lake_ET_Mm3") - m3_to_Mm3("outflow_clim"))
    run = recurrences.water_balance(balance, ["model", "scenario"], "date", "dv_Mm3", anchor_date, anchor_volume)
    return run.withColumn("level_m", level_from_volume("volume_Mm3", config.volume_to_level)).select(
        "date", "model", "scenario", "dv_Mm3", "volume_Mm3", "level_m", "lake_ET_Mm3",
        "inflow_clim_Mm3", "et0_lake_mm", "et0_catch_mm")


def hindcast(balance: DataFrame, observed: DataFrame, until_year: int, keys: Sequence[str] = ()) -> DataFrame:
    """Ensemble median level against observed levels: RMSE, correlation and days."""
    past = balance.where(F.year("date") <= until_year)
    median = aggregates.ensemble_median(past, [*keys, "date"], "level_m", "level_pred")
    both = joins.matched_pairs(median, observed.select(*keys, "date", F.col("level_m").alias("level_obs")),
                               [*keys, "date"])
    return hindcast_metrics(both, keys)


def hindcast_metrics(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    error = F.col("level_pred") - F.col("level_obs")
    return pairs.groupBy(*keys).agg(
        F.sqrt(F.avg(error * error)).alias("rmse_m"), F.corr("level_pred", "level_obs").alias("corr"),
        F.count(F.lit(1)).alias("n_days"))


# red line ------------------------------------------------------------------------------------------

def redline_backtest(daily: DataFrame, keys: Sequence[str] = SITE,
                     test_years: Sequence[int] = C.REDLINE_TEST_YEARS,
                     horizons: Sequence[int] = C.REDLINE_HORIZONS,
                     from_year: int = C.RECESSION_FROM_YEAR, month: int = 6, day: int = 1) -> DataFrame:
    """Projected against actual levels after a summer anchor, each year left out of its own rates.

    One row per (site, year, horizon) with the scaled, unscaled and persistence
    errors. Years whose window or targets leave the record are skipped.
    """
    longest = max(horizons)
    years = [*keys, "test_year"]
    rates = fits.recession_rates(daily, keys, "date", "level_m", from_year, test_years)
    spans = daily.groupBy(*keys).agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    anchors = (spans.withColumn("test_year", F.explode(F.array(*[F.lit(int(y)) for y in test_years])))
               .withColumn("anchor_date", F.make_date("test_year", F.lit(month), F.lit(day)))
               .where((F.date_sub("anchor_date", C.RECESSION_OBS_DAYS) >= F.col("_a"))
                      & (F.date_add("anchor_date", longest) <= F.col("_b")))
               .select(*years, "anchor_date"))
    scaled = recurrences.observed_scale(daily, rates, anchors, keys, years, "level_m")
    kinds = F.array(F.struct(F.lit("method").alias("kind"), F.col("scale").alias("scale")),
                    F.struct(F.lit("unscaled").alias("kind"), F.lit(1.0).alias("scale")))
    both = scaled.select(*years, "anchor_date", "anchor_level", F.explode(kinds).alias("k")) \
                 .select(*years, "anchor_date", "anchor_level", "k.kind", "k.scale")
    path = recurrences.project_levels(both, rates, [*years, "kind"], longest, years)
    ends = path.where(F.col("day").isin(*horizons)).groupBy(*years, "anchor_level", "date", F.col("day").alias("horizon")) \
               .agg(*[F.max(F.when(F.col("kind") == k, F.col("level"))).alias(k) for k in ("method", "unscaled")])
    actual = ends.join(daily.select(*keys, "date", F.col("level_m").alias("actual")), [*keys, "date"])
    return actual.select(*years, "horizon", (F.col("method") - F.col("actual")).alias("err_method"),
                         (F.col("anchor_level") - F.col("actual")).alias("err_persist"),
                         (F.col("unscaled") - F.col("actual")).alias("err_unscaled"))


def redline_report(errors: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and skill of the projection per horizon."""
    def mse(name: str) -> Column:
        return F.avg(F.col(name) * F.col(name))

    def skill(other: str) -> Column:
        return F.lit(1.0) - F.try_divide(mse("err_method"), mse(other))
    return errors.groupBy(*keys, "horizon").agg(
        F.count(F.lit(1)).alias("n_years"),
        *[F.avg(F.abs(f"err_{k}")).alias(f"mae_{k}_m") for k in ("method", "persist", "unscaled")],
        F.sqrt(mse("err_method")).alias("rmse_method_m"),
        skill("err_persist").alias("skill_vs_persistence"), skill("err_unscaled").alias("skill_vs_unscaled"))
