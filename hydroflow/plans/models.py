"""Two-stage forecasts with MLlib: stage one rain to inflow, stage two state to volume change.

Training data stay distributed; the driver loops over folds and the seven forecast
days only, and every step is one ``transform`` over all anchors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydroflow import config as C
from hydroflow.config import SiteConfig
from hydroflow.functions.scalars import (
    clip, level_from_volume, m3_to_Mm3, signed_log1p, signed_log1p_inverse, trend)
from hydroflow.operators.joins import expand_horizons, last_values, latest_state
from hydroflow.operators.selects import complete, complete_cases, union_aligned
from hydroflow.operators.windows import running_sum
from hydroflow.plans.longrange import climatology_predictor
from hydroflow.session import write_and_read

SITE = ("site",)
IMPUTED, VECTOR, RAW = "_imp_{}", "_features", "_prediction"


@dataclass(frozen=True)
class Learner:
    """Which tree ensemble to fit and how large; the defaults are the published settings."""

    kind: str = "gbt"
    trees: int = C.GBT_TREES_CV
    params: dict = field(default_factory=lambda: dict(C.GBT_PARAMS))
    median_error: float = 0.001

    def estimator(self):
        if self.kind == "gbt":
            return GBTRegressor(maxIter=self.trees, **self.params)
        if self.kind == "forest":
            shared = {k: v for k, v in self.params.items() if k != "stepSize"}
            return RandomForestRegressor(numTrees=self.trees, **shared)
        raise ValueError(f"unknown learner {self.kind}")

    def pipeline(self, features: Sequence[str], label: str) -> Pipeline:
        """Median imputation, assembly and trees over a fixed feature list.

        The medians come from a quantile sketch of bounded size.
        """
        filled = [IMPUTED.format(f) for f in features]
        imputer = Imputer(strategy="median", inputCols=list(features), outputCols=filled,
                          relativeError=self.median_error)
        trees = self.estimator().setFeaturesCol(VECTOR).setLabelCol(label).setPredictionCol(RAW)
        return Pipeline(stages=[imputer, VectorAssembler(inputCols=filled, outputCol=VECTOR), trees])


FINAL = Learner(trees=C.GBT_TREES_FINAL)


def as_doubles(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f: F.col(f).cast("double") for f in features})


def fit(train: DataFrame, features: Sequence[str], target: str, learner: Learner,
        log_target: bool = False) -> PipelineModel:
    """Fit on complete rows; ``log_target`` fits the signed log1p of the target."""
    label = signed_log1p(target) if log_target else F.col(target)
    rows = complete_cases(train, [*features, target]).select(
        *[F.col(f).cast("double").alias(f) for f in features], label.cast("double").alias("_label"))
    # every tree reads the rows again: a written table spares it the joins and windows before them
    return learner.pipeline(features, "_label").fit(write_and_read(rows, "train"))


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str], out: str,
            floor: float | None = None, log_target: bool = False) -> DataFrame:
    """Add a prediction column; rows with nulls are imputed, as in training."""
    raw = model.transform(as_doubles(df, features))
    value: Column = F.col(RAW)
    if log_target:
        value = signed_log1p_inverse(value)
    if floor is not None:
        value = clip(value, low=floor)
    return raw.withColumn(out, value).drop(VECTOR, RAW, *[IMPUTED.format(f) for f in features])


# walk-forward folds ----------------------------------------------------------------------

def folds(test_years: Sequence[int] = C.CV_TEST_YEARS, train_from: int = C.CV_TRAIN_FROM):
    """(fold name, train condition, test condition) per held-out year."""
    year = F.year("date")
    for y in test_years:
        yield str(y), (year >= train_from) & (year < y), year == y


def tag_folds(df: DataFrame, test_years: Sequence[int] = C.CV_TEST_YEARS,
              train_from: int = C.CV_TRAIN_FROM) -> DataFrame:
    """One row per daily row and fold it is used in, with its role."""
    year = F.year("date")
    fold = F.explode(F.array(*[F.lit(int(y)) for y in test_years])).alias("fold")
    tagged = df.select("*", fold).withColumn("role", F.when(year == F.col("fold"), F.lit("test")).when(
        (year < F.col("fold")) & (year >= train_from), F.lit("train")))
    return tagged.where("role is not null")


def with_actual_inflow(df: DataFrame) -> DataFrame:
    return df.withColumn("predicted_inflow_m3", F.col(C.INFLOW_TARGET))


# architectures ------------------------------------------------------------------------------

PREDICTION = ("fold", "site", "date", "horizon_h", "stage", "actual", "predicted")


def stage_rows(df: DataFrame, fold: str, stage: str, actual: str, predicted: str,
               horizon: Column | None = None) -> DataFrame:
    horizon = F.lit(0) if horizon is None else horizon
    return df.select(F.lit(fold).alias("fold"), "site", "date", horizon.cast("int").alias("horizon_h"),
                     F.lit(stage).alias("stage"), F.col(actual).cast("double").alias("actual"),
                     F.col(predicted).alias("predicted"))


def cv_baseline(frame: DataFrame, learner: Learner, test_years: Sequence[int] = C.CV_TEST_YEARS,
                train_from: int = C.CV_TRAIN_FROM, inflow_features: Sequence[str] = C.INFLOW_FEATURES,
                volume_features: Sequence[str] = C.VOLUME_FEATURES) -> DataFrame:
    """Out-of-fold predictions of both stages; stage two sees stage-one predictions in the test year."""
    out = []
    for fold, train, test in folds(test_years, train_from):
        seen, held = frame.where(train), frame.where(test)
        first = fit(seen, inflow_features, C.INFLOW_TARGET, learner)
        second = fit(with_actual_inflow(seen), volume_features, C.VOLUME_TARGET, learner, log_target=True)
        usable = complete([*inflow_features, C.INFLOW_TARGET])
        inflow = predict(first, held, inflow_features, "_inflow", floor=0.0)
        inflow = inflow.withColumn("predicted_inflow_m3", F.when(usable, F.col("_inflow")))
        whole = complete_cases(inflow, [*volume_features, C.VOLUME_TARGET])
        volume = predict(second, whole, volume_features, "_dvol", log_target=True)
        out.append(stage_rows(inflow.where(usable), fold, "inflow", C.INFLOW_TARGET, "predicted_inflow_m3"))
        out.append(stage_rows(volume, fold, "volume", C.VOLUME_TARGET, "_dvol"))
    return union_aligned(out)


def direct_samples(frame: DataFrame, stage: str, keys: Sequence[str] = SITE,
                   within: str | None = None) -> DataFrame:
    """Training rows of the direct models: weather of day t+h, state of day t, seven per anchor."""
    w = Window.partitionBy(*keys).orderBy("date")
    if stage == "inflow":
        weather = [f for f in C.INFLOW_DIRECT_FEATURES if f not in ("inflow_anchor_m3", "horizon_h")]
        state = frame.withColumn("inflow_anchor_m3", F.col("inflow_m3"))
        future = {c: c for c in weather} | {C.INFLOW_TARGET: "target"}
        return expand_horizons(state, keys, "date", C.HORIZONS, future, ("inflow_anchor_m3",), within=within)
    state = with_actual_inflow(frame).withColumns({
        "level_m_anchor": F.col("level_m"), "dvol_lag1_anchor": F.col("volume_change_Mm3"),
        "dvol_lag2_anchor": F.lag("volume_change_Mm3", 1).over(w),
        "dvol_lag3_anchor": F.lag("volume_change_Mm3", 2).over(w),
        "outflow_lag1_m3": F.lag("outflow_m3", 1).over(w)})
    anchor = tuple(f for f in C.VOLUME_ANCHOR if f != "horizon_h")
    future = {c: c for c in C.VOLUME_WEATHER} | {C.VOLUME_TARGET: "target"}
    return expand_horizons(state, keys, "date", C.HORIZONS, future, anchor, within=within)


def cv_direct(frame: DataFrame, learner: Learner, test_years: Sequence[int] = C.CV_TEST_YEARS,
              train_from: int = C.CV_TRAIN_FROM, single_stage: bool = False) -> DataFrame:
    """Direct multi-step models, with a first stage or (``single_stage``) without.

    Targets outside the fold's own years count as missing: train rows are dropped
    for it, test rows are predicted from imputed weather.
    """
    yearly = frame.withColumn("fold_year", F.year("date"))
    features = C.VOLUME_SINGLE_STAGE_FEATURES if single_stage else C.VOLUME_DIRECT_FEATURES
    by_day = ["site", "date", "horizon_h"]
    out = []
    for fold, train, test in folds(test_years, train_from):
        in_train = train & (F.year("target_date") < int(fold))
        volume_train = direct_samples(frame, "volume").where(in_train)
        second = fit(volume_train, features, "target", learner)
        held = direct_samples(yearly, "volume", within="fold_year").where(test)
        if not single_stage:
            inflow_train = direct_samples(frame, "inflow").where(in_train)
            first = fit(inflow_train, C.INFLOW_DIRECT_FEATURES, "target", learner)
            ahead = direct_samples(yearly, "inflow", within="fold_year").where(test)
            inflow = predict(first, ahead, C.INFLOW_DIRECT_FEATURES, "_inflow", floor=0.0)
            whole = complete_cases(inflow, [*C.INFLOW_DIRECT_FEATURES, "target"])
            out.append(stage_rows(whole, fold, "inflow", "target", "_inflow", F.col("horizon_h")))
            held = held.drop("predicted_inflow_m3").join(
                inflow.select(*by_day, F.col("_inflow").alias("predicted_inflow_m3")), by_day)
        volume = predict(second, held, features, "_dvol")
        scored = volume.withColumn("target", F.when(complete([*features, "target"]), F.col("target")))
        out.append(stage_rows(scored, fold, "volume", "target", "_dvol", F.col("horizon_h")))
    return union_aligned(out)


def weeks_ahead(frame: DataFrame, features: Sequence[str], keys: Sequence[str] = SITE,
                days: int = 7) -> DataFrame:
    """Anchors that have all coming days, with those days' features as an array of structs."""
    w = Window.partitionBy(*keys).orderBy("date")
    day = F.struct("date", *[F.col(c).cast("double").alias(c) for c in dict.fromkeys(features)])
    ahead = F.collect_list(day).over(w.rowsBetween(1, days))
    state = {"inflow_lag1_m3": F.col("inflow_m3"),
             "inflow_lag2_m3": F.coalesce(F.lag("inflow_m3", 1).over(w), F.when(
                 F.lag("date", 1).over(w).isNull(), F.col("inflow_m3"))),
             "volume_change_lag1_Mm3": F.col("volume_change_Mm3"),
             "volume_change_lag2_Mm3": F.coalesce(F.lag("volume_change_Mm3", 1).over(w), F.when(
                 F.lag("date", 1).over(w).isNull(), F.col("volume_change_Mm3"))),
             "_level": F.col("level_m"), "_volume": F.col("volume_Mm3")}
    made = frame.select(*keys, "date", ahead.alias("_ahead"), *[c.alias(n) for n, c in state.items()])
    last_day = F.element_at("_ahead", -1)["date"]
    return made.where((F.size("_ahead") == days) & (last_day == F.date_add("date", days)))


def simulate_week(frame: DataFrame, first: PipelineModel, second: PipelineModel, anchors: Column,
                  roll_change_only: bool = False, config: SiteConfig = SiteConfig(),
                  keys: Sequence[str] = SITE) -> DataFrame:
    """Seven chained days per anchor: predictions replace the lags of the days after.

    ``roll_change_only`` keeps the second lag and the level at the anchor's values.
    Each day is one transform over all anchors; the loop runs over the seven days.
    """
    weather1 = [f for f in C.INFLOW_FEATURES if not f.startswith("inflow_lag")]
    own2 = ("predicted_inflow_m3", "level_m", "volume_change_lag1_Mm3", "volume_change_lag2_Mm3")
    weather2 = [f for f in C.VOLUME_FEATURES if f not in own2]
    weather = list(dict.fromkeys([*weather1, *weather2]))
    # written once: the seven days are then planned over a table, not over the feature windows
    state = write_and_read(weeks_ahead(frame, [*weather, C.VOLUME_TARGET], keys).where(anchors), "weeks") \
        .withColumn("_path", F.array().cast(
            "array<struct<horizon_h:int,predicted:double,inflow:double,actual:double>>"))
    for h in C.HORIZONS:
        day = F.col("_ahead")[h - 1]
        now = state.withColumns({f: day[f] for f in weather} | {"level_m": F.col("_level")})
        now = predict(first, now, C.INFLOW_FEATURES, "predicted_inflow_m3", floor=0.0)
        now = predict(second, now, C.VOLUME_FEATURES, "_dvol")
        step = F.struct(F.lit(h).alias("horizon_h"), F.col("_dvol").alias("predicted"),
                        F.col("predicted_inflow_m3").alias("inflow"), day[C.VOLUME_TARGET].alias("actual"))
        moved = {"_path": F.array_append("_path", step),
                 "inflow_lag2_m3": F.col("inflow_lag1_m3"), "inflow_lag1_m3": F.col("predicted_inflow_m3"),
                 "volume_change_lag1_Mm3": F.col("_dvol")}
        if not roll_change_only:
            volume = F.col("_volume") + F.col("_dvol")
            moved |= {"volume_change_lag2_Mm3": F.col("volume_change_lag1_Mm3"), "_volume": volume,
                      "_level": level_from_volume(volume, config.volume_to_level)}
        state = now.withColumns(moved).drop(*weather, "level_m", "predicted_inflow_m3", "_dvol")
    return state.select(*keys, "date", F.explode("_path").alias("p")).select(*keys, "date", "p.*")


def cv_chain(frame: DataFrame, learner: Learner, test_years: Sequence[int] = C.CV_TEST_YEARS,
             train_from: int = C.CV_TRAIN_FROM, roll_change_only: bool = False,
             config: SiteConfig = SiteConfig()) -> DataFrame:
    """Baseline models judged by chained seven-day windows from every test day."""
    out = []
    for fold, train, test in folds(test_years, train_from):
        seen = frame.where(train)
        first = fit(seen, C.INFLOW_FEATURES, C.INFLOW_TARGET, learner)
        second = fit(with_actual_inflow(seen), C.VOLUME_FEATURES, C.VOLUME_TARGET, learner)
        week = simulate_week(frame, first, second, test, roll_change_only, config)
        out.append(stage_rows(week, fold, "volume", "actual", "predicted", F.col("horizon_h")))
    return union_aligned(out)


ARCHITECTURES = {
    "baseline": cv_baseline,
    "max_chain": cv_chain,
    "direct_anchor": cv_direct,
    "single_stage": lambda *a, **k: cv_direct(*a, single_stage=True, **k),
    "roll_one": lambda *a, **k: cv_chain(*a, roll_change_only=True, **k),
}


# final models and the live forecast ------------------------------------------------------------

def fit_final(frame: DataFrame, out_of_fold: DataFrame, learner: Learner = FINAL) -> dict[str, PipelineModel]:
    """Models on all rows; stage two sees out-of-fold inflow where there is any, else the actual."""
    oof = out_of_fold.where("stage = 'inflow'").select("site", "date", F.col("predicted").alias("_oof"))
    stacked = frame.join(oof, ["site", "date"], "left").withColumn(
        "predicted_inflow_m3", F.coalesce("_oof", C.INFLOW_TARGET)).drop("_oof")
    direct = direct_samples(frame, "volume")
    return {
        "inflow": fit(frame, C.INFLOW_FEATURES, C.INFLOW_TARGET, learner),
        "volume": fit(stacked, C.VOLUME_FEATURES, C.VOLUME_TARGET, learner, log_target=True),
        "volume_direct": fit(direct, C.VOLUME_DIRECT_FEATURES, "target", learner, log_target=True),
    }


def save_models(models: dict[str, PipelineModel], path: str) -> None:
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")


def load_models(path: str, names: Sequence[str] = ("inflow", "volume", "volume_direct")) -> dict[str, PipelineModel]:
    return {name: PipelineModel.load(f"{path}/{name}") for name in names}


def split_importance(spark: SparkSession, model_path: str, features: Sequence[str]) -> DataFrame:
    """Share of the splits each feature has in a saved tree model, largest first."""
    nodes = spark.read.parquet(f"{model_path}/stages/*Regressor*/data")
    feature = F.get(F.array(*[F.lit(f) for f in features]), F.col("nodeData.split.featureIndex"))
    counts = nodes.where("nodeData.split.featureIndex >= 0").groupBy(feature.alias("feature")) \
                  .agg(F.count(F.lit(1)).alias("n_splits"))
    whole = counts.agg(F.sum("n_splits").alias("n")).scalar()
    return counts.withColumn("importance", F.col("n_splits") / whole).orderBy(F.desc("importance"), "feature")


def anchor_state(history: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Start of a forecast: last complete level and volume, last inflows, changes and outflow."""
    state = latest_state(history, keys, "date", ["level_m", "volume_Mm3"]).withColumnsRenamed(
        {"date": "state_date", "level_m": "level_m_anchor", "volume_Mm3": "_volume"})
    for value, count, name in (("inflow_m3", 2, "inflow_lag{}_m3"),
                               ("volume_change_Mm3", 3, "dvol_lag{}_anchor"),
                               ("outflow_m3", 1, "outflow_lag{}_m3")):
        state = state.join(last_values(history, keys, "date", value, count, name), list(keys), "left")
    return state


def run_forecast(features: DataFrame, history: DataFrame, models: dict[str, PipelineModel],
                 config: SiteConfig = SiteConfig(), keys: Sequence[str] = SITE, days: int = 7) -> DataFrame:
    """Seven-day forecast of all sites: chained inflow, direct volume change from the fixed anchor.

    ``features`` are the forecast days (see ``plans.gold.forecast_features``).
    """
    weather = [f for f in dict.fromkeys([*C.INFLOW_FEATURES, *C.VOLUME_WEATHER])
               if f != "predicted_inflow_m3" and not f.startswith("inflow_lag")]
    present = [F.col(c).cast("double").alias(c) if c in features.columns
               else F.lit(None).cast("double").alias(c) for c in weather]
    coming = F.sort_array(F.collect_list(F.struct("date", *present)))  # days of one forecast
    ready = features.groupBy(*keys).agg(coming.alias("_ahead")).where(F.size("_ahead") >= days) \
        .join(anchor_state(history, keys), list(keys))
    state = write_and_read(ready, "anchors") \
        .withColumn("_path", F.array().cast("array<struct<day:int,date:date,rain_mm:double,"
                                            "temp_mean_C:double,inflow_m3:double,dvol:double>>"))
    for h in range(1, days + 1):
        day = F.col("_ahead")[h - 1]
        now = state.withColumns({f: day[f] for f in weather} | {"horizon_h": F.lit(float(h))})
        now = predict(models["inflow"], now, C.INFLOW_FEATURES, "predicted_inflow_m3", floor=0.0)
        now = predict(models["volume_direct"], now, C.VOLUME_DIRECT_FEATURES, "_dvol", log_target=True)
        step = F.struct(F.lit(h).alias("day"), day["date"].alias("date"), F.col("rainfall_mm").alias("rain_mm"),
                        F.col("temp_mean_C").alias("temp_mean_C"),
                        F.col("predicted_inflow_m3").alias("inflow_m3"), F.col("_dvol").alias("dvol"))
        state = now.withColumns({
            "_path": F.array_append("_path", step), "inflow_lag2_m3": F.col("inflow_lag1_m3"),
            "inflow_lag1_m3": F.col("predicted_inflow_m3")}).drop(
            *weather, "horizon_h", "predicted_inflow_m3", "_dvol")
    steps = state.select(*keys, F.col("_volume").alias("start_volume_Mm3"),
                         F.col("level_m_anchor").alias("start_level_m"), F.explode("_path").alias("p"))
    return forecast_rows(steps.select(*keys, "start_volume_Mm3", "start_level_m", "p.*"), config, keys)


def forecast_rows(steps: DataFrame, config: SiteConfig = SiteConfig(), keys: Sequence[str] = SITE) -> DataFrame:
    """Result rows: inflow, change, running change, volume and level per forecast day."""
    summed = steps.withColumn("cum_dvol_Mm3", running_sum("dvol", keys, "date"))
    volume = F.col("start_volume_Mm3") + F.col("cum_dvol_Mm3")
    return summed.select(
        *keys, "day", "date", "rain_mm", "temp_mean_C", m3_to_Mm3("inflow_m3").alias("pred_inflow_Mm3"),
        F.col("dvol").alias("pred_dvol_Mm3"), "cum_dvol_Mm3",
        level_from_volume(volume, config.volume_to_level).alias("pred_level_m"),
        volume.alias("pred_volume_Mm3"), "start_level_m", "start_volume_Mm3")


def forecast_summary(rows: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """End of the week against its start, with the trend class."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(
        "pred_level_m", "pred_volume_Mm3", "cum_dvol_Mm3", "start_level_m"), "day").alias("e"))
    change = F.col("e.pred_level_m") - F.col("e.start_level_m")
    return last.select(*keys, F.col("e.pred_level_m").alias("end_level_m"),
                       F.col("e.pred_volume_Mm3").alias("end_volume_Mm3"),
                       F.col("e.cum_dvol_Mm3").alias("week_dvol_Mm3"),
                       change.alias("level_change_m"), trend(change).alias("trend"))


# long-range bake-off --------------------------------------------------------------------------

LONGRANGE_LISTS = {"base": C.LONGRANGE_BASE, "temp": C.LONGRANGE_TEMP, "tempbucket": C.LONGRANGE_BUCKET}


def longrange_predictions(samples: DataFrame, test_years: Sequence[int], learner: Learner) -> DataFrame:
    """Test samples with the climatology and the three nested models' predictions, fold by fold.

    ``samples`` comes from ``longrange.change_samples``, complete cases only are used.
    """
    usable = complete_cases(samples, [*C.LONGRANGE_BUCKET, "target"])
    known = write_and_read(climatology_predictor(usable), "longrange")
    out = []
    for year in test_years:
        fold = known.where(F.col("fold") == int(year))
        scored = fold.where("test_anchor")
        for name, features in LONGRANGE_LISTS.items():
            model = fit(fold.where("train_anchor"), features, "target", learner)
            scored = predict(model, scored, features, f"pred_{name}")
        out.append(scored)
    return union_aligned(out)
