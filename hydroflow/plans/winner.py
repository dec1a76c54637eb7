"""The winning architecture, whichever it is: final fit on all rows, week forecast, scores and their record.

An architecture is an entry of ``ARCHITECTURES``: how it is cross-validated, which models it needs with their samples
and features, and how a week is forecast from them. Jobs look the winner up by its name on the leaderboard.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydroflow import config as C
from hydroflow.config import SiteConfig
from hydroflow.functions.scalars import level_from_volume
from hydroflow.plans import evaluation as E
from hydroflow.plans import models as M
from hydroflow.session import path_is_complete, write_and_read

Models = dict[str, PipelineModel]


@dataclass(frozen=True)
class Part:
    """One model: its training rows from (frame, out-of-fold predictions), what it reads and what it predicts."""

    samples: Callable[[DataFrame, DataFrame], DataFrame]
    features: Sequence[str]
    target: str
    log_target: bool = False


@dataclass(frozen=True)
class Architecture:
    cross_validate: Callable[..., DataFrame]
    parts: dict[str, Part]
    serve: Callable[..., DataFrame]

    def fit(self, frame: DataFrame, out_of_fold: DataFrame, learner: M.Learner = M.FINAL) -> Models:
        """Every part on all rows of the record."""
        return {name: M.fit(p.samples(frame, out_of_fold), p.features, p.target, learner, p.log_target)
                for name, p in self.parts.items()}


# training rows --------------------------------------------------------------------------------

def _days(frame: DataFrame, out_of_fold: DataFrame) -> DataFrame:
    return frame


def _actual(frame: DataFrame, out_of_fold: DataFrame) -> DataFrame:
    return M.with_actual_inflow(frame)


def _stacked(frame: DataFrame, out_of_fold: DataFrame) -> DataFrame:
    """Out-of-fold inflow where there is any, else the actual."""
    oof = out_of_fold.where("stage = 'inflow'").select("site", "date", F.col("predicted").alias("_oof"))
    return frame.join(oof, ["site", "date"], "left").withColumn(
        "predicted_inflow_m3", F.coalesce("_oof", C.INFLOW_TARGET)).drop("_oof")


def _ahead(stage: str):
    return lambda frame, out_of_fold: M.direct_samples(frame, stage)


# week forecasts -------------------------------------------------------------------------------

def _week(features: DataFrame, history: DataFrame, keys: Sequence[str], days: int) -> DataFrame:
    """One row per site and coming day, numbered, with the state the forecast starts from; whole weeks only."""
    wanted = [f for f in dict.fromkeys([*C.INFLOW_DIRECT_FEATURES, *C.VOLUME_WEATHER])
              if f not in ("predicted_inflow_m3", "inflow_anchor_m3", "horizon_h")]
    present = [F.col(c).cast("double").alias(c) if c in features.columns else F.lit(None).cast("double").alias(c) for c in wanted]
    w = Window.partitionBy(*keys)
    numbered = features.select(*keys, "date", *present).withColumns({
        "day": F.row_number().over(w.orderBy("date")), "_n": F.count(F.lit(1)).over(w)})
    week = numbered.where((F.col("_n") >= days) & (F.col("day") <= days)).drop("_n")
    return week.join(M.anchor_state(history, keys), list(keys)).withColumn("horizon_h", F.col("day").cast("double"))


def _rows(steps: DataFrame, inflow: Column, config: SiteConfig, keys: Sequence[str]) -> DataFrame:
    return M.forecast_rows(steps.select(
        *keys, F.col("_volume").alias("start_volume_Mm3"), F.col("level_m_anchor").alias("start_level_m"), "day", "date",
        F.col("rainfall_mm").alias("rain_mm"), "temp_mean_C", inflow.alias("inflow_m3"), F.col("_dvol").alias("dvol")), config, keys)


def serve_direct(features: DataFrame, history: DataFrame, models: Models, config: SiteConfig = SiteConfig(),
                 keys: Sequence[str] = M.SITE, days: int = 7) -> DataFrame:
    """All days of all sites in one transform per stage: each day is predicted from the state of the anchor day."""
    week = _week(features, history, keys, days).withColumn("inflow_anchor_m3", F.col("inflow_lag1_m3"))
    if "inflow_direct" not in models:
        return _rows(M.predict(models["volume_single"], week, C.VOLUME_SINGLE_STAGE_FEATURES, "_dvol"), F.lit(None).cast("double"), config, keys)
    week = M.predict(models["inflow_direct"], week, C.INFLOW_DIRECT_FEATURES, "predicted_inflow_m3", floor=0.0)
    return _rows(M.predict(models["volume_anchor"], week, C.VOLUME_DIRECT_FEATURES, "_dvol"), F.col("predicted_inflow_m3"), config, keys)


def serve_chain(features: DataFrame, history: DataFrame, models: Models, config: SiteConfig = SiteConfig(),
                keys: Sequence[str] = M.SITE, days: int = 7, roll_change_only: bool = False) -> DataFrame:
    """Day by day: predictions become the lags and the level of the day after. One transform over all sites a day."""
    week = write_and_read(_week(features, history, keys, days), "week")
    weather = [c for c in week.columns if c in {*C.INFLOW_FEATURES, *C.VOLUME_WEATHER} and not c.startswith("inflow_lag")]
    start = ["level_m_anchor", "_volume", "inflow_lag1_m3", "inflow_lag2_m3", "dvol_lag1_anchor", "dvol_lag2_anchor"]
    coming = F.sort_array(F.collect_list(F.struct("day", "date", *weather)))
    state = week.groupBy(*keys, *start).agg(coming.alias("_ahead")).withColumns({
        "level_m": F.col("level_m_anchor"), "_now": F.col("_volume"), "volume_change_lag1_Mm3": F.col("dvol_lag1_anchor"),
        "volume_change_lag2_Mm3": F.col("dvol_lag2_anchor"),
        "_path": F.array().cast("array<struct<day:int,date:date,rainfall_mm:double,temp_mean_C:double,inflow:double,_dvol:double>>")})
    for h in range(days):
        day = F.col("_ahead")[h]
        now = state.withColumns({c: day[c] for c in weather})
        now = M.predict(models["inflow"], now, C.INFLOW_FEATURES, "predicted_inflow_m3", floor=0.0)
        now = M.predict(models["volume"], now, C.VOLUME_FEATURES, "_dvol")
        step = F.struct(day["day"].alias("day"), day["date"].alias("date"), F.col("rainfall_mm").alias("rainfall_mm"),
                        F.col("temp_mean_C").alias("temp_mean_C"), F.col("predicted_inflow_m3").alias("inflow"), F.col("_dvol").alias("_dvol"))
        moved = {"_path": F.array_append("_path", step), "inflow_lag2_m3": F.col("inflow_lag1_m3"),
                 "inflow_lag1_m3": F.col("predicted_inflow_m3"), "volume_change_lag1_Mm3": F.col("_dvol")}
        if not roll_change_only:
            volume = F.col("_now") + F.col("_dvol")
            moved |= {"volume_change_lag2_Mm3": F.col("volume_change_lag1_Mm3"), "_now": volume,
                      "level_m": level_from_volume(volume, config.volume_to_level)}
        state = now.withColumns(moved).drop(*weather, "predicted_inflow_m3", "_dvol")
    steps = state.select(*keys, "_volume", "level_m_anchor", F.explode("_path").alias("p")).select(*keys, "_volume", "level_m_anchor", "p.*")
    return _rows(steps, F.col("inflow"), config, keys)


INFLOW = Part(_days, C.INFLOW_FEATURES, C.INFLOW_TARGET)
CHAINED = {"inflow": INFLOW, "volume": Part(_actual, C.VOLUME_FEATURES, C.VOLUME_TARGET)}
ARCHITECTURES = {
    "baseline": Architecture(M.cv_baseline, {
        "inflow": INFLOW, "volume": Part(_stacked, C.VOLUME_FEATURES, C.VOLUME_TARGET, True),
        "volume_direct": Part(_ahead("volume"), C.VOLUME_DIRECT_FEATURES, "target", True)}, M.run_forecast),
    "max_chain": Architecture(M.ARCHITECTURES["max_chain"], CHAINED, serve_chain),
    "roll_one": Architecture(M.ARCHITECTURES["roll_one"], CHAINED, lambda *a, **k: serve_chain(*a, roll_change_only=True, **k)),
    "direct_anchor": Architecture(M.ARCHITECTURES["direct_anchor"], {
        "inflow_direct": Part(_ahead("inflow"), C.INFLOW_DIRECT_FEATURES, "target"),
        "volume_anchor": Part(_ahead("volume"), C.VOLUME_DIRECT_FEATURES, "target")}, serve_direct),
    "single_stage": Architecture(M.ARCHITECTURES["single_stage"], {
        "volume_single": Part(_ahead("volume"), C.VOLUME_SINGLE_STAGE_FEATURES, "target")}, serve_direct),
}


# the winner -------------------------------------------------------------------------------------

def winning_name(board: DataFrame) -> str:
    """The model with the best score on the board; an error if there is none or its architecture is not known."""
    best = E.winner(board).select("model").first()
    if best is None or best["model"] is None:
        raise LookupError("the leaderboard has no winner")
    if best["model"] not in ARCHITECTURES:
        raise ValueError(f"unknown winner {best['model']!r}, known are {sorted(ARCHITECTURES)}")
    return best["model"]


def scores(out_of_fold: DataFrame, frame: DataFrame, name: str, config: SiteConfig = SiteConfig()) -> tuple[DataFrame, DataFrame]:
    """A model's leaderboard entry and its record: fold results in one layout, means, and what it was trained on."""
    folds = E.fold_metrics(out_of_fold.withColumn("model", F.lit(name)), frame, config=config)
    fold = F.struct("fold", "n_test", F.bround("s1_r2", 3).alias("s1_r2"), F.bround(F.col("s1_mae") / C.M3_PER_MM3, 3).alias("s1_mae_Mm3"),
                    F.bround("s2_r2", 3).alias("s2_r2"), F.bround("s2_mae", 3).alias("s2_mae_Mm3"))
    record = folds.groupBy(F.col("model").alias("winner")).agg(
        F.sort_array(F.collect_list(fold)).alias("cv_results"), F.bround(F.avg("s2_r2"), 3).alias("cv_s2_mean_r2"),
        F.bround(F.avg("s2_mae"), 3).alias("cv_s2_mean_mae"), F.bround(F.avg("s1_r2"), 3).alias("cv_s1_mean_r2"))
    rows = frame.agg(F.max("date").alias("trained_through"), F.count(F.lit(1)).alias("n_rows_total"))
    return E.leaderboard(folds), record.withColumns({c: rows.select(c).scalar() for c in rows.columns})


def save_record(spark: SparkSession, record: DataFrame, path: str, number: int) -> DataFrame:
    """Write version ``number`` of the model record as JSON; fields that only the version before has are kept."""
    if number and path_is_complete(spark, f"{path}/v={number - 1}"):
        before = spark.read.json(f"{path}/v={number - 1}")
        kept = [c for c in before.columns if c not in record.columns]
        record = record.withColumns({c: before.select(c).scalar() for c in kept})
    record.coalesce(1).write.mode("overwrite").json(f"{path}/v={number}")
    return spark.read.json(f"{path}/v={number}")


def train_winner(frame: DataFrame, board: DataFrame, path: str, number: int = 0, test_years: Sequence[int] = C.CV_TEST_YEARS,
                 train_from: int = C.CV_TRAIN_FROM, cv_learner: M.Learner = M.Learner(), learner: M.Learner = M.FINAL,
                 config: SiteConfig = SiteConfig()) -> tuple[str, Models, DataFrame]:
    """Cross-validate the winner anew, fit it on all rows, save its models and its record; the refreshed board comes back.

    Other models keep their entries, and of the winner's entry what the new run does not measure.
    """
    spark, name = frame.sparkSession, winning_name(board)
    architecture = ARCHITECTURES[name]
    out_of_fold = write_and_read(architecture.cross_validate(frame, cv_learner, test_years, train_from), "out-of-fold")
    models = architecture.fit(frame, out_of_fold, learner)
    M.save_models(models, f"{path}/models/v={number}")
    entry, record = scores(out_of_fold, frame, name, config)
    save_record(spark, record.withColumn("retrained_at", F.current_date()), f"{path}/record", number)
    return name, models, E.update_entry(board, entry)


def load_winner(path: str, name: str, number: int = 0) -> Models:
    return M.load_models(f"{path}/models/v={number}", list(ARCHITECTURES[name].parts))
