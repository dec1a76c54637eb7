"""Scores of forecasts: drift, leaderboard, ablation, forecast against actual, residuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroflow.config import SiteConfig
from hydroflow.functions.scalars import level_from_volume, season
from hydroflow.operators.aggregates import error_metrics
from hydroflow.operators.joins import replace_rows
from hydroflow.operators.selects import arg_max


def week_drift(predictions: DataFrame, gold: DataFrame, keys: Sequence[str] = ("site",),
               groups: Sequence[str] = (), config: SiteConfig = SiteConfig(), days: int = 7) -> DataFrame:
    """Absolute level error after the week, per anchor with all horizons.

    ``predictions`` is (groups, keys, date, horizon_h, pred_dvol).
    """
    weeks = predictions.groupBy(*groups, *keys, "date").agg(
        F.sum("pred_dvol").alias("_dvol"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= days)
    start = gold.select(*keys, "date", F.col("volume_Mm3").alias("_v0"))
    end = gold.select(*keys, F.date_sub("date", days).alias("date"), F.col("level_m").alias("_actual"))
    both = weeks.join(start, [*keys, "date"]).join(end, [*keys, "date"]) \
                .where(F.col("_v0").isNotNull() & F.col("_actual").isNotNull())
    level = level_from_volume(F.col("_v0") + F.col("_dvol"), config.volume_to_level)
    return both.select(*groups, *keys, "date", F.abs(level - F.col("_actual")).alias("drift_m"))


def fold_metrics(predictions: DataFrame, gold: DataFrame, models: Sequence[str] = ("model",),
                 config: SiteConfig = SiteConfig()) -> DataFrame:
    """Per model and fold: R2 and MAE of both stages, weekly drift where there are horizons."""
    keys = [*models, "fold"]
    scores = error_metrics(predictions, [*keys, "stage"], "actual", "predicted")
    def of(stage: str, column: str) -> Column:
        return F.max(F.when(F.col("stage") == stage, F.col(column)))
    table = scores.groupBy(*keys).agg(of("volume", "n").alias("n_test"), of("inflow", "r2").alias("s1_r2"),
                                      of("inflow", "mae").alias("s1_mae"),
                                      of("volume", "r2").alias("s2_r2"), of("volume", "mae").alias("s2_mae"))
    ahead = predictions.where("stage = 'volume' and horizon_h > 0").withColumnRenamed("predicted", "pred_dvol")
    drift = week_drift(ahead, gold, groups=keys, config=config).groupBy(*keys).agg(
        F.avg("drift_m").alias("drift_m"))
    return table.join(drift, keys, "left")


def leaderboard(folds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean scores per model over its folds, rounded, with the folds' R2 as a map."""
    by_fold = F.map_from_entries(F.sort_array(F.collect_list(F.struct("fold", "s2_r2"))))
    return folds.groupBy(*keys, "model").agg(
        F.bround(F.avg("s2_r2"), 3).alias("cv_vol_r2_mean"), by_fold.alias("cv_vol_r2_by_fold"),
        F.bround(F.avg("s2_mae"), 3).alias("cv_vol_mae_mean"),
        F.bround(F.avg("drift_m"), 4).alias("cv_7d_drift_mean_m"),
        F.bround(F.avg("s1_r2"), 3).alias("cv_inflow_r2_mean"))


def winner(board: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return arg_max(board, keys, "model", "cv_vol_r2_mean")


def against_baseline(board: DataFrame, baseline: str, keys: Sequence[str] = ()) -> DataFrame:
    """Score differences of every model to the baseline; a missing score counts as zero."""
    scores = {"r2_delta": "cv_vol_r2_mean", "mae_delta": "cv_vol_mae_mean"}
    base = board.where(F.col("model") == baseline).select(
        *keys, *[F.coalesce(c, F.lit(0.0)).alias(f"_{n}") for n, c in scores.items()])
    if keys:
        joined = board.join(base, list(keys), "left")
        reference = {n: F.coalesce(f"_{n}", F.lit(0.0)) for n in scores}
    else:
        joined = board
        reference = {n: F.coalesce(base.select(f"_{n}").scalar(), F.lit(0.0)) for n in scores}
    return joined.withColumns({n: F.coalesce(c, F.lit(0.0)) - reference[n] for n, c in scores.items()}) \
                 .drop(*[f"_{n}" for n in scores])


def refresh_entry(board: DataFrame, fresh: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Replace the retrained model's entry only."""
    return replace_rows(board, fresh, [*keys, "model"])


def update_entry(board: DataFrame, fresh: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Fresh scores over a model's entry; what they leave empty stays, and other entries are not touched."""
    by = [*keys, "model"]
    both = board.join(fresh.select(*by, F.struct("*").alias("_fresh")), by, "full")
    return both.select(*by, *[F.coalesce(F.col("_fresh")[c], c).alias(c) if c in fresh.columns else F.col(c)
                              for c in board.columns if c not in by])


def fold_matrix(folds: DataFrame, models: Sequence[str]) -> DataFrame:
    """Year by model table of fold R2."""
    return folds.groupBy("fold").pivot("model", list(models)).agg(F.max("s2_r2"))


def champion_score(board: DataFrame, fallback: float, keys: Sequence[str] = ()) -> DataFrame:
    return winner(board, keys).withColumn("cv_vol_r2_mean", F.coalesce("cv_vol_r2_mean", F.lit(float(fallback))))


def ablation(predictions: DataFrame, wet_fold: str, dry_fold: str, keys: Sequence[str] = ("variant",)) -> DataFrame:
    """Signed-residual gap between a wet and a dry fold per feature variant."""
    volume = predictions.where("stage = 'volume'")
    folds = error_metrics(volume, [*keys, "fold"], "actual", "predicted")
    def bias(fold: str) -> Column:
        return F.max(F.when(F.col("fold") == fold, F.bround("bias", 4)))
    table = folds.groupBy(*keys).agg(
        F.bround(F.avg(F.bround("r2", 3)), 3).alias("mean_r2"),
        bias(wet_fold).alias("resid_wet"), bias(dry_fold).alias("resid_dry"))
    gap = F.bround(F.col("resid_wet") - F.col("resid_dry"), 4)
    return table.withColumn("fold_gap", gap).withColumn("abs_gap", F.abs(gap))


def ablation_verdict(table: DataFrame, base: str, changed: str) -> DataFrame:
    """PASS when the changed variant narrows the gap of the base variant."""
    def of(variant: str, column: str) -> Column:
        return F.max(F.when(F.col("variant") == variant, F.col(column)))
    gaps = table.agg(of(base, "abs_gap").alias("gap_base"), of(changed, "abs_gap").alias("gap_changed"),
                     F.bround(of(changed, "mean_r2") - of(base, "mean_r2"), 3).alias("mean_r2_change"))
    return gaps.withColumn("verdict", F.when(F.col("gap_changed") < F.col("gap_base"), F.lit("PASS"))
                           .otherwise(F.lit("FAIL")))


def forecast_against_actual(rows: DataFrame, actual: DataFrame, keys: Sequence[str] = ("site",)) -> DataFrame:
    """Forecast days next to what happened, with absolute level and percent inflow errors."""
    seen = actual.select(*keys, "date", F.col("level_m").alias("actual_level_m"),
                         (F.col("inflow_m3") / 1e6).alias("actual_inflow_Mm3"))
    off = F.abs(F.col("pred_inflow_Mm3") - F.col("actual_inflow_Mm3"))
    return rows.join(seen, [*keys, "date"], "left").withColumns({
        "level_abs_error_m": F.abs(F.col("pred_level_m") - F.col("actual_level_m")), "inflow_abs_error_Mm3": off,
        "inflow_error_pct": F.lit(100.0) * F.try_divide(off, F.abs("actual_inflow_Mm3"))})


def forecast_accuracy(compared: DataFrame, keys: Sequence[str] = ("site",)) -> DataFrame:
    """MAE over the days with actual values, predicted and actual change of the week."""
    known = F.col("actual_level_m").isNotNull()
    first = F.min_by("actual_level_m", F.when(known, F.col("date")))
    last = F.max_by("actual_level_m", F.when(known, F.col("date")))
    return compared.groupBy(*keys).agg(
        F.avg("level_abs_error_m").alias("mae_level_m"), F.avg("inflow_abs_error_Mm3").alias("mae_inflow_Mm3"),
        F.count("actual_level_m").alias("n_level_days"),
        (F.max_by("pred_level_m", "date") - F.min("start_level_m")).alias("pred_change_m"),
        F.when(F.count("actual_level_m") >= 2, last - first).alias("actual_change_m"))


def residual_table(predictions: DataFrame) -> DataFrame:
    """Actual minus predicted with its season, over stored predictions."""
    return predictions.where(F.col("actual").isNotNull()).select(
        "fold", "site", "date", "stage", (F.col("actual") - F.col("predicted")).alias("residual"),
        season("date").alias("season"))


def lag_chain(rows: DataFrame, seed: DataFrame, keys: Sequence[str] = ("site",)) -> DataFrame:
    """The inflow lag each forecast day was fed: the day before's prediction, first the last observed.

    ``seed`` is (keys, inflow_lag1_m3).
    """
    w = Window.partitionBy(*keys).orderBy("day")
    return rows.join(seed.select(*keys, "inflow_lag1_m3"), list(keys)).select(
        *keys, "day", "date", F.coalesce(F.lag("pred_inflow_Mm3").over(w), F.col("inflow_lag1_m3") / 1e6)
        .alias("input_lag1_Mm3"), "pred_inflow_Mm3")
