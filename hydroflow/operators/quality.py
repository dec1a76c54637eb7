"""Quality layers over long daily tables (keys, date, metric, value).

Each layer takes and returns the same table. What it changes is appended to the
row's ``changes`` array, so the chain is one plan: the clean table and the change
log are two projections of it and no layer needs a join to find its changes.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroflow import config as C
from hydroflow.functions.scalars import first_token, lookup
from hydroflow.operators.fill import interpolate
from hydroflow.operators.windows import runs

CHANGES = "array<struct<layer:string,reason:string,original_value:double,new_value:double>>"
Layer = Callable[[DataFrame], DataFrame]


def start(df: DataFrame) -> DataFrame:
    """Give a daily table its empty change list."""
    return df.withColumn("changes", F.array().cast(CHANGES))


def _change(df: DataFrame, layer: str, new_value: Column, reason: Column) -> DataFrame:
    """Set a new value and note it where null turned to value or value to null."""
    staged = df.withColumn("_new", new_value)
    entry = F.struct(F.lit(layer).alias("layer"), reason.alias("reason"),
                     F.col("value").cast("double").alias("original_value"),
                     F.col("_new").cast("double").alias("new_value"))
    changed = F.col("value").isNull() != F.col("_new").isNull()
    return (staged
            .withColumn("changes", F.when(changed, F.array_append("changes", entry))
                        .otherwise(F.col("changes")))
            .withColumn("value", F.col("_new")).drop("_new"))


def _blank(df: DataFrame, layer: str, bad: Column, reason: Column) -> DataFrame:
    return _change(df, layer, F.when(~F.coalesce(bad, F.lit(False)), F.col("value")), reason)


def physical_bounds(bounds: Mapping[str, tuple[float, float]] = C.PHYSICAL_BOUNDS) -> Layer:
    """Blank values outside the inclusive limits of their metric."""
    low = lookup("metric", {m: float(b[0]) for m, b in bounds.items()})
    high = lookup("metric", {m: float(b[1]) for m, b in bounds.items()})
    text = lookup("metric", {m: "physical_bounds [%g, %g]" % b for m, b in bounds.items()})
    bad = (F.col("value") < low) | (F.col("value") > high)
    return lambda df: _blank(df, "physical_bounds", bad, text)


def not_negative() -> Layer:
    """Blank flows below zero."""
    return lambda df: _blank(df, "physical_bounds", F.col("value") < 0,
                             F.lit("physical_bounds [0, inf)"))


def monthly_iqr(keys: Sequence[str], multiplier: float = C.IQR_MULTIPLIER,
                skip_suffix: str | None = "_sum", decimals: int = 2) -> Layer:
    """Blank values outside the quartile fence of their calendar month.

    The month group of a daily series holds at most 31 rows a year.
    """
    def run(df: DataFrame) -> DataFrame:
        month = Window.partitionBy(*keys, "_month")
        quartiles = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).over(month)
        width = F.col("_q")[1] - F.col("_q")[0]
        fenced = (df.withColumn("_month", F.month("date")).withColumn("_q", quartiles)
                  .withColumn("_lo", F.col("_q")[0] - F.lit(multiplier) * width)
                  .withColumn("_hi", F.col("_q")[1] + F.lit(multiplier) * width))
        bad = (F.col("value") < F.col("_lo")) | (F.col("value") > F.col("_hi"))
        if skip_suffix:
            bad = bad & ~F.col("metric").endswith(skip_suffix)
        text = F.format_string(f"monthly_IQR month=%d [%.{decimals}f, %.{decimals}f]",
                               "_month", "_lo", "_hi")
        return _blank(fenced, "monthly_IQR", bad, text).drop("_month", "_q", "_lo", "_hi")
    return run


def slot_coverage(slots: DataFrame, keys: Sequence[str], ts: str, value: str,
                  slots_per_day: int = C.SLOTS_PER_DAY) -> DataFrame:
    """Share of the day's slots that carry a reading, per key and date."""
    return (slots.groupBy(*keys, F.to_date(ts).alias("date"))
            .agg((F.count(value) / F.lit(float(slots_per_day))).alias("coverage")))


def coverage(table: DataFrame, keys: Sequence[str], threshold: float = C.COVERAGE_MIN,
             strict: bool = False) -> Layer:
    """Blank a station's metrics on days with too few slots.

    Days absent from the coverage table pass. The radiation energy metric is
    left alone unless ``strict``.
    """
    def run(df: DataFrame) -> DataFrame:
        joined = df.join(table.select(*keys, "date", F.col("coverage").alias("_cov")),
                         [*keys, "date"], "left")
        covered = F.lit(False)
        for param in C.PARAM_AGGS:
            covered = covered | F.col("metric").contains(param)
        if strict:
            covered = covered | (F.col("metric") == "global_radiation_MJm2")
        text = F.format_string(f"coverage %.0f%% < {threshold * 100:.0f}%%",
                               F.col("_cov") * F.lit(100.0))
        return _blank(joined, "coverage", covered & (F.col("_cov") < threshold), text).drop("_cov")
    return run


def persistence(keys: Sequence[str], metrics: Sequence[str] | None = C.PERSISTENCE_METRICS,
                min_run: int = C.PERSISTENCE_RUN) -> Layer:
    """Blank runs of identical consecutive daily values of a stuck sensor."""
    def run(df: DataFrame) -> DataFrame:
        bad = F.col("run_length") >= min_run
        if metrics is not None:
            bad = bad & F.col("metric").isin(*metrics)
        text = F.lit(f"persistence_{min_run}_days_identical")
        return (_blank(runs(df, keys, "date", "value"), "persistence", bad, text)
                .drop("run_id", "run_length"))
    return run


def fill_gaps(keys: Sequence[str], limit: int = C.FILL_LIMIT_DAYS,
              limit_mode: str = "prefix") -> Layer:
    """Fill short gaps inside the active span and note the fills."""
    def run(df: DataFrame) -> DataFrame:
        filled = interpolate(df, keys, "date", "value", "_filled", limit, limit_mode)
        return _change(filled, "interpolated", F.col("_filled"),
                       F.lit(f"interpolated_gap<={limit}d")).drop("_filled")
    return run


def apply_layers(df: DataFrame, layers: Sequence[Layer]) -> DataFrame:
    """Run layers in order; keep their changes with the rows."""
    out = start(df)
    for layer in layers:
        out = layer(out)
    return out


def clean_table(checked: DataFrame) -> DataFrame:
    return checked.drop("changes")


def change_log(checked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per changed cell, with the layer tag cut from the reason text as well."""
    return (checked.select(*keys, "date", "metric", F.explode("changes").alias("c"))
            .select(*keys, "date", "metric", "c.original_value", "c.new_value", "c.reason",
                    "c.layer", first_token("c.reason").alias("layer_raw")))


def log_summary(checked: DataFrame) -> DataFrame:
    """Changed cells per layer and their share of all cells."""
    tagged = checked.select(F.explode(F.concat(
        F.array(F.lit("all")), F.transform("changes", lambda c: c["layer"]))).alias("layer"))
    counts = tagged.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
    cells = counts.where("layer = 'all'").select("n").scalar()
    return (counts.where("layer <> 'all'")
            .withColumn("percent", F.lit(100.0) * F.col("n") / cells))


def most_changed(checked: DataFrame, keys: Sequence[str], top: int = 8) -> DataFrame:
    """The series with the most blanked cells."""
    blanked = checked.select(*keys, "metric", F.explode("changes").alias("c")) \
                     .where(F.col("c.new_value").isNull())
    counts = blanked.groupBy(*keys, "metric").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), *keys, "metric").limit(top)
