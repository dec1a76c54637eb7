"""Grouped summaries: daily parameters, pivots, profiles, distributions, coverage."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroflow import config as C
from hydroflow.functions.scalars import m3s_to_m3day, slot_radiation_to_MJ
from hydroflow.operators.ranks import beside_key_table, ordered_counts, profile
from hydroflow.session import write_and_read


# readings -> days ------------------------------------------------------------

def last_reading(readings: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Last non-null value per group in source order."""
    return readings.where(F.col(value).isNotNull()) \
                   .groupBy(*keys).agg(F.max_by(value, order).alias(value))


def first_reading(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row per key in source order (map-side: no window over a hot key)."""
    rest = [c for c in df.columns if c not in keys]
    kept = F.min_by(F.struct(*rest), order).alias("_row")
    return df.groupBy(*keys).agg(kept).select(*keys, "_row.*").select(*df.columns)


def daily_parameters(readings: DataFrame, keys: Sequence[str], ts: str = "ts",
                     param: str = "param", value: str = "value",
                     aggs: Mapping[str, Sequence[str]] = C.PARAM_AGGS,
                     strict: bool = False) -> DataFrame:
    """Long readings to long daily metrics, each parameter by its own aggregates.

    An all-null rain day stays null. An all-null radiation sum is 0, and so is
    its energy, unless ``strict``.
    """
    base = (readings.where(F.col(param).isin(*aggs))
            .groupBy(*keys, F.to_date(ts).alias("date"), F.col(param).alias("_param"))
            .agg(F.avg(value).alias("mean"), F.max(value).alias("max"),
                 F.min(value).alias("min"), F.sum(value).alias("sum")))
    radiation = "global_radiation_Wm2"
    total = F.col("sum")
    if not strict:
        total = F.when(F.col("_param") == radiation, F.coalesce(total, F.lit(0.0))).otherwise(total)
    wanted = F.lit(None).cast("array<string>")
    for name, kinds in aggs.items():
        wanted = F.when(F.col("_param") == name, F.array(*map(F.lit, kinds))).otherwise(wanted)
    kinds = {"mean": F.col("mean"), "max": F.col("max"), "min": F.col("min"), "sum": total}
    parts = [F.struct(F.concat_ws("_", "_param", F.lit(k)).alias("metric"), F.lit(k).alias("kind"),
                      v.alias("value")) for k, v in kinds.items()]
    energy = F.struct(F.lit("global_radiation_MJm2").alias("metric"), F.lit("energy").alias("kind"),
                      slot_radiation_to_MJ(total).alias("value"))
    rows = F.array(*parts, energy)
    picked = F.filter(rows, lambda r: F.array_contains(wanted, r["kind"])
                      | ((r["kind"] == "energy") & (F.col("_param") == radiation)))
    return (base.select(*keys, "date", F.explode(picked).alias("m"))
            .select(*keys, "date", F.col("m.metric").alias("metric"), F.col("m.value").alias("value")))


def daily_flow(observations: DataFrame, keys: Sequence[str], ts: str, flow_m3s: str) -> DataFrame:
    """Mean flow rate of a day as a daily volume."""
    return (observations.groupBy(*keys, F.to_date(ts).alias("date"))
            .agg(m3s_to_m3day(F.avg(flow_m3s)).alias("flow_m3")))


def mean_of_duplicates(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def six_hourly_to_daily(steps: DataFrame, keys: Sequence[str], requested: DataFrame) -> DataFrame:
    """Forecast steps to the requested dates; a date without steps is all null."""
    daily = (steps.groupBy(*keys, F.to_date("ts").alias("date"))
             .agg(F.max("max_temp").alias("temp_max_C"), F.min("min_temp").alias("temp_min_C"),
                  F.sum("rain").alias("rainfall_mm"), F.avg("humidity").alias("humidity_pct"),
                  (F.avg("wind_kmh") / F.lit(C.KMH_PER_MS)).alias("wind_speed_ms")))
    return (requested.join(daily, [*keys, "date"], "left")
            .withColumn("radiation_MJm2", F.lit(None).cast("double")))


# pivots -----------------------------------------------------------------------

def pivot_wide(df: DataFrame, keys: Sequence[str], name: str, value: str,
               names: Sequence[str], drop_empty_rows: bool = True) -> DataFrame:
    """Long to wide with a given column list; rows without any value are dropped."""
    cells = df.where(F.col(value).isNotNull() & F.col(name).isin(*names)) if drop_empty_rows else df
    return cells.groupBy(*keys).pivot(name, list(names)).agg(F.first(value, ignorenulls=True))


def last_per_slot(rows: DataFrame, keys: Sequence[str], params: Sequence[str], order: str) -> DataFrame:
    """One row per key: of each parameter, number or text, the last value that is not null."""
    return rows.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in params])


def as_readings(slots: DataFrame, keys: Sequence[str], params: Sequence[str]) -> DataFrame:
    """Wide slots to long readings (keys, param, value) without nulls."""
    cells = F.filter(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).alias("value")) for p in params]),
                     lambda c: c["value"].isNotNull())
    return slots.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.param", "c.value")


def pivot_sensors(rows: DataFrame, keys: Sequence[str], by: str, params: Sequence[str], order: str) -> DataFrame:
    """One row per key with a column ``<by>_<param>`` for every pair that has a value, stations in order.

    Parameters may be numbers and texts side by side. A pass of counts finds the stations and their empty
    columns; then each key and station keeps its last values, and one pivot sets the stations beside each other.
    """
    counts = rows.groupBy(by).agg(*[F.count(p).alias(p) for p in params]).where(F.col(by).isNotNull()).collect()
    found = sorted((r[by], [p for p in params if r[p]]) for r in counts)
    found = [(name, held) for name, held in found if held]
    slots = last_per_slot(rows, [*keys, by], params, order)
    any_value = reduce(lambda a, b: a | b, [F.col(p).isNotNull() for p in params])
    cell = F.first(F.struct(*params), ignorenulls=True)
    wide = slots.where(any_value).groupBy(*keys).pivot(by, [name for name, _ in found] or [""]).agg(cell)
    return wide.select(*keys, *[F.col(f"`{name}`")[p].alias(f"{name}_{p}") for name, held in found for p in held])


def month_matrix(df: DataFrame, keys: Sequence[str], date: str, value: str) -> DataFrame:
    """Year by month matrix of means."""
    months = [F.avg(F.when(F.month(date) == m, F.col(value))).alias(f"m{m:02d}")
              for m in range(1, 13)]
    return df.groupBy(*keys, F.year(date).alias("year")).agg(*months)


def monthly_mean(df: DataFrame, keys: Sequence[str], date: str, value: str) -> DataFrame:
    month = F.trunc(F.col(date), "month").alias("month")
    return df.groupBy(*keys, month).agg(F.avg(value).alias(value))


# ensembles ----------------------------------------------------------------------

def annual(df: DataFrame, keys: Sequence[str], date: str, **aggregates: Column) -> DataFrame:
    return df.groupBy(*keys, F.year(date).alias("year")) \
             .agg(*[c.alias(name) for name, c in aggregates.items()])


def quantile_columns(value: str, shares: Mapping[str, float]) -> list[Column]:
    """Exact quantiles of a group that is small by nature (the models of a year)."""
    return [F.percentile(value, F.lit(float(s))).alias(name) for name, s in shares.items()]


def ribbon(annual_values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """10th, 50th and 90th percentile over the models of a year."""
    return annual_values.groupBy(*keys).agg(
        *quantile_columns(value, {"p10": 0.10, "p50": 0.50, "p90": 0.90}))


def ensemble_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias(out))


# profiles --------------------------------------------------------------------------

def to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str],
            name: str = "metric", value: str = "value") -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]) \
             .unpivot(list(keys), list(columns), name, value)


def null_profile(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (),
                 only_with_nulls: bool = True) -> DataFrame:
    """Percent of nulls per column (and per key, e.g. the year), in one pass."""
    shares = df.groupBy(*keys).agg(
        *[(F.lit(100.0) * F.avg(F.col(c).isNull().cast("double"))).alias(c) for c in columns])
    out = shares.unpivot(list(keys), list(columns), "metric", "null_pct")
    return out.where("null_pct > 0") if only_with_nulls else out


def fill_rates(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Percent of non-null values per column, fullest first."""
    shares = df.groupBy(*keys).agg(
        *[(F.lit(100.0) * F.avg(F.col(c).isNotNull().cast("double"))).alias(c) for c in columns])
    return shares.unpivot(list(keys), list(columns), "metric", "fill_pct") \
                 .orderBy(F.desc("fill_pct"), *keys, "metric")


def date_coverage(df: DataFrame, keys: Sequence[str], date: str, value: str) -> DataFrame:
    """First and last date of a series, days without a value and their share."""
    span = F.datediff(F.max(date), F.min(date)) + F.lit(1)
    base = df.groupBy(*keys).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"),
                                 F.count(value).alias("n_values"), span.alias("span_days"))
    missing = F.col("span_days") - F.col("n_values")
    return base.withColumn("missing_days", missing).withColumn(
        "missing_pct", F.lit(100.0) * missing / F.col("span_days"))


def column_profile(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Count, moments, extremes and exact quartiles per key, of any group size, in one reading of the rows.

    Skew and excess kurtosis are the unbiased estimators.
    """
    found = profile(long, keys, value, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    n, m2 = F.col("n").cast("double"), F.col("m2")
    g1 = F.col("m3") / F.pow(m2, F.lit(1.5))
    g2 = F.col("m4") / (m2 * m2) - 3
    skew = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    varies = m2 > 0
    return found.select(
        *keys, "n", "mean", F.when(n > 1, F.sqrt(m2 * n / (n - 1))).alias("std"), "min", "max",
        F.when(varies & (n > 2), skew).alias("skew"), F.when(varies & (n > 3), kurt).alias("kurt"), "p25", "median", "p75")


def correlation_matrix(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (),
                       min_values: int = 100) -> DataFrame:
    """Pairwise-complete Pearson r of all column pairs, in one aggregate.

    Columns with no more than ``min_values`` values are left out.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.groupBy(*keys).agg(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r"),
                 F.least(F.count(a), F.count(b)).alias("n")).alias(f"p{i}")
        for i, (a, b) in enumerate(pairs)])
    cells = F.explode(F.array(*[f"p{i}" for i in range(len(pairs))])).alias("p")
    upper = wide.select(*keys, cells).where(F.col("p.n") > min_values)
    both = F.when(F.col("p.a") == F.col("p.b"), F.array(F.struct("p.a", "p.b"))).otherwise(
        F.array(F.struct("p.a", "p.b"),
                F.struct(F.col("p.b").alias("a"), F.col("p.a").alias("b"))))
    return (upper.select(*keys, "p", F.explode(both).alias("ab"))
            .select(*keys, F.col("ab.a").alias("col_a"), F.col("ab.b").alias("col_b"),
                    F.col("p.r").alias("r")))


def pair_trend(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson r and straight trend line of a pair of columns."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"),
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


# distributions ------------------------------------------------------------------------

def histogram(long: DataFrame, keys: Sequence[str], value: str, bins: int = 40) -> DataFrame:
    """Density histogram with ``bins`` equal bins from minimum to maximum per key: one pass for the span, one for the bins."""
    present = long.select(*keys, value).where(F.col(value).isNotNull())
    span = present.groupBy(*keys).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    span = write_and_read(span.withColumn("_w", F.greatest((F.col("_hi") - F.col("_lo")) / F.lit(float(bins)),
                                                           F.lit(1e-9))), "spans")
    place = F.least(F.floor((F.col(value) - F.col("_lo")) / F.col("_w")), F.lit(bins - 1))
    counted = (beside_key_table(present, span, keys, "_n", value).withColumn("bin", place.cast("int"))
               .groupBy(*keys, "bin", "_lo", "_w", "_n").agg(F.count(F.lit(1)).alias("n")))
    return counted.select(
        *keys, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_start"), "n",
        (F.col("n") / (F.col("_n") * F.col("_w"))).alias("density"))


#: Terms of the kernel's series; with values at most half a bandwidth from their cell's centre the next is below 1e-15.
KERNEL_TERMS = 20


def density(long: DataFrame, keys: Sequence[str], value: str, points: int = 300,
            min_values: int = 5) -> DataFrame:
    """Gaussian kernel density on an even grid per key, bandwidth 1.06 sd n^-0.2.

    After one pass for the statistics, rows are summed to cells of one bandwidth: each cell keeps the sums of the
    powers of its values' distance from its centre, made where the rows are. A cell's kernel sum at a grid point is
    a Hermite series of these sums, exact to the last digits of a double, so grid points are met by cells and not
    by rows. A cell adds to points within 39 bandwidths, past which a double kernel is zero.
    """
    present = long.select(*keys, value).where(F.col(value).isNotNull())
    stats = present.groupBy(*keys).agg(
        F.count(value).alias("_n"), F.stddev_pop(value).alias("_sd"),
        F.min(value).alias("_min"), F.max(value).alias("_max")).where(F.col("_n") >= min_values)
    stats = stats.withColumn("_h", F.lit(1.06) * F.col("_sd") * F.pow("_n", F.lit(-0.2))) \
                 .where("_h > 0")
    stats = (stats.withColumn("_lo", F.col("_min") - 3 * F.col("_h"))
             .withColumn("_step", (F.col("_max") - F.col("_min") + 6 * F.col("_h"))
                         / F.lit(float(points - 1))))
    stats = write_and_read(stats.select(*keys, "_n", "_h", "_lo", "_step"), "kernels")
    place = (F.col(value) - F.col("_lo")) / F.col("_h")
    rows = beside_key_table(present, stats, keys, "_n", value).select(
        *keys, "_n", "_h", "_lo", "_step", F.floor(place).alias("_cell"), (place - F.floor(place) - 0.5).alias("_u1"))
    for p in range(2, KERNEL_TERMS):
        rows = rows.withColumn(f"_u{p}", F.col(f"_u{p // 2}") * F.col(f"_u{p - p // 2}"))
    cells = rows.groupBy(*keys, "_n", "_h", "_lo", "_step", "_cell").agg(
        F.count(F.lit(1)).cast("double").alias("_m0"), *[F.sum(f"_u{p}").alias(f"_m{p}") for p in range(1, KERNEL_TERMS)])
    centre = F.col("_lo") + (F.col("_cell") + 0.5) * F.col("_h")
    first = F.greatest(F.ceil((centre - 40 * F.col("_h") - F.col("_lo")) / F.col("_step")), F.lit(0))
    last = F.least(F.floor((centre + 40 * F.col("_h") - F.col("_lo")) / F.col("_step")), F.lit(points - 1))
    met = (cells.withColumn("point", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
           .withColumn("x", F.col("_lo") + F.col("point") * F.col("_step"))
           .withColumn("_v", (F.col("x") - centre) / F.col("_h"))
           .withColumn("_e0", F.exp(F.lit(-0.5) * F.col("_v") * F.col("_v"))).withColumn("_e1", F.col("_v") * F.col("_e0")))
    series = F.col("_m0") * F.col("_e0") + F.col("_m1") * F.col("_e1")
    for p in range(2, KERNEL_TERMS):  # Hermite functions over p!, each from the two before
        met = met.withColumn(f"_e{p}", (F.col("_v") * F.col(f"_e{p - 1}") - F.col(f"_e{p - 2}")) / F.lit(float(p)))
        series = series + F.col(f"_m{p}") * F.col(f"_e{p}")
    area = F.first("_n") * F.first("_h") * F.lit(math.sqrt(2 * math.pi))
    return met.groupBy(*keys, "point").agg(F.first("x").alias("x"), (F.sum(series) / area).alias("density"))


def box(long: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles with mean and population standard deviation, for groups of any size, in one reading of the rows."""
    found = profile(long, keys, value, {"q1": .25, "median": .5, "q3": .75})
    return found.select(*keys, "min", "max", "mean", F.sqrt("m2").alias("sd"), "q1", "median", "q3")


def top_counts(df: DataFrame, keys: Sequence[str], top: int) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), *keys).limit(top)


def error_metrics(df: DataFrame, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """n, R2 (0 when the actual values do not vary), MAE, RMSE and signed bias."""
    error = F.col(predicted) - F.col(actual)
    sums = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(error * error).alias("_mse"),
        F.var_pop(actual).alias("_var"), F.avg(F.abs(error)).alias("mae"), F.avg(error).alias("bias"))
    r2 = F.when(F.col("_var") > 0, F.lit(1.0) - F.col("_mse") / F.col("_var")).otherwise(F.lit(0.0))
    return sums.select(*keys, "n", r2.alias("r2"), "mae", F.sqrt("_mse").alias("rmse"), "bias")


def roc_auc(df: DataFrame, keys: Sequence[str], score: str, positive: str) -> DataFrame:
    """Area under the ROC curve by rank sums, ties at their mean rank, any group size.

    Null scores are dropped, a null label counts as negative, and a group of one
    class gives null.
    """
    label = F.coalesce(F.col(positive).cast("int"), F.lit(0))
    counts = ordered_counts(df, keys, score, {"_pos": label})
    rank = F.col("n_below") + (F.col("n") + 1) / F.lit(2.0)
    sums = counts.groupBy(*keys).agg(
        F.sum("_pos").cast("double").alias("n_pos"),
        F.first("n_total").cast("double").alias("n_total"),
        F.sum(F.col("_pos") * rank).alias("_ranks"))
    neg = F.col("n_total") - F.col("n_pos")
    auc = (F.col("_ranks") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * neg)
    return sums.select(*keys, F.when((F.col("n_pos") > 0) & (neg > 0), auc).alias("auc"),
                       F.col("n_pos").cast("long").alias("n_pos"), neg.cast("long").alias("n_neg"))


def seasonal_decomposition(df: DataFrame, keys: Sequence[str], date: str, value: str,
                           rows: int = 365, min_values: int = 30) -> DataFrame:
    """Centred trend over the valid rows of a daily series, and what is left."""
    half = rows // 2
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(-half, half)
    trend = F.when(F.count(value).over(w) >= min_values, F.avg(value).over(w))
    return (df.where(F.col(value).isNotNull()).withColumn("trend", trend)
            .withColumn("residual", F.col(value) - F.col("trend")))
