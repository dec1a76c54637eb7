"""Daily spine, interpolation and station consensus."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_spine(df: DataFrame, keys: Sequence[str], date: str = "date",
                start=None, end=None) -> DataFrame:
    """One row per key and day from the first to the last date, with the day of year.

    ``start`` and ``end`` (dates as text) replace the first and last date found.
    """
    first = F.lit(start).cast("date") if start else F.min(date)
    last = F.lit(end).cast("date") if end else F.max(date)
    spans = df.groupBy(*keys).agg(first.alias("_first"), last.alias("_last"))
    days = F.explode(F.sequence("_first", "_last", F.expr("interval 1 day")))
    return (spans.where(F.col("_first") <= F.col("_last"))
            .select(*keys, days.alias(date)).withColumn("doy", F.dayofyear(date)))


def densify(df: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Add the days missing between the rows of a daily series as rows of nulls.

    Each row spreads over the days up to the next row, so the series is read once
    and no spine is joined; the windows that follow reuse its partitioning.
    """
    following = F.lead(date).over(Window.partitionBy(*keys).orderBy(date))
    until = F.greatest(F.date_sub(following, 1), F.col(date))
    spread = df.withColumn("_until", until).withColumn(
        "_day", F.explode(F.sequence(date, "_until", F.expr("interval 1 day"))))
    own = F.col("_day") == F.col(date)
    rest = [c for c in df.columns if c not in keys and c != date]
    return spread.select(*keys, F.col("_day").alias(date),
                         *[F.when(own, F.col(c)).alias(c) for c in rest])


def on_spine(df: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """The series on its dense daily spine, with the day of year."""
    return densify(df, keys, date).withColumn("doy", F.dayofyear(date))


def interpolate(df: DataFrame, keys: Sequence[str], date: str, value: str, out: str | None = None,
                limit: int | None = 3, limit_mode: str = "prefix") -> DataFrame:
    """Time-weighted linear interpolation between the first and last value of a series.

    ``prefix`` fills the first ``limit`` rows of every gap, ``whole_gap`` only
    gaps of at most ``limit`` rows; ``limit=None`` fills every inner gap.
    """
    if limit_mode not in ("prefix", "whole_gap"):
        raise ValueError(f"unknown limit_mode {limit_mode}")
    forward = Window.partitionBy(*keys).orderBy(date)
    backward = Window.partitionBy(*keys).orderBy(F.col(date).desc())
    rows_so_far = (Window.unboundedPreceding, 0)
    numbered = df.withColumn("_row", F.row_number().over(forward))
    here = F.when(F.col(value).isNotNull(),
                  F.struct(F.col(value).alias("v"), F.col(date).alias("d"), F.col("_row").alias("r")))
    # the next value is the last one seen when reading backwards: both frames grow row by row
    framed = (numbered
              .withColumn("_prev", F.last(here, True).over(forward.rowsBetween(*rows_so_far)))
              .withColumn("_next", F.last(here, True).over(backward.rowsBetween(*rows_so_far))))
    prev, nxt = F.col("_prev"), F.col("_next")
    line = prev["v"] + (nxt["v"] - prev["v"]) * F.try_divide(
        F.datediff(date, prev["d"]).cast("double"), F.datediff(nxt["d"], prev["d"]).cast("double"))
    allowed = F.lit(True)
    if limit is not None and limit_mode == "prefix":
        allowed = F.col("_row") - prev["r"] <= limit
    elif limit is not None:
        allowed = nxt["r"] - prev["r"] - 1 <= limit
    filled = F.coalesce(F.col(value), F.when(allowed, line))
    return framed.withColumn(out or value, filled).drop("_row", "_prev", "_next")


def interpolate_rows(df: DataFrame, keys: Sequence[str], order: str, value: str,
                     out: str | None = None, edges: str = "both") -> DataFrame:
    """Linear interpolation of one column by row position, see ``interpolate_columns``."""
    return interpolate_columns(df, keys, order, {value: out or value}, edges)


def interpolate_columns(df: DataFrame, keys: Sequence[str], order: str, columns: Mapping[str, str],
                        edges: str = "both") -> DataFrame:
    """Linear interpolation by row position of several columns (input to output name).

    ``edges="both"`` extends the outer values and sets an empty series to 0;
    ``edges="forward"`` extends the last value only and leaves leading nulls. All
    columns share one pass forward and one backward.
    """
    forward = Window.partitionBy(*keys).orderBy(order)
    backward = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    rows_so_far = (Window.unboundedPreceding, 0)

    def here(value: str) -> Column:
        return F.when(F.col(value).isNotNull(),
                      F.struct(F.col(value).alias("v"), F.col("_row").alias("r")))

    numbered = df.withColumn("_row", F.row_number().over(forward))
    framed = numbered.withColumns({
        f"_prev_{v}": F.last(here(v), True).over(forward.rowsBetween(*rows_so_far)) for v in columns})
    framed = framed.withColumns({
        f"_next_{v}": F.last(here(v), True).over(backward.rowsBetween(*rows_so_far)) for v in columns})

    def filled(value: str) -> Column:
        prev, nxt = F.col(f"_prev_{value}"), F.col(f"_next_{value}")
        line = prev["v"] + (nxt["v"] - prev["v"]) * F.try_divide(
            (F.col("_row") - prev["r"]).cast("double"), (nxt["r"] - prev["r"]).cast("double"))
        outer = [nxt["v"], F.lit(0.0)] if edges == "both" else []
        return F.coalesce(F.col(value), line, prev["v"], *outer)

    helpers = [f"_{side}_{v}" for side in ("prev", "next") for v in columns]
    return framed.withColumns({o: filled(v) for v, o in columns.items()}).drop("_row", *helpers)


def resample_daily(df: DataFrame, keys: Sequence[str], date: str, value: str) -> DataFrame:
    """Daily mean of a sparse series on a dense spine, inner gaps interpolated."""
    daily = df.groupBy(*keys, date).agg(F.avg(value).alias(value))
    return interpolate(on_spine(daily, keys, date), keys, date, value, limit=None)


def fill_constant(df: DataFrame, value: str, constant: float = 0.0, out: str | None = None) -> DataFrame:
    return df.withColumn(out or value, F.coalesce(F.col(value), F.lit(constant)))


def fill_median(df: DataFrame, keys: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    """Nulls take the median of their daily series (a calendar-bounded group)."""
    middle = F.percentile(F.col(value), F.lit(0.5)).over(Window.partitionBy(*keys))
    return df.withColumn(out or value, F.coalesce(F.col(value), middle))


def active_span(df: DataFrame, keys: Sequence[str], date: str, value: str) -> DataFrame:
    """First and last date with a value per series."""
    dated = F.when(F.col(value).isNotNull(), F.col(date))
    return df.groupBy(*keys).agg(F.min(dated).alias("first_valid"), F.max(dated).alias("last_valid"))


def consensus(df: DataFrame, keys: Sequence[str], station: str, value: str,
              priority: str, out: str = "value") -> DataFrame:
    """Value of the priority station, else the mean of the others, per ``keys`` group."""
    own = F.max(F.when(F.col(station) == priority, F.col(value)))
    others = F.avg(F.when(F.col(station) != priority, F.col(value)))
    return df.groupBy(*keys).agg(F.coalesce(own, others).alias(out))
