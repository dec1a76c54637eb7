"""Row and column selection, samples of a series, scenarios, unions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def select_metrics(long: DataFrame, suffix: str, name: str = "metric") -> DataFrame:
    """Rows of the metrics with a name ending (a filter the scan can prune by)."""
    return long.where(F.col(name).endswith(suffix))


def complete(features: Sequence[str]) -> Column:
    """All of the columns hold a value.

    One IS NOT NULL per column: unlike the single predicate of ``dropna`` these are
    pushed to the parquet scan, and the optimizer can carry them through renames
    one by one.
    """
    return reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features], F.lit(True))


def complete_cases(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.where(complete(features))


def in_years(df: DataFrame, date: str, years: Sequence[int]) -> DataFrame:
    """Rows of these years, as one range of dates per run of years, so that files and row groups are pruned."""
    chosen = sorted(set(years))
    firsts = [y for y in chosen if y - 1 not in chosen]
    lasts = [y for y in chosen if y + 1 not in chosen]
    day = lambda y: F.lit(dt.date(y, 1, 1))
    inside = [(F.col(date) >= day(a)) & (F.col(date) < day(b + 1)) for a, b in zip(firsts, lasts)]
    return df.where(reduce(Column.__or__, inside, F.lit(False)))


def in_months(df: DataFrame, date: str, months: Sequence[int]) -> DataFrame:
    return df.where(F.month(date).isin(*months))


def in_dates(df: DataFrame, date: str, first: str, last: str) -> DataFrame:
    return df.where(F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def excluding(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    return df.where(~F.col(column).isin(*names)) if names else df


def every_kth(df: DataFrame, keys: Sequence[str], date: str, step: int) -> DataFrame:
    """Every ``step``-th row of a daily series, from its first row on."""
    w = Window.partitionBy(*keys).orderBy(date)
    return df.withColumn("_n", F.row_number().over(w)) \
             .where((F.col("_n") - 1) % step == 0).drop("_n")


def tail_rows(df: DataFrame, keys: Sequence[str], date: str, rows: int,
              before: Column | None = None) -> DataFrame:
    """The last ``rows`` rows per series, up to but not including a date."""
    source = df if before is None else df.where(F.col(date) < before)
    w = Window.partitionBy(*keys).orderBy(F.col(date).desc())
    return source.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= rows).drop("_n")


def what_if(df: DataFrame, scenarios: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Copies of a forecast per scenario (name, rain factor, temperature offset).

    The scenarios are a short setting list, so they are an exploded literal.
    """
    options = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(m)).alias("rain_factor"),
                                 F.lit(float(o)).alias("temp_offset")) for n, m, o in scenarios])
    rest = [c for c in df.columns if c not in ("rainfall_mm", "temp_max_C", "temp_min_C")]
    return (df.withColumn("_s", F.explode(options))
            .select(*rest, F.col("_s.scenario").alias("scenario"),
                    (F.col("rainfall_mm") * F.col("_s.rain_factor")).alias("rainfall_mm"),
                    (F.col("temp_max_C") + F.col("_s.temp_offset")).alias("temp_max_C"),
                    (F.col("temp_min_C") + F.col("_s.temp_offset")).alias("temp_min_C")))


def union_aligned(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def arg_max(df: DataFrame, keys: Sequence[str], name: str, score: str) -> DataFrame:
    """Name of the best score per key; a null or zero score counts as -1."""
    rank = F.when(F.col(score).isNull() | (F.col(score) == 0), F.lit(-1.0)).otherwise(F.col(score))
    best = F.max_by(F.struct(name, score), F.struct(rank, F.col(name)))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, f"_b.{name}", f"_b.{score}")
