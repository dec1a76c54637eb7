"""Report tables: what the dashboards read, each from one distributed job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroflow import config as C
from hydroflow.config import SiteConfig
from hydroflow.functions.scalars import line_distances, trend
from hydroflow.operators import aggregates as A
from hydroflow.operators.joins import in_periods, latest_state
from hydroflow.operators.selects import tail_rows
from hydroflow.operators.windows import difference, overlay_by_year
from hydroflow.sources.sinks import write_table

SITE = ("site",)


def home_figures(gold: DataFrame, config: SiteConfig = SiteConfig(), keys: Sequence[str] = SITE) -> DataFrame:
    """Last valid level and volume, change over thirty days, distances to the management lines."""
    columns = ["level_m", "volume_Mm3"]
    now = latest_state(gold, keys, "date", columns)
    cut = gold.groupBy(*keys).agg(F.date_sub(F.max("date"), 30).alias("_cut"))
    past = latest_state(gold.join(cut, list(keys)), keys, "date", columns, F.col("_cut")) \
        .withColumnsRenamed({"date": "date_30d", "level_m": "_l", "volume_Mm3": "_v"})
    both = now.join(past, list(keys), "left")
    change = F.col("level_m") - F.coalesce("_l", "level_m")
    lines = line_distances("level_m", config.lower_line_m, config.upper_line_m)
    return both.select(*keys, "date", "level_m", "volume_Mm3", change.alias("level_change_30d_m"),
                       (F.col("volume_Mm3") - F.coalesce("_v", "volume_Mm3")).alias("volume_change_30d_Mm3"),
                       *[c.alias(n) for n, c in lines.items()], trend(change).alias("trend"))


def sparkline(gold: DataFrame, keys: Sequence[str] = SITE, rows: int = 30) -> DataFrame:
    """The last valid levels and their day-to-day changes."""
    valid = gold.where(F.col("level_m").isNotNull()).select(*keys, "date", "level_m")
    last = tail_rows(valid, keys, "date", rows)
    return last.withColumn("change_m", difference("level_m", keys, "date"))


def seasonal_matrix(gold: DataFrame, value: str, keys: Sequence[str] = SITE) -> DataFrame:
    return A.month_matrix(gold, keys, "date", value)


def null_heatmap(gold: DataFrame, columns: Sequence[str], keys: Sequence[str] = SITE) -> DataFrame:
    """Percent missing per column and year, for columns with any gaps."""
    return A.null_profile(gold.withColumn("year", F.year("date")), columns, [*keys, "year"])


def scenario_ribbon(balance: DataFrame, value: str = "level_m") -> DataFrame:
    """10/50/90 percentiles over models of the annual means per scenario."""
    yearly = A.annual(balance, ["model", "scenario"], "date", **{value: F.avg(value)})
    return A.ribbon(yearly, ["scenario", "year"], value)


def period_summary(balance: DataFrame, value: str = "lake_ET_Mm3",
                   periods: Sequence[tuple[str, int, int]] = C.SUMMARY_PERIODS) -> DataFrame:
    """Median and 10-90 range of annual sums per scenario and (overlapping) period, one decimal."""
    yearly = A.annual(balance, ["model", "scenario"], "date", **{value: F.sum(value)})
    found = in_periods(yearly, "year", periods).groupBy("scenario", "period").agg(
        *A.quantile_columns(value, {"p10": .1, "median": .5, "p90": .9}))
    return found.select("scenario", "period", *[F.bround(c, 1).alias(c) for c in ("p10", "median", "p90")])


def observed_annual(levels: DataFrame, balance: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Annual mean of the observed level within the years of the hindcast."""
    first, last = (balance.agg(f(F.year("date")).alias("y")).scalar() for f in (F.min, F.max))
    yearly = A.annual(levels, keys, "date", level_m=F.avg("level_m"))
    return yearly.where(F.col("year").between(first, last))


def write_marts(gold: DataFrame, balance: DataFrame, path: str, config: SiteConfig = SiteConfig()) -> dict[str, str]:
    """Write every mart as a parquet table below ``path``; returns their places."""
    tables = {
        "home_figures": home_figures(gold, config),
        "sparkline": sparkline(gold),
        "year_overlay": overlay_by_year(gold, SITE, "date", "level_m"),
        "null_heatmap": null_heatmap(gold, [c for c, t in gold.dtypes if t == "double"]),
        "level_matrix": seasonal_matrix(gold, "level_m"),
        "inflow_matrix": seasonal_matrix(gold, "inflow_m3"),
        "decomposition": A.seasonal_decomposition(gold, SITE, "date", "level_m"),
        "scenario_ribbon": scenario_ribbon(balance),
        "period_summary": period_summary(balance),
    }
    places = {}
    for name, table in tables.items():
        places[name] = f"{path}/{name}"
        write_table(table, places[name])
    return places
