"""Landed files to the gold table: sensor, flow and level files of many sites through readers, layers and features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroflow import config as C
from hydroflow.config import SiteConfig
from hydroflow.operators import aggregates, quality
from hydroflow.plans import gold
from hydroflow.session import write_and_read
from hydroflow.sources import tables

PARAMS = tuple(C.PARAM_AGGS)
SLOT = ("site", "station", "ts")


@dataclass(frozen=True)
class RawNames:
    """How a source names things: header cells, station names (to ``site/station``), flow stations, level layouts."""

    columns: Mapping[str, str]
    stations: Mapping[str, str]
    flow_stations: Mapping[str, str]
    level_site: Column
    excluded: Sequence[str] = ()
    layouts: Sequence[tuple[str, str, str]] = field(default_factory=lambda: tables.LEVEL_LAYOUTS)


def with_site(rows: DataFrame) -> DataFrame:
    """Station names ``site/station`` to two columns."""
    parts = F.split("station", "/", 2)
    return rows.withColumns({"site": parts[0], "station": F.get(parts, F.lit(1))})


def sensor_rows(spark: SparkSession, paths: Sequence[str], names: RawNames, texts: Sequence[str] = (C.HHMM_PARAM,)) -> DataFrame:
    """Typed sensor rows (site, station, ts, one column per parameter, source_order); text parameters stay text."""
    raw = tables.read_sensor_files(spark, paths, names.columns)
    rows = tables.normalize_sensor_rows(raw, {}, names.stations, ("station", "datetime", *PARAMS, *texts))
    return with_site(tables.cast_sensor_rows(rows, PARAMS))


def wide_table(rows: DataFrame, texts: Sequence[str] = (C.HHMM_PARAM,)) -> DataFrame:
    """Ten-minute rows of a site, a column per station and parameter that has values, texts beside numbers."""
    return aggregates.pivot_sensors(rows, ("site", "ts"), "station", (*PARAMS, *texts), "source_order")


def daily_flows(spark: SparkSession, paths: Sequence[str], names: RawNames) -> DataFrame:
    """Checked and filled daily flows (site, station, date, flow_m3)."""
    rows = with_site(tables.normalize_flow_rows(tables.read_flow_csv(spark, paths), names.flow_stations, names.excluded))
    checked = quality.clean_table(gold.flow_silver(rows))
    return checked.select("site", "station", "date", F.col("value").alias("flow_m3"))


def daily_levels(spark: SparkSession, paths: Sequence[str], names: RawNames) -> DataFrame:
    """One level per site and day: the first in source order."""
    rows = tables.read_level_files(spark, paths, names.layouts).withColumn("site", names.level_site)
    return aggregates.first_reading(rows.select("site", "date", "level_m", "source_order"), ("site", "date"), "source_order") \
                     .select("site", "date", "level_m")


def raw_to_gold(spark: SparkSession, sensor_paths: Sequence[str], flow_paths: Sequence[str], level_paths: Sequence[str],
                names: RawNames, config: SiteConfig, level_to_volume: Sequence[float], strict: bool = False) -> DataFrame:
    """Files as they land to the gold table.

    The last reading of every slot is written once, because days, coverage and rain intensity all start from it.
    """
    rows = sensor_rows(spark, sensor_paths, names, ())
    slots = write_and_read(aggregates.last_per_slot(rows, SLOT, PARAMS, "source_order"), "slots")
    readings = aggregates.as_readings(slots, SLOT, PARAMS)
    silver = quality.clean_table(gold.checked_days(readings, strict))
    rain = slots.where(F.col("rainfall_mm").isNotNull()).select(*SLOT, F.col("rainfall_mm").alias("value"))
    return gold.build_gold(silver, daily_flows(spark, flow_paths, names), daily_levels(spark, level_paths, names),
                           gold.slot_intensity(rain, config), config, level_to_volume)
