"""Importing this module registers every query."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from hydroflow.checks import views
from hydroflow.operators import aggregates, fill, windows

GROUPS = ("sources", "selects", "joins", "aggregates", "windows", "quality", "scalars",
          "fits", "recurrences", "models", "evaluation", "marts", "streams", "raw")
for _group in GROUPS:
    try:
        importlib.import_module(f"hydroflow.checks.{_group}_checks")
    except ModuleNotFoundError as e:
        if not str(e.name).startswith("hydroflow.checks"):
            raise


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ("site", "station")
    daily = aggregates.daily_parameters(views.readings(spark, sf_dir), keys)
    rain = daily.where("metric = 'rainfall_mm_sum'").select(*keys, "date", "value")
    filled = fill.interpolate(fill.on_spine(rain, keys), keys, "date", "value")
    return filled.withColumn(
        "value_7d", windows.rolling_sum("value", keys, "date", 7, 1)).drop("doy")
