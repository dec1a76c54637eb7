"""Daily silver tables and the gold feature table, as single lazy plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydroflow import config as C
from hydroflow.config import SiteConfig
from hydroflow.functions.meteo import penman_monteith, seasonality, vpd
from hydroflow.functions.scalars import polyval
from hydroflow.operators import aggregates, fill, quality
from hydroflow.operators.selects import union_aligned
from hydroflow.operators.windows import (
    difference, lags, peak_intensity, rolling_mean, rolling_sum)

SITE = ("site",)
STATION = ("site", "station")
SERIES = ("site", "station", "metric")

# gold column -> silver metric it is the station consensus of
CONSENSUS = {
    "temp_mean_C": "temperature_C_mean",
    "temp_max_C": "temperature_C_max",
    "temp_min_C": "temperature_C_min",
    "humidity_pct": "relative_humidity_pct_mean",
    "wind_speed_ms": "wind_speed_ms_mean",
    "rainfall_mm": "rainfall_mm_sum",
}


def daily_silver(readings: DataFrame, strict: bool = False) -> DataFrame:
    """Readings (site, station, ts, param, value, src_ord) to checked daily metrics.

    The last reading of a slot wins, days are aggregated per parameter, then the
    four quality layers run. The result still carries its change list.
    """
    return checked_days(aggregates.last_reading(readings, ("site", "station", "ts", "param"), "value", "src_ord"), strict)


def checked_days(slots: DataFrame, strict: bool = False) -> DataFrame:
    """The same from one reading per slot (site, station, ts, param, value)."""
    daily = aggregates.daily_parameters(slots, STATION, strict=strict)
    temperature = slots.where(F.col("param") == "temperature_C")
    covered = quality.slot_coverage(temperature, STATION, "ts", "value")
    return quality.apply_layers(daily, [
        quality.physical_bounds(),
        quality.monthly_iqr(SERIES),
        quality.coverage(covered, STATION, strict=strict),
        quality.persistence(SERIES),
    ])


def flow_silver(flows: DataFrame, limit_mode: str = "prefix") -> DataFrame:
    """Daily flows (site, station, date, flow_m3): duplicates averaged, checked, short gaps filled."""
    daily = aggregates.mean_of_duplicates(flows, ("site", "station", "date"), "flow_m3")
    long = fill.on_spine(daily, STATION).select(
        "site", "station", "date", F.lit("flow_m3").alias("metric"), F.col("flow_m3").alias("value"))
    return quality.apply_layers(long, [
        quality.not_negative(),
        quality.monthly_iqr(SERIES, skip_suffix=None, decimals=0),
        quality.fill_gaps(SERIES, limit_mode=limit_mode),
    ])


def rain_intensity(readings: DataFrame, config: SiteConfig) -> DataFrame:
    """Peak one-hour rain per day from ten-minute rain, priority station first."""
    rain = readings.where(F.col("param") == "rainfall_mm")
    return slot_intensity(aggregates.last_reading(rain, ("site", "station", "ts"), "value", "src_ord"), config)


def slot_intensity(slots: DataFrame, config: SiteConfig) -> DataFrame:
    """The same from one rain reading per slot (site, station, ts, value)."""
    own = F.max(F.when(F.col("station") == config.priority_station, F.col("value")))
    merged = slots.groupBy("site", "ts").agg(F.coalesce(own, F.avg("value")).alias("value"))
    return peak_intensity(merged, SITE, "ts", "value")


def weather_columns(silver: DataFrame, config: SiteConfig) -> DataFrame:
    """Long daily metrics to one row per site and day: consensus weather and radiation.

    One aggregate makes all columns; radiation comes from its own station only.
    """
    metric, station, value = F.col("metric"), F.col("station"), F.col("value")
    columns = []
    for name, source in CONSENSUS.items():
        own = F.max(F.when((metric == source) & (station == config.priority_station), value))
        others = F.avg(F.when((metric == source) & (station != config.priority_station), value))
        columns.append(F.coalesce(own, others).alias(name))
    radiation = (metric == "global_radiation_MJm2") & (station == config.radiation_station)
    columns.append(F.max(F.when(radiation, value)).alias("radiation_MJm2"))
    return silver.groupBy("site", "date").agg(*columns)


def flow_columns(flows: DataFrame, config: SiteConfig) -> DataFrame:
    """Long flows to inflow and outflow columns."""
    def of(name):
        return F.max(F.when(F.col("station") == name, F.col("flow_m3")))
    return flows.groupBy("site", "date").agg(of(config.inflow_station).alias("inflow_m3"),
                                             of(config.outflow_station).alias("outflow_m3"))


def add_evaporation(df: DataFrame, config: SiteConfig) -> DataFrame:
    """Vapour pressure deficit and reference evapotranspiration."""
    return df.withColumns({
        "vpd_kPa": vpd("temp_mean_C", "humidity_pct"),
        "et0_mm": penman_monteith("temp_mean_C", "temp_max_C", "temp_min_C", "humidity_pct",
                                  "wind_speed_ms", "radiation_MJm2", F.col("doy").cast("double"),
                                  config.latitude, config.elevation_m)})


def add_antecedent(df: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Rolling rain and evapotranspiration sums and their balances, over dense daily rows."""
    sums = {f"rainfall_{n}d_mm": rolling_sum("rainfall_mm", keys, "date", n, m)
            for n, m in C.RAIN_WINDOWS}
    sums |= {f"et0_{n}d_mm": rolling_sum("et0_mm", keys, "date", n, m) for n, m in C.ET0_WINDOWS}
    return df.withColumns(sums).withColumns({
        f"moisture_balance_{n}d_mm": F.col(f"rainfall_{n}d_mm") - F.col(f"et0_{n}d_mm")
        for n, _ in C.ET0_WINDOWS})


def add_level(df: DataFrame, level_to_volume, keys: Sequence[str] = SITE) -> DataFrame:
    """Volume from the level curve, changes over one to three rows and their lags."""
    volume = df.withColumn("volume_Mm3", polyval(level_to_volume, "level_m"))
    changed = volume.withColumns({
        "level_change_m": difference("level_m", keys, "date"),
        "volume_change_Mm3": difference("volume_Mm3", keys, "date"),
        "volume_change_2d_Mm3": difference("volume_Mm3", keys, "date", 2),
        "volume_change_3d_Mm3": difference("volume_Mm3", keys, "date", 3)})
    return changed.withColumns(
        lags("volume_change_Mm3", keys, "date", 2, "volume_change_lag{}_Mm3"))


def add_flow(df: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Net inflow, lags and the trailing weekly mean."""
    net = df.withColumn("net_inflow_m3", F.col("inflow_m3") - F.col("outflow_m3"))
    return net.withColumns({
        **lags("inflow_m3", keys, "date", 2, "inflow_lag{}_m3"),
        **lags("net_inflow_m3", keys, "date", 2, "net_inflow_lag{}_m3"),
        "net_inflow_7d_ma_m3": rolling_mean("net_inflow_m3", keys, "date", 7)})


def build_gold(silver: DataFrame, flows: DataFrame, levels: DataFrame, intensity: DataFrame,
               config: SiteConfig, level_to_volume, start=None, end=None,
               check_unique: bool = True) -> DataFrame:
    """The gold table: dense daily rows per site with every feature, targets last.

    ``silver`` is (site, station, date, metric, value), ``flows`` (site, station,
    date, flow_m3), ``levels`` (site, date, level_m), ``intensity`` (site, date,
    precip_intensity_mm_hr). The spine runs over the days of the weather, or from
    ``start`` to ``end``.

    The sources are stacked and merged by one aggregate on (site, date) instead of
    being joined one after the other; everything after it works on one
    partitioning by site, where a site has one row a day.
    """
    day = [*SITE, "date"]
    sources = [weather_columns(silver, config).withColumn("_has_weather", F.lit(True)),
               intensity.select(*day, "precip_intensity_mm_hr"), levels.select(*day, "level_m"),
               flow_columns(flows, config)]
    if start or end:  # edge days of the spine, empty rows where no source has them
        edges = F.array(*[F.lit(e).cast("date") for e in (start, end) if e])
        sources.append(silver.select(*SITE).distinct().withColumn("date", F.explode(edges)))
    stacked = union_aligned(sources)
    merged = stacked.groupBy(*day).agg(*[
        _single(c, check_unique) if c in ("level_m", "precip_intensity_mm_hr") else F.max(c).alias(c)
        for c in stacked.columns if c not in day])
    whole = Window.partitionBy(*SITE)
    weather_day = F.when(F.col("_has_weather"), F.col("date"))
    first = F.lit(start).cast("date") if start else F.min(weather_day).over(whole)
    last = F.lit(end).cast("date") if end else F.max(weather_day).over(whole)
    inside = merged.withColumns({"_first": first, "_last": last}) \
                   .where(F.col("date").between(F.col("_first"), F.col("_last"))) \
                   .drop("_first", "_last", "_has_weather")
    df = fill.on_spine(inside, SITE).withColumns(seasonality("doy", config.latitude))
    df = add_flow(add_level(add_antecedent(add_evaporation(df, config)), level_to_volume))
    order = [c for c in df.columns if c not in C.GOLD_TARGETS and c != "doy"]
    return df.select(*order, *C.GOLD_TARGETS)


def _single(column: str, check: bool):
    """The one value a day has; two values are an error."""
    if not check:
        return F.max(column).alias(column)
    failure = F.raise_error(F.lit(f"duplicate daily value of {column}")).cast("double")
    return F.when(F.count(column) > 1, failure).otherwise(F.max(column)).alias(column)


def add_training_lags(gold: DataFrame, keys: Sequence[str] = SITE) -> DataFrame:
    """Rain lags and the empty stage-one column the model jobs need."""
    return gold.withColumns(lags("rainfall_mm", keys, "date", 3, "rainfall_lag{}_mm")) \
               .withColumn("predicted_inflow_m3", F.lit(None).cast("double"))


def forecast_features(history: DataFrame, forecast: DataFrame, config: SiteConfig,
                      keys: Sequence[str] = SITE) -> DataFrame:
    """Feature rows of forecast days, windows reaching back over the history.

    ``history`` needs (keys, date, rainfall_mm, et0_mm), ``forecast`` the forecast
    columns. Only forecast days come out.
    """
    ready = forecast.withColumn("temp_mean_C", (F.col("temp_max_C") + F.col("temp_min_C")) / 2.0) \
                    .withColumn("doy", F.dayofyear("date"))
    ready = add_evaporation(ready, config).withColumns(seasonality("doy", config.latitude))
    past = history.select(*keys, "date", "rainfall_mm", "et0_mm").withColumn("_ahead", F.lit(False))
    both = union_aligned([ready.withColumn("_ahead", F.lit(True)), past])
    featured = add_antecedent(both, keys).withColumns(
        lags("rainfall_mm", keys, "date", 3, "rainfall_lag{}_mm"))
    return featured.where("_ahead").drop("_ahead")


def gold_slice(gold: DataFrame, first: str, last: str, groups: Sequence[Sequence[str]]) -> DataFrame:
    """Rows of a date range with the columns of the chosen groups, none twice."""
    columns = list(dict.fromkeys(c for g in groups for c in g if c in gold.columns))
    return gold.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))) \
               .select("site", "date", *columns)


def save_gold(gold: DataFrame, path: str) -> None:
    """Parquet by year, dealt by ranges of year and site: files stay few with many sites, and site filters skip files."""
    gold.withColumn("year", F.year("date")).repartitionByRange("year", "site") \
        .sortWithinPartitions("year", "site", "date") \
        .write.mode("overwrite").partitionBy("year").parquet(path)
