"""Nested payloads on landed files: JSON, XML, HTML with script data, epoch labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroflow import config as C
from hydroflow.functions.scalars import lookup

# --- fixed values: reanalysis variables, the metrics they fill and their unit factor ---
REANALYSIS_METRICS = {
    "temperature_2m_max": (("temperature_C_max", "temperature_max_C_max"), 1.0),
    "temperature_2m_min": (("temperature_C_min", "temperature_min_C_min"), 1.0),
    "temperature_2m_mean": (("temperature_C_mean",), 1.0),
    "precipitation_sum": (("rainfall_mm_sum",), 1.0),
    "relative_humidity_2m_mean": (("relative_humidity_pct_mean",), 1.0),
    "wind_speed_10m_mean": (("wind_speed_ms_mean",), 1 / C.KMH_PER_MS),
    "wind_speed_10m_max": (("wind_speed_ms_max", "wind_speed_max10min_ms_max"), 1 / C.KMH_PER_MS),
    "wind_gusts_10m_max": (("wind_gust_speed_ms_max", "wind_speed_max1min_ms_max"), 1 / C.KMH_PER_MS),
    "wind_direction_10m_dominant": (("wind_dir_deg_mean", "wind_gust_dir_deg_mean"), 1.0),
    "shortwave_radiation_sum": (("global_radiation_MJm2",), 1.0),
}
EPOCH_ORIGIN = "1904-01-01 00:00:00"


# bad payloads ------------------------------------------------------------------------------------

#: Bodies that say nothing: no rows and no fault.
EMPTY_BODIES = ("", "{}", "[]", "null")
CORRUPT = "_corrupt"


def _is_empty(body: str) -> Column:
    return F.trim(F.coalesce(F.col(body), F.lit(""))).isin(*EMPTY_BODIES)


def daily_array_fault(body: str, metrics: Mapping[str, tuple[Sequence[str], float]] | None = None) -> Column:
    """Why a payload of daily arrays cannot be used, null for good and for empty ones."""
    names = list(REANALYSIS_METRICS if metrics is None else metrics)
    fields = ", ".join(f"`{v}`: array<double>" for v in names)
    schema = f"struct<daily: struct<time: array<string>, {fields}>, {CORRUPT}: string>"
    p = F.from_json(body, schema, {"columnNameOfCorruptRecord": CORRUPT})
    days = p["daily"]["time"]
    uneven = [days.isNotNull() & p["daily"][v].isNotNull() & (F.size(p["daily"][v]) != F.size(days)) for v in names]
    return F.when(_is_empty(body), F.lit(None)).when(p.isNull() | p[CORRUPT].isNotNull(), F.lit("malformed")) \
        .when(p["daily"].isNull(), F.lit("no daily part")) \
        .when(reduce(lambda a, b: a | b, uneven), F.lit("arrays of different length")) \
        .when(F.exists(days, lambda t: t.try_cast("date").isNull()), F.lit("unknown date"))


def station_map_fault(body: str) -> Column:
    """The same for maps of times to stations."""
    p = F.from_json(body, "map<string,map<string,array<double>>>")
    return F.when(_is_empty(body), F.lit(None)).when(p.isNull(), F.lit("malformed")) \
        .when(F.exists(F.map_keys(p), lambda t: t.try_cast("timestamp_ntz").isNull()), F.lit("unknown time"))


def forecast_fault(body: str) -> Column:
    """The same for ``Location`` elements."""
    p = F.from_xml(body, f"{FORECAST_XML}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})
    steps = p["LocationData"]["Forecast"]
    return F.when(_is_empty(body), F.lit(None)).when(p.isNull() | p[CORRUPT].isNotNull(), F.lit("malformed")) \
        .when(p["LocationMetaData"]["LocationId"].isNull(), F.lit("no location")) \
        .when(F.exists(steps, lambda f: f["ForecastTime"].try_cast("timestamp_ntz").isNull()), F.lit("unknown time"))


def quarantine(payloads: DataFrame, fault: Column) -> tuple[DataFrame, DataFrame]:
    """Payloads that can be parsed, and the others with their ``reason``."""
    marked = payloads.withColumn("reason", fault)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def fault_counts(bad: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return bad.groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n_payloads"))


def with_at_most(rows: DataFrame, bad: DataFrame, most: int = 0) -> DataFrame:
    """The rows, with an error when they are read and there are more than ``most`` bad payloads."""
    failure = F.raise_error(F.concat(F.col("n").cast("string"), F.lit(f" bad payloads, at most {most} are allowed"))).cast("boolean")
    found = bad.agg(F.count(F.lit(1)).alias("n")).select(F.when(F.col("n") <= most, F.lit(True)).otherwise(failure).alias("ok"))
    # a one-row subquery: it runs even when no row would come out
    return rows.unionByName(found.where("not ok").select(*[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]))


# payloads ----------------------------------------------------------------------------------------

def parse_daily_arrays(payloads: DataFrame, keys: Sequence[str], body: str,
                       metrics: Mapping[str, tuple[Sequence[str], float]] = REANALYSIS_METRICS) -> DataFrame:
    """``{"daily": {"time": [...], "<variable>": [...]}}`` to long daily metrics.

    A variable may fill several metrics; an empty payload gives no rows.
    """
    fields = ", ".join(f"`{v}`: array<double>" for v in metrics)
    schema = f"struct<daily: struct<time: array<string>, {fields}>>"
    days = payloads.select(*keys, F.from_json(body, schema).alias("p")).select(*keys, "p.daily.*")
    # arrays_zip is null as soon as one array is: a variable not delivered becomes an empty one
    zipped = F.arrays_zip("time", *[F.coalesce(v, F.array().cast("array<double>")).alias(v) for v in metrics])
    rows = days.where(F.col("time").isNotNull()).select(*keys, F.explode(zipped).alias("z"))
    fills = [F.struct(F.lit(name).alias("metric"), (F.col(f"z.{variable}") * F.lit(factor)).alias("value"))
             for variable, (names, factor) in metrics.items() for name in names]
    return (rows.select(*keys, F.col("z.time").try_cast("date").alias("date"),
                        F.explode(F.array(*fills)).alias("m"))
            .where(F.col("m.value").isNotNull())
            .select(*keys, "date", F.col("m.metric").alias("metric"), F.col("m.value").alias("value")))


def parse_station_maps(payloads: DataFrame, keys: Sequence[str], body: str,
                       stations: Mapping[str, str]) -> DataFrame:
    """``{time: {station: [flow, height]}}`` to flow readings of the mapped stations."""
    observations = F.from_json(body, "map<string,map<string,array<double>>>")
    by_time = payloads.select(*keys, F.explode(observations).alias("time", "stations"))
    each = by_time.select(*keys, "time", F.explode("stations").alias("code", "values"))
    named = each.select(*keys, F.col("time").try_cast("timestamp_ntz").alias("ts"),
                        lookup("code", stations).alias("station"),
                        F.get("values", F.lit(0)).alias("flow_m3s"))
    return named.where(F.col("station").isNotNull() & F.col("flow_m3s").isNotNull())


SCRIPT_ROW = (r"new Date\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\);\s*"
              r"data\.addRow\(\s*\[\s*date\s*,\s*(-?\d+(?:\.\d+)?)")


def parse_script_rows(pages: DataFrame, keys: Sequence[str], html: str) -> DataFrame:
    """Dates and levels of a chart script; script months count from zero."""
    parts = [F.regexp_extract_all(html, F.lit(SCRIPT_ROW), F.lit(i)).alias(name)
             for i, name in enumerate(("y", "m", "d", "v"), start=1)]
    found = pages.select(*keys, *parts).select(*keys, F.explode(F.arrays_zip("y", "m", "d", "v")).alias("r"))
    month = (F.col("r.m").cast("int") + F.lit(1)).cast("string")
    date = F.concat_ws("-", F.col("r.y"), month, F.col("r.d")).try_cast("date")
    return (found.select(*keys, date.alias("date"), F.col("r.v").cast("double").alias("level_m"))
            .where(F.col("date").isNotNull()))


FORECAST_XML = """LocationMetaData struct<LocationId: string>,
    LocationData struct<Forecast: array<struct<ForecastTime: string, MaxTemp: double,
        MinTemp: double, Rain: double, RelativeHumidity: double, WindSpeed: double>>>"""


def read_forecast_xml(spark: SparkSession, paths: Sequence[str], location_id: str) -> DataFrame:
    """Six-hourly steps of one location of forecast XML files; an error if it is absent."""
    locations = (spark.read.format("xml").option("rowTag", "Location").schema(FORECAST_XML)
                 .load(",".join(paths)))
    return forecast_steps(locations, location_id)


def parse_forecast_xml(payloads: DataFrame, body: str, location_id: str) -> DataFrame:
    """The same from a column of ``Location`` elements as text."""
    return forecast_steps(payloads.select(F.from_xml(body, FORECAST_XML).alias("l")).select("l.*"),
                          location_id)


def forecast_steps(locations: DataFrame, location_id: str, strict: bool = True) -> DataFrame:
    chosen = locations.where(F.col("LocationMetaData.LocationId") == location_id)
    steps = chosen.select(F.explode("LocationData.Forecast").alias("f")).select(
        F.col("f.ForecastTime").try_cast("timestamp_ntz").alias("ts"), F.col("f.MaxTemp").alias("max_temp"),
        F.col("f.MinTemp").alias("min_temp"), F.col("f.Rain").alias("rain"),
        F.col("f.RelativeHumidity").alias("humidity"), F.col("f.WindSpeed").alias("wind_kmh"))
    if not strict:
        return steps
    found = chosen.agg(F.count(F.lit(1)).alias("n")).select(
        F.when(F.col("n") > 0, F.lit(True)).otherwise(
            F.raise_error(F.lit(f"location {location_id} not in forecast")).cast("boolean")).alias("ok"))
    # the check is a one-row subquery: it runs even when no step would come out
    return steps.unionByName(found.where("not ok").select(
        *[F.lit(None).cast(t).alias(c) for c, t in steps.dtypes]))


# epoch labels ------------------------------------------------------------------------------

def epoch_timestamp(epoch) -> Column:
    """Seconds since the start of 1904 as a timestamp."""
    epoch = epoch if isinstance(epoch, str) else "epoch"
    return F.expr(f"timestampadd(SECOND, `{epoch}`, timestamp_ntz'{EPOCH_ORIGIN}')")


def epoch_label(epoch: str) -> Column:
    """``dd/MM/yyyy H:mm`` with the hour not padded."""
    return F.date_format(epoch_timestamp(epoch), "dd/MM/yyyy H:mm")


def repair_labels(df: DataFrame, keys: Sequence[str], epoch: str, columns: Sequence[str] | None = None,
                  rewrite: bool = False, order: str | None = None) -> DataFrame:
    """Fill null text labels from the epoch and keep one row per epoch.

    ``columns`` defaults to every text column; ``rewrite`` replaces all labels.
    """
    if columns is None:
        columns = [c for c, t in df.dtypes if t == "string" and c not in keys]
    label = epoch_label(epoch)
    filled = df.withColumns({c: label if rewrite else F.coalesce(F.col(c), label) for c in columns})
    rest = [c for c in filled.columns if c not in keys and c != epoch]
    row = F.struct(*rest)
    kept = F.min_by(row, order) if order else F.min(row)
    return (filled.groupBy(*keys, epoch).agg(kept.alias("_r")).select(*keys, epoch, "_r.*")
            .select(*df.columns))


