"""Landed CSV text: sensor readings, river flows, lake levels, curves, ensembles, forecasts."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroflow import config as C
from hydroflow.functions.scalars import clip, lookup, replace_by_map, strip_number, to_double
from hydroflow.operators.selects import union_aligned

SENSOR_TS = "dd/MM/yyyy HH:mm"
DAY_MONTH_YEAR = "d/M/yyyy"
ISO_DATE = "yyyy-MM-dd"

FLOW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in (
    "id", "station_code", "station_local", "station", "date", "flow_m3", "flow_rate",
    "hydro_year", "overflow")])


# ten-minute sensor readings -----------------------------------------------------

def read_sensor_csv(spark: SparkSession, paths_by_header: Mapping[str, Sequence[str]] | Sequence[str]
                    ) -> DataFrame:
    """All-string rows of sensor CSV files, one scan per group of equal headers.

    ``source_order`` keeps the order of files and rows for rules that take the first
    or the last row; a byte-order mark before the header is dropped. A file whose header is not its
    group's raises when it is read.
    """
    groups = paths_by_header.values() if isinstance(paths_by_header, Mapping) else [paths_by_header]
    frames = []
    for paths in groups:
        raw = spark.read.option("header", True).option("encoding", "UTF-8") \
            .option("enforceSchema", False).csv(list(paths))
        raw = raw.withColumn("source_order", _source_order())
        frames.append(raw.withColumnsRenamed({c: c.lstrip("\ufeff").strip() for c in raw.columns}))
    return union_aligned(frames)


def file_headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """Header cells of every CSV file, by path: one job, which sends back one line per file."""
    lines = read_lines(spark, paths).where(F.col("block_start") == 0)
    first = lines.groupBy("source_file").agg(F.min_by("line", "line_id").alias("line")).collect()
    return {unquote(r["source_file"]): [c.strip() for c in next(csv.reader([r["line"]]), [])] for r in first}


def read_sensor_files(spark: SparkSession, paths: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """All-string rows of sensor CSV files, each by its own header.

    Headers are read first and mapped; files whose mapped headers agree are one scan with that schema, whatever
    the order of columns in other files. A column that a file does not have is null in its rows, a byte-order mark is
    dropped, and a header that names a column twice is an error.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, cells in sorted(file_headers(spark, paths).items()):
        names = tuple(columns.get(c, c) for c in cells)
        if len(set(names)) < len(names):
            raise ValueError(f"{path} names a column twice: {names}")
        groups.setdefault(names, []).append(path)
    if not groups:
        raise FileNotFoundError(f"no sensor files in {list(paths)}")
    frames = []
    for names, files in groups.items():
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        raw = spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(files)
        frames.append(raw.withColumn("source_order", _source_order()))
    return union_aligned(frames)


def _source_order():
    """Place of a row: file, split of the file, row in the split."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))


def normalize_sensor_rows(raw: DataFrame, columns: Mapping[str, str], stations: Mapping[str, str],
                          expected: Sequence[str]) -> DataFrame:
    """Rename columns and stations by map, drop unmapped stations, add missing columns.

    Blank and dash cells become null. Everything stays text.
    """
    named = raw.withColumnsRenamed({c: columns.get(c.strip(), c.strip()) for c in raw.columns})
    station = lookup(F.trim("station"), stations)
    kept = named.withColumn("station", station).where(F.col("station").isNotNull())
    cells = {c: F.when(~F.col(c).isin("", "-"), F.col(c)) for c in expected
             if c in kept.columns and c != "station"}
    cells |= {c: F.lit(None).cast("string") for c in expected if c not in kept.columns}
    order = [c for c in kept.columns if c == "source_order"]
    return kept.withColumns(cells).select(*expected, *order)


def cast_sensor_rows(rows: DataFrame, numeric: Sequence[str], ts: str = "datetime") -> DataFrame:
    """Text to types: day-first timestamps and doubles; rows without a time or station go."""
    when = F.try_to_timestamp(F.trim(ts), F.lit(SENSOR_TS)).cast("timestamp_ntz")
    return (rows.withColumns({c: to_double(c) for c in numeric})
            .withColumn("ts", when).drop(ts).dropna(subset=["ts", "station"]))


# river flow files ------------------------------------------------------------------

def read_flow_csv(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Headerless eight-column flow rows; longer lines are skipped, shorter ones padded.

    A ninth column takes the first surplus field: a line that has one is dropped.
    """
    raw = spark.read.schema(FLOW_SCHEMA).option("mode", "PERMISSIVE").csv(list(paths))
    return raw.where(F.col("overflow").isNull()).drop("overflow")


def normalize_flow_rows(raw: DataFrame, names: Mapping[str, str], excluded: Sequence[str] = (),
                        date_format: str = DAY_MONTH_YEAR, rate_mode: str = "text") -> DataFrame:
    """Station names, types and the missing-marker rule of flow rows.

    A zero flow is missing where its rate is the text ``"0"`` (``rate_mode="text"``)
    or any number equal to zero (``"numeric"``).
    """
    if rate_mode not in ("text", "numeric"):
        raise ValueError(f"unknown rate_mode {rate_mode}")
    flow = to_double("flow_m3")
    rate_is_zero = (F.trim("flow_rate") == "0") if rate_mode == "text" else (to_double("flow_rate") == 0)
    missing = F.coalesce(rate_is_zero & (flow == 0), F.lit(False))
    tidy = raw.select(
        replace_by_map("station", names).alias("station"),
        F.to_date(F.try_to_timestamp(F.trim("date"), F.lit(date_format))).alias("date"),
        F.when(~missing, flow).alias("flow_m3"))
    if excluded:
        tidy = tidy.where(~F.col("station").isin(*excluded))
    return tidy.dropna(subset=["date", "station"])


def read_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Text lines with their file and their order in it; large files are read in splits."""
    return spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_id"),
        F.regexp_replace("value", "^\ufeff|\r$", "").alias("line"))


def read_sheet_csv(spark: SparkSession, paths: Sequence[str], title_rows: int = 3) -> DataFrame:
    """Flow sheets saved as CSV: title rows at the top of each file, then data by position."""
    lines = read_lines(spark, paths)
    tops = (lines.where(F.col("block_start") == 0).groupBy("source_file")
            .agg(F.min("line_id").alias("top")))
    is_title = (F.col("block_start") == 0) & (F.col("line_id") < F.col("top") + title_rows)
    return parse_sheet_lines(lines.join(tops, "source_file").where(~is_title))


def parse_sheet_lines(lines: DataFrame) -> DataFrame:
    """Positional sheet lines to the columns of a flow row (station name in column 3)."""
    schema = "id string, station_code string, station string, date string, " \
             "flow_m3 string, flow_rate string"
    # inline ends the projection: a plain "r.*" would parse the line again for every field
    return lines.where(F.trim("line") != "").select(F.inline(F.array(F.from_csv("line", schema))))


def normalize_sheet_rows(raw: DataFrame, translations: Mapping[str, str],
                         names: Mapping[str, str], excluded: Sequence[str] = ()) -> DataFrame:
    """Translate local station names, then the flow rules with a numeric rate test."""
    translated = raw.withColumn("station", replace_by_map("station", translations))
    return normalize_flow_rows(translated, names, excluded, ISO_DATE, "numeric")


# lake levels ------------------------------------------------------------------------------

# (date column, level column, date format); the level column's name is the exporter's choice
LEVEL_LAYOUTS = (("Survey_Date", "Survey_Level", DAY_MONTH_YEAR), ("Date", "Level", ISO_DATE))


def read_level_files(spark: SparkSession, paths: Sequence[str],
                     layouts: Sequence[tuple[str, str, str]] = LEVEL_LAYOUTS) -> DataFrame:
    """Level files of any known layout, as dated rows with ``source_order`` for first-wins rules."""
    lines = read_lines(spark, paths)
    order = F.struct("source_file", "block_start", "line_id").alias("source_order")
    return parse_level_lines(lines.select("source_file", order, "line"), layouts)


def parse_level_lines(lines: DataFrame,
                      layouts: Sequence[tuple[str, str, str]] = LEVEL_LAYOUTS) -> DataFrame:
    """Lines (source_file, source_order, line) to dated levels by the layout a file's header shows.

    Files without a known header, blank and ``Downloaded`` footer lines, and rows
    that do not parse give nothing.
    """
    cells = lines.withColumn("f", F.transform(F.split("line", ","), lambda x: F.trim(x)))
    layout = F.lit(None)
    for date_name, level_name, date_format in reversed(layouts):
        date_at, level_at = (F.array_position("f", n).cast("int") for n in (date_name, level_name))
        layout = F.when((date_at > 0) & (level_at > 0), F.struct(
            F.lit(date_format).alias("format"), date_at.alias("date_at"),
            level_at.alias("level_at"))).otherwise(layout)
    headers = (cells.withColumn("layout", layout).where("layout is not null")
               .groupBy("source_file").agg(F.min("layout").alias("layout")))
    body = cells.where((F.trim("line") != "") & ~F.ltrim("line").startswith("Downloaded"))
    typed = (body.join(headers, "source_file")
             .withColumn("_d", F.get("f", F.col("layout.date_at") - 1))
             .withColumn("_l", F.get("f", F.col("layout.level_at") - 1)))
    date = F.coalesce(*[F.when(F.col("layout.format") == fmt, F.try_to_timestamp("_d", F.lit(fmt)))
                        for fmt in dict.fromkeys(fmt for _, _, fmt in layouts)])
    return typed.select("source_file", "source_order", F.to_date(date).alias("date"),
                        to_double("_l").alias("level_m")).dropna(subset=["date", "level_m"])


# curves, ensembles, forecasts -----------------------------------------------------------------

def normalize_curve(raw: DataFrame, keys: Sequence[str], level: str, volume_a: str,
                    volume_b: str) -> DataFrame:
    """Hypsometric curve with the volume taken from the column with the larger maximum.

    Files ship with their percent and volume columns swapped at times.
    """
    numbers = raw.select(*keys, to_double(level).alias("level_m"), strip_number(volume_a).alias("_a"),
                         strip_number(volume_b).alias("_b"))
    larger = numbers.groupBy(*keys).agg((F.max("_a") > F.max("_b")).alias("_first"))
    volume = F.when(F.coalesce("_first", F.lit(False)), F.col("_a")).otherwise(F.col("_b"))
    return numbers.join(larger, list(keys)).select(*keys, "level_m", volume.alias("volume_Mm3"))


def normalize_ensemble(raw: DataFrame, cap: float = C.TMAX_CAP) -> DataFrame:
    """Ensemble rows (year, month, day, tmin, tmax, model, scenario, site) to dated rows.

    Impossible dates are dropped and the maximum temperature is capped.
    """
    date = F.concat_ws("-", *[F.col(c).cast("string") for c in ("year", "month", "day")])
    return (raw.withColumn("date", date.try_cast("date")).where(F.col("date").isNotNull())
            .select("date", "model", "scenario", "site", "tmin",
                    clip("tmax", high=cap).alias("tmax"), F.dayofyear("date").alias("doy")))


def read_ensemble(spark: SparkSession, paths_by_site: Mapping[str, Sequence[str]]) -> DataFrame:
    schema = "year int, month int, day int, tmin double, tmax double, model string, scenario string"
    frames = [spark.read.option("header", True).option("enforceSchema", False).schema(schema)
              .csv(list(paths)).withColumn("site", F.lit(site)) for site, paths in paths_by_site.items()]
    return normalize_ensemble(union_aligned(frames))


def check_forecast(raw: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Typed forecast rows; an error names missing required columns."""
    missing = [c for c in C.FORECAST_REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"forecast input lacks columns: {missing}")
    numbers = [to_double(F.col(c).cast("string")).alias(c) if c in raw.columns
               else F.lit(None).cast("double").alias(c) for c in C.FORECAST_COLUMNS[1:]]
    return raw.select(*keys, F.to_date(F.col("date").cast("string")).alias("date"), *numbers)


def incomplete_days(forecast: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How many forecast days lack a required value."""
    blank = F.lit(False)
    for c in C.FORECAST_REQUIRED[1:]:
        blank = blank | F.col(c).isNull()
    return forecast.groupBy(*keys).agg(F.sum(blank.cast("int")).alias("n_incomplete"),
                                       F.count(F.lit(1)).alias("n_days"))


def forecast_template(df: DataFrame, keys: Sequence[str], date: str = "date", days: int = 7) -> DataFrame:
    """Blank rows for the days after the last date of each site."""
    last = df.groupBy(*keys).agg(F.max(date).alias("_last"))
    coming = F.explode(F.sequence(F.lit(1), F.lit(days))).alias("_k")
    blanks = [F.lit(None).cast("double").alias(c) for c in C.FORECAST_COLUMNS[1:]]
    return last.select(*keys, "_last", coming).select(
        *keys, F.date_add("_last", F.col("_k")).alias("date"), *blanks)
