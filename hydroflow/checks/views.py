"""The driver tables in the roles of the library: readings, flows, levels, ensembles.

Each view exists twice, as a DataFrame and as the SQL text of a common table
expression, and always covers the whole table it is made from. The odd scale
factors keep means off exact decimals, where two engines may round apart.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroflow.config import SiteConfig
from hydroflow.plans.gold import add_training_lags, build_gold
from hydroflow.session import write_and_read


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ten-minute readings ---------------------------------------------------------------

PARAMS = {"click": "temperature_C", "view": "relative_humidity_pct", "purchase": "rainfall_mm",
          "signup": "global_radiation_Wm2", "error": "wind_speed_ms"}
PARAM_SQL = "CASE event_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in PARAMS.items()) + " END"

READINGS_SQL = f"""readings AS (
    SELECT 'lake' AS site, 'st' || CAST(user_id % 5 AS VARCHAR) AS station,
           time_bucket(INTERVAL '10 minutes', CAST(ts AS TIMESTAMP)) AS ts, {PARAM_SQL} AS param,
           value, event_id AS src_ord
    FROM events)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: the user's group of five is the station, the event type the parameter."""
    param = F.create_map(*[F.lit(x) for kv in PARAMS.items() for x in kv])[F.col("event_type")]
    ts = F.col("ts").cast("timestamp")
    slot = F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / 600) * 600).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(
        F.lit("lake").alias("site"),
        F.concat(F.lit("st"), (F.col("user_id") % 5).cast("string")).alias("station"),
        slot.alias("ts"), param.alias("param"), "value", F.col("event_id").alias("src_ord"))


# daily metrics -----------------------------------------------------------------------

METRICS = {
    "temperature_C_mean": "avg(l_quantity)",
    "temperature_C_max": "max(l_quantity)",
    "temperature_C_min": "min(l_quantity)",
    "relative_humidity_pct_mean": "avg(l_discount) * 1000",
    "rainfall_mm_sum": "sum(l_tax) * 100",
    "wind_speed_ms_mean": "avg(l_tax) * 100",
    "global_radiation_MJm2": "avg(l_extendedprice) / 2503",
}
SILVER_SQL = """silver AS (
    UNPIVOT (SELECT l_returnflag AS site, l_linestatus AS station, CAST(l_shipdate AS DATE) AS date, """ \
    + ", ".join(f"{e} AS {n}" for n, e in METRICS.items()) \
    + " FROM lineitem GROUP BY ALL) ON " + ", ".join(METRICS) + " INTO NAME metric VALUE value)"


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem by return flag (site), line status (station) and ship date."""
    daily = (table(spark, sf_dir, "lineitem")
             .groupBy(F.col("l_returnflag").alias("site"), F.col("l_linestatus").alias("station"),
                      F.to_date("l_shipdate").alias("date"))
             .agg(*[F.expr(e).alias(n) for n, e in METRICS.items()]))
    return daily.unpivot(["site", "station", "date"], list(METRICS), "metric", "value")


FLOWS_SQL = """flows AS (
    SELECT l_returnflag AS site, l_linestatus AS station, CAST(l_shipdate AS DATE) AS date,
           sum(l_extendedprice * (1 - l_discount)) AS flow_m3
    FROM lineitem GROUP BY ALL)"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "lineitem")
            .groupBy(F.col("l_returnflag").alias("site"), F.col("l_linestatus").alias("station"),
                     F.to_date("l_shipdate").alias("date"))
            .agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("flow_m3")))


# levels with natural gaps ---------------------------------------------------------------

LEVELS_SQL = """levels AS (
    SELECT o_orderpriority AS site, CAST(o_orderdate AS DATE) AS date,
           -214 + avg(o_totalprice) / 101113 AS level_m
    FROM orders GROUP BY ALL)"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders by priority (site) and date; days without an order are gaps."""
    return (table(spark, sf_dir, "orders")
            .groupBy(F.col("o_orderpriority").alias("site"), F.to_date("o_orderdate").alias("date"))
            .agg((F.lit(-214) + F.avg("o_totalprice") / 101113).alias("level_m")))


GAPPY_SQL = """gappy AS (
    SELECT o_orderpriority AS site, o_orderstatus AS station, CAST(o_orderdate AS DATE) AS date,
           avg(o_totalprice) / 1.013 AS value
    FROM orders GROUP BY ALL)"""


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders by priority, status and date: a daily series with many gaps."""
    return (table(spark, sf_dir, "orders")
            .groupBy(F.col("o_orderpriority").alias("site"), F.col("o_orderstatus").alias("station"),
                     F.to_date("o_orderdate").alias("date"))
            .agg((F.avg("o_totalprice") / 1.013).alias("value")))


GAPPY_SPINE_SQL = GAPPY_SQL + """, spans AS (
    SELECT site, station, min(date) AS a, max(date) AS b FROM gappy GROUP BY ALL),
dense AS (
    SELECT s.site, s.station, CAST(d AS DATE) AS date, g.value
    FROM (SELECT site, station, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d FROM spans) s
    LEFT JOIN gappy g ON g.site = s.site AND g.station = s.station AND g.date = CAST(s.d AS DATE))"""

# ensembles -----------------------------------------------------------------------------------

ENSEMBLE_SQL = """ensemble AS (
    SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS model, o_orderstatus AS scenario,
           unnest(['catchment', 'lake']) AS site, min(o_totalprice) / 19937 AS tmin,
           max(o_totalprice) / 9973 AS tmax
    FROM orders GROUP BY 1, 2, 3)"""


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: priority is the model, status the scenario; both sites have every date."""
    daily = (table(spark, sf_dir, "orders")
             .groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("model"),
                      F.col("o_orderstatus").alias("scenario"))
             .agg((F.min("o_totalprice") / 19937).alias("tmin"),
                  (F.max("o_totalprice") / 9973).alias("tmax")))
    return daily.select("date", "model", "scenario",
                        F.explode(F.array(F.lit("catchment"), F.lit("lake"))).alias("site"),
                        "tmin", "tmax")


# weather and gold ------------------------------------------------------------------------------

CONFIG = SiteConfig(priority_station="O", radiation_station="O", inflow_station="F", outflow_station="O")
LEVEL_TO_VOLUME = (1.4718614718585357, 784.4588744576319, 103974.06926393778)

WEATHER_SQL = """weather AS (
    SELECT l_returnflag AS site, CAST(l_shipdate AS DATE) AS date,
           max(l_quantity) AS temp_max_C, min(l_quantity) AS temp_min_C,
           (max(l_quantity) + min(l_quantity)) / 2 AS temp_mean_C,
           avg(l_discount) * 1000 AS humidity_pct, avg(l_tax) * 100 AS wind_speed_ms,
           greatest(sum(l_tax) * 100 - 20, 0) AS rainfall_mm,
           avg(l_extendedprice) / 2503 AS radiation_MJm2,
           sum(l_extendedprice * (1 - l_discount)) / 1.013 AS inflow_m3, sum(l_quantity) * 5000 AS outflow_m3,
           -212 + avg(l_discount) * 19.98237461 AS level_m, dayofyear(CAST(l_shipdate AS DATE)) AS doy
    FROM lineitem GROUP BY ALL)"""


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem by return flag (site) and ship date, as one wide row of daily weather."""
    return (table(spark, sf_dir, "lineitem")
            .groupBy(F.col("l_returnflag").alias("site"), F.to_date("l_shipdate").alias("date"))
            .agg(F.max("l_quantity").alias("temp_max_C"), F.min("l_quantity").alias("temp_min_C"),
                 ((F.max("l_quantity") + F.min("l_quantity")) / 2).alias("temp_mean_C"),
                 (F.avg("l_discount") * 1000).alias("humidity_pct"),
                 (F.avg("l_tax") * 100).alias("wind_speed_ms"),
                 F.greatest(F.sum("l_tax") * 100 - 20, F.lit(0.0)).alias("rainfall_mm"),
                 (F.avg("l_extendedprice") / 2503).alias("radiation_MJm2"),
                 (F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1.013).alias("inflow_m3"),
                 (F.sum("l_quantity") * 5000).alias("outflow_m3"),
                 (F.lit(-212) + F.avg("l_discount") * 19.98237461).alias("level_m"))
            .withColumn("doy", F.dayofyear("date")))


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold table of the lineitem lakes, built by the library's own plan."""
    days = weather(spark, sf_dir)
    rain = days.select("site", "date", (F.col("rainfall_mm") / 7).alias("precip_intensity_mm_hr"))
    return build_gold(silver(spark, sf_dir), flows(spark, sf_dir), days, rain, CONFIG, LEVEL_TO_VOLUME)


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold with training lags, written once per call so that many fits share it."""
    return write_and_read(add_training_lags(gold(spark, sf_dir)), "frame")
