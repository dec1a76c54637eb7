"""STR-1 .. STR-5: streams over the driver tables, against the batch answer in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydroflow.checks import views as V
from hydroflow.checks.recurrences_checks import BUCKET_SQL, series
from hydroflow.checks.registry import query
from hydroflow.session import scratch_path
from hydroflow.streaming import jobs as J
from hydroflow.streaming import replay as R

CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"

CLOSED_DAYS = f"""
    SELECT CAST(user_id % 5 AS VARCHAR) AS station, event_type, CAST(ts AS DATE) AS date, avg(value) AS mean, max(value) AS max,
           min(value) AS min, sum(value) AS sum, count(value) AS n FROM events
    WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= {CLOSED} GROUP BY ALL"""
HOURS = f"""
    WITH s AS (SELECT CAST(user_id % 5 AS VARCHAR) AS station, value, time_bucket(INTERVAL 10 MINUTE, CAST(ts AS TIMESTAMP)) AS slot FROM events),
    w AS (SELECT station, value, slot + CAST(unnest(range(1, 7)) AS INT) * INTERVAL 10 MINUTE AS window_end FROM s)
    SELECT station, window_end, CASE WHEN count(value) = 6 THEN sum(value) END AS hour_sum, count(value) AS n
    FROM w WHERE window_end <= {CLOSED} GROUP BY ALL"""


def landed_events(spark, d):
    """events as a stream of landed files."""
    table = V.table(spark, d, "events")
    return J.read_landed(spark, f"{d}/events*.parquet", table.schema) \
            .withColumn("station", (F.col("user_id") % 5).cast("string"))


def landed(spark, df, name, files_per_trigger=1000):
    """A derived table written to the shared folder and read as a stream of files."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return J.read_landed(spark, path, df.schema, files_per_trigger=files_per_trigger)


@query("str_1_closed_days", CLOSED_DAYS, "mean max min sum")
def str_1(spark, d):
    days = J.closed_days(landed_events(spark, d), ["station", "event_type"])
    return J.run_to_table(days, "closed-days")


@query("str_2_sliding_hour", HOURS, "hour_sum")
def str_2(spark, d):
    return J.run_to_table(J.sliding_hour(landed_events(spark, d), ["station"]), "sliding-hour")


def shuffled_events(spark, d):
    """events as six files, each with rows of all times, one file per batch."""
    rows = V.table(spark, d, "events").withColumn("station", (F.col("user_id") % 5).cast("string"))
    return landed(spark, rows.repartition(6, F.xxhash64("event_id")), "late-events", 1)


@query("str_1_closed_days_late_files", CLOSED_DAYS, "mean max min sum")
def str_1_late(spark, d):
    keys = ["station", "event_type"]
    return J.days_of_partials(J.run_partials(shuffled_events(spark, d), keys, scratch_path(spark, "day-sums")), keys)


@query("str_2_sliding_hour_late_files", HOURS, "hour_sum")
def str_2_late(spark, d):
    return J.hours_of_partials(J.run_partials(shuffled_events(spark, d), ["station"], scratch_path(spark, "slot-sums")), ["station"])


@query("str_3_upsert", """
    SELECT CAST(o_orderdate AS DATE) AS date, max(o_orderkey) AS o_orderkey,
           arg_max(o_totalprice, o_orderkey) AS level_m FROM orders GROUP BY 1""", "level_m")
def str_3(spark, d):
    rows = V.table(spark, d, "orders").select(
        F.to_date("o_orderdate").alias("date"), "o_orderkey", F.col("o_totalprice").alias("level_m"))
    # several files, one per batch: later batches bring older rows as well as newer ones
    stream = landed(spark, rows.repartition(4, "o_orderkey"), "orders", 1)
    return J.run_upsert(stream, ["date"], "o_orderkey", scratch_path(spark, "upserted"), F.date_format("date", "yyyy"))


@query("str_3_deduplicated", """
    SELECT DISTINCT CAST(user_id AS VARCHAR) AS station, ts, event_type, value, event_id FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1""", "value")
def str_3_deduplicated(spark, d):
    """Every reading is delivered twice; one of each (station, time) comes through."""
    rows = V.table(spark, d, "events").select(F.col("user_id").cast("string").alias("station"), "ts", "event_type", "value", "event_id")
    least = rows.groupBy("station", "ts").agg(F.min(F.struct("event_id", "event_type", "value")).alias("r")).select("station", "ts", "r.*")
    twice = least.select("station", "ts", "event_type", "value", "event_id")
    stream = landed(spark, twice.unionByName(twice).repartition(3, F.xxhash64("event_id")), "twice")
    out = J.run_to_table(J.deduplicated(stream, ["station"]), "once")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


STUCK_SQL = """
    WITH w AS (SELECT l_returnflag AS site, CAST(l_shipdate AS DATE) AS date, max(l_quantity) AS value FROM lineitem GROUP BY ALL),
    f AS (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY site ORDER BY date) THEN 0 ELSE 1 END AS s FROM w),
    g AS (SELECT *, sum(s) OVER (PARTITION BY site ORDER BY date) AS run FROM f),
    n AS (SELECT *, row_number() OVER (PARTITION BY site, run ORDER BY date) AS run_length FROM g)
    SELECT site, date, value, CAST(run_length AS INT) AS run_length FROM n WHERE run_length >= 3"""
STATE_SQL = BUCKET_SQL + """
    , api AS (SELECT a.site, a.date, sum(b.rain * pow(0.9, a.i - b.i)) AS api
              FROM rows0 a JOIN rows0 b ON a.site = b.site AND b.i <= a.i GROUP BY ALL)
    SELECT r.site, r.date, api, s AS bucket_S, q AS bucket_Q FROM rows0 r
    JOIN bucket b ON r.site = b.site AND r.i = b.i JOIN api ON api.site = r.site AND api.date = r.date"""
#: A century: no day of the record is out of reach of a correction.
CENTURY = 36_525


def alerts(spark, days, files, name):
    stream = landed(spark, days, name, files)
    return R.newest(J.run_to_table(J.stuck_sensor_alerts(stream, ["site"], 3, CENTURY), f"{name}-alerts"), ["site"]) \
            .select("site", "date", "value", "run_length")


def states(spark, days, files, name):
    stream = landed(spark, days, name, files)
    return R.newest(J.run_to_table(J.catchment_states(stream, ["site"], CENTURY), f"{name}-states"), ["site"]) \
            .select("site", "date", "api", "bucket_S", "bucket_Q")


def dealt(days):
    """Daily rows as six files, each with days of all years."""
    return days.repartition(6, F.xxhash64("date"))


def daily_values(spark, d):
    return V.weather(spark, d).select("site", "date", F.col("temp_max_C").alias("value"))


@query("str_4_stuck_sensor", STUCK_SQL, "value")
def str_4(spark, d):
    return alerts(spark, daily_values(spark, d), 1000, "stuck")


@query("str_4_stuck_sensor_late_files", STUCK_SQL, "value")
def str_4_late(spark, d):
    return alerts(spark, dealt(daily_values(spark, d)), 1, "late-stuck")


@query("str_5_catchment_state", STATE_SQL, "api bucket_S bucket_Q")
def str_5(spark, d):
    return states(spark, series(spark, d), 1000, "weather")


@query("str_5_catchment_state_late_files", STATE_SQL, "api bucket_S bucket_Q")
def str_5_late(spark, d):
    return states(spark, dealt(series(spark, d)), 1, "late-weather")
