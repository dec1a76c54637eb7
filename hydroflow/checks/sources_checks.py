"""SRC-1 .. SRC-20 on text and payloads that Spark derives from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroflow import config as C
from hydroflow.checks import views as V
from hydroflow.checks.registry import query
from hydroflow.session import scratch_path
from hydroflow.sources import payloads as P
from hydroflow.sources import sinks as K
from hydroflow.sources import tables as S
from hydroflow.sources import versions

LEVELS = V.with_views(V.LEVELS_SQL)
WEATHER = V.with_views(V.WEATHER_SQL)
MAPPED = {"S0": "north", "S1": "east", "S2": "south", "S3": "west"}
STATION_SQL = "CASE user_id % 5 " + " ".join(f"WHEN {k[1]} THEN '{v}'" for k, v in MAPPED.items()) + " END"


def sensor_text(spark, d):
    """events as a sensor export: foreign headers, all text, dashes for values below ten."""
    return V.table(spark, d, "events").select(
        F.concat(F.lit(" S"), (F.col("user_id") % 5).cast("string")).alias("Station"),
        F.date_format("ts", "dd/MM/yyyy HH:mm").alias(" Time "),
        F.when(F.col("value") < 10, F.lit("-")).otherwise(F.col("value").cast("string")).alias("Temp (C)"))


def sensor_rows(spark, d):
    return S.normalize_sensor_rows(
        sensor_text(spark, d), {"Station": "station", "Time": "datetime", "Temp (C)": "temperature_C"},
        MAPPED, ("station", "datetime", "temperature_C", "rainfall_mm"))


@query("src_1_sensor_rows", f"""
    SELECT {STATION_SQL} AS station, strftime(ts, '%d/%m/%Y %H:%M') AS datetime,
           CASE WHEN value >= 10 THEN CAST(value AS VARCHAR) END AS temperature_C, CAST(NULL AS VARCHAR) AS rainfall_mm
    FROM events WHERE {STATION_SQL} IS NOT NULL""")
def src_1(spark, d):
    return sensor_rows(spark, d)


@query("src_2_cast_sensor_rows", f"""
    SELECT {STATION_SQL} AS station, date_trunc('minute', ts) AS ts,
           CASE WHEN value >= 10 THEN value END AS temperature_C, CAST(NULL AS DOUBLE) AS rainfall_mm
    FROM events WHERE {STATION_SQL} IS NOT NULL""", "temperature_C")
def src_2(spark, d):
    return S.cast_sensor_rows(sensor_rows(spark, d), ("temperature_C", "rainfall_mm"))


def flow_text(spark, d):
    """lineitem as flow rows: undiscounted lines are zero flows, some with the missing marker."""
    flow = F.when(F.col("l_discount") == 0, F.lit("0")).otherwise(F.col("l_extendedprice").cast("string"))
    rate = F.when(F.col("l_tax") == 0, F.lit("0")).otherwise(F.lit("0.0"))
    return V.table(spark, d, "lineitem").select(
        F.concat(F.lit(" "), "l_returnflag", F.lit("-"), "l_linestatus").alias("station"),
        F.date_format("l_shipdate", "d/M/yyyy").alias("date"), flow.alias("flow_m3"), rate.alias("flow_rate"))


FLOW_NAMES = {"A-F": "upper", "A-O": "lower", "R-F": "side"}
FLOW_STATION = "CASE l_returnflag || '-' || l_linestatus " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in FLOW_NAMES.items()) + " ELSE l_returnflag || '-' || l_linestatus END"


def flow_sql(missing: str) -> str:
    return f"""SELECT {FLOW_STATION} AS station, CAST(l_shipdate AS DATE) AS date,
        CASE WHEN {missing} THEN NULL WHEN l_discount = 0 THEN 0 ELSE l_extendedprice END AS flow_m3
        FROM lineitem WHERE {FLOW_STATION} <> 'side'"""


@query("src_3_flow_rows", flow_sql("l_discount = 0 AND l_tax = 0"), "flow_m3")
def src_3(spark, d):
    return S.normalize_flow_rows(flow_text(spark, d), FLOW_NAMES, ("side",))


@query("src_4_missing_marker_numeric", flow_sql("l_discount = 0"), "flow_m3")
def src_4(spark, d):
    return S.normalize_flow_rows(flow_text(spark, d), FLOW_NAMES, ("side",), rate_mode="numeric")


@query("src_5_sheet_rows", flow_sql("l_discount = 0"), "flow_m3")
def src_5(spark, d):
    rows = V.table(spark, d, "lineitem")
    flow = F.when(F.col("l_discount") == 0, F.lit("0")).otherwise(F.col("l_extendedprice").cast("string"))
    local = F.concat(F.lit("loc "), "l_returnflag", F.lit("/"), "l_linestatus")
    lines = rows.select(F.concat_ws(",", F.col("l_orderkey").cast("string"), F.lit("7"), local,
                                    F.date_format("l_shipdate", "yyyy-MM-dd"), flow, F.lit("0")).alias("line"))
    translations = {f"loc {a}/{b}": f"{a}-{b}" for a in "ANR" for b in "FO"}
    return S.normalize_sheet_rows(S.parse_sheet_lines(lines), translations, FLOW_NAMES, ("side",))


@query("src_6_level_files", """
    SELECT o_orderpriority AS source_file, o_orderkey AS source_order, CAST(o_orderdate AS DATE) AS date,
           o_totalprice AS level_m FROM orders WHERE o_orderpriority <> '5-LOW'""", "level_m")
def src_6(spark, d):
    orders = V.table(spark, d, "orders")
    legacy = F.col("source_file").isin("1-URGENT", "2-HIGH")
    body = orders.select(
        F.col("o_orderpriority").alias("source_file"), F.col("o_orderkey").alias("source_order"),
        F.col("o_totalprice").cast("string").alias("v"), "o_orderdate").withColumn(
        "line", F.when(legacy, F.concat(F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" ,"), "v"))
        .otherwise(F.concat(F.lit("x,"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(","), "v")))
    heads = body.select("source_file").distinct().withColumn("source_order", F.lit(-1).cast("long")).withColumn(
        "line", F.when(legacy, F.lit("Survey_Date, Survey_Level"))
        .when(F.col("source_file") == "5-LOW", F.lit("Depth,Area")).otherwise(F.lit("Id,Date,Level")))
    footer = heads.withColumn("line", F.lit("  Downloaded from: somewhere"))
    lines = body.select("source_file", "source_order", "line").unionByName(heads).unionByName(footer)
    return S.parse_level_lines(lines)


@query("src_7_curve", """
    SELECT p_type, CAST(p_size AS DOUBLE) AS level_m, p_retailprice AS volume_Mm3 FROM part""", "level_m volume_Mm3")
def src_7(spark, d):
    swapped = F.col("p_type") == "ECONOMY"
    price = F.format_number("p_retailprice", 2)
    share = F.concat((F.col("p_size") % 100).cast("string"), F.lit("%"))
    raw = V.table(spark, d, "part").select(
        "p_type", F.col("p_size").cast("string").alias("level"),
        F.when(swapped, share).otherwise(price).alias("a"), F.when(swapped, price).otherwise(share).alias("b"))
    return S.normalize_curve(raw, ["p_type"], "level", "a", "b")


VARIABLES = {"temperature_2m_max": "temp_max_C", "precipitation_sum": "rainfall_mm",
             "wind_speed_10m_mean": "wind_speed_ms"}


@query("src_8_daily_arrays", WEATHER + " UNION ALL ".join(
    f"SELECT site, date, '{m}' AS metric, {VARIABLES[v]} * {f!r} AS value FROM weather"
    for v, (names, f) in P.REANALYSIS_METRICS.items() if v in VARIABLES for m in names), "value")
def src_8(spark, d):
    # one payload per site and year, as a reanalysis download has it
    day = F.struct(F.col("date").cast("string").alias("time"), *[F.col(c).alias(v) for v, c in VARIABLES.items()])
    years = V.weather(spark, d).groupBy("site", F.year("date")).agg(F.sort_array(F.collect_list(day)).alias("days"))
    arrays = F.struct(*[F.col(f"days.{v}").alias(v) for v in ("time", *VARIABLES)])
    payloads = years.select("site", F.to_json(F.struct(arrays.alias("daily"))).alias("body"))
    return P.parse_daily_arrays(payloads, ["site"], "body")


#: What is done to the body of payload number k: cut off, emptied, an error message, or nothing.
def damaged(body, k):
    cut = F.substring(body, 1, 40)
    return F.when(k % 5 == 1, cut).when(k % 5 == 2, F.lit(" {} ")).when(k % 5 == 3, F.lit('{"error": true}')).otherwise(body)


def outcome(good_rows, bad, keys):
    """Per payload: how many rows it gave, or why it was put aside."""
    counts = good_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("reason", F.lit(None).cast("string"))
    return counts.unionByName(bad.select(*keys, F.lit(0).cast("long").alias("n_rows"), "reason"))


@query("src_8_quarantine", WEATHER + f"""
    , k AS (SELECT site, year(date) AS y, count(*) AS n FROM weather GROUP BY ALL)
    SELECT site, CAST(y AS INT) AS y, CASE WHEN y % 5 IN (0, 4) THEN n * {sum(len(P.REANALYSIS_METRICS[v][0]) for v in VARIABLES)} ELSE 0 END AS n_rows,
           CASE y % 5 WHEN 1 THEN 'malformed' WHEN 3 THEN 'no daily part' END AS reason FROM k WHERE y % 5 <> 2""")
def src_8_quarantine(spark, d):
    day = F.struct(F.col("date").cast("string").alias("time"), *[F.col(c).alias(v) for v, c in VARIABLES.items()])
    years = V.weather(spark, d).groupBy("site", F.year("date").alias("y")).agg(F.sort_array(F.collect_list(day)).alias("days"))
    arrays = F.struct(*[F.col(f"days.{v}").alias(v) for v in ("time", *VARIABLES)])
    body = damaged(F.to_json(F.struct(arrays.alias("daily"))), F.col("y"))
    good, bad = P.quarantine(years.select("site", "y", body.alias("body")), P.daily_array_fault("body"))
    rows = P.with_at_most(P.parse_daily_arrays(good, ["site", "y"], "body"), bad, 1_000)
    return outcome(rows, bad, ["site", "y"])


@query("src_9_quarantine", """
    SELECT event_id, CASE WHEN event_id % 5 IN (0, 4) AND user_id % 5 IN (1, 2) THEN 1 ELSE 0 END AS n_rows,
           CASE event_id % 5 WHEN 1 THEN 'malformed' WHEN 3 THEN 'malformed' END AS reason
    FROM events WHERE event_id % 5 IN (1, 3) OR event_id % 5 IN (0, 4) AND user_id % 5 IN (1, 2)""")
def src_9_quarantine(spark, d):
    code = (F.col("user_id") % 5).cast("string")
    body = F.to_json(F.create_map(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
                                  F.create_map(code, F.array("value", F.col("user_id").cast("double")))))
    short = F.when(F.col("event_id") % 5 == 1, F.substring(body, 1, 20)).otherwise(damaged(body, F.col("event_id")))
    payloads = V.table(spark, d, "events").select("event_id", short.alias("body"))
    good, bad = P.quarantine(payloads, P.station_map_fault("body"))
    return outcome(P.parse_station_maps(good, ["event_id"], "body", {"1": "upper", "2": "lower"}), bad, ["event_id"])


@query("src_9_station_maps", """
    SELECT date_trunc('second', ts) AS ts, CASE user_id % 5 WHEN 1 THEN 'upper' ELSE 'lower' END AS station,
           value AS flow_m3s FROM events WHERE user_id % 5 IN (1, 2)""", "flow_m3s")
def src_9(spark, d):
    code = (F.col("user_id") % 5).cast("string")
    body = F.create_map(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
                        F.create_map(code, F.array("value", F.col("user_id").cast("double"))))
    payloads = V.table(spark, d, "events").select(F.to_json(body).alias("body"))
    return P.parse_station_maps(payloads, [], "body", {"1": "upper", "2": "lower"})


@query("src_10_script_rows", LEVELS + "SELECT site, date, round(level_m, 3) AS level_m FROM levels", "level_m")
def src_10(spark, d):
    # one page per site and month, its chart script as the source writes it
    row = F.format_string("date = new Date(%d, %d, %d);\n data.addRow([date, %s, 'x']);",
                          F.year("date"), F.month("date") - 1, F.dayofmonth("date"),
                          F.round("level_m", 3).cast("string"))
    pages = V.levels(spark, d).groupBy("site", F.trunc("date", "month")).agg(
        F.concat_ws("\n", F.collect_list(row)).alias("script"))
    html = pages.select("site", F.concat(F.lit("<html><script>"), "script", F.lit("</script></html>")).alias("html"))
    return P.parse_script_rows(html, ["site"], "html")


@query("src_10_script_rows_of_pages", """
    SELECT page_id, DATE '2000-01-01' AS date, 0.0::DOUBLE AS level_m FROM pages
    WHERE regexp_matches(html, 'new Date\\([0-9]+, *[0-9]+, *[0-9]+\\);\\s*data\\.addRow')""", "level_m")
def src_10b(spark, d):
    return P.parse_script_rows(V.table(spark, d, "pages"), ["page_id"], "html")


@query("src_11_forecast_xml", """
    SELECT time_bucket(INTERVAL '6 hours', CAST(ts AS TIMESTAMP)) AS ts, max(value) AS max_temp, min(value) AS min_temp,
           sum(value) AS rain, avg(user_id) AS humidity, avg(value) AS wind_kmh
    FROM events WHERE event_type = 'view' GROUP BY 1""", "max_temp min_temp rain humidity wind_kmh")
def src_11(spark, d):
    ts = F.col("ts").cast("timestamp")
    slot = F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / 21600) * 21600)
    steps = V.table(spark, d, "events").groupBy("event_type", slot.alias("slot")).agg(
        F.max("value").alias("a"), F.min("value").alias("b"), F.sum("value").alias("c"),
        F.avg("user_id").alias("h"), F.avg("value").alias("w"))
    parts = [f"<{tag}>%s</{tag}>" for tag in ("ForecastTime", "MaxTemp", "MinTemp", "Rain", "RelativeHumidity", "WindSpeed")]
    step = F.format_string("<Forecast>" + "".join(parts) + "</Forecast>",
                           F.date_format("slot", "yyyy-MM-dd HH:mm:ss"),
                           *[F.col(c).cast("string") for c in "abchw"])
    days = steps.groupBy("event_type", F.to_date("slot")).agg(F.concat_ws("", F.collect_list(step)).alias("body"))
    xml = F.concat(F.lit("<Location><LocationMetaData><LocationId>"), "event_type",
                   F.lit("</LocationId></LocationMetaData><LocationData>"), "body",
                   F.lit("</LocationData></Location>"))
    return P.parse_forecast_xml(days.select(xml.alias("body")), "body", "view")


TARGET = T.StructType([T.StructField("date", T.DateType()), T.StructField("site", T.StringType()),
                       T.StructField("level_m", T.DoubleType()), T.StructField("volume_Mm3", T.DoubleType())])


@query("src_12_append_aligned", LEVELS + """
    SELECT date, site, level_m, CAST(NULL AS DOUBLE) AS volume_Mm3, (SELECT count(*) FROM levels) AS appended
    FROM levels""", "level_m")
def src_12(spark, d):
    path = scratch_path(spark, "append")
    rows = V.levels(spark, d).withColumn("unknown", F.lit("dropped"))
    appended = K.append_aligned(rows, path, TARGET)
    K.append_aligned(rows.where(F.lit(False)), path, TARGET)
    return spark.read.schema(TARGET).parquet(path).withColumn("appended", F.lit(appended).cast("long"))


@query("src_13_newer_than", LEVELS + """
    , marks AS (SELECT site, max(date) AS mark FROM levels
               WHERE date < DATE '1999-01-01' AND site <> '5-LOW' GROUP BY ALL)
    SELECT l.* FROM levels l LEFT JOIN marks m ON l.site = m.site
    WHERE date > coalesce(mark, DATE '1994-12-31') AND date < DATE '2001-07-15'""", "level_m")
def src_13(spark, d):
    levels = V.levels(spark, d)
    target = levels.where("date < date'1999-01-01' and site <> '5-LOW'")
    return K.newer_than(levels, target, ["site"], "date", F.lit("2001-07-15").cast("date"), "1995-01-01")


@query("src_14_ensemble_rows", """
    WITH r AS (SELECT printf('%04d-%02d-%02d', year(o_orderdate), month(o_orderdate), day(o_orderdate) + 2) AS t, *
               FROM orders)
    SELECT try_cast(t AS DATE) AS date, o_orderpriority AS model, o_orderstatus AS scenario, 'lake' AS site,
           o_totalprice / 20011 AS tmin, least(o_totalprice / 9973, 49) AS tmax,
           CAST(dayofyear(try_cast(t AS DATE)) AS INT) AS doy
    FROM r WHERE try_cast(t AS DATE) IS NOT NULL""", "tmin tmax")
def src_14(spark, d):
    day = F.to_date("o_orderdate")
    raw = V.table(spark, d, "orders").select(
        F.year(day).alias("year"), F.month(day).alias("month"), (F.dayofmonth(day) + 2).alias("day"),
        (F.col("o_totalprice") / 20011).alias("tmin"), (F.col("o_totalprice") / 9973).alias("tmax"),
        F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("scenario"), F.lit("lake").alias("site"))
    return S.normalize_ensemble(raw)


@query("src_15_materialize", LEVELS + "SELECT * FROM levels", "level_m")
def src_15(spark, d):
    path = scratch_path(spark, "levels")
    K.materialize(spark, path, lambda: V.levels(spark, d))

    def rebuilt():
        raise AssertionError("a committed table must be reused")
    return K.materialize(spark, path, rebuilt)


@query("src_16_export_layout", WEATHER + """
    SELECT site, date, CAST(printf('%.11e', sqrt(inflow_m3)) AS DOUBLE) AS inflow,
           CAST(printf('%.11e', ln(outflow_m3)) AS DOUBLE) AS level_m FROM weather""", "inflow level_m", digits=9)
def src_16(spark, d):
    rows = V.weather(spark, d).select(F.log("outflow_m3").alias("level_m"), "site", "date",
                                      F.sqrt("inflow_m3").alias("inflow"))
    return K.export_layout(rows)


@query("src_17_repair_labels", """
    SELECT CAST(epoch(date_trunc('second', ts)) AS BIGINT) + 2082844800 AS epoch,
           arg_min(CASE WHEN event_type = 'error' THEN strftime(ts, '%d/%m/%Y %-H:%M') ELSE 'as read' END, event_id) AS label,
           arg_min(value, event_id) AS value, min(event_id) AS event_id FROM events GROUP BY 1""", "value")
def src_17(spark, d):
    rows = V.table(spark, d, "events").select(
        (F.unix_timestamp(F.col("ts").cast("timestamp")) + F.lit(2082844800)).alias("epoch"),
        F.when(F.col("event_type") != "error", F.lit("as read")).alias("label"), "value", "event_id")
    return P.repair_labels(rows, [], "epoch", order="event_id")


@query("src_18_upsert", LEVELS + """
    , fresh AS (SELECT site, date, -level_m AS level_m FROM levels WHERE month(date) = 5)
    SELECT * FROM fresh UNION ALL SELECT * FROM levels WHERE month(date) <> 5""", "level_m")
def src_18(spark, d):
    old = V.levels(spark, d)
    new = old.where(F.month("date") == 5).withColumn("level_m", -F.col("level_m"))
    return K.upsert(old, new, ["site", "date"], scratch_path(spark, "upsert"))


@query("src_18_upsert_by_month", LEVELS + """
    , fresh AS (SELECT site, date, -level_m AS level_m FROM levels WHERE month(date) = 5)
    SELECT * FROM fresh UNION ALL SELECT * FROM levels WHERE month(date) <> 5""", "level_m")
def src_18_by_month(spark, d):
    """The table is written once; only the months that new rows lie in are read and written again."""
    path, month = scratch_path(spark, "by-month"), F.date_format("date", "yyyy-MM")
    versions.merge(V.levels(spark, d), path, ["site", "date"], partition=month)
    new = versions.read(spark, path).where(F.month("date") == 5).withColumn("level_m", -F.col("level_m"))
    versions.merge(new, path, ["site", "date"], partition=month)
    return versions.read(spark, path)


@query("src_19_forecast_template", LEVELS + "SELECT site, max(date) + CAST(k AS INT) AS date, " + ", ".join(
    f"CAST(NULL AS DOUBLE) AS {c}" for c in C.FORECAST_COLUMNS[1:]) + " FROM levels, range(1, 8) r(k) GROUP BY site, k")
def src_19(spark, d):
    return S.forecast_template(V.levels(spark, d), ["site"])


@query("src_20_forecast_input", WEATHER + """
    SELECT site, date, temp_max_C, temp_min_C, CASE WHEN rainfall_mm > 0 THEN rainfall_mm END AS rainfall_mm,
           humidity_pct, wind_speed_ms, CAST(NULL AS DOUBLE) AS radiation_MJm2 FROM weather""",
       "temp_max_C temp_min_C rainfall_mm humidity_pct wind_speed_ms")
def src_20(spark, d):
    rain = F.when(F.col("rainfall_mm") > 0, F.col("rainfall_mm").cast("string")).otherwise(F.lit(" "))
    text = V.weather(spark, d).select(
        "site", F.col("date").cast("string").alias("date"), rain.alias("rainfall_mm"),
        *[F.col(c).cast("string").alias(c) for c in ("temp_max_C", "temp_min_C", "humidity_pct", "wind_speed_ms")])
    return S.check_forecast(text, ["site"])


@query("src_20_incomplete_days", WEATHER + """
    SELECT site, count(*) FILTER (WHERE rainfall_mm = 0) AS n_incomplete, count(*) AS n_days FROM weather GROUP BY ALL""")
def src_20b(spark, d):
    return S.incomplete_days(src_20(spark, d), ["site"])


