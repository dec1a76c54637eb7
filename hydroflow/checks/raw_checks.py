"""Files that Spark lands from the driver tables, through the readers: headers, pivots and the way to the gold table.

A day of a return flag and line status becomes 144 sensor slots of quarters, so both engines read the same
numbers and equal days have equal means: some days end early, some cells are dashes, some sensors are stuck or far out of bounds. Files differ in the
order of their columns, some begin with a byte-order mark, some lack a column.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hydroflow import config as C
from hydroflow.checks import views as V
from hydroflow.checks.models_checks import lagged
from hydroflow.checks.quality_checks import OUTSIDE, STUCK, fence
from hydroflow.checks.registry import query
from hydroflow.checks.scalars_checks import DECL, EA, OMEGA, PM_SQL, es
from hydroflow.checks.windows_checks import roll
from hydroflow.config import SiteConfig
from hydroflow.operators import aggregates
from hydroflow.plans import gold as G
from hydroflow.plans import raw as R
from hydroflow.session import scratch_path
from hydroflow.sources import tables as S

CONFIG = SiteConfig(priority_station="O", radiation_station="F", inflow_station="in", outflow_station="out")
SLOTS = 144

# landed files ------------------------------------------------------------------------------------

#: Whole numbers of a day, the same in both engines.
BASE = {"q": "CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT)", "n": "count(*)",
        "dsc": "CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT)",
        "tx": "CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT)",
        "ep": "CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT)"}
#: Hundredths of each parameter in slot s of a day; ``//`` divides whole numbers. All are quarters, so sums are exact in any order.
CELLS = {
    "temperature_C": "CASE WHEN (s + q) % 29 = 0 THEN NULL ELSE (q * 100) // n // 25 * 25 + (s * 37) % 52 * 25 - 650 "
                     "+ CASE WHEN q % 97 = 0 THEN 4000 ELSE 0 END END",
    "relative_humidity_pct": "CASE WHEN site = 'R' AND m = 3 THEN 5000 + (s % 4) * 25 ELSE (dsc * 1000) // n // 25 * 25 + s % 2 * 25 END",
    "wind_speed_ms": "CASE WHEN y % 4 = 1 THEN NULL ELSE (tx * 100) // n // 25 * 25 + s % 3 * 25 END",
    "rainfall_mm": "CASE WHEN tx % 5 = 0 THEN (s * 11) % 7 // 5 * 25 ELSE 0 END",
    "global_radiation_Wm2": "(ep // n) % 60000 // 100 * 100",
}
HHMM = "CASE WHEN s % 36 = 6 THEN lpad(CAST(s * 10 // 60 * 100 + s * 10 % 60 AS VARCHAR), 4, '0') END"
CAPTIONS = {"station": "Station", "datetime": "Date, time", "temperature_C": "Temp (C)", "relative_humidity_pct": "Humidity (%)",
            "wind_speed_ms": "Wind", "rainfall_mm": "Rain", "global_radiation_Wm2": 'Sun (W/m"2)', C.HHMM_PARAM: "End (hhmm)"}
ORDERS = (("station", "datetime", *CELLS, C.HHMM_PARAM), ("datetime", C.HHMM_PARAM, *reversed(CELLS), "station"))


def _spark(sql: str) -> str:
    return sql.replace("//", "div").replace("VARCHAR", "STRING")


def days(spark, d):
    site = [F.col("l_returnflag").alias("site"), F.col("l_linestatus").alias("station"), F.to_date("l_shipdate").alias("date")]
    rows = V.table(spark, d, "lineitem").groupBy(*site).agg(*[F.expr(_spark(e)).alias(n) for n, e in BASE.items()])
    return rows.withColumns({"y": F.year("date"), "m": F.month("date")})


def land(lines, path):
    """Lines (file, place, line) as one text file per ``file``."""
    lines.repartition("file").sortWithinPartitions("file", "place").select("file", "line").write.partitionBy("file").text(path)
    return [f"{path}/*/part-*"]


def sensor_files(spark, d, step=1):
    """Every ``step``-th slot of the day is delivered."""
    slots = days(spark, d).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1), F.lit(step)))).where("NOT (q % 11 = 0 AND s >= 90)")
    cells = {p: F.coalesce((F.expr(_spark(e)) / 100).cast("string"), F.lit("-")) for p, e in CELLS.items()}
    cells |= {"station": F.concat("site", F.lit(" at "), "station"), C.HHMM_PARAM: F.coalesce(F.expr(_spark(HHMM)), F.lit("")),
              "datetime": F.date_format(F.timestamp_seconds(F.unix_timestamp(F.col("date").cast("timestamp")) + F.col("s") * 600), S.SENSOR_TS)}
    odd = F.col("y") % 2 == 1

    def row(names, of):
        return F.concat_ws(",", *[of(n) for n in names])

    def caption(n):
        return F.lit('"' + CAPTIONS[n].replace('"', '""') + '"' if "," in CAPTIONS[n] or '"' in CAPTIONS[n] else f" {CAPTIONS[n]} ")

    def line(of):  # years of ``y % 4 = 1`` have no wind column at all
        short = [n for n in ORDERS[1] if n != "wind_speed_ms"]
        return F.when(F.col("y") % 4 == 1, row(short, of)).when(odd, row(ORDERS[1], of)).otherwise(row(ORDERS[0], of))

    body = slots.withColumns({f"_{n}": c for n, c in cells.items()}).select(
        F.concat("site", "station", F.col("y").cast("string")).alias("file"),
        F.concat(F.date_format("date", "yyyyMMdd"), F.lpad(F.col("s").cast("string"), 3, "0")).alias("place"),
        line(lambda n: F.col(f"_{n}")).alias("line"))
    heads = days(spark, d).select("site", "station", "y").distinct().select(
        F.concat("site", "station", F.col("y").cast("string")).alias("file"), F.lit("").alias("place"),
        F.concat(F.when(odd, F.lit("\ufeff")).otherwise(F.lit("")), line(caption)).alias("line"))
    return land(body.unionByName(heads), scratch_path(spark, "sensor-files"))


def flow_files(spark, d):
    """Headerless rows; every tenth day is missing, some zeros carry the missing marker."""
    base = days(spark, d).where("q % 10 <> 3")
    flow = F.explode(F.array(F.struct(F.lit("in").alias("kind"), (F.col("ep") % 7919 * 13).alias("flow")),
                             F.struct(F.lit("out").alias("kind"), F.when(F.expr("q % 7 = 0"), F.lit(0)).otherwise(F.col("q") * 1000).alias("flow"))))
    rows = base.where("station = 'F' OR site = 'N' AND station = 'O'").groupBy("site", "date", "y").agg(
        F.sum("ep").alias("ep"), F.sum("q").alias("q")).select("site", "date", "y", flow.alias("f"))
    lines = rows.select(F.col("site").alias("file"), F.concat(F.date_format("date", "yyyyMMdd"), "f.kind").alias("place"), F.concat_ws(
        ",", F.lit("1"), F.lit("7"), F.lit("local"), F.concat(F.lit(" "), "site", F.lit(" "), "f.kind"), F.date_format("date", "d/M/yyyy"),
        F.col("f.flow").cast("string"), F.when(F.col("f.flow") == 0, F.lit("0")).otherwise(F.lit("0.0")), F.col("y").cast("string")).alias("line"))
    return land(lines, scratch_path(spark, "flow-files"))


def level_files(spark, d):
    """Two layouts with a footer; every day twice, the second time with another level."""
    base = days(spark, d).groupBy("site", "date").agg(F.sum("dsc").alias("dsc"))
    legacy = F.col("site") != "N"
    level = (F.expr("dsc % 300") - 21400 + F.col("again") * 100) / 100
    body = base.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.concat(F.lit("site-"), "site").alias("file"), F.concat(F.date_format("date", "yyyyMMdd"), F.col("again").cast("string")).alias("place"),
        F.when(legacy, F.concat(F.date_format("date", "dd/MM/yyyy"), F.lit(" ,"), level.cast("string")))
        .otherwise(F.concat(F.lit("x,"), F.date_format("date", "yyyy-MM-dd"), F.lit(","), level.cast("string"))).alias("line"))
    sites = base.select("site").distinct()
    heads = sites.select(F.concat(F.lit("site-"), "site").alias("file"), F.lit("").alias("place"),
                         F.when(legacy, F.lit("Survey_Date, Survey_Level")).otherwise(F.lit("Id,Date,Level")).alias("line"))
    feet = heads.select("file", F.lit("z").alias("place"), F.lit("  Downloaded from: somewhere").alias("line"))
    return land(body.unionByName(heads).unionByName(feet), scratch_path(spark, "level-files"))


def names():
    return R.RawNames(
        columns={v: k for k, v in CAPTIONS.items()}, stations={f"{a} at {b}": f"{a}/{b}" for a in "ANR" for b in "FO"},
        flow_stations={f"{a} {k}": f"{a}/{k}" for a in "ANR" for k in ("in", "out")},
        level_site=F.regexp_extract("source_file", "site-([A-Z])/", 1))


# the same in SQL ---------------------------------------------------------------------------------

def raw_sql(step=1):
    return ["base AS (SELECT l_returnflag AS site, l_linestatus AS station, CAST(l_shipdate AS DATE) AS date, "
            + ", ".join(f"{e} AS {n}" for n, e in BASE.items()) + " FROM lineitem GROUP BY ALL)",
            "slots AS (SELECT *, CAST(date AS TIMESTAMP) + s * INTERVAL 10 MINUTE AS ts FROM (SELECT *, year(date) AS y, month(date) AS m, "
            f"CAST(unnest(range(0, {SLOTS}, {step})) AS INT) AS s FROM base) WHERE NOT (q % 11 = 0 AND s >= 90))",
            "cells AS (SELECT site, station, date, ts, " + ", ".join(f"({e}) / 100 AS {p}" for p, e in CELLS.items())
            + f", {HHMM} AS {C.HHMM_PARAM} FROM slots)"]


RAW_SQL, HOURLY_SQL = raw_sql(), raw_sql(6)


@query("src_1_sensor_files", V.with_views(*HOURLY_SQL) + f"""
    SELECT site, station, ts, {', '.join(CELLS)}, {C.HHMM_PARAM} FROM cells""", " ".join(CELLS))
def src_1_files(spark, d):
    """Every file by its own header: two orders of columns, byte-order marks, a missing column."""
    rows = R.sensor_rows(spark, sensor_files(spark, d, 6), names())
    return rows.select("site", "station", "ts", *CELLS, C.HHMM_PARAM)


PAIRS = [(st, p) for st in "FO" for p in (*[p for p in C.PARAM_AGGS if p in CELLS], C.HHMM_PARAM)]
WIDE = [f"{st}_{p}" for st, p in PAIRS]


@query("agg_4_join_8_mixed_pivot", V.with_views(*HOURLY_SQL) + "SELECT site, ts, " + ", ".join(
    f"max({p}) FILTER (WHERE station = '{st}') AS {st}_{p}" for st, p in PAIRS) + " FROM cells GROUP BY ALL",
       " ".join(c for c in WIDE if not c.endswith(C.HHMM_PARAM)))
def agg_4_mixed(spark, d):
    """Stations beside each other, texts beside numbers; parameters without values have no column."""
    return R.wide_table(R.sensor_rows(spark, sensor_files(spark, d, 6), names()))


@query("src_3_flow_files", V.with_views(RAW_SQL[0]) + """
    , pair AS (SELECT site, date, sum(ep) AS ep, sum(q) AS q FROM base WHERE q % 10 <> 3 AND (station = 'F' OR site = 'N') GROUP BY ALL)
    SELECT site || '/in' AS station, date, CASE WHEN ep % 7919 * 13 <> 0 THEN CAST(ep % 7919 * 13 AS DOUBLE) END AS flow_m3 FROM pair
    UNION ALL SELECT site || '/out', date, CASE WHEN q % 7 <> 0 THEN CAST(q * 1000 AS DOUBLE) END FROM pair""", "flow_m3")
def src_3_files(spark, d):
    return S.normalize_flow_rows(S.read_flow_csv(spark, flow_files(spark, d)), names().flow_stations)


LEVEL_SQL = """lake_levels AS (SELECT site, date, (sum(dsc) % 300 - 21400) / 100 AS level_m FROM base GROUP BY ALL)"""


@query("src_6_level_files_first_wins", V.with_views(RAW_SQL[0], LEVEL_SQL) + "SELECT * FROM lake_levels", "level_m")
def src_6_files(spark, d):
    return R.daily_levels(spark, level_files(spark, d), names())


AGG = {"mean": "avg", "max": "max", "min": "min", "sum": "sum"}
METRICS = {f"{p}_{k}": f"{AGG[k]}({p})" for p in CELLS for k in C.PARAM_AGGS[p]}
METRICS["global_radiation_Wm2_sum"] = "coalesce(sum(global_radiation_Wm2), 0)"
METRICS["global_radiation_MJm2"] = "round_even(coalesce(sum(global_radiation_Wm2), 0) * 600 / 1e6, 3)"
COVERED = " OR ".join(f"contains(metric, '{p}')" for p in C.PARAM_AGGS)
BOUNDS = ", ".join(f"('{m}', {float(lo)}, {float(hi)})" for m, (lo, hi) in C.PHYSICAL_BOUNDS.items())
SILVER_SQL = [
    *RAW_SQL,
    "daily AS (UNPIVOT (SELECT site, station, date, " + ", ".join(f"{e} AS {n}" for n, e in METRICS.items())
    + " FROM cells GROUP BY ALL) ON " + ", ".join(METRICS) + " INTO NAME metric VALUE value)",
    "cov AS (SELECT site, station, date, count(temperature_C) / 144.0 AS coverage FROM cells GROUP BY ALL)",
    f"""bounded AS (SELECT d.site, d.station, d.date, d.metric, CASE WHEN NOT coalesce(value < b.lo OR value > b.hi, false) THEN value END AS value
        FROM daily d LEFT JOIN (SELECT * FROM (VALUES {BOUNDS}) b(metric, lo, hi)) b ON d.metric = b.metric)""",
    fence("bounded", C.IQR_MULTIPLIER),
    f"fence_ok AS (SELECT site, station, date, metric, CASE WHEN coalesce({OUTSIDE}, false) THEN NULL ELSE value END AS value FROM fenced)",
    f"""covered AS (SELECT f.site, f.station, f.date, f.metric, CASE WHEN coverage < {C.COVERAGE_MIN} AND ({COVERED}) THEN NULL ELSE value END AS value
        FROM fence_ok f LEFT JOIN cov c ON f.site = c.site AND f.station = c.station AND f.date = c.date)""",
    """st AS (SELECT *, CASE WHEN value = lag(value) OVER w THEN 0 ELSE 1 END AS s
      FROM covered WINDOW w AS (PARTITION BY site, station, metric ORDER BY date))""",
    "sg AS (SELECT *, sum(s) OVER (PARTITION BY site, station, metric ORDER BY date) AS run FROM st)",
    "sn AS (SELECT *, count(*) OVER (PARTITION BY site, station, metric, run) AS run_length FROM sg)",
    f"silver AS (SELECT site, station, date, metric, CASE WHEN {STUCK} THEN NULL ELSE value END AS value FROM sn)"]


@query("qc_6_daily_silver", V.with_views(*SILVER_SQL) + "SELECT site, station, date, metric, value FROM silver WHERE value IS NOT NULL", "value")
def qc_6_silver(spark, d):
    """Ten-minute files through all four layers."""
    rows = R.sensor_rows(spark, sensor_files(spark, d), names(), ())
    slots = aggregates.last_per_slot(rows, R.SLOT, R.PARAMS, "source_order")
    checked = G.checked_days(aggregates.as_readings(slots, R.SLOT, R.PARAMS))
    return checked.drop("changes").where("value is not null").select("site", "station", "date", "metric", "value")


RAIN_SQL = """rain AS (SELECT site, ts, coalesce(max(rainfall_mm) FILTER (WHERE station = 'O'), avg(rainfall_mm)) AS value FROM cells GROUP BY ALL),
    rolled AS (SELECT site, CAST(ts AS DATE) AS date, count(value) OVER w AS k, sum(value) OVER w AS v FROM rain
               WINDOW w AS (PARTITION BY site ORDER BY ts ROWS 5 PRECEDING)),
    peak AS (SELECT site, date, max(CASE WHEN k = 6 THEN v END) AS precip_intensity_mm_hr FROM rolled GROUP BY ALL)"""


@query("win_6_rain_intensity", V.with_views(*RAW_SQL, RAIN_SQL) + "SELECT * FROM peak", "precip_intensity_mm_hr")
def win_6_rain(spark, d):
    rows = R.sensor_rows(spark, sensor_files(spark, d), names(), ()).withColumns({
        "param": F.lit("rainfall_mm"), "value": F.col("rainfall_mm")})
    return G.rain_intensity(rows.withColumnRenamed("source_order", "src_ord"), CONFIG)


FLOW_SQL = [
    """flow_rows AS (SELECT site, unnest(['in', 'out']) AS station, date, unnest([
            CASE WHEN ep % 7919 * 13 <> 0 THEN CAST(ep % 7919 * 13 AS DOUBLE) END, CASE WHEN q % 7 <> 0 THEN CAST(q * 1000 AS DOUBLE) END]) AS value
        FROM (SELECT site, date, sum(ep) AS ep, sum(q) AS q FROM base WHERE q % 10 <> 3 AND (station = 'F' OR site = 'N') GROUP BY ALL))""",
    "flow_spans AS (SELECT site, station, min(date) AS a, max(date) AS b FROM flow_rows GROUP BY ALL)",
    """flow_days AS (SELECT s.site, s.station, CAST(d AS DATE) AS date, g.value, 'flow_m3' AS metric
        FROM (SELECT site, station, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d FROM flow_spans) s
        LEFT JOIN flow_rows g ON g.site = s.site AND g.station = s.station AND g.date = CAST(s.d AS DATE))""",
    fence("flow_days", 3.0).replace("q AS (", "fq AS (", 1).replace("fenced AS", "flow_fenced AS").replace("JOIN q ON", "JOIN fq ON")
    .replace("q.", "fq.").replace("ffq.", "fq."),
    "flow_ok AS (SELECT site, station, date, CASE WHEN value < lo OR value > hi THEN NULL ELSE value END AS value FROM flow_fenced)",
    """flow_near AS (SELECT *, last_value(value IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER p AS pd,
        first_value(value IGNORE NULLS) OVER f AS nv, first_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER f AS nd
      FROM flow_ok WINDOW p AS (PARTITION BY site, station ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                          f AS (PARTITION BY site, station ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    """flows AS (SELECT site, station, date, CASE WHEN date - pd <= 3 THEN
        coalesce(value, pv + (nv - pv) * CAST(date - pd AS DOUBLE) / nullif(CAST(nd - pd AS DOUBLE), 0)) END AS flow_m3 FROM flow_near)"""]


def agreed(metric):
    picked = f"metric = '{metric}' AND station"
    return f"coalesce(max(value) FILTER (WHERE {picked} = 'O'), avg(value) FILTER (WHERE {picked} <> 'O'))"


P2, P1, P0 = V.LEVEL_TO_VOLUME
GOLD_SQL = [
    *SILVER_SQL, RAIN_SQL, LEVEL_SQL, *FLOW_SQL,
    "wide AS (SELECT site, date, " + ", ".join(f"{agreed(m)} AS {c}" for c, m in G.CONSENSUS.items())
    + ", max(value) FILTER (WHERE metric = 'global_radiation_MJm2' AND station = 'F') AS radiation_MJm2 FROM silver GROUP BY ALL)",
    "spans AS (SELECT site, min(date) AS a, max(date) AS b FROM wide GROUP BY ALL)",
    "spine AS (SELECT site, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM spans)",
    """weather AS (SELECT s.site, s.date, dayofyear(s.date) AS doy, w.* EXCLUDE (site, date), k.precip_intensity_mm_hr, l.level_m,
        i.flow_m3 AS inflow_m3, o.flow_m3 AS outflow_m3
      FROM spine s LEFT JOIN wide w ON s.site = w.site AND s.date = w.date LEFT JOIN peak k ON s.site = k.site AND s.date = k.date
      LEFT JOIN lake_levels l ON s.site = l.site AND s.date = l.date
      LEFT JOIN (SELECT * FROM flows WHERE station = 'in') i ON s.site = i.site AND s.date = i.date
      LEFT JOIN (SELECT * FROM flows WHERE station = 'out') o ON s.site = o.site AND s.date = o.date)""",
    PM_SQL.replace("greatest((0.408", "(0.408").replace("* u2)), 0) AS et0_mm", "* u2)) AS et0_raw"),
    f"""g1 AS (SELECT *, CASE WHEN et0_raw IS NOT NULL THEN greatest(et0_raw, 0) END AS et0_mm,
        CASE WHEN temp_mean_C IS NOT NULL AND humidity_pct IS NOT NULL THEN greatest({es('temp_mean_C')} - {EA}, 0) END AS vpd_kPa,
        sin(2 * pi() * doy / 365.25) AS season_sin, cos(2 * pi() * doy / 365.25) AS season_cos, {DECL} AS solar_declination_rad,
        24 / pi() * {OMEGA} AS daylength_hrs, """ + ", ".join(
        f"exp(ln(0.05) / 2025 * pow(least(abs(doy - {c}), 365 - abs(doy - {c})), 2)) AS rbf_{n}" for n, c in C.RBF_CENTRES.items())
    + f""", {P2!r} * level_m * level_m + {P1!r} * level_m + {P0!r} AS volume_Mm3, inflow_m3 - outflow_m3 AS net_inflow_m3 FROM et)""",
    "g2 AS (SELECT *, " + ", ".join([f"{roll('rainfall_mm', n, m)} AS rainfall_{n}d_mm" for n, m in C.RAIN_WINDOWS]
                                    + [f"{roll('et0_mm', n, m)} AS et0_{n}d_mm" for n, m in C.ET0_WINDOWS])
    + f""", level_m - {lagged('level_m', 1)} AS level_change_m, volume_Mm3 - {lagged('volume_Mm3', 1)} AS volume_change_Mm3,
        volume_Mm3 - {lagged('volume_Mm3', 2)} AS volume_change_2d_Mm3, volume_Mm3 - {lagged('volume_Mm3', 3)} AS volume_change_3d_Mm3,
        {lagged('inflow_m3', 1)} AS inflow_lag1_m3, {lagged('inflow_m3', 2)} AS inflow_lag2_m3,
        {lagged('net_inflow_m3', 1)} AS net_inflow_lag1_m3, {lagged('net_inflow_m3', 2)} AS net_inflow_lag2_m3,
        {roll('net_inflow_m3', 7, 1, 'avg')} AS net_inflow_7d_ma_m3 FROM g1)""",
    f"""gold AS (SELECT *, {lagged('volume_change_Mm3', 1)} AS volume_change_lag1_Mm3,
        {lagged('volume_change_Mm3', 2)} AS volume_change_lag2_Mm3,
        rainfall_7d_mm - et0_7d_mm AS moisture_balance_7d_mm, rainfall_14d_mm - et0_14d_mm AS moisture_balance_14d_mm FROM g2)"""]
GOLD = ["temp_mean_C", "temp_max_C", "temp_min_C", "humidity_pct", "wind_speed_ms", "rainfall_mm", "radiation_MJm2", "precip_intensity_mm_hr",
        "inflow_m3", "outflow_m3", "season_sin", "season_cos", "solar_declination_rad", "daylength_hrs", *C.RBF_FEATURES, "vpd_kPa", "et0_mm",
        *C.RAIN_FEATURES, "et0_7d_mm", "et0_14d_mm", "moisture_balance_7d_mm", "moisture_balance_14d_mm", "volume_change_lag1_Mm3",
        "volume_change_lag2_Mm3", "net_inflow_m3", "inflow_lag1_m3", "inflow_lag2_m3", "net_inflow_lag1_m3", "net_inflow_lag2_m3",
        "net_inflow_7d_ma_m3", *C.GOLD_TARGETS]


@query("gold_from_raw_files", V.with_views(*GOLD_SQL) + f"SELECT site, date, {', '.join(GOLD)} FROM gold",
       " ".join(f"{c}:4" if c.startswith("volume") or "flow" in c else c for c in GOLD))
def gold_from_files(spark, d):
    """Sensor, flow and level files to the gold table, all of its columns."""
    return R.raw_to_gold(spark, sensor_files(spark, d), flow_files(spark, d), level_files(spark, d), names(), CONFIG, V.LEVEL_TO_VOLUME)
