"""WIN-1 .. WIN-17, SPN and FIL on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydroflow import config as C
from hydroflow.checks import views as V
from hydroflow.checks.registry import query
from hydroflow.operators import aggregates, fill, joins, ranks, windows as W

SITE = ("site",)
WEATHER = V.with_views(V.WEATHER_SQL)
DENSE = V.with_views(V.GAPPY_SPINE_SQL)
READ = V.with_views(V.READINGS_SQL)
LEVEL_SPINE_SQL = V.LEVELS_SQL + """, spans AS (SELECT site, min(date) AS a, max(date) AS b FROM levels GROUP BY ALL),
days AS (SELECT s.site, CAST(d AS DATE) AS date, l.level_m
    FROM (SELECT site, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d FROM spans) s
    LEFT JOIN levels l ON l.site = s.site AND l.date = CAST(s.d AS DATE))"""


def dense(spark, d):
    return fill.on_spine(V.gappy(spark, d), ("site", "station"))


def roll(value, rows, at_least, fn="sum"):
    frame = f"(PARTITION BY site ORDER BY date ROWS {rows - 1} PRECEDING)"
    return f"CASE WHEN count({value}) OVER {frame} >= {at_least} THEN {fn}({value}) OVER {frame} END"


ROLL_SQL = [f"{roll('rainfall_mm', n, m)} AS rainfall_{n}d_mm" for n, m in C.RAIN_WINDOWS] + \
           [f"{roll('radiation_MJm2', n, m)} AS et0_{n}d_mm" for n, m in C.ET0_WINDOWS]


@query("win_1_rolling_sums", WEATHER + f"SELECT site, date, {', '.join(ROLL_SQL)} FROM weather",
       " ".join(r.rsplit(" ", 1)[1] for r in ROLL_SQL))
def win_1(spark, d):
    df = V.weather(spark, d)
    sums = {f"rainfall_{n}d_mm": W.rolling_sum("rainfall_mm", SITE, "date", n, m) for n, m in C.RAIN_WINDOWS}
    sums |= {f"et0_{n}d_mm": W.rolling_sum("radiation_MJm2", SITE, "date", n, m) for n, m in C.ET0_WINDOWS}
    return df.withColumns(sums).select("site", "date", *sums)


@query("win_2_rolling_mean", WEATHER + f"""
    SELECT site, date, {roll('humidity_pct', 7, 1, 'avg')} AS mean_7d FROM weather""", "mean_7d")
def win_2(spark, d):
    return V.weather(spark, d).select("site", "date", W.rolling_mean(
        "humidity_pct", SITE, "date", 7).alias("mean_7d"))


@query("win_3_lags", WEATHER + "SELECT site, date, " + ", ".join(
    f"lag(rainfall_mm, {k}) OVER (PARTITION BY site ORDER BY date) AS lag{k}" for k in (1, 2, 3))
    + " FROM weather", "lag1 lag2 lag3")
def win_3(spark, d):
    cols = W.lags("rainfall_mm", SITE, "date", 3, "lag{}")
    return V.weather(spark, d).withColumns(cols).select("site", "date", *cols)


@query("win_4_leads", WEATHER + "SELECT site, date, " + ", ".join(
    f"lead(rainfall_mm, {k}) OVER (PARTITION BY site ORDER BY date) AS lead{k}" for k in C.HORIZONS)
    + " FROM weather", " ".join(f"lead{k}" for k in C.HORIZONS))
def win_4(spark, d):
    cols = W.leads("rainfall_mm", SITE, "date", 7, "lead{}")
    return V.weather(spark, d).withColumns(cols).select("site", "date", *cols)


@query("win_5_differences", WEATHER + "SELECT site, date, " + ", ".join(
    f"level_m - lag(level_m, {k}) OVER (PARTITION BY site ORDER BY date) AS diff{k}" for k in (1, 2, 3, 30))
    + " FROM weather", "diff1 diff2 diff3 diff30")
def win_5(spark, d):
    cols = {f"diff{k}": W.difference("level_m", SITE, "date", k) for k in (1, 2, 3, 30)}
    return V.weather(spark, d).withColumns(cols).select("site", "date", *cols)


@query("win_6_peak_intensity", READ + """
    , slots AS (SELECT site, station, ts, arg_max(value, src_ord) AS value FROM readings
                WHERE param = 'rainfall_mm' GROUP BY ALL),
    sums AS (SELECT *, count(value) OVER w AS n, sum(value) OVER w AS s FROM slots
             WINDOW w AS (PARTITION BY site, station ORDER BY ts ROWS 5 PRECEDING))
    SELECT site, station, CAST(ts AS DATE) AS date, max(CASE WHEN n = 6 THEN s END) AS peak
    FROM sums GROUP BY ALL""", "peak")
def win_6(spark, d):
    rain = V.readings(spark, d).where("param = 'rainfall_mm'")
    slots = aggregates.last_reading(rain, ("site", "station", "ts"), "value", "src_ord")
    return W.peak_intensity(slots, ("site", "station"), "ts", "value", "peak", block_rows=128)


@query("win_7_centred_trend", WEATHER + """
    , t AS (SELECT site, date, level_m, CASE WHEN count(level_m) OVER w >= 30 THEN avg(level_m) OVER w END AS trend
            FROM weather WINDOW w AS (PARTITION BY site ORDER BY date ROWS BETWEEN 182 PRECEDING AND 182 FOLLOWING))
    SELECT site, date, trend, level_m - trend AS residual FROM t""", "trend residual")
def win_7(spark, d):
    out = aggregates.seasonal_decomposition(V.weather(spark, d), SITE, "date", "level_m")
    return out.select("site", "date", "trend", "residual")


@query("win_8_circular_mean", WEATHER + """
    , c AS (SELECT site, doy, avg(level_m) AS v FROM weather GROUP BY ALL),
    t AS (SELECT site, doy, v, doy + 366 * unnest([-1, 0, 1]) AS place FROM c),
    s AS (SELECT *, avg(v) OVER (PARTITION BY site ORDER BY place ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS smooth
          FROM t)
    SELECT site, CAST(doy AS INT) AS doy, smooth FROM s WHERE place BETWEEN 1 AND 366""", "smooth")
def win_8(spark, d):
    means = V.weather(spark, d).groupBy("site", "doy").agg(F.avg("level_m").alias("v"))
    return W.circular_mean(means, SITE, "doy", "v", "smooth").select("site", "doy", "smooth")


@query("win_9_runs", WEATHER + """
    , f AS (SELECT site, date, temp_max_C AS v, CASE WHEN temp_max_C = lag(temp_max_C) OVER w THEN 0 ELSE 1 END AS s
            FROM weather WINDOW w AS (PARTITION BY site ORDER BY date)),
    g AS (SELECT *, sum(s) OVER (PARTITION BY site ORDER BY date) AS run FROM f)
    SELECT site, date, v, CAST(count(*) OVER (PARTITION BY site, run) AS BIGINT) AS run_length FROM g""", "v")
def win_9(spark, d):
    df = V.weather(spark, d).select("site", "date", F.col("temp_max_C").alias("v"))
    return W.runs(df, SITE, "date", "v").drop("run_id")


@query("win_10_forward_means", WEATHER + "SELECT site, date, " + ", ".join(
    f"avg(temp_max_C) OVER (PARTITION BY site ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) AS mean_{h}d"
    for h in C.LEADS) + " FROM weather", " ".join(f"mean_{h}d" for h in C.LEADS))
def win_10(spark, d):
    cols = {f"mean_{h}d": W.forward_mean("temp_max_C", SITE, "date", h) for h in C.LEADS}
    return V.weather(spark, d).withColumns(cols).select("site", "date", *cols)


SCORES = "SELECT event_type AS site, value FROM events"


@query("win_11_average_rank", f"""
    SELECT DISTINCT site, value, rank() OVER (PARTITION BY site ORDER BY value)
           + (count(*) OVER (PARTITION BY site, value) - 1) / 2.0 AS avg_rank
    FROM ({SCORES})""", "value avg_rank")
def win_11(spark, d):
    scores = V.table(spark, d, "events").select(F.col("event_type").alias("site"), "value")
    return ranks.ordered_counts(scores, SITE, "value").select(
        "site", "value", ranks.average_rank().alias("avg_rank"))


@query("win_12_empirical_cdf", f"""
    SELECT DISTINCT site, value, cume_dist() OVER (PARTITION BY site ORDER BY value)
           - 0.5 / count(*) OVER (PARTITION BY site) AS cdf FROM ({SCORES})""", "value cdf:9")
def win_12(spark, d):
    scores = V.table(spark, d, "events").select(F.col("event_type").alias("site"), "value")
    cdf = (F.col("n_below") + F.col("n") - F.lit(0.5)) / F.col("n_total")
    return ranks.ordered_counts(scores, SITE, "value").select("site", "value", cdf.alias("cdf"))


@query("win_13_active_span", DENSE + """
    SELECT site, station, min(date) FILTER (WHERE value > 200000) AS first_valid,
           max(date) FILTER (WHERE value > 200000) AS last_valid FROM dense GROUP BY ALL""")
def win_13(spark, d):
    seen = dense(spark, d).withColumn("value", F.when(F.col("value") > 200000, F.col("value")))
    return fill.active_span(seen, ("site", "station"), "date", "value")


@query("win_14_last_values", DENSE + """
    , r AS (SELECT *, row_number() OVER (PARTITION BY site, station ORDER BY date DESC) AS k
            FROM dense WHERE value IS NOT NULL)
    SELECT site, station, max(value) FILTER (WHERE k = 1) AS lag1, max(value) FILTER (WHERE k = 2) AS lag2,
           max(value) FILTER (WHERE k = 3) AS lag3 FROM r GROUP BY ALL""", "lag1 lag2 lag3")
def win_14(spark, d):
    return joins.last_values(dense(spark, d), ("site", "station"), "date", "value", 3, "lag{}")


@query("win_15_sequences", WEATHER + """
    , r AS (SELECT site, date, list([coalesce(rainfall_mm, 0), temp_max_C]) OVER w AS seen, count(*) OVER w AS n
            FROM weather WINDOW w AS (PARTITION BY site ORDER BY date ROWS 20 PRECEDING))
    SELECT site, date, CAST(21 AS INT) AS length,
           list_sum(list_transform(seen, lambda x: x[2])) AS total, CASE WHEN n < 21 THEN 0.0 ELSE seen[1][2] END AS first
    FROM r""", "total first")
def win_15(spark, d):
    out = W.sequences(V.weather(spark, d), SITE, "date", ("rainfall_mm", "temp_max_C"), C.SEQUENCE_LENGTH)
    total = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[1])
    return out.select("site", "date", F.size("sequence").alias("length"), total.alias("total"),
                      F.col("sequence")[0][1].alias("first"))


@query("win_16_running_sum", WEATHER + """
    SELECT site, date, sum(level_m) OVER (PARTITION BY site, date_trunc('week', date) ORDER BY date) AS total
    FROM weather""", "total")
def win_16(spark, d):
    df = V.weather(spark, d).withColumn("week", F.date_trunc("week", "date"))
    return df.select("site", "date", W.running_sum("level_m", ("site", "week"), "date").alias("total"))


@query("win_17_year_overlay", V.with_views(V.LEVELS_SQL) + """
    SELECT site, CAST(year(date) AS INT) AS year, CAST(dayofyear(date) AS INT) AS doy, level_m FROM levels
    WHERE level_m IS NOT NULL""", "level_m")
def win_17(spark, d):
    return W.overlay_by_year(V.levels(spark, d), SITE, "date", "level_m")


# spine and filling --------------------------------------------------------------------

@query("spn_1_daily_spine", DENSE + "SELECT site, station, date, CAST(dayofyear(date) AS INT) AS doy FROM dense")
def spn_1(spark, d):
    return fill.daily_spine(V.gappy(spark, d), ("site", "station"))


INNER_LINE = """
    , n AS (SELECT *, row_number() OVER w AS r,
        last_value(value IGNORE NULLS) OVER p AS pv,
        last_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER p AS pd,
        first_value(value IGNORE NULLS) OVER f AS nv,
        first_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER f AS nd
      FROM dense WINDOW w AS (PARTITION BY site, station ORDER BY date),
        p AS (PARTITION BY site, station ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        f AS (PARTITION BY site, station ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
"""
LINE = "pv + (nv - pv) * CAST(date - pd AS DOUBLE) / nullif(CAST(nd - pd AS DOUBLE), 0)"


@query("spn_2_resample_daily", V.with_views(LEVEL_SPINE_SQL) + ", dense AS (SELECT site, '' AS station, date, level_m AS value FROM days)"
       + INNER_LINE + f"SELECT site, date, coalesce(value, {LINE}) AS level_m FROM n", "level_m")
def spn_2(spark, d):
    return fill.resample_daily(V.levels(spark, d), SITE, "date", "level_m").drop("doy")


@query("fil_1_interpolate_prefix", DENSE + INNER_LINE
       + f"SELECT site, station, date, CASE WHEN date - pd <= 3 THEN coalesce(value, {LINE}) END AS value FROM n", "value")
def fil_1(spark, d):
    return fill.interpolate(dense(spark, d), ("site", "station"), "date", "value").drop("doy")


@query("fil_1_interpolate_whole_gap", DENSE + INNER_LINE
       + f"SELECT site, station, date, coalesce(value, CASE WHEN nd - pd - 1 <= 3 THEN {LINE} END) AS value FROM n", "value")
def fil_1b(spark, d):
    return fill.interpolate(dense(spark, d), ("site", "station"), "date", "value",
                            limit_mode="whole_gap").drop("doy")


@query("fil_2_interpolate_rows", DENSE.replace("dense AS (", "dense0 AS (") + """
    , dense AS (SELECT site, station, date, CASE WHEN value > 150000 THEN value END AS value FROM dense0)"""
       + INNER_LINE + f"SELECT site, station, date, coalesce(value, {LINE}, pv, nv, 0.0) AS value FROM n", "value")
def fil_2(spark, d):
    seen = dense(spark, d).withColumn("value", F.when(F.col("value") > 150000, F.col("value")))
    return fill.interpolate_rows(seen, ("site", "station"), "date", "value").drop("doy")


@query("fil_3_constant_and_median", DENSE + """
    SELECT site, station, date, coalesce(value, 0) AS zero,
           coalesce(value, quantile_cont(value, 0.5) OVER (PARTITION BY site, station)) AS middle
    FROM dense""", "zero middle")
def fil_3(spark, d):
    keys = ("site", "station")
    filled = fill.fill_constant(dense(spark, d), "value", 0.0, "zero")
    return fill.fill_median(filled, keys, "value", "middle").drop("value", "doy")


@query("fil_4_consensus", V.with_views(V.GAPPY_SQL) + """
    SELECT site, date, coalesce(max(value) FILTER (WHERE station = 'O'),
                                avg(value) FILTER (WHERE station <> 'O')) AS value
    FROM gappy GROUP BY ALL""", "value")
def fil_4(spark, d):
    return fill.consensus(V.gappy(spark, d), ("site", "date"), "station", "value", "O")


@query("gold_flagship", READ + """
    , daily AS (SELECT site, station, CAST(ts AS DATE) AS date, sum(value) AS value FROM readings
                WHERE param = 'rainfall_mm' GROUP BY ALL),
    spans AS (SELECT site, station, min(date) AS a, max(date) AS b FROM daily GROUP BY ALL),
    dense AS (SELECT s.site, s.station, CAST(d AS DATE) AS date, g.value
        FROM (SELECT site, station, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d FROM spans) s
        LEFT JOIN daily g ON g.site = s.site AND g.station = s.station AND g.date = CAST(s.d AS DATE))"""
       + INNER_LINE + f""", filled AS (SELECT site, station, date,
            CASE WHEN date - pd <= 3 THEN coalesce(value, {LINE}) END AS value FROM n)
    SELECT site, station, date, value, sum(value) OVER (PARTITION BY site, station ORDER BY date ROWS 6 PRECEDING)
           AS value_7d FROM filled""", "value value_7d")
def flagship(spark, d):
    from hydroflow.checks import catalog
    return catalog.flagship(spark, d)
