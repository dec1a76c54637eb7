"""FN-1 .. FN-17 on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydroflow import config as C
from hydroflow.checks import views as V
from hydroflow.checks.registry import query
from hydroflow.functions import meteo as M
from hydroflow.functions import scalars as S
from hydroflow.operators.fill import on_spine

WEATHER = V.with_views(V.WEATHER_SQL)


def es(t):
    return f"0.6108 * exp(17.27 * {t} / ({t} + 237.3))"


EA = f"({es('temp_mean_C')} * humidity_pct / 100)"
DECL = "(0.409 * sin(2 * pi() / 365 * doy - 1.39))"
LAT = "radians(32.82)"
OMEGA = f"acos(greatest(least(-tan({LAT}) * tan({DECL}), 1), -1))"
RA = f"""(24 * 60 / pi() * 0.0820 * (1 + 0.033 * cos(2 * pi() / 365 * doy)) *
    ({OMEGA} * sin({LAT}) * sin({DECL}) + cos({LAT}) * cos({DECL}) * sin({OMEGA})))"""


def cols(df, **columns):
    return df.select("site", "date", *[c.alias(n) for n, c in columns.items()])


@query("fn_1_saturation_vapour", WEATHER + f"SELECT site, date, {es('temp_mean_C')} AS es FROM weather", "es")
def fn_1(spark, d):
    return cols(V.weather(spark, d), es=M.saturation_vapour_pressure("temp_mean_C"))


@query("fn_2_vapour_deficit", WEATHER + f"""
    SELECT site, date, greatest({es('temp_mean_C')} - {EA}, 0) AS vpd FROM weather""", "vpd")
def fn_2(spark, d):
    return cols(V.weather(spark, d), vpd=M.vpd("temp_mean_C", "humidity_pct"))


@query("fn_3_astronomy", WEATHER + f"""
    SELECT site, date, {DECL} AS decl, 24 / pi() * {OMEGA} AS hours, {RA} AS ra FROM weather""", "decl hours ra")
def fn_3(spark, d):
    return cols(V.weather(spark, d), decl=M.solar_declination("doy"), hours=M.daylength_hours("doy"),
                ra=M.extraterrestrial_radiation("doy"))


GAMMA = 0.000665 * 101.3 * ((293 - 0.0065 * -212.0) / 293) ** 5.26
PM_SQL = f"""pm AS (SELECT *, wind_speed_ms * (4.87 / ln(67.8 * 10 - 5.42)) AS u2, {GAMMA!r} AS g,
        ({es('temp_max_C')} + {es('temp_min_C')}) / 2 AS es2, {EA} AS ea,
        4098 * {es('temp_mean_C')} / pow(temp_mean_C + 237.3, 2) AS delta,
        (0.75 + 2e-5 * -212) * {RA} AS rso FROM weather),
    pn AS (SELECT *, 0.77 * radiation_MJm2 - 4.903e-9 * (pow(temp_max_C + 273.16, 4) + pow(temp_min_C + 273.16, 4)) / 2
        * (0.34 - 0.14 * sqrt(greatest(ea, 0)))
        * (1.35 * least(greatest(radiation_MJm2 / rso, 0.3), 1.0) - 0.35) AS rn FROM pm),
    et AS (SELECT *, greatest((0.408 * delta * rn + g * (900 / (temp_mean_C + 273)) * u2 * (es2 - ea))
        / (delta + g * (1 + 0.34 * u2)), 0) AS et0_mm FROM pn)"""


def et0():
    return M.penman_monteith("temp_mean_C", "temp_max_C", "temp_min_C", "humidity_pct", "wind_speed_ms",
                             "radiation_MJm2", F.col("doy").cast("double"))


@query("fn_4_penman_monteith", V.with_views(V.WEATHER_SQL, PM_SQL) + "SELECT site, date, et0_mm FROM et", "et0_mm")
def fn_4(spark, d):
    return cols(V.weather(spark, d), et0_mm=et0())


HS = f"0.0023 * 0.408 * {RA} * ((temp_max_C + temp_min_C) / 2 + 17.8) * sqrt(greatest(temp_max_C - temp_min_C, 0))"


@query("fn_5_hargreaves", WEATHER + f"""
    SELECT site, date, {HS} AS raw, greatest(1.0619 * {HS} + 0.8113, 0) AS calibrated FROM weather""", "raw calibrated")
def fn_5(spark, d):
    return cols(V.weather(spark, d), raw=M.hargreaves("temp_max_C", "temp_min_C", "doy"),
                calibrated=M.hargreaves_calibrated("temp_max_C", "temp_min_C", "doy"))


@query("fn_6_cloud_index", WEATHER + """
    SELECT site, date, 1 - least(greatest(sqrt(temp_max_C - temp_min_C) / sqrt(greatest(humidity_pct, 1e-9)), 0), 1)
           AS cloud FROM weather""", "cloud")
def fn_6(spark, d):
    return cols(V.weather(spark, d), cloud=M.cloud_index(F.col("temp_max_C") - F.col("temp_min_C"), "humidity_pct"))


@query("fn_7_seasonality", WEATHER + "SELECT site, date, sin(2 * pi() * doy / 365.25) AS season_sin, "
       "cos(2 * pi() * doy / 365.25) AS season_cos, " + ", ".join(
           f"exp(ln(0.05) / 2025 * pow(least(abs(doy - {c}), 365 - abs(doy - {c})), 2)) AS rbf_{n}"
           for n, c in C.RBF_CENTRES.items()) + " FROM weather",
       "season_sin season_cos " + " ".join(C.RBF_FEATURES))
def fn_7(spark, d):
    made = M.seasonality("doy")
    return cols(V.weather(spark, d), **{k: made[k] for k in (*C.SEASON_FEATURES, *C.RBF_FEATURES)})


@query("fn_8_harmonic_row", WEATHER + "SELECT site, date, " + ", ".join(
    f"{f}(2 * pi() * {k} * doy / 365) AS {f}{k}" for k in (1, 2, 3) for f in ("cos", "sin")) + " FROM weather",
       "cos1 sin1 cos2 sin2 cos3 sin3")
def fn_8(spark, d):
    row = M.harmonic_row("doy", 3)[1:]
    return cols(V.weather(spark, d), **{f"{f}{k}": row[2 * k - 2 + i] for k in (1, 2, 3)
                                        for i, f in enumerate(("cos", "sin"))})


@query("fn_9_transforms", WEATHER + """
    , c AS (SELECT site, date, inflow_m3, inflow_m3 / 1e5 - 2 AS x FROM weather)
    SELECT site, date, ln(greatest(inflow_m3, 1)) AS l, exp(ln(greatest(inflow_m3, 1))) / 1e5 AS li,
           sign(x) * ln(1 + abs(x)) AS s, x AS si, CASE WHEN x > 0 THEN ln(1 + x) END AS p FROM c""", "l li s si p")
def fn_9(spark, d):
    df = V.weather(spark, d).withColumn("x", F.col("inflow_m3") / 1e5 - 2)
    return cols(df, l=S.log_floor("inflow_m3"), li=S.log_floor_inverse(S.log_floor("inflow_m3")) / 1e5,
                s=S.signed_log1p("x"), si=S.signed_log1p_inverse(S.signed_log1p("x")), p=S.log1p_positive("x"))


A2, A1, A0 = C.VOLUME_TO_LEVEL


@query("fn_10_polynomial", WEATHER + f"""
    SELECT site, date, {A2!r} * v * v + {A1!r} * v + {A0!r} AS level
    FROM (SELECT site, date, 3500 + humidity_pct * 10 AS v FROM weather)""", "level")
def fn_10(spark, d):
    volume = F.lit(3500) + F.col("humidity_pct") * 10
    return cols(V.weather(spark, d), level=S.polyval(F.array(*[F.lit(c) for c in C.VOLUME_TO_LEVEL]), volume))


@query("fn_11_inverse_quadratic", WEATHER + f"""
    , r AS (SELECT site, date, sqrt({A1!r} * {A1!r} - 4 * {A2!r} * ({A0!r} - level_m)) AS s FROM weather),
    q AS (SELECT site, date, (-{A1!r} + s) / (2 * {A2!r}) AS v1, (-{A1!r} - s) / (2 * {A2!r}) AS v2 FROM r)
    SELECT site, date, CASE WHEN v1 BETWEEN 2000 AND 6000 THEN v1 WHEN v2 BETWEEN 2000 AND 6000 THEN v2 END AS volume
    FROM q""", "volume:4")
def fn_11(spark, d):
    return cols(V.weather(spark, d), volume=S.volume_from_level("level_m"))


@query("fn_12_clip", V.with_views(V.GAPPY_SPINE_SQL) + """
    SELECT site, station, date, CASE WHEN value IS NOT NULL THEN least(greatest(value, 100000), 300000) END AS both,
           CASE WHEN value IS NOT NULL THEN greatest(value, 200000) END AS low FROM dense""", "both low")
def fn_12(spark, d):
    dense = on_spine(V.gappy(spark, d), ("site", "station"))
    return dense.select("site", "station", "date", S.clip("value", 100000, 300000).alias("both"),
                        S.clip("value", low=200000).alias("low"))


@query("fn_13_text", """
    SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'Brand one' WHEN 'Brand#2' THEN 'Brand two' ELSE p_brand END AS brand,
           CAST(replace(p_size || '%', '%', '') AS DOUBLE) AS size, starts_with(p_name, 'red') AS is_red,
           suffix(p_name, 'ring') AS is_ring, split_part(p_name, ' ', 1) AS first,
           printf('%s (%d)', p_type, p_size) AS label FROM part""", "size")
def fn_13(spark, d):
    return V.table(spark, d, "part").select(
        "p_partkey", S.replace_by_map(F.concat(F.lit(" "), "p_brand"), {"Brand#1": "Brand one", "Brand#2": "Brand two"})
        .alias("brand"), S.strip_number(F.concat(F.col("p_size").cast("string"), F.lit("%"))).alias("size"),
        F.col("p_name").startswith("red").alias("is_red"), F.col("p_name").endswith("ring").alias("is_ring"),
        S.first_token("p_name", " ").alias("first"), F.format_string("%s (%d)", "p_type", "p_size").alias("label"))


@query("fn_14_dates", """
    SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m,
           CAST(dayofyear(o_orderdate) AS INT) AS doy, CAST(o_orderdate AS DATE) + 30 AS later,
           CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS INT) AS gap,
           strftime(o_orderdate, '%d/%m/%Y') AS label FROM orders""")
def fn_14(spark, d):
    day = F.to_date("o_orderdate")
    return V.table(spark, d, "orders").select(
        "o_orderkey", F.year(day).alias("y"), F.month(day).alias("m"), F.dayofyear(day).alias("doy"),
        F.date_add(day, 30).alias("later"), F.datediff(day, F.lit("1995-01-01").cast("date")).alias("gap"),
        F.date_format(day, "dd/MM/yyyy").alias("label"))


@query("fn_15_balances", WEATHER + """
    SELECT site, date, rainfall_mm - radiation_MJm2 AS balance, inflow_m3 - outflow_m3 AS net,
           temp_max_C - temp_min_C AS dtr, (temp_max_C + temp_min_C) / 2 AS mean FROM weather""", "balance net dtr mean")
def fn_15(spark, d):
    return cols(V.weather(spark, d), balance=F.col("rainfall_mm") - F.col("radiation_MJm2"),
                net=F.col("inflow_m3") - F.col("outflow_m3"),
                dtr=F.col("temp_max_C") - F.col("temp_min_C"), mean=(F.col("temp_max_C") + F.col("temp_min_C")) / 2)


@query("fn_16_line_distances", WEATHER + """
    SELECT site, date, level_m + 213 AS above_lower_m, -208.9 - level_m AS below_upper_m,
           abs(level_m + 213) * 220 AS buffer_Mm3, level_m - 0.654 / 300 AS band_low, level_m + 0.654 / 300 AS band_high
    FROM weather""", "above_lower_m below_upper_m buffer_Mm3 band_low band_high")
def fn_16(spark, d):
    return cols(V.weather(spark, d), **S.line_distances("level_m", -213.0, -208.9), **S.band("level_m"))


@query("fn_17_nested", """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k,
           CAST(json_extract_string(props, '$.k') AS INT) * value AS weighted FROM events""", "weighted")
def fn_17(spark, d):
    parsed = F.from_json("props", "map<string,int>")["k"]
    pairs = F.arrays_zip(F.array(parsed).alias("k"), F.array("value").alias("v"))
    total = F.aggregate(F.transform(pairs, lambda p: p["k"] * p["v"]), F.lit(0.0), lambda a, x: a + x)
    return V.table(spark, d, "events").select("event_id", parsed.alias("k"), total.alias("weighted"))
