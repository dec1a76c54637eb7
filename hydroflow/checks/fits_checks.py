"""FIT-1 .. FIT-13 on the driver tables.

The SQL twins of one harmonic write a 3x3 system out as determinants; those of three eliminate the 7x7 system
column by column, one table after the other.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hydroflow.checks import views as V
from hydroflow.checks.registry import query
from hydroflow.operators import fill, fits as T
from hydroflow.operators.windows import difference

SITE = ("site",)
WEATHER = V.with_views(V.WEATHER_SQL)


def det3(m):
    return " ".join(f"{s}({a})*({b})*({c})" for s, a, b, c in (
        ("+", m[0][0], m[1][1], m[2][2]), ("-", m[0][0], m[1][2], m[2][1]), ("-", m[0][1], m[1][0], m[2][2]),
        ("+", m[0][1], m[1][2], m[2][0]), ("+", m[0][2], m[1][0], m[2][1]), ("-", m[0][2], m[1][1], m[2][0])))


def solve3(gram, right, names):
    whole = det3(gram)
    return ", ".join(f"({det3([[right[r] if c == i else gram[r][c] for c in range(3)] for r in range(3)])})"
                     f" / ({whole}) AS {n}" for i, n in enumerate(names))


def harmonic_sql(name: str, source: str, y: str, keys: str = "site", where: str = "true", harmonics: int = 1) -> str:
    """CTE ``name``(keys, c0, c1, c2 ...): the least-squares fit of ``y`` on doy."""
    if harmonics > 1:
        return eliminated(name, source, y, keys, where, harmonics)
    gram = [["n", "c", "s"], ["c", "cc", "cs"], ["s", "cs", "ss"]]
    return f"""{name}_sums AS (SELECT {keys}, count(y) AS n, sum(c) AS c, sum(s) AS s, sum(c * c) AS cc, sum(c * s) AS cs,
            sum(s * s) AS ss, sum(y) AS y, sum(c * y) AS cy, sum(s * y) AS sy
        FROM (SELECT {keys}, cos(2 * pi() * doy / 365) AS c, sin(2 * pi() * doy / 365) AS s, {y} AS y
              FROM {source} WHERE {where}) WHERE y IS NOT NULL GROUP BY {keys}),
    {name} AS (SELECT {keys}, n AS n_fitted, {solve3(gram, ['y', 'cy', 'sy'], ('c0', 'c1', 'c2'))} FROM {name}_sums)"""


def waves(doy: str, harmonics: int) -> list[str]:
    return ["1.0::DOUBLE"] + [f"{f}({2 * k} * pi() * {doy} / 365)" for k in range(1, harmonics + 1) for f in ("cos", "sin")]


def eliminated(name: str, source: str, y: str, keys: str, where: str, harmonics: int) -> str:
    """``harmonic_sql`` by Gauss-Jordan elimination: table p has column p of the normal equations cleared."""
    size = 2 * harmonics + 1
    rows = ", ".join(f"{w} AS b{i}" for i, w in enumerate(waves("doy", harmonics)))
    cells = [f"sum(b{i} * {f'b{j}' if j < size else 'y'}) AS a{i}_{j}" for i in range(size) for j in range(size + 1)]
    out = [f"""{name}_0 AS (SELECT {keys}, count(*) AS n_fitted, {', '.join(cells)}
        FROM (SELECT {keys}, {rows}, {y} AS y FROM {source} WHERE {where}) WHERE y IS NOT NULL GROUP BY {keys})"""]
    for p in range(size):
        cells = [f"a{p}_{j} / a{p}_{p} AS a{i}_{j}" if i == p else f"a{i}_{j} - a{i}_{p} / a{p}_{p} * a{p}_{j} AS a{i}_{j}"
                 for i in range(size) for j in range(p + 1, size + 1)]
        out.append(f"{name}_{p + 1} AS (SELECT {keys}, n_fitted, {', '.join(cells)} FROM {name}_{p})")
    last = ", ".join(f"a{i}_{size} AS c{i}" for i in range(size))
    return ", ".join([*out, f"{name} AS (SELECT {keys}, n_fitted, {last} FROM {name}_{size})"])


def value_sql(alias: str, doy: str = "doy", harmonics: int = 1) -> str:
    if harmonics > 1:
        return "(" + " + ".join(f"{alias}.c{i} * {w}" for i, w in enumerate(waves(doy, harmonics))) + ")"
    return f"({alias}.c0 + {alias}.c1 * cos(2 * pi() * {doy} / 365) + {alias}.c2 * sin(2 * pi() * {doy} / 365))"


def clear_sql(source: str, keys: tuple[str, ...] = ("site",), where: str = "true", harmonics: int = 1, fit: str = "h", name: str = "clear") -> str:
    """CTE ``name``: the fit raised by the 0.9 quantile of its residuals."""
    own, same = ", ".join(f"{fit}.{k}" for k in keys), " AND ".join(f"w.{k} = {fit}.{k}" for k in keys)
    rest = ", ".join(f"any_value({fit}.c{i}) AS c{i}" for i in range(1, 2 * harmonics + 1))
    return f"""{name} AS (SELECT {own}, any_value({fit}.c0) + quantile_cont(dtr - {value_sql(fit, 'doy', harmonics)}, 0.9) AS c0, {rest}
        FROM {source} w JOIN {fit} ON {same} WHERE {where} GROUP BY {own})"""


def days(spark, d):
    return V.weather(spark, d).withColumn("dtr", F.col("temp_max_C") - F.col("temp_min_C")) \
            .withColumn("et0_mm", F.col("radiation_MJm2") / 4)


DAYS = V.with_views(V.WEATHER_SQL.replace("weather AS (", "weather0 AS ("),
                    "weather AS (SELECT *, temp_max_C - temp_min_C AS dtr, radiation_MJm2 / 4 AS et0_mm FROM weather0)")


@query("fit_1_quadratic", WEATHER + """
    , m AS (SELECT site, avg(humidity_pct) AS mx, avg(inflow_m3) / 1e4 AS my FROM weather GROUP BY ALL),
    z AS (SELECT w.site, humidity_pct - mx AS z, inflow_m3 / 1e4 - my AS v, mx, my FROM weather w JOIN m ON w.site = m.site),
    s AS (SELECT site, any_value(mx) AS mx, any_value(my) AS my, CAST(count(*) AS DOUBLE) AS s0, sum(z) AS s1, sum(z*z) AS s2,
        sum(z*z*z) AS s3, sum(z*z*z*z) AS s4, sum(v) AS t0, sum(z*v) AS t1, sum(z*z*v) AS t2, sum(v*v) AS vv FROM z GROUP BY site),
    k AS (SELECT *, """ + solve3([["s4", "s3", "s2"], ["s3", "s2", "s1"], ["s2", "s1", "s0"]],
                                  ["t2", "t1", "t0"], ("qa", "qb", "qc")) + """ FROM s)
    SELECT site, qa AS a, qb - 2 * qa * mx AS b, qc + my - qb * mx + qa * mx * mx AS c,
           1 - (vv - qa * t2 - qb * t1 - qc * t0) / vv AS r2 FROM k""", "a b c r2")
def fit_1(spark, d):
    df = V.weather(spark, d).withColumn("y", F.col("inflow_m3") / 1e4)
    fit = T.fit_quadratic(df, SITE, "humidity_pct", "y")
    c = F.col("coefficients")
    return fit.select("site", c[0].alias("a"), c[1].alias("b"), c[2].alias("c"), "r2")


def coefficients(fit, *names):
    c = F.col("coefficients")
    return [c[i].alias(n) for i, n in enumerate(names)]


@query("fit_2_harmonic", V.with_views(V.WEATHER_SQL, harmonic_sql("h", "weather", "temp_max_C"))
       + "SELECT site, n_fitted, c0, c1, c2 FROM h", "c0 c1 c2")
def fit_2(spark, d):
    fit = T.fit_harmonic(V.weather(spark, d), SITE, "doy", "temp_max_C", 1)
    return fit.select("site", "n_fitted", *coefficients(fit, "c0", "c1", "c2"))


SEVEN = [f"c{i}" for i in range(7)]


@query("fit_2_three_harmonics", V.with_views(V.WEATHER_SQL, harmonic_sql("h", "weather", "temp_max_C", harmonics=3))
       + f"SELECT site, {', '.join(SEVEN)} FROM h", " ".join(SEVEN))
def fit_2b(spark, d):
    fit = T.fit_harmonic(V.weather(spark, d), SITE, "doy", "temp_max_C", 3)
    return fit.select("site", *coefficients(fit, *SEVEN))


@query("fit_3_anomaly", V.with_views(V.WEATHER_SQL, harmonic_sql("h", "weather", "temp_max_C")) + f"""
    , r AS (SELECT w.site, w.date, temp_max_C - {value_sql('h')} AS resid FROM weather w JOIN h ON w.site = h.site)
    SELECT site, date, resid / stddev_pop(resid) OVER (PARTITION BY site) AS anomaly_z FROM r""", "anomaly_z")
def fit_3(spark, d):
    df = V.weather(spark, d)
    fit = T.fit_harmonic(df, SITE, "doy", "temp_max_C", 1)
    return T.anomaly(df, SITE, "doy", "temp_max_C", fit, harmonics=1).select("site", "date", "anomaly_z")


@query("fit_3_anomaly_three_harmonics", V.with_views(V.WEATHER_SQL, harmonic_sql("h", "weather", "temp_max_C", harmonics=3)) + f"""
    , r AS (SELECT w.site, w.date, temp_max_C - {value_sql('h', harmonics=3)} AS resid FROM weather w JOIN h ON w.site = h.site)
    SELECT site, date, resid / stddev_pop(resid) OVER (PARTITION BY site) AS anomaly_z FROM r""", "anomaly_z")
def fit_3b(spark, d):
    df = V.weather(spark, d)
    fit = T.fit_harmonic(df, SITE, "doy", "temp_max_C")
    return T.anomaly(df, SITE, "doy", "temp_max_C", fit).select("site", "date", "anomaly_z")


@query("fit_4_seasonal_anomaly_three_harmonics", V.with_views(
    V.WEATHER_SQL, harmonic_sql("h", "weather", "temp_max_C", harmonics=3),
    f"r AS (SELECT w.site, w.date, w.doy, temp_max_C - {value_sql('h', harmonics=3)} AS resid FROM weather w JOIN h ON w.site = h.site)",
    harmonic_sql("v", "r", "resid * resid", harmonics=3)) + f"""
    SELECT r.site, date, resid / sqrt(greatest({value_sql('v', harmonics=3)}, 1e-9)) AS anomaly_z FROM r JOIN v ON r.site = v.site""",
       "anomaly_z")
def fit_4b(spark, d):
    df = V.weather(spark, d)
    fit = T.fit_harmonic(df, SITE, "doy", "temp_max_C")
    spread = T.fit_variance(df, SITE, "doy", "temp_max_C", fit)
    return T.anomaly(df, SITE, "doy", "temp_max_C", fit, variance_fit=spread).select("site", "date", "anomaly_z")


@query("fit_4_seasonal_anomaly", V.with_views(
    V.WEATHER_SQL, harmonic_sql("h", "weather", "temp_max_C"),
    f"r AS (SELECT w.site, w.date, w.doy, temp_max_C - {value_sql('h')} AS resid FROM weather w JOIN h ON w.site = h.site)",
    harmonic_sql("v", "r", "resid * resid")) + f"""
    SELECT r.site, date, resid / sqrt(greatest({value_sql('v')}, 1e-9)) AS anomaly_z FROM r JOIN v ON r.site = v.site""",
       "anomaly_z")
def fit_4(spark, d):
    df = V.weather(spark, d)
    fit = T.fit_harmonic(df, SITE, "doy", "temp_max_C", 1)
    spread = T.fit_variance(df, SITE, "doy", "temp_max_C", fit, 1)
    return T.anomaly(df, SITE, "doy", "temp_max_C", fit, variance_fit=spread, harmonics=1) \
            .select("site", "date", "anomaly_z")


@query("fit_5_rain_normals", V.with_views(
    V.WEATHER_SQL, harmonic_sql("p", "weather", "CAST(rainfall_mm > 1 AS INT)"),
    harmonic_sql("a", "weather", "rainfall_mm", where="rainfall_mm > 1")) + """
    SELECT p.site, p.c0 AS p0, p.c1 AS p1, p.c2 AS p2, a.c0 AS a0, a.c1 AS a1, a.c2 AS a2
    FROM p JOIN a ON p.site = a.site""", "p0 p1 p2 a0 a1 a2")
def fit_5(spark, d):
    fit = T.fit_rain(V.weather(spark, d), SITE, "doy", "rainfall_mm", harmonics=1)
    return fit.select("site", *[F.col(c)[i].alias(f"{n}{i}") for c, n in (("p_wet", "p"), ("amount", "a"))
                                for i in range(3)])


#: Rain of the queries with three harmonics: seven coefficients need more wet days than ``rainfall_mm`` has on small tables.
DRIZZLE = "wind_speed_ms"


@query("fit_5_rain_normals_three_harmonics", V.with_views(
    V.WEATHER_SQL, harmonic_sql("p", "weather", f"CAST({DRIZZLE} > 1 AS INT)", harmonics=3),
    harmonic_sql("a", "weather", DRIZZLE, where=f"{DRIZZLE} > 1", harmonics=3)) + "SELECT p.site, "
       + ", ".join(f"{n}.c{i} AS {n}{i}" for n in "pa" for i in range(7)) + " FROM p JOIN a ON p.site = a.site",
       " ".join(f"{n}{i}" for n in "pa" for i in range(7)))
def fit_5b(spark, d):
    fit = T.fit_rain(V.weather(spark, d), SITE, "doy", DRIZZLE)
    return fit.select("site", *[F.col(c)[i].alias(f"{n}{i}") for c, n in (("p_wet", "p"), ("amount", "a"))
                                for i in range(7)])


CLEAR_SQL = [harmonic_sql("h", "weather", "dtr"), clear_sql("weather")]
CLEAR_SQL_3 = [harmonic_sql("h", "weather", "dtr", harmonics=3), clear_sql("weather", harmonics=3)]


@query("fit_6_clear_sky", DAYS[:-1] + ", " + ", ".join(CLEAR_SQL) + " SELECT * FROM clear", "c0 c1 c2")
def fit_6(spark, d):
    fit = T.fit_clear_sky(days(spark, d), SITE, "doy", "dtr", harmonics=1)
    return fit.select("site", *coefficients(fit, "c0", "c1", "c2"))


@query("fit_6_clear_sky_three_harmonics", DAYS[:-1] + ", " + ", ".join(CLEAR_SQL_3) + " SELECT * FROM clear", " ".join(SEVEN))
def fit_6b(spark, d):
    fit = T.fit_clear_sky(days(spark, d), SITE, "doy", "dtr")
    return fit.select("site", *coefficients(fit, *SEVEN))


NORMALS = {"temp_max_clim": "temp_max_C", "temp_min_clim": "temp_min_C", "et0_clim": "et0_mm"}
CLIMATE = "temp_max_clim temp_min_clim et0_clim dtr_clim dtr_clearsky p_wet_clim amount_clim outflow_clim:4"


def climatology_sql(k: int, rain: str) -> str:
    def value(alias):
        return value_sql(alias, "g.doy", k)
    return DAYS[:-1] + ", " + ", ".join([
        *(CLEAR_SQL if k == 1 else CLEAR_SQL_3), *[harmonic_sql(f"f_{n}", "weather", c, harmonics=k) for n, c in NORMALS.items()],
        harmonic_sql("p", "weather", f"CAST({rain} > 1 AS INT)", harmonics=k),
        harmonic_sql("a", "weather", rain, where=f"{rain} > 1", harmonics=k),
        harmonic_sql("o", "weather", "outflow_m3", where="date >= DATE '1997-01-01'", harmonics=k)]) + \
        ", grid AS (SELECT site, CAST(unnest(range(1, 367)) AS INT) AS doy FROM h) SELECT g.site, g.doy, " + \
        ", ".join(f"{value(f'f_{n}')} AS {n}" for n in NORMALS) + \
        f""", {value('h')} AS dtr_clim, {value('clear')} AS dtr_clearsky,
        greatest(least({value('p')}, 1), 0) AS p_wet_clim, greatest({value('a')}, 0) AS amount_clim,
        {value('o')} AS outflow_clim FROM grid g JOIN h ON g.site = h.site JOIN clear ON g.site = clear.site
        JOIN p ON g.site = p.site JOIN a ON g.site = a.site JOIN o ON g.site = o.site """ + \
        " ".join(f"JOIN f_{n} ON g.site = f_{n}.site" for n in NORMALS)


@query("fit_7_climatology", climatology_sql(1, "rainfall_mm"), CLIMATE)
def fit_7(spark, d):
    df = days(spark, d)
    return T.climatology(df, df, SITE, "1997-01-01", 1)


@query("fit_7_climatology_three_harmonics", climatology_sql(3, DRIZZLE), CLIMATE)
def fit_7b(spark, d):
    df = days(spark, d).withColumn("rainfall_mm", F.col(DRIZZLE))
    return T.climatology(df, df, SITE, "1997-01-01")


DEEP_SQL = V.LEVELS_SQL + """, ref AS (SELECT site, date, level_m * 0.9 + 1 AS level_m FROM levels
        WHERE date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31'),
    r AS (SELECT site, month(date) AS m, list(level_m ORDER BY level_m) AS vals, count(*) AS n FROM ref GROUP BY ALL),
    s AS (SELECT site, date, level_m, month(date) AS m,
        (cume_dist() OVER (PARTITION BY site, month(date) ORDER BY level_m)
         - 0.5 / count(*) OVER (PARTITION BY site, month(date))) AS q,
        count(*) FILTER (WHERE date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31')
          OVER (PARTITION BY site, month(date)) AS n_src FROM levels),
    p AS (SELECT s.*, vals, n, least(greatest(q * n - 0.5, 0), n - 1) AS pos FROM s LEFT JOIN r ON s.site = r.site AND s.m = r.m)"""


@query("fit_8_quantile_map", V.with_views(DEEP_SQL) + """
    SELECT site, date, CASE WHEN n >= 30 AND n_src >= 30 THEN vals[CAST(floor(pos) AS INT) + 1]
        + (vals[CAST(ceil(pos) AS INT) + 1] - vals[CAST(floor(pos) AS INT) + 1]) * (pos - floor(pos))
        ELSE level_m END AS level_m FROM p""", "level_m")
def fit_8(spark, d):
    deep = V.levels(spark, d)
    ref = deep.withColumn("level_m", F.col("level_m") * 0.9 + 1)
    return T.quantile_map(deep, ref, SITE, "level_m", ("1998-01-01", "2000-12-31"))


@query("fit_9_linear_calibration", WEATHER + """
    SELECT site, regr_slope(radiation_MJm2, temp_max_C) AS slope, regr_intercept(radiation_MJm2, temp_max_C) AS intercept,
           CAST(regr_count(radiation_MJm2, temp_max_C) AS BIGINT) AS n FROM weather GROUP BY ALL""", "slope intercept")
def fit_9(spark, d):
    return T.fit_line(V.weather(spark, d), SITE, "temp_max_C", "radiation_MJm2")


def inflow_sql(k: int) -> str:
    return V.with_views(
        V.WEATHER_SQL, """g AS (SELECT site, doy, radiation_MJm2 / 4 AS et, outflow_m3,
            level_m - lag(level_m) OVER (PARTITION BY site ORDER BY date) AS dv FROM weather)""",
        harmonic_sql("h", "g", "dv + et * 166 * 0.001 + outflow_m3 / 1e6", harmonics=k)) + f"""
        SELECT site, doy, {value_sql('h', harmonics=k)} AS inflow_clim_Mm3
        FROM (SELECT *, CAST(unnest(range(1, 367)) AS INT) AS doy FROM h) h"""


def inflow_days(spark, d):
    return days(spark, d).withColumn("volume_change_Mm3", difference("level_m", SITE, "date"))


@query("fit_10_inflow_climatology", inflow_sql(1), "inflow_clim_Mm3")
def fit_10(spark, d):
    return T.inflow_climatology(inflow_days(spark, d), SITE, 1)


@query("fit_10_inflow_climatology_three_harmonics", inflow_sql(3), "inflow_clim_Mm3")
def fit_10b(spark, d):
    return T.inflow_climatology(inflow_days(spark, d), SITE)


TEST_YEARS = (1998, 1999, 2000)
DENSE_LEVELS_SQL = V.LEVELS_SQL + """, spans AS (SELECT site, min(date) AS a, max(date) AS b FROM levels GROUP BY ALL),
    n AS (SELECT s.site, CAST(d AS DATE) AS date, l.level_m AS value,
        last_value(l.level_m IGNORE NULLS) OVER p AS pv, last_value(l.date IGNORE NULLS) OVER p AS pd,
        first_value(l.level_m IGNORE NULLS) OVER f AS nv, first_value(l.date IGNORE NULLS) OVER f AS nd
      FROM (SELECT site, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d FROM spans) s
      LEFT JOIN levels l ON l.site = s.site AND l.date = CAST(s.d AS DATE)
      WINDOW p AS (PARTITION BY s.site ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             f AS (PARTITION BY s.site ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    daily AS (SELECT site, date, coalesce(value, pv + (nv - pv) * CAST(date - pd AS DOUBLE)
                                          / nullif(CAST(nd - pd AS DOUBLE), 0)) AS level_m FROM n),
    steps AS (SELECT site, year(date) AS y, dayofyear(date) AS doy,
                     level_m - lag(level_m) OVER (PARTITION BY site ORDER BY date) AS dl FROM daily)"""


def rates_sql(years) -> str:
    listed = ", ".join(map(str, years))
    return DENSE_LEVELS_SQL + f""",
    sites AS (SELECT DISTINCT site FROM levels),
    grid AS (SELECT site, CAST(unnest([{listed}]) AS INT) AS test_year FROM sites),
    spine AS (SELECT *, CAST(unnest(range(1, 367)) AS INT) AS doy FROM grid),
    means AS (SELECT g.site, g.test_year, s.doy, avg(dl) AS v FROM grid g JOIN steps s ON g.site = s.site
              AND s.y <> g.test_year AND s.y >= 1996 WHERE dl IS NOT NULL GROUP BY ALL),
    holes AS (SELECT a.site, a.test_year, a.doy, m.v FROM spine a LEFT JOIN means m
              ON a.site = m.site AND a.test_year = m.test_year AND a.doy = m.doy),
    line AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN v IS NOT NULL THEN doy END IGNORE NULLS) OVER p AS pd,
        first_value(v IGNORE NULLS) OVER f AS nv, first_value(CASE WHEN v IS NOT NULL THEN doy END IGNORE NULLS) OVER f AS nd
      FROM holes WINDOW p AS (PARTITION BY site, test_year ORDER BY doy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             f AS (PARTITION BY site, test_year ORDER BY doy ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    filled AS (SELECT site, test_year, doy, coalesce(v, pv + (nv - pv) * CAST(doy - pd AS DOUBLE) / nullif(nd - pd, 0), pv) AS v
               FROM line),
    turned AS (SELECT site, test_year, doy, v, doy + 366 * unnest([-1, 0, 1]) AS place FROM filled),
    rates AS (SELECT site, test_year, doy, rate FROM (SELECT *, avg(v) OVER (PARTITION BY site, test_year ORDER BY place
        ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS rate FROM turned) WHERE place BETWEEN 1 AND 366)"""


def daily_levels(spark, d):
    return fill.resample_daily(V.levels(spark, d), SITE, "date", "level_m").drop("doy")


@query("fit_11_recession_rates", V.with_views(rates_sql(TEST_YEARS)) + "SELECT * FROM rates", "rate")
def fit_11(spark, d):
    return T.recession_rates(daily_levels(spark, d), SITE, "date", "level_m", 1996, TEST_YEARS)


@query("fit_13_standardize", WEATHER + """
    SELECT site, date, avg(level_m) OVER (PARTITION BY site) AS level_m_mean,
           greatest(stddev_pop(level_m) OVER (PARTITION BY site), 1e-8) AS level_m_sigma,
           (level_m - avg(level_m) OVER (PARTITION BY site)) / stddev_pop(level_m) OVER (PARTITION BY site) AS level_m_std,
           level_m AS back FROM weather""", "level_m_mean level_m_sigma level_m_std back")
def fit_13(spark, d):
    out = T.standardize(V.weather(spark, d).select("site", "date", "level_m"), SITE, "level_m")
    return out.withColumn("back", T.unstandardize("level_m", "level_m_std")).drop("level_m")
