"""Formulas, fits and recurrences against numpy."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hydroflow import config as C
from hydroflow.functions import meteo as M
from hydroflow.functions import scalars as S
from hydroflow.operators import fits, recurrences as R
from test_sources import CURVE

DAY0 = dt.date(2012, 1, 1)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_clip_keeps_null(spark):
    row = one(spark, a=S.clip(F.lit(None).cast("double"), 0, 1), b=S.clip(F.lit(5.0), 0, 1), c=S.clip(F.lit(-5.0), low=0))
    assert (row.a, row.b, row.c) == (None, 1, 0)


def test_text_to_number(spark):
    texts = ["1.5", " - ", "", "nan", "x", " 2 "]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.to_double("t")).collect()]
    assert got == [1.5, None, None, None, None, 2.0]
    assert one(spark, v=S.strip_number(F.lit("4,320%"))).v == 4320


def test_signed_log_round_trip(spark):
    row = one(spark, a=S.signed_log1p_inverse(S.signed_log1p(F.lit(-3.5))), b=S.log_floor_inverse(S.log_floor(F.lit(0.2))))
    assert row.a == pytest.approx(-3.5) and row.b == 1


def test_volume_level_round_trip(spark):
    df = spark.createDataFrame([(v,) for v in (3660.0, 4000.0, 4320.0)], "v double")
    got = df.select("v", S.volume_from_level(S.level_from_volume("v")).alias("w")).collect()
    assert all(r.w == pytest.approx(r.v, abs=1e-6) for r in got)
    with pytest.raises(Exception, match="no volume in range"):
        spark.createDataFrame([(0.0,)], "l double").select(S.volume_from_level("l")).collect()


def et0_numpy(t, tx, tn, rh, u10, rs, j, lat=32.82, elev=-212.0):
    es = lambda x: 0.6108 * math.exp(17.27 * x / (x + 237.3))
    lat = math.radians(lat)
    u2 = u10 * 4.87 / math.log(67.8 * 10 - 5.42)
    gamma = 0.000665 * 101.3 * ((293 - 0.0065 * elev) / 293) ** 5.26
    ea = es(t) * rh / 100
    decl = 0.409 * math.sin(2 * math.pi / 365 * j - 1.39)
    om = math.acos(-math.tan(lat) * math.tan(decl))
    ra = 24 * 60 / math.pi * 0.082 * (1 + 0.033 * math.cos(2 * math.pi / 365 * j)) * (
        om * math.sin(lat) * math.sin(decl) + math.cos(lat) * math.cos(decl) * math.sin(om))
    ratio = min(max(rs / ((0.75 + 2e-5 * elev) * ra), 0.3), 1.0)
    rn = 0.77 * rs - 4.903e-9 * ((tx + 273.16) ** 4 + (tn + 273.16) ** 4) / 2 * (0.34 - 0.14 * math.sqrt(ea)) * (1.35 * ratio - 0.35)
    delta = 4098 * es(t) / (t + 237.3) ** 2
    return max((0.408 * delta * rn + gamma * 900 / (t + 273) * u2 * ((es(tx) + es(tn)) / 2 - ea)) / (delta + gamma * (1 + 0.34 * u2)), 0)


def test_penman_monteith(spark):
    args = (25.0, 32.0, 18.0, 55.0, 3.0, 24.0, 180.0)
    lit = [F.lit(a) for a in args]
    row = one(spark, v=M.penman_monteith(*lit), w=M.penman_monteith(*lit[:5], F.lit(None).cast("double"), lit[6]))
    assert row.v == pytest.approx(et0_numpy(*args)) and row.w is None


def test_cloud_index_and_season_wrap(spark):
    row = one(spark, a=M.cloud_index(F.lit(4.0), F.lit(16.0)), b=M.cloud_index(F.lit(20.0), F.lit(16.0)))
    assert (row.a, row.b) == (0.5, 0.0)
    made = M.seasonality(F.lit(1.0))
    row = one(spark, w=made["rbf_winter_solstice"])
    assert row.w == pytest.approx(math.exp(math.log(0.05) / 2025 * 11 ** 2))


def test_trend_classes(spark):
    df = spark.createDataFrame([(0.02,), (-0.02,), (0.005,), (None,)], "d double")
    assert [r[0] for r in df.select(S.trend("d")).collect()] == ["RISING", "FALLING", "STABLE", None]


# fits -------------------------------------------------------------------------------

def test_quadratic_recovers_the_curve(spark):
    df = spark.createDataFrame([("lake", float(level), float(v)) for level, v, _ in CURVE], "site string, l double, v double")
    fit = fits.fit_quadratic(df, ["site"], "v", "l").first()
    np.testing.assert_allclose(fit.coefficients, C.VOLUME_TO_LEVEL, rtol=1e-7)
    assert 0.998 < fit.r2 < 1


def test_harmonic_recovers_a_sinusoid(spark):
    doy = np.arange(1, 366)
    y = 20 + 8 * np.sin(2 * np.pi * doy / 365) + 3 * np.cos(2 * np.pi * doy / 365)
    pdf = pd.DataFrame({"site": "a", "doy": doy, "y": y})
    df = spark.createDataFrame(pdf)
    fit = fits.fit_harmonic(df, ["site"], "doy", "y")
    got = fits.with_harmonic(df, fit, ["site"], "doy", "z").toPandas()
    assert np.abs(got.z - got.y).max() < 1e-6


def noisy(seed=5, n=3000):
    rng = np.random.default_rng(seed)
    date = pd.date_range("2012-01-01", periods=n)
    doy = date.dayofyear.values
    y = 20 + 8 * np.sin(2 * np.pi * doy / 365) + rng.normal(size=n)
    y[rng.random(n) < 0.05] = np.nan
    return pd.DataFrame({"site": "a", "date": date.date, "doy": doy, "y": y})


def to_spark(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumns({c: S.nan_to_null(c) for c, t in df.dtypes if t == "double"})


def design(doy, k):
    cols = [np.ones(len(doy))]
    for i in range(1, k + 1):
        cols += [np.cos(2 * np.pi * i * doy / 365), np.sin(2 * np.pi * i * doy / 365)]
    return np.column_stack(cols)


def test_three_harmonics_and_anomalies_equal_least_squares(spark):
    pdf = noisy()
    df = to_spark(spark, pdf)
    fit = fits.fit_harmonic(df, ["site"], "doy", "y")
    ok = pdf.y.notna()
    want = np.linalg.lstsq(design(pdf.doy[ok], 3), pdf.y[ok], rcond=None)[0]
    np.testing.assert_allclose(fit.first().coefficients, want, atol=1e-9)
    z = fits.anomaly(df, ["site"], "doy", "y", fit).orderBy("date").toPandas().anomaly_z
    resid = pdf.y - design(pdf.doy, 3) @ want
    np.testing.assert_allclose(z.astype(float), resid / np.nanstd(resid), atol=1e-8)


def test_constant_series_has_unit_sigma(spark):
    pdf = pd.DataFrame({"site": "a", "doy": np.arange(1, 366), "y": 5.0})
    df = spark.createDataFrame(pdf)
    out = fits.anomaly(df, ["site"], "doy", "y", fits.fit_harmonic(df, ["site"], "doy", "y"))
    assert out.agg(F.max(F.abs("anomaly_z"))).first()[0] < 1e-6


def test_clear_sky_raises_the_intercept(spark):
    pdf = noisy()
    df = to_spark(spark, pdf)
    mean = fits.fit_harmonic(df, ["site"], "doy", "y").first().coefficients
    clear = fits.fit_clear_sky(df, ["site"], "doy", "y").first().coefficients
    resid = pdf.y - design(pdf.doy, 3) @ np.array(mean)
    assert clear[0] - mean[0] == pytest.approx(np.nanquantile(resid, 0.9)) and clear[1:] == mean[1:]


def test_climatology_has_every_day_and_column(spark):
    pdf = noisy().rename(columns={"y": "temp_max_C"})
    pdf["temp_min_C"] = pdf.temp_max_C - 9
    pdf["et0_mm"], pdf["rainfall_mm"], pdf["outflow_m3"] = 4.0, np.where(pdf.doy < 90, 5.0, 0.0), 1e5
    out = fits.climatology(to_spark(spark, pdf), to_spark(spark, pdf), ["site"]).toPandas()
    assert len(out) == 366 and out.p_wet_clim.between(0, 1).all() and (out.amount_clim >= 0).all()
    assert set(out.columns) == {"site", "doy", "temp_max_clim", "temp_min_clim", "dtr_clim", "dtr_clearsky",
                                "et0_clim", "p_wet_clim", "amount_clim", "outflow_clim"}


def test_fit_of_an_all_null_value_is_null(spark):
    df = spark.createDataFrame([("a", d, 1.0, None) for d in range(1, 40)], "site string, doy int, x double, y double")
    row = fits.fit_harmonics(df, ["site"], "doy", {"x": F.col("x"), "y": F.col("y")}, 1).first()
    assert row.y is None and row.x[0] == pytest.approx(1)


def test_linear_calibration(spark):
    x = np.linspace(0, 8, 500)
    rows = [(float(a), float(1.15 * a - 0.3)) for a in x] + [(None, 1.0), (1.0, None)]
    fit = fits.fit_line(spark.createDataFrame(rows, "x double, y double"), [], "x", "y").first()
    assert (fit.slope, fit.intercept, fit.n) == (pytest.approx(1.15), pytest.approx(-0.3), 500)


def test_quantile_map_moves_the_source_onto_the_reference(spark):
    rng = np.random.default_rng(2)
    dates = [dt.date(2012, 1, 1) + dt.timedelta(days=int(i)) for i in range(2000)]
    src = pd.DataFrame({"site": "a", "date": dates, "v": rng.normal(23, 2, 2000)})
    src.loc[5, "v"] = np.nan
    ref = pd.DataFrame({"site": "a", "date": dates, "v": rng.normal(20, 2, 2000)})
    out = fits.quantile_map(to_spark(spark, src), to_spark(spark, ref), ["site"], "v", ("2012-01-01", "2024-12-31"),
                            out="w").orderBy("date").toPandas()
    assert abs(out.w.mean() - ref.v.mean()) < 0.3 and abs(out.w.std() - ref.v.std()) < 0.3
    assert pd.isna(out.w[5])
    january = out[pd.to_datetime(out.date).dt.month == 1].dropna().sort_values("v")
    assert (january.w.diff().dropna() >= -1e-12).all()


def test_quantile_map_needs_overlap(spark):
    rows = [("a", dt.date(2013, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "site string, date date, v double")
    out = fits.quantile_map(df, df.withColumn("v", F.col("v") + 100), ["site"], "v", out="w")
    assert out.where("v <> w").count() == 0


def test_standardize_floors_sigma(spark):
    df = fits.standardize(spark.createDataFrame([("a", 3.0), ("a", 3.0)], "site string, v double"), ["site"], "v")
    assert df.first().v_sigma == 1e-8 and df.first().v_std == 0


# recurrences ------------------------------------------------------------------------------

def rain(spark, rows):
    data = [("a", DAY0 + dt.timedelta(days=i), float(p), float(e)) for i, (p, e) in enumerate(rows)]
    return spark.createDataFrame(data, "site string, date date, rain double, et double")


def test_antecedent_index_decays(spark):
    out = R.antecedent_index(rain(spark, [(100, 0), (0, 0), (0, 0), (0, 0)]), ["site"], "date", "rain")
    assert [r.api for r in out.orderBy("date").collect()] == pytest.approx([100, 90, 81, 72.9])


@pytest.mark.parametrize("rows,s0,want", [
    ([(20, 2)], 0, [(18, 0)]), ([(20, 2)], 200, [(200, 18)]), ([(0, 10), (0, 10)], 5, [(0, 0), (0, 0)])])
def test_bucket_cases(spark, rows, s0, want):
    out = R.soil_bucket(rain(spark, rows), ["site"], "date", "rain", "et", 200, s0).orderBy("date").collect()
    assert [(r.bucket_S, r.bucket_Q) for r in out] == want


def test_recurrences_over_many_blocks_equal_loops(spark):
    rng = np.random.default_rng(7)
    rows = list(zip(rng.gamma(0.3, 20, 1500), rng.gamma(2, 2, 1500)))
    df = rain(spark, rows)
    got = R.soil_bucket(R.antecedent_index(df, ["site"], "date", "rain", start=3.0), ["site"], "date", "rain", "et").orderBy("date").toPandas()
    s, a = C.BUCKET_S_MAX / 2, 3.0
    want = []
    for p, e in rows:
        a = 0.9 * a + p
        level = s + p - e
        s = min(max(level, 0), C.BUCKET_S_MAX)
        want.append((a, s, max(level - C.BUCKET_S_MAX, 0)))
    np.testing.assert_allclose(got[["api", "bucket_S", "bucket_Q"]].values, want, atol=1e-8)


@pytest.mark.parametrize("v0", [30.0, -5.0])
def test_water_balance_equals_the_clipped_loop(spark, v0):
    rng = np.random.default_rng(4)
    dv = rng.normal(-0.5, 8, 400)
    rows = [("m", DAY0 + dt.timedelta(days=i), float(x)) for i, x in enumerate(dv)]
    df = spark.createDataFrame(rows, "model string, date date, dv double")
    got = R.water_balance(df, ["model"], "date", "dv", "2012-01-11", v0, "v").orderBy("date").toPandas().v
    assert got[:10].isna().all() and got[10] == v0
    v, want = v0, []
    for x in dv[11:]:
        v = max(v + x, 0)
        want.append(v)
    np.testing.assert_allclose(got[11:].astype(float), want, atol=1e-9)


def test_constant_recession_crosses_on_day_fifty(spark):
    rates = spark.createDataFrame([("a", d, -0.01) for d in range(1, 367)], "site string, doy int, rate double")
    anchors = spark.createDataFrame([("a", dt.date(2024, 6, 1), -212.505, 1.0)],
                                    "site string, anchor_date date, anchor_level double, scale double")
    path = R.project_levels(anchors, rates, ["site"], C.RECESSION_HORIZON_DAYS)
    hit = R.crossings(path, ["site"], -213.0).first()
    assert hit.days_to_line == 50 and hit.crossing_date == dt.date(2024, 7, 21)
    assert R.keep_until_crossing(path, ["site"], -213.0).count() == 75
    assert R.crossings(path, ["site"], -300.0).first().days_to_line is None


def test_recession_scale_is_bounded(spark):
    cases = [(-0.02, -0.01, 1.6), (-0.001, -0.01, 0.45), (-0.01, -0.01, 1.0), (-0.01, 0.0, 1.0)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "o double, n double")
    got = [r[0] for r in df.select(R.anomaly_scale(F.col("o"), F.col("n"))).collect()]
    assert got == [c for *_, c in cases]


def test_left_out_year_equals_a_fit_without_it(spark):
    rng = np.random.default_rng(9)
    dates = pd.date_range("2005-01-01", "2009-12-31")
    pdf = pd.DataFrame({"site": "a", "date": dates.date, "level_m": -210 + np.cumsum(rng.normal(-0.001, 0.01, len(dates)))})
    df = spark.createDataFrame(pdf)
    got = fits.recession_rates(df, ["site"], "date", "level_m", 2005, [2007]).orderBy("doy").toPandas().rate
    s = pd.Series(pdf.level_m.values, index=dates).diff()
    s = s[s.index.year != 2007]
    doy = s.groupby(s.index.dayofyear).mean().reindex(range(1, 367)).interpolate()
    want = pd.concat([doy] * 3).rolling(15, center=True, min_periods=1).mean().iloc[366:732]
    np.testing.assert_allclose(got, want.values, atol=1e-12)


def test_three_harmonics_of_short_records_are_the_smallest_coefficients(spark):
    days = [3, 60, 130, 250]
    rows = [("few", d, float(d % 11)) for d in days] + [("full", d, float(5 + np.sin(d / 58.1) * 3 + (d % 5))) for d in range(1, 367, 3)]
    rows += [("none", 5, None)]
    df = spark.createDataFrame(rows, "site string, doy int, y double")
    found = {r.site: r for r in fits.fit_harmonic(df, ["site"], "doy", "y").collect()}
    assert found.keys() == {"few", "full"}
    for site in found:
        own = [r for r in rows if r[0] == site]
        d = np.array([r[1] for r in own])
        basis = np.column_stack([np.ones(len(d))] + [f(2 * np.pi * k * d / 365) for k in (1, 2, 3) for f in (np.cos, np.sin)])
        want = np.linalg.lstsq(basis, np.array([r[2] for r in own]), rcond=None)[0]
        np.testing.assert_allclose(found[site].coefficients, want, rtol=1e-5 if site == "few" else 1e-10, atol=1e-6 if site == "few" else 1e-10)


def test_harmonic_fits_use_no_python_worker(spark):
    df = spark.createDataFrame([("a", 5, 1.0)], "site string, doy int, y double")
    plan = fits.fit_harmonic(df, ["site"], "doy", "y")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
