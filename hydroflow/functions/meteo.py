"""Weather formulas as Column expressions (FAO-56 daily reference, Hargreaves, seasonality)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydroflow import config as C
from hydroflow.functions.scalars import clip, col

YEAR = 2 * math.pi / 365


def saturation_vapour_pressure(temp) -> Column:
    t = col(temp)
    return F.lit(0.6108) * F.exp(F.try_divide(F.lit(17.27) * t, t + F.lit(237.3)))


def actual_vapour_pressure(temp, humidity) -> Column:
    return saturation_vapour_pressure(temp) * col(humidity) / F.lit(100.0)


def vpd(temp, humidity) -> Column:
    return clip(saturation_vapour_pressure(temp) - actual_vapour_pressure(temp, humidity), low=0.0)


def solar_declination(doy) -> Column:
    return F.lit(0.409) * F.sin(F.lit(YEAR) * col(doy) - F.lit(1.39))


def sunset_angle(doy, latitude) -> Column:
    lat = F.radians(latitude if isinstance(latitude, Column) else F.lit(float(latitude)))
    return F.acos(clip(-F.tan(lat) * F.tan(solar_declination(doy)), -1.0, 1.0))


def daylength_hours(doy, latitude=32.82) -> Column:
    return F.lit(24 / math.pi) * sunset_angle(doy, latitude)


def extraterrestrial_radiation(doy, latitude=32.82) -> Column:
    lat = F.radians(latitude if isinstance(latitude, Column) else F.lit(float(latitude)))
    decl, angle = solar_declination(doy), sunset_angle(doy, latitude)
    distance = F.lit(1.0) + F.lit(0.033) * F.cos(F.lit(YEAR) * col(doy))
    geometry = angle * F.sin(lat) * F.sin(decl) + F.cos(lat) * F.cos(decl) * F.sin(angle)
    return F.lit(24 * 60 / math.pi * 0.0820) * distance * geometry


def penman_monteith(temp_mean, temp_max, temp_min, humidity, wind_10m, radiation, doy,
                    latitude=32.82, elevation: float = -212.0) -> Column:
    """Daily reference evapotranspiration [mm]; null without radiation, never negative."""
    t, tx, tn = col(temp_mean), col(temp_max), col(temp_min)
    rs = col(radiation)
    wind = col(wind_10m) * F.lit(4.87 / math.log(67.8 * 10 - 5.42))
    gamma = 0.000665 * 101.3 * ((293 - 0.0065 * elevation) / 293) ** 5.26

    es = (saturation_vapour_pressure(tx) + saturation_vapour_pressure(tn)) / F.lit(2.0)
    ea = actual_vapour_pressure(t, humidity)
    slope = F.try_divide(F.lit(4098.0) * saturation_vapour_pressure(t),
                         F.pow(t + F.lit(237.3), F.lit(2.0)))

    clear_sky = F.lit(0.75 + 2e-5 * elevation) * extraterrestrial_radiation(doy, latitude)
    cloudiness = F.when(clear_sky > 0, clip(F.try_divide(rs, clear_sky), 0.3, 1.0))
    black_body = (F.pow(tx + F.lit(273.16), F.lit(4.0))
                  + F.pow(tn + F.lit(273.16), F.lit(4.0))) / F.lit(2.0)
    long_wave = (F.lit(4.903e-9) * black_body
                 * (F.lit(0.34) - F.lit(0.14) * F.sqrt(clip(ea, low=0.0)))
                 * (F.lit(1.35) * cloudiness - F.lit(0.35)))
    net = F.lit(0.77) * rs - long_wave

    supply = F.lit(0.408) * slope * net
    demand = F.lit(gamma) * F.try_divide(F.lit(900.0), t + F.lit(273.0)) * wind * (es - ea)
    scale = slope + F.lit(gamma) * (F.lit(1.0) + F.lit(0.34) * wind)
    return clip(F.try_divide(supply + demand, scale), low=0.0)


def hargreaves(temp_max, temp_min, doy, latitude=32.82,
               coefficient: float = C.HARGREAVES_COEFF) -> Column:
    tx, tn = col(temp_max), col(temp_min)
    mean = (tx + tn) / F.lit(2.0)
    span = clip(tx - tn, low=0.0)
    return (F.lit(coefficient * C.INVERSE_LATENT_HEAT) * extraterrestrial_radiation(doy, latitude)
            * (mean + F.lit(17.8)) * F.sqrt(span))


def hargreaves_calibrated(temp_max, temp_min, doy, latitude=32.82,
                          slope: float = C.HARGREAVES_SLOPE,
                          intercept: float = C.HARGREAVES_INTERCEPT) -> Column:
    raw = hargreaves(temp_max, temp_min, doy, latitude)
    return clip(F.lit(slope) * raw + F.lit(intercept), low=0.0)


def cloud_index(span, clear_sky_span) -> Column:
    ratio = F.sqrt(clip(span, low=0.0)) / F.sqrt(clip(clear_sky_span, low=1e-9))
    return F.lit(1.0) - clip(ratio, 0.0, 1.0)


def seasonality(doy, latitude=32.82) -> dict[str, Column]:
    """All seasonal features of a day of year, by column name."""
    j = col(doy).cast("double")
    out = {
        "season_sin": F.sin(F.lit(2 * math.pi) * j / F.lit(365.25)),
        "season_cos": F.cos(F.lit(2 * math.pi) * j / F.lit(365.25)),
        "solar_declination_rad": solar_declination(j),
        "daylength_hrs": daylength_hours(j, latitude),
    }
    for name, centre in C.RBF_CENTRES.items():
        away = F.abs(j - F.lit(float(centre)))
        wrapped = F.least(away, F.lit(365.0) - away)
        out[f"rbf_{name}"] = F.exp(F.lit(-C.RBF_GAMMA) * wrapped * wrapped)
    return out


def harmonic_row(doy, harmonics: int) -> list[Column]:
    """The row 1, cos, sin, cos, sin ... of a harmonic regression."""
    j = col(doy)
    row = [F.lit(1.0)]
    for k in range(1, harmonics + 1):
        row += [F.cos(F.lit(k * YEAR) * j), F.sin(F.lit(k * YEAR) * j)]
    return row


def harmonic_value(doy, coefficients, harmonics: int) -> Column:
    """Value of fitted coefficients (an array column) at a day of year."""
    terms = [F.get(col(coefficients), F.lit(i)) * b
             for i, b in enumerate(harmonic_row(doy, harmonics))]
    return sum(terms[1:], terms[0])
