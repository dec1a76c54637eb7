"""Column expressions: null-safe clipping, transforms, polynomials, units, text, dates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydroflow import config as C


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(x) -> Column:
    x = col(x)
    return F.when(~F.isnan(x), x)


def to_double(text) -> Column:
    """Text to double; blanks, dashes, unparsable text and ``nan`` give null."""
    t = F.trim(col(text))
    return nan_to_null(F.when(~t.isin("", "-"), t).try_cast("double"))


def clip(x, low=None, high=None) -> Column:
    """Bound a value on one or both sides and keep null as null."""
    x = col(x)
    out = x
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(float(low)))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(float(high)))
    return F.when(x.isNotNull(), out)


def log_floor(x) -> Column:
    """Natural log of a positive target, values below one raised to one."""
    return F.log(clip(x, low=1.0))


def log_floor_inverse(y) -> Column:
    return F.exp(col(y))


def signed_log1p(x) -> Column:
    x = col(x)
    return F.signum(x) * F.log1p(F.abs(x))


def signed_log1p_inverse(y) -> Column:
    y = col(y)
    return F.signum(y) * F.expm1(F.abs(y))


def log1p_positive(x) -> Column:
    """log1p of positive values, null otherwise."""
    x = col(x)
    return F.when(x > 0, F.log1p(x))


def polyval(coefficients, x) -> Column:
    """Polynomial with the highest power first; coefficients are numbers or an array column."""
    x = col(x)
    if isinstance(coefficients, (Column, str)):
        return F.aggregate(col(coefficients), F.lit(0.0), lambda acc, c: acc * x + c)
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + F.lit(float(c))
    return out


def level_from_volume(volume, coefficients: Sequence[float] = C.VOLUME_TO_LEVEL) -> Column:
    return polyval(coefficients, volume)


def volume_from_level(level, coefficients: Sequence[float] = C.VOLUME_TO_LEVEL,
                      valid: tuple[float, float] = C.VOLUME_RANGE_MM3,
                      strict: bool = True) -> Column:
    """Root of the quadratic level curve inside ``valid``; an error when there is none.

    ``strict=False`` gives null instead of the error. A null level stays null.
    """
    level = col(level)
    a, b, c = (float(v) for v in coefficients)
    disc = F.lit(b * b) - F.lit(4.0 * a) * (F.lit(c) - level)
    root = F.sqrt(F.when(disc >= 0, disc))
    first = (F.lit(-b) + root) / F.lit(2.0 * a)
    second = (F.lit(-b) - root) / F.lit(2.0 * a)
    picked = F.coalesce(*[F.when(v.between(*valid), v) for v in (first, second)])
    if not strict:
        return picked
    failure = F.raise_error(F.concat(F.lit("no volume in range for level "), level.cast("string")))
    return F.when(level.isNull(), F.lit(None).cast("double")) \
            .otherwise(F.coalesce(picked, failure.cast("double")))


# units ------------------------------------------------------------------------

def m3s_to_m3day(x) -> Column:
    return col(x) * F.lit(float(C.SECONDS_PER_DAY))


def m3_to_Mm3(x) -> Column:
    return col(x) / F.lit(C.M3_PER_MM3)


def kmh_to_ms(x) -> Column:
    return col(x) / F.lit(C.KMH_PER_MS)


def mm_over_lake_to_Mm3(x, area_km2: float = C.LAKE_AREA_KM2) -> Column:
    return col(x) * F.lit(area_km2) * F.lit(C.MM_KM2_TO_MM3)


def slot_radiation_to_MJ(slot_sum) -> Column:
    """Sum of ten-minute W/m2 readings to MJ/m2, three decimals, half to even."""
    return F.bround(col(slot_sum) * F.lit(float(C.SECONDS_PER_SLOT)) / F.lit(1e6), 3)


def significant_digits(x, digits: int = 12) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.format_string(f"%.{digits - 1}e", x).cast("double"))


# text ---------------------------------------------------------------------------

def strip_number(text) -> Column:
    """Number in a text that may carry percent signs and thousands commas."""
    return nan_to_null(F.trim(F.regexp_replace(col(text), "[%,]", "")).try_cast("double"))


def replace_by_map(text, names: Mapping[str, str]) -> Column:
    """Look a trimmed text up in a name map; names not in it stay as they are."""
    t = F.trim(col(text))
    return F.coalesce(lookup(t, names), t)


def lookup(key, entries: Mapping[str, object]) -> Column:
    """Value of a settings map for a key column, null when absent."""
    if not entries:
        return F.lit(None).cast("string")
    flat = [F.lit(x) for pair in entries.items() for x in pair]
    return F.try_element_at(F.create_map(*flat), col(key))


def first_token(text, separator: str = "_") -> Column:
    return F.substring_index(col(text), separator, 1)


# classes -------------------------------------------------------------------------

def season(date, cold_months: Sequence[int] = C.WINTER_MONTHS,
           cold: str = "winter", warm: str = "summer") -> Column:
    return F.when(F.month(col(date)).isin(*cold_months), F.lit(cold)).otherwise(F.lit(warm))


def wet_season(date) -> Column:
    return season(date, C.WET_MONTHS, "wet", "dry")


def trend(change, tolerance: float = 0.01) -> Column:
    change = col(change)
    return (F.when(change > tolerance, F.lit("RISING"))
            .when(change < -tolerance, F.lit("FALLING"))
            .when(change.isNotNull(), F.lit("STABLE")))


def line_distances(level, lower: float, upper: float,
                   buffer_per_m: float = C.BUFFER_MM3_PER_M) -> dict[str, Column]:
    level = col(level)
    above = level - F.lit(lower)
    return {"above_lower_m": above, "below_upper_m": F.lit(upper) - level,
            "buffer_Mm3": F.abs(above) * F.lit(buffer_per_m)}


def band(level, half_width: float = C.LEVEL_BAND_M) -> dict[str, Column]:
    level = col(level)
    return {"band_low": level - F.lit(half_width), "band_high": level + F.lit(half_width)}
