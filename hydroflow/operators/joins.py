"""Joins between daily tables: lookups, as-of, horizons, ranges, guards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroflow.operators.selects import complete_cases


def unique_or_error(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a lookup table; reading them raises an error if a key occurs twice."""
    rest = [c for c in df.columns if c not in keys]
    failure = F.raise_error(F.lit("duplicate lookup key")).cast("long")
    single = F.when(F.count(F.lit(1)) > 1, failure).otherwise(F.lit(1))
    # the maximum of one value is that value, and unlike first(struct) it hash-aggregates
    grouped = df.groupBy(*keys).agg(single.alias("_n"), *[F.max(c).alias(c) for c in rest])
    return grouped.where(F.col("_n") == 1).drop("_n")


def lookup_join(spine: DataFrame, source: DataFrame, keys: Sequence[str],
                check_unique: bool = True) -> DataFrame:
    """Left join of a source onto the spine; the source must be unique per key."""
    right = unique_or_error(source, keys) if check_unique else source
    return spine.join(right, list(keys), "left")


def matched_pairs(predictions: DataFrame, observations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of predictions and observations, complete rows only."""
    pairs = predictions.join(observations, list(keys))
    return complete_cases(pairs, pairs.columns)


def as_of(anchors: DataFrame, states: DataFrame, keys: Sequence[str], date: str,
          state_date: str, columns: Sequence[str]) -> DataFrame:
    """Last state with all ``columns`` valid at or before each anchor date.

    The distinct anchor days and the states, one row per day each, are merged into
    a series per key and the last valid state is carried forward: no range join,
    and a window bounded by the calendar however many anchors share a day.
    """
    valid = complete_cases(states, columns)
    daily = valid.groupBy(*keys, F.col(state_date).alias(date)).agg(
        F.max(F.struct(state_date, *columns)).alias("_state"))
    days = anchors.groupBy(*keys, date).agg(F.lit(True).alias("_asked"))
    merged = days.join(daily, [*keys, date], "full")
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    carried = merged.withColumn("_found", F.last("_state", ignorenulls=True).over(w)) \
                    .where("_asked").select(*keys, date, "_found")
    found = [F.col("_found")[c].alias(c) for c in (state_date, *columns)]
    return anchors.join(carried, [*keys, date], "left").select(*anchors.columns, *found)


def latest_state(states: DataFrame, keys: Sequence[str], date: str, columns: Sequence[str],
                 until: Column | None = None) -> DataFrame:
    """The last complete state per key (up to a date), by one map-side aggregate."""
    valid = complete_cases(states, columns)
    if until is not None:
        valid = valid.where(F.col(date) <= until)
    row = F.max_by(F.struct(date, *columns), date).alias("_s")
    return valid.groupBy(*keys).agg(row).select(*keys, "_s.*")


def last_values(df: DataFrame, keys: Sequence[str], date: str, value: str, count: int,
                name: str) -> DataFrame:
    """The last ``count`` valid values per key as columns ``name.format(1..count)``.

    The rank filter lets Spark keep only ``count`` rows per key before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(date).desc())
    ranked = (df.where(F.col(value).isNotNull()).withColumn("_rank", F.row_number().over(w))
              .where(F.col("_rank") <= count))
    return ranked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_rank") == k, F.col(value))).alias(name.format(k))
          for k in range(1, count + 1)])


def expand_horizons(daily: DataFrame, keys: Sequence[str], date: str, horizons: Sequence[int],
                    future: Mapping[str, str], anchor: Sequence[str] = (),
                    horizon: str = "horizon_h", within: str | None = None) -> DataFrame:
    """One row per anchor day and horizon: ``future`` columns from day t+h, ``anchor`` from t.

    ``future`` maps input to output names. The coming days are gathered with one
    window over the daily series, so there is no self join; a day that is missing
    at t+h gives nulls. ``within`` names a column (a fold's year, say) that the
    anchor and the target day must share, else the target is taken as missing.
    """
    span = max(horizons)
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(1, span)
    taken = [F.col(date).alias("_date")] + [F.col(a).alias(b) for a, b in future.items()]
    if within:
        taken.append(F.col(within).alias("_within"))
    kept = [*keys, date, *anchor] + ([within] if within and within not in anchor else [])
    ahead = daily.select(*kept, F.collect_list(F.struct(*taken)).over(w).alias("_ahead"))

    def at(h: int) -> Column:
        def wanted(r: Column) -> Column:
            hit = r["_date"] == F.date_add(F.col(date), h)
            return hit & (r["_within"] == F.col(within)) if within else hit
        return F.struct(F.lit(h).alias("h"), F.get(F.filter("_ahead", wanted), F.lit(0)).alias("t"))

    # the explode ends the projection: each feature below is a field access, not a search
    each = ahead.select(*kept, F.explode(F.array(*[at(int(h)) for h in horizons])).alias("_e"))
    return each.select(*kept, F.col("_e.h").alias(horizon), F.col("_e.t._date").alias("target_date"),
                       *[F.col(f"_e.t.{b}").alias(b) for b in future.values()])


def in_periods(df: DataFrame, year: str, periods: Sequence[tuple[str, int, int]],
               label: str = "period") -> DataFrame:
    """Tag rows with every period their year lies in; periods may overlap.

    The period list is a setting, so it is an expression and not a joined table.
    """
    tags = F.filter(
        F.array(*[F.when(F.col(year).between(lo, hi), F.lit(name)) for name, lo, hi in periods]),
        lambda t: t.isNotNull())
    return df.withColumn(label, F.explode(tags))


def alignment_mismatches(df: DataFrame, keys: Sequence[str], side: str, sides: tuple[str, str]) -> DataFrame:
    """Dates that only one of two sites has, per key, by one aggregate."""
    left, right = (F.max((F.col(side) == s).cast("int")) for s in sides)
    dates = df.where(F.col(side).isin(*sides)).groupBy(*keys, "date").agg(
        left.alias("_a"), right.alias("_b"))
    return dates.groupBy(*keys).agg(
        F.sum("_a").alias("n_left"), F.sum("_b").alias("n_right"),
        F.sum((F.col("_a") != F.col("_b")).cast("int")).alias("mismatches"))


def pair_sites(df: DataFrame, keys: Sequence[str], side: str, sides: tuple[str, str],
               columns: Sequence[str], strict: bool = True) -> DataFrame:
    """Two sites' columns side by side per date; ``strict`` raises where one site has no row."""
    aggs = [F.max(F.when(F.col(side) == s, F.col(c))).alias(f"{c}_{s}")
            for s in sides for c in columns]
    flags = [F.max((F.col(side) == s).cast("int")).alias(f"_has_{i}") for i, s in enumerate(sides)]
    both = (F.col("_has_0") == 1) & (F.col("_has_1") == 1)
    paired = df.where(F.col(side).isin(*sides)).groupBy(*keys).agg(*aggs, *flags)
    if strict:
        failure = F.raise_error(F.lit("sites do not cover the same dates")).cast("boolean")
        both = F.when(both, F.lit(True)).otherwise(failure)
    return paired.where(both).drop("_has_0", "_has_1")


def replace_rows(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows whose key is in the new batch give way to it."""
    kept = existing.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def redate_tail(history: DataFrame, keys: Sequence[str], date: str, rows: int) -> DataFrame:
    """The last ``rows`` rows of each series moved onto the days that follow it."""
    w = Window.partitionBy(*keys).orderBy(F.col(date).desc())
    tail = history.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= rows)
    whole = Window.partitionBy(*keys)
    moved = F.date_add(F.max(date).over(whole),
                       (F.max("_back").over(whole) - F.col("_back") + F.lit(1)).cast("int"))
    return tail.withColumn("_new", moved).withColumn(date, F.col("_new")).drop("_back", "_new")
