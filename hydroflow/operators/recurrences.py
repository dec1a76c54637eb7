"""Recurrences along a daily series without a serial scan of the series.

A series is cut into blocks (calendar quarters). Each block is reduced to the
function it applies to the state it starts from, the few block functions of a
series are chained, and the rows of all blocks are then worked out in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroflow import config as C
from hydroflow.functions.scalars import clip

MAX_DOUBLE = 1.7976931348623157e308


def antecedent_index(df: DataFrame, keys: Sequence[str], date: str, rain: str,
                     decay: float = C.API_DECAY, start: float = 0.0,
                     out: str = "api") -> DataFrame:
    """A = decay * previous A + rain; null rain counts as none.

    Inside a block A is a running sum of rain scaled by powers of the decay; the
    state a block starts from is folded over the ends of the blocks before it.
    """
    inside = Window.partitionBy(*keys, "_block").orderBy(date)
    grown = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = (df.withColumn("_block", F.trunc(F.col(date), "quarter"))
              .withColumn("_i", F.row_number().over(inside).cast("double")))
    power = F.pow(F.lit(float(decay)), F.col("_i"))
    local = placed.withColumn(
        "_local", power * F.sum(F.coalesce(F.col(rain), F.lit(0.0)) / power).over(grown))
    ends = local.groupBy(*keys, "_block").agg(
        F.max_by("_local", "_i").alias("end"), F.max("_i").alias("n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_ends", F.collect_list(F.struct("end", "n")).over(before))
    state = F.aggregate("_ends", F.lit(float(start)),
                        lambda a, e: a * F.pow(F.lit(float(decay)), e["n"]) + e["end"])
    starts = carried.select(*keys, "_block", state.alias("_start"))
    return (local.join(starts, [*keys, "_block"])
            .withColumn(out, F.col("_local") + F.col("_start") * power)
            .drop("_block", "_i", "_local", "_start"))


def soil_bucket(df: DataFrame, keys: Sequence[str], date: str, rain: str, et: str,
                s_max: float = C.BUCKET_S_MAX, s0: float | None = None,
                storage: str = "bucket_S", overflow: str = "bucket_Q") -> DataFrame:
    """Storage S = clip(S + rain - et, 0, s_max) and overflow of a soil bucket.

    One step is a clamp of a shift, and clamped shifts compose to a clamped
    shift (a, lo, hi): that triple is all a block passes on. A day without a value for
    rain or ET has none of it, so its storage is carried on.
    """
    s_max = float(s_max)
    s0 = s_max / 2 if s0 is None else float(s0)
    rest = [c for c in df.columns if c not in keys and c != date]
    net = F.coalesce(F.col(rain), F.lit(0.0)) - F.coalesce(F.col(et), F.lit(0.0))
    rows = F.sort_array(F.collect_list(
        F.struct(F.col(date).alias("d"), net.alias("net"), F.struct(*rest).alias("rest"))))
    blocks = (df.withColumn("_block", F.trunc(F.col(date), "quarter"))
              .groupBy(*keys, "_block").agg(rows.alias("_rows")))

    def bound(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(0.0)), F.lit(s_max))

    identity = F.struct(F.lit(0.0).alias("a"), F.lit(-MAX_DOUBLE).alias("lo"),
                        F.lit(MAX_DOUBLE).alias("hi"))
    effect = F.aggregate("_rows", identity, lambda f, r: F.struct(
        (f["a"] + r["net"]).alias("a"), bound(f["lo"] + r["net"]).alias("lo"),
        bound(f["hi"] + r["net"]).alias("hi")))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    chained = blocks.withColumn("_effect", effect) \
                    .withColumn("_before", F.collect_list("_effect").over(before))
    started = chained.withColumn("_start", F.aggregate(
        "_before", F.lit(s0), lambda s, f: F.least(F.greatest(s + f["a"], f["lo"]), f["hi"])))

    day = "struct<s:double,q:double>"
    empty = F.struct(F.col("_start").alias("s"), F.array().cast(f"array<{day}>").alias("days"))

    def step(acc: Column, r: Column) -> Column:
        level = acc["s"] + r["net"]
        stored = bound(level)
        spilled = F.greatest(level - F.lit(s_max), F.lit(0.0))
        entry = F.struct(stored.alias("s"), spilled.alias("q"))
        return F.struct(stored.alias("s"), F.array_append(acc["days"], entry).alias("days"))

    replayed = started.withColumn("_days", F.aggregate("_rows", empty, step, lambda acc: acc["days"]))
    each = replayed.select(*keys, F.explode(F.arrays_zip("_rows", "_days")).alias("e"))
    return each.select(*keys, F.col("e._rows.d").alias(date), F.col("e._rows.rest.*"),
                       F.col("e._days.s").alias(storage), F.col("e._days.q").alias(overflow))


def bucket_state(df: DataFrame, keys: Sequence[str], date: str, rain: str, et: str,
                 s_max: float = C.BUCKET_S_MAX, days: int = 30) -> DataFrame:
    """Storage at the day and trailing overflow; null rain is none, null ET the median."""
    middle = F.percentile(F.col(et), F.lit(0.5)).over(Window.partitionBy(*keys))
    ready = (df.withColumn("_rain", F.coalesce(F.col(rain), F.lit(0.0)))
             .withColumn("_et", F.coalesce(F.col(et), middle)))
    stored = soil_bucket(ready, keys, date, "_rain", "_et", s_max, s_max / 2).drop("_rain", "_et")
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(-(days - 1), 0)
    return stored.withColumn(f"bucket_Q{days}", F.sum("bucket_Q").over(w))


def water_balance(df: DataFrame, keys: Sequence[str], date: str, change: str,
                  anchor_date, anchor_volume, out: str = "volume_Mm3") -> DataFrame:
    """V = max(previous V + change, 0) from the anchor row on, null before it.

    The clipped sum in closed form: S - min(0, lowest S so far), with S the
    anchor volume plus the changes after the anchor row. ``anchor_date`` and
    ``anchor_volume`` are columns or values; the anchor row is the first row at
    or after the anchor date.
    """
    at = anchor_date if isinstance(anchor_date, Column) else F.lit(anchor_date).cast("date")
    v0 = anchor_volume if isinstance(anchor_volume, Column) else F.lit(float(anchor_volume))
    w = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    after = df.withColumn("_after", F.col(date) >= at) \
              .withColumn("_n", F.sum(F.col("_after").cast("int")).over(w))
    moved = F.when(F.col("_n") > 1, F.col(change)).otherwise(F.lit(0.0))
    summed = after.withColumn("_s", F.when(F.col("_after"), v0 + F.sum(moved).over(w)))
    # the anchor volume itself is not clipped, the days after it are
    lowest = F.least(F.min(F.when(F.col("_n") > 1, F.col("_s"))).over(w), F.lit(0.0))
    volume = F.when(F.col("_n") == 1, v0).otherwise(F.col("_s") - lowest)
    return summed.withColumn(out, F.when(F.col("_after"), volume)).drop("_after", "_n", "_s")


def anomaly_scale(observed_rate: Column, normal_rate: Column,
                  bounds: tuple[float, float] = C.RECESSION_SCALE_RANGE,
                  flat: float = C.RECESSION_FLAT_RATE) -> Column:
    """Observed recession over the normal one, bounded; 1 where the lake is not falling."""
    return F.when(normal_rate < flat, clip(F.try_divide(observed_rate, normal_rate), *bounds)) \
            .otherwise(F.lit(1.0))


def scenario_scales(scale: Column) -> Column:
    """Central, fast and slow multipliers as an array of (scenario, scale)."""
    slow = F.least(scale, F.lit(1.0)) * F.lit(C.RECESSION_SLOW_FACTOR)
    pairs = (("central", scale), ("fast", F.lit(1.0)), ("slow", slow))
    return F.array(*[F.struct(F.lit(n).alias("scenario"), s.alias("scale")) for n, s in pairs])


def observed_scale(daily: DataFrame, rates: DataFrame, anchors: DataFrame, keys: Sequence[str],
                   rate_keys: Sequence[str], level: str, days: int = C.RECESSION_OBS_DAYS) -> DataFrame:
    """Level and scale at each anchor: observed slope over the normal rate of its window.

    ``anchors`` holds (rate_keys, anchor_date). The window is the anchor day and
    the ``days`` days before it.
    """
    window = anchors.withColumn("date", F.explode(F.sequence(
        F.date_sub("anchor_date", days), F.col("anchor_date"), F.expr("interval 1 day")))) \
        .withColumn("doy", F.dayofyear("date"))
    joined = (window.join(daily.select(*keys, "date", level), [*keys, "date"], "left")
              .join(rates, [*rate_keys, "doy"], "left"))
    at_end = F.max(F.when(F.col("date") == F.col("anchor_date"), F.col(level)))
    at_start = F.max(F.when(F.col("date") == F.date_sub("anchor_date", days), F.col(level)))
    stats = joined.groupBy(*rate_keys, "anchor_date").agg(
        at_end.alias("anchor_level"), ((at_end - at_start) / F.lit(float(days))).alias("observed_rate"),
        F.avg("rate").alias("normal_rate"))
    return stats.withColumn("scale", anomaly_scale(F.col("observed_rate"), F.col("normal_rate")))


def project_levels(anchors: DataFrame, rates: DataFrame, keys: Sequence[str], days: int,
                   rate_keys: Sequence[str] | None = None) -> DataFrame:
    """Level on each of the coming days: anchor level plus the scaled rates so far.

    ``anchors`` holds (keys, anchor_date, anchor_level, scale); ``rates`` the rate
    per (rate_keys, doy).
    """
    rate_keys = list(rate_keys if rate_keys is not None else keys)
    path = (anchors.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(days))))
            .withColumn("date", F.date_add("anchor_date", F.col("day")))
            .withColumn("doy", F.dayofyear("date"))
            .join(rates.select(*rate_keys, "doy", "rate"), [*rate_keys, "doy"], "left"))
    w = Window.partitionBy(*keys, "anchor_date").orderBy("day") \
              .rowsBetween(Window.unboundedPreceding, 0)
    return path.withColumn("level", F.col("anchor_level")
                           + F.sum(F.col("rate") * F.col("scale")).over(w)).drop("doy", "rate")


def crossings(path: DataFrame, keys: Sequence[str], line: float) -> DataFrame:
    """First day at or below a line per path, null where it is not reached."""
    below = F.when(F.col("level") <= line, F.col("date"))
    return path.groupBy(*keys, "anchor_date").agg(F.min(below).alias("crossing_date")) \
               .withColumn("days_to_line", F.datediff("crossing_date", "anchor_date"))


def keep_until_crossing(path: DataFrame, keys: Sequence[str], line: float,
                        extra_days: int = C.RECESSION_KEEP_DAYS) -> DataFrame:
    """The path up to some days past its first crossing, or all of it."""
    w = Window.partitionBy(*keys, "anchor_date")
    first = F.min(F.when(F.col("level") <= line, F.col("date"))).over(w)
    return (path.withColumn("crossing_date", first)
            .where(F.col("crossing_date").isNull()
                   | (F.datediff("date", "crossing_date") <= extra_days)))
