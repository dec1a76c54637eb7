"""Row-based windows over daily series, and the same over very long series.

A daily series has one row per (series, date), so a window over it is bounded by
the calendar (36,525 rows a century) however many raw readings lie behind it.
Series of raw readings have no such bound: ``row_index`` and ``in_blocks`` cut
them into blocks that carry the rows a frame needs from the block before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from hydroflow.functions.scalars import col


def series(keys: Sequence[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing(keys: Sequence[str], order: str, rows: int) -> WindowSpec:
    return series(keys, order).rowsBetween(-(rows - 1), 0)


def when_enough(value: Column, counted, window: WindowSpec, min_values: int) -> Column:
    """A windowed value where the frame holds at least ``min_values`` non-null rows."""
    return F.when(F.count(col(counted)).over(window) >= min_values, value)


def rolling_sum(value, keys, order, rows: int, min_values: int = 1) -> Column:
    w = trailing(keys, order, rows)
    return when_enough(F.sum(col(value)).over(w), value, w, min_values)


def rolling_mean(value, keys, order, rows: int, min_values: int = 1) -> Column:
    w = trailing(keys, order, rows)
    return when_enough(F.avg(col(value)).over(w), value, w, min_values)


def centred_mean(value, keys, order, rows: int, min_values: int = 1) -> Column:
    half = (rows - 1) // 2
    w = series(keys, order).rowsBetween(-(rows - 1 - half), half)
    return when_enough(F.avg(col(value)).over(w), value, w, min_values)


def forward_mean(value, keys, order, rows: int) -> Column:
    """Mean of the next ``rows`` rows, the current one not counted."""
    return F.avg(col(value)).over(series(keys, order).rowsBetween(1, rows))


def difference(value, keys, order, rows: int = 1) -> Column:
    return col(value) - F.lag(col(value), rows).over(series(keys, order))


def lags(value, keys, order, count: int, name: str) -> dict[str, Column]:
    w = series(keys, order)
    return {name.format(k): F.lag(col(value), k).over(w) for k in range(1, count + 1)}


def leads(value, keys, order, count: int, name: str) -> dict[str, Column]:
    w = series(keys, order)
    return {name.format(k): F.lead(col(value), k).over(w) for k in range(1, count + 1)}


def running_sum(value, keys, order) -> Column:
    w = series(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(col(value)).over(w)


def circular_mean(df: DataFrame, keys: Sequence[str], doy: str, value: str, out: str,
                  rows: int = 15, days: int = 366) -> DataFrame:
    """Centred mean over the days of a year, the last days next to the first."""
    half = rows // 2
    turned = df.select(
        "*", F.explode(F.array(*[F.lit(s * days) for s in (-1, 0, 1)])).alias("_turn"))
    turned = turned.withColumn("_place", F.col(doy) + F.col("_turn"))
    w = Window.partitionBy(*keys).orderBy("_place").rowsBetween(-half, half)
    return (turned.withColumn(out, F.avg(value).over(w))
            .where(F.col("_turn") == 0).drop("_turn", "_place"))


def runs(df: DataFrame, keys: Sequence[str], order: str, value: str,
         island: str = "run_id", length: str = "run_length") -> DataFrame:
    """Number the runs of equal consecutive values; a null on either side breaks a run."""
    w = series(keys, order)
    before = F.lag(value).over(w)
    starts = F.coalesce(F.col(value) != before, F.lit(True)).cast("int")
    numbered = (df.withColumn("_starts", starts)
                .withColumn(island, F.sum("_starts").over(
                    w.rowsBetween(Window.unboundedPreceding, 0)))
                .drop("_starts"))
    size = F.count(value).over(Window.partitionBy(*keys, island))
    return numbered.withColumn(length, F.when(F.col(value).isNotNull(), size))


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: str,
              out: str = "row_index") -> DataFrame:
    """Position of every row in its series, without a window over the whole series.

    ``bucket`` is a column that never falls as ``order`` rises (a day, an hour)
    and splits a series into pieces that fit a task.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(bucket)
    offsets = (df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
               .select(*keys, bucket, (F.sum("_n").over(w) - F.col("_n")).alias("_offset")))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    return (df.join(offsets, [*keys, bucket])
            .withColumn(out, F.col("_offset") + F.row_number().over(inside) - F.lit(1))
            .drop("_offset"))


def in_blocks(df: DataFrame, index: str, block_rows: int, halo: int,
              block: str = "block", copied: str = "is_copy") -> DataFrame:
    """Assign rows to blocks and copy the last ``halo`` rows of a block to the next one.

    Windows over (series, block) then see every row a trailing frame of
    ``halo + 1`` rows needs; drop the copies afterwards.
    """
    if halo > block_rows:
        raise ValueError("a halo must fit into one block")
    own = F.floor(F.col(index) / F.lit(block_rows)).cast("long")
    near_end = F.col(index) % F.lit(block_rows) >= F.lit(block_rows - halo)
    homes = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    spread = df.withColumn("_own", own).withColumn(block, F.explode(homes))
    return spread.withColumn(copied, F.col(block) != F.col("_own")).drop("_own")


def peak_intensity(slots: DataFrame, keys: Sequence[str], ts: str, value: str,
                   out: str = "precip_intensity_mm_hr", rows: int = 6,
                   block_rows: int = 4096) -> DataFrame:
    """Daily maximum of the sum of ``rows`` consecutive slots (null if one is null).

    The window counts rows and crosses midnight; the sum belongs to the day of
    its last slot. ``slots`` has one row per (keys, ts), so a day is a bounded
    bucket whatever the length of the series.
    """
    dated = slots.withColumn("date", F.to_date(ts))
    blocks = in_blocks(row_index(dated, keys, [ts], "date"), "row_index", block_rows, rows - 1)
    w = Window.partitionBy(*keys, "block").orderBy("row_index").rowsBetween(-(rows - 1), 0)
    summed = blocks.withColumn(
        "_sum", F.when(F.count(value).over(w) == rows, F.sum(value).over(w)))
    return (summed.where(~F.col("is_copy"))
            .groupBy(*keys, "date").agg(F.max("_sum").alias(out)))


def sequences(df: DataFrame, keys: Sequence[str], date: str, features: Sequence[str],
              length: int, out: str = "sequence") -> DataFrame:
    """Trailing matrix of features per row: nulls are 0, missing leading rows are zero rows."""
    row = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    seen = F.collect_list(row).over(trailing(keys, date, length))
    zero = F.array(*[F.lit(0.0)] * len(features))
    padding = F.array_repeat(zero, F.lit(length) - F.size(seen))
    return df.withColumn(out, F.concat(padding, seen))


def overlay_by_year(df: DataFrame, keys: Sequence[str], date: str, value: str) -> DataFrame:
    """Value by day of year, one line per year."""
    return (df.where(F.col(value).isNotNull())
            .select(*keys, F.year(date).alias("year"), F.dayofyear(date).alias("doy"), value))
