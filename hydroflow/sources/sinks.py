"""Appends, upserts, incremental filters, cached tables and exports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hydroflow import config as C
from hydroflow.functions.scalars import significant_digits
from hydroflow.operators.joins import replace_rows
from hydroflow.session import path_is_complete


def align_to(df: DataFrame, schema: StructType) -> DataFrame:
    """Project onto a table's columns in order: absent ones are null, unknown ones dropped."""
    return df.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in df.columns
         else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def append_aligned(df: DataFrame, path: str, schema: StructType,
                   partition_by: Sequence[str] = ()) -> int:
    """Append rows in the table's own layout and return how many; nothing new writes nothing.

    The count comes from the write itself, not from a second pass.
    """
    if df.isEmpty():
        return 0
    counted = Observation()
    rows = align_to(df, schema).observe(counted, F.count(F.lit(1)).alias("n"))
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)
    return counted.get["n"]


def newer_than(df: DataFrame, target: DataFrame, keys: Sequence[str], date: str, as_of: Column,
               default_start: str, keep_today: bool = False) -> DataFrame:
    """Rows after the target's last date per key, without the day that is not over.

    ``as_of`` is the date the job runs for; ``keep_today`` keeps that day's rows.
    """
    mark = target.groupBy(*keys).agg(F.max(date).alias("_mark"))
    default = F.date_sub(F.lit(default_start).cast("date"), 1)
    fresh = F.col(date) > F.coalesce("_mark", default)
    closed = F.col(date) <= as_of if keep_today else F.col(date) < as_of
    return df.join(mark, list(keys), "left").where(fresh & closed).drop("_mark")


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False,
                partition_by: Sequence[str] = ()) -> DataFrame:
    """The table at ``path``, built and written first unless a committed one is there."""
    if force or not path_is_complete(spark, path):
        build().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], path: str | None = None,
           partition_by: Sequence[str] = ()) -> DataFrame:
    """Replace rows by key and put the key first; with a path, write a new table there.

    The result goes to a new path and never over the table it was read from.
    """
    merged = replace_rows(existing, new, keys)
    ordered = merged.select(*keys, *[c for c in merged.columns if c not in keys])
    if path is None:
        return ordered
    ordered.repartitionByRange(*keys).sortWithinPartitions(*keys) \
           .write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return existing.sparkSession.read.parquet(path)


def export_layout(df: DataFrame, last: Sequence[str] = C.GOLD_TARGETS, digits: int = 12) -> DataFrame:
    """Doubles cut to significant digits, the target columns moved to the end."""
    front = [c for c in df.columns if c not in last]
    kinds = dict(df.dtypes)
    return df.select(*[
        significant_digits(c, digits).alias(c) if kinds[c] == "double" else F.col(c)
        for c in [*front, *[c for c in last if c in df.columns]]])


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "overwrite") -> None:
    """Write as parquet, CSV with a header, or JSON lines."""
    writer = df.write.mode(mode).partitionBy(*partition_by)
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)
