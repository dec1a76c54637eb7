"""Structured Streaming twins of the incremental steps: closed days, intensity, upserts, states.

Event time is a UTC ``timestamp``; checkpoints and outputs lie below the shared
folder of the session, so a restarted job goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroflow import config as C
from hydroflow.session import scratch_path
from hydroflow.sources import versions
from hydroflow.streaming.replay import KEEP_DAYS, catchment, replayed, stuck_sensor


def read_landed(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet",
                files_per_trigger: int = 1000) -> DataFrame:
    """Stream of landed files, a bounded number per batch."""
    return (spark.readStream.schema(schema).format(kind)
            .option("maxFilesPerTrigger", files_per_trigger).load(path))


def deduplicated(readings: DataFrame, keys: Sequence[str], ts: str = "ts",
                 lateness: str = "10 minutes") -> DataFrame:
    """Drop re-delivered readings of the same (keys, time) within the watermark."""
    timed = readings.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return timed.dropDuplicatesWithinWatermark([*keys, ts])


def closed_days(readings: DataFrame, keys: Sequence[str], value: str = "value", ts: str = "ts",
                lateness: str = "10 minutes") -> DataFrame:
    """Daily aggregates of days the watermark has passed (append mode)."""
    timed = readings.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return (timed.groupBy(*keys, F.window(ts, "1 day").alias("w"))
            .agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"),
                 F.sum(value).alias("sum"), F.count(value).alias("n"))
            .select(*keys, F.to_date("w.start").alias("date"), "mean", "max", "min", "sum", "n"))


def sliding_hour(readings: DataFrame, keys: Sequence[str], value: str = "value", ts: str = "ts",
                 lateness: str = "10 minutes", slots: int = 6) -> DataFrame:
    """Hourly sums every ten minutes, null unless all slots of the hour are there."""
    timed = readings.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)
    return (timed.groupBy(*keys, F.window(ts, "1 hour", "10 minutes").alias("w"))
            .agg(F.sum(value).alias("_sum"), F.count(value).alias("n"))
            .select(*keys, F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                    F.when(F.col("n") == slots, F.col("_sum")).alias("hour_sum"), "n"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append", out: str | None = None,
                 state: str | None = None) -> DataFrame:
    """Process everything available, write parquet, return it as a batch table.

    With fixed paths for the table and the checkpoint a later call goes on where this one
    stopped; without them both are new folders below the shared one.
    """
    spark = stream.sparkSession
    out, state = out or scratch_path(spark, name), state or scratch_path(spark, f"{name}-state")
    query = (stream.writeStream.format("parquet").outputMode(mode).option("path", out)
             .option("checkpointLocation", state).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


#: Batches after which folders of replaced sums are removed.
TIDY_EVERY = 10


def run_partials(stream: DataFrame, keys: Sequence[str], path: str, value: str = "value", ts: str = "ts",
                 slot: str = "10 minutes", tidy_every: int = TIDY_EVERY) -> DataFrame:
    """Sums per key and slot, kept below ``path`` in one folder a day; the table of all batches so far.

    No row is late here: a batch adds its sums to those of the days it has rows of, so files may arrive in any
    order and any number per batch, and days without new rows are neither read nor written. A batch that is
    repeated after a failure adds nothing twice (``sources.versions``), and a later call with the same path goes
    on with the files that are new. Replaced folders are removed every ``tidy_every`` batches.
    """
    spark = stream.sparkSession
    by = [*keys, "slot"]

    def joined(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*by).agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"), F.min("min").alias("min"),
                                     F.max("max").alias("max"), F.max("last").alias("last"))

    def add(batch: DataFrame, number: int) -> None:
        timed = batch.withColumn(ts, F.col(ts).cast("timestamp"))
        sums = timed.groupBy(*keys, F.window(ts, slot).alias("w")).agg(
            F.sum(value).alias("sum"), F.count(value).alias("n"), F.min(value).alias("min"),
            F.max(value).alias("max"), F.max(ts).alias("last"))
        sums = sums.select(*keys, F.col("w.start").alias("slot"), "sum", "n", "min", "max", "last")
        versions.rewrite(sums, path, by, lambda old, new: joined(old.unionByName(new)), F.to_date("slot"), number)
        if number % tidy_every == tidy_every - 1:
            versions.drop_unreferenced(spark, path)

    query = (stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}-state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    table = versions.read(spark, path)
    if table is not None:
        return table
    kinds = {"sum": "double", "n": "long", "min": stream.schema[value].dataType.simpleString(),
             "max": stream.schema[value].dataType.simpleString(), "slot": "timestamp", "last": "timestamp"}
    fields = ", ".join([f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys]
                       + [f"{name} {kinds[name]}" for name in ("slot", "sum", "n", "min", "max", "last")])
    return spark.createDataFrame([], fields)


def _closed_at(partials: DataFrame, lateness: str) -> Column:
    """The newest event time less the lateness, as a scalar subquery."""
    newest = partials.agg(F.max("last").alias("newest"))
    return newest.select(F.col("newest") - F.expr(f"INTERVAL {lateness}")).scalar()


def days_of_partials(partials: DataFrame, keys: Sequence[str], lateness: str = "10 minutes") -> DataFrame:
    """The rows of ``closed_days`` from the sums of all batches: the same whatever a batch held."""
    days = partials.groupBy(*keys, F.to_date("slot").alias("date")).agg(
        F.max("max").alias("max"), F.min("min").alias("min"), F.sum("sum").alias("sum"), F.sum("n").alias("n"))
    over = F.date_add("date", 1).cast("timestamp") <= _closed_at(partials, lateness)
    return days.where(over).select(*keys, "date", F.when(F.col("n") > 0, F.col("sum") / F.col("n")).alias("mean"),
                                   "max", "min", "sum", "n")


def hours_of_partials(partials: DataFrame, keys: Sequence[str], lateness: str = "10 minutes",
                      slots: int = 6) -> DataFrame:
    """The rows of ``sliding_hour`` from ten-minute sums of all batches."""
    hours = partials.groupBy(*keys, F.window("slot", "1 hour", "10 minutes").alias("w")).agg(
        F.sum("sum").alias("_sum"), F.sum("n").alias("n"))
    return hours.where(F.col("w.end") <= _closed_at(partials, lateness)).select(
        *keys, F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        F.when(F.col("n") == slots, F.col("_sum")).alias("hour_sum"), "n")


def run_upsert(stream: DataFrame, keys: Sequence[str], order: str, path: str, partition: Column | None = None) -> DataFrame:
    """Merge each batch into a keyed table: the newest row per key wins, whatever the order of arrival.

    ``partition`` is an expression of the keys; a batch rewrites the partitions that its keys lie in and no
    others. Batch n makes version n of the table at ``path`` (see ``sources.versions``), so a batch that is
    repeated after a failure changes nothing twice, also in a new process.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        versions.merge(batch, path, keys, order, partition, number)

    query = (stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}-state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    table = versions.read(spark, path)
    return spark.createDataFrame([], stream.schema) if table is None else table


# keyed state ---------------------------------------------------------------------------------

def stuck_sensor_alerts(days: DataFrame, keys: Sequence[str], min_run: int = C.PERSISTENCE_RUN,
                        keep_days: int = KEEP_DAYS) -> DataFrame:
    """Alerts on runs of identical values (one row per key and date in), corrected when days come late."""
    return replayed(days, keys, stuck_sensor(min_run), keep_days)


def catchment_states(days: DataFrame, keys: Sequence[str], keep_days: int = KEEP_DAYS) -> DataFrame:
    """Antecedent index and soil bucket of each site and day, corrected when days come late."""
    return replayed(days, keys, catchment(), keep_days)
