"""The place of every row in one order over all rows, without a single task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroflow.llm.common import scratch_path


def written_in_order(rows: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """The rows with ``rank`` (from 0, gapless), and how many they are.

    Rows are cut into ranges of the order, sorted inside and written; a row's rank is its place in its file plus the
    rows of the files before. Only one number per file is summed over all files. ``order`` should tell all rows apart,
    so that no range is larger than the others.
    """
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, name)
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    table = spark.read.schema(rows.schema).parquet(path).select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = table.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    part = F.regexp_extract("_file", "part-(\\d+)", 1).cast("long")
    before = F.sum("_rows").over(Window.orderBy(part)) - F.col("_rows")
    found = files.select("_file", before.alias("_before"), "_rows").collect()  # one row per file
    if not found:
        return rows.withColumn("rank", F.lit(None).cast("long")).limit(0), 0
    starts = spark.createDataFrame([(r["_file"], r["_before"]) for r in found], "_file string, _before long")
    ranked = table.join(F.broadcast(starts), "_file").withColumn("rank", F.col("_before") + F.col("_row"))
    return ranked.select(*rows.columns, "rank"), sum(r["_rows"] for r in found)
