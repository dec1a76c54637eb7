"""Keyed tables that are merged partition by partition.

``path/data/v=N/part=P`` holds partition P as version N wrote it; ``path/current.json`` names the version and, for
each partition, the version that holds it. A merge reads and rewrites only the partitions that new rows lie in,
writes them below its own version and then puts the pointer file in place in one step. Readers see a version whole
or not at all; a merge that fails leaves files that nothing points to. ``drop_unreferenced`` removes those and
versions before the last two. The pointer has one entry per partition, so partitions should be few: years, months or days.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hydroflow.operators.joins import replace_rows

PART = "part"
#: Partition of tables that have no partition expression, and of null ones.
WHOLE = "all"


def _hadoop(spark: SparkSession, path: str):
    """(Hadoop's package, a path, its file context): tables may lie in any store that Spark reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    at = hadoop.fs.Path(path)
    return hadoop, at, hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()) \
        if at.toUri().getScheme() else hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file and put it in place of the one before in one step."""
    hadoop, at, _ = _hadoop(spark, path)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at)
    _, whole, files = _hadoop(spark, whole.toString())
    new = hadoop.fs.Path(whole.getParent(), f".{whole.getName()}.new")
    system = whole.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(new, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.valueOf("OVERWRITE")
    files.rename(new, whole, options)


def current(spark: SparkSession, path: str) -> dict | None:
    """The pointer: version, schema and the version of each partition; None where there is no table."""
    try:
        text = spark.read.text(f"{path}/current.json", wholetext=True).first()
    except AnalysisException:
        return None
    return json.loads(text[0])


def _folder(path: str, part: str, version: int) -> str:
    return f"{path}/data/v={version}/{PART}={part}"


def read(spark: SparkSession, path: str, parts: Sequence[str] | None = None) -> DataFrame | None:
    """The current version, or of it the given partitions only; None where there is no table."""
    now = current(spark, path)
    if now is None:
        return None
    schema = StructType.fromJson(now["schema"])
    held = [_folder(path, p, v) for p, v in sorted(now["parts"].items()) if parts is None or p in parts]
    return spark.read.schema(schema).parquet(*held) if held else spark.createDataFrame([], schema)


def newest_rows(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, that with the largest ``order``; each column on its own, so that the sums stay hash aggregates."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    marked = rows.groupBy(*keys).agg(F.max(order).alias(order), *[
        F.max_by(F.struct(c), order).alias(c) if rows.schema[c].dataType.typeName() in ("array", "map", "struct")
        else F.max_by(c, order).alias(c) for c in rest])
    return marked.select(*[F.col(c)[c].alias(c) if rows.schema[c].dataType.typeName() in ("array", "map", "struct")
                           else F.col(c) for c in rows.columns])


def rewrite(new: DataFrame, path: str, keys: Sequence[str], combine: Callable[[DataFrame, DataFrame], DataFrame],
            partition: Column | None = None, version: int | None = None) -> list[str]:
    """Put ``combine(old rows, new rows)`` in place of the partitions that the new rows lie in; return these.

    ``partition`` must be an expression of the keys, so that a key never moves. A ``version`` that the table
    already has is not written again, so that a repeated batch is harmless.
    """
    spark = new.sparkSession
    now = current(spark, path) or {"version": -1, "parts": {}, "schema": None}
    number = now["version"] + 1 if version is None else version
    if number <= now["version"]:
        return []
    place = F.lit(WHOLE) if partition is None else F.coalesce(partition.cast("string"), F.lit(WHOLE))
    touched = sorted(r[0] for r in new.select(place.alias(PART)).distinct().collect())
    known = [p for p in touched if p in now["parts"]]
    rows = combine(read(spark, path, known), new) if known else new
    if touched:
        rows.select(*new.columns, place.alias(PART)).repartition(PART, *keys).write.mode("overwrite") \
            .partitionBy(PART).parquet(f"{path}/data/v={number}")
    put_text(spark, f"{path}/current.json", json.dumps({
        "version": number, "parts": now["parts"] | {p: number for p in touched}, "before": now["parts"],
        "schema": now["schema"] or json.loads(new.schema.json())}))
    return touched


def merge(new: DataFrame, path: str, keys: Sequence[str], order: str | None = None, partition: Column | None = None,
          version: int | None = None) -> list[str]:
    """Replace rows by key in the table at ``path`` and return the partitions that were rewritten.

    With ``order`` the row with the largest value of that column wins, old or new; without it new rows win, and of
    several new rows of a key all stay.
    """
    def combine(old: DataFrame, fresh: DataFrame) -> DataFrame:
        if order:
            seen = fresh.join(old.select(*keys, F.col(order).alias("_old")), list(keys), "left")
            fresh = seen.where(F.col("_old").isNull() | (F.col(order) >= F.col("_old"))).drop("_old")
        return replace_rows(old, fresh, keys)

    return rewrite(newest_rows(new, keys, order) if order else new, path, keys, combine, partition, version)


def drop_unreferenced(spark: SparkSession, path: str) -> list[str]:
    """Remove partition folders that neither the current version nor the one before points to; return their names.

    For times when no merge is under way; readers of the last two versions are not disturbed.
    """
    now = current(spark, path)
    if now is None:
        return []
    hadoop, data, _ = _hadoop(spark, f"{path}/data")
    system = data.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = {(f"v={v}", f"{PART}={p}") for parts in (now["parts"], now["before"]) for p, v in parts.items()}
    gone = []
    for version in system.listStatus(data) if system.exists(data) else []:
        folders = [f for f in system.listStatus(version.getPath()) if f.isDirectory()]
        old = [f for f in folders if (version.getPath().getName(), f.getPath().getName()) not in held]
        for f in old:
            system.delete(f.getPath(), True)
            gone.append(f"{version.getPath().getName()}/{f.getPath().getName()}")
        if len(old) == len(folders):
            system.delete(version.getPath(), True)
    return sorted(gone)
