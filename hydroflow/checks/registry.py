"""Registered queries: a Spark job on the driver tables, with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: dict[str, int], default: int) -> DataFrame:
    """Round every double (no negative zero), so equal results compare as equal."""
    return df.select(*[
        (F.round(c, digits.get(c, default)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)
        for c, t in df.dtypes])


def query(name: str, sql: str | None = None, floats: str = "", digits: int = 6):
    """Register ``fn(spark, sf_dir)``.

    ``floats`` names the double columns of the SQL twin, as ``name`` or
    ``name:digits``; both sides are rounded alike.
    """
    places = {c: int(p or digits) for c, _, p in (f.partition(":") for f in floats.split())}

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return rounded(fn(spark, sf_dir), places, digits)

        QUERIES[name] = run
        if sql is not None:
            swaps = ", ".join(f'round("{c}", {p}) + 0.0 AS "{c}"' for c, p in places.items())
            ORACLES[name] = f"SELECT * REPLACE ({swaps}) FROM ({sql})" if places else sql
        return fn
    return register
