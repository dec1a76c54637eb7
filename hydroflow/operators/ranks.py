"""Exact ranks and quantiles of groups of any size.

A window or a ``percentile`` buffer over one key would put a hot key into one task. Here equal values are counted
first, in one pass over the source, and the counts are written. Their number says into how many slices they are
cut: bounds are picked from a small sorted sample, as a sort does, so a key of many distinct values gets many
slices and a key of few none. Slices are ranked on their own; what lies before a slice is added from a table that
has rows for cut keys only and is never larger than twice the number of slices.

Tables of one row per key come to the rows by ``beside_key_table`` or ``with_key_table``, which keep the rows of hot
keys apart from each other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroflow.session import write_and_read

#: Distinct values that one window ranks, and how many of them are looked at to place the bounds.
SLICE_ROWS = 1 << 20
SAMPLE_ROWS = 20
#: Keys whose row of a key table is broadcast: those with most rows. No other key has more than 1 / HOT_KEYS of all rows.
HOT_KEYS = 1024
#: Parts into which rows of a hot key are dealt when they are shuffled along with others.
SALTS = 1024


def with_key_table(rows: DataFrame, table: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """Inner join with a table of one row per key, whose column ``count`` says how many rows a key has.

    The ``HOT_KEYS`` largest keys are joined by a broadcast of that many rows, the others by their keys, so no
    task gets more than a small share of the rows, however many keys there are.
    """
    keys = list(keys)
    hot = F.broadcast(table.orderBy(F.desc(count), *keys).limit(HOT_KEYS))
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table, keys)
    return rows.join(hot, keys).unionByName(others)


def beside_key_table(rows: DataFrame, table: DataFrame, keys: Sequence[str], count: str, spread: str) -> DataFrame:
    """The join of ``with_key_table`` in one reading of the rows, for a table that is written.

    A table of no more than ``HOT_KEYS`` rows is broadcast. Beyond that the largest keys are, and rows go to the
    others by key; rows of a large key, which are served already, are dealt by their ``spread`` column meanwhile.
    """
    keys = list(keys)
    if table.limit(HOT_KEYS + 1).count() <= HOT_KEYS:
        return rows.join(F.broadcast(table), keys)
    added = [c for c in table.columns if c not in keys]
    packed = table.select(*keys, F.struct(*added).alias("_own"))
    hot = table.orderBy(F.desc(count), *keys).limit(HOT_KEYS).select(*keys, F.struct(*added).alias("_hot"))
    served = rows.join(F.broadcast(hot), keys, "left")
    deal = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(SALTS)) + 1).otherwise(F.lit(0))
    both = served.withColumn("_deal", deal).join(packed.withColumn("_deal", F.lit(0).cast("long")), [*keys, "_deal"], "left")
    found = F.coalesce("_hot", "_own")
    return both.where(found.isNotNull()).select(*rows.columns, *[found[c].alias(c) for c in added])


def _cuts(counts: DataFrame, keys: list[str], value: str, slices: int, n: int) -> list[tuple]:
    """(key values, cut values) of the keys that are cut, from a sorted sample of bounded size."""
    share = min(1.0, SAMPLE_ROWS * slices / n)
    sample = counts.select(*keys, value).sample(share, seed=7).orderBy(*keys, value).collect()
    bounds = sample[SAMPLE_ROWS // 2::SAMPLE_ROWS]
    return [(*key, [r[-1] for r in rows]) for key, rows in ((k, list(g)) for k, g in groupby(bounds, key=lambda r: tuple(r[:-1])))]


def _ranked(df: DataFrame, keys: list[str], value: str, sums: Mapping[str, Column],
            wanted: Sequence[float] | None = None, centred: bool = False) -> DataFrame:
    """Distinct values with n, n_below and n_total, and ``_mean`` of the key if ``centred``.

    With ``wanted`` shares, slices that hold none of these ranks are left out before the exchange.
    """
    weighted = F.col("n") * F.col(value).cast("double") if centred else F.lit(0.0)
    counts = write_and_read(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()]), "counts")
    n = counts.count()
    cuts = _cuts(counts, keys, value, n // SLICE_ROWS, n) if n > SLICE_ROWS else []
    whole = Window.partitionBy(*keys)
    if not cuts:
        upto = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.withColumns({"n_below": F.sum("n").over(upto) - F.col("n"), "n_total": F.sum("n").over(whole)})
        return ranked.withColumn("_mean", F.sum(weighted).over(whole) / F.col("n_total")) if centred else ranked
    spark, kinds = df.sparkSession, {f.name: f.dataType for f in counts.schema}
    schema = ", ".join([f"`_k{i}` {kinds[k].simpleString()}" for i, k in enumerate(keys)] + [f"_cuts array<{kinds[value].simpleString()}>"])
    table = F.broadcast(spark.createDataFrame(cuts, schema))  # no more rows than slices
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.lit(True))
    sliced = counts.join(table, same, "left").withColumn("_slice", F.lit(0))
    step = 1 << max(len(c[-1]) for c in cuts).bit_length()
    while step := step // 2:  # how many of the key's bounds lie below, by bisection
        below = F.get("_cuts", F.col("_slice") + F.lit(step - 1)) < F.col(value)
        sliced = sliced.withColumn("_slice", F.col("_slice") + F.when(below, step).otherwise(0))
    is_cut = F.col("_cuts").isNotNull()
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = sliced.where(is_cut).groupBy(*keys, "_slice").agg(F.sum("n").alias("_part"), F.sum(weighted).alias("_sum")).withColumns({
        "_before": F.coalesce(F.sum("_part").over(before), F.lit(0)), "_all": F.sum("_part").over(whole),
        "_whole_sum": F.sum("_sum").over(whole)})
    if wanted is not None:
        last = (F.col("_all") - 1).cast("double")
        edges = [f(F.lit(float(s)) * last) for s in wanted for f in (F.floor, F.ceil)]
        hit = reduce(lambda a, b: a | b, [(F.col("_before") <= e) & (e < F.col("_before") + F.col("_part")) for e in edges])
        parts = parts.withColumn("_hit", hit)
    names = [f"_p{i}" for i in range(len(keys))]
    parts = parts.select(*[F.col(k).alias(p) for k, p in zip(keys, names)], F.col("_slice").alias("_s"), *parts.columns[len(keys) + 1:])
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(p)) for k, p in zip(keys, names)], F.col("_slice") == F.col("_s"))
    sliced = sliced.drop("_cuts", *[f"_k{i}" for i in range(len(keys))]).join(F.broadcast(parts), match, "left")
    if wanted is not None:
        sliced = sliced.where(F.coalesce("_hit", F.lit(True)))
    inside = Window.partitionBy(*keys, "_slice")
    upto = inside.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = sliced.withColumn("n_below", F.sum("n").over(upto) - F.col("n") + F.coalesce("_before", F.lit(0))) \
                   .withColumn("n_total", F.coalesce("_all", F.sum("n").over(inside)))
    if centred:
        ranked = ranked.withColumn("_mean", F.coalesce("_whole_sum", F.sum(weighted).over(inside)) / F.col("n_total"))
    return ranked.select(*counts.columns, "n_below", "n_total", *["_mean"] * centred)


def ordered_counts(df: DataFrame, keys: Sequence[str], value: str,
                   sums: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per (keys, distinct value): ``n``, ``n_below`` and ``n_total``.

    ``sums`` adds further sums per distinct value. Null values are left out.
    """
    return _ranked(df, list(keys), value, dict(sums or {}))


def average_rank() -> Column:
    """Rank of a distinct value of ``ordered_counts``, ties sharing their mean rank."""
    return F.col("n_below") + (F.col("n") + F.lit(1)) / F.lit(2.0)


def _covers(value: str, shares: Mapping[str, float]) -> tuple[list[Column], dict[str, Column]]:
    """Aggregates that pick the values around each wanted rank, and the quantiles interpolated from them."""
    last = (F.col("n_total") - 1).cast("double")
    picks, out = [], {}
    for name, share in shares.items():
        spot = F.lit(float(share)) * last
        for side, edge in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            hit = (F.col("n_below") <= edge) & (edge < F.col("n_below") + F.col("n"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{side}"))
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out[name] = low + (high - low) * (spot - F.floor(spot))
    return picks, out


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    shares: Mapping[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per key, one column per entry of ``shares``.

    Of keys that are cut, only the slices that hold a wanted rank are shuffled and ranked.
    """
    keys = list(keys)
    ranked = _ranked(df, keys, value, {}, list(shares.values()))
    picks, out = _covers(value, shares)
    edges = ranked.groupBy(*keys).agg(F.first("n_total").alias("n_total"), *picks)
    return edges.select(*keys, *[c.alias(n) for n, c in out.items()])


def profile(df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """Quantiles with n, mean, min, max and the central moments m2, m3, m4 per key, from one reading of the rows.

    Moments are summed over the distinct values around the key's mean, which the window that ranks them gives.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    centred = _ranked(df, keys, value, {}, centred=True)
    gap = v - F.col("_mean")
    moments = [F.sum(F.col("n") * reduce(lambda a, b: a * b, [gap] * p)).alias(f"_s{p}") for p in (1, 2, 3, 4)]
    picks, out = _covers(value, shares)
    edges = centred.groupBy(*keys).agg(
        F.first("n_total").alias("n_total"), F.min(value).alias("min"), F.max(value).alias("max"), F.first("_mean").alias("_mean"),
        *moments, *picks)
    n = F.col("n_total").cast("double")
    d = F.col("_s1") / n  # what rounding left of the mean
    a2, a3, a4 = (F.col(f"_s{p}") / n for p in (2, 3, 4))
    return edges.select(
        *keys, F.col("n_total").alias("n"), (F.col("_mean") + d).alias("mean"), "min", "max", F.greatest(a2 - d * d, F.lit(0.0)).alias("m2"),
        (a3 - 3 * d * a2 + 2 * d * d * d).alias("m3"), (a4 - 4 * d * a3 + 6 * d * d * a2 - 3 * d * d * d * d).alias("m4"),
        *[c.alias(name) for name, c in out.items()])
