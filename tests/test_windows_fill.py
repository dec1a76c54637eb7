"""Windows, ranks and filling against plain pandas on small frames."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hydroflow.operators import aggregates as A
from hydroflow.operators import fill, ranks, windows as W

DAY0 = dt.date(2024, 1, 1)


def daily(spark, values, **extra):
    rows = [("a", DAY0 + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "site string, date date, value double")


def column(df, name, order="date"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


GAP = [0, None, None, None, None, None, None, 7, 8]


def test_prefix_fill_takes_first_three_rows_of_a_long_gap(spark):
    out = fill.interpolate(daily(spark, GAP), ["site"], "date", "value")
    assert column(out, "value") == pytest.approx([0, 1, 2, 3, None, None, None, 7, 8])


def test_whole_gap_fill_leaves_long_gaps(spark):
    out = fill.interpolate(daily(spark, [0, None, 2, *GAP]), ["site"], "date", "value", limit_mode="whole_gap")
    assert column(out, "value")[:6] == [0, 1, 2, 0, None, None]


def test_fill_stays_inside_the_active_span(spark):
    out = fill.interpolate(daily(spark, [None, 1, None, 3, None]), ["site"], "date", "value")
    assert column(out, "value") == [None, 1, 2, 3, None]


def test_row_interpolation_extends_edges_or_only_forward(spark):
    both = fill.interpolate_rows(daily(spark, [None, 2, None, 4, None]), ["site"], "date", "value")
    assert column(both, "value") == [2, 2, 3, 4, 4]
    forward = fill.interpolate_rows(daily(spark, [None, 2, None, 4, None]), ["site"], "date", "value", edges="forward")
    assert column(forward, "value") == [None, 2, 3, 4, 4]
    empty = fill.interpolate_rows(daily(spark, [None, None]), ["site"], "date", "value")
    assert column(empty, "value") == [0, 0]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-100, 100)), min_size=3, max_size=40))
def test_fill_equals_pandas(spark, values):
    ours = column(fill.interpolate(daily(spark, values), ["site"], "date", "value"), "value")
    series = pd.Series(values, dtype=float, index=pd.date_range(DAY0, periods=len(values)))
    want = series.interpolate(method="time", limit=3, limit_area="inside")
    np.testing.assert_allclose(np.array(ours, dtype=float), want.values, atol=1e-9)


def test_rolling_needs_enough_values(spark):
    df = daily(spark, [1, None, 3, 4])
    out = df.withColumn("s", W.rolling_sum("value", ["site"], "date", 3, 2))
    assert column(out, "s") == [None, None, 4, 7]


def test_centred_mean_matches_pandas(spark):
    values = list(np.arange(20.0) ** 2)
    df = daily(spark, values).withColumn("m", W.centred_mean("value", ["site"], "date", 5, 3))
    want = pd.Series(values).rolling(5, min_periods=3, center=True).mean()
    np.testing.assert_allclose(column(df, "m"), want.values)


def test_circular_mean_joins_year_ends(spark):
    rows = [("a", d, 366.0 if d == 366 else 0.0) for d in range(1, 367)]
    df = spark.createDataFrame(rows, "site string, doy int, v double")
    out = {r.doy: r.s for r in W.circular_mean(df, ["site"], "doy", "v", "s").collect()}
    assert out[1] == pytest.approx(366 / 15) and out[7] == pytest.approx(366 / 15) and out[8] == 0


def test_runs_break_on_null(spark):
    df = W.runs(daily(spark, [5, 5, None, 5, 5, 5, 6]), ["site"], "date", "value")
    assert column(df, "run_length") == [2, 2, None, 3, 3, 3, 1]


def slots(spark, values, start="2024-01-01 23:10:00"):
    t0 = dt.datetime.fromisoformat(start)
    rows = [("a", t0 + dt.timedelta(minutes=10 * i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "site string, ts timestamp_ntz, value double")


def test_intensity_crosses_midnight(spark):
    out = {str(r.date): r.peak for r in W.peak_intensity(
        slots(spark, [1.0] * 6), ["site"], "ts", "value", "peak", block_rows=5).collect()}
    assert out == {"2024-01-01": None, "2024-01-02": 6.0}
    hole = [1.0, 1.0, None, 1.0, 1.0, 1.0]
    out = W.peak_intensity(slots(spark, hole), ["site"], "ts", "value", "peak").collect()
    assert all(r.peak is None for r in out)


@pytest.mark.parametrize("block_rows", [5, 7, 64])
def test_blocked_window_equals_plain_window(spark, block_rows):
    rng = np.random.default_rng(1)
    ts = np.cumsum(rng.integers(1, 4000, 800))
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(t)), float(v))
            for t, v in zip(ts, rng.integers(0, 50, 800))]
    df = spark.createDataFrame(rows, "site string, ts timestamp_ntz, value double")
    blocked = W.peak_intensity(df, ["site"], "ts", "value", "peak", block_rows=block_rows)
    plain = pd.DataFrame(rows, columns=["site", "ts", "value"])
    want = plain.value.rolling(6).sum().groupby(plain.ts.dt.date).max()
    got = {r.date: r.peak for r in blocked.collect()}
    assert got == {d: (None if np.isnan(v) else v) for d, v in want.items()}


def test_sequence_is_padded_with_zero_rows(spark):
    df = daily(spark, [1, None, 3])
    out = W.sequences(df, ["site"], "date", ["value"], 3)
    assert column(out, "sequence") == [[[0.0], [0.0], [1.0]], [[0.0], [1.0], [0.0]], [[1.0], [0.0], [3.0]]]


def scores(spark, n=3000, seed=3):
    rng = np.random.default_rng(seed)
    hot = np.where(rng.random(n) < 0.4, 7.0, np.round(rng.normal(size=n), 2))
    key = np.where(rng.random(n) < 0.7, "hot", "cold")
    return pd.DataFrame({"k": key, "v": hot, "y": rng.random(n) < 0.3})


def test_exact_quantiles_equal_numpy_with_a_hot_value(spark):
    pdf = scores(spark)
    got = ranks.exact_quantiles(spark.createDataFrame(pdf), ["k"], "v",
                                {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.901, "e": 1.0}).toPandas().set_index("k")
    for k, part in pdf.groupby("k"):
        np.testing.assert_allclose(got.loc[k].values.astype(float), np.quantile(part.v, [0, .25, .5, .901, 1]))


@pytest.mark.parametrize("hot_keys", [1, 1024])
def test_key_tables_join_hot_and_other_keys_alike(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(ranks, "HOT_KEYS", hot_keys)
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 900, p=[.8, .1, .1]), "v": rng.integers(0, 60, 900) / 4})
    df = spark.createDataFrame(pdf)
    got = ranks.exact_quantiles(df, ["k"], "v", {"m": 0.5}).toPandas().set_index("k")["m"]
    assert got.to_dict() == pdf.groupby("k")["v"].median().to_dict()
    bins = A.histogram(df, ["k"], "v").toPandas().groupby("k")["n"].sum()
    assert bins.to_dict() == pdf["k"].value_counts().to_dict()
    assert set(A.density(df, ["k"], "v").toPandas().groupby("k").size()) == {300}


def test_a_hot_key_is_not_shuffled_to_meet_its_statistics(spark, monkeypatch):
    monkeypatch.setattr(ranks, "HOT_KEYS", 1)
    rows = spark.createDataFrame([("a", float(i % 7)) for i in range(50)] + [("b", 1.0)], "k string, v double")
    table = rows.groupBy("k").agg(F.count("v").alias("n"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = ranks.with_key_table(rows, table, ["k"], "n")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 51
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin [k" in plan and "LeftAnti, BuildRight" in plan


def in_slices(monkeypatch):
    monkeypatch.setattr(ranks, "SLICE_ROWS", 16)
    monkeypatch.setattr(ranks, "SAMPLE_ROWS", 4)


@pytest.mark.parametrize("cut", [False, True])
def test_ranks_quantiles_and_profiles_do_not_depend_on_slices(spark, monkeypatch, cut):
    if cut:
        in_slices(monkeypatch)
    pdf = scores(spark)
    pdf.loc[::50, "k"] = None
    pdf.loc[1::97, "v"] = None
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k string, v double, y boolean")
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.901, "e": 1.0}
    quantiles = {r.k: r for r in ranks.exact_quantiles(df, ["k"], "v", shares).collect()}
    profiles = {r.k: r for r in ranks.profile(df, ["k"], "v", shares).collect()}
    counts = {(r.k, r.v): r for r in ranks.ordered_counts(df, ["k"], "v").collect()}
    assert len(quantiles) == len(profiles) == 3
    for k in ("hot", "cold", None):
        v = pdf[pdf.k.isna() if k is None else pdf.k == k].v.dropna()
        np.testing.assert_allclose(list(quantiles[k])[1:], np.quantile(v, list(shares.values())))
        p, gap = profiles[k], v - v.mean()
        np.testing.assert_allclose([p[c] for c in shares], np.quantile(v, list(shares.values())))
        np.testing.assert_allclose([p.n, p["mean"], p["min"], p["max"], p.m2, p.m3, p.m4], [
            len(v), v.mean(), v.min(), v.max(), (gap ** 2).mean(), (gap ** 3).mean(), (gap ** 4).mean()], rtol=1e-9)
        for x, n in v.value_counts().items():
            assert (counts[k, x].n, counts[k, x].n_below, counts[k, x].n_total) == (n, (v < x).sum(), len(v))


def test_a_cut_key_is_ranked_in_slices_and_its_source_is_read_once(spark, monkeypatch, tmp_path):
    in_slices(monkeypatch)
    path = str(tmp_path / "scores")
    spark.createDataFrame(scores(spark)).write.parquet(path)
    ranked = ranks.ordered_counts(spark.read.parquet(path), ["k"], "v")
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "/scores" not in plan  # the counts are written, the source is not read again
    windows = [line for line in plan.split("\n") if "hashpartitioning(k" in line and "_slice" in line]
    assert plan.count("Exchange hashpartitioning") <= 3 and windows
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a few rows would share a task
    try:
        sizes = ranked.groupBy("k", F.spark_partition_id()).agg(F.sum("n_below"), F.sum("n_total")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([r for r in sizes if r.k == "hot"]) > 1


def test_density_equals_the_plain_kernel_sum(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 700, p=[.9, .1]), "v": np.where(rng.random(700) < .3, 4.0, rng.gamma(2, 30, 700))})
    got = A.density(spark.createDataFrame(pdf), ["k"], "v").toPandas()
    for k, part in pdf.groupby("k"):
        v, mine = part.v.values, got[got.k == k].sort_values("point")
        h = 1.06 * v.std() * len(v) ** -0.2
        x = v.min() - 3 * h + np.arange(300) * (v.max() - v.min() + 6 * h) / 299
        want = np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))
        np.testing.assert_allclose(mine.x, x)
        np.testing.assert_allclose(mine.density, want, rtol=1e-9, atol=1e-14)


def test_histogram_and_density_read_their_rows_twice(spark, tmp_path):
    path = str(tmp_path / "values")
    spark.createDataFrame(scores(spark)).write.parquet(path)
    df = spark.read.parquet(path)
    for made in (A.histogram(df, ["k"], "v"), A.density(df, ["k"], "v")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 2 and plan.count("FileScan parquet [k#") == 2  # the rows, and the written statistics
        assert len([line for line in plan.split("\n") if "FileScan" in line and "ReadSchema: struct<k:string,v:double>" in line]) == 1


def test_average_ranks_equal_pandas(spark):
    pdf = scores(spark)
    got = ranks.ordered_counts(spark.createDataFrame(pdf), ["k"], "v").withColumn(
        "r", ranks.average_rank()).toPandas().set_index(["k", "v"]).r
    want = pdf.assign(r=pdf.groupby("k").v.rank()).drop_duplicates(["k", "v"]).set_index(["k", "v"]).r
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


def test_auc_bounds_and_empty_class(spark):
    rng = np.random.default_rng(0)
    u = rng.random(2000)
    pdf = pd.DataFrame({"k": "x", "s": u, "y": rng.random(2000) < u})
    noise = pd.DataFrame({"k": "n", "s": rng.random(4000), "y": rng.random(4000) < 0.5})
    single = pd.DataFrame({"k": "one", "s": [1.0, 2.0, None], "y": [True, True, None]})
    got = A.roc_auc(spark.createDataFrame(pd.concat([pdf, noise, single])), ["k"], "s", "y")
    auc = {r.k: r.auc for r in got.collect()}
    assert auc["x"] > 0.7 and 0.45 < auc["n"] < 0.55 and auc["one"] is None


def test_profile_matches_pandas_skew_and_kurtosis(spark):
    pdf = scores(spark)
    got = A.column_profile(spark.createDataFrame(pdf[["k", "v"]]), ["k"], "v").toPandas().set_index("k")
    for k, part in pdf.groupby("k"):
        row = got.loc[k]
        np.testing.assert_allclose([row["skew"], row["kurt"], row["std"], row["median"]],
                                   [part.v.skew(), part.v.kurt(), part.v.std(), part.v.median()])


def test_density_integrates_to_one(spark):
    pdf = scores(spark)
    out = A.density(spark.createDataFrame(pdf[["k", "v"]]), ["k"], "v").toPandas()
    for _, part in out.groupby("k"):
        part = part.sort_values("x")
        assert len(part) == 300
        assert np.trapezoid(part.density, part.x) == pytest.approx(1, abs=0.01)


def test_spine_and_consensus(spark):
    rows = [("a", "main", DAY0, None), ("a", "x", DAY0, 2.0), ("a", "y", DAY0, 4.0),
            ("a", "main", DAY0 + dt.timedelta(days=2), 9.0), ("a", "x", DAY0 + dt.timedelta(days=2), 1.0)]
    df = spark.createDataFrame(rows, "site string, station string, date date, value double")
    agreed = fill.consensus(df, ["site", "date"], "station", "value", "main")
    dense = fill.on_spine(agreed, ["site"])
    assert column(dense, "value") == [3.0, None, 9.0]
    assert column(dense, "doy") == [1, 2, 3]


def test_first_reading_keeps_file_order(spark):
    rows = [("2024-01-01", 2, 5.0), ("2024-01-01", 1, 4.0), ("2024-01-02", 3, None)]
    df = spark.createDataFrame(rows, "date string, ord int, level_m double")
    got = {r.date: r.level_m for r in A.first_reading(df, ["date"], "ord").collect()}
    assert got == {"2024-01-01": 4.0, "2024-01-02": None}


def test_last_reading_skips_nulls(spark):
    df = spark.createDataFrame([("a", 1, 3.0), ("a", 2, None)], "k string, ord int, v double")
    assert A.last_reading(df, ["k"], "v", "ord").first().v == 3.0


def test_all_null_rain_is_null_and_radiation_zero(spark):
    rows = [("a", "s", dt.datetime(2024, 1, 1, 0, 10), p, None) for p in ("rainfall_mm", "global_radiation_Wm2")]
    df = spark.createDataFrame(rows, "site string, station string, ts timestamp_ntz, param string, value double")
    got = {r.metric: r.value for r in A.daily_parameters(df, ["site", "station"]).collect()}
    assert got["rainfall_mm_sum"] is None
    assert got["global_radiation_Wm2_sum"] == 0 and got["global_radiation_MJm2"] == 0
    strict = {r.metric: r.value for r in A.daily_parameters(df, ["site", "station"], strict=True).collect()}
    assert strict["global_radiation_Wm2_sum"] is None


def test_histogram_counts_every_value(spark):
    pdf = scores(spark)
    out = A.histogram(spark.createDataFrame(pdf[["k", "v"]]), ["k"], "v").toPandas()
    assert out.n.sum() == len(pdf) and out.bin.max() == 39


def test_null_profile_and_coverage(spark):
    df = daily(spark, [1, None, None, 4])
    assert A.null_profile(df, ["value"], ["site"]).first().null_pct == 50
    row = A.date_coverage(df, ["site"], "date", "value").first()
    assert (row.missing_days, row.missing_pct, row.span_days) == (2, 50, 4)
