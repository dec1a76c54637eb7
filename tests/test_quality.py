"""Quality layers with the exact quirks they reproduce."""

import datetime as dt

import pytest

from hydroflow.operators import quality as Q
from hydroflow.plans import gold

DAY0 = dt.date(2024, 1, 1)
KEYS = ("site", "station", "metric")
SCHEMA = "site string, station string, date date, metric string, value double"


def series(spark, metric, values, start=DAY0):
    rows = [("a", "s", start + dt.timedelta(days=i), metric, None if v is None else float(v))
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def values(checked):
    return [r.value for r in checked.orderBy("date").collect()]


def test_bounds_are_inclusive_and_logged(spark):
    checked = Q.apply_layers(series(spark, "relative_humidity_pct_mean", [0, 100, 100.5, -1, None]), [Q.physical_bounds()])
    assert values(checked) == [0, 100, None, None, None]
    log = Q.change_log(checked, ("site", "station")).orderBy("date").collect()
    assert [(r.original_value, r.new_value, r.reason, r.layer, r.layer_raw) for r in log] == [
        (100.5, None, "physical_bounds [0, 100]", "physical_bounds", "physical"),
        (-1.0, None, "physical_bounds [0, 100]", "physical_bounds", "physical")]


def test_unbounded_metric_passes(spark):
    assert values(Q.apply_layers(series(spark, "other", [1e9]), [Q.physical_bounds()])) == [1e9]


def test_iqr_works_per_month(spark):
    calm = [10, 11, 10, 11, 10, 11, 10, 11, 10, 11, 10, 60]
    lively = [10, 60, 10, 60, 10, 60, 10, 60, 10, 60, 10, 60]
    df = series(spark, "m", calm).unionByName(series(spark, "m", lively, dt.date(2024, 2, 1)))
    checked = Q.apply_layers(df, [Q.monthly_iqr(KEYS)])
    assert values(checked) == calm[:-1] + [None] + lively
    log = Q.change_log(checked, ("site", "station")).collect()
    assert [r.reason for r in log] == ["monthly_IQR month=1 [7.00, 14.00]"] and log[0].layer_raw == "monthly"


def test_iqr_skips_sums(spark):
    calm = [10, 11, 10, 11, 10, 11, 10, 11, 10, 11, 10, 60]
    assert values(Q.apply_layers(series(spark, "rainfall_mm_sum", calm), [Q.monthly_iqr(KEYS)])) == calm


def test_coverage_threshold_and_energy_quirk(spark):
    table = spark.createDataFrame([("a", "s", DAY0, 100 / 144), ("a", "s", DAY0 + dt.timedelta(days=1), 101 / 144)],
                                  "site string, station string, date date, coverage double")
    df = series(spark, "temperature_C_mean", [1, 2, 3]).unionByName(series(spark, "global_radiation_MJm2", [1, 2, 3]))
    checked = Q.apply_layers(df, [Q.coverage(table, ("site", "station"))])
    got = {(r.metric, r.date.day): r.value for r in checked.collect()}
    assert got[("temperature_C_mean", 1)] is None and got[("temperature_C_mean", 2)] == 2
    assert got[("temperature_C_mean", 3)] == 3 and got[("global_radiation_MJm2", 1)] == 1
    log = Q.change_log(checked, ("site", "station")).collect()
    assert [r.reason for r in log] == ["coverage 69% < 70%"] and log[0].layer_raw == "coverage 69% < 70%"
    strict = Q.apply_layers(df, [Q.coverage(table, ("site", "station"), strict=True)])
    assert {(r.metric, r.date.day): r.value for r in strict.collect()}[("global_radiation_MJm2", 1)] is None


def test_persistence_needs_an_unbroken_run(spark):
    df = series(spark, "wind_speed_ms_mean", [5, 5, 5, 1, 7, 7, None, 7, 7, 2, 8, 8, 8, 8])
    assert values(Q.apply_layers(df, [Q.persistence(KEYS)])) == \
        [5, 5, 5, 1, 7, 7, None, 7, 7, 2, None, None, None, None]
    rain = series(spark, "rainfall_mm_sum", [0, 0, 0, 0, 0])
    assert values(Q.apply_layers(rain, [Q.persistence(KEYS)])) == [0] * 5


def test_fill_layer_logs_new_values(spark):
    checked = Q.apply_layers(series(spark, "flow_m3", [1, None, 3]), [Q.fill_gaps(KEYS)])
    row = Q.change_log(checked, ("site", "station")).first()
    assert (row.original_value, row.new_value, row.reason) == (None, 2.0, "interpolated_gap<=3d")


def test_flow_chain_and_summary(spark):
    rows = [("a", "s", DAY0 + dt.timedelta(days=i), v) for i, v in enumerate([4.0, -1.0, 6.0, None, 8.0])]
    checked = gold.flow_silver(spark.createDataFrame(rows, "site string, station string, date date, flow_m3 double"))
    assert values(checked) == pytest.approx([4, 5, 6, 7, 8])
    summary = {r.layer: (r.n, r.percent) for r in Q.log_summary(checked).collect()}
    assert summary == {"physical_bounds": (1, 20.0), "interpolated": (2, 40.0)}
    assert Q.most_changed(checked, ("site", "station")).first().n == 1


def test_met_silver_runs_all_layers(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", "s", t0 + dt.timedelta(minutes=10 * i), "temperature_C", 20.0 + i % 7, i) for i in range(144)]
    rows += [("a", "s", t0 + dt.timedelta(days=1, minutes=10 * i), "temperature_C", 20.0, i) for i in range(20)]
    df = spark.createDataFrame(rows, "site string, station string, ts timestamp_ntz, param string, value double, src_ord long")
    got = {(r.metric, r.date.day): r.value for r in gold.daily_silver(df).collect()}
    assert got[("temperature_C_max", 1)] == 26 and got[("temperature_C_max", 2)] is None
