"""Streams restart, drop duplicates and ignore late rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hydroflow import config as C
from hydroflow.sources import versions
from hydroflow.streaming import jobs as J
from hydroflow.streaming import replay as R

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "station string, ts timestamp_ntz, value double"


def land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_closed_days_drop_duplicates_and_open_day(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [("s", T0 + dt.timedelta(hours=h), 1.0) for h in range(30)]
    land(spark, path, rows + rows[:5], SCHEMA)
    schema = spark.read.parquet(path).schema
    stream = J.deduplicated(J.read_landed(spark, path, schema), ["station"])
    out = J.run_to_table(stream, "dedup")
    assert out.count() == 30
    days = J.run_to_table(J.closed_days(J.read_landed(spark, path, schema), ["station"]), "days").collect()
    assert [(str(r.date), r.n) for r in days] == [("2024-01-01", 29)]


def test_sums_of_batches_do_not_depend_on_the_order_of_files(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "sums")
    rows = [("s", T0 + dt.timedelta(hours=h), None if h == 3 else float(h)) for h in range(50)]
    land(spark, path, rows[30:], SCHEMA)
    struct = spark.read.parquet(path).schema

    def days():
        sums = J.run_partials(J.read_landed(spark, path, struct, files_per_trigger=1), ["station"], out)
        return {str(r.date): (r.sum, r.n, r.min) for r in J.days_of_partials(sums, ["station"]).collect()}

    assert days() == {"2024-01-02": (sum(range(30, 48)), 18, 30.0)}
    land(spark, path, rows[10:30], SCHEMA)  # older than what has been read, in two later files
    land(spark, path, rows[:10], SCHEMA)
    assert days() == {"2024-01-01": (sum(range(24)) - 3, 23, 0.0), "2024-01-02": (sum(range(24, 48)), 24, 24.0)}
    assert days() == {"2024-01-01": (sum(range(24)) - 3, 23, 0.0), "2024-01-02": (sum(range(24, 48)), 24, 24.0)}


def test_upsert_goes_on_after_a_restart(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "day int, version int, v double"
    land(spark, path, [(1, 5, 1.0), (2, 5, 2.0)], schema)
    struct = spark.read.parquet(path).schema
    J.run_upsert(J.read_landed(spark, path, struct), ["day"], "version", out)
    land(spark, path, [(1, 4, -1.0), (2, 6, 20.0), (3, 1, 3.0)], schema)
    table = J.run_upsert(J.read_landed(spark, path, struct), ["day"], "version", out)
    assert {r.day: r.v for r in table.collect()} == {1: 1.0, 2: 20.0, 3: 3.0}


def test_states_carry_over_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = "site string, date date, value double, rain double, et double"
    day = dt.date(2024, 1, 1)
    for batch in ([5.0, 5.0], [5.0, 5.0, None, 5.0]):
        start = 0 if len(batch) == 2 else 2
        land(spark, path, [("a", day + dt.timedelta(days=start + i), v, 10.0, 2.0) for i, v in enumerate(batch)], schema)
    struct = spark.read.parquet(path).schema
    alerts = J.run_to_table(J.stuck_sensor_alerts(J.read_landed(spark, path, struct, files_per_trigger=1).select(
        "site", "date", "value"), ["site"]), "alerts").collect()
    assert [(r.date.day, r.run_length) for r in alerts] == [(4, 4)]
    states = J.run_to_table(J.catchment_states(J.read_landed(spark, path, struct, files_per_trigger=1).select(
        "site", "date", "rain", "et"), ["site"]), "states").orderBy("date").collect()
    assert [r.bucket_S for r in states] == [83, 91, 99, 107, 115, 123]
    assert states[1].api == pytest.approx(19)


def test_soil_bucket_carries_storage_over_missing_values(spark):
    from hydroflow.operators.recurrences import soil_bucket

    rows = [("s", f"2024-01-0{i}", r, e) for i, (r, e) in enumerate([(10.0, 2.0), (None, 3.0), (5.0, None), (None, None)], 1)]
    days = spark.createDataFrame(rows, "site string, date string, rain double, et double").selectExpr("site", "to_date(date) AS date", "rain", "et")
    found = soil_bucket(days, ["site"], "date", "rain", "et", 100.0, 50.0).orderBy("date").collect()
    assert [r["bucket_S"] for r in found] == [58.0, 55.0, 60.0, 60.0]


# late days of keyed state ----------------------------------------------------------------------

def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def plain_states(rows, decay=0.9, s_max=150.0):
    api, s, out = 0.0, s_max / 2, {}
    for date, rain, et in sorted(rows):
        rain, et = rain or 0.0, et or 0.0
        level = s + rain - et
        api, s = decay * api + rain, min(max(level, 0.0), s_max)
        out[date] = (api, s, max(level - s_max, 0.0))
    return out


def test_late_days_are_replayed_and_corrected(spark, tmp_path):
    rng = random.Random(8)
    rows = [(day(i), None if i % 17 == 3 else rng.random() * 40, rng.random() * 8) for i in range(90)]
    order = rows[:]
    rng.shuffle(order)
    path, schema = str(tmp_path / "in"), "site string, date date, rain double, et double"
    for part in range(5):
        land(spark, path, [("a", *r) for r in order[part::5]] + [("b", *rows[part])], schema)
    struct = spark.read.parquet(path).schema
    table = J.run_to_table(J.catchment_states(J.read_landed(spark, path, struct, files_per_trigger=1), ["site"]), "replayed")
    found = {r.date: (r.api, r.bucket_S, r.bucket_Q) for r in R.newest(table, ["site"]).where("site = 'a'").collect()}
    expected = plain_states(rows, C.API_DECAY, C.BUCKET_S_MAX)
    assert found.keys() == expected.keys() and all(found[d] == pytest.approx(expected[d]) for d in expected)
    assert R.late_days(table).count() == 0 and table.where("site = 'a'").agg({"version": "max"}).first()[0] == 5
    assert R.newest(table, ["site"]).where("site = 'b'").count() == 5


def test_a_late_day_withdraws_an_alert_and_a_filled_gap_makes_one(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "site string, date date, value double"
    land(spark, path, [("a", day(i), 5.0) for i in (0, 1, 3, 4)] + [("b", day(i), 7.0) for i in (0, 2)], schema)
    land(spark, path, [("a", day(2), 6.0), ("b", day(1), 7.0)], schema)
    land(spark, path, [("a", day(2), 5.0), ("a", day(5), None)], schema)  # the day is delivered again
    struct = spark.read.parquet(path).schema
    table = J.run_to_table(J.stuck_sensor_alerts(J.read_landed(spark, path, struct, files_per_trigger=1), ["site"], 3), "alerts")
    steps = sorted((r.version, r.date.day, r.run_length) for r in table.where("site = 'a'").collect())
    assert steps == [(1, 4, 3), (1, 5, 4), (2, 4, None), (2, 5, None), (3, 3, 3), (3, 4, 4), (3, 5, 5)]
    last = sorted((r.site, r.date.day, r.run_length) for r in R.newest(table, ["site"]).collect())
    assert last == [("a", 3, 3), ("a", 4, 4), ("a", 5, 5), ("b", 3, 3)]


def test_days_older_than_all_kept_ones_are_counted_and_not_lost(spark, tmp_path):
    path, schema = str(tmp_path / "in"), "site string, date date, rain double, et double"
    rows = [(day(i), float(i % 7), 1.0) for i in range(60)]
    late = [(day(-3), 50.0, 1.0), (day(-2), 3.0, 1.0)]
    land(spark, path, [("a", *r) for r in rows[:55]], schema)  # the last ten stay within reach
    land(spark, path, [("a", *r) for r in rows[56:]], schema)
    land(spark, path, [("a", *r) for r in [*late, rows[55]]], schema)
    struct = spark.read.parquet(path).schema
    table = J.run_to_table(J.catchment_states(J.read_landed(spark, path, struct, files_per_trigger=1), ["site"], keep_days=10), "late")
    assert [tuple(r) for r in R.late_counts(table, ["site"]).collect()] == [("a", 2, day(-3), day(-2))]
    found = {r.date: (r.api, r.bucket_S, r.bucket_Q) for r in R.newest(table, ["site"]).collect()}
    expected = plain_states(rows, C.API_DECAY, C.BUCKET_S_MAX)
    assert found.keys() == expected.keys() and all(found[d] == pytest.approx(expected[d]) for d in expected)
    whole = R.with_late_days(spark.createDataFrame([("a", *r) for r in rows], schema), table, ["site"], ["rain", "et"])
    assert sorted((r.date, r.rain) for r in whole.collect()) == sorted((d, r) for d, r, _ in rows + late)


# tables by partition ---------------------------------------------------------------------------

def test_merge_rewrites_only_the_partitions_it_touches(spark, tmp_path):
    path, month = str(tmp_path / "t"), F.date_format("date", "yyyy-MM")
    schema = "site string, date date, v double"

    def frame(rows):
        return spark.createDataFrame(rows, schema)

    assert versions.read(spark, path) is None
    days = [("a", day(i), float(i)) for i in range(120)]
    assert versions.merge(frame(days), path, ["site", "date"], partition=month) == ["2024-01", "2024-02", "2024-03", "2024-04"]
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "t/data").rglob("*.parquet")}
    assert versions.merge(frame([("a", day(40), -1.0), ("b", day(41), -2.0)]), path, ["site", "date"], partition=month) == ["2024-02"]
    again = {f: f.stat().st_mtime_ns for f in (tmp_path / "t/data").rglob("*.parquet")}
    new = again.keys() - files.keys()
    assert {f.parent.name for f in new} == {"part=2024-02"} and all(again[f] == files[f] for f in files)
    table = {(r.site, r.date): r.v for r in versions.read(spark, path).collect()}
    assert len(table) == 121 and table["a", day(40)] == -1.0 and table["b", day(41)] == -2.0 and table["a", day(39)] == 39.0
    assert versions.merge(frame([("c", day(1), 0.0)]), path, ["site", "date"], partition=month, version=1) == []
    assert versions.read(spark, path).count() == 121
    assert versions.merge(frame([]), path, ["site", "date"], partition=month) == []
    assert versions.read(spark, path, ["2024-03"]).count() == 31
    assert versions.drop_unreferenced(spark, path) == ["v=0/part=2024-02"]
    assert versions.read(spark, path).count() == 121


def test_a_merge_that_fails_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, 1, 1.0), (2, 1, 2.0)], "k int, o int, v double")
    versions.merge(rows, path, ["k"], "o")
    broken = rows.withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("stop")).cast("double")).otherwise(-1.0)).withColumn("o", F.lit(9))
    with pytest.raises(Exception, match="stop"):
        versions.merge(broken, path, ["k"], "o")
    assert {r.k: r.v for r in versions.read(spark, path).collect()} == {1: 1.0, 2: 2.0}
    versions.merge(rows.withColumn("v", F.col("v") * 10).withColumn("o", F.col("k") - 1), path, ["k"], "o")
    assert {r.k: r.v for r in versions.read(spark, path).collect()} == {1: 1.0, 2: 20.0}  # older rows do not win


def test_sums_of_many_batches_stay_in_few_files(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "sums")
    for b in range(50):
        land(spark, path, [("s", T0 + dt.timedelta(hours=6 * (b % 8), minutes=b), float(b))], SCHEMA)
    struct = spark.read.parquet(path).schema
    sums = J.run_partials(J.read_landed(spark, path, struct, files_per_trigger=1), ["station"], out, slot="1 day")
    assert sorted((r.n, r["sum"]) for r in sums.collect()) == sorted(
        (sum(1 for b in range(50) if (b % 8) // 4 == k), float(sum(b for b in range(50) if (b % 8) // 4 == k))) for k in (0, 1))
    folders = [f for f in (tmp_path / "sums/data").glob("*/part=*")]
    assert len(folders) <= 4 and len(list((tmp_path / "sums/data").rglob("*.parquet"))) <= 16
