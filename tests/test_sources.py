"""Readers and sinks on files written by the test."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroflow.operators import aggregates as A
from hydroflow.sources import payloads as P
from hydroflow.sources import sinks as K
from hydroflow.sources import tables as S


def test_sensor_files_with_different_headers(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("\ufeffStn, Time ,Temp\nS-1,01/02/2024 00:10,21.5\nS-9,01/02/2024 00:10,1\n", "utf-8")
    b.write_text("Stn,Time,Rain\nS-1,31/02/2024 00:10,2\nS-1,02/02/2024 00:20,-\n", "utf-8")
    raw = S.read_sensor_csv(spark, {"temp": [str(a)], "rain": [str(b)]})
    rows = S.normalize_sensor_rows(raw, {"Stn": "station", "Time": "datetime", "Temp": "temperature_C", "Rain": "rainfall_mm"},
                                   {"S-1": "north"}, ("station", "datetime", "temperature_C", "rainfall_mm"))
    typed = S.cast_sensor_rows(rows, ("temperature_C", "rainfall_mm")).orderBy("ts").collect()
    assert [(r.station, r.ts, r.temperature_C, r.rainfall_mm) for r in typed] == [
        ("north", dt.datetime(2024, 2, 1, 0, 10), 21.5, None), ("north", dt.datetime(2024, 2, 2, 0, 20), None, None)]
    assert typed[0].source_order.file.endswith("a.csv")


def test_flow_csv_rules(spark, tmp_path):
    f = tmp_path / "flow.csv"
    f.write_text("1,7,x, RIV-A ,05/03/2020,0,0,2019\n"       # missing marker
                 "2,7,x,RIV-A,06/03/2020,0,0.0,2019\n"        # a real zero
                 "3,7,x,RIV-A,07/03/2020,12.5,1,2019,extra\n"  # over-long: skipped
                 "4,7,x,RIV-A,08/03/2020,3\n"                 # short: padded
                 "5,7,x,OUT,08/03/2020,3,1,2019\n"
                 "6,7,x,RIV-A,99/03/2020,3,1,2019\n")
    raw = S.read_flow_csv(spark, [str(f)])
    got = S.normalize_flow_rows(raw, {"RIV-A": "A"}, ["OUT"]).orderBy("date").collect()
    assert [(r.station, r.date.day, r.flow_m3) for r in got] == [("A", 5, None), ("A", 6, 0.0), ("A", 8, 3.0)]
    numeric = S.normalize_flow_rows(raw, {"RIV-A": "A"}, ["OUT"], rate_mode="numeric").orderBy("date").collect()
    assert [r.flow_m3 for r in numeric] == [None, None, 3.0]


def test_sheet_skips_three_title_rows(spark, tmp_path):
    f = tmp_path / "sheet.csv"
    f.write_text("Title,,,,,\n,,,,,\nid,code,name,date,flow,rate\n1,7,local,2020-03-05,4.5,1\n2,7,gone,2020-03-06,1,1\n3,7,local,2020-03-07,0,0\n")
    rows = S.read_sheet_csv(spark, [str(f)])
    got = S.normalize_sheet_rows(rows, {"local": "A-1"}, {"A-1": "A"}, ["gone"]).orderBy("date").collect()
    assert [(r.station, r.date.day, r.flow_m3) for r in got] == [("A", 5, 4.5), ("A", 7, None)]


def test_two_level_layouts_and_first_wins(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Survey_Date,Survey_Level\n01/9/1966,-210.1\n02/9/1966,-210.2\n")
    (tmp_path / "b.csv").write_text("\ufeffDate,Level\n1966-09-02,-999\n1966-09-03,-210.3\n\n  Downloaded from: x,\n", "utf-8")
    (tmp_path / "c.csv").write_text("Depth,Area\n1,2\n")
    levels = S.read_level_files(spark, [str(tmp_path / n) for n in ("a.csv", "b.csv", "c.csv")])
    kept = A.first_reading(levels, ["date"], "source_order").orderBy("date").collect()
    assert [(str(r.date), r.level_m) for r in kept] == [
        ("1966-09-01", -210.1), ("1966-09-02", -210.2), ("1966-09-03", -210.3)]


CURVE = [(-209, "4320", "100%"), (-209.5, "4230", "98%"), (-210, "4130", "96%"), (-210.5, "4070", "94%"), (-211, "3990", "92%"),
         (-211.5, "3900", "90%"), (-212, "3820", "88%"), (-212.5, "3740", "87%"), (-213, "3660", "85%")]


def test_curve_picks_the_larger_volume_column(spark):
    raw = spark.createDataFrame([("lake", str(level), a, b) for level, a, b in CURVE], "site string, l string, pct string, vol string")
    got = S.normalize_curve(raw, ["site"], "l", "vol", "pct").agg(F.max("volume_Mm3")).first()[0]
    assert got == 4320


def test_reanalysis_arrays(spark):
    body = json.dumps({"daily": {"time": ["2024-01-01", "2024-01-02"], "temperature_2m_max": [20.0, None],
                                 "wind_speed_10m_mean": [10.8, 3.6]}})
    df = spark.createDataFrame([("a", body), ("b", '{"daily": {}}')], "site string, body string")
    got = {(str(r.date), r.metric): r.value for r in P.parse_daily_arrays(df, ["site"], "body").collect()}
    assert got[("2024-01-01", "wind_speed_ms_mean")] == pytest.approx(3.0)
    assert got[("2024-01-01", "temperature_C_max")] == got[("2024-01-01", "temperature_max_C_max")] == 20
    assert len(got) == 4


def test_station_maps_to_daily_flow(spark):
    body = json.dumps({"2026-05-27 06:00:00": {"79": [15.5, 2.1], "5": [1, 1]}, "2026-05-27 06:10:00": {"79": [15.8, 2.1]},
                       "2026-05-27 06:20:00": {"79": [15.3, None]}, "2026-05-28 00:00:00": {"79": [None, 2.0]}})
    obs = P.parse_station_maps(spark.createDataFrame([(body,)], "body string"), [], "body", {"79": "upper"})
    daily = A.daily_flow(obs, ["station"], "ts", "flow_m3s").collect()
    assert len(daily) == 1 and daily[0].flow_m3 == pytest.approx((15.5 + 15.8 + 15.3) / 3 * 86400)


def test_script_rows_count_months_from_zero(spark):
    html = """<script>var date = new Date(2026, 4, 20); data.addRow([date, -212.535, null]);
      date = new Date(2025, 11, 31);\n data.addRow([ date, -213 , 1]); new Date(2026, 1, 30); data.addRow([date, -1, 0]);</script>"""
    got = P.parse_script_rows(spark.createDataFrame([(html,)], "html string"), [], "html").orderBy("date").collect()
    assert [(str(r.date), r.level_m) for r in got] == [("2025-12-31", -213.0), ("2026-05-20", -212.535)]


XML = """<Root><Location><LocationMetaData><LocationId>202</LocationId></LocationMetaData><LocationData>{}</LocationData></Location>
<Location><LocationMetaData><LocationId>9</LocationId></LocationMetaData><LocationData></LocationData></Location></Root>"""


def test_forecast_xml_to_requested_days(spark, tmp_path):
    steps = [(0, 20, 16, 0.5, 60, 10), (6, 30, 18, 1.0, 40, 14), (12, 28, 20, 0.0, 50, 14), (18, 22, 17, 0.0, 54, 10)]
    body = "".join(f"<Forecast><ForecastTime>2026-05-27 {h:02d}:00:00</ForecastTime><MaxTemp>{a}</MaxTemp><MinTemp>{b}</MinTemp>"
                   f"<Rain>{r}</Rain><RelativeHumidity>{rh}</RelativeHumidity><WindSpeed>{w}</WindSpeed></Forecast>"
                   for h, a, b, r, rh, w in steps)
    path = tmp_path / "f.xml"
    path.write_text(XML.format(body))
    rows = P.read_forecast_xml(spark, [str(path)], "202").withColumn("site", F.lit("a"))
    asked = spark.createDataFrame([("a", dt.date(2026, 5, 27)), ("a", dt.date(2026, 5, 28))], "site string, date date")
    first, second = A.six_hourly_to_daily(rows, ["site"], asked).orderBy("date").collect()
    assert (first.temp_max_C, first.temp_min_C, first.rainfall_mm, first.humidity_pct) == (30, 16, 1.5, 51)
    assert first.wind_speed_ms == pytest.approx(12 / 3.6) and second.temp_max_C is None
    with pytest.raises(Exception, match="location 1 not in forecast"):
        P.read_forecast_xml(spark, [str(path)], "1").collect()


def test_ensemble_files(spark, tmp_path):
    f = tmp_path / "e.csv"
    f.write_text("year,month,day,tmin,tmax,model,scenario\n2006,2,28,5,55,m,rcp\n2006,2,29,5,20,m,rcp\n")
    got = S.read_ensemble(spark, {"lake": [str(f)], "catchment": [str(f)]}).collect()
    assert sorted(r.site for r in got) == ["catchment", "lake"]
    assert all(r.tmax == 49 and r.doy == 59 for r in got)


def test_epoch_labels(spark):
    df = spark.createDataFrame([(3859200000, None, 1.0), (3859200000, "x", 2.0), (3859203600, "kept", 3.0)],
                               "epoch long, label string, v double")
    got = P.repair_labels(df, [], "epoch", order="v").orderBy("epoch").collect()
    assert [(r.label, r.v) for r in got] == [("16/04/2026 16:00", 1.0), ("kept", 3.0)]
    rewritten = P.repair_labels(df, [], "epoch", rewrite=True, order="v").orderBy("epoch").collect()
    assert rewritten[1].label == "16/04/2026 17:00"


SCHEMA = T.StructType([T.StructField("date", T.StringType()), T.StructField("x_mean", T.DoubleType()),
                       T.StructField("other", T.DoubleType())])


def test_aligned_append(spark, tmp_path):
    path = str(tmp_path / "t")
    new = spark.createDataFrame([("2024-01-01", 1.0, "z"), ("2024-01-02", 2.0, "z")], "date string, x_mean double, unknown string")
    assert K.append_aligned(new, path, SCHEMA) == 2
    assert K.append_aligned(new.where("false"), path, SCHEMA) == 0
    back = spark.read.parquet(path)
    assert back.columns == ["date", "x_mean", "other"] and back.where("other is null").count() == 2


def test_newer_than_drops_the_open_day(spark):
    day = dt.date(2024, 1, 1)
    df = spark.createDataFrame([("a", day + dt.timedelta(days=i)) for i in range(5)], "site string, date date")
    target = df.where(F.col("date") <= F.lit("2024-01-02").cast("date"))
    as_of = F.lit("2024-01-05").cast("date")
    got = K.newer_than(df, target, ["site"], "date", as_of, "2024-01-01")
    assert sorted(r.date.day for r in got.collect()) == [3, 4]
    today = K.newer_than(df, target, ["site"], "date", as_of, "2024-01-01", keep_today=True)
    assert sorted(r.date.day for r in today.collect()) == [3, 4, 5]
    empty = K.newer_than(df, target.where("false"), ["site"], "date", as_of, "2024-01-02")
    assert sorted(r.date.day for r in empty.collect()) == [2, 3, 4]


def test_materialize_reuses_and_forces(spark, tmp_path):
    path = str(tmp_path / "m")
    assert K.materialize(spark, path, lambda: spark.range(3)).count() == 3
    assert K.materialize(spark, path, lambda: spark.range(9)).count() == 3
    assert K.materialize(spark, path, lambda: spark.range(9), force=True).count() == 9


def test_upsert_and_export(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").select("v", "k")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    out = K.upsert(old, new, ["k"], str(tmp_path / "u"))
    assert out.columns == ["k", "v"] and sorted(map(tuple, out.collect())) == [(1, "a"), (2, "B"), (3, "C")]
    df = spark.createDataFrame([(1.23456789012345, 2.0, 0.0)], "level_m double, x double, z double")
    row = K.export_layout(df)
    assert row.columns == ["x", "z", "level_m"] and row.first().level_m == 1.23456789012


def test_forecast_input(spark):
    good = spark.createDataFrame([("2024-01-01", "20", "10", "", "50", "x")],
                                 "date string, temp_max_C string, temp_min_C string, rainfall_mm string, humidity_pct string, wind_speed_ms string")
    row = S.check_forecast(good).first()
    assert row.temp_max_C == 20 and row.rainfall_mm is None and row.wind_speed_ms is None and row.radiation_MJm2 is None
    assert S.incomplete_days(S.check_forecast(good)).first().n_incomplete == 1
    with pytest.raises(ValueError, match="humidity_pct"):
        S.check_forecast(good.drop("humidity_pct"))


def test_template_starts_after_the_last_day(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 2, 27))], "site string, date date")
    got = S.forecast_template(df, ["site"]).orderBy("date").collect()
    assert len(got) == 7 and str(got[0].date) == "2024-02-28" and got[2].date.month == 3 and got[0].rainfall_mm is None


def test_sensor_files_of_another_header_raise(spark, tmp_path):
    for name, header in (("a", "station,temp,rain"), ("b", "station,rain,temp")):
        (tmp_path / f"{name}.csv").write_text(f"{header}\nx,1,2\n")
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    with pytest.raises(Exception, match="(?i)header"):
        S.read_sensor_csv(spark, paths).collect()
    rows = S.read_sensor_csv(spark, {"a": paths[:1], "b": paths[1:]}).collect()
    assert {(r.station, r.temp, r.rain) for r in rows} == {("x", "1", "2"), ("x", "2", "1")}


# files by their own header -----------------------------------------------------------------------

def test_every_sensor_file_is_read_by_its_own_header(spark, tmp_path):
    folder = tmp_path / "a folder with spaces"
    folder.mkdir()
    (folder / "b 1.csv").write_text('\ufeffStation,"Date, time",Temp (C),"Sun (W/m""2)"\nNorth,01/01/2024 00:10,5.5,1\nNorth,01/01/2024 00:20,-,\n', encoding="utf-8")
    (folder / "a.csv").write_text(' Temp (C) , Station ,"Date, time",End\n7,South,01/01/2024 00:10,0007\n', encoding="utf-8")
    (folder / "c.csv").write_text('Station,"Date, time",Temp (C),"Sun (W/m""2)"\nElse,01/01/2024 00:10,9,1\n', encoding="utf-8")
    (folder / "empty.csv").write_text("")
    columns = {"Station": "station", "Date, time": "datetime", "Temp (C)": "temperature_C", 'Sun (W/m"2)': "global_radiation_Wm2",
               "End": "wind_speed_max10min_time"}
    heads = S.file_headers(spark, [str(folder)])
    assert {p.rsplit("/", 1)[1] for p in heads} == {"a.csv", "b 1.csv", "c.csv"}
    raw = S.read_sensor_files(spark, [str(folder)], columns)
    expected = ("station", "datetime", "temperature_C", "global_radiation_Wm2", "wind_speed_max10min_time")
    rows = S.normalize_sensor_rows(raw, {}, {"North": "n", "South": "s"}, expected)
    got = sorted(tuple(r)[:5] for r in rows.collect())
    assert got == [("n", "01/01/2024 00:10", "5.5", "1", None), ("n", "01/01/2024 00:20", None, None, None),
                   ("s", "01/01/2024 00:10", "7", None, "0007")]
    assert raw._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2  # one scan per header
    (folder / "d.csv").write_text("Station,Station\n1,2\n")
    with pytest.raises(ValueError, match="d.csv names a column twice"):
        S.read_sensor_files(spark, [str(folder)], columns)


def test_mixed_pivot_keeps_texts_and_drops_empty_columns(spark):
    rows = spark.createDataFrame([
        ("b", 1, 5.0, None, "0007", 1), ("b", 1, 6.0, None, None, 2), ("a", 1, None, None, "0010", 3), ("a", 2, None, None, None, 4),
        ("b", 3, None, None, "0030", 5), (None, 3, 1.0, None, None, 6), ("c", 9, None, None, None, 7)],
        "station string, ts int, temp double, rain double, hhmm string, source_order int")
    wide = A.pivot_sensors(rows, ["ts"], "station", ["temp", "rain", "hhmm"], "source_order")
    assert wide.columns == ["ts", "a_hhmm", "b_temp", "b_hhmm"]
    assert sorted(map(tuple, wide.collect())) == [(1, "0010", 6.0, "0007"), (3, None, None, "0030")]
    assert A.pivot_sensors(rows.limit(0), ["ts"], "station", ["temp", "hhmm"], "source_order").columns == ["ts"]


def test_bad_payloads_are_put_aside_with_their_reason(spark):
    good = json.dumps({"daily": {"time": ["2024-01-01", "2024-01-02"], "temperature_2m_max": [1.0, 2.0]}})
    bodies = [good, good[:50], "{}", None, "  ", json.dumps({"daily": {}}), json.dumps({"error": "no"}), "not json",
              json.dumps({"daily": {"time": ["2024-01-01"], "temperature_2m_max": [1.0, 2.0]}}),
              json.dumps({"daily": {"time": ["2024-13-01"], "temperature_2m_max": [1.0]}})]
    df = spark.createDataFrame(list(enumerate(bodies)), "k int, body string")
    fine, bad = P.quarantine(df, P.daily_array_fault("body"))
    assert {r.k: r.reason for r in bad.collect()} == {
        1: "malformed", 6: "no daily part", 7: "malformed", 8: "arrays of different length", 9: "unknown date"}
    rows = P.parse_daily_arrays(fine, ["k"], "body")
    assert {r.k for r in rows.collect()} == {0} and rows.count() == 4
    assert P.with_at_most(rows, bad, 5).count() == 4
    with pytest.raises(Exception, match="5 bad payloads, at most 4"):
        P.with_at_most(rows, bad, 4).collect()
    with pytest.raises(Exception, match="5 bad payloads"):
        P.with_at_most(rows.limit(0), bad).collect()
    assert sorted((r.reason, r.n_payloads) for r in P.fault_counts(bad).collect())[-1] == ("unknown date", 1)


def test_bad_station_maps_and_forecasts_are_put_aside(spark):
    maps = ['{"2026-05-27 06:00:00":{"79":[15.5,2.1]}}', '{"2026-05-27 06:00:00":{"79":[15.5', "", "[]", '{"yesterday":{"79":[1.0]}}', '{"error":true}']
    df = spark.createDataFrame(list(enumerate(maps)), "k int, body string")
    good, bad = P.quarantine(df, P.station_map_fault("body"))
    assert {r.k: r.reason for r in bad.collect()} == {1: "malformed", 4: "unknown time", 5: "malformed"}
    assert {r.k for r in P.parse_station_maps(good, ["k"], "body", {"79": "a"}).collect()} == {0}
    step = "<Forecast><ForecastTime>{}</ForecastTime><MaxTemp>30</MaxTemp></Forecast>"
    whole = "<Location><LocationMetaData><LocationId>1</LocationId></LocationMetaData><LocationData>" + step + "</LocationData></Location>"
    bodies = [whole.format("2024-01-01 06:00:00"), whole.format("2024-01-01 06:00:00")[:90], None, whole.format("noon"),
              whole.format("2024-01-01 06:00:00").replace("LocationId>", "Name>")]
    df = spark.createDataFrame(list(enumerate(bodies)), "k int, body string")
    good, bad = P.quarantine(df, P.forecast_fault("body"))
    assert {r.k: r.reason for r in bad.collect()} == {1: "malformed", 3: "unknown time", 4: "no location"}
    assert P.parse_forecast_xml(good, "body", "1").count() == 1
