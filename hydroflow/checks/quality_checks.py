"""QC-1 .. QC-6 on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydroflow import config as C
from hydroflow.checks import views as V
from hydroflow.checks.aggregates_checks import BOUNDED_SQL
from hydroflow.checks.registry import query
from hydroflow.operators import quality as Q
from hydroflow.operators.aggregates import last_reading
from hydroflow.plans import gold

SERIES = gold.SERIES


@query("qc_1_physical_bounds", V.with_views(BOUNDED_SQL) + """
    SELECT site, station, date, metric, CASE WHEN NOT bad THEN value END AS value FROM marked""", "value")
def qc_1(spark, d):
    return Q.clean_table(Q.apply_layers(V.silver(spark, d), [Q.physical_bounds()]))


@query("qc_1_not_negative", V.with_views(V.GAPPY_SQL) + """
    SELECT site, station, date, 'flow_m3' AS metric, CASE WHEN value - 200000 >= 0 THEN value - 200000 END AS value
    FROM gappy""", "value")
def qc_1b(spark, d):
    flows = V.gappy(spark, d).withColumn("metric", F.lit("flow_m3")) \
        .withColumn("value", F.col("value") - 200000)
    return Q.clean_table(Q.apply_layers(flows, [Q.not_negative()])) \
            .select("site", "station", "date", "metric", "value")


def fence(source: str, multiplier: float) -> str:
    return f"""q AS (SELECT site, station, metric, month(date) AS m, quantile_cont(value, 0.25) AS q1,
             quantile_cont(value, 0.75) AS q3 FROM {source} GROUP BY ALL),
    fenced AS (SELECT s.*, q1 - {multiplier} * (q3 - q1) AS lo, q3 + {multiplier} * (q3 - q1) AS hi, m
      FROM {source} s JOIN q ON s.site = q.site AND s.station = q.station AND s.metric = q.metric
           AND month(s.date) = q.m)"""


OUTSIDE = "(value < lo OR value > hi) AND NOT suffix(metric, '_sum')"


@query("qc_2_monthly_iqr", V.with_views(V.SILVER_SQL, fence("silver", 1.0)) + f"""
    SELECT site, station, date, metric, CASE WHEN NOT ({OUTSIDE}) THEN value END AS value FROM fenced""", "value")
def qc_2(spark, d):
    return Q.clean_table(Q.apply_layers(V.silver(spark, d), [Q.monthly_iqr(SERIES, 1.0)]))


COVERAGE_SQL = V.READINGS_SQL + """, slots AS (
    SELECT site, station, ts, arg_max(value, src_ord) AS value FROM readings
    WHERE param = 'temperature_C' GROUP BY ALL),
cov AS (SELECT site, station, CAST(ts AS DATE) AS date, count(value) / 144.0 AS coverage FROM slots GROUP BY ALL)"""


@query("qc_3_slot_coverage", V.with_views(COVERAGE_SQL) + "SELECT * FROM cov", "coverage")
def qc_3(spark, d):
    return Q.slot_coverage(temperature_slots(spark, d), gold.STATION, "ts", "value")


def temperature_slots(spark, d):
    seen = V.readings(spark, d).where("param = 'temperature_C'")
    return last_reading(seen, [*gold.STATION, "ts"], "value", "src_ord")


@query("qc_3_coverage_layer", V.with_views(COVERAGE_SQL) + """
    , daily AS (SELECT site, station, CAST(ts AS DATE) AS date, 'rainfall_mm_sum' AS metric, sum(value) AS value
                FROM readings WHERE param = 'rainfall_mm' GROUP BY ALL
      UNION ALL SELECT site, station, CAST(ts AS DATE) AS date, 'global_radiation_MJm2' AS metric,
                sum(value) * 600 / 1e6 AS value FROM readings WHERE param = 'global_radiation_Wm2' GROUP BY ALL)
    SELECT d.site, d.station, d.date, metric,
           CASE WHEN metric = 'rainfall_mm_sum' AND coverage < 0.09 THEN NULL ELSE value END AS value
    FROM daily d LEFT JOIN cov c ON d.site = c.site AND d.station = c.station AND d.date = c.date""", "value")
def qc_3b(spark, d):
    reads = V.readings(spark, d)
    day = [*gold.STATION, F.to_date("ts").alias("date")]
    rain = reads.where("param = 'rainfall_mm'").groupBy(*day).agg(F.sum("value").alias("value")) \
                .withColumn("metric", F.lit("rainfall_mm_sum"))
    energy = reads.where("param = 'global_radiation_Wm2'").groupBy(*day).agg(
        (F.sum("value") * 600 / 1e6).alias("value")).withColumn("metric", F.lit("global_radiation_MJm2"))
    table = Q.slot_coverage(temperature_slots(spark, d), gold.STATION, "ts", "value")
    checked = Q.apply_layers(rain.unionByName(energy), [Q.coverage(table, gold.STATION, 0.09)])
    return Q.clean_table(checked)


PERSIST_SQL = V.SILVER_SQL + """, f AS (SELECT *, CASE WHEN value = lag(value) OVER w THEN 0 ELSE 1 END AS s
      FROM silver WINDOW w AS (PARTITION BY site, station, metric ORDER BY date)),
    g AS (SELECT *, sum(s) OVER (PARTITION BY site, station, metric ORDER BY date) AS run FROM f),
    n AS (SELECT *, count(*) OVER (PARTITION BY site, station, metric, run) AS run_length FROM g)"""
STUCK = "run_length >= 4 AND metric IN (" + ", ".join(f"'{m}'" for m in C.PERSISTENCE_METRICS) + ")"


@query("qc_4_persistence", V.with_views(PERSIST_SQL) + f"""
    SELECT site, station, date, metric, CASE WHEN NOT ({STUCK}) THEN value END AS value FROM n""", "value")
def qc_4(spark, d):
    return Q.clean_table(Q.apply_layers(V.silver(spark, d), [Q.persistence(SERIES)]))


@query("qc_5_change_log", V.with_views(V.SILVER_SQL, fence("silver", 1.0)) + f"""
    SELECT site, station, date, metric, value AS original_value, CAST(NULL AS DOUBLE) AS new_value,
           printf('monthly_IQR month=%d', m) AS reason, 'monthly_IQR' AS layer,
           'monthly' AS layer_raw FROM fenced WHERE {OUTSIDE}""", "original_value new_value")
def qc_5(spark, d):
    checked = Q.apply_layers(V.silver(spark, d), [Q.monthly_iqr(SERIES, 1.0)])
    log = Q.change_log(checked, ("site", "station"))
    # the limits in the text are rounded from binary doubles differently by Java and C
    return log.withColumn("reason", F.substring_index("reason", " [", 1))


CHAIN_SQL = V.with_views(
    BOUNDED_SQL,
    "bounded AS (SELECT site, station, date, metric, CASE WHEN NOT bad THEN value END AS value FROM marked)",
    fence("bounded", 1.0),
    f"fence_ok AS (SELECT site, station, date, metric, CASE WHEN coalesce({OUTSIDE}, false) THEN NULL ELSE value END AS value FROM fenced)",
    """f AS (SELECT *, CASE WHEN value = lag(value) OVER w THEN 0 ELSE 1 END AS s
      FROM fence_ok WINDOW w AS (PARTITION BY site, station, metric ORDER BY date))""",
    "g AS (SELECT *, sum(s) OVER (PARTITION BY site, station, metric ORDER BY date) AS run FROM f)",
    "n AS (SELECT *, count(*) OVER (PARTITION BY site, station, metric, run) AS run_length FROM g)")


def chain(spark, d):
    return Q.apply_layers(V.silver(spark, d), [
        Q.physical_bounds(), Q.monthly_iqr(SERIES, 1.0), Q.persistence(SERIES)])


@query("qc_6_layer_chain", CHAIN_SQL + f"""
    SELECT site, station, date, metric, CASE WHEN {STUCK} THEN NULL ELSE value END AS value FROM n""", "value")
def qc_6(spark, d):
    return Q.clean_table(chain(spark, d))


@query("qc_6_layer_counts", CHAIN_SQL + f"""
    , logged AS (SELECT 'physical_bounds' AS layer FROM marked WHERE bad
      UNION ALL SELECT 'monthly_IQR' FROM fenced WHERE {OUTSIDE}
      UNION ALL SELECT 'persistence' FROM n WHERE {STUCK} AND value IS NOT NULL)
    SELECT layer, count(*) AS n, 100.0 * count(*) / (SELECT count(*) FROM silver) AS percent
    FROM logged GROUP BY ALL""", "percent")
def qc_6b(spark, d):
    return Q.log_summary(chain(spark, d))


@query("qc_6_flow_chain", V.with_views(
    "flow_rows AS (SELECT l_returnflag AS site, l_linestatus AS station, CAST(l_shipdate AS DATE) AS date, "
    "sum(l_extendedprice * (1 - l_discount)) / 1013 AS value FROM lineitem GROUP BY ALL)",
    "spans AS (SELECT site, station, min(date) AS a, max(date) AS b FROM flow_rows GROUP BY ALL)",
    """dense0 AS (SELECT s.site, s.station, CAST(d AS DATE) AS date, g.value, 'flow_m3' AS metric
    FROM (SELECT site, station, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d FROM spans) s
    LEFT JOIN flow_rows g ON g.site = s.site AND g.station = s.station AND g.date = CAST(s.d AS DATE))""",
    fence("dense0", 3.0),
    "dense AS (SELECT site, station, date, CASE WHEN value < lo OR value > hi THEN NULL ELSE value END AS value FROM fenced)")
    + """, n AS (SELECT *,
        last_value(value IGNORE NULLS) OVER p AS pv,
        last_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER p AS pd,
        first_value(value IGNORE NULLS) OVER f AS nv,
        first_value(CASE WHEN value IS NOT NULL THEN date END IGNORE NULLS) OVER f AS nd
      FROM dense WINDOW
        p AS (PARTITION BY site, station ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        f AS (PARTITION BY site, station ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT site, station, date, 'flow_m3' AS metric, CASE WHEN date - pd <= 3 THEN
        coalesce(value, pv + (nv - pv) * CAST(date - pd AS DOUBLE) / nullif(CAST(nd - pd AS DOUBLE), 0)) END AS value
    FROM n""", "value")
def qc_6c(spark, d):
    flows = V.flows(spark, d).withColumn("flow_m3", F.col("flow_m3") / 1013)
    return Q.clean_table(gold.flow_silver(flows))
