"""Time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.temporal import days_inclusive
from ..operators import timeseries as ts
from ..session import table
from .registry import query

HALF_HOUR, HOUR = 1_800_000_000, 3_600_000_000


def _at(text):
    return F.lit(text).cast("timestamp_ntz")


@query("ts_filter_point", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate = TIMESTAMP '1997-05-28'")
def ts_filter_point(spark, root):
    return table(spark, root, "orders").where(F.col("o_orderdate") == _at("1997-05-28")).select("o_orderkey", "o_orderdate")


@query("ts_filter_range", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30'")
def ts_filter_range(spark, root):
    return table(spark, root, "orders").where(F.col("o_orderdate").between(_at("1997-01-01"), _at("1997-06-30"))).select("o_orderkey", "o_orderdate")


@query("date_range", """
SELECT o_orderkey, CAST(unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + INTERVAL 9 DAYS, INTERVAL 3 DAYS)) AS DATE) AS day FROM orders""")
def date_range(spark, root):
    low = F.col("o_orderdate").cast("date")
    return ts.date_range(table(spark, root, "orders").select("o_orderkey", "o_orderdate"), low, F.date_add(low, 9), "3 days", "day").drop("o_orderdate")


@query("group_by_dynamic", """
SELECT date_trunc('year', o_orderdate)::TIMESTAMP AS year, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1""")
def group_by_dynamic(spark, root):
    return table(spark, root, "orders").groupBy(ts.calendar_start(F.col("o_orderdate"), "year").cast("timestamp_ntz").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))


@query("group_by_dynamic_month", """
SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS n, CAST(date_diff('day', min(o_orderdate), max(o_orderdate)) + 1 AS INTEGER) AS days,
  CAST(date_diff('day', date_trunc('month', o_orderdate), date_trunc('month', o_orderdate) + INTERVAL 1 MONTH) AS INTEGER) AS month_days
FROM orders GROUP BY date_trunc('month', o_orderdate)""")
def group_by_dynamic_month(spark, root):
    month = ts.calendar_start(F.col("o_orderdate"), "month").cast("timestamp_ntz")
    made = table(spark, root, "orders").groupBy(month.alias("month")).agg(
        F.count(F.lit(1)).alias("n"), days_inclusive(F.min("o_orderdate"), F.max("o_orderdate")).alias("days"))
    return made.withColumn("month_days", F.day(F.last_day("month")))


@query("group_by_dynamic_closed_both", """
WITH e AS (SELECT event_type, time_bucket(INTERVAL 30 MINUTES, ts) AS half, value FROM events),
w AS (SELECT event_type, date_trunc('hour', half)::TIMESTAMP AS lower, value FROM e
  UNION ALL SELECT event_type, half - INTERVAL 1 HOUR, value FROM e WHERE half = date_trunc('hour', half))
SELECT event_type, lower, lower + INTERVAL 1 HOUR AS upper, count(*) AS n, round(sum(value), 2) AS total FROM w GROUP BY 1, 2""")
def group_by_dynamic_closed_both(spark, root):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    half = F.timestamp_micros(micros - F.pmod(micros, F.lit(HALF_HOUR))).cast("timestamp_ntz")
    e = table(spark, root, "events").select("event_type", half.alias("half"), "value")
    return ts.windows_closed_both(e, "half", HOUR, ["event_type"], F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


HOURLY = """
h AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS ts, max(value) AS value, min(event_id) AS event_id FROM events
  GROUP BY 1, 2 HAVING max(value) > 5),
grid AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 15 MINUTES)) AS ts FROM (
  SELECT event_type, min(ts) AS lo, max(ts) AS hi FROM h GROUP BY 1))"""


def _hourly(spark, root):
    hour = ts.calendar_start(F.col("ts"), "hour").cast("timestamp_ntz")
    return (table(spark, root, "events").groupBy("event_type", hour.alias("ts"))
            .agg(F.max("value").alias("value"), F.min("event_id").alias("event_id")).where("value > 5"))


@query("upsample_ffill", f"""
WITH {HOURLY} SELECT g.event_type, g.ts, h.value, h.event_id FROM grid g ASOF LEFT JOIN h ON g.event_type = h.event_type AND g.ts >= h.ts""")
def upsample_ffill(spark, root):
    return ts.upsample(_hourly(spark, root), "ts", 900_000_000, ["event_type"], ["value", "event_id"])


@query("upsample_interpolate", f"""
WITH {HOURLY}, j AS (SELECT g.event_type, g.ts, a.value AS v0, a.event_id, a.ts AS t0, b.value AS v1, b.ts AS t1 FROM grid g
  ASOF LEFT JOIN h a ON g.event_type = a.event_type AND g.ts >= a.ts ASOF LEFT JOIN h b ON g.event_type = b.event_type AND g.ts <= b.ts)
SELECT event_type, ts, CASE WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * ((epoch_us(ts) - epoch_us(t0))::DOUBLE / (epoch_us(t1) - epoch_us(t0))::DOUBLE) END AS value, event_id FROM j""")
def upsample_interpolate(spark, root):
    return ts.upsample_interpolate(_hourly(spark, root), "ts", 900_000_000, ["event_type"], "value", ["event_id"])
