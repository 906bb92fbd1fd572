"""Queries on logs and latency. Log lines are rendered from events: errors and
clicks are risk marks, purchases are completed questions, the rest is noise."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioquery.catalog.base import query, table
from folioquery.operators import latency as lt
from folioquery.operators.daily import DayStatistics
from folioquery.session import new_table_path
from folioquery.sources.logs import newest_files, write_daily

ORDER = ["ts", "event_id"]


def log_lines(spark, sf) -> DataFrame:
    """(ts, event_id, line)."""
    number = F.col("value").cast("string")
    message = (
        F.when(F.col("event_type") == "error", "_classify_query_risk → HIGH  (matched: 'x')")
        .when(F.col("event_type") == "click", "_classify_query_risk → LOW")
        .when(F.col("event_type") == "purchase", F.concat(
            F.lit("Query Complete | Total Latency: "), number, F.lit("s | Hybrid Retrieval Match (R): "), number,
            F.lit("1s | LLM Generation Inference (G): 5.25s")))
        .otherwise(F.concat(F.lit("User Query: "), F.col("props"))))
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS")
    return table(spark, sf, "events").select("ts", "event_id", F.concat(stamp, F.lit(" | INFO | "), message).alias("line"))


PAIR_SQL = """
marks AS (SELECT ts, event_id, CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'click' THEN 'LOW' END AS mark,
          CASE WHEN event_type = 'purchase' THEN value END AS total FROM events WHERE event_type IN ('error', 'click', 'purchase')),
pairs AS (SELECT event_id, total, before AS risk FROM
          (SELECT *, lag(mark) OVER (ORDER BY ts, event_id) AS before FROM marks) WHERE total IS NOT NULL AND before IS NOT NULL)
"""


def paired(spark, sf) -> DataFrame:
    return lt.pair_risks(lt.log_marks(log_lines(spark, sf)), [F.asc(c) for c in ORDER])


@query("log_pairing", f"WITH {PAIR_SQL} SELECT event_id, risk, total FROM pairs")
def log_pairing(spark, sf):
    return paired(spark, sf).select("event_id", "risk", "total")


@query("log_percentiles", f"""WITH {PAIR_SQL}
SELECT risk, count(*) AS n, round(list_sort(list(total))[floor(count(*) * 0.8)::BIGINT + 1], 1) AS p80 FROM pairs GROUP BY risk""")
def log_percentiles(spark, sf):
    return lt.risk_percentiles(paired(spark, sf))


@query("latency_p80", """
SELECT event_type, count(*) AS n, list_sort(list(value))[floor(count(*) * 0.8)::BIGINT + 1] AS p80 FROM events GROUP BY event_type""")
def latency_p80(spark, sf):
    return lt.order_statistic(table(spark, sf, "events"), "event_type", "value", digits=None)


@query("latency_p80_by_day", """
SELECT event_type, count(*) AS n, list_sort(list(value))[floor(count(*) * 0.8)::BIGINT + 1] AS p80 FROM events GROUP BY event_type""")
def latency_p80_by_day(spark, sf):
    """From days stored one after the other: all but the newest, then the newest, then that one again."""
    events = table(spark, sf, "events").select("event_type", "value", F.to_date("ts").alias("day"))
    days = DayStatistics(spark, new_table_path(spark, "day-statistics"), "event_type", "value")
    newest = F.col("day") == events.agg(F.max("day")).scalar()
    days.add(events.where(~newest), "day")
    for _ in range(2):
        days.add(events.where(newest), "day")
    return days.statistic(0.8)


@query("log_timings", """
SELECT event_id, date_trunc('second', ts) AS ts, value AS total, (value::VARCHAR || '1')::DOUBLE AS retrieval, 5.25::DOUBLE AS generation
FROM events WHERE event_type = 'purchase'""")
def log_timings(spark, sf):
    return lt.timings(log_lines(spark, sf)).select("event_id", "ts", "total", "retrieval", "generation")


@query("log_recent", """
WITH l AS (SELECT event_id, strftime(ts, '%Y%m%d') AS day FROM events),
c AS (SELECT day, count(*) AS n FROM l GROUP BY day),
k AS (SELECT day, coalesce(sum(n) OVER (ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS newer FROM c)
SELECT event_id, 'app_' || day || '.log' AS file_name FROM l WHERE day IN (SELECT day FROM k WHERE newer < 600)""")
def log_recent(spark, sf):
    """The newest daily files that together reach 600 lines."""
    name = F.concat(F.lit("app_"), F.date_format("ts", "yyyyMMdd"), F.lit(".log"))
    lines = log_lines(spark, sf).withColumn("file_name", name)
    return newest_files(lines).select("event_id", "file_name")


@query("daily_rollup", """
SELECT date_trunc('day', ts)::DATE::VARCHAR AS date, count(*) AS n FROM events GROUP BY 1""")
def daily_rollup(spark, sf):
    """Lines written to one folder per date, then counted from those folders."""
    path = new_table_path(spark, "daily")
    write_daily(log_lines(spark, sf), path)
    return spark.read.parquet(path).groupBy(F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"))
