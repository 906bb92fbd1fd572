"""Streaming queries: the given tables arrive as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioquery.catalog.answers import HISTORY_SQL, pipeline_store
from folioquery.catalog.base import query, table
from folioquery.catalog.logs import ORDER, PAIR_SQL, log_lines
from folioquery.catalog.retrieval import questions
from folioquery.operators.memory import turns_from_messages
from folioquery.plans.ask import answer
from folioquery.providers import offline
from folioquery.session import materialize, new_table_path
from folioquery.streaming.keyed import keyed_memory, keyed_pairs, remembered
from folioquery.streaming.sessions import session_stream
from folioquery.streaming.logs import answer_stream, last_carry, memory_stream, pair_stream

PARTS = 3


def _stream_in_parts(spark, df, part, name, start):
    """Hand a table to a stream part by part, stopping and starting again between them.

    So every part after the first is a micro-batch that needs what the ones
    before it left. Returns the last query that had rows.
    """
    path, last = new_table_path(spark, name), None
    for n in range(PARTS):
        df.where(part == n).write.mode("append").parquet(path)
        q = start(spark.readStream.schema(df.schema).parquet(path))
        q.awaitTermination()
        last = q if q.lastProgress and q.lastProgress["numInputRows"] else last
    return last


@query("stream_log_pairing", f"WITH {PAIR_SQL} SELECT event_id, risk, total FROM pairs")
def stream_log_pairing(spark, sf):
    out, lines = new_table_path(spark, "pair-stream"), log_lines(spark, sf)
    cuts = lines.select(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [1 / 3, 2 / 3]).alias("c")).first()["c"]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    part = F.when(at < cuts[0], 0).when(at < cuts[1], 1).otherwise(2)
    _stream_in_parts(spark, lines, part, "lines", lambda s: pair_stream(s, ORDER, out, f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/pairs").select("event_id", "risk", "total")


@query("stream_memory", f"WITH {HISTORY_SQL} SELECT conv_id, turn, length(line) AS n_chars FROM kept")
def stream_memory(spark, sf):
    out = new_table_path(spark, "memory-stream")
    turns = turns_from_messages(table(spark, sf, "conversations"))
    part = F.when(F.col("turn") < 2, 0).when(F.col("turn") < 4, 1).otherwise(2)
    q = _stream_in_parts(spark, turns, part, "turns", lambda s: memory_stream(s, out, f"{out}/checkpoint"))
    line = F.length("human") + F.length("assistant") + 19
    return last_carry(spark, q, out).select("conv_id", "turn", line.alias("n_chars"))


@query("stream_keyed_memory", f"WITH {HISTORY_SQL} SELECT conv_id, turn, length(line) AS n_chars FROM kept")
def stream_keyed_memory(spark, sf):
    """The state itself after three parts, read from the stream's checkpoint."""
    out = new_table_path(spark, "keyed-memory")
    turns = turns_from_messages(table(spark, sf, "conversations"))
    part = F.when(F.col("turn") < 2, 0).when(F.col("turn") < 4, 1).otherwise(2)
    _stream_in_parts(spark, turns, part, "turns", lambda s: keyed_memory(s, f"{out}/kept", f"{out}/checkpoint"))
    line = F.length("human") + F.length("assistant") + 19
    return remembered(spark, f"{out}/checkpoint").select("conv_id", "turn", line.alias("n_chars"))


@query("stream_keyed_pairing", """
WITH marks AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'click' THEN 'LOW' END AS mark,
          CASE WHEN event_type = 'purchase' THEN value END AS total FROM events WHERE event_type IN ('error', 'click', 'purchase'))
SELECT user_id, event_id, before AS risk, total FROM
  (SELECT *, lag(mark) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM marks) WHERE total IS NOT NULL AND before IS NOT NULL""")
def stream_keyed_pairing(spark, sf):
    """A log per user, in three parts by time."""
    out = new_table_path(spark, "keyed-pairs")
    users = table(spark, sf, "events").select("event_id", "user_id")
    lines = materialize(log_lines(spark, sf).join(users, "event_id"), "keyed-lines")  # the cuts and every part read them
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = lines.select(F.percentile_approx(at, [1 / 3, 2 / 3]).alias("c")).first()["c"]
    part = F.when(at < cuts[0], 0).when(at < cuts[1], 1).otherwise(2)
    _stream_in_parts(spark, lines, part, "lines", lambda s: keyed_pairs(s, "user_id", ORDER, f"{out}/pairs", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/pairs").select(F.col("stream").alias("user_id"), F.col("place").alias("event_id"), "risk", "total")


@query("stream_sessions", """
WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE AS cut FROM events WHERE ts IS NOT NULL),
s AS (SELECT user_id, ts, count(*) FILTER (cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM e)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, no""")
def stream_sessions(spark, sf):
    """Sessions of users over three parts by time; a last row far ahead closes what is open."""
    out = new_table_path(spark, "sessions")
    events = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    at = F.unix_micros("ts")
    cuts = events.select(F.percentile_approx(at, [1 / 3, 2 / 3]).alias("c")).first()["c"]
    part = F.when(at < cuts[0], 0).when(at < cuts[1], 1).otherwise(2)
    end = events.agg((F.max("ts") + F.expr("INTERVAL 10 DAYS")).alias("ts")).select(F.lit(None).cast("long").alias("user_id"), "ts")
    start = lambda s: session_stream(s, "user_id", "30 minutes", "1 hour", f"{out}/closed", f"{out}/checkpoint")
    _stream_in_parts(spark, events.unionByName(end), F.when(F.col("user_id").isNull(), 2).otherwise(part), "events", start)
    closed = spark.read.parquet(f"{out}/closed").where("user_id IS NOT NULL")
    return closed.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})


@query("stream_answers")
def stream_answers(spark, sf):
    out = new_table_path(spark, "answer-stream")
    store, models = pipeline_store(spark, sf), offline()
    _stream_in_parts(spark, questions(spark, sf), F.pmod("query_id", F.lit(PARTS)), "questions",
                     lambda s: answer_stream(s, lambda q: answer(q, store, models), out, f"{out}-checkpoint"))
    return spark.read.parquet(out).select("query_id", "risk_level", "answer")
