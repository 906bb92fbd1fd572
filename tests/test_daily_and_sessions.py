"""Order statistics by day and sessions against plain Python."""

import datetime
import glob
import math
import os
import random

from pyspark.sql import functions as F

from folioquery.operators.daily import DayStatistics, value_bin
from folioquery.streaming.sessions import session_stream, sessions

START = datetime.datetime(2024, 1, 1)


def test_bins_keep_the_order(spark):
    rng = random.Random(1)
    values = sorted([rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 12) for _ in range(500)] + [0.0, -0.0, float("inf"), float("-inf"), 1e308])
    got = [r.b for r in spark.createDataFrame([(v,) for v in [*values, float("nan")]], "v double").coalesce(1).select(value_bin(F.col("v")).alias("b")).collect()]
    assert got == sorted(got)


def brute(rows, share):
    out = {}
    for g, v, _ in rows:
        if v is not None:
            out.setdefault(g, []).append(v)
    return {g: (len(v), sorted(v)[math.floor(len(v) * share)]) for g, v in out.items()}


def test_days_equal_all_values_at_once(spark, tmp_path):
    rng = random.Random(7)
    day = lambda d, n: [(rng.choice(["a", "b", None]), rng.choice([None, rng.randint(-3, 3) / 2, rng.lognormvariate(2, 2), 7.0]), f"2024-01-{d:02}") for _ in range(n)]
    schema, stats = "kind string, v double, day string", DayStatistics(spark, str(tmp_path), "kind", "v")
    days = {d: day(d, 80) for d in (1, 2, 3)}
    stats.add(spark.createDataFrame([r for d in (1, 2) for r in days[d]], schema), "day")
    stats.add(spark.createDataFrame(days[3], schema), "day")
    every = [r for rows in days.values() for r in rows]
    for share in (0.0, 0.5, 0.8, 0.99):
        assert {r.kind: (r.n, r.p80) for r in stats.statistic(share).collect()} == brute(every, share)
    assert {r.kind: (r.n, r.p80) for r in stats.statistic(0.8, F.col("day") >= "2024-01-02").collect()} == brute(days[2] + days[3], 0.8)
    # A day that is added, or added again, touches its own folders only.
    written = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{tmp_path}/*/day=2024-01-0[12]/**/*.parquet", recursive=True)}
    before = written()
    days[3] = day(3, 50)
    stats.add(spark.createDataFrame(days[3], schema), "day")
    assert written() == before
    assert {r.kind: (r.n, r.p80) for r in stats.statistic(0.8).collect()} == brute([r for rows in days.values() for r in rows], 0.8)


def brute_sessions(rows, gap):
    out = []
    for user in sorted({u for u, _ in rows}):
        times = sorted(t for u, t in rows if u == user)
        start = 0
        for i in range(1, len(times) + 1):
            if i == len(times) or (times[i] - times[i - 1]).total_seconds() > gap:
                out.append((user, times[start], times[i - 1], i - start))
                start = i
    return out


def at(user, minutes):
    return user, START + datetime.timedelta(minutes=minutes)


def test_sessions_of_a_table(spark):
    rows = [at("a", m) for m in (0, 5, 15, 26, 36.5, 60)] + [at("b", m) for m in (3, 3, 14)]
    got = sessions(spark.createDataFrame(rows, "user string, ts timestamp"), "user", "10 minutes", "0 seconds").collect()
    assert sorted((r.user, r.first, r.last, r.n) for r in got) == brute_sessions(rows, 600)


def test_late_rows_join_or_are_dropped(spark, tmp_path):
    """A row within the lateness joins two sessions across batches; one that is later still is dropped."""
    parts = [[at("a", 0), at("a", 16), at("b", 1)], [at("a", 8), at("b", 100)], [at("a", 20), at("b", 105), at("c", 500)], [at("c", 501), at("z", 2000)]]
    schema, folder = "user string, ts timestamp", str(tmp_path)
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        session_stream(spark.readStream.schema(schema).parquet(f"{folder}/in"), "user", "10 minutes", "30 minutes",
                       f"{folder}/out", f"{folder}/cp").awaitTermination()
    got = sorted((r.user, r.first, r.last, r.n) for r in spark.read.parquet(f"{folder}/out").collect())
    kept = [at("a", m) for m in (0, 8, 16)] + [at("b", m) for m in (1, 100, 105)] + [at("c", m) for m in (500, 501)]
    assert got == brute_sessions(kept, 600)
