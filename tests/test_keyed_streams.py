"""Keyed streaming state against plain Python, over several micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from folioquery.streaming.keyed import keyed_memory, keyed_pairs, remembered


def feed(spark, folder, schema, parts, start):
    """Parts arrive one by one; the stream is stopped and started again between them."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        start(spark.readStream.schema(schema).parquet(folder)).awaitTermination()


def newest(turns, limit):
    kept, used = [], 0
    for turn in sorted(turns, reverse=True):
        used += 19 + sum(map(len, turns[turn]))
        if used > limit:
            break
        kept.append((turn, *turns[turn]))
    return kept


def test_memory_touches_only_its_keys(spark, tmp_path):
    rng = random.Random(2)
    parts = [[(conv, turn, "h" * rng.randint(0, 30), "a" * rng.randint(0, 40)) for conv in convs for turn in range(4 * n, 4 * n + 4)]
             for n, convs in enumerate([["a", "b", "c", None], ["a"], ["a", "c", "d"]])]
    parts[1].append(("a", 1, "late", "turn"))           # late, and too old to stay
    parts[2] += [("c", 9, "said", "again"), ("c", 3, None, "no text"), ("d", 1, "x" * 500, "too long")]
    out, schema = str(tmp_path), "conv_id string, turn long, human string, assistant string"
    feed(spark, f"{out}/in", schema, parts, lambda s: keyed_memory(s, f"{out}/kept", f"{out}/cp", 150))
    known = {}
    for rows in parts:
        for conv, turn, h, a in rows:
            if h is not None:
                known.setdefault(conv, {})[turn] = (h, a)
        known = {c: {t: x for t, *x in newest(v, 150)} for c, v in known.items()}
    got = sorted((r.conv_id or "", r.turn, r.human, r.assistant) for r in remembered(spark, f"{out}/cp").collect())
    assert got == sorted((c or "", t, *x) for c, v in known.items() for t, x in v.items())
    written = {(r.batch, r.conv_id) for r in spark.read.parquet(f"{out}/kept").select("batch", "conv_id").distinct().collect()}
    assert {c for b, c in written if b == 1} == {"a"}
    assert {c for b, c in written if b == 2} == {"a", "c", "d"} and len(written) == 8


def lines(rows):
    """(stream, second, number, kind) to log lines."""
    import datetime
    text = {"H": "_classify_query_risk → HIGH  (matched: 'x')", "L": "_classify_query_risk → LOW", "-": "nothing of note"}
    return [(s, datetime.datetime.fromtimestamp(1_700_000_000 + t, datetime.UTC).replace(tzinfo=None), n,
             text.get(k) or f"Query Complete | Total Latency: {k}s | Hybrid Retrieval Match (R): 1s | LLM Generation Inference (G): 1s")
            for s, t, n, k in rows]


LOG = "stream string, ts timestamp, n long, line string"


def found(spark, path):
    return sorted((r.stream, r.place if r.place is not None else -1, r.risk, r.total) for r in spark.read.parquet(path).collect())


def test_pairs_wait_across_batches(spark, tmp_path):
    parts = [lines([("a", 0, 1, "H"), ("b", 1, 2, "L"), ("a", 2, 3, "-"), ("c", 2, 9, "H")]),
             lines([("b", 3, 4, "7.5"), ("b", 4, 5, "8"), ("a", 5, 6, "L")]),
             lines([("a", 6, 8, "2"), ("a", 6, 7, "H"), ("b", 9, 10, "1")])]
    out = str(tmp_path)
    feed(spark, f"{out}/in", LOG, parts, lambda s: keyed_pairs(s, "stream", ["n"], f"{out}/pairs", f"{out}/cp"))
    assert found(spark, f"{out}/pairs") == [("a", 8, "HIGH", 2.0), ("b", 4, "LOW", 7.5)]
    state = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{out}/cp").select("key.stream", "value.risk")
    assert [tuple(r) for r in state.collect()] == [("c", "HIGH")]


def test_marks_run_out_of_patience(spark, tmp_path):
    """By a late latency, and by the timer alone when nothing more comes for the log."""
    parts = [lines([("a", 0, 1, "H"), ("b", 0, 2, "L"), ("c", 0, 3, "H")]),
             lines([("a", 8, 4, "5"), ("b", 30, 5, "6"), ("d", 200, 6, "L")]),
             lines([("d", 205, 7, "9")])]
    out = str(tmp_path)
    feed(spark, f"{out}/in", LOG, parts, lambda s: keyed_pairs(s, "stream", ["n"], f"{out}/pairs", f"{out}/cp", patience=10))
    assert [x if x[3] is not None else (*x[:3], None) for x in
            ((s, p, r, None if t is None or t != t else t) for s, p, r, t in found(spark, f"{out}/pairs"))] == [
        ("a", 4, "HIGH", 5.0), ("b", -1, "LOW", None), ("c", -1, "HIGH", None), ("d", 7, "LOW", 9.0)]


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    """The folder of a batch is replaced when its write is repeated."""
    out, schema = str(tmp_path), "conv_id string, turn long, human string, assistant string"
    feed(spark, f"{out}/in", schema, [[("a", 1, "x", "y")]], lambda s: keyed_memory(s, f"{out}/kept", f"{out}/cp"))
    keyed_memory(spark.readStream.schema(schema).parquet(f"{out}/in"), f"{out}/kept", f"{out}/cp").awaitTermination()
    assert spark.read.parquet(f"{out}/kept").count() == 1 and remembered(spark, f"{out}/cp").count() == 1


def test_pairing_asks_the_state_no_more_than_needed():
    """Every call on the state is a round trip: one to read, one to change what changed."""
    import pandas as pd

    from folioquery.streaming.keyed import Pairing

    class Value:
        def __init__(self, value):
            self.value, self.calls = value, []

        def exists(self):
            self.calls.append("exists")
            return self.value is not None

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def clear(self):
            self.calls.append("clear")
            self.value = None

    for before, marks, calls, after, pairs in [
            (("HIGH", 0), [(None, 7.5)], ["get", "clear"], None, [("HIGH", 7.5)]),
            (None, [("LOW", None), (None, 2.0)], ["get"], None, [("LOW", 2.0)]),
            (None, [(None, 2.0)], ["get"], None, []),
            (("LOW", 0), [("LOW", None)], ["get"], ("LOW", 0), []),
            (None, [("HIGH", None)], ["get", "update"], ("HIGH", 0), [])]:
        pairing = Pairing(["n"], None)
        pairing.waiting = Value(before)
        frame = pd.DataFrame([(n, n, *m) for n, m in enumerate(marks)], columns=["n", "place", "risk", "total"])
        found = [tuple(r) for f in pairing.handleInputRows(("a",), iter([frame]), None) for r in f[["risk", "total"]].itertuples(index=False)]
        assert (pairing.waiting.calls, pairing.waiting.value, found) == (calls, after, pairs)
