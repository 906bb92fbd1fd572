"""Clients are asked once, also when tasks die."""

import os

import pytest
from pyspark.sql import functions as F

from folioquery.calls import ask_once, journal, journaled, key_of
from folioquery.functions import fixed_values as fv
from folioquery.providers import client_judge, with_retries


def counting(folder, die_after=None):
    """A client that notes every call, and once takes its worker with it before a call."""
    def open_client():
        def client(prompt):
            died = os.path.join(folder, "died")
            calls = [f for f in os.listdir(folder) if f.startswith("calls-")]
            made = sum(sum(1 for _ in open(os.path.join(folder, f))) for f in calls)
            if die_after is not None and made >= die_after and not os.path.exists(died):
                open(died, "w").close()
                os._exit(1)
            with open(os.path.join(folder, f"calls-{os.getpid()}"), "a") as log:
                log.write(prompt + "\n")
            if "bad" in prompt:
                raise ValueError("no answer to " + prompt)
            return f"reply to {prompt} é"
        return client
    return open_client


def calls(folder):
    return sorted(line for f in os.listdir(folder) if f.startswith("calls-") for line in open(os.path.join(folder, f)).read().split("\n") if line)


def test_a_killed_task_asks_no_prompt_twice(spark, tmp_path):
    notes, kept = str(tmp_path / "notes"), str(tmp_path / "journal")
    os.makedirs(notes)
    rows = spark.createDataFrame([(i, f"prompt {i % 40}") for i in range(120)] + [(200, None)], "i int, p string").repartition(4)
    run = lambda: ask_once(rows, F.col("p"), counting(notes, 13), kept, "m", parallel=2)
    with pytest.raises(Exception):
        run()
    assert os.path.exists(os.path.join(notes, "died")) and 13 <= len(calls(notes)) < 40
    got = {r.i: r.reply for r in run().collect()}
    assert len(got) == 121 and all(got[i].answer == f"reply to prompt {i % 40} é" and got[i].error is None for i in range(120))
    assert got[200] is None
    assert calls(notes) == sorted(f"prompt {i}" for i in range(40))
    assert {(r.key, r.answer) for r in journal(spark, kept).collect()} == {(key_of(f"prompt {i}", "m"), f"reply to prompt {i} é") for i in range(40)}
    run().collect()
    assert len(calls(notes)) == 40


def test_failures_are_asked_again(spark, tmp_path):
    notes, kept = str(tmp_path / "notes"), str(tmp_path / "journal")
    os.makedirs(notes)
    rows = spark.createDataFrame([("bad 1",), ("good",), ("bad 1",)], "p string")
    for _ in range(2):
        got = sorted(map(str, (r.reply.asDict() for r in ask_once(rows, F.col("p"), counting(notes), kept).collect())))
    assert calls(notes) == ["bad 1", "bad 1", "good"]
    assert got == sorted(map(str, [{"answer": fv.ERROR_ANSWER, "error": "no answer to bad 1"}] * 2 + [{"answer": "reply to good é", "error": None}]))


def test_another_client_has_its_own_answers(tmp_path):
    folder = str(tmp_path)
    assert journaled(lambda: lambda p: "one " + p, folder, "a")()("q") == "one q"
    assert journaled(lambda: lambda p: "two " + p, folder, "b")()("q") == "two q"
    assert journaled(lambda: lambda p: "three " + p, f"file://{folder}", "a")()("q") == "one q"


def test_a_judge_with_retries_keeps_its_reply(spark, tmp_path):
    """Retries stand around the call, the journal around both."""
    notes = str(tmp_path / "notes")
    os.makedirs(notes)

    def open_flaky():
        seen = []

        def client(prompt):
            seen.append(prompt)
            with open(os.path.join(notes, f"calls-{os.getpid()}"), "a") as log:
                log.write("call\n")
            if len(seen) % 3:
                raise OSError("busy")
            return '{"faithfulness": 1.0}'
        return client

    judge = client_judge(journaled(lambda: with_retries(open_flaky(), attempts=3, base=0.0, sleep=lambda s: None), str(tmp_path / "journal")), attempts=1)
    rows = spark.createDataFrame([("q", "e", "a", "c")], "q string, e string, a string, c string").coalesce(1)
    for _ in range(2):
        assert rows.select(judge(F.col("q"), F.col("e"), F.col("a"), F.col("c")).alias("j")).first().j == '{"faithfulness": 1.0}'
    assert len(calls(notes)) == 3
