"""Cleaning, classifying, verifying, evaluating, latency, sources, whole plans."""

import json

import pytest
from pyspark.sql import functions as F

from folioquery import providers as pv
from folioquery.functions import fixed_values as fv, text as tx
from folioquery.operators import evaluate as ev, latency as lt, split as spl, verify as vf
from folioquery.plans.ask import answer
from folioquery.plans.build import build_store, open_store
from folioquery.plans.diagnose import explain_questions
from folioquery.plans.evaluate import run_evaluation
from folioquery.sources import logs as lg, stores as st
from folioquery.sources.markdown import read_markdown
from folioquery.streaming.logs import last_carry, memory_stream, pair_stream


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


# --- text -------------------------------------------------------------------

def test_strip_matches_python(spark):
    for s in ("", " ", " a b　", "\n\t a\x85", "a", " ", "  x\n y  "):
        assert one(spark, tx.strip(F.lit(s))) == s.strip()


def test_clean_chain(spark):
    raw = "cover\n## 1. Introduction\na....b\n\n\n\n|  a   b |\n-----\n  "
    assert one(spark, tx.clean_markdown(F.lit(raw))) == "## 1. Introduction\na b\n\n| a b |\n---"
    assert one(spark, tx.clean_markdown(F.lit("no  anchor"))) == "no  anchor"


def test_markup_and_sentences(spark):
    assert one(spark, tx.strip_markup(F.lit("**b** x\n## H\n#no\n**open\n"))) == "b x\nH\n#no\n**open\n"
    assert one(spark, tx.sentences(F.lit("One. Two!\nThree? four"))) == ["One.", "Two!", "Three?", "four"]
    assert one(spark, tx.sentences(F.lit("  "))) == []


@pytest.mark.parametrize("q,risk,lists", [("What are the six monitoring types?", "HIGH", True), ("List the actions", "LOW", True),
                                          ("Which function answers this?", "HIGH", False), ("Why?", "LOW", False)])
def test_question_classes(spark, q, risk, lists):
    assert one(spark, tx.risk_class(F.lit(q))) == risk
    assert one(spark, tx.is_list_question(F.lit(q))) is lists


def test_question_profiles(spark):
    q = F.lit("Give me some examples of bias")
    assert one(spark, tx.risk_class(q)) == "LOW" and one(spark, tx.risk_class(q, "ui")) == "HIGH"
    assert one(spark, tx.with_list_note(F.lit("a"), q)) == "a"
    assert one(spark, tx.with_list_note(F.lit("a"), q, "ui")) == "a" + fv.LIST_NOTE


def test_jaccard(spark):
    j = lambda a, b: one(spark, tx.jaccard(tx.set_tokens(F.lit(a)), tx.set_tokens(F.lit(b))))
    assert j("", "x") == 0.0 and j("The AI Framework", "ai framework!") == 1.0
    assert j("a1 b1 c1", "c1 a1 d1") == j("c1 a1 d1", "a1 b1 c1") == 0.5


def test_hit_threshold_is_inclusive(spark):
    hit = lambda e, r: one(spark, ev.retrieval_hit(F.array(*map(F.lit, e)), F.array(*map(F.lit, r)).cast("array<string>")))
    assert hit(["a1 b1 x1"], ["a1 b1 y1 z1"]) is True  # 2 of 5
    assert hit(["a1 x1"], ["a1 b1 y1"]) is False
    assert hit(["a1"], []) is False


# --- verification -----------------------------------------------------------

@pytest.mark.parametrize("verdicts,faithful", [([True, False], True), ([], True), ([True, False, False], False), ([None, False], True)])
def test_majority(spark, verdicts, faithful):
    col = F.array(*[F.lit(v) for v in verdicts]).cast("array<boolean>")
    assert one(spark, vf.majority(col)) is faithful


def test_verifier_runs_on_high_risk_only(spark):
    ctx = "--- Source: A ---\nx\n\n--- Source: B ---\nthe sky is blue"
    rows = [(1, "Which colour answers this?", ctx, "Sky is blue."), (2, "Which colour answers this?", ctx, "Grass. Mud."),
            (3, "Why?", ctx, "Grass. Mud.")]
    drafts = spark.createDataFrame(rows, "query_id int, question string, context string, draft string")
    asked = spark.sparkContext.accumulator(0)

    def verify(chunk, claims):
        @F.pandas_udf("array<boolean>")
        def check(c, s):
            asked.add(len(c))
            return s.map(lambda xs: ["sky" in x.lower() for x in xs])
        return check(chunk, claims)

    out = {r["query_id"]: r for r in vf.verify_and_retry(drafts, verify, lambda c, q: F.lit("again")).collect()}
    assert (out[1]["faithful"], out[1]["retried"], out[1]["answer"]) == (True, False, "Sky is blue.")
    assert (out[2]["faithful"], out[2]["retried"], out[2]["answer"]) == (False, True, "again")
    assert (out[3]["checked"], out[3]["faithful"], out[3]["answer"]) == (False, None, "Grass. Mud.")


def test_a_verifier_that_does_not_repeat_itself_loses_nothing(spark):
    drafts = spark.range(400).select(
        F.col("id").alias("query_id"), F.lit("What are the 7 items of order 9?").alias("question"), F.lit("ctx").alias("context"), F.lit("One. Two.").alias("draft"))
    asked = spark.sparkContext.accumulator(0)

    def verify(chunk, claims):
        @F.pandas_udf("array<boolean>")
        def check(c, s):
            import random
            asked.add(len(c))
            return s.map(lambda xs: [random.random() < 0.5 for _ in xs])
        return check(chunk, claims)

    out = vf.verify_and_retry(drafts, verify, lambda c, q: F.lit("again"))
    rows = out.collect()
    assert len(rows) == 400 and len({r["query_id"] for r in rows}) == 400 and asked.value == 400
    assert all(r["retried"] is (not r["faithful"]) for r in rows) and out.collect() and asked.value == 400


def test_failed_client_is_not_checked(spark):
    drafts = spark.createDataFrame([(1, "What are the 7 items of order 9?", "ctx", fv.ERROR_ANSWER, "down"), (2, "What are the 7 items of order 9?", "ctx", "Sky.", None)],
                                   "query_id int, question string, context string, draft string, error string")
    no = lambda chunk, claims: F.transform(claims, lambda c: F.lit(False))
    out = {r["query_id"]: r for r in vf.verify_and_retry(drafts, no, lambda c, q: F.lit("again")).collect()}
    assert out[1]["answer"] == fv.ERROR_ANSWER and not out[1]["checked"] and not out[1]["retried"]
    assert out[2]["retried"] and out[2]["answer"].startswith("again")


def test_prompted_clients(spark):
    seen = []

    def open_reader(settings):
        assert settings == fv.GENERATION

        def call(p):
            if "fail" in p:
                raise RuntimeError("down")
            return "**bold** reply"
        return call

    p = pv.prompted(None, None, open_reader, lambda: lambda prompt: "Yes", None)
    df = spark.createDataFrame([("ok",), ("fail",)], "q string")
    got = df.select(p.generate(F.lit("c"), F.lit("h"), F.col("q")).alias("r"), p.verify(F.lit("c"), F.array("q")).alias("v")).collect()
    assert got[0]["r"]["answer"] == "bold reply" and got[0]["r"]["error"] is None and got[0]["v"] == [True]
    assert got[1]["r"]["error"] == "down" and not seen
    judge = pv.client_judge(lambda: lambda prompt: "{}" if "EXPECTED: e" in prompt else 1 / 0, attempts=2, sleep=lambda s: None)
    assert df.select(judge(F.col("q"), F.lit("e"), F.lit("a"), F.lit("c")).alias("j")).first()["j"] == "{}"


def test_answers_written_back(spark):
    from folioquery.plans.ask import write_back
    turns = spark.createDataFrame([(7, 0, "h", "a")], "conv_id long, turn long, human string, assistant string")
    asked = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, None)], "query_id long, conv_id long")
    answers = asked.select("query_id", F.concat(F.lit("q"), "query_id").alias("question"), F.concat(F.lit("a"), "query_id").alias("answer"))
    got = sorted((r["conv_id"], r["turn"], r["human"]) for r in write_back(turns, asked, answers).collect())
    assert got == [(7, 0, "h"), (7, 1, "q1"), (7, 2, "q2"), (8, 0, "q3")]


def test_work_folder_must_be_shared_on_a_cluster():
    from types import SimpleNamespace as N
    from folioquery.session import work_dir
    conf = N(get=lambda *a: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_dir(N(conf=conf, sparkContext=N(master="spark://host:7077", getCheckpointDir=lambda: None)))
    assert work_dir(N(conf=N(get=lambda *a: "/shared"), sparkContext=N(master="yarn", getCheckpointDir=lambda: None))) == "/shared"


def test_client_errors_stay_in_their_row(spark):
    def open_client():
        def call(p):
            if p == "bad":
                raise RuntimeError("down")
            return p.upper()
        return call

    df = spark.createDataFrame([("a",), ("bad",)], "p string").select(pv.client_column(open_client, F.col("p")).alias("r"))
    got = [(r["r"]["answer"], r["r"]["error"]) for r in df.collect()]
    assert got == [("A", None), (fv.ERROR_ANSWER, "down")]


def test_retries_wait_longer_each_time():
    waits, calls = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 4:
            raise ValueError
        return x

    assert pv.with_retries(flaky, sleep=waits.append)(7) == 7
    assert len(waits) == 3 and 4 <= waits[0] <= 4.5 and 8 <= waits[1] <= 8.5 and 16 <= waits[2] <= 16.5


def test_fill_does_not_fill_values(spark):
    got = one(spark, pv.fill("{a}-{b}", a=F.lit("{b}"), b=F.lit("2")))
    assert got == "{b}-2"


# --- evaluation -------------------------------------------------------------

def reply(score="0.5", **extra):
    body = {m: score for m in fv.METRICS} | {f"{m}_reasoning": "r" for m in fv.METRICS}
    return body | extra


@pytest.mark.parametrize("raw,ok", [
    ("```json\n" + json.dumps(reply()) + "\n```", True), (json.dumps([reply()]), True), (json.dumps([reply(), {}]), True),
    ("[]", False), (json.dumps(reply("0.6")), False), (json.dumps(reply(relevance=0.5)), False), ("no json", False),
    (json.dumps(reply(relevance_reasoning=None)), False)])
def test_judge_replies(spark, raw, ok):
    row = ev.scored(spark.createDataFrame([(1, raw)], "index int, reply string")).first()
    assert row["judge_failed"] is not ok
    assert row["faithfulness"] == (0.5 if ok else None)
    assert row["correctness_reasoning"] == ("r" if ok else fv.JUDGE_FAILURE)


def test_index_validation(spark):
    requested = spark.createDataFrame([(1,), (2,)], "index int")
    returned = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (9, 2, "c")], "index int, pos int, v string")
    got = {r["index"]: (r["v"], r["judge_failed"]) for r in ev.validated_results(requested, returned).collect()}
    assert got == {1: ("a", False), 2: (None, True)}


def test_golden_errors(spark):
    good = json.dumps({"question_category": "f", "question": "q", "expected_answer": "a"})
    items = spark.createDataFrame([(1, good), (2, "[1]"), (3, '{"question": " ", "question_category": 5}'), (4, "oops")], "index int, item string")
    got = sorted((r["index"], r["error"]) for r in ev.golden_errors(items).collect())
    assert [g[0] for g in got] == [2, 3, 3, 3, 4] and got[0][1] == "not an object"
    with pytest.raises(ValueError, match="5 violation") as caught:
        ev.assert_golden(items)
    assert spark.read.parquet(caught.value.errors).count() == 5
    ev.assert_golden(items.where("index = 1"))


# Scores of one recorded run: (category, hit, four scores or None).
RUN = [("factual", 1, None), ("factual", 1, (1.0, 1.0, 0.5, 0.5)), ("edge", 1, (0.5, 0.75, 1.0, 0.25)), ("edge", 0, None)]


def test_failed_rows_count_for_hits_only(spark):
    rows = [(c, h, *(s or (None,) * 4), s is None) for c, h, s in RUN]
    rec = spark.createDataFrame(rows, "category string, retrieval_hit int, faithfulness double, relevance double, "
                                "completeness double, correctness double, judge_failed boolean")
    s = ev.summary(rec).first()
    assert (s["n"], s["n_failed"], s["n_valid"], s["hit_pct"], s["faithfulness"], s["correctness"]) == (4, 2, 2, 75.0, 0.75, 0.375)
    assert {r["category"]: r["n"] for r in ev.by_category(rec).collect()} == {"factual": 1, "edge": 1}
    total = [r for r in ev.rollup_summary(rec).collect() if r["is_total"]]
    assert total[0]["n"] == 2 and total[0]["relevance"] == 0.875


def test_verification_summary(spark):
    rows = [("HIGH", 1, 1)] * 2 + [("HIGH", 1, 0)] + [("LOW", 0, 0)] * 15
    rec = spark.createDataFrame(rows, "risk_level string, minicheck_triggered int, retry_triggered int")
    s = ev.verification_summary(rec).first()
    assert (s["n"], s["n_high"], s["n_checked"], s["n_retries"], round(s["retry_pct"], 1)) == (18, 3, 3, 2, 66.7)
    assert ev.verification_summary(rec.where("risk_level = 'LOW'")).first()["retry_pct"] == 0.0


def test_subset_case_and_truncation(spark):
    g = spark.createDataFrame([(1, "Alpha"), (2, "alphabet")], "index int, question string")
    assert ev.subset(g, []).count() == 2 and ev.subset(g, [2]).first()["index"] == 2
    assert ev.find_case(g, "ALPHA").first()["index"] == 1
    assert one(spark, ev.truncated_context(F.lit("abc"), 2)) == "ab" + fv.CONTEXT_CUT


# --- latency ----------------------------------------------------------------

@pytest.mark.parametrize("values,p80", [([1.0, 2.0, 3.0, 4.0, 5.0], 5.0), ([3.14], 3.1), ([float(i) for i in range(1000)], 800.0),
                                        ([1.0] * 99 + [2.0], 1.0)])
def test_p80(spark, values, p80):
    df = spark.createDataFrame([("LOW", v) for v in values], "risk string, total double")
    assert lt.risk_percentiles(df).first()["p80"] == p80


def test_p80_of_nothing(spark):
    assert lt.risk_percentiles(spark.createDataFrame([], "risk string, total double")).count() == 0


LOG = ["2026-06-10 19:36:38,005 | INFO | Query Complete | Total Latency: 1.00s | Hybrid Retrieval Match (R): 0.50s | X (G): 0.25s",
       "2026-06-10 19:36:39,005 | INFO | _classify_query_risk → HIGH  (matched: 'x')",
       "2026-06-10 19:36:40,005 | INFO | _classify_query_risk → LOW", "noise",
       "2026-06-10 19:36:41,005 | INFO | Query Complete | Total Latency: 2.00s | Hybrid Retrieval Match (R): 0.50s | X (G): 0.25s",
       "2026-06-10 19:36:42,005 | INFO | Query Complete | Total Latency: 3.00s | Hybrid Retrieval Match (R): 0.50s | X (G): 0.25s"]


def test_pairing(spark):
    lines = spark.createDataFrame(list(enumerate(LOG)), "n int, line string")
    for stream in (None, ["k"]):
        marks = lt.log_marks(lines.withColumn("k", F.lit(1)))
        got = [(r["risk"], r["total"]) for r in lt.pair_risks(marks, [F.asc("n")], stream).collect()]
        assert got == [("LOW", 2.0)]
    t = lt.timings(lines).orderBy("n").first()
    assert (t["total"], t["retrieval"], t["generation"]) == (1.0, 0.5, 0.25) and str(t["ts"]) == "2026-06-10 19:36:38"


def test_log_files(spark, tmp_path):
    for day, n in (("01", 500), ("02", 550), ("03", 100)):
        (tmp_path / f"app_202606{day}.log").write_text("\n".join(f"{day} {i}" for i in range(n)) + "\n")
    lines = lg.read_logs(spark, str(tmp_path))
    kept = lg.newest_files(lines)
    assert sorted({r["file_name"][8:12] for r in kept.select("file_name").distinct().collect()}) == ["0602", "0603"]
    ordered = [r["line"] for r in kept.orderBy(*lg.ORDER).collect()]
    assert ordered[:2] == ["02 0", "02 1"] and ordered[-1] == "03 99" and len(ordered) == 650


# --- sources ----------------------------------------------------------------

def test_markdown_folder(spark, tmp_path):
    for name in ("b.MARKDOWN", "a.md", "all_Merged.md", "c.txt"):
        (tmp_path / name).write_text(f"# {name}\n")
    rows = read_markdown(spark, str(tmp_path)).orderBy("file_id").collect()
    assert [(r["file_id"], r["file_name"]) for r in rows] == [(1, "a.md"), (2, "b.MARKDOWN")]


def test_child_lines(spark, tmp_path):
    lines = ['{"id": "a", "page_content": "x", "metadata": {"parent_link": "p", "source": "s", "content_type": "list"}}', "", "{broken",
             '{"page_content": "y"}', '{"id": "c", "page_content": ""}']
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    rows = sorted(st.read_children(spark, str(tmp_path)).collect(), key=lambda r: r["page_content"])
    assert [r["id"] for r in rows] == ["a", "unknown_4"]
    assert tuple(rows[0]["metadata"]) == ("p", "s", "list") and tuple(rows[1]["metadata"]) == ("unknown_4", "Unknown", "prose")
    assert st.rejected_lines(spark, str(tmp_path)).count() == 1


def test_unreadable_file_keeps_its_number(spark, tmp_path, monkeypatch):
    for name in ("a.md", "b.md", "c d.md"):
        (tmp_path / name).write_text(f"# {name}\n")
    scan = spark.read.format("binaryFile").load(str(tmp_path))
    assert scan.count() == 3
    rows = read_markdown(spark, str(tmp_path))
    (tmp_path / "b.md").unlink()  # listed, but gone when it is read
    assert sorted((r["file_id"], r["file_name"]) for r in rows.collect()) == [(1, "a.md"), (3, "c d.md")]


def test_child_ids_are_line_numbers_of_their_file(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(['{"id": "x", "page_content": "t"}', "", '{"page_content": "%s"}' % name]))
    assert sorted(r["id"] for r in st.read_children(spark, str(tmp_path)).collect()) == ["unknown_3", "unknown_3", "x", "x"]


def test_malformed_files_fail(spark, tmp_path):
    (tmp_path / "g.json").write_text("{not json")
    (tmp_path / "q.json").write_text('{"groups": []}')
    with pytest.raises(Exception, match="not a JSON array"):
        st.read_golden_items(spark, str(tmp_path / "g.json")).collect()
    with pytest.raises(Exception, match="missing categories"):
        st.read_question_list(spark, str(tmp_path / "q.json")).collect()


def test_parent_last_duplicate_wins(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"id": "a", "text": "old"}\n{"id": "a", "text": "new"}\n')
    assert [r["text"] for r in st.read_parents(spark, str(tmp_path)).collect()] == ["new"]


def test_question_list(spark, tmp_path):
    good = {"categories": [{"name": "n", "emoji": "e", "intro": "i", "questions": [
        "plain", {"label": "l", "answer": "a"}, {"label": "l", "prompt": "p", "answer": "a"}, {"label": "l", "prompt": "p"}, {"label": "l"}]}]}
    (tmp_path / "q.json").write_text(json.dumps(good))
    rows = st.resolve_questions(st.read_question_list(spark, str(tmp_path / "q.json"))).orderBy("pos").collect()
    assert [(r["label"], r["prompt"], r["answer"]) for r in rows] == [
        ("plain", "plain", ""), ("l", "", "a"), ("l", "", "a"), ("l", "p", ""), ("l", "l", "")]
    (tmp_path / "bad.json").write_text('{"categories": [{"name": "n", "questions": 5}]}')
    with pytest.raises(Exception, match="missing questions list"):
        st.read_question_list(spark, str(tmp_path / "bad.json")).collect()


def test_golden_file_and_eval_files(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([{"question_category": "f", "question": "q", "expected_answer": "a",
                                                   "sources": [{"document_title": "t", "section_title": "s", "raw_text": "r"}]}]))
    g = st.golden_rows(st.read_golden_items(spark, str(tmp_path / "g.json"))).first()
    assert (g["index"], g["question"], g["sources"][0]["document_title"]) == (1, "q", "t")
    rec = spark.createDataFrame([(1, 'say "x",\nok', "long")], "index int, question string, generated_answer string")
    st.write_eval(rec, str(tmp_path / "trace"), str(tmp_path / "metrics"))
    assert tuple(st.read_eval(spark, str(tmp_path / "metrics"), "index int, question string").first()) == (1, 'say "x",\nok')
    assert spark.read.json(str(tmp_path / "trace")).first()["generated_answer"] == "long"


def test_missing_store_fails_early(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="chunks not found"):
        open_store(spark, str(tmp_path))


# --- splitter ---------------------------------------------------------------

def test_recursive_split_bounds_and_cover():
    text = "\n\n".join(" ".join(f"word{i}_{j}" for j in range(40)) for i in range(6))
    parts = spl.recursive_split(text, 200, 40, spl.PARAGRAPHS_FIRST)
    assert all(len(p) <= 200 for p in parts)
    assert set(text.split()) == set(" ".join(parts).split())
    assert spl.recursive_split("short", 200, 40, spl.HEADERS_FIRST) == ["short"]


def test_header_sections(spark):
    docs = spark.createDataFrame([(1, "intro\n# A\na1\n\na2\n## B\n| x |\n# C\nc")], "file_id int, value string")
    rows = spl.header_sections(docs).orderBy("section_no").collect()
    assert [(r["section"], r["sub_section"]) for r in rows] == [(None, None), ("A", None), ("A", "B"), ("C", None)]
    kinds = [r["content_type"] for r in spl.split_sections(spl.header_sections(docs)).orderBy("section_no").collect()]
    assert kinds == ["prose", "prose", "table", "prose"]


# --- whole plans ------------------------------------------------------------

MD = ("# Guide\n\n## Cats\nCats are small animals that sleep for most of the day.\n\n## Dogs\nDogs are loyal animals that like to run "
      "in the park.\n\n## Table 1 Food\n| Animal | Requirement |\n|---|---|\n| cat | fish and milk |\n| dog | meat and bones |\n")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    docs = spark.createDataFrame([(1, MD)], "file_id long, value string")
    return build_store(docs, pv.offline(), str(tmp_path_factory.mktemp("store")))


def test_answers(spark, store):
    qs = spark.createDataFrame([(1, "Where do dogs like to run?", 7, None), (2, "Hello?", 7, " Hi. "), (3, "What are the 2 animals that sleep?", 8, "")],
                               "query_id int, question string, conv_id int, direct_answer string")
    turns = spark.createDataFrame([(7, 0, "a", "b")], "conv_id int, turn long, human string, assistant string")
    got = {r["query_id"]: r for r in answer(qs, store, pv.offline(), turns).collect()}
    assert "loyal animals" in got[1]["answer"] and got[1]["risk_level"] == "LOW"
    assert got[2]["answer"] == "Hi." and got[2]["sources"] == []
    assert got[3]["risk_level"] == "HIGH" and got[3]["checked"] and got[3]["answer"].endswith(fv.LIST_NOTE)
    assert got[1]["sources"][0]["source_title"] == "Guide"


def test_explain_and_evaluate(spark, store):
    golden = spark.createDataFrame([(1, "factual", "Where do dogs run?", "In the park", [("Guide", "", "")]), (2, " Negative", "Who?", "none", [])],
                                   "index int, question_category string, question string, expected_answer string, "
                                   "sources array<struct<document_title:string,section_title:string,raw_text:string>>")
    stages = explain_questions(golden.select(F.col("index").alias("query_id"), "question", "expected_answer"), store, pv.offline())
    assert {"question", "dense", "sparse", "fused", "parent", "context", "prompt", "actual", "expected"} == {
        r["stage"] for r in stages.select("stage").distinct().collect()}
    rec = {r["index"]: r for r in run_evaluation("r", golden, store, pv.offline()).collect()}
    assert rec[1]["retrieval_hit"] == 1 and rec[2]["retrieval_hit"] == 0 and not rec[1]["judge_failed"]
    assert set(ev.VERIFY_COLUMNS) <= set(rec[1].asDict())


# --- streams ----------------------------------------------------------------

def test_pair_stream_carries_waiting_risk(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    for n, part in enumerate((LOG[:3], LOG[3:5], LOG[5:])):
        spark.createDataFrame([(n * 10 + i, x) for i, x in enumerate(part)], "n int, line string").coalesce(1) \
             .write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("n int, line string").option("maxFilesPerTrigger", 1).parquet(str(src))
    pair_stream(stream, ["n"], out, str(tmp_path / "cp")).awaitTermination()
    assert [(r["risk"], r["total"]) for r in spark.read.parquet(f"{out}/pairs").collect()] == [("LOW", 2.0)]


def test_memory_stream(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    for n in range(3):
        spark.createDataFrame([(1, n, "h", "a" * 430)], "conv_id int, turn long, human string, assistant string").coalesce(1) \
             .write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("conv_id int, turn long, human string, assistant string").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = memory_stream(stream, out, str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(r["turn"] for r in last_carry(spark, q, out).collect()) == [1, 2]


def test_golden_file_is_written_by_many_tasks(spark, monkeypatch, tmp_path):
    """No file, and no task that writes one, holds the whole set; items keep their numbers."""
    from folioquery.catalog import evaluation
    monkeypatch.setattr(evaluation, "GOLDEN_A_FILE", 10)
    monkeypatch.setattr(evaluation, "new_table_path", lambda spark, name: str(tmp_path / name))
    docs = [(i, "en" if i % 2 else "fr", f"s{i}", f'text "{i}", [{{') for i in range(37, 0, -1)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(evaluation.golden_file(spark, str(tmp_path)).select("index", "expected_answer", "document_title").collect())
    assert [tuple(r) for r in got] == [(i, f'text "{i}", [{{', f"s{i}") for i in range(1, 38)]
    assert len(list((tmp_path / "golden-file").glob("part=*/*.txt"))) == 4
