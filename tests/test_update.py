"""Stores that change against stores built anew."""

import random

import pytest
from pyspark.sql import functions as F

from folioquery.operators import sparse as sp
from folioquery.plans.build import build_store
from folioquery.plans.update import LiveIndex, LiveStore
from folioquery.providers import offline


def docs_of(spark, texts):
    return spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")


def keys_of(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "key long")


def content(index):
    stats = index.stats.first()
    return (sorted(map(tuple, index.postings.select("doc_id", "term", "tf", "dl").collect())),
            sorted(map(tuple, index.terms.select("term", "df").collect())),
            (stats["n_docs"], round(stats["avgdl"], 9), round(stats["mean_idf"], 9)))


def test_changes_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    text = lambda: " ".join(rng.choices(words, k=rng.randint(0, 12)))
    live, now = LiveIndex(spark, str(tmp_path / "live")), {}
    for step in range(4):
        changed = {rng.randint(0, 25): text() for _ in range(10)}
        gone = {i for i in rng.sample(range(30), 5)} - changed.keys()   # some were never there
        live.change(docs_of(spark, changed), keys_of(spark, gone))
        now = {i: t for i, t in {**now, **changed}.items() if i not in gone}
        if step == 2:
            live.compact()
        if step != 1:
            assert content(live.open()) == content(sp.build_index(docs_of(spark, now)))
    questions = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w4")], "query_id long, question string")
    got, want = (sorted(map(tuple, sp.bm25_top(questions, x, 5).collect())) for x in (live.open(), sp.build_index(docs_of(spark, now))))
    assert got == want
    stored = live.open().write(str(tmp_path / "blocks"))
    assert stored.blocks is not None and sorted(map(tuple, sp.bm25_top(questions, stored, 5).collect())) == want


def test_a_change_that_died_is_not_read(spark, tmp_path):
    live = LiveIndex(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        live.open()
    none = keys_of(spark, [])
    live.change(docs_of(spark, {1: "a b", 2: "c"}), none)
    before = content(live.open())
    seg = live.segments
    seg.write(seg.next(), "postings", sp.build_postings(docs_of(spark, {1: "x"})).withColumn("key", F.col("doc_id")))
    seg.write(seg.next(), "gone", keys_of(spark, [1, 2]))          # and then the job is lost
    assert content(live.open()) == before
    live.change(docs_of(spark, {2: "d d"}), none)                   # takes the same number
    assert content(live.open()) == content(sp.build_index(docs_of(spark, {1: "a b", 2: "d d"})))


def test_all_gone(spark, tmp_path):
    live = LiveIndex(spark, str(tmp_path))
    live.change(docs_of(spark, {1: "a b", 2: ""}), keys_of(spark, []))
    live.change(docs_of(spark, {}), keys_of(spark, [1, 2]))
    index = live.open()
    assert index.postings.count() == 0 and index.terms.count() == 0 and live.segments.totals() == {"docs": 0, "tokens": 0}


def test_store_of_files(spark, tmp_path):
    """Parsed chunks, vectors and index by file; a rewritten file keeps none of its old chunks."""
    body = lambda i, extra="": f"# File {i}\n## Part\nThis paragraph of file {i} is longer than forty characters.{extra}\n\n- item {i}"
    files = lambda d: spark.createDataFrame(sorted(d.items()), "file_id long, value string")
    live = LiveStore(spark, str(tmp_path / "live"), offline())
    live.upsert(files({i: body(i, "\n\nAnother paragraph which is also longer than forty characters." * (i % 3)) for i in range(6)}))
    live.upsert(files({2: body(2), 7: body(7), 3: "short"}), spark.createDataFrame([(5,)], "file_id long"))
    now = {i: body(i, "\n\nAnother paragraph which is also longer than forty characters." * (i % 3)) for i in (0, 1, 4)} | {2: body(2), 7: body(7), 3: "short"}
    want, got = build_store(files(now), offline(), str(tmp_path / "new")), live.store()
    as_rows = lambda df: sorted(map(str, df.collect()))
    assert as_rows(got.chunks.select(*want.chunks.columns)) == as_rows(want.chunks)
    assert as_rows(got.vectors.select(*want.vectors.columns)) == as_rows(want.vectors)
    assert content(got.index) == content(want.index)
    live.compact()
    assert as_rows(live.store().chunks.select(*want.chunks.columns)) == as_rows(want.chunks)
    assert len(live.segments.log()) == 1
