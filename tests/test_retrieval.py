"""Sparse, dense, fused retrieval against brute force; context and memory rules."""

import dataclasses
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioquery.functions.text import sparse_tokens
from folioquery.operators import context as cx, memory as mm, sparse as sp
from folioquery.operators.dense import knn, normalize
from folioquery.operators.fuse import chapter_cap, rerank, rrf
from folioquery.operators.joins import join_small, with_positions


def test_tokens_split_on_spaces_only(spark):
    text = "Title\nContent: a|b  The-end\t\n \n x."
    got = spark.range(1).select(sparse_tokens(F.lit(text)).alias("t")).first()["t"]
    assert got == ["title\ncontent", "a|b", "the", "end\t\n", "x"]


def brute_bm25(docs, query):
    words = {d: t.split() for d, t in docs.items()}
    n, avgdl = len(words), sum(map(len, words.values())) / len(words)
    df = {}
    for ws in words.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    score = {}
    for d, ws in words.items():
        s = sum(idf.get(q, 0) * ws.count(q) * 2.5 / (ws.count(q) + 1.5 * (0.25 + 0.75 * len(ws) / avgdl)) for q in query.split())
        if s > 0:
            score[d] = round(s, 6)
    return [(d, score[d]) for d in sorted(score, key=lambda d: (-score[d], d))]


@pytest.mark.parametrize("stored", [False, True])
def test_bm25_matches_brute_force(spark, tmp_path, stored):
    rng = random.Random(7)
    vocab = ["common"] * 12 + [f"w{i}" for i in range(30)]
    docs = {i: " ".join(rng.choices(vocab, k=rng.randint(0, 25))) for i in range(60)}
    queries = {1: "common w1 w1 w2", 2: "w3 nowhere", 3: "common", 4: "nowhere"}
    index = sp.build_index(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    if stored:
        index = index.write(str(tmp_path / "index"))
    qs = spark.createDataFrame(list(queries.items()), "query_id long, question string")
    rows = sp.bm25_top(qs, index, 5).collect()
    for qid, text in queries.items():
        got = [(r["doc_id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == qid]
        want = brute_bm25(docs, text)[:5]
        assert [g[0] for g in got] == [w[0] for w in want]
        assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=2e-6)


def test_repeated_query_term_counts_twice(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "fish bird"), (3, "tree leaf")], "doc_id long, text string")
    qs = spark.createDataFrame([(1, "cat"), (2, "cat cat")], "query_id long, question string")
    s = {r["query_id"]: r["score"] for r in sp.bm25_top(qs, sp.build_index(docs)).collect()}
    assert s[2] == pytest.approx(2 * s[1], abs=2e-6)


def test_salted_join_equals_broadcast(spark):
    big = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("term"), F.col("id").alias("doc_id"))
    small = spark.createDataFrame([("hot", 1, True), ("hot", 2, True), ("k800", 1, False)], "term string, q int, hot boolean")
    a = join_small(big, small, "term", "hot", "doc_id")
    b = join_small(big, small, "term", "hot", "doc_id", max_rows=1)
    assert sorted(map(tuple, a.select("term", "doc_id", "q").collect())) == sorted(map(tuple, b.select("term", "doc_id", "q").collect()))
    assert b.count() == 1401


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
@pytest.mark.parametrize("shipped", [100, 2])
def test_knn_matches_brute_force(spark, metric, shipped):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (80, 4)).astype(float)  # small integers make ties
    v[~v.any(axis=1)] = 1.0
    q = v[:5]
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, vec array<float>")
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, vec array<float>")
    rows = knn(queries, vectors, 7, metric, max_shipped=shipped).collect()
    for i, x in enumerate(q):
        if metric == "l2":
            key = [(round(float(((x - y) ** 2).sum()), 6), j) for j, y in enumerate(v)]
        else:
            norm = (np.linalg.norm(x) if metric == "cosine" else 1.0)
            key = [(-round(float(x @ y / (norm * (np.linalg.norm(y) if metric == "cosine" else 1.0))), 6), j) for j, y in enumerate(v)]
        got = [r["chunk_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == i]
        assert got == [j for _, j in sorted(key)[:7]]


def test_knn_string_ids_and_no_questions(spark):
    vectors = spark.createDataFrame([("f1_p0", [1.0, 0.0]), ("f1_p1", [0.0, 1.0])], "chunk_id string, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.1])], "query_id long, vec array<double>")
    assert [r["chunk_id"] for r in knn(q, vectors).orderBy("rank").collect()] == ["f1_p0", "f1_p1"]
    assert knn(q.where("query_id < 0"), vectors).count() == 0


def test_normalize(spark):
    got = spark.range(1).select(normalize(F.array(F.lit(3.0), F.lit(4.0))).alias("v")).first()["v"]
    assert got == pytest.approx([0.6, 0.8])


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id int, chunk_id string, rank int")


def test_rrf_order_and_ties(spark):
    dense = ranked(spark, [(1, "a", 1), (1, "b", 2), (2, "d1", 1)])
    sparse = ranked(spark, [(1, "b", 1), (1, "c", 2), (2, "s1", 1)])
    rows = rrf(dense, sparse).orderBy("query_id", "rrf_rank").collect()
    assert [r["chunk_id"] for r in rows if r["query_id"] == 1] == ["b", "a", "c"]
    assert rows[0]["rrf"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-12)
    assert [r["chunk_id"] for r in rows if r["query_id"] == 2] == ["d1", "s1"]
    assert all(r["rrf"] <= 2 / 61 for r in rows)


def test_rerank_keeps_fusion_order_on_ties(spark):
    pool = spark.createDataFrame([(1, "a", 1, 0.5), (1, "b", 2, 0.9), (1, "c", 3, 0.5)], "query_id int, chunk_id string, rrf_rank int, s double")
    assert [r["chunk_id"] for r in rerank(pool, F.col("s"), 3).orderBy("hit").collect()] == ["b", "a", "c"]


def test_chapter_cap(spark):
    hits = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 3, "y")], "query_id int, hit int, chapter string")
    assert sorted(r["hit"] for r in chapter_cap(hits, 1).collect()) == [1, 3]


def test_positions(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("x"))
    rows = with_positions(df, [F.asc("x")]).collect()
    assert sorted((r["pos"], r["x"]) for r in rows) == [(i + 1, i) for i in range(500)]


# --- context ----------------------------------------------------------------

def table_parents(spark, n, siblings=True):
    names = [f"f1_t1_r{i}" for i in range(n)]
    rows = [(names[i], f"row {i + 1}", ("Doc", "Ch", "Sec", "table", "Doc::Sec", i + 1, n if n > 1 else 0,
             [x for x in names if x != names[i]])) for i in range(n)]
    rows.append(("f1_p9", "prose", ("NIST AI 100-2e2023 Report", "Ch", "", "prose", None, None, None, None)))
    return spark.createDataFrame(rows, "id string, text string, metadata struct<source:string,chapter:string,section:string,"
                                 "content_type:string,table_id:string,table_row:int,table_total:int,sibling_ids:array<string>>")


def hits(spark, *chunks):
    rows = [(1, i, c, f"child {c}", "Child source", "prose") for i, c in enumerate(chunks, 1)]
    return spark.createDataFrame(rows, "query_id int, hit int, chunk_id string, page_content string, source string, content_type string")


@pytest.mark.parametrize("row,used", [(0, ["r0", "r1"]), (1, ["r1", "r0", "r2"]), (3, ["r3", "r2"])])
def test_neighbours(spark, row, used):
    out = cx.build_context(hits(spark, f"f1_t1_r{row}"), table_parents(spark, 4)).first()
    assert [x.split("_")[-1] for x in out["used_ids"]] == used
    assert out["context"].count("[table context — adjacent row]") == len(used) - 1


def test_consumed_neighbour_blocks_hit_and_its_neighbours(spark):
    out = cx.build_context(hits(spark, "f1_t1_r1", "f1_t1_r2", "f1_p9"), table_parents(spark, 6)).first()
    assert [x.split("_")[-1] for x in out["used_ids"]] == ["r1", "r0", "r2", "p9"]
    assert len(out["sources"]) == 2
    assert "--- Source: NIST AI 100-2 | Ch ---\nprose" in out["context"]


def test_missing_parent_falls_back_to_child(spark):
    out = cx.build_context(hits(spark, "gone"), table_parents(spark, 2)).first()
    assert out["context"] == "--- Source: Child source ---\nchild gone"


def test_citations(spark):
    out = cx.build_context(hits(spark, "f1_t1_r1", "f1_p9"), table_parents(spark, 3))
    text = out.select(cx.citation_lines(F.col("sources")).alias("t")).first()["t"]
    assert text == ("\n\nSources:\n[1] Doc | Ch (TABLE)\n    Table: Sec  (3 rows total)\n"
                    "[2] NIST AI 100-2e2023 Report | Ch (PROSE)")
    assert spark.range(1).select(cx.citation_lines(F.array().cast(f"array<{cx.SOURCE}>")).alias("t")).first()["t"] == ""


def test_top_chunk(spark):
    two = "--- Source: A ---\nfirst\n\n--- Source: B ---\nsecond\nmore\n"
    row = spark.range(1).select(cx.top_chunk(F.lit(two)).alias("c"), cx.top_chunk(F.lit(two), False).alias("f"),
                                cx.top_chunk(F.lit("--- Source: A ---\n" + "x" * 900)).alias("one")).first()
    assert (row["c"], row["f"], len(row["one"])) == ("second\nmore", "first", 800)


# --- memory -----------------------------------------------------------------

def turns(spark, *sizes):
    frame = len("Human: \nAssistant: ")
    return spark.createDataFrame([(1, i, "h", "a" * (n - frame - 1)) for i, n in enumerate(sizes)],
                                 "conv_id int, turn long, human string, assistant string")


@pytest.mark.parametrize("sizes,kept", [((600, 500, 300), [1, 2]), ((100, 2000, 100), [2]), ((2000,), []), ((20,) * 80, list(range(30, 80)))])
def test_history_window(spark, sizes, kept):
    got = mm.kept_turns(turns(spark, *sizes), 1000).collect()
    assert sorted(r["turn"] for r in got) == kept


def test_history_text(spark):
    asked = spark.createDataFrame([(1,), (2,)], "conv_id int")
    got = {r["conv_id"]: r["history"] for r in mm.history_text(turns(spark, 30, 40), asked).collect()}
    assert got[1].count("Human: ") == 2 and "\n\n" in got[1] and got[2] == "No previous conversation."


def test_append_and_clear(spark):
    new = spark.createDataFrame([(1, 5, "x", "y"), (1, 6, "x2", "y"), (3, 0, "z", "y")], "conv_id int, turn long, human string, assistant string")
    both = mm.append_turns(turns(spark, 30, 40), new)
    assert sorted((r["conv_id"], r["turn"], r["human"]) for r in both.collect()) == [
        (1, 0, "h"), (1, 1, "h"), (1, 2, "x"), (1, 3, "x2"), (3, 0, "z")]
    assert mm.clear_conversations(both, spark.createDataFrame([(1,)], "conv_id int")).count() == 1


def test_chunk_keys_hold_any_size(spark):
    from folioquery.plans.build import chunk_key, file_of
    rows = [(1, 2**24), (2, 0), (2**40, 5), (2**40, 2**33), (2, 1)]
    keyed = spark.createDataFrame(rows, "f long, n long").select("f", "n", chunk_key(F.col("f"), F.col("n")).alias("k"), file_of(chunk_key(F.col("f"), F.col("n"))).alias("g"))
    got = keyed.orderBy("k").collect()
    assert [(r["f"], r["n"]) for r in got] == sorted(rows) and all(r["f"] == r["g"] for r in got) and len({r["k"] for r in got}) == len(rows)


@pytest.mark.parametrize("shipped", [16_384, 0])
def test_knn_leaves_out_what_cannot_be_compared(spark, shipped):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [0.0, 0.0]), (5, [0.6, 0.8]), (6, [None, 1.0]), (7, [])],
                                    "chunk_id long, vec array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id long, vec array<double>")
    got = sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in knn(asked, vectors, 3, "cosine", max_shipped=shipped).collect())
    assert got == [(1, 1, 1, 1.0), (1, 2, 5, 0.6), (1, 3, 4, 0.0), (3, 1, 1, 0.0), (3, 2, 4, 0.0), (3, 3, 5, 0.0)]


# --- blocks -----------------------------------------------------------------

def random_corpus(spark, n_docs, seed):
    """Few common words, many rare ones, copies of whole documents."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 60))) for _ in range(n_docs)]
    texts = [texts[rng.randint(0, i)] if rng.random() < 0.1 else t for i, t in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    questions = [" ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 8))) for _ in range(25)] + ["", "nothing known", "w0", "w0 w1 w0"]
    return docs, spark.createDataFrame(list(enumerate(questions)), "query_id long, question string")


def best_list(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("k, block, literals", [(3, 8, 256), (12, 16, 0), (500, 1024, 256)])
def test_blocks_equal_exhaustive_scores(spark, tmp_path, monkeypatch, k, block, literals):
    from folioquery.operators import blocks
    monkeypatch.setattr(blocks, "BLOCK", block)
    monkeypatch.setattr(blocks, "LITERALS", literals)
    docs, questions = random_corpus(spark, 600, k)
    index = sp.build_index(docs).write(str(tmp_path / "index"))
    plain = dataclasses.replace(index, blocks=None)
    assert best_list(sp.bm25_top(questions, index, k)) == best_list(sp.bm25_top(questions, plain, k))
    assert best_list(sp.bm25_top(questions, index, k, k1=0.9)) == best_list(sp.bm25_top(questions, plain, k, k1=0.9))


def test_blocks_hold_every_posting_once(spark, tmp_path, monkeypatch):
    from folioquery.operators import blocks
    monkeypatch.setattr(blocks, "BLOCK", 8)
    index = sp.build_index(random_corpus(spark, 500, 1)[0]).write(str(tmp_path / "index"))
    rows = index.blocks.collect()
    assert len({(r.term, r.level, r.part) for r in rows}) == len(rows) > 600
    assert all(abs(r.top - max(e.impact for e in r.entries)) < 1e-12 for r in rows)
    assert sum(len(r.entries) for r in rows) == index.postings.count() == len({(r.term, e.doc_id) for r in rows for e in r.entries})
    best = {}
    for r in rows:
        best.setdefault(r.term, []).append((r.level, r.top))
    assert all(a[1] >= b[1] - 1e-12 for levels in best.values() for a, b in itertools.combinations(sorted(levels, key=lambda x: (x[0], -x[1])), 2)
               if a[0] < b[0])


def test_blocks_are_skipped(spark, tmp_path, monkeypatch):
    """A term of two words' questions: blocks that cannot reach the floor are not read, folders of other terms neither."""
    from folioquery.operators import blocks
    monkeypatch.setattr(blocks, "BLOCK", 64)
    docs = [(i, "rare common " + "filler " * 3 if i < 20 else "common " + " ".join(f"x{i}y{j}" for j in range(40))) for i in range(400)]
    index = sp.build_index(spark.createDataFrame(docs, "doc_id long, text string")).write(str(tmp_path / "index"))
    terms = sp.question_terms(spark.createDataFrame([(1, "rare common")], "query_id long, question string"))
    asked, shards = blocks.with_bounds(sp.with_idf(terms, index).toPandas()), index.made["shards"]
    least = blocks.wanted_terms(asked, index.blocks, shards, 5).set_index("term")["least"]
    of_common = index.blocks.where("term = 'common'").collect()
    assert 0 < sum(r.top >= least["common"] for r in of_common) < len(of_common)
    plan = blocks.pick_blocks(index.blocks, *blocks._keys(spark, asked[["term"]], shards), shards)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*shard#\d+ (IN|=)", plan) and re.search(r"PushedFilters: \[[^\]]*In\(term", plan)


def test_negative_idf_terms_keep_bounds_right(spark, tmp_path, monkeypatch):
    """Terms in nearly all documents may take score away."""
    from folioquery.operators import blocks
    monkeypatch.setattr(blocks, "BLOCK", 4)
    docs = spark.createDataFrame([(i, "all most " + ("some " if i % 2 else "") + f"word{i % 7}") for i in range(60)], "doc_id long, text string")
    questions = spark.createDataFrame([(1, "all most some"), (2, "all word3"), (3, "most some word1 word2")], "query_id long, question string")
    index = sp.build_index(docs).write(str(tmp_path / "index"))
    assert best_list(sp.bm25_top(questions, index, 4)) == best_list(sp.bm25_top(questions, dataclasses.replace(index, blocks=None), 4))


def test_blocks_take_one_shuffle_and_small_tasks(spark, tmp_path, monkeypatch):
    """Postings move once, whatever the vocabulary; a term's parts are dealt over tasks."""
    from folioquery.operators import blocks
    monkeypatch.setattr(blocks, "BLOCK", 8)
    monkeypatch.setattr(blocks, "PARTS_A_TASK", 1)
    docs, _ = random_corpus(spark, 500, 1)
    index = sp.build_index(docs).write(str(tmp_path / "index"))
    made = blocks.blocked(index.postings, index.terms, index.made["shards"], 9.0, 1.5, 0.75)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange rangepartitioning" not in plan
    common = max(index.terms.collect(), key=lambda r: r["df"])["term"]
    assert made.where(F.col("term") == common).select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_blocks_go_on_over_batches(size):
    """Whatever batches the sorted postings come in, a block is one row."""
    from folioquery.operators import blocks
    rows = [(t % 2, f"t{t:02}", level, part, 1000 * t + i, float(i)) for t in (2, 4, 1, 3) for level in (0, 1) for part in (0, 1) for i in range(t)]
    rows.sort(key=lambda r: r[:4])
    names = ["shard", "term", "level", "part", "doc_id", "impact"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[a:a + size]]) for a in range(0, len(rows), size)]
    got = [r for b in blocks._grouped(iter(batches)) for r in b.to_pylist()]
    assert [(r["shard"], r["term"], r["level"], r["part"], e["doc_id"], e["impact"]) for r in got for e in r["entries"]] == rows
    assert len(got) == len({r[:4] for r in rows}) and all(r["top"] == max(e["impact"] for e in r["entries"]) for r in got)


def test_terms_are_counted_some_documents_at_a_time(monkeypatch):
    """A batch of many tokens is counted in pieces; no document is cut."""
    monkeypatch.setattr(sp, "TOKENS_AT_ONCE", 5, raising=False)
    tokens = [["a", "b", "a"], [], ["b"] * 12, None, ["c", "a", "c", "c"], ["a"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(tokens, pa.list_(pa.string()))], names=["doc_id", "tokens"])
    out = list(sp._count_terms(iter([batch])))
    assert len(out) > 1
    got = sorted((r["doc_id"], r["term"], r["tf"], r["dl"]) for b in out for r in b.to_pylist())
    assert got == [(0, "a", 2, 3), (0, "b", 1, 3), (2, "b", 12, 12), (4, "a", 1, 4), (4, "c", 3, 4), (5, "a", 1, 1)]
