"""Stage-by-stage trace of retrieval for any number of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioquery.functions import fixed_values as fv
from folioquery.functions.text import token_estimate, token_headroom
from folioquery.operators.context import assemble, parent_lookup, with_neighbors
from folioquery.operators.fuse import rrf
from folioquery.operators.joins import pick_rows
from folioquery.plans.ask import candidate_lists
from folioquery.plans.build import Store
from folioquery.providers import GENERATOR_TEMPLATE, Providers, fill
from folioquery.session import materialize


def _stage(df: DataFrame, name: str, rank: Column, chunk: Column, score: Column, detail: Column) -> DataFrame:
    return df.select("query_id", F.lit(name).alias("stage"), rank.cast("int").alias("rank"),
                     chunk.cast("string").alias("chunk_id"), score.cast("double").alias("score"),
                     detail.cast("string").alias("detail"))


def explain_questions(questions: DataFrame, store: Store, providers: Providers,
                      top_k: int = fv.TOP_K) -> DataFrame:
    """(query_id, stage, rank, chunk_id, score, detail) over all stages.

    questions(query_id, question, expected_answer). The trace takes the fused
    list's first top_k as is, without the re-ranker.
    """
    dense, sparse = candidate_lists(questions, store, providers, top_k)
    dense, sparse = materialize(dense, "dense"), materialize(sparse, "sparse")
    fused = materialize(rrf(dense, sparse, pool=None), "fused")
    texts = materialize(pick_rows(store.chunks.withColumnRenamed("pos", "chunk_id"), fused, "chunk_id").select(
        "chunk_id", "id", "page_content", F.col("metadata.source").alias("source"),
        F.col("metadata.content_type").alias("content_type")), "texts")
    named = lambda df: df.join(texts, "chunk_id")
    snippet = F.replace(F.substring("page_content", 1, 120), F.lit("\n"), F.lit(" "))
    chosen = named(fused.where(F.col("rrf_rank") <= top_k)).select(
        "query_id", F.col("rrf_rank").alias("hit"), F.col("id").alias("chunk_id"),
        "page_content", "source", "content_type")
    hits = materialize(with_neighbors(parent_lookup(chosen, store.parents), store.parents), "trace-hits")
    context = assemble(hits).select("query_id", "context").join(questions, "query_id")
    prompt = fill(GENERATOR_TEMPLATE, context=F.col("context"), chat_history=F.lit(fv.NO_HISTORY),
                  question=F.col("question"))
    room = token_headroom(prompt)
    draft = providers.generate(F.col("context"), F.lit(fv.NO_HISTORY), F.col("question"))
    none = F.lit(None)
    tail = context.withColumn("prompt", prompt)
    stages = [
        _stage(questions, "question", none, none, none, F.col("question")),
        _stage(named(dense), "dense", F.col("rank"), F.col("id"), F.col("score"), snippet),
        _stage(named(sparse), "sparse", F.col("rank"), F.col("id"), F.col("score"), snippet),
        _stage(named(fused), "fused", F.col("rrf_rank"), F.col("id"), F.col("rrf"),
               F.when(F.col("rrf_rank") <= top_k, "YES").otherwise("no")),
        _stage(hits, "parent", F.col("hit"), F.col("chunk_id"), token_estimate(F.col("text")), F.col("text")),
        _stage(context, "context", none, none, token_estimate(F.col("context")), F.col("context")),
        _stage(tail, "prompt", none, none, room,
               F.concat(F.when(room < 0, "OVERFLOW\n").otherwise(""), F.col("prompt"))),
        _stage(context, "actual", none, none, none, draft),
        _stage(questions, "expected", none, none, none, F.col("expected_answer")),
    ]
    out = stages[0]
    for s in stages[1:]:
        out = out.unionByName(s)
    return out
