"""Evaluation plan: golden items through answering, judging and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioquery.functions import fixed_values as fv
from folioquery.operators import evaluate as ev
from folioquery.plans.ask import answer
from folioquery.plans.build import Store
from folioquery.providers import Providers
from folioquery.session import materialize


def judged(items: DataFrame, judge, negative_judge=None) -> DataFrame:
    """Route items to the judge for their category; failed ones are not judged.

    items(index, category, question, expected_answer, generated_answer, retrieved_context)
    """
    routed = items.withColumn("route", ev.judge_route(F.col("generated_answer"), F.col("category"))) \
                  .withColumn("judge_context", ev.truncated_context(F.col("retrieved_context")))
    args = [F.col(c) for c in ("question", "expected_answer", "generated_answer", "judge_context")]
    standard = routed.where(F.col("route") == "standard").select("index", judge(*args).alias("reply"))
    negative = routed.where(F.col("route") == "negative").select(
        "index", (negative_judge or judge)(*args).alias("reply"))
    return ev.scored(standard.unionByName(negative))


def run_evaluation(run_id: str, golden: DataFrame, store: Store, providers: Providers,
                   indices: list[int] | None = None, profile: str = "core", compat: bool = True,
                   negative_judge=None) -> DataFrame:
    """golden(index, question_category, question, expected_answer, sources) -> records.

    Every item is answered on its own, without conversation history. With
    ``compat`` an apology for an engine error is judged like an answer. The
    whole golden set is checked first.
    """
    ev.assert_golden(golden.select("index", F.to_json(F.struct(*fv.GOLDEN_FIELDS)).alias("item")))
    items = ev.subset(golden, indices or [])
    asked = items.select(F.col("index").alias("query_id"), "question")
    done = materialize(answer(asked, store, providers, profile=profile, compat=compat), "answers")
    if not compat:
        broken = F.startswith("answer", F.lit(fv.ERROR_ANSWER))
        done = done.withColumn("answer", F.when(broken, fv.ERROR_SENTINEL).otherwise(F.col("answer")))
    answers = done.withColumnRenamed("query_id", "index").join(
        items.select("index", F.transform("sources", lambda s: s["document_title"]).alias("expected")), "index")
    hit = (F.col("answer") != fv.ERROR_SENTINEL) & ev.retrieval_hit(
        F.col("expected"), F.transform("sources", lambda s: s["source_title"]))
    told = answers.select(
        "index", F.col("answer").alias("generated_answer"), F.col("context").alias("retrieved_context"),
        hit.cast("int").alias("retrieval_hit"), "risk_level",
        F.col("checked").cast("int").alias("minicheck_triggered"),
        F.col("faithful").alias("minicheck_faithful"), F.col("retried").cast("int").alias("retry_triggered"))
    scores = judged(
        told.join(items.select("index", F.col("question_category").alias("category"),
                               "question", "expected_answer"), "index"),
        providers.judge, negative_judge)
    return ev.eval_records(run_id, items, told, scores, verified=True)
