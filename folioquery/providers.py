"""Model stages as plug-ins, with deterministic offline stand-ins.

A provider is a function from columns to a column, so a built-in expression
and an Arrow UDF around a model client plug in the same way. The stand-ins
below are lexical; their scores are not model scores.
"""

from __future__ import annotations

import random
import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from folioquery.functions import fixed_values as fv
from folioquery.functions.text import bind, sentences, set_tokens, strip_markup

GENERATOR_TEMPLATE = (
    "Answer from the context only; say you don't know if it is not there. Keep it short, in plain "
    "text, close to the source wording.\n\nCONTEXT:\n{context}\n\nCONVERSATION:\n{chat_history}\n\n"
    "QUESTION: {question}"
)
RETRY_TEMPLATE = (
    "Find the one sentence of the context that answers the question and reply with it. Say you "
    "don't know if there is none.\n\nCONTEXT:\n{context}\n\nQUESTION: {question}"
)
CLAIM_TEMPLATE = "Document: {chunk}\nClaim: {claim}"


def fill(template: str, **values: Column) -> Column:
    """Substitute columns for ``{name}`` marks; values are not substituted again."""
    parts: list[Column] = []
    while template:
        at, name = min(((template.find("{%s}" % n), n) for n in values if "{%s}" % n in template),
                       default=(-1, ""))
        if at < 0:
            break
        parts += [F.lit(template[:at]), values[name]]
        template = template[at + len(name) + 2:]
    return F.concat(*parts, F.lit(template))


# --- stand-ins --------------------------------------------------------------

REMEMBERED_WORDS = 100_000  # by each Python worker


def hash_embedder(dim: int = 64) -> Callable[[Column], Column]:
    """Stand-in embedder: signed word hashing, unit length."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict[str, tuple[int, float]] = {}
        for texts in batches:
            out = np.zeros((len(texts), dim))
            for row, text in enumerate(texts):
                for word in (text or "").lower().split():
                    if word not in seen:
                        if len(seen) > REMEMBERED_WORDS:
                            seen.clear()
                        h = zlib.crc32(word.encode())
                        seen[word] = (h % dim, 1.0 if h >> 31 else -1.0)
                    slot, sign = seen[word]
                    out[row, slot] += sign
            length = np.linalg.norm(out, axis=1, keepdims=True)
            yield pd.Series(list((out / np.where(length == 0, 1.0, length)).astype(np.float32)))

    return embed


def overlap_reranker(question: Column, text: Column) -> Column:
    """Stand-in re-ranker: share of the question's words found in the text."""
    def share(q: Column) -> Column:
        shared = F.size(F.array_intersect(q, set_tokens(text)))
        return F.when(F.size(q) > 0, F.round(shared / F.size(q), 6)).otherwise(F.lit(0.0))

    return bind(set_tokens(question), share)


def extractive_generator(context: Column, history: Column | None, question: Column) -> Column:
    """Stand-in generator: the context sentence sharing most words with the question."""
    def best(q: Column) -> Column:
        scored = F.transform(sentences(context), lambda s, i: F.struct(
            F.size(F.array_intersect(q, set_tokens(s))).alias("shared"), (-i).alias("early"), s.alias("s")))
        return F.array_max(scored)["s"]

    return F.coalesce(strip_markup(bind(set_tokens(question), best)), F.lit(""))


def containment_verifier(chunk: Column, claims: Column) -> Column:
    """Stand-in verifier: a claim is supported when half its words are in the chunk."""
    def check(claim: Column, words: Column) -> Column:
        return bind(set_tokens(claim), lambda own: F.size(F.array_intersect(own, words)) * 2 >= F.size(own))

    return bind(set_tokens(chunk), lambda words: F.transform(claims, lambda claim: check(claim, words)))


def overlap_judge(question: Column, expected: Column, answer: Column, context: Column) -> Column:
    """Stand-in judge: word overlaps snapped down to the score anchors, as JSON text."""
    def share(part: Column, whole: Column) -> Column:
        a = set_tokens(part)
        ratio = F.when(F.size(a) > 0, F.size(F.array_intersect(a, set_tokens(whole))) / F.size(a)).otherwise(0.0)
        return F.element_at(F.array(*[F.lit(x) for x in fv.SCORE_ANCHORS]), (F.floor(ratio * 4) + 1).cast("int"))

    scores = {"faithfulness": share(answer, context), "relevance": share(question, answer),
              "completeness": share(question, context), "correctness": share(expected, answer)}
    fields = [c for m in fv.METRICS for c in (
        scores[m].alias(m), F.lit("word overlap stand-in").alias(f"{m}_reasoning"))]
    return F.to_json(F.struct(*fields))


@dataclass(frozen=True)
class Providers:
    embed: Callable[[Column], Column]
    rerank: Callable[[Column, Column], Column] = overlap_reranker
    generate: Callable[[Column, Column, Column], Column] = extractive_generator
    regenerate: Callable[[Column, Column], Column] = lambda context, question: extractive_generator(
        context, None, question)
    verify: Callable[[Column, Column], Column] = containment_verifier
    judge: Callable[[Column, Column, Column, Column], Column] = overlap_judge


def offline() -> Providers:
    return Providers(embed=hash_embedder())


# --- real clients -----------------------------------------------------------

def with_retries(call: Callable, attempts: int = fv.JUDGE_ATTEMPTS, base: float = fv.JUDGE_BASE_DELAY,
                 sleep: Callable[[float], None] = time.sleep) -> Callable:
    """Retry with exponential waits and jitter. Tasks may rerun, so calls must be repeatable."""
    def run(*args):
        for attempt in range(attempts):
            try:
                return call(*args)
            except Exception:
                if attempt == attempts - 1:
                    raise
                sleep(base * 2 ** attempt + random.uniform(0, 0.5))
    return run


def client_column(open_client: Callable[[], Callable[[str], str]], prompt: Column) -> Column:
    """Send prompts to a text client; one client per task, one result per row.

    Returns struct<answer, error>: a failing row keeps the fixed apology and
    its error, and never fails the task.
    """
    @F.pandas_udf("struct<answer:string,error:string>")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client = open_client()
        for prompts in batches:
            rows = []
            for p in prompts:
                try:
                    rows.append((client(p), None))
                except Exception as exc:
                    rows.append((fv.ERROR_ANSWER, str(exc)))
            yield pd.DataFrame(rows, columns=["answer", "error"])

    return ask(prompt)


def critic(generate: Callable[[Column], Column], context: Column, draft: Column) -> Column:
    """Second pass: hand the draft and its context back for a rewrite."""
    return generate(fill("CONTEXT:\n{context}\n\nDRAFT:\n{draft}", context=context, draft=draft))


def prompted(embed: Callable[[Column], Column], rerank: Callable[[Column, Column], Column],
             open_reader: Callable, open_verifier: Callable, judge: Callable) -> Providers:
    """Providers around real text clients: prompts in, cleaned answers out.

    ``open_reader`` is called with the generation settings, once per task. A
    drafted row keeps its client's error beside the apology.
    """
    def ask(prompt: Column) -> Column:
        return client_column(lambda: open_reader(fv.GENERATION), prompt)

    def read(prompt: Column) -> Column:
        return bind(ask(prompt), lambda r: F.struct(strip_markup(r["answer"]).alias("answer"), r["error"].alias("error")))

    def verify(chunk: Column, claims: Column) -> Column:
        @F.pandas_udf("array<boolean>")
        def check(chunks: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            client = open_verifier()

            def one(text: str, claim: str):
                try:
                    return client(CLAIM_TEMPLATE.format(chunk=text, claim=claim)).strip().lower().startswith("yes")
                except Exception:
                    return None  # counted as support

            for texts, lists in chunks:
                yield pd.Series([[one(t, c) for c in cs] for t, cs in zip(texts, lists)])

        return check(chunk, claims)

    return Providers(
        embed=embed, rerank=rerank,
        generate=lambda c, h, q: read(fill(GENERATOR_TEMPLATE, context=c, chat_history=h, question=q)),
        regenerate=lambda c, q: strip_markup(ask(fill(RETRY_TEMPLATE, context=c, question=q))["answer"]),
        verify=verify, judge=judge)


JUDGE_TEMPLATE = (
    "Score the answer on faithfulness, relevance, completeness and correctness, each one of 0.0, 0.25, 0.5, 0.75, 1.0, and "
    "give a reason for each as <metric>_reasoning. Reply with one JSON object.\n\nQUESTION: {question}\n\n"
    "EXPECTED: {expected}\n\nANSWER: {answer}\n\nCONTEXT:\n{context}"
)


def client_judge(open_judge: Callable[[], Callable[[str], str]], **retry) -> Callable[[Column, Column, Column, Column], Column]:
    """A judge around a text client, retried with growing waits; a reply that never comes scores as a failure."""
    def judge(question: Column, expected: Column, answer: Column, context: Column) -> Column:
        prompt = fill(JUDGE_TEMPLATE, question=question, expected=expected, answer=answer, context=context)
        return client_column(lambda: with_retries(open_judge(), **retry), prompt)["answer"]
    return judge
