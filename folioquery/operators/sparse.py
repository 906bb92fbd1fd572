"""BM25 over an inverted index held in three small-row tables.

The index is ``postings(doc_id, term, tf, dl)``, ``terms(term, df)`` and the
one-row ``stats``. Postings are built row by row from each text, so building
them moves no text between machines; only term counts are shuffled, after
partial counting in every task. A stored index also holds its postings in
impact-ordered blocks by term (see ``blocks``), from which the best k are found
without scoring everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioquery.functions import fixed_values as fv
from folioquery.functions.text import sparse_tokens, strip
from folioquery.operators import blocks
from folioquery.operators.joins import fits_broadcast, join_small, pick_rows, top_rows
from folioquery.session import materialize

TOKENS_AT_ONCE = 200_000


@dataclass(frozen=True)
class SparseIndex:
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    n_docs: DataFrame
    blocks: DataFrame | None = None

    @cached_property
    def made(self):
        """The one row of totals and parameters."""
        return self.stats.first()

    def write(self, path: str, k1: float = fv.BM25_K1, b: float = fv.BM25_B) -> "SparseIndex":
        """Store the index and return one that reads the stored tables.

        Term counts and totals are derived from the stored postings, so the
        texts are tokenised once. Blocks are ordered by impacts under ``k1`` and ``b``.
        """
        spark = self.postings.sparkSession
        self.postings.write.mode("overwrite").parquet(f"{path}/postings")
        stored = spark.read.parquet(f"{path}/postings")
        n = self.n_docs.first()["n_docs"]
        total = stored.agg(F.sum("tf")).first()[0] or 0
        avgdl = total / n if n else 0.0
        blocks.with_tops(stored, avgdl or 1.0, k1, b).write.mode("overwrite").parquet(f"{path}/terms")
        terms = spark.read.parquet(f"{path}/terms")
        shards = max(blocks.MIN_SHARDS, -(-terms.count() // blocks.TERMS_A_SHARD))
        _stats(stored, terms, self.n_docs).withColumns(
            {"k1": F.lit(k1), "b": F.lit(b), "shards": F.lit(shards)}).write.mode("overwrite").parquet(f"{path}/stats")
        blocks.write_blocks(stored, terms, shards, avgdl or 1.0, k1, b, f"{path}/blocks")
        return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> SparseIndex:
    postings, terms, stats, stored = (spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "stats", "blocks"))
    return SparseIndex(postings, terms, stats, stats.select("n_docs"), stored)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tokens) batches -> one row per document and distinct token.

    Tokens become integer codes; (row, code) pairs of some documents are counted at once,
    so memory follows the longest document and TOKENS_AT_ONCE, not the size of batches.
    """
    for whole in batches:
        sizes = pc.list_value_length(whole.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // TOKENS_AT_ONCE)) + 1), whole.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            batch, lengths = whole.slice(start, end - start), sizes[start:end]
            ids, tokens = batch.column(0), batch.column(1)
            coded = tokens.flatten().dictionary_encode()
            if not len(coded):
                continue
            width = len(coded.dictionary)
            rows = np.repeat(np.arange(batch.num_rows), lengths)
            pairs, times = np.unique(rows * width + coded.indices.to_numpy(), return_counts=True)
            at = pairs // width
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at)), coded.dictionary.take(pa.array(pairs % width)),
                 pa.array(times.astype(np.int64)), pa.array(lengths[at])],
                names=["doc_id", "term", "tf", "dl"])


def build_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) -> (doc_id, term, tf, dl), counted in place, without a shuffle."""
    tokens = docs.select(F.col(id_col).alias("doc_id"), sparse_tokens(F.col(text_col)).alias("tokens"))
    id_type = docs.schema[id_col].dataType.simpleString()
    return tokens.mapInArrow(_count_terms, f"doc_id {id_type}, term string, tf bigint, dl bigint")


def doc_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.size(sparse_tokens(F.col(text_col))).cast("long").alias("dl"))


def _stats(postings: DataFrame, terms: DataFrame, n_docs: DataFrame) -> DataFrame:
    return stats_of(terms, n_docs.scalar(), postings.agg(F.sum("tf").alias("total")).scalar())


def stats_of(terms: DataFrame, n_docs: Column | int, n_tokens: Column | int) -> DataFrame:
    """One row: document count, average length, mean idf over the vocabulary."""
    n, total = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (n_docs, n_tokens))
    idf = F.ln(n - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    return terms.agg(n.alias("n_docs"), (total / n).alias("avgdl"), F.avg(idf).alias("mean_idf"))


def from_postings(postings: DataFrame, n_docs: DataFrame) -> SparseIndex:
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    return SparseIndex(postings, terms, _stats(postings, terms, n_docs), n_docs)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SparseIndex:
    n_docs = docs.agg(F.count("*").alias("n_docs"))
    return from_postings(build_postings(docs, id_col, text_col), n_docs)


def question_terms(questions: DataFrame, id_col: str = "query_id", text_col: str = "question") -> DataFrame:
    """(query_id, term, times): repeated terms count every time they occur."""
    cleaned = strip(F.lower(F.col(text_col)))
    return (
        questions.select(F.col(id_col).alias("query_id"), F.explode(sparse_tokens(cleaned)).alias("term"))
        .groupBy("query_id", "term").agg(F.count("*").alias("times"))
    )


def with_idf(q_terms: DataFrame, index: SparseIndex, small: bool = False) -> DataFrame:
    """Question terms with their idf; negative idf is floored.

    The vocabulary is cut to the questions' terms before anything else, unless
    they were found small enough to be broadcast.
    """
    known = index.terms if small else pick_rows(index.terms, q_terms, "term")
    n = index.stats.select("n_docs").scalar()
    mean_idf = index.stats.select("mean_idf").scalar()
    raw = F.ln(n - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    idf = F.when(raw < 0, F.lit(fv.BM25_EPSILON) * mean_idf).otherwise(raw)
    hot = F.col("df") * 100 > n  # in over a hundredth of all documents
    tops = ["df", "top"] if "top" in known.columns else []
    return known.select("term", idf.alias("idf"), hot.alias("hot"), *tops).join(F.broadcast(q_terms) if small else q_terms, "term")


def bm25_scores(questions: DataFrame, index: SparseIndex, id_col: str = "query_id",
                text_col: str = "question", k1: float = fv.BM25_K1, b: float = fv.BM25_B) -> DataFrame:
    """(query_id, doc_id, score), score rounded to 6 places.

    Postings are first cut to the questions' terms and spread by document, so
    all matches of a document meet in one task: the sum per (question,
    document) then needs no second shuffle, however common a term is.
    """
    q_terms = materialize(with_idf(question_terms(questions, id_col, text_col), index), "question-terms")
    hits = pick_rows(index.postings, q_terms, "term").repartition("doc_id")
    avgdl = index.stats.select("avgdl").scalar()
    norm = F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / avgdl)
    part = F.col("times") * F.col("idf") * (F.col("tf") * F.lit(k1 + 1) / norm)
    return (
        join_small(hits, q_terms, "term", hot="hot", spread="doc_id")
        .select("query_id", "doc_id", part.alias("part"))
        .groupBy("query_id", "doc_id")
        .agg(F.round(F.sum("part"), 6).alias("score"))
    )


def bm25_top(questions: DataFrame, index: SparseIndex, k: int = 2 * fv.TOP_K, k1: float = fv.BM25_K1,
             b: float = fv.BM25_B, id_col: str = "query_id", text_col: str = "question") -> DataFrame:
    """Best k documents per question; ties by document order, scores above 0 only.

    From a stored index with the same parameters, blocks are read as far as
    bounds ask for; otherwise everything that matches is scored. Both are exact.
    """
    made = None if index.blocks is None else index.made
    if made is not None and (made["k1"], made["b"]) == (k1, b):
        q_terms = materialize(question_terms(questions, id_col, text_col), "question-terms")
        if fits_broadcast(q_terms):
            asked = blocks.with_bounds(with_idf(q_terms, index, small=True).drop("hot").toPandas())
            scores = blocks.best_scores(index.blocks, asked, made["shards"], k)
            return top_rows(scores, "query_id", [F.desc("score"), F.asc("doc_id")], k).where(F.col("score") > 0)
    scores = bm25_scores(questions, index, id_col, text_col, k1, b)
    return top_rows(scores, "query_id", [F.desc("score"), F.asc("doc_id")], k).where(F.col("score") > 0)
    scores = bm25_scores(questions, index, id_col, text_col, k1, b)
    return top_rows(scores, "query_id", [F.desc("score"), F.asc("doc_id")], k).where(F.col("score") > 0)
