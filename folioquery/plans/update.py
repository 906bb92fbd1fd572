"""Stores that take changes: documents are added, replaced and deleted without a rebuild.

A change parses, embeds and indexes the changed documents only. Term counts
and totals are kept as differences: what a change adds, less what the replaced and deleted
documents had. So the index after any changes equals one built anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioquery.operators.joins import pick_rows
from folioquery.operators.parse import ParseOptions
from folioquery.operators.sparse import SparseIndex, build_postings, doc_lengths, stats_of
from folioquery.plans.build import Store, file_of, numbered_chunks
from folioquery.providers import Providers
from folioquery.session import materialize
from folioquery.sources.segments import KEY, Segments


def _added_up(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.sum("df").alias("df")).where("df != 0")


class LiveIndex:
    """An inverted index of texts (doc_id, text) that changes by document.

    ``key_of`` gives the key by which a text is replaced; several texts may share one.
    """

    tables = ["postings", "lengths"]

    def __init__(self, spark: SparkSession, path: str, key_of: Callable[[Column], Column] = lambda doc_id: doc_id):
        self.segments, self.key_of = Segments(spark, path), key_of

    def change(self, texts: DataFrame, gone: DataFrame, more: dict[str, DataFrame] | None = None) -> None:
        """``texts(doc_id, text)`` replace what their keys had; ``gone(key)`` are keys of others to drop.

        ``more`` has rows of further tables, each with ``key``.
        """
        seg, number = self.segments, self.segments.next()
        key = self.key_of(F.col("doc_id")).alias(KEY)
        touched = seg.write(number, "gone", texts.select(key).unionByName(gone.select(KEY)).distinct())
        postings = seg.write(number, "postings", build_postings(texts).withColumn(KEY, self.key_of(F.col("doc_id"))))
        lengths = seg.write(number, "lengths", doc_lengths(texts).withColumn(KEY, self.key_of(F.col("doc_id"))))
        for name, rows in (more or {}).items():
            seg.write(number, name, rows)
        counts = postings.groupBy("term").agg(F.count("*").alias("df"))
        before = (0, 0)
        if number:
            lost = pick_rows(seg.table("postings"), touched, KEY).groupBy("term").agg((-F.count("*")).alias("df"))
            counts = counts.unionByName(lost)
            before = self._size(pick_rows(seg.table("lengths"), touched, KEY))
        seg.write(number, "counts", _added_up(counts))
        now = self._size(lengths)
        seg.commit(number, {"docs": now[0] - before[0], "tokens": now[1] - before[1]}, base=number == 0)

    @staticmethod
    def _size(lengths: DataFrame) -> tuple[int, int]:
        row = lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
        return row["n"], row["tokens"]

    def compact(self) -> None:
        self.segments.compact(self.tables, {"counts": _added_up})

    def open(self) -> SparseIndex:
        """The index as it stands. It has no blocks; ``SparseIndex.write`` makes them where reading outweighs changing."""
        totals = self.segments.totals()
        terms = _added_up(self.segments.every("counts"))
        stats = stats_of(terms, totals["docs"], totals["tokens"])
        return SparseIndex(self.segments.table("postings").drop(KEY), terms, stats, stats.select("n_docs"))


class LiveStore(LiveIndex):
    """Chunks, vectors and index of documents (file_id, value) that change by file."""

    tables = ["postings", "lengths", "chunks", "vectors"]

    def __init__(self, spark: SparkSession, path: str, providers: Providers, options: ParseOptions = ParseOptions()):
        super().__init__(spark, path, file_of)
        self.providers, self.options = providers, options

    def upsert(self, docs: DataFrame, deleted: DataFrame | None = None) -> None:
        """``docs`` replace files of the same ids; ``deleted(file_id)`` go. A file that holds no chunk any more goes too."""
        chunks = materialize(numbered_chunks(docs, self.options).withColumn(KEY, file_of(F.col("pos"))), "changed-chunks")
        vectors = chunks.select(F.col("pos").alias("chunk_id"), self.providers.embed(F.col("page_content")).alias("vec"), KEY)
        gone = docs.select(F.col("file_id").alias(KEY))
        if deleted is not None:
            gone = gone.unionByName(deleted.select(F.col("file_id").alias(KEY)))
        self.change(chunks.select(F.col("pos").alias("doc_id"), F.col("page_content").alias("text")), gone,
                    {"chunks": chunks, "vectors": vectors})

    def store(self) -> Store:
        return Store(self.segments.table("chunks").drop(KEY), self.segments.table("vectors").drop(KEY), self.open())
