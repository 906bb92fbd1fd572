"""Queries on tokens, sparse and dense retrieval, fusion and re-ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioquery.catalog.base import (
    BM25_SQL, COSINE_SQL, DOT_SQL, L2_SQL, knn_sql, query, sql_jaccard, sql_set, sql_tokens, table)
from folioquery.functions.text import jaccard, set_tokens, sparse_tokens
from folioquery.operators import dense as dn, evaluate as ev, fuse, sparse as sp
from folioquery.operators.context import parent_lookup
from folioquery.operators.joins import pick_rows
from folioquery.plans.update import LiveIndex
from folioquery.providers import overlap_reranker
from folioquery.session import materialize, new_table_path

_BUILT: dict[tuple[str, str], sp.SparseIndex] = {}


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def stored_index(spark: SparkSession, sf: str) -> sp.SparseIndex:
    """The inverted index over all documents, written once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUILT:
        _BUILT[key] = sp.build_index(table(spark, sf, "documents")).write(new_table_path(spark, "index"))
    return _BUILT[key]


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))


def question_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """By convention question i is represented by vector i."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("chunk_id"))
    return pick_rows(vectors(spark, sf), items, "chunk_id").withColumnRenamed("chunk_id", "query_id")


@query("tokens_bm25", f"""
SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms, md5(array_to_string(t, ' ')) AS digest
FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)""")
def tokens_bm25(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", sparse_tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"),
                       F.size(F.array_distinct("t")).cast("long").alias("n_terms"),
                       F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query("tokens_set", f"""
SELECT doc_id, len({sql_set('text')}) AS n_tokens, md5(array_to_string(list_sort({sql_set('text')}), ' ')) AS digest
FROM documents""")
def tokens_set(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sort_array(set_tokens(F.col("text"))).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"),
                       F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query("term_df", f"""
WITH t AS (SELECT DISTINCT doc_id, unnest({sql_tokens('text')}) AS term FROM documents)
SELECT term, count(*) AS df FROM t GROUP BY term""")
def term_df(spark, sf):
    return sp.build_index(table(spark, sf, "documents")).terms


@query("postings", f"""
SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (
  SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents))
GROUP BY doc_id, term""")
def postings(spark, sf):
    return sp.build_postings(table(spark, sf, "documents"))


@query("doc_len_stats", f"""
WITH {BM25_SQL}
SELECT n::BIGINT AS n_docs, round(avgdl, 6) AS avgdl, round((SELECT avg(idf) FROM raw), 6) AS mean_idf FROM tot""")
def doc_len_stats(spark, sf):
    stats = stored_index(spark, sf).stats
    return stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"), F.round("mean_idf", 6).alias("mean_idf"))


@query("bm25_top12", f"WITH {BM25_SQL} SELECT query_id, doc_id, score, rank FROM bm25")
def bm25_top12(spark, sf):
    return sp.bm25_top(questions(spark, sf), stored_index(spark, sf))


def _changed_index(spark, sf) -> LiveIndex:
    """All documents, by way of changes.

    First come older texts of a third of them and documents that are no more;
    then the texts of today and the rest; last the deletions.
    """
    docs = table(spark, sf, "documents").select("doc_id", "text")
    old = F.col("doc_id") % 3 == 0
    live = LiveIndex(spark, new_table_path(spark, "live-index"))
    nobody = docs.select(F.col("doc_id").alias("key")).limit(0)
    extinct = docs.where(F.col("doc_id") % 5 == 0).select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    live.change(docs.where(F.col("doc_id") % 2 == 0).select("doc_id", F.when(old, F.concat(F.lit("older version "), F.reverse("text")))
                                                            .otherwise(F.col("text")).alias("text")).unionByName(extinct), nobody)
    live.change(docs.where(old | (F.col("doc_id") % 2 != 0)), nobody)
    live.change(docs.limit(0), extinct.select(F.col("doc_id").alias("key")))
    return live


@query("changed_postings", """
SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (
  SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM (SELECT doc_id, """ + sql_tokens("text") + """ AS t FROM documents))
GROUP BY doc_id, term""")
def changed_postings(spark, sf):
    """After changes and compaction."""
    live = _changed_index(spark, sf)
    live.compact()
    return live.open().postings


@query("changed_top12", f"WITH {BM25_SQL} SELECT query_id, doc_id, score, rank FROM bm25")
def changed_top12(spark, sf):
    """Retrieval from an index that was changed three times equals that from one built anew."""
    return sp.bm25_top(questions(spark, sf), _changed_index(spark, sf).open())


def _knn(metric):
    def run(spark, sf):
        return dn.knn(question_vectors(spark, sf), vectors(spark, sf), metric=metric)
    return run


for _name, _metric, _expr, _order in (("knn_l2", "l2", L2_SQL, "ASC"), ("knn_cosine", "cosine", COSINE_SQL, "DESC"),
                                      ("knn_dot", "dot", DOT_SQL, "DESC")):
    query(_name, f"WITH {knn_sql(_expr, _order)} SELECT query_id, chunk_id, score, rank FROM dense")(_knn(_metric))


@query("knn_l2_grid", f"WITH {knn_sql(L2_SQL, 'ASC')} SELECT query_id, chunk_id, score, rank FROM dense")
def knn_l2_grid(spark, sf):
    """The plan for question sets too large to ship to every task."""
    return dn.knn(question_vectors(spark, sf), vectors(spark, sf), max_shipped=8)


@query("normalize_vectors", """
SELECT vec_id, unnest(range(len(v))) AS dim, unnest(list_transform(v, lambda x: round(x / n, 6))) AS x, round(n, 6) AS norm
FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n
      FROM embeddings)""")
def normalize_vectors(spark, sf):
    v = F.col("vec")
    return vectors(spark, sf).select(
        F.col("chunk_id").alias("vec_id"), F.posexplode(dn.normalize(v)).alias("dim", "x"),
        F.round(dn.vector_norm(v), 6).alias("norm")).withColumn("x", F.round("x", 6))


# --- fusion -----------------------------------------------------------------

RRF_SQL = f"""{BM25_SQL}, {knn_sql(L2_SQL, 'ASC')},
both_lists AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_id, s.doc_id) AS chunk_id,
    d.rank AS dense_rank, s.rank AS sparse_rank,
    round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 12) AS rrf
  FROM dense d FULL JOIN bm25 s ON d.query_id = s.query_id AND d.chunk_id = s.doc_id),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY rrf DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) AS rrf_rank FROM both_lists) WHERE rrf_rank <= 10)
"""


def fused(spark, sf) -> DataFrame:
    dense = dn.knn(question_vectors(spark, sf), vectors(spark, sf))
    sparse = sp.bm25_top(questions(spark, sf), stored_index(spark, sf)).withColumnRenamed("doc_id", "chunk_id")
    return fuse.rrf(dense, sparse)


@query("rrf_fusion", f"WITH {RRF_SQL} SELECT query_id, chunk_id, dense_rank, sparse_rank, rrf, rrf_rank FROM fused")
def rrf_fusion(spark, sf):
    return fused(spark, sf)


_OVERLAP_SQL = (f"(CASE WHEN len({sql_set('b.text')}) > 0 THEN round(len(list_intersect({sql_set('b.text')}, "
                f"{sql_set('d.text')})) / len({sql_set('b.text')}), 6) ELSE 0.0 END)")
RERANK_SQL = f"""{RRF_SQL},
cand AS (SELECT f.query_id, f.chunk_id, f.rrf_rank, d.text, d.lang, d.source, b.text AS question,
         {_OVERLAP_SQL} AS rerank_score
         FROM fused f JOIN documents d ON d.doc_id = f.chunk_id JOIN benchmark b ON b.item_id = f.query_id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rrf_rank) AS hit
         FROM cand) WHERE hit <= 6)
"""


def reranked(spark, sf) -> DataFrame:
    """Top 6 documents per question with their text."""
    pool = materialize(fused(spark, sf), "pool")
    docs = table(spark, sf, "documents").withColumnRenamed("doc_id", "chunk_id")
    texts = pick_rows(docs, pool, "chunk_id").select("chunk_id", "text", "lang", "source")
    candidates = pool.join(texts, "chunk_id").join(questions(spark, sf), "query_id")
    return fuse.rerank(candidates, overlap_reranker(F.col("question"), F.col("text")))


@query("rerank_lexical", f"WITH {RERANK_SQL} SELECT query_id, chunk_id, rrf_rank, rerank_score, hit FROM hits")
def rerank_lexical(spark, sf):
    return reranked(spark, sf).select("query_id", "chunk_id", "rrf_rank", "rerank_score", "hit")


@query("chapter_cap", f"""WITH {RERANK_SQL}
SELECT query_id, chunk_id, source, hit FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY hit) AS r FROM hits) WHERE r <= 1""")
def chapter_cap(spark, sf):
    return fuse.chapter_cap(reranked(spark, sf), 1, key="source").select("query_id", "chunk_id", "source", "hit")


@query("parent_lookup", f"""WITH {RERANK_SQL}
SELECT h.query_id, h.hit, h.chunk_id::VARCHAR AS chunk_id,
  CASE WHEN l.doc_id IS NOT NULL THEN 'quality ' || l.quality ELSE h.text END AS text,
  CASE WHEN l.doc_id IS NOT NULL THEN 'label' ELSE h.source END AS source_title,
  CASE WHEN l.doc_id IS NOT NULL THEN 'toxic ' || l.toxic ELSE '' END AS chapter,
  CASE WHEN l.doc_id IS NOT NULL THEN 'list' ELSE 'prose' END AS content_type
FROM hits h LEFT JOIN labels l ON l.doc_id = h.chunk_id""")
def parent_lookup_query(spark, sf):
    """Labels stand for parents, so some hits have none and fall back."""
    hits = materialize(reranked(spark, sf).select(
        "query_id", "hit", F.col("chunk_id").cast("string").alias("chunk_id"),
        F.col("text").alias("page_content"), "source", F.lit("prose").alias("content_type")), "hits")
    none = F.lit(None)
    parents = table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("text"),
        F.struct(F.lit("label").alias("source"), F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("chapter"),
                 none.cast("string").alias("section"), F.lit("list").alias("content_type"),
                 none.cast("string").alias("table_id"), none.cast("int").alias("table_total")).alias("metadata"),
        none.cast("string").alias("prev_id"), none.cast("string").alias("next_id"))
    return parent_lookup(hits, parents).select(
        "query_id", "hit", "chunk_id", "text", "source_title", "chapter", "content_type")


@query("wiring_check", f"""WITH {knn_sql(L2_SQL, 'ASC')}, hits AS (SELECT * FROM dense WHERE rank <= 10)
SELECT count(*) AS n_hits, count(l.doc_id) AS n_resolved, count(*) - count(l.doc_id) AS n_missing,
  count_if(l.toxic = 1) AS n_no_table_id
FROM hits LEFT JOIN labels l ON l.doc_id = chunk_id""")
def wiring_check(spark, sf):
    """k = 10 hits against labels as parents; toxic ones play rows without a table id."""
    hits = dn.knn(question_vectors(spark, sf), vectors(spark, sf), 10).withColumn("content_type", F.lit("table"))
    parents = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.struct(
        F.when(F.col("toxic") == 0, "t").alias("table_id")).alias("metadata"))
    return ev.wiring_check(hits, parents)


@query("jaccard_hit", f"""WITH {BM25_SQL},
pairs AS (SELECT q.query_id, {sql_jaccard(sql_set('e.source'), sql_set('d.source'))} AS sim
  FROM bm25 q JOIN documents d USING (doc_id) JOIN documents e ON e.doc_id = q.query_id)
SELECT item_id AS query_id, coalesce(bool_or(sim >= 0.4), false) AS hit, round(coalesce(max(sim), 0), 6) AS best
FROM benchmark LEFT JOIN pairs ON query_id = item_id GROUP BY item_id""")
def jaccard_hit(spark, sf):
    """Sources are titles: document i's is expected of question i, and met in its top 12 documents."""
    ranked = materialize(sp.bm25_top(questions(spark, sf), stored_index(spark, sf)), "ranked")
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"))
    found = ranked.join(pick_rows(docs, ranked, "doc_id"), "doc_id") \
                  .groupBy("query_id").agg(F.collect_list("title").alias("retrieved"))  # 12 at most
    asked = questions(spark, sf).join(docs.withColumnRenamed("doc_id", "query_id"), "query_id", "left") \
        .withColumn("expected", F.array("title")).join(found, "query_id", "left")
    best = F.array_max(F.transform("retrieved", lambda r: jaccard(
        set_tokens(F.get("expected", 0)), set_tokens(r))))
    return asked.select("query_id", F.coalesce(ev.retrieval_hit(F.col("expected"), F.col("retrieved")), F.lit(False)).alias("hit"),
                        F.round(F.coalesce(best, F.lit(0.0)), 6).alias("best"))
