"""Queries on stored files: what was written is read back, with what is broken in them left out."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioquery.catalog.answers import pipeline_store
from folioquery.catalog.base import query, table
from folioquery.catalog.markdown import REPORT_SQL, orders_with_items, parsed_reports
from folioquery.catalog.retrieval import questions, vectors
from folioquery.operators import parse as ps
from folioquery.plans.ask import answer
from folioquery.providers import offline
from folioquery.session import new_table_path
from folioquery.sources import stores

_BROKEN = ['{"id": "f1_p0", "text": ', "", "   ", "[1, 2]", "not json"]


def _add_broken_lines(spark, path: str) -> None:
    """Lines that no reader may take for rows, in files of their own."""
    spark.createDataFrame([(line,) for line in _BROKEN], "value string").write.mode("append").text(path)


@query("parent_store_file", f"""WITH {REPORT_SQL}
SELECT id, text, refs, content_type, table_row, CASE WHEN content_type = 'table' THEN greatest(table_total - 1, 0) END AS n_siblings FROM chunks""")
def parent_store_file(spark, sf):
    """Parents with the other rows of their tables, as JSON lines among broken ones."""
    path = new_table_path(spark, "parents")
    chunks = parsed_reports(spark, sf).withColumn("n", F.conv(F.substring("pos", 17, 16), 16, 10).cast("long"))
    stores.write_jsonl(ps.parent_store(chunks), path)
    _add_broken_lines(spark, path)
    siblings = F.col("metadata.sibling_ids")
    return stores.read_parents(spark, path).select(
        "id", "text", F.array_join("refs", ",").alias("refs"), "metadata.content_type", "metadata.table_row",
        F.when(siblings.isNotNull(), F.size(siblings)).alias("n_siblings"))


@query("child_store_file", f"""WITH {REPORT_SQL}
SELECT id, page_content, id AS parent_link, source, content_type FROM chunks""")
def child_store_file(spark, sf):
    """Children among lines that are broken, blank or without an id."""
    path = new_table_path(spark, "children")
    stores.write_jsonl(ps.child_store(parsed_reports(spark, sf)), path)
    _add_broken_lines(spark, path)
    return stores.read_children(spark, path).where(F.col("metadata.parent_link").isNotNull()).select(
        "id", "page_content", "metadata.parent_link", "metadata.source", "metadata.content_type")


@query("vector_file", """
SELECT vec_id AS chunk_id, len(embedding) AS dims, embedding[1]::DOUBLE AS first, embedding[-1]::DOUBLE AS last FROM embeddings""")
def vector_file(spark, sf):
    path = new_table_path(spark, "vectors")
    stores.write_vectors(vectors(spark, sf), path)
    v = F.col("vec")
    return stores.read_vectors(spark, path).select("chunk_id", F.size(v).alias("dims"), F.element_at(v, 1).cast("double").alias("first"),
                                                   F.element_at(v, -1).cast("double").alias("last"))


@query("question_files", """
WITH d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT source AS category, 'Texts in ' || source AS intro, pos, CASE WHEN doc_id % 3 = 0 THEN text ELSE 'text ' || doc_id END AS label,
  CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN '' ELSE 'show ' || doc_id END AS prompt, CASE WHEN doc_id % 3 = 1 THEN text ELSE '' END AS answer FROM d""")
def question_files(spark, sf):
    """A question file per source: plain texts, entries with answers, entries with prompts."""
    path = new_table_path(spark, "questions")
    docs = table(spark, sf, "documents").select("source", "doc_id", "text")
    label, number = F.concat(F.lit("text "), F.col("doc_id").cast("string")), F.col("doc_id").cast("string")
    entry = (F.when(F.col("doc_id") % 3 == 0, F.expr("substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)"))
             .when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(label.alias("label"), F.col("text").alias("answer"))))
             .otherwise(F.to_json(F.struct(label.alias("label"), F.concat(F.lit("show "), number).alias("prompt")))))
    last = docs.groupBy("source").agg(F.max("doc_id").alias("doc_id"))
    head = docs.select("source").distinct().select(
        "source", F.lit(-1).cast("long").alias("doc_id"),
        F.concat(F.lit('{"categories": [{"name": "'), "source", F.lit('", "intro": "Texts in '), "source", F.lit('", "questions": [')).alias("value"))
    tail = last.select("source", (F.col("doc_id") + 1).alias("doc_id"), F.lit("]}]}").alias("value"))
    items = docs.join(F.broadcast(last.withColumnRenamed("doc_id", "last")), "source").select(
        "source", "doc_id", F.concat(entry, F.when(F.col("doc_id") == F.col("last"), "").otherwise(",")).alias("value"))
    (head.unionByName(items).unionByName(tail).withColumn("folder", F.col("source")).repartition("folder")
     .sortWithinPartitions("folder", "doc_id").select("folder", "value").write.partitionBy("folder").text(path))
    return stores.resolve_questions(stores.read_question_list(spark, path)).select("category", "intro", "pos", "label", "prompt", "answer")


@query("eval_trace", """
SELECT event_id AS index, event_type AS category, props AS generated_answer, 'ctx' AS retrieved_context FROM events""")
def eval_trace(spark, sf):
    """The full trace as it was written, long text columns included."""
    path = new_table_path(spark, "trace")
    events = table(spark, sf, "events").select(
        F.col("event_id").alias("index"), F.col("event_type").alias("category"), F.col("props").alias("generated_answer"),
        F.lit("ctx").alias("retrieved_context"))
    stores.write_eval(events, f"{path}/trace", f"{path}/metrics")
    return spark.read.schema(events.schema).json(f"{path}/trace")


@query("direct_answers", """
SELECT item_id AS query_id, text AS question, 'LOW' AS risk_level, false AS checked, false AS retried, 'See item ' || item_id || '.' AS answer FROM benchmark""")
def direct_answers(spark, sf):
    """Questions that carry their answer are served as they are."""
    direct = F.concat(F.lit("  See item "), F.col("query_id").cast("string"), F.lit(".\n"))
    asked = questions(spark, sf).withColumn("direct_answer", direct)
    return answer(asked, pipeline_store(spark, sf), offline()).select("query_id", "question", "risk_level", "checked", "retried", "answer")


@query("bold_captions", """
WITH items AS (SELECT l_orderkey AS k, l_linenumber AS no, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r,
    count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem),
o AS (SELECT o_orderkey AS k, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS m FROM orders)
SELECT k AS file_id, 'f' || k || '_p0' AS id, 'prose' AS content_type, '' AS section,
  'Document: Unknown Framework' || chr(10) || 'Chapter: Global Context' || chr(10) || 'Content: These are the items of order ' || k || ' as they were sent.' AS text FROM o
UNION ALL SELECT k, 'f' || k || '_t1_r' || r, 'table', 'Table 2: Items of order ' || k,
  'Document: Unknown Framework | Chapter: Global Context | Table: Table 2: Items of order ' || k || ' | Line: ' || no || ' | Part: ' || part FROM items
UNION ALL SELECT k, 'f' || k || '_fig' || (m + 1), 'figure', 'Figure 3: Route of order ' || k,
  'Document: Unknown Framework | Chapter: Global Context | Visual Element: Figure 3: Route of order ' || k || ' | Details: A map of order ' || k
    || ' **Table 4: no table, as a figure goes on**' FROM o""")
def bold_captions(spark, sf):
    """Tables and figures that open with a bold caption instead of a heading."""
    line = F.concat(F.lit("|"), F.col("l_linenumber").cast("string"), F.lit("|"), F.col("l_partkey").cast("string"), F.lit("|\n"))
    orders = orders_with_items(spark, sf, no=F.col("l_linenumber"), part=F.col("l_partkey"), line=line)
    k, rows = F.col("o_orderkey").cast("string"), F.coalesce(F.array_join(F.transform("rows", lambda r: r["line"]), ""), F.lit(""))
    value = F.concat(F.lit("These are the items of order "), k, F.lit(" as they were sent.\n\n**Table 2: Items of order "), k, F.lit("**\n|Line|Part|\n|---|---|\n"),
                     rows, F.lit("**Figure 3: Route of order "), k, F.lit("**\nA map of order "), k, F.lit("\n**Table 4: no table, as a figure goes on**\n"))
    chunks = ps.parse_chunks(orders.select(F.col("o_orderkey").alias("file_id"), value.alias("value")))
    return chunks.select("file_id", "id", "metadata.content_type", "metadata.section", "text")
