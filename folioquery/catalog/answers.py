"""Queries on context, memory, classification, verification and answering."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioquery.calls import ask_once
from folioquery.catalog.base import BM25_SQL, query, sql_sentences, sql_set, sql_strip, table
from folioquery.catalog.markdown import REPORT_SQL, documents, stored_reports
from folioquery.catalog.retrieval import questions, stored_index
from folioquery.functions import fixed_values as fv, text as tx
from folioquery.operators import context as cx, memory as mm, sparse as sp, verify as vf
from folioquery.operators.joins import pick_rows, top_rows
from folioquery.plans.ask import answer
from folioquery.plans.build import Store, build_store, file_of
from folioquery.plans.diagnose import explain_questions
from folioquery.plans.telemetry import Counters
from folioquery.providers import containment_verifier, fill, offline, with_retries
from folioquery.session import materialize, new_table_path
from folioquery.sources.stores import backend_query, resolve_questions

# --- context ----------------------------------------------------------------

# Six hits per report, drawn from its table rows in a fixed shuffled order, so
# neighbours and later hits collide all the time.
CONTEXT_SQL = f"""{REPORT_SQL},
rows_ AS (SELECT file_id, id, text, prev_id, next_id, table_total FROM chunks WHERE content_type = 'table'),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY md5(id)) AS hit FROM rows_) WHERE hit <= 6),
full_hits AS (SELECT h.*, p.text AS prev_text, x.text AS next_text FROM hits h
  LEFT JOIN rows_ p ON p.id = h.prev_id LEFT JOIN rows_ x ON x.id = h.next_id),
walk AS (
  SELECT file_id, 0 AS step, []::VARCHAR[] AS seen, []::VARCHAR[] AS parts, 0 AS n_sources FROM (SELECT DISTINCT file_id FROM hits)
  UNION ALL
  SELECT file_id, step, CASE WHEN take_next THEN list_append(seen2, next_id) ELSE seen2 END,
    CASE WHEN take_next THEN list_append(parts2, '  [table context — adjacent row]' || chr(10) || next_text) ELSE parts2 END, n_sources
  FROM (SELECT *, fresh AND next_id IS NOT NULL AND NOT list_contains(seen2, next_id) AS take_next FROM
   (SELECT *, CASE WHEN take_prev THEN list_append(seen1, prev_id) ELSE seen1 END AS seen2,
      CASE WHEN take_prev THEN list_append(parts1, '  [table context — adjacent row]' || chr(10) || prev_text) ELSE parts1 END AS parts2 FROM
    (SELECT *, fresh AND prev_id IS NOT NULL AND NOT list_contains(seen1, prev_id) AS take_prev FROM
     (SELECT *, CASE WHEN fresh THEN list_append(seen, id) ELSE seen END AS seen1,
        CASE WHEN fresh THEN list_append(parts, '--- Source: Order ' || file_id || ' | Overview > Table 1: Items of order ' || file_id
          || ' ---' || chr(10) || text) ELSE parts END AS parts1 FROM
      (SELECT w.file_id, w.step + 1 AS step, w.seen, w.parts, h.id, h.text, h.prev_id, h.next_id, h.prev_text, h.next_text,
         NOT list_contains(w.seen, h.id) AS fresh, w.n_sources + CASE WHEN list_contains(w.seen, h.id) THEN 0 ELSE 1 END AS n_sources
       FROM walk w JOIN full_hits h ON h.file_id = w.file_id AND h.hit = w.step + 1))))))
"""


def report_contexts(spark, sf) -> DataFrame:
    chunks = stored_reports(spark, sf)
    rows = chunks.where(F.col("metadata.content_type") == "table").select(
        file_of(F.col("pos")).alias("query_id"), F.col("id").alias("chunk_id"), "page_content",
        F.col("metadata.source").alias("source"), F.lit("table").alias("content_type"))
    hits = materialize(top_rows(rows, "query_id", [F.md5(F.col("chunk_id").cast("binary"))], 6, rank="hit"), "hits")
    return cx.build_context(hits, chunks.select("id", "text", "metadata", "prev_id", "next_id"))


@query("context_assemble", f"""WITH RECURSIVE {CONTEXT_SQL}
SELECT file_id AS query_id, array_to_string(parts, chr(10) || chr(10)) AS context, n_sources, len(seen) AS n_used
FROM walk WHERE step = (SELECT max(hit) FROM hits WHERE hits.file_id = walk.file_id)""")
def context_assemble(spark, sf):
    return report_contexts(spark, sf).select(
        "query_id", "context", F.size("sources").alias("n_sources"), F.size("used_ids").alias("n_used"))


@query("citations", f"""WITH RECURSIVE {CONTEXT_SQL},
done AS (SELECT file_id, n_sources, (SELECT any_value(table_total) FROM rows_ WHERE rows_.file_id = walk.file_id) AS total
  FROM walk WHERE step = (SELECT max(hit) FROM hits WHERE hits.file_id = walk.file_id))
SELECT file_id AS query_id, chr(10) || chr(10) || 'Sources:' || chr(10) || string_agg('[' || i || '] Order ' || file_id || ' | Overview (TABLE)'
  || CASE WHEN total > 1 THEN chr(10) || '    Table: Table 1: Items of order ' || file_id || '  (' || total || ' rows total)' ELSE '' END,
  chr(10) ORDER BY i) AS citations
FROM (SELECT *, unnest(range(1, n_sources + 1)) AS i FROM done) GROUP BY file_id, total""")
def citations(spark, sf):
    return report_contexts(spark, sf).select("query_id", cx.citation_lines(F.col("sources")).alias("citations"))


@query("neighbor_expand", f"""WITH {REPORT_SQL}
SELECT id, lag(text) OVER (PARTITION BY file_id ORDER BY n) AS prev_text, lead(text) OVER (PARTITION BY file_id ORDER BY n) AS next_text
FROM chunks WHERE content_type = 'table'""")
def neighbor_expand(spark, sf):
    """Neighbours of every table row, each row a hit of its own."""
    chunks = stored_reports(spark, sf).select("id", "text", "metadata.content_type", "prev_id", "next_id")
    rows = chunks.where(F.col("content_type") == "table").select(
        F.col("id").alias("query_id"), F.lit(1).alias("hit"), "content_type", "prev_id", "next_id")
    of = lambda c: F.get(F.filter("neighbors", lambda n: n["id"] == F.col(c)), 0)["text"]
    return cx.with_neighbors(rows, chunks).select(
        F.col("query_id").alias("id"), of("prev_id").alias("prev_text"), of("next_id").alias("next_text"))


_BLOCKS = "--- Source: NIST AI 100-{c} ---\nFirst block of {k}.\nMore.\n\n--- Source: B | X ---\n Second block of {k}. \n\n"


def _order_text(template: str):
    return fill(template, k=F.col("o_orderkey").cast("string"), c=F.col("o_custkey").cast("string"))


@query("top_chunk", """
SELECT o_orderkey AS k, 'Second block of ' || o_orderkey || '.' AS compat,
  'First block of ' || o_orderkey || '.' || chr(10) || 'More.' AS fixed, '--- Source: One ---' || chr(10) || 'Only ' || o_orderkey AS single,
  'NIST AI 100-' || o_custkey AS short FROM orders""")
def top_chunk(spark, sf):
    two, one = _order_text(_BLOCKS), _order_text("--- Source: One ---\nOnly {k}")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), cx.top_chunk(two).alias("compat"), cx.top_chunk(two, False).alias("fixed"),
        cx.top_chunk(one).alias("single"),
        tx.short_source(_order_text("NIST AI 100-{c}e2023 Report")).alias("short"))


@query("section_context", f"""WITH {BM25_SQL}, h AS (SELECT * FROM bm25 JOIN documents USING (doc_id) WHERE rank <= 3)
SELECT query_id, string_agg('--- Section: ' || CASE WHEN lang = 'en' THEN 'General' ELSE lang END || ' ---' || chr(10) || text,
  chr(10) || chr(10) ORDER BY rank) AS context, string_agg(left(text, 150) || '...', ' / ' ORDER BY rank) AS previews FROM h GROUP BY query_id""")
def section_context(spark, sf):
    """The older assembler over three hits; languages stand for sections."""
    ranked = materialize(sp.bm25_top(questions(spark, sf), stored_index(spark, sf), 3), "ranked")
    docs = pick_rows(table(spark, sf, "documents"), ranked, "doc_id")
    hits = ranked.join(docs, "doc_id").select(
        "query_id", F.col("rank").alias("hit"), F.col("text").alias("page_content"),
        F.when(F.col("lang") != "en", F.col("lang")).alias("section"), F.lit(None).cast("string").alias("sub_section"))
    return cx.section_context(hits).select("query_id", "context", F.array_join(
        F.transform("sources", lambda s: s["preview"]), " / ").alias("previews"))


# --- memory -----------------------------------------------------------------

HISTORY_SQL = """
turns AS (SELECT u.conv_id, u.turn, 'Human: ' || u.text || chr(10) || 'Assistant: ' || a.text AS line
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
kept AS (SELECT * FROM (SELECT *, sum(length(line)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM turns) WHERE used <= 1000),
convs AS (SELECT DISTINCT conv_id FROM conversations)
"""


def _turns(spark, sf):
    messages = table(spark, sf, "conversations")
    return mm.turns_from_messages(messages), messages.select("conv_id").distinct()


@query("history_window_1000", f"""WITH {HISTORY_SQL}, t AS (SELECT conv_id, string_agg(line, chr(10) || chr(10) ORDER BY turn) AS history FROM kept GROUP BY conv_id)
SELECT conv_id, CASE WHEN history IS NOT NULL THEN history WHEN conv_id IN (SELECT conv_id FROM turns) THEN ''
  ELSE 'No previous conversation.' END AS history FROM convs LEFT JOIN t USING (conv_id)""")
def history_window(spark, sf):
    return mm.history_text(*_turns(spark, sf), 1000)


@query("history_last5", f"""WITH {HISTORY_SQL}, t AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS history FROM
  (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM turns) WHERE age <= 5 GROUP BY conv_id)
SELECT conv_id, coalesce(history, 'No previous conversation.') AS history FROM convs LEFT JOIN t USING (conv_id)""")
def history_last5(spark, sf):
    return mm.last_turns(*_turns(spark, sf), 5)


@query("history_append", f"""WITH {HISTORY_SQL}
SELECT conv_id, turn, line FROM turns UNION ALL
SELECT item_id, coalesce((SELECT max(turn) FROM turns WHERE conv_id = item_id), -1) + 1, 'Human: ' || text || chr(10) || 'Assistant: ok' FROM benchmark""")
def history_append(spark, sf):
    """Question i is appended to conversation i."""
    new = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.col("text").alias("human"),
        F.lit("ok").alias("assistant"))
    return mm.append_turns(_turns(spark, sf)[0], new).select("conv_id", "turn", mm.turn_text().alias("line"))


@query("history_clear", f"""WITH {HISTORY_SQL}
SELECT conv_id, turn, line FROM turns WHERE conv_id NOT IN (SELECT item_id FROM benchmark)""")
def history_clear(spark, sf):
    cleared = table(spark, sf, "benchmark").select(F.col("item_id").alias("conv_id"))
    return mm.clear_conversations(_turns(spark, sf)[0], cleared).select("conv_id", "turn", mm.turn_text().alias("line"))


# --- questions and answers --------------------------------------------------

_BY_PRIORITY = {
    "1-URGENT": "What are the {c} items of order {k}?",
    "2-HIGH": "Which supplier ANSWERS for order {k}?",
    "3-MEDIUM": "list  the parts of order {k}",
    "4-NOT SPECIFIED": "Give me some examples of parts like {k}",
    "5-LOW": "Where is order {k}?",
}


def order_questions(spark, sf) -> DataFrame:
    """(query_id, question, status): one question per order."""
    asked = F.lit(None).cast("string")
    for priority, template in _BY_PRIORITY.items():
        asked = F.when(F.col("o_orderpriority") == priority, _order_text(template)).otherwise(asked)
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("query_id"), asked.alias("question"), F.col("o_orderstatus").alias("status"))


@query("risk_class", """
SELECT o_orderkey AS query_id, CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'HIGH' ELSE 'LOW' END AS core,
  CASE WHEN o_orderpriority[1] IN ('1', '2', '4') THEN 'HIGH' ELSE 'LOW' END AS ui,
  o_orderpriority[1] IN ('1', '3') AS core_list, o_orderpriority[1] IN ('1', '3', '4') AS ui_list,
  CASE o_orderpriority[1] WHEN '1' THEN 4 WHEN '2' THEN 1 WHEN '4' THEN 9 END AS first_pattern FROM orders""")
def risk_class(spark, sf):
    q = F.col("question")
    return order_questions(spark, sf).select(
        "query_id", tx.risk_class(q).alias("core"), tx.risk_class(q, "ui").alias("ui"),
        tx.is_list_question(q).alias("core_list"), tx.is_list_question(q, "ui").alias("ui_list"),
        tx.matched_pattern(q, fv.RISK_PATTERNS["ui"]).alias("first_pattern"))


def _regex_any(col: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches(lower({col}), '{p}')" for p in patterns) + ")"


@query("risk_messages", f"""
SELECT conv_id, turn, CASE WHEN {_regex_any('text', fv.RISK_PATTERNS['ui'])} THEN 'HIGH' ELSE 'LOW' END AS risk,
  {_regex_any('text', fv.LIST_PATTERNS['ui'])} AS is_list FROM conversations""")
def risk_messages(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.risk_class(F.col("text"), "ui").alias("risk"),
        tx.is_list_question(F.col("text"), "ui").alias("is_list"))


@query("claim_vote", f"""WITH {BM25_SQL},
d AS (SELECT query_id, b.text AS draft, d.text AS chunk FROM bm25 JOIN documents d USING (doc_id) JOIN benchmark b ON item_id = query_id WHERE rank = 1),
c AS (SELECT query_id, chunk, unnest({sql_sentences('draft')}) AS claim FROM d),
v AS (SELECT query_id, 2 * len(list_intersect({sql_set('claim')}, {sql_set('chunk')})) >= len({sql_set('claim')}) AS ok FROM c)
SELECT query_id, count_if(ok) AS supported, count_if(NOT ok) AS against, count_if(ok) >= count_if(NOT ok) AS faithful
FROM d LEFT JOIN v USING (query_id) GROUP BY query_id""")
def claim_vote(spark, sf):
    """Question texts as drafts, checked against their best document."""
    ranked = materialize(sp.bm25_top(questions(spark, sf), stored_index(spark, sf), 1), "ranked")
    docs = pick_rows(table(spark, sf, "documents"), ranked, "doc_id").select("doc_id", F.col("text").alias("chunk"))
    drafts = ranked.join(docs, "doc_id").join(questions(spark, sf), "query_id")
    checked = drafts.withColumn("verdicts", containment_verifier(F.col("chunk"), tx.sentences(F.col("question"))))
    supported, against = vf.claim_counts(F.col("verdicts"))
    return checked.select("query_id", supported.alias("supported"), against.alias("against"),
                          vf.majority(F.col("verdicts")).alias("faithful"))


@query("retry_route", """
SELECT o_orderkey AS query_id, CASE WHEN high THEN 'HIGH' ELSE 'LOW' END AS risk_level, high AS checked,
  CASE WHEN high THEN o_orderstatus <> 'P' END AS faithful, high AND o_orderstatus = 'P' AS retried,
  CASE WHEN high AND o_orderstatus = 'P' THEN 'Again ' || o_orderkey WHEN o_orderstatus = 'P' THEN 'Zebras fly. Pigs too.'
    WHEN o_orderstatus = 'F' THEN 'Second block. Zebras fly.' ELSE 'Second block of ' || o_orderkey || '.' END
  || CASE WHEN o_orderpriority[1] IN ('1', '3') THEN chr(10) || chr(10) ||
    'Note: This list may be incomplete. Refer to the original NIST source document for the full list.' ELSE '' END AS answer
FROM (SELECT *, o_orderpriority[1] IN ('1', '2') AS high FROM orders)""")
def retry_route(spark, sf):
    """Drafts supported, half supported or unsupported by order status."""
    key = F.col("query_id").cast("string")
    context = fill(_BLOCKS, k=key, c=key)
    draft = (F.when(F.col("status") == "P", "Zebras fly. Pigs too.").when(F.col("status") == "F", "Second block. Zebras fly.")
             .otherwise(F.concat(F.lit("Second block of "), key, F.lit("."))))
    drafts = order_questions(spark, sf).select("query_id", "question", context.alias("context"), draft.alias("draft"))
    again = lambda c, q: F.concat(F.lit("Again "), F.col("query_id").cast("string"))
    return vf.verify_and_retry(drafts, containment_verifier, again).select(
        "query_id", "risk_level", "checked", "faithful", "retried", "answer")


@query("prompt_fill", """
SELECT conv_id, turn, 'Document: ' || text || chr(10) || 'Claim: ' || role AS prompt FROM conversations""")
def prompt_fill(spark, sf):
    from folioquery.providers import CLAIM_TEMPLATE
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", fill(CLAIM_TEMPLATE, chunk=F.col("text"), claim=F.col("role")).alias("prompt"))


@query("question_resolve", f"""
SELECT conv_id, turn, CASE role WHEN 'user' THEN text ELSE 'label ' || turn END AS label,
  CASE role WHEN 'user' THEN text WHEN 'assistant' THEN '' ELSE CASE WHEN turn = 0 THEN text ELSE 'label ' || turn END END AS prompt,
  CASE role WHEN 'assistant' THEN text ELSE '' END AS answer,
  CASE role WHEN 'user' THEN {sql_strip('text')} WHEN 'assistant' THEN 'typed' ELSE CASE WHEN turn = 0 THEN {sql_strip('text')} ELSE 'label ' || turn END END AS asked
FROM conversations""")
def question_resolve(spark, sf):
    """Users are plain entries, assistants carry answers, systems carry prompts."""
    label = F.concat(F.lit("label "), F.col("turn").cast("string"))
    with_answer = F.parse_json(F.to_json(F.struct(label.alias("label"), F.col("text").alias("answer"), F.lit("x").alias("prompt"))))
    with_prompt = F.parse_json(F.to_json(F.struct(label.alias("label"), F.when(F.col("turn") == 0, F.col("text")).alias("prompt"))))
    entry = F.when(F.col("role") == "user", F.col("text").cast("variant")) \
        .when(F.col("role") == "assistant", with_answer).otherwise(with_prompt)
    entries = table(spark, sf, "conversations").select("conv_id", "turn", entry.alias("entry"))
    return resolve_questions(entries).withColumn("asked", backend_query(F.lit("typed"), F.col("prompt")))


# --- whole plans ------------------------------------------------------------

_STORES: dict[tuple[str, str], Store] = {}


def pipeline_store(spark, sf) -> Store:
    """All documents parsed, embedded and indexed, once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORES:
        _STORES[key] = build_store(documents(spark, sf), offline(), new_table_path(spark, "store"))
    return _STORES[key]


@query("answer_plan")
def answer_plan(spark, sf):
    """Every benchmark question answered, in its conversation where there is one."""
    asked = questions(spark, sf).withColumn("conv_id", F.col("query_id"))
    turns = mm.turns_from_messages(table(spark, sf, "conversations"))
    return answer(asked, pipeline_store(spark, sf), offline(), turns).withColumn(
        "citations", cx.citation_lines(F.col("sources"))).drop("sources")


@query("explain_plan")
def explain_plan(spark, sf):
    asked = questions(spark, sf).withColumn("expected_answer", F.col("question"))
    return explain_questions(asked, pipeline_store(spark, sf), offline())


# --- client calls -------------------------------------------------------------

def _terse_client():
    """Stands for a text client: no answer to some prompts, a first try in vain for others."""
    tried = set()

    def client(prompt: str) -> str:
        if len(prompt) % 7 == 0:
            raise ValueError(f"refused {len(prompt)}")
        if len(prompt) % 5 == 0 and prompt not in tried:
            tried.add(prompt)
            raise OSError("busy")
        return f"{len(prompt)} characters, from {prompt[3:9]}"
    return client


@query("client_answers", f"""
WITH p AS (SELECT item_id AS query_id, 'Q: ' || text AS prompt FROM benchmark)
SELECT query_id, CASE WHEN length(prompt) % 7 = 0 THEN '{fv.ERROR_ANSWER.replace("'", "''")}'
    ELSE length(prompt) || ' characters, from ' || prompt[4:9] END AS answer,
  CASE WHEN length(prompt) % 7 = 0 THEN 'refused ' || length(prompt) END AS error FROM p""")
def client_answers(spark, sf):
    """Every question sent once to a client that is retried, may refuse, and whose answers are kept."""
    folder = new_table_path(spark, "journal")
    open_client = lambda: with_retries(_terse_client(), attempts=2, base=0.0)
    asked = ask_once(questions(spark, sf), F.concat(F.lit("Q: "), F.col("question")), open_client, folder)
    return asked.select("query_id", "reply.answer", "reply.error")


@query("stage_counters", """
SELECT stage, 'rows' AS counter, (n * per)::DOUBLE AS value FROM (SELECT count(*) AS n FROM benchmark),
  (VALUES ('question-vectors', 1), ('pool', 10), ('hits', 6), ('drafts', 1)) AS s(stage, per)
UNION ALL SELECT 'drafts', 'failed', 0.0::DOUBLE UNION ALL SELECT 'drafts', 'without_context', 0.0::DOUBLE""")
def stage_counters(spark, sf):
    """What the stages of a batch of answers counted while they were written."""
    counters = Counters()
    answer(questions(spark, sf), pipeline_store(spark, sf), offline(), counters=counters)
    return counters.table(spark).where("counter != 'characters'")
