"""Line dedup by a log-template tree (DataFrame and SQL functions only).

Each line walks a tree of fixed depth: its number of tokens, then its first
DEPTH tokens, where tokens with digits count as a variable field. Lines that
agree in all tokens but the variable ones are one template. Within a leaf,
lines that are still single are generalised further: a token stays in the
template if it stands at its place in at least MIN_DOCS documents of the leaf, any
other becomes a variable field, and the line takes part if SIMILARITY of
its tokens stay. A template in at least MIN_DOCS documents recurs: its lines are
dropped from all documents but the first (least doc_id), so that no content is
lost and a group of copies keeps one whole text.

Counts of documents come from two aggregates with partial sums, so a line in a
third of all documents is no hot group. Templates and leaves are told apart
by 64-bit hashes.

Defined results: null texts stay null, empty texts stay empty; blank lines and lines
of fewer than MIN_TOKENS tokens are never dropped; repeated rows of one id are one
document; lines end at line feeds; an empty table gives no rows; other
columns are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioquery.llm.common import SPACES, measured, read, words_sql
from folioquery.session import materialize

DEPTH = 3
MIN_DOCS = 3
MIN_TOKENS = 3
SIMILARITY = 60   # percent of the tokens

KEY = ["doc_id", "_t"]  # a document and its text
MASKED = "transform(_w, x -> CASE WHEN x RLIKE '[0-9]' THEN '<*>' ELSE x END)"


def _lines(docs: DataFrame) -> DataFrame:
    """Lines with their masked tokens: doc_id, _t, line, _m."""
    return (docs.select("doc_id", F.xxhash64("text").alias("_t"), F.posexplode(F.split("text", "\n")).alias("line", "_s"))
            .withColumn("_w", F.expr(words_sql("_s"))).where(F.size("_w") >= MIN_TOKENS)
            .select(*KEY, "line", F.expr(f"CASE WHEN _s RLIKE '[0-9]' THEN {MASKED} ELSE _w END").alias("_m")))


def _documents(lines: DataFrame, template: str) -> DataFrame:
    """Templates in at least MIN_DOCS documents, with the first of them."""
    return (lines.select(template, "doc_id").distinct().groupBy(template)
            .agg(F.count("*").alias("_docs"), F.min("doc_id").alias("_first")).where(F.col("_docs") >= MIN_DOCS).drop("_docs"))


def _generalised(docs: DataFrame, single: DataFrame) -> DataFrame:
    """Lines (_id, doc_id, _sig) of leaves with several documents, variable tokens left out of the template.

    A token at its place in a leaf is one 64-bit hash, and a template the sum of
    its fixed places' hashes, so only hashes are shuffled and no line is gathered.
    """
    shared = materialize(_documents(single, "_leaf"), "line-shared").select("_leaf")
    open_ = materialize(single.join(measured(shared), "_leaf"), "line-open")
    once = open_.groupBy(*KEY, "line", "_leaf").agg(F.min("_id").alias("_id"), F.count("*").alias("_c"))  # repeated rows as one
    of_doc = once.groupBy(*KEY).agg(F.collect_list(F.struct("_id", "line", "_leaf", "_c")).alias("_open"))  # lines of one text
    of_doc = materialize(of_doc, "line-open-texts").withColumnsRenamed({"doc_id": "_i", "_t": "_h"})
    found = docs.withColumn("_t", F.xxhash64("text")).join(measured(of_doc), (F.col("doc_id") == F.col("_i")) & (F.col("_t") == F.col("_h")))
    tokens = (found.select("doc_id", F.expr(r"transform(array(split(text, '\n')), l -> transform(_open, o -> struct(o._id, o._leaf, o._c, l[o.line] AS _s)))[0]").alias("_o"))
              .select("doc_id", F.explode("_o").alias("_o")).select("doc_id", "_o.*")
              .withColumn("_w", F.expr(words_sql("_s"))).withColumn("_n", F.size("_w"))
              .select("_id", "doc_id", "_leaf", "_n", "_c", F.posexplode(F.expr(f"CASE WHEN _s RLIKE '[0-9]' THEN {MASKED} ELSE _w END")).alias("_pos", "_tok"))
              .select("_id", "doc_id", "_n", "_c", F.xxhash64("_leaf", "_pos", "_tok").alias("_place")))
    tokens = materialize(tokens, "line-places")
    fixed = materialize(_documents(tokens, "_place"), "line-fixed").select("_place")
    kept = tokens.join(measured(fixed), "_place").groupBy("_id", "doc_id", "_n", "_c").agg(
        F.count("*").alias("_k"), F.sum(F.xxhash64("_place").cast("decimal(38,0)")).alias("_sum"))
    each = F.expr("CAST(_sum / _c AS DECIMAL(38,0))")
    return (kept.where(100 * F.col("_k") >= SIMILARITY * F.col("_n") * F.col("_c"))
            .select("_id", "doc_id", F.xxhash64("_n", each).alias("_sig")))


def recurring_lines(docs: DataFrame) -> DataFrame:
    """Lines to drop, as (doc_id, _t, line)."""
    placed = materialize(_lines(docs).select(
        F.monotonically_increasing_id().alias("_id"), *KEY, "line",
        F.xxhash64(F.size("_m"), F.slice("_m", 1, DEPTH)).alias("_leaf"), F.xxhash64("_m").alias("_sig")), "line-leaves")
    recurring = materialize(_documents(placed, "_sig"), "line-recurring")
    known = placed.join(measured(recurring), "_sig", "left")
    general = materialize(_generalised(docs, known.where("_first IS NULL").select("_id", *KEY, "line", "_leaf")), "line-general")
    grown = general.join(measured(materialize(_documents(general, "_sig"), "line-grown")), "_sig").where("doc_id != _first").select("_id")
    exact = known.where("doc_id != _first").select(*KEY, "line")
    return exact.unionAll(placed.join(measured(grown), "_id", "left_semi").select(*KEY, "line")).distinct()


def without_recurring(docs: DataFrame) -> DataFrame:
    """``docs`` packed in ``_doc`` with doc_id, text as kept, n_lines, n_dropped."""
    drops = materialize(recurring_lines(docs.select("doc_id", "text")).groupBy(*KEY).agg(F.collect_list("line").alias("_drop")), "line-drops")
    drops = drops.withColumnsRenamed({"doc_id": "_i", "_t": "_h"})
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "doc_id", "text")
    same = (F.col("doc_id") == F.col("_i")) & (F.xxhash64("text") == F.col("_h"))
    joined = packed.join(measured(drops), same, "left")
    kept = F.expr(r"""CASE WHEN _drop IS NULL THEN text ELSE
        transform(array(split(text, '\n')), l -> array_join(transform(array_except(sequence(0, size(l) - 1), _drop), i -> l[i]), '\n'))[0] END""")
    return joined.select("_doc", "doc_id", kept.alias("_text"), F.coalesce(F.size("_drop"), F.lit(0)).alias("n_dropped"), "text")


def drop_lines(docs: DataFrame) -> DataFrame:
    """The documents without recurring lines, columns as they came (n_chars, where present, follows the text).

    A document that loses all it had is a copy of text kept elsewhere and goes.
    """
    done = without_recurring(docs).where(rf"n_dropped = 0 OR _text RLIKE '{SPACES.replace('[', '[^', 1)}'")
    new = {"text": F.col("_text"), "n_chars": F.when(F.col("n_dropped") > 0, F.length("_text")).otherwise(F.col("_doc.n_chars"))
           if "n_chars" in docs.columns else None}
    types = dict(docs.dtypes)
    return done.select(*[new[c].cast(types[c]).alias(c) if c in new else F.col(f"_doc.`{c}`") for c in docs.columns])


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = without_recurring(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"),
                       F.col("n_dropped").cast("long").alias("n_dropped"),
                       F.length(F.coalesce("_text", F.lit(""))).cast("long").alias("kept_chars"),
                       F.md5(F.coalesce("_text", F.lit(""))).alias("kept_md5"))


SQL = rf"""
WITH l AS (SELECT doc_id, line, list_filter(regexp_split_to_array(s, '{SPACES}'), lambda x: x <> '') AS w FROM (
    SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line, unnest(ls) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
m AS MATERIALIZED (SELECT doc_id, line, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS m
    FROM l WHERE len(w) >= {MIN_TOKENS}),
p AS (SELECT m, min(doc_id) AS first FROM m GROUP BY m HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
one AS MATERIALIZED (SELECT doc_id, line, m, len(m) || chr(1) || array_to_string(m[1:{DEPTH}], chr(1)) AS leaf FROM m WHERE m NOT IN (SELECT m FROM p)),
opened AS (SELECT * FROM one WHERE leaf IN (SELECT leaf FROM one GROUP BY leaf HAVING count(DISTINCT doc_id) >= {MIN_DOCS})),
tok AS (SELECT doc_id, line, leaf, generate_subscripts(m, 1) AS pos, unnest(m) AS tok FROM opened),
fixed AS (SELECT leaf, pos, tok FROM tok GROUP BY ALL HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
gen AS (SELECT doc_id, line, t.leaf, list(f.tok ORDER BY t.pos) AS g FROM tok t LEFT JOIN fixed f ON t.leaf = f.leaf AND t.pos = f.pos AND t.tok = f.tok
    GROUP BY doc_id, line, t.leaf HAVING 100 * count(f.tok) >= {SIMILARITY} * count(*)),
q AS (SELECT leaf, g, min(doc_id) AS first FROM gen GROUP BY leaf, g HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
gone AS (SELECT doc_id, line FROM m JOIN p USING (m) WHERE doc_id <> first
    UNION SELECT doc_id, line FROM gen JOIN q USING (leaf, g) WHERE doc_id <> first),
d AS (SELECT doc_id, list(line) AS gone FROM gone GROUP BY doc_id),
k AS (SELECT documents.doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, coalesce(gone, []) AS gone FROM documents LEFT JOIN d USING (doc_id)),
t AS (SELECT doc_id, len(ls) AS n_lines, len(gone) AS n_dropped, array_to_string(list_transform(list_filter(range(0, len(ls)),
    lambda i: NOT list_contains(gone, i)), lambda i: ls[i + 1]), chr(10)) AS kept FROM k)
SELECT doc_id, n_lines, n_dropped, length(kept) AS kept_chars, md5(kept) AS kept_md5 FROM t"""
