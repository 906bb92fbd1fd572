"""Registry of checkable queries: a Spark callable and, where it can be said
in plain SQL, the same result as a query on the raw tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioquery.session import spread

# Tables whose rows are costly to work on.
TEXT_TABLES = ("documents", "pages")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(scan) if name in TEXT_TABLES else scan


# --- SQL fragments ----------------------------------------------------------

SQL_SPACE = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def sql_tokens(col: str) -> str:
    """BM25 tokens."""
    flat = f"regexp_replace(lower({col}), '[\\[\\]().,:;!?*\\-]', ' ', 'g')"
    return f"list_filter(string_split({flat}, ' '), lambda t: trim(t, {SQL_SPACE}) <> '')"


def sql_set(col: str) -> str:
    """Distinct tokens for set similarity."""
    stop = "['', 'the', 'a', 'an', 'of', 'in', 'and', 'for', 'to', 'is', 'on', 'at', 'by', 'with', 'from', 'or', 'as', 'are']"
    words = f"string_split(regexp_replace(lower({col}), '[^a-z0-9]+', ' ', 'g'), ' ')"
    return f"list_filter(list_distinct({words}), lambda w: NOT list_contains({stop}, w))"


def sql_jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN {both} / (len({a}) + len({b}) - {both}) ELSE 0.0 END)"


def sql_strip(col: str) -> str:
    return f"trim({col}, {SQL_SPACE})"


def sql_sentences(col: str) -> str:
    cut = f"regexp_replace({col}, '([.!?])\\s+', '\\1' || chr(1), 'g')"
    return (f"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: {sql_strip('s')}), "
            f"lambda s: s <> '')")


BM25_SQL = f"""
docs AS (SELECT doc_id, {sql_tokens('text')} AS toks FROM documents),
dl AS (SELECT doc_id, len(toks) AS dl FROM docs),
tot AS (SELECT count(*)::DOUBLE AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM dl),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM docs) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM dfs, tot),
floor_idf AS (SELECT 0.25 * avg(idf) AS eps FROM raw),
idf AS (SELECT term, CASE WHEN idf < 0 THEN eps ELSE idf END AS idf FROM raw, floor_idf),
qt AS (SELECT item_id AS query_id, term, count(*) AS times FROM
       (SELECT item_id, unnest({sql_tokens("trim(lower(text), " + SQL_SPACE + ")")}) AS term FROM benchmark) GROUP BY ALL),
scores AS (SELECT query_id, doc_id, round(sum(times * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score
           FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN dl USING (doc_id), tot GROUP BY ALL),
bm25 AS (SELECT query_id, doc_id, score, rank FROM
         (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores)
         WHERE rank <= 12 AND score > 0)
"""


def knn_sql(expr: str, order: str) -> str:
    """Nearest vectors of each question; ``expr`` over arrays a and b."""
    return f"""
ev AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
qv AS (SELECT item_id AS query_id, v FROM benchmark JOIN ev ON item_id = vec_id),
dist AS (SELECT query_id, vec_id AS chunk_id, round({expr}, 6) AS score
         FROM (SELECT query_id, vec_id, qv.v AS a, ev.v AS b FROM qv, ev)),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, chunk_id) AS rank
                         FROM dist) WHERE rank <= 12)
"""


L2_SQL = "list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
COSINE_SQL = "list_cosine_similarity(a, b)"
DOT_SQL = "list_dot_product(a, b)"
