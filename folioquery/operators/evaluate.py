"""Golden-set checks, retrieval hits, judge replies, evaluation summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioquery.functions import fixed_values as fv
from folioquery.functions.text import jaccard, lstrip, set_tokens, strip
from folioquery.session import new_table_path

_REPLY_FIELDS = [f for m in fv.METRICS for f in (m, f"{m}_reasoning")]


# --- golden set -------------------------------------------------------------

def golden_errors(items: DataFrame) -> DataFrame:
    """All rule violations of golden items: items(index, item JSON) -> (index, error)."""
    v = F.try_parse_json("item")
    kind = F.coalesce(F.schema_of_variant(v), F.lit("INVALID"))

    def field_error(name: str) -> Column:
        value = F.try_variant_get(v, f"$.{name}", "variant")
        text = F.try_variant_get(v, f"$.{name}", "string")
        bad = (F.schema_of_variant(value) != "STRING") | (strip(text) == "")
        return F.when(value.isNull(), f"missing required field '{name}'") \
                .when(F.coalesce(bad, F.lit(True)), f"field '{name}' is empty or not a string")

    fields = F.array_compact(F.array(*[field_error(f) for f in fv.GOLDEN_FIELDS]))
    errors = F.when(kind.startswith("OBJECT"), fields).otherwise(F.array(F.lit("not an object")))
    return items.select("index", F.explode(errors).alias("error"))


class InvalidGolden(ValueError):
    """``errors`` names the table of all violations (index, error)."""

    def __init__(self, n: int, errors: str):
        super().__init__(f"golden set is invalid: {n} violation(s), all of them in {errors}")
        self.errors = errors


def assert_golden(items: DataFrame) -> None:
    """Fail if there are violations; all of them are written to a table that the error names."""
    spark, path = items.sparkSession, new_table_path(items.sparkSession, "golden-errors")
    golden_errors(items).write.parquet(path)
    n = spark.read.schema("index long, error string").parquet(path).count()
    if n:
        raise InvalidGolden(n, path)


def find_case(golden: DataFrame, part: str) -> DataFrame:
    """The first golden item whose question contains ``part``, any case."""
    return golden.where(F.contains(F.lower("question"), F.lit(part.lower()))).orderBy("index").limit(1)


def subset(golden: DataFrame, indices: list[int]) -> DataFrame:
    """Only the listed 1-based items; an empty list keeps all."""
    return golden.where(F.col("index").isin(indices)) if indices else golden


# --- retrieval --------------------------------------------------------------

def retrieval_hit(expected: Column, retrieved: Column, threshold: float = fv.HIT_THRESHOLD) -> Column:
    """True when any expected title is similar enough to any retrieved title.

    Both arrays are short (golden sources and top_k titles of one question).
    """
    found = F.transform(retrieved, lambda r: set_tokens(r))
    return F.coalesce(F.exists(expected, lambda e: F.exists(
        found, lambda r: jaccard(set_tokens(e), r) >= threshold)), F.lit(False))


# --- judge replies ----------------------------------------------------------

def strip_fences(raw: Column) -> Column:
    """The body of a fenced reply; unfenced replies are only trimmed."""
    trimmed = strip(raw)
    inside = strip(lstrip(F.get(F.split(trimmed, "```", -1), 1), "json"))
    return F.when(trimmed.startswith("```"), inside).otherwise(trimmed)


def parse_reply(raw: Column) -> Column:
    """Judge reply -> struct of fields plus ``ok``.

    An object or a non-empty array (first element) is accepted. Scores must be
    one of the five anchors as text; reasonings must be text.
    """
    v = F.try_parse_json(strip_fences(raw))
    is_array = F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    path = lambda f: F.when(is_array, F.try_variant_get(v, f"$[0].{f}", "variant")) \
        .otherwise(F.try_variant_get(v, f"$.{f}", "variant"))
    text = lambda f: F.when(F.schema_of_variant(path(f)) == "STRING",
                            F.try_variant_get(path(f), "$", "string"))
    ok = F.lit(True)
    for m in fv.METRICS:
        ok = ok & F.coalesce(text(m).isin(*fv.SCORE_ANCHORS), F.lit(False)) \
            & text(f"{m}_reasoning").isNotNull()
    return F.struct(*[text(f).alias(f) for f in _REPLY_FIELDS], ok.alias("ok"))


def scored(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Reply text -> numeric scores, reasonings and judge_failed."""
    parsed = replies.withColumn("_r", parse_reply(F.col(reply)))
    ok = F.col("_r.ok")
    columns = []
    for m in fv.METRICS:
        columns.append(F.when(ok, F.expr(f"try_cast(_r.{m} AS DOUBLE)")).alias(m))
        columns.append(F.when(ok, F.col(f"_r.{m}_reasoning")).otherwise(fv.JUDGE_FAILURE).alias(f"{m}_reasoning"))
    keep = [c for c in replies.columns if c != reply]
    return parsed.select(*keep, *columns, (~ok).alias("judge_failed"))


def validated_results(requested: DataFrame, returned: DataFrame, order: str = "pos") -> DataFrame:
    """Keep the first result per requested index; flag requested ones without any.

    requested(index), returned(index, pos, ...). The first result is found by
    an aggregate, so piles of duplicates shrink before they are shuffled.
    """
    payload = [c for c in returned.columns if c not in ("index", order)]
    first = returned.groupBy("index").agg(
        F.min_by(F.struct(*payload), order).alias("_p"))
    return (
        requested.select("index").distinct().join(first, "index", "left")
        .select("index", *[F.col(f"_p.{c}").alias(c) for c in payload],
                F.col("_p").isNull().alias("judge_failed"))
    )


def judge_route(answer: Column, category: Column) -> Column:
    """failed / negative / standard."""
    return F.when(answer == fv.ERROR_SENTINEL, "failed") \
            .when(F.lower(strip(category)) == "negative", "negative").otherwise("standard")


def truncated_context(context: Column, limit: int = fv.CONTEXT_LIMIT) -> Column:
    """Judge input: the leading part plus a marker once past the limit."""
    return F.when(F.length(context) > limit,
                  F.concat(F.substring(context, 1, limit), F.lit(fv.CONTEXT_CUT))).otherwise(context)


# --- records and summaries --------------------------------------------------

VERIFY_COLUMNS = ("risk_level", "minicheck_triggered", "minicheck_faithful", "retry_triggered")


def eval_records(run_id: str, golden: DataFrame, answers: DataFrame, scores: DataFrame,
                 verified: bool = False) -> DataFrame:
    """golden ⋈ answers ⋈ scores by index; unscored rows count as failed."""
    extra = list(VERIFY_COLUMNS) if verified else []
    joined = golden.join(answers, "index", "left").join(scores, "index", "left")
    metrics = [c for m in fv.METRICS for c in (
        F.col(m), F.coalesce(F.col(f"{m}_reasoning"), F.lit("")).alias(f"{m}_reasoning"))]
    return joined.select(
        F.lit(run_id).alias("run_id"), "index", F.col("question_category").alias("category"),
        "question", "expected_answer", "generated_answer", "retrieved_context",
        F.coalesce(F.col("retrieval_hit").cast("int"), F.lit(0)).alias("retrieval_hit"),
        *extra, *metrics, F.coalesce("judge_failed", F.lit(True)).alias("judge_failed"))


def _valid_mean(metric: str) -> Column:
    return F.avg(F.when(~F.col("judge_failed"), F.col(metric)))


def summary(records: DataFrame) -> DataFrame:
    """One row: failures, valid rows, hit percent over all, means over valid rows."""
    return records.agg(
        F.count("*").alias("n"), F.count_if("judge_failed").alias("n_failed"),
        F.count_if(~F.col("judge_failed")).alias("n_valid"),
        (F.avg("retrieval_hit") * 100).alias("hit_pct"),
        *[_valid_mean(m).alias(m) for m in fv.METRICS])


def by_category(records: DataFrame) -> DataFrame:
    """Means and counts per category over valid rows."""
    return records.where(~F.col("judge_failed")).groupBy("category").agg(
        F.count("*").alias("n"), *[F.avg(m).alias(m) for m in fv.METRICS])


def rollup_summary(records: DataFrame) -> DataFrame:
    """Category and grand-total means of valid rows in one pass."""
    return records.where(~F.col("judge_failed")).rollup("category").agg(
        F.grouping("category").alias("is_total"), F.count("*").alias("n"),
        *[F.avg(m).alias(m) for m in fv.METRICS])


def verification_summary(records: DataFrame) -> DataFrame:
    high = F.count_if(F.col("risk_level") == "HIGH")
    retries = F.sum(F.col("retry_triggered").cast("int"))
    return records.agg(
        F.count("*").alias("n"), high.alias("n_high"),
        F.sum(F.col("minicheck_triggered").cast("int")).alias("n_checked"), retries.alias("n_retries"),
        F.when(high > 0, retries / high * 100).otherwise(F.lit(0.0)).alias("retry_pct"))


def high_risk_by_category(records: DataFrame) -> DataFrame:
    return records.groupBy("category").agg(
        F.count("*").alias("n"), (F.avg((F.col("risk_level") == "HIGH").cast("int")) * 100).alias("high_pct"))


# --- index reports ----------------------------------------------------------

def index_quality(children: DataFrame) -> DataFrame:
    """Counts per content type plus rows whose source carries chunk labels."""
    source = F.col("metadata.source")
    dirty = F.contains(source, F.lit("Chapter:")) | F.contains(source, F.lit("Content:"))
    return children.groupBy(F.col("metadata.content_type").alias("content_type")).agg(
        F.count("*").alias("n"), F.count_if(dirty).alias("dirty"))


def wiring_check(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """One row: hits, resolved parents, missing parents, table rows without a table id."""
    found = hits.join(parents.select(F.col("id").alias("chunk_id"), F.col("metadata.table_id").alias("table_id"),
                                     F.lit(True).alias("found")), "chunk_id", "left")
    has = F.coalesce("found", F.lit(False))
    bare = has & (F.col("content_type") == "table") & (F.coalesce("table_id", F.lit("")) == "")
    return found.agg(F.count("*").alias("n_hits"), F.count_if(has).alias("n_resolved"),
                     F.count_if(~has).alias("n_missing"), F.count_if(bare).alias("n_no_table_id"))


def table_chunks(children: DataFrame) -> DataFrame:
    """Chunks marked as tables, or holding a pipe."""
    return children.where((F.col("metadata.content_type") == "table")
                          | F.contains("page_content", F.lit("|")))
