"""Quality rules with adaptive thresholds (DataFrame and SQL functions only).

Signals of each text are counted in place. Their spread is kept in mergeable
quantile sketches: a histogram of fixed integer bins per language, source and
signal. Two sketches merge by adding counts, so partial sketches are summed
before the shuffle, and a small group's sketch merges up into its language's or
the whole table's. Each group's cutoff is a fence above its own median, as wide
as its lower half asks, so up to half of a group may be bad without moving it;
and it stands at most a second slack above the fence of the language, so a
source that is bad as a whole does not vouch for itself. Texts are filtered by
joining the cutoffs.

Defined results: a null or empty text has no words and fails the base rule;
null languages or sources form groups of their own; repeated rows count each;
an empty table gives an empty result; other columns are carried or ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from folioquery.llm.common import SPACES, read, words_sql
from folioquery.operators.joins import fits_broadcast
from folioquery.session import materialize

MIN_WORDS = 50            # fewer fail
MAX_REPEAT_PERCENT = 50   # more words in repeated three-word windows fail
HALF_FACTOR = 7           # the fence stands this many times (median - lower quartile) above the median,
MIN_GROUP = 50            # and groups of fewer texts use the merged sketch of their language, or of all

# Signals in thousandths, and the least distance from the median to the fence.
SLACK = {"symbols": 50, "exclaims": 50, "capitals": 300, "dup_lines": 400, "repeats": 400}

_REPEATS = """
transform(array(w), v -> transform(array(
  transform(sequence(0, size(v) - 3), i -> xxhash64(v[i], v[i + 1], v[i + 2]))), h ->
    CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
      transform(array(sort_array(transform(h, (x, i) -> struct(x AS x, i AS i)))), p ->
        aggregate(
          sort_array(transform(filter(p, (e, i) ->
              (i > 0 AND p[greatest(i - 1, 0)].x = e.x)
              OR (i < size(p) - 1 AND p[least(i + 1, size(p) - 1)].x = e.x)), e -> e.i)),
          struct(0L AS n, -3 AS last),
          (s, i) -> struct(s.n + least(3, i - s.last) AS n, i AS last), s -> s.n))[0]
    END)[0])[0]
"""


def with_signals(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the array ``_bins`` of the signals' bins.

    Windows are told apart by 64-bit hashes within one text.
    """
    staged = docs.withColumn("w", F.expr(words_sql("text"))).withColumn(
        "_lines", F.expr(r"filter(split(coalesce(text, ''), '\n'), l -> length(trim(BOTH ' \t\r\u000C\u000B' FROM l)) > 0)"))
    counted = (
        staged.withColumn("n_words", F.size("w").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("w", "")).cast("long"))
        .withColumn("n_symbols", F.expr("CAST(coalesce(regexp_count(text, '[#*$%&|<>]'), 0) AS BIGINT)"))
        .withColumn("_exclaims", F.expr("CAST(coalesce(regexp_count(text, '!'), 0) AS BIGINT)"))
        .withColumn("_capitals", F.expr(r"CAST(coalesce(regexp_count(text, '\\p{Lu}'), 0) AS BIGINT)"))
        .withColumn("_n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.expr(f"CASE WHEN size(w) < 4 THEN 0L ELSE {_REPEATS} END")))
    share = lambda part, whole: F.expr(f"CASE WHEN {whole} > 0 THEN CAST(1000 * {part} div {whole} AS INT) ELSE 0 END")
    bins = {"symbols": share("n_symbols", "word_chars"), "exclaims": share("_exclaims", "word_chars"),
            "capitals": share("_capitals", "word_chars"), "dup_lines": share("n_dup_lines", "_n_lines"),
            "repeats": share("n_repeat_words", "n_words")}
    return counted.withColumn("_bins", F.array(*[bins[k] for k in SLACK])).drop(
        "w", "_lines", "_exclaims", "_capitals", "_n_lines")


def sketches(signals: DataFrame) -> DataFrame:
    """One row per (lang, source, signal, bin) with its count: at most 1001 bins a signal but for ratios over one."""
    return (signals.select("lang", "source", F.posexplode("_bins").alias("signal", "bin"))
            .groupBy("lang", "source", "signal", "bin").agg(F.count("*").alias("n")))


def thresholds(sketch: DataFrame) -> DataFrame:
    """Cutoffs per group: (lang, source, limits), limits in the order of SLACK.

    A quartile is the first bin where the running count reaches that share.
    """
    merged = (sketch.rollup("signal", "bin", "lang", "source")  # partial merges at three levels
              .agg(F.sum("n").alias("n"), F.grouping_id().alias("_level")).where("_level IN (0, 1, 3)"))
    group = Window.partitionBy("_level", "lang", "source", "signal")
    running = merged.withColumn("_run", F.sum("n").over(group.orderBy("bin"))).withColumn("_all", F.sum("n").over(group))
    quartile = lambda k: F.min(F.when(4 * F.col("_run") >= k * F.col("_all"), F.col("bin")))
    slack = F.element_at(F.array(*[F.lit(v) for v in SLACK.values()]), F.col("signal") + 1)
    q1, q2 = quartile(1), quartile(2)
    fences = running.groupBy("_level", "lang", "source", "signal").agg(
        F.max("_all").alias("_n"), (q2 + HALF_FACTOR * (q2 - q1)).alias("_fence")).withColumn("_limit", F.col("_fence") + slack)
    level = fences.groupBy("_level", "lang", "source").agg(
        F.max("_n").alias("_n"),
        F.transform(F.sort_array(F.collect_list(F.struct("signal", "_limit"))), lambda x: x["_limit"]).alias("limits"))
    own = level.where("_level = 0").select("lang", "source", "_n", F.col("limits").alias("_own"))
    lang = level.where("_level = 1").select(F.col("lang").alias("_l"), F.col("_n").alias("_ln"), F.col("limits").alias("_lim"))
    every = level.where("_level = 3").select(F.col("limits").alias("_every"))
    second = F.array(*[F.lit(v) for v in SLACK.values()])
    bounded = F.transform(F.arrays_zip("_own", "_wide", second.alias("_more")), lambda x: F.least(x["_own"], x["_wide"] + x["_more"]))
    return (own.join(lang, F.col("lang").eqNullSafe(F.col("_l"))).crossJoin(F.broadcast(every))  # one row
            .withColumn("_wide", F.when(F.col("_ln") >= MIN_GROUP, F.col("_lim")).otherwise(F.col("_every")))
            .select("lang", "source", F.when(F.col("_n") >= MIN_GROUP, bounded).otherwise(F.col("_wide")).alias("_limits")))


def with_verdicts(signals: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed and kept, joining each group's cutoffs (one row per language and source)."""
    limits = limits.withColumnsRenamed({"lang": "_l", "source": "_s"})
    same = F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))
    joined = signals.join(F.broadcast(limits) if fits_broadcast(limits) else limits, same, "left")
    over = F.expr("exists(arrays_zip(_bins, _limits), x -> x._bins > x._limits)")
    failed = F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    # One expression that a filter cannot be split from, or the signals would be computed once more below the join.
    kept = ~F.exists(F.array("base_failed", F.coalesce(over, F.lit(False))), lambda bad: bad)
    return joined.withColumn("base_failed", failed).withColumn("kept", kept)


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang, source) to the signals of each row, base_failed and kept.

    The signals, a few numbers a row, are written once and read for both the sketches and the verdicts.
    """
    signals = materialize(with_signals(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality-signals")
    return with_verdicts(signals, materialize(thresholds(sketches(signals)), "quality-limits"))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with.

    The texts are read twice, for the cutoffs and for the verdicts, and never shuffled.
    """
    plain = docs.select("doc_id", "text", "lang", "source")
    signals = materialize(with_signals(plain).drop("text"), "quality-signals")
    limits = materialize(thresholds(sketches(signals)), "quality-limits")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text", "lang", "source")
    return with_verdicts(with_signals(packed).drop("text"), limits).where("kept").select("_row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def _sql() -> str:
    words = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}'), lambda x: x <> '')"
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN 1000 * {a} // {b} ELSE 0 END"
    slack = ", ".join(map(str, SLACK.values()))
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {words} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE c > 1) GROUP BY doc_id),
f AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(text, '!')) AS ex,
    len(regexp_extract_all(text, '\p{{Lu}}')) AS up, len(ls) AS nl,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
    FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, [{share('n_symbols', 'word_chars')}, {share('ex', 'word_chars')}, {share('up', 'word_chars')},
    {share('n_dup_lines', 'nl')}, {share('n_repeat_words', 'n_words')}] AS bins FROM f),
long AS (SELECT lang, source, s, bins[s] AS bin FROM (SELECT *, unnest(range(1, {len(SLACK) + 1})) AS s FROM b)),
lev AS (SELECT 0 AS lv, lang, source, s, bin FROM long UNION ALL SELECT 1, lang, NULL, s, bin FROM long
    UNION ALL SELECT 2, NULL, NULL, s, bin FROM long),
q AS (SELECT lv, lang, source, s, count(*) AS n, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.5) AS q2 FROM lev GROUP BY ALL),
t AS (SELECT lv, lang, source, max(n) AS n, list(q2 + {HALF_FACTOR} * (q2 - q1) + ([{slack}])[s] ORDER BY s) AS lim FROM q GROUP BY ALL),
wide AS (SELECT o.*, CASE WHEN l.n >= {MIN_GROUP} THEN l.lim ELSE e.lim END AS wide
    FROM (SELECT * FROM t WHERE lv = 0) o JOIN (SELECT * FROM t WHERE lv = 1) l ON o.lang IS NOT DISTINCT FROM l.lang,
    (SELECT lim FROM t WHERE lv = 2) e),
lims AS (SELECT lang, source, CASE WHEN n >= {MIN_GROUP} THEN
    list_transform(range(1, {len(SLACK) + 1}), lambda s: least(lim[s], wide[s] + ([{slack}])[s])) ELSE wide END AS lim FROM wide)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bad AS base_failed,
    NOT bad AND NOT list_bool_or(list_transform(range(1, {len(SLACK) + 1}), lambda s: bins[s] > lim[s])) AS kept
FROM (SELECT b.*, lims.lim, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS bad
      FROM b JOIN lims ON b.lang IS NOT DISTINCT FROM lims.lang AND b.source IS NOT DISTINCT FROM lims.source)"""


SQL = _sql()
