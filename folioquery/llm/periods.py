"""Periodic runs of words: an online sparse diagonal DP.

A run is a stretch of words with smallest period q (words q apart are equal) of
at least ``max(least, times * q)`` words that no neighbouring word extends. On
the diagonal of lag q it is a row of matches. The words are read from left to
right; every active lag either matches once more or ends, and a diagonal that
ends long enough emits its run at once.

A word has far too many earlier occurrences in a long text to follow them all,
so a lag is opened only by the latest earlier place where the word stood with
the same ``m - 1`` words before it, for m = 16, 32, 64 and so on, and only if
the lag is above m / 2 (any lag for the smallest m) and at most m. That loses
no run: its last m words, m being the power of two from q on, also stand q
words earlier inside the run, and no nearer, or the run had a smaller period.
Nor does it open a multiple of a run's period. So a few lags are active at a time,
the work is n log n in the number of words, and memory is linear in it.

Defined results: a null or empty text has no words and no runs, its collapsed
text is empty; repeated rows count each; other columns of the caller are not
touched; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioquery.llm.common import SPACES, read, words_sql

LEAST = 24   # words of the shortest run
TIMES = 3    # periods of the shortest run; three at least, or the openings above would miss some

RUN = "struct<start:bigint,length:bigint,period:bigint>"
FOUND = f"struct<n_words:bigint,runs:array<{RUN}>,collapsed:string>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def _first_width(least: int) -> int:
    """The smallest m: m + q words fit into every run of a period q up to m."""
    return 1 << ((2 * least // 3).bit_length() - 1)


def _may_repeat(codes: np.ndarray, width: int) -> bool:
    """Whether a stretch of ``width`` words may occur twice; hashes only ever say yes too often."""
    h, have = codes.astype(np.uint64) + np.uint64(1), 1
    while have < width:
        h = h[:-have] * np.uint64(0x9E3779B97F4A7C15 + 2 * have) + (h[have:] ^ (h[have:] >> np.uint64(29)))
        have *= 2
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def _doubled(ids: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the stretches of ``2 * width`` words from those of ``width`` words."""
    pairs = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
    return np.unique(pairs, return_inverse=True)[1]


def openings(codes: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """(place, lag) where a diagonal is to be opened, by place."""
    width, low, limit = _first_width(least), 0, len(codes) // times
    ids, have, places, lags = codes, 1, [], []
    while have < width:
        ids, have = _doubled(ids, have), 2 * have
    while len(ids):
        order = np.argsort(ids, kind="stable")
        same, lag = ids[order[1:]] == ids[order[:-1]], np.diff(order)
        if not same.any():
            break
        hit = same & (lag > low) & (lag <= min(width, limit))
        at, lag = order[1:][hit], lag[hit]
        by_place = np.argsort(at)
        at, lag = at[by_place], lag[by_place]
        goes_on = np.zeros(len(at), bool)  # the lag was opened one word before
        goes_on[1:] = (np.diff(at) == 1) & (np.diff(lag) == 0)
        places.append(at[~goes_on] + width - 1)
        lags.append(lag[~goes_on])
        low = width
        if low >= limit or len(ids) <= width:
            break
        ids, width = _doubled(ids, width), 2 * width
    if not places:
        return []
    return sorted(zip(np.concatenate(places).tolist(), np.concatenate(lags).tolist()))


def runs_of(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(words)
    if n < least:
        return []
    known: dict = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if not _may_repeat(codes, _first_width(least)):
        return []
    todo, seq = openings(codes, least, times), codes.tolist()
    active: dict[int, int] = {}  # lag -> matches so far
    found, i, k = [], 0, 0
    while active or k < len(todo):
        if not active:
            i = todo[k][0]
        for lag in list(active):
            if i < n and seq[i] == seq[i - lag]:
                active[lag] += 1
                continue
            length = active.pop(lag) + lag
            if length >= max(least, times * lag):
                found.append((i - length, length, lag))
        while k < len(todo) and todo[k][0] == i:
            lag, k = todo[k][1], k + 1
            if lag not in active:
                back = i
                while back >= lag and seq[back] == seq[back - lag]:
                    back -= 1
                active[lag] = i - back
        i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: Iterable[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return b" ".join(words if keep.all() else [w for w, k in zip(words, keep.tolist()) if k])


def periodic_runs(text: Column, least: int = LEAST, times: int = TIMES) -> Column:
    """A text's n_words, runs(start, length, period) and collapsed text, as one struct."""
    if times < 3 or least < 3:
        raise ValueError("runs have three periods and three words at least")

    def find(texts: pa.Array) -> pa.Array:
        counts, runs, collapsed = [], [], []
        for value in texts:
            words = (value.as_py() or "").encode().split()  # bytes split at the six ASCII spaces only
            here = runs_of(words, least, times)
            counts.append(len(words))
            runs.append([{"start": s, "length": n, "period": p} for s, n, p in here])
            collapsed.append(collapse(words, here).decode())
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(collapsed, pa.string())], fields=list(_FOUND))

    return F.arrow_udf(find, FOUND)(text)


# A run is greater by exact length / period; the first of equal ones stays.
_GREATEST = (f"aggregate(found.runs, CAST(NULL AS {RUN}), (best, r) -> "
             "CASE WHEN best IS NULL OR r.length * best.period > best.length * r.period THEN r ELSE best END)")


def with_planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by crc32 of the id, repeat a stretch of their own words.

    Null ids are never changed.
    """
    return (
        docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("_h"))
        .withColumn("_w", F.when(F.col("_h") % 10 == 0, F.expr(words_sql("text"))))
        .withColumn("_n", F.size("_w")).withColumn("_g", F.expr("_h div 10"))
        .withColumn("_a", F.expr("CASE WHEN _n > 0 THEN CAST(_g % _n AS INT) END"))
        .withColumn("_p", F.expr("1 + CAST((_n - _a) div (3 + _g % 8) AS INT)"))
        .select("doc_id", F.expr("""CASE WHEN _a IS NULL THEN text ELSE
            array_join(transform(_w, (x, i) -> CASE WHEN i < _a THEN x ELSE _w[_a + (i - _a) % _p] END), ' ') END""").alias("text")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a run have nulls for the greatest one."""
    found = with_planted(read(spark, sf_dir, "documents")).select("doc_id", periodic_runs(F.col("text")).alias("found"))
    best = found.withColumn("best", F.expr(_GREATEST))
    return best.select(
        "doc_id", F.size("found.runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.expr("array_join(transform(found.runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"), 256)
        .alias("runs_sha256"),
        F.sha2("found.collapsed", 256).alias("collapsed_sha256"))


def crc32_sql(text: str) -> str:
    """DuckDB: unsigned crc32 of a text of ASCII characters; null stays null."""
    bit = "lambda a, b: xor(a >> 1, (a & 1) * 3988292384::UBIGINT)"
    byte = f"lambda c, d: list_reduce(list_prepend(xor(c, d), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), {bit})"
    return (f"xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, "
            f"list_transform(string_split({text}, ''), lambda c: ascii(c)::UBIGINT)), {byte}))")


# Every pair of equal stretches of 16 words, in rows along their diagonals; the smallest lag of one stretch is its period.
SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, {crc32_sql('doc_id::VARCHAR')} AS h,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT k, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g FROM t),
q AS (SELECT *, CASE WHEN planted THEN (g % n)::BIGINT END AS a FROM p),
s AS (SELECT *, CASE WHEN planted THEN (1 + (n - a) // (3 + (g % 8)::BIGINT))::BIGINT END AS per FROM q),
d AS MATERIALIZED (SELECT k, doc_id, n, CASE WHEN planted THEN
    list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % per + 1] END) ELSE w END AS w FROM s),
g AS MATERIALIZED (SELECT k, n, i, md5(array_to_string(w[i + 1:i + 16], ' ')) AS x FROM (SELECT k, n, w, unnest(range(n - 15)) AS i FROM d)),
m AS (SELECT a.k, b.i - a.i AS lag, b.i FROM g a JOIN g b ON a.k = b.k AND a.x = b.x AND a.i < b.i AND 3 * (b.i - a.i) <= a.n),
r AS (SELECT k, lag, min(i) - lag AS start, max(i) + 16 - min(i) + lag AS length FROM (
    SELECT *, i - row_number() OVER (PARTITION BY k, lag ORDER BY i) AS isle FROM m) GROUP BY k, lag, isle),
runs AS (SELECT k, start, length, min(lag) AS period FROM r WHERE length >= greatest({LEAST}, {TIMES} * lag) GROUP BY k, start, length),
per AS (SELECT k, count(*) AS n_runs, list({{'s': start, 'l': length, 'p': period}} ORDER BY start, period) AS rs,
    first({{'s': start, 'l': length, 'p': period}} ORDER BY length::DOUBLE / period DESC, start, period) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period,
    (1000 * best.l // best.p)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
    sha256(coalesce(array_to_string(CASE WHEN rs IS NULL THEN w ELSE list_transform(list_filter(range(n), lambda i:
        len(list_filter(rs, lambda x: i >= x.s + x.p AND i < x.s + x.l)) = 0), lambda i: w[i + 1]) END, ' '), '')) AS collapsed_sha256
FROM d LEFT JOIN per USING (k)"""
