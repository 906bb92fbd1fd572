"""Exact top-k over postings in impact-ordered blocks, skipping what no bound lets in.

A posting's impact is what it adds to a score per unit of idf; it depends on the
index alone. Postings of a term are kept in blocks, best impacts first: the term's level of
impact, and within a level a hash of the document, so that no block or group grows
with the collection. Every block knows its highest impact. Blocks are dealt to shards (folders) by term
and sorted by term inside, so a question opens its terms' folders and row groups only.

Where a question's few most telling terms may say enough, their first blocks give partial
scores; the k-th best of these is a floor below the true k-th score. A block whose best
impact, plus all that the question's other terms could add, stays below the floor of every
question that asks for it holds no result and is not read. What is read is spread by
document, so a document's matches meet in one task, which adds them up for all
questions and hands on its best k. Nothing is capped: where bounds say little, all is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioquery.operators.joins import fits_broadcast, top_rows
from folioquery.session import materialize

BLOCK = 1024          # postings of a block, about; terms of fewer have one block
LEVELS = 8            # levels of impact of a term with more
SEEDS = 4             # terms of a question that set its floor
LITERALS = 256        # up to so many question terms are written into the scan's filter
TERMS_A_SHARD = 100_000
MIN_SHARDS = 16
POSTINGS_A_TASK = 1_000_000
PARTS_A_TASK = 16     # parts of a common term that one task writes
BLOCKS_AT_ONCE = 4096
QUESTIONS_AT_ONCE = 1024
SLACK = 1e-5          # floors are lowered by this; scores are compared on 6 places


def impact(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / avgdl))


def shard_of(term: Column, shards: int | Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(shards) if isinstance(shards, int) else shards).cast("int")


def with_tops(postings: DataFrame, avgdl: float, k1: float, b: float) -> DataFrame:
    """(term, df, top): how many documents a term is in and its highest impact."""
    return postings.groupBy("term").agg(
        F.count("*").alias("df"), F.max(impact(F.col("tf"), F.col("dl"), F.lit(avgdl), k1, b)).alias("top"))


def write_blocks(postings: DataFrame, terms: DataFrame, shards: int, avgdl: float, k1: float, b: float, path: str) -> None:
    """Blocks in folders by shard, sorted by term."""
    blocked(postings, terms, shards, avgdl, k1, b).write.mode("overwrite").partitionBy("shard").parquet(path)


def blocked(postings: DataFrame, terms: DataFrame, shards: int, avgdl: float, k1: float, b: float) -> DataFrame:
    """Stored postings as blocks (shard, term, level, part, top, entries(doc_id, impact)).

    Postings are shuffled once, as they are, to their term's shard. Only terms of several blocks need
    to be known before; they are over a thousandth as many as postings at most. Their parts are dealt over
    tasks of their own, so no task grows with a term.
    """
    spark = postings.sparkSession
    common = materialize(terms.where(F.col("df") > BLOCK).select(
        "term", F.col("top").alias("best"), F.ceil(F.col("df") / F.lit(BLOCK * LEVELS / 2)).alias("parts")), "common-terms")
    common = F.broadcast(common) if fits_broadcast(common) else common
    worth = impact(F.col("tf"), F.col("dl"), F.lit(avgdl), k1, b)
    # Levels are steps of the term's own range of impacts, 0 the best; parts keep a level's blocks small.
    level = F.when(F.col("parts").isNotNull(), F.floor((F.col("best") - worth) / F.col("best") * LEVELS)).otherwise(0).cast("int")
    part = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0)).cast("int")
    shard = shard_of(F.col("term"), shards)
    each = postings.join(common, "term", "left").select("term", level.alias("level"), part.alias("part"), "doc_id", "tf", "dl")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-postings.count() // POSTINGS_A_TASK))  # counted from the files' footers
    id_type = postings.schema["doc_id"].dataType.simpleString()
    order = ["term", "level", "part"]  # what is written is sorted by shard, which leaves this order within
    return (each.repartition(tasks, shard, F.floor(F.col("part") / PARTS_A_TASK)).withColumn("shard", shard)
            .sortWithinPartitions(*order).select("shard", *order, "doc_id", worth.alias("impact"))
            .mapInArrow(_grouped, "shard int, term string, level int, part int, top double, "
                                  f"entries array<struct<doc_id:{id_type},impact:double>>"))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted postings (shard, term, level, part, doc_id, impact) as a row per block. What the end of a batch leaves open goes on with the next."""
    names = ["shard", "term", "level", "part"]
    open_rows: list[pa.RecordBatch] = []

    def put_together(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(starts), BLOCKS_AT_ONCE):
            first = starts[a]
            end = starts[a + BLOCKS_AT_ONCE] if a + BLOCKS_AT_ONCE < len(starts) else len(rows)
            mine, at = rows.slice(first, end - first).combine_chunks(), starts[a:a + BLOCKS_AT_ONCE] - first
            doc_id, worth = (mine.column(c).combine_chunks() for c in ("doc_id", "impact"))
            entries = pa.ListArray.from_arrays(pa.array(np.append(at, end - first), pa.int32()), pa.StructArray.from_arrays(
                [doc_id, worth], fields=[pa.field("doc_id", doc_id.type), pa.field("impact", pa.float64())]))
            keys = [mine.column(c).combine_chunks().take(pa.array(at)) for c in names]
            tops = pa.array(np.maximum.reduceat(worth.to_numpy(), at))
            yield pa.RecordBatch.from_arrays([*keys, tops, entries], names=[*names, "top", "entries"])

    def changes(rows: pa.Table) -> np.ndarray:
        new = np.zeros(len(rows), bool)
        new[0] = True
        for c in names:
            column = rows.column(c).combine_chunks()
            new[1:] |= pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, len(rows) - 1)), True).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        if open_rows and all(batch.column(names.index(c))[batch.num_rows - 1].as_py() == open_rows[0].column(names.index(c))[0].as_py() for c in names):
            open_rows.append(batch)
            continue
        rows = pa.Table.from_batches([*open_rows, batch])
        starts = changes(rows)
        last = int(starts[-1])
        if last:
            yield from put_together(rows.slice(0, last), starts[:-1])
        open_rows = rows.slice(last).combine_chunks().to_batches()
    if open_rows:
        yield from put_together(pa.Table.from_batches(open_rows), np.array([0]))


def with_bounds(asked: pd.DataFrame) -> pd.DataFrame:
    """Adds what a term is worth and can add to a score at most, what a question's terms can together, and its seeds.

    ``asked(query_id, term, times, idf, df, top)`` is a measured, small block of questions.
    ``losses`` is what terms of negative idf may take away.
    """
    worth = asked["times"] * asked["idf"]
    most = worth * asked["top"]
    out = asked.assign(worth=worth, gain=most.clip(lower=0.0), losses=most.clip(upper=0.0)).sort_values(
        ["gain", "term"], ascending=[False, True], kind="stable")
    own = out.groupby("query_id")
    return out.assign(seed=own.cumcount() < SEEDS, all_gains=own["gain"].transform("sum"), losses=own["losses"].transform("sum"))


def pick_blocks(blocks: DataFrame, keys: DataFrame, few: list[str] | None, shards: int) -> DataFrame:
    """The blocks of some terms; folders and row groups of others are not read.

    ``keys`` has term, shard and columns to add. The scan's filter names the terms'
    folders and, where they are few, the terms.
    """
    folders = sorted({r[0] for r in keys.select("shard").collect()})
    if len(folders) < shards:
        blocks = blocks.where(F.col("shard").isin(folders))
    if few is not None:
        blocks = blocks.where(F.col("term").isin(few))
    return blocks.join(F.broadcast(keys), ["shard", "term"])


def _keys(spark: SparkSession, rows: pd.DataFrame, shards: int) -> tuple[DataFrame, list[str] | None]:
    """Local rows with a column term as a table with shards, and the terms where they are few."""
    terms = rows["term"].unique().tolist()
    table = spark.createDataFrame(pa.Table.from_pandas(rows, preserve_index=False)).withColumn("shard", shard_of(F.col("term"), shards))
    return table, terms if len(terms) <= LITERALS else None


def floors(asked: pd.DataFrame, blocks: DataFrame, shards: int, k: int) -> pd.Series:
    """What the k-th best score reaches at least, for questions with k documents in their seeds' first blocks."""
    seeds, few = _keys(blocks.sparkSession, asked[asked["seed"] & (asked["gain"] > 0)][["term", "query_id", "worth"]], shards)
    first = pick_blocks(blocks.where("level = 0 AND part = 0"), seeds, few, shards)
    partial = (first.select("query_id", "worth", F.inline("entries")).groupBy("query_id", "doc_id")
               .agg(F.sum(F.col("worth") * F.col("impact")).alias("partial")))
    best = top_rows(partial, "query_id", [F.desc("partial"), F.asc("doc_id")], k)
    found = best.where(F.col("rank") == k).select("query_id", "partial").toPandas()  # one row a question
    return found.set_index("query_id")["partial"] - SLACK


def wanted_terms(asked: pd.DataFrame, blocks: DataFrame, shards: int, k: int) -> pd.DataFrame:
    """(term, number, df, least): the asked terms and the impact below which their blocks need not be read."""
    # A floor is at most what the seeds can add. Where the other terms can always add that much, no block can be skipped.
    seeds = asked["gain"].where(asked["seed"], 0.0).groupby(asked["query_id"]).sum()
    room = asked["query_id"].map(seeds) - (asked["all_gains"] - asked["gain"])
    least = pd.Series(0.0, asked.index)
    if (room > 0).any():
        floor = asked["query_id"].map(floors(asked, blocks, shards, k)) + asked["losses"]
        reached = (floor - (asked["all_gains"] - asked["gain"])) / asked["worth"].where(asked["gain"] > 0)
        least = reached.fillna(0.0).clip(lower=0.0)
    rated = asked.assign(least=least).groupby("term", as_index=False).agg(df=("df", "first"), least=("least", "min"))
    return rated.assign(number=range(len(rated)))


def _best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the best k; of equal scores near the border, the first k each."""
    hit = np.flatnonzero(scores > 0)
    if len(hit) <= k:
        return hit
    border = np.partition(scores[hit], len(hit) - k)[len(hit) - k]
    near = hit[np.abs(scores[hit] - border) <= SLACK]
    order = np.argsort(scores[near], kind="stable")
    values = scores[near][order]
    first = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(values) != 0]), np.arange(len(values)), 0))
    return np.concatenate([hit[scores[hit] > border + SLACK], near[order[np.arange(len(values)) - first < k]]])


def best_scores(blocks: DataFrame, asked: pd.DataFrame, shards: int, k: int) -> DataFrame:
    """(query_id, doc_id, score) of all documents that may be among the best k, on 6 places; ``asked`` as from ``with_bounds``."""
    spark = blocks.sparkSession
    wanted = wanted_terms(asked, blocks, shards, k)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(wanted["df"].sum()) // POSTINGS_A_TASK))
    keys, few = _keys(spark, wanted[["term", "number", "least"]], shards)
    hits = (pick_blocks(blocks, keys, few, shards).where("top >= least")
            .select("number", F.inline("entries")).repartition(parts, "doc_id"))
    numbers = asked["term"].map(wanted.set_index("term")["number"])
    query_ids = pa.array(asked["query_id"].drop_duplicates())
    by_question = asked.assign(number=numbers).sort_values("number").groupby("query_id", sort=False)
    groups = {q: list(zip(g["number"].tolist(), g["worth"].tolist())) for q, g in by_question}
    questions = spark.sparkContext.broadcast([groups[q] for q in query_ids.to_pylist()])
    id_type, query_type = hits.schema["doc_id"].dataType.simpleString(), str(query_ids.type).replace("int64", "bigint").replace("int32", "int")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        got = pa.Table.from_batches(held)
        coded = got.column("doc_id").combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary)   # ties go to the first document
        ids = coded.dictionary.take(order)
        place = np.empty(len(ids), np.int64)
        place[order.to_numpy()] = np.arange(len(ids))
        docs, terms = place[coded.indices.to_numpy()], got.column("number").to_numpy()
        by_term = np.argsort(terms, kind="stable")
        docs, impacts, terms = docs[by_term], got.column("impact").to_numpy()[by_term], terms[by_term]
        names, starts = np.unique(terms, return_index=True)
        ends = np.append(starts[1:], len(terms))
        where = {t: slice(a, b) for t, a, b in zip(names.tolist(), starts.tolist(), ends.tolist())}
        found = []
        for query, own in enumerate(questions.value):
            scores = np.zeros(len(ids))
            for term, worth in own:
                at = where.get(term)
                if at is not None:
                    scores[docs[at]] += worth * impacts[at]
            best = _best_of(scores, k)
            found.append((np.full(len(best), query), best, scores[best]))
            if len(found) == QUESTIONS_AT_ONCE or query == len(questions.value) - 1:
                asked_by, places, values = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(asked_by)), ids.take(pa.array(places)), pa.array(values)],
                                                 names=["query_id", "doc_id", "score"])
                found = []

    return hits.mapInArrow(score, f"query_id {query_type}, doc_id {id_type}, score double").withColumn("score", F.round("score", 6))
