"""Mixing sources to target weights by Pareto order sampling.

Targets are words per source. Within a source every document has an expected
number of copies, c * size^POWER, at most MAX_COPIES, with c solved so that the
expected words meet the target: whole copies are certain, the rest is an
inclusion probability p. Documents then stand in Pareto order, by random odds
over inclusion odds, q = (u / (1 - u)) / (p / (1 - p)), and the sample is the
order's prefix that fits the words still wanted (the fixed size, in words);
what a document too large at the border leaves open is filled, in the same
order, by later documents that fit.

The border is found without sorting a source: words are summed per bucket of q,
buckets are summed along, and only the bucket at the border is ranked, so a
source with a third of all rows spreads over all tasks. Random numbers come
from a hash of the document id, so reruns and lost tasks agree.

Defined results: null and empty texts have size 0 and take 0; a null source is a
source of its own, last in order; repeated rows
are drawn each for itself; rows equal in id, source and size are numbered, and as
documents each takes the copies of its number. Where FILLS rounds are over, a source may stay
short of its target by less than the documents that were still too large; a null id draws like any other; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from folioquery.llm.common import SPACES, measured, read
from folioquery.operators.joins import with_positions
from folioquery.session import materialize

WEIGHTS = (5, 2, 1)     # of the sources in order, repeating
TOTAL = (3, 2)          # the mix is this share of all words
MAX_COPIES = 2
POWER = 0.5             # longer documents are likelier, by the root of their size
BUCKETS = 4096          # of the order, to find the border
FILLS = 4               # rounds that fill what is open at the border
STRETCH = 1 << 16       # equal rows that one task numbers
SEED = 20

WORD = SPACES.replace("[", "[^", 1)


def with_sizes(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.expr(f"CAST(coalesce(regexp_count(text, r'{WORD}'), 0) AS BIGINT)"))


def numbered_rows(sizes: DataFrame) -> DataFrame:
    """Adds ``_row``: 1, 2, ... among rows equal in doc_id, source and size, made from their counts.

    A count is spread over tasks in stretches, so many equal rows are no hot group.
    """
    counts = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("_c"))
    stretch = F.explode(F.expr(f"sequence(0L, (_c - 1) div {STRETCH} * {STRETCH}, {STRETCH}L)"))
    few = counts.where(F.col("_c") <= STRETCH).withColumn("_from", F.lit(0).cast("long"))
    many = counts.where(F.col("_c") > STRETCH).withColumn("_from", stretch).repartition("doc_id", "source", "size", "_from")
    return few.unionByName(many).select("doc_id", "source", "size", F.explode(F.sequence(
        F.col("_from") + 1, F.least(F.col("_c"), F.col("_from") + STRETCH))).alias("_row"))


def by_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join on the source, null included; ``right`` has one row per source."""
    right = right.withColumnRenamed("source", "_src")
    return left.join(measured(right), F.col("source").eqNullSafe(F.col("_src"))).drop("_src")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target): weighted shares, held at MAX_COPIES times the source, the excess reshared.

    The level that is shared per weight rises as sources reach their limit;
    each round is one aggregate over the sources, until no source newly reaches it.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = sums.withColumn("_null", F.col("source").isNull())
    ranked = with_positions(named, ["_null", "source"], "_rank").drop("_null")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.col("_rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighed = materialize(ranked.select("source", "source_size", weight.cast("double").alias("_w")), "mix-sources")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    goal, level, full = total * TOTAL[0] / TOTAL[1], 0.0, -1
    while True:
        held = F.col("_w") * level > MAX_COPIES * F.col("source_size")
        row = weighed.agg(F.sum(F.when(held, MAX_COPIES * F.col("source_size"))).alias("capped"),
                          F.sum(F.when(~held, F.col("_w"))).alias("w"), F.count(F.when(held, 1)).alias("n")).first()
        if row["n"] == full or not row["w"]:
            break
        full, level = row["n"], (goal - (row["capped"] or 0)) / row["w"]
    target = F.least(F.col("_w") * level, (MAX_COPIES * F.col("source_size")).cast("double"))
    return weighed.select("source", "source_size", target.alias("target"))


def expected_copies(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """Adds ``_e``: expected copies, so that a source's expected words meet its target.

    Documents over the limit are held there and c is raised for the rest. With all sizes
    above t held, c follows from sums along the sizes; the largest t that stays within the limit
    is the border. A source's sizes stand in one window: k sizes that differ are
    k * k / 2 words at least, so they grow with the root of the input.
    """
    x = F.pow(F.col("size").cast("double"), F.lit(POWER))
    some = sizes.where("size > 0")
    rated = by_source(some.groupBy("source", "size").agg(F.count("*").alias("_n")), goals)
    larger = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    c = (F.col("target") - F.coalesce(F.sum(MAX_COPIES * F.col("size") * F.col("_n")).over(larger), F.lit(0))) \
        / F.sum(x * F.col("size") * F.col("_n")).over(up_to)
    within = x * F.col("_c") <= MAX_COPIES
    scale = (rated.withColumn("_c", c).groupBy("source").agg(F.max_by("_c", F.when(within, F.col("size"))).alias("_c"))
             .withColumnRenamed("source", "_src2"))
    scaled = materialize(goals.join(scale, F.col("source").eqNullSafe(F.col("_src2"))).drop("_src2"), "mix-scale")
    held = F.lit(float(MAX_COPIES))
    return by_source(some, scaled).withColumn("_e", F.coalesce(F.least(x * F.col("_c"), held), held)).drop("_c")


def pareto_prefix(candidates: DataFrame) -> DataFrame:
    """The rows (_k, source, size) of the order's prefix within each source's words, ``_room``."""
    v = F.col("_q") / (1 + F.col("_q"))
    placed = candidates.withColumn("_b", F.least(F.floor(v * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    sums = placed.groupBy("source", "_b").agg(F.sum("size").alias("_s"), F.max("_room").alias("_room"))
    along = Window.partitionBy("source").orderBy("_b")  # at most BUCKETS rows a source
    run = sums.withColumn("_run", F.sum("_s").over(along))
    border = materialize(run.groupBy("source").agg(
        F.min(F.when(F.col("_run") > F.col("_room"), F.col("_b"))).alias("_edge"),
        F.max(F.when(F.col("_run") <= F.col("_room"), F.col("_run"))).alias("_before")), "mix-border")
    at = by_source(placed, border)
    whole = at.where("_edge IS NULL OR _b < _edge")
    inside = Window.partitionBy("source").orderBy("_q", "doc_id", "_row", "_k").rowsBetween(Window.unboundedPreceding, 0)
    part = (at.where("_b = _edge").withColumn("_cum", F.sum("size").over(inside) + F.coalesce("_before", F.lit(0)))
            .where("_cum <= _room"))
    keep = ["_k", "source", "size"]
    return whole.select(*keep).unionAll(part.select(*keep))


def mix(sizes: DataFrame) -> DataFrame:
    """(doc_id, source, size) to (doc_id, source, size, _row, source_size, target, _copies), a row per input row."""
    numbered = materialize(numbered_rows(sizes).withColumn("_k", F.monotonically_increasing_id()), "mix-sizes")
    goals = materialize(targets(numbered), "mix-targets")
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), "doc_id", "_row")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rated = expected_copies(numbered, goals).withColumn("_whole", F.floor("_e").cast("long"))
    p = F.col("_e") - F.col("_whole")
    rated = materialize(rated.withColumn("_q", F.when(p > 0, (u / (1 - u)) * F.try_divide(1 - p, p))).drop("_e"), "mix-order")
    open_ = rated.where("_whole < 2 AND _q IS NOT NULL").select("_k", "doc_id", "_row", "source", "size", "_q")
    room = materialize(rated.groupBy("source").agg(F.max("target").alias("target"), F.sum(F.col("_whole") * F.col("size")).alias("_got"))
                       .select("source", (F.col("target") - F.col("_got")).alias("_room")), "mix-room")
    taken = None
    for _ in range(FILLS):
        left = open_ if taken is None else open_.join(taken.select("_k"), "_k", "left_anti")
        new = materialize(pareto_prefix(by_source(left, room).where("size <= _room")), "mix-taken")
        more = new.groupBy("source").agg(F.sum("size").alias("_add")).withColumnRenamed("source", "_src2")
        taken = new if taken is None else taken.unionAll(new)
        room = materialize(room.join(more, F.col("source").eqNullSafe(F.col("_src2")), "left")
                           .select("source", (F.col("_room") - F.coalesce("_add", F.lit(0))).alias("_room")), "mix-room")
    counted = rated.select("_k", "_whole").join(taken.select("_k", F.lit(1).alias("_one")), "_k", "left").select(
        "_k", (F.col("_whole") + F.coalesce("_one", F.lit(0))).alias("_copies"))
    return by_source(numbered, goals).join(counted, "_k", "left").fillna(0, ["_copies"]).drop("_k")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix(with_sizes(docs).drop("text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("_copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every document as often as the mix takes it; columns as they came.

    Rows whose id, source and size are met once are joined by them; only the others are
    written, numbered along a range sort, and joined by number.
    """
    sized = with_sizes(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "doc_id", "source", "text")).drop("text")
    copies = materialize(mix(sized.select("doc_id", "source", "size")).select("doc_id", "source", "size", "_row", "_copies"), "mix-copies")
    copies = copies.withColumnsRenamed({"doc_id": "_i", "source": "_s", "size": "_n"})
    same = F.col("doc_id").eqNullSafe(F.col("_i")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_n"))
    times = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
    by_key = copies.groupBy("_i", "_s", "_n").agg(F.count("*").alias("_c"), F.max("_copies").alias("_copies"))
    single = materialize(by_key.where("_c = 1 AND _copies > 0").drop("_c"), "mix-single")
    once = sized.join(measured(single), same).select("_doc", times.alias("_time")).select("_doc.*")
    repeated = materialize(by_key.where("_c > 1 AND _copies > 0").select("_i", "_s", "_n"), "mix-repeated")
    if repeated.isEmpty():
        return once
    held = materialize(sized.join(repeated, same, "left_semi").withColumn("_id", F.monotonically_increasing_id())
                       .withColumn("_j", F.xxhash64(F.to_json("_doc"))), "mix-equal")
    key = ["doc_id", "source", "size"]
    placed = with_positions(held.select(*key, "_j", "_id"), [*key, "_j", "_id"], "_at")
    low = placed.groupBy(*key).agg(F.min("_at").alias("_low")).withColumnsRenamed({"doc_id": "_i", "source": "_s", "size": "_n"})
    number = placed.join(low, same).select(*key, "_id", (F.col("_at") - F.col("_low") + 1).alias("_at"))
    taken = number.join(copies.where("_copies > 0"), same & (F.col("_at") == F.col("_row"))).select("_id", "_copies")
    return once.unionAll(held.join(taken, "_id").select("_doc", times.alias("_time")).select("_doc.*"))
