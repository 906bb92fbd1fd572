"""Joins and orderings that stay safe when one side or one key is huge."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from folioquery.session import materialize

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32


def _row_bytes(df: DataFrame):
    """Rough size of a row: text by length, plain values by 8, the rest as JSON."""
    total = F.lit(0)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(f.name), F.lit(0)) + 16
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0))
        else:
            total = total + 8
    return total


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS,
                   max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure, before hinting, that a side is small. Counted where the rows are."""
    size = df.agg(F.count("*").alias("n"), F.sum(_row_bytes(df)).alias("bytes")).first()
    return size["n"] <= max_rows and (size["bytes"] or 0) <= max_bytes


def join_small(big: DataFrame, small: DataFrame, key: str, hot: str | None = None,
               spread: str | None = None, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join that broadcasts ``small`` only after measuring it.

    Past the bound both sides are shuffled. ``hot`` names a boolean column of
    ``small`` that marks heavy keys: those are replicated over salts and the
    big side's rows of the same key are spread over them by ``spread``.
    """
    if fits_broadcast(small, max_rows):
        return big.join(F.broadcast(small), key)
    if hot is None:
        return big.join(small, key)
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    one = F.array(F.lit(0))
    salted = small.withColumn("salt", F.explode(F.when(F.col(hot), every).otherwise(one)))
    hot_keys = small.where(hot).select(key).distinct().withColumn("is_hot", F.lit(True))
    spread_out = (
        big.join(hot_keys, key, "left")
        .withColumn("salt", F.when(F.col("is_hot"), F.pmod(F.hash(spread), F.lit(SALTS)))
                    .otherwise(F.lit(0)))
        .drop("is_hot")
    )
    return spread_out.join(salted, [key, "salt"]).drop("salt")


def pick_rows(store: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a large store whose key is wanted.

    While the wanted keys are few they are broadcast and the store is not
    shuffled. The check counts the keys as given, duplicates included.
    """
    keys = ids.select(key)
    wanted = keys.distinct()
    return store.join(F.broadcast(wanted) if fits_broadcast(keys) else wanted, key, "left_semi")


def top_rows(df: DataFrame, key, order: list, k: int, rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per key, ranked from 1.

    The filter on row_number lets Spark cut every partition to k rows per key
    before the shuffle, so a hot key costs k rows per task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))) \
             .where(F.col(rank) <= k)


def with_positions(df: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """Number rows 1..n in a total order without one task seeing them all.

    A range sort spreads the rows, each task numbers its own range, and the
    per-range counts (one row per task) are summed to give every range its
    offset. The sorted rows are written first so both uses see the same ranges.
    """
    ranged = df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id())
    kept = materialize(ranged, "ordered")
    part = F.shiftright("_slot", 33)
    counts = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = F.col("_slot") - F.shiftleft(part, 33)
    return (
        kept.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_base") + local + 1)
        .drop("_part", "_base", "_slot")
    )
