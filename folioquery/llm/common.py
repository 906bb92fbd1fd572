"""What several operators share: word splitting, table reading, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioquery.operators.joins import fits_broadcast
from folioquery.session import materialize

# White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_sql(text: str = "text") -> str:
    """SQL of a text's words; null counts as empty."""
    return f"array_remove(split(coalesce({text}, ''), r'{SPACES}'), '')"


def measured(df: DataFrame) -> DataFrame:
    """A join side that is broadcast only once its size is measured; beyond the bound it is shuffled."""
    return F.broadcast(df) if fits_broadcast(df) else df


def components(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Smallest id reachable from each node: rows (id, component).

    ``nodes`` has ``id``; ``edges`` has ``a`` and ``b``. Large-star and small-star
    rounds (each a shuffle by node) run until the edge set no longer changes;
    every round is written to the shared folder, so no lineage grows and lost
    executors cost a re-read. Star rounds aggregate a minimum per node and
    never gather a node's neighbours, so a hub is no hot group.
    """
    current = materialize(
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    state = _fingerprint(current)
    while state[0]:
        current = materialize(_small_star(_large_star(current)), f"{name}-edges")
        now = _fingerprint(current)
        if now == state:
            break
        state = now
    roots = current.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("_root"))
    return nodes.join(roots, "id", "left").select("id", F.coalesce("_root", "id").alias("component"))


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour to the smallest one."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    return (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
            .where("a != b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour, and the node itself, to the smallest one."""
    least = edges.groupBy("a").agg(F.min("b").alias("_m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return moved.unionAll(least.select("a", F.col("_m").alias("b"))).where("a != b").distinct()


def whole_groups(batches, keys: list[str], rows: int = 20_000):
    """Cuts a stream sorted by ``keys`` into frames of about ``rows`` rows that never split a group."""
    import pandas as pd
    held: list = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < rows:
            continue
        frame = pd.concat(held, ignore_index=True)
        last = (frame[keys] != frame[keys].iloc[-1]).any(axis=1).to_numpy().nonzero()[0]
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield frame.iloc[:cut].reset_index(drop=True)
        held = [frame.iloc[cut:]]
    if held and sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def local_components(n: int, a, b):
    """Smallest reachable index of each of ``n`` items linked by index arrays ``a`` and ``b``."""
    import numpy as np
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label
