"""Near-duplicate vectors by sorted projection passes.

Each pass hashes a vector to a string of random hyperplane signs and orders all
vectors of a label lexicographically by it; every vector is compared with its
WINDOW predecessors in that order, and verified links are united over rounds of PASSES
passes. The order is a range sort by (pass, label, key), so a label with a third
of all rows spreads over many tasks; the rows at both sides of a border between tasks
are compared too. The second round and those after it hash what a vector has besides the
mean of its label, and a label goes on as long as a round unites groups of it. A group too dense for a window stays
connected through its neighbours; links are then counted exactly inside each
component, in pairs of blocks of bounded size, and only counts leave a task.

What the windows cannot give: a link whose two ends never come near each other in
any pass and are not joined through others. For cosine 0.98 a sign differs with
probability 0.064, and the more alike a label's vectors are, the more bits two ends must
share to meet; so no number of passes is fixed. Labels that fit into a window are
exact; tests measure recall, also in a dense label.

Defined results: rows with null id or label, null, empty, zero or non-finite
vectors link with nothing, stand alone and are kept; vectors of different lengths do not
link; equal vectors are one class that is compared once, each member counting;
repeated ids are one vector each but share a row of the result per input row;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioquery.llm.common import components, local_components, measured, read, whole_groups
from folioquery.session import materialize

THRESHOLD = 0.98
PASSES = 16
BITS = 64
WINDOW = 64
BLOCK = 1024
SEED = 8


def _unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in rows])
    x /= np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """Vectors that can link: (vec_id, label, dim, embedding)."""
    return (vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
            .where("NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")
            .where("exists(embedding, x -> x != 0)")
            .select("vec_id", "label", F.size("embedding").alias("dim"), "embedding"))


def label_means(vectors: DataFrame) -> DataFrame:
    """(label, dim, mean) of the unit vectors of labels that do not fit into a window."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (label, dim), rows in batch.groupby(["label", "dim"]):
                total = sum(_unit(rows["embedding"].iloc[a:a + 4096]).sum(0) for a in range(0, len(rows), 4096))
                yield pd.DataFrame({"label": [label], "dim": [dim], "n": [len(rows)], "total": [total]})

    def means(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, total = None, 0, 0.0
        for batch in batches:
            for row in batch.itertuples():
                if now not in (None, (row.label, row.dim)):
                    yield pd.DataFrame({"label": [now[0]], "dim": [now[1]], "n": [n], "mean": [total / n]})
                    n, total = 0, 0.0
                now, n, total = (row.label, row.dim), n + row.n, total + np.asarray(row.total)
        if now is not None:
            yield pd.DataFrame({"label": [now[0]], "dim": [now[1]], "n": [n], "mean": [total / n]})

    parts = vectors.mapInPandas(sums, "label int, dim int, n long, total array<double>")
    return (parts.repartition("label", "dim").sortWithinPartitions("label", "dim")
            .mapInPandas(means, "label int, dim int, n long, mean array<double>").where(F.col("n") > WINDOW + 1).drop("n"))


def _pass_keys(turn: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, rows in batch.groupby("dim"):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, dim, turn] if turn else [SEED, dim]).standard_normal((dim, PASSES * BITS))
                for a in range(0, len(rows), 4096):
                    part = rows.iloc[a:a + 4096]
                    x = _unit(part["embedding"]) - np.stack(part["mean"].to_list()) if turn else _unit(part["embedding"])
                    signs = (x @ planes[dim] > 0).reshape(len(part), PASSES, BITS)
                    keys = np.packbits(signs, axis=2)
                    for p in range(PASSES):
                        yield pd.DataFrame({"pass": p, "label": part["label"], "dim": dim,
                                            "key": [k.tobytes() for k in keys[:, p]], "vec_id": part["vec_id"],
                                            "embedding": part["embedding"]})
    return run


def _linked(rows: pd.DataFrame) -> pd.DataFrame:
    """Edges (a, b, label, dim) that connect what links within the windows of rows in order."""
    group = rows[["pass", "label", "dim"]].to_numpy()
    cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1), len(rows)]
    ids, a, b = rows["vec_id"].to_numpy(), [], []
    for lo, hi in zip(cuts, cuts[1:]):
        x = _unit(rows["embedding"].iloc[lo:hi])
        i, j = np.nonzero(np.tril(x @ x.T >= THRESHOLD, -1))
        near = i - j <= WINDOW
        a.append(i[near] + lo)
        b.append(j[near] + lo)
    label = local_components(len(rows), np.concatenate(a), np.concatenate(b))
    moved = np.flatnonzero(label != np.arange(len(rows)))
    return pd.DataFrame({"a": ids[moved], "b": ids[label[moved]], "label": group[moved, 1], "dim": group[moved, 2]})


LINKS = "a long, b long, label int, dim int"
BORDER = ["pass", "vec_id", "embedding"]
PASSED = LINKS + ", border int, place int, pass int, vec_id long, embedding array<float>"


def _window_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges within a partition, and its first and last rows for the borders to its neighbours."""
    tail, head, task = None, 0, TaskContext.get().partitionId()

    def border(rows: pd.DataFrame, k: int, place: int) -> pd.DataFrame:
        return pd.DataFrame({"a": pd.array([pd.NA] * len(rows), "Int64"), "b": pd.array([pd.NA] * len(rows), "Int64"), "label": rows["label"].array,
                             "dim": rows["dim"].array, "border": k, "place": np.arange(len(rows)) + place, **{c: rows[c].array for c in BORDER}})

    for batch in batches:
        for start in range(0, len(batch), 2048):
            rows = batch.iloc[start:start + 2048][["pass", "label", "dim", "vec_id", "embedding"]]
            if head < WINDOW:
                yield border(rows.iloc[:WINDOW - head], task - 1, WINDOW + head)
                head += min(len(rows), WINDOW - head)
            rows = rows if tail is None else pd.concat([tail, rows], ignore_index=True)
            found = _linked(rows)
            if len(found):
                none = pd.array([pd.NA] * len(found), "Int64")
                yield found.assign(border=none, place=none, **{"pass": none, "vec_id": none, "embedding": None})
            tail = rows.iloc[-WINDOW:]
    if tail is not None:
        yield border(tail, task, 0)


def _border_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in whole_groups(batches, ["border"]):
        for _, rows in frame.groupby("border"):
            yield _linked(rows)


def window_edges(vectors: DataFrame, turn: int = 0) -> DataFrame:
    """Edges (a, b, label, dim) of a round; from the second on, vectors have the ``mean`` of their label."""
    keyed = vectors.mapInPandas(_pass_keys(turn), "pass int, label int, dim int, key binary, vec_id long, embedding array<float>")
    order = ["pass", "label", "dim", "key", "vec_id"]
    passed = materialize(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_window_links, PASSED), "vector-windows")
    borders = (passed.where("border IS NOT NULL").repartition("border").sortWithinPartitions("border", "place")
               .mapInPandas(_border_links, LINKS))
    return passed.where("border IS NULL").select("a", "b", "label", "dim").unionAll(borders).where("a != b").distinct()


def window_components(vectors: DataFrame) -> DataFrame:
    """(id, component) by rounds of passes, each over the labels in which the one before united groups; two at least."""
    nodes = vectors.select(F.col("vec_id").alias("id"))
    links = materialize(window_edges(vectors), "vector-links")
    groups = materialize(components(nodes, links, "vector"), "vector-components")
    means, turn = materialize(label_means(vectors), "vector-means"), 1
    while not means.isEmpty():
        centred = vectors.join(measured(means), ["label", "dim"])
        found = window_edges(centred, turn)
        for end in ("a", "b"):
            found = found.join(groups.select(F.col("id").alias(end), F.col("component").alias(f"_{end}")), end)
        found = materialize(found.where("_a != _b").select("a", "b", "label", "dim"), "vector-links")
        if found.isEmpty():
            break
        links = links.unionAll(found)
        groups = materialize(components(nodes, links, "vector"), "vector-components")
        means = means.join(found.select("label", "dim").distinct(), ["label", "dim"], "left_semi")
        turn += 1
    return groups


def _block_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links per vector of each unit: a block with itself, or one block with another."""
    for frame in whole_groups(batches, ["component", "i", "j"]):
        for (_, i, j), rows in frame.groupby(["component", "i", "j"]):
            x, ids = _unit(rows["embedding"]), rows["vec_id"].to_numpy()
            weight, block = rows["weight"].to_numpy(), rows["block"].to_numpy()
            if i == j:
                linked = x @ x.T >= THRESHOLD
                np.fill_diagonal(linked, False)
                yield pd.DataFrame({"vec_id": ids, "n": linked @ weight})
            else:
                left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
                linked = x[left] @ x[right].T >= THRESHOLD
                yield pd.DataFrame({"vec_id": np.concatenate([ids[left], ids[right]]),
                                    "n": np.concatenate([linked @ weight[right], weight[left] @ linked])})


def link_counts(members: DataFrame) -> DataFrame:
    """(vec_id, n): summed weight of the vectors linked directly, for (vec_id, component, weight, embedding)."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 0")
    placed = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    units = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.withColumn("i", F.least("block", "_o")).withColumn("j", F.greatest("block", "_o")).drop("_o", "blocks")
    keys = ["component", "i", "j"]
    return (units.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_block_counts, "vec_id long, n long")
            .groupBy("vec_id").agg(F.sum("n").alias("n")))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, label) to (vec_id, n_links, component_id, kept)."""
    good = usable(vectors).withColumn("_h", F.xxhash64("label", "embedding")).withColumn("_g", F.hash("embedding"))
    same = ["label", "dim", "_h", "_g"]
    classes = good.groupBy(*same).agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"))
    member = materialize(good.drop("embedding").join(classes, same).select("vec_id", "first", "weight"), "vector-classes")
    firsts = materialize(good.join(member.where("vec_id = first").select("vec_id", "weight").distinct(), "vec_id")
                         .select("vec_id", "label", "dim", "embedding", "weight").dropDuplicates(["vec_id"]), "vector-firsts")
    groups = window_components(firsts).withColumnRenamed("id", "vec_id")
    shared = groups.groupBy("component").agg(F.count("*").alias("_n")).where("_n > 1").select("component")
    inside = firsts.join(groups, "vec_id").join(shared, "component").select("vec_id", "component", "weight", "embedding")
    of_class = groups.join(link_counts(inside), "vec_id", "left").select(F.col("vec_id").alias("first"), "component", "n")
    found = member.distinct().join(of_class, "first").select(
        "vec_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("_links"), "component")
    return vectors.select("vec_id").join(found, "vec_id", "left").select(
        "vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"))


def op8_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = id LEFT JOIN n ON vec_id = a"""
