"""Exact nearest neighbours.

Vectors stay where they are: every task multiplies its Arrow batches with the
block of question vectors and keeps k candidates per question, so only
tasks x questions x k rows are shuffled. The question block is shipped to the
tasks only when it is small; past that bound questions are cut into blocks and
meet the vectors in a grid of evenly sized groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from folioquery.functions import fixed_values as fv
from folioquery.operators.joins import top_rows

MAX_SHIPPED_QUESTIONS = 16_384
MAX_SHIPPED_BYTES = 64 * 1024 * 1024
BLOCK_QUESTIONS = 4_096
GRID_VECTORS = 50_000
_CHUNK = 1_024
METRICS = ("l2", "cosine", "dot")


def _scores(q: np.ndarray, m: np.ndarray, metric: str) -> np.ndarray:
    dot = q @ m.T
    if metric == "dot":
        return dot
    q2 = np.einsum("ij,ij->i", q, q)[:, None]
    m2 = np.einsum("ij,ij->i", m, m)[None, :]
    if metric == "cosine":
        length = np.sqrt(q2 * m2)
        return np.divide(dot, length, out=np.zeros_like(dot), where=length > 0)
    return np.maximum(q2 + m2 - 2.0 * dot, 0.0)


class _Best:
    """The best k (score, id) per question over the batches seen so far, as flat arrays."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, k: int, metric: str):
        self.qids, self.q, self.k, self.metric = qids, q, k, metric
        self.sign = 1.0 if metric == "l2" else -1.0
        self.rows, self.keys, self.ids = np.empty(0, np.int64), np.empty(0), None

    def add(self, ids: np.ndarray, m: np.ndarray) -> None:
        ids = ids.astype(str) if ids.dtype == object else ids
        rows, keys, names = [self.rows], [self.keys], [ids[:0] if self.ids is None else self.ids]
        for start in range(0, len(self.qids), _CHUNK):
            block = np.round(_scores(self.q[start:start + _CHUNK], m, self.metric), 6) * self.sign
            k = min(self.k, block.shape[1])
            bound = np.partition(block, k - 1, axis=1)[:, k - 1:k]
            row, column = np.nonzero(block <= bound)  # keeps ties at the bound
            rows.append(row + start)
            keys.append(block[row, column])
            names.append(ids[column])
        rows, keys, names = np.concatenate(rows), np.concatenate(keys), np.concatenate(names)
        order = np.lexsort((names, keys, rows))
        rows = rows[order]
        first = np.searchsorted(rows, rows, side="left")
        best = np.arange(len(rows)) - first < self.k
        self.rows, self.keys, self.ids = rows[best], keys[order][best], names[order][best]

    def frame(self) -> pd.DataFrame:
        ids = [] if self.ids is None else self.ids.tolist()
        return pd.DataFrame({"query_id": self.qids[self.rows], "chunk_id": ids, "score": self.keys * self.sign})


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _output_schema(queries: DataFrame, vectors: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("chunk_id", vectors.schema["chunk_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])


def _shipped(rows: list, vectors: DataFrame, k: int, metric: str, schema: T.StructType) -> DataFrame:
    qids = np.array([r["query_id"] for r in rows])
    q = np.array([r["vec"] for r in rows], dtype=np.float64)
    held = vectors.sparkSession.sparkContext.broadcast((qids, q))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(*held.value, k, metric)
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                best.add(ids, _matrix(batch.column(1)))
        if len(best.rows):
            yield pa.RecordBatch.from_pandas(best.frame(), preserve_index=False, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    return vectors.select("chunk_id", "vec").mapInArrow(search, schema)


def _grid(queries: DataFrame, vectors: DataFrame, k: int, metric: str, schema: T.StructType) -> DataFrame:
    n_blocks = -(-queries.count() // BLOCK_QUESTIONS)
    n_cells = max(1, -(-vectors.count() // GRID_VECTORS))
    blocks = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))) \
        .withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(n_cells - 1))))
    cells = vectors.withColumn("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(n_cells)).cast("int")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<bigint>")))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({f.name: [] for f in schema.fields})
        best = _Best(left["query_id"].to_numpy(), np.stack(left["vec"].to_numpy()).astype(np.float64), k, metric)
        best.add(right["chunk_id"].to_numpy(), np.stack(right["vec"].to_numpy()).astype(np.float64))
        return best.frame()

    return blocks.groupBy("block", "cell").cogroup(cells.groupBy("block", "cell")) \
                 .applyInPandas(search, schema)


def _usable() -> Column:
    """Vectors that can be compared: present, and every component a number."""
    return F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x))


def knn(queries: DataFrame, vectors: DataFrame, k: int = 2 * fv.TOP_K, metric: str = "l2",
        max_shipped: int = MAX_SHIPPED_QUESTIONS) -> DataFrame:
    """queries(query_id, vec), vectors(chunk_id, vec) -> (query_id, chunk_id, score, rank).

    ``l2`` scores are squared distances, smallest first; ``cosine`` and ``dot``
    are similarities, largest first. Scores are rounded to 6 places, ties go to
    the smaller id. Vectors that are NULL, empty or hold NULL or NaN take no
    part; the cosine of a zero vector with any other is 0.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    schema = _output_schema(queries, vectors)
    queries, vectors = queries.where(_usable()), vectors.where(_usable())
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    if not size["n"]:
        return vectors.sparkSession.createDataFrame([], schema.add("rank", T.IntegerType()))
    if size["n"] <= max_shipped and size["n"] * size["dim"] * 8 <= MAX_SHIPPED_BYTES:
        head = queries.select("query_id", "vec").collect()  # measured
        near = _shipped(head, vectors, k, metric, schema)
    else:
        near = _grid(queries, vectors, k, metric, schema)
    first = F.asc("score") if metric == "l2" else F.desc("score")
    return top_rows(near.withColumn("score", F.round("score", 6)), "query_id",
                    [first, F.asc("chunk_id")], k)


def normalize(vec):
    """Scale an array column to unit length."""
    return F.transform(vec, lambda x: x.cast("double") / vector_norm(vec))


def vector_norm(vec):
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
