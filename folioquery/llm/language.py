"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is its words: runs of letters in lower case, each with a mark at either
end. Features are the n-grams of 1 to 4 characters that reach over no mark, hashed to
BUCKETS buckets (a power of two). Training counts (language, bucket) where the
texts are, sums the counts in Spark, and turns them into a matrix of log
probabilities: languages times buckets, whatever the corpus. The matrix is broadcast, its
size bounded by MATRIX entries, and languages beyond that are scored in blocks.
Scoring takes the n-grams of a batch of texts as the rows of a sparse
matrix and multiplies it with the dense one, by gathering and adding.

Long texts are cut at spaces into slices that lose no n-gram. Defined results:
a null text, or one without a letter, is ``und`` with score 0, as is every text where
nothing was learned; ties go to the first language in code point order;
repeated rows count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioquery.llm.common import read
from folioquery.session import materialize

ORDERS = 4
BUCKETS = 1 << 16
MATRIX = 1 << 24        # most entries (float32) of one broadcast matrix
SMOOTH = 0.1            # added to every count
SLICE = 1 << 19         # characters hashed at once
TEXTS = 512             # texts hashed at once
UNKNOWN = "und"

_LETTERS = None


def _letters() -> np.ndarray:
    """Which code points are letters; made once in each worker."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def _slices(text: str) -> Iterator[str]:
    """A text in parts of about SLICE characters, cut at a space where there is one."""
    at = 0
    while len(text) - at > SLICE:
        cut = text.rfind(" ", at + 1, at + SLICE)
        cut = cut if cut > 0 else at + SLICE
        yield text[at:cut]
        at = cut
    yield text[at:]


def _packs(texts: pa.Array) -> Iterator[tuple[list[str], list[int]]]:
    """Slices and the rows they come from, some at a time."""
    parts, rows, size = [], [], 0
    for row, value in enumerate(texts):
        for part in _slices(value.as_py() or ""):
            if parts and (size + len(part) > SLICE or len(parts) == TEXTS):
                yield parts, rows
                parts, rows, size = [], [], 0
            parts.append(part)
            rows.append(row)
            size += len(part)
    if parts:
        yield parts, rows


def grams(parts: list[str], buckets: int = BUCKETS, orders: int = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """(part number, bucket) of every n-gram of some texts; part numbers do not fall within an order."""
    lower = [f" {p.lower()} " for p in parts]
    ends = np.cumsum([len(p) for p in lower])
    chars = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[chars]
    keep = letter.copy()
    keep[1:] |= letter[:-1]   # the mark behind a word,
    keep[:-1] |= letter[1:]   # and the one before
    part = np.searchsorted(ends, np.flatnonzero(keep), side="right").astype(np.int32)
    seq, inner = np.where(letter, chars, 0)[keep].astype(np.uint64), letter[keep]
    at, where = [part[inner]], [seq[inner]]
    code, valid = seq, inner
    for n in range(2, orders + 1):
        code = code[:-1] * np.uint64(0x100000001B3) + seq[n - 1:]
        # All characters but the first and the last are letters; of two, one is.
        valid = inner[:-1] | inner[1:] if n == 2 else inner[1:-1] if n == 3 else valid[:-1] & inner[n - 2:-1]
        same = valid & (part[:len(code)] == part[n - 1:])
        at.append(part[:len(code)][same])
        where.append(code[same] ^ np.uint64(n << 56))
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    spread = [((h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)) >> shift for h in where]
    return np.concatenate(at), np.concatenate(spread).astype(np.int64)


def counts(labelled: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(text, lang) to (lang, bucket, n): summed in every task first, at most ``buckets`` rows a language and task."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for parts, rows in _packs(batch.column(0)):
                at, where = grams(parts, buckets)
                names = sorted({langs[r] for r in rows})
                code = np.array([names.index(langs[r]) for r in rows])
                both = np.bincount(code[at] * buckets + where, minlength=len(names) * buckets).reshape(len(names), buckets)
                for name, row in zip(names, both):
                    sums[name] = sums[name] + row if name in sums else row
                if len(sums) * buckets > MATRIX:  # very many languages: hand them on
                    yield from _sparse(sums)
                    sums = {}
        yield from _sparse(sums)

    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    return rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _sparse(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for name, row in sums.items():
        where = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(where), pa.string()), pa.array(where.astype(np.int32)),
                                          pa.array(row[where].astype(np.int64))], names=["lang", "bucket", "n"])


class Model:
    """Languages in code point order and, per block of them, a matrix [bucket, language] of log probabilities."""

    def __init__(self, spark: SparkSession, langs: list[str], priors: list[float], counted: DataFrame, buckets: int = BUCKETS):
        self.spark, self.langs, self.priors, self.counted, self.buckets = spark, langs, np.array(priors), counted, buckets
        self.step = max(1, MATRIX // buckets)

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        """Blocks of at most MATRIX entries, one after the other on the driver."""
        for first in range(0, len(self.langs), self.step):
            names = self.langs[first:first + self.step]
            table = np.zeros((len(names), self.buckets))
            wanted = self.counted if len(names) == len(self.langs) else self.counted.where(F.col("lang").isin(names))
            got = wanted.toArrow()
            place = {name: k for k, name in enumerate(names)}
            coded = got.column("lang").combine_chunks().dictionary_encode()
            rows = np.array([place[v] for v in coded.dictionary.to_pylist()], int)
            if len(rows):
                table[rows[coded.indices.to_numpy()], got.column("bucket").to_numpy()] = got.column("n").to_numpy()
            logs = np.log(table + SMOOTH) - np.log(table.sum(1, keepdims=True) + SMOOTH * self.buckets)
            yield first, np.ascontiguousarray(logs.T.astype(np.float32))


def train(labelled: DataFrame, buckets: int = BUCKETS) -> Model:
    """A model of rows (text, lang); rows with a null in either teach nothing."""
    usable = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    seen = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").toArrow()  # one row a language
    n = seen.column("n").to_numpy().astype(float)
    return Model(labelled.sparkSession, seen.column("lang").to_pylist(), list(np.log(n / max(n.sum(), 1))),
                 materialize(counts(usable, buckets), "language-counts"), buckets)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``language(lang_pred, score)``; the score is the posterior probability."""
    names = [f"`{c}`" for c in docs.columns]
    packed = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.col(text).alias("text"))
    parts = packed.select("row", "text", F.lit(None).cast("struct<best:int,top:double,sum:double,letters:boolean>").alias("so_far"))
    for first, matrix in model.blocks():
        parts = _score_block(parts, model.spark.sparkContext.broadcast(matrix), first, model.priors, model.buckets)
    langs = F.array(*[F.lit(x) for x in model.langs]) if model.langs else F.expr("CAST(array() AS array<string>)")
    known = F.coalesce(F.col("so_far.letters"), F.lit(False))
    return parts.select("row.*", F.struct(
        F.when(known, F.get(langs, F.col("so_far.best"))).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, 1 / F.col("so_far.sum")).otherwise(0.0).alias("score")).alias("language"))


def _score_block(parts: DataFrame, matrix, first: int, priors: np.ndarray, buckets: int) -> DataFrame:
    """Adds a block of languages to what is known so far: the best one, its log score, the sum of all relative to it."""
    def score(texts: pa.Array, so_far: pa.Array) -> pa.Array:
        logs = matrix.value
        total = np.zeros((len(texts), logs.shape[1]))
        letters = np.zeros(len(texts), bool)
        for pack, rows in _packs(texts):
            at, where = grams(pack, buckets)
            if not len(at):
                continue
            # Rows of the sparse matrix are stretches of one part; there is one stretch a part and order.
            starts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
            sums = np.add.reduceat(logs[where], starts, axis=0, dtype=np.float64)
            owner = np.asarray(rows)[at[starts]]
            np.add.at(total, owner, sums)
            letters[owner] = True
        total += priors[first:first + logs.shape[1]]
        best = total.argmax(1)
        top = total[np.arange(len(total)), best]
        share = np.exp(total - top[:, None]).sum(1)
        best = best + first
        if first:
            old = so_far.field("best").to_numpy(zero_copy_only=False), so_far.field("top").to_numpy(), so_far.field("sum").to_numpy()
            keep = old[1] >= top
            high = np.where(keep, old[1], top)
            share = share * np.exp(top - high) + old[2] * np.exp(old[1] - high)
            best, top = np.where(keep, old[0], best), high
        return pa.StructArray.from_arrays([pa.array(best.astype(np.int32)), pa.array(top), pa.array(share), pa.array(letters)],
                                          names=["best", "top", "sum", "letters"])

    scored = F.arrow_udf(score, "struct<best:int,top:double,sum:double,letters:boolean>")
    return parts.withColumn("so_far", scored("text", "so_far"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with null ids are learned from."""
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = train(docs.where(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "language.*")
