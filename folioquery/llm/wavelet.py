"""Token ids as wavelet matrices: succinct bit planes with rank and select, one compressed file per shard.

File format: a folder of Parquet files (zstd), one file per shard, that is per
range of document ids; any store Spark writes to will do, and a lost task's
file is written again by Spark's commit protocol. A file's rows are blocks of
about BLOCK tokens, whole documents each:

``part``, ``block``  place of the shard and of the block in it
``n_tokens``         tokens of the block
``doc_ids``          64-bit ids of the documents (null ids as 0, flagged in ``null_ids``)
``lengths``          64-bit token counts of the documents
``planes``           the wavelet matrix (see ``WaveletMatrix.to_bytes``)

Defined results: null and empty texts hold the end id only; rows of one id
stand in order of their text, equal rows one after the other; an empty table
gives no blocks and no rows; other columns are ignored. A document longer than
a block is a block of its own.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from folioquery.llm.common import read
from folioquery.operators.joins import fits_broadcast
from folioquery.session import new_table_path

END_ID = 1
BLOCK = 1 << 18          # tokens a block is closed at
STEP = 512               # bits between two entries of a rank directory
JOINED = 256             # words of letters encoded as one string
WORDS_KEPT = 500_000     # encoded words a worker remembers; then it starts afresh
TEXTS_AT_ONCE = 1 << 21  # bytes of text encoded together

BLOCKS = ("part int, block int, n_tokens long, n_docs long, doc_ids binary, null_ids binary, lengths binary, "
          "planes binary")
BLOCK_SCHEMA = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()),
                          *[(c, pa.binary()) for c in ("doc_ids", "null_ids", "lengths", "planes")]])


class WaveletMatrix:
    """A sequence of ids below 2**bits, as bit planes with rank directories."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> "WaveletMatrix":
        planes, zeros, ranks, row = [], [], [], np.asarray(ids)
        for b in range(bits - 1, -1, -1):
            ones = (row >> b) & 1 == 1
            planes.append(np.packbits(ones, bitorder="little"))
            padded = np.zeros(-(-len(row) // STEP) * STEP, bool)
            padded[: len(row)] = ones
            ranks.append(np.concatenate([[0], np.cumsum(padded.reshape(-1, STEP).sum(1))]).astype(np.uint32))
            row = np.concatenate([row.compress(~ones), row.compress(ones)])
            zeros.append(len(ones) - int(ranks[-1][-1]))
        return cls(len(row), planes, zeros, ranks)

    def to_bytes(self) -> bytes:
        """Header (length, planes), zeros per plane, then each plane's bits and directory; little-endian."""
        head = struct.pack("<QI", self.n, len(self.planes)) + struct.pack(f"<{len(self.zeros)}Q", *self.zeros)
        return head + b"".join(p.tobytes() + r.astype("<u4").tobytes() for p, r in zip(self.planes, self.ranks))

    @classmethod
    def from_bytes(cls, data: bytes) -> "WaveletMatrix":
        n, bits = struct.unpack_from("<QI", data)
        zeros = list(struct.unpack_from(f"<{bits}Q", data, 12))
        at, wide, steps = 12 + 8 * bits, -(-n // 8), -(-n // STEP) + 1
        planes, ranks = [], []
        for _ in range(bits):
            planes.append(np.frombuffer(data, np.uint8, wide, at))
            ranks.append(np.frombuffer(data, "<u4", steps, at + wide))
            at += wide + 4 * steps
        return cls(n, planes, zeros, ranks)

    def ones_before(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block = i // STEP
        bits = np.unpackbits(self.planes[level][block * STEP // 8: -(-i // 8)], bitorder="little")
        return int(self.ranks[level][block]) + int(bits[: i - block * STEP].sum())

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self.ones_before(level, i)
            value, i = value << 1 | bit, zeros + ones if bit else i - ones
        return value

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the symbol's occurrences in [lo, hi) end up below the last plane."""
        for level, zeros in enumerate(self.zeros):
            a, b = self.ones_before(level, lo), self.ones_before(level, hi)
            lo, hi = (zeros + a, zeros + b) if symbol >> (len(self.zeros) - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id in places [lo, hi)."""
        if symbol >> len(self.zeros):
            return 0
        a, b = self._range(symbol, lo, self.n if hi is None else hi)
        return b - a

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        ranks = self.ranks[level].astype(np.int64)
        if not bit:
            ranks = np.arange(len(ranks), dtype=np.int64) * STEP - ranks
        block = int(np.searchsorted(ranks, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * STEP // 8: (block + 1) * STEP // 8], bitorder="little")
        return block * STEP + int(np.flatnonzero(bits == bit)[k - int(ranks[block])])

    def select(self, symbol: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id; -1 if there are fewer."""
        if symbol >> len(self.zeros):
            return -1
        lo, hi = self._range(symbol, 0, self.n)
        if not 0 <= k < hi - lo:
            return -1
        at = lo + k
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = symbol >> (len(self.zeros) - 1 - level) & 1
            at = self._select_bit(level, bit, at - self.zeros[level] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids, in order: the planes are merged back from the last to the first."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        row = np.zeros(self.n, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            before, zeros = np.empty_like(row), self.zeros[level]
            before[np.flatnonzero(~ones)] = row[:zeros]
            before[np.flatnonzero(ones)] = row[zeros:] | kind(1 << (len(self.planes) - 1 - level))
            row = before
        return row


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


class WordEncoder:
    """Encodes texts through their distinct words, each encoded once and remembered.

    Holds for vocabularies whose normaliser lowers letters and whose splitter
    never joins across ASCII white space nor letters or digits with a full stop
    or comma after them; then the ids of a text are those of its words.
    """

    def __init__(self, path: str, kind):
        self.tokenizer, self.kind = _tokenizer(path), kind
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.last = None  # which ids end a word
        if suffix:
            self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.last[[k for word, k in self.tokenizer.get_vocab().items() if word.endswith(suffix)]] = True
        self.ends = {mark: self.tokenizer.encode(mark, add_special_tokens=False).ids for mark in ".,"}
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.start, self.ids, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, self.kind), 0

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and each word's number of ids.

        Words of letters alone are encoded many to a string: each ends with the one token that ends a word.
        """
        plain = np.fromiter(map(str.isalpha, words), bool, len(words)) if self.last is not None else np.zeros(len(words), bool)
        letters, others = [w for w, p in zip(words, plain) if p], [w for w, p in zip(words, plain) if not p]
        lines = [" ".join(letters[k:k + JOINED]) for k in range(0, len(letters), JOINED)]
        many = self._ids(self.tokenizer.encode_batch_fast(lines, add_special_tokens=False))
        cuts = np.flatnonzero(self.last[many]) + 1 if lines else np.zeros(0, np.int64)
        if len(cuts) != len(letters):
            self.last = None  # not such a vocabulary
            return self._encoded(words)
        coded = self.tokenizer.encode_batch_fast(others, add_special_tokens=False)
        single, sizes = self._ids(coded), np.empty(len(words), np.int64)
        sizes[plain], sizes[~plain] = np.diff(cuts, prepend=0), np.fromiter(map(len, coded), np.int64, len(coded))
        out, starts = np.empty(len(many) + len(single), self.kind), np.cumsum(sizes) - sizes
        out[_ranges(starts[plain], sizes[plain])] = many
        out[_ranges(starts[~plain], sizes[~plain])] = single
        return out, sizes

    def _ids(self, coded: list) -> np.ndarray:
        return np.fromiter(itertools.chain.from_iterable(e.ids for e in coded), self.kind)

    def _stems(self, words: pa.Array) -> np.ndarray:
        """Places of the words' encodings, new ones encoded."""
        distinct = words.to_pylist()
        if len(self.place) > WORDS_KEPT:
            self.forget()
        place = np.fromiter(map(self.place.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new, first = [distinct[k] for k in missing], len(self.place)
            ids, sizes = self._encoded(new)
            ends = self.used + np.cumsum(sizes)
            grow = lambda a, n: a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])
            self.start, self.ids = grow(self.start, first + len(new) + 1), grow(self.ids, int(ends[-1]))
            self.ids[self.used:ends[-1]] = ids
            self.start[first + 1:first + len(new) + 1] = ends
            self.used = int(ends[-1])
            place[missing] = np.arange(first, first + len(new))
            self.place.update(zip(new, range(first, first + len(new))))
        return place

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and each text's number of ids."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        words = split.flatten().dictionary_encode()
        names = pc.if_else(pc.string_is_ascii(words.dictionary), pc.ascii_lower(words.dictionary), words.dictionary)
        mark = np.zeros(len(names), np.int64)  # 0: the word as it is, else the mark cut off its end
        for k, end in enumerate(self.ends, 1):
            cut = pc.match_substring_regex(names, r"[\pL\pN]\Q" + end + r"\E$")
            names = pc.if_else(cut, pc.utf8_slice_codeunits(names, 0, -1), names)
            mark[cut.to_numpy(zero_copy_only=False)] = k
        stems = names.dictionary_encode()
        place = self._stems(stems.dictionary)[stems.indices.to_numpy(zero_copy_only=False)]
        tails = [np.array(t, self.kind) for t in ([], *self.ends.values())]
        stem = self.start[place + 1] - self.start[place]
        size = stem + np.array([len(t) for t in tails])[mark]
        starts = np.cumsum(size) - size
        ids = np.empty(int(size.sum()), self.kind)  # of the distinct words
        into, at = _ranges(starts, stem), _ranges(self.start[place], stem)
        ids[into] = self.ids[at]
        for k, tail in enumerate(tails):
            for j, value in enumerate(tail):
                ids[(starts + stem + j)[mark == k]] = value

        of_word = words.indices.to_numpy(zero_copy_only=False)
        n = size[of_word]
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        return ids[_ranges(starts[of_word], n)], np.diff(np.concatenate([[0], np.cumsum(n)])[bounds])


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] places), then start[1], and so on."""
    out = np.repeat((start - (np.cumsum(n) - n)).astype(np.int32), n)  # places within one slice of texts or the words kept
    out += np.arange(len(out), dtype=np.int32)
    return out


@lru_cache(maxsize=2)
def _encoder(path: str, kind) -> WordEncoder:
    """One per Python worker, so that its tasks share the words remembered."""
    return WordEncoder(path, kind)


def encode_blocks(docs: DataFrame, vocabulary: str, block: int = BLOCK) -> DataFrame:
    """(doc_id, text) to the rows of the file format, in order of doc_id over the partitions."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, size = TaskContext.get().partitionId(), 0, _tokenizer(vocabulary).get_vocab_size()
        bits = max(1, (size - 1).bit_length())
        kind = np.uint16 if bits <= 16 else np.uint32
        encoder = _encoder(vocabulary, kind)
        ids: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        nulls: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal seq
            tokens, n = np.concatenate(ids), np.concatenate(lengths)
            row = {"part": part, "block": seq, "n_tokens": len(tokens), "n_docs": len(n), "doc_ids": np.concatenate(keys).tobytes(),
                   "null_ids": np.concatenate(nulls).tobytes(), "lengths": n.tobytes(), "planes": WaveletMatrix.build(tokens, bits).to_bytes()}
            for held in (ids, keys, nulls, lengths):
                held.clear()
            seq += 1
            return pa.RecordBatch.from_pylist([row], schema=BLOCK_SCHEMA)

        held = 0
        for batch in batches:
            marks = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)) // TEXTS_AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                tokens, n = encoder(batch["text"].slice(a, b - a))
                tokens, n = np.insert(tokens, np.cumsum(n), END_ID), n + 1
                key = batch["doc_id"].slice(a, b - a)
                null, key = key.is_null().to_numpy(zero_copy_only=False), key.fill_null(0).to_numpy()
                ends = np.cumsum(n)
                x = 0
                while x < len(n):  # whole documents, as many as the block still takes
                    base = ends[x] - n[x]
                    y = int(np.searchsorted(ends, base + block - held, side="right"))
                    if y <= x:
                        if held:
                            yield close()
                            held = 0
                            continue
                        y = x + 1
                    ids.append(tokens[base:ends[y - 1]])
                    keys.append(key[x:y].astype("<i8"))
                    nulls.append(null[x:y])
                    lengths.append(n[x:y].astype("<i8"))
                    held += int(ends[y - 1] - base)
                    x = y
        if held:
            yield close()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(encode, BLOCKS)


def write_shards(docs: DataFrame, vocabulary: str, path: str) -> DataFrame:
    encode_blocks(docs, vocabulary).write.option("compression", "zstd").parquet(path)
    return read_shards(docs.sparkSession, path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(path)


def block_starts(shards: DataFrame) -> DataFrame:
    """(part, block, first): tokens of the corpus before each block.

    Two levels: sums of whole shards run over the shards (a row per written
    file), then each shard's blocks run by themselves.
    """
    sizes = shards.groupBy("part", "block").agg(F.sum("n_tokens").alias("n"))
    whole = sizes.groupBy("part").agg(F.sum("n").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = whole.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = sizes.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return local.join(bases, "part").select("part", "block", (F.col("_base") + F.col("_in")).alias("first"))


def decode_documents(shards: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) read from the files."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                lengths, keys = np.frombuffer(row.lengths, "<i8"), np.frombuffer(row.doc_ids, "<i8")
                ids = WaveletMatrix.from_bytes(row.planes).decode().astype("<u4")
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(ids[e - n:e]) for e, n in zip(ends, lengths)]
                yield pd.DataFrame({
                    "doc_id": pd.array(np.where(np.frombuffer(row.null_ids, bool), 0, keys), "Int64").copy()
                    if not any(row.null_ids) else pd.array([None if z else k for k, z in zip(keys.tolist(), row.null_ids)], "Int64"),
                    "start": row.first + ends - lengths, "n_tokens": lengths, "ids_crc32": crcs})

    starts = block_starts(shards)
    placed = shards.join(F.broadcast(starts) if fits_broadcast(starts) else starts, ["part", "block"])
    return placed.select("doc_ids", "null_ids", "lengths", "planes", "first").mapInPandas(
        decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_positions(shards: DataFrame, symbol: int) -> DataFrame:
    """Every place of one id in the corpus, by select on each block: (position)."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for planes, first in zip(batch["planes"], batch["first"]):
                matrix = WaveletMatrix.from_bytes(planes)
                yield pd.DataFrame({"position": [first + matrix.select(symbol, k) for k in range(matrix.count(symbol))]},
                                   dtype="int64")

    return shards.join(block_starts(shards), ["part", "block"]).select("planes", "first").mapInPandas(find, "position long")


def op6_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    shards = write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), new_table_path(spark, "token-shards"))
    return decode_documents(shards)
