"""SentencePiece encoding and decoding with N-best segmentation.

The lattice of a text holds every vocabulary piece that fits; a character no
piece covers is one unknown edge, written as its UTF-8 bytes. Costs are whole
numbers (millionths of a nat), so sums and ties are exact. A forward Viterbi pass
gives the least cost from the start to every place; these are exact
heuristics for an A-star search from the end backwards, which yields
segmentations in order of cost and expands nothing it does not need.

Pieces hold the space mark only at their start, so the lattice of a text falls
apart before every run of spaces and around line feeds. Segmentations of the
parts are found once per distinct part and remembered; the N best of a text are
sums over its parts, and can differ from the best only in the N - 1 parts
whose second best costs least.

The vocabulary's own scores are merge ranks, no probabilities; ``costs="zipf"``
reads rank r as a probability in proportion to 1 / r, ``costs="model"`` takes
the scores as they are.

Defined results: null and empty texts have no pieces, score 0 and one
segmentation; whole texts of any length are encoded; of equal costs the
search keeps a fixed order, the path nearest to its end first; the literal space mark U+2581 decodes as a
space (``round_trip`` is then false); an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from folioquery.llm.common import read

N_BEST = 4
REMEMBERED = 600_000     # parts a worker remembers; then it starts afresh
TEXTS_AT_ONCE = 1 << 21  # characters
UNKNOWN = 10             # nats that an unknown character costs beyond the dearest piece
MARK = "▁"
PARTS = re.compile(r" +[^ \n]*|[^ \n]+|\n")


class Vocabulary:
    """Pieces, costs and the trie of a SentencePiece model file."""

    def __init__(self, path: str, costs: str = "zipf"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.bytes_at = {int(self.pieces[i][3:5], 16): i for i in ids if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes_at.items()}
        self.unknown_id = model.unk_id()
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(MARK in self.pieces[i].lstrip(MARK) or "\n" in self.pieces[i] for i in plain):
            raise ValueError("pieces with an inner space mark or a line feed: texts cannot be cut into parts")
        self.silent = {i for i in ids if model.is_control(i)}
        self.texts = [None if i in self.byte_of else "" if i in self.silent else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
        whole = math.log(sum(1 / r for r in range(1, len(ranked) + 1)))
        if costs == "zipf":
            self.costs = {i: round(1e6 * (math.log(r) + whole)) for r, i in enumerate(ranked, 1)}
        else:
            self.costs = {i: round(-1e6 * model.get_score(i)) for i in plain}
        self.unknown_cost = max(self.costs.values()) + UNKNOWN * 1_000_000
        self.trie: dict = {}  # character -> [edge of the piece that ends here or None, the trie after it]
        for i in plain:
            node, after = [None, None], self.trie
            for c in self.pieces[i].replace(MARK, " "):
                node = after.setdefault(c, [None, {}])
                after = node[1]
            node[0] = self.costs[i], (i,)

    def lattice(self, part: str) -> tuple[list[list[tuple[int, tuple[int, tuple]]]], list[int]]:
        """Edges by the place they end at, (start, (cost, ids)), and the forward Viterbi costs of all places."""
        size, trie = len(part), self.trie
        into: list[list] = [[] for _ in range(size + 1)]
        least: list = [0] + [math.inf] * size
        for i, c in enumerate(part):
            base, node, j = least[i], trie.get(c), i
            single = node is not None and node[0] is not None
            while node is not None:
                j += 1
                edge, after = node
                if edge is not None:
                    into[j].append((i, edge))
                    cost = base + edge[0]
                    if cost < least[j]:
                        least[j] = cost
                if j == size:
                    break
                node = after.get(part[j])
            if not single:
                raw = c.encode("utf-8", "surrogatepass")
                ids = tuple(self.bytes_at[b] for b in raw) if self.bytes_at else (self.unknown_id,)
                into[i + 1].append((i, (self.unknown_cost, ids)))
                least[i + 1] = min(least[i + 1], base + self.unknown_cost)
        return into, least

    def n_best(self, part: str, n: int) -> list[tuple[int, tuple]]:
        """Up to ``n`` segmentations (cost, ids), least cost first: A-star from the end, the Viterbi costs as heuristics."""
        into, least = self.lattice(part)
        out: list = []
        heap: list = [(least[-1], len(part), 0, 0, None)]
        push, pop, seq = heapq.heappush, heapq.heappop, 0
        while heap and len(out) < n:
            f, j, _, g, path = pop(heap)  # of equal costs, the one nearest to the start
            if j:
                for i, (cost, piece) in into[j]:
                    seq += 1
                    cost += g
                    push(heap, (cost + least[i], i, seq, cost, (piece, path)))
            else:
                ids: list = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                out.append((f, tuple(ids)))
        return out

    def decode(self, ids) -> str:
        """Ids to text, with the dummy space at the start still there."""
        found = [self.texts[i] for i in ids]
        if None not in found:
            return "".join(found)
        out = b"".join(bytes([self.byte_of[i]]) if text is None else text.encode("utf-8") for i, text in zip(ids, found))
        return out.decode("utf-8", "surrogatepass")


class Encoder:
    """Encodes texts part by part with a memory of parts."""

    def __init__(self, path: str, n: int = N_BEST, costs: str = "zipf"):
        self.vocabulary, self.n = Vocabulary(path, costs), n
        self.kind = np.uint16 if len(self.vocabulary.pieces) <= 1 << 16 else np.uint32
        self.code = np.dtype(self.kind).char
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, self.kind)  # of all parts, one after the other
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.cost = np.zeros(1 << 14, np.int64)
        self.step = np.zeros(1 << 14, np.int64)  # from the best to the second; -1: there is none
        self.same = np.zeros(1 << 14, bool)
        self.more: dict[str, list] = {}  # (step from the best, ids) of each of the N best, of the parts that were asked

    def _learn(self, parts: list[str]) -> None:
        if not parts:
            return
        a, b = len(self.place), len(self.place) + len(parts)
        grow = lambda x, n: x if n <= len(x) else np.concatenate([x, np.zeros(max(n - len(x), len(x)), x.dtype)])
        for name in ("start", "size", "cost", "step", "same"):
            setattr(self, name, grow(getattr(self, name), b))
        ids, sizes, costs, steps, same = array(self.code), [], [], [], []
        for part in parts:
            best = self.vocabulary.n_best(part, 2 if self.n > 1 else 1)
            ids.extend(best[0][1])
            sizes.append(len(best[0][1]))
            costs.append(best[0][0])
            steps.append(best[1][0] - best[0][0] if len(best) > 1 else -1)
            same.append(self.vocabulary.decode(best[0][1]) == part)
        self.place.update(zip(parts, range(a, b)))
        self.size[a:b], self.cost[a:b], self.step[a:b], self.same[a:b] = sizes, costs, steps, same
        self.start[a:b] = self.used + np.cumsum(sizes) - sizes
        self.ids = grow(self.ids, self.used + len(ids))
        self.ids[self.used:self.used + len(ids)] = np.frombuffer(ids, self.kind)
        self.used += len(ids)

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, list[int], bool]]:
        """For each text: ids of the best segmentation, costs of the N best, whether decoding gives the text back."""
        return [(every[0], costs, same) for every, costs, same in self.segmentations(texts, False)]

    def segmentations(self, texts: list[str], all_ids: bool = True) -> list[tuple[list[np.ndarray], list[int], bool]]:
        """For each text: ids and costs of the N best segmentations, best first, and whether decoding the best gives the text back.

        Without ``all_ids`` only those of the best are put together.
        """
        split = [PARTS.findall(" " + t) if t else [] for t in texts]
        if len(self.place) > REMEMBERED:
            self.forget()
        self._learn(list(set().union(*split).difference(self.place)))
        out, find = [], self.place.__getitem__
        for parts in split:
            at = np.fromiter(map(find, parts), np.int64, len(parts))
            total = int(self.cost[at].sum())
            n = self.size[at]
            ends = np.cumsum(n)
            ids = self.ids[np.repeat(self.start[at] - (ends - n), n) + np.arange(int(n.sum()))]
            found = self._ranked(parts, at)
            every = [ids, *(self._replaced(ids, at, ends, chosen) for _, chosen in found[1:])] if all_ids else [ids]
            out.append((every, [total + step for step, _ in found], bool(self.same[at].all())))
        return out

    def _ranked(self, parts: list[str], at: np.ndarray) -> list[tuple[int, list]]:
        """The N best segmentations of a text: step from the best, and (part, its ids) where they take other ids than the best."""
        steps = self.step[at]
        free = np.flatnonzero(steps >= 0)
        if self.n == 1 or not len(free):
            return [(0, [])]
        if len(free) >= self.n:
            free = np.sort(free[np.argpartition(steps[free], self.n - 2)[: self.n - 1]])
        choices = []
        for k in free.tolist():
            part = parts[k]
            if part not in self.more:
                found = self.vocabulary.n_best(part, self.n)
                self.more[part] = [(cost - found[0][0], np.array(own, self.kind)) for cost, own in found]
            choices.append((k, self.more[part]))
        sums = [sum(c) for c in itertools.product(*[[step for step, _ in own] for _, own in choices])]
        places = list(itertools.product(*[range(len(own)) for _, own in choices]))
        first = sorted(range(len(sums)), key=sums.__getitem__)[: self.n]  # the best takes place 0 everywhere
        return [(sums[i], [(k, own[j][1]) for (k, own), j in zip(choices, places[i]) if j]) for i in first]

    def _replaced(self, ids: np.ndarray, at: np.ndarray, ends: np.ndarray, chosen: list) -> np.ndarray:
        """The best ids of a text with those of some parts replaced."""
        pieces, a = [], 0
        for k, own in chosen:
            pieces += [ids[a:ends[k] - self.size[at[k]]], own]
            a = ends[k]
        return np.concatenate([*pieces, ids[a:]])


@lru_cache(maxsize=2)
def encoder(path: str, n: int = N_BEST, costs: str = "zipf") -> Encoder:
    """One encoder per Python worker, so that tasks share what it remembers."""
    return Encoder(path, n, costs)


def _runs(batches: Iterator[pd.DataFrame], path: str, n: int, costs: str, all_ids: bool):
    encode = encoder(path, n, costs).segmentations
    for batch in batches:
        texts = [t if isinstance(t, str) else "" for t in batch["text"]]
        marks = np.cumsum([len(t) for t in texts]) // TEXTS_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1), len(texts)]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.iloc[a:b], encode(texts[a:b], all_ids)


def encode_documents(docs: DataFrame, path: str, n: int = N_BEST, costs: str = "zipf", with_ids: bool = True, every: bool = False) -> DataFrame:
    """(doc_id, text) to (doc_id, n_pieces, scores, round_trip, ids or ids_crc32); no shuffle.

    ``scores``: log-probabilities (nats) of the N best segmentations, best first. With
    ``every``, ``segmentations`` (or ``segmentations_crc32``) holds the ids of all N in the same order.
    """
    last, kind = ("ids", "array<int>") if with_ids else ("ids_crc32", "bigint")
    name = "segmentations" if with_ids else "segmentations_crc32"
    schema = f"doc_id long, n_pieces long, scores array<double>, round_trip boolean, {last} {kind}" + (f", {name} array<{kind}>" if every else "")
    value = (lambda ids: ids.astype(np.int32)) if with_ids else (lambda ids: zlib.crc32(ids.astype("<u4")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, found in _runs(batches, path, n, costs, every):
            values = [[value(ids) for ids in own] for own, _, _ in found]
            out = pd.DataFrame({
                "doc_id": rows["doc_id"].astype("Int64").reset_index(drop=True), "n_pieces": [len(own[0]) for own, _, _ in found],
                "scores": [[-c / 1e6 for c in sums] for _, sums, _ in found], "round_trip": [ok for _, _, ok in found]})
            out[last] = [own[0] for own in values]
            if every:
                out[name] = values
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, schema)


def decode_documents(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) back to (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = encoder(path).vocabulary
        for batch in batches:
            texts = [vocabulary.decode(() if ids is None else ids.tolist())[1:] for ids in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": texts})

    return coded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = read(spark, sf_dir, "documents")
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False, every=True)
