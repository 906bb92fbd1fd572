"""Toxicity by weak supervision.

Voters look at a text and vote or abstain: fixed lexicons, lexicons mined from
the training labels, and patterns; the last one votes clean. A generative label
model reads all documents through their vote patterns (at most 2**VOTERS rows,
counted in Spark): expectation-maximisation estimates how often each voter votes on
toxic and on clean texts, then how voters correlate within a class; correlated
voters are weighed down and the rates estimated again. The posterior of each
pattern is the training label of a linear classifier on hashed words, fitted
on a bounded sample (SAMPLE documents a stratum, smallest hashes first) of the
training rows. Every document is scored by the classifier alone.

Labels are read only from rows whose crc32(doc_id as text) mod FOLDS is not 0;
they give the mined lexicons, the prior and anchors of the label model. Labels,
lang, source and doc_id are never inputs of a score.

Defined results: null and empty texts get the classifier's bias; whole texts
count; a document with several labels counts as toxic if one says so; with no
usable labels the fixed lexicons and a prior of 0.1 remain; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioquery.llm.common import read
from folioquery.operators.joins import fits_broadcast, pick_rows
from folioquery.session import materialize

FOLDS = 5
MINED = 256           # words of the mined lexicons, at most
MINED_GROUPS = 8
CANDIDATES = 50_000   # words and stems that the mining compares, most frequent in toxic training texts first
MIN_GAIN = 40.0       # log-likelihood ratio of a word that is mined or becomes a feature,
MIN_SHARE = 0.02      # and the least share of its class's documents that have it: no chance word, no group of copies
SAMPLE = 10_000       # documents a stratum (posterior below and from one half) that fit the classifier
SLOTS = 1 << 18       # hashed words
FEATURES = 512        # of them kept by the classifier, most associated first
PRIOR = 0.1           # where no labels are
MIN_PRECISION = 0.8   # share of toxic documents among those with a mined word
PREFIXES = (5, 6, 7)  # lengths of the stems that may carry meaning where endings vary
WORD = re.compile(r"[^\W\d_]+")

# General-purpose insult lists, a voter each.
LEXICONS = {
    "wits": "idiot idiots moron morons stupid dumb imbecile fool dimwit halfwit brainless retarded cretin".split(),
    "worth": "worthless pathetic loser losers scum trash garbage filth vermin clown disgusting parasite".split(),
    "others": ("imbécile crétin connard débile ordure dummkopf trottel abschaum vollidiot arschloch "
               "idiota imbécil estúpido estúpida escoria basura").split(),
}
SECOND_PERSON = frozenset("you your youre u ur tu vous du dich ihr tú usted".split())
VOTERS = len(LEXICONS) + MINED_GROUPS + 4


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def forms(words) -> set[str]:
    """Distinct words; stems (prefixes of PREFIXES letters) with a star; with two stars if two different words share one."""
    words = set(words)
    stems = Counter(w[:n] for w in words for n in PREFIXES if len(w) >= n)
    return words.union((s + "*" for s in stems), (s + "**" for s, k in stems.items() if k > 1))


def votes(text: str, words: list[str], mined: list[frozenset], against: frozenset = frozenset()) -> int:
    """Votes of all voters as bits."""
    have, bits = forms(words), 0
    lexicons = [frozenset(v) - against for v in LEXICONS.values()] + mined
    hits = [not s.isdisjoint(have) for s in lexicons]
    listed = frozenset().union(*[s for s, h in zip(lexicons, hits) if h]) if any(hits) else frozenset()
    aimed = any(w in listed and not SECOND_PERSON.isdisjoint(words[max(0, k - 3):k]) for k, w in enumerate(words)) if listed else False
    capitals = sum(map(str.isupper, text))
    for k, vote in enumerate([*hits, aimed, 2 * capitals > len(text), text.count("!") * 20 > len(words) > 0, not any(hits)]):
        bits |= vote << k
    return bits


def _texts(batch: pd.DataFrame) -> Iterator[str]:
    return (t if isinstance(t, str) else "" for t in batch["text"])


def fold() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the rows that may be learned from."""
    return (labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(fold() != 0)
            .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))


def with_labels(docs: DataFrame, labels: DataFrame, how: str = "inner") -> DataFrame:
    known = training_labels(labels)
    return docs.select("doc_id", "text").join(F.broadcast(known) if fits_broadcast(known) else known, "doc_id", how)


def mine_lexicon(labelled: DataFrame) -> tuple[list[frozenset], frozenset]:
    """Words and stems far likelier in toxic training texts, and listed words that the labels speak against.

    By document counts over all labelled rows.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = Counter()
        for batch in batches:
            for text in _texts(batch):
                have = forms(tokens(text))
                found.update(have if wanted is None else have & wanted)
            if len(found) > 200_000:
                yield pd.DataFrame({"word": list(found), "n": list(found.values())})
                found.clear()
        if found:
            yield pd.DataFrame({"word": list(found), "n": list(found.values())})

    def counted(rows: DataFrame) -> DataFrame:
        return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))

    all_ = labelled.agg(F.count(F.when(F.col("toxic") > 0, 1)).alias("t"), F.count(F.when(F.col("toxic") <= 0, 1)).alias("c")).first()
    if not all_["t"] or not all_["c"]:
        return [frozenset()] * MINED_GROUPS, frozenset()
    listed, wanted = [w for words in LEXICONS.values() for w in words], None
    often = counted(labelled.where("toxic > 0")).where((F.col("n") >= max(3, MIN_SHARE * all_["t"])) | F.col("word").isin(listed))
    # A form of a share of the toxic documents: at most the mean number of forms over MIN_SHARE, cut at CANDIDATES.
    toxic = {r["word"]: r["n"] for r in often.orderBy(F.desc("n"), "word").limit(CANDIDATES).collect()}
    wanted = frozenset(toxic) | frozenset(listed)
    clean = {r["word"]: r["n"] for r in counted(labelled.where("toxic <= 0")).collect()}  # of those words only
    share, gains = all_["t"] / (all_["t"] + all_["c"]), []
    for word, t in toxic.items():
        c = clean.get(word, 0)
        gain = 2 * (t * math.log(t / ((t + c) * share)) + (c * math.log(c / ((t + c) * (1 - share))) if c else 0))
        if t >= max(3, MIN_SHARE * all_["t"]) and t >= MIN_PRECISION * (t + c) and gain >= MIN_GAIN:
            gains.append((-gain, word))
    best = [w for _, w in sorted(gains)[:MINED]]
    against = frozenset(w for w in listed if clean.get(w, 0) > toxic.get(w, 0))
    return [frozenset(w for w in best if zlib.crc32(w.encode()) % MINED_GROUPS == g) for g in range(MINED_GROUPS)], against


class LabelModel:
    """Two classes; each voter votes with its own rate in each; correlated voters count for less."""

    def __init__(self, voters: int, rounds: int = 50):
        self.voters, self.rounds = voters, rounds

    def _bits(self, patterns: np.ndarray) -> np.ndarray:
        return (np.asarray(patterns)[:, None] >> np.arange(self.voters) & 1).astype(float)

    def fit(self, patterns: np.ndarray, counts: np.ndarray, known: np.ndarray, start: np.ndarray, prior: float) -> "LabelModel":
        """``known``: 0 or 1 where a training label says so, else -1; ``start``: first guess of the posterior."""
        v, counts = self._bits(patterns), np.asarray(counts, float)
        self.prior, self.weight = prior, np.ones(self.voters)
        p = np.where(known >= 0, known, start).astype(float)
        for turn in range(2):
            for _ in range(self.rounds):
                self.rates = np.stack([((counts * w) @ v + 1.0) / ((counts * w).sum() + 2.0) for w in (1 - p, p)])
                new = np.where(known >= 0, known, self._posterior(v))
                if np.abs(new - p).max(initial=0) < 1e-6:
                    break
                p = new
            if turn == 0:
                self.correlation = sum(self._correlation(v, counts * w) * (counts * w).sum() for w in (1 - p, p)) / max(counts.sum(), 1)
                extra = np.clip(self.correlation, 0, None)
                np.fill_diagonal(extra, 0)
                self.weight = 1 / (1 + extra.sum(1))
        return self

    @staticmethod
    def _correlation(v: np.ndarray, w: np.ndarray) -> np.ndarray:
        total = max(w.sum(), 1e-9)
        centred = v - (w @ v) / total
        cov = (centred * w[:, None]).T @ centred / total
        scale = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
        return cov / scale[:, None] / scale

    def _posterior(self, v: np.ndarray) -> np.ndarray:
        gain = np.log(self.rates[1] / self.rates[0]), np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        logit = math.log(self.prior / (1 - self.prior)) + v @ (self.weight * gain[0]) + (1 - v) @ (self.weight * gain[1])
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return self._posterior(self._bits(patterns))


def fit_linear(rows: list[np.ndarray], target: np.ndarray, weight: np.ndarray) -> tuple[dict[int, float], float]:
    """Logistic regression on the FEATURES slots most associated with the posterior: (slot weights, bias)."""
    target, weight = np.asarray(target, float), np.asarray(weight, float)
    rate = float(np.clip((weight * target).sum() / max(weight.sum(), 1e-9), 1e-6, 1 - 1e-6)) if len(target) else PRIOR
    if not len(target) or not sum(map(len, rows)):
        return {}, math.log(rate / (1 - rate))
    have, toxic, total, all_ = np.zeros(SLOTS), np.zeros(SLOTS), target.sum(), len(target)
    for row, t in zip(rows, target):  # slots of a row are distinct
        have[row] += 1
        toxic[row] += t
    clean = have - toxic
    part = lambda n, expected: np.where(n > 0, n * np.log(np.maximum(n, 1e-9) / np.maximum(expected, 1e-9)), 0)
    gain = 2 * (part(toxic, have * total / all_) + part(clean, have * (all_ - total) / all_))
    often = (toxic >= max(3, MIN_SHARE * total)) | (clean >= max(3, MIN_SHARE * (all_ - total)))
    gain = np.where(often & (gain >= MIN_GAIN), gain, 0)
    chosen = np.sort(np.argsort(-gain, kind="stable")[:min(FEATURES, int((gain > 0).sum()))])
    column = np.full(SLOTS, -1)
    column[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for k, row in enumerate(rows):
        at = column[row]
        x[k, at[at >= 0]] = 1
    w, b, weight = np.zeros(len(chosen)), math.log(rate / (1 - rate)), weight / weight.sum()
    speed, momentum = 2.0, [np.zeros(len(chosen)), 0.0]
    scale_w, scale_b = np.full(len(chosen), 1e-8), 1e-8
    for _ in range(400):  # gradient descent with a step per weight
        g = weight * (1 / (1 + np.exp(-np.clip(x @ w + b, -60, 60))) - target)
        gw, gb = x.T @ g + 1e-5 * w, g.sum()
        scale_w += gw * gw
        scale_b += gb * gb
        momentum = [0.8 * momentum[0] - speed * 0.2 * gw / np.sqrt(scale_w), 0.8 * momentum[1] - speed * 0.2 * gb / math.sqrt(scale_b)]
        w, b = w + momentum[0], b + momentum[1]
    return {int(s): float(v) for s, v in zip(chosen, w) if abs(v) > 1e-4}, float(b)


def slot_of(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & (SLOTS - 1)


class _Active(dict):
    """The slots with weights that a word and its stems fall on, and its stems whose doubled form has a weight."""

    def __init__(self, slots: dict[int, float]):
        super().__init__()
        self.slots = slots

    def __missing__(self, word: str) -> tuple[tuple[int, ...], tuple[str, ...]]:
        if len(self) > 300_000:
            self.clear()
        stems = [word[:n] for n in PREFIXES if len(word) >= n]
        self[word] = found = (tuple(s for s in map(slot_of, forms((word,))) if s in self.slots),
                              tuple(s for s in stems if slot_of(s + "**") in self.slots))
        return found

    def hits(self, words: list[str]) -> set[int]:
        found = [f for f in map(self.__getitem__, set(words)) if f[0] or f[1]]
        twice = Counter(s for _, stems in found for s in stems)
        return set().union(*(f[0] for f in found), (slot_of(s + "**") for s, k in twice.items() if k > 1))


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[int, float], float, LabelModel]:
    """(slot weights, bias, label model)."""
    mined, against = mine_lexicon(with_labels(docs, labels))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"].astype("Int64"),
                                "pattern": [votes(t, tokens(t), mined, against) for t in _texts(batch)]})

    voted = materialize(with_labels(docs, labels, "left").mapInPandas(vote, "doc_id long, toxic int, pattern long"), "toxic-votes")
    table = voted.groupBy("pattern", "toxic").agg(F.count("*").alias("n")).toPandas()  # at most 3 * 2**VOTERS rows
    known = table["toxic"].fillna(-1).clip(-1, 1).astype(int).to_numpy()
    pattern, n = table["pattern"].to_numpy(np.int64), table["n"].to_numpy(float)
    lexical = (1 << len(LEXICONS) + MINED_GROUPS) - 1
    labelled = n[known >= 0].sum()
    prior = float(np.clip(n[known == 1].sum() / labelled, 1e-3, 0.5)) if labelled else PRIOR
    model = LabelModel(VOTERS).fit(pattern, n, known, np.where(pattern & lexical, 0.9, 0.02), prior)

    posterior = dict(zip(pattern.tolist(), model.posterior(pattern).tolist()))
    toxic_patterns = [p for p, v in posterior.items() if v >= 0.5]
    rows, target, weight = [], [], []

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [(t, tokens(t)) for t in _texts(batch)]
            yield pd.DataFrame({"pattern": [votes(t, w, mined, against) for t, w in texts],
                                "slots": [np.array(sorted({slot_of(x) for x in forms(w)}), np.int32).tobytes() for _, w in texts]})

    for inside in (F.col("pattern").isin(toxic_patterns), ~F.col("pattern").isin(toxic_patterns)):
        stratum = voted.where(fold() != 0).where(inside)
        size = stratum.count()
        ids = stratum.select("doc_id", F.xxhash64("doc_id").alias("_h")).orderBy("_h", "doc_id").limit(SAMPLE).select("doc_id")
        found = pick_rows(docs.select("doc_id", "text"), ids, "doc_id").mapInPandas(features, "pattern long, slots binary").collect()  # SAMPLE rows
        rows += [np.frombuffer(r["slots"], np.int32) for r in found]
        target += [posterior[r["pattern"]] if r["pattern"] in posterior else 0.0 for r in found]
        weight += [size / max(len(found), 1)] * len(found)
    slots, bias = fit_linear(rows, np.array(target), np.array(weight))
    return slots, bias, model


def score_documents(docs: DataFrame, slots: dict[int, float], bias: float) -> DataFrame:
    """(doc_id, text) to (doc_id, held_out, score, predicted); no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        active, weight = _Active(slots), slots.__getitem__
        for batch in batches:
            sums = np.array([bias + sum(map(weight, sorted(active.hits(tokens(t))))) for t in _texts(batch)], float)
            score = 1 / (1 + np.exp(-np.clip(sums, -60, 60)))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": score, "predicted": (score >= 0.5).astype(np.int32)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double, predicted int").select(
        "doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    slots, bias, _ = train(docs, read(spark, sf_dir, "labels"))
    return score_documents(docs, slots, bias)
