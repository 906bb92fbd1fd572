"""Exact Jaccard self-join on word shingles by universe partitioning.

Sets are banded by size so that two sets that link lie in one band or in
neighbouring ones. For a band, two linked sets differ in at most H elements. The
universe of shingles is cut by hash into m segments, and each segment gets a
budget: 0 (the two subsets are equal) or 1 (they differ by one element, found
through one-deletion neighbourhoods). If the budgets plus one sum to H + 1, by
the pigeonhole principle linked sets agree in some segment within its budget.
How many segments get budget 1 is chosen per band by cost, from the counted
size of the band: more index rows against fewer false candidates. The choice
never changes the result.

Equal sets form one class and are indexed as one. Pairs are formed inside tasks,
per bucket and pair of blocks of bounded size, and cut by set sizes and by a
parity sketch (the bits in which two sketches differ never exceed the
difference of the sets). What is left is united from the likeliest pair on, so
a group of near copies yields a spanning forest and not all its pairs; these
pairs are verified on the whole sets, then every remaining pair that passes the
cuts and whose ends are still apart is verified too. So components are exact.
Whole sets are built for the classes of pairs to verify only; all others are
known by size and sketch.
Sets are told apart by 64-bit hashes.

Defined results: lower case for A-Z only; texts of fewer words than a shingle
are one shingle; null, empty and blank texts have empty sets and link with
nothing; repeated ids with equal texts are one document, and each input row gives
a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioquery.llm.common import components, measured, read, whole_groups
from folioquery.operators.joins import fits_broadcast, pick_rows
from folioquery.session import freed_shuffles, materialize

WORDS = 3            # of a shingle
PERCENT = 90         # 100 * intersection >= PERCENT * union links
SHARED = 0.2         # cost model: chance that an element is shared with another document of the band
CHECK = 0.1          # and the cost of comparing two sketches, in index rows
SKETCH_BITS = 128, 4096  # least and most; beyond, sketches of long texts cut less
TEXTS_AT_ONCE = 500
WANTED_KEYS = 4_000_000  # keys of larger buckets that are sent to the tasks, 8 bytes each
GOING = 2_000_000    # documents known by id and text that are broadcast, 16 bytes each
BLOCK = 1024         # members of a bucket that meet in one task
PAIRS_AT_ONCE = 1 << 18

_U = np.uint64
_MUL = [_U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)]  # splitmix64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MUL[1]
    x = (x ^ (x >> _U(27))) * _MUL[2]
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return np.empty(0, _U)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    width = min(width, len(words))
    total = np.full(len(words) - width + 1, width, _U)
    for k in range(width):
        total = total * _MUL[0] + hashes[k:len(words) - width + 1 + k]
        total = mix(total)
    return np.unique(total)


def set_class(elements: np.ndarray) -> int:
    """One 64-bit id for equal sets."""
    return int(np.int64(xxhash.xxh3_64_intdigest(elements.tobytes()) - (1 << 63)))


def allowed(total: int | np.ndarray, percent: int = PERCENT):
    """Most elements in which two linked sets of this summed size differ."""
    return (100 - percent) * total // (100 + percent)


@functools.lru_cache(maxsize=16)
def bands(percent: int = PERCENT, largest: int = 1 << 40) -> list[int]:
    """Least sizes of the bands: linked sets lie in one band or in neighbours."""
    out = [1]
    while out[-1] <= largest:
        x = out[-1] + 1
        x = max(x, (out[-1] - 1) * 100 // percent + 1)
        while -(-percent * x // 100) < out[-1]:
            x += 1
        out.append(x)
    return out


def band_of(n: int, percent: int = PERCENT) -> int:
    return bisect.bisect_right(bands(percent), n) - 1


def allocate(band: int, population: int, percent: int = PERCENT) -> tuple[int, int, int, int]:
    """(segments, how many of them have budget 1, spare, least) of a band, least in cost; zeros if only equal sets link.

    Spare segments make up for tiny ones, of fewer than ``least`` elements, which tell
    little: a set with at most ``spare`` tiny segments leaves them out.
    """
    top = bands(percent)[band + 1] - 1
    budget = allowed(2 * top, percent)
    if budget == 0:
        return 0, 0, 0, 0
    best = None
    for ones in range(0, (budget + 1) // 2 + 1) if budget < 64 else [0]:
        m, spare, least = budget + 1 - ones, 0, 0
        for small in (1, 2):
            extra = 0
            for _ in range(8):
                size = top / (m + extra)
                tiny = (m + extra - ones) * math.exp(-size) * (1 + size * (small - 1))
                extra = math.ceil(tiny + 3 * math.sqrt(tiny))
            if extra <= (budget + 1) / (4 if small == 1 else 16):
                spare, least = extra, small
        m, size = m + spare, top / (m + spare)
        seen = CHECK * population
        cost = (m - ones) * (1 + seen * SHARED ** size) + ones * (1 + size) * (1 + seen * SHARED ** max(size - 1, 0))
        if best is None or cost < best[0]:
            best = cost, m, ones, spare, least
    return best[1:]


@functools.lru_cache(maxsize=1 << 14)
def _edges(m: int) -> np.ndarray:
    return np.array([(k << 64) // m for k in range(1, m)], _U)


def index_keys(elements: np.ndarray, plan: dict[int, tuple[int, int, int, int]], percent: int = PERCENT) -> np.ndarray:
    """Bucket keys of a set: in its band, and in the next one, where it may meet larger sets."""
    out, own = [], band_of(len(elements), percent)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(elements), dtype=_U)])
    single = sums[1:] - sums[:-1]
    for band in (own, own + 1):
        m, ones, spare, least = plan.get(band, (0, 0, 0, 0))
        if not m:
            continue
        bounds = np.concatenate([[0], np.searchsorted(elements, _edges(m)), [len(elements)]])
        whole = sums[bounds[1:]] - sums[bounds[:-1]]
        salt = mix(np.arange(m, dtype=_U) * _MUL[0] + _U(band * 2 + 1))
        keys, tiny = mix(whole * _MUL[0] + salt), np.diff(bounds) < least
        tiny[:ones] = False
        # Two sets that link agree in more than ``spare`` segments (by budget); if all of these
        # were tiny, both sets would have more than ``spare`` tiny ones and keep them.
        out.append(keys[~tiny] if tiny.sum() <= spare else keys)
        if ones:  # segments 0..ones-1 also through every subset with one element less
            upto = bounds[ones]
            segment = np.repeat(np.arange(ones), np.diff(bounds[:ones + 1]))
            out.append(mix((whole[segment] - single[:upto]) * _MUL[0] + salt[segment]))
    return np.unique(np.concatenate(out)) if out else np.empty(0, _U)


def sketch(elements: np.ndarray, percent: int = PERCENT) -> bytes:
    """Parities of the elements that fall on each of a number of places; more places for larger sets.

    Its two halves, added, are the sketch with half the places.
    """
    bits = SKETCH_BITS[0]
    while bits < SKETCH_BITS[1] and bits < 4 * allowed(2 * len(elements), percent):
        bits *= 2
    counts = np.bincount((mix(elements ^ _MUL[2]) & _U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(bool)).tobytes()


class _Sketches:
    """Sketches of rows, comparable at the size of the smaller one."""

    def __init__(self, rows: list[bytes]):
        self.size = np.array([len(r) for r in rows])
        self.place, self.table = {}, {}
        for size in np.unique(self.size).tolist():
            native, double = np.flatnonzero(self.size == size), np.flatnonzero(self.size == 2 * size)
            halves = np.frombuffer(b"".join(rows[k] for k in double), np.uint64).reshape(len(double), 2, size // 8)
            self.table[size] = np.concatenate([
                np.frombuffer(b"".join(rows[k] for k in native), np.uint64).reshape(len(native), size // 8), halves[:, 0] ^ halves[:, 1]])
            self.place[size] = np.full(len(rows), -1)
            self.place[size][np.concatenate([native, double])] = np.arange(len(native) + len(double))

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many places the sketches of two rows differ: at most the difference of the sets."""
        out, size = np.zeros(len(x), np.int64), np.minimum(self.size[x], self.size[y])
        for one in np.unique(size).tolist():
            table, place = self.table[one], self.place[one]
            at = np.flatnonzero((size == one) & (place[x] >= 0) & (place[y] >= 0))
            for part in np.array_split(at, -(-len(at) * one // (1 << 26)) or 1):
                out[part] = np.bitwise_count(table[place[x[part]]] ^ table[place[y[part]]]).sum(1, dtype=np.int64)
        return out


def _texts(batch: pd.DataFrame):
    """Texts of a batch, some at a time."""
    for a in range(0, len(batch), TEXTS_AT_ONCE):
        part = batch.iloc[a:a + TEXTS_AT_ONCE]
        yield part, [t if isinstance(t, str) else "" for t in part["text"]]


def index_rows(docs: DataFrame, plan: dict, width: int, percent: int) -> DataFrame:
    """Index rows (bucket, cls) of all sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: set = set()
            for _, texts in _texts(batch):
                keys, owners = [np.empty(0, _U)], []
                for text in texts:
                    elements = shingle_set(text, width)
                    cls = set_class(elements)
                    if len(elements) and cls not in seen:
                        seen.add(cls)
                        keys.append(index_keys(elements, plan, percent))
                        owners.append((cls, len(keys[-1])))
                if owners:
                    yield pd.DataFrame({"bucket": np.concatenate(keys).view(np.int64), "cls": np.repeat(*np.array(owners, np.int64).T)})

    return docs.select("text").mapInPandas(run, "bucket long, cls long")


def document_rows(docs: DataFrame, plan: dict, width: int, percent: int, wanted: np.ndarray | None) -> DataFrame:
    """Document rows (doc_id, _t, n, cls, sketch), _t a hash of the text, and in the same pass index rows (bucket, cls) of the wanted buckets.

    Of equal sets met together one row has the sketch.
    """
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = shared.value
        for batch in batches:
            seen: set = set()
            for part, texts in _texts(batch):
                sizes, classes, sketches, keys, owners = [], [], [], [np.empty(0, np.int64)], []
                for text in texts:
                    elements = shingle_set(text, width)
                    sizes.append(len(elements))
                    classes.append(set_class(elements))
                    new = len(elements) > 0 and classes[-1] not in seen
                    sketches.append(sketch(elements, percent) if new else None)
                    if new:
                        seen.add(classes[-1])
                    if new and wanted is not None and len(wanted):
                        found = index_keys(elements, plan, percent).view(np.int64)
                        found = found[wanted[np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)] == found]
                        keys.append(found)
                        owners.append((classes[-1], len(found)))
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "_t": part["_t"].array, "n": sizes, "cls": classes,
                                    "sketch": sketches, "bucket": pd.array([pd.NA] * len(part), "Int64")})
                if sum(n for _, n in owners):
                    bucket = pd.array(np.concatenate(keys), "Int64")
                    none = pd.array(np.zeros(len(bucket), np.int64), "Int64")
                    none[:] = pd.NA
                    yield pd.DataFrame({"doc_id": none, "_t": 0, "n": 0, "cls": np.repeat(*np.array(owners, np.int64).T),
                                        "sketch": None, "bucket": bucket})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("_t")).mapInPandas(
        run, "doc_id long, _t long, n long, cls long, sketch binary, bucket long")


def class_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cls, elements) of the wanted classes, from one document (doc_id) of each.

    Classes that only rows without an id hold are found among those rows' distinct texts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, texts in _texts(batch):
                sets = [shingle_set(t, width) for t in texts]
                yield pd.DataFrame({"cls": [set_class(s) for s in sets], "elements": [s.tobytes() for s in sets]})

    columns = "cls long, elements binary"
    picked = pick_rows(docs.select("doc_id", "text"), wanted.where("doc_id IS NOT NULL").select("doc_id"), "doc_id")
    without = docs.where("doc_id IS NULL").select("doc_id", "text").dropDuplicates(["text"]).mapInPandas(run, columns)
    asked = wanted.where("doc_id IS NULL").select("cls")
    return picked.mapInPandas(run, columns).unionAll(without.join(asked, "cls", "left_semi").dropDuplicates(["cls"]))


def _bucket_pairs(frame: pd.DataFrame):
    """Index pairs (x, y) of rows that share a unit and, between two blocks, come from different ones."""
    unit = frame[["bucket", "i", "j"]].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]).any(1)]))
    ends = np.append(starts[1:], len(frame))
    row_end = np.repeat(ends, ends - starts)
    block, diagonal = frame["block"].to_numpy(), (frame["i"] == frame["j"]).to_numpy()
    partners = row_end - np.arange(len(frame)) - 1
    cum = np.cumsum(partners)
    at = 0
    while at < len(frame):
        stop = max(at + 1, int(np.searchsorted(cum, (cum[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        x = np.repeat(np.arange(at, stop), partners[at:stop])
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(partners[at:stop]) - partners[at:stop], partners[at:stop])
        keep = diagonal[x] | (block[x] != block[y])
        yield x[keep], y[keep]
        at = stop


def _survivors(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Distinct pairs (a < b) of classes, of different components, that sizes and sketches allow, with a bucket where they meet."""
    sketches = _Sketches(frame["sketch"].tolist())
    n, cls, comp, bucket = (frame[c].to_numpy() for c in ("n", "cls", "component", "bucket"))
    out = []
    for x, y in _bucket_pairs(frame):
        small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        fit = (comp[x] != comp[y]) & (100 * small >= percent * large)
        x, y = x[fit], y[fit]
        away = sketches.apart(x, y)
        fit = away <= allowed(n[x] + n[y], percent)
        x, y = x[fit], y[fit]
        out.append(pd.DataFrame({"a": np.minimum(cls[x], cls[y]), "b": np.maximum(cls[x], cls[y]),
                                 "away": away[fit] * 1000 // np.maximum(n[x] + n[y], 1), "bucket": bucket[x]}))
    return pd.concat(out, ignore_index=True).drop_duplicates(["a", "b"]) if out else pd.DataFrame({"a": [], "b": [], "away": [], "bucket": []})


def _forest(pairs: pd.DataFrame, component: dict) -> pd.DataFrame:
    """The pairs that unite components, likeliest first."""
    root: dict = {}

    def find(v):
        v = component[v]
        while root.get(v, v) != v:
            root[v] = root.get(root[v], root[v])
            v = root[v]
        return v

    kept = []
    pairs = pairs.sort_values(["away", "a", "b"])
    for k, (a, b) in enumerate(zip(pairs["a"].tolist(), pairs["b"].tolist())):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(k)
    return pairs.iloc[kept]


def candidates(members: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs (a, b) to verify among (bucket, i, j, block, cls, n, sketch, component); of a forest also the buckets with pairs that it leaves out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, ["bucket", "i", "j"]):
            pairs = _survivors(frame, percent)
            kept = _forest(pairs, dict(zip(frame["cls"].tolist(), frame["component"].tolist()))) if forest and len(pairs) else pairs
            yield kept[["a", "b"]].astype("Int64").assign(bucket=pd.array([pd.NA] * len(kept), "Int64"))
            if len(kept) < len(pairs):
                out = pd.array(pairs["bucket"].drop(kept.index).unique(), "Int64")
                none = pd.array([pd.NA] * len(out), "Int64")
                yield pd.DataFrame({"a": none, "b": none, "bucket": out})

    keys = ["bucket", "i", "j"]
    return members.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a long, b long, bucket long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["ea"], batch["eb"]):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[keep, ["a", "b"]]

    left = sets.select(F.col("cls").alias("a"), F.col("elements").alias("ea"))
    right = sets.select(F.col("cls").alias("b"), F.col("elements").alias("eb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ea", "eb").mapInPandas(run, "a long, b long")


def grouped_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, text) to (doc_id, _t, n, _g, _low), a row per input row.

    _t: hash of the text; _g: the group; _low: its smallest id. A text without words has neither group nor smallest id.
    """
    with freed_shuffles(docs.sparkSession):  # the index is the largest, and may be shuffled twice
        return _grouped_rows(docs, width, percent)


def _grouped_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    about = docs.select(F.expr(r"greatest(1, regexp_count(coalesce(text, ''), r'[^\x20\x09-\x0D]+') - 2)").alias("n"))
    limits = bands(percent)
    counted = about.select(F.floor(F.log(F.col("n").cast("double")) * 64).alias("g")).groupBy("g").agg(F.count("*").alias("c")).collect()  # a few hundred rows at most: sizes on a log scale
    population: dict[int, int] = {}
    for row in counted:
        k = band_of(max(1, int(math.exp((row["g"] + 0.5) / 64))), percent)
        population[k] = population.get(k, 0) + row["c"]
    last = max(population, default=0) + 8
    plan = {k: allocate(k, population.get(k, 0) + population.get(k - 1, 0), percent) for k in range(min(last, len(limits) - 2) + 1)}
    index = index_rows(docs, plan, width, percent)
    shared = materialize(index.groupBy("bucket").agg(F.min("cls").alias("_lo"), F.max("cls").alias("_hi"), F.count("*").alias("_c"))
                         .where("_lo != _hi"), "jaccard-buckets")
    two = shared.where("_c = 2").select("_lo", "_hi").distinct().select(  # a pair shares many buckets and is met once
        F.xxhash64("_lo", "_hi").alias("bucket"), F.explode(F.array("_lo", "_hi")).alias("cls"), F.lit(1).alias("_blocks"))
    large = shared.where("_c > 2").select("bucket", F.ceil(F.col("_c") / BLOCK).cast("int").alias("_blocks"))
    # The texts are read again, not the index written: its rows would outweigh the texts. Only the
    # rows of larger buckets leave the tasks, while these buckets' keys are few; else they are joined.
    few = fits_broadcast(large, WANTED_KEYS)
    wanted = np.sort(large.select("bucket").toPandas()["bucket"].to_numpy(np.int64)) if few else None
    rows = materialize(document_rows(docs, plan, width, percent, wanted), "jaccard-documents")
    texts = rows.where("bucket IS NULL").select("doc_id", "_t", "n", "cls", "sketch")
    of_large = rows.where("bucket IS NOT NULL").select("bucket", "cls") if few else index
    many = of_large.join(measured(large), "bucket").groupBy("bucket", "cls").agg(F.max("_blocks").alias("_blocks"))
    members = materialize(two.unionAll(many), "jaccard-members")
    first = texts.groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    sketches = materialize(texts.where("sketch IS NOT NULL").select("cls", "n", "sketch")
                           .join(members.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"]), "jaccard-sketches")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs that link, by the whole sets of their classes, which are few of all."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        wanted = materialize(first.join(ends, "cls", "left_semi"), "jaccard-wanted")
        sets = materialize(class_sets(docs, wanted, width), "jaccard-sets")
        return materialize(verified(pairs, sets, percent), "jaccard-links")


    def units(members: DataFrame) -> DataFrame:
        block = F.pmod(F.xxhash64("cls"), F.col("_blocks")).cast("int")
        each = members.withColumn("block", block).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        return each.select("bucket", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), "block", "cls").join(sketches, "cls")

    met = materialize(candidates(units(members).withColumn("component", F.col("cls")), percent, True), "jaccard-forest")
    likely = met.where("a IS NOT NULL").select("a", "b")
    links = linked(likely)
    nodes = sketches.select(F.col("cls").alias("id"))
    groups = materialize(components(nodes, links, "jaccard"), "jaccard-groups").withColumnRenamed("id", "cls")
    # Where the forest has all pairs of a bucket, they are verified; members of the other buckets meet once more.
    again = members.join(measured(met.where("bucket IS NOT NULL").select("bucket").distinct()), "bucket", "left_semi")
    rest = candidates(units(again).join(groups, "cls"), percent, False).select("a", "b").join(likely, ["a", "b"], "left_anti")
    more = linked(materialize(rest, "jaccard-rest"))
    groups = components(nodes, links.unionAll(more), "jaccard").withColumnRenamed("id", "cls")

    named = first.join(groups, "cls", "left").withColumn("_g", F.coalesce("component", "cls"))
    lowest = named.groupBy("_g").agg(F.min("doc_id").alias("_low"))
    of_class = materialize(named.join(lowest, "_g").select("cls", "_g", "_low"), "jaccard-classes")
    worded = lambda c: F.when(F.col("n") > 0, F.col(c)).alias(c)
    return texts.join(of_class, "cls", "left").select("doc_id", "_t", "n", worded("_g"), worded("_low"))


def jaccard_groups(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text) to (doc_id, n_shingles, component_id), a row per input row."""
    return grouped_rows(docs, width, percent).select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("_low")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each group, of the smallest id (null last); texts without words all stay; columns as they came.

    A row is known by its id and its text's hash; rows that are equal in both are met once more and one of them stays.
    """
    rows = grouped_rows(docs, width, percent)
    alike = rows.groupBy("doc_id", "_t").agg(F.min("_g").alias("_g"), F.count("*").alias("_c"))
    low = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_t")
    best = alike.where("_g IS NOT NULL").groupBy("_g").agg(F.min_by(F.struct("doc_id", "_t", "_c"), low).alias("_best"))
    best = best.select("_g", F.col("_best.doc_id").alias("_id"), F.col("_best._t").alias("_h"))
    stays = F.col("_g").isNull() | (F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_h")))
    many = F.col("_g").isNotNull() & (F.col("_c") > 1)
    alike = materialize(alike.join(best, "_g", "left").select("doc_id", "_t", stays.alias("_stays"), many.alias("_many")), "jaccard-alike")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h"))

    def met(which: DataFrame, how: str) -> DataFrame:
        return packed.join(which, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("_t")), how)

    # Those that go are few as a rule; while they can be broadcast, no text is shuffled.
    go = alike.where("NOT _stays OR _many").select("doc_id", "_t")
    once = met(F.broadcast(go), "left_anti") if fits_broadcast(go, GOING) else met(alike.where("_stays AND NOT _many"), "left_semi")
    many = alike.where("_stays AND _many").select("doc_id", "_t")
    once = once.select("_doc.*")
    if many.isEmpty():
        return once
    return once.unionAll(met(measured(many), "left_semi").groupBy("_id", "_h").agg(F.min_by("_doc", F.to_json("_doc")).alias("_doc")).select("_doc.*"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, component_id
FROM documents JOIN c ON documents.doc_id = id LEFT JOIN n ON n.doc_id = documents.doc_id"""
