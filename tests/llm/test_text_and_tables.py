"""Language ids, Merkle manifests and periodic runs against brute force, on small tables with every awkward row."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_operators import PROSE, SCHEMA, sample_rows, words


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def empty_folder(spark, empty, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    empty.write.parquet(f"{path}/documents.parquet")
    return path


# --- 13 -----------------------------------------------------------------------

def brute_runs(w, least=24, times=3):
    """Every maximal stretch of every period; of equal stretches the smallest period stays."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            end = i
            while end < len(w) and w[end] == w[end - q]:
                end += 1
            start, length = i - q, end - i + q
            if length >= max(least, times * q):
                found.setdefault((start, length), q)
            i = end
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def some_words(rng):
    """Words with repeats of all kinds: constant stretches, powers of short and long words, near repeats, chains."""
    out = []
    for _ in range(rng.randint(1, 7)):
        kind = rng.randint(0, 5)
        if kind == 0:
            out += [rng.choice("ab") for _ in range(rng.randint(0, 60))]
        elif kind == 1:
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 40))]
            out += (unit * rng.randint(1, 8))[: rng.randint(1, 250)]
        elif kind == 2:
            out += [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 80))]
        elif kind == 3:
            out += ["a"] * rng.randint(0, 90)
        elif kind == 4 and out:
            out += out[-rng.randint(1, len(out)):] * rng.randint(1, 4)
        else:
            unit = ["a"] * rng.randint(1, 30) + ["b"]
            out += unit * rng.randint(2, 5)
    return out[:700]


def test_runs_equal_brute_force():
    from folioquery.llm.periods import runs_of
    rng = random.Random(5)
    seen = 0
    for _ in range(1500):
        w = some_words(rng)
        least, times = rng.choice([(24, 3), (24, 3), (3, 3), (10, 4), (50, 3)])
        want = brute_runs(w, least, times)
        assert runs_of(w, least, times) == want, w
        seen += len(want)
    assert seen > 1000


def test_runs_of_very_long_texts():
    from folioquery.llm.periods import runs_of
    n = 300_000
    assert runs_of([b"a"] * n) == [(0, n, 1)]
    rng = random.Random(1)
    unit = [rng.choice("ab") for _ in range(70_001)]
    head = [f"x{i}" for i in range(500)]
    assert (500, 280_004, 70_001) in runs_of(head + unit * 4 + ["end"])


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected_runs(doc_id, text):
    w = planted(doc_id, words(text))
    runs = brute_runs(w)
    keep = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
    best = sorted(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))[:1]
    top = (best[0][0], best[0][1], best[0][2], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    return (len(runs), *top, hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(keep).encode()).hexdigest())


def test_periodic_runs_query(spark, folder, empty_folder):
    from folioquery.llm import periods
    want = sorted((str(r[0]), *map(str, expected_runs(r[0], r[1]))) for r in sample_rows())
    out = periods.op13_periodic_runs(spark, folder)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(tuple(map(str, r)) for r in out.collect()) == want
    assert periods.op13_periodic_runs(spark, empty_folder).count() == 0


def test_planted_ids_equal_brute_force(spark, tmp_path):
    from folioquery.llm import periods
    rows = [(i, " ".join(f"w{(i * k) % 97}" for k in range(20 + i % 150))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r[0]: tuple(r[1:]) for r in periods.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert got == {i: expected_runs(i, t) for i, t in rows}
    assert sum(1 for v in got.values() if v[0]) > 20


def test_runs_keep_whole_texts(spark):
    from folioquery.llm.periods import periodic_runs
    text = "start " + "tick tock " * 20 + "end of it"
    row = spark.createDataFrame([(text,)], "text string").select(periodic_runs(F.col("text")).alias("r")).first().r
    assert (row.n_words, [tuple(x) for x in row.runs], row.collapsed) == (44, [(1, 40, 2)], "start tick tock end of it")
    with pytest.raises(ValueError):
        periodic_runs(F.col("text"), times=2)


# --- 12 -----------------------------------------------------------------------

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    doc_id, text, lang, source, n_chars = row[:5]
    return h(*map(field, (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """The top hash, and for every node its siblings on the way up as (left, right)."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(place):
            run = nodes[p // 16 * 16: p // 16 * 16 + 16]
            paths[k].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1:])))
            place[k] = p // 16
        nodes = [h(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made[s] = climb([leaf(r) for r in groups[s]])
    root, tops = climb([made[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for r, path in zip(groups[s], made[s][1]):
            now = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                now = (r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            end = leaf(now)
            for left, right in path + top:
                end = h(left, end, right)
            out.append((r[0], leaf(r), made[s][0], root, h(*(a + b for a, b in path + top)), end, end == root))
    return sorted(out, key=str)


def test_manifest_query(spark, folder, empty_folder):
    from folioquery.llm import manifest
    out = manifest.op12_merkle_manifest(spark, folder)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, out.collect()), key=str) == brute_manifest(sample_rows())
    assert manifest.op12_merkle_manifest(spark, empty_folder).count() == 0


@pytest.mark.parametrize("n, sources", [(1, ["s"]), (16, ["s"]), (17, ["s"]), (600, ["s"]), (900, ["a", "a", "b", None, "é", "z", "a"]),
                                        (300, [f"src{i}" for i in range(40)] + [None])])
def test_manifest_shapes(spark, tmp_path, n, sources):
    from folioquery.llm import manifest
    rows = [(i, f"Text {i} ÄB", None if i % 7 == 0 else "en", sources[i % len(sources)], None if i % 5 == 0 else i) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, manifest.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=str)
    assert got == brute_manifest(rows)
    if n > 16:
        assert {v[6] for v in got} == {True, False}


def test_manifest_carries_clashing_columns(spark):
    from folioquery.llm import manifest
    rows = spark.createDataFrame([(1, "a", "k", 9), (2, "a", "l", 8)], "key long, g string, path string, n long")
    made = manifest.build(rows.withColumn("leaf", manifest.leaf_hash([F.col("key"), F.col("path")])), "g", "key", "leaf")
    proofs = manifest.with_proofs(made).withColumn("end", manifest.folded(F.col("leaf")))
    assert {(r.row.key, r.row.path, r.row.n) for r in proofs.collect()} == {(1, "k", 9), (2, "l", 8)}
    assert made.n_leaves == 2 and proofs.where("end = root").count() == 2


def test_manifest_in_shuffled_form(spark, tmp_path, monkeypatch):
    """Groups past the bound of a broadcast are joined by a shuffle, heavy ones over salts."""
    from folioquery.llm import manifest
    from folioquery.operators import joins
    rows = [(i, f"t{i}", "en", ["hot", None, "b"][0 if i % 3 else i % 9 // 3], i) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(joins, "fits_broadcast", lambda *a, **k: False)
    assert sorted(map(tuple, manifest.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=str) == brute_manifest(rows)


# --- 11 -----------------------------------------------------------------------

def brute_grams(text, orders=4):
    """Every n-gram of every word with a mark at both ends; what joins two words is no n-gram."""
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            padded = f"\0{word}\0"
            out += [padded[i:i + n] for n in range(1, orders + 1) for i in range(len(padded) - n + 1) if padded[i:i + n] != "\0"]
            word = ""
    return out


def test_grams_equal_brute_force():
    from folioquery.llm import language
    texts = ["Hello, world", "", "...", "a", "ñandú--ß x9y", PROSE]
    at, where = language.grams(texts, 1 << 30)
    for k, text in enumerate(texts):
        mine, want = where[at == k], brute_grams(text)
        single = [g for g in want if len(g) == 1 or g.count("\0") < 2 or len(g) > 2]
        # Bigrams of a mark behind one word and the next word's mark are counted by neither.
        assert len(mine) == len(single)
        assert len(set(mine.tolist())) == len(set(single))


def test_slices_lose_nothing(monkeypatch):
    from folioquery.llm import language
    text = " ".join(f"word{chr(97 + i % 26)} Über" for i in range(3000))
    whole = np.bincount(language.grams([text])[1], minlength=language.BUCKETS)
    monkeypatch.setattr(language, "SLICE", 1000)
    parts = list(language._slices(text))
    assert len(parts) > 20 and "".join(parts) == text
    assert (sum(np.bincount(language.grams([p])[1], minlength=language.BUCKETS) for p in parts) == whole).all()


LANGUAGES = {"en": "the and with from this that have they which would there their about",
             "de": "der die das und nicht mit sich auch werden haben einer über nach",
             "fr": "le la les des une est dans pour que qui sur avec plus pas"}


def language_rows(n, seed=3):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(LANGUAGES[lang].split()) for _ in range(rng.randint(5, 40))), lang, "s", 0)
            for i in range(n) for lang in [rng.choice(["en"] * 8 + ["de", "fr"])]]


def brute_posterior(train, text, buckets):
    from folioquery.llm import language
    counts, docs = {}, {}
    for _, t, lang, *_ in train:
        counts[lang] = counts.get(lang, 0) + np.bincount(language.grams([t], buckets)[1], minlength=buckets)
        docs[lang] = docs.get(lang, 0) + 1
    names, where = sorted(counts), language.grams([text], buckets)[1]
    logs = np.array([np.log(docs[x] / sum(docs.values())) + np.log((counts[x][where] + language.SMOOTH) /
                     (counts[x].sum() + language.SMOOTH * buckets)).sum() for x in names])
    p = np.exp(logs - logs.max())
    return names[int(logs.argmax())], float(p.max() / p.sum())


@pytest.mark.parametrize("block", [1 << 24, 1 << 10])
def test_posteriors_equal_brute_force(spark, monkeypatch, block):
    """With one matrix, and with a block for each language."""
    from folioquery.llm import language
    monkeypatch.setattr(language, "MATRIX", block)
    rows = language_rows(200)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    model = language.train(df.where("doc_id < 150"), 1 << 10)
    asked = spark.createDataFrame([(k, t) for k, t in enumerate(["und", "with the", "x", "die mit est", "q q q"])], "doc_id long, text string")
    for r in language.predict(asked, model).collect():
        want = brute_posterior(rows[:150], r.text, 1 << 10)
        assert r.language.lang_pred == want[0] and abs(r.language.score - want[1]) < 1e-4
    held = language.predict(df.where("doc_id >= 150"), model)
    assert held.where("language.lang_pred = lang").count() >= 49


def test_language_query(spark, folder, empty_folder, tmp_path):
    from folioquery.llm import language
    got = language.op11_language_id(spark, folder).collect()
    assert len(got) == len(sample_rows())
    letterless = {i for i, (_, t, *_) in enumerate(sample_rows()[:16]) if not any(c.isalpha() for c in t or "")}
    for r in got:
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (r.doc_id in letterless)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.lang_pred in ("en", "fr", "und")
    assert language.op11_language_id(spark, empty_folder).count() == 0
    spark.createDataFrame([(1, "words", None), (2, None, "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {(r.lang_pred, r.score) for r in language.op11_language_id(spark, str(tmp_path)).collect()} == {("und", 0.0)}
