"""JSON arrays cut at every comma, wherever splits fall, against the json module."""

import json
import random

import pytest

from folioquery.sources.json_array import read_array


def got_of(spark, path, **options):
    rows = sorted((r["index"], r["item"]) for r in read_array(spark, path, **options).collect())
    return [i for i, _ in rows], [x for _, x in rows]


def random_value(rng, depth=0):
    kind = rng.randint(0, 6 if depth < 3 else 3)
    if kind == 0:
        return "".join(rng.choice('ab,[]{}"\\ \n\té :') for _ in range(rng.randint(0, 12)))
    if kind == 1:
        return rng.choice([None, True, False, 0, -1.5, 10**12])
    if kind in (2, 3):
        return rng.choice(["", ",", "\\", '"', "],[", '\\",'])
    if kind == 4:
        return [random_value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice(['k', ',', '"', '}']) + str(i): random_value(rng, depth + 1) for i in range(rng.randint(0, 4))}


@pytest.mark.parametrize("indent, split", [(None, 200), (2, 333)])
def test_arrays_equal_the_json_module(spark, tmp_path, indent, split):
    rng = random.Random(split)
    items = [random_value(rng) for _ in range(120)]
    path = tmp_path / "golden.json"
    path.write_text(" \n" + json.dumps(items, indent=indent, ensure_ascii=rng.random() < 0.5) + "\n ")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        index, found = got_of(spark, str(path), stripe=500)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert index == list(range(1, 121))
    for want, item in zip(items, found):
        if isinstance(want, str) or want is None:
            assert item == want
        else:
            assert json.loads(item) == want


@pytest.mark.parametrize("text", ["", "{}", '"text"', "[1,2", "1,2]", "[1,,2]", "[1,]", "[1],", "[1],[2]", '["a]', "[{]}", "[1 2]", "[] x"])
def test_malformed_files_fail(spark, tmp_path, text):
    (tmp_path / "g.json").write_text(text)
    with pytest.raises(ValueError, match="not a JSON array"):
        read_array(spark, str(tmp_path / "g.json"))


def test_empty_and_single(spark, tmp_path):
    for text, want in (("[]", []), (" [ ] ", []), ("[ 7 ]", ["7"]), ('["a, b"]', ["a, b"]), ("[null]", [None])):
        (tmp_path / "g.json").write_text(text)
        assert got_of(spark, str(tmp_path / "g.json"))[1] == want
