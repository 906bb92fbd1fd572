"""What operators leave on disk while they run."""

import pandas as pd
import pytest

from folioquery.llm import jaccard
from folioquery.session import FREE_SHUFFLES


def _members(rows):
    return pd.DataFrame([(b, 0, 0, 0, c, 10, bytes(16), c) for b, c in rows], columns=["bucket", "i", "j", "block", "cls", "n", "sketch", "component"])


def test_only_buckets_that_the_forest_does_not_exhaust_meet_again(spark):
    """Three near sets give two pairs and their bucket, two give their pair."""
    df = spark.createDataFrame(_members([(1, 5), (1, 6), (1, 7), (2, 8), (2, 9)]),
                               "bucket long, i int, j int, block int, cls long, n long, sketch binary, component long")
    rows = {tuple(r) for r in jaccard.candidates(df, 80, True).collect()}
    assert (None, None, 1) in rows and (8, 9, None) in rows and len(rows) == 4
    assert {tuple(r)[:2] for r in jaccard.candidates(df, 80, False).collect()} == {(5, 6), (5, 7), (6, 7), (8, 9)}


@pytest.mark.parametrize("keys", [jaccard.WANTED_KEYS, 0])
def test_shuffles_of_near_duplicates_are_freed(spark, monkeypatch, keys):
    """Each table's shuffle files go once it is written, also where large buckets are met by joins."""
    freed, write, before = [], jaccard.materialize, spark.conf.get(FREE_SHUFFLES, "false")
    monkeypatch.setattr(jaccard, "WANTED_KEYS", keys)
    monkeypatch.setattr(jaccard, "materialize", lambda df, name: freed.append(spark.conf.get(FREE_SHUFFLES)) or write(df, name))
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join(words[:-1] + ["x"]), " ".join([*words, "y"]), " ".join(words[::-1]), "alone"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_groups(docs, 3, 80).collect()}
    assert groups == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}
    assert set(freed) == {"true"} and spark.conf.get(FREE_SHUFFLES, "false") == before


def test_tables_that_nothing_reads_any_more_go(spark):
    """Of the tables of context mixing the one that is scored stays."""
    import os

    from folioquery.llm import context_mixing as lm
    from folioquery.session import work_dir
    folder = work_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    df = spark.createDataFrame([(k, f"some words of text {k % 7} and word{k % 3}") for k in range(40)], "doc_id long, text string").repartition(3)
    assert lm.score_documents(df).count() == 40
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before} == {"lm-found", "lm-parts"}
