"""Files cut in one pass give what the running columns give."""

import random

import pytest
from pyspark.sql import functions as F

from folioquery.functions import fixed_values as fv
from folioquery.operators.files import note_of
from folioquery.operators.parse import ParseOptions, document_lines, parse_chunks, parse_lines

LONG = "This paragraph is certainly longer than forty characters."
SPACES = [" ", " ", "\x1c", "\x85", " ", "\t", "　"]
LINES = ["# Doc", "## Part", "## Table 1 Things", "## Table", "## Table 2 x", "### Accountable", "### Tables, all", "### Figure 1", "### a diagram", "### Sub",
         "| A | B |", "|---|---|", "| a | b |", "| a |", "|  |  |", "|x|", "|", "- one", "* two", "- [7] Author", "- [7] Author", "- [٧] Author",
         LONG, LONG + "[^a]", LONG + "[^éx] [^b]", "short", "[^a]: first [^b]", "[^b]: " + "z" * 301, "[^a]:again", "[^éx]: accent", "[^a b]: no note",
         "[^a]:", "[^a]: one two", "> quoted words", "> - item", ">", "**Table 2: T**", "**Figure 3: F**", "** fIgure 4**", "**İ no**", "**Fıgure 5**",
         "**table**", "> **Table 6: T**", "---", "![x](y.png)", "", "", "GV-1.1 and ISO 42001", "  # Spaced  ", "#### four", "ǅß İtable"]


def _text(rng: random.Random) -> str:
    ends = ["\n", "\n", "\n", "\r\n", "\r"]
    odd = lambda line: rng.choice(SPACES) + line + rng.choice(SPACES) if rng.random() < 0.1 else line
    return "".join(odd(rng.choice(LINES)) + rng.choice(ends) for _ in range(rng.randrange(0, 60)))


@pytest.mark.parametrize("compat", [True, False])
def test_random_files(spark, compat):
    rng = random.Random(7)
    rows = [(k if k % 50 else None, _text(rng)) for k in range(1, 400)]
    rows = [r for r in rows if r[0] is not None] + [(None, rows[49][1]), (1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "file_id long, value string").repartition(4)
    rows_of = lambda df: sorted(map(str, df.collect()))
    want = rows_of(parse_lines(document_lines(docs), ParseOptions(compat)))
    got = rows_of(parse_chunks(docs, ParseOptions(compat)))
    assert len(want) > 2000 and got == want


def test_files_of_one_id_are_one(spark):
    text = f"# Doc\n{LONG}[^a]\n[^a]: note\n\n- one\n- two\n## Table 1 T\n| A | Requirement |\n|---|---|\n| a | r |\n| b | q |\n"
    docs = spark.createDataFrame([(1, text), (2, text), (1, text), (None, text), (None, text)], "file_id long, value string").repartition(3)
    want = sorted(map(str, parse_lines(document_lines(docs)).collect()))
    assert sorted(map(str, parse_chunks(docs).collect())) == want


def test_lines_are_neither_sorted_nor_grouped(spark):
    docs = spark.createDataFrame([(1, LONG)], "file_id long, value string").repartition("file_id")
    plan = parse_chunks(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan and plan.count("Window") == 1


def test_notes_as_the_pattern_has_them(spark):
    lines = [x for x in LINES if x.startswith("[^")] + ["[^_9]: x", "[^́]: mark", "[^²]: two", "[^‍]: join", "[^Ⅰ]: roman", "[^‿]: tie", "[^]: x"]
    pattern = r"(?U)^\[\^(\w+)\]:\s*(.+)"
    rows = spark.createDataFrame([(x,) for x in lines], "s string").select(
        "s", F.col("s").rlike(pattern).alias("is"), *[F.regexp_extract("s", pattern, g).alias(f"g{g}") for g in (1, 2)]).collect()
    assert [note_of(r["s"]) for r in rows] == [(r["g1"], r["g2"]) if r["is"] else None for r in rows]
    assert all(chr(c).isspace() == (chr(c) in fv.WHITESPACE) for c in range(0x3100))
