"""Parser fixtures: one small markdown text per rule."""

import pytest
from pyspark.sql import functions as F

from folioquery.operators.parse import ParseOptions, child_store, content_type_histogram, parent_store, parse_chunks, with_siblings

LONG = "This paragraph is certainly longer than forty characters."

CASES = {
    "short": "x" * 39 + "\n\n" + "y" * 40,
    "joined": "First line of a paragraph that is long\n---\nenough to be kept.",
    "lists": "- one\n* two\n\n- three",
    "table": ("# Doc\n## Part\n## Table 1 Things\nWhat it shows.\n| A | Requirement |\n|---|---|\n| a1 | r1 |\n"
              "\n| a2 | r2 |\n---\n| only one |\nAfter the table comes a paragraph of enough length."),
    "single": "## Table 9\n| A |\n| x |",
    "empty_header": "## Table 1\n|  |  |\n|---|---|\n| Name | Value |\n| n1 | v1 |\n| n2 | v2 |",
    "figure": "### Figure 1 Flow\n![x](y.png)\n> quoted\n- bullet\n\n" + LONG + "\n## Next\n" + LONG,
    "accountable": "### Figure 4 Accountable roles\n- a\n- b",
    "bold": LONG + "\n**Table 2: Things**\nlead in\n| H |\n|---|\n| v |\n**Figure 3: Pic**\nbody\n**Table 4: not a table**",
    "notes": (LONG + "[^a]\n[^a]: first\n[^b]: " + "z" * 301 + "\n[^a]: see [^b]"),
    "bibliography": "- one\n- [7] Author\n- two",
    "stale": "## A\n### Sub\n" + LONG + "\n## B\n" + LONG,
    "pipes": "| a | b |\n| c | d | e | f | g | h | i | j | k |\n" + LONG,
    "refs": "Apply GOVERN 1.2 and map activities from 3.4; MP 2.1, GV-1.1-001 and ISO/IEC 42001 also apply.",
    "deep": "#### not a heading but a paragraph of sufficient length",
    "keys": "## Table 1\n| k | k | z |\n|---|---|---|\n| 1 | 2 | 3 |",
    "separator_first": "## Table 1\n|---|---|\n| a | b |\n| c | d |",
    "two_tables": "## Table 1\n| A |\n| x |\n| y |\n## Table 2\n| A |\n| z |\n| w |",
}


@pytest.fixture(scope="module")
def parsed(spark):
    order = list(CASES)
    docs = spark.createDataFrame([(i + 1, CASES[c]) for i, c in enumerate(order)], "file_id long, value string")
    out = {}
    for compat in (True, False):
        for r in with_siblings(parse_chunks(docs, ParseOptions(compat))).orderBy("file_id", "n").collect():
            out.setdefault((order[r["file_id"] - 1], compat), []).append(r)
    return lambda case, compat=True: out.get((case, compat), [])


def ids(rows):
    return [r["id"].split("_", 1)[1] for r in rows]


def test_short_paragraph_takes_no_number(parsed):
    rows = parsed("short")
    assert ids(rows) == ["p0"] and rows[0]["text"].endswith("Content: " + "y" * 40)


def test_rule_does_not_break_paragraph(parsed):
    rows = parsed("joined")
    assert rows[0]["text"] == ("Document: Unknown Framework\nChapter: Global Context\n"
                               "Content: First line of a paragraph that is long enough to be kept.")


def test_blank_line_ends_list(parsed):
    rows = parsed("lists")
    assert ids(rows) == ["l0", "l1"]
    assert rows[0]["metadata"]["list_items"] == ["one", "two"] and rows[0]["metadata"]["list_size"] == 2
    assert rows[0]["text"].endswith("Section: \nContent:\n- one\n* two")


def test_table_rows_and_siblings(parsed):
    rows = parsed("table")
    assert ids(rows) == ["p0", "t1_r1", "t1_r2", "p3"]
    assert rows[0]["text"] == "Document: Doc\nContext: Table 1 Things\nDescription: What it shows."
    assert rows[1]["text"] == "Document: Doc | Chapter: Part | Table: Table 1 Things | A: a1 | Requirement: r1"
    assert rows[1]["page_content"] == "Doc: Doc | Table: Table 1 Things | r1"
    first, second = rows[1]["metadata"], rows[2]["metadata"]
    assert first["sibling_ids"] == [rows[2]["id"]] and second["sibling_ids"] == [rows[1]["id"]]
    assert (first["table_row"], second["table_row"], first["table_total"]) == (1, 2, 2)
    assert first["table_id"] == "Doc::Table 1 Things"
    assert (rows[1]["next_id"], rows[2]["prev_id"]) == (rows[2]["id"], rows[1]["id"])
    assert rows[3]["metadata"]["section"] == "Table 1 Things"


def test_single_row_table(parsed):
    meta = parsed("single")[0]["metadata"]
    assert (meta["table_total"], meta["sibling_ids"]) == (0, [])


def test_empty_header(parsed):
    compat, fixed = parsed("empty_header"), parsed("empty_header", False)
    assert [r["text"].rsplit(" | ", 1)[1] for r in compat] == [": Value", ": v1", ": v2"]
    assert [r["text"].split("Table: Table 1 | ")[1] for r in fixed] == ["Name: n1 | Value: v1", "Name: n2 | Value: v2"]


def test_figure_swallows_until_heading(parsed):
    rows = parsed("figure")
    assert ids(rows) == ["fig0", "p1"]
    assert rows[0]["text"].endswith(f"Visual Element: Figure 1 Flow | Details: quoted - bullet {LONG}")
    assert rows[0]["page_content"].endswith("| " + f"quoted - bullet {LONG}"[:180])


def test_table_inside_another_word(parsed):
    assert ids(parsed("accountable")) == ["p0", "p1"]
    assert ids(parsed("accountable", False)) == ["fig0"]


def test_bold_captions_only_count_in_prose(parsed):
    rows = parsed("bold")
    assert ids(rows) == ["p0", "p1", "t1_r2", "fig3"]
    assert rows[1]["metadata"]["section"] == "Table 2: Things"
    assert rows[3]["text"].endswith("Figure 3: Pic | Details: body **Table 4: not a table**")


def test_footnotes_chain_and_cut(parsed):
    row, = parsed("notes")
    assert row["text"].endswith(f"{LONG}[^a]\n[Note a: see [^b]]\n[Note b: {'z' * 300}]")
    assert "Note" not in row["page_content"]


def test_bibliography_does_not_break_list(parsed):
    rows = parsed("bibliography")
    assert ids(rows) == ["l0"] and rows[0]["metadata"]["list_items"] == ["one", "two"]


def test_section_stays_after_new_chapter(parsed):
    a, b = parsed("stale")
    assert (a["metadata"]["chapter"], a["metadata"]["section"]) == ("Sub", "Sub")
    assert (b["metadata"]["chapter"], b["metadata"]["section"]) == ("B", "Sub")


def test_pipes_without_table_are_prose(parsed):
    rows = parsed("pipes")
    assert ids(rows) == ["p0"] and "| a | b | | c |" in rows[0]["text"]


def test_reference_ids(parsed):
    refs = parsed("refs")[0]["refs"]
    assert refs == sorted(set(refs))
    assert {"GOVERN_1.2", "MAP_3.4", "MAP_2.1", "GOVERN_1.1", "ISO/IEC_42001"} <= set(refs)


def test_fourth_level_is_text(parsed):
    assert ids(parsed("deep")) == ["p0"]


def test_repeated_column_keeps_last_cell(parsed):
    assert parsed("keys")[0]["text"].endswith("Table 1 | k: 2 | z: 3")


def test_rule_before_header_leaves_no_columns(parsed):
    assert parsed("separator_first") == []


def test_tables_do_not_share_siblings(parsed):
    rows = parsed("two_tables")
    assert ids(rows) == ["t1_r0", "t1_r1", "t2_r2", "t2_r3"]
    assert rows[0]["metadata"]["sibling_ids"] == [rows[1]["id"]]
    assert rows[2]["metadata"]["sibling_ids"] == [rows[3]["id"]]
    assert rows[1]["next_id"] is None and rows[2]["prev_id"] is None


def test_ids_unique_and_histogram(spark):
    docs = spark.createDataFrame(list(enumerate(CASES.values(), 1)), "file_id long, value string")
    chunks = parse_chunks(docs)
    assert chunks.select("id").distinct().count() == chunks.count() == child_store(chunks).count()
    hist = {r["content_type"]: r for r in content_type_histogram(chunks).collect()}
    assert sum(r["n"] for r in hist.values()) == chunks.count() and hist["figure"]["n"] == 2


def test_exported_parents_read_back(spark, tmp_path):
    from folioquery.sources.stores import read_parents, write_jsonl
    docs = spark.createDataFrame([(1, CASES["two_tables"]), (2, CASES["single"])], "file_id long, value string")
    store = parent_store(parse_chunks(docs))
    write_jsonl(store, str(tmp_path / "parents"))
    back = read_parents(spark, str(tmp_path / "parents"))
    assert sorted(map(str, store.select("id", "text", "refs", "metadata").collect())) == sorted(
        map(str, back.select("id", "text", "refs", "metadata").collect()))


def test_parse_has_one_shuffle_of_lines(spark):
    docs = spark.createDataFrame([(1, LONG)], "file_id long, value string").repartition(4)
    plan = parse_chunks(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


# --- files of any length ------------------------------------------------------

CHAINED = ("# Doc\n" + LONG + "[^a] and [^z]\n\n" + LONG + " without a mark\n\n" + LONG + "[^c]\n[^c]: third, see [^a] and [^d]\n"
           "[^a]: first, see [^b]\n[^b]: second, see [^c]\n[^d]: " + "q" * 297 + "[^e]\n[^e]: last\n[^a]: again, see [^b]\n[^e]: at last")


def rows_of(chunks):
    return sorted(map(str, chunks.collect()))


@pytest.mark.parametrize("stripe, compat", [(1, True), (3, False), (7, True)])
def test_stripes_give_the_same_chunks(spark, stripe, compat):
    """Every fixture on its own, and all of them as one long file."""
    from folioquery.operators.parse import document_lines, parse_lines
    texts = [*CASES.values(), CHAINED, "\n".join(CASES.values()), "\n\n".join([*CASES.values(), CHAINED] * 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "file_id long, value string")
    numbered = document_lines(docs)
    want = rows_of(parse_lines(numbered, ParseOptions(compat)))
    assert rows_of(parse_lines(numbered, ParseOptions(compat, stripe))) == want and len(want) > 60
    sparse = numbered.withColumn("line_no", F.col("line_no") * 10 + 5)  # numbers need not be dense
    assert rows_of(parse_lines(sparse, ParseOptions(compat, 40))) == want


def test_notes_name_later_notes_only(spark):
    docs = spark.createDataFrame([(1, CHAINED)], "file_id long, value string")
    for options in (ParseOptions(), ParseOptions(stripe=2)):
        texts = [r.text for r in parse_chunks(docs, options).orderBy("n").collect()]
        assert [t.count("[Note") for t in texts] == [2, 0, 5]


def test_one_long_file_is_read_by_many_tasks(spark, tmp_path):
    from folioquery.operators.parse import parse_lines
    from folioquery.sources.markdown import read_markdown, read_markdown_lines
    body = "\n".join(f"## Part {i}\n{LONG} {i}\n\n- item {i}\n## Table {i} T\n| A | B |\n|---|---|\n| a{i} | b |\n| c | d |" for i in range(3000))
    (tmp_path / "long file.md").write_text("# Title\n" + body)
    (tmp_path / "merged.md").write_text("# No\n" + LONG)
    (tmp_path / "a.MD").write_text("# Short\n" + LONG)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        numbered = read_markdown_lines(spark, str(tmp_path))
        parts = numbered.where("file_name = 'long file.md'").select(F.expr("line_no div 40000")).distinct().count()
        got = rows_of(parse_lines(numbered, ParseOptions(stripe=20_000)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert parts > 5 and got == rows_of(parse_chunks(read_markdown(spark, str(tmp_path))))
