"""Structured markdown to linked parent and child chunks.

One row per line, then running columns over ``(file_id, line_no)`` (see ``scan``). All
share one exchange and one sort; only the final grouping of lines
into chunks follows, on the same partitioning, so a corpus is parsed with a
single shuffle of its lines. With ``stripe`` set, stretches of lines are parsed in
tasks of their own and the state at their borders is composed, so a single
file may be of any length. Files that came as one text each are cut by ``files``, by the same rules.

How a line's mode (prose, pending table, table, figure) is found without a
state machine: headings cut a file into sections, and within a section a
block begins at the heading or at the first non-pipe line after a run of pipe
lines. Every block but the heading's own starts as prose, so its first bold
``Table``/``Figure`` caption is the one that counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from folioquery.functions import fixed_values as fv
from folioquery.functions.refs import reference_ids
from folioquery.functions.text import lines, lstrip, strip
from folioquery.operators.files import file_chunks
from folioquery.operators.scan import Count, Last, running
from folioquery.session import materialize


@dataclass(frozen=True)
class ParseOptions:
    """``compat`` keeps two known quirks of existing stores.

    They are: a third-level heading counts as a table when "table" occurs
    anywhere in it (as in "accountable"), and an all-empty header row names
    the columns. Without ``compat`` only the word "table" counts, and the
    first row with any text is the header.

    ``stripe`` is the number of line numbers that one task scans; None leaves
    every file to one task, which suits files that came as one text each.
    """

    compat: bool = True
    stripe: int | None = None


BOLD_TABLE = r"(?iU)^\*\*\s*Table\s+"
BOLD_FIGURE = r"(?iU)^\*\*\s*Figure\s+"
NOTE_LINE = r"(?U)^\[\^(\w+)\]:\s*(.+)"
BIBLIOGRAPHY_LINE = r"(?U)^-\s+\[\d+\]\s+[A-Z]"


def _running(rows: DataFrame, columns: dict, options: ParseOptions, order: str = "line_no") -> DataFrame:
    return running(rows, columns, "file_id", order, options.stripe)


def body_line() -> Column:
    """The line without block quote marks."""
    s = F.col("s")
    return F.when(s.startswith(">"), strip(lstrip(s, "> "))).otherwise(s)


def document_lines(docs: DataFrame) -> DataFrame:
    """(file_id, value) -> (file_id, line_no, s): one stripped line per row."""
    return (
        docs.select("file_id", F.posexplode(lines(F.col("value"))).alias("line_no", "raw"))
        .select("file_id", "line_no", strip(F.col("raw")).alias("s"))
    )


def _headings(rows: DataFrame, options: ParseOptions) -> DataFrame:
    """Heading level, title, the mode each heading opens, and captions."""
    s, level, title = F.col("s"), F.col("level"), F.col("title")
    named = rows.withColumn("level", F.when(s.startswith("# "), 1).when(s.startswith("## "), 2)
                            .when(s.startswith("### "), 3).otherwise(0)) \
        .withColumn("title", F.when(level == 1, strip(F.replace(s, F.lit("#"), F.lit(""))))
                    .when(level == 2, strip(F.replace(s, F.lit("##"), F.lit(""))))
                    .when(level == 3, strip(F.replace(s, F.lit("###"), F.lit("")))))
    low = F.lower(title)
    table3 = low.contains("table") if options.compat else low.rlike(r"(?U)\btables?\b")
    opens = (
        F.when(level == 1, "prose")
        .when((level == 2) & title.rlike(r"(?iU)^Table\s+"), "pending")
        .when(level == 2, "prose")
        .when((level == 3) & table3, "pending")
        .when((level == 3) & (low.contains("figure") | low.contains("diagram")), "figure")
        .when(level == 3, "prose")
    )
    c = body_line()
    bold = c.startswith("**")
    return named.select(
        "file_id", "line_no", "s", "level", "title", opens.alias("opens"),
        (level > 0).alias("is_head"), s.startswith("|").alias("is_pipe"),
        ((s != "") & (s != "---") & ~s.startswith("![")).alias("is_content"),
        F.when((level == 0) & bold & c.rlike(BOLD_TABLE), "table")
        .when((level == 0) & bold & c.rlike(BOLD_FIGURE), "figure").alias("caption"))


def classified_lines(numbered: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """(file_id, line_no, s) -> every content line with its kind and the titles in force at it."""
    head, content = F.col("is_head"), F.col("is_content")
    names_chapter = (F.col("level") >= 2) & (F.col("opens") == "prose")
    located = _running(_headings(numbered, options), {
        "blanks": Count(F.col("s") == ""),
        "after_pipe": Last(content, F.col("is_pipe"), F.lit(False), before=True),
        "mode_at_head": Last(head, F.col("opens"), F.lit("prose")),
        "doc_title": Last(F.col("level") == 1, F.col("title"), F.lit(fv.DEFAULT_TITLE)),
        "chapter": Last(names_chapter, F.col("title"), F.lit(fv.DEFAULT_CHAPTER)),
    }, options).where(content)

    starts_block = head | (~F.col("is_pipe") & F.col("after_pipe"))
    caption = F.col("caption").isNotNull()
    blocks = _running(located.withColumn("new_block", starts_block), {
        # The heading's own block starts in the heading's mode, others as prose.
        "head_block": Last(F.col("new_block"), head, F.lit(True)),
        "caption_before": Last(F.col("new_block") | caption, caption, F.lit(False), before=True),
    }, options)
    free = ~F.col("head_block") | (F.col("mode_at_head") == "prose")
    first = caption & free & (F.col("new_block") | ~F.col("caption_before"))
    captioned = blocks.withColumn("first_caption", F.when(first, F.col("caption")))
    is_figure, is_table = (F.coalesce(F.col("first_caption") == x, F.lit(False)) for x in ("figure", "table"))
    events = _running(captioned, {
        "figure_before": Last(head | is_figure, is_figure, F.lit(False), before=True),
        "table_before": Last(F.col("new_block") | is_table, is_table, F.lit(False), before=True),
    }, options)
    was_figure = ~head & ((F.col("mode_at_head") == "figure") | F.col("figure_before"))
    starts_figure, starts_table = is_figure & ~was_figure, is_table & ~was_figure
    armed = (F.col("head_block") & (F.col("mode_at_head") == "pending")) \
        | (F.col("table_before") & ~F.col("new_block"))
    c = body_line()
    kind = (
        F.when(head | starts_figure | starts_table, "mark")
        .when(was_figure, "figure")
        .when(armed & F.col("is_pipe"), "row")
        .when(armed, "desc")
        .when(c.startswith("-") & c.rlike(BIBLIOGRAPHY_LINE), "skip")
        .when(c.startswith("[^") & c.rlike(NOTE_LINE), "note")
        .when(c.startswith("- ") | c.startswith("* "), "list")
        .otherwise("prose")
    )
    names_section = head & ((F.col("level") == 3) | ((F.col("level") == 2) & (F.col("opens") == "pending")))
    named = F.when(names_section, F.col("title")) \
        .when(starts_figure | starts_table, strip(strip(c, "*")))
    return events.select(
        "file_id", "line_no", "s", "blanks", "doc_title", "chapter", kind.alias("kind"), named.alias("named"),
        ((head & (F.col("opens") == "pending")) | starts_table).alias("opens_table"))


def chunk_lines(classified: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """Attach a run number to each line; lines of one run form one chunk."""
    kind = F.col("kind")
    # Notes and bibliography lines never interrupt a list or a paragraph.
    body = ~kind.isin("note", "skip")
    titled = _running(classified, {
        "section": Last(F.col("named").isNotNull(), F.col("named"), F.lit("")),
        "table_no": Count(F.col("opens_table")),
        "body_before": Last(body, F.struct("kind", "blanks"), before=True),
        "kind_before": Last(F.lit(True), kind, before=True),
    }, options).where(kind != "skip")
    last = F.col("body_before")
    starts = body & (
        kind.isin("desc", "row") | last.isNull() | (last["kind"] != kind)
        | (kind.isin("list", "prose") & (last["blanks"] != F.col("blanks"))))
    is_row = kind == "row"
    first_row = is_row & F.coalesce(F.col("kind_before") != "row", F.lit(True))
    rule = F.col("s").contains("---")
    rows = titled.select(
        "file_id", "line_no", "s", "kind", "doc_title", "chapter", "section", "table_no",
        starts.alias("starts"), first_row.alias("first_row"), rule.alias("rule"),
        F.when(is_row, pipe_cells(F.col("s"))).alias("cells"))
    if options.compat:
        is_header = F.col("first_row") & ~F.col("rule")
    else:
        named_row = is_row & ~F.col("rule") & F.exists("cells", lambda x: x != "")
        rows = _running(rows.withColumn("named_row", named_row),
                        {"named_in": Last(F.col("named_row"), F.col("table_no"), F.lit(-1), before=True)}, options)
        is_header = F.col("named_row") & (F.col("named_in") != F.col("table_no"))
    none = F.array().cast("array<string>")
    carried = F.when(F.col("is_header"), F.col("cells")).when(F.col("first_row"), none)
    # A note inside a paragraph has its own run; the paragraph's number is
    # counted over body lines only, so it is the same on both sides of it.
    numbered = _running(rows.withColumn("is_header", is_header), {
        "header": Last(carried.isNotNull(), carried),
        "number": Count(F.col("starts")),
    }, options)
    keep_row = ~F.col("rule") & ~F.col("is_header") & (F.size("cells") == F.size("header"))
    if not options.compat:
        keep_row = keep_row & (F.size("header") > 0)
    return numbered.where((kind != "mark") & (~is_row | keep_row)).select(
        "file_id", F.when(kind == "note", -F.col("line_no") - 1).otherwise(F.col("number")).alias("run"),
        "kind", "line_no", "s", body_line().alias("c"), "cells", F.when(is_row, F.col("header")).alias("header"),
        "doc_title", "chapter", "section", "table_no")


def _row_value(name: str) -> Column:
    """The last cell under ``name``, NULL when there is no such column."""
    at = F.array_position(F.reverse("header"), F.lit(name)).cast("int")
    return F.get(F.reverse("cells"), at - 1)


def _row_pairs() -> Column:
    """``name: cell`` per distinct column, last cell wins, first position kept."""
    def pair(name: Column, cell: Column) -> Column:
        return F.concat(name, F.lit(": "), cell)

    def last(name: Column) -> Column:
        return F.get(F.reverse("cells"), F.array_position(F.reverse("header"), name).cast("int") - 1)

    names = F.array_distinct("header")
    repeated = F.transform(names, lambda name: pair(name, last(name)))
    return F.array_join(F.when(F.size(names) == F.size("header"), F.zip_with("header", "cells", pair)).otherwise(repeated), " | ")


def _notes_appended(text: Column, notes: Column) -> Column:
    """Append each footnote whose mark occurs, also in notes appended before it."""
    return F.aggregate(
        notes, text,
        lambda acc, n: F.when(
            F.contains(acc, F.concat(F.lit("[^"), n["key"], F.lit("]"))),
            F.concat(acc, F.lit("\n[Note "), n["key"], F.lit(": "),
                     F.substring(n["text"], 1, fv.NOTE_CHARS), F.lit("]")),
        ).otherwise(acc),
    )


def parse_chunks(docs: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """(file_id, value) -> one row per chunk with parent text, child text, metadata."""
    if options.stripe is not None:
        return parse_lines(document_lines(docs), options)
    return file_chunks(docs, options.compat).select(*_chunk_columns())


def parse_lines(numbered: DataFrame, options: ParseOptions = ParseOptions()) -> DataFrame:
    """(file_id, line_no, s) -> chunks. Line numbers ascend; they need not be dense."""
    runs = (
        chunk_lines(classified_lines(numbered, options), options)
        .groupBy("file_id", "run", "kind")
        .agg(
            F.min("line_no").alias("first_line"),
            F.sort_array(F.collect_list(F.struct("line_no", "c"))).alias("body"),
            *[F.first(x).alias(x) for x in
              ("s", "cells", "header", "doc_title", "chapter", "section", "table_no")],
        )
        .withColumn("body", F.transform("body", lambda b: b["c"]))
        .withColumn("joined", F.array_join("body", " "))
        .where((F.col("kind") != "prose") | (F.length("joined") >= fv.MIN_PROSE_CHARS))
    )
    is_note, is_row = F.col("kind") == "note", F.col("kind") == "row"
    counted = _running(runs, {"n": Count(~is_note)}, options, "first_line").withColumn("n", F.col("n") - 1)
    if options.stripe is not None:
        return _long_chunks(materialize(counted, "chunk-runs"))
    whole = Window.partitionBy("file_id")
    note = F.struct(F.col("first_line").alias("at"), *_note_columns())
    numbered_runs = counted.withColumn("notes", F.sort_array(F.collect_list(F.when(is_note, note)).over(whole))).where(~is_note)
    table_rows = Window.partitionBy("file_id", F.when(is_row, F.col("table_no")))
    placed = numbered_runs.withColumns({"first_n": F.min("n").over(table_rows), "rows": F.count("*").over(table_rows)})
    keys = F.array_distinct(F.transform("notes", lambda x: x["key"]))
    last_note = lambda k: F.element_at(F.filter("notes", lambda x: x["key"] == k), -1)["text"]
    ordered = F.transform(keys, lambda k: F.struct(k.alias("key"), last_note(k).alias("text")))
    marked = F.contains(_chunk_text(), F.lit("[^")) & (F.size("notes") > 0)
    return placed.select("*", F.when(marked, ordered).alias("own_notes")).select(*_chunk_columns())


def _note_columns() -> list[Column]:
    return [F.regexp_extract(F.col("joined"), NOTE_LINE, g).alias(name) for g, name in ((1, "key"), (2, "text"))]


def _long_chunks(counted: DataFrame) -> DataFrame:
    """Chunks of files of any length: tables and notes are met by joins, no file is gathered."""
    is_note, is_row = F.col("kind") == "note", F.col("kind") == "row"
    chunks = counted.where(~is_note)
    tables = chunks.where(is_row).groupBy("file_id", "table_no").agg(F.min("n").alias("first_n"), F.count("*").alias("rows"))
    placed = chunks.where(is_row).join(tables, ["file_id", "table_no"]).unionByName(
        chunks.where(~is_row).withColumns({"first_n": F.lit(None).cast("long"), "rows": F.lit(None).cast("long")}))
    notes = materialize(counted.where(is_note).select("file_id", "first_line", *_note_columns()).groupBy("file_id", "key")
                        .agg(F.min("first_line").alias("at"), F.max_by("text", "first_line").alias("text")), "notes")
    asking = placed.select("file_id", "n", F.explode(_marks(_chunk_text())).alias("key"))
    found = asking.join(notes, ["file_id", "key"]).select("file_id", "n", "key", "at", "text")
    # A note that was appended may name a later one; most name none, and the rounds end.
    shown = F.concat(F.substring("text", 1, fv.NOTE_CHARS), F.lit("]"))  # as it is appended: a cut mark may be closed
    linking = notes.select("file_id", "at", F.explode(_marks(shown)).alias("key"))
    links = materialize(linking.join(notes.select("file_id", "key", "text", F.col("at").alias("to")), ["file_id", "key"]).where("to > at"), "note-links")
    if not links.isEmpty():
        found = materialize(found, "asked-notes")
        fresh = found
        while not fresh.isEmpty():
            named = fresh.select("file_id", "n", "at").join(links, ["file_id", "at"]).select(
                "file_id", "n", "key", F.col("to").alias("at"), "text").distinct()
            fresh = materialize(named.join(found.select("file_id", "n", "key"), ["file_id", "n", "key"], "left_anti"), "more-notes")
            found = materialize(found.unionByName(fresh), "asked-notes")
    lists = found.groupBy("file_id", "n").agg(F.transform(
        F.sort_array(F.collect_set(F.struct("at", "key", "text"))), lambda x: F.struct(x["key"].alias("key"), x["text"].alias("text"))).alias("own_notes"))
    return placed.join(lists, ["file_id", "n"], "left").select(*_chunk_columns())


def _marks(text: Column) -> Column:
    """Keys of the footnote marks in a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\[\^(\w+)\]"), 1))


def _chunk_text() -> Column:
    """The parent text of a chunk, without notes."""
    kind, joined = F.col("kind"), F.col("joined")
    title, chapter, section = F.col("doc_title"), F.col("chapter"), F.col("section")
    row_text = F.concat(F.lit("Document: "), title, F.lit(" | Chapter: "), chapter,
                        F.lit(" | Table: "), section, F.lit(" | "), _row_pairs())
    figure_text = F.concat(F.lit("Document: "), title, F.lit(" | Chapter: "), chapter,
                           F.lit(" | Visual Element: "), section, F.lit(" | Details: "), joined)
    return (F.when(kind == "list", _list_text()).when(kind == "row", row_text).when(kind == "figure", figure_text)
            .when(kind == "desc", _desc_text()).otherwise(_prose_text()))


def _list_text() -> Column:
    return F.concat(F.lit("Document: "), F.col("doc_title"), F.lit("\nChapter: "), F.col("chapter"),
                    F.lit("\nSection: "), F.col("section"), F.lit("\nContent:\n"), F.array_join("body", "\n"))


def _prose_text() -> Column:
    return F.concat(F.lit("Document: "), F.col("doc_title"), F.lit("\nChapter: "), F.col("chapter"),
                    F.lit("\nContent: "), F.col("joined"))


def _desc_text() -> Column:
    return F.concat(F.lit("Document: "), F.col("doc_title"), F.lit("\nContext: "), F.col("section"),
                    F.lit("\nDescription: "), F.col("joined"))


def _chunk_columns() -> list[Column]:
    kind, n, joined = F.col("kind"), F.col("n"), F.col("joined")
    fid = F.concat(F.lit("f"), F.col("file_id").cast("string"))
    row_id = lambda i: F.concat(fid, F.lit("_t"), F.col("table_no").cast("string"), F.lit("_r"), i.cast("string"))
    cid = (
        F.when(kind == "list", F.concat(fid, F.lit("_l"), n.cast("string")))
        .when(kind == "row", row_id(n))
        .when(kind == "figure", F.concat(fid, F.lit("_fig"), n.cast("string")))
        .otherwise(F.concat(fid, F.lit("_p"), n.cast("string")))
    )
    title, chapter, section = F.col("doc_title"), F.col("chapter"), F.col("section")
    items = F.transform("body", lambda b: strip(lstrip(b, "-* ")))
    text = _chunk_text()
    primary = F.coalesce(*[_row_value(c) for c in fv.PRIMARY_COLUMNS],
                         F.substring("s", 1, fv.RAW_ROW_CHARS))
    child = (
        F.when(kind == "list", _list_text())
        .when(kind == "row", F.concat(F.lit("Doc: "), title, F.lit(" | Table: "), section,
                                      F.lit(" | "), primary))
        .when(kind == "figure", F.concat(F.lit("Doc: "), title, F.lit(" | Visual: "), section,
                                         F.lit(" | "), F.substring(joined, 1, fv.FIGURE_CHARS)))
        .when(kind == "desc", _desc_text()).otherwise(_prose_text())
    )
    own_refs = reference_ids(F.when(kind == "list", F.array_join(items, " "))
                             .when(kind == "row", F.col("s")).otherwise(joined))
    refs = F.when((kind == "figure") & (F.size(own_refs) == 0), reference_ids(section)).otherwise(own_refs)
    total = F.col("rows")
    is_row, is_list = kind == "row", kind == "list"
    grouped = is_row & (total >= 2)
    metadata = F.struct(
        title.alias("source"), chapter.alias("chapter"), section.alias("section"),
        F.when(is_row, "table").when(kind == "desc", "prose").otherwise(kind).alias("content_type"),
        F.when(is_list, F.size("body")).alias("list_size"),
        F.when(is_list, items).alias("list_items"),
        F.when(is_row, F.concat(title, F.lit("::"), section)).alias("table_id"),
        F.when(is_row, section).alias("table_title"),
        F.when(is_row, n - F.col("first_n") + 1).cast("int").alias("table_row"),
        F.when(grouped, total).when(is_row, 0).cast("int").alias("table_total"),
    )
    # Rows of a table carry consecutive numbers, so neighbours need no lookup.
    prev_id = F.when(is_row & (n > F.col("first_n")), row_id(n - 1))
    next_id = F.when(is_row & (n < F.col("first_n") + total - 1), row_id(n + 1))
    return [
        cid.alias("id"), "file_id", n.cast("long").alias("n"),
        F.when(F.col("own_notes").isNotNull(), _notes_appended(text, F.col("own_notes"))).otherwise(text).alias("text"),
        child.alias("page_content"), refs.alias("refs"), metadata.alias("metadata"),
        prev_id.alias("prev_id"), next_id.alias("next_id"),
    ]


def with_siblings(chunks: DataFrame) -> DataFrame:
    """Add metadata.sibling_ids: the ids of a table's other rows, in order.

    Rows of a table are numbered without gaps, so the list follows from a
    row's own number, place and table size. It grows with the square of the
    table, which is why only exported stores carry it.
    """
    m, n = F.col("metadata"), F.col("n")
    prefix = F.regexp_replace("id", "[0-9]+$", "")
    first = n - m["table_row"] + 1
    others = F.filter(F.sequence(first, first + m["table_total"] - 1), lambda i: i != n)
    none = F.array().cast("array<string>")
    ids = F.when(m["table_total"] >= 2, F.transform(others, lambda i: F.concat(prefix, i.cast("string")))) \
        .when(m["table_total"] == 0, none)
    return chunks.withColumn("metadata", m.withField("sibling_ids", ids))


def parent_store(chunks: DataFrame) -> DataFrame:
    return with_siblings(chunks).select("id", "text", "refs", "metadata")


def child_store(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "id", "page_content",
        F.struct(F.col("id").alias("parent_link"), F.col("metadata.source").alias("source"),
                 F.col("metadata.content_type").alias("content_type")).alias("metadata"),
    )


def content_type_histogram(chunks: DataFrame, column: str = "metadata.content_type") -> DataFrame:
    """Counts and whole-number percent per content type."""
    counts = chunks.groupBy(F.col(column).alias("content_type")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", F.floor(F.lit(100) * F.col("n") / total)) \
                 .select("content_type", "n", "pct")


def line_chunks(docs: DataFrame, min_chars: int = fv.MIN_PROSE_CHARS) -> DataFrame:
    """Every long enough line as its own prose chunk: (file_id, n, line_no, text).

    For corpora whose paragraphs are lines. Numbered within the row, no shuffle.
    """
    numbered = F.transform(lines(F.col("value")), lambda s, i: F.struct(i.alias("line_no"), strip(s).alias("text")))
    kept = F.filter(numbered, lambda x: F.length(x["text"]) >= min_chars)
    return docs.select("file_id", F.posexplode(kept).alias("n", "c")).select("file_id", "n", "c.line_no", "c.text")


def pipe_cells(line: Column) -> Column:
    """Cells of a pipe line: what lies between its first and last pipe, trimmed."""
    pieces = F.split(line, r"\|", -1)
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0))), lambda x: strip(x))
