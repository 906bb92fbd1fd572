"""Files that came as one text each, cut into runs of lines in one pass.

The same rules as ``parse.classified_lines`` and ``parse.chunk_lines``, which serve
lines of files of any length: here the state is a few variables of a loop, so nothing is sorted,
buffered or grouped by line. What a chunk's texts are made of comes out, a row each.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from folioquery.functions import fixed_values as fv

ROWS, CHARS = 10_000, 1 << 23   # of a batch that is handed on

_SPACE = "[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_TABLE_TITLE = re.compile(f"[Tt][Aa][Bb][Ll][Ee]{_SPACE}")
_BOLD_TABLE = re.compile(rf"\*\*{_SPACE}*[Tt][Aa][Bb][Ll][Ee]{_SPACE}")
_BOLD_FIGURE = re.compile(rf"\*\*{_SPACE}*[Ff][Ii\u0130\u0131][Gg][Uu][Rr][Ee]{_SPACE}")
_BIBLIOGRAPHY = re.compile(rf"-{_SPACE}+\[\d+\]{_SPACE}+[A-Z]")
_NOTE_TEXT = re.compile(rf"{_SPACE}*([^\n\r\x85\u2028\u2029]+)")
_WORD = {"Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Mn", "Me", "Mc", "Nd", "Pc"}

COLUMNS = ("n long, kind string, s string, cells array<string>, header array<string>, body array<string>, joined string, doc_title string, "
           "chapter string, section string, table_no long, first_n long, rows long, own_notes array<struct<key:string,text:string>>")
_NOTES = pa.list_(pa.struct([("key", pa.string()), ("text", pa.string())]))
_TYPES = [pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.string())] * 3, *[pa.string()] * 4, *[pa.int64()] * 3, _NOTES]


def _is_word(char: str) -> bool:
    if char.isascii():
        return char.isalnum() or char == "_"
    return unicodedata.category(char) in _WORD or char in "\u200c\u200d" or "\u24b6" <= char <= "\u24e9"


def _names_table(low: str) -> bool:
    """The word "table" or "tables" is in it."""
    at = low.find("table")
    while at >= 0:
        ends = [at + 5, at + 6] if low[at + 5:at + 6] == "s" else [at + 5]
        if (at == 0 or not _is_word(low[at - 1])) and any(e == len(low) or not _is_word(low[e]) for e in ends):
            return True
        at = low.find("table", at + 1)
    return False


def note_of(line: str) -> tuple[str, str] | None:
    """Key and text of a note's line."""
    if not line.startswith("[^"):
        return None
    end = line.find("]", 2)
    key = line[2:end]
    if end < 3 or line[end + 1:end + 2] != ":" or not all(map(_is_word, key)):
        return None
    text = _NOTE_TEXT.match(line, end + 2)
    return (key, text.group(1)) if text else None


def _merged(texts: list[str]) -> Iterator[tuple[int, str]]:
    """Stripped lines with their numbers; files that share an id are read line by line."""
    split = [t.replace("\r\n", "\n").replace("\r", "\n").split("\n") for t in texts]
    if len(split) == 1:
        return enumerate(map(str.strip, split[0]))
    return ((no, x[no].strip()) for no in range(max(map(len, split))) for x in split if no < len(x))


def runs(texts: list[str], compat: bool) -> list[list]:
    """[kind, first line, parts, s, cells, header, title, chapter, section, table number] of each run, in order."""
    out: dict = {}
    blanks, after_pipe, mode, title, chapter = 0, False, "prose", fv.DEFAULT_TITLE, fv.DEFAULT_CHAPTER
    head_block, caption_before, figure_before, table_before = True, False, False, False
    section, table_no, last_kind, last_blanks, kind_before = "", 0, None, 0, None
    named_in, header, number = -1, None, 0
    for no, s in _merged(texts):
        if s == "":
            blanks += 1
            continue
        if s == "---" or s.startswith("!["):
            continue
        first = s[0]
        c, is_pipe, level, opens, named, caption = s, first == "|", 0, None, None, None
        if first == "#":
            level = 1 if s.startswith("# ") else 2 if s.startswith("## ") else 3 if s.startswith("### ") else 0
            if level:
                named = s.replace("#" * level, "").strip()
                opens = "prose"
                if level == 2 and _TABLE_TITLE.match(named):
                    opens = "pending"
                elif level == 3:
                    low = named.lower()
                    if "table" in low if compat else _names_table(low):
                        opens = "pending"
                    elif "figure" in low or "diagram" in low:
                        opens = "figure"
                mode = opens
                if level == 1:
                    title = named
                elif opens == "prose":
                    chapter = named
                if not (level == 3 or opens == "pending"):
                    named = None
        elif first == ">":
            c = s.lstrip("> ").strip()
        if not level and c.startswith("**"):
            caption = "table" if _BOLD_TABLE.match(c) else "figure" if _BOLD_FIGURE.match(c) else None
        new_block = level > 0 or (not is_pipe and after_pipe)
        after_pipe = is_pipe
        if new_block:
            head_block = level > 0
        counts = caption is not None and (not head_block or mode == "prose") and (new_block or not caption_before)
        if new_block or caption is not None:
            caption_before = caption is not None
        is_figure, is_table = counts and caption == "figure", counts and caption == "table"
        was_figure = level == 0 and (mode == "figure" or figure_before)
        armed = (head_block and mode == "pending") or (table_before and not new_block)
        if level or is_figure:
            figure_before = is_figure
        if new_block or is_table:
            table_before = is_table
        starts_table = is_table and not was_figure
        if level or starts_table or (is_figure and not was_figure):
            kind = "mark"
            if not level:
                named = c.strip("*").strip()
        elif was_figure:
            kind = "figure"
        elif armed:
            kind = "row" if is_pipe else "desc"
        elif c.startswith("-") and _BIBLIOGRAPHY.match(c):
            kind_before = "skip"
            continue
        elif note_of(c):
            kind = "note"
        else:
            kind = "list" if c.startswith(("- ", "* ")) else "prose"
        if named is not None:
            section = named
        if opens == "pending" or starts_table:
            table_no += 1
        if kind == "note":
            kind_before = kind
            found = out.get(-no - 1)
            if found is None:
                out[-no - 1] = [kind, no, [(no, c)], None, None, None, title, chapter, section, table_no]
            else:
                found[2].append((no, c))
            continue
        if kind in ("desc", "row") or last_kind != kind or (kind in ("list", "prose") and last_blanks != blanks):
            number += 1
        last_kind, last_blanks = kind, blanks
        cells = None
        if kind == "row":
            first_row, rule = kind_before != "row", "---" in s
            cells = [x.strip() for x in s.split("|")[1:-1]]
            if compat:
                is_header = first_row and not rule
            else:
                is_named = not rule and any(cells)
                is_header = is_named and named_in != table_no
                if is_named:
                    named_in = table_no
            if is_header:
                header = cells
            elif first_row:
                header = []
            if rule or is_header or len(cells) != len(header) or not (compat or header):
                kind_before = kind
                continue
        kind_before = kind
        if kind == "mark":
            continue
        found = out.get(number)
        if found is None:
            out[number] = [kind, no, [(no, c)], s, cells, header if cells is not None else None, title, chapter, section, table_no]
        else:
            found[2].append((no, c))
    return list(out.values())


def chunk_parts(texts: list[str], compat: bool) -> list[tuple]:
    """Rows of COLUMNS for the files of one id."""
    kept, notes, tables, n = [], [], {}, 0
    for kind, at, parts, s, cells, header, *places in runs(texts, compat):
        body = [c for _, c in (sorted(parts, key=lambda p: (p[0], p[1].encode("utf-8", "surrogatepass"))) if len(texts) > 1 else parts)]
        joined = " ".join(body)
        if kind == "note":
            key, text = note_of(joined)
            notes.append((at, key, text))
            continue
        if kind == "prose" and len(joined) < fv.MIN_PROSE_CHARS:
            continue
        if kind == "row":
            tables.setdefault(places[3], [n, 0])[1] += 1
            kept.append([n, kind, s, cells, header, None, None, *places])
        else:
            kept.append([n, kind, None, None, None, body if kind == "list" else None, joined, *places])
        n += 1
    last = {}
    for _, key, text in sorted(notes):
        last[key] = text
    own = [{"key": key, "text": text} for key, text in last.items()] or None
    out = []
    for row in kept:
        first_n, rows = tables[row[10]] if row[1] == "row" else (None, None)
        marked = own and any("[^" in x for x in (row[6] or "", *row[7:10], *(row[3] or ()), *(row[4] or ())))
        out.append((*row, first_n, rows, own if marked else None))
    return out


def file_chunks(docs: DataFrame, compat: bool) -> DataFrame:
    """(file_id, value) to (file_id, COLUMNS): a row per chunk. Files of one id meet in one task, as they are dealt already if they are."""
    kind = docs.schema["file_id"].dataType
    arrow = to_arrow_type(kind)
    schema = pa.schema([("file_id", arrow), *zip((c.strip().split(" ")[0] for c in re.split(r",\s+", COLUMNS)), _TYPES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, chars = [], [], 0
        current, texts = None, []

        def handed() -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[]] * len(_TYPES)
            return pa.RecordBatch.from_arrays([pa.array(ids, arrow), *[pa.array(c, t) for c, t in zip(columns, _TYPES)]], schema=schema)

        def files():
            nonlocal current, texts
            for batch in batches:
                for file_id, value in zip(batch.column("file_id").to_pylist(), batch.column("value").to_pylist()):
                    if texts and file_id != current:
                        yield current, texts
                        texts = []
                    current = file_id
                    if value is not None:
                        texts.append(value)
            if texts:
                yield current, texts

        for file_id, of_file in files():
            found = chunk_parts(of_file, compat)
            ids += [file_id] * len(found)
            rows += found
            chars += sum(map(len, of_file))
            if len(rows) >= ROWS or chars >= CHARS:
                yield handed()
                ids, rows, chars = [], [], 0
        if rows:
            yield handed()

    together = docs.select("file_id", "value", F.row_number().over(Window.partitionBy("file_id").orderBy("value")).alias("_no"))
    fields = StructType([StructField("file_id", kind), *StructType.fromDDL(COLUMNS).fields])
    return together.mapInArrow(run, fields)
