"""Header-aware splitting into bounded, overlapping pieces."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from folioquery.functions.text import lines, strip

LengthsOf = Callable[[list[str]], list[int]]

HEADERS_FIRST = ("\n# ", "\n## ", "\n\n", "\n|", "\n", " ", "")
PARAGRAPHS_FIRST = ("\n\n", "\n# ", "\n## ", "\n|", "\n", " ", "")


def header_sections(docs: DataFrame) -> DataFrame:
    """(file_id, value) -> one row per stretch under the same headings.

    (file_id, section_no, section, sub_section, sub_sub_section, text); heading
    lines stay in the text. Lines of a block are joined by a newline, blocks
    by two spaces and a newline.
    """
    order = Window.partitionBy("file_id").orderBy("line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = docs.select("file_id", F.posexplode(lines(F.col("value"))).alias("line_no", "raw")) \
               .select("file_id", "line_no", strip(F.col("raw")).alias("s"))
    s = F.col("s")
    level = F.when(s.startswith("# "), 1).when(s.startswith("## "), 2).when(s.startswith("### "), 3)
    # A heading ends deeper ones: it carries its level, deeper names become NULL.
    name = strip(F.regexp_replace(s, "^#+ ", ""))
    marked = rows.withColumn("level", level)

    def under(depth: int) -> Column:
        at = F.when(F.col("level") <= depth, F.struct(F.col("level"), name.alias("name")))
        last = F.last(at, ignorenulls=True).over(so_far)
        return F.when(last["level"] == depth, last["name"])

    named = (
        marked.withColumn("section", under(1)).withColumn("sub_section", under(2))
        .withColumn("sub_sub_section", under(3))
        .withColumn("section_no", F.count_if(F.col("level").isNotNull()).over(so_far))
        .withColumn("block", F.count_if((s == "") | F.col("level").isNotNull()).over(so_far))
        .where(s != "")
    )
    blocks = named.groupBy("file_id", "section_no", "section", "sub_section", "sub_sub_section", "block").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "s"))), lambda x: x["s"]), "\n")
        .alias("text"))
    return blocks.groupBy("file_id", "section_no", "section", "sub_section", "sub_sub_section").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]),
                     "  \n").alias("text"))


def _cut(text: str, sep: str) -> list[str]:
    """Pieces of text; each piece after the first starts with the separator."""
    if not sep:
        return list(text)
    head, *rest = text.split(sep)
    return [p for p in [head, *(sep + r for r in rest)] if p]


def _pack(pieces: list[str], lengths: list[int], size: int, overlap: int) -> list[str]:
    """Join neighbouring pieces up to ``size``; a new chunk repeats a tail of at most ``overlap``.

    Lengths are summed once; where a chunk ends, and where the next one starts, is found
    by binary search in the sums.
    """
    upto = list(accumulate(lengths, initial=0))
    out, start = [], 0
    while start < len(pieces):
        end = max(start + 1, bisect_right(upto, upto[start] + size) - 1)
        out.append("".join(pieces[start:end]).strip())
        if end == len(pieces):
            break
        room = min(overlap, size - lengths[end])
        start = min(end, bisect_left(upto, upto[end] - room))
    return [c for c in out if c]


def characters(texts: list[str]) -> list[int]:
    return [len(t) for t in texts]


def recursive_split(text: str, size: int, overlap: int, separators: Sequence[str], lengths_of: LengthsOf = characters) -> list[str]:
    """Cut at the first separator that occurs, recursing into pieces still too long."""
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    pieces = _cut(text, separators[at])
    lengths, rest = lengths_of(pieces), separators[at + 1:]
    out, first = [], 0
    for i, length in enumerate([*lengths, size]):
        if length < size:
            continue
        out += _pack(pieces[first:i], lengths[first:i], size, overlap)
        first = i + 1
        if i < len(pieces):
            out += recursive_split(pieces[i], size, overlap, rest, lengths_of) if rest else [pieces[i]]
    return out


def token_lengths(open_tokenizer: Callable[[], object]) -> Callable[[], LengthsOf]:
    """Lengths in subword tokens; the tokenizer (``encode_batch``) is opened once per task."""
    def opened() -> LengthsOf:
        tokenizer = open_tokenizer()
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    return opened


def split_sections(sections: DataFrame, size: int = 1000, overlap: int = 100,
                   separators: Sequence[str] = PARAGRAPHS_FIRST, open_lengths: Callable[[], LengthsOf] = lambda: characters) -> DataFrame:
    """Add bounded pieces: (..., piece_no, piece, content_type).

    ``open_lengths`` is called once per task and gives the measure of ``size`` and ``overlap``:
    characters, or tokens (see ``token_lengths``).
    """
    seps = tuple(separators)

    @F.pandas_udf("array<string>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths_of = open_lengths()
        for texts in batches:
            yield texts.map(lambda t: recursive_split(t, size, overlap, seps, lengths_of) if t else [])

    kind = F.when(F.contains("piece", F.lit("|")), "table").otherwise("prose")
    return sections.select(*[c for c in sections.columns if c != "text"],
                           F.posexplode(pieces(F.col("text"))).alias("piece_no", "piece")) \
                   .withColumn("content_type", kind)
