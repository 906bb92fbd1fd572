"""Column expressions on text. All built-in functions, no Python workers."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from folioquery.functions import fixed_values as fv
from folioquery.functions.tables import pipe_tables


_OTHER_WHITESPACE = fv.WHITESPACE.replace(" ", "")


def strip(col: Column, chars: str = fv.WHITESPACE) -> Column:
    """Remove any of ``chars`` from both ends.

    Trimming spaces is cheap, trimming a set of characters is not; so for
    whitespace the set is tried only where it shows at an end.
    """
    if chars != fv.WHITESPACE:
        return F.btrim(col, F.lit(chars))
    plain = F.trim(col)
    ends = F.concat(F.substring(plain, 1, 1), F.substring(plain, -1, 1))
    odd = F.translate(ends, _OTHER_WHITESPACE, "") != ends
    return F.when(odd, F.btrim(plain, F.lit(chars))).otherwise(plain)


def lstrip(col: Column, chars: str = fv.WHITESPACE) -> Column:
    return F.ltrim(col, F.lit(chars))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where the
    body uses it many times or inside a lambda."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)


def blank_to_null(col: Column) -> Column:
    return F.when(strip(col) != "", col)


def lines(col: Column) -> Column:
    """Split on any newline convention."""
    return F.split(col, r"\r\n|\r|\n", -1)


# --- tokens -----------------------------------------------------------------

def sparse_tokens(col: Column) -> Column:
    """Tokens for BM25: lower case, punctuation to space, cut at spaces only.

    Newlines and tabs stay inside tokens; tokens of only whitespace vanish.
    """
    flat = F.regexp_replace(F.lower(col), "[" + re.escape(fv.TOKEN_PUNCTUATION) + "]", " ")
    # A token starting with a visible ASCII character cannot be blank.
    return F.filter(F.split(flat, " ", -1),
                    lambda t: ((t >= "!") & (t < "\x7f")) | (strip(t) != ""))


def set_tokens(col: Column) -> Column:
    """Distinct tokens for set similarity, without stop words."""
    words = F.split(F.regexp_replace(F.lower(col), r"[^a-z0-9]+", " "), " ", -1)
    drop = F.array(*[F.lit(w) for w in ("",) + fv.JACCARD_STOPWORDS])
    return F.array_except(words, drop)


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity of two distinct-token arrays; 0 when either is empty."""
    ratio = bind(F.size(F.array_intersect(a, b)), lambda both: both / (F.size(a) + F.size(b) - both))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), ratio).otherwise(F.lit(0.0))


def sentences(col: Column) -> Column:
    """Split after ``. ! ?`` followed by whitespace; empty pieces vanish."""
    pieces = F.split(col, r"(?U)(?<=[.!?])\s+", -1)
    return F.filter(F.transform(pieces, lambda s: strip(s)), lambda s: s != "")


def token_estimate(col: Column) -> Column:
    return F.floor(F.length(col) / 4)


def token_headroom(col: Column, budget: int = fv.CONTEXT_TOKENS) -> Column:
    return F.lit(budget) - token_estimate(col)


# --- cleaning ---------------------------------------------------------------

def cut_front_matter(col: Column, anchor: str) -> Column:
    at = F.instr(col, anchor)
    return F.when(at > 0, F.substr(col, at)).otherwise(col)


def drop_boilerplate(col: Column, patterns: Sequence[str]) -> Column:
    for pattern in patterns:
        if pattern:
            col = F.regexp_replace(col, f"(?iu){pattern}", "")
    return col


def collapse_table_spaces(col: Column) -> Column:
    """Runs of spaces become one, only on lines framed by pipes."""
    def one_line(line: Column) -> Column:
        framed = line.rlike(r"^\|.*\|$")
        return F.when(framed, F.regexp_replace(line, " {2,}", " ")).otherwise(line)

    return F.array_join(F.transform(F.split(col, "\n", -1), one_line), "\n")


def collapse_dashes(col: Column) -> Column:
    return F.regexp_replace(col, "-{4,}", "---")


def fix_spacing(col: Column) -> Column:
    col = F.regexp_replace(col, r"\.{4,}", " ")
    return strip(F.regexp_replace(col, r"\n{3,}", "\n\n"))


def clean_markdown(col: Column, profile: str = "800-218A") -> Column:
    """The whole cleaning chain for one document profile."""
    spec = fv.CLEAN_PROFILES[profile]
    col = cut_front_matter(col, spec["anchor"])
    col = drop_boilerplate(col, spec["junk"])
    return fix_spacing(collapse_dashes(collapse_table_spaces(col)))


# --- answers and questions --------------------------------------------------

def strip_markup(col: Column) -> Column:
    """Drop bold marks (within a line) and leading heading marks."""
    col = F.regexp_replace(col, r"\*\*(.*?)\*\*", "$1")
    return F.regexp_replace(col, r"(?m)^#{1,6}(?U:\s)+", "")


def _any_match(col: Column, patterns: Sequence[str]) -> Column:
    lowered = F.lower(col)
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | lowered.rlike(f"(?U){pattern}")
    return hit


def matched_pattern(col: Column, patterns: Sequence[str]) -> Column:
    """1-based number of the first pattern that hits, NULL for none."""
    lowered = F.lower(col)
    return F.coalesce(*[F.when(lowered.rlike(f"(?U){p}"), F.lit(i))
                        for i, p in enumerate(patterns, 1)])


def risk_class(col: Column, profile: str = "core") -> Column:
    return F.when(_any_match(col, fv.RISK_PATTERNS[profile]), "HIGH").otherwise("LOW")


def is_list_question(col: Column, profile: str = "core") -> Column:
    return _any_match(col, fv.LIST_PATTERNS[profile])


def with_list_note(answer: Column, question: Column, profile: str = "core") -> Column:
    note = F.when(is_list_question(question, profile), fv.LIST_NOTE).otherwise("")
    return F.concat(answer, note)


def short_source(col: Column) -> Column:
    found = F.regexp_extract(col, f"(?U){fv.SHORT_SOURCE}", 0)
    return F.when(found != "", found).otherwise(col)


def location(chapter: Column, section: Column) -> Column:
    return F.concat_ws(" > ", F.nullif(chapter, F.lit("")), F.nullif(section, F.lit("")))


# --- html -------------------------------------------------------------------

HTML_STEPS = (
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<script\b.*?</script\s*>", ""),
    (r"(?is)<style\b.*?</style\s*>", ""),
    (r"(?is)<head\b.*?</head\s*>", ""),
    (r"(?is)<!doctype[^>]*>", ""),
    (r"(?i)<h1\b[^>]*>", "\n\n# "),
    (r"(?i)<h2\b[^>]*>", "\n\n## "),
    (r"(?i)<h3\b[^>]*>", "\n\n### "),
    (r"(?i)<li\b[^>]*>", "\n- "),
    (r"(?i)<img\b[^>]*>", "\n\n![figure](image)\n\n"),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</?(p|div|article|nav|ul|ol|footer|h1|h2|h3|table|tr|body)\b[^>]*>", "\n\n"),
    (r"(?s)<[^>]*>", ""),
)
UNSEEN_STEPS = 5   # the first ones drop what a page does not show
HTML_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "),
    ("&copy;", "©"), ("&middot;", "·"), ("&#39;", "'"), ("&amp;", "&"),
)


def html_to_markdown(col: Column) -> Column:
    """Raw page to markdown: headings, bullets and paragraphs survive.

    Takes the place of the external document converter: headings become
    ``#`` lines, list items ``- `` lines, images a reference, tables pipe tables.
    """
    for pattern, replacement in HTML_STEPS[:UNSEEN_STEPS]:
        col = F.regexp_replace(col, pattern, replacement)
    col = pipe_tables(col)
    for pattern, replacement in HTML_STEPS[UNSEEN_STEPS:]:
        col = F.regexp_replace(col, pattern, replacement)
    for entity, char in HTML_ENTITIES:
        col = F.replace(col, F.lit(entity), F.lit(char))
    return fix_spacing(F.regexp_replace(col, r"[ \t]*\n[ \t]*", "\n"))
