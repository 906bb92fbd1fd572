"""Reference identifiers found in text, normalised, distinct and sorted."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from folioquery.functions import fixed_values as fv
from folioquery.functions.text import bind, strip

_KEYWORD = r"(?iU)\b(" + "|".join(fv.FUNCTION_PREFIX) + r")\b"


def _none() -> Column:
    return F.array().cast("array<string>")


def _mapped(col: Column, table: dict[str, str]) -> Column:
    out = col
    for key, value in table.items():
        out = F.when(col == key, value).otherwise(out)
    return out


def function_ids(text: Column) -> Column:
    """Decimals after a function keyword take that keyword as their prefix.

    The text is cut at each keyword, so the piece after the n-th keyword
    holds exactly the decimals the n-th keyword governs.
    """
    words = F.regexp_extract_all(text, F.lit(_KEYWORD), F.lit(1))
    pieces = F.split(text, _KEYWORD, -1)
    owned = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def tag(word: Column, piece: Column) -> Column:
        prefix = _mapped(F.lower(word), fv.FUNCTION_PREFIX)
        found = F.regexp_extract_all(piece, F.lit(r"(?U)\b\d+\.\d+\b"), F.lit(0))
        return F.transform(found, lambda d: F.concat(prefix, F.lit("_"), d))

    found = F.flatten(F.zip_with(words, owned, tag))
    return F.when(text.rlike(r"\p{Nd}\.\p{Nd}"), found).otherwise(_none())


def universal_ids(text: Column) -> Column:
    """``AB-1.2`` style identifiers; short prefixes are spelled out."""
    def normal(match: Column) -> Column:
        return bind(F.regexp_extract(match, "^[A-Z]+", 0), lambda p: F.concat(
            _mapped(p, fv.SHORT_PREFIX), F.lit("_"), F.substr(match, F.length(p) + 2)))

    return F.transform(F.regexp_extract_all(text, F.lit("(?U)" + fv.UNIVERSAL_ID), F.lit(0)), normal)


# A word and a run of digits that every match of the pattern contains, to skip texts without them.
_STANDARD_HINTS = (("iso", r"\d{4}"), ("sp", r"\s\d{3}-\d{3}"), ("nist", r"\s\d{3}"), ("o", r"\s\d{5}"), ("fips", r"\s\d"),
                   ("rfc", r"\s\d{4}"), ("ieee", r"\s\d{3}"))


def standard_ids(text: Column) -> Column:
    """Identifiers of standards, upper case with underscores for spaces."""
    low = F.lower(text)
    for variant, plain in (("ſ", "s"), ("ı", "i"), ("i̇", "i")):  # letters that equal s and i in any case
        low = F.replace(low, F.lit(variant), F.lit(plain))
    found = bind(low, lambda low: F.flatten(F.array(*[
        F.when(F.contains(low, F.lit(word)) & text.rlike(f"(?U){digits}"),
               F.regexp_extract_all(text, F.lit(f"(?iU){p}"), F.lit(0))).otherwise(_none())
        for p, (word, digits) in zip(fv.STANDARD_IDS, _STANDARD_HINTS, strict=True)])))
    return F.transform(found, lambda m: F.regexp_replace(strip(F.upper(m)), r"(?U)\s+", "_"))


def reference_ids(text: Column) -> Column:
    """All identifiers. Each kind holds a digit, so texts without one are skipped."""
    def found(text: Column) -> Column:
        every = F.concat(function_ids(text), universal_ids(text), standard_ids(text))
        return F.when(text.rlike(r"\p{Nd}"), F.sort_array(F.array_distinct(every))).otherwise(_none())
    return bind(text, found)  # a text made of parts is put together once
