"""Large JSON arrays, read by many tasks.

A file is cut at every comma, wherever its splits fall. Whether a comma separates
elements depends on all that came before: whether a string is open, and how
deep the nesting is. A piece's effect on both is one bit and one number, and effects
compose along the file (see ``operators.scan``). So quotes are counted first, then the brackets
outside of strings, then the separating commas; a piece's count is its element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioquery.operators.scan import Count, Sum, running
from folioquery.session import materialize

STRIPE = 16 * 1024 * 1024   # bytes of a file that one task scans
NOT_AN_ARRAY = "golden file is not a JSON array"


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, at, piece): what stands between commas; ``at`` ascends along a file."""
    read = spark.read.option("lineSep", ",").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("piece"))
    kept = materialize(read, "json-pieces")
    starts = kept.groupBy("file", "block").agg(F.min("place").alias("start"))  # a row a block
    return kept.join(starts, ["file", "block"]).select(
        "file", "size", (F.col("block") + F.col("place") - F.col("start")).alias("at"), "piece")


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, characters, ""))


def read_array(spark: SparkSession, path: str, stripe: int = STRIPE) -> DataFrame:
    """(file, index, item): each element's JSON text, a string's content, null for null; numbered from 1 in each file.

    Raises ValueError for a file that is not one whole JSON array.
    """
    plain = F.regexp_replace("piece", r"(?s)\\.", "")   # without escapes, every quote opens or closes
    quoted = running(pieces(spark, path).withColumn("quotes", _count(plain, '"')),
                     {"quotes_before": Sum(F.col("quotes"), before=True)}, "file", "at", stripe)
    inside = F.col("quotes_before") % 2
    outer = F.array_join(F.filter(F.split(plain, '"', -1), lambda part, i: (i + inside) % 2 == 0), "")
    change = _count(outer, r"[\[{]") - _count(outer, r"[\]}]")
    deep = running(quoted.withColumn("change", change), {"depth": Sum(F.col("change"))}, "file", "at", stripe)
    open_string = (F.col("quotes_before") + F.col("quotes")) % 2 == 1
    separates = ~open_string & (F.col("depth") == 1)
    numbered = materialize(running(
        deep.withColumns({"open_string": open_string, "separates": separates}),
        {"element": Count(F.col("separates"), before=True)}, "file", "at", stripe), "json-numbered")
    _check(numbered)
    texts = numbered.groupBy("file", "element").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), ",").alias("text"),
        F.min("depth").alias("least"))
    # The first element still has the opening bracket, the last one the closing one.
    cut = F.when(F.col("element") == 0, F.regexp_replace("text", r"^\s*\[", "")).otherwise(F.col("text"))
    whole = F.trim(F.when(F.col("least") == 0, F.regexp_replace(cut, r"\]\s*$", "")).otherwise(cut))
    stripped = texts.select("file", (F.col("element") + 1).alias("index"), F.regexp_replace(whole, r"^\s+|\s+$", "").alias("text"), "least")
    empty = (F.col("text") == "") & (F.col("index") == 1) & (F.col("least") == 0)   # [] has no elements
    listed = materialize(stripped.where(~empty), "json-items")
    alone = F.concat(F.lit("["), F.col("text"), F.lit("]"))
    values = F.from_json(alone, "array<string>")
    one = F.try_parse_json(alone).isNotNull() & (F.size(values) == 1)
    if not listed.where(~F.coalesce(one, F.lit(False))).isEmpty():
        raise ValueError(NOT_AN_ARRAY)
    return listed.select("file", F.col("index").cast("int").alias("index"), F.get(values, 0).alias("item"))


def _check(numbered: DataFrame) -> None:
    """Brackets and strings of each file must close, at its end and no sooner."""
    last = F.max_by(F.struct("depth", "open_string"), "at")
    first = F.min_by("piece", "at")
    files = numbered.groupBy("file").agg(
        first.rlike(r"^\s*\[").alias("opens"), (last["depth"] == 0).alias("closes"), last["open_string"].alias("open_string"),
        F.count_if((F.col("depth") <= 0)).alias("ends"), F.max_by("piece", "at").rlike(r"\]\s*$").alias("bracket"),
        (F.sum(F.octet_length("piece")) + F.count("*") - 1 == F.first("size")).alias("whole"))
    bad = files.where(~(F.col("opens") & F.col("closes") & F.col("bracket") & F.col("whole")) | F.col("open_string") | (F.col("ends") != 1))
    if numbered.isEmpty() or not bad.isEmpty():
        raise ValueError(NOT_AN_ARRAY)
