"""Markdown folders as (file_id, file_name, value) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioquery.functions.text import clean_markdown, html_to_markdown, strip
from folioquery.operators.joins import with_positions
from folioquery.session import materialize


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Whole markdown files, numbered from 1 in file-name order.

    Only .md/.markdown files count, in any case, and none with "merged" in its
    name. Numbers come from the listing alone, so a file that cannot be read
    keeps its number and is then skipped; texts are read once and joined by name.
    """
    low = F.lower("file_name")
    accepted = (low.endswith(".md") | low.endswith(".markdown")) & ~low.contains("merged")
    name = F.col("_metadata.file_name").alias("file_name")
    listed = spark.read.format("binaryFile").load(folder).select(name)  # contents are not opened
    numbered = with_positions(listed.where(accepted), [F.asc("file_name")], "file_id")
    texts = (
        spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
        .text(folder, wholetext=True)
        .select(name, "value")
    )
    plain = F.url_decode(F.replace("file_name", F.lit("+"), F.lit("%2B"))).alias("file_name")  # metadata names are escaped
    return texts.where(accepted).join(numbered, "file_name").select("file_id", plain, "value")


def read_markdown_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, file_name, line_no, s) of the same files, line by line, for files of any length.

    A file's blocks are read by many tasks. A line's number is its block's first byte
    plus its place among the lines of the block: ascending, but not dense.
    """
    low = F.lower("file_name")
    accepted = (low.endswith(".md") | low.endswith(".markdown")) & ~low.contains("merged")
    lines = spark.read.text(folder).select(
        F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), strip(F.col("value")).alias("s")).where(accepted)
    kept = materialize(lines, "markdown-lines")
    starts = kept.groupBy("file_name", "block").agg(F.min("place").alias("start"))  # one row a block
    names = with_positions(starts.select("file_name").distinct(), [F.asc("file_name")], "file_id")
    placed = starts.join(names, "file_name")
    plain = F.url_decode(F.replace("file_name", F.lit("+"), F.lit("%2B"))).alias("file_name")
    return kept.join(placed, ["file_name", "block"]).select(
        "file_id", plain, (F.col("block") + F.col("place") - F.col("start")).alias("line_no"), "s")


def clean(docs: DataFrame, profile: str, column: str = "value") -> DataFrame:
    return docs.withColumn(column, clean_markdown(F.col(column), profile))


def pages_as_markdown(pages: DataFrame) -> DataFrame:
    """Web pages -> (file_id, file_name, value)."""
    return pages.select(F.col("page_id").alias("file_id"), F.col("url").alias("file_name"),
                        html_to_markdown(F.col("html")).alias("value"))
