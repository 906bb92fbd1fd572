"""Dated application logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from folioquery.functions import fixed_values as fv

ORDER = ("file_name", "block", "row")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(line, file_name, block, row): ORDER restores the order lines were written in.

    Large files are read in splits; within a split row numbers rise, and the
    split's offset orders the splits of a file.
    """
    return spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"))


def newest_files(lines: DataFrame, enough: int = fv.LOG_LINES) -> DataFrame:
    """Lines of the newest whole files, stopping once ``enough`` lines are in.

    Lines are counted per file in every task; only one row per file is ordered.
    """
    counts = lines.groupBy("file_name").agg(F.count("*").alias("n"))
    newer = Window.orderBy(F.desc("file_name")).rowsBetween(Window.unboundedPreceding, -1)
    kept = counts.withColumn("newer", F.coalesce(F.sum("n").over(newer), F.lit(0))) \
                 .where(F.col("newer") < enough)
    return lines.join(kept.select("file_name"), "file_name", "left_semi")


def write_daily(lines: DataFrame, path: str, ts: str = "ts") -> None:
    """One folder per calendar date."""
    lines.withColumn("date", F.to_date(ts)).write.mode("append").partitionBy("date").parquet(path)
