"""Latency statistics from application logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from folioquery.functions import fixed_values as fv
from folioquery.operators.joins import join_small, with_positions
from folioquery.session import materialize


def _number(line: Column, pattern: str) -> Column:
    text = F.regexp_extract(line, pattern, 1)
    return F.nullif(text, F.lit("")).try_cast("double")


def log_marks(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines that matter, with ``risk`` or ``total`` (never both) filled."""
    text = F.col(line)
    risk = F.nullif(F.regexp_extract(text, fv.LOG_RISK, 1), F.lit(""))
    total = F.when(risk.isNull(), _number(text, fv.LOG_TOTAL))
    marked = lines.withColumn("risk", risk).withColumn("total", total)
    return marked.where(F.col("risk").isNotNull() | F.col("total").isNotNull())


def timings(lines: DataFrame, line: str = "line") -> DataFrame:
    """Completed questions: total, retrieval and generation seconds, and the time stamp."""
    text = F.col(line)
    stamp = F.try_to_timestamp(F.regexp_extract(text, r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d),\d+ \| ", 1),
                               F.lit("yyyy-MM-dd HH:mm:ss"))
    return lines.withColumns({
        "ts": stamp, "total": _number(text, fv.LOG_TOTAL), "retrieval": _number(text, fv.LOG_RETRIEVAL),
        "generation": _number(text, fv.LOG_GENERATION)}).where(F.col("total").isNotNull())


def pair_risks(marks: DataFrame, order: list, stream: list[str] | None = None) -> DataFrame:
    """Latencies with the risk class they belong to.

    A risk mark waits for the next latency and is used up by it. So a latency
    counts exactly when the mark right before it is a risk. ``stream`` columns
    partition the log into independent streams of bounded size; without them
    the one long stream is numbered by a distributed sort and every latency
    looks up its predecessor by number.
    """
    if stream:
        seq = Window.partitionBy(*stream).orderBy(*order)
        paired = marks.withColumn("before", F.lag("risk").over(seq))
    else:
        numbered = with_positions(marks, order)
        risks = numbered.where(F.col("risk").isNotNull()).select(
            (F.col("pos") + 1).alias("pos"), F.col("risk").alias("before"))
        paired = numbered.where(F.col("total").isNotNull()).join(risks, "pos").drop("pos")
    return paired.where(F.col("total").isNotNull() & F.col("before").isNotNull()) \
                 .withColumn("risk", F.col("before")).drop("before")


def order_statistic(values: DataFrame, group: str, value: str, share: float = 0.8,
                    name: str = "p80", digits: int | None = 1) -> DataFrame:
    """The value at 0-based place floor(share * n) of each group's sorted values.

    Exact, without sorting or collecting a group: an approximate percentile
    sketch brackets the place, values below the bracket are counted, and only
    the distinct values inside it are ordered.
    """
    margin = 0.005
    known = values.where(F.col(value).isNotNull()).select(group, value)
    bracket = materialize(known.groupBy(group).agg(
        F.count("*").alias("n"),
        F.percentile_approx(value, max(0.0, share - margin), 10_000).alias("lo"),
        F.percentile_approx(value, min(1.0, share + margin), 10_000).alias("hi")), "bracket")
    near = join_small(known, bracket, group).where(F.col(value) <= F.col("hi"))
    counts = (
        near.withColumn("v", F.when(F.col(value) >= F.col("lo"), F.col(value)))  # NULL: below the bracket
        .groupBy(group, "n", "v").agg(F.count("*").alias("c"))
    )
    upto = Window.partitionBy(group).orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)
    place = F.floor(F.col("n") * F.lit(share))
    picked = F.min("v") if digits is None else F.round(F.min("v"), digits)
    return (
        counts.withColumn("upto", F.sum("c").over(upto))
        .where((F.col("upto") > place) & F.col("v").isNotNull())
        .groupBy(group).agg(F.first("n").alias("n"), picked.alias(name))
    )


def risk_percentiles(paired: DataFrame) -> DataFrame:
    return order_statistic(paired, "risk", "total")
