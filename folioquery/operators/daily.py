"""Order statistics over many days that cost one day when a day is added.

Every day is stored once: its values counted per group, and a sketch of them,
counts per bin of a fixed monotone scale. Sketches of days merge by adding
counts, so the merged sketch says exactly in which bin the wanted place lies and how
many values are below it. Only that bin's values are then read, over all
days, and ordered. No day is read whole again, and a day written again replaces itself.

Layout: ``bins/day=<d>``, ``values/day=<d>``, the latter sorted by bin, so that reading a
bin skips the row groups of others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from folioquery.operators.joins import fits_broadcast
from folioquery.session import materialize

STEPS = 256    # bins per factor of e
LITERALS = 256  # up to so many bins are named in the scan's filter


def value_bin(value: Column) -> Column:
    """Never smaller for a larger value; NaN is the largest, as in Spark's order."""
    size = F.floor(F.signum(value) * F.log1p(F.abs(value)) * STEPS)
    ends = F.when(F.isnan(value), 2**31).when(value == float("inf"), 2**31 - 1).when(value == float("-inf"), -(2**31))
    return F.coalesce(ends, size).cast("long")


@dataclass(frozen=True)
class DayStatistics:
    """Values of one column by group and day, in a folder."""

    spark: SparkSession
    path: str
    group: str
    value: str

    def add(self, rows: DataFrame, day: str) -> None:
        """Store the days in ``rows`` (group, value, day); days stored before under the same name are replaced."""
        counted = materialize(
            rows.where(F.col(self.value).isNotNull())
            .groupBy(F.col(day).cast("string").alias("day"), F.col(self.group), F.col(self.value)).agg(F.count("*").alias("n"))
            .withColumn("bin", value_bin(F.col(self.value))), "day-values")
        bins = counted.groupBy("day", self.group, "bin").agg(F.sum("n").alias("n"))
        self._write(counted.repartitionByRange("day", "bin").sortWithinPartitions("day", "bin"), "values")
        self._write(bins.repartition("day"), "bins")

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.path}/{name}")

    def _read(self, name: str, days: Column | None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/{name}").withColumn("day", F.col("day").cast("string"))
        return rows if days is None else rows.where(days)

    def sketch(self, days: Column | None = None) -> DataFrame:
        """(group, bin, n) merged over the days that a condition on ``day`` lets through."""
        return self._read("bins", days).groupBy(self.group, "bin").agg(F.sum("n").alias("n"))

    def statistic(self, share: float, days: Column | None = None, name: str = "p80") -> DataFrame:
        """(group, n, <name>): the value at 0-based place floor(share * n) of each group's sorted values."""
        group = Window.partitionBy(self.group)
        upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        places = self.sketch(days).withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(group)}) \
            .withColumn("place", F.floor(F.col("all") * F.lit(share)))
        wanted = materialize(
            places.where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("n") <= F.col("place")))
            .select(F.col(self.group).alias("_group"), F.col("bin").alias("_bin"), "place", F.col("all").alias("total"),
                    (F.col("upto") - F.col("n")).alias("below")), "wanted-bins")
        values = self._read("values", days)
        few = wanted.select("_bin").distinct().limit(LITERALS + 1).collect()
        if len(few) <= LITERALS:
            values = values.where(F.col("bin").isin([r["_bin"] for r in few]))
        same = F.col(self.group).eqNullSafe(F.col("_group")) & (F.col("bin") == F.col("_bin"))
        near = (values.join(F.broadcast(wanted) if fits_broadcast(wanted) else wanted, same)
                .groupBy(self.group, self.value, "place", "below", "total").agg(F.sum("n").alias("n")))
        ordered = Window.partitionBy(self.group).orderBy(self.value).rowsBetween(Window.unboundedPreceding, 0)
        return (near.withColumn("upto", F.col("below") + F.sum("n").over(ordered)).where("upto > place")
                .groupBy(self.group).agg(F.first("total").alias("n"), F.min(self.value).alias(name)))
