"""Tables that change by segments instead of being written anew.

A change writes one segment: new rows of each table, and the keys whose older
rows count no more. It counts from the moment its line in the log is written,
which is last; a change that died before leaves nothing that is read, and its number is
used again. Reading takes the segments since the last base and drops rows that a
later segment has gone over. Compaction writes what counts as a new base. One
writer at a time.

Layout: ``<table>/segment=<n>``, ``gone/segment=<n>``, ``log/segment=<n>``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioquery.operators.joins import fits_broadcast

KEY = "key"


@dataclass(frozen=True)
class Segments:
    spark: SparkSession
    path: str

    def log(self) -> list:
        """One row per segment that counts, from the last base on: segment, base, totals by name."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return []
        rows = sorted(self.spark.read.parquet(f"{self.path}/log").collect(), key=lambda r: r["segment"])  # a row a change
        bases = [i for i, r in enumerate(rows) if r["base"]]
        return rows[bases[-1]:] if bases else []

    def table(self, name: str) -> DataFrame:
        """The rows that count now, with ``key``."""
        rows, numbers = self._all(name)
        if len(numbers) < 2:
            return rows.drop("segment")
        gone, _ = self._all("gone")
        last = gone.groupBy(KEY).agg(F.max("segment").alias("_gone"))
        last = F.broadcast(last) if fits_broadcast(gone) else last
        return rows.join(last, KEY, "left").where(F.col("_gone").isNull() | (F.col("segment") >= F.col("_gone"))).drop("_gone", "segment")

    def every(self, name: str) -> DataFrame:
        """All rows of a table of differences, which are added up and never dropped."""
        return self._all(name)[0].drop("segment")

    def totals(self) -> dict[str, int]:
        sums: dict[str, int] = {}
        for row in self.log():
            for name, value in row["totals"].items():
                sums[name] = sums.get(name, 0) + value
        return sums

    def _all(self, name: str) -> tuple[DataFrame, list[int]]:
        numbers = [r["segment"] for r in self.log()]
        if not numbers:
            raise FileNotFoundError(f"nothing was stored at {self.path}")
        folders = [f"{self.path}/{name}/segment={n}" for n in numbers]
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*folders), numbers

    def next(self) -> int:
        log = self.log()
        return log[-1]["segment"] + 1 if log else 0

    def write(self, number: int, name: str, rows: DataFrame) -> DataFrame:
        """Rows of a segment that does not count yet."""
        folder = f"{self.path}/{name}/segment={number}"
        rows.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def commit(self, number: int, totals: dict[str, int], base: bool = False) -> None:
        row = self.spark.createDataFrame([(base, totals)], "base boolean, totals map<string,bigint>")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/segment={number}")

    def compact(self, tables: list[str], sums: dict[str, Callable[[DataFrame], DataFrame]]) -> None:
        """Write what counts as a new base; ``sums`` has tables of differences and how they add up."""
        number, totals = self.next(), self.totals()
        keys = self._all("gone")[0].select(KEY).limit(0)
        for name in tables:
            self.write(number, name, self.table(name))
        for name, add in sums.items():
            self.write(number, name, add(self.every(name)))
        self.write(number, "gone", keys)
        self.commit(number, totals, base=True)
