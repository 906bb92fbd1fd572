"""Log pairing and conversation memory over streams.

Each micro-batch is handled by the same distributed operators as a whole log.
Only what the next batch needs is carried over: the last mark of each stream,
or the newest turns of each conversation. Carried tables are written per batch
id, so a batch that is run again writes the same files again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from folioquery.functions import fixed_values as fv
from folioquery.operators.latency import log_marks, pair_risks
from folioquery.operators.memory import kept_turns
from folioquery.session import materialize


def read_log_stream(spark: SparkSession, path: str) -> DataFrame:
    """New log files as they appear, with the columns that restore line order."""
    return spark.readStream.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"))


def _carry(spark: SparkSession, path: str, batch: int, schema) -> DataFrame:
    """What the previous batch left, or nothing before the first."""
    if batch == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/carry/{batch - 1}")


def pair_stream(lines: DataFrame, order: list[str], path: str, checkpoint: str,
                available_now: bool = True) -> StreamingQuery:
    """Write (order..., risk, total) pairs of a line stream to ``path``/pairs.

    The last mark of a batch may be a risk still waiting for its latency, so
    it is put in front of the next batch.
    """
    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks = log_marks(batch).select(*order, "risk", "total")
        waiting = _carry(spark, path, number, marks.schema)
        every = materialize(waiting.unionByName(marks), "marks")
        pair_risks(every, [F.asc(c) for c in order]).write.mode("overwrite").parquet(f"{path}/pairs/batch={number}")
        place = F.struct(*order)
        every.agg(F.max_by(F.struct("*"), place).alias("m")).where(F.col("m").isNotNull()) \
             .select("m.*").write.mode("overwrite").parquet(f"{path}/carry/{number}")

    return _start(lines, handle, checkpoint, available_now)


def memory_stream(turns: DataFrame, path: str, checkpoint: str, limit: int = fv.HISTORY_CHARS,
                  available_now: bool = True) -> StreamingQuery:
    """Keep each conversation's newest turns within ``limit``; latest state in ``path``/carry/<batch>."""
    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select("conv_id", "turn", "human", "assistant")
        known = _carry(spark, path, number, new.schema)
        kept = kept_turns(known.unionByName(new), limit).select(*new.columns)
        kept.write.mode("overwrite").parquet(f"{path}/carry/{number}")

    return _start(turns, handle, checkpoint, available_now)


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
                  available_now: bool = True) -> StreamingQuery:
    """Answer every arriving batch of questions with the batch plan."""
    def handle(batch: DataFrame, number: int) -> None:
        asked = materialize(batch, "asked")
        answer(asked).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _start(questions, handle, checkpoint, available_now)


def _start(stream: DataFrame, handle, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def last_carry(spark: SparkSession, query: StreamingQuery, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/carry/{query.lastProgress['batchId']}")
