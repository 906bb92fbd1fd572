"""Keyed state for streams: only the keys of a micro-batch are touched.

State lives in the store of the stream's own checkpoint, one entry a key and
value, and is written as changes. A conversation that says nothing and a log that writes
nothing cost nothing, however many there are. What the state holds is read back
as a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from folioquery.functions import fixed_values as fv
from folioquery.operators.latency import log_marks
from folioquery.operators.memory import _FRAME

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Memory(StatefulProcessor):
    """Each conversation's newest turns whose texts, with their frames, stay within ``limit``.

    Of rows of one turn the last one seen stays. Emits what a touched conversation keeps.
    """

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getMapState("turns", "turn bigint", "human string, assistant string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {turn[0]: tuple(texts) for turn, texts in self.turns.iterator()} if self.turns.exists() else {}
        known = dict(held)
        for frame in rows:
            frame = frame[frame["human"].notna() & frame["assistant"].notna()]
            known.update(zip(frame["turn"].tolist(), zip(frame["human"], frame["assistant"])))
            known = self._newest(known)  # a long first load never piles up
        for turn in held.keys() - known.keys():
            self.turns.removeKey((turn,))
        for turn, texts in known.items():
            if held.get(turn) != texts:
                self.turns.updateValue((turn,), texts)
        if known:
            yield pd.DataFrame({"conv_id": key[0], "turn": list(known), "n_chars": [_FRAME + len(h) + len(a) for h, a in known.values()]})

    def _newest(self, turns: dict) -> dict:
        kept, used = {}, 0
        for turn in sorted(turns, reverse=True):
            used += _FRAME + sum(map(len, turns[turn]))
            if used > self.limit:
                break
            kept[turn] = turns[turn]
        return kept

    def close(self) -> None:
        pass


class Pairing(StatefulProcessor):
    """Latencies of a log with the risk mark right before them; a mark waits for ``patience`` seconds at most.

    Marks that waited in vain are emitted without a latency.
    """

    def __init__(self, order: list[str], patience: float | None):
        self.order, self.patience = order, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "risk string, since bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        marks = pd.concat(list(rows)).sort_values(self.order, kind="stable")  # of one log in one micro-batch
        held = self.waiting.get()  # every call on the state is a round trip, so nothing is asked or written in vain
        risk, since = held or (None, 0)
        found = []
        for row in marks.itertuples(index=False):
            now = 0 if self.patience is None else int(row.ts.timestamp() * 1000)
            if risk is not None and self.patience is not None and now - since > 1000 * self.patience:
                found.append((key[0], None, risk, None))
                risk = None
            if pd.notna(row.risk):
                risk, since = row.risk, now
            elif risk is not None:
                found.append((key[0], row.place, risk, row.total))
                risk = None
        if self.patience is not None or (risk, since) != (held or (None, 0)):
            self._wait_for(risk, since, held is not None)
        if found:
            yield pd.DataFrame(found, columns=["stream", "place", "risk", "total"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            risk, _ = self.waiting.get()
            self.waiting.clear()
            yield pd.DataFrame([(key[0], None, risk, None)], columns=["stream", "place", "risk", "total"])

    def _wait_for(self, risk: str | None, since: int, held: bool) -> None:
        for timer in list(self.handle.listTimers()) if self.patience is not None else []:
            self.handle.deleteTimer(timer)
        if risk is None:
            if held:
                self.waiting.clear()
            return
        self.waiting.update((risk, since))
        if self.patience is not None:
            self.handle.registerTimer(since + int(1000 * self.patience) + 1)

    def close(self) -> None:
        pass


def _started(frame: DataFrame, path: str, checkpoint: str, mode: str) -> StreamingQuery:
    """Every micro-batch's output goes to a folder of its own, so one that is run again replaces it."""
    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    spark = frame.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        return (frame.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())
    finally:
        spark.conf.set(STORE, before)


def keyed_memory(turns: DataFrame, path: str, checkpoint: str, limit: int = fv.HISTORY_CHARS) -> StreamingQuery:
    """Turns (conv_id, turn, human, assistant) kept per conversation; what touched ones keep goes to ``path``."""
    schema = T.StructType([turns.schema["conv_id"], T.StructField("turn", T.LongType()), T.StructField("n_chars", T.LongType())])
    kept = (turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "human", "assistant").groupBy("conv_id")
            .transformWithStateInPandas(Memory(limit), outputStructType=schema, outputMode="Update", timeMode="None"))
    return _started(kept, path, checkpoint, "update")


def remembered(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(conv_id, turn, human, assistant): what all conversations keep now."""
    state = spark.read.format("statestore").option("stateVarName", "turns").load(checkpoint)
    return state.select("key.conv_id", "user_map_key.turn", "user_map_value.human", "user_map_value.assistant")


def keyed_pairs(lines: DataFrame, stream: str, order: list[str], path: str, checkpoint: str, patience: float | None = None,
                lateness: str = "0 seconds") -> StreamingQuery:
    """(stream, place, risk, total) of many logs; ``place`` is the last column of ``order``, lines of a log arrive in order.

    ``patience`` needs a time stamp ``ts`` in ``lines``.
    """
    marks = log_marks(lines)
    timed = marks.withWatermark("ts", lateness) if patience is not None else marks
    place = lines.schema[order[-1]]
    schema = T.StructType([T.StructField("stream", lines.schema[stream].dataType), T.StructField("place", place.dataType),
                           T.StructField("risk", T.StringType()), T.StructField("total", T.DoubleType())])
    times = [] if patience is None or "ts" in order else ["ts"]
    columns = [F.col(stream).alias("stream"), *order, *times, F.col(order[-1]).alias("place"), "risk", "total"]
    pairs = timed.select(*columns).groupBy("stream").transformWithStateInPandas(
        Pairing(order, patience), outputStructType=schema, outputMode="Append",
        timeMode="None" if patience is None else "EventTime")
    return _started(pairs, path, checkpoint, "append")
