"""Keyed state with event-time timers: queue pressure and approvals on streams.

Rows may come in any order within the watermark's delay.  They wait in state
until the watermark passes them, and are then taken in order, so that a stream
gives the rows of the batch form (`operators.pressure`) up to its watermark.
"""

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.pressure import LAST, MOVES

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> None:
    """Keep the state of streams started from now on in RocksDB, as keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class InOrder(StatefulProcessor):
    """Rows of a key wait for the watermark and are then passed on in order.

    A subclass has the waiting rows' schema, ``open``, and ``due(key, rows, upto)``,
    which takes rows in order, returns rows to emit, and when it wants to be called next.
    Times are in microseconds.
    """

    waiting_schema = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.open(handle)

    def wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r[1:4]) for r in rows]
        if new:
            self.waiting.appendList(new)
            self.wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        left = [r for r in held if r[0] > upto]
        if len(left) < len(held):
            self.waiting.put(left) if left else self.waiting.clear()
        if left:
            self.wake(min(r[0] for r in left))
        out, again = self.due(key[0], sorted(r for r in held if r[0] <= upto), upto)
        if again is not None:
            self.wake(again)
        return iter(out)

    def close(self) -> None:
        pass


class Pressure(InOrder):
    waiting_schema = "at long, ord long, breach boolean"

    def __init__(self, wait: int):
        self.wait_for = wait

    def open(self, handle) -> None:
        self.run = handle.getValueState("run", "began long, step long")

    def due(self, key, rows, upto):
        out, (began, step) = [], self.run.get() if self.run.exists() else (None, 0)

        def fire(last):
            nonlocal step
            while began is not None and began + (step + 1) * self.wait_for <= last:
                step += 1
                out.append(Row(key=key, began=began, step=step, fired=began + step * self.wait_for))

        for at, _, breach in rows:
            if not breach:
                fire(at - 1)
                began, step = None, 0
            elif began is None:
                began, step = at, 0
        fire(upto)
        if began is None:
            self.run.clear()
            return out, None
        self.run.update((began, step))
        return out, began + (step + 1) * self.wait_for


class Approvals(InOrder):
    waiting_schema = "at long, ord long, op string"

    def __init__(self, ttl: int):
        self.ttl = ttl

    def open(self, handle) -> None:
        self.item = handle.getValueState("item", "status string, opened long")

    def due(self, key, rows, upto):
        status, opened = self.item.get() if self.item.exists() else (None, None)
        out = []

        def move(at, ord, op, to):
            nonlocal status
            out.append(Row(id=key, at=at, ord=ord, op=op, before=status, after=to))
            status = to

        def expire(last):
            if status in ("pending", "replied") and opened + self.ttl <= last:
                move(opened + self.ttl, LAST, "expire", "expired")

        for at, ord, op in rows:
            expire(at - 1)
            if status is None and op == "queue":
                opened = at
                move(at, ord, op, "pending")
            elif status == "pending" and op in MOVES or status == "replied" and op in ("reply", "expire"):
                move(at, ord, op, MOVES[op])
        expire(upto)
        if status is not None:
            self.item.update((status, opened))
        return out, opened + self.ttl if status in ("pending", "replied") else None


def pressure_stream(events: DataFrame, key: str, at: str, ord: str, breach: Column, wait: int, late: str = "1 hour") -> DataFrame:
    """`pressure_fires` on a stream: each fire once, when the watermark passes it; rows later than ``late`` are dropped."""
    x = events.select(F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(ord).cast("long").alias("ord"), F.coalesce(breach, F.lit(False)).alias("breach"), F.col(at).cast("timestamp").alias("event_time"))
    x = x.where("key IS NOT NULL AND at IS NOT NULL").withWatermark("event_time", late).select("key", "at", "ord", "breach", "event_time")
    kind = dict(x.dtypes)["key"]
    return keyed(x, "key", Pressure(wait), f"key {kind}, began long, step long, fired long").withColumnRenamed("key", key)


def approval_stream(events: DataFrame, at: str, ttl: int, late: str = "1 hour") -> DataFrame:
    """`approval_moves` on a stream of (id, ord, op) and the time ``at``."""
    x = events.select("id", F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col("ord").cast("long").alias("ord"), "op", F.col(at).cast("timestamp").alias("event_time"))
    x = x.where("id IS NOT NULL AND at IS NOT NULL AND op IS NOT NULL").withWatermark("event_time", late)
    kind = dict(x.dtypes)["id"]
    return keyed(x, "id", Approvals(ttl), f"id {kind}, at long, ord long, op string, before string, after string")


def keyed(x: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    from pyspark.sql.types import _parse_datatype_string

    return x.groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=_parse_datatype_string(schema), outputMode="Append", timeMode="EventTime")
