"""What a stream carries by key: when a key was first seen and its best row so far, and keys that have fallen silent.

Both are processors for ``transformWithState``. Their state is one small value for each key, merged in any order of
arrival, so that micro-batches may hold rows in any order and a repeated run comes to the same state.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Keyed state lives in RocksDB, so that it may outgrow an executor's heap. A processor in processing time asks for batches
#: without data for ever, which a run over what is there must not wait for; one in event time needs the last such batch.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
ROCKS_NO_EMPTY = ROCKS | {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}
#: How long a key that isn't seen again is remembered, unless a caller says otherwise.
REMEMBERED_MS = 90 * 24 * 3_600_000


class _Known(StatefulProcessor):
    """(first order, first id, best value, its order and id, rows so far) of each key."""

    def __init__(self, names: list[str], ttl: int):
        self.names, self.ttl = names, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        shape = "first_at long, first_id long, best double, best_at long, best_id long, n long"
        self.state = handle.getValueState("known", shape, self.ttl) if self.ttl else handle.getValueState("known", shape)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, best, n, fresh = None, None, 0, not self.state.exists()
        if not fresh:
            a, i, v, b, j, n = self.state.get()
            first, best = (a, i), None if v is None else (-v, b, j)
        before = best
        for r in rows:
            n += 1
            first = min(first, (r["_at"], r["_id"])) if first else (r["_at"], r["_id"])
            if r["_value"] is not None:
                mine = (-r["_value"], r["_at"], r["_id"])
                best = min(best, mine) if best else mine
        v, b, j = (-best[0], best[1], best[2]) if best else (None, None, None)
        self.state.update((*first, v, b, j, n))
        yield Row(*self.names)(*key, *first, v, b, j, n, fresh, before is not None and best != before)

    def close(self) -> None:
        pass


def known(rows: DataFrame, keys: list[str], order: str, ident: str, value: str, ttl: int = REMEMBERED_MS) -> DataFrame:
    """(rows with keys, a timestamp, a long id and a number) -> for each micro-batch the keys it held, with first_at
    (microseconds) and first_id of the earliest row so far, best, best_at and best_id of the highest value so far, n rows so
    far, whether the key is new, and whether this batch improved a best that was there before.

    Ties go to the earlier row, then the lower id. A null value counts as a row but is never the best; rows without time or
    id are left out; a null key is a key. A key not seen for ``ttl`` milliseconds is forgotten (0: never)."""
    shape = T.StructType([*(rows.schema[k] for k in keys), *T._parse_datatype_string("first_at long, first_id long, best double, best_at long, best_id long, n long, fresh boolean, improved boolean").fields])
    given = rows.filter(F.col(order).isNotNull() & F.col(ident).isNotNull()).select(*keys, F.unix_micros(F.col(order).cast("timestamp")).alias("_at"), F.col(ident).cast("long").alias("_id"), F.col(value).cast("double").alias("_value"))
    return given.groupBy(*keys).transformWithState(statefulProcessor=_Known(shape.names, ttl), outputStructType=shape, outputMode="Update", timeMode="ProcessingTime")


def first_rows(rows: DataFrame, keys: list[str], order: str, ident: str, ttl: int = REMEMBERED_MS) -> DataFrame:
    """One row for each key, when it is first seen: the id of the earliest row of the first micro-batch that holds it."""
    return known(rows.withColumn("_none", F.lit(None).cast("double")), keys, order, ident, "_none", ttl).filter("fresh").select(*keys, F.col("first_id").alias(ident))


class _Silent(StatefulProcessor):
    """Open spans of rows of each key, ``gap`` apart at least; a timer closes those that are due first.

    Each call of the state goes to the JVM and back, so a key's spans are one value, and the timer that stands is known from them."""

    def __init__(self, names: list[str], gap: int):
        self.names, self.gap = names, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("spans", "began array<long>, ended array<long>, n array<long>")

    def _due(self, span: tuple) -> int:
        """Milliseconds of event time from which nothing can prolong a span."""
        return -(-(span[1] + self.gap) // 1000)

    def _held(self) -> list[tuple]:
        held = self.state.get()
        return list(zip(*held, strict=True)) if held else []

    def _keep(self, spans: list[tuple]) -> None:
        if spans:
            self.state.update(tuple(map(list, zip(*spans, strict=True))))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self._held()
        spans: list[tuple] = []
        for a, b, n in sorted([*held, *((r[-1], r[-1], 1) for r in rows)]):
            if spans and a < spans[-1][1] + self.gap:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]), spans[-1][2] + n)
            else:
                spans.append((a, b, n))
        self._keep(spans)
        before, due = (min(map(self._due, x), default=None) for x in (held, spans))
        if before is not None and before != due:
            self.handle.deleteTimer(before)
        if due is not None and before != due:
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        spans = self._held()
        left = [x for x in spans if self._due(x) > now]
        self._keep(left)
        if left:  # the timer that has expired goes by itself
            self.handle.registerTimer(min(map(self._due, left)))
        row = Row(*self.names)
        for x in spans:
            if self._due(x) <= now:
                yield row(*key, *x)

    def close(self) -> None:
        pass


def silent(rows: DataFrame, keys: list[str], order: str, gap_seconds: int, late: str = "1 hour") -> DataFrame:
    """Each span of rows of a key that are less than ``gap_seconds`` apart, once no later row can prolong it: keys, began and
    ended (microseconds), n. Rows later than ``late`` behind the latest one seen are dropped, by the watermark; rows without
    a time are left out. Spans still open at the end of the stream stay in its state."""
    shape = T.StructType([*(rows.schema[k] for k in keys), *T._parse_datatype_string("began long, ended long, n long").fields])
    given = rows.filter(F.col(order).isNotNull()).withColumn(order, F.col(order).cast("timestamp")).withWatermark(order, late)
    given = given.select(*keys, order, F.unix_micros(order).alias("_at"))
    return given.groupBy(*keys).transformWithState(statefulProcessor=_Silent(shape.names, gap_seconds * 1_000_000), outputStructType=shape, outputMode="Append", timeMode="EventTime")
