"""The states of a run's items over a stream of events, and their results in the run's order.

Events come in any order and more than once. What is kept of an item is a set (whether it is planned, which attempts were
started, failed, succeeded), and its state follows from the set alone, so the order of events and repeats change nothing. The
attempts of an item follow one another: the first one that hasn't failed decides.

* ``skipped``: the item is planned as excluded. It never counts as missing.
* ``succeeded``: that attempt succeeded, and its payload is the item's.
* ``quarantined``: all ``attempts`` failed. With ``patience``, an attempt that was started that long ago (by the events' own
  time) and has no result counts as failed.
* ``in_progress``: that attempt was started or has a result, which waits for the item's plan; else ``pending``.

An attempt has one result: if repeats of it differ, success counts, unless the item has been released.
The first three are final. Results of final items leave in the order of their positions in the run: an item is held back
until all before it are final. Positions are kept in blocks of ``BLOCK`` by (run, block), so that a run of any length
is many small keys; ``released`` shows a block's rows once all blocks before it are whole. Of a block's state, ``PART`` items are read and
written at once, as each access costs a round trip to the state store.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

#: What an event says: an item is planned (perhaps excluded), an attempt is started, or it has a result.
EVENTS = "run_id string, position long, item_id string, kind string, attempt int, ok boolean, excluded boolean, payload string, at timestamp"
OUT = "kind string, run_id string, position long, item_id string, state string, attempt int, payload string, updated_at timestamp, version int"
FINAL = ("skipped", "succeeded", "quarantined")
BLOCK, PART = 1_000, 100

_ITEM = "item_id string, planned boolean, excluded boolean, started long, failed long, good long, payloads array<string>, waits_until long, updated_us long, state string, version int"
_FIELDS = [x.split()[0] for x in _ITEM.split(", ")]


def state_of(planned: bool, excluded: bool, started: int, failed: int, good: int, attempts: int) -> tuple[str, int]:
    """An item's state and the attempt that decides it, from the sets of its attempts (bit a - 1 for attempt a)."""
    if planned and excluded:
        return "skipped", 0
    lost = failed & ~good
    at = (lost ^ (lost + 1)).bit_length()  # the first attempt that hasn't failed
    bit = 1 << (at - 1)
    if at > attempts:
        return ("quarantined" if planned else "in_progress"), attempts
    if good & bit:
        return ("succeeded" if planned else "in_progress"), at
    return ("in_progress" if started & bit else "pending"), at


class _Held:
    """The items of one key that a call reads or changes; each part is read once and written once."""

    def __init__(self, parts, attempts: int):
        self.parts, self.attempts, self.read, self.stale = parts, attempts, {}, set()

    def _part(self, n: int) -> dict[int, dict]:
        if n not in self.read:
            held = self.parts.getValue((n,))[0] if self.parts.containsKey((n,)) else []
            self.read[n] = {x[0]: dict(zip(_FIELDS, x[1:])) for x in held}
        return self.read[n]

    def get(self, position: int) -> dict | None:
        return self._part(position // PART).get(position)

    def changed(self, position: int) -> dict:
        """The item, a new one if there is none, to be written."""
        self.stale.add(position // PART)
        return self._part(position // PART).setdefault(position, dict(zip(_FIELDS, (None, False, False, 0, 0, 0, [None] * self.attempts, None, None, None, 0))))

    def remove(self, position: int) -> None:
        self.stale.add(position // PART)
        del self._part(position // PART)[position]

    def write(self) -> None:
        for n in self.stale:
            if own := self.read[n]:
                self.parts.updateValue((n,), ([(at, *(item[c] for c in _FIELDS)) for at, item in sorted(own.items())],))
            elif self.parts.containsKey((n,)):
                self.parts.removeKey((n,))


class _Items(StatefulProcessor):
    def __init__(self, attempts: int, patience: int | None, size: int):
        self.attempts, self.patience, self.size = attempts, patience, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = ", ".join(c.replace(" ", ": ", 1) for c in ("position long, " + _ITEM).split(", "))
        self.parts = handle.getMapState("parts", "part long", f"items array<struct<{fields}>>")
        self.next = handle.getValueState("next", "position long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, held, seen = self._next(key), _Held(self.parts, self.attempts), {}
        for r in rows:
            if r.position < first:
                continue  # released already
            if r.position not in seen:
                seen[r.position] = held.changed(r.position)
            self._apply(seen[r.position], r)
        yield from self._changed(key, seen, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, held, late = expiredTimerInfo.getExpiryTimeInMs(), _Held(self.parts, self.attempts), {}
        for position in [x[0] for _, (own,) in self.parts.iterator() for x in own]:
            item = held.get(position)
            open_ = item["started"] & ~item["failed"] & ~item["good"]
            if open_ and item["waits_until"] is not None and item["waits_until"] <= now:
                late[position] = held.changed(position)
                late[position] |= {"failed": item["failed"] | open_, "waits_until": None}
        yield from self._changed(key, late, held)

    def _next(self, key) -> int:
        return self.next.get()[0] if self.next.exists() else key[1] * self.size + 1

    def _apply(self, item: dict, r: Row) -> None:
        if r.item_id:
            item["item_id"] = min(item["item_id"] or r.item_id, r.item_id)
        if r.kind == "planned":
            item |= {"planned": True, "excluded": item["excluded"] or bool(r.excluded)}
        bit = 1 << (r.attempt - 1) if r.attempt and 0 < r.attempt <= self.attempts else 0
        if r.kind == "started":
            item["started"] |= bit
            if self.patience is not None and r.at_us is not None and bit & ~item["failed"] & ~item["good"]:
                until = r.at_us // 1000 + self.patience
                item["waits_until"] = max(item["waits_until"] or 0, until)
                self.handle.registerTimer(until)
        elif r.kind == "result" and bit:
            item["good" if r.ok else "failed"] |= bit
            if r.ok and r.payload is not None:
                payloads = list(item["payloads"])
                payloads[r.attempt - 1] = min(payloads[r.attempt - 1] or r.payload, r.payload)
                item["payloads"] = payloads
        if r.at_us is not None:
            item["updated_us"] = max(item["updated_us"] or r.at_us, r.at_us)

    def _state(self, item: dict) -> tuple[str, int]:
        return state_of(item["planned"], item["excluded"], item["started"], item["failed"], item["good"], self.attempts)

    def _changed(self, key, seen: dict[int, dict], held: _Held) -> Iterator[Row]:
        for position, item in sorted(seen.items()):
            state = self._state(item)[0]
            if state != item["state"]:
                item |= {"state": state, "version": item["version"] + 1}
                yield self._row("state", key, position, item)
        at = first = self._next(key)
        while (item := held.get(at)) and item["state"] in FINAL:
            yield self._row("release", key, at, item)
            held.remove(at)
            at += 1
        held.write()
        if at > first:
            self.next.update((at,))

    def _row(self, kind: str, key, position: int, item: dict) -> Row:
        state, attempt = self._state(item)
        payload = item["payloads"][attempt - 1] if state == "succeeded" else None
        return Row(kind=kind, run_id=key[0], position=position, item_id=item["item_id"], state=state, attempt=attempt, payload=payload, updated_us=item["updated_us"], version=item["version"])


def follow(spark: SparkSession, events: DataFrame, target: str, checkpoint: str, attempts: int = 3, patience_seconds: float | None = None, lateness: str = "10 minutes"):
    """Start following a stream of ``EVENTS``; state changes and released results are appended to the folder ``target``, each once.

    Events without a run or with a position below 1 are left out. Started again on the same checkpoint, it goes on
    where it was: the writer's own log keeps a batch that comes again from being written twice.
    """
    if not 0 < attempts < 63:
        raise ValueError("attempts must be between 1 and 62")
    keyed = events.filter(F.col("run_id").isNotNull() & (F.col("position") >= 1)).withColumn("block", F.floor((F.col("position") - 1) / BLOCK).cast("long"))
    if patience_seconds is not None:
        keyed = keyed.withWatermark("at", lateness)
    processor = _Items(attempts, None if patience_seconds is None else int(patience_seconds * 1000), BLOCK)
    name, ours = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ours)  # the stream takes the setting as it starts
    try:
        timed = keyed.withColumn("at_us", F.unix_micros("at")).groupBy("run_id", "block")
        out = timed.transformWithState(processor, OUT.replace("updated_at timestamp", "updated_us long"), "Append", "None" if patience_seconds is None else "EventTime")
        out = out.select(*[F.timestamp_micros("updated_us").alias(c) if c == "updated_at" else c for c in (x.split()[0] for x in OUT.split(", "))])
        return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def states(spark: SparkSession, target: str) -> DataFrame:
    """The latest state of each item: run_id, position, item_id, state, attempt, payload, updated_at."""
    own = spark.read.schema(OUT).parquet(target).filter("kind = 'state'")
    rest = ["item_id", "state", "attempt", "payload", "updated_at"]
    return own.groupBy("run_id", "position").agg(F.max_by(F.struct(*rest), "version").alias("r")).select("run_id", "position", "r.*")


def released(spark: SparkSession, target: str) -> DataFrame:
    """Results in order as far as a run is whole: run_id, position, item_id, state, payload.

    One row for each block passes through the window, not the results.
    """
    own = spark.read.schema(OUT).parquet(target).filter("kind = 'release'").withColumn("block", F.floor((F.col("position") - 1) / BLOCK).cast("long"))
    w = Window.partitionBy("run_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = own.groupBy("run_id", "block").agg(F.count("*").alias("n"))
    open_ = blocks.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).filter(F.col("before") == F.col("block") * BLOCK)
    return own.join(open_.select("run_id", "block"), ["run_id", "block"]).select("run_id", "position", "item_id", "state", "payload")
