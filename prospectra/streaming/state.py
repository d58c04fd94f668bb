"""Stateful feeds: rows of a key are handled in the order of their time, whatever order they come in.

A row waits in the state until the watermark has passed it, so that no earlier row can follow; then the processor of the
feed sees it. Each feed gives the rows of its batch form. The queries need the RocksDB state store (``state_store``).
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from decimal import ROUND_HALF_UP, Decimal
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from prospectra.operators import feeds

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: Rows that one value of a list state holds.
BLOCK, BLOCKS = 10_000, "rows binary"


def state_store(spark: SparkSession) -> None:
    """Let the streams of this session keep their state in RocksDB, as arbitrary state requires."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def micros(t: datetime) -> int:
    return (t.astimezone(timezone.utc) - EPOCH) // timedelta(microseconds=1)


def add_rows(state, rows: Iterable[tuple]) -> int | None:
    """Append rows to a list state, thousands in a value, as every value is a call to the state store; the smallest first column."""
    rows, least = iter(rows), None
    while block := list(islice(rows, BLOCK)):
        state.appendValue((pickle.dumps(block),))
        here = min(r[0] for r in block)
        least = here if least is None else min(least, here)
    return least


def rows_of(state) -> list[tuple]:
    return [r for (block,) in state.get() for r in pickle.loads(block)] if state.exists() else []


class InOrder(StatefulProcessor):
    """Holds rows until the watermark has passed their time; ``handle`` sees each key's rows in order of time and ``tie``.

    It gets them as tuples, the time in microseconds before the columns. ``keep_ms`` after a key's last row its state is
    cleared by a timer.
    """

    def __init__(self, schema: str, ts: str, tie: str, keep_ms: int):
        self.schema, self.ts, self.tie, self.keep_ms = schema, ts, tie, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle_ = handle
        self.waiting = handle.getListState("waiting", BLOCKS)
        self.timer = handle.getValueState("timer", "at long")
        self.open_state(handle)

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        """Further state of the feed."""

    def clear_state(self) -> None:
        """Forget a key that has been silent."""

    def handle(self, key, rows: list[tuple]) -> Iterator[Row]:
        raise NotImplementedError

    def _wake(self, at_ms: int) -> None:
        """The key's one timer."""
        if self.timer.exists():
            now = self.timer.get()[0]
            if now == at_ms:
                return
            self.handle_.deleteTimer(now)
        self.handle_.registerTimer(at_ms)
        self.timer.update((at_ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ts = self._names().index(self.ts)
        first = add_rows(self.waiting, ((micros(r[ts]), *r) for r in rows))
        if first is not None:
            earliest = first // 1000 + 1
            known = self.timer.get()[0] if self.timer.exists() else None
            if known is None or earliest < known:
                self._wake(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = rows_of(self.waiting)
        tie = 1 + self._names().index(self.tie)
        ready = sorted((r for r in rows if r[0] < passed), key=lambda r: (r[0], r[tie]))
        left = [r for r in rows if r[0] >= passed]
        del rows
        self.timer.clear()
        self.waiting.clear()
        if left:
            self._wake(add_rows(self.waiting, left) // 1000 + 1)
        elif ready:
            self._wake(ready[-1][0] // 1000 + 1 + self.keep_ms)
        else:
            self.clear_state()
        yield from self.handle(key, ready)

    def _names(self) -> list[str]:
        return [c.split()[0] for c in self.schema.split(", ")]

    def close(self) -> None:
        pass


def rounded(total: int, n: int) -> float | None:
    """Mean with four places, halves away from zero, as in batch."""
    return float(Decimal(repr(total / n)).quantize(Decimal("0.0001"), ROUND_HALF_UP)) if n else None


RUN_IN = "id long, stage_name string, started_at timestamp, items_processed long, duration_seconds long"
RUN_OUT = "id long, stage_name string, started_at timestamp, baseline double, avg_duration double, n_before long, anomaly boolean, told boolean"


class StageRuns(InOrder):
    """Baseline of each run over the seven days before it, and whether an anomaly is told.

    The state of a stage is one total a second in those days and the time of the last anomaly told.
    """

    def __init__(self):
        super().__init__(RUN_IN, "started_at", "id", feeds.BASELINE_DAYS * 86_400_000)

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        self.seconds = handle.getListState("seconds", BLOCKS)
        self.told = handle.getValueState("told", "at long")

    def clear_state(self) -> None:
        self.seconds.clear()
        self.told.clear()

    def handle(self, key, rows: list[tuple]) -> Iterator[Row]:
        if not rows:
            return
        history = deque(rows_of(self.seconds))  # second, runs, items and their number, duration and its number
        told = self.told.get()[0] if self.told.exists() else None
        sums = [sum(s[i] for s in history) for i in range(1, 6)]
        run = Row(*(c.split()[0] for c in RUN_OUT.split(", ")))
        for at, id_, stage, started, made, took in rows:
            second = at // 1_000_000
            while history and history[0][0] < second - feeds.BASELINE_DAYS * 86_400:
                sums = [a - b for a, b in zip(sums, history.popleft()[1:], strict=True)]
            same = history[-1][1:] if history and history[-1][0] == second else (0,) * 5
            n, items, n_items, duration, n_duration = (a - b for a, b in zip(sums, same, strict=True))
            baseline = rounded(items, n_items)
            short = n >= feeds.LEAST_RUNS and baseline is not None and baseline > feeds.LEAST_BASELINE and made is not None
            anomaly = bool(short and made < baseline * feeds.SHORT_OF_BASELINE and stage not in feeds.QUIET_STAGES)
            tell = anomaly and (told is None or at - told >= feeds.COOLDOWN_HOURS * 3_600_000_000)
            if tell:
                told = at
            add = (1, made or 0, int(made is not None), took or 0, int(took is not None))
            if history and history[-1][0] == second:
                history[-1] = (second, *(a + b for a, b in zip(same, add, strict=True)))
            else:
                history.append((second, *add))
            sums = [a + b for a, b in zip(sums, add, strict=True)]
            yield run(id_, stage, started, baseline, rounded(duration, n_duration), n, anomaly, tell)
        self.seconds.clear()
        add_rows(self.seconds, history)
        if told is not None:
            self.told.update((told,))


def stage_run_stream(runs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Every finished run once the watermark has passed it, with its baseline, whether it fell short and whether that is told.

    Equal to ``stage_anomalies`` and ``alert_cooldown`` of the rows that come within ``delay``. Runs without a start or
    a stage are left out; equal times go by id; a run that comes twice counts twice.
    """
    done = runs.where(F.col("status").isin("success", "partial") & F.col("started_at").isNotNull() & F.col("stage_name").isNotNull())
    rows = done.select(F.col("id").cast("long").alias("id"), "stage_name", "started_at", *(F.col(c).cast("long").alias(c) for c in ("items_processed", "duration_seconds")))
    state_store(runs.sparkSession)
    return rows.withWatermark("started_at", delay).groupBy("stage_name").transformWithState(StageRuns(), RUN_OUT, "Append", "EventTime")


BOUNCE = "id long, email string, bounce_type string, ts timestamp"
ACTION = "id long, email string, bounce_type string, ts timestamp, n_soft long, suppress boolean"


class SpacedBounces(InOrder):
    """Bounces a day or more after the last kept one of their address and type."""

    def __init__(self):
        super().__init__(BOUNCE, "ts", "id", feeds.BOUNCE_SPACING * 1000)

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "at long")

    def clear_state(self) -> None:
        self.kept.clear()

    def handle(self, key, rows: list[tuple]) -> Iterator[Row]:
        last = self.kept.get()[0] if self.kept.exists() else None
        bounce = Row(*self._names())
        for at, *r in rows:
            if last is None or at - last >= feeds.BOUNCE_SPACING * 1_000_000:
                last = at
                yield bounce(*r)
        if last is not None:
            self.kept.update((last,))


class SoftBounces(StatefulProcessor):
    """Running number of kept soft bounces of an address, and the one event that suppresses it.

    Kept bounces come out of ``SpacedBounces`` batch by batch in order of time, so those of a batch only need sorting.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("soft", "n long, suppressed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, suppressed = self.state.get() if self.state.exists() else (0, False)
        for r in sorted(rows, key=lambda r: (r["ts"], r["id"])):
            n += r["bounce_type"] == "soft_bounce"
            now = not suppressed and (r["bounce_type"] != "soft_bounce" or n >= feeds.SOFT_BOUNCES)
            suppressed = suppressed or now
            yield Row(id=r["id"], email=r["email"], bounce_type=r["bounce_type"], ts=r["ts"], n_soft=n, suppress=now)
        self.state.update((n, suppressed))

    def close(self) -> None:
        pass


def bounce_stream(messages: DataFrame, delay: str = "1 day") -> DataFrame:
    """Recorded bounces with the running soft count of their address and whether they suppress it, which happens once.

    Two chained stateful steps: per address and type a bounce within a day of the last recorded one is dropped; per
    address a hard bounce or a complaint suppresses, and so does the third recorded soft bounce. Equal to
    ``feeds.bounce_actions`` of the rows that come within ``delay``; rows without a time or address are left out.
    """
    found = messages.where(feeds.is_bounce_notice(F.col("subject"), F.col("sender")) & F.col("ts").isNotNull() & F.col("email").isNotNull())
    kind = feeds.classify_bounce(*(F.col(c) for c in ("dsn", "body", "subject", "sender"))).alias("bounce_type")
    rows = found.select(F.col("id").cast("long").alias("id"), "email", kind, "ts")
    state_store(messages.sparkSession)
    kept = rows.withWatermark("ts", delay).groupBy("email", "bounce_type").transformWithState(SpacedBounces(), BOUNCE, "Append", "EventTime", eventTimeColumnName="ts")
    return kept.groupBy("email").transformWithState(SoftBounces(), ACTION, "Append", "EventTime")
