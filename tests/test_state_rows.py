"""Held rows take few calls to the state store and come back whole, in order of time."""

from datetime import datetime, timedelta, timezone

import pytest

from prospectra.streaming import state


class Values:
    def __init__(self):
        self.held, self.calls = [], 0

    def exists(self):
        return bool(self.held)

    def get(self):
        self.calls += 1
        return iter(list(self.held)) if self.many else self.held[0]

    def appendValue(self, value):
        self.calls += 1
        self.held.append(value)

    def put(self, values):
        self.calls += len(values)
        self.held = list(values)

    def update(self, value):
        self.calls += 1
        self.held = [value]

    def clear(self):
        self.held = []


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def _open(self, name, many):
        self.states[name] = Values()
        self.states[name].many = many
        return self.states[name]

    def getListState(self, name, schema):
        return self._open(name, True)

    def getValueState(self, name, schema):
        return self._open(name, False)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


START = datetime(2024, 5, 1, tzinfo=timezone.utc)


@pytest.mark.parametrize("processor, row", [
    (state.StageRuns, lambda i: (i, "audit", START + timedelta(seconds=i * 7919 % 25_000), 3, None)),
    (state.SpacedBounces, lambda i: (i, "a@b.com", "soft_bounce", START + timedelta(seconds=i * 7919 % 25_000 * 86_400))),
])
def test_many_rows_of_a_key(processor, row):
    feed, handle, n = processor(), Handle(), 25_000
    feed.init(handle)
    names = feed.schema.split(", ")
    rows = [state.Row(*(c.split()[0] for c in names))(*row(i)) for i in range(n)]
    assert list(feed.handleInputRows(("k",), iter(rows[:20_000]), None)) == [] and list(feed.handleInputRows(("k",), iter(rows[20_000:]), None)) == []
    start = state.micros(START) // 1000
    assert handle.timers == {start + 1}
    handle.timers.clear()  # Spark drops a timer that has expired
    step = 1 if processor is state.StageRuns else 86_400
    half = list(feed.handleExpiredTimer(("k",), Watermark(start + 10_000 * step * 1000), None))
    assert len(half) == 10_000 and handle.timers == {start + 10_000 * step * 1000 + 1}
    rest = list(feed.handleExpiredTimer(("k",), Watermark(start + 10**12 * 9), None))
    times = [r[feed.ts] for r in half + rest]
    assert len(times) == n and times == sorted(times) and not handle.states["waiting"].held
    if processor is state.StageRuns:
        assert [r.n_before for r in half + rest] == list(range(n))
    assert sum(s.calls for s in handle.states.values()) < 100
