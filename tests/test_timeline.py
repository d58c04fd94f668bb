"""Sliding totals and spaced events: blocks and pointer doubling against plain loops."""

import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from prospectra.operators import timeline
from prospectra.operators.relational import spaced_events

START = datetime(2024, 3, 1, tzinfo=timezone.utc)


def test_sliding_totals_match_a_plain_sum(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), START + timedelta(microseconds=rng.randrange(40 * 3600 * 10**6)), rng.choice([None, 1, 7, -3]), rng.choice([None, 0.125, 2.5])) for i in range(400)]
    rows += [(1000 + i, "a", START + timedelta(hours=5), 2, 0.001) for i in range(30)] + [(2000, "a", None, 5, 1.0), (2001, "c", START - timedelta(days=30000), 1, 1.0)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "id int, key string, at timestamp, items int, cost double, n string")
    got = {r.id: r for r in timeline.sliding_totals(frame, ["key"], "at", ["items", "cost"], 7 * 3600, 600).collect()}
    assert len(got) == len(rows)
    second = lambda t: int((t - START).total_seconds() // 1)
    for i, key, at, _, _ in rows:
        before = [r for r in rows if at and r[2] and r[1] == key and second(at) - 7 * 3600 <= second(r[2]) < second(at)]
        assert got[i].n_before == len(before)
        assert (got[i].count_items, got[i].sum_items) == (sum(r[3] is not None for r in before), sum(r[3] or 0 for r in before))
        assert (got[i].count_cost, got[i].sum_cost) == (sum(r[4] is not None for r in before), sum((Decimal(str(r[4] or 0)) for r in before), Decimal(0)))
    assert timeline.sliding_totals(frame.where("id < 0"), ["key"], "at", ["items"], 60).count() == 0


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(40), rng.choice(["a", "b", None]), rng.randrange(3), START + timedelta(seconds=rng.randrange(200_000))) for _ in range(900)]
    rows += rows[:20] + [(5, "z", 1, None), (4, "z", 1, None), (9, "a", 0, None)] + [(k, "a", 7, START + timedelta(seconds=3600 * k)) for k in range(50)]
    rows += [(None, "a", 0, rows[0][3]), (1, None, None, START)]
    return spark.createDataFrame(rows, "id int, key string, type int, at timestamp").repartition(5)


@pytest.mark.parametrize("seconds", [3600, 86400])
def test_doubling_keeps_what_the_pass_keeps(events, seconds):
    plain = lambda df: sorted(map(str, df.collect()))
    want = plain(spaced_events(events, ["key", "type"], "at", seconds))
    assert plain(timeline.spaced_by_doubling(events, ["key", "type"], "at", seconds)) == want
    assert plain(timeline.spaced(events, ["key", "type"], "at", seconds, large_key=100)) == want


def test_nothing_is_spaced_to_nothing(events):
    assert timeline.spaced_by_doubling(events.where("id < 0"), ["key"], "at", 5).count() == 0
    assert timeline.spaced(events.where("id < 0"), ["key"], "at", 5).count() == 0


def test_one_key_of_a_million_events(spark):
    n, step = 1_000_000, 5000
    frame = spark.range(n).select("id", F.lit("only").alias("key"), F.timestamp_seconds(F.xxhash64("id") % 5_000_000 + 5_000_000).alias("at"))
    times = np.unique([r.t for r in frame.select(F.unix_seconds("at").alias("t")).distinct().collect()])
    want, last = [], None
    for t in times.tolist():
        if last is None or t - last >= step:
            want.append(t)
            last = t
    got = timeline.spaced(frame, ["key"], "at", step, large_key=100_000)
    assert sorted(r.t for r in got.select(F.unix_seconds("at").alias("t")).collect()) == want
