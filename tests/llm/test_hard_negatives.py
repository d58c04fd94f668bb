"""Hard negatives against a plain search over all pairs, and the norm-pruned index against a matrix product."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prospectra.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score string"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def expected(rows):
    good = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        good.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [int(np.floor(256 * x)) for x in v]))
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    key = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for n, (i, label, v) in enumerate(good):
        if i is None or i % 50:
            continue
        scores = [(score(v, w), j, other != label, m) for m, (j, other, w) in enumerate(good)]
        positives = sorted((s for s in scores if not s[2] and s[3] != n), key=key)[:5]
        negatives = sorted((s for s in scores if s[2]), key=key)
        for p in positives:
            fit = [s for s in negatives if 50 * p[0] <= 100 * s[0] <= 95 * p[0]][:3]
            out += [(i, p[1], r, s[1], p[0], s[0]) for r, s in enumerate(fit, 1)]
    return sorted(out, key=str)


def mined(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in hard_negatives.mine_hard_negatives(hard_negatives.scaled(frame), F.col("vec_id") % 50 == 0).collect()), key=str)


def made(n, width, seed):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((6, width))
    rows = []
    for i in range(n):
        v = centers[i % 6] * (0.2 + i % 3) + rng.standard_normal(width) * 0.6
        rows.append((i, (v / (1 if i % 11 else 40)).tolist(), int(rng.integers(0, 4))))
    return rows


def test_negatives_match_a_plain_search(spark):
    rows = made(420, 12, 1)
    rows += [(1000 + i, rows[3][1], i % 3) for i in range(40)]  # a common vector, ties by id
    rows += [(50, None, 1), (100, rows[0][1], None), (150, [float("nan")] * 12, 1), (200, [None] * 12, 2), (250, [0.0] * 12, 1), (300, [], 1), (350, rows[5][1][:5], 2)]
    rows += [(None, rows[0][1], 0), (None, rows[1][1], 3), (0, rows[0][1], rows[0][2]), (0, rows[0][1], rows[0][2]), (400, [-x for x in rows[0][1]], 1)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5)
    got = mined(frame)
    assert got == expected(rows) and len(got) > 50
    assert mined(frame.where("vec_id < -5")) == []


@pytest.mark.parametrize("ladder", [(), (0.99, 0.97)])
def test_rounds_and_blocks_change_nothing(spark, monkeypatch, ladder):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "ROWS", 50)
    monkeypatch.setattr(hard_negatives, "POSITIVE_LADDER", ladder)
    monkeypatch.setattr(hard_negatives, "NEGATIVE_LADDER", ladder)
    rows = made(400, 9, 2)
    assert mined(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)) == expected(rows)


def test_threshold_pairs_equal_the_product(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(hard_negatives, "GROUP", 4)
    for share in (-1.0, 0.0, 0.2, 0.6, 0.95, 1.5):
        a, x = rng.integers(-90, 90, (30, 17)), rng.integers(-90, 90, (200, 19)) // rng.integers(1, 30, (200, 1))
        x[:5, :17] = a[:5]
        low = (share * np.linalg.norm(a, axis=1) * np.linalg.norm(a, axis=1).mean()).astype(np.int64)
        full = a @ x[:, :17].T
        want = {(i, j, full[i, j]) for i, j in zip(*np.nonzero(full >= low[:, None]), strict=True)}
        assert set(zip(*hard_negatives.threshold_pairs(a, low, x), strict=True)) == want
    big = np.full((2, 3), 2**30)
    assert set(hard_negatives.threshold_pairs(big, np.array([1, 1]), big)[2]) == {3 * 2**60}
    with pytest.raises(OverflowError):
        hard_negatives.threshold_pairs(big * 4, np.array([1, 1]), big * 4)
