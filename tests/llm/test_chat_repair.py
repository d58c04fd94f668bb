"""Conversation repair against a plain search over all edits, and the chunks of long conversations."""

import hashlib
import random
import re
import zlib

import pytest

from prospectra.llm import chat_repair

BLANK = " \t\n\v\f\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        part = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if part == 0:
            continue
        text = "" if part == 1 else re.sub("[.!?]", "", text) if part == 2 else text
        out += [(conv, turn, "user" if part == 4 else role, text)] * (2 if part == 3 else 1)
    return out


def cheapest(rows):
    """Audit, cost and repaired rows, by keeping the best (cost, audit) of every state, forward."""
    best = {0: (0, "", [])}

    def better(into, state, cost, audit, out):
        if state not in into or (cost, audit) < into[state][:2]:
            into[state] = (cost, audit, out)

    def with_inserts(now):
        now = dict(now)
        for _ in range(2):
            for s, (c, a, o) in list(now.items()):
                role = "assistant" if s == 2 else "user"
                better(now, 3 if s == 2 else 2, c + 5, a + "I", [*o, f"{role}:"])
        return now

    for role, text, must_go, cut in rows:
        after = {}
        for s, (c, a, o) in with_inserts(best).items():
            better(after, s, c + 2, a + "D", o)
            if not must_go:
                extra, fit, to = 5 * cut, "assistant" if s == 2 else "user", 3 if s == 2 else 2
                better(after, to, c + extra + 1, a + "R", [*o, f"{fit}:{text}"])
                if s == 0 and role[:1] == "s":
                    better(after, 1, c + extra, a + "K", [*o, f"{role}:{text}"])
                if role[:1] == fit[0]:
                    better(after, to, c + extra, a + "K", [*o, f"{role}:{text}"])
        best = after
    return min(best[s] if s in best else (10**9, "", []) for s in (0, 3)) if not rows else min(v for s, v in with_inserts(best).items() if s in (0, 3))


def expected(rows):
    """Digest row of one conversation's damaged rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))
    seen, faults, steps = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, _, role, text in rows:
        bare = text.strip(BLANK)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        steps.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    turns = [r[1] for r in rows if r[1] is not None]
    cost, audit, repaired = cheapest(steps)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())


def result(frame):
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[c] for c in columns) for r in frame.collect()}


def made(seed, conversations, most):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(conversations)]:
        for turn in sorted(rng.sample(range(-2, most + 4), rng.randint(1, most))):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "ustad", "", None])
            rows.append((conv, turn, role, rng.choice(["One.", "Two!", "No stop", "", " \n", "x?  ", "Stop. not", None, f"row {turn}."])))
    return rows


def test_repairs_match_a_plain_search(spark):
    rows = made(1, 300, 12) + [(7001, None, "user", "No turn here."), (7001, 3, "assistant", "Yes."), (7002, None, "user", "Only one"), (7003, 1, "user", "long " * 60_000)]
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, copies_of string, kind int").repartition(5)
    got = result(chat_repair.digest_repairs(chat_repair.repair_conversations(chat_repair.damage(frame), frame.select("conv_id"))))
    after = damaged(rows)
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        assert got[conv] == expected([r for r in after if r[0] == conv]), conv


@pytest.mark.parametrize("chunk", [1, 3, 50])
def test_long_conversations_are_cut_into_chunks(spark, monkeypatch, chunk):
    rows = [r for r in made(chunk, 4, 90)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chunks = chat_repair._chunks
    monkeypatch.setattr(chat_repair, "CHUNK", chunk)
    # the functions travel by reference, so the size goes along in a closure
    monkeypatch.setattr(chat_repair, "_chunks", lambda batches: _with_chunk(chunks, chunk, batches))
    got = result(chat_repair.digest_repairs(chat_repair.repair_conversations(frame, frame.select("conv_id"))))
    for conv in got:
        assert got[conv] == expected([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]), conv


def _with_chunk(chunks, size, batches):
    from prospectra.llm import chat_repair as module

    module.CHUNK = size
    try:
        yield from chunks(batches)
    finally:
        module.CHUNK = 65_536


def test_repeated_rows_and_no_rows(spark):
    rows = [(1, 0, "user", "Hello.")] * 5 + [(1, 1, "assistant", "Hi.")] * 2
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = result(chat_repair.digest_repairs(chat_repair.repair_conversations(frame)))
    assert got[1] == expected(rows) and got[1][6] == "KDDDDKD"
    assert chat_repair.repair_conversations(frame.where("conv_id < 0")).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert result(chat_repair.digest_repairs(chat_repair.repair_conversations(frame.where("conv_id < 0"), frame.select("conv_id")))) == {1: (0, 0, 0, 0, 0, 0, "", empty)}


def test_checkpoints_change_nothing():
    rng = random.Random(9)
    for n in (1, 2, 3, 17, 400):
        kinds = bytes(rng.randrange(16) for _ in range(n))
        letters, _, start = chat_repair.walk(kinds, chat_repair.FINAL, (0, 1, 2, 3))
        costs = chat_repair.matrix(kinds)
        assert start == tuple(min(costs[4 * s + t] + chat_repair.FINAL[t] for t in range(4)) for s in range(4))
        assert all(sum(c != "I" for c in x) == n for x in letters)
