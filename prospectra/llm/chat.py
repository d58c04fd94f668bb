"""Chat formatting by columnar byte assembly.

A conversation is rendered turn by turn as ``<s>[ROLE:role] text </s>``. Control strings inside roles and texts are
escaped: a backslash goes before each of ``\\ < [ ]``, so that no unescaped bracket in a text can be taken for a mark and
the text can be read back exactly. The bytes of a batch are laid out in one preallocated buffer from segment lengths,
cumulative offsets and scatter indices.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = ord("\\")
SPECIAL = np.zeros(256, dtype=bool)
SPECIAL[[ESCAPE, ord("<"), ord("["), ord("]")]] = True
OPEN, MIDDLE, CLOSE = b"<s>[ROLE:", b"] ", b" </s>"
#: The role whose texts carry loss.
LOSS_ROLE = "assistant"

FORMATTED = "conv_id long, part int, n_turns long, formatted binary, loss_starts array<int>, loss_lengths array<int>"


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column, nulls as empty, and each value's length."""
    column = pc.fill_null(column.cast(pa.binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, np.diff(offsets).astype(np.int64)


def _escaped(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same values with an escape byte before each special byte."""
    special = SPECIAL[data]
    width = 1 + special.astype(np.int64)
    place = np.cumsum(width) - 1  # of each byte's own copy
    out = np.empty(int(width.sum()), dtype=np.uint8)
    out[place] = data
    out[place[special] - 1] = ESCAPE
    ends = np.concatenate([[0], np.cumsum(width)])[np.cumsum(lengths)]
    return out, np.diff(np.concatenate([[0], ends]))


def _scatter(buffer: np.ndarray, starts: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> None:
    """Copy consecutive values of ``data`` to their starts in ``buffer``."""
    ends = np.cumsum(lengths)
    buffer[np.repeat(starts - (ends - lengths), lengths) + np.arange(len(data))] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all turns, one after another; each turn's length; where in its turn the text starts, and its length."""
    role, role_n = _escaped(*_bytes_of(roles))
    text, text_n = _escaped(*_bytes_of(texts))
    total = len(OPEN) + role_n + len(MIDDLE) + text_n + len(CLOSE)
    start = np.cumsum(total) - total
    buffer = np.empty(int(total.sum()), dtype=np.uint8)
    for fixed, at in ((OPEN, start), (MIDDLE, start + len(OPEN) + role_n), (CLOSE, start + total - len(CLOSE))):
        buffer[at[:, None] + np.arange(len(fixed))] = np.frombuffer(fixed, dtype=np.uint8)
    _scatter(buffer, start + len(OPEN), role, role_n)
    text_at = len(OPEN) + role_n + len(MIDDLE)
    _scatter(buffer, start + text_at, text, text_n)
    return buffer, total, text_at, text_n


def format_chat(turns: DataFrame) -> DataFrame:
    """Conversations in order, each in one or more parts of whole turns: their bytes, and the runs of bytes under the loss mask.

    Rows are ordered by turn, then role and text; a null text or role is empty; a null turn comes first; rows with a null
    ``conv_id`` form one conversation; repeated rows are turns of their own; an empty table gives no conversation; other
    columns are not read. A conversation's parts stand in order in one partition, so that no task ever holds all of one.
    """

    def run(batches):
        last, part = object(), 0
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_pylist()
            first = np.array([0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1])])
            stop = np.append(first[1:], len(ids))
            buffer, total, text_at, text_n = assemble(b.column(1), b.column(2))
            ends = np.concatenate([[0], np.cumsum(total)])
            loss = pc.fill_null(pc.equal(b.column(1), LOSS_ROLE), False).to_numpy(zero_copy_only=False)
            parts = []
            for a in first:
                part = part + 1 if ids[a] == last else 0
                last = ids[a]
                parts.append(part)
            owner = np.repeat(np.arange(len(first)), stop - first)
            in_part = ends[:-1] - ends[first][owner] + text_at
            per = np.concatenate([[0], np.cumsum(np.bincount(owner[loss], minlength=len(first)))]).astype(np.int32)
            formatted = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.append(ends[first], ends[-1]).astype(np.int32)), pa.py_buffer(buffer)])
            lists = [pa.ListArray.from_arrays(per, pa.array(x[loss], pa.int32())) for x in (in_part, text_n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[a] for a in first], pa.int64()), pa.array(parts, pa.int32()), pa.array(stop - first), formatted, *lists],
                names=["conv_id", "part", "n_turns", "formatted", "loss_starts", "loss_lengths"],
            )

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "turn")
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return placed.mapInArrow(run, FORMATTED)


def _unescape(data: bytes) -> bytes:
    if b"\\" not in data:
        return data
    x = np.frombuffer(data, dtype=np.uint8)
    slash = x == ESCAPE
    at = np.arange(len(x))
    run_start = np.maximum.accumulate(np.where(~slash, at + 1, 0))  # first place of the run of slashes that a place is in
    mark = slash & ((at - run_start) % 2 == 0)
    return x[~mark].tobytes()


def parse(data: bytes) -> list[tuple[bytes, bytes]]:
    """Roles and texts of formatted turns, read back from their marks alone."""
    turns, at = [], 0

    def find(mark: bytes, at: int) -> int:
        while True:
            at = data.index(mark, at)
            back = at
            while data[back - 1] == ESCAPE:
                back -= 1
            if (at - back) % 2 == 0:
                return at
            at += 1

    while at < len(data):
        if data[at : at + len(OPEN)] != OPEN:
            raise ValueError("not a formatted conversation")
        role = at + len(OPEN)
        middle = find(MIDDLE[:1], role)
        text = middle + len(MIDDLE)
        # the mark's "<" is the first one that no backslash escapes; the space before it belongs to the mark
        close = find(CLOSE[1:2], text) - 1
        turns.append((_unescape(data[role:middle]), _unescape(data[text:close])))
        at = close + len(CLOSE)
    return turns


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation with the digests of what is read back from its formatted parts, taken as they stream by."""

    def run(batches):
        state = None

        def row(s):
            return {"conv_id": s[0], "n_turns": s[1], "turns_sha256": s[2].hexdigest(), "loss_chars": s[3], "loss_sha256": s[4].hexdigest(), "formatted_chars": s[5]}

        for b in batches:
            out = []
            for conv, part, data, starts, lengths in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True):
                if part == 0:
                    if state:
                        out.append(row(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(data):
                    state[1] += 1
                    state[2].update(role + b"\n" + text + b"\n")
                for at, n in zip(starts, lengths, strict=True):
                    text = _unescape(data[at : at + n])
                    state[3] += len(text.decode())
                    state[4].update(text)
                state[5] += len(data.decode())
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if state:
            yield pa.RecordBatch.from_pylist([row(state)], schema=schema)

    kinds = {"long": pa.int64(), "string": pa.string()}
    columns = {"conv_id": "long", "n_turns": "long", "turns_sha256": "string", "loss_chars": "long", "loss_sha256": "string", "formatted_chars": "long"}
    schema = pa.schema([(k, kinds[v]) for k, v in columns.items()])
    return formatted.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in columns.items()))


def op7_chat_formatting(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], turns.schema)
    return digests(format_chat(turns.unionByName(extra)))
