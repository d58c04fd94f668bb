"""Repair of conversation structure by cheapest edits, with a square-root checkpointed dynamic program.

A repaired conversation has the role initials ``(s?(ua)+)?``. Rows are kept (K), given the role that fits (R), deleted (D)
or preceded by rows without text (I). Four states say what may follow: nothing yet (0), after the system row (1), after a
user row (2), after an assistant row (3). The cost to the end from each state is a vector of four numbers a row; backward
vectors are stored only every square root of the rows, and the forward walk recomputes the vectors of one block at a time
while it takes, among the edits that lose nothing, the first in ASCII order.

Long conversations are cut into chunks of rows, which tasks share out: a chunk is a 4 by 4 matrix of costs, the matrices
are multiplied backward (minimum and sum) to give the vector at each chunk's end, each chunk is walked from each state that
may enter it, and the walks are joined forward.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, two_hashes

#: Rows of a chunk. It bounds what a task holds and how many walks are joined; it changes no result.
CHUNK = 65_536
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
NEVER = 1 << 60
#: State after an insertion in each state; the cost to end in each state.
AFTER_INSERT = (2, 2, 3, 2)
FINAL = (0, 2 * INSERT, INSERT, 0)
ROLE_OF = {0: "user", 1: "user", 2: "assistant", 3: "user"}

#: A row's kind: two bits for the role's initial (s, u, a, other), one for "must go", one for "ends without a stop".
MUST_GO, CUT_OFF = 4, 8
INITIALS = {"s": 0, "u": 1, "a": 2}
LEGAL = {"su", "ua", "au"}

BLANK_PATTERN, LAST_CHARACTER = r"[^\x20\x09-\x0D]", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z"
EDITS = "conv_id long, turn long, edit string, role string, text string, copies long, fault string, illegal long"


def _moves(kind: int) -> list[list[tuple[str, int, int]]]:
    """For each state the edits of a row of this kind in ASCII order: letter, cost, next state."""
    out = []
    for state in range(4):
        moves = [("D", DELETE, state)]
        if not kind & MUST_GO:
            extra = TRUNCATED if kind & CUT_OFF else 0
            initial = kind & 3
            if initial == 0 and state == 0:
                moves.append(("K", extra, 1))
            elif (initial == 2) if state == 2 else (initial == 1):
                moves.append(("K", extra, AFTER_INSERT[state]))
            moves.append(("R", REROLE + extra, AFTER_INSERT[state]))
        out.append(moves)
    return out


MOVES = [_moves(kind) for kind in range(16)]


def before(kind: int, after: tuple) -> tuple:
    """Costs to the end before a row of this kind, from those after it."""
    base = [min(cost + after[to] for _, cost, to in moves) for moves in MOVES[kind]]
    two, three = min(base[2], INSERT + base[3]), min(base[3], INSERT + base[2])
    return min(base[0], INSERT + two), min(base[1], INSERT + two), two, three


def matrix(kinds: bytes) -> list[int]:
    """Least cost of a run of rows from each state (rows) to each state (columns), row by row."""
    ends = [tuple(0 if s == t else NEVER for s in range(4)) for t in range(4)]
    for kind in reversed(kinds):
        ends = [before(kind, v) for v in ends]
    return [min(ends[t][s], NEVER) for s in range(4) for t in range(4)]


def walk(kinds: bytes, end: tuple, entries: tuple[int, ...]) -> tuple[list[str | None], list[int], tuple]:
    """Edits of a run of rows from each of the states ``entries``, the states it ends in, and the costs at its start.

    Only one vector in each square root of the rows is stored; those between are recomputed on the way forward.
    """
    n = len(kinds)
    step = isqrt(n) + 1
    checkpoints, v = {}, end
    for i in range(n - 1, -1, -1):
        if (i + 1) % step == 0 or i + 1 == n:
            checkpoints[i + 1] = v
        v = before(kinds[i], v)
    start = v
    letters, now = {s: [] for s in entries}, {s: s for s in entries}
    for a in range(0, n, step):
        b = min(a + step, n)
        block = [checkpoints[b]]
        for i in range(b - 1, a - 1, -1):
            block.append(before(kinds[i], block[-1]))
        block.reverse()
        for s in entries:
            state, out = now[s], letters[s]
            for i in range(a, b):
                here, there, moves = block[i - a], block[i - a + 1], MOVES[kinds[i]]
                while True:
                    goal = here[state]
                    _, cost, to = moves[state][0]
                    if cost + there[to] == goal:
                        out.append("D")
                        break
                    if INSERT + here[AFTER_INSERT[state]] == goal:
                        out.append("I")
                        state = AFTER_INSERT[state]
                        continue
                    letter, _, to = next(m for m in moves[state][1:] if m[1] + there[m[2]] == goal)
                    out.append(letter)
                    state = to
                    break
            now[s] = state
    return ["".join(letters[s]) if s in letters else None for s in range(4)], [now.get(s, s) for s in range(4)], start


def _chunks(batches) -> Iterator[pa.RecordBatch]:
    """Chunks of sorted rows. ``opens`` and ``closes`` say that the conversation surely begins and ends with the chunk."""
    columns = {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "h1": pa.int64(), "h2": pa.int64(), "number": pa.int64(), "kinds": pa.binary(), "opens": pa.bool_(), "closes": pa.bool_(), "costs": pa.list_(pa.int64())}
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 40
    key = None  # of the open chunk's first row
    kinds, opens = bytearray(), False

    def close(done: bool) -> dict:
        whole = opens and done
        return {**dict(zip(columns, key, strict=False)), "number": number, "kinds": bytes(kinds), "opens": opens, "closes": done, "costs": None if whole else matrix(bytes(kinds))}

    for b in batches:
        out = []
        for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "h1", "h2", "kind")), strict=True):
            changes = key is not None and row[0] != key[0]
            if changes or len(kinds) >= CHUNK:
                out.append(close(changes))
                number, kinds, opens, key = number + 1, bytearray(), changes, None
            if key is None:
                key = row[:5]
            kinds.append(row[5])
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(columns))
    if key is not None:
        yield pa.RecordBatch.from_pylist([close(False)], schema=pa.schema(columns))


CHUNKS = "conv_id long, turn long, role string, h1 long, h2 long, number long, kinds binary, opens boolean, closes boolean, costs array<long>"


def _end_costs(batches) -> Iterator[pa.RecordBatch]:
    """Costs to the end after each chunk; the chunks of a conversation come last one first."""
    conv, carry = object(), FINAL
    for b in batches:
        ends = []
        for c, costs in zip(b.column("conv_id").to_pylist(), b.column("costs").to_pylist(), strict=True):
            if c != conv:
                conv, carry = c, FINAL
            ends.append(list(carry))
            if costs:
                carry = tuple(min(costs[4 * s + t] + carry[t] for t in range(4)) for s in range(4))
        yield b.append_column("end_costs", pa.array(ends, pa.list_(pa.int64())))


def _walks(batches) -> Iterator[pa.RecordBatch]:
    for b in batches:
        letters, exits = [], []
        for kinds, opens, end in zip(*(b.column(c).to_pylist() for c in ("kinds", "opens", "end_costs")), strict=True):
            text, last, _ = walk(kinds, tuple(end), (0,) if opens else (0, 1, 2, 3))
            letters.append(text)
            exits.append(last)
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in ("conv_id", "turn", "role", "h1", "h2", "kinds")), pa.array(letters, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int32()))],
            names=["conv_id", "turn", "role", "h1", "h2", "kinds", "letters", "exits"],
        )


class _Editor:
    """Applies the walks of one conversation to its rows as they stream by."""

    def __init__(self, conv):
        self.conv, self.state, self.letters, self.kinds, self.at, self.row = conv, 0, "", b"", 0, 0
        self.last = None  # initial of the last row

    def piece(self, kinds: bytes, letters: list, exits: list) -> None:
        self.kinds, self.letters, self.at, self.row = kinds, letters[self.state], 0, 0

    def _insert(self, turn) -> dict:
        role = ROLE_OF[self.state]
        self.state = AFTER_INSERT[self.state]
        return {"conv_id": self.conv, "turn": turn, "edit": "I", "role": role, "text": "", "copies": 1, "fault": "", "illegal": 0}

    def edit(self, turn, role: str, text: str, copies: int, blank: bool) -> Iterator[dict]:
        kind = self.kinds[self.row]
        self.row += 1
        while self.letters[self.at] == "I":
            self.at += 1
            yield self._insert(turn)
        letter, self.at = self.letters[self.at], self.at + 1
        fault = "blank" if blank else "duplicate" if kind & MUST_GO else "truncated" if kind & CUT_OFF else ""
        illegal = int(self.last is not None and self.last + role[:1] not in LEGAL)
        self.last = role[:1]
        new_role = role
        if letter == "R":
            new_role = ROLE_OF[self.state]
        if letter != "D":
            self.state = 1 if letter == "K" and self.state == 0 and role[:1] == "s" else AFTER_INSERT[self.state]
        yield {"conv_id": self.conv, "turn": turn, "edit": letter, "role": new_role, "text": text, "copies": 1, "fault": fault, "illegal": illegal}
        if copies > 1:
            yield {"conv_id": self.conv, "turn": turn, "edit": "D", "role": role, "text": text, "copies": copies - 1, "fault": "blank" if blank else "duplicate", "illegal": copies - 1}

    def finish(self) -> Iterator[dict]:
        while self.state in (1, 2):
            yield self._insert(None)


def _apply(batches) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in EDITS.split(", "))])
    editor = None
    for b in batches:
        out = []
        for what, conv, turn, role, text, copies, blank, of_rows, letters, exits in zip(*(b.column(c).to_pylist() for c in ("what", "conv_id", "turn", "role", "text", "copies", "blank", "kinds", "letters", "exits")), strict=True):
            if editor is None or conv != editor.conv:
                if editor:
                    out.extend(editor.finish())
                editor = _Editor(conv)
            if what == 0:
                out.append({"conv_id": conv, "turn": None, "edit": "", "role": None, "text": None, "copies": 0, "fault": "", "illegal": 0})
            elif what == 1:
                editor.piece(of_rows, letters, exits)
            else:
                out.extend(editor.edit(turn, role, text, copies, blank))
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if editor:
        yield pa.RecordBatch.from_pylist(list(editor.finish()), schema=schema)


def repair_conversations(rows: DataFrame, conv_ids: DataFrame | None = None) -> DataFrame:
    """Edits in order: ``conv_id, turn, edit, role, text, copies, fault, illegal``; K, R and I rows are the repaired conversation.

    Rows are ordered by turn (nulls first), then role and a hash of the text, so that equal rows stand together. A row
    whose text is blank, or whose role and text came earlier in the conversation, must go. A null role or text is one
    space; rows with a null ``conv_id`` are one conversation; repeated rows are one record with their number in
    ``copies``; no rows give no edits; other columns are not read. ``conv_ids`` names conversations that get a record
    with an empty edit, also where they have no rows. All edits of a conversation stand in order in one partition;
    no task holds more of it than a chunk's letters.
    """
    key = ["conv_id", "turn", "role", "h1", "h2"]
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"), copies.alias("copies"))
    h1, h2 = two_hashes(F.col("role"), F.col("text"))
    stop = F.regexp_extract("text", LAST_CHARACTER, 1)
    whole = scratch(
        plain.groupBy("conv_id", "turn", "role", "text")
        .agg(F.sum("copies").alias("copies"))
        .select("*", h1.alias("h1"), h2.alias("h2"), (~F.col("text").rlike(BLANK_PATTERN)).alias("blank"), (~stop.isin(".", "!", "?")).alias("cut_off")),
        "repair-rows",
    )
    # the first turn of each role and text, joined back on the turn too: a text that fills a conversation is no hot key
    first = whole.groupBy("conv_id", "h1", "h2").agg(F.min("turn").alias("low"), F.max(F.col("turn").isNull()).alias("unknown"))
    joined_on = ("conv_id", "h1", "h2", "turn")
    first = first.withColumn("turn", F.when(~F.col("unknown"), F.col("low"))).select(*(F.col(c).alias(f"first_{c}") for c in joined_on), F.lit(True).alias("first"))
    small = whole.select(*key, "blank", "cut_off")
    same = [F.col(c).eqNullSafe(F.col(f"first_{c}")) for c in joined_on]
    initial = F.substring("role", 1, 1)
    code = F.lit(3)
    for letter, n in INITIALS.items():
        code = F.when(initial == letter, F.lit(n)).otherwise(code)
    must_go = F.col("blank") | F.col("first").isNull()
    kind = code + F.when(must_go, F.lit(MUST_GO)).otherwise(F.when(F.col("cut_off"), F.lit(CUT_OFF)).otherwise(F.lit(0)))
    kinds = scratch(small.join(first, same, "left").select(*key, kind.cast("int").alias("kind")), "repair-kinds")
    chunks = scratch(kinds.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_chunks, CHUNKS), "repair-chunks")
    ends = chunks.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("number")).mapInArrow(_end_costs, CHUNKS + ", end_costs array<long>")
    # by number again: the chunks of one long conversation are walked by many tasks
    pieces = ends.repartition("number").mapInArrow(_walks, "conv_id long, turn long, role string, h1 long, h2 long, kinds binary, letters array<string>, exits array<int>")
    streams = [
        pieces.withColumn("what", F.lit(1)),
        whole.withColumn("what", F.lit(2)),
        *([conv_ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("what", F.lit(0))] if conv_ids is not None else []),
    ]
    joined = streams[0]
    for s in streams[1:]:
        joined = joined.unionByName(s, allowMissingColumns=True)
    return joined.repartition("conv_id").sortWithinPartitions("conv_id", F.col("what") > 0, "turn", "role", "h1", "h2", "what").mapInArrow(_apply, EDITS)


def digest_repairs(edits: DataFrame) -> DataFrame:
    """One row a conversation from its edits: faults, gaps, cost, letters, and the digest of the repaired rows."""
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in counts), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches):
        state = None

        def row(s: dict) -> dict:
            gaps = s["high"] - s["low"] + 1 - s["turns"] if s["turns"] else 0
            return {"conv_id": s["conv_id"], "gaps": gaps, **{c: s[c] for c in counts[1:]}, "audit": "".join(s["audit"]), "repaired_sha256": s["sha"].hexdigest()}

        for b in batches:
            out = []
            for conv, turn, edit, role, text, copies, fault, illegal in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or conv != state["conv_id"]:
                    if state:
                        out.append(row(state))
                    state = {"conv_id": conv, "low": None, "high": None, "turns": 0, **dict.fromkeys(counts[1:], 0), "audit": [], "sha": hashlib.sha256(), "rows": 0}
                if edit and edit != "I" and turn is not None and turn != state["high"]:
                    state["low"] = turn if state["low"] is None else state["low"]
                    state["high"], state["turns"] = turn, state["turns"] + 1
                if fault:
                    state[fault] += copies
                state["illegal"] += illegal
                state["audit"].append(edit * copies)
                state["cost"] += {"": 0, "K": 0, "R": REROLE, "I": INSERT, "D": DELETE}[edit] * copies + (TRUNCATED if fault == "truncated" and edit in "KR" else 0)
                if edit and edit in "KRI":
                    state["sha"].update((b"\n" if state["rows"] else b"") + f"{role}:{text}".encode())
                    state["rows"] += 1
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if state:
            yield pa.RecordBatch.from_pylist([row(state)], schema=schema)

    return edits.mapInArrow(run, "conv_id long, " + ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by the crc32 of ``conv_id:turn``; a null id, turn, role or text is one space there."""
    part: Column = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return (
        rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), part.alias("part"))
        .where("part <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("part") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("part") == 1, "").when(F.col("part") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
            F.when(F.col("part") == 3, 2).otherwise(1).alias("copies"),
        )
    )


def op12_chat_structure_repair(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digest_repairs(repair_conversations(damage(turns), turns.select("conv_id")))
