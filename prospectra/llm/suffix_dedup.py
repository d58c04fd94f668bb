"""Removal of repeated substrings: names of sampled suffixes, brought together and compared.

Every byte of a text starts a suffix, and a byte goes if it lies in a string of LENGTH bytes that starts anywhere else
too. Two forms give the same result:

``sorted_repeats`` is the distributed difference-cover algorithm: triples at the positions that are 1 or 2 modulo 3 are
sorted and ranked, the ranks are named again by sorted triples until a name covers 243 bytes, the other suffixes are
merged in by the byte before a named suffix, and neighbours in the sorted order are compared. It sorts a row for two of
three bytes eight times.

``remove_repeats`` does not sort suffixes. Its cover is defined by content: positions chosen by their surroundings alone,
so that equal strings are sampled at equal places and each string of LENGTH bytes holds a sampled position at a safe
distance from its ends. Names are hashes of triples of names, computed where the text lies, and equal names meet by
``groupBy``. What is taken as equal agrees in two independent 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, release_shuffles, scratch, slices, two_hashes

LENGTH = 400
#: A position is sampled if its 27-byte name is lowest in some window of so many positions.
WINDOW = 64
#: What follows a sampled position in every string of LENGTH bytes whose first window it leads.
CORE = LENGTH - WINDOW + 1
#: Bytes that are named at a time, and bytes of texts that a task takes at a time.
PIECE, SLICE_BYTES = 1 << 19, 4 << 20
#: A group of more than one COMMON-th of all grouped rows is dealt over so many PARTS; there are fewer than COMMON of them.
COMMON, PARTS = 2048, 128
TRIPLES = (1, 3, 9, 27, 81)
SAMPLED, COVER = 27, 243

_BYTE = np.random.default_rng(400).integers(1, 1 << 63, 256, dtype=np.int64).view(np.uint64)
_SECOND = np.random.default_rng(800).integers(1, 1 << 63, 256, dtype=np.int64).view(np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 5
_UNBASE = pow(_BASE, -1, 1 << 64)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _name(*parts) -> np.ndarray:
    """Name of a pair or triple of names."""
    t = parts[0] * _ODD[0]
    for p, odd in zip(parts[1:], _ODD[1:], strict=False):
        t ^= t >> np.uint64(31)
        t += p * odd
    t ^= t >> np.uint64(29)
    t *= _ODD[3]
    t ^= t >> np.uint64(32)
    return t


def _names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the SAMPLED and of the COVER bytes from each position on, by naming triples of names again and again."""
    now, sampled = _BYTE[data], None
    for size in TRIPLES:
        if size == SAMPLED:
            sampled = now
        n = max(0, len(now) - 2 * size)
        now = _name(now[:n], now[size : size + n], now[2 * size : 2 * size + n])
    return sampled, now


def _span_name(cover: np.ndarray, at: np.ndarray, length) -> np.ndarray:
    """Name of ``length`` bytes, COVER to twice COVER, from each place on."""
    return _name(cover[at], cover[at + (length - COVER)])


def _leaders(sampled: np.ndarray) -> np.ndarray:
    """Place of the lowest name in the WINDOW positions from each position on, the last of equal ones."""
    places = np.arange(len(sampled), dtype=np.uint64)
    low = np.uint64(0xFFFFFFFF)
    best = (sampled & ~low) | (low - places)
    size = 1
    while size < WINDOW:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    return (low - (best & low)).astype(np.int64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Spans:
    """Second names of any stretch of a piece: a polynomial over the bytes, from prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.before = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_SECOND[data] * _powers(_BASE, n), out=self.before[1:])
        self.undo = _powers(_UNBASE, n)

    def name(self, at: np.ndarray, length) -> np.ndarray:
        t = (self.before[at + length] - self.before[at]) * self.undo[at]
        t ^= t >> np.uint64(32)
        return t * _ODD[1]


def sampled_positions(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, piece: int = PIECE, only_core: bool = False):
    """Of texts that lie one after another in ``data``: sampled places, the first and last start that each leads, and their names.

    Yields arrays (place, first, last, core, context); a start is a place at which a string of LENGTH bytes begins. The
    name of the core and that of the context, which holds the core, are independent. With ``only_core`` the latter is None.
    """
    edges = np.zeros(len(data) + 1, dtype=np.int8)
    long = sizes >= LENGTH
    np.add.at(edges, starts[long], 1)
    np.add.at(edges, starts[long] + sizes[long] - LENGTH + 1, -1)
    begins = np.cumsum(edges[:-1], dtype=np.int8) > 0
    for p0 in range(0, len(data), piece):
        base = max(0, p0 - WINDOW + 1)
        part = data[base : p0 + piece + LENGTH]
        if len(part) < LENGTH:
            continue
        sampled, cover = _names(part)
        lead = _leaders(sampled)
        at = np.flatnonzero(begins[base : base + len(part) - LENGTH + 1])
        lead = lead[at]
        new = np.concatenate([[True], (lead[1:] != lead[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, dtype=bool)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(at)) - 1
        place, first, last = lead[head], at[head], at[tail]
        own = (place + base >= p0) & (place + base < p0 + piece)
        place, first, last = place[own], first[own], last[own]
        core, context = _span_name(cover, place, CORE), None
        if not only_core:
            span = (place - first).astype(np.uint64) * np.uint64(LENGTH) + (last - first).astype(np.uint64)
            context = _name(_Spans(part).name(first, last - first + LENGTH), span)
        yield place + base, first + base, last + base, core, context


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a binary column without nulls, and each value's start and size."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[:-1] - offsets[0], np.diff(offsets)


def _positions(texts: DataFrame, only_core: bool, piece: int) -> DataFrame:
    """Sampled positions of all texts: the name of their core, or also of their context, the text's keys, and their starts."""
    names = ["core"] if only_core else ["core", "context", "h1", "h2", "first", "last"]

    def run(batches):
        for b in slices(batches, SLICE_BYTES):
            data, starts, sizes = _texts(b.column(2))
            for place, first, last, core, context in sampled_positions(data, starts, sizes, piece, only_core):
                columns = [pa.array(core.view(np.int64))]
                if not only_core:
                    of = np.searchsorted(starts, place, side="right") - 1
                    columns += [pa.array(context.view(np.int64)), b.column(0).take(pa.array(of)), b.column(1).take(pa.array(of))]
                    columns += [pa.array((x - starts[of]).astype(np.int32)) for x in (first, last)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.mapInArrow(run, "core long" if only_core else "core long, context long, h1 long, h2 int, first int, last int")


def _keyed(docs: DataFrame) -> tuple[Column, Column]:
    h1, h2 = two_hashes(F.col("doc_id"), F.col("text"))
    return h1.alias("h1"), F.shiftright(h2, 32).cast("int").alias("h2")


def _meet(rows: DataFrame, groups: DataFrame, keys: list[str], deal: list[str], how: str = "inner") -> DataFrame:
    """Join of ``rows`` with ``groups``, a table of the keys and their number of rows ``n``; rows of a common group are dealt over parts by ``deal``."""
    limit = (groups.agg(F.sum("n")).first()[0] or 0) // COMMON
    common = groups.where(F.col("n") > limit).select(*keys, F.lit(True).alias("common"))
    part = F.when(F.col("common"), F.pmod(F.xxhash64(*deal), F.lit(PARTS)).cast("int")).otherwise(0)
    dealt = rows.join(F.broadcast(common), keys, "left").withColumn("part", part).drop("common")
    places = F.when(F.col("n") > limit, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(groups.withColumn("part", F.explode(places)), [*keys, "part"], how).drop("part")


def repeated_starts(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """Starts of repeated strings of LENGTH bytes: ``h1``, ``h2`` (keys of id and text) and arrays ``first``, ``last``, ``single``.

    A sampled position whose core occurs once leads no repeated string. Where its whole context occurs again, all starts
    that it leads repeat. Only for the rest, at the edges of repeated passages, is each start named and counted, against
    the others and one position of each repeated context with the same core.
    """
    spark = docs.sparkSession
    texts = docs.where(F.octet_length("text") >= LENGTH).select(*_keyed(docs), F.col("text").cast("binary").alias("text"))
    shared = scratch(_positions(texts, True, piece).groupBy("core").agg(F.count("*").alias("n")).where("n > 1"), "shared-cores")
    release_shuffles(spark)
    found = scratch(_meet(_positions(texts, False, piece), shared, ["core"], ["h1", "first"]).drop("n"), "shared-positions")
    forget(shared)
    release_shuffles(spark)
    whole = scratch(found.groupBy("core", "context").agg(F.count("*").alias("n")).where("n > 1"), "whole-contexts")
    runs = _meet(found, whole, ["core", "context"], ["h1", "first"], "left")
    runs = scratch(runs.select("core", "context", "h1", "h2", "first", "last", F.col("n").isNotNull().alias("whole")), "position-runs")
    forget(found)
    forget(whole)
    # a start at an edge can repeat one within a whole context: of each such context, one position is named too
    edges = runs.where("not whole").select("core", "h1", "h2", "first", "last")
    inner = runs.where("whole").groupBy("core", "context").agg(F.min(F.struct("h1", "h2", "first", "last")).alias("one"))
    inner = inner.join(edges.select("core").distinct(), "core", "left_semi").select("one.*")
    edges = edges.drop("core").unionByName(inner).groupBy("h1", "h2").agg(F.collect_set(F.struct("first", "last")).alias("runs"))

    def name_starts(batches):
        for b in slices(batches, SLICE_BYTES):
            data, starts, _ = _texts(b.column(2))
            lists = b.column(3)
            of = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            runs = lists.flatten()
            first, last = (runs.field(k).to_numpy().astype(np.int64) + starts[of] for k in ("first", "last"))
            for p0 in range(0, len(data), piece):
                a, z = np.maximum(first, p0), np.minimum(last, p0 + piece - 1)
                some = np.flatnonzero(a <= z)
                if len(some):
                    part = data[p0 : p0 + piece + LENGTH]
                    a, size = a[some] - p0, z[some] - a[some] + 1
                    at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    doc = np.repeat(of[some], size)
                    names = _span_name(_names(part)[1], at, LENGTH), _Spans(part).name(at, LENGTH)
                    rows = pa.array(doc)
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(x.view(np.int64)) for x in names), b.column(0).take(rows), b.column(1).take(rows), pa.array((at + p0 - starts[doc]).astype(np.int32))],
                        names=["name", "name2", "h1", "h2", "start"],
                    )

    named = texts.dropDuplicates(["h1", "h2"]).join(edges, ["h1", "h2"]).select("h1", "h2", "text", "runs")
    named = scratch(named.mapInArrow(name_starts, "name long, name2 long, h1 long, h2 int, start int"), "edge-starts")
    release_shuffles(spark)
    repeated = scratch(named.groupBy("name", "name2").agg(F.count("*").alias("n")).where("n > 1"), "repeated-starts")
    single = _meet(named, repeated, ["name", "name2"], ["h1", "start"]).groupBy("h1", "h2").agg(F.collect_list("start").alias("single"))
    spans = runs.where("whole").groupBy("h1", "h2").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))
    out = scratch(spans.join(single, ["h1", "h2"], "full"), "starts-by-text")
    forget(runs)
    forget(named)
    forget(repeated)
    return out


def _merged(first: np.ndarray, last: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs [a, z) of bytes that strings starting at first..last cover, and the text that each lies in."""
    order = np.argsort(first, kind="stable")
    a, z, doc = first[order], last[order] + LENGTH, doc[order]
    reach = np.maximum.accumulate(z)  # texts lie one after another, so no string of an earlier text reaches into a later one
    head = np.flatnonzero(np.concatenate([[True], (a[1:] > reach[:-1]) | (doc[1:] != doc[:-1])])) if len(a) else np.zeros(0, dtype=np.int64)
    return a[head], reach[np.append(head[1:], len(a)) - 1] if len(a) else a, doc[head]


def remove_repeats(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """All rows and columns of ``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes that stay.

    Each byte goes that lies in a string of LENGTH bytes which starts anywhere else, judged on the input. A null text
    counts as empty; matches never cross texts; repeated rows repeat each other; an empty table stays empty. Columns with
    one of the four names are replaced. ``piece`` bytes are named at a time.
    """
    keep = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept")]
    starts = repeated_starts(docs, piece)
    release_shuffles(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes")
    rows = docs.select(*_keyed(docs), text, F.struct(*(c for c in keep if c != "text")).alias("row")).join(starts, ["h1", "h2"], "left").drop("h1", "h2")
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches):
        for b in slices(batches, SLICE_BYTES):
            data, starts, sizes = _texts(b.column(0))
            found = []
            for first, last in ((2, 3), (4, 4)):
                of = np.repeat(np.arange(b.num_rows), b.column(first).value_lengths().fill_null(0).to_numpy())
                found.append([*(b.column(c).flatten().to_numpy().astype(np.int64) + starts[of] for c in (first, last)), of])
            a, z, doc = _merged(*(np.concatenate(x) for x in zip(*found, strict=True)))
            change = np.zeros(len(data) + 1, dtype=np.int8)
            change[a] += 1
            change[z] -= 1
            removed = np.bincount(doc, weights=z - a, minlength=b.num_rows).astype(np.int64)
            kept_at = np.concatenate([[0], np.cumsum(sizes - removed)]).astype(np.int32)
            data = data[np.cumsum(change[:-1], dtype=np.int8) == 0]
            kept = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(kept_at), pa.py_buffer(np.ascontiguousarray(data))])
            spans = np.bincount(doc, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(sizes), pa.array(removed), pa.array(spans), kept, b.column(0)], names=["row", "n_bytes", "n_removed", "n_spans", "kept", "bytes"])

    done = rows.select("bytes", "row", "first", "last", "single").mapInArrow(run, f"row {kind}, n_bytes long, n_removed long, n_spans long, kept binary, bytes binary")
    return done.select(*(F.col("bytes").cast("string").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in keep), "n_bytes", "n_removed", "n_spans", "kept")


def _ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``name``, the rank of their keys among the sorted distinct keys, from 1."""
    spread = rows.select(*keys).distinct().repartitionByRange(*keys).withColumn("part", F.spark_partition_id())
    spread = scratch(spread.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(*keys))), "sorted-triples")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sizes = spread.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    names = spread.join(F.broadcast(sizes), "part").select(*keys, (F.col("base") + F.col("at")).alias("name"))
    return rows.join(names, keys).drop(*keys)


def sorted_repeats(docs: DataFrame) -> DataFrame:
    """``h1``, ``h2`` (keys of id and text) and ``start`` of each string of LENGTH bytes that starts anywhere else too.

    The difference-cover algorithm over every byte: exact, and for corpora of which eight sorts of all positions are
    affordable. Repeated rows repeat each other; null and short texts have no start; an empty table gives none.
    """
    copy = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.lit(0)))
    texts = docs.where(F.octet_length("text") >= LENGTH).select(*_keyed(docs), F.col("text").cast("binary").alias("text")).withColumn("copy", copy)
    one = F.conv(F.hex(F.substring(F.col("text"), F.col("pos") + 1, F.lit(1))), 16, 10).cast("long")
    text = ["h1", "h2", "copy"]
    chars = texts.withColumn("pos", F.explode(F.sequence(F.lit(0), F.octet_length("text") - 1))).select(*text, "pos", (one + 1).alias("c"))
    along = Window.partitionBy(*text).orderBy("pos")
    ahead = lambda c, n: F.lead(c, n, 0).over(along)
    chars = scratch(chars.select(*text, "pos", F.col("c").alias("x"), ahead("c", 1).alias("y"), ahead("c", 2).alias("z")), "bytes")
    names = scratch(_ranked(chars.where("pos % 3 > 0"), ["x", "y", "z"]), "names-3")
    for size in (3, 9, 27, 81):  # in the order of the sampled positions, size bytes are two thirds as many places
        step = size * 2 // 3
        names = scratch(_ranked(names.select(*text, "pos", F.col("name").alias("x"), ahead("name", step).alias("y"), ahead("name", 2 * step).alias("z")), ["x", "y", "z"]), f"names-{3 * size}")
    every = chars.select(*text, "pos", F.col("x").alias("c")).join(names, [*text, "pos"], "left")
    whole = F.max("pos").over(Window.partitionBy(*text)) - LENGTH + 1
    pair = lambda n: ahead("c", n) * 512 + ahead("c", n + 1)
    forms = {1: ("name", ahead("name", 156), ahead("c", 399)), 2: ("c", ahead("name", 1), ahead("name", 157)), 0: (pair(0), ahead("name", 2), ahead("name", 155), pair(398))}
    keyed = scratch(every.select(*text, "pos", whole.alias("stop"), *(F.struct(*(F.expr(v) if isinstance(v, str) else v for v in f)).alias(f"form{k}") for k, f in forms.items())).where("pos <= stop"), "suffixes")
    found = []
    for k, classes in {1: (1, 2), 2: (0, 1), 0: (0, 2)}.items():
        suffixes = keyed.where((F.col("pos") % 3).isin(*classes)).select("h1", "h2", F.col("pos").alias("start"), F.col(f"form{k}").alias("form"))
        near = Window.partitionBy("part").orderBy("form")
        suffixes = suffixes.repartitionByRange("form").withColumn("part", F.spark_partition_id())
        same = F.col("form").eqNullSafe(F.lag("form").over(near)) | F.col("form").eqNullSafe(F.lead("form").over(near))
        found.append(suffixes.withColumn("same", same).where("same").select("h1", "h2", "start"))
    return found[0].unionByName(found[1]).unionByName(found[2]).distinct()


def op9_difference_cover_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
