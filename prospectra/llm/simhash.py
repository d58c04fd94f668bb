"""SimHash near-dedup with pigeonring filtering.

A fingerprint is cut into a ring of TAU + 1 segments. If two fingerprints differ in at most TAU bits, some start on the
ring exists from which every chain of l consecutive segments differs in at most l * TAU / SEGMENTS bits in all. The first
two links of that chain (no bit, then at most one) are an exact key, so candidates meet in small buckets; the remaining
links prune them before the full Hamming check.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, scratch, two_hashes

SEED, SHINGLE, TAU = 42, 4, 4
#: Width of each segment of the ring, from the highest bits down; their sum is 64.
WIDTHS = (13, 13, 13, 13, 12)
SEGMENTS = len(WIDTHS)
#: Fingerprints of a bucket that one task compares; a larger bucket is dealt over pairs of parts.
CELL = 1024
#: Cells of up to so many fingerprints give their linked pairs, larger ones a forest over them.
FEW = 24

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 22


def _shingles(data: bytes, shingle: int):
    """Lists of the shingles of a text, piece by piece; of a text with fewer words, its words."""
    at, words, any_yet = 0, [], False
    while at < len(data):
        stop = len(data)
        if at + PIECE < stop and (space := _SPACE.search(data, at + PIECE)):
            stop = space.start()
        words += data[at:stop].lower().split()  # of bytes: only A-Z, and only the six spaces
        if len(words) >= shingle:
            any_yet = True
            yield list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
            words = words[len(words) - shingle + 1 :]
        at = stop
    if words and not any_yet:
        yield [b" ".join(words)]


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the shingles of a text in UTF-8; zero if it has no word."""
    digest, ones, n = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64), 0
    for grams in _shingles(data or b"", shingle):
        n += len(grams)
        for at in range(0, len(grams), 32768):
            block = np.frombuffer(b"".join([digest(g, SEED) for g in grams[at : at + 32768]]), dtype=np.uint8)
            ones += np.unpackbits(block).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint as a signed long) and ``h1``, ``h2`` (hashes of id and text) of each row."""

    def run(batches):
        for b in batches:
            found = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found), b.column(2), b.column(3)], names=["doc_id", "fp", "h1", "h2"])

    h1, h2 = two_hashes(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), h1.alias("h1"), h2.alias("h2"))
    return rows.mapInArrow(run, "doc_id long, fp long, h1 long, h2 long")


def _segments(fp):
    """The segments of unsigned fingerprints, each as an unsigned number."""
    out, shift = [], 64
    for w in WIDTHS:
        shift -= w
        out.append((fp >> np.uint64(shift)) & np.uint64((1 << w) - 1))
    return out


def ring_keys(fp: np.ndarray) -> np.ndarray:
    """Bucket keys, a row for each fingerprint: start segment whole, next segment with one bit masked.

    Two fingerprints whose start segments agree and whose next segments differ in one bit at most share a key.
    """
    parts, keys = _segments(fp), []
    for i in range(SEGMENTS):
        w, follower = WIDTHS[(i + 1) % SEGMENTS], parts[(i + 1) % SEGMENTS]
        for bit in range(w):
            masked = follower & ~np.uint64(1 << bit)
            keys.append(np.uint64(i * 16 + bit) << np.uint64(32) | parts[i] << np.uint64(16) | masked)
    return np.stack(keys, axis=1) if len(fp) else np.zeros((0, sum(WIDTHS)), dtype=np.uint64)


def ring_filter(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a chain exists whose cumulative differences stay within l * TAU / SEGMENTS for each length l."""
    diffs = [np.bitwise_count(x ^ y) for x, y in zip(_segments(a), _segments(b), strict=True)]
    found = np.zeros(a.shape, dtype=bool)
    for i in range(SEGMENTS):
        total, fits = np.zeros(a.shape, dtype=np.int16), np.ones(a.shape, dtype=bool)
        for length in range(1, SEGMENTS + 1):
            total = total + diffs[(i + length - 1) % SEGMENTS]
            fits &= SEGMENTS * total <= length * TAU
        found |= fits
    return found


def within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places at which unsigned fingerprints differ in TAU bits at most: the ring prunes, the Hamming check decides."""
    near = np.flatnonzero(ring_filter(a, b))
    return near[np.bitwise_count(a[near] ^ b[near]) <= TAU]


def _forest(left: np.ndarray, right: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Edges that connect what is linked within a cell: fewer than it has members."""
    nodes = left if same else np.concatenate([left, right])
    label, edges = np.arange(len(nodes)), []
    for i in range(len(left)):
        first = i + 1 if same else len(left)
        others = nodes[first:]
        near = within(np.broadcast_to(left[i], others.shape), others) + first
        for found in np.unique(label[near]):
            if found != label[i]:
                edges.append((i, int(near[np.flatnonzero(label[near] == found)[0]])))
                label[label == found] = label[i]
    return [(int(nodes[i]), int(nodes[j])) for i, j in edges]


def _pairs(cells: np.ndarray) -> np.ndarray:
    """Linked pairs within the rows of ``cells``, each pair once."""
    i, j = np.triu_indices(cells.shape[1], 1)
    a, b = cells[:, i].ravel(), cells[:, j].ravel()
    near = within(a, b)
    return np.unique(np.stack([a[near], b[near]], axis=1), axis=0)


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` that join all distinct fingerprints (column ``fp``) within TAU bits, not each pair of them."""

    def keys(batches):
        for b in batches:
            fp = np.asarray(b.column(0)).astype(np.int64)
            found = ring_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(found.ravel().view(np.int64)), pa.array(np.repeat(fp, found.shape[1]))], names=["key", "fp"])

    def compare(batches):
        for batch in batches:
            found, (left, right, same) = [], batch.columns
            ends, values = left.offsets.to_numpy(), left.values.to_numpy().view(np.uint64)
            sizes, alone = np.diff(ends), right.is_null().to_numpy(zero_copy_only=False)
            for n in np.unique(sizes[alone & (sizes <= FEW)]):
                starts = ends[:-1][alone & (sizes == n)]
                for at in range(0, len(starts), 4096):
                    found.append(_pairs(values[starts[at : at + 4096, None] + np.arange(n)]))
            for k in np.flatnonzero(~(alone & (sizes <= FEW))):
                x = values[ends[k] : ends[k + 1]]
                y = np.array(right[k].as_py() or [], dtype=np.int64).view(np.uint64)
                if edges := _forest(x, y, same[k].as_py()):
                    found.append(np.array(edges, dtype=np.uint64))
            edges = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, k].view(np.int64)) for k in (0, 1)], names=["a", "b"])

    spark = distinct.sparkSession  # a small file of fingerprints has few partitions, each of which grows 64-fold
    spread = distinct.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "fp").mapInArrow(keys, "key long, fp long")
    sizes = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # Spark takes the keys, 64 a fingerprint, for no more than their input and would broadcast them
    held = spread.join(sizes.hint("merge"), "key")
    small = (
        held.where(F.col("n") <= CELL)
        .groupBy("key")
        .agg(F.collect_list("fp").alias("l"))
        .select("l", F.lit(None).cast("array<long>").alias("r"), F.lit(True).alias("same"))
    )
    parts = F.ceil(F.col("n") / (CELL // 2)).cast("int")
    large = (
        held.where(F.col("n") > CELL)
        .withColumn("mine", F.pmod(F.xxhash64("fp"), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("key", "fp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine")
        .groupBy("key", "i", "j")
        .agg(F.collect_list(F.when(F.col("mine") == F.col("i"), F.col("fp"))).alias("l"), F.collect_list(F.when(F.col("mine") != F.col("i"), F.col("fp"))).alias("r"), (F.first("i") == F.first("j")).alias("same"))
        .select("l", "r", "same")
    )
    return small.unionByName(large).mapInArrow(compare, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp``, ``h1``, ``h2`` of each row, with ``root``, the fingerprint that stands for its group."""
    fps = scratch(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = scratch(fps.select("fp").distinct(), "distinct-fp")
    roots = connected_components(link_fingerprints(distinct)).select(F.col("node").alias("fp"), "component")
    table = distinct.join(roots, "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"))
    return scratch(fps.join(table, "fp"), "simhash-groups")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``doc_id``, ``fp`` and ``component_id``, a row for each row of ``docs``.

    Component: the smallest id reachable over links of TAU bits or fewer, the row itself included. A null text counts as
    empty; texts without a word share fingerprint zero and link like any other; rows with a null id take part and get the
    smallest id that is not null (null if there is none); repeated rows get the same component; an empty table gives an
    empty result; columns other than the id and the text are not read.
    """
    groups = simhash_groups(docs, id_col, text_col)
    lowest = groups.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return groups.join(lowest, "root").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates stays, with all its columns: the one with the smallest id.

    A row without an id stays only where its group has no other; of rows that repeat id and text, one stays.
    """
    groups = simhash_groups(docs)
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")).alias("best")).select("best.h1", "best.h2")
    h1, h2 = two_hashes(F.col("doc_id"), F.col("text"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), h1.alias("h1"), h2.alias("h2"))
    return keyed.join(best, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]).select("row.*")


def op3_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
