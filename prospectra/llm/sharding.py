"""Sharding by minimax contiguous partition of ordered atomic groups (native).

Rows with equal text form one atomic group. Groups lie in a fixed order (by text hash); the smallest shard capacity that
a greedy cut can keep is found by binary search, and the cuts are made at that capacity.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, two_hashes

#: Hash ranges in which prefix sums are taken; their totals are the only table that one task adds up.
BUCKETS = 8192
#: A large group of equal texts is dealt over so many parts.
PARTS = 64
#: Rows of the summary that the driver holds in a round of the search.
SUMMARY_ROWS = 8192


class Positions:
    """What is known of the allowed cut positions: disjoint intervals whose two ends are positions, nothing between them."""

    def __init__(self, intervals: list[tuple[int, int]]):
        self.intervals = sorted(intervals)
        self.starts = [x for x, _ in self.intervals]

    def reach(self, target: int) -> tuple[int, int]:
        """Bounds of the largest allowed position up to ``target``."""
        i = bisect_right(self.starts, target) - 1
        if i < 0:
            return 0, 0
        first, last = self.intervals[i]
        return (last, last) if target >= last else (first, target)

    def cuts(self, capacity: int, shards: int, side: int) -> list[int]:
        """Greedy cut positions at this capacity; side 0 is a lower bound of each, side 1 an upper bound."""
        out, at = [], 0
        for _ in range(shards):
            at = max(at, self.reach(at + capacity)[side])
            out.append(at)
        return out

    def smallest(self, total: int, shards: int, side: int) -> int:
        """Smallest capacity whose greedy cuts reach ``total`` by this bound."""
        low, high = -(-total // shards), total
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, side)[-1] >= total:
                high = mid
            else:
                low = mid + 1
        return low


def minimax_cuts(ends: DataFrame, total: int, shards: int) -> list[int]:
    """Cut positions of the minimax partition; ``ends`` has the prefix sum ``cum`` at the end of each group.

    The driver never holds the groups: each round summarises ``ends`` to at most about SUMMARY_ROWS intervals, searches
    the capacity with sure and possible positions, and refines only the intervals in which a cut is still in doubt.
    """
    cum, spans = F.col("cum"), [(1, total)]
    known: list[tuple[int, int]] = []
    while True:
        width = max(1, sum(b - a + 1 for a, b in spans) // SUMMARY_ROWS)
        inside = reduce(lambda x, y: x | y, (cum.between(a, b) for a, b in spans))
        rows = ends.where(inside).groupBy(F.floor(cum / width).alias("block")).agg(F.min("cum").alias("a"), F.max("cum").alias("b")).collect()
        known = [x for x in known if not any(a <= x[0] and x[1] <= b for a, b in spans)] + [(r["a"], r["b"]) for r in rows]
        positions = Positions(known)
        possible, sure = positions.smallest(total, shards, 1), positions.smallest(total, shards, 0)
        low, high = positions.cuts(possible, shards, 0), positions.cuts(sure, shards, 1)
        if possible == sure and low == high:
            return high
        doubt = [x for x in positions.intervals if x[1] > x[0] + 1 and any(a <= x[1] and x[0] <= b for a, b in zip(low, high, strict=True))]
        spans = []
        for a, b in doubt:
            if spans and a <= spans[-1][1] + 1:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
        if not spans:  # every interval in doubt has only its two ends: nothing lies between them
            positions = Positions([(x, x) for a, b in known for x in {a, b}])
            return positions.cuts(positions.smallest(total, shards, 0), shards, 0)


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assign every row to one of ``shards`` contiguous shards of nearly equal bytes; equal texts stay together.

    Size is the UTF-8 bytes of the text plus 1. A null text has size 1 and CRC 0 and forms a group of its own; rows with
    a null id are kept; repeated rows get slots of their own; an empty table gives an empty result. Columns other than
    the id and the text are not read.
    """
    text = F.col(text_col)
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        *(h.alias(n) for h, n in zip(two_hashes(text), ("h1", "h2"), strict=True)),
        F.pmod(F.xxhash64(F.lit("part"), F.col(id_col)), F.lit(PARTS)).cast("int").alias("part"),
    )
    key = ["h1", "h2", "part"]
    bucket = F.shiftrightunsigned("h1", 64 - (BUCKETS.bit_length() - 1)).cast("int")
    order = Window.partitionBy("bucket").orderBy(*key)
    parts = (
        base.groupBy(*key)
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        .withColumn("bucket", bucket)
        .withColumns({"cum": F.sum("bytes").over(order), "cum_rows": F.sum("rows").over(order), "next1": F.lead("h1").over(order), "next2": F.lead("h2").over(order)})
        .withColumn("ends", ~(F.col("next1").eqNullSafe(F.col("h1")) & F.col("next2").eqNullSafe(F.col("h2"))))
        .drop("next1", "next2")
    )
    parts = scratch(parts, "shard-parts")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("bucket")
        .agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r"))
        .select("bucket", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}0") for x in "br"))
    )  # at most BUCKETS rows
    parts = parts.join(F.broadcast(offsets), "bucket").select(*key, "rows", "ends", (F.col("cum") + F.col("b0")).alias("cum"), (F.col("cum_rows") + F.col("r0")).alias("cum_rows"))
    total = parts.agg(F.max("cum")).first()[0]
    cuts = minimax_cuts(parts.where("ends").select("cum"), total, shards) if total else []
    shard = reduce(lambda x, y: x + y, ((F.col("cum") > cut).cast("int") for cut in cuts[:-1]), F.lit(0))
    parts = parts.withColumn("shard", shard.cast("int")).withColumn("row0", F.col("cum_rows") - F.col("rows"))
    starts = parts.groupBy("shard").agg(F.min("row0").alias("shard_row0"))  # a row for each shard
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id"))
    return (
        base.withColumn("rank", rank)
        .join(parts.join(F.broadcast(starts), "shard"), key)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("row0") - F.col("shard_row0") + F.col("rank") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op1_minimax_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
