"""Mixing sources to target weights by Pfair scheduling.

The rows of each source form blocks. By its target weight, a source of share w has its block k released in the slot of
k / w and due in that of (k + 1) / w; at each slot the released block with the earliest deadline is placed, so that a
source is never a whole block ahead of or behind its share. When a source is used up the others share its part: both
times are kept in units in which all active weights together take one slot, so that no block's times ever change. They
are computed in integers of so many bits that they are those of the weights themselves.

A block is BLOCK_ROWS rows, or the total over MAX_BLOCKS where that is more: the driver, which holds a count a source,
schedules MAX_BLOCKS blocks and one more a source at most, whatever the number of rows. The plan is a table, which is met
with the rows by an equi-join.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_root, two_hashes

BLOCK_ROWS, MAX_BLOCKS = 8, 1 << 19
#: Default target weights: the number of rows of a source to this power.
TEMPERATURE = 0.5
#: Parts into which the rows of a source are dealt to be counted.
BUCKETS = 1024
#: Blocks of the plan that are written at once.
PLAN_PART = 1 << 17
PLAN = pa.schema([("label", pa.string()), ("block", pa.int64()), ("start", pa.int64())])
#: Bits of weights, and of a slot.
WEIGHT_BITS, TIME_BITS = 53, 160


def schedule(rows: dict[str, int], weights: dict[str, float], block_rows: int = BLOCK_ROWS) -> Iterator[tuple[str, int, int]]:
    """(source, block, first row) of every block in the order of the mix; the last block of a source may be short."""
    names = sorted(s for s, n in rows.items() if n)
    if not names:
        return
    blocks = [-(-rows[s] // block_rows) for s in names]
    top = max(weights[s] for s in names)
    weight = [max(1, round(weights[s] / top * 2**WEIGHT_BITS)) for s in names]
    slot = 1 << TIME_BITS
    at = lambda i, k: (k << TIME_BITS) // weight[i]
    ends = sorted((at(i, blocks[i]), i) for i in range(len(names)))  # when each is used up if all keep to their shares
    active, ended, now, start = sum(weight), 0, 0, 0
    done = [0] * len(names)
    coming, ready = [(0, i) for i in range(len(names))], []
    while coming or ready:
        rest = slot
        while ended < len(ends):  # the end of this slot
            if now + rest // active <= ends[ended][0]:
                now += rest // active
                break
            rest -= (ends[ended][0] - now) * active
            now, i = ends[ended]
            active, ended = active - weight[i], ended + 1
        while coming and (coming[0][0] < now or not ready or ended == len(ends)):
            i = heapq.heappop(coming)[1]
            heapq.heappush(ready, (at(i, done[i] + 1), i))
        i = heapq.heappop(ready)[1]
        yield names[i], done[i], start
        done[i] += 1
        if done[i] < blocks[i]:
            start += block_rows
            heapq.heappush(coming, (at(i, done[i]), i))
        else:
            start += rows[names[i]] - (blocks[i] - 1) * block_rows


def plan_table(spark: SparkSession, blocks: Iterable[tuple]) -> DataFrame:
    """The scheduled blocks as a table, written part by part."""
    path = f"{scratch_root(spark)}/mix-plan-{uuid.uuid4().hex}"
    part = []

    def write() -> None:
        columns = zip(*part, strict=True) if part else ([], [], [])
        spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PLAN, strict=True)], schema=PLAN)).write.mode("append").parquet(path)

    for x in blocks:
        part.append(x)
        if len(part) == PLAN_PART:
            write()
            part = []
    write()
    return spark.read.schema("label string, block long, start long").parquet(path)


def place_rows(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Add ``mix_source``, ``mix_block`` and ``mix_position`` (gapless from 0) to every row.

    Weights default to the row counts to the power TEMPERATURE; a source without a given weight gets the smallest given
    one. A null source is a source of its own; within a source rows lie in the order of a hash of id and text; repeated
    rows have places of their own; an empty table stays empty. Columns with one of the three names are replaced.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in ("mix_source", "mix_block", "mix_position")]
    # a label per source: "s:" and its name, "n:" for null
    label = F.when(F.col("source").isNull(), "n:").otherwise(F.concat(F.lit("s:"), F.col("source").cast("string")))
    h1, h2 = two_hashes(F.col("doc_id"), F.col("text"))
    rows = docs.select(F.struct(*keep).alias("row"), label.alias("label"), h1.alias("h1"), h2.alias("h2")).withColumn("bucket", F.shiftrightunsigned("h1", 64 - (BUCKETS.bit_length() - 1)).cast("int"))
    sizes = rows.groupBy("label", "bucket").agg(F.count("*").alias("n"))
    total = {r["label"]: r["n"] for r in sizes.groupBy("label").agg(F.sum("n").alias("n")).toLocalIterator()}
    if weights is None:
        share = {s: n**TEMPERATURE for s, n in total.items()}
    else:
        share = {s: max(weights.get(s[2:] if s[0] == "s" else None, min(weights.values())), 1e-9) for s in total}
    block_rows = max(block_rows, -(-sum(total.values()) // max_blocks))
    # the first row of each block, found once a block and brought to the rows with the ranks of their bucket
    starts = plan_table(spark, schedule(total, share, block_rows))
    before = Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranks = sizes.select("label", "bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank0"))
    first, last = F.floor(F.col("rank0") / block_rows), F.floor((F.col("rank0") + F.col("n") - 1) / block_rows)
    met = ranks.select("label", "bucket", "rank0", F.explode(F.sequence(first, last)).alias("block")).join(starts, ["label", "block"])
    offsets = met.groupBy("label", "bucket").agg(F.first("rank0").alias("rank0"), F.min("block").alias("block0"), F.sort_array(F.collect_list("start")).alias("starts"))
    ranked = rows.join(offsets, ["label", "bucket"]).withColumn("rank", F.col("rank0") + F.row_number().over(Window.partitionBy("label", "bucket").orderBy("h1", "h2")) - 1)
    block = F.floor(F.col("rank") / block_rows)
    position = F.get("starts", (block - F.col("block0")).cast("int")) + F.col("rank") % block_rows
    return ranked.select("row.*", F.col("label").alias("mix_source"), block.cast("long").alias("mix_block"), position.cast("long").alias("mix_position"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """All rows of ``docs`` with their columns, in the order of the mix."""
    return place_rows(docs, weights).orderBy("mix_position").select(*docs.columns)


def written_position(docs: DataFrame) -> DataFrame:
    """``docs``, a table read from the files that ``mix`` was written to, with ``mix_position`` (gapless from 0).

    The files are in the order of their numbers, which is that of the sorted ranges; readers don't keep it.
    """
    name = F.col("mix_file")
    number = lambda pattern: F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("long"), F.lit(0))
    rows = docs.select(*(c for c in docs.columns if c != "mix_position"), F.col("_metadata.file_name").alias("mix_file"), F.col("_metadata.row_index").alias("mix_row"))
    sizes = rows.groupBy("mix_file").agg(F.count("*").alias("n"))
    before = Window.orderBy(number(r"^part-(\d+)"), number(r"-c(\d+)\."), name).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("mix_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("mix_start"))  # a row a file
    return rows.join(F.broadcast(starts), "mix_file").withColumn("mix_position", F.col("mix_start") + F.col("mix_row")).drop("mix_file", "mix_start", "mix_row")


def op4_pfair_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return place_rows(docs.select("doc_id", "source", F.xxhash64("text").alias("text"))).select("doc_id", "source", "mix_source", "mix_block", "mix_position")
