"""Helpers shared by the training-data operators: scratch tables, text hashes, graph components."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python form of the word pattern: runs without space, tab, LF, VT, FF and CR.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; only a local session may have none and gets one beside the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return root.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """Folder of this application's cut lineage."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a scratch table that nothing will read again."""
    _delete(df.sparkSession, df.scratch_path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; call it when no result that reads them is needed any more."""
    _delete(spark, scratch_root(spark))


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs; it acts on what the driver's garbage collector frees."""
    for _ in range(2):  # what the first round frees in Python holds the driver's objects until the second
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def slices(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches put together or cut to about ``limit`` bytes; a row is never cut."""
    held, size = [], 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = b.num_rows - at
            while n > 1 and b.slice(at, n).nbytes > limit:
                n = (n + 1) // 2
            held.append(b.slice(at, n))
            size += held[-1].nbytes
            at += n
            if size >= limit:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body`` (a lambda of one Column)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def two_hashes(*cols: Column) -> tuple[Column, Column]:
    """128 bits that stand for the values of ``cols``; a null differs from an empty string."""
    marked = [x for c in cols for x in (c.isNull(), c)]
    return F.xxhash64(*marked), F.xxhash64(F.lit("second"), *marked)


def words(text: Column) -> Column:
    """Words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable from each node of an undirected edge list: columns ``node``, ``component``.

    Alternating large-star and small-star contraction: every round is two min-aggregations and two equi-joins, which
    AQE splits at hubs. Nodes without an edge to another node do not appear.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    now = scratch(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct(),
        "edges",
    )

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least(u, m).alias("m"))
        large = both.join(low, "u").where(v > u).select(v.alias("u"), m.alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(v != m).select(v.alias("u"), m.alias("v")).unionByName(low.select("u", m.alias("v"))).distinct()
        now = scratch(small, "edges")
        last, seen = seen, mark(now)
        if seen == last:
            break
    return now.select(u.alias("node"), v.alias("component")).unionByName(now.select(v.alias("node"), v.alias("component")).distinct())
