"""Joins of texts that hold or begin with one another, without meeting all pairs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

GRAM = 4


def _grams(text: Column, size: Column | int) -> Column:
    """All distinct pieces of a text that have this size; none for a shorter text."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.char_length(text) - size + 1
    at = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, size)))


def candidate_pairs(needles: DataFrame, hays: DataFrame, gram: int = GRAM) -> DataFrame:
    """Pairs ``needle, hay`` of distinct texts in which the hay holds the needle's rarest gram.

    Every gram of a needle is in each hay that holds it, so one gram is enough to find them all, and the one that the
    fewest hays have leaves the fewest pairs to test. A needle shorter than a gram is its own gram. A needle with a gram
    that no hay has is in none.
    """
    needles = needles.where("needle <> ''").select("needle").distinct()
    hays = hays.where("hay <> ''").select("hay").distinct()
    size = F.least(F.char_length("needle"), F.lit(gram))
    # at most ``gram`` sizes
    sizes = sorted(r.size for r in needles.select(size.alias("size")).distinct().collect())
    pieces = F.flatten(F.array(*(_grams(F.col("hay"), n) for n in sizes))) if sizes else F.array().cast("array<string>")
    postings = hays.select("hay", F.explode(pieces).alias("gram"))
    frequency = postings.groupBy("gram").agg(F.count("*").alias("n"))
    parts = needles.select("needle", F.explode(_grams(F.col("needle"), size)).alias("gram")).join(frequency, "gram", "left")
    rarest = parts.groupBy("needle").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("least"))
    return rarest.where("least > 0").select("needle", "gram").join(postings, "gram").select("needle", "hay")


def contained(needles: DataFrame, hays: DataFrame, gram: int = GRAM) -> DataFrame:
    """All pairs of distinct texts ``needle, hay`` where the hay holds the needle; empty and null texts are in none."""
    return candidate_pairs(needles, hays, gram).where(F.contains("hay", F.col("needle")))


def first_with_prefix(keys: DataFrame, names: DataFrame, parts: int | None = None) -> DataFrame:
    """The smallest ``id`` among the names (``name, id``) that begin with each key (``key``); keys without any are left out.

    The names are sorted into ranges, over as many tasks as there are. A key is an interval of names and goes to the
    ranges that its interval meets; there one pass holds the keys that the name at hand begins with, which are prefixes
    of one another. An empty or null key or name, or a name without an id, takes no part.
    """
    spark = keys.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = names.where("name <> '' and id is not null").groupBy("name").agg(F.min("id").alias("id"))
    ranged = cut(named.repartitionByRange(parts, "name").withColumn("part", F.spark_partition_id()), "ranges")
    # one row a range
    bounds = ranged.groupBy("part").agg(F.min("name").alias("low"), F.max("name").alias("high"))
    asked = keys.where("key <> ''").select("key").distinct()
    # a key meets a range if the range's names don't all come before it or all after what begins with it
    meets = (F.col("high") >= F.col("key")) & ((F.col("low") <= F.col("key")) | F.col("low").startswith(F.col("key")))
    placed = asked.join(F.broadcast(bounds), meets).select("part", F.col("key").alias("text"), F.lit(None).cast("long").alias("id"))
    both = placed.unionByName(ranged.select("part", F.col("name").alias("text"), F.col("id").cast("long").alias("id")))
    schema = pa.schema([("key", pa.string()), ("id", pa.int64())])

    def run(batches):
        open_keys: list[list] = []  # prefixes of the text at hand, each longer than the last, with their smallest id
        part = None
        for b in batches:
            done = []
            for p, text, i in zip(*(b.column(c).to_pylist() for c in ("part", "text", "id")), strict=True):
                while open_keys and (p != part or not text.startswith(open_keys[-1][0])):
                    key, low = open_keys.pop()
                    done.append((key, low))
                    if open_keys and low is not None:
                        held = open_keys[-1][1]
                        open_keys[-1][1] = low if held is None else min(held, low)
                part = p
                if i is None:
                    open_keys.append([text, None])
                elif open_keys:
                    held = open_keys[-1][1]
                    open_keys[-1][1] = i if held is None else min(held, i)
            yield _found(done, schema)
        done = []
        while open_keys:
            key, low = open_keys.pop()
            done.append((key, low))
            if open_keys and low is not None:
                held = open_keys[-1][1]
                open_keys[-1][1] = low if held is None else min(held, low)
        yield _found(done, schema)

    # a key comes before the name that equals it
    ordered = both.repartition("part").sortWithinPartitions("part", "text", F.col("id").isNotNull(), "id")
    return ordered.mapInArrow(run, "key string, id long").groupBy("key").agg(F.min("id").alias("id"))


def _found(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    rows = [r for r in rows if r[1] is not None]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)
