"""Embedding near-dedup by Euclidean p-stable hashing.

Unit vectors are projected on Gaussian directions, shifted and quantised to cells of fixed width; the cells of several
projections make a bucket, in each of several tables. Vectors that meet in a bucket are compared by exact cosine. At the
default parameters a pair at the threshold meets in at least one table with probability 0.997, closer pairs more often.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, scratch, two_hashes

THRESHOLD = 0.98
TABLES, PROJECTIONS, WIDTH, SEED = 20, 12, 1.5, 7
#: Vectors of a bucket that one task compares; a larger bucket is dealt over pairs of parts.
CELL = 512


def bucket_keys(unit: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """Bucket of each vector in each table, as 64-bit hashes of the table and its quantised projections."""
    dim = unit.shape[1]
    rng = np.random.default_rng([seed, dim])
    directions = rng.standard_normal((dim, tables * projections))
    shift = rng.uniform(0, width, tables * projections)
    cells = np.floor((unit @ directions + shift) / width).astype(np.int64).reshape(len(unit), tables, projections)
    mix = rng.integers(0, 1 << 63, (tables, projections), dtype=np.int64).view(np.uint64) | np.uint64(1)
    key = (cells.view(np.uint64) * mix).sum(axis=2, dtype=np.uint64)
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def _units(x: np.ndarray) -> np.ndarray:
    """The rows scaled to length 1, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _edges(same: np.ndarray) -> list[tuple[int, int]]:
    """A forest over the linked pairs of a boolean matrix: fewer edges than members."""
    label, out = np.arange(len(same)), []
    for i in range(len(same)):
        near = np.flatnonzero(same[i])
        for found in np.unique(label[near]):
            if found != label[i]:
                out.append((i, int(near[np.flatnonzero(label[near] == found)[0]])))
                label[label == found] = label[i]
    return out


def _compare(ids, copies, vectors, keys, mine, table: int, threshold: float):
    """Links within a cell, or between its two parts (``mine`` tells them apart), that no earlier table has found.

    Yields (id, number of rows linked) and (id, id) edges.
    """
    links = vectors @ vectors.T >= threshold
    np.fill_diagonal(links, False)
    if mine is not None:
        links &= mine[:, None] != mine[None, :]
    for t in range(table):
        if not links.any():
            break
        links &= keys[:, t][:, None] != keys[:, t][None, :]
    counts = links @ copies
    found = np.flatnonzero(counts)
    return [(int(ids[i]), int(counts[i])) for i in found], [(int(ids[i]), int(ids[j])) for i, j in _edges(links)] if len(found) else []


def link_embeddings(
    vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED
) -> DataFrame:
    """Columns ``vec_id``, ``n_links``, ``component_id``, ``kept``, a row for each row of ``vectors``.

    Vectors link if their labels are equal and not null and their cosine is at least ``threshold``. A null, empty or zero
    vector, one with a null or non-finite component, and one with a null label link with nothing. Vectors of different
    dimensions do not link. Equal vectors of a label form one class, so copies are counted, not paired; repeated rows
    are copies. A null ``vec_id`` takes part and never names a component unless the component has no other; an empty
    table gives an empty result; other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), "embedding")
    v = F.col("embedding")
    sound = F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    h1, h2 = two_hashes(F.col("label"), v)
    kind = rows.schema["embedding"].dataType.elementType.simpleString()
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("class", h1).withColumn("class2", h2)
    good = rows.where("sound")
    classes = scratch(
        good.groupBy("class", "class2").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"), F.first("label").alias("label")),
        "vector-classes",
    )

    def hashed(batches):
        for b in batches:
            out = []
            lists = b.column(2)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat, starts = lists.flatten().to_numpy(), np.cumsum(sizes) - sizes
            for dim in np.unique(sizes):
                of = np.flatnonzero(sizes == dim)
                x = flat[starts[of, None] + np.arange(dim)]
                keys = bucket_keys(_units(x), tables, projections, width, seed)
                out.append(
                    pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(of)), b.column(1).take(pa.array(of)), b.column(3).take(pa.array(of)), pa.array(np.full(len(of), dim, dtype=np.int32)), *(pa.ListArray.from_arrays(np.arange(len(of) + 1, dtype=np.int32) * m.shape[1], pa.array(m.ravel())) for m in (x, keys))],
                        names=["class", "copies", "label", "dim", "vector", "keys"],
                    )
                )
            yield from out

    units = classes.select("class", "copies", "embedding", F.xxhash64("label").alias("label"))
    units = scratch(units.mapInArrow(hashed, f"class long, copies long, label long, dim int, vector array<{kind}>, keys array<long>"), "vector-keys")
    # only ids go to all tables; vectors join them in the buckets that hold more than one
    bucket = ["label", "dim", "table", "key"]
    spread = units.select("class", "label", "dim", F.posexplode("keys").alias("table", "key"))
    sizes = spread.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1")
    held = scratch(spread.join(sizes, bucket), "vector-buckets")
    members = units.select("class", F.struct("class", "copies", "vector", "keys").alias("member"))
    small = held.where(F.col("n") <= CELL).join(members, "class").groupBy(*bucket).agg(F.collect_list(F.struct("member", F.lit(0).alias("mine"))).alias("cell")).select("table", "cell", F.lit(False).alias("split"))
    parts = F.ceil(F.col("n") / (CELL // 2)).cast("int")
    large = (
        held.where(F.col("n") > CELL)
        .withColumn("mine", F.pmod(F.xxhash64("class"), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select(*bucket, "class", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
        .join(members, "class")
        .groupBy(*bucket, "i", "j")
        .agg(F.collect_list(F.struct("member", "mine")).alias("cell"))
        .select("table", "cell", (F.col("i") != F.col("j")).alias("split"))
    )

    def compare(batches):
        for b in batches:
            counts, edges = [], []
            for k in range(b.num_rows):
                cell = b.column(1)[k].values
                member, mine = cell.field("member"), cell.field("mine").to_numpy()
                n = len(cell)
                unit = _units(member.field("vector").flatten().to_numpy().reshape(n, -1))
                keys = member.field("keys").flatten().to_numpy().reshape(n, -1)
                c, e = _compare(
                    member.field("class").to_numpy(), member.field("copies").to_numpy(), unit, keys, mine if b.column(2)[k].as_py() else None, b.column(0)[k].as_py(), threshold
                )
                counts += c
                edges += e
            columns = [[*(x for x, _ in counts), *(x for x, _ in edges)], [*(n for _, n in counts), *(0 for _ in edges)], [*(None for _ in counts), *(y for _, y in edges)]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["class", "links", "other"])

    found = scratch(small.unionByName(large).mapInArrow(compare, "class long, links long, other long"), "vector-links")
    links = found.where("links > 0").groupBy("class").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("other is not null"), "class", "other").select(F.col("node").alias("class"), F.col("component").alias("root"))
    table = classes.join(links, "class", "left").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    lowest = table.groupBy("root").agg(F.min("first").alias("component_id"))
    table = table.join(lowest, "root").select("class", "class2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = good.select("vec_id", "class", "class2").join(table, ["class", "class2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_pstable_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return link_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
