"""Connected components of edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut, forget


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node that it reaches, for every node of the edges ``u, v`` (longs).

    Large-star and small-star contraction by turns: a round is two min-aggregations and two equi-joins, and the number of
    rounds grows with the logarithm of the longest path. Each round's table is deleted when the next one stands. A node
    whose only edges lead to itself is its own component; edges with a null end are left out.
    """
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    both_ends = edges.where("u is not null and v is not null")
    now = cut(both_ends.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    loops = now.where(u == v).select(u.alias("node"))

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    first, now = now, cut(now.where(u != v), "edges")
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least(u, m).alias("m"))
        large = both.join(low, "u").where(v > u).select(v.alias("u"), m.alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(v != m).select(v.alias("u"), m.alias("v")).unionByName(low.select("u", m.alias("v"))).distinct()
        after = cut(small, "edges")
        forget(now)
        last, seen, now = seen, mark(after), after
        if seen == last:
            break
    found = now.select(u.alias("node"), v.alias("component")).unionByName(now.select(v.alias("node"), v.alias("component")).distinct())
    alone = loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    out = cut(found.unionByName(alone), "components")
    forget(first, now)
    return out
