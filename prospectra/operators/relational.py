"""Relational building blocks: latest rows, merges, de-duplication, anti-joins, sequential folds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .lineage import cut, forget

#: A component of the graph of shared keys with more rows is settled in rounds; the result is the same.
LARGE_COMPONENT = 200_000
#: Rounds before the graph is built.
ROUNDS = 3


def latest_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the largest ``order`` of each key, by one aggregation without a self-join."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("row")).select("row.*")


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), order).alias("row")).select("row.*")


def top_per_key(df: DataFrame, key: str, order: list[Column], n: int | None) -> DataFrame:
    """At most ``n`` rows of each key in this order, or all of them for None, numbered from 1 in ``rank``."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def keep_first(df: DataFrame, keys: list[Column], order: str, exempt: Column | None = None) -> DataFrame:
    """Rows that come first for their keys, by a partial aggregation before the shuffle; exempt rows all stay and go to no group.

    Rows of one order go by their columns.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    place = F.struct(F.col(order), row)
    spared = F.lit(False) if exempt is None else F.coalesce(exempt, F.lit(False))
    names = [f"__key{i}" for i in range(len(keys))]
    grouped = df.where(~spared).select(*(k.alias(n) for k, n in zip(keys, names, strict=True)), row.alias("row"), place.alias("place"))
    first = grouped.groupBy(*names).agg(F.min_by("row", "place").alias("row")).select("row.*")
    return first if exempt is None else first.unionByName(df.where(spared))


def merge_snapshot(old: DataFrame, new: DataFrame, key: str, keep_old: list[str], new_wins: list[str]) -> DataFrame:
    """Upsert on a key: ``keep_old`` columns keep an existing non-empty value, ``new_wins`` take a new value that is not null."""
    o, n = old.alias("o"), new.alias("n")
    pick = [F.coalesce(f"o.{key}", f"n.{key}").alias(key)]
    pick += [F.coalesce(F.when(F.col(f"o.{c}") != "", F.col(f"o.{c}")), F.col(f"n.{c}")).alias(c) for c in keep_old]
    pick += [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in new_wins]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*pick)


def anti_any(df: DataFrame, others: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Rows without a match on any of several keys: one anti-join each instead of a join with OR."""
    return reduce(lambda left, o: left.join(o[0].select(F.col(o[2]).alias(o[1])).distinct(), o[1], "left_anti"), others, df)


def semi_any(df: DataFrame, key: str, others: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Rows with a match on at least one of several keys."""
    found = [df.join(o.select(F.col(theirs).alias(mine)).where(F.col(mine).isNotNull()).distinct(), mine, "left_semi").select(key) for o, mine, theirs in others]
    return df.join(reduce(DataFrame.unionByName, found).distinct(), key, "left_semi")


def _in_rounds(df: DataFrame, first: str, second: str, place: Column, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows accepted in so many rounds of all tasks, or until none is left, and the rows left over.

    A round accepts rows that come first on both keys among those left, and drops what conflicts with them.
    """
    comes_first = lambda k: F.min(place).over(Window.partitionBy(k)).eqNullSafe(place)
    accepted, left, done = None, df, 0
    while True:
        now = cut(left.withColumn("__a", comes_first(first)).withColumn("__b", comes_first(second)).where("__a and __b").drop("__a", "__b"), "accepted")
        both = now if accepted is None else cut(accepted.unionByName(now), "accepted")
        rest = left
        for k in (first, second):
            rest = rest.join(now.select(F.col(k).alias("__k")).distinct(), F.col(k).eqNullSafe(F.col("__k")), "left_anti")
        rest = cut(rest, "unsettled")
        forget(*(x for x in (accepted, left) if x is not None and x is not df), *([now] if both is not now else []))
        accepted, left, done = both, rest, done + 1
        if done == rounds or left.isEmpty():
            return accepted, left


def greedy_two_keys(df: DataFrame, first: str, second: str, order: str, large: int = LARGE_COMPONENT, rounds: int = ROUNDS) -> DataFrame:
    """Rows accepted in order if neither key belongs to a row accepted earlier; a rejected row blocks nothing.

    Of rows with the same two keys only the first can be accepted. A few rounds over all tasks settle rows whose conflicts
    aren't deep. What is left is settled component by component of the graph that shared keys make: each is one pass over
    its rows in one task, which holds the keys taken in it; a component of more than ``large`` rows goes on in rounds. A
    null key is a key like others, a null order comes last, and rows of one order go by their columns.
    """
    columns = df.columns
    row = F.struct(*(F.col(f"`{c}`") for c in columns))
    by = [F.col(order).isNull(), F.col(order), *(part for c in columns for part in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`")))]
    place = F.struct(*by)
    rows = cut(df.groupBy(first, second).agg(F.min_by(row, place).alias("row")).select("row.*"), "candidates")
    out, left = _in_rounds(rows, first, second, place, rounds)
    forget(rows)
    if left.isEmpty():
        return out
    # hashes only say which rows belong together; keys themselves are compared
    ends = left.withColumns({"__u": F.xxhash64(F.lit(1), F.col(first).isNull(), first), "__v": F.xxhash64(F.lit(2), F.col(second).isNull(), second)})
    groups = components(ends.select(F.col("__u").alias("u"), F.col("__v").alias("v")))
    member = cut(ends.join(groups.select(F.col("node").alias("__node"), F.col("component").alias("__component")), F.col("__u") == F.col("__node")).drop("__u", "__v", "__node"), "components")
    forget(left, groups)
    giant = cut(member.groupBy("__component").count().where(F.col("count") > large).select("__component"), "giants")

    def settle(batches):
        component, taken = None, (set(), set())
        for b in batches:
            keep = []
            for c, a, z in zip(*(b.column(n).to_pylist() for n in ("__component", first, second)), strict=True):
                if c != component:
                    component, taken = c, (set(), set())
                free = a not in taken[0] and z not in taken[1]
                keep.append(free)
                if free:
                    taken[0].add(a)
                    taken[1].add(z)
            yield b.filter(pa.array(keep, pa.bool_()))

    small = member.join(giant, "__component", "left_anti")
    nulls_last = [F.col(f"`{c}`").asc_nulls_last() for c in dict.fromkeys([order, *columns])]
    settled = small.repartition("__component").sortWithinPartitions("__component", *nulls_last).mapInArrow(settle, small.schema).select(*columns)
    out = out.unionByName(settled)
    if giant.isEmpty():
        return out
    return out.unionByName(_in_rounds(member.join(giant, "__component", "left_semi").select(*columns), first, second, place)[0])


def _fold(df: DataFrame, keys: list[str], order: list[str], values: list[str], fresh: Callable[[tuple, tuple], bool]) -> DataFrame:
    """Rows that are the first of their key or ``fresh`` against the last kept row of it, by their ``values``.

    The rows of a key pass through one task in order, batch by batch; only the last kept row is held.
    """

    def run(batches):
        key = last = None
        for b in batches:
            columns = [b.column(c).to_pylist() for c in (*keys, *values)]
            keep = []
            for row in zip(*columns, strict=True):
                k, v = row[: len(keys)], row[len(keys) :]
                kept = last is None or k != key or fresh(v, last)
                keep.append(kept)
                if kept:
                    key, last = k, v
            yield b.filter(pa.array(keep, pa.bool_()))

    by = [F.col(c).asc_nulls_last() for c in dict.fromkeys([*keys, *order, *df.columns])]
    return df.repartition(*keys).sortWithinPartitions(*by).mapInArrow(run, df.schema)


def spaced_events(df: DataFrame, keys: list[str], ts: str, seconds: int) -> DataFrame:
    """Events at least ``seconds`` after the last kept event of their key: each kept event starts a new span.

    Events without a time come last; one is kept only where its key has no other.
    """

    def fresh(row: tuple, last: tuple) -> bool:
        return row[0] is not None and (row[0] - last[0]).total_seconds() >= seconds

    return _fold(df, keys, [ts], [ts], fresh)


def changed_rows(df: DataFrame, key: str, order: str, values: list[str], label: str, tolerance: float = 0.01) -> DataFrame:
    """Rows that differ from the last kept row of their key by ``tolerance`` in any value or in the label."""

    def fresh(row: tuple, last: tuple) -> bool:
        return row[-1] != last[-1] or any(a is not None and b is not None and abs(a - b) >= tolerance for a, b in zip(row[:-1], last[:-1], strict=True))

    return _fold(df, [key], [order], [*values, label], fresh)
