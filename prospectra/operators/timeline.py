"""Computations along the time of each key, where one key may hold a large part of all rows.

No step puts all rows of a key into one task: time is cut into blocks, a block is one window, and what crosses blocks goes
through one row a block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, forget
from .relational import spaced_events

INTEGRAL = ("tinyint", "smallint", "int", "bigint")
#: A key with more rows than this is spaced by pointer doubling over many tasks, others by one pass each; both give the same rows.
LARGE_KEY = 1_000_000
#: Blocks in a span of the spacing.
BLOCKS_A_SPAN = 16


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> tuple[DataFrame, Column]:
    """``right`` with its join columns renamed, and the null-safe condition on them."""
    renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in columns})
    return renamed, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in columns])


def sliding_totals(events: DataFrame, keys: list[str], ts: str, values: list[str], seconds: int, block_seconds: int = 3600) -> DataFrame:
    """The rows with ``n_before`` and, for each value, ``count_x`` and ``sum_x`` over the rows of its key in the ``seconds`` before.

    The span of a row at second t is [t - seconds, t - 1]. Totals are differences of running totals at both ends of the
    span: a running total is the total of earlier blocks and the running total within its block. Whole values are summed
    as longs and others as decimals with three places, so that differences are exact. Nulls are not counted in ``count_x``;
    a row without a time has no span and zero totals; null keys are a key.
    """
    whole = dict(events.dtypes)
    totals = ["n_before", *(f"{kind}_{v}" for v in values for kind in ("count", "sum"))]
    as_number = lambda v: F.col(v).cast("long" if whole[v] in INTEGRAL else "decimal(27,3)")
    by_value = [c for v in values for c in (F.count(v).alias(f"count_{v}"), F.coalesce(F.sum(as_number(v)), F.lit(0)).alias(f"sum_{v}"))]
    points = events.where(F.col(ts).isNotNull()).groupBy(*keys, F.unix_timestamp(ts).alias("__s")).agg(F.count("*").alias("n_before"), *by_value)
    ends = points.select(*keys, F.explode(F.array(F.col("__s") - 1, F.col("__s") - seconds - 1)).alias("__s"), *((F.col(c) * 0).alias(c) for c in totals))
    block = F.floor(F.col("__s") / block_seconds)
    # one exchange by key and block: the ends of spans are points that add nothing
    grid = points.unionByName(ends).withColumn("__block", block).repartition(*keys, "__block")
    grid = grid.groupBy(*keys, "__block", "__s").agg(*(F.sum(c).alias(c) for c in totals))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = grid.groupBy(*keys, "__block").agg(*(F.sum(c).alias(c) for c in totals))
    carried = blocks.select(*keys, "__block", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__before_{c}") for c in totals))
    within = Window.partitionBy(*keys, "__block").orderBy("__s").rowsBetween(Window.unboundedPreceding, 0)
    running = grid.select(*keys, "__block", "__s", *(F.sum(c).over(within).alias(c) for c in totals))
    carried, same = _same(running, carried, [*keys, "__block"])
    prefix = running.join(carried, same).select(*keys, "__s", *((F.col(c) + F.col(f"__before_{c}")).alias(c) for c in totals))
    # each prefix is the upper end of the span of one second and the lower end of that of another
    signed = lambda shift, sign: prefix.select(*keys, (F.col("__s") + shift).alias("__s"), *((F.col(c) * sign).alias(c) for c in totals))
    spans = signed(1, 1).unionByName(signed(seconds + 1, -1)).groupBy(*keys, "__s").agg(*(F.sum(c).alias(c) for c in totals))
    spans, same = _same(events, spans, [*keys, "__s"])
    joined = events.withColumn("__s", F.unix_timestamp(ts)).join(spans, same & F.col("__s").isNotNull(), "left")
    return joined.select(*events.columns, *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in totals))


def following_times(times: DataFrame, keys: list[str], step: int) -> DataFrame:
    """For each distinct time ``t`` (a long) of a key the first time at least ``step`` later, or null: columns keys, ``t``, ``next``."""
    width = max(step // BLOCKS_A_SPAN, 1)
    real = times.select(*keys, F.col("t").alias("at"), F.col("t").alias("real"), F.lit(None).cast("long").alias("asks"))
    asks = times.select(*keys, (F.col("t") + step).alias("at"), F.lit(None).cast("long").alias("real"), F.col("t").alias("asks"))
    grid = real.unionByName(asks).withColumn("block", F.floor(F.col("at") / width)).repartition(*keys, "block")
    # equal times are peers: a time exactly one step later is found
    after = Window.partitionBy(*keys, "block").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = grid.withColumn("near", F.min("real").over(after)).where("asks is not null").select(*keys, "block", "asks", "near")
    later = Window.partitionBy(*keys).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    heads = grid.groupBy(*keys, "block").agg(F.min("real").alias("head")).select(*keys, "block", F.min("head").over(later).alias("far"))
    heads, same = _same(found, heads, [*keys, "block"])
    return found.join(heads, same).select(*keys, F.col("asks").alias("t"), F.coalesce("near", "far").alias("next"))


def spaced_by_doubling(df: DataFrame, keys: list[str], ts: str, seconds: int) -> DataFrame:
    """The rows that ``spaced_events`` keeps, with each key's work shared out over tasks.

    Every time points to the first time at least ``seconds`` later. From the first time of each key the pointers are
    followed one, two, four, ... steps at once, so a chain of n kept events takes log n joins.
    """
    micros = df.select(*keys, F.unix_micros(ts).alias("t"))
    times = micros.where("t is not null").distinct()
    jumps = cut(following_times(times, keys, seconds * 1_000_000), "spaced-jumps")
    reached = cut(times.groupBy(*keys).agg(F.min("t").alias("t")), "spaced-reached")
    while True:
        right, same = _same(reached, jumps, [*keys, "t"])
        new = cut(reached.join(right, same).where("next is not null").select(*keys, F.col("next").alias("t")), "spaced-new")
        if new.isEmpty():
            forget(new, jumps)
            break
        both = cut(reached.unionByName(new), "spaced-reached")
        further = jumps.select(*keys, F.col("t").alias("from"), F.col("next").alias("t")).where("t is not null")
        right, same = _same(further, jumps, [*keys, "t"])
        longer = cut(further.join(right, same).select(*keys, F.col("from").alias("t"), "next").where("next is not null"), "spaced-jumps")
        forget(new, reached, jumps)
        reached, jumps = both, longer
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    order = F.struct(*(part for c in df.columns for part in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))))
    marked = df.withColumn("__t", F.unix_micros(ts))
    right, same = _same(marked, reached.withColumnRenamed("t", "__t"), [*keys, "__t"])
    kept = marked.join(right, same, "left_semi")
    only, same = _same(marked, reached.select(*keys), keys)
    untimed = marked.where("__t is null").join(only, same, "left_anti")
    return kept.unionByName(untimed).groupBy(*keys, "__t").agg(F.min_by(row, order).alias("row")).select("row.*")


def spaced(df: DataFrame, keys: list[str], ts: str, seconds: int, large_key: int = LARGE_KEY) -> DataFrame:
    """Events at least ``seconds`` (above zero) after the last kept event of their key.

    Events without a time come last; one is kept only where its key has no other. Of events of one time the one whose
    columns come first is kept.
    """
    df = cut(df, "spaced-events")
    large = cut(df.groupBy(*keys).count().where(F.col("count") > large_key).select(*keys), "spaced-large")
    if large.isEmpty():
        return spaced_events(df, keys, ts, seconds)
    right, same = _same(df, large, keys)
    return spaced_events(df.join(right, same, "left_anti"), keys, ts, seconds).unionByName(spaced_by_doubling(df.join(right, same, "left_semi"), keys, ts, seconds))
