"""Hard-negative mining by threshold joins with norm-pruned inverted indexes.

Anchors are set against all rows in a grid of cells, each a bounded block of anchors and a stream of rows. In a cell the
rows are held dimension by dimension: a row enters the index from the dimension on at which the norm of what comes before
can reach some threshold, so leading dimensions that no threshold needs are left out. Partial scores are accumulated over
the indexed dimensions; pairs whose partial score plus the product of the remaining norms stays below the anchor's
threshold are dropped, the others are completed. Each anchor asks for windows of scores with so many places; a round looks
between its threshold and the last one, and anchors whose windows aren't full go on with lower thresholds until the
windows are full or their lower ends are reached.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

#: Anchors held by a task at a time, and rows that a cell is planned for.
ANCHORS, ROWS = 16_384, 65_536
#: Rows and anchors scored together, dimensions accumulated between two rounds of pruning.
TILE_ROWS, TILE_ANCHORS, GROUP = 2_048, 1_024, 16
#: Thresholds of the rounds for positives, as shares of the largest score the norms allow; the last round takes all.
POSITIVE_LADDER = (0.4, 0.2)
#: Thresholds of the rounds for negatives, as shares of the window's upper end; the last round goes to its lower end.
NEGATIVE_LADDER = (0.85, 0.65)
POSITIVES, NEGATIVES = 5, 3
#: The window of a negative's score: so many hundredths of the positive's score.
LOW, HIGH = 50, 95
SCALE = 256
EVERYTHING = -(1 << 62)
#: Bounds are sums of floats; this much is allowed for their rounding.
SLACK = 1e-6

HITS = "anchor long, slot int, places int, score long, vec_id long, row long"


class Block:
    """Anchors of a cell as arrays, with the windows each asks for: scores in [low, high], of its own label or of others."""

    def __init__(self, rows: list[tuple]):
        self.row = np.array([r[0] for r in rows], np.int64)
        self.label = np.array([r[1] for r in rows], np.int64)
        width = max((len(r[2]) for r in rows), default=0)
        self.vector = np.zeros((len(rows), width), np.int64)
        for i, r in enumerate(rows):
            self.vector[i, : len(r[2])] = r[2]
        self.windows = [r[3] for r in rows]
        self.low = np.array([min(w[1] for w in x) for x in self.windows], np.int64)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of ``a`` with all rows of ``b``."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    raise OverflowError("scores of these vectors don't fit 64 bits")


def threshold_pairs(anchors: np.ndarray, low: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row and exact score of every pair that scores at least the anchor's ``low``.

    Dimensions are taken from the last to the first; ``first[r]`` is the dimension from which row ``r`` is indexed.
    """
    width = max(anchors.shape[1], rows.shape[1])
    a, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (anchors, rows))
    # dimensions of most weight last: they are accumulated first, and the prefixes left out are long
    order = np.argsort((x.astype(np.float64) ** 2).sum(axis=0), kind="stable")
    a, x = a[:, order], x[:, order]
    # norms of prefixes, rounded up a little so that no bound is below its true value
    head_a, head_x = (np.sqrt(np.pad(np.cumsum(m.astype(np.float64) ** 2, axis=1), ((0, 0), (1, 0)))) * (1 + 1e-12) for m in (a, x))
    need = (low / np.maximum(head_a[:, -1], 1e-300)).min() if len(a) and (low > 0).all() else 0.0
    first = (head_x[:, 1:] < need).sum(axis=1)  # prefixes of this length can't reach any threshold alone
    keep = np.flatnonzero(first < width) if need > 0 else np.arange(len(x))
    keep = keep[np.argsort(first[keep], kind="stable")]
    x, head_x, first = x[keep], head_x[keep], first[keep]
    score = np.zeros((len(a), len(x)), np.int64)
    who = np.arange(len(a))

    def reach(lead: np.ndarray) -> np.ndarray:
        """Most that the first ``lead`` dimensions of each row can add for each anchor: the product of their norms."""
        return head_a[who[:, None], lead] * head_x[np.arange(len(lead)), lead]

    for end in range(width, 0, -GROUP):
        start = max(end - GROUP, 0)
        listed = int(np.searchsorted(first, end, side="left"))  # rows with a posting in these dimensions
        part = x[:listed, start:end].copy()
        part[np.arange(start, end) < first[:listed, None]] = 0  # not indexed
        score[:, :listed] += _product(a[who, start:end], part)
        if start == 0 or not score.size:
            break
        alive = score + reach(np.maximum(start, first)) + SLACK >= low[who][:, None]
        rows_alive, who_alive = alive.any(axis=0), alive.any(axis=1)
        if rows_alive.mean() < 0.7 or who_alive.mean() < 0.7:
            score = score[np.ix_(who_alive, rows_alive)]
            x, head_x, first, keep, who = x[rows_alive], head_x[rows_alive], first[rows_alive], keep[rows_alive], who[who_alive]
    # pairs that may still reach the threshold get the dimensions that the index left out
    i, j = np.nonzero(score + reach(first) + SLACK >= low[who][:, None])
    total = score[i, j]
    for lead in np.unique(first[j]) if len(j) else ():
        at = first[j] == lead
        if lead:
            total[at] += np.einsum("ij,ij->i", a[who[i[at]], :lead], x[j[at], :lead])
    good = total >= low[who[i]]
    return who[i[good]], keep[j[good]], total[good]


def _best_of_windows(block: Block, pair: tuple, label: np.ndarray, ids: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For every window of every anchor the best pairs of this tile, as many as it has places."""
    who, j, score = pair
    other = block.label[who] != label[j]
    own = ~other & (block.row[who] != row[j])
    for wanted, side in ((0, own), (1, other)):
        a, r, s = who[side], j[side], score[side]
        order = np.lexsort((row[r], ids[r], -s, a))
        a, r, s = a[order], r[order], s[order]
        starts = np.searchsorted(a, np.arange(len(block.row) + 1))
        for i in np.unique(a):
            mine = -s[starts[i] : starts[i + 1]]
            for slot, low, high, places, of_others in block.windows[i]:
                if of_others != wanted:
                    continue
                begin = np.searchsorted(mine, -high, side="left")
                end = min(np.searchsorted(mine, -low, side="right"), begin + places)
                if end > begin:
                    at = starts[i] + np.arange(begin, end)
                    yield np.full(len(at), block.row[i]), np.full(len(at), slot), np.full(len(at), places), s[at], ids[r[at]], row[r[at]]


def _hits_of(batches) -> Iterator[pa.RecordBatch]:
    """A partition's cells one after another: first a cell's anchors, then its rows."""
    cell, anchors, block = None, [], None
    kinds = {"long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in HITS.split(", "))])

    def scored(b: pa.RecordBatch) -> pa.RecordBatch:
        values = b.column("vector")
        lengths = np.diff(values.offsets.to_numpy())
        flat = values.flatten().to_numpy()
        vectors = np.zeros((b.num_rows, int(lengths.max(initial=0))), np.int64)
        vectors[np.arange(vectors.shape[1]) < lengths[:, None]] = flat
        label, ids, row = (b.column(c).to_numpy() for c in ("label", "tie", "row"))
        out = []
        for lo in range(0, b.num_rows, TILE_ROWS):
            part = slice(lo, lo + TILE_ROWS)
            for at in range(0, len(block.row), TILE_ANCHORS):
                w, j, s = threshold_pairs(block.vector[at : at + TILE_ANCHORS], block.low[at : at + TILE_ANCHORS], vectors[part])
                out.extend(_best_of_windows(block, (w + at, j, s), label[part], ids[part], row[part]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for b in batches:
        cells, is_row = b.column("cell").to_numpy(), b.column("is_row").to_numpy(zero_copy_only=False).astype(bool)
        edges = [0, *(np.flatnonzero((np.diff(cells) != 0) | (np.diff(is_row.astype(int)) != 0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo == hi:
                continue
            part = b.slice(lo, hi - lo)
            if cells[lo] != cell:
                cell, anchors, block = cells[lo], [], None
            if not is_row[lo]:
                for row, label, vector, windows in zip(*(part.column(c).to_pylist() for c in ("row", "label", "vector", "windows")), strict=True):
                    anchors.append((row, label, vector, [(w["slot"], w["low"], w["high"], w["places"], w["of_others"]) for w in windows]))
            elif anchors:
                block = block or Block(anchors)
                yield scored(part)


WINDOW = "struct<slot: int, low: long, high: long, places: int, of_others: int>"


def search_windows(rows: DataFrame, asked: DataFrame, n_rows: int) -> DataFrame:
    """The best rows of each asked window: ``anchor, slot, places, score, vec_id, row``, at most ``places`` a window; ``vec_id`` is the tie column.

    ``rows`` has row, vec_id, tie, label, vector; ``asked`` has row, label, vector and an array of windows.
    """
    spark = rows.sparkSession
    blocks = max(1, -(-asked.count() // ANCHORS))
    lanes = max(-(-n_rows // ROWS), -(-2 * spark.sparkContext.defaultParallelism // blocks))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    block, lane = F.pmod(F.xxhash64("row", F.lit("block")), F.lit(blocks)), F.pmod(F.xxhash64("row", F.lit("lane")), F.lit(lanes))
    a = asked.select("row", "label", "vector", "windows", block.alias("block"), numbers(lanes).alias("lane")).withColumn("is_row", F.lit(0))
    r = rows.select("row", "label", "vector", "tie", numbers(blocks).alias("block"), lane.alias("lane")).withColumn("is_row", F.lit(1))
    cells = a.unionByName(r, allowMissingColumns=True).withColumn("cell", F.col("block") * lanes + F.col("lane")).drop("block", "lane")
    hits = cells.repartition("cell").sortWithinPartitions("cell", "is_row").mapInArrow(_hits_of, HITS)
    best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")
    return hits.withColumn("rank", F.row_number().over(best)).where("rank <= places").drop("rank")


def _rounds(rows: DataFrame, anchors: DataFrame, open_windows: DataFrame, ladder: list, n_rows: int) -> DataFrame:
    """Fill windows (anchor, slot, low, high, places, of_others) round by round; hits of all rounds.

    ``ladder`` has an expression for each round's threshold; a last round goes to the windows' lower ends. What a round
    finds lies above all that later rounds can find.
    """
    found = []
    for step in [*ladder, None]:
        if open_windows.isEmpty():
            break
        floor = F.col("low") if step is None else F.least("high", F.greatest("low", step.cast("long")))
        look = open_windows.withColumn("floor", floor)
        asked = (
            look.groupBy("anchor")
            .agg(F.collect_list(F.struct("slot", F.col("floor").alias("low"), "high", "places", "of_others").cast(WINDOW)).alias("windows"))
            .join(anchors, F.col("anchor") == F.col("row"))
            .select("row", "label", "vector", "windows")
        )
        hits = scratch(search_windows(rows, asked, n_rows), "negatives-hits")
        found.append(hits)
        if step is not None:
            got = hits.groupBy("anchor", "slot").agg(F.count("*").cast("int").alias("got"))
            left = look.join(got, ["anchor", "slot"], "left").withColumn("places", F.col("places") - F.coalesce("got", F.lit(0)))
            left = left.where("places > 0 and floor > low").withColumn("high", F.col("floor") - 1).drop("got", "floor")
            open_windows = scratch(left, "negatives-open")
    out = found[0] if found else rows.sparkSession.createDataFrame([], HITS)
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def mine_hard_negatives(rows: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """Rows ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``vec_id, label, vector``.

    ``vector`` holds integers; scores are integer inner products, where a shorter vector ends in zeros. An anchor is no
    positive of itself, but a repeated row with its id is. A null label or vector, or a null component, takes no part; a
    null ``vec_id`` comes last among ties; a vector without components scores zero; no rows give no rows; other columns
    are not read. Scores beyond 64 bits raise an error.
    """
    usable = rows.where("label is not null and vector is not null").where(~F.exists("vector", lambda x: x.isNull()))
    tie = F.coalesce(F.col("vec_id").cast("long"), F.lit(2**63 - 1)).alias("tie")
    base = scratch(
        usable.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), tie, F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector")),
        "negatives-rows",
    )
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x))
    n_rows, longest = base.agg(F.count("*"), F.max(norm)).first()
    anchors = base.where(is_anchor).select("row", "label", "vector")
    best = F.col("norm") * F.lit(float(longest or 0.0))
    first = anchors.select(F.col("row").alias("anchor"), F.lit(0).alias("slot"), F.lit(EVERYTHING).alias("low"), F.lit(-EVERYTHING).alias("high"), F.lit(positives).alias("places"), F.lit(0).alias("of_others"), norm.alias("norm"))
    hits = _rounds(base, anchors, first, [best * share for share in POSITIVE_LADDER], n_rows)
    # the ties column stands for the id: a null id is its largest value
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row"))
    chosen = scratch(hits.select("anchor", rank.cast("int").alias("slot"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")), "negatives-positives")
    # whole bounds: the lower one rounded up, the upper one down
    low = F.expr(f"(positive_score * {LOW} + pmod(-positive_score * {LOW}, 100)) div 100")
    high = F.expr(f"(positive_score * {HIGH} - pmod(positive_score * {HIGH}, 100)) div 100")
    windows = chosen.select("anchor", "slot", low.alias("low"), high.alias("high"), F.lit(negatives).alias("places"), F.lit(1).alias("of_others")).where("low <= high")
    windows = windows.withColumn("top", F.col("high"))
    found = _rounds(base, anchors, windows, [F.col("top") * share for share in NEGATIVE_LADDER], n_rows)
    place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row"))
    named = lambda c: F.when(F.col(c) != 2**63 - 1, F.col(c))
    return (
        found.withColumn("rank", place.cast("int"))
        .join(chosen, ["anchor", "slot"])
        .join(base.where(is_anchor).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
        .select("anchor_id", named("positive_id").alias("positive_id"), "rank", named("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def scaled(embeddings: DataFrame) -> DataFrame:
    """Labels with every seventh id moved on by one, and components times 256, cut down to whole numbers.

    Vectors with a null or non-finite component are null.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.select("vec_id", label.alias("label"), F.when(~F.exists(x, odd), F.transform(x, lambda v: F.floor(v * SCALE))).alias("vector"))


def op13_hard_negative_mining(spark, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return mine_hard_negatives(scaled(embeddings), F.col("vec_id") % 50 == 0)
