"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are the words of a text and the first four, five and six letters of them, in lower case. The vocabulary keeps the
terms that tell the labels apart; documents and examples are vectors over it, weighted by 1 + ln(count) and inverse
document frequency. The examples stand in an inverted index in blocks, with the largest weight of each term in each block:
a search opens blocks by their upper bounds and ends when no unopened block can reach the k-th best. The neighbours vote
with weights that fall with distance, and the votes are calibrated on the examples themselves, each scored without its own
text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Bounds of the model: labelled texts, terms. At most so many (text, term) pairs are broadcast as their product, 16 bytes each.
EXAMPLES, TERMS = 16_384, 1_024
#: A term is kept if so many examples have it and its chi-square (one degree of freedom) against the label is so large.
LEAST_EXAMPLES, LEAST_CHI2 = 5, 30.0
PREFIXES = (4, 5, 6)
NEIGHBOURS = 15
BLOCK = 64
#: Votes weigh 1 / (distance + SOFT), where distance is 1 - cosine; PRIOR is the weight of the share of examples without any term.
SOFT, PRIOR = 0.1, 1.0
SLICE_BYTES = 4 << 20
#: Results of searches held by a task, by query vector.
CACHE = 20_000

_MULTIPLIER = 0x9E3779B97F4A7C15
_LETTERS = np.array([chr(i).isalnum() for i in range(0x10000)])
_LETTERS[ord("0") : ord("9") + 1] = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_MULTIPLIER, -1, 1 << 64)
    up, down = np.full(n, _MULTIPLIER, np.uint64), np.full(n, inverse, np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mixed(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(kind)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of every term of whole texts, repeats included; a null text has none."""
    joined = "\n".join(pc.utf8_lower(pc.fill_null(texts, "")).to_pylist())
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    lengths = pc.utf8_length(pc.fill_null(texts, "")).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(lengths + 1) - lengths - 1
    letter = _LETTERS[np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], letter.view(np.int8), [0]])))
    start, stop = edge[::2], edge[1::2]
    up, down = _powers(len(codes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    row = np.searchsorted(first, start, side="right") - 1
    rows, hashes = [row], [_mixed((sums[stop] - sums[start]) * down[start], 1)]
    for n in PREFIXES:
        long = stop - start >= n
        s = start[long]
        rows.append(row[long])
        hashes.append(_mixed((sums[s + n] - sums[s]) * down[s], n))
    return np.concatenate(rows), np.concatenate(hashes)


class Vocabulary:
    """Hashes of the kept terms, ascending, with their inverse document frequencies."""

    def __init__(self, hashes: np.ndarray, idf: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.idf = hashes[order], idf[order]
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, term and count of the vocabulary's terms in the texts, ordered by row and term."""
        row, h = term_hashes(texts)
        ok = self.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)]
        row, h = row[ok], h[ok]
        if not len(self.hashes) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        term = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        ok = self.hashes[term] == h
        keys, n = np.unique(row[ok] * len(self.hashes) + term[ok], return_counts=True)
        return keys // len(self.hashes), keys % len(self.hashes), n

    def weights(self, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Unit vector of one text on its terms."""
        w = (1 + np.log(count)) * self.idf[term]
        return w / np.sqrt((w * w).sum()) if len(w) else w


class Examples:
    """Block-max inverted index of labelled unit vectors."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        # texts whose heaviest term is the same stand together, so that block maxima are tight
        order = sorted(range(len(vectors)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]) if len(vectors[i][0]) else n_terms, i))
        self.original = np.array(order, dtype=np.int64)
        place = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        term = np.concatenate([np.zeros(0, np.int64), *(vectors[i][0] for i in order)])
        weight = np.concatenate([np.zeros(0), *(vectors[i][1] for i in order)])
        by_term = np.lexsort((place, term))
        self.place, self.weight = place[by_term], weight[by_term]
        self.blocks = max(1, -(-len(order) // BLOCK))
        cell = term[by_term] * self.blocks + self.place // BLOCK
        self.starts = np.searchsorted(cell, np.arange(n_terms * self.blocks + 1))
        self.maxima = np.zeros(n_terms * self.blocks)
        np.maximum.at(self.maxima, cell, self.weight)
        self.maxima = self.maxima.reshape(n_terms, self.blocks)

    def search(self, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of largest cosine above zero and their cosines; ties go to the smaller example number."""
        found, cosine = np.zeros(0, np.int64), np.zeros(0)
        bound = weight @ self.maxima[term] if len(term) else np.zeros(self.blocks)
        blocks = np.argsort(-bound, kind="stable")
        blocks = blocks[bound[blocks] > 0]
        at, take = 0, 2
        while at < len(blocks) and not (len(found) == k and bound[blocks[at]] < cosine[-1] - 1e-9):
            opened = blocks[at : at + take]
            at, take = at + take, take * 2
            cells = (term[:, None] * self.blocks + opened).ravel()
            n = self.starts[cells + 1] - self.starts[cells]
            posting = np.repeat(self.starts[cells] - np.cumsum(n) + n, n) + np.arange(n.sum())
            share = np.repeat(np.repeat(weight, len(opened)), n) * self.weight[posting]
            slot = np.repeat(np.tile(np.arange(len(opened)), len(term)), n) * BLOCK + self.place[posting] % BLOCK
            scores = np.round(np.bincount(slot, share, minlength=len(opened) * BLOCK), 12)
            hit = np.flatnonzero(scores)
            found = np.concatenate([found, self.original[opened[hit // BLOCK] * BLOCK + hit % BLOCK]])
            cosine = np.concatenate([cosine, scores[hit]])
            best = np.lexsort((found, -cosine))[:k]
            found, cosine = found[best], cosine[best]
        return found, cosine


class ToxicityModel:
    """Vocabulary, labelled examples and the calibration of their votes."""

    def __init__(self, vocabulary: Vocabulary, ids: np.ndarray, keys: np.ndarray, toxic: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]):
        """``keys`` are hashes of the examples' texts, ``toxic`` the shares of label 1, ``vectors`` their terms and counts."""
        self.vocabulary, self.ids, self.keys, self.toxic = vocabulary, ids, keys, toxic
        unit = [(t, vocabulary.weights(t, n)) for t, n in vectors]
        self.index = Examples(unit, len(vocabulary.hashes))
        bare = np.array([not len(t) for t, _ in vectors], dtype=bool)
        self.bare = float((toxic[bare].sum() + 0.5 * PRIOR) / (bare.sum() + PRIOR)) if len(toxic) else 0.0
        self.steps = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        self.cache: dict = {}
        votes = np.array([self.vote(t, n, int(k))[0] for (t, n), k in zip(vectors, keys, strict=True)])
        self.steps = calibration(votes[~bare], toxic[~bare])

    def vote(self, term: np.ndarray, count: np.ndarray, key: int) -> tuple[float, list[tuple[int, float, float]]]:
        """Share of the toxic votes of the neighbours, and the neighbours; a text never votes for itself or its copies."""
        found = self.cache.get(name := (term.tobytes(), count.tobytes()))
        if found is None:
            found = self.index.search(term, self.vocabulary.weights(term, count), NEIGHBOURS + 1)
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[name] = found
        other = self.keys[found[0]] != key
        near, cosine = found[0][other][:NEIGHBOURS], found[1][other][:NEIGHBOURS]
        w = 1 / (np.maximum(0, 1 - cosine) + SOFT)
        share = float(((w * self.toxic[near]).sum() + PRIOR * self.bare) / (w.sum() + PRIOR))
        return share, [(int(self.ids[i]), float(c), float(self.toxic[i])) for i, c in zip(near, cosine, strict=True)]

    def score(self, texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, list]:
        """Calibrated scores and neighbours of a batch of whole texts; a text without terms takes the share among such examples."""
        row, term, count = self.vocabulary.counts(texts)
        scores, evidence = np.full(len(texts), self.bare), [[] for _ in range(len(texts))]
        cut = np.flatnonzero(np.diff(np.concatenate([[-1], row, [-1]])))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            i = row[a]
            scores[i], evidence[i] = self.vote(term[a:b], count[a:b], int(keys[i]))
            scores[i] = np.interp(scores[i], *self.steps)
        return scores, evidence


def calibration(votes: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Monotone line from votes to shares of toxic texts: pooled adjacent violators, each pool with one clean and one toxic half-row added."""
    if not len(votes):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    values, group = np.unique(np.round(votes, 6), return_inverse=True)
    n, s = np.bincount(group).astype(float), np.bincount(group, toxic)
    pools: list[list[float]] = []  # rows, toxic rows, votes
    for v, a, b in zip(values, n, s, strict=True):
        pools.append([a, b, v * a])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    x, y = np.array([p[2] / p[0] for p in pools]), np.array([(p[1] + 0.5) / (p[0] + 1) for p in pools])
    return x, np.maximum.accumulate(y)


def held_out(doc_id) -> F.Column:
    """Rows that labels are never learned from: crc32 of the id as text is divisible by 5. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, terms: int = TERMS) -> ToxicityModel:
    """Learn from at most ``examples`` labelled ids, those with the smallest hash, and as many distinct texts of them.

    Held-out ids, null ids and null labels are not learned from; an id labelled twice is toxic if any label is 1; equal
    texts are one example, whose label is their mean; a null text is empty. Without usable labels no text has a neighbour
    and every score is zero.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") == 1).cast("double")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(examples)
    )
    texts = (
        docs.select("doc_id", text.alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # ``examples`` rows at most
        .groupBy("text")
        .agg(F.min("doc_id").alias("doc_id"), F.avg("toxic").alias("toxic"))
        .select("doc_id", "text", "toxic", F.xxhash64("text").alias("key"))
    )

    def totals(batches):
        """Examples and toxic examples by term in this partition."""
        held = {}
        for b in slices(batches, SLICE_BYTES):
            row, h = term_hashes(b.column("text"))
            order = np.lexsort((row, h))
            row, h = row[order], h[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            unique, inverse = np.unique(h[new], return_inverse=True)
            share = b.column("toxic").to_numpy()[row[new]]
            for t, n, s in zip(unique.tolist(), np.bincount(inverse, minlength=len(unique)).tolist(), np.bincount(inverse, share, minlength=len(unique)).tolist(), strict=True):
                x = held.get(t)
                held[t] = (n, s) if x is None else (x[0] + n, x[1] + s)
            if len(held) > 500_000:
                yield _totals_batch(held)
                held = {}
        yield _totals_batch(held)

    n_all, n_toxic = texts.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0.0))).first()
    n, a = F.col("n"), F.col("a")
    # 2x2 chi-square from a = toxic with the term, n = all with it
    expected = n * F.lit(n_toxic / max(n_all, 1))
    spread = expected * (1 - F.lit(n_toxic / max(n_all, 1))) * (1 - n / F.lit(max(n_all, 1)))
    kept = (
        texts.mapInArrow(totals, "term long, n long, a double")
        .groupBy("term")
        .agg(F.sum("n").alias("n"), F.sum("a").alias("a"))
        .where(n >= LEAST_EXAMPLES)
        .withColumn("chi2", F.when(spread > 0, (a - expected) * (a - expected) / spread).otherwise(0.0))
        .where(F.col("chi2") >= LEAST_CHI2)
        .orderBy(F.desc(F.round("chi2", 6)), "term")
        .limit(terms)
        .collect()
    )
    vocabulary = Vocabulary(np.array([r.term for r in kept], np.int64).view(np.uint64), np.log((1 + n_all) / (1 + np.array([r.n for r in kept], dtype=float))) + 1)

    def vectors(batches):
        for b in slices(batches, SLICE_BYTES):
            row, term, count = vocabulary.counts(b.column("text"))
            ends = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x, pa.int32())) for x in (term, count)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), b.column("toxic"), *lists], names=["doc_id", "key", "toxic", "term", "count"])

    rows = (
        texts.orderBy("key", "doc_id").limit(examples).mapInArrow(vectors, "doc_id long, key long, toxic double, term array<int>, count array<int>")
        # small integers only; the texts stay where they are
        .orderBy("key", "doc_id").collect()
    )
    pairs = [(np.array(r.term, np.int64), np.array(r["count"], np.int64)) for r in rows]
    return ToxicityModel(vocabulary, *(np.array([r[c] for r in rows], dtype) for c, dtype in (("doc_id", np.int64), ("key", np.int64), ("toxic", float))), pairs)


def _totals_batch(held: dict) -> pa.RecordBatch:
    n, a = zip(*held.values(), strict=True) if held else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(np.array(list(held), np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(a, pa.float64())], names=["term", "n", "a"])


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Rows ``doc_id, score, predicted, evidence`` for every row of ``docs``; evidence are the neighbours that voted.

    Scores are functions of the text alone. A null or empty text, or one without any term of the vocabulary, takes the
    share of toxic examples among those without terms and has no evidence; repeated rows get equal scores; ties among
    neighbours go to the smaller hash of text; no rows give no rows; columns but ``doc_id`` and ``text`` are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    struct = pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.float64())])

    def run(batches):
        model = shared.value
        for b in slices(batches, SLICE_BYTES):
            scores, evidence = model.score(b.column(1), b.column(2).to_numpy())
            near = pa.array([[{"doc_id": i, "cosine": c, "toxic": y} for i, c, y in e] for e in evidence], pa.list_(struct))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), near], names=["doc_id", "score", "predicted", "evidence"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, evidence array<struct<doc_id: long, cosine: double, toxic: double>>")


def op11_nearest_example_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", F.transform("evidence", lambda e: e["doc_id"]).alias("evidence"))
