"""Quality rules as a learned decision list (native).

Statistics of each text are column expressions. Sequential covering learns an ordered list of threshold conjunctions that
reject, from the statistics of a bounded sample of labelled rows; the list becomes one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

#: At most so many labelled rows are used, those with the smallest hash of their id.
SAMPLE_ROWS = 6000
#: Thresholds tried for each statistic.
THRESHOLDS = 12
MAX_RULES, MAX_CONDITIONS = 12, 3
#: A rule is kept if it is right on so large a share of the rows that it covers, in the pruning part.
PRECISION, LEAST_COVER = 0.97, 5

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Name of each statistic that rules may test, as a ratio of two counts.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "shouts_per_word": ("n_shouts", "n_words"),
    "distinct_words": ("n_distinct_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def repeated_window_words(tokens: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text, the first one included."""

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            places,
            start,
            lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(acc["end"], p)).alias("n"), (p + 3).alias("end")),
            lambda acc: acc["n"],
        )

    def places(ordered: Column) -> Column:
        twin = lambda x, k: F.coalesce(F.get(ordered, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(ordered, twin), lambda x: x["i"]))

    def count(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, lambda o: covered(places(o))))

    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return let(tokens, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(let(windows(w), count)))


def _removed(text: Column, characters: str) -> Column:
    """How many of these characters a text has."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the base counts and the counts that the rules' ratios need; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    tokens = words(F.col(text_col))
    return docs.withColumns(
        {
            "n_words": F.size(tokens).cast("long"),
            "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": _removed(text, "#*$%&|<>"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": repeated_window_words(tokens).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_upper": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long"),
            "n_digits": _removed(text, "0123456789"),
            "n_shouts": _removed(text, "!?"),
            "n_distinct_words": F.size(F.array_distinct(tokens)).cast("long"),
        }
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def statistic(name: str) -> Column:
    """A statistic as the rules see it; 0 where its denominator is 0."""
    over, under = (F.col(x).cast("double") for x in RATIOS[name])
    return F.when(under == 0, F.lit(0.0)).otherwise(over / under)


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.name] >= self.threshold if self.above else row[self.name] < self.threshold

    def column(self) -> Column:
        return statistic(self.name) >= self.threshold if self.above else statistic(self.name) < self.threshold


class DecisionList:
    """Ordered rules, each a conjunction of conditions that rejects; a row that none covers is kept."""

    def __init__(self, rules: list[list[Condition]]):
        self.rules = rules

    def kept(self) -> Column:
        out = None
        for rule in self.rules:
            covers = reduce(lambda a, b: a & b, (c.column() for c in rule))
            out = F.when(covers, False) if out is None else out.when(covers, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def describe(self) -> list[str]:
        return [" AND ".join(f"{c.name} {'>=' if c.above else '<'} {c.threshold:.6g}" for c in rule) for rule in self.rules]


def _counts(rows: list[dict]) -> tuple[int, int]:
    bad = sum(r["bad"] for r in rows)
    return bad, len(rows) - bad


def _gain(before: tuple[int, int], after: tuple[int, int]) -> float:
    """FOIL's information gain of a condition for the rejected class."""
    if not after[0]:
        return 0.0
    return after[0] * (math.log2(after[0] / sum(after)) - math.log2(before[0] / sum(before)))


def _grow(rows: list[dict], candidates: list[Condition]) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS and (before := _counts(rows))[0] and before[1]:
        best, gain = None, 1e-9
        for c in candidates:
            inside = [r for r in rows if c.holds(r)]
            if (g := _gain(before, _counts(inside))) > gain:
                best, gain = c, g
        if best is None:
            break
        rule.append(best)
        rows = [r for r in rows if best.holds(r)]
    return rule


def _worth(rule: list[Condition], rows: list[dict]) -> float:
    """RIPPER's pruning value: (right - wrong) / covered."""
    bad, good = _counts([r for r in rows if all(c.holds(r) for c in rule)])
    return (bad - good) / (bad + good) if bad + good else -1.0


def learn(rows: list[dict]) -> DecisionList:
    """Sequential covering: grow a rule on two thirds of the uncovered rows, prune it on the rest, keep it if precise.

    ``rows`` hold each statistic of RATIOS and ``bad`` (0 or 1). No rows, or none of one class, give an empty list.
    """
    candidates = []
    for name in RATIOS:
        values = sorted({r[name] for r in rows})
        steps = {values[len(values) * k // (THRESHOLDS + 1)] for k in range(1, THRESHOLDS + 1)} if values else set()
        bad = sorted({r[name] for r in rows if r["bad"]})
        steps |= {bad[len(bad) * k // (THRESHOLDS + 1)] for k in range(1, THRESHOLDS + 1)} if bad else set()
        candidates += [Condition(name, above, t) for t in sorted(steps) for above in (True, False)]
    left, rules = list(rows), []
    while left and len(rules) < MAX_RULES:
        grow, prune = [r for i, r in enumerate(left) if i % 3], [r for i, r in enumerate(left) if not i % 3]
        rule = _grow(grow, candidates)
        if not rule:
            break
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda x: _worth(x, prune))
        bad, good = _counts([r for r in prune if all(c.holds(r) for c in rule)])
        all_bad, all_good = _counts([r for r in left if all(c.holds(r) for c in rule)])
        if bad < LEAST_COVER or bad < PRECISION * (bad + good) or all_bad < PRECISION * (all_bad + all_good):
            break
        rules.append(rule)
        left = [r for r in left if not all(c.holds(r) for c in rule)]
    return DecisionList(rules)


def fit_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """Learn from at most ``sample_rows`` labelled rows; a document labelled twice counts as bad if any label is 0.

    Rows that fail the base rule are left out: the list need not learn what is already decided.
    """
    sample = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.max((F.col("quality") == 0).cast("int")).alias("bad"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # sample_rows rows at most
    # the base rule is applied to the collected rows: as a filter here it would move below the join, to all documents
    columns = [statistic(n).alias(n) for n in RATIOS]
    rows = text_statistics(chosen).select("bad", base_failed().alias("failed"), *columns).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample_rows).collect()
    return learn([r.asDict() for r in rows if not r["failed"]])


def judge_quality(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """Add the statistics, ``base_failed`` and ``kept``.

    A null text has no words and fails the base rule; repeated rows get the same verdict; a null id changes nothing;
    columns of ``docs`` with a statistic's name are replaced by it.
    """
    return text_statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.kept())


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the learned list keeps, with the columns of ``docs``."""
    judged = judge_quality(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")), fit_rules(docs, labels))
    return judged.where("kept").select("row.*")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = fit_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge_quality(docs.select("doc_id", "text"), rules).select("doc_id", *BASE, "base_failed", "kept")
