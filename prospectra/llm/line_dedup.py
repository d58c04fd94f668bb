"""Line dedup by a segment-partition edit join (native).

Two lines within TAU edits agree on at least one of TAU + 1 segments of the shorter one, up to a small shift. Each
distinct line puts its own segments into an index keyed by length, segment and substring, and probes it, for every
length that is at most TAU shorter, with the few substrings that can match. Only keys that are met go on to the pairs. Candidates are verified by banded
bit-parallel edit distance. Of each class of linked lines the first occurrence in the corpus stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forget, let, release_shuffles, scratch, two_hashes

TAU = 2
#: Shorter lines are compared only with ``short_lines``: with one edit from SHORT_CHARS on, and exactly below.
MIN_CHARS, SHORT_CHARS = 32, 16
#: A line has a word if it has a letter or a digit.
HAS_WORD = r"[\p{L}\p{N}]"
#: Letters whose numbers tell lines apart before their distance is computed.
LETTERS = "etaoinsrhldcumfpgwybvk"
PREFIX_BITS = 18
#: Lines of a key that meet in one task.
CELL = 1024


def edit_distance_at_most(a: Column, b: Column, tau: int) -> Column:
    """Whether two strings are within ``tau`` edits.

    The band of 2 * tau + 1 diagonals around the main one is one machine word: each step compares a character of ``b``
    with the window of ``a`` that the band covers and updates the vertical differences of the column. ``a`` must be at
    least as long as ``b``, and by at most ``tau`` characters, and longer than ``tau``.
    """
    width = 2 * tau + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    inv = lambda x: x.bitwiseXOR(F.lit(full).cast("long"))
    one = lambda cond: F.when(cond, F.lit(1)).otherwise(F.lit(0))

    def run(x: Column) -> Column:
        ca, cb = x["a"], x["b"]

        def step(s: Column, i: Column) -> Column:
            match = F.lit(0).cast("long")
            for k in range(2 * tau + 1):
                same = F.when(i + (tau - k) >= 0, F.get(ca, i + (tau - k)) == F.get(cb, i))
                match = match + F.when(same, F.lit(top >> k).cast("long")).otherwise(F.lit(0).cast("long"))
            return let(F.struct(match.alias("x"), s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), s["h"].alias("h")), lambda v: after_match(v, i))

        def after_match(v: Column, i: Column) -> Column:
            x, vp, vn = v["x"], v["vp"], v["vn"]
            sum_ = (x.bitwiseAND(vp) + vp).bitwiseAND(F.lit(full).cast("long"))
            d0 = sum_.bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn)
            return let(F.struct(d0.alias("d0"), vp.alias("vp"), vn.alias("vn"), v["d"].alias("d"), v["h"].alias("h")), lambda w: after_d0(w, i))

        def after_d0(w: Column, i: Column) -> Column:
            d0, vp, vn = w["d0"], w["vp"], w["vn"]
            hp, hn = vn.bitwiseOR(inv(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)
            low = F.shiftright(d0, 1)
            diagonal = i < F.size(ca) - tau
            d = w["d"] + F.when(diagonal, one(d0.bitwiseAND(F.lit(top).cast("long")) == 0)).otherwise(one(hp.bitwiseAND(w["h"]) != 0) - one(hn.bitwiseAND(w["h"]) != 0))
            return F.struct(
                hn.bitwiseOR(inv(low.bitwiseOR(hp))).alias("vp"),
                low.bitwiseAND(hp).alias("vn"),
                d.cast("int").alias("d"),
                F.when(diagonal, w["h"]).otherwise(F.shiftright(w["h"], 1)).alias("h"),
            )

        start = F.struct(
            F.lit(((1 << (tau + 1)) - 1) << (width - tau - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(tau).alias("d"), F.lit(top >> 1).cast("long").alias("h")
        )
        return F.aggregate(F.sequence(F.lit(0), F.size(cb) - 1), start, step, lambda s: s["d"] <= tau)

    return let(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b")), run)


def _levels(tau: int, min_chars: int, short_lines: bool) -> list[tuple[int, int, int | None]]:
    """Edits allowed, and from how many characters to how many: one character more than shorter lines have, so that they meet longer neighbours."""
    return [(tau, min_chars, None), *([(min(1, tau), SHORT_CHARS, min_chars)] if short_lines else [])]


def _probes(level: int, tau: int) -> list[tuple[int, int, int, int, int, bool]]:
    """Substrings that a line is looked up by, by multi-match-aware selection: level, segments, characters that the other line is shorter, segment, shift, and whether it is a segment of the line itself."""
    parts = tau + 1
    shifts = lambda d, i: range(max(-i, d - (tau - i)), min(i, d + (tau - i)) + 1)
    return [(level, parts, d, i, s, d == s == 0) for d in range(parts) for i in range(parts) for s in shifts(d, i)]


def _keyed_lines(lines: DataFrame, levels: list[tuple[int, int, int | None]]) -> DataFrame:
    """``lid``, ``key`` and ``own`` of every probe of each distinct line. Even segments, the longer ones last."""
    n, p = F.col("n"), F.col("p")
    table = lambda rows: F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("level", "parts", "d", "i", "s", "own"), r, strict=True))) for r in rows))
    inside = [(n >= low) if high is None else n.between(low, high) for _, low, high in levels]
    every = [_probes(k, tau) for k, (tau, _, _) in enumerate(levels)]
    probes = F.when(reduce(lambda x, y: x & y, inside), table(sum(every, [])))
    for here, rows in zip(inside, every, strict=True):
        probes = probes.when(here, table(rows))
    length = n - p["d"]
    long_from = p["parts"] - length % p["parts"]
    start = (length / p["parts"]).cast("int") * p["i"] + F.greatest(p["i"] - long_from, F.lit(0)) + p["s"]
    size = (length / p["parts"]).cast("int") + F.when(p["i"] >= long_from, 1).otherwise(0)
    # where each character is a byte, segments are cut from the bytes, without counting characters from the start each time
    ascii_ = F.when(F.octet_length("line") == F.char_length("line"), F.col("line").cast("binary"))
    rows = lines.select("line").distinct().select("line", ascii_.alias("ascii"), F.xxhash64("line").alias("lid"), F.char_length("line").alias("n"))
    rows = rows.select("lid", "line", "ascii", "n", F.explode(probes).alias("p")).select("lid", "line", "ascii", "n", "p", start.alias("start"), size.alias("size"), length.alias("length"))
    rows = rows.where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= n))
    cut = lambda c: F.substring(F.col(c), F.col("start") + 1, F.col("size")).cast("binary")
    return rows.select("lid", F.xxhash64(p["level"], "length", p["i"], F.coalesce(cut("ascii"), cut("line"))).alias("key"), p["own"].alias("own"))


def _met_keys(lines: DataFrame, levels: list[tuple[int, int, int | None]]) -> DataFrame:
    """The rows of ``_keyed_lines`` whose key one line has as its own segment and another line has too, with ``n``, the rows of the key.

    The sizes of the keys need the same columns in the same places as the join, so that one exchange serves both.
    """
    keys = _keyed_lines(lines, levels).repartition("key")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("met"), F.min("lid").alias("low"), F.max("lid").alias("high"))
    return keys.join(sizes.where("met and low < high").select("key", "n").hint("shuffle_hash"), "key")


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS, short_lines: bool = False) -> DataFrame:
    """Lines of at least ``min_chars`` characters, or with ``short_lines`` also shorter ones that have a word, without the spaces at their ends: ``doc_id``, ``h1``, ``h2``, ``pos``, ``line``."""
    h1, h2 = two_hashes(F.col("doc_id"), F.col("text"))
    line = F.trim(F.col("raw"))
    compared = F.char_length("line") >= min_chars
    if short_lines:
        compared = compared | F.col("line").rlike(HAS_WORD)
    rows = docs.select("doc_id", h1.alias("h1"), h2.alias("h2"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    return rows.select("doc_id", "h1", "h2", "pos", line.alias("line")).where(compared)


def _line_id(line: Column) -> Column:
    """128 bits that stand for a line."""
    x, y = two_hashes(line)
    return F.struct(x.alias("x"), y.alias("y"))


def _tokens(line: Column) -> Column:
    """Words of a line, each with the space that follows it: joined, they are the line."""
    return F.split(line, "(?<= )")


def _letter_counts(line: Column, letters: str = LETTERS) -> Column:
    """The number of each letter, as an array."""
    return F.transform(F.array(*(F.lit(c) for c in letters)), lambda c: F.octet_length(line) - F.octet_length(F.replace(line, c, F.lit(""))))


def _letters(line: Column) -> Column:
    """The numbers of the first 16 letters modulo 16, packed in a long."""
    return F.aggregate(_letter_counts(line, LETTERS[:16]), F.lit(0).cast("long"), lambda acc, n: F.shiftleft(acc, 4).bitwiseOR((n % 16).cast("long")))


def _may_be_near(x: Column, y: Column, tau: int) -> Column:
    """An edit changes the numbers of two letters at most, by one each."""
    fifteen = F.lit(15).cast("long")
    apart = lambda i: (F.shiftrightunsigned(x, 4 * i).bitwiseAND(fifteen) - F.shiftrightunsigned(y, 4 * i)).bitwiseAND(fifteen)
    return reduce(lambda a, b: a + b, (F.least(apart(i), 16 - apart(i)) for i in range(16))) <= 2 * tau


def within_edits(a: Column, b: Column, tau: int) -> Column:
    """Whether two different lines are within ``tau`` edits; words that both start or end with are left out first."""
    agree = lambda x, y: F.array_position(F.zip_with(x, y, lambda u, v: u.eqNullSafe(v)), False) - 1
    rest = lambda x, n: F.slice(x, (n + 1).cast("int"), F.size(x))

    def ends(x: Column) -> Column:
        return let(F.struct(F.reverse(x["a"]).alias("a"), F.reverse(x["b"]).alias("b")), lambda y: let(agree(y["a"], y["b"]), lambda n: tails(y, n)))

    def tails(y: Column, n: Column) -> Column:
        return F.struct(*(F.array_join(F.reverse(rest(y[k], n)), "").alias(k) for k in "ab"))

    def decide(x: Column) -> Column:
        longer, shorter = (F.when((F.length(x["a"]) >= F.length(x["b"])) == first, x["a"]).otherwise(x["b"]) for first in (True, False))
        return let(F.struct(longer.alias("a"), shorter.alias("b")), lambda y: verdict(y["a"], y["b"]))

    def verdict(x: Column, y: Column) -> Column:
        return F.when(F.length(x) <= tau, True).when(F.length(x) - F.length(y) > tau, False).otherwise(edit_distance_at_most(x, y, tau))

    both = F.struct(_tokens(a).alias("a"), _tokens(b).alias("b"))
    starts = lambda x: let(agree(x["a"], x["b"]), lambda n: F.struct(rest(x["a"], n).alias("a"), rest(x["b"], n).alias("b")))
    return let(both, lambda x: let(starts(x), lambda y: let(ends(y), decide)))


def similar_lines(lines: DataFrame, levels: list[tuple[int, int, int | None]], cell: int = CELL) -> DataFrame:
    """Edges ``a``, ``b`` between the ids of different lines within the edits of their level.

    Only keys that some line has as its own segment and another one probes are held, with their lines. Lines that meet
    must agree in their letters before they make a pair; the lines of a key of more than ``cell`` are dealt over parts.
    """
    spark = lines.sparkSession
    held = scratch(_met_keys(lines, levels), "line-keys-met")
    release_shuffles(spark)
    ids = held.select("lid").distinct()
    # a table of the first PREFIX_BITS bits of the held ids, never above 2 ** PREFIX_BITS rows, keeps other lines out of the shuffle
    near = lines.select("line", F.xxhash64("line").alias("lid")).withColumn("prefix", F.shiftrightunsigned("lid", 64 - PREFIX_BITS))
    prefixes = F.broadcast(ids.select(F.shiftrightunsigned("lid", 64 - PREFIX_BITS).alias("prefix")).distinct())
    texts = near.join(prefixes, "prefix", "left_semi").drop("prefix").join(ids, "lid", "left_semi").distinct()
    texts = scratch(texts.withColumn("counts", _letter_counts(F.col("line"))).withColumn("letters", _letters(F.col("line"))), "met-lines")
    release_shuffles(spark)
    members = held.join(texts.select("lid", "letters"), "lid").withColumn("parts", F.ceil(F.col("n") / cell).cast("int"))
    part = F.pmod(F.xxhash64("lid"), F.col("parts")).cast("int")
    own = members.where("own").select("key", "lid", "letters", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    probing = members.select("key", F.col("lid").alias("other"), F.col("letters").alias("other_letters"), part.alias("part"))
    most = max(tau for tau, _, _ in levels)
    pairs = probing.join(own, ["key", "part"]).where((F.col("other") != F.col("lid")) & _may_be_near(F.col("letters"), F.col("other_letters"), most))
    both = scratch(pairs.select(F.least("lid", "other").alias("a"), F.greatest("lid", "other").alias("b")).distinct(), "line-candidates")
    release_shuffles(spark)
    for side in "ab":
        both = both.join(texts.select(F.col("lid").alias(side), F.col("line").alias(f"line_{side}"), F.col("counts").alias(f"counts_{side}")), side)
    apart = F.aggregate(F.zip_with("counts_a", "counts_b", lambda x, y: F.abs(x - y)), F.lit(0), lambda acc, x: acc + x)
    short, long = (f(F.char_length("line_a"), F.char_length("line_b")) for f in (F.least, F.greatest))
    similar = F.lit(False)
    for tau, low, high in reversed(levels):  # the first level that both lines belong to decides
        member = (short >= low) & (F.lit(True) if high is None else long <= high)
        similar = F.when(member, (long - short <= tau) & (apart <= 2 * tau) & within_edits(F.col("line_a"), F.col("line_b"), tau)).otherwise(similar)
    return both.where(similar).select(_line_id(F.col("line_a")).alias("a"), _line_id(F.col("line_b")).alias("b"))


def repeated_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, short_lines: bool = False) -> DataFrame:
    """Places of the lines to remove: ``h1``, ``h2`` (hashes of id and text) and the sorted array ``drop``.

    The first occurrence of a class is the one with the smallest id, text hash and line number; rows without an id come last.
    """
    levels = _levels(tau, min_chars, short_lines)
    edges = similar_lines(lines_of(docs, min(low for _, low, _ in levels)), levels)
    roots = connected_components(edges).select(F.col("node").alias("lid"), F.col("component").alias("root"))
    release_shuffles(docs.sparkSession)
    lines = lines_of(docs, min_chars, short_lines).select("doc_id", "h1", "h2", "pos", _line_id(F.col("line")).alias("lid"))
    places = scratch(lines.join(roots, "lid", "left").select("doc_id", "h1", "h2", "pos", F.coalesce("root", "lid").alias("class")), "line-places")
    release_shuffles(docs.sparkSession)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2", "pos")
    # written, so that the join reads tables on both sides and a class of very many places can be split
    first = scratch(places.groupBy("class").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("class", "first"), "line-firsts")
    dropped = places.join(first, "class").where(~((F.col("h1") == F.col("first.h1")) & (F.col("h2") == F.col("first.h2")) & (F.col("pos") == F.col("first.pos"))))
    drops = scratch(dropped.groupBy("h1", "h2").agg(F.sort_array(F.collect_set("pos")).alias("drop")), "line-drops")
    forget(places)
    forget(first)
    return drops


def _without(text: Column, drop: Column) -> Column:
    """The text without the lines at these places."""

    def kept(x: Column) -> Column:
        between = lambda at, i: F.slice(x["lines"], at + 2, F.get(x["at"], i + 1) - at - 1)
        return F.array_join(F.flatten(F.transform(F.slice(x["at"], F.lit(1), F.size(x["at"]) - 1), between)), "\n")

    lines = F.split(text, "\n", -1)
    ends = F.concat(F.array(F.lit(-1)), drop, F.array(F.size(lines)))
    return let(F.struct(lines.alias("lines"), ends.alias("at")), kept)


def remove_repeated_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, short_lines: bool = False) -> DataFrame:
    """``docs`` without lines that repeat an earlier line within ``tau`` edits, and the counts ``n_lines``, ``n_removed``.

    All rows and columns stay (columns with the names of the counts are replaced); a null text stays null with no lines;
    an empty text has one empty line; repeated rows are treated alike, as one; an empty table stays empty. Lines below
    ``min_chars`` stay unless ``short_lines`` is set: then one edit is allowed from SHORT_CHARS on and none below, and
    lines without a letter or digit stay.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    h1, h2 = two_hashes(F.col("doc_id"), F.col("text"))
    drops = repeated_lines(docs, tau, min_chars, short_lines)
    release_shuffles(docs.sparkSession)
    rows = docs.select(F.struct(*keep).alias("row"), h1.alias("h1"), h2.alias("h2")).join(drops, ["h1", "h2"], "left")
    text = F.when(F.col("drop").isNull(), F.col("row.text")).otherwise(_without(F.col("row.text"), F.col("drop")))
    n_lines = F.octet_length("row.text") - F.octet_length(F.replace(F.col("row.text"), F.lit("\n"), F.lit(""))) + 1
    return rows.select(
        *(text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in keep),
        F.when(F.col("row.text").isNull(), F.lit(0)).otherwise(n_lines).cast("long").alias("n_lines"),
        F.when(F.col("drop").isNull(), F.lit(0)).otherwise(F.size("drop")).cast("long").alias("n_removed"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated lines; a document that lost lines and has no word left goes."""
    found = remove_repeated_lines(docs, short_lines=True)
    left = F.length(F.translate(F.coalesce(F.col("text"), F.lit("")), " \t\n\x0b\x0c\r", "")) > 0
    return found.where((F.col("n_removed") == 0) | left).select(*docs.columns)


def op5_edit_join_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), short_lines=True)
    return found.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
