"""Containment and prefix joins against all pairs, and the number of pairs that they look at."""

import random

import pytest
from pyspark.sql import functions as F

from prospectra.operators import textjoin


@pytest.mark.parametrize("gram", [1, 3, 4])
def test_contained_matches_all_pairs(spark, gram):
    rng = random.Random(gram)
    texts = ["".join(rng.choice("abc é") for _ in range(rng.randint(0, 9))) for _ in range(150)] + [None, "", "abc", "漢字漢字", "xx漢字漢字yy"]
    needles, hays = texts[::2] + ["abc", "x" * 500], texts[1::2] + ["abc", "abc", "y" + "x" * 600]
    frame = lambda rows, c: spark.createDataFrame([(r, 1) for r in rows], f"{c} string, gram int")
    got = sorted((r.needle, r.hay) for r in textjoin.contained(frame(needles, "needle"), frame(hays, "hay"), gram).collect())
    assert got == sorted({(n, h) for n in needles for h in hays if n and h and n in h})
    assert textjoin.contained(frame([], "needle"), frame(hays, "hay")).count() == 0
    assert textjoin.contained(frame(needles, "needle"), frame([], "hay")).count() == 0


def test_names_that_begin_alike_meet_few(spark):
    """Ten thousand names with one beginning: by that beginning they would make a hundred million pairs."""
    n = 10_000
    name = F.concat(F.lit("the great company of "), F.format_string("%05d", F.pmod(F.xxhash64("id"), F.lit(100_000))), F.lit(" and sons"))
    names = spark.range(n).select(name.alias("needle"))
    hays = names.select(F.concat("needle", F.lit(" limited")).alias("hay"))
    pairs = textjoin.candidate_pairs(names, hays).count()
    found = textjoin.contained(names, hays).count()
    assert found == names.distinct().count() and pairs < 40 * n


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_prefixes_match_all_pairs(spark, parts):
    rng = random.Random(parts)
    word = lambda n: "".join(rng.choice("ab-é") for _ in range(rng.randint(0, n)))
    names = [(word(8), i) for i in range(400)] + [(None, 1), ("", 2), ("abab", 900), ("abab", 800), ("\U0010ffffz", 5), ("zz", None), ("zzz", 77)]
    keys = [word(5) for _ in range(80)] + [None, "", "nothing", "abab", "\U0010ffff", "z", "a", "a"]
    got = textjoin.first_with_prefix(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame(names, "name string, id long").repartition(4), parts)
    want = {k: min(i for n, i in names if n and i is not None and n.startswith(k)) for k in keys if k and any(n and i is not None and n.startswith(k) for n, i in names)}
    assert {r.key: r.id for r in got.collect()} == want and len(want) > 20
    assert textjoin.first_with_prefix(spark.createDataFrame([], "key string"), spark.createDataFrame([], "name string, id long"), parts).count() == 0
