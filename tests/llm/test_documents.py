"""Document operators on awkward rows: nulls, empty and long texts, repeated rows, ties, clashing columns, no rows."""

import base64
import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
import xxhash
from pyspark.sql import functions as F

from prospectra.llm import bpe, line_dedup, mixing, quality_rules, sharding, simhash, suffix_dedup

WORDS = [f"w{i}{chr(97 + i % 26)}é" for i in range(400)]
LONG = " ".join(WORDS[i * i % 397] + str(i % 83) for i in range(3000))
PASSAGE = " ".join(WORDS[(7 * i) % 400] for i in range(120))
ROWS = [
    (1, "s1", "The quick Brown fox\njumps over the lazy dog, and then it sleeps all day long."),
    (2, "s1", "The quick Brown fox\njumps over the lazy dog, and then it sleeps all day long."),
    (3, "s2", "a completely different opening line of this text here\njumps over the lazy dog, and then it sleeps all day lang."),
    (4, None, None),
    (5, "s2", ""),
    (6, "s1", " \n\t "),
    (7, "s3", LONG),
    (7, "s3", LONG),
    (8, "s3", PASSAGE + " tail one"),
    (9, "s1", "head " + PASSAGE),
    (None, "s1", "no id here but some words that nobody else has at all"),
    (11, "s1", "漢字🙂 don't  stop\r\n\x0b 123!?"),
    (12, "s9", "spam %%% ### spam"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, s, t, None, k, k * 2, "x") for k, (i, s, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, lang string, n_chars int, slot int, kept string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0).where("doc_id < 0")


def texts(rows=ROWS):
    return [(i, t or "") for i, _, t in rows]


def test_sharding_is_minimax_and_keeps_copies_together(docs, empty):
    got = sharding.shard_documents(docs, shards=4).collect()
    assert len(got) == len(ROWS)
    by_crc, sizes, slots = {}, Counter(), {}
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        by_crc.setdefault((r.text_crc32, r["size"]), set()).add(r.shard)
        sizes[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(v) == 1 for k, v in by_crc.items() if k[1] > 1)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(sizes.values()) == 2 * (len(LONG.encode()) + 1)  # the group that cannot be split
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_capacity_matches_brute_force(spark):
    sizes = [(37 * i * i) % 211 + 1 for i in range(300)]
    ends, total = [], 0
    for s in sizes:
        total += s
        ends.append((total,))

    def shards(cap):
        n, now = 1, 0
        for s in sizes:
            if s > cap:
                return 10**9
            if now + s > cap:
                n, now = n + 1, 0
            now += s
        return n

    best = next(c for c in range(1, total + 1) if shards(c) <= 7)
    old, sharding.SUMMARY_ROWS = sharding.SUMMARY_ROWS, 16
    try:
        cuts = sharding.minimax_cuts(spark.createDataFrame(ends, "cum long"), total, 7)
    finally:
        sharding.SUMMARY_ROWS = old
    assert cuts[-1] == total and max(b - a for a, b in zip([0, *cuts], cuts, strict=False)) == best


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_brute_force(docs, empty):
    got = simhash.simhash_components(docs).collect()
    rows = [(i, brute_fingerprint(t)) for i, t in texts()]
    want = []
    for i, fp in rows:
        group, todo = {fp}, [fp]
        while todo:
            x = todo.pop()
            for _, y in rows:
                if y not in group and bin(x ^ y).count("1") <= 4:
                    group.add(y)
                    todo.append(y)
        want.append((i, fp, min((j for j, f in rows if f in group and j is not None), default=None)))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert simhash.simhash_components(empty).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and ids.count(7) == 1 and 4 in ids and 5 not in ids


def test_simhash_pieces_of_a_long_text(monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 64)
    assert simhash.fingerprint(LONG.encode()) == brute_fingerprint(LONG)


def test_line_dedup(docs, empty):
    got = {(r.doc_id, r.n_removed): r for r in line_dedup.remove_repeated_lines(docs).collect()}
    assert got[(1, 0)].text == ROWS[0][2]
    assert got[(2, 1)].text == "The quick Brown fox"  # the first line is too short to be compared
    assert got[(3, 1)].text == "a completely different opening line of this text here"  # one letter apart
    assert got[(4, 0)].text is None and got[(4, 0)].n_lines == 0
    assert got[(5, 0)].text == "" and got[(7, 0)].text == LONG
    assert line_dedup.remove_repeated_lines(empty).count() == 0
    assert line_dedup.dedup_lines(docs).columns == docs.columns


def test_line_dedup_of_short_lines(spark):
    lines = ["Accept all cookies", "}", "go on", "another text of a page that has more than thirty-two characters"]
    rows = [(i, "\n".join([*lines[:3], f"{i} {chr(97 + i) * 9} {lines[3][i:]}"])) for i in range(5)] + [(9, "Accept all cookie!\nAccept no cookies\ngo in")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.remove_repeated_lines(docs, short_lines=True).collect()}
    assert got[0].n_removed == 0 and got[0].text == rows[0][1]
    assert all(got[i].n_removed == 2 and got[i].text == "\n".join(["}", rows[i][1].split("\n")[3]]) for i in range(1, 5))
    assert got[9].text == "Accept no cookies\ngo in"
    assert Counter(r.text.count("Accept") for r in line_dedup.dedup_lines(docs).collect()) == Counter({1: 2, 0: 4})


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def allowed(a, b):
    short, long = sorted((len(a), len(b)))
    tau = 2 if short >= 32 else 1 if short >= 16 and long <= 32 else 0
    return long - short <= tau and edits(a, b) <= tau


def random_lines():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeé 漢🙂") for _ in range(n)).strip() for n in (12, 16, 17, 31, 31, 32, 32, 33, 34, 48, 60)]
    base += ["one very common beginning of a line " + "".join(rng.choice("xyz") for _ in range(9)) for _ in range(60)]
    out = []
    for _ in range(320):
        line = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at, kind = rng.randrange(len(line)), rng.random()
            line[at : at + (kind > 0.3)] = [rng.choice("abq")] if kind > 0.3 and kind < 0.8 or kind <= 0.3 else []
        out.append("".join(line).strip(" "))
    return out


def test_line_dedup_matches_brute_force(spark):
    lines = random_lines()
    rows = [(i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    distinct = sorted(set(lines))
    near = {x: [y for y in distinct if x != y and allowed(x, y)] for x in distinct}
    levels = line_dedup._levels(2, 32, True)
    want = {(x, y) for x in distinct for y in near[x] if x < y}
    ids = {x: tuple(r) for x, r in zip(distinct, [r.i for r in spark.createDataFrame([(k, x) for k, x in enumerate(distinct)], "k int, line string").orderBy("k").select(line_dedup._line_id(F.col("line")).alias("i")).collect()], strict=True)}
    for cell in (3, 1024):
        found = {frozenset((tuple(r.a), tuple(r.b))) for r in line_dedup.similar_lines(line_dedup.lines_of(docs, 16), levels, cell).collect()}
        assert found == {frozenset((ids[x], ids[y])) for x, y in want}
    group = {}
    for x in distinct:
        if x not in group:
            todo = [x]
            while todo:
                y = todo.pop()
                if y not in group:
                    group[y] = x
                    todo += near[y]
    seen, expected = set(), []
    for i, text in rows:
        kept = []
        for line in text.split("\n"):
            if group[line] not in seen or not re.search(r"\w", line):
                kept.append(line)
            seen.add(group[line])
        expected.append((i, "\n".join(kept), 4 - len(kept)))
    got = line_dedup.remove_repeated_lines(docs, short_lines=True)
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got.collect()) == expected
    assert sum(n for _, _, n in expected) > 50 and len(want) > 50


def test_line_dedup_writes_few_rows_for_unlike_lines(spark, monkeypatch):
    rng, wrote, write = random.Random(8), Counter(), line_dedup.scratch

    def counted(df, name):
        out = write(df, name)
        wrote[name] += out.count()
        return out

    monkeypatch.setattr(line_dedup, "scratch", counted)
    lines = ["".join(rng.choice("abcdefghij klmnopé") for _ in range(60)).strip() for _ in range(200)]
    docs = spark.createDataFrame([(i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(50)], "doc_id long, text string")
    assert line_dedup.remove_repeated_lines(docs, short_lines=True).agg(F.sum("n_removed")).first()[0] == 0
    assert sum(wrote.values()) <= 2 * len(lines), wrote  # some eleven keys a line are made


def test_line_dedup_across_one_byte_and_longer_characters(spark):
    base = "the menu of the cafe on the corner of the long street"
    other = base.replace("cafe", "café")
    short = "cafe on the corner"
    docs = spark.createDataFrame([(1, f"{base}\n{short}"), (2, f"{other}\n{other[:-1]}\ncafé on the corner\né{base}"), (3, base.replace("cafe", "カフエ").replace("e", "é"))], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.remove_repeated_lines(docs, short_lines=True).collect()}
    assert [(got[i].n_lines, got[i].n_removed, got[i].text) for i in (1, 2)] == [(2, 0, f"{base}\n{short}"), (4, 4, "")]
    assert got[3].n_removed == 0 and got[3].n_lines == 1


def test_edit_distance_band(spark):
    pairs = [("kitten sitting", "kitten sittin"), ("abcdef", "abdcef"), ("abcdef", "bcdefg"), ("aaaaaa", "aaaa"), ("abcdef", "uvwxyz"), ("a b c d", "a b c  d"), ("x y z", "x z")]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select(line_dedup.within_edits(F.col("a"), F.col("b"), 2).alias("g"), (F.levenshtein("a", "b") <= 2).alias("e")).collect()
    assert [r.g for r in rows] == [r.e for r in rows]


def brute_statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(g)
    covered = {k for i, x in enumerate(g) if c[x] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(map(text.count, "#*$%&|<>")), dup, len(covered)


def test_quality_statistics_and_rules(spark, docs, empty):
    extra = spark.createDataFrame([(20, "a b c\na b c\n\n \na b c d a b c"), (21, "x x x x x")], "doc_id long, text string")
    frame = docs.select("doc_id", "text").unionByName(extra)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.text_statistics(frame).collect())
    assert got == Counter((i, *brute_statistics(t or "")) for i, t in [*texts(), *((r.doc_id, r.text) for r in extra.collect())])
    rows = [{**dict.fromkeys(quality_rules.RATIOS, 0.1), "symbols_per_word": x / 100, "bad": int(x > 40)} for x in range(100)]
    rules = quality_rules.learn(rows * 3)
    assert rules.rules and all((not all(c.holds(r) for c in rule)) or r["bad"] for rule in rules.rules for r in rows)
    assert quality_rules.learn([]).rules == []
    labels = spark.createDataFrame([(1, 1), (7, None), (None, 0)], "doc_id long, quality int")
    out = quality_rules.judge_quality(docs, quality_rules.fit_rules(docs, labels))
    assert {r.doc_id for r in out.where("kept").collect()} == {7, 8, 9}
    assert quality_rules.filter_quality(docs, labels).columns == docs.columns
    assert quality_rules.judge_quality(empty, rules).count() == 0


def test_mixing_places_every_row_once(docs, empty):
    got = mixing.place_rows(docs, block_rows=2).collect()
    assert sorted(r.mix_position for r in got) == list(range(len(ROWS)))
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(docs, {"s1": 3.0, "s2": 1.0}).count() == len(ROWS)
    assert mixing.place_rows(empty).count() == 0


def fluid(rows, weights, block_rows, slots):
    """Blocks due to each source after 0, 1, ... slots, in exact fractions, when a used-up source leaves its part to the others."""
    left = {s: Fraction(-(-n // block_rows)) for s, n in rows.items() if n}
    done, out = dict.fromkeys(left, Fraction(0)), [dict.fromkeys(left, Fraction(0))]
    for _ in range(slots):
        rest = Fraction(1)
        while rest and (open_ := [s for s in left if done[s] < left[s]]):
            total = sum(Fraction(weights[s]) for s in open_)
            step = min([rest, *((left[s] - done[s]) * total / Fraction(weights[s]) for s in open_)])
            for s in open_:
                done[s] += step * Fraction(weights[s]) / total
            rest -= step
        out.append(dict(done))
    return out


def test_schedule_stays_within_a_block_of_the_weights():
    rows = {"a": 500, "b": 130, "c": 71, "d": 3, "e": 1}
    for weights in ({s: n**0.5 for s, n in rows.items()}, {"a": 0.1, "b": 5.0, "c": 1e-3, "d": 1 / 3, "e": 7.0}):
        plan = list(mixing.schedule(rows, weights, 2))
        due, placed = fluid(rows, weights, 2, len(plan)), Counter()
        for t, (s, k, _) in enumerate(plan):
            assert k == placed[s]
            placed[s] += 1
            assert all(abs(placed[x] - due[t + 1][x]) < 1 for x in rows)
        sizes = {(s, k): min(2, rows[s] - 2 * k) for s, k, _ in plan}
        assert len(sizes) == len(plan) and sum(sizes.values()) == sum(rows.values())
        assert [x[2] for x in plan] == [sum(sizes[y[:2]] for y in plan[:t]) for t in range(len(plan))]


def test_schedule_of_a_large_table_stays_within_a_block():
    rows = {"a": 50_000_000, "b": 13_000_000, "c": 7_001_000, "d": 123_000}
    share, size = {s: n**0.5 for s, n in rows.items()}, 1024
    total, placed = sum(share.values()), Counter()
    for t, (s, _, _) in enumerate(mixing.schedule(rows, share, size), 1):
        placed[s] += 1
        if placed[s] * size >= rows[s]:  # until the first source is used up
            break
        assert all(abs(placed[x] - t * share[x] / total) < 1 for x in rows)
    assert t > 300


def test_rows_are_placed_as_scheduled(spark):
    rows = [(i, f"s{i * i % 7 % 3}" if i % 11 else None, f"text {i % 50}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    h1, h2 = mixing.two_hashes(F.col("doc_id"), F.col("text"))
    keyed = {r.doc_id: (r.h1 % (1 << 64) >> 54, r.h1, r.h2) for r in docs.select("doc_id", h1.alias("h1"), h2.alias("h2")).collect()}
    for max_blocks in (1 << 19, 30):
        size = max(8, -(-400 // max_blocks))
        got = {r.doc_id: r for r in mixing.place_rows(docs, max_blocks=max_blocks).collect()}
        members = {}
        for i, s, _ in rows:
            members.setdefault("n:" if s is None else f"s:{s}", []).append(i)
        counts = {s: len(x) for s, x in members.items()}
        for s, k, start in mixing.schedule(counts, {s: n**0.5 for s, n in counts.items()}, size):
            block = sorted(members[s], key=keyed.get)[k * size : (k + 1) * size]
            assert [(got[i].mix_source, got[i].mix_block, got[i].mix_position) for i in block] == [(s, k, start + j) for j in range(len(block))]


def test_mixing_gives_every_one_of_many_sources_its_share(spark):
    """Each of 1,000 equal sources has one block of two in the first half of the mix, under its own name."""
    docs = spark.range(1000 * 16).select(F.col("id").alias("doc_id"), F.concat(F.lit("src"), F.col("id") % 1000).alias("source"), F.col("id").cast("string").alias("text"))
    got = mixing.place_rows(docs, {None: 1.0}).select("source", "mix_source", "mix_position").collect()
    assert all(r.mix_source == f"s:{r.source}" for r in got)
    assert sorted(r.mix_position for r in got) == list(range(16000))
    assert set(Counter(r.source for r in got if r.mix_position < 8000).values()) == {8}


def test_last_stage_has_the_place_in_the_mix_of_many_files(spark, tmp_path):
    import corpus_pipeline

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("lang"), (F.col("id") % 7 % 3).cast("string").alias("source"), F.concat(F.lit("text "), "id").alias("text"))
    want = {r.doc_id: r.mix_position for r in mixing.place_rows(docs).collect()}
    path = str(tmp_path / "mix")
    corpus_pipeline.mixture(spark, docs, "").write.option("maxRecordsPerFile", 90).parquet(path)
    assert len(spark.read.parquet(path).inputFiles()) > 30
    got = corpus_pipeline.tokens(spark, spark.read.parquet(path), "").select("doc_id", "mix_position").collect()
    assert {r.doc_id: r.mix_position for r in got} == want


def brute_repeats(data):
    """(id, bytes, removed, runs, kept) by row, and the rows' (text, start) of repeated strings."""
    n = suffix_dedup.LENGTH
    count = Counter(b[i : i + n] for _, b in data for i in range(len(b) - n + 1))
    want, starts = Counter(), Counter()
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if count[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
                starts[k] += 1
        want[(i, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), bytes(x for x, g in zip(b, gone, strict=True) if not g))] += 1
    return want, starts


def removed(found):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect())


def test_repeats_match_brute_force(docs, empty):
    want, _ = brute_repeats([(i, t.encode()) for i, t in texts()])
    for piece in (suffix_dedup.PIECE, 777):
        got = removed(suffix_dedup.remove_repeats(docs, piece))
        assert got == want
        assert sum(n for k, n in got.items() if k[2]) == 4
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_repeats_within_and_between_texts(spark):
    rng = random.Random(9)
    line = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    passage, other = line(900), line(401)
    rows = [passage + line(50) + passage[:420], line(30) + passage[100:700] + other, other[:400] + "x" + other[1:], "z" * 1000, line(399), "abc" * 300, "é" * 250, other]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want, starts = brute_repeats([(i, t.encode()) for i, t in enumerate(rows)])
    assert removed(suffix_dedup.remove_repeats(docs)) == removed(suffix_dedup.remove_repeats(docs, 333)) == want
    found = suffix_dedup.sorted_repeats(docs)
    assert Counter(r.start for r in found.collect()) == starts
    assert suffix_dedup.sorted_repeats(docs.limit(0)).count() == 0


def test_repeats_with_and_without_common_groups(spark, monkeypatch):
    """One context in most rows: the same result when it is dealt over parts, when every group is, and when none is."""
    rng = random.Random(4)
    line = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    passage, rare = line(700), line(450)
    rows = [line(rng.randrange(80)) + passage + line(rng.randrange(80)) for _ in range(40)] + [passage] * 30 + [rare + "1", "2" + rare]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want, _ = brute_repeats([(i, t.encode()) for i, t in enumerate(rows)])
    for common, parts in ((2048, 128), (20, 3), (1, 2)):
        monkeypatch.setattr(suffix_dedup, "COMMON", common)
        monkeypatch.setattr(suffix_dedup, "PARTS", parts)
        assert removed(suffix_dedup.remove_repeats(docs)) == want


def test_bpe_matches_the_library(docs, empty):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.VOCABULARY), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(bpe.round_trip(docs)).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, t in texts():
        ids = library.encode_ordinary(t)
        want[(i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode()))] += 1
    assert got == want
    assert bpe.decode(bpe.encode(docs)).where("decoded <> cast(text as binary)").count() == 0
    assert bpe.round_trip(empty).count() == 0
    hard = ["a" * k for k in range(40)] + ["  x", "x  ", " \n y", "'re we'll", "\x1c \x85\xa0z", "<|endoftext|>", "ab" * 99]
    ids, lengths = bpe.encode_texts(hard, bpe.Vocabulary(ranks, public_tokenizers.PATTERN))
    at = 0
    for t, k in zip(hard, lengths, strict=True):
        assert ids[at : at + k].tolist() == library.encode_ordinary(t)
        at += k
