"""Toxicity: terms, index and votes against plain forms, held-out accuracy, awkward rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from prospectra.llm import toxicity

TEXTS = ["Idiot, you IDIOT! idiotic 4life", "", None, "naïve Straße\nÉCOLE école", "a1b2c3 漢字漢字漢字 x_y", "word" * 500 + " end", "🙂 smile🙂smile"]


def plain_terms(text):
    words = ["".join(g) for g in re.findall(r"((?:[^\W\d_]|[²-¾]|[\U00010000-\U0010ffff])+)", (text or "").lower())]
    return Counter(t for w in words for t in [("w", w), *((n, w[:n]) for n in toxicity.PREFIXES if len(w) >= n)])


def test_terms_are_words_and_their_beginnings():
    """Equal terms have equal hashes, others different ones, and their counts are those of a plain split."""
    row, h = toxicity.term_hashes(pa.array(TEXTS))
    plain = [plain_terms(t) for t in TEXTS]
    for i, want in enumerate(plain):
        assert sorted(Counter(h[row == i].tolist()).values()) == sorted(want.values())
    alone = {}
    for t in {t for p in plain for t in p}:
        kind, word = t
        r, one = toxicity.term_hashes(pa.array([word]))
        alone[t] = one[0] if kind == "w" else one[1 + [n for n in toxicity.PREFIXES if len(word) >= n].index(kind)]
    assert len(set(alone.values())) == len(alone)
    for i, want in enumerate(plain):
        assert Counter(h[row == i].tolist()) == Counter({alone[t]: n for t, n in want.items()})


def test_index_finds_what_a_full_product_finds():
    rng = np.random.default_rng(1)
    terms, vectors = 60, []
    for _ in range(700):
        t = np.sort(rng.choice(terms, rng.integers(0, 7), replace=False))
        w = rng.integers(1, 4, len(t)).astype(float)
        vectors.append((t, w / math.sqrt((w * w).sum()) if len(t) else w))
    vectors += vectors[:80]  # ties
    index = toxicity.Examples(vectors, terms)
    full = np.zeros((len(vectors), terms))
    for i, (t, w) in enumerate(vectors):
        full[i, t] = w
    for t, w in vectors[::9]:
        scores = np.round(full[:, t] @ w, 12) if len(t) else np.zeros(len(vectors))
        order = [i for i in np.lexsort((np.arange(len(scores)), -scores)) if scores[i] > 0]
        for k in (1, 5, 40):
            found, cosine = index.search(t, w, k)
            assert np.allclose(cosine, scores[order[:k]], atol=1e-9)
            close = len(order) > k and abs(scores[order[k - 1]] - scores[order[k]]) < 1e-9
            assert close or set(found.tolist()) == set(order[:k])


def test_calibration_is_monotone():
    rng = np.random.default_rng(2)
    votes = rng.random(500)
    x, y = toxicity.calibration(votes, (rng.random(500) < votes**2).astype(float))
    assert (np.diff(x) > 0).all() and (np.diff(y) >= 0).all() and abs(np.interp(0.9, x, y) - 0.81) < 0.15
    assert toxicity.calibration(np.zeros(0), np.zeros(0))[1].tolist() == [0.0, 1.0]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    syllables = ["ta", "ro", "mi", "ken", "sul", "va", "do", "per", "li", "no"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    docs, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        words = [word() for _ in range(rng.randint(20, 120))]
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["Grumblefoot", "zorkhead", "GRUMBLEFACE", "blastard,", "blastardly"]))
        docs.append((i, " ".join(words), "src", i % 7, "k"))
        labels.append((i, 1, int(toxic)))
    docs += [(2000, None, "s", 0, "k"), (2001, "", "s", 0, "k"), (2002, "zorkhead blastard " * 20_000, "s", 0, "k"), (None, "plain words only", "s", 0, "k"), docs[5], docs[4]]
    labels += [(4, 1, 0), (None, 1, 1), (7, 1, None), (99999, 0, 1), (2000, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, score int, key string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_scores_of_held_out_documents(corpus):
    docs, labels = corpus
    model = toxicity.fit_toxicity(docs, labels)
    rows = toxicity.score_toxicity(docs, model).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert not set(model.ids.tolist()) & set(held)
    wrong = [i for i in held if by[i][0].predicted != int(i % 4 == 0)]
    assert len(held) > 120 and len(wrong) <= 2
    assert by[2002][0].score > 0.9 and by[2000][0].score == by[2001][0].score == by[None][0].score < 0.1
    assert by[5][0].score == by[5][1].score and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    for i in held[:40]:
        for e in by[i][0].evidence:
            assert e.doc_id not in held and 0 < e.cosine <= 1
        assert by[i][0].score >= 0.5 or not by[i][0].evidence or np.mean([e.toxic for e in by[i][0].evidence]) < 0.9
    # a text never votes for itself
    assert all(e.doc_id != i for i in range(0, 900, 4) for e in by[i][0].evidence)


def test_no_labels_and_no_documents(corpus):
    docs, labels = corpus
    model = toxicity.fit_toxicity(docs, labels.where("doc_id < 0"))
    assert {r.score for r in toxicity.score_toxicity(docs, model).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.where("doc_id < 0"), model).count() == 0
    assert len(toxicity.fit_toxicity(docs.where("doc_id < 0"), labels).ids) == 0


def test_smaller_bounds_keep_to_them(corpus):
    model = toxicity.fit_toxicity(*corpus, examples=100, terms=5)
    assert len(model.ids) <= 100 and len(model.vocabulary.hashes) <= 5
