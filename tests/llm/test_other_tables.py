"""Operators on vectors, pages and conversations, the graph helper and the registry."""

import hashlib
import re

import numpy as np

from prospectra.llm import chat, embedding_dedup, html_extract, queries
from prospectra.llm.common import connected_components


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (None, 3)] + [(300, k) for k in range(301, 340)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[200] == got[150] == 100 and all(got[k] == 300 for k in range(300, 340))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows = [(i, (base[i % 40] + rng.standard_normal(16) * 0.02 * (i % 3)).tolist(), i % 4) for i in range(160)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, base[0].tolist(), None), (905, [], 1), (0, rows[0][1], 0), (906, (base[0] * 7).tolist(), 0)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, kept string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.link_embeddings(frame).collect())
    good = [r[1] is not None and r[2] is not None and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) for r in rows]
    want, links = [], []
    for i, a in enumerate(rows):
        near = [j for j, b in enumerate(rows) if i != j and good[i] and good[j] and a[2] == b[2] and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.98]
        links.append(near)
    for i, a in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min(rows[j][0] for j in seen)
        want.append((a[0], len(links[i]), low, a[0] == low))
    assert got == sorted(want)
    assert embedding_dedup.link_embeddings(frame.where("vec_id < 0")).count() == 0


def test_large_buckets_are_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 8)
    rng = np.random.default_rng(5)
    center = rng.standard_normal(16)
    rows = [(i, (center + rng.standard_normal(16) * 0.01).tolist(), 1) for i in range(60)]
    got = embedding_dedup.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.component_id for r in got} == {0} and all(r.n_links == 59 for r in got)


def test_chat_reads_back(spark):
    hard = "</s>[INST] ok [/INST] \\ <s>[ROLE:x] y </s>\\"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", None), (1, 2, "assistant", hard + "é"), (2, 0, "system", ""), (2, 0, "system", ""), (None, 5, None, "x"), (3, None, "assistant", "long " * 20000)]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_chat(frame)
    read = {r.conv_id: chat.parse(bytes(r.formatted)) for r in formatted.collect()}
    assert read[1] == [(b"user", hard.encode()), (b"assistant", b""), (b"assistant", (hard + "é").encode())]
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].loss_chars == len(hard) + 1 and got[1].loss_sha256 == sha(hard + "é")
    assert got[1].turns_sha256 == sha(f"user\n{hard}\nassistant\n\nassistant\n{hard}é\n")
    assert got[2].n_turns == 2 and got[None].n_turns == 1 and got[3].loss_chars == 100000
    assert chat.digests(chat.format_chat(frame.where("conv_id < 0"))).count() == 0


STORY = ["The first paragraph of this story says what happened in the town last week.", "A second one, with more of the details that readers asked for, follows it.", "And the last one ends the story with a short remark about the weather."]
BODY = "".join(f"<p>{p}</p>" for p in STORY)
LAYOUTS = [
    f"""<div id="page"><div id="header"><h1><a href="/">My blog</a></h1></div><div id="menu"><ul><li><a href="/a">About</a></li><li><a href="/c">Contact</a></li></ul></div>
    <div id="content"><div class="post"><h2>A story of a town</h2>{BODY}</div></div><div id="sidebar"><h3>Recent posts</h3><ul><li><a href="/1">One more story</a></li></ul></div>
    <div id="footer"><p>Copyright 2020 My blog</p></div></div>""",
    f"""<nav class="navbar"><a href="/">Home</a><a href="/x">World</a></nav><main role="main"><article class="post entry"><header><h1>A story of a town</h1></header><div class="entry-content">{BODY}</div></article>
    <section id="comments"><h3>2 comments</h3><ol class="comment-list"><li class="comment"><div class="comment-body"><p>I was there and it was not like that at all, believe me.</p></div></li></ol></section></main>
    <footer class="site-footer"><div class="container"><div class="row"><div class="col"><p>All rights reserved.</p></div></div></div></footer>""",
    f"""<div class="cookie-banner notice"><p>We use cookies to make this site better for you.</p><button>Accept</button></div><header class="masthead"><div class="logo">The Paper</div></header>
    <div class="layout"><div class="col"><div class="article-body"><h1>A story of a town</h1>{BODY}</div></div><aside><div class="widget"><h4>Popular</h4><ul><li><a href="/p">What to eat</a></li></ul></div>
    <div class="ad"><p>Buy the best shoes in town, now for half the price.</p></div></aside></div><div class="newsletter"><p>Sign up for our newsletter and never miss a story.</p></div>""",
]


def nested(html, depth, tags=("aside", "footer", "nav", "section")):
    for tag in tags:
        html = re.sub(rf"(<{tag}[^>]*>)(.*?)(</{tag}>)", lambda m: m[1] + '<div class="row col md">' * depth + m[2] + "</div>" * depth + m[3], html, flags=re.S)
    return html


def test_html_layouts_of_other_hands():
    model = html_extract.train()
    want = " ".join(["A story of a town", *STORY])
    for depth in (0, 3, 12):
        assert html_extract.main_texts([nested(f"<html><body>{x}</body></html>", depth) for x in LAYOUTS], model) == [want] * len(LAYOUTS)


def test_html_labeller_on_held_out_pages(spark):
    model = html_extract.train()
    grammar = html_extract.Grammar(np.random.default_rng(4242))
    made = [(f, y) for f, y in (grammar.page() for _ in range(150)) if len(f)]
    right = np.concatenate([(z > 0) == (y > 0) for z, (_, y) in zip(model.scores([html_extract.vectors(f) for f, _ in made]), made, strict=True)])
    assert right.mean() > 0.97
    page = (
        "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>More</a></li></ul></nav><article><h1>Big  title</h1>"
        "<p>First words &amp; more words of this article, enough to be a paragraph.<p>Second <b>bold</b> one &lt;here&gt; with several words in it.</article><footer>&copy; x.example.com</footer></body></html>"
    )
    rows = [(1, "u", page, "old"), (1, "u", page, "old"), (2, None, None, None), (3, "u", "", "x"), (4, "u", "<<<>><p", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract_main_text(frame).collect()
    want = "Big title First words & more words of this article, enough to be a paragraph. Second bold one <here> with several words in it."
    assert [r.text for r in got if r.page_id == 1] == [want, want]
    assert [r.text for r in got if r.page_id in (2, 3)] == ["", ""]
    assert html_extract.extract_main_text(frame.where("page_id < 0")).count() == 0


def test_lstm_gradients():
    rng = np.random.default_rng(0)
    model = html_extract.Labeller([w.astype(np.float64) for w in html_extract.Labeller.fresh(rng).weights])
    pages, labels = [rng.standard_normal((n, html_extract.INPUT_DIM)).astype(np.float32) for n in (3, 5)], [np.array([1, 0, 1.0]), np.array([0, 0, 1, 1, 0.0])]
    before = [w.copy() for w in model.weights]
    loss = model.step(pages, labels, [0, [np.zeros_like(w) for w in before], [np.zeros_like(w) for w in before]], 1e-3)
    after = model.step(pages, labels, [0, [np.zeros_like(w) for w in before], [np.zeros_like(w) for w in before]], 0.0)
    assert after < loss


def test_registry_has_one_query_for_each_number():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
