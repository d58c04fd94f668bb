"""Pages of shapes that the training grammar's author didn't draw from it, and pages that are deep or long."""

import time

import pytest

from prospectra.llm import html_extract

PARTS = ["The first paragraph of this story says what happened in the town last week.", "A second one, with more of the details that readers asked for, follows it.", "And the last one ends the story with a short remark about the weather."]
BODY, TITLE = "".join(f"<p>{x}</p>" for x in PARTS), "A story of a town"
WHOLE = " ".join([TITLE, *PARTS])
PAGES = {
    "table": (
        f"<table><tr><td colspan=2><a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a></td></tr><tr><td width=150><a href=/1>Local</a><br><a href=/2>World</a><br><a href=/3>Money</a></td><td><h1>{TITLE}</h1>{BODY}</td></tr><tr><td colspan=2>Copyright 2001 The Paper</td></tr></table>",
        WHOLE,
    ),
    "columns": (
        f'<div class="container"><div class="row"><div class="col-md-8"><h1>{TITLE}</h1>{BODY}</div><div class="col-md-4"><h4>Most read</h4><ul><li><a href=/a>Ten things to see</a></li><li><a href=/b>Where to eat now</a></li></ul></div></div></div>',
        WHOLE,
    ),
    "widget": (f'<main><h1>{TITLE}</h1>{BODY}</main><div id="disqus_thread"><div><p>I was there and it was not like that at all, believe me.</p></div></div>', WHOLE),
    "caption": (f"<article><h1>{TITLE}</h1><figure><img src=a.jpg><figcaption>The town seen from the hill.</figcaption></figure>{BODY}</article>", " ".join([TITLE, "The town seen from the hill.", *PARTS])),
    "bare": (f"<div><a href=/>Home</a> | <a href=/a>About</a></div><div><h1>{TITLE}</h1>{BODY}</div><div>All rights reserved.</div>", WHOLE),
}


@pytest.fixture(scope="module")
def model():
    return html_extract.train()


def test_pages_of_other_shapes(model):
    got = html_extract.main_texts([page for page, _ in PAGES.values()], model)
    assert dict(zip(PAGES, got, strict=True)) == {name: text for name, (_, text) in PAGES.items()}


def test_time_grows_with_the_page_and_not_with_its_depth(model):
    for page in ("<div>" * 200_000 + "x", "<div>a" * 170_000, "<b><div>" * 50_000 + "</b>" * 50_000, "<li><span>" * 60_000, "<p><table><tr><td>" * 20_000, "</p>" * 300_000):
        began = time.time()
        html_extract.blocks(page)
        assert time.time() - began < 15
    began = time.time()
    assert isinstance(html_extract.main_texts(["<div>a" * 20_000], model)[0], str) and time.time() - began < 30


def test_elements_close_as_browsers_close_them():
    text = lambda page: [t for _, t, _ in html_extract.blocks(page)]
    assert text("<p>one<p>two<div>three</p>four") == ["one", "two", "three", "four"]
    assert text("<ul><li>a<li>b<ul><li>c</ul>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert text("<dl><dt>a<dd>b<dt>c</dl><table><tr><td>d<td>e<tr><td>f</table>") == ["a", "b", "c", "d", "e", "f"]
    assert text("<b>x<div>y</b>z</div>w") == ["x", "yz", "w"] and text("</div></p>a<br/>b") == ["a", "b"]
    deep = html_extract._Open()
    for tag in ("div", "p", "b"):
        deep.push(tag, ["row"])
    full = deep.path()
    deep.push("i", ["row", "x"])
    deep.pop(3)
    again = deep.path()
    assert (full[0] == again[0]).all() and full[1:] == again[1:]
    deep.pop(0)
    assert not deep.path()[0].any() and deep.n_marks == 0
