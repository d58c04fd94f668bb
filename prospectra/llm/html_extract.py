"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks of text. Each block is read as two small vectors, one of its tag path (tags and
class words hashed) and one of its hashed words and shape; a bidirectional LSTM in numpy labels every block with the
whole document as context. The labeller is trained here, on pages that this module makes up from a grammar of page
layouts; its weights depend on nothing but the seed.
"""

from __future__ import annotations

import html as html_lib
import inspect
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_root, slices

# fixed values: elements by their role in HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var del wbr".split())
HIDDEN = frozenset("script style noscript template head svg math iframe object canvas audio video select option textarea".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SECTIONING = frozenset("article section nav aside header footer main body div form ul ol table".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_HINT = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")

TAG_DIM, HINT_DIM, WORD_DIM, SHAPE_DIM, HIDDEN_DIM = 32, 64, 32, 8, 24
PATH_DIM = TAG_DIM + HINT_DIM
#: What a mark counts one element further from the leaf.
NEAR = 0.8
INPUT_DIM = PATH_DIM + WORD_DIM + SHAPE_DIM
SEED = 11
#: Bytes of html that a task takes at a time, and blocks of pages that are labelled together.
SLICE_BYTES, BATCH_BLOCKS = 4 << 20, 20_000


class _Open:
    """Open elements of a page with what a block needs of their path, kept up to date as they come and go.

    The path is read as one vector: every mark (tag or class word) that is on it counts half once, and marks near the leaf
    count more, by NEAR for each element between. Pushing and popping cost the same at any depth.
    """

    def __init__(self):
        self.tags: list[str] = []
        self.marks: list[tuple[str, ...]] = []
        self.near: list[np.ndarray] = [np.zeros(PATH_DIM, dtype=np.float32)]
        self.once = np.zeros(PATH_DIM, dtype=np.float32)
        self.count: Counter = Counter()
        self.at: dict[str, list[int]] = {}  # places of each open tag
        self.block_at: list[int] = []  # places of elements that aren't inline
        self.n_marks = self.hidden = 0

    def last(self, tag: str) -> int | None:
        places = self.at.get(tag)
        return places[-1] if places else None

    def push(self, tag: str, hints: list[str]) -> None:
        marks = (tag, *(f".{h}" for h in hints))
        near = self.near[-1] * NEAR
        for mark in marks:
            at, sign = _place(mark)
            near[at] += sign
            self.count[mark] += 1
            if self.count[mark] == 1:
                self.once[at] += 0.5 * sign
        self.at.setdefault(tag, []).append(len(self.tags))
        if tag not in INLINE:
            self.block_at.append(len(self.tags))
        self.tags.append(tag)
        self.marks.append(marks)
        self.near.append(near)
        self.n_marks += len(marks)
        self.hidden += tag in HIDDEN

    def pop(self, to: int) -> None:
        while len(self.tags) > to:
            tag, marks = self.tags.pop(), self.marks.pop()
            self.near.pop()
            self.at[tag].pop()
            if self.block_at and self.block_at[-1] == len(self.tags):
                self.block_at.pop()
            for mark in marks:
                self.count[mark] -= 1
                if not self.count[mark]:
                    at, sign = _place(mark)
                    self.once[at] -= 0.5 * sign
            self.n_marks -= len(marks)
            self.hidden -= tag in HIDDEN

    def path(self) -> tuple[np.ndarray, int, bool]:
        """Vector of the path, its number of marks, and whether it has a main heading."""
        return self.once + 0.5 * self.near[-1], self.n_marks, bool(self.count["h1"] or self.count["h2"])


def blocks(page: str | None) -> list[tuple[tuple[np.ndarray, int, bool], str, int]]:
    """Leaf blocks of a page in order: (path, text, link characters). Time and memory grow with the page, not with its depth."""
    out: list = []
    open_ = _Open()
    text: list[str] = []
    links = 0
    page = page or ""

    def flush() -> None:
        nonlocal text, links
        joined = _SPACE.sub(" ", "".join(text)).strip()
        if joined:
            out.append((open_.path(), joined, links))
        text, links = [], 0

    def say(raw: str) -> None:
        nonlocal links
        if not open_.hidden and raw:
            raw = html_lib.unescape(raw) if "&" in raw else raw
            text.append(raw)
            if open_.at.get("a"):
                links += len(raw.strip())

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            where = open_.last(tag)
            if where is None:
                if tag in ("br", "p"):
                    flush()
                continue
            if tag not in INLINE:
                flush()
            elif open_.block_at and open_.block_at[-1] > where:
                continue  # an inline end tag doesn't close blocks
            open_.pop(where)
            continue
        if tag not in INLINE:
            flush()
        if tag in CLOSES_P and open_.last("p") is not None:
            open_.pop(open_.last("p"))
        if tag in SAME_CLOSES:
            same = max((w for t in SAME_CLOSES[tag] if (w := open_.last(t)) is not None), default=None)
            bound = max((w for t in SECTIONING if (w := open_.last(t)) is not None), default=-1)
            if same is not None and same > bound:
                open_.pop(same)
        if tag == "body" and open_.last("head") is not None:
            open_.pop(open_.at["head"][0])
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        hints = [w.lower() for h in _HINT.findall(m[3]) for w in _WORD.findall("".join(h))] if m[3] else []
        open_.push(tag, hints)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if tag == "title" or tag not in HIDDEN:
                say(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
            flush() if not open_.hidden else None
            text.clear() if open_.hidden else None
            open_.pop(len(open_.tags) - 1)
    flush()
    return out


@lru_cache(maxsize=1 << 16)
def _bucket(word: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode())
    return h % size, 1.0 if h & 0x10000 else -1.0


def _place(mark: str) -> tuple[int, float]:
    """Dimension and sign of a mark in the path's vector."""
    first, size = (TAG_DIM, HINT_DIM) if mark[0] == "." else (0, TAG_DIM)
    at, sign = _bucket(mark, size)
    return first + at, sign


def vectors(found: list) -> np.ndarray:
    """Input vectors of the blocks of a page, from the whole path and all words of each."""
    x = np.zeros((len(found), INPUT_DIM), dtype=np.float32)
    for row, ((path, n_marks, heading), text, links) in zip(x, found, strict=True):
        counts = Counter(text.lower().split(" "))
        unit = counts.total() ** -0.5
        values = [0.0] * WORD_DIM
        for w, n in counts.items():
            at, sign = _bucket(w, WORD_DIM)
            values[at] += sign * n * unit
        row[:PATH_DIM], row[PATH_DIM : PATH_DIM + WORD_DIM] = path, values
        row[-SHAPE_DIM:] = (
            min(len(text), 600) / 300,
            min(counts.total(), 100) / 50,
            links / (len(text) + 1),
            text[-1] in ".!?:;\"»”",
            "©" in text,
            np.log1p(n_marks) / 3,
            heading,
            1,
        )
    return x


class Labeller:
    """Bidirectional LSTM with a logistic output for each block."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Labeller:
        scale = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        out = []
        for _ in range(2):
            bias = np.zeros(4 * HIDDEN_DIM, dtype=np.float32)
            bias[HIDDEN_DIM : 2 * HIDDEN_DIM] = 1
            out += [scale(INPUT_DIM, 4 * HIDDEN_DIM), scale(HIDDEN_DIM, 4 * HIDDEN_DIM), bias]
        return cls([*out, scale(2 * HIDDEN_DIM, 1)[:, 0], np.zeros(1, dtype=np.float32)])

    def _run(self, x: np.ndarray, mask: np.ndarray, w, u, b, keep: bool = True):
        """Hidden states over time of a batch (time, page, input), zero past the end, and what the way back needs."""
        steps, n, _ = x.shape
        h, c = np.zeros((n, HIDDEN_DIM), dtype=np.float32), np.zeros((n, HIDDEN_DIM), dtype=np.float32)
        pre, tape, out = x @ w + b, [], np.zeros((steps, n, HIDDEN_DIM), dtype=np.float32)
        for t in range(steps):
            z = pre[t] + h @ u
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN_DIM]))
            i, f, o = np.split(gates, 3, axis=1)
            g = np.tanh(z[:, 3 * HIDDEN_DIM :])
            m = mask[t][:, None]
            c2 = (f * c + i * g) * m
            tc = np.tanh(c2)
            if keep:
                tape.append((h, c, i, f, o, g, tc))
            h, c = o * tc * m, c2
            out[t] = h
        return out, tape

    def _back(self, d_out, x, mask, tape, w, u):
        gw, gu, gb = np.zeros_like(w), np.zeros_like(u), np.zeros(w.shape[1], dtype=np.float32)
        dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
        for t in range(len(tape) - 1, -1, -1):
            h, c, i, f, o, g, tc = tape[t]
            m = mask[t][:, None]
            dh = (dh + d_out[t]) * m
            do, dc = dh * tc, (dc + dh * o * (1 - tc * tc)) * m
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), do * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            gw += x[t].T @ dz
            gu += h.T @ dz
            gb += dz.sum(axis=0)
            dh, dc = dz @ u.T, dc * f
        return gw, gu, gb

    @staticmethod
    def _batch(pages: list[np.ndarray]):
        """Pages as (time, page, input) forwards and backwards, and their mask."""
        steps = max(map(len, pages))
        x = np.zeros((steps, len(pages), INPUT_DIM), dtype=np.float32)
        r, mask = x.copy(), np.zeros((steps, len(pages)), dtype=np.float32)
        for k, p in enumerate(pages):
            x[: len(p), k], r[: len(p), k], mask[: len(p), k] = p, p[::-1], 1
        return x, r, mask

    @staticmethod
    def _turn(states: np.ndarray, pages: list[np.ndarray]) -> np.ndarray:
        """The states of the backward pass in the order of the blocks, or back."""
        out = np.zeros_like(states)
        for k, p in enumerate(pages):
            out[: len(p), k] = states[: len(p), k][::-1]
        return out

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Log-odds of main text of each block of each page."""
        if not pages:
            return []
        x, r, mask = self._batch(pages)
        a, _ = self._run(x, mask, *self.weights[0:3], keep=False)
        b, _ = self._run(r, mask, *self.weights[3:6], keep=False)
        both = np.concatenate([a, self._turn(b, pages)], axis=2) @ self.weights[6] + self.weights[7]
        return [both[: len(p), k] for k, p in enumerate(pages)]

    def step(self, pages: list[np.ndarray], labels: list[np.ndarray], state: list, rate: float) -> float:
        """One step of Adam on a batch; the mean loss of a block."""
        x, r, mask = self._batch(pages)
        a, tape_a = self._run(x, mask, *self.weights[0:3])
        b, tape_b = self._run(r, mask, *self.weights[3:6])
        both = np.concatenate([a, self._turn(b, pages)], axis=2)
        z = both @ self.weights[6] + self.weights[7]
        y = np.zeros_like(mask)
        for k, label in enumerate(labels):
            y[: len(label), k] = label
        p = 1 / (1 + np.exp(-z))
        d = (p - y) * mask / mask.sum()
        d_both = d[:, :, None] * self.weights[6]
        grads = [
            *self._back(d_both[:, :, :HIDDEN_DIM], x, mask, tape_a, *self.weights[0:2]),
            *self._back(self._turn(d_both[:, :, HIDDEN_DIM:], pages), r, mask, tape_b, *self.weights[3:5]),
            np.einsum("tn,tnh->h", d, both),
            np.array([d.sum()], dtype=np.float32),
        ]
        state[0] += 1
        for w, g, m, v in zip(self.weights, grads, state[1], state[2], strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (rate * (m / (1 - 0.9 ** state[0])) / (np.sqrt(v / (1 - 0.99 ** state[0])) + 1e-6)).astype(np.float32)
        return float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / mask.sum())


class Grammar:
    """Made-up pages with the label of every block: 1 for the article, 0 for what stands around it."""

    # fixed values: names that page authors give to regions
    AROUND = {
        "nav": "nav navbar menu navigation topnav breadcrumb breadcrumbs main-menu",
        "header": "header site-header masthead banner topbar branding",
        "footer": "footer site-footer copyright bottom legal colophon",
        "aside": "sidebar side widget related aside rail recommended popular trending",
        "ad": "ad ads advert advertisement sponsored promo adbox banner-ad sponsor",
        "notice": "notice cookie cookies consent alert gdpr banner popup newsletter subscribe privacy",
        "form": "form search login signup subscribe contact newsletter search-form",
        "comments": "comments comment discussion replies responses comment-list comment-body comment-content reader-comments",
        "share": "share social sharing tags meta byline-share related-links pager pagination",
    }
    ARTICLE = "article content main post entry story article-body post-content entry-content main-content text body"
    # fixed values: what pages say around their articles, by kind of region
    SAYS = {
        "nav": ["Home", "News", "World", "About", "About us", "Contact", "Archive", "Blog", "Products", "Services", "Help", "Sport", "Business", "Local", "Money", "Back to index", "Next", "Previous", "May", "June"],
        "footer": ["All rights reserved", "Terms of use", "Privacy policy", "Contact us", "Imprint", "Copyright", "Powered by", "Sitemap"],
        "aside": ["Most read", "Popular", "Related", "Recent posts", "Archives", "Read also", "More stories", "Trending", "Categories", "Latest"],
        "ad": ["Buy now", "for half the price", "Special offer", "Order today", "Advertisement", "Sponsored", "Save money", "our new book", "free shipping"],
        "notice": ["We use cookies", "to make this site better", "Subscribe now", "Sign up for our newsletter", "Your privacy", "Accept all", "Never miss a story"],
        "comments": ["I was there", "believe me", "I think", "Thanks for this", "great post", "I agree", "not true at all", "says", "replied", "Reply"],
        "header": ["The Paper", "Daily news", "My blog", "The magazine", "since 1950", "Welcome"],
        "share": ["Share", "Tweet", "Print", "E-mail this", "Tags", "Posted by"],
        "form": ["Name", "Email", "Search", "Send", "Your message"],
    }
    #: Common words, which say nothing about where they stand.
    COMMON = (
        "the of and to in a is that for it was on with as be by this at from not are or an have had they were which one all there can more her their has what so up out if about who get than them time only "
        "story first second last year week day town people work home world new best great true save next read buy short part says said told made after before over under most many much some any"
    )
    #: Names that comment widgets and other things set beside an article have as ids.
    WIDGETS = "disqus_thread fb-comments respond isso-thread reader-voices talk feedback"

    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        #: Share of common words in the page at hand.
        self.common = 0.0

    def pick(self, words: str | list) -> str:
        words = words.split() if isinstance(words, str) else words
        return words[self.rng.integers(len(words))]

    def word(self) -> str:
        """A word of one to four syllables, each of up to two consonants, a vowel and maybe a consonant."""
        if self.rng.random() < self.common:
            return self.pick(self.COMMON)
        consonants, vowels = "bcdfghjklmnpqrstvwxyz", "aeiouy" if self.rng.random() < 0.8 else "aeioäöüéèçñ"
        letter = lambda of: of[self.rng.integers(len(of))]
        syllable = lambda: "".join(letter(consonants) for _ in range(self.rng.integers(0, 3))) + letter(vowels) + (letter(consonants) if self.rng.random() < 0.4 else "")
        return "".join(syllable() for _ in range(self.rng.integers(1, 5)))

    def says(self, kind: str, low: int, high: int) -> str:
        """A phrase of a region: often what such regions say, else any words."""
        r = self.rng.random()
        if r < 0.35:
            return self.sentence(low, high)
        said = self.pick(self.SAYS[kind])
        return said if r < 0.65 and low < 5 else f"{said} {self.sentence(max(1, low - 2), max(2, high - 2)).lower()}"

    def sentence(self, low: int, high: int) -> str:
        words = [self.word() for _ in range(self.rng.integers(low, high))]
        if self.rng.random() < 0.05:
            words = [w + self.pick("%%% *** $$$ ###") for w in words]
        return " ".join(words).capitalize() + self.pick([".", ".", ".", "!", "?", ""])

    def paragraph(self) -> str:
        if self.rng.random() < 0.03:  # junk: a phrase over and over, or a run of words between bars
            phrase = self.sentence(1, 4)
            return self.pick([" ", " ", " | "]).join([phrase] * int(self.rng.integers(5, 80))) if self.rng.random() < 0.6 else " | ".join(self.word() for _ in range(self.rng.integers(5, 60)))
        return " ".join(self.sentence(3, 18) for _ in range(self.rng.integers(1, 7)))

    def article(self) -> tuple[str, list[str]]:
        """Markup of an article and the texts of its blocks."""
        parts, texts = [], []

        def add(tag: str, text: str, wrap: str = "{}") -> None:
            parts.append(f"<{tag}>{wrap.format(html_lib.escape(text, quote=False))}" + (f"</{tag}>" if self.rng.random() < 0.95 else ""))
            texts.append(text)

        if self.rng.random() < 0.9:
            add("h1" if self.rng.random() < 0.8 else "h2", self.sentence(3, 12))
        for _ in range(self.rng.integers(1, 10)):
            kind = self.rng.random()
            if kind < 0.08:
                add(self.pick("h2 h3 h4"), self.sentence(2, 8))
            elif kind < 0.16:
                parts.append("<ul>")
                for _ in range(self.rng.integers(2, 6)):
                    add("li", self.sentence(2, 14), "<a href='/x'>{}</a>" if self.rng.random() < 0.1 else "{}")
                parts.append("</ul>")
            elif kind < 0.22:
                add("blockquote", self.paragraph())
            elif kind < 0.25:
                add("div", self.paragraph())
            elif kind < 0.28:
                parts.append("<figure><img src='/i.jpg'>")
                add("figcaption", self.sentence(2, 14))
                parts.append("</figure>")
            elif kind < 0.3:
                parts.append("<table>")
                for _ in range(self.rng.integers(2, 5)):
                    parts.append("<tr>")
                    for _ in range(2):
                        add("td", self.sentence(1, 6))
                    parts.append("</tr>")
                parts.append("</table>")
            elif kind < 0.36:
                add("p", self.sentence(1, 4))
            else:
                add("p", self.paragraph(), "<b>{}<br>" if self.rng.random() < 0.1 else "{}")
        return "".join(parts), texts

    def nest(self, markup: str) -> str:
        """The markup within some elements that say nothing about it, often none and sometimes many."""
        for _ in range(int(self.rng.choice([0, 0, 0, 1, 2, 3, self.rng.integers(4, 14)]))):
            name = self.pick("wrapper container row col grid inner outer box layout block section-inner cell flex page clearfix") if self.rng.random() < 0.6 else self.word()
            markup = f'<{(tag := self.pick("div div div section span"))}' + (f' class="{name}{self.pick(["", " md", " w-100", " " + self.word()])}"' if self.rng.random() < 0.7 else "") + f">{markup}</{tag}>"
        return markup

    def region(self, kind: str) -> str:
        """Markup of something that stands around an article, in an element whose name or class says what it is."""
        hint = self.pick(self.AROUND[kind])
        named = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        tag = named if named and self.rng.random() < 0.6 else self.pick("div section div ul" if kind == "nav" else "div section div")
        attr = "" if tag == named and self.rng.random() < 0.6 else f' {self.pick("class id class")}="{hint}"'
        return self.nest(f"<{tag}{attr}>{self.nest(self.inside(kind))}</{tag}>")

    def inside(self, kind: str) -> str:
        """Markup inside a region of this kind."""
        r, e = self.rng, html_lib.escape
        link = lambda text: f"<a href='/{self.word()}'>{e(text)}</a>"
        if kind == "nav":
            items = [link(self.says("nav", 1, 3)) for _ in range(r.integers(2, 9))]
            form = r.random()
            return "<ul><li>" + "</li><li>".join(items) + "</li></ul>" if form < 0.6 else self.pick([" | ", " ", "<br>", ""]).join(items)
        if kind == "header":
            logo = self.pick("div p h1 span h1")
            return f"<{logo}>{link(self.says('header', 1, 4))}</{logo}>" + (f"<p>{e(self.says('header', 2, 8))}</p>" if r.random() < 0.6 else "")
        if kind == "footer":
            form = r.random()
            if form < 0.4:
                return " ".join(link(self.says("footer", 1, 3)) for _ in range(r.integers(2, 5)))
            mark = self.pick(["&copy; ", "© ", "Copyright ", "", "&copy; 2020 "])
            said = f"{mark}{e(self.says('footer', 2, 20))}" + self.pick(["", f" {self.word()}.{self.pick('com org net')}"])
            return (f"<p>{said}</p>" if r.random() < 0.5 else said) + (f"<p>{link('Privacy')} {link('Terms')}</p>" if r.random() < 0.4 else "")
        if kind == "aside":
            tag, linked = self.pick("p p li li"), r.random() < 0.5
            items = [self.says("aside", 3, 25) for _ in range(r.integers(1, 6))]
            body = "".join(f"<{tag}>{link(x) if linked else e(x)}</{tag}>" for x in items)
            head = self.pick("h3 h3 h4 b li")
            return (f"<{head}>{e(self.says('aside', 1, 4))}</{head}>" if r.random() < 0.8 else "") + (f"<ul>{body}</ul>" if tag == "li" else body)
        if kind == "ad":
            return e(self.says("ad", 2, 22)) if r.random() < 0.5 else f"<p>{e(self.says('ad', 2, 14))}</p>" + (link(self.says("ad", 1, 4)) if r.random() < 0.6 else "")
        if kind == "notice":
            return f"<p>{e(self.says('notice', 5, 25))}</p>" + (f"<button>{self.pick('OK Accept Close Agree')}</button>" if r.random() < 0.7 else "")
        if kind == "form":
            return f"<label>{e(self.pick(self.SAYS['form']))}</label><input type='text'><button>{self.pick('Send Search Go Join')}</button>"
        if kind == "comments":
            note = lambda: f"<b>{self.word()}</b><p>{e(self.says('comments', 5, 12) if r.random() < 0.5 else self.paragraph())}</p>"
            named = r.random() < 0.6
            each = lambda: f"<{(t := self.pick('div li'))}{' class=comment' if named else ''}>{self.nest(note() if r.random() < 0.7 else f'<p>{e(self.says("comments", 5, 25))}</p>')}</{t}>"
            return (f"<h3>{self.pick('Comments Responses Discussion')}</h3>" if r.random() < 0.7 else "") + "".join(each() for _ in range(r.integers(1, 6)))
        return "".join(f"{link(self.says('share', 1, 3))} " for _ in range(r.integers(2, 6)))

    def unnamed(self) -> str:
        """The body of a page whose classes say little or nothing: tables, columns by width, made-up class names, bare elements, old blogs.

        The article is between marks.
        """
        r = self.rng
        style = self.pick("table columns hashed bare bare semantic widget blog")
        body, _ = self.article()
        body = f"\x01{body}\x02"
        code = lambda: f"{self.pick('css sc jss x')}-{self.word()[:3]}{r.integers(1, 99)}"

        def box(inner: str, kind: str) -> str:
            if style == "table":
                return f"<td{self.pick(['', ' width=150', ' valign=top'])}>{inner}</td>"
            if style == "hashed":
                return f'<div class="{code()}">{inner}</div>'
            if style == "columns" and kind in ("main", "aside"):
                wide = f"{self.pick('col-md col-lg w column-')}-{self.pick('8 9 7') if kind == 'main' else self.pick('4 3 5')}"
                return f'<div class="{wide}">{inner}</div>'
            if style == "semantic":
                tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "main": self.pick("article main")}.get(kind, "div")
                return f"<{tag}>{inner}</{tag}>"
            if style == "widget" and kind == "comments":
                return f'<div id="{self.pick(self.WIDGETS)}"><div>{inner}</div></div>'
            if style == "widget" and kind == "main":
                return f"<{(t := self.pick('main article div'))}>{inner}</{t}>"
            if style == "blog":
                name = {"nav": "menu", "header": "logo", "footer": "bottom", "aside": "sidebar", "main": self.pick("post hentry entry"), "comments": "comments", "ad": "promo", "notice": "topbar", "share": "postmeta", "form": "searchform"}[kind]
                return f'<div {self.pick("id class")}="{name}">{inner}</div>'
            return f"<div>{inner}</div>" if r.random() < 0.9 else f"<{(t := self.pick('p center section'))}>{inner}</{t}>"

        regions = lambda *odds: [box(self.inside(k), k) for k, p in odds if r.random() < p]
        top = regions(("notice", 0.25), ("header", 0.5), ("nav", 0.8), ("form", 0.1), ("ad", 0.15))
        side = regions(("aside", 0.55), ("ad", 0.25), ("nav", 0.2))
        middle = [box(body, "main")]
        middle = [*side, *middle] if r.random() < 0.35 else [*middle, *side]
        last = regions(("share", 0.25), ("comments", 0.6 if style == "widget" else 0.3), ("ad", 0.15), ("notice", 0.15), ("nav", 0.2), ("footer", 0.8))
        if style == "table":
            rows = [*([[x] for x in top]), middle, *([[x] for x in last])]
            return "<table>" + "".join("<tr>" + "".join(row) + "</tr>" for row in rows) + "</table>"
        centre = "".join(middle)
        if r.random() < 0.5:
            centre = f"<div class=row>{centre}</div>" if style == "columns" else box(centre, "ad" if style in ("hashed", "bare") else "main") if style in ("hashed", "bare") else f"<div>{centre}</div>"
        out = "".join(top) + centre + self.pick(["", "", "<hr>"]) + "".join(last)
        return self.nest(out) if r.random() < 0.3 else out

    def page(self) -> tuple[list, np.ndarray]:
        """Blocks of a made-up page and their labels."""
        self.common = float(self.rng.choice([0.0, 0.0, 0.3, 0.6, 0.8]))
        return self.labelled(self.unnamed() if self.rng.random() < 0.4 else self.named())

    def named(self) -> str:
        """The body of a page whose elements and classes say what they hold, the article between marks."""
        r = self.rng
        before = [k for k, p in (("header", 0.4), ("nav", 0.8), ("notice", 0.2), ("form", 0.15), ("ad", 0.4)) if r.random() < p]
        after = [k for k, p in (("share", 0.3), ("comments", 0.35), ("aside", 0.4), ("ad", 0.25), ("form", 0.25), ("nav", 0.15), ("notice", 0.3), ("footer", 0.85)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(before)
        body, _ = self.article()
        kind = r.random()
        mark = lambda x: f"\x01{x}\x02"
        if kind < 0.55:
            middle = f"<article>{self.nest(mark(body))}</article>"
        elif kind < 0.7:
            middle = f"<main>{self.nest(mark(body))}</main>"
        else:
            middle = f'<div {self.pick("class id")}="{self.pick(self.ARTICLE)}">{self.nest(mark(body))}</div>'
        if r.random() < 0.15:  # something in the middle of the article
            cut = [m.start() for m in re.finditer("<p>|<h2>", middle)][1:]
            if cut:
                at = cut[r.integers(len(cut))]
                middle = middle[:at] + "\x02" + self.region(self.pick("ad aside share form")) + "\x01" + middle[at:]
        if r.random() < 0.25:  # something beside the article in the main part
            inside = self.region(self.pick("comments comments share aside"))
            middle = self.pick(["<main>{}</main>", '<div id="main">{}</div>', '<div class="content">{}</div>', "<article>{}</article>"]).format(self.nest(middle) + inside)
        if r.random() < 0.3:
            middle = f'<div class="{self.pick("wrapper container page row layout")}">{middle}{self.region("aside") if r.random() < 0.4 else ""}</div>'
        return "".join(map(self.region, before)) + self.nest(middle) + "".join(map(self.region, after))

    def labelled(self, body: str) -> tuple[list, np.ndarray]:
        page = f"<html><head><title>x</title></head><body>{self.nest(body)}</body></html>"
        found, labels, inside = [], [], False
        for path, text, links in blocks(page):
            inner = inside
            for ch in text:
                if ch == "\x01":
                    inside = True
                elif ch == "\x02":
                    inside = False
            inner = inner or "\x01" in text
            clean = text.replace("\x01", "").replace("\x02", "").strip()
            if clean:
                found.append((path, clean, links))
                labels.append(inner)
        return found, np.array(labels, dtype=np.float32)


@lru_cache(maxsize=1)
def train(pages: int = 4000, epochs: int = 6, seed: int = SEED, batch: int = 25) -> Labeller:
    """A labeller trained on ``pages`` made-up pages, once a process; the same seed gives the same weights."""
    rng = np.random.default_rng(seed)
    grammar, model = Grammar(rng), Labeller.fresh(rng)
    made = [(vectors(f), y) for f, y in (grammar.page() for _ in range(pages)) if len(f)]
    state = [0, [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights]]
    for epoch in range(epochs):
        order = sorted(range(len(made)), key=lambda k: len(made[k][0]) + rng.random() * 6)
        groups = [order[k : k + batch] for k in range(0, len(order), batch)]
        rng.shuffle(groups)
        for group in groups:
            model.step([made[k][0] for k in group], [made[k][1] for k in group], state, 0.01 * (1 - epoch / epochs))
    return model


_MODEL: list[Labeller] = []


def labeller(spark: SparkSession):
    """The trained weights, a fixed-size model, broadcast; trained by the first driver and kept in the shared folder for others."""
    if not _MODEL:
        code = zlib.crc32(inspect.getsource(inspect.getmodule(train)).encode())
        path = f"{shared_root(spark)}/html-labeller-{code:08x}"
        try:
            stored = spark.read.parquet(path).first()
        except AnalysisException:  # nobody has trained it yet
            stored = None
        if stored:
            _MODEL.append(Labeller([np.array(w, dtype=np.float32).reshape(shape) for w, shape in zip(stored["weights"], stored["shapes"], strict=True)]))
        else:
            _MODEL.append(train())
            row = ([w.ravel().tolist() for w in _MODEL[0].weights], [list(w.shape) for w in _MODEL[0].weights])
            spark.createDataFrame([row], "weights array<array<float>>, shapes array<array<int>>").coalesce(1).write.mode("ignore").parquet(path)
    return spark.sparkContext.broadcast(_MODEL[0].weights)


def main_texts(pages: list[str | None], model: Labeller, batch: int = 64) -> list[str]:
    """Main text of each page: its blocks that the model calls main, in order, joined by a space."""
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(found)) if found[k]), key=lambda k: len(found[k]))
    at = 0
    while at < len(order):
        group = order[at : at + batch]
        while len(group) > 1 and len(group) * len(found[group[-1]]) > BATCH_BLOCKS:
            group = group[: len(group) // 2]
        at += len(group)
        for k, z in zip(group, model.scores([vectors(found[k]) for k in group]), strict=True):
            out[k] = " ".join(text for (_, text, _), s in zip(found[k], z, strict=True) if s > 0)
    return out


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All rows and columns of ``pages`` without the html, with ``text``, the main text.

    A null or empty html, and a page without main text, give an empty text; repeated rows give the same text; an empty
    table stays empty; a column named ``text`` is replaced.
    """
    sent = labeller(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html_col, "text")]
    rows = pages.select(*keep, F.col(html_col).cast("string").alias("__html"))

    def run(batches):
        model = Labeller(sent.value)
        for b in slices(batches, SLICE_BYTES):
            texts = main_texts(b.column(len(keep)).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*b.schema.names[:-1], "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__html")
    return rows.mapInArrow(run, f"{kinds}{', ' if kinds else ''}text string")


def op6_recurrent_html_extraction(spark, sf_dir: str) -> DataFrame:
    found = extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
