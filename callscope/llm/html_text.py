"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

Every block element gets features of its own and of its surroundings: text and link density of
the subtree, words in its naming attributes, depth, siblings, and what the path above it says.
Boosted trees give the log odds that it belongs to the article. The decoder then chooses for each
element one of three states - undecided, inside, outside - with the best total under the rules
that everything below an outside element is outside and below an inside element nothing is
undecided again; so no choice contradicts one above it.

The trees are trained on pages drawn from a grammar of layouts with known regions, with fixed
seed and size; nothing is learned from the pages to be read.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.boost import Trees
from callscope.llm.common import map_slices, whole
from callscope.llm.dom import BLOCK, RAW, Page

TRAINING_PAGES = 700
SEED = 20
#: Added to the log odds of what stands inside an article: parts of it go only on clear evidence.
STAY = 1.0

#: Words in naming attributes that speak for and against an article, fixed values.
GOOD_WORDS = frozenset(
    "article articlebody body content entry main page post single story text blogpost hentry maincontent".split()
)
BAD_WORDS = frozenset(
    "ad ads advert advertisement aside banner bar breadcrumb breadcrumbs byline comment comments consent cookie "
    "cookies copyright disqus dialog disclaimer footer foot form gdpr header head login masthead menu meta modal nav "
    "navbar navigation newsletter notice overlay pagination pager popup privacy promo promoted recommended "
    "related reply replies respond responses search share sharing sidebar signup site skip social sponsor "
    "sponsored subscribe subscription tags teaser toolbar tools top widget alert".split()
)
#: Groups of element names, fixed values.
KINDS = (
    frozenset(("article",)),
    frozenset(("main",)),
    frozenset(("nav", "menu")),
    frozenset(("header",)),
    frozenset(("footer",)),
    frozenset(("aside",)),
    frozenset(("form", "fieldset", "label", "select", "button", "textarea", "dialog")),
    frozenset(("p", "blockquote", "pre")),
    frozenset(("h1", "h2", "h3", "h4", "h5", "h6")),
    frozenset(("ul", "ol", "dl", "menu")),
    frozenset(("li", "dd", "dt")),
    frozenset(("table", "tr", "td", "th", "tbody")),
    frozenset(("div", "section")),
    frozenset(("head", "title", "script", "style", "noscript", "template", "iframe", "svg")),
)
_KIND = {name: k for k, names in enumerate(KINDS) for name in names}
_NEVER = (_KIND["head"], _KIND["form"])


def nodes_of(page: Page) -> np.ndarray:
    """The elements that are decided on: the root and all block elements."""
    return np.array([i for i, tag in enumerate(page.tags) if tag in BLOCK or tag in RAW or not i])


def features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """(elements, one row of features for each)."""
    n = len(page.tags)
    own, own_links, blocks = np.zeros(n), np.zeros(n), np.zeros(n)
    stops = np.zeros(n)
    for (node, text), linked in zip(page.blocks, page.links, strict=True):
        own[node] += len(text)
        own_links[node] += min(linked, len(text))
        blocks[node] += 1
        stops[node] += text.count(". ") + text.endswith((".", "!", "?", "…", ":"))
    ends = np.array(page.ends)
    sums = lambda x: (c := np.concatenate([[0.0], np.cumsum(x)]))[ends] - c[np.arange(n)]
    text, linked, many, stop, tags = sums(own), sums(own_links), sums(blocks), sums(stops), ends - np.arange(n)
    kind = np.array([_KIND.get(tag, -1) for tag in page.tags])
    good = [sum([w in GOOD_WORDS for w in words]) if words else 0 for words in page.words]
    bad = [sum([w in BAD_WORDS for w in words]) if words else 0 for words in page.words]
    # What the path above says: named well, named badly, article, main, furniture, list.
    above, order, count, kinds = [(0, 0, 0, 0, 0, 0)] * n, [0] * n, [0] * n, kind.tolist()
    for i in range(1, n):
        p = page.parents[i]
        k, (a, b, c, d, e, _) = kinds[p], above[p]
        if good[p] or bad[p]:
            a, b = int(good[p] > 0), int(bad[p] > 0)
        above[i] = (a, b, int(c or k == 0), int(d or k == 1), int(e or 2 <= k <= 6), int(k == 9))
        order[i] = count[p]
        count[p] += 1
    parents, order, count = np.array(page.parents), np.array(order), np.array(count, float)
    whole_text = max(text[0], 1.0)
    parent_text = np.maximum(text[np.maximum(parents, 0)], 1.0)
    siblings = np.maximum(count[np.maximum(parents, 0)], 1.0)
    picked = nodes_of(page)
    rows = np.column_stack(
        [
            np.log1p(text),
            np.log1p(own),
            linked / np.maximum(text, 1),
            own_links / np.maximum(own, 1),
            text / tags,
            np.log1p(many),
            stop / np.maximum(text, 1) * 100,
            text / whole_text,
            text / parent_text,
            np.array(page.depth, float),
            order / siblings,
            np.log1p(siblings),
            (parent_text - text) / siblings,
            good,
            bad,
            np.array(above, float),
            kind[:, None] == np.arange(len(KINDS)),
        ]
    )
    return picked, rows[picked].astype(float)


# ---- training pages ----------------------------------------------------------------------------


class Layout:
    """Random pages of known regions. Article elements carry the attribute ``data-in``."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.vocabulary = ["".join(self.rng.choices("abdefghilmnoprstuv", k=self.rng.randint(2, 9))) for _ in range(900)]

    def some(self, low: int, high: int, end: str = ".") -> str:
        words = self.rng.choices(self.vocabulary, k=self.rng.randint(low, high))
        for k in range(9, len(words) - 1, 11):
            words[k] += self.rng.choice((".", ",", ".", ";"))
        return " ".join(words).capitalize() + end

    def pick(self, *values: str) -> str:
        return self.rng.choice(values)

    def box(self, names: str, inner: str, tags: str = "div") -> str:
        """An element with one of the given names as class or id, or without any name."""
        tag, name = self.pick(*tags.split()), self.pick(*names.split())
        attribute = self.pick(f' class="{name}"', f' id="{name}"', f' class="x {name} y{self.rng.randint(0, 9)}"')
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{k}">{self.some(1, 4, "")}</a>' for k in range(self.rng.randint(low, high))]
        form = self.rng.random()
        if form < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " ".join(items) if form < 0.8 else "".join(f"<div>{x}</div>" for x in items)

    def menu(self) -> str:
        inner = self.links(3, 9)
        return self.pick(f"<nav>{inner}</nav>", self.box("nav menu navbar navigation breadcrumb", inner, "div nav ul section"))

    def header(self) -> str:
        inner = self.some(1, 5, "") + self.pick("", self.menu(), f"<p>{self.some(2, 9, '')}</p>")
        return self.pick(f"<header>{inner}</header>", self.box("header masthead banner site-header top", inner, "div header"))

    def footer(self) -> str:
        inner = "&copy; 2024 " + self.some(2, 14) + self.pick("", self.links(2, 6), f"<p>{self.some(5, 25)}</p>")
        return self.pick(f"<footer>{inner}</footer>", self.box("footer foot copyright site-footer", inner, "div footer"))

    def advert(self) -> str:
        inner = self.pick(self.some(3, 30), f"<p>{self.some(3, 40)}</p>", f'<a href="/x">{self.some(3, 12)}</a>')
        return self.box("ad ads advert advertisement sponsored promo banner-ad", inner, "div div aside section p")

    def sidebar(self) -> str:
        inner = f"<h3>{self.some(1, 4, '')}</h3>" + self.pick(self.links(3, 9), f"<p>{self.some(8, 50)}</p>")
        return self.pick(f"<aside>{inner}</aside>", self.box("sidebar related widget recommended aside", inner, "div aside section"))

    def notice(self) -> str:
        inner = f"<p>{self.some(6, 45)}</p>" + self.pick("", "<button>OK</button>", '<a href="/p">More</a>')
        return self.box("cookie-notice notice consent gdpr-banner popup alert modal disclaimer", inner, "div section div")

    def form(self) -> str:
        inner = f"<label>{self.some(1, 4, '')}</label><input name=q><p>{self.some(3, 25)}</p><button>{self.some(1, 2, '')}</button>"
        plain = f"<form>{inner}</form>"
        return self.pick(plain, self.box("newsletter subscribe signup login search", self.pick(plain, inner)))

    def comments(self) -> str:
        one = lambda: self.box("comment reply response", f"<b>{self.some(1, 2, '')}</b><p>{self.some(4, 60)}</p>", "div li article")
        inner = f"<h3>{self.some(1, 3, '')}</h3>" + "".join(one() for _ in range(self.rng.randint(1, 5)))
        return self.box("comments comment-list responses disqus respond", inner, "div section ol aside")

    def share(self) -> str:
        return self.box("share social sharing tools meta tags byline", self.links(2, 5), "div ul p")

    def part(self) -> str:
        """One block of an article."""
        r = self.rng.random()
        if r < 0.68:
            low, high = self.rng.choice(((1, 6), (5, 90), (5, 90), (5, 90), (40, 400)))
            text = self.some(low, high)
            if self.rng.random() < 0.25:
                text += f' <a href="/l">{self.some(1, 4, "")}</a> ' + self.some(2, 12)
            if self.rng.random() < 0.15:
                return f"<p data-in><b>{text}<br>"
            return f"<p data-in>{text}</p>" if self.rng.random() < 0.85 else f"<div data-in>{text}</div>"
        if r < 0.78:
            tag = self.pick("h2", "h3", "h4")
            return f"<{tag} data-in>{self.some(1, 8, '')}</{tag}>"
        if r < 0.86:
            items = "".join(f"<li data-in>{self.some(1, 20, self.pick('', '.'))}</li>" for _ in range(self.rng.randint(2, 6)))
            return f"<ul data-in>{items}</ul>"
        if r < 0.9:
            return f"<blockquote data-in><p data-in>{self.some(6, 40)}</p></blockquote>"
        if r < 0.93:
            cells = "".join(f"<tr data-in><td data-in>{self.some(1, 5, '')}</td><td data-in>{self.some(1, 5, '')}</td></tr>" for _ in range(3))
            return f"<table data-in>{cells}</table>"
        if r < 0.96:
            return f"<figure data-in><img src=x><figcaption data-in>{self.some(3, 15)}</figcaption></figure>"
        return self.pick(self.advert(), self.share(), self.sidebar(), self.form())

    def article(self) -> str:
        parts = [self.part() for _ in range(self.rng.choice((1, 2, 3, 4, 6, 9, 14, 20)))]
        if self.rng.random() < 0.85:
            title = f"<h1 data-in>{self.some(3, 12, '')}</h1>"
            parts.insert(0, f"<header data-in>{title}</header>" if self.rng.random() < 0.15 else title)
        if self.rng.random() < 0.25:
            parts.append(self.pick(self.comments(), self.share(), self.form(), self.advert()))
        inner = "".join(parts)
        if self.rng.random() < 0.25:
            inner = f"<div data-in>{inner}</div>"
        r = self.rng.random()
        if r < 0.4:
            return f"<article data-in>{inner}</article>"
        name = self.pick("content", "post", "article-body", "entry-content", "story", "main-text", "post-content", "page-content")
        tag = self.pick("div", "div", "section", "main", "article")
        return f'<{tag} data-in class="{name}">{inner}</{tag}>' if r < 0.9 else f"<{tag} data-in>{inner}</{tag}>"

    def page(self) -> str:
        many = lambda *makers: [self.pick(*makers)() for _ in range(self.rng.randint(0, 3))]
        before = many(self.menu, self.header, self.advert, self.notice, self.form)
        after = many(self.sidebar, self.comments, self.advert, self.share, self.form, self.notice, self.menu)
        middle = before + [self.article()] + after + ([self.footer()] if self.rng.random() < 0.85 else [])
        if self.rng.random() < 0.7:
            middle.insert(0, self.pick(self.menu, self.header)())
        if self.rng.random() < 0.08:  # an article and little else
            middle = [self.article(), *[self.footer() for _ in range(self.rng.randint(0, 1))]]
            return self.pick("<body>", "") + "".join(middle)
        inner = "".join(middle)
        if self.rng.random() < 0.4:
            inner = self.box("wrapper container page-wrap layout", inner, "div")
        return f"<html><head><title>{self.some(2, 9, '')}</title></head><body>{inner}</body></html>"


def _labelled(source: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of one training page; the mark is taken off before features are read."""
    inside: list[bool] = []

    class Marked(Page):
        def _open(self, tag, attributes):
            node = super()._open(tag, attributes.replace(" data-in", ""))
            while len(inside) <= node:
                inside.append(False)
            inside[node] = " data-in" in attributes
            return node

    page = Marked(source)
    picked, rows = features(page)
    inside += [False] * (len(page.tags) - len(inside))
    return rows, np.array(inside)[picked].astype(float)


_MODEL: list[Trees] = []


def model() -> Trees:
    """The trees, trained once per process."""
    if not _MODEL:
        layout = Layout(SEED)
        rows, labels = zip(*[_labelled(layout.page()) for _ in range(TRAINING_PAGES)], strict=True)
        _MODEL.append(Trees().fit(np.concatenate(rows), np.concatenate(labels)))
    return _MODEL[0]


# ---- decoding ----------------------------------------------------------------------------------


def decode(page: Page, picked: np.ndarray, odds_of: np.ndarray) -> list[bool]:
    """Whether each element is inside the article, given the log odds of the picked ones."""
    n = len(page.tags)
    odds = np.zeros(n)
    odds[picked] = odds_of
    odds[[i for i in picked.tolist() if _KIND.get(page.tags[i], -1) in _NEVER]] = -50.0
    decided = np.zeros(n)
    decided[picked] = 1.0
    # Best totals of each subtree: outside, inside (with the bonus for staying), undecided.
    inside = (decided * (STAY - np.logaddexp(0, -odds))).tolist()
    outside = (decided * -np.logaddexp(0, odds)).tolist()
    open_ = list(outside)
    parents = page.parents
    for i in range(n - 1, 0, -1):
        p, a, b, c = parents[i], outside[i], inside[i], open_[i]
        outside[p] += a
        inside[p] += b if b > a else a
        open_[p] += max(a, b, c)
    state = [0] * n  # 0 undecided, 1 inside, -1 outside
    for i in range(1, n):
        above = state[parents[i]]
        if above < 0:
            state[i] = -1
        elif above > 0:
            state[i] = 1 if inside[i] >= outside[i] else -1
        else:
            best = max(open_[i], inside[i], outside[i])
            state[i] = 1 if inside[i] == best else 0 if open_[i] == best else -1
    return [x > 0 for x in state]


def main_texts(sources: list[str], trees: Trees) -> list[str]:
    """The article's blocks, one per line, of each page; all pages are scored together."""
    pages = [Page(source) for source in sources]
    found = [features(page) for page in pages]
    if not found:
        return []
    odds = trees.log_odds(np.concatenate([rows for _, rows in found]))
    cuts = np.cumsum([len(picked) for picked, _ in found])[:-1]
    texts = []
    for page, (picked, _), own in zip(pages, found, np.split(odds, cuts), strict=True):
        inside = decode(page, picked, own)
        texts.append("\n".join([text for node, text in page.blocks if inside[node]]))
    return texts


FIELDS = (("page_id", "long"), ("url", "string"), ("text", "string"), ("n_chars", "long"))


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page.

    A null or empty page, and one without an article, has the empty text. Rows are independent:
    null ids and repeated rows are kept as they come, other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model())

    def of_slice(ids, urls, sources):
        texts = main_texts(sources, shared.value)
        return [ids, urls, texts, [len(text) for text in texts]]

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), whole("html").alias("html"))
    return map_slices(rows, of_slice, FIELDS)
