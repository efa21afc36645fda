"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks in page order: maximal runs of text between block-level tags.
Each block has features of its ancestors (tags, words of class, id and role) and of its text; the
chain's two states are main text and the rest. The field is trained here on labelled pages from a
seeded generator (by penalised likelihood, forward-backward), and decoded by Viterbi.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML. What is skipped holds no text of the page, and runs on to the
# page's end if it is not closed; all other elements are read.
SKIPPED = ("script", "style", "template", "textarea")
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul br".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = frozenset("article aside body div footer form header main nav ol section table ul".split())
TAGS = "article main section div aside nav header footer form ul ol table blockquote pre figure figcaption button label fieldset dialog details head title address menu search body".split()
OWN = "p h1 h2 h3 h4 h5 h6 li td th dd dt div blockquote pre figcaption a span label button title section article body".split()
#: Words of class, id and role that tell parts of pages apart; a name that holds one counts.
NAMES = "ad ads advert sponsor promo banner popup cookie consent gdpr notice alert warning message comment reply respond discuss disqus sidebar side widget related recommend more share social follow nav menu breadcrumb crumb pagination pager toolbar header masthead logo top footer foot copyright legal bottom content article post entry story main body text prose page form login signup newsletter subscribe search tags meta byline author date caption".split()

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
GAP, SPACE, KEY, BARE = re.compile(r"[\s/]*"), re.compile(r"\s*"), re.compile(r"=?[^\s/>=]*"), re.compile(r"[^\s>]*")
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in (*SKIPPED, "title")}
PARTS = re.compile(r"[A-Za-z][a-z]*")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    names: frozenset[str]
    linked: int
    start: int


@dataclass
class Tag:
    """A start or end tag; `closed` is a tag that ends itself, `named` what class, id and role hold."""

    name: str
    end: bool
    closed: bool
    named: tuple[str, ...]
    at: int
    upto: int


def attributes(page: str, i: int) -> tuple[int, bool, list[str]]:
    """Reads a tag from the place after its name: the place after it (-1 if the page is cut off in
    it), whether it closes itself, and the values of class, id and role.

    A quote counts only at the start of a value. One that is never closed, or whose value runs over
    a `>` to a quote that no attribute can end with, is taken for a slip: the tag ends at that `>`.
    Every character is passed a bounded number of times, whatever the quotes.
    """
    n, named = len(page), []
    while True:
        gap = GAP.match(page, i).end()
        if gap >= n:
            return -1, False, named
        if page[gap] == ">":
            return gap + 1, gap > i and page[gap - 1] == "/", named
        m = KEY.match(page, gap)
        i = SPACE.match(page, m.end()).end()
        if i >= n or page[i] != "=":
            i = m.end()
            continue
        i = SPACE.match(page, i + 1).end()
        if i < n and page[i] in "\"'":
            close = page.find(page[i], i + 1)
            over = page.find(">", i + 1, close if close >= 0 else n)
            if over >= 0 and (close < 0 or not (close + 1 >= n or page[close + 1] in "/> \t\n\r\f")):
                return over + 1, False, named
            if close < 0:
                return -1, False, named
            value, i = page[i + 1 : close], close + 1
        else:
            bare = BARE.match(page, i)
            value, i = bare[0], bare.end()
        if m[0].lower() in ("class", "id", "role"):
            named.append(value)


def tags_of(page: str) -> Iterator[Tag]:
    """Tags in page order. Comments, declarations, skipped elements and a tag in which the page is
    cut off come as a tag without a name."""
    i, n, titles = 0, len(page), True
    while (at := page.find("<", i)) >= 0:
        mark = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            close = page.find("-->", at + 2)
            i = n if close < 0 else close + 3
            yield Tag("", False, False, (), at, i)
        elif mark in ("!", "?"):
            close = page.find(">", at)
            i = n if close < 0 else close + 1
            yield Tag("", False, False, (), at, i)
        elif m := NAME.match(page, at + 1 + (mark == "/")):
            name = m[0].lower()
            upto, closed, named = attributes(page, m.end())
            i = n if upto < 0 else upto
            if upto < 0 or (name in SKIPPED and mark == "/"):
                yield Tag("", False, False, (), at, i)
            elif name in SKIPPED:
                if not closed:
                    close = ENDS[name].search(page, i)
                    i = n if close is None else i if (i := attributes(page, close.end())[0]) >= 0 else n
                yield Tag("", False, False, (), at, i)
            else:
                yield Tag(name, mark == "/", closed, tuple(named), at, i)
                if name == "title" and mark != "/" and not closed and titles:
                    close = ENDS[name].search(page, i)
                    titles = close is not None  # without an end there is none further on either
                    i = close.start() if close else i  # a title holds text alone
        elif mark == "/":
            close = page.find(">", at)
            i = n if close < 0 else close + 1
            yield Tag("", False, False, (), at, i)
        else:
            i = at + 1


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks in page order. Character references are decoded, white space inside a block is
    one space, blocks without text are left out. Unclosed, misnested and cut-off tags are borne, at
    any depth and in linear time. A block's path has each open tag once, at its innermost place; its
    names are those of NAMES that class, id and role of the open elements hold."""
    out: list[Block] = []
    # Of each open element: its tag, the path and names down to it, and its own names.
    stack: list[tuple[str, tuple[str, ...], frozenset[str], frozenset[str]]] = []
    places: dict[str, list[int]] = {}  # by tag, where it is in the stack
    pieces: list[str] = []
    linked = begin = 0
    page = page or ""

    def close_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, stack[-1][1] if stack else (), stack[-1][2] if stack else frozenset(), linked, begin))
            pieces.clear()
        linked = 0

    def take(raw: str, at: int) -> None:
        nonlocal linked, begin
        if raw:
            if not pieces:
                begin = at
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if places.get("a"):
                linked += len(text)

    def drop(k: int) -> None:
        for x in stack[k:]:
            places[x[0]].pop()
        del stack[k:]

    def push(tag: str, words: frozenset[str]) -> None:
        path, names = stack[-1][1:3] if stack else ((), frozenset())
        if not path or path[-1] != tag:
            path = (*(t for t in path if t != tag), tag) if len(tag) < 40 and (tag in TAG_AT or tag in OWN_AT) else path
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, path, names if words <= names else names | words, words))

    last = lambda tags: max((places[t][-1] for t in tags if places.get(t)), default=-1)
    end = 0
    for tag in tags_of(page):
        take(page[end : tag.at], end)
        end, name = tag.upto, tag.name
        if not name:
            continue
        if name in BLOCKS:
            close_block()
        if tag.end:
            if places.get(name):
                drop(places[name][-1])
            continue
        if name in CLOSES:
            own = last(CLOSES[name])
            if own >= 0 and own >= last(STOPS):
                drop(own)
        elif name == "body":
            outer = [stack[k][3] for k in places.get("html", ())]
            drop(0)
            for words in outer:
                push("html", words)
        if name not in EMPTY and not tag.closed:
            push(name, frozenset(n for value in tag.named for w in PARTS.findall(value) for n in name_words(w.lower())))
    take(page[end:], end)
    close_block()
    return out


NAME_AT = {w: len(TAGS) + len(OWN) + k for k, w in enumerate(NAMES)}
TAG_AT = {t: k for k, t in enumerate(TAGS)}
OWN_AT = {t: len(TAGS) + k for k, t in enumerate(OWN)}
SHAPES = 24
FEATURES = len(TAGS) + len(OWN) + len(NAMES) + SHAPES


@lru_cache(maxsize=50_000)
def name_words(word: str) -> tuple[str, ...]:
    """The NAMES that a word of a class, id or role holds."""
    return tuple(n for n in NAMES if word == n or word == n + "s" or (len(n) > 3 and n in word))


def features(blocks: list[Block]) -> list[list[int]]:
    """Numbers of the features that each block has."""
    out = []
    base = FEATURES - SHAPES
    for k, b in enumerate(blocks):
        f = {TAG_AT[t] for t in b.path if t in TAG_AT}
        own = next((t for t in reversed(b.path) if t in OWN_AT), "body")
        f.add(OWN_AT[own])
        f.update(NAME_AT[w] for w in b.names)
        n = len(b.text)
        f.add(base + min(6, n.bit_length() // 2))
        f.add(base + 7 + min(3, int(4 * b.linked / n)))
        f.add(base + 11 + (b.text[-1] in ".!?…\"')"))
        f.add(base + 13 + min(3, b.text.count(" ") // 6))
        if "©" in b.text or "copyright" in b.text.lower():
            f.add(base + 17)
        if k == 0:
            f.add(base + 18)
        if k == len(blocks) - 1:
            f.add(base + 19)
        if not any(t in ("article", "main") for t in b.path):
            f.add(base + 20)
        if not b.names:
            f.add(base + 21)
        f.add(base + 22)
        out.append(sorted(f))
    return out


@dataclass
class Field:
    """Weights of the main state by feature, of transitions [from, to] and of the first state."""

    weight: np.ndarray
    transition: np.ndarray
    first: np.ndarray

    def decode(self, rows: list[list[int]]) -> list[bool]:
        """Viterbi: the likeliest states, true for main text; ties go to the rest."""
        if not rows:
            return []
        w, (t00, t01), (t10, t11) = self.weight, self.transition.tolist()[0], self.transition.tolist()[1]
        emitted = [float(w[r].sum()) for r in rows]
        a, b = float(self.first[0]), float(self.first[1]) + emitted[0]
        back = []
        for e in emitted[1:]:
            from_b = (b + t10 > a + t00, b + t11 > a + t01)
            a, b = max(a + t00, b + t10), max(a + t01, b + t11) + e
            back.append(from_b)
        state = b > a
        states = [state]
        for step in reversed(back):
            state = step[state]
            states.append(state)
        return states[::-1]


def fit(pages: list[tuple[list[list[int]], list[bool]]], *, rounds: int = 220, rate: float = 0.08, penalty: float = 0.3) -> Field:
    """Maximises the penalised conditional likelihood of whole label sequences, by Adam on exact
    forward-backward gradients of all pages at once."""
    pages = sorted((p for p in pages if p[0]), key=lambda p: -len(p[0]))  # those that reach a place stand first
    n, t = len(pages), max(len(p[0]) for p in pages)
    y, on = np.zeros((n, t), np.int64), np.zeros((n, t), bool)
    for k, (rows, labels) in enumerate(pages):
        y[k, : len(labels)] = labels
        on[k, : len(rows)] = True
    # Features of all blocks in page order, as numbers; every block has one at least.
    held = [r for rows, _ in pages for r in rows]
    at, lens = np.concatenate([np.array(r) for r in held]), np.array([len(r) for r in held])
    start = np.concatenate(([0], np.cumsum(lens)[:-1]))
    summed = lambda p: np.bincount(at, np.repeat(p[on], lens), FEATURES)
    size = FEATURES + 6
    theta, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    seen_first = np.bincount(y[:, 0], minlength=2).astype(float)
    both = on[:, 1:]
    seen_pairs = np.bincount((2 * y[:, :-1] + y[:, 1:])[both], minlength=4).astype(float)
    seen_x = summed(y.astype(float))
    reach = on.sum(0)
    for step in range(1, rounds + 1):
        w, first = theta[:FEATURES], np.exp(theta[FEATURES + 4 :])
        pair = np.exp(theta[FEATURES : FEATURES + 4].reshape(2, 2))
        e = np.ones((n, t, 2))
        e[on, 1] = np.exp(np.add.reduceat(w[at], start))
        # Forward and backward in probabilities, each place scaled to a sum of 1.
        ahead, behind = np.zeros((n, t, 2)), np.ones((n, t, 2))
        ahead[:, 0] = first * e[:, 0]
        ahead[:, 0] /= ahead[:, 0].sum(1, keepdims=True)
        for i in range(1, t):
            k = reach[i]
            here = (ahead[:k, i - 1] @ pair) * e[:k, i]
            ahead[:k, i] = here / here.sum(1, keepdims=True)
        for i in range(t - 2, -1, -1):
            k = reach[i + 1]
            here = (e[:k, i + 1] * behind[:k, i + 1]) @ pair.T
            behind[:k, i] = here / here.sum(1, keepdims=True)
        p = ahead * behind
        p /= np.maximum(p.sum(2, keepdims=True), 1e-300)
        q = ahead[:, :-1, :, None] * pair * (e[:, 1:] * behind[:, 1:])[:, :, None, :]
        q *= both[:, :, None, None] / np.maximum(q.sum((2, 3), keepdims=True), 1e-300)
        grad = np.concatenate((seen_x - summed(p[:, :, 1]), seen_pairs - q.sum((0, 1)).reshape(-1), seen_first - p[:, 0].sum(0))) - penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(theta[:FEATURES].astype(np.float32), theta[FEATURES : FEATURES + 4].reshape(2, 2), theta[FEATURES + 4 :])


def labelled_page(rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A made-up page and the spans of its main text in the source."""
    syllables = "an be co de er fi ga ho in ka le mi no or pa qui re sa tion und vi wo ä é ñ".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    mess = rng.choice(["", "", "", "&amp;&amp;&amp;", "%%%", "###", "!!", " |"])
    one = lambda: word() + (mess if rng.random() < 0.7 else "")
    sentence = lambda a=3, b=18: (" ".join(one() for _ in range(rng.randint(a, b)))).capitalize() + rng.choice([".", ".", "", "!"])
    prose = lambda: " ".join(sentence() for _ in range(rng.randint(1, 6) if rng.random() < 0.85 else rng.randint(7, 40)))
    links = lambda a=2, b=8: "<ul>" + "".join(f'<li><a href="/{word()}">{" ".join(word() for _ in range(rng.randint(1, 4)))}</a></li>' for _ in range(rng.randint(a, b))) + "</ul>"
    pick = rng.choice
    parts: list[tuple[str, bool]] = []
    rest = lambda s: parts.append((s, False))
    main = lambda s: parts.append((s, True))

    def advert() -> str:
        return pick(['<div class="ad">{}</div>', '<div class="ads banner">{}</div>', '<div id="ad-slot-3"><span>{}</span></div>', '<aside class="advertisement"><p>{}</p></aside>', '<div class="sponsored"><a href="#">{}</a></div>', '<div class="promo-box"><p>{}</p></div>']).format(prose())

    def aside() -> str:
        return pick(['<aside>{}</aside>', '<div class="sidebar"><h3>' + sentence(1, 3) + '</h3>{}</div>', '<div id="side" class="widget-area">{}</div>', '<div class="related-posts"><h2>' + sentence(1, 3) + '</h2>{}</div>', '<section class="recommended">{}</section>']).format(pick([links(), f"<p>{prose()}</p>", links() + f"<p>{prose()}</p>"]))

    def notice() -> str:
        return pick(['<div class="cookie-notice"><p>{}</p><button>' + word() + "</button></div>", '<div id="gdpr-consent">{}</div>', '<div class="alert notice">{}</div>', '<div role="alert">{}</div>', '<dialog open><p>{}</p></dialog>', '<div class="banner cookie">{}</div>']).format(prose())

    def form() -> str:
        return pick(['<form action="/s"><label>{}</label><input name="q"><button>' + word() + "</button></form>", '<form class="newsletter-signup"><p>{}</p><input type="email"><button>' + word() + "</button></form>", '<div class="subscribe"><form><p>{}</p></form></div>', '<form role="search"><input><button>{}</button></form>']).format(sentence())

    def comments() -> str:
        many = [prose() for _ in range(rng.randint(1, 5))]
        return pick([
            lambda: '<section class="comments"><h2>' + sentence(1, 3) + "</h2>" + "".join(f'<div class="comment"><b>{word()}</b><p>{c}</p></div>' for c in many) + "</section>",
            lambda: '<section id="comments">' + "".join(f"<article><p>{c}</p></article>" for c in many) + "</section>",
            lambda: '<ol class="commentlist">' + "".join(f'<li class="comment"><p>{c}</p></li>' for c in many) + "</ol>",
            lambda: '<div id="disqus_thread" class="discussion">' + "".join(f"<p>{c}</p>" for c in many) + "</div>",
            lambda: '<div class="reader-comments"><ul>' + "".join(f"<li>{c}</li>" for c in many) + "</ul></div>",
        ])()

    bare = rng.random() < 0.15  # a page of its article alone
    rest(pick([
        lambda: "<!DOCTYPE html><html><head><title>" + sentence(2, 8) + "</title><style>p{margin:0}</style><script>var t=\"</p>\";</script></head><body>",
        lambda: f'<!doctype html><html lang="{word()}"><head><meta charset="utf-8"><title>{sentence(1, 12)}</title><link rel=stylesheet href=/{word()}.css></head><body class="{word()} {word()}">',
        lambda: f"<html><head><title>{sentence(1, 5)}</title></head><body id={word()}>",
        lambda: f"<title>{sentence(1, 9)}</title>",
        lambda: '<html><head><meta charset="utf-8"><script src="/a.js"></script></head><body>',
        lambda: "<html><body>",
        lambda: "<body>",
        lambda: "",
    ])())
    if bare:
        return _bare_page(rng, parts, prose, sentence, word)
    if rng.random() < 0.35:
        rest(notice())
    if rng.random() < 0.55:
        rest(pick(["<header>{}</header>", '<div class="header">{}</div>', '<div id="masthead" class="site-header">{}</div>', '<header class="top"><h1>' + sentence(1, 3) + "</h1>{}</header>"]).format(pick([f"<h1>{sentence(1, 4)}</h1>", f'<a href="/">{word()}</a><p>{sentence()}</p>', links()])))
    if rng.random() < 0.8:
        rest(pick(["<nav>{}</nav>", '<div class="menu">{}</div>', '<ul class="nav">{}</ul>', '<div id="navigation">{}</div>', '<nav class="breadcrumbs">{}</nav>', "<menu>{}</menu>"]).format(links()))
    if rng.random() < 0.5:
        rest(advert())
    if rng.random() < 0.2:
        rest(aside())
    opening, closing = pick([("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<article class="post">', "</article>"), ('<div class="content">', "</div>"), ('<div id="content"><div class="entry-content">', "</div></div>"), ('<div class="article-body">', "</div>"), ('<section class="story">', "</section>"), ('<div id="main"><div class="post-text">', "</div></div>")])
    if rng.random() < 0.25:
        opening, closing = pick([('<div role="main">', "</div>"), (f'<div class="{word()}">', "</div>"), (f'<div id="{word()}"><div>', "</div></div>"), ("<section>", "</section>"), ("<table><tr><td>", "</td></tr></table>"), ("<div>", "</div>"), ("", ""), ('<main id="' + word() + '">', "</main>"), ('<article itemprop="articleBody" class="' + word() + '">', "</article>")])
    wrapper = rng.choice([0, 0, 0, 0, 1, 1, 2, 4])
    rest("".join('<div class="' + pick(["wrapper", "container", "page", "row", word(), "inner grid", "col-8"]) + '">' for _ in range(wrapper)) + opening)
    single = rng.random() < 0.2  # an article of one block
    if single:
        main(pick([f"<p>{prose()}</p>", f"<div>{prose()}</div>", prose(), f"<p>{sentence()}</p>"]))
    elif rng.random() < 0.85:
        main(f"<h1>{sentence(2, 10)}</h1>" if rng.random() < 0.8 else f"<h2>{sentence(2, 10)}</h2>")
    for _ in range(0 if single else rng.randint(1, 9)):
        r = rng.random()
        if r < 0.66:
            main(pick([f"<p>{prose()}</p>", f"<p>{prose()}</p>", f"<p>{prose()}", f"<p><b>{sentence()}<br>", f"<p>{sentence(1, 3)}</p>", f"<p>{sentence(1, 4)} <a href='#'>{word()}</a> {sentence(1, 6)}</p>", f"<div>{prose()}</div>"]))
        elif r < 0.72:
            main(f"<h2>{sentence(1, 6)}</h2>")
        elif r < 0.78:
            main(pick([f"<ul><li>{sentence()}</li><li>{sentence(1, 5)}</li></ul>", f"<blockquote><p>{prose()}</p></blockquote>", f"<pre>{sentence()}</pre>", f"<table><tr><td>{word()}</td><td>{word()}</td></tr></table>", f"<ol><li>{sentence()}</ol>"]))
        elif r < 0.86:
            rest(advert())
        elif r < 0.9:
            rest(pick(['<aside class="related">{}</aside>', '<div class="share-buttons">{}</div>', '<aside>{}</aside>']).format(links(1, 4)))
        elif r < 0.94:
            rest(form())
        else:
            rest(notice())
    inside = rng.random() < 0.3
    if inside and rng.random() < 0.6:
        rest(comments())
    rest(closing + "</div>" * wrapper)
    if rng.random() < 0.35:
        rest(comments())
    if rng.random() < 0.35:
        rest(aside())
    if rng.random() < 0.3:
        rest(form())
    if rng.random() < 0.25:
        rest(advert())
    if rng.random() < 0.85:
        rest(pick(["<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer">{}</div>', '<footer class="site-footer"><p>{}</p></footer>']).format("&copy; " + word() + ".example &middot; " + sentence() + (links(1, 4) if rng.random() < 0.3 else "")))
    rest(pick(["</body></html>", "", "</body>"]))
    return _joined(parts)


def _bare_page(rng: random.Random, parts: list[tuple[str, bool]], prose, sentence, word) -> tuple[str, list[tuple[int, int]]]:
    """A page without anything about its article: from a paragraph alone to headings and lists."""
    opening, closing = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), (f'<div class="{word()}">', "</div>"), ("", ""), ("", ""), ("<section>", "</section>"), ("<article><div><div>", "</div></div></article>")])
    parts.append((opening, False))
    if rng.random() < 0.4:
        parts.append((f"<h{rng.randint(1, 3)}>{sentence(1, 8)}</h{rng.randint(1, 3)}>", True))
    for _ in range(rng.choice([1, 1, 1, 2, 3, 6])):
        parts.append((rng.choice([f"<p>{prose()}</p>", f"<p>{prose()}", f"<div>{prose()}</div>", f"<p>{sentence(1, 4)}</p>", f"<ul><li>{sentence()}<li>{sentence()}</ul>", f"<blockquote>{prose()}</blockquote>", f"<pre>{prose()}</pre>", prose(), f"<p><a href=/{word()}>{word()}</a> {sentence()}</p>", f"<h2>{sentence(1, 4)}</h2><p>{prose()}</p>"]), True))
    parts.append((closing + rng.choice(["", "</body></html>", "</html>"]), False))
    return _joined(parts)


def _joined(parts: list[tuple[str, bool]]) -> tuple[str, list[tuple[int, int]]]:
    text, spans = "", []
    for s, is_main in parts:
        if is_main:
            spans.append((len(text), len(text) + len(s)))
        text += s
    return text, spans


def labelled_blocks(seed: int, n: int) -> list[tuple[list[list[int]], list[bool]]]:
    rng, out = random.Random(seed), []
    for _ in range(n):
        page, spans = labelled_page(rng)
        found = blocks_of(page)
        out.append((features(found), [any(s <= b.start < e for s, e in spans) for b in found]))
    return out


@lru_cache(maxsize=2)
def trained(seed: int = 17, pages: int = 900) -> Field:
    """The field, fitted on `pages` labelled pages of the seeded generator."""
    return fit(labelled_blocks(seed, pages))


def extract(page: str | None, field: Field) -> str:
    found = blocks_of(page)
    return " ".join(b.text for b, main in zip(found, field.decode(features(found)), strict=True) if main)


def main_text(pages: DataFrame, *, html_col: str = "html", field: Field | None = None) -> DataFrame:
    """Main text of every page: the input's columns, then text string and n_chars long.

    Null, empty and blank pages, and pages without main text, have an empty text. Pages are read
    whole, whatever their length; markup may be broken. Rows may repeat, keys may be null. Input
    columns named text or n_chars are replaced (an html column of those names is still read). An
    empty table gives an empty table. There is no shuffle; the broadcast field has a fixed size.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field or trained())
    kept = [f for f in pages.schema if f.name not in ("text", "n_chars")]

    def texts(source):
        return pa.array([extract(p, shared.value) for p in source.to_pylist()], pa.string())

    out = pages.select(*[F.col(f"`{f.name}`") for f in kept], F.arrow_udf(texts, "string")(F.col(html_col)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
