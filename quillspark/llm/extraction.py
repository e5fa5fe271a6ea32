"""Operator 9: main text of web pages as a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, tags negative with
a weight per tag that is learned from labelled pages; the contiguous run with the
largest sum, found in one linear scan, is the content region.

Words inside side elements (menus, headers, notices, adverts, forms, reader
comments ...) score nothing and never stand in the text. Whether an element is one
is a sum of learned weights too: of its tag, role and the words of its class and
id, alone or as part of a name (``has-sidebar`` is no ``sidebar``), of its share
of the page's words, of those words that are links, and of what it holds or stands
in. So a mark alone does not remove an element that holds the article. Scripts,
styles and other raw text are no words at all.

The region takes the containers around it while most of their words are its own
and the others are no links. Inside it a block element or a line break ends a block. Character
references are decoded, white space in a block becomes one space, and the blocks
stand one to a line in page order.

Weights: each labelled page gives, for every tag, how often it stands inside and
outside the marked region; a tag's penalty is its smoothed share outside times
``OUTSIDE`` plus ``INSIDE``. Weights of marks are a ridge logistic regression over
the pages' elements. The pages that the default weights come from are below;
``learn`` takes any others.

Defined results: a null or empty page, and one without words in the region, give
an empty text; unclosed elements reach to the end of their block; repeated rows
get equal results; an empty table gives no rows; columns other than ``page_id``,
``url`` and ``html`` are ignored. Pages of any length are read whole.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.runtime import ship, table

WORD = 1.0
INSIDE, OUTSIDE = 0.05, 3.0
#: a region with so much of its container's words takes the whole container, if no more of the others are links
WHOLE, LINKED = 0.7, 0.3
#: an element with so much of the page's words is measured as holding some or most of them
SOME, MOST = 0.2, 0.8
_CONTAINERS = frozenset(("article", "main", "section", "div", "td"))

# elements whose content is no markup
_RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes")
# a name that begins so tells what a page has or lacks, not what the element is
_TELLS = frozenset(("has", "with", "no", "without", "is", "not", "show", "hide"))
_NAME, _PART = re.compile(r"[^\s]+"), re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
# a start of one of these ends an open paragraph
_ENDS_P = _BLOCK - {"br", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "caption", "title"}
_ENDS = frozenset(("/body", "/html", "/div", "/article", "/main", "/section"))
_WHOLE = frozenset(("html", "body", "main"))
# tags that no side element is made of for the tag alone
_TEXT = frozenset("a abbr b big blockquote body center cite code div dd del dfn dl dt em font h1 h2 h3 h4 h5 h6 html i ins kbd li main mark ol p pre q s section small span strike strong sub sup table tbody td tfoot th thead tr tt u ul var".split())
_OPEN = re.compile(r"<(?:(?P<comment>!--)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*)|(?P<other>[!?/]))")
_COMMENT_END, _OTHER, _CDATA = re.compile(r"--!?>"), re.compile(r"[^<>]*>"), "<![CDATA["
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}
# attributes without marks in them, up to the end of the tag
_PLAIN = re.compile(r"(?:=\s*\"[^\"<]*\"|=\s*'[^'<]*'|[^>\"'<])*+>")
# the end of a tag, or one attribute; of a quoted value only its opening quote
_STEP = re.compile(r"[\s/]*+(?:(?P<close>>)|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:(?P<quote>[\"'])|[^\s>]*+))?)")
_ATTR = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*+)))?")


def marks(name: str, attrs: str) -> list[str]:
    """Features of an element's tag and attributes."""
    out = ["tag " + name] if name not in _TEXT else []
    if not attrs:
        return out
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            for whole in _NAME.findall(value):
                parts = [x.lower().rstrip("s") for x in _PART.findall(whole)]
                if parts and parts[0] not in _TELLS:
                    out += parts if len(parts) == 1 else [*parts, "".join(parts), "joined"]
        elif key == "role":
            out.append("role " + value.lower())
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            out.append("hidden")
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            out.append("hidden")
        elif key == "x-side":
            out.append("x-side")
    return out


def _tags(page: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of every piece of markup; names of end tags start with a slash, others have none.

    Linear: a scan that meets the end of the page marks its steps, and none is taken twice.
    """
    last, dead, at = {q: page.rfind(q) for q in "\"'>"}, set(), 0

    def close(p: int) -> int:
        """Where the tag ends whose attributes start at ``p``; without a matching quote at the next mark."""
        if m := _PLAIN.match(page, p):
            return m.end()
        first, steps = p, []
        while p not in dead and (m := _STEP.match(page, p)):
            if m["close"]:
                return m.end()
            steps.append(p)
            p = m.end()
            if m["quote"]:
                if p > last[m["quote"]]:
                    break
                p = page.find(m["quote"], p) + 1
        dead.update(steps)
        return page.find(">", first) + 1 if first <= last[">"] else 0

    while m := _OPEN.search(page, at):
        start, at, name, attrs = m.start(), m.end(), "", ""
        if m["comment"]:
            at = e.end() if (e := _COMMENT_END.search(page, at)) else len(page)
        elif m["other"]:
            if page[start : start + len(_CDATA)].upper() == _CDATA:
                end = page.find(">", at) + 1 if at <= last[">"] else 0
            else:
                end = e.end() if (e := _OTHER.match(page, at)) else 0
            if not end:
                continue
            at = end
        else:
            end = close(at)
            if not end:
                continue
            name, attrs, follow = m["end"] + m["name"].lower(), page[at : end - 1], page[at]
            at = end
            if name in _RAW_END and (follow in "/>" or follow.isspace()):
                at, name = e.end() if (e := _RAW_END[name].search(page, at)) else len(page), ""
        yield start, at, name, attrs


@dataclass
class Page:
    """Tokens (tag, attributes, decoded text, words) of a page and where the element that opens at a token ends."""

    tokens: list[tuple[str, str, str, int]]
    end: dict[int, int]

    @classmethod
    def of(cls, page: str) -> Page:
        """Linear in the page: end tags close the nearest element of their name."""
        tokens: list[tuple[str, str, str, int]] = []
        at = 0

        def text(x: str) -> tuple[str, str, str, int]:
            x = _html.unescape(x) if "&" in x else x
            return "", "", x, len(x.split())

        for start, stop, name, attrs in _tags(page):
            if start > at:
                tokens.append(text(page[at:start]))
            at = stop
            if name:
                tokens.append((name, attrs, "", 0))
        if at < len(page):
            tokens.append(text(page[at:]))
        end: dict[int, int] = {}
        opened: list[int] = []
        places: dict[str, list[int]] = {}  # where in ``opened`` the elements of a name are
        for k, (tag, attrs, _, _) in enumerate(tokens):
            if tag[:1] == "/":
                if places.get(tag[1:]):
                    cut = places[tag[1:]][-1]
                    end[opened[cut]] = k + 1
                    for o in opened[cut:]:
                        places[tokens[o][0]].pop()
                    del opened[cut:]
            elif tag and tag not in _VOID and attrs[-1:] != "/":
                places.setdefault(tag, []).append(len(opened))
                opened.append(k)
        # what nothing closes ends with its block
        stop = len(tokens)
        for k in range(len(tokens) - 1, -1, -1):
            tag, attrs, _, _ = tokens[k]
            if tag and tag[0] != "/" and tag not in _VOID and attrs[-1:] != "/":
                end.setdefault(k, stop)
            if tag in _ENDS_P or tag in _ENDS:
                stop = k
        return cls(tokens, end)

    def counts(self) -> tuple[list[int], list[int], list[int], list[int]]:
        """Running numbers of words, words in links, first headings and article elements."""
        n = x = h = r = depth = 0
        words, linked, heads, articles = [0], [0], [0], [0]
        for tag, _, _, more in self.tokens:
            if tag == "a":
                depth += 1
            elif tag == "/a":
                depth = max(0, depth - 1)
            elif tag == "h1":
                h += 1
            elif tag == "article" or tag == "main":
                r += 1
            n += more
            x += more if depth else 0
            words.append(n)
            linked.append(x)
            heads.append(h)
            articles.append(r)
        return words, linked, heads, articles

    def judged(self) -> Iterator[tuple[int, list[str], list[float]]]:
        """(token, marks, measures) of every element that has a mark."""
        odd = [(k, found) for k, (tag, attrs, _, _) in enumerate(self.tokens) if tag and tag[0] != "/" and (attrs or tag not in _TEXT) and k in self.end and tag not in _WHOLE and (found := marks(tag, attrs))]
        if not odd:
            return
        words, linked, heads, articles = self.counts()
        total = max(words[-1], 1)
        held = sorted((k, self.end[k]) for k, t in enumerate(self.tokens) if t[0] in ("article", "main") and k in self.end)
        at, upto = 0, -1  # how far the articles that open before an element reach
        for k, found in odd:
            while at < len(held) and held[at][0] < k:
                upto, at = max(upto, held[at][1]), at + 1
            e = self.end[k]
            n, head, within = words[e] - words[k], float(heads[e] > heads[k]), float(upto > k)
            yield k, found, [
                1.0, float(n > SOME * total), float(n > MOST * total), (linked[e] - linked[k]) / max(n, 1), head, float(articles[e] > articles[k + 1]), within, within * head
            ]


MEASURES = 8


@dataclass(frozen=True)
class Weights:
    """Penalties of tags, weights of marks and of an element's measures."""

    tags: dict[str, float]
    marks: dict[str, float]
    measures: tuple[float, ...]

    def side(self, found: list[str], measures: list[float]) -> bool:
        """Whether these make a side element; without a known mark measures alone do not."""
        known = [x for x in found if x in self.marks]
        return any(x != "joined" for x in known) and sum(self.marks[x] for x in known) + sum(a * b for a, b in zip(self.measures, measures)) > 0


def sequence(page: str, weights: Weights) -> list[tuple[str, str, int]]:
    """(tag, text, words) tokens: a tag name, ``side`` for a whole side element, or '' and a stretch of text."""
    p = Page.of(page)
    skip = {k: p.end[k] for k, found, measures in p.judged() if weights.side(found, measures)}
    return _without(p, skip)


def _without(p: Page, skip: dict[int, int]) -> list[tuple[str, str, int]]:
    out, k = [], 0
    tokens = [(t, x, n) for t, _, x, n in p.tokens]
    for a in sorted(skip):
        if a >= k:
            out += tokens[k:a]
            out.append(("side", "", 0))  # what is left of it parts blocks
            k = max(skip[a], a + 1)
    return out + tokens[k:]


#: labelled pages (fixed values): {{ }} mark the region
LABELLED = (
    "<html><head><title>a</title></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a>News</a></li></ul></nav><div class='ad'>Buy it now</div>"
    "<article>{{<h1>How bread rises</h1><p>Yeast eats the sugar in flour and gives off gas.</p><p>The <b>dough</b> holds the gas and grows.<br>Heat sets it.</p>}}</article>"
    "<footer>all rights <a href='/c'>contact</a></footer></body></html>",
    "<body><table><tr><td><a>one</a></td><td><a>two</a></td></tr></table><div><div>{{<h2>Rain tonight</h2><p>Clouds come in from the west, and rain falls before dawn.</p>"
    "<ul><li>North: four to six millimetres of rain</li><li>South: it stays dry until noon</li></ul><p>Winds are light.</p>}}</div><div><ul><li><a>more</a></li><li><a>print</a></li></ul></div></div></body>",
    "<body><div><a>Start</a> <a>Shop</a> <a>Help</a></div><div><div>{{<p>A <i>short</i> note on <a>rivers</a>: they carve valleys, and they carry sand to the sea.</p><blockquote>Water wins.</blockquote>"
    "<p>Over ages <em>all</em> hills wear down.</p>}}</div></div><div><div><span>Tags</span> <a>water</a> <a>hills</a></div></div><div><small>printed on paper</small></div></body>",
    "<body><div><ul><li><a>in</a></li><li><a>out</a></li></ul></div><main>{{<section><h3>Stone walls</h3><div><div>Dry walls hold by <a>weight</a> and by friction alone.</div>"
    "<div>Each stone <span>crosses</span> the joint of the two below it.</div></div></section><section><h3>Repair</h3><div><table><tr><td>Tool</td><td>Use</td></tr>"
    "<tr><td>hammer</td><td>to dress a face</td></tr></table></div><ol><li>Strip the wall down to sound courses.</li><li>Lay the stones again from below.</li></ol></section>}}</main><div><a>next</a></div></body>",
    "<body><div><div><a>login</a></div></div><div>{{<div><h1>Ferry times</h1></div><div><p>Boats leave on the hour from both piers.</p></div><div><p>On feast days they leave <strong>twice</strong> as often.</p>"
    "<pre>first 06:00 last 23:00</pre></div><figure><figcaption>The old pier in winter</figcaption></figure>}}</div><div><div><a>map</a> <a>jobs</a></div></div></body>",
)


#: names of content wrappers and of side elements (fixed values): tag and attributes
WRAPPERS = (
    "div class='has-sidebar'", "div class='with-menu content'", "div class='no-banner layout'", "div class='social-studies'", "div class='header-image page'",
    "div class='search-guide'", "div class='comment-column'", "div id='related-rates'", "div class='ad-free'", "div class='cookie-recipe'", "section class='post hentry'",
    "div class='entry-content'", "article class='post'", "article", "div class='login-tutorial'", "div class='share-prices'", "td class='news-alert'", "div class='nav-ready content'",
    "div class='modal-logic'", "div class='footer-fixed main'", "section class='widget-story'", "div class='legal-history'", "div class='popup-books'", "div class='reply-paid'",
    "div class='newsletter-archive'", "div class='share-list'", "div class='box-area'", "div class='form-links'", "div class='post-left'", "div class='promo-code-story'", "div class='overlay-page'", "div class='hidden-rivers'", "div class='notice-period'",
)
SIDES = (
    "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "canvas", "object", "audio", "video", "head", "fieldset", "datalist", "map",
    *(f"div role='{r}'" for r in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form", "toolbar")),
    *(f"{t} {a}='{w}'" for w in (
        "ad", "advert", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "sidebar", "footer", "masthead",
        "header", "breadcrumb", "cookie", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "comment", "disqus", "reply", "replies",
        "respond", "discussion", "share", "sharing", "social", "related", "recommended", "recommendation", "pagination", "pager", "widget", "toolbar", "login", "signup", "search",
        "copyright", "legal", "skip", "hidden", "aside",
    ) for t, a in (("div", "class"), ("div", "id"))),
    *(f"div class='{w}'" for w in (
        "site-header", "page-header-bar", "site-footer", "footer-links", "main-nav", "nav-menu", "side-bar", "left-sidebar", "sidebar-inner", "ad-slot", "ad-box", "top-ad", "google-ads",
        "sponsor-box", "promo-box", "banner-top", "menu-list", "top-menu", "cookie-notice", "cookie-banner", "consent-box", "site-notice", "alert-box", "popup-box", "modal-window",
        "page-overlay", "newsletter-form", "comment-list", "comments-area", "reader-comments", "reply-form", "share-buttons", "social-links", "related-posts", "related-links",
        "recommended-items", "search-form", "search-box", "login-box", "legal-notice", "copyright-line", "widget-area", "skip-link", "subscribe-box", "user-comments", "post-comments",
        "bread-crumbs", "page-pagination", "tool-bar", "ad-container", "advert-wrapper", "sponsored-content", "commentlist", "adsbygoogle", "alert-info", "toolbar-left",
    )),
    "div hidden", "div aria-hidden='true'", "div style='display:none'",
)


def labelled() -> Iterator[str]:
    """``LABELLED``, and pages of one wrapper with one side element before, in or after the text."""
    yield from LABELLED
    head, text = "<h1>On tides</h1>", "<p>The sea comes in twice a day and goes out twice.</p><p>Sailors know the hours, and so do <a>the birds</a> on the flats.</p>"
    inner = ("<a>one</a> <a>two</a> three", "<h2>What readers say</h2>" + "<p>I read it all and liked what it says of birds.</p>" * 6, "a few plain words here", "<ul><li><a>tides</a></li></ul>")
    for k, side in enumerate(SIDES):
        tag, wrap = side.split()[0], WRAPPERS[k % len(WRAPPERS)]
        for j in (k, k + 1):
            odd = f"<{side} x-side>{inner[j % 4]}</{tag}>"
            body = [odd, f"<{wrap}>{{{{{head * (j % 3 > 0)}{text}}}}}</{wrap.split()[0]}>"][:: -1 if j % 2 else 1]
            yield f"<body><div class='page'>{''.join(body)}</div></body>"
        yield f"<body><main><article>{{{{{head}{text}<{side} x-side>{inner[k % 4]}</{tag}>{text}}}}}</article></main></body>"
        if "comment" in side or "disqus" in side or "repl" in side:
            yield f"<body><div>{{{{{head}{text}}}}}</div><{side} x-side>{inner[1] * 9}</{tag}></body>"
        # the same name on what holds the article
        if tag in ("div", "section") and "role" not in side and side[:10] != "div hidden" and side[:9] != "div aria-" and "style" not in side:
            yield f"<body><nav x-side><a>in</a> <a>on</a></nav><{side}>{{{{{head}{text}}}}}</{tag}></body>"
        if tag == "header":
            yield f"<body><{side} x-side><h1>Sea News</h1><a>all</a></{tag}><div>{{{{<h2>On tides</h2>{text}}}}}</div></body>"
    for k, wrap in enumerate(WRAPPERS):
        tag, part = wrap.split()[0], inner[k % 4]
        yield f"<body><nav x-side><a>in</a></nav><{wrap}>{{{{<article><header><h1>Salt</h1></header><p>Salt keeps fish and meat for months.</p></article>}}}}<aside x-side>{part}</aside></{tag}><footer x-side>end</footer></body>"
        yield f"<body><{wrap}>{{{{{text}}}}}</{tag}></body>"
        yield f"<body><{wrap}>{{{{{text}}}}}<div id='comments' x-side>{inner[1]}</div></{tag}></body>"


def learn(pages: Iterable[str], ridge: float = 0.05, steady: float = 2.0) -> Weights:
    """Weights from pages whose region stands between {{ and }}; ``x-side`` marks elements that are none of it.

    ``steady`` is the ridge of the measures: marks should tell the elements apart where they can.
    """
    inside, outside, rows = Counter(), Counter(), []
    for page in pages:
        p = Page.of(page.replace("{{", "<x-region>").replace("}}", "</x-region>"))
        a = next((k for k, t in enumerate(p.tokens) if t[0] == "x-region"), 0)
        b = next((k for k, t in enumerate(p.tokens) if t[0] == "/x-region"), 0)
        skip = {}
        for k, found, measures in p.judged():
            side = "x-side" in found or p.end[k] <= a or k > b
            if "x-side" in found:
                skip[k] = p.end[k]
            rows.append((found, measures, side))
        region = False
        for t, _, _ in _without(p, skip):
            if t in ("x-region", "/x-region"):
                region = t == "x-region"
            elif t and t != "side":
                (inside if region else outside)[t.lstrip("/")] += 1
    tags = {t: INSIDE + OUTSIDE * (outside[t] + 0.02) / (inside[t] + outside[t] + 0.5) for t in inside.keys() | outside.keys()}
    # marks are what side elements have; words are, if one makes up the whole name of some
    sides = {x for found, _, _ in rows if "x-side" in found for x in found if "joined" not in found or " " in x or x == "joined"} - {"x-side"}
    rows = [([x for x in found if x in sides], measures, side) for found, measures, side in rows]
    rows = [r for r in rows if r[0]]
    names = sorted({x for found, _, _ in rows for x in found})
    at = {x: MEASURES + i for i, x in enumerate(names)}
    x, y = np.zeros((len(rows), MEASURES + len(names))), np.array([r[2] for r in rows], float)
    for r, (found, measures, _) in enumerate(rows):
        x[r, :MEASURES] = measures
        x[r, [at[f] for f in found]] = 1.0
    w, cost = np.zeros(x.shape[1]), np.where(np.arange(x.shape[1]) < MEASURES, steady, ridge)
    free = np.full(len(w), True)
    for _ in range(100):  # Newton steps; a mark that would speak for content says nothing
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        part = x[:, free]
        step = np.linalg.solve((part * (p * (1 - p))[:, None]).T @ part + np.diag(cost[free]), part.T @ (p - y) + cost[free] * w[free])
        w[free] -= step
        if np.abs(step).max() < 1e-9:
            low = (w < 0) & (np.arange(len(w)) >= MEASURES) & np.array([True] * MEASURES + [n != "joined" for n in names])
            if not low.any():
                break
            w[low], free = 0.0, free & ~low
    return Weights(tags, dict(zip(names, w[MEASURES:].tolist())), tuple(w[:MEASURES].tolist()))


@lru_cache(1)
def default_weights() -> Weights:
    """Weights learned from ``labelled()``."""
    return learn(labelled())


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the run with the largest sum; the earliest and then longest of equals."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best or total == best > 0 and span[0] == start:
            best, span = total, (start, k + 1)
    return span


def whole_container(tokens: list[tuple[str, str, int]], scores: list[float], a: int, b: int) -> tuple[int, int]:
    """The widest container around a region that adds few words to it, and few of those in links; else the region.

    Short blocks at a region's edge score less than the tags before them cost.
    """
    words, linked, inside = [0.0], [0.0], 0  # running counts
    for (t, _, _), s in zip(tokens, scores):
        inside = max(0, inside + (t == "a") - (t == "/a"))
        words.append(words[-1] + max(s, 0.0))
        linked.append(linked[-1] + (max(s, 0.0) if inside else 0.0))
    opened: list[tuple[str, int]] = []
    span = (a, b)
    for k, (t, _, _) in enumerate(tokens):
        if t in _CONTAINERS:
            opened.append((t, k))
        elif t[:1] == "/" and t[1:] in _CONTAINERS:
            at = next((i for i in range(len(opened) - 1, -1, -1) if opened[i][0] == t[1:]), None)
            if at is None:
                continue
            start = opened[at][1]
            del opened[at:]
            if start <= a and k >= b - 1:
                more = words[k] - words[start] - (words[b] - words[a])
                in_links = linked[k] - linked[start] - (linked[b] - linked[a])
                if words[b] - words[a] < WHOLE * (words[k] - words[start]) or in_links > LINKED * more:
                    break
                span = (start, k + 1)
    return span


def main_text(page: str | None, weights: Weights | None = None) -> str:
    """The text of the best region."""
    if not page:
        return ""
    weights = weights or default_weights()
    tokens = sequence(page, weights)
    other = INSIDE + OUTSIDE * 0.04  # a tag that no labelled page has
    penalty = {t: -weights.tags.get(t.lstrip("/"), other) for t in {t for t, _, _ in tokens}} | {"side": -INSIDE}
    scores = [WORD * n if not t else penalty[t] for t, _, n in tokens]
    a, b = whole_container(tokens, scores, *best_region(scores))
    blocks, run = [], []
    for t, x, _ in tokens[a:b]:
        if not t:
            run.append(x)
        elif t == "side" or t.lstrip("/") in _BLOCK:
            blocks.append(run)
            run = []
    blocks.append(run)
    lines = (" ".join("".join(r).split()) for r in blocks)
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x, weights) for x in b.column(2).to_pylist()]
            cols = [b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op9_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))
