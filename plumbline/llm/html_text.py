"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by where they stand: plain
text by the length of its block, headings, links, and parts that markup names
(menu, advert, comment and so on). Tags score negative. Both weights are log-odds
learned from labelled pages (LABELLED below). One linear scan finds the contiguous
region with the highest sum. Where it lies in an <article> or <main>, it grows to
that element; elsewhere to its neighbours, plain blocks in the same parent, so no
short paragraph or heading at its edge is lost. Of the region, the parts that
markup names are left out.

Names in class, id and role count by their head noun ("legal-analysis" is no legal
part, "nav-bar left" is a menu), and not behind "with", "has" or "no". A named
element that holds the page's article, or a form, sidebar or notice around most
of its words, is a wrapper and names nothing.

Null or empty html, or a page without a positive word: empty text. Ties go to
the first region. Nothing is cut off, however long the page; elements nested more
than 512 deep count as part of the 512th. Repeated rows are judged each on its
own. Columns besides those in `keep` are left behind, so none can clash.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Element names of HTML.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr "
    "html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: What an element's name says its words are.
_BY_NAME = {
    "nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form", "button": "form", "select": "form", "dialog": "notice",
    "script": "code", "style": "code", "noscript": "code", "template": "code", "textarea": "form", "head": "code", "title": "code", "iframe": "code", "xmp": "code",
    "noembed": "code", "noframes": "code", "object": "code", "svg": "code", "canvas": "code", "audio": "code", "video": "code", "fieldset": "form", "datalist": "form",
}
#: What the head noun of a class, id or role says.
_BY_WORD = {
    "nav": "menu", "navbar": "menu", "navigation": "menu", "menu": "menu", "breadcrumb": "menu", "breadcrumbs": "menu", "pagination": "menu", "pager": "menu", "toc": "menu",
    "header": "header", "masthead": "header", "topbar": "header", "banner": "header", "logo": "header", "contentinfo": "footer",
    "footer": "footer", "copyright": "footer", "colophon": "footer", "legal": "footer",
    "sidebar": "sidebar", "aside": "sidebar", "complementary": "sidebar",
    "ad": "advert", "ads": "advert", "advert": "advert", "adverts": "advert", "advertisement": "advert", "adsbox": "advert", "promo": "advert", "sponsor": "advert",
    "sponsored": "advert", "promotion": "advert", "adslot": "advert", "adunit": "advert",
    "notice": "notice", "cookie": "notice", "cookies": "notice", "consent": "notice", "gdpr": "notice", "popup": "notice", "modal": "notice", "alert": "notice",
    "overlay": "notice", "paywall": "notice", "toast": "notice",
    "comment": "comment", "comments": "comment", "disqus": "comment", "replies": "comment", "respond": "comment", "commentlist": "comment", "discussion": "comment",
    "form": "form", "search": "form", "login": "form", "signup": "form", "subscribe": "form", "newsletter": "form", "share": "sidebar", "sharing": "sidebar", "social": "sidebar",
}
#: Words that say it whatever noun follows.
_BY_ADJECTIVE = {"related": "sidebar", "recommended": "sidebar", "trending": "sidebar", "sponsored": "advert", "promoted": "advert"}
#: Nouns that only say how a part is laid out: the one before them counts.
_LAYOUT = set("area bar block bottom box col column container element group inner item items left links list outer panel region right row section slot text top unit widget wrap wrapper".split())
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

#: Labelled pages: what stands between [[ and ]] is main text, the rest is not.
LABELLED = [
    """<html><head><title>News of the day</title><style>p{margin:0}</style></head><body><header><h2>The Daily Paper</h2><p>All the news</p></header>
    <nav><ul><li><a href="/">Home</a></li><li><a href="/w">World</a></li><li><a href="/s">Sport</a></li><li><a href="/c">Culture</a></li></ul></nav>
    <article>[[<h1>A bridge opens after ten years</h1><p>The new bridge over the river was opened on Monday after ten years of work and many delays.</p>
    <p>Hundreds of people walked over it in the first hour, and the mayor said that <b>the wait was worth it</b>.</p>]]<div class="ad">Buy our bread now, half price this week only</div>
    [[<p>The old bridge is to be torn down next year, as <a href="/b">reported before</a>.</p>]]</article>
    <aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten ways to cook rice</a></li><li><a href="/2">Rain in the south</a></li></ul></aside>
    <section class="comments"><h3>Comments</h3><div class="comment"><p>First! I like bridges a lot and walk there each day.</p></div><div class="comment"><p>They should have built a tunnel.</p></div></section>
    <footer>&copy; The Daily Paper, all rights reserved. <a href="/t">Terms</a> <a href="/p">Privacy</a></footer></body></html>""",
    """<html><body><div id="cookie-notice">We use cookies to make this site better. <button>Accept</button></div><div class="menu"><a href="/">Start</a> | <a href="/about">About</a> | <a href="/x">Archive</a></div>
    <div class="post">[[<h1>Notes on growing beans</h1><p>Beans want sun, water and something to climb on. I plant mine in May, when the nights stay warm.</p>
    <ul><li>Soak the seeds for a night.</li><li>Plant them two fingers deep.</li><li>Water when the soil is dry.</li></ul><blockquote><p>A bean a day keeps the hunger away.</p></blockquote>]]</div>
    <form action="/s"><label>Subscribe to the newsletter</label><input name="m"><button>Go</button></form><div class="related"><a href="/y">On growing peas</a> <a href="/z">On compost</a></div>
    <div class="footer">Made by hand in a garden</div><script>var x = "<p>not text</p>";</script></body></html>""",
    """<html><body><table><tr><td class="sidebar"><a href="a">One</a><br><a href="b">Two</a><br><a href="c">Three</a></td><td>[[<h2>How the machine works</h2>
    <p>The machine has three parts. The first takes in water, the second heats it, and the third turns the steam into motion.</p><p>It was built by two brothers, who never agreed on its colour.</p>]]</td></tr></table>
    <p class="copyright">Copyright of the museum</p></body></html>""",
    """<html><body class="home"><div id="wrap" class="wrap with-sidebar"><div class="top-bar"><a href="/">The river club</a> <a href="/join">Join</a></div><div>[[<h1>Rowing in winter</h1>
    <p>In winter the river is quiet. We row twice a week, at noon, when the light is best and the wind is low.</p><p>Bring gloves.</p><p>The boats are heavy with frost, so four of us carry each of them down to the water.</p>]]</div>
    <div><a href="/a">Boats</a> <a href="/b">People</a> <a href="/c">Races</a> <a href="/d">Map</a></div><div>Club house, river road 4</div></div></body></html>""",
    """<html><body><form id="aspnet" action="/page"><div class="header"><a href="/">Town hall</a></div><ul><li><a href="/1">Permits</a></li><li><a href="/2">Taxes</a></li><li><a href="/3">Waste</a></li></ul>
    <div class="text">[[<h2>New hours of the library</h2><p>From the first of May the library opens at eight in the morning and closes at nine in the evening, on all days but Sunday.</p>
    <p>Books can be handed back at any hour through the slot beside the door.</p>]]</div><div>Print this page</div></form></body></html>""",
    """<body><p><a href="/">Home</a> &gt; <a href="/recipes">Recipes</a></p>[[<h1>Onion soup</h1><p>Slice two pounds of onions and cook them slowly in butter for an hour, until they are brown and sweet.</p>
    <p>Add stock and simmer for half an hour more. Serve with <a href="/bread">toasted bread</a> and cheese.</p>]]<p>Tags: <a href="/t/soup">soup</a> <a href="/t/onion">onion</a></p>
    <div class="respond"><p>I made this with leeks and my whole family liked it very much indeed.</p></div></body>""",
    """<html><body><div class="nav-bar left"><a href="/n">News</a></div><main>[[<p>The council met on Friday and spoke for three hours about the price of water, which has doubled within two years.</p>
    <p>No vote was taken.</p><p>It will meet again in June, when the report of the engineers is due, and the public may attend.</p>]]<div class="sponsored-content">Try our insurance today and save</div></main>
    <div class="related-posts"><h3>More</h3><p>A dam breaks in the north after a week of rain, and many have to leave their homes.</p></div></body></html>""",
]


def _named(value: str | None) -> str | None:
    """What the words of a class, id or role name."""
    for token in (value or "").split():
        parts = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", token).lower()) if w]
        if not parts or len(parts) > 1 and parts[0] in ("with", "has", "no", "without"):
            continue
        if found := next((_BY_ADJECTIVE[w] for w in parts if w in _BY_ADJECTIVE), None):
            return found
        while len(parts) > 1 and parts[-1] in _LAYOUT:
            parts.pop()
        if found := _BY_WORD.get(parts[-1]):
            return found
    return None


def _kind(name: str, attributes: dict) -> str | None:
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return "code"
    if found := _BY_NAME.get(name):
        return found
    if name in ("body", "html"):
        return None
    found = next(filter(None, (_named(attributes.get(a)) for a in ("class", "id", "role"))), None)
    return found if name not in ("article", "main") or found == "comment" else None


class _Reader:
    """Tags and texts of a page, in one pass: what has been searched for in vain isn't searched for again."""

    def __init__(self, page: str):
        self.page, self.gone = page, set()

    def find(self, what: str, at: int) -> int:
        found = -1 if what in self.gone else self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Behind the tag's >, quoted values skipped; a quote that opens no value or never closes doesn't count. -1 without any >."""
        while m := _STOP.search(self.page, at) if ">" not in self.gone else None:
            at = m.end()
            if m.group() == ">":
                return at
            if self._opens(m.start()):
                close = self.find(m.group(), at)
                at = close + 1 if close >= 0 else at
        self.gone.add(">")
        return -1

    def _opens(self, at: int) -> bool:
        """An equals sign comes before, white space aside."""
        at -= 1
        while at >= 0 and self.page[at] in " \t\n\r\f":
            at -= 1
        return at >= 0 and self.page[at] == "="


class Page:
    """tokens: ("text", string, element) or ("tag", name, element); elements: lists by number of parent, name, own kind, first and end token."""

    def __init__(self, page: str):
        self.tokens: list[tuple[str, str, int]] = []
        self.parent, self.name, self.own, self.first, self.end, self.main = [-1], [""], [None], [0], [0], [False]
        self._read(page)
        self._kinds()

    def _read(self, page: str) -> None:
        out, stack, depth, reader = self.tokens, [0], Counter(), _Reader(page)
        at, n = 0, len(page)

        def pop() -> None:
            e = stack.pop()
            self.end[e] = len(out)
            depth[self.name[e]] -= 1

        def close(names: set, stops: set) -> None:
            """The innermost of names goes, with all in it, unless a stop is in between."""
            if any(depth[x] for x in names):
                for i in range(len(stack) - 1, 0, -1):
                    if self.name[stack[i]] in names:
                        while len(stack) > i:
                            pop()
                        return
                    if self.name[stack[i]] in stops:
                        return

        while at < n:
            if page[at] != "<":
                to = reader.find("<", at)
                to = n if to < 0 else to
                out.append(("text", page[at:to], stack[-1]))
                at = to
                continue
            if page.startswith("<!--", at):
                to = reader.find("-->", at + 4)
                at = n if to < 0 else to + 3
                continue
            if page.startswith("<![CDATA[", at) and (to := reader.find("]]>", at)) >= 0:
                out.append(("text", page[at + 9 : to], stack[-1]))
                at = to + 3
                continue
            if page[at + 1 : at + 2] in ("!", "?") and (to := reader.find(">", at)) >= 0:
                at = to + 1
                continue
            m = _NAME.match(page, at + 1)
            to = reader.tag_end(m.end()) if m else -1
            if to < 0:
                out.append(("text", "<", stack[-1]))
                at += 1
                continue
            name, inside, at = m.group(2).lower(), page[m.end() : to - 1], to
            if m.group(1):
                close({name}, set())
                out.append(("tag", name, stack[-1]))
                continue
            attributes = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(inside)} if inside.strip() else {}
            closes = _CLOSES.get(name) or ({"p"} if name in _BLOCK else None)
            if closes:
                close(closes, _STOPS.get(name, set()) | ({"table", "td", "th", "button", "div", "section", "article"} if closes == {"p"} else set()))
            out.append(("tag", name, stack[-1]))
            raw = name in _RAW
            if name in _VOID or inside.endswith("/") and name in ("svg", "path"):
                continue
            self.parent.append(stack[-1])
            self.name.append(name)
            self.own.append(_kind(name, attributes))
            self.main.append(name in ("article", "main") or attributes.get("itemprop") == "articleBody")
            self.first.append(len(out) - 1)
            self.end.append(0)
            stack.append(len(self.name) - 1)
            depth[name] += 1
            if raw:
                found = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
                to = found.start() if found else n
                out.append(("text", page[at:to], stack[-1]))
                at = to
                if not found:
                    break
        while stack:
            pop()

    def _kinds(self) -> None:
        """kind: of the words in each element, None if nothing names them."""
        count = len(self.name)
        words, holds = [0] * count, [False] * count
        for what, value, e in self.tokens:
            if what == "text" and self.own[e] != "code":
                words[e] += len(value.split())
        for e in range(count - 1, 0, -1):
            if self.own[e] != "code":
                words[self.parent[e]] += words[e]
            holds[self.parent[e]] |= holds[e] or self.main[e]
        self.kind: list = [None] * count
        inside = [False] * count
        for e in range(1, count):
            up, own = self.parent[e], self.own[e]
            inside[e] = inside[up] or self.main[up]
            if own not in (None, "code", "comment") and holds[e]:
                own = None
            if own in ("form", "sidebar", "notice", "header") and 2 * words[e] > words[0]:
                own = None
            if own == "header" and inside[e]:
                own = None  # the header of an article is part of it
            outer = self.kind[up]
            self.kind[e] = outer if outer not in (None, "link") else own or outer or ("link" if self.name[e] == "a" else None)

    def features(self) -> list[str]:
        """Of each token: a tag's name; of a text what names its words, else links (a block half of them), link or heading, else the length of its block."""
        out, block, size, linked, heading = [""] * len(self.tokens), [], 0, 0, False

        def seal() -> None:
            plain = "links" if linked and 2 * linked >= size else "heading" if heading else "long" if size >= 12 else "middle" if size >= 5 else "short"
            for i, kind in block:
                out[i] = plain if kind is None or kind == "link" and plain == "links" else kind
            block.clear()

        for i, (what, value, e) in enumerate(self.tokens):
            if what == "text":
                kind = self.kind[e]
                block.append((i, kind))
                n = len(value.split())
                size += n if kind in (None, "link") else 0
                linked += n if kind == "link" else 0
                continue
            out[i] = value
            if value in _BLOCK:
                seal()
                size, linked, heading = 0, 0, value in _HEADINGS and not heading
        seal()
        return out


def train(pages: list[str], clip: float = 4.0) -> tuple[dict, dict]:
    """(word weights by feature, tag weights by name): log-odds of standing in main text; a tag's is at most -0.1."""
    words: dict = {}
    tags: dict = {}
    total = [[0, 0], [0, 0]]
    for text in pages:
        page, inside = Page(text.replace("[[", "<mark-on>").replace("]]", "</mark-on>")), False
        for (what, value, _), feature in zip(page.tokens, page.features()):
            if value == "mark-on":
                inside = not inside
            elif what == "text":
                n = len(value.split())
                words.setdefault(feature, [0, 0])[inside] += n
                total[0][inside] += n
            else:
                tags.setdefault(value, [0, 0])[inside] += 1
                total[1][inside] += 1
    odds = lambda c, base: max(-clip, min(clip, math.log((c[1] + 0.5) / (c[0] + 0.5)) - base))
    return {k: odds(c, 0) for k, c in words.items()}, {k: min(-0.1, odds(c, math.log(total[1][1] / total[1][0]))) for k, c in tags.items()}


WORDS, TAGS = train(LABELLED)
_OTHER_WORD, _OTHER_TAG = -1.0, -0.5


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the highest sum, (0, 0) if none is positive; the first of equals."""
    best, best_at, run, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, best_at = run, (start, i + 1)
    return best_at


def _grown(page: Page, features: list[str], start: int, end: int) -> tuple[int, int]:
    """The region with its article, or with the plain blocks around it that have its edges' parents."""
    texts = [i for i in range(start, end) if page.tokens[i][0] == "text" and page.kind[page.tokens[i][2]] in (None, "link") and page.tokens[i][1].strip()]
    if not texts:
        return start, end
    e = page.tokens[texts[0]][2]
    while e > 0 and not (page.main[e] and page.first[e] <= start and end <= page.end[e] and page.kind[e] is None):
        e = page.parent[e]
    if e > 0:
        return page.first[e], page.end[e]

    def parent(i: int) -> int:
        """The element around the block that a text stands in."""
        x = page.tokens[i][2]
        while x > 0 and page.name[x] not in _BLOCK:
            x = page.parent[x]
        return page.parent[x] if x > 0 else -1

    def further(at: int, step: int, around: int) -> int:
        last, i = at, at + step
        while 0 <= i < len(page.tokens):
            what, value, x = page.tokens[i]
            if what == "text" and value.strip():
                if features[i] == "links" or page.kind[x] not in (None, "link") or parent(i) != around:
                    break
                last = i
            i += step
        return last

    return min(start, further(texts[0], -1, parent(texts[0]))), max(end, further(texts[-1], 1, parent(texts[-1])) + 1)


def extract(page: str | None, words: dict | None = None, tags: dict | None = None) -> str:
    if not page:
        return ""
    words, tags = words or WORDS, tags or TAGS
    found = Page(page)
    features = found.features()
    scores = [
        len(value.split()) * words.get(feature, _OTHER_WORD) if what == "text" else tags.get(value, _OTHER_TAG)
        for (what, value, _), feature in zip(found.tokens, features)
    ]
    start, end = best_region(scores)
    if start == end:
        return ""
    start, end = _grown(found, features, start, end)
    blocks, parts = [], []
    for what, value, e in found.tokens[start:end]:
        if what == "text":
            if found.kind[e] in (None, "link"):
                parts.append(value)
        elif value == "br":
            parts.append(" ")
        elif value in _BLOCK:
            blocks.append(parts)
            parts = []
    blocks.append(parts)
    clean = (" ".join(_html.unescape("".join(b)).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


def extract_pages(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep + text, n_chars (code points)."""
    import pyarrow as pa

    small_batches(pages.sparkSession)
    names = [*keep, "text", "n_chars"]

    def extracted(batches):
        for b in batches:
            texts = [extract(p) for p in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)

    schema = ", ".join([*[f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep], "text string, n_chars long"])
    return pages.select(*[F.col(c) for c in keep], F.col(html).alias("_html")).mapInArrow(extracted, schema)
