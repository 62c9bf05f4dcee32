"""HTML extraction by minimum-cut labelling of text blocks.

A page's text falls into blocks at block-level tags.  A logistic classifier
gives each block the cost of either label, which become capacities from the
source (content) and to the sink (boilerplate); neighbours in page order and
blocks with the same parent element are tied by smoothness edges.  The minimum
cut, found by maximum flow, is the cheapest labelling.

The classifier is trained here on generated pages (``TRAINING_PAGES``, fixed
seed) whose blocks are known.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nightglass.llm.textcore import column, tidied

TRAINING_PAGES = 300
#: Longer names go on as attributes, so that a tag is read in its own length.
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]{0,63})")
_SPECIAL = re.compile(r"""['">]""")
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[^\W_]+")

# HTML's block-level, void, unparsed and implicitly closed elements.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe textarea title".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "summary"}
# Words of class and id attributes that tell of content and of the kinds of boilerplate.
GOOD = frozenset("article content main post entry story body text prose articlebody maincontent".split())
BAD = {
    "navigation": frozenset("nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc tabs topbar".split()),
    "frame": frozenset("header footer masthead banner copyright legal bottom colophon".split()),
    "side": frozenset("sidebar aside widget widgets rail related recommended recommendations popular trending tags categories".split()),
    "advert": frozenset("ad ads advert advertisement adverts promo promotion sponsor sponsored sponsors adsense dfp".split()),
    "notice": frozenset("cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup paywall disclaimer".split()),
    "social": frozenset("share sharing social follow byline author bio login search toolbar print".split()),
    "comments": frozenset("comment comments reply replies respond disqus discussion reviews".split()),
}
TAGS = ("nav", "header", "footer", "aside", "form", "article", "main", "li", "table", "button", "select")
FEATURES = ("bias", *(f"in {t}" for t in TAGS), *BAD, "good name", "hidden", "header in article", "footer in article", "all links", "many links", "some links", "heading", "paragraph", "short", "long", "ends a sentence", "has a comma", "sign of rights", "outside article or main")


@dataclass
class TextBlock:
    """A block of text: its element's path and what its ancestors say."""

    text: str
    parent: int
    tag: str
    marks: frozenset[str]
    linked: int = 0


@dataclass
class _Open:
    tag: str
    number: int
    marks: frozenset[str]
    block: int = 0  # where in the stack the nearest block-level element stands


class _Tags:
    """The tags of a page, read one after another in time linear in the page.

    A ``<`` that no tag or comment starts with, or whose tag never ends, is
    text.  An opening quote from which a tag was found never to end is
    remembered, so that it is followed once.
    """

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.special = [m.start() for m in _SPECIAL.finditer(page)]
        self.dead: set[int] = set()
        self.endless: set[str] = set()

    def _end(self, at: int) -> int:
        """Behind the ``>`` of a tag whose attributes begin at ``at``; -1 if there is none."""
        page, special, walked = self.page, self.special, []
        k = bisect_left(special, at)
        while k < len(special):
            at = special[k]
            if page[at] == ">":
                return at + 1
            if at in self.dead:
                break
            walked.append(at)
            close = page.find(page[at], at + 1)
            if close < 0:
                break
            k = bisect_left(special, close + 1, k)
        self.dead.update(walked)
        return -1

    def next(self, at: int) -> tuple[int, int, str, int] | None:
        """(start, end, name, where the name ends) of the first tag from ``at`` on; the name of a comment or declaration is empty."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if at >= self.last and (at := page.find("<!--", at)) < 0:
                break
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(page), "", at
            if page[at + 1] in "!?":
                return at, page.find(">", at) + 1, "", at
            if (m := _NAME.match(page, at)) and (end := self._end(m.end())) >= 0:
                return at, end, m[1].lower(), m.end()
            at += 1
        return None

    def behind(self, name: str, at: int) -> int:
        """Behind the first end tag of ``name`` from ``at`` on; -1 if there is none."""
        if name in self.endless:
            return -1
        end = re.compile(rf"</{name}\s*>", re.I).search(self.page, at)
        if not end:
            self.endless.add(name)
        return end.end() if end else -1


@dataclass
class _Builder:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    marks: frozenset[str] = frozenset()
    parent: int = 0
    tag: str = ""


def _marks(tag: str, attrs: str, above: frozenset[str]) -> frozenset[str]:
    out = set(above)
    if tag in TAGS:
        out.add(f"in {tag}")
    if tag in ("header", "footer") and ("in article" in above or "in main" in above):
        out.add(f"{tag} in article")
        if f"in {tag}" not in above:
            out.discard(f"in {tag}")
    if tag in ("article", "main"):
        # what stands above, such as a class of the page's body, says little about an article
        out -= {"in header", "in footer", *BAD}
    for name, value in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role", "itemprop") and tag not in ("body", "html"):
            words = set(_WORD.findall(value)) | set(re.findall(r"[a-z]+", value))
            out |= {kind for kind, names in BAD.items() if words & names}
            if words & GOOD:
                out.add("good name")
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            out.add("hidden")
    return frozenset(out)


def blocks_of(page: str) -> list[TextBlock]:
    """The page's text blocks in order, white space collapsed, references decoded, scripts and the like left out."""
    stack = [_Open("", 0, frozenset())]
    where: dict[str, list[int]] = {}  # of each open tag, where in the stack it stands
    out: list[TextBlock] = []
    now, tags = _Builder(), _Tags(page)
    number, at = 0, 0

    def close_block() -> None:
        nonlocal now
        text = " ".join(html.unescape("".join(now.parts)).split())
        if text:
            out.append(TextBlock(text, now.parent, now.tag, now.marks, min(now.linked, len(text))))
        now = _Builder()

    def add(text: str) -> None:
        if text and (now.parts or not text.isspace()):
            if not now.parts:
                k = stack[-1].block
                now.parent, now.tag, now.marks = stack[max(0, k - 1)].number, stack[k].tag, stack[-1].marks
            now.parts.append(text)
            if where.get("a"):
                now.linked += len(text.strip())

    def leave(upto: int) -> None:
        for o in stack[upto:]:
            where[o.tag].pop()
        del stack[upto:]

    def drawn_end(raw: str, at: int) -> int:
        """Where an svg or template ends that is open at ``at``: at its end tag, or else where an element around it ends, or the page."""
        inner: list[str] = []
        held: Counter[str] = Counter()
        while t := tags.next(at):
            start, at, name, _ = t
            if not name:
                continue
            if page[start + 1] != "/":
                if name in RAW and name not in ("svg", "template"):
                    at = max(at, tags.behind(name, at))
                elif name not in VOID and page[at - 2] != "/":
                    inner.append(name)
                    held[name] += 1
            elif held[name]:
                while True:
                    held[last := inner.pop()] -= 1
                    if last == name:
                        break
            elif name == raw:
                return at
            elif where.get(name):
                return start
        return len(page)

    while t := tags.next(at):
        start, end, tag, named = t
        add(page[at:start])
        at = end
        if not tag:
            continue
        if page[start + 1] == "/":
            if tag in BLOCK:
                close_block()
            if where.get(tag):
                leave(where[tag][-1])
            continue
        if tag == "head":
            continue
        empty = page[end - 2] == "/"
        if tag in RAW:
            if tag in ("svg", "template"):
                at = end if empty else drawn_end(tag, end)
            else:
                behind = tags.behind(tag, end)
                at = behind if behind >= 0 else len(page)
            if tag in ("textarea", "title", "iframe", "svg"):
                add(" ")
            continue
        if tag in BLOCK:
            close_block()
            k = stack[-1].block
            if k and (stack[k].tag in CLOSES.get(tag, ()) or stack[k].tag == "p" and tag in ENDS_P):
                # <tr> also ends the row above an open cell
                while tag == "tr" and k > 1 and stack[k - 1].tag == "tr":
                    k -= 1
                leave(k)
        elif tag == "br":
            add(" ")
        elif tag == "a" and where.get("a"):
            leave(where["a"][-1])
        if tag not in VOID and not empty:
            number += 1
            where.setdefault(tag, []).append(len(stack))
            stack.append(_Open(tag, number, _marks(tag, page[named : end - 1], stack[-1].marks), len(stack) if tag in BLOCK else stack[-1].block))
    rest = page[at:]
    cut = rest.rfind("<")
    add(rest[:cut] if cut >= 0 and re.match(r"<[!/?a-zA-Z]", rest[cut:]) else rest)  # a tag broken off at the end is no text
    close_block()
    return out


def features(blocks: list[TextBlock]) -> np.ndarray:
    """A row of 0 or 1 for each block."""
    out = np.zeros((len(blocks), len(FEATURES)))
    named = {f: i for i, f in enumerate(FEATURES)}
    framed = any("in article" in b.marks or "in main" in b.marks for b in blocks)
    for k, b in enumerate(blocks):
        share, n = b.linked / len(b.text), len(b.text.split())
        on = {
            "bias": True, "all links": share > 0.9, "many links": 0.4 < share <= 0.9, "some links": 0.1 < share <= 0.4, "heading": b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), "paragraph": b.tag in ("p", "blockquote", "pre"),
            "short": n < 8, "long": n > 25, "ends a sentence": b.text[-1] in ".!?\"»”…", "has a comma": "," in b.text, "sign of rights": "©" in b.text, "outside article or main": framed and not {"in article", "in main"} & b.marks,
        }
        for f in (*b.marks, *(f for f, v in on.items() if v)):
            if f in named:
                out[k, named[f]] = 1
    return out


def min_cut(content: np.ndarray, boilerplate: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """The cheapest labelling: True where content.

    ``content`` is each block's cost as content, ``boilerplate`` as
    boilerplate; an edge costs its weight if its ends differ.  Ties go to
    content.  Maximum flow by rounds of blocking flows along shortest paths,
    after each block's own source-sink path is filled.
    """
    n = len(content)
    both = np.minimum(content, boilerplate)
    source, sink = (boilerplate - both).tolist(), (content - both).tolist()
    near: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for a, b, w in edges:
        near[a].append(len(to))
        to.append(b)
        room.append(w)
        near[b].append(len(to))
        to.append(a)
        room.append(w)
    tiny = 1e-12
    while True:
        # distances from the blocks with flow left to send
        level = [-1] * n
        queue = deque(starts := [i for i in range(n) if source[i] > tiny and near[i]])
        for i in starts:
            level[i] = 0
        reached = False
        while queue:
            i = queue.popleft()
            reached = reached or sink[i] > tiny
            for e in near[i]:
                if level[to[e]] < 0 and room[e] > tiny:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not reached:
            break
        # a blocking flow along growing distances; each edge is given up once a round
        tried = [0] * n
        for s in starts:
            path: list[int] = []
            i = s
            while source[s] > tiny:
                if sink[i] > tiny:
                    flow = min(source[s], sink[i], *(room[e] for e in path))
                    source[s] -= flow
                    sink[i] -= flow
                    full = None
                    for k, e in enumerate(path):
                        room[e] -= flow
                        room[e ^ 1] += flow
                        if full is None and room[e] <= tiny:
                            full = k
                    if full is not None:  # back to before the first full edge
                        i = to[path[full] ^ 1]
                        del path[full:]
                    continue
                while tried[i] < len(near[i]):
                    e = near[i][tried[i]]
                    if room[e] > tiny and level[to[e]] == level[i] + 1:
                        break
                    tried[i] += 1
                if tried[i] < len(near[i]):
                    path.append(e)
                    i = to[e]
                elif path:
                    i = to[path.pop() ^ 1]
                    tried[i] += 1
                else:
                    break
    # boilerplate is what can still reach the sink
    out = [True] * n
    queue = deque(i for i in range(n) if sink[i] > tiny)
    for i in queue:
        out[i] = False
    while queue:
        i = queue.popleft()
        for e in near[i]:
            j = to[e]
            if room[e ^ 1] > tiny and out[j]:
                out[j] = False
                queue.append(j)
    return np.array(out, bool)


ADJACENT, SIBLING = 0.3, 0.6


def smoothness(blocks: list[TextBlock]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in page order, and between successive blocks of one parent; none where the ancestors' marks differ."""
    edges, last = [], {}
    for k, b in enumerate(blocks):
        if k and blocks[k - 1].marks == b.marks:
            edges.append((k - 1, k, ADJACENT))
        if (j := last.get(b.parent)) is not None and blocks[j].marks == b.marks:
            edges.append((j, k, SIBLING))
        last[b.parent] = k
    return edges


def training_page(r: random.Random) -> tuple[str, set[str]]:
    """A generated page and the texts of its content blocks."""
    syllables = "the of and in er an re on at en nd ti es or te ed is it al ar st to nt ng se ha as ou io le".split()
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    words = lambda lo, hi: " ".join(word() for _ in range(r.randint(lo, hi)))
    sentence = lambda: words(2, 14).capitalize() + r.choice(("", f", {words(2, 9)}")) + r.choice("...!?")
    prose = lambda: " ".join(sentence() for _ in range(r.randint(1, 7)))
    link = lambda: f'<a href="/{word()}">{words(1, 4)}</a>'
    content: set[str] = set()

    def keep(text: str, tag: str, wrap: str = "") -> str:
        content.add(re.sub(r"<[^>]*>", "", text))
        return f"<{tag}>{f'<{wrap}>' if wrap else ''}{text}{f'</{wrap}>' if wrap and r.random() < 0.5 else ''}{f'</{tag}>' if r.random() < 0.8 or tag != 'p' else ''}"

    def attr(kind: str) -> str:
        if r.random() < 0.25:
            return ""
        return f' {r.choice(("class", "id"))}="{r.choice(sorted(BAD[kind]))}{r.choice(("", "-box", " " + word(), "-" + str(r.randint(1, 9))))}"'

    def named(kind: str) -> str:
        a = attr(kind)
        return a or f' class="{r.choice(sorted(BAD[kind]))}"'

    menu = lambda: f"<nav{attr('navigation')}><ul>{''.join(f'<li>{link()}</li>' for _ in range(r.randint(3, 9)))}</ul></nav>" if r.random() < 0.7 else f"<div{named('navigation')}>{' | '.join(link() for _ in range(r.randint(3, 8)))}</div>"
    extras = [
        lambda: f"<div{named('advert')}>{sentence()}</div>", lambda: f"<aside{attr('side')}><h3>{words(1, 4)}</h3><p>{prose()}</p></aside>", lambda: f"<div{named('notice')}><p>{sentence()}</p><button>{words(1, 2)}</button></div>",
        lambda: f"<div{named(r.choice(('side', 'navigation', 'social')))}><ul>{''.join(f'<li>{r.choice((link, lambda: words(1, 5)))()}</li>' for _ in range(r.randint(2, 6)))}</ul></div>", lambda: f"<form><label>{words(1, 3)}</label><input><button>{words(1, 2)}</button></form>", lambda: f"<div{named('social')}>{link()} {link()}</div>",
        lambda: f"<div{r.choice((' hidden', ' style=\"display: none\"', ' aria-hidden=\"true\"'))}><p>{prose()}</p></div>", lambda: f"<section{named('comments')}><h3>{words(1, 3)}</h3>" + "".join(f"<div><b>{word()}</b><p>{prose()}</p></div>" for _ in range(r.randint(1, 4))) + "</section>",
    ]
    body = [keep(words(2, 9).capitalize(), r.choice(("h1", "h1", "h2")))]
    for _ in range(r.randint(1, 10)):
        x = r.random()
        if x < 0.7:
            body.append(keep(prose(), "p", r.choice(("", "", "", "b"))))
        elif x < 0.8:
            body.append(keep(words(1, 6).capitalize(), r.choice(("h2", "h3"))))
        elif x < 0.87:
            body.append("<ul>" + "".join(keep(r.choice((sentence, lambda: words(1, 6)))(), "li") for _ in range(r.randint(2, 6))) + "</ul>")
        elif x < 0.91:
            body.append(keep(prose(), "blockquote"))
        elif x < 0.95:
            body.append("<table>" + "".join("<tr>" + "".join(keep(words(1, 3), "td") for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
        else:
            body.append(keep(f"{sentence()} {link()} {sentence()}", "p"))
        if r.random() < 0.12:
            body.append(r.choice(extras)())
    shell = r.choice(("article", "article", "main", "div", "named"))
    inner = "".join(body)
    if shell == "named":
        inner = f'<div class="{r.choice(sorted(GOOD))}">{inner}</div>'
    else:
        inner = f"<{shell}>{inner}</{shell}>"
    top = r.choice(("h1", "h2", "p", "div"))
    before = "".join(r.sample([menu(), f"<div{named('frame')}><{top}>{words(1, 5)}</{top}>{r.choice((link(), menu()))}</div>", *(f() for f in r.sample(extras, 3)), f"<header{attr('frame')}><p>{words(1, 6)}</p>{link()}</header>"], r.randint(1, 4)))
    after = "".join(r.sample([*(f() for f in r.sample(extras, 4)), menu()], r.randint(0, 4)))
    foot = r.choice((f"<footer{attr('frame')}>&copy; {words(1, 4)} &middot; {sentence()}</footer>", f"<div{named('frame')}>&copy; {words(1, 6)} {link()}</div>", f"<footer><p>{sentence()}</p></footer>"))
    return f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title><script>var t='<p>';</script></head><body>{before}{inner}{after}{foot}</body></html>", content


@lru_cache(maxsize=2)
def train(pages: int = TRAINING_PAGES, seed: int = 11) -> np.ndarray:
    """Weights of the logistic classifier, the same whenever and wherever they are trained."""
    r, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        page, content = training_page(r)
        found = blocks_of(page)
        xs.append(features(found))
        ys += [b.text in content for b in found]
    x, y, w = np.vstack(xs), np.array(ys, float), np.zeros(len(FEATURES))
    for _ in range(25):  # Newton's method
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 0.5 * w)
    return w


def extract(page: str, weights: np.ndarray) -> str:
    """The page's main text: its content blocks in order, an empty line between them."""
    found = blocks_of(page)
    if not found:
        return ""
    z = features(found) @ weights
    label = min_cut(np.logaddexp(0, -z), np.logaddexp(0, z), smoothness(found))
    return "\n\n".join(b.text for b, keep in zip(found, label) if keep)


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), weights: np.ndarray | None = None) -> DataFrame:
    """Extract every page's main text from its whole html, without a shuffle.

    Returns the ``keep`` columns, text and n_chars (code points).  Null and
    empty pages, and pages without content, give an empty text.  Broken markup
    is read as far as it goes.  Repeated rows each give a row, nulls in the
    kept columns stay, other columns are not read, an empty table gives none.
    """
    w = train() if weights is None else weights
    kinds = dict(pages.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string, n_chars long"

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(t.as_py() or "", w) for t in column(batch, html_col)]
            yield pa.RecordBatch.from_pydict({c: column(batch, c) for c in keep} | {"text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})

    return pages.select(*dict.fromkeys([*keep, html_col])).mapInArrow(run, schema)
