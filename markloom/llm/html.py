"""HTML extraction from flat text blocks, classified by a decision tree trained on a small labelled table.

A page is read in one pass over its tags into flat blocks (text between block-level tags). Each block is described
by its word count and link density, those of its neighbours, and what it stands in (navigation, head or foot,
aside, form, list, heading, article; names of classes and ids that tell of adverts, notices, menus, comments). A
decision tree grown here on the blocks of a small labelled table decides which blocks are main text; where tags and
names tell nothing, neighbours decide."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from markloom.llm.common import arrow_pass

# What HTML elements are.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html iframe label legend li main menu nav ol option p pre section select "
    "summary table tbody td textarea tfoot th thead tr ul title head".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED_TAGS = frozenset("script style template title iframe noscript svg".split())  # what stands in them is no text of the page
REST_TAGS = frozenset("script style".split())  # without an end tag these go on to the page's end
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTEXTS = {"nav": "nav", "menu": "nav", "header": "head", "footer": "foot", "aside": "aside", "form": "form", "dialog": "aside", "button": "form",
            "fieldset": "form", "select": "form", "textarea": "form", "label": "form", "article": "main", "main": "main", "li": "list", "dd": "list", "dt": "list"}
NAMED = (
    ("ad", re.compile(r"(?<![a-z])(ads?|adverts?|advert\w*|banner|promo\w*|sponsor\w*|doubleclick)(?![a-z])")),
    ("nav", re.compile(r"(?<![a-z])(nav\w*|menus?|breadcrumbs?|topbar|toolbar|pagination|pager|tags?|skip)(?![a-z])")),
    ("foot", re.compile(r"(?<![a-z])(footer|foot|copyright|legal|credits)(?![a-z])")),
    ("head", re.compile(r"(?<![a-z])(header|masthead|branding|logo)(?![a-z])")),
    ("aside", re.compile(r"(?<![a-z])(sidebar|side|aside|widget\w*|related|recommended|share|sharing|social|newsletter|subscribe\w*|signup|cookies?|consent|notices?|alert|popup|modal|gdpr)(?![a-z])")),
    ("comment", re.compile(r"(?<![a-z])(comments?|commentlist|disqus|respond|replies|reviews?)(?![a-z])")),
    ("form", re.compile(r"(?<![a-z])(form|search|login)(?![a-z])")),
    ("main", re.compile(r"(?<![a-z])(article\w*|main|story|entry|post|content|body)(?![a-z])")),
)
ROLES = {"navigation": "nav", "banner": "head", "contentinfo": "foot", "complementary": "aside", "search": "form", "main": "main",
         "article": "main", "alert": "aside", "dialog": "aside", "form": "form", "menu": "nav"}
COMMENT_TITLE = re.compile(r"(\d+ )?(reader |user )?(comments?|replies|responses|leave a (reply|comment)|join the discussion|kommentare?|commentaires?|comentarios?)( \(?\d+\)?)?:?", re.I)
SIDES_NAMED = frozenset("nav head foot aside form ad comment".split())
CONTEXT_NAMES = ("nav", "head", "foot", "aside", "form", "ad", "comment", "list", "main", "heading")
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", *CONTEXT_NAMES, "outside")

#: A tag whose attributes are well formed; no part gives back what it has taken, so a try ends in linear time.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*+)((?:\s++[^\s"'>/=<]++(?:=(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'>=<`]++))?+)*+)\s*+(/?)>""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
KEY = re.compile(r"[\s/]*([^\s/>=]?[^\s/>=]*)\s*")
PLAIN = re.compile(r"[^\s>]*")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int  # words inside links
    contexts: frozenset[str]
    outside: bool = False  # of the element that the page marks as its main part

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


@lru_cache(maxsize=4096)
def _contexts(tag: str, attributes: str) -> tuple[frozenset[str], frozenset[str]]:
    """What the element's tag and role tell, and what its names of class and id do."""
    found = {CONTEXTS[tag]} if tag in CONTEXTS else set()
    named = set()
    if tag in HEADINGS:
        found.add("heading")
    for m in ATTRIBUTE.finditer(attributes):
        value = html.unescape(next(v for v in m.groups()[1:] if v is not None)).lower()
        if m[1].lower() == "role":
            found |= {ROLES[v] for v in value.split() if v in ROLES}
        elif tag not in ("body", "html", "article", "main"):
            for v in value.replace("_", "-").split():
                named |= {name for name, pattern in NAMED if pattern.search(v)}
    return frozenset(found), frozenset(named)


def decoded(raw: str) -> str:
    """Character references decoded, once each; texts with none but ``&amp;`` take the short way."""
    n = raw.count("&")
    if not n:
        return raw
    return raw.replace("&amp;", "&") if n == raw.count("&amp;") else html.unescape(raw)


def _length(words: list[str], text: str) -> int:
    """Number of words; in scripts without spaces three characters are one."""
    return len(words) if len(text) <= 16 * len(words) else len(text.strip()) // 3


class _Ends:
    """Where something next stands in the page; once it is missing it is not looked for again."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def end_tag(self, tag: str, at: int) -> int:
        """Place after the next end tag of the name, or -1."""
        if tag in self.missing:
            return -1
        m = _end_tag(tag).search(self.page, at)
        if m is None:
            self.missing.add(tag)
            return -1
        return m.end()


@lru_cache(maxsize=16)
def _end_tag(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?:\s[^>]*)?>", re.I)


def _odd_tag(page: str, at: int, ends: _Ends) -> tuple[int, bool, str, str] | None:
    """(place after it, whether it ends, name, attributes) of a tag that is not well formed: an attribute without quotes
    goes on to white space or ``>``, one whose quote is never closed ends at the next ``>``. None: no tag."""
    closing = page.startswith("</", at)
    m = NAME.match(page, at + 1 + closing)
    if m is None:
        return None
    first = i = m.end()
    while i < len(page):
        i = KEY.match(page, i).end()
        c = page[i : i + 1]
        if c == ">":
            return i + 1, closing, m[0].lower(), page[first:i]
        if c == "=":
            i += 1
            while page[i : i + 1].isspace():
                i += 1
            if page[i : i + 1] in ("'", '"') and i < len(page):
                close = ends.find(page[i], i + 1)
                i = close + 1 if close >= 0 else i + 1
            else:
                i = PLAIN.match(page, i).end()
    return len(page), closing, m[0].lower(), page[first:]


class _Outline:
    """Elements that tell something of the text in them, in the order of their start tags; the first is the page."""

    def __init__(self):
        none = frozenset()
        self.parent, self.own, self.named, self.mark, self.holds = [-1], [none], [none], [""], [False]
        self.words, self.blocks, self.plain = [0], [0], [0]  # ``plain``: words outside links

    def add(self, parent: int, own: frozenset[str], named: frozenset[str], mark: str) -> int:
        """``own``: told by tag and role; ``named``: by class and id; ``mark``: the tag of an element for the page's main part,
        or empty."""
        up = parent
        while mark and up >= 0 and not self.holds[up]:
            self.holds[up] = True
            up = self.parent[up]
        self.parent.append(parent)
        self.own.append(own)
        self.named.append(named)
        self.mark.append(mark)
        self.holds.append(False)
        for counts in (self.words, self.blocks, self.plain):
            counts.append(0)
        return len(self.own) - 1

    def forgiven(self, part: list[int]) -> frozenset[str]:
        """What names tell of most of the words outside links, in the page's main part or in a page without one, where hardly
        any other text is left: it says nothing of them."""
        hard, soft = [frozenset()], [frozenset()]
        total = clean = 0
        by_name: Counter[str] = Counter()
        for i in range(len(self.own)):
            if i:
                hard.append(hard[self.parent[i]] | (self.own[i] if not self.holds[i] or self.mark[i] else frozenset()))
                soft.append(soft[self.parent[i]] | (self.named[i] if not self.holds[i] or self.mark[i] else frozenset()))
            if self.plain[i] and (part[i] or not self.holds[0]) and not hard[i] & SIDES_NAMED:
                total += self.plain[i]
                bad = soft[i] & SIDES_NAMED
                clean += 0 if bad else self.plain[i]
                for name in bad:
                    by_name[name] += self.plain[i]
        return frozenset(name for name, n in by_name.items() if 2 * n > total and 4 * clean < n)

    def settle(self) -> tuple[list[frozenset[str]], list[int]]:
        """What holds for the text in each element, and the main part that it stands in (0: none).

        An element around the page's main part says nothing of it; in a page without one, nor does the tag of an element
        around three blocks or more that has most of the page's words, nor do names that would leave hardly any text. An article
        inside another that has more text of its own is a reader's."""
        n = len(self.own)
        part = [0] * n
        for i in range(1, n):
            part[i] = i if self.mark[i] else part[self.parent[i]]
        forgiven = self.forgiven(part)
        for i in range(n - 1, 0, -1):
            self.words[self.parent[i]] += self.words[i]
            self.blocks[self.parent[i]] += self.blocks[i]
        inner = [0] * n  # words of the main parts inside a main part
        for i in range(1, n):
            if self.mark[i]:
                inner[part[self.parent[i]]] += self.words[i]
        told = [frozenset()]
        for i in range(1, n):
            own, outer = self.own[i] | (self.named[i] - forgiven), part[self.parent[i]]
            if self.holds[i] and not self.mark[i]:
                own = own & {"main"}
            elif not self.holds[0] and self.blocks[i] > 2 and 2 * self.words[i] > self.words[0]:
                own = (self.own[i] & {"main", "list", "heading"}) | (self.named[i] - forgiven)
            elif self.mark[i] == self.mark[outer] == "article" and self.words[outer] - inner[outer] > self.words[i]:
                own = own | {"comment"}
            told.append(told[self.parent[i]] | own)
        return told, part


def flat_blocks(page: str) -> list[Block]:
    """The page's text blocks in order. Comments, scripts, styles and the like give no text; character references
    are decoded; white space runs, line breaks too, become one space; blocks without text are left out. Unclosed and
    crossing tags are taken as they come: an end tag closes the nearest open element of its name, if there is one.
    Time and memory grow in proportion to the page."""
    raw: list[tuple[str, int, int, int]] = []  # text, words, linked words, element
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, int]] = []  # open elements and the nearest one of the outline
    opened: Counter[str] = Counter()
    outline, ends = _Outline(), _Ends(page)
    here = at = 0

    def flush() -> None:
        nonlocal parts
        if parts:
            words = "".join([p for p, _ in parts]).split()
            if words:
                text = " ".join(words)
                n = _length(words, text)
                linked = sum(_length(p.split(), p) for p, link in parts if link)
                raw.append((text, n, min(linked, n), here))
                outline.words[here] += n
                outline.plain[here] += max(n - linked, 0)
                outline.blocks[here] += 1
            parts = []

    def close(tag: str) -> None:
        nonlocal here
        while True:
            name, _ = stack.pop()
            opened[name] -= 1
            if name == tag:
                break
        here = stack[-1][1] if stack else 0

    while True:
        start = page.find("<", at)
        if start < 0:
            break
        if start > at:
            parts.append((decoded(page[at:start]), opened["a"] > 0))
        m = TAG.match(page, start)
        if m is not None:
            at, closing, tag, attributes, empty = m.end(), bool(m[1]), m[2].lower(), m[3], bool(m[4])
        elif page.startswith("<!--", start):
            end = ends.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        elif page.startswith(("<!", "<?"), start):
            end = ends.find(">", start)
            at = end + 1 if end >= 0 else len(page)
            continue
        elif (odd := _odd_tag(page, start, ends)) is not None:
            at, closing, tag, attributes = odd
            empty = attributes.endswith("/")
        else:
            parts.append(("<", opened["a"] > 0))
            at = start + 1
            continue
        if closing:
            if tag in BLOCK_TAGS:
                flush()
            if opened[tag] > 0:
                close(tag)
            continue
        if tag == "br":
            parts.append((" ", False))
            continue
        if tag in DROPPED_TAGS:
            if tag in BLOCK_TAGS:
                flush()
            end = ends.end_tag(tag, at)
            if tag == "svg" and end >= 0 and page.find("<svg", at, end) >= 0:
                end = -1  # of another drawing
            at = end if end >= 0 else len(page) if tag in REST_TAGS else at
            continue
        if tag in BLOCK_TAGS:
            flush()
            if opened["p"] > 0 and tag not in ("button", "select", "option", "textarea", "iframe"):
                close("p")  # a paragraph ends where the next block begins
            elif tag == "li" and stack and stack[-1][0] == "li":
                close("li")
        elif tag == "a" and opened["a"] > 0:
            close("a")
        if tag in VOID_TAGS or (empty and tag not in BLOCK_TAGS):
            continue
        own, named = _contexts(tag, attributes)
        if own or named:
            here = outline.add(here, own, named, tag if tag in ("article", "main") else "")
        stack.append((tag, here))
        opened[tag] += 1
    if at < len(page):
        parts.append((decoded(page[at:]), opened["a"] > 0))
    flush()
    told, part = outline.settle()
    blocks = [Block(text, n, linked, told[e], outline.holds[0] and not part[e]) for text, n, linked, e in raw]
    told_of_comments = False
    for b in blocks:  # what follows a title such as "Comments" is by readers, up to the next title
        if "heading" in b.contexts:
            told_of_comments = COMMENT_TITLE.fullmatch(b.text) is not None
        if told_of_comments:
            b.contexts = b.contexts | {"comment"}
    return blocks


def block_features(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), len(FEATURES)), np.float32)
    own = np.array([(b.words, b.density) for b in blocks], np.float32).reshape(-1, 2)
    x[:, 0:2] = own
    x[1:, 2:4] = own[:-1]
    x[:-1, 4:6] = own[1:]
    for i, b in enumerate(blocks):
        for name in b.contexts:
            x[i, _PLACE[name]] = 1
        x[i, -1] = b.outside
    return x


_PLACE = {name: FEATURES.index(name) for name in CONTEXT_NAMES}


@dataclass
class Tree:
    """A node of a binary decision tree: a leaf where ``feature`` is negative."""

    feature: int
    cut: float
    value: float
    low: Tree | None = None
    high: Tree | None = None

    def decide(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value >= 0.5)
        high = x[:, self.feature] > self.cut
        out = np.empty(len(x), bool)
        out[high], out[~high] = self.high.decide(x[high]), self.low.decide(x[~high])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 1) -> Tree:
    """CART with the Gini index; ties go to the first feature and the lower cut."""
    value = float(y.mean())
    leaf = Tree(-1, 0.0, value)
    if depth == 0 or value in (0.0, 1.0):
        return leaf
    best = (1e-9, -1, 0.0)
    whole = value * (1 - value)
    for j in range(x.shape[1]):
        levels = np.unique(x[:, j])
        for cut in (levels[1:] + levels[:-1]) / 2:
            high = x[:, j] > cut
            n = high.sum()
            if min(n, len(y) - n) < least:
                continue
            p, q = y[high].mean(), y[~high].mean()
            gain = whole - (n * p * (1 - p) + (len(y) - n) * q * (1 - q)) / len(y)
            if gain > best[0] + 1e-12:
                best = (gain, j, float(cut))
    if best[1] < 0:
        return leaf
    high = x[:, best[1]] > best[2]
    return Tree(best[1], best[2], value, grow(x[~high], y[~high], depth - 1, least), grow(x[high], y[high], depth - 1, least))


#: Labelled table: page sketches whose blocks are marked main (``+``) or not (``-``). W<n> is a text of n words.
LABELLED = [
    "<nav><ul><li><a>-W1</a></li><li><a>-W1</a></li><li><a>-W2</a></li></ul></nav><div class=ad>-W9</div><article><h1>+W7</h1><p>+W60</p><p>+W1</p><p>+W35</p></article><footer>-W8</footer>",
    "<nav><a>-W1</a><a>-W3</a></nav><div class='ad banner'>-W30</div><article><h1>+W10</h1><p>+W3</p><p>+W120</p><p>+W2</p></article><footer>-W30</footer>",
    "<nav><ul><li><a>-W2</a></li><li>-W1</li></ul></nav><article><h1>+W1</h1><p>+W1</p></article><footer>-W2 <a>W2</a></footer>",
    "<div class=ad>-W3</div><article><p>+W4</p><p>+W14</p><ul><li>+W6</li><li>+W12</li><li>+W1</li></ul></article><div class=ad>-W60</div><footer>-W70</footer>",
    "<header><h1>-W3</h1><p>-W12</p></header><main><h1>+W8</h1><p>+W90</p><h2>+W4</h2><p>+W50</p></main><aside><h2>-W2</h2><p>-W40</p></aside><footer><p>-W20</p></footer>",
    "<div id=header><p>-W6</p></div><div id=menu><ul><li><a>-W1</a></li><li><a>-W2</a></li></ul></div><div id=content><h1>+W6</h1><p>+W70</p><p>+W8</p><ol><li>+W9</li><li>+W15</li></ol></div><div id=footer><p>-W15</p></div>",
    "<div class=cookie-notice>-W25</div><div class=topbar>-W4</div><div class=post><h2>+W5</h2><p>+W44</p><blockquote>+W20</blockquote><p>+W3</p></div><div class=comments><h3>-W2</h3><p>-W30</p><p>-W12</p></div>",
    "<article><h1>+W5</h1><p>+W33</p><div class=share><a>-W1</a><a>-W1</a></div><p>+W48</p><aside>-W18</aside><form><p>-W6</p></form><section class=comments><p>-W55</p></section></article>",
    "<article><h1>+W9</h1><div class=ad>-W15</div><p>+W25</p><nav><a>-W2</a></nav><p>+W2</p><footer>-W5</footer><header>-W4</header></article>",
    "<article><header><h1>+W7</h1><p>-W5</p></header><h2>+<a>W4</a></h2><p>+W60</p><p>+<a>W12</a></p><ul><li>+<a>W5</a></li><li>+<a>W3</a></li><li>+W9</li></ul><p>+W40</p></article>",
    "<header><h1>-W4</h1></header><article><header><h2>+W9</h2><p>-W3 <a>W2</a></p></header><p>+<a>W3</a></p><p>+W30</p><h3>+<a>W6</a></h3><p>+W22</p><ol><li>+<a>W8</a></li><li>+<a>W14</a></li></ol></article><footer>-W9</footer>",
    "<main><h1>+<a>W5</a></h1><p>+<a>W20</a></p><p>+W35</p><ul><li>+<a>W2</a></li></ul><p>+W3 <a>W8</a></p></main><div><a>-W3</a></div><ul><li><a>-W4</a></li></ul>",
    "<main><div class=newsletter>-W22</div><p>+W64</p><div class=related><h3>-W2</h3><ul><li><a>-W7</a></li><li><a>-W6</a></li></ul></div><p>+W5</p></main>",
    "<article><h1>+W1</h1><ul><li>+<a>W3</a></li><li>+<a>W2</a></li><li>+<a>W4</a></li><li>+<a>W1</a></li></ul></article><footer>-W5</footer>",
    "<table><tr><td>+W40</td></tr><tr><td>+W55</td></tr></table><div>-W2 <a>W2</a></div>",
    "<div><a>-W2</a></div><div><a>-W3</a></div><div>-W2</div><div><p>+W80</p><p>+W60</p><p>+W12</p><p>+W75</p></div><div><a>-W4</a></div><div>-W3</div>",
    "<p>-W2</p><h1>+W6</h1><p>+W40</p><p>+W30 <a>W3</a></p><p>+W18</p><p>+W50</p><p>-W1 <a>W2</a></p>",
    "<form><div>-W4</div><div>-W2</div><p>-W30</p></form><div><p>+W45</p><pre>+W30</pre><p>+W22</p></div><dialog>-W16</dialog>",
    "<header><nav><ul><li><a>-W1</a></li></ul></nav></header><article><header>-W9</header><h1>+W11</h1><p>+W1</p><h2>+W2</h2><p>+W16 <a>W9</a></p><figure><figcaption>+W8</figcaption></figure></article>",
]


#: Further rows of the table by rule: each kind of side block, at several lengths, before, between and after main
#: paragraphs of several lengths, in pages with and without an element that marks the article.
SIDES = [
    "<div class=ad>-{}</div>", "<nav>-{} <a>W2</a></nav>", "<nav><ul><li><a>-{}</a></li></ul></nav>", "<header>-{}</header>",
    "<footer>-{}</footer>", "<aside>-{}</aside>", "<div class=sidebar>-{}</div>", "<div class=notice>-{}</div>",
    "<form>-{}</form>", "<section class=comments>-{}</section>", "<div><a>-{}</a></div>", "<ul><li><a>-{}</a></li></ul>",
]
PAGES = [
    "{side}<article><h1>+W6</h1><p>+{main}</p><p>+W{n}</p></article>{side}",
    "{side}<h1>+W6</h1><p>+{main}</p><p>+W{n}</p>{side}",
    "<article><p>+{main}</p>{inside}<p>+W{n}</p></article>",
    "<div><p>+{main}</p>{side}<p>+W{n}</p></div>",
]
#: Pages whose tags and names tell nothing: menus and lists of links, single lines between them, and text. What such a
#: line is shows only in its neighbours.
LINKS = "<div><a>-W{a}</a></div>"
NAMELESS = [
    LINKS * 4 + "<div>-W{b}</div>" + LINKS * 2 + "<div>+W{n}</div><div>+W{b}</div><div>+W{m}</div><div>+W{n}</div>" + LINKS * 3,
    "<div>-W{b}</div>" + LINKS * 3 + "<div>+W{m}</div><div>+W{n}</div><div>+W{m}</div><div>+W{b} <a>W1</a></div><div>+W{n}</div>" + LINKS * 2 + "<div>-W{b}</div>" + LINKS,
    LINKS * 5 + "<p>+W{n}</p><p>+W{m}</p><p>+W{a}</p><p>+W{n}</p>" + LINKS * 4 + "<p>-W{b} <a>W2</a></p>",
    LINKS * 2 + "<div>-W{b}</div>" + LINKS + "<p>+W{m}</p><ul><li>+W{b}</li><li>+W{a}</li><li>+W{b}</li></ul><p>+W{n}</p>" + LINKS * 2,
    LINKS * 3 + "<p>+W{n}</p>" + LINKS * 2 + "<p>+W{m}</p><p>+W{n}</p>" + LINKS + "<div>-W{a}</div>" + LINKS,
    "<article><p>+W{n}</p><p>+W{m}</p></article><div><p>-W{m}</p><p>-W{b}</p></div>",
    "<article><h1>+W{b}</h1><p>+W{n}</p><h3>-Comments</h3><p>-W{m}</p><p>-W{b}</p></article>",
    "<div class='tags promo'><h1>+W{b}</h1><p>+W{n}</p><p>+W{m}</p><p>+W{b}</p><p>+W{n}</p></div>",
    "<div class='ad banner'><article><h1>+W{b}</h1><p>+W{n}</p><p>+W{m}</p></article></div><div class=ad>-W{m}</div>",
    "<article><p>+W{a}</p></article>", "<article><h1>+W{a}</h1><p>+W{b}</p></article>", "<main><p>+W{b}</p><p>+W{m}</p></main>", "<p>+W{n}</p>",
    "<article><p>+W{b}</p><p>+W{a}</p></article><footer>-W{b}</footer>", "<div><p>+W{m}</p><p>+W{b}</p></div>", "<main><article><p>+W{b}</p></article></main>",
    "<article class='promoted banner-story'><h1>+W{b}</h1><p>+W{n}</p><p>+W{a}</p></article><footer>-W{b}</footer>",
]


def _inside(side: str) -> str:
    """A side block that stands in the article: links that nothing else tells of are the article's own."""
    return side.replace("-{}", "+{}") if side in SIDES[-2:] else side


def table() -> list[str]:
    made = [
        page.format(side=side.format(f"W{a}"), inside=_inside(side).format(f"W{a}"), main=f"W{b}", n=n)
        for page in PAGES for side in SIDES for a, b, n in ((2, 30, 12), (9, 150, 40), (45, 16, 70), (20, 60, 1000))
    ]
    nameless = [
        page.format(a=a, b=b, m=m, n=n) for page in NAMELESS
        for a, b, m, n in ((1, 2, 30, 60), (2, 5, 18, 44), (3, 8, 25, 120), (1, 6, 50, 33), (4, 9, 75, 20), (2, 3, 40, 300))
    ]
    return [*LABELLED, *made, *nameless]


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    xs, ys = [], []
    for sketch in table():
        blocks = flat_blocks(re.sub(r"W(\d+)", lambda m: "w " * int(m[1]), sketch))
        xs.append(block_features(blocks))
        ys.append(np.array([b.text[0] == "+" for b in blocks], np.float64))
    return np.concatenate(xs), np.concatenate(ys)


@lru_cache(maxsize=1)
def train() -> Tree:
    return grow(*labelled_blocks())


def main_text(page: str | None, tree: Tree | None = None) -> str:
    """The page's main text: its main blocks joined by two line ends; empty where there is none."""
    blocks = flat_blocks(page) if page else []
    if not blocks:
        return ""
    keep = (tree or train()).decide(block_features(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of ``pages`` (page_id, url, html).

    Null or empty html, and pages without main text, have an empty text. Pages are read whole; repeated rows are
    read each; other columns are not used. Empty table: no rows. A narrow pass without a shuffle."""
    tree = tree or train()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, tree) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return arrow_pass(pages.select("page_id", "url", "html"), apply, f"page_id {kind}, url string, text string, n_chars long")


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
