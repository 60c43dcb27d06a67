"""Main text of pages: flat text blocks classified by a decision tree over shallow features of a block and its neighbours.

The html is cut into flat blocks at block-level tags. What is known of a block is how many words it has and which share
of them is in links, the same of the block before and the one after, and the same of its group, the blocks directly in
the same container (div, section, table cell and the like), with the group's share of the page and where in the page
the block stands. Minor features are tags: heading, the container of the title, an article or main element, an element
for navigation and the like; and whether an element around it bears a name made of nothing but words for adverts,
menus, notices, comments (``TELLING``). A decision tree, grown here by Gini impurity on a labelled table of blocks,
decides which are main text: its upper ``SHALLOW_DEPTH`` levels ask for words and link densities of the block and its
two neighbours only, what these leave undecided is split by all features. The blocks found are joined by a newline in
page order.

The labelled table is made by ``labelled_pages``: bounded (``TRAINING_PAGES`` pages), fixed by its seed, and independent
of the data. Half of its pages bear no names, half no tags with a meaning, so that words, link densities and neighbours
have to tell the blocks apart. The tree is grown once per session on the driver and has some hundred nodes.

Defined cases: null or empty html gives an empty text; plain text without tags is one block; unclosed and stray tags
close with their container; scripts, styles, comments and the head are markup, and without an end they go on to the
page's, as in browsers; an element that isn't shown and has no end of its own closes with its container or before the
next block; a tag without an end is text; nothing is cut or capped; repeated rows get equal results; other columns stay,
except those named like the output columns. Time is in proportion to a page's length.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helicase.llm import _common as c
from helicase.llm import _windows as win

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Containers: the blocks directly inside are a group.
GROUPS = frozenset("article aside body center dialog div fieldset figure footer form header html main menu nav section td".split())
#: What they hold is no markup.
RAW = frozenset("script style textarea title".split())
INVISIBLE = frozenset("noscript template svg math iframe object canvas select datalist optgroup option button".split())
NESTING = frozenset("template svg math object".split())
BOILER_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
#: Names of elements beside the main text, and words that go with them; a name counts if it has nothing else.
TELLING = frozenset(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo menu nav navbar navigation sidebar footer breadcrumb breadcrumbs pagination pager "
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login search comment comments respond reply replies disqus discussion "
    "share sharing social related recommended widget toolbar copyright legal toc contentinfo complementary masthead".split()
)
BESIDE = frozenset("area bar block body bottom box col column container content form global header inner item items layout left links list main meta page post posts primary right section site text top wrap wrapper".split())
#: Names that say how a page is laid out: with them, a telling name is no verdict on an article inside.
LAYOUT = frozenset("content main primary page post hentry entry article layout wrap wrapper container inner with without no has enabled disabled open closed".split())
TALK = frozenset("comment comments respond reply replies disqus discussion".split())
ATTRS = r"""(?>[^>=]++|=\s*+(?>"[^"]*+"|'[^']*+'|[^\s>]*+))*+"""
TAG = re.compile(rf"<(?P<close>/)?+(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>{ATTRS})>")
COMMENT_END = re.compile(r"--!?>")
NO_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<(script|style|textarea|title)\b[^>]*>.*?(?:</\1\s*>|$)", re.S | re.I)
NAMED = re.compile(r"""(?<![\w-])(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?<![\w-])hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
SPACE = re.compile(r"\s+")
PART = re.compile(r"[^a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "group_words", "group_link_density", "group_share",
    "words_left", "heading", "at_title", "with_title", "in_content", "page_has_content", "in_boiler", "named",
)

#: So many features, the first ones, are those of the block and its neighbours; so many levels of the tree ask for them.
SHALLOW, SHALLOW_DEPTH = 6, 4


def tells(name: str) -> bool:
    """Whether an element's name says that it is beside the main text: one of its words does, and no other says else."""
    parts = [x for x in PART.split(CAMEL.sub("-", name).lower()) if x]
    return any(x in TELLING for x in parts) and all(x in TELLING or x in BESIDE for x in parts)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    heading: bool
    title: bool
    content: bool
    boiler: bool
    named: bool
    group: int


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    #: Of each group, the one around it.
    outer: list[int] = field(default_factory=list)


@dataclass(frozen=True)
class Open:
    """An open element and what holds inside of it. name: the innermost telling name, as a node of ``_Names``."""

    tag: str = ""
    content: bool = False
    boiler: bool = False
    hidden: bool = False
    name: int = 0
    around: int = 0  # the innermost name around the content
    group: int = 0


class _Names:
    """The telling names of a page as a tree: node 0 is none, others have the node around them. An article or main
    element is a node too: names of layout around it don't count inside."""

    NAME, LAYS_OUT, CONTENT = range(3)

    def __init__(self) -> None:
        self.outer, self.kind = [0], [self.CONTENT]

    def add(self, outer: int, kind: int) -> int:
        self.outer.append(outer)
        self.kind.append(kind)
        return len(self.outer) - 1

    def wrappers(self, page: list[Block], of: list[int], around: list[int]) -> list[bool]:
        """Of each node, whether it is a name on an element that lays out the page: it is around the article that has
        the title or half of the words in articles; on a page without articles, around half of all words and a title,
        unless the name says layout. of: each block's node; around: the node at the content that the block is in."""
        content = sum(b.words for b in page if b.content)
        titled = next((i for i, b in enumerate(page) if b.title and (b.content or not content)), None)
        held = around if content else of
        n = len(self.outer)
        every, near = [0] * n, [0] * n  # words inside, and those of them with no article between
        for b, k in zip(page, held, strict=True):
            if b.content or not content:
                every[k] += b.words
                near[k] += b.words
        for k in range(n - 1, 0, -1):
            every[self.outer[k]] += every[k]
            near[self.outer[k]] += 0 if self.kind[k] == self.CONTENT else near[k]
        with_title, k, passed = [False] * n, held[titled] if titled is not None else 0, False
        while k:
            with_title[k] = self.kind[k] == self.NAME or not passed
            passed |= self.kind[k] == self.CONTENT
            k = self.outer[k]
        total = content or sum(b.words for b in page)
        out = []
        for k, kind in enumerate(self.kind):
            most = 2 * (every[k] if kind == self.NAME else near[k]) >= total
            out.append((most or with_title[k]) if content else most and (with_title[k] or kind == self.LAYS_OUT))
        return out

    def counting(self, wrapper: list[bool]) -> list[bool]:
        """Of each node, whether it or one around it is a name that counts."""
        name, lays_out = [False], [False]
        for k in range(1, len(self.outer)):
            up, kind = self.outer[k], self.kind[k]
            name.append(name[up] or kind == self.NAME and not wrapper[k])
            lays_out.append(kind != self.CONTENT and (lays_out[up] or kind == self.LAYS_OUT and not wrapper[k]))
        return [x or y for x, y in zip(name, lays_out, strict=True)]


def _ended(html: str, name: str) -> set[int]:
    """Ends of name's opening tags that have a closing tag of their own."""
    out, open_ = set(), []
    for m in re.finditer(rf"<(/?+){name}(?![\w:-]){ATTRS}>", html, re.I):
        if m.group(1):
            if open_:
                out.add(open_.pop())
        else:
            if name not in NESTING:
                open_.clear()
            open_.append(m.end())
    return out


class _Parser:
    """One pass over a page; see ``blocks``."""

    def __init__(self, html: str) -> None:
        self.html, self.page = html, Page(outer=[0])
        self.stack: list[Open] = []
        self.count: Counter[str] = Counter()  # of open elements, by tag
        self.bare = Open()
        self.parts: list[str] = []
        self.linked = self.links = 0
        self.heading = self.title = False
        self.tree = _Names()
        self.names: list[int] = []
        self.around: list[int] = []
        self.ends: dict[str, set[int]] = {}
        self.unended: set[str] = set()
        self.unseen: list[tuple[int, str, bool]] = []  # open elements that aren't shown: open blocks around them, tag, has an end
        self.markup: str | None = None

    def top(self) -> Open:
        return self.stack[-1] if self.stack else self.bare

    def push(self, e: Open) -> None:
        self.stack.append(e)
        self.count[e.tag] += 1

    def cut(self, depth: int) -> None:
        for e in self.stack[depth:]:
            self.count[e.tag] -= 1
        del self.stack[depth:]

    def depth_of(self, tag: str) -> int | None:
        """Of the innermost open element with the tag."""
        return next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].tag == tag) if self.count[tag] else None

    def flush(self) -> None:
        text = SPACE.sub(" ", entities.unescape("".join(self.parts))).strip()
        if text:
            e = self.top()
            self.page.blocks.append(Block(text, len(text.split(" ")), self.linked, self.heading, self.title, e.content, e.boiler, e.hidden, e.group))
            self.names.append(e.name)
            self.around.append(e.around)
        self.parts, self.linked = [], 0

    def say(self, text: str) -> None:
        if not self.unseen:
            self.parts.append(text)
            if self.links:
                self.linked += len(text.split())

    def run(self) -> Page:
        html, at, end = self.html, 0, len(self.html)
        while at < end:
            i = html.find("<", at)
            if i < 0:
                break
            nxt = html[i + 1 : i + 2]
            if nxt in ("!", "?"):
                self.say(html[at:i])
                at = self.declaration(i)
                continue
            m = TAG.match(html, i) if nxt == "/" or nxt.isascii() and nxt.isalpha() else None
            if m is None:
                if nxt.isascii() and nxt.isalpha():
                    break  # a tag without an end: all that follows is text
                self.say(html[at : i + 1])
                at = i + 1
                continue
            self.say(html[at:i])
            at = self.tag(m)
        self.say(html[at:])
        if self.unseen:
            self.cut(self.unseen[0][0])
        self.flush()
        counts = self.tree.counting(self.tree.wrappers(self.page.blocks, self.names, self.around))
        for b, k in zip(self.page.blocks, self.names, strict=True):
            b.named = b.named or counts[k]
        return self.page

    def declaration(self, i: int) -> int:
        """Where a comment, a CDATA section or the like that begins at i ends."""
        html = self.html
        if html.startswith("<!--", i):
            if html.startswith((">", "->"), i + 4):
                return html.index(">", i + 4) + 1
            m = COMMENT_END.search(html, i + 4)
            return m.end() if m else len(html)
        if html.startswith("<![CDATA[", i):
            stop = html.find("]]>", i + 9)
            self.say(html[i + 9 : stop if stop >= 0 else len(html)])
            return stop + 3 if stop >= 0 else len(html)
        stop = html.find(">", i)
        return stop + 1 if stop >= 0 else len(html)

    def tag(self, m: re.Match) -> int:
        """Takes a tag; where to go on."""
        at, name, closing, attrs = m.end(), m.group("name").lower(), bool(m.group("close")), m.group("attrs")
        if name in RAW or name == "head":
            if not closing and not attrs.endswith("/"):
                stop = None if name in self.unended else re.compile(rf"</{name}\s*>", re.I).search(self.html, at)
                if stop:
                    at = stop.end()
                else:
                    self.unended.add(name)
                    if name != "head":
                        at = len(self.html)
            self.say(" ")
            return at
        if name in INVISIBLE:
            self.invisible(name, closing, attrs, at)
            return at
        if name == "a" and not self.unseen:
            self.links = max(0, self.links - 1) if closing else 1
        if name == "br":
            self.say(" ")
        if name in BLOCKS and self.shown(name, closing):
            self.block(name, closing, attrs)
        return at

    def invisible(self, name: str, closing: bool, attrs: str, at: int) -> None:
        self.say(" ")
        if closing:
            i = next((i for i in range(len(self.unseen) - 1, -1, -1) if self.unseen[i][1] == name), None)
            if i is not None:
                self.cut(self.unseen[i][0])
                del self.unseen[i:]
        elif not attrs.endswith("/"):
            if name in ("option", "optgroup") and self.unseen and self.unseen[-1][1] == "option":
                self.cut(self.unseen.pop()[0])
            if name not in self.ends:
                if self.markup is None:
                    self.markup = NO_MARKUP.sub(lambda m: " " * len(m.group()), self.html)
                self.ends[name] = _ended(self.markup, name)
            self.unseen.append((len(self.stack), name, at in self.ends[name]))

    def shown(self, name: str, closing: bool) -> bool:
        """Whether a block-level tag is to be taken, after closing what isn't shown and ends here."""
        while self.unseen and not self.unseen[-1][2]:
            self.unseen.pop()
        if not self.unseen:
            return True
        if not closing:
            if name != "hr":
                e = self.top()
                self.push(Open(name, e.content, e.boiler, e.hidden, e.name, e.around, e.group))
            return False
        depth = self.depth_of(name)
        if depth is None:
            return False
        while self.unseen and self.unseen[-1][0] > depth:  # they close with their container
            self.cut(self.unseen.pop()[0])
        if self.unseen:
            self.cut(depth)
            return False
        return True

    def block(self, name: str, closing: bool, attrs: str) -> None:
        self.flush()
        if name == "hr":
            return
        self.links = 0
        self.heading = not closing and len(name) == 2 and name[0] == "h"
        self.title = not closing and name == "h1"
        if closing:
            depth = self.depth_of(name)
            if depth is not None:
                self.cut(depth)
            return
        top = self.top().tag
        if name in ("p", "li", "dt", "dd", "tr", "td", "th") and top == name or name in BLOCKS - {"p"} and top == "p":
            self.cut(len(self.stack) - 1)
        e = self.top()
        content, boiler, node, group = e.content, e.boiler, e.name, e.group
        named = [y for x in NAMED.findall(attrs) for y in "".join(x).split()] if attrs else []
        parts = {y for x in named for y in PART.split(CAMEL.sub("-", x).lower())}
        lays_out = bool(parts & LAYOUT) and not parts & TALK
        if name in CONTENT_TAGS and node:
            node = self.tree.add(node, _Names.CONTENT)
        if name not in ("body", "html") and not (lays_out and name in CONTENT_TAGS) and any(map(tells, named)):
            node = self.tree.add(node, _Names.LAYS_OUT if lays_out else _Names.NAME)
        if name in GROUPS and name not in ("html", "body"):
            group = len(self.page.outer)
            self.page.outer.append(e.group)
        self.push(
            Open(
                name, content or name in CONTENT_TAGS, boiler or name in BOILER_TAGS and not (content and name == "header"),  # an article's own header
                e.hidden or bool(attrs and HIDDEN.search(attrs)), node, node if name in CONTENT_TAGS else e.around, group,
            )
        )


def parsed(html: str) -> Page:
    """Visible text blocks of a page, in order, and its groups."""
    return _Parser(html).run()


def blocks(html: str) -> list[Block]:
    return parsed(html).blocks


def features(page: Page) -> np.ndarray:
    """A row of FEATURES for each block."""
    found = page.blocks
    n = len(found)
    words = np.array([b.words for b in found], float)
    linked = np.array([b.linked for b in found], float)
    group = np.array([b.group for b in found], np.int64)
    density = linked / words
    of_group = np.bincount(group, words, len(page.outer))
    group_density = np.bincount(group, linked, len(page.outer)) / np.maximum(of_group, 1)
    # the title is the first h1 outside of navigation and the like, or else the first one
    titles = [b for b in found if b.title]
    title = next((b for b in titles if not b.boiler and not b.named), titles[0] if titles else None)
    inside = np.zeros(len(page.outer), bool)  # groups in the title's; outer groups come first
    if title is not None:
        inside[title.group] = True
        for g, out in enumerate(page.outer):
            inside[g] |= g > 0 and inside[out]
    shift = lambda x, k: np.concatenate([[0.0], x[:-1]]) if k < 0 else np.concatenate([x[1:], [0.0]])
    left = np.cumsum(words[::-1])[::-1] - words
    has = np.full(n, float(any(b.content for b in found)))
    flag = lambda of: np.array([of(b) for b in found], float)
    return np.column_stack([
        words, density, shift(words, -1), shift(density, -1), shift(words, 1), shift(density, 1), of_group[group], group_density[group], of_group[group] / words.sum(),
        left, flag(lambda b: b.heading), flag(lambda b: b is title), inside[group].astype(float), flag(lambda b: b.content), has, flag(lambda b: b.boiler), flag(lambda b: b.named),
    ])


class Tree:
    """A binary decision tree: nodes (feature, threshold, left, right) or leaves (verdict)."""

    def __init__(self, depth: int = SHALLOW_DEPTH + 7, least: int = 5) -> None:
        self.depth, self.least, self.nodes = depth, least, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self._grow(x, y.astype(bool), 0)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        split = None
        if depth < self.depth and 0 < y.sum() < len(y):
            split = (self._split(x[:, :SHALLOW], y) if depth < SHALLOW_DEPTH else None) or self._split(x, y)
        if split is None:
            self.nodes[at] = bool(2 * y.sum() >= len(y))
        else:
            f, t = split
            left = x[:, f] <= t
            self.nodes[at] = (f, t, self._grow(x[left], y[left], depth + 1), self._grow(x[~left], y[~left], depth + 1))
        return at

    def _split(self, x: np.ndarray, y: np.ndarray) -> tuple[int, float] | None:
        best, found = 2 * y.mean() * (1 - y.mean()) - 1e-9, None
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, hits = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            ok = (v[1:] > v[:-1]) & (n >= self.least) & (len(y) - n >= self.least)
            if ok.any():
                p, q = hits[:-1] / n, (hits[-1] - hits[:-1]) / (len(y) - n)
                gini = np.where(ok, (n * p * (1 - p) + (len(y) - n) * q * (1 - q)) * 2 / len(y), 1.0)
                k = int(np.argmin(gini))
                if gini[k] < best:
                    best, found = gini[k], (f, float(v[k] + v[k + 1]) / 2)
        return found

    def told(self, node: int = 0, indent: str = "") -> str:
        """The tree as text."""
        what = self.nodes[node]
        if isinstance(what, bool):
            return f"{indent}{'main text' if what else 'beside'}\n"
        f, t, left, right = what
        return f"{indent}{FEATURES[f]} <= {t:g}\n{self.told(left, indent + '  ')}{indent}else\n{self.told(right, indent + '  ')}"

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            what = self.nodes[node]
            if isinstance(what, bool):
                out[rows] = what
            else:
                f, t, left, right = what
                low = x[rows, f] <= t
                todo += [(left, rows[low]), (right, rows[~low])]
        return out


TRAINING_PAGES = 1200


class _Sketch:
    """A labelled page in the making: markup, and a label for each of its blocks."""

    def __init__(self, rnd: random.Random, meaning: float, names: float) -> None:
        """meaning: how often an element has a tag that says what it is; names: how often one bears a telling name."""
        self.rnd, self.meaning, self.names = rnd, meaning, names
        self.html: list[str] = []
        self.marks: list[bool] = []

    def say(self, a: int, b: int) -> str:
        rnd = self.rnd
        return " ".join("".join(rnd.choices("abcdefghilmnoprstu", k=rnd.randint(1, 9))) for _ in range(rnd.randint(a, b)))

    def put(self, markup: str, *labels: bool) -> None:
        self.html.append(markup)
        self.marks.extend(labels)

    def within(self, tags: str, names: str, fill: Callable[[], None], always: bool = False) -> None:
        """fill inside an element: one of tags or a div, with one of names, another name or none."""
        rnd = self.rnd
        tag = rnd.choice(tags.split()) if rnd.random() < self.meaning else "div"
        named = always or rnd.random() < self.names
        name = rnd.choice(names.split(",")) if named else f"c{rnd.randint(1, 99)}" if rnd.random() < 0.5 else ""
        self.put(f"<{tag}{f' {rnd.choice(("class", "id"))}={chr(34)}{name}{chr(34)}' if name else ''}>")
        fill()
        self.put(f"</{tag}>")

    def linked(self, a: int, b: int, tag: str) -> None:
        self.put(f"<{tag}><a href='/{self.rnd.randint(1, 999)}'>{self.say(a, b)}</a></{tag}>", False)

    def menu(self) -> None:
        tag = self.rnd.choice(("li", "li", "li", "p", "div"))
        self.put("<ul>" if tag == "li" else "")
        for _ in range(self.rnd.randint(2, 9)):
            self.linked(1, 3, tag)
        self.put("</ul>" if tag == "li" else "")

    def teasers(self) -> None:
        """Links to other pages, some with a line of text."""
        if self.rnd.random() < 0.6:
            self.put(f"<h3>{self.say(1, 3)}</h3>", False)
        for _ in range(self.rnd.randint(2, 6)):
            self.linked(2, 10, "p")
            if self.rnd.random() < 0.3:
                self.put(f"<p>{self.say(3, 14)}</p>", False)

    def note(self, most: int = 30) -> None:
        """A few words in an element of their own: adverts, notices, letters to subscribe to."""
        text = self.say(2, most)
        self.put(self.rnd.choice((f"<p>{text}</p>", text)), False)
        if self.rnd.random() < 0.3:
            self.linked(1, 3, "p")

    def legal(self) -> None:
        text = self.say(2, 30)
        self.put(self.rnd.choice((f"<p>{text}</p>", text, f"{text} <a href='/'>{self.say(1, 2)}</a>")), False)

    def form(self) -> None:
        self.put(f"<form><p><label>{self.say(1, 6)}</label><input name=q></p></form>", False)

    def talk(self) -> None:
        """Readers' comments, each in an element of its own with who wrote it."""
        if self.rnd.random() < 0.5:
            self.put(f"<h3>{self.say(1, 3)}</h3>", False)
        for _ in range(self.rnd.randint(1, 8)):
            self.put(f"<div><p><a href='/u'>{self.say(1, 2)}</a> {self.say(0, 3)}</p><p>{self.say(2, 60)}</p></div>", False, False)

    def plain_talk(self) -> None:
        for _ in range(self.rnd.randint(1, 9)):
            self.put(f"<p>{self.say(2, 60)}</p>", False)

    def prose(self, k: int) -> None:
        for _ in range(k):
            what = self.rnd.random()
            if what < 0.1:
                self.put(f"<h2>{self.say(1, 6)}</h2>", True)
            elif what < 0.16:
                items = self.rnd.randint(1, 5)
                self.put("<ul>" + "".join(f"<li>{self.say(1, 12)}</li>" for _ in range(items)) + "</ul>", *[True] * items)
            elif what < 0.26:
                self.put(f"<p>{self.say(3, 30)} <a href='/y'>{self.say(1, 4)}</a> {self.say(2, 30)}</p>", True)
            elif what < 0.3:
                self.put(f"<blockquote>{self.say(3, 40)}</blockquote>", True)
            elif what < 0.42:
                self.put(f"<p>{self.say(1, 4)}</p>", True)
            else:
                self.put(f"<p>{self.say(5, 120)}</p>", True)

    def article(self) -> None:
        rnd = self.rnd
        if rnd.random() < 0.93:
            self.put(f"<h1>{self.say(2, 12)}</h1>", True)
        self.prose(rnd.choice((0, 1, 1, 2, 3, 4, 6, 9, 14)))
        if rnd.random() < 0.15:  # a part in a container of its own
            self.put("<div>")
            self.prose(rnd.randint(2, 4))
            self.put("</div>")
        if rnd.random() < 0.35:
            self.within("aside", "ad,advert,related,share,newsletter,promo", lambda: self.note(rnd.choice((30, 120))), always=True)
            self.prose(rnd.randint(1, 3))
        if rnd.random() < 0.1:
            self.form()
            self.prose(1)

    def page(self) -> tuple[str, list[bool]]:
        rnd = self.rnd
        if rnd.random() < 0.1:  # nothing but text
            bare = rnd.random()
            self.put(f"{'<p>' if bare < 0.3 else ''}{self.say(1, 400 if bare < 0.5 else 20)}", True) if bare < 0.7 else self.prose(rnd.randint(1, 6))
            return "".join(self.html), self.marks
        if rnd.random() < 0.04:  # nothing but what is beside
            self.meaning = 1.0
            self.within("nav header footer aside", "menu", rnd.choice((self.legal, self.menu, self.note)))
            return "".join(self.html), self.marks
        maybe = lambda p, *of: self.within(*of) if rnd.random() < p else None
        maybe(0.2, "div", "cookie-notice,consent,gdpr-banner", self.note)
        maybe(0.2, "header", "masthead,site-header,banner", self.legal)
        maybe(0.85, "nav", "menu,navbar,main-nav", self.menu)
        maybe(0.6, "aside section div", "ad,advert,banner,notice,promo", self.note)
        laid = rnd.random() < 0.3
        if laid:
            name = rnd.choice(LAYOUTS) if rnd.random() < self.names else ""
            self.put(f"<div class='{name}'>")
        self.within("article article main section", "post-body,entry,content,story,text,post", self.article)
        maybe(0.25, "aside", "sidebar,widget,related-links", self.teasers)
        if laid:
            self.put("</div>")
        maybe(0.3, "section", "comments,discussion", self.talk)
        if rnd.random() < 0.15:
            self.within("section", "comments,comment-list", self.plain_talk, always=True)
        maybe(0.2, "aside", "related-posts,recommended", self.teasers)
        maybe(0.15, "div", "newsletter,signup", self.form)
        maybe(0.15, "div", "ad,promo", self.note)
        maybe(0.85, "footer", "footer,legal,copyright", self.legal)
        return "<html><body>" + "".join(self.html) + "</body></html>", self.marks


#: Telling names of wrappers around an article and its sidebar.
LAYOUTS = ("content-sidebar-wrap", "content-with-sidebar", "main no-sidebar", "post comment-enabled", "sidebar-right", "page has-banner")


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """Pages with the labels of their blocks: articles amid menus, adverts, notices, forms and comments."""
    rnd = random.Random(seed)
    return [_Sketch(rnd, rnd.choice((0.0, 0.0, 0.5, 1.0)), rnd.choice((0.0, 0.0, 0.5, 1.0))).page() for _ in range(n)]


@lru_cache(maxsize=1)
def trained() -> Tree:
    x, y = [], []
    for page, labels in labelled_pages():
        found = parsed(page)
        if len(found.blocks) != len(labels):
            raise AssertionError("a training page has other blocks than labels")
        x.append(features(found))
        y += labels
    return Tree().fit(np.concatenate(x), np.array(y))


def main_text(html: str, tree: Tree) -> str:
    page = parsed(html)
    if not page.blocks:
        return ""
    return "\n".join(b.text for b, keep in zip(page.blocks, tree.predict(features(page)), strict=True) if keep)


def _extract(tree: Tree, html: int) -> Callable:
    def run(tables):
        for b in win.batches(tables, html):
            found = [main_text(t or "", tree) for t in b.column(html).to_pylist()]
            names = [x for k, x in enumerate(b.schema.names) if k != html]
            yield pa.record_batch([*[x for k, x in enumerate(b.columns) if k != html], pa.array(found, pa.string())], names=[*names, "text"])

    return run


def extract_text(pages: DataFrame, html_col: str = "html", tree: Tree | None = None) -> DataFrame:
    """pages without the html column, with the main text as text."""
    keep = [x for x in pages.columns if x not in (html_col, "text")]
    inner = [f"__h{i}" for i in range(len(keep))]
    d = c.ship(pages).select(*[F.col(f"`{x}`").alias(y) for x, y in zip(keep, inner, strict=True)], F.col(f"`{html_col}`").alias("__html"))
    schema = d.drop("__html").withColumn("text", F.lit("")).schema
    d = d.mapInArrow(_extract(tree or trained(), len(keep)), schema)
    return d.select(*[F.col(y).alias(x) for x, y in zip(keep, inner, strict=True)], "text")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = extract_text(c.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return d.withColumn("n_chars", F.length("text").cast("long"))
