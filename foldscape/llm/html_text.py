"""Main text of HTML pages by composite text density.

The page becomes a tree of elements; scripts, styles, navigation, headers, footers,
sidebars, notices, adverts, forms and reader comments are left out of it, by element
and by the words in class, id and role.  For each node, with C characters, T tags, LC
characters and LT tags of links below it, and LCb, Cb for the body,

    density = C / T * log(C / LC * T / LT) / log(ln(C / (C - LC) * LC + LCb / Cb * C + e))

(zeros count as 1), and a node's sum is that of its children's densities.  The node with
the largest sum is the root of the main text; if it stands in an article or main element,
all of that is, so that no heading is lost; if such elements stand in it, they are, with a
tenth of its characters and half the largest sum among them.  (Of the pages of sf0.1, all
give the same text if these elements are renamed.)  The threshold is the smallest density on the
path from the root to the body; other nodes of that density or more, outside the root,
whose sum is at least half the root's are main text too.

Inside an article or main element the words in class, id and role count on containers
(divisions, lists, tables and the like); sections go only by words for comments and
adverts, and other elements (paragraphs, headings, spans) only where a class is nothing
but a word for an advert.

Blocks are parted at block elements; character references are decoded, white space in a
block is one space, blocks are joined in page order by two line feeds.  A <br> is white
space.  Defined results: a null, empty or textless page has empty text.  The tree takes
memory in proportion to the page.  Other columns pass through.
"""

from __future__ import annotations

import bisect
import html
import itertools
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import add_from_text

_TAG = re.compile(
    r"""<!--(?s:.*?)(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?/][^>]*>""",
)
#: The same, whatever quotes there are.
_BARE = re.compile(r"""<!--(?s:.*?)(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>()()()|<[!?/][^>]*>""")
_HINT = re.compile(r"""(?<![^\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Words in class, id and role that mark what is not main text.
_NOT_MAIN = frozenset(
    "ad ads alert alerts advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs complementary comment comments "
    "consent contentinfo cookie cookies disclaimer discussion disqus footer gdpr header masthead menu modal nav navbar navigation "
    "newsletter notice notices notification outbrain pagination paywall popup promo promoted promotion recommended related replies "
    "respond rail search share sharing sidebar signup social sponsor sponsored subscribe subscription taboola toolbar widget".split()
)
#: The same within longer words.
_STEMS = re.compile("comment(?!ar)|sidebar|cookie|advert|newsletter|breadcrumb|navigation|sponsor|disqus|masthead|subscrib|subscription|mainmenu|topnav|navmenu|adsense|footer")
_RAW = frozenset("script style noscript template textarea title select noembed noframes xmp desc metadata annotation".split())
_SKIP = frozenset("nav header footer aside form menu dialog button fieldset head".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen".split())
_BLOCK = frozenset(
    "address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html li main "
    "nav ol p pre section summary table tbody td tfoot th thead tr ul aside footer header form hgroup legend fieldset option menu dialog".split()
)
_HOLDS_P = ("td", "th", "table", "button", "caption")
_ENDS_P = _BLOCK - frozenset("body html caption td th tr tbody thead tfoot option".split())
#: What a start tag closes, up to the enclosing element in the second set.
_SIBLING = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
}


_raw_ends: dict[str, re.Pattern] = {}


def _raw_end(name: str) -> re.Pattern:
    return _raw_ends.setdefault(name, re.compile(rf"</{name}\b[^>]*>", re.I))


class _Open:
    """The open elements, outermost first, and where those of each name stand."""

    def __init__(self):
        self.names: list[str] = []
        self.at: dict[str, list[int]] = {}

    def __len__(self) -> int:
        return len(self.names)

    def push(self, name: str) -> None:
        self.at.setdefault(name, []).append(len(self.names))
        self.names.append(name)

    def pop(self) -> str:
        name = self.names.pop()
        self.at[name].pop()
        return name

    def count(self, name: str) -> int:
        return len(self.at.get(name, ()))

    def last(self, names: Iterable[str]) -> int:
        """The place of the innermost of these, -1 without one."""
        return max((p[-1] for x in names if (p := self.at.get(x))), default=-1)

    def first_behind(self, names: Iterable[str], place: int) -> int:
        """The place of the outermost of these behind a place, -1 without one."""
        found = [p[i] for x in names if (p := self.at.get(x)) and (i := bisect.bisect_right(p, place)) < len(p)]
        return min(found, default=-1)


class Page:
    """The elements of a page in the order of their start tags, without those left out, and its runs of text."""

    def __init__(self, text: str, hints: bool = True):
        self.hints = hints
        self.tag: list[str] = ["body"]
        self.parent: list[int] = [-1]
        self.chars: list[int] = [0]
        self.link_chars: list[int] = [0]
        self.links: list[int] = [0]
        self.last: list[int] = [0]
        self.runs: list[tuple[int, int, str]] = []  # element, block, text
        self._stack: list[int] = [0]
        self._open = _Open()
        self._open.push("body")
        self._read(text)

    def _close(self, place: int) -> None:
        while len(self._stack) > place:
            self.last[self._stack.pop()] = len(self.tag) - 1
            self._open.pop()

    def _read(self, text: str) -> None:
        stack, names = self._stack, self._open
        out = _Open()  # the open elements inside one that is left out, itself first
        block = pos = 0
        limit = text.rfind(">") + 1  # no tag ends behind it
        pattern = _TAG
        n = len(text)
        while pos <= n:
            m = pattern.search(text, pos, limit) if pos < limit else None
            stop = m.start() if m else n
            if not m and (cut := text.find("<!--", max(pos, limit))) >= 0:
                stop = cut
            if stop > pos and not out:
                run = text[pos:stop]
                if "&" in run:
                    run = html.unescape(run)
                size = len(run.strip())
                self.runs.append((stack[-1], block, run))
                self.chars[stack[-1]] += size
                if names.count("a"):
                    self.link_chars[stack[-1]] += size
            if not m:
                break
            pos = m.end()
            name = m[2] or m[5]
            if not name:
                if m[0].startswith("<!--") and not m[0].endswith("-->"):
                    break
                continue
            if m[5]:  # a quote that nothing closes: from here on quotes mean nothing
                pattern = _BARE
            name = name.lower()
            if m[1] or m[4]:  # an end tag
                if out:
                    if out.count(name):
                        while out.pop() != name:
                            pass
                    elif names.count(name) and name in _BLOCK:
                        out = _Open()
                    else:
                        continue
                    if out or not names.count(name) or name in _SKIP:
                        block += name in _BLOCK  # an inline element parts no block, left out or not
                        continue
                if name in _BLOCK:
                    block += 1
                if names.count(name) and name not in ("body", "html"):
                    self._close(names.last([name]))
                continue
            attributes = m[3] if m[2] else m[6]
            if name in _RAW:
                if not attributes.endswith("/"):
                    end = _raw_end(name).search(text, pos)
                    pos = end.end() if end else n + 1
                continue
            if name == "br" or name in _VOID:
                if not out:
                    block += name == "hr"
                    self.runs.append((stack[-1], block, " "))
                continue
            if out:
                out.push(name)
                continue
            if name in ("html", "body"):
                continue
            if name in _BLOCK:
                block += 1
            self._close_before(name)
            if self._left_out(name, attributes, names, self.hints):
                out.push(name)
                continue
            k = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.chars.append(0), self.link_chars.append(0), self.last.append(k)
            self.links.append(name == "a")
            if attributes.endswith("/") and name not in _BLOCK:
                continue
            stack.append(k)
            names.push(name)
        for k in stack:
            self.last[k] = len(self.tag) - 1

    def _close_before(self, name: str) -> None:
        """Closes what a start tag ends without an end tag."""
        if name in _SIBLING:
            same, within = _SIBLING[name]
            place = self._open.first_behind(same, max(0, self._open.last(within)))
            if place > 0:
                self._close(place)
        elif name in _ENDS_P:
            place = self._open.last(["p"])
            if place > self._open.last(_HOLDS_P):
                self._close(place)

    @staticmethod
    def _left_out(name: str, attributes: str, names: _Open, hints: bool) -> bool:
        inside = names.count("article") > 0 or names.count("main") > 0
        if name in _SKIP and not (name == "header" and inside) or name == "head":
            return True
        if not attributes or not hints or name in ("article", "main"):
            return hints and name == "article" and _marks(attributes, _COMMENT)
        if not inside:
            return _marks(attributes, _NOT_MAIN)
        if name == "section":
            return _marks(attributes, _IN_SECTION)
        if name in _CONTAINER:
            return _marks(attributes, _IN_ARTICLE)
        return any((m[1] or "").lower() == "class" and not _ADVERT.isdisjoint((m[2] or m[3] or m[4] or "").lower().split()) for m in _HINT.finditer(attributes))

    def main_text(self) -> str:
        """The page's main text."""
        n = len(self.tag)
        chars, link_chars, links, tags = self.chars[:], self.link_chars[:], self.links[:], [0] * n
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            chars[p] += chars[k]
            link_chars[p] += link_chars[k]
            links[p] += links[k]
            tags[p] += tags[k] + 1
        ratio = link_chars[0] / max(1, chars[0])
        density, total = [0.0] * n, [0.0] * n
        for k in range(n - 1, -1, -1):
            c, lc, t, lt = chars[k], max(1, link_chars[k]), max(1, tags[k]), max(1, links[k])
            if c:
                base = math.log(math.log(c / max(1, c - link_chars[k]) * link_chars[k] + ratio * c + math.e))
                d = c / t * math.log(c / lc * t / lt) / base if base > 1e-6 else c / t * math.log(max(math.e, c / lc * t / lt))
                density[k] = max(0.0, d)
            if k:
                total[self.parent[k]] += density[k]
        best = max(range(n), key=lambda k: (total[k], density[k], -k))
        root, up = best, best
        path = [best]
        while up > 0:
            if self.tag[up] in ("article", "main"):
                root = up
            up = self.parent[up]
            path.append(up)
        threshold = min(density[k] for k in path)
        named = [] if self.tag[root] in ("article", "main") else [k for k in range(root + 1, self.last[root] + 1) if self.tag[k] in ("article", "main") and chars[k] * 10 >= chars[root]]
        top = max((total[k] for k in named), default=0.0)
        chosen = [k for k in named if total[k] >= top / 2] or [root]
        if not named:
            chosen += [k for k in range(n) if total[k] >= total[best] / 2 and density[k] >= threshold and not k <= root <= self.last[k]]
        edge = [0] * (n + 1)  # where main text begins and ends, in the order of elements
        for k in chosen:
            edge[k] += 1
            edge[self.last[k] + 1] -= 1
        inside = list(itertools.accumulate(edge))
        blocks: list[str] = []
        held: list[str] = []
        now = -1
        for element, block, run in self.runs:
            if not inside[element]:
                continue
            if block != now:
                blocks.append(" ".join("".join(held).split()))
                held, now = [], block
            held.append(run)
        blocks.append(" ".join("".join(held).split()))
        return "\n\n".join(b for b in blocks if b)


_COMMENT = frozenset("comment comments reply replies".split())
_ARTICLE = re.compile(r"<(?:article|main)[\s>]", re.I)
_IN_ARTICLE = _NOT_MAIN - {"header"}
_ADVERT = frozenset("ad ads advert adverts advertisement advertising advertorial sponsored promo promoted".split())
_IN_SECTION = _COMMENT | _ADVERT
_CONTAINER = frozenset("div ul ol dl li table tbody tr td details figure address center".split())
_ABOUT_OTHERS = frozenset("has with no without".split())  # has-sidebar says what stands beside it


def _marks(attributes: str, words: frozenset[str]) -> bool:
    for m in _HINT.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            parts = [w.lower() for w in _WORDS.findall(name)]
            if parts and parts[0] not in _ABOUT_OTHERS and (not words.isdisjoint(parts) or words in (_NOT_MAIN, _IN_ARTICLE) and _STEMS.search(name.lower())):
                return True
    return False


def main_text(page: str | None) -> str:
    """The main text of one page; if names leave nothing of one with an article or main element, only elements are left out."""
    if not page:
        return ""
    return Page(page).main_text() or (Page(page, hints=False).main_text() if _ARTICLE.search(page) else "")


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds text and n_chars to each page."""

    def work(columns: Iterator[pa.Array]) -> Iterator[list[pa.Array]]:
        for column in columns:
            got = [main_text(x.as_py()) for x in column]
            yield [pa.array(got, type=pa.string()), pa.array([len(x) for x in got], type=pa.int64())]

    return add_from_text(pages, work, "text string, n_chars long", html_col)
