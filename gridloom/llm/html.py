"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser turns a page into lines: a line is the text between two block borders,
with its white space collapsed, the number of tags met in it, and the element it stands in. Lines in
elements that never hold an article (menus, footers, scripts, ...) have no text to count. Forms and
elements named as adverts, boxes or readers' comments have none either, unless they hold a main or an
article that is no comment itself (on a page without these: most of the page's text), known once the page
is read; a name that a heading inside repeats is a section's subject and hides nothing but a list of links. Each line's ratio is its characters over its tags; the ratios are smoothed with a
Gaussian kernel and split by a two-cluster threshold, which chooses the content lines. Every chosen
line is kept. The container (or the main or article around it) that holds all of them gives its short
lines as well, in page order, so that a one-word paragraph between long ones is not lost; a headline
before it comes with the lines in between, and with the rest of the wrapper that both stand in.

Defined results: a null or empty page has an empty text; a page without any block gives its loose
text; unclosed and stray tags are tolerated; repeated rows are extracted alike; other columns are
nested in `row`. Nothing is cut off, however long the page.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.batches import over_texts

# fixed values: element names and words of class names
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HIDDEN = frozenset(
    "head title script style noscript template iframe object canvas svg math nav footer aside form button select option "
    "textarea label input dialog menu header".split()
)
WHOLE = frozenset("html body main article".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
MASTHEADS = frozenset("header masthead".split())
# words that are also subjects of sections: as an id they may be made from a heading
CHROME_CLASSES = frozenset(
    "banner sponsor promotion header notice notices notification alert overlay newsletter related recommended respond reply "
    "discussion search copyright disclaimer share sharing social".split()
)
CHROME = frozenset(
    "ad ads advert adverts advertisement advertising ad-box ad-banner ad-slot ad-unit ad-container ad-wrapper adsbygoogle "
    "sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer cookie cookies cookie-banner "
    "cookie-notice consent gdpr popup modal subscribe signup comment comments comment-list replies disqus disqus_thread "
    "widget pagination pager toolbar login skip skip-link".split()
)
# words inside a longer name, such as user-comments or advertTop
COMMENT_WORDS = frozenset("comment comments commentlist respond replies disqus".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsored promo cookie cookies consent gdpr popup modal breadcrumb breadcrumbs "
    "pagination related recommended share sharing social newsletter subscribe signup".split()
)
# a first word that says what the element is beside or has, not what it is
BESIDE = frozenset("has with no not without is hide show".split())
WORDS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
SIGMA, RADIUS = 1.0, 3


def name_words(attrs: dict) -> list[list[str]]:
    """The words of every class name and of the id, cut at signs and inner capitals."""
    names = (attrs.get("class") or "").split() + (attrs.get("id") or "").split()
    return [[w.lower() for w in WORDS.findall(name)] for name in names]


def is_comment(attrs: dict) -> bool:
    return any(words and words[0] not in BESIDE and not COMMENT_WORDS.isdisjoint(words) for words in name_words(attrs))


class Lines(HTMLParser):
    """Collects (pieces, tags) per line, a piece being (text, element, hidden); element numbers form paths through `parent`."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, bool]] = []  # name, element number, hidden, hidden by a block
        self.open: Counter[str] = Counter()  # names on the stack
        self.parent = [-1]
        self.names = ["#page"]
        self.marked: set[int] = set()  # elements that are hidden unless they hold the article
        self.subjects: dict[int, set[str]] = {}  # of these, the ones whose name may be a section's subject
        self.comments: set[int] = set()  # of these, readers' comments
        self.whole: list[int] = []  # visible main and article elements
        self.lines: list[tuple[list[tuple[str, int, bool]], int]] = []
        self.parts: list[tuple[str, int, bool]] = []
        self.tags = 0

    def _at(self) -> tuple[int, bool]:
        return (self.stack[-1][1], self.stack[-1][2]) if self.stack else (0, False)

    def _push(self, name: str, number: int, hidden: bool) -> None:
        block_hidden = hidden and (name in BLOCKS or (bool(self.stack) and self.stack[-1][3]))
        self.stack.append((name, number, hidden, block_hidden))
        self.open[name] += 1

    def _pop_to(self, k: int) -> None:
        for entry in self.stack[k:]:
            self.open[entry[0]] -= 1
        del self.stack[k:]

    def _end_line(self) -> None:
        if self.parts:
            if any(not text.isspace() for text, _, _ in self.parts):
                self.lines.append((self.parts, max(1, self.tags)))
            self.parts, self.tags = [], 0

    def _hides(self, name: str, attrs: dict, inside: bool) -> bool:
        if name in WHOLE:
            return inside
        if inside:
            return not (name in HEADINGS and self._in_article_header())
        if (name in HIDDEN and name != "form") or (attrs.get("role") or "").lower() in ROLES:
            return True
        return "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower()

    def _mark(self, name: str, attrs: dict, number: int) -> None:
        if name in HEADINGS or name in ("html", "body", "main"):
            return
        if is_comment(attrs):
            self.marked.add(number)
            self.comments.add(number)
            return
        if name in WHOLE:
            return
        classes = set((attrs.get("class") or "").lower().split())
        if self.open["main"] or self.open["article"]:
            classes -= MASTHEADS  # the article's own header
        if name == "form" or classes & CHROME or (attrs.get("id") or "").strip().lower() in CHROME:
            self.marked.add(number)
            return
        subjects = classes & CHROME_CLASSES
        for words in name_words(attrs):
            if len(words) > 1 and words[0] not in BESIDE:
                subjects |= CHROME_WORDS.intersection(words)
        if subjects:
            self.marked.add(number)
            self.subjects[number] = subjects

    def _in_article_header(self) -> bool:
        """A heading in the header of an article is the article's own."""
        if not (self.open["header"] and self.open["article"]):
            return False
        names = [entry[0] for entry in self.stack]
        return "header" in names and "article" in names[: names.index("header")] and not {"nav", "aside", "form"} & set(names)

    def handle_starttag(self, name, attrs):
        if name in BLOCKS:
            self._end_line()
            for k in range(len(self.stack) - 1, -1, -1):  # a block ends an open paragraph
                if not self.open["p"]:
                    break
                if self.stack[k][0] == "p":
                    self._pop_to(k)
                    break
                if self.stack[k][0] in BLOCKS:
                    break
            if name == "li":
                self._close_open("li", {"ul", "ol", "menu"})
        self.tags += 1
        if name in VOID:
            if name in ("br", "hr"):
                self.parts.append((" ", *self._at()))
            return
        if name in BLOCKS or name in HIDDEN or attrs:
            self.parent.append(self._at()[0])
            self.names.append(name)
            number = len(self.parent) - 1
            hidden = self._hides(name, dict(attrs), self._at()[1])
            if not hidden:
                self._mark(name, dict(attrs), number)
            if not hidden and name in ("main", "article"):
                self.whole.append(number)
            self._push(name, number, hidden)
        else:
            self._push(name, *self._at())

    def _close_open(self, name: str, stop: set) -> None:
        if not self.open[name]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                self._pop_to(k)
                return
            if self.stack[k][0] in stop:
                return

    def handle_startendtag(self, name, attrs):
        self.handle_starttag(name, attrs)
        if name not in VOID:
            self.handle_endtag(name)

    def handle_endtag(self, name):
        if name in BLOCKS:
            self._end_line()
        self.tags += 1
        if not self.open[name]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                self._pop_to(k)
                return
            if self.stack[k][0] in BLOCKS and name not in BLOCKS:
                return

    def handle_data(self, data):
        hidden = self._at()[1]
        if hidden and not self.stack[-1][3]:
            return  # a hidden inline element inside a line
        self.parts.append((data, self._at()[0], hidden))

    def resolved(self) -> list[tuple[str, int, int, bool]]:
        """(text, tags, element, hidden) per line, once it is known what the marked elements hold."""
        count = len(self.parent)
        in_link, under = [False] * count, [False] * count  # under: in readers' comments
        for e in range(1, count):
            in_link[e] = in_link[self.parent[e]] or self.names[e] == "a"
            under[e] = under[self.parent[e]] or e in self.comments
        size, linked, said = [0] * count, [0] * count, [set() for _ in self.subjects]
        place = {e: k for k, e in enumerate(self.subjects)}
        holder = [-1] * count  # the nearest element around that may be a section of its own subject
        heading = [False] * count
        for e in range(1, count):
            holder[e] = e if e in place else holder[self.parent[e]]
            heading[e] = heading[self.parent[e]] or self.names[e] in HEADINGS
        for pieces, _ in self.lines:
            for text, element, hidden in pieces:
                n = 0 if hidden else len("".join(text.split()))
                size[element] += n
                linked[element] += n if in_link[element] else 0
                if n and heading[element] and holder[element] >= 0:
                    said[place[holder[element]]] |= set(re.findall(r"[a-z]+", text.lower()))
        own = list(size)
        for e in range(count - 1, 0, -1):
            size[self.parent[e]] += size[e]
            linked[self.parent[e]] += linked[e]
            if e not in self.comments:
                own[self.parent[e]] += own[e]
        # an article that is a reader's comment counts only where there is no other
        whole = [e for e in self.whole if size[e]]
        articles = [e for e in whole if not under[e] and own[e]] or whole
        spared = set() if articles else {e for e in self.marked if 2 * size[e] > size[0]}
        spared |= {e for e, words in self.subjects.items() if words & said[place[e]] and own[e] > 2 * linked[e]}
        holding: set[int] = set()
        for e in articles:
            while e > 0 and e not in holding:
                holding.add(e)
                e = self.parent[e]
        spared |= holding
        off = [False] * len(size)
        in_block = [False] * len(size)  # hidden by a block, so the line stays, without text to count
        for e in range(1, len(size)):
            up = self.parent[e]
            off[e] = off[up] or (e in self.marked and e not in spared)
            in_block[e] = in_block[up] or (off[e] and self.names[e] in BLOCKS)
        lines = []
        for pieces, tags in self.lines:
            shown = [(text, e) for text, e, hidden in pieces if not hidden and not off[e]]
            if not any(not text.isspace() for text, _ in shown):
                shown = []
            words = shown or [(text, e) for text, e, hidden in pieces if hidden or in_block[e]]
            text = " ".join("".join(t for t, _ in words).split())
            if text:
                lines.append((text, tags, common(self.parent, [e for t, e in words if not t.isspace()]), not shown))
        return lines


def common(parent: list[int], elements: list[int]) -> int:
    """The deepest element that holds all of them (numbers go down the page, so the first and the last decide)."""
    found, e = min(elements), max(elements)
    while found != e:
        if found > e:
            found = parent[found]
        else:
            e = parent[e]
    return found


def smoothed(ratios: np.ndarray) -> np.ndarray:
    offsets = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-(offsets**2) / (2 * SIGMA**2))
    return np.convolve(ratios, kernel / kernel.sum(), "full")[RADIUS : RADIUS + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """The border between the two clusters of the smoothed ratios (two-means on a line)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        border = (low + high) / 2
        upper = values >= border
        new = (float(values[~upper].mean()) if not upper.all() else low, float(values[upper].mean()) if upper.any() else high)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str | None) -> str:
    """The article's blocks, joined by an empty line."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser._end_line()
    lines = parser.resolved()
    if not lines:
        return ""
    open_text = np.array([0 if hidden else len(text) for text, _, _, hidden in lines], float)
    if not open_text.any():
        return ""
    ratios = smoothed(open_text / np.array([tags for _, tags, _, _ in lines]))
    chosen = (ratios >= threshold(ratios)) & (open_text > 0)
    if not chosen.any():
        chosen = open_text > 0
    paths = Paths(parser)
    best = paths.region(common(parser.parent, [line[2] for line, use in zip(lines, chosen, strict=True) if use]))
    within = paths.inside(best)
    kept = [not hidden and (bool(use) or within[element]) for (_, _, element, hidden), use in zip(lines, chosen, strict=True)]
    first = kept.index(True)
    # a headline before the region, and what stands between them
    headed = paths.headed("h1")
    if not any(keep and headed[line[2]] for line, keep in zip(lines, kept, strict=True)):
        for name in ("h1", "h2"):
            headed = paths.headed(name)
            at = next((i for i in range(first - 1, -1, -1) if not lines[i][3] and headed[lines[i][2]]), None)
            if at is None:
                continue
            both = common(parser.parent, [best, lines[at][2]])
            wrapped = parser.names[both] not in PAGE
            if wrapped or name == "h1":
                within = paths.inside(both)
                for i, (_, _, element, hidden) in enumerate(lines):
                    kept[i] |= not hidden and (at <= i < first or (wrapped and within[element]))
                break
    return "\n\n".join(line[0] for line, keep in zip(lines, kept, strict=True) if keep)


PAGE = frozenset("#page html body".split())
CONTAINERS = frozenset("html body main article section div td center".split())


class Paths:
    """Where an element stands on its page."""

    def __init__(self, parser: Lines):
        self.parent, self.names = parser.parent, parser.names

    def inside(self, region: int) -> list[bool]:
        """Of every element, whether it stands in the region."""
        found = [False] * len(self.parent)
        for e, up in enumerate(self.parent):
            found[e] = e == region or (e > 0 and found[up])
        return found

    def headed(self, name: str) -> list[bool]:
        """Of every element, whether it stands in an element of that name."""
        found = [False] * len(self.parent)
        for e, up in enumerate(self.parent):
            found[e] = e > 0 and (self.names[e] == name or found[up])
        return found

    def region(self, element: int) -> int:
        """The outermost main or article around the element, else the nearest container."""
        found, nearest = -1, -1
        while element > 0:
            if nearest < 0 and self.names[element] in CONTAINERS:
                nearest = element
            if self.names[element] in ("main", "article"):
                found = element
            element = self.parent[element]
        return max(0, found if found > 0 else nearest)


def extract(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """Per page: row (the columns in `keep`), text, n_chars."""

    def found(texts: pa.Array) -> list:
        out = [main_text(t) for t in texts.to_pylist()]
        return [pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]

    return over_texts(pages, found, "text string, n_chars long", keep, html)
