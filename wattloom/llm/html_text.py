"""Main text of web pages by tree scoring.

A tolerant reader turns the page into a tree. Paragraphs pass points for length and commas to
their ancestors, discounted by link density; the best container is kept with its siblings of
the same kind, and its blocks are the text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick

# Element names of the HTML standard by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose own text counts for the parent: they are the paragraphs.
PARAGRAPHS = frozenset("p pre li dd dt td th blockquote figcaption caption address summary".split()) | HEADINGS
#: An open element of the second kind ends when one of the first begins.
ENDS = (
    (BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}, {"p"}),
    (HEADINGS, HEADINGS), ({"li"}, {"li"}), ({"dt", "dd"}, {"dt", "dd"}), ({"option", "optgroup"}, {"option"}),
    ({"td", "th"}, {"td", "th"}), ({"tr"}, {"td", "th", "tr"}),
    ({"tbody", "thead", "tfoot"}, {"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}), ({"a"}, {"a"}), ({"button"}, {"button"}))
#: Ends of elements do not reach beyond these.
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"},
         "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}, "caption": {"table"}}
#: Never part of the main text.
DROPPED = frozenset(
    "head script style title noscript template textarea iframe noembed noframes nav menu aside footer dialog "
    "svg math canvas object audio video map button select option optgroup datalist label fieldset legend input "
    "xmp search".split())
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status tooltip".split())
#: Words of class and id that tell menus, headers, sidebars, notices, adverts, forms and reader comments.
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promotion "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager skip topbar toolbar masthead "
    "sidebar sidebars aside rail related recommended recommendations widget widgets footer foot "
    "cookie cookies consent gdpr notice notices notification alert banner popup modal overlay paywall "
    "newsletter subscribe subscription signup login share sharing social sharebar "
    "comment comments commentlist disqus reply replies respond discussion livefyre form search".split())
#: A class of these words alone, ``header`` among them, is the head of the site.
HEADER_WORDS = frozenset("header site page top main global".split())
#: A class such as ``with-sidebar`` speaks of something else on the page.
STATES = frozenset("has with without no open closed enabled disabled is not allow".split())
MAIN_ROLES = frozenset("main article".split())
#: Points by element, added once to a container that any paragraph speaks for.
BONUS = {"article": 25.0, "main": 25.0, "div": 5.0, "section": 5.0, "td": 3.0, "pre": 3.0, "blockquote": 3.0,
         "ul": -3.0, "ol": -3.0, "dl": -3.0, "dd": -3.0, "dt": -3.0, "li": -3.0, "form": -3.0, "table": -3.0}
GOOD_WORDS = frozenset("article body content entry hentry main page post text blog story".split())
COMMAS = re.compile("[,،、，]")

#: Points of a paragraph reach so many ancestors; of the best score a sibling needs this share.
LEVELS, SIBLING_SHARE = 5, 0.2
#: Lists and boxes with more of their text in links are menus; a paragraph beside the best container may have this much.
MENU_DENSITY, BESIDE_DENSITY = 0.5, 0.25

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW}
_CLASS_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_ENDS = {name: frozenset().union(*[ended for begun, ended in ENDS if name in begun])
         for name in frozenset().union(*[begun for begun, _ in ENDS])}


class Page:
    """The tree of a page as lists by node number; node 0 is the document. Children follow their parent."""

    def __init__(self, source: str):
        self.names, self.parents, self.attributes = ["#document"], [-1], [{}]
        #: In page order: (node, text) for text, (node, None) for a line break or the end of a block.
        self.pieces: list[tuple[int, str | None]] = []
        self._open, self._count = [0], Counter()
        at, end = 0, len(source)
        while at < end:
            found = _TOKEN.search(source, at)
            self._text(source[at:found.start() if found else end])
            if not found:
                break
            at = found.end()
            if name := found[2]:
                name = name.lower()
                if found[1]:
                    self._close(name)
                else:
                    at = self._begin(name, found[3], source, at)
        self._count.clear()

    def _text(self, text: str) -> None:
        if text:
            self.pieces.append((self._open[-1], html.unescape(text) if "&" in text else text))

    def _begin(self, name: str, rest: str, source: str, at: int) -> int:
        """A start tag; returns where reading goes on (after the end of raw text)."""
        if name in ("html", "body") and self._count[name]:
            return at
        ended = _ENDS.get(name, ())
        if any(self._count[x] for x in ended):
            walls = WALLS.get(name, {"td", "th", "table", "button"})
            for place in range(len(self._open) - 1, 0, -1):
                kind = self.names[self._open[place]]
                if kind in ended:
                    self._cut(place)
                elif kind in walls or name in ("a", "option") and kind in BLOCK:
                    break
        self.names.append(name)
        self.parents.append(self._open[-1])
        self.attributes.append({m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "")
                                for m in _ATTRIBUTE.finditer(rest)} if rest.strip(" /\n\t") else {})
        node = len(self.names) - 1
        if name in BLOCK or name == "br":
            self.pieces.append((node, None))
        if name in RAW:
            end = _RAW_END[name].search(source, at)
            return end.end() if end else len(source)
        if name not in VOID and not (rest.endswith("/") and name in ("path", "rect", "circle", "line", "use")):
            self._open.append(node)
            self._count[name] += 1
        return at

    def _close(self, name: str) -> None:
        if name == "br":
            self.pieces.append((self._open[-1], None))
        if not self._count[name]:
            return
        walls = WALLS.get(name, {"td", "th"} if name not in BLOCK or name in ("p", "div") else ())
        for place in range(len(self._open) - 1, 0, -1):
            kind = self.names[self._open[place]]
            if kind == name and name not in BLOCK and any(self.names[x] in BLOCK for x in self._open[place:]):
                del self._open[place]  # the blocks begun inside go on
                self._count[name] -= 1
                return
            if kind == name:
                self._cut(place)
                return
            if kind in walls:
                return

    def _cut(self, place: int) -> None:
        """Ends the open element at ``place`` and all inside it."""
        for node in reversed(self._open[place:]):
            self._count[self.names[node]] -= 1
            if self.names[node] in BLOCK:
                self.pieces.append((node, None))
        del self._open[place:]


def _words(attributes: dict[str, str]) -> list[set[str]]:
    """The words of each class and of the id."""
    if "class" not in attributes and "id" not in attributes:
        return []
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    return [{w.lower() for w in _CLASS_WORD.findall(name)} for name in names]


def _is_main(name: str, attributes: dict[str, str]) -> bool:
    return name in ("article", "main") or attributes.get("role") in MAIN_ROLES or attributes.get("itemprop") == "articleBody"


def _is_junk(attributes: dict[str, str]) -> bool:
    return any(words & DROPPED_WORDS and not words & STATES for words in _words(attributes))


def _left_out(page: Page) -> list[bool]:
    """Nodes that are no main text by their element, role, class or id, or that lie in such a node."""
    names, parents, count = page.names, page.parents, len(page.names)
    holds, titled = [False] * count, [False] * count  # a main part inside; a heading inside
    main = [False] + [_is_main(names[i], page.attributes[i]) and not _is_junk(page.attributes[i]) for i in range(1, count)]
    for node in range(count - 1, 0, -1):
        up = parents[node]
        holds[up] |= holds[node] or main[node]
        titled[up] |= titled[node] or names[node] in HEADINGS
    out, inside = [False] * count, main
    for node in range(1, count):
        up, name, attributes = parents[node], names[node], page.attributes[node]
        inside[node] = inside[node] or inside[up]
        if out[up] or name in DROPPED or "hidden" in attributes or attributes.get("aria-hidden") == "true":
            out[node] = True
        elif holds[node] or name in ("html", "body", "main"):
            pass
        elif name == "form" or attributes.get("role", "").lower() in DROPPED_ROLES or _HIDDEN.search(attributes.get("style", "")):
            out[node] = True
        elif name == "header" or any("header" in words and words <= HEADER_WORDS for words in _words(attributes)):
            out[node] = not (inside[up] and titled[node])
        elif name not in HEADINGS:
            out[node] = _is_junk(attributes)
    return out


def _blocks(page: Page, out: list[bool]) -> list[tuple[int, str, int]]:
    """(node of the block, text, letters in links) of each block of text, in page order."""
    names, parents = page.names, page.parents
    block = [0] * len(names)  # nearest block element, the node itself included
    linked = [False] * len(names)
    for node in range(1, len(names)):
        block[node] = node if names[node] in BLOCK else block[parents[node]]
        linked[node] = names[node] == "a" or linked[parents[node]]
    found: list[tuple[int, str, int]] = []
    parts: list[str] = []
    owner, letters, breaks = 0, 0, 0

    def end() -> None:
        nonlocal parts, letters
        text = " ".join("".join(parts).split())
        if text:
            found.append((owner, text, letters))
        parts, letters = [], 0

    for node, text in page.pieces:
        if text is None:
            if names[node] == "br" and block[node] == owner:
                breaks += 1  # one is white space, several end the paragraph
                parts.append(" ")
                if breaks > 1:
                    end()
            else:
                end()
                breaks = 0
            continue
        if out[node]:
            continue
        if block[node] != owner:
            end()
            owner = block[node]
        if text.strip():
            breaks = 0
        parts.append(text)
        if linked[node]:
            letters += len("".join(text.split()))
    end()
    return found


def main_text(source: str | None) -> str:
    """The blocks of the page's main text, one a line; empty for null, empty and text-free pages."""
    if not source:
        return ""
    page = Page(source)
    out = _left_out(page)
    blocks = _blocks(page, out)
    if not blocks:
        return ""
    names, parents, count = page.names, page.parents, len(page.names)
    size, links, points, spoken = [0] * count, [0] * count, [0.0] * count, [False] * count
    for node, text, letters in blocks:
        size[node] += len(text) - text.count(" ")
        links[node] += letters
        if names[node] in HEADINGS:
            continue
        worth = 1.0 + len(COMMAS.findall(text)) + len(text) / 100
        up = parents[node] if names[node] in PARAGRAPHS else node
        for level in range(LEVELS):
            if up < 0:
                break
            points[up] += worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
            spoken[up] = True
            up = parents[up]
    for node in range(count - 1, 0, -1):
        size[parents[node]] += size[node]
        links[parents[node]] += links[node]
    density = [links[i] / size[i] if size[i] else 0.0 for i in range(count)]
    score = [0.0] * count
    for node in range(count):
        if spoken[node]:
            bonus = BONUS.get(names[node], 0.0) + (25.0 if any(words & GOOD_WORDS for words in _words(page.attributes[node])) else 0.0)
            score[node] = (points[node] + bonus) * (1 - density[node])
    if not any(spoken):
        return "\n".join(text for _, text, _ in blocks)  # headings alone
    best = max((i for i in range(count) if spoken[i]), key=lambda i: (score[i], i))
    kept = _kept(page, out, best, score, density, size)
    menus = _menus(page, best, density)
    inside = [False] * count
    lines = []
    for node in range(count):
        inside[node] = (node in kept or (parents[node] >= 0 and inside[parents[node]])) and node not in menus
    for node, text, _ in blocks:
        if inside[node]:
            lines.append(text)
    return "\n".join(lines)


def _kept(page: Page, out: list[bool], best: int, score: list[float], density: list[float], size: list[int]) -> set[int]:
    """The article around the best container, or the container with the siblings that belong to it."""
    names, parents, attributes = page.names, page.parents, page.attributes
    node = best
    while node > 0:
        if _is_main(names[node], attributes[node]):
            best = node
            if names[node] == "article":
                break
        node = parents[node]
    up, kind = parents[best], attributes[best].get("class")
    kept = {best}
    if up < 0 or names[best] in ("html", "body", "main"):
        return kept
    for node in range(up + 1, len(names)):
        if parents[node] != up or out[node] or node == best:
            continue
        worth = score[node] + (SIBLING_SHARE * score[best] if kind and attributes[node].get("class") == kind else 0.0)
        plain = names[node] in PARAGRAPHS | {"ul", "ol", "dl", "table", "figure"} and density[node] < BESIDE_DENSITY
        if size[node] and names[best] != "article" and (worth >= max(10.0, SIBLING_SHARE * score[best]) or plain):
            kept.add(node)
        elif size[node] and names[node] == "article" and score[node] >= max(10.0, SIBLING_SHARE * score[best]):
            kept.add(node)
    return kept


def _menus(page: Page, best: int, density: list[float]) -> set[int]:
    """Lists and boxes of at least three links that hold most of their text."""
    links = [0] * len(page.names)
    for node in range(len(page.names) - 1, 0, -1):
        links[node] += page.names[node] == "a"
        links[page.parents[node]] += links[node]
    return {i for i, name in enumerate(page.names)
            if i != best and name in ("ul", "ol", "div", "section", "table", "dl") and links[i] >= 3 and density[i] > MENU_DENSITY}


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Null, empty and text-free pages have an empty text; a null id or url stays null; repeated
    rows give a row each; an empty table gives none. Other columns are left out, whatever
    their names. The work is page by page, so its memory is that of a batch of pages.
    """
    rows = pick(pages, page_id=key, url=url, html=source)
    kinds = [f"{name} {rows.schema[name].dataType.simpleString()}" for name in ("page_id", "url")]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(batches, f"{', '.join(kinds)}, text string, n_chars bigint")
