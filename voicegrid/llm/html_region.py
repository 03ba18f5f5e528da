"""Main text of web pages by the maximum-scoring contiguous region.

A page is a row of words and tags.  Words score positive and tags negative; the
weights come from labelled pages, that is pages with exactly one ``article`` or
``main`` element: a word's weight is the share of such words inside that
element, a tag's the share of such tags outside.  Both are taken apart by the
enclosing block, by links and by boilerplate.  One linear scan finds the region
of the highest sum.  The region then grows to the element that holds it, so that
a short first or last block isn't cut off, and boilerplate inside is left out.

Defined results: a null or empty html has an empty text; a page without words
too; unclosed elements end with their parent; repeated rows are extracted each;
without labelled pages fixed default weights hold; extra columns are ignored;
empty tables give empty results.
"""

from __future__ import annotations

import html as html_entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voicegrid.llm.text_arrays import column_of, in_chunks

# Element kinds of HTML and the names that pages give to boilerplate.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noframes noembed xmp".split())
LEFT_OUT = frozenset(
    "head title script style noscript template iframe textarea noframes noembed xmp nav footer aside form button select option menu "
    "dialog svg canvas object audio video map search fieldset label".split()
)
CONTAINERS = frozenset("article main section div td body html blockquote center form".split())
NAMES_LEFT_OUT = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox sponsor sponsored sponsors promo promotion banner "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside footer masthead topbar "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended comment comments commentlist disqus reply replies respond pagination pager widget "
    "widgets toolbar copyright skip form search".split()
)
#: What readers wrote is left out even if it is most of the page.
READER_NAMES = frozenset("comment comments commentlist disqus reply replies respond".split())
SENTENCES = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd figcaption".split())
NAME_STARTS = ("advert", "cookie", "comment", "sidebar", "newsletter", "sponsor")
NAME_ENDS = ("menu", "nav", "navbar", "sidebar", "footer", "banner", "advert", "comments")
ROLES_LEFT_OUT = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
TAG_COST = 5.0
DEFAULT_WEIGHTS = {"word": 1.0, "word link": 0.1, "word out": 0.0, "tag": -2.0, "tag p": -0.5, "tag br": -0.2, "tag out": -5.0}
KEPT_SHARE = 0.9


#: Why an element is left out: never mind where it stands, by what readers wrote, or by a name that may mislead.
HARD, READERS, NAMED = 3, 2, 1


@dataclass
class Element:
    """An open or closed element of a page; ``reason`` is its own, ``out`` includes those around it."""

    tag: str
    parent: int
    out: bool
    link: bool
    inside: bool
    labelled: bool = False
    reason: int = 0
    words: int = 0


@dataclass
class Block:
    """A run of text between two block borders."""

    parent: int
    out: bool
    pieces: list[str] = field(default_factory=list)
    links: int = 0
    words: int = 0
    first: int = 0
    last: int = 0


class Page:
    """Elements, blocks and the scored row of one page.

    Elements are numbered as they open, so what is below one has the numbers up
    to its ``ends``.  Depths of open elements are kept by name, so that no tag
    walks the stack.  A name or a form that holds the article, or most of the
    page's words outside links where little else is left, leaves nothing out:
    such a page is read again with those elements spared.
    """

    def __init__(self, source: str) -> None:
        self._begin(frozenset())
        self._read(source)
        spared = self._misleading()
        if spared:
            self._begin(spared)
            self._read(source)
        self.ends = list(range(len(self.elements)))
        for number in range(len(self.elements) - 1, 0, -1):
            parent = self.elements[number].parent
            self.ends[parent] = max(self.ends[parent], self.ends[number])

    def _begin(self, spared: frozenset[int]) -> None:
        self.spared = spared
        self.elements = [Element("#page", -1, False, False, False)]
        self.blocks: list[Block] = []
        #: (feature, number of words or 1 for a tag, innermost element)
        self.row: list[tuple[str, int, int]] = []
        self.stack = [0]
        self.depths: dict[str, list[int]] = {}
        self.block_depths: list[int] = []
        self.block: Block | None = None

    def below(self, number: int, parent: int) -> bool:
        """Whether an element is another one or stands below it."""
        return parent <= number <= self.ends[parent]

    def _misleading(self) -> frozenset[int]:
        """Elements whose name or form must not leave out what they hold."""
        if not any(e.reason in (NAMED, READERS) for e in self.elements):
            return frozenset()
        hard, whole = [False] * len(self.elements), [e.words for e in self.elements]
        for number, element in enumerate(self.elements):
            hard[number] = element.reason == HARD or (number > 0 and hard[element.parent])
        for number in range(len(self.elements) - 1, 0, -1):
            whole[self.elements[number].parent] += 0 if hard[number] else whole[number]
        accepted = sum(e.words for e in self.elements if not e.out)
        spared: set[int] = set()
        articles = [k for k, e in enumerate(self.elements) if e.labelled and not hard[k] and whole[k]]
        if not any(not self.elements[k].out for k in articles):
            best = max(articles, key=whole.__getitem__, default=0)
            if best and whole[best] > accepted:
                spared |= {k for k in self.above(best) if self.elements[k].reason}
        if 5 * accepted < whole[0]:
            spared |= {k for k, e in enumerate(self.elements) if e.reason == NAMED and not hard[k] and 2 * whole[k] > whole[0]}
        return frozenset(spared)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            mark = source.find("<", at)
            if mark < 0:
                mark = end
            if mark > at:
                self._text(source[at:mark])
            if mark == end:
                break
            if source.startswith("<!--", mark):
                at = self._after(source, "-->", mark + 2)  # so that <!--> and <!---> are empty
            elif source[mark + 1 : mark + 2] in ("!", "?"):
                at = self._after(source, ">", mark)
            elif (tag := TAG.match(source, mark)) is not None:
                at = self._tag(source, tag)
            elif re.match(r"</?[a-zA-Z]", source[mark : mark + 3]):
                at = self._after(source, ">", mark)
            else:
                self._text("<")
                at = mark + 1
        self.block = None

    @staticmethod
    def _after(source: str, ending: str, at: int) -> int:
        found = source.find(ending, at)
        return len(source) if found < 0 else found + len(ending)

    def _tag(self, source: str, match: re.Match) -> int:
        closing, name, attributes = match[1], match[2].lower(), match[3]
        at = match.end()
        if name in BLOCKS:
            self.block = None
        if closing:
            self._close(name)
            return at
        if name in BLOCKS:
            self._end_paragraph(name)
        top = self.elements[self.stack[-1]]
        number = len(self.elements)
        reason = 0 if number in self.spared else self._reason(name, attributes, top)
        out = top.out or reason > 0
        self._mark(name, out)
        if name == "br" and self.block is not None:
            self.block.pieces.append(" ")
        if name in VOID:
            return at
        inside = top.inside or name in ("article", "main")
        labelled = name in ("article", "main")
        self.elements.append(Element(name, self.stack[-1], out, top.link or name == "a", inside, labelled, reason))
        self.depths.setdefault(name, []).append(len(self.stack))
        if name in BLOCKS:
            self.block_depths.append(len(self.stack))
        self.stack.append(number)
        if name in RAW and not attributes.rstrip().endswith("/"):
            ending = re.compile(f"</{name}", re.IGNORECASE).search(source, at)
            at = len(source) if ending is None else ending.start()
        return at

    def _reason(self, name: str, attributes: str, top: Element) -> int:
        if (name in LEFT_OUT and name != "form") or (name == "header" and not top.inside):
            return HARD
        if not attributes or name in ("html", "body", "article", "main"):
            return HARD if name == "article" and "comment" in attributes.lower() else NAMED if name == "form" else 0
        lower = attributes.lower()
        if "hidden" in lower and re.search(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true", lower):
            return HARD
        if "display" in lower and re.search(r"display\s*:\s*none", lower):
            return HARD
        found = NAMED if name == "form" else 0
        for attribute in ATTRIBUTE.finditer(attributes):
            key, value = attribute[1].lower(), attribute[2] or attribute[3] or attribute[4] or ""
            if key == "role" and value.strip().lower() in ROLES_LEFT_OUT:
                found = max(found, NAMED)
            if key in ("class", "id"):
                parts = {part.lower() for part in NAME_PART.findall(value)}
                if parts & READER_NAMES or any(part.startswith("comment") for part in parts):
                    return READERS
                if parts & NAMES_LEFT_OUT or ("header" in parts and not top.inside):
                    found = max(found, NAMED)
                elif any(part.startswith(NAME_STARTS) or part.endswith(NAME_ENDS) for part in parts):
                    found = max(found, NAMED)
        return found

    def _cut(self, depth: int) -> None:
        """Closes the open elements from a depth on."""
        for number in self.stack[depth:]:
            self.depths[self.elements[number].tag].pop()
        del self.stack[depth:]
        while self.block_depths and self.block_depths[-1] >= depth:
            self.block_depths.pop()

    def _innermost(self, name: str) -> int:
        depths = self.depths.get(name)
        return depths[-1] if depths else 0

    def _close(self, name: str) -> None:
        depth = self._innermost(name)
        border = 0 if name in ("table", "body", "html") else max(self._innermost("table"), self._innermost("body"))
        if depth > 0 and depth >= border:
            self._mark(name, self.elements[self.stack[depth]].out)
            self._cut(depth)

    def _end_paragraph(self, name: str) -> None:
        """A block ends an open paragraph, a list item the one before it."""
        if self.block_depths:
            tag = self.elements[self.stack[self.block_depths[-1]]].tag
            if tag == "p" or (tag == name and name in ("li", "dt", "dd", "td", "tr", "option")):
                self._cut(self.block_depths[-1])

    def _mark(self, name: str, out: bool) -> None:
        feature = "tag out" if out else f"tag {name}" if name in BLOCKS or name in ("a", "br", "b", "i", "span", "img") else "tag"
        self.row.append((feature, 1, self.stack[-1]))

    def _text(self, raw: str) -> None:
        top = self.elements[self.stack[-1]]
        if self.block is None and raw.isspace():
            return
        text = html_entities.unescape(raw) if "&" in raw else raw
        words = len(text.split())
        top.words += 0 if top.link else words
        if self.block is None or self.block.out != top.out:
            # Boilerplate inside a block (a hidden span, a share link) is left out of its text.
            if self.block is not None and top.out:
                return
            self.block = Block(self.stack[-1], top.out, first=len(self.row))
            self.blocks.append(self.block)
        self.block.pieces.append(text)
        if words:
            self.block.words += words
            self.block.links += words if top.link else 0
            self.block.last = len(self.row)
            self.row.append(("word out" if top.out else "word link" if top.link else f"word {self._around()}", words, self.stack[-1]))

    def _around(self) -> str:
        """The innermost enclosing block's tag."""
        return self.elements[self.stack[self.block_depths[-1]]].tag if self.block_depths else ""

    def above(self, number: int) -> list[int]:
        """An element and all around it, innermost first."""
        found = []
        while number >= 0:
            found.append(number)
            number = self.elements[number].parent
        return found


def feature_counts(page: Page) -> dict[str, list[int]]:
    """Features inside and outside the only article or main element; empty without one."""
    marked = [k for k, e in enumerate(page.elements) if e.labelled and not e.out]
    inner = [k for k in marked if page.elements[k].tag == "article"] or marked
    if len(inner) != 1:
        return {}
    counts: dict[str, list[int]] = {}
    for feature, n, number in page.row:
        counts.setdefault(feature, [0, 0])[0 if page.below(number, inner[0]) else 1] += n
    return counts


def learn_weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights from all labelled pages of the table; the number of features is bounded by the known tags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in in_chunks(batches, "html"):
            for source in column_of(batch, "html").to_pylist():
                for feature, (a, b) in feature_counts(Page(source or "")).items():
                    inside[feature] += a
                    outside[feature] += b
        names = sorted(inside | outside)
        yield pa.RecordBatch.from_pydict(
            {"feature": names, "a": [inside[x] for x in names], "b": [outside[x] for x in names]},
            pa.schema([("feature", pa.string()), ("a", pa.int64()), ("b", pa.int64())]),
        )

    counts = pages.select(F.col(html_col).alias("html")).mapInArrow(run, "feature string, a long, b long")
    weights = dict(DEFAULT_WEIGHTS)
    for feature, a, b in counts.groupBy("feature").agg(F.sum("a"), F.sum("b")).collect():
        inside = (a + 1) / (a + b + 2)
        weights[feature] = inside if feature.startswith("word") else -TAG_COST * (1 - inside) - 0.1
    return weights


def best_region(page: Page, weights: dict[str, float]) -> tuple[int, int]:
    """Start and end of the row's contiguous part with the highest sum."""
    best, low, high, total, start = 0.0, 0, 0, 0.0, 0
    for k, (feature, n, _) in enumerate(page.row):
        weight = weights.get(feature)
        if weight is None:
            weight = weights["word"] if feature.startswith("word") else weights["tag"]
        if total <= 0:
            total, start = 0.0, k
        total += n * weight
        if total > best:
            best, low, high = total, start, k + 1
    return low, high


def main_text(source: str | None, weights: dict[str, float]) -> str:
    """The page's main text, blocks in page order joined by line feeds."""
    page = Page(source or "")
    low, high = best_region(page, weights)
    core = [b for b in page.blocks if b.words and not b.out and b.first < high and b.last >= low]
    if not core:
        return ""
    holder = _holder(page, core)
    region = {id(b) for b in core}
    out = []
    for block in page.blocks:
        if block.out or not block.words or not page.below(block.parent, holder):
            continue
        if id(block) in region or not _is_menu(page, block) or page.elements[holder].tag == "article":
            out.append(" ".join("".join(block.pieces).split()))
    return "\n".join(out)


def _is_menu(page: Page, block: Block) -> bool:
    """Mostly links, and not a sentence of its own: a paragraph may be one link."""
    number = block.parent
    while number > 0 and page.elements[number].tag not in BLOCKS:
        number = page.elements[number].parent
    return 2 * block.links > block.words and page.elements[number].tag not in SENTENCES


def _holder(page: Page, core: list[Block]) -> int:
    """The element that the region belongs to: the article around it, or the smallest container with nearly all of its words."""
    words, blocks, others = ([0] * len(page.elements) for _ in range(3))
    for block in core:
        words[block.parent] += block.words
    for block in page.blocks:
        if block.words and not block.out:
            blocks[block.parent] += 1
            others[block.parent] += page.elements[block.parent].tag not in ("h1", "h2", "p") or 2 * block.links > block.words
    for number in range(len(page.elements) - 1, 0, -1):
        for sums in (words, blocks, others):
            sums[page.elements[number].parent] += sums[number]
    total = sum(b.words for b in core)
    around = page.above(max(k for k, n in enumerate(words) if n >= KEPT_SHARE * total))
    for tag in ("article", "main"):
        found = [k for k in around if page.elements[k].tag == tag]
        if found:
            return found[-1] if tag == "article" else found[0]
    holder = next(k for k in around if k == 0 or page.elements[k].tag in CONTAINERS)
    # A heading next to the container belongs to it.
    while holder > 0:
        parent = page.elements[holder].parent
        if blocks[parent] == blocks[holder] or others[parent] > others[holder]:
            break
        holder = parent
    return holder


def extract(pages: DataFrame, weights: dict[str, float], *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every whole page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, "html"):
            texts = [main_text(source, weights) for source in column_of(batch, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, "page_id"), column_of(batch, "url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return rows.mapInArrow(run, f"{kinds}, text string, n_chars long")
