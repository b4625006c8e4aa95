"""Main text of web pages: flat text blocks classified by a decision tree.

A page is read once, by one cursor, as a stream of tags and text (no tree is built, and the time taken grows with the
page's length alone). Quotes delimit a value only behind an equals sign, as in HTML; one that never closes delimits
nothing. Block-level tags end a text block. A block has its number of words and link density and those of its
neighbours, whether it is a heading or a list item or ends like a sentence, and what it lies in: articles (by element or role), landmarks
(menus, footers, sidebars; headers outside an article; more weakly forms and dialogs), containers that hold reader comments, and
containers whose class or id hints at boilerplate. Hints are weak evidence: they count only below the nearest
article, and a name that has other words beside the hinting one counts half. A decision tree (Gini, grown here) trained
on the labelled table in ``pages_table`` keeps or drops each block.

Null pages count as empty and give an empty text; an empty table gives no rows, and repeated rows are each a row. Very long
pages are read whole. Scripts, styles, titles, text areas, frames (iframe) and comments
are left out, to the end of the page where they are not closed. Pictures, players, buttons, selections, templates and what else is in
``_HIDDEN`` are left out where they are closed; one that is not, or that ends in ``/>``, hides nothing. Formulas (math)
are text, and so is a last tag that the page's end cuts off. White space includes the no-break space. Nothing is cut. The output column
is replaced where the input has it; all others are kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pages_table import pages

_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>))"""
_NAME = r"[^\s/>][^\s/>=]*+"
_TAG = re.compile(rf"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_NAME}(?:\s*+=\s*+{_VALUE})?+)*+)>""")
_LEAD = re.compile(r"</?[a-zA-Z]")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(rf"""({_NAME})(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+""")
# Elements of HTML.
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in ("script", "style", "title", "textarea", "iframe")}  # their content is no markup
_HIDDEN = frozenset("noscript template svg object select button canvas audio video".split())
_NESTING = frozenset("noscript template svg object".split())  # the others end where the next of their name begins
_BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup option p pre search section summary table tbody td"
    " tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_OPEN = _BLOCK - _VOID - _HEADING - frozenset("p li dd dt td th tr option optgroup".split())
_CONTENT, _LANDMARK, _SOFT = frozenset(["article", "main"]), frozenset("nav aside footer menu".split()), frozenset("form dialog search".split())
# Words of class, id and role that hint at boilerplate, by themselves or beside others; those that say what a hinted
# box is; those of reader comments; those that say that a page has or lacks something.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert alerts popup modal overlay sidebar"
    " nav navbar navigation menu breadcrumb breadcrumbs toolbar topbar masthead footer copyright contentinfo complementary social share sharing related recommended"
    " newsletter subscribe subscription signup login pagination pager widget".split()
)
_MAY = frozenset("side rail header foot recommendations register search form tags legal disclaimer skip promotion promoted discussion teaser".split())
_BOX = frozenset(
    "box wrapper wrap container section block list area top bottom left right site global inner outer item items title text link links button buttons bar panel group"
    " main page row col unit slot article articles post posts stories reading more topics icon icons enabled email print twitter facebook linkedin whatsapp".split()
)
_READER_BOX = _BOX | frozenset("user reader readers thread body content author meta form count".split())
_READERS = frozenset("comment comments disqus replies respond".split())
_ABOUT, _LACKS = frozenset("has no with without is js".split()), frozenset("free less none off hidden".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

FEATURES = (
    "words", "link_density", "words_before", "density_before", "words_after", "density_after", "words_around",
    "in_article", "boxed", "outside", "heading", "item", "ends",
)


@dataclass(slots=True)
class Block:
    text: str
    start: int
    words: int
    density: float
    article: bool
    landmark: int
    hint: int
    readers: bool
    heading: bool
    item: bool


class Tag(NamedTuple):
    start: int
    end: int  #: with the content, if that is no markup
    name: str  #: lower case; empty for comments, declarations and elements whose content is left out
    closing: bool
    attributes: str


def tags(page: str) -> Iterator[Tag]:
    """The page's tags in order. What is between them is text."""
    at, end, whole = 0, len(page), True
    while True:
        at = page.find("<", at)
        if at < 0 or at + 1 >= end:
            return
        if not _LEAD.match(page, at):
            if page[at + 1] not in "!?/":
                at += 1
                continue
            if page.startswith("<!--", at):
                stop = at + 4 if page.startswith((">", "->"), at + 4) else page.find("-->", at + 4)
                stop = end if stop < 0 else page.find(">", stop) + 1
            else:
                stop = page.find(">", at) + 1
                if not stop:
                    return
            yield Tag(at, stop, "", False, "")
            at = stop
            continue
        m = _TAG.match(page, at) if whole else None
        if m is None:
            whole = False  # values that swallow the rest of the page delimit nothing
            m = _LOOSE.match(page, at)
            if m is None:
                return  # no tag ends any more
        name, stop = m[2].lower(), m.end()
        if not m[1] and name in _RAW:
            found = _RAW[name].search(page, stop)
            stop = page.find(">", found.end()) + 1 or end if found else end
            yield Tag(at, stop, "", False, "")
        else:
            yield Tag(at, stop, name, bool(m[1]), m[3])
        at = stop


def marks(attributes: str) -> tuple[int, bool, bool]:
    """How strongly class, id and role hint at boilerplate (0, 1 or 2), whether they name reader comments, and whether the role is that of an article."""
    hint, readers, content = 0, False, False
    for m in _ATTRIBUTE.finditer(attributes):
        kind = m[1].lower()
        if kind not in ("class", "id", "role"):
            continue
        if kind == "role" and (m[2] or m[3] or m[4] or "").strip().lower() in _CONTENT:
            content = True
        for name in (m[2] or m[3] or m[4] or "").split():
            parts = [p.lower() for p in _PARTS.findall(name)]
            if not parts or parts[0] in _ABOUT or not _LACKS.isdisjoint(parts):
                continue
            if not _READERS.isdisjoint(parts) and all(p in _READERS or p in _READER_BOX for p in parts):
                hint, readers = 2, True
            elif not _NAMES.isdisjoint(parts):
                hint = max(hint, 2 if all(p in _NAMES or p in _BOX for p in parts) else 1)
            elif not _MAY.isdisjoint(parts) or not _READERS.isdisjoint(parts):
                hint = max(hint, 1)
    return hint, readers, content


def _hidden_spans(own: list[Tag]) -> dict[int, int]:
    """Start of each closed hidden element that lies in no other, and its end. One still open where
    a container around it is closed, or another of its name begins (unless they nest), is not closed."""
    spans: dict[int, int] = {}
    if not any(t.name in _HIDDEN for t in own):
        return spans
    stack: list[tuple[str, int]] = []
    open_: dict[str, int] = {}

    def pop() -> tuple[str, int]:
        name, start = stack.pop()
        open_[name] -= 1
        return name, start

    for t in own:
        name = t.name
        if name not in _HIDDEN and name not in _OPEN:
            continue
        if t.closing:
            if open_.get(name):
                while (found := pop())[0] != name:
                    pass
                if name in _HIDDEN:
                    spans[found[1]] = t.end
        elif not (name == "svg" and t.attributes.endswith("/")):
            if name in _HIDDEN and name not in _NESTING and open_.get(name):
                while pop()[0] != name:
                    pass
            stack.append((name, t.start))
            open_[name] = open_.get(name, 0) + 1
    return spans


class _Place(NamedTuple):
    """What lies around: the innermost container, and what it has from those around it."""

    name: str = ""
    article: bool = False
    landmark: int = 0  #: 1 for a form or dialog, 2 for a menu, sidebar, footer or header
    hint: int = 0
    readers: bool = False

    def inside(self, name: str, attributes: str) -> _Place:
        article, landmark, hint, readers = self.article, self.landmark, self.hint, self.readers
        own, of_readers, content = marks(attributes) if attributes and name not in ("body", "html") else (0, False, False)
        if name in _CONTENT or content:
            article, hint, landmark = True, 0, 0 if landmark == 1 else landmark
        else:
            if name in _LANDMARK or name == "header" and not article:
                landmark = 2
            elif name in _SOFT:
                landmark = max(landmark, 1)
            hint = max(hint, own)
        return _Place(name, article, landmark, hint, readers or of_readers)


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    text: list[str] = []
    links: list[str] = []
    places, open_ = [_Place()], dict[str, int]()
    linked, start, heading, item, own_hint, own_readers, last = 0, 0, False, False, 0, False, 0

    def flush() -> None:
        nonlocal text, links
        if text:
            own = " ".join(html.unescape("".join(text)).split())
            if own:
                words = count(own)
                density = min(1.0, count(" ".join(html.unescape("".join(links)).split())) / words) if links else 0.0
                p = places[-1]
                out.append(Block(own, start, words, density, p.article, p.landmark, max(p.hint, own_hint), p.readers or own_readers, heading, item))
            text, links = [], []

    def add(piece: str, at: int) -> None:
        nonlocal start
        if not text:
            start = at
        text.append(piece)
        if linked:
            links.append(piece)

    found = list(tags(page))
    spans = _hidden_spans(found)
    for at, end, name, closing, attributes in found:
        if at < last:  # in a hidden element
            continue
        if at > last:
            add(page[last:at], last)
        last = spans.get(at, end)
        if name == "a":
            linked = 0 if closing else 1
            if links:
                links.append(" ")
        elif name == "br":
            add(" ", at)
        elif name in _BLOCK:
            flush()
            own_hint, own_readers = (0, False) if closing or name in _OPEN or not attributes else marks(attributes)[:2]
            if name in _HEADING:
                heading = not closing
            elif name == "li":
                item = not closing
            elif name in _OPEN:
                heading = item = False
                linked = 0
                if not closing:
                    places.append(places[-1].inside(name, attributes))
                    open_[name] = open_.get(name, 0) + 1
                elif open_.get(name):
                    while (gone := places.pop().name) != name:
                        open_[gone] -= 1
                    open_[name] -= 1
            elif name == "p":
                heading = False
    if last < len(page):
        add(page[last:], last)
    flush()
    return out


def count(own: str) -> int:
    """Words of a block; scripts that do not part words count eight characters as one."""
    return max(own.count(" ") + 1, len(own) // 8) if own else 0


def _boxed(b: Block) -> int:
    return 4 if b.landmark == 2 or b.readers else 3 if b.hint == 2 else 2 if b.landmark else b.hint


def features(own: list[Block]) -> list[tuple]:
    """A row for each block. ``boxed``: 4 in landmarks and among reader comments, 3 in what is named for boilerplate, 2 in forms and dialogs,
    1 in what may be named for boilerplate, else 0; ``words_around``: the longest of the two blocks before and the two behind; ``outside``: the share
    of the page's words that lies in articles, if the block does not."""
    out = []
    total = sum(b.words for b in own) or 1
    share = sum(b.words for b in own if b.article) / total
    for k, b in enumerate(own):
        before, after = own[k - 1] if k else None, own[k + 1] if k + 1 < len(own) else None
        around = max([x.words for x in own[max(0, k - 2) : k] + own[k + 1 : k + 3]], default=0)
        out.append((
            b.words, b.density, before.words if before else 0, before.density if before else 0.0, after.words if after else 0, after.density if after else 0.0,
            around, int(b.article), _boxed(b), 0.0 if b.article else share, int(b.heading), int(b.item), int(b.text[-1] in ".!?…:;\"'»”)。"),
        ))
    return out


#: Fewest blocks of the labelled table in a leaf.
LEAF = 6


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 12):
    """A binary tree by Gini impurity: True or False, or (feature, cut, tree up to the cut, tree above it)."""
    n, share = len(labels), labels.mean() if len(labels) else 0.0
    if depth == 0 or share in (0.0, 1.0):
        return bool(share >= 0.5)
    best = None
    for f in range(rows.shape[1]):
        order = np.argsort(rows[:, f], kind="stable")
        values, kept = rows[order, f], np.cumsum(labels[order])
        at = np.flatnonzero(values[1:] > values[:-1])  # cuts behind these
        at = at[(at + 1 >= LEAF) & (at + 1 <= n - LEAF)]
        if not len(at):
            continue
        left = at + 1.0
        p, q = kept[at] / left, (kept[-1] - kept[at]) / (n - left)
        impurity = left * p * (1 - p) + (n - left) * q * (1 - q)
        k = int(impurity.argmin())
        if best is None or impurity[k] < best[0] - 1e-9:
            best = impurity[k], f, float((values[at[k]] + values[at[k] + 1]) / 2)
    if best is None:
        return bool(share >= 0.5)
    _, f, cut = best
    low = rows[:, f] <= cut
    a, b = grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1)
    return a if a is b and isinstance(a, bool) else (f, cut, a, b)


def keeps(node, row: tuple) -> bool:
    while type(node) is tuple:
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def described(node, indent: str = "") -> str:
    """The tree as text."""
    if type(node) is not tuple:
        return f"{indent}{'keep' if node else 'drop'}\n"
    f, cut, a, b = node
    return f"{indent}{FEATURES[f]} <= {cut:g}\n{described(a, indent + '  ')}{indent}{FEATURES[f]} > {cut:g}\n{described(b, indent + '  ')}"


def labelled(table: list[list[tuple[str, str]]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of pages given as marked fragments."""
    rows, labels = [], []
    for fragments in table:
        page, ends = "", []
        for mark, fragment in fragments:
            ends.append((len(page), mark == "+"))
            page += fragment
        own = blocks(page)
        rows += features(own)
        labels += [next(label for start, label in reversed(ends) if start <= b.start) for b in own]
    return np.array(rows, float), np.array(labels, float)


_trees: list = []


def tree():
    if not _trees:
        _trees.append(grow(*labelled(pages())))
    return _trees[0]


def main_text(page: str | None, root=None) -> str:
    root = tree() if root is None else root
    own = blocks(page or "")
    return "\n\n".join(b.text for b, row in zip(own, features(own), strict=True) if keeps(root, row))


def extract(df: DataFrame, page: str | Column = "html", out: str = "text") -> DataFrame:
    """Add the main text of each page."""
    root = tree()  # grown once, on the driver

    @F.arrow_udf(T.StringType())
    def main_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(x, root) for x in batch.to_pylist()], pa.string())

    return df.withColumn(out, main_texts(page))
