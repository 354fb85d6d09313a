"""Operator 13: the main text of web pages by composite text density.

Each page is a tree of elements. A node's density is its characters by tag, times a logarithm that falls with the share of
characters and tags in links; a node's sum is that of its children's densities. The node of the largest sum is where the
text is. The least density on the path from body to it is the page's threshold: from that node the choice widens to its
parent as long as what the parent adds is as dense as the threshold, or to the article or main element around it.
Elements that HTML or their names call menus, adverts, notices, forms, comments and the like take no part.

A page is one row and one task's work, in time and memory that grow with its length; nothing is shuffled.

Defined results: null or empty html, and pages without text, give an empty text; a page without tags is its text; unclosed
elements end where their parent ends, a paragraph or list item also where the next begins; an unclosed comment or script
lasts to the end; equal sums go to the node that comes first; repeated rows are extracted each; null ids and urls stay null; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only
from .tokens import batches_of

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!?\?*[^a-zA-Z/\s<>][^<>]*>|<!\w[^>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)(?:>|\Z)", re.S)
#: Elements whose inside is no markup; of these only a text area's would be shown, and it belongs to a form.
RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br button canvas cite code data del dfn em font i iframe img input ins kbd label map mark nobr object q rp rt ruby s samp script select small span strike strong style sub sup svg template time tt u var wbr".split())
#: What a start tag ends: (names that end with it, names that stop the search).
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CLOSED_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never part of an article, by what HTML says they are.
ASIDE = frozenset("nav footer aside form head script style textarea title noscript iframe template select button svg canvas object dialog menu map audio video".split())
#: Words of class, id and role that say the same.
NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion nav navbar navigation menu menubar submenu breadcrumb breadcrumbs sidebar sidebars rail widget widgets footer foot bottombar "
    "masthead topbar cookie cookies consent gdpr notice notices alert popup popover modal overlay newsletter subscribe subscription signup login signin comment comments commentlist disqus reply replies respond feedback share sharing social related "
    "recommended recommendations pagination pager toolbar copyright legal disclaimer skip search complementary contentinfo dialog form tags".split()
)
#: Of these, what holds readers' articles, not the page's.
READERS = frozenset("comment comments commentlist disqus reply replies respond feedback".split())
HEADER = frozenset("header head".split())
NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Page:
    """The tree of a page: lists by node, in page order; node 0 is the page, and texts are (node, text)."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.off, self.named = ["html"], [-1], [False], [""]
        self.texts: list[tuple[int, str]] = []
        self._read(source)

    def _open(self, name: str, attributes: str, parent: int) -> int:
        words: set[str] = set()
        if attributes:
            for found in NAMED.finditer(attributes):
                words.update(w.lower() for w in NAME_WORD.findall(found[1] or found[2] or found[3] or ""))
        kind = "off" if name in ASIDE or (attributes and HIDDEN.search(attributes)) else "readers" if words & READERS else "named" if words & NAMES else "header" if name == "header" or words & HEADER else ""
        if name in ("html", "body", "main") or (name == "article" and kind not in ("off", "readers")):
            kind = ""
        self.tag.append(name)
        self.parent.append(parent)
        self.off.append(kind == "off")
        self.named.append(kind)
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        stack, place = [0], 0
        self.open = Counter({"html": 1})
        for found in iter(lambda: MARKUP.search(source, place), None):
            if found.start() > place:
                self._say(stack[-1], source[place : found.start()])
            place = found.end() if found.end() > place else len(source)
            name = (found[2] or "").lower()
            if not name:
                continue
            if found[1]:
                if name not in ("html", "body"):
                    self._close(stack, name)
                continue
            if name in ("html", "body") and self.open[name]:
                continue
            if name in CLOSED_P and self.open["p"]:
                self._end(stack, {"p"}, {"table", "button"})
            elif name in ENDS:
                self._end(stack, *ENDS[name])
            at = self._open(name, found[3], stack[-1])
            if name == "br" or name not in INLINE:
                self.texts.append((at, " "))
            if name in RAW:
                closing = RAW[name].search(source, place)
                place = closing.end() if closing else len(source)
            elif name not in VOID and not (found[3].endswith("/") and name in ("svg", "path", "use")):
                stack.append(at)
                self.open[name] += 1
        if place < len(source):
            self._say(stack[-1], source[place:])

    def _end(self, stack: list[int], names: set[str], stop: frozenset[str] | set[str]) -> None:
        """Closes the innermost open element of these names, and all inside it, unless one that stops the search is met before."""
        if not any(self.open[name] for name in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            name = self.tag[stack[depth]]
            if name in names:
                self.open.subtract(self.tag[i] for i in stack[depth:])
                del stack[depth:]
                return
            if name in stop:
                return

    def _close(self, stack: list[int], name: str) -> None:
        self._end(stack, {name}, set() if name not in INLINE else CLOSED_P | {"li", "td", "th", "dd", "dt", "body"})

    def _say(self, node: int, text: str) -> None:
        self.texts.append((node, html.unescape(text) if "&" in text else text))


def density(chars: int, tags: int, link_chars: int, link_tags: int, link_share: float) -> float:
    """Characters by tag, scaled by a logarithm of how little of it is links; link_share is that of the whole body. Without links on the page it is the
    plain quotient. e is added in both logarithms, as the published quotient has no bound for short texts on pages of few links."""
    if not chars:
        return 0.0
    plain = chars / max(tags, 1)
    base = log(chars / max(chars - link_chars, 1) * link_chars + link_share * chars + e)
    if base <= 1.0:
        return plain
    return plain * log(max(chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1), 1.0) + e) / log(base + e)


def _left_out(page: Page) -> list[bool]:
    """Which nodes take no part: what HTML calls an aside, what is named one without holding the article, and what lies in these."""
    n = len(page.tag)
    holds_article, holds_title, holds_heading, in_article = [False] * n, [False] * n, [False] * n, [False] * n
    for i in range(n - 1, 0, -1):
        p, name = page.parent[i], page.tag[i]
        holds_title[p] |= holds_title[i] or name in ("main", "h1")
        holds_article[p] |= holds_article[i] or name in ("main", "h1") or (name == "article" and not page.named[i])
        holds_heading[p] |= holds_heading[i] or name in HEADINGS
    out = [False] * n
    for i in range(1, n):
        p, kind = page.parent[i], page.named[i]
        in_article[i] = in_article[p] or page.tag[p] in ("article", "main")
        out[i] = out[p] or page.off[i] or (kind == "readers" and not holds_title[i]) or (kind == "named" and not holds_article[i]) or (kind == "header" and page.tag[i] not in HEADINGS and not (in_article[i] and holds_heading[i]) and not (page.tag[i] != "header" and holds_article[i]))
    return out


def main_text(source: str) -> tuple[str, str, float, float]:
    """Text, path of the chosen node, its sum of densities and the page's threshold."""
    page = Page(source)
    n, parent, tag = len(page.tag), page.parent, page.tag
    out = _left_out(page)
    chars, links, tags, link_tags, in_link = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    for i in range(1, n):
        in_link[i] = in_link[parent[i]] or tag[i] == "a"
    said = [(i, " ".join(t.split())) for i, t in page.texts if not out[i]]
    for i, t in said:
        chars[i] += len(t)
        links[i] += len(t) if in_link[i] else 0
    for i in range(n - 1, 0, -1):
        if not out[i]:
            p = parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (tag[i] == "a")
    body = next((i for i in range(n) if tag[i] == "body"), 0)
    share = links[body] / max(chars[body], 1)
    dense = [0.0 if out[i] else density(chars[i], tags[i], links[i], link_tags[i], share) for i in range(n)]
    sums = [0.0] * n
    for i in range(n - 1, 0, -1):
        sums[parent[i]] += dense[i]
    chosen = max((i for i in range(body, n) if not out[i]), key=lambda i: (sums[i], -i))
    path = [chosen]
    while path[-1] not in (body, 0):
        path.append(parent[path[-1]])
    threshold = min(dense[i] for i in path)
    marked = next((i for i in path if tag[i] == "article"), None) or next((i for i in path if tag[i] == "main"), None)
    if marked is None:
        inside = [i for i in range(n) if not out[i] and tag[i] in ("article", "main") and chars[i]]
        marked = max(inside, key=lambda i: (sums[i], chars[i], -i)) if inside and chosen in (body, 0) else None
    if marked is None:
        marked = chosen
        for up in path[1:]:
            more = density(chars[up] - chars[marked], tags[up] - tags[marked], links[up] - links[marked], link_tags[up] - link_tags[marked], share)
            if up in (body, 0) or more < threshold:
                break
            marked = up
    return _blocks(page, out, marked), "/".join(tag[i] for i in reversed(_up(page, marked))), sums[marked], threshold


def _up(page: Page, i: int) -> list[int]:
    path = [i]
    while path[-1] > 0:
        path.append(page.parent[path[-1]])
    return path


def _blocks(page: Page, out: list[bool], root: int) -> str:
    """The text under root and of the heading right before it, a line for each block."""
    n, parent, tag = len(page.tag), page.parent, page.tag
    inside, block = [False] * n, [0] * n
    before = next((i for i in range(root - 1, 0, -1) if parent[i] == parent[root] and not out[i]), 0) if root else 0
    for i in range(n):
        inside[i] = i == root or (i == before and before > 0 and tag[i] in ("h1", "h2")) or (i > 0 and inside[parent[i]])
        block[i] = block[parent[i]] if i and tag[i] in INLINE else i
    # every block has a blank of its own at its start, so that even an empty one cuts the block around it
    lines: list[list[str]] = []
    last = -1
    for i, t in page.texts:
        if block[i] != last:
            last = -1
            if out[i] or not inside[i] or not t.strip():
                continue
            lines.append([])
            last = block[i]
        if inside[i] and not out[i]:
            lines[-1].append(t)
    kept = (" ".join("".join(line).split()) for line in lines)
    return "\n".join(line for line in kept if line)


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, and of the node chosen: path, density_sum and threshold; a row for each row of pages."""
    id_type, url_type = (pages.schema[c].dataType.simpleString() if c in pages.columns else "string" for c in ("page_id", "url"))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 2):
            found = [main_text(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.float64(), pa.float64())))], names=["page_id", "url", "text", "path", "density_sum", "threshold"])

    read = only(pages, "page_id", "url", source).withColumn(source, F.coalesce(source, F.lit("")))
    found = read.mapInArrow(extracted, f"page_id {id_type}, url {url_type}, text string, path string, density_sum double, threshold double")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path", "density_sum", "threshold")
