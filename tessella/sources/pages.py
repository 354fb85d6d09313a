"""Web pages to Markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a tag puts before and after its content, and the tags whose text is left out.
LEVELS = {f"h{n}": "\n\n" + "#" * n + " " for n in range(1, 7)}
PARTS = dict.fromkeys("p div section article tr table ul ol pre".split(), "\n\n")
BEFORE = {**LEVELS, **PARTS, "li": "\n- ", "br": "\n", "td": " | ", "th": " | "}
AFTER = {**dict.fromkeys(LEVELS, "\n\n"), **dict.fromkeys([*PARTS, "li", "br"], "\n")}
UNREAD = frozenset("script style noscript head nav footer".split())


class _Events(HTMLParser):
    """(sign, what) of a page in order: + or - and a tag, or = and a text."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.all: list[tuple[str, str]] = []
        self.handle_starttag = lambda tag, attrs: self.all.append(("+", tag))
        self.handle_endtag = lambda tag: self.all.append(("-", tag))
        self.handle_data = lambda text: self.all.append(("=", text))
        self.feed(html)


def to_markdown(html: str) -> str:
    """Headings, items, cells and paragraphs as Markdown; text within unread tags is left out, white space is squeezed."""
    unread, heading, out = 0, False, []
    for sign, what in _Events(html).all:
        if sign == "=":
            out.append("" if unread else what.strip() if heading else re.sub(r"\s+", " ", what))
        elif what in UNREAD:
            unread = max(0, unread + (1 if sign == "+" else -1))
        else:
            out.append((BEFORE if sign == "+" else AFTER).get(what, ""))
            heading = sign == "+" if what in LEVELS else heading
    lines = re.sub(r"[ \t]+\n", "\n", "".join(out))
    return re.sub(r"\n{3,}", "\n\n", lines).strip() + "\n"


def parse_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, markdown of pages (page_id, url, html); a null page is an empty one."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "markdown": b["html"].map(to_markdown)})

    texts = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return texts.mapInPandas(parse, "page_id long, url string, markdown string")
