"""HTML pages as rows: nodes, visible text, links, headings and table grids.

Parsing keeps state from tag to tag, so it runs in Python, a batch of pages at a time in the
task that reads them; the projections above it are column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(("script", "style"))
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
STOPS = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "p": {"td", "th", "li", "div", "article", "body"}}
BLOCKS = frozenset("p div li tr table ul ol h1 h2 h3 h4 h5 h6 article section nav header footer body blockquote pre title".split())
MOST_SPAN, MOST_DEPTH, MOST_NODES = 64, 256, 200_000


class Tree(HTMLParser):
    """Nodes as (id, parent, name, attributes, text); text nodes are named ``#text``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple[int, int, str, dict, str]] = []
        self.open: list[tuple[int, str]] = []

    def _add(self, name: str, attrs: dict, text: str) -> int:
        if len(self.nodes) >= MOST_NODES:
            raise ValueError(f"more than {MOST_NODES} nodes")
        self.nodes.append((len(self.nodes), self.open[-1][0] if self.open else -1, name, attrs, text))
        return len(self.nodes) - 1

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:  # an open element of these kinds ends here, if nothing in between stops it
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][1] in CLOSES[tag]:
                    del self.open[k:]
                    if tag != "tr":
                        break
                elif self.open[k][1] in STOPS[tag]:
                    break
        at = self._add(tag, {k: v or "" for k, v in attrs}, "")
        if tag not in VOID and len(self.open) < MOST_DEPTH:
            self.open.append((at, tag))

    def handle_startendtag(self, tag, attrs):
        self._add(tag, {k: v or "" for k, v in attrs}, "")

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][1] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self._add("#text", {}, data)


def parse(html: str | None) -> list[tuple[int, int, str, dict, str]]:
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    return tree.nodes


def visible_text(nodes: list[tuple[int, int, str, dict, str]]) -> str:
    """Text outside scripts and styles; blocks and line breaks part lines."""
    hidden, out, block = set(), [], {}
    for at, parent, name, _, text in nodes:
        if parent in hidden or name in RAW or name == "head":
            hidden.add(at)
            continue
        inside = at if name in BLOCKS else block.get(parent, -1)
        if name == "br" or (out and inside != out[-1][0]):
            out.append((inside, ""))
        block[at] = inside
        if name == "#text":
            out.append((inside, text))
    lines, last = [], None
    for inside, text in out:
        if last == inside and text and lines:
            lines[-1] += text
        else:
            lines.append(text)
        last = inside
    return "\n".join(line for line in (" ".join(x.split()) for x in lines) if line)


def table_grids(nodes: list[tuple[int, int, str, dict, str]]) -> list[tuple[int, int, int, int, str]]:
    """(table, row, column, colspan, text) of each cell; cells belong to their nearest table."""
    owner, rows, columns, cells, cell_of = {}, {}, {}, [], {}
    row_of: dict[int, int] = {}
    for at, parent, name, attrs, text in nodes:
        owner[at] = at if name == "table" else owner.get(parent, -1)
        cell_of[at] = cell_of.get(parent, -1)
        table = owner.get(parent, -1)
        if name == "tr" and table >= 0:
            rows[table] = rows.get(table, -1) + 1
            row_of[table] = rows[table]
            columns[table] = 0
        elif name in ("td", "th") and table in row_of:
            span = min(max(int(attrs.get("colspan", "1")) if attrs.get("colspan", "1").isdigit() else 1, 1), MOST_SPAN)
            cell_of[at] = len(cells)
            cells.append([table, row_of[table], columns[table], span, ""])
            columns[table] += span
        elif name == "#text" and cell_of[at] >= 0:
            cells[cell_of[at]][4] += text
    numbers = {t: k for k, t in enumerate(sorted({c[0] for c in cells}))}
    return [(numbers[t], r, c, s, " ".join(x.split())) for t, r, c, s, x in cells]


def nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per node: page, node, parent, name, attrs, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page, html in zip(batch["page"], batch["html"], strict=True):
                yield pd.DataFrame([(page, *n) for n in parse(html)], columns=["page", "node", "parent", "name", "attrs", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(html_col).alias("html"))
    return rows.mapInPandas(run, "page long, node int, parent int, name string, attrs map<string,string>, text string")


def text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"], "text": [visible_text(parse(h)) for h in batch["html"]]})

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInPandas(run, "page_id long, text string")


def links(pages: DataFrame) -> DataFrame:
    """page, node, href of every anchor with an address."""
    return nodes(pages).filter((F.col("name") == "a") & F.col("attrs")["href"].isNotNull()).select("page", "node", F.col("attrs")["href"].alias("href"))


def headings(nodes: list[tuple[int, int, str, dict, str]]) -> list[tuple[int, int, str]]:
    """(node, level, title) of each heading; the title is all text below it."""
    heading: dict[int, int] = {}
    said: dict[int, list] = {}
    for at, parent, name, _, text in nodes:
        if len(name) == 2 and name[0] == "h" and name[1] in "123456":
            heading[at] = at
            said[at] = [int(name[1]), ""]
        elif parent in heading:
            heading[at] = heading[parent]
            if name == "#text":
                said[heading[at]][1] += text
    return [(at, level, " ".join(title.split())) for at, (level, title) in said.items()]


def outline(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page, node, level, title of every heading."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page, html in zip(batch["page"], batch["html"], strict=True):
                yield pd.DataFrame([(page, *h) for h in headings(parse(html))], columns=["page", "node", "level", "title"])

    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(html_col).alias("html"))
    return rows.mapInPandas(run, "page long, node int, level int, title string")


def grids(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page, table, row, column, colspan, text of every table cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page, html in zip(batch["page"], batch["html"], strict=True):
                yield pd.DataFrame([(page, *c) for c in table_grids(parse(html))], columns=["page", "table", "row", "column", "colspan", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(html_col).alias("html"))
    return rows.mapInPandas(run, "page long, table int, row int, column int, colspan int, text string")
