"""Dictionary result pages to evidence rows (SRC-12, SCL-20, SCL-21)."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexloom.functions import text as tx
from lexloom.functions.similarity import block_similarity

# Where a result page shows its headword, in order of preference.
HEADWORD_PLACES = ("lemma-line", "search-result-headword", "entry-headword", "result-headword", "h1", "h2")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
FUZZY_THRESHOLD = 90.0


def squeeze(text: str) -> str:
    return " ".join(text.split())


class Node:
    __slots__ = ("tag", "attrs", "up", "items")

    def __init__(self, tag: str, attrs: dict, up: "Node | None") -> None:
        self.tag, self.attrs, self.up, self.items = tag, attrs, up, []

    def text(self) -> str:
        """Pieces of text, trimmed and joined by single blanks."""
        parts = (i.text() if isinstance(i, Node) else squeeze(i) for i in self.items)
        return squeeze(" ".join(p for p in parts if p))

    def walk(self) -> Iterator["Node"]:
        for i in self.items:
            if isinstance(i, Node):
                yield i
                yield from i.walk()

    def strings(self) -> Iterator[str]:
        for i in self.items:
            if isinstance(i, Node):
                yield from i.strings()
            else:
                yield i


class Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at)
        self.at.items.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.items.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.up
        if node is not None and node.up is not None:
            self.at = node.up

    def handle_data(self, data):
        self.at.items.append(data)


def heading_above(item: Node) -> str | None:
    """First heading of the nearest section or div that has one, else a heading before the item."""
    block = item.up
    while block is not None:
        if block.tag in ("section", "div"):
            first = next((n for n in block.walk() if n.tag in ("h2", "h3", "h4")), None)
            if first is not None and first.text():
                return first.text()
        block = block.up
    for other in reversed(item.up.items[: item.up.items.index(item)]):
        if isinstance(other, Node) and other.tag in ("h2", "h3", "h4") and other.text():
            return other.text()
    return None


def page_parts(html: str, url: str) -> tuple[list[str], list[str], list[tuple]]:
    """Headword texts in order of preference, all texts, and list items with a link."""
    page = Page()
    page.feed(html)
    nodes = list(page.root.walk())
    heads = []
    for place in HEADWORD_PLACES:
        for n in nodes:
            if n.tag == place or ("-" in place and place in (n.attrs.get("class") or "").split()):
                heads.append(n.text())
    texts = [t for t in (squeeze(s) for s in page.root.strings()) if t]
    items = []
    for n in nodes:
        if n.tag != "li":
            continue
        anchor = next((a for a in n.walk() if a.tag == "a" and a.attrs.get("href") is not None), None)
        if anchor is None:
            continue
        href, title = anchor.attrs["href"].strip(), anchor.text()
        if not title or not href or href.startswith("#") or href.lower().startswith("javascript:"):
            continue
        whole = n.text()
        rest = None if whole == title else whole.replace(title, "", 1).strip(" -–—") or None
        items.append((title, urljoin(url, href), heading_above(n), rest))
    return heads, texts, items


def parse_pages(pages: DataFrame) -> DataFrame:
    """SRC-12: (page_id, url, html) to headword texts, texts and linked list items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for page_id, url, html in zip(frame["page_id"], frame["url"], frame["html"]):
                heads, texts, items = page_parts(html or "", url or "")
                rows.append((page_id, heads, texts, [dict(zip(("title", "link", "section", "snippet"), i)) for i in items]))
            yield pd.DataFrame(rows, columns=["page_id", "heads", "texts", "items"])

    return pages.select("page_id", "url", "html").mapInPandas(
        run,
        "page_id bigint, heads array<string>, texts array<string>, "
        "items array<struct<title:string,link:string,section:string,snippet:string>>",
    )


def form_of(text: Column) -> Column:
    """SCL-20: left of an arrow, or a text of a single word."""
    left = F.regexp_replace(F.substring_index(text, "→", 1), "^[ «»]+|[ «»]+$", "")
    return F.when(F.contains(text, F.lit("→")), F.nullif(left, F.lit(""))).when((text != "") & ~F.contains(text, F.lit(" ")), text)


def matched_form(heads: Column, texts: Column, query: Column) -> Column:
    """SCL-20: first usable headword, else a text that equals the query, else the query."""
    first = F.get(F.filter(F.transform(heads, form_of), lambda x: x.isNotNull()), F.lit(0))
    same = F.get(
        F.filter(F.transform(texts, form_of), lambda x: x.isNotNull() & (tx.normalize_token(x) == tx.normalize_token(query))), F.lit(0)
    )
    return F.coalesce(first, same, tx.strip(query))


def match_class(rows: DataFrame, mode: str) -> DataFrame:
    """SCL-21: exact, normalized or, in fuzzy mode, similar enough; other rows are dropped.

    ``rows`` holds query and matched_form.
    """
    q, form = tx.normalize_token(F.col("query")), tx.normalize_token(F.col("matched_form"))
    out = rows.withColumns({"query_form": q, "normalized_form": form}).where(F.col("normalized_form") != "")
    exact, same = F.col("matched_form") == F.col("query"), F.col("normalized_form") == F.col("query_form")
    if mode != "fuzzy":
        return out.where(exact | same).withColumns({
            "match_type": F.when(exact, "exact").otherwise("normalized"), "match_score": F.lit(100.0),
        })
    scored = out.withColumn("score", F.when(exact | same, F.lit(100.0)).otherwise(block_similarity("query_form", "normalized_form")))
    return scored.where(F.col("score") >= FUZZY_THRESHOLD).withColumns({
        "match_type": F.when(exact, "exact").when(same, "normalized").otherwise("fuzzy"), "match_score": F.col("score"),
    }).drop("score")


def dictionary_results(pages: DataFrame, queries: DataFrame, mode: str = "normalized") -> DataFrame:
    """SRC-12 to evidence: one row per linked list item of a page that matches its query.

    ``queries``: page_id, query.  Equal rows of a page are kept once.
    """
    parsed = parse_pages(pages).join(queries, "page_id")
    named = parsed.withColumn("matched_form", matched_form(F.col("heads"), F.col("texts"), F.col("query"))).drop("heads", "texts")
    rows = match_class(named, mode).select(
        "page_id", "query", "matched_form", "normalized_form", "match_type", "match_score", F.posexplode("items").alias("seq", "i")
    )
    key = ["page_id", "query", "matched_form", F.col("i.title"), F.col("i.link")]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("seq"))
    return rows.withColumn("_k", rank).where(F.col("_k") == 1).select(
        "page_id", "query", "matched_form", "normalized_form", "match_type", "match_score", "seq", F.col("i.title").alias("source_title"),
        F.col("i.link").alias("reference_link"), F.col("i.section").alias("source_subtitle"), F.col("i.snippet").alias("snippet"),
    )
