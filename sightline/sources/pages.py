"""Advisory pages: HTML to node rows, then headings, table rows and links as relational steps."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sightline.operators.filters import vendor_scope

CVE = r"CVE-\d{4}-\d{4,}"
NODE_SCHEMA = "page_id string, url string, pos int, tag string, text string, href string, block int, row int, cell int"
NODES_A_BATCH = 20_000  # rows handed on at once: the pages of an Arrow batch may hold millions
_BLOCKS = {"h1", "h2", "h3", "p", "li", "td", "th", "title"}
_VOID = {"br", "img", "meta", "link", "hr", "input", "wbr", "source", "area", "base", "col", "embed", "track", "param"}


class _Nodes(HTMLParser):
    """Block texts and links of one page in document order; tables are numbered by block, row and cell."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.open: list[int] = []
        self.table = self.row = self.cell = 0
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self.table, self.row, self.cell = self.table + 1, 0, 0
        elif tag == "tr":
            self.row, self.cell = self.row + 1, 0
        elif tag == "a":
            href = dict(attrs).get("href")
            if href:
                self.nodes.append([len(self.nodes), "a", "", href, self.table, self.row, self.cell])
        if tag in _BLOCKS:
            if tag in ("td", "th"):
                self.cell += 1
            self._close(tag)
            cell = self.cell if tag in ("td", "th") else 0
            self.nodes.append([len(self.nodes), tag, "", None, self.table if cell else 0, self.row if cell else 0, cell])
            self.open.append(len(self.nodes) - 1)

    def _close(self, tag):
        # A paragraph or item ends where the next block of its kind begins.
        if self.open and self.nodes[self.open[-1]][1] in ("p", "li") and tag in ("p", "li", "h1", "h2", "h3"):
            self.open.pop()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in _BLOCKS:
            for depth in range(len(self.open) - 1, -1, -1):
                if self.nodes[self.open[depth]][1] == tag:
                    del self.open[depth:]
                    break

    def handle_data(self, data):
        if self.skip or not data.strip():
            return
        for index in self.open:
            text = self.nodes[index][2]
            self.nodes[index][2] = f"{text} {data.strip()}" if text else data.strip()


def _node_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for page, url, html in zip(batch["page_id"], batch["url"], batch["html"]):
            parser = _Nodes()
            parser.feed(html or "")
            parser.close()
            rows += [(page, url, pos, tag, text, href, block, row, cell) for pos, tag, text, href, block, row, cell in parser.nodes]
            if len(rows) >= NODES_A_BATCH:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        yield pd.DataFrame(rows, columns=columns)


def page_nodes(pages: DataFrame) -> DataFrame:
    """Node rows of pages (page_id, url, html)."""
    return pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html").mapInPandas(_node_batches, NODE_SCHEMA)


def with_headings(nodes: DataFrame) -> DataFrame:
    """Nodes with the nearest heading before them, per level (h2, h3) and over both.

    The window holds the nodes of one page.
    """
    before = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    level = lambda *tags: F.last(F.when(F.col("tag").isin(*tags), F.col("text")), ignorenulls=True).over(before)
    return nodes.withColumn("h2", level("h2")).withColumn("h3", level("h3")).withColumn("heading", level("h2", "h3"))


def mentions(pages: DataFrame) -> DataFrame:
    """CVE ids mentioned in paragraphs and list items, with the component named by the heading before them."""
    rows = with_headings(page_nodes(pages)).where(F.col("tag").isin("p", "li") & F.col("text").rlike(CVE))
    ids = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(CVE), F.lit(0)))).alias("id")
    low = F.lower("text")
    return rows.select("page_id", "url", "pos", F.coalesce("heading", F.lit("Unknown component")).alias("component"), "text", ids).groupBy(
        "page_id", "url", "id", "component"
    ).agg(
        F.min("pos").alias("first_pos"),
        F.bool_or(low.contains("may have been exploited") | low.contains("actively exploited")).alias("exploitation_reported"),
    )


def bulletin_rows(pages: DataFrame) -> DataFrame:
    """CVE table rows: cells named by the header row, patch level from h2, component from h3."""
    nodes = with_headings(page_nodes(pages))
    cells = nodes.where(F.col("tag").isin("td", "th") & (F.col("cell") > 0))
    head = F.lower("text")
    first = cells.groupBy("page_id", "block").agg(F.min("row").alias("row"))
    headers = cells.join(first, ["page_id", "block", "row"]).select("page_id", "block", "cell", head.alias("header"))
    named = cells.join(headers, ["page_id", "block", "cell"], "left")
    pick = lambda name: F.max(F.when(F.col("header") == name, F.col("text")))
    rows = named.groupBy("page_id", "url", "block", "row").agg(
        F.max(F.when(F.col("cell") == 1, F.col("text"))).alias("first"), pick("updated aosp versions").alias("versions"),
        pick("severity").alias("severity"), F.max("h3").alias("component"), F.max("h2").alias("patch_heading"),
    )
    component = F.coalesce("component", F.lit(""))
    return rows.where(F.col("first").rlike(CVE)).select(
        "page_id", F.explode(F.array_distinct(F.regexp_extract_all("first", F.lit(CVE), F.lit(0)))).alias("id"), component.alias("component"),
        vendor_scope(component).alias("vendor_scope"), F.regexp_extract(F.coalesce("patch_heading", F.lit("")), r"20\d\d-\d\d-\d\d", 0).alias("fixed_patch_level"),
        F.coalesce("versions", F.lit("")).alias("updated_versions"), F.lower(F.coalesce("severity", F.lit("unknown"))).alias("severity"),
    ).dropDuplicates(["page_id", "id", "component", "fixed_patch_level", "updated_versions"])


def catalogue_tests(pages: DataFrame) -> DataFrame:
    """Test ids of catalogue tables with their status."""
    cells = page_nodes(pages).where("cell > 0")
    rows = cells.groupBy("page_id", "block", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell", "text"))), lambda c: c["text"]), " ").alias("text"))
    identifier = F.regexp_extract("text", r"MASTG-TEST-\d{4}", 0)
    return rows.where(identifier != "").select(
        "page_id", identifier.alias("id"),
        F.when(F.contains("text", F.lit("deprecated")), "deprecated").when(F.contains("text", F.lit("placeholder")), "placeholder").otherwise("current").alias("status"),
    )


def discovered_links(pages: DataFrame, host: str, path_pattern: str, first: int) -> DataFrame:
    """The first distinct links of each page below a host whose path matches; relative ones are resolved."""
    from sightline.scale import top_k

    links = page_nodes(pages).where("tag = 'a'")
    base = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    absolute = F.when(F.col("href").rlike("^https?://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(base, "href"))
    rows = links.withColumn("link", F.regexp_replace(absolute, "#.*$", "")).where(
        (F.try_parse_url("link", F.lit("HOST")) == host) & F.coalesce(F.try_parse_url("link", F.lit("PATH")), F.lit("")).rlike(path_pattern)
    )
    distinct = rows.groupBy("page_id", "link").agg(F.min("pos").alias("pos"))
    return top_k(distinct, ["page_id"], [F.col("pos")], first).select("page_id", "link", "rank")
