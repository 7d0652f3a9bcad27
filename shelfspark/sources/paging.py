"""Page links of listings, and the loop that follows them."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import urls
from shelfspark.session import materialize

# Classes of page containers in order of preference, marks of the current page, texts of the link to the next one.
CONTAINER_CLASSES = ("pagination", "pager", "page-numbers", "pages")
CONTAINER_PARTS = ("pagination", "pager", "page-num")
CURRENT_CLASSES = frozenset(("current", "active", "selected"))
NEXT_TEXTS = frozenset(("next", ">", "»", "›"))
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Pages(HTMLParser):
    """Links and marks of the current page inside each page container; texts are those of whole elements."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[dict] = []
        self.containers: list[dict] = []

    @staticmethod
    def _rank(tag: str, attrs: dict[str, str]) -> int | None:
        names = attrs.get("class", "").split()
        for i, name in enumerate(CONTAINER_CLASSES):
            if name in names:
                return i
        for i, part in enumerate(CONTAINER_PARTS):
            if part in attrs.get("class", ""):
                return 4 + i
        if tag == "nav" and "pagination" in attrs.get("aria-label", ""):
            return 7
        return 8 if tag == "nav" and attrs.get("role") == "navigation" else None

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        node = {"tag": tag, "text": [], "href": attrs.get("href") if tag == "a" else None, "within": [n["box"] for n in self.open if "box" in n]}
        node["current"] = bool(CURRENT_CLASSES & set(attrs.get("class", "").split())) or attrs.get("aria-current") == "page"
        if (rank := self._rank(tag, attrs)) is not None:
            node["box"] = {"rank": rank, "links": [], "current": []}
            self.containers.append(node["box"])
        for box in node["within"]:
            if node["current"]:
                box["current"].append(node["text"])
            if node["href"] is not None:
                box["links"].append((node["href"], node["text"]))
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        for node in self.open:
            node["text"].append(data.strip())


def numbered_link(html: str | None) -> str | None:
    """The address behind the current page in the first page container of the best kind, or behind its link to the next page; null if none."""
    if not html:
        return None
    parser = _Pages()
    parser.feed(html)
    if not parser.containers:
        return None
    box = min(parser.containers, key=lambda c: c["rank"])
    numbers = [int(t) for t in ("".join(x) for x in box["current"]) if t.isdecimal()]
    for href, parts in box["links"]:
        text = "".join(parts)
        if numbers and text.isdecimal() and int(text) == numbers[0] + 1 or text.lower() in NEXT_TEXTS:
            return href
    return None


def _numbered(html: Column) -> Column:
    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(numbered_link)

    return found(html)


def numbered_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with ``numbered``, the absolute address of the next numbered page; null if none."""
    found = pages.withColumn("_href", _numbered(F.col(html)))
    return found.withColumn("numbered", F.when(F.col("_href").isNotNull(), urls.absolute_url(F.col("_href"), F.col(url)))).drop("_href")


def next_addresses(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with ``next_url``: by page parameter, by path, by a link to the next page, by numbered pages, by offset; null if none."""
    address = F.col(url)
    linked = pages.withColumn("_href", F.coalesce(urls.rel_next(F.col(html)), _numbered(F.col(html))))
    linked = linked.withColumn("_to", F.when(F.col("_href").isNotNull(), urls.absolute_url(F.col("_href"), address)))
    ways = F.coalesce(urls.next_query_page(address), urls.next_path_page(address), F.col("_to"), urls.next_offset_page(address))
    return linked.withColumn("next_url", ways).drop("_href", "_to")


def follow_pages(
    starts: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    items: Callable[[DataFrame], DataFrame],
    ceiling: int = urls.PAGE_CEILING,
    stop: Callable[[], bool] | None = None,
) -> DataFrame:
    """(start, page_num, item_url) of every listing: all listings advance together, a page a round, at most ``ceiling`` rounds.

    ``starts`` has a column ``url``; ``fetch`` gives (url, html) for (url), ``items`` (url, item_url) for pages. A listing ends
    with a page that can't be fetched, has no items or none that are new to it, has no next address, or whose next address is its own; ``stop`` ends
    all. A null address is no listing.
    """
    frontier = materialize(starts.select(F.col("url").alias("start"), "url").filter("url is not null").distinct())
    known = materialize(frontier.select("start", F.lit(0).alias("page_num"), F.lit("").alias("item_url")).limit(0))
    for number in range(1, ceiling + 1):
        if stop and stop():
            break
        pages = materialize(fetch(frontier.select("url").distinct()).filter("html is not null"))
        listed = frontier.join(items(pages).select("url", "item_url").filter("item_url is not null").distinct(), "url")
        fresh = listed.join(known.select("start", "item_url"), ["start", "item_url"], "left_anti").select("start", F.lit(number).alias("page_num"), "item_url")
        fresh = materialize(fresh.distinct())
        known = materialize(known.unionByName(fresh))
        onward = next_addresses(pages).select("url", "next_url").filter("next_url is not null and next_url <> url")
        frontier = materialize(frontier.join(fresh.select("start").distinct(), "start", "left_semi").join(onward, "url").select("start", F.col("next_url").alias("url")))
        if not frontier.limit(1).count():
            break
    return known
