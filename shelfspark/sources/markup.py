"""Records inside HTML: JSON-LD, meta tags, script state, product cards, links.

Regular parts are native. What isn't regular (matching braces, the element tree, sweeps of nested JSON in document order)
runs in Arrow-batched functions over the standard library's parser.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.scalar import filled, first_filled, html_to_text, normalize_price, stock_from_address
from shelfspark.functions.urls import absolute_url, canonical_url, is_product_path, netloc, path

JSON_LD_BODY = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"
#: Levels of lists and graphs that JSON-LD is searched through.
GRAPH_LEVELS = 3


def json_ld_nodes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, place, node): objects of all JSON-LD scripts, through lists and ``@graph``; invalid scripts have none."""
    scripts = pages.select(F.col(url).alias("url"), F.posexplode(F.regexp_extract_all(html, F.lit(JSON_LD_BODY), F.lit(1))).alias("script", "body"))
    level = scripts.select("url", F.array("script").alias("place"), F.try_parse_json("body").alias("v")).filter("v is not null")
    found = []
    for _ in range(GRAPH_LEVELS):
        kind = F.schema_of_variant("v")
        objects = level.filter(kind.startswith("OBJECT"))
        found.append(objects.select("url", "place", F.col("v").alias("node")))
        inner = F.coalesce(F.try_variant_get("v", '$["@graph"]', "array<variant>"), F.when(kind.startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")))
        level = level.select("url", "place", F.posexplode(inner).alias("i", "w")).select("url", F.concat("place", F.array("i")).alias("place"), F.col("w").alias("v"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def has_type(node: Column, name: str) -> Column:
    one = F.try_variant_get(node, '$["@type"]', "string")
    many = F.try_variant_get(node, '$["@type"]', "array<string>")
    return F.coalesce(one == name, F.lit(False)) | F.coalesce(F.array_contains(many, name), F.lit(False))


def json_ld_products(nodes: DataFrame) -> DataFrame:
    """(url, place, record fields) of Product nodes; the first offer counts."""

    def text(*paths: str) -> Column:
        """The first text or number; objects and lists at a path don't count."""
        values = (F.try_variant_get("node", p, "string") for p in paths)
        return first_filled(*(F.when(~v.rlike(r"^[{\[]"), v) for v in values))

    products = nodes.filter(has_type(F.col("node"), "Product"))
    image = text("$.image[0].url", "$.image[0]", "$.image.url", "$.image")
    return products.select(
        "url", "place",
        F.coalesce(text("$.name"), F.lit("")).alias("product_name"),
        F.coalesce(text("$.sku"), F.lit("")).alias("sku"),
        F.coalesce(text("$.brand.name", "$.brand"), F.lit("")).alias("brand"),
        html_to_text(text("$.description")).alias("description"),
        F.coalesce(text("$.category"), F.lit("")).alias("category"),
        normalize_price(text("$.offers[0].price", "$.offers[0].lowPrice", "$.offers.price", "$.offers.lowPrice")).alias("price"),
        F.coalesce(text("$.offers[0].priceCurrency", "$.offers.priceCurrency"), F.lit("")).alias("currency"),
        stock_from_address(F.coalesce(text("$.offers[0].availability", "$.offers.availability"), F.lit(""))).alias("availability"),
        F.coalesce(absolute_url(image, F.col("url")), F.lit("")).alias("main_image"),
        F.coalesce(absolute_url(text("$.url", "$.offers.url"), F.col("url")), F.col("url")).alias("product_url"),
    )


def json_ld_items(nodes: DataFrame) -> DataFrame:
    """(url, place, seq, item_url) of ItemList nodes."""
    lists = nodes.filter(has_type(F.col("node"), "ItemList"))
    items = lists.select("url", "place", F.posexplode(F.try_variant_get("node", "$.itemListElement", "array<variant>")).alias("seq", "e"))
    target = first_filled(*(F.try_variant_get("e", p, "string") for p in ("$", "$.url", "$.item.url", "$.item['@id']", "$.item")))
    full = canonical_url(absolute_url(target, F.col("url")))
    return items.select("url", "place", "seq", full.alias("item_url")).filter(is_product_path(path(F.col("item_url"))))


def _meta(html: Column, key: str) -> Column:
    a = rf"(?is)<meta\b[^>]*\b(?:property|name|itemprop)\s*=\s*[\"']{re.escape(key)}[\"'][^>]*\bcontent\s*=\s*[\"']([^\"']*)"
    b = rf"(?is)<meta\b[^>]*\bcontent\s*=\s*[\"']([^\"']*)[\"'][^>]*\b(?:property|name|itemprop)\s*=\s*[\"']{re.escape(key)}[\"']"
    return first_filled(F.regexp_extract(html, a, 1), F.regexp_extract(html, b, 1))


def meta_product(html: Column, url: Column) -> Column:
    """struct of the fields that a page's meta tags and headings state; stock is never assumed."""
    heading = html_to_text(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))
    title = html_to_text(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1))
    return F.struct(
        F.coalesce(first_filled(heading, _meta(html, "og:title"), title), F.lit("")).alias("product_name"),
        F.coalesce(first_filled(_meta(html, "og:description"), _meta(html, "description")), F.lit("")).alias("description"),
        normalize_price(first_filled(_meta(html, "product:price:amount"), _meta(html, "og:price:amount"), _meta(html, "price"))).alias("price"),
        F.coalesce(first_filled(_meta(html, "product:price:currency"), _meta(html, "og:price:currency")), F.lit("")).alias("currency"),
        F.coalesce(filled(absolute_url(_meta(html, "og:image"), url)), F.lit("")).alias("main_image"),
    )


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, item_url): distinct links of a page to products of its own host."""
    found = pages.select(F.col(url).alias("url"), F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"'#]+)"), F.lit(1))).alias("href"))
    full = canonical_url(absolute_url(F.col("href"), F.col("url")))
    named = found.select("url", full.alias("item_url")).filter(is_product_path(path(F.col("item_url"))))
    return named.filter(F.lower(netloc(F.col("url"))) == netloc(F.col("item_url"))).distinct()


def window_json(html: str | None, name: str) -> str | None:
    """The object assigned to ``window.<name>``, braces inside texts not counting; null if there is none or it never ends."""
    found = re.search(rf"window\.{re.escape(name)}\s*=\s*", html or "")
    if not found or html[found.end() : found.end() + 1] not in ("{", "["):
        return None
    depth, quote, skip = 0, "", False
    for at in range(found.end(), len(html)):
        ch = html[at]
        if skip:
            skip = False
        elif quote:
            skip = ch == "\\"
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch in "{[":
            depth += 1
        elif ch in "}]":
            depth -= 1
            if not depth:
                return html[found.end() : at + 1]
    return None


def window_state(pages: DataFrame, name: str, keep: tuple[str, ...] = ("url",), html: str = "html") -> DataFrame:
    """(keep…, state): the script state of each page as VARIANT; pages without one have no row."""

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: window_json(t, name))

    return pages.filter(F.contains(html, F.lit(f"window.{name}"))).select(*keep, F.try_parse_json(find(F.col(html))).alias("state")).filter("state is not null")


def _sweep(value, wanted, out: list[str]) -> None:
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            if wanted(v):
                out.append(json.dumps(v))
            stack.extend(reversed(list(v.values())))
        elif isinstance(v, list):
            stack.extend(reversed(v))


def _priced(v: dict) -> bool:
    return bool(v.get("title") or v.get("name")) and any(v.get(k) not in (None, "", [], {}) for k in ("price", "priceRange", "variants"))


def _goods(v: dict) -> bool:
    return any(k in v for k in ("goods_id", "goodsId", "goods_name", "goodsName"))


def sweep_nodes(df: DataFrame, keep: tuple[str, ...], text: str, kind: str = "product") -> DataFrame:
    """(keep…, seq, node): objects that look like products (or goods) anywhere in a JSON text, in document order."""
    wanted = {"product": _priced, "goods": _goods}[kind]

    @F.pandas_udf("array<string>")
    def sweep(texts: pd.Series) -> pd.Series:
        def nodes(t):
            out: list[str] = []
            try:
                _sweep(json.loads(t) if t else None, wanted, out)
            except (ValueError, RecursionError):
                pass
            return out

        return texts.map(nodes)

    return df.select(*keep, F.posexplode(sweep(F.col(text))).alias("seq", "_n")).select(*keep, "seq", F.try_parse_json("_n").alias("node")).filter("node is not null")


class _Card:
    def __init__(self, tag: str, name: str, depth: int) -> None:
        self.tag, self.name, self.depth = tag, name, depth
        self.text: list[str] = []
        self.signals = dict.fromkeys(("link", "title", "price", "image", "cart", "sku", "micro"), "")


class _CardParser(HTMLParser):
    """Containers with a class, with the product signals inside each."""

    VOID = {"img", "br", "hr", "input", "meta", "link", "source", "area", "base", "col", "embed", "track", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []
        self.cards: list[_Card] = []
        self.inside: list[_Card] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        kind = a.get("class", "").lower()
        if tag in ("div", "li", "article", "section") and kind:
            card = _Card(tag, a["class"], len(self.open))
            self.cards.append(card)
            self.inside.append(card)
        for card in self.inside:
            s = card.signals
            if tag == "a" and a.get("href") and not s["link"]:
                s["link"] = a["href"]
            if tag == "img" and not s["image"]:
                s["image"] = next((a[k] for k in ("src", "data-src", "data-original", "data-lazy-src") if a.get(k)), "")
            if any(w in kind for w in ("cart", "buy", "purchase")):
                s["cart"] = "1"
            if any(w in kind for w in ("sku", "product-id", "item-id")) or a.get("data-product-id"):
                s["sku"] = "1"
            if a.get("itemprop") == "product" or a.get("itemtype", "").endswith("Product"):
                s["micro"] = "1"
        if tag not in self.VOID:
            self.open.append((tag, kind))

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                del self.open[at:]
                break
        self.inside = [c for c in self.inside if c.depth < len(self.open)]

    def handle_data(self, data):
        said = data.strip()
        if not said or not self.inside:
            return
        kinds = [k for t, k in self.open] or [""]
        tag, kind = self.open[-1] if self.open else ("", "")
        for card in self.inside:
            s = card.signals
            card.text.append(said)
            below = kinds[card.depth + 1 :]
            if not s["price"] and (any(w in k for k in below for w in ("price", "cost", "amount", "sale")) or re.search(r"[$€£₹¥]\s*\d", said)):
                s["price"] = said
            elif not s["title"] and (tag in ("h1", "h2", "h3", "h4", "h5", "h6", "a") or any(w in kind for w in ("title", "name", "prod", "item"))):
                s["title"] = said


def card_rows(html: str | None) -> list[tuple]:
    """(class, position, link, title, price, image, cart, sku, micro) of each container with a class, in document order."""
    parser = _CardParser()
    try:
        parser.feed(html or "")
        parser.close()
    except (AssertionError, ValueError):
        pass
    return [(c.name, i, *(c.signals[k] for k in ("link", "title", "price", "image", "cart", "sku", "micro"))) for i, c in enumerate(parser.cards)]


def product_cards(pages: DataFrame, url: str = "url", html: str = "html", least_score: int = 40) -> DataFrame:
    """(url, position, class, product_name, price, product_url, image_url, score) of containers that look like product cards.

    The signals come from the parser, the score is native: address 30, name 25, price 25, image 15, cart 20, sku 15,
    microdata 20. Of nested containers with the same link the innermost stays.
    """
    fields = "url string, class string, position int, link string, title string, price string, image string, cart string, sku string, micro string"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(u, *r) for u, h in zip(batch["url"], batch["html"], strict=True) for r in card_rows(h)]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in fields.split(", ")])

    cards = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(parse, fields)
    link = F.when(F.col("link") != "", canonical_url(absolute_url(F.col("link"), F.col("url")))).otherwise("")

    def points(condition: Column, n: int) -> Column:
        return F.when(condition, n).otherwise(0)

    scored = cards.withColumn("product_url", link).withColumn(
        "score",
        points((F.col("product_url") != "") & is_product_path(path(F.col("product_url"))), 30) + points(F.length("title") >= 3, 25) + points(F.col("price") != "", 25)
        + points(F.col("image") != "", 15) + points(F.col("cart") != "", 20) + points(F.col("sku") != "", 15) + points(F.col("micro") != "", 20),
    )
    good = scored.filter((F.col("score") >= least_score) & (F.col("product_url") != canonical_url(F.col("url"))))
    inner = good.groupBy("url", "product_url").agg(F.max("position").alias("position"))
    return good.join(inner, ["url", "product_url", "position"]).select(
        "url", "position", "class", F.col("title").alias("product_name"), "price", "product_url", F.coalesce(filled(absolute_url(F.col("image"), F.col("url"))), F.lit("")).alias("image_url"), "score"
    )
