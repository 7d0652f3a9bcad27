"""Adapters: which pages a way of extraction takes, and how it finds items and records. New ones are registered in front."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import scalar, urls
from shelfspark.operators.dataset import first_strategy
from shelfspark.sources import markup, storefront

RECORD = ("url", "product_name", "sku", "brand", "description", "category", "price", "currency", "availability", "main_image", "product_url", "price_source")


def _shaped(df: DataFrame, source: str) -> DataFrame:
    """The common columns; what a strategy doesn't state is blank, and a missing price is null."""
    have = set(df.columns)
    blank = {c: F.lit(None).cast("double") if c == "price" else F.lit("") for c in RECORD if c not in have}
    return df.withColumns({**blank, "price_source": F.lit(source)}).withColumn("product_url", F.coalesce(scalar.filled(F.col("product_url")), F.col("url"))).select(*RECORD)


def json_ld_records(pages: DataFrame) -> DataFrame:
    nodes = markup.json_ld_products(markup.json_ld_nodes(pages))
    first = F.min(F.struct("place", "product_name")).alias("f")
    chosen = nodes.groupBy("url").agg(first).select("url", "f.place")
    return _shaped(nodes.join(chosen, ["url", "place"]), "jsonld.offers.price")


def state_records(pages: DataFrame) -> DataFrame:
    """The first object of a page's script state that looks like a product."""
    script = F.regexp_extract("html", r"(?is)<script[^>]*id=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>", 1)
    nodes = markup.sweep_nodes(pages.select("url", script.alias("t")).filter("t <> ''"), ("url",), "t").filter("seq = 0")

    def text(*paths: str) -> Column:
        return scalar.first_filled(*(F.try_variant_get("node", p, "string") for p in paths))

    lows = F.array_min(F.transform(F.try_variant_get("node", "$.variants", "array<variant>"), lambda v: scalar.normalize_price(F.try_variant_get(v, "$.price", "string"))))
    return _shaped(
        nodes.select("url", text("$.title", "$.name").alias("product_name"), F.coalesce(scalar.normalize_price(text("$.price")), lows).alias("price"), F.coalesce(text("$.sku"), F.lit("")).alias("sku"), F.lit("").alias("product_url")),
        "nextjs.price",
    )


def meta_records(pages: DataFrame) -> DataFrame:
    found = pages.select("url", markup.meta_product(F.col("html"), F.col("url")).alias("m")).select("url", "m.*", F.lit("").alias("product_url"))
    return _shaped(found.filter("product_name <> ''"), "html.price")


def single_page_records(pages: DataFrame) -> DataFrame:
    """One record per page by the first strategy that finds one: JSON-LD, script state, then meta tags and headings."""
    parts = [f(pages).withColumn("_rank", F.lit(i)) for i, f in enumerate((json_ld_records, state_records, meta_records))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # At most one record a strategy: the one of the least rank is the least struct, in a single aggregation.
    first = F.min(F.struct("_rank", *RECORD)).alias("r")
    return both.groupBy("url").agg(first).select(*(F.col(f"r.{c}") for c in RECORD))


def listing_items(pages: DataFrame) -> DataFrame:
    """(url, seq, item_url) of listing pages by the first strategy that finds any: JSON-LD lists, cards, links."""
    lists = markup.json_ld_items(markup.json_ld_nodes(pages)).select("url", F.col("seq").cast("bigint"), "item_url", F.lit(0).alias("_rank"))
    cards = markup.product_cards(pages).filter("product_url <> ''").select("url", F.col("position").cast("bigint").alias("seq"), F.col("product_url").alias("item_url"), F.lit(1).alias("_rank"))
    links = markup.links(pages).select("url", F.xxhash64("item_url").alias("seq"), "item_url", F.lit(2).alias("_rank"))
    return first_strategy(lists.unionByName(cards).unionByName(links), "url", "_rank").drop("_rank")


def goods_anchors(pages: DataFrame) -> DataFrame:
    """(url, goods_id, product_name, image_url, product_url) of links to goods; a link needs an id and a title or an image."""
    anchor = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*\bhref\s*=\s*[\"'][^\"']*(?:goods\.html|-g-\d+|goods_id=)[^\"']*[\"'][^>]*>.*?</a>"), F.lit(0))
    found = pages.select("url", F.posexplode(anchor).alias("seq", "a"))
    link = urls.absolute_url(F.regexp_extract("a", r"(?is)\bhref\s*=\s*[\"']([^\"']+)", 1), F.col("url"))
    title = scalar.clean_anchor_title(scalar.first_filled(F.regexp_extract("a", r"(?is)\btitle\s*=\s*[\"']([^\"']+)", 1), scalar.html_to_text(F.col("a"))))
    out = found.select(
        "url", "seq", urls.goods_id(link).alias("goods_id"), F.coalesce(title, F.lit("")).alias("product_name"),
        F.regexp_extract("a", r"(?is)<img\b[^>]*\bsrc\s*=\s*[\"']([^\"']+)", 1).alias("image_url"), urls.canonical_goods_url(link, link, F.lit("")).alias("product_url"),
    )
    return out.filter("goods_id is not null and (product_name <> '' or image_url <> '')")


def goods_items(pages: DataFrame) -> DataFrame:
    """Goods of a page's script state, else of its links."""
    state = markup.window_state(pages, "rawData").select("url", F.to_json("state").alias("t"))
    nodes = storefront.goods_records(markup.sweep_nodes(state, ("url",), "t", "goods"), "node", keep=("url", "seq"))
    columns = ("url", "seq", "goods_id", "product_name", "image_url", "product_url")
    both = nodes.select(*columns, F.lit(0).alias("_rank")).unionByName(goods_anchors(pages).select(*columns, F.lit(1).alias("_rank")))
    return first_strategy(both, "url", "_rank").drop("_rank")


def blocked(html: Column, state: Column) -> Column:
    """The shop refused the page: its state says so, or, where it has none, the page's own words do."""
    said = F.coalesce(F.try_variant_get(state, "$.store.banned", "boolean"), F.lit(False)) | F.coalesce(F.try_variant_get(state, "$.store.isRobot", "boolean"), F.lit(False))
    return said | (state.isNull() & html.rlike(r"(?i)captcha|security verification|are you a robot"))


def form_variations(pages: DataFrame) -> DataFrame:
    """(url, seq, variation fields) from the variations attribute of a product form."""
    raw = F.regexp_extract("html", r"(?is)data-product_variations\s*=\s*\"([^\"]*)\"", 1)
    for entity, plain in scalar.ENTITIES:
        raw = F.replace(raw, F.lit(entity), F.lit(plain))
    kind = "array<struct<variation_id:bigint,sku:string,display_price:double,is_in_stock:boolean,image:struct<src:string>>>"
    rows = pages.select("url", F.posexplode(F.from_json(raw, kind)).alias("seq", "v"))
    stock = F.when(F.col("v.is_in_stock"), "In Stock").when(~F.col("v.is_in_stock"), "Out of Stock").otherwise("")
    return rows.select("url", "seq", F.col("v.variation_id").cast("string").alias("variant_id"), F.coalesce("v.sku", F.lit("")).alias("variant_sku"), F.col("v.display_price").alias("variant_price"), stock.alias("variant_availability"), F.coalesce("v.image.src", F.lit("")).alias("variant_image"))


@dataclass(frozen=True)
class Adapter:
    """A way of extraction. Subclass or replace the functions to add a shop platform."""

    name: str
    discover: object = field(default=listing_items)
    extract: object = field(default=single_page_records)

    def takes(self, url: Column, html: Column | None = None) -> Column:
        return urls.platform(url, html) == self.name


ADAPTERS: tuple[Adapter, ...] = (Adapter("goods", discover=goods_items), Adapter("shopify"), Adapter("woocommerce"), Adapter("generic"))


def analyze(pages: DataFrame, adapters: Sequence[Adapter] = ADAPTERS) -> DataFrame:
    """Adds domain, adapter, platform, page_type, has_jsonld and the reason against fetching."""
    adapter = F.lit("generic")
    for one in reversed(adapters):
        adapter = F.when(one.takes(F.col("url"), F.col("html")), F.lit(one.name)).otherwise(adapter)
    tagged = pages.withColumn("adapter", adapter)
    return tagged.withColumns(
        {
            "domain": urls.source_domain(F.col("url")),
            "platform": F.when(F.col("adapter") == "generic", urls.fingerprint(F.col("html"))).otherwise(F.col("adapter")),
            "page_type": urls.page_type(F.col("url"), F.col("adapter")),
            "has_jsonld": F.contains(F.coalesce("html", F.lit("")), F.lit("application/ld+json")),
            "unsafe": urls.unsafe_reason(F.col("url")),
        }
    )
