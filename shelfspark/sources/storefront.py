"""Raw storefront JSON into records: listing pages, products with variants, store interface products, goods nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.images import image_fields
from shelfspark.functions.scalar import discount_percentage, filled, first_filled, html_to_text, minor_units, normalize_price, size_from_title
from shelfspark.functions.urls import canonical_goods_url

# Schemas of the raw records.
VARIANT = (
    "struct<id:bigint,title:string,option1:string,option2:string,option3:string,sku:string,price:string,compare_at_price:string,available:boolean,"
    "price_currency:string,image_id:bigint,featured_image:struct<src:string>>"
)
PRODUCT = (
    "struct<id:bigint,title:string,handle:string,vendor:string,product_type:string,body_html:string,tags:array<string>,price_currency:string,currency:string,"
    f"options:array<struct<name:string,position:int,values:array<string>>>,variants:array<{VARIANT}>,images:array<struct<id:bigint,src:string>>,image:struct<src:string>>"
)
LISTING = f"struct<products:array<{PRODUCT}>>"
STORE_API = (
    "array<struct<id:bigint,name:string,sku:string,description:string,short_description:string,permalink:string,brand:string,"
    "prices:struct<price:string,regular_price:string,sale_price:string,currency_code:string>,images:array<struct<src:string>>,categories:array<struct<name:string>>,"
    "attributes:array<struct<name:string,terms:array<struct<name:string>>>>,variations:array<struct<id:bigint,sku:string,attributes:string,price:string,is_in_stock:boolean>>,is_in_stock:boolean>>"
)
PAGE_SIZE = 250


def listing_products(pages: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Products of paged listings (source, page_num, body) up to the first short page of each source, in order (seq)."""
    parsed = pages.withColumn("_p", F.from_json("body", LISTING)["products"]).withColumn("_n", F.coalesce(F.size("_p"), F.lit(0)))
    last = parsed.filter(F.col("_n") < page_size).groupBy("source").agg(F.min("page_num").alias("_last"))
    wanted = parsed.join(last, "source", "left").filter(F.col("_last").isNull() | (F.col("page_num") <= F.col("_last")))
    return wanted.select("source", "page_num", F.posexplode("_p").alias("seq", "product")).select("source", "page_num", "seq", "product.*")


def option_value(options: Column, variant: Column, words: str, default: int) -> Column:
    """The variant's value of the last option whose name holds one of the words."""
    hit = F.try_element_at(F.filter(options, lambda o: F.lower(o["name"]).rlike(words)), F.lit(-1))
    position = F.when(hit.isNotNull(), F.coalesce(hit["position"], F.lit(default)))
    return F.when(position == 1, variant["option1"]).when(position == 2, variant["option2"]).when(position == 3, variant["option3"])


def first_in_stock(variants: Column) -> Column:
    """Index from 0 of the first variant in stock, 0 if there is none. A variant that doesn't say is in stock."""
    stock = F.transform(variants, lambda v: F.coalesce(v["available"], F.lit(True)))
    return F.greatest(F.array_position(stock, True) - 1, F.lit(0)).cast("int")


def variant_rows(options: Column, variants: Column, images: Column) -> Column:
    """Variants in one flat form."""

    def one(v: Column) -> Column:
        size = F.coalesce(filled(option_value(options, v, "size", 1)), filled(size_from_title(v["title"])), F.lit(""))
        color = F.coalesce(filled(option_value(options, v, "colou?r", 2)), F.lit(""))
        by_id = F.get(F.filter(images, lambda i: i["id"] == v["image_id"]), 0)["src"]
        price, compare = normalize_price(v["price"]), normalize_price(v["compare_at_price"])
        return F.struct(
            v["id"].cast("string").alias("variant_id"),
            F.coalesce(v["sku"], F.lit("")).alias("variant_sku"),
            F.coalesce(v["title"], F.lit("")).alias("variant_name"),
            price.alias("variant_price"),
            F.when(compare > price, compare).alias("variant_original_price"),
            color.alias("variant_color"),
            size.alias("variant_size"),
            F.when(F.coalesce(v["available"], F.lit(True)), "In Stock").otherwise("Out of Stock").alias("variant_availability"),
            F.coalesce(by_id, v["featured_image"]["src"], F.lit("")).alias("variant_image"),
        )

    return F.transform(variants, one)


def product_records(df: DataFrame, store_currency: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Records from storefront products. Price, sku and compare-at price come from one variant, the first in stock.

    Null titles are blank. Products without variants are out of stock and have no price.
    """
    shop = store_currency if store_currency is not None else F.lit(None).cast("string")
    none = F.array().cast(f"array<{VARIANT}>")
    base = df.withColumns(
        {
            "_variants": F.coalesce("variants", none),
            "_images": F.coalesce("images", F.array().cast("array<struct<id:bigint,src:string>>")),
            "_options": F.coalesce("options", F.array().cast("array<struct<name:string,position:int,values:array<string>>>")),
        }
    ).withColumn("_flat", variant_rows(F.col("_options"), F.col("_variants"), F.col("_images")))
    chosen = F.get("_flat", first_in_stock(F.col("_variants")))
    base = base.withColumn("_chosen", chosen)
    price, original = F.col("_chosen.variant_price"), F.col("_chosen.variant_original_price")
    sources = F.when(F.size("_images") > 0, F.transform("_images", lambda i: i["src"])).otherwise(F.array_compact(F.array(F.col("image.src"))))
    prices = F.array_distinct(F.array_compact(F.transform("_flat", lambda v: v["variant_price"])))
    first_currency = F.get(F.filter(F.transform("_variants", lambda v: filled(v["price_currency"])), lambda c: c.isNotNull()), 0)

    def listed(field: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("_flat", lambda v: v[field]), lambda x: x != ""))), "|")

    shown = image_fields(F.filter(sources, lambda s: s.isNotNull()), F.concat(F.lit("https://"), F.col("source_domain")))
    return base.withColumn("_shown", shown).select(
        *keep,
        F.col("id").cast("string").alias("product_id"),
        F.coalesce(F.trim("title"), F.lit("")).alias("product_name"),
        F.concat(F.lit("https://"), F.col("source_domain"), F.lit("/products/"), F.col("handle")).alias("product_url"),
        F.coalesce("vendor", F.lit("")).alias("brand"),
        F.coalesce("product_type", F.lit("")).alias("product_type"),
        html_to_text(F.col("body_html")).alias("description"),
        F.array_join(F.coalesce("tags", F.array().cast("array<string>")), "|").alias("tags"),
        price.alias("price"),
        original.alias("original_price"),
        discount_percentage(original, price).alias("discount_percentage"),
        F.coalesce(first_filled(first_currency, F.col("price_currency"), F.col("currency"), shop), F.lit("")).alias("currency"),
        F.coalesce(F.col("_chosen.variant_sku"), F.lit("")).alias("sku"),
        F.when(F.exists("_flat", lambda v: v["variant_availability"] == "In Stock"), "In Stock").otherwise("Out of Stock").alias("availability"),
        listed("variant_size").alias("sizes"),
        listed("variant_color").alias("colors"),
        F.size("_flat").alias("variant_count"),
        F.when(F.size(prices) > 1, F.format_string("variants[].price (varies: min=%s, max=%s)", F.array_min(prices).cast("decimal(18,2)"), F.array_max(prices).cast("decimal(18,2)")))
        .otherwise("variants[].price")
        .alias("price_source"),
        F.col("_shown.main_image").alias("main_image"),
        F.col("_shown.all_images").alias("all_images"),
        F.col("_flat").alias("variants"),
    )


def summary_text(variants: Column) -> Column:
    """``Size: … | Price: … | SKU: … | Stock: …`` of each variant, parted by two bars."""
    parts = F.transform(
        variants,
        lambda v: F.concat_ws(
            " | ", F.concat(F.lit("Size: "), v["variant_size"]), F.concat(F.lit("Price: "), F.coalesce(v["variant_price"].cast("decimal(18,2)").cast("string"), F.lit(""))),
            F.concat(F.lit("SKU: "), v["variant_sku"]), F.concat(F.lit("Stock: "), v["variant_availability"]),
        ),
    )
    return F.array_join(parts, " || ")


def store_api_records(pages: DataFrame) -> DataFrame:
    """Records from bodies of a store interface (a JSON array of products; prices in the smallest unit)."""
    items = pages.select("source", F.posexplode(F.from_json("body", STORE_API)).alias("seq", "p"))
    price, regular = minor_units(F.col("p.prices.price")), minor_units(F.col("p.prices.regular_price"))

    def terms(words: str) -> Column:
        hits = F.filter(F.col("p.attributes"), lambda a: F.lower(a["name"]).rlike(words))
        return F.array_join(F.flatten(F.transform(hits, lambda a: F.transform(a["terms"], lambda t: t["name"]))), "|")

    shown = image_fields(F.transform("p.images", lambda i: i["src"]), F.col("source"))
    return items.withColumn("_shown", shown).select(
        "source", "seq",
        F.col("p.id").cast("string").alias("product_id"),
        F.coalesce("p.name", F.lit("")).alias("product_name"),
        F.coalesce("p.sku", F.lit("")).alias("sku"),
        price.alias("price"),
        F.when(regular > price, regular).alias("original_price"),
        F.coalesce("p.prices.currency_code", F.lit("")).alias("currency"),
        html_to_text(F.col("p.description")).alias("description"),
        F.array_join(F.transform("p.categories", lambda c: c["name"]), " > ").alias("category"),
        terms("colou?r").alias("colors"),
        terms("size").alias("sizes"),
        F.coalesce(F.size("p.variations"), F.lit(0)).alias("variant_count"),
        F.when(F.coalesce("p.is_in_stock", F.lit(True)), "In Stock").otherwise("Out of Stock").alias("availability"),
        F.coalesce("p.permalink", F.lit("")).alias("product_url"),
        F.col("_shown.main_image").alias("main_image"),
    )


def goods_records(df: DataFrame, node: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Items from goods nodes (VARIANT): nodes without id and title, or without an address, are left out."""

    def text(*paths: str) -> Column:
        return first_filled(*(F.try_variant_get(F.col(node), p, "string") for p in paths))

    title = text("$.title", "$.goodsName", "$.goods_name", "$.product_name")
    number = text("$.goodsId", "$.goods_id", "$.product_id")
    url = canonical_goods_url(text("$.seoLinkUrl", "$.product_url"), text("$.linkUrl", "$.product_url"), number)
    cents = F.try_variant_get(F.col(node), "$.priceInfo.price", "double") / 100
    market = F.try_variant_get(F.col(node), "$.priceInfo.marketPrice", "double") / 100
    price = F.coalesce(normalize_price(text("$.priceInfo.priceStr")), cents, normalize_price(text("$.priceInfo", "$.price")))
    return df.select(
        *keep,
        F.coalesce(number, F.lit("")).alias("goods_id"),
        F.coalesce(title, F.lit("")).alias("product_name"),
        price.alias("price"),
        F.coalesce(normalize_price(text("$.priceInfo.marketPriceStr")), market).alias("original_price"),
        F.coalesce(text("$.priceInfo.currency"), F.lit("")).alias("currency"),
        F.coalesce(text("$.thumbUrl", "$.image.url"), F.lit("")).alias("image_url"),
        F.coalesce(text("$.salesTip"), F.lit("")).alias("sold_count"),
        F.try_variant_get(F.col(node), "$.comment.goodsScore", "double").alias("rating"),
        url.alias("product_url"),
    ).filter("(goods_id <> '' or product_name <> '') and product_url <> ''")
