"""One wide record from raw fields, as one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.images import image_fields
from shelfspark.functions.scalar import (
    detect_currency,
    filled,
    first_filled,
    html_to_text,
    material,
    normalize_price,
    price_relation,
    variant_count,
)
from shelfspark.functions.urls import source_domain
from shelfspark.schema import UNIVERSAL_COLUMNS


def normalize_records(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Universal records from rows with any of the universal columns; missing columns count as null.

    Names, brands, sellers and materials stand in for each other. Nothing is invented: what no field says stays blank.
    """
    have = set(df.columns)

    def c(name: str):
        return F.trim(F.col(name).cast("string")) if name in have else F.lit(None).cast("string")

    blank = F.lit("")
    relation = price_relation(
        normalize_price(c("price")), normalize_price(c("sale_price")), F.coalesce(normalize_price(c("original_price")), normalize_price(c("list_price")), normalize_price(c("compare_at_price")))
    )
    listed = F.filter(F.split(F.coalesce(c("all_images"), c("main_image"), blank), r"\|"), lambda u: F.trim(u) != "")
    named = first_filled(c("product_name"), c("title"))
    sign = detect_currency(F.concat_ws(" ", c("price"), c("sale_price"), c("original_price")))
    prepared = df.withColumns({"_relation": relation, "_images": image_fields(listed, F.coalesce(filled(c("product_url")), c("source_url"))), "_sign": sign})
    values = {
        "source_domain": source_domain(F.coalesce(filled(c("product_url")), c("source_url"), blank)),
        "product_name": F.coalesce(named, blank),
        "title": F.coalesce(first_filled(c("title"), c("product_name")), blank),
        "description": html_to_text(c("description")),
        "brand": F.coalesce(first_filled(c("brand"), c("vendor")), blank),
        "vendor": F.coalesce(first_filled(c("vendor"), c("brand")), blank),
        "seller": F.coalesce(first_filled(c("seller"), c("vendor"), c("brand")), blank),
        "price": F.col("_relation.price"),
        "sale_price": F.col("_relation.sale_price"),
        "original_price": F.col("_relation.original_price"),
        "list_price": F.col("_relation.original_price"),
        "compare_at_price": F.col("_relation.original_price"),
        "discount_percentage": F.col("_relation.discount_percentage"),
        "currency": F.coalesce(filled(c("currency")), F.col("_sign")),
        "currency_source": F.when(filled(c("currency_source")).isNotNull(), c("currency_source")).when(F.col("_sign") != "", "price_text").when(filled(c("currency")).isNotNull(), "provided").otherwise("not_found"),
        "availability": F.coalesce(first_filled(c("availability"), c("stock_status")), blank),
        "stock_status": F.coalesce(first_filled(c("stock_status"), c("availability")), blank),
        "material": F.coalesce(first_filled(c("material"), c("fabric"), material(F.concat_ws(" ", c("product_name"), c("tags")))), blank),
        "fabric": F.coalesce(first_filled(c("fabric"), c("material")), blank),
        "variant_count": F.coalesce(F.col("variant_count"), variant_count(c("variants"))) if "variant_count" in have else variant_count(c("variants")),
        "main_image": F.col("_images.main_image"),
        "additional_images": F.col("_images.additional_images"),
        "all_images": F.col("_images.all_images"),
        "image_url": F.col("_images.main_image"),
    }
    columns = [values.get(name, F.coalesce(c(name), blank)).alias(name) for name in UNIVERSAL_COLUMNS]
    return prepared.select(*keep, *columns)
