"""The universal product schema."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns of the universal record in their order; the last one is additional.
UNIVERSAL_COLUMNS = (
    "source_domain source_url product_id sku product_name title description short_description brand vendor seller category subcategory collection "
    "product_type tags product_url price sale_price original_price list_price compare_at_price discount_percentage currency availability stock_status "
    "colors sizes material fabric pattern variants variant_count main_image additional_images all_images video_url specifications rating review_count "
    "sold_count shipping_information scraped_at price_source title_source image_source sku_source description_source availability_source category_source "
    "variants_source currency_source image_url"
).split()
NUMBERS = {"price": T.DoubleType(), "sale_price": T.DoubleType(), "original_price": T.DoubleType(), "list_price": T.DoubleType(), "compare_at_price": T.DoubleType(), "variant_count": T.IntegerType()}
PRODUCT_SCHEMA = T.StructType([T.StructField(c, NUMBERS.get(c, T.StringType())) for c in UNIVERSAL_COLUMNS])
