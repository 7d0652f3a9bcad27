"""Image lists: full size, one entry per image, main image first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.urls import absolute_url


def full_size(url: Column) -> Column:
    return F.regexp_replace(url, r"_[0-9]+x[0-9]*\.(jpg|png|webp|jpeg)", r".$1")


def image_list(urls: Column, base: Column) -> Column:
    """Addresses in order, each image once; what follows a question mark tells no images apart. Null gives an empty list."""
    clean = F.filter(F.transform(F.coalesce(urls, F.array().cast("array<string>")), lambda u: full_size(absolute_url(u, base))), lambda u: u != "")
    keys = F.transform(clean, lambda u: F.substring_index(u, "?", 1))
    return F.filter(clean, lambda u, i: F.array_position(keys, F.substring_index(u, "?", 1)) == i + 1)


def image_fields(urls: Column, base: Column) -> Column:
    """struct(main_image, additional_images, all_images), packed with bars."""
    images = image_list(urls, base)
    return F.struct(
        F.coalesce(F.get(images, 0), F.lit("")).alias("main_image"),
        F.array_join(F.slice(images, 2, 2147483647), "|").alias("additional_images"),
        F.array_join(images, "|").alias("all_images"),
    )
