"""Identity of a shop's listing, as addresses and ids tell it, and instants written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.plain import is_stand_in


def shop_key(domain: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(domain)), r"^www\.", "")


def listing_id(product_id: Column) -> Column:
    """The bare id: outer space, a decimal ``.0`` and the prefix of a global id are left out; stand-ins give null."""
    bare = F.regexp_replace(F.trim(product_id), r"^gid://\S*/", "")
    bare = F.regexp_replace(bare, r"\.0+$", "")
    return F.when(is_stand_in(product_id) | (bare == "") | bare.rlike(r"^0+$"), None).otherwise(bare)


def address_path(url: Column) -> Column:
    """Path of an address without scheme, host, query, fragment, outer slashes and a leading collection."""
    path = F.rtrim(F.regexp_extract(F.trim(url), r"^(?:(?i:https?:)?//[^/?#]*)?/*([^?#]*)", 1), F.lit("/"))
    return F.when(path.startswith("collections/"), F.regexp_replace(path, r"^collections/[^/]+/(?=products/)", "")).otherwise(path)


def address_id(url: Column) -> Column:
    """The id that the query of an address carries."""
    found = F.regexp_extract(url, r"[?&](?:goods_id|product_id|item_id)=(\d+)", 1)
    return F.when(found != "", found)


def product_path(url: Column) -> Column:
    """The path of an address of one product; null for listings, other pages and addresses told apart by an id."""
    path = address_path(url)
    one = path.rlike(r"(?:^|/)(?:products?|item|items|p|dp|goods)/[^/]+$") | path.rlike(r"-g-\d+\.html$")
    return F.when(F.coalesce(one, F.lit(False)) & address_id(url).isNull(), path)


def instant_micros(text: Column) -> Column:
    """Microseconds since 1970 of an instant in ISO form (without zone: UTC) or as seconds or milliseconds; else null."""
    t = F.trim(text)
    digits = t.rlike(r"^\d{9,11}(?:\.\d+)?$")
    millis = t.rlike(r"^\d{12,14}$")
    iso = F.unix_micros(F.try_to_timestamp(F.regexp_replace(t, r"(\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)$", "$1Z")))
    iso = F.coalesce(iso, F.unix_micros(F.try_to_timestamp(t)))
    return (
        F.when(digits, (t.try_cast("decimal(20,6)") * 1_000_000).cast("bigint")).when(millis, t.try_cast("bigint") * 1000).otherwise(iso)
    )
