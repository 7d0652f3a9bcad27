"""Addresses: joining, canonical form, kind of page, platform, next page, safety. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.scalar import filled, first_filled, trim_all

# Path parts of product pages, and of listings and navigation.
PRODUCT_MARKERS = ("/products/", "/product/", "/p/", "/item/", "/dp/", "/goods/", "/buy/")
OTHER_MARKERS = (
    "/collections/", "/collection/", "/category/", "/categories/", "/cart", "/checkout", "/search", "/pages/", "/blogs/", "/about", "/contact",
    "/policy", "/policies/", "/account", "/faq",
)
# Query keys that only track visits.
TRACKING = r"(?i)^(utm_[^=]*|fbclid|gclid|mc_cid|mc_eid)(=|$)"
PAGE_KEYS = ("page", "p", "page_num", "page_number")
# Hosts and networks that are never fetched from.
BLOCKED_HOSTS = ("localhost", "loopback", "localhost.localdomain", "metadata.google.internal", "instance-data")
BLOCKED_RANGES = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.168.0.0", 16), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)
#: Listing pages of a job at most.
PAGE_CEILING = 50


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def source_domain(url: Column) -> Column:
    return F.replace(netloc(url), F.lit("www."), F.lit(""))


def absolute_url(url: Column, base: Column) -> Column:
    """The address in full: scheme-relative, host-relative, relative to the base's folder, or a bare host; blank for blank."""
    u = trim_all(F.coalesce(url, F.lit("")))
    origin = F.concat(F.coalesce(filled(scheme(base)), F.lit("https")), F.lit("://"), netloc(base))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    joined = F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), F.regexp_replace(u, r"^\./", ""))
    # Steps up are resolved a few times, as deep as addresses of shops go.
    for _ in range(4):
        joined = F.regexp_replace(joined, r"/(?!\.\./)[^/]+/\.\./", "/")
    return (
        F.when(u == "", "")
        .when(u.startswith("//"), F.concat(F.lit("https:"), u))
        .when(u.rlike(r"^https?://"), u)
        .when(u.startswith("/"), F.concat(origin, u))
        .when(F.coalesce(base, F.lit("")) == "", F.concat(F.lit("https://"), u))
        .when(u.startswith("?"), F.concat(origin, path(base), u))
        .otherwise(joined)
    )


def canonical_url(url: Column) -> Column:
    """Without fragment, tracking keys and trailing slashes, host in lower case; blank if it isn't http."""
    u = trim_all(F.coalesce(url, F.lit("")))
    u = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)
    kept = F.array_join(F.filter(F.split(query(u), "&"), lambda k: (k != "") & ~k.rlike(TRACKING)), "&")
    bare = F.concat(scheme(u), F.lit("://"), F.lower(netloc(u)), F.regexp_replace(path(u), r"/+$", ""))
    return F.when(~scheme(u).isin("http", "https"), "").when(kept == "", bare).otherwise(F.concat(bare, F.lit("?"), kept))


def _has_any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(text, F.lit(part))
    return out


def is_product_path(url_path: Column) -> Column:
    p = F.regexp_replace(F.lower(F.coalesce(url_path, F.lit(""))), r"/+$", "")
    plain = (p != "") & ~p.endswith("/products") & ~p.endswith("/product")
    return plain & (~_has_any(p, OTHER_MARKERS) | F.contains(p, F.lit("/products/"))) & _has_any(p, PRODUCT_MARKERS)


def platform(url: Column, html: Column | None = None) -> Column:
    """Which adapter takes the page: goods, shopify, woocommerce, else generic."""
    html = F.coalesce(html if html is not None else F.lit(""), F.lit(""))
    lower, p = F.lower(url), F.lower(path(url))
    shopify = (
        F.contains(lower, F.lit("myshopify.com")) | _has_any(html, ("cdn.shopify.com", "window.Shopify", "Shopify.theme", "/products.json"))
        | F.contains(p, F.lit("/collections/")) | p.endswith("/products.json") | p.startswith("/cart") | p.startswith("/checkout")
        | (F.contains(p, F.lit("/products/")) & F.contains(query(url), F.lit("variant=")))
    )
    woo = F.contains(F.lower(html), F.lit("woocommerce")) | F.contains(html, F.lit("wc-block")) | _has_any(url, ("/wp-json/wc/", "/product-category/"))
    goods = F.contains(lower, F.lit("temu.com")) | F.contains(p, F.lit("goods.html"))
    return F.when(goods, "goods").when(shopify, "shopify").when(woo, "woocommerce").otherwise("generic")


def fingerprint(html: Column) -> Column:
    h = F.lower(F.coalesce(html, F.lit("")))
    return (
        F.when(_has_any(h, ("magento", "mage/")), "Magento").when(F.contains(h, F.lit("bigcommerce")), "BigCommerce").when(F.contains(h, F.lit("prestashop")), "PrestaShop")
        .when(F.contains(html, F.lit("__NEXT_DATA__")), "Next.js E-Commerce").otherwise("Generic / Custom")
    )


def is_goods_url(url: Column) -> Column:
    p, q = F.lower(path(url)), F.lower(query(url))
    return F.contains(p, F.lit("goods.html")) | F.contains(q, F.lit("goods_id=")) | p.rlike(r"-g-\d+\.html$")


def page_type(url: Column, platform_name: Column) -> Column:
    p, q = F.lower(path(url)), F.lower(query(url))
    goods = F.when(is_goods_url(url), "Product").when(F.contains(p, F.lit("search_result.html")) | F.contains(q, F.lit("search_key=")), "Search").otherwise("Category / Listing")
    shopify = F.when(F.contains(p, F.lit("/products/")), "Product").when(F.contains(p, F.lit("/collections/")), "Collection").when(F.contains(p, F.lit("/search")), "Search").otherwise("Catalog / Store Root")
    woo = F.when(F.contains(p, F.lit("/product/")), "Product").when(_has_any(p, ("/product-category/", "/shop")), "Category / Listing").otherwise("Store Page")
    listing = _has_any(p, ("/category/", "/collection/", "/collections/", "/c/", "/cat/", "/shop/", "/catalog/"))
    generic = F.when(is_product_path(p), "Product").when(listing, "Category / Listing").when(_has_any(p, ("/search", "search_key=", "q=")), "Search").otherwise("General Listing / Catalog")
    return F.when(platform_name == "goods", goods).when(platform_name == "shopify", shopify).when(platform_name == "woocommerce", woo).otherwise(generic)


def goods_id(url: Column) -> Column:
    return first_filled(F.regexp_extract(F.lower(path(url)), r"-g-(\d+)\.html", 1), F.regexp_extract(query(url), r"(?:^|&)goods_id=([^&]*)", 1))


def canonical_goods_url(seo_url: Column, link_url: Column, id_: Column) -> Column:
    """The descriptive address if it names the item, else an address made from the link's or the given id; blank if neither."""
    seo = F.substring_index(F.coalesce(seo_url, F.lit("")), "?", 1)
    number = F.coalesce(goods_id(link_url), filled(id_))
    return F.when(F.contains(seo, F.lit(".html")) | F.contains(seo, F.lit("/goods")), seo).when(
        number.isNotNull(), F.concat(F.lit("https://www.temu.com/goods.html?goods_id="), number)
    ).otherwise(F.lit(""))


def with_page(url: Column, number: Column) -> Column:
    """The address with its page parameter replaced by ``number``, at the end."""
    kept = F.filter(F.split(query(url), "&"), lambda k: (k != "") & ~k.rlike(r"^page(=|$)"))
    return F.concat(F.regexp_replace(url, r"[?#].*$", ""), F.lit("?"), F.array_join(F.concat(kept, F.array(F.concat(F.lit("page="), number.cast("string")))), "&"))


def next_query_page(url: Column) -> Column:
    """The next page by the first page parameter with a number; null if there is none."""
    out = F.lit(None).cast("string")
    for key in reversed(PAGE_KEYS):
        now = F.regexp_extract(query(url), rf"(?:^|&){key}=(\d+)(?:&|$)", 1)
        ahead = F.regexp_replace(url, rf"([?&]{key}=)\d+(?=&|#|$)", "$1{next}")
        out = F.when(now != "", F.replace(ahead, F.lit("{next}"), (now.try_cast("bigint") + 1).cast("string"))).otherwise(out)
    return out


def next_path_page(url: Column) -> Column:
    """The next page by ``/page/N``, or by a number as the last part of the path; null if there is none."""
    p = path(url)
    paged, last = F.regexp_extract(p, r"/page/(\d+)", 1), F.regexp_extract(p, r"/(\d+)/?$", 1)
    origin = F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]*)", 1)
    tail = F.regexp_extract(url, r"(\?[^#]*)", 1)

    def ahead(n: Column) -> Column:
        return (n.try_cast("bigint") + 1).cast("string")

    by_page = F.concat(origin, F.replace(F.regexp_replace(p, r"/page/\d+", "/page/{next}"), F.lit("{next}"), ahead(paged)), tail)
    by_last = F.concat(origin, F.regexp_replace(p, r"\d+/?$", ""), ahead(last), F.lit("/"), tail)
    return F.when(paged != "", by_page).when(last != "", by_last)


def next_offset_page(url: Column) -> Column:
    offset = F.regexp_extract(query(url), r"(?:^|&)offset=(\d+)", 1).try_cast("bigint")
    limit = F.regexp_extract(query(url), r"(?:^|&)limit=(\d+)", 1).try_cast("bigint")
    moved = F.replace(F.regexp_replace(url, r"([?&]offset=)\d+", "$1{next}"), F.lit("{next}"), (offset + limit).cast("string"))
    return F.when(offset.isNotNull() & limit.isNotNull(), moved)


def rel_next(html: Column) -> Column:
    """The address, as written, of the link that a page marks as its next one; null if there is none."""
    one = r"(?is)<{tag}\b(?=[^>]*\brel\s*=\s*[\"']?next\b)[^>]*\bhref\s*=\s*[\"']([^\"']+)"
    return first_filled(F.regexp_extract(html, one.replace("{tag}", "link"), 1), F.regexp_extract(html, one.replace("{tag}", "a"), 1))


def next_rel_link(html: Column, base: Column) -> Column:
    """Target of the link that a page marks as its next one; null if there is none."""
    target = rel_next(html)
    return F.when(target.isNotNull(), absolute_url(target, base))


def next_page(url: Column, html: Column | None = None) -> Column:
    found = [next_query_page(url), next_path_page(url)]
    if html is not None:
        found.append(next_rel_link(html, url))
    return F.coalesce(*found, next_offset_page(url))


def _address_number(host: Column) -> Column:
    parts = F.split(host, r"\.")
    number = F.lit(0).cast("bigint")
    for i in range(4):
        number = number * 256 + F.get(parts, i).try_cast("bigint")
    return F.when(host.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), number)


def unsafe_reason(url: Column) -> Column:
    """Why an address must not be fetched, without asking a name server; blank if nothing speaks against it."""
    u = trim_all(F.coalesce(url, F.lit("")))
    kind = scheme(u)
    host = F.lower(F.regexp_replace(F.regexp_replace(netloc(u), r"^[^@]*@", ""), r":\d+$", ""))
    number = _address_number(host)
    # One look at the number for each length of network.
    blocked, lengths = F.lit(False), {}
    for first, bits in BLOCKED_RANGES:
        a, b, c, d = (int(x) for x in first.split("."))
        lengths.setdefault(bits, []).append((((a * 256 + b) * 256 + c) * 256 + d) >> (32 - bits))
    for bits, heads in lengths.items():
        blocked = blocked | F.shiftright(number, 32 - bits).isin(*heads)
    return (
        F.when(u == "", "empty").when((kind != "") & ~kind.isin("http", "https"), "scheme").when(host == "", "host")
        .when(host.isin(*BLOCKED_HOSTS) | host.endswith(".local") | host.endswith(".internal"), "blocked_host")
        .when(host.startswith("["), "literal").when(F.coalesce(blocked, F.lit(False)), "blocked_range").otherwise("")
    )


def redirect_kind(url: Column, target: Column) -> Column:
    """``blocked`` with its reason for an unsafe target, else ``same``, ``subdomain`` or ``other``; other sites are followed, and told apart for the log."""
    reason = unsafe_reason(target)
    old, new = F.lower(netloc(url)), F.lower(netloc(target))
    below = new.endswith(F.concat(F.lit("."), old)) | old.endswith(F.concat(F.lit("."), new))
    return F.when(reason != "", F.concat(F.lit("blocked: "), reason)).when(old == new, "same").when(below, "subdomain").otherwise("other")


def same_goods(url: Column, node_id: Column) -> Column:
    """A node is of the address's item unless both state an id and these differ."""
    return F.coalesce(goods_id(url) == F.nullif(node_id, F.lit("")), F.lit(True))
