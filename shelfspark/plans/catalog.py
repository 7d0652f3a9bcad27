"""Queries of the catalog operators, each with SQL for DuckDB that states the same result over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import scalar, urls
from shelfspark.functions.images import image_fields
from shelfspark.operators import dataset
from shelfspark.operators.packed import split_values
from shelfspark.plans.normalize import normalize_records
from shelfspark.session import load_table
from shelfspark.sources import sinks, storefront

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Shared pieces of SQL.
_NETLOC = r"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)"
_PATH = r"regexp_extract({u}, '^(?:(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*)?([^?#]*)', 1)"
_QUERY = r"regexp_extract({u}, '^[^?#]*\?([^#]*)', 1)"
_PRICE = r"try_cast(replace(regexp_extract(string_split(regexp_replace({p}, '^\s+|\s+$', '', 'g'), ' - ')[1], '(\d[\d,]*(?:\.\d+)?)', 1), ',', '') AS DOUBLE)"
_TEXT = (
    "regexp_replace(regexp_replace(regexp_replace({amp}, '[\\r\\n]+', '|', 'g'), '(\\s*\\|\\s*)+', ' | ', 'g'), '^[ |]+|[ |]+$', '', 'g')"
)


def _text_sql(column: str) -> str:
    t = f"coalesce({column}, '')"
    t = f"regexp_replace({t}, '(?i)<br\\s*/?>|</p>', chr(10), 'g')"
    t = f"regexp_replace({t}, '(?i)</li>|</tr>', ' | ', 'g')"
    t = f"regexp_replace({t}, '(?i)<li[^>]*>', '', 'g')"
    t = f"regexp_replace({t}, '(?s)<!--.*?-->', '', 'g')"
    noise = scalar.NOISE_ELEMENTS
    t = f"regexp_replace({t}, '(?is)<({noise})\\b.*?</({noise})\\s*>', '', 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', '', 'g')"
    for entity, plain in scalar.ENTITIES:
        t = "replace({}, '{}', '{}')".format(t, entity, plain.replace("'", "''"))
    return _TEXT.replace("{amp}", t)


def _product_path_sql(p: str) -> str:
    low = f"regexp_replace(lower(coalesce({p}, '')), '/+$', '')"
    other = " OR ".join(f"contains({low}, '{m}')" for m in urls.OTHER_MARKERS)
    product = " OR ".join(f"contains({low}, '{m}')" for m in urls.PRODUCT_MARKERS)
    return f"({low} <> '' AND NOT ends_with({low}, '/products') AND NOT ends_with({low}, '/product') AND (NOT ({other}) OR contains({low}, '/products/')) AND ({product}))"


def _currency_sql(column: str) -> str:
    cases = " ".join(f"WHEN contains(upper({column}), '{s}') THEN '{c}'" for s, c in scalar.CURRENCY_SIGNS)
    return f"CASE WHEN {column} IS NULL THEN '' {cases} ELSE '' END"


def _discount_sql(o: str, s: str) -> str:
    return f"CASE WHEN {o} > {s} AND {s} > 0 THEN CAST(CAST(round_even(({o} - {s}) / {o} * 100, 0) AS INT) AS VARCHAR) || '%' ELSE '' END"


# Addresses.


@query(f"SELECT row_id, replace({_NETLOC.format(u='product_url')}, 'www.', '') AS source_domain_of FROM products WHERE product_url IS NOT NULL")
def source_domain(spark, d):
    return load_table(spark, d, "products").filter("product_url is not null").select("row_id", urls.source_domain(F.col("product_url")).alias("source_domain_of"))


_CANON_U = r"CASE WHEN starts_with(u0, '//') THEN 'https:' || u0 ELSE u0 END"


@query(rf"""
WITH a AS (SELECT item_id, regexp_replace(coalesce(item_url, ''), '^\s+|\s+$', '', 'g') AS u0 FROM discovery_items),
b AS (SELECT item_id, {_CANON_U} AS u FROM a),
c AS (SELECT item_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS s, {_NETLOC.format(u='u')} AS n, {_PATH.format(u='u')} AS p,
  array_to_string(list_filter(string_split({_QUERY.format(u='u')}, '&'), lambda k: k <> '' AND NOT regexp_matches(k, '(?i)^(utm_[^=]*|fbclid|gclid|mc_cid|mc_eid)(=|$)')), '&') AS q FROM b)
SELECT item_id, CASE WHEN s NOT IN ('http', 'https') THEN '' WHEN q = '' THEN s || '://' || lower(n) || regexp_replace(p, '/+$', '')
  ELSE s || '://' || lower(n) || regexp_replace(p, '/+$', '') || '?' || q END AS canonical FROM c""")
def canonical_url(spark, d):
    return load_table(spark, d, "discovery_items").select("item_id", urls.canonical_url(F.col("item_url")).alias("canonical"))


@query(f"SELECT item_id, {_product_path_sql(_PATH.format(u='item_url'))} AS is_product FROM discovery_items WHERE item_url IS NOT NULL")
def product_path_flag(spark, d):
    items = load_table(spark, d, "discovery_items").filter("item_url is not null")
    return items.select("item_id", urls.is_product_path(urls.path(F.col("item_url"))).alias("is_product"))


_HOSTS = (
    "localhost", "loopback", "localhost.localdomain", "metadata.google.internal", "instance-data", "printer.local", "db.internal", "0.1.2.3", "10.1.2.3", "11.0.0.0", "100.64.0.1", "100.127.255.255",
    "100.128.0.0", "127.0.0.1", "169.254.169.254", "169.255.0.0", "172.15.255.255", "172.16.0.0", "172.31.255.255", "172.32.0.0", "192.168.7.7", "192.0.0.8", "192.0.1.0", "192.0.2.9", "198.51.100.1",
    "198.51.101.1", "203.0.113.255", "203.0.114.0", "224.0.0.1", "239.255.255.255", "240.0.0.1", "255.255.255.255", "8.8.8.8", "shop.example", "172.20.0.1:8080", "223.255.255.255",
)


@query(rf"""
WITH a AS (SELECT failure_id, ([{", ".join(f"'{h}'" for h in _HOSTS)}])[failure_id % {len(_HOSTS)} + 1] AS h, CASE WHEN failure_id % 5 = 0 THEN 'file' ELSE 'https' END AS s FROM failures),
b AS (SELECT failure_id, s, regexp_replace(h, ':\d+$', '') AS h FROM a),
c AS (SELECT failure_id, s, h, CASE WHEN regexp_matches(h, '^[0-9.]+$') THEN list_transform(string_split(h, '.'), lambda x: CAST(x AS INT)) END AS n FROM b)
SELECT failure_id, CASE WHEN s = 'file' THEN 'scheme' WHEN regexp_matches(h, '^(localhost|loopback|localhost\.localdomain|instance-data)$|\.(local|internal)$') THEN 'blocked_host'
  WHEN n[1] IN (0, 10, 127) OR n[1] >= 224 OR (n[1] = 100 AND n[2] BETWEEN 64 AND 127) OR (n[1] = 169 AND n[2] = 254) OR (n[1] = 172 AND n[2] BETWEEN 16 AND 31) OR (n[1] = 192 AND n[2] = 168)
    OR (n[1] = 192 AND n[2] = 0 AND n[3] IN (0, 2)) OR (n[1] = 198 AND n[2] = 51 AND n[3] = 100) OR (n[1] = 203 AND n[2] = 0 AND n[3] = 113) THEN 'blocked_range' ELSE '' END AS unsafe FROM c""")
def url_safety(spark, d):
    f = load_table(spark, d, "failures")
    host = F.get(F.array(*map(F.lit, _HOSTS)), (F.col("failure_id") % len(_HOSTS)).cast("int"))
    kind = F.when(F.col("failure_id") % 5 == 0, "file").otherwise("https")
    return f.select("failure_id", urls.unsafe_reason(F.concat(kind, F.lit("://"), host, F.lit("/x"))).alias("unsafe"))


@query(rf"""
WITH a AS (SELECT row_id, lower({_NETLOC.format(u='product_url')}) AS o, lower({_NETLOC.format(u='source_url')}) AS n FROM products WHERE product_url LIKE 'http%' AND source_url LIKE 'http%')
SELECT row_id, CASE WHEN n = '' THEN 'blocked: host' WHEN o = n THEN 'same' WHEN ends_with(n, '.' || o) OR ends_with(o, '.' || n) THEN 'subdomain' ELSE 'other' END AS kind FROM a""")
def redirect_kinds(spark, d):
    p = load_table(spark, d, "products").filter("product_url like 'http%' and source_url like 'http%'")
    return p.select("row_id", urls.redirect_kind(F.col("product_url"), F.col("source_url")).alias("kind"))


@query("""
WITH a AS (SELECT item_id, NULLIF(regexp_extract(item_url, '[?&]goods_id=([^&#]*)', 1), '') AS g, NULLIF(json_extract_string(CASE WHEN json_valid(payload) THEN payload END, '$.goods_id'), '') AS n FROM discovery_items)
SELECT item_id, coalesce(g = n, true) AS same FROM a""")
def goods_matches(spark, d):
    node = F.try_variant_get(scalar.strict_json(F.col("payload")), "$.goods_id", "string")
    return load_table(spark, d, "discovery_items").select("item_id", urls.same_goods(F.col("item_url"), node).alias("same"))


@query("SELECT item_id, json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload END) IN ('OBJECT', 'VARCHAR') AS item FROM discovery_items WHERE payload IS NOT NULL")
def item_shapes(spark, d):
    return load_table(spark, d, "discovery_items").filter("payload is not null").select("item_id", scalar.is_item(F.col("payload")).alias("item"))


@query(f"SELECT item_id, page_num FROM discovery_items WHERE page_num <= {urls.PAGE_CEILING}")
def pages_below_ceiling(spark, d):
    return load_table(spark, d, "discovery_items").select("item_id", "page_num").filter(F.col("page_num") <= urls.PAGE_CEILING)


@query("""SELECT item_id, coalesce(NULLIF(json_extract_string(p, '$.title'), ''), 'Website Data Summary') AS title, coalesce(NULLIF(json_extract_string(p, '$.business_type'), ''), 'E-Commerce / Catalog') AS business_type,
  coalesce(NULLIF(json_extract_string(p, '$.summary'), ''), 'Catalog extraction completed successfully.') AS summary, coalesce(NULLIF(json_extract_string(p, '$.estimated_catalog_size'), ''), 'N/A') AS estimated_catalog_size,
  0::INT AS highlights FROM (SELECT item_id, CASE WHEN json_valid(payload) THEN payload END AS p FROM discovery_items)""")
def summary_defaults(spark, d):
    s = load_table(spark, d, "discovery_items").select("item_id", *scalar.summary_fields(F.col("payload")))
    return s.select("item_id", *(n for n, _ in scalar.SUMMARY_DEFAULTS), F.size("key_highlights").alias("highlights"))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(trim(product_name), '') = '') AS missing_title, count(*) FILTER (WHERE coalesce(trim(image_url), '') = '') AS missing_image,
  count(*) FILTER (WHERE coalesce(trim(variants), '') <> '') AS has_variants FROM products""")
def column_audit(spark, d):
    return dataset.column_audit(load_table(spark, d, "products"))


@query("""SELECT raw_id, 2 AS page, 'https://' || source_domain || '/all/' || handle || '/3' AS next_url FROM store_products WHERE handle IS NOT NULL""")
def numbered_pages(spark, d):
    from shelfspark.sources import paging

    s = load_table(spark, d, "store_products").filter("handle is not null")
    link = lambda n: F.concat(F.lit("<li><a href='/all/"), "handle", F.lit(f"/{n}'><b>{n}</b></a></li>"))
    html = F.concat(F.lit("<nav role=navigation><a href='/'>&gt;</a></nav><ul class='x pagination'>"), link(1), F.lit("<li class='active'>2</li>"), link(3), link(4), F.lit("</ul><p class=pages>9</p>"))
    pages = s.select("raw_id", F.concat(F.lit("https://"), "source_domain", F.lit("/all")).alias("url"), html.alias("html"))
    return paging.numbered_links(pages).select("raw_id", F.lit(2).alias("page"), F.col("numbered").alias("next_url"))


_LOW_PATH = f"lower({_PATH.format(u='item_url')})"


@query(f"""
WITH a AS (SELECT item_id, item_url, {_LOW_PATH} AS p, {_QUERY.format(u='item_url')} AS q FROM discovery_items WHERE item_url IS NOT NULL),
b AS (SELECT *, CASE WHEN contains(lower(item_url), 'temu.com') OR contains(p, 'goods.html') THEN 'goods'
  WHEN contains(lower(item_url), 'myshopify.com') OR contains(p, '/collections/') OR ends_with(p, '/products.json') OR starts_with(p, '/cart') OR starts_with(p, '/checkout')
    OR (contains(p, '/products/') AND contains(q, 'variant=')) THEN 'shopify'
  WHEN contains(item_url, '/wp-json/wc/') OR contains(item_url, '/product-category/') THEN 'woocommerce' ELSE 'generic' END AS platform FROM a)
SELECT item_id, platform, CASE platform
  WHEN 'goods' THEN CASE WHEN contains(p, 'goods.html') OR contains(lower(q), 'goods_id=') OR regexp_matches(p, '-g-\\d+\\.html$') THEN 'Product'
    WHEN contains(p, 'search_result.html') OR contains(lower(q), 'search_key=') THEN 'Search' ELSE 'Category / Listing' END
  WHEN 'shopify' THEN CASE WHEN contains(p, '/products/') THEN 'Product' WHEN contains(p, '/collections/') THEN 'Collection' WHEN contains(p, '/search') THEN 'Search' ELSE 'Catalog / Store Root' END
  WHEN 'woocommerce' THEN CASE WHEN contains(p, '/product/') THEN 'Product' WHEN contains(p, '/product-category/') OR contains(p, '/shop') THEN 'Category / Listing' ELSE 'Store Page' END
  ELSE CASE WHEN {_product_path_sql('p')} THEN 'Product'
    WHEN contains(p, '/category/') OR contains(p, '/collection/') OR contains(p, '/collections/') OR contains(p, '/c/') OR contains(p, '/cat/') OR contains(p, '/shop/') OR contains(p, '/catalog/') THEN 'Category / Listing'
    WHEN contains(p, '/search') OR contains(p, 'search_key=') OR contains(p, 'q=') THEN 'Search' ELSE 'General Listing / Catalog' END END AS page_type FROM b""")
def page_classification(spark, d):
    items = load_table(spark, d, "discovery_items").filter("item_url is not null").withColumn("platform", urls.platform(F.col("item_url")))
    return items.select("item_id", "platform", urls.page_type(F.col("item_url"), F.col("platform")).alias("page_type"))


@query(r"""
SELECT row_id, CASE WHEN regexp_extract(source_url, '[?&]page=(\d+)(?:&|$|#)', 1) <> ''
  THEN regexp_replace(source_url, '([?&]page=)\d+', '\1' || CAST(CAST(regexp_extract(source_url, '[?&]page=(\d+)', 1) AS BIGINT) + 1 AS VARCHAR)) END AS next_url
FROM products WHERE source_url IS NOT NULL""")
def next_query_page(spark, d):
    return load_table(spark, d, "products").filter("source_url is not null").select("row_id", urls.next_query_page(F.col("source_url")).alias("next_url"))


@query("SELECT item_id, 'https://' || source_domain || '/en/page/' || CAST(page_num + 1 AS VARCHAR) || '?x=1' AS next_url FROM discovery_items WHERE source_domain IS NOT NULL AND page_num IS NOT NULL")
def next_path_page(spark, d):
    items = load_table(spark, d, "discovery_items").filter("source_domain is not null and page_num is not null")
    url = F.format_string("https://%s/en/page/%d?x=1", "source_domain", "page_num")
    return items.select("item_id", urls.next_path_page(url).alias("next_url"))


@query("SELECT item_id, 'https://' || source_domain || '/all?offset=' || CAST((page_num + 1) * 24 AS VARCHAR) || '&limit=24' AS next_url FROM discovery_items WHERE source_domain IS NOT NULL AND page_num IS NOT NULL")
def next_offset_page(spark, d):
    items = load_table(spark, d, "discovery_items").filter("source_domain is not null and page_num is not null")
    url = F.concat(F.lit("https://"), "source_domain", F.lit("/all?offset="), (F.col("page_num") * 24).cast("string"), F.lit("&limit=24"))
    return items.select("item_id", urls.next_offset_page(url).alias("next_url"))


@query("SELECT item_id, NULLIF(regexp_extract(item_url, '[?&]goods_id=([^&#]*)', 1), '') AS goods_id FROM discovery_items WHERE contains(item_url, 'goods.html')")
def goods_id_of_url(spark, d):
    items = load_table(spark, d, "discovery_items").filter(F.contains("item_url", F.lit("goods.html")))
    return items.select("item_id", urls.goods_id(F.col("item_url")).alias("goods_id"))


@query(r"""SELECT row_id, regexp_replace(source_url, '[?#].*$', '') || '?' || array_to_string(list_concat(list_filter(string_split(regexp_extract(source_url, '^[^?#]*\?([^#]*)', 1), '&'),
  lambda k: k <> '' AND NOT regexp_matches(k, '^page(=|$)')), ['page=7']), '&') AS url7 FROM products WHERE source_url <> ''""")
def page_parameter(spark, d):
    return load_table(spark, d, "products").filter("source_url <> ''").select("row_id", urls.with_page(F.col("source_url"), F.lit(7)).alias("url7"))


# Scalars.


@query(f"SELECT raw_id, {_text_sql('body_html')} AS text FROM store_products")
def html_to_text(spark, d):
    return load_table(spark, d, "store_products").select("raw_id", scalar.html_to_text(F.col("body_html")).alias("text"))


@query(f"SELECT doc_id, {_text_sql('text')} AS plain FROM documents")
def document_text(spark, d):
    return load_table(spark, d, "documents").select("doc_id", scalar.html_to_text(F.col("text")).alias("plain"))


@query(f"SELECT row_id, {_PRICE.format(p='price')} AS amount, {_currency_sql('price')} AS currency_of FROM products")
def price_and_currency(spark, d):
    return load_table(spark, d, "products").select(
        "row_id", scalar.normalize_price(F.col("price")).alias("amount"), scalar.detect_currency(F.col("price")).alias("currency_of")
    )


@query(f"""WITH a AS (SELECT row_id, {_PRICE.format(p='price')} AS p, {_PRICE.format(p='original_price')} AS o FROM products)
SELECT row_id, {_discount_sql('o', 'p')} AS discount FROM a""")
def discount_percent(spark, d):
    p = load_table(spark, d, "products")
    return p.select("row_id", scalar.discount_percentage(scalar.normalize_price(F.col("original_price")), scalar.normalize_price(F.col("price"))).alias("discount"))


@query(f"""WITH a AS (SELECT row_id, {_PRICE.format(p='price')} AS p, {_PRICE.format(p='sale_price')} AS s, {_PRICE.format(p='original_price')} AS o FROM products)
SELECT row_id, CASE WHEN o > p THEN p WHEN o > s THEN s ELSE coalesce(p, s) END AS price, CASE WHEN o > p THEN p WHEN o > s THEN s END AS sale_price,
  CASE WHEN o > p OR o > s THEN o END AS original_price FROM a""")
def price_relation(spark, d):
    p = load_table(spark, d, "products")
    r = scalar.price_relation(*(scalar.normalize_price(F.col(c)) for c in ("price", "sale_price", "original_price")))
    return p.select("row_id", r.alias("r")).select("row_id", "r.price", "r.sale_price", "r.original_price")


@query("SELECT row_id, CASE WHEN length(price) > 3 AND NOT contains(price, '.') THEN try_cast(price AS DOUBLE) / 100 ELSE try_cast(price AS DOUBLE) END AS amount FROM products WHERE regexp_matches(price, '^[0-9]+(\\.[0-9]+)?$')")
def minor_units(spark, d):
    p = load_table(spark, d, "products").filter(F.col("price").rlike(r"^[0-9]+(\.[0-9]+)?$"))
    return p.select("row_id", scalar.minor_units(F.col("price")).alias("amount"))


@query()
def minor_units_every_row(spark, d):
    """The same over every price. SQL is left out; a fixture is tested by brute force."""
    return load_table(spark, d, "products").select("row_id", scalar.minor_units(F.col("price")).alias("amount"))


_FABRIC_LIST = "[" + ", ".join(f"'{f}'" for f in scalar.FABRICS) + "]"


@query(f"""SELECT row_id, coalesce(array_to_string(list_filter({_FABRIC_LIST}, lambda f: contains(lower(coalesce(description, '')), lower(f))), ', '), '') AS material_of,
  CASE WHEN regexp_matches(lower(coalesce(tags, '')), '3 pc|3-piece|3pc|3 piece') THEN '3 Piece' WHEN regexp_matches(lower(coalesce(tags, '')), '2 pc|2-piece|2pc|2 piece') THEN '2 Piece'
  WHEN regexp_matches(lower(coalesce(tags, '')), '1 pc|1-piece|1pc|1 piece') THEN '1 Piece' ELSE '' END AS pieces_of FROM products""")
def material_and_pieces(spark, d):
    p = load_table(spark, d, "products")
    return p.select("row_id", scalar.material(F.col("description")).alias("material_of"), scalar.pieces(F.col("tags")).alias("pieces_of"))


@query(r"""SELECT row_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace('Top pick ' || product_name || ' Opens in new tab.', '(?i)^\s*top pick\s*', ''),
  '(?i)\s*opens? in (?:a )?new tab\.?\s*$', ''), '\s+', ' ', 'g'), '^[ ,|\-]+|[ ,|\-]+$', '', 'g') AS title_of FROM products WHERE regexp_matches(product_name, '^[ -~]+$')""")
def anchor_title(spark, d):
    p = load_table(spark, d, "products").filter(F.col("product_name").rlike(r"^[ -~]+$"))
    return p.select("row_id", scalar.clean_anchor_title(F.concat(F.lit("Top pick "), "product_name", F.lit(" Opens in new tab."))).alias("title_of"))


@query()
def anchor_title_every_row(spark, d):
    """The same over every name, in any script and with any white space, which SQL can't follow."""
    name = F.concat(F.lit("Top pick "), "product_name", F.lit(" Opens in new tab."))
    return load_table(spark, d, "products").select("row_id", scalar.clean_anchor_title(name).alias("title_of"))


@query(r"SELECT row_id, list_filter(list_transform(string_split(tags, ','), lambda t: regexp_replace(t, '^\s+|\s+$', '', 'g')), lambda t: t <> '') AS tag_list FROM products WHERE tags IS NOT NULL")
def tag_list(spark, d):
    return load_table(spark, d, "products").filter("tags is not null").select("row_id", scalar.tag_list(F.col("tags")).alias("tag_list"))


@query("""SELECT row_id, CASE WHEN coalesce(colors, '') = '' THEN 0 WHEN starts_with(colors, '[') THEN CASE WHEN json_valid(colors) THEN CAST(json_array_length(colors) AS INT) ELSE 1 END
  WHEN contains(colors, '||') THEN CAST(len(string_split(colors, '||')) AS INT) ELSE 1 END AS entries FROM products""")
def packed_count(spark, d):
    return load_table(spark, d, "products").select("row_id", scalar.variant_count(F.col("colors")).alias("entries"))


@query("SELECT doc_id, CASE WHEN length(text) > 4000 THEN substring(text, 1, 4000) || chr(10) || '... [truncated]' ELSE text END AS short FROM documents")
def truncate_text(spark, d):
    return load_table(spark, d, "documents").select("doc_id", scalar.truncate_text(F.col("text")).alias("short"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def answer_json(spark, d):
    e = load_table(spark, d, "events")
    answer = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here: "), "props", F.lit(" done"))).otherwise(F.col("props"))
    return e.select("event_id", F.get_json_object(scalar.answer_object(answer), "$.k").alias("k"))


@query("""SELECT failure_id, CASE WHEN status_code = 429 THEN 'http_429' WHEN status_code >= 500 THEN 'http_' || CAST(status_code AS VARCHAR)
  WHEN status_code >= 400 THEN 'client_error_' || CAST(status_code AS VARCHAR) WHEN status_code IS NOT NULL THEN '' END AS reason_of FROM failures""")
def fetch_reason(spark, d):
    return load_table(spark, d, "failures").select("failure_id", scalar.fetch_reason(F.col("status_code")).alias("reason_of"))


@query("""SELECT failure_id, attempt, 1.5::DOUBLE * attempt + CASE WHEN status_code = 429 THEN 1.5::DOUBLE * power(2, attempt) ELSE 0 END AS seconds
FROM failures, (SELECT unnest([1, 2, 3]) AS attempt)""")
def retry_schedule(spark, d):
    f = load_table(spark, d, "failures").select("failure_id", "status_code", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("attempt"))
    return f.select("failure_id", "attempt", scalar.retry_delay(F.col("attempt"), F.lit(1.5), F.coalesce("status_code", F.lit(0))).alias("seconds"))


@query("""SELECT failure_id, CASE failure_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'iso-8859-1' WHEN 2 THEN NULL ELSE 'windows-1252' END AS charset FROM failures""")
def header_charset(spark, d):
    f = load_table(spark, d, "failures")
    header = F.when(F.col("failure_id") % 4 == 0, "text/html; charset=UTF-8").when(F.col("failure_id") % 4 == 1, 'text/html;charset="ISO-8859-1"').when(F.col("failure_id") % 4 == 2, "text/html").otherwise("text/html; Charset=windows-1252; x=1")
    return f.select("failure_id", scalar.header_charset(header).alias("charset"))


@query("SELECT page_num, count(*) AS items, CAST(greatest(2, least(5, ceil(page_num * 10 / 24.0))) AS INT) AS ceiling FROM discovery_items WHERE page_num IS NOT NULL GROUP BY page_num")
def page_ceiling(spark, d):
    items = load_table(spark, d, "discovery_items").filter("page_num is not null").groupBy("page_num").agg(F.count("*").alias("items"))
    return items.select("page_num", "items", scalar.bounded_pages(F.col("page_num") * 10, F.lit(24)).alias("ceiling"))


@query(r"""
WITH a AS (SELECT row_id, list_filter(list_transform(string_split(all_images, '|'), lambda u: regexp_replace(CASE WHEN starts_with(trim(u), '//') THEN 'https:' || trim(u) ELSE trim(u) END, '_[0-9]+x[0-9]*\.(jpg|png|webp|jpeg)', '.\1', 'g')), lambda u: u <> '') AS l
  FROM products WHERE regexp_matches(all_images, '^(https?:)?//[^ ,;"''\[\]]+$') AND NOT contains(all_images, '、') AND NOT contains(all_images, '｜') AND NOT regexp_matches(all_images, '\s')),
b AS (SELECT row_id, list_filter(l, lambda u, i: list_position(list_transform(l, lambda x: string_split(x, '?')[1]), string_split(u, '?')[1]) = i) AS l FROM a)
SELECT row_id, l[1] AS main_image, array_to_string(l[2:], '|') AS additional_images, array_to_string(l, '|') AS all_images FROM b""")
def image_lists(spark, d):
    p = load_table(spark, d, "products").filter(F.col("all_images").rlike(r"^(https?:)?//[^ ,;\"'\[\]、｜\s]+$"))
    shown = image_fields(F.split("all_images", r"\|"), F.lit("https://x.example"))
    return p.select("row_id", shown.alias("i")).select("row_id", "i.main_image", "i.additional_images", "i.all_images")


@query()
def image_lists_every_row(spark, d):
    """The same over every row, however its images are packed, which SQL can't follow; rows without an image have blanks."""
    p = load_table(spark, d, "products").select("row_id", "all_images")
    placed = F.array_sort(F.collect_list(F.struct("item_pos", "item_value")))
    lists = split_values(p, "row_id", ["all_images"]).groupBy("row_id").agg(F.transform(placed, lambda x: x["item_value"]).alias("listed"))
    shown = image_fields(F.col("listed"), F.lit("https://x.example"))
    return p.select("row_id").join(lists, "row_id", "left").select("row_id", shown.alias("i")).select("row_id", "i.main_image", "i.additional_images", "i.all_images")


# Records.


@query(f"""
WITH a AS (SELECT *, {_PRICE.format(p='trim(price)')} AS p, {_PRICE.format(p='trim(sale_price)')} AS s, coalesce({_PRICE.format(p='trim(original_price)')}, {_PRICE.format(p='trim(list_price)')}, {_PRICE.format(p='trim(compare_at_price)')}) AS o FROM products)
SELECT row_id, coalesce(NULLIF(trim(product_name), ''), NULLIF(trim(title), ''), '') AS product_name, coalesce(NULLIF(trim(brand), ''), NULLIF(trim(vendor), ''), '') AS brand,
  coalesce(NULLIF(trim(seller), ''), NULLIF(trim(vendor), ''), NULLIF(trim(brand), ''), '') AS seller,
  CASE WHEN o > p THEN p WHEN o > s THEN s ELSE coalesce(p, s) END AS price, CASE WHEN o > p OR o > s THEN o END AS list_price,
  CASE WHEN o > p THEN {_discount_sql('o', 'p')} WHEN o > s THEN {_discount_sql('o', 's')} ELSE '' END AS discount_percentage,
  coalesce(NULLIF(trim(availability), ''), NULLIF(trim(stock_status), ''), '') AS availability, variant_count FROM a""")
def normalized_records(spark, d):
    n = normalize_records(load_table(spark, d, "products"), keep=("row_id",))
    return n.select("row_id", "product_name", "brand", "seller", "price", "list_price", "discount_percentage", "availability", "variant_count")


_VP = r"try_cast(replace(regexp_extract(v.price, '(\d[\d,]*(?:\.\d+)?)', 1), ',', '') AS DOUBLE)"
_VC = r"try_cast(replace(regexp_extract(v.compare_at_price, '(\d[\d,]*(?:\.\d+)?)', 1), ',', '') AS DOUBLE)"


@query(f"""
WITH a AS (SELECT raw_id, title, currency, price_currency, coalesce(list_transform(variants, lambda v: {{'p': {_VP}, 'c': {_VC}, 's': coalesce(v.sku, ''), 'a': coalesce(v.available, true), 'cur': NULLIF(v.price_currency, '')}}), []) AS l FROM store_products),
b AS (SELECT *, l[greatest(coalesce(list_position(list_transform(l, lambda x: x.a), true), 1), 1)] AS c, list_filter(list_transform(l, lambda x: x.p), lambda p: p IS NOT NULL) AS ps FROM a)
SELECT raw_id, coalesce(trim(title), '') AS product_name, c.p AS price, CASE WHEN c.c > c.p THEN c.c END AS original_price, coalesce(c.s, '') AS sku,
  coalesce(list_filter(list_transform(l, lambda x: x.cur), lambda u: u IS NOT NULL)[1], NULLIF(price_currency, ''), NULLIF(currency, ''), '') AS currency,
  CASE WHEN len(list_filter(l, lambda x: x.a)) > 0 THEN 'In Stock' ELSE 'Out of Stock' END AS availability, CAST(len(l) AS INT) AS variant_count,
  list_min(ps) AS low, list_max(ps) AS high FROM b""")
def storefront_records(spark, d):
    raw = load_table(spark, d, "store_products")
    r = storefront.product_records(raw, keep=("raw_id",))
    prices = F.array_compact(F.transform("variants", lambda v: v["variant_price"]))
    return r.select("raw_id", "product_name", "price", "original_price", "sku", "currency", "availability", "variant_count", F.array_min(prices).alias("low"), F.array_max(prices).alias("high"))


@query("""
WITH v AS (SELECT raw_id, images, unnest(variants) AS v FROM store_products)
SELECT raw_id, CAST(v.id AS VARCHAR) AS variant_id, coalesce(v.sku, '') AS variant_sku, CASE WHEN coalesce(v.available, true) THEN 'In Stock' ELSE 'Out of Stock' END AS variant_availability,
  coalesce(list_filter(images, lambda i: i.id = v.image_id)[1].src, v.featured_image.src, '') AS variant_image FROM v""")
def storefront_variants(spark, d):
    r = storefront.product_records(load_table(spark, d, "store_products"), keep=("raw_id",))
    return r.select("raw_id", F.inline("variants")).select("raw_id", "variant_id", "variant_sku", "variant_availability", "variant_image")


@query("""
WITH v AS (SELECT raw_id, options, unnest(variants) AS v FROM store_products), o AS (SELECT raw_id, v, list_filter(options, lambda o: regexp_matches(lower(o.name), 'size')) AS s FROM v),
z AS (SELECT raw_id, CASE WHEN len(s) > 0 THEN CASE coalesce(s[-1].position, 1) WHEN 1 THEN v.option1 WHEN 2 THEN v.option2 WHEN 3 THEN v.option3 END END AS x, upper(trim(v.title)) AS t FROM o),
y AS (SELECT raw_id, coalesce(NULLIF(x, ''), CASE WHEN t IN ('S','M','L','XL','XXL','SMALL','MEDIUM','LARGE','2XL','3XL') THEN t END, '') AS size FROM z)
SELECT p.raw_id, coalesce((SELECT string_agg(DISTINCT size, '|' ORDER BY size) FROM y WHERE y.raw_id = p.raw_id AND size <> ''), '') AS sizes FROM store_products p""")
def storefront_sizes(spark, d):
    return storefront.product_records(load_table(spark, d, "store_products"), keep=("raw_id",)).select("raw_id", "sizes")


@query("""SELECT item_id, json_extract_string(payload, '$.product_name') AS product_name, json_extract_string(payload, '$.product_url') AS product_url, json_extract_string(payload, '$.goods_id') AS goods_id
FROM discovery_items WHERE json_valid(payload)""")
def payload_fields(spark, d):
    items = load_table(spark, d, "discovery_items").withColumn("v", scalar.strict_json(F.col("payload"))).filter("v is not null")
    return items.select("item_id", *(F.try_variant_get("v", f"$.{c}", "string").alias(c) for c in ("product_name", "product_url", "goods_id")))


@query("""SELECT item_id, coalesce(NULLIF(json_extract_string(CASE WHEN json_valid(payload) THEN payload END, '$.product_url'), ''), NULLIF(item_url, ''), '') AS url,
  substring(coalesce(NULLIF(json_extract_string(CASE WHEN json_valid(payload) THEN payload END, '$.product_name'), ''), NULLIF(item_url, ''), ''), 1, 80) AS label FROM discovery_items""")
def item_labels(spark, d):
    v = scalar.strict_json(F.col("payload"))
    url, name = F.try_variant_get(v, "$.product_url", "string"), F.try_variant_get(v, "$.product_name", "string")
    return load_table(spark, d, "discovery_items").select(
        "item_id", F.coalesce(scalar.first_filled(url, F.col("item_url")), F.lit("")).alias("url"), F.substring(F.coalesce(scalar.first_filled(name, F.col("item_url")), F.lit("")), 1, 80).alias("label")
    )


# Whole tables.


@query("""SELECT * FROM (SELECT row_id, source_domain, product_id FROM (SELECT *, row_number() OVER (PARTITION BY source_domain, product_id ORDER BY row_id) AS rn FROM products
  WHERE coalesce(product_id, '') <> '') WHERE rn = 1) UNION ALL SELECT row_id, source_domain, product_id FROM products WHERE coalesce(product_id, '') = ''""")
def dedupe_keep_first(spark, d):
    p = load_table(spark, d, "products").select("row_id", "source_domain", "product_id")
    key = F.when(F.coalesce("product_id", F.lit("")) != "", F.struct("source_domain", "product_id"))
    return dataset.keep_first(p, key, "row_id")


@query("""SELECT count(*) AS rows_in, count(DISTINCT NULLIF(item_url, '')) + count(*) FILTER (WHERE coalesce(item_url, '') = '') AS rows_kept,
  count(*) - count(DISTINCT NULLIF(item_url, '')) - count(*) FILTER (WHERE coalesce(item_url, '') = '') AS duplicates FROM discovery_items""")
def duplicates_removed(spark, d):
    return dataset.duplicates_removed(load_table(spark, d, "discovery_items"), dataset.record_key("item_url"))


@query("SELECT min(item_id) AS item_id, item_key FROM discovery_items WHERE item_key <> '' GROUP BY item_key")
def dedupe_drop_blank(spark, d):
    items = load_table(spark, d, "discovery_items").select("item_id", "item_key")
    return dataset.keep_first(items, dataset.record_key("item_key"), "item_id", keep_blank=False)


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY product_url ORDER BY row_id) AS r FROM products WHERE product_url <> ''),
b AS (SELECT row_id, product_url, product_name FROM a WHERE r = 1 UNION ALL SELECT row_id, product_url, product_name FROM products WHERE coalesce(product_url, '') = ''),
c AS (SELECT *, row_number() OVER (PARTITION BY product_name ORDER BY row_id) AS r FROM b WHERE product_name <> '')
SELECT row_id, product_url, product_name FROM c WHERE r = 1 UNION ALL SELECT row_id, product_url, product_name FROM b WHERE coalesce(product_name, '') = ''""")
def dedupe_cards(spark, d):
    return dataset.keep_first_cards(load_table(spark, d, "products").select("row_id", "product_url", "product_name"), "product_url", "product_name", "row_id")


@query("SELECT item_id, item_url FROM discovery_items ORDER BY item_id LIMIT 10")
def max_products(spark, d):
    return dataset.first_records(load_table(spark, d, "discovery_items").select("item_id", "item_url"), ["item_id"], 10)


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 40")
def bounded_log(spark, d):
    return dataset.last_of_each(load_table(spark, d, "events"), "user_id", ["ts", "event_id"], 40).select("event_id", "user_id", "event_type")


@query("SELECT item_id, item_key FROM discovery_items i WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.product_id = i.item_key)")
def resume_skip(spark, d):
    items = load_table(spark, d, "discovery_items").select("item_id", "item_key")
    return dataset.resume_skip(items, load_table(spark, d, "products").select(F.col("product_id").alias("item_key")).filter("item_key is not null"), "item_key")


@query("SELECT row_id, CAST(0 AS INT) AS part FROM products WHERE row_id % 2 = 0 UNION ALL SELECT row_id, CAST(1 AS INT) AS part FROM products WHERE row_id % 2 = 1")
def resume_merge(spark, d):
    p = load_table(spark, d, "products").select("row_id")
    return dataset.resume_merge(p.filter("row_id % 2 = 0"), p.filter("row_id % 2 = 1"), True)


@query("""WITH t AS (SELECT DISTINCT raw_id, source_domain, lower(replace(trim(unnest(tags)), ' ', '-')) AS handle FROM store_products)
SELECT t.raw_id, string_agg(c.title, ', ' ORDER BY c.handle, c.title) AS collection FROM t JOIN collections c USING (source_domain, handle) GROUP BY t.raw_id""")
def collection_lookup(spark, d):
    return dataset.collection_titles(load_table(spark, d, "store_products"), load_table(spark, d, "collections"), "raw_id", "tags")


@query("""SELECT source_domain, handle, title FROM (SELECT *, row_number() OVER (PARTITION BY source_domain ORDER BY handle, title) AS r FROM collections
  WHERE contains(lower(title), 'kit') OR contains(lower(handle), 'kit')) WHERE r = 1""")
def matching_collections(spark, d):
    return dataset.matching_collections(load_table(spark, d, "collections"), "kit")


@query("SELECT i.item_id, s.store_currency FROM discovery_items i LEFT JOIN (SELECT source_domain, min(store_currency) AS store_currency FROM shops GROUP BY 1) s USING (source_domain)")
def store_currency(spark, d):
    return dataset.store_lookup(load_table(spark, d, "discovery_items").select("item_id", "source_domain"), load_table(spark, d, "shops"), "store_currency").select("item_id", "store_currency")


_B = "coalesce(trim({0}), '') = ''"


@query(f"""SELECT count(*) AS total, count(*) FILTER (WHERE {_B.format('product_name')} AND {_B.format('title')}) AS missing_title, count(*) FILTER (WHERE {_B.format('price')}) AS missing_price,
  count(*) FILTER (WHERE {_B.format('description')}) AS missing_description, count(*) FILTER (WHERE {_B.format('main_image')} AND {_B.format('image_url')}) AS missing_image,
  count(*) FILTER (WHERE {_B.format('category')}) AS missing_category, count(*) FILTER (WHERE {_B.format('sku')}) AS missing_sku, count(*) FILTER (WHERE variant_count > 0) AS has_variants FROM products""")
def integrity_audit(spark, d):
    return dataset.integrity_audit(load_table(spark, d, "products"))


@query("""SELECT (SELECT count(*) FROM discovery_items) AS discovered, (SELECT count(DISTINCT NULLIF(sku, '')) + count(*) FILTER (WHERE coalesce(sku, '') = '') FROM products) AS scraped,
  (SELECT count(*) - count(DISTINCT NULLIF(sku, '')) - count(*) FILTER (WHERE coalesce(sku, '') = '') FROM products) AS duplicates_removed, (SELECT count(*) FROM failures) AS failed""")
def run_stats(spark, d):
    return dataset.run_stats(*(load_table(spark, d, t) for t in ("discovery_items", "products", "failures")), dataset.record_key("sku"))


@query("""WITH g AS (SELECT source_domain, product_type, count(*) AS members, min(row_id) AS first_position FROM products GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT source_domain, product_type, members, first_position FROM (SELECT *, row_number() OVER (PARTITION BY source_domain ORDER BY first_position) AS r FROM g) WHERE r = 1""")
def class_grouping(spark, d):
    return dataset.largest_early_class(load_table(spark, d, "products"), "source_domain", "product_type", "row_id")


@query("""SELECT (SELECT count(*) FROM products) AS records, (SELECT string_agg('Name: ' || coalesce(product_name, '') || ' | Price: ' || coalesce(price, ''), chr(10) ORDER BY row_id)
  FROM (SELECT * FROM products ORDER BY row_id LIMIT 20)) AS summary""")
def catalog_summary(spark, d):
    return dataset.catalog_summary(load_table(spark, d, "products"), {"product_name": "Name", "price": "Price"}, "row_id")


@query("SELECT row_id, '' AS main_image, '' AS description, variants, variant_count FROM products")
def field_toggles(spark, d):
    p = load_table(spark, d, "products").select("row_id", "main_image", "description", "variants", "variant_count")
    return dataset.blank_fields(p, images=False, descriptions=False)


@query("SELECT coalesce(source_domain, '') AS source_domain, coalesce(sku, '') AS sku, '' AS gtin, coalesce(brand, '') AS brand, CAST(row_id AS VARCHAR) AS row_id FROM products")
def export_projection(spark, d):
    p = load_table(spark, d, "products").select("row_id", "brand", "sku", "source_domain")
    return sinks.export_frame(p, ("source_domain", "sku", "gtin"))


@query("SELECT product_url, reason, status_code, failed_at AS timestamp, stage FROM failures")
def failure_log(spark, d):
    return sinks.failure_log(load_table(spark, d, "failures"))


@query("""WITH t AS (SELECT source_domain, page_num, item_id, CASE WHEN payload IS NOT NULL THEN 0 WHEN item_key IS NOT NULL THEN 1 ELSE 2 END AS rank FROM discovery_items)
SELECT source_domain, page_num, item_id, rank FROM (SELECT *, min(rank) OVER (PARTITION BY source_domain, page_num) AS best FROM t) WHERE rank = best""")
def strategy_fallback(spark, d):
    rank = F.when(F.col("payload").isNotNull(), 0).when(F.col("item_key").isNotNull(), 1).otherwise(2)
    items = load_table(spark, d, "discovery_items").select("source_domain", "page_num", "item_id", rank.alias("rank"), F.concat_ws("|", "source_domain", "page_num").alias("_page"))
    return dataset.first_strategy(items, "_page", "rank").drop("_page")


@query("""SELECT failure_id AS id, 'failure' AS kind, product_url AS url FROM failures UNION ALL SELECT item_id AS id, 'item' AS kind, item_url AS url FROM discovery_items""")
def union_results(spark, d):
    a = load_table(spark, d, "failures").select(F.col("failure_id").alias("id"), F.lit("failure").alias("kind"), F.col("product_url").alias("url"))
    b = load_table(spark, d, "discovery_items").select(F.col("item_id").alias("id"), F.lit("item").alias("kind"), F.col("item_url").alias("url"))
    return dataset.union_pages([a, b])


@query("SELECT item_id, 'invalid_payload' AS reason FROM discovery_items WHERE payload IS NOT NULL AND NOT json_valid(CASE WHEN item_id % 7 = 0 THEN substring(payload, 2) ELSE payload END)")
def dead_letters(spark, d):
    items = load_table(spark, d, "discovery_items").filter("payload is not null")
    broken = F.when(F.col("item_id") % 7 == 0, F.substring("payload", 2, 2147483647)).otherwise(F.col("payload"))
    _, dead = dataset.split_failures(items.select("item_id", scalar.strict_json(broken).alias("v")), "v", "invalid_payload")
    return dead.select("item_id", "reason")


# Markup, built from the tables since they hold no pages.


def _pages(spark: SparkSession, d: str) -> DataFrame:
    s = load_table(spark, d, "store_products").filter("handle is not null")
    ld = F.to_json(F.struct(
        F.lit("Product").alias("@type"), F.col("title").alias("name"), F.get("variants", 0)["sku"].alias("sku"), F.struct(F.col("vendor").alias("name")).alias("brand"),
        F.array(F.struct(F.get("variants", 0)["price"].alias("price"), F.col("currency").alias("priceCurrency"), F.lit("https://schema.org/InStock").alias("availability"))).alias("offers"),
    ))
    url = F.concat(F.lit("https://"), "source_domain", F.lit("/products/"), "handle")
    state = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("id").cast("string").alias("goodsId"), F.concat(F.col("handle"), F.lit(' {"}')).alias("title"))).alias("goodsList")).alias("store")))
    html = F.concat(
        F.lit("<html><head><title>x</title><script type='application/ld+json'>{\"@graph\": ["), ld, F.lit("]}</script><meta property='og:title' content='"), "handle",
        F.lit("'><meta content='12.50' property='product:price:amount'></head><body><script>window.rawData = "), state, F.lit("; var x = {};</script><div class='product-card'><a href='/products/"), "handle",
        F.lit("?utm_source=x#top'><img src='/i/a_100x100.jpg'></a><h3 class='card-title'>Item "), F.col("raw_id").cast("string"), F.lit("</h3><span class='price'>$5</span></div></body></html>"),
    )
    return s.select("raw_id", url.alias("page"), html.alias("html"), F.concat(url, F.lit("?r="), F.col("raw_id").cast("string")).alias("url"))


@query(r"""SELECT raw_id, coalesce(title, '') AS product_name, coalesce(vendor, '') AS brand, coalesce(variants[1].sku, '') AS sku,
  try_cast(replace(regexp_extract(variants[1].price, '(\d[\d,]*(?:\.\d+)?)', 1), ',', '') AS DOUBLE) AS price, coalesce(currency, '') AS currency, 'In Stock' AS availability FROM store_products WHERE handle IS NOT NULL""")
def jsonld_products(spark, d):
    from shelfspark.sources import markup

    p = markup.json_ld_products(markup.json_ld_nodes(_pages(spark, d)))
    return p.select(F.regexp_extract("url", r"r=(\d+)$", 1).cast("bigint").alias("raw_id"), "product_name", "brand", "sku", "price", "currency", "availability")


@query("SELECT raw_id, handle AS product_name, 12.5::DOUBLE AS price FROM store_products WHERE handle IS NOT NULL")
def meta_products(spark, d):
    from shelfspark.sources import markup

    m = _pages(spark, d).select("raw_id", markup.meta_product(F.col("html"), F.col("url")).alias("m"))
    return m.select("raw_id", "m.product_name", "m.price")


@query("""SELECT raw_id, CAST(id AS VARCHAR) AS goods_id, handle || ' {"}' AS product_name, 'https://www.temu.com/goods.html?goods_id=' || CAST(id AS VARCHAR) AS product_url FROM store_products WHERE handle IS NOT NULL AND id IS NOT NULL""")
def window_goods(spark, d):
    from shelfspark.sources import markup

    states = markup.window_state(_pages(spark, d), "rawData", keep=("raw_id",)).select("raw_id", F.to_json("state").alias("t"))
    nodes = markup.sweep_nodes(states, ("raw_id",), "t", "goods")
    return storefront.goods_records(nodes, "node", keep=("raw_id",)).select("raw_id", "goods_id", "product_name", "product_url")


@query("""SELECT raw_id, 'Item ' || CAST(raw_id AS VARCHAR) AS product_name, '$5' AS price, 'https://' || source_domain || '/products/' || handle AS product_url,
  'https://' || source_domain || '/i/a_100x100.jpg' AS image_url, CAST(95 AS INT) AS score FROM store_products WHERE handle IS NOT NULL""")
def product_cards(spark, d):
    from shelfspark.sources import markup

    c = markup.product_cards(_pages(spark, d))
    return c.select(F.regexp_extract("url", r"r=(\d+)$", 1).cast("bigint").alias("raw_id"), "product_name", "price", "product_url", "image_url", "score")


@query("SELECT raw_id, 'https://' || source_domain || '/products/' || handle AS item_url FROM store_products WHERE handle IS NOT NULL")
def page_links(spark, d):
    from shelfspark.sources import markup

    found = markup.links(_pages(spark, d))
    return found.select(F.regexp_extract("url", r"r=(\d+)$", 1).cast("bigint").alias("raw_id"), "item_url")


@query()
def stream_first_arrivals(spark, d):
    """Items as a stream, kept first by key. The result is the durable table that the batches wrote."""
    from shelfspark.session import scratch_path
    from shelfspark.streaming import pipeline

    root = scratch_path(spark, "stream")
    items = load_table(spark, d, "discovery_items").select("item_id", "item_key", "arrived_at")
    items.repartitionByRange(4, "arrived_at").write.parquet(f"{root}/landed")
    stream = pipeline.read_stream(spark, f"{root}/landed", items)
    pipeline.run_to_table(pipeline.first_arrivals(stream, "item_key", "arrived_at", "400 days"), f"{root}/table", f"{root}/state")
    return spark.read.parquet(f"{root}/table").select("item_id", "item_key")
