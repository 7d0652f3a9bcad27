"""Scalar functions on scraped values as native column expressions.

Missing is null inside and blank only at the sinks. Every function gives null or a blank for null input, as stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fabrics in the order in which they are reported.
FABRICS = (
    "Arabic Lawn", "Lawn", "Chiffon", "Linen", "Cotton", "Voile", "Organza", "Khaddar", "Silk", "Velvet", "Grip", "Jacquard", "Polyester",
    "Spandex", "Denim", "Wool", "Satin", "Rayon", "Fleece",
)
# Currency signs and codes in the order in which they are looked for, as text of capitals.
CURRENCY_SIGNS = (
    ("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("₹", "INR"), ("¥", "JPY"), ("RS.", "PKR"), ("RS", "PKR"), ("PKR", "PKR"), ("USD", "USD"),
    ("EUR", "EUR"), ("GBP", "GBP"), ("INR", "INR"), ("CAD", "CAD"), ("AUD", "AUD"),
)
# Sizes that a variant's title may consist of.
TITLE_SIZES = ("S", "M", "L", "XL", "XXL", "SMALL", "MEDIUM", "LARGE", "2XL", "3XL")
# Elements whose content is no text of the product.
NOISE_ELEMENTS = "script|style|noscript|nav|footer|aside|form|svg|iframe"
# White space, with that beyond ASCII.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
# Entities that shop pages use, the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def strict_json(text: Column) -> Column:
    """VARIANT of a text that is one JSON value throughout; null if anything follows it."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.try_variant_get(wrapped, "$[1]", "string").isNull(), F.try_variant_get(wrapped, "$[0]", "variant"))


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def filled(text: Column) -> Column:
    """Null for blank text."""
    return F.nullif(text, F.lit(""))


def first_filled(*texts: Column) -> Column:
    """The first text that isn't null or empty; null if none."""
    return F.coalesce(*(filled(t) for t in texts))


def normalize_price(text: Column) -> Column:
    """The first number of a price text, before ``" - "``, without thousands commas; null if there is none."""
    low = F.substring_index(trim_all(text), " - ", 1)
    return F.replace(F.regexp_extract(low, r"(\d[\d,]*(?:\.\d+)?)", 1), F.lit(","), F.lit("")).try_cast("double")


def detect_currency(text: Column) -> Column:
    """Code of the first sign, in fixed order, that the text contains; blank if none or null."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    out = F.lit("")
    for sign, code in reversed(CURRENCY_SIGNS):
        out = F.when(F.contains(upper, F.lit(sign)), F.lit(code)).otherwise(out)
    return out


def discount_percentage(original: Column, sale: Column) -> Column:
    """Whole percents (half to even) with a sign where original > sale > 0, else blank."""
    percent = F.bround((original - sale) / original * 100).cast("int")
    return F.when((original > sale) & (sale > 0), F.concat(percent.cast("string"), F.lit("%"))).otherwise(F.lit(""))


def minor_units(text: Column) -> Column:
    """A store interface's amount: more than three characters without a point are hundredths."""
    number = normalize_price(text)
    return F.when((F.length(text) > 3) & ~F.contains(text, F.lit(".")), number / 100).otherwise(number)


def material(text: Column) -> Column:
    lower = F.lower(F.coalesce(text, F.lit("")))
    names = F.array(*(F.lit(f) for f in FABRICS))
    return F.array_join(F.filter(names, lambda f: F.contains(lower, F.lower(f))), ", ")


def pieces(text: Column) -> Column:
    lower = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("")
    for n in (1, 2, 3):
        out = F.when(lower.rlike(f"{n} pc|{n}-piece|{n}pc|{n} piece"), F.lit(f"{n} Piece")).otherwise(out)
    return out


def html_to_text(html: Column) -> Column:
    """Lines and list items of the visible text, joined by a bar; blank for null."""
    t = F.coalesce(html, F.lit(""))
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</p>", "\n")
    t = F.regexp_replace(t, r"(?i)</li>|</tr>", " | ")
    t = F.regexp_replace(t, r"(?i)<li[^>]*>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, rf"(?is)<({NOISE_ELEMENTS})\b.*?</({NOISE_ELEMENTS})\s*>", "")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for entity, plain in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(plain))
    t = F.regexp_replace(t, r"[\r\n]+", "|")
    t = F.regexp_replace(t, r"(\s*\|\s*)+", " | ")
    return F.regexp_replace(t, r"^[ |]+|[ |]+$", "")


def variant_count(text: Column) -> Column:
    """Entries of a JSON array, parts between doubled bars, or one for other text; zero for none."""
    return (
        F.when(F.coalesce(text, F.lit("")) == "", 0)
        .when(text.startswith("["), F.when(strict_json(text).isNotNull(), F.json_array_length(text)).otherwise(1))
        .when(F.contains(text, F.lit("||")), F.size(F.split(text, r"\|\|")))
        .otherwise(1)
        .cast("int")
    )


def price_relation(price: Column, sale: Column, original: Column) -> Column:
    """struct(price, sale_price, original_price, discount_percentage): a sale only where the original is higher."""
    none = F.lit(None).cast("double")

    def row(p: Column, s: Column, o: Column, d: Column) -> Column:
        return F.struct(p.alias("price"), s.alias("sale_price"), o.alias("original_price"), d.alias("discount_percentage"))

    return (
        F.when(original > price, row(price, price, original, discount_percentage(original, price)))
        .when(original > sale, row(sale, sale, original, discount_percentage(original, sale)))
        .otherwise(row(F.coalesce(price, sale), none, none, F.lit("")))
    )


def clean_anchor_title(text: Column) -> Column:
    """Link text without the badge before it and the hint behind it; any white space, of any script, counts as one space."""
    t = F.regexp_replace(text, rf"(?i)^{SPACE}*top{SPACE}*pick{SPACE}*", "")
    t = F.regexp_replace(t, rf"(?i){SPACE}*opens?{SPACE}+in{SPACE}+(?:a{SPACE}+)?new{SPACE}+tab\.?{SPACE}*$", "")
    t = F.regexp_replace(t, rf"{SPACE}+", " ")
    return F.regexp_replace(t, r"^[ ,|\-]+|[ ,|\-]+$", "")


def tag_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), trim_all), lambda t: t != "")


def size_from_title(title: Column) -> Column:
    upper = F.upper(trim_all(title))
    return F.when(upper.isin(*TITLE_SIZES), upper).otherwise(F.lit(""))


def stock_from_address(address: Column) -> Column:
    return F.when(F.contains(address, F.lit("OutOfStock")), "Out of Stock").when(F.contains(address, F.lit("InStock")), "In Stock").otherwise(F.lit(""))


def page_currency(html: Column) -> Column:
    """Three letters that a page's scripts or markup declare as its currency; null if none."""
    patterns = (
        r"Shopify\.currency\s*=\s*\{[^}]*\"active\"\s*:\s*\"([A-Za-z]{3})\"",
        r"\"priceCurrency\"\s*:\s*\"([A-Za-z]{3})\"",
        r"\"currency\"\s*:\s*\"([A-Za-z]{3})\"",
    )
    return F.upper(first_filled(*(F.regexp_extract(html, p, 1) for p in patterns)))


def truncate_text(text: Column, size: int = 4000, mark: str = "\n... [truncated]") -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(mark))).otherwise(text)


def answer_object(text: Column) -> Column:
    """The JSON object in a model's answer: from a fenced block, the whole text, or the outermost braces; null if none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    outer = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    candidates = (fenced, trim_all(text), outer)
    return F.coalesce(*(F.when(c.startswith("{"), F.when(F.try_parse_json(c).isNotNull(), c)) for c in candidates))


def job_id() -> Column:
    return F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 12)


def header_charset(content_type: Column) -> Column:
    return F.lower(filled(F.regexp_extract(content_type, r"(?i)charset=\"?([^\s;\"]+)", 1)))


def fetch_reason(status: Column) -> Column:
    """Why a response is no success; blank for success, null for a null status."""
    text = status.cast("string")
    return (
        F.when(status == 429, "http_429").when(status >= 500, F.concat(F.lit("http_"), text)).when(status >= 400, F.concat(F.lit("client_error_"), text)).when(status.isNotNull(), "")
    )


def retry_delay(attempt: Column, delay: Column, status: Column) -> Column:
    """Seconds before an attempt (from 1): growing with it, and doubled per attempt on top after 429."""
    return delay * F.greatest(attempt, F.lit(1)) + F.when(status == 429, delay * F.pow(F.lit(2.0), attempt)).otherwise(F.lit(0.0))


def bounded_pages(wanted: Column, page_size: Column) -> Column:
    return F.greatest(F.lit(2), F.least(F.lit(5), F.ceil(F.coalesce(wanted, page_size * 3) / page_size))).cast("int")


def is_item(payload: Column) -> Column:
    """A discovered item is an object or a text; other JSON, and what is no JSON, is left out."""
    return F.coalesce(F.schema_of_variant(strict_json(payload)).rlike("^(?:OBJECT|STRING)"), F.lit(False))


# What a summary says where an answer leaves a field out.
SUMMARY_DEFAULTS = (
    ("title", "Website Data Summary"), ("business_type", "E-Commerce / Catalog"), ("summary", "Catalog extraction completed successfully."), ("estimated_catalog_size", "N/A"),
)


def summary_fields(answer: Column) -> list[Column]:
    """The fields of a summary from an answer's JSON object: texts with their defaults, lists that are empty unless the answer has a list."""
    v = F.try_parse_json(answer)
    texts = [F.coalesce(F.nullif(F.try_variant_get(v, f"$.{name}", "string"), F.lit("")), F.lit(default)).alias(name) for name, default in SUMMARY_DEFAULTS]
    lists = [F.coalesce(F.try_variant_get(v, f"$.{name}", "array<string>"), F.array().cast("array<string>")).alias(name) for name in ("key_highlights", "product_categories")]
    return texts + lists
