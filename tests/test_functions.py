from pyspark.sql import functions as F

from shelfspark.functions import scalar, urls
from shelfspark.functions.images import image_fields
from shelfspark.functions.listing import instant_micros, listing_id, product_path


def values(spark, f, *inputs):
    width = max(len(i) if isinstance(i, tuple) else 1 for i in inputs)
    rows = [(n, *(i if isinstance(i, tuple) else (i,))) for n, i in enumerate(inputs)]
    df = spark.createDataFrame(rows, "n int, " + ", ".join(f"c{k} {'double' if isinstance(rows[0][k + 1], float) else 'string'}" for k in range(width)))
    return [r["x"] for r in df.select("n", f(*(F.col(f"c{k}") for k in range(width))).alias("x")).orderBy("n").collect()]


def test_price_text(spark):
    assert values(spark, scalar.normalize_price, "Rs. 4,397", "5276.40", "14.99 - 25.99", "N/A", "Free", None, "", "0") == [4397.0, 5276.4, 14.99, None, None, None, None, 0.0]
    assert values(spark, scalar.detect_currency, "Rs. 4,500", "$99.00", "£45.50", "€30.00", "No price", None) == ["PKR", "USD", "GBP", "EUR", "", ""]
    assert values(spark, scalar.discount_percentage, (10000.0, 7500.0), (5.0, 5.0), (8.0, 7.0)) == ["25%", "", "12%"]
    assert values(spark, scalar.minor_units, "1000", "999", "10.50") == [10.0, 999.0, 10.5]


def test_text(spark):
    html = "<p>One<br/>two</p><script>x()</script><ul><li>a</li><li>b</li></ul><!-- c --> &amp; &quot;q&quot;"
    assert values(spark, scalar.html_to_text, html, None, "<nav>x</nav>") == ['One | two | a | b | & "q"', "", ""]
    assert values(spark, scalar.material, "soft Lawn and chiffon", None) == ["Lawn, Chiffon", ""]
    assert values(spark, scalar.pieces, "a 3-piece suit", "13 pc", "x") == ["3 Piece", "3 Piece", ""]
    assert values(spark, scalar.variant_count, '["a","b"]', "a||b||c", "x", "", None, "[broken") == [2, 3, 1, 0, 0, 1]
    assert values(spark, scalar.answer_object, 'x ```json\n{"a": 1}\n``` y', '{"b": 2}', "see {\"c\": 3} ok", "no", None) == ['{"a": 1}', '{"b": 2}', '{"c": 3}', None, None]
    assert values(spark, scalar.header_charset, "text/html; charset=UTF-8", "text/html", None) == ["utf-8", None, None]


def test_addresses(spark):
    base = "https://shop.example/a/b?x=1"
    joined = values(spark, urls.absolute_url, ("/p/1", base), ("//cdn.example/x", base), ("c.html", base), ("../d", base), ("?p=2", base), ("", base), ("http://o.example/", base))
    assert joined == ["https://shop.example/p/1", "https://cdn.example/x", "https://shop.example/a/c.html", "https://shop.example/d", "https://shop.example/a/b?p=2", "", "http://o.example/"]
    assert values(spark, urls.canonical_url, "https://A.example/x/?utm_source=f&v=1#t", "//b.example/y/", "ftp://c", None) == ["https://a.example/x?v=1", "https://b.example/y", "", ""]
    assert values(spark, urls.is_product_path, "/products/x", "/item/1", "/products", "/collections/all", "/cart", "/collections/a/products/b", None) == [True, True, False, False, False, True, False]
    assert values(spark, urls.next_page, "https://s/a?page=2&x=1", "https://s/page/3", "https://s/item/123", "https://s/a?offset=24&limit=24", "https://s/a") == [
        "https://s/a?page=3&x=1", "https://s/page/4", "https://s/item/124/", "https://s/a?offset=48&limit=24", None,
    ]
    unsafe = values(spark, urls.unsafe_reason, "http://127.0.0.1/", "http://localhost:80/", "http://169.254.169.254/x", "file:///etc", "https://shop.example/", "http://172.31.255.255", "http://172.32.0.1", "http://u@10.0.0.1/")
    assert unsafe == ["blocked_range", "blocked_host", "blocked_range", "scheme", "", "blocked_range", "", "blocked_range"]
    assert values(spark, urls.platform, "https://x.myshopify.com/", "https://x.example/collections/a", "https://x.example/product-category/a", "https://x.example/a") == ["shopify", "shopify", "woocommerce", "generic"]


def test_images(spark):
    df = spark.createDataFrame([(["/a_100x200.jpg?v=1", "/a.jpg?v=2", "//c.example/b.png", ""],), (None,)], "u array<string>")
    rows = [r.i for r in df.select(image_fields(F.col("u"), F.lit("https://s.example")).alias("i")).collect()]
    assert rows[0].main_image == "https://s.example/a.jpg?v=1" and rows[0].additional_images == "https://c.example/b.png"
    assert rows[1].all_images == ""


def test_listings(spark):
    assert values(spark, listing_id, " 12 ", "12.0", "gid://store/Product/12", "n/a", None, "0") == ["12", "12", "12", None, None, None]
    same = values(spark, product_path, "https://www.s.example/products/x/?a=1#t", "//s.example/collections/all/products/x", "https://s.example/collections/a", "https://s.example/goods.html?goods_id=1", None)
    assert same == ["products/x", "products/x", None, None, None]
    micros = values(spark, instant_micros, "2031-05-05T02:00:00+02:00", "2031-05-05 00:00:00", "1935619200", "1935619200000", "2031-05-05T00:00:00.000000Z", "soon", None)
    assert micros[:5] == [1935705600 * 10**6 - 0] * 2 + [1935619200 * 10**6] * 2 + [1935705600 * 10**6] and micros[5:] == [None, None]
