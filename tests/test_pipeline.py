from pyspark.sql import functions as F

from shelfspark.plans import adapters, pipeline

LD = '<script type="application/ld+json">{"@type": "Product", "name": "N%d", "offers": {"price": "%d"}}</script>'
PAGES = [
    ("https://a.example/products/1", LD % (1, 5)),
    ("https://a.example/products/2", "<h1>Meta</h1><meta property='product:price:amount' content='7'>"),
    ("https://a.example/products/3", '<script id="__NEXT_DATA__" type="application/json">{"p": {"title": "T", "variants": [{"price": "9"}, {"price": "8"}]}}</script>'),
    ("https://a.example/products/4", None),
    ("http://10.0.0.1/products/5", LD % (5, 5)),
    ("https://a.example/about", "<h1>About</h1>"),
]


def test_run(spark):
    pages = spark.createDataFrame(PAGES, "url string, html string")
    records, dead, audit = pipeline.run(pages)
    assert sorted((r.product_name, r.price, r.availability) for r in records.collect()) == [("Meta", 7.0, ""), ("N1", 5.0, ""), ("T", 8.0, "")]
    assert sorted((r.product_url[-1], r.reason) for r in dead.collect()) == [("4", "no_record"), ("5", "unsafe_blocked_range")]
    assert audit.first().total == 3


def test_goods_and_forms(spark):
    page = "<a href='/x-g-123.html?a=1' title='Top pick Lamp'><img src='/l.jpg'></a><a href='/goods.html?goods_id=9'></a>"
    got = adapters.goods_items(spark.createDataFrame([("https://www.temu.com/c.html", page)], "url string, html string")).collect()
    assert [(g.goods_id, g.product_name) for g in got] == [("123", "Lamp")]
    form = '<form data-product_variations="[{&quot;variation_id&quot;: 4, &quot;display_price&quot;: 2.5}]">'
    row = adapters.form_variations(spark.createDataFrame([("u", form), ("v", None)], "url string, html string")).collect()
    assert [(r.variant_id, r.variant_price, r.variant_availability) for r in row] == [("4", 2.5, "")]
    state = spark.createDataFrame([('{"store": {"banned": true}}', "x"), ('{"store": {}}', "Security Verification"), (None, "please solve the CAPTCHA")], "s string, h string")
    assert [r.b for r in state.select(adapters.blocked(F.col("h"), F.try_parse_json("s")).alias("b")).collect()] == [True, False, True]
