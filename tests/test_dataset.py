from pyspark.sql import functions as F

from shelfspark.operators import dataset as ds
from shelfspark.plans.normalize import normalize_records
from shelfspark.schema import UNIVERSAL_COLUMNS
from shelfspark.sources import markup, pages, sinks, storefront


def test_keep_first(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, None), (5, "b"), (6, "")], "n long, k string")
    assert sorted(r.n for r in ds.keep_first(df, ds.record_key("k"), "n").collect()) == [1, 3, 4, 5, 6]
    assert sorted(r.n for r in ds.keep_first(df, ds.record_key("k"), "n", keep_blank=False).collect()) == [1, 5]
    assert ds.duplicates_removed(df, ds.record_key("k")).first().duplicates == 1
    assert ds.keep_first(df.limit(0), ds.record_key("k"), "n").count() == 0


def test_resume_and_limits(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n long, k string")
    assert sorted(r.n for r in ds.resume_skip(df, spark.createDataFrame([("a",), ("a",)], "k string"), "k").collect()) == [2, 3]
    assert ds.first_records(df, ["n"], 0).count() == 3 and ds.first_records(df, ["n"], 2).count() == 2
    assert ds.blank_fields(df.withColumn("description", F.lit("x")), descriptions=False).first().description == ""


def test_normalize_is_idempotent_and_invents_nothing(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/products.parquet")
    once = normalize_records(raw)
    assert once.columns == UNIVERSAL_COLUMNS
    empty = normalize_records(spark.createDataFrame([(None,)], "product_name string")).first().asDict()
    assert {v for k, v in empty.items() if k not in ("variant_count", "currency_source")} <= {"", None}
    fields = ["product_name", "brand", "price", "list_price", "currency", "availability"]
    text = once.withColumns({c: F.col(c).cast("decimal(20,4)").cast("string") for c in ("price", "sale_price", "original_price", "list_price", "compare_at_price")})
    assert sorted(map(repr, normalize_records(text).select(*fields).collect())) == sorted(map(repr, once.select(*fields).collect()))


def test_listing_and_store_api(spark):
    body = '{"products": [{"id": 1, "title": "T", "variants": [{"id": 7, "price": "10", "available": false}, {"id": 8, "price": "20", "compare_at_price": "30", "sku": "S"}]}]}'
    paged = spark.createDataFrame([("s", 1, body), ("s", 2, '{"products": []}'), ("s", 3, body)], "source string, page_num int, body string")
    found = storefront.listing_products(paged, page_size=1)
    assert [(r.page_num, r.id) for r in found.collect()] == [(1, 1)]
    record = storefront.product_records(found.withColumn("source_domain", F.lit("s.example"))).first()
    assert (record.price, record.original_price, record.sku, record.availability) == (20.0, 30.0, "S", "In Stock")
    api = '[{"id": 5, "name": "N", "prices": {"price": "1999", "regular_price": "2999", "currency_code": "EUR"}, "categories": [{"name": "a"}, {"name": "b"}], "is_in_stock": false}]'
    row = storefront.store_api_records(spark.createDataFrame([("https://s.example", api)], "source string, body string")).first()
    assert (row.price, row.original_price, row.category, row.availability) == (19.99, 29.99, "a > b", "Out of Stock")


def test_markup(spark):
    assert markup.window_json('<script>window.raw = {"a": "}{", "b": [1]}; x</script>', "raw") == '{"a": "}{", "b": [1]}'
    assert markup.window_json("window.raw = {", "raw") is None and markup.window_json(None, "raw") is None
    html = '<script type="application/ld+json">[{"@graph": [{"@type": ["Product"], "name": "N", "offers": {"lowPrice": "5"}}, "x"]}]</script><script type="application/ld+json">{bad</script>'
    nodes = markup.json_ld_nodes(spark.createDataFrame([("https://s.example/p", html), ("u", None)], "url string, html string"))
    product = markup.json_ld_products(nodes).collect()
    assert [(p.product_name, p.price, p.availability) for p in product] == [("N", 5.0, "")]
    cards = "".join(f"<div class='card'><img src='/{i}.jpg'><h3><a href='/products/i{i}'>Item {i}</a></h3><b class='price'>$ {i}</b></div>" for i in range(3)) + "<div class='nav'><a href='/cart'>Cart</a></div>"
    got = markup.product_cards(spark.createDataFrame([("https://s.example/collections/a", cards), ("https://s.example/b", None)], "url string, html string")).collect()
    assert sorted((c.product_name, c.price) for c in got) == [("Item 0", "$ 0"), ("Item 1", "$ 1"), ("Item 2", "$ 2")]
    swept = markup.sweep_nodes(spark.createDataFrame([('{"z": {"name": "A", "price": 1}, "b": [{"title": "B", "variants": [1]}]}',), (None,), ("[",)], "t string"), (), "t")
    assert [r.n for r in swept.select(F.coalesce(F.try_variant_get("node", "$.name", "string"), F.try_variant_get("node", "$.title", "string")).alias("n")).collect()] == ["A", "B"]


def test_pages_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray("é".encode("latin-1")), "text/html; charset=latin-1"), (2, bytearray(b"\xef\xbb\xbfx"), None), (3, None, None)], "n int, body binary, kind string")
    assert [r.html for r in pages.decode_pages(df, "body", "kind").orderBy("n").collect()] == ["é", "x", None]
    fetched = pages.fetch_pages(spark.createDataFrame([("http://10.0.0.1/",), ("https://s.example/a",), ("https://s.example/b",)], "url string"), lambda u: (200, "t", b"x") if u.endswith("a") else 1 / 0).collect()
    assert sorted((r.status or 0, r.error or "") for r in fetched) == [(0, "ZeroDivisionError"), (0, "unsafe_blocked_range"), (200, "")]
    records = spark.createDataFrame([(1, 'say "x", y', None, "z")], "sku int, title string, brand string, extra string")
    sinks.write_csv(records, str(tmp_path / "csv"))
    back = sinks.read_csv(spark, str(tmp_path / "csv"))
    assert back.columns == [*UNIVERSAL_COLUMNS, "extra"] and back.first().title == 'say "x", y'
    sinks.append_done(records, "sku", str(tmp_path / "done"))
    assert sinks.read_done(spark, str(tmp_path / "done")).count() == 1 and sinks.read_done(spark, str(tmp_path / "none")).count() == 0
    assert "Missing SKU" in sinks.quality_report({"total": 1}, "s")


def test_stream_equals_batch(spark, sf_dir):
    from shelfspark.plans import catalog

    got = catalog.queries()["stream_first_arrivals"](spark, sf_dir)
    items = spark.read.parquet(f"{sf_dir}/discovery_items.parquet")
    keyed = items.filter("coalesce(item_key, '') <> ''")
    assert got.filter("coalesce(item_key, '') <> ''").count() == keyed.select("item_key").distinct().count()
    assert got.filter("coalesce(item_key, '') = ''").count() == items.count() - keyed.count()
