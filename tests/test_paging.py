from pyspark.sql import functions as F

from shelfspark.sources.paging import follow_pages, next_addresses, numbered_link


def test_numbered_link():
    page = "<div class='pager'><span class='current'>2</span><a href='?p=1'>1</a><a href='?p=3'><i>3</i></a></div>"
    assert numbered_link(page) == "?p=3"
    assert numbered_link("<a href='/no'>next</a><ul class='pagination'><li><a href='/b'>Next</a></li></ul>") == "/b"
    assert numbered_link("<nav aria-label='pagination'><a href='/c'>\u203a</a></nav>") == "/c"
    assert numbered_link("<ul class=pagination><a>2</a><br></ul></div>") is None
    assert numbered_link("") is None and numbered_link(None) is None and numbered_link("<a href='/x'>next</a>") is None


def shop(number):
    return f"<ul class='pagination'><b class='active'>{number}</b><a href='/l/{chr(97 + number)}'>{number + 1}</a></ul>"


def test_loop(spark):
    # Page 4 has no items of its own; page 3 of the other listing leads to itself.
    html = {f"https://a.b/l/{chr(96 + n)}": shop(n) + "".join(f"[{i}]" for i in items) for n, items in enumerate(([1, 2], [2, 3], [4], [4]), 1)}
    html |= {"https://c.d/l/a": "[7]", "https://e.f/l/a": "<ul class='pages'><a href='/l/a'>next</a></ul>[8]", "https://g.h/l/a": None}
    table = spark.createDataFrame([(u, h) for u, h in html.items()], "url string, html string")
    starts = spark.createDataFrame([(u,) for u in ("https://a.b/l/a", "https://c.d/l/a", "https://e.f/l/a", "https://g.h/l/a", "https://x.y/", None)], "url string")
    items = lambda pages: pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(r"\[(\d)\]"), F.lit(1))).alias("item_url"))
    fetch = lambda asked: asked.join(table, "url")
    got = sorted((r.start, r.page_num, r.item_url) for r in follow_pages(starts, fetch, items).collect())
    assert got == [("https://a.b/l/a", 1, "1"), ("https://a.b/l/a", 1, "2"), ("https://a.b/l/a", 2, "3"), ("https://a.b/l/a", 3, "4"), ("https://c.d/l/a", 1, "7"), ("https://e.f/l/a", 1, "8")]
    assert {r.page_num for r in follow_pages(starts, fetch, items, ceiling=1).collect()} == {1}
    assert follow_pages(starts, fetch, items, stop=lambda: True).count() == 0 and follow_pages(starts.limit(0), fetch, items).count() == 0


def test_order_of_ways(spark):
    rows = [("https://a.b/x?page=2", shop(5)), ("https://a.b/x", shop(5)), ("https://a.b/x", None)]
    got = [r.next_url for r in next_addresses(spark.createDataFrame(rows, "url string, html string")).collect()]
    assert got == ["https://a.b/x?page=3", "https://a.b/l/f", None]
