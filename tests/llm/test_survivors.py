from shelfspark.llm.survivors import listing_groups, surviving_records, surviving_values

SCHEMA = "row_id long, source_domain string, product_id string, product_url string, source_url string, product_name string, description string, price string, brand string, availability string, main_image string, scraped_at string"
ROWS = [
    (1, "s.example", "10", None, None, "Mug", "good", "5", "B", "In Stock", "a.jpg", "2031-01-01T00:00:00Z"),
    (2, "www.S.example", "gid://store/Product/10", "https://s.example/products/mug?a=1", None, "404 Not Found", "better", "Sold out", "n/a", None, "", "2031-01-02 00:00:00"),
    (3, "s.example", None, "//s.example/collections/x/products/mug/", None, "Mug {{title}}", " ", "7", "C", "-", "b.jpg", "2031-01-02T01:00:00+02:00"),
    (4, "t.example", "10", None, None, "Mug", "x", "1", "B", "y", "z", "1"),
    (5, "s.example", None, None, "https://s.example/collections/x?page=2", "lone", None, None, None, None, None, None),
    (6, "s.example", None, None, "https://s.example/collections/x?page=2", "lone", None, None, None, None, None, None),
    (7, "u.example", " 77 ", None, None, None, "", "none", None, None, None, None),
    (8, "u.example", "77.0", None, None, None, None, None, None, None, None, None),
    (9, None, "10", None, None, "x", None, None, None, None, None, None),
]


def brute(rows):
    return {1: {"product_name": 1, "description": 2, "price": 3, "brand": 3, "availability": 1, "main_image": 3}}


def test_groups_and_values(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    groups = {r.row_id: r.group_row_id for r in listing_groups(df).collect()}
    assert groups == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9}
    got = {}
    for r in surviving_values(df).collect():
        got.setdefault(r.group_row_id, {})[r.field_name] = r.from_row_id
    assert got == brute(ROWS)
    record = surviving_records(df).collect()
    assert [(r.group_row_id, r.product_name, r.description, r.price) for r in record] == [(1, "Mug", "better", "7")]
    assert surviving_values(df.limit(0)).count() == 0


def test_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([*ROWS, tuple([None] * 12), tuple([None] * 12)], SCHEMA)
    more = df.selectExpr("*", "row_id as group_row_id", "row_id as n", "brand as offered", "brand as bad", "brand as instant", "brand as key")
    got = {(r.group_row_id, r.field_name): r.from_row_id for r in surviving_values(more).collect()}
    assert {f: got[1, f] for f in brute(ROWS)[1]} == brute(ROWS)[1]


def test_ties_take_the_smallest_id_and_hot_groups_hold(spark):
    same = [(i, "s.example", "1", None, None, "Mug", None, None, None, None, None, "2031-01-01T00:00:00Z") for i in range(300, 0, -1)]
    got = surviving_values(spark.createDataFrame(same, SCHEMA)).collect()
    assert [(r.group_row_id, r.field_name, r.from_row_id) for r in got] == [(1, "product_name", 1)]
